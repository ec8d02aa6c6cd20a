import hashlib
import random
import re

import pytest

from clausewise.llm import debruijn as D


def brute(texts, window):
    rows = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    places = {}
    for r, words in enumerate(rows):
        for i in range(len(words) - window + 1):
            places.setdefault(tuple(words[i : i + window]), []).append((r, i))
    gone = [set() for _ in rows]
    for found in places.values():
        if len(found) > 1:
            for r, i in found:
                gone[r].update(range(i, i + window))
    return [(len(w), len(g), " ".join(x for i, x in enumerate(w) if i not in g)) for w, g in zip(rows, gone, strict=True)]


def got(docs, window):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in D.removed(docs, window, True).collect()}


def test_against_brute_force(docs_of):
    rnd = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    texts = [None, "", " \t\n", "one", "a a a a a a a a a a a a", "A a A a A a A a B a A a A a A a A a", "x " * 3000 + "tail"]
    for _ in range(60):
        words = [rnd.choice("abcdefgh") for _ in range(rnd.randrange(0, 60))]
        at, a = rnd.randrange(0, len(words) + 1), rnd.randrange(0, 50)
        texts.append("  ".join(words[:at] + passage[a : a + rnd.randrange(0, 20)] + words[at:]))
    texts += [texts[20], texts[20], texts[21] + " more", "\x0bétude\x85non " * 9]
    docs = docs_of(list(enumerate(texts)), clash=True)
    for window in (1, 2, 5, 35):
        want = brute(texts, window)
        found = got(docs, window)
        assert len(found) == len(texts)
        assert [found[i] for i in range(len(texts))] == want


def test_nulls_repeats_and_empty_tables(docs_of):
    line = " ".join(f"w{i}" for i in range(40))
    rows = [(None, line), (None, line), (7, "begin " + line), (7, None), (8, line[:60]), (7, None)]
    out = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in D.removed(docs_of(rows)).collect())
    none = hashlib.sha256(b"").hexdigest()
    assert out == sorted([("None", 40, 40, none)] * 2 + [("7", 41, 40, hashlib.sha256(b"begin").hexdigest())] + [("7", 0, 0, none)] * 2 + [("8", len(line[:60].split()), 0, hashlib.sha256(line[:60].encode()).hexdigest())])
    assert D.removed(docs_of([])).count() == 0
    kept = {(r["doc_id"], r["text"]) for r in D.clean(docs_of(rows, clash=True)).collect()}
    assert kept == {(None, ""), (7, "begin"), (7, None), (8, line[:60])}


def test_a_shared_passage_is_one_path(docs_of):
    passage = " ".join(f"w{i}" for i in range(80))
    docs = docs_of([(i, f"left{i} {passage} right{i}") for i in range(5)] + [(9, passage.replace("w40", "other"))])
    found = {(r["doc_id"], r["start"], r["n_words"]) for r in D.passages(docs).collect()}
    # document 9 shares the first 40 and the last 39 words, so the path forks there
    assert {(9, 0, 40), (9, 41, 39)} <= found
    whole = [f for f in found if f[0] == 0]
    assert min(f[1] for f in whole) == 1 and max(f[1] + f[2] for f in whole) == 81


def test_false_paths_are_taken_back(docs_of, monkeypatch):
    """With hashes of few bits windows clash; what has no equal words elsewhere is not removed."""
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("abcdefghijklmnop") for _ in range(80)) for _ in range(20)] + ["q r s t u v w x y z"] * 2
    docs = docs_of(list(enumerate(texts)))
    want = brute(texts, 6)
    plain = D.Rolling.of
    monkeypatch.setattr(D.Rolling, "of", lambda self, start, length: plain(self, start, length) % (1 << 12))
    found = got(docs, 6)
    for i, (n, gone, kept) in enumerate(want):
        assert found[i][0] == n and found[i][1] <= gone
    assert found[20] == want[20] == (10, 10, "")


@pytest.mark.parametrize("bits", [1, 5])
def test_rolling_hash_sees_order_and_length(bits):
    import numpy as np

    h = np.arange(1, 50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    r = D.Rolling(np.concatenate((h, h[::-1], h)))
    a = r.of(np.arange(0, 40), bits)
    assert (a == r.of(np.arange(98, 138), bits)).all() and len(set(a.tolist())) == 40
    assert bits == 1 or not set(a.tolist()) & set(r.of(np.arange(49, 89), bits).tolist())
