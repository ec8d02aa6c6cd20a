import random
import re
import zlib
from collections import Counter

import pytest

from clausewise.llm import spelling as S


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    out = {}
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        out[w] = (best if best and n[best] >= 5 * n[w] else None, n[w], len(others))
    rows = {}
    for w, (form, count, close) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows[w] = (form, root, count, close, n[form] if form else None)
    return rows


def corpus():
    rnd = random.Random(11)
    stems = ["abandon", "zéphyrs", "committee", "accommodate", "aaaaaaa", "ÿÿÿÿÿÿ", "contract"]
    words = []
    for stem in stems:
        words += [stem] * 700
        for _ in range(12):
            i = rnd.randrange(len(stem) + 1)
            odd = rnd.choice([stem[:i] + "x" + stem[i:], stem[:i] + stem[i + 1 :], stem[:i] + "É" + stem[i + 1 :]])
            words += [odd] * rnd.choice([5, 6, 30, 139, 140, 141])
            words += [odd + "s"] * rnd.choice([4, 5, 9])
    rnd.shuffle(words)
    return [(i % 50 if i % 7 else None, " ".join(words[i : i + 40]).upper() if i % 3 else "-".join(words[i : i + 40])) for i in range(0, len(words), 40)]


@pytest.mark.parametrize("part_words", [1, 7, 20_000])
def test_against_brute_force(docs_of, part_words):
    rows = corpus() + [(1, None), (2, ""), (3, "x" * 5000), (4, "12 34")]
    rows += [rows[0], rows[0]]
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in S.variants(docs_of(rows, clash=True), part_words).collect()}
    want = brute([r[:2] for r in rows])
    assert got == want
    assert any(w[0] for w in want.values()) and any(w[1] != (w[0] or k) for k, w in want.items())


def test_empty_tables(docs_of):
    assert S.variants(docs_of([])).count() == 0
    assert S.variants(docs_of([(1, None), (None, "short words only")])).count() == 0


def test_acceptor_is_minimal_and_composition_complete():
    rnd = random.Random(3)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 7))) for _ in range(60)} | {"a" * 3000, "a" * 2999, "b" + "a" * 3000})
    acceptor = S.Acceptor(words)
    rests = {}
    for state in range(len(acceptor.arcs)):  # no two states read the same rests
        key = (acceptor.final[state], tuple(sorted(acceptor.arcs[state].items())))
        assert rests.setdefault(key, state) == state
    found = {tuple(sorted(p)) for p in S.Composed(acceptor).pairs()}
    assert found == {(a, b) for a in words for b in words if a < b and near(a, b)}


def test_long_words_take_linear_time(docs_of):
    long = "q" * 100_000
    rows = [(i, long + " " + long + "z") for i in range(5)]
    got = {len(r["word"]): r["n_near"] for r in S.variants(docs_of(rows)).collect()}
    assert got[100_000] == 1 and got[100_001] == 1
