import random

import pytest

from clausewise.llm import decontaminate as D


def made(seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(30))) for i in range(5)] + [(5, "only seven words stand in this item"), (6, "a b"), (7, None), (8, ""), (None, " ".join(text(20)))]
    docs = {}
    for i in range(5):
        words = items[i][1].split()
        docs[i] = text(200) + [w.upper() for w in words] + text(50)
        swapped = list(words)
        for j in (4, 11, 19, 26):
            swapped[j] = "zzz"
        docs[10 + i] = text(30) + swapped
        docs[20 + i] = text(100) + words[:9] + text(100)  # too short a piece
        docs[30 + i] = text(300)
        docs[40 + i] = words[8:21]
    docs[50] = text(40) + items[5][1].split() + text(3)
    docs[51] = text(40) + items[5][1].split()[:-1]
    docs[52] = ["a", "b"] * 500
    return items, {k: " ".join(v) for k, v in docs.items()}


@pytest.fixture(scope="module")
def tables(llm_spark, docs_of):
    items, docs = made()
    rows = list(docs.items()) + [(0, docs[0]), (60, None), (61, ""), (None, docs[1])]
    return docs_of(rows, clash=True), llm_spark.createDataFrame(items, "item_id long, text string")


def test_planted_passages(tables):
    rows = D.contaminated(*tables).collect()
    found = {(r.doc_id, r.item_id): (r.first_word, r.end_word, r.matching) for r in rows}
    want = {(a + i, i) for a in (0, 10, 40) for i in range(5)} | {(50, 5), (None, 1)}
    assert set(found) == want and len(rows) == len(want)
    assert found[0, 0] == (200, 230, 30) and found[10, 0] == (30, 60, 26) and found[40, 0] == (0, 13, 13) and found[50, 5] == (40, 47, 7)


def test_clean_documents_stay(tables):
    docs, items = tables
    kept = D.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [20, 21, 22, 23, 24, 30, 31, 32, 33, 34, 51, 52, 60, 61]


def test_empty(llm_spark, docs_of):
    items = llm_spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs_of([(1, "a b c")]), items).count() == 0
    assert D.clean(docs_of([(1, "a b c")]), items).count() == 1
    assert D.contaminated(docs_of([]), items).count() == 0


def test_clean_rows_of_shared_ids_stay(llm_spark, docs_of):
    """Only the rows that hold a passage go, not all rows of their (null or repeated) doc_id."""
    items, docs = made()
    rows = [(None, docs[0]), (None, docs[30]), (None, docs[31]), (None, None), (7, docs[1]), (7, docs[1]), (7, docs[32]), (7, ""), (8, docs[33])]
    kept = D.clean(docs_of(rows, clash=True), llm_spark.createDataFrame(items, "item_id long, text string"))
    want = [rows[i] for i in (1, 2, 3, 6, 7, 8)]
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted((str(i), str(t)) for i, t in want)


def accepted_without_seed(longest):
    """Patterns of matches (True) and substitutions up to ``longest`` that are accepted and meet no mask."""
    missed, todo = [], [((), 0, 0)]
    while todo:
        line, same, other = todo.pop()
        if line and line[-1] and same >= D.LEAST and same >= D.IDENTITY * len(line):
            missed.append(line)
        if len(line) == longest:
            continue
        for bit in (True, False):
            new = (*line, bit)
            a, b = same + bit, other + (not bit)
            if a <= D.PENALTY * b:  # the best stretch would begin later
                continue
            if any(len(new) >= len(m) and all(x or c == "0" for x, c in zip(new[-len(m) :], m, strict=True)) for m in D.MASKS):
                continue
            todo.append((new, a, b))
    return missed


def test_masks_meet_every_accepted_stretch():
    assert accepted_without_seed(26) == []


def test_long_stretches_without_seed_have_too_many_substitutions():
    """No cycle of mask-avoiding words has four matches for every substitution, so length does not help."""
    width = max(map(len, D.MASKS)) - 1
    states = [tuple(bool(i >> j & 1) for j in range(width)) for i in range(1 << width)]
    best = dict.fromkeys(states, 0.0)
    for _ in range(len(states) + 1):
        new = {}
        for s in states:
            for bit in (True, False):
                line = (*s, bit)
                if any(all(x or c == "0" for x, c in zip(line[-len(m) :], m, strict=True)) for m in D.MASKS):
                    continue
                to = line[1:]
                new[to] = max(new.get(to, -1e9), best[s] + (1 if bit else -4) + 1e-3)
        best = {s: new.get(s, -1e9) for s in states}
    # with a gain of 1 / 1000 a step, any cycle that breaks even would have lifted some state
    assert max(best.values()) < 0


def brute(docs, items):
    import numpy as np

    code = {}

    def words(t):
        return np.array([code.setdefault(w, len(code)) for w in (t or "").lower().split()], np.uint64)

    out = set()
    for doc_id, text in docs:
        a = words(text)
        for item_id, item in items:
            b = words(item)
            if len(b) < D.SHORTEST or not len(a):
                continue
            for shift in range(-len(b) + 1, len(a)):
                start, end, same = D.stretch(a, b, shift)
                if same >= min(D.LEAST, len(b)) and same >= D.IDENTITY * (end - start):
                    out.add((doc_id, item_id))
    return out


def test_against_all_shifts_of_all_items(llm_spark, docs_of):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(40)] * 3 + [f"u{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([4, 4, 5, 6, 9, 10, 11, 12, 15, 30, 60, 60])]
    items += [(12, "go go go go go go go go go go go go"), (13, "three short words"), (14, "one")]
    docs = []
    for i in range(160):
        item = rng.choice(items)[1].split()
        for j in range(len(item)):
            if (i % 4 == 0 and j % 5 == 4) or (i % 4 == 1 and rng.random() < 0.2) or (i % 4 == 2 and rng.random() < 0.1):
                item[j] = "other"
        pad = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 30))]
        docs.append((i, " ".join(pad + item[rng.randrange(0, 3) :] + pad)))
    docs += [(500, "go " * 3000), (501, None), (502, "three short words one")]
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs_of(docs), llm_spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute([d for d in docs if d[0] != 500], items)
    assert {g for g in got if g[0] != 500} == want and len(want) > 50
    assert {g[1] for g in got if g[0] == 500} == {12}
