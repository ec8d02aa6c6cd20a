import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from clausewise.llm import partenum as P
from clausewise.llm import textkit as K


def near_copies(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(800)]
    docs = []
    for size in (4, 12, 25, 60, 200, 900):
        for _ in range(2):
            base = [rng.choice(vocabulary) for _ in range(size)]
            for rate in (0, 0, 0.003, 0.01, 0.01, 0.02, 0.02, 0.03, 0.05, 0.1):
                docs.append([rng.choice(vocabulary) if rng.random() < rate else w for w in base])
            docs.append(base + base[:3])
            docs.append(base[2:])
    docs += [["same"] * 40, ["same"] * 500, ["a"], ["A"], ["a", "b"]]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)] + [(1000, None), (1001, ""), (1002, " \t"), (3, " ".join(docs[3])), (None, " ".join(docs[5]))]
    rng.shuffle(rows)
    return rows


def brute(rows, n, percent):
    sets = K.text_shingles(pa.array([t for _, t in rows], pa.string()), n)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if len(sets[i]) and len(sets[j]) and P.similar(sets[i], sets[j], percent):
            root[find(i)] = find(j)
    name = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            name[find(i)] = min(doc_id, name.get(find(i), doc_id))
    return sorted((str(d), len(sets[i]), str(name.get(find(i)))) for i, (d, _) in enumerate(rows)), len({find(i) for i in range(len(rows))})


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_components_match_brute_force(docs_of, n, percent):
    rows = near_copies()
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in P.join(docs_of(rows, clash=True), n, percent).collect())
    assert got == brute(rows, n, percent)[0]


@pytest.mark.parametrize("few", [1, 4])
def test_small_blocks_give_the_same(docs_of, monkeypatch, few):
    """Groups above ``few`` open members go through the second hub and the blocks."""
    monkeypatch.setattr(P, "FEW_MEMBERS", few)
    monkeypatch.setattr(P, "BLOCK_ELEMENTS", 300)
    monkeypatch.setattr(P, "BLOCK_ROWS", 5)
    rows = near_copies(9)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in P.join(docs_of(rows), 3, 80).collect())
    assert got == brute(rows, 3, 80)[0]


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(2)
    for size in list(range(1, 40)) + [100, 333, 2000]:
        for percent in (80, 90):
            for _ in range(20):
                a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
                k = int((100 - percent) * 2 * size // (100 + percent))
                drop = int(rng.integers(0, k + 1))
                b = np.unique(np.concatenate((a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, k + 1 - drop)), dtype=np.uint64))))
                if len(b) and P.similar(a, b, percent):
                    row, sig = P.signatures([a, b], percent)
                    assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist())


def test_one_of_each(docs_of):
    rows = near_copies()
    kept = P.one_of_each(docs_of(rows, clash=True), 5, 80)
    _, groups = brute(rows, 5, 80)
    got = kept.collect()
    assert kept.columns == docs_of(rows, clash=True).columns
    assert len(got) == groups
    assert {1000, 1001, 1002} <= {r.doc_id for r in got}


def test_empty(docs_of):
    assert P.join(docs_of([]), 3, 90).count() == 0
    assert P.one_of_each(docs_of([(1, None)]), 3, 90).count() == 1


def test_graph_components(llm_spark):
    from clausewise.llm.graph import components

    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(400 + i, 401 + i) for i in range(60)] + [(600, 500 + i) for i in range(50)] + [(7, 7)]
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(llm_spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if any(x in p and p[0] != p[1] for p in links)}


def test_bit_maps_rule_out_no_similar_pair():
    rng = np.random.default_rng(5)
    ruled = 0
    for _ in range(600):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 400)), dtype=np.uint64))
        keep = a[rng.random(len(a)) < rng.choice([1, 0.95, 0.85, 0.6])]
        b = np.unique(np.concatenate((keep, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + len(a) // 5)), dtype=np.uint64))))
        if len(b):
            may = P.may_be_similar(P.bit_map(a), P.bit_map(b), len(a), len(b), 80)
            assert may or not P.similar(a, b, 80)
            ruled += not may
    assert ruled > 100


def test_sets_of_more_parts_than_have_stand_ins_share_a_signature():
    """Just above ``FEW_PARTS`` parts a set has no stand-ins for empty signatures; none of many similar pairs is lost."""
    rng = np.random.default_rng(12)
    first, last = P.bands(80)
    k = P.differences(last, 80)
    band = next(i for i in range(len(k)) if P.scheme(int(k[i]))[0] * P.scheme(int(k[i]))[1] > P.FEW_PARTS)
    for size in (int(first[band]), int(last[band])):
        for _ in range(500):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            gone = int((100 - 80) * size // 180)
            b = np.unique(np.concatenate((a[gone:], rng.integers(0, 1 << 63, gone, dtype=np.uint64))))
            if P.similar(a, b, 80):
                row, sig = P.signatures([a, b], 80)
                assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist())


def passages(seed=8, docs=60):
    """Texts that share one passage and little else, some near copies of one another, and mutual near copies without a centre."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(5000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(docs):
        own = [rng.choice(vocabulary) for _ in range(60)]
        rows.append((2 * i, " ".join(passage + own)))
        if i % 10 == 0:
            rows.append((2 * i + 1, " ".join(passage + own[:-2])))
    chain = [rng.choice(vocabulary) for _ in range(150)]
    for i in range(40):
        chain[rng.randrange(150)] = f"new{i}"
        rows.append((1000 + i, " ".join(chain)))
    return rows


def test_sets_that_only_share_a_passage_are_not_compared(docs_of, monkeypatch):
    """Their pairs grew with the square of the number of texts; what an open member holds alone rules it out before."""
    asked = []
    sifted = P.sifted
    monkeypatch.setattr(P, "sifted", lambda pairs, *rest: (asked.append(pairs.count()), sifted(pairs, *rest))[1])
    rows = [r for r in passages() if r[0] < 1000]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in P.join(docs_of(rows), 3, 80).collect())
    assert got == brute(rows, 3, 80)[0]
    assert sum(asked) < 60


def test_nearest_members_first_gives_the_same(docs_of, monkeypatch):
    """Blocks of large groups: nearest members first, a component that fills a chunk in chunks of its own."""
    for name, value in (("FEW_MEMBERS", 1), ("MANY_TIMES", 1), ("BLOCK_ELEMENTS", 2000), ("BLOCK_ROWS", 20)):
        monkeypatch.setattr(P, name, value)
    rows = passages(3) + [(2000 + (d or 0), t) for d, t in near_copies(2)]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in P.join(docs_of(rows), 3, 90).collect())
    assert got == brute(rows, 3, 90)[0]


def test_nearest_comes_once_for_each_member():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))
    sets = [np.unique(np.concatenate((base[i:], rng.integers(0, 1 << 63, 2, dtype=np.uint64)))) for i in range(12)]
    ids = np.arange(12)
    side = (ids, ids, np.array([len(s) for s in sets]), [P.bit_map(s) for s in sets])
    pairs = [np.concatenate(x) for x in zip(*P.block_pairs(side, side, 80, nearest=True), strict=True)]
    assert len(pairs[0]) <= 24 and set(pairs[0]) == set(range(12))
    every = [np.concatenate(x) for x in zip(*P.block_pairs(side, side, 80), strict=True)]
    assert {(a, b) for a, b in zip(*pairs[:2], strict=True)} <= {(a, b) for a, b in zip(*every[:2], strict=True)}


def test_words_are_hashed_together(monkeypatch):
    """Only words above ``LONG_WORD`` bytes are hashed one by one; a hash follows from a word's bytes alone."""
    rng = random.Random(3)
    long = "x" * (K.LONG_WORD + 1)
    texts = [" ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 40))) for _ in range(300)) for _ in range(20)] + [None, "", f"{long} a {long}y", "a\x00 a"]
    single = []
    digest = K.xxhash.xxh64_intdigest
    monkeypatch.setattr(K.xxhash, "xxh64_intdigest", lambda w: (single.append(w), digest(w))[1])
    K.text_shingles(pa.array(texts, pa.string()), 3)
    assert single == [long.encode(), f"{long}y".encode()]
    flat, _ = K.words(pa.array(texts, pa.string()))
    for at in (0, 7):  # a part of an array, too
        words, h = flat.slice(at).to_pylist(), K.word_hashes(flat.slice(at)).tolist()
        assert len(set(zip(words, h, strict=True))) == len(set(words)) == len(set(h))
    assert K.word_hashes(pa.array([b"a"], pa.binary()))[0] == K.word_hashes(pa.array([b"b", b"a"], pa.binary()))[1]


def test_set_keys_of_many_sets_are_those_of_each():
    sets = [np.arange(k, dtype=np.uint64) * np.uint64(1 << 60) for k in (0, 1, 5, 0, 40)]
    assert (P.set_keys(sets) == np.concatenate([P.set_keys([s]) for s in sets])).all()
    assert not P.set_keys(sets)[0].any() and P.set_keys([]).shape == (0, 2)
