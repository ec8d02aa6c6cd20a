import random

from clausewise.llm import quality as Q


def corpus(seed=8):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 7))) for _ in range(2000)]
    rows, good = [], {}
    for i in range(600):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        kind = i % 8 if i % 3 == 0 else 9
        if kind == 0:
            words = [w.upper() + "!!" for w in words]
        elif kind == 1:
            words = [w + rng.choice(["***", "%%%", "###"]) for w in words]
        elif kind == 2:
            words = [w for w in words[:6] for _ in range(12)]
        elif kind == 3:
            words = [x for w in words for x in (w, "|")]
        rows.append((i, " ".join(words)))
        good[i] = int(kind > 3)
    return rows, good


def test_weak_labels_recover_quality(docs_of):
    rows, good = corpus()
    extra = [(9000, None), (9001, ""), (9002, "ok"), (None, rows[1][1]), (9003, "fine words here " * 20_000)]
    got = Q.score(docs_of(rows + extra + [rows[0]], clash=True)).collect()
    assert len(got) == len(rows) + len(extra) + 1
    by = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 and r.keep == int(r.score >= Q.KEEP) for r in got)
    assert sum(by[i].keep == g for i, g in good.items()) / len(good) > 0.97
    assert all(by[i].keep for i, g in good.items() if g)
    assert by[9000].score == by[9001].score == 0 and not by[9000].keep


def test_posteriors_follow_the_votes(docs_of):
    import numpy as np

    n = len(Q.LABELLERS)
    patterns = np.array([sum(d * 3 ** (n - 1 - i) for i, d in enumerate(v)) for v in ([1] * n, [2] * 3 + [1] * (n - 3), [0] * n)])
    p = Q.estimate(patterns, np.array([900, 80, 20]))
    assert p[0] > 0.9 > 0.1 > p[1]
    assert list(Q.estimate(np.array([0]), np.array([5]))) == [0.5]


def test_empty(docs_of):
    assert Q.score(docs_of([])).count() == 0


def test_oversized_text_first(docs_of, monkeypatch):
    """A text above the byte budget at the first hash place is passed over, and the scorer still learns from the others."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(Q, "SAMPLE_BYTES", 1 << 20)
    rows, good = corpus()
    first = docs_of(rows).orderBy(F.xxhash64("doc_id"), "doc_id").first().doc_id
    rows = [(i, "fine words here " * 80_000 if i == first else x) for i, x in rows]
    by = {r.doc_id: r for r in Q.score(docs_of(rows)).collect()}
    assert sum(by[i].keep == g for i, g in good.items() if i != first) / len(good) > 0.97
