import numpy as np
import pytest

from clausewise.llm import forest as A


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(ids, x, query, k=20):
    score = x.astype(float) @ x[ids.index(query)].astype(float)
    order = sorted((i for i in range(len(ids)) if ids[i] != query), key=lambda i: (-score[i], ids[i]))[:k]
    return [(ids[i], score[i]) for i in order]


@pytest.mark.parametrize("values", [A.BLOCK_VALUES, 256 * 16])
def test_recall_and_scores(llm_spark, monkeypatch, values):
    monkeypatch.setattr(A, "BLOCK_VALUES", values)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 16))
    x = (centres[rng.integers(0, 30, 3000)] + 0.4 * rng.standard_normal((3000, 16))).astype(np.float32) * rng.uniform(0.5, 2, (3000, 1)).astype(np.float32)
    x[100:900] = x[99]  # one vector in a quarter of the rows
    ids = list(range(3000))
    rows = [(i, v.tolist(), 0) for i, v in zip(ids, x, strict=True)]
    odd = [(4000, None, 0), (4020, [0.0] * 16, 0), (4040, [float("nan")] + [1.0] * 15, 0), (4060, [None] + [1.0] * 15, 0), (4080, [1.0], 0), (4100, [float("inf")] + [1.0] * 15, 0), (None, [1.0] * 16, 0)]
    got = {}
    for r in A.search(table(llm_spark, rows + odd + [rows[40]])).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        want = brute(ids, x, q)
        assert [f[0] for f in found] == list(range(1, 21)) and len({f[1] for f in found}) == 20
        assert all(abs(s - float(x[v].astype(float) @ x[q].astype(float))) < 1e-9 for _, v, s in found)
        least = want[-1][1] - 1e-9
        hits += sum(s >= least for _, _, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
    assert hits / (20 * len(got)) > 0.95
    # ties go to the smaller id
    assert [v for _, v, _ in got[120] if 99 <= v < 900][:5] == [99, 100, 101, 102, 103] or len([v for _, v, _ in got[120] if 99 <= v < 900]) < 5


def test_few_and_none(llm_spark):
    got = A.search(table(llm_spark, [(0, [1.0, 0.0], 1), (1, [0.5, 0.0], 1), (2, [0.0, 1.0], 1)])).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 1, 0.5), (0, 2, 2, 0.0)]
    assert A.search(table(llm_spark, [])).count() == 0
    assert A.search(table(llm_spark, [(0, [1.0, 2.0], 1)])).count() == 0
