import hashlib
import random

import numpy as np
import pytest

from clausewise.llm import hilbert as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, rounds=6, parts=8, entries=16):
    """rows: (vec_id, list, label) -> {position: (code, error, label_error)}, digest; in Python's integers."""
    kept = [(i, r) for i, r in enumerate(rows) if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    kept.sort(key=lambda t: (t[1][0] is None, t[1][0] or 0, t[1][1]))
    vectors = [[int(np.floor(np.float64(x) * 4096)) for x in r[1]] for _, r in kept]
    width = len(vectors[0]) // parts
    books = [[v[p * width : (p + 1) * width] for v in vectors[:entries]] for p in range(parts)]

    def nearest(piece, book):
        far = [sum((a - b) ** 2 for a, b in zip(piece, e, strict=True)) for e in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in vectors:
                piece = v[p * width : (p + 1) * width]
                groups.setdefault(nearest(piece, books[p])[0], []).append(piece)
            for e, found in groups.items():
                books[p][e] = [sum(c) // len(found) for c in zip(*found, strict=True)]
    out, labels = {}, {}
    for (i, r), v in zip(kept, vectors, strict=True):
        found = [nearest(v[p * width : (p + 1) * width], books[p]) for p in range(parts)]
        out[i] = ("".join(f"{e:02x}" for e, _ in found), sum(f for _, f in found))
        labels[r[2]] = labels.get(r[2], 0) + out[i][1]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {i: (c, e, labels[rows[i][2]]) for i, (c, e) in out.items()}, digest


def vectors(n, dim, seed, scale=1.0):
    rnd = random.Random(seed)
    return [[float(np.float32(rnd.gauss(0, scale))) for _ in range(dim)] for _ in range(n)]


@pytest.mark.parametrize("n,dim,scale", [(300, 32, 1.0), (40, 8, 1.0), (9, 16, 0.1), (60, 16, 1e4), (60, 16, 1e9)])
def test_against_brute_force(llm_spark, n, dim, scale):
    rows = [(i * 3, v, i % 4 if i % 5 else None) for i, v in enumerate(vectors(n, dim, n, scale))]
    rows += [(1000 + i, rows[2][1], 2) for i in range(n // 2)]  # very many equal vectors
    want, digest = brute(rows)
    df = llm_spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["vec_id"]: r for r in H.codes(df).collect()}
    assert len(got) == len(rows)
    for i, (code, error, label_error) in want.items():
        r = got[rows[i][0]]
        assert (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) == (code, min(error, H.MOST), min(label_error, H.MOST), digest)


def test_left_out_and_clashing_columns(llm_spark):
    from pyspark.sql import functions as F

    good = [(i, v, None) for i, v in enumerate(vectors(20, 16, 3))]
    bad = [(50, None, 1), (51, [], 1), (52, [1.0] * 15 + [None], 1), (53, [float("nan")] * 16, 1), (54, [float("inf")] + [0.0] * 15, 1), (55, [1.0] * 24, 1), (56, [1.0] * 3, 1)]
    tied = [(None, good[0][1], 1), (3, good[4][1], 1), (3, good[4][1], 1)]
    df = llm_spark.createDataFrame(good + bad + tied, SCHEMA)
    for c in ("row", "part", "ints", "code", "error", "_label", "n"):
        df = df.withColumn(c, F.lit(1))
    got = H.codes(df).collect()
    want, digest = brute(good + tied)
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"]) for r in got) == sorted((str((good + tied)[i][0]), *w) for i, w in want.items())
    assert {r["codebooks_sha256"] for r in got} == {digest}
    assert H.codes(llm_spark.createDataFrame([], SCHEMA)).count() == 0
    assert H.codes(llm_spark.createDataFrame(bad[:5], SCHEMA)).count() == 0


def test_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims)).reshape(dims, -1).T
        place = H.curve_places(grid, bits)
        assert sorted(place.tolist()) == list(range(len(grid)))
        steps = np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(1)
        assert (steps == 1).all()


def test_shortlist_never_misses():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        book = rnd.integers(-50, 50, (16, 3))
        data = rnd.integers(-20, 20, (30, 3)) + rnd.integers(-40, 40, 3)
        near = H.shortlist(data.min(0), data.max(0), book)
        best = ((data[:, None] - book[None]) ** 2).sum(2).argmin(1)
        assert set(best.tolist()) <= set(near.tolist())
