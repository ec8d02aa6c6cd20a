"""Nearest neighbours by inner product with a hash-prefix forest.

Every tree gives a vector a string of ``BITS`` random-hyperplane bits; a tree is the sorted array of its strings, and the
vectors that share a prefix with a query stand side by side in it. Vectors get one more coordinate that brings them all
to the length of the longest, so that the largest inner product is the smallest angle.

Search runs in two steps. Down: in every tree the query goes to its longest prefix that still leaves ``FIRST`` vectors,
which gives a first k-th best score. Up: that score is an angle, and with it the chance that a vector at least as near
shares a prefix of a given length with the query in at least one tree is known. All trees ascend together to the longest prefix
for which that chance reaches ``TARGET``, and everything below it is scored exactly. Clustered data stop at long
prefixes, data without structure at short ones; no count of candidates caps the search.

Trees are cut by their first bits (the trunk) into blocks of bounded size; a trunk that holds too many vectors, such as a
vector repeated in a third of all rows, is salted into several blocks, and the queries that visit a block are dealt out
in chunks. The table of trunks has at most ``TREES`` x 2^``TRUNK_BITS`` rows by construction.

Vectors that are null, zero, of another length than most, or hold null or non-finite numbers take no part, nor do null ids.
Rows with the query's id are the query itself; an id that occurs twice is found once with its best score, and queries
with its largest vector. With fewer than k other vectors all are returned; without vectors the result is empty.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausewise.session import materialise

TREES = 16
BITS = 32
TRUNK_BITS = 12
BLOCK_VALUES = 1 << 20
QUERY_CHUNK = 4096
FIRST = 300
TARGET = 0.97
K = 20
FOUND = "query_id long, vec_id long, score double"


def usable(rows: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """``vec_id, vector`` of the rows that take part, and the length of their vectors."""
    v = F.col(vector)
    good = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    clean = rows.filter(F.col("vec_id").isNotNull() & good).select(F.col("vec_id").cast("long"), v.cast("array<double>").alias("vector"))
    most = clean.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return (clean.filter(F.size("vector") == most["n"]), most["n"]) if most else (clean, 0)


def planes(dim: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim + 1, TREES * BITS))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def encoded(rows: DataFrame, dim: int, longest: float, queries: bool) -> DataFrame:
    """Adds ``codes``, the hash string of every tree as a number. Queries have no share in the added coordinate."""
    table = rows.sparkSession.sparkContext.broadcast(planes(dim))

    def run(batches):
        powers = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)
        for batch in batches:
            x = matrix(batch.column("vector")) / longest
            more = np.zeros(len(x)) if queries else np.sqrt(np.maximum(0, 1 - (x**2).sum(1)))
            bits = (np.concatenate((x, more[:, None]), 1) @ table.value > 0).reshape(len(x), TREES, BITS)
            codes = (bits @ powers).reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("vector"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * TREES), pa.array(codes))],
                ["vec_id", "vector", "codes"],
            )

    return rows.mapInArrow(run, "vec_id long, vector array<double>, codes array<long>")


def nearest(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per row the k best (ids, scores), ties to the smaller id; the row's own id is left out."""
    out = []
    scores[own[:, None] == ids[None, :]] = -np.inf
    cut = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(own), -np.inf)
    for row, least in zip(scores, cut, strict=True):
        at = np.flatnonzero((row >= least) & (row > -np.inf))
        at = at[np.lexsort((ids[at], -row[at]))[:k]]
        out.append((ids[at], row[at]))
    return out


def _block(k: int, down: bool, trunk_bits: int):
    """Search of one block: its sorted hash strings against the queries that visit it."""

    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if points.num_rows and queries.num_rows:
            code = points["code"].to_numpy()
            order = np.argsort(code, kind="stable")
            code, ids = code[order], points["vec_id"].to_numpy()[order]
            x = matrix(points["vector"].combine_chunks())[order]
            q, own, want = matrix(queries["vector"].combine_chunks()), queries["vec_id"].to_numpy(), queries["code"].to_numpy()
            if down:
                low, high = np.zeros(len(own), np.int64), np.full(len(own), len(code))
                for depth in range(trunk_bits, BITS + 1):
                    a, b = _range(code, want, np.full(len(own), depth))
                    enough = b - a >= FIRST
                    low, high = np.where(enough, a, low), np.where(enough, b, high)
            else:
                low, high = _range(code, want, queries["depth"].to_numpy())
            ranges, back = np.unique(np.stack((low, high), 1), axis=0, return_inverse=True)
            back = back.reshape(-1)
            for i, (a, b) in enumerate(ranges):
                mine = np.flatnonzero(back == i)
                for part in np.array_split(mine, -(-len(mine) // 256)):
                    if b > a:
                        best = nearest(q[part] @ x[a:b].T, ids[a:b], own[part], k)
                        found += [(np.full(len(v), own[p]), v, s) for p, (v, s) in zip(part, best, strict=True)]
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def _range(code: np.ndarray, want: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the strings that share their first ``depth`` bits with each wanted string."""
    rest = np.int64(BITS) - depth
    first = (want >> rest) << rest
    return np.searchsorted(code, first), np.searchsorted(code, first + (np.int64(1) << rest))


def _visit(points: DataFrame, queries: DataFrame, salts: DataFrame, down: bool, trunk_bits: int, k: int) -> DataFrame:
    """Score ``queries(vec_id, vector, tree, code, trunk, depth)`` in all blocks of their trunks."""
    keys = ["tree", "trunk", "salt", "chunk"]
    visits = queries.groupBy("tree", "trunk").agg(F.ceil(F.count("*") / QUERY_CHUNK).cast("int").alias("chunks"))
    plan = F.broadcast(salts.join(visits, ["tree", "trunk"]))  # at most TREES x 2^TRUNK_BITS rows
    left = (
        points.join(plan, ["tree", "trunk"])
        .withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("salts")).cast("int"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    )
    right = (
        queries.join(plan, ["tree", "trunk"])
        .withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    )
    return left.select(*keys, "vec_id", "vector", "code").groupBy(*keys).cogroup(right.select(*keys, "vec_id", "vector", "code", "depth").groupBy(*keys)).applyInArrow(_block(k, down, trunk_bits), FOUND)


def search(rows: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each row whose ``vec_id`` is divisible by ``every``."""
    vectors, dim = usable(rows)
    size = vectors.agg(F.count("*"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).first()
    if not size[0]:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    longest = math.sqrt(size[1])
    trunk_bits = min(TRUNK_BITS, max(0, math.ceil(math.log2(size[0] / max(256, BLOCK_VALUES // dim)))))
    trunk = F.shiftright("code", BITS - trunk_bits)
    points = encoded(vectors, dim, longest, False).select("vec_id", "vector", F.posexplode("codes").alias("tree", "code")).withColumn("trunk", trunk)
    points = materialise(points)
    salts = materialise(points.groupBy("tree", "trunk").agg(F.ceil(F.count("*") / max(256, BLOCK_VALUES // dim)).cast("int").alias("salts")))
    asked = vectors.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.max("vector").alias("vector"))
    queries = materialise(encoded(asked, dim, longest, True).select("vec_id", "vector", F.posexplode("codes").alias("tree", "code")).withColumn("trunk", trunk))
    first = materialise(_visit(points, queries.withColumn("depth", F.lit(BITS).cast("long")), salts, True, trunk_bits, k))
    # the k-th best distinct vector of each query so far, as the prefix length at which nearer ones are met with TARGET
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = lambda found: found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    last = merged(first).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).groupBy("query_id").agg(F.min("score").alias("least"), F.max("rank").alias("n"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    share = math.log(1 - (1 - TARGET) ** (1 / TREES))
    near = F.lit(1.0) - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("least") / (norm * longest)))) / math.pi
    depth = F.when(F.coalesce(F.col("n"), F.lit(0)) < k, 0).when(near >= 1, BITS).otherwise(F.floor(F.least(F.lit(share) / F.log(F.greatest(near, F.lit(1e-9))), F.lit(float(BITS)))))
    ready = queries.join(last, queries["vec_id"] == last["query_id"], "left").withColumn("depth", depth.cast("long")).drop("query_id", "n", "least")
    # a prefix shorter than the trunk opens several trunks
    open_bits = F.greatest(F.lit(trunk_bits) - F.col("depth"), F.lit(0)).cast("int")
    low = F.expr("shiftleft(shiftright(trunk, open), open)")
    ready = ready.withColumn("open", open_bits).withColumn("trunk", F.explode(F.sequence(low, low + F.expr("shiftleft(1L, open)") - 1))).drop("open")
    second = _visit(points, ready.select("vec_id", "vector", "tree", "code", "trunk", "depth"), salts, False, trunk_bits, k)
    best = merged(first.union(second)).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
