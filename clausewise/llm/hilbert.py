"""Product codes of vectors: exact integer k-means per part over Hilbert-sorted flat blocks.

Components become integers, vectors are cut into ``PARTS`` parts, and each part position has a codebook of at most
``ENTRIES`` entries. Parts are sorted along a Hilbert curve by Spark (a range sort by part position and place on the curve) and
packed into flat blocks of ``BLOCK_ROWS`` neighbours that keep the smallest and largest value of every component (a box) and
the sums. In each round a block compares its box with the entries: an entry whose least distance to the box is above
another's largest distance cannot be nearest to any part of the block. What is left is the block's shortlist. A
shortlist of one takes the whole block by its sums; others are evaluated by a small kernel in exact integers.

Blocks are read once per round and never moved; a round sends back sums per part and entry, whose number is fixed.
Integers are 64 bits wide, and blocks whose box allows larger squares are evaluated with Python's integers, so no result
is rounded; components beyond 2^63 stop there, and so do errors.

Vectors that are null, empty, or hold null or non-finite components are left out, and so are vectors whose length is not
that of the vector of smallest vec_id or not a multiple of ``PARTS``. With fewer than ``ENTRIES`` vectors a codebook has as many
entries. Of equal vec_ids the smaller vector comes first; null vec_ids come last. Repeated rows are coded each. Rows
with a null label make one group. An empty table gives an empty result. Extra columns may have any names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.session import materialise

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
BLOCK_ROWS = 256
#: Differences below this keep sums of squares of up to 2^13 components inside 64 bits.
NARROW = 1 << 24
MOST = (1 << 63) - 1
WIDE = "decimal(38,0)"


def integers(vectors: DataFrame) -> DataFrame:
    """``row, vec_id, label, ints`` of the vectors that take part (but for the rule on lengths)."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.select("vec_id", "label", x.cast("array<double>").alias("embedding")).filter(x.isNotNull() & (F.size(x) > 0) & fine)
    ints = F.transform("embedding", lambda v: F.floor(v * SCALE).cast("long"))
    return kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", ints.alias("ints")).filter(F.size("ints") % PARTS == 0)


def curve_places(points: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of points with coordinates of ``bits`` bits.

    Bit by bit from the top, a set coordinate bit mirrors the lower bits of the first axis, a clear one swaps them with
    the first axis; the Gray code of what is left, read across the axes, is the place.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        high, low = 1 << level, (1 << level) - 1
        for i in range(dims):
            mirror = (x[i] & high) > 0
            swap = np.where(mirror, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(mirror, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> level) & 1)
    return out


def spread_of(kept: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each component, for the grid of the curve only (they do not change any result)."""

    def run(batches):
        count, total, squares = 0, np.zeros(dim), np.zeros(dim)
        for batch in batches:
            x = batch.column("ints").flatten().to_numpy().reshape(-1, dim).astype(np.float64)
            count, total, squares = count + len(x), total + x.sum(0), squares + (x * x).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(np.full(dim, float(count))), pa.array(total), pa.array(squares)], ["at", "n", "total", "squares"])

    sums = kept.select("ints").mapInArrow(run, "at long, n double, total double, squares double").groupBy("at").agg(F.sum("n"), F.sum("total"), F.sum("squares")).orderBy("at").toArrow()
    n, total, squares = (sums.column(i).to_numpy() for i in (1, 2, 3))
    mean = total / np.maximum(n, 1)
    return mean, np.sqrt(np.maximum(squares / np.maximum(n, 1) - mean**2, 0))


def placed_parts(kept: DataFrame, dim: int) -> DataFrame:
    """``part, place, row, piece``: every part of every vector with its place on the curve of its position."""
    mean, deviation = spread_of(kept, dim)
    width = dim // PARTS
    bits = max(1, min(10, 62 // width))
    axes = min(width, 62)

    def run(batches):
        for batch in batches:
            x = batch.column("ints").flatten().to_numpy().reshape(-1, dim)
            row = batch.column("row")
            grid = (x.astype(np.float64) - mean) / np.where(deviation > 0, 4 * deviation, 1) + 0.5
            grid = np.clip(np.floor(grid * (1 << bits)), 0, (1 << bits) - 1).astype(np.int64)
            for part in range(PARTS):
                mine = slice(part * width, (part + 1) * width)
                flat = pa.array(np.ascontiguousarray(x[:, mine]).reshape(-1))
                piece = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), flat)
                place = curve_places(grid[:, mine][:, :axes], bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), part, np.int32)), pa.array(place), row, piece], ["part", "place", "row", "piece"])

    return kept.select("row", "ints").mapInArrow(run, "part int, place long, row long, piece array<long>")


BLOCK = f"part int, n int, rows binary, data binary, low array<long>, high array<long>, sums array<{WIDE}>"


def blocks(parts: DataFrame, width: int) -> DataFrame:
    """Flat blocks of neighbours on the curve; the row number splits places that very many parts share."""

    def run(batches):
        held: list[tuple] = []
        count = 0

        def packed(rows, data, part):
            for a in range(0, len(rows), BLOCK_ROWS):
                x, r = data[a : a + BLOCK_ROWS], rows[a : a + BLOCK_ROWS]
                yield part, len(x), r.tobytes(), x.tobytes(), x.min(0).tolist(), x.max(0).tolist(), x.astype(object).sum(0).tolist()

        def cut():
            part = np.concatenate([h[0] for h in held])
            rows = np.concatenate([h[1] for h in held])
            data = np.concatenate([h[2] for h in held])
            out = [b for p in np.unique(part) for b in packed(rows[part == p], data[part == p], int(p))]
            types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.decimal128(38, 0)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["part", "n", "rows", "data", "low", "high", "sums"])

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column("part").to_numpy(), batch.column("row").to_numpy(), batch.column("piece").flatten().to_numpy().reshape(-1, width)))
                count += batch.num_rows
            if count >= 16 * BLOCK_ROWS:
                yield cut()
                held, count = [], 0
        if held:
            yield cut()

    return parts.repartitionByRange("part", "place", "row").sortWithinPartitions("part", "place", "row").select("part", "row", "piece").mapInArrow(run, BLOCK)


def shortlist(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The entries that can be nearest to some point of the box, as indexes in order."""
    under, over = low - book, book - high
    outside = np.where(under > 0, under, np.where(over > 0, over, 0))
    across = np.where(np.abs(under) > np.abs(over), under, over)
    least, most = (outside * outside).sum(1), (across * across).sum(1)
    return np.flatnonzero(least <= most.min())


def as_integers(values: list, narrow: bool) -> np.ndarray:
    return np.array(values, dtype=np.int64 if narrow else object)


def assigned(data: np.ndarray, low: list, high: list, book: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shortlist, index into it of each part's nearest entry (ties: the lower), and the exact squared distances."""
    span = max(max(abs(v) for v in [*low, *high]), max(abs(v) for e in book for v in e))
    narrow = span < NARROW
    entries = as_integers(book, narrow)
    near = shortlist(as_integers(low, narrow), as_integers(high, narrow), entries)
    if len(near) == 1:
        return near, np.zeros(len(data), np.int64), None
    gap = data.astype(entries.dtype)[:, None, :] - entries[near][None, :, :]
    far = (gap * gap).sum(2)
    best = far.argmin(1)
    return near, best, far[np.arange(len(data)), best]


def round_sums(packed: DataFrame, books, width: int) -> DataFrame:
    """``part, entry, n, sums``: of the parts that each entry is nearest to; a task sends each entry once."""

    def run(batches):
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            for block in batch.to_pylist():
                part = block["part"]
                data = np.frombuffer(block["data"], np.int64).reshape(-1, width)
                near, best, _ = assigned(data, block["low"], block["high"], books.value[part])
                for i, entry in enumerate(near.tolist()):
                    if len(near) == 1:
                        n, sums = block["n"], [int(v) for v in block["sums"]]
                    else:
                        mine = data[best == i]
                        n, sums = len(mine), mine.astype(object).sum(0).tolist() if len(mine) else [0] * width
                    if n:
                        old = total.setdefault((part, entry), [0, [0] * width])
                        old[0] += n
                        old[1] = [int(a) + int(b) for a, b in zip(old[1], sums, strict=True)]
        at = [(p, e, v[0], i, s) for (p, e), v in total.items() for i, s in enumerate(v[1])]
        columns = list(zip(*at, strict=True)) or [[]] * 5
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["part", "entry", "n", "at", "total"])

    found = packed.mapInArrow(run, f"part int, entry int, n long, at int, total {WIDE}")
    return found.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").cast(WIDE).alias("total"))


def final_codes(packed: DataFrame, books, width: int) -> DataFrame:
    """``row, part, entry, error`` of every part."""

    def run(batches):
        for batch in batches:
            for block in batch.to_pylist():
                data = np.frombuffer(block["data"], np.int64).reshape(-1, width)
                book = books.value[block["part"]]
                near, best, error = assigned(data, block["low"], block["high"], book)
                if error is None:
                    gap = data.astype(object) - np.array(book[near[0]], dtype=object) if max(map(abs, [*block["low"], *block["high"], *book[near[0]]])) >= NARROW else data - np.array(book[near[0]], np.int64)
                    error = (gap * gap).sum(1)
                errors = [min(int(v), MOST) for v in error]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(block["rows"], np.int64)), pa.array(np.full(len(data), block["part"], np.int32)), pa.array(near[best].astype(np.int32)), pa.array(errors, pa.int64())],
                    ["row", "part", "entry", "error"],
                )

    return packed.mapInArrow(run, "row long, part int, entry int, error long")


def learnt(packed: DataFrame, first: list[list[int]], width: int, rounds: int) -> list[list[list[int]]]:
    """The codebooks after all rounds, by part position."""
    context = packed.sparkSession.sparkContext
    books = [[v[part * width : (part + 1) * width] for v in first] for part in range(PARTS)]
    for _ in range(rounds):
        sums = round_sums(packed, context.broadcast(books), width).collect()  # at most PARTS x ENTRIES x width rows
        for r in sums:
            books[r["part"]][r["entry"]] = list(books[r["part"]][r["entry"]])
            books[r["part"]][r["entry"]][r["at"]] = int(r["total"]) // r["n"]
    return books


def codes(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of ``vec_id, embedding, label`` (and more)."""
    every = materialise(integers(vectors))
    size = F.size("ints")
    order = [F.col("vec_id").asc_nulls_last(), F.col("ints")]
    head = every.orderBy(*order).select(size.alias("dim")).limit(1).collect()
    dim = head[0]["dim"] if head else PARTS
    kept = every.filter(size == dim)
    first = [list(r["ints"]) for r in kept.orderBy(*order).limit(ENTRIES).collect()]
    width = dim // PARTS
    if not first:
        books: list = []
        coded = kept.select("row", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        packed = materialise(blocks(placed_parts(kept, dim), width))
        books = learnt(packed, first, width, rounds)
        shift = (PARTS - 1 - F.col("part")) * 8
        byte = F.expr("shiftleft(cast(entry as bigint), (7 - part) * 8)") if PARTS == 8 else F.shiftleft(F.col("entry").cast("long"), shift)
        each = final_codes(packed, packed.sparkSession.sparkContext.broadcast(books), width)
        whole = each.groupBy("row").agg(F.sum(byte).alias("bits"), F.least(F.sum(F.col("error").cast(WIDE)), F.lit(MOST).cast(WIDE)).cast("long").alias("error"))
        coded = whole.select("row", F.lower(F.lpad(F.hex("bits"), 2 * PARTS, "0")).alias("code"), "error")
    joined = materialise(kept.select("row", "vec_id", "label").join(coded, "row"))
    by_label = joined.groupBy("label").agg(F.least(F.sum(F.col("error").cast(WIDE)), F.lit(MOST).cast(WIDE)).cast("long").alias("label_error"))
    named = by_label.select(F.col("label").alias("_label"), "label_error")
    digest = hashlib.sha256(",".join(str(int(v)) for book in books for entry in book for v in entry).encode()).hexdigest()
    return joined.join(named, joined["label"].eqNullSafe(named["_label"])).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
