"""Benchmark decontamination by spaced seeds.

A seed is the hash of those words of a window that a fixed mask selects. Seeds of all benchmark items are joined with the
seeds of all documents. Each hit fixes how item and document lie against each other, and along that line the best
stretch is found, a match counting 1 and a substituted word -``PENALTY``. A document is reported for an item when the stretch
has at least ``LEAST`` matching words (or the whole item) and ``IDENTITY`` of its words match.

The masks lose no such stretch: without five matching words in a row (first mask) all runs between substitutions are of
at most four words. If two neighbouring runs are of three, the second mask hits; if a run of four is followed by one of
two, the third does. What is left has too many substitutions: four matches for each are needed, and runs of three or
four beside runs of one or two give at most three.

Items under ``LEAST`` words match where all their words stand in a row. Items under ``shortest`` words (by default
``SHORTEST``) are not searched for, since so few words stand in clean texts by chance. Words are lower-cased (A-Z) runs of non-space. Documents without words, null texts and null item ids give nothing;
repeated rows give one result per doc_id and item_id (a null doc_id is one as well). Before the exact join, a bit table of
fixed size drops most seeds of documents that no item has; it can only keep too many.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.textkit import coded, free, hashes, lists, mixed, slices, words
from clausewise.session import materialise

MASKS = ("11111", "1110111", "1111011")
LEAST = 10
IDENTITY = 0.8
PENALTY = 2
SHORTEST = 4
TABLE_BITS = 27
HITS = "row long, doc_id long, words array<bigint>, seeds array<bigint>, places array<int>"


def seeds(h: np.ndarray, lengths: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of a word sequence, the window's first word and its words: of every mask, and of runs of the given lengths."""
    out, at, span = [], [], []
    for number, mask in enumerate((*MASKS, *("1" * n for n in lengths))):
        count = max(0, len(h) - len(mask) + 1)
        key = np.full(count, 1000 + number if number < len(MASKS) else len(mask), np.uint64)
        for j, bit in enumerate(mask):
            if bit == "1":
                key = mixed(key) + h[j : j + count]
        out.append(mixed(key))
        at.append(np.arange(count))
        span.append(np.full(count, len(mask)))
    return np.concatenate(out), np.concatenate(at), np.concatenate(span)


def item_seeds(items: DataFrame, shortest: int) -> DataFrame:
    """``item_id, words, seeds, places`` of every item that is searched for."""
    least = len(MASKS[0])

    def run(batches):
        for batch in slices(batches):
            flat, offsets = words(batch.column("text"))
            codes, distinct = coded(flat)
            h = hashes(distinct)[codes]
            rows = [h[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            found = [seeds(r) if len(r) >= least else seeds(r, (len(r),)) if len(r) >= max(1, shortest) else (r[:0], r[:0]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), lists(rows, pa.int64()), lists([f[0] for f in found], pa.int64()), lists([f[1] for f in found], pa.int32())],
                ["item_id", "words", "seeds", "places"],
            )

    given = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("item_id is not null").distinct()
    return given.mapInArrow(run, "item_id long, words array<bigint>, seeds array<bigint>, places array<int>")


def bit_table(keys: DataFrame) -> np.ndarray:
    """64-bit cells of a table of 2 to the ``TABLE_BITS`` bits with the bits of all ``seed`` values set."""
    cell = F.shiftrightunsigned("seed", 64 - TABLE_BITS)
    rows = keys.select(cell.alias("bit")).groupBy(F.shiftright("bit", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    out[rows["cell"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint64)
    return out


def maybe(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys >> np.uint64(64 - TABLE_BITS)
    return (table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def stretch(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """Best stretch with the item's first word at word ``shift`` of the document: (first word, end, matching words)."""
    low, high = max(0, shift), min(len(doc), shift + len(item))
    same = doc[low:high] == item[low - shift : high - shift]
    sums = np.concatenate(([0], np.cumsum(np.where(same, 1, -PENALTY))))
    least = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - least))
    start = int(np.flatnonzero(sums[: end + 1] == least[end])[-1])
    return low + start, low + end, int(same[start:end].sum())


def contaminated(docs: DataFrame, items: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """``doc_id, item_id, first_word, end_word, matching``: a row per document and item that it holds (the best stretch)."""
    context = docs.sparkSession.sparkContext
    searched = materialise(item_seeds(items, shortest))
    wanted = searched.select("item_id", F.size("words").alias("n"), F.explode(F.arrays_zip("seeds", "places")).alias("s")).select(
        "item_id", "n", F.col("s.seeds").alias("seed"), F.col("s.places").alias("item_place")
    )
    # lengths below that of the first mask
    short = tuple(sorted(r[0] for r in wanted.select("n").filter(F.col("n") < len(MASKS[0])).distinct().collect()))
    table = context.broadcast(bit_table(wanted))

    def run(batches):
        for batch in slices(batches):
            flat, offsets = words(batch.column("text"))
            codes, distinct = coded(flat)
            h = hashes(distinct)[codes]
            keys, at, size = seeds(h, short)
            hit = maybe(table.value, keys)
            keys, at, size = keys[hit], at[hit], size[hit]
            doc = np.searchsorted(offsets, at, side="right") - 1
            inside = at + size <= offsets[doc + 1]
            keys, at, doc = keys[inside], at[inside], doc[inside]
            order = np.argsort(doc, kind="stable")
            keys, at, doc = keys[order], at[order], doc[order]
            which, begins = np.unique(doc, return_index=True)
            ends = np.append(begins[1:], len(doc))
            for a in range(0, len(which), 200):
                part = range(a, min(len(which), a + 200))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").take(pa.array(which[a : a + 200])), batch.column("doc_id").take(pa.array(which[a : a + 200])),
                        lists([h[offsets[which[i]] : offsets[which[i] + 1]] for i in part], pa.int64()),
                        lists([keys[begins[i] : ends[i]] for i in part], pa.int64()),
                        lists([at[begins[i] : ends[i]] - offsets[which[i]] for i in part], pa.int32()),
                    ],
                    ["row", "doc_id", "words", "seeds", "places"],
                )

    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    hits = materialise(given.mapInArrow(run, HITS))
    met = (
        hits.select("row", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select("row", F.col("s.seeds").alias("seed"), F.col("s.places").alias("place"))
        .join(wanted, "seed").select("row", "item_id", "n", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    )
    lines = met.groupBy("row").agg(F.collect_list(F.struct("item_id", "shift", "n")).alias("lines"))

    def cut(batches):
        """The words of the document that lie against the item, for each line."""
        for batch in batches:
            for doc_id, text, found in zip(batch.column("doc_id"), batch.column("words"), batch.column("lines"), strict=True):
                h, found = text.values.to_numpy(), found.values
                shift, n = (found.field(c).to_numpy().astype(np.int64) for c in ("shift", "n"))
                low, high = np.maximum(shift, 0), np.minimum(shift + n, len(h))
                for a in range(0, len(found), 5000):
                    part = slice(a, a + 5000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc_id.as_py()] * len(shift[part]), pa.int64()), found.field("item_id").slice(a, 5000), pa.array(shift[part]), lists([h[i:j] for i, j in zip(low[part], high[part], strict=True)], pa.int64())],
                        ["doc_id", "item_id", "shift", "words"],
                    )

    sliced = hits.select("row", "doc_id", "words").join(lines, "row").select("doc_id", "words", "lines").mapInArrow(cut, "doc_id long, item_id long, shift long, words array<bigint>")
    pairs = sliced.join(searched.select("item_id", F.col("words").alias("item_words")), "item_id")

    def verify(batches):
        for batch in batches:
            rows = []
            for doc_id, item_id, shift, a, b in zip(*[batch.column(c) for c in ("doc_id", "item_id", "shift", "words", "item_words")], strict=True):
                item, base = b.values.to_numpy(), max(0, shift.as_py())
                start, end, same = stretch(a.values.to_numpy(), item, shift.as_py() - base)
                if same >= min(LEAST, len(item)) and same >= IDENTITY * (end - start):
                    rows.append((doc_id.as_py(), item_id.as_py(), base + start, base + end, same))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "item_id", "first_word", "end_word", "matching"])

    kept = pairs.select("doc_id", "item_id", "shift", "words", "item_words").mapInArrow(verify, "doc_id long, item_id long, first_word long, end_word long, matching long")
    best = F.max(F.struct("matching", (-F.col("first_word")).alias("a"), "end_word")).alias("best")
    return kept.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("best.a")).alias("first_word"), F.col("best.end_word").alias("end_word"), F.col("best.matching").alias("matching")
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, all columns; whatever its doc_id, only the text of a row counts."""
    name = free(docs.columns, "_bad")
    # the hash of the text stands for the doc_id, which may be null or shared; a null text holds nothing and matches nothing
    text_key = F.xxhash64(docs["text"].cast("string"))
    bad = materialise(contaminated(docs.select(text_key.alias("doc_id"), "text"), items).select(F.col("doc_id").alias(name)).distinct())
    return docs.join(bad, docs["text"].isNotNull() & (text_key == F.col(name)), "left_anti")
