"""Substring deduplication on a compacted de Bruijn graph of tokens.

Words are runs of anything but the six ASCII white-space characters, unchanged. A run of ``window`` words of one
document is an edge of the graph; it leads from the node of its first ``window`` - 1 words to the node of its last. Words
are removed where an edge covers them that also starts at another place, in the same document or elsewhere.

* **Edges in reach of each other.** Of the short runs inside a window the one of smallest hash is its anchor, so equal
  windows have equal anchors, and a dozen neighbouring windows share one. Only windows whose anchor occurs at two
  places are made into edges; that loses none.
* **Compaction.** An edge that occurs twice forks to the left if the words before its places differ or a text begins
  there, to the right likewise. Joining the edges' forks to their places, neighbouring edges without a fork between
  them become one path. As nothing forks inside a path, each of its places holds it whole, and a passage shared by any
  number of documents is the same path in all of them.
* **Verification.** The words at each path's coordinates are read again from their source and digested; a path whose
  words stand nowhere else (hashes of 64 bits that clash) is taken back and its texts are done again.

Copies of a text are one text with a count, known by a 128-bit hash, so a text repeated a million times meets itself in
two aggregations only. Counts and places are pre-aggregated before they are shuffled, and all joins are plain
equi-joins that adaptive execution splits where one anchor or text is hot. Nothing passes through the driver.

Null texts have no words and nothing is removed from them; texts under ``window`` words stay whole; repeated rows are
judged and returned each; an empty table gives an empty result. Extra columns may have any names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausewise.llm.textkit import coded, free, hashes, mixed, slices
from clausewise.session import materialise

WINDOW = 35
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SPANS = "array<struct<start:int,length:int>>"
CHUNK = 100_000


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Rolling:
    """Hashes of any run of words, from running sums."""

    def __init__(self, h: np.ndarray):
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers(BASE, len(h))[: len(h)])))
        self.inverse = powers(INVERSE, len(h))

    def of(self, start: np.ndarray, length: int) -> np.ndarray:
        return mixed((self.sums[start + length] - self.sums[start]) * self.inverse[start] + np.uint64(length))


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a column in order, and the offsets of each row's words in them."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    row = np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy()))
    flat = parts.flatten().cast(pa.binary())
    real = pc.greater(pc.binary_length(flat), 0)
    row = row[real.to_numpy(zero_copy_only=False)]
    return flat.filter(real), np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(parts)))))


def word_hashes(flat: pa.Array) -> np.ndarray:
    codes, distinct = coded(flat)
    return hashes(distinct)[codes]


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, … for each pair, one after the other."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())


def anchor_groups(h: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of neighbouring windows that share an anchor: its hash, the first window's word, the windows, the row."""
    short = max(1, window // 3)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    count = len(h) - window + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[window - 1 :] == row[:count])
    runs = Rolling(h).of(np.arange(len(h) - short + 1), short)
    view = np.lib.stride_tricks.sliding_window_view(runs, window - short + 1)
    anchor = np.concatenate([view[at[a : a + CHUNK]].argmin(1) for a in range(0, len(at), CHUNK)] or [at[:0]]) + at
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[at[1:]] != row[at[:-1]])
    heads = np.flatnonzero(new)
    return runs[anchor[heads]], at[heads], np.diff(np.append(heads, len(at))), row[at[heads]]


def unseen(batch: pa.RecordBatch, seen: set) -> pa.RecordBatch:
    """The rows whose text this task has not met yet."""
    keep = []
    for pair in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True):
        keep.append(pair not in seen)
        seen.add(pair)
    return batch.filter(pa.array(keep, pa.bool_()))


def anchors(texts: DataFrame, window: int) -> DataFrame:
    """``anchor, k1, k2, start, length``: a row per group of windows; a text comes once per task."""

    def run(batches):
        seen: set = set()
        for whole in batches:
            for batch in slices([unseen(whole, seen)]):
                flat, offsets = split(batch.column("text"))
                key, at, length, row = anchor_groups(word_hashes(flat), offsets, window)
                k1, k2 = (batch.column(c).to_numpy()[row] for c in ("k1", "k2"))
                start = at - offsets[row]
                for a in range(0, len(key), CHUNK):
                    columns = (key, k1, k2, start, length)
                    yield pa.RecordBatch.from_arrays([pa.array(c[a : a + CHUNK].astype(np.int64)) for c in columns], ["anchor", "k1", "k2", "start", "length"])

    return texts.select("k1", "k2", "text").mapInArrow(run, "anchor long, k1 long, k2 long, start long, length long")


def edges(texts: DataFrame, window: int) -> DataFrame:
    """``edge, k1, k2, at, before, after`` of the windows that ``groups`` names; 0 where a text begins or ends."""

    def run(batches):
        seen: set = set()
        for whole in batches:
            for batch in slices([unseen(whole, seen)]):
                flat, offsets = split(batch.column("text"))
                h = word_hashes(flat)
                groups = batch.column("groups")
                row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(groups).to_numpy())
                start, length = (groups.flatten().field(c).to_numpy().astype(np.int64) for c in ("start", "length"))
                at, row = ranges(offsets[row] + start, length), np.repeat(row, length)
                edge = Rolling(h).of(at, window)
                padded = np.pad(h, 1)
                before = np.where(at > offsets[row], padded[at], np.uint64(0))
                after = np.where(at + window < offsets[row + 1], padded[at + window + 1], np.uint64(0))
                k1, k2 = (batch.column(c).to_numpy()[row] for c in ("k1", "k2"))
                columns = (edge, k1, k2, at - offsets[row], before, after)
                for a in range(0, len(edge), CHUNK):
                    yield pa.RecordBatch.from_arrays([pa.array(c[a : a + CHUNK].astype(np.int64)) for c in columns], ["edge", "k1", "k2", "at", "before", "after"])

    return texts.select("k1", "k2", "text", "groups").mapInArrow(run, "edge long, k1 long, k2 long, at long, before long, after long")


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and the text's 128-bit key ``k1, k2``."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2"))


def place(at: str = "at"):
    return F.xxhash64("k1", "k2", F.col(at).cast("long"))


def paths(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """``k1, k2, start, length``: the compacted paths of repeated edges, and where they lie; ``length`` counts edges."""
    groups = anchors(texts, window)
    spread = groups.groupBy("anchor").agg(F.min(place("start")).alias("one"), F.max(place("start")).alias("two"))
    twice = materialise(spread.filter("one <> two").select("anchor"))
    wanted = groups.join(twice, "anchor", "left_semi").groupBy("k1", "k2").agg(F.collect_set(F.struct(F.col("start").cast("int").alias("start"), F.col("length").cast("int").alias("length"))).alias("groups"))
    placed = materialise(edges(texts.join(materialise(wanted), ["k1", "k2"]), window))
    forks = placed.groupBy("edge").agg(
        F.min(place()).alias("one"), F.max(place()).alias("two"),
        (F.max(F.col("before") == 0) | (F.min("before") != F.max("before"))).alias("left"),
        (F.max(F.col("after") == 0) | (F.min("after") != F.max("after"))).alias("right"),
    )
    # written first: the join can then be split where one edge has very many places
    forks = materialise(forks.filter("one <> two").select("edge", "left", "right"))
    repeated = placed.select("edge", "k1", "k2", "at").join(forks, "edge")
    line = Window.partitionBy("k1", "k2").orderBy("at")
    last = F.lag("at").over(line)
    starts = last.isNull() | (F.col("at") > last + 1) | ((F.col("at") == last + 1) & (F.col("left") | F.lag("right").over(line)))
    numbered = repeated.withColumn("starts", starts.cast("int")).withColumn("path", F.sum("starts").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("k1", "k2", "path").agg(F.min("at").alias("start"), (F.max("at") - F.min("at") + 1).alias("length")).drop("path")


def marked(texts: DataFrame, window: int, whole_text: bool) -> DataFrame:
    """``doc_id, k1, k2, n_words, n_removed, kept, kept_sha256, checks`` of texts with ``spans`` and ``copies``.

    ``checks`` has the digest of the words of each span; ``kept`` is filled only with ``whole_text``.
    """

    def run(batches):
        for batch in slices(batches):
            flat, offsets = split(batch.column("text"))
            n = np.diff(offsets)
            spans = batch.column("spans")
            sizes = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            start, length = (spans.flatten().field(c).to_numpy().astype(np.int64) for c in ("start", "length"))
            at, size = offsets[row] + start, length + window - 1
            edge = np.zeros(len(flat) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + size, -1)
            gone = np.cumsum(edge)[:-1] > 0
            all_gone = pc.fill_null(batch.column("copies"), 1).to_numpy(zero_copy_only=False).astype(np.int64) > 1
            gone |= np.repeat(all_gone & (n >= window), n)
            left = np.concatenate(([0], np.cumsum(~gone)))[offsets]
            kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), flat.filter(pa.array(~gone))), b" ")
            words = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), flat.take(pa.array(ranges(at, size)))), b" ")
            digest = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in words.to_pylist()), np.int64).reshape(-1, 2)
            check = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(digest[:, 0]), pa.array(digest[:, 1])], ["start", "length", "d1", "d2"])
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("doc_id", "k1", "k2")],
                    pa.array(n.astype(np.int64)), pa.array(n - np.diff(left)),
                    kept.cast(pa.string()) if whole_text else pa.nulls(batch.num_rows, pa.string()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in kept.to_pylist()]),
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), check),
                ],
                ["doc_id", "k1", "k2", "n_words", "n_removed", "kept", "kept_sha256", "checks"],
            )

    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, k1 long, k2 long, n_words long, n_removed long, kept string, kept_sha256 string, checks array<struct<start:long,length:long,d1:long,d2:long>>"
    return texts.select("doc_id", "k1", "k2", "text", "spans", "copies").mapInArrow(run, schema)


def with_spans(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Each row with the paths of its text and the number of rows that have this text."""
    pair = F.struct(F.col("start").cast("int").alias("start"), F.col("length").cast("int").alias("length"))
    spans = found.groupBy("k1", "k2").agg(F.collect_list(pair).alias("spans"))
    copies = texts.filter("text is not null").groupBy("k1", "k2").agg(F.count("*").alias("copies")).filter("copies > 1")
    known = materialise(spans.join(copies, ["k1", "k2"], "full"))
    return texts.join(known, ["k1", "k2"], "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))


def removed(docs: DataFrame, window: int = WINDOW, whole_text: bool = False) -> DataFrame:
    """A row per row of ``doc_id, text`` (and more): ``doc_id, n_words, n_removed, kept, kept_sha256``.

    ``kept`` is what is left of the text, its words joined by single spaces (null unless ``whole_text``).
    """
    texts = keyed(docs)
    found = materialise(paths(texts.filter("text is not null"), window))
    done = materialise(marked(with_spans(texts, found), window, whole_text))
    checks = done.select("k1", "k2", F.explode("checks").alias("c")).select("k1", "k2", "c.*")
    alone = materialise(checks.groupBy("d1", "d2", "length").agg(F.min(place("start")).alias("one"), F.max(place("start")).alias("two")).filter("one = two"))
    columns = ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"]
    if alone.isEmpty():
        return done.select(columns)
    false = materialise(checks.join(alone, ["d1", "d2", "length"], "left_semi").select("k1", "k2", "start").distinct())
    again = false.select("k1", "k2").distinct()
    mended = marked(with_spans(texts.join(again, ["k1", "k2"], "left_semi"), found.join(false, ["k1", "k2", "start"], "left_anti")), window, whole_text)
    return done.join(again, ["k1", "k2"], "left_anti").select(columns).unionByName(mended.select(columns))


def passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, start, n_words``: where the compacted repeated passages lie, by words from 0."""
    texts = keyed(docs)
    found = materialise(paths(texts.filter("text is not null"), window))
    return texts.select("doc_id", "k1", "k2").join(found, ["k1", "k2"]).select("doc_id", "start", (F.col("length") + window - 1).alias("n_words"))


def clean(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All columns of the documents, ``text`` without the words of repeated passages; null texts stay null."""
    row = free(docs.columns, "_row")
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()))
    left = removed(numbered.select(F.col(row).alias("doc_id"), "text"), window, True).select(F.col("doc_id").alias(row), F.col("kept").alias(free(docs.columns, "_kept")))
    kept = F.col(left.columns[1])
    return numbered.join(left, row).withColumn("text", F.when(F.col("text").isNull(), None).otherwise(kept)).select(docs.columns)
