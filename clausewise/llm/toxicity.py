"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams, edges marked, hashed into a fixed table of vectors; a window of ``WINDOW``
neighbouring words is the average of its words' averages, and a two-class softmax on that average gives its
probability. Table and softmax are trained jointly in numpy. Misspelt words share most n-grams with the words they
come from, so they land near them unseen. A text is as toxic as its worst window, so one insult in a very long text
counts like one in a short text; only that window of a toxic text is trained on as toxic. Words of which nothing was seen in
training count as clean.

Labels are learnt from a bounded sample: at most ``TOXIC_ROWS`` and ``CLEAN_ROWS`` labelled documents in hash order of
their id, one text of each, and at most ``SAMPLE_BYTES`` of text. A text above 1 / ``TEXT_SHARE`` of these bytes is learnt
from only where the smaller ones leave room. Scoring covers all documents and whole texts, without a shuffle; the
trained table, one number per bucket, has a fixed size. Null and empty texts score 0. A document that is labelled
twice counts as toxic if any label says so; null labels are not learnt from. Without labels of both kinds all scores
are 0. Repeated rows are scored each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.llm.textkit import coded, give_back, mixed, slices, words
from clausewise.session import materialise

BUCKETS = 1 << 17
DIM = 8
GRAMS = (3, 4, 5)
WINDOW = 8
EPOCHS = 12
BATCH = 256
RATE = 0.3
TOXIC_ROWS = 3000
CLEAN_ROWS = 6000
SAMPLE_BYTES = 24 << 20
TEXT_SHARE = 64
SLICE_WORDS = 20_000
PART_WORDS = 300_000
CUT = 0.7
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def held_out(doc_id: Column, parts: int, which: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == which


def subwords(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word, flat, and their offsets. Punctuation at a word's ends is not part of it."""
    parts = [_subwords(distinct.slice(a, SLICE_WORDS)) for a in range(0, len(distinct), SLICE_WORDS)]
    sizes = np.concatenate([np.diff(of) for _, of in parts])
    return np.concatenate([b for b, _ in parts]), np.concatenate(([0], np.cumsum(sizes)))


def _subwords(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    plain = [w.decode("utf-8", "replace").strip(EDGES) for w in distinct.to_pylist()]
    points = np.frombuffer("".join(f"<{w}>" for w in plain).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in plain), np.int64, len(plain))
    word = np.repeat(np.arange(len(plain)), sizes)
    of, keys = [], []
    for n in GRAMS:
        count = max(0, len(points) - n + 1)
        key = np.full(count, n, np.uint64)
        for j in range(n):
            key = mixed(key) + points[j : j + count]
        inside = word[:count] == word[n - 1 : n - 1 + count]
        of.append(word[:count][inside])
        keys.append(mixed(key[inside]))
    of, keys = np.concatenate(of), np.concatenate(keys)
    short = np.setdiff1d(np.arange(len(plain)), of)  # under three characters with their edges: all in one bucket
    of, keys = np.concatenate((of, short)), np.concatenate((keys, np.zeros(len(short), np.uint64)))
    order = np.argsort(of, kind="stable")
    offsets = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(plain)))))
    return (keys[order] % np.uint64(BUCKETS)).astype(np.int32), offsets


def averages(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean of each row's values; every row has some."""
    return np.add.reduceat(values, offsets[:-1], axis=0) / np.diff(offsets).reshape((-1,) + (1,) * (values.ndim - 1))


def windows(by_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text with words: mean of the best window, its first word, and the number of its words."""
    sums = np.concatenate(([0.0], np.cumsum(by_word, dtype=np.float64)))
    starts, sizes = offsets[:-1], np.diff(offsets)
    wide = np.minimum(sizes, WINDOW)
    count = np.where(sizes > 0, sizes - wide + 1, 0)
    at = np.repeat(starts, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    mean = (sums[at + np.repeat(wide, count)] - sums[at]) / np.repeat(np.maximum(wide, 1), count)
    full = np.flatnonzero(count)
    heads = (np.cumsum(count) - count)[full]
    best = np.full(len(sizes), -np.inf)
    first = starts.copy()
    if len(full):
        best[full] = np.maximum.reduceat(mean, heads)
        hit = np.flatnonzero(mean == np.repeat(best, count))
        row = np.repeat(np.arange(len(sizes)), count)[hit]
        first[row[::-1]] = at[hit[::-1]]
    return best, first, wide


def parts_of(offsets: np.ndarray):
    """Ranges of texts that hold about ``PART_WORDS`` words each, or one text."""
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + PART_WORDS, side="right")) - 1)
        yield low, high
        low = high


def best_windows(by_word: np.ndarray, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``windows`` of many texts, some at a time."""
    out = []
    for low, high in parts_of(offsets):
        base = offsets[low]
        best, first, wide = windows(by_word[codes[base : offsets[high]]], offsets[low : high + 1] - base)
        out.append((best, first + base, wide))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Model:
    """One number per bucket, a bias, and the slope and offset that turn a text's best window into a probability.

    Its attributes are sent to the tasks, not the object: a broadcast does not carry the class's code along.
    """

    def __init__(self, table: np.ndarray, slope: float, offset: float):
        self.table, self.slope, self.offset = table, slope, offset

    def score(self, texts: pa.Array) -> np.ndarray:
        flat, offsets = words(texts)
        if not len(flat):
            return np.zeros(len(texts))
        codes, distinct = coded(flat)
        buckets, of = subwords(distinct)
        best, _, _ = windows(averages(self.table[buckets], of)[codes], offsets)
        return np.where(np.isfinite(best), 1 / (1 + np.exp(-np.clip(self.slope * best + self.offset, -50, 50))), 0.0)


def train(texts: pa.Array, toxic: np.ndarray, seed: int = 7) -> Model | None:
    """Fit table and softmax on labelled texts; None without both labels."""
    flat, offsets = words(texts)
    sizes = np.diff(offsets)
    if not len(flat) or not (toxic[sizes > 0] == 1).any() or not (toxic[sizes > 0] == 0).any():
        return None
    codes, distinct = coded(flat)
    del flat
    buckets, of = subwords(distinct)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    softmax = np.zeros((DIM, 2), np.float32)
    bias = np.zeros(2, np.float32)
    seen_v, seen_s, seen_b = np.full(BUCKETS, 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    # first guess of the telling window: log odds of a word's presence in toxic texts
    yes, no = np.zeros(len(distinct)), np.zeros(len(distinct))
    for low, high in parts_of(offsets):
        row = np.repeat(np.arange(low, high), sizes[low:high])
        pair = np.unique(row * np.int64(len(distinct)) + codes[offsets[low] : offsets[high]])
        row, word = pair // len(distinct), pair % len(distinct)
        yes += np.bincount(word[toxic[row] == 1], minlength=len(distinct))
        no += np.bincount(word[toxic[row] == 0], minlength=len(distinct))
    by_word = np.log((yes + 0.5) / ((toxic == 1).sum() + 1)) - np.log((no + 0.5) / ((toxic == 0).sum() + 1))
    by_word = np.where(yes + no >= 3, by_word, 0.0)
    use = np.flatnonzero(sizes > 0)
    share = (toxic[use] == 1).mean()
    for epoch in range(EPOCHS):
        _, first, wide = best_windows(by_word, codes, offsets)
        clean = use[toxic[use] == 0]
        other = offsets[:-1][clean] + (rng.random(len(clean)) * (sizes[clean] - wide[clean] + 1)).astype(np.int64)
        start = np.concatenate((first[use], other))
        width = np.concatenate((wide[use], wide[clean]))
        label = np.concatenate((toxic[use], toxic[clean])).astype(np.int64)
        order = rng.permutation(len(start))
        for lot in np.array_split(order, max(1, len(order) // BATCH)):
            w, y = width[lot], label[lot]
            at = np.repeat(start[lot], w) + (np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w))
            code = codes[at]
            size = of[code + 1] - of[code]
            flat_at = np.repeat(of[code], size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
            bucket = buckets[flat_at]
            weight = np.repeat(1.0 / (size * np.repeat(w, w)), size).astype(np.float32)
            text = np.repeat(np.repeat(np.arange(len(lot)), w), size)
            heads = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
            mean = np.add.reduceat(vectors[bucket] * weight[:, None], heads, axis=0)
            logits = mean @ softmax + bias
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(1, keepdims=True)
            gain = p
            gain[np.arange(len(lot)), y] -= 1
            gain *= np.where(y == 1, min(4.0, 0.5 / max(share, 1e-3)), 1.0)[:, None] / len(lot)
            to_mean = gain @ softmax.T
            g = mean.T @ gain
            seen_s += g**2
            softmax -= RATE * g / np.sqrt(seen_s)
            # a window of nothing but unseen n-grams is its bias alone, and is trained on as clean
            blank = np.exp(bias - bias.max())
            g = gain.sum(0) + (blank / blank.sum() - np.array([1, 0])).astype(np.float32)
            seen_b += g**2
            bias -= RATE * g / np.sqrt(seen_b)
            step = to_mean[text] * weight[:, None]
            touched, back = np.unique(bucket, return_inverse=True)
            total = np.stack([np.bincount(back, step[:, d], len(touched)) for d in range(DIM)], 1)
            seen_v[touched] += (total**2).mean(1).astype(np.float32)
            vectors[touched] -= (RATE * total / np.sqrt(seen_v[touched])[:, None]).astype(np.float32)
        table = vectors @ (softmax[:, 1] - softmax[:, 0])
        by_word = averages(table[buckets], of)
    best, _, _ = best_windows(by_word, codes, offsets)
    blanks = max(1, int((toxic[use] == 1).sum()))
    slope, offset = calibrated(np.concatenate((best[use], np.zeros(blanks))), np.concatenate((toxic[use], np.zeros(blanks, toxic.dtype))))
    return Model(table.astype(np.float32), slope, offset)


def calibrated(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a lightly damped logistic fit of labels on best windows."""
    scale = x.std() or 1.0
    z = np.stack(((x - x.mean()) / scale, np.ones_like(x)), 1)
    t = np.where(y == 1, 1 - 1 / (2 + (y == 1).sum()), 1 / (2 + (y == 0).sum()))
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(hess, z.T @ (p - t) + np.array([1e-2, 1e-6]) * beta)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0] / scale), float(beta[1] - beta[0] * x.mean() / scale)


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """The bounded sample: text and label of labelled documents outside the held-out part, in hash order of the id.

    Toxic texts take at most half of ``SAMPLE_BYTES``, clean ones what is left.
    """
    known = (
        labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 3, 1))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    )
    one = materialise(one_text(docs, SAMPLE_BYTES).join(known, "doc_id"))
    toxic = drawn(one.filter("toxic = 1"), TOXIC_ROWS, SAMPLE_BYTES // 2)
    clean = drawn(one.filter("toxic = 0"), CLEAN_ROWS, SAMPLE_BYTES - (pc.sum(toxic["size"]).as_py() or 0))
    table = fetched(docs, pa.concat_tables([toxic, clean]))
    return table["text"].combine_chunks(), table["toxic"].to_numpy()


def one_text(docs: DataFrame, limit: int) -> DataFrame:
    """Of each doc_id with texts one, without the text: ``doc_id, turn, over, key, size``.

    ``over`` is 0, or the size of a text that is above its share of ``limit``; of several texts one that is not above it
    counts, of those the first by hash.
    """
    size = F.octet_length("text").cast("bigint")
    over = F.when(size > limit // TEXT_SHARE, size).otherwise(0)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    first = texts.groupBy("doc_id").agg(F.min(F.struct(over.alias("over"), F.xxhash64("text").alias("key"), size.alias("size"))).alias("first"))
    return first.select("doc_id", F.xxhash64("doc_id").alias("turn"), "first.*")


def drawn(one: DataFrame, rows: int, limit: int) -> pa.Table:
    """At most ``rows`` rows of ``one_text`` and ``limit`` bytes: texts within their share in hash order, then larger ones by size."""
    table = one.orderBy("over", "turn", "doc_id").limit(rows).toArrow()
    return table.slice(0, int(np.searchsorted(np.cumsum(table["size"].to_numpy()), limit, side="right")))


def fetched(docs: DataFrame, chosen: pa.Table) -> pa.Table:
    """The texts of the ``drawn`` rows, each once, in the order of ``turn``."""
    wanted = docs.sparkSession.createDataFrame(chosen)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumns({"key": F.xxhash64("text"), "size": F.octet_length("text").cast("bigint")})
    found = texts.join(F.broadcast(wanted), ["doc_id", "key", "size"]).groupBy(chosen.column_names).agg(F.min("text").alias("text"))
    return found.orderBy("turn", "doc_id").toArrow()


def learnt(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of the labelled sample; the memory of its training goes back, since the driver lives on."""
    model = train(*labelled_sample(docs, labels))
    give_back()
    return model


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text`` (and more) to ``doc_id, held_out, score, predicted``, learning from ``labels(doc_id, toxic)``."""
    model = learnt(docs, labels)
    return apply(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), model, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )


def apply(docs: DataFrame, model: Model | None, schema: str) -> DataFrame:
    """Every column of ``docs`` that ``schema`` names, and ``score`` of ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model and vars(model))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for batch in slices(batches):
            found = Model(**shared.value).score(batch.column("text")) if shared.value is not None else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(found) if n == "score" else batch.column(n) for n in names], names)

    return docs.mapInArrow(run, schema)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, all columns, without a shuffle."""
    model = learnt(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model and vars(model))

    def run(batches):
        for batch in slices(batches):
            if shared.value is None:
                yield batch
            else:
                yield batch.filter(pa.array(Model(**shared.value).score(batch.column("text")) < CUT))

    return docs.mapInArrow(run, docs.schema)
