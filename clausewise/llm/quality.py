"""Quality by weak labels: overlapping heuristic labellers, whose accuracies expectation-maximisation estimates.

Every labeller looks at one figure of a text and votes good, bad or not at all. The votes of a text form a pattern;
Spark counts the patterns of all documents, of which there are at most 3 to the power of the number of labellers.
Expectation-maximisation on the counts estimates how often each labeller votes how on good and on bad texts, and with
that the probability that a pattern belongs to a good text. These posteriors, soft labels, train a linear scorer on
hashed word shapes, on a bounded sample (``SAMPLE_ROWS`` documents in hash order of the id, one text of each,
``SAMPLE_BYTES`` of text; texts above 1 / 64 of these bytes only where the smaller ones leave room).
All documents are scored, whole texts, without a shuffle.

Null and empty texts have no words: their only vote is bad and their score 0. Repeated rows are scored each; null ids
are scored, but not drawn into the sample. Where no document votes at all, every posterior and score is 0.5.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.textkit import coded, mixed, slices, words
from clausewise.llm.toxicity import drawn, fetched, one_text

#: Labellers: figure, above or below which it votes bad, and on the far side of which it votes good.
LABELLERS = (
    ("upper", 0.5, 0.25),
    ("symbols", 0.12, 0.07),
    ("exclaimed", 0.2, 0.05),
    ("repeated", 0.25, 0.08),
    ("same_word", 0.3, 0.15),
    ("same_line", 0.3, 0.05),
    ("bare", 0.12, 0.03),
    ("tailed", 0.15, 0.02),
    ("different", -0.4, -0.55),
    ("few_words", 0.5, None),
)
BUCKETS = 1 << 16
SAMPLE_ROWS = 6000
SAMPLE_BYTES = 16 << 20
ROUNDS = 100
#: What is held of a labeller before counting, as shares of no, good and bad votes on good and on bad texts: a bad vote
#: is rarely wrong, while a text that is bad in one way looks good to most other labellers. Either kind of text is as likely
#: before. Weighs as BELIEF times all texts.
ON_GOOD, ON_BAD = (0.3, 0.695, 0.005), (0.3, 0.58, 0.12)
BELIEF = 0.3
EPOCHS = 10
KEEP = 0.5


def figures(texts: pa.Array, flat: pa.Array, offsets: np.ndarray, codes: np.ndarray, distinct: pa.Array) -> np.ndarray:
    """One row per text: the figures that the labellers look at, in their order."""
    rows, count = len(texts), np.diff(offsets).astype(float)
    some = np.maximum(count, 1)
    raw = pc.fill_null(texts.cast(pa.string()), "").cast(pa.binary())
    size = pc.binary_length(raw).to_numpy(zero_copy_only=False)
    data = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
    of = np.repeat(np.arange(rows), size)
    per = lambda mask: np.bincount(of[mask], minlength=rows)
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    plain = upper | lower | space | (data >= 128) | ((data >= 48) & (data <= 57))
    doc = np.repeat(np.arange(rows), np.diff(offsets))
    follows = np.concatenate(([False], (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1]))) if len(codes) else np.zeros(0, bool)
    pair, n = np.unique(doc * np.int64(max(1, len(distinct))) + codes, return_counts=True)
    most = np.zeros(rows)
    np.maximum.at(most, pair // max(1, len(distinct)), n)
    lines = pc.split_pattern(pc.fill_null(texts.cast(pa.string()), ""), "\n")
    line_doc = np.repeat(np.arange(rows), np.diff(lines.offsets.to_numpy()))
    line_codes, line_set = coded(lines.flatten())
    real = pc.greater(pc.binary_length(line_set), 0).to_numpy(zero_copy_only=False)[line_codes] if len(line_codes) else np.zeros(0, bool)
    kinds = np.unique(line_doc[real] * np.int64(max(1, len(line_set))) + line_codes[real])
    total = np.bincount(line_doc[real], minlength=rows)
    different = np.bincount(kinds // max(1, len(line_set)), minlength=rows)
    bare = np.fromiter((not re.search(rb"[0-9A-Za-z\x80-\xff]", w) for w in distinct.to_pylist()), bool, len(distinct))
    tail = np.fromiter((len(w) > 2 and w[-1] == w[-2] and not w[-2:].isalnum() and w[-1] < 128 for w in distinct.to_pylist()), bool, len(distinct))
    return np.stack(
        (
            per(upper) / np.maximum(per(upper | lower), 1),
            per(~plain) / np.maximum(per(~space), 1),
            per(data == 33) / some,
            np.bincount(doc[follows], minlength=rows) / some,
            np.where(count >= 8, most / some, 0.1),
            1 - different / np.maximum(total, 1),
            np.bincount(doc[bare[codes]], minlength=rows) / some,
            np.bincount(doc[tail[codes]], minlength=rows) / some,
            -np.where(count >= 20, np.bincount(pair // max(1, len(distinct)), minlength=rows) / some, 0.5),
            (count < 3).astype(float),
        ),
        1,
    )


def votes(values: np.ndarray) -> np.ndarray:
    """Votes as digits of a pattern number in base 3: 0 none, 1 good, 2 bad. Texts under 3 words only get the last vote."""
    pattern = np.zeros(len(values), np.int64)
    for i, (name, bad, good) in enumerate(LABELLERS):
        vote = np.where(values[:, i] > bad, 2, 0)
        if good is not None:
            vote = np.where(values[:, i] < good, 1, vote)
        if name != "few_words":
            vote = np.where(values[:, -1] > 0, 0, vote)
        pattern = pattern * 3 + vote
    return pattern


def shapes(flat: pa.Array, distinct: pa.Array) -> np.ndarray:
    """A hash of the shape of each distinct word: kinds of characters with runs collapsed, symbols as they are."""
    made, out = {}, np.zeros(len(distinct), np.uint64)
    for i, w in enumerate(distinct.to_pylist()):
        shape = re.sub(rb"[0-9]+", b"0", re.sub(rb"[A-Za-z\x80-\xff]+", b"a", w))
        shape = re.sub(rb"(.)\1+", rb"\1\1", shape)
        if shape not in made:
            made[shape] = np.frombuffer(shape.ljust(8 * (len(shape) // 8 + 1), b"\0"), np.uint64)
            value = np.zeros(1, np.uint64)
            for part in made[shape]:
                value = mixed(value + part + np.uint64(1))
            made[shape] = value[0]
        out[i] = made[shape]
    return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pattern of each text, and flat text numbers, buckets and weights of its hashed features)."""
    flat, offsets = words(texts)
    codes, distinct = coded(flat)
    values = figures(texts, flat, offsets, codes, distinct)
    count = np.diff(offsets)
    doc = np.repeat(np.arange(len(texts)), count)
    raw_upper = np.repeat((values[:, 0] * 5).astype(np.uint64), count)
    shape = shapes(flat, distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    same = np.zeros(len(codes), np.uint64)
    if len(codes):
        same[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    before = np.concatenate((np.zeros(1, np.uint64), shape[:-1])) if len(shape) else shape
    keys = np.concatenate((mixed(shape + same * np.uint64(17) + np.uint64(1)), mixed(mixed(shape + raw_upper) + before)))
    bucket = (keys % np.uint64(BUCKETS)).astype(np.int64)
    pair, n = np.unique(np.concatenate((doc, doc)) * np.int64(BUCKETS) + bucket, return_counts=True)
    of = pair // BUCKETS
    weight = np.sqrt(n / count[of])
    line = (values[:, 5:6] * 4).astype(np.int64)[:, 0] + 1
    busy = np.flatnonzero(count)
    return (
        votes(values),
        np.concatenate((of, busy)),
        np.concatenate((pair % BUCKETS, (mixed(line[busy].astype(np.uint64) + np.uint64(99)) % np.uint64(BUCKETS)).astype(np.int64))),
        np.concatenate((weight, np.ones(len(busy)))),
    )


def estimate(patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Probability of a good text for each pattern, by expectation-maximisation from the majority of votes."""
    digits = np.stack([patterns // 3 ** (len(LABELLERS) - 1 - i) % 3 for i in range(len(LABELLERS))], 1)
    good, bad = (digits == 1).sum(1), (digits == 2).sum(1)
    p = np.where(good + bad == 0, 0.5, np.where(bad > 0, 0.1, 0.9))
    if not len(patterns) or not (good + bad).any():
        return np.full(len(patterns), 0.5)
    belief = BELIEF * counts.sum() + 1
    for _ in range(ROUNDS):
        prior = ((counts * p).sum() + belief / 2) / (counts.sum() + belief)
        log = np.full(len(patterns), np.log(prior) - np.log(1 - prior))
        for i in range(len(LABELLERS)):
            hit = digits[:, i, None] == np.arange(3)
            yes = ((counts * p)[:, None] * hit).sum(0) + belief * np.array(ON_GOOD)
            no = ((counts * (1 - p))[:, None] * hit).sum(0) + belief * np.array(ON_BAD)
            log += np.log((yes / yes.sum())[digits[:, i]]) - np.log((no / no.sum())[digits[:, i]])
        new = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return p


def fit(texts: pa.Array, posterior: dict[int, float], seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear scorer on soft labels."""
    parts, base = [], 0
    for part in slices([pa.RecordBatch.from_arrays([texts], ["text"])]):
        found = features(part.column("text"))
        parts.append((found[0], found[1] + base, found[2].astype(np.int32), found[3]))
        base += part.num_rows
    pattern, of, bucket, weight = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4
    target = np.array([posterior.get(int(x), 0.5) for x in pattern])
    order = np.argsort(of, kind="stable")
    of, bucket, weight = of[order], bucket[order], weight[order]
    begins = np.searchsorted(of, np.arange(len(texts) + 1))
    w, bias, seen, seen_b = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-6), 1e-6
    share = np.clip(1 - target.mean() if len(target) else 0.5, 0.02, 0.98)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for lot in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // 64)):
            size = begins[lot + 1] - begins[lot]
            at = np.repeat(begins[lot], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            row = np.repeat(np.arange(len(lot)), size)
            z = np.bincount(row, w[bucket[at]] * weight[at], len(lot)) + bias
            gain = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[lot]) * (target[lot] / (2 * (1 - share)) + (1 - target[lot]) / (2 * share)) / max(1, len(lot))
            touched, back = np.unique(bucket[at], return_inverse=True)
            g = np.bincount(back, gain[row] * weight[at], len(touched)) + 1e-6 * w[touched]
            seen[touched] += g**2
            w[touched] -= 0.2 * g / np.sqrt(seen[touched])
            seen_b += gain.sum() ** 2
            bias -= 0.2 * gain.sum() / np.sqrt(seen_b)
    return w.astype(np.float32), bias


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` (and more) to ``doc_id, posterior, score, keep``: keep is 1 from a score of ``KEEP`` on."""
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def patterns(batches):
        for batch in slices(batches):
            flat, offsets = words(batch.column("text"))
            codes, distinct = coded(flat)
            some, n = np.unique(votes(figures(batch.column("text"), flat, offsets, codes, distinct)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n)], ["pattern", "n"])

    counted = given.mapInArrow(patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toArrow()
    known = counted["pattern"].to_numpy()
    posterior = dict(zip(known.tolist(), estimate(known, counted["n"].to_numpy()).tolist(), strict=True))
    sample = fetched(given, drawn(one_text(given, SAMPLE_BYTES), SAMPLE_ROWS, SAMPLE_BYTES))
    weights, bias = fit(sample["text"].combine_chunks() if sample.num_rows else pa.array([], pa.string()), posterior)
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias, posterior))

    def run(batches):
        w, b, known = shared.value
        for batch in slices(batches):
            pattern, of, bucket, weight = features(batch.column("text"))
            z = np.bincount(of, w[bucket] * weight, batch.num_rows) + b
            filled = np.bincount(of, minlength=batch.num_rows) > 0
            found = np.where(filled, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
            post = np.array([known[int(x)] for x in pattern])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(post), pa.array(found), pa.array((found >= KEEP).astype(np.int32))], ["doc_id", "posterior", "score", "keep"]
            )

    return given.mapInArrow(run, "doc_id long, posterior double, score double, keep int")
