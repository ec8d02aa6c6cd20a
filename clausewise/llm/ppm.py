"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ``ORDER`` bytes, counted by Spark over all training texts (lower-cased A-Z,
preceded by start marks, followed by an end mark). A symbol is coded at the longest context in which it was seen.
Before that, every longer context that was seen costs an escape of probability distinct / (total + distinct), and the
symbols of that context are excluded from the counts of the next shorter one; below all contexts the symbols not yet
seen are equally likely. A text's score is the log10 probability of its bytes and its end, under the fixed trie.

Beside it stands a unigram score over words with one end token per text and add-one smoothing.

The trie is cut into blocks of at most about ``BLOCK_NODES`` nodes by the last two bytes of the context, which all
longer contexts share; a block is sent to the tasks, which score those places of all texts whose context falls into
it, and the blocks' parts are added up. Words that make up more than 1/``FREQUENT`` of all tokens, at most ``FREQUENT`` of
them by that rule, are sent to the tasks as well; all rarer ones, none of which is hot, are joined by shuffle.

Null texts count as empty; an empty text is its end mark alone. Repeated rows are counted and scored each. Without
training texts every symbol is equally likely.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.textkit import coded, lowered, slices, words
from clausewise.llm.toxicity import held_out
from clausewise.session import materialise

ORDER = 4
#: Bytes that UTF-8 never uses: marks before and after a text.
START, END = 0xFE, 0xFF
SYMBOLS = 255
BLOCK_NODES = 4_000_000
FREQUENT = 1 << 21
TASK_GRAMS = 1_000_000


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each place's context and symbol packed into a number, symbol lowest, for all texts; and the rows' offsets."""
    flat = lowered(texts).cast(pa.binary())
    size = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(flat.to_pylist()), np.uint8)
    rows, pad = len(size), ORDER + 1
    starts = np.cumsum(size) - size
    line = np.full(len(data) + rows * pad, START, np.uint8)
    line[np.arange(len(data)) + np.repeat(np.arange(rows) * pad + ORDER, size)] = data
    line[starts + size + np.arange(rows) * pad + ORDER] = END
    keys = np.zeros(len(line) - ORDER if rows else 0, np.uint64)
    for j in range(ORDER + 1):
        keys = (keys << np.uint64(8)) | line[j : j + len(keys)]
    keep = np.ones(len(keys), bool)
    heads = (starts + np.arange(rows) * pad)[1:]
    for j in range(ORDER):
        keep[heads - ORDER + j] = False
    return keys[keep], np.concatenate(([0], np.cumsum(size + 1)))


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[: len(keys)]
    return keys[heads], np.add.reduceat(counts, heads) if len(keys) else counts


def count_grams(docs: DataFrame) -> DataFrame:
    """``key, n``: how often each context and symbol occurs, by map-side counts and one aggregation."""

    def run(batches):
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in slices(batches):
            some = np.unique(grams(batch.column("text"))[0], return_counts=True)
            keys, counts = merged(np.concatenate((keys, some[0])), np.concatenate((counts, some[1])))
            if len(keys) > TASK_GRAMS:
                yield out(keys, counts)
                keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield out(keys, counts)

    def out(keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], ["key", "n"])

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


class Trie:
    """The contexts of one block: for every order sorted grams and contexts with what coding and escaping need."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low_keys: np.ndarray, low_counts: np.ndarray):
        """Full-order grams of the block; ``low_*``: grams of order 1 of the whole corpus."""
        self.grams, self.counts, self.contexts, self.total, self.kinds = {}, {}, {}, {}, {}
        for order in range(ORDER, -1, -1):
            mask = np.uint64((1 << (8 * (order + 1))) - 1)
            if order > 1:
                g, c = merged(keys & mask, counts)
            else:
                g, c = merged(low_keys & mask, low_counts)
            self.grams[order], self.counts[order] = g, c
            context = g >> np.uint64(8)
            heads = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))[: len(g)]
            self.contexts[order] = context[heads]
            self.total[order] = np.add.reduceat(c, heads) if len(g) else c
            self.kinds[order] = np.diff(np.concatenate((heads, [len(g)])))
        # of each context above order 0: total and kinds of its shorter context without the symbols seen here
        self.below = {}
        for order in range(ORDER, 0, -1):
            mask = np.uint64((1 << (8 * order)) - 1)
            g = self.grams[order]
            if not len(g):
                self.below[order] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
                continue
            known = self.counts[order - 1][np.searchsorted(self.grams[order - 1], g & mask)]
            heads = np.cumsum(self.kinds[order]) - self.kinds[order]
            shorter = np.searchsorted(self.contexts[order - 1], self.contexts[order] & (mask >> np.uint64(8)))
            self.below[order] = (
                self.total[order - 1][shorter] - np.add.reduceat(known, heads),
                self.kinds[order - 1][shorter] - self.kinds[order],
            )
        top = np.repeat(self.total[ORDER] + self.kinds[ORDER], self.kinds[ORDER])
        self.cost = np.log10(self.counts[ORDER] / np.maximum(top, 1))
        self.slots = None

    @classmethod
    def of(cls, parts: dict) -> "Trie":
        """From its attributes: those are sent to the tasks, since a broadcast does not carry a class's code along."""
        out = cls.__new__(cls)
        out.__dict__.update(parts)
        return out

    def _index(self) -> None:
        """A hash table over the full-order grams; those that find no place near their slot are left to ``_slow``."""
        bits = max(4, int(2 * len(self.grams[ORDER])).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.full((1 << bits) + 4, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.slot_cost = np.zeros(len(self.slots))
        left = np.arange(len(self.grams[ORDER]))
        for step in range(4):
            at = self._slot(self.grams[ORDER][left]) + step
            free = self.slots[at] == np.uint64(0xFFFFFFFFFFFFFFFF)
            _, first = np.unique(at[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.slots[at[chosen]] = self.grams[ORDER][left[chosen]]
            self.slot_cost[at[chosen]] = self.cost[left[chosen]]
            left = np.delete(left, chosen)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def costs(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's symbol after its context."""
        if self.slots is None:
            self._index()
        at = self._slot(keys)
        hit = self.slots[at] == keys
        out = self.slot_cost[at]
        left = np.flatnonzero(~hit)
        for step in range(1, 4):
            there = at[left] + step
            hit = self.slots[there] == keys[left]
            out[left[hit]] = self.slot_cost[there[hit]]
            left = left[~hit]
        if len(left):
            some, back = np.unique(keys[left], return_inverse=True)
            out[left] = self._slow(some)[back]
        return out

    def _slow(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        todo = np.arange(len(keys))
        above = np.full(len(keys), -1)  # place of the next longer context that was seen
        for order in range(ORDER, -1, -1):
            g = keys[todo] & np.uint64((1 << (8 * (order + 1))) - 1)
            context, at = _find(self.contexts[order], g >> np.uint64(8))
            total = np.where(context, self.total[order][at], 0) if len(self.total[order]) else np.zeros(len(todo), np.int64)
            kinds = np.where(context, self.kinds[order][at], 0) if len(self.kinds[order]) else np.zeros(len(todo), np.int64)
            if order < ORDER and len(self.contexts[order + 1]):
                less = above[todo] >= 0
                place = np.maximum(above[todo], 0)
                total = np.where(less, self.below[order + 1][0][place], total)
                kinds = np.where(less, self.below[order + 1][1][place], kinds)
            seen, where = _find(self.grams[order], g)
            whole = np.maximum(total + kinds, 1)
            if len(self.counts[order]):
                out[todo[seen]] += np.log10(self.counts[order][where[seen]] / whole[seen])
            escape = ~seen & (kinds > 0)
            out[todo[escape]] += np.log10(kinds[escape] / whole[escape])
            above[todo] = np.where(context, at, -1)
            todo = todo[~seen]
            if not len(todo):
                return out
        out[todo] -= np.log10(max(1, SYMBOLS - len(self.grams[0])))
        return out


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, at


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    """The block of a gram, from the last two bytes of its context."""
    return ((((keys >> np.uint64(8)) & np.uint64(0xFFFF)) * np.uint64(40503)) & np.uint64(0xFFFF)) % np.uint64(blocks)


def _block_column(blocks: int):
    return F.pmod(F.pmod(F.shiftrightunsigned("key", 8).bitwiseAND(0xFFFF) * 40503, F.lit(65536)), F.lit(blocks))


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n`` over all texts."""

    def run(batches):
        for batch in slices(batches):
            flat, _ = words(batch.column("text"))
            codes, distinct = coded(flat)
            yield pa.RecordBatch.from_arrays([distinct, pa.array(np.bincount(codes, minlength=len(distinct)).astype(np.int64))], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _passes(docs: DataFrame, trie, blocks: int, block: int, common=None) -> DataFrame:
    """A row per document with its part of the score; with ``common`` also the word sums and the rarer words' rows."""

    def run(batches):
        known_trie = Trie.of(trie.value)
        for batch in slices(batches):
            texts = batch.column("text")
            keys, offsets = grams(texts)
            if blocks > 1:
                cost = np.zeros(len(keys))
                mine = block_of(keys, blocks) == block
                cost[mine] = known_trie.costs(keys[mine])
            else:
                cost = known_trie.costs(keys)
            score = np.add.reduceat(cost, offsets[:-1])
            row = batch.column("row").to_numpy()
            if common is None:
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(score)], ["row", "score"])
                continue
            names, known = common.value
            flat, at = words(texts)
            codes, distinct = coded(flat)
            where = pc.index_in(distinct, value_set=names).to_numpy(zero_copy_only=False)
            rare = np.isnan(where)
            n = np.where(rare, 0, known[np.where(rare, 0, where).astype(np.int64)]) if len(known) else np.zeros(len(distinct))
            often = ~rare[codes]
            doc = np.repeat(np.arange(len(texts)), np.diff(at))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row), batch.column("doc_id"), pa.array(score), pa.array(np.diff(at).astype(np.int64)),
                    pa.array(np.bincount(doc[often], minlength=len(texts)).astype(np.int64)),
                    pa.array(np.bincount(doc[often], np.log10(n + 1.0)[codes[often]], minlength=len(texts)).astype(float)),
                    pa.nulls(len(texts), pa.binary()),
                ],
                NAMES,
            )
            pair, tf = np.unique(doc[~often] * np.int64(len(distinct)) + codes[~often], return_counts=True)
            for a in range(0, len(pair), 50_000):
                some, m = pair[a : a + 50_000], len(pair[a : a + 50_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row[some // len(distinct)]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.array(tf[a : a + 50_000].astype(np.int64)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), distinct.take(pa.array(some % len(distinct)))],
                    NAMES,
                )

    NAMES = ["row", "doc_id", "score", "n_words", "n_often", "logs", "word"]
    given = docs.select("row", "doc_id", "text")
    if common is None:
        return given.mapInArrow(run, "row long, score double")
    return given.mapInArrow(run, "row long, doc_id long, score double, n_words long, n_often long, logs double, word binary")


def score(docs: DataFrame, parts: int = 7, which: int = 2, block_nodes: int = BLOCK_NODES, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of ``doc_id, text`` (and more).

    Learns from the documents whose id's CRC-32 modulo ``parts`` is not ``which``.
    """
    context = docs.sparkSession.sparkContext
    given = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    training = given.filter(~held_out(F.col("doc_id"), parts, which))
    counts = materialise(count_words(training))
    ends = training.count()
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, kinds = total + ends, kinds + (ends > 0)
    often = counts.filter(F.col("n") * frequent > tokens).toArrow()  # fewer than ``frequent`` words
    names = often["word"].combine_chunks() if often.num_rows else pa.array([], pa.binary())
    common = context.broadcast((names, often["n"].to_numpy()))
    table = materialise(count_grams(training))
    blocks = max(1, -(-table.count() // block_nodes))
    low = table.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("key")).agg(F.sum("n").alias("n")).toArrow()  # at most 65,536 rows
    given, found = given.withColumn("row", F.monotonically_increasing_id()), None
    if blocks > 1:
        given = materialise(given)  # so that all passes see the same numbers
    for block in range(blocks):
        nodes = table.filter(_block_column(blocks) == block).toArrow()
        trie = context.broadcast(vars(Trie(*(x["key"].to_numpy().astype(np.uint64) if c == "key" else x["n"].to_numpy() for x in (nodes, low) for c in ("key", "n")))))
        if found is None:
            found = materialise(_passes(given, trie, blocks, block, common))
            main = found.filter("word is null")
        else:
            more = _passes(given, trie, blocks, block).withColumnRenamed("score", "part")
            main = materialise(main.join(more, "row").withColumn("score", F.col("score") + F.col("part")).drop("part"))
    rare = (
        found.filter("word is not null").select("row", "word", F.col("n_words").alias("tf"))
        .join(counts.filter(F.col("n") * frequent <= tokens), "word", "inner")
        .groupBy("row").agg(F.sum("tf").alias("n_rare"), F.sum(F.col("tf") * F.log10(F.col("n") + 1.0)).alias("rare_logs"))
    )
    each = F.lit(float(np.log10(tokens + kinds + 1)))
    end = F.lit(float(np.log10(ends + 1)))
    zero = F.lit(0).cast("long")
    return main.join(rare, "row", "left").select(
        "doc_id",
        held_out(F.col("doc_id"), parts, which).alias("held_out"),
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("n_often") + F.coalesce("n_rare", zero) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) + end - (F.col("n_words") + 1) * each).alias("base_score"),
        "score",
    )
