"""Grouping of spelling variants by composition of finite-state machines.

The vocabulary is an acceptor A with one path per word; a transducer E copies its input but for exactly one inserted,
deleted or replaced symbol. The pairs that A ∘ E ∘ A accepts are the words that are one edit apart. A state of the
composition is (state of the left A, state of the right A, edit used or not). Before the edit both sides are in one
state, after it they must read the same rest.

The composition is cut at its initial states, which stand for the prefixes read so far without an edit:

* A prefix with at most ``PART_WORDS`` words is one partition: a task minimises the acceptor of the rests of its words and
  enumerates the accepted pairs, with the states after the edit shared by all prefixes that lead to them.
* A prefix with more words, and the empty one in any case, is not gathered: the edit arcs that leave its state are
  joined by Spark on the rest that both sides must read, and its copying arcs lead on to longer prefixes. A group of
  that join holds words that are equal but for one symbol, at most as many as the alphabet has symbols.

So no task gets more than ``PART_WORDS`` words, whatever share of the vocabulary begins alike, and no pair is lost.

Words come from maximal runs of Latin letters of the whole texts, A-Z lower-cased; every run of which the CRC-32 of
``<doc_id>:<run>`` is divisible by ``DAMAGE`` first loses the code point numbered CRC-32 modulo length. Words of at least
``LEAST_LENGTH`` code points and ``LEAST_COUNT`` occurrences count. A word's form is its most frequent near word if that is at
least ``FACTOR`` times as frequent (ties: the smallest in code-point order); forms are followed to the root.

Null texts have no words; a null doc_id counts as empty text in ``<doc_id>``; repeated rows are counted each; an empty
table gives no words. Extra columns may have any names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.session import materialise

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RUN = "[a-zÀ-ÿ]+"
DAMAGE = 199
LEAST_LENGTH = 6
LEAST_COUNT = 5
FACTOR = 5
PART_WORDS = 20_000
#: Counts grow by ``FACTOR`` with every form, and 5 to the 32nd is beyond any count: so many doublings reach every root.
DOUBLINGS = 5


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` of ``doc_id, text`` (and more), after the damage; counted in the map tasks before the shuffle."""
    lowered = F.translate(F.col("text").cast("string"), UPPER, UPPER.lower())
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    damaged = F.when(F.col("h") % DAMAGE == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    words = runs.withColumn("h", h).select(damaged.alias("word"))
    return words.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))


class Acceptor:
    """The minimal acyclic acceptor of sorted distinct words: ``arcs[state]`` by symbol, ``final[state]``; starts in ``start``."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.known: dict[tuple, int] = {}
        path: list[tuple[dict[str, int], list[bool]]] = [({}, [False])]  # arcs and finality along the last word
        last = ""
        for word in words:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            self._close(path, last, same)
            path.extend(({}, [False]) for _ in word[same:])
            path[-1][1][0] = True
            last = word
        self._close(path, last, 0)
        self.start = self._state(*path[0])

    def _close(self, path: list, word: str, depth: int) -> None:
        while len(path) > depth + 1:
            arcs, final = path.pop()
            path[-1][0][word[len(path) - 1]] = self._state(arcs, final)

    def _state(self, arcs: dict[str, int], final: list[bool]) -> int:
        """The one state with these arcs and this finality."""
        key = (final[0], *sorted(arcs.items()))
        if key not in self.known:
            self.known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final[0])
        return self.known[key]


def spelt(link: tuple | None) -> str:
    """The symbols of a chain of (symbol, earlier chain)."""
    letters = []
    while link is not None:
        letters.append(link[0])
        link = link[1]
    return "".join(reversed(letters))


class Composed:
    """A ∘ E ∘ A of one acceptor."""

    def __init__(self, acceptor: Acceptor):
        self.a = acceptor
        self.live: dict[tuple[int, int], bool] = {}
        self.rests: dict[tuple[int, int], list[str]] = {}

    def meets(self, s: int, t: int) -> bool:
        """Whether some rest is read from both states."""
        todo = [((s, t), False)]
        while todo:
            pair, back = todo.pop()
            x, y = pair
            if pair in self.live and not back:
                continue
            if x == y or (self.a.final[x] and self.a.final[y]):
                self.live[pair] = True  # every state leads to a word's end
                continue
            below = [(self.a.arcs[x][c], self.a.arcs[y][c]) for c in self.a.arcs[x].keys() & self.a.arcs[y].keys()]
            if back:
                self.live[pair] = any(self.live[p] for p in below)
            else:
                self.live[pair] = False
                todo.append((pair, True))
                todo.extend((p, False) for p in below if p not in self.live)
        return self.live[(s, t)]

    def shared(self, s: int, t: int) -> list[str]:
        """All rests that both states read."""
        if (s, t) not in self.rests:
            out, todo = [], [(s, t, None)] if self.meets(s, t) else []
            while todo:
                x, y, link = todo.pop()
                if self.a.final[x] and self.a.final[y]:
                    out.append(spelt(link))
                for c in self.a.arcs[x].keys() & self.a.arcs[y].keys():
                    p, q = self.a.arcs[x][c], self.a.arcs[y][c]
                    if self.meets(p, q):
                        todo.append((p, q, (c, link)))
            self.rests[(s, t)] = out
        return self.rests[(s, t)]

    def edits(self, s: int) -> list[tuple[str, str]]:
        """(left, right) rests of the pairs whose edit is the next step from the state; each pair in one order."""
        out = []
        arcs = sorted(self.a.arcs[s].items())
        for i, (c, x) in enumerate(arcs):
            for d, y in arcs[i + 1 :]:
                out.extend((c + z, d + z) for z in self.shared(x, y))
            out.extend((z, c + z) for z in self.shared(s, x))
        return out

    def pairs(self):
        """All accepted pairs, each in one order; a pair may come more than once."""
        at_state: dict[int, list[tuple[str, str]]] = {}
        todo: list[tuple] = [(self.a.start, None)]
        while todo:
            s, link = todo.pop()
            if s not in at_state:
                at_state[s] = self.edits(s)
            prefix = spelt(link) if at_state[s] else ""
            for x, y in at_state[s]:
                yield prefix + x, prefix + y
            todo.extend((t, (c, link)) for c, t in self.a.arcs[s].items())


def arcs_joined(words: DataFrame, depth: int) -> DataFrame:
    """``a, b``: pairs of ``word``s that have the first ``depth`` symbols in common and are edited right after them."""
    prefix = F.substring("word", 1, depth) if depth else F.lit("")
    long = F.col("word").substr(F.lit(depth + 2), F.length("word"))
    whole = F.col("word").substr(F.lit(depth + 1), F.length("word"))
    cut = words.filter(F.length("word") > depth).select("word", prefix.alias("p"), long.alias("rest"))
    other = cut.withColumn("edit", F.lit("replaced")).unionByName(words.select("word", prefix.alias("p"), whole.alias("rest")).withColumn("edit", F.lit("deleted")))
    met = cut.withColumnRenamed("word", "a").join(other.withColumnRenamed("word", "b"), ["p", "rest"])
    return met.filter((F.col("a") < F.col("b")) | ((F.col("edit") == "deleted") & (F.col("a") != F.col("b")))).select("a", "b")


def parts_composed(words: DataFrame) -> DataFrame:
    """``a, b``: the accepted pairs of each ``part`` of ``words(part, word)``, whose words all begin with it."""

    def work(group: pa.Table) -> pa.Table:
        part = group["part"][0].as_py()
        found = Composed(Acceptor(sorted({w[len(part) :] for w in group["word"].to_pylist()}))).pairs()
        rows = sorted({(part + x, part + y) for x, y in found})
        return pa.table([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["a", "b"])

    return words.select("part", "word").groupBy("part").applyInArrow(work, "a string, b string")


def near_pairs(vocabulary: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """``word, other``: all pairs of different words of ``vocabulary(word)`` that are one edit apart, in both orders."""
    open_, depth, found = vocabulary.select("word"), 0, None
    while True:
        pairs = arcs_joined(open_, depth)
        depth += 1
        headed = open_.filter(F.length("word") >= depth).withColumn("part", F.substring("word", 1, depth))
        sizes = headed.groupBy("part").agg(F.count("*").alias("words"))
        small = headed.join(sizes.filter(F.col("words") <= part_words), "part", "left_semi")
        step = materialise(pairs.unionByName(parts_composed(small)))
        found = step if found is None else found.unionByName(step)
        open_ = materialise(headed.join(sizes.filter(F.col("words") > part_words), "part", "left_semi").select("word"))
        if open_.isEmpty():
            break
    one = found.select(F.col("a").alias("word"), F.col("b").alias("other"))
    return one.unionByName(one.select(F.col("other").alias("word"), F.col("word").alias("other"))).distinct()


def greater(factor: int, other: str, own: str) -> Column:
    return F.col(other).cast("decimal(20,0)") >= F.col(own).cast("decimal(20,0)") * factor


def variants(docs: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: every word of the vocabulary with its form and its root."""
    vocabulary = materialise(word_counts(docs).filter(F.col("n") >= LEAST_COUNT))
    near = near_pairs(vocabulary, part_words).join(vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("turn"), "other")).alias("best"))
    chosen = vocabulary.join(best, "word", "left").withColumn("form_n", -F.col("best.turn")).withColumn("is_form", F.coalesce(greater(FACTOR, "form_n", "n"), F.lit(False)))
    formed = materialise(
        chosen.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("is_form"), F.col("best.other")).alias("form"), F.when(F.col("is_form"), F.col("form_n")).alias("form_n"),
        )
    )
    roots = formed.select("word", F.coalesce("form", "word").alias("root"))
    for _ in range(DOUBLINGS):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = materialise(roots.join(further, "root").select("word", F.col("next").alias("root")))
    return formed.join(roots, "word").select("word", "form", "root", "n", "n_near", "form_n")
