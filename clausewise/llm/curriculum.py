"""Mixing sources to target weights along a time-varying curriculum.

A source's share of the mix comes from its weight; *when* its words are seen comes from its schedule, a piecewise
linear weight over training time 0 to 1. The schedule is integrated to a cumulative demand of words; a document whose
words start at the c-th word of its source is due at the time at which demand reaches c, which is the inverse of that
integral. Sorting by due time gives the training order.

Sources stand in the order of their code points, null last (an empty name is a source of its own), and their weights
repeat over that order. Targets are shares of all words, at most ``most`` times what a source has; what a source
cannot take is shared among the others by weight. Inside a source, documents come in the order of the MD5 of their id
(a null id counts as an empty one; equal ids by id and size; rows equal in all of that are interchangeable), round
after round, so reruns agree. The last document of the last round may be taken in part, so that a source's words meet
its target to the word. Null and empty texts have size 0 and are taken 0 times. No rows give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (1, 2, 3)
#: Schedules given to the sources in turn: (time, weight) knots. Only the shape counts.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.5)))
MOST = 3
BUCKET_ROWS = 50_000
WORD = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size`` to ``source, source_size, source_rank, target, quota``: one row per source.

    Sources meet their ceiling in the order of ceiling per weight, so the level at which the rest is shared follows
    from running sums. The table has one row per source and is ordered as a whole.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    filled = Window.orderBy("ratio", "source_rank")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    zero = F.lit(0).cast("bigint")
    ranked = sizes.withColumn("source_rank", F.row_number().over(order)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), F.pmod(F.col("source_rank") - 1, F.lit(len(weights))) + 1)
    )
    levelled = (
        ranked.withColumn("ratio", F.lit(float(most)) * F.col("source_size") / F.col("weight"))
        .withColumn("full", F.coalesce(F.sum(F.col("source_size") * most).over(before), zero))
        .withColumn("used", F.coalesce(F.sum("weight").over(before), zero))
        .withColumn("place", F.row_number().over(filled))
        .withColumn("level", (F.sum("source_size").over(whole) - F.col("full")).cast("double") / (F.sum("weight").over(whole) - F.col("used")).cast("double"))
    )
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(whole)
    return (
        levelled.withColumn("first", first)
        .withColumn("capped", F.col("first").isNull() | (F.col("place") < F.col("first.place")))
        .withColumn("target", F.when(F.col("capped"), (F.col("source_size") * most).cast("double")).otherwise(F.col("first.level") * F.col("weight")))
        .withColumn("quota", F.least(F.floor("target"), F.col("source_size") * most))
        .select("source", "source_size", "source_rank", "target", "quota")
    )


def due_time(share: Column, knots: tuple) -> Column:
    """The time at which a piecewise linear schedule has asked for ``share`` (0 to 1) of all that it asks for."""
    pieces, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        area = (t1 - t0) * (w0 + w1) / 2
        pieces.append((t0, t1, w0, (w1 - w0) / (t1 - t0), done, done + area))
        done += area
    asked, out = share * F.lit(done), None
    for t0, t1, w0, slope, low, high in reversed(pieces):
        rest = asked - F.lit(low)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0)))
        inside = F.least(F.lit(t0) + F.when(rest <= 0, F.lit(0.0)).otherwise(F.lit(2.0) * rest / (F.lit(w0) + root)), F.lit(t1))
        out = inside if out is None else F.when(asked < F.lit(high), inside).otherwise(out)
    return out


def mix(docs: DataFrame, weights: tuple = WEIGHTS, schedules: tuple = SCHEDULES, most: int = MOST, carried: bool = False) -> DataFrame:
    """``doc_id, source, text`` (and more) to ``doc_id, source, size, source_size, target, taken, position``, a row per row.

    ``position`` is the due time of the first copy; later copies are due at ``training_order``'s times. A third of
    all rows may belong to one source: the running count of words inside a source is cut by leading digits of the
    MD5 into buckets of about ``BUCKET_ROWS`` rows, whose sums are added up first. With ``carried`` the whole row comes
    along in the struct ``doc``.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    along = [F.struct(*docs.columns).alias("doc")] if carried else []
    sized = docs.select(*along, "doc_id", "source", size.alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("turn"))
    digits = max(1, min(6, math.ceil(math.log(max(docs.count() / BUCKET_ROWS, 1), 16))))
    # empty names and null stay apart as keys
    sized = sized.withColumn("bucket", F.substring("turn", 1, digits)).withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    sums = sized.drop("doc").groupBy("key", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("words"))
    goals = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    goals = goals.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source")
    run = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("base", F.coalesce(F.sum("words").over(run), F.lit(0))).select("key", "bucket", "base").join(goals, "key")
    inner = Window.partitionBy("key", "bucket").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sized.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
        .join(offsets, ["key", "bucket"])
        .withColumn("at", F.col("base") + F.col("within"))
    )
    rounds = F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(F.lit(0).cast("bigint"))
    rest = F.col("quota") - rounds * F.col("source_size")
    taken = rounds * F.col("size") + F.least(F.col("size"), F.greatest(rest - F.col("at"), F.lit(0)))
    return placed.withColumn("taken", taken).withColumn(
        "position", F.when(F.col("taken") > 0, _due(F.col("at"), schedules))
    ).select(*["doc"] * carried, "doc_id", "source", "size", "source_size", "target", "taken", "position", "at", "quota", "source_rank")


def _due(at: Column, schedules: tuple) -> Column:
    share = at.cast("double") / F.col("quota").cast("double")
    kind, out = F.pmod(F.col("source_rank") - 1, F.lit(len(schedules))), due_time(share, schedules[-1])
    for i, knots in enumerate(schedules[:-1]):
        out = F.when(kind == i, due_time(share, knots)).otherwise(out)
    return out


def training_order(mixed: DataFrame, schedules: tuple = SCHEDULES, whole: bool = False) -> DataFrame:
    """A row per copy that is trained on (``copy`` from 0, ``words`` taken of it), range-sorted by ``position``.

    The last copy of a source is usually taken in part. With ``whole`` it is taken whole where that is at least as near to
    the target as leaving it out, or where the source would have no row at all; otherwise it is left out.
    """
    copies = mixed.filter(F.col("taken") > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.expr("cast((taken - 1) div size as int)"))))
    start = F.col("at") + F.col("copy") * F.col("source_size")
    placed = copies.withColumn("words", F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))).withColumn("position", _due(start, schedules))
    if whole:
        only = (F.col("at") == 0) & (F.col("copy") == 0)
        placed = placed.filter((2 * F.col("words") >= F.col("size")) | only).withColumn("words", F.col("size"))
    return placed.drop("at", "quota", "source_rank").repartitionByRange("position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy")


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, schedules: tuple = SCHEDULES, most: int = MOST) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row per copy, range-sorted by ``position``, with ``copy`` and ``words``.

    Documents that the mix does not take are gone; texts are never cut, so a source comes within half a document of its
    target, or within one where it has a single row. A new column whose name is taken gets underscores.
    """
    ordered = training_order(mix(docs, weights, schedules, most, carried=True), schedules, whole=True)
    own = [F.col(f"doc.`{c}`") for c in docs.columns]
    new = []
    for name in ("position", "copy", "words"):
        alias = name
        while alias in docs.columns:
            alias += "_"
        new.append(F.col(name).alias(alias))
    return ordered.select(*own, *new)
