"""Character spans inside one text, as arrays in the row: nothing is exploded or shuffled.

Offsets are 0-based code points; ``end`` is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\u0001"  # put around matches; any such character in the text is swapped for its neighbour first
OTHER_MARK = "\u0002"


def cut(text: Column, pattern: str) -> Column:
    """The text cut at every match of a regular expression: odd elements are the matches. One scan of the text."""
    safe = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, OTHER_MARK)).otherwise(text)
    return F.split(F.regexp_replace(safe, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)


STRIDE = 128  # even, so that matches stay at odd places within every stretch


def located(pieces: Column) -> Column:
    """Spans of the matches in a cut text, in order: ``array<struct<start int, end int>>``. Pass a plain column.

    The pieces are walked in stretches, since appending to one long array would copy it for every piece.
    """
    none = F.array().cast("array<struct<start:int,end:int>>")
    inner_zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), none.alias("out"))
    outer_zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("bases"))

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        hit = F.array(F.struct(acc["at"].alias("start"), end.alias("end")))
        return F.struct(
            end.alias("at"),
            (~acc["inside"]).alias("inside"),
            F.when(acc["inside"], F.concat(acc["out"], hit)).otherwise(acc["out"]).alias("out"),
        )

    def base(acc: Column, stretch: Column) -> Column:
        return F.struct((acc["at"] + stretch["at"]).alias("at"), F.concat(acc["bases"], F.array(acc["at"])).alias("bases"))

    def shifted(stretch: Column, by: Column) -> Column:
        return F.transform(stretch["out"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end")))

    begins = F.sequence(F.lit(1), F.size(pieces), F.lit(STRIDE))
    stretches = F.transform(begins, lambda i: F.aggregate(F.slice(pieces, i, STRIDE), inner_zero, step))

    def joined(found: Column) -> Column:
        bases = F.aggregate(found, outer_zero, base, lambda acc: acc["bases"])
        return F.flatten(F.zip_with(found, bases, shifted))

    short = F.aggregate(pieces, inner_zero, step, lambda acc: acc["out"])
    long = F.transform(F.array(stretches), joined)[0]
    before, hit = F.length(F.get(pieces, F.lit(0))), F.length(F.get(pieces, F.lit(1)))
    single = F.array(F.struct(before.alias("start"), (before + hit).alias("end")))
    return F.when(F.size(pieces) <= 1, none).when(F.size(pieces) == 3, single).when(F.size(pieces) <= STRIDE, short).otherwise(long)


def running(sizes: Column) -> Column:
    """For each element the sum of those before it: ``array<int>``. Walked in stretches, as in ``located``. Pass a plain column."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, size: Column) -> Column:
        return F.struct((acc["at"] + size).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def base(acc: Column, stretch: Column) -> Column:
        return F.struct((acc["at"] + stretch["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def joined(found: Column) -> Column:
        bases = F.aggregate(found, zero, base, lambda acc: acc["out"])
        return F.flatten(F.zip_with(found, bases, lambda stretch, by: F.transform(stretch["out"], lambda at: at + by)))

    begins = F.when(F.size(sizes) > 0, F.sequence(F.lit(1), F.size(sizes), F.lit(STRIDE))).otherwise(F.array().cast("array<int>"))
    stretches = F.transform(begins, lambda i: F.aggregate(F.slice(sizes, i, STRIDE), zero, step))
    return F.transform(F.array(stretches), joined)[0]


def find(text: Column, pattern: str) -> Column:
    """All matches of a regular expression in a text. The text is cut once, not for every stretch of its pieces."""
    return F.transform(F.array(cut(text, pattern)), located)[0]


def piece(text: Column, span: Column) -> Column:
    return text.substr(span["start"] + 1, span["end"] - span["start"])


def drop_overlaps(spans: Column, element: str) -> Column:
    """Keep the spans that win against every overlapping one: highest score, then longest, then first.

    Spans are first cut into runs that touch nothing outside themselves, so only true overlaps are compared.
    """
    none = F.array().cast(f"array<{element}>")
    start = F.struct(F.lit(-1).alias("end"), none.alias("run"), F.array().cast(f"array<array<{element}>>").alias("done"))

    def cut(acc: Column, s: Column) -> Column:
        touching = s["start"] < acc["end"]
        return F.struct(
            F.greatest(acc["end"], s["end"]).alias("end"),
            F.when(touching, F.concat(acc["run"], F.array(s))).otherwise(F.array(s)).alias("run"),
            F.when(touching | (F.size(acc["run"]) == 0), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["run"]))).alias("done"),
        )

    def step(kept: Column, item: Column) -> Column:
        s = item["s"]
        clash = F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(s)))

    def winners(run: Column) -> Column:
        ranked = F.transform(
            run, lambda s: F.struct((-s["score"]).alias("k1"), (s["start"] - s["end"]).alias("k2"), s["start"].alias("k3"), s["entity"].alias("k4"), s.alias("s"))
        )
        return F.when(F.size(run) == 1, run).otherwise(F.array_sort(F.aggregate(F.array_sort(ranked), none, step)))

    runs = F.aggregate(F.array_sort(spans), start, cut, lambda acc: F.concat(acc["done"], F.array(acc["run"])))
    return F.when(F.size(spans) > 1, F.flatten(F.transform(runs, winners))).otherwise(spans)


def splice(text: Column, spans: Column, replacement: str) -> Column:
    """Replace disjoint spans (ascending) by their field ``replacement``: the pieces are cut once and joined once."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = text.substr(acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(before, s[replacement])).alias("out"))

    done = F.aggregate(
        spans, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), text.substr(acc["at"] + 1, F.length(text)))
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)


def rebase(offset: Column, spans: Column, replacement: str, clamp: str = "shifted") -> Column:
    """Where an offset of the original text lies after the splice.

    Past a replacement: moved by its change of length. Strictly inside: moved to the start of the placeholder
    (``clamp="original"`` keeps the start it had before any shift). At its start: unaffected by it.
    """

    def change(s: Column) -> Column:
        return F.length(s[replacement]) - (s["end"] - s["start"])

    shift = F.aggregate(spans, F.lit(0), lambda acc, s: acc + F.when(s["end"] <= offset, change(s)).otherwise(0))
    around = F.filter(spans, lambda s: (s["start"] < offset) & (offset < s["end"]))
    start = F.get(around, F.lit(0))["start"]
    inside = start if clamp == "original" else start + shift
    return F.when(F.size(around) > 0, inside).otherwise(offset + shift)
