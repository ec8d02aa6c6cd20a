"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Seeds are what four fixed expressions find with certainty: e-mail addresses, IPv4 addresses, card numbers that pass the
Luhn check, and international phone numbers. The words before a seed induce a lexical pattern. Other tokens that look
like an identifier of a kind are instances of the patterns they stand behind. On the graph of patterns and distinct
instances, Spark scores a pattern by the share of its instances that are (seed or so far believed) identifiers of the
kind, and an instance by the chance that at least one of its patterns is right, ``ROUNDS`` times. Instances of good score
behind a pattern of good confidence and enough distinct seeds become further spans.

Spans are code points, end exclusive, of the original text. Texts stay in their row: only short contexts, values and
offsets are shuffled, pre-aggregated; patterns too common to be telling drop out before anything is joined on them.
Null and empty texts have no spans; a row comes back for every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.functions import spans as sp
from clausewise.llm.textkit import free
from clausewise.session import materialise

KINDS = ("email", "ip", "card", "phone")
#: The fixed expressions. Possessive forms and the guards on the left find the same leftmost matches in linear time.
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that a text without any match fails.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
#: Tokens that may be an identifier, and what each kind asks of one.
TOKEN = r"(?<!\S)(?=[^\s0-9@]{0,63}[0-9@])[^\s]{6,64}(?!\S)"
LOOKS = {
    "email": r"^[^@]+(@|\(at\)|\[at\])[^@]+$",
    "ip": r"^[0-9a-f:.]*[:.][0-9a-f:.]*[:.][0-9a-f:.]*$",
    "card": r"^[0-9*x-]{12,}$",
    "phone": r"^[+(]?[0-9][0-9().-]{5,}$",
}
CONTEXT = 60
ROUNDS = 3
LEAST_SEEDS = 3
CONFIDENT = 0.7
SPAN = "struct<kind:int,start:int,end:int>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, -i, 1).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _right(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.substring(F.regexp_replace(p, "^0+(?=.)", ""), 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Matches of one kind in a text column, failing ones dropped."""
    none = F.array().cast(f"array<{SPAN}>")
    number = F.lit(KINDS.index(kind))
    hinted = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(HINT[kind])
    found = F.filter(sp.find(text, BASE[kind]), lambda s: _right(kind, sp.piece(text, s)))
    return F.when(hinted, F.transform(found, lambda s: F.struct(number.alias("kind"), s["start"].alias("start"), s["end"].alias("end")))).otherwise(none)


def _before(text: Column, start: Column) -> Column:
    """Up to two words before a place, lower-cased, digits masked; empty at the start of a text."""
    low = F.greatest(start - CONTEXT, F.lit(0))
    near = F.lower(text.substr(low + 1, start - low))
    return F.regexp_replace(F.regexp_extract(near, r"(?:(\S{1,30})\s+)?(\S{1,30})\s*$", 0), r"[0-9]|\s+$", "")


def annotate(docs: DataFrame) -> DataFrame:
    """Adds ``base`` (spans of the fixed expressions), ``seeds`` and ``instances`` with their contexts, all in the row."""
    text = F.col("text")
    based = docs.withColumn("text", F.coalesce(text.cast("string"), F.lit("")))
    for kind in KINDS:
        based = based.withColumn(f"_{kind}", base_spans(text, kind))
    based = based.withColumn("base", F.concat(*[f"_{k}" for k in KINDS])).drop(*[f"_{k}" for k in KINDS])
    none = F.array().cast("array<struct<start:int,end:int>>")
    tokens = F.when(text.rlike(TOKEN), sp.find(text, TOKEN)).otherwise(none)
    free = F.filter(tokens, lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))

    def described(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), _before(text, s["start"]).alias("pattern"), F.lower(sp.piece(text, s)).alias("value"))

    seeds = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), _before(text, s["start"]).alias("pattern"), F.lower(sp.piece(text, s)).alias("value")))
    return based.withColumn("seeds", seeds).withColumn("instances", F.transform(free, described))


def score_graph(notes: DataFrame) -> DataFrame:
    """``kind, pattern, value`` of the believed instances, from the ``seeds`` and ``instances`` of all documents."""
    seeds = notes.select(F.explode("seeds").alias("s")).select("s.*").filter("pattern <> ''").distinct()
    able = materialise(seeds.groupBy("kind", "pattern").agg(F.count("*").alias("n_seeds")).filter(F.col("n_seeds") >= LEAST_SEEDS))
    kind_of = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col("value").rlike(LOOKS[k]).alias("fits")) for i, k in enumerate(KINDS)]))
    edges = notes.select(F.explode("instances").alias("s")).select("s.pattern", "s.value").filter("pattern <> ''").distinct()
    # all distinct instances of a pattern count against it, also those that do not look like the kind
    edges = edges.join(able.select("pattern").distinct(), "pattern", "left_semi").withColumn("k", kind_of).select("pattern", "value", "k.*")
    edges = materialise(edges.join(able, ["kind", "pattern"]))
    score = materialise(edges.select("kind", "value").distinct().withColumn("score", F.lit(0.0)))
    trust = None
    for _ in range(ROUNDS):
        held = edges.join(score, ["kind", "value"]).groupBy("kind", "pattern").agg(
            F.first("n_seeds").alias("n_seeds"), F.count("*").alias("n_other"), F.sum(F.when(F.col("fits"), F.col("score")).otherwise(0.0)).alias("believed")
        )
        trust = materialise(held.select("kind", "pattern", ((F.col("n_seeds") + F.col("believed")) / (F.col("n_seeds") + F.col("n_other") + 1)).alias("trust")))
        miss = F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9))))
        score = materialise(edges.filter("fits").join(trust, ["kind", "pattern"]).groupBy("kind", "value").agg((1 - F.exp(miss)).alias("score")))
    good = edges.filter("fits").join(trust.filter(F.col("trust") >= CONFIDENT), ["kind", "pattern"]).join(score.filter(F.col("score") >= CONFIDENT), ["kind", "value"])
    return good.groupBy("pattern", "value").agg(F.min(F.struct(-F.col("trust"), "kind")).alias("best")).select("pattern", "value", F.col("best.kind").alias("kind"))


def discovered(notes: DataFrame, key: str) -> DataFrame:
    """``key, more``: the spans of believed instances per ``key``, for keys that have some."""
    believed = materialise(score_graph(notes))
    places = notes.select(key, F.explode("instances").alias("s")).select(key, "s.*")
    span = F.struct("kind", "start", "end")
    return places.join(believed, ["pattern", "value"]).groupBy(key).agg(F.collect_set(span).alias("more"))


def ordered(spans: Column) -> Column:
    return F.array_sort(spans)


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """A row per row of ``doc_id, text``: ``doc_id, n_<kind>, base_sha256, spans`` and ``n_more``."""
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    notes = materialise(annotate(given).drop("text"))
    none = F.array().cast(f"array<{SPAN}>")
    joined = notes.join(discovered(notes, "row"), "row", "left").withColumn("more", F.coalesce("more", none))

    def count(number: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return joined.select(
        "doc_id", *counts,
        F.sha2(written(ordered(F.col("base"))).cast("binary"), 256).alias("base_sha256"),
        written(ordered(F.concat("base", "more"))).alias("spans"),
        F.size("more").cast("long").alias("n_more"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; where spans overlap, the longest one counts.

    Spans depend on the text alone, so those found through patterns are joined by the text's hash. ``n_chars`` follows.
    """
    key = F.sha2(F.col("text").cast("binary"), 256)
    notes = materialise(annotate(docs.select(key.alias("key"), "text")).drop("text"))
    more = materialise(discovered(notes, "key"))
    named, spans = free(docs.columns, "_key"), free(docs.columns, "_spans")
    none = F.array().cast(f"array<{SPAN}>")
    touched = materialise(
        notes.filter(F.size("base") > 0).select("key", "base").dropDuplicates(["key"]).join(more, "key", "full")
        .select(F.col("key").alias(named), F.concat(F.coalesce("base", none), F.coalesce("more", none)).alias(spans))
    )
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    marked = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(names, s["kind"] + 1).alias("entity"), F.lit(1.0).alias("score")))
    kept = F.array_sort(sp.drop_overlaps(marked, "struct<start:int,end:int,entity:string,score:double>"))
    plain = sp.splice(F.col("text"), kept, "entity")
    out = docs.withColumn(named, key).join(touched, named, "left").withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(plain))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
