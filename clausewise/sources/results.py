"""Result tables on shared storage: idempotent writes, reads, stored pages, the encrypted placeholder map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.sources.page_text import WORDS

PAGES_JSON = f"array<struct<page_no:int,text:string,words:{WORDS}>>"
KEY_CONF = "spark.clausewise.pii.key"
NONCE, TAG = 12, 16


def _filesystem(spark: SparkSession, path: str):
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def _versions(spark: SparkSession, base: str) -> list[int]:
    fs, path = _filesystem(spark, base)
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(name.split("=")[1]))
    return sorted(found)


def write_version(df: DataFrame, base: str) -> str:
    """Write the next version of a whole table. Readers see it only once complete; a lost job leaves the old one valid."""
    done = _versions(df.sparkSession, base)
    path = f"{base.rstrip('/')}/version={(done[-1] if done else 0) + 1}"
    df.write.mode("overwrite").parquet(path)
    return path


def read_version(spark: SparkSession, base: str) -> DataFrame | None:
    """The newest complete version of a table, None if there is none."""
    done = _versions(spark, base)
    return spark.read.parquet(f"{base.rstrip('/')}/version={done[-1]}") if done else None


def append_if_absent(existing: DataFrame | None, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows whose key is neither stored nor repeated among themselves. Only keys of the stored table move.

    Incoming rows are dealt by their key once: the look-up, the removal of repeats and their common sort all follow that.
    """
    dealt = incoming.repartition(*key)
    fresh = dealt if existing is None else dealt.join(existing.select(key), key, "left_anti")
    return fresh.dropDuplicates(key)


def only_complete(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Rows of audits that completed."""
    return rows.join(audits.filter(F.col("status") == "COMPLETE").select("audit_id"), "audit_id", "left_semi")


BUCKETS = 16


def _bucketed(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))


def _stored(spark: SparkSession, target: str, incoming: DataFrame) -> DataFrame | None:
    """What is stored in the buckets (at most ``BUCKETS``) that the incoming rows touch; None if nothing is."""
    fs, path = _filesystem(spark, target)
    if not fs.exists(path):
        return None
    touched = [r[0] for r in incoming.select("bucket").distinct().collect()]
    return spark.read.parquet(target).filter(F.col("bucket").isin(touched))


def current_audits(stored: DataFrame) -> DataFrame:
    """Of each stored audit the row of its newest load."""
    fields = [c for c in stored.columns if c not in ("load", "bucket")]
    newest = stored.groupBy("audit_id").agg(F.max_by(F.struct(*fields), "load").alias("row"))
    return newest.select("row.*")


def save_audits(audits: DataFrame, base: str) -> None:
    """Add a load with the audits that are new or differ from their stored row, so the newest status holds."""
    spark, target = audits.sparkSession, f"{base.rstrip('/')}/audits"
    incoming = _bucketed(audits.dropDuplicates(["audit_id"]), "audit_id")
    stored = _stored(spark, target, incoming)
    load = 1
    if stored is not None:
        load = 1 + (spark.read.parquet(target).agg(F.max("load")).first()[0] or 0)
        fields = [c for c in audits.columns]
        same = current_audits(stored).select("audit_id", F.xxhash64(*fields).alias("_was"))
        incoming = incoming.withColumn("_is", F.xxhash64(*fields)).join(same, "audit_id", "left").filter(~F.col("_is").eqNullSafe(F.col("_was"))).drop("_is", "_was")
    incoming.withColumn("load", F.lit(load)).write.mode("append").partitionBy("load", "bucket").parquet(target)


def save_results(results: dict[str, DataFrame], base: str) -> None:
    """Store audits (newest status first), and clauses, issues and their links of completed audits.

    ``results`` holds audits, clauses, issues, links, warnings. Repeating a load adds nothing; a later load that
    completes an audit changes its status and adds its clauses and issues. Tables are partitioned by a hash of their
    key, and only touched partitions are read. Parquet appends commit as a whole; loads run one at a time.
    """
    spark = results["audits"].sparkSession
    save_audits(results["audits"], base)
    keys = {"clauses": ["clause_id"], "issues": ["issue_id"], "links": ["issue_id", "clause_id"], "warnings": ["audit_id", "code", "message"]}
    for name, key in keys.items():
        rows = results.get(name)
        if rows is None:
            continue
        if name in ("clauses", "issues"):
            rows = only_complete(rows, results["audits"])
        if name == "links":
            rows = rows.join(only_complete(results["issues"], results["audits"]).select("issue_id"), "issue_id", "left_semi")
        target = f"{base.rstrip('/')}/{name}"
        incoming = _bucketed(rows, key[0])
        # rows stay where their key has dealt them: by bucket they would move once more, and into as many tasks as there are buckets
        append_if_absent(_stored(spark, target, incoming), incoming, key).write.mode("append").partitionBy("bucket").parquet(target)


def read_audit(spark: SparkSession, base: str, audit_ids: list) -> dict[str, DataFrame]:
    """The stored tables for a few audits, audits as of their newest load; the id filter is pushed into every scan."""
    tables = {name: spark.read.parquet(f"{base.rstrip('/')}/{name}") for name in ("audits", "clauses", "issues", "links", "warnings")}
    chosen = {name: df.filter(F.col("audit_id").isin(audit_ids)) for name, df in tables.items() if "audit_id" in df.columns}
    chosen["audits"] = current_audits(chosen["audits"])
    chosen = {name: df.drop("bucket") for name, df in chosen.items()}
    chosen["links"] = tables["links"].drop("bucket").join(chosen["issues"].select("issue_id"), "issue_id", "left_semi")
    return chosen


def nested_audits(audits: DataFrame, clauses: DataFrame, issues: DataFrame, links: DataFrame, pii: DataFrame | None = None, part_rows: int = 1000) -> DataFrame:
    """Audits with nested clauses and nested issues (each with the ids of its clauses), in parts of bounded size.

    An audit comes in ``n_parts`` rows, one for nearly every audit; children are dealt to the parts by hash, so
    a row never holds more than about ``part_rows`` children however large the audit is. Nothing is left out.
    """
    sizes = (
        clauses.select("audit_id").unionByName(issues.select("audit_id")).groupBy("audit_id").agg(F.count("*").alias("_n"))
    )
    head = audits.join(sizes, "audit_id", "left").withColumn("n_parts", F.greatest(F.ceil(F.coalesce("_n", F.lit(0)) / F.lit(part_rows)), F.lit(1)).cast("int"))
    if pii is not None:
        head = head.join(pii, "audit_id", "left").fillna(0, ["total_redacted"])
    parts = head.select("audit_id", "n_parts")

    def dealt(rows: DataFrame, key: str, out: str) -> DataFrame:
        child = rows.join(parts, "audit_id").withColumn("part", F.pmod(F.xxhash64(key), F.col("n_parts")).cast("int"))
        fields = [c for c in rows.columns if c != "audit_id"]
        return child.groupBy("audit_id", "part").agg(F.array_sort(F.collect_list(F.struct(key, *[c for c in fields if c != key]))).alias(out))

    linked = issues.join(links.groupBy("issue_id").agg(F.array_sort(F.collect_set("clause_id")).alias("related")), "issue_id", "left")
    spread_out = head.drop("_n").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    return spread_out.join(dealt(clauses, "clause_id", "clauses"), ["audit_id", "part"], "left").join(
        dealt(linked, "issue_id", "issues"), ["audit_id", "part"], "left"
    )


def rehydrate(audits: DataFrame, pii: DataFrame) -> DataFrame:
    """Stored audits back as input: pages from their JSON (unreadable gives none), redaction counts with zero defaults."""
    pages = F.coalesce(F.from_json("pages_json", PAGES_JSON), F.array().cast(PAGES_JSON))
    joined = audits.join(pii.select("audit_id", "total_redacted", "entity_counts"), "audit_id", "left")
    return joined.select(
        *[c for c in audits.columns if c not in ("pages_json", "text")],
        F.coalesce("text", F.lit("")).alias("text"),
        pages.alias("pages"),
        F.coalesce("total_redacted", F.lit(0)).alias("total_redacted"),
        F.coalesce("entity_counts", F.create_map().cast("map<string,bigint>")).alias("entity_counts"),
    )


# --- encrypted placeholder map ----------------------------------------------------------------------------


def _key(spark: SparkSession) -> Column:
    """Key expression from the session setting: 64 hex digits.

    The key is looked up from a one-row table while the plan runs, so no plan holds it.
    """
    text = spark.conf.get(KEY_CONF, "")
    if len(text) != 64 or any(c not in "0123456789abcdefABCDEF" for c in text):
        raise ValueError(f"{KEY_CONF} must hold 64 hex characters (32 bytes)")
    spark.createDataFrame([(text,)], "k string").createOrReplaceTempView("clausewise_pii_key")
    return F.unhex(F.expr("(SELECT first(k) FROM clausewise_pii_key)"))


def seal_maps(df: DataFrame, mapping: str, out: str) -> DataFrame:
    """Adds ``out``: AES-256-GCM of the map column as JSON, laid out nonce (12), tag (16), ciphertext."""
    native = F.aes_encrypt(F.to_json(F.col(mapping)).cast("binary"), _key(df.sparkSession), F.lit("GCM"))
    size, b = F.octet_length("_native"), F.col("_native")
    laid_out = F.concat(F.substring(b, 1, NONCE), b.substr(size - TAG + 1, F.lit(TAG)), b.substr(F.lit(NONCE + 1), size - NONCE - TAG))
    # the nonce is drawn per evaluation, so the bytes are sealed once, before they are cut: as a row-dependent expression, which
    # the optimiser never copies
    return df.withColumn("_native", F.when(F.monotonically_increasing_id() >= 0, native)).withColumn(out, laid_out).drop("_native")


def open_maps(df: DataFrame, stored: str, out: str) -> DataFrame:
    """Adds ``out``: the map back; null where bytes are too short, tag or key are wrong, or the content is no JSON."""
    b, size = F.col(stored), F.octet_length(stored)
    native = F.concat(F.substring(b, 1, NONCE), b.substr(F.lit(NONCE + TAG + 1), size - NONCE - TAG), F.substring(b, NONCE + 1, TAG))
    plain = F.try_aes_decrypt(F.when(size > NONCE + TAG, native), _key(df.sparkSession), F.lit("GCM")).cast("string")
    return df.withColumn(out, F.from_json(plain, "map<string,string>"))
