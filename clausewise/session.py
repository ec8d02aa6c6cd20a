"""Session settings the operators rely on, and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # shuffle files go when the query that made them ends, not when the driver happens to collect its garbage
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # rows that hold whole pages go to Python in batches of bounded size
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


# Stage results and stored tables of audits are mostly texts that resemble one another. The training-data operators keep the
# default, since this compressor takes memory outside the heap.
AUDIT_CODEC = ("spark.sql.parquet.compression.codec", "zstd")

# A filter on the size of an exploded array is inferred below the explode, with the whole array spelled out in it: what makes the
# array (patterns over a text) would run twice, and more often where its steps mention one another.
EXCLUDED_RULES = "spark.sql.optimizer.excludedRules"
NOT_INFERRED = "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate"


def build_session(app: str = "clausewise", master: str | None = None, **conf: str) -> SparkSession:
    """A session for local runs and tests; on a cluster use the session you are given and ``tune`` it."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings (all are changeable on a running session)."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    excluded = [r for r in spark.conf.get(EXCLUDED_RULES, "").split(",") if r]
    if NOT_INFERRED not in excluded:
        spark.conf.set(EXCLUDED_RULES, ",".join([*excluded, NOT_INFERRED]))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, from ``spark.checkpoint.dir``; a scratch folder only where that is unset (tests).

    On a cluster every executor would write to its own scratch folder, so there the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def materialise(df: DataFrame) -> DataFrame:
    """Write a stage result to the shared folder once and go on from the written table.

    Cuts the lineage, so later steps neither recompute it nor plan it again, and losing executors costs nothing.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/clausewise-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_folder = path
    return out


def discard(*stages: DataFrame) -> None:
    """Delete the folders of stage results that nothing reads any more."""
    for df in stages:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stage_folder)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
