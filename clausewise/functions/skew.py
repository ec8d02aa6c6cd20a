"""Joining a large child table to one row per parent when a single parent may own a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000


def join_parent(
    child: DataFrame,
    parent: DataFrame,
    key: str,
    spread: Column,
    size: str,
    how: str = "left",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Equi join ``child`` to ``parent``, whose rows know in ``size`` how many child rows their key has.

    Parents above ``hot_rows`` child rows are replicated once per ``hot_rows`` and their children spread over
    the copies by a hash of ``spread``, so no task receives more than about ``hot_rows`` rows of one parent.
    The list of hot parents is broadcast; it cannot be longer than total rows / ``hot_rows``.
    """
    parts = F.ceil(F.col(size) / F.lit(hot_rows)).cast("int")
    hot = parent.filter(F.col(size) > hot_rows).select(key, parts.alias("_parts")).distinct()
    left = child.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int"))
    )
    copies = parent.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return left.drop("_parts").join(copies, [key, "_salt"], how).drop("_salt")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly before heavy work on each row: adaptive execution picks the number of parts by their bytes."""
    return df.hint("rebalance")


PART_BYTES = 4 << 20
UNKNOWN = 1 << 60  # what Spark takes for the size of rows that come from the driver or an RDD


def by_key(df: DataFrame, key: str) -> DataFrame:
    """Deal rows by a key to a number of parts that grows with the input, so that what groups or sorts a part needs bounded memory."""
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(least if size >= UNKNOWN else max(least, -(-size // PART_BYTES)), key)


def deal(df: DataFrame) -> DataFrame:
    """Deal rows of few bytes and much work each out to a fixed number of parts, which are not merged by their size."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism))
