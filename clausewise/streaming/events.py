"""Progress events: building, filtering, latest state, bounded history, replay; for tables and for streams."""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from clausewise.functions.maths import half_up, lookup
from clausewise.sources.reference_data import (
    DEFAULT_STAGE_MESSAGE,
    EXPECTED_SECONDS,
    FEED_TYPES,
    HISTORY_EVENTS,
    STAGES,
    STATUS_TTL_SECONDS,
)

PAYLOAD = "type string, status string, progress int, message string, clause string, issue string"
FAILED, COMPLETE = "FAILED", "COMPLETE"


# --- building ---------------------------------------------------------------------------------------------


def stage_progress(stage: Column) -> Column:
    return lookup(stage, {k: v[0] for k, v in STAGES.items()}, F.lit(0))


def stage_message(stage: Column) -> Column:
    return lookup(stage, {k: v[1] for k, v in STAGES.items()}, F.lit(DEFAULT_STAGE_MESSAGE))


def status_events(stages: DataFrame) -> DataFrame:
    """``stages(audit_id, seq, ts, stage, status[, percent, note])`` to status events; unknown stages count 0 %."""
    percent = F.coalesce("percent", stage_progress(F.col("stage"))) if "percent" in stages.columns else stage_progress(F.col("stage"))
    note = F.coalesce("note", stage_message(F.col("stage"))) if "note" in stages.columns else stage_message(F.col("stage"))
    body = F.struct(
        F.lit("status_change").alias("type"), F.coalesce("status", F.lit("CLASSIFYING")).alias("status"), percent.alias("progress"), note.alias("message")
    )
    return stages.filter(F.col("audit_id").isNotNull()).select("audit_id", "seq", "ts", F.to_json(body).alias("payload"))


def item_events(rows: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """``clause_found`` or ``issue_flagged`` events, one per row of clauses or issues (table or stream)."""
    item = "clause" if kind == "clause_found" else "issue"
    body = F.struct(F.lit(kind).alias("type"), F.struct(*columns).alias(item))
    return rows.select("audit_id", F.col("pos").alias("seq"), F.to_json(body).alias("payload"))


# --- reading ----------------------------------------------------------------------------------------------


def parse_events(raw: DataFrame) -> DataFrame:
    """Add the fields of the JSON payload; ``malformed`` marks rows that are no JSON object or name no type."""
    parsed = raw.withColumn("_e", F.from_json("payload", PAYLOAD, {"mode": "PERMISSIVE"}))
    return parsed.select("*", F.col("_e.type").alias("type"), F.col("_e.status").alias("status"), F.col("_e.progress").alias("progress"),
                         F.col("_e.message").alias("message"), F.col("_e.clause").alias("clause"), F.col("_e.issue").alias("issue"), F.col("_e.type").isNull().alias("malformed")).drop("_e")


def well_formed(parsed: DataFrame) -> DataFrame:
    return parsed.filter(~F.col("malformed")).drop("malformed")


def quarantine(parsed: DataFrame) -> DataFrame:
    return parsed.filter("malformed").select("audit_id", "payload")


def is_terminal(kind: Column, status: Column) -> Column:
    return (kind == "complete") | ((kind == "status_change") & status.isin(COMPLETE, FAILED))


def feed(events: DataFrame) -> DataFrame:
    return events.filter(F.col("type").isin(FEED_TYPES))


def remaining_seconds(progress: Column) -> Column:
    left = half_up(F.lit(float(EXPECTED_SECONDS)) * (F.lit(1.0) - progress / F.lit(100.0)))
    return F.when(progress >= 100, F.lit(0)).otherwise(left.cast("int"))


# --- state per audit, on tables ---------------------------------------------------------------------------


def latest_status(events: DataFrame) -> DataFrame:
    """Last status event of every audit with its progress; one aggregation, combined before the shuffle."""
    picked = F.max_by(F.struct("ts", "status", "progress"), F.struct("ts", "seq"))
    last = events.filter(F.col("type") == "status_change").groupBy("audit_id").agg(picked.alias("l"))
    return last.select("audit_id", "l.ts", "l.status", "l.progress")


def unexpired(latest: DataFrame, now: Column, seconds: int = STATUS_TTL_SECONDS) -> DataFrame:
    return latest.filter(F.col("ts") > now - F.make_interval(secs=F.lit(seconds)))


def latest_progress(events: DataFrame, audits: DataFrame | None = None) -> DataFrame:
    """Progress of the last status event per audit; with ``audits`` every audit gets a row, default 0."""
    last = events.filter(F.col("type") == "status_change").groupBy("audit_id").agg(F.max_by("progress", "seq").alias("progress"))
    if audits is None:
        return last
    return audits.select("audit_id").join(last, "audit_id", "left").withColumn("progress", F.coalesce("progress", F.lit(0)))


def history(events: DataFrame, keep: int = HISTORY_EVENTS) -> DataFrame:
    """The last events of every audit. The limit per audit also runs before the shuffle, so a busy audit stays small."""
    order = W.partitionBy("audit_id").orderBy(F.col("seq").desc())
    return events.withColumn("age", F.row_number().over(order)).filter(F.col("age") <= keep)


def until_terminal(events: DataFrame) -> DataFrame:
    """Per audit whether and when the first terminal event came, and how many events there were."""
    end = F.when(is_terminal(F.col("type"), F.col("status")), F.col("seq"))
    return events.groupBy("audit_id").agg(F.min(end).alias("end_seq"), F.count("*").alias("n_events")).withColumn("closed", F.col("end_seq").isNotNull())


def replay(kept: DataFrame, latest: DataFrame) -> DataFrame:
    """What a late reader gets first: the kept history, or the last status of audits that have no history left."""
    columns = ["audit_id", "seq", "type", "status", "progress"]
    rest = latest.join(kept.select("audit_id").distinct(), "audit_id", "left_anti")
    only_status = rest.select("audit_id", F.lit(-1).cast("bigint").alias("seq"), F.lit("status_change").alias("type"), "status", "progress")
    return kept.select(columns).unionByName(only_status.select(columns))


# --- routing and merging of stage results -----------------------------------------------------------------


def failed_audits(audits: DataFrame, warnings: DataFrame, completed_at: Column | None = None) -> DataFrame:
    """Audits with a non-recoverable warning: status FAILED, completion time, number of all their warnings."""
    per_audit = warnings.groupBy("audit_id").agg(F.count("*").alias("n_warnings"), F.count_if(~F.col("recoverable")).alias("n_fatal"))
    fatal = per_audit.filter("n_fatal > 0")
    return audits.drop("status").join(fatal, "audit_id").withColumns(
        {"status": F.lit(FAILED), "completed_at": completed_at if completed_at is not None else F.current_timestamp()}
    )


def continuing(rows: DataFrame, warnings: DataFrame) -> DataFrame:
    """Rows (audits, clauses, …) of audits without a non-recoverable warning."""
    fatal = warnings.filter(~F.col("recoverable")).select("audit_id").distinct()
    return rows.join(fatal, "audit_id", "left_anti")


def merge_updates(updates: DataFrame, fields: list[str]) -> DataFrame:
    """Last written value per field and audit (null means not written), and counters merged key by key, last wins."""
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields]
    merged = updates.groupBy("audit_id").agg(*last)
    if "counters" not in updates.columns:
        return merged
    entries = updates.select("audit_id", "seq", F.explode("counters").alias("key", "value"))
    newest = entries.groupBy("audit_id", "key").agg(F.max_by("value", "seq").alias("value"))
    counters = newest.groupBy("audit_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("counters"))
    return merged.join(counters, "audit_id", "left")


# --- state per audit, on streams --------------------------------------------------------------------------


CLOSED_SECONDS = 86_400


class UntilTerminal(StatefulProcessor):
    """State of an audit that ends: with its terminal event everything kept is deleted but a mark of one bit.

    While the mark lives, late events of the audit give nothing and bring no state back. With ``linger_seconds`` the mark
    has a time to live (``CLOSED_SECONDS`` is a day). Spark's clock for that keeps a query running, so runs that shall
    end by themselves (``availableNow``) give none.
    """

    def __init__(self, linger_seconds: int | None = None):
        self.linger = linger_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.closed = handle.getValueState("closed", "closed boolean", ttlDurationMs=self.linger * 1000 if self.linger else None)
        self.open(handle)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        given = list(rows)
        if not given or self.closed.exists():
            return
        ended = any(r.terminal for r in given)
        out = self.update(key[0], given, ended)
        if ended:
            self.closed.update((True,))
        yield from out

    def close(self) -> None:
        pass


class LastEvents(UntilTerminal):
    """Keeps the newest events of an open audit and marks it closed once a terminal event came."""

    def __init__(self, keep: int = HISTORY_EVENTS, linger_seconds: int | None = None):
        super().__init__(linger_seconds)
        self.keep = keep

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getListState("events", "seq bigint, type string, status string, progress int")

    def update(self, audit_id, given: list[Row], ended: bool) -> list[Row]:
        fresh = [(r.seq, r.type, r.status, r.progress) for r in given]
        kept = sorted([*self.events.get(), *fresh], key=itemgetter(0))[-self.keep :]
        if not ended:
            self.events.put(kept)
        else:
            self.events.clear()
        return [Row(audit_id=audit_id, seq=q, type=t, status=s, progress=p, closed=ended) for q, t, s, p in kept]


def _marked(events: DataFrame) -> DataFrame:
    return events.withColumn("terminal", F.coalesce(is_terminal(F.col("type"), F.col("status")), F.lit(False)))


def stream_history(events: DataFrame, keep: int = HISTORY_EVENTS, linger_seconds: int | None = None) -> DataFrame:
    """Streaming form of ``history``: after each batch the kept events of the audits it touched (update mode).

    The state holds the events of open audits only; the batch with the terminal event gives the last rows of an audit.
    """
    prepared = _marked(events).select("audit_id", "seq", "type", "status", F.col("progress").cast("int").alias("progress"), "terminal")
    return prepared.groupBy("audit_id").transformWithState(
        statefulProcessor=LastEvents(keep, linger_seconds), outputStructType="audit_id bigint, seq bigint, type string, status string, progress int, closed boolean",
        outputMode="Update", timeMode="ProcessingTime" if linger_seconds else "None",
    )


class LatestStatus(StatefulProcessor):
    """The last status of an audit, forgotten after a time to live (needs processing-time mode)."""

    def __init__(self, ttl_seconds: int = STATUS_TTL_SECONDS):
        self.ttl = ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq bigint, status string, progress int", ttlDurationMs=self.ttl * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = self.last.get() if self.last.exists() else None
        for batch in rows:
            top = batch.loc[batch["seq"].idxmax()]
            if best is None or top["seq"] > best[0]:
                best = (int(top["seq"]), top["status"], int(top["progress"]))
        self.last.update(best)
        yield pd.DataFrame({"audit_id": [key[0]], "seq": [best[0]], "status": [best[1]], "progress": [best[2]]})

    def close(self) -> None:
        pass


def stream_latest_status(events: DataFrame, ttl_seconds: int = STATUS_TTL_SECONDS) -> DataFrame:
    prepared = events.filter(F.col("type") == "status_change").select("audit_id", "seq", "status", "progress")
    return prepared.groupBy("audit_id").transformWithStateInPandas(
        statefulProcessor=LatestStatus(ttl_seconds), outputStructType="audit_id bigint, seq bigint, status string, progress int",
        outputMode="Update", timeMode="ProcessingTime",
    )


class LatestProgress(UntilTerminal):
    """Progress of the last status event of an open audit."""

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq bigint, progress int")

    def update(self, audit_id, given: list[Row], ended: bool) -> list[Row]:
        best = self.last.get()
        changes = [(r.seq, r.progress) for r in given if r.type == "status_change"]
        if changes:
            top = max(changes, key=itemgetter(0))
            if best is None or top[0] > best[0]:
                best = top
        if ended:
            self.last.clear()
        elif best is not None:
            self.last.update(tuple(best))
        return [Row(audit_id=audit_id, progress=best[1])] if best is not None else []


def stream_latest_progress(events: DataFrame, linger_seconds: int | None = None) -> DataFrame:
    """Streaming form of ``latest_progress`` (update mode); the state holds open audits only."""
    prepared = _marked(events).filter("terminal or (type = 'status_change' and progress is not null)").select("audit_id", "seq", "type", F.col("progress").cast("int").alias("progress"), "terminal")
    return prepared.groupBy("audit_id").transformWithState(
        statefulProcessor=LatestProgress(linger_seconds), outputStructType="audit_id bigint, progress int", outputMode="Update",
        timeMode="ProcessingTime" if linger_seconds else "None",
    )


def kept_state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """The state ``name`` as a stopped stream left it: ``audit_id`` and a row per kept value."""
    kept = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    return kept.select("key.*", "list_element.*" if "list_element" in kept.columns else "value.*")


# --- replay, then live tail -------------------------------------------------------------------------------


def write_feed(events: DataFrame, live_path: str, checkpoint: str, **trigger):
    """Write every batch of events to the live feed, a folder of its own for each; a retried batch replaces its folder.

    A batch is entered in the list of finished ones after it is written, so a snapshot never counts half a batch.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{live_path}/batch={batch_id}")
        batch.sparkSession.range(1).select(F.lit(batch_id).cast("long").alias("finished")).write.mode("overwrite").parquet(f"{live_path}_finished/of={batch_id}")

    return events.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def take_snapshot(spark: SparkSession, live_path: str, schema: StructType, snapshot_path: str, keep: int | None = HISTORY_EVENTS) -> None:
    """What a late reader starts from: the kept history of the finished batches, and the last of these batches."""
    offset = spark.read.schema("finished long").parquet(f"{live_path}_finished").agg(F.coalesce(F.max("finished"), F.lit(-1)).alias("offset"))
    live = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(live_path)
    until = live.filter(F.col("batch") <= offset.first()[0])
    rows = until if keep is None else history(until, keep).drop("age")
    rows.write.mode("overwrite").parquet(f"{snapshot_path}/events")
    offset.write.mode("overwrite").parquet(f"{snapshot_path}/offset")


def snapshot_events(spark: SparkSession, snapshot_path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{snapshot_path}/events")


def live_tail(spark: SparkSession, live_path: str, schema: StructType, snapshot_path: str) -> DataFrame:
    """The stream of events after a snapshot: batches above the snapshot's offset. Each event is in one batch, so none is
    lost or doubled at the hand-over; from there on the reader's own checkpoint counts, also after a restart."""
    offset = spark.read.schema("offset long").parquet(f"{snapshot_path}/offset").first()[0]
    return spark.readStream.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(live_path).filter(F.col("batch") > offset).drop("batch")
