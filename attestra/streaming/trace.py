"""Run traces as streams: parsing, first registrations, verdict joins, counts and usage.

Input is a folder of JSON-lines files, one event per line: run_id, seq, ts, type and the
event's own fields. Watermarks bound the state; they are this library's addition. Events that a
watermark would drop are written to a side table (``start_late``), so that a batch job over it
and the stream's output together give what one batch over all events gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attestra.operators import analysis as A

EVENT = """run_id STRING, seq BIGINT, ts TIMESTAMP, type STRING, id STRING, title STRING, tool STRING, count BIGINT, message STRING,
model STRING, tokens_in BIGINT, tokens_out BIGINT, section_id STRING, claim STRUCT<id: STRING, ord: BIGINT, text: STRING>,
verdict STRUCT<claimId: STRING, ord: BIGINT, status: STRING>"""


def read_trace(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """The raw lines of a trace folder as a stream."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def parse_trace(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(events, malformed lines)``; unknown event types are kept with their payload.

    Works on a stream and on a batch of (value) rows alike.
    """
    schema = EVENT + ", _bad STRING"
    parsed = lines.select(
        F.col("value").alias("payload"), F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("e")
    ).select("payload", "e.*")
    good = F.col("_bad").isNull() & F.col("run_id").isNotNull() & F.col("type").isNotNull() & F.col("ts").isNotNull()
    return parsed.where(good).drop("_bad"), parsed.where(~good).select("payload")


def late_events(events: DataFrame, delay: str = "1 hour") -> tuple[DataFrame, DataFrame]:
    """``(in time, late)`` by arrival: an event is late when it happened more than ``delay`` before
    it was read. Both streams together are all events.

    Stateful jobs take the first; their watermark on ``ts`` is then never passed by an event in
    time, provided files are read within ``delay`` of being written.
    """
    stamped = events.withColumn("read_at", F.current_timestamp())
    late = F.col("ts") < F.col("read_at") - F.expr(f"INTERVAL {delay}")
    return stamped.where(~late).drop("read_at"), stamped.where(late)


def start_late(events: DataFrame, path: str, checkpoint: str, delay: str = "1 hour", **trigger) -> StreamingQuery:
    """Append late events, with the time they were read, to parquet files."""
    return start_sink(late_events(events, delay)[1], path, checkpoint, **trigger)


def first_registrations(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Distinct (run_id, id) of registered evidence, each once within the watermark.

    Only keys are emitted: which copy of a micro-batch survives is arbitrary, so titles
    come from the batch upsert.
    """
    keys = events.where(F.col("type") == "evidence_registered").select("run_id", "id", "ts")
    if not events.isStreaming:
        return keys.select("run_id", "id").distinct()
    return keys.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["run_id", "id"]).select("run_id", "id")


def claim_verdicts(events: DataFrame, delay: str = "1 hour", wait: str = "30 minutes") -> DataFrame:
    """Drafted claims with their verdict; a claim without one by ``wait`` gets a null status.

    Claims and verdicts meet on (run, section, claim position): claim ids restart per round.
    """
    claims = events.where(F.col("type") == "claim_drafted").select(
        "run_id", "section_id", F.col("claim.ord").alias("ord"), F.col("claim.text").alias("text"), F.col("ts").alias("drafted_at")
    )
    verdicts = events.where(F.col("type") == "verdict").select(
        F.col("run_id").alias("v_run"), F.col("section_id").alias("v_section"), F.col("verdict.ord").alias("v_ord"),
        F.col("verdict.status").alias("status"), F.col("ts").alias("judged_at"),
    )
    if events.isStreaming:
        claims = claims.withWatermark("drafted_at", delay)
        verdicts = verdicts.withWatermark("judged_at", delay)
    same = (
        (F.col("run_id") == F.col("v_run")) & (F.col("section_id") == F.col("v_section")) & (F.col("ord") == F.col("v_ord"))
        & (F.col("judged_at") >= F.col("drafted_at")) & (F.col("judged_at") <= F.col("drafted_at") + F.expr(f"INTERVAL {wait}"))
    )
    return claims.join(verdicts, same, "left").select("run_id", "section_id", "ord", "text", "drafted_at", "status", "judged_at")


def event_counts(events: DataFrame, window: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Events, tool results and errors per run and type; state is one row per pair.

    With ``window`` counts are per run, type and window of event time, and a window's state is
    dropped ``delay`` after it ends; the sum over windows is the count of the whole run.
    """
    keys = ["run_id", "type"]
    if window is not None:
        if events.isStreaming:
            events = events.withWatermark("ts", delay)
        keys.append(F.window("ts", window).alias("window"))
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("count", F.lit(0))).alias("results"), F.count_if(F.col("type") == "error").alias("errors")
    )


def usage_so_far(events: DataFrame) -> DataFrame:
    """Running calls and tokens per model."""
    return A.usage_by_model(events.where(F.col("model").isNotNull()))


def start_usage(events: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep a priced usage report under ``path``; each batch writes the current totals.

    Batches are written under their number, so a replayed batch replaces its own output.
    """
    def report(batch: DataFrame, number: int) -> None:
        priced = A.priced(batch, A.price_table(batch.sparkSession))
        priced.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        usage_so_far(events).writeStream.outputMode("complete").foreachBatch(report)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def start_sink(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream to parquet files."""
    return (
        stream.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def start_counts(events: DataFrame, path: str, checkpoint: str, window: str | None = "1 day", delay: str = "1 hour", **trigger) -> StreamingQuery:
    """Write changed (run, type, window) counts per batch; the latest batch of a key is current."""
    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        event_counts(events, window, delay).writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )
