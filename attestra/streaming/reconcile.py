"""Claims and verdicts in any order, and run summaries, with state of our own (``transformWithState``).

A stream-stream join forgets a claim once its time bound has passed, so a verdict that comes later is
lost. Here a claim's state is a list of its drafts and a list of its verdicts:

* whichever comes first waits for the other;
* a claim without a verdict ``wait`` after it was drafted is told as open (null status), once;
* a verdict that changes what was told is told as a correction, with the next ``revision``;
* ``keep`` after its last event the state is dropped by a timer; a verdict after that is told alone, as an
  orphan (no text), so a batch job can still unite it.

The verdict of a claim is the latest one judged at or after its first draft; equal times go to the
greater status. Of repeated drafts the first counts (equal times: the least text). The last revision of
each claim is what ``verdicts_of`` gives for the same events in one batch, however they were split.

``run_totals`` counts a run's events per type and tells them when the run has been silent for ``idle``;
events after that start the run's next part, so the parts add up to the whole run. ``usage_deltas`` tells
each batch's own calls and tokens per model and keeps no state at all: the total is their sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from attestra.operators import analysis as A

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TOLD = "run_id string, section_id string, ord bigint, text string, drafted_at timestamp, status string, judged_at timestamp, late boolean, revision int"
TOTALS = "run_id string, part int, type string, n bigint, results bigint, errors bigint"


def use_state_store(spark: SparkSession) -> None:
    """Lists, maps and timers need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _ms(at: datetime) -> int:
    if at.tzinfo is None:
        at = at.astimezone()
    return int(at.timestamp() * 1000)


def _at(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc)


def settled(drafts: list[tuple], verdicts: list[tuple], wait_ms: int) -> tuple | None:
    """(text, drafted, status, judged, late) of the drafts (ms, text) and verdicts (ms, status) seen so far."""
    if not drafts:
        return None
    drafted, text = min(drafts)
    judged = [v for v in verdicts if v[0] >= drafted]
    if not judged:
        return text, drafted, None, None, None
    at, status = max(judged)
    return text, drafted, status, at, at > drafted + wait_ms


class Reconciler(StatefulProcessor):
    """Rows (kind, at, text) of one (run, section, claim): ``kind`` is draft or verdict, ``text`` its content."""

    def __init__(self, wait: timedelta, keep: timedelta):
        self.wait, self.keep = int(wait.total_seconds() * 1000), int(keep.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.drafts = handle.getListState("drafts", "at bigint, text string")
        self.verdicts = handle.getListState("verdicts", "at bigint, status string")
        self.told = handle.getValueState("told", "text string, drafted bigint, status string, judged bigint, late boolean, revision int")
        self.ends = handle.getValueState("ends", "at bigint")

    def _list(self, state) -> list[tuple]:
        return [tuple(r) for r in state.get()] if state.exists() else []

    def _tell(self, key: tuple, now: tuple) -> Iterator[Row]:
        before = tuple(self.told.get()) if self.told.exists() else None
        if before is not None and before[:5] == now:
            return
        revision = 0 if before is None else before[5] + 1
        self.told.update((*now, revision))
        text, drafted, status, judged, late = now
        yield Row(run_id=key[0], section_id=key[1], ord=key[2], text=text, drafted_at=None if drafted is None else _at(drafted), status=status, judged_at=None if judged is None else _at(judged), late=late, revision=revision)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        drafts, verdicts = self._list(self.drafts), self._list(self.verdicts)
        for row in rows:
            (drafts if row["kind"] == "draft" else verdicts).append((_ms(row["at"]), row["text"]))
        # only what can still count is kept: the first draft, the latest verdict, and before a draft all verdicts' latest
        drafts, verdicts = [min(drafts)] if drafts else [], [max(verdicts)] if verdicts else []
        self.drafts.put(drafts) if drafts else None
        self.verdicts.put(verdicts) if verdicts else None
        last = max(a for a, _ in drafts + verdicts)
        mark = timerValues.getCurrentWatermarkInMs()
        now = settled(drafts, verdicts, self.wait)
        if now is not None and now[2] is None and now[1] + self.wait > mark:
            self._arm(now[1] + self.wait)
        elif now is not None:
            yield from self._tell(key, now)
        if not self.ends.exists() or self.ends.get()[0] < last + self.keep:
            self.ends.update((last + self.keep,))
        self._arm(max(last + self.keep, mark + 1))

    def _arm(self, at: int) -> None:
        if at not in list(self.handle.listTimers()):
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        drafts, verdicts = self._list(self.drafts), self._list(self.verdicts)
        now = settled(drafts, verdicts, self.wait)
        if now is not None:
            yield from self._tell(key, now)
        if self.ends.exists() and expiredTimerInfo.getExpiryTimeInMs() >= self.ends.get()[0]:
            if now is None and verdicts:
                at, status = max(verdicts)
                yield from self._tell(key, (None, None, status, at, None))
            for state in (self.drafts, self.verdicts, self.told, self.ends):
                state.clear()


def claim_rows(events: DataFrame) -> DataFrame:
    """(run_id, section_id, ord, kind, at, text) of drafts and verdicts; others, and those without a key, are left out."""
    draft = F.col("type") == "claim_drafted"
    ord_ = F.when(draft, F.col("claim.ord")).otherwise(F.col("verdict.ord"))
    rows = events.where(draft | (F.col("type") == "verdict")).select(
        "run_id", F.coalesce("section_id", F.lit("")).alias("section_id"), ord_.alias("ord"),
        F.when(draft, "draft").otherwise("verdict").alias("kind"), F.col("ts").alias("at"), F.coalesce(F.when(draft, F.col("claim.text")).otherwise(F.col("verdict.status")), F.lit("")).alias("text"),
    )
    return rows.where(F.col("ord").isNotNull() & F.col("run_id").isNotNull())


def reconciled(events: DataFrame, delay: str = "1 hour", wait: timedelta = timedelta(minutes=30), keep: timedelta = timedelta(days=1)) -> DataFrame:
    """A stream of what is told about each claim, as columns ``TOLD``."""
    use_state_store(events.sparkSession)
    rows = claim_rows(events.withWatermark("ts", delay))
    return rows.groupBy("run_id", "section_id", "ord").transformWithState(Reconciler(wait, keep), TOLD, "Append", "EventTime")


def verdicts_of(events: DataFrame, wait: timedelta = timedelta(minutes=30)) -> DataFrame:
    """The same of all events at once: one row a drafted claim."""
    rows = claim_rows(events)
    keys = ["run_id", "section_id", "ord"]
    drafts = rows.where("kind = 'draft'").groupBy(*keys).agg(F.min(F.struct("at", "text")).alias("d"))
    verdicts = rows.where("kind = 'verdict'").groupBy(*keys).agg(F.max(F.struct("at", "text")).alias("v"))
    both = drafts.join(verdicts, keys, "left").withColumn("v", F.when(F.col("v.at") >= F.col("d.at"), F.col("v")))
    late = F.col("v.at") > F.col("d.at") + F.expr(f"INTERVAL '{int(wait.total_seconds())}' SECOND")
    return both.select(*keys, F.col("d.text").alias("text"), F.col("d.at").alias("drafted_at"), F.col("v.text").alias("status"), F.col("v.at").alias("judged_at"), late.alias("late"))


class RunTotals(StatefulProcessor):
    """Rows (type, n, results, errors, at) of one run, counted until it has been silent for ``idle``."""

    def __init__(self, idle: timedelta):
        self.idle = int(idle.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.types = handle.getMapState("types", "type string", "n bigint, results bigint, errors bigint")
        self.last = handle.getValueState("last", "at bigint, part int")

    def _close(self, key: tuple) -> Iterator[Row]:
        at, part = self.last.get()
        for kind, (n, results, errors) in list(self.types.iterator()):
            yield Row(run_id=key[0], part=part, type=kind[0], n=n, results=results, errors=errors)
        self.types.clear()
        self.last.update((at, part + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        # a part whose time is up ends before the rows of this batch, though timers go off after them
        if self.last.exists() and self.types.exists() and self.last.get()[0] + self.idle <= mark:
            yield from self._close(key)
        at, part = self.last.get() if self.last.exists() else (0, 0)
        for row in rows:
            kind = (row["type"],)
            n, results, errors = self.types.getValue(kind) if self.types.containsKey(kind) else (0, 0, 0)
            self.types.updateValue(kind, (n + 1, results + row["results"], errors + row["errors"]))
            at = max(at, _ms(row["at"]))
        self.last.update((at, part))
        timer = max(at + self.idle, mark + 1)
        if timer not in list(self.handle.listTimers()):
            self.handle.registerTimer(timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists() and self.types.exists() and expiredTimerInfo.getExpiryTimeInMs() >= self.last.get()[0] + self.idle:
            yield from self._close(key)


def run_totals(events: DataFrame, delay: str = "1 hour", idle: timedelta = timedelta(hours=6)) -> DataFrame:
    """A stream of (run_id, part, type, n, results, errors): a run's part is told when it has been silent."""
    use_state_store(events.sparkSession)
    error = (F.col("type") == "error").cast("bigint")
    rows = events.select("run_id", "type", F.coalesce("count", F.lit(0)).alias("results"), error.alias("errors"), F.col("ts").alias("at"))
    return rows.withWatermark("at", delay).groupBy("run_id").transformWithState(RunTotals(idle), TOTALS, "Append", "EventTime")


def start_usage_deltas(events: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write each batch's calls and tokens per model under the batch's number; a replay replaces its own."""

    def save(batch: DataFrame, number: int) -> None:
        A.usage_by_model(batch.where(F.col("model").isNotNull())).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def usage_total(spark: SparkSession, path: str) -> DataFrame:
    """The priced report of all deltas so far."""
    deltas = spark.read.parquet(path).drop("batch")
    sums = [F.sum(c).alias(c) for c in deltas.columns if c != "model"]
    return A.priced(deltas.groupBy("model").agg(*sums), A.price_table(spark))
