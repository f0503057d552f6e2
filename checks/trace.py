"""Trace queries: batch twins of the streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.streaming import reconcile as RC
from attestra.streaming import trace as TR
from checks.base import Tables, check


def trace_lines(t: Tables) -> DataFrame:
    """The events table as trace lines; every 50th line is cut short."""
    kind = F.col("event_type")
    payload = F.to_json(F.struct(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), F.col("ts").alias("ts"),
        F.when(kind == "view", "evidence_registered").when(kind == "click", "tool_result").when(kind == "purchase", "new_kind").otherwise(kind).alias("type"),
        F.concat(F.lit("PMID:"), (F.col("event_id") % 40).cast("string")).alias("id"), F.col("event_id").bitwiseAND(F.lit(7)).alias("count"),
    ))
    return t["events"].select(F.when(F.col("event_id") % 50 == 0, F.substring(payload, 1, 20)).otherwise(payload).alias("value"))


@check("SELECT DISTINCT CAST(user_id AS VARCHAR) AS run_id, 'PMID:' || (event_id % 40) AS id FROM events WHERE event_type = 'view' AND event_id % 50 <> 0")
def trace_first(t: Tables) -> DataFrame:
    events, _ = TR.parse_trace(trace_lines(t))
    return TR.first_registrations(events)


@check("""
    SELECT CAST(user_id AS VARCHAR) AS run_id, CASE event_type WHEN 'view' THEN 'evidence_registered' WHEN 'click' THEN 'tool_result' WHEN 'purchase' THEN 'new_kind' ELSE event_type END AS type,
           count(*) AS n, CAST(sum(event_id % 8) AS BIGINT) AS results, count(*) FILTER (event_type = 'error') AS errors FROM events WHERE event_id % 50 <> 0 GROUP BY 1, 2
    UNION ALL SELECT 'malformed', '', count(*), 0, 0 FROM events WHERE event_id % 50 = 0
""")
def trace_counts(t: Tables) -> DataFrame:
    events, bad = TR.parse_trace(trace_lines(t))
    zero = F.lit(0).cast("bigint")
    cut = bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit("malformed").alias("run_id"), F.lit("").alias("type"), "n", zero.alias("results"), zero.alias("errors"))
    return TR.event_counts(events).unionByName(cut)


@check("""
    WITH e AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id % 40 AS ord, ts, event_type = 'view' AS draft,
                      CASE WHEN event_type = 'view' THEN 'claim ' || event_id WHEN event_id % 3 = 0 THEN 'unsupported' ELSE 'supported' END AS said
               FROM events WHERE event_type IN ('view', 'click')),
    d AS (SELECT run_id, ord, min((ts, said)) AS d FROM e WHERE draft GROUP BY ALL),
    v AS (SELECT run_id, ord, max((ts, said)) AS v FROM e WHERE NOT draft GROUP BY ALL)
    SELECT run_id, ord, d[2] AS text, CASE WHEN v[1] >= d[1] THEN v[2] END AS status, CASE WHEN v[1] >= d[1] THEN v[1] > d[1] + INTERVAL 30 MINUTE END AS late
    FROM d LEFT JOIN v USING (run_id, ord)
""")
def trace_verdicts(t: Tables) -> DataFrame:
    """Every drafted claim with its latest verdict, as the stream's last revisions give them."""
    key, view = F.col("event_id"), F.col("event_type") == "view"
    ord_ = (key % 40).alias("ord")
    claim = F.struct(F.lit("c").alias("id"), ord_, F.concat(F.lit("claim "), key.cast("string")).alias("text"))
    verdict = F.struct(F.lit("c").alias("claimId"), ord_, F.when(key % 3 == 0, "unsupported").otherwise("supported").alias("status"))
    payload = F.to_json(F.struct(
        F.col("user_id").cast("string").alias("run_id"), key.alias("seq"), F.col("ts").alias("ts"), F.when(view, "claim_drafted").otherwise("verdict").alias("type"),
        F.when(view, claim).alias("claim"), F.when(~view, verdict).alias("verdict"),
    ))
    events, _ = TR.parse_trace(t["events"].where(F.col("event_type").isin("view", "click")).select(payload.alias("value")))
    return RC.verdicts_of(events).select("run_id", "ord", "text", "status", "late")
