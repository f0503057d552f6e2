"""Sinks: typed results and scorecards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions.numbers import fixed
from attestra.functions.canon import canonical_json

FIELDS = [
    ("type", "type"), ("value", "value"), ("unit", "unit"), ("comparator", "comparator"), ("threshold", "threshold"), ("direction", "direction"),
    ("precision", "precision"), ("tolerance", "tolerance"), ("sample_n", "sampleN"), ("nullable", "nullable"), ("note", "note"),
]


def results_json(results: DataFrame) -> DataFrame:
    """One canonical JSON document (sorted keys) of typed results per computation.

    A computation has a handful of result keys; its series points are gathered per key.
    """
    gap = F.struct(F.col("missing_n").alias("missingN"), F.col("observed_n").alias("observedN"), F.col("total_n").alias("totalN"), "fraction")
    body = [F.col(c).alias(n) for c, n in FIELDS] + [gap.alias("missingness")]
    point = F.struct("pos", F.struct(F.col("group_key").alias("key"), *body).alias("v"))
    heads = results.where(F.col("group_key").isNull())
    groups = results.where(F.col("group_key").isNotNull()).groupBy("computation_id", "result_key").agg(
        F.transform(F.sort_array(F.collect_list(point)), lambda p: p["v"]).alias("groups")
    )
    full = heads.join(groups, ["computation_id", "result_key"], "left").select(
        "computation_id", "result_key", F.struct(*body, "groups").alias("v")
    )
    keep_null = {"ignoreNullFields": "false"}
    # A scalar has no group list at all; its null list is cut from the text.
    text = F.regexp_replace(F.to_json("v", keep_null), r',"groups":null\}$', "}")
    entry = F.struct("result_key", F.concat(F.to_json(F.struct("result_key")), F.lit(" ")).alias("k"), text.alias("j"))
    docs = full.groupBy("computation_id").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    key = lambda e: F.concat(F.lit('"'), e["result_key"], F.lit('":'), e["j"])
    return docs.select(
        "computation_id", canonical_json(F.concat(F.lit('{"results":{'), F.array_join(F.transform("e", key), ","), F.lit("}}"))).alias("json")
    )


def write_results(results: DataFrame, path: str) -> None:
    """Typed results as parquet rows and as one JSON line per computation."""
    results.write.mode("overwrite").parquet(f"{path}/rows")
    results_json(results).select(F.col("json").alias("value")).write.mode("overwrite").text(f"{path}/json")


def scorecard_markdown(metrics: DataFrame, title: str) -> str:
    """A report of metric means and of every target's metrics (tens of rows)."""
    three = lambda c: fixed(c, 3)
    means = metrics.groupBy("name").agg(F.concat(F.lit("| "), "name", F.lit(" | "), three(F.avg("score")), F.lit(" |")).alias("line"))
    rows = metrics.select("target", F.struct(
        "name", F.concat(F.lit("| "), "name", F.lit(" | "), three(F.col("score")), F.lit(" | "), F.when(F.col("pass"), "y").otherwise("n"), F.lit(" |")).alias("line"),
        F.col("pass").alias("pass"),
    ).alias("m"))
    per = rows.groupBy("target").agg(F.sort_array(F.collect_list("m")).alias("m")).select(
        "target",
        F.array_join(F.transform(F.filter("m", lambda x: ~x["pass"]), lambda x: x["name"]), ", ").alias("fails"),
        F.array_join(F.transform("m", lambda x: x["line"]), "\n").alias("table"),
    )
    lines = [f"# {title}", "", "## Aggregates", "| metric | mean |", "| --- | --- |"]
    lines += [r["line"] for r in means.orderBy("name").collect()]
    lines += ["", "## Per target"]
    for r in per.orderBy("target").collect():
        lines += [f"### {r['target']}", f"FAIL: {r['fails']}" if r["fails"] else "all pass", "| metric | score | pass |", "| --- | --- | --- |", r["table"], ""]
    return "\n".join(lines)


def write_scorecard(metrics: DataFrame, path: str, title: str = "Evaluation scorecard") -> None:
    """Metrics and their means as JSON, and the report as markdown."""
    metrics.write.mode("overwrite").json(f"{path}/metrics")
    metrics.groupBy("name").agg(F.avg("score").alias("mean")).coalesce(1).write.mode("overwrite").json(f"{path}/aggregates")
    report = scorecard_markdown(metrics, title)
    metrics.sparkSession.createDataFrame([(report,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")
