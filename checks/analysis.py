"""Frozen-table analysis queries over the line items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.operators import analysis as A
from attestra.operators import quality as Q
from attestra.session import cut_lineage
from checks import views as V
from checks.base import Tables, check


@check("""
    SELECT k AS key, count(*) AS copies FROM (SELECT CASE WHEN l_orderkey % 50 = 0 THEN ' ' ELSE l_orderkey || '-' || l_linenumber END AS k FROM lineitem)
    GROUP BY 1 HAVING count(*) > 1 OR trim(k) = ''
""")
def dup_keys(t: Tables) -> DataFrame:
    key = F.when(F.col("l_orderkey") % 50 == 0, " ").otherwise(F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return A.duplicate_keys(t["lineitem"].select(key.alias("key")), "key")


@check("""
    SELECT l_linenumber, CASE WHEN isfinite(v) THEN v END AS value, trim(measure_text) <> '' AND (v IS NULL OR NOT isfinite(v)) AS bad, count(*) AS n
    FROM (SELECT *, TRY_CAST(trim(measure_text) AS DOUBLE) AS v FROM v_measure) GROUP BY ALL
""")
def parse_measure(t: Tables) -> DataFrame:
    parsed = A.parse_measure(V.v_measure(t), "measure_text")
    return parsed.groupBy("l_linenumber", F.col("measure_text").alias("value"), F.col("measure_text_bad").alias("bad")).agg(
        F.count(F.lit(1)).alias("n")
    )


@check("""
    SELECT l_returnflag, CASE WHEN trim(l) = '' THEN 'Unknown' ELSE trim(l) END AS lineage, reason, count(*) AS n FROM
      (SELECT l_returnflag, CASE WHEN l_linenumber = 6 THEN ' ' WHEN l_linenumber = 7 THEN '' ELSE ' L' || l_linenumber || ' ' END AS l,
              CASE WHEN l_quantity - 5 < 0 THEN 'negative measure' END AS r1, CASE WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN 'unreviewed sample_class' END AS r2,
              CASE WHEN l_suppkey % 10 = 3 THEN 'study_id differs from the reviewed cohort' END AS r3 FROM lineitem),
      (SELECT unnest(['a', 'b', 'c', 'd']) AS w),
      LATERAL (SELECT CASE w WHEN 'a' THEN r1 WHEN 'b' THEN r2 WHEN 'c' THEN r3 ELSE 'any' END AS reason)
    WHERE reason IS NOT NULL GROUP BY ALL
""")
def domain_rules(t: Tables) -> DataFrame:
    line = F.col("l_linenumber")
    rows = t["lineitem"].select(
        "l_returnflag",
        A.lineage_label(F.when(line == 6, " ").when(line != 7, F.concat(F.lit(" L"), line.cast("string"), F.lit(" ")))).alias("lineage"),
        (F.col("l_quantity") - 5).alias("measure"),
        F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "A"), "blood")
        .when(F.col("l_linestatus") == "F", "Tumor").alias("sample_class"),
        F.when(F.col("l_suppkey") % 10 == 3, "other").otherwise("cohort").alias("study_id"),
    )
    why = F.concat(A.domain_reasons("measure", "sample_class", {"study_id": "cohort"}), F.array(F.lit("any")))
    return rows.select("l_returnflag", "lineage", F.explode(why).alias("reason")).groupBy("l_returnflag", "lineage", "reason").agg(
        F.count(F.lit(1)).alias("n")
    )


@check("""
    SELECT c.c_custkey AS model_id, coalesce(CAST(CAST(n.n_regionkey AS BIGINT) AS VARCHAR), '') AS gene_effect,
           CASE WHEN n_regionkey IN (0, 1, 2) THEN 'tumor' WHEN n_regionkey = 3 THEN 'normal' ELSE 'unknown' END AS sample_class
    FROM customer c LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 4) n ON n.n_nationkey = c.c_nationkey
""")
def left_join_class(t: Tables) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("Primary Solid Tumor", "Recurrent Solid Tumor", "Metastatic", "Solid Tissue Normal", "Cell line")])
    nations = t["nation"].where("n_nationkey % 5 <> 4").select(
        F.col("n_nationkey").alias("c_nationkey"), F.get(kinds, F.col("n_regionkey")).alias("sample_type"), F.col("n_regionkey").cast("bigint").alias("effect")
    )
    joined = t["customer"].join(nations, "c_nationkey", "left")
    effects = joined.where(F.col("effect").isNotNull()).select(F.col("c_custkey").alias("model_id"), F.col("effect").alias("gene_effect"))
    models = joined.select(F.col("c_custkey").alias("model_id"), A.class_of_sample(F.col("sample_type")).alias("sample_class"))
    return A.join_effects(models, effects)


MISSING = "count(*) - count(measure) AS missing_n, count(measure) AS observed_n, count(*) AS total_n, round((count(*) - count(measure)) / count(*), 8) AS fraction"


@check(f"SELECT grp, cls, {MISSING} FROM v_measure GROUP BY 1, 2")
def missingness(t: Tables) -> DataFrame:
    return A.missingness(V.v_measure(t), "measure", ["grp", "cls"])


@check(f"""
    SELECT grp AS computation_id, 'measure.median' AS result_key, NULL::VARCHAR AS group_key, 'scalar' AS type, quantile_cont(measure, 0.5) AS value, 'usd' AS unit, {MISSING},
           count(measure) AS sample_n, FALSE AS nullable FROM v_measure GROUP BY grp
    UNION ALL
    SELECT grp, 'measure.by_class', NULL, 'grouped-series', NULL, 'usd', {MISSING}, count(measure), FALSE FROM v_measure GROUP BY grp
    UNION ALL
    SELECT grp, 'measure.by_class', cls || l_linenumber, 'scalar', quantile_cont(measure, 0.5), 'usd', {MISSING}, count(measure), count(measure) = 0
    FROM v_measure GROUP BY grp, cls, l_linenumber
""")
def typed_results(t: Tables) -> DataFrame:
    rows = V.v_measure(t).withColumn("point", F.concat("cls", F.col("l_linenumber").cast("string")))
    run = F.col("grp").alias("computation_id")
    whole = A.missingness(rows, "measure", ["grp"]).join(A.percentiles(rows, ["grp"], "measure", {"m": 0.5}), "grp")
    parts = A.missingness(rows, "measure", ["grp", "point"]).join(
        A.percentiles(rows, ["grp", "point"], "measure", {"m": 0.5}), ["grp", "point"], "left"
    )
    out = (
        A.typed_rows(whole.select("*", run), "measure.median", F.col("m"), "usd", 6, 1e-6)
        .unionByName(A.typed_rows(whole.select("*", run), "measure.by_class", None, "usd", 6, 1e-6, kind="grouped-series"))
        .unionByName(A.typed_rows(parts.select("*", run), "measure.by_class", F.col("m"), "usd", 6, 1e-6, group="point"))
    )
    return out.select(
        "computation_id", "result_key", "group_key", "type", "value", "unit", "missing_n", "observed_n", "total_n", "fraction", "sample_n", "nullable"
    )


@check(f"""
    SELECT count(*) FILTER (measure <= 20000) AS at_or_below_n, round(avg(CASE WHEN measure IS NULL THEN NULL WHEN measure <= 20000 THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS at_or_below_fraction,
           {MISSING}, quantile_cont(measure, 0.5) AS median FROM v_measure
""")
def threshold_summary(t: Tables) -> DataFrame:
    out = A.threshold_summary(V.v_measure(t), "measure", 20000.0)
    return out.withColumn("at_or_below_fraction", F.round("at_or_below_fraction", 9))


@check(f"""
    SELECT g, {MISSING}, round(quantile_cont(measure, 0.5), 6) AS median FROM (SELECT *, l_orderkey % 5000 AS g FROM v_measure) GROUP BY g HAVING count(measure) >= 5
""")
def median_by_group(t: Tables) -> DataFrame:
    rows = V.v_measure(t).withColumn("g", F.col("l_orderkey") % 5000)
    return A.median_by_group(rows, "g", "measure").withColumn("median", F.round("median", 6))


@check(f"""
    SELECT c.cls, coalesce(missing_n, 0) AS missing_n, coalesce(observed_n, 0) AS observed_n, coalesce(total_n, 0) AS total_n, coalesce(fraction, 0.0) AS fraction, q1, median, q3
    FROM (SELECT unnest(['F', 'X']) AS cls) c LEFT JOIN (SELECT cls, {MISSING}, round(quantile_cont(measure, 0.25), 6) AS q1, round(quantile_cont(measure, 0.5), 6) AS median,
          round(quantile_cont(measure, 0.75), 6) AS q3 FROM v_measure GROUP BY cls) m ON m.cls = c.cls
    UNION ALL SELECT 'warnings', 2, (SELECT count(*) FROM v_measure WHERE cls NOT IN ('F', 'X')), 0, 0.0, NULL, NULL, NULL
""")
def quartiles(t: Tables) -> DataFrame:
    table, warnings = A.quartiles_by_class(V.v_measure(t), "cls", "measure", ["F", "X"])
    rounded = [F.round(q, 6).alias(q) for q in ("q1", "median", "q3")]
    said = warnings.agg(
        F.count(F.lit(1)).alias("missing_n"), F.max(F.regexp_extract("warning", r"^(\d+) rows", 1).try_cast("bigint")).alias("observed_n")
    ).select(
        F.lit("warnings").alias("cls"), "missing_n", "observed_n", F.lit(0).cast("bigint").alias("total_n"), F.lit(0.0).alias("fraction"),
        *[F.lit(None).cast("double").alias(q) for q in ("q1", "median", "q3")],
    )
    return table.select("cls", "missing_n", "observed_n", "total_n", "fraction", *rounded).unionByName(said)


@check(f"""
    SELECT 'series' AS part, l_orderkey || '-' || l_linenumber AS key, measure AS value, NULL::BIGINT AS observed_n FROM v_measure
    UNION ALL SELECT 'maximum', NULL, max(measure), count(measure) FROM v_measure
""")
def series_max(t: Tables) -> DataFrame:
    rows = V.v_measure(t).select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("key"), "measure")
    series, top = A.series_and_max(rows, "key", "measure")
    null = F.lit(None)
    return series.select(F.lit("series").alias("part"), "key", F.col("measure").alias("value"), null.cast("bigint").alias("observed_n")).unionByName(
        top.select(F.lit("maximum").alias("part"), null.cast("string").alias("key"), F.col("maximum").alias("value"), "observed_n")
    )


@check("""
    WITH s AS (SELECT min(measure) AS lo, max(measure) AS hi, least(40, greatest(10, CAST(floor(sqrt(count(measure))) AS INT))) AS bins FROM v_measure),
    b AS (SELECT least(bins - 1, CAST(floor((measure - lo) / ((hi - lo) / bins)) AS INT)) AS bin, count(*) AS n FROM v_measure, s WHERE measure IS NOT NULL GROUP BY 1),
    f AS (SELECT unnest(range(0, bins)) AS bin, lo, (hi - lo) / bins AS w FROM s)
    SELECT CAST(f.bin AS INT) AS bin, round(lo + f.bin * w, 6) AS low, round(lo + (f.bin + 1) * w, 6) AS high, coalesce(n, 0) AS n FROM f LEFT JOIN b ON b.bin = f.bin
""")
def histogram(t: Tables) -> DataFrame:
    return A.histogram(V.v_measure(t), "measure").select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


# --- Bindings and replay: one computation per order, one series point per line number ------

RESULT_SQL = """
    res AS MATERIALIZED (SELECT 'c' || l_orderkey AS computation_id, 'order.total' AS result_key, NULL::VARCHAR AS group_key, 'scalar' AS type,
                   CASE WHEN l_orderkey % 23 = 0 THEN NULL ELSE sum(CAST(l_quantity AS BIGINT))::DOUBLE END AS value, 'pieces' AS unit FROM lineitem GROUP BY l_orderkey
            UNION ALL SELECT 'c' || l_orderkey, 'order.lines', NULL, 'grouped-series', NULL, 'pieces' FROM lineitem GROUP BY l_orderkey
            UNION ALL SELECT 'c' || l_orderkey, 'order.lines', CAST(l_linenumber AS VARCHAR), 'scalar', sum(CAST(l_quantity AS BIGINT))::DOUBLE, 'pieces' FROM lineitem GROUP BY l_orderkey, l_linenumber)
"""


def results(t: Tables) -> DataFrame:
    lines = t["lineitem"].select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("q"))
    run = F.concat(F.lit("c"), F.col("l_orderkey").cast("string")).alias("computation_id")
    total = lines.groupBy("l_orderkey").agg(F.sum("q").cast("double").alias("value"))
    points = lines.groupBy("l_orderkey", "l_linenumber").agg(F.sum("q").cast("double").alias("value"))
    null = lambda kind: F.lit(None).cast(kind)
    cols = lambda key, group, kind, value, pos: [
        run, F.lit(key).alias("result_key"), group.alias("group_key"), F.lit(kind).alias("type"), value.alias("value"), pos.cast("bigint").alias("pos"),
    ]
    blank = F.when(F.col("l_orderkey") % 23 != 0, F.col("value"))
    out = (
        total.select(*cols("order.total", null("string"), "scalar", blank, F.lit(0)))
        .unionByName(total.select(*cols("order.lines", null("string"), "grouped-series", null("double"), F.lit(0))))
        .unionByName(points.select(*cols("order.lines", F.col("l_linenumber").cast("string"), "scalar", F.col("value"), F.col("l_linenumber"))))
    )
    fixed = {"unit": "pieces", "comparator": "none", "direction": "neutral", "note": None}
    out = out.select("*", *[F.lit(v).cast("string").alias(k) for k, v in fixed.items()])
    # Typed results are a stored table in practice: written once per query here.
    return cut_lineage(out.select(
        "*", null("double").alias("threshold"), F.lit(0).alias("precision"), F.lit(0.5).alias("tolerance"), F.lit(0).alias("missing_n"),
        F.lit(1).alias("observed_n"), F.lit(1).alias("total_n"), F.lit(0.0).alias("fraction"), F.lit(1).alias("sample_n"), F.lit(False).alias("nullable"),
    ))


BINDING_SQL = """
    bind AS (SELECT 'c' || o_orderkey AS computation_id, CASE o_orderkey % 6 WHEN 0 THEN 'order.total' WHEN 1 THEN 'order.lines::1' WHEN 2 THEN 'order.lines::2'
             WHEN 3 THEN 'order.none' WHEN 4 THEN 'order.lines' ELSE 'order.lines::x::3' END AS binding FROM orders),
    named AS MATERIALIZED (SELECT computation_id, result_key || coalesce('::' || group_key, '') AS binding, value, unit FROM res WHERE type = 'scalar'),
    val AS MATERIALIZED (SELECT b.*, n.value, n.unit FROM bind b LEFT JOIN named n USING (computation_id, binding))
"""


def binding_key() -> Column:
    k = F.col("o_orderkey") % 6
    return (
        F.when(k == 0, "order.total").when(k == 1, "order.lines::1").when(k == 2, "order.lines::2").when(k == 3, "order.none")
        .when(k == 4, "order.lines").otherwise("order.lines::x::3")
    )


def run_id() -> Column:
    return F.concat(F.lit("c"), F.col("o_orderkey").cast("string"))


@check("WITH " + RESULT_SQL + "," + BINDING_SQL + "SELECT computation_id, binding, value, unit FROM val")
def resolve_binding(t: Tables) -> DataFrame:
    wanted = t["orders"].select(run_id().alias("computation_id"), binding_key().alias("binding"))
    return A.resolve_binding(wanted, results(t)).select("computation_id", "binding", "value", "unit")


# Claims over orders: every gate rule is broken by some residue of the order key.
CLAIM_SQL = BINDING_SQL + """,
    cl AS (SELECT o_orderkey AS ord, o_orderkey % 7 = 0 AS free, o_orderkey % 14 = 0 AS cites_run, v.*, coalesce(v.value, 0) + CASE WHEN o_orderkey % 31 = 0 THEN 2 ELSE 0.25 END AS av,
           CASE WHEN o_orderkey % 29 = 0 THEN 'kg' ELSE 'pieces' END AS au FROM orders o JOIN val v ON v.computation_id = 'c' || o_orderkey)
"""


def bound_claims(t: Tables, stored: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    orders = t["orders"].select("o_orderkey", run_id().alias("computation_id"), binding_key().alias("binding"))
    value = A.resolve_binding(orders, stored)
    asserted = F.coalesce("value", F.lit(0.0)) + F.when(key % 31 == 0, 2.0).otherwise(0.25)
    evidence = F.concat(F.lit("run:"), "computation_id")
    return value.select(
        F.lit(1).alias("section_id"),
        key.alias("ord"),
        F.when(key % 7 == 0, F.when(key % 14 == 0, F.array(F.lit("PMID:1"), evidence)).otherwise(F.array(F.lit("PMID:1"))))
        .when(key % 37 == 0, F.array(F.lit("PMID:1"))).otherwise(F.array(evidence)).alias("citations"),
        F.when(
            key % 7 != 0,
            F.struct(
                "computation_id", F.col("binding").alias("result_key"), asserted.alias("asserted_value"),
                F.when(key % 29 == 0, "kg").otherwise("pieces").alias("asserted_unit"),
            ),
        ).alias("binding"),
    )


def computations(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    names = F.array(*[F.lit(x) for x in ("order.total", "order.none", "order.lines", "order.lines::1", "order.lines::x::3")])
    # Every third computation has an earlier evidence row too, which no claim cites.
    twice = t["orders"].withColumn("ord", F.explode(F.when(key % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    return twice.select(
        "ord", run_id().alias("computation_id"), F.concat(F.when(F.col("ord") == 0, "old:").otherwise("run:"), run_id()).alias("evidence_id"), (key % 41 != 0).alias("valid"), names.alias("result_keys"),
        F.when(key % 43 == 0, 1).otherwise(0).alias("exit_code"), (key % 47 == 0).alias("timed_out"), F.lit(None).cast("string").alias("signal"),
        (key % 53 != 0).alias("primary_valid"), (key % 53 != 0).alias("results_valid"), (key % 59 != 0).alias("replay_valid"), (key % 61 != 0).alias("same_contract"),
    )


@check("WITH " + RESULT_SQL + "," + CLAIM_SQL + """,
    lines AS (SELECT DISTINCT l_orderkey FROM lineitem)
    SELECT ord, CASE WHEN free AND cites_run THEN 'claim cites computation evidence without a structured binding' WHEN free THEN NULL
        WHEN ord % 41 = 0 THEN 'missing valid computation evidence' WHEN ord % 37 = 0 THEN 'claim does not cite its computation evidence'
        WHEN binding = 'order.lines::2' THEN 'result key is absent from computation evidence' WHEN ord % 43 = 0 OR ord % 47 = 0 THEN 'computation did not exit successfully'
        WHEN ord % 53 = 0 THEN 'primary results failed schema, identity, or hash validation' WHEN value IS NULL THEN 'bound result is missing or null'
        WHEN au <> unit THEN 'asserted unit does not match typed result' WHEN abs(value - av) > 0.5 THEN 'asserted value does not match typed result'
        WHEN ord % 59 = 0 THEN 'replay results failed schema validation' WHEN ord % 61 = 0 THEN 'replay run contract does not match the primary run'
        WHEN ord % 5 = 0 OR ord % 11 = 0 OR ord % 13 = 0 THEN 'replay output mismatched beyond the declared tolerance' END AS drop_reason,
        CASE WHEN drop_reason IS NULL AND NOT free THEN 'live' END AS execution_mode
    FROM cl
""")
def reproduce_gate(t: Tables) -> DataFrame:
    primary = results(t)
    key = F.substring("computation_id", 2, 20).cast("bigint")
    last = (F.col("result_key") == "order.total")
    # Replays shift one value, change one unit, or miss one output.
    replay = (
        primary.withColumn("value", F.when((key % 5 == 0) & F.col("value").isNull() & (F.col("type") == "scalar"), 1.0)
                           .when(key % 5 == 0, F.col("value") + 1).otherwise(F.col("value") + 0.25))
        .withColumn("unit", F.when((key % 11 == 0) & last, "boxes").otherwise(F.col("unit")))
        .where(~((key % 13 == 0) & last))
    )
    gated = A.reproduce_gate(bound_claims(t, primary), computations(t), primary, replay)
    return gated.select("ord", "drop_reason", "execution_mode")


@check("WITH " + RESULT_SQL + "," + CLAIM_SQL + """,
    why AS (SELECT ord % 4 AS run_id, ord, CASE WHEN free THEN 'computation citation lacks a structured binding'
        WHEN ord % 37 = 0 THEN 'missing matching computation evidence' WHEN ord % 43 = 0 OR ord % 47 = 0 THEN 'computation exit was not successful'
        WHEN binding = 'order.lines::2' THEN 'result key absent from evidence' WHEN ord % 53 = 0 THEN 'results schema or content hash mismatch'
        WHEN value IS NULL THEN 'bound typed result is missing or null' WHEN au <> unit THEN 'asserted unit mismatch' WHEN abs(value - av) > 0.5 THEN 'asserted value mismatch'
        WHEN ord % 3 = 2 THEN 'verification state is not trusted' WHEN ord % 10 = 9 THEN 'decorrelated LLM verification is absent or not supported' END AS reason
        FROM cl WHERE NOT free OR cites_run)
    SELECT run_id, 'reason' AS part, reason AS name, count(*)::DOUBLE AS value FROM why WHERE reason IS NOT NULL GROUP BY 1, 3
    UNION ALL SELECT run_id, 'score', CAST(count(reason) = 0 AS VARCHAR), round(1 - count(reason) / count(*), 9) FROM why GROUP BY 1
""")
def m_computation(t: Tables) -> DataFrame:
    key = F.col("ord")
    live, cached = key % 3 == 0, key % 3 == 1
    pick = lambda a, b: F.when(live, a).when(cached, b)
    stored = results(t)
    claims = bound_claims(t, stored).select(
        (key % 4).alias("run_id"), "*", pick("live", "cached").alias("execution_mode"), pick("verified", "not_run").alias("replay_verification"),
        pick("none", "verified").alias("origin_verification"), F.when(key % 10 != 9, "supported").otherwise("overreach").alias("verdict"), F.lit(True).alias("decorrelated"),
    )
    why = Q.computation_reasons(claims, computations(t), stored, ["ord"])
    score = Q.computation_grounding(why, claims.select("run_id").distinct(), ["run_id"])
    parts = why.where(F.col("reason").isNotNull()).groupBy("run_id", F.col("reason").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return parts.select("run_id", F.lit("reason").alias("part"), "name", "value").unionByName(
        score.select("run_id", F.lit("score").alias("part"), F.col("pass").cast("string").alias("name"), F.round("score", 9).alias("value"))
    )


USAGE = """
    u AS (SELECT model, count(*) AS calls, sum(tin) AS tokens_in, sum(tout) AS tokens_out FROM
          (SELECT CASE l_returnflag WHEN 'A' THEN 'claude-haiku-4-5' WHEN 'N' THEN 'local/x' ELSE CASE WHEN l_linestatus = 'F' THEN 'mystery' ELSE 'openai/gpt-oss-120b' END END AS model,
                  CAST(l_quantity AS BIGINT) * 100 AS tin, CAST(l_quantity AS BIGINT) AS tout FROM lineitem) GROUP BY 1),
    p AS (SELECT *, round(CASE model WHEN 'claude-haiku-4-5' THEN tokens_in / 1e6 * 1 + tokens_out / 1e6 * 5 WHEN 'local/x' THEN 0
                     WHEN 'openai/gpt-oss-120b' THEN tokens_in / 1e6 * 0.15 + tokens_out / 1e6 * 0.75 END, 6) AS cost_usd FROM u)
"""


@check("WITH " + USAGE + """
    SELECT model, calls, CAST(tokens_in AS BIGINT) AS tokens_in, CAST(tokens_out AS BIGINT) AS tokens_out, cost_usd FROM p
    UNION ALL SELECT 'total', CAST(sum(calls) AS BIGINT), CAST(sum(tokens_in) AS BIGINT), CAST(sum(tokens_out) AS BIGINT),
           CASE WHEN count(*) = count(cost_usd) THEN sum(cost_usd) END FROM p
""")
def usage_report(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    calls = t["lineitem"].select(
        F.when(flag == "A", "claude-haiku-4-5").when(flag == "N", "local/x").when(F.col("l_linestatus") == "F", "mystery").otherwise("openai/gpt-oss-120b").alias("model"),
        (F.col("l_quantity").cast("bigint") * 100).alias("tokens_in"), F.col("l_quantity").cast("bigint").alias("tokens_out"),
    )
    per = A.priced(A.usage_by_model(calls), A.price_table(t.spark))
    total = A.usage_total(per).select(F.lit("total").alias("model"), "calls", "tokens_in", "tokens_out", "cost_usd")
    return per.select("model", "calls", "tokens_in", "tokens_out", "cost_usd").unionByName(total).withColumn("cost_usd", F.round("cost_usd", 6))


@check("""
    SELECT o_orderkey AS k, sha256('{"datasets":[{"contentSha256":"c' || o_custkey || '","datasetId":"a","logicalSourceId":"s"},{"contentSha256":"' || o_orderkey || '","datasetId":"b","logicalSourceId":"s:'
        || o_orderstatus || '"}],"params":{"n":' || CASE WHEN o_orderkey % 3 = 0 THEN '0.' || o_custkey % 9 + 1 ELSE CAST(o_custkey AS VARCHAR) END || ',"q":[1,"x\\u001f",{"a":null,"b":true}]},"seed":' || o_orderkey || '}') AS computation_id
    FROM orders
""")
def computation_id(t: Tables) -> DataFrame:
    """Ids of manifests with unsorted, nested and repeated keys and numbers in several spellings."""
    from attestra.functions import canon

    key, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    tenth = F.concat(F.lit("0."), (F.col("o_custkey") % 9 + 1).cast("string"), F.lit("0"))
    text = F.concat(
        F.lit('{"seed": 7, "params": {"q": [1.0, "x\\u001F", {"b": true, "a": null}], "n": '), F.when(F.col("o_orderkey") % 3 == 0, tenth).otherwise(F.concat(customer, F.lit(".0e0"))),
        F.lit('},\n "datasets": [{"logicalSourceId": "s:'), "o_orderstatus", F.lit('", "datasetId": "b", "contentSha256": "'), key,
        F.lit('"}, {"datasetId": "a", "contentSha256": "c'), customer, F.lit('", "logicalSourceId": "s"}], "seed": '), key, F.lit("}"),
    )
    return t.text("orders").select(F.col("o_orderkey").alias("k"), canon.computation_id(text).alias("computation_id"))
