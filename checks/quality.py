"""Quality metric queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.operators import quality as Q
from checks import views as V
from checks.base import Tables, check
from checks.claims import KNOWN
from checks.patents import READ, readings


def short(metric: DataFrame, *extra: str) -> DataFrame:
    return metric.withColumn("score", F.round("score", 9)).drop("name")


@check(f"""
    WITH c AS (SELECT run_id, ord, len(citations) = 0 OR EXISTS (SELECT 1 FROM (SELECT unnest(v.citations) AS id) x WHERE x.id NOT IN {KNOWN}) AS bad FROM v_claims v)
    SELECT run_id, round(1 - count(*) FILTER (bad) / count(*), 9) AS score, 1 - count(*) FILTER (bad) / count(*) >= 0.99 AS pass, count(*) AS total, count(*) FILTER (bad) AS offenders
    FROM c GROUP BY 1
""")
def m_grounding(t: Tables) -> DataFrame:
    return short(Q.grounding_integrity(V.v_claims(t), V.v_evidence(t), ["run_id"], ["ord"]))


RECALL = """
    gold AS (SELECT doc_id % 8 AS target, CAST(doc_id AS VARCHAR) AS pmid FROM labels WHERE quality = 1 AND doc_id % 8 <> 5),
    med AS (SELECT quantile_cont(CAST(n_chars AS DOUBLE), 0.5) AS m, quantile_cont(CAST(n_chars AS DOUBLE), 0.25) AS q FROM documents),
    got AS (SELECT doc_id % 8 AS target, CAST(doc_id AS VARCHAR) AS pmid, n_chars > m AS base, n_chars > q AS wide FROM documents, med)
"""


def _recall_inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    docs = t["documents"]
    target = (F.col("doc_id") % 8).alias("target")
    gold = t["labels"].where("quality = 1 AND doc_id % 8 <> 5").select(target, F.col("doc_id").cast("string").alias("pmid"))
    cut = lambda p: docs.agg(F.percentile("n_chars", p)).scalar()
    seen = lambda p: docs.where(F.col("n_chars") > cut(p)).select(target, F.concat(F.lit("PMID:"), F.col("doc_id").cast("string"), F.lit("#sec-0")).alias("id"))
    return gold, seen(0.5), seen(0.25), docs.select(target).distinct()


@check("WITH " + RECALL + """
    SELECT t.target, CASE WHEN count(g.pmid) = 0 THEN 1.0::DOUBLE ELSE round(count(b.pmid) / count(g.pmid), 9) END AS score,
           CASE WHEN count(g.pmid) = 0 THEN TRUE ELSE count(b.pmid) / count(g.pmid) >= 0.6 END AS pass, count(g.pmid) AS gold, count(b.pmid) AS found
    FROM (SELECT DISTINCT target FROM got) t LEFT JOIN gold g ON g.target = t.target LEFT JOIN got b ON b.target = g.target AND b.pmid = g.pmid AND b.base GROUP BY 1
""")
def m_recall(t: Tables) -> DataFrame:
    gold, base, _, targets = _recall_inputs(t)
    return short(Q.retrieval_recall(gold, base, targets, ["target"]))


@check("WITH " + RECALL + """,
    s AS (SELECT t.target, count(g.pmid) AS gold, CASE WHEN count(g.pmid) = 0 THEN 1.0::DOUBLE ELSE count(b.pmid) FILTER (b.base) / count(g.pmid) END AS baseline,
          CASE WHEN count(g.pmid) = 0 THEN 1.0::DOUBLE ELSE count(b.pmid) FILTER (b.wide) / count(g.pmid) END AS hybrid
          FROM (SELECT DISTINCT target FROM got) t LEFT JOIN gold g ON g.target = t.target LEFT JOIN got b ON b.target = g.target AND b.pmid = g.pmid GROUP BY 1)
    SELECT CAST(target AS VARCHAR) AS scope, round(baseline, 9) AS baseline, round(hybrid, 9) AS hybrid, round(hybrid - baseline, 9) AS lift FROM s
    UNION ALL SELECT 'all', round(avg(baseline), 9), round(avg(hybrid), 9), round(avg(hybrid - baseline), 9) FROM s
    UNION ALL SELECT 'with_gold', round(avg(baseline), 9), round(avg(hybrid), 9), round(avg(hybrid - baseline), 9) FROM s WHERE gold > 0
""")
def recall_lift(t: Tables) -> DataFrame:
    gold, base, wide, targets = _recall_inputs(t)
    lift = Q.recall_lift(*[Q.retrieval_recall(gold, got, targets, ["target"]) for got in (base, wide)])
    cols = [F.round(c, 9).alias(c) for c in ("baseline", "hybrid", "lift")]
    return lift.select(F.col("target").cast("string").alias("scope"), *cols).unionByName(Q.mean_lift(lift).select("scope", *cols))


@check("""
    WITH labs AS (SELECT target, lower(last_author) AS n FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY w DESC, last_author) AS rank FROM
            (SELECT doc_id % 4 AS target, last_author, count(*) AS w FROM v_store WHERE last_author IS NOT NULL GROUP BY 1, 2)) WHERE rank <= 3),
    e AS (SELECT l_suppkey % 3 AS target, ' SRC' || l_suppkey % 20 AS investigator, l_suppkey % 7 = 0 AS must FROM (SELECT DISTINCT l_suppkey FROM lineitem)),
    m AS (SELECT e.*, EXISTS (SELECT 1 FROM labs l WHERE l.target = e.target AND (contains(l.n, lower(trim(e.investigator))) OR contains(lower(trim(e.investigator)), l.n))) AS hit FROM e)
    SELECT t.target, CASE WHEN count(m.hit) = 0 THEN 0.0::DOUBLE ELSE round(count(*) FILTER (m.hit) / count(m.hit), 9) END AS score, count(*) FILTER (must AND NOT hit) = 0 AS pass,
           count(m.hit) AS expected, count(*) FILTER (m.hit) AS matched, count(*) FILTER (must AND NOT hit) AS missed_must
    FROM (SELECT unnest([0, 1, 2, 3]) AS target) t LEFT JOIN m ON m.target = t.target GROUP BY 1
""")
def m_labs(t: Tables) -> DataFrame:
    from attestra.operators.retrieve import top_n

    store = V.v_store(t).where(F.col("last_author").isNotNull()).withColumn("target", F.col("doc_id") % 4)
    counts = store.groupBy("target", F.col("last_author").alias("investigator")).agg(F.count(F.lit(1)).alias("w"))
    labs = top_n(counts, ["target"], [F.col("w").desc(), F.col("investigator")], 3)
    key = F.col("l_suppkey")
    expected = t["lineitem"].select("l_suppkey").distinct().select(
        (key % 3).alias("target"), F.concat(F.lit(" SRC"), (key % 20).cast("string")).alias("investigator"), (key % 7 == 0).alias("must_appear")
    )
    return short(Q.lab_match(expected, labs, store.select("target"), ["target"]))


@check("""
    WITH known AS (SELECT doc_id % 8 AS run_id, ['immunogenicity', 'half_life', 'dosing', 'manufacturability'][doc_id % 4 + 1] AS category, doc_id % 3 + 1 AS lim FROM labels WHERE quality = 1 AND doc_id % 8 <> 2),
    worst AS (SELECT run_id, category, max(CASE severity WHEN 'severe' THEN 3 WHEN 'significant' THEN 2 ELSE 1 END) AS s FROM v_risks GROUP BY 1, 2),
    a AS (SELECT run_id, count(*) AS known, count(*) FILTER (s >= lim) AS caught FROM known k LEFT JOIN worst w USING (run_id, category) GROUP BY 1)
    SELECT t.run_id, CASE WHEN known IS NULL THEN 1.0::DOUBLE ELSE round(caught / known, 9) END AS score, CASE WHEN known IS NULL THEN TRUE ELSE caught / known >= 0.5 END AS pass,
           coalesce(known, 0) AS known, coalesce(caught, 0) AS caught FROM (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS run_id) t LEFT JOIN a USING (run_id)
""")
def m_risks(t: Tables) -> DataFrame:
    key = F.col("doc_id")
    pick = lambda names, i: F.get(F.array(*[F.lit(n) for n in names]), i.cast("int"))
    known = t["labels"].where("quality = 1 AND doc_id % 8 <> 2").select(
        (key % 8).alias("run_id"), pick(["immunogenicity", "half_life", "dosing", "manufacturability"], key % 4).alias("category"),
        pick(["manageable", "significant", "severe"], key % 3).alias("min_severity"),
    )
    runs = t["labels"].select((key % 8).alias("run_id"))
    return short(Q.risk_catch(known, V.v_risks(t), runs, ["run_id"]))


@check("""
    SELECT target, repeat, CAST(ok AS INT)::DOUBLE AS score, ok AS pass FROM (SELECT target, repeat,
        list_contains(CASE WHEN target % 2 = 0 THEN ['go', 'watch'] ELSE ['no-go'] END, verdict) AS ok FROM v_runs)
""")
def m_band(t: Tables) -> DataFrame:
    runs = V.v_runs(t)
    gold = runs.select("target").distinct().withColumn(
        "allowed_verdicts", F.when(F.col("target") % 2 == 0, F.array(F.lit("go"), F.lit("watch"))).otherwise(F.array(F.lit("no-go")))
    )
    return short(Q.verdict_in_band(runs, gold, ["target", "repeat"]))


@check("""
    WITH p AS (SELECT target, verdict, count(*) AS n, min(repeat) AS f FROM v_runs GROUP BY 1, 2),
    a AS (SELECT target, sum(n) AS k, max(n) AS m, arg_max(verdict, n * 1000000 - f) AS modal_verdict FROM p GROUP BY 1)
    SELECT target, round(m / k, 9) AS score, 1 - m / k <= 0.2 AS pass, modal_verdict FROM a
""")
def m_stability(t: Tables) -> DataFrame:
    return short(Q.verdict_stability(V.v_runs(t), ["target"]))


@check("SELECT target, repeat, 1.0::DOUBLE AS score, TRUE AS pass, elapsed_ms, elapsed_ms / 1e6 AS cost_usd, elapsed_ms // 4 AS tokens FROM v_runs")
def m_cost(t: Tables) -> DataFrame:
    runs = V.v_runs(t).withColumn("cost_usd", F.col("elapsed_ms") / 1e6).withColumn("tokens", F.expr("elapsed_ms div 4"))
    return short(Q.cost_latency(runs, ["target", "repeat"]))


@check("WITH " + READ + """,
    c AS (SELECT o_orderkey AS ord, o_custkey % 20 AS run_id, [o_orderkey, o_orderkey + 1] AS figs FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey % 20 <> 4),
    p AS (SELECT c.run_id, c.ord, bool_and(coalesce(r.low, FALSE)) AS ok FROM (SELECT run_id, ord, unnest(figs) AS figure_id FROM c) c LEFT JOIN r ON r.figure_id = c.figure_id GROUP BY 1, 2),
    a AS (SELECT run_id, count(*) AS n, count(*) FILTER (ok) AS low FROM p GROUP BY 1)
    SELECT t.run_id, CASE WHEN n IS NULL THEN 1.0::DOUBLE ELSE round(low / n, 9) END AS score, coalesce(n, 0) < 3 OR low / n >= 0.5 AS pass, coalesce(n, 0) AS n, coalesce(low, 0) AS low
    FROM (SELECT DISTINCT o_custkey % 20 AS run_id FROM orders) t LEFT JOIN a USING (run_id)
""")
def m_figures(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    fig = lambda k: F.concat(F.lit("PMCID:PMC1#fig-"), k.cast("string"))
    claims = t["orders"].select(
        (F.col("o_custkey") % 20).alias("run_id"), key.alias("ord"),
        F.when((key % 2 == 0) & (F.col("o_custkey") % 20 != 4), F.array(fig(key), F.lit("PMID:1"), fig(key + 1))).otherwise(F.array(F.lit("PMID:1"))).alias("citations"),
    )
    values = readings(t).select(fig(F.col("figure_id")).alias("figure_id"), F.explode("values").alias("v")).select("figure_id", "v.read_risk")
    return short(Q.figure_grounding(claims, values, claims, ["run_id"], ["ord"]))


@check("""
    WITH c AS (SELECT run_id, section_id, ord, row_number() OVER (PARTITION BY run_id ORDER BY section_id, ord) AS rn FROM v_claims WHERE len(citations) > 0),
    a AS (SELECT run_id, count(*) AS sampled, count(*) FILTER (status = 'supported') AS supported FROM c JOIN v_verdicts USING (section_id, ord) GROUP BY 1)
    SELECT run_id, round(supported / sampled, 9) AS score, supported / sampled >= 0.9 AS pass, sampled, supported FROM a
""")
def m_faithful(t: Tables) -> DataFrame:
    return short(Q.faithfulness(V.v_claims(t), V.v_verdicts(t), ["run_id"], ["section_id", "ord"]))


@check("""
    WITH s AS (SELECT doc_id, source, i - 1 AS sentence_no, s[i] AS sentence FROM (SELECT doc_id, source, s, unnest(range(1, len(s) + 1)) AS i FROM
          (SELECT doc_id, source, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')) > 15) AS s FROM documents))),
    a AS (SELECT source, count(*) AS sentences, count(*) FILTER (sentence_no % 5 IN (1, 3)) AS unsupported FROM s GROUP BY 1)
    SELECT source, abstained, round(CASE WHEN abstained THEN 1.0 ELSE 1 - unsupported / sentences END, 9) AS score, abstained OR unsupported / sentences <= 0.1 AS pass, sentences, unsupported
    FROM (SELECT DISTINCT source, source = 'src3' AS abstained FROM documents) LEFT JOIN a USING (source)
""")
def m_sentences(t: Tables) -> DataFrame:
    docs = t.text("documents")
    rows = Q.prose_sentences(docs, ["doc_id", "source"])
    verdicts = rows.select(
        "doc_id", "sentence_no",
        F.when(F.col("sentence_no") % 5 == 1, "unsupported").when(F.col("sentence_no") % 5 == 3, "overreach").otherwise("supported").alias("status"),
    )
    runs = docs.select("source", (F.col("source") == "src3").alias("abstained")).distinct()
    out = Q.unsupported_sentences(runs, rows, verdicts, ["source"], ["doc_id", "sentence_no"])
    return short(out.join(runs, "source"))


@check("""
    WITH a AS (SELECT target, count(*) AS probes, count(*) FILTER (CASE grounded WHEN 'overreach' THEN 'supported' ELSE grounded END = expected) AS correct FROM v_probes WHERE target <> 6 GROUP BY 1)
    SELECT t.target, CASE WHEN probes IS NULL THEN 1.0::DOUBLE ELSE round(correct / probes, 9) END AS score, CASE WHEN probes IS NULL THEN TRUE ELSE correct / probes >= 0.8 END AS pass,
           coalesce(probes, 0) AS probes, coalesce(correct, 0) AS correct FROM (SELECT DISTINCT target FROM v_probes) t LEFT JOIN a USING (target)
""")
def m_probes(t: Tables) -> DataFrame:
    probes = V.v_probes(t).select("target", "expected", F.col("grounded").alias("got"))
    return short(Q.probe_accuracy(probes.where("target <> 6"), probes, ["target"]))


@check("SELECT name, round(avg(score), 9) AS mean FROM v_scores GROUP BY 1")
def scorecard(t: Tables) -> DataFrame:
    return Q.scorecard(V.v_scores(t)).withColumn("mean", F.round("mean", 9))


@check("""
    WITH c AS (SELECT name, avg(score) AS mean FROM v_scores GROUP BY 1), r AS (SELECT * FROM (VALUES ('grounding_integrity', 0.0, NULL), ('faithfulness', 0.03, NULL), ('retrieval_recall', 0.05, NULL),
          ('figure_grounding', 0.1, 0.5), ('computation_grounding', 0.0, 1.0)) x(name, tolerance, floor))
    SELECT name, round(mean, 9) AS mean, round(mean + 0.04, 9) AS baseline, CAST(tolerance AS DOUBLE) AS tolerance, (mean + 0.04) - mean > tolerance AS regressed, CAST(floor AS DOUBLE) AS floor, coalesce(mean < floor, FALSE) AS below_floor
    FROM c JOIN r USING (name)
    UNION ALL SELECT 'hard failures', count(DISTINCT target), NULL, NULL, FALSE, NULL, FALSE FROM v_scores WHERE name IN ('grounding_integrity', 'computation_grounding') AND NOT pass
""")
def regression(t: Tables) -> DataFrame:
    scores = V.v_scores(t)
    current = Q.scorecard(scores)
    out = Q.regression(current, current.withColumn("mean", F.col("mean") + 0.04))
    hard = Q.hard_failures(scores).agg(F.count(F.lit(1)).cast("double").alias("mean")).select(
        F.lit("hard failures").alias("name"), "mean", F.lit(None).cast("double").alias("baseline"), F.lit(None).cast("double").alias("tolerance"),
        F.lit(False).alias("regressed"), F.lit(None).cast("double").alias("floor"), F.lit(False).alias("below_floor"),
    )
    return out.unionByName(hard).withColumn("mean", F.round("mean", 9)).withColumn("baseline", F.round("baseline", 9))


@check("""
    WITH d AS (SELECT o_orderkey AS doc_id, o_orderkey % 6 AS declared_count FROM orders),
    f AS (SELECT d.doc_id, count(DISTINCT seq_id) AS n FROM d JOIN v_seq_ids s USING (doc_id) WHERE seq_id BETWEEN 1 AND declared_count GROUP BY 1)
    SELECT d.*, coalesce(n, 0) AS found, CASE WHEN declared_count <= 0 THEN 1.0::DOUBLE ELSE round(coalesce(n, 0) / declared_count, 9) END AS score FROM d LEFT JOIN f USING (doc_id)
""")
def m_extract(t: Tables) -> DataFrame:
    declared = t["orders"].select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 6).alias("declared_count"))
    return Q.extraction_recall(V.v_seq_ids(t), declared).withColumn("score", F.round("score", 9))


@check("""
    SELECT o_orderkey % 100 AS doc_id, count(*) AS known, count(*) FILTER (o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 1) AS equal, round(count(*) FILTER (o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 1) / count(*), 9) AS score
    FROM orders GROUP BY 1
""")
def m_residue(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    base = t["orders"].select((key % 100).alias("doc_id"), key.alias("seq_id"), F.concat("o_orderpriority", F.lit("ACDe")).alias("residues"))
    known = base.withColumn("residues", F.when(F.col("seq_id") % 4 == 1, "XX").otherwise(F.col("residues")))
    got = base.where("seq_id % 3 <> 0").withColumn("residues", F.lower("residues"))
    return Q.residue_fidelity(known, got).withColumn("score", F.round("score", 9))


@check("""
    SELECT c_nationkey AS target, count(*) AS expected, count(*) FILTER (c_custkey % 3 = 0) AS found, round(count(*) FILTER (c_custkey % 3 = 0) / count(*), 9) AS score FROM customer GROUP BY 1
""")
def m_set_recall(t: Tables) -> DataFrame:
    rows = t["customer"].select(F.col("c_nationkey").alias("target"), "c_custkey", F.regexp_replace("c_name", "#", "  no ").alias("name"))
    got = rows.where("c_custkey % 3 = 0").select("target", F.concat(F.lit(" "), F.upper(F.regexp_replace("name", " +", "\t"))).alias("name"))
    return Q.set_recall(rows.select("target", "name"), got, ["target"], "name").withColumn("score", F.round("score", 9))


@check("""
    WITH e AS (SELECT DISTINCT doc_id, seq_id, accession FROM v_hits WHERE percent_identity >= 98 AND ord % 3 <> 0), g AS (SELECT doc_id, seq_id, accession FROM v_hits WHERE percent_identity >= 99),
    r AS (SELECT doc_id, avg(CASE WHEN (doc_id, seq_id, accession) IN (SELECT doc_id, seq_id, accession FROM g) THEN 1.0::DOUBLE ELSE 0 END) AS recall FROM e GROUP BY 1),
    p AS (SELECT doc_id, avg(CASE WHEN (doc_id, seq_id, accession) IN (SELECT doc_id, seq_id, accession FROM e) THEN 1.0::DOUBLE ELSE 0 END) AS precision FROM g GROUP BY 1)
    SELECT doc_id, round(coalesce(recall, 1), 9) AS recall, round(coalesce(precision, 1), 9) AS precision FROM r FULL JOIN p USING (doc_id)
""")
def m_competitors(t: Tables) -> DataFrame:
    hits = V.v_hits(t)
    expected = hits.where("percent_identity >= 98 AND ord % 3 <> 0").select("doc_id", "seq_id", "accession").distinct()
    got = hits.where("percent_identity >= 99").select("doc_id", "seq_id", "accession")
    out = Q.competitor_scores(expected, got, ["doc_id"])
    return out.select("doc_id", F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))


LIFT = """count(*) AS probes, count(*) FILTER (grounded = expected) AS grounded_correct, count(*) FILTER (closed = expected) AS closed_correct,
    count(*) FILTER (grounded IN ('supported', 'refuted') AND grounded <> expected AND expected IN ('supported', 'refuted')) AS hallucinations,
    count(*) FILTER (grounded = 'unsupported' AND expected <> 'unsupported') AS abstentions, count(*) FILTER (grounded = expected AND closed <> expected) AS corrections,
    count(*) FILTER (closed = expected AND grounded <> expected) AS regressions, round((count(*) FILTER (grounded = expected) - count(*) FILTER (closed = expected)) / count(*), 9) AS delta"""


@check(f"""
    SELECT 'target' AS level, target, NULL::VARCHAR AS expected, {LIFT} FROM v_probes GROUP BY target
    UNION ALL SELECT 'expected', NULL, expected, {LIFT} FROM v_probes GROUP BY expected
    UNION ALL SELECT 'all', NULL, NULL, {LIFT} FROM v_probes
""")
def grounded_lift(t: Tables) -> DataFrame:
    return Q.grounded_lift(V.v_probes(t)).withColumn("delta", F.round("delta", 9))
