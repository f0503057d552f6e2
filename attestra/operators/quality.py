"""Quality metrics: one row (group, name, score, pass) per scored group.

``group`` is a list of columns, usually run and target. Every metric is one aggregation per
group; judge outcomes enter as verdict tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra import constants as K
from attestra.functions import numbers as N
from attestra.functions import text as T
from attestra.session import cut_lineage


def _metric(df: DataFrame, group: list[str], name: str, score: Column, good: Column | None = None, *extra) -> DataFrame:
    mark = K.PASS_MARKS.get(name)
    out = df.withColumn("score", score)
    return out.select(
        *group, F.lit(name).alias("name"), "score", (F.col("score") >= mark if good is None else good).alias("pass"), *extra
    )


def grounding_integrity(claims: DataFrame, evidence: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """Share of claims that cite something and whose citations all exist; 1 without claims."""
    bad = (
        claims.select(*keys, F.explode("citations").alias("id"))
        .join(evidence.select("id").distinct(), "id", "left_anti")
        .select(*keys, F.lit(1).alias("_bad"))
        .distinct()
    )
    flagged = claims.join(bad, keys, "left").withColumn("_off", F.col("_bad").isNotNull() | (F.size("citations") == 0))
    agg = flagged.groupBy(*group).agg(F.count(F.lit(1)).alias("total"), F.count_if("_off").alias("offenders"))
    return _metric(agg, group, "grounding_integrity", 1 - F.col("offenders") / F.col("total"), None, "total", "offenders")


def computation_reasons(claims: DataFrame, computations: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Computed claims with the first rule they break (null: grounded).

    claims: keys, citations, binding, execution_mode, replay_verification,
    origin_verification, verdict, decorrelated. computations: evidence_id, computation_id,
    exit_code, timed_out, signal, result_keys, results_valid.
    """
    from attestra.operators.analysis import with_bound_values

    # Claims are read for their citations and for their values: written once.
    claims = cut_lineage(claims)
    runs = computations.select(
        "evidence_id", F.col("computation_id").alias("_cid"), "exit_code", "timed_out", "signal", "result_keys", "results_valid"
    )
    cited = claims.select(*keys, F.col("binding.computation_id").alias("_want"), F.posexplode("citations").alias("pos", "evidence_id"))
    met = cited.join(runs, "evidence_id")
    per = met.groupBy(*keys).agg(
        F.min_by(
            F.struct("_cid", "exit_code", "timed_out", "signal", "result_keys", "results_valid"),
            F.when(F.col("_cid") == F.col("_want"), F.col("pos")),
        ).alias("e"),
        F.bool_or(F.col("_cid") == F.col("_want")).alias("_has"),
        F.count(F.lit(1)).alias("_runs"),
    )
    joined = (
        with_bound_values(claims, results).join(per, keys, "left")
        .where(F.col("binding").isNotNull() | F.col("_runs").isNotNull())
    )
    state = lambda mode, replay, origin: (
        F.col("execution_mode").eqNullSafe(F.lit(mode))
        & F.col("replay_verification").eqNullSafe(F.lit(replay))
        & F.col("origin_verification").eqNullSafe(F.lit(origin))
    )
    e = lambda f: F.col(f"e.{f}")
    reason = (
        F.when(F.col("binding").isNull(), "computation citation lacks a structured binding")
        .when(~F.coalesce("_has", F.lit(False)), "missing matching computation evidence")
        .when(~e("exit_code").eqNullSafe(F.lit(0)) | e("timed_out") | e("signal").isNotNull(), "computation exit was not successful")
        .when(~F.array_contains(e("result_keys"), F.col("binding.result_key")), "result key absent from evidence")
        .when(~e("results_valid"), "results schema or content hash mismatch")
        .when(F.col("_value").isNull(), "bound typed result is missing or null")
        .when(F.col("_unit") != F.col("binding.asserted_unit"), "asserted unit mismatch")
        .when(F.abs(F.col("_value") - F.col("binding.asserted_value")) > F.col("_tol"), "asserted value mismatch")
        .when(~(state("live", "verified", "none") | state("cached", "not_run", "verified")), "verification state is not trusted")
        .when(
            ~(F.col("verdict").eqNullSafe(F.lit("supported")) & F.coalesce("decorrelated", F.lit(False))),
            "decorrelated LLM verification is absent or not supported",
        )
    )
    return joined.withColumn("reason", reason).select(*claims.columns, "reason")


def computation_grounding(reasons: DataFrame, groups: DataFrame, group: list[str]) -> DataFrame:
    """Share of computed claims without a reason; 1 for groups without computed claims."""
    agg = reasons.groupBy(*group).agg(F.count(F.lit(1)).alias("total"), F.count("reason").alias("offenders"))
    full = groups.select(*group).distinct().join(agg, group, "left").na.fill(0, ["total", "offenders"])
    return _metric(full, group, "computation_grounding", 1 - N.ratio(F.col("offenders"), F.col("total"), 0.0), None, "total", "offenders")


def retrieval_recall(gold: DataFrame, evidence: DataFrame, groups: DataFrame, group: list[str]) -> DataFrame:
    """Share of gold ids found anywhere in the retrieved evidence ids; 1 without gold."""
    have = (
        evidence.select(*group, F.regexp_extract("id", r"PMID:(\d+)", 1).alias("pmid"))
        .where(F.col("pmid") != "")
        .distinct()
        .withColumn("_have", F.lit(1))
    )
    agg = gold.join(have, [*group, "pmid"], "left").groupBy(*group).agg(
        F.count(F.lit(1)).alias("gold"), F.count("_have").alias("found")
    )
    full = groups.select(*group).distinct().join(agg, group, "left").na.fill(0, ["gold", "found"])
    return _metric(full, group, "retrieval_recall", N.ratio(F.col("found"), F.col("gold"), 1.0), None, "gold", "found")


def lab_match(expected: DataFrame, labs: DataFrame, groups: DataFrame, group: list[str], k: int = K.LABS_KEPT) -> DataFrame:
    """Share of expected labs among the first ``k`` named ones; names match by containment.

    A group without expected labs scores 0 and passes; a missed must-appear lab fails it.
    """
    named = labs.where(F.col("rank") <= k).select(*group, F.lower("investigator").alias("_n"))
    want = expected.withColumn("_e", F.lower(F.trim("investigator")))
    pairs = want.join(named, group).where(F.contains("_n", F.col("_e")) | F.contains("_e", F.col("_n")))
    hit = pairs.select(*group, "investigator", F.lit(1).alias("_hit")).distinct()
    agg = expected.join(hit, [*group, "investigator"], "left").groupBy(*group).agg(
        F.count(F.lit(1)).alias("expected"),
        F.count("_hit").alias("matched"),
        F.count_if(F.col("must_appear") & F.col("_hit").isNull()).alias("missed_must"),
    )
    full = groups.select(*group).distinct().join(agg, group, "left").na.fill(0, ["expected", "matched", "missed_must"])
    return _metric(
        full, group, "kol_precision_at_k", N.ratio(F.col("matched"), F.col("expected"), 0.0), F.col("missed_must") == 0,
        "expected", "matched", "missed_must",
    )


def severity_rank(col: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in K.SEVERITY_RANK.items() for x in kv])[col]


def risk_catch(known: DataFrame, flagged: DataFrame, groups: DataFrame, group: list[str]) -> DataFrame:
    """Share of known risks flagged in their category at their severity or above."""
    worst = flagged.groupBy(*group, "category").agg(F.max(severity_rank(F.col("severity"))).alias("_s"))
    agg = known.join(worst, [*group, "category"], "left").groupBy(*group).agg(
        F.count(F.lit(1)).alias("known"),
        F.count_if(F.coalesce(F.col("_s") >= severity_rank(F.col("min_severity")), F.lit(False))).alias("caught"),
    )
    full = groups.select(*group).distinct().join(agg, group, "left").na.fill(0, ["known", "caught"])
    return _metric(full, group, "developability_catch", N.ratio(F.col("caught"), F.col("known"), 1.0), None, "known", "caught")


def verdict_in_band(runs: DataFrame, gold: DataFrame, group: list[str]) -> DataFrame:
    """1 when the verdict is one of the target's allowed verdicts."""
    ok = F.array_contains("allowed_verdicts", F.col("verdict"))
    joined = runs.join(gold.select("target", "allowed_verdicts"), "target").withColumn("_ok", ok)
    return _metric(joined, group, "verdict_in_band", F.col("_ok").cast("double"), F.col("_ok"))


def verdict_stability(runs: DataFrame, group: list[str]) -> DataFrame:
    """One minus the flip rate over repeats, with the modal verdict (ties: first seen)."""
    per = runs.groupBy(*group, "verdict").agg(F.count(F.lit(1)).alias("n"), F.min("repeat").alias("_first"))
    agg = per.groupBy(*group).agg(
        F.sum("n").alias("_all"), F.max("n").alias("_mode"),
        F.max_by("verdict", F.struct(F.col("n"), -F.col("_first"))).alias("modal_verdict"),
    )
    flip = 1 - F.col("_mode") / F.col("_all")
    return _metric(agg, group, "verdict_stability", 1 - flip, flip <= K.MAX_FLIP_RATE, "modal_verdict")


def cost_latency(runs: DataFrame, group: list[str]) -> DataFrame:
    """Run cost and time as they are; informational, always passes."""
    return _metric(runs, group, "cost_latency", F.lit(1.0), F.lit(True), "elapsed_ms", "cost_usd", "tokens")


def figure_grounding(claims: DataFrame, values: DataFrame, groups: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """Of claims that cite figures, the share whose figures all have a low-risk value.

    values: figure_id, read_risk. Judged from three such claims on.
    """
    sure = values.where(F.col("read_risk") == "low").select(F.col("figure_id").alias("id"), F.lit(1).alias("_low")).distinct()
    all_keys = list(dict.fromkeys([*group, *keys]))
    cited = claims.select(*all_keys, F.explode("citations").alias("id")).where(F.col("id").contains("#fig-"))
    per = cited.join(sure, "id", "left").groupBy(*all_keys).agg(F.bool_and(F.col("_low").isNotNull()).alias("_ok"))
    agg = per.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.count_if("_ok").alias("low"))
    full = groups.select(*group).distinct().join(agg, group, "left").na.fill(0, ["n", "low"])
    score = N.ratio(F.col("low"), F.col("n"), 1.0)
    good = (F.col("n") < K.FIGURE_GATE_N) | (F.col("score") >= K.PASS_MARKS["figure_grounding"])
    return _metric(full, group, "figure_grounding", score, good, "n", "low")


def faithfulness(claims: DataFrame, verdicts: DataFrame, group: list[str], keys: list[str], sample: int | None = None) -> DataFrame:
    """Share of supported claims among the cited claims of each group, or its first ``sample``."""
    from attestra.operators.retrieve import top_n

    cited = claims.where(F.size("citations") > 0)
    first = cited if sample is None else top_n(cited, group, [F.col(k) for k in keys], sample)
    good = verdicts.where(F.col("status") == "supported").select(*keys, F.lit(1).alias("_ok")).distinct()
    agg = first.join(good, keys, "left").groupBy(*group).agg(F.count(F.lit(1)).alias("sampled"), F.count("_ok").alias("supported"))
    full = claims.select(*group).distinct().join(agg, group, "left").na.fill(0, ["sampled", "supported"])
    return _metric(full, group, "faithfulness", N.ratio(F.col("supported"), F.col("sampled"), 1.0), None, "sampled", "supported")


def prose_sentences(prose: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sentence_no, sentence): sentences of each text longer than 15 characters."""
    return prose.select(*keys, F.posexplode(T.sentences(F.col("text"))).alias("sentence_no", "sentence"))


def unsupported_sentences(runs: DataFrame, sentences: DataFrame, verdicts: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """One minus the share of unsupported or overreaching sentences; abstentions are exempt.

    runs: group, abstained; sentences: group and keys; verdicts: keys, status.
    """
    bad = verdicts.where(F.col("status").isin("unsupported", "overreach")).select(*keys, F.lit(1).alias("_bad")).distinct()
    agg = sentences.join(bad, keys, "left").groupBy(*group).agg(
        F.count(F.lit(1)).alias("sentences"), F.count("_bad").alias("unsupported")
    )
    full = runs.select(*group, "abstained").join(agg, group, "left").na.fill(0, ["sentences", "unsupported"])
    share = F.when(F.col("abstained"), F.lit(0.0)).otherwise(N.ratio(F.col("unsupported"), F.col("sentences"), 0.0))
    return _metric(full, group, "unsupported_sentence_ratio", 1 - share, share <= K.MAX_UNSUPPORTED, "sentences", "unsupported")


def probe_accuracy(probes: DataFrame, groups: DataFrame, group: list[str]) -> DataFrame:
    """Share of probes answered as expected; an overreach counts as supported."""
    got = F.when(F.col("got") == "overreach", "supported").otherwise(F.col("got"))
    agg = probes.groupBy(*group).agg(
        F.count(F.lit(1)).alias("probes"), F.count_if(F.coalesce(got == F.col("expected"), F.lit(False))).alias("correct")
    )
    full = groups.select(*group).distinct().join(agg, group, "left").na.fill(0, ["probes", "correct"])
    return _metric(full, group, "claim_probes", N.ratio(F.col("correct"), F.col("probes"), 1.0), None, "probes", "correct")


def scorecard(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("name").agg(F.avg("score").alias("mean"))


def regression(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Metric means against a baseline and absolute floors: (name, mean, baseline, tolerance,
    regressed, floor, below_floor), for the metrics that have a tolerance or a floor."""
    spark = current.sparkSession
    rules = spark.createDataFrame(K.REGRESSION_TOLERANCE, "name string, tolerance double").join(
        spark.createDataFrame(K.ABSOLUTE_FLOORS, "name string, floor double"), "name", "full"
    )
    joined = current.join(baseline.select("name", F.col("mean").alias("baseline")), "name", "left").join(
        F.broadcast(rules), "name"
    )
    return joined.select(
        "name", "mean", "baseline", "tolerance",
        F.coalesce(F.col("baseline") - F.col("mean") > F.col("tolerance"), F.lit(False)).alias("regressed"),
        "floor",
        F.coalesce(F.col("mean") < F.col("floor"), F.lit(False)).alias("below_floor"),
    )


def hard_failures(metrics: DataFrame) -> DataFrame:
    """Targets with a failing must-pass metric."""
    return metrics.where(F.col("name").isin(K.MUST_PASS) & ~F.col("pass")).select("target").distinct()


# --- Patent scores -----------------------------------------------------------------------


def extraction_recall(found: DataFrame, declared: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct extracted ids within 1..declared, as a share of the declared count."""
    inside = (
        found.join(declared, key)
        .where((F.col("seq_id") >= 1) & (F.col("seq_id") <= F.col("declared_count")))
        .select(key, "seq_id")
        .distinct()
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("found"))
    )
    full = declared.join(inside, key, "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return full.select(key, "declared_count", "found", N.ratio(F.col("found"), F.col("declared_count"), 1.0).alias("score"))


def residue_fidelity(known: DataFrame, extracted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Share of known sequences extracted letter by letter, case ignored."""
    got = extracted.select(key, "seq_id", F.upper("residues").alias("_got"))
    same = F.coalesce(F.col("_got") == F.upper("residues"), F.lit(False))
    return known.join(got, [key, "seq_id"], "left").groupBy(key).agg(
        F.count(F.lit(1)).alias("known"), F.count_if(same).alias("equal")
    ).withColumn("score", F.col("equal") / F.col("known"))


def set_recall(expected: DataFrame, got: DataFrame, group: list[str], column: str) -> DataFrame:
    """Share of expected names found; blanks and case do not matter."""
    have = got.select(*group, T.set_key(F.col(column)).alias("_k")).distinct().withColumn("_have", F.lit(1))
    return expected.withColumn("_k", T.set_key(F.col(column))).join(have, [*group, "_k"], "left").groupBy(*group).agg(
        F.count(F.lit(1)).alias("expected"), F.count("_have").alias("found")
    ).withColumn("score", F.col("found") / F.col("expected"))


def construct_accuracy(expected: DataFrame, got: DataFrame, key: str = "doc_id") -> DataFrame:
    """Species and pairing accuracy by heavy-domain id; the last construct of an id counts."""
    last = got.where(F.col("vh_seq_id").isNotNull()).groupBy(key, "vh_seq_id").agg(
        F.max_by(F.struct(F.col("vl_seq_id").alias("_vl"), F.col("species").alias("_sp")), "ord").alias("g")
    )
    joined = expected.join(last, [key, "vh_seq_id"], "left")
    found = F.col("g").isNotNull()
    return joined.groupBy(key).agg(
        F.avg((found & F.coalesce(F.col("g._sp") == F.col("species"), F.lit(False))).cast("double")).alias("species_accuracy"),
        F.avg((found & F.col("g._vl").eqNullSafe(F.col("vl_seq_id"))).cast("double")).alias("pairing_accuracy"),
    )


def got_overlaps(edges: DataFrame) -> DataFrame:
    """Competitor overlaps stated by graph edges: (doc_id, seq_id, accession, level)."""
    return edges.where(F.col("predicate") == "MATCHES").select(
        "doc_id",
        F.replace("subject", F.lit("SEQ:"), F.lit("")).cast("bigint").alias("seq_id"),
        F.col("object").alias("accession"),
        F.when(F.col("provenance") == "blast-cdr-h3", "cdr").otherwise("whole").alias("level"),
    )


def competitor_scores(expected: DataFrame, got: DataFrame, group: list[str]) -> DataFrame:
    """Recall and precision of competitor overlaps per group; 1 when a side is empty."""
    ids = [*group, "seq_id", "accession"]
    exp = expected.select(*ids).distinct().withColumn("_e", F.lit(1))
    hit = got.select(*ids).distinct().withColumn("_g", F.lit(1))
    recall = expected.join(hit, ids, "left").groupBy(*group).agg(F.avg(F.when(F.col("_g") == 1, 1.0).otherwise(0.0)).alias("recall"))
    precision = got.join(exp, ids, "left").groupBy(*group).agg(F.avg(F.when(F.col("_e") == 1, 1.0).otherwise(0.0)).alias("precision"))
    return recall.join(precision, group, "full").na.fill(1.0, ["recall", "precision"])


# --- Lift --------------------------------------------------------------------------------


def grounded_lift(probes: DataFrame) -> DataFrame:
    """Probe accuracy without and with evidence, per target, per expected answer and in all.

    probes: target, expected, grounded, closed. ``level`` names the grouping.
    """
    sure = lambda c: F.col(c).isin("supported", "refuted")
    g_ok, c_ok = F.col("grounded") == F.col("expected"), F.col("closed") == F.col("expected")
    sets = probes.groupingSets([[F.col("target")], [F.col("expected")], []], F.col("target"), F.col("expected"))
    agg = sets.agg(
        F.grouping_id().alias("_gid"),
        F.count(F.lit(1)).alias("probes"),
        F.count_if(g_ok).alias("grounded_correct"),
        F.count_if(c_ok).alias("closed_correct"),
        F.count_if(sure("grounded") & ~g_ok & sure("expected")).alias("hallucinations"),
        F.count_if((F.col("grounded") == "unsupported") & (F.col("expected") != "unsupported")).alias("abstentions"),
        F.count_if(g_ok & ~c_ok).alias("corrections"),
        F.count_if(c_ok & ~g_ok).alias("regressions"),
    )
    level = F.when(F.col("_gid") == 1, "target").when(F.col("_gid") == 2, "expected").otherwise("all")
    return agg.withColumn("level", level).withColumn(
        "delta", (F.col("grounded_correct") - F.col("closed_correct")) / F.col("probes")
    ).drop("_gid")


def recall_lift(baseline: DataFrame, hybrid: DataFrame) -> DataFrame:
    """Recall of two runs per target (target, gold, score), with the lift."""
    b = baseline.select("target", "gold", F.col("score").alias("baseline"))
    h = hybrid.select("target", F.col("score").alias("hybrid"))
    return b.join(h, "target").withColumn("lift", F.col("hybrid") - F.col("baseline"))


def mean_lift(lift: DataFrame) -> DataFrame:
    """Mean recalls over all targets and over those with gold ids."""
    both = lift.withColumn("scope", F.explode(F.array(F.lit("all"), F.when(F.col("gold") > 0, "with_gold"))))
    return both.where(F.col("scope").isNotNull()).groupBy("scope").agg(
        F.avg("baseline").alias("baseline"), F.avg("hybrid").alias("hybrid"), F.avg("lift").alias("lift")
    )
