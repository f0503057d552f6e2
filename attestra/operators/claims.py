"""Claims: grounding, verification inputs, ratings, flags, grades and posture.

A claim is keyed by (section_id, ord). Its own ``id`` restarts in every drafting round, so
it never serves as a join key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra import constants as K
from attestra.functions import numbers as N
from attestra.operators.store import evidence_line

KEY = ["section_id", "ord"]


def citations(claims: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Claims as (key, pos, id) rows, without their text."""
    return claims.select(*keys, F.posexplode("citations").alias("pos", "id"))


def ground(claims: DataFrame, evidence: DataFrame, keys: list[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """``(shipped, stripped with reason)``: every cited id must exist.

    Only ids are shuffled; claim text joins a table of the claims that fail.
    """
    missing = citations(claims, keys).join(evidence.select("id").distinct(), "id", "left_anti")
    # Bounded by the citations of one claim.
    why = missing.groupBy(*keys).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]), ", "
        ).alias("_missing")
    )
    checked = claims.join(why, keys, "left").withColumn(
        "reason",
        F.when(F.size("citations") == 0, "no citation").when(
            F.col("_missing").isNotNull(), F.concat(F.lit("citation does not resolve: "), F.col("_missing"))
        ),
    ).drop("_missing")
    return checked.where(F.col("reason").isNull()).drop("reason"), checked.where(F.col("reason").isNotNull())


def verify_inputs(claims: DataFrame, evidence: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Claim text with its cited evidence lines, in citation order; unknown ids are skipped."""
    text = F.when(F.col("kind") == "computation", F.col("raw")).otherwise(F.coalesce("passage", "snippet"))
    lines = citations(claims, keys).join(evidence.drop("ord"), "id").select(*keys, "pos", evidence_line(text).alias("line"))
    joined = lines.groupBy(*keys).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n"
        ).alias("evidence_text")
    )
    return claims.join(joined, keys, "left").select(
        *keys, "text", F.coalesce("evidence_text", F.lit("")).alias("evidence_text")
    )


def supported(claims: DataFrame, verdicts: DataFrame, keys: list[str] = KEY) -> DataFrame:
    good = verdicts.where(F.col("status") == "supported").select(*keys).distinct()
    return claims.join(good, keys, "left_semi")


def section_sources(claims: DataFrame) -> DataFrame:
    """Distinct cited ids per section as rows, ordered by first use (ord, pos)."""
    first = citations(claims).groupBy("section_id", "id").agg(F.min(F.struct("ord", "pos")).alias("f"))
    return first.select("section_id", "id", F.col("f.ord").alias("first_ord"), F.col("f.pos").alias("first_pos"))


def count_identities(claims: DataFrame, identities: DataFrame) -> DataFrame:
    """Distinct source identities per section; (section, identity) pairs are reduced first."""
    pairs = (
        claims.select("section_id", F.explode("citations").alias("id"))
        .distinct()
        .join(identities, "id")
        .select("section_id", "source_identity")
        .distinct()
    )
    return pairs.groupBy("section_id").agg(F.count(F.lit(1)).alias("n_sources"))


def rate_sections(sections: DataFrame, shipped: DataFrame, verdicts: DataFrame, identities: DataFrame) -> DataFrame:
    """Red, amber or green per section.

    Red without supported claims; green when every shipped claim is supported and at least
    two independent sources stand behind them; amber otherwise.
    """
    good = supported(shipped, verdicts)
    counts = shipped.groupBy("section_id").agg(F.count(F.lit(1)).alias("n_shipped"))
    kept = good.groupBy("section_id").agg(F.count(F.lit(1)).alias("n_supported"))
    out = (
        sections.select("section_id")
        .join(counts, "section_id", "left")
        .join(kept, "section_id", "left")
        .join(count_identities(good, identities), "section_id", "left")
        .na.fill(0, ["n_shipped", "n_supported", "n_sources"])
    )
    return out.withColumn(
        "rating",
        F.when(F.col("n_supported") == 0, "red")
        .when((F.col("n_supported") == F.col("n_shipped")) & (F.col("n_sources") >= 2), "green")
        .otherwise("amber"),
    )


def card_claims(evidence: DataFrame) -> DataFrame:
    """Claims stated by curated records, routed to the section that owns the question."""
    section = F.lit(None).cast("string")
    for suffix, name in K.CARD_ROUTES:
        section = F.when(F.col("id").endswith(suffix), F.lit(name)).otherwise(section)
    text = F.trim(F.coalesce("snippet", "title"))
    return (
        evidence.where(F.col("source").isin(K.CARD_SOURCES))
        .withColumn("section_id", section)
        .withColumn("_text", text)
        .where(F.col("section_id").isNotNull() & (F.length("_text") > 0))
        .select(
            "section_id",
            "ord",
            F.concat(F.lit("struct-"), F.col("ord")).alias("id"),
            F.concat("_text", F.lit(" ("), F.col("source"), F.lit(")")).alias("text"),
            F.array("id").alias("citations"),
            F.lit(K.CARD_CONFIDENCE).alias("confidence"),
        )
    )


def prepend(claims: DataFrame, cards: DataFrame, sections: DataFrame) -> DataFrame:
    """Claims with the card claims in front; texts a section already has are skipped.

    ``block`` 0 marks card claims, 1 the section's own; order by (block, ord).
    """
    fresh = cards.join(sections.select("section_id"), "section_id", "left_semi").join(
        claims.select("section_id", "text"), ["section_id", "text"], "left_anti"
    )
    return fresh.withColumn("block", F.lit(0)).unionByName(
        claims.withColumn("block", F.lit(1)), allowMissingColumns=True
    )


def claim_flags(claims: DataFrame, audits: DataFrame) -> DataFrame:
    """Red flags a claim inherits from audits of the papers it cites, one row per flag.

    audits: section_id, audit_ord, ids (paper and its passages), red_flags.
    """
    cited = claims.select(*KEY, F.explode("citations").alias("id")).distinct()
    covered = audits.select("section_id", "audit_ord", F.explode("ids").alias("id")).distinct()
    met = cited.join(covered, ["section_id", "id"]).select(*KEY, "audit_ord").distinct()
    flags = audits.select("section_id", "audit_ord", F.posexplode("red_flags").alias("flag_pos", "flag"))
    return met.join(flags, ["section_id", "audit_ord"]).select(*KEY, "audit_ord", "flag_pos", "flag.*")


def grade(critiques: DataFrame) -> DataFrame:
    """Evidence level: the study design's, lowered by bias and small samples, not below very low."""
    base = F.create_map(*[F.lit(x) for kv in K.GRADE_BASE.items() for x in kv])
    flags = F.coalesce("red_flags", F.array().cast("array<struct<category:string,bias_risk:string,explanation:string>>"))
    high = F.exists(flags, lambda f: f["bias_risk"] == "high").cast("int")
    moderate = (F.size(F.filter(flags, lambda f: f["bias_risk"] == "moderate")) >= 2).cast("int")
    small = F.coalesce((F.col("sample_size") < K.SMALL_SAMPLE).cast("int"), F.lit(0))
    index = F.greatest(F.lit(0), base[F.col("study_design")] - high - moderate - small)
    return critiques.withColumn("level", index).withColumn("evidence_level", F.get(levels(), index))


def levels() -> Column:
    return F.array(*[F.lit(v) for v in K.GRADE_LEVELS])


def best_grade(claims: DataFrame, graded: DataFrame) -> DataFrame:
    """Best level over a claim's citations, ``ungraded`` without any; last critique per id wins."""
    last = graded.where(F.col("level").isNotNull()).groupBy(F.col("evidence_id").alias("id")).agg(
        F.max_by("level", "ord").alias("level")
    )
    best = citations(claims).join(last, "id").groupBy(*KEY).agg(F.max("level").alias("level"))
    return claims.join(best, KEY, "left").withColumn(
        "best_grade", F.coalesce(F.get(levels(), F.col("level")), F.lit("ungraded"))
    ).drop("level")


def valid_contradictions(flags: DataFrame, evidence: DataFrame) -> DataFrame:
    """Contradictions between two different, known evidence ids."""
    ids = evidence.select("id").distinct()
    return (
        flags.where(F.col("id_a") != F.col("id_b"))
        .join(ids.withColumnRenamed("id", "id_a"), "id_a", "left_semi")
        .join(ids.withColumnRenamed("id", "id_b"), "id_b", "left_semi")
    )


def ground_risks(risks: DataFrame, evidence: DataFrame) -> DataFrame:
    return risks.join(evidence.select(F.col("id").alias("evidence_id")), "evidence_id", "left_semi")


def posture(runs: DataFrame, claims: DataFrame, risks: DataFrame) -> DataFrame:
    """Final label per run (runs: run_id, proposed).

    Fewer than two supported claims: insufficient evidence. Any severe risk: no-go.
    """
    counts = claims.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_supported"))
    severe = risks.where(F.col("severity") == "severe").select("run_id", F.lit(True).alias("_severe")).distinct()
    return (
        runs.join(counts, "run_id", "left")
        .join(severe, "run_id", "left")
        .withColumn("n_supported", F.coalesce("n_supported", F.lit(0)))
        .withColumn(
            "verdict",
            F.when(F.col("n_supported") < K.MIN_SUPPORTED, "insufficient-evidence")
            .when(F.col("_severe"), "no-go")
            .otherwise(F.col("proposed")),
        )
        .drop("_severe")
    )


def clean_points(points: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Keep only known citation ids of each point, in order; a point may end up with none."""
    kept = points.select(*keys, F.posexplode("citations").alias("pos", "id")).join(
        known.select("id").distinct(), "id", "left_semi"
    )
    regrouped = kept.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("_kept")
    )
    return (
        points.join(regrouped, keys, "left")
        .withColumn("citations", F.coalesce("_kept", F.array().cast("array<string>")))
        .drop("_kept")
    )


def merge_gaps(
    sections: DataFrame, claims: DataFrame, gap_claims: DataFrame, identities: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """``(sections with ratings, claims)`` after supported gap claims joined their section.

    Gap claims of unknown sections are dropped. A section that gains claims is rated again
    with all of its claims taken as supported; the others keep their rating.
    """
    gained = gap_claims.join(sections.select("section_id"), "section_id", "left_semi")
    merged = claims.withColumn("block", F.lit(0)).unionByName(gained.withColumn("block", F.lit(1)))
    grew = gained.select("section_id", F.lit(True).alias("_grew")).distinct()
    rated = (
        sections.join(grew, "section_id", "left")
        .join(count_identities(merged, identities).withColumnRenamed("n_sources", "_sources"), "section_id", "left")
        .withColumn(
            "rating",
            F.when(F.col("_grew"), F.when(F.col("_sources") >= 2, "green").otherwise("amber")).otherwise(F.col("rating")),
        )
        .drop("_grew", "_sources")
    )
    return rated, merged


def clamp_confidence(claims: DataFrame) -> DataFrame:
    return claims.withColumn("confidence", N.clamp_confidence(F.col("confidence")))


def digest_lines(
    sections: DataFrame, claims: DataFrame, flags: DataFrame, risks: DataFrame, contradictions: DataFrame
) -> DataFrame:
    """A run's findings as ordered lines (run_id, block, sort, line).

    sections: run_id, section_id, ord, title, rating, takeaway; claims and flags keyed as
    above; risks and contradictions carry run_id and ord. Order by (block, sort).
    """
    noted = flags.where(F.col("bias_risk").isin("moderate", "high")).groupBy(*KEY).agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("audit_ord", "flag_pos", "bias_risk", "category", "explanation"))),
                lambda f: F.concat(f["bias_risk"], F.lit(" "), f["category"], F.lit(" - "), f["explanation"]),
            ),
            "; ",
        ).alias("_note")
    )
    cites = F.array_join(F.transform("citations", lambda c: F.concat(F.lit("["), c, F.lit("]"))), " ")
    note = F.when(F.col("_note").isNotNull(), F.concat(F.lit(" (AUDIT: "), F.col("_note"), F.lit(")"))).otherwise("")
    place = sections.select("run_id", "section_id", F.col("ord").alias("_section"))
    head = sections.select(
        "run_id",
        F.lit(0).alias("block"),
        F.struct(F.col("ord").alias("a"), F.lit(0).alias("b"), F.lit(0).cast("long").alias("c")).alias("sort"),
        F.concat(F.lit("## "), "title", F.lit(" ["), "rating", F.lit("]\n"), "takeaway").alias("line"),
    )
    body = (
        claims.join(noted, KEY, "left")
        .join(place, "section_id")
        .select(
            "run_id",
            F.lit(0).alias("block"),
            F.struct(F.col("_section").alias("a"), F.lit(1).alias("b"), F.col("ord").cast("long").alias("c")).alias("sort"),
            F.concat(F.lit("- "), "text", F.lit(" "), cites, note).alias("line"),
        )
    )
    flat = lambda: F.struct(F.col("ord").alias("a"), F.lit(0).alias("b"), F.lit(0).cast("long").alias("c")).alias("sort")
    risky = risks.where(F.col("severity") != "manageable").select(
        "run_id",
        F.lit(1).alias("block"),
        flat(),
        F.concat(F.lit("- "), "severity", F.lit(" "), "category", F.lit(" ["), "evidence_id", F.lit("] - "), "explanation").alias("line"),
    )
    clash = contradictions.select(
        "run_id",
        F.lit(2).alias("block"),
        flat(),
        F.concat(F.lit("- "), "endpoint", F.lit(": "), "explanation", F.lit(" ["), "id_a", F.lit("] vs ["), "id_b", F.lit("]")).alias("line"),
    )
    return head.unionByName(body).unionByName(risky).unionByName(clash)


def rank_labs(evidence: DataFrame, k: int = K.LABS_KEPT) -> DataFrame:
    """Top labs per target: the last author leads the lab, deep-read papers weigh more.

    evidence: target, id, pmcid, last_author, affiliation, one row per (target, id).
    """
    lab = ["target", F.col("last_author").alias("investigator")]
    papers = evidence.where(F.length("last_author") > 0)
    full = (
        evidence.where(F.col("id").startswith("PMCID:") & (F.length("pmcid") > 0))
        .select("target", "pmcid")
        .distinct()
    )
    deep = papers.where(F.length("pmcid") > 0).join(full, ["target", "pmcid"], "left_semi")
    # Papers without a PMCID never enter the join, so a blank key cannot skew it.
    marks = papers.select(*lab, F.lit(1).alias("n"), F.lit(K.ABSTRACT_WEIGHT).alias("w")).unionByName(
        deep.select(*lab, F.lit(0).alias("n"), F.lit(K.FULLTEXT_WEIGHT - K.ABSTRACT_WEIGHT).alias("w"))
    )
    totals = marks.groupBy("target", "investigator").agg(
        F.sum("n").alias("paper_count"), F.sum("w").alias("weight")
    )
    homes = (
        papers.where(F.length("affiliation") > 0)
        .groupBy(*lab, "affiliation")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("target", "investigator")
        .agg(F.min_by("affiliation", F.struct(-F.col("_n"), F.col("affiliation"))).alias("institution"))
    )
    from attestra.operators.retrieve import top_n

    order = [F.col("weight").desc(), F.col("paper_count").desc(), F.col("investigator")]
    return top_n(totals, ["target"], order, k).join(homes, ["target", "investigator"], "left")


def lab_evidence(labs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence ids behind each ranked lab, one row each, in arrival order."""
    rows = evidence.select("target", F.col("last_author").alias("investigator"), "id", "ord")
    return rows.join(labs.select("target", "investigator"), ["target", "investigator"], "left_semi")
