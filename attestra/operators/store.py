"""Keyed evidence: upserts, source identity, references and contract checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra import constants as K
from attestra.functions import text as T


def _pick(df: DataFrame, keys: list[str], order: str, best) -> DataFrame:
    # Only keys, the order and a content hash are aggregated. The wide rows are then filtered on
    # all of them, which spreads the copies of one hot key over many partitions, and equal rows
    # collapse under the same partitioning.
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    rows = df.withColumn("_hash", F.xxhash64(*plain))
    winners = rows.groupBy(*keys).agg(best(F.struct(F.col(order).alias("o"), "_hash")).alias("_w"))
    winners = winners.select(*keys, F.col("_w.o").alias(order), "_w._hash")
    picked = [*keys, order, "_hash"]
    return rows.join(winners, picked, "left_semi").dropDuplicates(picked).drop("_hash")


def first_rows(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The earliest row per key; ties go to the smaller content hash."""
    return _pick(df, keys, order, F.min)


def last_rows(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The latest row per key; ties go to the larger content hash."""
    return _pick(df, keys, order, F.max)


def register(evidence: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """First-wins upsert: the first arrival of an id stays."""
    return first_rows(evidence, keys or ["id"])


def merge_last(first: DataFrame, second: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Last-wins upsert: rows of ``second`` replace rows of ``first``."""
    both = first.withColumn("_side", F.lit(0)).unionByName(
        second.withColumn("_side", F.lit(1)), allowMissingColumns=True
    )
    stamped = both.withColumn("_at", F.struct("_side", "ord"))
    return last_rows(stamped, keys or ["id"], "_at").drop("_side", "_at")


def pmcid_parents(evidence: DataFrame) -> DataFrame:
    """``(root, parent)``: the full-text root id and the publication that carries its PMCID."""
    papers = evidence.where(
        (F.col("kind") == "publication") & F.col("id").startswith("PMID:") & (F.length("pmcid") > 0)
    )
    root = F.concat(F.lit("PMCID:"), F.regexp_replace("pmcid", "^PMCID:", ""))
    return papers.groupBy(root.alias("root")).agg(F.max_by("id", "ord").alias("parent"))


def source_identity(ids: DataFrame, evidence: DataFrame, computations: DataFrame | None = None) -> DataFrame:
    """``(id, source_identity)`` for every distinct id in ``ids``.

    ``evidence`` must hold one row per id. Passages and figures resolve to their parent
    publication, computations to their sorted dataset releases
    (``computations``: evidence id, logical_source_id).
    """
    wanted = ids.select("id").distinct().withColumn("root", T.base_id("id"))
    out = (
        wanted.join(evidence.select("id", "kind"), "id", "left")
        .join(pmcid_parents(evidence), "root", "left")
        .withColumn(
            "source_identity",
            F.when(F.col("kind").isNull(), F.col("root"))
            .when(F.col("kind").isin("publication", "figure"), F.coalesce("parent", "root"))
            .otherwise(F.col("id")),
        )
    )
    if computations is not None:
        # Datasets per computation are few by contract (one manifest row each).
        releases = computations.groupBy("id").agg(
            F.concat(
                F.lit("dataset-release:"),
                F.array_join(F.sort_array(F.collect_set("logical_source_id")), "+"),
            ).alias("release")
        )
        out = out.join(releases, "id", "left").withColumn(
            "source_identity",
            F.when(F.col("kind") == "computation", F.col("release")).otherwise(F.col("source_identity")),
        )
    return out.select("id", "source_identity")


def cited_ids(*claim_tables: DataFrame) -> DataFrame:
    """Distinct ids cited by any claim of the given tables."""
    parts = [t.select(F.explode("citations").alias("id")) for t in claim_tables]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def references(evidence: DataFrame, cited: DataFrame, width: int | None = None) -> DataFrame:
    """One reference per cited source, titled by source type, earliest evidence first; snippets are
    whole, or ``width`` characters if given."""
    rows = evidence.join(cited.select("id"), "id", "left_semi").withColumn("base", T.base_id("id"))
    rows = first_rows(rows, ["base"])
    title = F.col("title")
    for prefix, label in reversed(K.REFERENCE_LABELS):
        title = F.when(F.col("base").startswith(prefix), F.lit(label)).otherwise(title)
    is_run = F.col("kind") == "computation"
    snippet = F.when(~is_run & (F.length("snippet") > 0), F.col("snippet") if width is None else F.substring("snippet", 1, width))
    return rows.select(
        F.when(is_run, F.col("id")).otherwise(F.col("base")).alias("id"),
        "kind",
        "source",
        F.when(is_run, F.col("title")).otherwise(title).alias("title"),
        F.when(is_run, F.col("url")).otherwise(T.base_id("url")).alias("url"),
        snippet.alias("snippet"),
        F.when(F.col("kind").isin(K.CURATED_KINDS), F.col("raw")).alias("raw"),
    ).orderBy("id")


def cited_publications(evidence: DataFrame, cited: DataFrame) -> DataFrame:
    """The first publication per cited source; both sides compare without locator."""
    bases = cited.select(T.base_id("id").alias("base")).distinct()
    rows = evidence.where(F.col("kind") == "publication").withColumn("base", T.base_id("id"))
    return first_rows(rows.join(bases, "base", "left_semi"), ["base"])


def doi_check(publications: DataFrame, registry: DataFrame) -> DataFrame:
    """Compare publications with a DOI registry (doi, reg_title, reg_journal, reg_year).

    Of several registry rows of one doi the least counts. Journal and year of a found row win.
    """
    one = registry.groupBy("doi").agg(F.min(F.struct("reg_title", "reg_journal", "reg_year")).alias("r"))
    found = one.select("doi", "r.*", F.lit(True).alias("_found"))
    has_doi = F.coalesce(F.length("doi") > 0, F.lit(False))
    hit = has_doi & F.coalesce("_found", F.lit(False))
    same = T.titles_match(F.col("title"), F.col("reg_title"))
    return (
        publications.join(found, "doi", "left")
        .withColumn("verified", hit & same)
        .withColumn(
            "note",
            F.when(~has_doi, "no doi")
            .when(~hit, "doi not found on crossref")
            .when(~same, "title mismatch"),
        )
        .withColumn("journal", F.coalesce(F.when(hit, F.col("reg_journal")), F.col("journal")))
        .withColumn("year", F.coalesce(F.when(hit, F.col("reg_year")), F.col("year")))
        .drop("_found", "reg_title", "reg_journal", "reg_year")
    )


def evidence_line(text: Column | None = None) -> Column:
    """``[id] (locator) title - text``."""
    where = F.when(F.length("locator") > 0, F.concat(F.lit(" ("), F.col("locator"), F.lit(")"))).otherwise("")
    body = F.coalesce("passage", "snippet") if text is None else text
    return F.concat(F.lit("["), F.col("id"), F.lit("]"), where, F.lit(" "), F.col("title"), F.lit(" - "), body)


def evidence_context(questions: DataFrame, evidence: DataFrame, hits: DataFrame) -> DataFrame:
    """Context lines: a run's curated records once, for all its questions, and each question's hits.

    ``questions``: question_id, run_id; ``evidence``: registered rows with run_id;
    ``hits``: question_id, id, rank. A question's context is the lines of its run without a
    question, block 0, then its own, block 1, in the order of pos: rows grow with the
    evidence and the hits, never with their product.
    """
    asked = questions.select("run_id").distinct()
    curated = (
        evidence.where(F.col("kind").isin(K.CURATED_KINDS))
        .join(asked, "run_id", "left_semi")
        .select(
            "run_id", F.lit(None).cast(questions.schema["question_id"].dataType).alias("question_id"), F.lit(0).alias("block"),
            F.col("ord").cast("long").alias("pos"), "id", evidence_line().alias("line"),
        )
    )
    first_hit = hits.groupBy("question_id", "id").agg(F.min("rank").alias("pos"))
    literature = (
        first_hit.join(questions.select("question_id", "run_id"), "question_id")
        .join(evidence.where(~F.col("kind").isin(K.CURATED_KINDS)), ["run_id", "id"])
        .select("run_id", "question_id", F.lit(1).alias("block"), F.col("pos").cast("long"), "id", evidence_line().alias("line"))
    )
    return curated.unionByName(literature)


def migrate_sections(sections: DataFrame) -> DataFrame:
    """Sections stored before the kind field existed are research sections."""
    if "kind" not in sections.columns:
        return sections.withColumn("kind", F.lit("research"))
    return sections.withColumn("kind", F.coalesce("kind", F.lit("research")))


def reasons(*rules: tuple[Column, str]) -> Column:
    """Array of the reasons whose rule is true."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(why)) for bad, why in rules]))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)`` by the ``reasons`` column."""
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)


def check_results(results: DataFrame) -> DataFrame:
    """Add ``reasons`` to a long typed-result table: row rules and series rules."""
    is_series = F.col("type") == "grouped-series"
    is_group = F.col("group_key").isNotNull()
    series = results.where(is_group).groupBy("computation_id", "result_key", "group_key").agg(
        F.count(F.lit(1)).alias("_copies")
    )
    headers = results.where(is_series).select(
        "computation_id", "result_key", F.col("unit").alias("_series_unit"), F.lit(True).alias("_has_header")
    )
    groups = (
        results.where(is_group)
        .select("computation_id", "result_key", F.lit(True).alias("_has_groups"))
        .distinct()
    )
    joined = (
        results.join(series, ["computation_id", "result_key", "group_key"], "left")
        .join(headers, ["computation_id", "result_key"], "left")
        .join(groups, ["computation_id", "result_key"], "left")
    )
    value, nullable = F.col("value"), F.col("nullable")
    rules = [
        (F.col("missing_n") + F.col("observed_n") != F.col("total_n"), "missingness does not add up"),
        (~F.col("fraction").between(0, 1), "missing fraction outside 0..1"),
        (~is_series & value.isNull() & (~nullable | (F.col("sample_n") != 0)), "null value without nullable and sample 0"),
        (value.isNotNull() & nullable, "numeric value marked nullable"),
        (is_series & (value.isNotNull() | nullable), "series header carries a value"),
        (is_series & F.col("_has_groups").isNull(), "series without groups"),
        (F.coalesce(F.col("_copies") > 1, F.lit(False)), "duplicate group key"),
        (is_group & F.col("_has_header").isNotNull() & (F.col("unit") != F.col("_series_unit")), "group unit differs from series"),
        (is_group & F.col("_has_header").isNull(), "group without series"),
        (~F.col("result_key").rlike(K.RESULT_KEY_PATTERN), "invalid result key"),
        (F.length("unit") == 0, "blank unit"),
        (~F.col("precision").between(0, 12), "precision outside 0..12"),
        (F.col("tolerance") < 0, "negative tolerance"),
        (~F.col("comparator").isin("lt", "lte", "eq", "gte", "gt", "none"), "unknown comparator"),
        (~F.col("direction").isin("lower", "higher", "neutral", "not_applicable"), "unknown direction"),
    ]
    return joined.withColumn("reasons", reasons(*rules)).drop("_copies", "_series_unit", "_has_header", "_has_groups")


def check_warnings(warnings: DataFrame) -> DataFrame:
    """Computations whose warnings repeat: (computation_id, warning, copies)."""
    return (
        warnings.groupBy("computation_id", "warning")
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
    )


def check_computations(computations: DataFrame, results: DataFrame) -> DataFrame:
    """Add ``reasons`` to computation evidence from its recomputed hashes and its results.

    Needs ``manifest_sha``, ``code_bytes``, ``results_sha``, ``lineage`` (array of
    declared/actual hash pairs) beside the declared values, and ``result_keys``.
    """
    keys = computations.select("computation_id", F.explode("result_keys").alias("binding"))
    from attestra.operators.analysis import resolve_binding

    unresolved = (
        resolve_binding(keys, results)
        .where(F.col("type").isNull())
        .groupBy("computation_id")
        .agg(F.count(F.lit(1)).alias("_unresolved"))
    )
    joined = computations.join(unresolved, "computation_id", "left")
    lineage_bad = F.exists("lineage", lambda x: x["declared"] != x["actual"])
    rules = [
        (F.col("manifest_sha") != F.col("computation_id"), "computation id does not match its manifest"),
        (F.sha2("code_bytes", 256) != F.col("code_hash"), "code hash does not match the code"),
        (F.col("results_sha") != F.col("results_hash"), "results hash does not match the results"),
        (F.coalesce(lineage_bad, F.lit(False)), "lineage manifest hash mismatch"),
        (F.col("_unresolved") > 0, "unknown result binding"),
    ]
    return joined.withColumn("reasons", reasons(*rules)).drop("_unresolved")
