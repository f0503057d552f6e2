"""Descriptive analysis of frozen tables: contracts, missingness, typed results, replay.

Typed results are a long table, one row per scalar, series header (``grouped-series``) or
series point: computation_id, result_key, group_key, pos, type, value, unit, comparator,
threshold, direction, precision, tolerance, missing_n, observed_n, total_n, fraction,
sample_n, nullable, note.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra import constants as K
from attestra.functions import numbers as N
from attestra.functions.aggregates import percentiles
from attestra.functions.numbers import fixed
from attestra.operators.store import last_rows
from attestra.session import cut_lineage


class ContractError(ValueError):
    """The input breaks a fatal rule."""


# --- Input contracts ---------------------------------------------------------------------


def require_columns(df: DataFrame, expected: set[str], label: str) -> DataFrame:
    if set(df.columns) != set(expected):
        raise ContractError(f"{label}: expected columns {sorted(expected)}, got {sorted(df.columns)}")
    return df


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that are blank or occur more than once, with their count."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
    blank = F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")
    return counts.where(blank | (F.col("copies") > 1))


def require_unique(df: DataFrame, key: str, label: str) -> DataFrame:
    bad = [r[0] for r in duplicate_keys(df, key).limit(10).collect()]
    if bad:
        raise ContractError(f"{label}.{key} is blank or repeated: {bad}")
    return df


def require_none(bad: DataFrame, label: str) -> None:
    rows = bad.limit(5).collect()
    if rows:
        raise ContractError(f"{label}: {[r.asDict() for r in rows]}")


def parse_measure(df: DataFrame, column: str) -> DataFrame:
    """Text measure as a double; ``<column>_bad`` marks text that is no finite number."""
    text = F.col(column).cast("string")
    return df.withColumn(f"{column}_bad", N.bad_measure(text)).withColumn(column, N.parse_measure(text))


def require_measure(df: DataFrame, column: str, label: str) -> DataFrame:
    parsed = parse_measure(df, column)
    require_none(df.where(N.bad_measure(F.col(column).cast("string"))).select(column), f"{label}.{column} is not a number")
    return parsed.drop(f"{column}_bad")


def domain_reasons(negative: str | None = None, sample_class: str | None = None, fixed: dict[str, str] | None = None) -> Column:
    """Reasons a row breaks the domain rules of its table."""
    rules = []
    if negative:
        rules.append((F.coalesce(F.col(negative) < 0, F.lit(False)), f"negative {negative}"))
    if sample_class:
        known = F.lower(F.coalesce(F.col(sample_class), F.lit("unknown"))).isin("tumor", "normal", "unknown")
        rules.append((~known, f"unreviewed {sample_class}"))
    for column, value in (fixed or {}).items():
        rules.append((F.coalesce(F.col(column) != value, F.lit(False)), f"{column} differs from the reviewed cohort"))
    return F.array_compact(F.array(*[F.when(bad, F.lit(why)) for bad, why in rules]))


def lineage_label(col: Column) -> Column:
    """Trimmed lineage; a blank one is Unknown."""
    text = F.trim(F.coalesce(col, F.lit("")))
    return F.when(text == "", "Unknown").otherwise(text)


def class_of_sample(sample_type: Column) -> Column:
    return (
        F.when(sample_type.isin(K.TUMOR_SAMPLE_TYPES), "tumor")
        .when(sample_type.isin(K.NORMAL_SAMPLE_TYPES), "normal")
        .otherwise("unknown")
    )


def join_effects(models: DataFrame, effects: DataFrame) -> DataFrame:
    """Model metadata with its effect; models without one keep a blank (missing) effect.

    Both tables must be unique by model_id (see ``require_unique``).
    """
    joined = models.join(effects.select("model_id", "gene_effect"), "model_id", "left")
    return joined.withColumn("gene_effect", F.coalesce(F.col("gene_effect").cast("string"), F.lit("")))


# --- Summaries ---------------------------------------------------------------------------


def missing_columns(value: Column) -> list[Column]:
    """Aggregates: missing_n, observed_n, total_n and the missing fraction to 8 places."""
    total, observed = F.count(F.lit(1)), F.count(value)
    return [
        (total - observed).alias("missing_n"),
        observed.alias("observed_n"),
        total.alias("total_n"),
        F.coalesce(F.round(F.try_divide(total - observed, total), 8), F.lit(0.0)).alias("fraction"),
    ]


def missingness(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or [])).agg(*missing_columns(F.col(value)))


def threshold_summary(df: DataFrame, value: str, cutoff: float = K.DEPENDENCY_CUTOFF) -> DataFrame:
    """Median, count at or below the cutoff and their share of the observed values."""
    low = F.col(value) <= cutoff
    counts = df.agg(
        F.count_if(low).alias("at_or_below_n"),
        F.avg(low.cast("double")).alias("at_or_below_fraction"),
        *missing_columns(F.col(value)),
    )
    return counts.withColumn("median", percentiles(df, [], value, {"median": 0.5}).scalar())


def median_by_group(df: DataFrame, group: str, value: str, min_n: int = K.LINEAGE_MIN_N) -> DataFrame:
    """Median of each group with at least ``min_n`` observed values, with its missingness."""
    stats = missingness(df, value, [group]).where(F.col("observed_n") >= min_n)
    return stats.join(percentiles(df, [group], value, {"median": 0.5}), group)


def quartiles_by_class(df: DataFrame, column: str, value: str, classes: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(quartiles, warnings)``; a class without values keeps a null row and a warning.

    Rows of other classes are left out and counted in a warning.
    """
    spark = df.sparkSession
    wanted = spark.createDataFrame([(c, i) for i, c in enumerate(classes)], f"{column} string, pos int")
    known = df.where(F.col(column).isin(classes))
    table = (
        wanted.join(missingness(known, value, [column]), column, "left")
        .join(percentiles(known, [column], value, {"q1": 0.25, "median": 0.5, "q3": 0.75}), column, "left")
        .na.fill(0, ["missing_n", "observed_n", "total_n", "fraction"])
    )
    absent = table.where(F.col("observed_n") == 0).select(
        F.concat(F.lit("no observed values for class "), F.col(column)).alias("warning")
    )
    other = df.where(~F.coalesce(F.col(column).isin(classes), F.lit(False))).agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    left_out = other.select(F.concat(F.col("n").cast("string"), F.lit(" rows of other classes left out")).alias("warning"))
    return table, absent.unionByName(left_out)


def series_and_max(df: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """The values as they are, and their maximum."""
    return df.select(key, value), df.agg(F.max(value).alias("maximum"), *missing_columns(F.col(value)))


def histogram(df: DataFrame, value: str) -> DataFrame:
    """Equal-width bins, empty ones included; between 10 and 40 bins, by the root of n."""
    v = F.col(value)
    span = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n")).withColumn(
        "bins", F.least(F.lit(40), F.greatest(F.lit(10), F.floor(F.sqrt("n")).cast("int")))
    )
    rows = df.where(v.isNotNull()).select(v.alias("_v"), span.select(F.struct("*")).scalar().alias("_s")).select(
        "_v", "_s.*"
    )
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    inside = F.least(F.col("bins") - 1, F.floor((F.col("_v") - F.col("lo")) / width).cast("int"))
    counts = (
        rows.select(F.when(F.col("hi") > F.col("lo"), inside).otherwise(F.lit(0)).alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    frame = span.select(
        "lo", width.alias("width"), F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin")
    )
    return frame.join(counts, "bin", "left").select(
        "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("low"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


# --- Typed results -----------------------------------------------------------------------

RESULT_COLUMNS = [
    "computation_id", "result_key", "group_key", "pos", "type", "value", "unit", "comparator", "threshold",
    "direction", "precision", "tolerance", "missing_n", "observed_n", "total_n", "fraction", "sample_n",
    "nullable", "note",
]


def typed_rows(
    df: DataFrame,
    key: str,
    value: Column | None,
    unit: str,
    precision: int,
    tolerance: float,
    group: str | None = None,
    kind: str = "scalar",
    comparator: str = "none",
    threshold: float | None = None,
    direction: str = "not_applicable",
    note: str | None = None,
    pos: Column | None = None,
) -> DataFrame:
    """Typed result rows from a summary that carries computation_id and missingness.

    A null value is allowed only without observations, where the row is nullable.
    """
    number = F.lit(None).cast("double") if value is None else F.bround(value.cast("double"), precision)
    header = kind == "grouped-series"
    empty = F.lit(False) if header else number.isNull()
    checked = number
    if not header:
        checked = F.when(
            number.isNull() & (F.col("observed_n") != 0), F.raise_error(F.lit(f"{key}: null value with observations"))
        ).otherwise(number)
    return df.select(
        "computation_id",
        F.lit(key).alias("result_key"),
        (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("group_key"),
        (F.lit(0) if pos is None else pos).cast("long").alias("pos"),
        F.lit(kind).alias("type"),
        checked.alias("value"),
        F.lit(unit).alias("unit"),
        F.lit(comparator).alias("comparator"),
        F.lit(threshold).cast("double").alias("threshold"),
        F.lit(direction).alias("direction"),
        F.lit(precision).alias("precision"),
        F.lit(float(tolerance)).alias("tolerance"),
        "missing_n",
        "observed_n",
        "total_n",
        "fraction",
        F.col("observed_n").alias("sample_n"),
        empty.alias("nullable"),
        F.lit(note).cast("string").alias("note"),
    )


def resolve_binding(bindings: DataFrame, results: DataFrame) -> DataFrame:
    """Join (computation_id, binding) to its scalar: ``key`` or ``series::group``.

    The text after the last ``::`` names the group, so a group name that holds ``::`` cannot
    be addressed. Result keys must be valid (see ``check_results``). Unresolved bindings
    keep null result columns.
    """
    fields = [c for c in results.columns if c not in ("computation_id", "result_key", "group_key", "pos")]
    named = _scalars(results).select(F.col("computation_id"), F.col("result_key").alias("_key"), F.coalesce("group_key", F.lit("")).alias("_group"), *fields)
    key, group = _binding_parts(F.col("binding"))
    split = bindings.withColumn("_key", key).withColumn("_group", group)
    return split.join(named, ["computation_id", "_key", "_group"], "left").select(*bindings.columns, *fields)


def _scalars(results: DataFrame) -> DataFrame:
    return results.where((F.col("type") == "scalar") & ~F.coalesce(F.contains("group_key", F.lit("::")), F.lit(False)))


def _binding_parts(binding: Column) -> tuple[Column, Column]:
    parts = F.regexp_extract(binding, r"(?s)^(.*)::(.*)\z", 1), F.regexp_extract(binding, r"(?s)^(.*)::(.*)\z", 2)
    grouped = F.contains(binding, F.lit("::"))
    return F.when(grouped, parts[0]).otherwise(binding), F.when(grouped, parts[1]).otherwise("")


def with_bound_values(claims: DataFrame, results: DataFrame) -> DataFrame:
    """Claims with ``_cid`` and ``_key`` of their binding and ``_value``, ``_unit``, ``_tol`` of the scalar it names.

    Claims look their scalar up themselves, in one join: the same as ``resolve_binding`` on distinct bindings.
    """
    named = _scalars(results).select(
        F.col("computation_id").alias("_cid"), F.col("result_key").alias("_result"), F.coalesce("group_key", F.lit("")).alias("_group"),
        F.col("value").alias("_value"), F.col("unit").alias("_unit"), F.col("tolerance").alias("_tol"),
    )
    result, group = _binding_parts(F.col("_key"))
    bound = claims.withColumn("_cid", F.col("binding.computation_id")).withColumn("_key", F.col("binding.result_key"))
    return bound.withColumn("_result", result).withColumn("_group", group).join(named, ["_cid", "_result", "_group"], "left").drop("_result", "_group")


# --- Replay ------------------------------------------------------------------------------

CONTRACT = [
    "type", "unit", "comparator", "threshold", "direction", "precision", "tolerance", "missing_n", "observed_n",
    "total_n", "fraction", "sample_n", "nullable", "note",
]


def _compared(primary: DataFrame, replay: DataFrame) -> DataFrame:
    """``(computation_id, same)`` of every output of either run.

    Outputs meet in a full outer join on (key, group, position); each must exist on both
    sides, carry the same contract, and differ by at most the primary's tolerance.
    """
    keys = ["computation_id", "result_key", "group_key", "pos"]
    left = primary.select(*keys, F.struct(*CONTRACT).alias("pc"), F.col("value").alias("pv"), F.col("tolerance").alias("ptol"))
    right = replay.select(*keys, F.struct(*CONTRACT).alias("rc"), F.col("value").alias("rv"))
    fill = lambda df: df.withColumn("group_key", F.coalesce("group_key", F.lit("")))
    both = fill(left).join(fill(right), keys, "full")
    close = F.when(F.col("pv").isNull() | F.col("rv").isNull(), F.col("pv").isNull() & F.col("rv").isNull()).otherwise(
        F.abs(F.col("pv") - F.col("rv")) <= F.col("ptol")
    )
    same = F.col("pc").isNotNull() & F.col("rc").isNotNull() & F.col("pc").eqNullSafe(F.col("rc")) & close
    return both.select("computation_id", F.coalesce(same, F.lit(False)).alias("same"))


def replay_agreement(primary: DataFrame, replay: DataFrame) -> DataFrame:
    """``(computation_id, reproduced)``: every typed output of both runs agrees."""
    return _compared(primary, replay).groupBy("computation_id").agg(F.bool_and("same").alias("reproduced"))


def reproduce_gate(
    claims: DataFrame,
    computations: DataFrame,
    primary: DataFrame,
    replay: DataFrame,
    mode: str = "live",
    origin_verified: bool = False,
) -> DataFrame:
    """Claims with ``drop_reason`` (null: ship) and their verification states.

    claims: keys, citations, binding struct (computation_id, result_key, asserted_value,
    asserted_unit) or null. computations: computation_id, evidence_id, valid, result_keys,
    exit_code, timed_out, signal, primary_valid, replay_valid, same_contract.
    The first failing rule, in this order, names the reason.
    """
    # Claims are read for their citations and for their values: written once.
    claims = cut_lineage(claims)
    # A claim cites few ids, so the test for cited computations runs on its own citations.
    cites = (
        claims.where(F.col("binding").isNull())
        .select("section_id", "ord", F.explode("citations").alias("evidence_id"))
        .join(computations.select("evidence_id").distinct(), "evidence_id", "left_semi")
        .select("section_id", "ord", F.lit(True).alias("_cites_run"))
        .distinct()
    )
    # The last valid evidence of a computation counts.
    valid = computations.where(F.col("valid"))
    if "ord" not in valid.columns:
        valid = valid.withColumn("ord", F.col("evidence_id"))
    runs = last_rows(valid, ["computation_id"]).withColumnRenamed("computation_id", "_cid").drop("ord")
    joined = with_bound_values(claims, primary).join(cites, ["section_id", "ord"], "left").join(runs, "_cid", "left")
    free = F.col("binding").isNull()
    off = F.abs(F.col("_value") - F.col("binding.asserted_value")) > F.col("_tol")
    reason = (
        F.when(free & F.col("_cites_run"), K.DROP_REASONS["unbound"])
        .when(free, F.lit(None))
        .when(F.col("evidence_id").isNull(), K.DROP_REASONS["no_evidence"])
        .when(~F.array_contains("citations", F.col("evidence_id")), K.DROP_REASONS["not_cited"])
        .when(~F.array_contains("result_keys", F.col("_key")), K.DROP_REASONS["no_key"])
        .when(
            ~F.col("exit_code").eqNullSafe(F.lit(0)) | F.col("timed_out") | F.col("signal").isNotNull(),
            K.DROP_REASONS["failed"],
        )
        .when(~F.col("primary_valid"), K.DROP_REASONS["invalid"])
        .when(F.col("_value").isNull(), K.DROP_REASONS["no_value"])
        .when(F.col("_unit") != F.col("binding.asserted_unit"), K.DROP_REASONS["unit"])
        .when(off, K.DROP_REASONS["value"])
    )
    if mode == "live":
        # A claim that gets this far has a primary output, so only outputs that differ matter.
        differ = _compared(primary, replay).where(~F.col("same")).select(F.col("computation_id").alias("_cid"), F.lit(True).alias("_differs")).distinct()
        joined = joined.join(differ, "_cid", "left")
        reason = (
            reason.when(~F.col("replay_valid"), K.DROP_REASONS["replay_invalid"])
            .when(~F.col("same_contract"), K.DROP_REASONS["replay_contract"])
            .when(F.col("_differs"), K.DROP_REASONS["replay_value"])
        )
        states = ("live", "verified", "none")
    else:
        if not origin_verified:
            reason = reason.when(F.lit(True), K.DROP_REASONS["origin"])
        states = ("cached", "not_run", "verified")
    out = joined.withColumn("drop_reason", reason)
    shipped = F.col("drop_reason").isNull() & ~free
    for name, state in zip(("execution_mode", "replay_verification", "origin_verification"), states):
        out = out.withColumn(name, F.when(shipped, F.lit(state)))
    return out.select(*claims.columns, "drop_reason", "execution_mode", "replay_verification", "origin_verification")


def result_claims(results: DataFrame) -> DataFrame:
    """Three bounded claims per computation from its dependency, tumor and tissue results."""
    rows = results.where(F.col("type") == "scalar").withColumn(
        "binding", F.concat_ws("::", "result_key", "group_key")
    )
    key = F.col("binding")
    amount = fixed(F.col("value"), F.col("precision"))
    share = fixed(F.col("value") * 100, F.least(F.lit(4), F.col("precision")))
    cutoff = F.coalesce(F.regexp_replace(F.col("threshold").cast("string"), r"\.0$", ""), F.lit("the locked cutoff"))
    n = F.col("sample_n").cast("string")
    text = (
        F.when(
            key == "dependency.fraction_at_or_below_locked_cutoff",
            F.concat(
                F.lit("Of "), n, F.lit(" cell-line models with data in the frozen DepMap table, "), share, F.lit("% reach the template's "), cutoff,
                F.lit(" gene-effect cutoff for TACSTD2. Background on tumor biology; it says nothing on fitness as an ADC target."),
            ),
        )
        .when(
            key == "tumor_expression.median_by_sample_class::tumor",
            F.concat(
                F.lit("TACSTD2 expression in the frozen breast-cancer table has a median of "), amount, F.lit(" "), F.col("unit"), F.lit(" over "), n,
                F.lit(" tumor samples with data; it is set against no other source."),
            ),
        )
        .when(
            key == "normal_tissue.maximum_tissue_median_tpm",
            F.concat(
                F.lit("The highest median TACSTD2 transcript level among "), n, F.lit(" GTEx tissues is "), amount, F.lit(" "), F.col("unit"),
                F.lit(": a reason to look at exposure of normal tissue, which protein and clinical data would have to confirm."),
            ),
        )
    )
    return rows.withColumn("text", text).where(F.col("text").isNotNull() & F.col("value").isNotNull()).select(
        "computation_id",
        "text",
        F.lit(1.0).alias("confidence"),
        F.struct(
            "computation_id", F.col("binding").alias("result_key"), F.col("value").alias("asserted_value"),
            F.col("unit").alias("asserted_unit"),
        ).alias("binding"),
    )


# --- Usage -------------------------------------------------------------------------------


def price_table(spark) -> DataFrame:
    return spark.createDataFrame(K.PRICES, "model string, price_in double, price_out double")


def usage_by_model(calls: DataFrame) -> DataFrame:
    return calls.groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out")
    )


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage per model with its cost; local models are free, unknown prices give null."""
    local = F.lit(False)
    for prefix in K.FREE_MODEL_PREFIXES:
        local = local | F.col("model").startswith(prefix)
    cost = F.col("tokens_in") / 1e6 * F.col("price_in") + F.col("tokens_out") / 1e6 * F.col("price_out")
    return usage.join(prices, "model", "left").withColumn(
        "cost_usd", F.when(local, F.lit(0.0)).otherwise(cost)
    ).drop("price_in", "price_out")


def usage_total(per_model: DataFrame) -> DataFrame:
    """Totals; the cost is null as soon as one model has no known price."""
    known = F.coalesce(F.bool_and(F.col("cost_usd").isNotNull()), F.lit(True))
    return per_model.agg(
        F.sum("calls").alias("calls"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.when(known, F.coalesce(F.sum("cost_usd"), F.lit(0.0))).alias("cost_usd"),
        known.alias("pricing_known"),
    )
