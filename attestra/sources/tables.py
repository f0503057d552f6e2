"""Frozen tables: strict CSV readers, source normalisers and content checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra import constants as K
from attestra.operators import analysis as A
from attestra.sources.hashes import file_hashes, listed

DEPMAP = ["model_id", "cell_line_name", "lineage", "primary_disease", "gene_effect"]
GTEX = ["tissue_id", "tissue_name", "median_tpm"]
TUMOR = ["study_id", "molecular_profile_id", "sample_id", "sample_type", "sample_class", "expression_value"]


def read_text_csv(spark: SparkSession, path: str, columns: list[str], label: str) -> DataFrame:
    """A CSV whose header must name exactly the reviewed columns; every value stays text."""
    frame = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return A.require_columns(frame, set(columns), label).select(*columns)


def _fatal(df: DataFrame, why: Column, label: str) -> DataFrame:
    A.require_none(df.where(F.size(why) > 0).select("*", why.alias("why")), label)
    return df


def load_depmap(spark: SparkSession, path: str) -> DataFrame:
    frame = A.require_unique(read_text_csv(spark, path, DEPMAP, "depmap"), "model_id", "depmap")
    frame = A.require_measure(frame, "gene_effect", "depmap")
    return frame.withColumn("lineage", A.lineage_label(F.col("lineage")))


def load_gtex(spark: SparkSession, path: str) -> DataFrame:
    frame = A.require_unique(read_text_csv(spark, path, GTEX, "gtex"), "tissue_id", "gtex")
    frame = A.require_measure(frame, "median_tpm", "gtex")
    return _fatal(frame, A.domain_reasons(negative="median_tpm"), "gtex")


def load_tumor(spark: SparkSession, path: str) -> DataFrame:
    frame = A.require_unique(read_text_csv(spark, path, TUMOR, "tumor"), "sample_id", "tumor")
    frame = A.require_measure(frame, "expression_value", "tumor")
    fixed = {"study_id": K.COHORT_STUDY, "molecular_profile_id": K.COHORT_PROFILE}
    frame = _fatal(frame, A.domain_reasons("expression_value", "sample_class", fixed), "tumor")
    return frame.withColumn("sample_class", F.lower(F.coalesce("sample_class", F.lit("unknown"))))


# --- Source normalisers ------------------------------------------------------------------


def first_column(df: DataFrame, names: list[str], default: str | None = None) -> Column:
    """The first of several names a source may use for a column."""
    have = [n for n in names if n in df.columns]
    if have:
        return F.col(f"`{have[0]}`")
    if default is None:
        raise A.ContractError(f"none of the columns {names} is present")
    return F.lit(default)


def normalize_depmap(effects: DataFrame, models: DataFrame) -> DataFrame:
    """Model metadata with its gene effect; repeated model ids are fatal on both sides."""
    ids = ["ModelID", "model_id", "DepMap_ID"]
    gene = effects.select(
        first_column(effects, ids).alias("model_id"), first_column(effects, ["TACSTD2 (4070)", "TACSTD2", "gene_effect"]).alias("gene_effect")
    )
    A.require_unique(gene, "model_id", "depmap effects")
    meta = models.select(
        first_column(models, ids).alias("model_id"),
        F.coalesce(first_column(models, ["CellLineName", "cell_line_name"], ""), F.lit("")).alias("cell_line_name"),
        F.coalesce(first_column(models, ["OncotreeLineage", "lineage"], "Unknown"), F.lit("Unknown")).alias("lineage"),
        F.coalesce(first_column(models, ["OncotreePrimaryDisease", "primary_disease"], ""), F.lit("")).alias("primary_disease"),
    )
    A.require_unique(meta, "model_id", "depmap models")
    return A.join_effects(meta, gene).select(*DEPMAP).orderBy("model_id")


def normalize_gtex(rows: DataFrame) -> DataFrame:
    tissue = first_column(rows, ["tissueSiteDetailId", "tissue_id"])
    name = first_column(rows, ["tissueSiteDetail", "tissueSiteDetailId", "tissue_name"])
    out = rows.select(
        tissue.alias("tissue_id"), F.coalesce(name, tissue).alias("tissue_name"),
        first_column(rows, ["median", "medianTpm", "median_tpm"]).cast("string").alias("median_tpm"),
    )
    return A.require_unique(out, "tissue_id", "gtex").orderBy("tissue_id")


def normalize_tumor(samples: DataFrame, clinical: DataFrame, expression: DataFrame, gene_id: int = 4070) -> DataFrame:
    """Samples (sample_id) with their class from clinical data and their expression value."""
    kinds = clinical.where(F.col("attribute") == "SAMPLE_TYPE").groupBy("sample_id").agg(F.max_by("value", "ord").alias("sample_type"))
    values = expression.where(F.col("entrez_gene_id") == gene_id).select("sample_id", "value")
    A.require_unique(values, "sample_id", "tumor expression")
    A.require_unique(samples, "sample_id", "tumor samples")
    joined = samples.join(kinds, "sample_id", "left").join(values, "sample_id", "left")
    kind = F.coalesce("sample_type", F.lit(""))
    return joined.select(
        F.lit(K.COHORT_STUDY).alias("study_id"), F.lit(K.COHORT_PROFILE).alias("molecular_profile_id"), "sample_id",
        kind.alias("sample_type"), A.class_of_sample(kind).alias("sample_class"), F.coalesce(F.col("value").cast("string"), F.lit("")).alias("expression_value"),
    ).orderBy("sample_id")


# --- Content checks ----------------------------------------------------------------------


def logical_source(source: Column, ids: Column, dataset_id: Column) -> Column:
    """``source:release``, else the dataset id, the study id or the entry's own id."""
    return F.concat(source, F.lit(":"), F.coalesce(ids["release"], ids["datasetId"], ids["studyId"], dataset_id))


def verify_datasets(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Manifest entries (id, source, source_ids map, sha256) with the file's hash.

    Files are named ``<id>.csv``; ``matches`` is false for a missing or changed file. Files may be of any
    size: they are streamed, each by one task.
    """
    hashed = file_hashes(listed(spark, path))
    files = hashed.select(F.regexp_extract("path", r"([^/]+)\.csv$", 1).alias("id"), F.col("sha256").alias("actual_sha256"))
    return manifest.join(files, "id", "left").select(
        "id", logical_source(F.col("source"), F.col("source_ids"), F.col("id")).alias("logical_source_id"), "sha256", "actual_sha256",
        F.coalesce(F.col("sha256") == F.col("actual_sha256"), F.lit(False)).alias("matches"),
    )
