"""Gold targets and gold patents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators.store import reasons

TARGET = """target STRING, label STRING, allowedVerdicts ARRAY<STRING>, rationale STRING, trap STRUCT<kind: STRING>,
seminalPmids ARRAY<STRING>, expectedKols ARRAY<STRUCT<investigator: STRING, institution: STRING, mustAppear: BOOLEAN>>,
knownDevelopabilityRisks ARRAY<STRUCT<category: STRING, minSeverity: STRING>>,
claimProbes ARRAY<STRUCT<statement: STRING, expected: STRING>>, curator STRING, curatedAt STRING"""

PATENT = """name STRING, patentNumber STRING, expectedAssignees ARRAY<STRING>, expectedFamilyMembers ARRAY<STRING>,
declaredSequenceCount INT, knownSequences ARRAY<STRUCT<seqId: BIGINT, residues: STRING>>,
expectedConstructs ARRAY<STRUCT<name: STRING, vhSeqId: BIGINT, vlSeqId: BIGINT, species: STRING>>,
expectedCompetitorOverlaps ARRAY<STRUCT<seqId: BIGINT, competitorAccession: STRING, level: STRING>>"""


def _files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    named = rows.select("*", F.col("_metadata.file_name").alias("file_name"))
    return named.where(~F.col("file_name").startswith("_"))


def load_gold(spark: SparkSession, path: str, subset: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(targets, rejected with reasons)``; files starting with ``_`` are not targets."""
    rows = _files(spark, path, TARGET)
    checked = rows.withColumn("reasons", reasons(
        (F.coalesce(F.length("target"), F.lit(0)) == 0, "target is blank"),
        (F.coalesce(F.length("rationale"), F.lit(0)) == 0, "rationale is blank"),
        (F.coalesce(F.size("allowedVerdicts"), F.lit(0)) < 1, "no allowed verdicts"),
        (~F.coalesce(F.array_contains("allowedVerdicts", F.col("label")), F.lit(False)), "allowed verdicts leave out the label"),
        (
            F.col("trap").isNotNull() & ~F.coalesce(F.array_contains("allowedVerdicts", F.lit("insufficient-evidence")), F.lit(False)),
            "a trap target must allow abstention",
        ),
    ))
    good = checked.where(F.size("reasons") == 0).drop("reasons")
    if subset is not None:
        good = good.where(F.col("target").isin(subset))
    return good, checked.where(F.size("reasons") > 0)


def gold_patents(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path, PATENT).where(F.col("patentNumber").isNotNull())
