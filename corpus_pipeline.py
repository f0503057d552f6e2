"""The corpus pipeline: from raw documents to packed training sequences.

Stages, each on all that the one before it kept:

1. ``language``: documents whose language is unknown or ambiguous go;
2. ``near_duplicates``: of each component of near copies (five words, 0.8) the smallest id stays;
3. ``decontaminate``: documents contaminated by benchmark passages go;
4. ``secrets``: found secrets are replaced by a mark, ``n_chars`` follows the text;
5. ``pack``: token pieces with their sequences and places.

``run`` writes each stage's result as Parquet in the session's checkpoint folder and reads it again,
so no stage recomputes another and a lost executor costs one stage's tasks at most. An empty table
goes through as an empty one. Rows without an id, repeated rows and ties are treated as the
operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import decontaminate, jaccard, language, packing, secrets
from attestra.llm.queries import TOKENIZERS
from attestra.session import cut_lineage

ORACLE_SQL = None  # decoded languages and packing have no SQL


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    fold = F.coalesce(language.held_out(F.col("doc_id")), F.lit(False))
    return language.spoken(docs, language.fit(docs.where(~fold).select("doc_id", "text", "lang")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.scan(docs.select(F.struct(*docs.columns).alias("row"), F.col("text")))
    text = secrets.redact(F.col("text"), F.col("secrets"))
    size = F.when(F.size("secrets") > 0, F.char_length("new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    new = {"text": F.col("new"), "n_chars": size}
    return found.withColumn("new", text).select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, f"{TOKENIZERS}/byte_bpe_50k.json"))


STAGES = [
    ("language", identify),
    ("near_duplicates", deduplicate),
    ("decontaminate", decontaminated),
    ("secrets", redact),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
