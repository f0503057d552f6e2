"""Files of one or many records, split by byte ranges, in the order they arrived, with rejects.

A record is a whole file, a line, or whatever ends in a separator (``</article>``): Spark's text source
cuts files at any byte and finds the next separator, so one large file is read by many tasks. Records are
numbered by arrival: the time a file was received (from a manifest of (file, received), else its time of
change), then its name relative to the folder that was read, then the place in it. So moving a folder, or
reading it with other partitions, changes no number's order, and which of two copies came first stays.

``parsed`` turns JSON records into columns; what is no JSON of the wanted shape goes to the rejects, with
its reason, and is never lost. It works on a stream of records too (``record_stream``).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions.order import numbered

PLACE = 31  # bits for places within one record; an array holds fewer than 2^31 elements


def _root(path: str) -> str:
    """The fixed part of a path or pattern, without scheme: what names are relative to."""
    plain = re.sub(r"^[a-z0-9+.-]+://?[^/]*", "", path) if "://" in path else re.sub(r"^[a-z0-9+-]+:(?=/)", "", path)
    fixed = re.split(r"[*?\[{]", plain)[0]
    return fixed if fixed.endswith("/") else fixed.rsplit("/", 1)[0] + "/" if fixed != plain or re.search(r"\.[A-Za-z0-9]+$", fixed) else fixed + "/"


def _named(rows: DataFrame, path: str) -> DataFrame:
    whole, root = F.col("_metadata.file_path"), _root(path)
    at = F.locate(root, whole)
    relative = F.when(at > 0, F.expr(f"substring(_metadata.file_path, locate('{root}', _metadata.file_path) + {len(root)})".replace("\\", "\\\\"))).otherwise(F.col("_metadata.file_name"))
    return rows.select(
        F.col("value"), relative.alias("file"), F.col("_metadata.file_modification_time").alias("received"), F.col("_metadata.file_block_start").alias("_block")
    )


def land(spark: SparkSession, path: str, separator: str | None = None, received: DataFrame | None = None) -> DataFrame:
    """(record, file, received, value): every record of a path, ``record`` its number by arrival.

    ``separator`` ends a record and stays off it; without one a record is a file. Blank records are left
    out. A file the manifest ``received`` (file, received) does not name keeps its time of change.
    """
    reader = spark.read.text(path, wholetext=True) if separator is None else spark.read.text(path, lineSep=separator)
    rows = _named(reader, path).withColumn("_at", F.monotonically_increasing_id())
    if received is not None:
        known = received.groupBy("file").agg(F.min("received").alias("_known"))
        rows = rows.join(known, "file", "left").withColumn("received", F.coalesce("_known", "received")).drop("_known")
    rows = rows.where(F.length(F.trim("value")) > 0)
    order = [F.col("received"), F.col("file"), F.col("_block"), F.col("_at")]
    return numbered(rows, order, "record").select("record", "file", "received", "value")


def record_stream(spark: SparkSession, path: str, separator: str | None = None, files_per_batch: int = 100) -> DataFrame:
    """The records of new files as a stream of (file, received, value)."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    reader = reader.option("wholetext", True) if separator is None else reader.option("lineSep", separator)
    return _named(reader.text(path), path).drop("_block").where(F.length(F.trim("value")) > 0)


def parsed(records: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """``(good, rejects)``: JSON records as the columns of ``schema``; rejects keep their text and a reason."""
    kept = [c for c in records.columns if c != "value"]
    read = records.withColumn("_j", F.from_json("value", schema + ", _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    fault = F.when(F.try_parse_json("value").isNull(), "not JSON").when(F.col("_j").isNull() | F.col("_j._bad").isNotNull(), "another shape")
    good = read.where(F.coalesce(F.col("_j._bad").isNull() & F.col("_j").isNotNull(), F.lit(False))).select(*kept, "_j.*").drop("_bad")
    return good, read.withColumn("reason", fault).where(F.col("reason").isNotNull()).select(*kept, "reason", "value")


def place(record, pos):
    """One number for (record, place in it): both keep their order, and no two pairs share one."""
    return F.shiftleft(record.cast("bigint"), PLACE) + pos.cast("bigint")
