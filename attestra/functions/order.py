"""Numbers for rows in an order of their own, without sorting them in one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.session import cut_lineage


def numbered(df: DataFrame, order: list[Column], name: str = "ord") -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... in the given order, written down once.

    Rows are dealt by ranges of the order and sorted within them; the driver sees the ranges' sizes only.
    Rows that tie in every column of the order are numbered in no particular order.
    """
    rows = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted((r[0], r[1]) for r in rows.groupBy(part.alias("part")).count().toLocalIterator())
    starts = list(accumulate([0, *(n for _, n in sizes)]))[:-1]
    first = df.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts, strict=True)], "_part bigint, _start bigint")
    at = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("_part", part).join(first, "_part").withColumn(name, F.col("_start") + at).drop("_part", "_start", "_at")
