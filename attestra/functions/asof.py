"""As-of joins: for each row the nearest earlier (or later) row of another table under the same key.

Time is cut into ``BLOCKS`` equal ranges. Within a (key, range) a running value gives the neighbour; where
a range has none before a row, the last value of the key's earlier ranges does, of which there are at most
``BLOCKS`` a key. So a key that holds a large share of all rows is spread over its ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = 256


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, later: bool = False, strict: bool = False) -> DataFrame:
    """``left`` with ``value`` of the last ``right`` row of its key at or before ``at``.

    ``later``: the first row at or after it; ``strict``: rows at the same time don't count. Null where
    there is none. Of right rows with equal key and time the greatest value counts (the least with
    ``later``). ``at`` is an integer; rows without key or time find nothing and are found by nothing.
    """
    sign = -1 if later else 1
    time = (F.col(at) * sign).cast("bigint")
    span = right.agg(F.min(time), F.max(time)).first()
    if span[0] is None:
        return left.withColumn(value, F.lit(None).cast(right.schema[value].dataType))
    width = max(1, -(-(span[1] - span[0] + 1) // BLOCKS))
    block = F.least(F.expr(f"floor((_t - {span[0]}L) / {width}L)"), F.lit(BLOCKS)).cast("int")
    rows = right.where(F.col(key).isNotNull() & time.isNotNull()).select(F.col(key), time.alias("_t"), F.struct(F.col(value).alias("v")).alias("_v"))
    rows = rows.withColumn("_block", block)
    # at equal times right rows come first, unless only earlier ones count
    both = left.withColumn("_t", time).withColumn("_block", block).withColumn("_side", F.lit(1))
    both = both.unionByName(rows.withColumn("_side", F.lit(2 if strict else 0)), allowMissingColumns=True)
    order = Window.partitionBy(key, "_block").orderBy("_t", "_side", F.asc("_v") if sign > 0 else F.desc("_v")).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_near", F.last("_v", ignorenulls=True).over(order)).where(F.col("_side") == 1)
    pick = F.max if sign > 0 else F.min
    newest = rows.groupBy(key, "_block", "_t").agg(pick("_v").alias("_v"))
    heads = newest.groupBy(key, "_block").agg(F.max_by("_v", "_t").alias("_v"))
    heads = heads.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_block", "_v"))).alias("_heads"))
    before = F.filter("_heads", lambda x: x["_block"] < F.col("_block"))
    found = F.coalesce("_near", F.when(F.size(before) > 0, F.element_at(before, -1)["_v"]))
    return near.join(heads, key, "left").withColumn(value, found["v"]).select(*left.columns, value)
