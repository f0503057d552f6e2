"""Aggregations that stay exact and spread when one group holds most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.session import cut_lineage

SKETCH = 1000  # rank error of the bounds is at most n / SKETCH


def join_lines(lines: DataFrame, keys: list[str], order: list[str], column: str = "line") -> DataFrame:
    """Ordered text per key. For small presentation groups only (a digest, a report)."""
    return lines.groupBy(*keys).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct(*order, column))), lambda x: x[column]), "\n"
        ).alias("text")
    )


def percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation, one column per named point.

    Spark's ``percentile`` keeps every distinct value of a group in one aggregation buffer.
    Here a bounded sketch first yields, per wanted rank, a value interval that must hold it;
    values outside all intervals are only counted, values inside are counted per value. Those
    counts, about ``4 / SKETCH`` of a group, are laid out in ranges of (group, value); each range's
    total gives the rank at which it begins, so ranks are found range by range and no task ever
    sorts a whole group.
    """
    points = dict(sorted(points.items(), key=lambda kv: kv[1]))
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    shift = 2.0 / SKETCH
    probes = []
    for p in points.values():
        probes += [max(0.0, p - shift), min(1.0, p + shift)]
    sketch = F.percentile_approx("_v", F.array(*[F.lit(x) for x in probes]), F.lit(SKETCH))
    bounds = rows.groupBy(*keys).agg(
        sketch.alias("_b"), F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    inside = F.lit(False)
    slot = F.lit(0)
    # Below this size a rank can lie outside the sketch's margin, so all values are kept.
    small = F.col("_n") <= 4 * SKETCH
    for i, p in enumerate(points.values()):
        low = F.col("_lo") if p - shift <= 0 else F.when(small, F.col("_lo")).otherwise(F.get("_b", F.lit(2 * i)))
        high = F.col("_hi") if p + shift >= 1 else F.when(small, F.col("_hi")).otherwise(F.get("_b", F.lit(2 * i + 1)))
        inside = inside | F.col("_v").between(low, high)
        # Gaps between intervals get one slot each, so their rows add up to one count.
        slot = slot + (F.col("_v") > high).cast("int")
    if keys:
        joined = rows.join(bounds, keys)
    else:
        joined = rows.withColumn("_s", bounds.select(F.struct("_b", "_n", "_lo", "_hi")).scalar()).select("*", "_s.*")
    marked = joined.select(
        *keys, "_n", slot.alias("_slot"), F.when(inside, F.col("_v")).alias("_x"), F.col("_v")
    )
    counted = marked.groupBy(*keys, "_n", "_slot", "_x").agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_at")
    )
    ranged = counted.repartitionByRange(*[F.col(k) for k in keys], F.col("_at")).withColumn("_part", F.spark_partition_id())
    ranged = cut_lineage(ranged)  # ranges are sampled: both uses below must see the same ones
    totals = ranged.groupBy(*keys, "_part").agg(F.sum("_c").alias("_c"))
    # One row for each group and range.
    ahead = Window.partitionBy(*keys, F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_start"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    w = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranged.join(starts, same).withColumn("_to", F.col("_start") + F.sum("_c").over(w)).withColumn("_from", F.col("_to") - F.col("_c"))
    out = []
    for name, p in points.items():
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        lower, upper = F.floor(pos), F.ceil(pos)
        hold = lambda r: (F.col("_from") <= r) & (r < F.col("_to"))
        a = F.max(F.when(hold(lower), F.col("_x")))
        b = F.max(F.when(hold(upper), F.col("_x")))
        frac = F.max(pos - F.floor(pos))
        exact = a + (b - a) * frac
        # A missing rank would mean the sketch broke its error bound: fail, never guess.
        checked = F.when(a.isNull() | b.isNull(), F.raise_error(F.lit("percentile bounds missed a rank"))).otherwise(exact)
        out.append(checked.alias(name))
    return ranked.groupBy(*keys).agg(*out)
