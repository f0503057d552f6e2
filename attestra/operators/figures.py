"""Figure readings checked against captions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra import constants as K
from attestra.functions import numbers as N


def gate_readings(readings: DataFrame, figures: DataFrame) -> DataFrame:
    """Readings of known figures; each value is low risk when the caption states it.

    readings: figure_id, figure_type, reading, confidence, values (label, value, unit);
    figures: figure_id, caption, one row per figure.
    """
    def judged(v):
        stated = N.text_has_value(F.col("_caption"), v["value"])
        return F.struct(
            v["label"].alias("label"), v["value"].alias("value"), v["unit"].alias("unit"), stated.alias("in_caption"),
            F.when(stated, "low").otherwise("high").alias("read_risk"),
        )

    known = F.col("figure_type").isin(K.FIGURE_TYPES)
    return (
        readings.join(figures.select("figure_id", N.numeric_text(F.col("caption")).alias("_caption")), "figure_id")
        .withColumn("values", F.transform("values", judged))
        .withColumn("figure_type", F.when(known, F.col("figure_type")).otherwise("other"))
        .drop("_caption")
    )
