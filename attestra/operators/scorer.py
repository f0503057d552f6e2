"""Pluggable batch scorer: a caller's function over Arrow batches, with soft failure."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def score_rows(df: DataFrame, keys: list[str], scorer: Callable[[pd.DataFrame], pd.DataFrame], fields: str) -> DataFrame:
    """Run ``scorer`` on every batch; it returns one row per input row, in order.

    ``fields`` is the schema of the scorer's columns. A batch that fails, or comes back with
    another number of rows, yields null scores and says why in ``error``, so later steps fall back
    (lexical order, unverified verdicts) instead of stopping, and nothing fails unseen.
    """
    names = [part.strip().split(" ")[0] for part in fields.split(",")]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", " + fields + ", error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[keys].reset_index(drop=True)
            try:
                scored = scorer(batch).reset_index(drop=True)
                if len(scored) != len(out):
                    raise ValueError("scorer changed the number of rows")
                yield out.assign(**{n: scored[n] for n in names}, error=None)
            except Exception as error:
                yield out.assign(**{n: None for n in names}, error=f"{type(error).__name__}: {error}")

    return df.mapInPandas(run, schema)
