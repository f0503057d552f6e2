"""Exact top-k of vectors by cosine or inner product, in matrix blocks.

Queries go in blocks of at most ``queries`` rows, whose matrix is sent to all tasks; every block reads
the vectors once. A task multiplies each batch of vectors with the query matrix, so the work is matrix
products, and keeps k a query. What can be left out is: by Cauchy-Schwarz a query's product with any
vector of a batch is at most its product with the batch's centre plus its length times the batch's
radius, and a query whose k-th best is above that skips the batch.

Products differ in their last digits with the order of summation, so rows that come near the k-th best
are worked out again one by one in a fixed order and rounded to ``digits``; equal values are ranked by
id. The result then depends on neither partitioning nor batches. Vectors that are null, empty, not finite
or (cosine) zero, or of another length than the query, meet nothing. Rows that share an id are ranked
as rows of their own. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import vectors as V
from attestra.session import cut_lineage

SLACK = 1e-9  # of the vectors' lengths; far above the rounding of a product


def _unit(x: np.ndarray, metric: str) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if metric == "cosine" else x


def _usable(table: DataFrame, key: str, column: str, metric: str) -> DataFrame:
    rows = table.where(V.valid_vector(F.col(column)))
    if metric == "cosine":
        rows = rows.where(F.exists(column, lambda v: v != 0))
    return rows.select(F.col(key), F.col(column).cast("array<double>").alias(column))


def _best(q: np.ndarray, value: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query: greatest value, then least id."""
    if ids.dtype == object:
        ids = np.unique(ids.astype(str), return_inverse=True)[1]
    order = np.lexsort((ids, -value, q))
    rank = np.arange(len(order)) - np.searchsorted(q[order], q[order])
    return order[rank < k]


def _block(rows: DataFrame, key: str, column: str, matrix: np.ndarray, k: int, metric: str, digits: int) -> DataFrame:
    """(q, id, value): per task the k best vectors of each query of a matrix."""
    sent = rows.sparkSession.sparkContext.broadcast(_unit(matrix, metric))
    width = matrix.shape[1]
    kind = rows.schema[key].dataType.simpleString()

    def work(batches):
        query = sent.value
        length = np.sqrt((query * query).sum(axis=1))
        q, value, ids = np.zeros(0, np.int64), np.zeros(0), None
        least = np.full(len(query), -np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(key).to_numpy(zero_copy_only=False)
            x = _unit(np.asarray(batch.column(column).flatten()).reshape(-1, width), metric)
            centre = x.mean(axis=0)
            radius = np.sqrt(((x - centre) ** 2).sum(axis=1).max())
            scale = SLACK * length * np.sqrt((x * x).sum(axis=1).max())
            alive = np.flatnonzero(query @ centre + length * radius + scale >= least)
            if not len(alive):
                continue
            near = query[alive] @ x.T
            if near.shape[1] > k:  # the batch's own k-th best is a threshold, too
                kth = np.partition(near, -k, axis=1)[:, -k]
                floor = np.maximum(least[alive], kth)
            else:
                floor = least[alive]
            at, row = np.nonzero(near >= (floor - scale[alive])[:, None])
            again = np.round((query[alive][at] * x[row]).sum(axis=1), digits)
            q, value = np.concatenate([q, alive[at]]), np.concatenate([value, again])
            ids = names[row] if ids is None else np.concatenate([ids, names[row]])
            top = _best(q, value, ids, k)
            q, value, ids = q[top], value[top], ids[top]
            full = np.flatnonzero(np.bincount(q, minlength=len(query)) == k)
            least[full] = value[np.searchsorted(q, full, "right") - 1] - 10.0**-digits
        out = pa.array(ids if ids is not None else [], batch_type)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), out, pa.array(value)], ["q", key, "value"])

    batch_type = _arrow_type(kind)
    return rows.mapInArrow(work, f"q int, `{key}` {kind}, value double")


def _arrow_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def top_k(queries: DataFrame, vectors: DataFrame, k: int, key: str = "id", column: str = "vector", metric: str = "cosine", digits: int = 9, most: int = 1024) -> DataFrame:
    """(query_id, key, value, rank): the k vectors of greatest cosine (or ``dot``) for each (query_id, vector).

    The driver holds one block of query vectors at a time.
    """
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    asked = _usable(queries, "query_id", column, metric)
    rows = _usable(vectors, key, column, metric)
    total = asked.count()
    count = max(1, -(-total // most))
    sized = asked.withColumn("_size", F.size(column))
    # rows of one id and vector are dealt apart, so a block stays near its size
    dealt = cut_lineage(sized.withColumn("_block", F.pmod(F.xxhash64("query_id", column, F.monotonically_increasing_id()), F.lit(count))))
    found = []
    for i in range(count):
        part = dealt.where(F.col("_block") == i)
        for (size,) in part.select("_size").distinct().toLocalIterator():
            block = list(part.where(F.col("_size") == size).select("query_id", column).toLocalIterator())
            matrix = np.array([r[1] for r in block], float)
            best = _block(rows.where(F.size(column) == size), key, column, matrix, k, metric, digits)
            order = Window.partitionBy("q").orderBy(F.desc("value"), F.asc_nulls_first(key))
            best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            names = spark.createDataFrame([(n, r[0]) for n, r in enumerate(block)], f"q int, query_id {queries.schema['query_id'].dataType.simpleString()}")
            found.append(cut_lineage(best.join(names, "q").select("query_id", key, "value", "rank")))
    if not found:
        return asked.join(rows.drop(column).withColumn("_q", F.lit(None)), F.lit(False)).select("query_id", key, F.lit(0.0).alias("value"), F.lit(1).alias("rank"))
    while len(found) > 1:
        found = [a.unionByName(b) for a, b in zip(found[::2], found[1::2], strict=False)] + found[len(found) & ~1 :]
    return found[0]
