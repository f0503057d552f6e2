"""Sharding by k-d tree over document metadata.

The tree begins with all rows and the wanted number of leaves. A node of several leaves is split in
two along the dimension in which its rows spread widest (range over the whole table's range), at
the weighted quantile that gives each side bytes in proportion to its leaves, until every node is a
leaf and holds about total / leaves bytes. All nodes of a level are split together: their quantiles
are narrowed by counting bytes in ``BINS`` slices of each node's interval, so what reaches the
driver is nodes times slices, whatever the number of rows.

A row's key on a dimension is the dimension's value followed by a hash of its id and text, so rows
of equal metadata are separable; only rows equal in all of these stay together. Each pass walks rows
down the tree so far, so nothing but the slim rows is ever stored. Dimensions: text
length, source, language, id. Null metadata counts as the lowest value, a null text has no bytes, an
empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm import blocks as B
from attestra.session import cut_lineage

Tree = dict[int, tuple[int, int]]  # node -> (dimension, key of the first row on the right)

BINS = 512
OVERHEAD = 16
LOW = 1 << 31  # keys are value * LOW + tie, values below LOW
DIMENSIONS = ("d0", "d1", "d2", "d3")


def _points(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, tie, d0..d3): slim rows, each dimension a 31-bit number."""
    text = F.coalesce("text", F.lit(""))
    bits = F.lit(LOW)

    def ranked(c: str) -> Column:
        return F.coalesce(F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(1 << 16)), F.lit(0))

    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", "text"), bits).alias("tie"),
        F.least(F.floor(F.log2(F.octet_length(text) + 1.0) * (1 << 20)).cast("bigint"), F.lit(LOW - 1)).alias("d0"),
        ranked("source").alias("d1"),
        ranked("lang").alias("d2"),
        F.pmod(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), bits).alias("d3"),
    )


def _keys(batch: pa.RecordBatch, tie: np.ndarray, d: int) -> np.ndarray:
    return batch.column(DIMENSIONS[d]).to_numpy() * LOW + tie


def _descend(batch: pa.RecordBatch, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """The node of every row under the splits so far, and the rows' ties."""
    tie = batch.column("tie").to_numpy()
    node = np.ones(batch.num_rows, np.int64)
    for n in sorted(tree):  # parents before children
        d, cut = tree[n]
        here = np.flatnonzero(node == n)
        if len(here):
            node[here] = 2 * n + (_keys(batch, tie, d)[here] >= cut)
    return node, tie


def _extents(rows: DataFrame, tree: Tree) -> dict[int, tuple]:
    """node -> (size, lows, highs) of its rows; a row for each node reaches the driver."""

    def work(batches):
        for batch in batches:
            node, _ = _descend(batch, tree)
            size = batch.column("size").to_numpy()
            ids, at = np.unique(node, return_inverse=True)
            out = [pa.array(ids), pa.array(np.bincount(at, size).astype(np.int64))]
            for d in DIMENSIONS:
                value = batch.column(d).to_numpy()
                low, high = np.full(len(ids), np.iinfo(np.int64).max), np.full(len(ids), -1)
                np.minimum.at(low, at, value)
                np.maximum.at(high, at, value)
                out += [pa.array(low), pa.array(high)]
            yield pa.RecordBatch.from_arrays(out, ["node", "size", *[f"{e}{d}" for d in DIMENSIONS for e in ("lo_", "hi_")]])

    found = rows.mapInArrow(work, "node bigint, size bigint, " + ", ".join(f"lo_{d} bigint, hi_{d} bigint" for d in DIMENSIONS))
    found = found.groupBy("node").agg(F.sum("size").alias("size"), *[F.min(f"lo_{d}").alias(f"lo_{d}") for d in DIMENSIONS], *[F.max(f"hi_{d}").alias(f"hi_{d}") for d in DIMENSIONS])
    return {r["node"]: (r["size"], [r[f"lo_{d}"] for d in DIMENSIONS], [r[f"hi_{d}"] for d in DIMENSIONS]) for r in found.collect()}


def _slices(rows: DataFrame, tree: Tree, active: dict[int, tuple[int, int, int]]) -> dict[int, list[tuple[int, int]]]:
    """Bytes in each slice of each active node's interval: active is node -> (dimension, low, width)."""

    def work(batches):
        for batch in batches:
            node, tie = _descend(batch, tree)
            size = batch.column("size").to_numpy()
            for n, (d, lo, width) in active.items():
                here = np.flatnonzero(node == n)
                slot = (_keys(batch, tie, d)[here] - lo) // width
                inside = (slot >= 0) & (slot < BINS)
                sums = np.bincount(slot[inside], size[here][inside], minlength=1).astype(np.int64)
                at = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n)), pa.array(at), pa.array(sums[at])], ["node", "slot", "size"])

    found = rows.mapInArrow(work, "node bigint, slot bigint, size bigint").groupBy("node", "slot").agg(F.sum("size").alias("size"))
    out: dict[int, list[tuple[int, int]]] = {}
    for r in found.collect():  # nodes times BINS rows at most
        out.setdefault(r["node"], []).append((r["slot"], r["size"]))
    return {n: sorted(v) for n, v in out.items()}


def _quantiles(rows: DataFrame, tree: Tree, wanted: dict[int, tuple[int, int, int, float, float]]) -> Tree:
    """For each node the key that parts its target bytes from the rest.

    wanted: node -> (dimension, low, high, target bytes, slack bytes). An interval is narrowed until
    the slice that holds the quantile weighs no more than the slack, or is a single key.
    """
    active = {n: (d, lo, hi + 1, 0) for n, (d, lo, hi, _, _) in wanted.items()}
    done: Tree = {}
    while active:
        width = {n: max(1, -(-(hi - lo) // BINS)) for n, (_, lo, hi, _) in active.items()}
        counted = _slices(rows, tree, {n: (d, lo, width[n]) for n, (d, lo, _, _) in active.items()})
        for n, (d, lo, _, below) in list(active.items()):
            target, slack = wanted[n][3:]
            edge, over = lo, 0
            for slot, size in counted[n]:
                edge, over = lo + slot * width[n], size
                if below + size > target:
                    break
                below += size
            if below + over <= target or over <= slack or width[n] == 1:
                done[n] = (d, edge if target - below <= over / 2 else edge + width[n])
                del active[n]
            else:
                active[n] = (d, edge, edge + width[n], below)
    return done


def shards(docs: DataFrame, leaves: int = 40, precision: float = 0.002) -> DataFrame:
    """(doc_id, size, text_crc32, tie, shard) of every row; shard sizes differ by about ``precision``
    of a shard for each level, or by one inseparable row."""
    B.arrow_batches(docs.sparkSession, 10000)
    rows = cut_lineage(_points(docs))
    count, first, tree, wide = {1: leaves}, {1: 0}, {}, None
    while any(m > 1 for m in count.values()):
        extents = _extents(rows, tree)
        if not extents:
            break
        if wide is None:
            _, lows, highs = extents[1]
            wide = [max(1, hi - lo) for lo, hi in zip(lows, highs, strict=True)]
        wanted = {}
        for n in [n for n, m in count.items() if m > 1]:
            m, at = count.pop(n), first.pop(n)
            count |= {2 * n: m - m // 2, 2 * n + 1: m // 2}
            first |= {2 * n: at, 2 * n + 1: at + m - m // 2}
            if n not in extents:
                continue  # no rows: its leaves stay empty
            size, lows, highs = extents[n]
            d = max(range(len(DIMENSIONS)), key=lambda i: ((highs[i] - lows[i]) / wide[i], -i))
            wanted[n] = (d, lows[d] * LOW, (highs[d] + 1) * LOW - 1, size * (m - m // 2) / m, precision * size / m)
        tree |= _quantiles(rows, tree, wanted)
    place = dict(first)

    def work(batches):
        for batch in batches:
            node, tie = _descend(batch, tree)
            shard = np.array([place[n] for n in node.tolist()], np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "size", "text_crc32", "tie")), pa.array(shard)], ["doc_id", "size", "text_crc32", "tie", "shard"])

    return rows.mapInArrow(work, "doc_id bigint, size bigint, text_crc32 bigint, tie bigint, shard int")


def numbered(placed: DataFrame, per_bucket: int = 65536) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard: rows are numbered in hashed buckets of bounded
    size, and buckets are laid end to end."""
    placed = cut_lineage(placed)
    buckets = max(1, -(-placed.count() // per_bucket))
    placed = placed.withColumn("bucket", F.pmod(F.col("tie"), F.lit(buckets)))
    sizes = placed.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "bucket").orderBy("tie", "doc_id", "text_crc32")
    return placed.withColumn("at", F.row_number().over(inside)).join(starts, ["shard", "bucket"]).withColumn("slot", F.col("base") + F.col("at") - 1).drop("tie", "bucket", "at", "base")
