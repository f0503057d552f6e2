"""Removal of repeated byte strings by a sparse, hash-compared suffix sort.

Every ``size``-byte string has an anchor: the ``GRAM``-byte string inside it with the least hash,
leftmost among equals. Equal strings have equal anchors at equal places, so only strings that share
an anchor need comparing, and about one place in two hundred is an anchor. For each anchor the
strings that have it start at consecutive places; together they cover its context.

Anchors whose whole context is equal (by a 128-bit digest) repeat entirely. For the rest, the
contexts of one anchor, one of each repeated kind included, are sorted by what follows the anchor and
by what precedes it, in mergesort whose comparison finds the common extension of two suffixes by
binary search over prefix polynomial hashes; every extension found is then compared byte by byte.
A string that starts ``o`` bytes before its anchor repeats exactly if another context agrees for
``o`` bytes before and ``size - o`` after, which the two orders answer for all contexts at once.

An anchor with more than ``largest`` contexts is not gathered in one task: its strings are counted
one by one by their digests instead, to the same result.

Texts are UTF-8 bytes, null ones empty; strings never cross documents and are judged on the input.
Repeated rows repeat each other's strings. Empty and short texts keep all bytes, an empty table gives
an empty result, other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm import blocks as B
from attestra.session import cut_lineage

GRAM = 32
FILTER_BITS = 1 << 23
_STEP = 1 << 20
_PLACE = np.uint64(24)
CLASS = ("key", "least", "most", "context")


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, cuts: np.ndarray, size: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, place, first, last, key) of every anchor: strings of its text starting at ``first`` to
    ``last`` have the anchor at ``place``; places are those of the block."""
    total = len(data) - size + 1
    if total <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    prefix = B.Prefix(data)
    at = np.empty(total, np.int64)
    for lo in range(0, total, _STEP):
        hi = min(total, lo + _STEP)
        place = np.arange(lo, hi + size - gram)
        h = prefix.of(place, place + gram)
        key = h >> _PLACE << _PLACE | (place - lo).astype(np.uint64)
        at[lo:hi] = (_sliding_min(key, size - gram + 1) & np.uint64((1 << 24) - 1)).astype(np.int64) + lo
    starts = np.arange(total)
    text = np.searchsorted(cuts, starts, "right") - 1
    inside = starts + size <= cuts[text + 1]
    starts, text, at = starts[inside], text[inside], at[inside]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(at) else first
    place = at[first]
    return text[first], place, starts[first], starts[last], prefix.of(place, place + gram)


def _found(block: B.Block, size: int):
    text, place, first, last, key = anchors(block.data, block.cuts, size)
    raw = block.data.tobytes()
    digests = [hashlib.blake2b(raw[a : b + size], digest_size=16).digest() for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    return text, place, first, last, key, digests, raw


def _listed(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, mark, place, least, most, key, context) of every anchor: its place in its text, how
    far before it its strings start, and the digest of its context."""

    def work(batches):
        for batch in batches:
            for block in B.blocks(batch):
                text, place, first, last, key, digests, _ = _found(block, size)
                ids = [batch.column(c).slice(block.lo, block.rows).take(pa.array(text)) for c in ("doc_id", "mark")]
                yield pa.RecordBatch.from_arrays(
                    [*ids, *(pa.array(x.astype(np.int32)) for x in (place - block.cuts[text], place - last, place - first)), pa.array(key.view(np.int64)), pa.array(digests, pa.binary())],
                    ["doc_id", "mark", "place", "least", "most", "key", "context"],
                )

    return docs.mapInArrow(work, "doc_id bigint, mark bigint, place int, least int, most int, key bigint, context binary")


def _bit(mark: np.ndarray, place: np.ndarray) -> np.ndarray:
    h = B.mix(mark.astype(np.int64).view(np.uint64) ^ B.mix(place.astype(np.uint64) + np.uint64(1)))
    return (h & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _bitmap(rows: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over (mark, place); at most FILTER_BITS / 64 numbers reach the driver."""

    def work(batches):
        for batch in batches:
            bit = _bit(batch.column("mark").to_numpy(), batch.column("place").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(bit >> 6), pa.array((bit & 63).astype(np.int32))], ["at", "b"])

    words = rows.select("mark", "place").mapInArrow(work, "at bigint, b int").groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS >> 6, np.int64)
    out[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def _contexts(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The wanted anchors (doc_id, mark, place, ...) with the bytes of their contexts."""
    bits = _bitmap(wanted)

    def work(batches):
        for batch in batches:
            marks = batch.column("mark").to_numpy()
            for block in B.blocks(batch):
                text, place, first, last, key = anchors(block.data, block.cuts, size)
                local = place - block.cuts[text]
                bit = _bit(marks[block.lo : block.hi][text], local)
                keep = np.flatnonzero(bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                raw = block.data.tobytes()
                ids = [batch.column(c).slice(block.lo, block.rows).take(pa.array(text[keep])) for c in ("doc_id", "mark")]
                texts = [raw[a : b + size] for a, b in zip(first[keep].tolist(), last[keep].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(local[keep].astype(np.int32)), pa.array(texts, pa.binary())], ["doc_id", "mark", "place", "bytes"])

    found = docs.mapInArrow(work, "doc_id bigint, mark bigint, place int, bytes binary").dropDuplicates(["doc_id", "mark", "place"])
    same = (found["mark"] == wanted["mark"]) & (found["place"] == wanted["place"]) & found["doc_id"].eqNullSafe(wanted["doc_id"])
    return wanted.join(found, same).select(*[wanted[c] for c in wanted.columns], found["bytes"])


class Suffixes:
    """Common extensions of suffixes of byte strings, by prefix hashes and binary search."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        prefix = B.Prefix(np.frombuffer(b"".join(texts), np.uint8))
        self.sums = prefix.sums.tolist()
        self.up = B._POWERS.upto(len(self.sums))[0][: len(self.sums)].tolist()
        self.base = np.cumsum([0, *map(len, texts)]).tolist()

    def common(self, i: int, j: int) -> int:
        """Length of the common prefix of texts i and j, verified byte by byte."""
        a, b, sums = self.base[i], self.base[j], self.sums
        ua, ub = self.up[a], self.up[b]
        lo, hi = 0, min(len(self.texts[i]), len(self.texts[j]))
        while lo < hi:
            mid = (lo + hi + 1) >> 1
            if (sums[a + mid] - sums[a]) * ub & B.MASK == (sums[b + mid] - sums[b]) * ua & B.MASK:
                lo = mid
            else:
                hi = mid - 1
        x, y = self.texts[i], self.texts[j]
        while x[:lo] != y[:lo]:  # a collision: the hashes agreed too far
            lo = next(k for k in range(lo) if x[k] != y[k])
        return lo

    def compare(self, i: int, j: int) -> int:
        n = self.common(i, j)
        x, y = self.texts[i][n : n + 1], self.texts[j][n : n + 1]
        return (x > y) - (x < y)

    def order(self) -> tuple[list[int], np.ndarray]:
        """Texts in order (a mergesort), and the common prefix of each with the one before."""
        order = sorted(range(len(self.texts)), key=cmp_to_key(self.compare))
        return order, np.array([0] + [self.common(a, b) for a, b in zip(order, order[1:], strict=False)])


def repeated(contexts: list[bytes], most: list[int], size: int) -> list[list[tuple[int, int]]]:
    """For each context of one anchor, ``most`` bytes into it, the ranges (from, to) of bytes before
    the anchor at which strings start that another context has too."""
    n = len(contexts)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    right, after = Suffixes([c[m:] for c, m in zip(contexts, most, strict=True)]).order()
    left, before = Suffixes([c[:m][::-1] for c, m in zip(contexts, most, strict=True)]).order()
    rank = np.empty(n, np.int64)
    rank[left] = np.arange(n)
    by_right = rank[right]
    table = [before]  # range minima of 2^k neighbours
    while 2 << len(table) - 1 <= n:
        w = 1 << len(table) - 1
        table.append(np.minimum(table[-1][:-w], table[-1][w:]))
    for o in np.unique(size - after[1:]).tolist():
        if o >= size:
            continue
        o = max(o, 0)
        run = np.cumsum(after < size - o)
        seq = np.lexsort((by_right, run))
        ranks, runs = by_right[seq], run[seq]
        together = runs[1:] == runs[:-1]
        a, b = ranks[:-1] + 1, ranks[1:] + 1
        agree = np.full(len(a), -1)
        for x in np.flatnonzero(together).tolist():
            k = int(b[x] - a[x]).bit_length() - 1
            agree[x] = min(table[k][a[x]], table[k][b[x] - (1 << k)])
        best = np.full(n, -1)
        np.maximum.at(best, seq[:-1], agree)
        np.maximum.at(best, seq[1:], agree)
        for x in np.flatnonzero(best >= o).tolist():
            out[right[x]].append((o, int(best[x])))
    return out


def _sorted_spans(rows: DataFrame, size: int) -> DataFrame:
    """(doc_id, mark, begin, end) of repeated strings among contexts, gathered by anchor."""

    def close(group: list, out: list) -> None:
        if len(group) > 1:
            ranges = repeated([g["bytes"] for g in group], [g["most"] for g in group], size)
            for g, found in zip(group, ranges, strict=True):
                for lo, hi in found:
                    lo, hi = max(lo, g["least"]), min(hi, g["most"])
                    if lo <= hi:
                        out.append((g["doc_id"], g["mark"], g["place"] - hi, g["place"] - lo + size))

    def work(batches):
        group: list = []
        for batch in batches:
            out: list = []
            for r in batch.to_pylist():
                if group and group[0]["key"] != r["key"]:
                    close(group, out)
                    group = []
                group.append(r)
            yield _spans(out)
        out = []
        close(group, out)
        yield _spans(out)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(work, "doc_id bigint, mark bigint, begin int, end int")


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "mark", "begin", "end"])


def _counted_spans(rows: DataFrame, size: int) -> DataFrame:
    """The same for anchors of very many contexts: every string by itself, counted by its digest."""

    def work(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                for o in range(r["least"], r["most"] + 1):
                    a = r["most"] - o
                    out.append((r["doc_id"], r["mark"], r["place"] - o, hashlib.blake2b(r["bytes"][a : a + size], digest_size=16).digest()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["doc_id", "mark", "begin", "string"])

    each = rows.mapInArrow(work, "doc_id bigint, mark bigint, begin int, string binary")
    many = each.groupBy("string").count().where(F.col("count") > 1).select("string")
    return each.join(many, "string", "left_semi").select("doc_id", "mark", "begin", (F.col("begin") + size).cast("int").alias("end"))


def spans(docs: DataFrame, size: int, largest: int = 4096) -> DataFrame:
    """(doc_id, mark, begin, end): bytes of repeated strings, for rows (doc_id, mark, text)."""
    every = cut_lineage(_listed(docs, size))
    # Most anchors are alone: only those that share their key go further.
    # (Written down, so that the join below is free to split a key of very many anchors.)
    shared = cut_lineage(every.groupBy("key").count().where(F.col("count") > 1).select("key"))
    listed = cut_lineage(every.join(shared, "key", "left_semi"))
    classes = listed.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "mark", "place")).alias("head"))
    classes = cut_lineage(classes)
    keys = classes.groupBy("key").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("kinds"), F.sum((F.col("n") == 1).cast("int")).alias("alone"))
    whole = listed.join(classes.where("n > 1").select(*CLASS), list(CLASS), "left_semi")
    whole = whole.select("doc_id", "mark", (F.col("place") - F.col("most")).alias("begin"), (F.col("place") - F.col("least") + size).cast("int").alias("end"))
    rest = classes.join(keys.where("kinds > 1 and alone > 0"), "key")
    rest = cut_lineage(rest.select("head.doc_id", "head.mark", "head.place", "key", "least", "most", "kinds"))
    with_bytes = cut_lineage(_contexts(docs, rest, size))
    fine = _sorted_spans(with_bytes.where(F.col("kinds") <= largest).drop("kinds"), size)
    hot = _counted_spans(with_bytes.where(F.col("kinds") > largest).drop("kinds"), size)
    return whole.unionByName(fine).unionByName(hot)


def _merge(found: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for b, e in sorted((s["begin"], s["end"]) for s in found):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [(b, e) for b, e in out]


def deduplicate(docs: DataFrame, size: int = 400, largest: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, removed, kept) of every row: maximal removed byte runs, and what is left."""
    B.arrow_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("doc_id", "text"))
    found = spans(docs, size, largest).withColumnRenamed("doc_id", "__id").withColumnRenamed("mark", "__mark").distinct()
    found = found.groupBy("__id", "__mark").agg(F.collect_list(F.struct("begin", "end")).alias("found"))
    same = (F.col("mark") == F.col("__mark")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    rows = docs.join(found, same, "left").select("doc_id", "text", F.coalesce("found", F.array().cast("array<struct<begin:int,end:int>>")).alias("found"))

    def work(batches):
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            sizes, removed, kept = [], [], []
            for text, parts in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
                raw, gone = text.encode(), _merge(parts)
                edges = [0, *(x for run in gone for x in run), len(raw)]
                sizes.append(len(raw))
                removed.append([{"begin": b, "end": e} for b, e in gone])
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    return rows.mapInArrow(work, "doc_id bigint, n_bytes bigint, removed array<struct<begin:int,end:int>>, kept binary")
