"""Ranked lexical search over buckets of documents of like length of their impact vectors.

A query is a bag of terms; a document's coordinate at a term is the term's weight times its integer
impact, and the score of a pair is their inner product. The search is exact:

1. Queries go in blocks of bounded size (``items``, ``bytes``). A block's terms are the only coordinates
   that matter, so a document is reduced to its counts of those terms, and written down once.
2. Documents are put in falling order of their vector's length and cut into ``CUTS`` ranges of length.
   The ranges are searched one after another; each ends with the k best so far of every query and so with
   a threshold for the next.
3. Within a task every ``BATCH`` documents, neighbours in length, are a bucket. By Cauchy-Schwarz a query
   whose length times the bucket's greatest is below its threshold skips the bucket. Otherwise its
   heaviest coordinates (the focus) are added up, and a document goes on only if that sum plus the most
   that the two remainders can give reaches the threshold (coordinate bound).
4. Survivors are scored again in 64-bit integers; a task keeps k a query, and the best of all tasks stay.

Bounds are on floating-point lengths with a margin far above their rounding; a pair that ties with the
threshold is kept. Weights, impacts and scores are the caller's integers, so results do not depend on the
order of work. Documents that share a term with no query are counted, but never compared.

Nulls: a null text has no terms; rows without an id are documents, and rank first among equal scores. Rows
that share a doc_id are documents of their own. Item rows that share an id are one item with the terms of
all its different texts. An item without terms, or an empty table, gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm import blocks as B
from attestra.session import cut_lineage

CUTS = (1 / 256, 1 / 16)  # shares of the longest vectors that are searched before the rest
BATCH = 4096
FOCUS = 0.8  # share of a query's squared length that its focus holds
MARGIN = 1e-9
COUNTS = "doc_id bigint, n bigint, terms array<int>, tfs array<int>"
VECTORS = "length double, doc_id bigint, terms array<int>, impacts array<int>"
FOUND = "query int, doc_id bigint, score bigint"

_SPLIT = bytes(b + 32 if 65 <= b < 91 else b if 0x30 <= b < 0x3A or 97 <= b < 123 or b >= 0x80 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of digits, letters and characters beyond ASCII, A-Z in lower case (as UTF-8)."""
    return text.translate(_SPLIT).split()


@dataclass
class Queries:
    """A block of queries: query q has terms ``terms[bounds[q]:bounds[q + 1]]``, ``times`` each."""

    names: list
    vocabulary: dict[bytes, int]
    bounds: np.ndarray
    terms: np.ndarray
    times: np.ndarray


def blocks_of_items(items: DataFrame, most: int, size: int) -> Iterator[Queries]:
    """The items as blocks of about ``most`` items and ``size`` bytes of different texts."""
    texts = items.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    total = texts.agg(F.count_distinct(F.coalesce(F.col("item_id").cast("string"), F.lit(""))), F.sum(F.octet_length("text"))).first()
    count = max(1, -(-total[0] // most), -(-(total[1] or 0) // size))
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(count)))
    if count > 1:
        dealt = cut_lineage(dealt)
    for i in range(count):
        found: dict = {}
        for item, text in dealt.where(F.col("block") == i).select("item_id", F.col("text").cast("binary")).toLocalIterator():
            bag = found.setdefault(item, {})
            for term in terms(bytes(text)):
                bag[term] = bag.get(term, 0) + 1
        found = {item: bag for item, bag in found.items() if bag}
        vocabulary = {t: j for j, t in enumerate(sorted({t for bag in found.values() for t in bag}))}
        names = sorted(found, key=lambda x: (x is not None, x))
        bags = [sorted((vocabulary[t], c) for t, c in found[name].items()) for name in names]
        flat = np.array([p for bag in bags for p in bag], np.int64).reshape(-1, 2)
        yield Queries(names, vocabulary, np.cumsum([0, *map(len, bags)]), flat[:, 0], flat[:, 1])


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Each document's number of terms and its counts of the vocabulary's terms."""
    spark = docs.sparkSession
    B.arrow_batches(spark)
    sent = spark.sparkContext.broadcast(vocabulary)

    def work(batches):
        known = sent.value
        for batch in batches:
            sizes, owner, found = [], [], []
            for i, text in enumerate(batch.column("text").cast(pa.large_binary()).to_pylist()):
                words = terms(text) if text else []
                sizes.append(len(words))
                hits = [known[w] for w in words if w in known]
                found.extend(hits)
                owner.append(len(hits))
            pairs = np.repeat(np.arange(len(owner)), owner) * np.int64(max(1, len(known))) + np.array(found, np.int64)
            pairs, tfs = np.unique(pairs, return_counts=True)
            rows, place = np.divmod(pairs, max(1, len(known)))
            cuts = pa.array(np.searchsorted(rows, np.arange(len(owner) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(v.astype(np.int32))) for v in (place, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    done = cut_lineage(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(work, COUNTS))
    sent.destroy()
    return done


def _lists(batch: pa.RecordBatch, *names: str) -> tuple[np.ndarray, ...]:
    """Offsets from 0 and values of list columns of equal lengths."""
    out = []
    for name in names:
        column = batch.column(name)
        cuts = np.asarray(column.offsets)
        if not out:
            out.append(cuts - cuts[0])
        out.append(np.asarray(column.values)[cuts[0] : cuts[-1]])
    return tuple(out)


def bm25_weights(df: np.ndarray, documents: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1)))."""
    return np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)


def bm25_impacts(n: np.ndarray, tf: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Integer impact of counts ``tf`` in documents of ``n`` terms; all else is 64-bit division rounding down."""
    m = 25 + (75 * n * documents) // max(1, total)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def vectors(counts: DataFrame, weights: np.ndarray, documents: int, total: int) -> DataFrame:
    """Impact vectors in falling order of length, equal lengths by id."""
    sent = counts.sparkSession.sparkContext.broadcast(weights)

    def work(batches):
        w = sent.value
        for batch in batches:
            cuts, place, tf = _lists(batch, "terms", "tfs")
            n = np.repeat(np.asarray(batch.column("n")), np.diff(cuts))
            impacts = bm25_impacts(n, tf.astype(np.int64), documents, total)
            squares = (w[place] * impacts.astype(float)) ** 2
            length = np.sqrt(np.add.reduceat(squares, cuts[:-1])) if len(squares) else np.zeros(batch.num_rows)
            column = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(impacts.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(length), batch.column("doc_id"), batch.column("terms"), column], ["length", "doc_id", "terms", "impacts"])

    order = [F.desc("length"), F.asc("doc_id")]
    found = counts.where(F.size("terms") > 0).mapInArrow(work, VECTORS).where(F.col("length") > 0)
    done = cut_lineage(found.repartitionByRange(*order).sortWithinPartitions(*order))
    sent.destroy()
    return done


class _Bucket:
    """Documents of like length, by coordinate."""

    def __init__(self, batch: pa.RecordBatch, weights: np.ndarray):
        self.cuts, place, self.impacts = _lists(batch, "terms", "impacts")
        self.rows, self.place = batch.num_rows, place
        self.length = np.asarray(batch.column("length"))
        ids = batch.column("doc_id")
        self.valid = np.asarray(ids.is_valid())
        self.ids = np.where(self.valid, np.asarray(ids.fill_null(0)), np.iinfo(np.int64).min)
        owner = np.repeat(np.arange(self.rows, dtype=np.int32), np.diff(self.cuts))
        order = np.argsort(place, kind="stable")
        self.owner = owner[order]
        self.value = weights[place[order]] * self.impacts[order].astype(np.int64)
        self.present, first = np.unique(place[order], return_index=True)
        self.first = np.append(first, len(order))

    def postings(self, wanted: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents that hold the wanted coordinates, their values there, and the query's times."""
        at = np.searchsorted(self.present, wanted)
        there = at < len(self.present)
        there[there] = self.present[at[there]] == wanted[there]
        at, times = at[there], times[there]
        sizes = self.first[at + 1] - self.first[at]
        index = np.repeat(self.first[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return self.owner[index], self.value[index], np.repeat(times, sizes)


def _focus(weights: np.ndarray, places: np.ndarray, times: np.ndarray) -> np.ndarray:
    """A query's coordinates in falling order of what they can give, and how many are its focus."""
    order = np.argsort(-(weights[places] * times), kind="stable")
    share = np.cumsum(times[order].astype(float) ** 2)
    return order, int(np.searchsorted(share, FOCUS * share[-1])) + 1


def searched(docs: DataFrame, queries: Queries, weights: np.ndarray, floor: np.ndarray, k: int) -> DataFrame:
    """Per task at most k documents a query, all that could be among the best of these documents."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    sent = docs.sparkSession.sparkContext.broadcast((queries.bounds, queries.terms, queries.times, weights, floor))

    def work(batches):
        bounds, places, times, w, least = sent.value
        least = least.copy()
        plans = []
        for q in range(len(bounds) - 1):
            cut = slice(bounds[q], bounds[q + 1])
            order, focus = _focus(w, places[cut], times[cut])
            t, c = places[cut][order], times[cut][order]
            plans.append((t, c, focus, np.sqrt(float((c.astype(float) ** 2).sum())), np.sqrt(float((c[focus:].astype(float) ** 2).sum()))))
        lengths = np.array([p[3] for p in plans])
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in plans]
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = _Bucket(batch, w)
            alive = np.flatnonzero(lengths * bucket.length.max() * (1 + MARGIN) >= least)
            for q in alive.tolist():
                t, c, focus, _, rest = plans[q]
                who, value, n = bucket.postings(t[:focus], c[:focus])
                partial = np.bincount(who, value * n.astype(float), bucket.rows)
                held = np.bincount(who, value.astype(float) ** 2, bucket.rows)
                open_ = np.sqrt(np.maximum(bucket.length**2 * (1 + MARGIN) - held, 0))
                keep = partial + rest * open_ * (1 + MARGIN) >= least[q] * (1 - MARGIN)
                who, value, n = bucket.postings(t, c)
                on = keep[who]
                score = np.zeros(bucket.rows, np.int64)
                np.add.at(score, who[on], value[on] * n[on])
                rows = np.flatnonzero(score >= max(1, least[q]))
                if not len(rows):
                    continue
                ids, scores = np.concatenate([best[q][0], bucket.ids[rows]]), np.concatenate([best[q][1], score[rows]])
                top = np.lexsort((ids, -scores))[:k]
                best[q] = ids[top], scores[top]
                if len(top) == k:
                    least[q] = max(least[q], scores[top[-1]])
        out = [(q, i, s) for q, (ids, scores) in enumerate(best) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]
        q, ids, scores = (np.array(c, np.int64) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        missing = ids == np.iinfo(np.int64).min
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(ids, pa.int64(), mask=missing), pa.array(scores)], ["query", "doc_id", "score"])

    return docs.mapInArrow(work, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(items: DataFrame, docs: DataFrame, k: int = 10, most_items: int = 4096, most_bytes: int = 16 << 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item.

    What reaches the driver is bounded by a block: its items, terms and k results each.
    """
    spark = docs.sparkSession
    results, kind = [], dict(items.dtypes)["item_id"]
    totals = None
    for queries in blocks_of_items(items, most_items, most_bytes):
        if not queries.names:
            continue
        counts = counted(docs, queries.vocabulary)
        if totals is None:
            totals = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        documents, total = int(totals[0]), int(totals[1])
        df = np.zeros(len(queries.vocabulary), np.int64)
        for term, n in counts.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            df[term] = n
        weights = bm25_weights(df, documents)
        ordered = vectors(counts, weights, documents, total)
        edges = ordered.agg(F.percentile_approx("length", F.array(*[F.lit(1 - c) for c in CUTS]), 10000)).first()[0] or []
        limits = [None, *dict.fromkeys(edges), None]
        least, best = np.zeros(len(queries.names), np.int64), None
        for high, low in zip(limits, limits[1:], strict=False):
            part = ordered if low is None else ordered.where(F.col("length") >= low)
            part = part if high is None else part.where(F.col("length") < high)
            found = searched(part, queries, weights, least, k)
            best = cut_lineage(_best(found if best is None else best.drop("rank").unionByName(found), k))
            for q, n, score in best.groupBy("query").agg(F.count(F.lit(1)), F.min("score")).toLocalIterator():
                least[q] = score if n == k else 0
        names = spark.createDataFrame(list(enumerate(queries.names)), f"query int, item_id {kind}")
        results.append(best.join(names, "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    if not results:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    while len(results) > 1:
        results = [a.unionByName(b) for a, b in zip(results[::2], results[1::2], strict=False)] + results[len(results) & ~1 :]
    return results[0]
