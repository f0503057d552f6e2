"""Benchmark decontamination as a prefix-filtered set join.

An item's window is ``window`` consecutive words (a shorter item is one window), seen as a set of
word shingles. A window is contained in a text only if all its shingles are, so for exact
containment the necessary prefix of the set, ordered by rarity in the corpus, is its single rarest
shingle. Texts are probed for those shingles alone, the join on the shingle applies the length bound
(the text has as many words as the window) and the positional bound (the window fits where the
shingle stands), and the words of the item-sized window around it are compared one by one.

Probing uses a bitmap of fixed size (``FILTER_BITS``), whatever the benchmark's size; a larger
benchmark makes it less selective, never wrong. The joins themselves are on hashes and shuffle.

Null and wordless texts and items have no windows: 0 hits, not contaminated. Items without an id
are ignored, repeated items count once, repeated document rows are judged each by itself. Empty
tables give 0 hits or an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm import blocks as B
from attestra.session import cut_lineage

FILTER_BITS = 1 << 22
_WORD_BITS = 6


def _words(block: B.Block) -> tuple[np.ndarray, B.Words, np.ndarray]:
    data = B.LOWER[block.data]
    words = B.runs(B.LETTER_DIGIT[data], block.cuts)
    return data, words, B.Prefix(data).of(words.begin, words.end)


def _joined(data: np.ndarray, words: B.Words, lo: int, hi: int) -> str:
    return " ".join(data[words.begin[i] : words.end[i]].tobytes().decode() for i in range(lo, hi))


def item_windows(items: DataFrame, window: int = 13, shingle: int = 5) -> DataFrame:
    """(item_id, body, size, place, span, key): every shingle of every window of every item.

    ``body`` is the window's words, ``place`` the shingle's first word in it, ``span`` its words.
    """

    def work(batches):
        for batch in batches:
            ids = batch.column("item_id").to_pylist()
            for block in B.blocks(batch):
                data, words, hashes = _words(block)
                out = []
                for i in range(block.rows):
                    a, n = int(words.bounds[i]), int(words.counts[i])
                    size = min(window, n)
                    span = min(shingle, size)
                    if not n:
                        continue
                    keys, _, _ = B.windows(hashes[a : a + n], np.array([0, n]), span)
                    for first in range(n - size + 1):
                        body = _joined(data, words, a + first, a + first + size)
                        out += [(ids[block.lo + i], body, size, p, span, int(keys[first + p].view(np.int64))) for p in range(size - span + 1)]
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("item_id", "body", "size", "place", "span", "key"), r, strict=True)) for r in out],
                    pa.schema([("item_id", pa.string()), ("body", pa.string()), ("size", pa.int32()), ("place", pa.int32()), ("span", pa.int32()), ("key", pa.int64())]),
                )

    rows = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    return rows.mapInArrow(work, "item_id string, body string, size int, place int, span int, key bigint")


def bitmap(keys: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, those of the keys set: at most FILTER_BITS / 64 rows reach the driver."""
    bit = F.pmod(F.col("key"), F.lit(FILTER_BITS))
    rows = (
        keys.select(F.shiftright(bit, _WORD_BITS).alias("at"), F.pmod(bit, F.lit(64)).cast("int").alias("b"))
        .groupBy("at")
        .agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"))
        .toPandas()
    )
    out = np.zeros(FILTER_BITS >> _WORD_BITS, np.int64)
    out[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _probe(block: B.Block, spans: list[int], marked: np.ndarray):
    """(words, data, [(span, key, first word)]) of the block's shingles that are in the bitmap."""
    data, words, hashes = _words(block)
    found = []
    for span in spans:
        keys, first, _ = B.windows(hashes, words.bounds, span, short=False)
        hit = marked[(keys & np.uint64(FILTER_BITS - 1)).astype(np.int64)]
        found.append((span, keys[hit], first[hit]))
    return data, words, found


def shingle_counts(docs: DataFrame, spans: list[int], marked: np.ndarray) -> DataFrame:
    """(key, n): how often the marked shingles occur in all texts."""

    def work(batches):
        for batch in batches:
            for block in B.blocks(batch):
                _, _, found = _probe(block, spans, marked)
                keys, n = np.unique(np.concatenate([k for _, k, _ in found]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    return docs.select("text").mapInArrow(work, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def rarest(shingles: DataFrame, counts: DataFrame) -> DataFrame:
    """The necessary prefix of each window that can occur: its rarest shingle (ties: smaller key)."""
    needed = math.ceil(1.0)  # containment 1: prefix of |set| - |set| + 1 shingles
    ranked = shingles.join(counts, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = ranked.groupBy("item_id", "body").agg(F.min(F.struct("n", "key", "place", "size", "span")).alias("s"))
    return best.where(F.col("s.n") >= needed).select("item_id", "body", "s.key", "s.place", "s.size", "s.span")


def mark() -> Column:
    """A hash of id and text, by which a verdict finds its rows again, also those without an id."""
    return F.xxhash64("doc_id", "text")


def _candidates(docs: DataFrame, spans: list[int], marked: np.ndarray, window: int) -> DataFrame:
    """(doc_id, mark, n_words, found): for every text its marked shingles, each with the words around."""
    kind = pa.list_(pa.struct([("key", pa.int64()), ("span", pa.int32()), ("at", pa.int32()), ("lead", pa.int32()), ("near", pa.string())]))

    def work(batches):
        for batch in batches:
            for block in B.blocks(batch):
                data, words, found = _probe(block, spans, marked)
                lists: list[list] = [[] for _ in range(block.rows)]
                for span, keys, first in found:
                    text = np.searchsorted(words.bounds, first, "right") - 1
                    for key, at, i in zip(keys.view(np.int64).tolist(), first.tolist(), text.tolist(), strict=True):
                        lo, hi = int(words.bounds[i]), int(words.bounds[i + 1])
                        begin, end = max(lo, at - window + span), min(hi, at + window)
                        lists[i].append({"key": key, "span": span, "at": at - lo, "lead": at - begin, "near": _joined(data, words, begin, end)})
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(block.lo, block.rows) for c in ("doc_id", "mark")), pa.array(words.counts.astype(np.int64)), pa.array(lists, kind)],
                    ["doc_id", "mark", "n_words", "found"],
                )

    schema = "doc_id bigint, mark bigint, n_words bigint, found array<struct<key bigint, span int, at int, lead int, near string>>"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), mark().alias("mark"), "text").mapInArrow(work, schema)


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, shingle: int = 5, share: int = 20) -> DataFrame:
    """(row, doc_id, mark, n_words, n_hit, items, contaminated) for every row of ``docs``.

    ``n_hit`` counts words inside any occurrence of a window; a text is contaminated when it has a
    hit and ``share`` times the hits reach its words. ``items`` are the ids, sorted as strings.
    """
    B.arrow_batches(docs.sparkSession)
    shingles = cut_lineage(item_windows(items, window, shingle))
    spans = sorted(r["span"] for r in shingles.select("span").distinct().collect())  # at most ``shingle`` values
    if not spans:
        spans = [shingle]
    counts = shingle_counts(docs, spans, bitmap(shingles))
    prefix = cut_lineage(rarest(shingles, counts))
    probed = _candidates(docs, spans, bitmap(prefix), window).withColumn("row", F.monotonically_increasing_id())
    probed = cut_lineage(probed)
    windows = prefix.select("body", "key", "place", "size", "span").distinct()
    seen = probed.where(F.size("found") > 0).select("row", "n_words", F.explode("found").alias("f")).select("row", "n_words", "f.*")
    begin = F.col("at") - F.col("place")
    fits = (begin >= 0) & (begin + F.col("size") <= F.col("n_words")) & (F.col("size") <= F.col("n_words"))
    same = F.expr("array_join(slice(split(near, ' '), lead - place + 1, size), ' ') = body")
    hits = (
        seen.join(windows, ["key", "span"])
        .where(fits & (F.col("lead") >= F.col("place")))
        .where(same)
        .select("row", "body", begin.alias("begin"), (begin + F.col("size")).alias("end"))
    )
    hits = cut_lineage(hits)
    spots = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spots"))
    covered = F.expr(
        "aggregate(spots, named_struct('n', 0L, 'to', 0), "
        "(s, x) -> named_struct('n', s.n + greatest(0, x.end - greatest(x.begin, s.to)), 'to', greatest(s.to, x.end)), s -> s.n)"
    )
    named = hits.select("row", "body").distinct().join(prefix.select("body", "item_id").distinct(), "body")
    named = named.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    found = spots.select("row", covered.alias("n_hit")).join(named, "row")
    return (
        probed.select("row", "doc_id", "mark", "n_words")
        .join(found, "row", "left")
        .withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("bigint")))
        .withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
    )


def clean(docs: DataFrame, items: DataFrame, window: int = 13, shingle: int = 5, share: int = 20) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all their columns as they were."""
    bad = contamination(docs, items, window, shingle, share).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    same = (mark() == F.col("__mark")) & F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id"))
    return docs.join(bad, same, "left_anti")
