"""N-gram Jaccard join by vertical partitioning, and the components of its links.

A document's set is its distinct word shingles. The n-grams have one global order, rare ones first;
rarity is counted over all texts in a table of ``CELLS`` cells, so it is approximate where n-grams
share a cell, which changes the order and never a result. Two sets of similarity t share an n-gram
among the first |A| - ceil(t |A|) + 1 of either, so documents meet on those, under the length bound
and the positional bound. The order is then cut at pivots into ``fragments`` of about equal weight;
for every pair that met, each fragment's overlap is counted by itself, and the counts are summed.
Before sets are fetched for that, a pair goes if the two sets' parity bitmaps show that they differ in
more members than linked sets can.

Only components are wanted of the links, so a pair whose documents are known to be connected needs
no count. First, equal sets are one node. Then, in ``chains`` rounds, each n-gram's documents are
put in an order (first one order for all n-grams, then a random one for each) and each is compared
with its next one, later its next few; links found are contracted. Last,
every remaining pair of different components that meets on an n-gram is compared: documents outside
an n-gram's largest component against all of its documents, under a bound by short parity bitmaps
that are held where they meet. So a large group of near copies is
connected by few comparisons and never multiplied out, and no link between components is lost.

Null and wordless texts have no shingles and link with nothing. Rows that share a doc_id are one
document: their links are united, and each row carries its own n_shingles. Rows without an id have no
component. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm import blocks as B
from attestra.llm.graph import components
from attestra.session import cut_lineage

CELLS = 1 << 20
SLICES = 32
FILTER_BITS = 1 << 23
SIGN = 16  # 64-bit words of a set's signature
FOLD = 4  # of those that go along with its n-grams; a divisor of SIGN
NEXT = 3
SEEN = 100_000


def shingles(block: B.Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, and bounds by text."""
    data = B.LOWER[block.data]
    words = B.runs(B.NOT_SPACE[data], block.cuts)
    keys, _, bounds = B.windows(B.Prefix(data).of(words.begin, words.end), words.bounds, k)
    owner = np.repeat(np.arange(block.rows), np.diff(bounds))
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner = keys[new], owner[new]
    return keys, np.searchsorted(owner, np.arange(block.rows + 1))


def _digest(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set."""
    total = np.zeros(len(keys) + 1, np.uint64)
    np.cumsum(B.mix(keys ^ np.uint64(0x1F3D5B79)), out=total[1:])
    return B.mix((total[bounds[1:]] - total[bounds[:-1]]) ^ B.mix(np.diff(bounds).astype(np.uint64))).view(np.int64)


def _cell(keys: np.ndarray) -> np.ndarray:
    return (B.mix(keys ^ np.uint64(0x5851F42D)) & np.uint64(CELLS - 1)).astype(np.int64)


def _signature(keys: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A parity bitmap of each set: two sets differ in at least as many members as their bitmaps do in bits."""
    h = B.mix(keys ^ np.uint64(0x2545F491))
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    bits = np.bincount(owner * (64 * SIGN) + (h & np.uint64(64 * SIGN - 1)).astype(np.int64), minlength=(len(bounds) - 1) * 64 * SIGN) & 1
    words = np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)
    return pa.FixedSizeListArray.from_arrays(pa.array(words), SIGN).cast(pa.list_(pa.int64()))


def sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, node, check, sign) of every row; equal sets have equal nodes. ``check`` is a
    second digest, by which a collision of the first would show."""

    def work(batches):
        for batch in batches:
            for block in B.blocks(batch):
                keys, bounds = shingles(block, k)
                check = _digest(B.mix(keys), bounds)
                columns = [batch.column("doc_id").slice(block.lo, block.rows), pa.array(np.diff(bounds)), pa.array(_digest(keys, bounds)), pa.array(check), _signature(keys, bounds)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "node", "check", "sign"])

    return docs.mapInArrow(work, "doc_id bigint, n_shingles bigint, node bigint, check bigint, sign array<bigint>")


def cell_counts(docs: DataFrame, k: int) -> np.ndarray:
    """How many shingles of all sets fall in each cell. Tasks send dense slices, which are summed as
    they stream by; CELLS numbers reach the driver."""
    width = CELLS // SLICES

    def count(batches):
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for block in B.blocks(batch):
                total += np.bincount(_cell(shingles(block, k)[0]), minlength=CELLS)
        parts = total.astype(np.uint32).reshape(SLICES, width)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "cells"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, cells in zip(batch.column("slice").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                total.setdefault(s, np.zeros(width, np.int64))
                total[s] += np.frombuffer(cells, np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["slice", "cells"])

    schema = "slice int, cells binary"
    rows = docs.mapInArrow(count, schema).repartition(SLICES, "slice").mapInArrow(add, schema).collect()
    out = np.zeros((SLICES, width), np.int64)
    for r in rows:
        out[r["slice"]] += np.frombuffer(r["cells"], np.int64)
    return np.minimum(out.ravel(), (1 << 31) - 1).astype(np.uint32)


def _rank(keys: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Place in the global order: cell count first, then the hash."""
    return cells[_cell(keys)].astype(np.uint64) << np.uint64(32) | keys >> np.uint64(32)


def pivots(cells: np.ndarray, fragments: int) -> np.ndarray:
    """Ranks that cut the order into fragments of about equal weight: the cells' counts are that
    weight, and hashes spread evenly within a count."""
    weight = np.bincount(np.minimum(cells, 1 << 20), weights=cells)
    total = np.concatenate(([0.0], np.cumsum(weight)))
    out = []
    for i in range(1, fragments):
        want = total[-1] * i / fragments
        c = int(np.searchsorted(total, want, "right")) - 1
        share = (want - total[c]) / max(weight[min(c, len(weight) - 1)], 1.0)
        out.append((c << 32) + int(min(share, 1.0) * ((1 << 32) - 1)))
    return np.array(out, np.uint64)


def prefixes(docs: DataFrame, cells: Broadcast, k: int, percent: int) -> DataFrame:
    """(key, node, at, n): the shingles of each set's necessary prefix, their place and the set's
    size. A task sends a set it has seen lately once only; copies of other tasks are left to distinct."""

    def work(batches):
        seen: set[int] = set()
        ranks = cells.value
        for batch in batches:
            for block in B.blocks(batch):
                keys, bounds = shingles(block, k)
                n = np.diff(bounds)
                owner = np.repeat(np.arange(block.rows), n)
                order = np.lexsort((keys, _rank(keys, ranks), owner))
                node = _digest(keys, bounds)
                fresh = np.zeros(block.rows, bool)
                for i, d in enumerate(node.tolist()):
                    if d not in seen:
                        fresh[i] = True
                        seen.add(d)
                if len(seen) > SEEN:
                    seen.clear()
                keys = keys[order]
                at = np.arange(len(keys)) - np.repeat(bounds[:-1], n)
                size = n[owner]
                take = (at < size + (-percent * size) // 100 + 1) & fresh[owner]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (keys[take].view(np.int64), node[owner[take]], at[take].astype(np.int32), size[take].astype(np.int32))], ["key", "node", "at", "n"]
                )

    return docs.select("text").mapInArrow(work, "key bigint, node bigint, at int, n int")


def _bit(doc: np.ndarray) -> np.ndarray:
    return (B.mix(doc.astype(np.int64).view(np.uint64) + B.STEP) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _filter(heads: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over doc_id; at most FILTER_BITS / 64 rows reach the driver."""

    def work(batches):
        for batch in batches:
            bit = _bit(batch.column("doc_id").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(bit >> 6), pa.array((bit & 63).astype(np.int32))], ["at", "b"])

    rows = heads.select("doc_id").mapInArrow(work, "at bigint, b int").groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS >> 6, np.int64)
    out[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def _segments(docs: DataFrame, heads: DataFrame, cells: Broadcast, cuts: np.ndarray, k: int) -> DataFrame:
    """(node, parts) of the given heads (node, doc_id), and of a few others that the bitmap lets
    through: a set's n-grams, fragment by fragment. A row that is repeated gives its set again."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter(heads))
    parts = len(cuts) + 1

    def work(batches):
        known, ranks = bits.value, cells.value
        for batch in batches:
            bit = _bit(batch.column("doc_id").to_numpy())
            batch = batch.filter(pa.array((known[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)))  # the others are not even cut into shingles
            for block in B.blocks(batch):
                keys, bounds = shingles(block, k)
                node, wanted = _digest(keys, bounds), np.diff(bounds) > 0
                owner = np.repeat(np.cumsum(wanted) - 1, np.diff(bounds))
                mine = np.repeat(wanted, np.diff(bounds))
                keys, owner = keys[mine], owner[mine]
                part = owner * parts + np.searchsorted(cuts, _rank(keys, ranks), "right")
                order = np.argsort(part, kind="stable")
                rows = int(wanted.sum())
                inner = np.searchsorted(part[order], np.arange(rows * parts + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(inner), pa.array(keys[order].view(np.int64)))
                outer = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * parts), lists)
                yield pa.RecordBatch.from_arrays([pa.array(node[wanted]), outer], ["node", "parts"])

    done = cut_lineage(docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(work, "node bigint, parts array<array<bigint>>"))
    bits.destroy()
    return done


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose signatures leave room for a link: sets of similarity p / 100 differ in at most
    (100 - p) / (100 + p) of the sum of their sizes."""
    for side in "ab":
        pairs = pairs.join(classes.select(F.col("node").alias(side), F.col("sign").alias(f"s{side}")), side)
    return pairs.where(_close([(F.get("sa", F.lit(i)), F.get("sb", F.lit(i))) for i in range(SIGN)], percent)).select("a", "b", "na", "nb")


def _close(words: list[tuple[Column, Column]], percent: int) -> Column:
    """Whether two parity bitmaps, word by word, leave room for a link of sets of sizes na and nb."""
    apart = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in words), F.lit(0))
    return apart * (100 + percent) <= (100 - percent) * (F.col("na") + F.col("nb"))


def _folded(sign: Column) -> list[Column]:
    """A signature in FOLD words; parities of parities, so it bounds the difference of two sets too."""
    return [reduce(Column.bitwiseXOR, [F.get(sign, F.lit(i)) for i in range(j, SIGN, FOLD)]) for j in range(FOLD)]


def _linked(docs: DataFrame, pairs: DataFrame, classes: DataFrame, cells: Broadcast, cuts: np.ndarray, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link: the overlap of every fragment is counted by itself, and summed for each pair."""
    pairs = cut_lineage(_likely(pairs, classes, percent))
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    # Both joins are on the node alone, so that one dealing of the sets serves them both.
    dealt = _segments(docs, classes.select("node", "doc_id").join(ends, "node", "left_semi"), cells, cuts, k).repartition("node")
    left = dealt.select(F.col("node").alias("a"), F.col("parts").alias("pa"))
    right = dealt.select(F.col("node").alias("b"), F.col("parts").alias("pb"))
    counts = [F.size(F.array_intersect(F.get("pa", F.lit(i)), F.get("pb", F.lit(i)))) for i in range(len(cuts) + 1)]
    total = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", sum(counts[1:], counts[0]).alias("n"))
    return total.where(100 * F.col("n") >= percent * (F.col("na") + F.col("nb") - F.col("n"))).select("a", "b").distinct()


def _reachable(percent: int):
    """Length and positional bounds on a meeting of two sets (na, pa) and (nb, pb)."""
    na, nb = F.col("na"), F.col("nb")
    long_enough = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    rest = 1 + F.least(na - F.col("pa") - 1, nb - F.col("pb") - 1)
    return long_enough & (rest * (100 + percent) >= percent * (na + nb))


def _ordered(meetings: DataFrame, percent: int) -> DataFrame:
    swap = F.col("a") > F.col("b")
    return (
        meetings.where((F.col("a") != F.col("b")) & _reachable(percent))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb"))
        .distinct()
    )


def similar(docs: DataFrame, k: int = 5, percent: int = 80, fragments: int = 4, chains: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``: documents link when their sets'
    Jaccard similarity is at least ``percent`` / 100."""
    B.arrow_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    base = cut_lineage(sets(docs, k))
    full = base.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    digested = full.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("check").alias("lo"), F.max("check").alias("hi"), *[F.min(F.get("sign", F.lit(i))).alias(f"s{i}") for i in range(SIGN)])
    sure = F.when(F.col("lo") == F.col("hi"), F.col("node")).otherwise(F.raise_error(F.lit("two sets of one digest")).cast("bigint"))
    classes = cut_lineage(digested.select(sure.alias("node"), "doc_id", F.array(*[f"s{i}" for i in range(SIGN)]).alias("sign")))
    counts = cell_counts(docs, k)
    cuts = pivots(counts, fragments)
    cells = docs.sparkSession.sparkContext.broadcast(counts)

    # Dealt by key once: distinct and the count of each key's sets work in that partitioning.
    met = prefixes(docs.where(F.col("doc_id").isNotNull()), cells, k, percent).repartition("key").distinct()
    by_key = Window.partitionBy("key")
    met = cut_lineage(met.withColumn("met", F.count(F.lit(1)).over(by_key)).where(F.col("met") > 1).drop("met"))
    roots = None

    def rooted(rows: DataFrame) -> DataFrame:
        """Rows of n-grams whose documents are of more than one component so far."""
        if roots is None:
            return rows.withColumn("root", F.col("node"))
        rows = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        ends = rows.withColumn("lo", F.min("root").over(by_key)).withColumn("hi", F.max("root").over(by_key))
        return ends.where(F.col("lo") != F.col("hi")).drop("lo", "hi")

    compared: list[DataFrame] = []

    def extend(pairs: DataFrame) -> DataFrame:
        """Components with the links among pairs that were not compared before."""
        if compared:
            pairs = pairs.join(reduce(DataFrame.unionByName, [c.select("a", "b") for c in compared]), ["a", "b"], "left_anti")
        compared.append(cut_lineage(pairs))
        fresh = _linked(docs, compared[-1], classes, cells, cuts, k, percent)
        return components(cut_lineage(fresh), roots)

    for i in range(chains):
        by = [F.xxhash64("node")] if i == 0 else [F.xxhash64(F.lit(i), "key", "node")]
        order = by_key.orderBy(*by, "node")
        fields = {"b": "node", "rb": "root", "pb": "at", "nb": "n"}
        ahead = [F.struct(*[F.lead(c, j).over(order).alias(a) for a, c in fields.items()]) for j in range(1, 2 if i == 0 else NEXT + 1)]
        near = rooted(met).withColumn("next", F.array(*ahead))
        near = near.select(F.col("node").alias("a"), F.col("root").alias("ra"), F.col("at").alias("pa"), F.col("n").alias("na"), F.explode("next").alias("x"))
        near = near.select("a", "ra", "pa", "na", "x.*").where(F.col("b").isNotNull() & (F.col("ra") != F.col("rb")))
        roots = extend(_ordered(near, percent))

    # Signatures go along, so that most pairs are dropped where they meet.
    signs = [f"s{j}" for j in range(FOLD)]
    short = classes.select("node", *[c.alias(n) for c, n in zip(_folded(F.col("sign")), signs, strict=True)])
    rows = cut_lineage(rooted(met).join(short, "node"))
    largest = rows.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("major"))
    minor = rows.join(largest, "key").where(F.col("root") != F.col("major"))
    minor = minor.select("key", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("at").alias("pa"), F.col("n").alias("na"), *[F.col(c).alias(f"{c}a") for c in signs])
    every = rows.select("key", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("at").alias("pb"), F.col("n").alias("nb"), *[F.col(c).alias(f"{c}b") for c in signs])
    close = _close([(F.col(f"{c}a"), F.col(f"{c}b")) for c in signs], percent)
    roots = extend(_ordered(minor.join(every, "key").where((F.col("ra") != F.col("rb")) & _reachable(percent) & close), percent))

    # Rows of one doc_id are one document: its sets are linked.
    own = full.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where(F.col("a") != F.col("z"))
    own = full.join(own, "doc_id").select("a", F.col("node").alias("b")).where(F.col("a") != F.col("b")).distinct()
    named = classes.select("node", "doc_id").join(components(own, roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component"))
    named = named.join(least, "root").select("node", "component")
    out = base.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    alone = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), alone).alias("component_id"))


def representatives(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, its smallest doc_id (ties: the smallest text, null and empty ones last); rows without an id
    stay. All columns as they were."""
    found = similar(docs, k, percent)
    heads = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__id")).distinct()
    kept = docs.join(heads, F.col("doc_id").cast("bigint") == F.col("__id"))
    first = Window.partitionBy("__id").orderBy(F.coalesce(F.length("text"), F.lit(0)) == 0, F.col("text").asc_nulls_last())
    kept = kept.withColumn("__n", F.row_number().over(first)).where(F.col("__n") == 1)
    return kept.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
