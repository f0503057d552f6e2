"""A positional word index of texts, for phrase and substring search without reading a text again.

The index is a table of postings in segments. A segment inverts at most ``SEGMENT_WORDS`` words of one
task's rows, or one longer row: for each word the rows that hold it, how often, and at which places, all three delta-coded.
So a word that is in every text has one bounded posting a segment, and whatever happens at a word's
places happens segment by segment, spread over the cluster. Postings of a segment are sorted by word,
so a look-up of a few words skips the other row groups; ``buckets`` deals them by word into one folder
each, for an index that is kept and asked often.

Words are maximal runs of letters and digits in lower case. A text may come in regions (say title with
passage, then snippet); a phrase lies within one region. Rows with a null text have no words. Ids should
be unique; rows that share one are found as that id. An empty table gives an empty index.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.session import cut_lineage

SEGMENT_WORDS = 500_000
BATCH_ROWS = 512
REGION = 1 << 28  # places of the next region begin this much later; no phrase spans two
GRAM = 3

POSTINGS = "word string, segment bigint, n int, rows binary, counts binary, places binary, ids array<string>"


@dataclass
class TextIndex:
    """``postings`` (one row a word and segment) and ``names`` (the ids of each segment's rows)."""

    postings: DataFrame
    names: DataFrame
    id_type: str
    buckets: int | None = None

    def of_words(self, wanted: DataFrame) -> DataFrame:
        """Rows of ``wanted`` (word, ...) with the postings of their words."""
        if self.buckets:
            wanted = wanted.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(self.buckets)).cast("int"))
            return self.postings.join(wanted, ["bucket", "word"]).drop("bucket")
        return self.postings.join(wanted, "word")

    def named(self, hits: DataFrame, id_col: str) -> DataFrame:
        """Hits (..., segment, rows) as one row an id."""
        at = F.transform("rows", lambda r: F.get("ids", r))
        flat = hits.join(self.names, "segment").withColumn("_id", F.explode(at))
        return flat.withColumn(id_col, F.col("_id").cast(self.id_type)).drop("segment", "rows", "ids", "_id")


def words_of(text: Column) -> Column:
    key = T.title_key(F.coalesce(text, F.lit("")))
    return F.when(key == "", F.array().cast("array<string>")).otherwise(F.split(key, " "))


def _inverted(ids: pa.Array, words: pa.Array, sizes: np.ndarray, firsts: list[np.ndarray], segment: int) -> pa.RecordBatch:
    """A segment's postings. ``sizes`` words belong to each row, ``firsts[r]`` of them to its regions up to r."""
    coded = words.dictionary_encode()
    code = np.asarray(coded.indices)
    row = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    place = np.arange(len(code), dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    late = np.zeros(len(code), np.int64)
    for first in firsts:
        late += (place >= np.repeat(first, sizes)) * np.int64(REGION)
    place += late
    order = np.argsort(code, kind="stable")
    code, row, place = code[order], row[order], place[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    pair = np.flatnonzero(new)  # a word in a row
    counts = np.diff(np.append(pair, len(code)))
    head = np.ones(len(pair), bool)
    head[1:] = code[pair][1:] != code[pair][:-1]
    start = np.flatnonzero(head)  # a word
    steps = np.diff(row[pair], prepend=0)
    steps[head] = row[pair][head]
    gaps = np.diff(place, prepend=0)
    gaps[new] = place[new]
    pair_cuts = np.append(start, len(pair))
    place_cuts = np.append(pair, len(code))[pair_cuts]
    terms = coded.dictionary.take(pa.array(code[pair][start])) if len(start) else pa.array([], pa.string())
    by_word = np.argsort(np.asarray(terms.to_numpy(zero_copy_only=False), object), kind="stable") if len(start) else np.zeros(0, np.int64)

    def packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
        data = pa.py_buffer(values.astype("<u4").tobytes())
        return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer((4 * cuts).astype(np.int64).tobytes()), data]).take(pa.array(by_word)).cast(pa.binary())

    n = len(start)
    columns = [terms.take(pa.array(by_word)).cast(pa.string()), pa.array(np.full(n, segment)), pa.array(np.diff(pair_cuts)[by_word].astype(np.int32))]
    columns += [packed(steps, pair_cuts), packed(counts, pair_cuts), packed(gaps, place_cuts), pa.nulls(n, pa.list_(pa.string()))]
    names = [pa.array([None], pa.string()), pa.array([segment]), pa.array([len(sizes)], pa.int32()), *[pa.nulls(1, pa.binary())] * 3]
    names.append(pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.cast(pa.string())))
    return pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(columns, names, strict=True)], ["word", "segment", "n", "rows", "counts", "places", "ids"])


def _small_batches(spark: SparkSession) -> None:
    """Small Arrow batches: rows with whole texts or postings make large ones otherwise."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def build(rows: DataFrame, id_col: str, regions: list[Column], folder: str | None = None, buckets: int | None = None) -> TextIndex:
    """Invert the texts of ``rows``, whose regions are searched one after another.

    Written to ``folder`` (overwritten), or to the session's checkpoint folder for the length of a job.
    """
    _small_batches(rows.sparkSession)
    words = [words_of(r) for r in regions]
    sizes = F.array(*[F.size(w) for w in words])
    count = len(regions)
    source = rows.select(F.col(id_col).cast("string").alias("id"), F.concat(*words).alias("words"), sizes.alias("sizes"))

    def work(batches):
        part = TaskContext.get().partitionId() << 32
        held, total, number = [], 0, 0

        def settle():
            ids = pa.concat_arrays([b.column("id") for b in held])
            flat = pa.concat_arrays([b.column("words").flatten().cast(pa.large_string()) for b in held])
            each = np.concatenate([np.asarray(b.column("sizes").flatten()).reshape(-1, count) for b in held]).astype(np.int64)
            ends = np.cumsum(each, axis=1)
            return _inverted(ids, flat, ends[:, -1], [ends[:, r] for r in range(count - 1)], part + number)

        for batch in batches:
            ends = np.cumsum(np.asarray(batch.column("sizes").flatten(), np.int64).reshape(-1, count).sum(axis=1))
            at = before = 0
            while at < batch.num_rows:
                fit = int(np.searchsorted(ends, before + SEGMENT_WORDS - total, "right"))
                if fit > at or not held:  # a row above the size is a segment of its own
                    stop = max(fit, at + 1)
                    held.append(batch.slice(at, stop - at))
                    total += int(ends[stop - 1]) - before
                    at, before = stop, int(ends[stop - 1])
                if total >= SEGMENT_WORDS or at < batch.num_rows:
                    yield settle()
                    held, total, number = [], 0, number + 1
        if held:
            yield settle()

    found = source.mapInArrow(work, POSTINGS)
    if buckets:
        found = found.withColumn("bucket", F.when(F.col("word").isNull(), -1).otherwise(F.pmod(F.xxhash64("word"), F.lit(buckets))).cast("int"))
        # segments of one hot word stay apart: rows are dealt by word and segment, and sorted by word
        found = found.repartition("bucket", "segment").sortWithinPartitions("bucket", "word", "segment")
    if folder is None:
        table = cut_lineage(found)
    else:
        writer = found.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy("bucket") if buckets else writer).parquet(folder)
        return load(rows.sparkSession, folder, rows.schema[id_col].dataType.simpleString(), buckets)
    return _opened(table, rows.schema[id_col].dataType.simpleString(), buckets)


def load(spark: SparkSession, folder: str, id_type: str = "string", buckets: int | None = None) -> TextIndex:
    """An index that was built into a folder."""
    kind = POSTINGS + (", bucket int" if buckets else "")
    return _opened(spark.read.schema(kind).parquet(folder), id_type, buckets)


def _opened(table: DataFrame, id_type: str, buckets: int | None) -> TextIndex:
    words = table.where(F.col("word").isNotNull()).drop("ids")
    names = table.where(F.col("word").isNull()).select("segment", "ids")
    return TextIndex(words, names, id_type, buckets)


# --- phrases ----------------------------------------------------------------------------------


def _starts(postings: list[tuple[bytes, bytes, bytes]], regions: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places at which words with these postings stand one after another, in the first regions."""
    keys = None
    for i, (rows, counts, places) in enumerate(postings):
        row = np.repeat(np.cumsum(np.frombuffer(rows, "<u4").astype(np.int64)), np.frombuffer(counts, "<u4"))
        gaps = np.frombuffer(places, "<u4").astype(np.int64)
        total = np.cumsum(gaps)
        first = np.cumsum(np.frombuffer(counts, "<u4").astype(np.int64)) - np.frombuffer(counts, "<u4")
        place = total - np.repeat((total - gaps)[first], np.frombuffer(counts, "<u4"))
        here = (row << 32) + place - i
        here = here[place < regions * REGION]
        keys = here if keys is None else keys[np.isin(keys, here, assume_unique=True)]
        if not len(keys):
            break
    return keys >> 32, keys & 0xFFFFFFFF


def phrase_rows(index: TextIndex, phrases: DataFrame) -> DataFrame:
    """(query, segment, rows) of the rows that hold every phrase of a query.

    phrases: query, part (int), words (array), regions (int): part ``part`` of a query occurs in one of
    its first ``regions`` regions. A query's words in one segment are what a group holds: its own few
    words' postings there. A query that names no word finds nothing.
    """
    _small_batches(phrases.sparkSession)
    asked = phrases.select("query", "part", "regions", F.posexplode("words").alias("at", "word"))
    need = asked.groupBy("query").agg(F.count_distinct("word").alias("need"))
    found = index.of_words(asked).groupBy("query", "segment").agg(
        F.count_distinct("word").alias("have"), F.sort_array(F.collect_list(F.struct("part", "at", "regions", "rows", "counts", "places"))).alias("held")
    )
    whole = found.join(need, "query").where(F.col("have") == F.col("need")).select("query", "segment", "held")
    query_type = phrases.schema["query"].dataType.simpleString()

    def work(batches):
        for batch in batches:
            out = []
            for held in (group.as_py() for group in batch.column("held")):  # one group's postings at a time
                parts: dict[int, list] = {}
                for h in held:
                    parts.setdefault(h["part"], []).append(h)
                rows = None
                for words in parts.values():
                    here = np.unique(_starts([(h["rows"], h["counts"], h["places"]) for h in words], words[0]["regions"])[0])
                    rows = here if rows is None else np.intersect1d(rows, here, assume_unique=True)
                    if not len(rows):
                        break
                out.append(rows.astype(np.int32))
            cuts = np.cumsum([0, *map(len, out)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(out) if out else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("segment"), lists], ["query", "segment", "rows"])

    return whole.mapInArrow(work, f"query {query_type}, segment bigint, rows array<int>").where(F.size("rows") > 0)


# --- substrings -------------------------------------------------------------------------------


def grams(text: Column, n: int) -> Column:
    """The distinct n-grams of a short text."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return F.array_distinct(F.transform(places, lambda i: F.substr(text, i, F.lit(n))))


def words_with(index: TextIndex, parts: DataFrame) -> DataFrame:
    """(part, word): the words of the index that contain each distinct part, itself of letters and digits.

    Words and parts meet on n-grams of the vocabulary: of a part the one that the fewest words hold.
    """
    shortest = parts.agg(F.min(F.length("part"))).first()[0]
    if shortest is None:
        return parts.select("part", F.col("part").alias("word")).limit(0)
    sizes = range(min(GRAM, shortest), GRAM + 1)
    of_part = F.coalesce(*[F.when(F.length("part") == n, grams(F.col("part"), n)) for n in sizes if n < GRAM], grams(F.col("part"), GRAM))
    keyed = parts.select("part", F.explode(of_part).alias("gram"))
    vocabulary = index.postings.select("word").distinct()
    held = vocabulary.select("word", F.explode(F.array_distinct(F.concat(*[grams(F.col("word"), n) for n in sizes]))).alias("gram"))
    held = cut_lineage(held.join(keyed.select("gram").distinct(), "gram", "left_semi"))
    rare = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    best = keyed.join(rare, "gram", "left").groupBy("part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))
    return held.join(best, "gram").where(F.contains("word", F.col("part"))).select("part", "word")


def rows_with(index: TextIndex, parts: DataFrame) -> DataFrame:
    """(part, segment, rows) of the rows that hold a word that contains the part; a row may come up again."""
    _small_batches(parts.sparkSession)
    found = index.of_words(words_with(index, parts)).select("part", "segment", "rows")

    def work(batches):
        for batch in batches:
            rows = [np.cumsum(np.frombuffer(r, "<u4")).astype(np.int32) for r in batch.column("rows").to_pylist()]
            cuts = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("segment"), lists], ["part", "segment", "rows"])

    return found.mapInArrow(work, "part string, segment bigint, rows array<int>")
