"""Token-id files with a minimal perfect hash index: constant-time keyed access to raw id payloads.

A folder holds shards, index files and two manifests.

* A **shard** begins with the ids of its documents, raw, little-endian, one after another (so it can be
  memory-mapped as it is); behind them stand a directory (keys, flags, lengths) and a footer. Shards
  follow each other in ascending key order, and a document never crosses a shard.
* The **index** knows every document by (key, copy): ``copy`` counts the rows that share a key from 0, in
  file order. A key hashes to a bucket of about ``BUCKET`` keys; a bucket is a cascade of bit arrays in
  which the rank of a key's bit is its slot, so n keys fill n slots, and a slot stores a 32-bit
  fingerprint, the shard, the offset in it and the length. A lookup reads one bucket and one range of a
  shard, whatever the number of documents.

Files are written by a Spark data source: each task attempt writes files of its own name, and only what
the driver commits to the manifest counts, so a lost executor or a second attempt leaves nothing behind
that is read. One task holds one bucket or one document at a time, never a shard; the driver holds a line
a file. Folders are any URI pyarrow can open, or a path all machines share.

Rows without a key are kept, ahead of all others, under the null key; repeated keys are copies; an empty
table gives a manifest without files; columns other than key and ids are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from attestra.llm.blocks import MASK, mix

MAGIC = b"IDSHARD1"
FOOTER = "<8sIIQQ"  # magic, bytes an id, spare, documents, ids
SHARD_BYTES = 256 << 20
BUCKET = 8192
GAMMA = 2  # bits of a level for each key that reaches it
LEVELS = 48
DIRECTORY = "doc_id bigint, copy bigint, shard int, offset bigint, length bigint"
ENTRY = "bucket int, h1 bigint, h2 bigint, shard int, offset bigint, length bigint"
PLACE = "doc_id bigint, copy bigint, shard int, offset bigint, length bigint, start bigint"
FETCHED = "doc_id bigint, copy bigint, start bigint, length bigint, ids binary"


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder's URI (Hadoop writes ``file:/a`` for ``file:///a``)."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = folder[len("file:") :]
    return pafs.FileSystem.from_uri(folder)


def _put(folder: str, name: str, data: bytes) -> None:
    fs, root = opened(folder)
    with fs.open_output_stream(f"{root}/{name}.new") as out:
        out.write(data)
    fs.move(f"{root}/{name}.new", f"{root}/{name}")


def manifest(folder: str, name: str = "shards") -> dict:
    fs, root = opened(folder)
    with fs.open_input_stream(f"{root}/{name}.json") as f:
        return json.loads(f.read())


# --- the hash ---------------------------------------------------------------------------------


def hashes(keys: np.ndarray, valid: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of (key or null, copy)."""
    k = np.where(valid, keys, 0).astype(np.int64).view(np.uint64)
    tail = mix(copies.astype(np.uint64) * np.uint64(2) + valid.astype(np.uint64) + np.uint64(0x51ED270B))
    first = mix(mix(k + np.uint64(0x9E3779B97F4A7C15)) ^ tail)
    second = mix(mix(k ^ np.uint64(0xC2B2AE3D27D4EB4F)) + tail * np.uint64(0x165667B19E3779F9))
    return first, second


def bucket_of(h1: np.ndarray, bits: int) -> np.ndarray:
    return (h1 >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(h1), np.int32)


def fingerprint(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (mix(h1 + (h2 << np.uint64(1))) >> np.uint64(32)).astype(np.uint32)


def _at(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    step = np.uint64(level * 0xD6E8FEB86659FD93 & MASK)
    return (mix(h1 ^ (h2 + step)) % np.uint64(size)).astype(np.int64)


def build(h1: np.ndarray, h2: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels of a minimal perfect hash and the slot of every key.

    A level gives each key that is left one of its bits; keys alone on a bit are settled there, the
    others go to the next level. A key's slot is the number of set bits before its own.
    """
    levels: list[np.ndarray] = []
    slots = np.empty(len(h1), np.int64)
    left, before = np.arange(len(h1)), 0
    while len(left):
        if len(levels) == LEVELS:
            raise ValueError("two keys of a bucket share both hashes")
        size = max(64, -(-GAMMA * len(left) // 64) * 64)
        at = _at(h1[left], h2[left], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        rank = np.cumsum(alone) - 1
        settled = alone[at]
        slots[left[settled]] = before + rank[at[settled]]
        before += int(alone.sum())
        levels.append(alone)
        left = left[~settled]
    return levels, slots


def find(levels: list[tuple[np.ndarray, np.ndarray]], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 where no level knows it."""
    slots = np.full(len(h1), -1, np.int64)
    left = np.arange(len(h1))
    for i, (alone, rank) in enumerate(levels):
        if not len(left):
            break
        at = _at(h1[left], h2[left], i, len(alone))
        settled = alone[at]
        slots[left[settled]] = rank[at[settled]]
        left = left[~settled]
    return slots


_SLOT = np.dtype([("mark", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("length", "<u4")])


def pack_bucket(h1: np.ndarray, h2: np.ndarray, shard: np.ndarray, offset: np.ndarray, length: np.ndarray) -> bytes:
    levels, slots = build(h1, h2)
    table = np.empty(len(h1), _SLOT)
    for name, values in (("mark", fingerprint(h1, h2)), ("shard", shard), ("offset", offset), ("length", length)):
        table[name][slots] = values
    head = np.array([len(h1), len(levels), *[len(level) for level in levels]], "<u4").tobytes()
    return head + b"".join(np.packbits(level, bitorder="little").tobytes() for level in levels) + table.tobytes()


class Bucket:
    """One bucket, read back."""

    def __init__(self, data: bytes):
        n, count = np.frombuffer(data, "<u4", 2).tolist()
        sizes = np.frombuffer(data, "<u4", count, 8).tolist()
        at, before, self.levels = 8 + 4 * count, 0, []
        for size in sizes:
            alone = np.unpackbits(np.frombuffer(data, np.uint8, size // 8, at), bitorder="little").astype(bool)
            self.levels.append((alone, before + np.cumsum(alone) - 1))
            before += int(alone.sum())
            at += size // 8
        self.table = np.frombuffer(data, _SLOT, n, at)

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Row of ``table`` for each key, -1 for keys that are not stored (but for one in 2^32)."""
        slots = find(self.levels, h1, h2)
        known = slots >= 0
        known[known] = self.table["mark"][slots[known]] == fingerprint(h1[known], h2[known])
        return np.where(known, slots, -1)


# --- shards -----------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    part: int
    files: list[dict] = field(default_factory=list)


class _ShardFile:
    def __init__(self, fs, root: str, name: str, width: int):
        self.name, self.width = name, width
        self.out = fs.open_output_stream(f"{root}/{name}")
        self.keys: list[np.ndarray] = []
        self.valid: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.bytes = 0

    def add(self, keys: np.ndarray, valid: np.ndarray, sizes: np.ndarray, payload) -> None:
        self.out.write(payload)
        self.keys.append(keys)
        self.valid.append(valid)
        self.lengths.append(sizes // self.width)
        self.bytes += int(sizes.sum())

    def close(self) -> dict:
        keys, valid, lengths = (np.concatenate(x) for x in (self.keys, self.valid, self.lengths))
        for part in (keys.astype("<i8"), valid.astype(np.uint8), lengths.astype("<u4")):
            self.out.write(part.tobytes())
        ids = int(lengths.sum())
        self.out.write(struct.pack(FOOTER, MAGIC, self.width, 0, len(keys), ids))
        self.out.close()
        other = np.flatnonzero((keys != keys[-1]) | (valid != valid[-1]))
        edge = lambda i: int(keys[i]) if valid[i] else None
        run = len(keys) - 1 - int(other[-1]) if len(other) else len(keys)
        return {"file": self.name, "docs": len(keys), "ids": ids, "first": edge(0), "last": edge(-1), "run": run}


class _ShardWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, width: int, limit: int):
        self.folder, self.width, self.limit = folder, width, limit

    def write(self, iterator) -> Written:
        fs, root = opened(self.folder)
        part = TaskContext.get().partitionId()
        done, file = Written(part), None
        for batch in iterator:
            if not batch.num_rows:
                continue
            keys = batch.column("doc_id")
            valid = np.asarray(keys.is_valid())
            keys = np.asarray(keys.fill_null(0))
            ids = batch.column("ids").cast(pa.large_binary())
            _, places, data = ids.buffers()
            cuts = np.frombuffer(places, np.int64)[ids.offset : ids.offset + len(ids) + 1]
            sizes = np.diff(cuts)
            if (sizes // self.width >= 1 << 32).any():
                raise ValueError("a document of 2^32 ids or more")
            lo = 0
            while lo < len(sizes):
                if file is None:
                    file = _ShardFile(fs, root, f"part-{part:06d}-{len(done.files):04d}-{uuid.uuid4().hex}.ids", self.width)
                room = self.limit - file.bytes
                hi = int(np.searchsorted(cuts[lo + 1 :] - cuts[lo], room, "right")) + lo
                hi = max(hi, lo + 1) if not file.bytes else hi
                if hi > lo:
                    file.add(keys[lo:hi], valid[lo:hi], sizes[lo:hi], data.slice(int(cuts[lo]), int(cuts[hi] - cuts[lo])) if data else b"")
                    lo = hi
                if lo < len(sizes):
                    done.files.append(file.close())
                    file = None
        if file is not None:
            done.files.append(file.close())
        return done

    def commit(self, messages) -> None:
        files = [f for m in sorted((m for m in messages if m), key=lambda m: m.part) for f in m.files]
        docs = ids = carried = 0
        before = None
        for f in files:
            same = before is not None and before["last"] == f["first"]
            carried = (carried if before["run"] == before["docs"] else 0) + before["run"] if same else 0
            f |= {"doc0": docs, "id0": ids, "copies": carried}
            docs, ids, before = docs + f["docs"], ids + f["ids"], f
        _put(self.folder, "shards.json", json.dumps({"width": self.width, "docs": docs, "ids": ids, "files": files}).encode())

    def abort(self, messages) -> None:
        _drop(self.folder, messages)


def _drop(folder: str, messages) -> None:
    fs, root = opened(folder)
    for m in messages:
        for f in m.files if m else ():
            fs.delete_file(f"{root}/{f['file']}")


@dataclass
class _Shard(InputPartition):
    number: int
    file: dict
    width: int


def directory(folder: str, file: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, flags and lengths of a shard; the payload is not read."""
    fs, root = opened(folder)
    with fs.open_input_file(f"{root}/{file['file']}") as f:
        n = file["docs"]
        f.seek(file["ids"] * width)
        data = f.read(13 * n)
        magic, wide, _, docs, ids = struct.unpack(FOOTER, f.read(struct.calcsize(FOOTER)))
    if (magic, wide, docs, ids) != (MAGIC, width, n, file["ids"]):
        raise ValueError(f"{file['file']} is not the shard its manifest names")
    return np.frombuffer(data, "<i8", n), np.frombuffer(data, np.uint8, n, 8 * n).astype(bool), np.frombuffer(data, "<u4", n, 9 * n).astype(np.int64)


class _DirectoryReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self):
        known = manifest(self.folder)
        return [_Shard(i, f, known["width"]) for i, f in enumerate(known["files"])] or [InputPartition(None)]

    def read(self, partition):
        if not isinstance(partition, _Shard):
            return
        keys, valid, lengths = directory(self.folder, partition.file, partition.width)
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (valid[1:] != valid[:-1])
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        copies = np.arange(len(keys)) - starts[group] + np.where(group == 0, partition.file["copies"], 0)
        offsets = np.cumsum(lengths) - lengths
        for lo in range(0, len(keys), 65536):
            cut = slice(lo, lo + 65536)
            shard = np.full(len(keys[cut]), partition.number, np.int32)
            columns = [pa.array(keys[cut], pa.int64(), mask=~valid[cut]), pa.array(copies[cut]), pa.array(shard), pa.array(offsets[cut]), pa.array(lengths[cut])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "copy", "shard", "offset", "length"])


class IdShards(DataSource):
    """Format ``idshards``: writes sorted (doc_id, ids) rows as shards, reads their directories."""

    @classmethod
    def name(cls) -> str:
        return "idshards"

    def schema(self) -> str:
        return DIRECTORY

    def reader(self, schema):
        return _DirectoryReader(self.options["path"])

    def writer(self, schema, overwrite):
        return _ShardWriter(self.options["path"], int(self.options["width"]), int(self.options.get("limit", SHARD_BYTES)))


# --- the index --------------------------------------------------------------------------------


class _IndexWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, bits: int):
        self.folder, self.bits = folder, bits

    def write(self, iterator) -> Written:
        fs, root = opened(self.folder)
        done = Written(TaskContext.get().partitionId())
        held: list[list[np.ndarray]] = []
        now, out, name, at, table = None, None, "", 0, []

        def settle():
            nonlocal out, name, at
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            if out is None:
                name = f"index-{uuid.uuid4().hex}.mph"
                out = fs.open_output_stream(f"{root}/{name}")
            data = pack_bucket(columns[0].view(np.uint64), columns[1].view(np.uint64), *columns[2:])
            out.write(data)
            table.append((now, at))
            at += len(data)

        for batch in iterator:
            buckets = np.asarray(batch.column("bucket"))
            columns = [np.asarray(batch.column(c)) for c in ("h1", "h2", "shard", "offset", "length")]
            edges = np.flatnonzero(np.diff(buckets)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(buckets)], strict=True):
                if lo == hi:
                    continue
                if now is not None and buckets[lo] != now:
                    settle()
                    held.clear()
                now = int(buckets[lo])
                held.append([c[lo:hi] for c in columns])
        if held:
            settle()
        if out is not None:
            out.write(np.array(table, "<i8").tobytes())
            out.close()
            done.files.append({"file": name, "first": table[0][0], "last": table[-1][0], "count": len(table), "end": at})
        return done

    def commit(self, messages) -> None:
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f["first"])
        _put(self.folder, "index.json", json.dumps({"bits": self.bits, "files": files}).encode())

    def abort(self, messages) -> None:
        _drop(self.folder, messages)


class IdIndex(DataSource):
    """Format ``idindex``: writes index rows that are clustered by bucket as index files."""

    @classmethod
    def name(cls) -> str:
        return "idindex"

    def schema(self) -> str:
        return ENTRY

    def writer(self, schema, overwrite):
        return _IndexWriter(self.options["path"], int(self.options["bits"]))


def _register(spark: SparkSession) -> None:
    spark.dataSource.register(IdShards)
    spark.dataSource.register(IdIndex)


def write(rows: DataFrame, folder: str, width: int, limit: int = SHARD_BYTES) -> dict:
    """Write rows (doc_id, ids) that are sorted across and within partitions; return the manifest."""
    _register(rows.sparkSession)
    fs, root = opened(folder)
    fs.create_dir(root)
    rows.select("doc_id", "ids").write.format("idshards").option("width", width).option("limit", limit).mode("append").save(folder)
    return manifest(folder)


def index(spark: SparkSession, folder: str, keys: int = BUCKET) -> None:
    """Build the index of a folder's shards from their directories."""
    _register(spark)
    docs = manifest(folder)["docs"]
    bits = max(0, (max(1, -(-docs // keys)) - 1).bit_length())

    def work(batches):
        for batch in batches:
            h1, h2, bucket = _hashed(batch, bits)
            columns = [pa.array(bucket), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), *[batch.column(c) for c in ("shard", "offset", "length")]]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "h1", "h2", "shard", "offset", "length"])

    entries = spark.read.format("idshards").load(folder).mapInArrow(work, ENTRY)
    entries = entries.repartitionByRange("bucket").sortWithinPartitions("bucket")
    entries.write.format("idindex").option("bits", bits).mode("append").save(folder)


def _hashed(batch: pa.RecordBatch, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = batch.column("doc_id")
    valid = np.asarray(keys.is_valid())
    h1, h2 = hashes(np.asarray(keys.fill_null(0)), valid, np.asarray(batch.column("copy")))
    return h1, h2, bucket_of(h1, bits)


class Index:
    """A folder's index as one reader holds it: the list of files, one open file, its last bucket."""

    def __init__(self, folder: str):
        self.fs, self.root = opened(folder)
        known = manifest(folder, "index")
        self.bits, self.files = known["bits"], known["files"]
        self.firsts = np.array([f["first"] for f in self.files], np.int64)
        self.file, self.bucket = (None, None, {}), (None, None)

    def load(self, bucket: int) -> Bucket | None:
        if self.bucket[0] == bucket:
            return self.bucket[1]
        at = int(np.searchsorted(self.firsts, bucket, "right")) - 1
        if at < 0:
            return None
        if self.file[0] != at:
            spec = self.files[at]
            handle = self.fs.open_input_file(f"{self.root}/{spec['file']}")
            handle.seek(spec["end"])
            table = np.frombuffer(handle.read(16 * spec["count"]), "<i8").reshape(-1, 2)
            ends = [*table[1:, 1].tolist(), spec["end"]]
            if self.file[1] is not None:
                self.file[1].close()
            self.file = (at, handle, {b: (lo, hi) for (b, lo), hi in zip(table.tolist(), ends, strict=True)})
        place = self.file[2].get(bucket)
        if place is None:
            return None
        self.file[1].seek(place[0])
        self.bucket = (bucket, Bucket(self.file[1].read(place[1] - place[0])))
        return self.bucket[1]


def look_up(keys: DataFrame, folder: str) -> DataFrame:
    """Places of (doc_id, copy) rows through the index; shard, offset, length and start are null for unknown keys.

    Keys are dealt by bucket, so each bucket is read once or a few times; keys should be distinct.
    """
    bits = manifest(folder, "index")["bits"]

    def mark(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copy"), pa.array(_hashed(batch, bits)[2])], ["doc_id", "copy", "bucket"])

    def probe(batches):
        known = Index(folder)
        firsts = np.array([f["id0"] for f in manifest(folder)["files"]], np.int64)
        for batch in batches:
            h1, h2, bucket = _hashed(batch, bits)
            found = np.zeros(len(h1), bool)
            place = {c: np.zeros(len(h1), np.int64) for c in ("shard", "offset", "length")}
            order = np.argsort(bucket, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                held = known.load(int(bucket[rows[0]])) if len(rows) else None
                if held is None:
                    continue
                slots = held.find(h1[rows], h2[rows])
                rows, slots = rows[slots >= 0], slots[slots >= 0]
                found[rows] = True
                for c, values in place.items():
                    values[rows] = held.table[c][slots]
            start = firsts[place["shard"]] + place["offset"] if len(firsts) else place["offset"]
            columns = [batch.column("doc_id"), batch.column("copy"), pa.array(place["shard"].astype(np.int32), mask=~found)]
            columns += [pa.array(v, mask=~found) for v in (place["offset"], place["length"], start)]
            yield pa.RecordBatch.from_arrays(columns, PLACE_NAMES)

    keys = keys.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("copy").cast("bigint").alias("copy"))
    dealt = keys.mapInArrow(mark, "doc_id bigint, copy bigint, bucket int").repartitionByRange("bucket", "doc_id", "copy")
    return dealt.sortWithinPartitions("bucket").mapInArrow(probe, PLACE)


PLACE_NAMES = ["doc_id", "copy", "shard", "offset", "length", "start"]


def every_key(docs: DataFrame, step: int = 65536) -> DataFrame:
    """(doc_id, copy) of every row of ``docs``: rows of an id are counted, not gathered."""
    counts = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    parts = counts.select("doc_id", "n", F.explode(F.expr(f"sequence(0, (n - 1) div {step})")).alias("part"))
    return parts.select("doc_id", F.explode(F.expr(f"sequence(part * {step}, least(n, (part + 1) * {step}) - 1)")).alias("copy"))


def fetch(places: DataFrame, folder: str, most: int = 8 << 20) -> DataFrame:
    """Ids of placed documents, as little-endian unsigned 32-bit integers; a row without a place is an error.

    Places are dealt by shard and offset, so neighbours are read together, at most ``most`` bytes (or one
    document) at a time.
    """

    def work(batches):
        fs, root = opened(folder)
        known = manifest(folder)
        width, files = known["width"], known["files"]
        now, handle = None, None
        for batch in batches:
            shard, offset, length = (np.asarray(batch.column(c)).astype(np.int64) for c in ("shard", "offset", "length"))
            lo = 0
            while lo < len(shard):
                hi, begin, end = lo + 1, offset[lo], offset[lo] + length[lo]
                while hi < len(shard) and shard[hi] == shard[lo] and begin <= offset[hi] <= end and (offset[hi] + length[hi] - begin) * width <= most:
                    end = max(end, offset[hi] + length[hi])
                    hi += 1
                if shard[lo] != now:
                    if handle is not None:
                        handle.close()
                    now, handle = shard[lo], fs.open_input_file(f"{root}/{files[int(shard[lo])]['file']}")
                handle.seek(int(begin) * width)
                data = np.frombuffer(handle.read(int(end - begin) * width), f"<u{width}").astype("<u4")
                ids = pa.array([data[o : o + n].tobytes() for o, n in zip((offset[lo:hi] - begin).tolist(), length[lo:hi].tolist(), strict=True)], pa.binary())
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("doc_id", "copy", "start", "length")], ids], ["doc_id", "copy", "start", "length", "ids"])
                lo = hi

    placed = F.when(F.col("shard").isNull(), F.raise_error(F.lit("a key is not in the index"))).otherwise(F.col("shard"))
    found = places.withColumn("shard", placed.cast("int"))
    return found.repartitionByRange("shard", "offset", "length").sortWithinPartitions("shard", "offset", "length").mapInArrow(work, FETCHED)


def read_document(folder: str, key: int | None, copy: int = 0) -> np.ndarray | None:
    """One document's ids, by one bucket and one range of one shard."""
    known, shards = Index(folder), manifest(folder)
    h1, h2 = hashes(np.array([key or 0]), np.array([key is not None]), np.array([copy]))
    bucket = known.load(int(bucket_of(h1, known.bits)[0]))
    slot = -1 if bucket is None else int(bucket.find(h1, h2)[0])
    if slot < 0:
        return None
    entry = bucket.table[slot]
    fs, root = opened(folder)
    with fs.open_input_file(f"{root}/{shards['files'][int(entry['shard'])]['file']}") as f:
        f.seek(int(entry["offset"]) * shards["width"])
        return np.frombuffer(f.read(int(entry["length"]) * shards["width"]), f"<u{shards['width']}").astype(np.uint32)
