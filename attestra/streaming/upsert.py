"""A keyed table that takes upserts batch by batch and rewrites only the buckets a batch touches.

Keys are dealt into ``buckets`` by hash. A bucket's rows lie in a folder of their own, and a manifest
names the folder that counts for each bucket and the last batch that was applied. A batch reads the
buckets its keys fall in, settles old and new rows by the table's rule (the first or the last arrival
of a key), writes those buckets into new folders and then puts the next manifest in place, in one step.
So readers see a batch whole or not at all; a batch that failed half-way leaves folders no manifest
names; and a batch that comes again after it was applied (a restarted stream replays its last one)
is known by its number and skipped. The result does not depend on how rows fall into batches, as
long as the rule's order is a property of the rows.

A bucket of more than ``SMALL`` rows is not rewritten for every batch: the batch's rows, settled among
themselves, become one more run of it, and a read settles its runs. At ``RUNS`` runs the next batch
rewrites it. So what a batch writes follows the batch, not the table.

Rows without a key are not kept. A key with very many rows in a batch is settled by partial aggregates before its rows meet; after that
a run holds a key once. The driver holds one manifest: a line a bucket.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attestra.operators import store as S
from attestra.sources import files

FIRST, LAST = "first", "last"
SMALL = 1_000  # rows of a bucket that is rewritten whole
RUNS = 8


def _runs(manifest: dict, bucket: str) -> list[str]:
    found = manifest["buckets"].get(bucket, [])
    return [found] if isinstance(found, str) else found  # tables of before had one run a bucket


@dataclass
class KeyedTable:
    """``rule`` is ``first`` or ``last`` by ``order``; ties are settled by content, as in batch jobs."""

    spark: SparkSession
    folder: str
    keys: tuple[str, ...] = ("id",)
    order: str = "ord"
    rule: str = FIRST
    buckets: int = 64

    # --- the manifest ---

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in files.names(self.spark, f"{self.folder}/manifests") if n.startswith("v") and n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version (the newest one by default); an empty one for a new table."""
        known = self.versions()
        if not known:
            return {"version": 0, "batch": -1, "schema": None, "buckets": {}, "count": self.buckets}
        found = json.loads(files.read_text(self.spark, f"{self.folder}/manifests/v{version or known[-1]:012d}.json"))
        if found["count"] != self.buckets:
            raise ValueError(f"the table has {found['count']} buckets, not {self.buckets}")
        return found

    def _commit(self, manifest: dict) -> None:
        files.write_text(self.spark, f"{self.folder}/manifests/v{manifest['version']:012d}.json", json.dumps(manifest))

    # --- rows ---

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _settled(self, rows: DataFrame) -> DataFrame:
        return (S.first_rows if self.rule == FIRST else S.last_rows)(rows, list(self.keys), self.order)

    def _files(self, manifest: dict, buckets: list[str]) -> DataFrame | None:
        """The rows of all runs of these buckets."""
        from pyspark.sql.types import StructType

        if manifest["schema"] is None:
            return None
        schema = StructType.fromJson(manifest["schema"])
        paths = sorted(p for b in buckets for p in _runs(manifest, b))
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{p}" for p in paths])

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table's rows as of a version; None before the first batch."""
        manifest = self.manifest(version)
        several = [b for b in manifest["buckets"] if len(_runs(manifest, b)) > 1]
        whole = self._files(manifest, [b for b in manifest["buckets"] if b not in several])
        return whole.unionByName(self._settled(self._files(manifest, several))) if several else whole

    def apply(self, batch: DataFrame, number: int) -> bool:
        """Apply batch ``number``; False if it was applied before."""
        now = self.manifest()
        if number <= now["batch"]:
            return False
        touched = sorted(r[0] for r in batch.select(self._bucket()).distinct().toLocalIterator())
        new = dict(now, version=now["version"] + 1, batch=number, schema=now["schema"] or json.loads(batch.schema.json()))
        if touched:
            held = now.get("rows", {})
            whole = [str(b) for b in touched if held.get(str(b), 0) <= SMALL or len(_runs(now, str(b))) >= RUNS]
            old = self._files(now, whole)
            rows = batch if old is None else old.unionByName(batch)
            place = f"data/v{new['version']:012d}-{uuid.uuid4().hex}"
            # Rows go to their bucket's files from where they were settled; they are not moved once more for it.
            self._settled(rows).withColumn("_bucket", self._bucket()).sortWithinPartitions("_bucket", *self.keys).write.partitionBy("_bucket").parquet(f"{self.folder}/{place}")
            counts = self.spark.read.schema("_bucket int").parquet(f"{self.folder}/{place}").groupBy("_bucket").count()
            counts = {str(r[0]): r[1] for r in counts.toLocalIterator()}
            kept = lambda b: [] if b in whole else _runs(now, b)
            new["buckets"] = {**now["buckets"], **{str(b): [*kept(b), f"{place}/_bucket={b}"] for b in counts}}
            new["rows"] = {**held, **{b: n + (0 if b in whole else held[b]) for b, n in counts.items()}}
        self._commit(new)
        return True

    def vacuum(self, keep: int = 2) -> int:
        """Delete what only manifests before the last ``keep`` name, and what no manifest names."""
        versions = self.versions()
        old, kept = versions[:-keep], [self.manifest(v) for v in versions[-keep:]]
        named = {p for m in kept for b in m["buckets"] for p in _runs(m, b)}
        gone = 0
        for folder in files.names(self.spark, f"{self.folder}/data"):
            parts = [f"data/{folder}/{n}" for n in files.names(self.spark, f"{self.folder}/data/{folder}")]
            buckets = [p for p in parts if "/_bucket=" in p]
            if not any(p in named for p in buckets):
                gone += files.delete(self.spark, f"{self.folder}/data/{folder}")
                continue
            gone += sum(files.delete(self.spark, f"{self.folder}/{p}") for p in buckets if p not in named)
        for v in old:
            files.delete(self.spark, f"{self.folder}/manifests/v{v:012d}.json")
        return gone


def start_upserts(stream: DataFrame, table: KeyedTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Apply a stream's micro-batches to a table, under their batch numbers."""

    def save(batch: DataFrame, number: int) -> None:
        table.apply(batch, number)

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
