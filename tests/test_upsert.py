"""Upserts batch by batch: any split into batches, replays, failures half-way, restarts."""

import os
import random

import pytest
from pyspark.sql import functions as F

from attestra.operators import store as S
from attestra.sources import files
from attestra.streaming import upsert as U

KIND = "id string, ord bigint, title string"


def rows(n=300):
    rng = random.Random(4)
    out = [(f"k{rng.randrange(60)}", i, f"t{i}") for i in range(n)]
    out += [("hot", n + i, f"h{i}") for i in range(200)] + [(None, 9000, "no key"), (None, 9001, "no key either"), ("tie", 5, "a"), ("tie", 5, "b"), ("same", 6, "x"), ("same", 6, "x")]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("rule", [U.FIRST, U.LAST])
def test_batches_equal_one_job(spark, tmp_path, rule):
    every = spark.createDataFrame(rows(), KIND)
    table = U.KeyedTable(spark, str(tmp_path / "t"), rule=rule, buckets=7)
    assert table.read() is None
    data = rows()
    for n in range(5):
        assert table.apply(spark.createDataFrame(data[n::5], KIND), n)
        assert not table.apply(spark.createDataFrame([("k1", -9, "replayed")], KIND), n)  # the number is known
    pick = S.first_rows if rule == U.FIRST else S.last_rows
    assert sorted(map(tuple, table.read().collect()), key=repr) == sorted(map(tuple, pick(every, ["id"]).collect()), key=repr)
    assert table.apply(spark.createDataFrame([], KIND), 5) and table.manifest()["batch"] == 5


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = U.KeyedTable(spark, str(tmp_path / "t"), rule=U.LAST, buckets=16)
    table.apply(spark.createDataFrame(rows(), KIND), 0)
    before = table.manifest()["buckets"]
    table.apply(spark.createDataFrame([("hot", 10**6, "newest")], KIND), 1)
    after = table.manifest()["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert table.read().where("id = 'hot'").first()["title"] == "newest"
    assert table.read(1).where("id = 'hot'").first()["title"] == "h199"  # the earlier version can still be read
    assert table.vacuum(keep=1) > 0 and table.versions() == [2]
    assert table.read().where("id = 'hot'").first()["title"] == "newest" and table.read().count() == 63


def test_a_batch_that_fails_before_the_manifest(spark, tmp_path, monkeypatch):
    table = U.KeyedTable(spark, str(tmp_path / "t"), buckets=4)
    table.apply(spark.createDataFrame([("a", 1, "first")], KIND), 0)
    monkeypatch.setattr(U.KeyedTable, "_commit", lambda self, m: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        table.apply(spark.createDataFrame([("a", 0, "earlier"), ("b", 2, "b")], KIND), 1)
    assert [tuple(r) for r in table.read().collect()] == [("a", 1, "first")]
    monkeypatch.undo()
    assert table.apply(spark.createDataFrame([("a", 0, "earlier"), ("b", 2, "b")], KIND), 1)
    assert sorted(map(tuple, table.read().collect())) == [("a", 0, "earlier"), ("b", 2, "b")]
    assert table.vacuum(keep=2) >= 1  # what the failed try left


def test_two_writers_of_one_version(spark, tmp_path):
    table = U.KeyedTable(spark, str(tmp_path / "t"), buckets=2)
    table.apply(spark.createDataFrame([("a", 1, "x")], KIND), 0)
    with pytest.raises(FileExistsError):
        table._commit(dict(table.manifest(), batch=1))
    with pytest.raises(ValueError, match="buckets"):
        U.KeyedTable(spark, str(tmp_path / "t"), buckets=3).manifest()


def test_stream_survives_a_restart(spark, tmp_path):
    source, table = tmp_path / "in", U.KeyedTable(spark, str(tmp_path / "t"), buckets=5)
    data = rows()

    def feed(n):
        spark.createDataFrame(data[n::5], KIND).coalesce(1).write.mode("append").json(str(source))
        for name in os.listdir(source):
            if name.startswith("_"):
                os.remove(source / name)

    def go():
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).json(str(source))
        query = U.start_upserts(stream, table, str(tmp_path / "state"))
        query.awaitTermination(120)
        return query

    for n in range(3):
        feed(n)
    assert go().exception() is None
    feed(3), feed(4)
    fail, real = [True], U.KeyedTable._commit

    def once(self, manifest):
        real(self, manifest)
        if fail:
            fail.pop()
            raise OSError("the driver dies after the manifest")

    U.KeyedTable._commit = once
    try:
        with pytest.raises(Exception, match="dies"):
            go()
    finally:
        U.KeyedTable._commit = real
    go()  # the batch comes again and is skipped, the next one follows
    assert sorted(map(tuple, table.read().collect()), key=repr) == sorted(map(tuple, S.first_rows(spark.createDataFrame(data, KIND), ["id"]).collect()), key=repr)
    assert files.names(spark, str(tmp_path / "nowhere")) == []


@pytest.mark.parametrize("rule", [U.FIRST, U.LAST])
def test_large_buckets_get_runs_and_are_rewritten_at_last(spark, tmp_path, monkeypatch, rule):
    monkeypatch.setattr(U, "SMALL", 5)
    monkeypatch.setattr(U, "RUNS", 3)
    table, data = U.KeyedTable(spark, str(tmp_path / "t"), rule=rule, buckets=2), rows()
    lengths = []
    for n in range(5):
        before = {p for b in table.manifest()["buckets"] for p in U._runs(table.manifest(), b)}
        table.apply(spark.createDataFrame(data[n::5], KIND), n)
        after = table.manifest()
        lengths.append(max(len(U._runs(after, b)) for b in after["buckets"]))
        # earlier runs stay as they are until the bucket is rewritten
        assert n in (0, 3) or before <= {p for b in after["buckets"] for p in U._runs(after, b)}
    assert lengths == [1, 2, 3, 1, 2]
    pick = S.first_rows if rule == U.FIRST else S.last_rows
    assert sorted(map(tuple, table.read().collect()), key=repr) == sorted(map(tuple, pick(spark.createDataFrame(data, KIND), ["id"]).collect()), key=repr)
