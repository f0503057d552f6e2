"""Landing of records: order by arrival, splits, rejects; the readers on top of it."""

import json
import os
import shutil

from pyspark.sql import functions as F

from attestra.functions.order import numbered
from attestra.operators import store as S
from attestra.sources import literature as L
from attestra.sources import records as R


def hits(*rows):
    return json.dumps({"resultList": {"result": [{"id": p, "source": "MED", "pmid": p, "title": t} for p, t in rows]}})


def put(folder, name, text, at):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    os.utime(path, (at, at))


def winners(spark, path, **more):
    rows = L.publications(spark, R.land(spark, path, **more))
    return {r["id"]: r["title"] for r in S.register(rows).collect()}


def test_numbers_in_order(spark):
    df = spark.range(5000).withColumn("k", F.xxhash64("id")).repartition(7)
    rows = numbered(df, [F.col("k"), F.col("id")]).orderBy("ord").collect()
    assert [r["ord"] for r in rows] == list(range(5000)) and [r["k"] for r in rows] == sorted(r["k"] for r in rows)
    assert numbered(df.limit(0), [F.col("k")]).count() == 0


def test_moving_the_folder_keeps_the_winners(spark, tmp_path):
    """The file that came first wins, wherever the folder lies and whatever its name hashes to."""
    one = tmp_path / "one"
    put(one, "b.json", hits(("1", "late"), ("2", "only")), 2000)
    put(one, "a.json", hits(("1", "later still")), 3000)
    put(one, "deep/c.json", hits(("1", "first"), ("3", "x"), ("3", "y")), 1000)
    pattern = lambda folder: f"{folder}/{{*.json,deep/*.json}}"
    want = {"PMID:1": "first", "PMID:2": "only", "PMID:3": "x"}
    assert winners(spark, pattern(one)) == want
    for name in ("two", "a longer name", "z"):
        shutil.move(one, tmp_path / name)
        one = tmp_path / name
        assert winners(spark, pattern(one)) == want
    ords = [(r["id"], r["title"]) for r in L.publications(spark, pattern(one)).orderBy("ord").collect()]
    assert ords == [("PMID:1", "first"), ("PMID:3", "x"), ("PMID:3", "y"), ("PMID:1", "late"), ("PMID:2", "only"), ("PMID:1", "later still")]


def test_a_manifest_gives_the_arrival(spark, tmp_path):
    put(tmp_path, "in/a.json", hits(("1", "a")), 1000)
    put(tmp_path, "in/b.json", hits(("1", "b")), 2000)
    known = spark.sql("SELECT 'b.json' AS file, TIMESTAMP '1970-01-01 00:00:01' AS received")
    assert winners(spark, str(tmp_path / "in")) == {"PMID:1": "a"}
    assert winners(spark, str(tmp_path / "in"), received=known) == {"PMID:1": "b"}


def test_lines_are_split_and_stay_in_order(spark, tmp_path):
    lines = [hits((str(i), f"t{i}" + "x" * (i % 90))) for i in range(3000)]
    put(tmp_path, "in/many.jsonl", "\n".join(lines) + "\n\n", 1000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 5
        landed = R.land(spark, str(tmp_path / "in"), separator="\n")
        assert [r["value"] for r in landed.orderBy("record").collect()] == lines
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["id"] for r in L.publications(spark, landed).orderBy("ord").collect()] == [f"PMID:{i}" for i in range(3000)]


def test_rejects_keep_their_text(spark, tmp_path):
    good, text = hits(("1", "a")), ['{"resultList": ', "[1]", "not json", '{"resultList": 7}', "{}"]
    put(tmp_path, "in/x.jsonl", "\n".join([good, *text]), 1000)
    fine, bad = R.parsed(R.land(spark, str(tmp_path / "in"), separator="\n"), L.PUBLICATION)
    assert {r["value"]: r["reason"] for r in bad.collect()} == {text[0]: "not JSON", text[1]: "another shape", text[2]: "not JSON", text[3]: "another shape"}
    assert [r["record"] for r in fine.orderBy("record").collect()] == [0, 5]  # an empty object is an answer without results
    assert fine.count() + bad.count() == 6


def test_rejects_of_a_stream(spark, tmp_path):
    put(tmp_path, "in/a.jsonl", hits(("1", "a")) + "\nbroken\n", 1000)
    stream = R.record_stream(spark, str(tmp_path / "in"), separator="\n")
    query = R.parsed(stream, L.PUBLICATION)[1].writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [(r["file"], r["value"], r["reason"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a.jsonl", "broken", "not JSON")]


ARTICLE = '<article><front><article-id pub-id-type="pmc">{i}</article-id></front><body><sec><title>T{i}</title><p>text {i}</p></sec><fig><label>F</label><caption><p>cap {i}</p></caption></fig></body></article>'


def test_articles_of_one_large_file(spark, tmp_path):
    put(tmp_path, "in/set.xml", "<?xml version='1.0'?><set>" + "\n".join(ARTICLE.format(i=i) for i in range(400)) + "<article><body><sec></article></set>", 1000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        parsed = L.parse_articles(L.split_articles(spark, str(tmp_path / "in"))).cache()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    rows = L.fulltext(parsed).orderBy("ord").collect()
    assert [(r["id"], r["passage"]) for r in rows] == [(f"PMCID:PMC{i}#sec-0", f"text {i}") for i in range(400)]
    assert L.figures(parsed).count() == 400
    bad = L.rejected_articles(parsed).collect()
    assert len(bad) == 1 and bad[0]["reason"].startswith("not XML")
    ords = {r["ord"] for r in L.fulltext(parsed).unionByName(L.figures(parsed)).collect()}
    assert len(ords) == 800
    parsed.unpersist()
