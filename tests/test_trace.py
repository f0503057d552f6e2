"""Streaming jobs against their batch twins, with restarts."""

import json
import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from attestra.streaming import trace as TR

START = datetime(2026, 1, 1)


def line(i, kind, run="r1", minutes=None, **extra):
    return json.dumps({"run_id": run, "seq": i, "ts": (START + timedelta(minutes=i if minutes is None else minutes)).isoformat(), "type": kind, **extra})


def write(folder, name, lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")
    at = 1_700_000_000 + 10 * ord(name[0])  # files are read in the order of their times
    os.utime(folder / name, (at, at))


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_trace_parse(spark):
    rows = spark.createDataFrame([(line(1, "plan"),), (line(2, "made_up", x=1),), ('{"run_id": "r1", "seq": ',), ("[]",), ('{"seq": 1}',)], "value string")
    good, bad = TR.parse_trace(rows)
    assert [r.type for r in good.orderBy("seq").collect()] == ["plan", "made_up"] and bad.count() == 3
    assert '"x": 1' in good.where("type = 'made_up'").first()["payload"]


def test_first_registrations_survive_a_restart(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    write(source, "a.json", [line(1, "evidence_registered", id="PMID:1"), line(2, "evidence_registered", id="PMID:1"), line(3, "error", message="x")])
    start = lambda: run(TR.start_sink(TR.first_registrations(TR.parse_trace(TR.read_trace(spark, str(source)))[0]), out, state))
    start()
    write(source, "b.json", [line(4, "evidence_registered", id="PMID:1"), line(5, "evidence_registered", id="PMID:2"), line(6, "evidence_registered", run="r2", id="PMID:1")])
    start()
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    batch = TR.first_registrations(TR.parse_trace(spark.read.text(str(source)))[0])
    assert got == sorted(tuple(r) for r in batch.collect()) == [("r1", "PMID:1"), ("r1", "PMID:2"), ("r2", "PMID:1")]


def test_trace_verdicts(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    claim = lambda i, o: line(i, "claim_drafted", section_id="s", claim={"id": "c1", "ord": o, "text": f"t{o}"})
    verdict = lambda i, o, s, **k: line(i, "verdict", section_id="s", verdict={"claimId": "c1", "ord": o, "status": s}, **k)
    write(source, "a.json", [claim(1, 1), claim(2, 2), verdict(3, 1, "supported"), claim(4, 3)])
    write(source, "b.json", [verdict(50, 3, "overreach", minutes=50)])
    write(source, "c.json", [line(1000, "plan"), claim(1001, 9), verdict(1002, 9, "supported")])
    write(source, "d.json", [line(3000, "plan"), claim(3001, 10), verdict(3002, 10, "supported")])
    events = TR.parse_trace(TR.read_trace(spark, str(source), 1))[0]
    run(TR.start_sink(TR.claim_verdicts(events), out, str(tmp_path / "state")))
    got = {r.ord: r.status for r in spark.read.parquet(out).collect()}
    assert got[1] == "supported" and got[2] is None and got[3] is None and got[9] == "supported"
    batch = {r.ord: r.status for r in TR.claim_verdicts(TR.parse_trace(spark.read.text(str(source)))[0]).collect()}
    assert all(batch[k] == v for k, v in got.items())


def test_counts_and_usage_match_batch(spark, tmp_path):
    source = tmp_path / "in"
    write(source, "a.json", [line(1, "tool_result", count=3), line(2, "tool_result", count=4), line(3, "error", message="m"), line(4, "usage", model="claude-haiku-4-5", tokens_in=10, tokens_out=2)])
    write(source, "b.json", [line(5, "tool_result", run="r2", count=1), line(6, "usage", model="claude-haiku-4-5", tokens_in=5, tokens_out=1), line(7, "usage", model="who", tokens_in=1, tokens_out=1)])
    events = lambda: TR.parse_trace(TR.read_trace(spark, str(source), 1))[0]
    run(TR.start_counts(events(), str(tmp_path / "counts"), str(tmp_path / "s1")))
    run(TR.start_usage(events(), str(tmp_path / "usage"), str(tmp_path / "s2")))
    saved = spark.read.parquet(str(tmp_path / "counts"))
    latest = saved.groupBy("run_id", "type").agg(F.max_by(F.struct("n", "results", "errors"), "batch").alias("v")).select("run_id", "type", "v.*")
    whole = TR.parse_trace(spark.read.text(str(source)))[0]
    assert sorted(tuple(r) for r in latest.collect()) == sorted(tuple(r) for r in TR.event_counts(whole).collect())
    usage = spark.read.parquet(str(tmp_path / "usage"))
    last = usage.where(F.col("batch") == usage.agg(F.max("batch")).scalar())
    assert {r.model: (r.calls, r.tokens_in, r.cost_usd) for r in last.collect()} == {"claude-haiku-4-5": (2, 15, 15 / 1e6 + 3 / 1e6 * 5), "who": (1, 1, None)}


def test_late_events_are_kept_aside(spark, tmp_path):
    source = tmp_path / "in"
    now = (datetime.now() - START).total_seconds() / 60
    write(source, "a.json", [line(1, "plan"), line(2, "plan", minutes=int(now) + 1500)])
    events = TR.parse_trace(TR.read_trace(spark, str(source)))[0]
    run(TR.start_late(events, str(tmp_path / "late"), str(tmp_path / "state")))
    assert [r.seq for r in spark.read.parquet(str(tmp_path / "late")).collect()] == [1]
    timely, late = TR.late_events(TR.parse_trace(spark.read.text(str(source)))[0])
    assert [r.seq for r in timely.collect()] == [2] and late.count() == 1
