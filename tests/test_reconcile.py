"""Own state: order of arrival, late verdicts, restarts and silent runs, against one batch."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from test_trace import line, run, write

from attestra.streaming import reconcile as RC
from attestra.streaming import trace as TR

CLAIM = lambda i, o, minutes, run="r1": line(i, "claim_drafted", run=run, minutes=minutes, section_id="s", claim={"id": "c", "ord": o, "text": f"t{o}"})
VERDICT = lambda i, o, status, minutes, run="r1": line(i, "verdict", run=run, minutes=minutes, section_id="s", verdict={"claimId": "c", "ord": o, "status": status})


@pytest.fixture(autouse=True)
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def events(spark, source):
    return TR.parse_trace(TR.read_trace(spark, str(source), 1))[0]


def last(spark, out):
    newest = Window.partitionBy("run_id", "section_id", "ord").orderBy(F.desc("revision"))
    rows = spark.read.parquet(out).withColumn("rn", F.row_number().over(newest)).where("rn = 1")
    return {(r.run_id, r.ord): (r.text, r.status, r.late) for r in rows.collect()}


def test_orders_of_arrival_and_late_verdicts(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    start = lambda: run(TR.start_sink(RC.reconciled(events(spark, source)), out, str(tmp_path / "state")))
    write(source, "a.json", [CLAIM(1, 1, 1), VERDICT(2, 2, "supported", 5), CLAIM(3, 3, 1), CLAIM(4, 4, 2)])
    write(source, "b.json", [VERDICT(5, 1, "supported", 6), CLAIM(6, 2, 3), line(7, "plan", minutes=4)])
    start()  # a restart between the two of a pair
    write(source, "c.json", [line(8, "plan", minutes=200), CLAIM(9, 9, 201)])  # past claim 3's and 4's wait
    write(source, "d.json", [line(10, "plan", minutes=201)])  # the timers of claims 3 and 4 go off
    write(source, "e.json", [VERDICT(11, 3, "overreach", 202), VERDICT(12, 9, "unsupported", 203), VERDICT(13, 1, "unsupported", 204)])
    write(source, "f.json", [line(14, "plan", minutes=206)])
    start()
    rows = spark.read.parquet(out)
    assert [r.status for r in rows.where("ord = 3").orderBy("revision").collect()] == [None, "overreach"]  # open, then corrected
    assert [r.status for r in rows.where("ord = 1").orderBy("revision").collect()] == ["supported", "unsupported"]
    got = last(spark, out)
    batch = RC.verdicts_of(TR.parse_trace(spark.read.text(str(source)))[0]).collect()
    want = {(r.run_id, r.ord): (r.text, r.status, r.late) for r in batch}
    assert got == {k: v for k, v in want.items()} and want[("r1", 3)] == ("t3", "overreach", True) and want[("r1", 2)] == ("t2", "supported", False) and want[("r1", 4)][1] is None


def test_any_split_equals_the_batch(spark, tmp_path):
    """Random claims and verdicts, dealt over files: the last revisions are the batch's rows."""
    rng = random.Random(7)
    lines = []
    for o in range(40):
        run_id = f"r{o % 3}"
        if o % 5:
            lines.append((rng.randrange(100), CLAIM(o, o, rng.randrange(60), run_id)))
        for j in range(rng.choice([0, 1, 1, 2])):
            lines.append((rng.randrange(100), VERDICT(100 + o, o, rng.choice(["supported", "overreach"]), rng.randrange(100), run_id)))
    source = tmp_path / "in"
    lines.sort(key=lambda x: x[0])
    for n in range(3):
        write(source, f"{'abc'[n]}.json", [t for _, t in lines[n::3]])
    write(source, "x.json", [line(999, "plan", minutes=100), CLAIM(1000, 999, 500)])
    write(source, "y.json", [CLAIM(1001, 999, 501)])
    run(TR.start_sink(RC.reconciled(events(spark, source), delay="3 hours", keep=timedelta(days=9)), str(tmp_path / "out"), str(tmp_path / "state")))
    batch = RC.verdicts_of(TR.parse_trace(spark.read.text(str(source)))[0])
    want = {(r.run_id, r.ord): (r.text, r.status, r.late) for r in batch.collect() if r.ord != 999}
    assert {k: v for k, v in last(spark, str(tmp_path / "out")).items() if k[1] != 999} == want


def test_state_goes_and_orphans_are_told(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    write(source, "a.json", [VERDICT(1, 1, "supported", 1), CLAIM(2, 2, 1), VERDICT(3, 2, "supported", 2)])
    write(source, "b.json", [CLAIM(4, 8, 3000)])
    write(source, "c.json", [CLAIM(5, 9, 3001)])
    query = TR.start_sink(RC.reconciled(events(spark, source), keep=timedelta(hours=5)), out, str(tmp_path / "state"))
    run(query)
    assert last(spark, out)[("r1", 1)] == (None, "supported", None)
    assert query.lastProgress.stateOperators[0].numRowsRemoved > 0 or any(p.stateOperators[0].numRowsRemoved > 0 for p in query.recentProgress)


def test_runs_are_totalled_in_parts(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    start = lambda: run(TR.start_sink(RC.run_totals(events(spark, source), delay="10 minutes", idle=timedelta(hours=1)), out, str(tmp_path / "state")))
    write(source, "a.json", [line(1, "tool_result", count=3, minutes=1), line(2, "error", minutes=2), line(3, "tool_result", run="r2", count=1, minutes=3)])
    write(source, "b.json", [line(4, "tool_result", count=4, minutes=5)])
    start()
    write(source, "c.json", [line(5, "plan", run="r3", minutes=300)])
    write(source, "d.json", [line(6, "tool_result", count=2, minutes=301)])  # the run goes on: its second part
    write(source, "e.json", [line(7, "plan", run="r3", minutes=900)])
    write(source, "f.json", [line(8, "plan", run="r3", minutes=901)])
    start()
    rows = spark.read.parquet(out)
    assert {(r.part, r.type, r.n, r.results, r.errors) for r in rows.where("run_id = 'r1'").collect()} == {(0, "tool_result", 2, 7, 0), (0, "error", 1, 0, 1), (1, "tool_result", 1, 2, 0)}
    whole = TR.event_counts(TR.parse_trace(spark.read.text(str(source)))[0]).where("run_id <> 'r3'")
    summed = rows.where("run_id <> 'r3'").groupBy("run_id", "type").agg(F.sum("n"), F.sum("results"), F.sum("errors"))
    assert sorted(map(tuple, summed.collect())) == sorted(map(tuple, whole.collect()))


def test_usage_deltas_add_up(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "usage")
    go = lambda: run(RC.start_usage_deltas(events(spark, source), out, str(tmp_path / "state")))
    write(source, "a.json", [line(1, "usage", model="claude-haiku-4-5", tokens_in=10, tokens_out=2), line(2, "usage", model="who", tokens_in=1, tokens_out=1)])
    go()
    write(source, "b.json", [line(3, "usage", model="claude-haiku-4-5", tokens_in=5, tokens_out=1), line(4, "plan")])
    go()
    deltas = spark.read.parquet(out)
    assert deltas.where("batch = 1").count() == 1  # only what the batch brought
    got = {r.model: (r.calls, r.tokens_in, r.cost_usd) for r in RC.usage_total(spark, out).collect()}
    assert got == {"claude-haiku-4-5": (2, 15, 15 / 1e6 + 3 / 1e6 * 5), "who": (1, 1, None)}
