"""Exact blocked top-k against brute force; the positional index against plain search."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.operators import nearest as N
from attestra.operators import postings as P
from attestra.operators import retrieve as R


@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_top_k_equals_brute_force(spark, metric):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((700, 7)).round(2) * rng.choice([0.1, 1, 30], (700, 1))
    x[300:500] = x[3]  # a third of the rows are copies
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, []), (902, [float("nan")] * 7), (903, [0.0] * 7), (904, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "id bigint, vector array<double>").repartition(6)
    queries = table.where("id % 25 = 0 OR id > 900").select(F.col("id").alias("query_id"), "vector")
    got = {(r.query_id, r["rank"]): (r.id, r.value) for r in N.top_k(queries, table, 5, metric=metric, most=9).collect()}
    every = {i: np.array(v) for i, v in rows if v and np.isfinite(v).all() and (metric == "dot" or any(v))}
    unit = lambda v: v / np.sqrt((v * v).sum()) if metric == "cosine" else v
    want = {}
    for q in [i for i in every if i % 25 == 0 or i > 900]:
        scored = sorted((-round(float((unit(every[q]) * unit(v)).sum()), 9), i) for i, v in every.items() if len(v) == len(every[q]))
        want |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(scored[:5])}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-6 for k in want)


def test_top_k_of_nothing(spark):
    empty = spark.createDataFrame([], "id string, vector array<float>")
    some = spark.createDataFrame([("a", [1.0, 0.0])], "id string, vector array<float>")
    assert N.top_k(empty.withColumnRenamed("id", "query_id"), some, 3).count() == 0
    assert N.top_k(some.withColumnRenamed("id", "query_id"), empty, 3).count() == 0
    assert [tuple(r) for r in N.top_k(some.withColumnRenamed("id", "query_id"), some, 3).collect()] == [("a", "a", 1.0, 1)]


def _papers(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "anti-pd1", "x", "Ünï", "β2", "a.b"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(f"P{i}", say(rng.randint(0, 3)), say(rng.randint(0, 30)) if i % 7 else None, say(2) if i % 5 else None, i, i) for i in range(300)]
    rows += [(f"C{i}", "alpha beta", "alpha " * 50, "gamma", 1, 1000 + i) for i in range(150)]  # hot words, copies
    return rows, spark.createDataFrame(rows, "id string, title string, passage string, snippet string, cited_by bigint, ord bigint").repartition(5)


PHRASES = [(1, "alpha beta", ""), (2, "Beta", "gamma delta"), (3, "anti pd1", "ünï"), (4, "x x", "β2"), (5, "", "alpha"), (6, "nowhere", ""), (7, "alpha alpha alpha", "beta"), (8, "A B", "delta gamma")]


def _phrase(text):
    return " " + " ".join(re.findall(r"[^\W_]+", (text or "").lower())) + " "


@pytest.mark.parametrize("size,buckets", [(P.SEGMENT_WORDS, None), (40, None), (200, 4)])
def test_phrases_in_the_index(spark, tmp_path, monkeypatch, size, buckets):
    """Phrases hold within a region; segments, buckets and a kept index give the same hits."""
    monkeypatch.setattr(P, "SEGMENT_WORDS", size)
    rows, pubs = _papers(spark)
    queries = spark.createDataFrame(PHRASES, "query_id bigint, target string, concept string")
    index = R.publication_index(pubs, str(tmp_path / "index") if buckets else None, buckets)
    got = {(r.query_id, r.id) for r in R.pinned_pairs(pubs, queries, index=index).collect()}
    want = set()
    for q, target, concept in PHRASES:
        for i, title, passage, snippet, *_ in rows:
            first = _phrase(" ".join(x for x in (title, passage) if x is not None))
            if target and _phrase(target) in first and (not concept or _phrase(concept) in first or _phrase(concept) in _phrase(snippet)):
                want.add((q, i))
    assert got == want and {q for q, _ in want} >= {1, 2, 3, 7}
    if buckets:
        again = P.load(spark, str(tmp_path / "index"), buckets=buckets)
        assert {(r.query_id, r.id) for r in R.pinned_pairs(pubs, queries, index=again).collect()} == want


def test_substrings_in_the_index(spark):
    rows, pubs = _papers(spark)
    terms = [("t1", "lph"), ("t2", "a"), ("t3", "anti-PD1 x"), ("t4", "-"), ("t5", "pd1 an"), ("t6", "zzz"), ("t7", "β"), ("t7", "ünï"), ("t8", ".b "), ("t9", "et")]
    found = R.term_hits(pubs, "id", R.gate_text(), spark.createDataFrame(terms, "target string, term string"))
    texts = {i: " ".join(x for x in (t, p or "", s or "") if x is not None).lower() for i, t, p, s, *_ in rows}
    assert {(r.target, r.id) for r in found.collect()} == {(t, i) for t, term in terms for i, text in texts.items() if term.lower() in text}


def test_empty_index(spark):
    _, pubs = _papers(spark)
    queries = spark.createDataFrame(PHRASES, "query_id bigint, target string, concept string")
    assert R.pinned_pairs(pubs.limit(0), queries).count() == 0
    assert R.pinned_pairs(pubs, queries.limit(0)).count() == 0
    assert R.term_hits(pubs.limit(0), "id", R.gate_text(), spark.createDataFrame([("t", "a")], "target string, term string")).count() == 0
