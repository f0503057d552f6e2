"""Retrieval on literal rows."""

import pytest
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.functions import vectors as V
from attestra.operators import postings
from attestra.operators import retrieve as R
from attestra.operators.scorer import score_rows


def test_rrf(spark):
    lists = [[("a", 0), ("b", 1), ("a", 2)], [("b", 0), ("c", 1)]]
    rows = [(1, n, i, x) for n, items in enumerate(lists) for x, i in items]
    df = spark.createDataFrame(rows, "query_id int, list_no int, idx int, id string")
    got = [r.id for r in R.rrf(df, limit=10).orderBy("rank").collect()]
    assert got == ["b", "a", "c"]
    one = {(r.id, r.score) for r in R.rrf(df.repartition(1)).collect()}
    assert one == {(r.id, r.score) for r in R.rrf(df.repartition(7)).collect()}


def test_dense_pool(spark):
    pool = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "z", 3)], "query_id int, id string, rank int")
    vecs = spark.createDataFrame([("x", [0.0, 1.0]), ("y", [.8, .2]), ("z", [1.0, 0.0])], "id string, vector array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<float>")
    assert [r.id for r in R.dense_rank_pool(pool, q, vecs).orderBy("dense_rank").collect()] == ["z", "y", "x"]


def test_cosine_edges(spark):
    rows = [([], []), ([1.0], [1.0, 2.0]), ([0.0], [1.0]), ([1.0, 1.0], [1.0, 1.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 0.0, 1.0]


def test_rerank(spark):
    hits = spark.createDataFrame([(1, x, i + 1) for i, x in enumerate("abcd")], "query_id int, id string, rank int")
    scores = spark.createDataFrame([(1, 2.0, .9, 0), (1, 0.0, .5, 1), (1, 2.0, .1, 2), (1, 9.0, 1.0, 3), (1, 1.5, 1.0, 4), (1, 3.0, float("inf"), 5)],
                                   "query_id int, index double, score double, ord int")
    assert [r.id for r in R.apply_rerank(hits, scores).orderBy("rerank").collect()] == ["c", "a", "b", "d"]


def test_target_terms(spark):
    df = spark.createDataFrame([("TROP2", "TACSTD2", ["EGP-1", "M1", "GA733-1"], 2), ("TROP2", "LATER", [], 5), ("X", None, None, 1)],
                               "target string, approved_symbol string, synonyms array<string>, ord long")
    got = {}
    for r in R.target_terms(df).collect():
        got.setdefault(r.target, set()).add(r.term)
    assert got == {"TROP2": {"trop2", "tacstd2", "egp-1", "ga733-1"}, "X": {"x"}}


def test_term_hits(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["trop2 and egfr", "ab", "her2neu", "nothing", None, "xabx"])], "id long, t string")
    terms = spark.createDataFrame([("A", "TROP2"), ("A", "ab"), ("B", "her2"), ("B", "e"), ("C", "neu"), ("C", "absent")], "target string, term string")
    found = {tuple(r) for r in R.term_hits(rows, "id", F.col("t"), terms).collect()}
    want = {(i, t) for i, x in enumerate(["trop2 and egfr", "ab", "her2neu", "nothing", "", "xabx"]) for t, w in (("A", "trop2"), ("A", "ab"), ("B", "her2"), ("B", "e"), ("C", "neu")) if w in x}
    assert found == want
    targets = spark.createDataFrame([("A",), ("D",)], "target string")
    assert [r.target for r in R.open_targets(targets, terms).collect()] == ["D"]


def test_pinned_search(spark):
    pubs = spark.createDataFrame([("p1", "EGFR in lung", "drug resistance", "", False), ("p2", "Other", "egfr mutated; Drug-Resistance", "", True), ("p3", "EGFRvIII", "drug resistance", "", True)],
                                 "id string, title string, passage string, snippet string, is_review boolean")
    queries = spark.createDataFrame([(1, "EGFR", "drug resistance"), (2, "EGFR", ""), (3, "lung", "cited"), (4, "in lung", ""), (5, "lung in", "")], "query_id int, target string, concept string")
    find = lambda **k: {(r.query_id, r.id) for r in R.pinned_search(pubs, queries, **k).collect()}
    assert find() == {(1, "p1"), (1, "p2"), (2, "p1"), (2, "p2"), (4, "p1")} and find(review_only=True) == {(1, "p2"), (2, "p2")}


def test_page_sizes_are_obeyed(spark):
    hits = spark.createDataFrame([(1, f"p{i}", 500 - i, i) for i in range(300)], "query_id int, id string, cited_by long, ord long")
    assert R.top_cited(hits, 150).count() == 150
    with pytest.raises(ValueError):
        R.top_cited(hits, 0)


def test_titles(spark):
    cases = [("The Role of TROP2", "the role of trop2: a review", True), ("a b c d e", "a b c d f", False), ("a b c d e f g h i j", "b a c d e f g h i k", True), ("", "x", False), (None, "x", False)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = [r[0] for r in df.orderBy("i").select(T.titles_match(F.col("a"), F.col("b"))).collect()]
    assert got == [c[2] for c in cases]


def test_scorer_hook(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "id long, text string").repartition(3)

    def good(batch):
        return batch.assign(score=batch["text"].str.len().astype(float))[["score"]]

    def bad(batch):
        raise RuntimeError("service down")

    assert [r.score for r in score_rows(df, ["id"], good, "score double").orderBy("id").collect()] == [2.0] * 6
    down = score_rows(df, ["id"], bad, "score double").collect()
    assert sorted(r.id for r in down) == list(range(6)) and all(r.score is None and "service down" in r.error for r in down)
    short = score_rows(df, ["id"], lambda b: b.head(0).assign(score=[]), "score double")
    assert short.where("score is null").count() == 6


def test_index_segments_are_cut_inside_a_batch(spark, monkeypatch):
    """A batch of many words is more than one segment; a row above the size is one of its own."""
    monkeypatch.setattr(postings, "SEGMENT_WORDS", 10)
    rows = [(i, f"alpha beta w{i} w{i + 1}") for i in range(20)] + [(20, "gamma " * 30), (21, None), (22, "alpha gamma")]
    index = postings.build(spark.createDataFrame(rows, "id bigint, text string").coalesce(1), "id", [F.col("text")])
    held = [[int(i) for i in r["ids"]] for r in index.names.select("ids").collect()]
    assert sorted(i for ids in held for i in ids) == list(range(23))
    assert max(len(ids) for ids in held) == 2 and [20] in held
    asked = spark.createDataFrame([(1, 0, ["alpha", "beta"], 1), (2, 0, ["gamma", "gamma"], 1), (3, 0, ["alpha", "gamma"], 1)], "query int, part int, words array<string>, regions int")
    found = index.named(postings.phrase_rows(index, asked), "id").select("query", "id").collect()
    assert sorted(map(tuple, found)) == [(1, i) for i in range(20)] + [(2, 20), (3, 22)]
