"""The pipeline's stages on the smallest driver tables, each against brute force on its own input."""

from __future__ import annotations

import brute
import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from attestra.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    """Every stage's rows, each stage reading what the one before wrote."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [(docs.columns, docs.collect())]
    for name, stage in P.STAGES:
        done = stage(spark, docs, FOLDER)
        done.write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append((docs.columns, docs.collect()))
    return out


def test_stage_columns(results):
    assert [name for name, _ in P.STAGES] == ["language", "near_duplicates", "decontaminate", "secrets", "pack"]
    assert all(columns == results[0][0] for columns, _ in results[:5])


def test_language_keeps_documents_with_letters(results):
    kept = {r["doc_id"] for r in results[1][1]}
    lettered = {r["doc_id"] for r in results[0][1] if any(c.isalpha() for c in r["text"] or "")}
    assert kept <= lettered and len(kept) >= 0.98 * len(lettered)


def test_one_document_of_each_group_stays(results):
    want = brute.jaccard_components([(r["doc_id"], r["text"]) for r in results[1][1]], 5, 80)
    assert {r["doc_id"] for r in results[2][1]} == {d for d, (_, root) in want.items() if d == root}


def test_contaminated_documents_go(spark, results):
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    found = brute.contamination([(r["doc_id"], r["text"]) for r in results[2][1]], items)
    assert {r["doc_id"] for r in results[3][1]} == {f[0] for f in found if not f[5]}


def test_secrets_are_replaced(results):
    before = {r["doc_id"]: r for r in results[3][1]}
    assert {r["doc_id"] for r in results[4][1]} == set(before)
    for r in results[4][1]:
        old = before[r["doc_id"]]
        if r["text"] != old["text"]:
            assert "[SECRET]" in r["text"] and r["n_chars"] == len(r["text"])
        elif old["text"] is not None:
            assert not brute.base_secrets(old["text"]) and r["n_chars"] == old["n_chars"]


def test_pieces_fill_sequences(results):
    by: dict[int, list] = {}
    for r in results[5][1]:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {r["doc_id"] for r in results[5][1]} == {r["doc_id"] for r in results[4][1]}
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048


def test_run_gives_the_last_stage(spark, results):
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, P.run(spark, FOLDER).collect())) == sorted(map(key, results[5][1]))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    from compare import compare, duck

    assert compare(spark, duck(FOLDER), queries.QUERIES[name], queries.ORACLES[name], FOLDER) is None


def test_every_operator_has_a_query():
    names = entry.queries()
    assert "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.QUERIES) <= set(names)


def test_secrets_stage_passes_plain_texts_by(spark):
    rows = [(1, "plain words " * 50, 600), (2, "token=abcdefgh1 end", 19), (3, "see AKIA" + "Z" * 16 + " here", 34), (4, None, 0)]
    out = P.redact(spark, spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint"), "")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all(_text" in plan and "regexp_extract_all(text" not in plan and "regexp_extract_all(coalesce(text" not in plan
    assert sorted(map(tuple, out.collect())) == [rows[0], (2, "[SECRET] end", 12), (3, "see [SECRET] here", 17), rows[3]]
