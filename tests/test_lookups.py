"""Patent look-ups and alignment searches on odd and broken responses."""

import json
import re

import pytest

from attestra.sources import lookups as LK

DOC = "doc_id string, text string"


def looked_up(spark, biblio, family=(), legal=()):
    out = LK.patent_lookups(*[spark.createDataFrame([(d, t if isinstance(t, str) or t is None else json.dumps(t)) for d, t in rows], DOC) for rows in (biblio, family, legal)])
    return [df.collect() for df in out]


def data(**parts):
    return {"ops:world-patent-data": parts}


def test_what_is_missing_or_broken(spark):
    member = {"publication-reference": {"document-id": {"country": "EP", "doc-number": 5}}}
    records, members, events = looked_up(
        spark, [("a", "nope"), ("b", {}), ("c", None), ("d", data(**{"exchange-documents": {"exchange-document": {"bibliographic-data": 7}}}))],
        [("a", data(**{"ops:patent-family": {"ops:family-member": member}})), ("b", data(**{"ops:patent-family": {"ops:family-member": [member, {}, {"publication-reference": {"document-id": []}}]}})), ("d", "{")],
        [("b", data(**{"ops:legal": {"@country": "EP", "@doc-number": "5", "@code": "WD", "@date": "bad"}})), ("d", "[]")],
    )
    assert {r.doc_id: (r.found, r.title, r.applicants, r.estimated_expiry) for r in records} == {"a": (False, None, [], None), "b": (True, None, [], None), "c": (False, None, [], None), "d": (True, None, [], None)}
    assert [(m.doc_id, m.pos, m.country, m.number, m.kind, m.status) for m in members] == [("b", 0, "EP", "5", None, "inactive")]
    assert [(e.code, e.category, e.effect, e.date) for e in events] == [("WD", "withdrawn", "inactive", None)]


def test_status_follows_the_latest_event(spark):
    ref = lambda n: {"publication-reference": {"document-id": {"country": "US", "doc-number": n}}}
    law = lambda n, code, date: {"@country": "US", "@doc-number": n, "ops:legal": {"@code": code}, "@code": "XX", "@date": date}
    _, members, _ = looked_up(
        spark, [("a", {}), ("b", {})], [(d, data(**{"ops:patent-family": {"ops:family-member": [ref("1"), ref("2"), ref("3")]}})) for d in "ab"],
        [("a", data(**{"ops:legal": [law("1", "MM4A", "20220101"), law("1", "PG25", "20180101"), law("2", "PG25", "20200101"), law("2", "WD", "20200101"), law("3", "ZZ", "20200101")]}))],
    )
    assert {(m.doc_id, m.number): m.status for m in members} == {("a", "1"): "inactive", ("a", "2"): "inactive", ("a", "3"): "unknown", ("b", "1"): "unknown", ("b", "2"): "unknown", ("b", "3"): "unknown"}


def test_alignment_responses(spark):
    hsp = lambda i, a, f, t: f"<Hsp><Hsp_identity>{i}</Hsp_identity><Hsp_align-len>{a}</Hsp_align-len><Hsp_query-from>{f}</Hsp_query-from><Hsp_query-to>{t}</Hsp_query-to><Hsp_evalue>0.0</Hsp_evalue></Hsp>"
    hit = lambda acc, text, *hsps: f"<Hit><Hit_accession>{acc}</Hit_accession>{text}<Hit_hsps>{''.join(hsps)}</Hit_hsps></Hit>"
    body = lambda *its: "<BlastOutput><BlastOutput_query-len>30</BlastOutput_query-len><BlastOutput_iterations>" + "".join(f"<Iteration><Iteration_hits>{i}</Iteration_hits></Iteration>" for i in its) + "</BlastOutput_iterations></BlastOutput>"
    first = hit("A", "<Hit_def>x [Homo sapiens] [y]</Hit_def>", hsp(29, 30, 1, 30), hsp(1, 2, 1, 2)) + hit("B", "", hsp(1, 3, 2, 11)) + hit("C", "<Hit_def>z</Hit_def>")
    rows = [("q", "blastn", "patnt", body(first, hit("D", ""))), ("none", "blastp", "nr", body("")), ("bad", "blastp", "nr", "<BlastOutput><"), ("null", "blastp", "nr", None)]
    found = LK.alignment_hits(spark.createDataFrame(rows, "query_id string, program string, database string, xml string"))
    got = [(r.id, r["rank"], r.percent_identity, r.query_coverage, r.organism, r.snippet, r.passage) for r in found.orderBy("rank").collect()]
    assert got == [
        ("BLAST:A", 1, 96.7, 100.0, "Homo sapiens", "96.7% id, E=0.0, Homo sapiens", "Aligned 30 residues, query coverage 100%."),
        ("BLAST:B", 2, 33.3, 33.3, "", "33.3% id, E=0.0", "Aligned 3 residues, query coverage 33.3%."),
        ("BLAST:C", 3, 0.0, 3.3, "", "0% id, E=", "Aligned 0 residues, query coverage 3.3%."),
    ]
    assert {(r.kind, r.title, r.url) for r in found.collect()} >= {("patent", "(no description)", "https://www.ncbi.nlm.nih.gov/nuccore/B")}
    assert LK.alignment_hits(spark.createDataFrame(rows, "query_id string, program string, database string, xml string"), 1).count() == 1
    with pytest.raises(ValueError):
        LK.alignment_hits(found, 0)


def _parses(df):
    return len(re.findall("(?i)parse_?json", df._jdf.queryExecution().optimizedPlan().toString()))


def test_responses_are_parsed_once(spark):
    """What is read twice later on was written down first: no plan parses a response again."""
    from attestra.sources import targets

    text = json.dumps({"ops:world-patent-data": {"ops:biblio-search": {"ops:search-result": {"exchange-documents": {"exchange-document": {"bibliographic-data": {
        "publication-reference": {"document-id": {"@document-id-type": "docdb", "country": {"$": "US"}, "doc-number": {"$": "1"}, "kind": {"$": " "}}}}}}}}}})
    rows = lambda key, text, kind: spark.createDataFrame([(key, text)], kind).repartition(1)
    found = targets.patent_evidence(targets.patent_records(rows(1, text, "record bigint, text string")))
    assert [r["id"] for r in found.select("id").collect()] == ["PATENT:US1"]
    assert _parses(found) == 0
    records, _, events = LK.patent_lookups(*[rows("a", "{}", DOC)] * 3)
    assert records.first()["found"] and _parses(records) == 0
    assert _parses(events) > 0


def test_responses_are_written_where_lines_met(spark):
    """The shuffle of the made responses carries numbers: no markup before the gather, and the lines keep their order."""
    from checks import lookups
    from checks.base import Tables

    t = Tables(spark, "")
    t.known[("table", "lineitem")] = spark.createDataFrame(
        [(1, 20, 3, 2, 31.0), (1, 10, 4, 1, 1.0), (1, 20, 3, 2, 11.0), (1, 30, 5, 3, 21.0), (17, 10, 4, 1, 1.0)],
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double")
    found = lookups.alignment_hits(t)
    assert [tuple(r) for r in found.orderBy("rank").collect()] == [
        (1, 1, "BLAST:P10", "dataset", 0.0, 3.3, "Sp 4"), (1, 2, "BLAST:P20", "dataset", 100.0, 20.0, ""), (1, 3, "BLAST:P20", "dataset", 100.0, 53.3, "")]
    gather = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "partial_collect_list" in line]
    assert gather and not any("<Hit>" in line for line in gather)
