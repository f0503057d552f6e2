"""Readers on small literal files."""

import hashlib
import json

from pyspark.sql import functions as F

from attestra.operators.retrieve import target_terms
from attestra.sources import gold, literature as L, tables, targets as G


def by_id(df):
    return {r["id"]: r for r in df.collect()}


def test_src_publications(spark, save):
    path = save("hits.json", json.dumps({"resultList": {"result": [
        {"id": "1", "source": "MED", "pmid": "11", "pmcid": "PMC11", "title": "A", "abstractText": "abs", "citedByCount": "7", "isOpenAccess": "Y",
         "firstPublicationDate": "2020-01-01", "doi": "10.1/a", "pubYear": "2020", "journalInfo": {"journal": {"title": "J"}},
         "pubTypeList": {"pubType": ["Journal Article", "Systematic Review"]},
         "authorList": {"author": [
             {"fullName": "First A", "authorId": {"type": "ORCID", "value": "0-1"},
              "authorAffiliationDetailsList": {"authorAffiliation": [{"affiliation": "Inst X"}, {"affiliation": "Inst Y"}]}},
             {"authorId": {"type": "OTHER", "value": "9"}, "authorAffiliationDetailsList": {"authorAffiliation": [{"affiliation": "Inst X"}]}}]}},
        {"id": "2", "source": "PPR", "title": "no pubmed id"},
        {"id": "3", "source": "MED", "pmid": "13"},
    ]}}))
    got = by_id(L.publications(spark, path))
    assert set(got) == {"PMID:11", "PMID:13"}
    one, bare = got["PMID:11"], got["PMID:13"]
    assert one["snippet"] == "cited 7x . 2020-01-01" and one["cited_by"] == 7 and one["is_review"] and one["is_open_access"]
    assert [a["name"] for a in one["metadata"]["authors"]] == ["First A", "(unknown)"]
    assert [a["orcid"] for a in one["metadata"]["authors"]] == ["0-1", None]
    assert one["metadata"]["institutions"] == ["Inst X"] and one["metadata"]["journal"] == "J"
    assert bare["title"] == "(no title)" and bare["metadata"] is None and bare["pmcid"] == "" and not bare["is_open_access"]
    assert bare["snippet"] == "cited 0x ." and one["ord"] < bare["ord"]


def test_src_citations(spark, save):
    path = save("c.json", json.dumps({"request": {"id": "5"}, "citationList": {"citation": [
        {"id": "8", "source": "MED", "title": "t", "citedByCount": 3, "pubYear": "2021"}, {"id": "9", "source": "PPR"}, {"source": "MED"}]}}))
    edges, evidence = L.citations(spark, path)
    assert [(r.cited, r.citing, r.cited_by) for r in edges.collect()] == [("PMID:5", "PMID:8", 3)]
    assert evidence.first()["snippet"] == "cited 3x . 2021"


def test_src_pubmed(spark, save):
    ids = save("ids.json", json.dumps({"esearchresult": {"idlist": ["3", "1", "2"]}}))
    sums = save("sum/s.json", json.dumps({"result": {"uids": ["1", "3"], "3": {"uid": "3", "title": "T3", "source": "J", "pubdate": "2019"}, "1": {"uid": "1"}}}))
    rows = L.pubmed(spark, ids, sums).orderBy("ord").collect()
    assert [r["id"] for r in rows] == ["PMID:3", "PMID:1", "PMID:2"]
    assert [r["title"] for r in rows] == ["T3", "(no title)", "(no title)"]
    assert rows[0]["snippet"] == "J 2019" and rows[2]["snippet"] == ""


def test_src_doi(spark, save):
    path = save("r.json", json.dumps({"message": {"DOI": "10.1/x", "title": ["A", "B"], "container-title": [], "issued": {"date-parts": [[2018, 5]]}}}))
    row = L.doi_registry(spark, path).first()
    assert (row.doi, row.reg_title, row.reg_journal, row.reg_year) == ("10.1/x", "A", None, "2018")


ARTICLE = """<pmc-articleset><article xmlns:xlink="http://www.w3.org/1999/xlink"><front><title>x</title></front><body>
<sec><title>Intro</title><p>one <b>bold</b>
 text</p><sec><p>inner</p></sec><p>two</p></sec>
<sec><title>Empty</title><sec><title>Deep</title><p>deep text</p><fig><label>Figure 1</label><caption><p>cap one</p></caption><graphic xlink:href="f1.jpg"/></fig></sec></sec>
<fig><label>none</label></fig><fig><caption><p>bare %s</p></caption></fig>
</body></article></pmc-articleset>""" % ("y" * 250)


def test_page_sections_and_figures(spark, save, tmp_path):
    save("x/PMC7.xml", ARTICLE)
    save("x/PMC8.xml", "<article><body><sec><p>broken")
    parsed = L.parse_articles(L.read_articles(spark, str(tmp_path / "x")))
    secs = L.fulltext(parsed).orderBy("ord").collect()
    assert [(r["id"], r["title"], r["passage"]) for r in secs] == [
        ("PMCID:PMC7#sec-0", "Intro", "one bold text two"), ("PMCID:PMC7#sec-1", "Section 2", "inner"), ("PMCID:PMC7#sec-2", "Deep", "deep text")]
    figs = L.figures(parsed).orderBy("ord").collect()
    assert [r["id"] for r in figs] == ["PMCID:PMC7#fig-0", "PMCID:PMC7#fig-2"]
    assert figs[0]["url"].endswith("/bin/f1.jpg") and figs[0]["metadata"]["imageRef"] == "f1.jpg" and figs[0]["title"] == "Figure 1"
    assert figs[1]["title"] == "Figure 3" and figs[1]["snippet"] == figs[1]["passage"] and figs[1]["metadata"] is None


def test_web_page_sections(spark):
    html = "<body><script>var a='<h2>no</h2>';</script><h2>One</h2><p>first</p><H2 class='x'>Two</H2><h2>Three</h2>third <b>part</b></body>"
    rows = L.page_sections(spark.createDataFrame([(1, "u", html)], "page_id int, url string, html string")).orderBy("pos").collect()
    assert [(r.title, r.passage) for r in rows] == [("One", "first"), ("Three", "third part")]


def test_resolve_target(spark, save):
    path = save("t.json", json.dumps({"data": {"search": {"hits": [
        {"id": "EFO_1", "name": "d", "entity": "disease"}, {"id": "X1", "name": "x", "entity": "target"},
        {"id": "ENSG1", "name": "GENE1", "entity": "target"}, {"id": "ENSG2", "name": "GENE2", "entity": "target"}]}}}))
    assert [(r["id"], r["title"]) for r in G.resolve_target(spark, path).collect()] == [("ENSG1", "GENE1")]


def test_target_cards(spark, save):
    path = save("target.json", json.dumps({"data": {"target": {
        "id": "ENSG9", "approvedSymbol": "ABC1", "approvedName": "abc one", "symbolSynonyms": [{"label": "AB"}, {"label": "ABCX"}], "nameSynonyms": [{"label": "ABCX"}],
        "tractability": [{"modality": "AB", "label": "Antibody high", "value": True}, {"modality": "SM", "label": "Pocket", "value": True}, {"modality": "AB", "label": "surface", "value": False}],
        "safetyLiabilities": [{"event": "rash"}, {"event": "rash"}, {}], "subcellularLocations": [{"location": "Cell membrane"}, {"termSL": "Cytoplasm"}],
        "baselineExpression": {"rows": [{"median": 2.0, "datatypeId": "rna", "tissueBiosample": {"biosampleName": "liver"}},
                                        {"median": 9.0, "datatypeId": "proteomics", "tissueBiosample": {"biosampleName": "skin"}},
                                        {"median": None, "tissueBiosample": {"biosampleName": "lung"}}]},
        "associatedDiseases": {"rows": [{"score": 0.5, "disease": {"id": "EFO_1", "name": "dis"}}]},
        "drugAndClinicalCandidates": {"rows": [{"maxClinicalStage": "3", "drug": {"id": "D1", "name": "drug"}}, {"drug": None}]}}}}))
    cards = G.target_cards(spark, path)
    rows = cards.orderBy("ord").collect()
    assert [r["id"] for r in rows] == ["ENSG9", "ENSG9#localization", "ENSG9#expression", "ENSG9#tractability", "ENSG9#safety", "EFO_1", "D1"]
    text = {r["id"]: r["snippet"] for r in rows}
    assert text["ENSG9"] == "tractability: 3 modalities; safety liabilities: 3"
    assert text["ENSG9#localization"].startswith("Subcellular location: Cell membrane; Cytoplasm. Surface")
    assert "skin (9, proteomics); liver (2, rna)." in text["ENSG9#expression"] and text["ENSG9#expression"].endswith("as protein: skin.")
    assert text["ENSG9#tractability"].endswith("antibodies: AB: Antibody high.")
    assert text["ENSG9#safety"] == "Safety events: rash."
    assert text["EFO_1"] == "association score 0.50 for ABC1" and text["D1"].endswith("max clinical stage 3")
    terms = target_terms(G.target_records(cards))
    assert {r.term for r in terms.collect()} == {"abc1", "abcx"}


def test_protein_cards(spark, save):
    feats = [{"type": "Transmembrane"}, {"type": "Topological domain", "description": "Extracellular"}, {"type": "Domain", "description": "Ig"}, {"type": "Domain", "description": "Ig"}]
    path = save("p.json", json.dumps({"symbol": "ABC1", "results": [{
        "primaryAccession": "P1", "proteinDescription": {"recommendedName": {"fullName": {"value": "Abc"}}},
        "comments": [{"commentType": "FUNCTION"}, {"commentType": "SUBCELLULAR LOCATION", "subcellularLocations": [{"location": {"value": "Nucleus"}}]}], "features": feats}]}))
    rows = G.protein_cards(spark, path).orderBy("ord").collect()
    assert [r["id"] for r in rows] == ["UNIPROT:P1#localization", "UNIPROT:P1#domains"]
    assert rows[0]["snippet"].startswith("Subcellular location: Nucleus. 1 transmembrane region(s) with an extracellular domain. Reachable")
    assert rows[1]["snippet"] == "Annotated domains: Ig."


def test_src_trials(spark, save):
    study = lambda nct, phases, status: {"protocolSection": {"identificationModule": {"nctId": nct}, "statusModule": {"overallStatus": status}, "designModule": {"phases": phases}}}
    path = save("t.json", json.dumps({"studies": [study("NCT1", ["PHASE1", "PHASE2"], "DONE"), study(None, [], "X"), study("NCT2", None, None)]}))
    assert [(r["id"], r["snippet"]) for r in G.trials(spark, path).orderBy("ord").collect()] == [("NCT1", "PHASE1/PHASE2 DONE"), ("NCT2", "")]


def test_src_patent_hits(spark, save):
    doc = lambda kind, c, n, k, d=None: {"@document-id-type": kind, "country": {"$": c}, "doc-number": {"$": n}, "kind": {"$": k}, **({"date": {"$": d}} if d else {})}
    exch = lambda ids, **bib: {"exchange-document": {"bibliographic-data": {"publication-reference": {"document-id": ids}, **bib}}}
    hits = [
        exch([doc("epodoc", "", "EP123", ""), doc("docdb", "EP", "123", "A1", "20200102")], **{
            "invention-title": [{"@lang": "de", "$": "Titel"}, {"@lang": "en", "$": "Title"}],
            "parties": {"applicants": {"applicant": [{"applicant-name": {"name": {"$": "ACME"}}}, {"applicant-name": {"name": {"$": "ACME"}}}]}},
            "patent-classifications": {"patent-classification": [{"section": {"$": "A"}, "class": {"$": "61"}, "subclass": {"$": "K"}}]}}),
        exch([doc("docdb", "EP", "123", "A1")]),
        exch([{"doc-number": {"$": "US777B2"}}]),
        {"exchange-document": {"bibliographic-data": {}}},
    ] + [exch([doc("docdb", "WO", str(i), "A1")]) for i in range(10)]
    path = save("s.json", json.dumps({"ops:world-patent-data": {"ops:biblio-search": {"ops:search-result": {"exchange-documents": hits}}}}))
    assert G.patent_hits(spark, path).count() == 12
    rows = G.patent_hits(spark, path, limit=8).orderBy("ord").collect()
    assert len(rows) == 8 and [r["id"] for r in rows[:3]] == ["PATENT:EP123A1", "PATENT:US777B2", "PATENT:WO0A1"]
    assert rows[0]["title"] == "Title" and rows[0]["snippet"] == "ACME · 2020-01-02 · IPC A61K"
    assert rows[1]["title"] == "(no title)"


def test_gold_load(spark, save, tmp_path):
    base = {"label": "go", "allowedVerdicts": ["go"], "rationale": "r", "curator": "c", "curatedAt": "2026-01-01"}
    save("g/A.json", json.dumps({"target": "A", **base}))
    save("g/B.json", json.dumps({"target": "B", **base, "label": "watch"}))
    save("g/C.trap.json", json.dumps({"target": "C", **base, "trap": {"kind": "fictional"}}))
    save("g/_subset.json", json.dumps({"fast": ["A"]}))
    save("g/D.json", json.dumps({"target": "D", **base}))
    good, bad = gold.load_gold(spark, str(tmp_path / "g"))
    assert {r.target for r in good.collect()} == {"A", "D"}
    assert {r.target: r.reasons for r in bad.collect()} == {
        "B": ["allowed verdicts leave out the label"], "C": ["a trap target must allow abstention"]}
    assert [r.target for r in gold.load_gold(spark, str(tmp_path / "g"), ["A"])[0].collect()] == ["A"]


def test_dataset_hash(spark, save, tmp_path):
    save("d/one.csv", "a\n1\n")
    save("d/two.csv", "b\n")
    sha = hashlib.sha256(b"a\n1\n").hexdigest()
    manifest = spark.createDataFrame(
        [("one", "depmap", {"release": "24Q4"}, sha), ("two", "cbio", {"studyId": "s"}, sha), ("three", "x", {"other": "y"}, sha)],
        "id string, source string, source_ids map<string,string>, sha256 string")
    got = {r.id: (r.logical_source_id, r.matches) for r in tables.verify_datasets(spark, str(tmp_path / "d"), manifest).collect()}
    assert got == {"one": ("depmap:24Q4", True), "two": ("cbio:s", False), "three": ("x:three", False)}
