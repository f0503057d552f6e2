"""The dossier job from evidence to rated, united claims."""

from attestra import constants as K
from attestra.plans.dossier import build_dossier

EVIDENCE = "id string, kind string, source string, title string, snippet string, passage string, locator string, url string, raw string, pmcid string, target string, last_author string, affiliation string, ord bigint"
CLAIM = "section_id string, ord bigint, text string, citations array<string>, confidence double"
VERDICT = "section_id string, ord bigint, status string"


def paper(i, ord, author="Lab A", title=None):
    return (f"PMID:{i}", "publication", "Europe PMC", title or f"paper {i}", "", "text", None, f"http://x/{i}", None, f"PMC{i}", "T", author, "Home", ord)


def made(spark, claims, verdicts, gaps=None):
    suffix, section = K.CARD_ROUTES[0]
    card = (f"ENSG1{suffix}", "target", K.CARD_SOURCES[0], "card", "a card text", None, None, "http://t#x", "{}", "", "T", None, None, 50)
    rows = [paper(1, 1), paper(2, 2), paper(1, 9, title="a later copy"), paper(3, 3, "Lab B"), card]
    frame = lambda data, kind: spark.createDataFrame(data, kind)
    sections = frame([("s1",), ("s2",), (section,)], "section_id string")
    extra = None if gaps is None else frame(gaps, CLAIM)
    return section, build_dossier(frame(rows, EVIDENCE), frame(claims, CLAIM), frame(verdicts, VERDICT), sections, extra)


CLAIMS = [
    ("s1", 0, "The drug works", ["PMID:1"], 0.5), ("s1", 1, "the drug works!", ["PMID:1", "PMID:2"], 3.0), ("s1", 2, "unknown source", ["PMID:404"], 0.5),
    ("s2", 3, "THE DRUG WORKS.", ["PMID:3"], None), ("s2", 4, "another finding entirely", ["PMID:3"], 0.4), ("s2", 5, "not borne out", ["PMID:1"], 0.9),
]
VERDICTS = [("s1", 0, "supported"), ("s1", 1, "supported"), ("s2", 3, "supported"), ("s2", 4, "supported"), ("s2", 5, "unsupported")]


def test_from_evidence_to_united_claims(spark):
    section, done = made(spark, CLAIMS, VERDICTS)
    assert {r.ord for r in done.stripped.collect()} == {2}
    assert {r.section_id: r.rating for r in done.sections.collect()} == {"s1": "green", "s2": "amber", section: "red"}
    final = {(r.block, r.section_id, r.text): r for r in done.claims.collect()}
    # the best supported wording of the fact stays, with clamped confidence; cards come in front
    assert set(final) == {(1, "s1", "the drug works!"), (1, "s2", "another finding entirely"), (0, section, f"a card text ({K.CARD_SOURCES[0]})")}
    assert final[1, "s1", "the drug works!"].confidence == 1.0
    united = done.citations.where("ord = 1").orderBy("first_ord", "first_pos").collect()
    assert [r.id for r in united] == ["PMID:1", "PMID:2", "PMID:3"]  # no source of a merged claim is lost
    refs = {r.id: r.title for r in done.references.collect()}
    assert refs["PMID:1"] == "paper 1" and {"PMID:1", "PMID:2", "PMID:3", "ENSG1"} == set(refs)
    assert {(r.investigator, r.paper_count) for r in done.labs.collect()} == {("Lab A", 2), ("Lab B", 1)}


def test_gap_claims_rate_their_section_again(spark):
    section, done = made(spark, CLAIMS, VERDICTS, [("s2", 100, "found in the gap round", ["PMID:2"], 0.6), ("nowhere", 101, "no such section", ["PMID:2"], 0.6)])
    assert {r.section_id: r.rating for r in done.sections.collect()} == {"s1": "green", "s2": "green", section: "red"}
    assert {r.text for r in done.claims.where("block = 1").collect()} == {"the drug works!", "another finding entirely", "found in the gap round"}


def test_nothing_drafted(spark):
    section, done = made(spark, [], [])
    assert {r.rating for r in done.sections.collect()} == {"red"} and done.citations.count() == 0
    assert [r.block for r in done.claims.collect()] == [0]
