"""Patent text, regions and constructs on literal rows."""

from pyspark.sql import functions as F

from attestra.functions import numbers as N
from attestra.functions import seqs as S
from attestra.operators import figures as FG
from attestra.operators import patents as P
from attestra.operators import quality as Q
from attestra.plans.workup import work_up


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_patent_numbers(spark):
    got = column(spark, ["US 10,123,456 B2", "EP1234567", "not-a-patent", "12345", "us-123.a"], S.patent_number)
    assert [g and (g.epodoc, g.kind) for g in got] == [("US10123456", "B2"), ("EP1234567", None), None, None, ("US123", "A")]


def test_find_patent_no(spark):
    assert column(spark, ["Filed as Patent No. US 10,123,456 B2 on ...", "no number here", "see WO 2019/123456 A1"], S.first_patent_number) == [
        "US10123456", None, "WO2019123456"]


def test_listing_text(spark):
    md = "SEQ ID NO: 1\nEVQLVESGGG\n\nSEQ ID NO: 2\nDIQ MTQ SPSS\n\nSEQ ID NO: 1\nZZZZZZ\n\nthe CDR-H1 comprises SEQ ID NO: 3 and other text"
    got = [(r.seq_id, r.residues, r.declared_length) for r in P.text_listing(docs(spark, md, "SEQ ID NO: 5\nMET\n")).orderBy("seq_id").collect()]
    assert got == [(1, "EVQLVESGGG", None), (2, "DIQMTQSPSS", None)]


def test_declared_len(spark):
    one = "<210> 1\n<211> 12\n<212> PRT\n<213> Homo sapiens\nSEQ ID NO: 1\nARDYYGSSYFDY\n\n"
    two = "<210> 1\n<210> 2\n<211> 9\nSEQ ID NO: 1\nEVQLVESGG\n\nSEQ ID NO: 2\nARDYYGSS\n"
    got = {(r.doc_id, r.seq_id): r.declared_length for r in P.text_listing(docs(spark, one, two)).collect()}
    assert got == {(0, 1): 12, (1, 1): None, (1, 2): 9}


def entry(i, seq, length, features=""):
    table = f"<INSDSeq_feature-table>{features}</INSDSeq_feature-table>" if features else ""
    return (f'<SequenceData sequenceIDNumber="{i}"><INSDSeq><INSDSeq_length>{length}</INSDSeq_length>{table}'
            f"<INSDSeq_sequence>{seq}</INSDSeq_sequence></INSDSeq></SequenceData>")


def listing(*entries):
    return f'<?xml version="1.0"?>\n<ST26SequenceListing>{"".join(entries)}</ST26SequenceListing>'


def feature(where, *quals):
    q = "".join(f"<INSDQualifier><INSDQualifier_name>{n}</INSDQualifier_name><INSDQualifier_value>{v}</INSDQualifier_value></INSDQualifier>" for n, v in quals)
    return f"<INSDFeature><INSDFeature_location>{where}</INSDFeature_location><INSDFeature_quals>{q}</INSDFeature_quals></INSDFeature>"


def test_listing_xml(spark):
    good = listing(entry(1, "ARDYYGSSYFDY", 12), entry(2, "EVQLVESGG", 9), entry(1, "GGGGGG", 6), entry("x", "GGGG", 4), entry(3, "AR", 2))
    rows = P.sequences(docs(spark, good, "<ST26SequenceListing><SequenceData", listing(entry(3, "EVQLVESGG", 9)), "SEQ ID NO: 5\nEVQLVESGG\n\n")).collect()
    got = sorted((r.doc_id, r.seq_id, r.residues, r.declared_length) for r in rows if r.doc_id != 3)
    assert got == [(0, 1, "ARDYYGSSYFDY", 12), (0, 2, "EVQLVESGG", 9), (2, 3, "EVQLVESGG", 9)]
    assert [(r.seq_id, r.residues) for r in rows if r.doc_id == 3] == [(5, "EVQLVESGG")]


def test_listings_are_read_once(spark):
    """XML and text listings go through one pass: a document is not made again for the other route."""
    text = ("<210> 9\n<211> 99999999999999999999\n<210> 1\n<211> 12\n<210> 9\n<211> 8\n<210> 1\n<211> 13\nSEQ ID NO: 9\nMET\n\nSEQ ID NO: 9\nEVQLVESGG\n\n"
            "SEQ ID NO: 1\nARDYY\n\nSEQ ID NO: 99999999999999999999\nGGGGG\n\nSEQ ID NO: 1\nDIQMTQ\n\n")
    xml = listing(entry(1, "AR", 2), entry(1, "ARDYYGSSYFDY", "about"), entry(99999999999999999999, "GGGG", 4), entry(1, "GGGGGG", 6))
    two = docs(spark, text, xml, "nothing here").withColumn("text", F.reverse(F.reverse("text")))
    found = P.sequences(two)
    got = {(r.doc_id, r.seq_id, r.pos, r.residues, r.declared_length) for r in found.collect()}
    assert got == {(0, 9, 1, "EVQLVESGG", None), (0, 1, 2, "ARDYY", 12), (0, None, 3, "GGGGG", None), (1, 1, 1, "ARDYYGSSYFDY", None)}
    # Under one id, the routes stay apart.
    same = P.sequences(two.withColumn("doc_id", F.lit(7)))
    assert {(r.seq_id, r.residues, r.declared_length) for r in same.where("seq_id = 1").collect()} == {(1, "ARDYY", 12), (1, "ARDYYGSSYFDY", None)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("reverse(reverse(") == 1 and "Join" not in plan and "Union" not in plan


def test_xml_assoc(spark):
    xml = listing(
        entry(1, "EVQLVESGG", 9, feature("1..9", ("product", "kappa light chain"), ("note", "heavy chain variable region")) + feature("1..9", ("note", "VH"))),
        entry(2, "DIQMTQSPS", 9, feature("2..5", ("note", "CDR-L1")) + feature("1..9", ("standard_name", "VL"))),
        entry(4, "GGGG", 4, feature("1..4", ("note", "something else"))))
    got = sorted((r.seq_id, r.region_label) for r in P.xml_associations(docs(spark, xml)).collect())
    assert got == [(1, "VH"), (2, "VL")]


def test_region_label(spark):
    cases = {
        "Heavy chain CDR1": "CDR-H1", "CDR-L3": "CDR-L3", "HCDR2": "CDR-H2", "L-CDR1": "CDR-L1", "light chain variable region": "VL", "VH": "VH",
        "variable region": None, "heavy chain": "heavy-chain", "kappa light chain": "light-chain", "Fab fragment": "Fab", "Fc region": "Fc", "CH1 domain": "CH1",
        "constant light": "CL", "hinge": "hinge", "CDR1": None, "heavy and light variable": None, "signal peptide": None, "complementarity CDR H3 loop": "CDR-H3"}
    assert dict(zip(cases, column(spark, list(cases), S.region_label))) == cases


def test_norm_seq(spark):
    assert column(spark, [">sp|P1\nacd ef\n  >x\nGH-1\r\n"], S.sequence_text) == ["ACDEFGH"]
    assert column(spark, ["ACGTUN", "EVQL", ""], S.alphabet) == ["blastn", "blastp", "blastp"]


def test_species(spark):
    rows = [("human", "Homo sapiens"), ("human", None), ("mouse", "Homo sapiens"), ("mouse", "Mus musculus"), ("mouse", ""), ("human", "Mus"), (None, "Homo"), ("camel", None)]
    df = spark.createDataFrame([(i, v, c) for i, (v, c) in enumerate(rows)], "i int, v string, c string")
    got = [r[0] for r in df.orderBy("i").select(S.species_class(F.col("v"), F.col("c"))).collect()]
    assert got == ["human-like", "human-like", "chimeric", "murine", "murine", "unknown", "unknown", "unknown"]


def numbered(doc, seq, chain, species, residues, start=1):
    return [(doc, seq, chain, species, i, str(start + i), aa) for i, aa in enumerate(residues)]


NUMBERING = "doc_id long, seq_id long, chain string, species string, ord int, position string, aa string"


def test_regions_keep_insertions(spark):
    rows = [(1, "H", 0, "26", "A"), (1, "H", 1, "27", "C"), (1, "H", 2, "28", "-"), (1, "H", 3, "29A", "D"), (1, "H", 4, "129", "W")]
    got = {r.label: (r.seq, r.first_pos, r.last_pos) for r in P.derive_regions(
        spark.createDataFrame(rows, "domain_id int, chain string, ord int, position string, aa string")).collect()}
    assert got == {"VH": ("ACDW", 26, 129), "FR-H1": ("A", 26, 26), "CDR-H1": ("CD", 27, 29)}


def test_check_regions(spark):
    regions = spark.createDataFrame([(1, "H", 0, "VH", "EVQL"), (1, "H", 0, "CDR-H1", "GY")], "case_id int, chain string, domain_no int, label string, seq string")
    claims = [("VH", "xxEV QLxx"), ("CDR-H1", "g y"), ("CDR-H1", "GYT"), ("CDR-L1", "AA"), ("Fc", "AA"), ("FR-H4", "AA"), ("odd", "AA")]
    claimed = spark.createDataFrame([(1, i, l, s) for i, (l, s) in enumerate(claims)] + [(2, 0, "Fc", "A")], "case_id int, pos int, label string, sequence string")
    checks, overall = P.check_regions(claimed, regions)
    got = [r.status for r in checks.where("case_id = 1").orderBy("pos").collect()]
    assert got == ["confirmed", "confirmed", "mismatch", "orphan_unverifiable", "not_applicable_constant", "orphan_unverifiable", "orphan_unverifiable"]
    assert {r.case_id: r.overall_status for r in overall.collect()} == {1: "mismatch", 2: "partial"}


def corpus(spark):
    vh = "E" * 26 + "GYTFTSYW" + "H" * 90
    text = f"Patent US 10,123,456 B2\nSEQ ID NO: 1\n{vh}\n\nSEQ ID NO: 2\nDIQMTQSPSS\n\nSEQ ID NO: 3\nGYTFTSYW\n\nSEQ ID NO: 4\nRASQSVSS\n\n"
    hit = "doc_id long, seq_id long, accession string, percent_identity double, query_coverage double, mismatch_count int, exact_match boolean, organism string, ord int"
    return dict(
        docs=docs(spark, text, "too short"),
        associations=spark.createDataFrame([(0, 1, "VH", 0), (0, 2, "VL", 1)], "doc_id long, seq_id long, region_label string, pos long"),
        members=spark.createDataFrame(
            [(0, "Ab1", 0, "VH", 1), (0, "Ab1", 1, "VL", 2), (0, "Ab1", 2, "CDR-H1", 3), (0, "Ab1", 3, "CDR-L1", 3), (0, "Ab1", 4, "heavy-chain", 1), (0, "Ab1", 5, "Fc", 99)],
            "doc_id long, name string, pos int, region_label string, seq_id long"),
        numbering=spark.createDataFrame(numbered(0, 1, "H", "mouse", vh[:34]), NUMBERING),
        general_hits=spark.createDataFrame([(0, 1, "N1", 99.0, 100.0, 1, False, "Homo sapiens", 0), (0, 1, "N2", 99.9, 100.0, 0, True, "Mus", 1)], hit),
        patent_hits=spark.createDataFrame([(0, 1, "R1", 98.0, 100.0, 0, True, "", 0), (0, 1, "R2", 97.9, 100.0, 0, True, "", 1), (0, 2, "R3", 100.0, 100.0, 0, True, "", 2)], hit),
        loop_hits=spark.createDataFrame([(0, 1, "L1", 91.0, 100.0, 1, False, "", 0), (0, 1, "L2", 89.9, 100.0, 1, False, "", 1)], hit),
        applicants=spark.createDataFrame([(0, "ACME")], "doc_id long, company string"),
    )


def test_workup(spark):
    out = work_up(**corpus(spark))
    assert [r.doc_id for r in out.rejected.collect()] == [1]
    assert [(r.doc_id, r.patent_number) for r in out.numbers.collect()] == [(0, "US10123456")]
    done = out.completeness.first()
    assert (done.found_count, done.referenced_max, done.association_count, done.missing_count) == (4, 4, 2, 0)
    marks = {(r.region_label, r.seq_id): r.cdr_confirmation for r in out.regions.collect()}
    assert marks == {("VH", 1): None, ("VL", 2): None, ("CDR-H1", 3): "confirmed", ("CDR-L1", 3): "no_anchor", ("heavy-chain", 1): None}
    assert out.species.first()["classification"] == "chimeric"
    assert out.pairing.first()["warning"] == "heavy chain with no paired light chain"
    assert out.shape.first()["disclosure_shape"] == "antibody"
    edges = sorted((r.subject, r.predicate, r.object, r.confidence) for r in out.edges.collect())
    assert edges == sorted([
        ("US10123456", "OWNED_BY", "ACME", "verified"), *[("US10123456", "DISCLOSES", f"SEQ:{i}", "claimed") for i in (1, 2, 3, 4)],
        *[("Ab1", "HAS_REGION", f"SEQ:{i}", "claimed") for i in (1, 1, 2, 3, 3)], *[("SEQ:1", "MATCHES", "R1", "verified")] * 2, ("SEQ:1", "MATCHES", "L1", "claimed")])


def test_shape_without_domain(spark):
    c = corpus(spark)
    assert P.disclosure_shape(c["docs"].where("doc_id = 0"), c["members"], c["numbering"].limit(0)).first()["disclosure_shape"] == "not-standard-antibody"


def test_cdr_hits(spark):
    c = corpus(spark)
    heavy = spark.createDataFrame([(0, "Ab1", 1), (0, "Ab2", None)], "doc_id long, name string, vh_seq_id long")
    assert [r.accession for r in P.loop_competitors(heavy, c["loop_hits"]).collect()] == ["L1"]


def test_fact_index(spark):
    c = corpus(spark)
    out = work_up(**c)
    regions = out.regions.withColumn("construct_no", F.lit(0))
    patents = spark.createDataFrame([(0, None, [])], "doc_id long, patent_number string, applicants array<string>")
    facts = P.fact_index(regions, out.species, P.top_general_hit(c["docs"].selectExpr("0L doc_id", "1L seq_id", "60 length").limit(1), c["general_hits"]), c["patent_hits"].where("accession = 'R1'"), patents)
    got = {r.citation: r.fact for r in facts.collect()}
    assert got["SEQ:1"] == "heavy-chain SEQ:1 in Ab1 (species chimeric); nr top hit N1 99% mismatches=1"
    assert got["SEQ:3"] == "CDR-L1 SEQ:3 in Ab1 (species chimeric); CDR no_anchor"
    assert got["R1"] == "competitor patent R1 98% mismatches=0" and got["patent"] == "patent unknown; applicants unknown"
    points = spark.createDataFrame([(0, 1, ["R1", "who"]), (0, 2, [])], "doc_id long, point_id int, citations array<string>")
    assert {r.point_id: r.evidence for r in P.cited_facts(points, facts).collect()} == {1: "competitor patent R1 98% mismatches=0\nwho", 2: "(no cited evidence)"}


def test_invalid_residues(spark):
    df = spark.createDataFrame([(0, 1, "EVQL"), (0, 2, "EXBXJ")], "doc_id int, seq_id int, residues string")
    assert [(r.seq_id, r.invalid_chars) for r in P.invalid_residues(df).collect()] == [(2, "XBJ")]


def test_patent_records(spark):
    biblio = spark.createDataFrame([(1, "2005-06-15"), (2, "20050615")], "doc_id int, filing_date string")
    family = spark.createDataFrame([(1, "US", "1"), (1, "EP", "2")], "doc_id int, country string, number string")
    legal = spark.createDataFrame([("US", "1", "PG25", "2018-01-01", 0), ("US", "1", "MM4A", "2022-01-01", 1), ("EP", "2", "ZZ", None, 2)],
                                  "country string, number string, code string, date string, ord int")
    records, members = P.patent_records(biblio, family, legal)
    assert {r.doc_id: (r.family_size, r.estimated_expiry) for r in records.collect()} == {1: (2, "2025-06-15"), 2: (0, None)}
    assert {r.member: r.status for r in members.collect()} == {"US1": "inactive", "EP2": "unknown"}
    assert column(spark, ["20200102", "2020"], S.iso_date) == ["2020-01-02", None]


def test_numeric_captions(spark):
    assert column(spark, ["0.620", "0·62", "1,234", "5.", "10", "1,234,567.50"], N.numeric_text) == ["0.62", "0.62", "1234", "5", "10", "1234567.5"]
    figs = spark.createDataFrame([("f", "pooled HR 0·620 (n=1,234)")], "figure_id string, caption string")
    values = [("a", "0.62", None), ("b", "0.41", None), ("c", " ", None), ("d", "1234", None)]
    raw = spark.createDataFrame([("f", "pie", "r", .5, values), ("g", "bar", "r", .5, values)],
                                "figure_id string, figure_type string, reading string, confidence double, values array<struct<label:string,value:string,unit:string>>")
    row = FG.gate_readings(raw, figs).collect()
    assert len(row) == 1 and row[0].figure_type == "other"
    assert [v.read_risk for v in row[0]["values"]] == ["low", "high", "high", "low"]


def test_m_species(spark):
    expected = spark.createDataFrame([(1, 1, 2, "human-like"), (1, 3, None, "murine"), (1, None, None, "murine")], "doc_id int, vh_seq_id int, vl_seq_id int, species string")
    got = spark.createDataFrame([(1, 1, 9, "murine", 0), (1, 1, 2, "human-like", 1), (1, 3, 4, "murine", 2)], "doc_id int, vh_seq_id int, vl_seq_id int, species string, ord int")
    row = Q.construct_accuracy(expected, got).first()
    assert (round(row.species_accuracy, 3), round(row.pairing_accuracy, 3)) == (0.667, 0.333)
