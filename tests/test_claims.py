"""Claims, store and consolidation on literal rows."""

import random
import re

from pyspark.sql import functions as F

from attestra.operators import claims as C
from attestra.operators import consolidate as X
from attestra.operators import store as S

CLAIM = "section_id string, ord long, text string, citations array<string>, confidence double"
EV = "id string, kind string, pmcid string, ord long"


def rate(spark, claims, verdicts, evidence):
    cl = spark.createDataFrame([("s", i, f"t{i}", c, 0.5) for i, c in enumerate(claims)], CLAIM)
    vd = spark.createDataFrame([("s", i, v) for i, v in enumerate(verdicts)], "section_id string, ord long, status string")
    ids = S.source_identity(S.cited_ids(cl), spark.createDataFrame(evidence, EV))
    sections = spark.createDataFrame([("s",)], "section_id string")
    return C.rate_sections(sections, cl, vd, ids).first()["rating"]


def test_rating(spark):
    papers = [("PMID:1", "publication", "PMC1", 1), ("PMID:2", "publication", "", 2), ("PMCID:PMC1#sec-0", "publication", "PMC1", 3), ("PMCID:PMC1#sec-1", "publication", "PMC1", 4)]
    assert rate(spark, [["PMID:1"]], ["unsupported"], papers) == "red"
    assert rate(spark, [["PMID:1"], ["PMID:2"]], ["supported", "supported"], papers) == "green"
    assert rate(spark, [["PMID:1"], ["PMID:2"]], ["supported", "overreach"], papers) == "amber"
    assert rate(spark, [["PMCID:PMC1#sec-0"], ["PMCID:PMC1#sec-1", "PMID:1"]], ["supported", "supported"], papers) == "amber"


def test_claims_of_two_rounds_keep_their_own_verdict(spark):
    """Claim ids restart per round; the key (section, ord) keeps verdicts apart."""
    cl = spark.createDataFrame([("s", 1, "c1"), ("s", 101, "c1")], "section_id string, ord long, id string")
    vd = spark.createDataFrame([("s", 1, "supported"), ("s", 101, "unsupported")], "section_id string, ord long, status string")
    assert [r.ord for r in C.supported(cl, vd).collect()] == [1]


def test_computation_identity(spark):
    ev = spark.createDataFrame([("run:1", "computation", None, 1)], EV)
    runs = spark.createDataFrame([("run:1", "gtex:v8"), ("run:1", "depmap:24q4"), ("run:1", "gtex:v8")], "id string, logical_source_id string")
    assert S.source_identity(ev, ev, runs).first()["source_identity"] == "dataset-release:depmap:24q4+gtex:v8"


def test_grounding_keeps_every_claim(spark):
    cl = spark.createDataFrame([("s", 1, "a", [], .5), ("s", 2, "b", ["X", "PMID:1", "Y"], .5), ("s", 3, "c", ["PMID:1"], .5)], CLAIM)
    shipped, stripped = C.ground(cl, spark.createDataFrame([("PMID:1", "publication", "", 1)], EV))
    assert [r.ord for r in shipped.collect()] == [3]
    assert {r.ord: r.reason for r in stripped.collect()} == {1: "no citation", 2: "citation does not resolve: X, Y"}


def test_migrate(spark):
    df = spark.createDataFrame([("a", None), ("b", "analysis")], "id string, kind string")
    assert [r.kind for r in S.migrate_sections(df).orderBy("id").collect()] == ["research", "analysis"]
    assert S.migrate_sections(df.drop("kind")).where("kind = 'research'").count() == 2


def test_references_of_structured_sources(spark):
    rows = [("ENSG1#expression", "target", "OT", "ABC expression", "s", "http://x#e", "{}", 2), ("ENSG1", "target", "OT", "ABC", "s" * 700, "http://x", "{}", 1),
            ("run:1", "computation", "c", "Run", "s", "u", "{}", 3), ("PMID:1", "publication", "e", "Paper", "", "u", "{}", 4)]
    ev = spark.createDataFrame(rows, "id string, kind string, source string, title string, snippet string, url string, raw string, ord long")
    got = {r.id: r for r in S.references(ev, ev.select("id")).collect()}
    assert got["ENSG1"].title == "Open Targets - target record" and len(got["ENSG1"].snippet) == 700 and got["ENSG1"].raw == "{}"
    assert got["PMID:1"].snippet is None and got["PMID:1"].raw is None and got["run:1"].snippet is None


def test_digest(spark):
    sections = spark.createDataFrame([("r", "s", 0, "Biology", "green", "fine")], "run_id string, section_id string, ord int, title string, rating string, takeaway string")
    cl = spark.createDataFrame([("s", 2, "later", ["PMID:2"], .5), ("s", 1, "first", ["PMID:1", "PMID:9"], .5)], CLAIM)
    flags = spark.createDataFrame([("s", 1, 0, 0, "unblinded", "high", "no mask"), ("s", 1, 0, 1, "p_hacking", "low", "x")],
                                  "section_id string, ord long, audit_ord int, flag_pos int, category string, bias_risk string, explanation string")
    risks = spark.createDataFrame([("r", 0, "severe", "dosing", "PMID:1", "hard"), ("r", 1, "manageable", "dosing", "PMID:1", "ok")],
                                  "run_id string, ord int, severity string, category string, evidence_id string, explanation string")
    clash = spark.createDataFrame([("r", 0, "OS", "differ", "PMID:1", "PMID:2")], "run_id string, ord int, endpoint string, explanation string, id_a string, id_b string")
    lines = [r.line for r in C.digest_lines(sections, cl, flags, risks, clash).orderBy("block", "sort").collect()]
    assert lines == ["## Biology [green]\nfine", "- first [PMID:1] [PMID:9] (AUDIT: high unblinded - no mask)", "- later [PMID:2]",
                     "- severe dosing [PMID:1] - hard", "- OS: differ [PMID:1] vs [PMID:2]"]


def lab_rows():
    rows, full = [], []
    for lab, n, deep in (("B", 3, 3), ("A", 4, 2), ("C", 5, 0), ("D", 1, 0)):
        for i in range(n):
            pid = f"{lab.lower()}{i}"
            rows.append(("T", f"PMID:{pid}", f"PMC{pid}", f"Senior {lab}", "Inst", len(rows)))
            if i < deep:
                full.append(("T", f"PMCID:PMC{pid}#sec-0", f"PMC{pid}", None, None, 1000 + len(full)))
    return rows + full


def test_lab_ranking(spark):
    ev = spark.createDataFrame(lab_rows(), "target string, id string, pmcid string, last_author string, affiliation string, ord long")
    labs = C.rank_labs(ev)
    got = [(r.investigator, r.weight, r.paper_count) for r in labs.orderBy("rank").collect()]
    assert got == [("Senior B", 9, 3), ("Senior A", 8, 4), ("Senior C", 5, 5)]
    ids = [r.id for r in C.lab_evidence(labs, ev).where("investigator = 'Senior B'").orderBy("ord").collect()]
    assert ids == ["PMID:b0", "PMID:b1", "PMID:b2"]


def merged(spark, rows):
    kept, cites = X.consolidate(spark.createDataFrame([("s", i, t, c, conf) for i, (t, c, conf) in enumerate(rows)], CLAIM))
    return {r.ord: r.merged for r in kept.collect()}, sorted((r.ord, r.id) for r in cites.orderBy("ord", "first_ord", "first_pos").collect())


def test_consolidation_cases(spark):
    kept, _ = merged(spark, [("TROP2 is overexpressed.", ["PMID:1"], .7), ("Trop-2 is Overexpressed", ["PMID:1"], .8), ("trop2 is over-expressed", ["PMID:1"], .6)])
    assert kept == {1: 2}
    kept, _ = merged(spark, [("the drug works in mice well", ["PMID:1", "PMID:2"], .7), ("the drug works in mice", ["PMID:2", "PMID:1"], .7)])
    assert kept == {0: 1}
    kept, _ = merged(spark, [("tumour growth was slower", ["PMID:1"], .7), ("expression rises under stress", ["PMID:1"], .7)])
    assert kept == {0: 0, 1: 0}
    kept, cites = merged(spark, [("same fact", ["PMID:1"], .9), ("Same fact!", ["PMID:1", "PMID:2", "PMID:3"], .9)])
    assert kept == {1: 1} and cites == [(1, "PMID:1"), (1, "PMID:2"), (1, "PMID:3")]


def test_blank_keys_never_merge(spark):
    kept, _ = merged(spark, [("κύτταρο", ["PMID:1"], .7), ("клетка", ["PMID:1"], .7)])
    assert kept == {0: 0, 1: 0}


def test_greedy_differs_from_components(spark):
    """A bridging claim joins the first group; the second group stays apart."""
    rows = [("a b c d", ["P"], .5), ("e f g h", ["P"], .5), ("a b c d e f g h", ["P"], .5)]
    df = spark.createDataFrame([("s", i, t, c, conf) for i, (t, c, conf) in enumerate(rows)], CLAIM)
    groups = {r.ord: r.group_id for r in X.claim_groups(df).collect()}
    assert groups[0] == groups[2] != groups[1]


def brute(rows):
    tokens = lambda t: set(re.findall("[a-z0-9]+", t.lower()))

    def same(x, y):
        a, b = tokens(x[1]), tokens(y[1])
        if re.sub("[^a-z0-9]+", "", x[1].lower()) == re.sub("[^a-z0-9]+", "", y[1].lower()):
            return True
        return bool(x[2]) and sorted(x[2]) == sorted(y[2]) and len(a & b) / len(a | b) >= 0.5

    groups = []
    for row in rows:
        home = next((g for g in groups if any(same(m, row) for m in g)), None)
        home.append(row) if home else groups.append([row])
    return {frozenset(m[0] for m in g) for g in groups}


def test_consolidation_equals_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for i in range(250):
        block, words = rng.randrange(15), rng.sample("abcdef", rng.randint(1, 4))
        sep = rng.choice([" ", "", ". "])
        rows.append((i, sep.join(words) + sep + f"k{block}", rng.choice([[f"P{block}"], [f"P{block}", "Q"], []])))
    df = spark.createDataFrame([("s", i, t, c, .5) for i, t, c in rows], CLAIM)
    got = {}
    for r in X.claim_groups(df).collect():
        got.setdefault(r.group_id, set()).add(r.ord)
    assert {frozenset(v) for v in got.values()} == brute(rows)


def test_computation_contract(spark):
    runs = spark.createDataFrame(
        [("m1", "m1", "code", None, "h", "h", [("a", "a")], ["x.y", "s.z::g"]), ("m2", "bad", "code", "zz", "h", "other", [("a", "b")], ["nope"])],
        "computation_id string, manifest_sha string, code_bytes string, code_hash string, results_sha string, results_hash string, "
        "lineage array<struct<declared:string,actual:string>>, result_keys array<string>",
    ).withColumn("code_hash", F.coalesce("code_hash", F.sha2("code_bytes", 256)))
    results = spark.createDataFrame([("m1", "x.y", None, 0, "scalar"), ("m1", "s.z", None, 0, "grouped-series"), ("m1", "s.z", "g", 1, "scalar")],
                                    "computation_id string, result_key string, group_key string, pos int, type string")
    good, bad = S.split_valid(S.check_computations(runs, results))
    assert [r.computation_id for r in good.collect()] == ["m1"]
    assert len(bad.first()["reasons"]) == 5


def test_classes_that_share_some_words_are_no_candidates(spark):
    rng = random.Random(5)
    # all under one citation, every line with common words, three lines nearly alike
    lines = [sorted({*rng.sample([f"c{i}" for i in range(60)], 12), *rng.sample([f"r{i}" for i in range(400)], 12)}) for _ in range(600)]
    lines += [lines[0][:-2] + ["x1"], lines[0][:-3] + ["x2"]]
    sets = [set(w) for w in lines]
    want = {(i, j) for i in range(len(sets)) for j in range(i) if 2 * len(sets[i] & sets[j]) >= len(sets[i] | sets[j])}
    rows = [(i, f"k{i:04d}", "PMID:1", w) for i, w in enumerate(lines)]
    cited = spark.createDataFrame(rows, "no bigint, class_id string, cite_key string, words array<string>")
    found = {tuple(sorted(r, reverse=True)) for r in X.overlap_candidates(cited).collect()}
    assert want <= found and len(found) < len(want) + 100
    edges = {tuple(sorted((int(a[1:]), int(b[1:])), reverse=True)) for a, b in X.overlap_edges(cited).collect()}
    assert edges == want


def test_large_sets_that_share_a_few_words_are_no_candidates(spark):
    rng = random.Random(7)
    lines = [sorted({*rng.sample([f"c{i}" for i in range(300)], n // 4), *rng.sample([f"r{i}" for i in range(4000)], n - n // 4)}) for n in (60, 95, 96, 150, 191, 192, 260, 400) * 30]
    lines += [line[: len(line) * 4 // 5] + [f"x{i}"] for i, line in enumerate(lines[:40])] + [line[len(line) // 2 :] for line in lines[:40]]
    sets = [set(w) for w in lines]
    want = {(i, j) for i in range(len(sets)) for j in range(i) if 2 * len(sets[i] & sets[j]) >= len(sets[i] | sets[j])}
    rows = [(i, f"k{i:04d}", "PMID:1", w) for i, w in enumerate(lines)]
    cited = spark.createDataFrame(rows, "no bigint, class_id string, cite_key string, words array<string>")
    found = {tuple(sorted(r, reverse=True)) for r in X.overlap_candidates(cited).collect()}
    assert len(want) >= 80 and want <= found and len(found) < 2 * len(want), (len(want), len(found))
    edges = {tuple(sorted((int(a[1:]), int(b[1:])), reverse=True)) for a, b in X.overlap_edges(cited).collect()}
    assert edges == want


def test_claims_are_read_and_keyed_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    texts = ["same fact", "Same fact!", "κύτταρο", "a b c d", "a b c e", "κύτταρο", "", "a b c d"]
    rows = [("s", i, t, ["P"], .5) for i, t in enumerate(texts)]
    claims = spark.createDataFrame(rows, CLAIM).withColumn("text", seen.asNondeterministic()("text"))
    groups = {r.ord: r.group_id for r in X.claim_groups(claims).collect()}
    assert groups == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, 7: 3}
    assert read.value == len(rows)
