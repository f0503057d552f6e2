"""Frozen-table analysis, replay gate, canonical JSON and sinks."""

import hashlib
import json
import statistics

import pytest
from canonical import canonical, number_text
from pyspark.sql import functions as F

from attestra import constants as K
from attestra.functions import canon
from attestra.functions.aggregates import percentiles
from attestra.operators import analysis as A
from attestra.plans.locked import locked_job, run_locked
from attestra.sources import hashes, sinks, tables
from attestra.operators.store import check_results

DEPMAP = "model_id,cell_line_name,lineage,primary_disease,gene_effect\n" + "".join(
    f"M{i:02d},c{i},{'Lung' if i < 6 else ('' if i < 8 else 'Skin')},d,{'' if i == 3 else (-1.0 + i / 10)}\n" for i in range(10))
GTEX = "tissue_id,tissue_name,median_tpm\nT1,Liver,1.5\nT2,Skin,7.25\nT3,Lung,\n"
TUMOR = "study_id,molecular_profile_id,sample_id,sample_type,sample_class,expression_value\n" + "".join(
    f"{K.COHORT_STUDY},{K.COHORT_PROFILE},S{i},x,{'tumor' if i < 4 else ''},{10 * i}\n" for i in range(6))


def paths(save, **change):
    texts = {"depmap.crispr_gene_effect": DEPMAP, "gtex.median_tpm": GTEX, "expr.tumor": TUMOR, **change}
    return {name: save(f"{name}/{name}.csv", text) for name, text in texts.items()}


PARAMS = {"target": "TACSTD2", "analysisQuestion": "trop2_profile"}


def test_locked_job(spark, save):
    results, warnings = run_locked(spark, K.ANALYSIS_TEMPLATE, paths(save), PARAMS, "run1")
    rows = {(r.result_key, r.group_key): r for r in results.collect()}
    effects = [-1.0 + i / 10 for i in range(10) if i != 3]
    assert rows["dependency.median_gene_effect", None].value == pytest.approx(statistics.median(effects))
    assert rows["dependency.models_at_or_below_locked_cutoff_n", None].value == sum(e <= -0.5 for e in effects)
    assert rows["dependency.fraction_at_or_below_locked_cutoff", None].value == round(sum(e <= -0.5 for e in effects) / 9, 6)
    assert rows["dependency.fraction_at_or_below_locked_cutoff", None].missing_n == 1
    assert [k[1] for k in rows if k[0] == "dependency.median_by_lineage"] == [None, "Lung"]
    assert rows["tumor_expression.q1_by_sample_class", "tumor"].value == 7.5
    assert rows["tumor_expression.median_by_sample_class", "normal"].nullable
    assert rows["normal_tissue.median_tpm_by_tissue", "T3"].value is None
    assert rows["normal_tissue.maximum_tissue_median_tpm", None].value == 7.25
    assert sorted(r.warning[:12] for r in warnings.collect()) == ["2 samples of", "No observed "]
    assert check_results(results).where(F.size("reasons") > 0).count() == 0

    claims = {r.binding.result_key: r.text for r in A.result_claims(results).collect()}
    assert len(claims) == 3
    assert claims["dependency.fraction_at_or_below_locked_cutoff"].startswith("Of 9 cell-line models with data in the frozen DepMap table, 55.5556% ")
    assert "template's -0.5 gene-effect cutoff" in claims["dependency.fraction_at_or_below_locked_cutoff"]
    assert "median of 15.000 RSEM over 4 tumor samples" in claims["tumor_expression.median_by_sample_class::tumor"]
    assert "is 7.250 TPM:" in claims["normal_tissue.maximum_tissue_median_tpm"]

    doc = json.loads(sinks.results_json(results).first()["json"])["results"]
    assert list(doc) == sorted(doc) and doc["normal_tissue.maximum_tissue_median_tpm"]["value"] == 7.25
    assert "groups" not in doc["normal_tissue.maximum_tissue_median_tpm"]
    assert {g["key"] for g in doc["normal_tissue.median_tpm_by_tissue"]["groups"]} == {"T1", "T2", "T3"}


@pytest.mark.parametrize("name,text,part", [
    ("gtex.median_tpm", "tissue_id,tissue_name\nT1,Liver\n", "expected columns"),
    ("gtex.median_tpm", GTEX + "T1,Again,2\n", "blank or repeated"),
    ("gtex.median_tpm", GTEX + "T9,Bad,-2\n", "negative median_tpm"),
    ("gtex.median_tpm", GTEX + "T9,Bad,inf\n", "is not a number"),
    ("expr.tumor", TUMOR.replace(K.COHORT_STUDY, "other"), "reviewed cohort"),
    ("expr.tumor", TUMOR.replace("tumor,10", "blood,10"), "unreviewed sample_class"),
    ("depmap.crispr_gene_effect", DEPMAP.replace("-1.0", "n/a"), "is not a number"),
])
def test_columns_and_fatal_rules(spark, save, name, text, part):
    with pytest.raises(A.ContractError, match=part):
        run_locked(spark, K.ANALYSIS_TEMPLATE, paths(save, **{name: text}), PARAMS, "r")


def test_locked_inputs_are_fixed(spark, save):
    sets = paths(save)
    for template, datasets, params in [("other", sets, PARAMS), (K.ANALYSIS_TEMPLATE, {"x": "y"}, PARAMS), (K.ANALYSIS_TEMPLATE, sets, {**PARAMS, "target": "X"})]:
        with pytest.raises(A.ContractError):
            run_locked(spark, template, datasets, params, "r")


REVIEWED = "id string, source string, source_ids map<string,string>, sha256 string, retrieved_at string"


def test_locked_job_checks_contents_version_and_seed(spark, save, tmp_path):
    texts = {"depmap.crispr_gene_effect": DEPMAP, "gtex.median_tpm": GTEX, "expr.tumor": TUMOR}
    for name, text in texts.items():
        save(f"all/{name}.csv", text)
    entries = [(n, "src", {"release": "r1"}, hashlib.sha256(t.encode()).hexdigest(), "2026-07-17") for n, t in texts.items()]
    go = lambda rows=entries, **more: locked_job(spark, K.ANALYSIS_TEMPLATE, str(tmp_path / "all"), spark.createDataFrame(rows, REVIEWED), PARAMS, **more)
    one, two = go(), go(list(reversed(entries)))
    assert one.computation_id == two.computation_id == hashlib.sha256(canonical(one.manifest).encode()).hexdigest()
    assert {r.computation_id for r in one.results.select("computation_id").distinct().collect()} == {one.computation_id}
    assert {d["logicalSourceId"] for d in one.manifest["datasets"]} == {"src:r1"} and one.manifest["seed"] == 1729
    for bad in (dict(version="2.0.0"), dict(seed=1), dict(rows=entries[:2]), dict(rows=[*entries[:2], (*entries[2][:3], "0" * 64, "x")])):
        with pytest.raises(A.ContractError):
            go(**bad)


def test_hash_of_a_file_beyond_two_gib(spark, tmp_path):
    """A sparse file of 2 GiB and a few bytes, beside small ones."""
    large, size = tmp_path / "files" / "large.bin", (2 << 30) + 5
    large.parent.mkdir()
    with open(large, "wb") as f:
        f.truncate(size)
    (large.parent / "small.bin").write_bytes(b"abc")
    (large.parent / "none.bin").write_bytes(b"")
    state, zeros = hashlib.sha256(), bytes(1 << 20)
    for _ in range(size >> 20):
        state.update(zeros)
    state.update(bytes(size & ((1 << 20) - 1)))
    got = {r.path.rsplit("/", 1)[1]: (r.bytes, r.sha256) for r in hashes.file_hashes(hashes.listed(spark, str(large.parent))).collect()}
    assert got == {"large.bin": (size, state.hexdigest()), "small.bin": (3, hashlib.sha256(b"abc").hexdigest()), "none.bin": (0, hashlib.sha256(b"").hexdigest())}


def test_normalisers(spark):
    effects = spark.createDataFrame([("M1", "-0.5")], "`ModelID` string, `TACSTD2 (4070)` string")
    models = spark.createDataFrame([("M2", "b"), ("M1", "a")], "`ModelID` string, `CellLineName` string")
    assert [tuple(r) for r in tables.normalize_depmap(effects, models).collect()] == [("M1", "a", "Unknown", "", "-0.5"), ("M2", "b", "Unknown", "", "")]
    with pytest.raises(A.ContractError):
        tables.normalize_depmap(effects.union(effects), models)
    samples = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "sample_id string")
    clinical = spark.createDataFrame([("s1", "SAMPLE_TYPE", "Metastatic", 1), ("s2", "SAMPLE_TYPE", "Solid Tissue Normal", 2), ("s3", "AGE", "4", 3)],
                                     "sample_id string, attribute string, value string, ord long")
    values = spark.createDataFrame([("s1", 4070, 2.5), ("s1", 1, 9.0)], "sample_id string, entrez_gene_id int, value double")
    got = [(r.sample_id, r.sample_class, r.expression_value) for r in tables.normalize_tumor(samples, clinical, values).collect()]
    assert got == [("s1", "tumor", "2.5"), ("s2", "normal", ""), ("s3", "unknown", "")]
    gtex = spark.createDataFrame([("T", 2.0)], "tissueSiteDetailId string, median double")
    assert tuple(tables.normalize_gtex(gtex).first()) == ("T", "T", "2.0")


def test_percentiles_on_a_hot_group_and_ties(spark):
    rows = spark.range(30000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 300).cast("string"))).alias("g"),
        F.when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 5 == 0, 1.0).otherwise((F.col("id") * 7919) % 10007 / 10).alias("v"))
    points = {"a": 0.0, "q1": 0.25, "m": 0.5, "p9": 0.9, "z": 1.0}
    got = percentiles(rows, ["g"], "v", points)
    want = rows.groupBy("g").agg(*[F.percentile("v", p).alias("x_" + n) for n, p in points.items()])
    bad = got.join(want, "g").where(" OR ".join(f"abs({n} - x_{n}) > 1e-9 OR {n} IS NULL" for n in points))
    assert bad.count() == 0 and got.count() == want.count()
    whole = percentiles(rows, [], "v", {"m": 0.5}).first()["m"]
    assert whole == pytest.approx(rows.agg(F.percentile("v", 0.5)).first()[0])


MANIFEST = {
    "manifestVersion": "1.0.0", "templateId": "trop2_analysis", "templateVersion": "1.0.0",
    "datasets": [{
        "datasetId": "depmap.crispr_gene_effect", "logicalSourceId": "depmap:public-24q4",
        "contentSha256": "53ada942b62a3d78b1784b04599e1b64f4cbe29367224dc9ef055b77b1d43948",
        "acquisitionQuery": {"gene": "TACSTD2", "release": "24Q4"}, "retrievedAt": "2026-07-17T20:58:39Z", "lineageManifestHash": "1" * 64}],
    "imageDigest": "sha256:" + "2" * 64, "codeHash": "3" * 64, "params": {"target": "TACSTD2", "question": "dependency"}, "seed": 1729,
}


def test_computation_id(spark):
    second = {**MANIFEST["datasets"][0], "datasetId": "gtex.median_tpm"}
    one = {**MANIFEST, "datasets": [MANIFEST["datasets"][0], second]}
    two = {**MANIFEST, "datasets": [second, MANIFEST["datasets"][0]]}
    df = spark.createDataFrame([(i, json.dumps(m)) for i, m in enumerate([MANIFEST, one, two])], "i int, j string")
    ids = [r[0] for r in df.select(canon.computation_id(F.col("j"))).collect()]
    assert ids[0] == "cff1da85cd9f4629ce5ea560e04648fb85be4d29958d4c996771a8df88609797"
    assert ids[1] == ids[2] != ids[0]


def test_canonical_json():
    assert canonical({"z": 1, "a": {"y": 2.0, "x": [3, {"b": True, "a": None}]}}) == '{"a":{"x":[3,{"a":null,"b":true}],"y":2},"z":1}'
    for x, text in [(1e-6, "0.000001"), (1e-7, "1e-7"), (1.5e-7, "1.5e-7"), (1e21, "1e+21"), (123456789012345680000.0, "123456789012345680000"),
                    (-0.5, "-0.5"), (0.1, "0.1"), (100, "100"), (1234.5, "1234.5"), (-0.0, "0"), (2.5e25, "2.5e+25")]:
        assert number_text(x) == text
    with pytest.raises(ValueError):
        number_text(float("nan"))


RESULT = "computation_id string, result_key string, group_key string, pos long, type string, value double, unit string, tolerance double"


def typed(spark, rows):
    return spark.createDataFrame(rows, RESULT).select(
        "*", F.lit("none").alias("comparator"), F.lit(None).cast("double").alias("threshold"), F.lit("neutral").alias("direction"), F.lit(1).alias("precision"),
        F.lit(0).alias("missing_n"), F.lit(1).alias("observed_n"), F.lit(1).alias("total_n"), F.lit(0.0).alias("fraction"), F.lit(1).alias("sample_n"),
        F.lit(False).alias("nullable"), F.lit(None).cast("string").alias("note"))


def test_gate_makes_claims_once(spark):
    """The claims' own plan runs once, and each meets its value and its runs in one join of each kind."""
    bind = lambda key, value: F.struct(F.lit("c1").alias("computation_id"), F.lit(key).alias("result_key"), F.lit(value).alias("asserted_value"), F.lit("u").alias("asserted_unit"))
    made = spark.range(4).select(
        F.lit("s").alias("section_id"), F.col("id").alias("ord"), F.array(F.upper(F.concat(F.lit("ru"), F.when(F.col("id") >= 0, "n")))).alias("citations"),
        F.when(F.col("id") == 0, bind("s::g", 5.0)).when(F.col("id") == 1, bind("s::a::g", 5.0)).when(F.col("id") == 2, bind("x.y", 2.0)).alias("binding"))
    runs = spark.createDataFrame([("c1", "RUN", True, ["x.y", "s::g", "s::a::g"], 0, False, None, True, True, True)],
                                 "computation_id string, evidence_id string, valid boolean, result_keys array<string>, exit_code int, timed_out boolean, signal string, "
                                 "primary_valid boolean, replay_valid boolean, same_contract boolean")
    good = [("c1", "x.y", None, 0, "scalar", 2.0, "u", 0.1), ("c1", "s", "g", 1, "scalar", 5.0, "u", 0.1), ("c1", "s", "a::g", 2, "scalar", 5.0, "u", 0.1)]
    found = A.reproduce_gate(made, runs, typed(spark, good), typed(spark, good))
    assert {r["ord"]: r["drop_reason"] for r in found.collect()} == {
        0: None, 1: "bound result is missing or null", 2: None, 3: "claim cites computation evidence without a structured binding"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "upper(" not in plan and plan.count("Join ") == 7
    cached = A.reproduce_gate(made, runs, typed(spark, good), typed(spark, good), "cached", True)
    assert cached._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 5


def gate(spark, mode="live", origin=False, claim=None, comp=None, primary=None, replay=None):
    """Drop reason of one bound claim after one change to an otherwise good case."""
    base_claim = {"section_id": "s", "ord": 1, "citations": ["run:1"], "binding": ("c1", "x.y", 2.0, "u")}
    base_comp = {"computation_id": "c1", "evidence_id": "run:1", "valid": True, "result_keys": ["x.y", "z"], "exit_code": 0, "timed_out": False,
                 "signal": None, "primary_valid": True, "replay_valid": True, "same_contract": True}
    cl = spark.createDataFrame([{**base_claim, **(claim or {})}],
                               "section_id string, ord long, citations array<string>, binding struct<computation_id:string,result_key:string,asserted_value:double,asserted_unit:string>")
    cp = spark.createDataFrame([{**base_comp, **(comp or {})}],
                               "computation_id string, evidence_id string, valid boolean, result_keys array<string>, exit_code int, timed_out boolean, signal string, "
                               "primary_valid boolean, replay_valid boolean, same_contract boolean")
    good = [("c1", "x.y", None, 0, "scalar", 2.0, "u", 0.1), ("c1", "s", None, 0, "grouped-series", None, "u", 0.1), ("c1", "s", "g", 1, "scalar", 5.0, "u", 0.1)]

    def table(rows):
        return spark.createDataFrame(rows, RESULT).select(
            "*", F.lit("none").alias("comparator"), F.lit(None).cast("double").alias("threshold"), F.lit("neutral").alias("direction"), F.lit(1).alias("precision"),
            F.lit(0).alias("missing_n"), F.lit(1).alias("observed_n"), F.lit(1).alias("total_n"), F.lit(0.0).alias("fraction"), F.lit(1).alias("sample_n"),
            F.lit(False).alias("nullable"), F.lit(None).cast("string").alias("note"))

    row = A.reproduce_gate(cl, cp, table(primary or good), table(replay or good), mode, origin).first()
    return row["drop_reason"] or (row["execution_mode"], row["replay_verification"], row["origin_verification"])


def test_reproducibility_gate(spark):
    assert gate(spark) == ("live", "verified", "none")
    assert gate(spark, mode="cached", origin=True) == ("cached", "not_run", "verified")
    assert gate(spark, mode="cached") == "cached computation lacks verified signed origin"
    assert gate(spark, claim={"binding": None}) == "claim cites computation evidence without a structured binding"
    assert gate(spark, claim={"binding": None, "citations": ["PMID:1"]}) == (None, None, None)
    assert gate(spark, comp={"valid": False}) == "missing valid computation evidence"
    assert gate(spark, claim={"citations": ["PMID:1"]}) == "claim does not cite its computation evidence"
    assert gate(spark, comp={"result_keys": ["z"]}) == "result key is absent from computation evidence"
    for change in ({"exit_code": 1}, {"exit_code": None}, {"timed_out": True}, {"signal": "KILL"}):
        assert gate(spark, comp=change) == "computation did not exit successfully"
    assert gate(spark, comp={"primary_valid": False}).startswith("primary results failed")
    assert gate(spark, claim={"binding": ("c1", "z", 2.0, "u")}) == "bound result is missing or null"
    assert gate(spark, claim={"binding": ("c1", "x.y", 2.0, "kg")}) == "asserted unit does not match typed result"
    assert gate(spark, claim={"binding": ("c1", "x.y", 42.0, "u")}) == "asserted value does not match typed result"
    assert gate(spark, comp={"replay_valid": False}) == "replay results failed schema validation"
    assert gate(spark, comp={"same_contract": False}).startswith("replay run contract")
    other = [("c1", "x.y", None, 0, "scalar", 2.05, "u", 0.1), ("c1", "s", None, 0, "grouped-series", None, "u", 0.1), ("c1", "s", "g", 1, "scalar", 5.5, "u", 0.1)]
    assert gate(spark, replay=other) == "replay output mismatched beyond the declared tolerance"


def test_usage_unknown_price(spark):
    calls = spark.createDataFrame([("claude-haiku-4-5", 10**6, 10**6), ("ollama/q", 5, 5), ("who", 1, 1)], "model string, tokens_in long, tokens_out long")
    per = A.priced(A.usage_by_model(calls), A.price_table(spark))
    assert {r.model: r.cost_usd for r in per.collect()} == {"claude-haiku-4-5": 6.0, "ollama/q": 0.0, "who": None}
    total = A.usage_total(per).first()
    assert total.cost_usd is None and not total.pricing_known
    known = A.usage_total(per.where("model <> 'who'")).first()
    assert known.cost_usd == 6.0 and known.pricing_known


def test_sinks(spark, tmp_path):
    metrics = spark.createDataFrame([("A", "faithfulness", 0.5, False), ("A", "claim_probes", 1.0, True), ("B", "faithfulness", 1.0, True)],
                                    "target string, name string, score double, pass boolean")
    sinks.write_scorecard(metrics, str(tmp_path / "card"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "card/report"), wholetext=True).collect())
    assert "| faithfulness | 0.750 |" in text and "FAIL: faithfulness" in text and "all pass" in text
    assert spark.read.json(str(tmp_path / "card/aggregates")).count() == 2
