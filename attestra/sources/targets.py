"""Target, protein, trial and patent records as evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions.numbers import fixed
from attestra.session import cut_lineage
from attestra.sources.literature import evidence_columns, json_records
from attestra.sources.records import land

SURFACE = "(?i)cell membrane|plasma membrane|cell surface|extracellular"

TARGET_HITS = "query STRING, data STRUCT<search: STRUCT<hits: ARRAY<STRUCT<id: STRING, name: STRING, entity: STRING, description: STRING>>>>"


def resolve_target(spark: SparkSession, path: str) -> DataFrame:
    """Per response, the first hit that is a target with an Ensembl gene id."""
    rows = json_records(spark, path, TARGET_HITS).select("record", F.posexplode("data.search.hits").alias("pos", "h"))
    good = rows.where((F.col("h.entity") == "target") & F.col("h.id").startswith("ENSG"))
    first = good.groupBy("record").agg(F.min(F.struct("pos", "h")).alias("m")).select("record", "m.pos", "m.h")
    return evidence_columns(
        first, id=F.col("h.id"), kind=F.lit("target"), source=F.lit("Open Targets"), title=F.col("h.name"),
        snippet=F.coalesce("h.description", F.lit("")), url=F.concat(F.lit("https://platform.opentargets.org/target/"), "h.id"), raw=F.to_json("h"),
    )


TARGET = """data STRUCT<target: STRUCT<id: STRING, approvedSymbol: STRING, approvedName: STRING,
symbolSynonyms: ARRAY<STRUCT<label: STRING>>, nameSynonyms: ARRAY<STRUCT<label: STRING>>,
tractability: ARRAY<STRUCT<modality: STRING, label: STRING, value: BOOLEAN>>, safetyLiabilities: ARRAY<STRUCT<event: STRING>>,
subcellularLocations: ARRAY<STRUCT<location: STRING, termSL: STRING>>,
baselineExpression: STRUCT<rows: ARRAY<STRUCT<median: DOUBLE, specificity_score: DOUBLE, datatypeId: STRING, tissueBiosample: STRUCT<biosampleName: STRING>>>>,
associatedDiseases: STRUCT<rows: ARRAY<STRUCT<score: DOUBLE, disease: STRUCT<id: STRING, name: STRING>>>>,
drugAndClinicalCandidates: STRUCT<rows: ARRAY<STRUCT<maxClinicalStage: STRING, drug: STRUCT<id: STRING, name: STRING>>>>>>"""


def ab_tractability(buckets: Column) -> Column:
    """Achieved tractability buckets that matter for an antibody, as ``modality: label``."""
    fits = lambda b: b["value"] & F.concat_ws(" ", b["modality"], b["label"]).rlike("(?i)antibody|adc|cell.?surface|secreted|targetable")
    return F.transform(F.filter(buckets, fits), lambda b: F.concat(b["modality"], F.lit(": "), b["label"]))


def ranked_tissues(rows: Column) -> Column:
    """Tissues with a name and a median, highest median first, ties in input order."""
    named = F.filter(
        F.transform(rows, lambda r, i: F.struct(
            (-r["median"]).alias("down"), i.alias("i"), r["tissueBiosample"]["biosampleName"].alias("tissue"), r["median"].alias("median"),
            r["datatypeId"].alias("datatype"))),
        lambda r: r["down"].isNotNull() & (F.length(r["tissue"]) > 0),
    )
    return F.sort_array(named)


def _expression_text(rows: Column, tissues: int | None) -> Column:
    ranked = ranked_tissues(rows)
    protein = F.filter(ranked, lambda r: F.coalesce(r["datatype"], F.lit("")).rlike("(?i)proteomics|protein"))
    top = ranked
    if tissues is not None:
        top, protein = F.slice(ranked, 1, tissues), F.slice(protein, 1, tissues)
    item = lambda r: F.concat(
        r["tissue"], F.lit(" ("), F.round(r["median"], 0).cast("bigint").cast("string"),
        F.when(F.length(r["datatype"]) > 0, F.concat(F.lit(", "), r["datatype"])).otherwise(""), F.lit(")"),
    )
    body = F.concat(
        F.lit("Normal tissues by median expression, of "), F.size(ranked).cast("string"), F.lit(" biosamples: "),
        F.array_join(F.transform(top, item), "; "), F.lit("."),
        F.when(
            F.size(protein) > 0,
            F.concat(
                F.lit(" Measured as protein: "),
                F.array_join(F.transform(protein, lambda r: r["tissue"]), ", "), F.lit("."),
            ),
        ).otherwise(""),
    )
    return F.when(F.size(top) > 0, body).otherwise("No tissue has a median expression.")


def target_cards(spark: SparkSession, path: str, tissues: int | None = None) -> DataFrame:
    """Cards of the target records under a path; see ``target_rows``."""
    return target_rows(json_records(spark, path, TARGET), tissues)


def target_rows(records: DataFrame, tissues: int | None = None) -> DataFrame:
    """A target record (file, data) fanned out to its base, localisation, expression, tractability
    and safety cards, disease rows and drug rows, in that order. Cards without data are left
    out; each card keeps the part of the record it was made from. ``tissues`` limits how many
    tissues the expression text names."""
    t = lambda f: F.col(f"t.{f}")
    none = lambda kind: F.array().cast(kind)
    rows = records.where(F.col("data.target").isNotNull()).select("record", F.col("data.target").alias("t"))
    buckets = F.coalesce(t("tractability"), none("array<struct<modality:string,label:string,value:boolean>>"))
    safety = F.filter(F.transform(F.coalesce(t("safetyLiabilities"), none("array<struct<event:string>>")), lambda s: s["event"]), lambda e: F.length(e) > 0)
    places = F.filter(
        F.transform(F.coalesce(t("subcellularLocations"), none("array<struct<location:string,termSL:string>>")), lambda s: F.coalesce(s["location"], s["termSL"])),
        lambda p: F.length(p) > 0,
    )
    expr = F.coalesce(t("baselineExpression.rows"), F.expr("array()").cast(
        "array<struct<median:double,specificity_score:double,datatypeId:string,tissueBiosample:struct<biosampleName:string>>>"))
    surface = F.exists(places, lambda p: p.rlike(SURFACE))
    ab = ab_tractability(buckets)
    url = F.concat(F.lit("https://platform.opentargets.org/target/"), t("id"))
    symbol = t("approvedSymbol")
    synonyms = F.array_distinct(F.concat(
        F.transform(F.coalesce(t("symbolSynonyms"), none("array<struct<label:string>>")), lambda s: s["label"]),
        F.transform(F.coalesce(t("nameSynonyms"), none("array<struct<label:string>>")), lambda s: s["label"]),
    ))

    def card(id_: Column, title: Column, snippet: Column, link: Column, raw: Column, kind: str = "target") -> Column:
        return F.struct(
            id_.alias("id"), F.lit(kind).alias("kind"), title.alias("title"), snippet.alias("snippet"), link.alias("url"), raw.alias("raw")
        )

    part = lambda **fields: F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    base = card(
        t("id"), F.concat(symbol, F.lit(" — "), t("approvedName")),
        F.concat(F.lit("tractability: "), F.size(buckets).cast("string"), F.lit(" modalities; safety liabilities: "),
                 F.coalesce(F.size(t("safetyLiabilities")), F.lit(0)).cast("string")),
        url, part(approvedSymbol=symbol, synonyms=synonyms, tractability=buckets, safetyLiabilities=t("safetyLiabilities")),
    )
    where = card(
        F.concat(t("id"), F.lit("#localization")), F.concat(symbol, F.lit(" subcellular localisation")),
        F.concat(
            F.lit("Subcellular location: "), F.array_join(F.array_distinct(places), "; "), F.lit("."),
            F.when(surface, " Surface or membrane site.").otherwise(" No surface or membrane site is annotated."),
        ), url, part(subcellularLocations=t("subcellularLocations")),
    )
    level = card(F.concat(t("id"), F.lit("#expression")), F.concat(symbol, F.lit(" baseline normal-tissue expression")), _expression_text(expr, tissues),
                 F.concat(url, F.lit("?tab=expression")), part(baselineExpression=t("baselineExpression")))
    reach = card(
        F.concat(t("id"), F.lit("#tractability")), F.concat(symbol, F.lit(" tractability (antibody / ADC)")),
        F.when(F.size(ab) > 0, F.concat(F.lit("Buckets reached for antibodies: "), F.array_join(ab, "; "), F.lit(".")))
        .otherwise("No bucket is reached for antibodies."),
        F.concat(url, F.lit("?tab=tractability")), part(tractability=buckets),
    )
    harm = card(F.concat(t("id"), F.lit("#safety")), F.concat(symbol, F.lit(" known safety liabilities")),
                F.concat(F.lit("Safety events: "), F.array_join(F.array_distinct(safety), "; "), F.lit(".")), F.concat(url, F.lit("?tab=safety")), part(safetyLiabilities=t("safetyLiabilities")))
    diseases = F.transform(
        F.coalesce(t("associatedDiseases.rows"), none("array<struct<score:double,disease:struct<id:string,name:string>>>")),
        lambda r: F.struct(
            r["disease"]["id"].alias("id"), F.lit("disease").alias("kind"), r["disease"]["name"].alias("title"),
            F.concat(F.lit("association score "), fixed(r["score"], 2), F.lit(" for "), symbol).alias("snippet"),
            F.concat(F.lit("https://platform.opentargets.org/evidence/"), t("id"), F.lit("/"), r["disease"]["id"]).alias("url"), F.to_json(r).alias("raw")),
    )
    drugs = F.transform(
        F.filter(F.coalesce(t("drugAndClinicalCandidates.rows"), none("array<struct<maxClinicalStage:string,drug:struct<id:string,name:string>>>")),
                 lambda r: r["drug"].isNotNull()),
        lambda r: F.struct(
            r["drug"]["id"].alias("id"), F.lit("drug").alias("kind"), r["drug"]["name"].alias("title"),
            F.concat(F.lit("clinical candidate for "), symbol,
                     F.when(F.length(r["maxClinicalStage"]) > 0, F.concat(F.lit(" — max clinical stage "), r["maxClinicalStage"])).otherwise("")).alias("snippet"),
            F.concat(F.lit("https://platform.opentargets.org/drug/"), r["drug"]["id"]).alias("url"), F.to_json(r).alias("raw")),
    )
    cards = F.array_compact(F.array(
        base, F.when(F.size(places) > 0, where), F.when(F.size(expr) > 0, level), F.when(F.size(buckets) > 0, reach), F.when(F.size(safety) > 0, harm)
    ))
    shape = "array<struct<id:string,kind:string,title:string,snippet:string,url:string,raw:string>>"
    out = rows.select("record", F.posexplode(F.concat(cards.cast(shape), diseases.cast(shape), drugs.cast(shape))).alias("pos", "c")).select("record", "pos", "c.*")
    return evidence_columns(
        out, id=F.col("id"), kind=F.col("kind"), source=F.lit("Open Targets"), title=F.col("title"), snippet=F.col("snippet"), url=F.col("url"), raw=F.col("raw")
    )


def target_records(cards: DataFrame) -> DataFrame:
    """(target, approved_symbol, synonyms, ord) of base cards, for ``target_terms``."""
    raw = F.from_json("raw", "approvedSymbol STRING, synonyms ARRAY<STRING>")
    base = cards.where((F.col("kind") == "target") & ~F.col("id").contains("#")).withColumn("r", raw)
    return base.select(F.col("r.approvedSymbol").alias("target"), F.col("r.approvedSymbol").alias("approved_symbol"), F.col("r.synonyms").alias("synonyms"), "ord")


PROTEIN = """symbol STRING, results ARRAY<STRUCT<primaryAccession: STRING,
proteinDescription: STRUCT<recommendedName: STRUCT<fullName: STRUCT<value: STRING>>>,
comments: ARRAY<STRUCT<commentType: STRING, subcellularLocations: ARRAY<STRUCT<location: STRUCT<value: STRING>, topology: STRUCT<value: STRING>>>>>,
features: ARRAY<STRUCT<type: STRING, description: STRING>>>>"""


def protein_cards(spark: SparkSession, path: str) -> DataFrame:
    """Localisation and domain cards of the first protein entry per response."""
    e = lambda f: F.col(f"e.{f}")
    rows = json_records(spark, path, PROTEIN).select("record", "symbol", F.get("results", F.lit(0)).alias("e")).where(F.length("e.primaryAccession") > 0)
    comment = F.get(F.filter(e("comments"), lambda c: c["commentType"] == "SUBCELLULAR LOCATION"), F.lit(0))
    spots = F.coalesce(comment["subcellularLocations"], F.array().cast("array<struct<location:struct<value:string>,topology:struct<value:string>>>"))
    places = F.filter(F.transform(spots, lambda s: s["location"]["value"]), lambda v: F.length(v) > 0)
    feats = F.coalesce(e("features"), F.array().cast("array<struct<type:string,description:string>>"))
    membrane = F.size(F.filter(feats, lambda f: f["type"] == "Transmembrane"))
    outside = F.exists(feats, lambda f: (f["type"] == "Topological domain") & F.coalesce(f["description"], F.lit("")).rlike("(?i)extracellular"))
    surface = outside | (membrane > 0) | F.exists(places, lambda p: p.rlike(SURFACE))
    domains = F.filter(F.transform(F.filter(feats, lambda f: f["type"] == "Domain"), lambda f: f["description"]), lambda d: F.length(d) > 0)
    name = F.coalesce(e("proteinDescription.recommendedName.fullName.value"), F.col("symbol"))
    id_ = lambda tail: F.concat(F.lit("UNIPROT:"), e("primaryAccession"), F.lit(tail))
    where = F.struct(
        F.lit(0).alias("pos"), id_("#localization").alias("id"), F.concat("symbol", F.lit(" ("), name, F.lit(") localisation & topology")).alias("title"),
        F.concat(
            F.when(F.size(places) > 0, F.concat(F.lit("Subcellular location: "), F.array_join(F.array_distinct(places), "; "), F.lit(". "))).otherwise(""),
            F.when(membrane > 0, F.concat(membrane.cast("string"), F.lit(" transmembrane region(s)"),
                                          F.when(outside, " with an extracellular domain").otherwise(""), F.lit(". "))).otherwise(""),
            F.when(surface, "Reachable at the cell surface.").otherwise("No part is annotated as outside the cell."),
        ).alias("snippet"),
    )
    parts = F.struct(
        F.lit(1).alias("pos"), id_("#domains").alias("id"), F.concat("symbol", F.lit(" domain architecture")).alias("title"),
        F.concat(F.lit("Annotated domains: "), F.array_join(F.array_distinct(domains), "; "), F.lit(".")).alias("snippet"),
    )
    cards = F.array_compact(F.array(F.when((F.size(places) > 0) | (membrane > 0), where), F.when(F.size(domains) > 0, parts)))
    out = rows.select("record", e("primaryAccession").alias("acc"), F.to_json("e").alias("raw"), F.explode(cards).alias("c")).select("record", "acc", "raw", "c.*")
    return evidence_columns(
        out, id=F.col("id"), kind=F.lit("target"), source=F.lit("UniProt"), title=F.col("title"), snippet=F.col("snippet"),
        url=F.concat(F.lit("https://www.uniprot.org/uniprotkb/"), "acc", F.lit("/entry")), raw=F.col("raw"),
    )


TRIALS = """studies ARRAY<STRUCT<protocolSection: STRUCT<identificationModule: STRUCT<nctId: STRING, briefTitle: STRING>,
statusModule: STRUCT<overallStatus: STRING>, designModule: STRUCT<phases: ARRAY<STRING>>>>>"""


def trials(spark: SparkSession, path: str) -> DataFrame:
    """Registered trials; studies without an NCT id are dropped."""
    rows = json_records(spark, path, TRIALS).select("record", F.posexplode("studies").alias("pos", "s"))
    p = lambda f: F.col(f"s.protocolSection.{f}")
    id_ = p("identificationModule.nctId")
    phases = F.array_join(F.coalesce(p("designModule.phases"), F.array().cast("array<string>")), "/")
    return evidence_columns(
        rows.where(F.length(id_) > 0), id=id_, kind=F.lit("trial"), source=F.lit("ClinicalTrials.gov"),
        title=F.coalesce(p("identificationModule.briefTitle"), F.lit("(no title)")),
        snippet=F.trim(F.concat(phases, F.lit(" "), F.coalesce(p("statusModule.overallStatus"), F.lit("")))),
        url=F.concat(F.lit("https://clinicaltrials.gov/study/"), id_), raw=F.to_json("s"),
    )


# --- Patent search -----------------------------------------------------------------------

# Places of a bibliographic record, relative to the record.
REFERENCES = '$["bibliographic-data"]["publication-reference"]["document-id"]'
TITLES = '$["bibliographic-data"]["invention-title"]'
APPLICANTS = '$["bibliographic-data"].parties.applicants.applicant'
CLASSES = '$["bibliographic-data"]["patent-classifications"]["patent-classification"]'
RECORDS = '$["ops:world-patent-data"]["ops:biblio-search"]["ops:search-result"]["exchange-documents"]'
SYMBOL_PARTS = ("section", "class", "subclass", "main-group", "subgroup")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _many(node: Column, path: str) -> Column:
    """What stands at a path as an array: its items, or the one value that stands there."""
    empty = F.array().cast("array<variant>")
    items = lambda at: F.when(at.isNull(), empty).otherwise(F.coalesce(F.try_variant_get(at, "$", "array<variant>"), F.array(at)))
    return _once(F.try_variant_get(node, path, "variant"), items)


def _leaf(node: Column, path: str = "$") -> Column:
    """Trimmed text at a path, given plainly or under the text key of an element; null if blank."""
    below = F.try_variant_get(node, path + '["$"]', "string")
    text = lambda at: F.when(F.schema_of_variant(at).rlike("^(OBJECT|ARRAY)"), F.lit(None)).otherwise(F.try_variant_get(at, "$", "string"))
    plain = _once(F.try_variant_get(node, path, "variant"), text)
    return _once(F.trim(F.coalesce(below, plain)), lambda found: F.when(found != "", found))


def _texts(nodes: Column, *paths: str) -> Column:
    """Distinct texts of nodes, each from the first of the paths that has one."""
    return F.array_distinct(F.array_compact(F.transform(nodes, lambda n: F.coalesce(*[_leaf(n, p) for p in paths]))))


def patent_records(responses: DataFrame) -> DataFrame:
    """(record, pos, country, number, kind, date, title, applicants, classes, raw) of search responses
    (record, text). Responses that are not JSON, and records without a country and a number, are
    left out.

    A record's identity comes from its docdb reference, else its epodoc one, else its first. A
    country or kind written inside the number is taken out of it.
    """
    parsed = responses.select("record", F.try_parse_json("text").alias("v"))
    records = parsed.select("record", F.posexplode(_many(F.col("v"), RECORDS)).alias("pos", "entry"))
    inner = F.coalesce(F.try_variant_get("entry", '$["exchange-document"]', "variant"), F.col("entry"))
    records = records.select("record", F.col("pos").cast("long").alias("pos"), inner.alias("r"))
    refs = F.transform(
        _many(F.col("r"), REFERENCES),
        lambda d, i: F.struct(
            F.coalesce(F.array_position(F.array(F.lit("docdb"), F.lit("epodoc")), F.lower(F.try_variant_get(d, '$["@document-id-type"]', "string"))), F.lit(0)).alias("at"),
            i.alias("i"),
            F.regexp_replace(F.upper(_leaf(d, "$.country")), "[^A-Z]", "").alias("country"),
            F.regexp_replace(F.upper(_leaf(d, '$["doc-number"]')), "[^A-Z0-9]", "").alias("number"),
            F.regexp_replace(F.upper(_leaf(d, "$.kind")), "[^A-Z0-9]", "").alias("kind"),
            _leaf(d, "$.date").alias("date"),
        ),
    )
    ranked = F.array_sort(F.transform(refs, lambda x: F.struct(F.when(x["at"] == 0, 3).otherwise(x["at"]).alias("rank"), x["i"].alias("i"), x.alias("x"))))
    titles = F.transform(_many(F.col("r"), TITLES), lambda n: F.struct((F.lower(F.try_variant_get(n, '$["@lang"]', "string")) == "en").alias("english"), _leaf(n).alias("text")))
    symbol = lambda n: F.coalesce(
        _leaf(n), _leaf(n, '$["classification-symbol"]'), F.nullif(F.concat(*[F.coalesce(_leaf(n, f'$["{p}"]'), F.lit("")) for p in SYMBOL_PARTS]), F.lit(""))
    )
    classes = F.transform(_many(F.col("r"), CLASSES), lambda n: F.regexp_replace(symbol(n), r"\s+", " "))
    # Each leaf is read once here; the explode keeps the plain columns below from being worked out again per use.
    read = F.struct(
        ranked.alias("refs"), titles.alias("titles"), _texts(_many(F.col("r"), APPLICANTS), '$["applicant-name"].name', '$["applicant-name"]').alias("applicants"),
        F.array_distinct(F.array_compact(classes)).alias("classes"), F.to_json("r").alias("raw"),
    )
    rows = records.select("record", "pos", F.explode(F.array(read)).alias("p")).select("record", "pos", "p.*")
    rows = rows.withColumn("b", F.get("refs", F.lit(0))["x"]).where(F.col("b").isNotNull())
    joined = F.concat(F.coalesce("b.country", F.lit("")), F.regexp_replace(F.coalesce("b.number", F.lit("")), F.concat(F.lit("^"), F.coalesce("b.country", F.lit(""))), F.lit("")))
    number = F.regexp_extract(joined, "^[A-Z]{2}(.+)$", 1)
    ending = F.regexp_extract(number, r"^\d+([A-Z]\d?)$", 1)
    own_kind = F.nullif("b.kind", F.lit(""))
    rows = rows.withColumn("country", F.regexp_extract(joined, "^([A-Z]{2}).+$", 1)).withColumn("kind", F.coalesce(own_kind, F.nullif(ending, F.lit(""))))
    rows = rows.withColumn("number", F.when(own_kind.isNull() & (ending != ""), F.regexp_extract(number, r"^(\d+)", 1)).otherwise(number))
    dates = F.filter(F.concat(F.array("b.date"), F.transform("refs", lambda x: x["x"]["date"])), lambda d: d.isNotNull())
    day = F.get(dates, F.lit(0))
    named = lambda keep: F.get(F.filter(F.transform(F.filter("titles", keep), lambda n: n["text"]), lambda x: x.isNotNull()), F.lit(0))
    return rows.where((F.col("country") != "") & (F.col("number") != "")).select(
        "record", "pos", "country", "number", "kind",
        F.when(day.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2))).when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day).alias("date"),
        F.coalesce(named(lambda n: n["english"]), named(lambda n: F.lit(True))).alias("title"), "applicants", "classes", "raw",
    )


def patent_evidence(records: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct documents of each response as evidence, the first record of an id; at most ``limit``
    of a response, if given."""
    from attestra.operators.retrieve import top_n
    from attestra.operators.store import first_rows

    hits = records.withColumn("id", F.concat(F.lit("PATENT:"), "country", "number", F.coalesce("kind", F.lit(""))))
    # Written once: picking reads its rows twice, and the responses would be parsed for each.
    rows = first_rows(cut_lineage(hits), ["record", "id"], "pos")
    if limit is not None:
        rows = top_n(rows, ["record"], [F.col("pos")], limit).drop("rank")
    return evidence_columns(
        rows, id=F.col("id"), kind=F.lit("patent"), source=F.lit("EPO Espacenet (OPS)"), title=F.coalesce("title", F.lit("(no title)")),
        snippet=F.concat_ws(
            " · ", F.nullif(F.array_join("applicants", ", "), F.lit("")), F.col("date"),
            F.when(F.size("classes") > 0, F.concat(F.lit("IPC "), F.array_join("classes", ", "))),
        ),
        url=F.concat(F.lit("https://worldwide.espacenet.com/patent/search?q=pn%3D"), "country", "number"), raw=F.col("raw"),
    )


def patent_hits(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Evidence of the patent search responses under a path, one response a file."""
    return patent_evidence(patent_records(land(spark, path).withColumnRenamed("value", "text")), limit)
