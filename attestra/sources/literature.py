"""Publication records, citation edges, registry rows and full-text articles."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions.text import collapse_space
from attestra.sources import records as R

EVIDENCE_DDL = (
    "id string, kind string, source string, title string, snippet string, passage string, locator string, url string, "
    "raw string, metadata struct<authors:array<struct<name:string,affiliation:string,orcid:string>>,"
    "institutions:array<string>,doi:string,journal:string,year:string,imageRef:string>, pmcid string, cited_by bigint, "
    "is_review boolean, is_open_access boolean, ord bigint"
)
COLUMNS = [part.split(" ")[0] for part in (
    "id,kind,source,title,snippet,passage,locator,url,raw,metadata,pmcid,cited_by,is_review,is_open_access,ord").split(",")]


def json_records(spark: SparkSession, path: str | DataFrame, schema: str) -> DataFrame:
    """One row a JSON document with ``record``, its number by arrival.

    ``path`` names files of one response each, or is a table of landed records (``records.land``), for
    files of many. Documents that can't be read are left out here; ``records.parsed`` gives them.
    """
    landed = path if isinstance(path, DataFrame) else R.land(spark, path)
    return R.parsed(landed, schema)[0]


def blank_metadata() -> Column:
    return F.lit(None).cast(
        "struct<authors:array<struct<name:string,affiliation:string,orcid:string>>,institutions:array<string>,"
        "doi:string,journal:string,year:string,imageRef:string>"
    )


def evidence_columns(df: DataFrame, **values: Column) -> DataFrame:
    """Select the evidence columns; those not given are null. ``ord`` is the record's arrival, then ``pos``."""
    defaults = {
        "passage": F.lit(None).cast("string"), "locator": F.lit(None).cast("string"), "raw": F.lit(None).cast("string"),
        "metadata": blank_metadata(), "pmcid": F.lit(None).cast("string"), "cited_by": F.lit(None).cast("bigint"),
        "is_review": F.lit(None).cast("boolean"), "is_open_access": F.lit(None).cast("boolean"),
    }
    cols = {**defaults, **values}
    cols["ord"] = values.get("ord", R.place(F.col("record"), F.col("pos")))
    return df.select(*[cols[c].alias(c) for c in COLUMNS])


PUBLICATION = """resultList STRUCT<result: ARRAY<STRUCT<id: STRING, source: STRING, pmid: STRING, pmcid: STRING, title: STRING,
abstractText: STRING, citedByCount: STRING, isOpenAccess: STRING, firstPublicationDate: STRING, doi: STRING, pubYear: STRING,
journalInfo: STRUCT<journal: STRUCT<title: STRING>>, pubTypeList: STRUCT<pubType: ARRAY<STRING>>,
authorList: STRUCT<author: ARRAY<STRUCT<fullName: STRING, authorId: STRUCT<type: STRING, value: STRING>,
authorAffiliationDetailsList: STRUCT<authorAffiliation: ARRAY<STRUCT<affiliation: STRING>>>>>>>>>"""


def publications(spark: SparkSession, path: str) -> DataFrame:
    """Publication search responses; hits without a PubMed id are dropped."""
    hits = json_records(spark, path, PUBLICATION).select("record", F.posexplode("resultList.result").alias("pos", "h"))
    h = lambda f: F.col(f"h.{f}")
    filled = lambda c: F.nullif(c, F.lit(""))

    def author(a: Column) -> Column:
        return F.struct(
            F.coalesce(a["fullName"], F.lit("(unknown)")).alias("name"),
            filled(F.get(a["authorAffiliationDetailsList"]["authorAffiliation"], F.lit(0))["affiliation"]).alias("affiliation"),
            F.when(a["authorId"]["type"] == "ORCID", a["authorId"]["value"]).alias("orcid"),
        )

    authors = F.transform(h("authorList.author"), author)
    homes = F.array_distinct(F.filter(F.transform(authors, lambda a: a["affiliation"]), lambda x: x.isNotNull()))
    some = lambda a: F.when(F.size(a) > 0, a)
    parts = [some(authors), filled(h("doi")), filled(h("journalInfo.journal.title")), filled(h("pubYear"))]
    metadata = F.when(
        F.coalesce(*[p.isNotNull() & F.lit(True) for p in parts[:1]]) | parts[1].isNotNull() | parts[2].isNotNull() | parts[3].isNotNull(),
        F.struct(
            parts[0].alias("authors"), some(homes).alias("institutions"), parts[1].alias("doi"), parts[2].alias("journal"),
            parts[3].alias("year"), F.lit(None).cast("string").alias("imageRef"),
        ),
    )
    cited = F.coalesce(h("citedByCount"), F.lit("0"))
    return evidence_columns(
        hits.where(F.length("h.pmid") > 0),
        id=F.concat(F.lit("PMID:"), h("pmid")), kind=F.lit("publication"), source=F.lit("Europe PMC"),
        title=F.coalesce(h("title"), F.lit("(no title)")),
        snippet=F.trim(F.concat(F.lit("cited "), cited, F.lit("x . "), F.coalesce(h("firstPublicationDate"), F.lit("")))),
        passage=F.coalesce(h("abstractText"), F.lit("")),
        url=F.concat(F.lit("https://europepmc.org/article/"), h("source"), F.lit("/"), h("pmid")),
        raw=F.to_json("h"), metadata=metadata, pmcid=F.coalesce(h("pmcid"), F.lit("")), cited_by=cited.try_cast("bigint"),
        is_review=F.coalesce(F.exists(h("pubTypeList.pubType"), lambda t: t.rlike("(?i)review")), F.lit(False)),
        is_open_access=F.coalesce(h("isOpenAccess") == "Y", F.lit(False)),
    )


CITATIONS = """request STRUCT<id: STRING>, citationList STRUCT<citation: ARRAY<STRUCT<id: STRING, source: STRING, title: STRING,
citedByCount: BIGINT, pubYear: STRING>>>"""


def citations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(edges, evidence)`` of forward-citation responses; only PubMed citers count.

    The cited paper is the request id of each response.
    """
    rows = json_records(spark, path, CITATIONS).select(
        "record", F.concat(F.lit("PMID:"), "request.id").alias("cited"), F.posexplode("citationList.citation").alias("pos", "c")
    )
    rows = rows.where((F.length("c.id") > 0) & (F.col("c.source") == "MED"))
    citing = F.concat(F.lit("PMID:"), F.col("c.id"))
    cited_by = F.coalesce("c.citedByCount", F.lit(0).cast("bigint"))
    title = F.coalesce("c.title", F.lit("(no title)"))
    evidence = evidence_columns(
        rows, id=citing, kind=F.lit("publication"), source=F.lit("Europe PMC"), title=title,
        snippet=F.trim(F.concat(F.lit("cited "), cited_by.cast("string"), F.lit("x . "), F.coalesce("c.pubYear", F.lit("")))),
        passage=F.lit(""), url=F.concat(F.lit("https://europepmc.org/article/MED/"), F.col("c.id")), raw=F.to_json("c"), cited_by=cited_by,
    )
    edges = rows.select("cited", citing.alias("citing"), title.alias("title"), cited_by.alias("cited_by"), F.col("pos").cast("bigint").alias("ord"))
    return edges, evidence


PUBMED_IDS = "esearchresult STRUCT<idlist: ARRAY<STRING>>"
PUBMED_SUMMARY = "result MAP<STRING, STRING>"
SUMMARY = "uid STRING, title STRING, source STRING, pubdate STRING"


def pubmed(spark: SparkSession, id_path: str, summary_path: str) -> DataFrame:
    """PubMed rows in id-list order; an id without a summary is kept as ``(no title)``."""
    ids = json_records(spark, id_path, PUBMED_IDS).select("record", F.posexplode("esearchresult.idlist").alias("pos", "uid"))
    found = (
        json_records(spark, summary_path, PUBMED_SUMMARY)
        .select(F.explode("result").alias("uid", "text"))
        .where(F.col("uid") != "uids")
        .groupBy("uid")
        .agg(F.max("text").alias("text"))
        .select("uid", F.from_json("text", SUMMARY).alias("s"), "text")
    )
    return evidence_columns(
        ids.join(found, "uid", "left"),
        id=F.concat(F.lit("PMID:"), "uid"), kind=F.lit("publication"), source=F.lit("PubMed"),
        title=F.coalesce("s.title", F.lit("(no title)")),
        snippet=F.trim(F.concat(F.coalesce("s.source", F.lit("")), F.lit(" "), F.coalesce("s.pubdate", F.lit("")))),
        url=F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.col("uid"), F.lit("/")), raw=F.col("text"),
    )


REGISTRY = """message STRUCT<DOI: STRING, title: ARRAY<STRING>, `container-title`: ARRAY<STRING>,
issued: STRUCT<`date-parts`: ARRAY<ARRAY<STRING>>>>"""


def doi_registry(spark: SparkSession, path: str) -> DataFrame:
    """DOI registry rows: first title, first container and issued year."""
    first = lambda c: F.nullif(F.get(c, F.lit(0)), F.lit(""))
    return json_records(spark, path, REGISTRY).where(F.col("message.DOI").isNotNull()).select(
        F.col("message.DOI").alias("doi"), first(F.col("message.title")).alias("reg_title"),
        first(F.col("message.`container-title`")).alias("reg_journal"),
        first(F.get(F.col("message.issued.`date-parts`"), F.lit(0))).alias("reg_year"),
    )


# --- Full text ---------------------------------------------------------------------------

ARTICLE_DDL = (
    "sections array<struct<title:string,passage:string>>, "
    "figures array<struct<number:int,label:string,caption:string,href:string>>"
)


# Figures of an article come after its sections: a text of at most 2 GiB holds fewer than 2^30 of either.
FIGURES = 1 << 30


def _flat(node) -> str:
    return re.sub(r"\s+", " ", " ".join(t for t in node.itertext())).strip()


def _article(xml: str | None) -> tuple[list[dict], list[dict], str | None]:
    """Own paragraphs of every section in document order, all captioned figures, and what is wrong with the text."""
    try:
        root = ElementTree.fromstring(xml)
    except (ElementTree.ParseError, ValueError, TypeError) as error:
        return [], [], f"not XML: {error}"
    article = root if root.tag == "article" else next(root.iter("article"), root)
    body = article.find("body")
    sections, figures = [], []

    def walk(node) -> None:
        for sec in node.findall("sec"):
            passage = re.sub(r"\s+", " ", " ".join(_flat(p) for p in sec.findall("p"))).strip()
            if passage:
                head = sec.find("title")
                title = "" if head is None else _flat(head)
                sections.append({"title": title or f"Section {len(sections) + 1}", "passage": passage})
            walk(sec)

    if body is not None:
        walk(body)
    for number, fig in enumerate((article if body is None else body).iter("fig")):
        caption = fig.find("caption")
        text = "" if caption is None else _flat(caption)
        if not text:
            continue
        label = fig.find("label")
        graphic = fig.find("graphic")
        href = None
        if graphic is not None:
            href = next((v for k, v in graphic.attrib.items() if k.rsplit("}", 1)[-1] in ("href", "xlink:href")), None)
        figures.append(
            {"number": number, "label": ("" if label is None else _flat(label)) or f"Figure {number + 1}", "caption": text, "href": href}
        )
    return sections, figures, None


def parse_articles(articles: DataFrame) -> DataFrame:
    """Articles (record, pmcid, xml) with their sections, figures and ``error``, parsed in Arrow batches.

    Spark's XML reader loses the order of mixed content, so each article is walked once. An article that
    is no XML has an ``error`` and nothing else; ``rejected_articles`` names those.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parsed = [_article(x) for x in batch["xml"]]
            yield pd.DataFrame({
                "pmcid": batch["pmcid"], "record": batch["record"],
                "sections": [p[0] for p in parsed], "figures": [p[1] for p in parsed], "error": [p[2] for p in parsed],
            })

    return articles.select("pmcid", "record", "xml").mapInPandas(run, f"pmcid string, record bigint, {ARTICLE_DDL}, error string")


def rejected_articles(parsed: DataFrame) -> DataFrame:
    """(record, pmcid, reason) of the articles that could not be read."""
    return parsed.where(F.col("error").isNotNull()).select("record", "pmcid", F.col("error").alias("reason"))


def read_articles(spark: SparkSession, path: str, received: DataFrame | None = None) -> DataFrame:
    """Article files named ``<pmcid>.xml`` as (record, pmcid, xml)."""
    landed = R.land(spark, path, received=received)
    return landed.select("record", F.regexp_extract("file", r"([^/]*)\.xml$", 1).alias("pmcid"), F.col("value").alias("xml"))


def split_articles(spark: SparkSession, path: str, received: DataFrame | None = None) -> DataFrame:
    """Files of many ``<article>`` elements as (record, pmcid, xml), split by byte ranges.

    What stands before an element (a prolog, a set's start tag) goes; the id is the article's own.
    """
    end = "</article>"
    landed = R.land(spark, path, separator=end, received=received)
    xml = F.concat(F.regexp_extract("value", r"(?s)<article[\s>].*", 0), F.lit(end))
    own = F.regexp_extract("value", r"""<article-id[^>]*pub-id-type=["']pmc(?:id)?["'][^>]*>\s*(?:PMC)?([^<\s]+)""", 1)
    found = landed.where(F.col("value").rlike(r"<article[\s>]"))
    return found.select("record", F.when(own != "", F.concat(F.lit("PMC"), own)).otherwise("").alias("pmcid"), xml.alias("xml"))


def fulltext(parsed: DataFrame) -> DataFrame:
    """Section passages as evidence; numbered over the sections that have text."""
    rows = parsed.select("pmcid", "record", F.posexplode("sections").alias("pos", "s"))
    return evidence_columns(
        rows, id=F.concat(F.lit("PMCID:"), "pmcid", F.lit("#sec-"), F.col("pos").cast("string")), kind=F.lit("publication"),
        source=F.lit("PMC full text"), title=F.col("s.title"), snippet=F.col("s.title"), passage=F.col("s.passage"), locator=F.col("s.title"),
        url=F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/"), "pmcid", F.lit("/")), pmcid=F.col("pmcid"),
    )


def figures(parsed: DataFrame) -> DataFrame:
    """Figure captions as evidence; the id counts all figures, captioned or not."""
    rows = parsed.select("pmcid", "record", F.posexplode("figures").alias("pos", "f"))
    number = F.col("f.number").cast("string")
    base = F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/"), "pmcid", F.lit("/"))
    null = F.lit(None)
    image = F.struct(
        null.cast("array<struct<name:string,affiliation:string,orcid:string>>").alias("authors"), null.cast("array<string>").alias("institutions"),
        null.cast("string").alias("doi"), null.cast("string").alias("journal"), null.cast("string").alias("year"), F.col("f.href").alias("imageRef"),
    )
    return evidence_columns(
        rows, id=F.concat(F.lit("PMCID:"), "pmcid", F.lit("#fig-"), number), kind=F.lit("figure"), source=F.lit("pmc"), title=F.col("f.label"),
        snippet=F.col("f.caption"), passage=F.col("f.caption"), locator=F.concat(F.lit("fig-"), number),
        url=F.when(F.col("f.href").isNotNull(), F.concat(base, F.lit("bin/"), "f.href")).otherwise(base),
        metadata=F.when(F.col("f.href").isNotNull(), image), pmcid=F.col("pmcid"), ord=R.place(F.col("record"), F.col("f.number") + F.lit(FIGURES)),
    )


def page_sections(pages: DataFrame, level: int = 2) -> DataFrame:
    """Web pages (page_id, html) split at headings of one level: one passage per section.

    Scripts, styles and comments go first, then tags; blank sections are left out.
    """
    bare = F.regexp_replace("html", r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    split = F.split(bare, rf"(?i)(?=<h{level}[\s>])")
    parts = F.slice(split, F.lit(2), F.greatest(F.size(split) - 1, F.lit(0)))
    rows = pages.select("page_id", "url", F.posexplode(parts).alias("pos", "part"))
    clean = lambda c: collapse_space(F.regexp_replace(c, "<[^>]*>", " "))
    head = rf"(?is)^<h{level}[^>]*>(.*?)</h{level}>"
    out = rows.select(
        "page_id", "pos", clean(F.regexp_extract("part", head, 1)).alias("title"), clean(F.regexp_replace("part", head, " ")).alias("passage"), "url"
    )
    return out.where(F.length("passage") > 0)
