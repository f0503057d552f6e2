"""Patent look-ups and alignment searches: loosely shaped responses brought to rows.

A field may be there once, many times or not at all, plainly or under a text key. Each response is read
once: its wanted places become one typed struct, and an explode keeps everything after it on that struct.
Responses that are not what they should be give no rows but their own mark (``found``), never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import numbers as N
from attestra.functions import seqs as SQ
from attestra.operators import patents as P
from attestra.session import cut_lineage
from attestra.sources.targets import _many, _once

# Fixed places of the look-up responses.
BIBLIO = '$["ops:world-patent-data"]["exchange-documents"]["exchange-document"]["bibliographic-data"]'
FAMILY = '$["ops:world-patent-data"]["ops:patent-family"]["ops:family-member"]'
LEGAL = '$["ops:world-patent-data"]["ops:legal"]'
TEXT = "^(STRING|BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"


def _plain(node: Column, path: str) -> Column:
    """A text or number at a path, or under its text key; null if it is empty or something else."""

    def text(at: Column) -> Column:
        plain = lambda x: F.when(x != "", x)
        return F.when(F.schema_of_variant(at).rlike(TEXT), _once(F.try_variant_get(at, "$", "string"), plain))

    return _once(F.try_variant_get(node, path, "variant"), lambda at: F.coalesce(text(at), _once(F.try_variant_get(at, '$["$"]', "variant"), text)))


def _date(raw: Column) -> Column:
    """YYYYMMDD as YYYY-MM-DD; null for anything else."""
    parts = lambda x: F.when(x.rlike(r"^\d{8}\z"), F.concat_ws("-", F.substring(x, 1, 4), F.substring(x, 5, 2), F.substring(x, 7, 2)))
    return _once(raw, parts)


def _texts(node: Column, path: str, below: str) -> Column:
    return F.array_compact(F.transform(_many(node, path), lambda n: _plain(n, below)))


def patent_lookups(biblio: DataFrame, family: DataFrame, legal: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(records, members, events)`` of look-up responses (doc_id, text); one response of a kind a doc_id.

    records: doc_id, found, title, applicants, inventors, ipc, publication_date, filing_date,
    estimated_expiry. A document is found if its biblio is JSON; family and legal are best-effort.
    members: doc_id, pos, country, number, kind, status. events: doc_id, pos, country, number, code,
    category, effect, date, description.
    """
    v = lambda rows: rows.select("doc_id", F.try_parse_json("text").alias("v"))
    dates = lambda kind: F.get(_texts(F.col("v"), f'{BIBLIO}["{kind}"]["document-id"]', "$.date"), F.lit(0))
    symbol = lambda n: F.concat(F.coalesce(_plain(n, "$.section"), F.lit("")), F.coalesce(_plain(n, "$.class"), F.lit("")))
    read = F.struct(
        F.col("v").isNotNull().alias("found"),
        _plain(F.col("v"), f'{BIBLIO}["invention-title"]').alias("title"),
        _texts(F.col("v"), f"{BIBLIO}.parties.applicants.applicant", '$["applicant-name"].name').alias("applicants"),
        _texts(F.col("v"), f"{BIBLIO}.parties.inventors.inventor", '$["inventor-name"].name').alias("inventors"),
        F.filter(F.transform(_many(F.col("v"), f'{BIBLIO}["patent-classifications"]["patent-classification"]'), symbol), lambda s: s != "").alias("ipc"),
        _date(dates("publication-reference")).alias("publication_date"),
        _date(dates("application-reference")).alias("filing_date"),
    )
    records = v(biblio).select("doc_id", F.explode(F.array(read)).alias("r")).select("doc_id", "r.*")
    # Written once: it is a result, and says which documents were found.
    records = cut_lineage(records.withColumn("estimated_expiry", SQ.expiry(F.array("filing_date"))))

    first = lambda n: F.get(_many(n, '$["publication-reference"]["document-id"]'), F.lit(0))
    member = lambda n: F.struct(_plain(first(n), "$.country").alias("country"), _plain(first(n), '$["doc-number"]').alias("number"), _plain(first(n), "$.kind").alias("kind"))
    members = v(family).select("doc_id", F.posexplode(F.transform(_many(F.col("v"), FAMILY), member)).alias("pos", "m")).select("doc_id", "pos", "m.*")
    members = members.where(F.col("country").isNotNull() & F.col("number").isNotNull())

    event = lambda n: F.struct(
        F.try_variant_get(n, '$["@country"]', "string").alias("country"), F.try_variant_get(n, '$["@doc-number"]', "string").alias("number"),
        F.coalesce(F.try_variant_get(n, '$["ops:legal"]["@code"]', "string"), F.try_variant_get(n, '$["@code"]', "string")).alias("code"),
        _date(F.try_variant_get(n, '$["@date"]', "string")).alias("date"), F.try_variant_get(n, '$["@desc"]', "string").alias("description"),
    )
    events = v(legal).select("doc_id", F.posexplode(F.transform(_many(F.col("v"), LEGAL), event)).alias("pos", "e")).select("doc_id", "pos", "e.*")
    events = P.map_legal(events.where((F.col("country") != "") & (F.col("number") != "") & (F.col("code") != "")))
    keyed = lambda rows: rows.withColumn("member", F.struct("doc_id", F.concat("country", "number").alias("name")))
    found = records.where("found").select("doc_id")
    members = P.member_status(keyed(members.join(found, "doc_id", "left_semi")), keyed(events).withColumnRenamed("pos", "ord")).drop("member")
    return records, members, events.select("doc_id", "pos", "country", "number", "code", "category", "effect", "date", "description")


# Fixed names of the alignment output.
HSP = "STRUCT<`Hsp_align-len`: STRING, Hsp_identity: STRING, `Hsp_query-from`: STRING, `Hsp_query-to`: STRING, Hsp_evalue: STRING, `Hsp_bit-score`: STRING>"
HIT = f"STRUCT<Hit_accession: STRING, Hit_def: STRING, Hit_hsps: STRUCT<Hsp: ARRAY<{HSP}>>>"
OUTPUT = (
    "`BlastOutput_query-len` STRING, BlastOutput_version STRING, BlastOutput_db STRING, "
    f"BlastOutput_iterations STRUCT<Iteration: ARRAY<STRUCT<Iteration_hits: STRUCT<Hit: ARRAY<{HIT}>>>>>"
)
PATENT_DATABASES = ("pataa", "patnt")


def _number(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def _shown(c: Column) -> Column:
    """A number without a closing ``.0``."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def alignment_hits(responses: DataFrame, max_hits: int | None = None) -> DataFrame:
    """Hits of alignment responses (query_id, program, database, xml), ``rank`` from 1 in the response's order.

    Of a hit its first segment counts: identity and coverage in percent, one decimal, 0 where there is
    nothing to divide by; the organism is what stands in brackets in the description. ``max_hits`` keeps
    the first hits of a query. Texts that are not such a response give no hits.
    """
    if max_hits is not None and max_hits < 1:
        raise ValueError(f"at least 1 expected, not {max_hits}")
    read = responses.select("query_id", "program", "database", F.from_xml("xml", OUTPUT, {"mode": "PERMISSIVE"}).alias("o"))
    first = F.get("o.BlastOutput_iterations.Iteration", F.lit(0))
    hits = first["Iteration_hits"]["Hit"]
    hits = hits if max_hits is None else F.slice(hits, 1, max_hits)
    rows = read.select("query_id", "program", "database", F.col("o.`BlastOutput_query-len`").alias("_len"), F.col("o.BlastOutput_version").alias("version"), F.col("o.BlastOutput_db").alias("db"), F.posexplode(hits).alias("pos", "h"))
    s = F.get(F.col("h.Hit_hsps.Hsp"), F.lit(0))
    title = F.coalesce("h.Hit_def", F.lit("(no description)"))
    rows = rows.select(
        "query_id", "program", "database", (F.col("pos") + 1).alias("rank"), F.coalesce("h.Hit_accession", F.lit("")).alias("accession"), title.alias("title"),
        F.regexp_extract(title, r"\[([^\]]+)\]", 1).alias("organism"), _number(s["Hsp_identity"]).cast("bigint").alias("identity"), _number(s["Hsp_align-len"]).cast("bigint").alias("align_len"),
        (_number(s["Hsp_query-to"]) - _number(s["Hsp_query-from"]) + 1).alias("_span"), _number(F.col("_len")).alias("_whole"),
        F.coalesce(s["Hsp_evalue"], F.lit("")).alias("e_value"), _number(s["Hsp_bit-score"]).alias("bit_score"), F.coalesce("version", F.lit("")).alias("version"), F.coalesce("db", F.lit("")).alias("db"),
    )
    rows = rows.withColumn("percent_identity", N.percent_one_decimal(F.col("identity"), F.col("align_len"))).withColumn("query_coverage", N.percent_one_decimal(F.col("_span"), F.col("_whole")))
    said = F.concat(_shown(F.col("percent_identity")), F.lit("% id, E="), "e_value")
    page = F.when(F.col("program") == "blastn", "nuccore").otherwise("protein")
    return rows.drop("_span", "_whole").select(
        "*",
        F.concat(F.lit("BLAST:"), "accession").alias("id"),
        F.when(F.col("database").isin(*PATENT_DATABASES), "patent").otherwise("dataset").alias("kind"),
        F.concat(F.lit("NCBI BLAST "), "program", F.lit(" ("), "database", F.lit(")")).alias("source"),
        F.when(F.col("organism") != "", F.concat(said, F.lit(", "), "organism")).otherwise(said).alias("snippet"),
        F.concat(F.lit("Aligned "), F.col("align_len").cast("string"), F.lit(" residues, query coverage "), _shown(F.col("query_coverage")), F.lit("%.")).alias("passage"),
        F.concat(F.lit("https://www.ncbi.nlm.nih.gov/"), page, F.lit("/"), "accession").alias("url"),
    )
