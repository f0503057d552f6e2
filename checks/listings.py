"""Listings and search responses, written as texts from the driver tables and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.operators import patents as P
from attestra.sources import targets as G
from checks.base import Tables, check

LETTERS = "ACDEFGHIKLMNPQRS"
LINES = f"""
    ln AS (SELECT l_orderkey AS doc_id, l_linenumber AS seq_id, l_partkey, l_suppkey,
           CASE WHEN l_linenumber % 4 = 3 THEN 'ACD' ELSE translate(md5(CAST(l_partkey AS VARCHAR)), '0123456789abcdef', '{LETTERS}') END AS residues,
           row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS rn FROM lineitem)
"""


def _lines(t: Tables) -> DataFrame:
    residues = F.translate(F.md5(F.col("l_partkey").cast("string").cast("binary")), "0123456789abcdef", LETTERS)
    return t["lineitem"].select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("bigint").alias("seq_id"), "l_partkey", "l_suppkey",
        F.when(F.col("l_linenumber") % 4 == 3, "ACD").otherwise(residues).alias("residues"),
    )


def _texts(rows: DataFrame, *parts: Column) -> DataFrame:
    """One text a document: each part of all its lines in turn. An order has a few lines."""
    names = [f"p{i}" for i in range(len(parts))]
    entry = F.struct("seq_id", "l_partkey", "l_suppkey", *[p.alias(n) for p, n in zip(parts, names, strict=True)])
    all_lines = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    pick = lambda name: F.array_join(F.transform("e", lambda x: x[name]), "")
    return all_lines.select("doc_id", F.concat(*map(pick, names)).alias("text"))


@check("WITH " + LINES + """
    SELECT doc_id, seq_id, residues, length(residues) + seq_id AS declared_length FROM ln WHERE rn = 1 AND length(residues) >= 4
""")
def listing_text(t: Tables) -> DataFrame:
    number = F.col("seq_id").cast("string")
    length = (F.length("residues") + F.col("seq_id")).cast("string")
    declared = F.concat(F.lit("<210> "), number, F.lit("\n<211> "), length, F.lit("\n"))
    block = F.concat(F.lit("SEQ ID NO: "), number, F.lit("\n"), "residues", F.lit("\n\n"))
    return P.text_listing(_texts(_lines(t), declared, block)).select("doc_id", "seq_id", "residues", "declared_length")


@check("WITH " + LINES + """
    SELECT doc_id, seq_id, residues, CASE WHEN seq_id % 2 = 0 THEN length(residues) END AS declared_length FROM ln WHERE rn = 1 AND length(residues) >= 4
""")
def listing_xml(t: Tables) -> DataFrame:
    number = F.col("seq_id").cast("string")
    length = F.when(F.col("seq_id") % 2 == 0, F.length("residues").cast("string")).otherwise("about")
    rows = _lines(t).withColumn(
        "xml",
        F.concat(
            F.lit('<SequenceData sequenceIDNumber="'), number, F.lit('"><INSDSeq><INSDSeq_length>'), length, F.lit("</INSDSeq_length><INSDSeq_sequence>"),
            "residues", F.lit("</INSDSeq_sequence></INSDSeq></SequenceData>"),
        ),
    )
    docs = _texts(rows, F.col("xml")).select(
        "doc_id", F.concat(F.lit('<?xml version="1.0"?>\n<ST26SequenceListing>'), "text", F.lit("</ST26SequenceListing>")).alias("text")
    )
    return P.sequences(docs).select("doc_id", "seq_id", "residues", "declared_length")


@check("""
    WITH o AS (SELECT *, o_orderkey // 2 AS num, o_orderkey % 3 AS k, row_number() OVER (PARTITION BY o_custkey, o_orderkey // 2, o_orderkey % 3 ORDER BY o_orderkey) AS rn FROM orders)
    SELECT 'PATENT:' || ['US', 'EP', 'WO'][k + 1] || num || CASE WHEN k = 2 THEN '' ELSE 'A' || k END AS id,
           CASE WHEN o_orderkey % 5 = 0 THEN '(no title)' WHEN o_orderkey % 4 = 0 THEN 'Auftrag ' || o_orderkey ELSE 'Order ' || o_orderkey END AS title,
           o_orderpriority || ' · ' || strftime(o_orderdate, '%Y-%m-%d') || ' · IPC A6' || o_orderkey % 2 || 'K' AS snippet
    FROM o WHERE rn = 1
""")
def src_patent_hits(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    text = lambda c: F.struct(c.cast("string").alias("$"))
    number = (key - key % 2) / 2
    country = F.element_at(F.array(F.lit("US"), F.lit("EP"), F.lit("WO")), (key % 3 + 1).cast("int"))
    kind = F.when(key % 3 != 2, F.concat(F.lit("A"), (key % 3).cast("string")))
    plain = number.cast("bigint").cast("string")
    # The epodoc reference writes the country inside the number; the docdb one is the identity.
    refs = F.array(
        F.struct(F.lit("epodoc").alias("@document-id-type"), text(F.lit("")).alias("country"), text(F.concat(country, plain)).alias("doc-number"), text(F.lit(None)).alias("kind"), text(F.lit(None)).alias("date")),
        F.struct(F.lit("docdb").alias("@document-id-type"), text(country).alias("country"), text(F.concat(country, plain)).alias("doc-number"), text(kind).alias("kind"), text(F.date_format("o_orderdate", "yyyyMMdd")).alias("date")),
    )
    title = lambda lang, c: F.struct(F.lit(lang).alias("@lang"), c.alias("$"))
    german, english = title("de", F.concat(F.lit("Auftrag "), key.cast("string"))), title("en", F.concat(F.lit("Order "), key.cast("string")))
    titles = F.when(key % 5 != 0, F.when(key % 4 == 0, F.array(german)).otherwise(F.array(german, english)))
    applicant = F.struct(F.struct(text(F.col("o_orderpriority")).alias("name")).alias("applicant-name"))
    symbol = F.struct(text(F.lit("A")).alias("section"), text(F.concat(F.lit("6"), (key % 2).cast("string"))).alias("class"), text(F.lit("K")).alias("subclass"))
    biblio = F.struct(
        F.struct(refs.alias("document-id")).alias("publication-reference"), titles.alias("invention-title"),
        F.struct(F.struct(F.array(applicant, applicant).alias("applicant")).alias("applicants")).alias("parties"),
        F.struct(symbol.alias("patent-classification")).alias("patent-classifications"),
    )
    entry = F.struct(key.alias("o"), F.struct(biblio.alias("bibliographic-data")).alias("exchange-document"))
    # A customer has a few orders: one response each.
    found = t["orders"].groupBy("o_custkey").agg(F.array_sort(F.collect_list(entry)).alias("docs"))
    nested = F.struct(F.struct(F.struct(F.col("docs").alias("exchange-documents")).alias("ops:search-result")).alias("ops:biblio-search")).alias("ops:world-patent-data")
    responses = found.select(F.col("o_custkey").alias("record"), F.to_json(F.struct(nested)).alias("text"))
    return G.patent_evidence(G.patent_records(responses)).select("id", "title", "snippet")
