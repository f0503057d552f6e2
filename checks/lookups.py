"""Patent look-ups and alignment searches made of the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.sources import lookups as LK
from checks.base import Tables, check


def _filled(template: str, **values) -> F.Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"%{name}%"), value)
    return out


@check("""
    WITH o AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y%m%d') AS day, strftime(o_orderdate, '%Y-%m-%d') AS iso, o_orderpriority AS who FROM orders),
    r AS (SELECT k, k % 11 <> 0 AS found,
        CASE WHEN k % 11 = 0 OR k % 3 = 2 THEN NULL ELSE 'Title ' || k END AS title,
        CASE WHEN k % 11 = 0 THEN '' WHEN k % 2 = 0 THEN who ELSE who || '|Co ' || k END AS applicants,
        CASE WHEN k % 11 = 0 OR k % 4 = 0 THEN '' ELSE 'Inv ' || k END AS inventors,
        CASE WHEN k % 11 = 0 THEN '' ELSE 'A61|C' END AS ipc,
        CASE WHEN k % 11 <> 0 THEN iso END AS publication_date,
        CASE WHEN k % 11 <> 0 AND k % 7 <> 0 THEN iso END AS filing_date FROM o),
    m AS (SELECT k, 0 AS pos, 'US' || k AS member, CASE WHEN k % 13 = 1 THEN 'unknown' WHEN k % 2 = 1 AND k % 3 <> 0 THEN 'inactive' ELSE 'active' END AS status FROM o
          UNION ALL SELECT k, 1, 'EP' || k, 'unknown' FROM o WHERE k % 3 <> 1)
    SELECT r.k AS doc_id, found, title, applicants, inventors, ipc, publication_date, filing_date,
           CAST(CAST(substr(filing_date, 1, 4) AS INT) + 20 AS VARCHAR) || substr(filing_date, 5) AS estimated_expiry, m.member, m.status
    FROM r LEFT JOIN m ON m.k = r.k AND found AND r.k % 13 <> 0
""")
def patent_records(t: Tables) -> DataFrame:
    """Biblio, family and legal responses in every shape they come in."""
    k = F.col("o_orderkey")
    key, day = k.cast("string"), F.date_format("o_orderdate", "yyyyMMdd")
    title = F.when(k % 3 == 0, _filled('{"$":"Title %k%"}', k=key)).when(k % 3 == 1, _filled('"Title %k%"', k=key)).otherwise('[{"$":"one of two"},{"$":"titles"}]')
    one = _filled('{"applicant-name":{"name":{"$":"%who%"}}}', who=F.col("o_orderpriority"))
    applicants = F.when(k % 2 == 0, one).otherwise(F.concat(F.lit("["), one, _filled(',{"applicant-name":{"name":""}},{"applicant-name":{"name":"Co %k%"}}]', k=key)))
    inventors = F.when(k % 4 == 0, "{}").otherwise(_filled('{"inventor":{"inventor-name":{"name":"Inv %k%"}}}', k=key))
    filed = F.when(k % 7 == 0, '"2020-01"').when(k % 5 == 0, day).otherwise(F.concat(F.lit('"'), day, F.lit('"')))
    biblio = _filled(
        '{"ops:world-patent-data":{"exchange-documents":{"exchange-document":{"bibliographic-data":{"invention-title":%title%,"parties":{"applicants":{"applicant":%applicants%},"inventors":%inventors%},'
        '"publication-reference":{"document-id":[{"date":""},{"date":{"$":"%day%"}}]},"application-reference":{"document-id":{"date":%filed%}},'
        '"patent-classifications":{"patent-classification":[{"section":"A","class":"61"},{"section":{"$":"C"}},{}]}}}}}}',
        title=title, applicants=applicants, inventors=inventors, filed=filed, day=day,
    )
    us = _filled('{"publication-reference":{"document-id":[{"country":"US","doc-number":%k%,"kind":"A1"},{"country":"XX","doc-number":"0"}]}}', k=key)
    ep = _filled('{"publication-reference":{"document-id":{"country":{"$":"EP"},"doc-number":{"$":"%k%"}}}},{"publication-reference":{"document-id":{"country":"","doc-number":"7"}}}', k=key)
    family = _filled('{"ops:world-patent-data":{"ops:patent-family":{"ops:family-member":%m%}}}', m=F.when(k % 3 == 1, us).otherwise(F.concat(F.lit("["), us, F.lit(","), ep, F.lit("]"))))
    granted = _filled('{"@country":"US","@doc-number":"%k%","@date":"%day%","ops:legal":{"@code":"PG25"},"@desc":"granted"}', k=key, day=day)
    later = _filled('{"@country":"US","@doc-number":%k%,"@date":"%day%","@code":"%code%"},{"@country":"US","@doc-number":"","@code":"WD"}', k=key, day=day, code=F.when(k % 2 == 1, "MM4A").otherwise("XXXX"))
    legal = _filled('{"ops:world-patent-data":{"ops:legal":%e%}}', e=F.when(k % 3 == 0, granted).otherwise(F.concat(F.lit("["), granted, F.lit(","), later, F.lit("]"))))
    orders = t["orders"].select(k.alias("doc_id"), F.when(k % 11 == 0, '{"ops').otherwise(biblio).alias("biblio"), family.alias("family"), F.when(k % 13 == 1, "no json").otherwise(legal).alias("legal"))
    of = lambda c, rows=orders: rows.select("doc_id", F.col(c).alias("text"))
    records, members, _ = LK.patent_lookups(of("biblio"), of("family", orders.where("doc_id % 13 <> 0")), of("legal"))
    joined = lambda c: F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c)
    flat = records.select("doc_id", "found", "title", joined("applicants"), joined("inventors"), joined("ipc"), "publication_date", "filing_date", "estimated_expiry")
    return flat.join(members.select("doc_id", F.concat("country", "number").alias("member"), "status"), "doc_id", "left")


@check("""
    WITH h AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem)
    SELECT l_orderkey AS query_id, rn AS rank, 'BLAST:P' || l_partkey AS id, CASE WHEN l_orderkey % 2 = 0 THEN 'patent' ELSE 'dataset' END AS kind,
           CASE WHEN q = 1 THEN 0.0 ELSE floor((q - 1 - l_linenumber % 2)::DOUBLE / (q - 1) * 1000 + 0.5) / 10 END AS percent_identity,
           floor((q + 1)::DOUBLE / 60 * 1000 + 0.5) / 10 AS query_coverage, CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE 'Sp ' || l_suppkey END AS organism
    FROM h WHERE rn <= 3 AND l_orderkey % 17 <> 0
""")
def alignment_hits(t: Tables) -> DataFrame:
    """The first three hits of each order's search; every 17th response is cut short."""
    text = lambda c: c.cast("string")

    def hit(x: F.Column) -> F.Column:
        q, n, supplier = x["q"], x["l_linenumber"], x["l_suppkey"]
        name = F.when(supplier % 3 == 0, "protein x").otherwise(F.concat(F.lit("protein x [Sp "), text(supplier), F.lit("] [other]")))
        second = F.when(n % 3 == 0, "<Hsp><Hsp_identity>1</Hsp_identity><Hsp_align-len>9</Hsp_align-len></Hsp>").otherwise("")
        return F.concat(
            F.lit("<Hit><Hit_def>"), name, F.lit("</Hit_def><Hit_accession>P"), text(x["l_partkey"]),
            F.lit("</Hit_accession><Hit_hsps><Hsp><Hsp_bit-score>50.5</Hsp_bit-score><Hsp_evalue>1e-9</Hsp_evalue><Hsp_query-from>1</Hsp_query-from><Hsp_query-to>"), text(q + 1),
            F.lit("</Hsp_query-to><Hsp_identity>"), text(q - 1 - n % 2), F.lit("</Hsp_identity><Hsp_align-len>"), text(q - 1),
            F.lit("</Hsp_align-len></Hsp>"), second, F.lit("</Hit_hsps></Hit>"),
        )

    # An order has a few lines: one response each, written where they have met. Lines may repeat, so the quantity completes their order.
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("q"))
    hits = t["lineitem"].groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), hit), "").alias("hits"))
    head = F.lit("<?xml version='1.0'?><BlastOutput><BlastOutput_version>BLASTP 2.x</BlastOutput_version><BlastOutput_db>nr</BlastOutput_db><BlastOutput_query-len>60</BlastOutput_query-len><BlastOutput_iterations><Iteration><Iteration_hits>")
    whole = F.concat(head, "hits", F.lit("</Iteration_hits></Iteration></BlastOutput_iterations></BlastOutput>"))
    key = F.col("l_orderkey")
    responses = hits.select(
        key.alias("query_id"), F.lit("blastp").alias("program"), F.when(key % 2 == 0, "pataa").otherwise("nr").alias("database"), F.when(key % 17 == 0, F.substring(whole, 1, 150)).otherwise(whole).alias("xml")
    )
    return LK.alignment_hits(responses, 3).select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", "kind", "percent_identity", "query_coverage", "organism")
