"""Evidence table queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.operators import patents as P
from attestra.operators import store as S
from attestra.session import checkpoint_dir, cut_lineage
from attestra.sources import hashes as H
from attestra.streaming import upsert as U
from checks import views as V
from checks.base import Tables, check


@check("SELECT cited, citing, count(*) AS n, max(cited_by) AS cited_by FROM v_edges GROUP BY ALL")
def citation_edges(t: Tables) -> DataFrame:
    return V.v_edges(t).groupBy("cited", "citing").agg(F.count(F.lit(1)).alias("n"), F.max("cited_by").alias("cited_by"))


@check("""
    SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) >= 50 AS readable FROM
        (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id + 1000000, regexp_replace(text, '[a-z]', '', 'g') FROM documents)
""")
def readable_docs(t: Tables) -> DataFrame:
    docs = t.text("documents").select("doc_id", "text")
    bare = docs.select((F.col("doc_id") + 1000000).alias("doc_id"), F.regexp_replace("text", "[a-z]", "").alias("text"))
    good, bad = P.readable_docs(docs.unionByName(bare))
    return good.select("doc_id", F.lit(True).alias("readable")).unionByName(bad.select("doc_id", F.lit(False).alias("readable")))


@check("SELECT id, title, md5(passage) AS passage_md5, pmcid, ord FROM v_store")
def evidence_first(t: Tables) -> DataFrame:
    return V.v_store(t).select("id", "title", F.md5("passage").alias("passage_md5"), "pmcid", "ord")


@check("""
    SELECT id, title, md5(passage) AS passage_md5, ord FROM
      (SELECT *, row_number() OVER (PARTITION BY id ORDER BY side DESC, ord DESC) AS rn FROM
        (SELECT 0 AS side, id, title, passage, ord FROM v_store UNION ALL SELECT 1, id, title, passage, ord FROM v_evidence WHERE is_review))
    WHERE rn = 1
""")
def evidence_last(t: Tables) -> DataFrame:
    cols = ["id", "title", "passage", "ord"]
    merged = S.merge_last(V.v_store(t).select(*cols), V.v_evidence(t).where("is_review").select(*cols))
    return merged.select("id", "title", F.md5("passage").alias("passage_md5"), "ord")


@check("""
    SELECT 'first' AS rule, id, title, md5(passage) AS passage_md5, ord FROM v_store
    UNION ALL SELECT 'last', id, title, md5(passage), ord FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS rn FROM v_evidence) WHERE rn = 1
""")
def evidence_upserts(t: Tables) -> DataFrame:
    """The evidence in five batches, upserted into two keyed tables."""
    rows = cut_lineage(V.v_evidence(t).select("id", "title", "passage", "ord"))
    folder = f"{checkpoint_dir(t.spark)}/upserts-{uuid.uuid4().hex}"
    out = []
    for rule in (U.FIRST, U.LAST):
        table = U.KeyedTable(t.spark, f"{folder}/{rule}", rule=rule, buckets=8)
        for n in range(5):
            table.apply(rows.where(F.pmod("ord", F.lit(5)) == n), n)
        out.append(table.read().select(F.lit(rule).alias("rule"), "id", "title", F.md5("passage").alias("passage_md5"), "ord"))
    return out[0].unionByName(out[1])


IDENTITY = """
    SELECT i.id, CASE WHEN e.id IS NULL THEN split_part(i.id, '#', 1)
                      ELSE coalesce(p.parent, split_part(i.id, '#', 1)) END AS source_identity
    FROM ids i LEFT JOIN v_store e ON e.id = i.id
    LEFT JOIN (SELECT 'PMCID:' || pmcid AS root, arg_max(id, ord) AS parent FROM v_store
               WHERE id LIKE 'PMID:%' AND pmcid <> '' GROUP BY 1) p ON p.root = split_part(i.id, '#', 1)
"""


@check("""
    WITH ids AS (SELECT id FROM v_evidence UNION SELECT unnest(citations) FROM v_claims)
""" + IDENTITY)
def source_identity(t: Tables) -> DataFrame:
    ids = V.v_evidence(t).select("id").unionByName(S.cited_ids(V.v_claims(t)))
    return S.source_identity(ids, V.v_store(t))


def _cited(t: Tables) -> DataFrame:
    """Ids cited by claims, with every full-text section of a cited paper."""
    full = V.v_claims(t).select(
        F.explode(F.transform("citations", lambda c: F.concat(F.lit("PMCID:PMC"), F.substring(c, 6, 20), F.lit("#sec-0")))).alias("id")
    )
    return S.cited_ids(V.v_claims(t)).unionByName(full).distinct()


CITED = """
    cited AS (SELECT DISTINCT unnest(citations) AS id FROM v_claims
              UNION SELECT 'PMCID:PMC' || substr(c, 6) || '#sec-0' FROM (SELECT unnest(citations) AS c FROM v_claims))
"""


@check("WITH " + CITED + """
    SELECT base AS id, kind, source, CASE WHEN base LIKE 'PMCID:%' THEN 'PubMed Central full text' ELSE title END AS title,
           split_part(url, '#', 1) AS url, snippet
    FROM (SELECT *, split_part(id, '#', 1) AS base, row_number() OVER (PARTITION BY split_part(id, '#', 1) ORDER BY ord) AS rn
          FROM v_store WHERE id IN (SELECT id FROM cited)) WHERE rn = 1
""")
def references(t: Tables) -> DataFrame:
    store = V.v_store(t).withColumn("raw", F.lit(None).cast("string"))
    return S.references(store, _cited(t)).drop("raw")


@check("WITH " + CITED + """
    SELECT id, base, title, ord FROM (SELECT *, split_part(id, '#', 1) AS base,
           row_number() OVER (PARTITION BY split_part(id, '#', 1) ORDER BY ord) AS rn FROM v_store
           WHERE split_part(id, '#', 1) IN (SELECT split_part(id, '#', 1) FROM cited)) WHERE rn = 1
""")
def cited_publications(t: Tables) -> DataFrame:
    return S.cited_publications(V.v_store(t), _cited(t)).select("id", "base", "title", "ord")


KEYS = """
    keyed AS (SELECT p.*, r.reg_title, r.reg_journal, r.reg_year, r.doi IS NOT NULL AS found,
              trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS a,
              trim(regexp_replace(lower(reg_title), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS b
              FROM v_with_doi p LEFT JOIN v_registry r ON r.doi = p.doi),
    compared AS (SELECT *, coalesce(length(a) > 0 AND length(b) > 0 AND (contains(a, b) OR contains(b, a) OR
                 len(list_intersect(string_split(a, ' '), string_split(b, ' '))) /
                 len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))) >= 0.8), FALSE) AS same FROM keyed)
"""


@check("WITH " + KEYS + """
    SELECT id, doi, found AND same AS verified,
           CASE WHEN doi IS NULL THEN 'no doi' WHEN NOT found THEN 'doi not found on crossref' WHEN NOT same THEN 'title mismatch' END AS note,
           CASE WHEN found THEN coalesce(reg_journal, journal) ELSE journal END AS journal,
           CASE WHEN found THEN coalesce(reg_year, year) ELSE year END AS year
    FROM compared
""")
def doi_check(t: Tables) -> DataFrame:
    return S.doi_check(V.v_with_doi(t), V.v_registry(t)).select("id", "doi", "verified", "note", "journal", "year")


@check("WITH " + KEYS + "SELECT doc_id, a AS title_key, b AS reg_key, same FROM compared WHERE found")
def title_match(t: Tables) -> DataFrame:
    both = V.v_with_doi(t).join(V.v_registry(t), "doi")
    return both.select(
        "doc_id", T.title_key(F.col("title")).alias("title_key"), T.title_key(F.col("reg_title")).alias("reg_key"),
        T.titles_match(F.col("title"), F.col("reg_title")).alias("same"),
    )


@check("""
    WITH q AS (SELECT DISTINCT conv_id AS question_id, run_id FROM v_claims),
    h AS (SELECT question_id, id, min(rank) AS pos FROM (SELECT conv_id AS question_id, turn * 10 + i AS rank, citations[i] AS id
          FROM v_claims, (SELECT unnest([1, 2]) AS i) WHERE len(citations) > 0) GROUP BY 1, 2)
    SELECT c.run_id, NULL AS question_id, 0 AS block, c.ord AS pos, c.id,
           md5('[' || c.id || '] ' || c.title || ' - ' || c.snippet) AS line_md5
    FROM v_cards c WHERE run_id IN (SELECT run_id FROM q)
    UNION ALL
    SELECT q.run_id, h.question_id, 1, h.pos, e.id, md5('[' || e.id || ']' || CASE WHEN e.locator IS NULL THEN '' ELSE ' (' || e.locator || ')' END
           || ' ' || e.title || ' - ' || coalesce(e.passage, e.snippet)) FROM h JOIN q USING (question_id) JOIN v_store e USING (id)
""")
def evidence_context(t: Tables) -> DataFrame:
    claims = V.v_claims(t)
    questions = claims.select(F.col("conv_id").alias("question_id"), "run_id").distinct()
    runs = claims.select("run_id").distinct()
    hits = claims.select(
        F.col("conv_id").alias("question_id"), "turn", F.posexplode("citations").alias("i", "id")
    ).select("question_id", "id", (F.col("turn") * 10 + F.col("i") + 1).alias("rank"))
    cols = ["run_id", "id", "kind", "title", "snippet", "passage", "locator", "ord"]
    # Literature of a run: the records its questions cite.
    seen = claims.select("run_id", F.explode("citations").alias("id")).distinct()
    papers = V.v_store(t).join(seen, "id").select(*cols)
    store = V.v_cards(t).select(*cols).unionByName(papers)
    lines = S.evidence_context(questions, store.join(runs, "run_id", "left_semi"), hits)
    return lines.select("run_id", "question_id", "block", "pos", "id", F.md5("line").alias("line_md5"))


RESULTS2 = """
    SELECT 'c' || s_suppkey AS computation_id, CASE WHEN s_suppkey % 17 = 0 THEN 'Bad Key' ELSE 'supplier.balance' END AS result_key, NULL::VARCHAR AS group_key,
           'scalar' AS type, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_acctbal END AS value, 'usd' AS unit,
           CASE WHEN s_suppkey % 13 = 0 THEN 3 ELSE 1 END AS missing_n, 4 AS observed_n, 5 AS total_n, 0.2 AS fraction, CASE WHEN s_suppkey % 10 = 0 THEN 0 ELSE 4 END AS sample_n,
           s_suppkey % 10 IN (0, 3) AS nullable
    FROM supplier
    UNION ALL
    SELECT 'c' || (c_custkey % 100), 'series.nation', CASE WHEN i = 0 THEN NULL ELSE c_nationkey::VARCHAR END,
           CASE WHEN i = 0 THEN 'grouped-series' ELSE 'scalar' END, CASE WHEN i = 0 THEN NULL ELSE c_acctbal END,
           CASE WHEN i = 1 AND c_custkey % 19 = 0 THEN 'eur' ELSE 'usd' END, 1, 4, 5, 0.2, 4, FALSE
    FROM customer, (SELECT unnest([0, 1]) AS i) WHERE i = 1 OR (c_custkey < 100 AND c_custkey % 3 <> 0)
"""


def result_rows(t: Tables) -> DataFrame:
    key = F.col("s_suppkey")
    null = F.lit(None).cast("string")
    scalars = t["supplier"].select(
        F.concat(F.lit("c"), key.cast("string")).alias("computation_id"),
        F.when(key % 17 == 0, "Bad Key").otherwise("supplier.balance").alias("result_key"), null.alias("group_key"),
        F.lit("scalar").alias("type"), F.when(key % 5 != 0, F.col("s_acctbal")).alias("value"), F.lit("usd").alias("unit"),
        F.when(key % 13 == 0, 3).otherwise(1).alias("missing_n"), F.lit(4).alias("observed_n"), F.lit(5).alias("total_n"),
        F.lit(0.2).alias("fraction"), F.when(key % 10 == 0, 0).otherwise(4).alias("sample_n"), (key % 10).isin(0, 3).alias("nullable"),
    )
    cust = F.col("c_custkey")
    base = t["customer"].select("c_custkey", "c_nationkey", "c_acctbal", F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    point = F.col("i") == 1
    series = base.where(point | ((cust < 100) & (cust % 3 != 0))).select(
        F.concat(F.lit("c"), (cust % 100).cast("string")).alias("computation_id"), F.lit("series.nation").alias("result_key"),
        F.when(point, F.col("c_nationkey").cast("string")).alias("group_key"),
        F.when(point, "scalar").otherwise("grouped-series").alias("type"), F.when(point, F.col("c_acctbal")).alias("value"),
        F.when(point & (cust % 19 == 0), "eur").otherwise("usd").alias("unit"), F.lit(1).alias("missing_n"), F.lit(4).alias("observed_n"),
        F.lit(5).alias("total_n"), F.lit(0.2).alias("fraction"), F.lit(4).alias("sample_n"), F.lit(False).alias("nullable"),
    )
    return scalars.unionByName(series).select(
        "*", F.lit("none").alias("comparator"), F.lit("neutral").alias("direction"), F.lit(2).alias("precision"), F.lit(0.0).alias("tolerance")
    )


@check("WITH r AS (" + RESULTS2 + """),
    h AS (SELECT computation_id, result_key, max(unit) AS series_unit FROM r WHERE type = 'grouped-series' GROUP BY 1, 2),
    g AS (SELECT computation_id, result_key, group_key, count(*) AS copies FROM r WHERE group_key IS NOT NULL GROUP BY 1, 2, 3),
    s AS (SELECT DISTINCT computation_id, result_key FROM g),
    j AS (SELECT r.*, h.series_unit, g.copies, s.computation_id IS NOT NULL AS has_groups FROM r
          LEFT JOIN h ON h.computation_id = r.computation_id AND h.result_key = r.result_key
          LEFT JOIN g ON g.computation_id = r.computation_id AND g.result_key = r.result_key AND g.group_key = r.group_key
          LEFT JOIN s ON s.computation_id = r.computation_id AND s.result_key = r.result_key)
    SELECT reason, count(*) AS n FROM (
        SELECT unnest(list_filter([
            CASE WHEN missing_n + observed_n <> total_n THEN 'missingness does not add up' END,
            CASE WHEN type = 'scalar' AND value IS NULL AND (NOT nullable OR sample_n <> 0) THEN 'null value without nullable and sample 0' END,
            CASE WHEN value IS NOT NULL AND nullable THEN 'numeric value marked nullable' END,
            CASE WHEN type = 'grouped-series' AND NOT has_groups THEN 'series without groups' END,
            CASE WHEN copies > 1 THEN 'duplicate group key' END,
            CASE WHEN group_key IS NOT NULL AND series_unit <> unit THEN 'group unit differs from series' END,
            CASE WHEN group_key IS NOT NULL AND series_unit IS NULL THEN 'group without series' END,
            CASE WHEN NOT regexp_full_match(result_key, '[a-z][a-z0-9_.-]*') THEN 'invalid result key' END], lambda x: x IS NOT NULL)) AS reason FROM j)
    GROUP BY 1 UNION ALL SELECT 'rows', count(*) FROM j
""")
def result_contract(t: Tables) -> DataFrame:
    checked = S.check_results(result_rows(t))
    by_reason = checked.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return by_reason.unionByName(checked.agg(F.count(F.lit(1)).alias("n")).select(F.lit("rows").alias("reason"), "n"))


@check("""
    SELECT source, sum(octet_length(encode(text)) + 1)::BIGINT AS bytes, sha256(string_agg(text || chr(10), '' ORDER BY doc_id)) AS sha256
    FROM documents WHERE text IS NOT NULL GROUP BY source
""")
def dataset_hash(t: Tables) -> DataFrame:
    """One file for each source, of its texts by id; the files are then hashed."""
    folder = f"{checkpoint_dir(t.spark)}/texts-{uuid.uuid4().hex}"
    texts = t["documents"].where(F.col("text").isNotNull()).repartition("source").sortWithinPartitions("source", "doc_id")
    texts.select("source", "text").write.partitionBy("source").text(folder)
    hashed = H.file_hashes(H.listed(t.spark, folder))
    return hashed.select(F.url_decode(F.regexp_extract("path", "/source=([^/]*)/", 1)).alias("source"), "bytes", "sha256")
