"""Patent and figure queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions import numbers as N
from attestra.functions import seqs as SQ
from attestra.operators import figures as G
from attestra.operators import patents as P
from checks import views as V
from checks.base import Tables, check


@check("""
    WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'us ' END || o_orderkey || '-' || o_custkey || CASE WHEN o_orderkey % 3 = 0 THEN ' b2' ELSE '' END AS raw FROM orders),
    c AS (SELECT o_orderkey, upper(regexp_replace(raw, '[\\s,.-]', '', 'g')) AS x FROM n)
    SELECT o_orderkey, CASE WHEN ok THEN regexp_extract(x, '^([A-Z]{2})(\\d+)', 1) END AS country, CASE WHEN ok THEN regexp_extract(x, '^([A-Z]{2})(\\d+)', 2) END AS number,
           CASE WHEN ok THEN nullif(regexp_extract(x, '([A-Z]\\d?)$', 1), '') END AS kind FROM (SELECT *, regexp_full_match(x, '[A-Z]{2}\\d+([A-Z]\\d?)?') AS ok FROM c)
""")
def patent_no(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    raw = F.concat(
        F.when(key % 5 == 0, "").otherwise("us "), key.cast("string"), F.lit("-"), F.col("o_custkey").cast("string"),
        F.when(key % 3 == 0, " b2").otherwise(""),
    )
    return t["orders"].select("o_orderkey", SQ.patent_number(raw).alias("p")).select("o_orderkey", "p.country", "p.number", "p.kind")


@check("""
    SELECT doc_id, length(w) AS n, md5(w) AS window_md5 FROM (SELECT doc_id,
        CASE WHEN doc_id % 2 = 0 THEN '## Claims' || chr(10) || text || text || text ELSE text END AS w FROM documents)
""")
def claims_window(t: Tables) -> DataFrame:
    text = F.col("text")
    body = F.when(
        F.col("doc_id") % 2 == 0, F.concat(F.lit("some description\n## Claims\n"), text, text, text)
    ).otherwise(text)
    window = SQ.claims_window(body)
    return t.text("documents").select("doc_id", F.length(window).cast("bigint").alias("n"), F.md5(window).alias("window_md5"))


@check("""
    WITH a AS (SELECT doc_id, seq_id FROM v_seq_ids WHERE l_linestatus = 'F'), s AS (SELECT DISTINCT doc_id, seq_id FROM v_seq_ids WHERE l_linestatus = 'O'),
    d AS (SELECT doc_id FROM a UNION SELECT doc_id FROM s),
    c AS (SELECT d.doc_id, (SELECT count(*) FROM s WHERE s.doc_id = d.doc_id) AS found_count, (SELECT count(*) FROM a WHERE a.doc_id = d.doc_id) AS association_count,
          greatest(coalesce((SELECT max(seq_id) FROM s WHERE s.doc_id = d.doc_id), 0), coalesce((SELECT max(seq_id) FROM a WHERE a.doc_id = d.doc_id), 0)) AS referenced_max FROM d)
    SELECT c.*, coalesce(m.missing_ids, '') AS missing_ids FROM c LEFT JOIN (SELECT doc_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS missing_ids
        FROM (SELECT doc_id, unnest(range(1, referenced_max + 1)) AS i FROM c) x WHERE (doc_id, i) NOT IN (SELECT doc_id, seq_id FROM s) GROUP BY 1) m ON m.doc_id = c.doc_id
""")
def completeness(t: Tables) -> DataFrame:
    rows = V.v_seq_ids(t)
    seqs = rows.where("l_linestatus = 'O'").select("doc_id", "seq_id").distinct()
    done = P.completeness(seqs, rows.where("l_linestatus = 'F'").select("doc_id", "seq_id"))
    each = P.missing_ids(seqs, done).select("doc_id", F.explode(F.sequence("first_id", "last_id")).alias("seq_id"))
    gaps = each.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("seq_id")), ",").alias("missing_ids"))
    return done.drop("missing_count").join(gaps, "doc_id", "left").na.fill("", ["missing_ids"])


@check("""
    SELECT doc_id, seq_id, string_agg(region_label, '|' ORDER BY pos, region_label) AS labels FROM
        (SELECT doc_id, seq_id, region_label, min(pos) AS pos FROM v_seq_ids GROUP BY 1, 2, 3) GROUP BY 1, 2
""")
def labels_by_key(t: Tables) -> DataFrame:
    return P.labels_by_sequence(V.v_seq_ids(t)).select("doc_id", "seq_id", F.array_join("labels", "|").alias("labels"))


@check("""
    SELECT ord, code, CASE code WHEN 'PG25' THEN 'granted' WHEN 'WD' THEN 'withdrawn' WHEN 'MK9A' THEN 'expired' END AS category,
           CASE code WHEN 'PG25' THEN 'active' WHEN 'WD' THEN 'inactive' WHEN 'MK9A' THEN 'inactive' ELSE 'neutral' END AS effect FROM v_legal
""")
def legal_map(t: Tables) -> DataFrame:
    return P.map_legal(V.v_legal(t)).select("ord", "code", "category", "effect")


@check("""
    WITH e AS (SELECT member, CASE code WHEN 'PG25' THEN 'active' ELSE 'inactive' END AS effect, row_number() OVER (PARTITION BY member ORDER BY coalesce(date, '') DESC, ord DESC) AS rn
               FROM v_legal WHERE code <> 'XX')
    SELECT c_custkey AS member, coalesce(e.effect, 'unknown') AS status FROM customer LEFT JOIN e ON e.member = c_custkey AND e.rn = 1
""")
def family_status(t: Tables) -> DataFrame:
    members = t["customer"].select(F.col("c_custkey").alias("member"))
    return P.member_status(members, P.map_legal(V.v_legal(t))).select("member", "status")


@check("""
    SELECT member, min(date) AS earliest, (CAST(substr(min(date), 1, 4) AS INT) + 20) || substr(min(date), 5) AS estimated_expiry FROM v_legal
    WHERE regexp_full_match(date, '\\d{4}-\\d{2}-\\d{2}') GROUP BY 1
""")
def est_expiry(t: Tables) -> DataFrame:
    return P.estimated_expiry(V.v_legal(t), "member")


@check("""
    SELECT ord, accession, percent_identity, query_coverage, count(*) AS n FROM v_hits GROUP BY ALL
""")
def hit_identity(t: Tables) -> DataFrame:
    rows = P.score_hits(V.v_raw_hits(t))
    return rows.groupBy("ord", "accession", "percent_identity", "query_coverage").agg(F.count(F.lit(1)).alias("n"))


@check("""
    SELECT seq_id, mismatch_count, mismatch_count = 0 AND query_coverage = 100 AS exact_match, count(*) AS n FROM v_hits GROUP BY ALL
""")
def norm_hits(t: Tables) -> DataFrame:
    return V.v_hits(t).groupBy("seq_id", "mismatch_count", "exact_match").agg(F.count(F.lit(1)).alias("n"))


@check("""
    SELECT h.doc_id, h.seq_id, accession, ord, percent_identity FROM v_hits h JOIN v_seqs s USING (doc_id, seq_id) WHERE s.length >= 50 AND percent_identity >= 98
    UNION ALL SELECT doc_id, seq_id, arg_min(accession, ord * 100000 + CAST(substr(accession, 2) AS BIGINT)), min(ord), -1 FROM v_hits h JOIN v_seqs s USING (doc_id, seq_id) WHERE s.length >= 50 GROUP BY 1, 2
""")
def competitors(t: Tables) -> DataFrame:
    cols = ["doc_id", "seq_id", "accession", "ord", "percent_identity"]
    hits, seqs = V.v_hits(t), V.v_seqs(t)
    # Line items may repeat an order line, so the accession completes the order.
    ranked = hits.withColumn("_o", F.col("ord")).withColumn("ord", F.col("ord") * 100000 + F.substring("accession", 2, 20).cast("bigint"))
    top = P.top_general_hit(seqs, ranked).select("doc_id", "seq_id", "accession", F.col("_o").alias("ord"), F.lit(-1.0).alias("percent_identity"))
    return P.competitors(seqs, hits).select(*cols).unionByName(top)


@check("""
    SELECT h.seq_id, h.mismatch_count = 0 AND query_coverage = 100 AND coalesce(s.declared_length = s.length, TRUE) AS exact_match,
           coalesce(s.declared_length = s.length, FALSE) AS full_length_confirmed, count(*) AS n
    FROM v_hits h LEFT JOIN v_seqs s USING (doc_id, seq_id) GROUP BY ALL
""")
def length_guard(t: Tables) -> DataFrame:
    rows = P.length_guard(V.v_hits(t), V.v_seqs(t))
    return rows.groupBy("seq_id", "exact_match", "full_length_confirmed").agg(F.count(F.lit(1)).alias("n"))


@check("""
    WITH p AS (SELECT event_id // 140 AS domain_id, event_id % 140 + 1 AS n, event_id AS ord, CASE WHEN event_id % 9 = 0 THEN '-' ELSE upper(substr(event_type, 1, 1)) END AS aa,
               CASE WHEN (event_id // 140) % 2 = 0 THEN 'H' ELSE 'K' END AS chain FROM events),
    r AS (SELECT *, CASE WHEN n BETWEEN 1 AND 26 THEN 'FR1' WHEN n BETWEEN 27 AND 38 THEN 'CDR1' WHEN n BETWEEN 39 AND 55 THEN 'FR2' WHEN n BETWEEN 56 AND 65 THEN 'CDR2'
               WHEN n BETWEEN 66 AND 104 THEN 'FR3' WHEN n BETWEEN 105 AND 117 THEN 'CDR3' WHEN n BETWEEN 118 AND 128 THEN 'FR4' END AS g, CASE chain WHEN 'H' THEN 'H' ELSE 'L' END AS side FROM p WHERE aa <> '-'),
    b AS (SELECT domain_id, chain, n, ord, aa, 'V' || side AS label FROM r
          UNION ALL SELECT domain_id, chain, n, ord, aa, regexp_replace(g, '\\d', '') || '-' || side || regexp_replace(g, '\\D', '', 'g') FROM r WHERE g IS NOT NULL)
    SELECT domain_id, chain, label, string_agg(aa, '' ORDER BY ord) AS seq, CAST(min(n) AS INT) AS first_pos, CAST(max(n) AS INT) AS last_pos FROM b GROUP BY 1, 2, 3
""")
def range_bucket(t: Tables) -> DataFrame:
    key = F.col("event_id")
    domain = F.expr("event_id div 140")
    numbering = t["events"].select(
        domain.alias("domain_id"), F.when(domain % 2 == 0, "H").otherwise("K").alias("chain"), key.alias("ord"),
        F.concat((key % 140 + 1).cast("string"), F.when(key % 17 == 0, "A").otherwise("")).alias("position"),
        F.when(key % 9 == 0, "-").otherwise(F.upper(F.substring("event_type", 1, 1))).alias("aa"),
    )
    return P.derive_regions(numbering)


@check("""
    WITH m AS (SELECT DISTINCT l_orderkey AS doc_id, l_linestatus AS name, l_linenumber AS seq_id FROM lineitem),
    d AS (SELECT *, CASE (doc_id + seq_id) % 4 WHEN 0 THEN 'H' WHEN 1 THEN 'K' WHEN 2 THEN 'L' END AS chain FROM m),
    c AS (SELECT doc_id, name, count(*) FILTER (chain = 'H') AS heavy, count(*) FILTER (chain IN ('K', 'L')) AS light FROM d GROUP BY 1, 2)
    SELECT *, CASE WHEN heavy = 1 AND light = 1 THEN NULL WHEN heavy > 1 THEN 'two or more heavy chains grouped into one construct'
        WHEN light > 1 THEN 'two or more light chains grouped into one construct' WHEN heavy = 1 AND light = 0 THEN 'heavy chain with no paired light chain'
        WHEN light = 1 AND heavy = 0 THEN 'light chain with no paired heavy chain' END AS warning FROM c
""")
def pairing(t: Tables) -> DataFrame:
    members = t["lineitem"].select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linestatus").alias("name"), F.col("l_linenumber").cast("bigint").alias("seq_id")
    )
    mark = (F.col("doc_id") + F.col("seq_id")) % 4
    domains = members.select("doc_id", "seq_id").distinct().where(mark < 3).withColumn(
        "chain", F.when(mark == 0, "H").when(mark == 1, "K").otherwise("L")
    )
    return P.pairing(members, domains)


@check("""
    WITH reg AS (SELECT doc_id, 'Ab' || doc_id % 3 AS name, seq_id FROM v_seqs WHERE seq_id % 4 <> 0), loose AS (SELECT doc_id, seq_id FROM v_seqs WHERE seq_id % 4 = 0 OR seq_id % 8 = 1),
    e AS (SELECT 'US' || n_nationkey AS subject, 'OWNED_BY' AS predicate, r_name AS object, 'epo-assignee' AS provenance, 'verified' AS confidence FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0
        UNION ALL SELECT 'US' || doc_id, 'DISCLOSES', 'SEQ:' || seq_id, 'patent-listing', 'claimed' FROM (SELECT doc_id, seq_id FROM reg UNION SELECT doc_id, seq_id FROM loose) WHERE doc_id < 25
        UNION ALL SELECT name, 'HAS_REGION', 'SEQ:' || seq_id, 'claims-grouping', 'claimed' FROM reg
        UNION ALL SELECT 'SEQ:' || r.seq_id, 'MATCHES', accession, 'blast-pataa', CASE WHEN mismatch_count = 0 AND query_coverage = 100 THEN 'verified' ELSE 'claimed' END
                  FROM reg r JOIN v_hits h USING (doc_id, seq_id) WHERE percent_identity >= 98
        UNION ALL SELECT 'SEQ:' || seq_id, 'MATCHES', accession, 'blast-cdr-h3', 'claimed' FROM v_hits WHERE percent_identity >= 90 AND seq_id % 4 = 1 AND align_len < 20)
    SELECT subject, predicate, object, provenance, confidence, count(*) AS n FROM e GROUP BY ALL
""")
def graph_edges(t: Tables) -> DataFrame:
    seqs, hits = V.v_seqs(t), V.v_hits(t)
    patents = t["nation"].select(
        F.col("n_nationkey").cast("bigint").alias("doc_id"), F.concat(F.lit("US"), F.col("n_nationkey").cast("string")).alias("subject"),
        (F.col("n_nationkey") % 2 == 0).alias("found"),
    )
    owners = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("bigint").alias("doc_id"), F.col("r_name").alias("company")
    )
    regions = seqs.where("seq_id % 4 <> 0").select("doc_id", F.concat(F.lit("Ab"), (F.col("doc_id") % 3).cast("string")).alias("name"), "seq_id")
    loose = seqs.where("seq_id % 4 = 0 OR seq_id % 8 = 1").select("doc_id", "seq_id")
    heavy = seqs.where("seq_id % 4 = 1").select("doc_id", F.lit("c").alias("name"), F.col("seq_id").alias("vh_seq_id"))
    loops = P.loop_competitors(heavy, hits.where("align_len < 20"))
    edges = P.graph_edges(patents, owners, regions, loose, hits.where("percent_identity >= 98"), loops)
    return edges.groupBy("subject", "predicate", "object", "provenance", "confidence").agg(F.count(F.lit(1)).alias("n"))


@check("""
    WITH r AS (SELECT doc_id, sha256('blastp|nr|10|' || upper(regexp_replace(title, '[^A-Za-z]', '', 'g'))) AS key FROM (SELECT doc_id, text || ' ' || doc_id AS title FROM documents)),
    q AS (SELECT doc_id, sha256('blastp|nr|10|' || upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))) AS key FROM documents),
    c AS (SELECT key, min(doc_id) AS d FROM q WHERE doc_id % 3 <> 0 GROUP BY 1)
    SELECT q.doc_id, q.key, coalesce(c.d % 40 <= 30 AND c.d % 40 <> 7, FALSE) AS hit FROM q LEFT JOIN c ON c.key = q.key
""")
def cache_lookup(t: Tables) -> DataFrame:
    docs = t["documents"].select("doc_id", F.lit("blastp").alias("program"), F.lit("nr").alias("database"), F.lit(10).alias("expect"), F.col("text").alias("residues"))
    requests = docs.select("doc_id", P.cache_key(["program", "database", "expect"], "residues").alias("key"))
    now = F.to_timestamp(F.lit("2026-03-01 00:00:00"))
    cache = requests.where("doc_id % 3 <> 0").groupBy("key").agg(F.min("doc_id").alias("d")).select(
        "key", F.lit("{}").alias("payload"),
        F.when(F.col("d") % 40 == 7, "not a time").otherwise(F.date_sub(F.lit("2026-03-01").cast("date"), (F.col("d") % 40).cast("int")).cast("string")).alias("cached_at"),
    )
    return P.cache_lookup(requests, cache, now, 30 * 86400).select("doc_id", "key", "hit")


@check("""
    SELECT figure_id, regexp_replace(regexp_replace(regexp_replace(replace(lower(value), '·', '.'), '(\\d+\\.\\d*?)0+(\\D|$)', '\\1\\2', 'g'), '(\\d+)\\.(\\D|$)', '\\1\\2', 'g'), 'x^', '') AS value FROM v_values
""")
def norm_numeric(t: Tables) -> DataFrame:
    return V.v_values(t).select("figure_id", N.numeric_text(F.col("value")).alias("value"))


TIDY = "regexp_replace(regexp_replace(replace(lower({x}), '·', '.'), '(\\d+\\.\\d*?)0+(\\D|$)', '\\1\\2', 'g'), '(\\d+)\\.(\\D|$)', '\\1\\2', 'g')"
READ = """
    r AS (SELECT v.figure_id, v.value, trim(v.value) <> '' AND contains(""" + TIDY.format(x="f.caption") + ", " + TIDY.format(x="trim(v.value)") + """) AS low FROM v_values v JOIN v_figures f USING (figure_id))
"""


@check("WITH " + READ + "SELECT figure_id, CASE WHEN figure_id % 3 = 0 THEN 'bar' ELSE 'other' END AS figure_type, value, low AS in_caption, CASE WHEN low THEN 'low' ELSE 'high' END AS read_risk FROM r")
def gate_readings(t: Tables) -> DataFrame:
    return readings(t).select("figure_id", "figure_type", F.explode("values").alias("v")).select("figure_id", "figure_type", "v.value", "v.in_caption", "v.read_risk")


def readings(t: Tables) -> DataFrame:
    raw = V.v_values(t).select(
        "figure_id", F.when(F.col("figure_id") % 3 == 0, "bar").otherwise("sketch").alias("figure_type"), F.lit("read").alias("reading"),
        F.lit(0.5).alias("confidence"), F.array(F.struct(F.lit("total").alias("label"), "value", F.lit("usd").alias("unit"))).alias("values"),
    )
    return G.gate_readings(raw, V.v_figures(t))
