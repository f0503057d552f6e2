"""Driver tables shaped into library inputs, in Spark and in SQL with the same rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from checks.base import Tables, view

LATER = 1_000_000_000  # arrival offset of repeated rows


def pmid(col: Column) -> Column:
    return F.concat(F.lit("PMID:"), col.cast("string"))


@view("""
    SELECT 'PMID:' || doc_id AS id, 'publication' AS kind, 'Europe PMC' AS source, substr(text, 1, 80) AS title,
           'cited ' || n_chars || 'x' AS snippet, text AS passage, NULL::VARCHAR AS locator,
           'https://example.org/' || doc_id AS url,
           CASE WHEN doc_id % 3 = 0 THEN 'PMC' || doc_id ELSE '' END AS pmcid,
           doc_id % 4 <> 0 AS is_open_access, doc_id % 5 = 0 AS is_review, n_chars AS cited_by,
           source AS last_author, lang AS affiliation, doc_id, doc_id AS ord
    FROM documents
    UNION ALL
    SELECT 'PMCID:PMC' || doc_id || '#sec-0', 'publication', 'PMC full text', 'Section 1', 'Section 1', text, 'Section 1',
           'https://example.org/pmc/' || doc_id || '#sec-0', 'PMC' || doc_id, TRUE, FALSE, 0, NULL, NULL, doc_id,
           2000000000 + doc_id
    FROM documents WHERE doc_id % 6 = 0
    UNION ALL
    SELECT 'PMID:' || doc_id, 'publication', 'Europe PMC', 'Changed ' || substr(text, 1, 80), 'cited ' || n_chars || 'x', text,
           NULL, 'https://example.org/' || doc_id, CASE WHEN doc_id % 3 = 0 THEN 'PMC' || doc_id ELSE '' END,
           doc_id % 4 <> 0, doc_id % 5 = 0, n_chars, source, lang, doc_id, 1000000000 + doc_id
    FROM documents WHERE doc_id % 10 = 0
""")
def v_evidence(t: Tables) -> DataFrame:
    # One scan: each document yields its paper, its full text section and its repeat.
    key = F.col("doc_id")
    parts = F.array_compact(F.array(F.lit(0), F.when(key % 6 == 0, 1), F.when(key % 10 == 0, 2)))
    docs = t.text("documents").select("*", F.explode(parts).alias("part"))
    full = F.col("part") == 1
    name = key.cast("string")
    pmc = F.concat(F.lit("PMC"), name)
    head = F.substring("text", 1, 80)
    own = lambda column: F.when(~full, column)
    return docs.select(
        F.when(full, F.concat(F.lit("PMCID:"), pmc, F.lit("#sec-0"))).otherwise(pmid(key)).alias("id"),
        F.lit("publication").alias("kind"),
        F.when(full, "PMC full text").otherwise("Europe PMC").alias("source"),
        F.when(full, "Section 1").when(F.col("part") == 2, F.concat(F.lit("Changed "), head)).otherwise(head).alias("title"),
        F.when(full, "Section 1").otherwise(F.concat(F.lit("cited "), F.col("n_chars").cast("string"), F.lit("x"))).alias("snippet"),
        F.col("text").alias("passage"),
        F.when(full, "Section 1").alias("locator"),
        F.when(full, F.concat(F.lit("https://example.org/pmc/"), name, F.lit("#sec-0")))
        .otherwise(F.concat(F.lit("https://example.org/"), name)).alias("url"),
        F.when(full | (key % 3 == 0), pmc).otherwise("").alias("pmcid"),
        (full | (key % 4 != 0)).alias("is_open_access"),
        (~full & (key % 5 == 0)).alias("is_review"),
        F.when(full, F.lit(0)).otherwise(F.col("n_chars")).cast("bigint").alias("cited_by"),
        own(F.col("source")).alias("last_author"),
        own(F.col("lang")).alias("affiliation"),
        "doc_id",
        (key + F.when(full, 2 * LATER).when(F.col("part") == 2, LATER).otherwise(0)).alias("ord"),
    )


@view("SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS rn FROM v_evidence) WHERE rn = 1")
def v_store(t: Tables) -> DataFrame:
    from attestra.operators.store import register

    return register(v_evidence(t))


@view("""
    SELECT conv_id % 6 AS section_id, conv_id * 100 + turn AS ord, conv_id % 8 AS run_id, conv_id, turn, text,
           CASE WHEN turn = 3 THEN []::VARCHAR[]
                ELSE ['PMID:' || ((conv_id * 131 + turn * 17) % (SELECT count(*) + count(*) // 5 FROM documents)),
                      'PMID:' || ((conv_id * 131 + turn * 34) % (SELECT count(*) + count(*) // 5 FROM documents))] END AS citations,
           (conv_id % 15) / 10.0 AS confidence
    FROM conversations WHERE role = 'assistant'
""")
def v_claims(t: Tables) -> DataFrame:
    n = t.rows("documents")
    span = n + n // 5
    conv, turn = F.col("conv_id"), F.col("turn")
    cite = lambda k: pmid((conv * 131 + turn * k * 17) % span)
    return t["conversations"].where(F.col("role") == "assistant").select(
        (conv % 6).alias("section_id"),
        (conv * 100 + turn).alias("ord"),
        (conv % 8).alias("run_id"),
        "conv_id",
        "turn",
        "text",
        F.when(turn == 3, F.array().cast("array<string>")).otherwise(F.array(cite(1), cite(2))).alias("citations"),
        ((conv % 15) / 10).alias("confidence"),
    )


@view("""
    SELECT section_id, ord, CASE (conv_id + turn) % 5 WHEN 0 THEN 'unsupported' WHEN 1 THEN 'overreach' ELSE 'supported' END AS status
    FROM v_claims
""")
def v_verdicts(t: Tables) -> DataFrame:
    mark = (F.col("conv_id") + F.col("turn")) % 5
    return v_claims(t).select(
        "section_id", "ord",
        F.when(mark == 0, "unsupported").when(mark == 1, "overreach").otherwise("supported").alias("status"),
    )


@view("""
    SELECT * FROM v_claims c WHERE len(citations) > 0
      AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(c.citations) AS id) x WHERE x.id NOT IN (SELECT id FROM v_evidence))
""")
def v_shipped(t: Tables) -> DataFrame:
    from attestra.operators.claims import ground

    return ground(v_claims(t), v_evidence(t))[0]


@view("""
    SELECT doc_id * 1000000 + i AS ord, source AS section_id, trim(line) AS text, (doc_id % 10) / 10.0 AS confidence,
           CASE WHEN doc_id % 7 = 0 THEN []::VARCHAR[] WHEN doc_id % 3 = 0 THEN [source, coalesce(lang, 'und')] ELSE [source] END AS citations
    FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
""")
def v_dup_claims(t: Tables) -> DataFrame:
    """Every line of every document as a claim."""
    lines = t.text("documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    both = F.array("source", F.coalesce("lang", F.lit("und")))
    return lines.select(
        (F.col("doc_id") * 1000000 + F.col("i") + 1).alias("ord"),
        F.col("source").alias("section_id"),
        F.trim("line").alias("text"),
        F.when(F.col("doc_id") % 7 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 3 == 0, both).otherwise(F.array("source")).alias("citations"),
        ((F.col("doc_id") % 10) / 10).alias("confidence"),
    )


SUFFIXES = ["#localization", "#domains", "#expression", "#tractability", "#safety"]


@view("""
    SELECT 'T' || p_partkey || ['#localization', '#domains', '#expression', '#tractability', '#safety'][p_size % 5 + 1] AS id,
           'target' AS kind, CASE p_partkey % 3 WHEN 0 THEN 'Open Targets' WHEN 1 THEN 'UniProt' ELSE 'Other' END AS source,
           p_name AS title, CASE WHEN p_partkey % 7 = 0 THEN '  ' ELSE p_name || ' ' || p_brand END AS snippet,
           NULL::VARCHAR AS passage, NULL::VARCHAR AS locator, p_partkey % 8 AS run_id, p_partkey AS ord
    FROM part
""")
def v_cards(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    suffix = F.get(F.array(*[F.lit(s) for s in SUFFIXES]), F.col("p_size") % 5)
    return t["part"].select(
        F.concat(F.lit("T"), key.cast("string"), suffix).alias("id"),
        F.lit("target").alias("kind"),
        F.when(key % 3 == 0, "Open Targets").when(key % 3 == 1, "UniProt").otherwise("Other").alias("source"),
        F.col("p_name").alias("title"),
        F.when(key % 7 == 0, "  ").otherwise(F.concat("p_name", F.lit(" "), "p_brand")).alias("snippet"),
        F.lit(None).cast("string").alias("passage"),
        F.lit(None).cast("string").alias("locator"),
        (key % 8).alias("run_id"),
        key.alias("ord"),
    )


DESIGNS = ["randomized_controlled", "single_arm", "observational", "post_hoc", "preclinical_nhp", "in_vitro"]


@view("""
    SELECT d.doc_id, 'PMID:' || d.doc_id AS evidence_id, d.doc_id % 6 AS section_id, d.doc_id AS ord,
           ['randomized_controlled', 'single_arm', 'observational', 'post_hoc', 'preclinical_nhp', 'in_vitro'][d.doc_id % 6 + 1] AS study_design,
           CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE n_chars % 200 END AS sample_size, toxic, d.doc_id % 4 AS moderate
    FROM labels JOIN documents d USING (doc_id)
""")
def v_critiques(t: Tables) -> DataFrame:
    key = F.col("doc_id")
    flag = lambda risk, i: F.struct(
        F.lit("unblinded").alias("category"), F.lit(risk).alias("bias_risk"),
        F.concat(F.lit("note "), i.cast("string")).alias("explanation"),
    )
    moderate = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.when(i <= key % 4, flag("moderate", i)))
    high = F.when(F.col("toxic") == 1, flag("high", F.lit(0)))
    return t["labels"].join(t["documents"].select("doc_id", "n_chars"), "doc_id").select(
        "doc_id",
        pmid(key).alias("evidence_id"),
        (key % 6).alias("section_id"),
        key.alias("ord"),
        F.get(F.array(*[F.lit(d) for d in DESIGNS]), (key % 6).cast("int")).alias("study_design"),
        F.when(key % 11 != 0, F.col("n_chars") % 200).alias("sample_size"),
        "toxic",
        (key % 4).alias("moderate"),
        F.array_compact(F.concat(F.array(high), moderate)).alias("red_flags"),
    )


@view("""
    SELECT 'PMID:' || (doc_id + CASE WHEN doc_id % 2 = 1 THEN 1000000000 ELSE 0 END) AS evidence_id, doc_id % 8 AS run_id, doc_id AS ord,
           ['manageable', 'significant', 'severe'][doc_id % 3 + 1] AS severity,
           ['immunogenicity', 'half_life', 'dosing'][doc_id % 5 % 3 + 1] AS category
    FROM labels WHERE toxic = 1
""")
def v_risks(t: Tables) -> DataFrame:
    key = F.col("doc_id")
    pick = lambda names, i: F.get(F.array(*[F.lit(n) for n in names]), i.cast("int"))
    return t["labels"].where("toxic = 1").select(
        pmid(key + F.when(key % 2 == 1, LATER).otherwise(0)).alias("evidence_id"),
        (key % 8).alias("run_id"),
        key.alias("ord"),
        pick(["manageable", "significant", "severe"], key % 3).alias("severity"),
        pick(["immunogenicity", "half_life", "dosing"], key % 5 % 3).alias("category"),
    )


@view("""
    SELECT doc_id AS ord, 'PMID:' || doc_id AS id_a, 'PMID:' || (doc_id + toxic * 1000000000) AS id_b FROM labels
    UNION ALL SELECT doc_id + 1000000000, 'PMID:' || doc_id, 'PMID:' || ((doc_id + 1) % (SELECT count(*) FROM documents)) FROM labels
""")
def v_contra(t: Tables) -> DataFrame:
    n = t.rows("documents")
    key = F.col("doc_id")
    one = t["labels"].select(key.alias("ord"), pmid(key).alias("id_a"), pmid(key + F.col("toxic") * F.lit(LATER).cast("bigint")).alias("id_b"))
    two = t["labels"].select((key + LATER).alias("ord"), pmid(key).alias("id_a"), pmid((key + 1) % n).alias("id_b"))
    return one.unionByName(two)


@view("""
    SELECT 'PMID:' || doc_id AS id, text AS title, 'J' || doc_id % 9 AS journal, '2001' AS year,
           CASE WHEN doc_id % 9 = 0 THEN NULL ELSE '10.1/' || doc_id END AS doi, doc_id, doc_id AS ord
    FROM documents
""")
def v_with_doi(t: Tables) -> DataFrame:
    key = F.col("doc_id")
    return t["documents"].select(
        pmid(key).alias("id"), F.col("text").alias("title"),
        F.concat(F.lit("J"), (key % 9).cast("string")).alias("journal"), F.lit("2001").alias("year"),
        F.when(key % 9 != 0, F.concat(F.lit("10.1/"), key.cast("string"))).alias("doi"), "doc_id", key.alias("ord"),
    )


@view("""
    SELECT '10.1/' || doc_id AS doi,
           CASE WHEN doc_id % 4 = 0 THEN 'Another paper ' || doc_id WHEN doc_id % 4 = 1 THEN '*** ' || text
                ELSE text || ' (reprint)' END AS reg_title,
           CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'R' || doc_id % 3 END AS reg_journal, '20' || (10 + doc_id % 10) AS reg_year
    FROM documents WHERE doc_id % 7 <> 0
""")
def v_registry(t: Tables) -> DataFrame:
    key = F.col("doc_id")
    return t["documents"].where(key % 7 != 0).select(
        F.concat(F.lit("10.1/"), key.cast("string")).alias("doi"),
        F.when(key % 4 == 0, F.concat(F.lit("Another paper "), key.cast("string")))
        .when(key % 4 == 1, F.concat(F.lit("*** "), F.col("text")))
        .otherwise(F.concat(F.col("text"), F.lit(" (reprint)"))).alias("reg_title"),
        F.when(key % 5 != 0, F.concat(F.lit("R"), (key % 3).cast("string"))).alias("reg_journal"),
        F.concat(F.lit("20"), (10 + key % 10).cast("string")).alias("reg_year"),
    )


@view("""
    SELECT 'PMID:' || o_custkey AS cited, 'PMID:' || (o_orderkey % (SELECT count(*) FROM documents)) AS citing,
           o_orderpriority || ' ' || o_orderkey AS title, CAST(round(o_totalprice * 100) AS BIGINT) AS cited_by, o_orderkey AS ord
    FROM orders
""")
def v_edges(t: Tables) -> DataFrame:
    n = t.rows("documents")
    return t["orders"].select(
        pmid(F.col("o_custkey")).alias("cited"), pmid(F.col("o_orderkey") % n).alias("citing"),
        F.concat("o_orderpriority", F.lit(" "), F.col("o_orderkey").cast("string")).alias("title"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cited_by"), F.col("o_orderkey").alias("ord"),
    )


@view("SELECT vec_id, vec_id // 50 AS query_id, 'V' || vec_id AS id, embedding AS vector FROM embeddings")
def v_vec(t: Tables) -> DataFrame:
    return t["embeddings"].select(
        "vec_id", F.expr("vec_id div 50").alias("query_id"), F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("id"),
        F.col("embedding").alias("vector"),
    )


@view("""
    SELECT doc_id // 200 AS query_id, list_no, CAST(row_number() OVER (PARTITION BY doc_id // 200, list_no ORDER BY k, doc_id) - 1 AS BIGINT) AS idx,
           'PMID:' || (doc_id // 2) AS id
    FROM (SELECT doc_id, 0 AS list_no, -n_chars AS k FROM documents UNION ALL SELECT doc_id, 1, doc_id FROM documents
          UNION ALL SELECT doc_id, 2, n_chars % 97 FROM documents WHERE doc_id % 3 = 0)
""")
def v_lists(t: Tables) -> DataFrame:
    docs = t["documents"]
    parts = [
        docs.select("doc_id", F.lit(0).alias("list_no"), (-F.col("n_chars")).alias("k")),
        docs.select("doc_id", F.lit(1).alias("list_no"), F.col("doc_id").alias("k")),
        docs.where("doc_id % 3 = 0").select("doc_id", F.lit(2).alias("list_no"), (F.col("n_chars") % 97).alias("k")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("query_id", F.expr("doc_id div 200"))
    w = Window.partitionBy("query_id", "list_no").orderBy("k", "doc_id")
    return every.select(
        "query_id", "list_no", (F.row_number().over(w) - 1).cast("bigint").alias("idx"), pmid(F.floor(F.col("doc_id") / 2)).alias("id")
    )


@view("""
    SELECT item_id AS query_id, list_extract(w, 1) AS target, CASE WHEN item_id % 4 = 3 THEN '' ELSE list_extract(w, 2) END AS concept
    FROM (SELECT item_id, list_filter(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '),
                                      lambda x: length(x) >= 6) AS w FROM benchmark)
    WHERE len(w) >= 2
""")
def v_pinned(t: Tables) -> DataFrame:
    from attestra.functions.text import title_key

    words = F.filter(F.split(title_key(F.col("text")), " "), lambda w: F.length(w) >= 6)
    rows = t["benchmark"].select("item_id", words.alias("w")).where(F.size("w") >= 2)
    return rows.select(
        F.col("item_id").alias("query_id"), F.get("w", F.lit(0)).alias("target"),
        F.when(F.col("item_id") % 4 == 3, "").otherwise(F.get("w", F.lit(1))).alias("concept"),
    )


@view("""
    SELECT l_orderkey, l_linenumber, l_returnflag AS grp, l_linestatus AS cls,
           CASE WHEN l_linenumber = 6 THEN NULL ELSE l_extendedprice END AS measure,
           CASE WHEN l_linenumber = 6 THEN ' ' WHEN l_linenumber = 7 AND l_orderkey % 100 = 0 THEN 'n/a'
                WHEN l_linenumber = 7 AND l_orderkey % 100 = 1 THEN 'NaN' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS measure_text
    FROM lineitem
""")
def v_measure(t: Tables) -> DataFrame:
    last = F.col("l_linenumber") == 7
    key = F.col("l_orderkey") % 100
    return t["lineitem"].select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("grp"), F.col("l_linestatus").alias("cls"),
        F.when(F.col("l_linenumber") != 6, F.col("l_extendedprice")).alias("measure"),
        F.when(F.col("l_linenumber") == 6, " ").when(last & (key == 0), "n/a").when(last & (key == 1), "NaN")
        .otherwise(F.col("l_quantity").cast("bigint").cast("string")).alias("measure_text"),
    )


@view("""
    SELECT user_id AS member, event_type, CASE event_type WHEN 'purchase' THEN 'PG25' WHEN 'error' THEN 'WD' WHEN 'view' THEN 'MK9A' ELSE 'XX' END AS code,
           CASE WHEN event_id % 13 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS date, event_id AS ord
    FROM events
""")
def v_legal(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return t["events"].select(
        F.col("user_id").alias("member"), "event_type",
        F.when(kind == "purchase", "PG25").when(kind == "error", "WD").when(kind == "view", "MK9A").otherwise("XX").alias("code"),
        F.when(F.col("event_id") % 13 != 0, F.date_format("ts", "yyyy-MM-dd")).alias("date"),
        F.col("event_id").alias("ord"),
    )


@view("""
    SELECT l_suppkey % 50 AS doc_id, l_suppkey AS seq_id, 'A' || l_partkey AS accession, CAST(l_quantity AS BIGINT) * 4 AS align_len,
           CAST(l_quantity AS BIGINT) * 4 - l_linenumber % 3 AS identity, 1 AS query_from,
           CAST(l_quantity AS BIGINT) * 4 + l_linenumber % 2 - l_linenumber % 5 AS query_to,
           CAST(l_quantity AS BIGINT) * 4 AS query_len, l_orderkey * 10 + l_linenumber AS ord
    FROM lineitem
""")
def v_raw_hits(t: Tables) -> DataFrame:
    n = F.col("l_quantity").cast("bigint") * 4
    line = F.col("l_linenumber")
    return t["lineitem"].select(
        (F.col("l_suppkey") % 50).alias("doc_id"), F.col("l_suppkey").alias("seq_id"),
        F.concat(F.lit("A"), F.col("l_partkey").cast("string")).alias("accession"), n.alias("align_len"),
        (n - line % 3).alias("identity"), F.lit(1).alias("query_from"), (n + line % 2 - line % 5).alias("query_to"),
        n.alias("query_len"), (F.col("l_orderkey") * 10 + line).alias("ord"),
    )


@view("""
    SELECT *, CASE WHEN align_len = 0 THEN 0 ELSE floor(identity / align_len * 100 * 10 + 0.5) / 10 END AS percent_identity,
           CASE WHEN query_len = 0 THEN 0 ELSE floor((query_to - query_from + 1) / query_len * 100 * 10 + 0.5) / 10 END AS query_coverage,
           greatest(0, align_len - identity) AS mismatch_count
    FROM v_raw_hits
""")
def v_hits(t: Tables) -> DataFrame:
    from attestra.operators.patents import norm_hits, score_hits

    return norm_hits(score_hits(v_raw_hits(t)))


@view("""
    SELECT s_suppkey % 50 AS doc_id, s_suppkey AS seq_id, s_suppkey * 7 % 90 + 10 AS length,
           CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN s_suppkey * 7 % 90 + 10 ELSE s_suppkey * 7 % 90 + 11 END AS declared_length
    FROM supplier
""")
def v_seqs(t: Tables) -> DataFrame:
    key = F.col("s_suppkey")
    size = key * 7 % 90 + 10
    return t["supplier"].select(
        (key % 50).alias("doc_id"), key.alias("seq_id"), size.alias("length"),
        F.when(key % 3 == 1, size).when(key % 3 == 2, size + 1).alias("declared_length"),
    )


@view("SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS seq_id, l_returnflag AS region_label, l_partkey AS pos, l_linestatus FROM lineitem")
def v_seq_ids(t: Tables) -> DataFrame:
    return t["lineitem"].select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("bigint").alias("seq_id"),
        F.col("l_returnflag").alias("region_label"), F.col("l_partkey").alias("pos"), "l_linestatus",
    )


@view("""
    SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders
""")
def v_cents(t: Tables) -> DataFrame:
    return t["orders"].withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))


@view("""
    SELECT o_orderkey AS figure_id, 'total ' || cents // 100 || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') || ' of all' AS caption
    FROM v_cents WHERE o_orderkey % 7 <> 0
""")
def v_figures(t: Tables) -> DataFrame:
    return v_cents(t).where("o_orderkey % 7 <> 0").select(
        F.col("o_orderkey").alias("figure_id"),
        F.concat(F.lit("total "), F.expr("cents div 100").cast("string"), F.lit("."),
                 F.lpad((F.col("cents") % 100).cast("string"), 2, "0"), F.lit(" of all")).alias("caption"),
    )


@view("""
    SELECT o_orderkey AS figure_id,
           CASE WHEN o_orderkey % 5 = 0 THEN CAST((cents + 1) // 100 AS VARCHAR) || '.' || lpad(CAST((cents + 1) % 100 AS VARCHAR), 2, '0')
                WHEN o_orderkey % 5 = 1 THEN ' ' || CAST(cents // 100 AS VARCHAR) || '·' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') || '0'
                WHEN o_orderkey % 11 = 0 THEN '  '
                ELSE CAST(cents // 100 AS VARCHAR) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') END AS value
    FROM v_cents
""")
def v_values(t: Tables) -> DataFrame:
    key, cents = F.col("o_orderkey"), F.col("cents")
    spell = lambda c, dot: F.concat(F.floor(c / 100).cast("string"), F.lit(dot), F.lpad((c % 100).cast("string"), 2, "0"))
    return v_cents(t).select(
        key.alias("figure_id"),
        F.when(key % 5 == 0, spell(cents + 1, "."))
        .when(key % 5 == 1, F.concat(F.lit(" "), spell(cents, "·"), F.lit("0")))
        .when(key % 11 == 0, "  ")
        .otherwise(spell(cents, ".")).alias("value"),
    )


@view("""
    SELECT conv_id % 8 AS target, conv_id, turn, conv_id * 10 + turn AS repeat,
           ['go', 'watch', 'no-go', 'insufficient-evidence'][conv_id * turn % 4 + 1] AS verdict, length(text) AS elapsed_ms
    FROM conversations
""")
def v_runs(t: Tables) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    names = F.array(*[F.lit(v) for v in ("go", "watch", "no-go", "insufficient-evidence")])
    return t["conversations"].select(
        (conv % 8).alias("target"), "conv_id", "turn", (conv * 10 + turn).alias("repeat"),
        F.get(names, (conv * turn % 4).cast("int")).alias("verdict"), F.length("text").cast("bigint").alias("elapsed_ms"),
    )


@view("""
    SELECT doc_id, doc_id % 8 AS target, CASE WHEN quality = 1 THEN 'supported' WHEN doc_id % 2 = 0 THEN 'refuted' ELSE 'unsupported' END AS expected,
           CASE WHEN toxic = 1 THEN 'refuted' WHEN doc_id % 4 = 0 THEN 'unsupported' WHEN doc_id % 4 = 1 THEN 'overreach' ELSE 'supported' END AS grounded,
           ['supported', 'refuted', 'unsupported'][doc_id % 3 + 1] AS closed
    FROM labels
""")
def v_probes(t: Tables) -> DataFrame:
    key = F.col("doc_id")
    return t["labels"].select(
        "doc_id", (key % 8).alias("target"),
        F.when(F.col("quality") == 1, "supported").when(key % 2 == 0, "refuted").otherwise("unsupported").alias("expected"),
        F.when(F.col("toxic") == 1, "refuted").when(key % 4 == 0, "unsupported").when(key % 4 == 1, "overreach")
        .otherwise("supported").alias("grounded"),
        F.get(F.array(F.lit("supported"), F.lit("refuted"), F.lit("unsupported")), (key % 3).cast("int")).alias("closed"),
    )


SCORE_NAMES = ["grounding_integrity", "faithfulness", "retrieval_recall", "figure_grounding", "computation_grounding"]


@view("""
    SELECT doc_id % 8 AS target, ['grounding_integrity', 'faithfulness', 'retrieval_recall', 'figure_grounding', 'computation_grounding'][doc_id % 5 + 1] AS name,
           CAST(CASE WHEN doc_id % 2 = 0 THEN quality ELSE 1 - toxic END AS DOUBLE) AS score,
           (CASE WHEN doc_id % 2 = 0 THEN quality ELSE 1 - toxic END) = 1 AS pass
    FROM labels
""")
def v_scores(t: Tables) -> DataFrame:
    key = F.col("doc_id")
    score = F.when(key % 2 == 0, F.col("quality")).otherwise(1 - F.col("toxic")).cast("double")
    return t["labels"].select(
        (key % 8).alias("target"), F.get(F.array(*[F.lit(n) for n in SCORE_NAMES]), (key % 5).cast("int")).alias("name"),
        score.alias("score"), (score == 1).alias("pass"),
    )
