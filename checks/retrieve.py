"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.operators import nearest as N
from attestra.operators import retrieve as R
from attestra.plans import hybrid as H
from checks import views as V
from checks.base import Tables, check

TERMS = ["tion", "der", "thanx", "ouch"]
TERM_SQL = "(contains({c}, 'tion') OR contains({c}, 'der') OR contains({c}, 'thanx') OR contains({c}, 'ouch'))"
GATE = TERM_SQL.format(c="lower(title || ' ' || coalesce(passage, '') || ' ' || snippet)")
TITLE = TERM_SQL.format(c="lower(title)")


@check("""
    WITH g AS (SELECT l_returnflag || l_shipmonth AS target, * FROM (SELECT *, CAST(month(l_shipdate) AS VARCHAR) AS l_shipmonth FROM lineitem)),
    r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM g)
    SELECT target, l_orderkey, l_linenumber, l_extendedprice, rank FROM r WHERE rank <= 8
""")
def topk_per_group(t: Tables) -> DataFrame:
    rows = t["lineitem"].withColumn("target", F.concat("l_returnflag", F.month("l_shipdate").cast("string")))
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return R.top_n(rows, ["target"], order, 8).select("target", "l_orderkey", "l_linenumber", "l_extendedprice", "rank")


@check(f"SELECT id, ord FROM v_store WHERE {GATE}")
def relevance_gate(t: Tables) -> DataFrame:
    return R.relevance_gate(V.v_store(t), TERMS).select("id", "ord")


@check("""
    SELECT DISTINCT s.id, p.query_id AS target FROM v_store s JOIN (SELECT query_id, target AS term FROM v_pinned UNION ALL SELECT query_id, concept FROM v_pinned WHERE concept <> '') p
    ON contains(lower(s.title || ' ' || coalesce(s.passage, '') || ' ' || s.snippet), p.term)
""")
def relevance_gate_many(t: Tables) -> DataFrame:
    pins = V.v_pinned(t)
    terms = pins.select(F.col("query_id").alias("target"), F.col("target").alias("term")).unionByName(
        pins.where("concept <> ''").select(F.col("query_id").alias("target"), F.col("concept").alias("term"))
    )
    return R.relevance_gate_many(V.v_store(t), terms).select("id", "target")


@check(f"SELECT id, ord FROM (SELECT id, ord, title || ' ' || coalesce(passage, '') AS title FROM v_store) WHERE {TITLE}")
def title_gate(t: Tables) -> DataFrame:
    whole = V.v_store(t).withColumn("title", F.concat("title", F.lit(" "), F.coalesce("passage", F.lit(""))))
    return R.title_gate(whole, TERMS).select("id", "ord")


FOUND = """
    words AS (SELECT *, ' ' || trim(regexp_replace(lower(concat_ws(' ', title, passage)), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' AS tx,
              ' ' || trim(regexp_replace(lower(concat_ws(' ', title, passage, snippet)), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' AS ax FROM v_store),
    found AS (SELECT q.query_id, w.* FROM v_pinned q JOIN words w ON contains(w.tx, ' ' || q.target || ' ')
              AND (q.concept = '' OR contains(w.ax, ' ' || q.concept || ' ')))
"""


@check("WITH " + FOUND + "SELECT query_id, id, ord FROM found")
def pinned_search(t: Tables) -> DataFrame:
    return R.pinned_search(V.v_store(t), V.v_pinned(t)).select("query_id", "id", "ord")


@check("WITH " + FOUND + """
    SELECT query_id, id, cited_by, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cited_by DESC, ord) AS rank FROM found) WHERE rank <= 8
""")
def top_cited(t: Tables) -> DataFrame:
    hits = R.pinned_search(V.v_store(t), V.v_pinned(t))
    return R.top_cited(hits).select("query_id", "id", "cited_by", "rank")


CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace({x}, '(?i)\\b(?:AND|OR|NOT)\\b', ' ', 'g'), '[\"''()\\[\\]{{}}:]', ' ', 'g'), '\\s+', ' ', 'g'))"


@check("""
    WITH base AS (SELECT query_id, target, concept AS facet FROM v_pinned),
    alias AS (SELECT query_id, """ + CLEAN.format(x="'(' || upper(target) || 'x) NOT'") + """ AS target, facet FROM base WHERE query_id % 3 = 0),
    prop AS (SELECT query_id, """ + CLEAN.format(x="CASE WHEN i % 2 = 0 THEN '\"' || target || '\"' ELSE 'alt' || i END") + """ AS target,
             """ + CLEAN.format(x="CASE WHEN i = 2 THEN upper(facet) ELSE 'idea ' || i || ' AND more' END") + """ AS facet, i
             FROM base, (SELECT unnest([1, 2, 3, 4, 5]) AS i)),
    every AS (SELECT query_id, target, facet, 0 AS rk, 0 AS o FROM base UNION ALL SELECT query_id, target, facet, 1, 0 FROM alias
              UNION ALL SELECT query_id, target, facet, 2, i FROM prop),
    uniq AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(target), lower(facet) ORDER BY rk, o) AS dup FROM every)
    SELECT query_id, target, facet AS concept, variant FROM
        (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rk, o) AS variant FROM uniq WHERE dup = 1) WHERE variant <= 4
""")
def query_variants(t: Tables) -> DataFrame:
    base = V.v_pinned(t)
    messy = base.withColumn("concept", F.concat(F.lit("(\""), "concept", F.lit("\") AND "), "target"))
    aliases = base.where("query_id % 3 = 0").select(
        "query_id", F.concat(F.lit("("), F.upper("target"), F.lit("x) NOT")).alias("alias"), F.lit(1).alias("ord")
    )
    i = F.col("i")
    proposed = base.select("query_id", "target", "concept", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("i")).select(
        "query_id",
        F.when(i % 2 == 0, F.concat(F.lit('"'), "target", F.lit('"'))).otherwise(F.concat(F.lit("alt"), i.cast("string"))).alias("target"),
        F.when(i == 2, F.upper("concept")).otherwise(F.concat(F.lit("idea "), i.cast("string"), F.lit(" AND more"))).alias("concept"),
        i.alias("ord"),
    )
    return R.query_variants(messy, aliases, proposed)


RRF_SQL = """
    per AS (SELECT query_id, list_no, id, min(idx) AS idx FROM v_lists GROUP BY 1, 2, 3),
    s AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + idx + 1)) AS score, min(list_no * 1000000 + idx) AS f FROM per GROUP BY 1, 2)
"""


@check("WITH " + RRF_SQL + """
    SELECT query_id, id, round(score, 9) AS score, rank FROM
        (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, f) AS rank FROM s) WHERE rank <= 50
""")
def rrf(t: Tables) -> DataFrame:
    fused = R.rrf(V.v_lists(t), limit=50)
    return fused.select("query_id", "id", F.round("score", 9).alias("score"), "rank")


COSINE = """CASE WHEN len({a}) <> len({b}) OR list_inner_product({a}::DOUBLE[], {a}::DOUBLE[]) = 0 OR list_inner_product({b}::DOUBLE[], {b}::DOUBLE[]) = 0 THEN 0
    ELSE list_inner_product({a}::DOUBLE[], {b}::DOUBLE[]) / sqrt(list_inner_product({a}::DOUBLE[], {a}::DOUBLE[]) * list_inner_product({b}::DOUBLE[], {b}::DOUBLE[])) END"""


@check("""
    WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, """ + COSINE.format(a="q.embedding", b="e.embedding") + """ AS sim
               FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q)
    SELECT query_id, vec_id, round(sim, 6) AS similarity, CAST(rank AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, vec_id) AS rank FROM s) WHERE rank <= 50
""")
def cosine_topk(t: Tables) -> DataFrame:
    """The 50 nearest of all vectors for every vector whose id is divisible by 100."""
    vectors = t["embeddings"].select("vec_id", F.col("embedding").alias("vector"))
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    return N.top_k(queries, vectors, 50, key="vec_id").select("query_id", "vec_id", F.round("value", 6).alias("similarity"), "rank")


@check("""
    SELECT vec_id, vec_id % 10 <> 0 AND vec_id % 11 <> 0 AS valid FROM embeddings
""")
def valid_vectors(t: Tables) -> DataFrame:
    broken = F.transform("vector", lambda v, i: F.when(i == 3, F.lit(float("nan")).cast("float")).otherwise(v))
    rows = V.v_vec(t).withColumn(
        "vector",
        F.when(F.col("vec_id") % 10 == 0, F.array().cast("array<float>")).when(F.col("vec_id") % 11 == 0, broken).otherwise(F.col("vector")),
    )
    good, bad = R.split_vectors(rows)
    return good.select("vec_id", F.lit(True).alias("valid")).unionByName(bad.select("vec_id", F.lit(False).alias("valid")))


@check("""
    WITH q AS (SELECT query_id, vector AS q FROM v_vec WHERE vec_id % 50 = 0),
    s AS (SELECT v.query_id, v.id, v.vec_id % 50 + 1 AS rank, """ + COSINE.format(a="q", b="vector") + """ AS sim FROM v_vec v JOIN q USING (query_id))
    SELECT query_id, id, rank, round(sim, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, rank) AS dense_rank FROM s
""")
def dense_pool(t: Tables) -> DataFrame:
    vecs = V.v_vec(t)
    pool = vecs.select("query_id", "id", (F.col("vec_id") % 50 + 1).alias("rank"))
    queries = vecs.where("vec_id % 50 = 0").select("query_id", "vector")
    ranked = R.dense_rank_pool(pool, queries, vecs.select("id", "vector"))
    return ranked.select("query_id", "id", "rank", F.round("similarity", 6).alias("similarity"), "dense_rank")


@check("""
    WITH h AS (SELECT query_id, id, vec_id % 50 + 1 AS rank FROM v_vec),
    s AS (SELECT query_id, rank - 1 AS i, CASE WHEN rank % 7 = 1 THEN 'NaN'::DOUBLE ELSE ((rank * 13 + query_id) % 20) / 4.0 END AS score FROM h WHERE rank % 3 <> 0
          UNION ALL SELECT query_id, 5000, 99.0 FROM h WHERE rank = 1 UNION ALL SELECT query_id, 1, 0.1 FROM h WHERE rank = 1),
    b AS (SELECT query_id, i, max(score) AS score FROM s WHERE NOT isnan(score) GROUP BY 1, 2)
    SELECT h.query_id, h.id, h.rank, b.score, row_number() OVER (PARTITION BY h.query_id ORDER BY b.score IS NULL, b.score DESC, h.rank) AS rerank
    FROM h LEFT JOIN b ON b.query_id = h.query_id AND b.i = h.rank - 1
""")
def rerank_merge(t: Tables) -> DataFrame:
    hits = V.v_vec(t).select("query_id", "id", (F.col("vec_id") % 50 + 1).alias("rank"))
    rank = F.col("rank")
    score = F.when(rank % 7 == 1, F.lit(float("nan"))).otherwise(((rank * 13 + F.col("query_id")) % 20) / 4)
    one = hits.where(rank % 3 != 0).select("query_id", (rank - 1).cast("double").alias("index"), score.alias("score"), rank.alias("ord"))
    first = hits.where(rank == 1)
    out = first.select("query_id", F.lit(5000.0).alias("index"), F.lit(99.0).alias("score"), F.lit(900).cast("bigint").alias("ord"))
    again = first.select("query_id", F.lit(1.0).alias("index"), F.lit(0.1).alias("score"), F.lit(901).cast("bigint").alias("ord"))
    half = first.select("query_id", F.lit(1.5).alias("index"), F.lit(99.0).alias("score"), F.lit(902).cast("bigint").alias("ord"))
    return R.apply_rerank(hits, one.unionByName(out).unionByName(again).unionByName(half))


PAGE = """
    page AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cited_by DESC, ord) AS rank FROM found),
    top AS (SELECT * FROM page WHERE rank <= 25)
"""
NAMED = "contains(lower(title), 'a')"


@check("WITH " + FOUND + "," + PAGE + f"""
    SELECT query_id, id, pmcid, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rn FROM top
        WHERE pmcid <> '' AND is_open_access AND {NAMED}) WHERE rn = 1
""")
def deep_read_pick(t: Tables) -> DataFrame:
    hits = R.top_cited(R.pinned_search(V.v_store(t), V.v_pinned(t)), 25)
    return R.pick_deep_read(hits, R.mentions_any(F.lower("title"), ["a"]))


@check("WITH " + FOUND + "," + PAGE + f""",
    pick AS (SELECT query_id, pmcid FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rn FROM top
        WHERE pmcid <> '' AND is_open_access AND {NAMED}) WHERE rn = 1),
    term AS (SELECT query_id, target AS term FROM v_pinned WHERE query_id % 3 <> 0 UNION ALL SELECT query_id, 'tion' FROM v_pinned WHERE query_id % 3 = 1)
    SELECT query_id, id, ord FROM pick JOIN v_store s USING (pmcid) WHERE id LIKE 'PMCID:%' AND (query_id % 3 = 0 OR EXISTS (SELECT 1 FROM term t
        WHERE t.query_id = pick.query_id AND contains(lower(s.title || ' ' || coalesce(s.passage, '') || ' ' || s.snippet), t.term)))
""")
def gate_passages(t: Tables) -> DataFrame:
    store = V.v_store(t)
    hits = R.top_cited(R.pinned_search(store, V.v_pinned(t)), 25)
    picks = R.pick_deep_read(hits, R.mentions_any(F.lower("title"), ["a"]))
    pins = V.v_pinned(t)
    terms = pins.where("query_id % 3 <> 0").select("query_id", F.col("target").alias("term")).unionByName(
        pins.where("query_id % 3 = 1").select("query_id", F.lit("tion").alias("term"))
    )
    return R.gate_passages(picks, store.where(F.col("id").startswith("PMCID:")), terms).select("query_id", "id", "ord")


@check("""
    WITH term AS (SELECT unnest(['A', 'A', 'B']) AS target, unnest(['high', 'low', 'a']) AS term),
    seed AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'A' WHEN doc_id % 3 = 0 THEN 'C' ELSE 'B' END AS target, id FROM v_store WHERE is_review),
    e AS (SELECT s.target, v.*, row_number() OVER (PARTITION BY s.target, cited ORDER BY cited_by DESC, ord) AS rn FROM v_edges v JOIN seed s ON s.id = v.cited
          WHERE s.target = 'C' OR EXISTS (SELECT 1 FROM term t WHERE t.target = s.target AND contains(lower(v.title), t.term))),
    c AS (SELECT DISTINCT target, citing AS id FROM e WHERE rn <= 3)
    SELECT c.target, id, ord FROM c JOIN v_store s USING (id) WHERE c.target = 'C' OR EXISTS (SELECT 1 FROM term t
        WHERE t.target = c.target AND contains(lower(s.title || ' ' || coalesce(s.passage, '') || ' ' || s.snippet), t.term))
""")
def snowball(t: Tables) -> DataFrame:
    store = V.v_store(t)
    target = F.when(F.col("doc_id") % 2 == 0, "A").when(F.col("doc_id") % 3 == 0, "C").otherwise("B")
    seeds = store.where("is_review").select(target.alias("target"), "id")
    terms = t.spark.sql("SELECT col1 AS target, col2 AS term FROM VALUES ('A', 'high'), ('A', 'low'), ('B', 'a')")
    return R.snowball(seeds, V.v_edges(t), store, terms).select("target", "id", "ord")


@check("""
    WITH q AS (SELECT DISTINCT target FROM v_pinned),
    words AS (SELECT *, ' ' || trim(regexp_replace(lower(concat_ws(' ', title, passage)), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' AS tx FROM v_store WHERE is_review),
    f AS (SELECT q.target, w.*, row_number() OVER (PARTITION BY q.target ORDER BY cited_by DESC, ord) AS rank FROM q JOIN words w
          ON contains(w.tx, ' ' || q.target || ' ') AND contains(lower(w.title || ' ' || coalesce(w.passage, '') || ' ' || w.snippet), q.target)),
    top AS (SELECT * FROM f WHERE rank <= 2),
    pick AS (SELECT target, min(rank) AS p FROM top WHERE contains(lower(title), target) AND pmcid <> '' AND is_open_access GROUP BY 1)
    SELECT top.target, id, rank, coalesce(rank = p, FALSE) AS deep_read FROM top LEFT JOIN pick ON pick.target = top.target
""")
def orientation(t: Tables) -> DataFrame:
    terms = V.v_pinned(t).select("target", F.col("target").alias("term")).distinct()
    return R.orient(V.v_store(t), terms).select("target", "id", "rank", "deep_read")


@check("WITH " + FOUND.replace("v_pinned q", "variants q").replace("WITH", "") .replace("words AS", """
    variants AS (SELECT query_id, 0 AS variant, target, concept FROM v_pinned UNION ALL SELECT query_id, 1, target, '' FROM v_pinned),
    words AS""").replace("SELECT q.query_id, w.*", "SELECT q.query_id, q.variant, w.*") + """,
    gated AS (SELECT f.* FROM found f JOIN v_pinned p USING (query_id) WHERE contains(lower(f.title || ' ' || coalesce(f.passage, '') || ' ' || f.snippet), p.target)),
    page AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY cited_by DESC, ord) AS r FROM found),
    lists AS (SELECT query_id, variant, id, doc_id, row_number() OVER (PARTITION BY query_id, variant ORDER BY r) - 1 AS idx FROM page WHERE r <= 25
              AND (query_id, id) IN (SELECT query_id, id FROM gated)),
    lex AS (SELECT query_id, id, any_value(doc_id) AS doc_id, sum(1.0::DOUBLE / (60 + idx + 1)) AS score, min(variant * 1000 + idx) AS f FROM lists GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, f) AS rank FROM lex),
    pool AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM ranked WHERE rank <= 50),
    nv AS (SELECT count(*) AS nv FROM embeddings),
    vec AS (SELECT p.*, e.embedding AS d, q.embedding AS q FROM pool p, nv
            LEFT JOIN embeddings e ON e.vec_id = p.doc_id % nv.nv AND p.doc_id % 37 <> 0 LEFT JOIN embeddings q ON q.vec_id = p.query_id),
    ok AS (SELECT query_id FROM vec GROUP BY 1 HAVING count(*) = count(d) AND count(*) >= 2),
    den AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY """ + COSINE.format(a="q", b="d") + """ DESC, rank) AS dr
            FROM vec WHERE query_id IN (SELECT query_id FROM ok)),
    fin AS (SELECT p.query_id, p.id, p.rank AS lexical_rank, den.dr AS dense_rank,
            CASE WHEN den.dr IS NULL THEN 1.0::DOUBLE / (60 + p.rank) ELSE 1.0::DOUBLE / (60 + p.rank) + 1.0::DOUBLE / (60 + den.dr) END AS score
            FROM pool p LEFT JOIN den ON den.query_id = p.query_id AND den.id = p.id)
    SELECT query_id, id, lexical_rank, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, lexical_rank) AS rank FROM fin)
    WHERE rank <= 8
""")
def hybrid_search(t: Tables) -> DataFrame:
    pins = V.v_pinned(t)
    variants = pins.withColumn("variant", F.lit(0)).unionByName(pins.withColumn("variant", F.lit(1)).withColumn("concept", F.lit("")))
    terms = pins.select("query_id", F.col("target").alias("term"))
    store = V.v_store(t)
    n = t.rows("embeddings")
    vectors = store.where("doc_id % 37 <> 0").select("id", (F.col("doc_id") % n).alias("vec_id")).join(
        t["embeddings"].select("vec_id", F.col("embedding").alias("vector")), "vec_id"
    ).select("id", "vector")
    queries = t["embeddings"].select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    out = H.hybrid_search(variants, terms, store, queries, vectors, page_size=25)
    return out.select("query_id", "id", "lexical_rank", "rank")
