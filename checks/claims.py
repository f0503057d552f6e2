"""Claim and expert ranking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.operators import claims as C
from attestra.operators import consolidate as X
from attestra.operators import store as S
from attestra.session import cut_lineage
from checks import views as V
from checks.base import Tables, check
from checks.store import IDENTITY

KNOWN = "(SELECT id FROM v_evidence)"


@check(f"""
    WITH x AS (SELECT section_id, ord, i, citations[i] AS id FROM v_claims, (SELECT unnest([1, 2]) AS i) WHERE len(citations) >= i),
    m AS (SELECT section_id, ord, string_agg(id, ', ' ORDER BY i) AS missing FROM x WHERE id NOT IN {KNOWN} GROUP BY 1, 2)
    SELECT c.section_id, c.ord, CASE WHEN len(c.citations) = 0 THEN 'no citation'
           WHEN m.missing IS NOT NULL THEN 'citation does not resolve: ' || m.missing END AS reason
    FROM v_claims c LEFT JOIN m ON m.section_id = c.section_id AND m.ord = c.ord
""")
def ground_claims(t: Tables) -> DataFrame:
    shipped, stripped = C.ground(V.v_claims(t), V.v_evidence(t))
    return shipped.select("section_id", "ord", F.lit(None).cast("string").alias("reason")).unionByName(
        stripped.select("section_id", "ord", "reason")
    )


@check("""
    WITH x AS (SELECT c.section_id, c.ord, i, '[' || e.id || ']' || CASE WHEN e.locator IS NULL THEN '' ELSE ' (' || e.locator || ')' END
               || ' ' || e.title || ' - ' || coalesce(e.passage, e.snippet) AS line
               FROM v_claims c, (SELECT unnest([1, 2]) AS i) JOIN v_store e ON e.id = c.citations[i] WHERE len(c.citations) >= i),
    j AS (SELECT section_id, ord, string_agg(line, chr(10) ORDER BY i) AS txt FROM x GROUP BY 1, 2)
    SELECT c.section_id, c.ord, md5(c.text) AS claim_md5, md5(coalesce(j.txt, '')) AS evidence_md5
    FROM v_claims c LEFT JOIN j ON j.section_id = c.section_id AND j.ord = c.ord
""")
def verify_inputs(t: Tables) -> DataFrame:
    rows = C.verify_inputs(V.v_claims(t), V.v_store(t).withColumn("raw", F.lit(None).cast("string")))
    return rows.select("section_id", "ord", F.md5("text").alias("claim_md5"), F.md5("evidence_text").alias("evidence_md5"))


@check("SELECT section_id, ord, text FROM v_shipped JOIN v_verdicts USING (section_id, ord) WHERE status = 'supported'")
def supported_claims(t: Tables) -> DataFrame:
    return C.supported(V.v_shipped(t), V.v_verdicts(t)).select("section_id", "ord", "text")


@check("""
    SELECT section_id, id, first_ord, first_pos FROM (
        SELECT section_id, citations[i] AS id, ord AS first_ord, i - 1 AS first_pos,
               row_number() OVER (PARTITION BY section_id, citations[i] ORDER BY ord, i) AS rn
        FROM v_claims, (SELECT unnest([1, 2]) AS i) WHERE len(citations) >= i) WHERE rn = 1
""")
def section_sources(t: Tables) -> DataFrame:
    return C.section_sources(V.v_claims(t))


RATING = """
    WITH ids AS (SELECT DISTINCT unnest(citations) AS id FROM v_claims), idn AS (""" + IDENTITY + """),
    good AS (SELECT s.* FROM v_shipped s JOIN v_verdicts v USING (section_id, ord) WHERE status = 'supported'),
    n AS (SELECT section_id, count(DISTINCT source_identity) AS n FROM (SELECT section_id, unnest(citations) AS id FROM good) JOIN idn USING (id) GROUP BY 1)
"""


@check(RATING + """
    SELECT b.section_id, coalesce(s.n, 0) AS n_shipped, coalesce(g.n, 0) AS n_supported, coalesce(n.n, 0) AS n_sources,
           CASE WHEN coalesce(g.n, 0) = 0 THEN 'red' WHEN g.n = s.n AND n.n >= 2 THEN 'green' ELSE 'amber' END AS rating
    FROM (SELECT DISTINCT section_id FROM v_claims UNION SELECT 99) b
    LEFT JOIN (SELECT section_id, count(*) AS n FROM v_shipped GROUP BY 1) s USING (section_id)
    LEFT JOIN (SELECT section_id, count(*) AS n FROM good GROUP BY 1) g USING (section_id)
    LEFT JOIN n USING (section_id)
""")
def section_rating(t: Tables) -> DataFrame:
    claims, store = V.v_claims(t), V.v_store(t)
    sections = claims.select("section_id").distinct().unionByName(t.spark.sql("SELECT 99L AS section_id"))
    identities = S.source_identity(S.cited_ids(claims), store)
    return C.rate_sections(sections, V.v_shipped(t), V.v_verdicts(t), identities)


CARD_SQL = """
    SELECT CASE WHEN id LIKE '%#localization' OR id LIKE '%#domains' THEN 'target_biology' WHEN id LIKE '%#expression' THEN 'disease_indications'
                ELSE 'modality_developability' END AS section_id, ord, 'struct-' || ord AS id,
           trim(snippet) || ' (' || source || ')' AS text, id AS cite, 0.9 AS confidence
    FROM v_cards WHERE source IN ('Open Targets', 'UniProt') AND trim(snippet) <> ''
"""


@check("""
    WITH cards AS (""" + CARD_SQL + """),
    own AS (SELECT section_id, ord, text, cite, confidence FROM cards WHERE ord % 4 = 0)
    SELECT section_id, 0 AS block, ord, text, cite, CAST(confidence AS DOUBLE) AS confidence FROM cards c
    WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.section_id = c.section_id AND o.text = c.text)
    UNION ALL SELECT section_id, 1, ord, text, cite, confidence FROM own
""")
def card_claims(t: Tables) -> DataFrame:
    cards = C.card_claims(V.v_cards(t))
    own = cards.where("ord % 4 = 0")
    sections = cards.select("section_id").distinct()
    merged = C.prepend(own, cards, sections)
    return merged.select("section_id", "block", "ord", "text", F.get("citations", F.lit(0)).alias("cite"), "confidence")


@check("""
    WITH audits AS (SELECT section_id, ord AS audit_ord, toxic, moderate, doc_id FROM v_critiques),
    cover AS (SELECT section_id, audit_ord, 'PMID:' || doc_id AS id FROM audits UNION ALL SELECT section_id, audit_ord, 'PMCID:PMC' || doc_id || '#sec-0' FROM audits),
    met AS (SELECT DISTINCT c.section_id, c.ord, v.audit_ord FROM (SELECT section_id, ord, unnest(citations) AS id FROM v_claims) c JOIN cover v USING (section_id, id)),
    flags AS (SELECT section_id, audit_ord, i, CASE WHEN i = 0 THEN 'high' ELSE 'moderate' END AS bias_risk FROM audits, (SELECT unnest([0, 1, 2, 3]) AS i)
              WHERE (i = 0 AND toxic = 1) OR (i > 0 AND i <= moderate))
    SELECT section_id, ord, audit_ord, bias_risk, count(*) AS n FROM met JOIN flags USING (section_id, audit_ord) GROUP BY ALL
""")
def attach_flags(t: Tables) -> DataFrame:
    audits = V.v_critiques(t).select(
        "section_id", F.col("ord").alias("audit_ord"), "red_flags",
        F.array("evidence_id", F.concat(F.lit("PMCID:PMC"), F.col("doc_id").cast("string"), F.lit("#sec-0"))).alias("ids"),
    )
    rows = C.claim_flags(V.v_claims(t), audits)
    return rows.groupBy("section_id", "ord", "audit_ord", "bias_risk").agg(F.count(F.lit(1)).alias("n"))


GRADED = """
    SELECT doc_id, evidence_id, section_id, ord, greatest(0, [3, 2, 1, 1, 0, 0][doc_id % 6 + 1] - toxic - CASE WHEN moderate >= 2 THEN 1 ELSE 0 END
           - CASE WHEN sample_size < 50 THEN 1 ELSE 0 END) AS level FROM v_critiques
"""


@check("SELECT doc_id, ['very_low', 'low', 'moderate', 'high'][level + 1] AS evidence_level FROM (" + GRADED + ")")
def grade(t: Tables) -> DataFrame:
    return C.grade(V.v_critiques(t)).select("doc_id", "evidence_level")


@check("WITH g AS (" + GRADED + """),
    b AS (SELECT section_id, ord, max(level) AS level FROM (SELECT section_id, ord, unnest(citations) AS evidence_id FROM v_claims) c
          JOIN (SELECT evidence_id, level FROM g) g USING (evidence_id) GROUP BY 1, 2)
    SELECT c.section_id, c.ord, coalesce(['very_low', 'low', 'moderate', 'high'][b.level + 1], 'ungraded') AS best_grade
    FROM v_claims c LEFT JOIN b ON b.section_id = c.section_id AND b.ord = c.ord
""")
def best_grade(t: Tables) -> DataFrame:
    return C.best_grade(V.v_claims(t), C.grade(V.v_critiques(t))).select("section_id", "ord", "best_grade")


@check(f"SELECT ord, id_a, id_b FROM v_contra WHERE id_a <> id_b AND id_a IN {KNOWN} AND id_b IN {KNOWN}")
def contradictions(t: Tables) -> DataFrame:
    return C.valid_contradictions(V.v_contra(t), V.v_evidence(t)).select("ord", "id_a", "id_b")


@check(f"SELECT * FROM v_risks WHERE evidence_id IN {KNOWN}")
def risks(t: Tables) -> DataFrame:
    return C.ground_risks(V.v_risks(t), V.v_evidence(t))


@check(f"""
    WITH runs AS (SELECT DISTINCT run_id, CASE WHEN run_id % 2 = 0 THEN 'go' ELSE 'watch' END AS proposed FROM v_claims
                  UNION SELECT 1000 + conv_id, 'go' FROM v_claims),
    c AS (SELECT run_id, count(*) AS n FROM (SELECT run_id, section_id, ord FROM v_shipped UNION ALL SELECT 1000 + conv_id, section_id, ord FROM v_shipped)
          JOIN v_verdicts USING (section_id, ord) WHERE status = 'supported' GROUP BY 1),
    s AS (SELECT DISTINCT run_id FROM v_risks WHERE severity = 'severe')
    SELECT r.run_id, r.proposed, coalesce(c.n, 0) AS n_supported, CASE WHEN coalesce(c.n, 0) < 2 THEN 'insufficient-evidence'
           WHEN s.run_id IS NOT NULL THEN 'no-go' ELSE proposed END AS verdict
    FROM runs r LEFT JOIN c ON c.run_id = r.run_id LEFT JOIN s ON s.run_id = r.run_id
""")
def posture(t: Tables) -> DataFrame:
    claims = V.v_claims(t)
    label = F.when(F.col("run_id") % 2 == 0, "go").otherwise("watch").alias("proposed")
    runs = claims.select("run_id", label).distinct().unionByName(
        claims.select((F.col("conv_id") + 1000).alias("run_id"), F.lit("go").alias("proposed")).distinct()
    )
    good = C.supported(V.v_shipped(t), V.v_verdicts(t))
    both = good.select("run_id").unionByName(good.select((F.col("conv_id") + 1000).alias("run_id")))
    return C.posture(runs, both, V.v_risks(t))


@check(f"""
    SELECT c.section_id, c.ord, coalesce(string_agg(x.id, '|' ORDER BY x.i), '') AS citations
    FROM v_claims c LEFT JOIN (SELECT section_id, ord, i, citations[i] AS id FROM v_claims, (SELECT unnest([1, 2]) AS i)
        WHERE len(citations) >= i AND citations[i] IN {KNOWN}) x ON x.section_id = c.section_id AND x.ord = c.ord
    GROUP BY 1, 2
""")
def clean_points(t: Tables) -> DataFrame:
    points = V.v_claims(t).select("section_id", "ord", "citations")
    out = C.clean_points(points, V.v_evidence(t), ["section_id", "ord"])
    return out.select("section_id", "ord", F.array_join("citations", "|").alias("citations"))


@check("""
    WITH base AS (SELECT section_id, ord, citations FROM v_shipped WHERE turn = 1),
    gap AS (SELECT CASE WHEN conv_id % 7 = 0 THEN 77 ELSE section_id END AS section_id, ord, citations FROM v_shipped WHERE turn = 2 AND section_id <> 4),
    gained AS (SELECT * FROM gap WHERE section_id IN (SELECT section_id FROM v_claims)),
    merged AS (SELECT * FROM base UNION ALL SELECT * FROM gained),
    ids AS (SELECT DISTINCT unnest(citations) AS id FROM v_claims), idn AS (""" + IDENTITY + """),
    n AS (SELECT section_id, count(DISTINCT source_identity) AS n FROM (SELECT section_id, unnest(citations) AS id FROM merged) JOIN idn USING (id) GROUP BY 1)
    SELECT s.section_id, CASE WHEN s.section_id IN (SELECT section_id FROM gained) THEN CASE WHEN n.n >= 2 THEN 'green' ELSE 'amber' END ELSE 'red' END AS rating,
           (SELECT count(*) FROM merged m WHERE m.section_id = s.section_id) AS n_claims
    FROM (SELECT DISTINCT section_id FROM v_claims) s LEFT JOIN n USING (section_id)
""")
def merge_gaps(t: Tables) -> DataFrame:
    shipped = V.v_shipped(t)
    cols = ["section_id", "ord", "citations"]
    gap = shipped.where("turn = 2 AND section_id <> 4").withColumn(
        "section_id", F.when(F.col("conv_id") % 7 == 0, F.lit(77).cast("bigint")).otherwise(F.col("section_id"))
    )
    sections = V.v_claims(t).select("section_id").distinct().withColumn("rating", F.lit("red"))
    identities = S.source_identity(S.cited_ids(V.v_claims(t)), V.v_store(t))
    rated, merged = C.merge_gaps(sections, shipped.where("turn = 1").select(*cols), gap.select(*cols), identities)
    counts = merged.groupBy("section_id").agg(F.count(F.lit(1)).alias("n_claims"))
    return rated.join(counts, "section_id", "left").na.fill(0, ["n_claims"])


@check("""
    SELECT doc_id, greatest(0.0, least(1.0, coalesce(CASE WHEN doc_id % 5 = 0 THEN NULL ELSE (n_chars - 500) / 1000.0 END, 0.7))) AS confidence FROM documents
""")
def clamp(t: Tables) -> DataFrame:
    raw = F.when(F.col("doc_id") % 5 != 0, (F.col("n_chars") - 500) / 1000)
    return C.clamp_confidence(t["documents"].select("doc_id", raw.alias("confidence")))


WORDS = """
    c AS (SELECT *, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS tk, array_to_string(list_sort(citations), '|') AS ck,
          list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''))) AS w FROM v_dup_claims),
    k AS (SELECT sha256(tk || chr(1) || ck || chr(1) || array_to_string(w, ' ')) AS class_id, any_value(tk) AS tk, any_value(ck) AS ck, any_value(w) AS w,
          min(ord) AS first_ord FROM c WHERE tk <> '' GROUP BY 1)
"""


@check("WITH " + WORDS + """,
    tok AS (SELECT class_id, ck, len(w) AS n, unnest(w) AS word FROM k),
    pairs AS (SELECT a.class_id AS a, b.class_id AS b FROM tok a JOIN tok b ON a.ck = b.ck AND a.ck <> '' AND a.word = b.word AND a.class_id < b.class_id
              GROUP BY 1, 2 HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.5),
    hubs AS (SELECT tk, arg_min(class_id, first_ord) AS hub FROM k GROUP BY 1),
    stars AS (SELECT least(hub, class_id) AS a, greatest(hub, class_id) AS b FROM k JOIN hubs USING (tk) WHERE hub <> class_id)
    SELECT DISTINCT a, b FROM (SELECT * FROM pairs UNION ALL SELECT * FROM stars)
""")
def consolidate_edges(t: Tables) -> DataFrame:
    keyed = X.keyed_claims(V.v_dup_claims(t))
    return X.same_fact_edges(cut_lineage(X.claim_classes(keyed.where(F.length("text_key") > 0))))


@check("WITH " + WORDS + """,
    g AS (SELECT *, CASE WHEN tk = '' THEN 'blank/' || ord ELSE tk END AS grp FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY confidence DESC, length(text) DESC, ord) AS rn, count(*) OVER (PARTITION BY grp) AS k FROM g)
    SELECT ord, section_id, text, CAST(k - 1 AS BIGINT) AS merged FROM r WHERE rn = 1
""")
def consolidate_text(t: Tables) -> DataFrame:
    """Without citations the text rule alone groups, and greedy groups equal its classes."""
    claims = V.v_dup_claims(t).withColumn("citations", F.array().cast("array<string>"))
    kept, _ = X.consolidate(claims)
    return kept.select("ord", "section_id", "text", "merged")


@check("WITH RECURSIVE " + WORDS + """,
    tok AS (SELECT class_id, ck, len(w) AS n, unnest(w) AS word FROM k WHERE ck <> ''),
    near AS (SELECT a.class_id AS a, b.class_id AS b FROM tok a JOIN tok b ON a.ck = b.ck AND a.word = b.word
             GROUP BY 1, 2 HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.5),
    alike AS (SELECT a, b FROM near UNION SELECT x.class_id, y.class_id FROM k x JOIN k y USING (tk)),
    item AS (SELECT ord, sha256(tk || chr(1) || ck || chr(1) || array_to_string(w, ' ')) AS class_id FROM c WHERE tk <> ''),
    e AS (SELECT y.ord AS late, x.ord AS early FROM alike JOIN item x ON x.class_id = a JOIN item y ON y.class_id = b WHERE y.ord > x.ord),
    reach(ord, g) AS (SELECT ord, ord FROM item UNION SELECT late, g FROM reach JOIN e ON early = reach.ord),
    grp AS (SELECT ord, min(g) AS g FROM reach GROUP BY 1 UNION ALL SELECT ord, ord FROM c WHERE tk = ''),
    r AS (SELECT c.*, g, row_number() OVER (PARTITION BY g ORDER BY len(citations) DESC, confidence DESC, length(text) DESC, c.ord) AS rn,
                 count(*) OVER (PARTITION BY g) AS n FROM c JOIN grp USING (ord)),
    u AS (SELECT g, id, min((ord, p)) AS f FROM (SELECT g, ord, unnest(citations) AS id, generate_subscripts(citations, 1) AS p FROM r) GROUP BY 1, 2)
    SELECT ord, section_id, text, CAST(n - 1 AS BIGINT) AS merged, u.id, CASE WHEN u.id IS NOT NULL THEN row_number() OVER (PARTITION BY r.g ORDER BY f) END::INTEGER AS place
    FROM r LEFT JOIN u ON u.g = r.g WHERE rn = 1
""")
def consolidate(t: Tables) -> DataFrame:
    """Kept claims, how many each replaces, and the united citations of its group in order of arrival."""
    kept, cites = X.consolidate(cut_lineage(V.v_dup_claims(t)))
    place = F.row_number().over(Window.partitionBy("ord").orderBy("first_ord", "first_pos"))
    united = cites.select("ord", "id", place.alias("place"))
    return kept.select("ord", "section_id", "text", "merged").join(united, "ord", "left")


@check("""
    WITH f AS (SELECT DISTINCT doc_id % 4 AS target, pmcid FROM v_store WHERE id LIKE 'PMCID:%' AND pmcid <> ''),
    p AS (SELECT s.doc_id % 4 AS target, last_author, affiliation, CASE WHEN f.pmcid IS NOT NULL THEN 3 ELSE 1 END AS w
          FROM v_store s LEFT JOIN f ON f.target = s.doc_id % 4 AND f.pmcid = s.pmcid WHERE last_author IS NOT NULL),
    a AS (SELECT target, last_author, affiliation, count(*) AS n FROM p WHERE affiliation IS NOT NULL GROUP BY 1, 2, 3),
    i AS (SELECT target, last_author, affiliation AS institution FROM (SELECT *, row_number() OVER (PARTITION BY target, last_author ORDER BY n DESC, affiliation) AS rn FROM a) WHERE rn = 1),
    l AS (SELECT target, last_author, count(*) AS paper_count, sum(w) AS weight FROM p GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY weight DESC, paper_count DESC, last_author) AS rank FROM l)
    SELECT r.target, r.last_author AS investigator, paper_count, CAST(weight AS BIGINT) AS weight, rank, institution
    FROM r LEFT JOIN i ON i.target = r.target AND i.last_author = r.last_author WHERE rank <= 3
""")
def rank_labs(t: Tables) -> DataFrame:
    rows = V.v_store(t).withColumn("target", F.col("doc_id") % 4)
    return C.rank_labs(rows).withColumn("paper_count", F.col("paper_count").cast("bigint"))
