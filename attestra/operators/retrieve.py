"""Retrieval over evidence: gates, pinned search, rank fusion, dense ranks and reranks.

Queries are rows, so every operator ranks for all queries at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra import constants as K
from attestra.functions import text as T
from attestra.functions import vectors as V
from attestra.operators import postings as P
from attestra.session import cut_lineage, literal_array

GRAM = 3  # texts and terms meet on n-grams of this length; shorter terms on themselves


def rank_all(df: DataFrame, keys: list[str], order: list[Column], rank: str) -> DataFrame:
    """Rank every row per key; for candidate pools, which are bounded per query."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def positive(value: int | None, default: int) -> int:
    """The value asked for, or the default; a number below 1 is an error."""
    if value is not None and value < 1:
        raise ValueError(f"at least 1 expected, not {value}")
    return default if value is None else int(value)


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per key. Ranks are limited before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


# --- Relevance ---------------------------------------------------------------------------


def target_terms(targets: DataFrame) -> DataFrame:
    """``(target, term)`` from (target, approved_symbol, synonyms, ord): symbol first.

    Only the first record per target counts; synonyms under three characters are left out.
    """
    first = targets.groupBy("target").agg(
        F.min_by(F.struct("approved_symbol", "synonyms"), "ord").alias("rec")
    )
    names = F.concat(
        F.array("target", "rec.approved_symbol"),
        F.coalesce(F.filter("rec.synonyms", lambda s: F.length(s) >= 3), F.array().cast("array<string>")),
    )
    terms = F.array_distinct(F.transform(F.filter(names, lambda s: F.length(s) > 0), F.lower))
    return first.select("target", F.explode(terms).alias("term"))


def gate_text() -> Column:
    return F.lower(F.concat_ws(" ", "title", F.coalesce("passage", F.lit("")), F.coalesce("snippet", F.lit(""))))


def mentions_any(text: Column, terms: list[str]) -> Column:
    """Whether lower-cased text contains any term; an empty term list passes everything."""
    if not terms:
        return F.lit(True)
    return F.exists(literal_array([t.lower() for t in terms]), lambda t: F.contains(text, t))


def relevance_gate(evidence: DataFrame, terms: list[str]) -> DataFrame:
    """Rows whose title, passage or snippet contains a term of one target."""
    return evidence.where(mentions_any(gate_text(), terms))


def title_gate(evidence: DataFrame, terms: list[str]) -> DataFrame:
    return evidence.where(mentions_any(F.lower("title"), terms))


def _grams(text: Column, n: Column) -> Column:
    """The distinct n-grams of a text, by one pass of an empty match at every place."""
    return F.array_distinct(F.regexp_extract_all(text, F.concat(F.lit("(?s)(?=(.{"), n.cast("string"), F.lit("}))")), F.lit(1)))


def term_hits(rows: DataFrame, id_col: str, text: Column, terms: DataFrame, index: P.TextIndex | None = None) -> DataFrame:
    """``(id, target)`` pairs where the text contains any term of the target.

    A term of letters and digits lies within one word, so the words that contain it are found in the
    vocabulary and their postings name the rows; no text is read. A term of several words is looked up by
    its longest, and only the rows that hold it fetch their text. A term without letters or digits is
    looked for in n-grams of the texts. ``index`` is an index of ``text``; without one it is built here.
    """
    lowered = cut_lineage(terms.select("target", F.lower("term").alias("term")).where(F.length("term") > 0).distinct())
    parts = P.words_of(F.col("term"))
    longest = F.aggregate(parts, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    shaped = lowered.withColumn("part", longest).withColumn("_one", F.col("part") == F.col("term"))
    base = rows.select(F.col(id_col), text.alias("_text"))
    worded = shaped.where(F.length("part") > 0)
    index = index or P.build(base, id_col, [F.col("_text")])
    held = P.rows_with(index, worded.select("part").distinct())
    direct = held.join(worded.where("_one").select("part", "target").distinct(), "part").select("target", "segment", "rows")
    hits = index.named(direct, id_col).select(id_col, "target")
    if not worded.where(~F.col("_one")).isEmpty():
        several = index.named(held.join(worded.where(~F.col("_one")), "part").select("term", "segment", "rows"), id_col).distinct()
        found = several.join(base, id_col).where(F.contains("_text", F.col("term"))).select(id_col, "term")
        hits = hits.unionByName(found.join(lowered, "term").select(id_col, "target"))
    marks = shaped.where(F.length("part") == 0).select("target", "term")
    if not marks.isEmpty():
        hits = hits.unionByName(_mark_hits(base, id_col, marks))
    return hits.distinct()


def _mark_hits(base: DataFrame, id_col: str, terms: DataFrame) -> DataFrame:
    """Texts that contain a term without letters and digits: they meet on the term's first characters."""
    keyed = terms.withColumn("_gram", F.substring("term", 1, GRAM))
    held = F.concat(*[_grams(F.col("_text"), F.lit(n)) for n in range(1, GRAM + 1)])
    pairs = base.select(id_col, F.explode(held).alias("_gram")).join(keyed, "_gram").select(id_col, "target", "term").distinct()
    return pairs.join(base, id_col).where(F.contains("_text", F.col("term"))).select(id_col, "target")


def own_terms(terms: DataFrame, key: str) -> DataFrame:
    """The lower-case terms of each key as an array ``_terms``: a symbol and its synonyms."""
    return terms.groupBy(key).agg(F.collect_set(F.lower("term")).alias("_terms"))


def mentions_own(text: Column) -> Column:
    """Whether text contains one of the row's ``_terms``; without terms every row passes."""
    return F.coalesce(F.exists("_terms", lambda t: F.contains(text, t)), F.lit(True))


def relevance_gate_many(evidence: DataFrame, terms: DataFrame, index: P.TextIndex | None = None) -> DataFrame:
    """``(target, evidence row)`` for every target whose terms the row mentions.

    A target without terms passes every row; ``open_targets`` names those, and the evidence itself
    is their result, so it is not multiplied here.
    """
    return evidence.join(term_hits(evidence, "id", gate_text(), terms, index), "id")


def open_targets(targets: DataFrame, terms: DataFrame) -> DataFrame:
    """The targets that have no term, for which the gate passes everything."""
    named = terms.where(F.length("term") > 0).select("target")
    return targets.select("target").distinct().join(named, "target", "left_anti")


# --- Search ------------------------------------------------------------------------------


def publication_index(publications: DataFrame, folder: str | None = None, buckets: int | None = None) -> P.TextIndex:
    """The index that pinned search asks: title and passage are one region, the snippet the next."""
    return P.build(publications, "id", [F.concat_ws(" ", "title", "passage"), F.col("snippet")], folder, buckets)


def pinned_pairs(publications: DataFrame, queries: DataFrame, review_only: bool = False, index: P.TextIndex | None = None) -> DataFrame:
    """``(query_id, id, cited_by, ord)`` of the publications a (query_id, target, concept) finds.

    The target phrase must occur in title or abstract as whole words; the concept phrase anywhere in
    the record, and an empty concept matches. Phrases are found at their words' places in the index
    (``publication_index``, built here if none is given); texts are not read again.
    """
    pubs = publications.where(F.col("is_review")) if review_only else publications
    index = index or publication_index(pubs)
    target = F.struct(F.lit(0).alias("part"), P.words_of(F.col("target")).alias("words"), F.lit(1).alias("regions"))
    concept = F.struct(F.lit(1).alias("part"), P.words_of(F.col("concept")).alias("words"), F.lit(2).alias("regions"))
    parts = queries.where(F.size(P.words_of(F.col("target"))) > 0).select(F.col("query_id").alias("query"), F.explode(F.array(target, concept)).alias("p"))
    hits = P.phrase_rows(index, parts.select("query", "p.*").where(F.size("words") > 0))
    found = index.named(hits.withColumnRenamed("query", "query_id"), "id").distinct()
    return found.join(pubs.select("id", *[c for c in ("cited_by", "ord") if c in pubs.columns]), "id").select("query_id", "id", *[c for c in ("cited_by", "ord") if c in pubs.columns])


def pinned_search(publications: DataFrame, queries: DataFrame, review_only: bool = False, index: P.TextIndex | None = None) -> DataFrame:
    """The publications each query finds, whole rows. Publication ids must be unique."""
    pairs = pinned_pairs(publications, queries, review_only, index)
    return pairs.select("query_id", "id").join(publications, "id")


def top_cited(hits: DataFrame, page_size: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """One page per query: most cited first, arrival order on ties."""
    n = positive(page_size, K.TOP_K)
    return top_n(hits, keys or ["query_id"], [F.col("cited_by").desc(), F.col("ord")], n)


def query_variants(base: DataFrame, aliases: DataFrame, proposed: DataFrame, n: int = K.VARIANTS) -> DataFrame:
    """The first ``n`` variants per query: the original, one alias, then proposed ones.

    base: query_id, target, concept; aliases: query_id, alias, ord; proposed: query_id,
    target, concept, ord. Proposed variants equal to an earlier one (case-insensitive)
    are dropped.
    """
    n = positive(n, K.VARIANTS)
    facet = T.collapse_space(T.strip_query_syntax(T.drop_word(F.col("concept"), F.col("_base"))))
    origin = base.select("query_id", F.col("target").alias("_base"), "concept").select(
        "query_id", "_base", facet.alias("_facet")
    )
    first = origin.select("query_id", F.col("_base").alias("target"), F.col("_facet").alias("concept"),
                          F.lit(0).alias("_rank"), F.lit(0).cast("long").alias("_ord"))
    clean_alias = (
        aliases.join(origin, "query_id")
        .withColumn("_alias", T.strip_query_syntax(F.col("alias")))
        .withColumn("_alias", F.when(F.length("_alias") > 0, F.col("_alias")).otherwise(F.col("_base")))
        .where(F.lower("_alias") != F.lower("_base"))
    )
    alias = clean_alias.groupBy("query_id").agg(
        F.min_by(F.struct(F.col("_alias").alias("target"), F.col("_facet").alias("concept")), "ord").alias("v")
    ).select("query_id", "v.target", "v.concept", F.lit(1).alias("_rank"), F.lit(0).cast("long").alias("_ord"))
    model = (
        proposed.join(origin.select("query_id", "_base"), "query_id")
        .withColumn("_t", T.strip_query_syntax(F.col("target")))
        .select(
            "query_id",
            F.when(F.length("_t") > 0, F.col("_t")).otherwise(F.col("_base")).alias("target"),
            facet.alias("concept"),
            F.lit(2).alias("_rank"),
            F.col("ord").cast("long").alias("_ord"),
        )
    )
    every = first.unionByName(alias).unionByName(model)
    # The first three ranks keep one row per (query, lower-cased variant): the earliest.
    unique = every.groupBy("query_id", F.lower("target").alias("_lt"), F.lower("concept").alias("_lc")).agg(
        F.min_by(F.struct("target", "concept", "_rank", "_ord"), F.struct("_rank", "_ord")).alias("v")
    ).select("query_id", "v.*")
    return top_n(unique, ["query_id"], [F.col("_rank"), F.col("_ord")], n, "variant").drop("_rank", "_ord")


# --- Fusion and vectors ------------------------------------------------------------------


def rrf(lists: DataFrame, k: int = K.RRF_K, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of (query_id, list_no, idx, id), idx from 0.

    An id counts once per list, at its first index; later indexes do not move up. Scores
    are added in list order, so the sum does not depend on partitioning. With ``limit``
    the best rows per query get a rank; without it the order columns are returned.
    """
    k = max(0, k)
    per_list = lists.groupBy("query_id", "list_no", "id").agg(F.min("idx").alias("idx"))
    # One entry per list an id occurs in: bounded by the number of lists per query.
    fused = per_list.groupBy("query_id", "id").agg(
        F.sort_array(F.collect_list(F.struct("list_no", "idx"))).alias("_in")
    )
    score = F.aggregate("_in", F.lit(0.0), lambda acc, x: acc + F.lit(1.0) / (x["idx"] + F.lit(k + 1)))
    scored = fused.select(
        "query_id", "id", score.alias("score"), F.element_at("_in", 1).alias("_first")
    ).select("query_id", "id", "score", F.col("_first.list_no").alias("first_list"), F.col("_first.idx").alias("first_idx"))
    if limit is None:
        return scored
    order = [F.col("score").desc(), F.col("first_list"), F.col("first_idx")]
    return top_n(scored, ["query_id"], order, limit)


def split_vectors(vectors: DataFrame, column: str = "vector") -> tuple[DataFrame, DataFrame]:
    """``(usable, rejected)``: vectors must be non-empty and finite."""
    ok = V.valid_vector(F.col(column))
    return vectors.where(ok), vectors.where(~ok)


def dense_rank_pool(pool: DataFrame, query_vectors: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rank a bounded candidate pool by cosine; lexical rank breaks ties.

    pool: query_id, id, rank (a page per query); vectors: id, vector.
    """
    qv = query_vectors.select("query_id", F.col("vector").alias("_q")).withColumn("_q2", V.squared_norm(F.col("_q")))
    dv = vectors.select("id", F.col("vector").alias("_d"))
    scored = (
        pool.join(dv, "id")
        .join(qv, "query_id")
        .withColumn("similarity", V.cosine(F.col("_q"), F.col("_d"), a2=F.col("_q2")))
        .drop("_q", "_d", "_q2")
    )
    return rank_all(scored, ["query_id"], [F.col("similarity").desc(), F.col("rank")], "dense_rank")


def apply_rerank(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """Reorder (query_id, id, rank from 1) by outside scores (query_id, index from 0, score, ord).

    Indexes outside the list and non-finite scores are ignored, the best score of an index
    counts, and hits without a score keep their order behind the scored ones.
    """
    index = F.col("index")
    good = scores.where(
        (index >= 0) & (index == F.floor(index)) & F.col("score").isNotNull() & ~F.isnan("score")
        & (F.abs("score") != float("inf"))
    )
    # Ordered by score, ties by arrival; the first mention of an index is the one kept.
    best = good.groupBy("query_id", index.cast("long").alias("_i")).agg(
        F.max_by(F.struct("score", "ord"), F.struct("score", -F.col("ord"))).alias("s")
    ).select("query_id", "_i", "s.score", F.col("s.ord").alias("_seen"))
    sized = hits.withColumn("_i", F.col("rank").cast("long") - 1)
    joined = sized.join(best, ["query_id", "_i"], "left")
    order = [F.col("score").isNull(), F.col("score").desc(), F.col("_seen"), F.col("rank")]
    out = rank_all(joined, ["query_id"], order, "rerank")
    return out.drop("_i", "_seen")


# --- Reading and snowballing -------------------------------------------------------------


def readable() -> Column:
    """Full text can be read: a PMCID and no closed-access flag."""
    return (F.length("pmcid") > 0) & F.coalesce("is_open_access", F.lit(True))


def pick_deep_read(hits: DataFrame, title_ok: Column) -> DataFrame:
    """The first ranked readable hit per query whose title names the target."""
    good = hits.where(readable() & title_ok)
    return good.groupBy("query_id").agg(F.min_by(F.struct("id", "pmcid", "rank"), "rank").alias("p")).select(
        "query_id", "p.*"
    )


def gate_passages(picks: DataFrame, passages: DataFrame, terms: DataFrame) -> DataFrame:
    """``(query_id, passage row)``: sections of each query's picked article that mention one of that
    query's terms (query_id, term); a query without terms passes all."""
    chosen = passages.join(picks.select("query_id", "pmcid").distinct(), "pmcid")
    return chosen.join(own_terms(terms, "query_id"), "query_id", "left").where(mentions_own(gate_text())).drop("_terms")


def snowball(seeds: DataFrame, edges: DataFrame, publications: DataFrame, terms: DataFrame, n: int | None = 3) -> DataFrame:
    """Papers citing a target's seeds: per seed the ``n`` most cited (all for ``None``) whose title
    names the target, then gated by the target's terms.

    seeds: target, id; terms: target, term; edges: cited, citing, title, cited_by, ord (ids of the
    form ``PMID:n``). Returns (target, evidence row), the first record per target and id.
    """
    from attestra.operators.store import register

    named = own_terms(terms, "target")
    papers = seeds.where(F.col("id").startswith("PMID:")).select("target", F.col("id").alias("cited")).distinct()
    fitting = edges.join(papers, "cited").join(named, "target", "left").where(mentions_own(F.lower("title"))).drop("_terms")
    if n is not None:
        fitting = top_n(fitting, ["target", "cited"], [F.col("cited_by").desc(), F.col("ord")], positive(n, 3))
    citing = fitting.select("target", F.col("citing").alias("id")).distinct()
    full = publications.join(citing, "id").join(named, "target", "left").where(mentions_own(gate_text())).drop("_terms")
    return register(full, ["target", "id"])


def orient(publications: DataFrame, terms: DataFrame, n: int = 2) -> DataFrame:
    """The top review papers per target, flagged where the first readable one is deep-read.

    terms: (target, term); the target's own symbol is the pinned search term.
    """
    queries = terms.select("target").distinct().select(
        F.col("target").alias("query_id"), "target", F.lit("").alias("concept")
    )
    found = pinned_pairs(publications, queries, review_only=True).select(F.col("query_id").alias("target"), "id")
    named = own_terms(terms, "target")
    fits = publications.select("id", "cited_by", "ord", gate_text().alias("_text"))
    gated = found.join(fits, "id").join(named, "target", "left").where(mentions_own(F.col("_text"))).drop("_text", "_terms")
    page = top_cited(gated, n, ["target"]).select("target", "id", "rank")
    ranked = page.join(publications, "id").join(named, "target", "left")
    good = F.when(mentions_own(F.lower("title")) & readable(), F.col("rank"))
    # At most ``n`` rows per target are left here.
    first = F.min(good).over(Window.partitionBy("target"))
    return ranked.withColumn("deep_read", F.coalesce(F.col("rank") == first, F.lit(False))).drop("_terms")
