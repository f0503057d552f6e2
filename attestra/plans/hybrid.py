"""Hybrid retrieval for all queries at once: lexical lists, fusion, dense ranks, rerank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra import constants as K
from attestra.operators import retrieve as R
from attestra.session import cut_lineage


def lexical_pool(variants: DataFrame, terms: DataFrame, publications: DataFrame, page_size: int, candidates: int) -> DataFrame:
    """(query_id, id, rank): fused lexical candidates, at most ``candidates`` per query.

    Each variant's page is gated by the query's terms; a gated list keeps its own order.
    """
    searched = variants.select(
        F.struct("query_id", "variant").alias("query_id"), "target", "concept"
    )
    page = R.top_cited(R.pinned_pairs(publications, searched), R.positive(page_size, 25))
    texts = publications.select("id", R.gate_text().alias("_text"))
    flat = page.select("query_id.query_id", "query_id.variant", "id", "rank").join(texts, "id")
    gated = flat.join(R.own_terms(terms, "query_id"), "query_id", "left").where(R.mentions_own(F.col("_text")))
    w = Window.partitionBy("query_id", "variant").orderBy("rank")
    lists = gated.select(
        "query_id", F.col("variant").alias("list_no"), (F.row_number().over(w) - 1).alias("idx"), "id"
    )
    return R.rrf(lists, limit=R.positive(candidates, K.CANDIDATES)).select("query_id", "id", "rank")


def hybrid_search(
    variants: DataFrame,
    terms: DataFrame,
    publications: DataFrame,
    query_vectors: DataFrame,
    vectors: DataFrame,
    page_size: int = 25,
    candidates: int = K.CANDIDATES,
    top_k: int = K.TOP_K,
    scores: DataFrame | None = None,
) -> DataFrame:
    """(query_id, id, lexical_rank, dense_rank, rank) of the best hits per query.

    variants: query_id, variant, target, concept; terms: query_id, term. A query whose
    candidates do not all have a usable vector, or that has fewer than two, keeps its
    lexical order. ``scores`` (query_id, index, score, ord) reranks the fused head.
    """
    # A page of ids per query, used in six places below: written once, read back.
    pool = cut_lineage(lexical_pool(variants, terms, publications, page_size, candidates))
    good, _ = R.split_vectors(vectors)
    have = pool.join(good.select("id").distinct(), "id", "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("_v"))
    sizes = pool.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    usable_q, _ = R.split_vectors(query_vectors)
    complete = (
        sizes.join(have, "query_id")
        .where((F.col("_n") == F.col("_v")) & (F.col("_n") >= 2))
        .join(usable_q.select("query_id"), "query_id", "left_semi")
        .select("query_id")
    )
    ranked = R.dense_rank_pool(pool.join(complete, "query_id", "left_semi"), usable_q, good)
    dense = cut_lineage(ranked.select("query_id", "id", "dense_rank"))
    lists = pool.select("query_id", F.lit(0).alias("list_no"), (F.col("rank") - 1).alias("idx"), "id").unionByName(
        dense.select("query_id", F.lit(1).alias("list_no"), (F.col("dense_rank") - 1).alias("idx"), "id")
    )
    fused = R.rrf(lists, limit=R.positive(top_k, K.TOP_K)).select("query_id", "id", "rank")
    if scores is not None:
        fused = R.apply_rerank(fused, scores).select("query_id", "id", F.col("rerank").alias("rank"))
    return fused.join(pool.withColumnRenamed("rank", "lexical_rank"), ["query_id", "id"]).join(
        dense, ["query_id", "id"], "left"
    )
