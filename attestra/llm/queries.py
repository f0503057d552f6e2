"""The queries of the operators over the driver tables, and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import chat, decontaminate, idfiles, jaccard, language, lexical, packing, quality, secrets, sharding, substrings, tokens, whitening, wordids
from attestra.session import checkpoint_dir

TOKENIZERS = "/opt/tokenizers"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return wrap


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.coalesce(language.held_out(F.col("doc_id")), F.lit(False))
    model = language.fit(docs.where(~fold))
    return language.predict(docs, model).withColumn("held_out", fold)


@query(
    r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(ws)) AS m, array_to_string(ws[p:p + least(13, len(ws)) - 1], ' ') AS body
       FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS p FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, m, p, array_to_string(ws[p:p + m - 1], ' ') AS body
       FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS p FROM w, (SELECT DISTINCT m FROM iw) WHERE len(ws) >= m)),
hit AS (SELECT doc_id, p, m, body FROM dw SEMI JOIN (SELECT DISTINCT m, body FROM iw) USING (m, body)),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM hit) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
      FROM (SELECT DISTINCT doc_id, item_id FROM hit JOIN iw USING (m, body)) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""
)
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), digest.alias("items_sha256"), "contaminated")


@query()
def op9_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


PLANTED_TURNS = """SELECT -7L AS conv_id, col1 AS turn, col2 AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant')"""


@query(
    r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(replace(text, '\', '\\'))
    + list_sum(list_transform(['<<SYS>>', '<</SYS>>', '[INST]', '[/INST]', '<s>', '</s>', '<|role:', '|>', '<|end|>'], lambda c: (length(text) - length(replace(text, c, ''))) // length(c))) AS body,
  CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 16 + length(role) END AS marks,
  lag(role) OVER w AS prev, row_number() OVER w AS rn FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(body + marks)::BIGINT AS formatted_chars,
  bool_and(CASE WHEN prev IS NULL THEN role IN ('system', 'user') WHEN prev IN ('system', 'assistant') THEN role = 'user' WHEN prev = 'user' THEN role = 'assistant' ELSE false END)
    AND arg_max(role, rn) = 'assistant' AS valid
FROM e GROUP BY conv_id
"""
)
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = chat.segments(turns.unionByName(spark.sql(PLANTED_TURNS)))
    turned = F.array_join(F.transform(chat.read_back(F.col("formatted")), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    done = done.withColumn("lossy", chat.loss_text(F.col("segments")))
    return done.select(
        "conv_id",
        F.size(chat.read_back(F.col("formatted"))).cast("bigint").alias("n_turns"),
        F.sha2(turned.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("lossy").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("lossy").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
    )


@query()
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(kind) for kind in secrets.KINDS],
        F.sha2(secrets.written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.written(F.col("secrets")).alias("spans"),
    )


@query()
def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pieces(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")
    return packing.pack(found)


@query()
def op8_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.numbered(sharding.shards(_table(spark, sf_dir, "documents")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@query()
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(_table(spark, sf_dir, "documents"), k=4, percent=85)


@query()
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


@query()
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.deduplicate(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["begin"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        (F.col("n_bytes") - removed).alias("n_kept"),
        (removed > 0).alias("changed"),
    )


@query(
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
qt AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
g AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, sum(len(ts))::BIGINT AS total FROM d),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d) SEMI JOIN (SELECT DISTINCT term FROM qt) USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, g GROUP BY term),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // total))))::BIGINT AS score
      FROM qt JOIN tf USING (term) JOIN w USING (term), g GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
)
def op11_lemp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents"), k=10)


@query()
def op12_id_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/ids-{uuid.uuid4().hex}"
    wordids.write_ids(docs, folder, "word_bpe_49k.json", end=2)
    idfiles.index(spark, folder)
    read = idfiles.fetch(idfiles.look_up(idfiles.every_key(docs), folder), folder)
    return read.select("doc_id", "start", F.col("length").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query()
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", count=32)
