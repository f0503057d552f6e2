"""Stages lose no document for want of a model, and no text to an empty row of its id."""

from __future__ import annotations

import zlib

import corpus_pipeline as P
from attestra.llm import jaccard

SCHEMA = "doc_id bigint, text string, lang string"
HELD_OUT = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]


def test_documents_stay_when_no_language_can_be_learnt(spark):
    texts = ["plain words of a text", "日本語のテキスト", "123 ...", "", None]
    unlabelled = [(i, t, None) for i, t in enumerate(texts)]
    unlearnt = [(i, t, "en") for i, t in zip(HELD_OUT, texts, strict=False)]
    for rows in (unlabelled, unlearnt):
        docs = spark.createDataFrame(rows, SCHEMA)
        kept = P.identify(spark, docs, "")
        assert kept.columns == docs.columns
        assert {tuple(r) for r in kept.collect()} == set(rows[:2])


def test_a_text_stays_before_an_empty_row_of_its_id(spark):
    text = "a long text of more than five words"
    rows = [(7, None, "en"), (7, "", "en"), (7, text, "en"), (8, None, "en"), (8, "", "en")]
    kept = jaccard.representatives(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(7, text), (8, "")]
