"""Ranked search, id files with their index, and whitening: against brute force, the library and numpy."""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_llm_operators import ROWS, SCHEMA

from attestra.llm import idfiles, lexical, queries, whitening, wordids

FOLDER = "/root/testdata/sf0.001"
VOCABULARY = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(VOCABULARY))


# --- ranked search ------------------------------------------------------------------------------


def ranked(items, docs, k):
    """All pairs, in plain Python integers."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(i, words(t)) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = {}
    for _, bag in bags:
        for w in set(bag):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for i, bag in bags:
            score = 0
            for w in words(text):
                tf = bag.count(w)
                if tf:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                    score += weight * ((10**9 * tf) // (1000 * tf + 8 * (25 + 75 * len(bag) * n_docs // total)))
            if score:
                scores.append((-score, i is not None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return out


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_search_equals_brute_force(spark, docs):
    pairs = [(r[0], r[1]) for r in ROWS]
    texts = [t for _, t in pairs if t]
    items = [(1, texts[4]), (2, "one ONE two"), (3, None), (4, "!!"), (5, "nowhere"), (6, "same last é 日本語"), (None, "ab"), (7, texts[8][:900])]
    table = spark.createDataFrame([(i, t, 9, "x", 1.0) for i, t in items], "item_id bigint, text string, doc_id int, term string, score double")
    want = plain(ranked(items, pairs, 3))
    assert plain(lexical.search(table, docs, k=3).collect()) == want
    assert plain(lexical.search(table, docs, k=3, most_items=2).collect()) == want  # queries in several blocks
    assert lexical.search(table.limit(0), docs, k=3).count() == 0 == lexical.search(table, docs.limit(0), k=3).count()


def test_search_in_buckets(spark):
    """Many buckets, long and short vectors, hot copies and ties: still exactly the brute force's ranks."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words[: rng.choice([5, 60])]) for _ in range(rng.choice([1, 3, 30])))) for i in range(900)]
    rows += [(1000 + i, "w1 w2 w3") for i in range(450)]
    items = [(q, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for q in range(25)]
    found = lexical.search(spark.createDataFrame(items, "item_id bigint, text string"), spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7), k=10)
    assert plain(found.collect()) == plain(ranked(items, rows, 10))


def test_bounds_prune_and_keep(spark):
    """A threshold above a bucket's reach skips it; one that ties with the best keeps it."""
    counts = lexical.counted(spark.createDataFrame([(1, "a b"), (2, "a"), (3, "b b")], "doc_id bigint, text string"), {b"a": 0, b"b": 1})
    found = lexical.vectors(counts, np.array([3, 5]), 3, 5)
    q = lexical.Queries(["q"], {b"a": 0, b"b": 1}, np.array([0, 2]), np.array([0, 1]), np.array([1, 1]))
    all_of_them = {r["doc_id"]: r["score"] for r in lexical.searched(found, q, np.array([3, 5]), np.zeros(1, np.int64), 10).collect()}
    best = max(all_of_them.values())
    keep = lambda least: {r["doc_id"] for r in lexical.searched(found, q, np.array([3, 5]), np.array([least]), 10).collect()}
    assert len(all_of_them) == 3 and keep(best) == {d for d, s in all_of_them.items() if s == best} and keep(best + 1) == set()


# --- id files -----------------------------------------------------------------------------------


def awkward_texts():
    rng = random.Random(8)
    parts = ["don't", "I'LL", "'s", "x's", "é", "é", "ﬁ", "İ", "ΣΑΣ", "ß", "ª", "²³½", "12a3", "日本語", "😀!", "...", "<|endoftext|>", "a<|startoftext|>b", " ", "­", "\x00", "\x1c", "\x85", " ", "Ǆ", "ɏ", "ɐ", "_a_", "word" * 80, "ͅ"]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", "\n", "\t ", "　"]) for _ in range(rng.randint(1, 25))) for _ in range(400)] + parts


def test_encoder_equals_the_library(library):
    book = wordids.Encoder(public_tokenizers.path(VOCABULARY), remembered=50)
    assert book.by_pieces
    for text in awkward_texts():
        got = np.frombuffer(book.encode(text), f"<u{book.width}").tolist()
        assert got == library.encode(text, add_special_tokens=False).ids, text
    assert book.encode(None) == book.encode("") == b""


def test_other_vocabulary_goes_through_the_library():
    book = wordids.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not book.by_pieces
    assert np.frombuffer(book.encode("Hello  there"), f"<u{book.width}").tolist() == book.library.encode("Hello  there", add_special_tokens=False).ids


def test_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 5000):
        h1, h2 = rng.integers(0, 2**63, (2, n)).astype(np.uint64)
        _, slots = idfiles.build(h1, h2)
        assert sorted(slots.tolist()) == list(range(n))
        bucket = idfiles.Bucket(idfiles.pack_bucket(h1, h2, np.arange(n), np.arange(n) * 3, np.arange(n) + 7))
        assert bucket.find(h1, h2).tolist() == slots.tolist()
        assert bucket.table["offset"][bucket.find(h1, h2)].tolist() == [3 * i for i in range(n)]
        assert (bucket.find(h2, h1 + np.uint64(1)) < 0).all()
    with pytest.raises(ValueError, match="share both hashes"):
        idfiles.build(np.zeros(2, np.uint64), np.zeros(2, np.uint64))


def test_every_row_is_found_again(spark, docs, library, tmp_path):
    folder = str(tmp_path / "ids")
    known = wordids.write_ids(docs.repartition(5), folder, VOCABULARY, end=2)
    idfiles.index(spark, folder, keys=4)
    assert known["docs"] == len(ROWS)
    rows = idfiles.fetch(idfiles.look_up(idfiles.every_key(docs, step=1), folder), folder).collect()
    want = {}
    for i, text, *_ in ROWS:
        want.setdefault(i, []).append(library.encode(text or "", add_special_tokens=False).ids + [2])
    got = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        got.setdefault(r["doc_id"], []).append(np.frombuffer(r["ids"], "<u4").tolist())
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):  # gapless, in ascending order, rows without an id first
        assert r["start"] == at
        at += r["length"]
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    assert idfiles.read_document(folder, 5).tolist() == want[5][0] and idfiles.read_document(folder, None, 1) is not None
    assert idfiles.read_document(folder, 5, 1) is None and idfiles.read_document(folder, 10**12) is None
    unknown = spark.createDataFrame([(5, 0), (5, 1), (-1, 0)], "doc_id bigint, copy bigint")
    assert sorted((r["doc_id"], r["copy"], r["shard"] is not None) for r in idfiles.look_up(unknown, folder).collect()) == [(-1, 0, False), (5, 0, True), (5, 1, False)]


def test_small_shards_and_copies_across_them(spark, tmp_path):
    """A key's copies go on in the next shards; their numbers and starts do too."""
    rows = spark.createDataFrame([(1, b"\x01\x00")] + [(7, bytes([i, 0]) * (i + 1)) for i in range(9)] + [(9, b"")], "doc_id bigint, ids binary").coalesce(1)
    folder = str(tmp_path / "small")
    known = idfiles.write(rows, folder, width=2, limit=8)
    assert len(known["files"]) > 4 and known["docs"] == 11
    idfiles.index(spark, folder, keys=2)
    got = {(r["doc_id"], r["copy"]): (r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in idfiles.fetch(idfiles.look_up(idfiles.every_key(rows), folder), folder).collect()}
    assert set(got) == {(1, 0), (9, 0)} | {(7, i) for i in range(9)}
    for i in range(9):
        assert got[7, i] == (1 + i * (i + 1) // 2, [i] * (i + 1))


def test_what_is_not_committed_is_not_read(spark, tmp_path):
    folder = str(tmp_path / "twice")
    rows = spark.createDataFrame([(1, b"\x05\x00")], "doc_id bigint, ids binary")
    idfiles.write(rows, folder, 2)
    (tmp_path / "twice" / "part-000000-0000-lost.ids").write_bytes(b"left by a lost task")
    idfiles.index(spark, folder)
    assert idfiles.read_document(folder, 1).tolist() == [5]
    with pytest.raises(Exception, match="not in the index"):
        idfiles.fetch(idfiles.look_up(spark.createDataFrame([(2, 0)], "doc_id bigint, copy bigint"), folder), folder).collect()


def test_empty_table_of_ids(spark, docs, tmp_path):
    folder = str(tmp_path / "none")
    assert wordids.write_ids(docs.limit(0), folder, VOCABULARY, 2)["files"] == []
    idfiles.index(spark, folder)
    assert idfiles.look_up(idfiles.every_key(docs.limit(0)), folder).count() == 0 and idfiles.read_document(folder, 1) is None
    assert all(r["shard"] is None for r in idfiles.look_up(idfiles.every_key(docs), folder).collect())


def test_id_query_equals_the_library(spark, library):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    rows = {r["doc_id"]: r for r in queries.op12_id_index(spark, FOLDER).collect()}
    at = 0
    for doc, text in docs:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert tuple(rows.pop(doc)) == (doc, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert not rows


# --- whitening ----------------------------------------------------------------------------------


@pytest.mark.parametrize("values", [[5.0, 4, 3, 2, 1, 0.5], [3.0] * 4, [7.0, 7, 7, 1, 1, 0], [1e9, 1, 1e-6], [2.0], [0.0, 0.0], [-3.0, 2, 2, 5]])
def test_components_equal_the_spectrum(values):
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    for count in (1, 2, len(values)):
        found, vectors = whitening.components(a, count)
        scale = max(1e-300, np.abs(values).max())
        assert np.allclose(found, sorted(values, reverse=True)[:count], rtol=0, atol=1e-13 * scale)
        assert np.allclose(vectors.T @ vectors, np.eye(vectors.shape[1]), atol=1e-13)
        assert np.abs(a @ vectors - vectors * found).max() <= 1e-12 * scale


def test_polar_factor():
    a = np.random.default_rng(2).standard_normal((20, 20))
    a = a + a.T
    w, v = np.linalg.eigh(a)
    assert np.abs(whitening.polar_factor(a) - v @ np.diag(np.sign(w)) @ v.T).max() < 1e-12


def expected(x, count):
    x = np.floor(64 * x).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    y = x - sums / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    deviation = [sum(int(v) ** 2 for v in n * r - sums) for r in x]
    return deviation, (y @ vectors) / np.sqrt(values), values / np.trace(y.T @ y / n)


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((300, 12)) @ np.diag(np.linspace(1, 6, 12)) @ rng.standard_normal((12, 12))
    rows = [(i, [float(v) for v in r], "x", 1) for i, r in enumerate(x)]
    bad = [(1000, None), (1001, [None] + [0.0] * 11), (1002, [float("nan")] * 12), (1003, [float("inf")] * 12), (1004, []), (1005, [1.0, 2.0])]
    table = spark.createDataFrame(rows + [(i, v, "x", 1) for i, v in bad], "vec_id bigint, embedding array<double>, component string, n int").repartition(5)
    got = whitening.whiten(table, count=5).toPandas()
    deviation, white, share = expected(x, 5)
    wide = got.pivot(index="vec_id", columns="component", values="whitened")
    assert wide.index.tolist() == list(range(300)) and wide.columns.tolist() == [1, 2, 3, 4, 5]
    signs = np.sign((wide.to_numpy() * white).sum(axis=0))
    assert np.abs(wide.to_numpy() * signs - white).max() < 1e-9
    one = got[got.component == 1].sort_values("vec_id")
    assert one.deviation.tolist() == deviation and set(got.n) == {300}
    assert np.allclose(got.groupby("component").explained.first(), share, rtol=1e-10)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10


def test_whitening_of_few_and_flat_vectors(spark):
    kind = "vec_id bigint, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).count() == 0  # no variance
    line = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 6.0]), (None, [2.0, 4.0])], kind)
    rows = whitening.whiten(line).collect()
    assert len(rows) == 3 and {r["component"] for r in rows} == {1} and abs(rows[0]["explained"] - 1) < 1e-12
    large = spark.createDataFrame([(1, [1e30]), (2, [-1e30]), (3, [0.0])], kind)
    assert {r["deviation"] for r in whitening.whiten(large).collect() if r["vec_id"] < 3} == {None}


def test_whitening_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").toPandas()
    x = np.array(rows.embedding.tolist(), float)
    deviation, white, share = expected(x, 32)
    got = queries.op13_whitening(spark, FOLDER).toPandas()
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[rows.vec_id].to_numpy()
    assert np.abs(wide * np.sign((wide * white).sum(axis=0)) - white).max() < 1e-8 and got.identity_error.max() < 1e-4
    assert got[got.component == 1].set_index("vec_id").loc[rows.vec_id].deviation.tolist() == deviation
