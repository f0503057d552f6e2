"""Recall of the random tokens of each encoding and length among words, and behind names and paths."""

from __future__ import annotations

import random
import re

import brute
import pytest
from pyspark.sql import functions as F

from attestra.llm import secrets

LETTERS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
ENGLISH = (
    "the of and that have with this from they were which their would there about other people after first water where "
    "under think great house world still never again every right means before through should because between another thought"
).split()
HEXISH = "facade decade beef cafe added dead face fade 2023 1999 0000 1234 deed babe feed".split()
SEED = 11
LENGTHS = (20, 24, 32, 40, 64)
PLANTED, SHARE = 20, 0.01


def _words(rng, encoding, n):
    out = ""
    while len(out) < n:
        word = rng.choice(HEXISH if encoding.lower() == "hex" else ENGLISH)
        out += {"HEX": word.upper(), "base32": word.upper(), "base62": word.capitalize(), "base64": word.capitalize() + rng.choice(("", "/"))}.get(encoding, word)
    return out[:n]


def _token(rng, encoding, n):
    return "".join(rng.choice(LETTERS[encoding]) for _ in range(n))


def _random_spans(spark, data):
    found = secrets.scan(spark.createDataFrame(data, "doc_id bigint, text string").repartition(8))
    spans = F.filter("secrets", lambda s: s["kind"] == secrets.RANDOM)
    return {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in found.select("doc_id", spans.alias("spans")).collect()}


@pytest.fixture(scope="module")
def found(spark):
    """Of each (encoding, length) PLANTED tokens, a share of SHARE: how many of them are found, and how many of the words."""
    rng = random.Random(SEED)
    data, groups = [], []
    for encoding in LETTERS:
        for n in LENGTHS:
            for i in range(int(PLANTED / SHARE)):
                data.append((len(groups), f"see {_token(rng, encoding, n) if i < PLANTED else _words(rng, encoding, n)} here"))
                groups.append((encoding, n, i < PLANTED))
    spans = _random_spans(spark, data)
    out: dict = {}
    for i, (encoding, n, planted) in enumerate(groups):
        hits = out.setdefault((encoding, n), [0, 0])
        # A base kind may have the token already (lower-case hex of 32 and more).
        hits[not planted] += bool(spans[i]) or (planted and encoding == "hex" and n >= 32)
    return out


@pytest.mark.parametrize("encoding", LETTERS)
def test_tokens_of_every_length_are_found_at_a_share_of_one_percent(found, encoding):
    recall = {n: found[encoding, n][0] / PLANTED for n in LENGTHS}
    assert all(share >= (0.6 if n < 32 else 0.9) for n, share in recall.items()), recall


def test_words_stay(found):
    hits, words = (sum(h[i] for h in found.values()) for i in (0, 1))
    assert words <= 0.05 * (hits + words), (hits, words)


@pytest.mark.parametrize("prefix", ["sig=", "session=", "files/v2/", "user-id_", "https/host-name/path_to/x="])
def test_tokens_behind_names_and_paths_are_found(spark, prefix):
    rng = random.Random(4)
    kinds = [("HEX", 64), ("hex", 31), ("base32", 52), ("base36", 50), ("base62", 43)]
    tokens = [(_token(rng, e, n), e) for e, n in kinds for _ in range(20)]
    data = [(i, f"see {prefix}{t} here") for i, (t, _) in enumerate(tokens)]
    data += [(len(tokens) + i, f"see {prefix}{_words(rng, 'base36', 40)} here") for i in range(400)]
    spans = _random_spans(spark, data)
    for encoding, _ in kinds:
        mine = [i for i, (_, e) in enumerate(tokens) if e == encoding]
        whole = [i for i in mine if any(a <= 4 + len(prefix) and b == 4 + len(prefix + tokens[i][0]) for a, b in spans[i])]
        assert len(whole) >= 0.9 * len(mine), (encoding, len(whole))
    assert sum(bool(spans[i]) for i in range(len(tokens), len(data))) <= 5


def test_parts_are_distinct_and_in_order(spark):
    a, b, c = "A" * 20, "b" * 25, "C" * 21
    row = spark.createDataFrame([(f"x {a}/{b}-k={c}== {a} short=1 {a}",)], "text string")
    got = [(s["start"], s["value"]) for s in row.select(secrets.candidates(F.col("text")).alias("c")).collect()[0]["c"]]
    assert got == [(2, a), (2, f"{a}/{b}"), (2, f"{a}/{b}-k"), (2, f"{a}/{b}-k={c}=="), (23, b), (23, f"{b}-k"), (51, f"{c}=="), (75, a), (104, a)]


def test_many_spans_keep_the_widest(spark):
    spans = [(i, i + 5, "random") for i in range(0, 6000, 5)] + [(0, 3000, "random"), (3, 9, "assign"), (2990, 3010, "hex")]
    items = sorted((a, -b, 3 if kind == "random" else 0, b, kind) for a, b, kind in spans)
    row = spark.createDataFrame([(items,), ([],)], "s array<struct<start:bigint,back:bigint,rank:int,end:bigint,kind:string>>")
    got = [[(s["start"], s["end"], s["kind"]) for s in r["o"]] for r in row.select(secrets.outermost(F.col("s")).alias("o")).collect()]
    want, top = [], -1
    for a, _, _, b, kind in items:
        if kind != "random" or b > top:
            want.append((a, b, kind))
        top = max(top, b)
    assert sorted(got, key=len) == [[], want]


def test_only_suspected_texts_meet_the_patterns(spark):
    runs = ["a" * 19, "b" * 20, "9f" * 15 + "c", "9f" * 16, "AKIA" + "Z" * 11, "AKIA" + "Z" * 12]
    assigned = [f"{key}{mid}{value}" for key in ("Password", "toKen", "API_key", "apikey", "toKen") for mid in ("=", "' : \"", " :  ") for value in ("v.x+567", "v.x+5678")]
    plain = ["", "word " * 600_000, "x" * 19 + "\n" + "y" * 19, "\U0001f600" * 30, "time: 12:30, a=b", None]
    texts = plain + [before + core + after for core in runs + assigned for before, after in (("", ""), ("\U0001f600 ", "."), ("one\ntwo ", "\nthree"))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    found = secrets.scan(docs)
    # the patterns' extractions work on the texts that are left, not on all
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all(_text" in plan and "regexp_extract_all(text" not in plan and "regexp_extract_all(coalesce(text" not in plan
    text = F.coalesce("text", F.lit(""))
    got = {r["doc_id"]: r for r in found.select("doc_id", secrets.suspected(text).alias("may"), F.size(secrets.candidates(text)).alias("n"), secrets.written(F.col("base")).alias("base")).collect()}
    for i, t in enumerate(texts):
        want = ",".join(brute.base_secrets(t or ""))
        assert got[i]["base"] == want and got[i]["may"] == bool(want or re.search("[A-Za-z0-9+/_=-]{20}", t or "") or "AKIA" in (t or "")), t
        assert (got[i]["n"] > 0) == bool(re.search("[A-Za-z0-9+/_=-]{20}", t or "")), t
