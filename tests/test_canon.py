"""Canonical JSON columns against plain Python."""

import hashlib
import json
import random
import struct

import pytest
from canonical import canonical, number_text
from pyspark.sql import functions as F

from attestra.functions import canon


def got(spark, texts, make=canon.canonical_json):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(4)
    return [r[0] for r in rows.withColumn("c", make(F.col("t"))).orderBy("i").select("c").collect()]


def test_numbers_as_ecmascript_prints_them(spark):
    rng = random.Random(1)
    numbers = [0.0, -0.0, 1.0, -1.5, 1e21, 1e20, 123456789012345680000.0, 1e-6, 1e-7, 5e-324, 1.7976931348623157e308, 2.2250738585072014e-308, 1e23, 9007199254740993.0, 5.6843418860808015e-14, 0.1 + 0.2, 4.35, 100.0, 2e-310]
    numbers += [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(300)] + [rng.randrange(-(10**6), 10**6) / 1000 for _ in range(100)]
    numbers = [x for x in numbers if x == x and abs(x) != float("inf")]
    assert got(spark, [json.dumps(x) for x in numbers]) == [number_text(x) for x in numbers]
    assert got(spark, ["123456789012345678901234567890", "1E2", "0.1000", "-12"]) == ["1.2345678901234568e+29", "100", "0.1", "-12"]


def value(rng, depth=0):
    kind = rng.randrange(8 if depth < 4 else 6)
    if kind == 0:
        return None
    if kind == 1:
        return rng.random() < 0.5
    if kind in (2, 3):
        return rng.choice([rng.randrange(-1000, 1000), rng.random() * 10 ** rng.randrange(-12, 25)])
    if kind in (4, 5):
        return "".join(rng.choice(["a", "Z", "1", " ", '"', "\\", "\\u001A", "/", "\n", "\x1f", "\x0b", "\x7f", "é", "€", "😀", "\ufffd", "-5", "e3"]) for _ in range(rng.randrange(6)))
    if kind == 6:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {"".join(rng.choice(["a", "b", "é", "€", "😀", "\ufffd", "A", "1", '"', " "]) for _ in range(rng.randrange(4))): value(rng, depth + 1) for _ in range(rng.randrange(5))}


def test_documents_equal_plain_python(spark):
    rng = random.Random(2)
    values = [value(rng) for _ in range(400)] + [{"z": 1, "a": {"y": 2.0, "x": [3, {"b": True, "a": None}]}}, {}, [], "", {"": {}}]
    texts = [json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2])) for v in values]
    assert got(spark, texts) == [canonical(v) for v in values]


def test_repeated_keys_and_broken_text(spark):
    assert got(spark, ['{"a":1,"b":{"c":1,"c":2},"a":3}', '{"a":', None, "nope"]) == ['{"a":3,"b":{"c":2}}', None, None, None]
    with pytest.raises(Exception, match="non-finite"):
        got(spark, ["[1, 2e999]"])
    assert got(spark, ['"2e999"']) == ['"2e999"']


def test_ids_do_not_depend_on_the_order_of_datasets(spark):
    sets = [{"datasetId": d, "logicalSourceId": s, "contentSha256": h, "rows": 1.0} for d, s, h in [("b", "x", "1"), ("a", "y", "2"), ("a", "x", "3"), ("a", "x", "1")]]
    make = lambda order: {"version": 1, "datasets": [sets[i] for i in order], "params": {"q": 2.50, "é": "😀"}, 'odd "key"': [1]}
    texts = [json.dumps(make(order)) for order in ([0, 1, 2, 3], [3, 2, 1, 0])]
    want = hashlib.sha256(canonical(make([3, 2, 1, 0])).encode()).hexdigest()
    assert got(spark, texts, canon.computation_id) == [want, want]
    bare = {"version": 1}
    assert got(spark, [json.dumps(bare), "x"], canon.computation_id) == [hashlib.sha256(canonical(bare).encode()).hexdigest(), None]


def test_long_strings_and_large_numbers(spark):
    long = json.dumps({"b": "x\\y" * 50_000, "a": 1.50})
    assert got(spark, [long]) == ['{"a":1.5,"b":"' + "x\\\\y" * 50_000 + '"}']
    assert got(spark, ["[9007199254740991, 9007199254740993, -0.0, 1e2, 1e-7]"]) == ["[9007199254740991,9007199254740992,0,100,1e-7]"]
