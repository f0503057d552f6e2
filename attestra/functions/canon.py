"""Canonical JSON (RFC 8785) as column expressions.

A parsed variant keeps the keys of every object in the order of their UTF-16 code units, and of repeated
keys the last, so writing it out again sorts a document at every depth. What is left are numbers and
escapes: the text is cut into tokens, numbers are written the way ECMAScript prints the double they
stand for, and control characters are escaped in lower case.

Null or malformed text gives null; a number beyond the range of doubles is an error, as canonical JSON
has no infinity.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra.functions.bind import let
from attestra.session import active

# A string, a number, or what stands between them.
TOKEN = r'"(?:[^"\\]++|\\.)*+"|-?\d++(?:\.\d++)?(?:[eE][+-]?\d++)?|[^"\d-]++'
SUBNORMAL = 2.2250738585072014e-308
WHOLE = 2.0**53
LARGE = r"[eE]\+?\d{3}|\d{200}"


def _parse(text: Column) -> Column:
    active().conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return F.try_parse_json(text)


def _shortest(d: Column) -> Column:
    """The fewest digits that give the double again, in scientific form."""

    def tried(p: int) -> Column:
        return let(F.format_string(f"%.{p}e", d), lambda text: F.when(text.cast("double") == d, text))

    few = lambda: F.coalesce(*[tried(p) for p in (14, 15, 16)])
    return F.when(d < SUBNORMAL, F.coalesce(*[tried(p) for p in range(17)])).otherwise(few())


def _written(digits: Column, point: Column) -> Column:
    """Digits with the decimal point after ``point`` of them, as ECMAScript writes numbers."""
    n, e = F.length(digits), point - 1
    fraction = F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise("")
    science = F.concat(F.substr(digits, F.lit(1), F.lit(1)), fraction, F.lit("e"), F.when(e >= 0, "+").otherwise("-"), F.abs(e).cast("string"))
    return (
        F.when((n <= point) & (point <= 21), F.concat(digits, F.repeat(F.lit("0"), point - n)))
        .when((point > 0) & (point <= 21), F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1)))
        .when((point > -6) & (point <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .otherwise(science)
    )


def _fraction(d: Column) -> Column:
    digits = lambda s: F.regexp_replace(F.regexp_replace(s, "(e.*$)|\\.", ""), "0+$", "")
    point = lambda s: F.regexp_extract(s, "e(.*)$", 1).try_cast("int") + 1
    parts = lambda s: F.struct(digits(s).alias("digits"), point(s).alias("point"))
    sign = F.when(d < 0, "-").otherwise("")
    return F.concat(sign, let(let(_shortest(F.abs(d)), parts), lambda x: _written(x["digits"], x["point"])))


def _number(d: Column) -> Column:
    # Whole numbers below 2^53 are their own digits.
    whole = d.cast("bigint")
    return F.when((F.abs(d) < WHOLE) & (whole == d), whole.cast("string")).otherwise(_fraction(d))


def _lower(text: Column) -> Column:
    """Escapes of control characters in lower case; an escaped backslash before them is none."""
    for digit in "ABCDEF":
        text = F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)\\u00([01])" + digit, r"$1\\u00$2" + digit.lower())
    return text


def _token(t: Column) -> Column:
    """A token as canonical JSON writes it: numbers by their doubles, escapes in lower case."""
    number = lambda d: F.when(d.isNull(), t).otherwise(_number(d))
    return (
        F.when(F.contains(t, F.lit("\\u00")), _lower(t))
        .when(F.substr(t, F.lit(1), F.lit(1)).isin(*"-0123456789"), let(t.try_cast("double"), number))
        .otherwise(t)
    )


def _canonical(text: Column, written: Column) -> Column:
    """``written``, the JSON of ``text`` with sorted keys, in canonical form; null if that is null."""
    # Only a number with an exponent of three digits, or with some hundred digits itself, can be beyond the doubles.
    beyond = F.exists(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: ~F.startswith(t, F.lit('"')) & (F.abs(t.try_cast("double")) == float("inf")))
    fault = F.raise_error(F.lit("canonical JSON has no non-finite numbers"))
    rewritten = lambda s: F.array_join(F.transform(F.regexp_extract_all(s, F.lit(TOKEN), F.lit(0)), _token), "")
    return let(written, lambda s: F.when(s.isNull(), F.lit(None)).when(F.rlike(text, F.lit(LARGE)) & beyond, fault).otherwise(rewritten(s)))


def canonical_json(text: Column) -> Column:
    """Canonical form of a JSON text."""
    return let(text, lambda t: _canonical(t, F.to_json(_parse(t))))


def computation_id(manifest_json: Column) -> Column:
    """SHA-256 of the canonical manifest, its datasets in the order of id, source and content hash."""
    order = lambda d: F.struct(*[F.try_variant_get(d, f"$.{k}", "string").alias(k) for k in ("datasetId", "logicalSourceId", "contentSha256")], F.to_json(d).alias("json"))
    name = lambda k: F.regexp_replace(F.to_json(F.array(k)), r"^\[|\]$", "")

    def whole(parts: Column) -> Column:
        datasets = F.array_sort(F.transform(F.try_variant_get(parts["datasets"], "$", "array<variant>"), order))
        listed = F.concat(F.lit("["), F.array_join(F.transform(datasets, lambda d: d["json"]), ","), F.lit("]"))
        value = lambda e: F.when(e["key"] == "datasets", F.coalesce(listed, F.to_json(e["value"]))).otherwise(F.to_json(e["value"]))
        entry = lambda e: F.concat(name(e["key"]), F.lit(":"), value(e))
        return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(parts), entry), ","), F.lit("}"))

    # The map has the keys in the variant's order, so nothing is left to sort.
    written = lambda t: let(F.try_variant_get(_parse(t), "$", "map<string,variant>"), whole)
    return F.sha2(let(manifest_json, lambda t: _canonical(t, written(t))), 256)
