"""Secret scans: fixed patterns, and a battery of randomness tests over token-like runs.

The base kinds are regular expressions, leftmost and non-overlapping for each kind; an assignment
whose value is short is dropped after matching. (Of the other two kinds only a maximal run can
match, so their least length stands in the pattern.) Beside them every run of token characters of
``MIN_RUN`` or more is a candidate, and so are its parts of that length between the separators of
``CUTS``: a name, path or URL may be glued to a token. The encoding of each is inferred from its
characters (hex, base32, base36, base62, base64), and three
tests compare it with a uniform draw from that alphabet: chi-squared of its character counts, the
number of runs above and below the middle of the alphabet, and the lag-1 serial correlation of its
characters. A candidate that any of the three rejects is no random string. For the others the
evidence is the likelihood ratio of a uniform draw to word-like text, in which a character depends
on the class (lower, upper, digit, other) of the one before it and has its class's word shares. A
candidate has to beat two word models, a fixed one and the one of the corpus's own rejected
candidates. Under either, a ratio of L or more has a probability of 1 / L at most, at every length,
so 1 / L is the p-value. Those go through Benjamini-Hochberg in each (encoding, length) stratum,
over all candidates of the corpus, so the share of false finds is held at ``fdr`` among short and
among long ones alike.

p-values are counted in ``BINS`` logarithmic bins a stratum; the threshold of a stratum is the
largest bin edge that passes, which is never laxer than the exact rule. Bins times strata is all
that reaches the driver. Everything runs in SQL functions.

A text goes to the patterns only if it is ``suspected``: quick tests, each of which every text with a
span of its kind passes. They decide nothing else. Places of matches come from one extraction and one
split, and character sets are spelled out, which regular expressions look up and need not compare.

Null and empty texts have no spans. Repeated rows are scanned each by itself, ties (spans that start
together) are ordered by kind, an empty table gives an empty result, other columns are kept as
they are.
"""

from __future__ import annotations

from math import log
from string import ascii_lowercase, ascii_uppercase, digits

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.session import cut_lineage

_ALNUM = ascii_uppercase + ascii_lowercase + digits
_TOKEN = f"{_ALNUM}+/_=-"
_VALUE = f"[{_ALNUM}+/_.=-]"
_VALUE_MIN = 8
KINDS = {
    "assign": (rf"""(?=[apstAPST])(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?({_VALUE}+)""", 2, _VALUE_MIN),
    "access": ("AKIA[A-Z0-9]{12,}", 0, 0),
    "hex": ("[0-9a-f]{32,}", 0, 0),
}
MIN_RUN = 20
RANDOM = "random"
RUN_PATTERN = f"[{_TOKEN}]{{{MIN_RUN},}}"
# Whether a text has such a run, in one walk without a step back: shorter runs and what parts them, then a run.
HAS_RUN = rf"\A(?:[{_TOKEN}]{{0,{MIN_RUN - 1}}}+[^{_TOKEN}]++)*+[{_TOKEN}]{{{MIN_RUN}}}"
HAS_VALUE = rf"""[:=]\x20*["']?{_VALUE}{{{_VALUE_MIN}}}"""
# Parts of a run: cut at '=', and at none, one or both of the separators that base64 and base64url have as letters.
CUTS = [f"[{_ALNUM}+{letters}]{{{MIN_RUN},}}(?:=+$)?" for letters in ("/_-", "_-", "/", "")]
BINS = 512
BINS_A_DECADE = 16
_CHUNK = 256

ALPHABETS = {
    "hex": ("^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    "base32": ("^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base36": ("^(?:[a-z0-9]+|[A-Z0-9]+)$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    "base62": ("^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    "base64": ("^[A-Za-z0-9+/_=-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
}
# Word-like text: shares of letters (per mille, a to z), and for each class of character the next one's (lower, upper, digit, other).
LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
NEXT_CLASS = ((0.80, 0.05, 0.03, 0.12), (0.30, 0.60, 0.05, 0.05), (0.08, 0.05, 0.75, 0.12), (0.60, 0.15, 0.15, 0.10))
FLOOR = 0.05  # of each share is uniform
LEAST_LETTERS = 2000  # the corpus has a word model of an encoding from so many letters on
_START = 4
_WIDTH = 64


def _cumulated(items: Column) -> Column:
    """Running starts of items (gap, size, ...): in chunks, so that long lists stay linear."""

    def chunk(first: Column) -> Column:
        return F.slice(items, first * _CHUNK + 1, F.lit(_CHUNK))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _CHUNK).cast("int")), chunk)
    zero = F.lit(0).cast("bigint")
    totals = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda s, x: s + x["gap"] + x["size"]))
    starts = F.aggregate(totals, F.array(zero), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))

    def spans(part: Column, start: Column) -> Column:
        none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
        done = F.aggregate(
            part,
            F.struct(start.alias("at"), none.alias("spans")),
            lambda s, x: F.struct(
                (s["at"] + x["gap"] + x["size"]).alias("at"),
                F.concat(
                    s["spans"],
                    F.array(F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["size"]).alias("end"), x["value"].alias("value"))),
                ).alias("spans"),
            ),
        )
        return done["spans"]

    return F.flatten(F.zip_with(chunks, F.slice(starts, F.lit(1), F.size(chunks)), spans))


def matches(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """array<struct<start, end, value>> of a pattern's matches in code points, end exclusive.

    The texts between matches and the matches themselves give every place; matches whose ``group``
    has fewer than ``least`` characters are dropped after matching.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("p")] if group else []

    def items(x: Column) -> Column:
        return F.transform(
            F.arrays_zip(x["w"].alias("w"), (x["p"] if group else x["w"]).alias("p"), F.slice(x["b"], F.lit(1), F.size(x["w"])).alias("b")),
            lambda y: F.struct(F.char_length(y["b"]).cast("bigint").alias("gap"), F.char_length(y["w"]).cast("bigint").alias("size"), y["p"].alias("value")),
        )

    # as fields and elements of arrays of one, so that what is used more than once is worked out once
    once = F.transform(F.array(F.struct(whole.alias("w"), F.split(text, pattern, -1).alias("b"), *parts)), items)
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    found = F.when(text.rlike(HAS_RUN if pattern == RUN_PATTERN else pattern), F.flatten(F.transform(once, _cumulated))).otherwise(none)
    return F.filter(found, lambda s: F.char_length(s["value"]) >= least) if least else found


def suspected(text: Column) -> Column:
    """Whether a text may have spans: a long run (which hex digits are too), an access key's mark, or an assigned value."""
    assigns = (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(HAS_VALUE) & text.rlike(KINDS["assign"][0])
    return F.contains(text, F.lit("AKIA")) | assigns | text.rlike(HAS_RUN)


def _normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal: Abramowitz and Stegun 26.2.17, error under 1e-7."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = poly * F.exp(-x * x / 2) / 2.5066282746310002
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _tail_of_chi(statistic: Column, freedom: Column) -> Column:
    """P(X > statistic) of a chi-squared: Wilson and Hilferty's cube root."""
    spread = 2 / (9 * freedom)
    return _normal_tail((F.pow(statistic / freedom, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread))


def encoding(token: Column) -> Column:
    """The narrowest alphabet, in the order of ALPHABETS, that the token's characters fit."""
    out = F.lit("base64")
    for name in reversed(list(ALPHABETS)):
        out = F.when(token.rlike(ALPHABETS[name][0]), name).otherwise(out)
    return out


def _alphabet(kind: Column) -> Column:
    out = F.lit(ALPHABETS["base64"][1])
    for name, (_, letters) in ALPHABETS.items():
        out = F.when(kind == name, letters).otherwise(out)
    return out


def _letters(token: Column, kind: Column) -> Column:
    """The token's places in its alphabet, padding left out."""
    plain = F.translate(F.rtrim(token, F.lit("=")), "-_", "+/")
    folded = F.when(kind.isin("hex", "base36"), F.lower(plain)).otherwise(plain)
    alphabet = _alphabet(kind)
    return F.filter(F.transform(F.split(folded, ""), lambda c: F.instr(alphabet, c) - 1), lambda i: i >= 0)


def _class_of(letter: str) -> int:
    return 0 if letter.islower() else 1 if letter.isupper() else 2 if letter.isdigit() else 3


CLASSES = {name: [_class_of(c) for c in letters] for name, (_, letters) in ALPHABETS.items()}


def _code(kind: Column) -> Column:
    out = F.lit(-1)
    for i, name in enumerate(ALPHABETS):
        out = F.when(kind == name, i).otherwise(out)
    return out


def _literals(values: list) -> Column:
    """An array of numbers, written as one expression: a call for each takes the driver longer than the job."""
    return F.expr(f"array({', '.join(f'{v!r}D' if isinstance(v, float) else str(v) for v in values)})")


def _classes(x: Column) -> Column:
    """The classes of a candidate's letters, with _START before them."""
    table = _literals([c for classes in CLASSES.values() for c in classes + [3] * (_WIDTH - len(classes))])
    return F.concat(F.array(F.lit(_START)), F.transform(x["at"], lambda a: F.get(table, x["code"] * _WIDTH + a)))


def _pairs(x: Column) -> Column:
    return F.arrays_zip(F.slice(x, F.lit(1), F.size(x) - 1).alias("a"), F.slice(x, F.lit(2), F.size(x) - 1).alias("b"))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def battery(docs: DataFrame, column: str) -> DataFrame:
    """Replaces an array of struct<start, end, value> by the same with the tests' results.

    Fields added: encoding, its code, at (places of the letters), n and k (letters of token and
    alphabet), evenness (the chi-squared statistic), p_uniform, p_runs, p_serial. Each step adds fields to the struct, so that no
    statistic is worked out twice.
    """
    fields = ["start", "end", "value"]

    def add(rows: DataFrame, **new) -> DataFrame:
        def extend(x: Column) -> Column:
            return F.struct(*[x[f].alias(f) for f in fields], *[make(x).alias(name) for name, make in new.items()])

        rows = rows.withColumn(column, F.transform(column, extend))
        fields.extend(new)
        return rows

    rows = add(docs, encoding=lambda x: encoding(x["value"]))
    rows = add(rows, at=lambda x: _letters(x["value"], x["encoding"]), code=lambda x: _code(x["encoding"]), k=lambda x: F.char_length(_alphabet(x["encoding"])).cast("double"))
    rows = add(
        rows,
        n=lambda x: F.size(x["at"]).cast("double"),
        high=lambda x: F.transform(x["at"], lambda a: (a >= x["k"] / 2).cast("double")),
        mean=lambda x: _total(F.transform(x["at"], lambda a: a.cast("double"))) / F.size(x["at"]),
        squares=lambda x: _total(
            F.transform(F.array_distinct(x["at"]), lambda a: F.pow(F.size(F.filter(x["at"], lambda b: b == a)).cast("double"), F.lit(2.0)))
        ),
    )
    rows = add(
        rows,
        evenness=lambda x: F.greatest(x["squares"] * x["k"] / x["n"] - x["n"], F.lit(0.0)),
        ups=lambda x: _total(x["high"]),
        changes=lambda x: F.size(F.filter(_pairs(x["high"]), lambda p: p["a"] != p["b"])).cast("double") + 1,
        spread=lambda x: _total(F.transform(x["at"], lambda a: F.pow(a - x["mean"], F.lit(2.0)))),
        lag=lambda x: _total(F.transform(_pairs(x["at"]), lambda p: (p["a"] - x["mean"]) * (p["b"] - x["mean"]))),
    )
    rows = add(
        rows,
        expected=lambda x: 2 * x["ups"] * (x["n"] - x["ups"]) / x["n"] + 1,
        serial=lambda x: F.coalesce(x["lag"] / F.nullif(x["spread"], F.lit(0.0)), F.lit(1.0)),
    )
    rows = add(
        rows,
        run_z=lambda x: F.abs(x["changes"] - x["expected"])
        / F.sqrt(F.nullif(F.greatest((x["expected"] - 1) * (x["expected"] - 2) / (x["n"] - 1), F.lit(0.0)), F.lit(0.0))),
        serial_z=lambda x: F.abs(x["serial"] + 1 / x["n"]) * F.sqrt(x["n"]),
    )
    fields_out = ("start", "end", "value", "encoding", "code", "at", "n", "k", "evenness")
    return rows.withColumn(
        column,
        F.transform(
            column,
            lambda x: F.struct(
                *[x[f].alias(f) for f in fields_out],
                _tail_of_chi(x["evenness"], x["k"] - 1).alias("p_uniform"),
                F.coalesce(2 * _normal_tail(x["run_z"]), F.lit(0.0)).alias("p_runs"),
                F.coalesce(2 * _normal_tail(x["serial_z"]), F.lit(0.0)).alias("p_serial"),
            ),
        ),
    )


def _rejected(x: Column, alpha: float) -> Column:
    """Whether the battery, over its three tests, rejects a uniform draw."""
    return F.coalesce(F.least(x["p_uniform"], x["p_runs"], x["p_serial"]) < alpha / 3, F.lit(True))


def _normal(weights: list[float]) -> list[float]:
    return [w / sum(weights) for w in weights]


def _model(name: str, counts: dict[tuple[int, int], int]) -> tuple[list[float], list[list[float]]]:
    """Word-like text of an alphabet: each letter's share in its class, and the classes' next ones.

    ``counts`` are of (class before, place of the letter); classes and rows without any keep the
    fixed shares.
    """
    letters, classes = ALPHABETS[name][1], CLASSES[name]
    present = sorted(set(classes))
    share = [0.0] * len(letters)
    for c in present:
        places = [i for i in range(len(letters)) if classes[i] == c]
        fixed = [LETTERS[ord(letters[i].lower()) - 97] if c < 2 else 1.0 for i in places]
        seen = [float(sum(n for (_, at), n in counts.items() if at == i)) for i in places]
        for i, w in zip(places, _normal(seen if sum(seen) >= LEAST_LETTERS else fixed), strict=True):
            share[i] = (1 - FLOOR) * w + FLOOR / len(places)
    following = []
    for a in range(4):
        seen = [float(sum(n for (before, at), n in counts.items() if before == a and classes[at] == c)) for c in present]
        row = _normal(seen if sum(seen) >= LEAST_LETTERS else [NEXT_CLASS[a][c] for c in present])
        row = {c: (1 - FLOOR) * w + FLOOR / len(present) for c, w in zip(present, row, strict=True)}
        following.append([row.get(c, 1.0) for c in range(4)])
    # The first letter's class is no evidence.
    following.append([max(classes.count(c), 1) / len(letters) for c in range(4)])
    return share, following


def word_models(tested: DataFrame, alpha: float) -> list[dict]:
    """The fixed word model, and the one of the candidates that the battery rejects. Those with a
    separator inside are left out, as their parts may be random."""
    x = F.col("x")
    words = tested.where(_rejected(x, alpha) & ~x["value"].rlike("[=/_-]"))
    steps = words.select("x.encoding", F.explode(F.arrays_zip(F.slice(_classes(x), F.lit(1), F.size("x.at")).alias("a"), x["at"].alias("b"))).alias("y"))
    rows = steps.groupBy("encoding", "y.a", "y.b").count().collect()  # 5 encodings, 5 classes, 64 letters at most
    counts = {name: {(r["a"], r["b"]): r["count"] for r in rows if r["encoding"] == name} for name in ALPHABETS}
    return [{name: _model(name, {}) for name in ALPHABETS}, {name: _model(name, counts[name]) for name in ALPHABETS}]


def _log_ratio(x: Column, model: dict) -> Column:
    weight, step = [], []
    for share, following in model.values():
        k = len(share)
        weight += [-log(k * w) for w in share] + [0.0] * (_WIDTH - k)
        step += [-log(w) for row in following for w in row]
    weights, steps = _literals(weight), _literals(step)
    letters = F.transform(x["at"], lambda a: F.get(weights, x["code"] * _WIDTH + a))
    classes = F.transform(_pairs(_classes(x)), lambda p: F.get(steps, x["code"] * 20 + p["a"] * 4 + p["b"]))
    return _total(letters) + _total(classes)


def _evidence(x: Column, models: list[dict]) -> Column:
    """Log of the likelihood ratio of a uniform draw to the likelier of the word models."""
    return F.least(*[_log_ratio(x, model) for model in models])


def _p_words(x: Column, models: list[dict], alpha: float) -> Column:
    """p-value of a likelihood ratio this high under word-like text; 1 if the battery rejects."""
    return F.when(_rejected(x, alpha), 1.0).otherwise(F.least(F.exp(-_evidence(x, models)), F.lit(1.0)))


def _stratum(x: Column) -> Column:
    return F.concat_ws(":", x["encoding"], F.least(F.floor(F.log2(F.greatest(x["n"], F.lit(1.0)))), F.lit(12)).cast("string"))


def _bin(p: Column) -> Column:
    """Bin b holds p in (10^-((b + 1) / BINS_A_DECADE), 10^-(b / BINS_A_DECADE)]."""
    return F.least(F.floor(-BINS_A_DECADE * F.log10(F.greatest(p, F.lit(1e-40)))), F.lit(BINS - 1)).cast("int")


def thresholds(tested: DataFrame, models: list[dict], fdr: float, alpha: float) -> dict[str, int]:
    """For each stratum the lowest bin whose p-values all pass Benjamini-Hochberg."""
    x = F.col("x")
    rows = tested.groupBy(_stratum(x).alias("stratum"), _bin(_p_words(x, models, alpha)).alias("bin")).count().collect()  # strata times BINS at most
    out = {}
    for name in {r["stratum"] for r in rows}:
        bins = sorted(((r["bin"], r["count"]) for r in rows if r["stratum"] == name), reverse=True)
        total, seen = sum(n for _, n in bins), 0
        for b, n in bins:
            seen += n
            if 10.0 ** (-b / BINS_A_DECADE) <= fdr * seen / total:
                out[name] = b
    return out


def candidates(text: Column) -> Column:
    """array<struct<start, end, value>> of the runs and of their parts, in order, each once."""

    def shifted(run: Column, pattern: str) -> Column:
        return F.transform(
            matches(run["value"], pattern), lambda x: F.struct((run["start"] + x["start"]).alias("start"), (run["start"] + x["end"]).alias("end"), x["value"].alias("value"))
        )

    def split(run: Column) -> Column:
        return F.when(run["value"].rlike("[=/_-]"), F.concat(F.array(run), *[shifted(run, p) for p in CUTS])).otherwise(F.array(run))

    found = F.array_sort(F.flatten(F.transform(matches(text, RUN_PATTERN), split)))
    before = F.concat(F.array(F.lit(None).cast("struct<start:bigint,end:bigint,value:string>")), found)
    again = F.zip_with(found, before, lambda x, y: F.when(y.isNull() | (x["start"] != y["start"]) | (x["end"] != y["end"]), x))
    return F.filter(again, lambda x: x.isNotNull())


def outermost(spans: Column) -> Column:
    """The spans (start, back, rank, end, kind), sorted, without the random ones that lie inside an
    earlier one; ``back`` is minus the end, so that the wider of two comes first. In chunks, so that
    long lists stay linear."""

    def chunk(first: Column) -> Column:
        return F.slice(spans, first * _CHUNK + 1, F.lit(_CHUNK))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(spans) - 1, F.lit(0))) / _CHUNK).cast("int")), chunk)
    none = F.lit(-1).cast("bigint")
    tops = F.transform(chunks, lambda c: F.coalesce(F.array_max(F.transform(c, lambda x: x["end"])), none))
    reached = F.aggregate(tops, F.array(none), lambda s, x: F.concat(s, F.array(F.greatest(F.element_at(s, -1), x))))

    def keep(part: Column, start: Column) -> Column:
        empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
        done = F.aggregate(
            part,
            F.struct(start.alias("top"), empty.alias("kept")),
            lambda s, x: F.struct(
                F.greatest(s["top"], x["end"]).alias("top"),
                F.when((x["kind"] == RANDOM) & (x["end"] <= s["top"]), s["kept"])
                .otherwise(F.concat(s["kept"], F.array(F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))))
                .alias("kept"),
            ),
        )
        return done["kept"]

    return F.flatten(F.zip_with(chunks, F.slice(reached, F.lit(1), F.size(chunks)), keep))


def scan(docs: DataFrame, fdr: float = 0.05, alpha: float = 0.001) -> DataFrame:
    """``docs`` with ``base`` and ``secrets``: array<struct<start, rank, end, kind>> of the base spans
    and of all spans, in order of start and rank. A random span inside a base one, or inside a wider
    random one, is not repeated."""
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")

    def spans(found: Column, rank: int, kind: str) -> Column:
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    text = F.coalesce("text", F.lit(""))
    runs = battery(docs.select(text.alias("text")).where(F.col("text").rlike(HAS_RUN)).select(candidates(F.col("text")).alias("runs")), "runs")
    tested = cut_lineage(runs.select(F.explode("runs").alias("x")))
    models = word_models(tested, alpha)
    limits = thresholds(tested, models, fdr, alpha)

    def random(x: Column) -> Column:
        known = F.create_map(*[F.lit(v) for pair in sorted(limits.items()) for v in pair])
        return _bin(_p_words(x, models, alpha)) >= F.coalesce(known[_stratum(x)], F.lit(BINS)) if limits else F.lit(False)

    held = F.col("_text")
    base = F.array_sort(F.concat(*[spans(matches(held, *rule), i, kind) for i, (kind, rule) in enumerate(KINDS.items())]))
    docs = docs.withColumn("_text", F.when(suspected(text), text).otherwise(F.lit("")))
    rows = battery(docs.withColumn("_runs", candidates(held)).withColumn("base", F.coalesce(base, none)).drop("_text"), "_runs")
    found = F.concat("base", spans(F.filter("_runs", random), len(KINDS), RANDOM))
    wide = F.array_sort(F.transform(found, lambda s: F.struct(s["start"], (-s["end"]).alias("back"), s["rank"], s["end"], s["kind"])))
    rows = rows.withColumn("_found", wide)
    return rows.withColumn("secrets", F.array_sort(outermost(F.col("_found")))).drop("_runs", "_found")


def redact(text: Column, secrets: Column, mark: str = "[SECRET]") -> Column:
    """The text with every run of overlapping spans replaced by a mark."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def merge(s: Column, x: Column) -> Column:
        last = F.element_at(s, -1)
        joined = F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        fresh = F.concat(s, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))
        return F.when((F.size(s) > 0) & (F.coalesce(F.get(s, F.size(s) - 1)["end"], F.lit(-1)) > x["start"]), joined).otherwise(fresh)

    gone = F.aggregate(secrets, none, merge)
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(gone, lambda x: x["end"]))
    starts = F.concat(F.transform(gone, lambda x: x["start"]), F.array(F.char_length(text).cast("bigint")))
    kept = F.zip_with(ends, starts, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    return F.when(F.size(secrets) > 0, F.array_join(kept, mark)).otherwise(text)


def written(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
