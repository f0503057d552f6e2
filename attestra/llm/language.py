"""Language identification by error-correcting output codes.

Every language has a codeword. For every bit of the code a binary classifier, naive Bayes over
hashed byte n-grams, tells the languages whose codeword has a 1 there from the others. A text is
decoded by loss-weighted decoding: the loss of each bit's margin against each codeword, weighted by
how reliable that bit is on that language, is summed, and the codeword of least loss wins. Two
codewords of nearly the same loss make the text ambiguous.

The model is fitted on a bounded sample of labelled rows (``sample`` rows a language, picked by a
hash of doc_id); every document is decoded from its whole text. ``und`` is given to a null text and
to one without a letter, with score 0. Null labels are not learned from. Without any labelled row
every document is ``und``. Repeated rows are decoded each by itself; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm import blocks as B

UNKNOWN = "und"
BUCKET_BITS = 15
ORDER = 3
_FOLD = B.LOWER.copy()
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A -1/1 row for each class: all two-way splits up to 7 classes, beyond that 15 bits for each
    doubling, the widest-spaced of 64 seeded draws."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        bits = np.arange(1, 1 << (n - 1))
        rows = [np.ones(len(bits))] + [np.where(bits >> j & 1, -1.0, 1.0) for j in range(n - 1)]
        return np.array(rows)
    rng = np.random.default_rng(seed)
    length = 15 * int(np.ceil(np.log2(n)))
    best, spaced = None, -1
    for _ in range(64):
        code = rng.choice([-1.0, 1.0], (n, length))
        code = code[:, np.abs(code.sum(0)) < n]
        apart = (code.shape[1] - code @ code.T) / 2
        np.fill_diagonal(apart, code.shape[1])
        if apart.min() > spaced:
            best, spaced = code, apart.min()
    return best


def grams(block: B.Block) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of the block's folded bytes, and bounds by text; a text is closed by
    a space on either side, so its first and last letters make n-grams too."""
    n = block.rows
    size = np.diff(block.cuts)
    cuts = block.cuts + 2 * np.arange(n + 1)
    data = np.full(cuts[-1], 32, np.uint8)
    place = np.arange(len(block.data)) + np.repeat(2 * np.arange(n) + 1, size)
    data[place] = _FOLD[block.data]
    value = data.astype(np.uint32)
    code = value[:-2] | value[1:-1] << np.uint32(8) | value[2:] << np.uint32(16)
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
    inside = np.ones(len(bucket), bool)
    inside[cuts[1:-1] - 1] = inside[cuts[1:-1] - 2] = False
    return bucket[inside], np.concatenate(([0], np.cumsum(size)))


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    trust: np.ndarray

    def margins(self, block: B.Block) -> np.ndarray:
        """Signed margin of every bit for every text: the mean log odds of its n-grams against
        their usual size, less for short texts."""
        bucket, bounds = grams(block)
        n = np.diff(bounds)
        out = np.zeros((block.rows, self.weights.shape[1]))
        some = n > 0
        if some.any():
            out[some] = np.add.reduceat(self.weights[bucket], bounds[:-1][some], axis=0)
        return out / np.maximum(n, 1)[:, None] / self.scale * np.sqrt(n / (n + 10.0))[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword, score and ambiguity of every row of margins."""
        loss = np.zeros((len(margins), len(self.languages)))
        for i in range(len(self.languages)):
            loss[:, i] = np.exp(-np.clip(self.code[i] * margins, -6, 6)) @ self.trust[i]
        best = loss.argmin(1)
        least = loss[np.arange(len(loss)), best]
        chance = np.exp(-4 * (loss - least[:, None]))
        score = 1 / chance.sum(1)
        rest = loss.copy()
        rest[np.arange(len(loss)), best] = np.inf
        second = rest.min(1) if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return best, score, second - least < 0.02 * least


def _sample(labelled: DataFrame, sample: int) -> tuple[DataFrame, list[str]]:
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row a language
    languages = sorted(sizes)
    if not languages:
        return labelled, []
    share = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, min(1.0, sample / sizes[lang])).otherwise(share)
    drawn = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1 << 20)) < share * (1 << 20)
    return labelled.where(drawn).select("text", "lang"), languages


def fit(labelled: DataFrame, sample: int = 4000) -> Model | None:
    """The model of rows (doc_id, text, lang), from about ``sample`` rows of each language."""
    chosen, languages = _sample(labelled.where(F.col("lang").isNotNull()), sample)
    if not languages:
        return None
    index = {lang: i for i, lang in enumerate(languages)}
    size = 1 << BUCKET_BITS

    def count(batches):
        total = np.zeros((len(languages), size), np.int64)
        for batch in batches:
            which = np.array([index[x] for x in batch.column("lang").to_pylist()], np.int64)
            for block in B.blocks(batch):
                bucket, bounds = grams(block)
                key = np.repeat(which[block.lo : block.hi], np.diff(bounds)) * size + bucket
                total += np.bincount(key, minlength=total.size).reshape(total.shape)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "n"])

    B.arrow_batches(labelled.sparkSession)
    found = chosen.mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(len(languages) * size)
    table[found["at"].to_numpy(np.int64)] = found["n"].to_numpy()
    table = table.reshape(len(languages), size)
    table = table / np.maximum(table.sum(1, keepdims=True), 1)
    code = codewords(len(languages))
    weights = np.zeros((size, code.shape[1]), np.float32)
    tiny = 1e-6
    for j in range(code.shape[1]):
        ones, zeros = code[:, j] > 0, code[:, j] < 0
        up = table[ones].mean(0) if ones.any() else table.mean(0)
        down = table[zeros].mean(0) if zeros.any() else table.mean(0)
        weights[:, j] = np.log((up + tiny) / (down + tiny))
    bits = code.shape[1]
    model = Model(languages, code, weights, np.ones(bits), np.ones(code.shape))

    def test(batches):
        right = np.zeros((len(languages), bits))
        wide, seen = np.zeros(bits), np.zeros(len(languages))
        for batch in batches:
            which = np.array([index[x] for x in batch.column("lang").to_pylist()], np.int64)
            for block in B.blocks(batch):
                margins, lang = model.margins(block), which[block.lo : block.hi]
                np.add.at(right, lang, margins * code[lang] > 0)
                np.add.at(seen, lang, 1)
                wide += np.abs(margins).sum(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([right.ravel().tolist()], pa.list_(pa.float64())), pa.array([wide.tolist()], pa.list_(pa.float64())), pa.array([seen.tolist()], pa.list_(pa.float64()))],
            ["right", "wide", "seen"],
        )

    tested = chosen.mapInArrow(test, "right array<double>, wide array<double>, seen array<double>")
    total = tested.select(
        *[
            F.array(*[F.sum(F.col(c)[i]) for i in range(n)]).alias(c)
            for c, n in (("right", code.size), ("wide", bits), ("seen", len(languages)))
        ]
    ).first()
    seen = np.array(total["seen"])
    right = (np.array(total["right"]).reshape(code.shape) + 1) / (seen[:, None] + 2)
    model.scale = np.maximum(np.array(total["wide"]) / max(seen.sum(), 1), 1e-6)
    model.trust = right / right.sum(1, keepdims=True)
    return model


def predict(docs: DataFrame, model: Model | None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, lang_pred, score and ambiguous of every row of ``docs``, from its text
    alone. A carried column of one of the new names gives way to it."""
    carried = [c for c in carry if c not in ("lang_pred", "score", "ambiguous")]
    text = F.coalesce("text", F.lit(""))
    if model is None:
        return docs.select(*carried, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    rows = docs.select(*carried, text.alias("__text"), text.rlike(r"\p{L}").alias("__spoken"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carried) + ", lang_pred string, score double, ambiguous boolean"
    names = np.array([*model.languages, UNKNOWN], object)

    def work(batches):
        for batch in batches:
            for block in B.blocks(batch, "__text"):
                best, score, near = model.decode(model.margins(block))
                mute = ~batch.column("__spoken").slice(block.lo, block.rows).to_numpy(zero_copy_only=False).astype(bool)
                best, score, near = np.where(mute, len(model.languages), best), np.where(mute, 0.0, score), near | mute
                old = [batch.column(c).slice(block.lo, block.rows) for c in carried]
                yield pa.RecordBatch.from_arrays([*old, pa.array(names[best], pa.string()), pa.array(score), pa.array(near)], [*carried, "lang_pred", "score", "ambiguous"])

    B.arrow_batches(docs.sparkSession)
    return rows.mapInArrow(work, schema)


def spoken(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` whose language is known and not ambiguous, all their columns as they were.
    Without a model no language can be told, and every row whose text has a letter stays."""
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    marks = ("lang_pred", "score", "ambiguous")
    kept = {f"__{i}": c for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(a) for a, c in kept.items()], F.col("text"))
    found = predict(renamed, model, tuple(kept)).where((F.col(marks[0]) != UNKNOWN) & ~F.col(marks[2]))
    return found.select(*[F.col(a).alias(c) for a, c in kept.items()])


def held_out(doc_id: Column) -> Column:
    """True for a document that no model learns from: crc32 of its id, as text, modulo 3 is 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1
