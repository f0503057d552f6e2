"""Best-fit packing of token pieces under several capacities at once.

A bin holds at most ``tokens`` tokens, ``documents`` pieces and ``attention`` (the sum of squared
piece lengths). Pieces are dealt by hash into groups of about ``group`` pieces, and each group is
packed by itself in one task: pieces in falling order of length, each into the open bin that
satisfies every constraint and scores best, either the largest weighted dot product of the piece's
needs and the bin's residual (``dot``) or the least weighted norm of what would be left (``norm``).
A group leaves at most a few bins part empty, so many bounded groups cost next to nothing and no
task ever sees more than a group.

Tokens: byte-level BPE ids read from a tokenizers file; texts that hold one of its special strings go
through the tokenizers library itself, all others through the same merges in tiktoken. A null text
is an empty one; with the closing id every document has a token at least. Pieces of repeated rows
are packed each by itself, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm import blocks as B
from attestra.session import cut_lineage

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(spare)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from texts to id arrays, ids as the tokenizers library gives them."""
    import tiktoken
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    spec = json.load(open(path, encoding="utf-8"))
    special = [t["content"] for t in spec["added_tokens"]]
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode


def pieces(docs: DataFrame, path: str, limit: int = 2048, closing: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and a closing id, longer ones
    cut into pieces of ``limit`` ids with what is over in the first."""

    def work(batches):
        encode = encoder(path)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(closing)).astype("<u4")
                ends = range((len(ids) - 1) % limit + 1, len(ids) + 1, limit)
                begin = 0
                for i, end in enumerate(ends):
                    out.append((doc, i, begin, end - begin, zlib.crc32(ids[begin:end].tobytes())))
                    begin = end
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    B.arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(work, PIECES)


def best_fit(lengths: np.ndarray, tokens: int, documents: int, attention: int, weights: tuple[float, float, float], score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece, in the order given (falling lengths pack best)."""
    full = np.array([tokens, documents, attention], float)
    unit = np.array(weights, float) / full**2
    left = np.empty((len(lengths), 3))
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    count, open_bins = 0, np.empty(0, np.int64)
    for i, length in enumerate(lengths.tolist()):
        need = np.array([length, 1.0, float(length) * length])
        rest = left[open_bins]
        fits = (rest[:, 0] >= length) & (rest[:, 1] >= 1) & (rest[:, 2] >= need[2])
        if fits.any():
            after = rest - need
            value = (after * after) @ unit if score == "norm" else -(rest @ (unit * need))
            value[~fits] = np.inf
            at = int(value.argmin())
            chosen = open_bins[at]
        else:
            chosen, at = count, -1
            left[chosen] = full
            count += 1
        bins[i], offsets[i] = chosen, tokens - left[chosen, 0]
        left[chosen] -= need
        still = (left[chosen] >= [1, 1, 1]).all()
        if at < 0 and still:
            open_bins = np.append(open_bins, chosen)
        elif at >= 0 and not still:
            open_bins = np.delete(open_bins, at)
    return bins, offsets


def pack(
    found: DataFrame,
    tokens: int = 2048,
    documents: int = 2048,
    attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
    score: str = "norm",
    group: int = 16384,
) -> DataFrame:
    """Adds sequence_id and offset to pieces. Needs every piece to fit an empty bin."""
    attention = tokens * tokens if attention is None else attention
    found = cut_lineage(found)
    groups = max(1, -(-found.count() // group))
    salt = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = found.withColumn("part", F.pmod(salt, F.lit(groups)))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], na_position="first")
        bins, offsets = best_fit(pdf["length"].to_numpy(np.int64), tokens, documents, attention, weights, score)
        return pdf.assign(sequence_id=(pdf["part"].to_numpy(np.int64) << 32) + bins, offset=offsets).drop(columns="part")

    return dealt.groupBy("part").applyInPandas(work, PIECES + ", sequence_id bigint, offset bigint")
