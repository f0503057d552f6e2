"""Token ids of whole texts by a vocabulary of the tokenizers library that drops white space.

The vocabulary lower-cases, splits at white space and inside it by a pattern, and merges each piece by
itself. So a text's ids are the ids of its pieces in order, and a piece that was seen before need not
be merged again: every worker keeps a bounded memory of pieces. All ids come from the library: pieces
of plain Latin letters from its model, words with other characters from its whole encoder, and texts
that hold one of its added tokens (or unusual control characters) go through it as they are. A file
whose normaliser, splitter or post-processing is another one goes through the library as a whole, too.
A null text is an empty one.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm import blocks as B
from attestra.llm import idfiles

# Fixed values of the vocabulary files this memory of pieces is right for.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = ["NFC", "Replace", "Lowercase"]
REMEMBERED = 1 << 20  # pieces a worker keeps; beyond it the memory starts anew
LONGEST = 256  # longer words are not kept

_LETTERS = "a-zªµºß-öø-ɏ"
_DIGITS = "0-9²³¹¼-¾"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\\s{_LETTERS}{_DIGITS}]+")
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-įı-ɏ]*")
_WORDS = re.compile("[^\t\n\r ]+")
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0]")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(spare)}


class Encoder:
    """Ids of texts, as little-endian unsigned integers of ``width`` bytes each."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.by_pieces = _as_expected(spec)
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}
        self.remembered = remembered

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def _whole(self, text: str) -> bytes:
        return self._packed(self.library.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return self._packed([token.id for token in self.library.model.tokenize(spelled)])

    def _joined(self, parts: list[str], make) -> bytes:
        known = self.known
        try:
            return b"".join([known[p] for p in parts])
        except KeyError:
            pass
        if len(known) > self.remembered:
            known.clear()
        out = []
        for part in parts:
            ids = known.get(part)
            if ids is None:
                ids = make(part)
                if len(part) <= LONGEST:
                    known[part] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_pieces or any(a in text for a in self.added):
            return self._whole(text)
        if _PLAIN.fullmatch(text):
            return self._joined(_PIECES.findall(text.lower()), self._piece)
        if _CONTROL.search(text):
            return self._whole(text)
        # a word here is between blanks, not between the splitter's breaks: a leading blank keeps its key apart
        return self._joined([" " + w for w in _WORDS.findall(text)], self._whole)


def _as_expected(spec: dict) -> bool:
    normal, before = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = before.get("pretokenizers") or [{}, {}]
    model = spec.get("model") or {}
    return (
        [n["type"] for n in normal.get("normalizers", [])] == NORMAL
        and len(steps) == 2
        and steps[0].get("pattern") == {"Regex": SPLIT}
        and (steps[0].get("behavior"), steps[0].get("invert")) == ("Removed", True)
        and (steps[1].get("type"), steps[1].get("add_prefix_space"), steps[1].get("use_regex")) == ("ByteLevel", False, False)
        and spec.get("post_processor") is None
        and spec.get("truncation") is None
        and spec.get("padding") is None
        and model.get("type") == "BPE"
        and model.get("dropout") is None
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
    )


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    """The encoder of a vocabulary; a plain name is looked up among the public ones of this machine."""
    if "/" not in name:
        import public_tokenizers

        name = public_tokenizers.path(name)
    return Encoder(name)


def encoded(name: str, end: int):
    """A task's work for ``mapInArrow``: (doc_id, ids) of rows (doc_id, text), ``end`` after each text."""

    def work(batches):
        book = encoder(name)
        close = np.array([end], f"<u{book.width}").tobytes()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids = [book.encode(t) + close for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return work


def write_ids(docs: DataFrame, folder: str, name: str, end: int, width: int = 2) -> dict:
    """Encode ``docs`` in ascending doc_id order into the shards of a new folder; return their manifest.

    Texts are dealt by id before they are encoded, so each is encoded once and its ids never travel;
    rows of one id are dealt on by content and place, so many of them do not meet in one task.
    """
    B.arrow_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = rows.withColumn("mark", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("doc_id"), F.asc("mark"), F.asc("place")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return idfiles.write(rows.mapInArrow(encoded(name, end), "doc_id bigint, ids binary"), folder, width)
