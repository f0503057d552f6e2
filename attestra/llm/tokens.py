"""Token counts by a tokenizer compiled into a finite-state transducer.

A piece vocabulary with merge scores encodes a word greedily by merges. The last token of the
encoding of each prefix of a word is unique, and a token may follow another exactly if the two,
joined and encoded, come out as the two again. So one pass over the characters suffices: a state
holds the places from which a token can still grow (its node in the vocabulary's trie, the token
before it, how many tokens fewer lay before it), and each transition says by how much the number
of emitted tokens changes; it is negative where tokens merge. States and transitions are compiled
when first met and dropped when they reach ``STATES``. Words of several spaces (whose merges tie)
and words no state explains are merged directly.

No token crosses from a character to a following space, so texts fall into words, equal words of a
block are counted once, and a text may be cut anywhere: the map of a chunk is its open first word,
the count of the closed words between, and its open last word. Maps compose associatively; texts
longer than ``chunk`` bytes are cut, their chunks mapped in parallel and the maps composed by a
prefix scan.

A null text is an empty one and has no tokens. Texts that hold the space mark itself are counted by
the library. Repeated rows are counted each by itself, an empty table gives an empty result, other
columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm import blocks as B

MARK = "▁"
STATES = 250_000
WORDS = 200_000
START = -1
_SPACE = 0x20


class Transducer:
    """Counts of the tokens of words, for a sentencepiece BPE model."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        special = {i for i in range(size) if self.library.is_unknown(i) or self.library.is_control(i) or self.library.is_byte(i)}
        self.text = [self.library.id_to_piece(i) for i in range(size)]
        self.token = {t: i for i, t in enumerate(self.text) if i not in special}
        self.score = [self.library.get_score(i) for i in range(size)]
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        for t, i in self.token.items():
            node = 0
            for c in t:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(-1)
                node = self.next[node][c]
            self.ends[node] = i
        self.exact = all(c in self.token for t in self.token for c in t)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = [((0, START, 0),)]
        self.index = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def merged(self, word: str) -> list[str]:
        """The symbols of a word after all merges: best score first, leftmost among equals."""
        symbols = list(word)
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                token = self.token.get(symbols[i] + symbols[i + 1])
                if token is not None and (best is None or self.score[token] > best):
                    best, at = self.score[token], i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def direct(self, word: str) -> int:
        """Tokens of a word by the merges themselves; long words are left to the library."""
        if len(word) > 64:
            return len(self.library.encode(word.removeprefix(MARK).replace(MARK, " ")))
        return sum(1 if s in self.token else len(s.encode()) for s in self.merged(word))

    def follows(self, left: int, right: int) -> bool:
        if left == START:
            return True
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= 2 * STATES:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(self.text[left] + self.text[right]) == [self.text[left], self.text[right]]
        return known

    def compile(self, state: int, char: str) -> tuple[int, int] | None:
        """The transition of a state on a character: next state and change of the count."""
        live = self.states[state]
        if char not in self.next[0]:
            grown, delta, last = [], len(char.encode()), START
        else:
            grown, found = [], []
            for node, before, behind in live:
                child = self.next[node].get(char)
                if child is not None:
                    token = self.ends[child]
                    if token >= 0 and self.follows(before, token):
                        found.append((token, behind + 1))
                    if self.next[child]:
                        grown.append((child, before, behind))
            if len(found) != 1:
                return None
            last, delta = found[0]
        key = (*((node, before, behind - delta) for node, before, behind in grown), (0, last, 0))
        to = self.index.get(key)
        if to is None:
            to = self.index[key] = len(self.states)
            self.states.append(key)
        self.moves[state << 21 | ord(char)] = to, delta
        return to, delta

    def count(self, word: str) -> int:
        """Tokens of one word, its leading spaces written as marks."""
        if not self.exact or word.startswith(MARK + MARK):
            return self.direct(word)
        if len(self.states) > STATES:
            self.clear()
        state = total = 0
        moves = self.moves
        for char in word:
            move = moves.get(state << 21 | ord(char)) or self.compile(state, char)
            if move is None:
                return self.direct(word)
            state, delta = move
            total += delta
        return total


class Counter:
    """Counts of whole texts; keeps the transducer and the words met last."""

    def __init__(self, path: str):
        self.transducer = Transducer(path)
        self.words: dict[int, int] = {}

    def word(self, raw: bytes) -> int:
        return self.transducer.count(raw.decode().replace(" ", MARK)) if raw else 0

    def block(self, block: B.Block) -> np.ndarray:
        """Tokens of each text of a block."""
        n, size = block.rows, np.diff(block.cuts)
        cuts = block.cuts + np.arange(n + 1)
        data = np.full(cuts[-1], _SPACE, np.uint8)
        data[np.arange(len(block.data)) + np.repeat(np.arange(n) + 1, size)] = block.data
        space = data == _SPACE
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[cuts[:-1]] = True
        begin = np.flatnonzero(first)
        bounds = np.searchsorted(begin, cuts)
        end = np.append(begin[1:], len(data))
        keys, at, inverse = np.unique(B.Prefix(data).of(begin, end), return_index=True, return_inverse=True)
        if len(self.words) > WORDS:
            self.words.clear()
        raw, known = data.tobytes(), self.words
        counts = np.empty(len(keys), np.int64)
        for i, (key, a, b) in enumerate(zip(keys.tolist(), begin[at].tolist(), end[at].tolist(), strict=True)):
            n_tokens = known.get(key)
            if n_tokens is None:
                n_tokens = known[key] = self.word(raw[a:b])
            counts[i] = n_tokens
        out = B.sums(counts[inverse], bounds)
        out[size == 0] = 0
        if bytes(MARK, "utf-8") in raw:
            for i in range(n):
                text = block.data[block.cuts[i] : block.cuts[i + 1]].tobytes().decode()
                if MARK in text:
                    out[i] = len(self.transducer.library.encode(text))
        return out

    def chunk_map(self, raw: bytes) -> tuple[bytes, int, bytes | None]:
        """(open first word, tokens of closed words, open last word); one open word: last is None."""
        data = np.frombuffer(raw, np.uint8)
        space = data == _SPACE
        breaks = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        if not len(breaks):
            return raw, 0, None
        inner = sum(self.word(raw[a:b]) for a, b in zip(breaks[:-1].tolist(), breaks[1:].tolist(), strict=True))
        return raw[: breaks[0]], inner, raw[breaks[-1] :]

    def compose(self, left: tuple, right: tuple) -> tuple:
        """The map of two neighbouring chunks."""
        a, n, b = left
        c, m, d = right
        tail = a if b is None else b
        if tail and c and tail[-1] != _SPACE and c[0] == _SPACE:  # a word ends between them
            if b is None:
                return (a, n + m + self.word(c), d) if d is not None else (a, n + m, c)
            closed = n + m + self.word(b)
            return (a, closed + self.word(c), d) if d is not None else (a, closed, c)
        joined = tail + c
        if b is None:
            return joined, n + m, d
        return (a, n + m + self.word(joined), d) if d is not None else (a, n + m, joined)

    def scan(self, maps: list[tuple]) -> list[tuple]:
        """Inclusive prefix composition in doubling steps."""
        maps, step = list(maps), 1
        while step < len(maps):
            maps = maps[:step] + [self.compose(maps[i - step], maps[i]) for i in range(step, len(maps))]
            step *= 2
        return maps

    def total(self, final: tuple) -> int:
        a, n, b = final
        return self.word(a) + n + self.word(b or b"")


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def _short(docs: DataFrame, path: str) -> DataFrame:
    def work(batches):
        count = counter(path)
        for batch in batches:
            for block in B.blocks(batch):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(block.lo, block.rows), pa.array(np.diff(block.cuts)), pa.array(count.block(block))], ["doc_id", "n_bytes", "n_tokens"]
                )

    return docs.mapInArrow(work, "doc_id bigint, n_bytes bigint, n_tokens bigint")


def _long(docs: DataFrame, path: str, chunk: int) -> DataFrame:
    raw = F.concat(F.lit(" ").cast("binary"), F.col("text").cast("binary"))
    rows = docs.withColumn("row", F.monotonically_increasing_id()).withColumn("raw", raw).withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    places = F.sequence(F.lit(0), F.floor((F.octet_length("raw") - 1) / chunk).cast("int"))
    parts = rows.select("doc_id", "row", "n_bytes", "raw", F.explode(places).alias("i")).select(
        "doc_id", "row", "n_bytes", "i", F.substring(F.col("raw"), F.col("i") * chunk + 1, F.lit(chunk)).alias("raw")
    )
    parts = parts.repartition("row", "i")

    def map_chunks(batches):
        count = counter(path)
        for batch in batches:
            maps = [count.chunk_map(x) for x in batch.column("raw").to_pylist()]
            cols = list(zip(*maps, strict=True)) if maps else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "row", "n_bytes", "i")), pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())],
                ["doc_id", "row", "n_bytes", "i", "head", "inner", "tail"],
            )

    mapped = parts.mapInArrow(map_chunks, "doc_id bigint, row bigint, n_bytes bigint, i int, head binary, inner bigint, tail binary")
    texts = mapped.groupBy("row", "doc_id", "n_bytes").agg(F.array_sort(F.collect_list(F.struct("i", "head", "inner", "tail"))).alias("maps"))

    def join(batches):
        count = counter(path)
        for batch in batches:
            totals = [count.total(count.scan([(m["head"], m["inner"], m["tail"]) for m in maps])[-1]) for maps in batch.column("maps").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(totals, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return texts.select("doc_id", "n_bytes", "maps").mapInArrow(join, "doc_id bigint, n_bytes bigint, n_tokens bigint")


def token_counts(docs: DataFrame, path: str, limit: int = 4096, chunk: int = 1 << 22) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, texts whole."""
    B.arrow_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    long = (F.octet_length("text") > chunk) & ~F.contains("text", F.lit(MARK))
    found = _short(docs.where(~long), path).unionByName(_long(docs.where(long), path, chunk))
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
