"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0). Votes of all documents are counted by pattern;
expectation-maximisation over those counts estimates how often each rule votes on good and on bad
documents and how often it is right; a document is kept when the posterior probability of good
reaches a threshold, so one failing rule does not sink it. The patterns number 3^rules at most,
whatever the corpus, and their counts are all that reaches the driver.

Null and empty texts have no words: all counts are 0 and ``base_failed`` is true. Repeated rows are
judged each by itself. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm import blocks as B
from attestra.session import cut_lineage

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended", "n_letters", "n_upper", "n_alpha_words")
SCHEMA = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)


def _marks(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


SYMBOL = _marks("#*$%&|<>")
ENDING = _marks(".!?\"')")
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = True
LETTER[0xC2:] = True  # the first byte of a wider character
HEAD = (np.arange(256) & 0xC0) != 0x80


def _repeats(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    order = np.argsort(keys)
    ordered = keys[order]
    same = np.zeros(len(keys), bool)
    same[1:] = ordered[1:] == ordered[:-1]
    same[:-1] |= same[1:]
    out = np.empty(len(keys), bool)
    out[order] = same
    return out


def block_counts(block: B.Block) -> dict[str, np.ndarray]:
    data, cuts, n = block.data, block.cuts, block.rows
    words = B.runs(B.NOT_SPACE[data], cuts)
    prefix = B.Prefix(data)
    salt = B.mix(np.arange(1, n + 1).astype(np.uint64))
    heads = np.concatenate(([0], np.cumsum(HEAD[data])))
    letters = np.concatenate(([0], np.cumsum(LETTER[data])))

    hashes = prefix.of(words.begin, words.end)
    keys, first, bounds = B.windows(hashes, words.bounds, 3, short=False)
    again = first[_repeats(keys ^ np.repeat(salt, np.diff(bounds)))]
    cover = np.zeros(len(hashes) + 3, bool)
    for j in range(3):
        cover[again + j] = True

    lines = B.runs(data != 10, cuts)
    marked = np.concatenate(([0], np.cumsum(B.NOT_SPACE[data])))
    full = marked[lines.end] > marked[lines.begin]
    owner, begin, end = lines.owner()[full], lines.begin[full], lines.end[full]
    key = prefix.of(begin, end) ^ salt[owner]
    _, at = np.unique(key, return_index=True)
    n_lines = np.bincount(owner, minlength=n)
    last = end - 1
    return {
        "n_words": words.counts,
        "word_chars": B.sums(heads[words.end] - heads[words.begin], words.bounds),
        "n_symbols": B.sums(SYMBOL[data], cuts),
        "n_dup_lines": n_lines - np.bincount(owner[at], minlength=n),
        "n_repeat_words": B.sums(cover[: len(hashes)], words.bounds),
        "n_lines": n_lines,
        "n_ended": np.bincount(owner[ENDING[data[last]]], minlength=n),
        "n_letters": B.sums(LETTER[data], cuts),
        "n_upper": B.sums(UPPER[data], cuts),
        "n_alpha_words": B.sums(letters[words.end] > letters[words.begin], words.bounds),
    }


def text_counts(docs: DataFrame) -> DataFrame:
    """Counts of every whole text, one row for each row of ``docs``."""

    def work(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for block in B.blocks(batch):
                found = block_counts(block)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(block.lo, block.rows), *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], ["doc_id", *COUNTS]
                )

    B.arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(work, SCHEMA)


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.when(F.col(whole) > 0, F.col(whole))


def _rule(value: Column, bad: Column, good: Column) -> Column:
    return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The vote of each rule as a column expression over the counts."""
    out = {}

    def over(name: str, value: Column, good: float, bad: float) -> None:
        out[name] = _rule(value, value > bad, value <= good)

    def under(name: str, value: Column, bad: float, good: float) -> None:
        out[name] = _rule(value, value < bad, value >= good)

    over("symbols", _share("n_symbols", "n_words"), 0.02, 0.1)
    over("marks", _share("n_symbols", "word_chars"), 0.004, 0.05)
    over("dup_lines", _share("n_dup_lines", "n_lines"), 0.0, 0.3)
    over("repeats", _share("n_repeat_words", "n_words"), 0.05, 0.2)
    size = _share("word_chars", "n_words")
    out["word_size"] = _rule(size, (size < 2.5) | (size > 12), (size >= 3) & (size <= 10))
    over("upper", _share("n_upper", "n_letters"), 0.15, 0.4)
    under("letters", _share("n_alpha_words", "n_words"), 0.7, 0.9)
    under("endings", _share("n_ended", "n_lines"), 0.1, 0.5)
    under("length", F.col("n_words").cast("double"), 20.0, 50.0)
    return out


def fit(counts: dict[tuple[int, ...], int], rounds: int = 100, prior: float = 0.8) -> dict[tuple[int, ...], float]:
    """Posterior of good for every vote pattern, by expectation-maximisation over pattern counts.

    Rules are independent given the class; each has its own rates of voting good, bad and
    abstaining in either class. Rates begin where a rule is right three times in four, which also
    fixes which of the two classes is the good one; one pseudo-count each keeps them off 0.
    """
    if not counts:
        return {}
    patterns = sorted(counts)
    votes = np.array(patterns)
    weight = np.array([counts[p] for p in patterns], float)
    n, m = votes.shape
    is_vote = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)
    rate = np.zeros((2, m, 3))
    rate[0], rate[1] = [0.6, 0.2, 0.2], [0.2, 0.2, 0.6]
    good = prior
    for _ in range(rounds):
        logs = np.log([1 - good, good])[:, None] + np.einsum("pmv,cmv->cp", is_vote, np.log(rate))
        logs -= logs.max(0)
        post = np.exp(logs) / np.exp(logs).sum(0)
        mass = post * weight
        rate = np.einsum("cp,pmv->cmv", mass, is_vote) + 1
        rate /= rate.sum(2, keepdims=True)
        good = float(np.clip((mass[1].sum() + 1) / (weight.sum() + 2), 0.01, 0.99))
    return {p: float(x) for p, x in zip(patterns, post[1])}


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts, votes' posterior and the verdict of every document."""
    spark = docs.sparkSession
    voted = text_counts(docs)
    named = rules()
    voted = cut_lineage(voted.withColumn("votes", F.array(*[v.cast("int") for v in named.values()])))
    rows = voted.groupBy("votes").count().collect()  # 3^rules at most
    posterior = fit({tuple(r["votes"]): r["count"] for r in rows})
    table = spark.createDataFrame([(list(k), v) for k, v in posterior.items()], "votes array<int>, posterior double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        voted.join(F.broadcast(table), "votes")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("posterior") >= threshold))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior", "votes")
    )
