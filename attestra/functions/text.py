"""Text expressions: identifiers, normalised keys, titles and search phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \s leaves out NBSP and other Unicode spaces unless (?U) is given.
SPACE = r"(?U)\s"


def base_id(col: Column | str) -> Column:
    """Identifier without its ``#locator``."""
    return F.substring_index(F.col(col) if isinstance(col, str) else col, "#", 1)


def collapse_space(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, SPACE + "+", " "))


def title_key(col: Column) -> Column:
    """Lower-case words of letters and digits separated by one blank."""
    return F.trim(F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]+", " "))


def titles_match(a: Column, b: Column) -> Column:
    """Same title: one contains the other, or word Jaccard of at least 0.8."""
    ka, kb = title_key(a), title_key(b)
    wa, wb = F.split(ka, " "), F.split(kb, " ")
    jaccard = F.size(F.array_intersect(wa, wb)) / F.size(F.array_union(wa, wb))
    usable = (F.length(ka) > 0) & (F.length(kb) > 0)
    return F.coalesce(usable & (F.contains(ka, kb) | F.contains(kb, ka) | (jaccard >= 0.8)), F.lit(False))


def claim_key(col: Column) -> Column:
    """Claim text reduced to its ASCII letters and digits."""
    return F.regexp_replace(F.lower(col), "[^a-z0-9]+", "")


def claim_tokens(col: Column) -> Column:
    """Distinct ASCII words of a claim, sorted."""
    words = F.split(F.regexp_replace(F.lower(col), "[^a-z0-9]+", " "), " ")
    return F.sort_array(F.array_distinct(F.filter(words, lambda w: w != "")))


def phrase_text(col: Column) -> Column:
    """Text as blank-delimited words, so a phrase test is a plain substring test."""
    return F.concat(F.lit(" "), title_key(F.coalesce(col, F.lit(""))), F.lit(" "))


def phrase(col: Column) -> Column:
    """A query phrase in the form ``phrase_text`` can be searched for."""
    return F.concat(F.lit(" "), title_key(col), F.lit(" "))


def strip_query_syntax(col: Column) -> Column:
    """Drop boolean words, quotes, brackets and colons from a proposed query part."""
    no_bool = F.regexp_replace(col, r"(?i)\b(?:AND|OR|NOT)\b", " ")
    return collapse_space(F.regexp_replace(no_bool, r"[\"'()\[\]{}:]", " "))


def drop_word(col: Column, word: Column) -> Column:
    """Remove every whole-word, case-insensitive occurrence of ``word``."""
    quoted = F.regexp_replace(word, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    return F.regexp_replace(col, F.concat(F.lit(r"(?i)\b"), quoted, F.lit(r"\b")), F.lit(" "))


def sentences(col: Column) -> Column:
    """Sentences split after ``. ! ?``; short fragments (15 characters or fewer) dropped."""
    return F.filter(F.split(col, r"(?<=[.!?])(?U)\s+"), lambda s: F.length(F.regexp_replace(s, r"^(?U)\s+|\s+$", "")) > 15)


def set_key(col: Column) -> Column:
    """Comparison key of a name: trimmed, blanks collapsed, upper case."""
    return F.upper(collapse_space(col))
