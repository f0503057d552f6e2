"""Patent numbers, sequence text and region names as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra import constants as K
from attestra.functions.text import SPACE


def patent_number(col: Column) -> Column:
    """Struct (country, number, kind, epodoc) of a patent number, or null."""
    clean = F.upper(F.regexp_replace(col, r"(?U)[\s,.\-]", ""))
    part = lambda i: F.regexp_extract(clean, K.PATENT_NUMBER, i)
    return F.when(
        F.length(part(1)) > 0,
        F.struct(
            part(1).alias("country"),
            part(2).alias("number"),
            F.nullif(part(3), F.lit("")).alias("kind"),
            F.concat(part(1), part(2)).alias("epodoc"),
        ),
    )


def first_patent_number(text: Column) -> Column:
    """The first patent number in free text, as country and digits."""
    found = F.regexp_extract_all(text, F.lit(K.PATENT_CANDIDATE), F.lit(0))
    numbers = F.transform(found, lambda c: patent_number(F.replace(c, F.lit("/"), F.lit("")))["epodoc"])
    return F.get(F.filter(numbers, lambda n: n.isNotNull()), F.lit(0))


def letters(col: Column) -> Column:
    """Residues only: ASCII letters, upper case."""
    return F.upper(F.regexp_replace(col, "[^A-Za-z]", ""))


def sequence_text(col: Column) -> Column:
    """Residues of FASTA or plain text; header lines are dropped."""
    return letters(F.regexp_replace(col, r"(?m)(?U)^\s*>.*$", ""))


def alphabet(seq: Column) -> Column:
    return F.when(seq.rlike(r"^[ACGTUN]+\z"), "blastn").otherwise("blastp")


def no_space(col: Column) -> Column:
    return F.upper(F.regexp_replace(col, SPACE + "+", ""))


def region_label(note: Column) -> Column:
    """Region named by a feature note; null when it names none or both chains."""
    n = F.lower(note)
    heavy, light = n.rlike(K.HEAVY_CHAIN), n.rlike(K.LIGHT_CHAIN)
    group = lambda patterns: F.coalesce(*[F.nullif(F.regexp_extract(n, p, 1), F.lit("")) for p in patterns])
    number, letter = group(K.LOOP_NUMBERS), F.coalesce(group(K.LOOP_CHAINS), F.lit(""))

    def by_chain(h: Column, l: Column, if_heavy: Column, if_light: Column) -> Column:
        return F.when(h & ~l, if_heavy).when(l & ~h, if_light)

    loop = by_chain(
        heavy | (letter == "h"), light | (letter == "l"),
        F.concat(F.lit("CDR-H"), number), F.concat(F.lit("CDR-L"), number),
    )
    label = F.when(n.contains("cdr") & number.isNotNull(), loop)
    label = label.when(n.rlike(K.VARIABLE_DOMAIN), by_chain(heavy, light, F.lit("VH"), F.lit("VL")))
    for pattern, name in K.OTHER_REGIONS:
        label = label.when(n.rlike(pattern), name)
    return label.when(n.contains("chain"), by_chain(heavy, light, F.lit("heavy-chain"), F.lit("light-chain")))


def anchor_chain(label: Column) -> Column:
    """Chain whose numbering can check a region label: H, light or none."""
    return F.when((label == "VH") | label.rlike(r"-H[1-4]\z"), "H").when(
        (label == "VL") | label.rlike(r"-L[1-4]\z"), "light"
    )


def species_class(variable: Column, constant: Column) -> Column:
    """Human-like, chimeric, murine or unknown, from variable and constant region species."""
    is_ = lambda c, pattern: F.coalesce(c.rlike(pattern), F.lit(False))
    none = F.coalesce(F.length(constant) == 0, F.lit(True))
    human_v, human_c = is_(variable, K.HUMAN_SPECIES), is_(constant, K.HUMAN_SPECIES)
    other_v, other_c = is_(variable, K.OTHER_SPECIES), is_(constant, K.OTHER_SPECIES)
    return (
        F.when(human_v & (human_c | none), "human-like")
        .when(other_v & human_c, "chimeric")
        .when(other_v & (other_c | none), "murine")
        .otherwise("unknown")
    )


def claims_window(text: Column, width: int | None = None) -> Column:
    """Text from the claims heading on, from the start without one; ``width`` characters if given."""
    at = F.regexp_instr(text, F.lit(K.CLAIMS_HEADING))
    return F.substring(text, F.greatest(at, F.lit(1)), F.length(text) if width is None else F.lit(width))


def expiry(dates: Column) -> Column:
    """Earliest well-formed date of an array plus 20 years, on the string."""
    good = F.filter(dates, lambda d: d.rlike(r"^\d{4}-\d{2}-\d{2}\z"))
    first = F.array_min(good)
    return F.concat((F.substring(first, 1, 4).cast("int") + 20).cast("string"), F.substring(first, 5, 6))


def iso_date(col: Column) -> Column:
    """``YYYYMMDD`` as ``YYYY-MM-DD``; anything else is null."""
    return F.when(
        col.rlike(r"^\d{8}\z"), F.concat_ws("-", F.substring(col, 1, 4), F.substring(col, 5, 2), F.substring(col, 7, 2))
    )
