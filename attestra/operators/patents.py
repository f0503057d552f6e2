"""Patent corpus operators: listings, legal status, hits, regions, constructs, edges.

Every table is keyed by ``doc_id`` (the patent document); sequences by (doc_id, seq_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra import constants as K
from attestra.functions import numbers as N
from attestra.functions import seqs as S
from attestra.functions import text as T

SEQ = ["doc_id", "seq_id"]


# --- Extraction --------------------------------------------------------------------------


def readable_docs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(readable, rejected with reason)``: at least 50 characters that are not blanks."""
    ok = F.coalesce(
        F.length(F.regexp_replace("text", T.SPACE, "")) >= K.MIN_READABLE_CHARS, F.lit(False)
    )
    return docs.where(ok), docs.where(~ok).withColumn("reason", F.lit("no extractable text"))


def document_numbers(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", S.first_patent_number(F.col("text")).alias("patent_number"))


def _matches(text: Column, pattern: str) -> Column:
    """Groups 1 and 2 of every match, in text order."""
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("id"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("v"))


def text_listing(docs: DataFrame) -> DataFrame:
    """(doc_id, seq_id, pos, residues, declared_length) of numbered text listings.

    The first usable block of an id counts, and the first length declared for it.
    """
    return _listed(docs, lambda text: F.lit(False))


XML_SCHEMA = (
    "SequenceData ARRAY<STRUCT<_sequenceIDNumber: STRING, INSDSeq: STRUCT<INSDSeq_length: STRING, "
    "INSDSeq_sequence: STRING, `INSDSeq_feature-table`: STRUCT<INSDFeature: ARRAY<STRUCT<"
    "INSDFeature_location: STRING, INSDFeature_quals: STRUCT<INSDQualifier: ARRAY<STRUCT<"
    "INSDQualifier_name: STRING, INSDQualifier_value: STRING>>>>>>>>>"
)


def _xml_entries(docs: DataFrame) -> DataFrame:
    # Malformed XML yields a null record, hence no entries.
    parsed = docs.select("doc_id", F.from_xml("text", XML_SCHEMA, {"mode": "PERMISSIVE"}).alias("x"))
    return parsed.select("doc_id", F.posexplode("x.SequenceData").alias("pos", "e")).select(
        "doc_id",
        "pos",
        F.when(F.col("e._sequenceIDNumber").rlike(r"^\s*\d+\s*\z"), F.trim("e._sequenceIDNumber").try_cast("bigint")).alias("seq_id"),
        F.when(F.col("e.INSDSeq.INSDSeq_length").rlike(r"^\s*\d+\s*\z"), F.trim("e.INSDSeq.INSDSeq_length").try_cast("bigint")).alias(
            "declared_length"
        ),
        S.letters(F.coalesce("e.INSDSeq.INSDSeq_sequence", F.lit(""))).alias("residues"),
        F.col("e.INSDSeq.`INSDSeq_feature-table`.INSDFeature").alias("features"),
    )


def xml_listing(docs: DataFrame) -> DataFrame:
    """Sequences of XML listings; the first usable entry per id counts."""
    return _listed(docs, lambda text: F.lit(True))


def is_xml(text: Column) -> Column:
    return F.coalesce(text.rlike(K.XML_LISTING), F.lit(False))


def sequences(docs: DataFrame) -> DataFrame:
    """Sequences of every document; XML listings and text listings take their own route."""
    return _listed(docs, is_xml)


def _listed(docs: DataFrame, xml) -> DataFrame:
    """Both routes in one pass: a document is read once, and its entries, blocks and declared lengths
    meet in one aggregate."""
    part = lambda kind, i, id, length, residues: F.struct(
        F.lit(kind).alias("kind"), i.alias("pos"), id.alias("id"), length.alias("length"), residues.alias("residues")
    )
    none = F.lit(None).cast("string")
    text = F.col("text")
    # Malformed XML yields a null record, hence no entries.
    record = F.from_xml("text", XML_SCHEMA, {"mode": "PERMISSIVE"})["SequenceData"]
    entries = F.transform(
        record, lambda e, i: part("entry", i, e["_sequenceIDNumber"], e["INSDSeq"]["INSDSeq_length"], F.coalesce(e["INSDSeq"]["INSDSeq_sequence"], F.lit("")))
    )
    blocks = F.transform(_matches(text, K.LISTING_BLOCK), lambda m, i: part("block", i, m["id"], none, m["v"]))
    lengths = F.transform(_matches(text, K.DECLARED_LENGTH), lambda m, i: part("length", i, m["id"], m["v"], none))
    # The explode of one text keeps it from being made again for every place it is named.
    whole = docs.select("doc_id", F.explode(F.array("text")).alias("text")).withColumn("_xml", xml(text))
    rows = whole.select("doc_id", "_xml", F.explode(F.when(F.col("_xml"), entries).otherwise(F.concat(blocks, lengths))).alias("m"))
    number = lambda c: F.when(F.col("_xml"), F.when(c.rlike(r"^\s*\d+\s*\z"), F.trim(c).try_cast("bigint"))).otherwise(c.try_cast("bigint"))
    rows = rows.select(
        "doc_id", "_xml", "m.pos", number(F.col("m.id")).alias("seq_id"), number(F.col("m.length")).alias("length"),
        (F.col("m.kind") == "length").alias("_length"), F.when(F.col("m.kind") != "length", S.letters(F.col("m.residues"))).alias("residues"),
    )
    usable = (F.length("residues") >= K.MIN_RESIDUES) & (~F.col("_xml") | F.col("seq_id").isNotNull())
    rows = rows.where(F.col("_length") | usable).groupBy(*SEQ, "_xml").agg(
        F.min(F.when(~F.col("_length"), F.struct("pos", "residues", "length"))).alias("f"),
        F.min(F.when(F.col("_length"), F.struct("pos", "length"))).alias("d"),
    )
    declared = F.when(F.col("_xml"), F.col("f.length")).when(F.col("doc_id").isNotNull() & F.col("seq_id").isNotNull(), F.col("d.length"))
    return rows.where(F.col("f").isNotNull()).select(*SEQ, "f.pos", "f.residues", declared.alias("declared_length"))


def xml_associations(docs: DataFrame) -> DataFrame:
    """Region names of whole sequences: (doc_id, seq_id, region_label, pos), distinct.

    Of a feature's qualifiers, note goes before product before standard_name. A feature
    counts when its location spans the declared length.
    """
    entries = _xml_entries(docs.where(is_xml(F.col("text")))).where(
        (F.col("seq_id") > 0) & F.col("declared_length").isNotNull()
    )
    feats = entries.select(*SEQ, "pos", "declared_length", F.posexplode("features").alias("fpos", "f"))
    quals = F.filter(
        F.transform(
            F.coalesce("f.INSDFeature_quals.INSDQualifier", F.array()),
            lambda q, i: F.struct(
                F.array_position(F.array(F.lit("note"), F.lit("product"), F.lit("standard_name")), F.lower(q["INSDQualifier_name"])).alias("rank"),
                i.alias("i"),
                F.coalesce(q["INSDQualifier_value"], F.lit("")).alias("value"),
            ),
        ),
        lambda q: q["rank"] > 0,
    )
    spots = F.transform(F.regexp_extract_all("f.INSDFeature_location", F.lit(r"(\d+)"), F.lit(1)), lambda s: s.try_cast("bigint"))
    labelled = feats.withColumn("region_label", S.region_label(F.array_min(quals)["value"])).withColumn("spots", spots)
    whole = labelled.where(
        F.col("region_label").isNotNull() & (F.array_min("spots") <= 1) & (F.array_max("spots") >= F.col("declared_length"))
    )
    return whole.groupBy(*SEQ, "region_label").agg(F.min(F.struct("pos", "fpos")).alias("f")).select(
        *SEQ, "region_label", (F.col("f.pos") * 1000000 + F.col("f.fpos")).alias("pos")
    )


def completeness(seqs: DataFrame, associations: DataFrame) -> DataFrame:
    """Counts per document: found, highest referenced id, ids missing below it, associations."""
    found = seqs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("found_count"), F.max("seq_id").alias("_a"))
    assoc = associations.groupBy("doc_id").agg(F.count(F.lit(1)).alias("association_count"), F.max("seq_id").alias("_b"))
    have = seqs.select(*SEQ).distinct().where(F.col("seq_id") >= 1).groupBy("doc_id").agg(F.count(F.lit(1)).alias("_have"))
    return (
        found.join(assoc, "doc_id", "full")
        .join(have, "doc_id", "left")
        .select(
            "doc_id",
            F.coalesce("found_count", F.lit(0)).alias("found_count"),
            F.greatest(F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0))).alias("referenced_max"),
            F.coalesce("association_count", F.lit(0)).alias("association_count"),
            (F.greatest(F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0))) - F.coalesce("_have", F.lit(0))).alias("missing_count"),
        )
    )


def missing_ids(seqs: DataFrame, complete: DataFrame) -> DataFrame:
    """(doc_id, first_id, last_id): runs of ids, from 1 to the highest referenced one, that have no
    sequence. Runs come from neighbours among the ids there are, so one huge id costs one row."""
    here = seqs.select("doc_id", F.col("seq_id").cast("bigint").alias("seq_id")).where("seq_id >= 1").distinct()
    end = complete.select("doc_id", (F.col("referenced_max").cast("bigint") + 1).alias("seq_id"))
    before = F.lag("seq_id", 1, 0).over(Window.partitionBy("doc_id").orderBy("seq_id"))
    gaps = here.unionByName(end).distinct().withColumn("_b", before)
    return gaps.where(F.col("seq_id") - F.col("_b") > 1).select("doc_id", (F.col("_b") + 1).alias("first_id"), (F.col("seq_id") - 1).alias("last_id"))


def invalid_residues(seqs: DataFrame) -> DataFrame:
    """Sequences with letters outside the residue alphabet, and those letters in order."""
    odd = F.array_distinct(F.split(F.regexp_replace(F.upper("residues"), f"[{K.VALID_RESIDUES}]", ""), ""))
    return seqs.withColumn("invalid_chars", F.array_join(odd, "")).where(F.length("invalid_chars") > 0).select(*SEQ, "invalid_chars")


def attach_residues(associations: DataFrame, seqs: DataFrame) -> DataFrame:
    return associations.join(seqs.select(*SEQ, "residues"), SEQ, "left")


def labels_by_sequence(associations: DataFrame) -> DataFrame:
    """Distinct region labels per sequence in order of first mention (23 labels exist)."""
    first = associations.groupBy(*SEQ, "region_label").agg(F.min("pos").alias("pos"))
    return first.groupBy(*SEQ).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "region_label"))), lambda x: x["region_label"]).alias("labels")
    )


# --- Legal status ------------------------------------------------------------------------


def map_legal(events: DataFrame) -> DataFrame:
    """Category and effect of each legal code; unlisted codes are neutral."""
    codes = events.sparkSession.createDataFrame(K.LEGAL_CODES, "code string, category string, effect string")
    return events.join(F.broadcast(codes), "code", "left").withColumn("effect", F.coalesce("effect", F.lit("neutral")))


def member_status(members: DataFrame, events: DataFrame, key: str = "member") -> DataFrame:
    """Members with the effect of their latest directional event; unknown without one.

    Events without a date come first; of equal dates the later row counts.
    """
    latest = events.where(F.col("effect") != "neutral").groupBy(key).agg(
        F.max_by("effect", F.struct(F.coalesce("date", F.lit("")), F.col("ord"))).alias("_effect")
    )
    return members.join(latest, key, "left").withColumn("status", F.coalesce("_effect", F.lit("unknown"))).drop("_effect")


def estimated_expiry(filings: DataFrame, key: str) -> DataFrame:
    """Earliest well-formed filing date per key plus 20 years, on the string."""
    good = filings.where(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}\z"))
    return good.groupBy(key).agg(F.min("date").alias("earliest")).withColumn(
        "estimated_expiry", S.expiry(F.array("earliest"))
    )


def patent_records(biblio: DataFrame, family: DataFrame, legal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(records, family members)``; biblio decides identity, family and legal are optional."""
    events = map_legal(legal.withColumn("member", F.concat("country", "number")))
    members = member_status(family.withColumn("member", F.concat("country", "number")), events)
    counts = members.groupBy("doc_id").agg(F.count(F.lit(1)).alias("family_size"))
    records = biblio.join(counts, "doc_id", "left").withColumn("family_size", F.coalesce("family_size", F.lit(0)))
    return records.withColumn("estimated_expiry", S.expiry(F.array("filing_date"))), members


# --- Hits --------------------------------------------------------------------------------


def score_hits(raw: DataFrame) -> DataFrame:
    """Identity and coverage in percent from the first aligned segment of each hit."""
    return raw.withColumn("percent_identity", N.percent_one_decimal(F.col("identity"), F.col("align_len"))).withColumn(
        "query_coverage", N.percent_one_decimal(F.col("query_to") - F.col("query_from") + 1, F.col("query_len"))
    )


def norm_hits(hits: DataFrame) -> DataFrame:
    mismatches = F.greatest(F.lit(0), F.col("align_len") - F.col("identity"))
    return hits.withColumn("mismatch_count", mismatches).withColumn(
        "exact_match", (F.col("mismatch_count") == 0) & (F.col("query_coverage") == 100)
    )


def length_guard(hits: DataFrame, lengths: DataFrame) -> DataFrame:
    """A declared length that differs from the sequence's revokes exact matches.

    lengths: doc_id, seq_id, length, declared_length.
    """
    joined = hits.join(lengths.select(*SEQ, "length", "declared_length"), SEQ, "left")
    differs = F.coalesce(F.col("declared_length") != F.col("length"), F.lit(False))
    return joined.withColumn("exact_match", F.col("exact_match") & ~differs).withColumn(
        "full_length_confirmed", F.coalesce(F.col("declared_length") == F.col("length"), F.lit(False))
    )


def competitors(seqs: DataFrame, hits: DataFrame) -> DataFrame:
    """Patent hits of long enough sequences with near-identical residues."""
    long_ = seqs.where(F.col("length") >= K.MIN_ALIGN_LENGTH).select(*SEQ)
    return hits.where(F.col("percent_identity") >= K.COMPETITOR_IDENTITY).join(long_, SEQ, "left_semi")


def top_general_hit(seqs: DataFrame, hits: DataFrame) -> DataFrame:
    """The first general-database hit of each long enough sequence."""
    long_ = seqs.where(F.col("length") >= K.MIN_ALIGN_LENGTH).select(*SEQ)
    fields = [c for c in hits.columns if c not in SEQ]
    best = hits.join(long_, SEQ, "left_semi").groupBy(*SEQ).agg(F.min_by(F.struct(*fields), "ord").alias("h"))
    return best.select(*SEQ, "h.*")


def loop_competitors(constructs: DataFrame, hits: DataFrame) -> DataFrame:
    """Patent hits of a construct's heavy CDR3: constructs (doc_id, name, vh_seq_id), hits by
    (doc_id, seq_id) of that heavy domain."""
    near = hits.where(F.col("percent_identity") >= K.LOOP_IDENTITY)
    return constructs.where(F.col("vh_seq_id").isNotNull()).withColumn("seq_id", F.col("vh_seq_id")).join(near, SEQ)


def cache_key(columns: list[str], sequence: str) -> Column:
    """SHA-256 over the request arguments and the letters of its sequence."""
    args = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.sha2(F.concat_ws("|", *args, S.letters(F.col(sequence))), 256)


def cache_lookup(requests: DataFrame, cache: DataFrame, now: Column, max_age_seconds: int | None) -> DataFrame:
    """Requests with ``hit``: the cache (key, payload, cached_at) holds a fresh entry.

    ``cached_at`` is text; an unreadable time counts as expired. Without a maximum age
    every entry is fresh.
    """
    # Of several entries of one key the latest counts.
    last = cache.groupBy("key").agg(F.max(F.struct(F.try_to_timestamp("cached_at"), "cached_at", "payload")).alias("c"))
    found = last.select("key", "c.payload", "c.cached_at", F.lit(True).alias("_in"))
    joined = requests.join(found, "key", "left")
    fresh = F.lit(True)
    if max_age_seconds is not None:
        age = now.cast("long") - F.try_to_timestamp("cached_at").cast("long")
        fresh = F.coalesce(age <= max_age_seconds, F.lit(False))
    return joined.withColumn("hit", F.coalesce("_in", F.lit(False)) & fresh).drop("_in")


# --- Regions -----------------------------------------------------------------------------


def _region_of(number: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, low, high in K.REGION_RANGES:
        out = F.when(number.between(low, high), F.lit(name)).otherwise(out)
    return out


def derive_regions(numbering: DataFrame) -> DataFrame:
    """Regions of numbered domains (domain_id, chain, ord, position, aa).

    Gaps are skipped, insertion letters keep their place, positions outside every range
    belong to none. The whole domain is a region too. A domain has about 130 positions.
    """
    rows = numbering.where(~F.col("aa").isin("-", "")).withColumn(
        "n", F.regexp_extract("position", r"^\s*(\d+)", 1).try_cast("int")
    )
    side = F.when(F.col("chain") == "H", "H").otherwise("L")
    generic = _region_of(F.col("n"))
    named = F.concat(F.regexp_replace(generic, r"\d", ""), F.lit("-"), side, F.regexp_replace(generic, r"\D", ""))
    both = rows.withColumn("label", F.explode(F.array_compact(F.array(F.concat(F.lit("V"), side), named))))
    return both.groupBy("domain_id", "chain", "label").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "aa"))), lambda x: x["aa"]), "").alias("seq"),
        F.min("n").alias("first_pos"),
        F.max("n").alias("last_pos"),
    )


def check_regions(claimed: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(checks, overall)`` for claimed regions (case_id, pos, label, sequence).

    regions: case_id, chain, domain_no, label, seq. The first domain of the anchor chain
    decides. Whole domains may be longer than the derived one; loops and frames must be equal.
    """
    side = F.when(F.col("chain") == "H", "H").otherwise("light")
    anchored = regions.withColumn("anchor", side)
    first = anchored.groupBy("case_id", "anchor").agg(F.min("domain_no").alias("domain_no"))
    usable = anchored.join(first, ["case_id", "anchor", "domain_no"], "left_semi").select("case_id", "label", "seq")
    has = first.select("case_id", "anchor", F.lit(True).alias("_has"))
    joined = (
        claimed.withColumn("anchor", S.anchor_chain(F.col("label")))
        .join(has, ["case_id", "anchor"], "left")
        .join(usable, ["case_id", "label"], "left")
    )
    mine, derived = S.no_space(F.col("sequence")), S.no_space(F.col("seq"))
    same = F.when(F.col("label").isin("VH", "VL"), F.contains(mine, derived)).otherwise(mine == derived)
    status = (
        F.when(F.col("label").isin(K.CONSTANT_LABELS), "not_applicable_constant")
        .when(F.col("anchor").isNull() | F.col("_has").isNull() | F.col("seq").isNull(), "orphan_unverifiable")
        .when(same, "confirmed")
        .otherwise("mismatch")
    )
    note = F.when(
        F.col("status") == "orphan_unverifiable",
        F.when(F.col("anchor").isNull(), "no anchor chain for label")
        .when(F.col("_has").isNull(), "no variable-domain anchor to number")
        .otherwise("region not present in numbered domain"),
    )
    checks = joined.withColumn("status", status).withColumn("note", note).select(
        "case_id", "pos", "label", "sequence", F.col("seq").alias("derived_seq"), "status", "note"
    )
    overall = checks.groupBy("case_id").agg(
        F.when(F.bool_or(F.col("status") == "mismatch"), "mismatch")
        .when(F.bool_and(F.col("status") == "confirmed"), "confirmed")
        .otherwise("partial")
        .alias("overall_status")
    )
    return checks, overall


# --- Constructs --------------------------------------------------------------------------


def worked_regions(members: DataFrame, seqs: DataFrame, regions: DataFrame) -> DataFrame:
    """Construct members that have a sequence, with CDR confirmation.

    members: doc_id, name, pos, region_label, seq_id; regions: doc_id, seq_id, label, seq.
    CDRs are compared with the construct's VH domain only, so light CDRs have no anchor.
    """
    have = members.join(seqs.select(*SEQ, "residues"), SEQ)
    vh = have.where(F.col("region_label") == "VH").groupBy("doc_id", "name").agg(F.min_by("seq_id", "pos").alias("vh_seq_id"))
    derived = regions.select("doc_id", F.col("seq_id").alias("vh_seq_id"), F.col("label").alias("region_label"), F.col("seq").alias("_d"))
    joined = have.join(vh, ["doc_id", "name"], "left").join(derived, ["doc_id", "vh_seq_id", "region_label"], "left")
    is_cdr = F.col("region_label").rlike(r"^CDR-[HL][1-3]\z")
    return joined.withColumn(
        "cdr_confirmation",
        F.when(
            is_cdr,
            F.when(F.col("_d").isNull(), "no_anchor")
            .when(S.letters(F.col("residues")) == S.letters(F.col("_d")), "confirmed")
            .otherwise("mismatch"),
        ),
    ).drop("_d")


def ungrouped(members: DataFrame, seqs: DataFrame) -> DataFrame:
    return seqs.join(members.select(*SEQ), SEQ, "left_anti")


def construct_species(members: DataFrame, domains: DataFrame, top_hits: DataFrame, seqs: DataFrame) -> DataFrame:
    """Species class per construct, from its first variable domain and constant member.

    domains: doc_id, seq_id, chain, species; top_hits: doc_id, seq_id, organism.
    """
    have = members.join(seqs.select(*SEQ), SEQ, "left_semi")
    rank = F.when(F.col("region_label") == "VH", 0).otherwise(1)
    variable = (
        have.where(F.col("region_label").isin("VH", "VL"))
        .groupBy("doc_id", "name")
        .agg(F.min_by("seq_id", F.struct(rank, F.col("pos"))).alias("seq_id"))
        .join(domains.select(*SEQ, F.col("species").alias("variable_species")), SEQ, "left")
        .drop("seq_id")
    )
    constant = (
        members.where(F.col("region_label").isin(K.CONSTANT_LABELS))
        .groupBy("doc_id", "name")
        .agg(F.min_by("seq_id", "pos").alias("seq_id"))
        .join(top_hits.select(*SEQ, F.nullif("organism", F.lit("")).alias("constant_species")), SEQ, "left")
        .drop("seq_id")
    )
    out = members.select("doc_id", "name").distinct().join(variable, ["doc_id", "name"], "left").join(
        constant, ["doc_id", "name"], "left"
    )
    return out.withColumn(
        "classification", S.species_class(F.col("variable_species"), F.col("constant_species"))
    ).withColumn(
        "evidence",
        F.concat(
            F.lit("variable domain species "), F.coalesce("variable_species", F.lit("unknown")),
            F.lit("; constant region species "), F.coalesce("constant_species", F.lit("unknown")),
        ),
    )


def pairing(members: DataFrame, domains: DataFrame) -> DataFrame:
    """Chain pairing warning per construct, over its distinct sequences with a domain."""
    chains = members.select(*SEQ, "name").distinct().join(domains.select(*SEQ, "chain"), SEQ, "left")
    counts = chains.groupBy("doc_id", "name").agg(
        F.count_if(F.col("chain") == "H").alias("heavy"), F.count_if(F.col("chain").isin("K", "L")).alias("light")
    )
    h, l = F.col("heavy"), F.col("light")
    return counts.withColumn(
        "warning",
        F.when((h == 1) & (l == 1), F.lit(None))
        .when(h > 1, "two or more heavy chains grouped into one construct")
        .when(l > 1, "two or more light chains grouped into one construct")
        .when((h == 1) & (l == 0), "heavy chain with no paired light chain")
        .when((l == 1) & (h == 0), "light chain with no paired heavy chain"),
    )


def disclosure_shape(docs: DataFrame, members: DataFrame, domains: DataFrame) -> DataFrame:
    """Antibody when any construct member has a numbered domain."""
    any_ = members.join(domains.select(*SEQ), SEQ, "left_semi").select("doc_id", F.lit(True).alias("_any")).distinct()
    return docs.select("doc_id").join(any_, "doc_id", "left").select(
        "doc_id", F.when(F.col("_any"), "antibody").otherwise("not-standard-antibody").alias("disclosure_shape")
    )


def graph_edges(
    patents: DataFrame, owners: DataFrame, regions: DataFrame, loose: DataFrame, matches: DataFrame, loops: DataFrame
) -> DataFrame:
    """Relationship edges of every patent.

    patents: doc_id, subject, found; owners: doc_id, company; regions: doc_id, name, seq_id
    (worked members); loose: doc_id, seq_id; matches: doc_id, seq_id, accession, exact_match;
    loops: doc_id, vh_seq_id, accession. A sequence is disclosed once per patent.
    """
    seq = lambda c: F.concat(F.lit("SEQ:"), F.col(c).cast("string"))
    edge = lambda s, p, o, why, conf: [
        "doc_id", s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"), F.lit(why).alias("provenance"),
        conf.alias("confidence"),
    ]
    named = patents.select("doc_id", "subject", "found")
    owned = owners.join(named.where(F.col("found")), "doc_id").select(
        *edge(F.col("subject"), "OWNED_BY", F.col("company"), "epo-assignee", F.lit("verified"))
    )
    told = regions.select(*SEQ).unionByName(loose.select(*SEQ)).distinct().join(named, "doc_id").select(
        *edge(F.col("subject"), "DISCLOSES", seq("seq_id"), "patent-listing", F.lit("claimed"))
    )
    parts = regions.select(*edge(F.col("name"), "HAS_REGION", seq("seq_id"), "claims-grouping", F.lit("claimed")))
    level = F.when(F.col("exact_match"), "verified").otherwise("claimed")
    # A sequence that is a member n times states its matches n times.
    near = regions.select(*SEQ).join(matches, SEQ).select(
        *edge(seq("seq_id"), "MATCHES", F.col("accession"), "blast-pataa", level)
    )
    loop = loops.select(*edge(seq("vh_seq_id"), "MATCHES", F.col("accession"), "blast-cdr-h3", F.lit("claimed")))
    return owned.unionByName(told).unionByName(parts).unionByName(near).unionByName(loop)


def fact_index(regions: DataFrame, species: DataFrame, top_hits: DataFrame, matches: DataFrame, patents: DataFrame) -> DataFrame:
    """(doc_id, citation, fact) lines; a later fact of a citation replaces an earlier one."""
    top = top_hits.select(*SEQ, F.col("accession").alias("_acc"), F.col("percent_identity").alias("_pid"), F.col("mismatch_count").alias("_mm"))
    num = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")
    rows = regions.join(species.select("doc_id", "name", "classification"), ["doc_id", "name"]).join(top, SEQ, "left")
    hit_text = F.concat(F.lit("nr top hit "), "_acc", F.lit(" "), num("_pid"), F.lit("% mismatches="), num("_mm"))
    seq_text = F.concat_ws(
        "; ",
        F.concat("region_label", F.lit(" SEQ:"), F.col("seq_id").cast("string"), F.lit(" in "), "name", F.lit(" (species "), "classification", F.lit(")")),
        F.concat(F.lit("CDR "), "cdr_confirmation"),
        hit_text,
    )
    at = lambda step, sub: F.struct(F.col("construct_no").alias("a"), F.col("pos").alias("b"), F.lit(step).alias("c"), sub.alias("d"))
    zero = F.lit(0).cast("long")
    one = rows.select("doc_id", F.concat(F.lit("SEQ:"), F.col("seq_id").cast("string")).alias("citation"), at(0, zero).alias("_at"), seq_text.alias("fact"))
    two = rows.where(F.col("_acc").isNotNull()).select("doc_id", F.col("_acc").alias("citation"), at(1, zero).alias("_at"), hit_text.alias("fact"))
    rival = regions.join(matches.withColumnRenamed("ord", "_mord"), SEQ)
    three = rival.select(
        "doc_id", F.col("accession").alias("citation"), at(2, F.col("_mord").cast("long")).alias("_at"),
        F.concat(F.lit("competitor patent "), "accession", F.lit(" "), num("percent_identity"), F.lit("% mismatches="), num("mismatch_count")).alias("fact"),
    )
    latest = one.unionByName(two).unionByName(three).groupBy("doc_id", "citation").agg(F.max_by("fact", "_at").alias("fact"))
    own = patents.select(
        "doc_id", F.lit("patent").alias("citation"),
        F.concat(
            F.lit("patent "), F.coalesce("patent_number", F.lit("unknown")), F.lit("; applicants "),
            F.coalesce(F.nullif(F.array_join("applicants", ", "), F.lit("")), F.lit("unknown")),
        ).alias("fact"),
    )
    return latest.where(F.col("citation") != "patent").unionByName(own)


def cited_facts(points: DataFrame, facts: DataFrame) -> DataFrame:
    """Evidence text per narrative point; an unknown citation stands for itself."""
    cites = points.select("doc_id", "point_id", F.posexplode("citations").alias("pos", "citation"))
    lines = cites.join(facts, ["doc_id", "citation"], "left").withColumn("line", F.coalesce("fact", "citation"))
    text = lines.groupBy("doc_id", "point_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("_t")
    )
    return points.join(text, ["doc_id", "point_id"], "left").withColumn(
        "evidence", F.coalesce("_t", F.lit("(no cited evidence)"))
    ).drop("_t")
