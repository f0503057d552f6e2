"""The patent corpus job: documents to sequences, hits, constructs and edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.operators import patents as P


@dataclass
class Workup:
    """Output tables of one corpus job."""

    rejected: DataFrame
    numbers: DataFrame
    sequences: DataFrame
    completeness: DataFrame
    regions: DataFrame
    species: DataFrame
    pairing: DataFrame
    shape: DataFrame
    edges: DataFrame


def work_up(
    docs: DataFrame, associations: DataFrame, members: DataFrame, numbering: DataFrame, general_hits: DataFrame, patent_hits: DataFrame,
    loop_hits: DataFrame, applicants: DataFrame,
) -> Workup:
    """docs: doc_id, text; associations (for text listings) and members are model output;
    numbering: doc_id, seq_id, chain, species, ord, position, aa; hit tables are scored and
    normalised; applicants: doc_id, company (documents found in the registry)."""
    good, rejected = P.readable_docs(docs)
    seqs = P.sequences(good)
    lengths = seqs.select(*P.SEQ, F.length("residues").alias("length"), "declared_length")
    named = P.xml_associations(good).unionByName(
        associations.join(good.where(~P.is_xml(F.col("text"))).select("doc_id"), "doc_id", "left_semi").select(*P.SEQ, "region_label", "pos")
    )
    domain_id = F.struct("doc_id", "seq_id").alias("domain_id")
    derived = P.derive_regions(numbering.select(domain_id, "chain", "ord", "position", "aa")).select(
        "domain_id.doc_id", "domain_id.seq_id", "label", "seq"
    )
    domains = numbering.groupBy(*P.SEQ).agg(F.min("chain").alias("chain"), F.min("species").alias("species"))
    top = P.length_guard(P.top_general_hit(lengths, general_hits), lengths)
    rivals = P.length_guard(P.competitors(lengths, patent_hits), lengths)
    regions = P.worked_regions(members, seqs, derived)
    heavy = regions.where(F.col("vh_seq_id").isNotNull()).select("doc_id", "name", "vh_seq_id").distinct()
    numbers = P.document_numbers(good)
    found = applicants.select("doc_id", F.lit(True).alias("found")).distinct()
    patents = numbers.join(found, "doc_id", "left").select(
        "doc_id", F.coalesce("patent_number", F.lit("unknown-patent")).alias("subject"), F.coalesce("found", F.lit(False)).alias("found")
    )
    edges = P.graph_edges(patents, applicants, regions, P.ungrouped(members, seqs), rivals, P.loop_competitors(heavy, loop_hits))
    return Workup(
        rejected, numbers, seqs, P.completeness(seqs, named), regions, P.construct_species(members, domains, top, seqs),
        P.pairing(members, domains), P.disclosure_shape(good, members, domains), edges,
    )
