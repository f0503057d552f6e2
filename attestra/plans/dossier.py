"""The dossier job: from evidence, drafted claims and verdicts to rated sections.

Model output (claims, verdicts, gap claims, risks, critiques) comes in as tables. All
targets run at once; every table carries its keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.operators import claims as C
from attestra.operators import consolidate as X
from attestra.operators import store as S


@dataclass
class Dossier:
    """Output tables of one dossier job."""

    sections: DataFrame
    claims: DataFrame
    stripped: DataFrame
    sources: DataFrame
    citations: DataFrame
    references: DataFrame
    labs: DataFrame


def build_dossier(evidence: DataFrame, claims: DataFrame, verdicts: DataFrame, sections: DataFrame, gap_claims: DataFrame | None = None) -> Dossier:
    """Register evidence, ground and rate claims, merge gaps, consolidate, attach cards.

    claims: section_id, ord (unique over the dossier), text, citations, confidence.
    """
    store = S.register(evidence)
    shipped, stripped = C.ground(C.clamp_confidence(claims), store)
    everything = claims if gap_claims is None else claims.unionByName(gap_claims, allowMissingColumns=True)
    identities = S.source_identity(S.cited_ids(everything), store)
    rated = C.rate_sections(sections, shipped, verdicts, identities)
    kept = C.supported(shipped, verdicts)
    if gap_claims is not None:
        rated, kept = C.merge_gaps(rated, kept, gap_claims.select(*kept.columns), identities)
        kept = kept.drop("block")
    unique, citations = X.consolidate(kept)
    cards = C.card_claims(store)
    final = C.prepend(unique.drop("merged"), cards, sections)
    cited = citations.select("id").unionByName(S.cited_ids(cards)).distinct()
    labs = C.rank_labs(store) if "target" in store.columns else None
    refs = S.references(store, cited) if "raw" in store.columns else S.references(store.withColumn("raw", F.lit(None).cast("string")), cited)
    return Dossier(rated, final, stripped, C.section_sources(kept), citations, refs, labs)
