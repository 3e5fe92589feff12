"""Job: parsed references to enriched, deduplicated citation tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from citestat.operators import dedup, enrich, refs
from citestat.schemas import OC_METADATA_COLUMNS
from citestat.session import save_and_reload

REFERENCE_KEYS = ["identifier", "lang", "reference_index"]


@dataclass
class Bibliography:
    metadata: DataFrame
    citations: DataFrame
    mapping: DataFrame
    enriched: DataFrame
    diagnostics: DataFrame
    errors: DataFrame


def export_bibliography(jobs: DataFrame, parsed: DataFrame, candidates: DataFrame,
                        prefer_provider_type: bool = False) -> Bibliography:
    """``jobs``: article jobs (`refs.jobs`); ``parsed``: (identifier, lang, reference_index,
    raw_reference, parsed_json); ``candidates``: the provider's answers per query.
    """
    good, errors = refs.split_unparsed(parsed)
    references = refs.parsed_fields(good)
    for missing in ("doi", "publisher", "editor"):
        if missing not in references.columns:
            references = references.selectExpr("*", f"CAST(NULL AS STRING) AS {missing}")
    citing = jobs.select("identifier", "lang", refs.citing_id().alias("citing_id"))
    references = references.join(citing, ["identifier", "lang"])
    scored = save_and_reload(enrich.score_candidates(references, candidates), "scored")
    enriched = enrich.enrich(scored, prefer_provider_type)
    unique = dedup.deduplicate(enriched, REFERENCE_KEYS)
    rows = refs.citing_rows(jobs).select(OC_METADATA_COLUMNS)
    return Bibliography(
        metadata=dedup.export_metadata(rows, unique, ["id", "title"]),
        citations=dedup.citation_pairs(unique),
        mapping=dedup.mapping_table(unique),
        enriched=enriched,
        diagnostics=enrich.diagnostics(scored, REFERENCE_KEYS),
        errors=errors,
    )
