"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from tallyframe.llm import consensus, cutoff, leakage, neardup, pairs, personal, qdigest, spans, tokenize

QUERIES = {
    "p1_percentiles": qdigest.p1_percentiles,
    "p2_found": pairs.p2_found,
    "p2_counts": pairs.p2_counts,
    "p3_found": cutoff.p3_found,
    "p3_sources": cutoff.p3_sources,
    "p4_found": consensus.p4_found,
    "p4_consensus": consensus.p4_consensus,
    "p4_reviewers": consensus.p4_reviewers,
    "p4_agreement": consensus.p4_agreement,
    "p5_found": neardup.p5_found,
    "p5_groups": neardup.p5_groups,
    "p6_found": personal.p6_found,
    "p6_redacted": personal.p6_redacted,
    "p7_ids": tokenize.p7_ids,
    "p8_found": leakage.p8_found,
    "p8_cleaned": leakage.p8_cleaned,
    "p9_found": spans.p9_found,
    "p9_share": spans.p9_share,
}

ORACLE: dict[str, str] = {**qdigest.ORACLE, **consensus.ORACLE}
