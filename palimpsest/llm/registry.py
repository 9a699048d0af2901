"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import mixing, url_reputation
from .conversations import op11_conversation_repair
from .fingerprints import op5_lookup_sketches
from .jaccard import op4_jaccard_join
from .language_id import op3_language_id
from .licenses import op13_license_scan
from .mixing import op8_mixing
from .packing import op2_best_fit_packing
from .periodic import op12_periodic_runs
from .pii import op1_feistel_pseudonyms
from .quality import op10_robust_quality
from .token_counts import op6_token_counts
from .token_ids import op9_token_ids
from .url_reputation import op7_url_reputation

QUERIES = {
    "op1_feistel_pseudonyms": op1_feistel_pseudonyms,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_language_id": op3_language_id,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_lookup_sketches": op5_lookup_sketches,
    "op6_token_counts": op6_token_counts,
    "op7_url_reputation": op7_url_reputation,
    "op8_mixing": op8_mixing,
    "op9_token_ids": op9_token_ids,
    "op10_robust_quality": op10_robust_quality,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_license_scan": op13_license_scan,
}

#: The other operators are held against brute force in tests/llm.
ORACLES: dict[str, str] = {"op7_url_reputation": url_reputation.ORACLE, "op8_mixing": mixing.ORACLE}
