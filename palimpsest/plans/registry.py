"""All registered queries by name, and their SQL."""

from __future__ import annotations

from palimpsest.plans import catalogue, compare, inventory, pages, review, streams

QUERIES = catalogue.QUERIES | review.QUERIES | inventory.QUERIES | compare.QUERIES | pages.QUERIES | streams.QUERIES
ORACLES = catalogue.ORACLES | review.ORACLES | inventory.ORACLES | compare.ORACLES | pages.ORACLES | streams.ORACLES
FLAGSHIP = "semantic_search_topk"
