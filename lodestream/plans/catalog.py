"""All registered queries; importing this module registers them."""

from __future__ import annotations

from lodestream.plans import aggregates, derived, graphs, hierarchies, joins, scripts, star, summaries, surface, views, whole_table, windows_of_time  # noqa: F401
from lodestream.plans.registry import CORPUS_ORACLES, CORPUS_QUERIES, ORACLES, QUERIES  # noqa: F401
