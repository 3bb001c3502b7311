"""All queries of the core, by name."""

from __future__ import annotations

from papyrine.plans import collections, content, general, nearest

MODULES = (nearest, content, collections, general)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
