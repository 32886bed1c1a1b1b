"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from . import decontamination, language_id, packing, phrases, quality_classifier, quality_rules, simhash, source_audit, suffixes, token_counts, tokens, url_filters

_MODULES = (url_filters, quality_rules, token_counts, tokens, simhash, phrases, packing, quality_classifier, suffixes, decontamination, language_id, source_audit)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLES", {}).items()}
