"""All registered queries and their SQL twins."""

from __future__ import annotations

from tidemark.plans import boards, corpus, extraction, labelling, market, skills, spend, streams

_MODULES = (market, corpus, boards, skills, extraction, spend, labelling, streams)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
