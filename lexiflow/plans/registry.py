"""All queries of the reference's operators and their SQL."""

from __future__ import annotations

from . import corpus, parsing, retrieve

QUERIES = corpus.QUERIES | retrieve.QUERIES | parsing.QUERIES
ORACLES = corpus.ORACLES | retrieve.ORACLES | parsing.ORACLES
