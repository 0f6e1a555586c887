"""All queries and their SQL, by name."""

from __future__ import annotations

from corpusmill.plans import comparison, corpus, evaluation, more, ordered, readers, runs, statistics
from corpusmill.plans.tables import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "comparison", "corpus", "evaluation", "more", "ordered", "readers", "runs", "statistics"]
