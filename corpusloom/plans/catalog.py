"""All queries of the engine itself."""

from __future__ import annotations

from corpusloom.plans import analysis, corpus, package, summaries, validation, workflow  # noqa: F401
from corpusloom.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
