"""All registered queries and their SQL."""

from corpusloom.plans import ingestion, retrieval, sources, streams  # noqa: F401 - they register their queries
from corpusloom.plans.registry import ORACLES, QUERIES

FLAGSHIP = "mmr_top5"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
