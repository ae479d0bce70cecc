"""All queries, loaded from their modules."""

from turnmill.plans import (  # noqa: F401
    dialogue,
    diarization,
    evaluation,
    files,
    incremental,
    relevance,
    training,
    videos,
)
from turnmill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
