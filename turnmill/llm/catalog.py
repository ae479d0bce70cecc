"""All queries of this subpackage, loaded from their modules."""

import corpus_pipeline
from turnmill.llm import (  # noqa: F401
    chat,
    class_lm,
    decontaminate,
    html_extract,
    langid,
    packing,
    prefix_trie,
    quality,
    relative_lz,
    sharding,
    simhash,
    suffix_groups,
    whitening,
)
from turnmill.llm.registry import ORACLES, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

__all__ = ["ORACLES", "QUERIES"]
