"""All queries of this subpackage, and the SQL some of them are compared with."""

import corpus_pipeline

from burnish.llm import (  # noqa: F401
    bpe,
    byte_network,
    collocations,
    exact_dedup,
    jaccard_join,
    language,
    merkle,
    mixing,
    neighbours,
    substrings,
    token_counts,
    toxicity,
    warc,
)
from burnish.llm.common import ORACLES, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

__all__ = ["ORACLES", "QUERIES"]
