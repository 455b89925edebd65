"""All registered queries of the corpus operators, and the pipeline."""

import corpus_pipeline
from keepwell.llm import (  # noqa: F401  (importing registers)
    q_alignment, q_audit, q_decontaminate, q_exact, q_lines, q_lm, q_nearest, q_packing, q_pii, q_quality, q_simhash, q_url, q_warc,
)
from keepwell.llm.base import ORACLES, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

__all__ = ["ORACLES", "QUERIES"]
