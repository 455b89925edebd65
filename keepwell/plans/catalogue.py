"""All registered queries."""

from keepwell.plans import (  # noqa: F401  (importing registers)
    activity, checks, measures, modelling, profiles, retrieval, risk, stores, streams, texts,
)
from keepwell.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
