"""All queries of this subpackage."""

from promptloom.llm import (  # noqa: F401
    decontaminate,
    divergence,
    jaccard,
    langid,
    linedup,
    mixture,
    negatives,
    pages,
    personal,
    secrets,
    substrings,
    toxicity,
    vectors,
)
from promptloom.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
