"""All queries of the subpackage; importing the modules fills the registry."""

from gridlens.llm import (  # noqa: F401
    archive, bpe, decontamination, divergence, language, line_dedup, merkle, ngram_jaccard, quality, secrets, sharding, token_counts, toxicity,
)
from gridlens.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
