"""Scalar Column helpers. All are built-in Spark expressions (codegen, no Python)."""

from vsframe.functions.scalar import (
    TRUE_TOKENS,
    as_column,
    in_aliases,
    lenient,
    pair_label,
    period_predicate,
    truthy,
)

__all__ = [
    "TRUE_TOKENS",
    "as_column",
    "in_aliases",
    "lenient",
    "pair_label",
    "period_predicate",
    "truthy",
]
