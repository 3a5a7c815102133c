"""Symbol text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed


def normalized(symbol: Column) -> Column:
    return F.upper(F.trim(symbol))


def is_valid(symbol: Column) -> Column:
    """Whether a normalized symbol may name a series."""
    base = F.element_at(F.split(symbol, r"\."), 1)
    return (symbol.rlike(fixed.SYMBOL_PATTERN) & ~symbol.endswith(".")
            & ~base.rlike(fixed.RESERVED_SYMBOL_PATTERN))
