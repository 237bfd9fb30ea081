"""Paging arithmetic and score scales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ranking contract.
DISTANCE_THRESHOLD = 0.7
RRF_CONSTANT = 60.0
DEFAULT_LIMIT = 10
MAX_LIMIT = 100
MIN_CANDIDATES = 150
MAX_CANDIDATES = 800
CANDIDATE_FACTOR = 8


def page_limit(limit: Column) -> Column:
    return F.least(F.coalesce(limit, F.lit(DEFAULT_LIMIT)), F.lit(MAX_LIMIT)).cast("long")


def page_offset(page: Column, limit: Column) -> Column:
    """Rows to skip. Pages count from 1; a lower page is an error."""
    number = F.coalesce(page, F.lit(1)).cast("long")
    checked = F.when(number >= 1, number).otherwise(
        F.raise_error(F.lit("page must be at least 1")).cast("long")
    )
    return (checked - 1) * page_limit(limit)


def candidates(limit: Column, offset: Column) -> Column:
    wanted = (limit + offset) * CANDIDATE_FACTOR
    return F.least(F.greatest(wanted, F.lit(MIN_CANDIDATES)), F.lit(MAX_CANDIDATES))


def rrf(rank: Column) -> Column:
    """Reciprocal-rank term; a leg without the row adds nothing."""
    return F.coalesce(F.lit(1.0) / (F.lit(RRF_CONSTANT) + rank), F.lit(0.0))


def vector_score(distance: Column) -> Column:
    return F.least(F.greatest((F.lit(1.0) - distance) * 100, F.lit(0.0)), F.lit(100.0))


def hybrid_score(score: Column) -> Column:
    best = 2.0 / (RRF_CONSTANT + 1.0)
    return F.least(score / F.lit(best) * 100, F.lit(100.0))


def percent(value: Column) -> Column:
    """Display form such as ``87.5%``; use the numeric column for comparisons."""
    return F.format_string("%.1f%%", value)
