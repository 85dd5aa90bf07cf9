"""Search and filter predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_ci(col: Column, term: str) -> Column:
    """Substring test, case-insensitive; ``%`` and ``_`` in the term are plain characters."""
    return F.contains(F.lower(col), F.lit(term.lower()))


def any_contains(cols: Sequence[str], term: str | None) -> Column:
    """OR over several columns; no term, no filter."""
    if not term:
        return F.lit(True)
    hit = F.lit(False)
    for name in cols:
        hit = hit | F.coalesce(contains_ci(F.col(name), term), F.lit(False))
    return hit


def search_groups(*groups: tuple[Sequence[str], str | None]) -> Column:
    """AND over groups of OR-ed columns, each group with its own term."""
    keep = F.lit(True)
    for cols, term in groups:
        keep = keep & any_contains(cols, term)
    return keep


def search_joined(cols: Sequence[str], term: str | None) -> Column:
    """Search one text made of several columns with blanks between; a NULL counts as empty."""
    if not term:
        return F.lit(True)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    return contains_ci(F.concat_ws(" ", *parts), term)


def search_with_default(col: str, term: str | None, default: str = "General") -> Column:
    """Search a column in which a missing or empty value counts as ``default``."""
    if not term:
        return F.lit(True)
    value = F.when(F.coalesce(F.col(col), F.lit("")) == "", F.lit(default)).otherwise(F.col(col))
    return contains_ci(value, term)


def exact(**wanted) -> Column:
    """Equality on each given column; None leaves a column open."""
    keep = F.lit(True)
    for name, value in wanted.items():
        if value is not None:
            keep = keep & (F.col(name) == F.lit(value))
    return keep


def history_of(col: str, agent: str) -> Column:
    """Rows whose details start with this agent; a prefix test reaches the scan."""
    return F.col(col).startswith(f"Agent: {agent}")


def is_database_endpoint(source_type: str = "source_type", host: str = "db_host") -> Column:
    return (F.coalesce(F.col(source_type), F.lit("")) == "database") | (F.coalesce(F.col(host), F.lit("")) != "")
