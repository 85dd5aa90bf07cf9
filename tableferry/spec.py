"""Declarations of what to move: endpoints, rules and sync specs."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

# The kinds of source an endpoint can be.
SOURCE_KINDS = ("database", "file", "api", "mongodb", "redis", "minio", "script")


@dataclass(frozen=True)
class Endpoint:
    """Where data is read from or written to.

    ``options`` go to the Spark reader or writer as they are. Secrets belong
    in there (from the caller's secret store), never in a rule's SQL; they are
    kept out of ``repr`` so that logs and plans stay clean.
    """

    kind: str = "database"
    format: str = "parquet"
    path: str | None = None
    options: Mapping[str, str] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        if self.kind not in SOURCE_KINDS:
            raise ValueError(f"unknown source kind: {self.kind}")


@dataclass(frozen=True)
class Rule:
    """One extraction: a query, pattern or file, and the table its rows go to.

    ``source_query`` is what the source's kind asks for: SQL for a database, a name pattern for files, a filter as JSON for
    documents, a key pattern for a key space, nothing for landed API responses (``schema`` is the DDL of one record), a
    name pattern for a mirror, and the query of a script. ``buckets`` above 0 keeps the target as a bucketed table.
    ``range_column`` with ``ranges`` reads a database in that many parallel ranges.
    """

    target_table: str
    source_query: str = ""
    schema: str = ""
    buckets: int = 0
    range_column: str = ""
    ranges: tuple[int, int, int] = (0, 0, 1)
    key: str | None = None
    order_by: tuple[str, ...] = ()
    truncate: bool = False
    extract_pre: str = ""
    extract_post: str = ""
    upload_pre: str = ""
    upload_post: str = ""
    notes: str = ""


@dataclass(frozen=True)
class SyncSpec:
    """A named set of rules between a source and a target, with incremental state."""

    name: str
    source: Endpoint
    target: Endpoint
    rules: tuple[Rule, ...]
    checkpoint_column: str | None = None
    hook_errors: str = "warn"

    def validate(self) -> "SyncSpec":
        from tableferry.functions.names import is_valid_name

        if not self.rules:
            raise ValueError("a sync needs at least one rule")
        for rule in self.rules:
            if not is_valid_name(rule.target_table):
                raise ValueError(f"invalid table name: {rule.target_table!r}")
        if self.hook_errors not in ("warn", "fail"):
            raise ValueError("hook_errors is 'warn' or 'fail'")
        return self
