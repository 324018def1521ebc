"""Bounds on what one statement may use."""

from __future__ import annotations

from dataclasses import dataclass

from .errors import ResourceLimit

DATABASE_BYTES, STORAGE_WORKING_BYTES, SQL_BYTES = "database bytes", "storage working bytes", "SQL bytes"
WHERE_PREDICATES, CHECK_PREDICATES, JOIN_SOURCES = "WHERE predicates", "CHECK predicates", "JOIN sources"
PATTERN_BYTES, QUERY_WORKING_BYTES, QUERY_OUTPUT_BYTES = "generated regex bytes", "query working bytes", "query output bytes"
JOIN_STEPS, BACKTRACKING = "JOIN execution steps", "regex backtracking steps"
MIB = 1 << 20


@dataclass(frozen=True)
class Limits:
    """max_query_working_bytes, max_join_steps and regex_backtrack_limit are kept for the interface only: Spark spills, and no
    step of a hash join or of the scans here corresponds to them."""

    max_database_bytes: int = 64 * MIB
    max_sql_bytes: int = 64 * 1024
    max_predicates: int = 64
    max_join_sources: int = 64
    max_pattern_bytes: int = 8 * MIB
    max_query_working_bytes: int = 32 * MIB
    max_query_output_bytes: int = 32 * MIB
    max_join_steps: int = 1_000_000
    regex_backtrack_limit: int = 1_000_000

    @property
    def storage_working_bytes(self) -> int:
        return 4 * self.max_database_bytes


def check(used: int, limit: int, resource: str) -> None:
    if used > limit:
        raise ResourceLimit(resource, limit)
