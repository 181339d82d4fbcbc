"""Limits: exceeding one is an error before any output, never a shorter result."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame


class LimitExceeded(RuntimeError):
    pass


@dataclass(frozen=True)
class Limits:
    # Fixed values.
    max_line_bytes: int = 16 << 20
    max_file_bytes: int = 64 << 20
    max_files: int = 100_000
    max_total_bytes: int = 1 << 30
    max_findings: int = 100_000


def receipt(files: DataFrame) -> DataFrame:
    """One row over files (content): files, total_bytes, longest_file, longest_line."""
    return files.selectExpr("octet_length(content) AS n", "array_max(transform(split(content, '\\n'), x -> octet_length(x))) AS line").selectExpr(
        "count(*) AS files", "coalesce(sum(n), 0) AS total_bytes", "coalesce(max(n), 0) AS longest_file", "coalesce(max(line), 0) AS longest_line"
    )


def check_findings(found: DataFrame, limits: Limits) -> int:
    """The number of findings; more than max_findings raises, since a shorter list would look complete."""
    n = found.count()
    if n > limits.max_findings:
        raise LimitExceeded("max_findings")
    return n


def check(files: DataFrame, limits: Limits) -> dict[str, int]:
    """One job; raises with the name of each limit that is exceeded, and returns the receipt."""
    own = receipt(files).first().asDict()
    pairs = {"max_files": "files", "max_total_bytes": "total_bytes", "max_file_bytes": "longest_file", "max_line_bytes": "longest_line"}
    if over := [k for k, v in pairs.items() if own[v] > asdict(limits)[k]]:
        raise LimitExceeded(", ".join(over))
    return own
