"""From findings to logical groups, identities, reviews and reports. The captured value is a grouping key only; nothing here returns it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKED = "CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END"


def evidence_id(mode: str = "source") -> str:
    """SQL: an id from the versioned place, never from the value."""
    return f"concat('ev-v1:', sha2(concat('[\"{mode}\",\"', path, '\",\"', rule, '\",', line, ',', start_column, ',', end_column, ']'), 256))"


def groups(found: DataFrame) -> DataFrame:
    """A row for each captured value: group_id, severity, n_occurrences, n_files, rules (sorted)."""
    keyed = found.selectExpr("sha2(value, 256) AS grouping_key", f"{evidence_id()} AS id", "rule", f"{RANKED} AS rank", "severity", "path")
    out = keyed.groupBy("grouping_key").agg(
        F.sort_array(F.collect_set("id")).alias("ids"),
        F.expr("min_by(severity, rank)").alias("severity"),
        F.expr("CAST(size(collect_set(path)) AS BIGINT)").alias("n_files"),
        F.expr("array_join(array_sort(collect_set(rule)), ',')").alias("rules"),
    )
    return out.selectExpr("concat('group-v1:', sha2(array_join(ids, ','), 256)) AS group_id", "severity", "CAST(size(ids) AS BIGINT) AS n_occurrences", "n_files", "rules")


def reviewed(found: DataFrame, exceptions: DataFrame, now: str) -> DataFrame:
    """id, path, line, rule, severity, status: accepted, expired or blocking. An exception holds before its end only."""
    ids = found.selectExpr(f"{evidence_id()} AS id", "path", "line", "rule", "severity")
    some = exceptions.selectExpr("occurrence_id", f"expires_at > TIMESTAMP '{now}' AS holds")
    status = "CASE WHEN holds THEN 'accepted' WHEN NOT holds THEN 'expired' ELSE 'blocking' END"
    return ids.join(some, F.col("id") == F.col("occurrence_id"), "left").selectExpr("id", "path", "line", "rule", "severity", f"{status} AS status")


def audit(found: DataFrame, exceptions: DataFrame, now: str) -> DataFrame:
    """One row: entries, matched, unmatched, accepted, expired. Every entry is judged by whether its id is that of a finding."""
    ids = found.selectExpr(f"{evidence_id()} AS id").distinct()
    both = exceptions.join(ids, F.col("occurrence_id") == F.col("id"), "left")
    judged = both.selectExpr(f"CASE WHEN id IS NOT NULL THEN expires_at > TIMESTAMP '{now}' END AS holds")
    return judged.selectExpr("count(*) AS entries", "count(holds) AS matched", "count_if(holds IS NULL) AS unmatched", "count_if(holds) AS accepted", "count_if(NOT holds) AS expired")


def merged_spans(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Spans of each key joined where they overlap or touch: gaps and islands over running ends."""
    over = f"PARTITION BY {', '.join(keys)} ORDER BY {start}, {end}"
    flagged = spans.selectExpr("*", f"CASE WHEN {start} <= max({end}) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh")
    numbered = flagged.selectExpr("*", f"sum(fresh) OVER ({over} ROWS UNBOUNDED PRECEDING) AS island")
    return numbered.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("island")
