"""Commit graphs and revisions: what a head has that a base lacks, and which findings its parents had already."""

from __future__ import annotations

import tempfile
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _shared(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="leakloom-"))
    return df.checkpoint()


def reachable(edges: DataFrame, tips: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """commit: everything that the tips reach by (commit, parent). Sets of nodes grow by rounds; each node is visited once.

    Reached sets are squared: every round joins what is known of ancestors with itself, so the rounds grow with the logarithm of the depth."""
    hops = _shared(edges.where("parent IS NOT NULL").select("commit", "parent").distinct())
    seen = _shared(tips.select("commit").distinct())
    n = seen.count()
    for _ in range(max_rounds):
        # the reached set by one jump of the present length, then jumps of twice that length
        seen = _shared(seen.union(seen.join(hops, "commit").select(F.col("parent").alias("commit"))).distinct())
        m = seen.count()
        longer = hops.alias("a").join(hops.alias("b"), F.col("a.parent") == F.col("b.commit")).select("a.commit", "b.parent").distinct()
        if m == n:
            # no jump of this length adds anything: try single steps once more, then end
            step = seen.join(edges.where("parent IS NOT NULL"), "commit").select(F.col("parent").alias("commit")).distinct().join(seen, "commit", "left_anti")
            if step.isEmpty():
                return seen
            seen = _shared(seen.union(step))
            m = seen.count()
        n = m
        hops = _shared(longer.union(edges.where("parent IS NOT NULL").select("commit", "parent")).distinct()) if not longer.isEmpty() else hops
    raise RuntimeError(f"no end after {max_rounds} rounds")


def introduced(edges: DataFrame, head: DataFrame, base: DataFrame) -> DataFrame:
    """commit: what the head reaches and the base does not."""
    return reachable(edges, head).join(reachable(edges, base), "commit", "left_anti")


def scopes(edges: DataFrame, tips: DataFrame, max_depth: int | None = None) -> DataFrame:
    """repo, commit, distance, generation for all that the tips reach and no base does, for all repositories in one pass.

    edges: repo, commit (long), parent (null for roots); tips: repo, commit, base (boolean). A repository's graph goes to one task, as a few
    arrays; its edges are walked once. distance is the number of steps from the nearest head, generation the longest way up from a
    root (or from what is not in the range): sorted by it, parents come before children. More than max_depth commits in a range, and a parent that has no
    row of its own, are errors."""
    sides = edges.selectExpr("repo", "commit", "parent", "CAST(NULL AS BOOLEAN) AS base").unionByName(tips.selectExpr("repo", "commit", "CAST(NULL AS BIGINT) AS parent", "base"))

    def run(table: pa.Table) -> pa.Table:
        repo = table.column("repo")[0].as_py()
        base, commits, parents = (table.column(k).to_numpy(zero_copy_only=False) for k in ("base", "commit", "parent"))
        is_tip = np.array([x is not None for x in base])
        known, inverse = np.unique(commits, return_inverse=True)
        rows = np.flatnonzero(~is_tip & ~np.isnan(parents.astype(float)))
        up = np.searchsorted(known, parents[rows].astype(np.int64))
        there = np.zeros(len(known), bool)
        there[inverse[~is_tip]] = True
        if (up >= len(known)).any() or (known[np.minimum(up, len(known) - 1)] != parents[rows].astype(np.int64)).any() or not there[up].all() or not there[inverse[is_tip]].all():
            raise ValueError(f"a commit of {repo} is missing")
        order = np.argsort(inverse[rows], kind="stable")
        child, up = inverse[rows][order], up[order]
        first = np.searchsorted(child, np.arange(len(known) + 1))

        def walk(start: np.ndarray, apart: np.ndarray) -> np.ndarray:
            """Steps from the start to each commit, -1 where none lead; not into what is apart."""
            steps = np.full(len(known), -1, np.int64)
            front, n = np.unique(start[~apart[start]]), 0
            while len(front):
                steps[front] = n
                counts = first[front + 1] - first[front]
                reach = up[np.repeat(first[front] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))]
                front, n = np.unique(reach[(steps[reach] < 0) & ~apart[reach]]), n + 1
            return steps

        tips_at = np.flatnonzero(is_tip)
        is_base = np.array([bool(base[i]) for i in tips_at], bool)
        old = walk(inverse[tips_at[is_base]], np.zeros(len(known), bool)) >= 0
        steps = walk(inverse[tips_at[~is_base]], old)
        own = np.flatnonzero(steps >= 0)
        if max_depth is not None and len(own) > max_depth:
            raise ValueError(f"more than {max_depth} commits in the range of {repo}")
        inside = (steps[child] >= 0) & (steps[up] >= 0)
        a, b = child[inside], up[inside]
        waiting = np.bincount(a, minlength=len(known))
        by_parent = np.argsort(b, kind="stable")
        kids, begin = a[by_parent], np.searchsorted(b[by_parent], np.arange(len(known) + 1))
        generation, front, n = np.zeros(len(known), np.int64), own[waiting[own] == 0], 0
        while len(front):
            generation[front] = n
            counts = begin[front + 1] - begin[front]
            reach = kids[np.repeat(begin[front] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))]
            np.subtract.at(waiting, reach, 1)
            reach = np.unique(reach)
            front, n = reach[waiting[reach] == 0], n + 1
        return pa.table({"repo": pa.array([repo] * len(own), table.schema.field("repo").type), "commit": known[own], "distance": steps[own], "generation": generation[own]})

    kind = edges.schema["repo"].dataType.simpleString()
    return sides.groupBy("repo").applyInArrow(run, f"repo {kind}, commit long, distance long, generation long")


def changed_files(child: DataFrame, parents: DataFrame, excluded: str = "false") -> DataFrame:
    """commit, path, blob, reason: why a file of a commit is not inspected (deleted, trusted exclusion, unchanged in a parent), or null.

    child: commit, path, blob, mode; parents: commit (the child's), parent_no, path, blob, mode. Whatever differs from the first parent is a change;
    it is unchanged if any parent has the same regular blob at that path. Links and other kinds of entries are an error. excluded: SQL over path."""
    regular = "mode IN ('100644', '100755')"
    first = parents.where("parent_no = 0").selectExpr("commit AS _c", "path AS _p", "blob AS _b", "mode AS _m")
    both = child.join(first, (F.col("commit") == F.col("_c")) & (F.col("path") == F.col("_p")), "full_outer")
    both = both.where("NOT (blob <=> _b AND mode <=> _m)").selectExpr("coalesce(commit, _c) AS commit", "coalesce(path, _p) AS path", "blob", "mode")
    same = parents.where(regular).selectExpr("commit AS _c", "path AS _p", "blob AS _b").distinct()
    out = both.join(same, (F.col("commit") == F.col("_c")) & (F.col("path") == F.col("_p")) & (F.col("blob") == F.col("_b")), "left")
    checked = f"CASE WHEN blob IS NOT NULL AND NOT ({excluded}) AND NOT ({regular}) THEN raise_error(concat('no regular file: ', path)) ELSE blob END"
    return out.selectExpr("commit", "path", f"{checked} AS blob", f"CASE WHEN blob IS NULL THEN 'deleted' WHEN {excluded} THEN 'trusted exclusion' WHEN _c IS NOT NULL THEN 'content unchanged in a parent' END AS reason")


def skipped(changes: DataFrame) -> DataFrame:
    """reason, n."""
    return changes.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def date_scope(commits: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """One row over commits (committed_at): reachable, selected, omitted_by_date. Whole days in UTC, both included; the dates are YYYY-MM-DD."""
    tests = []
    for day, sign in ((since, ">= TIMESTAMP '{} 00:00:00'"), (until, "<= TIMESTAMP '{} 23:59:59'")):
        if day is not None:
            if len(day) != 10:
                raise ValueError(f"no date: {day}")
            date.fromisoformat(day)
            tests.append("date_trunc('second', committed_at) " + sign.format(day))
    picked = " AND ".join(tests) or "true"
    return commits.selectExpr("count(*) AS reachable", f"count_if({picked}) AS selected", f"count_if(NOT ({picked})) AS omitted_by_date")


def merge_result(commits: DataFrame, head: int, base: int) -> DataFrame:
    """The commits (commit, parents) that may be the result of merging base and head; any other is an error."""
    good = f"size(parents) >= 2 AND array_contains(parents, {head}L) AND array_contains(parents, {base}L)"
    return commits.withColumn("commit", F.expr(f"CASE WHEN {good} THEN commit ELSE raise_error(concat('no merge of base and head: ', commit)) END"))


def added_intervals(lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """Closed intervals of line numbers in a row."""
    numbered = lines.selectExpr(*keys, line, f"{line} - row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {line}) AS island")
    return numbered.groupBy(*keys, "island").agg(F.min(line).alias("first_line"), F.max(line).alias("last_line")).drop("island")


def new_findings(child: DataFrame, parents: DataFrame) -> DataFrame:
    """Findings (path, rule, value, text of the line) of a revision that none of its parents has on an equal line, each as often as it is more frequent."""
    keys = ["path", "rule", "value", "text"]
    ranked = lambda df: df.selectExpr("*", f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY line, start_column) AS turn")
    return ranked(child).join(ranked(parents).select(*keys, "turn"), [*keys, "turn"], "left_anti").drop("turn")
