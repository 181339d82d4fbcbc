"""A scan from files to findings that a report may show: which files are read, what is found on lines that are not suppressed, and the limits."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakloom.functions.sqltext import literal
from leakloom.operators import detect, report, suppress
from leakloom.plans import limits
from leakloom.plans.policy import Policy, load, shown, toml
from leakloom.sources import text


def normalised(path: str) -> str:
    """SQL: a path below its root without empty and single-dot parts; one with two dots is an error, none left is `.`."""
    parts = f"filter(split({path}, '/'), x -> x NOT IN ('', '.'))"
    return f"CASE WHEN array_contains(split({path}, '/'), '..') THEN raise_error(concat('outside of its root: ', {path})) WHEN size({parts}) = 0 THEN '.' ELSE array_join({parts}, '/') END"


def descends(exclusions: tuple[tuple[str, str], ...], path: str = "path") -> str:
    """SQL: whether a walk from the root comes to a file: none of the folders above it is ignored, unless a later exclusion that allows
    has a fixed beginning inside that folder, or around it, or none."""
    def folder_ok(f: str) -> str:  # the last exclusion that matches a folder, or what is in it
        cases = []
        for no in range(len(exclusions) - 1, -1, -1):
            glob, kind = exclusions[no]
            re = literal(text.glob(glob))
            again = []
            for other, k in exclusions[no + 1 :]:
                if k != "ignore":
                    fixed = other[: min([other.index(c) for c in "*?[" if c in other], default=len(other))]
                    again.append(f"startswith('{fixed}', concat({f}, '/')) OR startswith(concat({f}, '/'), '{fixed}')")
            inside = " OR ".join(again) or "false"
            cases.append(f"WHEN {f} RLIKE {re} OR concat({f}, '/') RLIKE {re} THEN {'true' if kind != 'ignore' else inside}")
        return f"CASE {' '.join(cases)} ELSE true END" if cases else "true"

    above = f"transform(sequence(1, size(split({path}, '/')) - 1), n -> array_join(slice(split({path}, '/'), 1, n), '/'))"
    return f"(NOT contains({path}, '/') OR forall({above}, f -> {folder_ok('f')}))"


def chosen(files: DataFrame, policy: Policy, single: bool = False) -> DataFrame:
    """files (path below the root) with policy: those that a scan reads. A file that was named itself is read whatever its extension."""
    name = "element_at(split(path, '/'), -1)"
    out = files.withColumn("path", F.expr(normalised("path")))
    out = out.withColumn("policy", F.expr(text.policy(policy.exclusions, name if single else "path"))).where("policy <> 'ignore'")
    return out if single else out.where(descends(policy.exclusions)).where(text.eligible(extensions=" ".join(policy.extensions)))


def findings(files: DataFrame, policy: Policy) -> tuple[DataFrame, DataFrame]:
    """Findings and warnings of files (file_id, path, content, policy): FINDING columns and snippet, without the value."""
    lines = text.lines(files, "file_id", "path", "content")
    off = suppress.suppressed_lines(files).withColumnsRenamed({"file_id": "_f", "line": "_l"})
    read = lines.join(off, (F.col("file_id") == F.col("_f")) & (F.col("line") == F.col("_l")), "left_anti")
    found = detect.findings(read, policy.rules, policy.entropy, policy.threshold, policy.min_length, keep=("text",))
    shown = report.snippets(found).drop("value", "text").join(files.select(F.col("file_id").alias("_f"), "policy"), F.col("file_id") == F.col("_f")).drop("_f")
    return shown.where("policy <> 'warn'").drop("policy"), shown.where("policy = 'warn'").drop("policy")


def hidden(spark: SparkSession, root: str) -> DataFrame:
    """path, length, content of files with names or folders that begin with a dot or an underscore, which Spark's file sources pass over: listed here
    and read by the workers. Only for folders of a file system that all machines have; in other stores such files are not seen."""
    own = []
    for at, folders, names in os.walk(root):
        folders[:] = [x for x in folders if not os.path.islink(f"{at}/{x}")]
        inside = any(x[0] in "._" for x in os.path.relpath(at, root).split("/") if x != ".")
        own += [(p, os.path.getsize(p)) for p in (f"{at}/{x}" for x in names if inside or x[0] in "._") if os.path.isfile(p) and not os.path.islink(p)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open(path, "rb") as f:
                    yield pa.RecordBatch.from_pydict({"path": [path], "length": [length], "content": [f.read()]})

    return spark.createDataFrame(own, "path string, length long").mapInArrow(read, "path string, length long, content binary")


def folder(spark: SparkSession, root: str, policy: Policy) -> tuple[DataFrame, dict[str, int]]:
    """The files of a folder, or a file, that a scan reads, and their receipt. Contents are read only of those; a limit that is exceeded raises."""
    plain = "url_decode(replace(regexp_replace(path, '^[a-z]+:/*', '/'), '+', '%2B')) AS path"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).selectExpr(plain, "length", "content")
    raw = raw.unionByName(hidden(spark, os.path.abspath(root)))
    single = os.path.isfile(root)
    base = os.path.dirname(os.path.abspath(root)) if single else os.path.abspath(root)
    names = raw.select("path", "length").withColumn("full", F.col("path")).withColumn("path", F.expr(f"substring(path, {len(base) + 2})"))
    own = chosen(names, policy, single)
    most = policy.limits
    sizes = own.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total"), F.coalesce(F.max("length"), F.lit(0)).alias("longest")).first()
    over = [k for k, v in (("max_files", sizes.n), ("max_total_bytes", sizes.total), ("max_file_bytes", sizes.longest)) if v > getattr(most, k)]
    if over:
        raise limits.LimitExceeded(", ".join(over))
    content = F.expr("CASE WHEN NOT is_valid_utf8(content) THEN raise_error(concat('no UTF-8: ', path)) ELSE string(content) END")
    files = own.join(raw.select(F.col("path").alias("full"), "content"), "full").select(F.xxhash64("path").alias("file_id"), "path", content.alias("content"), "policy")
    return files, limits.check(files, most)


def scan(spark: SparkSession, root: str, policy: Policy) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Findings, warnings and the receipt, all limits checked."""
    files, receipt = folder(spark, root, policy)
    found, warned = findings(files, policy)
    limits.check_findings(found, policy.limits)
    return found, warned, receipt


def main(arguments: list[str]) -> int:
    """0: clean, 1: findings, 2: failed, and then nothing is written."""
    parser = argparse.ArgumentParser("leakloom")
    parser.add_argument("command", choices=("scan", "show-config", "generate-config"))
    parser.add_argument("path", nargs="?", default=".")
    parser.add_argument("--config")
    parser.add_argument("--no-config", action="store_true")
    parser.add_argument("--format", choices=("text", "json", "json-report"), default="text")
    own = parser.parse_args(arguments)
    try:
        if own.command == "generate-config":
            print(toml(Policy()), end="")
            return 0
        policy = load(own.config, own.path, not own.no_config)
        if own.command == "show-config":
            print(json.dumps(shown(policy)))
            return 0
        spark = SparkSession.builder.getOrCreate()
        found, warned, receipt = scan(spark, own.path, policy)
        rows = found.orderBy("path", "line", "start_column")
        kind = report.legacy_text(rows) if own.format == "text" else report.legacy_json(rows)
        lines, heard = [x[0] for x in kind.toLocalIterator()], [x[0] for x in report.legacy_text(warned).toLocalIterator()]
    except Exception as e:  # whatever stops a scan, its result is not complete
        print(f"failed: {e}", file=sys.stderr)
        return 2
    for x in heard:
        print(f"warning: {x}", file=sys.stderr)
    if own.format == "text":
        print("\n".join(lines) if lines else "No secrets found!")
        counts = {r.severity: r.n for r in report.summary_counts(found).collect()}
        print(f"\n{receipt['files']} files, {len(lines)} findings: " + ", ".join(f"{k} {v}" for k, v in counts.items()))
    else:
        body = ",\n".join(lines)
        whole = f"[{body}]" if own.format == "json" else f'{{"schema_version":1,"mode":"scan","complete":true,"findings_count":{len(lines)},"coverage":{json.dumps(receipt)},"findings":[{body}]}}'
        print(whole)
    return int(bool(lines))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
