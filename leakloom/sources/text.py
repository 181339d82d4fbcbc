"""Content tables and files as located lines; which paths are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakloom.functions import constants
from leakloom.functions.sqltext import basename, extension, literal, one_of


def files(spark: SparkSession, folder: str, max_file_bytes: int = 64 << 20) -> DataFrame:
    """file_id, path, content of a folder's files, in any store that Spark reads. A file beyond the limit is an error, not a gap."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    checked = F.expr(f"CASE WHEN length > {max_file_bytes} THEN raise_error(concat('file too large: ', path)) WHEN NOT is_valid_utf8(content) THEN raise_error(concat('no UTF-8: ', path)) ELSE string(content) END")
    return raw.select(F.xxhash64("path").alias("file_id"), "path", checked.alias("content"))


def lines(docs: DataFrame, file_id: str, path: str, content: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """file_id, path, line (from 1), text, and the columns to be kept: cut at \\n, without one \\r at the end; no empty line after a last \\n."""
    body = F.expr(f"CASE WHEN {content} = '' THEN CAST(array() AS ARRAY<STRING>) ELSE split(CASE WHEN endswith({content}, '\\n') THEN left({content}, length({content}) - 1) ELSE {content} END, '\\n', -1) END")
    out = docs.select(F.expr(file_id).alias("file_id"), F.expr(path).alias("path"), *keep, F.posexplode(body).alias("no", "raw"))
    return out.selectExpr("file_id", "path", "no + 1 AS line", "CASE WHEN endswith(raw, '\\r') THEN left(raw, length(raw) - 1) ELSE raw END AS text", *keep)


def eligible(path: str = "path", extensions: str = constants.EXTENSIONS) -> str:
    """SQL: whether a path's name or extension is one of those that are read."""
    name = basename(path)
    return f"({one_of(name, constants.LOCKFILES)} OR {one_of(name, constants.EXTENSIONLESS)} OR {name} = '.env' OR startswith({name}, '.env.') OR {one_of(extension(path), extensions)})"


def glob(pattern: str) -> str:
    """A glob as a regular expression: * and ? also cross /, ** stands for whole parts of a path."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern[i : i + 2] == "**" and i + 2 == len(pattern) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + ".*", i + 2
        elif pattern[i] == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]", end + 1
        else:
            c = pattern[i]
            out, i = out + (".*" if c == "*" else "." if c == "?" else ("\\" + c if c in r"\.+()|^$[]{}" else c)), i + 1
    return f"^(?s:{out})$"


DEFAULT_EXCLUSIONS = tuple((f"**/{name}/**", "ignore") for name in constants.IGNORED_FOLDERS.split())


def policy(exclusions: tuple[tuple[str, str], ...] = DEFAULT_EXCLUSIONS, path: str = "path") -> str:
    """SQL: the policy of the last exclusion that matches a path, else 'allow'."""
    cases = " ".join(f"WHEN {path} RLIKE {literal(glob(g))} THEN '{p}'" for g, p in reversed(exclusions))
    return f"CASE {cases} ELSE 'allow' END" if cases else "'allow'"
