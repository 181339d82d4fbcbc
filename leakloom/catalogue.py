"""Every query of the engine by name, and its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakloom.functions import constants
from leakloom.functions.sqltext import entropy
from leakloom.operators import decode, detect, history, private, report, suppress
from leakloom.operators import findings as results
from leakloom.operators import rules as R
from leakloom.operators.parts import spread
from leakloom.plans import corpus, limits
from leakloom.sources import text

NOW = "2025-01-01 00:00:00"
LINES = f"(WITH corpus AS ({corpus.sql('duckdb')}) SELECT file_id, path, CAST(i AS INTEGER) AS line, l[i] AS text FROM (SELECT file_id, path, string_split(content, chr(10)) AS l FROM corpus), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.lines(corpus.spread_files(spark, sf_dir), "file_id", "path", "content")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return text.lines(docs, "doc_id", "concat(source, '/', doc_id, '.txt')", "text")


def lines_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_lines(spark, sf_dir).selectExpr("file_id", "line", "CAST(octet_length(text) AS BIGINT) AS n_bytes", "sha2(text, 256) AS text_sha256")


def byte_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = document_lines(spark, sf_dir).selectExpr("file_id", "line", "octet_length(text) + 1 AS n")
    return own.selectExpr("file_id", "line", "CAST(sum(n) OVER (PARTITION BY file_id ORDER BY line) - n AS BIGINT) AS start_byte")


def path_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.files(spark, sf_dir).selectExpr("path", f"{text.eligible()} AS eligible")


EXCLUSIONS = (("**/vendor/**", "ignore"), ("src/o/**", "warn"), ("**/f*2.env", "allow"))


def exclusion_last_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.files(spark, sf_dir).selectExpr("path", f"{text.policy(EXCLUSIONS)} AS policy")


def placed(found: DataFrame) -> DataFrame:
    """Findings as a sink may see them: without the value."""
    return found.selectExpr("file_id", "path", "line", "rule", "severity", "CAST(start_column AS BIGINT) AS start_column", "CAST(end_column AS BIGINT) AS end_column")


def scan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(detect.findings(corpus_lines(spark, sf_dir)))


def provider_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = tuple(r for r in R.BUILTIN if r.kind == "token")
    return placed(detect.findings(corpus_lines(spark, sf_dir), some, with_entropy=False))


def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_findings(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n"))


def rule_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a path holds its file's id, by which files are dealt out: a file's findings are counted where they are made, and no path is shuffled
    by_file = scan_findings(spark, sf_dir).groupBy("file_id", "path", "rule").agg(F.count("*").alias("n"))
    return by_file.groupBy("rule").agg(F.sum("n").alias("n"), F.count("path").alias("n_files"))


CUSTOM = (R.own("Planted token", 'token = "([0-9a-f]{40})"', "Low", ("token",)),)


def custom_rule_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.findings(document_lines(spark, sf_dir), CUSTOM, with_entropy=False)
    return found.selectExpr("file_id", "line", "CAST(start_column AS BIGINT) AS start_column", "CAST(end_column AS BIGINT) AS end_column", "sha2(value, 256) AS value_sha256")


def entropy_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_lines(spark, sf_dir).transform(detect.quoted_values).where("before LIKE '%\"'").selectExpr("file_id", "line", "sha2(value, 256) AS value_sha256", "round(entropy, 9) AS entropy").distinct()


def entropy_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"round({entropy('p_name')}, 9) AS entropy")


def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_partkey % 1000 AS start", "l_partkey % 1000 + CAST(l_quantity AS BIGINT) * 4 AS end")
    return results.merged_spans(spread(spans, ["l_orderkey"], spans.count()), ["l_orderkey"])


def _every(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return detect.findings(corpus_lines(spark, sf_dir), keep=keep)


def logical_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.groups(_every(spark, sf_dir))


def _exceptions(found: DataFrame) -> DataFrame:
    ids = found.where("file_id % 3 = 0").selectExpr(f"{results.evidence_id()} AS occurrence_id", "CASE WHEN file_id % 2 = 0 THEN TIMESTAMP '2030-01-01' ELSE TIMESTAMP '2025-01-01' END AS expires_at")
    return ids.union(found.sparkSession.sql("SELECT 'gone' AS occurrence_id, TIMESTAMP '2031-01-01' AS expires_at"))


def reviews_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _every(spark, sf_dir)
    return results.reviewed(found, _exceptions(found), NOW).groupBy("status").agg(F.count("*").alias("n"))


def exception_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _every(spark, sf_dir)
    return results.audit(found, _exceptions(found), NOW)


def top_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _every(spark, sf_dir)
    judged = results.reviewed(found, _exceptions(found), NOW)
    return judged.selectExpr("status = 'accepted' AS accepted", "path", "CAST(line AS BIGINT) AS line", "rule").orderBy("accepted", "path", "line", "rule").limit(100)


def added_line_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS file_id", "l_partkey % 40 AS line")
    return history.added_intervals(spread(added, ["file_id"], added.count()).distinct(), ["file_id"])


def _histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit for every event, with its user's last number: each the child of the one before, every fifth also of the fourth before."""
    numbered = table(spark, sf_dir, "events").selectExpr("user_id", "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n", "count(*) OVER (PARTITION BY user_id) AS last")
    own = numbered.selectExpr("user_id * 1000000000 + n AS commit", "n", "last")
    first = own.selectExpr("commit", "n", "last", "CASE WHEN n > 1 THEN commit - 1 END AS parent")
    return first.union(own.where("n % 5 = 0").selectExpr("commit", "n", "last", "commit - 4 AS parent"))


def reachable_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's last commit reaches, without what its middle one does."""
    edges = _histories(spark, sf_dir).withColumn("repo", F.expr("commit div 1000000000"))
    heads = edges.where("n = last").selectExpr("repo", "commit", "false AS base")
    bases = edges.where("n = (last + 1) div 2").selectExpr("repo", "commit", "true AS base")
    return history.scopes(edges.select("repo", "commit", "parent"), heads.union(bases).distinct()).select("commit")


def date_filtered_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = "ts >= TIMESTAMP '2024-01-01 00:00:00' AND ts < TIMESTAMP '2024-01-08 00:00:00'"
    return table(spark, sf_dir, "events").selectExpr("count(*) AS reachable", f"count_if({picked}) AS selected", f"count_if(NOT ({picked})) AS omitted_by_date")


def inventory_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = corpus.files(spark, sf_dir).selectExpr("path", "octet_length(content) AS size", "sha2(content, 256) AS sha256")
    then = corpus.files(spark, sf_dir).where("file_id % 50 <> 7").selectExpr("path AS p", "octet_length(content) AS s", "sha2(CASE WHEN file_id % 50 = 9 THEN concat(content, 'x') ELSE content END, 256) AS h")
    state = "CASE WHEN p IS NULL THEN 'added' WHEN path IS NULL THEN 'missing' WHEN size <> s OR sha256 <> h THEN 'changed' ELSE 'equal' END AS state"
    return now.join(then, F.col("path") == F.col("p"), "full_outer").selectExpr(state).groupBy("state").agg(F.count("*").alias("n"))


def engine_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows of 4 KiB every 2 KiB over the bytes of documents."""
    own = table(spark, sf_dir, "documents").where("text <> ''").selectExpr("doc_id", "CAST(text AS BINARY) AS b")
    cut = own.selectExpr("doc_id", "b", "explode(sequence(0, octet_length(b) - 1, 2048)) AS start")
    return cut.selectExpr("doc_id", "CAST(start AS BIGINT) AS start", "sha2(substring(b, start + 1, 4096), 256) AS window_sha256")


def introduced_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _every(spark, sf_dir, ("text",))
    old = found.where("file_id % 3 <> 1")
    return placed(history.new_findings(found, old))


def coverage_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = limits.receipt(corpus.files(spark, sf_dir))
    return own.select(*(F.col(c).cast("long").alias(c) for c in own.columns))


def _versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings with the digest of their file as its version."""
    files = corpus.spread_files(spark, sf_dir).withColumn("version", F.expr("sha2(content, 256)"))
    return detect.findings(text.lines(files, "file_id", "path", "content", ("version",)), keep=("version",))


def redacted_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.snippets(_every(spark, sf_dir, ("text",))).select("path", "line", "rule", "snippet")


def evidence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.evidence(_versioned(spark, sf_dir)).select("path", "line", "rule", "evidence_id")


def _occurred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.occurrences(report.evidence(_versioned(spark, sf_dir)))


def occurrence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _occurred(spark, sf_dir).selectExpr("path", "line", "occurrence_id", "CAST(size(evidence_ids) AS BIGINT) AS n_evidence")


def report_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all findings, where no occurrence is reviewed."""
    judged = _occurred(spark, sf_dir).withColumn("status", F.lit("blocking"))
    return report.groups(judged).selectExpr("group_id", "title", "severity", "to_json(rules) AS rules", "occurrence_count", "blocking_occurrence_count")


NEEDLES = {"A": b"tio", "B": b"ion", "C": b"io", "D": b". "}


def private_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return private.found(docs, NEEDLES, "text", "doc_id").select("doc_id", "name", "start", "end")


def changed_file_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit for each customer whose files are its orders; its first parent lacks some and has others, its second has some of the new ones."""
    own = table(spark, sf_dir, "orders").selectExpr("o_custkey AS commit", "concat(CASE o_orderkey % 7 WHEN 3 THEN 'vendor/' ELSE 'src/' END, o_orderkey) AS path", "o_orderkey AS k", "sha2(CAST(o_orderkey AS STRING), 256) AS blob")
    child = own.where("k % 5 <> 1").selectExpr("commit", "path", "blob", "'100644' AS mode")
    first = own.where("k % 5 <> 2").selectExpr("commit", "0 AS parent_no", "path", "CASE k % 5 WHEN 3 THEN 'old' ELSE blob END AS blob", "'100644' AS mode")
    second = own.where("k % 3 = 0").selectExpr("commit", "1 AS parent_no", "path", "blob", "'100644' AS mode")
    changes = history.changed_files(child, first.unionByName(second), "startswith(path, 'vendor/')")
    return changes.selectExpr("coalesce(reason, 'inspected') AS reason").groupBy("reason").agg(F.count("*").alias("n"))


def decoded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A private value in Base64 of a third of the customers' names, in plain names of another, and cut short in the rest."""
    names = "CASE c_custkey % 3 WHEN 0 THEN concat('x ', base64(CAST(c_name AS BINARY)), ' y') WHEN 1 THEN c_name ELSE base64(CAST(left(c_name, 9) AS BINARY)) END"
    docs = table(spark, sf_dir, "customer").selectExpr("c_custkey AS file_id", f"{names} AS content")
    out = decode.inspected(docs, {"NAME": b"Customer#0"})
    return out.select("file_id", F.explode("found").alias("f")).select("file_id", "f.name", "f.chain", "f.start", "f.end", "f.line", "f.start_column")


def suppressed_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a directive suppresses, in files of two lines for each customer: in code, in a quote, in another language, for the next line."""
    lines = "CASE c_custkey % 5 WHEN 0 THEN 'x = 1 // leakloom-ignore\\ny = 2' WHEN 1 THEN 'x = \"// leakloom-ignore\"\\ny = 2' WHEN 2 THEN '// LEAKLOOM-ignore-next\\ny = 2' WHEN 3 THEN '/* a\\n*/ // leakloom-ignore' ELSE 'plain\\ny' END"
    files = table(spark, sf_dir, "customer").selectExpr("c_custkey AS file_id", "concat('f', c_custkey, CASE c_custkey % 2 WHEN 0 THEN '.js' ELSE '.py' END) AS path", f"{lines} AS content")
    return suppress.suppressed_lines(files)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        lines_explode, byte_offsets, path_eligibility, exclusion_last_match, scan_findings, provider_tokens, severity_summary, rule_summary, custom_rule_tokens, entropy_values, entropy_of_words,
        interval_merge, logical_groups, reviews_applied, exception_audit, top_annotations, added_line_islands, reachable_except, date_filtered_commits, inventory_verify, engine_windows, introduced_anti_join, coverage_receipt,
        redacted_snippets, evidence_ids, occurrence_ids, report_groups, private_overlaps, changed_file_reasons, suppressed_comments, decoded_values,
    )
}

_DOC_LINES = r"(SELECT doc_id AS file_id, CAST(i AS INTEGER) AS line, regexp_replace(l[i], '\r$', '') AS text FROM (SELECT doc_id, string_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS l FROM documents WHERE text <> ''), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i))"
_CORPUS = corpus.sql("duckdb")
_NAMES = ", ".join(f"'{x}'" for x in constants.EXTENSIONS.split())
_EDGE = "(?:^|[^A-Za-z0-9_])"
# each line of the corpus holds one credential at most
_FOUND = f"""
SELECT file_id, path, line, rule, severity, start_column, start_column + strlen(value) - 1 AS end_column, value FROM (
  SELECT *, CAST(strlen(left(text, position(value IN text) - 1)) + 1 AS BIGINT) AS start_column FROM (
    SELECT *, 'GitHub Token' AS rule, 'Critical' AS severity, regexp_extract(text, '{_EDGE}(gh[pousr]_[A-Za-z0-9]{{36}})(?:$|[^A-Za-z0-9_])', 1) AS value FROM {LINES}
    UNION ALL SELECT *, 'npm Access Token', 'Critical', regexp_extract(text, '{_EDGE}(npm_[A-Za-z0-9]{{36}})(?:$|[^A-Za-z0-9_])', 1) FROM {LINES}
    UNION ALL SELECT *, 'Password in Object', 'High', regexp_extract(text, 'password: ''([^'']{{8,}})''', 1) FROM {LINES}
    UNION ALL SELECT *, 'Generic API Key', 'High', regexp_extract(text, 'api_key => `([0-9a-f]{{32}})`', 1) FROM {LINES}
    UNION ALL SELECT *, 'Database Connection String', 'Critical', regexp_extract(text, 'postgres://[a-z]+:[0-9a-f]+@host/db', 0) FROM {LINES}
  ) WHERE value <> '')"""
_TOKENS = f"(SELECT * FROM ({_FOUND}) WHERE rule LIKE '% Token')"
_PLACED = "file_id, path, line, rule, severity, start_column, end_column"
_ID = "'ev-v1:' || sha256('[\"source\",\"' || path || '\",\"' || rule || '\",' || line || ',' || start_column || ',' || end_column || ']')"
_EXCEPTIONS = f"(SELECT {_ID} AS occurrence_id, file_id % 2 = 0 AS holds FROM ({_FOUND}) WHERE file_id % 3 = 0 UNION ALL SELECT 'gone', true)"
_JUDGED = f"(SELECT t.*, CASE WHEN holds THEN 'accepted' WHEN NOT holds THEN 'expired' ELSE 'blocking' END AS status FROM (SELECT *, {_ID} AS id FROM ({_FOUND})) t LEFT JOIN {_EXCEPTIONS} e ON id = occurrence_id)"
_HISTORIES = """WITH RECURSIVE numbered AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS last FROM events),
edges AS (SELECT user_id * 1000000000 + n AS c, n, last, CASE WHEN n > 1 THEN user_id * 1000000000 + n - 1 END AS p FROM numbered UNION ALL SELECT user_id * 1000000000 + n, n, last, user_id * 1000000000 + n - 4 FROM numbered WHERE n % 5 = 0),
head AS (SELECT c FROM edges WHERE n = last UNION SELECT p FROM head JOIN edges USING (c) WHERE p IS NOT NULL),
base AS (SELECT c FROM edges WHERE n = (last + 1) // 2 UNION SELECT p FROM base JOIN edges USING (c) WHERE p IS NOT NULL)"""

_VERSIONED = f"(SELECT f.*, sha256(c.content) AS version FROM ({_FOUND}) f JOIN ({_CORPUS}) c USING (file_id))"
_EVIDENCE = f"""(SELECT *, 'evidence-v1:' || sha256('["source",{{"path":"' || path || '","version":"' || version || '"}},"' || rule || '",[{{"start_line":' || line || ',"end_line":' || line || ',"start_column":' || start_column || ',"end_column":' || end_column || '}}]]') AS evidence_id FROM {_VERSIONED})"""
_OCCURRED = f"""(SELECT *, 'occurrence-v1:' || sha256('["' || evidence_id || '"]') AS occurrence_id FROM {_EVIDENCE})"""

ORACLES: dict[str, str] = {
    "redacted_snippets": f"SELECT f.path, f.line, f.rule, right(left(l.text, p - 1), 20) || '[REDACTED]' || left(substr(l.text, p + length(value)), 20) AS snippet FROM (SELECT f.*, l.text, position(value IN l.text) AS p FROM ({_FOUND}) f JOIN {LINES} l USING (file_id, line)) f, LATERAL (SELECT f.text) l",
    "evidence_ids": f"SELECT path, line, rule, evidence_id FROM {_EVIDENCE}",
    "occurrence_ids": f"SELECT path, line, occurrence_id, CAST(1 AS BIGINT) AS n_evidence FROM {_OCCURRED}",
    "report_groups": f"""SELECT 'group-v1:' || sha256('["' || string_agg(occurrence_id, '","' ORDER BY occurrence_id) || '"]') AS group_id, 'Credential candidate' AS title, any_value(severity) AS severity, '{{"' || any_value(rule) || '":"' || any_value(severity) || '"}}' AS rules, count(*) AS occurrence_count, count(*) AS blocking_occurrence_count FROM {_OCCURRED} GROUP BY value""",
    "private_overlaps": "SELECT doc_id, name, start, start + n AS \"end\" FROM (SELECT doc_id, name, v, n, b, unnest(range(0, greatest(strlen(text) - n + 1, 0))) AS start FROM (SELECT doc_id, text, encode(text) AS b, name, v, strlen(v) AS n FROM documents, (VALUES ('A', 'tio'), ('B', 'ion'), ('C', 'io'), ('D', '. ')) AS x(name, v) WHERE contains(text, v))) WHERE b[start + 1 : start + n] = encode(v)",
    "decoded_values": "SELECT c_custkey AS file_id, 'NAME' AS name, 'base64' AS chain, CAST(2 AS BIGINT) AS start, CAST(18 AS BIGINT) AS \"end\", CAST(1 AS BIGINT) AS line, CAST(3 AS BIGINT) AS start_column FROM customer WHERE c_custkey % 3 = 0 AND contains(c_name, 'Customer#0')",
    "changed_file_reasons": "SELECT CASE WHEN k % 5 = 1 THEN 'deleted' WHEN k % 7 = 3 THEN 'trusted exclusion' WHEN k % 3 = 0 THEN 'content unchanged in a parent' ELSE 'inspected' END AS reason, count(*) AS n FROM (SELECT o_orderkey AS k FROM orders) WHERE k % 5 IN (1, 2, 3) GROUP BY 1",
    "suppressed_comments": "SELECT c_custkey AS file_id, CAST(l AS INTEGER) AS line FROM (SELECT c_custkey, unnest(CASE c_custkey % 5 WHEN 0 THEN [1] WHEN 2 THEN [1, 2] WHEN 3 THEN [2] ELSE [] END) AS l FROM customer WHERE c_custkey % 2 = 0)",
    "lines_explode": f"SELECT file_id, line, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256 FROM {_DOC_LINES}",
    "byte_offsets": f"SELECT file_id, line, CAST(sum(strlen(text) + 1) OVER (PARTITION BY file_id ORDER BY line) - strlen(text) - 1 AS BIGINT) AS start_byte FROM {_DOC_LINES}",
    "path_eligibility": f"SELECT path, regexp_extract(path, '[^/]\\.([a-z]+)$', 1) IN ({_NAMES}) AS eligible FROM ({_CORPUS})",
    "exclusion_last_match": f"SELECT path, CASE WHEN path LIKE '%/f%2.env' THEN 'allow' WHEN path LIKE 'src/o/%' THEN 'warn' WHEN path LIKE '%/vendor/%' THEN 'ignore' ELSE 'allow' END AS policy FROM ({_CORPUS})",
    "scan_findings": f"SELECT {_PLACED} FROM ({_FOUND})",
    "provider_tokens": f"SELECT {_PLACED} FROM {_TOKENS}",
    "severity_summary": f"SELECT severity, count(*) AS n FROM ({_FOUND}) GROUP BY severity",
    "rule_summary": f"SELECT rule, count(*) AS n, count(DISTINCT path) AS n_files FROM ({_FOUND}) GROUP BY rule",
    # the k-th match of 50 bytes begins after k pieces and k - 1 matches
    "custom_rule_tokens": f"SELECT file_id, line, CAST(p0 AS BIGINT) AS start_column, CAST(p0 + 39 AS BIGINT) AS end_column, sha256(vs[k]) AS value_sha256 FROM (SELECT *, list_sum([strlen(x) for x in pieces[:k]]) + 50 * (k - 1) + 10 AS p0 FROM (SELECT *, unnest(range(1, len(vs) + 1)) AS k FROM (SELECT *, regexp_extract_all(text, 'token = \"([0-9a-f]{{40}})\"', 1) AS vs, regexp_split_to_array(text, 'token = \"[0-9a-f]{{40}}\"') AS pieces FROM {_DOC_LINES})))",
    "entropy_values": f"""WITH q AS (SELECT DISTINCT file_id, line, v FROM (SELECT file_id, line, unnest(regexp_extract_all(text, '"([^"\\\\]*(?:\\\\.[^"\\\\]*)*)"', 1)) AS v FROM {_DOC_LINES}) WHERE length(v) >= 30 AND NOT (contains(v, '/') AND contains(v, '.')) AND regexp_full_match(v, '[A-Za-z0-9_.+/=:%-]+'))
SELECT file_id, line, sha256(v) AS value_sha256, round(-sum(s * log2(s)), 9) AS entropy FROM (SELECT file_id, line, v, count(*) / length(v) AS s FROM (SELECT *, unnest(string_split(v, '')) AS c FROM q) GROUP BY file_id, line, v, c) GROUP BY file_id, line, v""",
    "entropy_of_words": "SELECT p_partkey, round(-sum(s * log2(s)), 9) AS entropy FROM (SELECT p_partkey, count(*) / any_value(length(p_name)) AS s FROM (SELECT p_partkey, p_name, unnest(string_split(p_name, '')) AS c FROM part) GROUP BY p_partkey, c) GROUP BY p_partkey",
    "interval_merge": """SELECT l_orderkey, min(s) AS start, max(e) AS "end", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM (
SELECT l_orderkey, l_partkey % 1000 AS s, l_partkey % 1000 + CAST(l_quantity AS BIGINT) * 4 AS e FROM lineitem))) GROUP BY l_orderkey, island""",
    "logical_groups": f"SELECT 'group-v1:' || sha256(string_agg(id, ',' ORDER BY id)) AS group_id, any_value(severity) AS severity, count(*) AS n_occurrences, count(DISTINCT path) AS n_files, any_value(rule) AS rules FROM (SELECT *, {_ID} AS id FROM ({_FOUND})) GROUP BY value",
    "reviews_applied": f"SELECT status, count(*) AS n FROM {_JUDGED} GROUP BY status",
    "exception_audit": f"SELECT (SELECT count(*) FROM {_EXCEPTIONS}) AS entries, count(*) AS matched, CAST(1 AS BIGINT) AS unmatched, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'expired') AS expired FROM {_JUDGED} WHERE status <> 'blocking'",
    "top_annotations": f"SELECT status = 'accepted' AS accepted, path, CAST(line AS BIGINT) AS line, rule FROM {_JUDGED} ORDER BY 1, 2, 3, 4 LIMIT 100",
    "added_line_islands": "SELECT file_id, min(line) AS first_line, max(line) AS last_line FROM (SELECT *, line - row_number() OVER (PARTITION BY file_id ORDER BY line) AS island FROM (SELECT DISTINCT l_orderkey AS file_id, l_partkey % 40 AS line FROM lineitem)) GROUP BY file_id, island",
    "reachable_except": f'{_HISTORIES} SELECT c AS "commit" FROM head WHERE c NOT IN (SELECT c FROM base)',
    "date_filtered_commits": "SELECT count(*) AS reachable, count(*) FILTER (p) AS selected, count(*) FILTER (NOT p) AS omitted_by_date FROM (SELECT ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-08' AS p FROM events)",
    "inventory_verify": f"SELECT CASE file_id % 50 WHEN 7 THEN 'added' WHEN 9 THEN 'changed' ELSE 'equal' END AS state, count(*) AS n FROM ({_CORPUS}) GROUP BY 1",
    "engine_windows": "SELECT doc_id, start, sha256(b[start + 1 : start + 4096]) AS window_sha256 FROM (SELECT doc_id, encode(text) AS b, unnest(range(0, strlen(text), 2048)) AS start FROM documents WHERE text <> '')",
    "introduced_anti_join": f"SELECT {_PLACED} FROM ({_FOUND}) WHERE file_id % 3 = 1",
    "coverage_receipt": f"SELECT count(*) AS files, CAST(sum(strlen(content)) AS BIGINT) AS total_bytes, max(strlen(content)) AS longest_file, max(list_max([strlen(x) for x in string_split(content, chr(10))])) AS longest_line FROM ({_CORPUS})",
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity_summary(spark, sf_dir)
