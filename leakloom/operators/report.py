"""From findings to what a report may show: redacted snippets, evidence, occurrences and groups with content-addressed ids, reviews, JSON and text.

Ids are digests of versioned places, never of captured values: evidence of [mode, location, rule, spans], an occurrence of its sorted
evidence ids, a group of its sorted occurrence ids. The captured value is a grouping key that no function here returns.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakloom.functions import constants
from leakloom.operators.findings import RANKED

REDACTED = "[REDACTED]"
CONTEXT = 20
PRIVATE = "private-env:"


def text_json(value: str) -> str:
    """SQL: a text as a JSON string."""
    return f"substring(to_json(array({value})), 2, length(to_json(array({value}))) - 2)"


def identity(kind: str, json: str) -> str:
    """SQL: an id of some compact JSON."""
    return f"concat('{kind}-v1:', sha2({json}, 256))"


def snippets(found: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """found with snippet: CONTEXT characters around each value, in which every captured range of the line is replaced.

    found: file_id, line, start_column, end_column (bytes from 1, the end included); lines: file_id, line, text, or none if found has the text."""
    own = found if lines is None else found.join(lines.select("file_id", "line", F.col("text").alias("_text")), ["file_id", "line"])
    own = own.withColumn("_b", F.col("text" if lines is None else "_text").cast("binary")).drop("_text")
    span = F.struct((F.col("start_column") - 1).alias("s"), F.col("end_column").alias("e"))
    own = own.withColumn("spans", F.array_sort(F.collect_set(span).over(Window.partitionBy("file_id", "line"))))
    # ranges that overlap or touch as one: a fold over the sorted spans, last one held apart
    start = "struct(CAST(NULL AS BIGINT) AS s, CAST(NULL AS BIGINT) AS e, CAST(array() AS ARRAY<STRUCT<s: BIGINT, e: BIGINT>>) AS done)"
    step = "CASE WHEN a.e IS NULL THEN struct(CAST(x.s AS BIGINT) AS s, CAST(x.e AS BIGINT) AS e, a.done AS done) WHEN x.s <= a.e THEN struct(a.s AS s, greatest(a.e, CAST(x.e AS BIGINT)) AS e, a.done AS done) ELSE struct(CAST(x.s AS BIGINT) AS s, CAST(x.e AS BIGINT) AS e, concat(a.done, array(struct(a.s AS s, a.e AS e))) AS done) END"
    own = own.selectExpr("*", f"aggregate(spans, {start}, (a, x) -> {step}, a -> concat(a.done, array(struct(a.s AS s, a.e AS e)))) AS ranges").drop("spans")
    cut = lambda a, n: f"string(substring(_b, CAST({a} + 1 AS INT), CAST({n} AS INT)))"
    own = own.withColumn("_low", F.expr(f"start_column - 1 - octet_length(right({cut(0, 'start_column - 1')}, {CONTEXT}))"))
    own = own.withColumn("_high", F.expr(f"end_column + octet_length(left({cut('end_column', 'octet_length(_b)')}, {CONTEXT}))"))
    inside = "filter(ranges, r -> r.e > _low AND r.s < _high)"
    grow = f"struct(greatest(a.at, least(r.e, _high)) AS at, concat(a.out, CASE WHEN r.s > a.at THEN {cut('a.at', 'r.s - a.at')} ELSE '' END, '{REDACTED}') AS out)"
    text = f"aggregate({inside}, struct(CAST(_low AS BIGINT) AS at, '' AS out), (a, r) -> {grow}, a -> concat(a.out, CASE WHEN a.at < _high THEN {cut('a.at', '_high - a.at')} ELSE '' END))"
    return own.withColumn("snippet", F.expr(text)).drop("_b", "_low", "_high", "ranges")


def evidence(found: DataFrame, mode: str = "source") -> DataFrame:
    """One row per observation: grouping_key, evidence_id, location (JSON), rule, severity, and its span.

    found: path, version (what fixes the bytes: a commit or a digest of the file), rule, severity, line, start_column, end_column,
    value; end_line if spans go over lines, private (boolean) if declared values are among them. Bad spans are an error."""
    own = found if "end_line" in found.columns else found.withColumn("end_line", F.col("line"))
    good = "line > 0 AND start_column > 0 AND struct(end_line, end_column) >= struct(line, start_column)"
    own = own.withColumn("line", F.expr(f"CASE WHEN {good} THEN line ELSE raise_error(concat('bad span in ', path)) END"))
    span = "concat('{\"start_line\":', line, ',\"end_line\":', end_line, ',\"start_column\":', start_column, ',\"end_column\":', end_column, '}')"
    own = own.selectExpr("*", "to_json(struct(path, version)) AS location")
    json = f"concat('[\"{mode}\",', location, ',', {text_json('rule')}, ',[', {span}, ']]')"
    return own.selectExpr("sha2(value, 256) AS grouping_key", f"{identity('evidence', json)} AS evidence_id", "location", "path", "version", "rule", "severity", "line", "start_column", "end_line", "end_column")


def occurrences(observed: DataFrame) -> DataFrame:
    """grouping_key, occurrence_id, location, path, version, primary span, evidence ids (sorted), rules with severities.

    Observations of a value at one location in order: one that lies in the occurrence before it, or around it, belongs to it and narrows it to
    what both have; others begin an occurrence. Groups are those of a value in one file, so that a value that is everywhere is no hot key."""
    point = "struct(line AS l, start_column AS c) AS s, struct(end_line AS l, end_column AS c) AS e"
    row = F.expr(f"struct(line, start_column, evidence_id, {point}, rule, severity)")
    grouped = observed.groupBy("grouping_key", "location", "path", "version").agg(F.sort_array(F.collect_list(row)).alias("every"))
    # in order, equal evidence is adjacent: its id holds the place
    grouped = grouped.withColumn("seen", F.expr("filter(every, (x, i) -> i = 0 OR get(every, i - 1).evidence_id <> x.evidence_id)")).drop("every")
    kind = "STRUCT<s: STRUCT<l: INT, c: INT>, e: STRUCT<l: INT, c: INT>, seen: ARRAY<STRUCT<id: STRING, rule: STRING, severity: STRING>>>"
    one = "array(struct(x.evidence_id AS id, x.rule AS rule, x.severity AS severity))"
    place = lambda p: f"struct(CAST({p}.l AS INT) AS l, CAST({p}.c AS INT) AS c)"
    fresh = f"struct({place('x.s')} AS s, {place('x.e')} AS e, {one} AS seen)"
    last = "element_at(a, -1)"
    nested = f"({last}.s <= {place('x.s')} AND {last}.e >= {place('x.e')}) OR ({last}.s >= {place('x.s')} AND {last}.e <= {place('x.e')})"
    narrowed = f"struct(greatest({last}.s, {place('x.s')}) AS s, least({last}.e, {place('x.e')}) AS e, concat({last}.seen, {one}) AS seen)"
    step = f"CASE WHEN size(a) > 0 AND ({nested}) THEN concat(slice(a, 1, size(a) - 1), array({narrowed})) ELSE concat(a, array({fresh})) END"
    folded = grouped.selectExpr("grouping_key", "location", "path", "version", f"explode(aggregate(seen, CAST(array() AS ARRAY<{kind}>), (a, x) -> {step})) AS o")
    ids = "array_sort(array_distinct(transform(o.seen, x -> x.id)))"
    return folded.selectExpr(
        "grouping_key", f"{identity('occurrence', f'to_json({ids})')} AS occurrence_id", "location", "path", "version",
        "o.s.l AS line", "o.s.c AS start_column", "o.e.l AS end_line", "o.e.c AS end_column", f"{ids} AS evidence_ids", "o.seen AS seen",
    )


def ambiguous(occurred: DataFrame) -> DataFrame:
    """Occurrence ids that stand in two groups: reviews could not tell these apart, so a report stops at any."""
    return occurred.groupBy("occurrence_id").agg(F.count_distinct("grouping_key").alias("n")).where("n > 1").select("occurrence_id")


def checked_exceptions(exceptions: DataFrame, mode: str = "source") -> DataFrame:
    """occurrence_id, kind, reason, reviewed_by, expires_at (text, RFC 3339) with expires_at as a timestamp; any bad field is an error.

    Artifact reports take false positives only, and each id stands once."""
    zone = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$"
    rules = {
        "occurrence_id": "occurrence_id RLIKE '^occurrence-v1:[0-9a-f]{64}$'",
        "kind": "kind = 'false_positive'" if mode == "artifacts" else "kind IN ('false_positive', 'accepted_risk')",
        "reason": "octet_length(trim(reason)) > 0 AND octet_length(reason) <= 1024",
        "reviewed_by": "octet_length(trim(reviewed_by)) > 0 AND octet_length(reviewed_by) <= 256",
        "expires_at": f"expires_at RLIKE '{zone}' AND try_to_timestamp(expires_at) IS NOT NULL",
    }
    out = exceptions.withColumn("_n", F.expr("count(*) OVER (PARTITION BY occurrence_id)"))
    bad = " ".join(f"WHEN NOT coalesce({test}, false) THEN raise_error('bad {name}')" for name, test in rules.items())
    return out.selectExpr(f"CASE {bad} WHEN _n > 1 THEN raise_error('an id twice') ELSE occurrence_id END AS occurrence_id", "kind", "reason", "reviewed_by", "try_to_timestamp(expires_at) AS expires_at")


def masked(exceptions: DataFrame, values: list[str]) -> DataFrame:
    """Reviews without declared private values in their texts."""
    from leakloom.operators.private import contains

    out = exceptions
    for name in ("reason", "reviewed_by"):
        out = out.withColumn(name, F.when(contains(out.sparkSession, values)(F.col(name)), F.lit("[REDACTED PRIVATE VALUE]")).otherwise(F.col(name)))
    return out


def reviewed(occurred: DataFrame, exceptions: DataFrame, now: str) -> DataFrame:
    """occurred with status: accepted before the review's end, expired from then on, rejected_private_value for declared values, else blocking."""
    private = f"exists(seen, x -> startswith(x.rule, '{PRIVATE}'))"
    own = exceptions.selectExpr("occurrence_id AS _id", f"expires_at > TIMESTAMP '{now}' AS _holds")
    status = "CASE WHEN _id IS NULL THEN 'blocking' WHEN _private THEN 'rejected_private_value' WHEN _holds THEN 'accepted' ELSE 'expired' END"
    groups = occurred.withColumn("_private", F.expr(f"max({private}) OVER (PARTITION BY grouping_key)"))
    return groups.join(own, F.col("occurrence_id") == F.col("_id"), "left").withColumn("status", F.expr(status)).drop("_id", "_holds")


def audit(judged: DataFrame, exceptions: DataFrame) -> DataFrame:
    """One row: entries, matched, unmatched, accepted, expired, rejected."""
    own = judged.where("status <> 'blocking'").select("occurrence_id", "status")
    both = exceptions.select(F.col("occurrence_id").alias("_id")).join(own, F.col("_id") == F.col("occurrence_id"), "left")
    counts = [F.count_if(F.col("status") == s).alias(n) for s, n in (("accepted", "accepted"), ("expired", "expired"), ("rejected_private_value", "rejected"))]
    return both.agg(F.count("*").alias("entries"), F.count("status").alias("matched"), F.count_if(F.col("status").isNull()).alias("unmatched"), *counts)


def remediation(mode: str) -> str:
    """SQL over accepted (all occurrences are) and private: what to do."""
    place = "Remove the credential from the introduced commits, refer to a runtime secret instead, and rotate it if it was shared." if mode == "changes" else "Remove the credential from what is published, scan the new build, and rotate it if it was exposed."
    return f"CASE WHEN accepted THEN 'Look at the review again before it ends. It revokes nothing.' WHEN private AND '{mode}' <> 'changes' THEN 'Remove the private value from what is published, build and scan again, and rotate it if it was exposed.' ELSE '{place}' END"


def groups(judged: DataFrame, mode: str = "source") -> DataFrame:
    """One row per captured value: group_id, title, severity (the highest), rules (map of each rule's highest), private names, counts, remediation."""
    # an occurrence counts with the first of what was seen there; one pass, by rule and then by value
    each = judged.selectExpr("grouping_key", "occurrence_id", "status", "posexplode(seen) AS (no, x)")
    by_rule = each.groupBy("grouping_key", F.col("x.rule").alias("rule")).agg(
        F.expr(f"min_by(x.severity, {RANKED.replace('severity', 'x.severity')})").alias("severity"), F.collect_list(F.expr("CASE WHEN no = 0 THEN occurrence_id END")).alias("ids"),
        F.count_if(F.expr("no = 0 AND status <> 'accepted'")).alias("n_blocking"))
    out = by_rule.groupBy("grouping_key").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "severity")))).alias("rules"), F.expr(f"min_by(severity, {RANKED})").alias("severity"),
        F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"), F.sum("n_blocking").alias("blocking_occurrence_count"))
    private = f"transform(filter(map_keys(rules), x -> startswith(x, '{PRIVATE}')), x -> substring(x, {len(PRIVATE) + 1}))"
    out = out.selectExpr("*", f"{identity('group', 'to_json(ids)')} AS group_id", "CAST(size(ids) AS BIGINT) AS occurrence_count", f"array_sort({private}) AS private_env").drop("ids")
    out = out.selectExpr("*", "blocking_occurrence_count = 0 AS accepted", "size(private_env) > 0 AS private")
    title = "CASE WHEN private THEN 'Declared private value' ELSE 'Credential candidate' END"
    return out.selectExpr("grouping_key", "group_id", f"{title} AS title", "severity", "rules", "private_env", "occurrence_count", "blocking_occurrence_count", f"{remediation(mode)} AS remediation")


def totals(judged: DataFrame) -> DataFrame:
    """One row: findings, logical_findings, occurrences, blocking, accepted."""
    return judged.agg(F.sum(F.size("seen")).alias("findings"), F.count_distinct("grouping_key").alias("logical_findings"), F.count("*").alias("occurrences"),
                      F.count_if(F.col("status") != "accepted").alias("blocking"), F.count_if(F.col("status") == "accepted").alias("accepted"))


def exit_code(total: DataFrame) -> int:
    """0 without blocking occurrences, else 1. What fails raises, which a command turns into 2."""
    return int((total.first().blocking or 0) > 0)


def logical_json(judged: DataFrame, mode: str = "source") -> DataFrame:
    """group_id, json: each group as one JSON object with its occurrences and their evidence."""
    primary = F.struct(F.col("line").alias("start_line"), "end_line", "start_column", "end_column")
    one = F.struct(F.col("occurrence_id").alias("id"), F.struct("path", "version").alias("location"), primary.alias("primary"),
                   F.expr("transform(seen, x -> named_struct('id', x.id, 'rule_id', x.rule, 'severity', x.severity))").alias("evidence"), "status")
    inner = judged.groupBy("grouping_key").agg(F.array_sort(F.collect_list(one)).alias("occurrences"))
    out = groups(judged, mode).join(inner, "grouping_key").drop("grouping_key").withColumnRenamed("group_id", "id")
    return out.select(F.col("id").alias("group_id"), F.to_json(F.struct(*out.columns), {"ignoreNullFields": "true"}).alias("json"))


def report_lines(judged: DataFrame, coverage: str, mode: str = "source", scanner: str = "0.1") -> Iterator[str]:
    """The grouped report as text, group by group: the driver holds one group at a time. coverage: a JSON object."""
    t = totals(judged).first()
    yield f'{{"schema_version":3,"mode":"{mode}","complete":true,"scanner_version":"{scanner}","findings_count":{t.findings or 0},"logical_findings_count":{t.logical_findings},"occurrence_count":{t.occurrences},"blocking_occurrence_count":{t.blocking},"accepted_occurrence_count":{t.accepted},"coverage":{coverage},"logical_findings":['
    held = ""
    for row in logical_json(judged, mode).orderBy("group_id").toLocalIterator():
        yield held
        held = row.json + ","
    yield held.rstrip(",") + "]}"


def escaped(value: str) -> str:
    """SQL: a text without control characters that a terminal would act on."""
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({value}, '\\n', '\\\\n'), '\\r', '\\\\r'), '\\t', '\\\\t'), '[\\x00-\\x1f\\x7f-\\x9f]', '?')"


def legacy_text(found: DataFrame) -> DataFrame:
    """line: [SEVERITY] place - rule - snippet, for each of found with snippet."""
    return found.selectExpr(f"concat('[', upper(severity), '] ', {escaped('path')}, ':', line, ' - ', rule, '\\nSnippet: ', {escaped('snippet')}, '\\n') AS line")


def legacy_json(found: DataFrame) -> DataFrame:
    """json: one object for each of found with snippet; fields that are null are left out, the value is never among them."""
    own = [c for c in ("file", "line", "pattern_name", "snippet", "severity", "commit_hash", "commit_author", "commit_date") if c in {"file", "line", "pattern_name", "snippet", "severity"} or c in found.columns]
    named = found.withColumns({"file": F.col("path"), "pattern_name": F.col("rule")})
    return named.select(F.to_json(F.struct(*own), {"ignoreNullFields": "true"}).alias("json"))


def markdown(value: str) -> str:
    """SQL: a text for Markdown, every character but letters and digits as an entity."""
    return f"array_join(transform(split({value}, ''), c -> CASE WHEN c RLIKE '^[A-Za-z0-9]?$' THEN c ELSE concat('&#', ascii(c), ';') END), '')"


def command(value: str) -> str:
    """SQL: a text inside a command of the CI runner."""
    out = value
    for plain, code in (("%", "%25"), ("\\r", "%0D"), ("\\n", "%0A"), (":", "%3A"), (",", "%2C")):
        out = f"replace({out}, '{plain}', '{code}')"
    return out


def summary_counts(found: DataFrame) -> DataFrame:
    """severity, n for every severity, also those without findings."""
    spark = found.sparkSession
    every = spark.createDataFrame([(i, s) for i, s in enumerate(constants.SEVERITIES.split())], "no int, severity string")
    return every.join(found.groupBy("severity").agg(F.count("*").alias("n")), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))
