import hashlib
import json

import pytest

from leakloom.operators import private, report

FOUND = "file_id int, path string, version string, rule string, severity string, line int, start_column int, end_column int, value string"


def test_snippets(spark):
    text = "é" * 30 + "abcSECRETxyzTOKEN" + "ü" * 30
    at = len(("é" * 30 + "abc").encode())
    found = spark.createDataFrame([(1, 1, at + 1, at + 6), (1, 1, at + 10, at + 14), (2, 1, 1, 3), (2, 1, 4, 6)], "file_id int, line int, start_column int, end_column int")
    lines = spark.createDataFrame([(1, 1, text), (2, 1, "abcdef!")], "file_id int, line int, text string")
    got = {(r.file_id, r.start_column): r.snippet for r in report.snippets(found, lines).collect()}
    assert got == {
        (1, at + 1): "é" * 17 + "abc[REDACTED]xyz[REDACTED]" + "ü" * 12,
        (1, at + 10): "é" * 8 + "abc[REDACTED]xyz[REDACTED]" + "ü" * 20,
        (2, 1): "[REDACTED]!", (2, 4): "[REDACTED]!",
    }


def rows(spark):
    some = [(1, "a", "v1", rule, sev, 1, s, e, "k") for rule, sev, s, e in (("wide", "High", 3, 30), ("token", "Critical", 10, 20), ("again", "Low", 10, 20), ("token", "Critical", 40, 50))]
    some += [(2, 'b"\n', "v1", "token", "Critical", 2, 10, 20, "k"), (2, 'b"\n', "v1", "private-env:X", "Critical", 3, 1, 9, "p")]
    return spark.createDataFrame(some + some[:1], FOUND)


def test_occurrences_groups_and_reviews(spark):
    occurred = report.occurrences(report.evidence(rows(spark)))
    got = sorted((r.path, r.line, r.start_column, r.end_column, sorted(x.rule for x in r.seen)) for r in occurred.collect())
    assert got == [("a", 1, 10, 20, ["again", "token", "wide"]), ("a", 1, 40, 50, ["token"]), ('b"\n', 2, 10, 20, ["token"]), ('b"\n', 3, 1, 9, ["private-env:X"])]
    place = json.dumps({"path": 'b"\n', "version": "v1"}, separators=(",", ":"))
    one = "evidence-v1:" + hashlib.sha256(f'["source",{place},"token",[{{"start_line":2,"end_line":2,"start_column":10,"end_column":20}}]]'.encode()).hexdigest()
    by_place = {(r.path, r.line, r.start_column): r.occurrence_id for r in occurred.collect()}
    assert by_place['b"\n', 2, 10] == "occurrence-v1:" + hashlib.sha256(f'["{one}"]'.encode()).hexdigest()
    assert report.ambiguous(occurred).count() == 0
    some = [(by_place["a", 1, 10], "2030-01-01T00:00:00Z"), (by_place["a", 1, 40], "2025-01-01T00:00:00Z"), (by_place['b"\n', 3, 1], "2030-01-01T00:00:00+02:00"), ("occurrence-v1:" + "0" * 64, "2030-01-01T00:00:00Z")]
    exceptions = report.checked_exceptions(spark.createDataFrame([(i, "false_positive", "r", "me", e) for i, e in some], "occurrence_id string, kind string, reason string, reviewed_by string, expires_at string"))
    judged = report.reviewed(occurred, exceptions, "2025-01-01 00:00:00")
    assert {(r.path, r.start_column): r.status for r in judged.collect()} == {("a", 10): "accepted", ("a", 40): "expired", ('b"\n', 10): "blocking", ('b"\n', 1): "rejected_private_value"}
    assert tuple(report.audit(judged, exceptions).first()) == (4, 3, 1, 1, 1, 1)
    t = report.totals(judged)
    assert tuple(t.first()) == (6, 2, 4, 3, 1) and report.exit_code(t) == 1
    g = {r.title: r for r in report.groups(judged).collect()}
    k = g["Credential candidate"]
    assert (k.severity, k.rules, k.occurrence_count, k.blocking_occurrence_count) == ("Critical", {"again": "Low", "token": "Critical", "wide": "High"}, 3, 2)
    assert g["Declared private value"].private_env == ["X"]
    whole = json.loads("".join(report.report_lines(judged, '{"files":2}')))
    assert [len(x["occurrences"]) for x in sorted(whole["logical_findings"], key=lambda x: x["title"])] == [3, 1] and '"value"' not in json.dumps(whole)


@pytest.mark.parametrize("field,value", [("kind", "x"), ("reason", ""), ("reviewed_by", "x" * 300), ("expires_at", "2030-01-01"), ("occurrence_id", "no")])
def test_bad_reviews_stop(spark, field, value):
    row = {"occurrence_id": "occurrence-v1:" + "0" * 64, "kind": "false_positive", "reason": "r", "reviewed_by": "me", "expires_at": "2030-01-01T00:00:00Z"} | {field: value}
    with pytest.raises(Exception, match=f"bad {field}"):
        report.checked_exceptions(spark.createDataFrame([row])).collect()


def test_bad_spans_stop(spark):
    bad = spark.createDataFrame([(1, "a", "v", "r", "Low", 1, 5, 3, "k")], FOUND)
    with pytest.raises(Exception, match="bad span"):
        report.evidence(bad).collect()


def test_private_values(spark):
    values = private.declared(["A", "B", "C"], {"A": "abcabc", "B": "abcabc", "C": "c\nde\n"}, frozenset("ABC"))
    docs = spark.createDataFrame([(1, "abcabcabc"), (2, None), (3, "x\nabc\nde\ny"), (4, "")], "file_id long, content string")
    got = sorted((r.file_id, r.name, r.start, r.line, r.start_column, r.end_line, r.end_column) for r in private.found(docs, values).collect())
    assert got == [(1, "A", 0, 1, 1, 1, 6), (1, "A", 3, 1, 4, 1, 9), (1, "B", 0, 1, 1, 1, 6), (1, "B", 3, 1, 4, 1, 9), (3, "C", 4, 2, 3, 4, 0)]
    for names, env in ((["1x"], {"1x": "long enough"}), (["A"], {}), (["A"], {"A": "short"}), (["A", "A"], {"A": "long enough"})):
        with pytest.raises(ValueError):
            private.declared(names, env)
    masked = report.masked(spark.createDataFrame([("o", "has abcabc in", "me")], "occurrence_id string, reason string, reviewed_by string"), ["abcabc"]).first()
    assert (masked.reason, masked.reviewed_by) == ("[REDACTED PRIVATE VALUE]", "me")


def test_texts(spark):
    found = spark.createDataFrame([("a\x1b\n", 3, "R", "High", "x [REDACTED]")], "path string, line int, rule string, severity string, snippet string")
    assert report.legacy_text(found).first().line == "[HIGH] a?\\n:3 - R\nSnippet: x [REDACTED]\n"
    assert json.loads(report.legacy_json(found).first().json) == {"file": "a\x1b\n", "line": 3, "pattern_name": "R", "snippet": "x [REDACTED]", "severity": "High"}
    got = spark.range(1).selectExpr(f"{report.markdown(chr(39) + 'a<b' + chr(39))} AS m", f"{report.command(chr(39) + 'a:b,c%' + chr(39))} AS c").first()
    assert (got.m, got.c) == ("a&#60;b", "a%3Ab%2Cc%25")
    assert {r.severity: r.n for r in report.summary_counts(found).collect()} == {"Critical": 0, "High": 1, "Medium": 0, "Low": 0}
