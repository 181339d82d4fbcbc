"""What a query costs as its tables grow: scans, shuffles and the share of a task, read off the plans."""

import random
import re

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from leakloom import catalogue
from leakloom.functions.sqltext import bound, entropy
from leakloom.operators import detect, parts
from leakloom.operators import rules as R
from leakloom.sources import text

SF = f"{DATA}/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name,scans,shuffles", [
    ("occurrence_ids", 1, 2), ("reviews_applied", 2, 5), ("scan_findings", 1, 1), ("exception_audit", 3, 8), ("introduced_anti_join", 2, 4), ("redacted_snippets", 1, 1),
    ("top_annotations", 2, 4), ("rule_summary", 1, 3), ("evidence_ids", 1, 1), ("logical_groups", 1, 2), ("report_groups", 1, 4), ("severity_summary", 1, 2),
])
def test_findings_are_made_in_one_pass(spark, name, scans, shuffles):
    got = plan(catalogue.QUERIES[name](spark, SF))
    assert len(re.findall("FileScan", got)) <= scans and len(re.findall(r" Exchange ", got)) <= shuffles


def test_no_rule_is_matched_in_a_filter(spark):
    """A filter on findings is not made of copies of what makes them."""
    filters = [x for x in plan(catalogue.scan_findings(spark, SF)).splitlines() if " Filter " in x]
    assert filters and max(map(len, filters)) < 4000


@pytest.mark.parametrize("query", [catalogue.scan_findings, catalogue.added_line_islands, catalogue.interval_merge])
def test_a_task_has_a_bounded_share(spark, monkeypatch, query):
    monkeypatch.setattr(parts, "ROWS", 50)
    n_rows = spark.read.parquet(f"{SF}/{'orders' if query is catalogue.scan_findings else 'lineitem'}.parquet").count()
    found = [int(n) for n in re.findall(r"Exchange hashpartitioning\(.*, (\d+)\)", plan(query(spark, SF)))]
    assert found == [-(-n_rows // 50)]


def test_many_and_single_matches_on_a_line_are_judged_alike(spark):
    token, secret = "gh" + "p_" + "0123456789abcdef0123456789abcdef0123", "long" + "enough1"
    one = [f"é x {token};", f"password = '{secret}'", f"PASSWORD=${{PW:-'{secret}'}}", f"password = ${{PW:-{secret}}}", "password: your_password_here", f"x{token}"]
    docs = spark.createDataFrame([(i, "a.env", t) for i, t in enumerate([*one, *(f"{t} " + "\t" + t for t in one)])], "file_id long, path string, content string")
    got = {}
    for r in detect.findings(text.lines(docs, "file_id", "path", "content"), with_entropy=False).collect():
        got.setdefault(r.file_id, []).append((r.rule, r.start_column, r.end_column, r.value))
    for i, t in enumerate(one):
        shift = len(f"{t} \t".encode())
        first = got.get(i, [])
        assert sorted(got.get(i + len(one), [])) == sorted([*first, *((r, a + shift, b + shift, v) for r, a, b, v in first)])
    assert [i for i in range(len(one)) if i in got] == [0, 1, 2, 3]
    own = (R.own("tok", r'tok="([0-9a-f]{8})"', "Low"),)
    lines = spark.createDataFrame([(1, "a", 1, 'é tok="deadbeef"', "v1")], "file_id int, path string, line int, text string, version string")
    assert [(r.start_column, r.value, r.version) for r in detect.findings(lines, own, keep=("version",)).collect()] == [(9, "deadbeef", "v1")]


def test_only_one_carriage_return_is_cut(spark):
    docs = spark.createDataFrame([(1, "a\r\r\nb\r")], "i long, t string")
    assert sorted(r.text for r in text.lines(docs, "i", "'p'", "t").collect()) == ["a\r", "b"]


@pytest.mark.parametrize("name", ["severity_summary", "rule_summary", "evidence_ids", "reviews_applied", "top_annotations", "exception_audit"])
def test_a_line_is_told_by_texts_before_patterns(spark, name):
    """No line runs a pattern to be lowered or to split its path, and no rule one to tell whether it is the only one."""
    got = plan(catalogue.QUERIES[name](spark, SF))
    assert "RLIKE(text" not in next(x for x in got.splitlines() if "struct(lowered" in x) and "split(path" not in got
    assert not re.search(r"Contains\(lowered[^)]*\)\)? AND RLIKE\(text", got)


def test_rules_are_chosen_by_all_texts_that_they_need(spark):
    lines = {"password: 'x'": ["Password in Object"], "api_key => `x`": ["Generic API Key"], "a = process.env.SECRET": [], "url = http://host/key": [], "KEY: AKIA": ["AWS Access Key", "AWS Key in Object"], "sk_ || secret=": ["AWS Secret with Fallback", "Stripe Secret Key"]}
    df = spark.createDataFrame([(t.lower(), "a/.env") for t in lines], "lowered string, path string")
    rows = df.selectExpr(*(f"{detect._held(r)} AS r{no}" for no, r in enumerate(R.BUILTIN))).collect()
    assert [sorted(r.name for r, held in zip(R.BUILTIN, row) if held) for row in rows] == list(lines.values())
    some = df.selectExpr(f"{' OR '.join(detect._held_by_some(R.BUILTIN))} AS some").collect()
    assert all(s.some or not names for s, names in zip(some, lines.values()))


def test_the_first_match_is_where_its_text_is_first(spark):
    """A netrc pattern looks before its match: an equal text that is no match comes first here."""
    secret = "long" + "enough1"
    lines = spark.createDataFrame([(1, ".netrc", 1, f"éxpassword {secret} password {secret}"), (2, "a.env", 1, f"é Password: '{secret}'")], "file_id long, path string, line int, text string")
    got = sorted((r.file_id, r.rule, r.start_column, r.value) for r in detect.findings(lines).collect())
    assert got == [(1, "Netrc Password", len(f"éxpassword {secret} password ".encode()) + 1, secret), (2, "Password in Object", len("é Password: '".encode()) + 1, secret)]


def test_an_audit_reads_findings_once_and_exceptions_once(spark):
    got = plan(catalogue.exception_audit(spark, SF))
    assert len(re.findall("FileScan", got)) == 2


def longest_method(spark, df):
    """Bytes of the longest method that a plan's stages are compiled to."""
    generator = spark._jvm.org.apache.spark.sql.catalyst.expressions.codegen.CodeGenerator

    def walk(node):
        own = [generator.compile(node.doCodeGen()._2())._2().maxMethodCodeSize()] if node.nodeName().startswith("WholeStageCodegen") else []
        children = node.children()
        return own + [n for i in range(children.size()) for n in walk(children.apply(i))]

    return max(walk(df._jdf.queryExecution().executedPlan()))


@pytest.mark.parametrize("name", ["rule_summary", "evidence_ids", "severity_summary", "scan_findings", "top_annotations", "redacted_snippets"])
def test_no_method_is_too_long_to_be_compiled(spark, name):
    """The JVM interprets methods of over 8,000 bytes, at half the speed or less; the rest is room for columns that a query adds."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert longest_method(spark, catalogue.QUERIES[name](spark, SF)) < 7000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_rule_summary_shuffles_no_paths(spark, tmp_path):
    rows = [(1, 1, "O"), (1, 2, "O"), (1, 1, "F"), (3, 1, None), (4, 1, "O"), (None, 1, "O"), (8, 1, "P"), (9, 1, "P")]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalogue.rule_summary(spark, str(tmp_path))
    assert len(re.findall(r" Exchange ", plan(got))) == 2
    want = catalogue.scan_findings(spark, str(tmp_path)).groupBy("rule").agg(F.count("*"), F.count_distinct("path"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [("Generic API Key", 1, 1), ("GitHub Token", 1, 1), ("Password in Object", 4, 3), ("npm Access Token", 1, 0)]


def test_lines_without_room_for_random_text_are_left_out_and_no_others(spark):
    """Every value of high entropy is in a line that may hold one, and digits with a prefix are told without counting characters."""
    dice = random.Random(7)
    some = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.+/=:%-"
    values = ["".join(dice.choices(some[: dice.randrange(20, 70)], k=dice.randrange(26, 60))) for _ in range(400)]
    values += ["".join(dice.sample("0123456789abcdef" + "".join(dice.sample(some[6:52] + some[62:], k)), 16 + k)) + "0123" for k in range(9, 15) for _ in range(40)]
    lines = [dice.choice([f'x = "{v}"', f"k:{v}", f"'{v}',", f"a b {v}", f"é🙂 `{v}`", f"k = {v}\u0085"]) for v in values]
    df = spark.createDataFrame([(t,) for t in lines], "text string")
    of_text = f"exists({detect.quoted(30)}, m -> {bound('m.value', 'value', entropy('value'))} >= {{}})"
    for threshold in (3.0, 4.2, 4.8):
        rows = df.selectExpr(f"{of_text.format(threshold)} AS random", f"{detect.may_be_random(threshold, 30)} AS hot").collect()
        assert all(r.hot for r in rows if r.random) and sum(r.random for r in rows) > 20
    told = detect.may_be_random(4.8, 30).split(" AND ")[1]
    digits = "0123456789abcdef" * 3
    plain = spark.createDataFrame([(t,) for t in (f'payload = "gh' + f'p_{digits[:36]}"', f'sha256: "{digits}"', f"api_key => `{digits[:32]}`")], "text string")
    assert plain.where(told).count() == 0
