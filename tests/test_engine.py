import os

import duckdb
import pytest
from conftest import DATA

import __spark_entry__
from leakloom import catalogue
from leakloom.operators import detect, findings, history
from leakloom.operators import rules as R
from leakloom.plans import limits
from leakloom.sources import text

SF = f"{DATA}/sf0.001"
HEX = "0123456789abcdef" * 4


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, db, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = db.sql(catalogue.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    own = sorted(tuple(str(r[c]) for c in columns) for r in got.collect())
    assert own == sorted(tuple(str(dict(zip(want.columns, r, strict=True))[c]) for c in columns) for r in want.fetchall())


def test_groups_reviews_and_introduced_take_all_findings(spark):
    n = catalogue.scan_findings(spark, SF).count()
    judged = {r.status: r.n for r in catalogue.QUERIES["reviews_applied"](spark, SF).collect()}
    assert sum(judged.values()) == n > catalogue.provider_tokens(spark, SF).count()
    assert "Database Connection String" in {r.rule for r in catalogue.QUERIES["introduced_anti_join"](spark, SF).collect()}
    assert catalogue.QUERIES["logical_groups"](spark, SF).agg({"n_occurrences": "sum"}).first()[0] == n


def scan(spark, files, **more):
    docs = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "file_id long, path string, content string")
    rows = detect.findings(text.lines(docs, "file_id", "path", "content"), **more).collect()
    return sorted((r.file_id, r.line, r.rule, r.start_column, r.end_column) for r in rows)


def test_provider_tokens_in_all_contexts(spark):
    tokens = {"GitHub Token": "gh" + "p_" + HEX[:36], "npm Access Token": "np" + "m_" + HEX[:36], "Stripe Secret Key": "sk" + "_live_" + HEX[:24], "AWS Access Key": "AK" + "IA" + "ABCDEFGH01234567"}
    contexts = ["k={}", 'k="{}"', '{{"k":"{}"}}', "k: '{}'", "k = `{}`;", "'k' => '{}',", 'k := "{}"', "{}"]
    files, want = [], []
    for rule, token in tokens.items():
        for c in contexts:
            at = c.format("\0").index("\0") + 1
            want.append((len(files), 1, rule, at, at + len(token) - 1))
            files.append((f"f{len(files)}.txt", c.format(token)))
    assert scan(spark, files, with_entropy=False) == sorted(want)


def test_boundaries_dense_lines_and_bytes(spark):
    token = "gh" + "p_" + HEX[:36]
    assert scan(spark, [("a.md", f"x{token} {token}y {token}_z"), ("b.md", f"{token},{token}"), ("c.md", f"é🙂 {token}")], with_entropy=False) == [(1, 1, "GitHub Token", 1, 40), (1, 1, "GitHub Token", 42, 81), (2, 1, "GitHub Token", 8, 47)]
    assert len(scan(spark, [("d.txt", f'"{token}" ' * 4096)])) == 4096


def test_benign_lines_and_assignments(spark):
    benign = "\n".join(
        ["password = process.env.PASSWORD", 'password: "${SECRET}"', "password = var.secret_value", 'password = "your_password_here"', "password: ${{ secrets.TOKEN }}", f'api_key = "{"0" * 40}"', f'sha256 = "{HEX}"', 'key = "pk' + f'_live_{HEX[:24]}"', "postgres:" + "//localhost/db", "postgres:" + "//user:$PASSWORD@host/db", "notpassword = os.getenv('A')"]
    )
    assert scan(spark, [("a.env", benign)]) == []
    secret = "long" + "enough1"
    got = scan(spark, [("a.py", f"password = {secret}\npassword = '{secret}'"), ("b.env", f"password = {secret}\r\n\nPASSWORD=${{PW:-{secret}}}"), (".netrc", f"machine m password {secret}")], with_entropy=False)
    assert got == [(0, 2, "Password Assignment", 13, 23), (1, 1, "Password Assignment", 12, 22), (1, 3, "Password Assignment", 16, 26), (2, 1, "Netrc Password", 20, 30)]


def test_entropy(spark):
    value = "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0fX"
    got = scan(spark, [("a.py", f'x = "{value}"'), ("a.py", f'sha256 = "{value}"'), ("go.sum", f'x = "{value}"'), ("b.py", "x = " + value + ";")], threshold=4.5)
    assert got == [(0, 1, "high-entropy", 6, 37), (3, 1, "high-entropy", 5, 36)]


def test_own_rule_with_a_built_in_name_keeps_its_meaning(spark):
    own = (R.Rule("GitHub Token", "0{40}", "Low", "plain", "true", builtin=False),)
    assert scan(spark, [("a", "x" + "0" * 40 + "y")], rules=own, with_entropy=False) == [(0, 1, "GitHub Token", 2, 41)]


def test_lines_paths_and_globs(spark):
    docs = spark.createDataFrame([(1, "a\r\nb\n\nc\n"), (2, ""), (3, None), (4, "\n")], "i long, t string")
    assert sorted(tuple(r)[::2] + (r.text,) for r in text.lines(docs, "i", "'p'", "t").selectExpr("file_id", "path", "line", "text").collect()) == [(1, 1, "a"), (1, 2, "b"), (1, 3, ""), (1, 4, "c"), (4, 1, "")]
    import re

    table = [("**/x/**", "a/x/b", True), ("**/x/**", "x/b", True), ("**/x/**", "a/xy/b", False), ("*.env", "a/b.env", True), ("a?c", "abc", True), ("[!a]b", "cb", True), ("[!a]b", "ab", False), ("a.b", "axb", False)]
    assert [bool(re.match(text.glob(g).replace("(?s:", "(?s:"), p)) for g, p, _ in table] == [x for *_, x in table]


def test_limits_fail_closed(spark):
    files = spark.createDataFrame([("abc\ndefgh",), ("x",)], "content string")
    assert limits.check(files, limits.Limits()) == {"files": 2, "total_bytes": 10, "longest_file": 9, "longest_line": 5}
    with pytest.raises(limits.LimitExceeded, match="max_files, max_line_bytes|max_line_bytes|max_files"):
        limits.check(files, limits.Limits(max_files=1, max_line_bytes=4))


def test_reachability_on_long_and_merged_histories(spark):
    rows = [(i, i - 1 if i else None) for i in range(300)] + [(250, 40), (300, 299), (300, 1000), (1000, 5)]
    edges = spark.createDataFrame(rows, "commit long, parent long")
    got = {r[0] for r in history.introduced(edges, spark.createDataFrame([(300,)], "commit long"), spark.createDataFrame([(120,)], "commit long")).collect()}
    assert got == set(range(121, 301)) | {1000}


def test_histories_have_no_cap(spark, tmp_path):
    sizes = {1: 1, 2: 16, 3: 17, 4: 230}
    rows = [(u, e, u * 1000 + e) for u, n in sizes.items() for e in range(n)]
    spark.createDataFrame(rows, "user_id long, ts long, event_id long").write.parquet(f"{tmp_path}/events.parquet")

    def reached(tip):
        seen, todo = set(), [tip]
        while todo:
            n = todo.pop()
            if n >= 1 and n not in seen:
                seen.add(n)
                todo += [n - 1, n - 4] if n % 5 == 0 else [n - 1]
        return seen

    want = {u * 10**9 + n for u, last in sizes.items() for n in reached(last) - reached((last + 1) // 2)}
    assert {r[0] for r in catalogue.reachable_except(spark, str(tmp_path)).collect()} == want and 4 * 10**9 + 230 in want


def test_new_findings_and_groups(spark):
    row = "path string, line int, start_column int, rule string, value string, text string"
    child = spark.createDataFrame([("a", 1, 1, "r", "v", "x v"), ("a", 3, 1, "r", "v", "x v"), ("b", 1, 1, "r", "v", "x v")], row)
    parents = spark.createDataFrame([("a", 7, 1, "r", "v", "x v")], row)
    assert sorted((r.path, r.line) for r in history.new_findings(child, parents).collect()) == [("a", 3), ("b", 1)]
    found = child.selectExpr("*", "'High' AS severity", "start_column AS end_column")
    g = findings.groups(found).collect()
    assert len(g) == 1 and (g[0].n_occurrences, g[0].n_files) == (3, 2) and "grouping_key" not in g[0].asDict()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
