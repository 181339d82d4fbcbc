import json
import os

import pytest

from leakloom.operators import suppress
from leakloom.plans import limits, policy, scan

GH = "ghp" + "_" + "aB3" * 12


def suppressed(path, text):
    own = suppress.Reader(path)
    return [i for i, x in enumerate(text.split("\n"), 1) if own.suppressed(x)]


@pytest.mark.parametrize("path,text,want", [
    ("a.js", "x // leakloom-ignore\ny\n// leakloom-ignore-next\nz\nw", [1, 3, 4]), ("a.js", "'// leakloom-ignore'\n\"\\\" // leakloom-ignore", []), ("a.js", "/* // leakloom-ignore\n*/ x // LEAKLOOM-IGNORE now", [2]),
    ("a.py", "x // leakloom-ignore", []), ("a.rs", "fn f<'a>() {} // leakloom-ignore", [1]), ("a.rs", "r#\"x\" // leakloom-ignore\"# // leakloom-ignore\n'c' // leakloom-ignore", [1, 2]),
    ("a.js", "`open\n// leakloom-ignore\n` // leakloom-ignore", [3]), ("a.c", "/* /* */ // leakloom-ignore\n*/ // leakloom-ignore", [2]), ("a.go", "// leakloom-ignored\n//leakloom-ignore", [2]), (".js", "// leakloom-ignore", []),
])
def test_directives(path, text, want):
    assert suppressed(path, text) == want


def tree(root, files):
    for name, content in files.items():
        os.makedirs(os.path.dirname(root / name), exist_ok=True)
        (root / name).write_bytes(content if isinstance(content, bytes) else content.encode())


def test_scan_from_files_to_exit_code(spark, tmp_path, capsys):
    line = f'key = "{GH}"\n'
    tree(tmp_path, {"a b+c.js": line + f"// leakloom-ignore-next\n{line}", "x/y.exe": line, "vendor/z.js": line, "w/k.md": line, "sub/deep/.env": line, "leakloom.toml": '[[exclusions]]\npattern = "w/**"\npolicy = "ScanButWarn"\n'})
    assert scan.main(["scan", str(tmp_path), "--format", "json"]) == 1
    out = capsys.readouterr()
    got = json.loads(out.out)
    assert [(x["file"], x["line"], x["snippet"]) for x in got] == [("a b+c.js", 1, 'key = "[REDACTED]"'), ("sub/deep/.env", 1, 'key = "[REDACTED]"')]
    assert "w/k.md:1" in out.err and GH not in out.out + out.err
    assert scan.main(["scan", str(tmp_path / "x/y.exe"), "--no-config"]) == 1  # named itself
    assert "1 files, 1 findings: Critical 1" in capsys.readouterr().out
    (tmp_path / "leakloom.toml").write_text("[limits]\nmax_findings = 1\n")
    assert scan.main(["scan", str(tmp_path)]) == 2 and capsys.readouterr().out == ""
    (tmp_path / "bad.js").write_bytes(b"\xff\xfe")
    assert scan.main(["scan", str(tmp_path), "--no-config"]) == 2 and capsys.readouterr().out == ""


def test_pruning(spark):
    rules = (("**/vendor/**", "ignore"), ("a/vendor/keep/**", "allow"), ("b/*.log", "ignore"))
    paths = ["a/vendor/keep/x.js", "a/vendor/y.js", "b/vendor/keep/x.js", "c.js", "b/z.log", "./d//e.js"]
    got = scan.chosen(spark.createDataFrame([(p,) for p in paths], "path string"), policy.Policy(exclusions=rules)).collect()
    assert sorted(r.path for r in got) == ["a/vendor/keep/x.js", "c.js", "d/e.js"]
    with pytest.raises(Exception, match="outside"):
        scan.chosen(spark.createDataFrame([("../x.js",)], "path string"), policy.Policy()).collect()


def test_policy_files(tmp_path):
    own = policy.merged('extensions = [".ABC"]\n[entropy]\nenabled = false\n[limits]\nmax_files = 3\n[[patterns]]\nname = "JWT Token"\npattern = "x(?P<secret>[0-9]+)y"\nseverity = "Low"\n[[exclusions]]\npattern = "**/vendor/**"\npolicy = "ScanButAllow"\n')
    assert own.extensions[-1] == "abc" and not own.entropy and own.limits.max_files == 3 and own.exclusions[-1] == ("**/vendor/**", "allow") and len(own.exclusions) == len(policy.DEFAULT_EXCLUSIONS)
    rule = next(r for r in own.rules if r.name == "JWT Token")
    assert not rule.builtin and len(own.rules) == len(policy.R.BUILTIN)
    assert policy.merged(policy.toml(policy.Policy())) == policy.Policy()
    for bad in ("x = 1", "[entropy]\nthreshold = 9", "[limits]\nmax_files = 0", "[git]\nsince_date = '2024-1-1'", "[git]\nsince_date = '2024-02-01'\nuntil_date = '2024-01-01'", "[[patterns]]\nname = 'a'\npattern = '('", "[[exclusions]]\npattern = 'a'\npolicy = 'no'", "[entropy]\nenabled = 1", "a ="):
        with pytest.raises(policy.PolicyError):
            policy.merged(bad)
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / policy.NAME).write_text("")
    assert policy.discovered(str(tmp_path / "a/b")) == str(tmp_path / policy.NAME)
    (tmp_path / "a/.git").mkdir()
    assert policy.discovered(str(tmp_path / "a/b")) is None


def test_max_findings(spark):
    with pytest.raises(limits.LimitExceeded):
        limits.check_findings(spark.range(3), limits.Limits(max_findings=2))
