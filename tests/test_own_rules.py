import pytest

from leakloom.operators import detect
from leakloom.operators import rules as R


def columns(spark, rule, text):
    lines = spark.createDataFrame([(1, "a.txt", 1, text)], "file_id int, path string, line int, text string")
    return sorted((r.start_column, r.end_column, r.value) for r in detect.findings(lines, (rule,), with_entropy=False).collect())


def test_place_of_the_group(spark):
    rule = R.own("tok", r'(?i)tok="(?P<secret>[0-9a-f]{8})"', "Low", ("TOK=",))
    assert columns(spark, rule, 'é TOK="deadbeef" tok="deadbeef"') == [(9, 16, "deadbeef"), (24, 31, "deadbeef")]
    assert columns(spark, R.own("pair", r"([a-c]+)-x[)(\]]"), "aab-x) c-x]") == [(1, 3, "aab"), (8, 8, "c")]
    assert columns(spark, R.own("whole", "x[0-9]+"), "x1 x22") == [(1, 2, "x1"), (4, 6, "x22")]


@pytest.mark.parametrize("pattern", ["((a)b)", "(a)|b", "(a)(b)", "(?:(a)b)"])
def test_groups_that_have_no_place(pattern):
    with pytest.raises(ValueError):
        R.own("x", pattern)
