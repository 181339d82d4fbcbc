import base64
import json
import urllib.parse

import pytest

from leakloom.operators import decode
from leakloom.plans.limits import LimitExceeded


def found(text, values, depth=4):
    own = decode.Inspection(text, values, depth).run()
    return [(n, chain, text[a:b]) for n, _, chain, a, b, *_ in own.found]


SECRET = b"s3cret-value"


def test_kinds():
    b64 = base64.b64encode(SECRET)
    assert found(b"x " + b64 + b" y", {"A": SECRET}) == [("A", "base64", b64)]
    url = b"a%73%33cret-value"
    assert found(b"q=" + url + b"&z", {"A": SECRET}) == [("A", "url_percent", url[1:])]
    assert [g[1] for g in found(b"with+space%21x", {"A": b"with space!"})] == ["url_percent > url_form", "url_form"]
    assert found(b'{"k": "s\\u0033cret-v\\u0061lue"}', {"A": SECRET}) == [("A", "json_string", b"s\\u0033cret-v\\u0061lue")]
    assert found(b'"\\n s3cret-value"', {"A": SECRET}) == []  # stands there as it is
    assert found(b'"open \\u0073\\u0033cret-value\\"', {"A": SECRET}) == [] and found(b"%zz%7", {"A": b"%zz"}) == []


def test_overlaps_nesting_and_places():
    assert len(found(base64.b64encode(b"ababa"), {"A": b"aba"})) == 2
    inner = json.dumps(urllib.parse.quote(base64.b64encode(SECRET + b"??>").decode(), safe="")).replace("%", "\\u0025")
    got = found(f"x\n{{{inner}}}".encode(), {"A": SECRET})
    assert "json_string > url_percent > base64" in [g[1] for g in got]
    own = decode.Inspection(f"x\n {base64.b64encode(SECRET).decode()}".encode(), {"A": SECRET}, 4).run()
    assert own.found[0][5:] == (2, 2, 2, 17) and own.depth == 1
    with pytest.raises(LimitExceeded):
        found(f"{{{inner}}}".encode(), {"A": SECRET}, 2)


@pytest.mark.parametrize("n", range(1, 9))
def test_every_range_of_base64(n):
    data = bytes(range(65, 65 + n))
    for a in range(n):
        for b in range(a + 1, n + 1):
            for text in (base64.b64encode(data), base64.b64encode(data).rstrip(b"=")):
                got = [g for g in found(text, {"A": data[a:b]}) if g[1] == "base64"]
                assert [g[2] for g in got] == [text[a // 3 * 4 : min((b + 2) // 3 * 4, len(text))]], (data, a, b)


@pytest.mark.parametrize("text", [b"YR==", b"YQ=", b"YQ===", b"Y", b"ab+_", b"YQ==YQ=="])
def test_no_canonical_base64(text):
    assert decode.decoded("base64", text) is None


def test_frames(spark):
    docs = spark.createDataFrame([(1, base64.b64encode(SECRET).decode()), (2, None), (3, ""), (4, "plain")], "file_id long, content string")
    out = decode.inspected(docs, {"A": SECRET})
    assert {r.file_id: len(r.found) for r in out.collect()} == {1: 1, 2: 0, 3: 0, 4: 0}
    assert decode.coverage(out)["depth"] == 1
    with pytest.raises(LimitExceeded, match="max_decode_work_bytes"):
        decode.coverage(out, decode.Limits(max_decode_work_bytes=3))
