"""SQL text for Catalyst expressions that built-in functions have no name for. Everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLD = 128


def literal(pattern: str) -> str:
    """A regular expression as a raw SQL string."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def bound(value: str, name: str, use: str) -> str:
    """`use`, in which `name` stands for the value, computed once."""
    return f"element_at(transform(array({value}), {name} -> {use}), 1)"


def once(df: DataFrame, **columns: str) -> DataFrame:
    """df with more columns that are computed once for each row: the optimizer copies no expression out of a generator into filters and projections."""
    return df.select("*", F.inline(F.array(F.struct(*(F.expr(e).alias(name) for name, e in columns.items())))))


def running_before(numbers: str) -> str:
    """For each number of an array the sum of those before it; in pieces, so that long arrays stay near-linear."""

    def fold(part: str, start: str) -> str:
        return f"aggregate({part}, struct({start} AS at, CAST(array() AS ARRAY<INT>) AS out), (d, x) -> struct(d.at + x AS at, concat(d.out, array(d.at)) AS out), d -> d.out)"

    pieces = f"transform(CASE WHEN size(ns) > 0 THEN sequence(0, int((size(ns) - 1) / {FOLD})) ELSE CAST(array() AS ARRAY<INT>) END, no -> slice(ns, no * {FOLD} + 1, {FOLD}))"
    starts = fold("transform(ps, p -> aggregate(p, 0, (n, x) -> n + x))", "0")
    return bound(numbers, "ns", bound(pieces, "ps", f"flatten(zip_with(ps, {starts}, (p, start) -> {fold('p', 'start')}))"))


def matches(text: str, pattern: str, secret: int, more: str = "", key: int | None = None, lead: int | None = None) -> str:
    """All leftmost matches as structs: start, end (bytes of the match), at (where the secret begins: after the group `lead`, else so that it
    ends with the match), whole, secret (a group), key, before (all since the match before it, and that), after (one)."""
    re = literal(pattern)
    key = key if lead is None else lead
    names = f"regexp_extract_all({text}, {re}, {key})" if key is not None else "CAST(array() AS ARRAY<STRING>)"
    rows = f"arrays_zip(regexp_extract_all({text}, {re}, 0), regexp_extract_all({text}, {re}, {secret}), {names}, split({text}, {re}, -1))"  # fields 0 to 3
    w, s, k, p = "`0`", "`1`", "`2`", "`3`"
    at = running_before(f"transform(ms, m -> octet_length(m.{p}) + coalesce(octet_length(m.{w}), 0))")
    own = (
        f"struct(at + octet_length(m.{p}) AS start, at + octet_length(m.{p}) + octet_length(m.{w}) AS end, {'at + octet_length(m.' + p + ') + octet_length(m.' + k + ')' if lead is not None else f'at + octet_length(m.{p}) + octet_length(m.{w}) - octet_length(m.{s})'} AS at,"
        f" m.{w} AS whole, m.{s} AS secret, coalesce(m.{k}, '') AS key, concat(coalesce(get(ms, m_no - 1).{w}, ''), m.{p}) AS before, left(concat(coalesce(get(ms, m_no + 1).{p}, ''), coalesce(get(ms, m_no + 1).{w}, '')), 1) AS after{more})"
    )
    numbered = "transform(ms, (m, i) -> struct(m AS m, i AS i))"
    found = f"zip_with({numbered}, {at}, (x, at) -> {bound('x.m', 'm', bound('x.i', 'm_no', own))})"
    return bound(rows, "ms", f"filter({found}, m -> m.whole IS NOT NULL)")


def entropy(value: str) -> str:
    """Shannon entropy of a text of one-byte characters, in bits a byte."""
    n = f"length({value})"
    share = f"(({n} - length(replace({value}, c, ''))) / {n})"
    return f"aggregate(array_sort(array_distinct(split({value}, ''))), 0D, (a, c) -> a - CASE WHEN c = '' THEN 0D ELSE {share} * log2({share}) END)"


def extension(path: str) -> str:
    return f"lower(regexp_extract({path}, {literal('[^/.][^/]*[.]([^/.]+)$')}, 1))"


def basename(path: str) -> str:
    return f"substring_index({path}, '/', -1)"


def one_of(value: str, words: str) -> str:
    return f"{value} IN ({', '.join(repr(x) for x in words.split())})"
