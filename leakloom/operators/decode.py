"""Declared private values inside Base64, URL and JSON text, to a depth, with the places that they come from.

Each decoded byte knows the range of its input that gave it, so that a match is traced through all steps back to bytes of the file. A match whose
bytes stand there as they are was found in the file itself and is passed over. Work is counted for each file; `checked` sums it and stops at limits."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakloom.operators.private import Lines, places
from leakloom.plans.limits import LimitExceeded

# The order in which kinds are tried.
KINDS = ("json_string", "url_percent", "url_form", "base64")


@dataclass(frozen=True)
class Limits:
    # Fixed values.
    max_decode_depth: int = 4
    max_decode_candidates: int = 1_000_000
    max_decoded_bytes: int = 1 << 30
    max_decode_work_bytes: int = 8 << 30


_QUOTED = re.compile(rb'"(?:[^"\\]|\\.)*+(?:"|\\?\Z)', re.S)
_SEGMENT = re.compile(rb"[^ \t\n\f\r\x00\"'`<>]+")
_RUN = re.compile(rb"[A-Za-z0-9+/_-]+=*")
_ESCAPE = re.compile(rb"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\.", re.S)
_PERCENT = re.compile(rb"%[0-9A-Fa-f]{2}")
_PERCENT_PLUS = re.compile(rb"%[0-9A-Fa-f]{2}|\+")


def candidates(kind: str, data: bytes, least: int) -> Iterator[tuple[int, int]]:
    """(start, end) of what may be text of a kind, of at least so many bytes."""
    if kind == "base64":
        found = (m.span() for m in _RUN.finditer(data) if len(m[0]) * 3 // 4 >= least)
    elif kind == "json_string":
        found = (m.span() for m in _QUOTED.finditer(data) if b"\\" in m[0] and len(m[0]) > 1 and m[0].endswith(b'"') and not _open(m[0]))
    else:
        found = (m.span() for m in _SEGMENT.finditer(data) if (b"+" if kind == "url_form" else b"%") in m[0])
    return ((a, b) for a, b in found if b - a >= least)


def _open(text: bytes) -> bool:
    """Whether the last quote of a quoted text is an escaped one, so that it never ends."""
    body = text[:-1]
    return (len(body) - len(body.rstrip(b"\\"))) % 2 == 1


def decoded(kind: str, text: bytes) -> tuple[bytes, np.ndarray, np.ndarray] | None:
    """The decoded bytes, and for each the range of text that gave it; None if the text is not of the kind, or says itself."""
    if kind == "base64":
        url, plain, body = re.search(rb"[-_]", text), re.search(rb"[+/]", text), text.rstrip(b"=")
        if (url and plain) or len(body) % 4 == 1 or (body != text and len(text) % 4) or len(text) - len(body) > 2:
            return None
        try:
            whole = (base64.urlsafe_b64decode if url else base64.b64decode)(body + b"=" * (-len(body) % 4))
        except binascii.Error:
            return None
        if (base64.urlsafe_b64encode if url else base64.b64encode)(whole).rstrip(b"=") != body:
            return None  # bits besides those of the bytes
        low = np.arange(len(whole)) // 3 * 4
        return whole, low, np.minimum(low + 4, len(text))
    if kind == "json_string":
        try:
            whole = json.loads(text.decode()).encode()
        except ValueError:
            return None
        parts, shift = _ESCAPE.finditer(text, 1, len(text) - 1), lambda x: json.loads(f'"{x.decode()}"').encode()
        start, end = 1, len(text) - 1
    else:
        parts, shift = (_PERCENT_PLUS if kind == "url_form" else _PERCENT).finditer(text), lambda x: b" " if x == b"+" else bytes([int(x[1:], 16)])
        start, end, whole = 0, len(text), None
    out, low, high, at = [], [], [], start
    for m in parts:
        new = shift(m[0])
        out += [text[at : m.start()], new]
        low += [np.arange(at, m.start()), np.full(len(new), m.start())]
        high += [np.arange(at, m.start()) + 1, np.full(len(new), m.end())]
        at = m.end()
    if not out:
        return None
    joined = b"".join([*out, text[at:end]])
    if whole is not None and joined != whole:
        return None
    return joined, np.concatenate([*low, np.arange(at, end)]), np.concatenate([*high, np.arange(at, end) + 1])


@dataclass
class Inspection:
    """One file: what was found, and the work that it took."""

    data: bytes
    values: Mapping[str, bytes]
    max_depth: int
    candidates: int = 0
    decoded_bytes: int = 0
    work_bytes: int = 0
    depth: int = 0
    found: list[tuple] = field(default_factory=list)

    def run(self) -> Inspection:
        if self.values and len(self.data) >= (least := min(map(len, self.values.values()))):
            self.lines = Lines(self.data)
            self._visit(self.data, [], least)
        return self

    def _visit(self, data: bytes, frames: list[tuple[str, int, np.ndarray, np.ndarray]], least: int) -> None:
        for kind in KINDS:
            self.work_bytes += len(data)
            for a, b in candidates(kind, data, least):
                self.candidates += 1
                self.work_bytes += b - a
                got = decoded(kind, data[a:b])
                if got is None:
                    continue
                self.decoded_bytes += len(got[0])
                if len(got[0]) < least:
                    continue
                if len(frames) >= self.max_depth:
                    raise LimitExceeded("max_decode_depth")
                chain = [*frames, (kind, a, got[1], got[2])]
                self.depth = max(self.depth, len(chain))
                for name, low, high in places(got[0], self.values):
                    value = got[0][low:high]
                    for _, at, starts, ends in reversed(chain):
                        low, high = at + int(starts[low]), at + int(ends[high - 1])
                    if self.data[low:high] != value:
                        label = " > ".join(k for k, *_ in chain)
                        self.found.append((name, hashlib.sha256(value).hexdigest(), label, low, high, *self.lines.span(low, high)))
                self._visit(got[0], chain, least)


FOUND = "name string, grouping_key string, chain string, start long, end long, line long, start_column long, end_line long, end_column long"


def inspected(docs: DataFrame, values: Mapping[str, bytes], limits: Limits = Limits(), content: str = "content", key: str = "file_id") -> DataFrame:  # noqa: B008
    """A row for each of docs: key, candidates, decoded_bytes, work_bytes, depth, found (array of FOUND). Deeper text than the limit is an error."""
    known, fields = dict(values), [x.split() for x in FOUND.split(", ")]
    kind = pa.list_(pa.struct([(n, pa.string() if t == "string" else pa.int64()) for n, t in fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [Inspection(x.as_py() or b"", known, limits.max_decode_depth).run() for x in batch.column(1)]
            counts = [pa.array([getattr(d, n) for d in done], pa.int64()) for n in ("candidates", "decoded_bytes", "work_bytes", "depth")]
            found = pa.array([[dict(zip((n for n, _ in fields), x, strict=True)) for x in d.found] for d in done], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, found], names=[key, "candidates", "decoded_bytes", "work_bytes", "depth", "found"])

    row = f"array<struct<{FOUND.replace(' string', ':string').replace(' long', ':bigint')}>>"
    return docs.select(key, F.col(content).cast("binary")).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, candidates long, decoded_bytes long, work_bytes long, depth long, found {row}")


def coverage(out: DataFrame, limits: Limits = Limits()) -> dict[str, int]:  # noqa: B008
    """The sums over all files; more than a limit raises."""
    own = out.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("candidates", "decoded_bytes", "work_bytes")), F.coalesce(F.max("depth"), F.lit(0)).alias("depth")).first().asDict()
    names = {"max_decode_candidates": "candidates", "max_decoded_bytes": "decoded_bytes", "max_decode_work_bytes": "work_bytes"}
    if over := [k for k, v in names.items() if own[v] > getattr(limits, k)]:
        raise LimitExceeded(", ".join(over))
    return own
