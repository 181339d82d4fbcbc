"""Declared private values: every place where one stands in bytes, overlapping ones too. Values reach the workers in a closure, never in a plan."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

MOST_NAMES, LEAST_BYTES, MOST_BYTES = 256, 8, 64 << 10
PLACES = "name string, grouping_key string, start long, end long, line long, start_column long, end_line long, end_column long"


def declared(names: list[str], environment: Mapping[str, str], short: frozenset[str] = frozenset()) -> dict[str, bytes]:
    """The values of some names. A bad name, a missing, empty, short or long value is an error; names in `short` may have short ones."""
    if len(names) > MOST_NAMES or len(set(names)) != len(names):
        raise ValueError("too many names, or one twice")
    out = {}
    for name in names:
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
            raise ValueError(f"bad name {name!r}")
        value = environment.get(name, "").encode()
        if not value or len(value) > MOST_BYTES or (len(value) < LEAST_BYTES and name not in short):
            raise ValueError(f"the value of {name} is missing, empty, too short or too long")
        out[name] = value
    return out


def places(data: bytes, values: Mapping[str, bytes]) -> list[tuple[str, int, int]]:
    """(name, start, end) of all matches, overlapping ones too, by end, then start."""
    out = []
    for name, value in values.items():
        at = data.find(value)
        while at >= 0:
            out.append((name, at, at + len(value)))
            at = data.find(value, at + 1)
    return sorted(out, key=lambda x: (x[2], x[1], x[0]))


class Lines:
    """Places of bytes as lines and columns."""

    def __init__(self, data: bytes):
        self.ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)

    def at(self, offset: int) -> tuple[int, int]:
        """Line and column, both from 1, of the byte at an offset."""
        n = int(self.ends.searchsorted(offset))
        return n + 1, offset - (int(self.ends[n - 1]) if n else -1)

    def span(self, start: int, end: int) -> tuple[int, int, int, int]:
        """Start line and column, end line and column of bytes: the end column counts the bytes of the last line, 0 after a line end."""
        line, column = self.at(end)
        return (*self.at(start), line, column - 1)


def found(docs: DataFrame, values: Mapping[str, bytes], content: str = "content", key: str = "file_id") -> DataFrame:
    """key and PLACES for each match of a value in the bytes of content (text or binary)."""
    known = dict(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if (data := data.as_py()) is None:
                    continue
                lines = None
                for name, a, b in places(data, known):
                    lines = lines or Lines(data)
                    rows.append((own, name, hashlib.sha256(data[a:b]).hexdigest(), a, b, *lines.span(a, b)))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    kind = docs.select(key).schema[0].dataType
    schema = pa.schema([(key, to_arrow_type(kind)), *((n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in PLACES.split(", ")))])
    return docs.select(key, F.col(content).cast("binary")).mapInArrow(run, f"{key} {kind.simpleString()}, {PLACES}")


def contains(spark: SparkSession, values: list[str]) -> Callable[[Column], Column]:
    """Whether a text holds one of the values."""
    known = list(values)

    @F.pandas_udf("boolean")
    def test(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: x is not None and any(v in x for v in known))

    return test
