"""Comment directives that suppress a line or the next one, in languages with C-like comments.

Lexical state (open quotes, nested block comments) goes from line to line, so a file is read in order, in a Python worker; only files that
hold a directive at all are sent there, all others have no suppressed lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
LANGUAGES = "js mjs cjs ts jsx tsx rs java go cs c cpp h hpp php kt swift"
IGNORE, IGNORE_NEXT = "leakloom-ignore", "leakloom-ignore-next"

#: What may begin outside of quotes and comments, in order of precedence: a block comment, a line comment, a raw string, a quote.
_OPEN = re.compile(r"(?P<block>/\*)|(?P<line>//)|(?P<raw>r(?P<hashes>#*)\")|(?P<quote>[\"'`])")
_BLOCK = re.compile(r"/\*|\*/")
_LIFETIME = re.compile(r"[A-Za-z0-9_]+(?!['A-Za-z0-9_])")
_CLOSE = {q: re.compile(rf"(?:[^{q}\\]|\\.)*?{q}", re.S) for q in "\"'`"}


class Reader:
    """Reads the lines of one file; `suppressed` says of each whether findings on it are dropped."""

    def __init__(self, path: str, ignore: str = IGNORE, ignore_next: str = IGNORE_NEXT):
        name = path.rpartition("/")[2]
        extension = name.rpartition(".")[2] if "." in name.lstrip(".") else ""
        self.reads, self.rust = extension in LANGUAGES.split(), extension == "rs"
        self.ignore, self.ignore_next = ignore, ignore_next
        self.next, self.depth, self.close = False, 0, None

    def suppressed(self, line: str) -> bool:
        held, self.next = self.next, False
        at = 0
        while self.reads and at < len(line):
            if self.close is not None:
                end = self.close.match(line, at)
                if end is None:
                    return held
                self.close, at = None, end.end()
            elif self.depth:
                mark = _BLOCK.search(line, at)
                if mark is None:
                    return held
                self.depth += 1 if mark[0] == "/*" else -1
                at = mark.end()
            else:
                mark = _OPEN.search(line, at)
                while mark and mark["raw"] and not self.rust:  # not a raw string: its quote opens
                    mark = _OPEN.search(line, mark.end() - 1)
                if mark is None:
                    return held
                at = mark.end()
                if mark["block"]:
                    self.depth = 1
                elif mark["line"]:
                    word = (line[at:].split() or [""])[0].lower()
                    self.next = word == self.ignore_next
                    return held or self.next or word == self.ignore
                elif mark["raw"]:
                    self.close = re.compile(f'.*?"{mark["hashes"]}', re.S)
                elif not (self.rust and mark["quote"] == "'" and _LIFETIME.match(line, at)):
                    self.close = _CLOSE[mark["quote"]]
        return held


def suppressed_lines(docs: DataFrame, ignore: str = IGNORE, ignore_next: str = IGNORE_NEXT) -> DataFrame:
    """file_id, line of the suppressed lines of docs (file_id, path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lines = [], []
            for key, path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = Reader(path, ignore, ignore_next)
                found = [i for i, line in enumerate(content.split("\n"), 1) if own.suppressed(line.removesuffix("\r"))]
                ids += [key] * len(found)
                lines += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(lines, pa.int32())], names=["file_id", "line"])

    some = docs.where(F.contains(F.lower("content"), F.lit(ignore.lower()))).select("file_id", "path", "content")
    return some.mapInArrow(run, f"file_id {docs.schema['file_id'].dataType.simpleString()}, line int")
