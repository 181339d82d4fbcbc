"""What the operators of this subpackage share: tables, the shared folder, Arrow batches cut by bytes, word offsets."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a Python worker handles at once; a longer text is handled alone.
SLICE_BYTES = 1 << 19

#: Bytes of an Arrow batch on its way to a Python worker; a single row may be larger.
BATCH_BYTES = 4 << 20

#: The bytes that the contracts call white space: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines see: spark.checkpoint.dir. Only where that is unset, as in tests, a local one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        folder = tempfile.mkdtemp(prefix="leakloom-")
        sc.setCheckpointDir(folder)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, codec: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and outlives executors. codec: its compression, the session's where it is None."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/leakloom-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """For small tables inside loops: Spark removes these files when nothing refers to them any more."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def apart(df: DataFrame, results: tuple[str, ...], inner: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """df with columns renamed that are called like results or like what an operator uses within, and the names under which
    they come out: an input column called like a result as `<name>_in`, any other as before."""
    taken, kept, out, names = {x.lower() for x in df.columns}, {x.lower() for x in (*results, *inner)}, [], []
    for name in df.columns:
        new = name
        if name.lower() in kept:
            while new.lower() in taken | kept:
                new += "_in"
            taken.add(new.lower())
        out.append(new)
        names.append(new if name.lower() in {x.lower() for x in results} else name)
    return df.toDF(*out), names


#: Elements of an array that SQL functions fold at once: a fold that grows an array is quadratic in these alone.
FOLD = 128


def bound(value: str, name: str, use: str) -> str:
    """SQL: `use`, in which `name` is the value, computed once however often it is used."""
    return f"element_at(transform(array({value}), {name} -> {use}), 1)"


def parts_of(array: str) -> str:
    """SQL: the array cut into pieces of FOLD elements."""
    return f"transform(CASE WHEN size({array}) > 0 THEN sequence(0, int((size({array}) - 1) / {FOLD})) ELSE CAST(array() AS ARRAY<INT>) END, part_no -> slice({array}, part_no * {FOLD} + 1, {FOLD}))"


def sums_before(numbers: str) -> str:
    """SQL: for each number of an array of ints the sum of those before it; nearly linear in the array's size."""

    def fold(part: str, start: str) -> str:
        return f"aggregate({part}, struct({start} AS at, CAST(array() AS ARRAY<INT>) AS out), (done, x) -> struct(done.at + x AS at, concat(done.out, array(done.at)) AS out), done -> done.out)"

    starts = fold("transform(parts, part -> aggregate(part, 0, (n, x) -> n + x))", "0")
    whole = f"flatten(zip_with(parts, {starts}, (part, start) -> {fold('part', 'start')}))"
    return bound(numbers, "numbers", bound(parts_of("numbers"), "parts", whole))


def span_index(spans: str) -> str:
    """SQL: of an array of structs with start and end, sorted by start: for `meets`."""
    return bound(spans, "spans", f"transform({parts_of('spans')}, part -> struct(part[0].start AS start, array_max(transform(part, s -> s.end)) AS end, part AS spans))")


def meets(index: str, start: str, end: str) -> str:
    """SQL: whether a span of the index has a place in [start, end)."""
    return f"exists({index}, b -> b.start < {end} AND {start} < b.end AND exists(b.spans, s -> s.start < {end} AND {start} < s.end))"


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches between the JVM and Python workers, which both sides hold several times over. A bound that the session has set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "67108864"):  # Spark's default
        spark.conf.set(key, str(BATCH_BYTES))


def released(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows; at their end the worker gives memory that it no longer uses back, since it lives on for other tasks."""
    try:
        yield from rows
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most so many bytes of a text column, or of one row. Whole rows, in order."""
    n = batch.num_rows
    if n == 0:
        return
    offsets = text_buffer(batch.column(column))[1]
    start = 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        stop = min(n, max(stop, start + 1))
        yield batch.slice(start, stop - start)
        start = stop


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, one text after another, and n + 1 offsets from 0. Null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, none across texts, and for each text its first word's number (n + 1)."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    here = np.zeros(n + 1, bool)
    here[:n] = inside
    starts = np.flatnonzero(here & (~before | edge))
    ends = np.flatnonzero(before & (~here | edge))
    return starts, ends, np.searchsorted(starts, offsets)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the rolling hash's base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        kept = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, _INVERSE)]
        if size > 4 * SLICE_BYTES:  # one very long text: not kept for the rest of the worker's life
            return kept[0][:n], kept[1][:n]
        _powers[:] = kept
    return _powers[0][:n], _powers[1][:n]


class Rolling:
    """Hashes of any byte ranges of a buffer from one pass over it: equal ranges have equal hashes."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def grams(self, n: int) -> np.ndarray:
        """Of every n bytes in a row."""
        last = len(self.sums) - n
        return mixed((self.sums[n:] - self.sums[:last]) * self.down[:last]) if last > 0 else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of flags between the offsets."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.float64 if flags.dtype.kind == "f" else np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]
