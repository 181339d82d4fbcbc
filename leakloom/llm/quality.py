"""Quality rules: fixed counts, and a logistic regression over hashed n-grams learnt from labelled rows.

Features are word 1-grams, word 2-grams and character 3-grams and 5-grams of the whole text, hashed into BINS bins, as shares of
their family. The regression is fitted in one task on at most `train_rows` labelled rows, and its logit is mapped to a
probability by Platt scaling on rows that the fit did not see. Scoring runs in Arrow batches; each text's score depends on
that text and the model alone. Repeated windows are told apart by 64-bit hashes.

Defined results: a null or empty text has no words, fails the base rules and is not kept. Null labels are passed over; a
doc_id labelled twice counts with its lowest label. Without labels of both classes the base rules alone decide. Repeated
rows are scored each; very long texts are scored whole, ties at the threshold are kept, an empty table gives an empty one; other columns of the input pass through `score` untouched, one that is named like a result as `<name>_in`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leakloom.llm import common

BINS = 1 << 16
TRAIN_ROWS = 4_000
#: A document goes if the chance that it is good is below this.
LEAST_GOOD = 0.5
MIN_WORDS = 50
MOST_REPEATED = 0.5
#: Words 1 and 2 in a row, characters 3 and 5 in a row: each family's shares sum to this.
WEIGHT = 8.0
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Pieces:
    """What rules and model need of some texts."""

    def __init__(self, column: pa.Array):
        data, self.offsets = common.text_buffer(column)
        inside = ~common.SPACE[data]
        self.data, self.inside = data, inside
        self.starts, ends, self.words_at = common.word_bounds(inside, self.offsets)
        self.rolling = common.Rolling(data)
        self.words = self.rolling.of(self.starts, ends)

    def in_a_row(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n words in a row, and for each whether it lies in one text."""
        w = self.words
        if len(w) < n:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        h = w[: len(w) - n + 1].copy()
        for k in range(1, n):
            h = common.mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k])
        whole = np.ones(len(h), bool)
        for at in self.words_at[1:-1]:
            whole[max(0, at - n + 1) : at] = False
        return h, whole

    def families(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each family: bins of the features, whether each lies in one text, and the first feature of each text."""
        shift = np.uint64(64 - BINS.bit_length() + 1)
        yield (self.words >> shift).astype(np.int32), np.ones(len(self.words), bool), self.words_at
        h, whole = self.in_a_row(2)
        yield (h >> shift).astype(np.int32), whole, np.minimum(self.words_at, len(h))
        points = np.append(np.flatnonzero((self.data & 0xC0) != 0x80), len(self.data))
        chars_at = np.searchsorted(points, self.offsets)
        for n in (3, 5):
            h = self.rolling.of(points[:-n], points[n:]) if len(points) > n else np.zeros(0, np.uint64)
            whole = np.ones(len(h), bool)
            for at in chars_at[1:-1]:
                whole[max(0, at - n + 1) : at] = False
            yield (common.mixed(h + np.uint64(n)) >> shift).astype(np.int32), whole, np.minimum(chars_at, len(h))

    def stats(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        points = self.inside & ((self.data & 0xC0) != 0x80)
        out = {"n_words": np.diff(self.words_at), "word_chars": common.per_text(points, self.offsets), "n_symbols": common.per_text(SYMBOLS[self.data], self.offsets)}
        again = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text and "\n" in text:
                lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
                again[i] = len(lines) - len(set(lines))
        out["n_dup_lines"] = again
        h, whole = self.in_a_row(3)
        marked = np.zeros(len(self.words) + 1, bool)
        at = np.flatnonzero(whole)
        if len(at):
            text_of = np.repeat(np.arange(len(texts)), np.diff(self.words_at))[at]
            keys = common.mixed(h[at] + np.uint64(0x9E3779B97F4A7C15) * text_of.astype(np.uint64))
            order = np.argsort(keys)
            twice = keys[order][1:] == keys[order][:-1]
            for found in (at[order[1:][twice]], at[order[:-1][twice]]):
                for k in range(3):
                    marked[found + k] = True
        out["n_repeat_words"] = common.per_text(marked[:-1], self.words_at)
        return out


def logits(pieces: Pieces, weights: np.ndarray) -> np.ndarray:
    total = np.full(len(pieces.offsets) - 1, float(weights[-1]))
    for bins, whole, at in pieces.families():
        n = np.maximum(1, common.per_text(whole, at))
        total += WEIGHT * common.per_text(np.where(whole, weights[bins], 0.0), at) / n
    return total


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: weights (BINS and a bias) and the scale and shift of the logit; none if a class is missing."""
    rows, cols, vals, y, n = [], [], [], [], 0
    for batch in batches:
        for part in common.slices(batch, "text"):
            pieces = Pieces(part.column("text"))
            y.append(part.column("quality").to_numpy(zero_copy_only=False).astype(np.float64))
            m = part.num_rows
            for bins, whole, at in pieces.families():
                text_of = np.repeat(np.arange(m), np.diff(at))
                bins, whole = bins[: len(text_of)], whole[: len(text_of)]
                keys, counts = np.unique(text_of[whole] * BINS + bins[whole], return_counts=True)
                owner = keys // BINS
                sums = np.bincount(owner, counts, m)
                rows.append((owner + n).astype(np.int32))
                cols.append((keys % BINS).astype(np.int32))
                vals.append((WEIGHT * counts / sums[owner]).astype(np.float32))
            n += m
    y = np.concatenate(y) if y else np.zeros(0)
    if len(set(y.tolist())) < 2:
        return
    chunks = list(zip(rows, cols, vals, strict=True))  # apart, so that what a step needs besides stays small
    held = np.arange(n) % 4 == 3
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held[:] = False
    w = np.zeros(BINS + 1)
    m1, m2 = np.zeros(BINS + 1), np.zeros(BINS + 1)
    use = ~held
    # both classes weigh the same in the fit; the calibration brings the shares back
    weight = np.where(y == 1, 0.5 / max(1, (y[use] == 1).sum()), 0.5 / max(1, (y[use] == 0).sum())) * use
    for step in range(1, 61):
        g = (sigmoid(margins(chunks, w, n)) - y) * weight
        grad = np.append(sum(np.bincount(c, v * g[r], BINS) for r, c, v in chunks), g.sum()) + 1e-7 * w
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        w -= 0.2 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
    z = margins(chunks, w, n)
    a, b = platt(z[held], y[held]) if held.any() else platt(z, y)
    yield pa.RecordBatch.from_pydict({"weights": [w.astype(np.float32).tobytes()], "a": [float(a)], "b": [float(b)]})


def margins(chunks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], w: np.ndarray, n: int) -> np.ndarray:
    return sum(np.bincount(r, v * w[c], n) for r, c, v in chunks) + w[-1]


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift that turn logits into chances; damped Newton steps on softened targets."""
    ones, zeros = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))

    def loss(a: float, b: float) -> float:
        x = a * z + b
        return float((np.logaddexp(0, x) - target * x).sum())

    a, b = 0.0, float(np.log((ones + 1) / (zeros + 1)))
    for _ in range(100):
        p = sigmoid(a * z + b)
        r, s = p - target, p * (1 - p)
        grad = np.array([(r * z).sum(), r.sum()])
        hess = np.array([[(s * z * z).sum(), (s * z).sum()], [(s * z).sum(), s.sum()]]) + 1e-6 * np.eye(2)
        step, t, before = np.linalg.solve(hess, grad), 1.0, loss(a, b)
        while t > 1e-6 and loss(a - t * step[0], b - t * step[1]) > before:
            t /= 2
        a, b = a - t * step[0], b - t * step[1]
        if t <= 1e-6 or np.abs(t * step).max() < 1e-8:
            break
    return a, b


def labelled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """doc_id, text and quality of at most so many labelled documents, those of the lowest hashes; of rows with one doc_id the text of the lowest hash."""
    some = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    some = some.withColumnRenamed("doc_id", "labelled_id")  # at most `rows` rows: a proven bound
    return docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("labelled_id")).groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float, float] | None:
    """Weights, scale and shift. Reads every document, learns from at most train_rows of them, in one task."""
    common.small_batches(docs.sparkSession)
    sample = labelled(docs, labels, train_rows).repartition(1).sortWithinPartitions("doc_id").select("text", "quality")
    got = sample.mapInArrow(lambda rows: common.released(fit(rows)), "weights binary, a double, b double").collect()
    return (np.frombuffer(got[0].weights, np.float32), got[0].a, got[0].b) if got else None


def score(docs: DataFrame, model: tuple[np.ndarray, float, float] | None, least_good: float = LEAST_GOOD) -> DataFrame:
    """docs with the counts of STATS, base_failed, good (the calibrated chance; null without a model) and kept."""

    common.small_batches(docs.sparkSession)
    docs = common.apart(docs, (*STATS, "base_failed", "good", "kept"))[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                pieces = Pieces(part.column("text"))
                stats = pieces.stats(part.column("text").to_pylist())
                failed = (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > 100 * MOST_REPEATED * stats["n_words"])
                good = sigmoid(model[1] * logits(pieces, model[0]) + model[2]) if model else None
                kept = ~failed & (good >= least_good) if model else ~failed
                more = [pa.array(stats[k].astype(np.int64)) for k in STATS]
                more += [pa.array(failed), pa.array(good) if model else pa.nulls(part.num_rows, pa.float64()), pa.array(kept)]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, *STATS, "base_failed", "good", "kept"])

    schema = StructType(list(docs.schema.fields))
    for k in STATS:
        schema = schema.add(k, "long")
    return docs.mapInArrow(lambda rows: common.released(run(rows)), schema.add("base_failed", "boolean").add("good", "double").add("kept", "boolean"))


def rules(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, least_good: float = LEAST_GOOD) -> DataFrame:
    return score(docs, train(docs, labels, train_rows), least_good)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return rules(docs, common.table(spark, sf_dir, "labels")).drop("text")
