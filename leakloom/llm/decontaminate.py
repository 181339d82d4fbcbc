"""Benchmark decontamination by a distributed positional inverted index.

`build_index` makes one row for each segment: some whole documents of about SEGMENT_WORDS words (a longer document is a
segment of its own). A row holds postings of every word: sorted 64-bit term hashes, where each one's list begins, and its
positions in the segment. It knows nothing of any benchmark and can be written once and searched often; every segment is
complete in itself, so building needs no shuffle and a lost executor costs only its own segments.

`search` takes windows of `window` words from the benchmark. In each segment, the rarest term of a window gives
candidate starts (its positions less its offset), and the offset-adjusted lists of the other terms, by rising length, are
intersected with them. What is left are exact phrase matches. With `near`, further columns count items that have a window (those
that begin at multiples of `window`) whose words all lie, in any order, within `near` words around a place of its rarest.

The index is written to the shared folder. Benchmark windows go to the executors in blocks of at most WINDOWS_AT_ONCE, a
bound on what is broadcast; each block is another pass over the index. A benchmark of any size is so searched in full.

Words: A-Z in lower case, then maximal runs of ASCII letters and digits and of any characters beyond ASCII. Defined results:
null and empty texts have no words and no hits; an item without words is in no document; an item of fewer words than
`window` is one window; equal windows of different items count for each. An item whose id is null is left out. Rows with
equal doc_id are each judged by themselves. Very long texts are searched whole, and an empty table gives an empty one; doc_id and
item_id must be integers, or text that can be cast to them. Terms are told apart by 64-bit hashes, and a match needs all of a window's in order.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakloom.llm import common

WINDOW = 10
SEGMENT_WORDS = 400_000
WINDOWS_AT_ONCE = 200_000
#: Words around a place of its rarest word within which op8 looks for all of an item's.
NEAR = 20

INSIDE = np.zeros(256, bool)
INSIDE[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
INSIDE[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

INDEX = "doc_ids array<bigint>, words_at binary, terms binary, first binary, positions binary"


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of each text's first (n + 1)."""
    data, offsets = common.text_buffer(column)
    data = LOWER[data]
    starts, ends, words_at = common.word_bounds(INSIDE[data], offsets)
    return common.Rolling(data).of(starts, ends), words_at


def postings(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted terms, where the list of each begins (n + 1), positions."""
    order = np.argsort(words, kind="stable").astype(np.int32)
    sorted_words = words[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_words[1:] != sorted_words[:-1]])) if len(words) else np.zeros(0, np.int64)
    return sorted_words[first], np.append(first, len(words)).astype(np.int32), order


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each segment: doc_ids (array of long), words_at (int32: each document's first word, and the end), terms
    (uint64), first (int32), positions (int32), segment (a number of its own)."""

    def segment(ids: list[pa.Array], words: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        terms, first, positions = postings(np.concatenate(words))
        at = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
        values = pa.concat_arrays(ids)
        own = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        more = [pa.array([x.tobytes()], pa.binary()) for x in (at, terms, first, positions)]
        return pa.RecordBatch.from_arrays([own, *more], names=["doc_ids", "words_at", "terms", "first", "positions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, counts, n = [], [], [], 0
        for batch in batches:
            for part in common.slices(batch, text_column, 1 << 20):
                own, at = terms_of(part.column(text_column))
                if n and n + len(own) > SEGMENT_WORDS:
                    yield segment(ids, words, counts)
                    ids, words, counts, n = [], [], [], 0
                ids.append(part.column(id_column).cast(pa.int64()))
                words.append(own), counts.append(np.diff(at))
                n += len(own)
        if ids:
            yield segment(ids, words, counts)

    common.small_batches(docs.sparkSession)
    return docs.select(id_column, text_column).mapInArrow(lambda rows: common.released(run(rows)), INDEX).withColumn("segment", F.monotonically_increasing_id())


class Windows:
    """A block of benchmark windows by their words, equal windows once."""

    def __init__(self, rows: list[tuple[int, list[int]]], near: int | None):
        self.near = near
        by_words: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for item, words in rows:
            by_words[tuple(words)].append(item)
        self.items = [sorted(set(x)) for x in by_words.values()]
        self.sizes = np.array([len(w) for w in by_words], np.int64)
        longest = int(self.sizes.max(initial=1))
        self.words = np.zeros((len(by_words), longest), np.uint64)
        for i, w in enumerate(by_words):
            self.words[i, : len(w)] = w
        self.used = np.arange(longest)[None, :] < self.sizes[:, None]
        self.terms, inverse = np.unique(self.words, return_inverse=True)
        self.slot = inverse.reshape(self.words.shape)

    def lists(self, terms: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and length of each window term's list in a segment, and the windows all of whose terms occur."""
        at = np.searchsorted(terms, self.terms)
        there = at < len(terms)
        there[there] = terms[at[there]] == self.terms[there]
        at[~there] = 0
        begin = np.where(there, first[at], 0)
        length = np.where(there, first[at + 1] - first[at], 0) if len(terms) else np.zeros(len(self.terms), np.int64)
        lengths = np.where(self.used, length.astype(np.int64)[self.slot], np.int64(np.iinfo(np.int64).max))
        return begin[self.slot], lengths, np.flatnonzero(lengths.min(axis=1) > 0)


def exact(block: Windows, words_at: np.ndarray, terms: np.ndarray, first: np.ndarray, positions: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(window, starts in the segment) of the windows that occur."""
    begin, lengths, live = block.lists(terms, first)
    ends = np.repeat(words_at[1:], np.diff(words_at))  # where each word's document ends
    order = np.argsort(lengths[live], axis=1, kind="stable")
    # term numbers by position: membership in a term's list is then one look-up
    by_position = np.empty(len(positions), np.int32)
    by_position[positions] = np.repeat(np.arange(len(terms), dtype=np.int32), np.diff(first))
    number = np.searchsorted(terms, block.words)
    chunk = 4096
    for at in range(0, len(live), chunk):
        own, by = live[at : at + chunk], order[at : at + chunk]
        rare = by[:, 0]
        count = lengths[own, rare]
        owner = np.repeat(np.arange(len(own)), count)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[own, rare], count)
        start = positions[place].astype(np.int64) - rare[owner]
        size = block.sizes[own]
        keep = start >= 0
        owner, start = owner[keep], start[keep]
        keep = start + size[owner] <= ends[start] if len(start) else np.zeros(0, bool)
        owner, start = owner[keep], start[keep]
        for k in range(1, by.shape[1]):
            if not len(start):
                break
            offset = by[owner, k]
            on = k < size[owner]
            same = by_position[np.where(on, start + offset, 0)] == number[own[owner], offset]
            keep = same | ~on
            owner, start = owner[keep], start[keep]
        for i in np.unique(owner).tolist():
            yield int(own[i]), start[owner == i]


def near_items(block: Windows, words_at: np.ndarray, terms: np.ndarray, first: np.ndarray, positions: np.ndarray) -> Iterator[tuple[int, int]]:
    """(window, document) where all words of the window lie within `near` words around a place of its rarest, inside one document."""
    begin, lengths, live = block.lists(terms, first)
    for i in live.tolist():
        by = [k for k in np.argsort(lengths[i], kind="stable").tolist() if block.used[i, k]]
        lists = [np.sort(positions[begin[i, k] : begin[i, k] + lengths[i, k]]) for k in by]
        at = lists[0].astype(np.int64)
        doc = np.searchsorted(words_at, at, "right") - 1
        low, high = np.maximum(at - block.near, words_at[doc]), np.minimum(at + block.near, words_at[doc + 1] - 1)
        for other in lists[1:]:
            there = np.searchsorted(other, low) < np.searchsorted(other, high, "right")
            low, high, doc = low[there], high[there], doc[there]
            if not len(low):
                break
        for d in np.unique(doc).tolist():
            yield i, d


HITS = "segment long, row int, doc_id long, n_words long, spans binary, items array<bigint>, near_items array<bigint>"


def search_block(index: DataFrame, block: Windows) -> DataFrame:
    """A row for each document: segment and row in it, doc_id, n_words, spans (int32 pairs), items, near_items."""
    shared = index.sparkSession.sparkContext.broadcast(block)

    def one(batch: pa.RecordBatch, row: int) -> pa.RecordBatch:
        block = shared.value
        ids = batch.column("doc_ids")[row].values
        at, terms, first, positions = (np.frombuffer(batch.column(k)[row].as_py(), kind) for k, kind in (("words_at", np.int32), ("terms", np.uint64), ("first", np.int32), ("positions", np.int32)))
        spans, items, near = defaultdict(list), defaultdict(set), defaultdict(set)
        if len(terms) and len(block.sizes):
            for w, starts in exact(block, at, terms, first, positions):
                for doc, start in zip((np.searchsorted(at, starts, "right") - 1).tolist(), starts.tolist(), strict=True):
                    spans[doc].append((start - int(at[doc]), start - int(at[doc]) + int(block.sizes[w]) - 1))
                    items[doc].update(block.items[w])
            if block.near is not None:
                for w, doc in near_items(block, at, terms, first, positions):
                    near[doc].update(block.items[w])
        n = len(ids)
        columns = {
            "segment": pa.array([batch.column("segment")[row].as_py()] * n, pa.int64()),
            "row": pa.array(range(n), pa.int32()),
            "doc_id": ids,
            "n_words": pa.array(np.diff(at).astype(np.int64)),
            "spans": pa.array([merged(spans[d]).tobytes() if d in spans else b"" for d in range(n)], pa.binary()),
            "items": pa.array([sorted(items[d]) if d in items else [] for d in range(n)], pa.list_(pa.int64())),
            "near_items": pa.array([sorted(near[d]) if d in near else [] for d in range(n)], pa.list_(pa.int64())),
        }
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield one(batch, row)

    return index.mapInArrow(lambda rows: common.released(run(rows)), HITS)


def merged(spans: list[tuple[int, int]]) -> np.ndarray:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return np.array(out, np.int32).reshape(-1, 2)


def blocks_of(benchmark: DataFrame, window: int, near: int | None, at_once: int) -> Iterator[Windows]:
    """The benchmark's windows in blocks; the driver holds one item and one block at a time."""
    rows: list[tuple[int, list[int]]] = []
    for item in benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").toLocalIterator():
        words = terms_of(pa.array([item.text]))[0].tolist()
        for at in range(max(1, len(words) - window + 1) if words else 0):
            rows.append((item.item_id, words[at : at + window]))
            if len(rows) == at_once:
                yield Windows(rows, near)
                rows = []
    if rows:
        yield Windows(rows, near)


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: int | None = None, at_once: int = WINDOWS_AT_ONCE) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, spans (array of first and last word of each hit stretch), n_hit, items
    (of the benchmark, with an exact match), near_items (with a match in any order; empty unless `near` is given)."""
    blocks = blocks_of(benchmark, window, near, at_once)
    first = next(blocks, None) or Windows([], near)
    more = next(blocks, None)
    index = common.written(build_index(docs))
    if more is None:
        got = search_block(index, first)
    else:
        parts = [common.written(search_block(index, block)) for block in itertools.chain([first, more], blocks)]
        got = parts[0]
        for part in parts[1:]:
            got = got.union(part)
        lists = (F.array_sort(F.array_distinct(F.flatten(F.collect_list(k)))).alias(k) for k in ("items", "near_items"))
        got = got.groupBy("segment", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_join(F.collect_list(F.hex("spans")), "").alias("spans"), *lists)
        got = got.withColumn("spans", F.unhex("spans"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merged(np.frombuffer(x or b"", np.int32).reshape(-1, 2).tolist()) for x in batch.column("spans").to_pylist()]
            columns = {k: batch.column(k) for k in ("doc_id", "n_words")}
            columns["spans"] = pa.array([x.tolist() for x in spans], pa.list_(pa.list_(pa.int32())))
            columns["n_hit"] = pa.array([int((x[:, 1] - x[:, 0] + 1).sum()) for x in spans], pa.int64())
            yield pa.RecordBatch.from_pydict(columns | {k: batch.column(k) for k in ("items", "near_items")})

    return got.mapInArrow(read, "doc_id long, n_words long, spans array<array<int>>, n_hit long, items array<bigint>, near_items array<bigint>")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any exact match, each judged by its text alone, whatever its doc_id."""
    key = F.xxhash64("text")
    hit = search(docs.where("text is not null").select(key.alias("doc_id"), "text"), benchmark, window).where("n_hit > 0").select(F.col("doc_id").alias("_key")).distinct()
    return docs.join(hit, key == F.col("_key"), "left_anti").select(*docs.columns)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With n_near_items: items all of whose words of a window stand, in any order, within NEAR words of its rarest."""
    found = search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), near=NEAR)
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near_items"))
