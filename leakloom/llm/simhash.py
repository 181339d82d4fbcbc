"""SimHash near-dedup by Golay-code fuzzy hashing.

A fingerprint has 64 bits; two link at `bits` = 4 or fewer differing ones. It is cut into three segments of 22, 21 and 21
bits. Pigeonhole: of four differing bits, two of the three segments hold two at most between them: none and up to two, or one
and one. A segment is read as a word of the perfect [23, 12, 7] Golay code (zeros in front). All words lie within 3 bits of
one codeword. A segment's keys are the 12-bit indices of its own nearest codeword and of those nearest to the 23 words one bit
away: one key, if the word lies within 2 bits of its codeword, else six. Two segments that differ in two bits or fewer
share a key: that of a word between them. So a fingerprint gives, for each of the three pairs of segments, all pairs of
keys (84 mostly), and linked fingerprints share at least one: none is missed.

Equal fingerprints are first reduced to one row. Fingerprints that share a key are compared bit by bit. A bucket of up to
BLOCK fingerprints is compared in one task, and gives the edges of a spanning forest, not all links. A larger one is
cut into blocks, and each pair of blocks is such a task: memory is bounded, no fingerprint is left out, and no task grows
with the bucket. The edges' components are found by star rounds over Spark tables.

Fingerprints: see `fingerprints`. Defined results: a null or empty text has fingerprint zero, and links as any other. A null
doc_id is left out of components (its component_id is null); rows with equal doc_id are each judged by their own fingerprint.
Very long texts are read whole, repeated rows get equal results, and an empty table gives an empty one. Other columns of
the input stay in `kept`, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leakloom.llm import common, components

BITS = 4
WORDS = 4
BLOCK = 2048
SMALL = 32
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
GENERATOR = 0b101011100011


def _remainders(words: np.ndarray) -> np.ndarray:
    words = words.astype(np.int64)
    for shift in range(11, -1, -1):
        words = np.where(words >> (shift + 11) & 1, words ^ (GENERATOR << shift), words)
    return words


def _errors() -> np.ndarray:
    """The error of up to three bits for each of the 2,048 remainders: the code is perfect."""
    out = np.zeros(2048, np.int64)
    one = 1 << np.arange(23)
    words = [0, *one, *(a | b for i, a in enumerate(one) for b in one[:i]), *(a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j])]
    words = np.array(words, np.int64)
    out[_remainders(words)] = words
    return out


_golay: list[np.ndarray] = []


def indices(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    if not _golay:
        _golay.append(_errors())
    return (words ^ _golay[0][_remainders(words)]) >> 11


def segment_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, key): the distinct keys of each."""
    around = np.concatenate([words[:, None], words[:, None] ^ (1 << np.arange(23))[None, :]], axis=1)
    keys = np.sort(indices(around.ravel()).reshape(around.shape), axis=1)
    new = np.ones(keys.shape, bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return np.nonzero(new)[0], keys[new]


def fingerprint_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the fingerprint, key): pair of segments in the top bits, then two keys of 12 bits."""
    prints = prints.view(np.uint64)
    per = [segment_keys((prints >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64)) for at, n in SEGMENTS]
    owners, keys = [], []
    for no, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        (own_i, keys_i), (own_j, keys_j) = per[i], per[j]
        count_j = np.bincount(own_j, minlength=len(prints))
        first_j = np.cumsum(count_j) - count_j
        times = count_j[own_i]
        owner = np.repeat(own_i, times)
        turn = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
        owners.append(owner)
        keys.append((no << 24) | (np.repeat(keys_i, times) << 12) | keys_j[first_j[owner] + turn])
    return np.concatenate(owners), np.concatenate(keys)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    import xxhash

    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    joined = b" ".join(parts)
    ends = np.cumsum([len(x) + 1 for x in parts]).tolist()
    starts = [0, *ends]
    last = min(words, len(parts)) - 1
    hash64 = xxhash.xxh64_intdigest
    hashes = np.fromiter((hash64(joined[starts[i] : ends[i + last] - 1], 42) for i in range(n)), np.uint64, n)
    # counts bit by bit in bytes: 255 shingles at a time cannot overflow
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, column: str = "fp") -> DataFrame:
    """docs with fp (long, the bits of the unsigned fingerprint). A-Z in lower case, words between white space, shingles of
    `words` words (repeats count; a shorter text is one shingle), XXH64 with seed 42; a bit is 1 if over half of them have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                prints = np.array([fingerprint(t.as_py(), words) for t in part.column("text")], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(prints)], names=[*part.schema.names, column])

    common.small_batches(docs.sparkSession)
    return docs.mapInArrow(lambda rows: common.released(run(rows)), StructType(list(docs.schema.fields)).add(column, "long"))


def forest(left: np.ndarray, right: np.ndarray | None, bits: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between two lists of fingerprints, or inside one."""
    both = left if right is None else np.concatenate([left, right])
    todo = [np.arange(len(both))] if right is None else [np.arange(len(left)), np.arange(len(left), len(both))]
    edges: list[tuple[int, int]] = []
    while len(todo[0]):
        stack, todo[0] = [int(todo[0][0])], todo[0][1:]
        while stack:
            x = stack.pop()
            other = 0 if right is None else int(x < len(left))
            near = np.bitwise_count(both[todo[other]] ^ both[x]) <= bits
            if near.any():
                found = todo[other][near].tolist()
                todo[other] = todo[other][~near]
                edges += [(both[x], both[y]) for y in found]
                stack += found
    return edges


def _rows(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(edges, np.uint64).view(np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_pydict({"key": pa.nulls(len(pairs), pa.int64()), "block": pa.nulls(len(pairs), pa.int64()), "a": pa.array(pairs[:, 0].copy()), "b": pa.array(pairs[:, 1].copy())})


EDGES = "key long, block long, a long, b long"


def _runs(batches: Iterator[pa.RecordBatch], size: int, *names: str) -> Iterator[tuple[tuple, np.ndarray, bool]]:
    """Sorted rows as (key, values of the last column, whether the key goes on), `size` rows at most at a time."""
    held: tuple | None = None
    values = np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in names[:-1]], axis=1)
        own = batch.column(names[-1]).to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(own)]])
        for start, stop in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            key = tuple(keys[start].tolist())
            if held is not None and key != held:
                yield held, values, False
                values = values[:0]
            held = key
            values = np.concatenate([values, own[start:stop]]) if len(values) else own[start:stop]
            while len(values) > size:
                yield held, values[:size], True
                values = values[size:]
    if held is not None:
        yield held, values, False


def links(prints: DataFrame, bits: int = BITS, size: int = BLOCK) -> DataFrame:
    """(a, b): edges that connect the distinct fingerprints fp just as all links of up to `bits` differing bits do."""
    if not 0 <= bits <= BITS:
        raise ValueError(f"bits must be from 0 to {BITS}: for more the keys would miss links")
    common.small_batches(prints.sparkSession)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                own = batch.column("fp").slice(at, 4096).to_numpy(zero_copy_only=False)
                owner, key = fingerprint_keys(own)
                yield pa.RecordBatch.from_pydict({"key": pa.array(key), "fp": pa.array(own[owner])})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = values = np.zeros(0, np.int64)
        large, block = None, 0

        def blocks(key: int, own: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal large, block
            large, block = key, block if large == key else 0
            for at in range(0, len(own), size):
                n = len(own[at : at + size])
                yield pa.RecordBatch.from_pydict({"key": pa.array([key] * n, pa.int64()), "block": pa.array([block] * n, pa.int64()), "a": pa.array(own[at : at + size]), "b": pa.nulls(n, pa.int64())})
                block += 1

        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                keys = np.concatenate([keys, batch.column("key").to_numpy(zero_copy_only=False)])
                values = np.concatenate([values, batch.column("fp").to_numpy(zero_copy_only=False)])
            if not len(keys):
                continue
            at = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            whole = at[-1] if batch is None else at[-2]  # the last bucket may go on
            sizes = np.diff(at if batch is None else at[:-1])
            # small buckets: first whether they have a link at all, by comparing rows k apart
            hit = np.zeros(len(sizes), bool)
            no = np.repeat(np.arange(len(sizes)), sizes)
            for k in range(1, min(SMALL, int(sizes.max(initial=0)))):
                same = np.flatnonzero(no[k:] == no[:-k])
                near = np.bitwise_count((values[same] ^ values[same + k]).view(np.uint64)) <= bits
                hit[no[same[near]]] = True
            hit |= sizes > SMALL
            if large is not None and len(sizes) and keys[0] == large:
                hit[0] = True
            found = []
            for i in np.flatnonzero(hit).tolist():
                own, key = values[at[i] : at[i + 1]], int(keys[at[i]])
                if key == large or len(own) > size:
                    yield from blocks(key, own)
                else:
                    found += forest(own.view(np.uint64), None, bits)
            if found:
                yield _rows(found)
            keys, values = keys[whole:], values[whole:]
            if len(keys) > size:
                full = len(keys) // size * size
                yield from blocks(int(keys[0]), values[:full])
                keys, values = keys[full:], values[full:]

    def compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        last = None
        for (key, i, j, own), values, _ in _runs(batches, size, "key", "i", "j", "block", "fp"):
            if (key, i, j) != last:
                held, last = {}, (key, i, j)
            held[own] = values.view(np.uint64)
            if i == j or len(held) == 2:
                yield _rows(forest(held[i], None if i == j else held[j], bits))

    rows = prints.select("fp").mapInArrow(keys, "key long, fp long")
    rows = rows.repartition("key").sortWithinPartitions("key", "fp")
    found = common.written(rows.mapInArrow(compare, EDGES))
    large = found.where("key is not null").select("key", "block", F.col("a").alias("fp"))
    blocks = large.groupBy("key").agg(F.max("block").alias("last"))
    # each block goes to as many tasks as its bucket has blocks; a task holds two
    spread = large.join(blocks, "key").withColumn("other", F.explode(F.expr("sequence(0L, last)")))
    spread = spread.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp")
    spread = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "block", "fp")
    return found.where("key is null").select("a", "b").union(spread.mapInArrow(compare_blocks, EDGES).select("a", "b")).distinct()


def owners(rows: DataFrame, bits: int = BITS, column: str = "fp") -> DataFrame:
    """_fp, root and component_id (the least doc_id that can be reached by links) for each fingerprint of rows (doc_id, fp)."""
    prints = common.written(rows.groupBy(F.col(column).alias("fp")).agg(F.min("doc_id").alias("least")))
    roots = components.least_reachable(links(prints, bits))
    whole = prints.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    least = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    return whole.join(least, "root").select(F.col("fp").alias("_fp"), F.col("root").alias("_root"), F.col("component_id").alias("_component"))


def linked(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """A row for each of docs: doc_id, fingerprint (16 hexadecimal digits) and component_id (the least doc_id that can be reached by links)."""
    ids = common.written(fingerprints(docs.select("doc_id", "text"), words).select("doc_id", "fp"))
    own = owners(ids, bits)
    return ids.join(own, F.col("fp") == F.col("_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("_component")).alias("component_id"))


def kept(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """One row of docs for each component: one of the least doc_id in it, of several such the one of the lowest text hash,
    then the first by all columns. Rows with a null doc_id stay."""
    name = "_fp"
    while name in docs.columns:
        name += "_"
    rows = common.written(fingerprints(docs.where("doc_id is not null"), words, name))
    own = owners(rows.select("doc_id", name), bits, name).toDF("_fp0", "_root", "_component")
    first = rows.join(own, [F.col(name) == F.col("_fp0"), F.col("doc_id") == F.col("_component")])
    order = F.struct(F.xxhash64("text"), F.xxhash64(*docs.columns))
    one = first.groupBy("_root").agg(F.min_by(F.struct(*(rows[c] for c in docs.columns)), order).alias("_row")).select("_row.*")
    return one.toDF(*docs.columns).union(docs.where("doc_id is null"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(common.table(spark, sf_dir, "documents"))
