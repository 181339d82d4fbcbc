"""Byte-level BPE: encoding by recursive DuckDB queries inside each task, decoding by ordered aggregation.

Each match of the split pattern (a word) is encoded separately. In DuckDB a word is a list of tokens, at first its bytes. One
recursive step unnests the lists into token-position rows, joins neighbours to the merge table, takes the leftmost pair of
the lowest rank of each word and contracts it; words without a pair drop out. A word that is itself a token is taken whole,
as tiktoken does. For a word of over LONG bytes that would be quadratic: its tokens stay rows, and one step contracts the places
of the lowest pair from left to right, as long as none of the pairs that arise is of a lower rank still, which are the same
contractions in the same order. Both forms are exact for any ranks. A recursive query runs LEVELS steps at most and is called
again for the rest, so that what it holds stays in proportion to its words.

Pieces of text that were encoded are kept in arrays of the Python worker (KEPT at most, then all anew), so each task encodes only
what is new to it. A piece is a word; with `spaced` texts are cut at once before white space that follows none, and before punctuation
that follows a letter: for patterns that begin a match at all such places, as the usual one does. Pieces are found by hash and
compared byte by byte.

Decoding joins the ids of documents to the vocabulary, orders the rows by position and aggregates their bytes.

Defined results: a null text is empty; an empty text has no tokens, and decodes to an empty text. Any text goes, however
long, no string is special; repeated rows give repeated results, and of equal ranks the leftmost pair is first. An empty table gives
an empty one. Columns of the input pass through `encoded` and `decoded`, one that is named like a result as `<name>_in`.
"""

from __future__ import annotations

import base64
import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructType

from leakloom.llm import common

LONG = 256
LEVELS = 64
KEPT = 1_000_000
#: Bytes of words that DuckDB encodes at once, tokens that it decodes at once; bytes of text between two calls, and of a window of look-ups.
WORD_BYTES = 200_000
TOKENS = 150_000
TEXT_BYTES = 2 << 20
LOOK_BYTES = 1 << 19

BLANK, LETTER, PUNCTUATION = np.zeros((3, 256), bool)
BLANK[list(b" \n")] = True
LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
PUNCTUATION[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~")] = True

STEPS = """
WITH RECURSIVE steps(wid, toks, done) AS (
    SELECT wid, toks, false FROM words
  UNION ALL
    SELECT s.wid, CASE WHEN b.code IS NULL THEN s.toks ELSE s.toks[: (b.code & 65535) - 1] || [(b.code >> 16)::INTEGER] || s.toks[(b.code & 65535) + 2 :] END, b.code IS NULL
    FROM steps s
    LEFT JOIN (
        SELECT p.wid, min(m.rank * 65536 + p.place) AS code
        FROM (SELECT wid, unnest(toks[:-2]) AS l, unnest(toks[2:]) AS r, generate_subscripts(toks[2:], 1) AS place FROM steps) p
        JOIN merges m ON m.pair = p.l::BIGINT * 4294967296 + p.r
        GROUP BY p.wid
    ) b ON b.wid = s.wid
    WHERE NOT s.done
)
SELECT wid, toks FROM steps WHERE done
"""

LONG_STEPS = """
WITH RECURSIVE steps(step, wid, pos, tok) AS (
    SELECT 0, wid, unnest(generate_series(1, len(toks))), unnest(toks) FROM words
  UNION ALL
    SELECT step + 1, wid, pos, CASE WHEN cut THEN low ELSE tok END
    FROM (
        SELECT *, coalesce(lag(cut) OVER (PARTITION BY wid ORDER BY pos), false) AS gone
        FROM (
            SELECT * REPLACE (cut AND n <= coalesce(min(n) FILTER (cut AND (a.rank < low OR b.rank < low)) OVER (PARTITION BY wid), n) AS cut)
            FROM (
                SELECT *, CASE WHEN cut THEN CASE WHEN lag(cut, 2) OVER w THEN low ELSE lag(tok) OVER w END END AS before, CASE WHEN cut THEN lead(tok, 2) OVER w END AS after
                FROM (
                    SELECT *, hit AND row_number() OVER (PARTITION BY wid, hit, isle ORDER BY pos) % 2 = 1 AS cut
                    FROM (
                        SELECT *, n - row_number() OVER (PARTITION BY wid, hit ORDER BY pos) AS isle
                        FROM (
                            SELECT *, coalesce(rank = low, false) AS hit
                            FROM (
                                SELECT p.*, m.rank, min(m.rank) OVER (PARTITION BY p.wid) AS low
                                FROM (SELECT *, lead(tok) OVER w AS nxt, row_number() OVER w AS n FROM steps WINDOW w AS (PARTITION BY wid ORDER BY pos)) p
                                LEFT JOIN merges m ON m.pair = p.tok::BIGINT * 4294967296 + p.nxt
                            ) WHERE low IS NOT NULL
                        )
                    )
                ) WINDOW w AS (PARTITION BY wid ORDER BY pos)
            ) c
            LEFT JOIN (SELECT pair, rank FROM merges) a ON a.pair = c.before::BIGINT * 4294967296 + c.low
            LEFT JOIN (SELECT pair, rank FROM merges) b ON b.pair = c.low::BIGINT * 4294967296 + c.after
        )
    ) WHERE NOT gone AND step < {levels}
)
SELECT wid, any_value(step) AS step, list(tok ORDER BY pos) AS toks
FROM (SELECT *, max(step) OVER (PARTITION BY wid) AS last FROM steps) WHERE step = last GROUP BY wid
"""

DECODE = "SELECT string_agg(text, '') AS text FROM (SELECT v.text FROM toks t JOIN vocab v USING (tok) ORDER BY t.pos)"

#: Kept in a Python worker between its tasks, by the digest of the rank file and the pattern.
_codecs: dict[str, Codec] = {}

def ranks_of(file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in file.splitlines() if x)}


def lists_of(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.astype(np.int32)))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces begin: texts; spaces and line ends after a character that surely is no white space (printable ASCII, or
    beyond it any but those of the lead bytes C2 and E1 to E3, among which Unicode has white space); ASCII punctuation after a letter."""
    is_start = np.zeros(len(data) + 1, bool)
    at = np.flatnonzero(BLANK[data])
    at = at[at > 0]
    one = data[at - 1]
    two, three, four = (data[np.maximum(at - k, 0)] for k in (2, 3, 4))
    later = one >= 0x80
    sure = ((one > 32) & (one < 127)) | (later & (two >= 0xC3) & (two < 0xE0)) | (later & (two >= 0x80) & (two < 0xC0) & ((three >= 0xE4) & (three < 0xF0) | (three >= 0x80) & (three < 0xC0) & (four >= 0xF0)))
    is_start[at[sure]] = True
    at = np.flatnonzero(PUNCTUATION[data])
    is_start[at[LETTER[data[at - 1]]]] = True
    is_start[offsets] = True
    is_start[-1] = False
    return np.flatnonzero(is_start)


class Store:
    """Pieces and their ids in arrays that grow, under a table of hashes. A hash only leads to a piece; its bytes decide."""

    def __init__(self) -> None:
        self.table = np.full(1 << 16, -1, np.int32)
        self.n = self.n_text = self.n_ids = 0
        self.hashes, self.text_at, self.ids_at = np.zeros(0, np.uint64), np.zeros(1, np.int32), np.zeros(1, np.int32)
        self.text, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.int32)
        self.apart: dict[bytes, int] = {}  # pieces whose hash is that of another

    def _grown(self, name: str, used: int, more: np.ndarray) -> None:
        old = getattr(self, name)
        if used + len(more) > len(old):
            new = np.zeros((used + len(more)) * 5 // 4 + 1024, old.dtype)
            new[:used] = old[:used]
            setattr(self, name, new)
        getattr(self, name)[used : used + len(more)] = more

    def _look(self, hashes: np.ndarray) -> np.ndarray:
        """The slot under each hash, or -1."""
        mask = np.uint64(len(self.table) - 1)
        place = (hashes & mask).astype(np.int32)
        out = self.table[place]
        left = np.flatnonzero((out >= 0) & (self.hashes[out] != hashes)) if self.n else []
        while len(left):
            place[left] = (place[left] + 1) & int(mask)
            out[left] = self.table[place[left]]
            own = out[left]
            left = left[(own >= 0) & (self.hashes[own] != hashes[left])]
        return out

    def _put(self, slots: np.ndarray) -> None:
        """Slots of distinct new hashes into the table."""
        mask = len(self.table) - 1
        place = (self.hashes[slots] & np.uint64(mask)).astype(np.int64)
        while len(slots):
            free = self.table[place] < 0
            self.table[place[free]] = slots[free]
            left = self.table[place] != slots
            slots, place = slots[left], (place[left] + 1) & mask

    def add(self, pieces: list[bytes], sizes: np.ndarray, ids: np.ndarray) -> None:
        """New pieces, with the number of ids of each and all ids."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(x) for x in pieces])
        hashes = common.Rolling(data).of(np.concatenate([[0], ends[:-1]]), ends)
        new, first = np.unique(hashes, return_index=True)
        first = first[self._look(new) < 0]
        self._grown("text", self.n_text, data), self._grown("ids", self.n_ids, ids), self._grown("hashes", self.n, hashes)
        self._grown("text_at", self.n + 1, self.n_text + ends), self._grown("ids_at", self.n + 1, self.n_ids + np.cumsum(sizes))
        for i in set(range(len(pieces))).difference(first.tolist()) if len(first) < len(pieces) else ():
            self.apart[pieces[i]] = self.n + i
        slots, old = (self.n + first).astype(np.int32), self.n
        self.n, self.n_text, self.n_ids = self.n + len(pieces), self.n_text + len(data), self.n_ids + len(ids)
        if self.n * 2 > len(self.table):
            used = self.table[self.table >= 0]
            self.table = np.full(1 << int(self.n * 3).bit_length(), -1, np.int32)
            self._put(used)
        self._put(slots)

    def find(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """The slot of each piece of data, which begin at starts and leave no gap (-1: not here), and some that aren't here, each
        once: none only if all are."""
        ends = np.append(starts[1:], len(data))
        out, missing = [np.zeros(0, np.int32)], {}
        at = 0
        while at < len(starts):
            stop = max(at + 1, int(np.searchsorted(ends, starts[at] + LOOK_BYTES, "right")))
            own, low, high = data[starts[at] : ends[stop - 1]], starts[at:stop] - starts[at], ends[at:stop] - starts[at]
            hashes = common.Rolling(own).of(low, high)
            slots = self._look(hashes)
            known = np.flatnonzero(slots >= 0)
            begin = self.text_at[slots[known]]
            sizes = (high - low)[known]
            fits = self.text_at[slots[known] + 1] - begin == sizes
            known, sizes, begin = known[fits], sizes[fits], begin[fits]
            same = np.zeros(len(low), bool)
            if len(known):
                first = np.cumsum(sizes) - sizes
                here = own if len(known) == len(low) else own[ranges(low[known], sizes)]
                equal = self.text[np.repeat((begin - first).astype(np.int32), sizes) + np.arange(len(here), dtype=np.int32)] == here
                same[known] = np.logical_and.reduceat(equal, first)
            slots[~same] = -1
            lacking = np.flatnonzero(~same)
            if len(lacking) and self.apart:
                for i in lacking.tolist():
                    slots[i] = self.apart.get(own[low[i] : high[i]].tobytes(), -1)
                lacking = lacking[slots[lacking] < 0]
            if len(lacking):
                some = lacking[np.unique(hashes[lacking], return_index=True)[1]]
                raw = own.tobytes()
                missing.update((raw[a:b], None) for a, b in zip(low[some].tolist(), high[some].tolist(), strict=True))
            out.append(slots)
            at = stop
        return np.concatenate(out), list(missing)

    def ids_of(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each piece, and all ids."""
        begin = self.ids_at[slots]
        sizes = self.ids_at[slots + 1] - begin
        return sizes, self.ids[ranges(begin, sizes)]


class Codec:
    """The vocabulary in DuckDB, and the pieces encoded so far."""

    def __init__(self, file: bytes, pattern: str, spaced: bool = False):
        import duckdb
        import regex

        self.words_of = regex.compile(pattern).findall
        self.spaced = spaced
        self.ranks = ranks_of(file)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.lengths = np.zeros(max(self.ranks.values()) + 1, np.int64)
        self.lengths[list(self.ranks.values())] = [len(x) for x in self.ranks]
        self.store = Store()
        self.folder = tempfile.TemporaryDirectory(prefix="leakloom-duckdb-")  # of this process alone, for what exceeds the limit
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "128MB", "allocator_flush_threshold": "16MB", "temp_directory": self.folder.name})
        pairs, ranks = [], []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b), ranks.append(rank)
        self.keep("merges", {"pair": pa.array(pairs, pa.int64()), "rank": pa.array(ranks, pa.int64())})
        # a byte is the character of the same number
        self.keep("vocab", {"tok": pa.array(self.ranks.values(), pa.int32()), "text": pa.array([x.decode("latin-1") for x in self.ranks])})

    def keep(self, name: str, columns: dict[str, pa.Array]) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def fixpoint(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of words that are no tokens themselves: the number of ids of each, and all ids."""
        sizes = np.array([len(w) for w in words], np.int64)
        wids, lists = [np.zeros(0, np.int64)], [pa.array([], pa.list_(pa.int32()))]
        for some, run in ((np.flatnonzero(sizes <= LONG), self._short), (np.flatnonzero(sizes > LONG), self._long)):
            ends = np.cumsum(sizes[some])
            at = 0
            while at < len(some):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORD_BYTES, "right")))
                part = some[at:stop]
                toks = self.byte[np.frombuffer(b"".join(words[i] for i in part), np.uint8)]
                for wid, own in run(part, lists_of(toks, sizes[part])):
                    wids.append(wid), lists.append(own)
                at = stop
        found = pa.concat_arrays(lists).take(pa.array(np.argsort(np.concatenate(wids))))
        return np.diff(found.offsets.to_numpy()), found.flatten().to_numpy()

    def _short(self, part: np.ndarray, toks: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
        self.keep("words", {"wid": pa.array(part), "toks": toks})
        got = self.db.sql(STEPS).to_arrow_table().combine_chunks()
        yield got.column("wid").to_numpy(), got.column("toks").combine_chunks().cast(pa.list_(pa.int32()))

    def _long(self, part: np.ndarray, toks: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
        left = pa.array(part)
        while len(left):
            self.keep("words", {"wid": left, "toks": toks})
            got = self.db.sql(LONG_STEPS.format(levels=LEVELS)).to_arrow_table()
            more = got.column("step").to_numpy() == LEVELS
            done, rest = got.filter(pa.array(~more)).combine_chunks(), got.filter(pa.array(more)).combine_chunks()
            yield done.column("wid").to_numpy(), done.column("toks").combine_chunks().cast(pa.list_(pa.int32()))
            left, toks = rest.column("wid").combine_chunks(), rest.column("toks").combine_chunks()

    def learn(self, pieces: list[bytes]) -> None:
        """Encodes new pieces and keeps them. Those that begin with a space and end in ASCII are split together, as a text."""
        texts = [x.decode() for x in pieces]
        if self.spaced:
            chained = [t[0] == " " and 32 < x[-1] < 127 for t, x in zip(texts, pieces, strict=True)]
            order = sorted(range(len(pieces)), key=lambda i: not chained[i])
            pieces, texts = [pieces[i] for i in order], [texts[i] for i in order]
            n = sum(chained)
            parts = [self.words_of("".join(texts[:n])), *map(self.words_of, texts[n:])]
            words = [w for part in parts for w in part]
            ends, at = np.cumsum([len(t) for t in texts]), np.cumsum([len(w) for w in words])
            owner = np.searchsorted(ends, at)
        else:
            words, owner = texts, np.arange(len(texts))
        distinct = list(dict.fromkeys(words))
        number = {w: i for i, w in enumerate(distinct)}
        raw = [w.encode() for w in distinct]
        ranks = list(map(self.ranks.get, raw))
        new = [i for i, r in enumerate(ranks) if r is None]
        more, values = self.fixpoint([raw[i] for i in new])
        sizes = np.ones(len(distinct), np.int64)
        sizes[new] = more
        begin = np.zeros(len(distinct), np.int64)
        begin[new] = np.cumsum(more) - more
        whole = np.array([r is not None for r in ranks])
        begin[whole] = len(values) + np.arange(int(whole.sum()))
        values = np.concatenate([values, np.array([r for r in ranks if r is not None], np.int32)])
        use = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        self.store.add(pieces, np.bincount(owner, sizes[use], len(pieces)).astype(np.int64), values[ranges(begin[use], sizes[use])])

    def encoded(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, and all ids."""
        if self.store.n > KEPT:
            self.store = Store()
        data, offsets = common.text_buffer(column)
        if self.spaced:
            starts = piece_starts(data, offsets)
            firsts = np.searchsorted(starts, offsets)
        else:
            split = [self.words_of(t or "") for t in column.to_pylist()]
            words = [w.encode() for own in split for w in own]
            data = np.frombuffer(b"".join(words), np.uint8)
            starts = np.concatenate([[0], np.cumsum([len(w) for w in words])])[:-1].astype(np.int64)
            firsts = np.concatenate([[0], np.cumsum([len(own) for own in split])]).astype(np.int64)
        slots, missing = self.store.find(data, starts)
        while missing:
            self.learn(missing)
            lacking = np.flatnonzero(slots < 0)
            sizes = np.append(starts[1:], len(data))[lacking] - starts[lacking]
            slots[lacking], missing = self.store.find(data[ranges(starts[lacking], sizes)], np.cumsum(sizes) - sizes)
        sizes, ids = self.store.ids_of(slots)
        return np.diff(np.concatenate([[0], np.cumsum(sizes)])[firsts]), ids

    def decoded(self, sizes: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """The bytes of lists of ids, given by their sizes and all ids."""
        out = []
        for at in range(0, len(ids), TOKENS):
            part = ids[at : at + TOKENS]
            self.keep("toks", {"pos": pa.array(np.arange(len(part))), "tok": pa.array(part)})
            out.append(self.db.sql(DECODE).fetchall()[0][0].encode("latin-1"))
        whole = b"".join(out)
        cuts = np.concatenate([[0], np.cumsum(self.lengths[ids])])[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)].tolist()
        if cuts[-1] != len(whole):
            raise ValueError("an id that the vocabulary lacks")
        return [whole[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def codec(file: bytes, pattern: str, spaced: bool = False) -> Codec:
    key = hashlib.sha256(file + pattern.encode() + bytes([spaced])).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(file, pattern, spaced)
    return _codecs[key]


def given(spark: SparkSession, path: str) -> Broadcast:
    """The rank file, read on the driver: executors need not have it."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def added(df: DataFrame, *fields: tuple[str, str]) -> StructType:
    schema = StructType(list(df.schema.fields))
    for name, kind in fields:
        schema = schema.add(name, DataType.fromDDL(kind))
    return schema


def encoded(docs: DataFrame, path: str, pattern: str, digests: bool = False, spaced: bool = False) -> DataFrame:
    """docs with ids (array of int), or with n_tokens, ids_sha256 and decoded_sha256 (of the decoded ids) in its stead."""
    file = given(docs.sparkSession, path)
    common.small_batches(docs.sparkSession)
    docs = common.apart(docs, ("n_tokens", "ids_sha256", "decoded_sha256") if digests else ("ids",))[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(file.value, pattern, spaced)
        for batch in batches:
            for part in common.slices(batch, "text", TEXT_BYTES):
                sizes, ids = own.encoded(part.column("text"))
                if digests:
                    back = [hashlib.sha256(x).hexdigest() for x in own.decoded(sizes, ids)]
                    joined = pc.binary_join(lists_of(ids, sizes).cast(pa.list_(pa.string())), " ")
                    digest = [hashlib.sha256(x.as_buffer()).hexdigest() for x in joined]
                    more = {"n_tokens": pa.array(sizes.astype(np.int64)), "ids_sha256": pa.array(digest, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
                else:
                    more = {"ids": lists_of(ids, sizes)}
                yield pa.RecordBatch.from_arrays([*part.columns, *more.values()], names=[*part.schema.names, *more])

    fields = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")] if digests else [("ids", "array<int>")]
    return docs.mapInArrow(lambda rows: common.released(run(rows)), added(docs, *fields))


def decoded(df: DataFrame, path: str, pattern: str, column: str = "ids") -> DataFrame:
    """df with decoded (binary): the bytes of its lists of ids; null for null."""
    file = given(df.sparkSession, path)
    common.small_batches(df.sparkSession)
    df = common.apart(df, ("decoded",))[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(file.value, pattern)
        for batch in batches:
            lists = batch.column(column)
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            texts = own.decoded(sizes, ids)
            more = pa.array([t if there else None for there, t in zip(lists.is_valid().to_pylist(), texts, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, more], names=[*batch.schema.names, "decoded"])

    return df.mapInArrow(lambda rows: common.released(run(rows)), added(df, ("decoded", "binary")))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True, spaced=True).drop("text")
