"""Edit-aware token counts: a segment tree over each document's pre-tokens.

The leaves are blocks of about LEAF pre-tokens with their texts and token counts; inner nodes hold sums of characters and tokens. An edit
(start, end, new text, in code points of the text as it then is) finds its leaves by descent, and re-reads the text from a few pre-tokens
before it: from the last boundary that ends at least LOOK_AHEAD characters before the edit, since a match of the split pattern looks no
further than that past its end. It stops at the first boundary behind the edit where a pre-token began before too: the pattern looks at
nothing before a match, so from there on all is as it was. Only these pre-tokens are encoded anew, and only the sums above their leaves change.
A leaf that has grown beyond 4 x LEAF is split by building the tree anew from the counts it has; no text is encoded for that.

`trees` makes what is kept of each document: the lengths and token counts of its pre-tokens, from which its tree is put up without
encoding anything. `edited` works on such a table, so a text is encoded once and then only where edits touch it.

Tokens are counted by the given rank file, each match of the split pattern by itself, without special tokens.

Defined results: a null text is empty; an empty one has no tokens. Edits out of range are clipped to the text. Texts of any
length are taken whole, an empty table gives an empty one; each row is judged by itself, whatever its doc_id. Both keep the other columns, one that is named like a result as `<name>_in`. A null list of edits is an empty one.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakloom.llm import bpe, common

LEAF = 32
LOOK_AHEAD = 3
#: Different pre-tokens whose counts a Python worker keeps.
KEPT = 500_000

_counters: dict[str, Counter] = {}


class Counter:
    """Pre-tokens of a text, and the tokens of each."""

    def __init__(self, file: bytes, pattern: str):
        import regex
        import tiktoken

        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.ranks_of(file), special_tokens={})
        self.known: dict[str, int] = {}

    def count(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            if len(self.known) >= KEPT:
                self.known.clear()
            n = self.known[word] = len(self.encoding.encode_ordinary(word))
        return n

    def counts(self, words: list[str]) -> list[int]:
        known = self.known
        new = [w for w in set(words) if w not in known]
        if len(known) + len(new) > KEPT:
            known.clear()
            new = list(set(words))
        for w in new:
            known[w] = len(self.encoding.encode_ordinary(w))
        return [known[w] for w in words]


def counter(file: bytes, pattern: str) -> Counter:
    key = hashlib.sha256(file + pattern.encode()).hexdigest()
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(file, pattern)
    return _counters[key]


class Tree:
    def __init__(self, text: str, own: Counter, kept: tuple[list[int], list[int]] | None = None):
        """kept: lengths and token counts of the text's pre-tokens; without it they are read and encoded."""
        self.own = own
        self.encoded = 0  # pre-tokens encoded since the tree was built
        if kept is None:
            words = own.pattern.findall(text)
            counts = own.counts(words)
        else:
            ends = list(itertools.accumulate(kept[0], initial=0))
            words, counts = [text[a:b] for a, b in itertools.pairwise(ends)], list(kept[1])
        self._build(words, counts)

    def _build(self, words: list[str], counts: list[int]) -> None:
        self.leaves = [(words[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(words), LEAF)] or [([], [])]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (w, c) in enumerate(self.leaves):
            self.chars[self.size + i], self.tokens[self.size + i] = sum(map(len, w)), sum(c)
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def words(self) -> list[str]:
        return [w for leaf in self.leaves for w in leaf[0]]

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character (at the end: the last), and the characters before it."""
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if at - before >= self.chars[i] and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        return i - self.size, before

    def _set(self, no: int, words: list[str], counts: list[int]) -> None:
        self.leaves[no] = (words, counts)
        i = self.size + no
        self.chars[i], self.tokens[i] = sum(map(len, words)), sum(counts)
        while i > 1:
            i //= 2
            self._sum(i)

    def edit(self, start: int, end: int, text: str) -> None:
        start = max(0, min(start, self.length))
        end = max(start, min(end, self.length))
        # leaves from the last boundary that the edit can't touch
        first, before = self._leaf(max(0, start - 1))
        while first > 0 and before + LOOK_AHEAD > start:
            first -= 1
            before -= self.chars[self.size + first]
        words, counts = self.leaves[first]
        kept, at = 0, before
        while kept < len(words) and at + len(words[kept]) + LOOK_AHEAD <= start:
            at += len(words[kept])
            kept += 1
        head, head_counts = words[:kept], counts[:kept]
        # old text from there on, leaf by leaf, as far as it is needed
        last, rest, rest_counts = first, words[kept:], counts[kept:]
        have = at + sum(map(len, rest))
        while True:
            while have < end + 64 and last + 1 < len(self.leaves):
                last += 1
                rest, rest_counts = rest + self.leaves[last][0], rest_counts + self.leaves[last][1]
                have = at + sum(map(len, rest))
            done = self._reread(at, rest, rest_counts, start, end, text, last + 1 == len(self.leaves))
            if done is not None:
                break
            last += 1  # no common boundary yet: one more leaf
            rest, rest_counts = rest + self.leaves[last][0], rest_counts + self.leaves[last][1]
            have = at + sum(map(len, rest))
        new, new_counts = head + done[0], head_counts + done[1]
        self._set(first, new, new_counts)
        for no in range(first + 1, last + 1):
            self._set(no, [], [])
        if len(new) > 4 * LEAF:
            self._build(self.words(), [c for leaf in self.leaves for c in leaf[1]])

    def _reread(self, at: int, rest: list[str], counts: list[int], start: int, end: int, text: str, whole: bool) -> tuple[list[str], list[int]] | None:
        """The pre-tokens after the edit, or None if what is at hand doesn't settle them. whole: the text ends with `rest`."""
        old = "".join(rest)
        new = old[: start - at] + text + old[end - at :]
        moved = len(text) - (end - start)
        places, place = {}, at
        for i, w in enumerate(rest):
            places[place + moved] = i
            place += len(w)
        behind = start + len(text)
        out: list[str] = []
        out_counts: list[int] = []
        here = at
        for m in self.own.pattern.finditer(new):
            here = at + m.start()
            if here >= behind and here in places and here - moved >= end:
                i = places[here]
                return out + rest[i:], out_counts + counts[i:]
            if not whole and at + m.end() + LOOK_AHEAD > at + len(new):
                return None  # what follows could change this match
            out.append(m[0])
            out_counts.append(self.own.count(m[0]))
            self.encoded += 1
        return (out, out_counts) if whole else None


EDIT = "array<struct<start:int,end:int,text:string>>"


def packed(numbers: list[int]) -> bytes:
    """A byte with the width that the largest number needs (1, 2 or 4), then the numbers, unsigned and little-endian."""
    most = max(numbers, default=0)
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes((width,)) + np.array(numbers, f"<u{width}").tobytes()


def unpacked(buffer: pa.Buffer) -> list[int]:
    return np.frombuffer(buffer, f"<u{buffer[0]}", offset=1).tolist()


def trees(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs with word_chars and word_tokens (binary, `packed`, a number for each pre-token): what `edited` needs of a text besides the text."""
    file = bpe.given(docs.sparkSession, path)
    common.small_batches(docs.sparkSession)
    docs = common.apart(docs, ("word_chars", "word_tokens"))[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(file.value, pattern)
        for batch in batches:
            for part in common.slices(batch, "text"):
                split = [own.pattern.findall(t or "") for t in part.column("text").to_pylist()]
                chars = [packed(list(map(len, words))) for words in split]
                tokens = [packed(own.counts(words)) for words in split]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(chars, pa.binary()), pa.array(tokens, pa.binary())], names=[*part.schema.names, "word_chars", "word_tokens"])

    return docs.mapInArrow(lambda rows: common.released(run(rows)), bpe.added(docs, ("word_chars", "binary"), ("word_tokens", "binary")))


def edited(kept: DataFrame, path: str, pattern: str, edits: str = "edits") -> DataFrame:
    """kept, which `trees` made and which has a column of edits (EDIT), with n_tokens, n_pretokens, n_tokens_after and n_encoded (pre-tokens that the edits encoded)."""
    file = bpe.given(kept.sparkSession, path)
    common.small_batches(kept.sparkSession)
    kept = common.apart(kept, ("n_tokens", "n_pretokens", "n_tokens_after", "n_encoded"))[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(file.value, pattern)
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for text, todo, *known in zip(*(batch.column(x) for x in ("text", edits, "word_chars", "word_tokens")), strict=True):
                tree = Tree(text.as_py() or "", own, tuple(unpacked(x.as_buffer()) for x in known))
                n, words = tree.total, sum(len(w) for w, _ in tree.leaves)
                for x in todo.as_py() or []:
                    tree.edit(x["start"], x["end"], x["text"] or "")
                out.append((n, words, tree.total, tree.encoded))
            names = ["n_tokens", "n_pretokens", "n_tokens_after", "n_encoded"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in zip(*out, strict=True))] if out else [*batch.columns, *[pa.array([], pa.int64())] * 4], names=[*batch.schema.names, *names])

    return kept.mapInArrow(lambda rows: common.released(run(rows)), bpe.added(kept, ("n_tokens", "long"), ("n_pretokens", "long"), ("n_tokens_after", "long"), ("n_encoded", "long")))


def three_edits(text: str = "text") -> Column:
    """Replace the first ten characters, put words into the middle, cut what then are the last five characters."""
    n = F.coalesce(F.length(text), F.lit(0))
    after = n - F.least(n, F.lit(10)) + 8 + 13
    one = [(F.lit(0), F.lit(10), "Revised "), (F.floor(n / 2).cast("int"), F.floor(n / 2).cast("int"), " (see note 7)"), (after - 5, after, "")]
    return F.array(*(F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(x).alias("text")) for a, b, x in one))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    kept = common.written(trees(common.table(spark, sf_dir, "documents").select("doc_id", "text"), *model), "zstd")
    return edited(kept.withColumn("edits", three_edits()), *model).drop("text", "edits", "word_chars", "word_tokens")
