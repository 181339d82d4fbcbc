"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are first read as classes: insult (with a weight), threat, target (persons spoken to or of), negation, reported speech, other.
Over each clause runs the composition of five transducers, built once as one table of states:

* `reported` passes insults and threats on as quoted ones after a word of reporting or a quotation mark;
* `negated` passes them on as denied ones for REACH words after a negation;
* `insult`, `threat` and `target` pass all on; their final states say whether the clause has an insult or a threat of any
  kind, and whether it names a person. Only clauses that end in an accepting state of one of the first two match.

The weight of an arc that gives an insult or a threat is its word's weight; a matched clause has the sums by kind.

A document's features are sums over its matched clauses by kind, never over words alone, and a logistic regression turns them into a
score. What is learnt, from at most `train_rows` labelled rows with crc32(doc_id) % 4 <> 2: the insult lexicon (whole words and stems, that
is word beginnings, by the lower bound of the share of toxic ones among documents that have them; their neighbours must be various, so
that copies of one text do not make its words insults), and the regression. A seed lexicon keeps the grammar of use without labels.

Scores depend on the text alone. Defined results: a null or empty text, and any without a matched clause, gets the regression's base
score; texts of any length are read whole, and an empty table gives an empty one. A doc_id labelled twice is toxic if one label says so; null labels are passed over. Without labels of both classes fixed weights
score the seeds. Rows are scored each by itself; other columns of the input stay, one named score as score_in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leakloom.llm import common

TRAIN_ROWS = 20_000
LEAST_DOCS = 6
LEAST_SHARE = 0.6
LEAST_NEIGHBOURS = 5
STEMS = (4, 5, 6, 7)
REACH = 3
THRESHOLD = 0.3
SEED_WEIGHT = 3.0

#: Words, and negated verbs with their apostrophe.
TOKEN = re.compile(r"[^\W\d_]+n['’]t(?![^\W_])|[^\W\d_]+|[.!?;:\n\"«»„“”]")
ENDS = frozenset(".!?;\n")
QUOTES = frozenset("\"«»„“”")

INSULTS = "idiot idiots moron morons stupid dumb fool fools loser losers scum trash clown worthless pathetic disgusting vermin imbecile coward filthy ugly dummkopf trottel arschloch abschaum versager idiota imbécil estúpido estúpida basura crétin abruti ordure minable débile".split()
THREATS = "kill killing murder hurt destroy die strangle beat shoot stab burn töten umbringen vernichten schlagen sterben tuer frapper mourir détruire matar golpear morir destruir".split()
TARGETS = "you your yours u he she him her they them du dich dir dein deine sie ihr euch tu te toi ton ta vous votre il elle ils usted ustedes tú ti él ella ellos".split()
NEGATIONS = "not no never nobody neither nor without nicht kein keine nie niemals pas jamais aucun sans nunca ni sin tampoco".split()
REPORTS = "said says say told called quoted reported wrote according allegedly sagte sagt nannte laut dit disait selon dijo dice llamó según".split()

#: What the grammar gives for a matched word: quoted and denied ones are kept apart, and the regression weighs them.
KINDS = ("insult", "denied insult", "quoted insult", "threat", "denied threat", "quoted threat")
FEATURES = (*KINDS, "targeted insult", "targeted threat", "clauses", "strongest clause", "clauses per word")


@dataclass(frozen=True)
class Transducer:
    """Deterministic: (state, symbol) to (state, symbol), where nothing is said the state stays and the symbol passes."""

    start: int
    arcs: dict[tuple[int, str], tuple[int, str]]

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.arcs.get((state, symbol), (state, symbol))


def composed(parts: list[Transducer], alphabet: tuple[str, ...]) -> tuple[dict[tuple[int, str], tuple[int, str]], list[tuple[int, ...]]]:
    """One table for the chain of parts, and its states (those that can be reached, numbered from the start state 0) by those of the parts."""
    start = tuple(p.start for p in parts)
    numbers, queue, table = {start: 0}, [start], {}
    while queue:
        state = queue.pop()
        for symbol in alphabet:
            out, after = symbol, []
            for part, own in zip(parts, state, strict=True):
                own, out = part.step(own, out)
                after.append(own)
            if (after := tuple(after)) not in numbers:
                numbers[after] = len(numbers)
                queue.append(after)
            table[numbers[state], symbol] = numbers[after], out
    return table, list(numbers)


def grammar() -> tuple[dict[tuple[int, str], tuple[int, str]], list[tuple[int, ...]]]:
    """Symbols: i insult, t threat, g target, n negation, r report, o other. Out: i, t, plain; d, e denied; q, u quoted."""
    reported = Transducer(0, {(0, "r"): (1, "o"), (1, "r"): (1, "o"), (1, "i"): (1, "q"), (1, "t"): (1, "u")})
    arcs: dict[tuple[int, str], tuple[int, str]] = {}
    for left in range(REACH + 1):
        arcs[left, "n"] = (REACH, "o")
        if left:
            for symbol in "iotgqu":
                arcs[left, symbol] = (left - 1, {"i": "d", "t": "e"}.get(symbol, symbol))
    negated = Transducer(0, arcs)
    seen = [Transducer(0, {(0, symbol): (1, symbol) for symbol in symbols}) for symbols in ("idq", "teu", "g")]
    return composed([reported, negated, *seen], ("i", "t", "g", "n", "r", "o"))


_OUT = {"i": 0, "d": 1, "q": 2, "t": 3, "e": 4, "u": 5}


class Grammar:
    def __init__(self, terms: dict[str, float], stems: dict[str, float]):
        self.table, states = grammar()
        self.matches = [bool(x[2] or x[3]) for x in states]
        self.targeted = [bool(x[4]) for x in states]
        self.words: dict[str, tuple[str, float]] = {}
        for symbol, words in (("g", TARGETS), ("n", NEGATIONS), ("r", REPORTS), ("t", THREATS), ("i", INSULTS)):
            self.words |= {w: (symbol, SEED_WEIGHT) for w in words}
        self.words |= {w: ("i", x) for w, x in terms.items()}
        self.stems = stems
        self.heads = {w[:4] for w in (*terms, *INSULTS, *THREATS)} | {w[:4] for w in stems}

    def read(self, word: str) -> tuple[str, float]:
        if word in self.words:
            return self.words[word]
        if word.endswith(("n't", "n’t")):
            return "n", 0.0
        best = max((self.stems.get(word[:n], 0.0) for n in STEMS if len(word) > n), default=0.0)
        return ("i", best) if best else ("r", 0.0) if word in QUOTES else ("o", 0.0)

    def features(self, text: str | None) -> np.ndarray | None:
        """None if no clause matches."""
        tokens = TOKEN.findall((text or "").lower())
        heads = self.heads
        known = {w: self.read(w) for w in set(tokens) if w[:4] in heads}
        if not any(symbol in "it" for symbol, _ in known.values()):
            return None
        out = np.zeros(len(FEATURES))
        start = 0
        for at in [i for i, w in enumerate(tokens) if w in ENDS] + [len(tokens)]:
            clause = tokens[start:at]
            start = at + 1
            if not any(known.get(w, "o")[0] in "it" for w in clause):
                continue
            sums, state = np.zeros(6), 0
            for word in clause:
                symbol, weight = known.get(word) or self.read(word)
                state, got = self.table[state, symbol]
                if got in _OUT:
                    sums[_OUT[got]] += weight
            if not self.matches[state]:
                continue
            out[:6] += sums
            if self.targeted[state]:
                out[6] += sums[:3].sum()
                out[7] += sums[3:].sum()
            out[8] += 1
            out[9] = max(out[9], sums.sum())
        out[10] = 100 * out[8] / max(1, len(tokens))
        return np.log1p(out)


def training_rows(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """text and toxic of at most so many labelled documents, none held out, those of the lowest hashes; of rows with one doc_id the text of the lowest hash."""
    some = (
        labels.where("doc_id is not null and toxic in (0, 1)")
        .where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
        .withColumnRenamed("doc_id", "labelled_id")
    )  # at most `rows` rows: a proven bound
    return docs.where("text is not null").select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("labelled_id")).groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "toxic")


def lexicon(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of words and of stems (log odds): found in enough documents, mostly toxic ones, beside various neighbours. All of
    them: each stands in LEAST_DOCS of the bounded rows at least."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def rows() -> pa.RecordBatch:
            terms = list(counts)
            columns = [pa.array(terms), *(pa.array([counts[t][k] for t in terms], pa.int64()) for k in range(3))]
            return pa.RecordBatch.from_arrays(columns, names=["term", "toxic", "clean", "near"])

        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                words = [w for w in TOKEN.findall(text.as_py().lower()) if w[0].isalpha()]
                near: dict[str, int] = {}
                if toxic:
                    for i, w in enumerate(words):
                        beside = 1 << (sum(map(ord, words[i - 1] if i else "")) + 31 * sum(map(ord, words[i + 1] if i + 1 < len(words) else ""))) % 63
                        for term in (f"w{w}", *(f"s{w[:n]}" for n in STEMS if len(w) > n)):
                            near[term] = near.get(term, 0) | beside
                else:
                    for w in set(words):
                        near[f"w{w}"] = 0
                        for n in STEMS:
                            if len(w) > n:
                                near[f"s{w[:n]}"] = 0
                for term, mask in near.items():
                    own = counts.setdefault(term, [0, 0, 0])
                    own[0] += toxic
                    own[1] += 1 - toxic
                    own[2] |= mask
                if len(counts) > 400_000:
                    yield rows()
                    counts.clear()
        if counts:
            yield rows()

    sums = rows.mapInArrow(count, "term string, toxic long, clean long, near long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_or("near").alias("near"))
    n, p, zz = F.col("toxic") + F.col("clean"), F.col("toxic") / (F.col("toxic") + F.col("clean")), 3.84
    low = (p + zz / (2 * n) - F.sqrt(zz * (p * (1 - p) + zz / (4 * n)) / n)) / (1 + zz / n)
    sums = sums.where((F.col("toxic") >= LEAST_DOCS) & (F.bit_count("near") >= LEAST_NEIGHBOURS)).withColumn("low", low).where(F.col("low") >= LEAST_SHARE)
    weight = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5))
    got = sums.select("term", weight.alias("weight"), "low").collect()
    words = {r.term[1:]: r.weight for r in got if r.term[0] == "w"}
    stems = {r.term[1:]: r.weight for r in got if r.term[0] == "s"}
    return words, stems


def regression(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias, by Newton steps with a small ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 0.5 * np.append(w[:-1], 0.0)
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(np.append(np.full(len(w) - 1, 0.5), 1e-6))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return w


@dataclass(frozen=True)
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    weights: np.ndarray


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    common.small_batches(docs.sparkSession)
    rows = common.written(training_rows(docs, labels, train_rows))
    words, stems = lexicon(rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(words, stems)
        for batch in batches:
            x = [own.features(t.as_py()) for t in batch.column("text")]
            x = [np.zeros(len(FEATURES)) if v is None else v for v in x]
            yield pa.RecordBatch.from_arrays([pa.array([v.tolist() for v in x], pa.list_(pa.float64())), batch.column("toxic").cast(pa.int32())], names=["x", "toxic"])

    # equal rows as one with a count: most have no match, and what comes here is bounded by train_rows
    got = rows.mapInArrow(features, "x array<double>, toxic int").groupBy("x", "toxic").count().collect()
    if len({r.toxic for r in got}) < 2:
        return Model(words, stems, np.append(np.full(len(FEATURES), 0.8), -3.0))
    times = [r["count"] for r in got]
    x, y = np.repeat(np.array([r.x for r in got]), times, axis=0), np.repeat(np.array([r.toxic for r in got], float), times)
    return Model(words, stems, regression(x, y))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score."""
    docs = common.apart(docs, ("score",))[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(model.words, model.stems)
        for batch in batches:
            logits = np.full(batch.num_rows, model.weights[-1])
            for i, text in enumerate(batch.column("text")):
                x = own.features(text.as_py())
                if x is not None:
                    logits[i] += x @ model.weights[:-1]
            score = pa.array(1 / (1 + np.exp(-np.clip(logits, -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[*batch.schema.names, "score"])

    common.small_batches(docs.sparkSession)
    return docs.mapInArrow(lambda rows: common.released(run(rows)), StructType(list(docs.schema.fields)).add("score", "double"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(docs, train(docs, common.table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
