"""Personal data: base patterns, and bootstrapped contextual extraction. DataFrame operations only.

1. Seeds: e-mail addresses, IPv4 addresses, card and phone numbers, found by regular expressions and checks (`base`). Possessive
   quantifiers and a look-behind keep the search linear; they don't change what matches.
2. A lexical pattern is a kind and the two words before an identifier, whatever their length, but no further back than the second match of
   the same search before it; where the text begins before two words, `^` stands for its beginning. Seeds induce the
   patterns. Candidates are words with digits or an @, and numbers in groups with spaces and brackets, that are no base match but have a
   shape that a kind allows (local phone numbers, IPv6, cards that fail the checksum, addresses without a dot). Where two overlap,
   the number in groups counts.
3. Pattern-instance graph: patterns are joined to all their instances, seeds and candidates, over the corpus. In each of
   `rounds` rounds, a pattern's score is the mean score of its instances (one more counts as 0), an instance's score is
   1 less the product of what its patterns lack, 1 for a seed; then instances of a score of ACCEPTED induce the patterns in which they
   stand elsewhere, and these join the graph with all their instances.
4. Patterns of at least `support` different seeds or accepted instances and a score of `least` find: their candidates become spans.

Texts are read once; what is shuffled are the few identifiers with two words each. Contexts that are everywhere are summed up before
the shuffle. Nothing is collected.

Defined results: null and empty texts have no spans. Rows with equal doc_id are each judged by themselves, with a row number that the
written table fixes; a null doc_id is no matter. Texts of any length are read whole; of equal scores the first kind counts; an empty
table gives an empty one. Positions are code points, the end is exclusive. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakloom.llm import common

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
CANDIDATE = r"(?<!\S)(?=[^\s0-9@]*+[0-9@])\S{6,}+(?!\S)"
#: Numbers in groups, at least one of which stands after a space or a bracket.
GROUPED = r"(?<![^\s\x22\x27<\[{,;:])[(+]?[0-9]++(?:[ ().-]{1,3}+[0-9]++)++(?![0-9A-Za-z@])"
#: What a candidate, without punctuation around it, must look like for a kind; digits are counted apart.
SHAPES = {
    "email": (r"^[^\s@]+@[^\s@]+$", 0, 99),
    "ip": (r"^(?=.*:.*:)[0-9A-Fa-f:.%/]+$", 1, 99),
    "card": (r"^[0-9][0-9 ./-]+[0-9]$", 12, 19),
    "phone": (r"^[(+]?[0-9][0-9 ()./+-]+[0-9]$", 7, 15),
}
#: Punctuation that is no part of a candidate.
BEFORE, AFTER = r"^[\"\x27<\[{]", r"[\"\x27>\]},.;:!?]"
ROUNDS, SUPPORT, LEAST = 3, 3, 0.6
#: From this score on an instance induces patterns.
ACCEPTED = 0.75

SPAN = "ARRAY<STRUCT<start: INT, k: INT, end: INT, value: STRING, context: STRING>>"


# The functions below make SQL text, with names for the values that they take.


def digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def luhn(number: str) -> str:
    each = f"transform(split(reverse({number}), ''), (d, i) -> int(d) * (1 + i % 2))"
    return f"aggregate({each}, 0, (n, x) -> n + x - CASE WHEN x > 9 THEN 9 ELSE 0 END) % 10 = 0"


def valid(kind: str, value: str) -> str:
    if kind == "ip":
        return f"forall(split({value}, '[.]'), p -> coalesce(try_cast(p AS INT) <= 255, false))"
    if kind == "card":
        return f"length({digits(value)}) BETWEEN 12 AND 19 AND {luhn(digits(value))}"
    return f"length({digits(value)}) BETWEEN 9 AND 15" if kind == "phone" else "true"


def context(before: str, whole: str) -> str:
    """The last two words, in lower case, or what there is after ^ if `before` is all that is before (whole); empty if there are not two."""
    two = rf"regexp_extract(before, r'(?<!\S)(\S++\s++\S++)\s*+$', 1)"
    return common.bound(before, "before", rf"lower(regexp_replace(CASE WHEN {two} <> '' THEN {two} WHEN {whole} THEN trim(concat('^ ', regexp_extract(before, r'(\S*+)\s*+$', 1))) ELSE '' END, r'\s+', ' '))")


def matches(text: str, pattern: str, k: int, valid: str) -> str:
    """The matches v for which `valid` holds, as SPAN: the pieces between all matches give their places and contexts."""
    both = f"zip_with(regexp_extract_all({text}, r'{pattern}', 0), split({text}, r'{pattern}', -1), (v, p) -> struct(v AS value, p AS piece))"
    places = f"zip_with(own, {common.sums_before('transform(own, x -> length(x.piece) + length(x.value))')}, (x, at) -> struct(at + length(x.piece) AS start, x.value AS value))"
    some = f"filter(transform({places}, (x, i) -> struct(x.start AS start, x.value AS value, i AS i)), x -> {common.bound('x.value', 'v', valid)})"
    before = "concat_ws('', get(own, x.i - 2).piece, get(own, x.i - 2).value, get(own, x.i - 1).piece, get(own, x.i - 1).value, get(own, x.i).piece)"
    found = f"transform({some}, x -> struct(x.start AS start, {k} AS k, x.start + length(x.value) AS end, x.value AS value, {context(before, 'x.i <= 2')} AS context))"
    # what follows the last match is a piece without one
    return common.bound(f"filter({both}, x -> x.value IS NOT NULL)", "own", found)


def base(text: str) -> dict[str, str]:
    """For each kind the array of its valid matches in a column."""

    def some(kind: str) -> str:
        """The text, or an empty one if it can have no match."""
        test = f"contains({text}, '{NEEDS[kind]}')" if NEEDS[kind] else f"{text} RLIKE '[0-9]{{2}}|[0-9][ -][0-9]'"
        return f"CASE WHEN {test} THEN {text} ELSE '' END"

    return {kind: matches(some(kind), PATTERNS[kind], k, valid(kind, "v")) for k, kind in enumerate(KINDS)}


def stripped(value: str) -> str:
    """Without punctuation around it."""
    return f"regexp_replace({value}, r'{BEFORE}++|(?<!{AFTER}){AFTER}++$', '')"


def allows(kind: str, value: str) -> str:
    shape, least, most = SHAPES[kind]
    return f"({value} RLIKE r'{shape}' AND length({digits(value)}) BETWEEN {least} AND {most})"


def found(docs: DataFrame) -> DataFrame:
    """row, doc_id, a column for each kind, base and candidates, all SPAN; a candidate's k is -1."""
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", *(F.expr(x).alias(k) for k, x in base("text").items()))
    out = out.withColumn("base", F.array_sort(F.concat(*KINDS)))
    shaped = common.bound(stripped("v"), "w", " OR ".join(allows(kind, "w") for kind in KINDS))
    words = matches("CASE WHEN text RLIKE '[0-9@]' THEN text ELSE '' END", CANDIDATE, -1, shaped)
    left, value = f"length(regexp_extract(x.value, r'{BEFORE}*', 0))", stripped("x.value")
    words = f"transform({words}, x -> struct(x.start + {left} AS start, x.k AS k, x.start + {left} + length({value}) AS end, {value} AS value, x.context AS context))"
    grouped = matches("CASE WHEN text RLIKE '[0-9][ ().-]{1,3}[0-9]' THEN text ELSE '' END", GROUPED, -1, f"v RLIKE '[ (]' AND ({' OR '.join(allows(kind, 'v') for kind in ('card', 'phone'))})")
    apart = lambda spans, known: common.bound(common.span_index(known), "known", f"filter({spans}, w -> NOT {common.meets('known', 'w.start', 'w.end')})")
    free = common.bound(apart(grouped, "base"), "grouped", f"concat(grouped, {apart(apart(words, 'base'), 'grouped')})")
    return out.select("doc_id", *KINDS, "base", F.expr(free).alias("candidates")).withColumn("row", F.monotonically_increasing_id())


def instances(rows: DataFrame) -> DataFrame:
    """(k, context, value, seed): all seeds and candidates with their contexts, each once."""
    seeds = rows.select(F.explode("base").alias("s")).select("s.k", "s.context", "s.value").where("context <> ''").distinct().withColumn("seed", F.lit(True))
    own = rows.select(F.explode("candidates").alias("s")).select("s.context", "s.value").where("context <> ''").distinct()
    kinds = F.expr(f"array_compact(array({', '.join(f'CASE WHEN {allows(kind, "value")} THEN {k} END' for k, kind in enumerate(KINDS))}))")
    return seeds.unionByName(own.select(F.explode(kinds).alias("k"), "context", "value").withColumn("seed", F.lit(False)))


def trusted(rows: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, least: float = LEAST) -> DataFrame:
    """(k, context, score) of the patterns that may find."""
    every = common.written(instances(rows))
    patterns = every.where("seed").select("k", "context").distinct()
    for no in range(rounds):
        graph = common.checkpointed(every.join(patterns, ["k", "context"], "left_semi"))
        if no == 0:
            scores = graph.withColumn("own", F.col("seed").cast("double"))
        else:
            scores = graph.join(known, ["k", "value"], "left").withColumn("own", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("own", F.lit(0.0))))  # noqa: F821
        patterns = scores.groupBy("k", "context").agg((F.sum("own") / (F.count("*") + 1)).alias("score"), F.count_if(F.col("own") >= ACCEPTED).alias("sure"))
        if no == rounds - 1:
            break
        linked = graph.join(patterns.select("k", "context", "score"), ["k", "context"])
        known = common.checkpointed(linked.groupBy("k", "value").agg((1 - F.exp(F.sum(F.log1p(-F.least("score", F.lit(0.999999)))))).alias("own")))
        more = every.join(known.where(F.col("own") >= ACCEPTED).select("k", "value"), ["k", "value"], "left_semi").select("k", "context")
        patterns = patterns.select("k", "context").union(more).distinct()
    return patterns.where((F.col("sure") >= support) & (F.col("score") >= least)).select("k", "context", "score")


def scanned(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, least: float = LEAST) -> DataFrame:
    """doc_id, a column for each kind (base spans), base and added: arrays of (start, k, end, value, context), in order."""
    rows = common.written(found(docs))
    free = rows.select("row", F.explode("candidates").alias("s"))
    kind = " OR ".join(f"k = {k} AND {allows(name, 's.value')}" for k, name in enumerate(KINDS))
    hits = free.join(trusted(rows, rounds, support, least).withColumnRenamed("context", "_context"), F.col("s.context") == F.col("_context")).where(kind)
    best = hits.groupBy("row", "s").agg(F.max(F.struct("score", (-F.col("k")).alias("k"))).alias("b"))
    span = F.struct(F.col("s.start").alias("start"), (-F.col("b.k")).alias("k"), F.col("s.end").alias("end"), F.col("s.value").alias("value"), F.col("s.context").alias("context"))
    added = best.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("added"))
    return rows.join(added, "row", "left").withColumn("added", F.coalesce("added", F.array().cast(SPAN))).drop("row", "candidates")


def listed(spans: str) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scanned(common.table(spark, sf_dir, "documents")).withColumn("spans", F.array_sort(F.concat("base", "added")))
    return out.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"), F.size("added").cast("long").alias("n_added"))
