"""Line dedup: content-defined chunks of lines, removed where they repeat across the corpus. DataFrame operations only.

1. A text is split at \n, and each line hashed. A line of one document alone ends a run of shared lines. Inside a run a chunk
   ends unless each of the two lines stands next to the other wherever it occurs: so wherever a common run of two documents
   begins or ends, a chunk does. It also ends around a line of over `min_words` words, between lines with and without words, and
   where a rolling hash over two line hashes is 0 modulo `modulus`; lines without words in a row are one chunk. None of this
   depends on where in its text a passage stands.
2. From each chunk of a run, downwards and upwards, the fewest chunks of over `min_words` words together are a window. Windows
   are counted over all documents by the hashes of their chunks. Those of a common run cover the run, whatever else its lines
   are in. A window of two documents or more goes, except for its first place (in the document of the lowest doc_id, the first
   from the top) and what overlaps that in the same document.
3. Byte comparison: all copies of a chunk must be the same text, or none of them goes.

Only hashes, counts and numbers of lines are shuffled, but for the texts themselves, once to compare and once to cut
(the plan uses one exchange for both where the columns are the same). A line or chunk that is everywhere is summed up
before the shuffle; common ones, whose number is bounded by their share, are broadcast to their places, all others joined by key.

Defined results: null and empty texts stay as they are. A null doc_id keeps its text. Rows with equal doc_id and text are
one document, and all are cut alike; rows with equal doc_id and other texts are different documents, the lower hash first.
A \\r is part of its line. A passage that repeats only inside one document stays. Lines without
words at the edge of a passage stay where their number differs from copy to copy. A text may become empty; its row stays.
All columns of the input stay, whatever their names; one that is named like a result comes out as `<name>_in`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakloom.llm import common

MIN_WORDS = 50
MODULUS = 2
#: A line with this share of all places of shared lines is common, so there are 2,000 of them at most; windows of chunks likewise.
COMMON = 1 / 2_000
KEY = ("_id", "_hash")
RESULTS = ("n_lines", "n_removed", "removed")
WORD = r"[^\x20\x09-\x0D]+"


def keyed(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), F.col("text").alias("_text"))


def looked_up(rows: DataFrame, counts: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """rows with the values that counts (keys, values, n: how many rows there are of a key) has for their keys; others go.

    Keys with a share of COMMON of all counted rows are broadcast, being 1 / COMMON at most. Their rows have what they need, so any key
    deals them evenly; the others are joined by their keys."""
    own, counts = rows.columns, common.written(counts)
    least = max(1, (counts.agg(F.sum("n")).first()[0] or 0) * COMMON)
    often = counts.where(F.col("n") >= least).select(*keys, F.struct(*values).alias("often"))
    rest = counts.where(F.col("n") < least).select(F.col(keys[0]).alias("dealt"), *keys[1:], F.struct(*values).alias("seldom"))
    dealt = F.when(F.col("often").isNull(), F.col(keys[0])).otherwise(F.xxhash64(*own))
    both = rows.join(F.broadcast(often), keys, "left").withColumn("dealt", dealt).join(rest.hint("merge"), ["dealt", *keys[1:]], "left")
    return both.withColumn("near", F.coalesce("often", "seldom")).where("near is not null").select(*own, *(F.col(f"near.{v}") for v in values))


def shared_lines(docs: DataFrame) -> DataFrame:
    """_id, _hash, place, line (hash), words, led, followed (whether all its places have the same line before, after): lines of at least two documents."""
    lines = keyed(docs).select(*KEY, F.transform(F.split("_text", "\n"), lambda x: F.struct(F.xxhash64(x).alias("line"), F.regexp_count(x, F.lit(WORD)).alias("words"))).alias("lines"))
    near = F.expr("transform(lines, (x, i) -> struct(x.line AS line, coalesce(get(lines, i - 1).line, 0L) AS up, coalesce(get(lines, i + 1).line, 0L) AS down))")
    once = lines.select(F.xxhash64(*KEY).alias("doc"), F.explode(near).alias("x")).select("doc", "x.*")
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("doc", "up", "down") for f in (F.min, F.max)]
    counts = once.groupBy("line").agg(*ends, F.count("*").alias("n")).where("min_doc <> max_doc").selectExpr("line", "min_up = max_up AS led", "min_down = max_down AS followed", "n")
    every = lines.select(*KEY, F.posexplode("lines").alias("place", "x")).select(*KEY, "place", "x.line", "x.words")
    return looked_up(every, counts, ["line"], ["led", "followed"])


def chunks(docs: DataFrame, modulus: int = MODULUS, min_words: int = MIN_WORDS) -> DataFrame:
    """_id, _hash, chunk (hash), top, bottom (places of lines), words."""
    in_text = Window.partitionBy(*KEY).orderBy("place")
    lines = shared_lines(docs).withColumns({"up": F.lag("place").over(in_text), "up_followed": F.lag("followed").over(in_text), "up_line": F.lag("line").over(in_text), "up_words": F.lag("words").over(in_text)})
    lines = lines.where("up is null or up < place")  # a row given twice
    apart = ~(F.col("up_followed") & F.col("led")) | (F.greatest("words", "up_words") > min_words) | (F.least("words", "up_words") == 0) | (F.pmod(F.xxhash64("up_line", "line"), F.lit(modulus)) == 0)
    cut = (F.col("up") + 1 != F.col("place")) | ((F.greatest("words", "up_words") > 0) & apart)
    lines = lines.withColumn("no", F.sum(F.when(cut, 1).otherwise(0)).over(in_text)).withColumn("top", F.min("place").over(Window.partitionBy(*KEY, "no")))
    found = lines.groupBy(*KEY, "no", "top").agg(F.max("place").alias("bottom"), F.sum("words").alias("words"), F.bit_xor(F.xxhash64("line", F.col("place") - F.col("top"))).alias("chunk"))
    return found.drop("no")


def runs(docs: DataFrame, modulus: int = MODULUS, min_words: int = MIN_WORDS) -> DataFrame:
    """_id, _hash, run (number), parts (chunks from the top, upto: the words of the run with theirs): shared lines in a row, of over min_words words."""
    in_text = Window.partitionBy(*KEY).orderBy("top")
    found = chunks(docs, modulus, min_words).withColumn("new", F.coalesce(F.lag("bottom").over(in_text) + 1 != F.col("top"), F.lit(True)))
    found = found.withColumn("run", F.sum(F.col("new").cast("int")).over(in_text))
    found = found.withColumn("upto", F.sum("words").over(Window.partitionBy(*KEY, "run").orderBy("top")))
    parts = F.sort_array(F.collect_list(F.struct("top", "bottom", "words", "upto", "chunk"))).alias("parts")
    return found.groupBy(*KEY, "run").agg(F.max("upto").alias("all_words"), parts).where(F.col("all_words") > min_words).drop("all_words")


def windows(found: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """_id, _hash, run, top, bottom, window, more (hashes): for each chunk the fewest chunks from it, and up to it, of over min_words words."""
    most = 2 * min_words + 3  # so many chunks at most, as every other one has words
    down = f"transform(parts, (x, i) -> filter(slice(parts, i + 1, {most}), y -> y.upto - y.words - x.upto + x.words <= {min_words}))"
    up = f"filter(transform(parts, (x, i) -> filter(slice(parts, greatest(i + 2 - {most}, 1), least(i + 1, {most})), y -> x.upto - y.upto <= {min_words})), w -> size(w) > 1)"
    whole = f"filter(concat({down}, {up}), w -> element_at(w, -1).upto - w[0].upto + w[0].words > {min_words})"
    hashed = f"transform({whole}, w -> struct(w[0].top AS top, element_at(w, -1).bottom AS bottom, xxhash64(w.chunk) AS window, hash(w.chunk) AS more))"
    return found.select(*KEY, "run", F.expr(f"inline({hashed})"))


def passages(docs: DataFrame, modulus: int = MODULUS, min_words: int = MIN_WORDS) -> DataFrame:
    """_id, _hash, chunk, top, bottom, stays: the chunks of repeated windows."""
    own = common.written(runs(docs, modulus, min_words))
    found = common.written(windows(own, min_words))
    repeated = found.groupBy("window", "more").agg(F.min(F.struct(*KEY, "bottom")).alias("first"), F.max(F.struct(*KEY)).alias("last"), F.count("*").alias("n"))
    repeated = repeated.where("first._id <> last._id OR first._hash <> last._hash").drop("last")
    stays = (F.col("first._id") == F.col("_id")) & (F.col("first._hash") == F.col("_hash")) & (F.col("top") <= F.col("first.bottom"))
    spans = looked_up(found, repeated, ["window", "more"], ["first"]).select(*KEY, "run", F.struct(F.col("top").alias("start"), (F.col("bottom") + 1).alias("end")).alias("span"), stays.alias("stays"))
    of_run = spans.groupBy(*KEY, "run").agg(*(F.sort_array(F.collect_set(x)).alias(name) for x, name in ((F.col("span"), "every"), (F.when(~F.col("stays"), F.col("span")), "gone"))))
    held = f"filter(parts, x -> {common.meets('i_every', 'x.top', 'x.bottom + 1')})"
    judged = f"transform({held}, x -> struct(x.chunk AS chunk, x.top AS top, x.bottom AS bottom, NOT {common.meets('i_gone', 'x.top', 'x.bottom + 1')} AS stays))"
    judged = common.bound(common.span_index("every"), "i_every", common.bound(common.span_index("gone"), "i_gone", judged))
    return own.join(of_run, [*KEY, "run"]).select(*KEY, F.expr(f"inline({judged})"))


def deduplicated(docs: DataFrame, modulus: int = MODULUS, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text cut, and n_lines, n_removed (long), removed (string: top:bottom of line numbers from 0, comma-joined)."""
    docs, names = common.apart(docs, RESULTS, (*KEY, "_text", "_gone"))
    found = common.written(passages(docs, modulus, min_words))
    of_text = found.groupBy(*KEY).agg(F.collect_list(F.struct("chunk", "top", "bottom")).alias("parts"))
    texts = keyed(docs).join(of_text, list(KEY))
    copies = texts.select(F.split("_text", "\n").alias("lines"), F.explode("parts").alias("p"))
    copies = copies.select("p.chunk", F.array_join(F.slice("lines", F.col("p.top") + 1, F.col("p.bottom") - F.col("p.top") + 1), "\n").alias("own"))
    differ = copies.groupBy("chunk").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low <> high").select("chunk")
    differ = common.written(differ)  # chunks of equal hash and other text: hardly ever any, so Spark sees by its size whether to broadcast it
    gone = found.where("not stays").join(differ, "chunk", "left_anti").groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("top", "bottom"))).alias("_gone"))
    own = docs.withColumns({"_id": F.col("doc_id"), "_hash": F.xxhash64("text"), "_text": F.col("text")}).drop("text")
    lines = F.split("_text", "\n")
    spans = common.span_index("transform(_gone, g -> struct(g.top AS start, g.bottom + 1 AS end))")
    left = F.expr(common.bound(spans, "gone", f"array_join(filter(split(_text, '\n'), (line, i) -> NOT {common.meets('gone', 'i', 'i + 1')}), '\n')"))
    cut = own.join(gone, list(KEY), "left").withColumns(
        {
            "text": F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(left),
            "n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"),
            "n_removed": F.coalesce(F.aggregate("_gone", F.lit(0), lambda n, g: n + g["bottom"] - g["top"] + 1), F.lit(0)).cast("long"),
            "removed": F.coalesce(F.array_join(F.transform("_gone", lambda g: F.concat_ws(":", g["top"].cast("string"), g["bottom"].cast("string"))), ","), F.lit("")),
        }
    )
    return cut.select(*docs.columns, *RESULTS).toDF(*names, *RESULTS)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
