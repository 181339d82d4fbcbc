"""Chat formatting by prefix-target expansion: each assistant turn becomes an example of its own, with all turns before it as
context and only that reply trainable. Turns after the last assistant turn, and conversations without one, come as one more
example without a target, so that nothing of a conversation is lost.

Template: `<s>` once, then for each turn `[role]`, its text, `[/role]`, and at the very end `</s>`. A trainable text stands between
`[loss]` and `[/loss]` inside its turn. Inside texts and roles a backslash and every `[`, `]` and `<` becomes a backslash with a letter
(CODES), so no text can hold a control string or a part of one, and texts come back exactly. The loss mask of an example is
what lies between its loss marks.

The examples of a conversation of n turns are longer than the conversation by a factor of up to n / 2: that is the method. A
conversation is cut into blocks of BLOCK turns. Each block goes once to every later block of its conversation, dealt by
conversation and block, so that the examples of a long conversation are made in many tasks; a task holds the turns before
one block and makes one example at a time. No task holds more text than a few examples of the largest kind.

Order: by turn, equal ones by role and text; a null turn comes first. Defined results: a null text or role is empty; rows with a null
conv_id are one conversation; repeated rows are turns like others, and so are empty ones; an empty table has no examples. A text of
any length is taken whole. Only the role `assistant` is trainable. Columns besides the four are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakloom.llm import common

TARGET = "assistant"
#: Turns in a block.
BLOCK = 128
#: What stands for what, the backslash first.
CODES = (("\\", "\\b"), ("[", "\\o"), ("]", "\\c"), ("<", "\\l"))


def escaped(text: str) -> str:
    for plain, code in CODES:
        text = text.replace(plain, code)
    return text


def unescaped(text: str) -> str:
    for plain, code in reversed(CODES):
        text = text.replace(code, plain)
    return text


def escaped_column(text: Column) -> Column:
    for plain, code in CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped_column(text: Column) -> Column:
    for plain, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def parsed(formatted: str) -> list[tuple[str, str, bool]]:
    """(role, text, whether it is under the loss mask) of every turn of an example."""
    if not (formatted.startswith("<s>") and formatted.endswith("</s>")):
        raise ValueError("no example")
    out, rest = [], formatted[3:-4]
    while rest:
        role, _, rest = rest[1:].partition("]")
        text, mark, rest = rest.partition(f"[/{role}]")
        if not mark:
            raise ValueError(f"no end of a turn of {role}")
        trainable = text.startswith("[loss]") and text.endswith("[/loss]")
        out.append((unescaped(role), unescaped(text[6:-7] if trainable else text), trainable))
    return out


def formatted(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, example (number from 0), target (number of the trainable turn, or null), formatted."""
    whole = Window.partitionBy("conv_id")
    order = whole.orderBy("turn", "role", "text")
    turns = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("no", F.row_number().over(order) - 1).withColumn("last", F.count("*").over(whole) - 1)
    name, is_target = escaped_column(F.col("role")), F.col("role") == TARGET
    around = lambda a, b: F.concat(F.lit("["), name, F.lit(f"]{a}"), escaped_column(F.col("text")), F.lit(f"{b}[/"), name, F.lit("]"))
    turn = F.struct("no", is_target.alias("on"), around("", "").alias("plain"))
    # a turn's form as a target differs by its marks alone, and is made from the plain one when needed
    blocks = turns.groupBy("conv_id", F.floor(F.col("no") / block).alias("block"), F.floor(F.col("last") / block).alias("last_block"), "last").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: t["plain"]), "")
    count = F.size(F.filter("turns", lambda t: t["on"]))
    own = blocks.select("conv_id", F.col("block").alias("at"), "block", "last", "turns", F.lit(None).cast("string").alias("text"), F.lit(0).alias("n"))
    none = F.lit(None).cast(blocks.schema["turns"].dataType)
    earlier = blocks.where("block < last_block").select("conv_id", F.explode(F.sequence(F.col("block") + 1, F.col("last_block"))).alias("at"), "block", "last", none.alias("turns"), text.alias("text"), count.alias("n"))
    # of conversations of one block nothing is joined: they are groups of one row
    parts = F.array_sort(F.collect_list(F.when(F.col("turns").isNull(), F.struct("block", "text"))))
    joined = own.unionByName(earlier).groupBy("conv_id", "at").agg(
        F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("before"), F.sum("n").alias("first"), F.max("last").alias("last"), F.first("turns", ignorenulls=True).alias("turns")
    )
    each = joined.select("conv_id", "before", "first", "last", "turns", F.explode(F.sequence(F.lit(1), F.size("turns"))).alias("i"))
    t, up_to = F.element_at("turns", F.col("i")), F.slice("turns", F.lit(1), F.col("i") - 1)
    each = each.where(t["on"] | (t["no"] == F.col("last")))
    head = F.concat(F.lit("<s>"), "before", F.array_join(F.transform(up_to, lambda x: x["plain"]), ""))
    inner = F.expr(f"substring(element_at(turns, i).plain, {len(TARGET) + 3}, length(element_at(turns, i).plain) - {2 * len(TARGET) + 5})")
    target = F.concat(F.lit(f"[{TARGET}][loss]"), inner, F.lit(f"[/loss][/{TARGET}]"))
    return each.select(
        "conv_id",
        (F.col("first") + F.size(F.filter(up_to, lambda x: x["on"]))).cast("int").alias("example"),
        F.when(t["on"], t["no"]).cast("int").alias("target"),
        F.concat(head, F.when(t["on"], target).otherwise(t["plain"]), F.lit("</s>")).alias("formatted"),
    )


def under_mask(text: Column) -> Column:
    """The text under the loss mask of an example; null if there is none."""
    inner = F.substring_index(F.substring_index(text, "[loss]", -1), "[/loss]", 1)
    return F.when(F.contains(text, F.lit("[loss]")), unescaped_column(inner))


def turns_of(text: Column) -> Column:
    """The turns of an example: array of role and text."""
    plain = F.replace(F.replace(F.substr(text, F.lit(4), F.length(text) - 7), F.lit("[loss]"), F.lit("")), F.lit("[/loss]"), F.lit(""))
    pieces = F.filter(F.split(plain, r"\[/[^\]]*\]"), lambda x: x != "")
    role = lambda x: unescaped_column(F.substring_index(F.substring_index(x, "]", 1), "[", -1))
    return F.transform(pieces, lambda x: F.struct(role(x).alias("role"), unescaped_column(F.substring_index(x, "]", -1)).alias("text")))


def digests(examples: DataFrame) -> DataFrame:
    """Read back from the examples of each conversation: n_turns, turns_sha256, loss_chars, loss_sha256 (of all text under a
    loss mask, in order), formatted_chars. Every example is read where it was made; what is gathered for a conversation, the texts
    under its masks, is no longer than its last example, which holds all turns."""
    said = F.transform(turns_of(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = examples.select("conv_id", "example", F.length("formatted").cast("long").alias("n"), under_mask(F.col("formatted")).alias("loss"), said.alias("said"))
    read = read.select("conv_id", "example", "n", "loss", F.struct(F.size("said").cast("long").alias("n"), F.sha2(F.array_join("said", ""), 256).alias("sha256")).alias("turns"))
    out = read.groupBy("conv_id").agg(
        F.max_by("turns", "example").alias("turns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("learnt"),
        F.sum("n").alias("formatted_chars"),
    )
    return out.select("conv_id", F.col("turns.n").alias("n_turns"), F.col("turns.sha256").alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT -1L AS conv_id, col1 AS turn, col2 AS role, '{hard}' AS text FROM VALUES (0L, 'user'), (1L, '{TARGET}')")
    return digests(formatted(common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)))
