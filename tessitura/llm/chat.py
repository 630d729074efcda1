"""Chat formatting by prefix-target expansion, in column functions alone.

Every turn becomes a segment ``### role: text</turn>`` and a line break; a
conversation is its segments in order. The two control strings and the escape
sign are replaced inside texts and roles, so a segment can always be found and
read back. Every assistant turn becomes an example: its prompt is the whole
conversation before it, its target that one reply, and only the target is
trainable.

A conversation is shuffled once, its texts as they are. Its loss mask is an
array of spans of the formatted text; examples are cut out of that text. Their
prompts take space in the square of the turns, so where they are not asked
for, Spark does not build them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: Control strings and what stands for them in a text; the escape sign first.
ESCAPES = (("\\", "\\b"), ("</turn>", "\\t"), ("###", "\\h"))
#: A role ends at a colon, so there it is replaced too.
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
TRAINED = "assistant"


def escape(text: Column, escapes=ESCAPES) -> Column:
    for plain, code in escapes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, escapes=ESCAPES) -> Column:
    """Every escape sign in an escaped text starts a code, so codes can be put back one kind after another, the sign's own last."""
    for plain, code in reversed(escapes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def segments(turns: DataFrame) -> DataFrame:
    """Each turn with its ``position`` from 0, its ``segment`` and the place of its text in the formatted conversation.

    ``first`` counts the characters before the text, ``chars`` those of it,
    both as formatted. Turns are ordered by (turn, role, text), so ties have
    one outcome; repeated rows are turns of their own. A null role or text
    counts as empty; null turn numbers come first; null conversations form one
    group. Other columns are dropped. An empty table gives no rows.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    role, text = escape(F.col("role"), ROLE_ESCAPES), escape(F.col("text"))
    plain = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    size = F.char_length(role) + F.char_length(text) + len(OPEN + MIDDLE + CLOSE)
    # lengths travel, not formatted texts: those are built behind the exchange
    placed = plain.withColumn("position", F.row_number().over(order) - 1).withColumn("stop", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    chars = F.char_length(text)
    return placed.select(
        "conv_id",
        "position",
        "role",
        F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE)).alias("segment"),
        (F.col("stop") - len(CLOSE) - chars).alias("first"),
        chars.cast("long").alias("chars"),
    )


def conversations(turns: DataFrame) -> DataFrame:
    """The formatted text of each conversation: conv_id, formatted, and mask.

    ``mask`` has a span for every assistant turn, in order: how many turns
    (``turns``) and characters (``first``) of ``formatted`` come before its
    trainable text, and how many characters that has (``chars``).
    """
    spans = F.when(F.col("role") == TRAINED, F.struct(F.col("position").alias("turns"), "first", "chars"))
    found = segments(turns).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("position", "segment"))).alias("parts"), F.array_sort(F.collect_list(spans)).alias("mask"))
    return found.select("conv_id", F.array_join(F.transform("parts", lambda x: x["segment"]), "").alias("formatted"), "mask")


def under(formatted: Column, span: Column) -> Column:
    """What a span of the mask covers, still escaped."""
    return F.substr(formatted, (span["first"] + 1).cast("int"), span["chars"].cast("int"))


def examples(found: DataFrame) -> DataFrame:
    """One row per span of the mask of formatted conversations, all else of a conversation repeated.

    Adds ``span``, the ``prompt`` before it and the ``target`` under it, both
    still escaped. A conversation without a span has one row with nulls there.
    """
    one = found.select("*", F.explode_outer("mask").alias("span"))
    return one.withColumn("prompt", F.substring(F.col("formatted"), F.lit(1), F.col("span.first").cast("int"))).withColumn("target", under(F.col("formatted"), F.col("span")))


def read_turns(formatted: Column) -> Column:
    """A formatted conversation as an array of (role, text)."""
    parts = F.split(formatted, CLOSE)
    head = lambda x: F.substring_index(x, MIDDLE, 1)
    return F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda x: F.struct(
            unescape(F.substr(head(x), F.lit(len(OPEN) + 1)), ROLE_ESCAPES).alias("role"),
            unescape(F.substr(x, F.char_length(head(x)) + len(MIDDLE) + 1)).alias("text"),
        ),
    )


def digests(found: DataFrame) -> DataFrame:
    """What formatted conversations and their examples read back as, by conversation.

    Nothing but ``formatted`` and ``mask`` is looked at: turns are read from
    the one, and the loss is what the targets of all examples say, in order.
    """
    read = F.array_join(F.transform(read_turns(F.col("formatted")), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    whole = found.select(
        "conv_id", "formatted", "mask", (F.size(F.split("formatted", CLOSE)) - 1).cast("long").alias("n_turns"), F.sha2(read, 256).alias("turns_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars")
    )
    one = examples(whole).select("conv_id", "n_turns", "turns_sha256", "formatted_chars", F.when(F.col("span").isNotNull(), F.struct("span.turns", "target")).alias("example"))
    # conversations lie together still, so this grouping moves nothing
    joined = one.groupBy("conv_id").agg(*(F.first(c).alias(c) for c in ("n_turns", "turns_sha256", "formatted_chars")), F.array_sort(F.collect_list("example")).alias("examples"))
    loss = unescape(F.array_join(F.transform("examples", lambda x: x["target"]), ""))
    final = joined.withColumn("loss", loss)
    return final.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", F.size("examples").cast("long").alias("n_examples"))
