r"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted (turn, role, text), adjacent
turns of one role become one block, and blocks are concatenated:

    <|im_start|>role<|im_sep|>text<|im_next|>text<|im_end|>

``<|im_next|>`` keeps apart the texts that one block merges, so that every turn can be read
back. The loss mask covers each text of the trained role, as (start, length) in code points.

*Escapes.* A control string is an opener, ``<`` or ``[``, and a rest without openers. Inside
roles and texts, one backslash is put behind the opener of whatever is an opener, any number
of backslashes and such a rest; reading back takes one away. No control string is left over
within a text, no other text changes, and none can arise across an edge, as a rest holds no
opener.

A conversation is one row and so is its formatted text, which must be whole for its digests;
nothing larger than a conversation is gathered.

Defined cases: a NULL text is empty, a NULL role is the empty role, a NULL turn comes first;
ties of ``turn`` are ordered by role and text, and repeated rows stay repeated turns; a NULL
``conv_id`` is a conversation of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

START, SEP, NEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>"
#: Control strings of this and other chat templates, all escaped inside texts.
CONTROLS = (START, SEP, NEXT, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
TRAINED = "assistant"

_RESTS = "|".join(re.escape(c[1:]) for c in CONTROLS)
_ENCODE = rf"([<\[]\\*)(?={_RESTS})"
_DECODE = rf"([<\[]\\*)\\(?={_RESTS})"
#: Running totals are taken per chunk, so that long conversations cost no quadratic copying.
CHUNK = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(_ENCODE), F.lit(r"$1\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_DECODE), F.lit("$1"))


def _at(array: Column, i: Column) -> Column:
    return F.get(array, i.cast("int"))


def running_before(counts: Column) -> Column:
    """For each number of an array, the sum of those before it."""
    zero = F.lit(0).cast("long")

    def totals(numbers: Column, start: Column) -> Column:
        seen = F.struct(start.alias("sum"), F.array().cast("array<bigint>").alias("before"))
        return F.aggregate(numbers, seen, lambda acc, x: F.struct(
            (acc["sum"] + x).alias("sum"), F.array_append(acc["before"], acc["sum"]).alias("before")))["before"]

    chunks = F.when(F.size(counts) > 0, F.transform(
        F.sequence(F.lit(0), F.floor((F.size(counts) - 1) / CHUNK).cast("int")),
        lambda c: F.slice(counts, c * CHUNK + 1, F.lit(CHUNK)))).otherwise(F.array().cast("array<array<bigint>>"))
    starts = totals(F.transform(chunks, lambda c: F.aggregate(c, zero, lambda a, x: a + x)), zero)
    return F.flatten(F.transform(F.arrays_zip(chunks.alias("c"), starts.alias("s")), lambda z: totals(z["c"], z["s"])))


def formatted(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text", trained: str = TRAINED) -> DataFrame:
    """Per conversation: ``conv_id``, ``formatted`` and ``loss``, the masked (start, length) pairs."""
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                   F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = turns.select(F.col(conv_id).alias("conv_id"), row.alias("t")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("t")).alias("turns"))
    # Where a block begins; its texts are the slice up to the next beginning.
    out = out.withColumn("firsts", F.expr(
        "filter(sequence(0, size(turns) - 1), i -> i = 0 OR get(turns, i).role <> get(turns, i - 1).role)"))
    out = out.withColumn("blocks", F.transform("firsts", lambda at, k: F.struct(
        _at(F.col("turns"), at)["role"].alias("role"),
        F.transform(
            F.slice("turns", at + 1, F.coalesce(_at(F.col("firsts"), k + 1), F.size("turns")) - at),
            lambda t: escape(t["text"])).alias("texts"))))
    # Pieces between which nothing stands: what opens a text, then the text, then END of the last.
    out = out.withColumn("pieces", F.flatten(F.transform("blocks", lambda b, k: F.transform(b["texts"], lambda x, i: F.struct(
        F.when(i > 0, F.lit(NEXT)).otherwise(F.concat(
            F.when(k > 0, F.lit(END)).otherwise(F.lit("")), F.lit(START), escape(b["role"]), F.lit(SEP))).alias("opens"),
        x.alias("text"), (b["role"] == F.lit(trained)).alias("loss"))))))
    out = out.withColumn("before", running_before(
        F.transform("pieces", lambda p: (F.length(p["opens"]) + F.length(p["text"])).cast("long"))))
    spans = F.transform(
        F.filter(F.arrays_zip("pieces", "before"), lambda z: z["pieces"]["loss"]),
        lambda z: F.struct((z["before"] + F.length(z["pieces"]["opens"])).alias("start"),
                           F.length(z["pieces"]["text"]).cast("long").alias("length")))
    whole = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["opens"], p["text"])), ""), F.lit(END))
    return out.select("conv_id", whole.alias("formatted"), spans.alias("loss"))


def read_back(conversations: DataFrame) -> DataFrame:
    """Per formatted conversation: ``turns`` (role, text), and ``masked``, the unescaped texts under the mask."""
    literal = lambda c: F.lit(re.escape(c))
    blocks = F.split(F.expr(f"substring(formatted, {len(START) + 1}, length(formatted) - {len(START) + len(END)})"),
                     literal(END + START))

    def turns_of(block: Column) -> Column:
        parts = F.split(block, literal(SEP))
        return F.transform(F.split(parts[1], literal(NEXT)), lambda x: F.struct(
            unescape(parts[0]).alias("role"), unescape(x).alias("text")))

    masked = F.transform("loss", lambda s: unescape(
        F.substring("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return conversations.select(
        "conv_id", "formatted", F.flatten(F.transform(blocks, turns_of)).alias("turns"), masked.alias("masked"))


def digests(conversations: DataFrame) -> DataFrame:
    """What was read back, as counts and SHA-256 digests."""
    back = read_back(conversations)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("masked", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
