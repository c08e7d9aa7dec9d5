"""Preference pairs for training: one prompt, two masked completions.

The prompt is the longest run of turns that the chosen and the rejected conversation begin
with. It is rendered once; what follows on either side is rendered as a completion, with
the spans of it that are trained on. A conversation becomes one record, so its turns are
gathered in one row; conversations are never gathered with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Template of a turn, and the role that is trained on.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns``, in order; repeated rows count once, missing values as empty."""
    turn = F.struct(
        F.coalesce(F.col("turn").cast("long"), F.lit(0).cast("long")).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return (
        turns.filter(F.col("conv_id").isNotNull())
        .groupBy(F.col("conv_id").cast("long").alias("conv_id"))
        .agg(F.array_sort(F.collect_set(turn)).alias("turns"))
    )


def common_turns(left: Column, right: Column) -> Column:
    """How many turns two conversations begin with in common."""
    same = F.zip_with(
        left, right, lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False))
    )
    first_other = F.array_position(same, F.lit(False))
    return F.when(first_other > 0, first_other - 1).otherwise(F.size(same)).cast("int")


def head_of(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head_of(t), t["text"], F.lit(CLOSE))), "")


def trained_spans(turns: Column) -> Column:
    """Start and length in the rendered turns of what is trained on: a reply and its end mark."""
    empty = F.array().cast("array<struct<start:int,length:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(done: Column, turn: Column) -> Column:
        head, body = F.length(head_of(turn)), F.length(turn["text"]) + len(CLOSE)
        span = F.struct((done["at"] + head).alias("start"), (body - 1).alias("length"))
        return F.struct(
            (done["at"] + head + body).alias("at"),
            F.when(turn["role"] == TRAINED_ROLE, F.concat(done["spans"], F.array(span)))
            .otherwise(done["spans"]).alias("spans"),
        )

    return F.aggregate(turns, start, step, lambda done: done["spans"])


def preference_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """One record for each row of ``pairs`` (pair_id, chosen_id, rejected_id).

    Columns: pair_id, common_turns, prompt, chosen, rejected, chosen_spans, rejected_spans.
    Spans count characters and leave out the line break after an end mark. A conversation
    that is missing has no turns; equal conversations are all prompt and have two empty
    completions. Turns without a conversation are left out; turns of one number go by
    role, then text. Empty tables give no rows.
    """
    told = conversations(turns)
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    both = (
        pairs.select("pair_id", F.col("chosen_id").cast("long"), F.col("rejected_id").cast("long"))
        .join(told.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("c")), "chosen_id", "left")
        .join(told.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("r")), "rejected_id", "left")
        .withColumns({"c": F.coalesce("c", none), "r": F.coalesce("r", none)})
    )
    # zip_with pads the shorter side, and a turn never equals padding
    cut = both.withColumn("common_turns", common_turns(F.col("c"), F.col("r")))

    def rest(name: str) -> Column:
        return F.slice(F.col(name), F.col("common_turns") + 1, F.size(name))

    return cut.select(
        "pair_id",
        "common_turns",
        rendered(F.slice("c", F.lit(1), F.col("common_turns"))).alias("prompt"),
        rendered(rest("c")).alias("chosen"),
        rendered(rest("r")).alias("rejected"),
        trained_spans(rest("c")).alias("chosen_spans"),
        trained_spans(rest("r")).alias("rejected_spans"),
    )


def swapped_replies(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and pairs for preference data out of plain conversations.

    A conversation with a reply is chosen over its own turns before the last reply,
    followed by the last reply of its neighbour (the id that differs in the last bit; an
    empty reply where there is none). Chosen conversations get even ids, the others odd.
    """
    given = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    last = (
        given.filter((F.col("role") == TRAINED_ROLE) & F.col("conv_id").isNotNull())
        .groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("reply"))
        .select("conv_id", F.col("reply.turn").alias("last"), F.col("reply.text").alias("reply"))
    )
    before = given.join(last, "conv_id").filter("turn < last")
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("reply").alias("theirs"))
    reply = last.join(other, "conv_id", "left").select(
        "conv_id", F.col("last").alias("turn"), F.lit(TRAINED_ROLE).alias("role"),
        F.coalesce("theirs", F.lit("")).alias("text"),
    )
    columns = ["turn", "role", "text"]
    odd = before.select("conv_id", *columns).unionByName(reply)
    made = given.select((F.col("conv_id") * 2).alias("conv_id"), *columns).unionByName(
        odd.select((F.col("conv_id") * 2 + 1).alias("conv_id"), *columns)
    )
    pairs = last.select(
        F.col("conv_id").alias("pair_id"), (F.col("conv_id") * 2).alias("chosen_id"),
        (F.col("conv_id") * 2 + 1).alias("rejected_id"),
    )
    return made, pairs
