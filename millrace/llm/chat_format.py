"""Preference pairs from two conversations that begin alike.

All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrays import ends, given

#: The marks of a turn, and what a mark in a text is written as.
START, END = "<|im_start|>", "<|im_end|>\n"
MARK, WRITTEN = "<|im_", "<|_im_"


def _turns(side: int) -> Column:
    """The turns of one side in order of turn, then role and text; null roles and texts are empty."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return F.sort_array(F.collect_list(F.when(F.col("side") == side, turn)))


def _common(a: Column, b: Column) -> Column:
    """The number of first turns with equal role and text."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (F.get(a, i)["role"] != F.get(b, i)["role"]) | (F.get(a, i)["text"] != F.get(b, i)["text"]))
    return F.when(n > 0, F.coalesce(F.array_min(differ), n)).otherwise(F.lit(0))


def _rendered(turns: Column) -> Column:
    """Each turn written out; a text's own marks are rewritten, so that no text can open or close a turn."""
    plain = lambda c: F.replace(c, F.lit(MARK), F.lit(WRITTEN))
    return F.transform(turns, lambda t: F.concat(F.lit(START), plain(t["role"]), F.lit("\n"), plain(t["text"]), F.lit(END)))


def _masks(turns: Column, trained: str) -> Column:
    """Spans (start, end) of the trained role's texts with their end mark, in code points of the joined turns."""

    def spans(p: Column) -> Column:
        lengths, stops = p["lengths"], p["ends"]
        head = len(START) + 1
        every = F.transform(p["roles"], lambda r, i: F.struct((F.get(stops, i) - F.get(lengths, i) + head + F.length(F.replace(r, F.lit(MARK), F.lit(WRITTEN)))).alias("start"), F.get(stops, i).alias("end")))
        return F.filter(every, lambda s, i: F.get(p["roles"], i) == trained)

    def placed(p: Column) -> Column:
        return F.struct(p["lengths"].alias("lengths"), p["roles"].alias("roles"), ends(p["lengths"]).alias("ends"))

    lengths = F.transform(_rendered(turns), lambda t: F.length(t).cast("long"))
    parts = F.struct(lengths.alias("lengths"), F.transform(turns, lambda t: t["role"]).alias("roles"))
    none = F.expr("array()").cast("array<struct<start:bigint,end:bigint>>")
    return F.when(F.size(turns) > 0, given(given(parts, placed), spans)).otherwise(none)


def preferences(chosen: DataFrame, rejected: DataFrame, pair_col: str, turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """Format pairs of conversations, given as turns, for preference training.

    Returns one row for each value of pair_col in either table: pair_col,
    n_prompt_turns (the longest common prefix of turns with equal role and text),
    prompt (those turns rendered once), and for each side its completion (the turns
    after them) and mask: spans (start, end) in code points of the completion that are
    trained on, the texts of the trained role with their end marks.

    Turns are in order of turn, null first, then role and text; repeated turns all
    count. Null roles and texts are empty. A side without turns has an empty prompt in
    common, an empty completion and no mask. Turns with a null pair are of no
    conversation and left out. Other columns aren't read. Empty tables give an empty result.

    A conversation is one row of the result, so its turns meet in one task; nothing
    else does.
    """
    part = lambda df, side: df.select(F.col(pair_col).alias("pair"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), F.lit(side).alias("side"))
    turns = part(chosen, 0).unionByName(part(rejected, 1)).where("pair is not null")
    pairs = turns.groupBy("pair").agg(_turns(0).alias("a"), _turns(1).alias("b"))
    split = pairs.withColumn("n", _common(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    split = split.select("pair", "n", F.slice("a", F.lit(1), F.col("n")).alias("prompt"), rest("a").alias("a"), rest("b").alias("b"))
    text = lambda c: F.concat_ws("", _rendered(F.col(c)))
    return split.select(
        F.col("pair").alias(pair_col),
        F.col("n").cast("long").alias("n_prompt_turns"),
        text("prompt").alias("prompt"),
        text("a").alias("chosen"),
        _masks(F.col("a"), trained).alias("chosen_mask"),
        text("b").alias("rejected"),
        _masks(F.col("b"), trained).alias("rejected_mask"),
    )
