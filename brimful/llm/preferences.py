"""Preference formatting of chosen and rejected conversations.

A conversation is an array of turns in order. The longest common turn prefix of a pair is rendered once, as
the prompt; what follows on each side is that side's completion. Completions come with the spans (code
points) that count for the loss: the content and end mark of assistant turns; everything else is masked.

Defined cases: a null role is "user" and a null text empty; turns with equal numbers are ordered by role
and text; a null turn number comes first; sides that are equal give empty completions; a side without
turns is an empty array; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brimful.functions.binding import let
from brimful.llm.common import written
from brimful.llm.fingerprints import next_ids

END = "<|end|>\n"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>) from one row for each turn."""
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.array_sort(F.collect_list(one))
    return turns.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.transform(ordered, lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"))


def _shown(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn.role, F.lit("|>\n"), turn.text, F.lit(END))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _shown), "")


def _counted(turns: Column) -> Column:
    """Spans of a completion that are not masked."""
    nothing = F.array().cast("array<struct<start:int,end:int>>")

    def step(state: Column, turn: Column) -> Column:
        end = state["at"] + F.length(_shown(turn))
        begin = end - F.length(turn.text) - len(END)
        spans = F.when(turn.role == "assistant", F.concat(state.spans, F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(state.spans)
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), nothing.alias("spans")), step, lambda s: s.spans)


def common_prefix(a: Column, b: Column) -> Column:
    """How many first turns are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return let(F.array_position(same, F.lit(False)).cast("int"), lambda at: F.when(at > 0, at - 1).otherwise(F.size(same)))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """(pair_id, n_prompt_turns, prompt, chosen, chosen_spans, rejected, rejected_spans) from (pair_id, chosen, rejected)."""
    cut = pairs.select("pair_id", "chosen", "rejected", common_prefix(F.col("chosen"), F.col("rejected")).alias("n_prompt_turns"))
    rest = lambda side: F.slice(side, F.col("n_prompt_turns") + 1, F.greatest(F.lit(0), F.size(side) - F.col("n_prompt_turns")))
    return cut.select(
        "pair_id",
        F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"),
        _rendered(F.slice("chosen", F.lit(1), F.col("n_prompt_turns"))).alias("prompt"),
        _rendered(rest("chosen")).alias("chosen"),
        _counted(rest("chosen")).alias("chosen_spans"),
        _rendered(rest("rejected")).alias("rejected"),
        _counted(rest("rejected")).alias("rejected_spans"),
    )


def mismatched_pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected): each conversation, and the same with its last assistant text from the next one.

    For corpora without ratings. Conversations without an assistant turn have no answer to compare.
    """
    whole = conversations(turns).withColumn("answer", F.size("turns") - F.array_position(F.transform(F.reverse("turns"), lambda t: t.role == "assistant"), F.lit(True)).cast("int"))
    whole = written(whole.where(F.exists("turns", lambda t: t.role == "assistant")), "conversations")
    following = next_ids(whole.select(F.col("conv_id").alias("doc_id")))
    answers = whole.select(F.col("conv_id").alias("next_id"), F.get("turns", F.col("answer")).text.alias("other"))
    pairs = whole.join(following.withColumnRenamed("doc_id", "conv_id"), "conv_id").join(answers, "next_id")
    swapped = F.transform("turns", lambda t, i: F.struct(t.role.alias("role"), F.when(i == F.col("answer"), F.col("other")).otherwise(t.text).alias("text")))
    return pairs.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), swapped.alias("rejected"))
