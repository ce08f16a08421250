"""Operator 7: preference formatting of chat (native: DataFrame and SQL functions only).

A pair is a chosen and a rejected conversation. Their longest common prefix of turns (same role and same
text) is rendered once, as the prompt; what follows in each is its completion. Completions come as one
string with the character spans in which loss is taken: the assistant's turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, turns array<struct<turn, role, text, end>>) in the order of turn, role, text;
    end is the number of characters up to the turn's end when all are rendered. Null roles count as 'user', null texts as
    empty; rows without conv_id don't count; rows that repeat are turns each."""
    role, text = F.coalesce("role", F.lit("user")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.length(rendered_turn(F.struct("role", "text")))).over(before).cast("long"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "end"))).alias("turns"))


def rendered_turn(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))


def rendered(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, rendered_turn))


def mask(turns: Column, base: Column) -> Column:
    """Spans [begin, finish) of a rendered completion that count for the loss: text and end mark of the
    assistant's turns. base is the end of the prompt."""
    own = F.filter(turns, lambda t: t["role"] == "assistant")
    size = lambda t: F.length(t["text"]) + F.lit(len("<|end|>\n"))
    return F.transform(own, lambda t: F.struct((t["end"] - base - size(t)).alias("begin"), (t["end"] - base).alias("finish")))


def common_turns(a: Column, b: Column) -> Column:
    """Number of turns at the start in which role and text agree."""
    least = F.least(F.size(a), F.size(b))
    same = F.zip_with(a, b, lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    differs = F.array_position(F.transform(same, lambda s: F.coalesce(s, F.lit(False))), F.lit(False))
    return F.when(differs == 0, least).otherwise(F.least(least, (differs - 1).cast("int")))


def preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """chosen and rejected (pair_id, conv_id, turns) -> one row per pair that has both. A prompt that would
    take up all of one side gives back its last turn, so that both completions have one, unless that side
    is empty."""
    a = chosen.select("pair_id", F.col("conv_id").alias("chosen_id"), F.col("turns").alias("c"))
    b = rejected.select("pair_id", F.col("conv_id").alias("rejected_id"), F.col("turns").alias("r"))
    rows = a.join(b, "pair_id").withColumn("shared", common_turns(F.col("c"), F.col("r")))
    rows = rows.withColumn("shared", F.greatest(F.lit(0), F.least("shared", F.size("c") - 1, F.size("r") - 1)))
    after = F.col("shared") + 1
    rows = rows.select(
        "pair_id", "chosen_id", "rejected_id", F.col("shared").alias("prompt_turns"),
        F.slice("c", 1, F.col("shared")).alias("p"), F.coalesce(F.get("c", F.col("shared") - 1)["end"], F.lit(0).cast("long")).alias("base"), F.slice("c", after, F.size("c")).alias("c"), F.slice("r", after, F.size("r")).alias("r"),
    )
    return rows.select(
        "pair_id", "chosen_id", "rejected_id", "prompt_turns", rendered(F.col("p")).alias("prompt"),
        rendered(F.col("c")).alias("chosen"), rendered(F.col("r")).alias("rejected"), mask(F.col("c"), F.col("base")).alias("chosen_mask"), mask(F.col("r"), F.col("base")).alias("rejected_mask"),
    )


def paired(turns: DataFrame) -> DataFrame:
    """Preferences of the conversations 2 i (chosen) and 2 i + 1 (rejected), pair_id i. Keys are ids, so a
    first turn that many conversations share makes no large group."""
    found = conversations(turns).withColumn("pair_id", F.floor(F.col("conv_id") / 2).cast("long"))
    even = F.pmod("conv_id", F.lit(2)) == 0
    return preferences(found.where(even), found.where(~even))
