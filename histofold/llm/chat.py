"""Preference formatting: the longest common turn prefix once as prompt, two masked completions.

``turns`` are long rows (conversation, position, role, text); ``pairs`` names a chosen and a
rejected conversation.  The turns of a conversation are gathered in order, the prompt is the
longest run of leading turns equal in role and text, rendered once; what follows in each
conversation is its completion, with the character spans of the assistant's content as loss
mask (everything else -- prompt, other roles, markers -- is masked).

Only (pair, conversation) keys and the turns are shuffled; a conversation named by many pairs
is joined to them where Spark splits skewed partitions.

Defined cases: turns without conversation are ignored, null role reads as ``user``, null text
as empty; turns at the same position follow by role, then text, repeated rows each; a pair
with a missing conversation, or with an empty one, keeps an empty completion there; equal
conversations give empty completions; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOSE = "<|end|>\n"


def conversations(turns: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """(conv, turns): one row per conversation, its turns as an ordered array of (role, text)."""
    t = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("conv"),
        F.struct(F.col(order_col).alias("at"), F.coalesce(F.col(role_col), F.lit("user")).alias("role"),
                 F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    ordered = F.transform(F.array_sort(F.collect_list("t")), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return t.groupBy("conv").agg(ordered.alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that are equal in role and text."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def _head(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t["role"]), t["text"], F.lit("\n" + CLOSE))), "")


def trained(turns: Column, role: str = "assistant") -> Column:
    """Character spans (start, end) of the contents of ``role`` in the rendered turns."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc, t):
        start = (acc["at"] + F.length(_head(t["role"]))).cast("long")
        end = (start + F.length(t["text"])).cast("long")
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + F.lit(len(CLOSE) + 1)).cast("long").alias("at"),
                        F.when(t["role"] == role, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def preferences(turns: DataFrame, pairs: DataFrame, chosen_col: str = "chosen", rejected_col: str = "rejected",
                rejected_turns: DataFrame | None = None, **names: str) -> DataFrame:
    """(chosen_id, rejected_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask) per pair.

    ``rejected_turns``: where the rejected conversations are kept apart from the chosen ones.
    """
    good = conversations(turns, **names)
    bad = good if rejected_turns is None else conversations(rejected_turns, **names)
    p = pairs.select(F.col(chosen_col).alias("chosen_id"), F.col(rejected_col).alias("rejected_id"))
    none = F.array().cast("array<struct<role:string,text:string>>")
    both = (p.join(good.select(F.col("conv").alias("chosen_id"), F.col("turns").alias("a")), "chosen_id", "left")
            .join(bad.select(F.col("conv").alias("rejected_id"), F.col("turns").alias("b")), "rejected_id", "left")
            .withColumns({"a": F.coalesce("a", none), "b": F.coalesce("b", none)}))
    both = both.withColumn("k", common_prefix(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(c, F.col("k") + 1, F.greatest(F.size(c) - F.col("k"), F.lit(0)))
    cut = both.select("chosen_id", "rejected_id", F.col("k").cast("long").alias("prompt_turns"),
                      F.slice("a", F.lit(1), F.col("k")).alias("p"), rest("a").alias("a"), rest("b").alias("b"))
    return cut.select("chosen_id", "rejected_id", "prompt_turns", rendered(F.col("p")).alias("prompt"),
                      rendered(F.col("a")).alias("chosen"), rendered(F.col("b")).alias("rejected"),
                      trained(F.col("a")).alias("chosen_mask"), trained(F.col("b")).alias("rejected_mask"))
