"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own.

The context of an example is all that precedes the turn in its conversation, rendered turn by turn; only the reply is
trainable: the characters from train_start to train_end of prompt || target. The turns are sorted once by conversation
and the contexts built in one pass of a window; nothing but built-in functions runs.

Defined results: turns are ordered by turn, then role, then text, nulls first, so that ties and repeated rows have one
order (a repeated row is a turn like any other); a null role is rendered as `unknown`, a null text as empty; an
assistant turn with a null or empty text is context of later turns but no example; rows with a null conv_id belong to
no conversation and are left out; an assistant turn that comes first has an empty context; an empty table gives an
empty result. Only the four named columns are read, so that others can have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROLE = "assistant"


def head(role: str = "unknown") -> str:
    return f"<|{role}|>\n"


END = "<|end|>\n"


def expand(turns: DataFrame, conversation="conv_id", turn="turn", role="role", text="text", trained=ROLE) -> DataFrame:
    """(conv_id, turn, context_turns, prompt, target, train_start, train_end) for every trainable reply."""
    clean = turns.where(F.col(conversation).isNotNull()).select(
        F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    by = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text").rowsBetween(W.unboundedPreceding, -1)
    rendered = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit(END))
    return (
        clean.select("conv_id", "turn", "role", "text", F.array_join(F.collect_list(rendered).over(by), "").alias("context"), F.count("*").over(by).alias("context_turns"))
        .where((F.col("role") == trained) & (F.col("text") != ""))
        .select(
            F.col("conv_id").alias(conversation),
            F.col("turn").alias(turn),
            "context_turns",
            F.concat("context", F.lit(head(trained))).alias("prompt"),
            F.concat("text", F.lit(END)).alias("target"),
        )
        .withColumn("train_start", F.length("prompt").cast("long"))
        .withColumn("train_end", (F.length("prompt") + F.length("target")).cast("long"))
    )
