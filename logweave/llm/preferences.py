"""Preference pairs of conversations: the common turns once as prompt, and two completions with masks.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: How a turn is written: the opening with the role in it, and the closing.
OPEN_LEFT, OPEN_RIGHT, CLOSE = "<|", "|>\n", "<|end|>\n"


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns as an array of (turn, role, text) in order.

    Equal turn numbers go by role and text, a null first; null roles and texts become empty. A
    conversation becomes one value, so it must fit a row, as its rendering must.
    """
    part = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return turns.groupBy(F.col(conv_id).alias("conv_id")).agg(F.array_sort(F.collect_list(part)).alias("turns"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN_LEFT), t["role"], F.lit(OPEN_RIGHT), t["text"], F.lit(CLOSE))), "")


def mask(turns: Column, answers: str = "assistant") -> Column:
    """``start:end`` in the rendering of the texts of the answering role (code points, end exclusive), comma-joined."""
    head = len(OPEN_LEFT) + len(OPEN_RIGHT)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(a: Column, t: Column) -> Column:
        start = a["at"] + F.length(t["role"]) + head
        end = start + F.length(t["text"])
        span = F.concat_ws(":", start.cast("string"), end.cast("string"))
        return F.struct((end + len(CLOSE)).alias("at"), F.when(t["role"] == answers, F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, zero, step)["spans"], ",")


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix: turns are equal in role and text."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same).cast("long"))


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected", answers: str = "assistant") -> DataFrame:
    """From ``chosen`` and ``rejected`` (arrays of (role, text) in order; null as empty): n_common (long),
    prompt, chosen_text, rejected_text, chosen_mask, rejected_mask, which replace columns of those names; the
    other columns stay.

    The prompt is the common prefix, rendered once; the completions are the rest of each side, and the
    masks name the characters in them that a loss counts. Equal conversations have empty completions,
    conversations without a common first turn an empty prompt.
    """
    made = ("n_common", "prompt", "chosen_text", "rejected_text", "chosen_mask", "rejected_mask")
    others = [F.col(f"`{c}`") for c in pairs.columns if c not in (chosen, rejected) and c.lower() not in made]
    none = lambda c: F.coalesce(F.col(c), F.expr(f"filter({c}, x -> false)"), F.array().cast(pairs.schema[c].dataType))
    sides = pairs.withColumns({"_a": none(chosen), "_b": none(rejected)}).withColumn("_n", common_turns(F.col("_a"), F.col("_b")))
    rest = lambda c: F.slice(F.col(c), F.col("_n").cast("int") + 1, F.greatest(F.size(c), F.lit(1)))
    return sides.select(
        *others, F.col("_n").alias("n_common"), render(F.slice(F.col("_a"), F.lit(1), F.col("_n").cast("int"))).alias("prompt"),
        render(rest("_a")).alias("chosen_text"), render(rest("_b")).alias("rejected_text"),
        mask(rest("_a"), answers).alias("chosen_mask"), mask(rest("_b"), answers).alias("rejected_mask"),
    )


def pairs_by_next_answer(convs: DataFrame, answers: str = "assistant") -> DataFrame:
    """A pair for each conversation (conv_id, turns): it is chosen, and rejected is the same up to its
    last answer, which is replaced by the last answer of the conversation with the next id.

    Where there is no next one, or one without an answer, the rejected answer is empty. A conversation
    without an answer is its own counterpart. One equi-join on the id, no group of conversations.
    """
    numbers = F.transform(F.col("turns"), lambda t, i: F.when(t["role"] == answers, i + 1).otherwise(0))
    last = F.coalesce(F.array_max(numbers), F.lit(0))
    marked = convs.withColumn("last", last).withColumn("answer", F.get(F.col("turns"), F.col("last") - 1)["text"])
    following = marked.groupBy((F.col("conv_id") - 1).alias("before")).agg(F.min("answer").alias("other"))
    kept = F.slice(F.col("turns"), F.lit(1), F.greatest(F.col("last") - 1, F.lit(0)))
    own = F.get(F.col("turns"), F.col("last") - 1)
    swapped = F.concat(kept, F.array(F.struct(own["turn"].alias("turn"), own["role"].alias("role"), F.coalesce(F.col("other"), F.lit("")).alias("text"))))
    return marked.join(following, F.col("conv_id") == F.col("before"), "left").select(
        "conv_id", F.col("turns").alias("chosen"), F.when(F.col("last") > 0, swapped).otherwise(F.col("turns")).alias("rejected")
    )
