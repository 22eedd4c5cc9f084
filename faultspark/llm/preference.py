"""Preference pairs as one prompt and two masked completions.

The longest common turn prefix of a chosen and a rejected conversation is
rendered once, as the prompt; what is left of each is its completion. A
completion's mask is the spans of characters to train on: what the assistant
said, with the mark that ends its turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultspark.llm import work

END = "<|end|>\n"
TRAINED = "assistant"


def _safe(text: Column) -> Column:
    """Text that cannot be read as a mark."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), _safe(turn["role"]), F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(_safe(turn["text"]), F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def spans(turns: Column) -> Column:
    """Array of (start, length) of the trained parts of rendered turns."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("found"))

    def step(acc: Column, t: Column) -> Column:
        start = (acc["at"] + F.char_length(_head(t))).cast("bigint")
        size = F.char_length(_body(t)).cast("bigint")
        one = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct((start + size).alias("at"), F.when(t["role"] == TRAINED, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(turns, zero, step, lambda acc: acc["found"])


def common(a: Column, b: Column) -> Column:
    """Number of leading turns that two conversations share."""
    least = F.least(F.size(a), F.size(b))
    unlike = F.filter(F.sequence(F.lit(0), least), lambda i: (i == least) | ~F.get(a, i).eqNullSafe(F.get(b, i)))
    return F.array_min(unlike).cast("bigint")


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Adds n_common, prompt, chosen_completion, rejected_completion and their masks.

    Conversations are arrays of (role, text); a null array has no turns, and a
    null role or text counts as empty. Equal conversations are all prompt, with
    two empty completions. Other columns pass through; of columns with the new
    names, the new ones stay."""
    blank = F.array().cast("array<struct<role:string,text:string>>")

    def clean(c: str) -> Column:
        turns = F.coalesce(F.col(c).cast("array<struct<role:string,text:string>>"), blank)
        return F.transform(turns, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))

    own = pairs.withColumns({"_a": clean(chosen), "_b": clean(rejected)}).withColumn("_n", common(F.col("_a"), F.col("_b")))
    rest = lambda c: F.slice(c, F.col("_n").cast("int") + 1, F.greatest(F.size(c), F.lit(1)))
    own = own.withColumns({"_p": F.slice("_a", F.lit(1), F.col("_n").cast("int")), "_c": rest(F.col("_a")), "_r": rest(F.col("_b"))})
    new = {
        "n_common": F.col("_n"),
        "prompt": render(F.col("_p")),
        "chosen_completion": render(F.col("_c")),
        "rejected_completion": render(F.col("_r")),
        "chosen_mask": spans(F.col("_c")),
        "rejected_mask": spans(F.col("_r")),
    }
    return own.withColumns(new).drop("_a", "_b", "_n", "_p", "_c", "_r")


def reply_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected) of a table of turns.

    Chosen is a conversation up to its last assistant turn; rejected is the
    same with that turn's text replaced by the last assistant text of the
    conversation beside it (2k and 2k + 1; empty if there is none). Without an
    assistant turn both are the whole conversation. Turns are in order of
    (turn, role, text), nulls first; rows without a conv_id are one
    conversation with no neighbour."""
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.select("conv_id", "turn", "role", "text").groupBy("conv_id").agg(F.sort_array(F.collect_list(said)).alias("turns"))
    spoken = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: F.get(F.col("turns"), i)["role"] == TRAINED)
    whole = whole.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"), (F.coalesce(F.array_max(spoken), F.lit(-1)) + 1).alias("last"))
    whole = work.cut(whole.withColumn("reply", F.when(F.col("last") > 0, F.get(F.col("turns"), F.col("last") - 1)["text"])), "whole")
    beside = whole.select((F.col("conv_id").bitwiseXOR(F.lit(1).cast("bigint"))).alias("beside"), F.col("reply").alias("other"))
    both = whole.join(beside, F.col("conv_id") == F.col("beside"), "left")
    swapped = F.array(F.struct(F.lit(TRAINED).alias("role"), F.coalesce("other", F.lit("")).alias("text")))
    spoken = F.col("last") > 0
    return both.select(
        "conv_id",
        F.when(spoken, F.slice("turns", F.lit(1), F.col("last"))).otherwise(F.col("turns")).alias("chosen"),
        F.when(spoken, F.concat(F.slice("turns", F.lit(1), F.greatest(F.col("last") - 1, F.lit(0))), swapped)).otherwise(F.col("turns")).alias("rejected"),
    )


def op6_preference(spark, sf_dir: str) -> DataFrame:
    done = format_pairs(reply_pairs(work.read(spark, sf_dir, "conversations")))
    flat = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("+", s["start"].cast("string"), s["length"].cast("string"))), ",")
    return done.select("conv_id", "n_common", "prompt", F.col("chosen_completion").alias("chosen"), F.col("rejected_completion").alias("rejected"), flat("chosen_mask").alias("chosen_mask"), flat("rejected_mask").alias("rejected_mask"))


OP6_SQL = """
WITH s AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
         coalesce(role, '') AS role, coalesce(text, '') AS txt FROM conversations),
l AS (SELECT conv_id, count(*) AS n, coalesce(max(k) FILTER (WHERE role = 'assistant'), 0) AS la FROM s GROUP BY conv_id),
r AS (SELECT l.conv_id, l.n, l.la, s.txt AS reply FROM l LEFT JOIN s ON s.conv_id = l.conv_id AND s.k = l.la),
p AS (SELECT r.conv_id, r.n, r.la, r.reply, coalesce(o.reply, '') AS other FROM r LEFT JOIN r o ON o.conv_id = xor(r.conv_id, 1)),
c AS (SELECT *, CASE WHEN la = 0 THEN n WHEN reply = other THEN la ELSE la - 1 END AS n_common,
             la > 0 AND reply <> other AS differ,
             replace(coalesce(reply, ''), '<|', '< |') || '<|end|>' || chr(10) AS a, replace(other, '<|', '< |') || '<|end|>' || chr(10) AS b FROM p),
t AS (SELECT c.conv_id, string_agg('<|' || replace(s.role, '<|', '< |') || '|>' || chr(10) || replace(s.txt, '<|', '< |') || '<|end|>' || chr(10), '' ORDER BY s.k) AS prompt
      FROM c JOIN s ON s.conv_id = c.conv_id AND s.k <= c.n_common GROUP BY c.conv_id)
SELECT c.conv_id, c.n_common::BIGINT AS n_common, coalesce(t.prompt, '') AS prompt,
       CASE WHEN differ THEN '<|assistant|>' || chr(10) || a ELSE '' END AS chosen,
       CASE WHEN differ THEN '<|assistant|>' || chr(10) || b ELSE '' END AS rejected,
       CASE WHEN differ THEN '14+' || length(a) ELSE '' END AS chosen_mask,
       CASE WHEN differ THEN '14+' || length(b) ELSE '' END AS rejected_mask
FROM c LEFT JOIN t ON t.conv_id = c.conv_id
"""
