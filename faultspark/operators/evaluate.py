"""Predictions against the truth, runs, votes and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Dollars per million input and output tokens, by model.
PRICES = {
    "gpt-4.1": (2.00, 8.00),
    "gpt-4.1-mini": (0.40, 1.60),
    "gpt-4.1-nano": (0.10, 0.40),
    "gpt-4o": (2.50, 10.00),
    "gpt-4o-2024-05-13": (5.00, 15.00),
    "gpt-4o-mini": (0.15, 0.60),
    "chatgpt-4o-latest": (5.00, 15.00),
    "gpt-4-turbo-2024-04-09": (10.00, 30.00),
    "gpt-4-0125-preview": (10.00, 30.00),
    "gpt-4-1106-preview": (10.00, 30.00),
    "gpt-4-0613": (30.00, 60.00),
    "gpt-4-0314": (30.00, 60.00),
    "gpt-4-32k": (60.00, 120.00),
    "gpt-3.5-turbo": (0.50, 1.50),
    "gpt-3.5-turbo-0125": (0.50, 1.50),
    "gpt-3.5-turbo-1106": (1.00, 2.00),
    "gpt-3.5-turbo-0613": (1.50, 2.00),
    "gpt-3.5-0301": (1.50, 2.00),
    "gpt-3.5-turbo-instruct": (1.50, 2.00),
    "gpt-3.5-turbo-16k-0613": (3.00, 4.00),
    "gpt-realtime": (4.00, 16.00),
    "gpt-audio": (2.50, 10.00),
    "o1": (15.00, 60.00),
    "o1-pro": (150.00, 600.00),
    "o3-pro": (20.00, 80.00),
    "o3": (2.00, 8.00),
    "o3-deep-research": (10.00, 40.00),
    "o4-mini": (1.10, 4.40),
    "o4-mini-deep-research": (2.00, 8.00),
    "o3-mini": (1.10, 4.40),
    "o1-mini": (1.10, 4.40),
    "claude-haiku-4-5": (1.0, 5.0),
    "claude-haiku-4-5-20251001": (1.0, 5.0),
    "claude-sonnet-4-5": (3.0, 15.0),
    "claude-sonnet-4-5-20250929": (3.0, 15.0),
    "claude-opus-4-1-20250805": (15.0, 75.0),
    "claude-opus-4-0": (15.0, 75.0),
    "claude-opus-4-20250514": (15.0, 75.0),
    "claude-sonnet-4-0": (3.0, 15.0),
    "claude-sonnet-4-20250514": (3.0, 15.0),
    "claude-3-7-sonnet-20250219": (3.0, 15.0),
    "claude-3-7-sonnet-latest": (3.0, 15.0),
    "claude-3-5-haiku-20241022": (1.0, 5.0),
    "claude-3-5-haiku-latest": (1.0, 5.0),
    "claude-3-5-sonnet-20241022": (3.0, 15.0),
    "claude-3-5-sonnet-latest": (3.0, 15.0),
    "claude-3-5-sonnet-20240620": (3.0, 15.0),
    "claude-3-haiku-20240307": (0.25, 1.25),
    "claude-3-opus-20240229": (15.0, 75.0),
    "claude-3-opus-latest": (15.0, 75.0),
    "claude-3-sonnet-20240229": (3.0, 15.0),
}


def token_price(model: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """Dollars for a number of tokens; null for an unknown model."""
    rate = lambda k: F.create_map(*(x for m, p in PRICES.items() for x in (F.lit(m), F.lit(p[k]))))[F.trim(model)]
    return rate(0) * input_tokens / 1_000_000.0 + rate(1) * output_tokens / 1_000_000.0


def ranked(predictions: DataFrame, bug: str = "bug_id", score: str = "score", ties: list[str] | None = None) -> DataFrame:
    """Choices with their rank by score, null scores last."""
    order = Window.partitionBy(bug).orderBy(F.desc_nulls_last(score), *(ties or []))
    return predictions.withColumn("rank", F.row_number().over(order).cast("bigint"))


def hits(truth: DataFrame, predictions: DataFrame, match: list[str], bug: str = "bug_id") -> DataFrame:
    """(bug, rank): the best rank of a choice that is the true one, or null.

    ``predictions`` are ranked. A truth without a block id matches by the rest."""
    wanted = truth.select(bug, *(F.col(c).alias("_" + c) for c in match))
    right = F.lit(True)
    for c in match:
        same = F.col("_" + c) == F.col(c)
        right = right & (F.col("_" + c).isNull() | same if c == match[-1] and len(match) > 1 else same)
    return wanted.join(predictions, bug, "left").groupBy(bug).agg(F.min(F.when(right, F.col("rank"))).alias("rank"))


def top_counts(found: DataFrame, tops: tuple = (1, 5, 10)) -> DataFrame:
    """Hits within the tops and at all, and their share of the truth, as one row."""
    total = F.count("*")
    counts = {f"top{k}": F.count_if(F.col("rank") <= k) for k in tops} | {"top_any": F.count("rank")}
    return found.agg(total.alias("bugs"), *(c.alias(n) for n, c in counts.items()))


def cost(found: DataFrame, usage: DataFrame, bug: str = "bug_id") -> DataFrame:
    """Mean tokens and price of the bugs that were hit first; null without any."""
    first = found.where("rank = 1").join(usage, bug)
    return first.agg(F.count("*").alias("hits"), F.avg("tokens").alias("avg_tokens"), F.avg("price").alias("avg_price"))


def trace_tops(traces: DataFrame, truth: DataFrame, most: int = 10) -> DataFrame:
    """(k, hits): bugs whose block is among the last k rows of their trace.

    ``traces`` (bug_id, seq, block_id), ``truth`` (bug_id, block_id)."""
    order = Window.partitionBy("bug_id").orderBy(F.desc("seq"))
    rows = traces.withColumn("back", F.row_number().over(order)).where(F.col("back") <= most)
    best = rows.join(truth.select("bug_id", F.col("block_id").alias("_b")), "bug_id").where("block_id = _b").groupBy("bug_id").agg(F.min("back").alias("back"))
    ks = traces.sparkSession.range(1, most + 1).select(F.col("id").alias("k"))
    counts = best.groupBy(F.col("back").cast("bigint").alias("k")).agg(F.count("*").alias("n"))
    running = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return ks.join(F.broadcast(counts), "k", "left").select("k", F.sum(F.coalesce("n", F.lit(0))).over(running).alias("hits"))


def trace_summary(traces: DataFrame, truth: DataFrame) -> DataFrame:
    """Number of bugs, hits of block anywhere in the trace, and the mean length of traces."""
    rows = truth.select("bug_id", F.col("block_id").alias("_b")).join(traces, "bug_id", "left")
    each = rows.groupBy("bug_id").agg(F.coalesce(F.bool_or(F.col("block_id") == F.col("_b")), F.lit(False)).alias("hit"), F.count("block_id").alias("size"))
    return each.agg(F.count("*").alias("bugs"), F.count_if(F.col("hit")).alias("hits"), F.avg("size").alias("avg_size"))


def latest_runs(runs: DataFrame, bug: str, number: str, ties: list[str]) -> DataFrame:
    """Of each bug the run with the highest number."""
    order = Window.partitionBy(bug).orderBy(F.desc(number), *ties)
    return runs.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(window)).where("_k = 1").drop("_k")


def top_items(items: DataFrame, item: str, k: int) -> DataFrame:
    """The k most frequent items, ties to the smaller item."""
    return items.groupBy(item).agg(F.count("*").alias("n")).orderBy(F.desc("n"), item).limit(k)


def vote(votes: DataFrame, keys: list[str]) -> DataFrame:
    """Of (keys, dive, suspicious, terminate): not to dive takes over half of the
    votes, suspicion half, an end over half."""
    share = lambda c: F.avg(c.cast("double"))
    return votes.groupBy(*keys).agg((share(~F.col("dive")) > 0.5).alias("skip"), (share(F.col("suspicious")) >= 0.5).alias("suspicious"), (share(F.col("terminate")) > 0.5).alias("terminate"))


def drop_earlier(items: Column) -> Column:
    """Of an ordered array of (name, time), without those that follow the same name at a later time."""
    empty = F.slice(items, 1, 0)
    return F.aggregate(items, empty, lambda acc, x: F.when(F.exists(acc, lambda a: (a["name"] == x["name"]) & (x["time"] < a["time"])), acc).otherwise(F.concat(acc, F.array(x))))


def pick_signals(chosen: DataFrame, drivers: DataFrame, keys: list[str]) -> DataFrame:
    """Chosen (name, time) matched to drivers: exactly, else by name alone; indices are cut off."""
    base = F.substring_index("name", "[", 1)
    asked = chosen.withColumn("name", base)
    exact = asked.join(drivers.select(*keys, "name", "time").distinct(), [*keys, "name", "time"])
    rest = asked.join(exact.select(*keys, "name", "time"), [*keys, "name", "time"], "left_anti").drop("time")
    return exact.select(*keys, "name", "time").unionByName(rest.join(drivers.select(*keys, "name", "time").distinct(), [*keys, "name"]).select(*keys, "name", "time")).distinct()
