"""Spectrum localization: counters, scores, ranks and lines to blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultspark.functions import suspicion


def sample_times(failed: Column, step: Column, interval: Column) -> Column:
    """Times from the failure back in strides of ``step * interval``, ascending, none negative.

    The stride is kept at one in the divisor only, so a stride of zero gives
    the failure time again and again."""
    stride = step * interval
    count = F.floor(failed / F.greatest(stride, F.lit(1))).cast("int")
    times = F.transform(F.reverse(F.sequence(F.lit(0), count)), lambda i: failed - stride * i)
    return F.filter(times, lambda t: t >= 0)


def test_results(times: DataFrame, scope: str = "scope", time: str = "time", last_passes: bool = True) -> DataFrame:
    """(scope, test_id, failed) of sampled times: the last one is told from the others.

    Published runs mark the last sample as the one that passes; with
    ``last_passes`` off it is the one that fails."""
    last = F.max(time).over(Window.partitionBy(scope))
    is_last = F.col(time) == last
    return times.select(scope, F.col(time).alias("test_id"), (~is_last if last_passes else is_last).alias("failed"))


def counters(spectrum: DataFrame, tests: DataFrame) -> DataFrame:
    """a_ef, a_ep, a_nf and a_np of each (scope, line).

    ``spectrum`` (test_id, scope, line) has the executed statements, once each;
    ``tests`` (test_id, failed) all tests. One shuffle joins the outcomes, and
    the counts are summed on the map side; totals of tests are two numbers."""
    totals = tests.agg(F.count_if(F.col("failed")).alias("_f"), F.count_if(~F.col("failed")).alias("_p"))
    hit = spectrum.join(tests, "test_id").groupBy("scope", "line").agg(F.count_if(F.col("failed")).alias("a_ef"), F.count_if(~F.col("failed")).alias("a_ep"))
    return hit.crossJoin(F.broadcast(totals)).select("scope", "line", "a_ef", "a_ep", (F.col("_f") - F.col("a_ef")).alias("a_nf"), (F.col("_p") - F.col("a_ep")).alias("a_np"))


def scored(counts: DataFrame, metric: str) -> DataFrame:
    return counts.select("scope", "line", suspicion.score(metric).alias("score"))


def rank_in_scope(scores: DataFrame) -> DataFrame:
    """Rank by score within a scope; ties go to the smaller line."""
    order = Window.partitionBy("scope").orderBy(F.desc("score"), "line")
    return scores.withColumn("rank", F.row_number().over(order).cast("bigint"))


def rank_globally(scores: DataFrame) -> DataFrame:
    """Rank by (score descending, scope, line) over all scopes.

    Rows are numbered within their (score, scope); only the table of those
    cells, with its running counts, is put in one order."""
    cells = scores.groupBy(F.col("score").alias("_s"), F.col("scope").alias("_c")).agg(F.count("*").alias("_n"))
    before = Window.orderBy(F.desc("_s"), "_c").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("_s", "_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = scores.withColumn("_k", F.row_number().over(Window.partitionBy("score", "scope").orderBy("line")))
    joined = rows.join(cells, (F.col("score") == F.col("_s")) & (F.col("scope") == F.col("_c")))
    return joined.select("scope", "line", "score", (F.col("_before") + F.col("_k")).cast("bigint").alias("rank"))


def top(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "scope", "line").limit(k)


def block_lines(blocks: DataFrame) -> DataFrame:
    """(scope, line, bid) of every line of blocks (bid, scope, lo, hi); a block with lo above hi has none."""
    return blocks.where("lo <= hi").select("scope", F.explode(F.sequence("lo", "hi")).alias("line"), "bid")


def lines_to_blocks(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """The first block, by bid, that holds each line; lines in none are dropped.

    The range join is an equi-join on the blocks' lines. Spark's estimate of
    their size is that of the blocks, so without the hint it would broadcast
    lines that are far larger."""
    first = block_lines(blocks).groupBy("scope", "line").agg(F.min("bid").alias("bid"))
    return lines.join(first.hint("merge"), ["scope", "line"])


def block_bounds(lines: DataFrame) -> DataFrame:
    """Smallest and largest line per block; 0 for a block without lines."""
    return lines.groupBy("bid").agg(F.coalesce(F.min("line"), F.lit(0)).alias("lo"), F.coalesce(F.max("line"), F.lit(0)).alias("hi"))


def max_line(lines: DataFrame) -> DataFrame:
    return lines.groupBy("scope").agg(F.max("line").alias("max_line"))


def localize(spectrum: DataFrame, tests: DataFrame, blocks: DataFrame, metric: str = "ochiai", k: int = 10) -> DataFrame:
    """The k most suspicious statements that lie in a block: scope, line, score, bid."""
    return top(lines_to_blocks(scored(counters(spectrum, tests), metric), blocks), k)
