"""The commands of the library as functions of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultspark.operators import evaluate as evaluation
from faultspark.operators import mutate, navigate, slicing, spectrum
from faultspark.sources import logs, rtl


def localize(rows: DataFrame, top: str, coverage: DataFrame, signal: str, time: int, scope: str | None = None, step: int = 1, bound: int | None = None, chooser=navigate.mark_all, limit: int = 1000) -> list[tuple[int, float]]:
    """Suspicious blocks of a design, walking back from a signal at a time.

    ``rows`` are those of ``rtl.read_rtl``. The slice is cut at ``limit`` rows,
    collected, and walked by the chooser; a block's score falls with its rank."""
    scopes = rtl.elaborate(rows, top)
    blocks = rtl.scope_blocks(rows, scopes)
    flow = rtl.scope_flow(rows, blocks)
    start = rows.sparkSession.createDataFrame([(scope or top, signal, time)], "scope string, signal string, time bigint")
    found = slicing.dynamic_slice(flow, coverage, start, step, bound)
    drivers = flow.groupBy("bid").agg(F.array_sort(F.collect_set("src")).alias("srcs"), F.min("out").alias("target"))
    met = found.join(blocks.select("bid", "module", "scope", "btype", "text"), "bid").join(drivers, "bid", "left")
    trace = [navigate.Block(r.bid, r.module, r.scope, r.btype, r.text, r.target or "", tuple((s, r.time) for s in r.srcs or ())) for r in met.orderBy("level", "bid", "time").limit(limit).collect()]
    marked = navigate.walk(trace, chooser, own_first=True)
    return [(bid, 1.0 / (k + 1)) for k, bid in enumerate(marked)]


def spectrum_localize(executed: DataFrame, tests: DataFrame, blocks: DataFrame, metric: str = "ochiai", k: int = 10) -> DataFrame:
    return spectrum.localize(executed, tests, blocks, metric, k)


def evaluate(predictions: DataFrame, truth: DataFrame, match: tuple = ("module", "block_id"), ties: tuple = ()) -> DataFrame:
    """Top-1, 5, 10 and any hits over all of the truth."""
    return evaluation.top_counts(evaluation.hits(truth, evaluation.ranked(predictions, ties=list(ties)), list(match)))


def lines_to_blocks(choices: DataFrame, block_lines: DataFrame) -> DataFrame:
    """Choices (bug_id, module, line) with the first block of the module that has the line."""
    first = block_lines.groupBy("module", "line").agg(F.min("bid").alias("block_id"))
    return choices.join(first, ["module", "line"], "left")


def validate(diffs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Number of bugs by status, from diffs (bug_id, diff) and block texts (bug_id, ctx)."""
    lines = diffs.select("bug_id", logs.first_added(F.col("diff")).alias("line"))
    return mutate.validate(lines, blocks).groupBy("status").agg(F.count("*").alias("n"))


def test_report(lines: DataFrame, trace: DataFrame, step: int, keys: tuple = ("bug_id",)) -> DataFrame:
    """Per bug the report, start time and bound, from its log and its instruction trace."""
    told = logs.mismatch_report(lines, list(keys), "at")
    last = logs.trace_context(trace, list(keys), "at")
    by = last.groupBy(*keys).agg(F.max(F.when(F.col("back") == 1, F.col("instruction"))).alias("now"), F.max(F.when(F.col("back") == 2, F.col("instruction"))).alias("before"))
    joined = told.join(by, list(keys), "left")
    said = F.when(F.col("kind") == "Pc", F.coalesce("before", "now")).otherwise(F.col("now"))
    start = logs.start_time(F.col("failure_time"), F.lit(step))
    return joined.select(*keys, "kind", start.alias("start_time"), logs.time_bound(start, F.lit(step)).alias("time_bound"), logs.report_text(F.col("kind"), said, F.col("dut"), F.col("oracle")).alias("test_info"))


def naive_localize(files: list[str], decide, score, sources: dict[str, str], k: int = 10) -> list[tuple[str, int, float]]:
    """Lines of the files that ``decide`` picks from a directory tree, as ``score`` sees them.

    ``decide`` maps the tree to file names, ``score`` a source to pairs of a line's
    text and a score; a text counts for its first equal line, others are dropped.
    Returns (file, line, score), best first."""
    found = []
    for name in decide(navigate.tree(files)):
        lines = [x.strip() for x in sources.get(name, "").split("\n")]
        for text, value in score(sources.get(name, "")):
            if text.strip() in lines:
                found.append((name, lines.index(text.strip()) + 1, value))
    return sorted(found, key=lambda x: (-x[2], x[0], x[1]))[:k]


def mutations(sites: DataFrame, seed: int = 0) -> DataFrame:
    """Replacements of ``rtl.read_mutation_sites``, one per site, drawn by a hash of the seed and the place."""
    draw = F.pmod(F.xxhash64("module", "at", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    new = F.when(F.col("kind") == "operator", mutate.mutated(F.col("token"))).otherwise(mutate.constant(F.col("token"), draw))
    return sites.withColumn("replacement", new).where("replacement IS NOT NULL AND replacement <> token")
