"""Coverage trackers: null is not instantiated, 0 uncovered, more covered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(probes: DataFrame, coverage: DataFrame) -> DataFrame:
    """``count`` of (scope, line, time): that of the line, else the largest positive
    one of the scope at the time, else null."""
    exact = coverage.groupBy("scope", "line", "time").agg(F.max("count").alias("_own"))
    top = coverage.where("count > 0").groupBy("scope", "time").agg(F.max("count").alias("_top"))
    met = probes.join(exact, ["scope", "line", "time"], "left").join(top, ["scope", "time"], "left")
    return met.select(*probes.columns, F.coalesce("_own", "_top").alias("count"))


def three_valued(probes: DataFrame, coverage: DataFrame, dead: DataFrame) -> DataFrame:
    """``count`` by block type: always blocks by line, assigns by what parameters
    leave dead (scope, line), ports 1, no type null."""
    found = lookup(probes, coverage).join(dead.withColumn("_dead", F.lit(True)), ["scope", "line"], "left")
    answer = F.when(F.startswith("btype", F.lit("Always")), F.col("count")).when(F.col("btype") == "Assign", F.when(F.col("_dead"), 0).otherwise(1)).when(F.col("btype").isNotNull(), 1)
    return found.select("scope", "line", "time", "btype", answer.cast("bigint").alias("count"))


def plain(probes: DataFrame) -> DataFrame:
    """The tracker that takes everything as covered."""
    return probes.withColumn("count", F.lit(1).cast("bigint"))


def comb_or_seq(coverage: DataFrame) -> DataFrame:
    """Combinational rows, or the clocked ones if there are no combinational at all."""
    has = coverage.agg(F.coalesce(F.bool_or(F.col("kind") == "comb"), F.lit(False)).alias("_has"))
    return coverage.crossJoin(F.broadcast(has)).where((F.col("kind") == "comb") | ~F.col("_has")).drop("_has")


def single_scope(path: Column, repeated: str) -> Column:
    """A path whose head ``repeated`` stands twice, with it once."""
    return F.when(F.startswith(path, F.lit(repeated * 2)), F.substring(path, len(repeated) + 1, 1 << 30)).otherwise(path)


def live_blocks(block_lines: DataFrame, coverage: DataFrame) -> DataFrame:
    """Rows (bid, scope, btype, line) of blocks that parameters don't make dead: those
    that aren't assigns, are of scopes without data, or have a covered line."""
    modules = coverage.select("scope").distinct().withColumn("_known", F.lit(True))
    alive = coverage.where("count > 0").select("scope", "line").distinct()
    covered = block_lines.join(alive, ["scope", "line"]).select(F.col("bid").alias("_b")).distinct()
    met = block_lines.join(modules, "scope", "left").join(covered, F.col("bid") == F.col("_b"), "left")
    return met.where((F.col("btype") != "Assign") | F.col("_known").isNull() | F.col("_b").isNotNull()).select(*block_lines.columns)


def covered_outputs(outputs: DataFrame, coverage: DataFrame) -> DataFrame:
    """Outputs (scope, line, time, ...) on a line that was executed at the time."""
    return outputs.join(coverage.where("count > 0").select("scope", "line", "time").distinct(), ["scope", "line", "time"], "left_semi")


def covered_files(files: DataFrame, coverage: DataFrame) -> DataFrame:
    """Files with coverage; all of them if there is none."""
    seen = coverage.select("file").distinct()
    if seen.isEmpty():
        return files
    return files.join(seen, "file", "left_semi")
