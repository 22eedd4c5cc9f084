"""JSON inputs and outputs: parameter trees, results, oracles and traces."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RESULT = "bug_id string, token_usage struct<input_tokens:bigint,output_tokens:bigint,total_tokens:bigint>, token_price double, choices array<struct<module_name:string,line_number:bigint,block_id:bigint,score:double>>"
ORACLE = "bid bigint, module_name string, scope_name string, description string, bug_file string"


def location(loc: str) -> range:
    """Lines of ``file,l1:c1,l2:c2``; any other form is an error."""
    _, first, last = loc.split(",")
    return range(int(first.split(":")[0]), int(last.split(":")[0]) + 1)


def parameter_lines(tree: str) -> list[tuple[str, int]]:
    """(module, line) of the assigned lines of a parameter tree; dead modules have none."""
    found = set()

    def walk(module: str, node) -> None:
        if isinstance(node, list):
            for x in node:
                walk(module, x)
        elif isinstance(node, dict):
            if node.get("type") in ("ASSIGN", "ASSIGNW"):
                for left in node.get("lhsp", []):
                    found.update((module, n) for n in location(left["loc"]))
            for value in node.values():
                if isinstance(value, list):
                    walk(module, value)

    for module in json.loads(tree).get("modulesp", []):
        if module.get("type") == "MODULE" and not module.get("dead"):
            for value in module.values():
                if isinstance(value, list):
                    walk(module.get("origName"), value)
    return sorted(found)


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """(module, line) of parameter trees, one file at a time in a task."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            for content in batch.content:
                yield pd.DataFrame(parameter_lines(bytes(content).decode()), columns=["module", "line"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "module string, line int").distinct()


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT).option("multiLine", True).json(path)


def choices(results: DataFrame) -> DataFrame:
    """One row per choice: bug_id, at, module_name, line_number, block_id, score."""
    return results.select("bug_id", F.posexplode("choices").alias("at", "c")).select("bug_id", "at", "c.*")


def read_oracles(spark: SparkSession, root: str) -> DataFrame:
    """Oracles of ``<root>/<bug>/oracle_info.json`` with their bug_id; ``init`` is skipped."""
    rows = spark.read.schema(ORACLE).option("multiLine", True).json(f"{root}/*/oracle_info.json")
    bug = F.regexp_extract(F.input_file_name(), r"/([^/]+)/oracle_info\.json$", 1)
    return rows.withColumn("bug_id", bug).where("bug_id <> 'init'")


def latest_result_paths(paths: DataFrame, prefix: str) -> DataFrame:
    """Of paths ``.../<bug>/<prefix>_<n>/...`` those of the highest n of each bug."""
    pattern = rf"/([^/]+)/{prefix}_(\d+)(?:/|$)"
    keyed = paths.where(F.col("path").rlike(pattern)).withColumns({"bug_id": F.regexp_extract("path", pattern, 1), "n": F.regexp_extract("path", pattern, 2).cast("bigint")})
    order = Window.partitionBy("bug_id").orderBy(F.desc("n"))
    return keyed.withColumn("_k", F.rank().over(order)).where("_k = 1").drop("_k")


def in_slice(column: str = "n", first: int = 0, last: int | None = None):
    """Whether a row, numbered from 0 in ``column``, is in the slice [first, last)."""
    upper = F.lit(True) if last is None else F.col(column) < last
    return (F.col(column) >= first) & upper


# Sinks


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_trace(trace: DataFrame, path: str) -> None:
    """Rows of a trace, in order of ``seq``."""
    trace.orderBy("seq").select("bid", "scope", "type", "time", "suspicious_outputs", "suspicious_input_vars_with_time").write.mode("overwrite").json(path)


def block_sizes(blocks: DataFrame) -> DataFrame:
    """bid, scope, btype and number of lines of a block's text."""
    kind = F.when(F.col("btype") == "AlwaysSeq", F.to_json(F.struct(F.lit("SEQ").alias("Always")))).when(F.col("btype") == "AlwaysComb", F.to_json(F.struct(F.lit("COMB").alias("Always")))).otherwise(F.col("btype"))
    return blocks.select("bid", "scope", kind.alias("btype"), F.size(F.split("text", "\n")).alias("block_size"))


def write_results(choices_: DataFrame, path: str) -> None:
    """One result per bug with its choices in order of ``rank``."""
    said = F.struct("rank", "module_name", "line_number", "block_id", "score")
    grouped = choices_.groupBy("bug_id").agg(F.array_sort(F.collect_list(said)).alias("c"))
    grouped.select("bug_id", F.transform("c", lambda x: F.struct(x["module_name"].alias("module_name"), x["line_number"].alias("line_number"), x["block_id"].alias("block_id"), x["score"].alias("score"))).alias("choices")).write.mode("overwrite").json(path)


def write_oracles(oracles: DataFrame, path: str) -> None:
    oracles.write.mode("overwrite").partitionBy("bug_id").json(path)


def write_signal_map(maps: DataFrame, path: str) -> None:
    maps.write.mode("overwrite").json(path)
