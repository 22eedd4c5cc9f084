"""Lookups of code blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ports(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("btype").isin("ModuleInput", "ModuleOutput"))


def of_scope(blocks: DataFrame, scope: str) -> DataFrame:
    return blocks.where(F.col("scope") == scope)


def by_id(blocks: DataFrame, bid: int) -> DataFrame:
    return blocks.where(F.col("bid") == bid)


def first_driver(outputs: DataFrame) -> DataFrame:
    """The first block, by bid, that computes each signal of a scope."""
    return outputs.groupBy("signal", "scope").agg(F.min("bid").alias("bid"))


def descendants(tops: DataFrame, paths: DataFrame, strict: bool = False) -> DataFrame:
    """(top, path) of paths that start with a top and are longer.

    Loosely, by characters, so that ``x.alu`` has ``x.alu2`` below it too; with
    ``strict`` only whole segments count. Both ways are equi-joins: on prefixes
    of whole segments, or on those and the prefixes of the next segment."""
    parts = F.split("path", r"\.")
    whole = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    loose = F.transform(F.sequence(F.lit(1), F.char_length("path")), lambda i: F.substring(F.col("path"), F.lit(1), i))
    keyed = paths.select("path", F.explode(F.array_distinct(whole if strict else loose)).alias("top")).where("top <> path")
    return tops.join(keyed, "top").select("top", "path")


def by_offset(places: DataFrame, ranges: DataFrame, width: int) -> DataFrame:
    """(place, bid) of places that lie in exactly one range (bid, at, len).

    Ranges are dealt to buckets of ``width`` offsets, so the range join is an
    equi-join on the bucket and a filter."""
    cells = ranges.where("len > 0").select("bid", "at", "len", F.explode(F.sequence(F.floor(F.col("at") / width), F.floor((F.col("at") + F.col("len") - 1) / width))).alias("cell"))
    keyed = places.withColumn("cell", F.floor(F.col("place") / width))
    met = keyed.join(cells, "cell").where("place >= at AND place < at + len")
    return met.groupBy("place").agg(F.min("bid").alias("bid"), F.count("*").alias("n")).where("n = 1").drop("n")


def merge(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """Blocks (bid, inputs, outputs, ctx) merged by label (node, label): the
    smallest bid stays, with the union of signals and the texts in order."""
    named = blocks.join(labels, F.col("bid") == F.col("node"), "left").withColumn("_to", F.coalesce("label", "bid"))
    united = named.groupBy(F.col("_to").alias("bid")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("inputs")))).alias("inputs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("outputs")))).alias("outputs"),
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("bid").alias("b"), F.col("ctx").alias("c")))), lambda x: x["c"]).alias("ctx"),
    )
    return united


def heavy_pairs(lines: DataFrame, least: float) -> DataFrame:
    """(a, b): neighbouring parts of an order that both have at least that quantity."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = lines.select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(order).alias("b"), F.col("l_quantity").alias("q"), F.lead("l_quantity").over(order).alias("r"))
    return rows.where((F.col("q") >= least) & (F.col("r") >= least) & (F.col("a") != F.col("b"))).select("a", "b").distinct()


def canonical_signals(rows: DataFrame, name_map: DataFrame, suffix) -> DataFrame:
    """``canonical`` of (module, port): the map's entry for the module, else the
    smallest of any module, else ``suffix`` of the port."""
    exact = name_map.select("module", "port", F.col("canonical").alias("_own"))
    any_module = name_map.groupBy("port").agg(F.min("canonical").alias("_any"))
    return rows.join(exact, ["module", "port"], "left").join(any_module, "port", "left").withColumn("canonical", F.coalesce("_own", "_any", suffix)).drop("_own", "_any")


def bind_ports(ports_: DataFrame, connections: DataFrame) -> DataFrame:
    """(scope, port, signal): connections by the exact port text, else by suffix."""
    exact = ports_.join(connections.select("scope", "port", F.col("signal").alias("_s")), ["scope", "port"], "left")
    tail = connections.groupBy("scope", F.substring_index("port", "_", -2).alias("_tail")).agg(F.min("signal").alias("_t"))
    return exact.withColumn("_tail", F.substring_index("port", "_", -2)).join(tail, ["scope", "_tail"], "left").select("scope", "port", F.coalesce("_s", "_t").alias("signal"))


def suffix_search(asked: DataFrame, signals: DataFrame, least: int = 4) -> DataFrame:
    """(name, signal, scope): of the signals whose name ends in a name of ``least``
    or more characters the first by scope and signal.

    An ending is an equi-join on the signals' suffixes."""
    ends = F.transform(F.sequence(F.lit(1), F.char_length("signal")), lambda i: F.substring(F.col("signal"), i, F.char_length("signal")))
    keyed = signals.select("scope", "signal", F.explode(F.filter(ends, lambda e: F.char_length(e) >= least)).alias("name"))
    first = keyed.groupBy("name").agg(F.min(F.struct("scope", "signal")).alias("m"))
    return asked.select("name").distinct().join(first, "name").select("name", "m.signal", "m.scope")


def without_own_outputs(variables: DataFrame, outputs: DataFrame) -> DataFrame:
    """Variables (bid, text, ...) that their block doesn't compute itself."""
    return variables.join(outputs.select("bid", "text").distinct(), ["bid", "text"], "left_anti")


def identifiers(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("kind") == "Identifier")


def first_line_of(wanted: DataFrame, sources: DataFrame) -> DataFrame:
    """Line number of the first source line (key, source) that equals the wanted text
    (key, text), both trimmed; null if there is none."""
    lines = sources.select("key", F.posexplode(F.split("source", "\n")).alias("at", "line")).select("key", F.trim("line").alias("text"), (F.col("at") + 1).cast("bigint").alias("line"))
    first = lines.groupBy("key", "text").agg(F.min("line").alias("line"))
    return wanted.select("key", F.trim("text").alias("text")).join(first, ["key", "text"], "left")


def instruction_at(probes: DataFrame, trace: DataFrame) -> DataFrame:
    """The first instruction of a trace (key, at, pc, instruction) at each probe's (key, pc)."""
    first = trace.groupBy("key", "pc").agg(F.min_by("instruction", "at").alias("instruction"))
    return probes.join(first, ["key", "pc"], "left")


def without_ignored(frontier: DataFrame, ignored: DataFrame, how: str) -> DataFrame:
    """A frontier (module, bid, ...) without what an early stop excludes: whole
    modules, single blocks, or nothing."""
    if how == "none":
        return frontier
    key = {"module": "module", "block": "bid"}[how]
    return frontier.join(ignored.select(key).distinct(), key, "left_anti").select(*frontier.columns)
