"""Backward slices over a block graph, breadth first by level.

Edges are (dst, src, dt): src drives dst, dt time steps earlier. Each level is
one join of the frontier with the edges and one null-safe anti-join with what has
been visited; levels are written to the shared folder, so plans stay flat, and
only counts come to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultspark.lineage import cut


def without(rows: DataFrame, met: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose keys are not in ``met``; nulls are equal to each other."""
    known = met.select(*(F.col(k).alias("_met_" + k) for k in keys))
    return rows.join(known, reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col("_met_" + k)) for k in keys)), "left_anti")


def reach(edges: DataFrame, start: DataFrame, bound: int | None = None, timed: bool = True, scope=None, limit: int | None = None, levels: int = 10_000) -> DataFrame:
    """Nodes, with times if ``timed``, that the start nodes depend on, with their level.

    ``start`` has node (and time). A time below ``bound`` (0 without one) is not
    visited; a null time passes. ``scope`` is a condition on ``node``. With
    ``limit`` the walk ends once there are more rows, and the first limit + 1
    in canonical order are left. Repeated edges and starts count once, null times
    are one time, and no start gives an empty table."""
    keys = ["node", "time"] if timed else ["node"]
    allowed = F.lit(True) if scope is None else scope
    if timed:
        allowed = allowed & (F.col("time").isNull() | (F.col("time") >= (bound or 0)))
    ways = cut(edges.select(F.col("dst").alias("node"), F.col("src").alias("_src"), *([F.col("dt").alias("_dt")] if timed else [])).distinct())
    frontier = cut(start.select(*keys).where(allowed).distinct().withColumn("level", F.lit(0)))
    seen, level, new = frontier, 0, frontier.count()
    total = new
    while level < levels and new and not (limit is not None and total > limit):
        level += 1
        step = frontier.select(*keys).join(ways, "node")
        moved = step.select(F.col("_src").alias("node"), *([(F.col("time") - F.col("_dt")).alias("time")] if timed else [])).distinct().where(allowed)
        frontier = cut(without(moved, seen, keys).withColumn("level", F.lit(level)))
        new = frontier.count()
        total += new
        if new:
            seen = seen.unionByName(frontier)
    if limit is not None:
        return seen.orderBy("level", *keys).limit(limit + 1)
    return seen


def dynamic_slice(flow: DataFrame, coverage: DataFrame, start: DataFrame, step: int = 1, bound: int | None = None) -> DataFrame:
    """(bid, time, level): blocks met walking back from signals, gated by coverage.

    ``flow`` has the def-use rows (bid, scope, seq, line, out, src): block bid of
    a scope computes out from src on a line; seq tells a clocked block.
    ``coverage`` (scope, line, time, count) gates lines at a time; combinational
    assigns have a null line and always count. A block is recorded when a line
    of it is covered; its drivers are those of its covered definitions of the
    signal, each definition visited once by whichever walk comes first in
    (level, time descending) order; a clocked block looks one step earlier. No
    start gives an empty table."""
    flow, coverage = cut(flow), cut(coverage)
    blocks = flow.select("bid", "scope", "seq", "line", "out").distinct()
    frontier = cut(start.select("scope", F.col("signal").alias("out"), "time").distinct())
    kinds = f"bid {flow.schema['bid'].dataType.simpleString()}, time {start.schema['time'].dataType.simpleString()}, level int"
    asked, done, found, level = frontier, None, None, 0
    covered = coverage.where("count > 0").select("scope", "line", "time").distinct()
    while not frontier.isEmpty():
        hit = frontier.join(blocks, ["scope", "out"])
        live = hit.join(covered, ["scope", "line", "time"], "left_semi").unionByName(hit.where("line IS NULL"))
        live = cut(live)
        rows = live.select("bid", "time").distinct().withColumn("level", F.lit(level))
        found = cut(rows if found is None else found.unionByName(rows.join(found.select("bid", "time"), ["bid", "time"], "left_anti")))
        fresh = live.groupBy("bid", "scope", "seq", "line", "out").agg(F.max("time").alias("time"))
        if done is not None:
            met = (F.col("bid") == F.col("_b")) & (F.col("out") == F.col("_o")) & F.col("line").eqNullSafe(F.col("_l"))
            fresh = fresh.join(done, met, "left_anti")
        fresh = cut(fresh)
        marks = fresh.select(F.col("bid").alias("_b"), F.col("line").alias("_l"), F.col("out").alias("_o"))
        done = cut(marks if done is None else done.unionByName(marks))
        uses = flow.select(F.col("bid").alias("_b"), F.col("line").alias("_l"), F.col("out").alias("_o"), "src")
        met = (F.col("bid") == F.col("_b")) & (F.col("out") == F.col("_o")) & F.col("line").eqNullSafe(F.col("_l"))
        earlier = F.col("time") - F.when(F.col("seq"), F.lit(step)).otherwise(F.lit(0))
        drivers = fresh.join(uses, met).select("scope", F.col("src").alias("out"), earlier.alias("time"))
        frontier = cut(drivers.where(F.col("time") >= (bound or 0)).distinct().join(asked, ["scope", "out", "time"], "left_anti"))
        asked = cut(asked.unionByName(frontier))
        level += 1
    return start.sparkSession.createDataFrame([], kinds) if found is None else found


def resolve_scope(paths: DataFrame, known: DataFrame, path: str = "path") -> DataFrame:
    """The longest existing prefix of each path; null if there is none."""
    from faultspark.functions import names

    asked = paths.select(path, F.explode(names.prefixes(F.col(path))).alias("scope"))
    met = asked.join(known.select(F.col(path).alias("scope")).distinct(), "scope")
    longest = met.groupBy(path).agg(F.max_by("scope", F.char_length("scope")).alias("scope"))
    return paths.select(path).distinct().join(longest, path, "left")


def driving_blocks(frontier: DataFrame, outputs: DataFrame, scopes: DataFrame) -> DataFrame:
    """Blocks that drive (scope, text): those of the scope, else outputs of scopes below it.

    ``outputs`` (scope, text, bid, btype) has what blocks compute; ``scopes``
    (scope, below) the closure of scopes and those below them."""
    own = frontier.join(outputs.where("btype <> 'ModuleOutput'"), ["scope", "text"])
    rest = frontier.join(own.select("scope", "text").distinct(), ["scope", "text"], "left_anti")
    inner = outputs.where("btype = 'ModuleOutput'").select(F.col("scope").alias("below"), "text", "bid", "btype")
    return own.unionByName(rest.join(scopes, "scope").join(inner, ["below", "text"]).select(*own.columns))


def merge_components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of the component of each node of edges (a, b).

    Labels spread along edges and jump to their own label's label, until none
    changes; each round is checkpointed."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("_l")), "b").groupBy(F.col("a").alias("node")).agg(F.min("_l").alias("_n"))
        step = labels.join(near, "node").select("node", F.col("label").alias("_was"), F.least("label", "_n").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("_top"))
        after = cut(step.join(up, "label", "left").select("node", "_was", F.least("label", F.coalesce("_top", "label")).alias("label")))
        labels = after.select("node", "label")
        if after.where("label <> _was").isEmpty():
            return labels
