"""Value-change logs: as-of lookup, compaction, delta cycles, names and rendering.

A log has rows (signal, time, seq, value); probes are (probe_id, signal, time).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultspark.functions import names


def first_of_delta(changes: DataFrame, keys: list[str], time: str = "time", seq: str = "seq") -> DataFrame:
    """The first row at each time of a signal."""
    order = Window.partitionBy(*keys, time).orderBy(seq)
    return changes.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def as_of(probes: DataFrame, changes: DataFrame, keys: list[str], time: str = "time", seq: str = "seq", value: str = "value", out: str = "found") -> DataFrame:
    """Probes with the value that each signal held: that of the last change at or before.

    Changes and probes are put in one order by a union and filled forward, so
    the cost is a sort and not a join on an inequality. At one time a change
    comes before a probe, and of several changes the first counts. A probe
    before all changes gets null."""
    held = first_of_delta(changes, keys, time, seq)
    extra = [c for c in probes.columns if c not in keys and c != time]
    left = probes.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.struct(*extra).alias("_row"), F.lit(None).cast(changes.schema[value].dataType).alias("_v"), F.lit(False).alias("_set"))
    right = held.select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"), F.lit(True).alias("_set"))
    both = left.unionByName(right)
    order = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_held", F.last(F.when(F.col("_set"), F.struct("_v")), ignorenulls=True).over(order))
    return filled.where("_side = 1").select(*keys, F.col("_t").alias(time), "_row.*", F.col("_held._v").alias(out))


def compact(changes: DataFrame, keys: list[str], order: list[str], value: str = "value") -> DataFrame:
    """Rows whose value isn't that of the signal's row before."""
    window = Window.partitionBy(*keys).orderBy(*order)
    marked = changes.withColumn("_was", F.lag(value).over(window)).withColumn("_k", F.row_number().over(window))
    return marked.where((F.col("_k") == 1) | ~F.col("_was").eqNullSafe(F.col(value))).drop("_was", "_k")


def delta_groups(changes: DataFrame, keys: list[str], time: str = "time", seq: str = "seq", value: str = "value") -> DataFrame:
    """Number of changes, first seq and first value at each time of a signal."""
    return changes.groupBy(*keys, time).agg(F.count("*").alias("elements"), F.min(seq).alias("first_seq"), F.min_by(value, seq).alias("first_value"))


def next_change(changes: DataFrame, keys: list[str], order: list[str], what: str, out: str = "next") -> DataFrame:
    return changes.withColumn(out, F.lead(what).over(Window.partitionBy(*keys).orderBy(*order)))


def monotonic(changes: DataFrame, keys: list[str], arrival: list[str], time: str = "time") -> DataFrame:
    """Rows, in order of arrival, whose time isn't before one already seen."""
    before = Window.partitionBy(*keys).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    return changes.withColumn("_top", F.max(time).over(before)).where(F.col("_top").isNull() | (F.col(time) >= F.col("_top"))).drop("_top")


def concat_in_order(parts: list[DataFrame], keys: list[str], time: str = "time") -> DataFrame:
    """Logs one behind the other; a part that starts before its predecessor ends is an error."""
    ends = [p.agg(F.min(time), F.max(time)).first() for p in parts]
    full = [e for e in ends if e[0] is not None]
    if any(a[1] > b[0] for a, b in zip(full, full[1:])):
        raise ValueError("parts overlap in time")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def map_enum(rows: DataFrame, enum_map: DataFrame, raw: str, out: str) -> DataFrame:
    """The name of a raw value, or the raw value; ``enum_map`` (raw, name) is small metadata."""
    small = enum_map.select(F.col("raw").alias("_raw"), F.col("name").alias("_name"))
    return rows.join(small, F.col(raw) == F.col("_raw"), "left").withColumn(out, F.coalesce("_name", F.col(raw).cast("string"))).drop("_raw", "_name")


def match_scopes(asked: DataFrame, known: DataFrame, path: str = "path") -> DataFrame:
    """For each asked path the known one with the longest common suffix of segments.

    Suffixes are exploded to an equi-join; ties go to the smaller known path.
    Paths without any common suffix are left out."""
    left = asked.select(F.col(path).alias("asked"), F.explode(names.suffixes(F.col(path))).alias("suffix")).distinct()
    right = known.select(F.col(path).alias("known"), F.explode(names.suffixes(F.col(path))).alias("suffix")).distinct()
    met = left.join(right, "suffix").withColumn("segments", F.size(F.split("suffix", r"\.")).cast("bigint"))
    order = Window.partitionBy("asked").orderBy(F.desc("segments"), "known")
    return met.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("asked", "known", "segments")


def flatten_scopes(scopes: DataFrame, depth: int = 64) -> DataFrame:
    """(scope_id, path) of a scope tree (scope_id, parent_id, name); roots have no parent."""
    from faultspark.lineage import cut

    level = scopes.where("parent_id IS NULL").select("scope_id", F.col("name").alias("path"))
    out = level
    for _ in range(depth):
        level = cut(scopes.join(level.select(F.col("scope_id").alias("parent_id"), "path"), "parent_id").select("scope_id", F.concat_ws(".", "path", "name").alias("path")))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError("scopes are nested too deep or in a circle")


def resolve_slices(values: DataFrame, slices: DataFrame) -> DataFrame:
    """Values of alias signals (signal_id, source_id, msb, lsb), cut out of their source's."""
    source = values.withColumnRenamed("signal_id", "source_id")
    cut_out = slices.join(source, "source_id").withColumn("value", F.expr("substring(value, char_length(value) - msb, msb - lsb + 1)"))
    return cut_out.select(*values.columns)


def table(rows: DataFrame, by: str, signal: str, value: str, signals: list[str]) -> DataFrame:
    """One row per ``by``, one column per signal, with its first value by order of value."""
    return rows.groupBy(by).agg(*(F.min(F.when(F.col(signal) == s, F.col(value))).alias(s) for s in signals))


def markdown(rows: list[dict]) -> str:
    """A markdown table of few collected rows."""
    if not rows:
        return ""
    head = list(rows[0])
    lines = [head, ["---"] * len(head), *([str(r[c]) for c in head] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def values_json(name: Column, time: Column, width: Column, value: Column) -> Column:
    return F.to_json(F.struct(name.alias("signal_name"), time.alias("time"), width.alias("bit-width"), value.alias("value")))


def probe_start(rows: DataFrame, keys: list[str], time: str = "time", value: str = "value", trivial: tuple = (0, 0x80000000)) -> DataFrame:
    """The first time of a non-trivial value, else the last time."""
    telling = F.col(value).isNotNull() & ~F.col(value).isin(*trivial)
    return rows.groupBy(*keys).agg(F.coalesce(F.min(F.when(telling, F.col(time))), F.max(time)).alias("start"))
