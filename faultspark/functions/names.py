"""Scope paths, signal names and positions in source text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Port name prefixes to strip, longest first, and names too generic to match by.
PORT_PREFIXES = ("io_in_bits_", "io_out_bits_", "io_in_", "io_out_", "io_")
GENERIC = ("data", "valid", "ready", "bits", "clock", "reset")


def parent_scope(path: Column) -> Column:
    """The path without its last segment; null for a path of one segment."""
    return F.when(F.instr(path, ".") > 0, F.regexp_extract(path, r"^(.*)\.[^.]*$", 1))


def child_scope(path: Column, name: Column) -> Column:
    return F.concat(path, F.lit("."), name)


def suffixes(path: Column) -> Column:
    """All dotted suffixes of a path, longest first."""
    parts = F.split(path, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def prefixes(path: Column) -> Column:
    """All dotted prefixes of a path, shortest first."""
    parts = F.split(path, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def signal_suffix(name: Column) -> Column:
    """The last two segments between underscores."""
    return F.substring_index(name, "_", -2)


def canonical_port(name: Column) -> Column:
    """A port's short name; null if that is under four characters or generic."""
    short = name
    cases = F.when(F.startswith(name, F.lit(PORT_PREFIXES[0])), F.substring(name, len(PORT_PREFIXES[0]) + 1, 1 << 30))
    for prefix in PORT_PREFIXES[1:]:
        cases = cases.when(F.startswith(name, F.lit(prefix)), F.substring(name, len(prefix) + 1, 1 << 30))
    short = cases.otherwise(name)
    return F.when((F.char_length(short) >= 4) & ~short.isin(*GENERIC), short)


def is_constant(name: Column) -> Column:
    """Whether all letters are capitals; true without letters."""
    letters = F.regexp_replace(name, "[^A-Za-z]", "")
    return letters == F.upper(letters)


def array_base(name: Column) -> Column:
    return F.substring_index(name, "[", 1)


def array_element(name: Column, index: Column) -> Column:
    return F.concat(name, F.lit("["), index.cast("string"), F.lit("]"))


def parse_numbers(text: Column) -> Column:
    """Lines of ``14,16-19,22`` as an array; empty for an empty text."""
    def one(part: Column) -> Column:
        ends = F.split(F.trim(part), "-")
        return F.sequence(F.element_at(ends, 1).cast("int"), F.element_at(ends, -1).cast("int"))

    return F.when(F.trim(text) == "", F.array().cast("array<int>")).otherwise(F.flatten(F.transform(F.split(text, ","), one)))


def location_lines(loc: Column) -> Column:
    """Lines l1 to l2 of ``file,l1:c1,l2:c2``; null if it hasn't three parts."""
    parts = F.split(loc, ",")
    line = lambda k: F.split(F.get(parts, F.lit(k)), ":")[0].cast("int")
    return F.when(F.size(parts) == 3, F.sequence(line(1), line(2)))


def position(source: Column, offset: Column) -> Column:
    """(column, row) of a byte offset; a line end counts to the row it starts. Null past the end."""
    upto = F.substring(source.cast("binary"), F.lit(1), (offset + 1).cast("int"))
    text = F.hex(upto)
    breaks = F.transform(F.regexp_extract_all(text, F.lit("(..)"), F.lit(1)), lambda h: h == "0A")
    row = (F.size(F.filter(breaks, lambda b: b)) + 1).cast("bigint")
    last = F.array_max(F.filter(F.transform(breaks, lambda b, i: F.when(b, i)), lambda i: i.isNotNull()))
    column = F.coalesce(offset - last, offset + 1).cast("bigint")
    inside = (offset >= 0) & (offset < F.octet_length(source))
    return F.when(inside, F.struct(column.alias("column"), row.alias("row")))


def merge_spans(spans: Column) -> Column:
    """Spans (offset, len), sorted and merged where they touch or overlap."""
    empty = F.array().cast("array<struct<offset:bigint,len:bigint>>")

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        end = F.greatest(last["offset"] + last["len"], s["offset"] + s["len"])
        joined = F.struct(last["offset"].alias("offset"), (end - last["offset"]).alias("len"))
        return F.when((F.size(acc) > 0) & (s["offset"] <= F.try_element_at(acc, F.lit(-1))["offset"] + F.try_element_at(acc, F.lit(-1))["len"]), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(F.struct(s["offset"].cast("bigint").alias("offset"), s["len"].cast("bigint").alias("len")))))

    return F.aggregate(F.array_sort(spans), empty, step)


def name_distance(a: Column, b: Column) -> Column:
    """Edit distance, where a side with a capital is taken in capitals."""
    fold = lambda c: F.when(c.rlike("[A-Z]"), F.upper(c)).otherwise(c)
    return F.levenshtein(fold(a), fold(b))
