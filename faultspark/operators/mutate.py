"""Mutation candidates: operators, names and replaced text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultspark.functions import names

# What an operator is mutated to.
OPERATORS = {"+": "-", "-": "+", "*": "/", "/": "*", "&": "|", "|": "&", "&&": "||", "||": "&&", "==": "!=", "!=": "==", "<": ">", ">": "<", "<=": ">=", ">=": "<="}


def mutated(operator: Column) -> Column:
    """The operator it is replaced by; null if it is never mutated."""
    return F.create_map(*(F.lit(x) for pair in OPERATORS.items() for x in pair))[operator]


def constant(literal: Column, draw: Column) -> Column:
    """A sized or plain constant with another value of the same base and width:
    below its own by ``draw`` in [0, 1), or 1 for zero."""
    pattern = r"^(\d+)?('[bodhBODH])?([0-9a-fA-F_]+)$"
    base = F.lower(F.regexp_extract(literal, pattern, 2))
    radix = F.when(base == "'b", 2).when(base == "'o", 8).when(base == "'h", 16).otherwise(10)
    digits = F.replace(F.regexp_extract(literal, pattern, 3), F.lit("_"))
    head = F.concat(F.regexp_extract(literal, pattern, 1), F.regexp_extract(literal, pattern, 2))
    plain = F.regexp_extract(literal, pattern, 2) == ""
    whole = F.when(plain, F.concat(F.regexp_extract(literal, pattern, 1), digits)).otherwise(digits)
    # Of a wide constant the leading digits are lowered, as many as a double holds exactly.
    digits_held = F.when(base == "'b", 48).when(base == "'o", 16).when(base == "'h", 12).otherwise(15)
    out = F.get(F.transform(F.array(whole), lambda whole: _lowered(whole, draw, radix, digits_held)), F.lit(0))
    return F.when(literal.rlike(pattern), F.when(plain, out).otherwise(F.concat(head, out)))


def _lowered(whole: Column, draw: Column, radix: Column, digits_held: Column) -> Column:
    """Digits of a smaller number, as many as before."""
    conv = lambda text, from_, to: F.call_function("conv", text, from_, to)
    leading = F.regexp_replace(whole, "^0+(?=.)", "")
    top, rest = F.substring(leading, F.lit(1), digits_held), F.substring(leading, digits_held + 1, F.char_length(leading))
    value = conv(top, radix, F.lit(10)).cast("decimal(20,0)")
    less = F.when(value == 0, F.lit(1).cast("decimal(20,0)")).otherwise(F.floor(value.cast("double") * draw).cast("decimal(20,0)"))
    shown = F.concat(F.lower(conv(less.cast("string"), F.lit(10), radix)), F.lower(rest))
    return F.lpad(shown, F.greatest(F.char_length(shown), F.char_length(whole)), F.lit("0"))


def spliced(source: Column, offset: Column, length: Column, replacement: Column) -> Column:
    """Text with ``length`` characters at ``offset`` replaced."""
    return F.overlay(source, replacement, (offset + 1).cast("int"), length.cast("int"))


def nearest_names(tokens: DataFrame, name: str = "name") -> DataFrame:
    """For each distinct name the most similar other one; ties go to the smaller.

    Names of a design are few and known; each is compared with all, in blocks."""
    distinct = tokens.select(name).distinct()
    pairs = distinct.join(distinct.select(F.col(name).alias("other")), F.col(name) != F.col("other"))
    near = pairs.withColumn("distance", names.name_distance(F.col(name), F.col("other")).cast("bigint"))
    return near.groupBy(name).agg(F.min(F.struct("distance", "other")).alias("m")).select(name, "m.other", "m.distance")


def weighted_scopes(scopes: DataFrame) -> DataFrame:
    """(scope, weight, upto, total): running sums to draw a scope by its weight."""
    order = Window.orderBy("scope").rowsBetween(Window.unboundedPreceding, 0)
    total = scopes.agg(F.sum("weight").alias("total"))
    return scopes.withColumn("upto", F.sum("weight").over(order)).crossJoin(F.broadcast(total))


def validate(diffs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Status of (bug_id, line): consistent if a block of the bug holds the line."""
    held = diffs.join(blocks, "bug_id", "left").groupBy("bug_id", "line").agg(F.bool_or(F.col("ctx").contains(F.col("line"))).alias("held"))
    return held.select("bug_id", F.when(F.col("line").isNull() | F.col("held").isNull(), "error").when(F.col("held"), "consistent").otherwise("mismatch").alias("status"))
