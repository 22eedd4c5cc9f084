"""Signal values as strings of states, most significant first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# States of two-, four- and nine-valued logic in code order.
STATES = {2: "01", 4: "01xz", 9: "01xzhuwl-"}


def state_class(value: Column) -> Column:
    """0, 1 or 2 for values of two, four or nine states; null for anything else."""
    return F.when(value.rlike("^[01]+$"), 0).when(value.rlike("^[01xXzZ]+$"), 1).when(value.rlike("^[01xXzZhHuUwWlL-]+$"), 2)


def join_states(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def state_code(bit: Column) -> Column:
    """The code of one state character, in either case; null if it is none."""
    at = F.instr(F.lit(STATES[9]), F.lower(bit))
    return F.when((F.char_length(bit) == 1) & (at > 0), at - 1)


def render_states(codes: Column) -> Column:
    """The state string of an array of codes."""
    return F.array_join(F.transform(codes, lambda c: F.substring(F.lit(STATES[9]), (c + 1).cast("int"), F.lit(1))), "")


def extend(value: Column, width: Column) -> Column:
    """A shorter value widened to the left: 0 and 1 by 0, x and z by themselves.
    Null if it is as wide already, or starts in another state."""
    first = F.substring(value, 1, 1)
    fill = F.when(first.isin("0", "1"), F.lit("0")).when(first.isin("x", "X", "z", "Z"), first)
    return F.when(F.char_length(value) < width, F.lpad(value, width.cast("int"), fill))


def bit_slice(value: Column, msb: Column, lsb: Column) -> Column:
    """Bits msb down to lsb."""
    return F.substring(value, (F.char_length(value) - msb).cast("int"), (msb - lsb + 1).cast("int"))


def hex_value(number: Column, digits: int = 0) -> Column:
    shown = F.lower(F.hex(number))
    return F.concat(F.lit("0x"), F.lpad(shown, digits, "0") if digits else shown)


def var_width(msb: Column, lsb: Column) -> Column:
    return F.abs(msb - lsb) + 1


def vcd_id(name: Column) -> Column:
    """A VCD identifier code as a number: bijective base 94, first character lowest;
    null if it is empty, holds another character or is too large."""
    codes = F.transform(F.reverse(F.split(name, "")), lambda c: (F.ascii(c) - 32).cast("decimal(38,0)"))
    total = F.aggregate(codes, F.lit(0).cast("decimal(38,0)"), lambda acc, c: (acc * F.lit(94).cast("decimal(2,0)") + c).cast("decimal(38,0)"))
    return F.when(name.rlike("^[!-~]{1,10}$") & (total <= F.lit(2**63 - 1).cast("decimal(38,0)")), (total - 1).try_cast("bigint"))


def vcd_name(name: Column) -> Column:
    """(name, msb, lsb) of ``a[3:0]``, ``a[3]`` or ``a``."""
    part = lambda k: F.nullif(F.regexp_extract(name, r"^(.*?)\s*(?:\[(-?\d+)(?::(-?\d+))?\])?$", k), F.lit(""))
    msb, lsb = part(2).cast("int"), part(3).cast("int")
    return F.struct(part(1).alias("name"), msb.alias("msb"), F.coalesce(lsb, msb).alias("lsb"))
