"""Semantics of values as column expressions: folding, truth, unions, intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base type that absorbs each literal's tag.
BASES = {"lit-int": "int", "lit-string": "string", "true": "bool", "false": "bool"}


def truthy_string(c: Column) -> Column:
    """The empty string and "0" are false."""
    return ~c.isin("", "0")


def fold_divide(a: Column, b: Column) -> Column:
    """Division of integers: (int value, float value); int when exact, none at zero."""
    exact = (b != 0) & (a % F.when(b != 0, b) == 0)
    return F.struct(
        F.when(exact, F.expr("try_divide(1, 1)").cast("bigint") * F.floor(a / F.when(b != 0, b)).cast("bigint")).alias("int_value"),
        F.when((b != 0) & ~exact, a.cast("double") / F.when(b != 0, b).cast("double")).alias("float_value"),
    )


def fold_int(op: str, a: Column, b: Column) -> Column:
    """``+ - *`` on 64-bit integers; none on overflow.  ``%``: none at zero, sign of the dividend."""
    if op == "%":
        return F.when(b != 0, a % F.when(b != 0, b))
    return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b)


def union_types(arms: Column) -> Column:
    """Normal form of a flat union of type names (an array): nullable arms give
    their inner type and null, duplicates go and the first stays, ``int(5)`` and
    the like go where their base stands, no arm is ``never``."""
    flat = F.flatten(F.transform(arms, lambda t: F.when(t.startswith("?"), F.array(F.substring(t, 2, 1 << 20), F.lit("null"))).otherwise(F.array(t))))
    distinct = F.array_distinct(flat)
    base = lambda t: F.when(t.isin("true", "false"), F.lit("bool")).when(t.contains("("), F.substring_index(t, "(", 1))
    kept = F.filter(distinct, lambda t: base(t).isNull() | ~F.array_contains(distinct, base(t)))
    return F.when(F.size(kept) == 0, F.lit("never")).otherwise(F.array_join(kept, "|"))


def narrow_range(low: Column, high: Column, op: str, bound: Column) -> Column:
    """The interval [low, high] (null is open) where ``x op bound`` holds; null if empty."""
    lo = {">": bound + 1, ">=": bound, "==": bound}.get(op)
    hi = {"<": bound - 1, "<=": bound, "==": bound}.get(op)
    new_lo = low if lo is None else F.greatest(low, lo)
    new_hi = high if hi is None else F.least(high, hi)
    return F.when(new_lo.isNull() | new_hi.isNull() | (new_lo <= new_hi), F.struct(new_lo.alias("low"), new_hi.alias("high")))
