"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The number grammar of logs: no nan, no inf.
NUMBER = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[Ee][+-]?\d+)?"


def finite(x: Column) -> Column:
    """Whether a double is neither null, NaN nor infinite; never null."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def once(**columns: Column) -> Column:
    """The columns, computed once for a row: what reads or filters them later doesn't compute them again."""
    return F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))


def at_most(x: Column, limit: Column) -> Column:
    """x <= limit; false for a null or non-finite x."""
    return finite(x) & F.coalesce(x <= limit, F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """a / b, with 0 / 0 = 0 and otherwise the largest double for a zero divisor."""
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(F.when(a == 0, 0.0).otherwise(1.7976931348623157e308))


def series_id(*parts: Column) -> Column:
    """20 hexadecimal digits that stand for function, type, region, field, operation, component and source; null is empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 20)


def magnitude(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def number(text: Column) -> Column:
    """A double from text in the number grammar; null for other text."""
    return F.when(text.rlike(f"^{NUMBER}$"), text.try_cast("double"))
