"""Comparisons of a column with literals, in SQL's value semantics."""

from __future__ import annotations

from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class ColumnError(ValueError):
    """A predicate on a column that isn't there, or with a literal that doesn't fit its type."""


def literal(value: object, kind: T.DataType, column: str) -> Column:
    """The literal in the column's own type, so that the comparison is one of equal types and reaches the scan.

    A number that the type can't hold (a fraction against whole numbers, too many digits) is compared as a decimal or
    a double, as SQL does.
    """
    if not isinstance(kind, NUMBERS):
        return F.lit(str(value)).cast(kind)  # dates and timestamps: the document only has text for them
    try:
        number = Decimal(str(value).strip())
    except InvalidOperation as error:
        raise ColumnError(f"'{value}' is no number, but column '{column}' is {kind.simpleString()}") from error
    if isinstance(kind, (T.FloatType, T.DoubleType)) or not number.is_finite():
        return F.lit(float(number)).cast(kind if isinstance(kind, T.FloatType) else "double")
    whole = number == number.to_integral_value()
    if isinstance(kind, WHOLE):
        if whole and -(2**63) <= number < 2**63:
            n = int(number)
            small = -(2**31) <= n < 2**31 and not isinstance(kind, T.LongType)
            return F.lit(n).cast("int" if small else "long")
        return F.lit(number) if len(number.as_tuple().digits) <= 38 else F.lit(float(number))
    fits = number.adjusted() < kind.precision - kind.scale and -number.normalize().as_tuple().exponent <= kind.scale
    return F.lit(str(number)).cast(kind) if fits else F.lit(float(number)) if len(number.as_tuple().digits) > 38 else F.lit(number)


def condition(df: DataFrame, predicate: dict) -> Column:
    """One comparison; ``!=`` and ``NOT IN`` are only reached from filters of vertices."""
    column, operator, value = predicate["column"], predicate.get("operator", "="), predicate["value"]
    kind = df.schema[column].dataType
    here = F.col(f"`{column}`")
    if operator in ("IN", "NOT IN"):
        values = value if isinstance(value, (list, tuple)) else [value]
        if isinstance(kind, NUMBERS):  # texts in a mixed list can't equal a number
            values = [v for v in values if not isinstance(v, str) or _is_number(v)]
        found = here.isin([literal(v, kind, column) for v in values]) if values else F.lit(False) & here.isNotNull()
        return found if operator == "IN" else ~found
    if operator == "LIKE":
        return here.cast("string").like(str(value))
    against = literal(value, kind, column)
    if operator == "=":
        return here == against
    if operator == "!=":
        return here != against
    if operator == ">":
        return here > against
    if operator == "<":
        return here < against
    if operator == ">=":
        return here >= against
    if operator == "<=":
        return here <= against
    raise ColumnError(f"unknown comparison '{operator}'")


def _is_number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def filtered(df: DataFrame, predicate: dict | None, strict: bool = True) -> DataFrame:
    """Rows that satisfy the predicate; without one, all.  A missing column is an error, or with ``strict=False`` no filter."""
    if not predicate:
        return df
    if predicate["column"] not in df.columns:
        if strict:
            raise ColumnError(f"no column '{predicate['column']}' among {df.columns}")
        return df
    return df.where(condition(df, predicate))
