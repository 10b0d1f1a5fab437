"""Reductions with the identities of their loops: sum 0, product 1, max and min the type's least and
greatest finite number.

NaN never wins a comparison, so maxima and minima pass it over. Without group keys one row comes back even
from no rows; with keys one row for each key (an outer index of a team loop) that has rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the least and the greatest finite number of each type
LOWEST = {"double": -1.7976931348623157e308, "float": -3.4028234663852886e38, "long": -(2**63), "int": -(2**31)}
HIGHEST = {"double": 1.7976931348623157e308, "float": 3.4028234663852886e38, "long": 2**63 - 1, "int": 2**31 - 1}


def _number(value: Column, kind: str) -> Column:
    return F.when(~F.isnan(value), value) if kind in ("double", "float") else value


def combine(op: str, value: Column, kind: str = "double") -> Column:
    """The aggregate of a reduction, with its identity over no rows."""
    if op == "sum":
        return F.coalesce(F.sum(value.cast("long" if kind in ("int", "long") else "double")), F.lit(0).cast("long" if kind in ("int", "long") else "double"))
    if op == "product":
        return F.coalesce(F.product(value.cast("double")), F.lit(1.0))
    if op == "max":
        return F.coalesce(F.max(_number(value, kind)), F.lit(LOWEST[kind]).cast(kind))
    if op == "min":
        return F.coalesce(F.min(_number(value, kind)), F.lit(HIGHEST[kind]).cast(kind))
    raise ValueError(f"no reduction {op!r}")


def reduce_all(df: DataFrame, kind: str = "double", **parts: tuple[str, Column]) -> DataFrame:
    """Several reductions in one pass: name=(op, expression)."""
    return df.agg(*(combine(op, e, kind).alias(name) for name, (op, e) in parts.items()))


def reduce_by(df: DataFrame, keys: list[str], kind: str = "double", **parts: tuple[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*(combine(op, e, kind).alias(name) for name, (op, e) in parts.items()))


def product_log(df: DataFrame, value: Column) -> DataFrame:
    """``sign`` and ``log`` of a product beyond the range of doubles, which is sign * exp(log).

    No rows give sign 1 and log 0, a zero gives sign 0 and log -inf. Nulls are passed over.
    """
    x = value.cast("double")
    log = F.when(x == 0, F.lit(float("-inf"))).otherwise(F.ln(F.abs(x)))
    sign = F.when(F.count_if(x == 0) > 0, 0).otherwise(1 - 2 * (F.count_if(x < 0) % 2)).cast("int")
    return df.agg(sign.alias("sign"), F.coalesce(F.sum(log), F.lit(0.0)).alias("log"))
