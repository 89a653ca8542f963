"""Filter specifications as predicates."""

from __future__ import annotations

from functools import reduce
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers


def _text(df: DataFrame, name: str) -> Column:
    """A value's text; missing: nan."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("nan"))


def _valid(df: DataFrame, pattern: Any) -> bool:
    """Whether the engine that will run the pattern takes it."""
    if not isinstance(pattern, str) or not pattern.strip():
        return False
    try:
        df.sparkSession._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return True


def predicate(df: DataFrame, spec: dict[str, Any]) -> Column:
    """One filter: ``{column, op, lo, hi, expr}``.

    ``range``: numbers within lo and hi, either of which may be missing; what isn't a
    number doesn't pass.  ``==``: the text matches the regular expression somewhere;
    ``!=``: it doesn't, and missing values pass.  Unknown columns and operators, and
    blank or invalid patterns, let nothing pass.
    """
    name, op = spec.get("column"), spec.get("op")
    if name not in df.columns:
        return F.lit(False)
    if op == "range":
        text = F.col(f"`{name}`")
        number = numbers.number(text) if dict(df.dtypes)[name] == "string" else text.try_cast("double")
        keep = number.isNotNull() & ~F.isnan(number)
        if spec.get("lo") is not None:
            keep = keep & (number >= F.lit(float(spec["lo"])))
        if spec.get("hi") is not None:
            keep = keep & (number <= F.lit(float(spec["hi"])))
        return F.coalesce(keep, F.lit(False))
    if op in ("==", "!=") and _valid(df, spec.get("expr")):
        hit = _text(df, name).rlike(spec["expr"])
        return hit if op == "==" else ~hit
    return F.lit(False)


def apply(df: DataFrame, specs: list[dict[str, Any]] | None) -> DataFrame:
    """Rows that pass all filters; number ranges reach the scan where the column is a number."""
    return df.where(reduce(lambda a, b: a & b, (predicate(df, s) for s in specs))) if specs else df


def complete(specs: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """Filters as a form gives them, without those that lack a column, both bounds, or a pattern."""
    return [s for s in specs if s.get("column") and ((s.get("op") == "range" and s.get("lo") is not None and s.get("hi") is not None) or (s.get("op") in ("==", "!=") and s.get("expr")))]
