"""Logical types of text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers

BOOL_WORDS = ("true", "false", "yes", "no")
#: Share of values that must parse for a column to be numeric or temporal.
SHARE = 0.9


def _smallest(low: float, high: float) -> str:
    if low >= 0:
        return next((t for t, top in (("UInt8", 2**8), ("UInt16", 2**16), ("UInt32", 2**32)) if high < top), "Int64")
    return next((t for t, half in (("Int8", 2**7), ("Int16", 2**15), ("Int32", 2**31)) if low >= -half and high < half), "Int64")


def facts(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """What the decision needs of each column, in one aggregation over all of them."""
    sums = []
    for i, c in enumerate(columns):
        text = F.trim(F.col(f"`{c}`").cast("string"))
        lowered = F.lower(text)
        real = text.isNotNull() & (text != "") & (lowered != "nan")
        number = F.when(real, numbers.number(text))
        time = F.when(real, F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy/MM/dd")), F.try_to_timestamp(text, F.lit("dd-MM-yyyy"))))
        near = F.abs(number - number.cast("float").cast("double")) <= 1e-9 + 1e-6 * F.abs(number)
        sums += [
            F.count_if(real).alias(f"n{i}"),
            F.count_if(real & lowered.isin(*BOOL_WORDS)).alias(f"words{i}"),
            F.count_if(real & lowered.isin(*BOOL_WORDS, "0", "1")).alias(f"bools{i}"),
            F.count(number).alias(f"numbers{i}"),
            F.min(number).alias(f"low{i}"),
            F.max(number).alias(f"high{i}"),
            F.coalesce(F.bool_and(number == F.floor(number)), F.lit(False)).alias(f"whole{i}"),
            F.coalesce(F.bool_and(near), F.lit(False)).alias(f"single{i}"),
            F.count(time).alias(f"times{i}"),
            F.coalesce(F.bool_or(F.date_trunc("DAY", time) != time), F.lit(False)).alias(f"clock{i}"),
        ]
    row = df.agg(*sums).first()
    return {c: {k: row[f"{k}{i}"] for k in ("n", "words", "bools", "numbers", "low", "high", "whole", "single", "times", "clock")} for i, c in enumerate(columns)}


def decide(x: dict) -> str:
    """The type: Bool if all are truth values and one is a word; numbers if nine in ten parse; times likewise; else String."""
    if not x["n"]:
        return "String"
    if x["bools"] == x["n"] and x["words"]:
        return "Bool"
    if x["numbers"] >= SHARE * x["n"]:
        if x["whole"]:
            return _smallest(x["low"], x["high"])
        return "Float32" if x["single"] else "Float64"
    if x["times"] >= SHARE * x["n"]:
        return "DateTime" if x["clock"] else "Date"
    return "String"


def types(df: DataFrame, columns: list[str], sample_rows: int | None = None) -> dict[str, str]:
    """The logical type of each column, over all rows, or over the first ``sample_rows`` as a preview."""
    return {c: decide(x) for c, x in facts(df.limit(sample_rows) if sample_rows else df, columns).items()}


def examples(df: DataFrame, column: str, most: int = 25) -> tuple[list[str], bool]:
    """Up to ``most`` distinct values, and whether there are more."""
    rows = [r[0] for r in df.select(F.col(f"`{column}`").cast("string").alias("v")).where("v is not null").distinct().orderBy("v").limit(most + 1).collect()]
    return rows[:most], len(rows) > most
