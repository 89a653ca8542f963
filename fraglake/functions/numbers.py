"""Numbers in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number; Spark's own casts also take a type letter at the end, as in 5d or 7f.
NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)\s*$"


def number(text: Column) -> Column:
    """A text as a double; null where it isn't a number."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))
