"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the text some payloads send for a missing figure.
NULL_TOKENS = ("None",)


def drop_null_tokens(text: Column, tokens: tuple[str, ...] = NULL_TOKENS) -> Column:
    return F.when(~text.isin(*tokens), text)


def series_stem(label: Column, suffix: Column | str = "") -> Column:
    """Group label to series name: no spaces, lower case, then the suffix."""
    tail = F.lit(suffix) if isinstance(suffix, str) else suffix
    return F.concat(F.lower(F.replace(label, F.lit(" "), F.lit(""))), tail)


def float_text(value: Column) -> Column:
    """Shortest text of a double, with ``nan`` for a missing one."""
    return F.coalesce(value.cast("string"), F.lit("nan"))
