"""Column expressions.  All are built-in Spark expressions, none is a UDF."""

from monthloom.functions.dates import (
    format_iso,
    format_month_year,
    month_end,
    month_index,
    month_start,
    parse_mixed_date,
)
from monthloom.functions.numbers import (
    half_even,
    natural_log,
    nan_to_null,
    pct_change,
    position_between,
    rebase,
)
from monthloom.functions.pairs import pair_beta, pair_corr
from monthloom.functions.strict import lenient_double, strict_double
from monthloom.functions.text import drop_null_tokens, float_text, series_stem

__all__ = [
    "drop_null_tokens",
    "float_text",
    "format_iso",
    "format_month_year",
    "half_even",
    "lenient_double",
    "month_end",
    "month_index",
    "month_start",
    "nan_to_null",
    "natural_log",
    "pair_beta",
    "pair_corr",
    "parse_mixed_date",
    "pct_change",
    "position_between",
    "rebase",
    "series_stem",
    "strict_double",
]
