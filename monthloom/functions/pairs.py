"""Two-variable statistics over complete pairs, as aggregates or windows.

``corr`` fails under ANSI when a side is constant; these give NULL instead.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def _over(aggregate: Column, window: WindowSpec | None) -> Column:
    return aggregate if window is None else aggregate.over(window)


def _complete(x: Column, y: Column) -> tuple[Column, Column]:
    """Both sides NULL unless both are present."""
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


def pair_count(x: Column, y: Column, window: WindowSpec | None = None) -> Column:
    return _over(F.count(F.when(x.isNotNull() & y.isNotNull(), F.lit(1))), window)


def pair_corr(x: Column, y: Column, window: WindowSpec | None = None) -> Column:
    """Pearson correlation over complete pairs."""
    x, y = _complete(x, y)
    cov = _over(F.covar_pop(x, y), window)
    spread = F.sqrt(_over(F.var_pop(x), window) * _over(F.var_pop(y), window))
    return F.try_divide(cov, spread)


def pair_beta(x: Column, y: Column, window: WindowSpec | None = None) -> Column:
    """Slope of y on x over complete pairs."""
    return _over(F.regr_slope(y, x), window)
