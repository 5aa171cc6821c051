"""Readers of landed files, all with explicit schemas."""

from monthloom.sources.catalog import catalog_from_lines, grouped_suffixes, read_catalog, route, unrouted
from monthloom.sources.columns import parse_lines, read_columns
from monthloom.sources.pages import audit_pages, distinct_pages, flatten_pages, parse_pages, read_pages
from monthloom.sources.series import catalog_daily_sums, catalog_series, read_landed_series, read_quotes

__all__ = [
    "audit_pages",
    "catalog_from_lines",
    "catalog_daily_sums",
    "catalog_series",
    "distinct_pages",
    "flatten_pages",
    "grouped_suffixes",
    "parse_lines",
    "parse_pages",
    "read_catalog",
    "read_columns",
    "read_landed_series",
    "read_pages",
    "read_quotes",
    "route",
    "unrouted",
]
