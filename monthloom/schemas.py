"""Explicit schemas of everything the engine reads; nothing is inferred."""

from __future__ import annotations

CATALOG = (
    "source STRING, data_name STRING, secondary_name STRING, data_link STRING, "
    "paginated STRING, column_to_groupby STRING, value_name STRING"
)

# Landed rows of a one-value-per-date source, keyed by the source's own name.
LANDED_SERIES = "data_name STRING, date STRING, value DOUBLE"

# A landed page.  Record fields differ between payloads, so a record is a map
# and the catalog row says which entries hold the value and the group.
PAGE = "response STRUCT<total: STRING, data: ARRAY<MAP<STRING, STRING>>>"

QUOTES = "ticker STRING, trade_date DATE, close DOUBLE"

OBSERVATIONS = "series_id STRING, obs_date DATE, value DOUBLE, obs_id BIGINT"
MONTHLY = "series_id STRING, month_end DATE, value DOUBLE"
CORRELATION = "var_a STRING, var_b STRING, n BIGINT, r DOUBLE"
