"""Incremental landing of pages and series files."""

from monthloom.streaming.landing import land_new_files, stream_pages, stream_series

__all__ = ["land_new_files", "stream_pages", "stream_series"]
