"""Writers."""

from monthloom.sinks.tables import (
    newest_month,
    panel_years,
    read_output,
    read_panel,
    shared_frame,
    staged_report,
    write_outputs,
    write_panel,
    write_report,
)

__all__ = [
    "newest_month",
    "panel_years",
    "read_output",
    "read_panel",
    "shared_frame",
    "staged_report",
    "write_outputs",
    "write_panel",
    "write_report",
]
