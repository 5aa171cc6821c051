"""Whole jobs: the panel from landed files, and the reports on it.

A report takes the long monthly panel and returns its output frames by name,
all of them lazy.  The order of steps in a report is part of its meaning: an
epoch is cut before changes are taken, a user's date range after.
"""

from monthloom.plans.common import Outputs
from monthloom.plans.correlation import correlation_report, pair_detail
from monthloom.plans.employment import employment_report
from monthloom.plans.fuel import fuel_report
from monthloom.plans.industrial import industrial_report
from monthloom.plans.oil import oil_report
from monthloom.plans.panel import build_panel
from monthloom.plans.price import price_report
from monthloom.plans.recent import recent_report
from monthloom.plans.years import panel_of, years_of

__all__ = [
    "Outputs",
    "build_panel",
    "correlation_report",
    "employment_report",
    "fuel_report",
    "industrial_report",
    "oil_report",
    "pair_detail",
    "panel_of",
    "price_report",
    "recent_report",
    "years_of",
]
