"""Economic time-series panels on Spark.

A panel is kept long, one row per series and month, and every operator takes
and returns DataFrames.  Nothing here runs an action except where a docstring
says so.
"""

from monthloom.session import get_session

__all__ = ["get_session"]
