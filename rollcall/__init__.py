"""rollcall: audience analytics on Spark DataFrames.

Everything here takes DataFrames and returns DataFrames (or Columns).  Spark
plans, partitions and runs the work; see README.md for the map of the package.
"""

from rollcall.session import configure, local_session
from rollcall.tables import Tables

__all__ = ["configure", "local_session", "Tables"]
