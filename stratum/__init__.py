"""stratum — table-in/table-out survey analytics on Spark.

Every public operator takes DataFrames and returns DataFrames.  Small
parameter tables (levels, quantiles, means) are computed with one wide
aggregation and joined back with a size-checked broadcast; nothing row-sized
passes through the driver.
"""

from stratum.session import get_session, scratch_dir  # noqa: F401

__all__ = ["get_session", "scratch_dir"]
