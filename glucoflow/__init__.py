"""glucoflow: diabetes-device time series on Spark.

Irregular device readings (glucose sensors, meters, insulin, meals, notes)
for many people at once become cleaned, regular, aligned series.  Every
operator is a ``DataFrame -> DataFrame`` function keyed by ``series_id``.
"""

from glucoflow.session import ensure_session_defaults, get_spark

__all__ = ["get_spark", "ensure_session_defaults"]
