"""Live monitoring: error statistics by time window, and first epochs of each id, with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def error_windows(stream: DataFrame, time: str, error: str, width: str, late: str, keys: list[str] = ()) -> DataFrame:
    """Count, mean and root mean square of errors by window; rows later than ``late`` behind the newest are dropped, and so is the state of closed windows."""
    e = F.col(error)
    own = stream.withWatermark(time, late).groupBy(F.window(time, width), *keys)
    return own.agg(F.count("*").alias("n"), F.avg(e).alias("mean_error"), F.sqrt(F.avg(e * e)).alias("rmse")).select(F.col("window.start").alias("start"), *keys, "n", "mean_error", "rmse")


def first_epochs(stream: DataFrame, time: str, key: str, late: str) -> DataFrame:
    """The first row of each id and time; repeats within the watermark are dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
