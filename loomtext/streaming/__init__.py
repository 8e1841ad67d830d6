"""Patterns over streams.

Every column function is a function of its row alone, so it works on streaming DataFrames unchanged, with no state and
no watermark; what follows (windows, counts) is Spark's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import columns as K


def parsed(stream: DataFrame, column: str, p, into: str = "value", kind=None) -> DataFrame:
    """The rows whose text the pattern matches, with its result."""
    return stream.withColumn(into, K.try_parse(column, p, kind)).where(F.col(into).isNotNull())


def counted(stream: DataFrame, time: str, column: str, p, window: str = "1 hour", late: str = "1 hour", kind=None) -> DataFrame:
    """Counts of each result by window of event time; rows later than ``late`` are let go, as Spark's watermark does."""
    rows = parsed(stream.withWatermark(time, late), column, p, "value", kind)
    return rows.groupBy(F.window(time, window).alias("window"), "value").agg(F.count(F.lit(1)).alias("n"))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the lines of the text files that come into a folder."""
    return spark.readStream.text(folder)
