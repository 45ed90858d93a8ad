"""Result tables of experiments as CSV, with their customary headers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.evaluate import running


def accuracy_table(accuracies: DataFrame, label_seconds: float = 0.0, stream_seconds: float = 0.0) -> DataFrame:
    """index, currAcc, avgAcc, labelTime, streamTime: a row for each trajectory in order of tid (from evaluate.accuracy).

    The times are what the driver measured for the whole run, spread evenly over the trajectories."""
    t = running(accuracies, {"k": F.lit(1), "all": F.col("acc")})
    n = t.count()
    return t.select((F.col("k") - 1).cast("int").alias("index"), F.col("acc").alias("currAcc"), (F.col("all") / F.col("k")).alias("avgAcc"), F.lit(label_seconds / max(n, 1)).alias("labelTime"), F.lit(stream_seconds / max(n, 1)).alias("streamTime"))


def point_table(accuracies: DataFrame) -> DataFrame:
    """TrajectoryIndex, currPointNum, totalPointNum, currAcc, totalAcc."""
    t = running(accuracies, {"k": F.lit(1), "total": F.col("n"), "wrong": F.col("errors")})
    return t.select((F.col("k") - 1).cast("int").alias("TrajectoryIndex"), F.col("n").alias("currPointNum"), F.col("total").alias("totalPointNum"), F.col("acc").alias("currAcc"), (1 - F.col("wrong") / F.col("total")).alias("totalAcc"))


def write_csv(table: DataFrame, path: str) -> None:
    """With a header; a folder of part files."""
    table.write.csv(path, header=True)


def write_lines(geojson: DataFrame, path: str, column: str = "geojson") -> None:
    """One document a line."""
    geojson.select(column).write.text(path)
