"""Weights and scores by the quality of positions and headings, as columns; operators.baselines has them for plain numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.geo import col


def distance_weight(hdop, low: float, high: float) -> Column:
    h = col(hdop)
    return F.when(h <= low, 1.0).when(h < high, (h - low) / (high - low)).otherwise(0.0)


def heading_score(road_angle, turned, step: int) -> Column:
    return (1 + float(step == 1) * F.cos(F.radians(col(road_angle))) + float(step == 2) * F.cos(F.radians(col(turned)))) / 2


def heading_weight(speed, before, low: float, high: float) -> Column:
    v, b = col(speed), col(before)
    return F.when((v < low) | (b < low), 0.0).when((v > high) & (b > high), 1.0).otherwise((v + b - 2 * low) / (2 * (high - low)))
