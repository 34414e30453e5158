"""Generated series: a week of sinusoids or weather, with seeded noise."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _week(spark: SparkSession, minutes: int) -> DataFrame:
    return spark.range(7 * 24 * 60 // minutes).select((F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * minutes * 60)).cast("timestamp_ntz").alias("timestamp"), (F.col("id") * minutes / 1440.0).alias("day"))


def _wave(mean: float, swing: float, shift: float, noise: float, seed: int) -> Column:
    return F.lit(mean) + swing * F.sin(2 * math.pi * (F.col("day") + shift)) + noise * (F.rand(seed) - 0.5)


def sinusoids(spark: SparkSession, seed: int = 1) -> DataFrame:
    columns = {"temperature": _wave(20, 5, 0, 1, seed), "humidity": _wave(60, 10, 0.25, 2, seed + 1), "pressure": _wave(1013, 3, 0.5, 1, seed + 2)}
    return _week(spark, 15).select("timestamp", *[c.alias(n) for n, c in columns.items()])


def weather(spark: SparkSession, seed: int = 1) -> DataFrame:
    columns = {"temperature": _wave(15, 8, 0, 2, seed), "humidity": _wave(55, 20, 0.5, 5, seed + 1), "pressure": _wave(1013, 5, 0.25, 1, seed + 2), "wind_speed": F.abs(_wave(5, 3, 0.75, 4, seed + 3))}
    return _week(spark, 10).select("timestamp", *[c.alias(n) for n, c in columns.items()])
