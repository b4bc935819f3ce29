"""Synthetic images: (img, r, c, v) as closed forms over a grid; r and c count from 0, centres follow the 1-based convention."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, h: int, w: int) -> DataFrame:
    p = F.col("id")
    return spark.range(h * w).select(F.floor(p / w).cast("int").alias("r"), (p % w).cast("int").alias("c"))


def _centred(h: int, w: int) -> tuple[Column, Column]:
    return F.col("c") + 1 - (w + 1) / 2, F.col("r") + 1 - (h + 1) / 2


def ramp(spark: SparkSession, h: int, w: int, direction: float = 0.0, slope: float = 1.0, intercept: float = 0.0) -> DataFrame:
    x, y = _centred(h, w)
    return grid(spark, h, w).select("r", "c", (x * (slope * math.cos(direction)) + y * (slope * math.sin(direction)) + intercept).alias("v"))


def radius(spark: SparkSession, h: int, w: int, exponent: float = 1.0) -> DataFrame:
    x, y = _centred(h, w)
    return grid(spark, h, w).select("r", "c", F.pow(x * x + y * y, F.lit(exponent / 2)).alias("v"))


def angle(spark: SparkSession, h: int, w: int, phase: float = 0.0) -> DataFrame:
    x, y = _centred(h, w)
    a = F.atan2(y, x) + (math.pi - phase)
    return grid(spark, h, w).select("r", "c", (F.pmod(a, F.lit(2 * math.pi)) - math.pi).alias("v"))


def soft_step(x: Column, width: float, position: float, left: float, right: float, size: int = 256) -> Column:
    """Raised-cosine step from ``left`` to ``right`` about a position, linear between the samples of a table of ``size`` steps."""
    at = size / 2 + 1 + size * (x - position) / width
    i = F.greatest(F.lit(0), F.least(F.floor(at), F.lit(size + 1)))
    y = lambda k: left + (right - left) * F.pow(F.cos(math.pi / (2 * size) * (F.greatest(F.lit(1), F.least(k, F.lit(size + 1))) - size - 1)), F.lit(2.0))
    return y(i) + F.greatest(F.lit(0.0), F.least(at - i, F.lit(1.0))) * (y(i + 1) - y(i))


def disc(spark: SparkSession, h: int, w: int, rad: float, soft: float = 0.0, inside: float = 1.0, outside: float = 0.0) -> DataFrame:
    """A disc; its edge is ``soft`` pixels wide."""
    x, y = _centred(h, w)
    if not soft:
        return grid(spark, h, w).select("r", "c", F.when(x * x + y * y <= rad * rad, inside).otherwise(outside).alias("v"))
    return grid(spark, h, w).select("r", "c", soft_step(F.sqrt(x * x + y * y), soft, rad, inside, outside).alias("v"))


def gaussian(spark: SparkSession, h: int, w: int, variance: float | tuple[tuple[float, float], tuple[float, float]], amplitude: float | None = None) -> DataFrame:
    """A Gaussian of a variance or a covariance matrix ((rows, both), (both, columns)), of integral 1 unless an amplitude is given."""
    x, y = _centred(h, w)
    (p, q), (q2, s) = variance if isinstance(variance, tuple) else ((variance, 0.0), (0.0, variance))
    det = p * s - q * q2
    if not (p > 0 and det > 0):
        raise ValueError("the covariance is not positive")
    top = 1 / (2 * math.pi * math.sqrt(det)) if amplitude is None else amplitude
    return grid(spark, h, w).select("r", "c", (top * F.exp((p * x * x - (q + q2) * x * y + s * y * y) / (-2 * det))).alias("v"))


def square(spark: SparkSession, h: int, w: int, period: float, direction: float = 0.0, amplitude: float = 1.0, phase: float = 0.0, soft: float | None = None) -> DataFrame:
    """A square wave; its edges are ``soft`` pixels wide (2, or a third of the period if that is less)."""
    f = 2 * math.pi / period
    soft = min(2.0, period / 3) if soft is None else soft
    x, y = _centred(h, w)
    wave = x * (f * math.cos(direction)) + y * (f * math.sin(direction)) + phase - math.pi / 2
    folded = F.abs(F.pmod(wave + math.pi, F.lit(2 * math.pi)) - math.pi)
    return grid(spark, h, w).select("r", "c", soft_step(folded, soft * f, math.pi / 2, -amplitude, amplitude).alias("v"))


def angular_sine(spark: SparkSession, h: int, w: int, harmonic: float = 1.0, amplitude: float = 1.0, phase: float = 0.0) -> DataFrame:
    """A sine of the angle about the centre; the phase enters the angle and the sine, as is customary."""
    return angle(spark, h, w, phase).select("r", "c", (amplitude * F.sin(harmonic * F.col("v") + phase)).alias("v"))


def triangle(spark: SparkSession, steps: int) -> DataFrame:
    """(red, green, blue) of the plane red + green + blue = 1, on a grid of shares."""
    g = grid(spark, steps + 1, steps + 1).select((F.col("r") / steps).alias("red"), (F.col("c") / steps).alias("green"))
    return g.withColumn("blue", F.round(1 - F.col("red") - F.col("green"), 12)).where(F.col("blue") >= 0)


def zone_plate(spark: SparkSession, h: int, w: int, amplitude: float = 1.0, phase: float = 0.0) -> DataFrame:
    x, y = _centred(h, w)
    return grid(spark, h, w).select("r", "c", (amplitude * F.cos((math.pi / max(h, w)) * (x * x + y * y) + phase)).alias("v"))


def sine(spark: SparkSession, h: int, w: int, period: float, direction: float = 0.0, amplitude: float = 1.0, phase: float = 0.0) -> DataFrame:
    k = 2 * math.pi / period
    wave = k * math.cos(direction) * F.col("c") + k * math.sin(direction) * F.col("r") + phase
    return grid(spark, h, w).select("r", "c", (amplitude * F.sin(wave)).alias("v"))


def impulse(spark: SparkSession, h: int, w: int, amplitude: float = 1.0) -> DataFrame:
    return grid(spark, h, w).select("r", "c", F.when((F.col("r") == math.ceil((h + 1) / 2) - 1) & (F.col("c") == math.ceil((w + 1) / 2) - 1), amplitude).otherwise(0.0).alias("v"))
