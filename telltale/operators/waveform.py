"""Channel statistics, spectra and side summaries of fixed-length waveforms.

A channel is one row with its samples as an array; a recording has a fixed number of
channels, so every group below is bounded by the sensor layout.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from telltale.functions.columns import linspace_index

# Class names, sampling, tooth wheel and spectral bands.
CLASSES = ("Normal", "Side I", "Side II")
SAMPLE_RATE = 10_000
TEETH = 90
WHEEL_DIAMETER_M = 0.85
SEGMENT_SAMPLES = 2048
BANDS = ((0, 100), (100, 300), (300, 600), (600, 1200), (1200, 2400), (2400, 5001))
STATISTICS = ("log_rms", "log_std", "log_abs_p95", "log_peak", "crest", "kurtosis", "diff_ratio")
SPECTRAL = ("spectral_centroid_hz", "spectral_entropy", *[f"band_{a}_{min(b, 5000)}_fraction" for a, b in BANDS])
SKETCH_POINTS = 64


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def array_percentile(sorted_values: Column, p: float) -> Column:
    """Linear percentile of an already sorted array."""
    at = (F.size(sorted_values) - 1) * F.lit(p)
    low = F.get(sorted_values, F.floor(at).cast("int"))
    high = F.get(sorted_values, F.ceil(at).cast("int"))
    return low + (high - low) * (at - F.floor(at))


def channel_statistics(df: DataFrame, samples: str = "samples") -> DataFrame:
    """Seven amplitude statistics per channel row, in three passes over the array."""
    s, n = F.col(samples), F.size(samples)
    first = F.aggregate(
        s, F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("sq"), F.lit(0.0).alias("peak")),
        lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["sq"] + x * x).alias("sq"),
                              F.greatest(a["peak"], F.abs(x)).alias("peak")))
    step = df.withColumn("_a", first).withColumn("_mean", F.col("_a.sum") / n)
    second = F.aggregate(
        s, F.struct(F.lit(0.0).alias("m2"), F.lit(0.0).alias("m4"), F.lit(0.0).alias("d2"), F.lit(None).cast("double").alias("p")),
        lambda a, x: F.struct(
            (a["m2"] + (x - F.col("_mean")) ** 2).alias("m2"), (a["m4"] + (x - F.col("_mean")) ** 4).alias("m4"),
            (a["d2"] + F.coalesce((x - a["p"]) ** 2, F.lit(0.0))).alias("d2"), x.alias("p")))
    step = step.withColumn("_b", second)
    std = F.sqrt(F.col("_b.m2") / n)
    rms = F.sqrt(F.col("_a.sq") / n)
    safe = F.greatest(std, F.lit(1e-12))
    p95 = array_percentile(F.array_sort(F.transform(s, F.abs)), 0.95)
    return step.withColumns({
        "rms": rms, "log_rms": F.log1p(rms), "log_std": F.log1p(std), "log_abs_p95": F.log1p(p95),
        "log_peak": F.log1p(F.col("_a.peak")), "crest": F.col("_a.peak") / F.greatest(rms, F.lit(1e-12)),
        "kurtosis": F.col("_b.m4") / n / safe ** 4,
        "diff_ratio": F.sqrt(F.col("_b.d2") / (n - 1)) / safe}).drop("_a", "_b", "_mean")


def _power(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Averaged periodogram: half-overlapping Hann windows, mean removed, one-sided density."""
    width = min(SEGMENT_SAMPLES, len(x))
    hop = width - width // 2
    starts = np.arange(0, len(x) - width + 1, hop)
    frames = x[starts[:, None] + np.arange(width)]
    frames = frames - frames.mean(axis=1, keepdims=True)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(width) / width)
    power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2 / (rate * np.sum(window**2))
    power[:, 1: -1 if width % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(width, 1 / rate), power.mean(axis=0)


def spectrum(df: DataFrame, samples: str = "samples", rate: float = SAMPLE_RATE) -> DataFrame:
    """Centroid, normalised entropy and band shares; the only Python step, one Arrow batch at a time."""
    schema = ", ".join(f"{name} double" for name in SPECTRAL)

    @F.pandas_udf(schema)
    def shape(values: pd.Series) -> pd.DataFrame:
        out = np.empty((len(values), len(SPECTRAL)))
        for row, x in enumerate(values):
            freq, power = _power(np.asarray(x, dtype=float), rate)
            total = max(power.sum(), 1e-30)
            share = power / total
            out[row, 0] = (freq * share).sum()
            out[row, 1] = -(share * np.log(np.maximum(share, 1e-30))).sum() / np.log(len(freq))
            for k, (a, b) in enumerate(BANDS):
                out[row, 2 + k] = power[(freq >= a) & (freq < b)].sum() / total
        return pd.DataFrame(out, columns=list(SPECTRAL))

    return df.withColumn("_s", shape(F.col(samples))).select("*", "_s.*").drop("_s")


def side_summary(channels: DataFrame, metrics: tuple[str, ...] = STATISTICS) -> DataFrame:
    """Median and maximum per side, kind and metric: at most 32 channels each."""
    ids = ["file_id", "side", "kind"]
    cells = channels.select(*ids, *metrics).unpivot(ids, list(metrics), "metric", "v")
    return cells.groupBy(*ids, "metric").agg(F.percentile("v", 0.5).alias("median"), F.max("v").alias("max"))


def side_contrast(summary: DataFrame, metrics: tuple[str, ...] = ("log_rms", "log_peak", "kurtosis")) -> DataFrame:
    """Signed difference of the side medians, Side I minus Side II."""
    chosen = summary.where(F.col("metric").isin(*metrics))
    side = lambda name: F.max(F.when(F.col("side") == name, F.col("median")))
    return chosen.groupBy("file_id", "kind", "metric").agg((side("side_i") - side("side_ii")).alias("contrast"))


def pulse_speed(df: DataFrame, pulse: str = "pulse", rate: float = SAMPLE_RATE) -> DataFrame:
    """Rising tooth edges, running speed in m/s and the share of time the pulse is high."""
    p = F.col(pulse)
    edges = F.aggregate(
        p, F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("p")),
        lambda a, x: F.struct((a["n"] + F.coalesce((x > a["p"]).cast("int"), F.lit(0))).alias("n"), x.alias("p")))["n"]
    seconds = F.size(p) / F.lit(float(rate))
    return df.withColumns({
        "rising_edges": edges, "speed_m_s": edges / seconds / TEETH * math.pi * WHEEL_DIAMETER_M,
        "pulse_duty": array_sum(p) / F.size(p)})


def largest_channel(channels: DataFrame) -> DataFrame:
    """The channel with the largest RMS per side and kind; a tie goes to the first position."""
    return channels.groupBy("file_id", "side", "kind").agg(
        F.max_by("position", F.struct("rms", -F.col("position"))).alias("position"), F.max("rms").alias("rms"))


def sketch_columns(df: DataFrame, samples: str = "samples", points: int = SKETCH_POINTS) -> DataFrame:
    """Evenly spaced float32 sketch, mean and RMS, and a content hash of the exact samples."""
    s, n = F.col(samples), F.size(samples).cast("long")
    k = F.least(F.lit(points).cast("long"), n)
    sketch = F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda i: F.get(
        s, linspace_index(i, n, k).cast("int")).cast("float").cast("double"))
    return df.withColumns({
        "n_samples": n, "sketch": sketch,
        "signature": F.array(array_sum(s) / n, F.sqrt(array_sum(F.transform(s, lambda x: x * x)) / n)),
        "numeric_sha256": F.sha2(F.array_join(F.transform(s, lambda x: x.cast("string")), ","), 256)})
