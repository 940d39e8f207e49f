"""Column functions that choose frames to sample."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_positions(total: Column, wanted: Column) -> Column:
    """Distinct evenly spaced indices from 0 to total - 1, rounded half to even."""
    c = F.least(total, wanted)
    spaced = F.transform(F.sequence(F.lit(0), c - 1), lambda i: F.rint(i * ((total - 1) / (c - 1))).cast("int"))
    return F.when((total <= 1) | (wanted <= 1), F.array(F.lit(0))).otherwise(F.array_distinct(spaced))


def sample_step(total: Column, most: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / F.lit(most)))


def video_positions(count: Column, fps: Column, seconds: float, most: int) -> Column:
    """Every interval-th frame index, an interval being so many seconds (30 frames if the rate is unknown), at most ``most``."""
    interval = F.when(fps > 0, F.greatest(F.lit(1), F.bround(fps * F.lit(seconds), 0).cast("int"))).otherwise(30)
    return F.when(count > 0, F.slice(F.sequence(F.lit(0), count - 1, interval), 1, most)).otherwise(F.array().cast("array<int>"))


def preview_positions(count: Column, fps: Column) -> Column:
    """Frame indices of a video's preview: six in a second (of 24 frames if the rate is unknown), 60 at most; each is shown 167 ms."""
    stride = F.greatest(F.lit(1), F.bround(F.when(fps > 0, fps).otherwise(24.0) / 6, 0).cast("int"))
    return F.when(count > 0, F.slice(F.sequence(F.lit(0), count - 1, stride), 1, 60)).otherwise(F.array().cast("array<int>"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-80.0), F.least(F.lit(80.0), x))))
