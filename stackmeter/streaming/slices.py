"""Structured Streaming over arriving frames (an addition to the batch operators).

The depth projection is a per-pixel running maximum, so its state for a stack is one
frame: value, slice and sharpness.  Late slices may come in any order; equal sharpness
goes to the lower slice, so the result does not depend on the order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..kernels import image

OUT = "stack int, n_slices int, height int, width int, edf array<double>, best_z array<int>, peak array<double>"
STATE = "n_slices int, height int, width int, edf array<double>, best_z array<int>, peak array<double>"


def _update(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, shape, value, best, peak = 0, None, None, None, None
    if state.exists:
        n, h, w, value, best, peak = state.get
        shape, value, best, peak = (h, w), np.asarray(value), np.asarray(best), np.asarray(peak)
    for pdf in parts:
        for z, px, h, w in zip(pdf["z"], pdf["px"], pdf["height"], pdf["width"], strict=True):
            a = np.asarray(px, dtype=np.float64)
            sharp = np.round(image.tenengrad(a.reshape(h, w)).reshape(-1), 6)
            n += 1
            if shape is None:
                shape, value, best, peak = (h, w), a, np.full(a.shape, z), sharp
                continue
            new = (sharp > peak) | ((sharp == peak) & (z < best))
            value, best, peak = np.where(new, a, value), np.where(new, z, best), np.where(new, sharp, peak)
    held = (n, int(shape[0]), int(shape[1]), value.tolist(), [int(b) for b in best], peak.tolist())
    state.update(held)
    yield pd.DataFrame([(key[0], *held)], columns=["stack", "n_slices", "height", "width", "edf", "best_z", "peak"])


def projected(stream: DataFrame) -> DataFrame:
    """A stream of frames (stack, z, height, width, px) to each stack's projection so far."""
    return stream.groupBy("stack").applyInPandasWithState(_update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def profile(stream: DataFrame) -> DataFrame:
    """Running mean intensity of each slice of a stream of exploded pixels (stack, z, v)."""
    return stream.groupBy("stack", "z").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n"))
