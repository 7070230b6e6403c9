"""What is computed from the pixels of a picture: its perceptual hash and its measures of detail.

A picture comes as 32 x 32 grey values, row by row, with the orientation in which it is shown. Arrow batches of pictures are
turned and transformed as arrays; nothing is decoded here and no row is handled on its own.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from ..registry import query
from .picture_sql import MEASURED_SQL

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The side of a hash's input, the side of the block of low frequencies that it keeps.
SIDE, LOW = 32, 8

SCHEMA = "content_id long, phash string, mean_brightness double, mean_gradient double"


def upright(pixels: np.ndarray, orientation: np.ndarray) -> np.ndarray:
    """Pictures (n x 32 x 32) as they are shown. Orientations (fixed values) 1 and beyond 8 need no turn."""
    turns = {2: lambda a: a[:, :, ::-1], 3: lambda a: a[:, ::-1, ::-1], 4: lambda a: a[:, ::-1], 5: lambda a: a.transpose(0, 2, 1), 6: lambda a: a.transpose(0, 2, 1)[:, :, ::-1], 7: lambda a: a[:, ::-1, ::-1].transpose(0, 2, 1), 8: lambda a: a.transpose(0, 2, 1)[:, ::-1]}
    out = pixels.copy()
    for kind, turn in turns.items():
        some = orientation == kind
        out[some] = turn(pixels[some])
    return out


def cosines() -> np.ndarray:
    """The first LOW rows of the cosine transform of SIDE values."""
    return 2 * np.cos(np.pi * np.outer(np.arange(LOW), 2 * np.arange(SIDE) + 1) / (2 * SIDE))


def perceptual_hashes(pixels: np.ndarray) -> np.ndarray:
    """64 bits a picture: where a low frequency of rows and columns is above the median of them all, row by row."""
    c = cosines()
    low = (c @ pixels @ c.T).reshape(len(pixels), LOW * LOW)
    return low > np.median(low, axis=1, keepdims=True)


def measures(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean brightness, and the mean length of the gradient: half the neighbours' difference inside, the whole step at an edge."""
    gy, gx = np.gradient(pixels, axis=(1, 2))
    return pixels.mean(axis=(1, 2)), np.hypot(gx, gy).mean(axis=(1, 2))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole = [p is not None and len(p) == SIDE * SIDE and None not in p for p in batch.column("pixels").to_pylist()]
        fit = batch.filter(pa.array(whole, pa.bool_()))
        bits, bright, steep = np.zeros((0, 64), bool), np.zeros(0), np.zeros(0)
        if fit.num_rows:
            pixels = fit.column("pixels").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, SIDE, SIDE)
            turned = upright(pixels, fit.column("orientation").fill_null(1).to_numpy(zero_copy_only=False))
            bits, (bright, steep) = perceptual_hashes(turned), measures(turned)
        names = [raw.tobytes().hex() for raw in np.packbits(bits, axis=1)]
        place = np.cumsum(whole) - 1
        pick = lambda values: [values[k] if ok else None for k, ok in zip(place, whole, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("content_id"), pa.array(pick(names), pa.string()), pa.array(pick(bright.tolist()), pa.float64()), pa.array(pick(np.round(steep, 6).tolist()), pa.float64())], names=["content_id", "phash", "mean_brightness", "mean_gradient"]
        )


def measured(pictures: DataFrame) -> DataFrame:
    """pictures: content_id, orientation, pixels. Hash and measures; null for one that isn't 32 x 32 values."""
    return pictures.select("content_id", "orientation", "pixels").mapInArrow(_measure, SCHEMA)


@query("picture_hashes", f"SELECT content_id, phash FROM ({MEASURED_SQL})")
def picture_hashes(pictures: DataFrame) -> DataFrame:
    return measured(pictures).select("content_id", "phash")


@query("picture_measures", f"SELECT content_id, mean_brightness, mean_gradient FROM ({MEASURED_SQL})")
def picture_measures(pictures: DataFrame) -> DataFrame:
    return measured(pictures).select("content_id", "mean_brightness", "mean_gradient")
