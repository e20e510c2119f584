"""Pixels of images for a scorer: letterboxing and projective crops, on Arrow batches, since they resample."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Steps of an interpolation weight, and means and deviations of channels (blue, green, red).
STEPS = 2048
MEAN, DEVIATION = (0.406, 0.456, 0.485), (0.225, 0.224, 0.229)


def _weights(n: int, fitted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = (np.arange(fitted) + 0.5) * n / fitted - 0.5
    low = np.floor(at)
    part = np.rint((at - low) * STEPS).astype(np.int64)
    low = low.astype(np.int64)
    return np.clip(low, 0, n - 1), np.clip(low + 1, 0, n - 1), part


def resized(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, with weights in whole steps, rounded to whole values."""
    y0, y1, wy = _weights(image.shape[0], h)
    x0, x1, wx = _weights(image.shape[1], w)
    rows = image.astype(np.int64)
    wx, wy = wx[None, :, None], wy[:, None, None]
    top = rows[y0][:, x0] * (STEPS - wx) + rows[y0][:, x1] * wx
    low = rows[y1][:, x0] * (STEPS - wx) + rows[y1][:, x1] * wx
    total = top * (STEPS - wy) + low * wy
    return (total + STEPS * STEPS // 2) // (STEPS * STEPS)


def letterboxed(image: np.ndarray, size: int) -> np.ndarray:
    """The image fitted into a white square, in units of the channels' deviations, channels first."""
    h, w = image.shape[:2]
    scale = size / max(h, w)
    fit = lambda n: max(1, int(np.rint(n * scale)))
    out = np.full((size, size, 3), 255.0)
    top, left = (size - fit(h)) // 2, (size - fit(w)) // 2
    out[top : top + fit(h), left : left + fit(w)] = resized(image, fit(h), fit(w))
    return ((out / 255 - MEAN) / DEVIATION).transpose(2, 0, 1)


def cropped(image: np.ndarray, coefficients: list[float], width: int, height: int, full: int) -> np.ndarray:
    """A crop of width x height sampled through projective coefficients, from -1 to 1, then zeros up to the full width."""
    c = coefficients
    y, x = np.mgrid[0:height, 0:width].astype(float)
    below = c[6] * x + c[7] * y + 1
    px, py = (c[0] * x + c[1] * y + c[2]) / below, (c[3] * x + c[4] * y + c[5]) / below
    h, w = image.shape[:2]
    px, py = np.clip(px, 0, w - 1), np.clip(py, 0, h - 1)
    x0, y0 = np.floor(px).astype(int), np.floor(py).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = (px - x0)[..., None], (py - y0)[..., None]
    value = (image[y0, x0] * (1 - fx) + image[y0, x1] * fx) * (1 - fy) + (image[y1, x0] * (1 - fx) + image[y1, x1] * fx) * fy
    out = np.zeros((height, full, 3))
    out[:, :width] = value / 127.5 - 1
    return out.transpose(2, 0, 1)


def _image(row) -> np.ndarray:
    return np.frombuffer(row["pixels"], np.uint8).reshape(row["h"], row["w"], 3)


def letterbox(images: DataFrame, size: int = 224, key: str = "path") -> DataFrame:
    """key and tensor (channels first, row by row) of images (key, h, w, pixels) that have pixels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "tensor": [letterboxed(_image(r), size).ravel().astype(np.float32) for r in pdf.to_dict("records")]})

    return images.where("pixels is not null").select(key, "h", "w", "pixels").mapInPandas(run, f"{key} string, tensor array<float>")


def crop(images: DataFrame, quads: DataFrame, height: int = 48, full: int = 640, key: str = "path") -> DataFrame:
    """key, slot and tensor of each quad (key, slot, coefficients, width) of an image."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tensors = [cropped(_image(r), list(r["coefficients"]), int(r["width"]), height, full).ravel().astype(np.float32) for r in pdf.to_dict("records")]
            yield pd.DataFrame({key: pdf[key], "slot": pdf["slot"], "tensor": tensors})

    rows = quads.where("coefficients is not null").join(images.where("pixels is not null"), key).select(key, "slot", "coefficients", "width", "h", "w", "pixels")
    return rows.mapInPandas(run, f"{key} string, slot int, tensor array<float>")


def scored(df: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """df through a model: a function from a batch to rows of a schema, which is all that the engine knows of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield model(pdf)

    return df.mapInPandas(run, schema)
