"""Pixel formats: conversions of packed images in numpy, and their parameters as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes per pixel of packed formats, luma weights, the letterbox's grey.
BYTES_PER_PIXEL = {"Rgb8": 3, "Bgr8": 3, "Rgba8": 4, "Gray8": 1}
LUMA = (0.299, 0.587, 0.114)
GREY = 114
CONVERSIONS = (("Bgr8", "Rgb8"), ("Rgb8", "Bgr8"), ("Rgba8", "Rgb8"), ("Rgb8", "Gray8"))


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.floor(r * LUMA[0] + g * LUMA[1] + b * LUMA[2] + 0.5).cast("long")


def convert(image: np.ndarray, source: str, target: str) -> np.ndarray:
    """(h, w, channels) of uint8 in another format; pairs outside CONVERSIONS are an error."""
    if (source, target) not in CONVERSIONS:
        raise ValueError(f"no conversion from {source} to {target}")
    if image.shape[2] != BYTES_PER_PIXEL[source]:
        raise ValueError(f"{source} has {BYTES_PER_PIXEL[source]} bytes a pixel, the image {image.shape[2]}")
    if target == "Gray8":
        return np.floor(image @ np.array(LUMA) + 0.5).astype(np.uint8)[:, :, None]
    return image[:, :, :3] if source == "Rgba8" else image[:, :, ::-1]


def convert_column(data: Column, width: Column, height: Column, source: str, target: str) -> Column:
    """``convert`` over a binary column; null where the bytes do not fill the image."""
    size = BYTES_PER_PIXEL[source]

    @F.pandas_udf("binary")
    def run(raw: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        ok = [b is not None and len(b) == x * y * size for b, x, y in zip(raw, w, h, strict=True)]
        return pd.Series([convert(np.frombuffer(b, np.uint8).reshape(y, x, size), source, target).tobytes() if good else None for b, x, y, good in zip(raw, w, h, ok, strict=True)])

    return run(data, width, height)


def letterbox(width: Column, height: Column, target: int) -> dict[str, Column]:
    """Scale, scaled size and padding that fit an image into a square."""
    scale = F.least(F.lit(float(target)) / width, F.lit(float(target)) / height)
    new_w, new_h = F.floor(width * scale + 0.5), F.floor(height * scale + 0.5)
    return {"scale": scale, "new_w": new_w, "new_h": new_h, "pad_x": (target - new_w) / 2.0, "pad_y": (target - new_h) / 2.0}


def remap(x: Column, pad: Column, scale: Column, size: Column) -> Column:
    """A letterbox coordinate as a share of the original side, within it."""
    return F.greatest(F.lit(0.0), F.least((x - pad) / scale, size)) / size


def letterbox_image(image: np.ndarray, target: int) -> np.ndarray:
    """(1, 3, target, target) of float32 in [0, 1]: nearest neighbours on grey."""
    h, w = image.shape[:2]
    scale = min(target / w, target / h)
    new_w, new_h = int(w * scale + 0.5), int(h * scale + 0.5)
    left, top = (target - new_w) // 2, (target - new_h) // 2
    out = np.full((target, target, 3), GREY, dtype=np.uint8)
    ys = np.minimum((np.arange(new_h) / scale).astype(int), h - 1)
    xs = np.minimum((np.arange(new_w) / scale).astype(int), w - 1)
    out[top : top + new_h, left : left + new_w] = image[ys][:, xs, :3]
    return (out.astype(np.float32) / 255).transpose(2, 0, 1)[None]
