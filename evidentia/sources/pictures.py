"""Pictures as Spark's image source decodes them: difference hashes for near duplicates, crops of regions as PNG.

``images`` have the column ``image`` of ``spark.read.format("image")``: rows of pixels from the top, one to four bytes each, blue first. Only the
pixels' arithmetic is Python, over batches; reading, dealing and joining are Spark's. A picture that cannot be decoded has null results.
"""

from __future__ import annotations

import functools
import math
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

#: A hash compares neighbours in a picture of this many columns and rows (fixed values).
COLUMNS, ROWS = 9, 8
#: Weights of red, green and blue in 65536ths, and the bits of a resampling weight (fixed values).
GREY, BITS = (19595, 38470, 7471), 22


def images(spark: SparkSession, path: str) -> DataFrame:
    """origin, width, height, image of every picture below a path; files that are none are left out."""
    found = spark.read.format("image").option("dropInvalid", True).load(path)
    return found.select("image.origin", "image.width", "image.height", "image")


@functools.lru_cache(256)
def weights(size: int, wanted: int) -> np.ndarray:
    """wanted x size whole numbers: the cubic kernel (-1/2) over what each wanted place covers of ``size`` places."""
    step = size / wanted
    wide = max(step, 1.0)
    out = np.zeros((wanted, size), np.int64)
    for i in range(wanted):
        middle = (i + 0.5) * step
        low, high = max(0, int(middle - 2 * wide + 0.5)), min(size, int(middle + 2 * wide + 0.5))
        x = np.abs((np.arange(low, high) - middle + 0.5) / wide)
        k = np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, -0.5 * (((x - 5) * x + 8) * x - 4), 0.0))
        k = k / k.sum() * (1 << BITS)
        out[i, low:high] = np.trunc(k + np.where(k < 0, -0.5, 0.5))
    return out


def shrunk(grey: np.ndarray, across: int = COLUMNS, down: int = ROWS) -> np.ndarray:
    """Rows first, then columns, each rounded to 0 ... 255."""
    rounded = lambda x: np.clip((x + (1 << BITS - 1)) >> BITS, 0, 255)
    if grey.shape[1] != across:
        grey = rounded(grey @ weights(grey.shape[1], across).T)
    return grey if grey.shape[0] == down else rounded(weights(grey.shape[0], down) @ grey)


def _pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray | None:
    raw = np.frombuffer(data, np.uint8)
    return raw.reshape(height, width, channels) if height > 0 and width > 0 and channels in (1, 3, 4) and len(raw) == height * width * channels else None


def _grey(pixels: np.ndarray) -> np.ndarray:
    if pixels.shape[2] == 1:
        return pixels[:, :, 0].astype(np.int64)
    return (pixels[:, :, 2] * np.int64(GREY[0]) + pixels[:, :, 1] * np.int64(GREY[1]) + pixels[:, :, 0] * np.int64(GREY[2]) + 0x8000) >> 16


@F.pandas_udf(StringType())
def difference_hash(image: pd.DataFrame) -> pd.Series:
    """16 hex digits: row by row, whether each place of the shrunk grey picture is brighter than the next one."""

    def one(height, width, channels, data):
        pixels = None if data is None else _pixels(height, width, channels, data)
        if pixels is None:
            return None
        small = shrunk(_grey(pixels))
        return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()

    return pd.Series([one(*r) for r in zip(image["height"], image["width"], image["nChannels"], image["data"], strict=True)], dtype=object)


def hashed(found: DataFrame) -> DataFrame:
    """The rows of ``images`` with ``hash`` in place of the pixels."""
    return found.withColumn("hash", difference_hash("image")).drop("image")


def crop_box(region: Column, width: Column, height: Column) -> Column:
    """struct of left, top, right, bottom in pixels of a region (x, y, width, height as shares): held within the picture, a pixel at least; null if the region is null or empty."""
    within = lambda c, most: F.least(most, F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0))))
    x, y = within(region["x"], F.lit(1.0)), within(region["y"], F.lit(1.0))
    w, h = within(region["width"], F.lit(1.0) - x), within(region["height"], F.lit(1.0) - y)
    at = lambda share, size: F.bround(share * size, 0).cast("int")
    left, top = at(x, width), at(y, height)
    box = F.struct(left.alias("left"), top.alias("top"), F.least(width, F.greatest(left + 1, at(x + w, width))).alias("right"), F.least(height, F.greatest(top + 1, at(y + h, height))).alias("bottom"))
    return F.when(region.isNotNull() & (w > 0) & (h > 0) & (left < width) & (top < height), box)


def png(pixels: np.ndarray) -> bytes:
    """A PNG file of rows of pixels, red first."""
    height, width, channels = pixels.shape
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, width * channels)], axis=1)
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


@F.pandas_udf(BinaryType())
def _cut_out(image: pd.DataFrame, box: pd.DataFrame) -> pd.Series:
    def one(height, width, channels, data, left, top, right, bottom):
        pixels = None if data is None or left is None or math.isnan(left) else _pixels(height, width, channels, data)
        if pixels is None:
            return None
        part = pixels[int(top) : int(bottom), int(left) : int(right)]
        return png(np.ascontiguousarray(part if channels == 1 else part[:, :, 2::-1]))

    cols = [*(image[c] for c in ("height", "width", "nChannels", "data")), *(box[c] for c in ("left", "top", "right", "bottom"))]
    return pd.Series([one(*r) for r in zip(*cols, strict=True)], dtype=object)


def crops(candidates: DataFrame, assets: DataFrame, found: DataFrame) -> DataFrame:
    """candidate_key, asset_id, box, crop (PNG) of candidates (candidate_key, asset_id, region) whose asset (asset_id, origin) is among ``images``; others have no row.

    Only pictures that a candidate names are cut; one picture may serve many candidates. Repeated candidates and assets give repeated rows.
    """
    wanted = candidates.where("asset_id is not null and region is not null").join(assets.select("asset_id", "origin"), "asset_id")
    both = wanted.join(found, "origin").withColumn("box", crop_box(F.col("region"), F.col("width"), F.col("height"))).where("box is not null")
    return both.select("candidate_key", "asset_id", "box", _cut_out("image", "box").alias("crop"))


def words_confidence(words: Column) -> Column:
    """The mean confidence (0 to 1, from percentages) of an array of recognised words (text, confidence) that have text and a confidence of 0 or more; null without any."""
    fit = F.filter(words, lambda w: (F.trim(w["text"]) != "") & (w["confidence"] >= 0))
    return F.when(F.size(fit) > 0, F.aggregate(fit, F.lit(0.0), lambda a, w: a + w["confidence"]) / F.size(fit) / 100)
