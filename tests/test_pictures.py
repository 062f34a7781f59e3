"""Hashes and crops of pictures written here, against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import neardup
from evidentia.sources import pictures


def plain_hash(rgb):
    """The same hash, one number at a time."""
    grey = [[(r * 19595 + g * 38470 + b * 7471 + 32768) // 65536 for r, g, b in row] for row in rgb.tolist()]

    def kernel(x):
        x = abs(x)
        return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0

    def line(values, n):
        if len(values) == n:
            return values
        step, out = len(values) / n, []
        wide = max(1.0, step)
        for i in range(n):
            at = (i + 0.5) * step
            places = range(max(0, int(at - 2 * wide + 0.5)), min(len(values), int(at + 2 * wide + 0.5)))
            w = [kernel((p + 0.5 - at) / wide) for p in places]
            whole = [math.trunc(x / sum(w) * 4194304 + (0.5 if x >= 0 else -0.5)) for x in w]
            out.append(min(255, max(0, (sum(values[p] * k for p, k in zip(places, whole, strict=True)) + 2097152) // 4194304)))
        return out

    rows = [line(r, 9) for r in grey]
    columns = [line([r[i] for r in rows], 8) for i in range(9)]
    bits = "".join("1" if columns[i][j] > columns[i + 1][j] else "0" for j in range(8) for i in range(8))
    return f"{int(bits, 2):016x}"


@pytest.fixture(scope="module")
def drawn(tmp_path_factory):
    rng = np.random.default_rng(4)
    out = {f"{w}x{h}": rng.integers(0, 256, (h, w, 3), dtype=np.uint8) for w, h in ((9, 8), (9, 40), (31, 8), (5, 3), (64, 48), (101, 77), (1, 1))}
    ramp = np.repeat(np.linspace(250, 5, 90).astype(np.uint8)[None, :], 60, axis=0)
    out["falling"], out["rising"] = np.stack([ramp] * 3, 2), np.stack([ramp[:, ::-1]] * 3, 2)
    # the same picture at another size
    out["larger"] = np.repeat(np.repeat(out["64x48"], 2, 0), 2, 1)
    folder = tmp_path_factory.mktemp("pictures")
    for name, rgb in out.items():
        (folder / f"{name}.png").write_bytes(pictures.png(rgb))
    (folder / "grey.png").write_bytes(pictures.png(ramp[:, :, None]))
    (folder / "torn.png").write_bytes(b"\x89PNG no")
    return str(folder), out


def named(df):
    return df.withColumn("name", F.regexp_extract("origin", r"([^/]+)\.png$", 1))


def test_hashes(spark, drawn):
    folder, out = drawn
    found = {r["name"]: (r["hash"], r["width"], r["height"]) for r in named(pictures.hashed(pictures.images(spark, folder))).collect()}
    assert set(found) == {*out, "grey"}
    for name, rgb in out.items():
        assert found[name] == (plain_hash(rgb), rgb.shape[1], rgb.shape[0]), name
    assert found["falling"][0] == found["grey"][0] == "f" * 16 and found["rising"][0] == "0" * 16


def test_look_alikes_by_their_pixels(spark, drawn):
    folder, _ = drawn
    rows = named(pictures.hashed(pictures.images(spark, folder))).where("name in ('64x48', 'larger', 'falling', 'grey', 'rising')")
    none = F.lit(None).cast("string")
    priority = F.when(F.col("name").isin("larger", "grey"), 2.0).otherwise(1.0)
    assets = rows.select(F.col("name").alias("asset_id"), priority.alias("priority"), F.xxhash64("name").alias("ordinal"), "name", none.alias("url"), "hash", "width", "height", none.alias("ocr")).withColumnRenamed("name", "sha")
    kept = {r.asset_id: (r.kept, r.duplicate_of) for r in neardup.deduplicate(assets).collect()}
    assert kept["larger"] == kept["grey"] == (True, None) and kept["rising"] == (True, None)
    assert kept["falling"] == (False, "grey") and kept["64x48"] == (False, "larger")


def plain_box(region, width, height):
    if region is None:
        return None
    x, y = (min(1.0, max(0.0, region[k] or 0.0)) for k in "xy")
    w, h = min(1.0 - x, max(0.0, region["width"] or 0.0)), min(1.0 - y, max(0.0, region["height"] or 0.0))
    left, top = round(x * width), round(y * height)
    if w <= 0 or h <= 0 or left >= width or top >= height:
        return None
    return left, top, min(width, max(left + 1, round((x + w) * width))), min(height, max(top + 1, round((y + h) * height)))


def test_crops(spark, drawn):
    folder, out = drawn
    rng = random.Random(8)
    share = lambda: rng.choice([None, -0.5, 0.0, 0.5, 1.0, 1.5, rng.random(), rng.random()])
    regions = [None, *({"x": share(), "y": share(), "width": share(), "height": share()} for _ in range(200))]
    names = [rng.choice(["64x48", "101x77", "1x1", "gone"]) for _ in regions]
    found = named(pictures.images(spark, folder))
    assets = found.select(F.col("name").alias("asset_id"), "origin")
    rows = spark.createDataFrame(list(zip(range(len(regions)), names, regions, strict=True)), "candidate_key long, asset_id string, region struct<x: double, y: double, width: double, height: double>")
    cut = {r.candidate_key: r for r in pictures.crops(rows, assets, found.drop("name")).collect()}
    for k, (name, region) in enumerate(zip(names, regions, strict=True)):
        box = plain_box(region, *out[name].shape[1::-1]) if name in out else None
        assert (tuple(cut[k].box) if k in cut else None) == box
        if box is not None:
            left, top, right, bottom = box
            assert cut[k].crop == pictures.png(np.ascontiguousarray(out[name][top:bottom, left:right]))


def test_recognised_words(spark):
    rows = [(1, [("foam", 90.0), (" ", 99.0), ("x", -1.0), ("y", 70.0)]), (2, []), (3, None), (4, [(None, 5.0)])]
    df = spark.createDataFrame(rows, "id long, words array<struct<text: string, confidence: double>>")
    found = {r.id: r.c for r in df.select("id", pictures.words_confidence(F.col("words")).alias("c")).collect()}
    assert found == {1: pytest.approx(0.8), 2: None, 3: None, 4: None}
