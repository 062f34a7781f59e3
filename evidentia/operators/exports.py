"""Frames for export and the files that hold them."""

from __future__ import annotations

import csv
import glob
import io
import os
import shutil
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def flat(df: DataFrame) -> DataFrame:
    """Containers as JSON, so that any text format holds the frame."""
    return df.select(*(F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, ArrayType | MapType | StructType) else F.col(f"`{f.name}`") for f in df.schema.fields))


def joined(c: str, by: str) -> Column:
    return F.array_join(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")), by)


def configurations(candidates: DataFrame, products: DataFrame) -> DataFrame:
    """Candidates with their product's name, lists joined by bars; candidates of unknown products stay."""
    named = products.select("product_id", F.col("name").alias("product"))
    return candidates.join(named, "product_id", "left").withColumns({"reasons": joined("reasons", " | "), "contradictions": joined("contradictions", " | ")})


def configuration_layers(candidates: DataFrame) -> DataFrame:
    """One row per layer of candidates (product_id, place, stack, taken, picked)."""
    rows = candidates.select("product_id", "place", F.posexplode(F.arrays_zip("stack", "taken", "picked")).alias("i", "l"))
    return rows.select("product_id", "place", (F.col("i") + 1).alias("position"), F.col("l.stack.material").alias("material"), F.col("l.taken").alias("thickness_mm"), F.col("l.picked").alias("density"))


def stack_text(material: Column, thickness: Column, density: Column) -> Column:
    """``a (x mm, y kg/m³) → b ...`` of three arrays."""
    rows = F.arrays_zip(material.alias("m"), thickness.alias("t"), density.alias("d"))
    return F.array_join(F.transform(rows, lambda x: F.concat(x["m"], F.lit(" ("), x["t"].cast("string"), F.lit(" mm, "), x["d"].cast("string"), F.lit(" kg/m³)"))), " → ")


def trademark_rows(materials: DataFrame) -> DataFrame:
    """Decoded materials with lists joined by bars and the number of their evidence sources."""
    lists = [c for c in ("additives", "functions", "queries", "contradictions", "unknowns") if c in materials.columns]
    return materials.withColumns({c: joined(c, " | ") for c in lists}).withColumn("evidence_source_count", F.size(F.coalesce("evidence", F.array()))).drop("evidence")


def material_evidence_rows(materials: DataFrame) -> DataFrame:
    """One row per evidence source of a decoded material; the product's name, else its family."""
    return materials.select("material_id", F.coalesce("product", "family").alias("product"), "trademark", F.explode("evidence").alias("e")).select("material_id", "product", "trademark", "e.*")


def visual_layers(assets: DataFrame) -> DataFrame:
    """One row per recognised component of assets (asset_id, products array of (name, layers array of (material, thickness_mm)), regions array of strings): of products' layers, and regions that no product has."""
    of_products = assets.select("asset_id", F.explode("products").alias("p")).select("asset_id", F.col("p.name").alias("product"), F.posexplode("p.layers").alias("i", "l"))
    layers = of_products.select("asset_id", "product", (F.col("i") + 1).alias("position"), F.col("l.material").alias("material"), F.col("l.thickness_mm").alias("thickness_mm"))
    loose = assets.select("asset_id", F.posexplode("regions").alias("i", "material")).select("asset_id", F.lit(None).cast("string").alias("product"), (F.col("i") + 1).alias("position"), "material", F.lit(None).cast("double").alias("thickness_mm"))
    return layers.unionByName(loose)


def visual_queue(assets: DataFrame) -> DataFrame:
    """asset_id, kind, text: what recognised assets (asset_id, queries, urls) ask for next, each once."""
    of = lambda c, kind: assets.select("asset_id", F.lit(kind).alias("kind"), F.explode(c).alias("text"))
    return of("queries", "query").unionByName(of("urls", "url")).where("text is not null and text != ''").dropDuplicates(["asset_id", "kind", "text"])


def run_summary(frames: dict[str, DataFrame], run_id: str, company: str) -> DataFrame:
    """One row: how many rows each frame of a run has; no frame's rows meet in one task."""
    counts = None
    for name, df in frames.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        counts = one if counts is None else counts.unionByName(one)
    if counts is None:
        raise ValueError("no frames")
    wide = counts.groupBy().pivot("name", list(frames)).agg(F.max("n"))
    return wide.select(F.lit(run_id).alias("run_id"), F.lit(company).alias("company"), *frames)


def write(frames: dict[str, DataFrame], path: str, kind: str = "csv") -> None:
    """Each frame as a folder of CSV (with a header) or JSON files under ``path``; containers become JSON in CSV. An empty frame has a header alone."""
    for name, df in frames.items():
        if kind == "csv":
            flat(df).write.mode("overwrite").option("header", True).option("escape", '"').option("encoding", "UTF-8").csv(f"{path}/{name}")
        elif kind == "json":
            df.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/{name}")
        else:
            raise ValueError(f"{kind} is neither csv nor json")


def bundle(frames: dict[str, DataFrame], path: str) -> None:
    """The primary artifacts: the product and the material table as CSV and JSON, and the two summaries as JSON."""
    for kind in ("csv", "json"):
        write({k: v for k, v in frames.items() if k in ("primary_table", "trademark_materials")}, f"{path}/{kind}", kind)
    write({k: v for k, v in frames.items() if k in ("coverage", "summary")}, f"{path}/json", "json")


def one_file(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A frame as one file: CSV with a byte-order mark and a header, or a JSON array of records; its rows in the frame's order.

    Tasks write parts, which are then copied into the file one line after the other, and the file gets its name last; ``path`` is on a file system that all nodes share.
    """
    if kind not in ("csv", "json"):
        raise ValueError(f"{kind} is neither csv nor json")
    parts, made = f"{path}.parts-{uuid.uuid4().hex}", f"{path}.{uuid.uuid4().hex}"
    try:
        if kind == "csv":
            flat(df).write.option("header", False).option("escape", '"').option("emptyValue", "").option("encoding", "UTF-8").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(parts)
        else:
            df.write.option("ignoreNullFields", False).json(parts)
        with open(made, "wb") as out:
            if kind == "csv":
                text = io.StringIO()
                csv.writer(text, lineterminator="\n").writerow(df.columns)
                out.write(b"\xef\xbb\xbf" + text.getvalue().encode())
            else:
                out.write(b"[")
            first = True
            for part in sorted(glob.glob(f"{glob.escape(parts)}/part-*")):
                with open(part, "rb") as lines:
                    if kind == "csv":
                        shutil.copyfileobj(lines, out, 1 << 20)
                        continue
                    for line in lines:
                        out.write((b"\n" if first else b",\n") + line.rstrip(b"\n"))
                        first = False
            if kind == "json":
                out.write(b"\n]\n")
        os.replace(made, path)
    finally:
        shutil.rmtree(parts, ignore_errors=True)
        if os.path.exists(made):
            os.remove(made)


def primary_artifacts(products: DataFrame, materials: DataFrame, result: DataFrame, folder: str) -> dict[str, str]:
    """The six primary files of a run and their paths: both tables as CSV and JSON, the materials as a workbook of one sheet, and the whole result, whose rows are JSON objects in one array."""
    from ..sources import workbook

    os.makedirs(folder, exist_ok=True)
    named = {"table_csv_path": "displayed_products.csv", "table_json_path": "displayed_products.json", "material_csv_path": "trademark_materials.csv", "material_json_path": "trademark_materials.json", "material_excel_path": "trademark_materials.xlsx", "result_json_path": "research_result.json"}
    paths = {k: f"{folder}/{v}" for k, v in named.items()}
    for df, key in ((products, "table"), (materials, "material")):
        for kind in ("csv", "json"):
            one_file(df, paths[f"{key}_{kind}_path"], kind)
    workbook.write({"Displayed Products": materials}, paths["material_excel_path"], "Materials", {})
    one_file(result, paths["result_json_path"], "json")
    return paths


def write_series(wide: DataFrame, path: str) -> None:
    """A simulation's wide frame as CSV, numbers with six digits after the point."""
    numbers = [F.format_string("%.6f", F.col(f"`{f.name}`")).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f"`{f.name}`") for f in wide.schema.fields]
    wide.select(*numbers).write.mode("overwrite").option("header", True).csv(path)
