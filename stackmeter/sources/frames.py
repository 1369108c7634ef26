"""Stacks of frames: discovery, loading, stage positions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tags import tag_text
from . import tiff

# Folders that never hold stacks, and the name of the default stack.
SKIPPED = (".git", ".venv", "venv", "output", "docs", "__pycache__", "node_modules", "site-packages")
HINT = "4x_00009"


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, folder, name, z_label) of the frames under ``root``; no pixel is read (A2)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").option("recursiveFileLookup", "true").load(root)
    return files.select(
        "path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"),
        F.coalesce(F.expr("try_cast(nullif(regexp_extract(path, '_Z([0-9]+)_', 1), '') as int)"), F.lit(0)).alias("z_label"),
    )


def stacks(frames: DataFrame, root: str, max_depth: int = 3, least: int = 3) -> DataFrame:
    """(folder, stack, n) of folders with at least three slices, not below another stack, by name (A3)."""
    inside = F.regexp_replace(F.substring_index("folder", root.rstrip("/").removeprefix("file:"), -1), "^/", "")
    n = frames.where(F.col("name").rlike("_Z[0-9]+_")).groupBy("folder").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    parts = F.split(inside, "/")
    ok = (F.size(parts) <= max_depth) & ~F.exists(parts, lambda p: p.startswith(".") | p.isin(*SKIPPED))
    found = n.withColumn("stack", F.regexp_extract("folder", "([^/]*)$", 1)).where(ok)
    # Ancestors of a folder, at most max_depth: an equi-join instead of a prefix comparison of all pairs.
    up = found.select("folder", F.explode(F.sequence(F.lit(1), F.lit(max_depth))).alias("d")).select("folder", F.expr("substring_index(folder, '/', size(split(folder, '/')) - d)").alias("parent"))
    below = up.join(found.select(F.col("folder").alias("parent")), "parent").select("folder").distinct()
    return found.join(below, "folder", "left_anti").select("folder", "stack", "n")


def default_stack(found: DataFrame, hint: str = HINT) -> DataFrame:
    """The stack whose name contains the hint, else the first by name (A4)."""
    return found.orderBy(F.desc(F.col("stack").contains(hint)), "stack").limit(1)


def load(spark: SparkSession, root: str, channel: str | None = None) -> DataFrame:
    """Frames (tile, z, z_label, height, width, px) of every stack under ``root`` (A1).

    ``z`` counts the slices of a tile from 0 in the order of their labels.  A tile whose
    frames differ in shape stops the read with an error.
    """
    wanted = f"*{channel}*.tif" if channel else "*.tif"
    files = spark.read.format("binaryFile").option("pathGlobFilter", wanted).option("recursiveFileLookup", "true").load(root)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            arrays = [tiff.decode(c) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "height": [a.shape[0] for a in arrays], "width": [a.shape[1] for a in arrays], "px": [a.astype(float).reshape(-1) for a in arrays]})

    order = listed(spark, root).select("path", F.regexp_extract("folder", "([^/]*)$", 1).alias("tile"), "z_label")
    order = order.withColumn("z", F.row_number().over(Window.partitionBy("tile").orderBy("z_label", "path")) - 1)
    decoded = files.select("path", "content").mapInPandas(run, "path string, height int, width int, px array<double>")
    whole = Window.partitionBy("tile")
    same = (F.min("height").over(whole) == F.max("height").over(whole)) & (F.min("width").over(whole) == F.max("width").over(whole))
    rows = decoded.drop("px").join(order, "path").withColumn("ok", same)
    checked = rows.select("path", "tile", "z", "z_label", F.when(F.col("ok"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("frames of different shapes in "), F.col("tile"))).cast("boolean")).alias("ok"))
    return decoded.join(checked.where("ok").drop("ok"), "path").select("tile", "z", "z_label", "height", "width", "px")


def common_depth(frames: DataFrame) -> DataFrame:
    """(depth): the least number of slices over the tiles."""
    return frames.groupBy("tile").count().agg(F.min("count").alias("depth"))


def stage_locations(spark: SparkSession, root: str) -> DataFrame:
    """(tile, z_label, stage_x, stage_y, stage_z) in nanometres; null where a frame has no complete note (A10)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").option("recursiveFileLookup", "true").load(root)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"path": pdf["path"], "note": [tiff.frame_note(c) for c in pdf["content"]]})

    at = [tag_text(F.col("note"), f"StageLocation{a}").try_cast("long") for a in "XYZ"]
    whole = F.greatest(*[a.isNull() for a in at])
    notes = files.select("path", "content").mapInPandas(run, "path string, note string").select("path", *[F.when(~whole, a).alias(f"stage_{n}") for a, n in zip(at, "xyz", strict=True)])
    return notes.join(listed(spark, root).select("path", F.regexp_extract("folder", "([^/]*)$", 1).alias("tile"), "z_label"), "path").drop("path")
