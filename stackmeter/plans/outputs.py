"""Results on disk: tables, JSON, meshes and the reuse of finished fields."""

from __future__ import annotations

from dataclasses import asdict, is_dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fields_of

LEAD = ["uid", "oid", "stack", "tile", "source"]
MICROMETRES = ["x_um", "y_um", "z_um", "radius_um", "diameter_um", "radius_z_um", "area_um2", "volume_um3", "dome_distance_um", "z_position_um"]
# The curated feature columns, in order.
CURATED = (
    "uid tile x_mosaic_px y_mosaic_px z_slice appearance_measurable background_clipped_frac focus_sharpness clipped rim_minus_core_od core_rim_separation core_fill_fraction "
    "core_od_mean core_od_std core_od_entropy core_glcm_contrast_d2 core_glcm_homogeneity_d2 rim_od_mean rim_over_core_grad diameter_um circularity solidity radius_cv "
    "outline_empty shape_suspect nearest_border_px dome_radial_frac height_above_glass_slices nn_gap_px"
).split()


def object_table(objects: DataFrame, calibrated: bool) -> DataFrame:
    """Pixel columns always, micrometres only where calibrated (B1)."""
    flat = [f.name for f in objects.schema.fields if f.dataType.simpleString().split("<")[0] not in ("array", "map", "struct")]
    return objects.select(*[c for c in flat if calibrated or c not in MICROMETRES])


def ordered(df: DataFrame, curated: list[str] | None = None) -> DataFrame:
    """Lead columns first; only the curated ones that are present, if a list (``CURATED``) is given."""
    names = [c for c in LEAD if c in df.columns] + [c for c in df.columns if c not in LEAD]
    return df.select(*[c for c in (curated or names) if c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_csv(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A written table with its schema; empty cells are null."""
    return spark.read.schema(fields_of(like)).option("header", "true").csv(path)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text for each row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def run_document(run: str, settings: dict[str, dict], tiles: DataFrame, merge: DataFrame, summary: DataFrame) -> DataFrame:
    """One row that says all of a run: settings by kind, the tiles in order, the seams' summary and the objects' (B6).

    ``merge`` and ``summary`` have one row; a scan's tiles are one list.
    """
    grid = tiles.agg(F.array_sort(F.collect_list(F.struct("tile", "tr", "tc", "x0", "y0", "w", "h"))).alias("tiles"))
    own = [F.struct(*[F.lit(v).cast(_kind(v)).alias(k) for k, v in group.items()]).alias(name) for name, group in settings.items()]
    one = lambda df, name: df.select(F.struct(*df.columns).alias(name))
    return grid.join(F.broadcast(one(merge, "merge"))).join(F.broadcast(one(summary, "objects"))).select(F.lit(run).alias("run"), *own, "tiles", "merge", "objects")


def _kind(value: object) -> str:
    return "long" if isinstance(value, int) else "string" if isinstance(value, str) else "double"


#: What a reload needs of a run document; further parts are read with a schema of one's own.
DOCUMENT = "tiles array<struct<tile:int,tr:int,tc:int,x0:double,y0:double,w:double,h:double>>, merge struct<n_seams:long,worst_residual:double,reliable:boolean,weakest_rate:double>, objects struct<n:long>, run string"


def run_documents(spark: SparkSession, path: str) -> DataFrame | None:
    """The documents of all finished runs, None before the first."""
    try:
        return spark.read.schema(DOCUMENT).json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def reloaded(spark: SparkSession, output: str, run: str) -> tuple[DataFrame, DataFrame]:
    """(tiles with their saved offsets, catalogue) of a finished run.

    A run without a document, a catalogue of another length than its document says, and an object on a tile that the
    document does not list are errors, not smaller results (A12, E12).
    """
    known = run_documents(spark, f"{output}/runs")
    document = None if known is None else known.where(F.col("run") == run).first()
    if document is None:
        raise ValueError(f"no finished run {run}")
    tiles = spark.createDataFrame(document["tiles"], known.schema["tiles"].dataType.elementType)
    objects = spark.read.parquet(f"{output}/catalogue").where(F.col("run") == run).drop("run")
    off = objects.join(F.broadcast(tiles.select("tile")), "tile", "left_anti").limit(1).collect()
    if off or objects.count() != document["objects"]["n"]:
        raise ValueError(f"the catalogue of {run} is not the one that its document describes")
    return tiles.withColumn("offset_source", F.lit("saved")), objects


def params_key(*settings: object) -> str:
    """A digest of all settings, for reuse of results."""
    import hashlib
    import json

    plain = [asdict(s) if is_dataclass(s) else s for s in settings]
    return hashlib.sha256(json.dumps(plain, sort_keys=True, default=str).encode()).hexdigest()


def pending(fields: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Fields without a finished result under the same settings."""
    return fields.join(done.where(F.col("params_key") == key).select("stack"), "stack", "left_anti")


def turbo(share: Column) -> tuple[Column, Column, Column]:
    """A blue-green-red ramp for depth."""
    x = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    level = lambda c: F.round(255 * F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))).cast("int")
    return level(1.5 - F.abs(4 * x - 3)), level(1.5 - F.abs(4 * x - 2)), level(1.5 - F.abs(4 * x - 1))


def ply_lines(vertices: DataFrame, faces: DataFrame, per_object: int) -> DataFrame:
    """(part, line) of a text mesh: vertices of all objects with colours by depth, then faces with moved indices.

    ``vertices`` has place (0, 1, ... of the object), vid, x, y, z; ``faces`` place, fid, a, b, c.
    """
    limits = vertices.agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    red, green, blue = turbo((F.col("z") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9)))
    v = vertices.join(F.broadcast(limits)).select(F.lit(1).alias("part"), "place", F.col("vid").alias("n"), F.format_string("%.4f %.4f %.4f %d %d %d", "x", "y", "z", red, green, blue).alias("line"))
    base = F.col("place") * per_object
    f = faces.select(F.lit(2).alias("part"), "place", F.col("fid").alias("n"), F.format_string("3 %d %d %d", (F.col("a") + base).cast("long"), (F.col("b") + base).cast("long"), (F.col("c") + base).cast("long")).alias("line"))
    return v.unionByName(f).repartitionByRange("part", "place", "n").sortWithinPartitions("part", "place", "n")


def ply_header(n_vertices: int, n_faces: int) -> str:
    colours = "".join(f"property uchar {c}\n" for c in ("red", "green", "blue"))
    return f"ply\nformat ascii 1.0\nelement vertex {n_vertices}\nproperty float x\nproperty float y\nproperty float z\n{colours}element face {n_faces}\nproperty list uchar int vertex_indices\nend_header\n"


def without_empty_columns(df: DataFrame) -> DataFrame:
    """Columns that are null in every row are left out: what could not be measured is absent, not zero."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if counts[c]])


# What a payload leaves out, as it follows from other columns or no reader shows it.
REDUNDANT = ("radial_profile_um", "outlines_px", "z_extent_slices")


def trimmed(matrix: DataFrame) -> DataFrame:
    """A feature matrix as a viewer gets it: without ``REDUNDANT``, numbers to four places, outlines to one, half-even."""
    kinds = dict(matrix.dtypes)
    places = lambda c: F.transform(c, lambda v: F.bround(v, 1)) if kinds[c] == "array<double>" else F.bround(c, 4) if kinds[c] == "double" else F.col(c)
    return matrix.select(*[places(c).alias(c) for c in matrix.columns if c not in REDUNDANT])


def data_uri(content: Column, kind: str) -> Column:
    """Bytes as a link that carries them."""
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(content))


def build_stamp(at: Column) -> Column:
    """A moment as a build stamp, to the minute, in UTC; a timestamp without a zone is taken as UTC."""
    return F.date_format(at, "yyyy-MM-dd HH:mm 'UTC'")


def payload_lines(matrix: DataFrame, tiles: DataFrame, meta: DataFrame) -> DataFrame:
    """(part, n, line): JSON of a run's payload, the one row of ``meta`` first, then tiles, then objects in order (M).

    A line an object, so that no task or driver holds them all.
    """
    text = lambda df: F.to_json(F.struct(*df.columns))
    small = trimmed(matrix)
    parts = [
        meta.select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("n"), text(meta).alias("line")),
        tiles.select(F.lit(2).alias("part"), F.col("tile").cast("long").alias("n"), text(tiles).alias("line")),
        small.select(F.lit(3).alias("part"), F.col("uid").cast("long").alias("n"), text(small).alias("line")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).repartitionByRange("part", "n").sortWithinPartitions("part", "n")
