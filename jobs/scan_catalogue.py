"""Catalogue of a tiled scan: sightings of all tiles become one numbered catalogue with its seams and a run document.

The tables folder holds the scan as the library's relational views have it: ``nation`` lays out the tiles, ``customer``
the objects that tiles sight.  The library's operators match sightings over the seams, join them to objects, elect a
view of each, flag, number and place them in the droplet.  Under ``output``:

* ``catalogue`` and ``views``, partitioned by run and tile; ``seams``, partitioned by run;
* ``runs``, JSON, partitioned by run: one document with the settings, the tiles, the seams' summary and the counts,
  written last.

A run's name is a digest of the settings and of the tables' rows.  A run whose document is there is finished and is
reused; one that broke off has none and is written again, into its own partitions only.  So a rerun over the same tables
changes nothing, and other tables or settings stand beside it as another run.

    python -m jobs.scan_catalogue --config jobs/scan_catalogue.json --tables T --output O
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from stackmeter.functions import scalars
from stackmeter.operators import catalogue, matching
from stackmeter.params import Acquisition, Dome, Params
from stackmeter.plans import outputs
from stackmeter.plans.views import view
from stackmeter.storage import drop, materialise, new_path

LOG = logging.getLogger("jobs.scan_catalogue")


@dataclass(frozen=True)
class Settings:
    """Rules that a scan may change; the rest are the library's."""

    lateral_base_px: float = Params.lateral_base_px
    lateral_per_radius: float = Params.lateral_per_radius
    max_radius_ratio: float = Params.max_radius_ratio
    informative_seam: int = Params.informative_seam
    px_um: float | None = Acquisition.px_um
    z_um: float | None = Acquisition.z_um
    na: float | None = Acquisition.na

    def rules(self) -> tuple[Params, Acquisition]:
        own = asdict(self)
        scales = {k: own.pop(k) for k in ("px_um", "z_um", "na")}
        return Params(**own), Acquisition(**scales)


def digest(df: DataFrame) -> list[int | None]:
    """A number of rows and two sums that any change of a row moves, whatever the order of the rows."""
    h = F.xxhash64(*df.columns)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1 << 30))).alias("s")).first()
    return [row["n"], row["x"], row["s"]]


def finished(spark: SparkSession, output: str, name: str) -> bool:
    known = outputs.run_documents(spark, f"{output}/runs")
    return known is not None and not known.where(F.col("run") == name).isEmpty()


def run(spark: SparkSession, tables: str, output: str, settings: Settings = Settings()) -> dict[str, object]:
    """Write the catalogue of the scan in ``tables``, or find it written; says what was read and written."""
    p, a = settings.rules()
    tiles, seen = view(spark, tables, "v_tiles"), view(spark, tables, "v_sightings")
    counts = {"tiles": digest(tiles), "sightings": digest(seen)}
    name = "r" + outputs.params_key(p, a, Dome(), counts)[:24]
    report: dict[str, object] = {"run": name, "sightings_read": counts["sightings"][0], "tiles_read": counts["tiles"][0], "reused": finished(spark, output, name)}
    if report["reused"]:
        LOG.info("run %(run)s of %(sightings_read)d sightings is there already", report)
        return report
    held = new_path(spark, "scan-sightings")
    try:
        sightings = materialise(matching.with_clipped(catalogue.with_sid(seen), p), "", held)
        grouped = catalogue.with_components(sightings, catalogue.matched(sightings, tiles, p, a))
        merged = scalars.with_spatial_features(catalogue.catalogue(grouped, tiles, p))
        common.replace_partitions(merged.withColumn("run", F.lit(name)).hint("rebalance", "tile"), f"{output}/catalogue", "run", "tile")
        common.replace_partitions(catalogue.views_long(grouped).withColumn("run", F.lit(name)).hint("rebalance", "tile"), f"{output}/views", "run", "tile")
        seams = catalogue.seam_report(sightings, tiles, catalogue.matched(sightings, tiles, p, a), p)
        common.replace_partitions(seams.withColumn("run", F.lit(name)), f"{output}/seams", "run")
    finally:
        drop(spark, held)
    objects = spark.read.parquet(f"{output}/catalogue").where(F.col("run") == name)
    summary = catalogue.merge_summary(spark.read.parquet(f"{output}/seams").where(F.col("run") == name), p)
    document = outputs.run_document(name, {"params": asdict(p), "acquisition": asdict(a), "dome": asdict(Dome())}, tiles, summary, catalogue.run_summary(objects))
    common.replace_partitions(document, f"{output}/runs", "run", format="json")
    report["objects_written"] = objects.count()
    LOG.info("run %(run)s: read %(sightings_read)d sightings of %(tiles_read)d tiles, wrote %(objects_written)d objects", report)
    return report


def result(spark: SparkSession, output: str) -> DataFrame:
    """All finished runs' objects."""
    done = outputs.run_documents(spark, f"{output}/runs").select("run")
    return spark.read.parquet(f"{output}/catalogue").join(done, "run", "left_semi")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("--tables", "--output"):
        parser.add_argument(name, required=True)
    parser.add_argument("--config")
    given = parser.parse_args(arguments)
    spark = common.session("scan-catalogue")
    try:
        run(spark, given.tables, given.output, common.settings_of(Settings, given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
