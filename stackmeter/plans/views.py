"""Relational stand-ins for tiles, objects, sightings, pixels, outlines, focus curves and rings.

The driver's tables hold no images; each view derives one kind of measured data from
them.  The texts hold for Spark and, with two changes of dialect, for DuckDB, so that
an oracle can inline them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[str, ...]] = {
    "v_tiles": (
        """SELECT CAST(n_nationkey AS INT) AS tile, CAST(floor(n_nationkey/5e0) AS INT) AS tr, CAST(n_nationkey % 5 AS INT) AS tc,
        (n_nationkey % 5)*672e0 + (n_regionkey-2) AS x0, floor(n_nationkey/5e0)*504e0 + (n_regionkey-2) AS y0, 960e0 AS w, 720e0 AS h FROM nation""",
    ),
    "v_objects": (
        """SELECT c_custkey AS obj, ((c_custkey*7919) % 364800)/100e0 AS gx, ((c_custkey*104729) % 273600)/100e0 AS gy,
        ((c_custkey*31) % 1190)/10e0 AS gz, 4e0 + ((c_custkey*13) % 160)/10e0 AS r FROM customer""",
    ),
    "v_sightings": (
        """SELECT t.tile, o.obj, o.gx + (((o.obj*17+t.tile*5) % 21)-10)/10e0 AS x, o.gy + (((o.obj*11+t.tile*3) % 21)-10)/10e0 AS y,
        o.gz + (((o.obj*7+t.tile) % 11)-5)/10e0 AS z, o.r, ((o.obj*37+t.tile*19) % 100)/100e0 AS sharp,
        least(o.gx-t.x0, t.x0+t.w-o.gx, o.gy-t.y0, t.y0+t.h-o.gy) AS edge
        FROM v_objects o JOIN v_tiles t ON o.gx BETWEEN t.x0 AND t.x0+t.w AND o.gy BETWEEN t.y0 AND t.y0+t.h WHERE (o.obj*29+t.tile*23) % 10 < 8""",
        "v_objects",
        "v_tiles",
    ),
    "v_pairs": (
        """SELECT a.tile AS ta, b.tile AS tb, CASE WHEN a.tr = b.tr THEN 'x' ELSE 'y' END AS axis
        FROM v_tiles a JOIN v_tiles b ON (a.tr=b.tr AND a.tc+1=b.tc) OR (a.tc=b.tc AND a.tr+1=b.tr)""",
        "v_tiles",
    ),
    "v_pixels": (
        """SELECT CAST(floor(vec_id/50e0) AS INT) AS stack, CAST(vec_id % 50 AS INT) AS z, CAST(floor((i-1)/8e0) AS INT) AS y, CAST((i-1) % 8 AS INT) AS x,
        CAST({item} AS DOUBLE)*100e0 AS v FROM embeddings{items}""",
    ),
    "v_outlines": ("SELECT vec_id AS oid, CAST(i-1 AS INT) AS k, 20e0 + 10e0*CAST({item} AS DOUBLE) AS r FROM embeddings{items}",),
    "v_curves": ("SELECT user_id AS oid, CAST(day(ts) AS INT)-1 AS z, round(sum(value),4) AS v FROM events GROUP BY 1, 2",),
    "v_rings": (
        """SELECT CAST(p_partkey % 24 AS INT) AS z, avg(sqrt(1226e0*1226e0 - power((p_partkey % 24)*4*2.65e0 - 1100e0,2)) + (p_size-25)/10e0) AS radius
        FROM part GROUP BY 1""",
    ),
}
TABLES = ("nation", "customer", "embeddings", "events", "part")


def _ordered(names: tuple[str, ...] | list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        for x in [*_ordered(list(VIEWS[n][1:])), n]:
            if x not in out:
                out.append(x)
    return out


def duck_ctes(*names: str) -> str:
    """``v_a AS (...), v_b AS (...)`` for DuckDB, in order of need."""
    return ",\n".join(f"{n} AS ({VIEWS[n][0].format(item='embedding[i]', items=', range(1,65) t(i)')})" for n in _ordered(list(names)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables in ``sf_dir``."""
    ctes = ", ".join(f"{n} AS ({_spark_text(n, sf_dir)})" for n in _ordered([name]))
    return spark.sql(f"WITH {ctes} SELECT * FROM {name}")


def _spark_text(name: str, sf_dir: str) -> str:
    text = VIEWS[name][0].format(item="element_at(embedding, i)", items=" LATERAL VIEW explode(sequence(1,64)) t AS i")
    for t in TABLES:
        text = text.replace(f"FROM {t}", f"FROM parquet.`{sf_dir}/{t}.parquet`")
    return text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
