"""The jobs as queries: each runs its job twice into one new folder and returns the output as it then stands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import scan_catalogue, tag_register
from stackmeter import queries as measurement
from stackmeter.params import Dome
from stackmeter.storage import new_path


def job1_tag_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_path(spark, "job1-tag-register")
    for _ in range(2):
        tag_register.run(spark, f"{sf_dir}/pages.parquet", f"{at}/out", f"{at}/checkpoint")
    return tag_register.result(spark, f"{at}/out")


def job2_scan_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_path(spark, "job2-scan-catalogue")
    for _ in range(2):
        scan_catalogue.run(spark, sf_dir, at)
    return measurement.rounded(scan_catalogue.result(spark, at).drop("run"), 3)


TAG_REGISTER_SQL = r"""
WITH p AS (SELECT CAST(page_id AS VARCHAR) AS record, page_id, url, html, nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)), '^(www|m|blog)\.', ''), '') AS site,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '\.html$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '') AS path FROM pages),
 r AS (SELECT record, page_id, url, site, site || path AS address, CASE WHEN regexp_matches(html, '(?s)<title(?:\s[^>]*)?>.*?</title>') THEN trim(regexp_extract(html, '(?s)<title(?:\s[^>]*)?>(.*?)</title>', 1)) END AS title,
  CASE WHEN regexp_matches(html, '<html\s(?:[^>]*\s)?lang="[^"]*"') THEN regexp_extract(html, '<html\s(?:[^>]*\s)?lang="([^"]*)"', 1) END AS language,
  CAST(coalesce(len(regexp_extract_all(html, '<p[\s/>]')), 0) AS INT) AS n_paragraphs, CAST(coalesce(len(regexp_extract_all(html, '<a[\s/>]')), 0) AS INT) AS n_links, CAST(coalesce(octet_length(encode(html)), 0) AS BIGINT) AS n_bytes, sha256(html) AS sha256 FROM p)
SELECT r.*, CAST(count(*) OVER (PARTITION BY site) AS BIGINT) AS site_records, CAST(sum(n_bytes) OVER (PARTITION BY site) AS BIGINT) AS site_bytes,
  CASE WHEN address IS NULL THEN false ELSE page_id < max(page_id) OVER (PARTITION BY address) END AS stale FROM r
"""

_D = Dome()
_ROUND = {c: f"round(o.{c}, 3) + 0e0 AS {c}" for c in ("x", "y", "z", "r", "sharp")}
SCAN_CATALOGUE_SQL = measurement._with(
    measurement._SV,
    f"""SELECT uid, tile, obj, {', '.join(_ROUND.values())}, clipped, n_views, views, coverage_k, round(lateral_s, 3) + 0e0 AS lateral_spread_px, round(axial, 3) + 0e0 AS axial_spread_slices, round(ratio, 3) + 0e0 AS radius_ratio,
  allc AS clipped_everywhere, (n_views = 1 AND coverage_k > 1) AS single_view_in_overlap, ratio > 1.25e0 AS radius_disagreement, n_tiles < n_views AS same_tile_twice, rmax > half AS guarantee_void,
  round(radial, 3) + 0e0 AS dome_radial_px, round((degrees(atan2(y - {_D.cy}e0, x - {_D.cx}e0)) + 360e0) % 360e0, 3) + 0e0 AS dome_azimuth_deg, round(radial / {_D.contact_radius!r}e0, 3) + 0e0 AS dome_radial_frac, round({_D.glass}e0 - z, 3) + 0e0 AS height_above_glass_slices,
  round(clear, 3) + 0e0 AS dome_distance_px, round(edge_px, 3) + 0e0 AS contact_edge_distance_px, CASE WHEN clear <= edge_px THEN 1e0 ELSE 0e0 END AS nearest_border_is_cap, round(least(clear, edge_px), 3) + 0e0 AS nearest_border_px
FROM (SELECT *, CASE WHEN {_D.contact_radius!r}e0 - radial < 0 THEN abs(({_D.glass}e0 - z) * {_D.anisotropy}e0) - r ELSE {_D.contact_radius!r}e0 - radial - r END AS edge_px FROM (SELECT *, sqrt((x - {_D.cx}e0) * (x - {_D.cx}e0) + (y - {_D.cy}e0) * (y - {_D.cy}e0)) AS radial,
  {_D.radius}e0 - sqrt((x - {_D.cx}e0) * (x - {_D.cx}e0) + (y - {_D.cy}e0) * (y - {_D.cy}e0) + ((z - {_D.cz}e0) * {_D.anisotropy}e0) * ((z - {_D.cz}e0) * {_D.anisotropy}e0)) - r AS clear FROM objs)) o""",
    measurement._SEAM, measurement._COMP, measurement._CAT,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_tag_register": job1_tag_register, "job2_scan_catalogue": job2_scan_catalogue}


def oracle_sql() -> dict[str, str]:
    return {"job1_tag_register": TAG_REGISTER_SQL, "job2_scan_catalogue": SCAN_CATALOGUE_SQL}
