"""Queries reach every row of their tables: no slice, stack or id is left out, in the query or in its SQL."""

import pytest

from stackmeter import queries as registry
from stackmeter.plans.views import view

from .test_queries import SF, pytestmark  # noqa: F401

FRAMES = ["od_stats", "core_rim_contrast", "glcm_core", "glcm_core_d2", "glcm_core_d4", "gradient_stats", "lbp_core", "plane_background", "texture_ridge"]
SLICES = ["feather_composite", "max_composite", "seam_steps", "overlap_disagreement"]


@pytest.mark.parametrize(
    ("name", "keys", "source", "held"),
    [(n, ["stack", "z"], "v_pixels", ["stack", "z"]) for n in FRAMES]
    + [(n, ["z"], "v_pixels", ["z"]) for n in SLICES]
    + [("mesh_vertices", ["oid"], "v_outlines", ["oid"]), ("mesh_faces", ["oid"], "v_objects", ["obj"])],
)
def test_every_key_has_rows(spark, name, keys, source, held):
    got = registry.queries()[name](spark, SF).select(*keys).distinct()
    want = view(spark, SF, source).select(*held).distinct()
    assert got.count() == want.count() > 0


def test_every_order_has_a_name(spark):
    orders = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert registry.queries()["view_names"](spark, SF).count() == orders
