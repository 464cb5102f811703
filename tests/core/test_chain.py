"""Kernel chains, page requests and surface functions: known answers, nulls and empty inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbgrid.functions import surface
from plumbgrid.functions.scalar import np_fbm
from plumbgrid.operators import chain, raster

NOISE = {"type": "noise_stack", "params": {"frequency": 1 / 32}}
EROSION = {"type": "erosion", "params": {"iterations": 3, "thermal_iterations": 1, "rain_rate": 0.02, "gravity": 9.0, "seed": 3, "not_known": 1}}


def pages(spark, *xs):
    return spark.createDataFrame([(float(x), 0.0) for x in xs], "page_x double, page_z double")


@pytest.mark.parametrize("kernel", [{}, {"type": "fog"}, {"type": "chain", "stages": []}, {"type": "chain", "stages": [EROSION]}, {"type": "chain", "stages": [NOISE, NOISE]}, None])
def test_chain_shape(kernel):
    with pytest.raises(ValueError):
        chain.stages_of(kernel)


def test_chain_is_noise_then_erosion(spark):
    assert chain.stages_of(NOISE) == [NOISE]
    both = {"type": "chain", "stages": [NOISE, EROSION]}
    got = chain.run_chain(pages(spark, 0, 0, 64), both, 8, 64.0, 5).toPandas()
    assert len(got) == 128
    for x in (0.0, 64.0):
        rows = got[got.page_x == x].sort_values(["r", "c"])
        h = 50 * np_fbm(x + rows.c.to_numpy() * (64 / 7), rows.r.to_numpy() * (64 / 7), frequency=1 / 32, seed=5)
        eroded = raster.erode(h.astype(np.float32).reshape(8, 8), iterations=3, thermal_iterations=1, rain_rate=0.02)["eroded"]
        assert np.allclose(rows.h.to_numpy().reshape(8, 8), eroded, atol=1e-4)


@pytest.mark.parametrize("mode", raster.MODES)
def test_feature_of_a_registered_source(spark, mode):
    """The feature is computed from the source's heights, then sampled and blended by mode and by the noise's amplitude."""
    made = np.random.default_rng(2).normal(size=(6, 6)) * 20
    chain.register_source("hills", spark.createDataFrame([(r, c, float(v)) for (r, c), v in np.ndenumerate(made)], "r int, c int, h double"), 6, -1000.0, -1000.0, 2000.0)
    noise = {"type": "noise_stack", "params": {"frequency": 1 / 32, "amplitude": 10.0, "other": 1}}
    kernel = lambda name: {"type": "chain", "stages": [noise, {"type": "dem_feature", "params": {"source": name, "mode": mode, "strength": 0.5}}]}
    base = {(r.r, r.c): r for r in chain.run_chain(pages(spark, 300), noise, 4, 60.0).collect()}
    got = {(r.r, r.c): r.h for r in chain.run_chain(pages(spark, 300), kernel("hills"), 4, 60.0).collect()}
    feature = raster.feature(made, mode)
    for k, row in base.items():
        fx, fy = ((v + 1000) / 2000 * 5 for v in (row.x, row.z))
        x, y = int(fx), int(fy)
        u, v = fx - x, fy - y
        at = (feature[y, x] * (1 - u) + feature[y, x + 1] * u) * (1 - v) + (feature[y + 1, x] * (1 - u) + feature[y + 1, x + 1] * u) * v
        if mode == "dem_height":
            expected = row.h + (at - (made.min() + made.max()) / 2 - row.h) * 0.5
        else:
            expected = row.h + (at - (0 if mode == "ridge_emphasis" else 0.5)) * 10 * 0.5
        assert got[k] == pytest.approx(expected)
    chain.clear_sources()
    assert {(r.r, r.c): r.h for r in chain.run_chain(pages(spark, 300), kernel("hills"), 4, 60.0).collect()} == {k: r.h for k, r in base.items()}


def test_bake_keeps_pages(spark, tmp_path, monkeypatch):
    store, catalog = str(tmp_path / "store"), [{"name": "a", "kernel": NOISE}]
    plain = {(r.page_x, r.r, r.c): r.h for r in chain.bake(pages(spark, 0, 64), catalog, 0, 4, 16.0, 1).collect()}
    first = {(r.page_x, r.r, r.c): r.h for r in chain.bake(pages(spark, 0, 64), catalog, 0, 4, 16.0, 1, store).collect()}
    assert first == plain and len(first) == 32
    asked = []
    real = chain.run_chain
    monkeypatch.setattr(chain, "run_chain", lambda pages, *rest: asked.append(sorted(r.page_x for r in pages.collect())) or real(pages, *rest))
    again = {(r.page_x, r.r, r.c): r.h for r in chain.bake(pages(spark, 0, 64, 128), catalog, 0, 4, 16.0, 1, store).collect()}
    assert asked == [[128.0]] and {k: again[k] for k in first} == first and len(again) == 48
    # what a page is made from is in its key
    for changed in ({"seed": 2}, {"n": 5}, {"catalog": [{"name": "a", "kernel": {"type": "noise_stack", "params": {"frequency": 1 / 31}}}]}):
        asked.clear()
        chain.bake(pages(spark, 0), changed.get("catalog", catalog), 0, changed.get("n", 4), 16.0, changed.get("seed", 1), store).collect()
        assert asked == [[0.0]]
    kept = spark.read.parquet(store)
    assert kept.count() == 6 and kept.first().metadata["stages"] == "noise_stack"
    with pytest.raises(IndexError):
        chain.bake(pages(spark, 0), catalog, 1, 4, 16.0)
    assert chain.bake(pages(spark), catalog, 0, 4, 16.0).count() == 0


def test_a_check_that_fails_when_run(spark):
    checks = {"late": lambda s: s.range(3).selectExpr("'error' AS severity", "CAST(raise_error('x') AS STRING) AS code"), "fine": lambda s: s.range(1).selectExpr("'info' AS severity", "'fine.one' AS code")}
    assert sorted(r.code for r in chain.run_checks(spark, checks).collect()) == ["fine.one", "late.check_crashed"]


def test_requests_return_errors(spark):
    kind = "id int, page_x double, page_z double, grid_n int, extent double, caps array<string>, tier string"
    rows = [(1, 0.0, 0.0, 4, 16.0, ["height"], "high"), (2, 0.0, 0.0, 0, -1.0, [], ""), (3, 0.0, 0.0, None, None, None, None), (4, 0.0, 0.0, 4, 16.0, ["slope"], "low"), (5, 0.0, 0.0, 5, 16.0, ["height"], "low")]
    got = {r.id: r for r in chain.generate_pages(spark.createDataFrame(rows, kind), NOISE, 4, 16.0).collect()}
    assert len(got) == 5 and got[1].errors == [] and len(got[1].heights) == 16 and got[1].complete
    assert got[2].errors == ["grid_n", "extent", "caps_empty", "tier"] and got[2].heights is None and not got[2].complete
    assert "caps_unknown" in got[3].errors and got[4].heights is None and got[5].errors == ["shape"]


def test_windows(spark):
    tiles = spark.createDataFrame([(0, 0, 0, 5), (0, 2, 2, 7)], "ring int, tx int, tz int, tile int")
    assert [(r.tx, r.tz) for r in chain.rebase(tiles, (0, 0), (1, 1), 3).collect()] == [(1, 1)]
    got = {(r.tx, r.tz): r.tile for r in chain.fill_nearest(tiles, 3).collect()}
    assert len(got) == 9 and got[0, 0] == 5 and got[2, 2] == 7 and got[1, 1] == 5 and got[2, 1] == 7
    assert chain.fill_nearest(tiles.limit(0), 3).count() == 0


def test_surface_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first().v
    assert [get(surface.mip_choice(F.lit(h), [4.0, 8.0, 16.0])) for h in (1.0, 4.0, 15.0, 99.0, 0.0)] == [0, 0, 1, 2, None]
    assert get(surface.failed_checks({"edge": F.lit(False), "junc": F.lit(None).cast("boolean"), "mip": F.lit(True)})) == "fail: edge"
    assert get(surface.contrast_blend([F.lit(3.0)] * 3, [F.lit(0.2), F.lit(0.3), F.lit(0.5)])) == pytest.approx(3.0)
    assert abs(get(surface.inverse_erf(F.lit(0.5))) - 0.476936) < 2e-3
    assert [get(surface.noise_layer(F.lit(n), 4)) for n in (0.0, 0.5, 0.9999)] == [0, 2, 3]
    assert get(surface.elevation_feature(F.lit(4.0), F.lit(9.0), "dem_height", 1.0, middle=1.0, inside=F.lit(-5.0))) == 4.0
    assert 0 <= get(surface.surface_noise(F.lit(-3.2), F.lit(8.9), 0.3)) < 1
