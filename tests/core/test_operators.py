"""Known answers and properties of the operators that SQL can't hold against."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbgrid.functions import scalar as fn
from plumbgrid.operators import quality, raster, spatial, store

POINTS = [(1, 0.0, 0.0), (2, 5.0, 5.0), (3, 50.0, 50.0), (4, -30.0, 20.0), (5, 0.1, 0.1)]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(POINTS, "id long, x double, z double")


@pytest.mark.parametrize(("radius", "ids"), [(1.0, {1, 5}), (200.0, {1, 2, 3, 4, 5}), (-1.0, set()), (0.0, {1})])
def test_radius(spark, points, radius, ids):
    q = spark.createDataFrame([(0, 0.0, 0.0, radius)], "qid long, qx double, qz double, radius double")
    assert {r.id for r in spatial.radius_join(points, q, 10.0).collect()} == ids


def test_rect_and_nearest(spark, points):
    rects = spark.createDataFrame([(0, -1.0, -1.0, 10.0, 10.0), (1, 0.0, 0.0, 5.0, 5.0)], "rid long, x0 double, z0 double, x1 double, z1 double")
    got = spatial.rect_join(points, rects, 10.0).collect()
    assert {r.id for r in got if r.rid == 0} == {1, 2, 5} and {r.id for r in got if r.rid == 1} == {1, 2, 5}
    assert {r.id for r in spatial.rect_join(points, rects, 10.0, closed=False).where("rid = 1").collect()} == {1, 5}
    q = spark.createDataFrame([(0, 0.0, 0.0), (9, 5000.0, 0.0)], "qid long, qx double, qz double")
    near = spatial.nearest_join(points, q, 3, 10.0).collect()
    assert [r.id for r in sorted(near, key=lambda r: (r.qid, r["rank"])) if r.qid == 0] == [1, 5, 2]
    assert spatial.nearest_join(points, q, 100, 10.0).count() == 10 and spatial.nearest_join(points, q, 0, 10.0).count() == 0


def test_plan_has_no_nested_loop(spark, points):
    q = points.selectExpr("id AS qid", "x AS qx", "z AS qz", "2e0 AS radius")
    plan = spatial.radius_join(points, q, 10.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_hashes_match_numpy(spark):
    xs = [0, 1, 61, 2**31, 2**32 - 1, *range(1000, 1100)]
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    assert [r[0] for r in df.select(fn.wang_hash(F.col("x"))).collect()] == fn.np_hash(np.array(xs, np.uint32)).tolist()
    cells = spark.createDataFrame([(x % 2000 - 1000, -(x % 77)) for x in xs], "a long, b long")
    got = [r[0] for r in cells.select(fn.lattice(F.col("a"), F.col("b"), 42)).collect()]
    assert got == fn.np_lattice(np.array([x % 2000 - 1000 for x in xs]), np.array([-(x % 77) for x in xs]), 42).tolist()


def test_noise(spark):
    x = np.linspace(-300, 300, 500)
    a = fn.np_fbm(x, x * 0.7, seed=7)
    assert (np.abs(a) <= 1).all() and a.std() > 0.05 and (a == fn.np_fbm(x, x * 0.7, seed=7)).all() and (a != fn.np_fbm(x, x * 0.7, seed=8)).any()


def peak(n):
    r, c = np.indices((n, n)) - (n - 1) / 2
    return 20 * np.exp(-(r**2 + c**2) / (2 * (n / 6) ** 2))


def test_erosion_properties():
    flat = raster.erode(np.full((16, 16), 0.5), iterations=10, thermal_iterations=5)
    assert np.allclose(flat["eroded"], 0.5, atol=1e-4) and (flat["vx"] == 0).all()
    a, b = raster.erode(peak(32)), raster.erode(peak(32))
    assert all((a[k] == b[k]).all() for k in a) and a["eroded"].max() <= peak(32).max() + 1 and a["flow_accum"].min() >= 1
    ramp = np.tile(np.linspace(0, 5, 16), (16, 1))
    assert raster.erode(ramp, iterations=5, thermal_iterations=0)["vx"][:, 2:-2].mean() < 0
    slid = raster.erode(peak(16), iterations=0, thermal_iterations=50)["eroded"]
    assert slid.max() < peak(16).max() and slid.sum() == pytest.approx(peak(16).sum(), rel=1e-4)
    assert (raster.erode(peak(16), gravity=1.0, seed=9)["eroded"] == raster.erode(peak(16))["eroded"]).all()
    with pytest.raises(TypeError):
        raster.erode(peak(16), rain=0.1)


SIDES = ((0, 1), (0, -1), (1, 0), (-1, 0))


def eroded_by_hand(h, p):
    """Cell by cell, in double precision."""
    n, m = h.shape
    h, water, mud = h.astype(float).copy(), np.zeros((n, m)), np.zeros((n, m))
    cells = [(y, x) for y in range(n) for x in range(m)]
    inside = lambda y, x: 0 <= y < n and 0 <= x < m
    limit = np.tan(np.radians(p["talus_angle_deg"]))

    def slide():
        change = np.zeros((n, m))
        for y, x in cells:
            for dy, dx in SIDES:
                if inside(y + dy, x + dx) and (over := h[y, x] - h[y + dy, x + dx] - limit) > 0:
                    change[y, x] -= p["talus_rate"] * over
                    change[y + dy, x + dx] += p["talus_rate"] * over
        h[:] += change

    every = max(1, p["iterations"] // p["thermal_iterations"]) if p["thermal_iterations"] else 0
    for step in range(p["iterations"]):
        water += p["rain_rate"]
        flow, moved = np.zeros((n, m, 4)), np.zeros((n, m))
        for y, x in cells:
            for k, (dy, dx) in enumerate(SIDES):
                if inside(y + dy, x + dx):
                    flow[y, x, k] = max(0.0, h[y, x] + water[y, x] - h[y + dy, x + dx] - water[y + dy, x + dx])
            if (total := flow[y, x].sum()) > 1e-8:
                flow[y, x] *= min(1.0, water[y, x] / total)
        for y, x in cells:
            for k, (dy, dx) in enumerate(SIDES):
                moved[y, x] -= flow[y, x, k]
                if inside(y + dy, x + dx):
                    moved[y + dy, x + dx] += flow[y, x, k]
        water += moved
        speed = np.hypot(flow[..., 0] - flow[..., 1], flow[..., 2] - flow[..., 3])
        before = h.copy()
        for y, x in cells:
            slope = [0.0, 0.0]
            for axis, (size, at) in enumerate(((n, y), (m, x))):
                lo, hi = max(at - 1, 0), min(at + 1, size - 1)
                ends = (before[hi, x], before[lo, x]) if axis == 0 else (before[y, hi], before[y, lo])
                slope[axis] = (ends[0] - ends[1]) / (hi - lo)
            gap = p["sediment_capacity"] * max(float(np.hypot(*slope)), p["min_slope"]) * speed[y, x] - mud[y, x]
            taken = (p["dissolve_rate"] if gap > 0 else p["deposit_rate"]) * gap
            h[y, x] -= taken
            mud[y, x] += taken
        water *= 1 - p["evaporation"]
        if every and step % every == 0:
            slide()
    if not p["iterations"]:
        for _ in range(p["thermal_iterations"]):
            slide()
    return h


@pytest.mark.parametrize("settings", [{}, {"iterations": 7, "thermal_iterations": 3, "rain_rate": 0.2}, {"iterations": 0, "thermal_iterations": 9, "talus_angle_deg": 10.0}, {"iterations": 5, "thermal_iterations": 0, "deposit_rate": 0.9}])
def test_erosion_by_hand(settings):
    h = peak(9) + np.random.default_rng(4).normal(size=(9, 9))
    assert np.allclose(raster.erode(h, **settings)["eroded"], eroded_by_hand(h.astype(np.float32), raster.EROSION | settings), atol=2e-3)


def test_drainage_by_hand():
    h = np.random.default_rng(6).normal(size=(9, 7))
    down = {}
    for y in range(9):
        for x in range(7):
            ways = [(-(h[y, x] - h[y + dy, x + dx]) / np.hypot(dy, dx), k, (y + dy, x + dx)) for k, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))) if 0 <= y + dy < 9 and 0 <= x + dx < 7]
            least = min(ways)
            down[y, x] = least[2] if least[0] < 0 else None
    amount = np.zeros((9, 7))
    for start in down:  # every cell's own unit runs down to its sink
        at = start
        while at is not None:
            amount[at] += 1
            at = down[at]
    expected = np.log1p(amount)
    assert np.allclose(raster.drainage(h), (expected - expected.min()) / (expected.max() - expected.min()))


def test_features_by_hand():
    h = np.random.default_rng(7).normal(size=(12, 12)).cumsum(0)
    reach, sigma = 8, 2.0
    kernel = [np.exp(-(d**2) / (2 * sigma**2)) for d in range(-reach, reach + 1)]
    mirrored = lambda k, n: k % (2 * n) if k % (2 * n) < n else 2 * n - 1 - k % (2 * n)
    smooth = h.copy()
    for axis in (0, 1):
        old = smooth if axis == 0 else smooth.T
        new = np.array([[sum(w * old[mirrored(y + d, 12), x] for w, d in zip(kernel, range(-reach, reach + 1), strict=True)) / sum(kernel) for x in range(12)] for y in range(12)])
        smooth = new if axis == 0 else new.T
    bend = np.array([[max(0.0, -sum(smooth[mirrored(y + dy, 12), mirrored(x + dx, 12)] - smooth[y, x] for dy, dx in SIDES)) for x in range(12)] for y in range(12)])
    assert np.allclose(raster.feature(h, "ridge_emphasis"), (bend - bend.min()) / (bend.max() - bend.min()))
    ramp = np.tile(np.arange(5.0), (5, 1))
    assert np.allclose(raster.feature(ramp, "slope_deg"), 45) and np.allclose(raster.feature(ramp, "aspect_deg"), 270)
    assert np.allclose(raster.feature(-ramp.T, "aspect_deg"), 180) and (raster.feature(ramp, "dem_height") == ramp).all()
    assert np.allclose(raster.resampled(ramp, 9)[0], np.arange(9) / 2) and raster.resampled(np.ones((1, 1)), 3).shape == (3, 3)
    with pytest.raises(ValueError):
        raster.feature(ramp, "fog")


def test_features():
    rows = np.repeat(np.arange(15, -1, -1.0)[:, None], 16, 1)
    run = raster.drainage(rows)
    assert run[-1].mean() > run[0].mean() and run.min() == 0 and run.max() == 1
    assert (raster.ridges(np.full((16, 16), 100.0)) == 0).all()
    assert np.unravel_index(raster.ridges(peak(33)).argmax(), (33, 33)) == (16, 16)
    assert quality.periodic(np.tile(np.sin(np.arange(64) * np.pi / 2), (64, 1))) > quality.periodic(np.random.default_rng(1).random((64, 64)))


def test_periodicity_by_hand():
    """The definition in plain loops over a shifted spectrum, with random and ruled pages."""
    r = np.random.default_rng(3)
    pages = np.stack([r.random((40, 48)), np.tile(np.sin(np.arange(48) * 2 * np.pi / 3), (40, 1)) + r.random((40, 48)) * 0.1])
    for page, got in zip(pages, quality.periodic(pages), strict=True):
        window = np.outer(np.hanning(40), np.hanning(48))
        power = {(y, x): abs(v) ** 2 for (y, x), v in np.ndenumerate(np.fft.fft2((page - page.mean()) * window))}
        power = {((y + 20) % 40 - 20, (x + 24) % 48 - 24): v for (y, x), v in power.items()}
        fast = {k: v for k, v in power.items() if max(abs(k[0]), abs(k[1])) > 8}
        peak_at = min(k for k, v in fast.items() if v >= max(fast.values()) * (1 - 1e-9))
        near = lambda d: [v for k, v in power.items() if max(abs(k[0] - peak_at[0]), abs(k[1] - peak_at[1])) <= d]  # noqa: E731, B023
        assert got == pytest.approx(max(near(3)) / np.median(near(12)))


def test_palette(spark):
    rows = [(0, k // 8, k % 8, *((250, 10, 10) if k < 40 else (10, 10, 250))) for k in range(64)] + [(1, 0, 0, 5, 6, 7)]
    got = quality.palette(spark.createDataFrame(rows, "img long, r int, c int, red int, green int, blue int"), "img", k=2).orderBy("img", "place").collect()
    assert [tuple(x) for x in got] == [(0, 0, 250, 10, 10, 0.625), (0, 1, 10, 10, 250, 0.375), (1, 0, 5, 6, 7, 1.0)]


def test_searches_of_every_size(spark):
    """Radii from nothing to all, dense and lone points, against all pairs."""
    r = np.random.default_rng(8)
    xs = np.concatenate([r.normal(size=(200, 2)) * 3, r.uniform(-1e4, 1e4, size=(100, 2)), np.zeros((50, 2))])
    points = spark.createDataFrame([(k, float(x), float(z)) for k, (x, z) in enumerate(xs)], "id long, x double, z double")
    asked = [(k, float(x), float(z), float(rad)) for k, (x, z, rad) in enumerate([(0, 0, 0), (0, 0, 2), (1, -1, 1e5), (5000, 5000, 3000), (-9e5, 3, 10), (0, 0, -1)])]
    queries = spark.createDataFrame(asked, "qid long, qx double, qz double, radius double")
    d2 = {(q, k): (x - qx) ** 2 + (z - qz) ** 2 for q, qx, qz, _ in asked for k, (x, z) in enumerate(xs.tolist())}
    got = {(x.qid, x.id) for x in spatial.radius_join(points, queries, 2.0).collect()}
    assert got == {(q, k) for (q, k), d in d2.items() if asked[q][3] >= 0 and d <= asked[q][3] ** 2}
    for k in (1, 7, 1000):
        near = spatial.nearest_join(points, queries, k, 2.0).collect()
        expected = {q: [i for _, i in sorted((d2[q, i], i) for i in range(len(xs)))[:k]] for q, *_ in asked}
        assert {q: [x.id for x in sorted(near, key=lambda x: x["rank"]) if x.qid == q] for q, *_ in asked} == expected
    assert spatial.nearest_join(points.limit(0), queries, 2, 2.0).count() == spatial.nearest_join(points, queries.limit(0), 2, 2.0).count() == 0


def test_rectangles_overlap_once(spark):
    r = np.random.default_rng(1)

    def some(n, wide):
        corner = r.uniform(-500, 500, size=(n, 2))
        return [(k, float(x), float(z), float(x + a), float(z + b)) for k, ((x, z), (a, b)) in enumerate(zip(corner, r.exponential(wide, size=(n, 2)), strict=True))]

    left, right = some(80, 5) + [(900, -2000.0, -2000.0, 2000.0, 2000.0), (901, 0.0, 0.0, 0.0, 5.0)], some(60, 60) + [(900, 2000.0, 0.0, 2001.0, 1.0)]
    a = spark.createDataFrame(left, "id long, x0 double, z0 double, x1 double, z1 double")
    b = spark.createDataFrame(right, "sub_id long, sx0 double, sz0 double, sx1 double, sz1 double")
    got = sorted((x.id, x.sub_id) for x in spatial.rect_overlaps(a, b, 8.0).collect())
    assert got == sorted((i, j) for i, x0, z0, x1, z1 in left for j, u0, v0, u1, v1 in right if x0 < u1 and x1 > u0 and z0 < v1 and z1 > v0)


def test_running_sums_with_ties(spark):
    rows = [(k, 5.0 if k < 900 else float(k), 2) for k in range(1000)] + [(1000, None, 1)]
    df = spark.createDataFrame(rows, "key long, last_access double, size_bytes long")
    got = {r.key: r.before for r in store.running(df, [F.col("last_access"), F.col("key")], F.col("size_bytes"), "before").collect()}
    assert got[1000] == 0 and all(got[k] == 1 + 2 * k for k in range(1000))
    assert {r.key for r in store.keep_recent(df, 10).collect()} == {1000, *range(990)}
    assert store.keep_recent(df, 5000).count() == 0 and store.keep_recent(df.limit(0), 1).count() == 0


def test_canonical_hash(spark):
    import hashlib
    import json

    values = [{"b": {"z": 1.5, "a": [1, 2]}, "a": "é\u4e2d", "c": None, "d": 1e22, "e": True}, {"b": {"z": 0.1, "a": []}, "a": "", "c": 3, "d": 1e-7, "e": False}]
    df = spark.createDataFrame([(v,) for v in values], "v struct<b: struct<z: double, a: array<int>>, a: string, c: int, d: double, e: boolean>")
    expected = [hashlib.sha256(json.dumps(v, sort_keys=True, separators=(",", ":")).encode()).hexdigest() for v in values]
    assert [r[0] for r in df.select(fn.canonical_hash(F.col("v"))).collect()] == expected
    maps = spark.createDataFrame([({"b": 1, "a": 2},)], "v map<string,int>")
    assert maps.select(fn.canonical_hash(F.col("v"))).first()[0] == hashlib.sha256(b'{"a":2,"b":1}').hexdigest()


def test_cycles_and_eviction(spark):
    deps = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "c")], "key string, depends_on string")
    one = spark.createDataFrame([("a", "a")], "start string, key string")
    assert {r.key for r in store.dependents(deps, one).collect()} == {"a", "b", "c", "d"}
    access = spark.createDataFrame([(k, 10, float(k)) for k in range(10)], "key long, size_bytes long, last_access double")
    assert {r.key for r in store.keep_newest(access, 35).collect()} == set(range(7))
    assert store.keep_newest(access, 100).count() == 0 and store.keep_newest(access.limit(0), 1).count() == 0


def test_semver(spark):
    df = spark.createDataFrame([("1.2.3",), ("0.1.0-beta.1",), ("x.1.2",), ("1.2",), ("",)], "v string")
    assert [tuple(r[0]) for r in df.select(fn.semver(F.col("v"))).collect()] == [(1, 2, 3), (0, 1, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0)]
