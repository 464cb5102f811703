"""Images, PNG files, DEM bundles and readers against plain loops and hand-made files."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbgrid.operators import images, materials
from plumbgrid.sources import files, png


def resized_by_hand(image, rows, cols, support):
    def shape(x):
        x = abs(x)
        if support == 3.0:
            return 1.0 if x == 0 else 0.0 if x >= 3 else 3 * np.sin(np.pi * x) * np.sin(np.pi * x / 3) / (np.pi * x) ** 2
        return 1 - 2.5 * x * x + 1.5 * x**3 if x < 1 else 2 - 4 * x + 2.5 * x * x - 0.5 * x**3 if x < 2 else 0.0

    def line(values, n):
        scale, out = len(values) / n, []
        wide = max(scale, 1)
        for k in range(n):
            center = (k + 0.5) * scale
            first, last = max(0, int(center - support * wide + 0.5)), min(len(values), int(center + support * wide + 0.5))
            w = [shape((i + 0.5 - center) / wide) for i in range(first, last)]
            out.append(min(255, max(0, int(np.floor(sum(a * float(b) for a, b in zip(w, values[first:last], strict=True)) / sum(w) + 0.5)))))
        return out

    across = [line(list(r), cols) for r in image] if image.shape[1] != cols else image.tolist()
    return np.array([line(list(c), rows) for c in zip(*across, strict=True)]).T if image.shape[0] != rows else np.array(across)


@pytest.mark.parametrize("support", [images.LANCZOS, images.BICUBIC])
@pytest.mark.parametrize("size", [(4, 4), (1, 1), (9, 20), (12, 10)])
def test_resized_by_hand(support, size):
    image = np.random.default_rng(1).integers(0, 256, (12, 10), np.uint8)
    assert np.abs(images.resized(image, *size, support).astype(int) - resized_by_hand(image, *size, support)).max() <= 1
    assert (images.resized(np.full((8, 8, 3), 77, np.uint8), 3, 5, support) == 77).all()


def test_fields():
    a = images.tileable_noise(24, 5, 42)
    assert a.shape == (24, 24) and abs(a.mean()) < 1e-5 and a.std() == pytest.approx(1, abs=1e-4) and (a == images.tileable_noise(24, 5, 42)).all() and (a != images.tileable_noise(24, 5, 43)).any()
    inner = np.abs(np.diff(a, axis=0)).max()
    assert np.abs(a[0] - a[-1]).max() <= inner * 1.5  # no seam
    assert images.tileable_fbm(16, 7).shape == (16, 16) and np.abs(images.wave_field(16, 3)).max() <= 1
    moved = images.matched_mean(np.full((4, 4, 3), 51, np.uint8), np.full((4, 4, 3), 0.8), 1.0)
    assert np.allclose(moved, 0.2)


def test_matching():
    r = np.random.default_rng(5)
    a, b = r.normal(40, 5, (64, 64)), r.normal(60, 12, (64, 64))
    to = images.matched_light(a.astype(np.float32), b.astype(np.float32))
    assert np.abs(np.quantile(to, [0.1, 0.5, 0.9]) - np.quantile(b, [0.1, 0.5, 0.9])).max() < 1.5
    spread = images.matched_spread(a, b)
    assert spread.mean() == pytest.approx(b.mean()) and spread.std() == pytest.approx(b.std(), rel=1e-5)
    rgb = r.integers(0, 256, (20, 20, 3), np.uint8)
    assert images.distance(rgb, rgb) == 0 < images.distance(rgb, rgb // 2)
    back = images.rgb_of(images.lab(np.full((2, 2, 3), 120, np.uint8)))
    assert np.abs(back.astype(int) - 120).max() <= 1


def test_image_tables(spark):
    r = np.random.default_rng(6)
    made = {k: r.integers(0, 256, (16, 16, 3), np.uint8) // (1 + k % 3) for k in range(4)}
    pixels = spark.createDataFrame([(k, y, x, *map(int, v)) for k, a in made.items() for y, row in enumerate(a) for x, v in enumerate(row)], "img long, r int, c int, red int, green int, blue int")
    rows = images.packed(pixels.repartition(5)).cache()
    assert {x.img: bytes(x.rgb) for x in rows.collect()} == {k: a.tobytes() for k, a in made.items()}
    got = {(x.img, x["size"]): x.stdev for x in images.mip_stdevs(rows, (32, 16, 4)).collect()}
    assert got.keys() == {(k, s) for k in made for s in (16, 4)}
    assert all(got[k, 16] == pytest.approx(images.luma(a).astype(float).std(), rel=1e-5) for k, a in made.items())
    assert {x.img: (x.red, x.green, x.blue) for x in images.mean_colors(rows).collect()} == {k: tuple(images.resized(a, 1, 1)[0, 0].tolist()) for k, a in made.items()}
    locked = {x.img: x for x in images.locked_to_anchor(rows.withColumns({"family": F.lit(7).cast("long"), "is_anchor": F.col("img") == 2}), "family", "is_anchor").collect()}
    assert locked[2].before == 0 and bytes(locked[2].rgb) == made[2].tobytes() and locked[0].after < locked[0].before
    rough = images.roughness_maps(rows, 0.9, 0.2).first()
    assert len(rough.rough) == 256 and images.mean_colors(rows.limit(0)).count() == 0
    snow, soil = (images.roughness(made[0], 0.5, 0.3, s).astype(int) for s in (True, False))
    assert (snow != soil).any()


@pytest.mark.parametrize("a", [np.arange(12, dtype=np.uint8).reshape(3, 4), (np.arange(30) * 2000).astype(np.uint16).reshape(5, 6), np.random.default_rng(1).integers(0, 256, (7, 5, 3), np.uint8), np.random.default_rng(2).integers(0, 65536, (4, 5, 4)).astype(np.uint16)])
def test_png_round_trip(a):
    back = png.decode(png.encode(a))
    assert back.dtype == a.dtype and (back == a).all()
    with pytest.raises(ValueError):
        png.decode(b"GIF89a")


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_png_filters(kind):
    """Lines filtered by their definitions."""
    a = np.random.default_rng(kind).integers(0, 256, (6, 5, 3), np.uint8)
    raw, out = a.reshape(6, 15).astype(int), b""
    for y in range(6):
        line = []
        for x in range(15):
            left, up, corner = (raw[y, x - 3] if x > 2 else 0), (raw[y - 1, x] if y else 0), (raw[y - 1, x - 3] if y and x > 2 else 0)
            guess = min((left, up, corner), key=lambda v: abs(left + up - corner - v))
            line.append((raw[y, x] - (0, left, up, (left + up) // 2, guess)[kind]) % 256)
        out += bytes([kind, *line])
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    data = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(out)) + part(b"IEND", b"")
    assert (png.decode(data) == a).all()


def test_dem_bundles(spark, tmp_path):
    h = np.linspace(100, 300, 20).reshape(4, 5)
    made = spark.createDataFrame([("hill", None, 4, 5, h.ravel().tolist()), ("hill", "slope_deg", 4, 5, (h / 10).ravel().tolist())], "id string, mode string, rows int, cols int, heights array<double>")
    out = {r.mode: r for r in files.quantized(made).collect()}
    (tmp_path / "hill.png").write_bytes(out[None].png)
    (tmp_path / "hill_slope_deg.png").write_bytes(out["slope_deg"].png)
    (tmp_path / "hill_aspect_deg.png").write_bytes(png.encode(np.zeros((2, 2), np.uint16)))
    side = {"id": "hill", "bounds_world_xz": [0, 0, 50, 40], "elevation_range_m": [out[None].lo, out[None].hi], "features": {"ranges": {"slope_deg": [10, 30], "aspect_deg": [0, 360]}}}
    (tmp_path / "hill.json").write_text(json.dumps(side))
    (tmp_path / "flat.json").write_text(json.dumps(side | {"id": "flat", "elevation_range_m": [5, 5]}))
    (tmp_path / "flat.png").write_bytes(out[None].png)
    (tmp_path / "bad.json").write_text(json.dumps(side | {"id": "bad"}))
    (tmp_path / "bad.png").write_bytes(b"no")
    got = {(r.id, r.mode): r for r in files.dem_bundles(spark, str(tmp_path)).collect()}
    assert got.keys() == {("hill", None), ("hill", "slope_deg")}
    assert np.allclose(got["hill", None].heights, h.ravel(), atol=200 / 65535) and (got["hill", None].rows, got["hill", None].x1) == (4, 50.0)
    assert np.allclose(got["hill", "slope_deg"].heights, h.ravel() / 10, atol=20 / 65535)


def test_readers(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"world_min_xz": [-1, -2], "world_max_xz": [3, 4], "texture": ""}))
    (tmp_path / "n.json").write_text(json.dumps({"world_min_xz": [-1, -2]}))
    assert [tuple(r)[1:] for r in files.macro_albedo(spark, str(tmp_path / "[mn].json")).collect()] == [(-1.0, -2.0, 3.0, 4.0, "")]
    place = tmp_path / "slots.json"
    place.write_text(json.dumps({"slots": [{"name": "rock", "siblings": ["a"]}, {"name": "sand"}]}))
    before = files.slot_index(spark, str(place))
    assert [(r.place, r.name, r.siblings) for r in before.orderBy("place").collect()] == [(0, "rock", ["a"]), (1, "sand", None)]
    held = spark.createDataFrame(before.collect(), before.schema)
    place.write_text("{")
    assert files.slot_index(spark, str(place)).count() == 0 and files.slot_index(spark, str(place), held).count() == 2
    (tmp_path / "_index.json").write_text(json.dumps({"biome": "b", "slot": "s", "candidates": {"00_x": {"grade": "A", "size": 4}, "01_y": {}}}))
    assert {(r.id, r.entry.grade) for r in files.candidate_index(spark, str(tmp_path / "_index.json")).collect()} == {("00_x", "A"), ("01_y", None)}
    (tmp_path / "p.cfg").write_text('[plugin]\nname="x"\nversion="1.4.2"\n')
    (tmp_path / "q.cfg").write_text("name=1")
    assert {r.version for r in files.version(spark, str(tmp_path / "*.cfg")).collect()} == {"1.4.2", "0.0.0"}
    text = "# a matrix\nbiome: alpine\nslots:\n  rock:\n    prompts:\n      - 'one, two'\n      - three # late\n    size: 512\n  sand: {}\nlist:\n- a: 1\n  b: \"x: y\"\n- a: 2\n"
    (tmp_path / "b.yaml").write_text(text)
    got = {(r.path, r.value) for r in files.prompt_matrix(spark, str(tmp_path / "b.yaml")).collect()}
    assert got == {("biome", "alpine"), ("slots.rock.prompts.0", "one, two"), ("slots.rock.prompts.1", "three"), ("slots.rock.size", "512"), ("slots.sand", "{}"), ("list.0.a", "1"), ("list.0.b", "x: y"), ("list.1.a", "2")}
    first = files.hashed(spark, str(tmp_path), None, "*.cfg")
    before = first.collect()
    memo = spark.createDataFrame([(r.file, r.modified, r.size_bytes, "memo" if r.file.endswith("p.cfg") else r.sha256) for r in before], first.schema)
    (tmp_path / "q.cfg").write_text("name=22")
    again = {r.file[-5:]: r.sha256 for r in files.hashed(spark, str(tmp_path), memo, "*.cfg").collect()}
    assert again["p.cfg"] == "memo" and again["q.cfg"] not in {r.sha256 for r in before}
    files.write_report(spark.createDataFrame([(1, "x")], "id int, reason string"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().reason == "x"


def test_promotion(spark):
    kind = "slot string, place int, id string, source string, weight double"
    manifest = spark.createDataFrame([("rock", 0, "default", "rock", 1.0), ("rock", 1, "v0_old", "rock_variants/v0_old", 0.3), ("sand", 0, "default", "sand", 1.0)], kind)
    candidates = spark.createDataFrame([("rock", t) for t in "abcdefghij"], "slot string, tag string")
    ask = lambda base, siblings: spark.createDataFrame([("rock", base, siblings)], "slot string, base string, siblings array<string>")
    got = sorted(map(tuple, materials.promoted(manifest, ask("a", ["b", "c"]), candidates).collect()))
    assert got == [("rock", 0, "default", "rock", 1.0), ("rock", 1, "v0_b", "rock_variants/v0_b", 1.0), ("rock", 2, "v1_c", "rock_variants/v1_c", 1.0), ("sand", 0, "default", "sand", 1.0)]
    again = materials.promoted(materials.promoted(manifest, ask("a", ["b", "c"]), candidates), ask("a", None), candidates)
    assert sorted((r.slot, r.id) for r in again.collect()) == [("rock", "default"), ("sand", "default")]
    for wrong in (ask("z", []), ask("a", list("bcdefghi")), ask("a", ["y"])):
        with pytest.raises(ValueError, match="refused"):
            materials.promoted(manifest, wrong, candidates)
    assert sorted(r.code for r in materials.promotion_errors(ask("z", list("bcdefghi")), candidates).collect()) == ["missing", "over_cap"]
