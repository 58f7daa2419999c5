"""The raster engine against brute force in double precision, and its edge cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastermill.functions import scores as fn
from rastermill.operators import matching, peaks, rules
from rastermill.plans import geometry
from rastermill.sources import rasters, reports, scenes


def rows_of(spark, image: np.ndarray, image_id: int = 0):
    return spark.createDataFrame([(image_id, y, line.ravel().tolist()) for y, line in enumerate(image)], rasters.ROWS)


def templates_of(spark, *images: np.ndarray, gray: bool = False):
    return spark.createDataFrame([(i, i, t.shape[1], t.shape[0], gray, t.ravel().tolist()) for i, t in enumerate(images)], matching.TEMPLATE)


def brute(image: np.ndarray, t: np.ndarray) -> np.ndarray:
    th, tw = t.shape[:2]
    out = np.zeros((image.shape[0] - th + 1, image.shape[1] - tw + 1))
    d = t - t.mean((0, 1))
    for y in range(out.shape[0]):
        for x in range(out.shape[1]):
            w = image[y : y + th, x : x + tw].astype(float)
            w = w - w.mean((0, 1))
            size = np.sqrt((w * w).sum() * (d * d).sum())
            out[y, x] = (w * d).sum() / size if size else 0
    return out


def noise(seed: int, *shape: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 256, shape)


def as_map(df, shape) -> np.ndarray:
    out = np.full(shape, np.nan)
    for r in df.select("y", "x", "score").collect():
        out[r["y"], r["x"]] = r["score"]
    return out


@pytest.mark.parametrize("method", ["tiles", "join"])
@pytest.mark.parametrize(("shape", "size"), [((23, 31, 1), (5, 7)), ((16, 12, 4), (3, 4)), ((12, 12, 3), (12, 12)), ((9, 8, 4), (1, 1))])
def test_response_map(spark, method, shape, size):
    image, t = noise(1, *shape), noise(2, *size, shape[2])
    got = as_map(matching.response_map(rows_of(spark, image), templates_of(spark, t), shape[2], method, band=6 if method == "tiles" else 256), (shape[0] - size[0] + 1, shape[1] - size[1] + 1))
    want = brute(image, t) if size != (1, 1) else None
    if want is None:  # one pixel has no spread: a flat template
        assert (got == 1).all()
    else:
        assert np.abs(got - want).max() < 1e-9


def test_large_template_by_transform():
    image, t = noise(3, 60, 70, 2), noise(4, 25, 30, 2)
    assert np.abs(matching.scores(image, t) - brute(image, t)).max() < 1e-9


@pytest.mark.parametrize("cn", [1, 4])
def test_templates_of_several_buckets_share_a_block(cn):
    image = noise(18, 90, 300, cn)
    sizes = [(25, 30), (60, 9), (9, 60), (24, 24), (5, 5), (90, 300), (88, 20), (91, 5)]
    held = [matching.Held(i, i, False, noise(30 + i, *s, cn).astype(np.uint8)) for i, s in enumerate(sizes)]
    held.append(matching.Held(8, 8, False, np.full((6, 6, cn), 7, np.uint8)))
    got = {t.template_id: m for t, m in matching.Block(image).scores([(t, cn) for t in held])}
    assert set(got) == {0, 1, 2, 3, 4, 5, 6, 8}
    assert (got[8] == 1).all()
    for i in (0, 2, 4, 5, 6):
        assert np.abs(got[i] - brute(image, held[i].values)).max() < 1e-9


def test_alpha_that_says_nothing_is_left_out(spark):
    image, t = noise(19, 30, 20, 4), noise(20, 6, 5, 4)
    image[:, :, 3], t[:, :, 3] = 200, 55
    varied = t.copy()
    varied[0, 0, 3] = 56
    flags = [(image, t, 3), (image, varied, 4), (noise(19, 30, 20, 4), t, 4), (noise(21, 30, 20, 4), varied, 4)]
    for frame, template, used in flags:
        want = as_map(matching.response_map(rows_of(spark, frame[:, :, :used]), templates_of(spark, template[:, :, :used]), used), (25, 16))
        for method in ("tiles", "join"):
            got = as_map(matching.response_map(rows_of(spark, frame), templates_of(spark, template), 4, method), (25, 16))
            assert (got == want).all()
    both = rows_of(spark, image).unionByName(rows_of(spark, flags[2][0], 1))
    got = {(r["image_id"], r["template_id"]): tuple(r)[2:] for r in matching.find_all(both, templates_of(spark, t, varied), 4).drop("ord").select("image_id", "template_id", "min_v", "min_x", "min_y", "max_v", "max_x", "max_y").collect()}
    alone = matching.match(rows_of(spark, image[:, :, :3]), templates_of(spark, t[:, :, :3]), 3).first()
    assert got[0, 0] == tuple(alone)[2:]


def test_iterate(spark):
    image, t = noise(22, 20, 30, 1), noise(23, 5, 4, 1)
    moved = image.copy()
    image[3:8, 4:8] = moved[10:15, 20:24] = t
    found = [df.first() for df in matching.iterate([rows_of(spark, image), rows_of(spark, moved)], templates_of(spark, t))]
    assert [(r["max_x"], r["max_y"]) for r in found] == [(4, 3), (20, 10)]


def test_area_cap_and_ragged_rows(spark):
    big = spark.createDataFrame([(0, 0, 4000, 3000, False, [1])], matching.TEMPLATE)
    with pytest.raises(ValueError, match="more than"):
        matching.match(rows_of(spark, noise(1, 4, 4, 1)), big)
    with pytest.raises(ValueError, match="values"):
        matching.match(rows_of(spark, noise(1, 4, 4, 1)), templates_of(spark, noise(1, 2, 2, 1)).withColumn("w", F.lit(3)))
    for bad in ([(0, 0, [1, 2, 3, 4]), (0, 1, [1, 2, 3])], [(0, 0, [1, 2, 3]), (0, 1, [1, 2, 3])]):
        with pytest.raises(Exception, match="equal lengths"):
            matching.match(spark.createDataFrame(bad, rasters.ROWS), templates_of(spark, noise(1, 1, 2, 2)), 2).collect()


def test_planted_template_is_found(spark):
    image = noise(5, 40, 50, 1)
    t = image[11:19, 21:33].copy()
    r = matching.match(rows_of(spark, image), templates_of(spark, t), band=7).first()
    assert (r["max_x"], r["max_y"]) == (21, 11)
    assert r["max_v"] > 0.9999


def test_flat_template_flat_window_and_no_fit(spark):
    image = np.full((10, 10, 1), 128)
    flat, bumpy, large = np.full((2, 2, 1), 9), noise(6, 2, 2, 1), noise(7, 11, 2, 1)
    got = {r["template_id"]: tuple(r)[2:] for r in matching.match(rows_of(spark, image), templates_of(spark, flat, bumpy, large)).collect()}
    assert got == {0: (1, 0, 0, 1, 0, 0), 1: (0, 0, 0, 0, 0, 0)}


def test_single_bump_canary(spark):
    image, t = np.full((150, 200, 1), 128), np.full((32, 32, 1), 128)
    image[75, 100] = t[5, 7] = 129
    r = matching.match(rows_of(spark, image), templates_of(spark, t)).first()
    assert (r["max_v"], r["max_x"], r["max_y"]) == (1.0, 93, 70)
    assert (r["min_x"], r["min_y"]) == (69, 44)
    assert abs(r["min_v"] + 0.00097752) < 1e-7


def test_results_do_not_depend_on_partitions_or_bands(spark):
    image, t = noise(8, 30, 20, 1), noise(9, 4, 4, 1)
    got = {tuple(matching.match(rows_of(spark, image).repartition(n), templates_of(spark, t), band=b).first()) for n, b in ((1, 5), (3, 8), (5, 256))}
    assert len(got) == 1


def test_checks(spark):
    rows = rows_of(spark, noise(1, 4, 4, 1))
    with pytest.raises(ValueError, match="no templates"):
        matching.match(rows, templates_of(spark, noise(1, 2, 2, 1)).limit(0))
    mixed = templates_of(spark, noise(1, 2, 2, 1)).unionByName(templates_of(spark, noise(1, 2, 2, 1), gray=True))
    with pytest.raises(ValueError, match="grey"):
        matching.match(rows, mixed)
    assert matching.match(rows.limit(0), templates_of(spark, noise(1, 2, 2, 1))).count() == 0


def test_alpha_and_grey(spark):
    image = noise(10, 5, 6, 4)
    image[:, :, 3] = 200
    assert matching.alpha_constant(rows_of(spark, image)).first()["a_const"]
    grey = np.array([r["data"] for r in rasters.grey_rows(rows_of(spark, image), 4).orderBy("y").collect()])
    assert (grey == (image[:, :, :3] @ np.array([4899, 9617, 1868]) + 8192) >> 14).all()
    t = image[1:4, 2:5]
    a = matching.match(rasters.select_channels(rows_of(spark, image), 4, 3), templates_of(spark, t[:, :, :3]), 3).first()
    b = matching.match(rows_of(spark, image), templates_of(spark, t), 4).first()
    assert abs(a["max_v"] - b["max_v"]) < 1e-5
    assert (a["max_x"], a["max_y"]) == (b["max_x"], b["max_y"]) == (2, 1)


def test_window_sums(spark):
    image = noise(11, 9, 8, 2)
    got = {(r["c"], r["y"], r["x"]): (r["s"], r["s2"]) for r in matching.window_sums(rows_of(spark, image), 2, 3, 4).collect()}
    want = {(c, y, x): (int(w.sum()), int((w * w).sum())) for c in range(2) for y in range(6) for x in range(6) for w in [image[y : y + 4, x : x + 3, c]]}
    assert got == want


def test_peaks(spark):
    image = noise(12, 40, 40, 1) % 64
    t = noise(13, 6, 8, 1)
    spots = [(3, 4), (20, 10), (30, 28)]
    for y, x in spots:
        image[y : y + 6, x : x + 8] = t
    found = peaks.local_maxima(matching.response_map(rows_of(spark, image), templates_of(spark, t)), 0.999, 4, 3)
    assert sorted((r["y"], r["x"]) for r in found.collect()) == spots
    assert [r["rank"] for r in peaks.ranked(found, 2).orderBy("rank").collect()] == [1, 2]
    assert peaks.ambiguity(found).first()["gap"] < 1e-9


def test_rules(spark):
    frame = np.zeros((60, 80, 4), int)
    frame[:, :, 0], frame[:, :, 1], frame[:, :, 2], frame[:, :, 3] = 30 + np.arange(80) // 4, 40 + np.arange(60)[:, None] // 4, 64, 255
    widget, other = noise(14, 8, 10, 4), noise(15, 8, 10, 4)
    widget[:, :, 3] = other[:, :, 3] = 255
    frame[40:48, 50:60] = widget
    templates = templates_of(spark, widget, other)
    table = [(1, 0, "first", None, False, 0.95, rules.FIRST, [1, 0]), (2, 1, "all", (80, 60, 40, 30), True, 0.95, rules.ALL, [1, 0]), (3, 2, "small", (0, 0, 5, 5), False, 0.1, rules.ALL, [0]), (4, 3, "off", (200, 200, 300, 300), False, 0.1, rules.FIRST, [0])]
    got = {r["rule_id"]: r for r in rules.verdicts(rows_of(spark, frame), spark.createDataFrame(table, rules.RULES), templates).collect()}
    assert got[1]["matched"]
    assert got[1]["best"]["template_id"] == 0
    assert tuple(got[1]["best"]["rect"]) == (50, 40, 60, 48)
    assert got[1]["all"] == []
    assert got[2]["matched"]
    assert [h["template_id"] for h in got[2]["all"]] == [1, 0]
    assert not got[3]["matched"]
    assert got[3]["all"] == []
    assert not got[4]["matched"]


def test_rule_fixture(spark):
    """The reproducible frame: a button that moves, two tray icons, a panel, a region in which nothing fits."""
    base, moved = scenes.widget_frame(), scenes.widget_frame(True)
    parts = {101: (120, 36, 21), 102: (24, 24, 7), 103: (24, 24, 9), 105: (300, 200, 33), 100: (120, 36, 99), 104: (24, 24, 77)}
    templates = spark.createDataFrame([(i, k, w, h, False, scenes.widget(w, h, s).ravel().tolist()) for k, (i, (w, h, s)) in enumerate(parts.items())], matching.TEMPLATE)
    table = [(1, 0, "confirm-button", None, False, 0.95, rules.FIRST, [100, 101]), (2, 1, "tray-status", (1150, 0, 1280, 48), True, 0.95, rules.ALL, [102, 103, 104]), (3, 2, "main-panel", (180, 180, 520, 420), False, 0.95, rules.FIRST, [105]), (4, 3, "oversized-roi", (0, 0, 40, 40), False, 0.95, rules.FIRST, [105])]
    rows = scenes.image_rows(spark, base).unionByName(scenes.image_rows(spark, moved, 1))
    found = rules.verdicts(rows, spark.createDataFrame(table, rules.RULES), templates)
    got = {(r["image_id"], r["rule_id"]): r for r in found.collect()}
    assert len(got) == 8
    for frame, x in ((0, 860), (1, 600)):
        assert got[frame, 1]["best"]["template_id"] == 101
        assert tuple(got[frame, 1]["best"]["rect"]) == (x, 700, x + 120, 736)
        assert [h["template_id"] for h in got[frame, 2]["all"]] == [102, 103, 104]
        assert [tuple(h["rect"])[:2] for h in got[frame, 2]["all"]][:2] == [(1180, 12), (1216, 12)]
        assert got[frame, 2]["best"]["template_id"] in (102, 103)
        assert abs(got[frame, 2]["all"][2]["score"] - 0.9593) < 1e-4
        assert tuple(got[frame, 3]["best"]["rect"]) == (200, 200, 500, 400)
        assert not got[frame, 4]["matched"]
    moves = rules.changes(found).collect()
    assert [(r["image_id"], r["rule_id"]) for r in moves] == [(1, 1)]
    assert {r["rule_id"] for r in rules.changes(found, span=1).collect()} == {1}


def test_scenes(spark, tmp_path):
    (tmp_path / "photo.png").write_bytes(png(noise(24, 8, 9, 3)))
    table, rows = scenes.scenes(spark, [str(tmp_path / "*.png"), str(tmp_path / "absent.png")])
    got = {r["name"]: r for r in table.collect()}
    assert (got["window1600_button"]["px"], got["window1600_button"]["py"]) == (893, 614)
    assert got["photo_photo"]["px"] == -1
    assert rows.where("image_id = 0").count() == 1000
    assert rows.where("image_id > 0 or image_id < 0").count() == 8
    frame, boxes = scenes.desktop(1600, 1000)
    for name in ("button", "icon", "panel"):
        x0, y0, x1, y1 = boxes[name]
        area = frame[max(0, y0 - 150) : y1 + 40, max(0, x0 - 130) : x1 + 130]
        found = matching.scores(area, scenes.cut(frame, boxes[name]))
        assert np.unravel_index(found.argmax(), found.shape) == (min(150, y0), min(130, x0))
    assert rasters.read_images(spark, str(tmp_path / "absent.png"))[1].count() == 0


def test_dumps(spark, tmp_path):
    image, t = noise(25, 7, 9, 3), noise(26, 3, 4, 3)
    dump = rasters.raw_dumps(rows_of(spark, image, 5), 3).first()
    (tmp_path / "a.raw").write_bytes(dump["content"])
    responses = matching.response_map(rows_of(spark, image), templates_of(spark, t), 3)
    scores = rasters.score_dumps(responses)
    (tmp_path / "b.raw").write_bytes(scores.first()["content"])
    raw = rasters.read_raw(spark, str(tmp_path / "*.raw"))
    back = np.array([r["data"] for r in rasters.raw_rgba_rows(raw).orderBy("y").collect()]).reshape(7, 9, 4)
    assert (back[:, :, :3] == image).all()
    assert (back[:, :, 3] == 255).all()
    got = as_map(rasters.raw_scores(raw), (5, 6))
    assert np.abs(got - as_map(responses, (5, 6))).max() < 1e-7
    rasters.write_manifest(scores, str(tmp_path / "manifest"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "manifest")).first().asDict() == {"image_id": "0", "template_id": "0", "width": "6", "height": "5"}


def test_parity(spark):
    schema = "image_id long, template_id long, y int, x int, score double"
    table = lambda scores: spark.createDataFrame([(0, 0, k // 2, k % 2, s) for k, s in enumerate(scores)], schema)
    for theirs, status, worst in (([0.1, 0.9, 0.2, 0.3], "ok", 0.0), ([0.1, 0.9, 0.901, 0.3], "tie", 0.701), ([0.1, 0.5, 0.9, 0.3], "mismatch", 0.7)):
        r = peaks.parity(table([0.1, 0.9, 0.2, 0.3]), table(theirs)).first()
        assert (r["status"], r["positions"]) == (status, 4)
        assert abs(r["worst"] - worst) < 1e-9
    assert peaks.digest(table([1.0, 0.5])).first()["digest"] == peaks.digest(table([1.0, 0.5]).repartition(2)).first()["digest"] != peaks.digest(table([0.5, 1.0])).first()["digest"]


def test_reports(spark, tmp_path):
    log = ["BenchmarkMatch/noise_a-4   10   2500000 ns/op", "BenchmarkMatch/noise_a-4   12   2000000.5 ns/op", "BenchmarkMatchGray/noise_a   3   1000000 ns/op", "noise_a 7.5 ms 6.1 ms", "gray:noise_a 3.5 ms", "impl=match x peakHWM=2048 kB", "impl=match y peakHWM=1024 kB", "scene=noise_a worst_abs=1.5e-06 loc=ok", "other"]
    (tmp_path / "log.txt").write_text("\n".join(log))
    lines = reports.lines(spark, str(tmp_path / "log.txt"))
    assert [tuple(r) for r in reports.best_of(reports.timings(lines), "kind", "scene", "cpus").orderBy("kind").collect()] == [("Match", "noise_a", 4, 2.0000005, 2), ("MatchGray", "noise_a", 1, 1.0, 1)]
    assert {tuple(r) for r in reports.native_timings(lines).collect()} == {("color", "noise_a", 7.5), ("gray", "noise_a", 3.5)}
    assert tuple(reports.memory(lines).first()) == ("match", 2.0)
    assert tuple(reports.parities(lines).first()) == ("noise_a", 1.5e-06)
    times = spark.createDataFrame([("a", "x", 2.0), ("a", "y", 5.0), ("b", "x", 1.0), ("b", "y", 4.0), ("c", "x", 1.0)], "scene string, impl string, ms double")
    assert tuple(reports.ratios(times, "x", "y").first()) == (2.5, 4.0, 2)
    again = reports.refreshed(times, spark.createDataFrame([("a", "x", 3.0)], times.schema), "scene", "impl")
    assert sorted(tuple(r) for r in again.collect())[:2] == [("a", "x", 3.0), ("a", "y", 5.0)]
    assert reports.write_report(again, str(tmp_path / "report"), "scene", "impl").splitlines()[2] == "| a | x | 3.0 |"
    assert spark.read.json(str(tmp_path / "report")).count() == 5
    first = reports.pinned({"a": "1"}, None, "first")
    assert reports.pinned({"a": "1"}, first, "first") == first
    for digests, reason in (({"a": "2"}, "first"), ({"a": "2"}, " ")):
        with pytest.raises(ValueError, match="reason"):
            reports.pinned(digests, first, reason)


@pytest.mark.parametrize(("rule", "word"), [((1, 0, "r", (5, 0, 5, 9), False, 0.5, 0, [0]), "area"), ((1, 0, "r", None, False, 0.5, 7, [0]), "mode"), ((1, 0, "r", None, False, 0.5, 0, [9]), "template 9")])
def test_bad_rules(spark, rule, word):
    with pytest.raises(ValueError, match=word):
        rules.compiled(spark.createDataFrame([rule], rules.RULES), templates_of(spark, noise(1, 2, 2, 4)), 4)


def test_template_with_two_sizes(spark):
    two = templates_of(spark, noise(1, 2, 2, 4)).unionByName(templates_of(spark, noise(1, 3, 2, 4)).withColumn("ord", F.lit(1)))
    with pytest.raises(ValueError, match="two sizes"):
        rules.compiled(spark.createDataFrame([(1, 0, "r", None, False, 0.5, 0, [0])], rules.RULES), two, 4)


#: (tw, th, rw, rh, dft_w, dft_h, block_w, block_h): pinned plans.
PINS = [
    (128, 128, 1793, 953, 1024, 512, 897, 385), (96, 32, 1505, 969, 512, 1024, 417, 969), (32, 32, 1889, 1049, 512, 256, 481, 225), (256, 256, 3585, 1905, 2048, 1024, 1793, 769), (24, 24, 1577, 977, 256, 512, 233, 489),
    (80, 80, 433, 401, 512, 512, 433, 401), (64, 64, 449, 449, 512, 512, 449, 449), (100, 100, 769, 501, 512, 256, 413, 157), (128, 128, 625, 473, 512, 512, 385, 385), (64, 64, 1, 1, 64, 64, 1, 1),
    (1, 1, 50, 40, 4, 2, 4, 2), (33, 257, 8, 44, 64, 512, 8, 44), (17, 13, 81, 49, 64, 64, 48, 49), (1, 400, 2000, 1, 32, 512, 32, 1), (400, 1, 1, 2000, 512, 2, 1, 2),
]


def test_plans(spark):
    table = geometry.best_tiles(geometry.shape_table(spark, [p[:4] for p in PINS])).orderBy("plan_id").collect()
    assert [tuple(r)[1:5] for r in table] == [p[4:] for p in PINS]
    assert [geometry.tile_for(*p[:4]) for p in PINS] == [p[4:] for p in PINS]
    assert geometry.tile_for(3000, 2000, 1, 1) == (4096, 2048, 1, 1)


def bucketed(spark, *sides):
    table = spark.createDataFrame([(k, *s) for k, s in enumerate(sides)], "template_id long, w int, h int, flat boolean, channels int")
    got: dict[tuple, list[int]] = {}
    for r in geometry.buckets(table).orderBy("template_id").collect():
        got.setdefault((r["w_class"], r["h_class"]), []).append(r["template_id"])
    return got, {tuple(r) for r in geometry.bucket_maxima(table).collect()}


def test_buckets(spark):
    assert bucketed(spark, (300, 8, False, 3), (8, 300, False, 4)) == ({(512, 8): [0], (8, 512): [1]}, {(512, 8, 1, 300, 8, 3), (8, 512, 1, 8, 300, 4)})
    assert bucketed(spark, (24, 24, False, 3), (200, 100, False, 3), (64, 128, False, 4)) == ({(256, 128): [0, 1, 2]}, {(256, 128, 3, 200, 128, 4)})
    assert bucketed(spark, (400, 300, True, 4), (24, 24, False, 1)) == ({(32, 32): [1]}, {(32, 32, 1, 24, 24, 1)})
    sides = [(24, 24), (96, 32), (48, 48), (300, 200), (16, 16), (64, 128), (8, 512)]
    own = matching.bucket_of([(h, w) for w, h in sides])
    table, _ = bucketed(spark, *((w, h, False, 1) for w, h in sides))
    assert {tuple(sorted(i for i, (w, h) in enumerate(sides) if own[h, w] == b)) for b in own.values()} == {tuple(m) for m in table.values()}


def test_tiles_cover_the_result_once(spark):
    shapes = geometry.shape_table(spark, [(17, 13, 81, 49), (3000, 2000, 1, 1), (5, 5, 700, 300)])
    grid = geometry.tile_grid(shapes.join(geometry.best_tiles(shapes), "plan_id"))
    area = {r["plan_id"]: r["a"] for r in grid.groupBy("plan_id").agg(F.sum(F.col("bw") * F.col("bh")).alias("a")).collect()}
    assert area == {0: 81 * 49, 1: 1, 2: 700 * 300}
    assert geometry.best_tiles(shapes).where("plan_id = 1").first()["cost"] == -1


def test_scalar_functions(spark):
    one = spark.range(1)
    got = one.select(*(fn.next_pow2(F.lit(n)).alias(str(n)) for n in (1, 2, 3, 4, 5, 1024, 1025))).first()
    assert tuple(got) == (1, 2, 4, 4, 8, 1024, 2048)
    assert [fn.clamp_workers(n, 8) for n in (-1, 0, 1, 20)] == [8, 8, 1, 16]
    assert one.select(fn.lcg(F.lit((1 << 32) - 1))).first()[0] == (((1 << 32) - 1) * 1664525 + 1013904223) % (1 << 32)
    box = fn.rect(*(F.lit(v) for v in (9, 8, 3, 2)))
    assert tuple(one.select(box.alias("r")).first()["r"]) == (3, 2, 9, 8)
    other = fn.rect(*(F.lit(v) for v in (5, 0, 12, 4)))
    got = one.select(fn.intersect(box, other).alias("r"), fn.is_empty(fn.intersect(box, other)).alias("e"), fn.is_empty(fn.intersect(box, fn.rect(*(F.lit(v) for v in (9, 2, 12, 4))))).alias("n")).first()
    assert (tuple(got["r"]), got["e"], got["n"]) == ((5, 2, 9, 4), False, True)


def test_raw_dumps(spark, tmp_path):
    image = noise(16, 3, 4, 4).astype(np.uint8)
    (tmp_path / "a.raw").write_bytes(rasters.raw_bytes(rasters.RAW_RGBA, 4, 3, image.tobytes()))
    scores = np.linspace(-1, 1, 6, dtype="<f4")
    (tmp_path / "b.raw").write_bytes(rasters.raw_bytes(rasters.RAW_FLOAT, 3, 2, scores.tobytes()))
    raw = rasters.read_raw(spark, str(tmp_path))
    lines = rasters.raw_rgba_rows(raw).orderBy("y").collect()
    assert (np.array([r["data"] for r in lines]).reshape(3, 4, 4) == image).all()
    assert [r["score"] for r in rasters.raw_scores(raw).orderBy("y", "x").collect()] == scores.tolist()


def png(image: np.ndarray) -> bytes:
    import struct
    import zlib

    h, w, n = image.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + line.astype(np.uint8).tobytes() for line in image)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_image_files_and_stream(spark, tmp_path):
    from rastermill.streaming import frames

    image = noise(17, 12, 14, 3)
    folder = tmp_path / "images"
    folder.mkdir()
    (folder / "a.png").write_bytes(png(image))
    (folder / "bad.png").write_bytes(b"no image")
    table, rows = rasters.read_images(spark, str(folder))
    assert table.count() == 1
    assert (np.array([r["data"] for r in rows.orderBy("y").collect()]).reshape(image.shape) == image).all()
    got = []
    template = templates_of(spark, image[3:8, 5:9])
    query = frames.match_stream(frames.frame_stream(spark, str(folder)), template, 3, lambda df, _: got.extend(df.collect()), str(tmp_path / "state"), available_now=True)
    query.awaitTermination(120)
    assert [(r["max_x"], r["max_y"]) for r in got] == [(5, 3)]


def test_synthetic_sources(spark):
    rows = rasters.noise_rows(spark, 9, 7, alpha=True)
    data = np.array([r["data"] for r in rows.orderBy("y").collect()]).reshape(7, 9, 4)
    assert data.min() >= 0
    assert data.max() <= 255
    assert data[:, :, 3].min() >= 64
    worse = np.array([r["data"] for r in rasters.degraded_rows(rows, 40).orderBy("y").collect()]).reshape(7, 9, 4)
    assert (worse[:, :, 3] == data[:, :, 3]).all()
    assert 0 < np.abs(worse - data).max() <= 40
