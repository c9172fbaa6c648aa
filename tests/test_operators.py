import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from redlight.operators import detections, graph, identity, images, indicators, reads, tracks
from redlight.sources import io


def test_components_are_those_of_a_search(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    root = {}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = start
                todo += near[x]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if near[k] != {k}}


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(40):
        c = rng.random((rng.integers(1, 5), rng.integers(1, 5)))
        pairs = tracks.assign(c)
        n, m = c.shape
        best = min(sum(c[i, j] for i, j in zip(range(n), q)) for q in itertools.permutations(range(m), n)) if n <= m else min(sum(c[i, j] for i, j in zip(q, range(m))) for q in itertools.permutations(range(n), m))
        assert sum(c[i, j] for i, j in pairs) == pytest.approx(best) and len(pairs) == min(n, m)


def moving(frames, dx=2.0, x=10.0, y=10.0):
    return [(f, x + dx * f, y, x + dx * f + 30, y + 20) for f in frames]


def run_track(spark, boxes, parts=1, **options):
    rows = [("s", f, i, *b) for i, (f, *b) in enumerate(boxes)]
    df = spark.createDataFrame(rows, "seq string, frame long, det_id long, x1 double, y1 double, x2 double, y2 double").repartition(parts)
    return sorted((r["frame"], r["track_id"]) for r in tracks.track(df, "seq", **options).collect())


def test_tracker_keeps_ids_and_bridges_gaps(spark):
    two = moving(range(1, 9)) + moving(range(1, 9), -1.0, 200.0, 100.0)
    got = run_track(spark, two)
    assert {i for _, i in got} == {1, 2} and len(got) == 16
    assert run_track(spark, random.Random(1).sample(two, len(two)), 3) != [] and {i for _, i in run_track(spark, two[::-1], 3)} == {1, 2}
    # One missed frame is bridged, two are not.
    assert {i for f, i in run_track(spark, moving([1, 2, 3, 4, 6, 7, 8, 9])) if f > 5} == {1}
    assert {i for f, i in run_track(spark, moving([1, 2, 3, 4, 7, 8, 9, 10, 11])) if f > 6} == {2}
    # A long gap gives the same result as stepping every empty frame.
    assert {i for f, i in run_track(spark, moving([1, 2, 3]) + moving([500, 501, 502, 503, 504])) if f > 400} == {2}


def test_interpolation(spark):
    df = spark.createDataFrame([(1, 10, 0.0, 0.0, 4.0, 4.0, 0.9), (1, 14, 8.0, 4.0, 12.0, 8.0, 0.5), (2, 3, 1.0, 1.0, 2.0, 2.0, 0.1)], "car_id long, frame long, x1 double, y1 double, x2 double, y2 double, text_score double")
    got = {(r["car_id"], r["frame"]): (r["x1"], r["imputed"]) for r in tracks.interpolate_tracks(df).collect()}
    assert got == {(1, 10): (0, False), (1, 11): (2, True), (1, 12): (4, True), (1, 13): (6, True), (1, 14): (8, False), (2, 3): (1, False)}


def test_nms_leaves_no_overlap(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(40):
        x, y = rnd.uniform(0, 20), rnd.uniform(0, 20)
        rows.append((i, i % 3, x, y, x + 10, y + 10, rnd.random()))
    df = spark.createDataFrame(rows, "det_id long, frame long, x1 double, y1 double, x2 double, y2 double, score double")
    kept = detections.nms(df, ["frame"]).select("frame", "det_id").join(df, ["frame", "det_id"])
    assert detections.iou_pairs(kept, ["frame"], 0.45).count() == 0
    assert kept.count() < 40


def test_assign_plates_takes_the_largest_track(spark):
    t = spark.createDataFrame([(1, 7, 0.0, 0.0, 9.0, 9.0), (1, 9, 0.0, 0.0, 8.0, 8.0)], "frame long, track_id long, x1 double, y1 double, x2 double, y2 double")
    q = spark.createDataFrame([(1, 1, 1.0, 1.0, 2.0, 2.0), (2, 1, 0.0, 1.0, 2.0, 2.0)], "plate_id long, frame long, x1 double, y1 double, x2 double, y2 double")
    assert {r["plate_id"]: r["track_id"] for r in detections.assign_plates(q, t, ["frame"]).collect()} == {1: 9, 2: -1}


def test_blocked_pairs_are_all_pairs(spark):
    rnd = random.Random(2)
    texts = ["AB1234", "A81234", "AB-1234", "CD1234", "XY91234", "0BI2", "OB12", "ZZ", "", "777"]
    rows = [(i, 1, rnd.choice(texts), rnd.uniform(0, 30)) for i in range(70)]
    df = spark.createDataFrame(rows, "read_id long, camera long, text string, t double")
    got = {(r["a"], r["b"]) for r in reads.dup_pairs(df, ["camera"], 0.75).collect()}
    from redlight.functions import plates as p

    x = df.selectExpr("read_id a", "text ta", "t da").crossJoin(df.selectExpr("read_id b", "text tb", "t db")).where("a < b and ta <> '' and tb <> ''")
    want = x.where(p.fused_similarity(p.dup_text_similarity("ta", "tb"), F.lit(0.0), p.time_similarity(F.col("da") - F.col("db"))) >= 0.75)
    assert got == {(r["a"], r["b"]) for r in want.collect()}


def test_golden_indicators(spark):
    inf = spark.createDataFrame([(f"P{i}", "01/05/2023", "10:00:00") for i in range(6)], "placa string, fecha string, hora string")
    monthly = spark.createDataFrame([("all", 508, 120, 65)], "month string, total int, dias int, reincidentes int")
    survey = spark.createDataFrame([(float(m),) for m in (7, 6, 5, 10, 8)], "minutes double")
    r = indicators.indicator_report(inf, monthly, survey).first()
    ti, tr, ir = (r["indicadores"][k] for k in ("TI", "TR", "IR"))
    assert ti["sin_software"]["valor"] == pytest.approx(4.2333, abs=1e-4) and ti["con_software"]["mejora"] == pytest.approx(41.73, abs=0.01)
    assert tr["sin_software"]["valor"] == pytest.approx(432) and tr["con_software"]["factor"] == pytest.approx(45.47, abs=0.01)
    assert ir["sin_software"]["valor"] == pytest.approx(12.795, abs=1e-3) and ir["con_software"]["valor"] == 0


def test_empty_indicators(spark):
    inf = spark.createDataFrame([], "placa string, fecha string, hora string")
    assert indicators.detection_rate(inf).first()[0] == 0 and indicators.repeat_rate(inf).first()[0] == 0


def test_nearest_by_products_is_the_exact_one():
    """as Ward distances give it, to the last bit, with ties, copies and large offsets."""
    import numpy as np

    from redlight.operators import identity

    rng = np.random.default_rng(3)
    for shift in (0.0, 1e6):
        c = np.concatenate([rng.normal(0, 1, (200, 16)), rng.integers(0, 2, (200, 16))]) + shift
        c[7], n = c[3], rng.integers(1, 4, 400).astype(float)
        d = identity._ward(c[:300], n[:300], c, n)
        d[np.arange(300), np.arange(300)] = np.inf
        best, near = identity.nearest_of(np.arange(300), c[:300], n[:300], np.arange(400), c, n)
        assert (best == d.argmin(1)).all() and (near == d.min(1)).all()


def test_vehicle_ids(spark):
    rows = [(i, [float(i % 2), 1.0], i / 10) for i in range(8)] + [(8, None, 9.0)]
    df = spark.createDataFrame(rows, "vec_id long, features array<double>, t double")
    got = {r["vec_id"]: r["vehicle_id"] for r in identity.vehicle_ids(df).collect()}
    assert got[0] == "V1" and got[1] == "V2" and got[8] == "V3" and got[6] == "V1"
    assert {r["vehicle_id"] for r in identity.vehicle_ids(df.where("vec_id in (1, 8)")).collect()} == {"V1", "V2"}


def test_images(spark):
    df = spark.createDataFrame([(1, 2, 2, 3, bytearray([0, 0, 0, 255, 255, 255] * 2), 50.0)], "image_id long, height int, width int, nChannels int, data binary, t double")
    r = images.image_stats(df).first()
    assert r["mean"] == pytest.approx(127.5) and r["std"] == pytest.approx(127.5)
    f = images.histogram_features(df).first()["features"]
    assert len(f) == 49 and f[0] == 1 and f[15] == 1 and f[48] == 0.5


def test_files(spark, tmp_path):
    (tmp_path / "log.json").write_text('[{"placa": "A", "fecha": "01/01/2023"}, {"placa": "B", "modo_nocturno": true}]')
    (tmp_path / "some.json").write_text('[{"hora": "10:00:00", "ubicacion": "X", "tipo": "T"}, {"placa": "B"}]')
    assert io.read_infractions(spark, str(tmp_path / "some.json")).count() == 2
    (tmp_path / "bad.json").write_text('[{"placa": ')
    assert io.read_infractions(spark, str(tmp_path / "log.json")).count() == 2
    assert io.read_infractions(spark, str(tmp_path / "bad.json")).count() == 0
    assert io.read_infractions(spark, str(tmp_path / "none.json")).count() == 0
    for n, t in (("avenue_config", '{"c1": "Av 1"}'), ("time_presets", '{"c1": {"green": 1, "yellow": 2, "red": 3}}'), ("polygon_config", '{"c1": [[0, 0], [4, 0], [4, 4]]}')):
        (tmp_path / f"{n}.json").write_text(t)
    c = io.read_camera_config(spark, str(tmp_path))
    assert c["avenue"].first()["avenue"] == "Av 1" and c["preset"].first()["red"] == 3 and c["polygon"].first()["poly"][1]["x"] == 4
    t = spark.createDataFrame([("s", 1, 5, 1.0, 2.0, 4.0, 6.0)], "seq string, frame long, track_id long, x1 double, y1 double, x2 double, y2 double")
    io.write_mot(t, str(tmp_path / "mot"))
    assert spark.read.text(str(tmp_path / "mot")).first()["value"] == "1,5,1.00,2.00,3.00,4.00,1,-1,-1,-1"
    box = F.struct(F.lit(1.0).alias("x1"), F.lit(2.0).alias("y1"), F.lit(3.0).alias("x2"), F.lit(4.0).alias("y2"))
    rows = spark.createDataFrame([(1, 2, 0.5, "AB", 0.9), (1, None, 0.5, "AB", 0.9)], "frame_nmr long, car_id long, license_plate_bbox_score double, license_number string, license_number_score double").withColumns({"car_bbox": box, "license_plate_bbox": box})
    io.write_plate_csv(rows, str(tmp_path / "plates"))
    back = io.read_plate_csv(spark, str(tmp_path / "plates")).collect()
    assert len(back) == 1 and back[0]["car_bbox"]["y2"] == 4.0
    inf = io.read_infractions(spark, str(tmp_path / "log.json"))
    for _ in range(2):  # a batch that is written again takes its own place
        io.append_infractions(inf, str(tmp_path / "store"), "monday")
    io.append_infractions(inf, str(tmp_path / "store"), "tuesday", ["placa"])
    assert io.read_stored(spark, str(tmp_path / "store")).count() == 2
    io.append_infractions(inf, str(tmp_path / "store"), "tuesday")
    assert io.read_stored(spark, str(tmp_path / "store")).groupBy("batch").count().count() == 2
    colours = spark.createDataFrame([("c.png", 2, 1, 3, bytearray([1, 2, 3, 250, 0, 9])), ("g.png", 1, 2, 1, bytearray([7, 8]))], "name string, height int, width int, nChannels int, data binary")
    io.write_pictures(colours, str(tmp_path / "pictures"))
    back = io.read_pictures(spark, str(tmp_path / "pictures"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, colours.collect()))
    io.export(inf, str(tmp_path / "csv"), "csv")
    assert "modo_nocturno" in spark.read.option("header", True).csv(str(tmp_path / "csv")).columns
    (tmp_path / "times.json").write_text('{"processing_times": [1.5, 2.5]}')
    assert io.read_processing_times(spark, str(tmp_path / "times.json")).count() == 2
    assert [r["name"] for r in io.list_media(spark, str(tmp_path), ["JSON"]).collect()][0] == "avenue_config.json"



def test_tracks_are_sent_once(spark):
    """rows of v_track went through one shuffle for frames and one more for cars."""
    from redlight.plans import registry

    plan = registry.QUERIES["w01_interpolate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_assign_takes_no_array_steps(monkeypatch):
    """a step of the assignment of a small frame cost more in arrays than in loops."""
    import numpy as np

    from redlight.operators import tracks

    cost = np.array([[-0.9, -0.8, 0.0], [-0.8, -0.1, 0.0], [0.0, -0.5, -0.4], [-0.3, -0.2, -0.1]])
    for name in ("where", "flatnonzero", "full"):
        monkeypatch.setattr(np, name, None)
    assert tracks.assign(cost) == [(0, 1), (1, 0), (2, 2)]
    assert tracks.assign(cost.T) == [(0, 1), (1, 0), (2, 2)]
