"""Cases worked out by hand, and operators against plain step-by-step versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from redlight.functions import geometry as g
from redlight.functions import plates as p
from redlight.operators import detections, identity, images, reads, tracks
from redlight.plans.views import view
from redlight.sources import io
from redlight.streaming import live

SF = "/root/testdata/sf0.001"


def strip(x, y):
    """An area that holds one point of a grid of whole numbers."""
    return [(x - 1, y), (x, y - 1), (x + 1, y), (x, y + 1)]


def test_points_of_the_live_modes(spark):
    box = (10, 20, 51, 63)  # 41 x 43, centre (30, 41)
    day = [(30, 41), ((10 + 153) // 4, 41), ((30 + 51) // 4, 41), (10, 20), (51, 20), (10, 63), (51, 63)]
    night = [(x, y) for x in (10 + 10, 30, 51 - 10) for y in (20 + 10, 41, 63 - 10, 63)]
    tried = [*day, *night, (30, 63), (24, 41), (37, 41), (20, 20), (30, 20)]
    rows = [(*map(float, box), x, y, [{"x": a, "y": b} for a, b in strip(x, y)]) for x, y in tried]
    df = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double, x int, y int, poly array<struct<x:int,y:int>>")
    for mode, points in (("live_day", day), ("live_night", night), ("day", [(30, 63)])):
        got = df.select("x", "y", g.in_area(g.box(), g.area_shape("poly", mode), mode).alias("in")).collect()
        assert [r["in"] for r in got] == [any(abs(r["x"] - a) + abs(r["y"] - b) <= 1 for a, b in points) for r in got], mode


def test_stored_quality_takes_the_noise(spark):
    df = spark.createDataFrame([(50.0, 40.0, 80.0, 100.0, 50.0, 100, 50, "AB-1234")], "mean double, std double, p10 double, sharpness double, noise double, width int, height int, text string")
    q = lambda **k: df.select(images.plate_quality("stored", p.image_format_score("text"), **k)).first()[0]
    assert q(noise=F.col("noise")) == pytest.approx(0.4 * 0.2 + 0.3 * 0.5 + 0.15 * 0.5 + 0.05 * 0.5 + 0.1 * 1.1)
    assert q(noise=F.lit(250.0)) == pytest.approx(q(noise=F.lit(50.0)) - 0.025) and q() == pytest.approx(q(noise=F.col("noise")))
    x = np.zeros((5, 5))
    x[2, 2] = 8.0
    assert images.sobel_std(x) == pytest.approx(np.sqrt(4 * 64 / 25))


def test_classes_are_those_of_all_pairs(spark):
    rnd = random.Random(9)
    texts = ["AB1234", "A81234", "AB-1234", "CD1234", "XY91234", "ZZ567234", "0BI2", "OB12", "ZZ", "", "777", "K55", "KSS", None]
    rows = [(i, rnd.randrange(3), rnd.choice(texts), rnd.choice([0.0, 1.0, 2.6, 4.0, 4.9, 5.0, 9.0, 30.0])) for i in range(60)]
    df = spark.createDataFrame(rows, "read_id long, camera long, text string, t double")
    pairs = reads.dup_pairs(df, ["camera"], 0.5)
    want = {tuple(r) for r in reads.dup_groups(pairs).collect()}
    assert {tuple(r) for r in reads.dup_classes(df, ["camera"]).collect()} == want and len(want) > 20
    assert reads.dup_classes(df.limit(0), ["camera"]).count() == 0
    with pytest.raises(ValueError):
        reads.dup_classes(df, ["camera"], 0.9)


def step_by_step(rows, **options):
    """All frames of every sequence, one after the other, also empty ones."""
    out = []
    for seq in sorted({r[0] for r in rows}):
        mine = sorted(r[1:] for r in rows if r[0] == seq)
        tracker = tracks.Tracker(**options)
        for f in range(1, max(r[0] for r in mine) + 1):
            out += [(seq, frame, i, *np.round(b, 6)) for frame, i, *b in tracker.step(np.array([r[2:] for r in mine if r[0] == f], float).reshape(-1, 4))]
    return sorted(out)


@pytest.mark.parametrize(("block", "options"), [(1 << 16, {}), (7, {}), (3, {"max_age": 3, "min_hits": 1})])
def test_tracks_are_those_of_every_frame(spark, monkeypatch, block, options):
    monkeypatch.setattr(tracks, "FRAME_BLOCK", block)
    rnd, rows = random.Random(block), []
    for seq in ("a", "b", "c"):
        frames, f = [], rnd.randrange(1, 3)
        while len(frames) < 40:
            frames.append(f)
            f += rnd.choice([1, 1, 1, 1, 2, 2, 3, 5, 9])
        for i in range(3):
            for f in frames[rnd.randrange(8) :]:
                if rnd.random() < 0.85:
                    x, y = 20 * i + 3 * f + rnd.random(), 40 * i + rnd.random()
                    rows.append((seq, f, len(rows), x, y, x + 30, y + 20))
    df = spark.createDataFrame(rows, "seq string, frame long, det_id long, x1 double, y1 double, x2 double, y2 double").repartition(5)
    got = sorted((r["seq"], r["frame"], r["track_id"], *(round(r[c], 6) for c in tracks.BOX)) for r in tracks.track(df, "seq", **options).collect())
    want = step_by_step(rows, **options)
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3:] for r in got], [r[3:] for r in want], atol=1e-5)


@pytest.mark.parametrize(("parked", "look", "rounds"), [(0, 8, 4), (0, 2, 1), (1, 8, 2)])
def test_long_sequences_are_stepped_in_stretches(spark, monkeypatch, parked, look, rounds):
    """A sequence without a gap is more than one task's work, with the tracks of every frame; so
    it is where stretches do not agree in time, or never, as a parked car's track lives on."""
    for name, value in (("STRETCH", 16), ("LOOK", look), ("ROUNDS", rounds)):
        monkeypatch.setattr(tracks, name, value)
    rnd, rows = random.Random(7), []
    for seq in ("a", "b", None):
        for f in range(1, 200):
            for i in range(4):
                if rnd.random() < 0.6:
                    x, y = rnd.choice([0, 15, 200]) + 20 * rnd.random(), 40 * i
                    rows.append((seq, f, len(rows), x, y, x + 30, y + 20))
            if parked and 60 <= f < (130 if seq == "a" else 200):
                rows.append((seq, f, len(rows), 900, 900, 930, 920))
    df = spark.createDataFrame([(*r[:3], *map(float, r[3:])) for r in rows], "seq string, frame long, det_id long, x1 double, y1 double, x2 double, y2 double").repartition(5)
    made = tracks._stepped(df, "seq", 1, 3, 0.3, "det_id")
    got = sorted((r["seq"] or "", r["frame"], r["track_id"], *(round(r[c], 6) for c in tracks.BOX)) for r in tracks._numbered_on(made, "seq").collect())
    want = step_by_step([(r[0] or "", *r[1:]) for r in rows])
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3:] for r in got], [r[3:] for r in want], atol=1e-5)
    pieces = [r["n"] for r in made.where("frame is null and not _open").groupBy("seq").agg(F.count("*").alias("n")).collect()]
    assert len(pieces) == 3 and (rounds == 1 or min(pieces) > 2)


def test_tracker_first_steps():
    """One box that moves by two: the filter's first steps, from its equations."""
    t = tracks.Tracker(min_hits=1)
    assert t.step(np.array([[0.0, 0, 10, 10]])) == [(1, 1, 0.0, 0.0, 10.0, 10.0)]
    (out,) = t.step(np.array([[2.0, 0, 12, 10]]))
    # Predicted variance of the centre: 10 + 10000 + 1; gain 10011 / 10012.
    assert out[:2] == (2, 1) and (out[2] + out[4]) / 2 == pytest.approx(5 + 2 * 10011 / 10012)


def test_null_sequences_are_tracked(spark):
    rows = [(None, f, f, 2.0 * f, 0.0, 2.0 * f + 30, 20.0) for f in range(1, 6)]
    df = spark.createDataFrame(rows, "seq string, frame long, det_id long, x1 double, y1 double, x2 double, y2 double")
    assert [(r["seq"], r["track_id"]) for r in tracks.track(df).collect()] == [(None, 1)] * 5
    assert tracks.track(df.limit(0)).count() == 0


def ward(points):
    """Heights and members by the definition: the growth of the sums of squares."""
    groups, merges = [[i] for i in range(len(points))], []
    spread = lambda m: ((points[m] - points[m].mean(0)) ** 2).sum()
    while len(groups) > 1:
        h, i, j = min((2 * (spread(a + b) - spread(a) - spread(b)), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        merges.append((np.sqrt(max(h, 0)), groups[i] + groups[j]))
        groups = [m for k, m in enumerate(groups) if k not in (i, j)] + [groups[i] + groups[j]]
    return merges


@pytest.mark.parametrize("seed", range(6))
def test_ward_cut_is_the_definition(seed):
    rng = np.random.default_rng(seed)
    points = np.concatenate([rng.normal(c, 0.3, (5, 3)) for c in (0, 2, 7)])
    merges = ward(points)
    label = np.arange(len(points))
    for h, members in merges:
        if h <= 0.7 * merges[-1][0]:
            label[members] = min(label[members])
    got = identity.ward_cut(points, np.ones(len(points)))
    assert len(set(zip(got, label))) == len(set(got)) == len(set(label))
    # A weighted centre stands for its points.
    means = np.stack([points[i : i + 5].mean(0) for i in (0, 5, 10)])
    assert list(identity.ward_cut(means, np.full(3, 5.0))) == [0, 0, 1]


@pytest.mark.parametrize(("n", "few", "block", "parts"), [(50, 8, 7, 3), (50, 2048, 4096, 1), (500, 40, 64, 5), (2000, 500, 300, 8)])
def test_vehicle_ids_are_the_cut_at_every_size(spark, monkeypatch, n, few, block, parts):
    """The same ids as the definition's, however many rows and partitions, wherever merged."""
    monkeypatch.setattr(identity, "BLOCK", block)
    rng = np.random.default_rng(n)
    points = np.concatenate([rng.normal(rng.uniform(-9, 9, 4), 0.8, (n // 10, 4)) for _ in range(10)])
    points[n // 3] = points[n // 3 + 1] = points[2]
    z = (points - points.mean(0)) / points.std(0)
    label = identity.ward_cut(z, np.ones(n))
    if n == 50:
        merges, want = ward(z), np.arange(n)
        for h, members in merges:
            if h <= 0.7 * merges[-1][0]:
                want[members] = min(want[members])
        assert len(set(zip(label, want))) == len(set(label)) == len(set(want))
    first = {}
    want = [f"V{first.setdefault(x, len(first) + 1)}" for x in label]
    rows = [(i, p.tolist(), float(i)) for i, p in enumerate(points)] + [(n + i, None, 0.0) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, features array<double>, t double").repartition(parts)
    got = {r["vec_id"]: r["vehicle_id"] for r in identity.vehicle_ids(df, few=few).collect()}
    assert [got[i] for i in range(n)] == want
    assert sorted(got[n + i] for i in range(3)) == sorted(f"V{len(first) + 1 + i}" for i in range(3))


def test_blocks_are_not_broadcast(spark, monkeypatch):
    """one row for each pair of blocks, with the centres of a block, went through the driver."""
    monkeypatch.setattr(identity, "BLOCK", 50)
    rng = np.random.default_rng(3)
    c, n = rng.normal(size=(320, 4)), rng.integers(1, 4, 320).astype(float)
    clusters = spark.createDataFrame([(i, float(n[i]), c[i].tolist()) for i in range(320)], "cid long, n double, c array<double>")
    found = identity._nearest(clusters.where("cid < 130"), clusters)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan
    d = identity._ward(c[:130], n[:130], c, n)
    d[np.arange(130), np.arange(130)] = np.inf
    assert sorted(map(tuple, found.collect())) == [(i, int(d[i].argmin()), float(d[i].min())) for i in range(130)]


def test_equal_points_need_no_rounds(spark):
    rows = [(i, [float(i % 2), 1.0], float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, features array<double>, t double")
    got = {r["vec_id"]: r["vehicle_id"] for r in identity.vehicle_ids(df, few=1).collect()}
    assert all(got[i] == f"V{i % 2 + 1}" for i in range(400))


def test_variants_from_a_table(spark):
    table = spark.createDataFrame([(0, "AB1234", "AB1234"), (0, "AB1234", "A81234"), (1, "XY9", "XY9")], "rank int, canonical string, variant string")
    df = spark.createDataFrame([("AB1299",), ("A8123",), ("XY",), ("QQQQQQ",), ("",), (None,), ("AB1234",), ("AB1234",)], "text string")
    got = [tuple(r) for r in reads.canonicalise_fuzzy(df, table).collect()]
    # Four of six and equal length: 0.77. Four of five (A8123 with A81234): all of them. XY: both.
    want = {"AB1299": "AB1234", "A8123": "AB1234", "XY": "XY9", "QQQQQQ": "QQQQQQ", "": "", None: None, "AB1234": "AB1234"}
    assert len(got) == 8 and all(want[t] == c for t, c in got)


def test_registered_functions_are_the_columns(spark):
    names = p.register(spark, "rl_")
    assert len(names) > 15
    reads_ = view(spark, SF, "v_reads").limit(200)
    one = [f for f in p.SQL_FUNCTIONS[1]]
    got = reads_.selectExpr(*(f"rl_{f.__name__}(text) as {f.__name__}" for f in one)).collect()
    want = reads_.select(*(f(F.col("text")).alias(f.__name__) for f in one)).collect()
    assert got == want
    assert spark.sql("select rl_pattern_similarity('LL', 'LN')").first()[0] == 0.5


def test_missing_files_are_empty(spark, tmp_path):
    at = str(tmp_path / "none")
    assert io.read_mot(spark, at).count() == 0 and io.list_media(spark, at, ["png"]).count() == 0
    assert io.read_plate_csv(spark, at).count() == 0 and io.read_processing_times(spark, at).count() == 0


def test_late_rows_are_what_the_stream_drops(spark, tmp_path):
    at, days = str(tmp_path / "in"), lambda d, h=1: f"2024-01-{d:02d} {h:02d}:00:00"
    batches = [[days(1), days(2)], [days(5), days(1, 2)], [days(1, 3), days(3), days(6)], [days(2, 4), days(4, 5), days(5, 6), days(9)], [days(12)]]
    rows = [(i, t) for i, b in enumerate(batches) for t in b]
    df = spark.createDataFrame(rows, "batch int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(len(batches)):
        df.where(F.col("batch") == i).coalesce(1).write.mode("append").parquet(at)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(at)
    q = live.daily_counts(stream).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    told = {r["day"]: r["n"] for r in spark.table("late").collect()}
    late = live.late_rows(df, "batch")
    kept = {r["day"]: r["n"] for r in live.daily_counts(df.exceptAll(late)).collect()}
    assert late.count() > 0 and told and all(kept[d] == n for d, n in told.items())


def test_panel(spark):
    rows = [("a", 2.0), ("a", -1.0), ("b", 0.001), ("c", None)]
    df = spark.createDataFrame([(k, t, "2024-01-01 00:00:00") for k, t in rows], "plate string, processing_time double, ts string")
    r = live.panel(live.running_indicators(df)).first()
    assert (r["ti"], round(r["tr"], 6), round(r["ir"], 4)) == (3, round(2.01 / 2, 6), 33.3333)
    assert tuple(live.panel(live.running_indicators(df.limit(0))).first()) == (0, 0.0, 0.0)


def test_areas_need_a_polygon(spark):
    det = view(spark, SF, "v_det")
    areas = view(spark, SF, "v_area").where("camera = 0").withColumn("poly", F.slice("poly", 1, 2))
    assert detections.with_area(det, areas, "day").where("inside").count() == 0
