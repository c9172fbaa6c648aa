import datetime

import pytest
from pyspark.sql import functions as F

from redlight.plans import registry
from redlight.plans.views import view
from redlight.streaming import live

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("events") / "in")
    spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.col("user_id").alias("plate"), F.col("ts").cast("timestamp").alias("ts")).write.parquet(at)
    return at


def run(spark, df, mode="append"):
    name = f"out_{id(df)}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def stream(spark, at):
    return spark.readStream.schema(spark.read.parquet(at).schema).parquet(at)


def test_daily_counts_are_the_batch(spark, folder):
    got = {r["day"]: r["n"] for r in run(spark, live.daily_counts(stream(spark, folder))).collect()}
    want = {r["day"]: r["n"] for r in live.daily_counts(spark.read.parquet(folder)).collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(want) - len(got) <= 2


def test_first_sightings_and_running_counts(spark, folder):
    batch = spark.read.parquet(folder)
    plates = batch.select("plate").distinct().count()
    assert run(spark, live.first_sightings(stream(spark, folder), late="100 days")).count() == plates
    got = run(spark, live.running_indicators(stream(spark, folder)), "complete")
    assert got.count() == plates and got.agg(F.sum("n")).first()[0] == batch.count()


def test_sessions(spark, folder):
    got = run(spark, live.near_time_groups(stream(spark, folder)))
    want = {(r["plate"], r["start"], r["n"]) for r in live.near_time_groups(spark.read.parquet(folder)).collect()}
    assert {(r["plate"], r["start"], r["n"]) for r in got.collect()} <= want


def test_infractions_and_tracks_are_the_batch(spark, tmp_path):
    det, presets, areas = (view(spark, SF, v) for v in ("v_det", "v_preset", "v_area"))
    det = det.withColumn("frame", F.col("frame") + 1)
    at = str(tmp_path / "det")
    det.coalesce(1).write.parquet(at)
    got = run(spark, live.live_infractions(stream(spark, at), presets, areas)).select("det_id").collect()
    assert sorted(got) == sorted(live.live_infractions(det, presets, areas).select("det_id").collect())


def test_online_tracker_out_of_order_is_the_batch(spark):
    """The query's frames come in three batches, out of order within its slack."""
    online, batch = (sorted(map(tuple, registry.QUERIES[q](spark, SF).collect())) for q in ("r6_online_tracker", "t1_track"))
    assert online == batch


def boxes(camera, frames):
    return [(camera, f, 10 * f, 2.0 * f, 0.0, 2.0 * f + 30, 20.0) for f in frames]


def test_idle_cameras_leave_no_state_and_late_frames_are_told(spark, tmp_path):
    schema = "camera long, frame long, det_id long, x1 double, y1 double, x2 double, y2 double"
    at = str(tmp_path / "in")
    batches = [boxes(1, range(1, 6)), boxes(2, [1, 2]), boxes(2, [3]) + boxes(1, [100, 101, 102, 103]), boxes(2, [2, 4]) + boxes(1, [50])]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)
    live.use_state_store(spark)
    dets = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)
    with live.only_with_rows(spark):
        got = run(spark, live.online_tracker(dets, slack=0, idle=1)).collect()
    rows = {(r["camera"], r["session"], r["frame"], r["track_id"], r["late"]) for r in got}
    # Camera 1 was idle for a batch: what it brings then is a session of its own.
    assert {(1, 1, f, 1, False) for f in range(1, 6)} <= rows
    assert {r[1] for r in rows if r[0] == 1 and not r[4] and r[2] >= 100} == {100}
    assert all(r[3] == 1 for r in rows if r[0] == 1 and not r[4])
    assert sum(r[4] for r in rows) + sum(not r[4] for r in rows) == len(rows)


def test_late_frames_are_not_lost(spark, tmp_path):
    schema = "camera long, frame long, det_id long, x1 double, y1 double, x2 double, y2 double"
    at = str(tmp_path / "in")
    for rows in (boxes(1, [1, 2, 4, 5]), boxes(1, [3, 6])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)
    live.use_state_store(spark)
    dets = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)
    with live.only_with_rows(spark):
        none = run(spark, live.online_tracker(dets)).collect()
    assert {(r["frame"], r["x1"]) for r in none if r["late"]} == {(3, 6.0)}
    with live.only_with_rows(spark):
        some = run(spark, live.online_tracker(dets, slack=2)).collect()
    assert not any(r["late"] for r in some) and {r["frame"] for r in some} == {1, 2, 3, 4}


def test_late_rows_split_off_are_those_the_window_drops(spark, tmp_path):
    days = lambda *d: [(i, datetime.datetime(2024, 1, x, 12)) for i, x in enumerate(d)]
    at, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in (days(1, 2), days(9, 9), days(10), days(2, 3, 10, 9)):
        spark.createDataFrame(rows, "event_id long, ts timestamp").coalesce(1).write.mode("append").parquet(at)
    files = lambda: spark.readStream.schema("event_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(at)
    live.split_late(files(), out, f"{out}-log").trigger(availableNow=True).start().awaitTermination()
    late, kept = spark.read.parquet(f"{out}/late"), spark.read.parquet(f"{out}/kept")
    assert sorted(r["ts"].day for r in late.collect()) == [2, 3] and kept.count() == 7
    told = run(spark, live.daily_counts(files()), "update").groupBy("day").agg(F.max("n").alias("n"))
    want = live.daily_counts(kept.select("ts"))
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, want.collect()))
    # A batch that is run again takes its own place.
    assert spark.read.parquet(f"{out}/marks").count() == 4


def test_panel_costs_follow_the_batch(spark, tmp_path):
    at, out = str(tmp_path / "in"), str(tmp_path / "out")
    seen = [[("a", 2.0), ("b", -1.0), (None, 0.001)], [("a", 3.0), ("a", 1.0)], [("b", 0.0)]]
    for rows in seen:
        spark.createDataFrame(rows, "plate string, processing_time double").coalesce(1).write.mode("append").parquet(at)
    live.use_state_store(spark)
    rows = spark.readStream.schema("plate string, processing_time double").option("maxFilesPerTrigger", 1).parquet(at)
    live.write_panel(rows, out, f"{out}-log").trigger(availableNow=True).start().awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(f"{out}/*").where("batch < 3").orderBy("batch").select("plates", "back", F.round("tr", 4), F.round("ir", 2)).collect()]
    assert got == [(3, 0, 1.005, 0.0), (3, 1, 1.5025, 33.33), (3, 2, 1.5025, 66.67)]


def test_append(spark, folder, tmp_path):
    q = live.append_infractions(stream(spark, folder), str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(folder).count()


def test_frames_of_a_batch_are_no_tables_of_their_own(monkeypatch):
    """F8, F10: a batch was grouped into a table for every frame."""
    import pandas as pd

    kept = {}
    state = type("S", (), {"exists": lambda s: False, "update": lambda s, v: None})()
    waiting = type("W", (dict,), {"containsKey": dict.__contains__, "getValue": dict.__getitem__, "updateValue": dict.__setitem__, "removeKey": dict.__delitem__})(kept)
    handle = type("H", (), {"getValueState": lambda s, *a: state, "getMapState": lambda s, *a: waiting, "listTimers": lambda s: [], "registerTimer": lambda s, t: None})()
    timer = type("T", (), {"getCurrentProcessingTimeInMs": lambda s: 0})()
    rows = pd.DataFrame([(3, 2, 7, 0.0, 0.0, 9.0, 9.0), (3, 1, 5, 0.0, 0.0, 9.0, 9.0), (3, 2, None, None, None, None, None), (3, 9, 8, 0.0, 0.0, 9.0, 9.0)], columns=["camera", "frame", "det_id", "x1", "y1", "x2", "y2"])
    tracker = live.FrameTracker("camera", 1, 3, 0.3, 5, 1000)
    tracker.init(handle)
    monkeypatch.setattr(pd.DataFrame, "groupby", None)
    told = pd.concat(tracker.handleInputRows((3,), iter([rows]), timer))
    assert told[["frame", "track_id", "late"]].values.tolist() == [[1, 1, False], [2, 1, False]]
    assert list(waiting) == [(9,)]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100])
def test_thirds_are_those_of_one_window(spark, n):
    """the rows were ranked in one task."""
    from pyspark.sql import Window

    rows = spark.range(n).select(((F.col("id") * 37) % 101).alias("ts"), "id")
    want = rows.withColumn("third", F.ntile(3).over(Window.orderBy("ts", "id")) - 1)
    assert sorted(map(tuple, registry._thirds(rows, ["ts", "id"]).select("id", "third").collect())) == sorted(map(tuple, want.select("id", "third").collect()))
