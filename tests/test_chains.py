"""Whole analyses on small tables that can be followed by hand."""

import datetime

from pyspark.sql import functions as F

from redlight.operators import tracks
from redlight.plans import chains


def test_plate_pipeline(spark):
    """Two cars and a third without a plate; reads at some frames only, the rest filled in."""
    car = lambda c, f: (10 * f + c, 1, f, 100.0 * c + 2 * f, 50.0 * c, 100.0 * c + 2 * f + 60, 50.0 * c + 40)
    vehicles = spark.createDataFrame([car(c, f) for f in range(1, 12) for c in (1, 2, 3)], "det_id long, camera long, frame long, x1 double, y1 double, x2 double, y2 double")
    reads = {1: {2: ("AB1234", 0.4), 5: ("A81234", 0.9), 9: ("AB1234", 0.7)}, 2: {4: ("XY99", 0.5)}}
    plates = [(100 * c + f, 1, f, 100.0 * c + 2 * f + 20, 50.0 * c + 15, 100.0 * c + 2 * f + 30, 50.0 * c + 25, *r) for c, got in reads.items() for f, r in got.items()]
    plates = spark.createDataFrame(plates, "plate_id long, camera long, frame long, x1 double, y1 double, x2 double, y2 double, text string, text_score double")
    out = chains.plate_pipeline(vehicles, plates)
    told = {(r["track_id"], r["frame"]): (r["imputed"], r["best_text"], r["best_frame"]) for r in out.collect()}
    ids = {round(r["y1"] / 50): r["track_id"] for r in tracks.track(vehicles, "camera").where("frame = 5").collect()}
    assert told == {(ids[1], f): (f not in reads[1], "A81234", 5) for f in range(2, 10)} | {(ids[2], 4): (False, "XY99", 4)}
    line = {r["frame"]: r["x1"] for r in out.where(F.col("track_id") == ids[1]).collect()}
    assert abs(line[7] - (line[5] + line[9]) / 2) < 1e-9


def test_offline_analysis(spark):
    at = datetime.datetime(2024, 5, 1, 8, 30)
    rows = [(1, "AB-1234", 0.9, 1.0), (2, "A8-1234", 0.5, 2.0), (3, "AB-1234", 0.6, 30.0), (4, "ZZ-9999", 0.8, 61.0), (5, "QX-777", 0.8, 62.0)]
    found = spark.createDataFrame([(*r, "run", at, "Av. 1", None) for r in rows], "read_id long, text string, conf double, t double, run string, event_ts timestamp, ubicacion string, franja_horaria string")
    ids = spark.createDataFrame([(1, "V1"), (2, "V2"), (4, "V3"), (5, "V3")], "read_id long, vehicle_id string")
    out = chains.offline_analysis(found, ids, ["run"]).collect()
    # V1, V2 and read 3 carry one plate; V3 keeps its better read.
    assert sorted(r["placa"] for r in out) in (["AB-1234", "QX-777"], ["AB-1234", "ZZ-9999"])
    assert {(r["fecha"], r["ubicacion"], r["franja_horaria"]) for r in out} == {("01/05/2024", "Av. 1", "No especificada")}
