import random

import pytest
from pyspark.sql import functions as F

from redlight.functions import geometry as g

SQUARE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]


def poly_df(spark, rows):
    return spark.createDataFrame([(float(x), float(y), [{"x": a, "y": b} for a, b in p]) for x, y, p in rows], "px double, py double, poly array<struct<x:double,y:double>>")


@pytest.mark.parametrize(("x", "y", "poly", "want"), [(5, 5, SQUARE, True), (10, 5, SQUARE, True), (0, 0, SQUARE, True), (11, 5, SQUARE, False), (5, 5, SQUARE[:2], False), (5, 5, [], False)])
def test_point_in_polygon(spark, x, y, poly, want):
    assert poly_df(spark, [(x, y, poly)]).select(g.point_in_polygon("px", "py", "poly")).first()[0] is want


def test_iou(spark):
    rnd = random.Random(0)
    rows = []
    for _ in range(60):
        a, b = rnd.uniform(0, 9), rnd.uniform(0, 9)
        c, d = rnd.uniform(0, 9), rnd.uniform(0, 9)
        rows.append((a, b, a + 3, b + 2, c, d, c + 2, d + 4))
    rows.append((0.0,) * 8)
    df = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double, bx1 double, by1 double, bx2 double, by2 double")
    for r, s in df.select(g.iou(g.box(), g.box("b")), g.iou(g.box("b"), g.box())).collect():
        assert 0 <= r <= 1 and r == pytest.approx(s)
    assert df.where("x1 = 0 and x2 = 0").select(g.iou(g.box(), g.box("b"))).first()[0] == 0


def test_phase_is_the_simulated_cycle(spark):
    rnd = random.Random(1)
    rows, want = [], []
    for _ in range(200):
        gr, ye, re, f = rnd.randrange(0, 9), rnd.randrange(0, 3), rnd.randrange(0, 9), rnd.randrange(0, 90)
        rows.append((f, gr, ye, re))
        cycle = ["green"] * gr + ["yellow"] * ye + ["red"] * re
        want.append(cycle[f % len(cycle)] if cycle else None)
    df = spark.createDataFrame(rows, "f long, g long, y long, r long")
    assert [x[0] for x in df.select(g.phase("f", "g", "y", "r")["state"]).collect()] == want


def test_boxes_there_and_back(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0, 4.0)], "x1 double, y1 double, x2 double, y2 double").select(*(v.alias(k) for k, v in g.box_to_z(g.box()).items()))
    assert [round(v, 9) for v in df.select(*g.z_to_box("cx", "cy", "area", "ratio").values()).first()] == [1, 2, 5, 4]


def test_clock(spark):
    df = spark.createDataFrame([(75.5,), (None,)], "t double")
    assert [tuple(r) for r in df.select(g.clock("t"), g.clock("t", True)).collect()] == [("01:15", "01:15.500"), (None, None)]
    assert df.select(F.lit(1)).count() == 2
