"""Filters, joins and rankings of detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

#: Least confidence (night, day) by kind.
CONFIDENCE = {"vehicle": (0.25, 0.40), "plate": (0.30, 0.50), "plate_retry": (0.25, 0.25), "default": (0.35, 0.35)}


def vehicles(df: DataFrame, classes=(2, 5, 7)) -> DataFrame:
    return df.where(F.col("class_id").isin(*classes))


def confident(df: DataFrame, kind: str = "vehicle", night: Column | bool = False) -> DataFrame:
    dark, light = CONFIDENCE[kind]
    night = night if isinstance(night, Column) else F.lit(night)
    return df.where(F.col("score") >= F.when(night, dark).otherwise(light))


def sample_step(fps: float, night: bool = False) -> int:
    return max(1, int(fps / (5 if night else 3)))


def sample_frames(df: DataFrame, fps: float, night: bool = False, start: str | Column = "red_start") -> DataFrame:
    """Every n-th frame of a red segment."""
    start = F.col(start) if isinstance(start, str) else start
    return df.where((F.col("frame") - start) % sample_step(fps, night) == 0)


def direct_read_frames(df: DataFrame, every: int = 10, start: str = "red_start") -> DataFrame:
    return df.where((F.col("frame") - F.col(start) + 1) % every == 0)


def with_phase(df: DataFrame, presets: DataFrame, fps: float = 1.0) -> DataFrame:
    """Signal phase of every row by modular arithmetic; cameras without preset are dropped."""
    p = presets.select(F.col("camera"), *((F.col(c) * fps).cast("long").alias(f"_{c}") for c in ("green", "yellow", "red")))
    out = df.join(p, "camera")
    return out.withColumns(g.phase("frame", "_green", "_yellow", "_red")).drop("_green", "_yellow", "_red")


def with_area(df: DataFrame, areas: DataFrame, mode: str) -> DataFrame:
    """Rows of cameras that have an area, with ``inside``. Edges and bounds are made once per
    camera, before the join."""
    shapes = areas.select("camera", g.area_shape("poly", mode).alias("_shape"))
    return df.join(shapes, "camera").withColumn("inside", g.in_area(g.box(), F.col("_shape"), mode)).drop("_shape")


def infractions(det: DataFrame, presets: DataFrame, areas: DataFrame, fps: float = 1.0, night: bool = False) -> DataFrame:
    """Vehicles in the restricted area while the signal is red."""
    red = with_phase(confident(vehicles(det), "vehicle", night), presets, fps).where("state = 'red'")
    return with_area(red, areas, "night" if night else "day").where("inside").drop("inside")


def assign_plates(plates: DataFrame, tracks: DataFrame, keys=("camera", "frame")) -> DataFrame:
    """Every plate with the vehicle that strictly contains it, the largest track id of
    several; -1 where there is none. ``plates`` has ``plate_id`` and a box, ``tracks``
    ``track_id`` and a box."""
    t = tracks.select(*keys, "track_id", *(F.col(c).alias(f"v{c}") for c in ("x1", "y1", "x2", "y2")))
    inside = plates.join(t, list(keys)).where("x1 > vx1 and y1 > vy1 and x2 < vx2 and y2 < vy2")
    best = inside.groupBy("plate_id").agg(F.max("track_id").alias("track_id"))
    return plates.join(best, "plate_id", "left").withColumn("track_id", F.coalesce("track_id", F.lit(-1)))


def iou_pairs(df: DataFrame, keys: list[str], least: float = 0.0, id_col: str = "det_id") -> DataFrame:
    """Pairs ``a, b`` (a < b) of one group whose overlap is above ``least``."""
    names = ("x1", "y1", "x2", "y2")
    left = df.select(*keys, F.col(id_col).alias("a"), *(F.col(c).alias(f"a{c}") for c in names))
    right = df.select(*keys, F.col(id_col).alias("b"), *(F.col(c).alias(f"b{c}") for c in names))
    near = (F.col("a") < F.col("b")) & (F.col("ax1") < F.col("bx2")) & (F.col("bx1") < F.col("ax2")) & (F.col("ay1") < F.col("by2")) & (F.col("by1") < F.col("ay2"))
    return left.join(right, keys).where(near).withColumn("iou", g.iou(g.box("a"), g.box("b"))).where(F.col("iou") > least).select(*keys, "a", "b", "iou")


def nms(df: DataFrame, keys: list[str], threshold: float = 0.45, id_col: str = "det_id") -> DataFrame:
    """Greedy suppression: highest score first (ties: smaller id), drop what overlaps a kept
    box by more than ``threshold``. Groups are the detections of one frame."""
    item = F.struct((-F.col("score")).alias("s"), F.col(id_col).alias("id"), "x1", "y1", "x2", "y2")
    box = lambda r: tuple(r[c] for c in ("x1", "y1", "x2", "y2"))
    grouped = df.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("all"))
    none = F.filter("all", lambda x: F.lit(False))
    kept = F.aggregate("all", none, lambda acc, x: F.when(F.exists(acc, lambda k: g.iou(box(k), box(x)) > threshold), acc).otherwise(F.array_append(acc, x)))
    return grouped.select(*keys, F.explode(kept).alias("k")).select(*keys, F.col("k.id").alias(id_col), (-F.col("k.s")).alias("score"))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def plate_region(df: DataFrame, keys: list[str], night: bool = False, frame_h: float = 300.0) -> DataFrame:
    """Largest candidate box in the lower part, by area and shape; one row per group."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    area, ratio = w * h, w / F.nullif(h, F.lit(0.0))
    lo, hi, least = (1.5, 7.0, 200) if night else (2.0, 6.0, 300)
    fit = df.where((area >= least) & ratio.between(lo, hi) & (F.col("y2") >= frame_h * 0.4))
    return fit.groupBy(*keys).agg(F.max_by(F.struct("det_id", "x1", "y1", "x2", "y2"), F.struct(area, -F.col("det_id"))).alias("r")).select(*keys, "r.*")


def boxes_or_default(vehicles_: DataFrame, detected: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """Detector box, else region box, else the lower middle (20-80 %, 65-95 %)."""
    box = lambda df, p: df.select(key, F.struct("x1", "y1", "x2", "y2").alias(p))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    default = F.struct((F.col("x1") + w * 0.2).alias("x1"), (F.col("y1") + h * 0.65).alias("y1"), (F.col("x1") + w * 0.8).alias("x2"), (F.col("y1") + h * 0.95).alias("y2"))
    out = vehicles_.withColumn("_default", default).drop("x1", "y1", "x2", "y2").join(box(detected, "_d"), key, "left").join(box(regions, "_r"), key, "left")
    source = F.when(F.col("_d").isNotNull(), "detector").when(F.col("_r").isNotNull(), "region").otherwise("default")
    return out.withColumn("source", source).withColumn("_b", F.coalesce("_d", "_r", "_default")).select("*", "_b.*").drop("_d", "_r", "_default", "_b")


def last_per_car_frame(plates: DataFrame, keys: list[str]) -> DataFrame:
    """Of several plates of one vehicle and frame the last in input order."""
    return top_k(plates, keys, [F.desc("plate_id")], 1).drop("rank")


def reuse_previous(df: DataFrame, keys: list[str], signature: str, value: str) -> DataFrame:
    """Rows whose signature equals that of the row before take the value of the first of the run."""
    w = Window.partitionBy(*keys).orderBy("frame", "det_id")
    new = F.coalesce(F.lag(signature).over(w) != F.col(signature), F.lit(True)).cast("int")
    runs = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w))
    first = F.first(value).over(Window.partitionBy(*keys, "run").orderBy("frame", "det_id"))
    return runs.withColumn("reused", first).drop("_new")


def unmatched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on, "left_anti")
