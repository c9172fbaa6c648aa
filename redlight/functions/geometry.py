"""Boxes, polygons and video time as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{n}") for n in ("x1", "y1", "x2", "y2"))


def iou(a: Box, b: Box, guarded: bool = True) -> Column:
    """Intersection over union; ``guarded``: 0 where the union is not positive."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    inter = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.when(union <= 0, 0.0).otherwise(F.try_divide(inter, union)) if guarded else F.try_divide(inter, union)


def polygon_edges(poly) -> Column:
    """``edges, n, x0, y0, x1, y1`` of an array of structs ``x, y``: every vertex with the next
    one, the number of vertices, and the bounds."""
    poly = _c(poly)
    n = F.size(poly)
    after = F.concat(F.slice(poly, 2, F.greatest(n - 1, F.lit(0))), F.slice(poly, 1, F.least(n, F.lit(1))))
    edges = F.zip_with(poly, after, lambda a, b: F.struct(a["x"].cast("double").alias("ax"), a["y"].cast("double").alias("ay"), b["x"].cast("double").alias("bx"), b["y"].cast("double").alias("by")))
    end = lambda f, k: f(F.transform(poly, lambda p: p[k].cast("double")))
    return F.struct(edges.alias("edges"), n.alias("n"), end(F.array_min, "x").alias("x0"), end(F.array_min, "y").alias("y0"), end(F.array_max, "x").alias("x1"), end(F.array_max, "y").alias("y1"))


def point_in_edges(px, py, shape) -> Column:
    """Crossing parity, edges count as inside; fewer than three vertices: false. Points out of
    bounds are told without a look at the edges. ``shape`` is from :func:`polygon_edges`."""
    px, py, shape = _c(px).cast("double"), _c(py).cast("double"), _c(shape)

    def on(e):
        cross = (e["bx"] - e["ax"]) * (py - e["ay"]) - (e["by"] - e["ay"]) * (px - e["ax"])
        return (cross == 0) & px.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & py.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))

    def crossed(e):
        at = (e["bx"] - e["ax"]) * (py - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"]
        return ((e["ay"] > py) != (e["by"] > py)) & (px < at)

    near = (shape["n"] >= 3) & px.between(shape["x0"], shape["x1"]) & py.between(shape["y0"], shape["y1"])
    odd = F.size(F.filter(shape["edges"], lambda e: F.coalesce(crossed(e), F.lit(False)))) % 2 == 1
    return F.coalesce(near & (F.exists(shape["edges"], on) | odd), F.lit(False))


def point_in_polygon(px, py, poly) -> Column:
    """:func:`point_in_edges` for an array of structs ``x, y``."""
    return point_in_edges(px, py, polygon_edges(poly))


def scaled_polygon(poly, factor: float = 1.1) -> Column:
    """Scaled about the truncated mean of the vertices; vertices truncated to integers."""
    poly = _c(poly)
    mean = lambda k: F.try_divide(F.aggregate(poly, F.lit(0.0), lambda s, p: s + p[k]), F.size(poly)).cast("long")
    cx, cy = mean("x"), mean("y")
    return F.transform(poly, lambda p: F.struct((cx + (p["x"] - cx) * factor).cast("long").alias("x"), (cy + (p["y"] - cy) * factor).cast("long").alias("y")))


def _half(a: Column, b: Column) -> Column:
    return F.floor((a + b) / 2)


def test_points(b: Box, mode: str) -> list[tuple[Column, Column]]:
    """The points of a vehicle that are tested against the restricted area."""
    x1, y1, x2, y2 = b
    w, h = x2 - x1, y2 - y1
    mid = (_half(x1, x2), _half(y1, y2))
    if mode == "day":
        return [(mid[0], y2)]
    if mode == "night":
        return [(mid[0], y2), mid]
    if mode == "live_day":
        return [mid, (F.floor((x1 + 3 * x2) / 4), mid[1]), (F.floor((3 * x1 + x2) / 4), mid[1]), (x1, y1), (x2, y1), (x1, y2), (x2, y2)]
    if mode == "live_night":
        dx, dy = F.floor(w / 4), F.floor(h / 4)
        return [(x, y) for y in (y1 + dy, mid[1], y2 - dy, y2) for x in (x1 + dx, mid[0], x2 - dx)]
    raise ValueError(mode)


def area_shape(poly, mode: str) -> Column:
    """Edges of the area that a mode tests: night scales it by 1.1."""
    return polygon_edges(scaled_polygon(poly) if mode == "night" else poly)


def in_area(b: Box, shape, mode: str) -> Column:
    """Is any of the mode's points in the area (see :func:`area_shape`)."""
    points = F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in test_points(b, mode)))
    return F.exists(points, lambda p: point_in_edges(p["x"], p["y"], shape))


def pad_clip(b: Box, width, height, fx: float = 0.05, fy: float = 0.15) -> dict[str, Column]:
    """Pad by a share of the box, one pixel at least, and clip to the frame."""
    x1, y1, x2, y2 = b
    px = F.greatest(F.lit(1), ((x2 - x1) * fx).cast("long"))
    py = F.greatest(F.lit(1), ((y2 - y1) * fy).cast("long"))
    return {"x1": F.greatest(F.lit(0), x1 - px), "y1": F.greatest(F.lit(0), y1 - py), "x2": F.least(_c(width), x2 + px), "y2": F.least(_c(height), y2 + py)}


def pad_fixed(b: Box, width, height, pixels: int = 5) -> dict[str, Column]:
    """Pad by ``pixels`` and clip; a box without area becomes zeros."""
    x1, y1, x2, y2 = b
    new = (F.greatest(F.lit(0), x1 - pixels), F.greatest(F.lit(0), y1 - pixels), F.least(_c(width), x2 + pixels), F.least(_c(height), y2 + pixels))
    ok = (new[2] > new[0]) & (new[3] > new[1])
    return {n: F.when(ok, v).otherwise(0.0) for n, v in zip(("x1", "y1", "x2", "y2"), new)}


def rescale(b: Box, sx: float, sy: float) -> dict[str, Column]:
    return {n: (v * s).cast("long") for n, v, s in zip(("x1", "y1", "x2", "y2"), b, (sx, sy, sx, sy))}


def expand_roi(b: Box, width, height, night) -> dict[str, Column]:
    """Expand by 10 % (night 15 %) of the size on every side, truncated, and clip."""
    x1, y1, x2, y2 = b
    f = F.when(_c(night), 0.15).otherwise(0.10)
    dx, dy = ((x2 - x1) * f).cast("long"), ((y2 - y1) * f).cast("long")
    return {"x1": F.greatest(F.lit(0), x1 - dx), "y1": F.greatest(F.lit(0), y1 - dy), "x2": F.least(_c(width), x2 + dx), "y2": F.least(_c(height), y2 + dy)}


def context_box(b: Box, width, height, factor: float = 2.5) -> dict[str, Column]:
    """A box of ``factor`` times the size about the same centre, clipped."""
    x1, y1, x2, y2 = b
    cx, cy = _half(x1, x2), _half(y1, y2)
    w, h = ((x2 - x1) * factor).cast("long"), ((y2 - y1) * factor).cast("long")
    left, top = F.greatest(F.lit(0), cx - F.floor(w / 2)), F.greatest(F.lit(0), cy - F.floor(h / 2))
    return {"x1": left, "y1": top, "x2": F.least(_c(width), left + w), "y2": F.least(_c(height), top + h)}


def xywh_to_xyxy(x, y, w, h) -> dict[str, Column]:
    x, y, w, h = map(_c, (x, y, w, h))
    return {"x1": x, "y1": y, "x2": x + w, "y2": y + h}


def box_to_z(b: Box) -> dict[str, Column]:
    """Centre, area and ratio."""
    x1, y1, x2, y2 = b
    w, h = x2 - x1, y2 - y1
    return {"cx": x1 + w / 2, "cy": y1 + h / 2, "area": w * h, "ratio": F.try_divide(w, h)}


def z_to_box(cx, cy, area, ratio) -> dict[str, Column]:
    cx, cy, area, ratio = map(_c, (cx, cy, area, ratio))
    w = F.sqrt(area * ratio)
    h = F.try_divide(area, w)
    return {"x1": cx - w / 2, "y1": cy - h / 2, "x2": cx + w / 2, "y2": cy + h / 2}


def plate_shaped(b: Box, low: float = 1.5, high: float = 6.0) -> Column:
    ratio = (b[2] - b[0]) / F.nullif(b[3] - b[1], F.lit(0.0))
    return F.coalesce(ratio.between(low, high), F.lit(False))


def size_guard(b: Box, min_h: int = 15, min_w: int = 40) -> Column:
    """Marker for boxes too small to read, else null."""
    return F.when((b[3] - b[1] < min_h) | (b[2] - b[0] < min_w), "NO_PLATE_SMALL")


def video_time(frame, fps, live: bool = False) -> Column:
    return _c(frame) / (F.greatest(_c(fps), F.lit(30)) if live else _c(fps))


def clock(seconds, millis: bool = False) -> Column:
    """``mm:ss`` or ``mm:ss.mmm`` of seconds, truncated."""
    s = _c(seconds)
    whole = F.floor(s)
    minute, second = F.floor(whole / 60).cast("int"), (whole % 60).cast("int")
    if not millis:
        return F.when(s.isNotNull(), F.format_string("%02d:%02d", minute, second))
    return F.when(s.isNotNull(), F.format_string("%02d:%02d.%03d", minute, second, F.floor((s - whole) * 1000).cast("int")))


def phase(frame, green, yellow, red) -> dict[str, Column]:
    """State, segment number, start and end of the signal's cycle at a frame (null if the
    cycle has no length). All in frames; a cycle starts with green."""
    f, g, y, r = (_c(x).cast("long") for x in (frame, green, yellow, red))
    cycle = F.when(g + y + r > 0, g + y + r)
    m, seg = F.pmod(f, cycle), F.floor(f / cycle)
    start = seg * cycle + g + y
    return {
        "state": F.when(m < g, "green").when(m < g + y, "yellow").when(m.isNotNull(), "red"),
        "segment": seg, "red_start": start, "red_end": start + r,
    }
