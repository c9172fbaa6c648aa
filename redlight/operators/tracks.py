"""Tracks: gap filling, best reads, rates, and the multi-object tracker."""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize, partitions

BOX = ("x1", "y1", "x2", "y2")


def interpolate_tracks(df: DataFrame, key: str = "car_id") -> DataFrame:
    """One row for every frame between a car's first and last; boxes of missing frames lie on
    the line between their neighbours, and ``imputed`` is true."""
    w = Window.partitionBy(key).orderBy("frame")
    rows = df.withColumn("_next", F.lead(F.struct("frame", *BOX)).over(w))
    rows = rows.withColumn("_f", F.explode(F.sequence("frame", F.coalesce(F.col("_next.frame") - 1, F.col("frame")))))
    share = (F.col("_f") - F.col("frame")) / F.coalesce(F.col("_next.frame") - F.col("frame"), F.lit(1))
    lerp = {c: F.when(F.col("_f") == F.col("frame"), F.col(c)).otherwise(F.col(c) + (F.col(f"_next.{c}") - F.col(c)) * share) for c in BOX}
    new = F.col("_f") != F.col("frame")
    return rows.select(key, F.col("_f").alias("frame"), *(v.alias(c) for c, v in lerp.items()), F.when(new, 0.0).otherwise(F.col("text_score")).alias("text_score"), new.alias("imputed"))


def best_read_per_car(df: DataFrame, key: str = "car_id") -> DataFrame:
    """The row with the highest text score; of equals the earliest."""
    w = Window.partitionBy(key).orderBy(F.desc("text_score"), "frame")
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def annotate_frames(df: DataFrame, key: str = "car_id") -> DataFrame:
    """Every frame of a car with the car's best read."""
    best = best_read_per_car(df, key).select(key, F.col("frame").alias("best_frame"), F.col("text_score").alias("best_score"))
    return df.join(best, key)


def hit_streaks(df: DataFrame, key: str = "car_id") -> DataFrame:
    """``streak``: consecutive frames up to this one; ``age``: frames since the first."""
    w = Window.partitionBy(key).orderBy("frame")
    rows = df.withColumn("_island", F.col("frame") - F.row_number().over(w))
    return rows.withColumns({"streak": F.row_number().over(Window.partitionBy(key, "_island").orderBy("frame")), "age": F.col("frame") - F.min("frame").over(Window.partitionBy(key))}).drop("_island")


def ema_rate(df: DataFrame, key: str, order: str, weight: float = 0.1) -> DataFrame:
    """One row per key: r = (1 - weight) r + weight / dt, from 0, over its ordered steps."""
    w = Window.partitionBy(key).orderBy(order)
    steps = df.withColumn("_dt", F.col(order) - F.lag(order).over(w)).where("_dt > 0")
    # The recurrence is a weighted sum: a step counts less by 1 - weight for each later one.
    later = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))) - 1
    return steps.withColumn("_later", later).groupBy(key).agg(F.sum(weight * F.pow(F.lit(1 - weight), F.col("_later")) / F.col("_dt")).alias("rate"))


# --- tracker -------------------------------------------------------------------------------
# Simple online tracking (arXiv 1602.00763): constant-velocity Kalman filter over
# (centre, area, ratio), assignment by overlap. The noise of the filter. The
# order of steps within a frame is required, as results depend on it.
#
# All noise is diagonal and a velocity acts on its own coordinate alone, so the filter falls into
# one of two values for each coordinate with a velocity and one of a single value (the ratio). A
# frame holds few boxes, for which a call on arrays costs more than the sums themselves: tracks
# are lists of numbers.
_XY = (1.0, 1.0, 0.01)  # noise of a measured centre, of its step and of its velocity's step
_AREA = (10.0, 1.0, 0.0001)
_RATIO = (10.0, 1.0)
_ID, _MISS, _STREAK, _X, _Y, _S, _R, _VX, _VY, _VS, _P, _PS, _PR = range(13)
_NAN = float("nan")

#: Pairs of boxes of one frame from which on arrays are faster.
MANY = 1024


def assign(cost: np.ndarray | list[list[float]]) -> list[tuple[int, int]]:
    """Assignment of least cost (shortest augmenting paths)."""
    if not len(cost) or not len(cost[0]):
        return []
    turned = len(cost) > len(cost[0])
    c = np.asarray(cost).T.tolist() if turned else [list(r) for r in cost]
    n, m = len(c), len(c[0])
    inf = float("inf")
    u, v, owner = [0.0] * n, [0.0] * (m + 1), [-1] * (m + 1)
    for i in range(n):
        least = [x - y for x, y in zip(c[i], v)]
        gain = min(least)
        j = least.index(gain)
        u[i] += gain
        if owner[j] < 0:
            owner[j] = i
            continue
        owner[m] = i
        least = [x - gain for x in least]
        back, seen, free = [m] * m, [m], list(range(m))
        free.remove(j)
        while owner[j] >= 0:
            seen.append(j)
            row = owner[j]
            costs, at = c[row], u[row]
            gain, nxt = inf, -1
            for k in free:
                slack = costs[k] - at - v[k]
                if slack < least[k]:
                    least[k], back[k] = slack, j
                if nxt < 0 or least[k] < gain:
                    gain, nxt = least[k], k
            for k in seen:
                u[owner[k]] += gain
                v[k] -= gain
            for k in free:
                least[k] -= gain
            free.remove(nxt)
            j = nxt
        while j != m:
            owner[j], j = owner[back[j]], back[j]
    pairs = [(owner[j], j) for j in range(m) if owner[j] >= 0]
    return sorted((b, a) if turned else (a, b) for a, b in pairs)


def _box(t: list) -> tuple[float, float, float, float]:
    """Box of a track; NaN where it has no width."""
    square = t[_S] * t[_R]
    w = math.sqrt(square) if square > 0 else square * 0.0
    h = t[_S] / w if w else _NAN
    return t[_X] - w / 2, t[_Y] - h / 2, t[_X] + w / 2, t[_Y] + h / 2


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lo, hi = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    inter = np.maximum(hi - lo, 0).prod(2)
    size = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    with np.errstate(all="ignore"):
        return inter / (size(a)[:, None] + size(b)[None, :] - inter)


def _shares(dets: list, boxes: list) -> list[list[float]]:
    """Overlaps of few boxes; what has no area, no end or no number is left to arrays."""
    ours, theirs = ([(*b, (b[2] - b[0]) * (b[3] - b[1])) for b in side] for side in (dets, boxes))
    if len(dets) * len(boxes) >= MANY or not all(0 < b[4] < 1e100 for b in ours + theirs):
        return np.nan_to_num(overlaps(np.array(dets, float), np.array(boxes, float))).tolist()
    out = []
    for x1, y1, x2, y2, size in ours:
        row = []
        for a1, b1, a2, b2, other in theirs:
            w = (x2 if x2 < a2 else a2) - (x1 if x1 > a1 else a1)
            h = (y2 if y2 < b2 else b2) - (y1 if y1 > b1 else b1)
            inter = w * h if w > 0 and h > 0 else 0.0
            row.append(inter / (size + other - inter))
        out.append(row)
    return out


def associate(dets: list, tracks: list, least: float) -> list[tuple[int, int]]:
    """Pairs (detection, track) of an overlap of at least ``least``."""
    if not dets or not tracks:
        return []
    o = _shares(dets, tracks)
    hits = [(d, t) for d, row in enumerate(o) for t, share in enumerate(row) if share > least]
    if hits and len({d for d, _ in hits}) == len(hits) == len({t for _, t in hits}):
        return hits
    return [(d, t) for d, t in assign([[-share for share in row] for row in o]) if o[d][t] >= least]


def _ahead(p: tuple, noise: tuple) -> tuple:
    """Covariance of a coordinate and its velocity a frame later."""
    a, b, d, c = p
    return (a + d) + (b + c) + noise[1], b + c, d + c, c + noise[2]


def _measured(p: tuple, noise: tuple) -> tuple[float, float, tuple]:
    """Gains of a coordinate and its velocity, and their covariance after a measurement."""
    a, b, d, c = p
    inverse = 1.0 / (a + noise[0])
    g, gv = a * inverse, d * inverse
    return g, gv, (a - g * a, b - g * b, d - gv * a, c - gv * b)


class Tracker:
    """State of one sequence; :meth:`step` takes every frame, also empty ones. Tracks are told
    newest first, as the order of results is part of them."""

    def __init__(self, max_age: int = 1, min_hits: int = 3, iou: float = 0.3):
        self.max_age, self.min_hits, self.iou = max_age, min_hits, iou
        self.frame, self.made = 0, 0
        self.tracks: list[list] = []

    def step(self, dets: np.ndarray | list) -> list[tuple]:
        self.frame += 1
        dets = dets.tolist() if isinstance(dets, np.ndarray) else dets
        boxes, living = [], []
        for t in self.tracks:
            if t[_S] + t[_VS] <= 0:
                t[_VS] = 0.0
            t[_X] += t[_VX]
            t[_Y] += t[_VY]
            t[_S] += t[_VS]
            t[_P], t[_PS], t[_PR] = _ahead(t[_P], _XY), _ahead(t[_PS], _AREA), t[_PR] + _RATIO[1]
            if t[_MISS] > 0:
                t[_STREAK] = 0
            t[_MISS] += 1
            box = _box(t)
            if math.isfinite(sum(t[_X : _VS + 1]) + sum(box)):
                living.append(t)
                boxes.append(box)
        self.tracks = living
        pairs = associate(dets, boxes, self.iou)
        for d, i in pairs:
            t = living[i]
            x1, y1, x2, y2 = dets[d]
            w, h = x2 - x1, y2 - y1
            g, gv, t[_P] = _measured(t[_P], _XY)
            off = x1 + w / 2 - t[_X]
            t[_X] += g * off
            t[_VX] += gv * off
            off = y1 + h / 2 - t[_Y]
            t[_Y] += g * off
            t[_VY] += gv * off
            g, gv, t[_PS] = _measured(t[_PS], _AREA)
            off = w * h - t[_S]
            t[_S] += g * off
            t[_VS] += gv * off
            g = t[_PR] * (1.0 / (t[_PR] + _RATIO[0]))
            t[_R] += g * ((w / h if h else 0.0) - t[_R])
            t[_PR] -= g * t[_PR]
            t[_MISS] = 0
            t[_STREAK] += 1
        taken = {d for d, _ in pairs}
        for d, (x1, y1, x2, y2) in enumerate(dets):
            if d not in taken:
                self.made += 1
                w, h = x2 - x1, y2 - y1
                at = [x1 + w / 2, y1 + h / 2, w * h, w / h if h else 0.0, 0.0, 0.0, 0.0]
                living.append([self.made, 0, 0, *at, (10.0, 0.0, 0.0, 1e4), (10.0, 0.0, 0.0, 1e4), 10.0])
        early = self.frame <= self.min_hits
        out = [(self.frame, t[_ID], *_box(t)) for t in reversed(living) if t[_MISS] < 1 and (early or t[_STREAK] >= self.min_hits)]
        self.tracks = [t for t in living if t[_MISS] <= self.max_age]
        return out


#: Frames of one key that are searched for gaps in one task.
FRAME_BLOCK = 1 << 16
#: Frames of a part that are stepped at a stretch, how many more are looked at until the next
#: stretch's tracks agree, and how often stretches that do not agree are joined one by one.
STRETCH, LOOK, ROUNDS = 4096, 1024, 4


def alive_parts(dets: DataFrame, key: str, max_age: int) -> DataFrame:
    """``_k, _f, _part`` for every frame of every sequence: the first frame of the stretch that
    it lies in. Between stretches more than ``max_age`` frames have no detection, so no track
    lives through. Frames are searched in blocks; what blocks need of each other is one row
    per block."""
    frames = materialize(dets.select(F.col(key).alias("_k"), F.col("frame").alias("_f"), F.floor(F.col("frame") / FRAME_BLOCK).alias("_b")).distinct(), "frames")
    inside, over = Window.partitionBy("_k", "_b").orderBy("_f"), Window.partitionBy("_k").orderBy("_b")
    blocks = frames.groupBy("_k", "_b").agg(F.max("_f").alias("_hi")).select(F.col("_k").alias("_bk"), F.col("_b").alias("_bb"), F.lag("_hi").over(over).alias("_before"))
    same = F.col("_k").eqNullSafe(F.col("_bk")) & (F.col("_b") == F.col("_bb"))
    rows = frames.withColumn("_last", F.lag("_f").over(inside)).join(blocks, same).withColumn("_last", F.coalesce("_last", "_before"))
    new = F.when(F.col("_last").isNull() | (F.col("_f") - F.col("_last") > max_age + 1), F.col("_f"))
    rows = materialize(rows.select("_k", "_b", "_f", F.max(new).over(inside).alias("_part")), "frames")
    starts = rows.groupBy("_k", "_b").agg(F.max("_part").alias("_part")).select(F.col("_k").alias("_bk"), F.col("_b").alias("_bb"), F.max("_part").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_open"))
    return rows.join(starts, same).select("_k", "_f", F.coalesce("_part", "_open").alias("_part"))


def _agree(old: Tracker, new: Tracker, before: int) -> bool:
    """Whether two trackers hold the same tracks, all of them begun after ``old`` had made
    ``before``: from here on they tell the same, but for the ids."""
    return len(old.tracks) == len(new.tracks) and all(x[_ID] > before and x[1:] == y[1:] for x, y in zip(old.tracks, new.tracks))


def _stretches(rows: DataFrame, key: str, max_age: int, min_hits: int, iou: float, order: str) -> DataFrame:
    """Steps the rows of each ``_part, _piece`` from no tracks on. Rows with ``_look`` are the
    next stretch's first: there a second tracker starts as the next stretch does, and the
    stretch ends with the frame in which both agree. Told is what tracks tell and, without a
    frame, one row for each stretch: the number of tracks it made, the ``seconds`` its steps
    took, its last frame and, for the next stretch, the frame ``_to`` in which they agree, the
    tracks ``_skip`` that the second tracker made until then and the ``_names`` of those that
    live, counted back from the last track made. ``_open``: they do not agree."""
    names = [key, "_part", "_piece", "_look", "frame", order, *BOX]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    rows = rows.select(*names).repartition(partitions(rows.sparkSession), key, "_part", "_piece").sortWithinPartitions(key, "_part", "_piece", "frame", order)
    schema = f"{key} {types[key]}, _part long, _piece long, frame long, track_id long, x1 double, y1 double, x2 double, y2 double, seconds double, last long, _to long, _skip long, _names map<bigint,bigint>, _open boolean"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out, kinds = None, [], [], None
        tracker = other = to = None
        before, seconds, ahead = 0, 0.0, False

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=[c.split()[0] for c in schema.split(", ")])

        def step(tracker, boxes):
            for _ in range(min(at[3] - tracker.frame - 1, max_age + 1)):
                tracker.step([])
            tracker.frame = at[3] - 1
            return tracker.step(boxes)

        def close():
            """Step the frame that is complete."""
            nonlocal other, before, to, seconds
            began = time.perf_counter()
            boxes = [[_NAN if v is None else float(v) for v in b] for b in held]
            if ahead and other is None:
                other, before = Tracker(max_age, min_hits, iou), tracker.made
                other.frame = at[3] - 1
            out.extend((*at[:3], *r, *[None] * 6) for r in step(tracker, boxes))
            if other:
                step(other, boxes)
                if _agree(tracker, other, before):
                    to = at[3]
            seconds += time.perf_counter() - began

        def end():
            same = [(y[_ID], x[_ID] - tracker.made) for x, y in zip(tracker.tracks, other.tracks)] if to else None
            out.append((*at[:3], None, tracker.made, *[None] * 4, seconds, at[3], to, other.made if to else None, same, bool(other) and not to))

        for b in batches:
            kinds = kinds or [b.column(0).type, *[pa.int64()] * 4, *[pa.float64()] * 5, *[pa.int64()] * 3, pa.map_(pa.int64(), pa.int64()), pa.bool_()]
            cols = [b.column(i).to_pylist() for i in (0, 1, 2, 4, 3, 6, 7, 8, 9)]
            for k, part, piece, f, look, *box in zip(*cols):
                now = (k, part, piece, f)
                if now != at:
                    if held:
                        close()
                        held = []
                    if at is None or now[:3] != at[:3]:
                        if at:
                            end()
                        tracker, other, to, seconds = Tracker(max_age, min_hits, iou), None, None, 0.0
                        tracker.frame = f - 1
                    at, ahead = now, look
                if not to:
                    held.append(box)
            if len(out) >= 20_000:
                yield batch()
                out = []
        if held:
            close()
        if at:
            end()
        if out:
            yield batch()

    return materialize(rows.mapInArrow(work, schema), "tracks")


def _stepped(dets: DataFrame, key: str, max_age: int, min_hits: int, iou: float, order: str) -> DataFrame:
    """What tracks tell, by parts and stretches (see :func:`_stretches`).

    A stretch starts from no tracks, so what it tells counts from the frame on in which the
    stretch before agrees with it. Where they do not agree in time, they are stepped again as
    one; after some rounds, a part is one stretch from there on."""
    look = max(LOOK, max_age + 2)
    stretch = max(STRETCH, look)
    same = lambda *more: F.col(key).eqNullSafe(F.col("_k")) & reduce(and_, (F.col(a) == F.col(b) for a, b in more))
    parts = alive_parts(dets.where("frame >= 1"), key, max_age)
    rows = dets.where("frame >= 1").join(parts, same(("frame", "_f"))).select(key, "_part", "frame", order, *BOX)
    rows = rows.withColumns({"_piece": F.floor((F.col("frame") - F.col("_part")) / stretch), "_first": (F.col("frame") - F.col("_part")) % stretch < look})
    both = F.when(F.col("_first") & (F.col("_piece") > 0), F.array("_piece", F.col("_piece") - 1)).otherwise(F.array("_piece"))
    sent = rows.withColumns({"_own": F.col("_piece"), "_piece": F.explode(both)}).withColumn("_look", F.col("_own") > F.col("_piece"))
    made = _stretches(sent, key, max_age, min_hits, iou, order)
    pieces = made.where("frame is null").select(F.col(key).alias("_k"), F.col("_part").alias("_p"), F.col("_piece").alias("_i"), F.col("_piece").alias("_in"))
    for n in range(1, ROUNDS + 1):
        ends = made.where("frame is null").select(key, "_part", "_piece", "_open")
        if ends.where("_open").isEmpty():
            break
        w = Window.partitionBy("_k", "_p").orderBy("_i")
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        now = pieces.join(ends, same(("_part", "_p"), ("_piece", "_in"))).select("_k", "_p", "_i", "_in", "_open")
        fails = F.lag("_open").over(w) if n < ROUNDS else F.max("_open").over(before)
        starts = F.lag("_in").over(w).isNull() | ((F.lag("_in").over(w) != F.col("_in")) & ~fails)
        now = now.withColumn("_to", F.max(F.when(starts, F.col("_i"))).over(w))
        now = now.withColumn("_again", F.max(F.col("_to") != F.col("_in")).over(Window.partitionBy("_k", "_p", "_to")))
        last = F.lag(F.struct("_to", "_again")).over(w)
        now = now.withColumn("_back", F.when(last["_again"] & (last["_to"] != F.col("_to")), last["_to"]))
        now = materialize(now.select("_k", "_p", "_i", "_in", "_to", "_again", "_back"), "pieces")
        targets = F.array_compact(F.array(F.when(F.col("_again"), F.col("_to")), F.when(F.col("_first"), F.col("_back"))))
        sent = rows.join(now, same(("_part", "_p"), ("_piece", "_i"))).withColumns({"_own": F.col("_to"), "_piece": F.explode(targets)})
        again = _stretches(sent.withColumn("_look", F.col("_own") > F.col("_piece")), key, max_age, min_hits, iou, order)
        old = now.where("_again").select("_k", "_p", "_in").distinct()
        made = made.join(old, same(("_part", "_p"), ("_piece", "_in")), "left_anti").unionByName(again)
        pieces = now.select("_k", "_p", "_i", F.col("_to").alias("_in"))
    return made


def _numbered_on(made: DataFrame, key: str) -> DataFrame:
    """Tracks of all stretches, each from the frame on that it counts from, with ids that go on
    from those of earlier stretches and parts."""
    last = Window.partitionBy(key, "_part").orderBy("_piece")
    before = Window.partitionBy(key).orderBy("_part", "_piece").rowsBetween(Window.unboundedPreceding, -1)
    ends = made.where("frame is null").select(key, "_part", "_piece", "track_id", *(F.lag(c).over(last).alias(c) for c in ("_to", "_skip", "_names")))
    ends = ends.withColumn("_skip", F.coalesce("_skip", F.lit(0))).withColumn("_made", F.coalesce(F.sum(F.col("track_id") - F.col("_skip")).over(before), F.lit(0)))
    ends = ends.select(F.col(key).alias("_k"), F.col("_part").alias("_p"), F.col("_piece").alias("_i"), F.coalesce("_to", F.lit(0)).alias("_after"), "_skip", "_names", "_made")
    told = made.where("frame is not null").select(key, "_part", "_piece", "frame", "track_id", *BOX)
    told = told.join(ends, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")) & (F.col("_piece") == F.col("_i"))).where("frame > _after")
    own = F.when(F.col("track_id") > F.col("_skip"), F.col("track_id") - F.col("_skip")).otherwise(F.col("_names")[F.col("track_id")])
    return told.select(key, "frame", (F.col("_made") + own).alias("track_id"), *BOX)


def track(dets: DataFrame, key: str = "seq", max_age: int = 1, min_hits: int = 3, iou: float = 0.3, order: str = "det_id") -> DataFrame:
    """``key, frame, track_id`` and the filtered boxes. Within a sequence frames are stepped in
    order, frames without a detection too. Frames count from 1; rows of frames below are not
    part of a sequence and are left out. Rows of a frame are taken in the order of ``order``,
    so input partitions do not matter.

    Sequences are cut where no track lives through and, between, into stretches that start from
    no tracks and run in parallel; a stretch counts from the frame on in which the one before
    holds the very same tracks. Ids are numbered on by the number of tracks that earlier ones
    made. A task streams over its stretches and holds one frame and the tracks that live in it.
    """
    return _numbered_on(_stepped(dets, key, max_age, min_hits, iou, order), key)


def track_timed(dets: DataFrame, key: str = "seq", max_age: int = 1, min_hits: int = 3, iou: float = 0.3, order: str = "det_id") -> tuple[DataFrame, DataFrame]:
    """The tracks, and ``key, frames, seconds`` of each sequence from the same run: frames up to
    its last one, and the seconds that stepping its stretches took in the tasks."""
    made = _stepped(dets, key, max_age, min_hits, iou, order)
    took = made.where("frame is null").groupBy(key).agg(F.max("last").alias("frames"), F.sum("seconds").alias("seconds"))
    return _numbered_on(made, key), took


def tracking_throughput(df: DataFrame) -> DataFrame:
    """``seconds, frames, per_second`` from rows of ``seconds, frames``."""
    return df.agg(F.sum("seconds").alias("seconds"), F.sum("frames").alias("frames"), F.coalesce(F.try_divide(F.sum("frames"), F.sum("seconds")), F.lit(0.0)).alias("per_second"))
