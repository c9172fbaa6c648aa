"""Live operators: transformations that take streams as they take tables.

Event time is ``ts`` (a timestamp with time zone). State is bounded by the watermark: rows
later than it are dropped; the batch twin of a query shows them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions.plates import fold_confusable
from ..operators.detections import infractions
from ..operators.tracks import BOX, Tracker


def use_state_store(spark: SparkSession) -> None:
    """Operators with state of their own need the RocksDB state store in the session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def only_with_rows(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside run no batches without rows. A stream with timers on the
    clock would run them without end, so with ``availableNow`` it would never stop; its timers
    are looked at with every batch that has rows of any key."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name, "true")
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def live_infractions(det: DataFrame, presets: DataFrame, areas: DataFrame, fps: float = 1.0, night: bool = False) -> DataFrame:
    """Phase and infraction filter per frame: stream with static configuration."""
    return infractions(det, presets, areas, fps, night)


def first_sightings(df: DataFrame, key: str = "plate", late: str = "1 day") -> DataFrame:
    """The first row of each plate within the watermark's span."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def running_indicators(df: DataFrame, key: str = "plate") -> DataFrame:
    """Per plate running count, last sighting and, where rows have a ``processing_time``, its
    positive values' sum (0.01 at least each) and number (output mode update or complete)."""
    found = [F.count("*").alias("n"), F.max("ts").alias("last")]
    if "processing_time" in df.columns:
        took = F.when(F.col("processing_time") > 0, F.greatest("processing_time", F.lit(0.01)))
        found += [F.sum(took).alias("seconds"), F.count(took).alias("timed")]
    return df.groupBy(key).agg(*found)


def panel(running: DataFrame) -> DataFrame:
    """``ti, tr, ir`` of a table of :func:`running_indicators`: plates seen, mean seconds, and
    the share of plates that came back, in per cent; 0 where there is nothing."""
    return running.agg(
        F.count("*").alias("ti"),
        F.coalesce(F.try_divide(F.sum("seconds"), F.sum("timed")), F.lit(0.0)).alias("tr"),
        F.coalesce(F.avg(F.when(F.col("n") > 1, 100.0).otherwise(0.0)), F.lit(0.0)).alias("ir"),
    )


def _changes(rows: pd.DataFrame, state) -> tuple:
    """What rows of several plates change in a map of plate -> (number, seconds, timed), as
    totals: plates that are new, that came back for the first time, seconds, timed."""
    took = rows["took"].where(rows["took"] > 0).clip(lower=0.01)
    found = pd.DataFrame({"plate": rows["plate"], "n": 1, "s": took.fillna(0.0), "k": took.notna().astype(int)}).groupby("plate", sort=True).sum()
    total = [0, 0, 0.0, 0]
    for plate, n, s, k in zip(found.index.tolist(), found["n"], found["s"], found["k"]):
        old = state.getValue((plate,))[0] if state.containsKey((plate,)) else 0
        state.updateValue((plate,), (old + int(n),))
        total[0] += old == 0
        total[1] += old < 2 <= old + n
        total[2] += float(s)
        total[3] += int(k)
    return tuple(total)


class PanelChanges(StatefulProcessor):
    """For each bucket of plates how a batch changes the panel's totals. State: how often each
    plate was seen, in the state store, one entry a plate; a batch touches its own plates only."""

    def __init__(self, kind: str):
        self.kind = kind

    def init(self, handle) -> None:
        self.seen = handle.getMapState("seen", f"plate {self.kind}", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = [_changes(part, self.seen) for part in rows]
        yield pd.DataFrame({name: [sum(f[i] for f in found)] for i, name in enumerate(("plates", "back", "seconds", "timed"))})

    def close(self) -> None:
        pass


def panel_changes(df: DataFrame, key: str = "plate", buckets: int = 256) -> DataFrame:
    """``plates, back, seconds, timed``: what each micro-batch adds to the totals, at most one
    row for each bucket of plates. Rows may have a ``processing_time``; null plates count as one."""
    took = F.col("processing_time") if "processing_time" in df.columns else F.lit(None)
    kind = df.schema[key].dataType.simpleString()
    empty = "''" if kind == "string" else f"cast(0 as {kind})"
    rows = df.select(F.coalesce(F.col(key), F.expr(empty)).alias("plate"), took.cast("double").alias("took"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("plate"), F.lit(buckets)).cast("int"))
    return rows.groupBy("bucket").transformWithStateInPandas(PanelChanges(kind), "plates long, back long, seconds double, timed long", "Append", "None")


def write_panel(df: DataFrame, path: str, checkpoint: str, key: str = "plate"):
    """Renews the panel with every batch: one row ``batch, plates, back, seconds, timed, ti, tr,
    ir`` each, under ``path``. Plates seen, mean seconds and the share of plates that came back
    are totals over plates, so a batch adds what it changes to the row before: its cost follows
    its own rows. A batch that is run again overwrites its own row."""
    columns = ("plates", "back", "seconds", "timed")

    def renew(changes: DataFrame, batch: int) -> None:
        spark = changes.sparkSession
        new = changes.select(*columns)
        if batch:
            new = new.unionByName(spark.read.parquet(f"{path}/{batch - 1:09d}").select(*columns))
        total = new.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast(new.schema[c].dataType).alias(c) for c in columns))
        shown = {"ti": F.col("plates"), "tr": F.coalesce(F.try_divide("seconds", "timed"), F.lit(0.0)), "ir": F.coalesce(F.try_divide(100.0 * F.col("back"), F.col("plates")), F.lit(0.0))}
        total.withColumns({**shown, "batch": F.lit(batch)}).write.mode("overwrite").parquet(f"{path}/{batch:09d}")

    return panel_changes(df, key).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(renew)


def daily_counts(df: DataFrame, late: str = "1 day") -> DataFrame:
    return df.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "n")


def late_rows(df: DataFrame, batch: str, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Rows that :func:`daily_counts` drops where it reads one ``batch`` number after the
    other: those of windows that had ended by the watermark for late rows. That is the latest
    time less ``late`` over all batches but this one and the one before it: the watermark
    moves when a batch is done, and late rows are still told by the one before."""
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -2)
    # One row per batch.
    marks = df.groupBy(F.col(batch).alias("_b")).agg(F.max("ts").alias("_max")).select("_b", (F.max("_max").over(before) - F.expr(f"INTERVAL {late}")).alias("_mark"))
    return df.join(marks, F.col(batch) == F.col("_b")).where(F.window("ts", window)["end"] <= F.col("_mark")).select(*df.columns)


def split_late(df: DataFrame, path: str, checkpoint: str, late: str = "1 day", window: str = "1 day"):
    """Writes every batch in two parts under ``path``: ``kept`` and ``late``, by whether
    :func:`daily_counts` takes or drops the row, and ``marks``, the latest time of each batch.
    A batch is judged by the marks of those before the one before it, as the watermark is; it
    overwrites its own parts when it is run again, also after a restart."""
    def split(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        spark.createDataFrame([(None,)], "ts timestamp").unionByName(rows.select("ts")).agg(F.max("ts").alias("latest")).write.mode("overwrite").parquet(f"{path}/marks/batch={batch}")
        mark = None
        if batch > 1:
            mark = spark.read.parquet(f"{path}/marks").where(F.col("batch") <= batch - 2).agg(F.max("latest") - F.expr(f"INTERVAL {late}")).first()[0]
        gone = F.coalesce(F.window("ts", window)["end"] <= F.lit(mark).cast("timestamp"), F.lit(False))
        told = rows.withColumn("_late", gone)
        for name, part in (("kept", told.where("not _late")), ("late", told.where("_late"))):
            part.drop("_late").write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")

    return df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(split)


def near_time_groups(df: DataFrame, key: str = "plate", gap: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Sightings of one plate that follow each other within ``gap``."""
    return df.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), "n")


def near_duplicates(left: DataFrame, right: DataFrame, key: str = "plate", id_col: str = "id", within: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """``a, b, dt``: sightings less than ``within`` apart whose plates are equal once look-alike
    characters are folded; ``a`` is the earlier, of equal times the smaller id.

    ``left`` and ``right`` are two readings of one stream. Both have a watermark, so Spark keeps
    a sighting only as long as a partner can still come: ``within`` and ``late``.
    """
    side = lambda df, k: df.select(F.col(id_col).alias(k), F.col("ts").alias(f"{k}_ts"), fold_confusable(F.regexp_replace(F.col(key).cast("string"), "[- ]", "")).alias(f"{k}_plate")).withWatermark(f"{k}_ts", late)
    near = F.expr(f"b_ts >= a_ts AND b_ts < a_ts + INTERVAL {within}")
    order = (F.col("a_ts") < F.col("b_ts")) | (F.col("a") < F.col("b"))
    both = side(left, "a").join(side(right, "b"), (F.col("a_plate") == F.col("b_plate")) & near & order)
    return both.select("a", "b", (F.col("b_ts").cast("double") - F.col("a_ts").cast("double")).alias("dt"))


class FrameTracker(StatefulProcessor):
    """The tracker of one camera over a stream. State: the tracks that live, and the rows of the
    last ``slack`` frames, which wait until what may come before them has come. ``idle``
    milliseconds after the last batch a timer steps what waits and drops all state."""

    def __init__(self, key: str, max_age: int, min_hits: int, iou: float, slack: int, idle: int):
        self.key, self.made, self.slack, self.idle = key, (max_age, min_hits, iou), slack, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("tracker", "data binary, first long, seen long")
        self.waiting = handle.getMapState("waiting", "frame long", "rows binary")

    def _step(self, key, upto: int | None) -> list[tuple]:
        """Steps waiting frames up to ``upto``, in order."""
        data, first, _ = self.state.get() if self.state.exists() else (None, None, None)
        tracker = Tracker(*self.made)
        if data:
            vars(tracker).update(pickle.loads(data))
        out = []
        for f in sorted(k[0] for k in self.waiting.keys()):
            if upto is not None and f > upto:
                break
            boxes = sorted(pickle.loads(self.waiting.getValue((f,))[0]))
            self.waiting.removeKey((f,))
            first = f if first is None else first
            for _ in range(min(f - tracker.frame - 1, self.made[0] + 1)):
                tracker.step(np.zeros((0, 4)))
            tracker.frame = f - 1
            out += [(key[0], first, *r, False) for r in tracker.step(np.array([b[1:] for b in boxes], float))]
        self.tracker, self.first = tracker, first
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        data, _, seen = self.state.get() if self.state.exists() else (None, None, None)
        done = pickle.loads(data)["frame"] if data else 0
        late = []
        for part in rows:
            part = part[part["frame"].notna()]
            frames = part["frame"].to_numpy(dtype="int64")
            order = np.argsort(frames, kind="stable")
            boxed = part["det_id"].notna().to_numpy()[order].tolist()
            found = list(zip(*(part[c].to_numpy()[order].tolist() for c in ("det_id", *BOX))))
            # A frame of few rows costs more as a table of its own than as a stretch of a list.
            starts, counts = np.unique(frames[order], return_index=True, return_counts=True)[1:]
            for i, n in zip(starts.tolist(), counts.tolist()):
                f = int(frames[order[i]])
                new = [r for r, has in zip(found[i : i + n], boxed[i : i + n]) if has]
                if f <= done:
                    late += [(key[0], None, f, None, *r[1:], True) for r in new]
                    continue
                seen = f if seen is None else max(seen, f)
                if new:
                    old = pickle.loads(self.waiting.getValue((f,))[0]) if self.waiting.containsKey((f,)) else []
                    self.waiting.updateValue((f,), (pickle.dumps(old + new),))
        out = self._step(key, seen - self.slack) if seen is not None else []
        if seen is not None:
            self.state.update((pickle.dumps(vars(self.tracker)), self.first, seen))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield self._table(out + late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self._step(key, None)
        self.state.clear()
        self.waiting.clear()
        yield self._table(out)

    def _table(self, rows: list[tuple]) -> pd.DataFrame:
        table = pd.DataFrame(rows, columns=[self.key, "session", "frame", "track_id", *BOX, "late"])
        return table.astype({c: "Int64" for c in ("session", "frame", "track_id")} | {"late": "boolean"})

    def close(self) -> None:
        pass


def online_tracker(dets: DataFrame, key: str = "camera", max_age: int = 1, min_hits: int = 3, iou: float = 0.3, slack: int = 0, idle: int = 3_600_000) -> DataFrame:
    """``key, session, frame, track_id``, the filtered boxes and ``late``, per camera.

    Rows may arrive out of order, across batches too: a frame is stepped once frames ``slack``
    further on have been seen, so within ``slack`` frames results are those of
    :func:`..operators.tracks.track`. What comes later still is told as it came, with ``late``
    true and no track; nothing is lost unseen. A row with null ``det_id`` has no box and only
    moves the time on. ``idle`` milliseconds after its last batch a camera's waiting frames are
    stepped and its state goes; its next frames are a new ``session``, named by its first frame,
    with track ids from 1 on. Frames count from 1. The session needs the RocksDB state store
    (:func:`use_state_store`); start the stream in :func:`only_with_rows`.
    """
    kind = dets.schema[key].dataType.simpleString()
    processor = FrameTracker(key, max_age, min_hits, iou, slack, idle)
    out = f"{key} {kind}, session long, frame long, track_id long, x1 double, y1 double, x2 double, y2 double, late boolean"
    return dets.select(key, "frame", "det_id", *BOX).groupBy(key).transformWithStateInPandas(processor, out, "Append", "ProcessingTime")


def append_infractions(df: DataFrame, path: str, checkpoint: str):
    """Incremental append with exactly-once files."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
