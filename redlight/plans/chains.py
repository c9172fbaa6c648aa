"""Whole analyses out of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detections, indicators, reads, tracks
from ..storage import materialize


def plate_pipeline(vehicles: DataFrame, plates: DataFrame, key: str = "camera") -> DataFrame:
    """Every frame of every car that had a plate read, with the car's best read.

    ``vehicles`` are detections (``det_id, frame`` and a box), ``plates`` read ones (``plate_id,
    frame``, a box, ``text, text_score``), both per ``key``. Vehicles are tracked, plates given
    to the track that contains them (the last of several in a frame), frames between the first
    and the last read filled in, and the text with the highest score told for all of them.
    """
    told = materialize(tracks.track(vehicles, key), "tracks")
    given = detections.assign_plates(plates, told, (key, "frame")).where("track_id > 0")
    one = detections.last_per_car_frame(given, [key, "frame", "track_id"]).select(key, "frame", "track_id", "text", "text_score")
    cars = told.join(one, [key, "frame", "track_id"]).withColumn("car_id", F.concat_ws("/", F.col(key).cast("string"), F.col("track_id").cast("string")))
    cars = materialize(cars, "cars")
    best = tracks.best_read_per_car(cars).select("car_id", key, "track_id", F.col("text").alias("best_text"), F.col("text_score").alias("best_score"), F.col("frame").alias("best_frame"))
    return tracks.interpolate_tracks(cars, "car_id").join(best, "car_id").drop("car_id")


def offline_analysis(found: DataFrame, identities: DataFrame, keys: list[str], pictures_quality: str | None = None) -> DataFrame:
    """Infractions of one run as records, one for each vehicle and plate.

    ``found`` are reads (``read_id, text, conf, t``, the run's ``keys``, what records need) and
    ``identities`` gives their ``vehicle_id``; reads without one are vehicles of their own. Of
    each vehicle the best read stays, then duplicate plates are resolved, and the rest become
    records with their defaults.
    """
    named = found.join(identities.select("read_id", "vehicle_id"), "read_id", "left").withColumn("vehicle_id", F.coalesce("vehicle_id", F.concat(F.lit("R"), F.col("read_id").cast("string"))))
    best = materialize(reads.best_per_vehicle(named, "vehicle_id"), "best-per-vehicle")
    kept = reads.best_per_group(best, reads.dup_classes(best, keys), vehicle=pictures_quality)
    return kept.withColumns({"plate": F.col("text"), "video_time": F.col("t")}).transform(indicators.to_record)
