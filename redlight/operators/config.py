"""Joins with camera configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULTS = {"avenue": "Desconocida", "time_slot": "No especificada", "green": 12, "yellow": 2, "red": 10}


def enrich(df: DataFrame, avenues: DataFrame, presets: DataFrame) -> DataFrame:
    """Location and signal times by camera, defaults where there is no configuration. Spark
    broadcasts these sides where their size allows."""
    out = df.join(avenues.select("camera", "avenue"), "camera", "left").join(presets.select("camera", "green", "yellow", "red", "time_slot"), "camera", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items()})


def configured(avenues: DataFrame, presets: DataFrame, areas: DataFrame) -> DataFrame:
    """Cameras that have all three, the area with three vertices at least."""
    return avenues.select("camera").join(presets, "camera", "left_semi").join(areas.where(F.size("poly") >= 3), "camera", "left_semi")
