"""Readers and writers of the engine's file formats. Missing files read as empty tables."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

INFRACTION = "placa string, fecha string, hora string, video_timestamp string, ubicacion string, franja_horaria string, tipo string, estado string, vehicle_path string, plate_path string, modo_nocturno boolean"
MOT = "frame int, track int, x double, y double, w double, h double, score double, c8 int, c9 int, c10 int"
PLATE_CSV = "frame_nmr long, car_id long, car_bbox string, license_plate_bbox string, license_plate_bbox_score double, license_number string, license_number_score double"


def _or_empty(spark: SparkSession, schema: str, read) -> DataFrame:
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_infractions(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array a file; a corrupt file gives no rows. Records are kept whatever fields
    they lack (see ``indicators.with_defaults``)."""
    read = lambda: spark.read.schema(INFRACTION + ", _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    out = _or_empty(spark, INFRACTION + ", _bad string", read)
    # The second part never holds; Spark wants another column read beside the corrupt record.
    return out.where("_bad is null or placa = _bad").drop("_bad")


def read_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A JSON object as rows ``camera, value``."""
    text = _or_empty(spark, "value string", lambda: spark.read.text(path, wholetext=True))
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("camera", "value"))


def read_camera_config(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """``avenue``, ``preset`` and ``polygon`` rows by camera."""
    area = read_map(spark, f"{folder}/polygon_config.json", "array<array<int>>")
    return {
        "avenue": read_map(spark, f"{folder}/avenue_config.json", "string").withColumnRenamed("value", "avenue"),
        "preset": read_map(spark, f"{folder}/time_presets.json", "struct<green:int,yellow:int,red:int,time_slot:string>").select("camera", "value.*"),
        "polygon": area.select("camera", F.transform("value", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("poly")),
    }


def read_mot(spark: SparkSession, root: str, phase: str = "train") -> DataFrame:
    """Detection files ``root/phase/<sequence>/det/det.txt``."""
    df = _or_empty(spark, MOT, lambda: spark.read.schema(MOT).csv(f"{root}/{phase}/*/det/det.txt"))
    return df.withColumn("seq", F.regexp_extract(F.input_file_name(), "/([^/]+)/det/det[.]txt", 1))


def parse_box(col) -> F.col:
    """``[a b c d]``, with or without brackets and with any blanks, to a struct of doubles."""
    bare = F.trim(F.regexp_replace(col, r"[\[\]]", ""))
    v = F.transform(F.split(bare, r"\s+"), lambda x: x.try_cast("double"))
    return F.when(F.size(v) == 4, F.struct(v[0].alias("x1"), v[1].alias("y1"), v[2].alias("x2"), v[3].alias("y2")))


def read_plate_csv(spark: SparkSession, path: str) -> DataFrame:
    df = _or_empty(spark, PLATE_CSV, lambda: spark.read.schema(PLATE_CSV).option("header", True).csv(path))
    return df.withColumns({"car_bbox": parse_box("car_bbox"), "license_plate_bbox": parse_box("license_plate_bbox")})


def box_text(c: str):
    return F.format_string("[%s %s %s %s]", *(F.col(f"{c}.{k}").cast("string") for k in ("x1", "y1", "x2", "y2")))


def write_plate_csv(df: DataFrame, path: str) -> None:
    """Rows that lack a car, a plate or a text are left out."""
    whole = df.dropna(subset=["car_id", "car_bbox", "license_plate_bbox", "license_number"])
    whole.withColumns({c: box_text(c) for c in ("car_bbox", "license_plate_bbox")}).select([f.split(" ")[0] for f in PLATE_CSV.split(", ")]).write.option("header", True).csv(path)


def mot_line(df: DataFrame) -> DataFrame:
    num = lambda c: F.format_string("%.2f", c)
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return df.withColumn("value", F.concat_ws(",", F.col("frame").cast("string"), F.col("track_id").cast("string"), num("x1"), num("y1"), num(w), num(h), F.lit("1,-1,-1,-1")))


def write_mot(df: DataFrame, path: str) -> None:
    """A folder of text files per sequence, ordered by frame within each file."""
    mot_line(df).repartition("seq").sortWithinPartitions("seq", "frame").select("seq", "value").write.partitionBy("seq").text(path)


def read_processing_times(spark: SparkSession, path: str) -> DataFrame:
    df = _or_empty(spark, "processing_times array<double>", lambda: spark.read.schema("processing_times array<double>").option("multiLine", True).json(path))
    return df.select(F.explode("processing_times").alias("seconds"))


def list_media(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """Files of the folder itself, in the order of their names."""
    read = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    files = _or_empty(spark, "path string, length long", read).withColumn("name", F.regexp_extract("path", "([^/]+)$", 1))
    return files.where(F.regexp_extract("path", "^(.*)/[^/]+$", 1).endswith(folder.rstrip("/").split(":", 1)[-1].lstrip("/"))).where(F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).isin([e.lower().lstrip(".") for e in extensions])).orderBy("name")


def write_media(files: DataFrame, folder: str) -> None:
    """Files ``name, data`` into ``folder``, which driver and executors share. A name is
    written whole again if its task is run again."""

    def work(batches):
        from pyarrow import fs as pfs

        fs, root = pfs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for b in batches:
            for name, data in zip(b["name"], b["data"]):
                with fs.open_output_stream(f"{root}/{name}") as f:
                    f.write(data)
            yield b[["name"]]

    files.select("name", "data").mapInPandas(work, "name string").write.format("noop").mode("overwrite").save()


def append_infractions(df: DataFrame, path: str, batch: int | str, key: list[str] | None = None) -> None:
    """Append as Parquet, as the rows of ``batch``: a batch that is written again takes the place
    of what it wrote before, so a run can be repeated and writers of different batches do not
    meet. With ``key`` only rows that no other batch has."""
    if key:
        empty = df.limit(0).withColumn("batch", F.lit(str(batch)))
        old = _or_empty(df.sparkSession, empty.schema.simpleString()[7:-1].replace(":", " "), lambda: read_stored(df.sparkSession, path))
        df = df.join(old.where(F.col("batch") != str(batch)).select(*key), key, "left_anti").select(*df.columns)
    out = df.withColumn("batch", F.lit(str(batch)))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`append_infractions` has stored, with ``batch`` as text."""
    return spark.read.parquet(path).withColumn("batch", F.col("batch").cast("string"))


def _png(data: bytes, height: int, width: int, channels: int) -> bytes:
    """A PNG file of 8-bit pixels: one channel, or blue, green, red."""
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)[..., ::-1].reshape(height, -1)
    lines = np.concatenate([np.zeros((height, 1), np.uint8), x], 1).tobytes()
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if channels == 1 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def write_pictures(images: DataFrame, folder: str) -> None:
    """Rows ``name, height, width, nChannels, data`` (the image source's layout, one or three
    channels) as PNG files."""
    def work(batches):
        for b in batches:
            yield pd.DataFrame({"name": b["name"], "data": [_png(*r) for r in zip(b["data"], b["height"], b["width"], b["nChannels"])]})

    write_media(images.select("name", "height", "width", "nChannels", "data").mapInPandas(work, "name string, data binary"), folder)


def read_pictures(spark: SparkSession, folder: str) -> DataFrame:
    """Picture files through Spark's image source: ``name, height, width, nChannels, data``;
    what is no picture gives no row."""
    read = spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*")
    return read.select(F.regexp_extract("origin", "([^/]+)$", 1).alias("name"), "height", "width", "nChannels", "data")


def export(df: DataFrame, path: str, fmt: str = "json") -> None:
    """The full schema in either format."""
    (df.write.json(path) if fmt == "json" else df.write.option("header", True).csv(path))


def write_report(report: DataFrame, path: str) -> None:
    report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def upsert_config(old: DataFrame, new: DataFrame, key: str = "camera") -> DataFrame:
    """Last write wins."""
    return old.join(new, key, "left_anti").select(*new.columns).unionByName(new)


def delete_camera(configs: dict[str, DataFrame], cameras: DataFrame) -> dict[str, DataFrame]:
    return {k: df.join(cameras, "camera", "left_anti") for k, df in configs.items()}


def pending(inputs: DataFrame, outputs: DataFrame, name: str = "name") -> DataFrame:
    return inputs.join(outputs.select(name), name, "left_anti")


def validate_config(df: DataFrame):
    """Rows with ``errors``: numbers parse, location and slot are given, three vertices."""
    bad = lambda cond, text: F.when(~F.coalesce(cond, F.lit(False)), text)
    checks = [bad(F.col(c).try_cast("int").isNotNull(), c) for c in ("green", "yellow", "red")]
    checks += [bad(F.trim(c) != "", c) for c in ("avenue", "time_slot")] + [bad(F.size("poly") >= 3, "poly")]
    return df.withColumn("errors", F.array_compact(F.array(*checks)))
