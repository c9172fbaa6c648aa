"""The registered queries of the enforcement engine, each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import plates as p
from ..operators import config, detections, identity, images, indicators, picture_dups, reads, tracks
from ..sources import io
from ..storage import new_path
from ..streaming import live
from . import chains
from . import sqltext as s
from .views import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
W, H = 340, 260


def add(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = with_views(sql)
        return f

    return keep


def over(view_name: str, name: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """A query over one fixture view."""
    add(name, sql)(lambda spark, d, v=view_name, f=f: f(view(spark, d, v)))


def r4(c) -> F.col:
    return F.round(c, 4)


BOX = ["x1", "y1", "x2", "y2"]
INFRACTIONS_SQL = f"""SELECT d.*, {s.state()} AS state FROM v_det d JOIN v_preset p USING (camera) JOIN v_area a USING (camera)
WHERE class_id IN (2, 5, 7) AND score >= 0.4 AND {s.state()} = 'red' AND {s.inside('floor((x1 + x2) / 2)', 'y2')}"""

# --- filters and projections ---------------------------------------------------------------
over("v_det", "f01_vehicle_classes", lambda d: detections.vehicles(d).groupBy("camera").agg(F.count("*").alias("n")), "SELECT camera, count(*) AS n FROM v_det WHERE class_id IN (2, 5, 7) GROUP BY camera")
over("v_det", "f02_confidence", lambda d: detections.confident(d, "vehicle", F.col("camera") % 2 == 0).select("det_id", "score"), "SELECT det_id, score FROM v_det WHERE score >= CASE WHEN camera % 2 = 0 THEN 0.25 ELSE 0.40 END")
over("v_det", "f03_plate_shaped", lambda d: d.where(g.plate_shaped(g.box())).select("det_id"), "SELECT det_id FROM v_det WHERE (x2 - x1) / nullif(y2 - y1, 0) BETWEEN 1.5 AND 6.0")
over("v_det", "f04_pad_clip", lambda d: d.select("det_id", *(v.cast("double").alias(k) for k, v in g.pad_clip(g.box(), W, H).items())), f"""SELECT det_id, greatest(0, x1 - px)::DOUBLE AS x1, greatest(0, y1 - py)::DOUBLE AS y1, least({W}, x2 + px)::DOUBLE AS x2, least({H}, y2 + py)::DOUBLE AS y2
FROM (SELECT *, greatest(1, trunc((x2 - x1) * 0.05::DOUBLE)) AS px, greatest(1, trunc((y2 - y1) * 0.15::DOUBLE)) AS py FROM v_det)""")
over("v_det", "f05_rescale", lambda d: d.select("det_id", *(v.alias(k) for k, v in g.rescale(g.box(), 0.75, 1.5).items())), "SELECT det_id, trunc(x1 * 0.75)::BIGINT AS x1, trunc(y1 * 1.5)::BIGINT AS y1, trunc(x2 * 0.75)::BIGINT AS x2, trunc(y2 * 1.5)::BIGINT AS y2 FROM v_det")
over("v_det", "f06_expand_roi", lambda d: d.select("det_id", *(v.cast("double").alias(k) for k, v in g.expand_roi(g.box(), W, H, F.col("camera") > 4).items())), f"""SELECT det_id, greatest(0, x1 - dx)::DOUBLE AS x1, greatest(0, y1 - dy)::DOUBLE AS y1, least({W}, x2 + dx)::DOUBLE AS x2, least({H}, y2 + dy)::DOUBLE AS y2
FROM (SELECT *, trunc((x2 - x1) * f) AS dx, trunc((y2 - y1) * f) AS dy FROM (SELECT *, CASE WHEN camera > 4 THEN 0.15::DOUBLE ELSE 0.10::DOUBLE END AS f FROM v_det))""")
over("v_det", "f07_context_box", lambda d: d.select("det_id", *(v.cast("double").alias(k) for k, v in g.context_box(g.box(), W, H).items())), f"""SELECT det_id, l AS x1, t AS y1, least({W}, l + w)::DOUBLE AS x2, least({H}, t + h)::DOUBLE AS y2 FROM (SELECT *, greatest(0, floor((x1 + x2) / 2) - floor(w / 2))::DOUBLE AS l, greatest(0, floor((y1 + y2) / 2) - floor(h / 2))::DOUBLE AS t
FROM (SELECT *, trunc((x2 - x1) * 2.5) AS w, trunc((y2 - y1) * 2.5) AS h FROM v_det))""")
over("v_det", "f08_box_forms", lambda d: d.select("det_id", *(v.alias(k) for k, v in g.box_to_z(g.box()).items())).select("det_id", "area", *(r4(v).alias(k) for k, v in g.z_to_box("cx", "cy", "area", "ratio").items())), "SELECT det_id, (x2 - x1) * (y2 - y1) AS area, round(x1, 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(y2, 4) AS y2 FROM v_det")
over("v_det", "f09_size_guard", lambda d: d.select("det_id", g.size_guard(g.box(), 50, 80).alias("marker")), "SELECT det_id, CASE WHEN y2 - y1 < 50 OR x2 - x1 < 80 THEN 'NO_PLATE_SMALL' END AS marker FROM v_det")
over("v_reads", "f10_valid_length", lambda d: d.where(p.valid_length("text", 6)).select("read_id"), f"SELECT read_id FROM v_reads WHERE length({s.BARE.format('text')}) <= 6")
over("v_reads", "f11_not_blocked", lambda d: reads.not_blocked(d, ["AB", "B07"]).select("read_id"), "SELECT read_id FROM v_reads WHERE NOT contains(regexp_replace(upper(text), '[ -]', '', 'g'), 'AB') AND NOT contains(regexp_replace(upper(text), '[ -]', '', 'g'), 'B07')")
_DAY = "try_strptime(fecha, '%d/%m/%Y')"
over("v_inf", "f12_dates_strict", lambda d: indicators.between_dates(d, "1994-01-01", "1995-06-30").select("inf_id"), f"SELECT inf_id FROM v_inf WHERE {_DAY} BETWEEN '1994-01-01'::TIMESTAMP AND '1995-06-30'::TIMESTAMP")
over("v_inf", "f13_dates_lenient", lambda d: indicators.between_dates(d, "1994-01-01", "1995-06-30", True).select("inf_id"), f"SELECT inf_id FROM v_inf WHERE {_DAY} IS NULL OR {_DAY} BETWEEN '1994-01-01'::TIMESTAMP AND '1995-06-30'::TIMESTAMP")
over("v_reads", "f14_usable_reads", lambda d: reads.usable_reads(d, 0.6).select("read_id", "text"), f"SELECT read_id, {s.BARE.format('upper(text)')} AS text FROM v_reads WHERE conf > 0.6")
over("v_det", "f15_sample_frames", lambda d: detections.sample_frames(d, 12.0, start=F.lit(4)).select("det_id"), "SELECT det_id FROM v_det WHERE (frame - 4) % 4 = 0")
over("v_det", "f16_direct_read_frames", lambda d: detections.direct_read_frames(d.withColumn("red_start", F.lit(3))).select("det_id"), "SELECT det_id FROM v_det WHERE (frame - 3 + 1) % 10 = 0")
over("v_inf", "f17_defaults", lambda d: indicators.with_defaults(d).select("inf_id", "placa", "ubicacion"), "SELECT inf_id, coalesce(placa, 'No identificada') AS placa, coalesce(ubicacion, 'Desconocida') AS ubicacion FROM v_inf")
over("v_hist", "f18_to_record", lambda d: indicators.to_record(d.select(F.col("plate_key").cast("string").alias("plate"), F.col("ts").alias("event_ts"), F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 4000).alias("video_time"), F.lit(None).cast("string").alias("ubicacion"), F.lit("tarde").alias("franja_horaria"))).drop("modo_nocturno"), """SELECT plate_key::VARCHAR AS placa, strftime(ts, '%d/%m/%Y') AS fecha, strftime(ts, '%H:%M:%S') AS hora,
coalesce(lpad((floor(v / 60))::BIGINT::VARCHAR, 2, '0') || ':' || lpad((v % 60)::VARCHAR, 2, '0'), '00:00') AS video_timestamp, 'Desconocida' AS ubicacion, 'tarde' AS franja_horaria, 'Semáforo en rojo' AS tipo, 'Pendiente' AS estado
FROM (SELECT *, CASE WHEN event_id % 5 > 0 THEN event_id % 4000 END AS v FROM v_hist)""")
over("v_det", "f19_video_time", lambda d: d.select("det_id", r4(g.video_time("frame", 25.0)).alias("t"), r4(g.video_time("frame", 25.0, True)).alias("live_t")), "SELECT det_id, round(frame / 25.0::DOUBLE, 4) AS t, round(frame / 30.0::DOUBLE, 4) AS live_t FROM v_det")
over("v_reads", "f21_second_pass", lambda d: reads.second_pass(d.withColumn("pass", F.when(F.col("read_id") % 2 == 0, 1).otherwise(2)).withColumn("adj", F.col("conf") - 0.2)).select("read_id", "relax"), """WITH a AS (SELECT *, CASE WHEN read_id % 2 = 0 THEN 1 ELSE 2 END AS pass, conf - 0.2::DOUBLE AS adj FROM v_reads),
b AS (SELECT crop_id, max(adj) AS best FROM a WHERE pass = 1 GROUP BY crop_id), k AS (SELECT a.* FROM a LEFT JOIN b USING (crop_id) WHERE pass = 1 OR best IS NULL OR best < 0.5)
SELECT read_id, count(*) OVER (PARTITION BY crop_id) < 2 AS relax FROM k""")
over("v_reads", "f22_first_usable", lambda d: reads.first_usable(d.select("read_id", F.when(F.col("read_id") % 3 == 0, F.substring("text", 1, 3)).alias("direct"), F.when(F.col("read_id") % 2 == 0, F.col("text")).alias("classic"), F.lit("ALT0").alias("other")), ["direct", "classic", "other"]).select("read_id", "text", "source"), """SELECT read_id, CASE WHEN read_id % 2 = 0 AND length(text) >= 4 THEN text ELSE 'ALT0' END AS text, CASE WHEN read_id % 2 = 0 AND length(text) >= 4 THEN 'classic' ELSE 'other' END AS source FROM v_reads""")
_BASE_BOX = "SELECT det_id, x1, y1, x2, y2 FROM v_det"


@add("f23_boxes_or_default", """SELECT det_id, CASE WHEN det_id % 3 = 0 THEN 'detector' WHEN det_id % 2 = 0 THEN 'region' ELSE 'default' END AS source,
round(CASE WHEN det_id % 3 = 0 THEN x1 + 1 WHEN det_id % 2 = 0 THEN x1 + 2 ELSE x1 + (x2 - x1) * 0.2 END, 4) AS x1, round(CASE WHEN det_id % 3 = 0 OR det_id % 2 = 0 THEN y2 ELSE y1 + (y2 - y1) * 0.95 END, 4) AS y2 FROM v_det""")
def f23(spark, d):
    det = view(spark, d, "v_det").select("det_id", *BOX)
    shifted = lambda n: det.withColumn("x1", F.col("x1") + n)
    out = detections.boxes_or_default(det, shifted(1).where("det_id % 3 = 0"), shifted(2).where("det_id % 2 = 0"), "det_id")
    return out.select("det_id", "source", r4("x1").alias("x1"), r4("y2").alias("y2"))


over("v_det", "f24_pad_fixed", lambda d: d.select("det_id", *(v.cast("double").alias(k) for k, v in g.pad_fixed(g.box(), 200, 150).items())), """SELECT det_id, CASE WHEN ok THEN a ELSE 0 END AS x1, CASE WHEN ok THEN b ELSE 0 END AS y1, CASE WHEN ok THEN c ELSE 0 END AS x2, CASE WHEN ok THEN e ELSE 0 END AS y2
FROM (SELECT *, c > a AND e > b AS ok FROM (SELECT det_id, greatest(0, x1 - 5)::DOUBLE AS a, greatest(0, y1 - 5)::DOUBLE AS b, least(200, x2 + 5)::DOUBLE AS c, least(150, y2 + 5)::DOUBLE AS e FROM v_det))""")


@add("f20_validate_config", """SELECT s_suppkey AS camera, (CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END)::INT AS n_errors FROM supplier""")
def f20(spark, d):
    rows = spark.read.parquet(f"{d}/supplier.parquet").select(
        F.col("s_suppkey").alias("camera"), F.when(F.col("s_suppkey") % 4 == 0, "x").otherwise("10").alias("green"), F.lit("2").alias("yellow"), F.lit("8").alias("red"),
        F.when(F.col("s_suppkey") % 5 == 0, " ").otherwise("Av").alias("avenue"), F.lit("tarde").alias("time_slot"), F.sequence(F.lit(1), F.when(F.col("s_suppkey") % 2 == 0, 2).otherwise(3)).alias("poly"),
    )
    return io.validate_config(rows).select("camera", F.size("errors").alias("n_errors"))


# --- configuration -------------------------------------------------------------------------
@add("j01_enrich", """SELECT det_id, coalesce(avenue, 'Desconocida') AS avenue, coalesce(green, 12)::BIGINT AS green, coalesce(red, 10)::BIGINT AS red, coalesce(time_slot, 'No especificada') AS time_slot FROM v_det LEFT JOIN v_avenue USING (camera) LEFT JOIN v_preset USING (camera)""")
def j01(spark, d):
    out = config.enrich(view(spark, d, "v_det"), view(spark, d, "v_avenue"), view(spark, d, "v_preset"))
    return out.select("det_id", "avenue", F.col("green").cast("long").alias("green"), F.col("red").cast("long").alias("red"), "time_slot")


@add("j02_configured", "SELECT camera FROM v_avenue WHERE camera IN (SELECT camera FROM v_preset) AND camera IN (SELECT camera FROM v_area WHERE len(poly) >= 3)")
def j02(spark, d):
    return config.configured(*(view(spark, d, v) for v in ("v_avenue", "v_preset", "v_area")))


@add("s12_upsert_config", "SELECT camera, avenue FROM v_avenue WHERE camera % 3 <> 0 UNION ALL SELECT s_suppkey AS camera, 'nueva' AS avenue FROM supplier WHERE s_suppkey < 12 AND s_suppkey % 3 = 0")
def s12(spark, d):
    new = spark.read.parquet(f"{d}/supplier.parquet").where("s_suppkey < 12 and s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("camera"), F.lit("nueva").alias("avenue"))
    return io.upsert_config(view(spark, d, "v_avenue"), new)


@add("s13_delete_camera", "SELECT camera, 'avenue' AS config FROM v_avenue WHERE camera % 4 <> 1 UNION ALL SELECT camera, 'preset' FROM v_preset WHERE camera % 4 <> 1")
def s13(spark, d):
    gone = view(spark, d, "v_avenue").where("camera % 4 = 1").select("camera")
    left = io.delete_camera({"avenue": view(spark, d, "v_avenue"), "preset": view(spark, d, "v_preset")}, gone)
    return left["avenue"].select("camera", F.lit("avenue").alias("config")).unionByName(left["preset"].select("camera", F.lit("preset").alias("config")))


@add("s14_pending", "SELECT doc_id AS name FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def s14(spark, d):
    return io.pending(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("name")), spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("name")))


@add("s04_parse_boxes", "SELECT car_id, frame, x1, y2 FROM v_track")
def s04(spark, d):
    t = view(spark, d, "v_track")
    text = F.when(F.col("frame") % 2 == 0, F.concat(F.lit("["), F.concat_ws("  ", *(F.col(c).cast("string") for c in BOX)), F.lit("]"))).otherwise(F.concat_ws(" ", *(F.col(c).cast("string") for c in BOX)))
    return t.withColumn("b", io.parse_box(text)).select("car_id", "frame", "b.x1", "b.y2")


# --- joins ---------------------------------------------------------------------------------
@add("j03_assign_plates", """WITH t AS (SELECT * FROM v_det WHERE class_id <> 3), pl AS (SELECT det_id AS plate_id, camera, frame, x1 + 10 AS x1, y1 + 5 AS y1, x1 + 20 AS x2, y1 + 10 AS y2 FROM v_det WHERE class_id IN (3, 7))
SELECT plate_id, coalesce((SELECT max(t.det_id) FROM t WHERE t.camera = pl.camera AND t.frame = pl.frame AND pl.x1 > t.x1 AND pl.y1 > t.y1 AND pl.x2 < t.x2 AND pl.y2 < t.y2), -1) AS track_id FROM pl""")
def j03(spark, d):
    det = view(spark, d, "v_det")
    plates = det.where("class_id in (3, 7)").selectExpr("det_id as plate_id", "camera", "frame", "x1 + 10 as x1", "y1 + 5 as y1", "x1 + 20 as x2", "y1 + 10 as y2")
    return detections.assign_plates(plates, det.where("class_id <> 3").withColumnRenamed("det_id", "track_id")).select("plate_id", "track_id")


over("v_det", "j04_iou_pairs", lambda d: detections.iou_pairs(d, ["camera", "frame"]).select("a", "b", r4("iou").alias("iou")), f"SELECT a.det_id AS a, b.det_id AS b, round({s.iou('a.', 'b.')}, 4) AS iou FROM v_det a JOIN v_det b ON a.camera = b.camera AND a.frame = b.frame AND a.det_id < b.det_id WHERE {s.iou('a.', 'b.')} > 0")
over("v_det", "j04_iou_plain", lambda d: d.select("det_id", r4(g.iou(g.box(), (F.lit(50.0), F.lit(40.0), F.lit(200.0), F.lit(160.0)), False)).alias("iou")), f"SELECT det_id, round({s.iou('d.', 'r.')}, 4) AS iou FROM v_det d, (SELECT 50.0::DOUBLE AS x1, 40.0::DOUBLE AS y1, 200.0::DOUBLE AS x2, 160.0::DOUBLE AS y2) r")


def area_query(mode: str, name: str, points: list[tuple[str, str]], poly: str = "poly") -> None:
    cond = " OR ".join(s.inside(x, y, "q") for x, y in points)
    sql = f"SELECT det_id FROM (SELECT d.*, {poly} AS q FROM v_det d JOIN v_area USING (camera)) WHERE {cond}"
    add(name, sql)(lambda spark, d: detections.with_area(view(spark, d, "v_det"), view(spark, d, "v_area"), mode).where("inside").select("det_id"))


_MID = ("floor((x1 + x2) / 2)", "floor((y1 + y2) / 2)")
area_query("day", "j06_in_area_day", [(_MID[0], "y2")])
area_query("night", "j07_in_area_night", [(_MID[0], "y2"), _MID], s.scaled())
area_query("live_day", "j08_in_area_live_day", [_MID, ("floor((x1 + x2 * 3) / 4)", _MID[1]), ("floor((x1 * 3 + x2) / 4)", _MID[1]), ("x1", "y1"), ("x2", "y1"), ("x1", "y2"), ("x2", "y2")])
_QX, _QY = "floor((x2 - x1) / 4)", "floor((y2 - y1) / 4)"
area_query("live_night", "j09_in_area_live_night", [_MID, *((x, y) for y in (f"(y1 + {_QY})", _MID[1], f"(y2 - {_QY})", "y2") for x in (f"(x1 + {_QX})", _MID[0], f"(x2 - {_QX})"))])


@add("j05_point_in_polygon", f"SELECT det_id, camera, {s.inside('x1', 'y1')} AS inside FROM v_det JOIN v_area USING (camera)")
def j05(spark, d):
    det = view(spark, d, "v_det").join(view(spark, d, "v_area"), "camera")
    return det.select("det_id", "camera", g.point_in_polygon("x1", "y1", "poly").alias("inside"))


@add("j10_phase", f"SELECT det_id, {s.state()} AS state, floor(frame / (green + yellow + red))::BIGINT AS segment, (floor(frame / (green + yellow + red)) * (green + yellow + red) + green + yellow)::BIGINT AS red_start FROM v_det JOIN v_preset p USING (camera)")
def j10(spark, d):
    return detections.with_phase(view(spark, d, "v_det"), view(spark, d, "v_preset")).select("det_id", "state", "segment", "red_start")


def red_light(spark: SparkSession, d: str) -> DataFrame:
    return detections.infractions(view(spark, d, "v_det"), view(spark, d, "v_preset"), view(spark, d, "v_area"))


@add("j11_infractions", f"SELECT det_id, camera, frame FROM ({INFRACTIONS_SQL})")
def j11(spark, d):
    return red_light(spark, d).select("det_id", "camera", "frame")


@add("e1_infractions_by_camera_day", f"SELECT camera, ts::DATE AS day, count(*) AS n FROM ({INFRACTIONS_SQL}) i JOIN events e ON e.event_id = i.det_id GROUP BY ALL")
def flagship(spark, d):
    """Red-light infractions per camera and day."""
    days = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("det_id"), F.to_date("ts").alias("day"))
    return red_light(spark, d).join(days, "det_id").groupBy("camera", "day").agg(F.count("*").alias("n"))


# --- plate texts ---------------------------------------------------------------------------
UP = "upper(trim(text))"
over("v_reads", "x01_clean_plate", lambda d: d.select("read_id", p.clean_plate("text").alias("clean"), p.clean_plate("text", True).alias("with_hyphen")), f"SELECT read_id, {s.BARE.format('upper(text)')} AS clean, regexp_replace(upper(text), '[^A-Z0-9-]', '', 'g') AS with_hyphen FROM v_reads")
over("v_reads", "x02_format_7", lambda d: d.select("read_id", F.concat(p.clean_plate("text"), F.lit("5")).alias("t")).select("read_id", p.complies_7("t").alias("ok"), F.when(p.complies_7("t"), p.format_7("t")).alias("plate")), f"""SELECT read_id, ok, CASE WHEN ok THEN translate(t[1:2], '013465', 'OIJAGS') || translate(t[3:4], 'OIJAGS', '013465') || translate(t[5:7], '013465', 'OIJAGS') END AS plate
FROM (SELECT *, regexp_full_match(t, '[A-Z013456]{{2}}[0-9OIJAGS]{{2}}[A-Z013456]{{3}}') AS ok FROM (SELECT read_id, {s.BARE.format('upper(text)')} || '5' AS t FROM v_reads))""")
over("v_reads", "x03_valid_format", lambda d: d.select("read_id", p.valid_format(F.upper(F.trim("text"))).alias("ok")), f"SELECT read_id, {s.valid(UP)} AS ok FROM v_reads")
_SHAPES = ", ".join(f"'{x}'" for x in p.SHAPES)
_CL = s.BARE.format("upper(text)")
over("v_reads", "x04_valid_plate", lambda d: d.select("read_id", p.valid_plate("text", prefixes=["AB", "BK"]).alias("ok"), p.valid_plate("text", True, known=["AB1234"]).alias("night")), f"""SELECT read_id, length(text) >= 4 AND length(c) BETWEEN 4 AND 8 AND {s.letters('c')} >= 1 AND {s.digits('c')} >= 2 AND ({s.pattern('c')} IN ({_SHAPES}) OR starts_with(c, 'AB') OR starts_with(c, 'BK')) AS ok,
length(text) >= 4 AND length(c) BETWEEN 3 AND 9 AND {s.letters('c')} >= 1 AND {s.digits('c')} >= 1 AND ({s.matches('c', "'AB1234'")} >= least(4, length(c), 6) OR {s.pattern('c')} IN ({_SHAPES}) OR regexp_matches(c, '^[A-Z]{{1,2}}[0-9]{{2,4}}') OR regexp_matches(c, '^[0-9]{{3,4}}[A-Z]{{1,2}}')) AS night
FROM (SELECT *, {_CL} AS c FROM v_reads)""")
over("v_reads", "x05_pattern_key", lambda d: d.select("read_id", p.pattern_key("text").alias("pattern")), f"SELECT read_id, {s.pattern('text')} AS pattern FROM v_reads")
over("v_reads", "x06_pattern_similarity", lambda d: d.select("read_id", r4(p.pattern_similarity(p.pattern_key("text"), F.lit("LL-NNNN"))).alias("similarity")), f"SELECT read_id, round({s.similar(s.pattern('text'), chr(39) + 'LL-NNNN' + chr(39))}, 4) AS similarity FROM v_reads")
over("v_reads", "x07_pattern_coherence", lambda d: d.select("read_id", r4(p.pattern_coherence(F.upper(F.trim("text")))).alias("coherence")), f"SELECT read_id, round({s.coherence('t')}, 4) AS coherence FROM (SELECT read_id, {UP} AS t FROM v_reads)")
over("v_reads", "x08_format_break", lambda d: d.select("read_id", p.format_break(F.trim("text")).alias("cut")), """WITH t AS (SELECT read_id, trim(text) AS t FROM v_reads), u AS (SELECT *, [i FOR i IN range(2, length(t) + 1) IF (regexp_matches(t[i - 1], '[A-Za-z]') AND regexp_matches(t[i], '[0-9]')) OR (regexp_matches(t[i - 1], '[0-9]') AND regexp_matches(t[i], '[A-Za-z]'))] AS c,
length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS l, [i FOR i IN range(1, length(t) + 1) IF regexp_matches(t[i], '[0-9]')] AS d FROM t)
SELECT read_id, (CASE WHEN length(t) = 0 THEN 0 WHEN len(c) > 0 THEN c[1] - 1 WHEN l > 0 AND l < length(t) AND l <= floor(length(t) / 2) THEN l WHEN l > 0 AND l < length(t) AND len(d) > 0 THEN d[1] - 1 ELSE floor(length(t) / 2) END)::INT AS cut FROM u""")
over("v_reads", "x09_context_correct", lambda d: d.select("read_id", p.context_correct(p.clean_plate("text", True)).alias("text")), s.context("v_reads"))
over("v_reads", "x10_split_correct", lambda d: d.select("read_id", p.split_correct(F.upper(F.trim("text"))).alias("text")), f"""WITH t AS (SELECT read_id, {UP} AS t FROM v_reads), c AS (SELECT *, CASE WHEN contains(t, '-') THEN instr(t, '-') - 1 ELSE 3 END AS k FROM t),
e AS (SELECT read_id, translate(substr(t, 1, k), '012584', 'OIZSBA') || translate(substr(t, k + 1), 'OIZSBA', '012584') AS r FROM c)
SELECT read_id, CASE WHEN length(r) = 6 AND NOT contains(r, '-') AND {s.letters('r[1:3]')} >= 2 AND {s.digits('r[4:6]')} >= 2 THEN r[1:3] || '-' || r[4:6] ELSE r END AS text FROM e""")
over("v_reads", "x11_region_normalise", lambda d: d.select("read_id", p.region_normalise("text").alias("plate")), s.region("v_reads"))
_SCORE = """round((CASE WHEN n > 8 THEN -100 WHEN n BETWEEN 5 AND 7 THEN 5 WHEN n BETWEEN 4 AND 8 THEN 3 ELSE 1 END
+ CASE WHEN regexp_full_match(text, '[A-Z]{2}-[0-9]{4}') THEN 8 WHEN regexp_full_match(text, '[A-Z]{3}-[0-9]{4}') THEN 5 WHEN regexp_full_match(text, '[A-Z]-[0-9]{4,5}') THEN 4 WHEN contains(text, '-') THEN 2 ELSE 0 END
- 2 * length(regexp_replace(text, '[A-Za-z0-9-]', '', 'g')) - CASE WHEN contains(text, 'L') AND contains(text, 'I') THEN 1 ELSE 0 END - CASE WHEN contains(text, 'O') AND contains(text, '0') THEN 1 ELSE 0 END - CASE WHEN contains(text, 'S') AND contains(text, '5') THEN 1 ELSE 0 END - CASE WHEN contains(text, 'B') AND contains(text, '8') THEN 1 ELSE 0 END
+ CASE WHEN regexp_full_match(text, '[^-]*-[0-9]+') THEN 2 ELSE 0 END - EXTRA)::DOUBLE + least(5.0, sharpness / 100), 4)"""
over("v_reads", "x12_detection_score", lambda d: d.select("read_id", r4(p.detection_score("text", "sharpness", ["AX"], {"AB-": 2})).alias("score")), f"""SELECT read_id, {_SCORE.replace('- EXTRA', '- CASE WHEN contains(text, \'AX\') THEN 100 ELSE 0 END + CASE WHEN starts_with(text, \'AB-\') THEN 2 ELSE 0 END')} AS score FROM (SELECT *, length(regexp_replace(text, '[- ]', '', 'g')) AS n FROM v_reads)""")
_FORM = "(CASE WHEN regexp_full_match(text, '[A-Z]+-[0-9]+') THEN 1.0 WHEN regexp_full_match(text, '[A-Z]+[0-9]+') THEN 0.8 WHEN regexp_full_match(text, '[0-9]+-[A-Z]+') THEN 0.7 WHEN contains(text, '-') THEN 0.5 ELSE 0 END + CASE WHEN length(text) BETWEEN 6 AND 8 THEN 0.1 ELSE 0 END)::DOUBLE"
over("v_reads", "x13_quality_score", lambda d: d.select("read_id", r4(p.quality_score("text", "conf", F.col("conf") - 0.4)).alias("quality")), f"""WITH q AS (SELECT *, conf - 0.4::DOUBLE AS v, {_FORM} AS f FROM v_reads)
SELECT read_id, round((0.4 * conf + 0.2 * v + 0.2 * f + 0.1 * CASE WHEN regexp_full_match(text, '[A-Z]{{2,3}}-[0-9]{{3,4}}') THEN 0.9 WHEN regexp_full_match(text, '[A-Z]-[0-9]{{3,5}}') THEN 0.8 WHEN regexp_full_match(text, '[0-9]{{3,4}}-[A-Z]{{2,3}}') THEN 0.7 ELSE 0 END
+ 0.1 * CASE WHEN conf > 0.5 AND v > 0.5 AND f > 0.5 THEN 0.8 WHEN conf < 0.3 OR v < 0.3 THEN 0.2 ELSE 0 END)::DOUBLE * CASE WHEN length(text) NOT BETWEEN 4 AND 10 THEN 0.7::DOUBLE ELSE 1 END, 4) AS quality FROM q""")
#: Quality without a picture of the vehicle.
_QUALITY = f"""round((0.4 * conf + 0.2 * {_FORM} + 0.1 * CASE WHEN regexp_full_match(text, '[A-Z]{{2,3}}-[0-9]{{3,4}}') THEN 0.9 WHEN regexp_full_match(text, '[A-Z]-[0-9]{{3,5}}') THEN 0.8 WHEN regexp_full_match(text, '[0-9]{{3,4}}-[A-Z]{{2,3}}') THEN 0.7 ELSE 0 END)::DOUBLE
* CASE WHEN length(text) NOT BETWEEN 4 AND 10 THEN 0.7::DOUBLE ELSE 1 END, 9)"""
_PAIRS = "WITH p AS (SELECT a.read_id, a.text AS a, b.text AS b, a.t - b.t AS dt FROM v_reads a JOIN v_reads b ON b.read_id = a.read_id + 1)"


def pairs(d: DataFrame) -> DataFrame:
    """Each read with the next one."""
    return d.select("read_id", F.col("text").alias("a"), F.col("t").alias("ta")).join(d.select((F.col("read_id") - 1).alias("read_id"), F.col("text").alias("b"), F.col("t").alias("tb")), "read_id").withColumn("dt", F.col("ta") - F.col("tb"))


over("v_reads", "x14_plate_similarity", lambda d: pairs(d).select("read_id", r4(p.plate_similarity("a", "b")).alias("similarity")), _PAIRS + """, q AS (SELECT *, upper(regexp_replace(a, '-', '', 'g')) AS x, upper(regexp_replace(b, '-', '', 'g')) AS y FROM p)
SELECT read_id, round(CASE WHEN x = y THEN 1 WHEN abs(length(x) - length(y)) > 2 THEN 0 ELSE least(1, 1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)) + 0.1 * len([1 FOR i IN range(1, least(length(x), length(y)) + 1) IF x[i] <> y[i] AND translate(x[i], 'OISBZ', '01582') = translate(y[i], 'OISBZ', '01582')])::DOUBLE / greatest(1, least(length(x), length(y)))
+ CASE WHEN regexp_replace(regexp_replace(x, '[A-Za-z]', 'L', 'g'), '[0-9]', 'N', 'g') = regexp_replace(regexp_replace(y, '[A-Za-z]', 'L', 'g'), '[0-9]', 'N', 'g') THEN 0.2 ELSE 0 END) END::DOUBLE, 4) AS similarity FROM q""")
over("v_reads", "x15_text_similar", lambda d: pairs(d).select("read_id", p.text_similar("a", "b").alias("similar")), _PAIRS + f""", q AS (SELECT *, regexp_replace(a, '-', '', 'g') AS x, regexp_replace(b, '-', '', 'g') AS y FROM p),
r AS (SELECT *, abs(length(x) - length(y)) AS gap, len([1 FOR i IN range(1, least(length(x), length(y)) + 1) IF x[i] <> y[i] AND len([1 FOR e IN {p.EQUIVALENT} IF contains(e, x[i]) AND contains(e, y[i])]) = 0]) AS other FROM q)
SELECT read_id, CASE WHEN a = b OR contains(x, y) OR contains(y, x) THEN true WHEN gap > 2 THEN false WHEN {s.similar(s.pattern('x'), s.pattern('y'))} > 0.8 THEN true ELSE other + gap <= least(2, floor(greatest(length(x), length(y)) / 3)) END AS similar FROM r""")
over("v_reads", "x16_dup_text_similarity", lambda d: pairs(d).select("read_id", r4(p.dup_text_similarity("a", "b")).alias("similarity")), _PAIRS + f""", q AS (SELECT *, upper(regexp_replace(a, '[- ]', '', 'g')) AS x, upper(regexp_replace(b, '[- ]', '', 'g')) AS y FROM p), r AS (SELECT *, {s.run('x')} AS m, {s.run('y')} AS n FROM q),
u AS (SELECT *, coalesce(list_max([i FOR i IN range(1, least(length(m), length(n)) + 1) IF right(m, i) = right(n, i)]), 0) AS k FROM r),
v AS (SELECT *, CASE WHEN least(length(m), length(n)) >= 3 AND m = n THEN 0.85 WHEN least(length(m), length(n)) >= 3 AND k >= 3 THEN 0.6 + k::DOUBLE / greatest(length(m), length(n)) * 0.3 ELSE 0 END AS z FROM u)
SELECT read_id, round(CASE WHEN x = y THEN 1 WHEN z < 0.8 AND {s.fold('x')} = {s.fold('y')} THEN 0.85 ELSE z END::DOUBLE, 4) AS similarity FROM v""")
over("v_reads", "x17_time_similarity", lambda d: pairs(d).select("read_id", r4(p.time_similarity("dt")).alias("similarity")), _PAIRS + " SELECT read_id, round(CASE WHEN abs(dt) < 5 THEN 1 - abs(dt) / 5 ELSE 0 END::DOUBLE, 4) AS similarity FROM p")
over("v_reads", "x18_fused_similarity", lambda d: d.select("read_id", r4(p.fused_similarity(F.col("conf") - 0.3, F.when(F.col("read_id") % 4 == 0, 0.0).otherwise(F.col("read_id") % 10 / 10), F.when(F.col("read_id") % 7 == 0, 0.0).otherwise(F.col("read_id") % 9 / 9))).alias("similarity")), """WITH a AS (SELECT read_id, conf - 0.3::DOUBLE AS s, CASE WHEN read_id % 4 = 0 THEN 0 ELSE (read_id % 10)::DOUBLE / 10 END AS i, CASE WHEN read_id % 7 = 0 THEN 0 ELSE (read_id % 9)::DOUBLE / 9 END AS t FROM v_reads),
b AS (SELECT *, CASE WHEN i >= 0.7 AND s < 0.5 THEN 0.3 WHEN i >= 0.7 THEN 0.5 ELSE 0.6 END::DOUBLE AS w, CASE WHEN i >= 0.7 AND s < 0.5 THEN 0.6 WHEN i >= 0.7 THEN 0.4 ELSE 0.3 END::DOUBLE AS v, 0.1::DOUBLE AS u FROM a),
c AS (SELECT read_id, s, i, t, CASE WHEN i = 0 THEN w / (w + u) ELSE w END AS w, CASE WHEN i = 0 THEN 0 ELSE v END AS v, CASE WHEN i = 0 THEN u / (w + u) ELSE u END AS u FROM b),
e AS (SELECT *, CASE WHEN t = 0 THEN (w * s + v * i) / (w + v) ELSE w * s + v * i + u * t END AS z FROM c)
SELECT read_id, round(CASE WHEN i >= 0.75 AND t >= 0.8 THEN greatest(z, 0.85) ELSE z END, 4) AS similarity FROM e""")
over("v_reads", "x19_longest_digit_run", lambda d: d.select("read_id", p.longest_digit_run("text").alias("run")), f"SELECT read_id, {s.run('text')} AS run FROM v_reads")
over("v_reads", "x20_fold_confusable", lambda d: d.select("read_id", p.fold_confusable("text").alias("folded")), f"SELECT read_id, {s.fold('text')} AS folded FROM v_reads")
over("v_reads", "x21_hamming", lambda d: pairs(d).select("read_id", p.hamming("a", "b").cast("long").alias("hamming"), p.positional_matches("a", "b").cast("long").alias("matches")), _PAIRS + f" SELECT read_id, CASE WHEN length(a) = length(b) THEN length(a) - {s.matches('a', 'b')} END AS hamming, {s.matches('a', 'b')} AS matches FROM p")
over("v_reads", "x22_position_correct", lambda d: d.select("read_id", p.position_correct("text").alias("text")), f"""SELECT read_id, CASE WHEN length(t) < 4 THEN t ELSE u[1:2] || translate(u[3:5], 'GSLIOAB', '6511048') || substr(u, 6) END AS text FROM (SELECT *, substr(t, 1, length(t) - 1) || translate(right(t, 1), '15', 'LS') AS u FROM (SELECT read_id, {_CL} AS t FROM v_reads))""")
over("v_reads", "x23_six_g", lambda d: d.select("read_id", p.six_g("text").alias("text")), "SELECT read_id, CASE WHEN length(t) < 4 THEN t ELSE translate(t[1:2], '6', 'G') || translate(substr(t, 3, length(t) - 3), 'G', '6') || translate(right(t, 1), '6', 'G') END AS text FROM (SELECT read_id, replace(upper(text), ' ', '') AS t FROM v_reads)")
over("v_inf", "x24_region_of", lambda d: d.select("inf_id", p.region_of(F.coalesce("ubicacion", F.lit(""))).alias("region")), "SELECT inf_id, CASE WHEN contains(upper(coalesce(ubicacion, '')), 'ES') THEN 'ES' WHEN contains(upper(coalesce(ubicacion, '')), 'CL') THEN 'CL' ELSE 'ES' END AS region FROM v_inf")
over("v_reads", "x25_adjusted_conf", lambda d: d.select("read_id", r4(p.adjusted_conf("conf", F.upper(F.trim("text")), F.col("read_id") % 2 == 0)).alias("adj")), f"SELECT read_id, round(conf * CASE WHEN {s.valid('u')} THEN 1.5 ELSE 1 END * (1 + CASE WHEN read_id % 2 = 0 THEN 0.5 ELSE 1 END * {s.coherence('u')})::DOUBLE, 4) AS adj FROM (SELECT *, {UP} AS u FROM v_reads)")
over("v_reads", "x26_clock", lambda d: d.select("read_id", g.clock("t").alias("short"), g.clock(F.floor("t") + 0.25, True).alias("long")), "SELECT read_id, lpad(floor(t / 60)::BIGINT::VARCHAR, 2, '0') || ':' || lpad((floor(t)::BIGINT % 60)::VARCHAR, 2, '0') AS short, lpad(floor(t / 60)::BIGINT::VARCHAR, 2, '0') || ':' || lpad((floor(t)::BIGINT % 60)::VARCHAR, 2, '0') || '.250' AS long FROM v_reads")
over("v_reads", "x27_char_density", lambda d: d.select("read_id", F.round(p.char_density("text", F.col("read_id") % 100, F.lit(20)), 6).alias("density")), "SELECT read_id, round(length(text)::DOUBLE / nullif((read_id % 100) * 20, 0), 6) AS density FROM v_reads")
over("v_reads", "x28_format_scores", lambda d: d.select("read_id", r4(p.format_score("text")).alias("stored"), r4(p.image_format_score("text")).alias("image")), f"""SELECT read_id, round({_FORM}, 4) AS stored, round(CASE WHEN regexp_full_match(text, '[A-Z]+-[0-9]{{4}}') THEN 1.0 WHEN regexp_full_match(text, '[A-Z][0-9]{{4}}[A-Z]?') THEN 0.8 WHEN contains(text, '-') THEN 0.7 ELSE 0 END + CASE WHEN regexp_full_match(text, '[A-Za-z0-9-]+') THEN 0.1 ELSE 0 END, 4)::DOUBLE AS image FROM v_reads""")
_VARIANTS = {"AB1234": ["AB1234", "A81234", "4B1234"], "BH0013": ["BH0013", "8H0013", "BHOO13"], "CO0026": ["CO0026", "C00026", "COOO26"]}


@add("j14_canonicalise", "SELECT read_id, CASE WHEN v = 'X' THEN c ELSE 'ok-' || v END AS canonical FROM (SELECT read_id, c, CASE WHEN c[1] BETWEEN 'A' AND 'M' AND length(c) = 6 THEN c ELSE 'X' END AS v FROM (SELECT read_id, " + _CL + " AS c FROM v_reads))")
def j14(spark, d):
    r = view(spark, d, "v_reads").withColumn("c", p.clean_plate("text"))
    table = r.where("length(c) = 6 and substr(c, 1, 1) between 'A' and 'M'").select(F.col("c").alias("variant"), F.concat(F.lit("ok-"), "c").alias("canonical")).distinct()
    return reads.canonicalise(r, table, "c").select("read_id", "canonical")


_LIKE = " ".join("WHEN greatest({}) >= 0.7 THEN '{}'".format(", ".join(f"{s.matches('c', chr(39) + v + chr(39))}::DOUBLE / nullif(least(length(c), {len(v)}), 0) + CASE WHEN length(c) = {len(v)} THEN 0.1 ELSE 0 END" for v in vs), k) for k, vs in _VARIANTS.items())


@add("j15_canonicalise_fuzzy", f"SELECT read_id, CASE {_LIKE} ELSE c END AS canonical FROM (SELECT read_id, {_CL} AS c FROM v_reads)")
def j15(spark, d):
    table = spark.createDataFrame([(i, k, v) for i, (k, vs) in enumerate(_VARIANTS.items()) for v in vs], "rank int, canonical string, variant string")
    return reads.canonicalise_fuzzy(view(spark, d, "v_reads").withColumn("c", p.clean_plate("text")), table, col="c").select("read_id", "canonical")


@add("j16_best_plate_version", f"""WITH k AS (SELECT DISTINCT {_CL} AS k FROM v_reads WHERE conf >= 0.99), t AS (SELECT DISTINCT {_CL} AS c FROM v_reads),
m AS (SELECT c, min(k) AS k FROM t JOIN k ON length(c) = length(k) WHERE length(c) - {s.matches('c', 'k')} BETWEEN 0 AND 2 GROUP BY c)
SELECT read_id, CASE WHEN c IN (SELECT k FROM k) THEN c ELSE coalesce(m.k, c) END AS version FROM (SELECT read_id, {_CL} AS c FROM v_reads) r LEFT JOIN m USING (c)""")
def j16(spark, d):
    r = view(spark, d, "v_reads").withColumn("c", p.clean_plate("text"))
    return reads.best_plate_version(r, r.where("conf >= 0.99").select(F.col("c").alias("plate")), "c").select("read_id", "version")


_SIM = f"""WITH r AS (SELECT read_id, vehicle, t, upper(regexp_replace(text, '[- ]', '', 'g')) AS x FROM v_reads), q AS (SELECT *, {s.run('x')} AS m, {s.fold('x')} AS f FROM r WHERE x <> ''),
p AS (SELECT a.read_id AS a, b.read_id AS b, a.x, b.x AS y, a.m, b.m AS n, a.f, b.f AS fy, abs(a.t - b.t) AS dt FROM q a JOIN q b ON a.vehicle = b.vehicle AND a.read_id < b.read_id),
u AS (SELECT *, coalesce(list_max([i FOR i IN range(1, least(length(m), length(n)) + 1) IF right(m, i) = right(n, i)]), 0) AS k FROM p),
v AS (SELECT *, CASE WHEN least(length(m), length(n)) >= 3 AND m = n THEN 0.85 WHEN least(length(m), length(n)) >= 3 AND k >= 3 THEN 0.6 + k::DOUBLE / greatest(length(m), length(n)) * 0.3 ELSE 0 END AS z FROM u),
w AS (SELECT *, CASE WHEN x = y THEN 1 WHEN z < 0.8 AND f = fy THEN 0.85 ELSE z END::DOUBLE AS s, CASE WHEN dt < 5 THEN 1 - dt / 5 ELSE 0 END::DOUBLE AS h FROM v),
y AS (SELECT a, b, dt, CASE WHEN h = 0 THEN s ELSE s * 6 / 7 + h / 7 END AS similarity FROM w)"""


# --- aggregates ----------------------------------------------------------------------------
_DAYS = "WITH d AS (SELECT coalesce(fecha, 'Sin fecha') AS day, placa, count(*) AS n FROM v_inf GROUP BY ALL), c AS (SELECT day, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (WHERE placa IS NOT NULL), 0)::BIGINT AS plate_rows, count(placa) AS plates, count(*) FILTER (WHERE placa IS NOT NULL AND n > 1) AS repeated FROM d GROUP BY day)"
over("v_inf", "a01_daily_counts", indicators.daily_counts, _DAYS + " SELECT * FROM c")
over("v_inf", "a02_detection_rate", lambda d: indicators.detection_rate(d).select(r4("ti").alias("ti")), _DAYS + " SELECT round(sum(total)::DOUBLE / count(*), 4) AS ti FROM c")
over("v_inf", "a03_repeat_rate_daily", lambda d: indicators.repeat_rate_daily(d).select(r4("ir").alias("ir")), _DAYS + " SELECT round(avg(repeated * 100.0::DOUBLE / total), 4) AS ir FROM c")
over("v_inf", "a04_repeat_rate", lambda d: indicators.repeat_rate(d).select(r4("ir").alias("ir")), "SELECT round(avg(CASE WHEN n > 1 THEN 100.0::DOUBLE ELSE 0 END), 4) AS ir FROM (SELECT placa, count(*) AS n FROM v_inf WHERE placa IS NOT NULL GROUP BY placa)")
over("v_inf", "a05_distinct_plates", indicators.distinct_plates, "SELECT count(DISTINCT placa) AS plates FROM v_inf")
over("v_hist", "a06_registration_time", lambda d: indicators.registration_time(d).select(r4("tr").alias("tr")), "SELECT round(coalesce(avg(greatest(processing_time, 0.01)) FILTER (WHERE processing_time > 0), 0), 4) AS tr FROM v_hist")
over("v_hist", "a07_run_time", lambda d: indicators.run_time_per_infraction(d.groupBy((F.col("plate_key") % 20).alias("run")).agg(F.sum("processing_time").alias("seconds"), F.count_if(F.col("processing_time") > 0).alias("infractions"))).select("run", r4("per_infraction").alias("per_infraction")), "SELECT plate_key % 20 AS run, round(coalesce(sum(processing_time) / nullif(count(*) FILTER (WHERE processing_time > 0), 0), 0), 4) AS per_infraction FROM v_hist GROUP BY 1")
over("v_hist", "a08_plate_history", lambda d: indicators.plate_history(d).withColumn("processing_time", r4("processing_time")), "SELECT plate_key, count(*) AS n, min(ts) AS first_detection, max(ts) AS last_detection, round(arg_max(processing_time, (ts, event_id)), 4) AS processing_time FROM v_hist GROUP BY plate_key")


def _months(spark, d):
    return view(spark, d, "v_inf").withColumn("month", F.substring("fecha", 4, 7)).groupBy("month").agg(F.count("*").alias("total"), F.countDistinct("fecha").alias("dias"), F.count_if(F.col("inf_id") % 8 == 0).alias("reincidentes"))


_MONTHS = "WITH m AS (SELECT substr(fecha, 4, 7) AS month, count(*) AS total, count(DISTINCT fecha) AS dias, count(*) FILTER (WHERE inf_id % 8 = 0) AS reincidentes FROM v_inf GROUP BY 1)"


def _survey(spark, d):
    return view(spark, d, "v_inf").select((F.col("inf_id") % 7 + 4).cast("double").alias("minutes"))


@add("a09_baseline", _MONTHS + " SELECT round(sum(total)::DOUBLE / sum(dias), 4) AS ti, (SELECT round(avg(inf_id % 7 + 4) * 60, 4) FROM v_inf) AS tr, round(sum(reincidentes)::DOUBLE / sum(total) * 100, 4) AS ir FROM m")
def a09(spark, d):
    return indicators.baseline(_months(spark, d), _survey(spark, d)).select(*(r4(c).alias(c) for c in ("ti", "tr", "ir")))


over("v_hist", "a10_compare", lambda d: indicators.compare(d.groupBy("plate_key").agg(F.count("*").cast("double").alias("a"), F.count_if(F.col("processing_time") > 0).cast("double").alias("b")), "a", "b").select("plate_key", *(r4(c).alias(c) for c in ("improvement", "reduction", "speed_up", "ratio"))), """WITH k AS (SELECT plate_key, count(*)::DOUBLE AS a, (count(*) FILTER (WHERE processing_time > 0))::DOUBLE AS b FROM v_hist GROUP BY 1)
SELECT plate_key, round(coalesce((a - b) / nullif(b, 0) * 100, 0), 4) AS improvement, round(coalesce((b - a) / nullif(b, 0) * 100, 0), 4) AS reduction, round(coalesce(b / nullif(a, 0), 0), 4) AS speed_up, round(coalesce(a / nullif(b, 0), 0), 4) AS ratio FROM k""")


@add("a11_indicator_report", f"""{_DAYS}, s AS (SELECT sum(total)::DOUBLE / count(*) AS ti, avg(repeated * 100.0::DOUBLE / total) AS ir, 9.5::DOUBLE AS tr FROM c), m AS (SELECT substr(fecha, 4, 7) AS month, count(*) AS total, count(DISTINCT fecha) AS dias, count(*) FILTER (WHERE inf_id % 8 = 0) AS reincidentes FROM v_inf GROUP BY 1),
b AS (SELECT sum(total)::DOUBLE / sum(dias) AS bti, (SELECT avg(inf_id % 7 + 4) * 60 FROM v_inf) AS btr, sum(reincidentes)::DOUBLE / sum(total) * 100 AS bir FROM m)
SELECT (SELECT strftime(min({_DAY}), '%d/%m/%Y') FROM v_inf) AS inicio, (SELECT strftime(max({_DAY}), '%d/%m/%Y') FROM v_inf) AS fin, round((ti - bti) / bti * 100, 4) AS ti_mejora, round(btr / tr, 4) AS tr_factor, round(ir, 4) AS ir_valor, 5.25::DOUBLE AS patched FROM s, b""")
def a11(spark, d):
    inf = view(spark, d, "v_inf")
    report = indicators.indicator_report(inf, _months(spark, d), _survey(spark, d))
    patched = indicators.patch_report_tr(report.withColumn("factor", F.col("indicadores.TR.con_software.factor")), 5.25)
    at = lambda k: F.col(f"indicadores.{k}")
    return patched.select("periodo.inicio", "periodo.fin", r4(at("TI.con_software.mejora")).alias("ti_mejora"), r4("factor").alias("tr_factor"), r4(at("IR.con_software.valor")).alias("ir_valor"), at("TR.con_software.valor").alias("patched"))


over("v_inf", "a19_period", lambda d: d.agg(F.min(indicators.parsed_day()).alias("first"), F.max(indicators.parsed_day()).alias("last")), f"SELECT min({_DAY})::DATE AS first, max({_DAY})::DATE AS last FROM v_inf")


def upper_reads(d: DataFrame) -> DataFrame:
    return d.withColumn("text", F.upper(F.trim("text")))


_U = f"WITH u AS (SELECT read_id, crop_id, camera, conf, {UP} AS text FROM v_reads)"
_GS = f"(0.5 * count(*) + 0.3 * avg(conf) + 0.2 * avg({s.coherence('text')})) * CASE WHEN bool_or({s.valid('text')}) THEN 1.8::DOUBLE ELSE 1 END"
_PRE = f"SELECT *, {s.coherence('text')} AS coh, {s.valid('text')} AS ok, {s.pattern('text')} AS pattern FROM u"
over("v_reads", "a12_majority_vote", lambda d: reads.majority_vote(d.withColumn("text", F.substring(p.clean_plate("text"), 1, 2))), f"""WITH c AS (SELECT crop_id, {_CL}[1:2] AS text, count(*) AS votes, min(read_id) AS first_id FROM v_reads GROUP BY ALL) SELECT crop_id, arg_max(text, (votes, -first_id)) AS text, max(votes) AS votes FROM c GROUP BY crop_id""")
over("v_reads", "a13_consensus", lambda d: reads.consensus(upper_reads(d)), f"""WITH RECURSIVE{_U[4:]}, e AS ({_PRE}), o AS (SELECT *, row_number() OVER (PARTITION BY crop_id ORDER BY read_id) AS rn FROM e),
k AS (SELECT crop_id, read_id, rn, pattern AS grp, [pattern] AS keys FROM o WHERE rn = 1 UNION ALL SELECT crop_id, read_id, rn, g AS grp, list_append(keys, g) AS keys FROM (
  SELECT o.crop_id, o.read_id, o.rn, k.keys, coalesce(list_filter(k.keys, lambda q: q = o.pattern)[1], list_filter(k.keys, lambda q: {s.similar('o.pattern', 'q')} > 0.7)[1], o.pattern) AS g FROM k JOIN o ON o.crop_id = k.crop_id AND o.rn = k.rn + 1 WHERE o.rn <= 15)),
j AS (SELECT e.*, k.grp FROM e JOIN k USING (crop_id, read_id)), c AS (SELECT crop_id, grp, (0.5 * count(*) + 0.3 * avg(conf) + 0.2 * avg(coh)) * CASE WHEN bool_or(ok) THEN 1.8::DOUBLE ELSE 1 END AS score, min(read_id) AS f, arg_max(text, (ok::INT, conf, -read_id)) AS text FROM j GROUP BY crop_id, grp)
SELECT crop_id, arg_max(text, (round(score, 9), -f)) AS text FROM c GROUP BY crop_id""")
over("v_reads", "a13_consensus_exact", lambda d: reads.consensus_exact(upper_reads(d)).select("crop_id", "pattern", "text"), f"""{_U}, e AS ({_PRE}), k AS (SELECT crop_id, pattern, (0.5 * count(*) + 0.3 * avg(conf) + 0.2 * avg(coh)) * CASE WHEN bool_or(ok) THEN 1.8::DOUBLE ELSE 1 END AS score, min(read_id) AS f FROM e GROUP BY ALL),
b AS (SELECT crop_id, arg_max(pattern, (round(score, 9), -f)) AS pattern FROM k GROUP BY crop_id)
SELECT crop_id, pattern, arg_max(text, (ok::INT, conf, -read_id)) AS text FROM e JOIN b USING (crop_id, pattern) GROUP BY ALL""")
over("v_reads", "a14_group_score", lambda d: reads.group_scores(upper_reads(d), ["crop_id"]).select("crop_id", r4("score").alias("score")), f"{_U}, e AS ({_PRE}) SELECT crop_id, round((0.5 * count(*) + 0.3 * avg(conf) + 0.2 * avg(coh)) * CASE WHEN bool_or(ok) THEN 1.8::DOUBLE ELSE 1 END, 4) AS score FROM e GROUP BY crop_id")
over("v_reads", "a15_representative", lambda d: reads.representative(upper_reads(d), ["crop_id"]), f"{_U}, e AS ({_PRE}) SELECT crop_id, arg_max(text, (ok::INT, conf, -read_id)) AS text FROM e GROUP BY crop_id")
over("v_reads", "a16_best_candidate", lambda d: reads.best_candidate(upper_reads(d)).withColumn("adj", r4("adj")), f"{_U}, e AS (SELECT *, conf * CASE WHEN ok THEN 1.5::DOUBLE ELSE 1 END * (1 + coh) AS adj FROM ({_PRE})) SELECT crop_id, arg_max(text, (round(adj, 9), -read_id)) AS text, round(max(adj), 4) AS adj FROM e GROUP BY crop_id")
over("v_reads", "a17_best_plate_in_image", lambda d: reads.best_plate_in_image(upper_reads(d), "crop_id").select("crop_id", "text", r4("score").alias("score")), f"""{_U}, e AS (SELECT *, row_number() OVER (PARTITION BY crop_id ORDER BY conf DESC, read_id) AS rn, length(text)::DOUBLE / 8 * CASE WHEN ok THEN 1.5::DOUBLE ELSE 1 END * (1 + coh) AS score FROM ({_PRE}))
SELECT crop_id, arg_max(text, (round(score, 9), -rn)) AS text, round(max(score), 4) AS score FROM e WHERE rn <= 3 GROUP BY crop_id""")

# --- windows -------------------------------------------------------------------------------
over("v_track", "w01_interpolate", lambda d: tracks.interpolate_tracks(d).select("car_id", "frame", r4("x1").alias("x1"), r4("y2").alias("y2"), "text_score", "imputed"), """WITH n AS (SELECT *, lead(frame) OVER w AS nf, lead(x1) OVER w AS nx, lead(y2) OVER w AS ny FROM v_track WINDOW w AS (PARTITION BY car_id ORDER BY frame))
SELECT car_id, f AS frame, round(CASE WHEN f = frame THEN x1 ELSE x1 + (nx - x1) * ((f - frame)::DOUBLE / (nf - frame)) END, 4) AS x1, round(CASE WHEN f = frame THEN y2 ELSE y2 + (ny - y2) * ((f - frame)::DOUBLE / (nf - frame)) END, 4) AS y2, CASE WHEN f = frame THEN text_score ELSE 0 END AS text_score, f <> frame AS imputed
FROM n, LATERAL (SELECT unnest(range(frame, coalesce(nf, frame + 1))) AS f)""")
_BEST = "WITH b AS (SELECT *, row_number() OVER (PARTITION BY car_id ORDER BY text_score DESC, frame) AS rn FROM v_track)"
over("v_track", "w02_best_read_per_car", lambda d: tracks.best_read_per_car(d).select("car_id", "frame", "text_score"), _BEST + " SELECT car_id, frame, text_score FROM b WHERE rn = 1")
over("v_track", "j13_annotate_frames", lambda d: tracks.annotate_frames(d).select("car_id", "frame", "best_frame", "best_score"), _BEST + " SELECT t.car_id, t.frame, b.frame AS best_frame, b.text_score AS best_score FROM v_track t JOIN b ON b.car_id = t.car_id AND rn = 1")
over("v_det", "w03_last_per_car_frame", lambda d: detections.last_per_car_frame(d.withColumnRenamed("det_id", "plate_id"), ["camera", "frame"]).select("camera", "frame", "plate_id"), "SELECT camera, frame, max(det_id) AS plate_id FROM v_det GROUP BY camera, frame")
over("v_reads", "w04_first_seen", lambda d: reads.first_seen(d.withColumn("c", p.clean_plate("text")), "c", ["t", "read_id"]).select("c", "read_id"), f"SELECT c, read_id FROM (SELECT {_CL} AS c, read_id, row_number() OVER (PARTITION BY {_CL} ORDER BY t, read_id) AS rn FROM v_reads) WHERE rn = 1")
over("v_reads", "w05_best_per_vehicle", lambda d: reads.best_per_vehicle(d, "vehicle", "sharpness").select("vehicle", "read_id", r4("score").alias("score")), f"""WITH q AS (SELECT *, {_SCORE.replace('- EXTRA', '')} AS score FROM (SELECT *, length(regexp_replace(text, '[- ]', '', 'g')) AS n FROM v_reads))
SELECT vehicle, arg_max(read_id, (score, -read_id)) AS read_id, max(score) AS score FROM q GROUP BY vehicle""")
over("v_reads", "w06_best_per_group", lambda d: reads.best_per_group(d, d.groupBy("crop_id").agg(F.collect_list("read_id").alias("m")).select(F.explode("m").alias("node"), F.array_min("m").alias("root"))).select("read_id", "members"), f"""WITH q AS (SELECT *, min(read_id) OVER (PARTITION BY crop_id) AS grp, {_QUALITY} AS quality FROM v_reads)
SELECT arg_max(read_id, (quality, -read_id)) AS read_id, count(*) AS members FROM q GROUP BY grp""")
over("v_det", "w07_reuse_previous", lambda d: detections.reuse_previous(d.withColumn("sig", F.floor(F.col("det_id") / 30) % 2), ["camera"], "sig", "det_id").select("det_id", "run", "reused"), """WITH a AS (SELECT *, floor(det_id / 30) % 2 AS sig FROM v_det), b AS (SELECT *, CASE WHEN coalesce(lag(sig) OVER w <> sig, true) THEN 1 ELSE 0 END AS n FROM a WINDOW w AS (PARTITION BY camera ORDER BY frame, det_id)),
c AS (SELECT *, (sum(n) OVER (PARTITION BY camera ORDER BY frame, det_id))::BIGINT AS run FROM b) SELECT det_id, run, first_value(det_id) OVER (PARTITION BY camera, run ORDER BY frame, det_id) AS reused FROM c""")
over("v_track", "w08_ema_rate", lambda d: tracks.ema_rate(d, "car_id", "frame").select("car_id", r4("rate").alias("rate")), """WITH RECURSIVE s AS (SELECT car_id, frame - lag(frame) OVER w AS dt, row_number() OVER w - 1 AS i FROM v_track WINDOW w AS (PARTITION BY car_id ORDER BY frame)),
r AS (SELECT car_id, i, 0.1::DOUBLE / dt AS rate FROM s WHERE i = 1 UNION ALL SELECT s.car_id, s.i, r.rate * (1 - 0.1::DOUBLE) + 0.1::DOUBLE / s.dt FROM r JOIN s ON s.car_id = r.car_id AND s.i = r.i + 1)
SELECT car_id, round(arg_max(rate, i), 4) AS rate FROM r GROUP BY car_id""")
over("v_track", "w09_hit_streaks", lambda d: tracks.hit_streaks(d).select("car_id", "frame", "streak", "age"), """WITH a AS (SELECT *, frame - row_number() OVER (PARTITION BY car_id ORDER BY frame) AS isl FROM v_track) SELECT car_id, frame, (row_number() OVER (PARTITION BY car_id, isl ORDER BY frame))::INT AS streak, frame - min(frame) OVER (PARTITION BY car_id) AS age FROM a""")

# --- sorts, top-k, sets --------------------------------------------------------------------
over("v_inf", "k01_newest_first", lambda d: indicators.newest_first(d, "inf_id").select("inf_id", "fecha", "hora"), f"SELECT inf_id, fecha, hora FROM v_inf ORDER BY {_DAY} DESC NULLS LAST, hora DESC, inf_id")
over("v_det", "k02_top_k", lambda d: detections.top_k(d, ["camera"], [F.desc("score"), F.col("det_id")], 3).select("camera", "det_id", "rank"), "SELECT camera, det_id, rank FROM (SELECT *, (row_number() OVER (PARTITION BY camera ORDER BY score DESC, det_id))::INT AS rank FROM v_det) WHERE rank <= 3")
over("v_det", "k03_plate_region", lambda d: detections.plate_region(d, ["camera", "frame"]).select("camera", "frame", "det_id"), "SELECT camera, frame, arg_max(det_id, ((x2 - x1) * (y2 - y1), -det_id)) AS det_id FROM v_det WHERE (x2 - x1) * (y2 - y1) >= 300 AND (x2 - x1) / nullif(y2 - y1, 0) BETWEEN 2.0 AND 6.0 AND y2 >= 120 GROUP BY camera, frame")
over("v_det", "k04_nms", lambda d: detections.nms(d, ["camera", "frame"]), f"""WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY camera, frame ORDER BY score DESC, det_id) AS rn FROM v_det),
k AS (SELECT camera, frame, 1 AS rn, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'id': det_id, 's': score}}] AS kept FROM d WHERE rn = 1 UNION ALL
SELECT k.camera, k.frame, k.rn + 1, CASE WHEN len(list_filter(k.kept, lambda b: {s.iou('b.', 'd.')} > 0.45)) > 0 THEN k.kept ELSE list_append(k.kept, {{'x1': d.x1, 'y1': d.y1, 'x2': d.x2, 'y2': d.y2, 'id': d.det_id, 's': d.score}}) END FROM k JOIN d ON d.camera = k.camera AND d.frame = k.frame AND d.rn = k.rn + 1),
l AS (SELECT camera, frame, arg_max(kept, rn) AS kept FROM k GROUP BY camera, frame) SELECT camera, frame, b.id AS det_id, b.s AS score FROM (SELECT camera, frame, unnest(kept) AS b FROM l)""")
over("v_reads", "k05_segment_dedup", lambda d: reads.segment_dedup(d, ["crop_id"]), f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY crop_id ORDER BY sharpness DESC, read_id) AS rn FROM v_reads WHERE text <> '' AND length({s.BARE.format('text')}) <= 7),
k AS (SELECT crop_id, rn, [{{'id': read_id, 't': text}}] AS kept FROM o WHERE rn = 1 UNION ALL
SELECT k.crop_id, o.rn, CASE WHEN len(list_filter(k.kept, lambda x: length(x.t) = length(o.text) AND length(o.text) - {s.matches('x.t', 'o.text')} <= CASE WHEN length(o.text) <= 6 THEN 1 ELSE 2 END)) > 0 THEN k.kept ELSE list_append(k.kept, {{'id': o.read_id, 't': o.text}}) END FROM k JOIN o ON o.crop_id = k.crop_id AND o.rn = k.rn + 1)
SELECT crop_id, x.id AS read_id, x.t AS text FROM (SELECT crop_id, unnest(arg_max(kept, rn)) AS x FROM k GROUP BY crop_id)""")
over("v_det", "k06_union", lambda d: d.where("camera < 3").select("det_id", "camera").unionByName(d.where("camera > 6").select("det_id", "score"), allowMissingColumns=True), "SELECT det_id, camera, NULL::DOUBLE AS score FROM v_det WHERE camera < 3 UNION ALL SELECT det_id, NULL, score FROM v_det WHERE camera > 6")
over("v_reads", "k07_distinct_plates", lambda d: d.select(p.clean_plate("text").alias("plate")).distinct(), f"SELECT DISTINCT {_CL} AS plate FROM v_reads")
over("v_det", "k08_unmatched", lambda d: detections.unmatched(d, d.where("class_id = 2").select("camera", "frame").distinct(), ["camera", "frame"]).select("det_id"), "SELECT det_id FROM v_det d WHERE NOT EXISTS (SELECT 1 FROM v_det e WHERE e.class_id = 2 AND e.camera = d.camera AND e.frame = d.frame)")

# --- duplicates, tracking, identity --------------------------------------------------------
over("v_reads", "j12_dup_pairs", lambda d: reads.dup_pairs(d, ["vehicle"], 0.75).select("a", "b", reads.rounded(F.col("similarity"), 4).alias("similarity")), _SIM + " SELECT a, b, round(similarity, 4) AS similarity FROM y WHERE round(similarity, 9) >= 0.75")
_GROUPS = _SIM.replace("WITH r", "WITH RECURSIVE r") + """, e AS (SELECT a, b FROM y WHERE similarity >= 0.8 UNION SELECT b, a FROM y WHERE similarity >= 0.8), c(node, root) AS (SELECT a, a FROM e UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node WHERE e.b > c.root),
g AS (SELECT node, min(root) AS root FROM c GROUP BY node)"""
over("v_reads", "t3_dup_groups", lambda d: reads.dup_classes(d, ["vehicle"]), _GROUPS + " SELECT node, root FROM g")
over("v_reads", "t4_dedup_plates", lambda d: reads.dedup_plates(d, ["vehicle"]).select("read_id", "members"), _GROUPS + f""", h AS (SELECT v.*, coalesce(root, read_id) AS grp, {_QUALITY} AS quality FROM v_reads v LEFT JOIN g ON node = read_id)
SELECT arg_max(read_id, (quality, -read_id)) AS read_id, count(*) AS members FROM h GROUP BY grp""")


def sequences(spark, d) -> DataFrame:
    det = view(spark, d, "v_det")
    return det.withColumn("frame", F.col("frame") + 1).withColumn("x1", F.col("x1") / 8 + F.col("frame")).withColumn("x2", F.col("x1") + 60).withColumn("y1", F.col("camera") * 50.0).withColumn("y2", F.col("y1") + 40)


add("t1_track")(lambda spark, d: tracks.track(sequences(spark, d), "camera").select("camera", "frame", "track_id", r4("x1").alias("x1")))
add("t5_vehicle_ids", """WITH RECURSIVE l AS (SELECT vec_id, t, unnest(features)::DOUBLE AS v, generate_subscripts(features, 1) AS dim FROM v_vec), m AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS s FROM l GROUP BY dim),
z AS (SELECT row_number() OVER (ORDER BY any_value(t), vec_id)::BIGINT AS a, vec_id, list(coalesce((v - m) / nullif(s, 0), 0) ORDER BY dim) AS c FROM l JOIN m USING (dim) GROUP BY vec_id),
r(kind, a, b, n, c, h) AS (SELECT 0, a, 0::BIGINT, 1.0::DOUBLE, c, 0.0::DOUBLE FROM z UNION ALL
(WITH d AS (SELECT x.a, y.a AS b, 2 * x.n * y.n / (x.n + y.n) * list_distance(x.c, y.c) ** 2 AS h FROM r x JOIN r y ON x.a <> y.a WHERE x.kind = 0 AND y.kind = 0),
k AS (SELECT a, arg_min(b, (h, b)) AS b, min(h) AS h FROM d GROUP BY a), p AS (SELECT k.a, k.b, k.h FROM k JOIN k o ON o.a = k.b AND o.b = k.a WHERE k.a < k.b)
SELECT 1, a, b, 0.0, NULL, h FROM p UNION ALL SELECT 0, r.a, 0, r.n, r.c, 0.0 FROM r WHERE kind = 0 AND EXISTS (SELECT 1 FROM p) AND r.a NOT IN (SELECT a FROM p UNION ALL SELECT b FROM p)
UNION ALL SELECT 0, p.a, 0, x.n + y.n, list_transform(list_zip(x.c, y.c), lambda e: (e[1] * x.n + e[2] * y.n) / (x.n + y.n)), 0.0 FROM p JOIN r x ON x.a = p.a AND x.kind = 0 JOIN r y ON y.a = p.b AND y.kind = 0)),
e AS MATERIALIZED (SELECT a, b FROM r WHERE kind = 1 AND sqrt(h) <= 0.7 * sqrt((SELECT max(h) FROM r WHERE kind = 1))), u AS MATERIALIZED (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
g AS (SELECT a AS x, a AS y FROM z UNION SELECT g.x, u.y FROM g JOIN u ON g.y = u.x), f AS (SELECT x, min(y) AS root FROM g GROUP BY x)
SELECT vec_id, 'V' || dense_rank() OVER (ORDER BY root) AS vehicle_id FROM z JOIN f ON f.x = z.a""")(lambda spark, d: identity.vehicle_ids(view(spark, d, "v_vec")).select("vec_id", "vehicle_id"))
over("v_vec", "t6_standardise", lambda d: identity.standardise(d).select("vec_id", "dim", (r4("z") + 0.0).alias("z")), """WITH l AS (SELECT vec_id, unnest(features)::DOUBLE AS v, generate_subscripts(features, 1) - 1 AS dim FROM v_vec), m AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS s FROM l GROUP BY dim)
SELECT vec_id, dim::INT AS dim, round(coalesce((v - m) / nullif(s, 0), 0), 4) + 0.0 AS z FROM l JOIN m USING (dim)""")


@add("a18_tracking_throughput", "SELECT sum(n)::BIGINT AS frames, true AS measured, true AS consistent FROM (SELECT camera, max(frame) + 1 AS n FROM v_det GROUP BY camera)")
def a18(spark, d):
    """Seconds are those of the run, so only their sense can be compared."""
    told, took = tracks.track_timed(sequences(spark, d), "camera")
    rate = tracks.tracking_throughput(took)
    return rate.select("frames", (F.col("seconds") > 0).alias("measured"), (F.abs(F.col("per_second") * F.col("seconds") - F.col("frames")) < 1).alias("consistent"))


@add("a05_plates_from_sketches", """WITH s AS (SELECT coalesce(ubicacion, '-') AS ubicacion, month(try_strptime(fecha, '%d/%m/%Y')) AS month, placa FROM v_inf WHERE placa IS NOT NULL), a AS (SELECT ubicacion, count(DISTINCT placa) AS plates FROM s GROUP BY 1 UNION ALL SELECT 'all', count(DISTINCT placa) FROM s UNION ALL SELECT 'spring', count(DISTINCT placa) FROM s WHERE month IN (3, 4, 5))
SELECT ubicacion, plates, true AS near FROM a""")
def a05_sketches(spark, d):
    """Places, all of them, and the springs of all years, each from stored sketches only."""
    rows = view(spark, d, "v_inf").withColumn("ubicacion", F.coalesce("ubicacion", F.lit("-")))
    at = new_path(spark, "sketches")
    indicators.daily_sketches(rows, ["ubicacion"]).write.parquet(at)
    stored = spark.read.parquet(at)
    month = F.month(F.try_to_timestamp("fecha", F.lit("dd/MM/yyyy")))
    cuts = {None: (stored, rows), "all": (stored, rows), "spring": (stored.where(month.isin(3, 4, 5)), rows.where(month.isin(3, 4, 5)))}
    out = None
    for name, (about, exact) in cuts.items():
        keys = [] if name else ["ubicacion"]
        label = F.lit(name) if name else F.col("ubicacion")
        e = exact.groupBy(*keys).agg(F.countDistinct("placa").alias("plates")).select(label.alias("ubicacion"), "plates")
        a = indicators.plates_from_sketches(about, keys).select(label.alias("ubicacion"), F.col("plates").alias("about"))
        both = e.join(a, "ubicacion").select("ubicacion", "plates", (F.abs(F.col("about") - F.col("plates")) <= 0.02 * F.col("plates")).alias("near"))
        out = both if out is None else out.unionByName(both)
    return out


@add("e2_plate_pipeline")
def e2(spark, d):
    """Detections to annotated frames; tracks have no SQL."""
    det = sequences(spark, d)
    plates = det.where("det_id % 3 = 0").selectExpr("det_id as plate_id", "camera", "frame", "x1 + 20 as x1", "y1 + 15 as y1", "x1 + 30 as x2", "y1 + 25 as y2", "concat('P', det_id % 50) as text", "(det_id * 29 % 100) / 100 as text_score")
    out = chains.plate_pipeline(det, plates)
    return out.select("camera", "track_id", "frame", "imputed", "best_text", "best_score", "best_frame", r4("x1").alias("x1"))


# --- images --------------------------------------------------------------------------------
_IMG = "WITH m AS (SELECT image_id, list_avg(pixels) AS mean, sqrt(list_avg([(x - list_avg(pixels)) ** 2 FOR x IN pixels])) AS std, list_sort(pixels)[floor((len(pixels) - 1) * 0.1)::INT + 1] AS p10 FROM v_img)"
over("v_img", "i1_pixel_stats", lambda d: images.pixel_stats(d).select("image_id", r4("mean").alias("mean"), r4("std").alias("std"), "p10"), _IMG + " SELECT image_id, round(mean, 4) AS mean, round(std, 4) AS std, p10 FROM m")
over("v_img", "i2_is_night", lambda d: images.pixel_stats(d).select("image_id", images.is_night("offline").alias("night"), images.is_night("batch").alias("batch")), _IMG + " SELECT image_id, mean < 85 OR p10 < 30 AS night, mean < 100 AS batch FROM m")
over("v_img", "i3_plate_quality", lambda d: images.pixel_stats(d).withColumns({"sharpness": F.lit(50.0), "width": F.lit(8), "height": F.lit(8)}).select("image_id", r4(images.plate_quality()).alias("reader"), r4(images.plate_quality("stored", noise=F.col("image_id") % 150)).alias("stored")), _IMG + " SELECT image_id, round(least(1.0, greatest(0.0, 0.4 * 0.5 + 0.3 * std / 80 + 0.2 * (1 - abs((mean - 127.5) / 127.5)) + 0.1 * 64 / 10000)), 4)::DOUBLE AS reader, round(least(1.0, greatest(0.0, 0.4 * 0.1 + 0.3 * std / 80 + 0.15 * 64 / 10000 + 0.05 * (1 - least(1, (image_id % 150) / 100)))), 4)::DOUBLE AS stored FROM m")
over("v_img", "s15_route_params", lambda d: images.pixel_stats(d).withColumn("sharpness", F.col("image_id") % 160).select("image_id", images.route_params().alias("route")), _IMG + " SELECT image_id, CASE WHEN mean < 100 AND std < 25 THEN 'night_contrast' WHEN mean < 100 THEN 'night' WHEN std < 25 THEN 'contrast' WHEN image_id % 160 < 80 THEN 'sharpen' ELSE 'plain' END AS route FROM m")


def image_rows(spark, d) -> DataFrame:
    """Pictures of 8 x 8 pixels, one channel, in the image source's layout."""
    px = view(spark, d, "v_img")
    data = F.unhex(F.array_join(F.transform("pixels", lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), ""))
    return px.select("image_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), data.alias("data"), (F.col("image_id") / 10).alias("t"))


#: Pixel (row, column) of an 8 x 8 picture, rows and columns mirrored at the edges; lists count from 1.
_AT = "pixels[(7 - abs(7 - abs(r + {}))) * 8 + 7 - abs(7 - abs(c + {})) + 1]"
_PX = f"""WITH g AS (SELECT image_id, pixels, unnest(range(8)) AS r FROM v_img), h AS (SELECT image_id, pixels, r, unnest(range(8)) AS c FROM g),
k AS (SELECT image_id, {_AT.format(-1, 0)} + {_AT.format(1, 0)} + {_AT.format(0, -1)} + {_AT.format(0, 1)} - 4 * {_AT.format(0, 0)} AS lap, {_AT.format(1, 1)} + {_AT.format(-1, -1)} - {_AT.format(1, -1)} - {_AT.format(-1, 1)} AS mixed FROM h),
m AS (SELECT image_id, pixels, list_avg(pixels) AS mean, list_sort(pixels) AS o FROM v_img)"""
# Variances are sums of powers of two: off the ties of rounding.
add("i1_image_stats", _PX + """ SELECT image_id, round(mean, 4) AS mean, round(sqrt(list_avg([(x - mean) ** 2 FOR x IN pixels])), 4) AS std, round(o[7] + 0.3::DOUBLE * (o[8] - o[7]), 4) AS p10, round(var_pop(lap) + 0.00001::DOUBLE, 4) AS sharpness, round(stddev_pop(mixed), 4) AS noise
FROM m JOIN k USING (image_id) GROUP BY image_id, mean, pixels, o""")(lambda spark, d: images.image_stats(image_rows(spark, d)).select("image_id", *(r4(c).alias(c) for c in ("mean", "std", "p10", "noise")), r4(F.col("sharpness") + 0.00001).alias("sharpness")))
add("i4_histogram_features", """WITH b AS (SELECT image_id, [len(list_filter(pixels, lambda x: floor(x / 16) = i)) FOR i IN range(16)] AS h FROM v_img),
s AS (SELECT image_id, [coalesce((x - list_min(h))::DOUBLE / nullif(list_max(h) - list_min(h), 0), 0) FOR x IN h] AS h FROM b), f AS (SELECT image_id, list_concat(h, h, h, [image_id::DOUBLE / 1000]) AS f FROM s)
SELECT image_id, generate_subscripts(f, 1)::INT AS at, round(unnest(f), 4) AS value FROM f""")(lambda spark, d: images.histogram_features(image_rows(spark, d)).select("image_id", F.posexplode("features").alias("at", "value")).select("image_id", (F.col("at") + 1).alias("at"), r4("value").alias("value")))


@add("i5_image_similarity", """WITH v AS (SELECT image_id, pixels, [len(list_filter(pixels, lambda x: floor(x / 8) = i))::DOUBLE FOR i IN range(32)] AS h FROM v_img),
a AS (SELECT a.image_id, a.pixels AS x, b.pixels AS y, a.h AS p, b.h AS q FROM v a JOIN v b ON b.image_id = a.image_id + 1), k AS (SELECT *, list_avg(p) AS mp, list_avg(q) AS mq FROM a),
c AS (SELECT image_id, greatest(0, coalesce(list_sum([(p[i] - mp) * (q[i] - mq) FOR i IN range(1, 33)]) / nullif(sqrt(list_sum([(x - mp) ** 2 FOR x IN p]) * list_sum([(x - mq) ** 2 FOR x IN q])), 0), 1)) AS r, 1 - least(1, list_avg([(x[i] - y[i]) ** 2 FOR i IN range(1, 65)]) / 10000) AS t FROM k)
SELECT image_id, round(least(1, CASE WHEN r >= 0.85 AND t >= 0.7 THEN greatest(0.45 * r + 0.35 * t, 0.85) ELSE 0.45 * r + 0.35 * t END), 4) AS similarity FROM c""")
def i5(spark, d):
    px = view(spark, d, "v_img").join(images.channel_histograms(image_rows(spark, d)), "image_id")
    side = lambda k, at: px.select((F.col("image_id") - at).alias("image_id"), F.col("pixels").alias(f"{k}_pixels"), F.col("histograms").alias(f"{k}_hist"))
    both = side("a", 0).join(side("b", 1), "image_id")
    return both.select("image_id", r4(images.image_similarity(images.colour_similarity("a_hist", "b_hist"), images.structure_similarity("a_pixels", "b_pixels"))).alias("similarity"))


# Reads with pictures: three of four carry one of fifty, within a quarter of a minute.
def _pictured(spark, d) -> tuple[DataFrame, DataFrame]:
    r = view(spark, d, "v_reads").withColumn("t", F.when(F.col("read_id") % 41 > 0, (F.col("read_id") * 11 % 97) / 4))
    image = F.when(F.col("read_id") % 4 > 0, (F.col("read_id") * 7 + F.col("vehicle")) % 50)
    found = view(spark, d, "v_img").where("image_id < 50").join(images.channel_histograms(image_rows(spark, d).where("image_id < 50")), "image_id")
    return r.withColumn("image_id", image), found


_PICTURED = f"""WITH RECURSIVE v AS MATERIALIZED (SELECT image_id, pixels, [len(list_filter(pixels, lambda x: floor(x / 8) = i))::DOUBLE FOR i IN range(32)] AS h FROM v_img WHERE image_id < 50),
im AS MATERIALIZED (SELECT p, q, least(1, CASE WHEN r >= 0.85 AND t >= 0.7 THEN greatest(0.45 * r + 0.35 * t, 0.85) ELSE 0.45 * r + 0.35 * t END) AS image FROM (SELECT p, q, greatest(0, coalesce(list_sum([(x[i] - mx) * (y[i] - my) FOR i IN range(1, 33)]) / nullif(sqrt(list_sum([(u - mx) ** 2 FOR u IN x]) * list_sum([(u - my) ** 2 FOR u IN y])), 0), 1)) AS r, 1 - least(1, list_avg([(px[i] - py[i]) ** 2 FOR i IN range(1, 65)]) / 10000) AS t
FROM (SELECT a.image_id AS p, b.image_id AS q, a.h AS x, b.h AS y, list_avg(a.h) AS mx, list_avg(b.h) AS my, a.pixels AS px, b.pixels AS py FROM v a, v b))),
r AS (SELECT read_id, vehicle, CASE WHEN read_id % 41 > 0 THEN (read_id * 11 % 97) / 4.0::DOUBLE END AS t, CASE WHEN read_id % 4 > 0 THEN (read_id * 7 + vehicle) % 50 END AS pic, upper(regexp_replace(text, '[- ]', '', 'g')) AS x FROM v_reads), qq AS MATERIALIZED (SELECT *, {s.run('x')} AS m, {s.fold('x')} AS f FROM r WHERE x <> ''),
pp AS (SELECT a.read_id AS a, b.read_id AS b, a.x, b.x AS y, a.m, b.m AS n, a.f, b.f AS fy, abs(a.t - b.t) AS dt, a.pic AS pa, b.pic AS pb FROM qq a JOIN qq b ON a.vehicle = b.vehicle AND a.read_id < b.read_id),
u AS (SELECT *, coalesce(list_max([i FOR i IN range(1, least(length(m), length(n)) + 1) IF right(m, i) = right(n, i)]), 0) AS k FROM pp),
vv AS (SELECT *, CASE WHEN least(length(m), length(n)) >= 3 AND m = n THEN 0.85 WHEN least(length(m), length(n)) >= 3 AND k >= 3 THEN 0.6 + k::DOUBLE / greatest(length(m), length(n)) * 0.3 ELSE 0 END AS z FROM u),
w AS (SELECT a, b, pa IS NOT NULL AND pb IS NOT NULL AS both_images, CASE WHEN x = y THEN 1 WHEN z < 0.8 AND f = fy THEN 0.85 ELSE z END::DOUBLE AS s, CASE WHEN dt < 5 THEN 1 - dt / 5 ELSE 0 END::DOUBLE AS h, coalesce(image, 0)::DOUBLE AS i FROM vv LEFT JOIN im ON pa = p AND pb = q),
wt AS (SELECT *, CASE WHEN i = 0 THEN 6.0 WHEN i >= 0.7 AND s < 0.5 THEN 3 WHEN i >= 0.7 THEN 5 ELSE 6 END::DOUBLE AS ws, CASE WHEN i = 0 THEN 0.0 WHEN i >= 0.7 AND s < 0.5 THEN 6 WHEN i >= 0.7 THEN 4 ELSE 3 END::DOUBLE AS wi, CASE WHEN h = 0 THEN 0 ELSE 1 END::DOUBLE AS wh FROM w),
y AS MATERIALIZED (SELECT a, b, both_images, CASE WHEN i >= 0.75 AND h >= 0.8 THEN greatest(0.85, (ws * s + wi * i + wh * h) / (ws + wi + wh)) ELSE (ws * s + wi * i + wh * h) / (ws + wi + wh) END AS similarity FROM wt)"""
_PICTURED_GROUPS = _PICTURED + """, l AS (SELECT a, b FROM y WHERE similarity >= 0.8 - 1e-9 OR (both_images AND similarity >= 0.75 - 1e-9)), e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l), c(node, root) AS (SELECT a, a FROM e UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node WHERE e.b > c.root),
g AS (SELECT node, min(root) AS root FROM c GROUP BY node)"""


@add("j12_dup_pairs_pictures", _PICTURED + " SELECT a, b, both_images, round(similarity, 4) AS similarity FROM y WHERE similarity >= 0.78")
def j12_pictures(spark, d):
    return picture_dups.dup_pairs(*_pictured(spark, d), ["vehicle"], 0.78).select("a", "b", "both_images", reads.rounded(F.col("similarity"), 4).alias("similarity"))


@add("t3_dup_groups_pictures", _PICTURED_GROUPS + " SELECT node, root FROM g")
def t3_pictures(spark, d):
    return picture_dups.dup_classes(*_pictured(spark, d), ["vehicle"])


@add("t4_dedup_plates_pictures", _PICTURED_GROUPS + f""", vq AS (SELECT r.read_id, (r.read_id * 13 % 101) / 100.0::DOUBLE AS vehicle_quality FROM r WHERE pic IS NOT NULL),
h AS (SELECT v.read_id, v.text, coalesce(root, v.read_id) AS grp, conf, coalesce(vehicle_quality, 0) AS vehicle, vehicle_quality IS NOT NULL AS has FROM v_reads v LEFT JOIN g ON node = v.read_id LEFT JOIN vq ON vq.read_id = v.read_id),
k AS (SELECT *, {_FORM} AS form, CASE WHEN regexp_full_match(text, '[A-Z]{{2,3}}-[0-9]{{3,4}}') THEN 0.9 WHEN regexp_full_match(text, '[A-Z]-[0-9]{{3,5}}') THEN 0.8 WHEN regexp_full_match(text, '[0-9]{{3,4}}-[A-Z]{{2,3}}') THEN 0.7 ELSE 0 END AS pattern FROM h),
z AS (SELECT *, round((0.4 * conf + 0.2 * vehicle + 0.2 * form + 0.1 * pattern + 0.1 * CASE WHEN has AND length(text) > 0 AND conf > 0.5 AND vehicle > 0.5 AND form > 0.5 THEN 0.8 WHEN has AND length(text) > 0 AND (conf < 0.3 OR vehicle < 0.3) THEN 0.2 ELSE 0 END)::DOUBLE * CASE WHEN length(text) NOT BETWEEN 4 AND 10 THEN 0.7::DOUBLE ELSE 1 END, 9) AS quality FROM k)
SELECT arg_max(read_id, (quality, -read_id)) AS read_id, count(*) AS members FROM z GROUP BY grp""")
def t4_pictures(spark, d):
    r, found = _pictured(spark, d)
    r = r.withColumn("quality", F.when(F.col("image_id").isNotNull(), (F.col("read_id") * 13 % 101) / 100))
    return picture_dups.dedup_plates(r, found, ["vehicle"], "quality").select("read_id", "members")


# --- files: written by the engine's sinks and read back --------------------------------------
def _records(spark, d) -> DataFrame:
    return view(spark, d, "v_inf").select("inf_id", *(F.col(c) if c in ("placa", "fecha", "hora", "ubicacion") else F.lit(None).cast("string").alias(c) for c in _TEXTS), F.lit(None).cast("boolean").alias("modo_nocturno"))


_TEXTS = [c.split(" ")[0] for c in io.INFRACTION.split(", ")][:-1]
_REC = "SELECT placa, fecha, hora, ubicacion FROM v_inf"


def _json_folder(rows: DataFrame, at: str) -> str:
    """One text per row into a file of its own."""
    rows.select("part", "value").repartition("part").write.partitionBy("part").text(at)
    return at


@add("s01_read_infractions", _REC)
def s01(spark, d):
    """JSON arrays of up to a thousand records a file."""
    rows = _records(spark, d).groupBy(F.floor(F.col("inf_id") / 1000).alias("part")).agg(F.to_json(F.collect_list(F.struct(*_TEXTS))).alias("value"))
    at = _json_folder(rows, new_path(spark, "log"))
    return io.read_infractions(spark, f"{at}/*").select("placa", "fecha", "hora", "ubicacion")


@add("s02_camera_config", "SELECT a.camera, avenue, green, red, time_slot, len(poly) AS vertices, list_sum([p.x FOR p IN poly])::BIGINT AS xs FROM (SELECT camera::VARCHAR AS camera, avenue FROM v_avenue) a JOIN (SELECT camera::VARCHAR AS camera, green, red, time_slot FROM v_preset) USING (camera) JOIN (SELECT camera::VARCHAR AS camera, poly FROM v_area) USING (camera)")
def s02(spark, d):
    at = new_path(spark, "config")
    tables = {"avenue_config": ("v_avenue", F.col("avenue")), "time_presets": ("v_preset", F.struct("green", "yellow", "red", "time_slot")), "polygon_config": ("v_area", F.transform("poly", lambda p: F.array(p["x"].cast("int"), p["y"].cast("int"))))}
    for name, (source, value) in tables.items():
        # Cameras are few: one JSON object holds them.
        view(spark, d, source).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("camera").cast("string"), value)))).alias("value")).write.text(f"{at}/{name}.json")
    c = io.read_camera_config(spark, at)
    out = c["avenue"].join(c["preset"], "camera").join(c["polygon"], "camera")
    return out.select("camera", "avenue", F.col("green").cast("long").alias("green"), F.col("red").cast("long").alias("red"), "time_slot", F.size("poly").cast("long").alias("vertices"), F.aggregate("poly", F.lit(0).cast("long"), lambda x, p: x + p["x"]).alias("xs"))


_MOT = "SELECT 'c' || camera AS seq, (frame + 1)::INT AS frame, -1 AS track, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h, score FROM v_det"


@add("s03_read_mot", _MOT)
def s03(spark, d):
    """Detection files of all cameras, as many folders as there are cameras (ten)."""
    at = new_path(spark, "mot")
    rows = view(spark, d, "v_det").selectExpr("camera", "frame + 1 as frame", "-1 as track", "x1", "y1", "x2 - x1 as w", "y2 - y1 as h", "score", "-1 as c8", "-1 as c9", "-1 as c10")
    for camera in range(10):
        rows.where(F.col("camera") == camera).drop("camera").write.csv(f"{at}/train/c{camera}/det/det.txt")
    return io.read_mot(spark, at).select("seq", "frame", "track", "x", "y", "w", "h", "score")


@add("s05_processing_times", "SELECT processing_time AS seconds FROM v_hist")
def s05(spark, d):
    rows = view(spark, d, "v_hist").groupBy(F.floor(F.col("event_id") / 1000).alias("part")).agg(F.to_json(F.struct(F.collect_list("processing_time").alias("processing_times"))).alias("value"))
    return io.read_processing_times(spark, _json_folder(rows, new_path(spark, "times")) + "/*")


@add("s06_list_media", "SELECT 'clip' || image_id || CASE WHEN image_id % 3 = 0 THEN '.JPG' ELSE '.png' END AS name, 64::BIGINT AS length FROM v_img WHERE image_id % 3 < 2")
def s06(spark, d):
    at = new_path(spark, "media")
    ending = F.when(F.col("image_id") % 3 == 0, ".JPG").when(F.col("image_id") % 3 == 1, ".png").otherwise(".txt")
    io.write_media(image_rows(spark, d).select(F.concat(F.lit("clip"), F.col("image_id").cast("string"), ending).alias("name"), "data"), at)
    return io.list_media(spark, at, ["jpg", "png"]).select("name", "length")


@add("s07_plate_csv", "SELECT frame AS frame_nmr, car_id, x1, y2, text_score AS license_number_score FROM v_track WHERE frame % 7 > 0")
def s07(spark, d):
    box = F.struct(*BOX)
    rows = view(spark, d, "v_track").select(F.col("frame").alias("frame_nmr"), "car_id", box.alias("car_bbox"), box.alias("license_plate_bbox"), F.lit(0.5).alias("license_plate_bbox_score"), F.when(F.col("frame") % 7 > 0, "AB1234").alias("license_number"), F.col("text_score").alias("license_number_score"))
    at = new_path(spark, "plates")
    io.write_plate_csv(rows, at)
    return io.read_plate_csv(spark, at).select("frame_nmr", "car_id", "car_bbox.x1", "license_plate_bbox.y2", "license_number_score")


@add("s08_write_mot", "SELECT camera AS seq, (frame + 1) || ',' || det_id || ',' || printf('%.2f,%.2f,%.2f,%.2f', x1, y1, x2 - x1, y2 - y1) || ',1,-1,-1,-1' AS value FROM v_det")
def s08(spark, d):
    at = new_path(spark, "tracks")
    io.write_mot(view(spark, d, "v_det").select(F.col("camera").alias("seq"), (F.col("frame") + 1).alias("frame"), F.col("det_id").alias("track_id"), *BOX), at)
    return spark.read.text(at).select(F.col("seq").cast("long").alias("seq"), "value")


@add("s09_append_infractions", "SELECT inf_id, placa, fecha, CASE WHEN inf_id % 2 = 0 THEN '0' ELSE '1' END AS batch FROM v_inf")
def s09(spark, d):
    """Half of the rows, then all of them by key, and both batches again: no row twice."""
    at, rows = new_path(spark, "store"), _records(spark, d)
    for _ in range(2):
        io.append_infractions(rows.where("inf_id % 2 = 0"), at, 0)
        io.append_infractions(rows, at, 1, ["inf_id"])
    return io.read_stored(spark, at).select("inf_id", "placa", "fecha", "batch")


@add("s10_export", "SELECT inf_id, placa, ubicacion, 'csv' AS fmt FROM v_inf UNION ALL SELECT inf_id, placa, ubicacion, 'json' FROM v_inf")
def s10(spark, d):
    at, rows = new_path(spark, "export"), _records(spark, d)
    for fmt in ("csv", "json"):
        io.export(rows, f"{at}-{fmt}", fmt)
    back = [spark.read.schema(rows.schema).option("header", True).csv(f"{at}-csv"), spark.read.schema(rows.schema).json(f"{at}-json")]
    return back[0].select("inf_id", "placa", "ubicacion", F.lit("csv").alias("fmt")).unionByName(back[1].select("inf_id", "placa", "ubicacion", F.lit("json").alias("fmt")))


@add("s11_write_report", _DAYS + " SELECT round(sum(total)::DOUBLE / count(*), 4) AS ti, round(avg(repeated * 100.0::DOUBLE / total), 4) AS ir, 3.5::DOUBLE AS tr FROM c")
def s11(spark, d):
    at = new_path(spark, "report")
    report = indicators.indicator_report(view(spark, d, "v_inf"), _months(spark, d), _survey(spark, d))
    io.write_report(indicators.patch_report_tr(report, 3.5), at)
    value = lambda k: r4(F.get_json_object("value", f"$.indicadores.{k}.con_software.valor").cast("double")).alias(k.lower())
    return spark.read.text(at).select(value("TI"), value("IR"), value("TR"))


@add("i1_stats_of_files", _PX + """ SELECT 'p' || image_id || '.png' AS name, round(mean, 4) AS mean, round(sqrt(list_avg([(x - mean) ** 2 FOR x IN pixels])), 4) AS std, round(var_pop(lap) + 0.00001::DOUBLE, 4) AS sharpness
FROM m JOIN k USING (image_id) GROUP BY image_id, mean, pixels""")
def i1_files(spark, d):
    """Pictures written as files and read through Spark's image source."""
    at = new_path(spark, "pictures")
    io.write_pictures(image_rows(spark, d).withColumn("name", F.concat(F.lit("p"), F.col("image_id").cast("string"), F.lit(".png"))), at)
    stats = images.image_stats(io.read_pictures(spark, at), "name")
    return stats.select("name", r4("mean").alias("mean"), r4("std").alias("std"), r4(F.col("sharpness") + 0.00001).alias("sharpness"))


# --- streams: the tables arrive as files, in one go or in batches -----------------------------
def arriving(spark: SparkSession, rows: DataFrame, files: int = 1, order: str | None = None) -> DataFrame:
    """``rows`` as a stream of ``files`` files, one a batch, in ranges of ``order``."""
    at = new_path(spark, "arriving")
    for i in range(files):
        part = rows if order is None else rows.where(F.col(order) == i).drop(order)
        part.coalesce(1).write.mode("append").parquet(at)
    schema = rows.schema if order is None else rows.drop(order).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)


def settled(df: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream has to say of what is there now."""
    spark = df.sparkSession
    at = new_path(spark, "settled")
    start = df.writeStream.option("checkpointLocation", f"{at}-log").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        query = start.format("parquet").option("path", at).start()
    else:
        query = start.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(at)).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(at)


def _seen(spark, d) -> DataFrame:
    return view(spark, d, "v_hist").select("event_id", F.col("plate_key").alias("plate"), "processing_time", F.col("ts").cast("timestamp").alias("ts"))


@add("r1_live_infractions", f"SELECT det_id, camera, frame FROM ({INFRACTIONS_SQL})")
def r1(spark, d):
    det = arriving(spark, view(spark, d, "v_det"))
    return settled(live.live_infractions(det, view(spark, d, "v_preset"), view(spark, d, "v_area")).select("det_id", "camera", "frame"))


@add("r2_first_sightings", "SELECT DISTINCT plate_key AS plate FROM v_hist")
def r2(spark, d):
    return settled(live.first_sightings(arriving(spark, _seen(spark, d)), late="3650 days").select("plate"))


@add("r3_running_panel", """WITH p AS (SELECT b, plate_key, count(*) AS n, sum(greatest(processing_time, 0.01)) FILTER (WHERE processing_time > 0) AS s, count(*) FILTER (WHERE processing_time > 0) AS k FROM v_hist JOIN range(3) t(b) ON event_id % 3 <= b GROUP BY 1, 2)
SELECT b AS batch, count(*) AS ti, round(coalesce(sum(s) / sum(k), 0), 4) AS tr, round(avg(CASE WHEN n > 1 THEN 100.0::DOUBLE ELSE 0 END), 4) AS ir FROM p GROUP BY b""")
def r3(spark, d):
    """The panel after each of three batches."""
    at = new_path(spark, "panel")
    live.use_state_store(spark)
    live.write_panel(arriving(spark, _seen(spark, d).withColumn("part", (F.col("event_id") % 3).cast("int")), 3, "part"), at, f"{at}-log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/*").where("batch < 3").select(F.col("batch").cast("long").alias("batch"), "ti", r4("tr").alias("tr"), r4("ir").alias("ir"))


@add("r6_online_tracker")
def r6(spark, d):
    """In three batches, the frames of each out of order; equal to the tracker over the table."""
    det = sequences(spark, d).select("camera", "frame", "det_id", *BOX)
    last = det.agg(F.max("frame")).first()[0]
    part = F.least(F.lit(2), F.floor(F.col("frame") * 3 / (last + 1))).cast("int")
    shifted = F.when(F.col("frame") % 5 == 2, F.least(F.lit(2), part + 1)).otherwise(part)
    ends = det.select("camera").distinct().select("camera", F.lit(last * 2 + 10).cast("long").alias("frame"), F.lit(None).cast("long").alias("det_id"), *(F.lit(None).cast("double").alias(c) for c in BOX), F.lit(3).alias("part"))
    live.use_state_store(spark)
    rows = arriving(spark, det.withColumn("part", shifted).unionByName(ends), 4, "part")
    with live.only_with_rows(spark):
        told = settled(live.online_tracker(rows, slack=int(last) + 5))
    return told.where("not late").select("camera", "frame", "track_id", r4("x1").alias("x1"))


@add("r6_late_frames", "SELECT camera, frame + 1 AS frame, count(*) AS n FROM v_det WHERE det_id % 97 = 5 GROUP BY ALL")
def r6_late(spark, d):
    """Rows that come when their frame is over are told as late, not lost."""
    det = sequences(spark, d).select("camera", "frame", "det_id", *BOX)
    ends = det.select("camera").distinct().select("camera", (F.lit(det.agg(F.max("frame")).first()[0]) + 1).alias("frame"), F.lit(None).cast("long").alias("det_id"), *(F.lit(None).cast("double").alias(c) for c in BOX), F.lit(1).alias("part"))
    live.use_state_store(spark)
    rows = arriving(spark, det.withColumn("part", F.when(F.col("det_id") % 97 == 5, 2).otherwise(0)).unionByName(ends), 3, "part")
    with live.only_with_rows(spark):
        told = settled(live.online_tracker(rows))
    return told.where("late").groupBy("camera", "frame").agg(F.count("*").alias("n"))


def _close_sightings(spark, d) -> DataFrame:
    """Twenty sightings a second; every second plate is read with look-alike letters."""
    plate = F.concat(F.lit("B"), F.col("plate_key").cast("string"))
    return view(spark, d, "v_hist").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, plate).otherwise(F.translate(plate, "0158", "OISB")).alias("plate"), F.timestamp_seconds(1_700_000_000 + F.floor(F.col("event_id") / 20)).alias("ts"))


@add("r5_near_duplicates", "WITH s AS (SELECT event_id AS id, plate_key, floor(event_id / 20.0) AS t FROM v_hist) SELECT a.id AS a, b.id AS b, (b.t - a.t)::DOUBLE AS dt FROM s a JOIN s b ON a.plate_key = b.plate_key AND b.t >= a.t AND b.t < a.t + 5 AND (a.t < b.t OR a.id < b.id)")
def r5(spark, d):
    """A stream joined with itself, in three batches that follow each other in time."""
    rows = _close_sightings(spark, d)
    n = rows.agg(F.max("id")).first()[0] + 1
    files = lambda: arriving(spark, rows.withColumn("part", F.floor(F.col("id") * 3 / n).cast("int")), 3, "part")
    return settled(live.near_duplicates(files(), files()))


@add("r7_append", "SELECT event_id, plate_key AS plate FROM v_hist")
def r7(spark, d):
    at = new_path(spark, "live-store")
    live.append_infractions(arriving(spark, _seen(spark, d)), at, f"{at}-log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(at).select("event_id", "plate")


_BATCHES = "SELECT event_id, ts, CASE WHEN event_id % 10 = 0 THEN 3 ELSE least(2, (ntile(3) OVER (ORDER BY ts, event_id)) - 1) END AS batch FROM v_hist"


def _thirds(rows: DataFrame, order: list[str]) -> DataFrame:
    """``third`` 0 to 2 of every row, as ``ntile(3) - 1`` gives it, without one task for all."""
    told = identity.numbered(rows, order, "_n")
    n = told.count()
    few, more = n // 3, n % 3
    at, wide = F.col("_n") - 1, more * (few + 1)
    third = F.when(at < wide, F.floor(at / (few + 1))).otherwise(more + F.floor((at - wide) / max(few, 1)))
    return told.withColumn("third", third.cast("int")).drop("_n")


@add("r8_late_rows", f"WITH b AS ({_BATCHES}), m AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL 1 DAY AS mark FROM b GROUP BY batch) SELECT event_id FROM b JOIN m USING (batch) WHERE ts::DATE::TIMESTAMP + INTERVAL 1 DAY <= mark")
def r8(spark, d):
    """Rows that came after their day was closed, split off a stream of four batches: every
    tenth row arrives last of all."""
    rows = _thirds(_seen(spark, d), ["ts", "event_id"]).withColumn("batch", F.when(F.col("event_id") % 10 == 0, 3).otherwise(F.col("third"))).drop("third")
    at = new_path(spark, "split")
    live.split_late(arriving(spark, rows, 4, "batch"), at, f"{at}-log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/late").select("event_id")


# --- batch twins of the streams ------------------------------------------------------------
add("r4_daily_twin", "SELECT epoch(ts::DATE)::BIGINT AS day, count(*) AS n FROM v_hist GROUP BY 1")(lambda spark, d: live.daily_counts(_seen(spark, d)).select(F.unix_timestamp("day").alias("day"), "n"))
add("r3_running_indicators_twin", "SELECT plate_key AS plate, count(*) AS n, epoch(date_trunc('second', max(ts)))::BIGINT AS last FROM v_hist GROUP BY 1")(lambda spark, d: live.running_indicators(_seen(spark, d)).select("plate", "n", F.unix_timestamp("last").alias("last")))
add("r5_session_twin", """WITH a AS (SELECT plate_key, ts, CASE WHEN coalesce(ts - lag(ts) OVER w >= INTERVAL 1 HOUR, true) THEN 1 ELSE 0 END AS n FROM v_hist WINDOW w AS (PARTITION BY plate_key ORDER BY ts)),
b AS (SELECT *, sum(n) OVER (PARTITION BY plate_key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT plate_key AS plate, epoch(date_trunc('second', min(ts)))::BIGINT AS start, count(*) AS n FROM b GROUP BY plate_key, g""")(lambda spark, d: live.near_time_groups(_seen(spark, d), gap="1 hour").select("plate", F.unix_timestamp("start").alias("start"), "n"))
