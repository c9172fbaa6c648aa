"""Fixture views over the given tables, in SQL that Spark and DuckDB share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Restricted areas by camera: vertices (x, y). Camera 3's is concave.
AREAS = {
    0: [(20, 20), (300, 10), (310, 220), (10, 240)], 1: [(0, 0), (200, 0), (200, 150), (0, 150)], 2: [(50, 40), (350, 60), (300, 260), (80, 200)],
    3: [(10, 10), (300, 10), (150, 100), (300, 240), (10, 240)], 4: [(100, 50), (250, 50), (250, 200), (100, 200)], 5: [(0, 100), (400, 100), (400, 300), (0, 300)],
    6: [(60, 0), (320, 80), (200, 280)], 7: [(37, 53), (260, 30), (330, 250), (40, 270)],
}

_BASE = "chr(CAST(65 + o_custkey % 26 AS INT)) || chr(CAST(65 + (o_custkey * 7) % 26 AS INT)) || lpad(CAST((o_custkey * 13) % 10000 AS VARCHAR(8)), 4, '0')"

VIEWS = {
    "v_det": """SELECT event_id AS det_id, user_id % 10 AS camera, CAST(floor(event_id / 50) AS BIGINT) AS frame,
        CAST((event_id * 37) % 300 AS DOUBLE) AS x1, CAST((event_id * 53 + user_id * 11) % 200 AS DOUBLE) AS y1,
        CAST((event_id * 37) % 300 + 40 + (event_id % 7) * 20 AS DOUBLE) AS x2, CAST((event_id * 53 + user_id * 11) % 200 + 20 + (user_id % 5) * 15 AS DOUBLE) AS y2,
        CAST((20 + (event_id * 29) % 80) AS DOUBLE) / 100 AS score,
        CASE event_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 5 WHEN 4 THEN 7 ELSE 2 END AS class_id FROM {events}""",
    "v_preset": """SELECT s_suppkey AS camera, 8 + s_suppkey % 5 AS green, 2 AS yellow, 6 + s_suppkey % 4 AS red,
        CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'tarde' END AS time_slot FROM {supplier} WHERE s_suppkey < 8""",
    "v_avenue": "SELECT s_suppkey AS camera, s_name AS avenue FROM {supplier} WHERE s_suppkey < 9",
    "v_reads": f"""SELECT o_orderkey AS read_id, o_custkey % 10 AS camera, CAST(o_orderkey % 7200 AS DOUBLE) / 10 AS t, CAST(floor(o_orderkey / 5) AS BIGINT) AS crop_id,
        CAST(50 + (o_orderkey * 31) % 50 AS DOUBLE) / 100 AS conf, o_custkey % 400 AS vehicle,
        CASE o_orderkey % 5 WHEN 0 THEN {_BASE} WHEN 1 THEN translate({_BASE}, '0158', 'OISB') WHEN 2 THEN substr({_BASE}, 1, 2) || '-' || substr({_BASE}, 3)
        WHEN 3 THEN lower(' ' || {_BASE}) ELSE substr({_BASE}, 1, 5) END AS text, CAST((o_orderkey * 17) % 900 AS DOUBLE) AS sharpness FROM {{orders}}""",
    "v_track": """SELECT user_id AS car_id, CAST(floor(event_id / 50) AS BIGINT) AS frame, CAST(max((event_id * 37) % 1200) AS DOUBLE) AS x1, CAST(max((event_id * 53) % 600) AS DOUBLE) AS y1,
        CAST(max((event_id * 37) % 1200) + 80 AS DOUBLE) AS x2, CAST(max((event_id * 53) % 600) + 40 AS DOUBLE) AS y2, CAST(max((event_id * 29) % 100) AS DOUBLE) / 100 AS text_score
        FROM {events} GROUP BY user_id, floor(event_id / 50)""",
    "v_inf": """SELECT o_orderkey AS inf_id, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE 'P-' || CAST(o_custkey % 400 AS VARCHAR(8)) END AS placa,
        CASE WHEN o_orderkey % 101 = 0 THEN 'sin dato' ELSE {day} END AS fecha,
        lpad(CAST(o_orderkey % 24 AS VARCHAR(8)), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR(8)), 2, '0') || ':00' AS hora,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE n_name END AS ubicacion
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    "v_hist": "SELECT event_id, user_id AS plate_key, value - 20 AS processing_time, ts FROM {events}",
    "v_vec": "SELECT vec_id, embedding AS features, vec_id % 5 AS camera, CAST(vec_id AS DOUBLE) / 10 AS t FROM {embeddings}",
}
_DAY = {"spark": "date_format(o_orderdate, 'dd/MM/yyyy')", "duckdb": "strftime(o_orderdate, '%d/%m/%Y')"}
_TABLES = re.compile(r"\{(events|supplier|orders|customer|nation|embeddings)\}")


def _area(engine: str) -> str:
    if engine == "duckdb":
        return " UNION ALL ".join(f"SELECT {c}::BIGINT AS camera, {[{'x': float(x), 'y': float(y)} for x, y in p]} AS poly" for c, p in AREAS.items())
    point = lambda x, y: f"named_struct('x', {x}D, 'y', {y}D)"
    return " UNION ALL ".join(f"SELECT CAST({c} AS BIGINT) AS camera, array({', '.join(point(*v) for v in p)}) AS poly" for c, p in AREAS.items())


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "v_area":
        return spark.sql(_area("spark"))
    if name == "v_img":
        from pyspark.sql import functions as F

        level = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 100 * x.cast("double")).cast("int"))).cast("double")
        return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), F.transform("embedding", level).alias("pixels"))
    text = VIEWS[name].replace("{day}", _DAY["spark"])
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(_TABLES.findall(text))}
    if name == "v_track":
        # What is asked of tracks is asked by car: two columns are sent once, not wide rows twice.
        tables["events"] = tables["events"].select("event_id", "user_id").repartition("user_id")
    return spark.sql(text, **tables)


def with_views(sql: str) -> str:
    """Put the views that ``sql`` names before it, for DuckDB."""
    all_views = {n: _TABLES.sub(r"\1", t.replace("{day}", _DAY["duckdb"])) for n, t in VIEWS.items()}
    all_views["v_area"] = _area("duckdb")
    all_views["v_img"] = "SELECT vec_id AS image_id, [greatest(0, least(255, floor(128 + 100 * x::DOUBLE)))::DOUBLE FOR x IN embedding] AS pixels FROM embeddings"
    used = [n for n in all_views if re.search(rf"\b{n}\b", sql)]
    views = ", ".join(f"{n} AS ({all_views[n]})" for n in used)
    rest = sql.strip()
    if not views:
        return rest
    if rest.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views}, {rest[15:]}"
    return f"WITH {views}, {rest[5:]}" if rest.upper().startswith("WITH ") else f"WITH {views} {rest}"
