"""Infraction listings and indicators: TI (detections), TR (registration time), IR (repeats)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import clock

DEFAULTS = {"placa": "No identificada", "ubicacion": "Desconocida", "hora": "00:00", "tipo": "Semáforo en rojo", "estado": "Pendiente"}


def parsed_day(col: str = "fecha") -> Column:
    return F.to_date(F.try_to_timestamp(F.col(col), F.lit("dd/MM/yyyy")))


def between_dates(df: DataFrame, a: str, b: str, keep_bad: bool = False) -> DataFrame:
    """Both ends inclusive; dates that do not parse are dropped, or kept for exports."""
    ok = parsed_day().between(F.to_date(F.lit(a)), F.to_date(F.lit(b)))
    return df.where((ok | parsed_day().isNull()) if keep_bad else ok)


def with_defaults(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items() if c in df.columns})


def newest_first(df: DataFrame, *more: str) -> DataFrame:
    return df.orderBy(parsed_day().desc_nulls_last(), F.col("hora").desc_nulls_last(), *more)


def to_record(df: DataFrame, night: bool = False, location: str = "ubicacion", slot: str = "franja_horaria") -> DataFrame:
    """Raw infractions to stored records."""
    return df.select(
        F.col("plate").alias("placa"), F.date_format("event_ts", "dd/MM/yyyy").alias("fecha"), F.date_format("event_ts", "HH:mm:ss").alias("hora"),
        F.when(F.col("video_time").isNotNull(), clock("video_time")).otherwise("00:00").alias("video_timestamp"), F.coalesce(location, F.lit("Desconocida")).alias("ubicacion"),
        F.coalesce(slot, F.lit("No especificada")).alias("franja_horaria"), F.lit(DEFAULTS["tipo"]).alias("tipo"), F.lit(DEFAULTS["estado"]).alias("estado"),
        F.when(F.lit(night), True).alias("modo_nocturno"),
    )


def daily_counts(df: DataFrame) -> DataFrame:
    """``day, total, plate_rows, plates``; rows without a date form the day ``Sin fecha``."""
    per = df.groupBy(F.coalesce("fecha", F.lit("Sin fecha")).alias("day"), "placa").agg(F.count("*").alias("n"))
    return per.groupBy("day").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("placa").isNotNull(), F.col("n")).otherwise(0)).alias("plate_rows"), F.count("placa").alias("plates"), F.count_if(F.col("placa").isNotNull() & (F.col("n") > 1)).alias("repeated"))


def detection_rate(df: DataFrame) -> DataFrame:
    """TI: infractions per active day."""
    return df.agg(F.coalesce(F.try_divide(F.count("*"), F.countDistinct(F.coalesce("fecha", F.lit("Sin fecha")))), F.lit(0.0)).alias("ti"))


def repeat_rate_daily(df: DataFrame) -> DataFrame:
    """IR: mean over days of plates seen again that day per infraction of the day, in percent."""
    return daily_counts(df).agg(F.coalesce(F.avg(F.col("repeated") / F.col("total") * 100), F.lit(0.0)).alias("ir"))


def repeat_rate(df: DataFrame) -> DataFrame:
    """IR of the panel: share of plates seen more than once, in percent."""
    per = df.where("placa is not null").groupBy("placa").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.avg((F.col("n") > 1).cast("int")) * 100, F.lit(0.0)).alias("ir"))


def distinct_plates(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct("placa").alias("plates"))


def plate_history(df: DataFrame, key: str = "plate_key") -> DataFrame:
    """Count, first and last detection, and the last's processing time."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min("ts").alias("first_detection"), F.max("ts").alias("last_detection"), F.max_by("processing_time", F.struct("ts", "event_id")).alias("processing_time"))


def registration_time(df: DataFrame) -> DataFrame:
    """TR: mean positive processing time, at least 0.01; else mean positive delay of
    registration if there is a column ``delay``; 0 without any."""
    t = F.when(F.col("processing_time") > 0, F.col("processing_time"))
    if "delay" in df.columns:
        t = F.coalesce(t, F.when(F.col("delay") > 0, F.col("delay")))
    return df.agg(F.coalesce(F.avg(F.when(t.isNotNull(), F.greatest(t, F.lit(0.01)))), F.lit(0.0)).alias("tr"))


def run_time_per_infraction(runs: DataFrame) -> DataFrame:
    return runs.withColumn("per_infraction", F.coalesce(F.try_divide("seconds", "infractions"), F.lit(0.0)))


def baseline(monthly: DataFrame, survey: DataFrame) -> DataFrame:
    """Manual indicators from monthly totals and survey minutes."""
    m = monthly.agg((F.sum("total") / F.sum("dias")).alias("ti"), (F.sum("reincidentes") / F.sum("total") * 100).alias("ir"))
    # Two one-row tables.
    return m.withColumn("k", F.lit(1)).join(survey.agg((F.avg("minutes") * 60).alias("tr")).withColumn("k", F.lit(1)), "k").select("ti", "tr", "ir")


def compare(df: DataFrame, system: str, base: str) -> DataFrame:
    """Change in percent and ratio; 0 where the divisor is 0."""
    safe = lambda x: F.coalesce(x, F.lit(0.0))
    return df.withColumns({
        "improvement": safe(F.try_divide(F.col(system) - F.col(base), F.col(base)) * 100), "reduction": safe(F.try_divide(F.col(base) - F.col(system), F.col(base)) * 100),
        "speed_up": safe(F.try_divide(F.col(base), F.col(system))), "ratio": safe(F.try_divide(F.col(system), F.col(base))),
    })


def indicator_report(df: DataFrame, monthly: DataFrame, survey: DataFrame, seconds: float = 9.5) -> DataFrame:
    """One nested row: period, and TI, TR, IR with baseline, system and comparison."""
    one = lambda x: x.withColumn("k", F.lit(1))
    system = one(detection_rate(df)).join(one(repeat_rate_daily(df)), "k").join(one(df.agg(F.min(parsed_day()).alias("first_day"), F.max(parsed_day()).alias("last_day"), F.count("*").alias("n"))), "k").withColumn("tr", F.lit(float(seconds)))
    base = baseline(monthly, survey).select(F.lit(1).alias("k"), F.col("ti").alias("bti"), F.col("tr").alias("btr"), F.col("ir").alias("bir"))
    rows = system.join(base, "k")

    def branch(name: str) -> Column:
        s, b = F.col(name), F.col(f"b{name}")
        return F.struct(F.struct(b.alias("valor")).alias("sin_software"), F.struct(s.alias("valor"), F.coalesce(F.try_divide(s - b, b) * 100, F.lit(0.0)).alias("mejora"), F.coalesce(F.try_divide(b, s), F.lit(0.0)).alias("factor")).alias("con_software"))

    return rows.select(
        F.struct(F.date_format("first_day", "dd/MM/yyyy").alias("inicio"), F.date_format("last_day", "dd/MM/yyyy").alias("fin")).alias("periodo"),
        F.struct(branch("ti").alias("TI"), branch("tr").alias("TR"), branch("ir").alias("IR")).alias("indicadores"),
        F.format_string("%d infracciones, TI %.2f", "n", "ti").alias("resumen_global"),
    )


def patch_report_tr(report: DataFrame, seconds: float) -> DataFrame:
    return report.withColumn("indicadores", F.col("indicadores").withField("TR.con_software.valor", F.lit(float(seconds))))


def daily_sketches(df: DataFrame, keys: list[str], day: str = "fecha", plate: str = "placa", bits: int = 14) -> DataFrame:
    """``sketch``: a mergeable sketch of the distinct plates of each day and ``keys``; some
    kilobytes each, however many rows. To be stored, and read by :func:`plates_from_sketches`."""
    return df.where(F.col(plate).isNotNull()).groupBy(*keys, day).agg(F.hll_sketch_agg(plate, bits).alias("sketch"))


def plates_from_sketches(sketches: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """``plates``: about how many distinct plates there were, over whatever days and keys the
    rows hold (error below 2 % at 14 bits), from the sketches alone."""
    return sketches.groupBy(*keys).agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("plates"))
