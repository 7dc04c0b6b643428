"""Structured Streaming forms, run over all input there is and compared with the batch answer."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..plans.rules import HAZARD_RULES, HAZARD_WATCHED, WEATHER_RULES
from ..sources import changes as C
from ..sources import landing as L
from ..sources import sinks as K
from ..streaming import evolve as E
from ..streaming import ingest as I
from .registry import PER_DEGREE, query


def _land(t, df, name, parts=2):
    """Land a table as ``parts`` batches, cut by a hash of the row."""
    root = K.scratch(t.spark, name)
    cut = F.pmod(F.hash(*df.columns), F.lit(parts))
    for i in range(parts):
        K.land(df.where(cut == i), root, name, dt.datetime(2024, 1, 20 + i, 6, 0, 0))
    return root


def _weather_files(t):
    shown = t.weather.withColumn("forecast_time", F.date_format("forecast_time", "yyyy-MM-dd'T'HH:mm")).drop("_ingest_time")
    return _land(t, shown, "weather")


def _whole_sum(t, rows, name):
    """A decimal sum as BIGINT; it stays decimal, and exact, where a BIGINT can't hold it for each of these few rows."""
    path = K.scratch(t.spark, "sums")
    rows.write.parquet(path)
    rows = t.spark.read.schema(rows.schema).parquet(path)
    small = rows.where(F.col(name).isNotNull() & F.col(name).try_cast("long").isNull()).isEmpty()
    return rows.withColumn(name, F.col(name).cast("long")) if small else rows


VALID = "temperature_c BETWEEN -50 AND 60 AND (precipitation_mm >= 0 OR precipitation_mm IS NULL) AND (windspeed_kmh >= 0 OR windspeed_kmh IS NULL)"
PER_STATION = f"""
    SELECT location_name, count(*) AS n, round(sum(precipitation_mm), 2) AS rain, strftime(min(forecast_time), '%Y-%m-%d %H:%M:%S') AS first_time
    FROM weather WHERE {VALID} GROUP BY 1"""


def _per_station(df):
    return df.groupBy("location_name").agg(F.count("*").alias("n"), F.round(F.sum("precipitation_mm"), 2).alias("rain"),
                                           F.min("forecast_time").alias("first_time"))


def _weather_stream(t, root):
    return L.weather_bronze(L.read_landing(t.spark, root, L.WEATHER_SCHEMA, multi_line=False, max_files=1))


def _run(q):
    q.awaitTermination()


@query("SRC-01", PER_STATION, ("weather",))
def weather_stream(t):
    root, out = _weather_files(t), K.scratch(t.spark, "bronze")
    _run(I.ingest(_weather_stream(t, root), f"{out}/rows", f"{out}/checkpoint", WEATHER_RULES))
    return _per_station(t.spark.read.parquet(f"{out}/rows"))


@query("SRC-02", """
    SELECT h3_cell, hazard_type, count(*) AS n, strftime(make_timestamp(max(created_ms) * 1000), '%Y-%m-%d %H:%M:%S') AS created_ts FROM hazards GROUP BY 1, 2""", ("hazards",))
def hazard_stream(t):
    root, out = _land(t, t.hazards_raw.drop("_ingest_time"), "hazards"), K.scratch(t.spark, "bronze")
    stream = L.hazards_bronze(L.read_landing(t.spark, root, L.HAZARD_SCHEMA, multi_line=False), PER_DEGREE)
    _run(I.ingest(stream, f"{out}/rows", f"{out}/checkpoint", HAZARD_RULES))
    return t.spark.read.parquet(f"{out}/rows").groupBy("h3_cell", "hazard_type").agg(F.count("*").alias("n"), F.max("created_ts").alias("created_ts"))


@query("SRC-01-inferred", """
    SELECT location_name, count(*) AS n, count(*) FILTER (weather_code % 2 = 1) AS n_gust, round(sum(CASE WHEN weather_code % 2 = 1 THEN windspeed_kmh * 2 END), 2) AS gust,
      round(sum(CASE WHEN weather_code % 6 <> 3 THEN temperature_c END), 2) AS temperature,
      count(*) FILTER (weather_code % 6 = 3) AS n_rescued, CAST(sum(weather_code) AS BIGINT) AS codes, strftime(min(forecast_time), '%Y-%m-%d %H:%M:%S') AS first_time
    FROM weather GROUP BY 1""", ("weather",))
def weather_inferred(t):
    """No schema is given. Later files have a field more, and text where a number was: the one becomes a column, the other is rescued."""
    root, out = K.scratch(t.spark, "weather"), K.scratch(t.spark, "bronze")
    shown = t.weather.withColumn("forecast_time", F.date_format("forecast_time", "yyyy-MM-dd'T'HH:mm")).drop("_ingest_time")
    gust = shown.withColumn("gust_kmh", F.col("windspeed_kmh") * 2)
    landed = [shown.where("weather_code % 2 = 0"), gust.where("weather_code % 2 = 1 AND weather_code % 6 <> 3"),
              gust.where("weather_code % 6 = 3").withColumn("temperature_c", F.lit("sensor fault"))]
    for i, df in enumerate(landed):
        K.land(df, root, "weather", dt.datetime(2024, 1, 20 + i, 6, 0, 0))
        E.ingest_inferred(t.spark, root, f"{out}/rows", f"{out}/checkpoint", L.weather_bronze, multi_line=False)
    rows = E.read_inferred(t.spark, f"{out}/rows", f"{out}/checkpoint")
    fault = F.get_json_object("_rescued", "$.temperature_c") == "sensor fault"
    return rows.groupBy("location_name").agg(
        F.count("*").alias("n"), F.count("gust_kmh").alias("n_gust"), F.round(F.sum("gust_kmh"), 2).alias("gust"),
        F.round(F.sum("temperature_c"), 2).alias("temperature"), F.count_if(fault).alias("n_rescued"),
        F.sum("weather_code").alias("codes"), F.min("forecast_time").alias("first_time"))


@query("SRC-02-inferred", """
    SELECT hazard_type, count(*) AS n, count(*) FILTER (is_major) AS n_major, count(h3_cell) AS n_placed, CAST(sum(h3_cell) AS BIGINT) AS cells,
      CAST(sum(created_ms) AS BIGINT) AS created, (SELECT count(*) FROM hazards_raw WHERE hazard_type = 'quake') AS dropped
    FROM hazards GROUP BY 1""", ("hazards", "hazards_raw"))
def hazards_inferred(t):
    """JSON arrays over several lines; the types come from the files, the rules are counted while the rows are written."""
    root, out = K.scratch(t.spark, "hazards"), K.scratch(t.spark, "bronze")
    K.land_arrays(t.hazards_raw.drop("_ingest_time"), f"{root}/hazards/2024/01/20")
    E.ingest_inferred(t.spark, root, f"{out}/rows", f"{out}/checkpoint", lambda df: L.hazards_bronze(df, PER_DEGREE), HAZARD_RULES,
                      HAZARD_WATCHED, f"{out}/audit", "hazards")
    dropped = t.spark.read.parquet(f"{out}/audit").where("rule = 'known_hazard_type'").select(F.col("failed").alias("dropped"))
    rows = E.read_inferred(t.spark, f"{out}/rows", f"{out}/checkpoint").groupBy("hazard_type").agg(
        F.count("*").alias("n"), F.count_if("is_major").alias("n_major"), F.count("h3_cell").alias("n_placed"),
        F.sum("h3_cell").alias("cells"), F.sum(F.col("created_ms").cast("decimal(20, 0)")).alias("created"))
    rows = _whole_sum(t, rows, "created")
    return rows.withColumn("dropped", F.lit(sum(r.dropped for r in dropped.collect())).cast("long"))   # a count per micro-batch


@query("SNK-08", """
    SELECT rule, action, CAST(failed AS BIGINT) AS failed FROM (
      SELECT 'known_hazard_type' AS rule, 'drop' AS action, count(*) FILTER (hazard_type = 'quake') AS failed FROM hazards_raw
      UNION ALL SELECT 'longitude_in_nsw', 'drop', count(*) FILTER (longitude NOT BETWEEN 140 AND 154) FROM hazards_raw
      UNION ALL SELECT 'latitude_in_nsw', 'drop', count(*) FILTER (latitude NOT BETWEEN -37.5 AND -28) FROM hazards_raw
      UNION ALL SELECT 'has_geometry', 'allow', count(*) FILTER (longitude IS NULL) FROM hazards_raw)""", ("hazards_raw",))
def counted_rules(t):
    root, out = _land(t, t.hazards_raw.drop("_ingest_time"), "hazards"), K.scratch(t.spark, "bronze")
    stream = L.read_landing(t.spark, root, L.HAZARD_SCHEMA, multi_line=False)
    _run(I.ingest(stream, f"{out}/rows", f"{out}/checkpoint", HAZARD_RULES, HAZARD_WATCHED, f"{out}/audit", "hazards"))
    return t.spark.read.parquet(f"{out}/audit").groupBy("rule", "action").agg(F.sum("failed").alias("failed"))


@query("STR-01", PER_STATION, ("weather",))
def triggered(t):
    """Two runs of the same query: the second one finds only the files landed in between."""
    root, out = K.scratch(t.spark, "weather"), K.scratch(t.spark, "bronze")
    shown = t.weather.withColumn("forecast_time", F.date_format("forecast_time", "yyyy-MM-dd'T'HH:mm")).drop("_ingest_time")
    cut = F.pmod(F.hash(*shown.columns), F.lit(2))
    for i in range(2):
        K.land(shown.where(cut == i), root, "weather", dt.datetime(2024, 1, 20 + i, 6, 0, 0))
        _run(I.ingest(_weather_stream(t, root), f"{out}/rows", f"{out}/checkpoint", WEATHER_RULES))
    return _per_station(t.spark.read.parquet(f"{out}/rows"))


@query("STR-02", """
    SELECT count(*) AS n, true AS same_stamps FROM weather""", ("weather",))
def replayed(t):
    root, out = _weather_files(t), K.scratch(t.spark, "bronze")
    _run(I.ingest(_weather_stream(t, root), f"{out}/first", f"{out}/cp1"))
    _run(I.replay(lambda: _weather_stream(t, root), f"{out}/second", f"{out}/cp2"))
    first, second = t.spark.read.parquet(f"{out}/first"), t.spark.read.parquet(f"{out}/second")
    stamps = ["_source_file", "_ingest_time"]
    both = first.groupBy(*stamps).agg(F.count("*").alias("n")).join(
        second.groupBy(*stamps).agg(F.count("*").alias("m")), stamps, "full_outer")
    return both.agg(F.sum("m").alias("n"), F.coalesce(F.every(F.col("n") == F.col("m")), F.lit(False)).alias("same_stamps"))


@query("STR-03", PER_STATION, ("weather",))
def once_per_file(t):
    root, out = _weather_files(t), K.scratch(t.spark, "bronze")
    for _ in range(3):
        _run(I.ingest(_weather_stream(t, root), f"{out}/rows", f"{out}/checkpoint", WEATHER_RULES))
    return _per_station(t.spark.read.parquet(f"{out}/rows"))


@query("STR-04", """
    SELECT event_type, count(*) AS n, count(*) FILTER (event_type <> 'click') AS n_new, CAST(2 AS BIGINT) AS schema_version FROM events GROUP BY 1""")
def evolved(t):
    """A field appears in files landed later: nobody declares it. The second run meets it, notes the next schema and starts again."""
    root, out = K.scratch(t.spark, "events"), K.scratch(t.spark, "bronze")
    old = t.events.where("event_type = 'click'").select("event_id", "event_type")
    new = t.events.where("event_type <> 'click'").select("event_id", "event_type", F.col("user_id").alias("added"))
    for i, df in enumerate((old, new)):
        K.land(df, root, "events", dt.datetime(2024, 1, 20 + i, 6, 0, 0))
        version = E.ingest_inferred(t.spark, root, f"{out}/rows", f"{out}/checkpoint", multi_line=False)
    rows = E.read_inferred(t.spark, f"{out}/rows", f"{out}/checkpoint")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count("added").alias("n_new"), F.lit(version).cast("long").alias("schema_version"))


def _event_stream(t):
    schema = t.events.schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.root)


@query("STR-05", """
    SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total, max(value) AS top FROM events GROUP BY 1, 2""")
def daily(t):
    out = K.scratch(t.spark, "rollup")
    rolled = I.daily_rollup(_event_stream(t).withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"],
                            {"n": F.count("*"), "total": F.round(F.sum("value"), 2), "top": F.max("value")})
    _run(I.store_rollup(rolled, f"{out}/rows", ["day", "event_type"], f"{out}/checkpoint"))
    return C.read_changes(t.spark, f"{out}/rows")


@query("STR-05-append", """
    SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events
    WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1, 2""")
def closed_days(t):
    """Append form: a day is written once, when the watermark has passed its end."""
    out = K.scratch(t.spark, "rollup")
    rolled = I.daily_rollup(_event_stream(t).withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], {"n": F.count("*")})
    return I.run_to_parquet(rolled, f"{out}/rows", f"{out}/checkpoint")


@query("STR-05-late", """
    SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (
      event_id % 10 = 0 AND date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events WHERE event_id % 10 <> 0) - INTERVAL 1 DAY) AS BIGINT) AS n_late
    FROM events""")
def late_rows(t):
    """One row in ten arrives after the others: what the watermark drops is counted by the flow audit. Each row is a group of its own here."""
    root, out = K.scratch(t.spark, "events"), K.scratch(t.spark, "rollup")
    audit = I.FlowAudit(t.spark, f"{out}/audit", "events")
    for i in range(2):
        # A run per landed file, as a scheduler would start them; the watermark goes on from the checkpoint.
        K.land(t.events.where((F.col("event_id") % 10 == 0) == F.lit(i == 1)), root, "events", dt.datetime(2024, 1, 20 + i, 6, 0, 0))
        stream = L.read_landing(t.spark, root, t.events.schema, multi_line=False).withColumn("ts", F.col("ts").cast("timestamp"))
        rolled = I.daily_rollup(stream, "ts", ["event_id"], {"n": F.count("*")})
        audit.follow(lambda rolled=rolled: I.store_rollup(rolled, f"{out}/rows", ["day", "event_id"], f"{out}/checkpoint"))
    return audit.table().agg(F.sum("rows").alias("n_rows"), F.sum("late").alias("n_late"))


@query("STR-06", """
    SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1""")
def newest_row(t):
    out = K.scratch(t.spark, "latest")
    stream = _event_stream(t).select("user_id", "ts", "event_id", "event_type")
    _run(I.keep_latest(stream, f"{out}/rows", ["user_id"], ["ts", "event_id"], f"{out}/checkpoint"))
    return C.read_changes(t.spark, f"{out}/rows").select("user_id", "event_id", "event_type")
