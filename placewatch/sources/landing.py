"""Landed payload files: reading them in batch or as a stream, and flattening them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import epoch_ms, jsonp_body
from ..functions.geo import PER_DEGREE, cell_id

# Column contracts of the landed files.
WEATHER_SCHEMA = ("location_name string, latitude double, longitude double, forecast_time string, "
                  "precipitation_mm double, windspeed_kmh double, temperature_c double, "
                  "humidity_pct double, weather_code int")
HAZARD_SCHEMA = ("hazard_type string, hazard_id string, main_category string, display_name string, "
                 "headline string, expected_delay_min double, impacting_network boolean, is_major boolean, "
                 "ended boolean, advice_a string, advice_b string, advice_c string, other_advice string, "
                 "created_ms bigint, last_updated_ms bigint, longitude double, latitude double, "
                 "encoded_polylines_json string, roads_json string")
FEATURES_SCHEMA = ("struct<features:array<struct<id:string,"
                   "properties:struct<mainCategory:string,displayName:string,headline:string,expectedDelay:double,"
                   "impactingNetwork:boolean,isMajor:boolean,ended:boolean,adviceA:string,adviceB:string,"
                   "adviceC:string,otherAdvice:string,created:bigint,lastUpdated:bigint,"
                   "encodedPolylines:string,roads:string>,"
                   "geometry:struct<coordinates:array<double>>>>>")
HOURLY = {"time": "forecast_time", "precipitation": "precipitation_mm", "windspeed_10m": "windspeed_kmh",
          "temperature_2m": "temperature_c", "relative_humidity_2m": "humidity_pct", "weather_code": "weather_code"}


def read_landing(spark: SparkSession, path: str, schema: str | T.StructType, streaming: bool = True,
                 multi_line: bool = True, max_files: int | None = None) -> DataFrame:
    """JSON array files under ``path`` (any depth) with file time and path as lineage columns."""
    reader = (spark.readStream if streaming else spark.read).schema(schema)
    reader = reader.option("multiLine", multi_line).option("recursiveFileLookup", True)
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path).select("*", F.col("_metadata.file_modification_time").alias("_ingest_time"),
                                    F.col("_metadata.file_path").alias("_source_file"))


def with_lineage(df: DataFrame, source: str, batch_time: dt.datetime | str | None = None) -> DataFrame:
    """Stamp a batch: one source name and one time for all of its rows."""
    df = df.withColumn("_source", F.lit(source))
    if batch_time is not None:
        return df.withColumn("_ingest_time", F.lit(str(batch_time)).cast("timestamp"))
    return df if "_ingest_time" in df.columns else df.withColumn("_ingest_time", F.current_timestamp())


def weather_bronze(landed: DataFrame, tz: str | None = None) -> DataFrame:
    ts = F.to_timestamp("forecast_time")
    return (landed.withColumn("forecast_time", ts if tz is None else F.to_utc_timestamp(ts, tz))
            .withColumn("_source", F.lit("open-meteo")))


def hazards_bronze(landed: DataFrame, per_degree: int = PER_DEGREE) -> DataFrame:
    return landed.withColumns({
        "created_ts": epoch_ms("created_ms"), "last_updated_ts": epoch_ms("last_updated_ms"),
        "h3_cell": cell_id("longitude", "latitude", per_degree), "_source": F.lit("tfnsw")})


def explode_parallel_arrays(df: DataFrame, col: str, fields: dict[str, str], keep: list[str]) -> DataFrame:
    """A struct of parallel arrays to one row per position; short arrays give NULLs."""
    zipped = F.arrays_zip(*[F.col(f"{col}.{f}").alias(n) for f, n in fields.items()])
    return df.select(*keep, F.inline(zipped))


def flatten_features(df: DataFrame, body: str, kind: str | Column, keep: list[str] | None = None) -> DataFrame:
    """Feature-collection text to one hazard row per feature.

    Absent properties are NULL, an empty headline is NULL, coordinates are
    [lon, lat] and NULL when short, nested lists stay JSON text with all their
    fields in their order.
    """
    kind = F.lit(kind) if isinstance(kind, str) else kind
    parsed = df.select(*(keep or []), kind.alias("hazard_type"), F.from_json(body, FEATURES_SCHEMA).alias("_fc"))
    feats = parsed.select("*", F.explode("_fc.features").alias("f")).drop("_fc")
    p, xy = F.col("f.properties"), F.col("f.geometry.coordinates")
    empty = F.lit("[]")
    return feats.select(
        *(keep or []), "hazard_type", F.col("f.id").alias("hazard_id"),
        p["mainCategory"].alias("main_category"), p["displayName"].alias("display_name"),
        F.nullif(p["headline"], F.lit("")).alias("headline"), p["expectedDelay"].alias("expected_delay_min"),
        p["impactingNetwork"].alias("impacting_network"), p["isMajor"].alias("is_major"), p["ended"].alias("ended"),
        p["adviceA"].alias("advice_a"), p["adviceB"].alias("advice_b"), p["adviceC"].alias("advice_c"),
        p["otherAdvice"].alias("other_advice"), p["created"].alias("created_ms"),
        p["lastUpdated"].alias("last_updated_ms"),
        F.when(F.size(xy) >= 2, xy[0]).alias("longitude"), F.when(F.size(xy) >= 2, xy[1]).alias("latitude"),
        F.coalesce(p["encodedPolylines"], empty).alias("encoded_polylines_json"),
        F.coalesce(p["roads"], empty).alias("roads_json"))


# Fields of a business register answer.
IDENTITY_SCHEMA = ("struct<Abn:string,AbnStatus:string,EntityName:string,EntityTypeName:string,"
                   "AddressState:string,AddressPostcode:string,Message:string>")


def identity(df: DataFrame, asked: str, body: str) -> DataFrame:
    """Register answers (plain or wrapped JSON) to identity columns with an ``error`` text, never a failure."""
    from ..functions.scalars import clean_abn, valid_abn

    abn = clean_abn(asked)
    rec = F.from_json(jsonp_body(body), IDENTITY_SCHEMA)
    df = df.withColumns({"_abn": abn, "_rec": rec})
    got = F.nullif(F.col("_rec.Abn"), F.lit("")).isNotNull()
    error = (F.when(~valid_abn(asked), F.concat(F.lit("Invalid ABN format: '"), F.coalesce(F.col(asked), F.lit("None")),
                                                F.lit("' must be 11 digits")))
             .when(jsonp_body(body).isNull(), F.lit("No JSON object in response"))
             .when(~got, F.coalesce(F.col("_rec.Message"),
                                    F.concat(F.lit("ABN "), F.col("_abn"), F.lit(" not found")))))
    fields = {"entity_name": "EntityName", "abn_status": "AbnStatus", "entity_type": "EntityTypeName",
              "state": "AddressState", "postcode": "AddressPostcode"}
    return (df.withColumn("error", error)
            .withColumns({"abn": F.when(F.col("error").isNull(), F.col("_rec.Abn"))
                          .when(valid_abn(asked), F.col("_abn")).otherwise(F.col(asked)),
                          **{n: F.when(F.col("error").isNull(), F.col(f"_rec.{f}")) for n, f in fields.items()}})
            .drop("_abn", "_rec"))
