"""Business products: details, rain risk, identity, look-ups, suppliers, submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clean_abn, contains_ci, padded_code, split_ids, valid_abn
from ..operators.history import freshness, latest_batch, latest_event, latest_per_key, top, top_per_key, upsert
from ..operators.joins import bulk_lookup, join_code, left_with, via_map
from ..sources.landing import identity
from .rules import rain_level

LOOKUP = ["abn", "organisation_name", "status", "entity_type", "state", "postcode"]


def details_rows(businesses: DataFrame, weather_map: DataFrame) -> DataFrame:
    """Business records with the weather location of their postcode (numeric or text codes)."""
    joined = join_code(businesses, weather_map.select("poa_code", "nearest_weather_location"), "postcode", "poa_code")
    return joined.select("abn", "entity_type", "postcode", F.col("nearest_weather_location").alias("location_name"),
                         "ingested_at")


def current_details(history: DataFrame) -> DataFrame:
    return latest_per_key(history, ["abn"], ["ingested_at", "entity_type", "postcode", "location_name"])


def refresh(lookup: DataFrame, arrived: DataFrame, weather_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged look-up table, new detail rows) for a batch of parsed records."""
    newest = ["ingested_at", *[c for c in lookup.columns if c not in ("abn", "ingested_at")]]
    return upsert(lookup, arrived, ["abn"], newest), details_rows(arrived, weather_map)


def rain_risk(businesses: DataFrame, weather_map: DataFrame, weather: DataFrame, at=None,
              collapse: str | None = None) -> DataFrame:
    """Rain level of each business for every forecast row of the newest batch, or one row with the maximum."""
    batch = latest_batch(weather).select("location_name", "precipitation_mm", "windspeed_kmh")
    if collapse == "max":
        batch = batch.groupBy("location_name").agg(F.max("precipitation_mm").alias("precipitation_mm"),
                                                   F.max("windspeed_kmh").alias("windspeed_kmh"))
    mapped = weather_map.select("poa_code", "nearest_weather_location")
    here = join_code(businesses.select("abn", "postcode"), mapped, "postcode", "poa_code", how="inner")
    rows = via_map(batch, here, "nearest_weather_location", "location_name")
    stamp = F.current_timestamp() if at is None else F.lit(str(at)).cast("timestamp")
    return rows.select("abn", "precipitation_mm", "windspeed_kmh", rain_level().alias("risk_level"),
                       stamp.alias("calculation_time"))


def verify(asked: DataFrame, cover: DataFrame, weather_map: DataFrame, climate_map: DataFrame,
           in_region: str = "cells", region: str = "NSW") -> DataFrame:
    """Register answers plus the spatial keys of their postcode.

    ``asked`` holds abn and body. Keys are collected once per postcode asked
    for. ``in_region`` = ``cells`` (the postcode has cells) or ``state``.
    """
    who = identity(asked, "abn", "body").drop("body").withColumn("_code", padded_code("postcode"))
    wanted = who.select(F.col("_code").alias("poa_code")).distinct()
    cells = (cover.select("poa_code", "h3_cell").distinct().join(wanted, "poa_code", "left_semi")
             .groupBy("poa_code").agg(F.array_sort(F.collect_list("h3_cell")).alias("h3_cells")))
    near = weather_map.groupBy("poa_code").agg(F.max("nearest_weather_location").alias("nearest_weather_location"))
    station = climate_map.groupBy("poa_code").agg(F.max("nearest_csiro_station").alias("nearest_csiro_station"))
    out = who
    for dim in (cells, near, station):
        out = left_with(out, dim, {"_code": "poa_code"})
    inside = F.coalesce(F.size("h3_cells") > 0, F.lit(False)) if in_region == "cells" else F.col("state") == region
    return out.select("abn", "entity_name", "abn_status", "entity_type", "state", "postcode", inside.alias("in_nsw"),
                      F.coalesce("h3_cells", F.array().cast("array<bigint>")).alias("h3_cells"),
                      "nearest_weather_location", "nearest_csiro_station", "error")


def search(lookup: DataFrame, term: str, by: str = "abn", k: int = 20) -> DataFrame:
    """First ``k`` businesses with this number, or with this text in the name."""
    if by == "abn":
        found = lookup.where(F.col("abn").cast("string") == clean_abn(F.lit(term)))
    else:
        found = lookup.where(contains_ci("organisation_name", term))
    return top(found.select(*LOOKUP), LOOKUP, k)


def details(current: DataFrame, lookup: DataFrame) -> DataFrame:
    names = lookup.select("abn", "organisation_name", "status", "state")
    return current.join(names, "abn", "left").select(
        "abn", "organisation_name", "status", "entity_type", "state", "postcode", "location_name", "ingested_at")


def fresh(current: DataFrame, now=None, hours: int = 24) -> DataFrame:
    return freshness(current.select("abn", "ingested_at"), "ingested_at", now, hours)


def lookup_list(lists: DataFrame, text: str, lookup: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Comma lists of numbers to (found rows, valid numbers without a row, invalid entries)."""
    parts = lists.select(split_ids(text).alias("p"))
    valid = parts.select(F.explode("p.valid").alias("abn")).select(F.col("abn").cast("long").alias("abn"))
    invalid = parts.select(F.explode("p.invalid").alias("entry"))
    found, missing = bulk_lookup(valid, lookup.select(*LOOKUP), "abn")
    return found, missing, invalid


def known_numbers(df: DataFrame, text: str) -> DataFrame:
    """Rows with the cleaned number and whether it is one."""
    return df.withColumns({"abn_clean": clean_abn(text), "is_valid": valid_abn(text)})


def suppliers(events: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Present supplier list of every user: pairs whose last event is ADD, with the supplier's location."""
    out = latest_event(events, ["user_abn", "supplier_abn"], "added_at", "action").drop("action")
    if current is None:
        return out
    return left_with(out, current.select("abn", "location_name"), {"supplier_abn": "abn"})


def submissions(log: DataFrame, k: int = 20) -> DataFrame:
    """The newest ``k`` submissions of every business."""
    return top_per_key(log, ["abn"], [F.desc("generated_at"), F.desc("id")], k)
