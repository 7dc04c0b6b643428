"""Standing questions over the current and history tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.history import top
from ..operators.trends import against_trailing, days_with, level_against_period, trend


def summary(gold: DataFrame) -> DataFrame:
    return gold.agg(
        F.count("*").alias("total_postcodes"), F.countDistinct("weather_station_name").alias("distinct_weather_stations"),
        F.countDistinct("nearest_csiro_station").alias("distinct_csiro_stations"),
        F.sum("total_active_hazards").alias("total_active_hazards"),
        F.count_if(F.col("risk_level") == "Critical").alias("critical_postcodes"),
        F.count_if(F.col("risk_level") == "High").alias("high_risk_postcodes"),
        F.count_if(F.col("total_active_hazards") == 0).alias("quiet_postcodes"),
        F.round(F.avg("current_temperature_c"), 4).alias("avg_temperature_c"))


def most_warming(gold: DataFrame, k: int = 10) -> DataFrame:
    return top(gold.where("warming_2080s_rcp85_c IS NOT NULL").select(
        "postcode", "weather_station_name", "nearest_csiro_station",
        F.round("climate_temp_2020s", 2).alias("temp_2020s"),
        F.round("climate_temp_2080s_rcp85", 2).alias("temp_2080s_high"),
        F.round("warming_2080s_rcp85_c", 2).alias("warming_c")), [F.desc("warming_c"), "postcode"], k)


def most_hazards(gold: DataFrame, k: int = 20) -> DataFrame:
    return top(gold.where("total_active_hazards > 0").select(
        "postcode", "risk_level", "active_flood_count", "active_fire_count", "active_roadwork_count",
        "active_incident_count", "major_hazards_count", "total_active_hazards"),
        [F.desc("major_hazards_count"), F.desc("total_active_hazards"), "postcode"], k)


def flooded_and_major(gold: DataFrame) -> DataFrame:
    return gold.where("active_flood_count > 0 AND major_hazards_count > 0").select(
        "postcode", "active_flood_count", "major_hazards_count")


def flooded_now(gold: DataFrame) -> DataFrame:
    return gold.where("active_flood_count > 0").select("postcode", "active_flood_count", "risk_level")


def warming_above(gold: DataFrame, degrees: float = 3.0) -> DataFrame:
    return gold.where(F.col("warming_2080s_rcp85_c") > degrees).select(
        "postcode", "nearest_csiro_station", F.round("warming_2080s_rcp85_c", 2).alias("warming_c"))


def most_roadworks(gold: DataFrame, k: int = 1) -> DataFrame:
    return top(gold.where("active_roadwork_count > 0").select("postcode", "active_roadwork_count"),
               [F.desc("active_roadwork_count"), "postcode"], k)


def weather_of_places(gold: DataFrame) -> DataFrame:
    """Current weather by place; the caller filters by postcode."""
    return gold.select("postcode", "weather_station_name", "weather_observed_at", "current_temperature_c", "current_precipitation_mm",
                       "current_windspeed_kmh")


def decades_of_places(gold: DataFrame) -> DataFrame:
    """2020s against 2080s under the high scenario by place; the caller filters by postcode."""
    return gold.select("postcode", "nearest_csiro_station", F.round("climate_temp_2020s", 2).alias("temp_2020s"),
                       F.round("climate_temp_2080s_rcp85", 2).alias("temp_2080s_high"),
                       F.round("warming_2080s_rcp85_c", 2).alias("warming_c"))


def hazard_trend(history: DataFrame, days: int = 7, today=None) -> DataFrame:
    return trend(history, ["postcode"], "snapshot_date", "total_active_hazards", days, today)


def critical_lately(history: DataFrame, days: int = 7, today=None) -> DataFrame:
    end = F.lit(today).cast("date") if today is not None else history.agg(F.max("snapshot_date")).scalar()
    recent = history.where(F.col("snapshot_date") > F.date_sub(end, days))
    return days_with(recent, ["postcode"], "snapshot_date", F.col("risk_level") == "Critical")


def often_flooded(history: DataFrame, more_than: int = 3, days: int = 30, today=None) -> DataFrame:
    end = F.lit(today).cast("date") if today is not None else history.agg(F.max("snapshot_date")).scalar()
    recent = history.where(F.col("snapshot_date") > F.date_sub(end, days))
    return days_with(recent, ["postcode"], "snapshot_date", F.col("active_flood_count") > 0, more_than)


def today_against_month(history: DataFrame, days: int = 30) -> DataFrame:
    """Daily total over all places next to the mean of the days before."""
    daily = history.groupBy("state", "snapshot_date").agg(F.sum("total_active_hazards").alias("total_active_hazards"))
    return against_trailing(daily, ["state"], "snapshot_date", "total_active_hazards", days)


def wettest_day(history: DataFrame, days: int = 30, today=None) -> DataFrame:
    end = F.lit(today).cast("date") if today is not None else history.agg(F.max("snapshot_date")).scalar()
    return (history.where(F.col("snapshot_date") > F.date_sub(end, days)).groupBy("postcode")
            .agg(F.max("daily_total_rain_mm").alias("max_daily_rain_mm")))


def current_against_week(gold: DataFrame, history: DataFrame, start, end) -> DataFrame:
    now = gold.select("postcode", "risk_level", "total_active_hazards")
    return level_against_period(now, history, "postcode", "snapshot_date", "total_active_hazards", start, end)
