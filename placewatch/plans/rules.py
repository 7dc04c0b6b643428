"""Risk and severity rules, kept as named column rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAZARD_TYPES = ("flood", "fire", "roadwork", "incident")   # fixed values

# Validity rules of the two landed feeds.
WEATHER_RULES = {
    "valid_temperature": "temperature_c BETWEEN -50 AND 60",
    "valid_precipitation": "precipitation_mm >= 0 OR precipitation_mm IS NULL",
    "valid_windspeed": "windspeed_kmh >= 0 OR windspeed_kmh IS NULL",
}
WEATHER_WATCHED = {"forecast_recent": "forecast_time IS NOT NULL"}
HAZARD_RULES = {
    "known_hazard_type": "hazard_type IN ('flood', 'fire', 'roadwork', 'incident')",
    "longitude_in_nsw": "longitude IS NULL OR longitude BETWEEN 140.0 AND 154.0",
    "latitude_in_nsw": "latitude IS NULL OR latitude BETWEEN -37.5 AND -28.0",
}
HAZARD_WATCHED = {"has_geometry": "longitude IS NOT NULL AND latitude IS NOT NULL"}
BOX = {"lat": (-37.5, -28.0), "lon": (140.0, 154.0)}


def severity(rule: str = "major_first") -> Column:
    """Hazard score by a named rule.

    ``major_first``: major 3, network 2, else 1. ``kind_first``: flood or fire
    3, network 2, any known type 1, else 0. ``either``: major, flood or fire 3,
    network 2, else 1.
    """
    major, network = F.col("is_major"), F.col("impacting_network")
    grave = F.col("hazard_type").isin("flood", "fire")
    top = {"major_first": major, "kind_first": grave, "either": major | grave}[rule]
    rest = F.when(F.col("hazard_type").isNull(), 0).otherwise(1) if rule == "kind_first" else F.lit(1)
    return F.when(top, 3).when(network, 2).otherwise(rest)


def risk_level(major: str = "major_hazards_count", flood: str = "active_flood_count",
               fire: str = "active_fire_count", total: str = "total_active_hazards") -> Column:
    return (F.when(F.col(major) > 0, "Critical").when(F.col(flood) + F.col(fire) > 0, "High")
            .when(F.col(total) > 0, "Moderate").otherwise("Low"))


def rain_level(mm: str = "precipitation_mm", over: float = 50) -> Column:
    return F.when(F.col(mm) > over, "High").otherwise("Low")
