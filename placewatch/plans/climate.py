"""Climate projections: loading wide files, model spread, structs per postcode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import PER_DEGREE, cell_id
from ..operators.aggregates import distinct_count, median_then_pivot, spread
from ..operators.history import union_all
from ..operators.reshape import melt_named, pick_column, unpivot_drop_nulls
from .places import BASE_PERIOD, LATE_PERIOD
from .rules import BOX

# The value columns of the wide files and the variables they hold.
TIME_COLUMNS = ["Annual", "DJF", "MAM", "JJA", "SON", "NDJFMA", "MJJASO", "January", "February", "March", "April", "May", "June",
                "July", "August", "September", "October", "November", "December"]
VARIABLES = {"tas": ("mean", "celsius"), "tasmax": ("mean", "celsius"), "tasmin": ("mean", "celsius"),
             "hurs9": ("mean", "percent"), "hurs15": ("mean", "percent"), "pan_evap": ("sum", "mm")}
SERIES = r"^(.+?)_(rcp\d{2})_(\d{4}-\d{4})$"


def long_form(wide: DataFrame, variable: str) -> DataFrame:
    """One variable's wide table (a column per season and month) as rows."""
    aggregation, units = VARIABLES[variable]
    named = {"STATION_NAME": "station_name", "STN_ID": "station_id", "LAT": "lat", "LON": "lon",
             "ENSEMBLE": "ensemble", "RCP": "rcp", "MODEL": "model", "CLIMATOLOGY": "period"}
    values = [c for c in TIME_COLUMNS if c in wide.columns]
    typed = wide.select(*named, *[F.col(c).cast("double") for c in values])
    rows = unpivot_drop_nulls(typed, list(named), values, "time_aggregation", "value")
    return rows.select(
        "STATION_NAME", F.col("STN_ID").cast("string").alias("STN_ID"), F.col("LAT").cast("double").alias("LAT"),
        F.col("LON").cast("double").alias("LON"), "ENSEMBLE", "RCP", "MODEL", "CLIMATOLOGY",
        F.lit(variable).alias("variable"), F.lit(aggregation).alias("aggregation"), F.lit(units).alias("units"),
        "time_aggregation", "value").withColumnsRenamed(named)


def projections(wide: dict[str, DataFrame], box: dict = BOX, per_degree: int = PER_DEGREE) -> DataFrame:
    """All variables in long form, stations inside the box only, with their cell."""
    rows = union_all([long_form(df, v) for v, df in wide.items()])
    inside = rows.where(F.col("lat").between(*box["lat"]) & F.col("lon").between(*box["lon"]))
    return inside.withColumn("h3_cell", cell_id("lon", "lat", per_degree))


def melted(wide: DataFrame, variable: str) -> DataFrame:
    """The other file layout: one column per model, scenario and period."""
    aggregation, unit = VARIABLES[variable]
    station = pick_column(wide, "STATION_NAME", "STATION", "NAME")
    lat, lon = pick_column(wide, "LAT", "LATITUDE"), pick_column(wide, "LON", "LONGITUDE")
    season = next((c for c in wide.columns if c.upper() in ("TIME", "SEASON")), None)
    ids = [c for c in (station, lat, lon, season) if c]
    rows = melt_named(wide, ids, SERIES, ["model", "rcp", "period"])
    return rows.select(
        F.col(station).cast("string").alias("station_name"), F.col(lat).try_cast("double").alias("latitude"),
        F.col(lon).try_cast("double").alias("longitude"), F.lit(variable).alias("variable"),
        (F.col(season).cast("string") if season else F.lit("Annual")).alias("time_aggregation"),
        F.lit(unit).alias("unit"), "model", "rcp", "period", "value")


def model_spread(projected: DataFrame, keys: list[str], exact: bool = False) -> DataFrame:
    """Median, min, max and number of models per key."""
    return spread(projected, keys, "value", "model", 2, exact).withColumnRenamed("n_members", "n_models")


def climate_struct(keys: DataFrame, mapping: DataFrame, projected: DataFrame, exact: bool = False) -> DataFrame:
    """(postcode, result): median yearly temperatures, warming, worst case, models, error text."""
    asked = projected.where(F.col("rcp").isin("rcp45", "rcp85") & F.col("period").isin(BASE_PERIOD, LATE_PERIOD)
                            & (F.col("variable") == "tas") & (F.col("time_aggregation") == "Annual"))
    rcp, period = F.col("rcp"), F.col("period")
    wide = median_then_pivot(asked, ["station_name"], ["rcp", "period"], "value", {
        "now45": (rcp == "rcp45") & (period == BASE_PERIOD), "late45": (rcp == "rcp45") & (period == LATE_PERIOD),
        "late85": (rcp == "rcp85") & (period == LATE_PERIOD)}, exact)
    models = (distinct_count(asked, ["station_name", "rcp", "period"], "model", "n")
              .groupBy("station_name").agg(F.max("n").cast("int").alias("models_n")))
    mapped = mapping.select(F.col("poa_code").alias("postcode"), F.col("nearest_csiro_station").alias("station_name"))
    out = (keys.join(mapped, "postcode", "left")
           .join(wide.join(models, "station_name"), "station_name", "left"))
    error = F.when(F.col("station_name").isNull(),
                   F.concat(F.lit("Postcode "), F.col("postcode"), F.lit(" not found in NSW CSIRO lookup")))
    return out.select("postcode", F.struct(
        F.col("postcode").alias("poa_code"), "station_name", F.round("now45", 2).alias("current_2020s_temp_c"),
        F.round("late45", 2).alias("future_2080s_temp_c"),
        F.round(F.col("late45") - F.col("now45"), 2).alias("warming_delta_c"),
        F.round("late85", 2).alias("worst_case_2080s_rcp85_temp_c"), "models_n", error.alias("error")).alias("result"))
