"""Per-place products: weather, hazards, current and history tables, structs, snapshot, map."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..plans import analyst, climate, places
from ..plans.industry import industry_context, industry_struct
from .registry import NEEDS, NOW, PER_DEGREE, SQL_ONLY, query

AT = "TIMESTAMP '2024-01-20 12:00:00'"

SQL_ONLY["weather_current"] = f"""
    SELECT c.*, n.* EXCLUDE (loc) FROM
      (SELECT location_name, latitude, longitude, forecast_time AS current_observed_at, temperature_c AS current_temperature_c,
              precipitation_mm AS current_precipitation_mm, windspeed_kmh AS current_windspeed_kmh,
              humidity_pct AS current_humidity_pct, weather_code AS current_weather_code
       FROM (SELECT *, row_number() OVER (PARTITION BY location_name ORDER BY abs(epoch_us(forecast_time) - epoch_us({AT})),
               forecast_time, temperature_c NULLS FIRST, precipitation_mm NULLS FIRST, windspeed_kmh, humidity_pct, weather_code) AS rn
             FROM weather_now) WHERE rn = 1) c
    LEFT JOIN (SELECT location_name AS loc, max(temperature_c) AS next_24h_max_temp_c, min(temperature_c) AS next_24h_min_temp_c,
              round(sum(precipitation_mm), 2) AS next_24h_total_rain_mm, max(windspeed_kmh) AS next_24h_max_wind_kmh,
              round(avg(humidity_pct), 1) AS next_24h_avg_humidity_pct
       FROM weather_now WHERE forecast_time >= {AT} AND forecast_time < {AT} + INTERVAL 24 HOUR GROUP BY 1) n ON n.loc = c.location_name
    WHERE current_temperature_c IS NULL OR current_temperature_c BETWEEN -50 AND 60"""
SQL_ONLY["scored"] = """
    SELECT *, CASE WHEN is_major THEN 3 WHEN impacting_network THEN 2 ELSE 1 END AS severity_score FROM active"""
SQL_ONLY["hazard_agg"] = """
    SELECT p.poa_code, count(DISTINCT p.h3_cell) AS h3_cells_count,
           count(DISTINCT CASE WHEN hazard_type = 'flood' THEN h.h3_cell END) AS active_flood_count,
           count(DISTINCT CASE WHEN hazard_type = 'fire' THEN h.h3_cell END) AS active_fire_count,
           count(DISTINCT CASE WHEN hazard_type = 'roadwork' THEN h.h3_cell END) AS active_roadwork_count,
           count(DISTINCT CASE WHEN hazard_type = 'incident' THEN h.h3_cell END) AS active_incident_count,
           count(DISTINCT CASE WHEN is_major THEN h.h3_cell END) AS major_hazards_count,
           count(DISTINCT h.h3_cell) AS total_active_hazards, coalesce(max(severity_score), 0) AS max_severity_score
    FROM cover p LEFT JOIN scored h ON p.h3_cell = h.h3_cell GROUP BY 1"""
SQL_ONLY["climate_wide"] = """
    SELECT m.poa_code, m.nearest_csiro_station,
           max(value) FILTER (period = '2020-2039' AND rcp = 'rcp45') AS climate_temp_2020s,
           max(value) FILTER (period = '2080-2099' AND rcp = 'rcp45') AS climate_temp_2080s_rcp45,
           max(value) FILTER (period = '2080-2099' AND rcp = 'rcp85') AS climate_temp_2080s_rcp85
    FROM climate_map m LEFT JOIN projections p ON p.station_name = m.nearest_csiro_station AND variable = 'tas'
      AND aggregation = 'mean' AND time_aggregation = 'Annual' GROUP BY 1, 2"""
LEVEL = """CASE WHEN major_hazards_count > 0 THEN 'Critical' WHEN active_flood_count + active_fire_count > 0 THEN 'High'
                WHEN total_active_hazards > 0 THEN 'Moderate' ELSE 'Low' END"""
SQL_ONLY["gold"] = f"""
    SELECT a.poa_code AS postcode, 'NSW' AS state, h3_cells_count, m.nearest_weather_location AS weather_station_name,
           current_temperature_c, current_precipitation_mm, current_windspeed_kmh, current_weather_code,
           strftime(current_observed_at, '%Y-%m-%d %H:%M:%S') AS weather_observed_at, next_24h_max_temp_c, next_24h_min_temp_c,
           next_24h_total_rain_mm, next_24h_max_wind_kmh, active_flood_count, active_fire_count, active_roadwork_count,
           active_incident_count, major_hazards_count, total_active_hazards, max_severity_score, {LEVEL} AS risk_level,
           nearest_csiro_station, climate_temp_2020s, climate_temp_2080s_rcp45, climate_temp_2080s_rcp85,
           climate_temp_2080s_rcp85 - climate_temp_2020s AS warming_2080s_rcp85_c
    FROM hazard_agg a LEFT JOIN weather_map m ON m.poa_code = a.poa_code
    LEFT JOIN weather_current w ON w.location_name = m.nearest_weather_location
    LEFT JOIN climate_wide c ON c.poa_code = a.poa_code"""
SQL_ONLY["gold_days"] = f"""
    SELECT postcode, 'NSW' AS state, snapshot_date, weather_station_name, coalesce(f, 0) AS active_flood_count,
           coalesce(fi, 0) AS active_fire_count, coalesce(r, 0) AS active_roadwork_count, coalesce(i, 0) AS active_incident_count,
           coalesce(m, 0) AS major_hazards_count, coalesce(n, 0) AS total_active_hazards,
           CASE WHEN coalesce(m, 0) > 0 THEN 'Critical' WHEN coalesce(f, 0) + coalesce(fi, 0) > 0 THEN 'High'
                WHEN coalesce(n, 0) > 0 THEN 'Moderate' ELSE 'Low' END AS risk_level,
           daily_avg_temp_c, daily_max_temp_c, daily_min_temp_c, daily_total_rain_mm, daily_max_wind_kmh
    FROM (SELECT coalesce(h.poa_code, w.poa_code) AS postcode, coalesce(h.d, w.d) AS snapshot_date, h.*, w.* FROM
      (SELECT poa_code, CAST(_ingest_time AS DATE) AS d, count(DISTINCT CASE WHEN hazard_type = 'flood' THEN hazard_id END) AS f,
              count(DISTINCT CASE WHEN hazard_type = 'fire' THEN hazard_id END) AS fi,
              count(DISTINCT CASE WHEN hazard_type = 'roadwork' THEN hazard_id END) AS r,
              count(DISTINCT CASE WHEN hazard_type = 'incident' THEN hazard_id END) AS i,
              count(DISTINCT CASE WHEN is_major THEN hazard_id END) AS m, count(DISTINCT hazard_id) AS n
       FROM cover JOIN hazards USING (h3_cell) WHERE ended = false GROUP BY 1, 2) h
      FULL JOIN (SELECT m.poa_code, nearest_weather_location AS weather_station_name, x.* EXCLUDE (location_name) FROM weather_map m JOIN
        (SELECT location_name, CAST(_ingest_time AS DATE) AS d, round(avg(temperature_c), 1) AS daily_avg_temp_c,
                max(temperature_c) AS daily_max_temp_c, min(temperature_c) AS daily_min_temp_c,
                round(sum(precipitation_mm), 2) AS daily_total_rain_mm, max(windspeed_kmh) AS daily_max_wind_kmh
         FROM weather GROUP BY 1, 2) x ON x.location_name = m.nearest_weather_location) w
      ON h.poa_code = w.poa_code AND h.d = w.d)"""
NEEDS.update({"weather_current": ["weather_now"], "scored": ["active"], "hazard_agg": ["cover", "scored"],
              "climate_wide": ["climate_map", "projections"],
              "gold": ["hazard_agg", "weather_map", "weather_current", "climate_wide"],
              "gold_days": ["cover", "hazards", "weather_map", "weather"]})


def gold(t):
    return places.gold_current(t.weather, t.hazards, t.cover, t.weather_map, t.climate_map, t.projections, NOW)


def gold_days(t):
    return places.gold_history(t.weather, t.hazards, t.cover, t.weather_map)


@query("Q-01", "SELECT * REPLACE (strftime(current_observed_at, '%Y-%m-%d %H:%M:%S') AS current_observed_at) FROM weather_current",
       ("weather_current",))
def weather_now(t):
    return places.weather_current(t.weather, NOW)


@query("Q-01-events", """
    SELECT c.user_id, event_id, n, total FROM (SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY
        abs(epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-20 12:00:00')), ts, event_id) AS rn FROM events) WHERE rn = 1) c
    LEFT JOIN (SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00'
        AND ts < TIMESTAMP '2024-01-21 12:00:00' GROUP BY 1) x ON x.user_id = c.user_id""")
def user_now(t):
    c = H.nearest_in_time(t.events, ["user_id"], "ts", NOW, "nearest", ["event_id"]).select("user_id", "event_id")
    ahead = H.time_window(t.events, "ts", NOW, 24).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return c.join(ahead, "user_id", "left")


@query("Q-02", """
    SELECT hazard_type, hazard_id, main_category, display_name, headline, is_major, impacting_network, severity_score, h3_cell,
           round(longitude, 4) AS longitude, strftime(make_timestamp(last_updated_ms * 1000), '%Y-%m-%d %H:%M:%S') AS last_updated_ts
    FROM scored""", ("scored",))
def hazards_now(t):
    return places.hazards_current(t.hazards).select(
        "hazard_type", "hazard_id", "main_category", "display_name", "headline", "is_major", "impacting_network", "severity_score",
        "h3_cell", F.round("longitude", 4).alias("longitude"), "last_updated_ts")


@query("Q-03", "SELECT * FROM gold", ("gold",))
def current_table(t):
    return gold(t)


@query("Q-04", "SELECT * REPLACE (strftime(snapshot_date, '%Y-%m-%d') AS snapshot_date) FROM gold_days", ("gold_days",))
def history_table(t):
    return gold_days(t)


@query("Q-05", f"""
    WITH lw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY location_name ORDER BY forecast_time DESC,
        temperature_c NULLS FIRST, precipitation_mm NULLS FIRST, windspeed_kmh, humidity_pct, weather_code) AS rn FROM weather_now
        WHERE forecast_time <= {AT}) WHERE rn = 1)
    SELECT a.poa_code AS postcode, 'NSW' AS state, h3_cells_count, m.nearest_weather_location AS weather_station_name,
           temperature_c AS current_temperature_c, precipitation_mm AS current_precipitation_mm, windspeed_kmh AS current_windspeed_kmh,
           weather_code AS current_weather_code, strftime(forecast_time, '%Y-%m-%d %H:%M:%S') AS weather_observed_at,
           active_flood_count, active_fire_count, active_roadwork_count, active_incident_count, major_hazards_count,
           total_active_hazards, {LEVEL} AS risk_level, nearest_csiro_station, climate_temp_2020s, climate_temp_2080s_rcp45,
           climate_temp_2080s_rcp85, climate_temp_2080s_rcp85 - climate_temp_2020s AS warming_2080s_rcp85_c
    FROM hazard_agg a LEFT JOIN weather_map m ON m.poa_code = a.poa_code
    LEFT JOIN lw ON lw.location_name = m.nearest_weather_location LEFT JOIN climate_wide c ON c.poa_code = a.poa_code""",
       ("hazard_agg", "weather_map", "weather_now", "climate_wide"))
def small_view(t):
    return places.gold_view(t.weather, t.hazards, t.cover, t.weather_map, t.climate_map, t.projections, NOW)


@query("Q-09", f"""
    WITH h AS (SELECT *, row_number() OVER (PARTITION BY location_name ORDER BY forecast_time, temperature_c NULLS FIRST,
                 precipitation_mm, windspeed_kmh) AS rn FROM weather_now
               WHERE forecast_time >= {AT} AND forecast_time < {AT} + INTERVAL 24 HOUR),
    s AS (SELECT location_name, max(precipitation_mm) AS r, max(windspeed_kmh) AS w, count(*) FILTER (rn <= 12) AS n,
                 string_agg(concat_ws(' ', strftime(forecast_time, '%d %H:%M'), coalesce(CAST(CAST(round(temperature_c * 1000) AS BIGINT) AS VARCHAR), '-'), coalesce(CAST(CAST(round(precipitation_mm * 1000) AS BIGINT) AS VARCHAR), '-'), coalesce(CAST(CAST(round(windspeed_kmh * 1000) AS BIGINT) AS VARCHAR), '-')), ',' ORDER BY rn) FILTER (rn <= 12) AS times FROM h GROUP BY 1)
    SELECT k.poa_code AS postcode, m.nearest_weather_location AS forecast_location, coalesce(n, 0) AS n, coalesce(times, '') AS times,
           r AS max_rain_24h_mm, w AS max_wind_24h_kmh,
           CASE WHEN m.nearest_weather_location IS NULL THEN 'Postcode ' || k.poa_code || ' not found in NSW weather lookup' END AS error
    FROM (SELECT DISTINCT poa_code FROM cover UNION ALL SELECT 'x9999') k LEFT JOIN weather_map m ON m.poa_code = k.poa_code
    LEFT JOIN s ON s.location_name = m.nearest_weather_location""", ("cover", "weather_map", "weather_now"))
def forecast_structs(t):
    extra = t.spark.createDataFrame([("x9999",)], "postcode string")
    keys = t.cover.select(F.col("poa_code").alias("postcode")).distinct().unionByName(extra)
    out = places.weather_struct(keys, t.weather, t.weather_map, NOW).select("postcode", "result.*")
    return out.select("postcode", "forecast_location", F.size("next_12h").cast("long").alias("n"),
                      F.array_join(F.transform("next_12h", lambda x: F.concat_ws(" ", F.date_format(x["forecast_time"], "dd HH:mm"), *[
                          F.coalesce(F.round(x[f] * 1000).cast("long").cast("string"), F.lit("-")) for f in ("temp_c", "rain_mm", "wind_kmh")])), ",").alias("times"),
                      "max_rain_24h_mm", "max_wind_24h_kmh", "error")


@query("Q-10", """
    WITH b AS (SELECT * FROM hazards WHERE _ingest_time = (SELECT max(_ingest_time) FROM hazards) AND h3_cell IS NOT NULL),
    m AS (SELECT poa_code, b.*, row_number() OVER (PARTITION BY poa_code ORDER BY impacting_network DESC NULLS LAST,
            last_updated_ms DESC NULLS LAST, hazard_id) AS rn FROM cover JOIN b USING (h3_cell)),
    s AS (SELECT poa_code, count(*) AS n, string_agg(concat_ws(' ', hazard_type, coalesce(display_name, '-'), advice_a, main_category, CAST(CAST(round(expected_delay_min * 1000) AS BIGINT) AS VARCHAR),
              coalesce(CAST(impacting_network AS VARCHAR), '-'), coalesce(CAST(last_updated_ms AS VARCHAR), '-')), ',' ORDER BY rn) FILTER (rn <= 20) AS list FROM m GROUP BY 1)
    SELECT k.poa_code AS postcode, coalesce(n, 0) AS hazard_count, coalesce(list, '') AS list,
           CASE WHEN k.poa_code = 'x9999' THEN 'Postcode x9999 not found in NSW H3 lookup' END AS error
    FROM (SELECT DISTINCT poa_code FROM cover UNION ALL SELECT 'x9999') k LEFT JOIN s USING (poa_code)""", ("cover", "hazards"))
def hazard_structs(t):
    extra = t.spark.createDataFrame([("x9999",)], "postcode string")
    keys = t.cover.select(F.col("poa_code").alias("postcode")).distinct().unionByName(extra)
    out = places.hazards_struct(keys, t.hazards, t.cover).select("postcode", "result.*")
    labels = F.transform("hazards", lambda x: F.concat_ws(
        " ", x["hazard_type"], F.coalesce(x["display_name"], F.lit("-")), x["advice_a"], x["main_category"],
        F.round(x["expected_delay_min"] * 1000).cast("long").cast("string"), F.coalesce(x["impacting_network"].cast("string"), F.lit("-")),
        F.coalesce(F.unix_millis(x["last_updated_ts"]).cast("string"), F.lit("-"))))
    return out.select("postcode", F.col("hazard_count").cast("long").alias("hazard_count"), F.array_join(labels, ",").alias("list"), "error")


@query("Q-11", """
    WITH f AS (SELECT station_name, rcp, period, quantile_disc(value, 0.5) AS v, count(DISTINCT model) AS n FROM projections
               WHERE variable = 'tas' AND time_aggregation = 'Annual' AND rcp IN ('rcp45', 'rcp85') GROUP BY 1, 2, 3),
    p AS (SELECT station_name, max(v) FILTER (rcp = 'rcp45' AND period = '2020-2039') AS a, max(v) FILTER (rcp = 'rcp45' AND period = '2080-2099') AS b,
                 max(v) FILTER (rcp = 'rcp85' AND period = '2080-2099') AS c, max(n) AS n FROM f GROUP BY 1)
    SELECT k.poa_code AS postcode, m.nearest_csiro_station AS station_name, round(a, 2) AS current_2020s_temp_c, round(b, 2) AS future_2080s_temp_c,
           round(b - a, 2) AS warming_delta_c, round(c, 2) AS worst_case_2080s_rcp85_temp_c, n AS models_n,
           CASE WHEN m.nearest_csiro_station IS NULL THEN 'Postcode ' || k.poa_code || ' not found in NSW CSIRO lookup' END AS error
    FROM (SELECT DISTINCT poa_code FROM cover) k LEFT JOIN climate_map m USING (poa_code)
    LEFT JOIN p ON p.station_name = m.nearest_csiro_station""", ("cover", "climate_map", "projections"))
def climate_structs(t):
    keys = t.cover.select(F.col("poa_code").alias("postcode")).distinct()
    out = climate.climate_struct(keys, t.climate_map, t.projections, exact=True).select("postcode", "result.*")
    return out.drop("poa_code")


INDUSTRY = """
    SELECT substring(p_brand, 7, 2) AS INDUSTRY, CASE p_type WHEN 'ECONOMY' THEN 'EMPTOTAL' WHEN 'STANDARD' THEN 'INCTOTAL'
             WHEN 'PROMO' THEN 'EXPLCWAGESNA' WHEN 'SMALL' THEN 'EBITDA' WHEN 'LARGE' THEN 'INDUSTRY' ELSE 'XOTHER' END AS MEASURE,
           CAST(2018 + p_size % 5 AS STRING) AS TIME_PERIOD,
           CASE WHEN p_partkey % 13 = 0 THEN 'np' ELSE CAST(p_partkey AS STRING) END AS OBS_VALUE, lpad(CAST(p_partkey AS STRING), 9, '0') AS SERIES
    FROM part"""


@query("Q-12", f"""
    WITH raw AS ({INDUSTRY}),
    o AS (SELECT *, try_cast(OBS_VALUE AS DOUBLE) AS v FROM raw WHERE TIME_PERIOD = (SELECT max(TIME_PERIOD) FROM raw)
          AND MEASURE <> 'XOTHER'),
    w AS (SELECT INDUSTRY AS code, TIME_PERIOD AS reference_year, arg_min(v, SERIES) FILTER (MEASURE = 'EMPTOTAL' AND v IS NOT NULL) AS e,
            arg_min(v, SERIES) FILTER (MEASURE = 'INCTOTAL' AND v IS NOT NULL) AS i, arg_min(v, SERIES) FILTER (MEASURE = 'EXPLCWAGESNA' AND v IS NOT NULL) AS g,
            arg_min(v, SERIES) FILTER (MEASURE = 'EBITDA' AND v IS NOT NULL) AS b, arg_min(v, SERIES) FILTER (MEASURE = 'INDUSTRY' AND v IS NOT NULL) AS a
          FROM o GROUP BY 1, 2)
    SELECT k.code, n_name AS anzsic_name, reference_year, e AS num_employees_thousand, i AS total_income_aud_m, a AS industry_value_added_aud_m,
           CASE WHEN e > 0 AND i IS NOT NULL THEN CAST(trunc(i * 1000 / e) AS BIGINT) END AS revenue_per_employee_aud,
           CASE WHEN i > 0 THEN round(g / i * 100, 2) END AS wages_share_of_income_pct, CASE WHEN i > 0 THEN round(b / i * 100, 2) END AS ebitda_margin_pct,
           CASE WHEN i > 0 THEN round(a / i * 100, 2) END AS value_added_intensity_pct,
           CASE WHEN w.code IS NULL THEN 'ANZSIC code ' || k.code || ' not found in our industry data. Use a 2-digit Subdivision code like 01, 45, 43.' END AS error
    FROM (SELECT DISTINCT INDUSTRY AS code FROM raw UNION ALL SELECT '999') k LEFT JOIN w ON w.code = k.code
    LEFT JOIN nation ON CAST(n_nationkey AS VARCHAR) = w.code""")
def industry(t):
    raw = t.derive(INDUSTRY)
    names = t.nation.select(F.col("n_nationkey").cast("string").alias("anzsic_code"), F.col("n_name").alias("anzsic_name"))
    context = industry_context(raw, names)
    keys = raw.select(F.concat(F.lit(" "), F.col("INDUSTRY")).alias("code")).distinct().unionByName(
        t.spark.createDataFrame([("999 ",)], "code string"))
    out = industry_struct(keys, context).select("result.*")
    return out.select(F.col("anzsic_code").alias("code"), "anzsic_name", "reference_year", "num_employees_thousand", "total_income_aud_m",
                      "industry_value_added_aud_m", F.col("revenue_per_employee_aud").cast("long").alias("revenue_per_employee_aud"),
                      "wages_share_of_income_pct", "ebitda_margin_pct", "value_added_intensity_pct", "error")


CELL_RISK = """
    SELECT poa_code, h3_cell, max(CASE WHEN {top} THEN 3 WHEN impacting_network THEN 2 WHEN hazard_type IS NOT NULL THEN 1 ELSE 0 END) AS risk
    FROM cover LEFT JOIN active USING (h3_cell) GROUP BY 1, 2"""


@query("AGG-13", CELL_RISK.format(top="hazard_type IN ('flood', 'fire')"), ("cover", "active"))
def worst_per_cell(t):
    from ..operators.spatial import cell_risk
    from ..plans.rules import severity
    active = H.latest_batch(t.hazards).where(~F.col("ended") & F.col("h3_cell").isNotNull())
    return cell_risk(t.cover, active, ["poa_code"], "h3_cell", severity("kind_first"))


@query("Q-17", f"""
    WITH c AS ({CELL_RISK.format(top="hazard_type IN ('flood', 'fire')")}),
    s AS (SELECT poa_code, count(*) AS total_cells, count(*) FILTER (risk > 0) AS at_risk_cells, count(*) FILTER (risk >= 3) AS critical_cells FROM c GROUP BY 1)
    SELECT *, CAST(round_even(at_risk_cells / total_cells * 100, 0) AS BIGINT) AS risk_pct, CASE WHEN critical_cells > 0 THEN 'Critical'
      WHEN round_even(at_risk_cells / total_cells * 100, 0) > 20 THEN 'High' WHEN at_risk_cells > 0 THEN 'Moderate' ELSE 'Low' END AS risk_level FROM s""",
       ("cover", "active"))
def snapshot(t):
    return places.risk_snapshot(t.cover, t.hazards).withColumn("risk_pct", F.col("risk_pct").cast("long"))


@query("FN-25", f"""
    WITH c AS ({CELL_RISK.format(top="hazard_type IN ('flood', 'fire')")}),
    s AS (SELECT poa_code, count(*) AS n, count(*) FILTER (risk > 0) AS r, count(*) FILTER (risk >= 3) AS k FROM c GROUP BY 1),
    l AS (SELECT DISTINCT poa_code, hazard_type || ': ' || coalesce(display_name, headline) || ' (' || CASE WHEN is_major THEN 'major'
            WHEN impacting_network THEN 'network' ELSE 'active' END || ')' AS label FROM cover JOIN active USING (h3_cell)),
    fw AS (SELECT *, row_number() OVER (PARTITION BY location_name ORDER BY forecast_time, precipitation_mm NULLS FIRST, temperature_c NULLS FIRST, windspeed_kmh NULLS FIRST) AS rn FROM weather_now),
    x AS (SELECT poa_code, concat_ws(', ', 'station=' || nearest_weather_location, 'precipitation_mm=' || CAST(round(precipitation_mm * 1000) AS BIGINT),
            'temperature_c=' || CAST(round(temperature_c * 1000) AS BIGINT), 'windspeed_kmh=' || CAST(round(windspeed_kmh * 1000) AS BIGINT)) AS shown
          FROM weather_map m LEFT JOIN (SELECT * FROM fw WHERE rn = 1) w ON w.location_name = m.nearest_weather_location),
    f AS (SELECT poa_code, string_agg(label, '; ' ORDER BY label) AS labels FROM
            (SELECT *, row_number() OVER (PARTITION BY poa_code ORDER BY label) AS rn FROM l) WHERE rn <= 5 GROUP BY 1)
    SELECT poa_code, 'overall_risk=' || CASE WHEN k > 0 THEN 'Critical' WHEN round_even(r / n * 100, 0) > 20 THEN 'High' WHEN r > 0 THEN 'Moderate' ELSE 'Low' END
      || '; total_cells=' || n || '; at_risk_cells=' || r || '; critical_cells=' || k || '; risk_pct=' || CAST(round_even(r / n * 100, 0) AS INT)
      || '; active_hazards=' || coalesce(labels, 'no active hazards reported') || '; weather=' || coalesce(x.shown, 'unavailable') AS context
    FROM s LEFT JOIN f USING (poa_code) LEFT JOIN x USING (poa_code)""", ("cover", "active", "weather_now", "weather_map"))
def context_lines(t):
    # Fractions print differently by engine, so the figures are whole numbers here.
    whole = {c: F.round(F.col(c) * 1000).cast("long") for c in ("precipitation_mm", "temperature_c", "windspeed_kmh")}
    return places.risk_texts(t.cover, t.hazards, t.weather.withColumns(whole), t.weather_map)


@query("Q-18", f"""
    WITH c AS ({CELL_RISK.format(top="is_major OR hazard_type IN ('flood', 'fire')")})
    SELECT poa_code, h3_cell, risk, 
      concat_ws(' ', s, w, s, w + 250, s + 250, w + 250, s + 250, w, s, w) AS corners FROM
        (SELECT *, CAST(round(((h3_cell // 1440) / 4 - 90) * 1000) AS BIGINT) AS s, CAST(round(((h3_cell % 1440) / 4 - 180) * 1000) AS BIGINT) AS w FROM c)""",
       ("cover", "active"))
def cells_on_map(t):
    out = places.map_cells(t.cover, t.hazards, PER_DEGREE)
    corners = F.transform(F.flatten("boundary"), lambda x: F.round(x * 1000).cast("long").cast("string"))
    return out.select("poa_code", "h3_cell", "risk", F.array_join(corners, " ").alias("corners"))


@query("Q-18-nearby", """
    WITH d AS (SELECT DISTINCT poa_code, hazard_type, coalesce(display_name, '') AS display_name, headline, is_major,
        coalesce(impacting_network, false) AS impacting_network, round(latitude, 4) AS lat, round(longitude, 4) AS lng,
        concat(json_extract_string(roads_json, '$[0].mainStreet'), ', ', json_extract_string(roads_json, '$[0].suburb'),
          CASE WHEN json_extract_string(roads_json, '$[0].crossStreet') <> '' THEN concat(' (near ', json_extract_string(roads_json, '$[0].crossStreet'), ')') ELSE '' END) AS road
      FROM cover JOIN active USING (h3_cell))
    SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY poa_code ORDER BY hazard_type, display_name, headline, is_major,
      impacting_network, lat, lng, road) AS rn FROM d) WHERE rn <= 20""", ("cover", "active"))
def hazards_nearby(t):
    return places.nearby_hazards(t.cover, t.hazards)


# -- questions over the two tables -------------------------------------------

SUMMARY = """
    SELECT count(*) AS total_postcodes, count(DISTINCT weather_station_name) AS distinct_weather_stations,
           count(DISTINCT nearest_csiro_station) AS distinct_csiro_stations, CAST(sum(total_active_hazards) AS BIGINT) AS total_active_hazards,
           count(*) FILTER (risk_level = 'Critical') AS critical_postcodes, count(*) FILTER (risk_level = 'High') AS high_risk_postcodes,
           count(*) FILTER (total_active_hazards = 0) AS quiet_postcodes, round(avg(current_temperature_c), 4) AS avg_temperature_c FROM gold"""


@query("Q-25", SUMMARY, ("gold",))
def gold_summary(t):
    return analyst.summary(gold(t))


@query("Q-25-warming", """
    SELECT postcode, weather_station_name, nearest_csiro_station, round(climate_temp_2020s, 2) AS temp_2020s,
           round(climate_temp_2080s_rcp85, 2) AS temp_2080s_high, round(warming_2080s_rcp85_c, 2) AS warming_c
    FROM gold WHERE warming_2080s_rcp85_c IS NOT NULL ORDER BY warming_c DESC, postcode LIMIT 10""", ("gold",))
def warmest(t):
    return analyst.most_warming(gold(t))


@query("Q-25-hazards", """
    SELECT postcode, risk_level, active_flood_count, active_fire_count, active_roadwork_count, active_incident_count, major_hazards_count,
           total_active_hazards FROM gold WHERE total_active_hazards > 0
    ORDER BY major_hazards_count DESC, total_active_hazards DESC, postcode LIMIT 20""", ("gold",))
def worst(t):
    return analyst.most_hazards(gold(t))


@query("Q-25-both", """
    SELECT postcode, active_flood_count, major_hazards_count FROM gold WHERE active_flood_count > 0 AND major_hazards_count > 0""", ("gold",))
def both(t):
    return analyst.flooded_and_major(gold(t))


@query("Q-25-floods", "SELECT postcode, active_flood_count, risk_level FROM gold WHERE active_flood_count > 0", ("gold",))
def floods(t):
    return analyst.flooded_now(gold(t))


@query("Q-25-above", """
    SELECT postcode, nearest_csiro_station, round(warming_2080s_rcp85_c, 2) AS warming_c FROM gold WHERE warming_2080s_rcp85_c > 3""", ("gold",))
def above(t):
    return analyst.warming_above(gold(t))


@query("Q-25-roadworks", """
    SELECT postcode, active_roadwork_count FROM gold WHERE active_roadwork_count > 0 ORDER BY active_roadwork_count DESC, postcode LIMIT 1""", ("gold",))
def roadworks(t):
    return analyst.most_roadworks(gold(t))


@query("Q-25-weather", """
    SELECT postcode, weather_station_name, weather_observed_at, current_temperature_c, current_precipitation_mm, current_windspeed_kmh FROM gold""", ("gold",))
def weather_now(t):
    return analyst.weather_of_places(gold(t))


@query("Q-25-decades", """
    SELECT postcode, nearest_csiro_station, round(climate_temp_2020s, 2) AS temp_2020s, round(climate_temp_2080s_rcp85, 2) AS temp_2080s_high,
           round(warming_2080s_rcp85_c, 2) AS warming_c FROM gold""", ("gold",))
def decades(t):
    return analyst.decades_of_places(gold(t))


@query("Q-21", """
    SELECT postcode, strftime(snapshot_date, '%Y-%m-%d') AS snapshot_date, total_active_hazards, risk_level,
           total_active_hazards - lag(total_active_hazards) OVER (PARTITION BY postcode ORDER BY snapshot_date) AS change
    FROM gold_days WHERE snapshot_date >= DATE '2024-01-19' - 7""", ("gold_days",))
def hazard_change(t):
    return analyst.hazard_trend(gold_days(t)).select("postcode", "snapshot_date", "total_active_hazards", "risk_level", "change")


@query("Q-22", """
    SELECT postcode, count(DISTINCT snapshot_date) AS n_days FROM gold_days WHERE risk_level = 'Critical'
      AND snapshot_date > DATE '2024-01-19' - 7 GROUP BY 1""", ("gold_days",))
def critical(t):
    return analyst.critical_lately(gold_days(t))


@query("Q-22-floods", """
    SELECT postcode, count(DISTINCT snapshot_date) AS n_days FROM gold_days WHERE active_flood_count > 0
      AND snapshot_date > DATE '2024-01-19' - 30 GROUP BY 1 HAVING count(DISTINCT snapshot_date) > 1""", ("gold_days",))
def flooded(t):
    return analyst.often_flooded(gold_days(t), more_than=1)


@query("Q-23", """
    WITH d AS (SELECT state, snapshot_date, CAST(sum(total_active_hazards) AS BIGINT) AS total_active_hazards FROM gold_days GROUP BY 1, 2)
    SELECT a.state, strftime(a.snapshot_date, '%Y-%m-%d') AS snapshot_date, a.total_active_hazards, round(avg(b.total_active_hazards), 4) AS trailing_avg
    FROM d a LEFT JOIN d b ON b.state = a.state AND b.snapshot_date < a.snapshot_date AND b.snapshot_date >= a.snapshot_date - 30
    GROUP BY 1, 2, 3""", ("gold_days",))
def against_month(t):
    return analyst.today_against_month(gold_days(t))


@query("Q-23-rain", """
    SELECT postcode, max(daily_total_rain_mm) AS max_daily_rain_mm FROM gold_days WHERE snapshot_date > DATE '2024-01-19' - 30 GROUP BY 1""", ("gold_days",))
def wettest(t):
    return analyst.wettest_day(gold_days(t))


@query("Q-24", """
    SELECT g.postcode, risk_level, total_active_hazards, period_avg FROM gold g LEFT JOIN
      (SELECT postcode, round(avg(total_active_hazards), 4) AS period_avg FROM gold_days WHERE snapshot_date >= DATE '2024-01-12'
         AND snapshot_date < DATE '2024-01-19' GROUP BY 1) h ON h.postcode = g.postcode""", ("gold", "gold_days"))
def against_week(t):
    return analyst.current_against_week(gold(t), gold_days(t), "2024-01-12", "2024-01-19")


@query("Q-26", """
    SELECT station_name, rcp, period, round(quantile_disc(value, 0.5), 2) AS median_value, min(value) AS min_value, max(value) AS max_value,
           count(DISTINCT model) AS n_models FROM projections WHERE variable = 'tas' AND time_aggregation = 'Annual' GROUP BY 1, 2, 3""", ("projections",))
def spread_of_models(t):
    rows = t.projections.where("variable = 'tas' AND time_aggregation = 'Annual'")
    return climate.model_spread(rows, ["station_name", "rcp", "period"], exact=True)


@query("Q-26-scenarios", """
    SELECT rcp, period, variable, round(quantile_disc(value, 0.5), 2) AS median_value, min(value) AS min_value, max(value) AS max_value,
           count(DISTINCT model) AS n_models FROM projections GROUP BY 1, 2, 3""", ("projections",))
def scenarios(t):
    return climate.model_spread(t.projections, ["rcp", "period", "variable"], exact=True)


WATCHED = {"weather": "_ingest_time", "hazards": "_ingest_time", "hazards_raw": "_ingest_time", "businesses": "ingested_at", "supplier_log": "added_at",
           "events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}


@query("Q-27", " UNION ALL ".join(f"""
    SELECT '{name}' AS table_name, count(*) AS n_rows, count(DISTINCT {at}) AS n_batches, strftime(max({at}), '%Y-%m-%d %H:%M:%S') AS latest,
           datediff('second', CAST(max({at}) AS TIMESTAMP), TIMESTAMP '2024-01-20 12:00:00') // 60 AS minutes_old FROM {name}""" for name, at in WATCHED.items()),
       ("weather", "hazards", "businesses", "supplier_log"))
def health(t):
    """Eight tables with the stamps of their batches."""
    from ..operators.quality import freshness_minutes
    return freshness_minutes({name: (getattr(t, name), at) for name, at in WATCHED.items()}, NOW)


@query("UDF-01", """
    SELECT c.poa_code AS postcode, m.nearest_weather_location AS forecast_location, r AS max_rain_24h_mm, coalesce(n, 0) AS hazard_count,
           k.nearest_csiro_station AS station_name, v AS worst_case
    FROM (SELECT DISTINCT poa_code FROM cover) c LEFT JOIN weather_map m USING (poa_code) LEFT JOIN climate_map k USING (poa_code)
    LEFT JOIN (SELECT location_name, max(precipitation_mm) AS r FROM weather_now WHERE forecast_time >= TIMESTAMP '2024-01-20 12:00:00'
        AND forecast_time < TIMESTAMP '2024-01-21 12:00:00' GROUP BY 1) w ON w.location_name = m.nearest_weather_location
    LEFT JOIN (SELECT poa_code, count(*) AS n FROM cover JOIN (SELECT * FROM hazards WHERE _ingest_time = (SELECT max(_ingest_time) FROM hazards)) h USING (h3_cell)
        GROUP BY 1) h USING (poa_code)
    LEFT JOIN (SELECT station_name, round(quantile_disc(value, 0.5), 2) AS v FROM projections WHERE variable = 'tas' AND time_aggregation = 'Annual' AND rcp = 'rcp85'
        AND period = '2080-2099' GROUP BY 1) p ON p.station_name = k.nearest_csiro_station""",
       ("cover", "weather_map", "climate_map", "weather_now", "hazards", "projections"))
def struct_functions(t):
    """The struct-valued look-ups, as one frame over all keys instead of a function per key."""
    keys = t.cover.select(F.col("poa_code").alias("postcode")).distinct()
    w = places.weather_struct(keys, t.weather, t.weather_map, NOW).withColumnRenamed("result", "w")
    h = places.hazards_struct(keys, t.hazards, t.cover).withColumnRenamed("result", "h")
    c = climate.climate_struct(keys, t.climate_map, t.projections, exact=True).withColumnRenamed("result", "c")
    return w.join(h, "postcode").join(c, "postcode").select(
        "postcode", "w.forecast_location", "w.max_rain_24h_mm", F.col("h.hazard_count").cast("long").alias("hazard_count"), "c.station_name",
        F.col("c.worst_case_2080s_rcp85_temp_c").alias("worst_case"))
