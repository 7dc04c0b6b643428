"""Hazard counts, severity rules, snapshot and structs on a small map."""

from pyspark.sql import functions as F

from placewatch.plans import analyst, places as P
from placewatch.plans.rules import HAZARD_RULES, severity
from placewatch.operators.quality import keep_valid

from .conftest import NOW, at
from .test_history import weather

HAZARD = ("hazard_type string, hazard_id string, main_category string, display_name string, headline string, expected_delay_min double, "
          "impacting_network boolean, is_major boolean, ended boolean, advice_a string, longitude double, latitude double, "
          "roads_json string, created_ts timestamp, last_updated_ts timestamp, h3_cell bigint, _ingest_time timestamp")
T = at("2026-05-12 03:00:00")


def hazard(kind, hid, net, major, ended, cell, when=T):
    lon, lat = (150.0, -33.0) if cell else (None, None)
    return (kind, hid, "cat", f"{kind} {hid}", "head", 1.0, net, major, ended, "adv", lon, lat,
            '[{"mainStreet":"High St","suburb":"Town","crossStreet":""}]', T, at("2026-05-12 01:00:00"), cell, when)


def hazards(spark):
    return spark.createDataFrame([
        hazard("flood", "1", True, True, False, 100), hazard("fire", "2", False, False, False, 200),
        hazard("roadwork", "3", True, False, False, 300), hazard("roadwork", "4", None, None, False, 300),
        hazard("incident", "5", False, False, True, 301), hazard("incident", "6", False, False, None, 301),
        hazard("incident", "7", False, False, False, None), hazard("quake", "8", False, False, False, 100),
        hazard("fire", "1", False, False, False, 100, at("2026-05-11 21:00:00"))], HAZARD)


def cover(spark):
    return spark.createDataFrame([("A", 100), ("A", 101), ("B", 200), ("B", 300), ("C", 300), ("C", 301), ("D", 400)], "poa_code string, h3_cell bigint")


def clean(spark):
    return keep_valid(hazards(spark), HAZARD_RULES)


def test_unknown_type_dropped_null_geometry_kept(spark):
    ids = {r.hazard_id for r in clean(spark).where(F.col("_ingest_time") == F.lit(T)).collect()}
    assert ids == {"1", "2", "3", "4", "5", "6", "7"}


def test_current_hazards(spark, rows):
    # Ended, of unknown end, without a cell: all left out; severity by the major-first rule.
    assert rows(P.hazards_current(clean(spark)), "hazard_id", "severity_score") == [("1", 3), ("2", 1), ("3", 2), ("4", 1)]


def test_three_severity_rules(spark, rows):
    got = {}
    for rule in ("major_first", "kind_first", "either"):
        got[rule] = dict(rows(P.hazards_current(clean(spark), rule), "hazard_id", "severity_score"))
    assert [got[r]["2"] for r in got] == [1, 3, 3] and got["kind_first"]["3"] == 2 and got["either"]["1"] == 3
    odd = spark.createDataFrame([(None, None, None)], "hazard_type string, is_major boolean, impacting_network boolean")
    assert odd.select(severity("kind_first").alias("s")).first()["s"] == 0


def test_counts_cells_not_ids(spark):
    out = {r.poa_code: r for r in P.hazard_counts(cover(spark), P.hazards_current(clean(spark))).collect()}
    assert out["C"].active_roadwork_count == 1 and out["C"].total_active_hazards == 1      # two ids, one cell
    assert out["B"].total_active_hazards == 2 and out["D"].total_active_hazards == 0 and out["D"].h3_cells_count == 1
    assert out["A"].max_severity_score == 3 and out["D"].max_severity_score is None


def maps(spark):
    wm = spark.createDataFrame([("A", "Alpha"), ("B", "Beta"), ("C", "Alpha")], "poa_code string, nearest_weather_location string")
    cm = spark.createDataFrame([("A", "S1"), ("B", "S2")], "poa_code string, nearest_csiro_station string")
    pr = spark.createDataFrame([(s, m, rcp, p, v, "mean", "celsius", "Annual", x)
                                for s in ("S1",) for m, d in (("m1", 0), ("m2", 1), ("m3", 2), ("m4", 3))
                                for rcp, p, v, x in (("rcp45", "2020-2039", "tas", 20.0 + d), ("rcp45", "2080-2099", "tas", 22.0 + d),
                                                     ("rcp85", "2080-2099", "tas", 25.0 + d), ("rcp85", "2020-2039", "tas", 99.0))],
                               "station_name string, model string, rcp string, period string, variable string, aggregation string, units string, time_aggregation string, value double")
    return wm, cm, pr


def test_gold_current(spark):
    wm, cm, pr = maps(spark)
    out = P.gold_current(weather(spark), clean(spark), cover(spark), wm, cm, pr, NOW)
    got = {r.postcode: r for r in out.collect()}
    assert {p: r.risk_level for p, r in got.items()} == {"A": "Critical", "B": "High", "C": "Moderate", "D": "Low"}
    assert len(out.columns) == 26 and got["D"].max_severity_score == 0 and got["D"].weather_station_name is None
    # The warming of the high scenario is measured from the rcp45 base, by the largest model.
    assert got["A"].warming_2080s_rcp85_c == 28.0 - 23.0 and got["B"].warming_2080s_rcp85_c is None
    assert len(P.gold_view(weather(spark), clean(spark), cover(spark), wm, cm, pr, NOW).columns) == 21


def test_gold_history_counts_ids_and_keeps_one_sided_days(spark):
    wm, _, _ = maps(spark)
    h = clean(spark).unionByName(spark.createDataFrame([hazard("fire", "9", False, False, False, 400, at("2026-05-09 03:00:00"))], HAZARD))
    got = {(r.postcode, str(r.snapshot_date)): r for r in P.gold_history(weather(spark), h, cover(spark), wm).collect()}
    assert got[("C", "2026-05-12")].active_roadwork_count == 2                            # two ids in one cell
    assert got[("D", "2026-05-09")].daily_avg_temp_c is None and got[("D", "2026-05-09")].total_active_hazards == 1
    assert got[("C", "2026-05-11")].total_active_hazards == 0 and got[("C", "2026-05-11")].risk_level == "Low"


def test_id_in_several_cells_counts_once(spark):
    """One id in two cells of a place on one day, and in a shared cell of two places."""
    h = spark.createDataFrame([hazard("fire", "m", False, False, False, 100), hazard("fire", "m", False, True, False, 101),
                               hazard("fire", "s", False, False, False, 300)], HAZARD)
    got = {r.poa_code: r for r in P.daily_hazards(h, cover(spark)).collect()}
    assert got["A"].active_fire_count == 1 and got["A"].major_hazards_count == 1 and got["A"].total_active_hazards == 1
    assert got["B"].active_fire_count == 1 and got["C"].active_fire_count == 1


def test_structs_carry_errors(spark):
    wm, cm, pr = maps(spark)
    keys = spark.createDataFrame([("A",), ("Z",)], "postcode string")
    w = {r.postcode: r.result for r in P.weather_struct(keys, weather(spark), wm, NOW).collect()}
    assert len(w["A"].next_12h) == 12 and w["A"].error is None
    assert w["A"].next_12h[0].forecast_time == at(NOW) and w["Z"].next_12h == []
    assert w["Z"].error == "Postcode Z not found in NSW weather lookup"
    h = {r.postcode: r.result for r in P.hazards_struct(spark.createDataFrame([("C",), ("D",), ("Z",)], "postcode string"), clean(spark), cover(spark)).collect()}
    assert h["C"].hazard_count == 4 and [x.impacting_network for x in h["C"].hazards] == [True, False, False, None]   # ended ones too
    assert h["D"].hazard_count == 0 and h["D"].error is None and h["Z"].error == "Postcode Z not found in NSW H3 lookup"


def test_climate_median_is_an_element(spark):
    from placewatch.plans.climate import climate_struct
    _, cm, pr = maps(spark)
    keys = spark.createDataFrame([("A",), ("B",), ("Z",)], "postcode string")
    for exact in (True, False):
        got = {r.postcode: r.result for r in climate_struct(keys, cm, pr, exact).collect()}
        assert got["A"].current_2020s_temp_c == 21.0 and got["A"].warming_delta_c == 2.0 and got["A"].models_n == 4
        assert got["A"].worst_case_2080s_rcp85_temp_c == 26.0
        assert got["B"].current_2020s_temp_c is None and got["B"].error is None and got["Z"].error.startswith("Postcode Z")


def test_snapshot_share(spark):
    got = {r.poa_code: r for r in P.risk_snapshot(cover(spark), clean(spark)).collect()}
    assert (got["A"].risk_pct, got["A"].risk_level) == (50, "Critical") and got["B"].risk_level == "Critical"
    assert (got["C"].at_risk_cells, got["C"].risk_level) == (1, "High") and got["D"].risk_level == "Low"


def test_context_text(spark):
    wm, _, _ = maps(spark)
    got = {r.poa_code: r.context for r in P.risk_texts(cover(spark), clean(spark), weather(spark), wm).collect()}
    assert got["D"] == ("overall_risk=Low; total_cells=1; at_risk_cells=0; critical_cells=0; risk_pct=0; "
                        "active_hazards=no active hazards reported; weather=unavailable")
    assert "active_hazards=flood: flood 1 (major); weather=station=Alpha, precipitation_mm=0.0, temperature_c=10.0, windspeed_kmh=5.0" in got["A"]


def test_map_cells_are_grouped(spark):
    out = P.map_cells(cover(spark), clean(spark))
    assert out.count() == 7 and out.where("poa_code = 'C' AND h3_cell = 300").first()["risk"] == 2
    near = P.nearby_hazards(cover(spark), clean(spark)).where("poa_code = 'B'").collect()
    assert {r.road for r in near} == {"High St, Town"} and len(near) == 3


def test_trends(spark, rows):
    import datetime as dt
    days = [(p, "NSW", dt.date(2026, 4, 3) + dt.timedelta(days=d), (d * 7 + i) % 5, "Critical" if d % 10 == 0 else "Low", d % 4, float(d))
            for i, p in enumerate("ABC") for d in range(40) if not (p == "B" and d == 37)]
    h = spark.createDataFrame(days, "postcode string, state string, snapshot_date date, total_active_hazards long, risk_level string, active_flood_count long, daily_total_rain_mm double")
    t = analyst.hazard_trend(h, 7)
    assert t.where("postcode = 'A'").count() == 8 and t.where("postcode = 'B'").count() == 7
    assert rows(analyst.critical_lately(h, 10)) == [("A", 1), ("B", 1), ("C", 1)]
    assert rows(analyst.often_flooded(h, 3, 30), "postcode", "n_days")[0] == ("A", 23)
    last = analyst.today_against_month(h).orderBy(F.desc("snapshot_date")).first()
    window = [sum(x[3] for x in days if x[2] == dt.date(2026, 5, 12) - dt.timedelta(days=k)) for k in range(1, 31)]
    assert abs(last.trailing_avg - sum(window) / 30) < 1e-3
    assert rows(analyst.wettest_day(h))[0] == ("A", 39.0)


def test_places_are_never_broadcast(spark, folder):
    # A row per place or per cell of a place: the small packed file it comes from says nothing about its size.
    frames = {"weather": weather(spark), "hazards": clean(spark), "cover": cover(spark),
              "map": spark.createDataFrame([("A", "s1")], "poa_code string, nearest_weather_location string")}
    for name, df in frames.items():
        df.write.parquet(f"{folder}/{name}")
    history = P.gold_history(*(spark.read.parquet(f"{folder}/{name}") for name in frames))
    assert "BroadcastExchange" not in history._jdf.queryExecution().executedPlan().toString()
    assert {r.postcode for r in history.collect()} >= {"A", "B"}


def test_only_numbers_of_hazards_are_ranked_per_place(spark):
    # The texts of a cell's hazards would be shuffled once for each place that holds the cell.
    import re
    plan = P.nearby_hazards(cover(spark), clean(spark))._jdf.queryExecution().optimizedPlan().toString()
    orders = re.findall(r"windowspecdefinition\(poa_code#\d+, ([^\n]*?), specifiedwindowframe", plan)
    assert orders and all(re.fullmatch(r"_pos#\d+L? ASC NULLS FIRST", o) for o in orders)
