"""Newest batch, nearest in time, newest event, upsert: literal rows, one case per trap."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from placewatch.operators import history as H
from placewatch.operators import joins as J
from placewatch.plans import business as B
from placewatch.plans import places as P
from placewatch.sources import sinks as K

from .conftest import NOW, at

WEATHER = ("location_name string, latitude double, longitude double, forecast_time timestamp, precipitation_mm double, "
           "windspeed_kmh double, temperature_c double, humidity_pct double, weather_code int, _ingest_time timestamp")
OLD, NEW = at("2026-05-11 21:00:00"), at("2026-05-12 03:00:00")


def by_rank(df):
    """The newest batch by a window over the whole table: small data only."""
    rank = F.dense_rank().over(Window.orderBy(F.desc("_ingest_time")))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def weather(spark):
    import datetime as dt
    data = []
    for batch in (OLD, NEW):
        for i, place in enumerate(("Alpha", "Beta")):
            for h in range(30):
                t = at(NOW) + dt.timedelta(hours=h - 2, minutes=0 if place == "Alpha" else 30)
                temp = None if (place == "Beta" and h == 5) else 10.0 + h
                data.append((place, -33.0 - i, 150.0 + i, t, 0.1 * h, 5.0 + h, temp, 50.0, h % 4, batch))
    data.append(("Gone", -30.0, 150.0, at(NOW), 0.0, 1.0, 9.0, 40.0, 0, OLD))
    return spark.createDataFrame(data, WEATHER)


def test_latest_batch_forms_agree(spark, rows):
    w = weather(spark)
    a, b = H.latest_batch(w), by_rank(w)
    assert rows(a) == rows(b) and a.count() == 60
    assert a.where("location_name = 'Gone'").count() == 0
    assert H.latest_batch(w, as_of="2026-05-12 00:00:00").count() == 61


def test_latest_batch_reaches_the_scan(spark, folder):
    w = weather(spark)
    w.write.parquet(f"{folder}/w")
    plan = H.latest_batch(spark.read.parquet(f"{folder}/w"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(_ingest_time), EqualTo(_ingest_time" in plan and "Window" not in plan


def test_pick_rules_differ(spark):
    """Nearest, newest not after now, and earliest are three different readings."""
    got = {p: {r.location_name: r.current_observed_at for r in P.weather_current(weather(spark), NOW, p).collect()}
           for p in ("nearest", "last_before", "first")}
    assert got["nearest"]["Alpha"] == at(NOW) and got["first"]["Alpha"] == at("2026-05-12 04:00:00")
    # 05:30 and 06:30 are equally far: the earlier one is taken.
    assert got["nearest"]["Beta"] == at("2026-05-12 05:30:00") == got["last_before"]["Beta"]
    assert "Gone" not in got["nearest"]


def test_next_day_is_half_open(spark):
    w = weather(spark)
    r = {x.location_name: x for x in P.weather_current(w, NOW).collect()}["Alpha"]
    # Hours 2..25 of the fixture; hour 26 is exactly now + 24 h and left out.
    assert r.next_24h_max_temp_c == 35.0 and r.next_24h_min_temp_c == 12.0
    assert r.next_24h_total_rain_mm == round(sum(0.1 * h for h in range(2, 26)), 2)


def test_now_defaults_to_newest_batch(spark):
    w = weather(spark)
    assert {r.location_name: r.current_observed_at for r in P.weather_current(w).collect()}["Alpha"] == at("2026-05-12 04:00:00")


EVENTS = ("user_abn long, supplier_abn long, supplier_name string, added_at timestamp, action string")


def test_latest_event(spark, rows):
    t1, t2, t3 = at("2026-01-01"), at("2026-01-02"), at("2026-01-03")
    e = spark.createDataFrame([
        (1, 10, "a", t1, "ADD"), (1, 11, "b", t1, "ADD"), (1, 11, "", t2, "REMOVE"),
        (1, 12, "c", t1, "ADD"), (1, 12, "", t2, "REMOVE"), (1, 12, "c2", t3, "ADD"),
        (1, 13, "d", t1, "ADD"), (1, 13, "", t1, "REMOVE"), (2, 13, "e", t1, "ADD"), (2, 13, "f", t1, "ADD")], EVENTS)
    got = rows(H.latest_event(e, ["user_abn", "supplier_abn"], "added_at", "action"), "user_abn", "supplier_abn", "supplier_name")
    # At the same instant a removal wins; equal events fall to the largest row.
    assert got == [(1, 10, "a"), (1, 12, "c2"), (2, 13, "f")]


def test_upsert(spark, rows):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "c", "z")], "k long, v string, w string")
    source = spark.createDataFrame([(2, None, "new"), (4, "d", "q")], "k long, v string, w string")
    once = H.upsert(target, source, ["k"])
    assert rows(once) == [(1, "a", "x"), (2, None, "new"), (3, "c", "z"), (4, "d", "q")]
    assert rows(H.upsert(once, source, ["k"])) == rows(once)


def test_upsert_repeated_key(spark, rows):
    target = spark.createDataFrame([(1, "a", 0)], "k long, v string, n int")
    source = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "k long, v string, n int")
    with pytest.raises(Exception, match="more than one row"):
        H.upsert(target, source, ["k"]).collect()
    assert rows(H.upsert(target, source, ["k"], ["n"])) == [(1, "y", 2)]


def test_upsert_table_rewrites_touched_buckets_only(spark, folder, rows):
    import glob
    import os
    path = f"{folder}/t"
    K.upsert_table(spark, path, spark.range(200).select(F.col("id").alias("k"), F.lit("old").alias("v")), ["k"], buckets=16)
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/_bucket=*/*.parquet")}
    out = K.upsert_table(spark, path, spark.createDataFrame([(7, "new")], "k long, v string"), ["k"], buckets=16)
    after = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/_bucket=*/*.parquet")}
    assert out.count() == 200 and rows(out.where("v = 'new'")) == [(7, "new")]
    assert len(set(before.items()) & set(after.items())) == len(before) - 1


def test_rain_risk_one_row_per_forecast(spark):
    w = weather(spark).withColumn("precipitation_mm", F.lit(51.0))
    biz = spark.createDataFrame([(1, 800), (2, 2480)], "abn long, postcode long")
    m = spark.createDataFrame([("0800", "Alpha"), ("2480", "Nowhere")], "poa_code string, nearest_weather_location string")
    out = B.rain_risk(biz, m, w, NOW)
    assert out.count() == 30 and out.where("abn = 1 AND risk_level = 'High'").count() == 30
    assert B.rain_risk(biz, m, w, NOW, collapse="max").count() == 1


def test_codes_join_with_leading_zeros(spark, rows):
    a = spark.createDataFrame([(800,), (2480,), (None,)], "p long")
    b = spark.createDataFrame([("0800", "x"), ("2480", "y")], "code string, v string")
    assert rows(J.join_code(a, b, "p", "code"), "p", "v") == [(2480, "y"), (800, "x"), (None, None)]


def test_spread_join_equals_plain_join(spark, rows):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 40).alias("k"), F.col("id").alias("v"))
    small = spark.range(1, 30).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        got, want = J.spread_join(big, small, "k", ["v"], how, rows=200, salts=8), big.join(small, "k", how)
        assert rows(got, *sorted(got.columns)) == rows(want, *sorted(want.columns)), how
    assert J.hot_keys(big, "k", 200).count() == 1


def test_right_filter_keeps_left_rows(spark):
    a = spark.createDataFrame([(1,), (2,)], "k long")
    b = spark.createDataFrame([(1, "no")], "j long, v string")
    assert J.left_with(a, b, {"k": "j"}, "v = 'yes'").count() == 2


def test_top_per_key_and_arrays(spark):
    df = spark.createDataFrame([(1, 3), (1, 1), (1, 2), (2, 5)], "k long, v long")
    got = {r.k: [x["v"] for x in r.a] for r in H.collect_top(df, ["k"], [F.desc("v")], 2, ["v"], "a").collect()}
    assert got == {1: [3, 2], 2: [5]}


def test_merge_of_null_keys_and_another_bucket_count(spark, folder, rows):
    path, source = folder + "/t", spark.createDataFrame([(None, "a"), (1, "b")], "k long, v string")
    for _ in range(3):
        out = K.upsert_table(spark, path, source, ["k"], buckets=4)
    assert rows(out) == [(1, "b"), (None, "a")] or sorted(map(str, rows(out))) == sorted(map(str, [(1, "b"), (None, "a")]))
    with pytest.raises(ValueError, match="4 buckets"):
        K.upsert_table(spark, path, source, ["k"], buckets=8)
    assert out.count() == 2


def test_merge_reads_its_source_once(spark, folder):
    """A source that gives other rows at each reading is staged, so that buckets and rows agree."""
    source = spark.range(50).select((F.rand() * 1000000).cast("long").alias("k"), F.col("id").alias("v"))
    assert K.upsert_table(spark, folder + "/t", source, ["k"], ["v"], buckets=8).select("v").distinct().count() >= 49


def test_newest_batch_reads_one_day_folder(spark, folder):
    for day in ("2024-01-01 05:00:00", "2024-01-02 05:00:00", "2024-01-02 06:00:00"):
        K.append_batch(spark.range(3).select("id", F.lit(day).cast("timestamp").alias("_ingest_time")), folder + "/t")
    table = K.read_history(spark, folder + "/t")
    newest = H.latest_batch(table)
    assert [str(r._ingest_time) for r in newest.collect()] == ["2024-01-02 06:00:00"] * 3
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_ingest_date" in plan and "PartitionFilters: []" not in plan.split("Subquery")[0]
    assert [str(r._ingest_time) for r in H.latest_batch(table, as_of="2024-01-02 05:30:00").collect()] == ["2024-01-02 05:00:00"] * 3
    assert [str(r._ingest_time) for r in H.latest_batch(table, as_of="2024-01-02 04:00:00").collect()] == ["2024-01-01 05:00:00"] * 3
