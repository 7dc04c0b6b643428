"""Covers and nearest neighbours against plain geometry."""

import math
import random

import pytest
from pyspark.sql import functions as F

from placewatch.functions.geo import wkt_to_points
from placewatch.operators import spatial as P


def inside(x, y, rings):
    hit = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 <= y) != (y2 <= y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                hit = not hit
    return hit


SHAPES = {
    "hole": [[(10.003, 10.003), (10.203, 10.003), (10.203, 10.203), (10.003, 10.203), (10.003, 10.003)],
             [(10.053, 10.053), (10.153, 10.053), (10.153, 10.153), (10.053, 10.153), (10.053, 10.053)]],
    "tri": [[(0.0011, 0.0007), (0.1312, 0.0213), (0.0531, 0.0917), (0.0011, 0.0007)]],
    "tiny": [[(5.001, 5.001), (5.002, 5.001), (5.002, 5.002), (5.001, 5.001)]],
    "bow": [[(-3.011, -2.017), (-2.903, -2.117), (-2.911, -2.013), (-3.007, -2.119), (-3.011, -2.017)]]}


def test_cover_cells_have_their_centre_inside(spark):
    wkt = {k: "POLYGON(" + ",".join("(" + ", ".join(f"{x} {y}" for x, y in r) + ")" for r in rings) + ")" for k, rings in SHAPES.items()}
    wkt["two"] = "MULTIPOLYGON(((0.001 0.001,0.051 0.001,0.051 0.0513,0.001 0.001)),((1.001 1.001,1.031 1.001,1.031 1.031,1.001 1.031,1.001 1.001)))"
    shapes = {**SHAPES, "two": [[(0.001, 0.001), (0.051, 0.001), (0.051, 0.0513), (0.001, 0.001)],
                                [(1.001, 1.001), (1.031, 1.001), (1.031, 1.031), (1.001, 1.031), (1.001, 1.001)]]}
    df = spark.createDataFrame([*wkt.items(), ("none", None)], "k string, w string")
    got = {}
    for r in P.cover(df, "k", "w").collect():
        got.setdefault(r.k, set()).add(r.h3_cell)
    assert "none" not in got and "tiny" not in got
    for k, rings in shapes.items():
        xs, ys = [x for r in rings for x, _ in r], [y for r in rings for _, y in r]
        want = {i * 36000 + j for i in range(math.floor((min(ys) + 90) * 100) - 1, math.ceil((max(ys) + 90) * 100) + 1)
                for j in range(math.floor((min(xs) + 180) * 100) - 1, math.ceil((max(xs) + 180) * 100) + 1)
                if inside((j + 0.5) / 100 - 180, (i + 0.5) / 100 - 90, rings)}
        assert got.get(k, set()) == want, k


def km(a, b):
    f = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(f))


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_equals_brute_force(spark, seed):
    """World-wide points, a crowded spot on both sides, poles, the date line, and exact ties."""
    r = random.Random(seed)
    left = [(i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(150)] + [(200 + i, -33 + r.random() / 300, 151 + r.random() / 300) for i in range(100)]
    left += [(900, 89.99, 10.0), (901, 10.0, 179.99), (902, 0.0, 0.0), (903, None, 1.0)]
    right = [(i, r.uniform(-80, 80), r.uniform(-180, 180)) for i in range(60)] + [(100 + i, -33 + r.random() / 300, 151 + r.random() / 300) for i in range(300)]
    right += [(801, 10.0, -179.99), (803, 0.0, 1.0), (802, 0.0, -1.0), (810, 0.0, 1.0), (820, None, None)]
    lf, rf = spark.createDataFrame(left, "id long, lat double, lon double"), spark.createDataFrame(right, "rid long, lat double, lon double")
    some = [x for x in right if x[1] is not None]
    want = {i: min((round(km((a, b), (x[1], x[2])), 9), x[0]) for x in some) for i, a, b in left if a is not None}
    got = {x.id: (x.n, x.distance_km) for x in P.nearest(lf, rf, "id", "rid", "n", digits=6).collect()}
    assert set(got) == set(want)
    for i, (d, k) in want.items():
        assert got[i][0] == k and abs(got[i][1] - d) < 1e-5, i


@pytest.mark.parametrize("size", [10, 256, 257])
def test_nearest_has_one_answer_for_every_size(spark, size):
    """A row for each left row, also where its key repeats, and the same rows whatever the size of the right side."""
    left = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 0.0), (1, 0.049, 0.5), (2, 0.021, 0.5)], "id long, lat double, lon double")
    right = spark.range(size).select(F.col("id").alias("rid"), (F.col("id") / 100).alias("lat"), F.lit(0.5).alias("lon"))
    got = sorted((r.id, r.n) for r in P.nearest(left, right, "id", "rid", "n").collect())
    assert got == [(1, 0), (1, 0), (1, 5), (2, 2)]


def test_polygon_with_a_hole(spark):
    df = spark.createDataFrame([("POLYGON ((150 -33, 151 -33,151 -34, 150 -33), (150.1 -33.1, 150.2 -33.1, 150.2 -33.2, 150.1 -33.1))",), ("POLYGON((1 2, x 3))",), (None,)], "w string")
    got = [r.p for r in df.select(wkt_to_points("w").alias("p")).collect()]
    assert got == [[[-33.0, 150.0], [-33.0, 151.0], [-34.0, 151.0], [-33.0, 150.0]], [[2.0, 1.0], [3.0, None]], None]


def test_point_on_a_station(spark):
    p = spark.createDataFrame([("p", -33.42, 149.58)], "k string, lat double, lon double")
    s = spark.createDataFrame([("Bathurst", -33.42, 149.58), ("Orange", -33.28, 149.10)], "name string, lat double, lon double")
    r = P.nearest(p, s, "k", "name", "station").first()
    assert (r.station, r.distance_km) == ("Bathurst", 0.0)


def test_first_of_ranked_looks_at_all_stations(spark, folder, rows):
    # Customer 0 and station 0 share a place, but not a nation.
    spark.createDataFrame([(0, 1), (900, 1)], "c_custkey long, c_nationkey int").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(0, 2), (500, 1)], "s_suppkey long, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    from placewatch.catalog import QUERIES
    got = rows(QUERIES["WIN-04"](spark, folder), "c_custkey", "nearest", "distance_km")
    assert got[0] == (0, 0, 0.0) and len(got) == 2
