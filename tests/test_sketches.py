"""Merged sketches against the rows they stand for."""

from pyspark.sql import functions as F

from placewatch.operators import sketches as S


def test_nulls_empty_groups_and_repeated_batches(spark, folder, rows):
    data = [("a", 1.0, "x"), ("a", 2.0, "y"), ("a", None, None), ("a", float("nan"), "x"), ("b", None, None)]
    df = spark.createDataFrame(data, "k string, v double, s string")
    batch = S.sketch_rows(df, ["k"], {"v": "v"}, {"s": ("s", None), "one": ("s", F.col("v") == 1)})
    for name in ("01", "02", "02"):
        S.keep_sketches(batch, folder, name)
    kept = S.read_sketches(spark, folder)
    assert rows(kept, "_batch", "k") == [("01", "a"), ("01", "b"), ("02", "a"), ("02", "b")]
    whole = S.merge_sketches(kept, ["k"])
    got = whole.select("k", "n_rows", S.values("v"), S.quantile("v", 1.0), S.distinct("s"), S.distinct_of("all", "s", "one"),
                       S.distinct_of("first", "s", "one"), S.distinct_of("any", "s", "one"))
    assert rows(got) == [("a", 8, 4, 2.0, 2, 1, 1, 2), ("b", 2, 0, None, 0, 0, 0, 0)]
    assert S.merge_sketches(kept.where("k = 'c'"), ["k"]).count() == 0


def test_answers_stay_inside_their_bounds_after_merges(spark):
    """A third of the rows under one key; every answer from sketches of 40 batches is within the bound."""
    n = 300_000
    df = spark.range(n).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id % 7 END AS k", "id % 40 AS batch",
                                   "CAST(pmod(xxhash64(id), 1000003) AS DOUBLE) AS v", "pmod(xxhash64(id, 1), 60000) AS u")
    whole = S.merge_sketches(S.sketch_rows(df, ["k", "batch"], {"v": "v"}, {"u": ("u", None), "low": ("u", F.col("u") < 20000)}), ["k"])
    asked = {f"q{i}": q for i, q in enumerate((0.01, 0.25, 0.5, 0.75, 0.99))}
    found = whole.select("k", S.values("v").alias("n"), *[S.quantile("v", q).alias(a) for a, q in asked.items()],
                         S.distinct("u").alias("u"), S.distinct_of("all", "u", "low").alias("low"))
    ranks = df.join(found.drop("u", "n"), "k").groupBy("k").agg(
        F.count("*").alias("exact_n"), F.count_distinct("u").alias("exact_u"), F.count_distinct(F.when(F.col("u") < 20000, F.col("u"))).alias("exact_low"),
        *[(F.count_if(F.col("v") <= F.col(a)) / F.count("*")).alias(f"r_{a}") for a in asked])
    for r in found.join(ranks, "k").collect():
        assert r.n == r.exact_n
        assert all(abs(r[f"r_{a}"] - q) <= S.rank_error() + 1e-4 for a, q in asked.items()), r
        assert abs(r.u - r.exact_u) <= S.distinct_error() * r.exact_u, r
        assert abs(r.low - r.exact_low) <= S.distinct_error() * r.exact_u, r
