"""The cell index against the exact search."""

import numpy as np
from pyspark.sql import functions as F

from placewatch.operators import vector_index as V
from placewatch.operators.vector import top_k

SCHEMA = "chunk_id long, embedding array<double>"


def clustered(spark, n=6000, groups=40, dims=16):
    rng = np.random.default_rng(7)
    heads = rng.normal(size=(groups, dims))
    rows = heads[np.arange(n) % groups] + 0.25 * rng.normal(size=(n, dims))
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], SCHEMA).repartition(6)


def asked_of(df, step):
    return df.where(F.col("chunk_id") % step == 0).select(F.col("chunk_id").alias("query_id"), "embedding")


def test_recall_and_share_of_rows_read(spark, folder):
    """Recall of 0.9 or more while a query looks into a small part of the cells; every row is in the index once."""
    df = clustered(spark)
    V.build_index(df, folder, 64)
    ids = spark.read.parquet(f"{folder}/blocks").select(F.explode("ids").alias("id"))
    assert (ids.count(), ids.distinct().count()) == (6000, 6000)
    asked = asked_of(df, 50)
    found = V.search_index(spark, folder, asked)
    share = V.recall(found, top_k(asked, df)).first()
    assert share.n_hits == 600 and share.recall >= 0.9
    few = V.recall(V.search_index(spark, folder, asked, probes=16), top_k(asked, df)).first()
    assert few.recall >= 0.9


def test_all_cells_give_the_exact_search(spark, folder, rows):
    """Copies of one vector fill a third of the rows; ties go to the smallest ids."""
    df = clustered(spark, 900).withColumn("embedding", F.when(F.col("chunk_id") % 3 == 0, F.array(*[F.lit(1.0)] * 16)).otherwise(F.col("embedding")))
    V.build_index(df, folder, 20)
    asked = asked_of(df, 9)
    assert rows(V.search_index(spark, folder, asked, probes=20)) == rows(top_k(asked, df))


def test_rows_without_a_direction_and_empty_tables(spark, folder, rows):
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [0.9, 0.1]), (None, [1.0, 0.0])], SCHEMA)
    V.build_index(odd, f"{folder}/odd", 4)
    asked = odd.select(F.col("chunk_id").alias("query_id"), "embedding").where("query_id IS NOT NULL")
    assert rows(V.search_index(spark, f"{folder}/odd", asked, 2, 4), "query_id", "chunk_id", "rank") == [(1, 1, 1), (1, 5, 2), (5, 1, 2), (5, 5, 1)]
    V.build_index(odd.where("chunk_id > 9"), f"{folder}/none", 4)
    assert V.search_index(spark, f"{folder}/none", asked).count() == 0
    assert V.search_index(spark, f"{folder}/odd", asked.where("query_id > 9")).count() == 0


def test_exact_search_in_several_blocks(spark, rows):
    df = clustered(spark, 300)
    asked = asked_of(df, 5)
    assert rows(top_k(asked, df, block=7)) == rows(top_k(asked, df))
    assert top_k(asked.where("query_id < 0"), df).count() == 0
