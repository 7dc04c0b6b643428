"""Work dealt to tasks by what it costs or returns, and bounds of what one task holds."""

import glob

from pyspark.sql import functions as F
from pyspark.sql import types as T

from placewatch.operators import joins as J
from placewatch.operators import text as X
from placewatch.sources import files as SF
from placewatch.sources import sinks as K
from placewatch.streaming import evolve as E


def _used(df):
    """Tasks that return rows."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_pairs_of_one_key_are_returned_by_many_tasks(spark, rows):
    a = spark.createDataFrame([(1, i) for i in range(200)] + [(1, 7), (2, 500), (None, 9)], "k long, a long")
    b = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (3, 5), (None, 9)], "k long, b long")
    out = J.pairs_join(a, b, "k")
    assert rows(out, "k", "a", "b") == rows(a.join(b, "k"), "k", "a", "b") and out.count() == 603
    assert _used(out) > 1
    assert rows(J.cell_join(a, b, "k", "inner", pairs=True), "k", "a", "b") == rows(J.cell_join(a, b, "k", "inner"), "k", "a", "b")


def test_code_lists_of_one_file_are_read_by_many_tasks(spark):
    df = spark.range(100).coalesce(1).select("id", F.lit('{"codes":[{"id":"a","name":"x"}]}').alias("body"))
    out = SF.code_list(df, "id", "body")
    assert out.count() == 100 and _used(out) > 1


def test_compaction_bounds_the_rows_of_a_file(spark, folder, monkeypatch):
    monkeypatch.setattr(K, "FILE_ROWS", 100)
    spark.range(1000).select(F.pmod("id", F.lit(50)).alias("k"), "id").write.parquet(f"{folder}/small")
    K.compact(spark, f"{folder}/small", f"{folder}/large", ["k"], 3)
    assert len(glob.glob(f"{folder}/large/*.parquet")) > 3 and spark.read.parquet(f"{folder}/large").count() == 1000


def test_encoder_gets_no_more_than_its_batch_and_all_rows_come_back(spark, rows):
    def encoder(texts):
        assert 0 < len(texts) <= 4
        return [[float(len(t or ""))] for t in texts]
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "x" * i) for i in range(50)], "i long, t string").coalesce(1)
    got = {r.i: list(r.embedding) for r in X.embed(df, "t", encoder, batch=4).collect()}
    assert got == {i: [0.0 if i % 3 == 0 else float(i)] for i in range(50)}


def test_each_inferred_value_is_tested_once(spark):
    known = T.StructType([T.StructField(n, T.LongType()) for n in "abcd"])
    data = [("""{"a":1,"b":2,"c":3,"d":4}""",), ("""{"a":1,"b":"x","c":null}""",), ("""{"a":1,"e":5,"f":null}""",), ("""[1]""",), ("""{}""",), ("7",)]
    values = spark.createDataFrame(data, "j string").select(F.try_parse_json("j").alias("_value"), F.lit(0).alias("_ingest_time"), F.lit("p").alias("_source_file"))
    records = E._records(values)
    out = E.typed(records, known)
    got = sorted(((r.a, r.b, r.c, r.d, r._rescued) for r in out.collect()), key=str)
    assert got == sorted([(1, 2, 3, 4, None), (1, None, None, None, '{"b":"x"}'), (1, None, None, None, '{"e":5}'), (None, None, None, None, "1"),
                          (None, None, None, None, None), (None, None, None, None, "7")], key=str)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # The last step looks at types only for the rescued text (named twice there), of fields that no column has.
    assert plan.split("\n")[0].count("SchemaOfVariant.schemaOfVariant(") <= 2
