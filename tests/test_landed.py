"""Landed files without a schema, counted streams, newest rows as state, merges without rewriting, Z-order."""

import glob
import json
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from placewatch.catalog import QUERIES
from placewatch.operators import quality as Q
from placewatch.sources import changes as C
from placewatch.sources import landing as L
from placewatch.sources import sinks as K
from placewatch.streaming import evolve as E
from placewatch.streaming import ingest as I


def land(folder, name, text):
    os.makedirs(f"{folder}/in", exist_ok=True)
    with open(f"{folder}/in/{name}.json", "w") as f:
        f.write(text if isinstance(text, str) else json.dumps(text, indent=1))


def size(folder):
    return sum(os.path.getsize(f) for f in glob.glob(f"{folder}/**/*.parquet", recursive=True))


def test_new_fields_become_columns_and_misfits_are_rescued(spark, folder):
    def run():
        return E.ingest_inferred(spark, f"{folder}/in", f"{folder}/out", f"{folder}/cp")

    land(folder, "a", [{"a": 1, "b": "x", "c": 1.5, "later": None}, {"a": 2, "b": None}])
    assert run() == 1
    first = E.read_inferred(spark, f"{folder}/out", f"{folder}/cp")
    assert dict(first.dtypes) == {"a": "bigint", "b": "string", "c": "double", "_rescued": "string", "_malformed": "boolean",
                                       "_ingest_time": "timestamp", "_source_file": "string"}
    land(folder, "b", [{"a": 2.5, "b": 7, "c": 3, "d": {"k": [1, 2]}, "later": True}, {"a": "three", "B": "other case"}, 5])
    land(folder, "c", "[{\"a\": 1")
    land(folder, "e", [])
    assert run() == 2 and run() == 2          # the third run finds nothing new
    out = E.read_inferred(spark, f"{folder}/out", f"{folder}/cp")
    assert dict(out.dtypes)["d"] == "variant" and dict(out.dtypes)["later"] == "boolean"
    got = [(r.a, r.b, r.c, r.d, r.later, json.loads(r._rescued) if r._rescued else None, r._malformed)
           for r in out.withColumn("d", F.to_json("d")).collect()]
    want = [(1, "x", 1.5, None, None, None, False), (2, None, None, None, None, None, False),
            (None, None, 3.0, '{"k":[1,2]}', True, {"a": 2.5, "b": 7}, False), (None, None, None, None, None, {"a": "three", "B": "other case"}, False),
            (None, None, None, None, None, 5, False), (None, None, None, None, None, None, True)]
    assert all(g in want for g in got) and len(got) == len(want)


def test_columns_have_a_limit_and_other_errors_are_no_new_fields(spark, folder):
    land(folder, "a", [{"a": 1, "b": 2, "c": 3}])
    assert E.ingest_inferred(spark, f"{folder}/in", f"{folder}/out", f"{folder}/cp", most=2) == 1
    row = E.read_inferred(spark, f"{folder}/out", f"{folder}/cp").first()
    assert (row.a, row.b, row._rescued) == (1, 2, '{"c":3}')
    land(folder, "b", [{"a": 1}])
    with pytest.raises(Exception, match="no_such_column"):
        E.ingest_inferred(spark, f"{folder}/in", f"{folder}/out", f"{folder}/cp", shape=lambda df: df.select("no_such_column"), most=2)
    with pytest.raises(ValueError, match="nothing has been ingested"):
        E.read_inferred(spark, f"{folder}/none", f"{folder}/none")


def test_large_numbers_are_not_changed(spark, folder):
    land(folder, "a", '[{"x": 0.1, "n": 1}]')
    land(folder, "b", '[{"x": 1234567890.123456789012345, "n": 9007199254740993}, {"x": 12345678901234567, "n": 2}]')
    E.ingest_inferred(spark, f"{folder}/in", f"{folder}/out", f"{folder}/cp", max_files=1)
    got = {r.n: (r.x, r._rescued) for r in E.read_inferred(spark, f"{folder}/out", f"{folder}/cp").collect()}
    assert got == {1: (0.1, None), 9007199254740993: (None, '{"x":1234567890.123456789012345}'), 2: (None, '{"x":12345678901234567}')}


def test_rules_are_counted_in_the_pass_that_writes(spark, folder, rows):
    land(folder, "a", [{"kind": "flood"}, {"kind": "quake"}, {"kind": None}])
    rules, watched = {"known": "kind = 'flood'"}, {"long": "length(kind) > 5"}
    for audit in (None, f"{folder}/audit"):
        stream = L.read_landing(spark, f"{folder}/in", "kind string")
        I.ingest(stream, f"{folder}/out{bool(audit)}", f"{folder}/cp{bool(audit)}", rules, watched, audit).awaitTermination()
    assert os.listdir(f"{folder}/outTrue") == os.listdir(f"{folder}/outFalse") == ["batch=0"]
    assert rows(spark.read.parquet(f"{folder}/audit"), "rule", "action", "passed", "failed") == [("known", "drop", 1, 2), ("long", "allow", 0, 3)]
    batch = spark.createDataFrame([("flood",)], "kind string")
    counted, _ = Q.expect(batch, {**rules, **watched})
    assert Q.keep_valid(counted, rules)._jdf.queryExecution().executedPlan().toString().count("CollectMetrics") == 1


def test_flow_audit_counts_late_rows(spark, folder):
    def put(name, days):
        spark.createDataFrame([(f"2026-05-{d:02d} 10:00:00", k) for k, d in days], "ts string, k long").select(
            F.col("ts").cast("timestamp").alias("ts"), "k").coalesce(1).write.parquet(f"{folder}/in/{name}")

    audit = I.FlowAudit(spark, f"{folder}/audit", "x")
    for name, days in (("a", [(1, 1), (2, 9)]), ("b", [(3, 1), (4, 2), (5, 9), (6, 8)])):
        put(name, days)
        s = spark.readStream.schema("ts timestamp, k long").option("recursiveFileLookup", True).parquet(f"{folder}/in")
        audit.follow(lambda s=s: I.store_rollup(I.daily_rollup(s, "ts", ["k"], {"n": F.count("*")}), f"{folder}/t", ["day", "k"], f"{folder}/cp"))
    assert audit.table().agg(F.sum("rows"), F.sum("late")).first()[:] == (6, 2)
    assert sorted(r.k for r in C.read_changes(spark, f"{folder}/t").collect()) == [1, 2, 5, 6]


def test_late_older_rows_write_nothing(spark, folder, rows):
    """Only keys whose newest row changed are written; the state is kept between runs."""
    def run(name, data):
        spark.createDataFrame(data, "k long, at long, v string").coalesce(1).write.parquet(f"{folder}/in/{name}")
        s = spark.readStream.schema("k long, at long, v string").option("recursiveFileLookup", True).parquet(f"{folder}/in")
        I.keep_latest(s, f"{folder}/t", ["k"], ["at"], f"{folder}/cp").awaitTermination()
        last = max(glob.glob(f"{folder}/t/rows-*"), key=os.path.getmtime)
        return rows(spark.read.parquet(last), "k", "v")

    assert run("a", [(1, 5, "a5"), (1, 4, "a4"), (2, 1, "b1"), (3, None, "n")]) == [(1, "a5"), (2, "b1"), (3, "n")]
    assert run("b", [(1, 3, "late"), (2, 9, "b9"), (3, 0, "zero"), (1, 5, "tie")]) == [(2, "b9"), (3, "zero")]
    assert run("c", [(1, 1, "later still")]) == []
    assert rows(C.read_changes(spark, f"{folder}/t"), "k", "v") == [(1, "a5"), (2, "b9"), (3, "zero")]


def test_a_merge_of_few_keys_writes_few_bytes(spark, folder, rows):
    path = f"{folder}/t"
    C.merge_changes(spark, path, spark.range(100_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")), ["k"], name="0")
    whole = size(path)
    few = spark.range(1000).select((F.col("id") * 100).alias("k"), F.sha2((F.col("id") * 100 + 1).cast("string"), 256).alias("v"))
    for _ in range(2):      # a repeated micro-batch counts once
        C.merge_changes(spark, path, few, ["k"], name="1")
    assert size(path) - whole < 0.02 * whole
    want = rows(C.read_changes(spark, path))
    assert len(want) == 100_000 and C.read_changes(spark, path).join(few, ["k", "v"]).count() == 1000
    C.compact_changes(spark, path, 4)
    assert rows(C.read_changes(spark, path)) == want
    C.merge_changes(spark, path, few, ["k"], name="1")
    C.compact_changes(spark, path, 4)
    assert rows(C.read_changes(spark, path)) == want


def test_merges_of_null_keys_new_columns_and_no_rows(spark, folder):
    path = f"{folder}/t"
    with pytest.raises(ValueError, match="no merge"):
        C.read_changes(spark, path)
    C.merge_changes(spark, path, spark.createDataFrame([], "k long, v string"), ["k"])
    assert C.read_changes(spark, path).count() == 0
    C.merge_changes(spark, path, spark.createDataFrame([(None, "a"), (1, "b"), (2, "c")], "k long, v string"), ["k"])
    C.merge_changes(spark, path, spark.createDataFrame([(None, "n", 7)], "k long, v string, w int"), ["k"])
    assert {(r.k, r.v, r.w) for r in C.read_changes(spark, path).collect()} == {(None, "n", 7), (1, "b", None), (2, "c", None)}
    with pytest.raises(Exception, match="more than one row"):
        C.merge_changes(spark, path, spark.createDataFrame([(1, "x"), (1, "y")], "k long, v string"), ["k"])
    with pytest.raises(ValueError, match="v is string"):
        C.merge_changes(spark, path, spark.createDataFrame([(1, 2)], "k long, v long"), ["k"])
    with pytest.raises(ValueError, match="has the keys"):
        C.merge_changes(spark, path, spark.createDataFrame([(1, "x")], "k long, v string"), ["v"])
    # What a failed merge left behind was never published.
    spark.range(3).write.parquet(f"{path}/rows-lost")
    assert C.read_changes(spark, path).count() == 3


def test_first_merges_without_rows_and_failed_ones(spark, folder, rows):
    empty = spark.createDataFrame([], "k long, v string")
    assert K.upsert_table(spark, f"{folder}/t", empty, ["k"], buckets=4).columns == ["k", "v"]
    assert rows(K.upsert_table(spark, f"{folder}/t", spark.createDataFrame([(1, "a")], "k long, v string"), ["k"], buckets=4)) == [(1, "a")]
    broken = spark.range(2).select(F.raise_error(F.lit("broken")).cast("long").alias("k"), F.lit("x").alias("v"))
    with pytest.raises(Exception, match="broken"):
        K.upsert_table(spark, f"{folder}/u", broken, ["k"], buckets=4)
    assert rows(K.upsert_table(spark, f"{folder}/u", spark.createDataFrame([(1, "a")], "k long, v string"), ["k"], buckets=8)) == [(1, "a")]


def test_notes_are_replaced_and_numbered(spark, folder):
    for text in ("a", "b"):
        K.note(spark, f"{folder}/_n", text)
    assert K.noted(spark, f"{folder}/_n") == "b"
    assert [K.note_next(spark, f"{folder}/log", x) for x in "xy"] == [1, 2] and K.note_next(spark, f"{folder}/log", "z", 2) is None
    assert K.noted(spark, f"{folder}/log/_00000002") == "y" and K.notes(spark, f"{folder}/log") == [1, 2]


def test_z_order_lets_readers_skip_by_each_column(spark, folder):
    """Files whose range of the column holds a value, summed over some values: Z-order against sorting by the first column."""
    df = spark.range(40_000).select((F.xxhash64("id") % 1000).alias("a"), F.concat(F.lit("s"), F.lpad(F.abs(F.hash("id") % 1000).cast("string"), 4, "0")).alias("b"), "id")
    df = df.withColumn("a", F.when(F.col("id") % 50 == 0, None).otherwise(F.col("a")))
    K.z_ordered(df, ["a", "b"], 16).write.parquet(f"{folder}/z")
    K.clustered(df, ["a", "b"], 16).write.parquet(f"{folder}/s")

    def touched(name, column, values):
        total = 0
        for f in glob.glob(f"{folder}/{name}/*.parquet"):
            meta = pq.ParquetFile(f).metadata
            at = meta.schema.names.index(column)
            groups = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
            low, high = min(s.min for s in groups if s.has_min_max), max(s.max for s in groups if s.has_min_max)
            total += sum(low <= v <= high for v in values)
        return total

    whole = 16 * 20
    a, b = [v * 90 - 900 for v in range(20)], [f"s{v * 49:04d}" for v in range(20)]
    assert touched("z", "a", a) < 0.5 * whole and touched("z", "b", b) < 0.5 * whole
    assert touched("s", "b", b) > 0.9 * whole
    assert spark.read.parquet(f"{folder}/z").count() == 40_000
    assert K.z_ordered(df.limit(0), ["a"], 4).count() == 0


def test_records_do_not_carry_their_array(spark, folder):
    # Behind the generator each record of a file would come with a copy of the whole file.
    import re
    spark.createDataFrame([('[{"a": 1}, 2, null]',), (None,)], "t string").write.parquet(f"{folder}/t")
    values = spark.read.parquet(f"{folder}/t").select(F.try_parse_json("t").alias("_value"), F.lit(None).cast("timestamp").alias("_ingest_time"), F.lit("f").alias("_source_file"))
    records = E._records(values)
    plan = records.select("_malformed", "_fields", "_source_file")._jdf.queryExecution().executedPlan().toString()
    assert "Generate inline" in plan and re.search(r"\), \[[^\]]*_value#\d+[^\]]*\], (false|true)", plan) is None
    assert sorted(r._malformed for r in records.select("_malformed").collect()) == [False, False, False, True]


@pytest.mark.parametrize("first, kind", [(0, "bigint"), (5_100_000_000_000, "decimal(30,0)")])
def test_sums_of_inferred_times_outgrow_a_bigint(spark, folder, first, kind):
    """As many rows of one type as make the sum too large would be millions; here a few have late times."""
    n = 2000
    (spark.range(first, first + n).select(
        F.col("id").alias("o_orderkey"), F.lit(7).cast("long").alias("o_custkey"), F.lit("2-HIGH").alias("o_orderpriority"),
        F.lit(1000.5).alias("o_totalprice"), F.lit("F").alias("o_orderstatus")).write.parquet(f"{folder}/orders.parquet"))
    out = QUERIES["SRC-02-inferred"](spark, folder)
    want = sum(1700000000000 + 1000 * k for k in range(first, first + n))
    assert dict(out.dtypes)["created"] == kind and (want > 2**63) == (kind != "bigint")
    assert [(r.hazard_type, r.n, int(r.created), r.dropped) for r in out.collect()] == [("fire", n, want, 0)]
