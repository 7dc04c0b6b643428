"""Sources and sinks: the driver's tables written as landed files, read back and checked."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import history as H
from ..operators.joins import attach_scalars
from ..plans.datasets import Datasets
from ..sources import changes as C
from ..sources import files as SF
from ..sources import landing as L
from ..sources import sinks as K
from .registry import NOW, PER_DEGREE, query

LANDED = dt.datetime(2024, 1, 20, 12, 0, 0)


@query("SRC-03", "SELECT 'orders.parquet' AS file, count(*) AS n FROM orders")
def file_metadata(t):
    rows = t.orders.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"),
                           F.col("_metadata.file_modification_time").isNotNull().alias("stamped"))
    return rows.where("stamped").groupBy("file").agg(F.count("*").alias("n"))


@query("SRC-04", """
    SELECT l_orderkey, l_linenumber, l_partkey, strftime(make_timestamp(1000000 * (CAST(1705536000 AS BIGINT) + 3600 * h)), '%Y-%m-%d %H:%M:%S') AS forecast_time,
           CASE h WHEN 0 THEN l_quantity WHEN 1 THEN l_discount END AS precipitation_mm, CASE h WHEN 0 THEN l_tax WHEN 1 THEN l_quantity WHEN 2 THEN l_discount END AS temperature_c,
           CASE h WHEN 0 THEN l_quantity END AS windspeed_kmh, CASE h WHEN 0 THEN l_extendedprice WHEN 1 THEN l_tax WHEN 2 THEN l_tax END AS humidity_pct,
           CASE WHEN h < 2 THEN l_linenumber + h END AS weather_code
    FROM lineitem, (VALUES (0), (1), (2)) v(h)""")
def parallel_arrays(t):
    start = F.timestamp_micros(F.lit(1705536000000000))
    times = F.array(*[start + F.expr(f"INTERVAL {h} HOURS") for h in range(3)])
    payload = F.struct(times.alias("time"), F.array("l_quantity", "l_discount").alias("precipitation"),
                       F.array("l_tax", "l_quantity", "l_discount").alias("temperature_2m"), F.array("l_quantity").alias("windspeed_10m"),
                       F.array("l_extendedprice", "l_tax", "l_tax").alias("relative_humidity_2m"),
                       F.array(F.col("l_linenumber"), F.col("l_linenumber") + 1).alias("weather_code"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", payload.alias("hourly"))
    return L.explode_parallel_arrays(rows, "hourly", L.HOURLY,
                                     ["l_orderkey", "l_linenumber", "l_partkey"])


FEATURES = ("""concat('{"features":[{"id":"', o_orderkey, '","properties":{"mainCategory":"', o_orderpriority, '","headline":"', CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'H' END, """
            """'","isMajor":', CASE WHEN o_totalprice > 450000 THEN 'true' ELSE 'false' END, ',"ended":null,"created":', 1700000000000 + o_orderkey, ',"encodedPolylines":["a",{"coords":"xy"}],"roads":[{"suburb":"S","mainStreet":"M","region":"SYD","delay":"5"}]},'"""
            """, '"geometry":{"coordinates":[150.5,-33.25]}},{"id":', o_orderkey + 1, ',"properties":{"ended":true},"geometry":{"coordinates":[150.5]}}]}')""")


@query("SRC-05", """
    SELECT CAST(o_orderkey AS VARCHAR) AS hazard_id, o_orderpriority AS main_category, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'H' END AS headline,
           o_totalprice > 450000 AS is_major, CAST(NULL AS BOOLEAN) AS ended, 150.5 AS longitude, -33.25 AS latitude, '[{"suburb":"S","mainStreet":"M","region":"SYD","delay":"5"}]' AS roads_json,
           '["a",{"coords":"xy"}]' AS encoded_polylines_json, 'flood' AS hazard_type FROM orders
    UNION ALL SELECT CAST(o_orderkey + 1 AS VARCHAR), NULL, NULL, NULL, true, NULL, NULL, '[]', '[]', 'flood' FROM orders""")
def features(t):
    flat = L.flatten_features(t.orders.select(F.expr(FEATURES).alias("body")), "body", "flood")
    return flat.select("hazard_id", "main_category", "headline", "is_major", "ended", "longitude", "latitude", "roads_json", "encoded_polylines_json", "hazard_type")


@query("SRC-07", """
    SELECT lpad(CAST(s_suppkey AS VARCHAR), 4, '0') AS poa_code, s_name AS poa_name, s_acctbal AS area_sqkm,
           CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 'POLYGON((0 0, 1 0, 1 1, 0 ' || s_suppkey || ', 0 0))' END AS geometry_wkt FROM supplier""")
def polygons(t):
    path = K.scratch(t.spark, "polygons")
    code = F.lpad(F.col("s_suppkey").cast("string"), 4, "0")
    wkt = F.when(F.col("s_suppkey") % 7 == 0, "").otherwise(F.concat(F.lit("POLYGON((0 0, 1 0, 1 1, 0 "), F.col("s_suppkey").cast("string"), F.lit(", 0 0))")))
    t.supplier.select(code.alias("POA_CODE21"), F.col("s_name").alias("POA_NAME21"), F.col("s_acctbal").alias("AREASQKM21"), wkt.alias("wkt")).write.option("header", True).csv(path)
    return SF.read_polygons(t.spark, path, "POA_CODE21", "POA_NAME21", "AREASQKM21", "wkt").select("poa_code", "poa_name", "area_sqkm", "geometry_wkt")


@query("SRC-08", """
    SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS total, 'BIGINT' AS key_type FROM lineitem GROUP BY 1""")
def inferred_csv(t):
    paths = [K.scratch(t.spark, f"csv{i}") for i in range(2)]
    for i, p in enumerate(paths):
        t.lineitem.where(F.col("l_returnflag").isin("A") == (i == 0)).select("l_suppkey", "l_quantity").write.option("header", True).csv(p)
    df = SF.read_csv_files(t.spark, paths)
    kind = "BIGINT" if dict(df.dtypes)["l_suppkey"] in ("int", "bigint") else "other"
    return df.groupBy(F.col("l_suppkey").cast("long").alias("l_suppkey")).agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"), F.lit(kind).alias("key_type"))


@query("SRC-09", "SELECT lpad(CAST(p_size AS VARCHAR), 2, '0') AS code, count(*) AS n FROM part GROUP BY 1")
def text_csv(t):
    path = K.scratch(t.spark, "codes")
    t.part.select(F.lpad(F.col("p_size").cast("string"), 2, "0").alias("code"), "p_partkey").write.option("header", True).csv(path)
    return SF.read_csv_files(t.spark, path, strings=True).groupBy("code").agg(F.count("*").alias("n"))


@query("SRC-12", """
    SELECT c_custkey, '0' || (c_custkey % 10) AS code, c_name AS name FROM customer
    UNION ALL SELECT c_custkey, 'A', CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'text' END FROM customer""")
def nested_codes(t):
    both = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('{"de":"x","en":"'), F.col("c_mktsegment"), F.lit('"}'))).otherwise('"text"')
    first = F.concat(F.lit('{"id":"0'), (F.col("c_custkey") % 10).cast("string"), F.lit('","name":"'), F.col("c_name"), F.lit('"}'))
    codes = F.concat(F.lit('"codes":['), first, F.lit(',{"id":"A","name":'), both, F.lit('},{"name":"no id"}]'))
    body = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("{"), codes, F.lit("}"))).otherwise(
        F.concat(F.lit('{"meta":[1,{"x":2}],"data":{"a":{"b":{"c":{"d":{"codelists":[{"id":"cl",'), codes, F.lit('},{"codes":[{"id":"second"}]}]}}}}},"codes":7}')))
    return SF.code_list(t.customer.select("c_custkey", body.alias("body")), "c_custkey", "body")


@query("SRC-12-states", """
    SELECT CASE c_custkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'malformed' WHEN 2 THEN 'no list' ELSE 'listed' END AS state,
           count(*) AS n FROM customer GROUP BY 1""")
def code_list_states(t):
    """Broken, missing and list-free texts beside good ones; a text that only quotes a list holds none."""
    kind, name = F.col("c_custkey") % 5, F.col("c_name")
    quoted = F.concat(F.lit('{"note":"{\\"codes\\":[{\\"id\\":1}]}","name":"'), name, F.lit('"}'))
    good = F.concat(F.lit('[0,{"codes":[{"id":"'), name, F.lit('"}]}]'))
    body = F.when(kind == 1, F.concat(F.lit('{"codes":["'), name)).when(kind == 2, quoted).when(kind > 2, good)
    return SF.code_list_states(t.customer.select(body.alias("body")), "body")


@query("SRC-15", "SELECT length(text) AS chars, md5(replace(text, chr(12), ' ')) AS digest FROM documents WHERE trim(replace(text, chr(10), ' ')) <> ''")
def page_texts(t):
    path = K.scratch(t.spark, "pages")
    t.documents.select(F.concat(F.regexp_replace("text", "\f", " "), F.lit("\f")).alias("value")).write.option("maxRecordsPerFile", 500).text(path)
    pages = SF.read_pages(t.spark, path).withColumn("text", F.regexp_replace("text", "^\n", ""))
    return pages.where(F.trim(F.translate("text", "\n", " ")) != "").select(F.length("text").cast("long").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SRC-15-numbers", """
    SELECT doc_id // 500 AS file, row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id, text) AS page,
           md5(coalesce(replace(text, chr(12), ' '), '')) AS digest FROM documents""")
def numbered_pages(t):
    """Files of 500 documents, a page each, and the numbers that the pages get when read back."""
    path = K.scratch(t.spark, "numbered")
    file = F.floor(F.col("doc_id") / 500).cast("long")
    rows = t.documents.select(file.alias("file"), "doc_id", F.coalesce(F.regexp_replace("text", "\f", " "), F.lit("")).alias("value"))
    (rows.repartition("file").sortWithinPartitions("file", "doc_id", "value").select("file", "value")
     .write.partitionBy("file").option("lineSep", "\f").text(path))
    return SF.read_pages(t.spark, path).select(F.regexp_extract("path", r"file=(\d+)", 1).cast("long").alias("file"),
                                               F.col("page").cast("long").alias("page"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("UDF-04", "SELECT event_id, 'k' AS key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS value FROM events")
def table_functions(t):
    rows = t.events.select("event_id", F.parse_json("props").alias("v"))
    out = rows.lateralJoin(t.spark.tvf.variant_explode(F.col("v").outer()).toDF("pos", "key", "item"))
    return out.select("event_id", "key", F.variant_get("item", "$", "long").alias("value"))


# -- sinks -------------------------------------------------------------------


@query("SNK-01", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS added, CASE WHEN o_orderstatus = 'F' THEN '2024-01-19 00:00:00'
           ELSE '2024-01-20 12:00:00' END AS _ingest_time FROM orders""")
def batches(t):
    path = K.scratch(t.spark, "history")
    first = L.with_lineage(t.orders.where("o_orderstatus = 'F'").select("o_orderkey"), "orders", "2024-01-19 00:00:00")
    second = L.with_lineage(t.orders.where("o_orderstatus <> 'F'").select("o_orderkey", F.col("o_orderpriority").alias("added")), "orders", NOW)
    for b in (first, second, second.limit(0)):
        K.append_batch(b, path)
    return K.read_history(t.spark, path).select("o_orderkey", "added", "_ingest_time")


@query("SNK-02", "SELECT o_orderkey, o_totalprice FROM orders")
def overwritten(t):
    path = K.scratch(t.spark, "table")
    K.replace(t.orders.select("o_orderkey", (-F.col("o_totalprice")).alias("o_totalprice")), path)
    K.replace(t.orders.select("o_orderkey", "o_totalprice"), path)
    return t.spark.read.parquet(path)


@query("SNK-03", "SELECT l_suppkey, l_partkey, l_quantity FROM lineitem")
def clustered(t):
    path = K.scratch(t.spark, "clustered")
    K.replace(t.lineitem.select("l_suppkey", "l_partkey", "l_quantity"), path, ("l_suppkey", "l_partkey"))
    return t.spark.read.parquet(path)


@query("SNK-04", "SELECT c_custkey, 1 AS run, CASE WHEN c_acctbal < 0 THEN 'High' ELSE 'Low' END AS level FROM customer UNION ALL SELECT c_custkey, 2, 'Low' FROM customer")
def derived_history(t):
    path = K.scratch(t.spark, "derived")
    level = F.when(F.col("c_acctbal") < 0, "High").otherwise("Low")
    for run, col in ((1, level), (2, F.lit("Low"))):
        K.append_batch(t.customer.select("c_custkey", F.lit(run).alias("run"), col.alias("level")), path, partition_by=None)
    return t.spark.read.parquet(path)


@query("SNK-07", """
    SELECT 10000000000 + c_custkey AS user_abn, 20000000000 + c_nationkey AS supplier_abn, c_name AS supplier_name,
           CASE WHEN c_custkey % 2 = 0 THEN 2000 + c_nationkey END AS supplier_postcode, 'ADD' AS action FROM customer
    UNION ALL SELECT 10000000000 + c_custkey, 20000000000 + c_nationkey, '', NULL, 'REMOVE' FROM customer WHERE c_acctbal < 0""")
def event_rows(t):
    path = K.scratch(t.spark, "events")
    abn = F.concat(F.lit("10 0"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    post = F.when(F.col("c_custkey") % 2 == 0, (2000 + F.col("c_nationkey")).cast("string")).otherwise("n/a")
    rows = t.customer.select("c_acctbal", abn.alias("user_abn"), (20000000000 + F.col("c_nationkey")).cast("string").alias("supplier_abn"),
                             F.col("c_name").alias("supplier_name"), F.lit("Active").alias("supplier_status"), F.lit("Company").alias("supplier_entity_type"),
                             F.lit("NSW").alias("supplier_state"), post.alias("supplier_postcode"))
    K.append_batch(K.supplier_events(rows, "ADD", NOW), path, "added_at")
    K.append_batch(K.supplier_events(rows.where("c_acctbal < 0"), "REMOVE", "2024-01-21 00:00:00"), path, "added_at")
    return K.read_history(t.spark, path).select("user_abn", "supplier_abn", "supplier_name", "supplier_postcode", "action")


@query("SNK-09", """
    SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 2000 GROUP BY 1""")
def dataset_run(t):
    d = Datasets(t.spark, K.scratch(t.spark, "datasets"))
    d.source("orders", t.orders)
    d.define("per_customer", lambda o: o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")),
             ("priced",), cluster_by=("o_custkey",), fail={"counted": "n > 0"})
    d.define("priced", lambda o: o, ("orders",), drop={"large_enough": "o_totalprice > 2000"}, watch={"known": "o_orderstatus IN ('F', 'O')"})
    d.refresh("run1")
    return d.read("per_customer")


@query("SNK-09-audit", """
    SELECT 'priced' AS dataset, 'large_enough' AS rule, 'drop' AS action, count(*) FILTER (o_totalprice <= 2000) AS failed FROM orders
    UNION ALL SELECT 'priced', 'known', 'allow', count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) FROM orders""")
def dataset_audit(t):
    d = Datasets(t.spark, K.scratch(t.spark, "datasets"))
    d.source("orders", t.orders)
    d.define("priced", lambda o: o, ("orders",), drop={"large_enough": "o_totalprice > 2000"}, watch={"known": "o_orderstatus IN ('F', 'O')"})
    d.refresh("run1")
    return d.dropped()


@query("SNK-10", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def views(t):
    K.view(t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")), "placewatch_status")
    return t.spark.table("placewatch_status")


@query("SNK-11", "SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem")
def compacted(t):
    small, large = K.scratch(t.spark, "small"), K.scratch(t.spark, "large")
    t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber").repartition(24).write.parquet(small)
    K.compact(t.spark, small, large, ["l_suppkey"], 3)
    return t.spark.read.parquet(large)


@query("SNK-12", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def declared(t):
    path = K.scratch(t.spark, "declared")
    table = "placewatch_" + path.rsplit("-", 1)[1][:12]
    for _ in range(2):
        K.declare(t.spark, table, "o_orderkey BIGINT, month STRING", "month", "orders by month", path)
    t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month")).write.mode("append").partitionBy("month").parquet(path)
    out = t.spark.read.parquet(path).select("o_orderkey", F.col("month").cast("string").alias("month"))
    t.spark.sql(f"DROP TABLE {table}")
    return out


@query("SNK-13", "SELECT hazard_id, hazard_type, longitude FROM hazards_raw", ("hazards_raw",))
def landed(t):
    root = K.scratch(t.spark, "landing")
    K.land(t.hazards_raw.where("1 = 0"), root, "hazards", LANDED)
    path = K.land(t.hazards_raw, root, "hazards", LANDED)
    if not path.endswith("hazards/2024/01/20/120000.json"):
        raise ValueError(path)
    return L.read_landing(t.spark, root, L.HAZARD_SCHEMA, streaming=False, multi_line=False).select("hazard_id", "hazard_type", "longitude")


@query("SNK-14", """
    SELECT v.col_name, v.comment, (SELECT count(*) FROM orders) AS n_rows FROM
      (VALUES ('o_orderkey', 'the order''s key'), ('o_totalprice', 'total, dollars')) v(col_name, comment)""")
def commented(t):
    path = K.scratch(t.spark, "commented")
    table = "placewatch_" + path.rsplit("-", 1)[1][:12]
    t.orders.select("o_orderkey", "o_totalprice").write.parquet(path)
    K.declare(t.spark, table, "o_orderkey BIGINT, o_totalprice DOUBLE", location=path)
    K.document(t.spark, table, "orders", {"o_orderkey": "the order's key", "o_totalprice": "total, dollars"})
    columns = t.spark.createDataFrame([(c.name, c.description) for c in t.spark.catalog.listColumns(table)], "col_name string, comment string")
    t.spark.sql(f"DROP TABLE {table}")
    return attach_scalars(columns, t.spark.read.parquet(path).agg(F.count("*").alias("n_rows")))


@query("SNK-15", "SELECT event_id AS id, user_id AS abn, event_type AS grant_status, strftime(ts, '%Y-%m-%d %H:%M:%S') AS generated_at FROM events")
def submission_log(t):
    path = K.scratch(t.spark, "submissions")
    rows = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("abn"), F.col("event_type").alias("grant_status"), F.col("ts").alias("generated_at"))
    K.append_batch(rows, path, "generated_at")
    return K.read_history(t.spark, path).drop("_ingest_date")


@query("SNK-05-table", """
    SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'second' ELSE 'first' END AS v FROM customer""")
def versioned(t):
    path = K.scratch(t.spark, "merged")
    first = t.customer.where("c_custkey % 2 = 0 OR c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.lit("first").alias("v"))
    K.upsert_table(t.spark, path, first, ["k"])
    return K.upsert_table(t.spark, path, t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.lit("second").alias("v")), ["k"])


@query("SNK-05-changes", """
    SELECT c_custkey AS k, CASE WHEN c_custkey % 20 = 0 THEN 'third' WHEN c_custkey % 10 = 0 THEN 'second' ELSE 'first' END AS v,
      CASE WHEN c_custkey % 20 = 0 THEN c_acctbal END AS added FROM customer""")
def changed(t):
    """Three merges of fewer and fewer keys, of which the last adds a column; the first two are folded together in between."""
    path = K.scratch(t.spark, "changes")
    for name, rule in (("first", "true"), ("second", "c_custkey % 10 = 0"), ("third", "c_custkey % 20 = 0")):
        rows = t.customer.where(rule).select(F.col("c_custkey").alias("k"), F.lit(name).alias("v"), F.col("c_acctbal").alias("added"))
        C.merge_changes(t.spark, path, rows if name == "third" else rows.drop("added"), ["k"], name=name)
        if name == "second":
            C.compact_changes(t.spark, path)
    return C.read_changes(t.spark, path)


@query("SNK-11-zorder", "SELECT l_partkey, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate, l_orderkey, l_linenumber FROM lineitem")
def z_ordered(t):
    path = K.scratch(t.spark, "zorder")
    K.z_ordered(t.lineitem.select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber"), ["l_partkey", "l_shipdate"], files=16).write.parquet(path)
    return t.spark.read.parquet(path)


@query("PRJ-02-cells", """
    SELECT hazard_id, CASE WHEN longitude IS NULL THEN NULL ELSE CAST(floor((latitude + 90) * 4) AS BIGINT) * 1440 + CAST(floor((longitude + 180) * 4) AS BIGINT) END AS h3_cell,
           strftime(make_timestamp(created_ms * 1000), '%Y-%m-%d %H:%M:%S') AS created_ts FROM hazards_raw""", ("hazards_raw",))
def bronze_columns(t):
    return L.hazards_bronze(t.hazards_raw, PER_DEGREE).select("hazard_id", "h3_cell", "created_ts")


@query("SRC-04-newest", "SELECT count(*) AS n FROM weather WHERE _ingest_time = (SELECT max(_ingest_time) FROM weather)", ("weather",))
def newest_of_history(t):
    """Day folders let the newest batch be found and read without the older ones."""
    path = K.scratch(t.spark, "weather")
    K.append_batch(t.weather, path)
    df = K.read_history(t.spark, path)
    return H.latest_batch(H.latest_batch(df, "_ingest_date"), "_ingest_time").agg(F.count("*").alias("n"))
