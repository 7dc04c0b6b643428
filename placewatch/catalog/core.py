"""Projections, filters, joins, aggregates, windows and sorts on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import history as H
from ..operators import joins as J
from ..operators import reshape as R
from ..operators.quality import probe_values
from ..plans.rules import BOX
from ..sources.landing import with_lineage
from .registry import NOW, query

# -- projections -------------------------------------------------------------


@query("PRJ-01", """
    SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS nation, c_name AS name, c_acctbal AS balance,
           CAST(NULL AS VARCHAR) AS note FROM customer""")
def contract(t):
    want = T.StructType([T.StructField("id", T.LongType()), T.StructField("nation", T.LongType()),
                         T.StructField("name", T.StringType()), T.StructField("balance", T.DoubleType()),
                         T.StructField("note", T.StringType())])
    named = t.customer.withColumnsRenamed({"c_custkey": "id", "c_nationkey": "nation", "c_name": "name", "c_acctbal": "balance"})
    return R.to_contract(named, want)


@query("PRJ-02", """
    SELECT o_orderkey, 'orders' AS _source, '2024-01-20 12:00:00' AS _ingest_time FROM orders""")
def lineage(t):
    return with_lineage(t.orders.select("o_orderkey"), "orders", NOW)


@query("PRJ-03", """
    SELECT hazard_id, coalesce(display_name, headline, 'unnamed') AS label FROM hazards_raw""", ("hazards_raw",))
def fallback(t):
    df = t.hazards_raw
    return df.select("hazard_id", F.coalesce(R.first_present(df, "display_name", "absent.path", "headline"), F.lit("unnamed")).alias("label"))


@query("PRJ-04", """
    SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN
      (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON c_custkey = o_custkey""")
def zeros(t):
    done = t.orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    return R.zero_fill(J.left_with(t.customer.select("c_custkey"), done, {"c_custkey": "o_custkey"}), ["n_orders"])


@query("PRJ-05", """
    SELECT l_orderkey, l_linenumber, l_partkey, 'NSW' AS state, l_quantity - l_discount AS delta FROM lineitem""")
def constants(t):
    base = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")
    return R.derive(base, {"state": F.lit("NSW"), "delta": "l_quantity - l_discount"}).drop("l_quantity", "l_discount")


# -- filters -----------------------------------------------------------------


@query("FLT-01", """
    SELECT hazard_id, longitude, latitude FROM hazards_raw
    WHERE latitude BETWEEN -37.5 AND -28.0 AND longitude BETWEEN 145.0 AND 150.0""", ("hazards_raw",))
def in_box(t):
    return t.hazards_raw.where(F.col("latitude").between(*BOX["lat"]) & F.col("longitude").between(145.0, 150.0)).select(
        "hazard_id", "longitude", "latitude")


@query("FLT-02", """
    SELECT event_id, user_id FROM events
    WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' AND ts < TIMESTAMP '2024-01-21 12:00:00'""")
def half_open(t):
    return H.time_window(t.events, "ts", NOW, 24).select("event_id", "user_id")


@query("FLT-03", """
    SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer#00000%'
      AND regexp_full_match(lpad(CAST(c_custkey AS VARCHAR), 4, '0'), '^0\\d{3}$')""")
def prefix_and_pattern(t):
    code = S.padded_code("c_custkey", 4)
    return t.customer.where(F.col("c_name").like("Customer#00000%") & code.rlike(r"^0\d{3}$")).select("c_custkey", "c_name")


@query("FLT-04", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), lower('RED'))")
def contains(t):
    return t.part.where(S.contains_ci("p_name", "RED")).select("p_partkey", "p_name")


@query("FLT-05", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def in_list(t):
    return t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).select("o_orderkey")


@query("FLT-06", """
    SELECT hazard_id, hazard_type FROM hazards_raw WHERE ended = false AND longitude IS NOT NULL""", ("hazards_raw",))
def open_and_placed(t):
    return t.hazards_raw.where(~F.col("ended") & F.col("longitude").isNotNull()).select("hazard_id", "hazard_type")


@query("FLT-07", """
    SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)""")
def newest_rows(t):
    return H.latest_batch(t.orders, "o_orderdate").select("o_orderkey", "o_custkey")


@query("FLT-08", """
    SELECT c_custkey, CASE WHEN NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)
           THEN 'Customer ' || c_custkey || ' has no large order' END AS error FROM customer""")
def missing_error(t):
    large = t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    text = F.concat(F.lit("Customer "), F.col("c_custkey").cast("string"), F.lit(" has no large order"))
    return J.with_missing_error(t.customer.select("c_custkey"), large, "c_custkey", text)


@query("FLT-09", """
    SELECT event_id, ts > TIMESTAMP '2024-01-19 12:00:00' AS is_fresh FROM events""")
def fresh(t):
    return H.freshness(t.events.select("event_id", "ts"), "ts", NOW, 24).drop("ts")


@query("FLT-10", """
    SELECT doc_id FROM documents WHERE try_cast(CASE WHEN n_chars < 200 THEN 'too short' END AS VARCHAR) IS NULL""")
def no_parse_error(t):
    marked = t.documents.select("doc_id", F.to_json(F.struct(F.when(F.col("n_chars") < 200, "too short").alias("error_status"))).alias("j"))
    return marked.where(F.try_variant_get(F.parse_json("j"), "$.error_status", "string").isNull()).select("doc_id")


# -- joins -------------------------------------------------------------------


@query("JON-01", """
    SELECT c_custkey, n_orders, total, biggest FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey
    LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON b.o_custkey = c_custkey
    LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS biggest FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) c ON c.o_custkey = c_custkey""")
def star(t):
    o = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    n = o.groupBy("c_custkey").agg(F.count("*").alias("n_orders"))
    total = o.where("o_orderstatus = 'O'").groupBy("c_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    big = o.where("o_orderstatus = 'P'").groupBy("c_custkey").agg(F.max("o_totalprice").alias("biggest"))
    return J.star(t.customer.select("c_custkey"), [(n, "c_custkey"), (total, "c_custkey"), (big, "c_custkey")])


@query("JON-02", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def differing_names(t):
    return J.left_with(t.customer, t.nation, {"c_nationkey": "n_nationkey"}).select("c_custkey", "n_name")


@query("JON-03", """
    SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders
      ON c_custkey = o_custkey AND o_orderstatus = 'P' AND o_totalprice > 300000""")
def right_filter(t):
    return J.left_with(t.customer, t.orders, {"c_custkey": "o_custkey"},
                       "o_orderstatus = 'P' AND o_totalprice > 300000").select("c_custkey", "o_orderkey")


@query("JON-04", """
    SELECT c_custkey, n_name FROM customer LEFT JOIN
      (SELECT lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS code, n_name FROM nation WHERE n_nationkey < 20)
      ON lpad(CAST(c_nationkey AS VARCHAR), 4, '0') = code""")
def across_types(t):
    codes = t.nation.where("n_nationkey < 20").select(F.lpad(F.col("n_nationkey").cast("string"), 4, "0").alias("code"), "n_name")
    return J.join_code(t.customer, codes, "c_nationkey", "code").select("c_custkey", "n_name")


@query("JON-05", """
    SELECT poa_code, hazard_id, hazard_type FROM cover JOIN active USING (h3_cell)""", ("cover", "active"))
def cells(t):
    active = H.latest_batch(t.hazards).where(~F.col("ended") & F.col("h3_cell").isNotNull())
    return J.cell_join(t.cover, active, "h3_cell", "inner", pairs=True).select("poa_code", "hazard_id", "hazard_type")


@query("JON-06", """
    SELECT m.poa_code, strftime(w.forecast_time, '%Y-%m-%d %H:%M:%S') AS forecast_time, w.precipitation_mm FROM weather_map m
    JOIN weather_now w ON m.nearest_weather_location = w.location_name""", ("weather_map", "weather_now"))
def key_map_facts(t):
    rain = H.latest_batch(t.weather).select("location_name", "forecast_time", "precipitation_mm")
    out = J.via_map(rain, t.weather_map, "nearest_weather_location", "location_name")
    return out.select("poa_code", "forecast_time", "precipitation_mm")


@query("JON-07", """
    SELECT strftime(coalesce(o.day, s.day), '%Y-%m-%d') AS day, coalesce(n_orders, 0) AS n_orders, coalesce(n_lines, 0) AS n_lines
    FROM (SELECT o_orderdate AS day, count(*) AS n_orders FROM orders GROUP BY 1) o
    FULL JOIN (SELECT l_shipdate AS day, count(*) AS n_lines FROM lineitem GROUP BY 1) s ON o.day = s.day""")
def full_outer(t):
    o = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n_orders"))
    s = t.lineitem.groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("n_lines"))
    return R.zero_fill(J.full_outer_coalesce(o, s, ["day"]), ["n_orders", "n_lines"])


@query("JON-09", """
    SELECT o_custkey AS key, CASE WHEN n_name IS NULL THEN 'missing' ELSE 'found' END AS outcome
    FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN (SELECT c_custkey, n_name FROM customer JOIN nation
      ON c_nationkey = n_nationkey WHERE c_acctbal > 0) ON c_custkey = o_custkey""")
def bulk(t):
    keys = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    found, missing = J.bulk_lookup(keys, t.customer.where("c_acctbal > 0"), "c_custkey")
    return R.union_tagged({"found": found.select(F.col("c_custkey").alias("key")),
                           "missing": missing.select(F.col("c_custkey").alias("key"))}, "outcome")


@query("JON-10", """
    SELECT r_regionkey, r_name, (SELECT count(*) FROM nation) AS n_nations, (SELECT max(c_acctbal) FROM customer) AS top_balance
    FROM region""")
def scalars(t):
    n = t.nation.agg(F.count("*").alias("n_nations"))
    b = t.customer.agg(F.max("c_acctbal").alias("top_balance"))
    return J.attach_scalars(J.attach_scalars(t.region, n), b)


@query("JON-11", """
    SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS biggest,
           (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n_done FROM customer""")
def correlated(t):
    per = t.orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("biggest"),
                                            F.count_if(F.col("o_orderstatus") == "F").alias("n_done"))
    return R.zero_fill(J.left_with(t.customer.select("c_custkey"), per, {"c_custkey": "o_custkey"}), ["n_done"])


@query("JON-12", """
    SELECT o_orderkey, n_name AS name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation
      ON n_nationkey = c_nationkey AND n_nationkey < 15""")
def code_names(t):
    coded = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return J.left_with(coded, t.nation, {"c_nationkey": "n_nationkey"}, "n_nationkey < 15").select("o_orderkey", F.col("n_name").alias("name"))


@query("JON-13", r"""
    SELECT doc_id, lang, word FROM (SELECT doc_id, lang, unnest(string_split(text, ' ')) AS word FROM documents)""")
def lateral(t):
    return t.documents.select("doc_id", "lang", F.explode(F.split("text", " ")).alias("word"))


@query("JON-14", """
    SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id
      ORDER BY ts DESC, event_id) AS rn FROM events WHERE ts <= TIMESTAMP '2024-01-20 12:00:00') WHERE rn = 1""")
def as_of(t):
    return H.nearest_in_time(t.events, ["user_id"], "ts", NOW, "last_before", ["event_id"]).select("user_id", "event_id", "event_type")


@query("SKEW-JOIN", "SELECT l_returnflag, n_name, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey "
                    "JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL")
def salted(t):
    lines = t.lineitem.select(F.col("l_suppkey").alias("s_suppkey"), "l_returnflag", "l_orderkey", "l_linenumber")
    met = J.spread_join(lines, t.supplier, "s_suppkey", ["l_orderkey", "l_linenumber"], rows=100)
    return J.left_with(met, t.nation, {"s_nationkey": "n_nationkey"}).groupBy("l_returnflag", "n_name").agg(F.count("*").alias("n"))


# -- aggregates --------------------------------------------------------------


@query("AGG-01", """
    SELECT event_id, user_id, event_type, value FROM events
    WHERE date_trunc('day', ts) = (SELECT max(date_trunc('day', ts)) FROM events)""")
def newest_batch(t):
    return H.latest_batch(t.events.withColumn("batch", F.to_date("ts")), "batch").select("event_id", "user_id", "event_type", "value")


@query("AGG-02", """
    SELECT l_suppkey, min(l_quantity) AS lo, max(l_quantity) AS hi, round(sum(l_extendedprice), 2) AS total,
           round(avg(l_quantity), 4) AS mean FROM lineitem GROUP BY 1""")
def per_group(t):
    return A.summarise(t.lineitem, ["l_suppkey"], {
        "lo": F.min("l_quantity"), "hi": F.max("l_quantity"), "total": F.round(F.sum("l_extendedprice"), 2),
        "mean": F.round(F.avg("l_quantity"), 4)})


@query("AGG-03", """
    SELECT l_suppkey, count(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_partkey END) AS a,
           count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS r,
           count(DISTINCT CASE WHEN l_discount > 0.05 THEN l_partkey END) AS cheap,
           count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1""")
def distinct_by_condition(t):
    flag = F.col("l_returnflag")
    return A.conditional_distinct(t.lineitem, ["l_suppkey"], {"a": flag == "A", "r": flag == "R", "cheap": F.col("l_discount") > 0.05},
                                  "l_partkey", total="parts")


@query("AGG-04", "SELECT o_custkey, count(DISTINCT o_orderdate) AS days FROM orders GROUP BY 1")
def distinct_days(t):
    return A.distinct_count(t.orders, ["o_custkey"], "o_orderdate", "days")


@query("AGG-05", """
    SELECT o_custkey, max(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN o_totalprice END) AS urgent_done,
           max(CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'O' THEN o_totalprice END) AS low_open
    FROM orders GROUP BY 1""")
def pivot_by_condition(t):
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    return A.pivot_max(t.orders, ["o_custkey"], {"urgent_done": (p == "1-URGENT") & (s == "F"), "low_open": (p == "5-LOW") & (s == "O")},
                       "o_totalprice")


@query("AGG-06", """
    SELECT user_id, arg_min(value, event_id) FILTER (event_type = 'click') AS clicks,
           arg_min(value, event_id) FILTER (event_type = 'view') AS views,
           arg_min(value, event_id) FILTER (event_type = 'purchase') AS purchases, CAST(NULL AS DOUBLE) AS refunds
    FROM events GROUP BY 1""")
def pivot_by_code(t):
    return A.pivot_first(t.events, ["user_id"], "event_type", "value",
                         {"click": "clicks", "view": "views", "purchase": "purchases", "refund": "refunds"}, ["event_id"])


@query("AGG-07", """
    SELECT l_returnflag, l_linestatus, quantile_disc(l_extendedprice, 0.5) AS median_value, min(l_extendedprice) AS min_value,
           max(l_extendedprice) AS max_value, count(DISTINCT l_suppkey) AS n_members FROM lineitem GROUP BY 1, 2""")
def median_exact(t):
    return A.spread(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_suppkey", exact=True)


@query("AGG-07-quantiles", """
    SELECT l_suppkey, quantile_disc(l_quantity, 0.25) AS q1, quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY 1""")
def quantiles(t):
    q1 = A.discrete_quantile(t.lineitem, ["l_suppkey"], "l_quantity", 0.25, "q1")
    return q1.join(A.discrete_quantile(t.lineitem, ["l_suppkey"], "l_extendedprice", 0.95, "p95"), "l_suppkey")


@query("AGG-08", """
    WITH m AS (SELECT l_suppkey, l_returnflag, l_linestatus, quantile_disc(l_extendedprice, 0.5) AS v FROM lineitem GROUP BY 1, 2, 3)
    SELECT l_suppkey, max(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN v END) AS af,
           max(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN v END) AS no FROM m GROUP BY 1""")
def median_pivot(t):
    f, s = F.col("l_returnflag"), F.col("l_linestatus")
    return A.median_then_pivot(t.lineitem, ["l_suppkey"], ["l_returnflag", "l_linestatus"], "l_extendedprice",
                               {"af": (f == "A") & (s == "F"), "no": (f == "N") & (s == "O")}, exact=True)


@query("AGG-09", """
    SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS open
    FROM orders GROUP BY 1""")
def counts_by_type(t):
    s = F.col("o_orderstatus")
    return A.summarise(t.orders, ["o_custkey"], {"n": F.count("*"), "done": F.count_if(s == "F"), "open": F.count_if(s == "O")})


@query("AGG-10", """
    SELECT l_returnflag, count(*) AS n_rows, count(DISTINCT l_suppkey) AS n_l_suppkey, count(DISTINCT l_partkey) AS n_l_partkey
    FROM lineitem GROUP BY 1""")
def coverage(t):
    return A.coverage(t.lineitem, ["l_returnflag"], ["l_suppkey", "l_partkey"])


@query("AGG-11", """
    SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 15""")
def biggest_groups(t):
    return H.top(probe_values(t.lineitem, "l_partkey"), [F.desc("n"), "l_partkey"], 15)


@query("AGG-14", """
    SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY rn) AS top_orders FROM
      (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
    WHERE rn <= 3 GROUP BY 1""")
def top_structs(t):
    packed = H.collect_top(t.orders, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3, ["o_orderkey", "o_totalprice"], "rows")
    return packed.select("o_custkey", F.array_join(F.transform("rows", lambda r: r["o_orderkey"].cast("string")), ",").alias("top_orders"))


@query("AGG-15", """
    SELECT poa_code, string_agg(h3_cell, ',' ORDER BY h3_cell) AS cells FROM cover GROUP BY 1""", ("cover",))
def cell_lists(t):
    # A place has a fixed number of cells; the list is its result.
    per = t.cover.groupBy("poa_code").agg(F.array_sort(F.collect_list("h3_cell")).alias("c"))
    return per.select("poa_code", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("cells"))


@query("AGG-17", """
    SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_custkey) AS customers,
           count(*) FILTER (o_orderstatus = 'F') AS done FROM orders""")
def whole_table(t):
    return t.orders.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"),
                        F.countDistinct("o_custkey").alias("customers"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))


# -- windows and sorts -------------------------------------------------------


@query("WIN-01", """
    SELECT o_orderkey FROM (SELECT *, dense_rank() OVER (ORDER BY date_trunc('month', o_orderdate) DESC) AS r FROM orders) WHERE r = 1""")
def ranked_batch(t):
    return H.latest_batch(t.orders.withColumn("batch", F.trunc("o_orderdate", "month")), "batch").select("o_orderkey")


@query("WIN-02", """
    SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY
      abs(epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-20 12:00:00')), ts, event_id) AS rn FROM events) WHERE rn = 1""")
def closest_in_time(t):
    return H.nearest_in_time(t.events, ["user_id"], "ts", NOW, "nearest", ["event_id"]).select("user_id", "event_id")


@query("WIN-03", """
    WITH last AS (SELECT *, row_number() OVER (PARTITION BY user_abn, supplier_abn ORDER BY added_at DESC,
      CASE WHEN action = 'ADD' THEN 0 ELSE 1 END DESC, event_id DESC) AS rn FROM supplier_log)
    SELECT user_abn, supplier_abn, event_id FROM last WHERE rn = 1 AND action = 'ADD'""", ("supplier_log",))
def present_pairs(t):
    log = t.supplier_log.select("user_abn", "supplier_abn", "event_id", "added_at", "action")
    return H.latest_event(log, ["user_abn", "supplier_abn"], "added_at", "action").select("user_abn", "supplier_abn", "event_id")


@query("WIN-05", """
    SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn
      FROM orders WHERE o_orderdate <= TIMESTAMP '1999-06-30 00:00:00') WHERE rn = 1""")
def last_before(t):
    return H.nearest_in_time(t.orders, ["o_custkey"], "o_orderdate", "1999-06-30 00:00:00", "last_before", ["o_orderkey"]).select(
        "o_custkey", "o_orderkey")


@query("SRT-01", """
    SELECT hazard_id, impacting_network, row_number() OVER (ORDER BY impacting_network DESC NULLS LAST, last_updated_ms DESC NULLS LAST, hazard_id) AS pos
    FROM hazards_raw""", ("hazards_raw",))
def mixed_order(t):
    order = [F.col("impacting_network").desc_nulls_last(), F.col("last_updated_ms").desc_nulls_last(), F.col("hazard_id")]
    return H.positions(t.hazards_raw.select("hazard_id", "impacting_network", "last_updated_ms"), order, "pos").select("hazard_id", "impacting_network", "pos")


@query("SRT-02", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_overall(t):
    return H.top(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 10)


@query("SRT-03", """
    SELECT o_custkey, o_orderkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn
      FROM orders) WHERE rn <= 20""")
def top_of_key(t):
    return H.top_per_key(t.orders, ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"], 20, rank="rn").select(
        "o_custkey", "o_orderkey", F.col("rn").cast("long").alias("rn"))


@query("SRT-04", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') ORDER BY p_partkey, p_name LIMIT 20")
def limit_with_order(t):
    found = t.part.where(S.contains_ci("p_name", "ring")).select("p_partkey", "p_name")
    return H.top(found, ["p_partkey", "p_name"], 20)
