"""Set operations, reshaping, quality rules, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import history as H
from ..operators import quality as Q
from ..operators import reshape as R
from ..plans.rules import HAZARD_RULES, HAZARD_WATCHED
from .registry import ARGUED_SQL, INPUTS, NOW, TABLES, WHITE, query


@query("SET-01", """
    SELECT c_nationkey AS nation, c_acctbal AS balance, 'customer' AS kind FROM customer
    UNION ALL SELECT s_nationkey, s_acctbal, 'supplier' FROM supplier""")
def tagged(t):
    c = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    s = t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return R.union_tagged({"customer": c, "supplier": s}, "kind")


@query("SET-02", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in TABLES))
def counts(t):
    return Q.table_counts({n: getattr(t, n) for n in TABLES})


@query("SET-03", "SELECT DISTINCT location_name, latitude, longitude FROM weather", ("weather",))
def seeds(t):
    return R.distinct_seeds(t.weather, ["location_name", "latitude", "longitude"])


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("SET-04", """
    UNPIVOT (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, nullif(l_discount, 0) AS l_discount, l_tax FROM lineitem)
    ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME measure VALUE amount""")
def unpivoted(t):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    df = t.lineitem.select(*keys, *MEASURES).withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))
    return R.unpivot_drop_nulls(df, keys, MEASURES, "measure", "amount")


@query("SET-05", """
    SELECT o_custkey, 'M1' AS model, 'rcp45' AS rcp, '2020-2039' AS period, max(o_totalprice) AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY 1
    UNION ALL SELECT o_custkey, 'M2', 'rcp85', '2080-2099', max(o_totalprice) FROM orders WHERE o_orderstatus = 'O' GROUP BY 1""")
def melted(t):
    wide = t.orders.groupBy("o_custkey").agg(
        F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("M1_rcp45_2020-2039"),
        F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))).alias("M2_rcp85_2080-2099"),
        F.count("*").alias("unrelated"))
    return R.melt_named(wide, ["o_custkey"], r"^(.+?)_(rcp\d{2})_(\d{4}-\d{4})$", ["model", "rcp", "period"])


@query("SET-06", """
    WITH called AS (SELECT conv_id, list(DISTINCT role) AS a FROM conversations GROUP BY 1)
    SELECT conv_id, len(list_intersect(a, ['assistant', 'user'])) AS matched, len(list_intersect(a, ['system'])) AS forbidden,
           2 - len(list_intersect(a, ['assistant', 'user'])) AS missed FROM called""")
def overlap(t):
    roles = F.array(F.lit("assistant"), F.lit("user"))
    # collect_set holds at most the three role names.
    called = t.conversations.groupBy("conv_id").agg(F.collect_set("role").alias("a"))
    s = called.select("conv_id", "a", R.set_overlap("a", roles, F.array(F.lit("system"))).alias("s"))
    return s.select("conv_id", F.size(F.array_intersect("a", roles)).cast("long").alias("matched"),
                    F.size("s.forbidden_called").cast("long").alias("forbidden"), F.size("s.missed").cast("long").alias("missed"))


# -- quality -----------------------------------------------------------------


@query("DQ-01", """
    SELECT count(*) AS n_rows, count(*) FILTER (NOT coalesce(longitude IS NOT NULL AND latitude IS NOT NULL, false)) AS has_geometry
    FROM hazards_raw""", ("hazards_raw",))
def watched(t):
    rep = Q.rule_report(t.hazards_raw, HAZARD_WATCHED)
    return rep.select((F.col("passed") + F.col("failed")).alias("n_rows"), F.col("failed").alias("has_geometry"))


@query("DQ-02", """
    SELECT hazard_id, hazard_type FROM hazards_raw WHERE hazard_type IN ('flood', 'fire', 'roadwork', 'incident')
      AND (longitude IS NULL OR longitude BETWEEN 140 AND 154) AND (latitude IS NULL OR latitude BETWEEN -37.5 AND -28)""", ("hazards_raw",))
def kept(t):
    return Q.keep_valid(t.hazards_raw, HAZARD_RULES).select("hazard_id", "hazard_type")


@query("DQ-02-null-fails", """
    SELECT rule, passed, failed FROM (
      SELECT 'temp' AS rule, count(*) FILTER (temperature_c BETWEEN -50 AND 60) AS passed,
             count(*) FILTER (coalesce(temperature_c NOT BETWEEN -50 AND 60, true)) AS failed FROM weather
      UNION ALL SELECT 'rain', count(*) FILTER (precipitation_mm >= 1 OR precipitation_mm IS NULL),
             count(*) FILTER (precipitation_mm < 1) FROM weather)""", ("weather",))
def report(t):
    return Q.rule_report(t.weather, {"temp": "temperature_c BETWEEN -50 AND 60", "rain": "precipitation_mm >= 1 OR precipitation_mm IS NULL"})


@query("DQ-03", "SELECT o_orderkey, o_totalprice FROM orders")
def stopped_unless_clean(t):
    return Q.expect_or_fail(t.orders, {"priced": "o_totalprice > 0", "keyed": "o_orderkey IS NOT NULL"}).select("o_orderkey", "o_totalprice")


@query("DQ-04", "SELECT 'orders' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer")
def tables_there(t):
    for n in ("orders", "customer"):
        getattr(t, n).createOrReplaceTempView(f"dq_{n}")
    out = Q.require_tables(t.spark, ["dq_orders", "dq_customer"])
    return out.withColumn("table_name", F.substring("table_name", 4, 100))


@query("DQ-05", """
    SELECT 'orders' AS table_name, 'o_comment' AS column_name, count(*) AS n_rows FROM orders""")
def columns_there(t):
    gaps = Q.missing_columns({"orders": t.orders, "customer": t.customer},
                             {"orders": ["o_orderkey", "o_comment"], "customer": ["c_custkey"]})
    parts = [getattr(t, n).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), F.lit(c).alias("column_name"), "n_rows")
             for n, cols in gaps.items() for c in cols]
    return H.union_all(parts)


@query("DQ-06", """
    SELECT 'known_hazard_type' AS rule, count(*) FILTER (hazard_type = 'quake') AS failed, count(*) AS n_rows FROM hazards_raw
    UNION ALL SELECT 'has_geometry', count(*) FILTER (longitude IS NULL), count(*) FROM hazards_raw""", ("hazards_raw",))
def audited(t):
    rules = {"known_hazard_type": HAZARD_RULES["known_hazard_type"], **HAZARD_WATCHED}
    rep = Q.rule_report(t.hazards_raw, rules)
    log = rep.select(F.lit("run").alias("run_id"), F.lit("hazards").alias("dataset"), F.lit("expectation_result").alias("event_type"),
                     "rule", F.lit("drop").alias("action"), "failed", (F.col("passed") + F.col("failed")).alias("n_rows"),
                     F.lit(NOW).cast("timestamp").alias("at"))
    return Q.audit_events(log, "expectation_result").select("rule", "failed", "n_rows")


@query("DQ-07", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def probed(t):
    return Q.probe_values(t.lineitem, "l_returnflag", "l_linestatus")


# -- scalar functions --------------------------------------------------------


@query("FN-01", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS parsed FROM orders")
def iso(t):
    return t.orders.select("o_orderkey", S.iso_timestamp(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")).alias("parsed"))


@query("FN-01-zone", """
    SELECT o_orderkey, strftime(timezone('UTC', timezone('Australia/Brisbane', o_orderdate)), '%Y-%m-%d %H:%M:%S') AS parsed FROM orders""")
def iso_zone(t):
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")
    return t.orders.select("o_orderkey", S.iso_timestamp(text, "Australia/Brisbane").alias("parsed"))


@query("FN-02", "SELECT hazard_id, strftime(make_timestamp(created_ms * 1000), '%Y-%m-%d %H:%M:%S') AS created_ts FROM hazards_raw", ("hazards_raw",))
def millis(t):
    return t.hazards_raw.select("hazard_id", S.epoch_ms("created_ms").alias("created_ts"))


@query("FN-03", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def day(t):
    return t.events.select("event_id", F.to_date("ts").alias("day"))


@query("FN-04", "SELECT event_id, ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 7 DAY AS recent FROM events")
def interval(t):
    at = F.lit(NOW).cast("timestamp_ntz")
    return t.events.select("event_id", (F.col("ts") >= at - F.expr("INTERVAL 7 DAYS")).alias("recent"))


@query("FN-05", """
    SELECT event_id, CAST(abs(epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-20 12:00:00')) AS BIGINT) AS seconds FROM events""")
def distance_in_time(t):
    from ..functions.common import moment, seconds
    return t.events.select("event_id", F.abs(seconds("ts") - seconds(moment(t.events, "ts", NOW))).alias("seconds"))


@query("FN-06", "SELECT event_id, CAST(trunc(epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(ts)) AS BIGINT) // 60000000 AS minutes_old FROM events")
def staleness(t):
    return t.events.select("event_id", S.minutes_between("ts", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).alias("minutes_old"))


@query("FN-07", "SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 4, 0) AS even, round(l_quantity / 4, 0) AS up FROM lineitem")
def rounding(t):
    q = F.col("l_quantity") / 4
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", S.half_even(q, 0).alias("even"), F.round(q, 0).alias("up"))


@query("FN-08", """
    SELECT c_custkey, round(sin(radians(c_acctbal)), 9) AS s, round(asin(sqrt(abs(cos(c_acctbal)))), 9) AS a, round(acos(-1), 9) AS p FROM customer""")
def trig(t):
    b = F.col("c_acctbal")
    return t.customer.select("c_custkey", F.round(F.sin(F.radians(b)), 9).alias("s"), F.round(F.asin(F.sqrt(F.abs(F.cos(b)))), 9).alias("a"),
                             F.round(F.acos(F.lit(-1.0)), 9).alias("p"))


@query("FN-09", """
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount > 0 THEN round(l_tax / l_discount * 100, 2) END AS pct,
           CASE WHEN l_quantity > 0 THEN CAST(trunc(l_extendedprice * 1000 / l_quantity) AS INTEGER) END AS per_head FROM lineitem""")
def ratios(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", S.ratio_pct("l_tax", "l_discount").alias("pct"),
                             S.per_head("l_extendedprice", "l_quantity").alias("per_head"))


@query("FN-10", """
    SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'Critical' WHEN o_totalprice > 250000 THEN 'High'
      WHEN o_totalprice > 100000 THEN 'Moderate' ELSE 'Low' END AS level FROM orders""")
def ladder(t):
    p = F.col("o_totalprice")
    return t.orders.select("o_orderkey", F.when(p > 400000, "Critical").when(p > 250000, "High").when(p > 100000, "Moderate")
                           .otherwise("Low").alias("level"))


@query("FN-11", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def dates(t):
    text = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select("o_orderkey", S.strict_date(text).alias("day"))


@query("FN-12", """
    SELECT c_custkey, length(trim(c_mktsegment)) AS n, lower(c_mktsegment) AS low, replace(c_name, '#', '-') AS name,
           substr(c_name, 1, 5) AS head FROM customer""")
def texts(t):
    return t.customer.select("c_custkey", F.length(F.trim("c_mktsegment")).cast("long").alias("n"), F.lower("c_mktsegment").alias("low"),
                             F.replace("c_name", F.lit("#"), F.lit("-")).alias("name"), F.substring("c_name", 1, 5).alias("head"))


@query("FN-13", "SELECT page_id, regexp_extract(url, '/([^/]+)$', 1) AS file FROM pages")
def file_part(t):
    return t.pages.select("page_id", S.file_name("url").alias("file"))


ABN = ("concat(substring(CAST(10000000000 + c_custkey AS STRING), 1, 2), CASE WHEN c_custkey % 3 = 0 THEN '-' ELSE ' ' END, "
       "substring(CAST(10000000000 + c_custkey AS STRING), 3, 9 - CAST(c_custkey % 5 = 0 AS INT)))")


@query("FN-14", f"""
    SELECT c_custkey, regexp_replace({ABN}, '[\\s-]', '', 'g') AS abn,
           regexp_full_match(regexp_replace({ABN}, '[\\s-]', '', 'g'), '\\d{{11}}') AS valid FROM customer""")
def numbers(t):
    text = F.expr(ABN)
    return t.customer.select("c_custkey", S.clean_abn(text).alias("abn"), S.valid_abn(text).alias("valid"))


@query("FN-15", """
    SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE CAST(10000000000 + c_custkey AS VARCHAR) END AS valid,
           CASE WHEN c_custkey % 5 = 0 THEN concat(c_custkey, 'x,abc') ELSE 'abc' END AS invalid FROM customer""")
def lists(t):
    first = F.expr("CASE WHEN c_custkey % 5 = 0 THEN concat(c_custkey, '- x') ELSE concat('10 ', substring(10000000000 + c_custkey, 3, 9)) END")
    s = S.split_ids(F.concat(first, F.lit(", ,abc")))
    return t.customer.select("c_custkey", F.array_join(s["valid"], ",").alias("valid"), F.array_join(s["invalid"], ",").alias("invalid"))


AMOUNT_TEXT = ("CASE WHEN o_orderkey % 4 = 0 THEN concat('The damage estimate was $', CAST(o_orderkey AS STRING), ',500 in total') "
               "WHEN o_orderkey % 4 = 1 THEN concat('Rent $900 then $', CAST(1000 + o_orderkey AS STRING), '.50 due') "
               "WHEN o_orderkey % 4 = 2 THEN 'Loss of $12 only' ELSE 'no figure' END")


@query("FN-16", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey * 1000 + 500 >= 1000 THEN o_orderkey * 1000.0 + 500
      WHEN o_orderkey % 4 = 1 THEN 1000 + o_orderkey + 0.5 ELSE 0 END::DOUBLE AS amount FROM orders""")
def amounts(t):
    return t.orders.select("o_orderkey", S.first_amount([F.expr(AMOUNT_TEXT), F.lit("")]).alias("amount"))


@query("FN-17", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderdate >= TIMESTAMP '2000-01-01' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '2024-03-01' END AS day,
           CASE WHEN o_orderkey % 3 = 0 THEN 'B' ELSE 'D' END AS category, CASE WHEN o_orderkey % 3 = 0 THEN 'storm' ELSE 'fire' END AS word
    FROM orders""")
def findings(t):
    """Only dates from 2000 on count as dates of an event."""
    rows = t.orders
    mine = F.concat(F.lit("It was "), F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("long ago"),
                    F.when(F.col("o_orderkey") % 3 == 0, ", Category b, a STORM").otherwise(""))
    agent = F.lit("On 2024-03-01 category D: bush FIRE or cyclone")
    blob = F.when(F.col("o_orderkey") % 3 == 0, mine).otherwise(F.concat(mine, agent))
    return rows.select("o_orderkey", S.first_date([mine, agent]).alias("day"), S.first_category([mine, agent]).alias("category"),
                       S.disaster_word(blob).alias("word"))


@query("FN-18", "SELECT c_custkey, concat('Ref [ref redacted] for ', c_name) AS note FROM customer")
def redacted(t):
    return t.customer.select("c_custkey", S.redact_uuid(F.concat(F.lit("Ref "), S.stable_id("c_custkey"), F.lit(" for "), F.col("c_name"))).alias("note"))


# Texts with a paragraph that argues, a short claim, or none.
INPUTS["argued"] = """
    SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN concat(text, chr(10), replace(substring(text, 1, 700), chr(10), ' '), ' they qualify for it ', replace(substring(text, 50, 900), chr(10), ' '))
      WHEN doc_id % 4 = 1 THEN concat('a claim ', text) WHEN doc_id % 4 = 2 THEN concat('id 123e4567-e89b-12d3-a456-426614174000 ', text) ELSE text END AS text FROM documents"""


@query("FN-19", rf"""
    WITH d AS (SELECT doc_id, regexp_replace(text, '^{WHITE}|{WHITE}$', '', 'g') AS t FROM argued)
    SELECT doc_id, md5({ARGUED_SQL.replace("{t}", "t")}) AS digest FROM d""", ("argued",))
def paragraphs(t):
    return t.argued.select("doc_id", F.md5(S.justification("text").cast("binary")).alias("digest"))


@query("FN-20", """
    SELECT hazard_id, concat(json_extract_string(roads_json, '$[0].mainStreet'), ', ', json_extract_string(roads_json, '$[0].suburb'),
      CASE WHEN json_extract_string(roads_json, '$[0].crossStreet') <> ''
           THEN concat(' (near ', json_extract_string(roads_json, '$[0].crossStreet'), ')') ELSE '' END) AS road FROM hazards_raw""", ("hazards_raw",))
def roads(t):
    return t.hazards_raw.select("hazard_id", S.road_label("roads_json").alias("road"))


@query("FN-20-path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_path(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("FN-21", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def variant_path(t):
    return t.events.select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "int").alias("k"))


@query("FN-22", """
    SELECT c_custkey, c_name AS name, len(parts) AS n, coalesce(parts[1], 'none') AS first FROM (SELECT *, CASE c_custkey % 3
      WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN CAST([] AS VARCHAR[]) ELSE list_filter(string_split(c_name, '0'), lambda p: p <> '') END AS parts FROM customer)""")
def named_structs(t):
    """A struct with a list that is missing, empty or filled, by row; a missing one counts as a typed empty one."""
    empty = F.array().cast("array<string>")
    parts = F.when(F.col("c_custkey") % 3 == 1, empty).when(F.col("c_custkey") % 3 == 2, F.filter(F.split("c_name", "0"), lambda p: p != ""))
    s = F.named_struct(F.lit("name"), F.col("c_name"), F.lit("parts"), F.coalesce(parts, empty))
    return t.customer.select("c_custkey", s.alias("s")).select(
        "c_custkey", "s.name", F.size("s.parts").cast("long").alias("n"), F.coalesce(F.get("s.parts", F.lit(0)), F.lit("none")).alias("first"))


@query("FN-23", """
    SELECT c_custkey, concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) AS id
    FROM (SELECT c_custkey, md5(concat(c_custkey, chr(1), c_name)) AS h FROM customer)""")
def ids(t):
    return t.customer.select("c_custkey", S.stable_id("c_custkey", "c_name").alias("id"))


@query("FN-24", """
    SELECT hazard_id, hazard_type || ': ' || coalesce(display_name, headline) || ' (' ||
      CASE WHEN is_major THEN 'major' WHEN impacting_network THEN 'network' ELSE 'active' END || ')' AS label FROM hazards_raw""", ("hazards_raw",))
def labels(t):
    return t.hazards_raw.select("hazard_id", S.hazard_label("hazard_type", "display_name", "headline", "is_major", "impacting_network").alias("label"))


@query("FN-26", "SELECT p_partkey, p_type AS tail FROM part")
def tails(t):
    return t.part.select("p_partkey", S.name_tail(F.concat(F.lit("a.b__c__"), F.col("p_type"))).alias("tail"))


@query("SNK-16", """
    SELECT c_custkey, '{"name":"' || c_name || '","note":null}' AS j FROM customer""")
def json_text(t):
    return t.customer.select("c_custkey", S.as_json(F.struct(F.col("c_name").alias("name"), F.lit(None).cast("string").alias("note"))).alias("j"))


@query("SRC-06", "SELECT event_id, CASE WHEN event_type = 'click' THEN CAST(user_id AS DOUBLE) END AS n FROM events")
def tolerant(t):
    text = F.when(F.col("event_type") == "click", F.col("user_id").cast("string")).otherwise(F.col("event_type"))
    return R.tolerant_cast(t.events.select("event_id", text.alias("n")), {"n": "double"})


@query("SRC-10", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def picked(t):
    c = R.pick_column(t.orders, "status", "O_ORDERSTATUS")
    return t.orders.groupBy(F.col(c).alias("status")).agg(F.count("*").alias("n"))


@query("SRC-11", "SELECT r_regionkey AS region_key, r_name AS region_name FROM region")
def normalised(t):
    return R.normalise_names(t.region.toDF("Region Key", "REGION-NAME"))


@query("SRC-14", """
    SELECT c_custkey, c_name AS name FROM customer""")
def jsonp(t):
    body = F.concat(F.lit("callback({\"n\":{\"name\":\""), F.col("c_name"), F.lit("\"}})"))
    return t.customer.select("c_custkey", S.jsonp_to_struct(body, "struct<n:struct<name:string>>").alias("j")).select(
        "c_custkey", F.col("j.n.name").alias("name"))


@query("SRC-16", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def catalog_read(t):
    t.nation.createOrReplaceTempView("placewatch_nation")
    return (t.customer.join(t.spark.table("placewatch_nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy("n_name").agg(F.count("*").alias("n")))


@query("SRC-17", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 5 AND o_totalprice > 1000")
def bound(t):
    from ..sources.files import point_read
    t.orders.createOrReplaceTempView("placewatch_orders")
    return point_read(t.spark, "SELECT o_orderkey, o_totalprice FROM placewatch_orders WHERE o_custkey = :k AND o_totalprice > :p",
                      {"k": 5, "p": 1000.0})


@query("SRC-18", """
    SELECT v.name, count(*) AS n FROM (VALUES ('low', 0, 100000), ('mid', 100000, 300000), ('high', 300000, 600000)) v(name, a, b)
    JOIN orders ON o_totalprice >= a AND o_totalprice < b GROUP BY 1""")
def seeded(t):
    from ..sources.files import seed_table
    # A seed list with the bucket each amount falls into.
    seeds = seed_table(t.spark, [("low", 0), ("mid", 1), ("mid", 2), ("high", 3), ("high", 4), ("high", 5)], "name string, bucket long")
    bucket = F.floor(F.col("o_totalprice") / 100000)
    return t.orders.join(seeds, bucket == F.col("bucket")).groupBy("name").agg(F.count("*").alias("n"))
