"""Business products: upsert, details, identity, look-ups, suppliers, submissions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..plans import business as B
from ..sources import files as SF
from ..sources import sinks as K
from .registry import NEEDS, NOW, SQL_ONLY, query

SQL_ONLY["current_details"] = """
    SELECT abn, entity_type, b.postcode, m.nearest_weather_location AS location_name, ingested_at FROM businesses b
    LEFT JOIN weather_map m ON m.poa_code = lpad(CAST(b.postcode AS VARCHAR), 8, '0')"""
NEEDS["current_details"] = ["businesses", "weather_map"]


def details_now(t):
    eight = t.weather_map
    from ..operators.joins import join_code
    joined = join_code(t.businesses, eight, "postcode", "poa_code", width=8)
    return joined.select("abn", "entity_type", "postcode", F.col("nearest_weather_location").alias("location_name"), "ingested_at")


@query("SNK-05", """
    WITH s AS (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS st, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS tp FROM orders GROUP BY 1),
    t AS (SELECT c_custkey AS k, c_mktsegment AS st, c_acctbal AS tp FROM customer WHERE c_custkey >= 100)
    SELECT coalesce(k, o_custkey) AS k, CASE WHEN o_custkey IS NULL THEN t.st ELSE s.st END AS status, CASE WHEN o_custkey IS NULL THEN t.tp ELSE s.tp END AS amount
    FROM t FULL JOIN s ON k = o_custkey""")
def merged(t):
    target = t.customer.where("c_custkey >= 100").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("status"), F.col("c_acctbal").alias("amount"))
    source = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"),
                             "o_orderdate", "o_orderkey")
    newest = H.latest_per_key(source, ["k"], ["o_orderdate", "o_orderkey"]).select("k", "status", "amount")
    return H.upsert(target, newest, ["k"])


@query("SNK-06", """
    WITH arrived AS (SELECT abn, entity_type, postcode, 'Place ' || (postcode % 7) AS location_name FROM businesses WHERE postcode % 2 = 0)
    SELECT coalesce(d.abn, a.abn) AS abn, coalesce(a.entity_type, d.entity_type) AS entity_type, coalesce(a.postcode, d.postcode) AS postcode,
           CASE WHEN a.abn IS NULL THEN d.location_name ELSE a.location_name END AS location_name
    FROM current_details d FULL JOIN arrived a ON a.abn = d.abn""", ("current_details",))
def enriched_upsert(t):
    arrived = t.businesses.where("postcode % 2 = 0")
    places = t.customer.select(F.col("c_custkey").cast("string").alias("poa_code"),
                               F.concat(F.lit("Place "), (F.col("c_custkey") % 7).cast("string")).alias("nearest_weather_location"))
    rows = B.details_rows(arrived, places).drop("ingested_at")
    return H.upsert(details_now(t).drop("ingested_at"), rows, ["abn"])


@query("Q-07", """
    SELECT abn, precipitation_mm, windspeed_kmh, CASE WHEN precipitation_mm > 50 THEN 'High' ELSE 'Low' END AS risk_level, count(*) AS n
    FROM businesses b JOIN weather_map m ON m.poa_code = lpad(CAST(b.postcode AS VARCHAR), 8, '0')
    JOIN (SELECT location_name, precipitation_mm * 10 AS precipitation_mm, windspeed_kmh FROM weather_now) w ON w.location_name = m.nearest_weather_location
    GROUP BY ALL""", ("businesses", "weather_map", "weather_now"))
def rain_rows(t):
    codes = t.weather_map
    wet = t.weather.withColumn("precipitation_mm", F.col("precipitation_mm") * 10)
    eight = t.businesses.withColumn("postcode", F.lpad(F.col("postcode").cast("string"), 8, "0"))
    out = B.rain_risk(eight, codes, wet, NOW).drop("calculation_time")
    return out.groupBy(*out.columns).agg(F.count("*").alias("n"))


@query("Q-07-max", """
    SELECT abn, max(precipitation_mm) * 10 AS precipitation_mm, max(windspeed_kmh) AS windspeed_kmh,
           CASE WHEN max(precipitation_mm) * 10 > 50 THEN 'High' ELSE 'Low' END AS risk_level
    FROM businesses b JOIN weather_map m ON m.poa_code = lpad(CAST(b.postcode AS VARCHAR), 8, '0')
    JOIN weather_now w ON w.location_name = m.nearest_weather_location GROUP BY 1""", ("businesses", "weather_map", "weather_now"))
def rain_worst(t):
    wet = t.weather.withColumn("precipitation_mm", F.col("precipitation_mm") * 10)
    eight = t.businesses.withColumn("postcode", F.lpad(F.col("postcode").cast("string"), 8, "0"))
    return B.rain_risk(eight, t.weather_map, wet, NOW, collapse="max").drop("calculation_time")


NAME = "CASE WHEN b.postcode % 3 = 0 THEN b.organisation_name WHEN b.postcode % 3 = 1 THEN b.organisation_name || ' A' ELSE 'Kim ' || b.organisation_name END"


XML_RECORDS = 50_000   # records of a written XML file, about 30 MB


def xml_records(t):
    """The business records written as XML files, names in three places, and read back."""
    three, name = F.col("postcode") % 3, F.col("organisation_name")
    both = F.array(F.struct(F.concat(name, F.lit(" A")).alias("organisationName")), F.struct(F.lit("other").alias("organisationName")))
    rows = t.businesses.select(
        F.struct(F.col("abn").alias("identifierValue")).alias("ABN"), F.struct(F.col("status").alias("entityStatusCode")).alias("entityStatus"),
        F.struct(F.col("entity_type").alias("entityDescription")).alias("entityType"),
        F.when(three == 0, F.struct(name.alias("organisationName"))).alias("mainName"), F.when(three == 1, both).alias("businessName"),
        F.when(three == 2, F.struct(F.lit("Kim").alias("givenName"), name.alias("familyName"))).alias("legalName"),
        F.struct(F.col("state").alias("stateCode"), "postcode").alias("mainBusinessPhysicalAddress"))
    path = K.scratch(t.spark, "business-xml")
    # A reader can't split an XML file: each is written small.
    rows.write.option("maxRecordsPerFile", XML_RECORDS).format("xml").option("rowTag", "businessEntity202001").option("rootTag", "records").save(path)
    return SF.business_rows(SF.read_business_xml(t.spark, path), NOW)


@query("SRC-13", f"SELECT abn, status, entity_type, state, postcode, {NAME} AS organisation_name FROM businesses b", ("businesses",))
def parsed_records(t):
    return xml_records(t).drop("ingested_at")


@query("Q-08", f"""
    SELECT b.abn, b.status, b.postcode, {NAME} AS organisation_name, m.nearest_weather_location AS location_name
    FROM businesses b LEFT JOIN weather_map m ON m.poa_code = lpad(CAST(b.postcode AS VARCHAR), 8, '0')
    UNION ALL SELECT 99, 'OLD', 1, 'kept', NULL""", ("businesses", "weather_map"))
def parse_upsert_details(t):
    lookup = t.spark.createDataFrame([(99, "OLD", "Company", "NSW", 1, "kept", None), (10000000003, "OLD", "Company", "NSW", 1, "replaced", None)],
                                     "abn long, status string, entity_type string, state string, postcode long, organisation_name string, ingested_at timestamp")
    arrived = xml_records(t)
    merged_rows, _ = B.refresh(lookup, arrived, t.weather_map)
    _, new = B.refresh(lookup, arrived.withColumn("postcode", F.lpad(F.col("postcode").cast("string"), 8, "0")), t.weather_map)
    now = B.current_details(new).select("abn", "location_name")
    return merged_rows.select("abn", "status", "postcode", "organisation_name").join(now, "abn", "left")


BODY = """concat(CASE WHEN postcode % 4 = 0 THEN 'callback(' ELSE '' END, '{"Abn":"', CASE WHEN postcode % 11 = 0 THEN '' ELSE CAST(abn AS STRING) END,
      '","AbnStatus":"Active","EntityName":"', organisation_name, '","EntityTypeName":"', entity_type, '","AddressState":"NSW","AddressPostcode":"',
      lpad(CAST(postcode AS STRING), 8, '0'), '","Message":"No record found"}', CASE WHEN postcode % 4 = 0 THEN ')' ELSE '' END)"""


@query("Q-13", """
    SELECT CAST(b.abn AS VARCHAR) AS abn, CASE WHEN b.postcode % 11 = 0 THEN NULL ELSE organisation_name END AS entity_name,
           CASE WHEN b.postcode % 11 = 0 THEN NULL ELSE m.nearest_weather_location END AS nearest_weather_location,
           CASE WHEN b.postcode % 11 = 0 THEN NULL ELSE c.nearest_csiro_station END AS nearest_csiro_station,
           b.postcode % 11 <> 0 AS in_nsw, CASE WHEN b.postcode % 11 = 0 THEN 0 ELSE n END AS n_cells, CASE WHEN b.postcode % 11 = 0 THEN NULL ELSE first_cell END AS first_cell,
           CASE WHEN b.postcode % 11 = 0 THEN 'No record found' END AS error
    FROM businesses b LEFT JOIN weather_map m ON m.poa_code = lpad(CAST(b.postcode AS VARCHAR), 8, '0')
    LEFT JOIN climate_map c ON c.poa_code = lpad(CAST(b.postcode AS VARCHAR), 8, '0')
    LEFT JOIN (SELECT poa_code, count(*) AS n, min(h3_cell) AS first_cell FROM cover GROUP BY 1) v ON v.poa_code = lpad(CAST(b.postcode AS VARCHAR), 8, '0')""",
       ("businesses", "weather_map", "climate_map", "cover"))
def identities(t):
    asked = t.businesses.select(F.col("abn").cast("string").alias("abn"), F.expr(BODY).alias("body"))
    out = B.verify(asked, t.cover, t.weather_map, t.climate_map)
    return out.select("abn", "entity_name", "nearest_weather_location", "nearest_csiro_station", "in_nsw", F.size("h3_cells").cast("long").alias("n_cells"),
                      F.get("h3_cells", F.lit(0)).alias("first_cell"), "error")


@query("Q-19", "SELECT abn, organisation_name, status, entity_type, state, postcode FROM businesses WHERE contains(lower(organisation_name), lower('er#0000001')) "
               "ORDER BY abn LIMIT 20", ("businesses",))
def found_by_name(t):
    return B.search(t.businesses, "er#0000001", by="name")


@query("Q-19-number", "SELECT abn, organisation_name, status, entity_type, state, postcode FROM businesses WHERE abn = 10000000007", ("businesses",))
def found_by_number(t):
    return B.search(t.businesses, "10 000-000 007")


@query("Q-19-details", """
    SELECT d.abn, organisation_name, status, d.entity_type, state, d.postcode, location_name, strftime(d.ingested_at, '%Y-%m-%d %H:%M:%S') AS ingested_at
    FROM current_details d LEFT JOIN businesses b ON b.abn = d.abn""", ("current_details", "businesses"))
def business_details(t):
    return B.details(details_now(t), t.businesses)


@query("Q-19-fresh", """
    SELECT abn, strftime(ingested_at, '%Y-%m-%d %H:%M:%S') AS ingested_at, ingested_at > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 24 HOUR AS is_fresh FROM businesses""", ("businesses",))
def fresh_details(t):
    return B.fresh(t.businesses, NOW)


@query("Q-19-bulk", """
    SELECT kind, count(*) AS n, count(DISTINCT v) AS values FROM (
      SELECT 'found' AS kind, CAST(abn AS VARCHAR) AS v FROM businesses WHERE postcode % 5 <> 0
      UNION ALL SELECT 'missing', CAST(abn AS VARCHAR) FROM businesses WHERE postcode % 5 = 0
      UNION ALL SELECT 'missing', CAST(30000000000 + c_custkey AS VARCHAR) FROM customer
      UNION ALL SELECT 'invalid', CAST(c_custkey AS VARCHAR) || 'x' FROM customer) GROUP BY 1""", ("businesses",))
def bulk_lists(t):
    text = F.concat(F.lit("10 000"), F.substring((F.lit(10000000000) + F.col("c_custkey")).cast("string"), 6, 6), F.lit(", "),
                    (F.lit(30000000000) + F.col("c_custkey")).cast("string"), F.lit(",,"), F.col("c_custkey").cast("string"), F.lit("x"))
    found, missing, invalid = B.lookup_list(t.customer.select(text.alias("ids")), "ids", t.businesses.where("postcode % 5 <> 0"))
    parts = {"found": found.select(F.col("abn").cast("string").alias("v")), "missing": missing.select(F.col("abn").cast("string").alias("v")),
             "invalid": invalid.select(F.col("entry").alias("v"))}
    from ..operators.reshape import union_tagged
    return union_tagged(parts, "kind").groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("v").alias("values"))


@query("Q-20", """
    WITH last AS (SELECT *, row_number() OVER (PARTITION BY user_abn, supplier_abn ORDER BY added_at DESC, CASE WHEN action = 'ADD' THEN 0 ELSE 1 END DESC,
        supplier_name DESC, supplier_status DESC, event_id DESC) AS rn FROM supplier_log)
    SELECT user_abn, supplier_abn, supplier_name, supplier_status, strftime(added_at, '%Y-%m-%d %H:%M:%S') AS added_at, event_id, location_name
    FROM last LEFT JOIN current_details d ON d.abn = supplier_abn WHERE rn = 1 AND action = 'ADD'""", ("supplier_log", "current_details"))
def supplier_list(t):
    return B.suppliers(t.supplier_log, details_now(t))


@query("Q-20-submissions", """
    SELECT abn, id, strftime(generated_at, '%Y-%m-%d %H:%M:%S') AS generated_at FROM (SELECT 20000000000 + user_id AS abn, event_id AS id, ts AS generated_at,
      row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 20""")
def last_submissions(t):
    log = t.events.select((F.col("user_id") + 20000000000).alias("abn"), F.col("event_id").alias("id"), F.col("ts").alias("generated_at"))
    return B.submissions(log)


@query("FN-14-lookup", """
    SELECT abn, postcode FROM businesses WHERE postcode % 2 = 0""", ("businesses",))
def valid_only(t):
    raw = t.businesses.select("abn", "postcode", F.when(F.col("postcode") % 2 == 0, F.concat(F.lit(" "), F.col("abn").cast("string"), F.lit("-")))
                              .otherwise("12 345").alias("typed"))
    return B.known_numbers(raw, "typed").where("is_valid").select(F.col("abn_clean").cast("long").alias("abn"), "postcode")


@query("UDF-02", """
    SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'INVALID' ELSE 'DRAFT' END AS status FROM customer""")
def validated(t):
    from ..plans.claims import draft_status
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "volcano").otherwise("flood")
    status = draft_status(F.col("c_custkey").cast("string"), F.col("c_name"), kind, F.lit("2026-01-31"), F.lit("C"), F.abs("c_acctbal"), F.lit("Water in the shop"))
    return t.customer.select("c_custkey", status.alias("status"))


@query("UDF-03", """
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Invalid ABN format: ''12'' must be 11 digits' WHEN c_custkey % 3 = 1 THEN 'No JSON object in response' END AS error,
           CASE WHEN c_custkey % 3 = 2 THEN c_name END AS entity_name FROM customer""")
def register_answers(t):
    from ..sources.landing import identity
    k = F.col("c_custkey") % 3
    asked = t.customer.select("c_custkey", F.when(k == 0, "12").otherwise("53 004 085 616").alias("abn"),
                              F.when(k == 1, "<html>busy</html>").otherwise(F.concat(F.lit('({"Abn":"53004085616","EntityName":"'), F.col("c_name"), F.lit('"})'))).alias("body"))
    return identity(asked, "abn", "body").select("c_custkey", "error", "entity_name")


