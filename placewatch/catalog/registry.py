"""Registry of queries and the shapes the driver's tables take for them.

The reference's own data is not available, so each of its tables is derived
from a driver table by integer formulas. The derivations are plain SQL that
Spark and the checking engine both read; everything after them is built by the
operators on one side and by SQL on the other.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PER_DEGREE = 4
WIDTH = 360 * PER_DEGREE
NOW = "2024-01-20 12:00:00"

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()

CELL = "(CAST(floor(({lat} + 90e0) * 4) AS BIGINT) * 1440 + CAST(floor(({lon} + 180e0) * 4) AS BIGINT))"
CUSTOMER_LAT, CUSTOMER_LON = "(-37e0 + (({k} * 131) % 900) / 1e2)", "(141e0 + (({k} * 197) % 1300) / 1e2)"
STATION_LAT, STATION_LON = "(-37e0 + (({k} * 37) % 900) / 1e2)", "(141e0 + (({k} * 53) % 1300) / 1e2)"

# TS_OF(microseconds) is the timestamp of an epoch microsecond in either engine.
INPUTS = {
    "weather": f"""
        SELECT concat('Station ', CAST(l_suppkey AS STRING)) AS location_name,
               {STATION_LAT.format(k='l_suppkey')} AS latitude, {STATION_LON.format(k='l_suppkey')} AS longitude,
               TS_OF(1000000 * (CAST(1705536000 AS BIGINT) + 3600 * (l_orderkey % 168) + 60 * l_linenumber)) AS forecast_time,
               l_discount * 1e2 AS precipitation_mm, l_quantity AS windspeed_kmh,
               CASE WHEN l_quantity > 45 THEN NULL ELSE l_extendedprice / 2e3 END AS temperature_c,
               l_tax * 1e3 AS humidity_pct, l_linenumber AS weather_code,
               TS_OF(1000000 * (CAST(1705287600 AS BIGINT) + 86400 * (l_partkey % 5))) AS _ingest_time
        FROM lineitem""",
    "hazards_raw": f"""
        SELECT CAST(o_orderkey AS STRING) AS hazard_id,
               CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'flood' WHEN '2' THEN 'fire'
                    WHEN '3' THEN 'roadwork' WHEN '4' THEN 'incident' ELSE 'quake' END AS hazard_type,
               o_orderpriority AS main_category,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('Place ', CAST(o_orderkey % 50 AS STRING)) END AS display_name,
               concat('Headline ', CAST(o_orderkey % 20 AS STRING)) AS headline,
               o_totalprice / 1e4 AS expected_delay_min, o_totalprice > 450000e0 AS is_major,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 3 = 0 END AS impacting_network,
               CASE WHEN o_orderstatus = 'F' THEN true WHEN o_orderstatus = 'O' THEN false
                    WHEN o_orderkey % 2 = 0 THEN NULL ELSE false END AS ended,
               concat('Advice ', o_orderstatus) AS advice_a,
               1700000000000 + o_orderkey * 1000 AS created_ms,
               CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 1700000000000 + o_orderkey * 1777 END AS last_updated_ms,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE {CUSTOMER_LON.format(k='o_custkey')} END AS longitude,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE {CUSTOMER_LAT.format(k='o_custkey')} END AS latitude,
               concat('[{{"mainStreet":"Main ', CAST(o_custkey % 30 AS STRING), '","suburb":"Sub ',
                      CAST(o_custkey % 9 AS STRING), '","crossStreet":"',
                      CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('Cross ', CAST(o_orderkey % 6 AS STRING)) END,
                      '"}}]') AS roads_json,
               TS_OF(1000000 * (CAST(1705287600 AS BIGINT) + 86400 * (o_orderkey % 5))) AS _ingest_time
        FROM orders""",
    "weather_map": """
        SELECT lpad(CAST(c_custkey AS STRING), 8, '0') AS poa_code,
               CASE WHEN c_custkey % 97 = 0 THEN 'Station none' ELSE
                    concat('Station ', CAST(c_custkey % (SELECT count(*) FROM supplier) AS STRING)) END AS nearest_weather_location
        FROM customer""",
    "climate_map": """
        SELECT lpad(CAST(c_custkey AS STRING), 8, '0') AS poa_code,
               concat('SITE-', CAST((c_custkey * 7) % (SELECT count(*) FROM supplier) AS STRING)) AS nearest_csiro_station
        FROM customer WHERE c_custkey % 89 <> 0""",
    "projections": """
        SELECT concat('SITE-', CAST(l_suppkey AS STRING)) AS station_name, concat('M', CAST(l_linenumber AS STRING)) AS model,
               CASE l_returnflag WHEN 'A' THEN 'rcp26' WHEN 'N' THEN 'rcp45' ELSE 'rcp85' END AS rcp,
               CASE l_linestatus WHEN 'F' THEN '2020-2039' ELSE '2080-2099' END AS period,
               CASE WHEN l_quantity <= 40 THEN 'tas' ELSE 'tasmax' END AS variable, 'mean' AS aggregation,
               'celsius' AS units, CASE WHEN l_partkey % 3 > 0 THEN 'Annual' ELSE 'DJF' END AS time_aggregation,
               l_extendedprice AS value
        FROM lineitem""",
    "businesses": """
        SELECT 10000000000 + c_custkey AS abn, c_mktsegment AS status,
               CASE WHEN c_acctbal > 5000e0 THEN 'Company' ELSE 'Sole Trader' END AS entity_type, 'NSW' AS state,
               c_custkey AS postcode, c_name AS organisation_name,
               TS_OF(1000000 * (CAST(1705700000 AS BIGINT) + 3600 * (c_custkey % 48))) AS ingested_at
        FROM customer""",
    "supplier_log": """
        SELECT 20000000000 + user_id AS user_abn, 10000000000 + CAST(substring(props, 7, length(props) - 7) AS BIGINT) AS supplier_abn,
               concat('Supplier ', substring(props, 7, length(props) - 7)) AS supplier_name, 'Active' AS supplier_status,
               ts AS added_at, CASE event_type WHEN 'error' THEN 'REMOVE' ELSE 'ADD' END AS action, event_id
        FROM events WHERE event_type IN ('signup', 'error', 'purchase')""",
}

# Tables whose derivation differs by engine: the Spark side uses operators.
SQL_ONLY = {
    "hazards": f"""
        SELECT *, {CELL.format(lat='latitude', lon='longitude')} AS h3_cell FROM hazards_raw
        WHERE hazard_type IN ('flood', 'fire', 'roadwork', 'incident')
          AND (longitude IS NULL OR longitude BETWEEN 140e0 AND 154e0) AND (latitude IS NULL OR latitude BETWEEN -37.5e0 AND -28e0)""",
    "active": """
        SELECT * FROM hazards WHERE _ingest_time = (SELECT max(_ingest_time) FROM hazards)
          AND ended = false AND h3_cell IS NOT NULL""",
    "cover": f"""
        SELECT lpad(CAST(c_custkey AS STRING), 8, '0') AS poa_code,
               {CELL.format(lat=CUSTOMER_LAT.format(k='c_custkey'), lon=CUSTOMER_LON.format(k='c_custkey'))}
               + dy.v * {WIDTH} + dx.v AS h3_cell
        FROM customer, (VALUES (-1), (0), (1)) AS dy(v), (VALUES (-1), (0), (1)) AS dx(v)""",
    "weather_now": """
        SELECT * FROM weather WHERE _ingest_time = (SELECT max(_ingest_time) FROM weather)""",
}
NEEDS = {"hazards": ["hazards_raw"], "active": ["hazards"], "weather_now": ["weather"]}

# White space of any kind, and the argument of a narrative (``{t}``), for the checking engine.
WHITE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
ARGUED_SQL = r"""regexp_replace(CASE WHEN length({t}) <= 800 THEN {t}
    WHEN NOT regexp_matches({t}, '(?i)justif|recommend|claim|apply|seek|qualif|eligib') THEN {t}[1:800] ELSE coalesce(nullif(regexp_replace(
    regexp_extract(list_filter(string_split({t}, chr(10)), lambda l: regexp_matches(l, '(?is)^.{40}.*(?:justif|recommend|claim|apply|seek|qualif|eligib)'))[1],
      '(?is)([^\n]{40,800}(?:justif|recommend|claim|apply|seek|qualif|eligib)[^\n]{0,800})', 1), '^WHITE|WHITE$', '', 'g'), ''), {t}[1:800]) END,
    '\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b', '[ref redacted]', 'g')""".replace("WHITE", WHITE)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables and the derived shapes, as DataFrames by attribute."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.root}/{name}.parquet")
        if name in INPUTS:
            return self.derive(INPUTS[name])
        raise AttributeError(name)

    def derive(self, text: str) -> DataFrame:
        """Run a shared derivation; table names in FROM become the driver's files."""
        text = text.replace("TS_OF(", "timestamp_micros(")
        names = {n: getattr(self, n) for n in TABLES if re.search(rf"\bFROM {n}\b", text)}
        body = text.replace("{", "{{").replace("}", "}}")
        for n in names:
            body = re.sub(rf"\bFROM {n}\b", f"FROM {{{n}}}", body)
        return self.spark.sql(body, **names) if names else self.spark.sql(text)

    @property
    def hazards(self) -> DataFrame:
        from ..functions.geo import cell_id
        from ..operators.quality import keep_valid
        from ..plans.rules import HAZARD_RULES
        from ..functions.scalars import epoch_ms

        raw = keep_valid(self.hazards_raw, HAZARD_RULES)
        return raw.withColumns({"h3_cell": cell_id("longitude", "latitude", PER_DEGREE),
                                "created_ts": epoch_ms("created_ms"), "last_updated_ts": epoch_ms("last_updated_ms")})

    @property
    def cover(self) -> DataFrame:
        from ..functions.geo import cell_id, ring

        at = self.customer.select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("poa_code"),
                                  F.expr(CUSTOMER_LON.format(k="c_custkey")).alias("lon"),
                                  F.expr(CUSTOMER_LAT.format(k="c_custkey")).alias("lat"))
        return at.select("poa_code", F.explode(ring(cell_id("lon", "lat", PER_DEGREE), 1, PER_DEGREE)).alias("h3_cell"))


def shown(df: DataFrame) -> DataFrame:
    """Times and dates as text, so both engines print them alike."""
    forms = {"timestamp": "yyyy-MM-dd HH:mm:ss", "timestamp_ntz": "yyyy-MM-dd HH:mm:ss", "date": "yyyy-MM-dd"}
    return df.select(*[F.date_format(c, forms[t]).alias(c) if t in forms else F.col(c) for c, t in df.dtypes])


def with_inputs(body: str, *names: str) -> str:
    """SQL for the checking engine: the derived tables it needs as CTEs in front of ``body``."""
    wanted: list[str] = []

    def need(n: str) -> None:
        for m in NEEDS.get(n, []):
            need(m)
        if n not in wanted:
            wanted.append(n)

    for n in names:
        need(n)
    body = body.strip()
    parts = [f"{n} AS ({(INPUTS | SQL_ONLY)[n].strip()})" for n in wanted]
    if body[:5].upper() == "WITH ":
        parts.append(body[5:])
        text = "WITH " + ",\n".join(parts)
    else:
        text = ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
    return text.replace("TS_OF(", "make_timestamp(")


def query(key: str, sql: str | None = None, inputs: tuple[str, ...] = ()):
    """Register ``fn(tables) -> DataFrame`` under ``key`` with its SQL counterpart."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if key in QUERIES:
            raise ValueError(f"registered twice: {key}")
        QUERIES[key] = lambda spark, root: shown(fn(Tables(spark, root)))
        if sql is not None:
            ORACLES[key] = with_inputs(sql, *inputs)
        return fn

    return add
