"""Reference files: CSV, code lists, polygons, business XML, page text, parsed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import tasks
from ..operators.reshape import first_present, path_column


def read_csv_files(spark: SparkSession, paths: str | list[str], strings: bool = False,
                   schema: str | None = None) -> DataFrame:
    """CSV with a header, tagged with file name and read time.

    ``strings`` keeps every column as text, so codes such as 01 keep their zeros.
    """
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", not strings)
    return reader.csv(paths).select("*", F.col("_metadata.file_name").alias("_source_file"),
                                    F.current_timestamp().alias("_ingest_time"))


def read_polygons(spark: SparkSession, path: str, code: str, name: str, area: str, wkt: str) -> DataFrame:
    """Polygon table out of a text table with a WKT column; audit columns added."""
    raw = read_csv_files(spark, path, strings=True)
    return raw.select(F.col(code).alias("poa_code"), F.col(name).alias("poa_name"),
                      F.col(area).try_cast("double").alias("area_sqkm"),
                      F.nullif(F.col(wkt), F.lit("")).alias("geometry_wkt"), "_source_file", "_ingest_time")


def _marked(text: Column) -> Column:
    """JSON text whose strings that begin like a list or an object get a leading NUL, so raw nested text stands out."""
    return F.regexp_replace(F.ltrim(text), r'(?<!\\)"((?:\\u0000)*\s*[\[{])', r'"\\u0000$1')


def _unmarked(value: Column) -> Column:
    return F.regexp_replace(value, r"^\x00(\x00*\s*[\[{])", "$1")


def _first_codes(text: Column) -> Column:
    """Raw text of the first ``codes`` list of valid JSON text, at any depth; NULL when there is none.

    The text is walked level by level. A place is its list of child numbers, and
    lists compare in document order, an object before what it holds, so the
    smallest place wins and what lies behind a hit is not walked further.
    """
    container = r"^[\[{]"
    state = "struct<open: array<struct<at: array<int>, body: string>>, hit: array<struct<at: array<int>, codes: string>>>"

    def hits(state: Column) -> Column:
        here = F.transform(state["open"], lambda o: F.struct(o["at"].alias("at"), F.when(
            o["body"].startswith("{"), F.from_json(o["body"], "codes string")["codes"]).alias("codes")))
        return F.slice(F.array_sort(F.concat(state["hit"], F.filter(here, lambda h: h["codes"].startswith("[")))), 1, 1)

    def inside(o: Column) -> Column:
        parts = F.when(o["body"].startswith("{"), F.map_values(F.from_json(o["body"], "map<string, string>"))).otherwise(
            F.from_json(o["body"], "array<string>"))
        placed = F.transform(parts, lambda c, i: F.struct(F.concat(o["at"], F.array(i)).alias("at"), c.alias("body")))
        return F.filter(placed, lambda c: c["body"].rlike(container))

    def level(state: Column, _) -> Column:
        def deeper(hit: Column) -> Column:
            still = F.filter(state["open"], lambda o: F.coalesce(o["at"] < F.get(hit, F.lit(0))["at"], F.lit(True)))
            return F.struct(F.flatten(F.transform(still, inside)).alias("open"), hit.alias("hit"))

        return F.transform(F.array(hits(state)), deeper)[0]

    start = F.struct(F.array(F.struct(F.array().cast("array<int>").alias("at"), text.alias("body"))).alias("open"),
                     F.array().cast("array<struct<at: array<int>, codes: string>>").alias("hit")).cast(state)
    # No text is nested deeper than it has opening brackets; rounds after the last level have nothing to do.
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(F.regexp_replace(text, r"[^\[{]", ""))))
    return F.get(F.aggregate(rounds, start, level)["hit"], F.lit(0))["codes"]


def code_list(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, code, name) out of JSON text that holds a ``codes`` list at any depth; the first one in document order counts.

    A name may be text or an object of languages: English first, else the
    first one given. A code without an id is no code. A NULL text, one that is
    no JSON and one without such a list give no row; ``code_list_states`` counts them.
    """
    def entry(c: Column) -> Column:
        kind = F.schema_of_variant(F.from_json(c, "name variant")["name"])
        fields = F.from_json(c, "id string, name string")
        languages = F.from_json(fields["name"], "map<string, string>")
        english = F.nullif(F.from_json(fields["name"], "en string")["en"], F.lit(""))
        name = F.when(kind == "STRING", fields["name"]).when(
            kind.startswith("OBJECT"), F.coalesce(english, F.get(F.map_values(languages), F.lit(0))))
        return F.struct(_unmarked(fields["id"]).alias("code"), _unmarked(name).alias("name"))

    # A text is small and the work on it is not: the few tasks that read the texts deal them out first.
    texts = df.select(key, col).repartition(tasks(df.sparkSession))
    lists = (texts.select(key, F.when(F.try_parse_json(col).isNotNull(), _marked(F.col(col))).alias("_text"))
             .select(key, F.from_json(_first_codes(F.col("_text")), "array<string>").alias("_codes")))
    entries = F.transform(F.filter("_codes", lambda c: c.startswith("{")), entry)
    return lists.select(key, F.inline(F.filter(entries, lambda e: e["code"].isNotNull())))


def code_list_states(df: DataFrame, col: str) -> DataFrame:
    """Texts per state: ``listed``, ``no list``, ``malformed`` (no JSON) or ``missing`` (NULL)."""
    state = (F.when(F.col(col).isNull(), "missing").when(F.try_parse_json(col).isNull(), "malformed")
             .when(_first_codes(_marked(F.col(col))).isNull(), "no list").otherwise("listed"))
    texts = df.select(col).repartition(tasks(df.sparkSession))
    return texts.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def read_business_xml(spark: SparkSession, path: str, row_tag: str = "businessEntity202001",
                      schema: str | T.StructType | None = None) -> DataFrame:
    """Records of XML files; give ``schema`` to spare the inference pass over large folders."""
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def _text(schema: T.StructType, path: str) -> Column:
    col = path_column(schema, path)
    return (F.lit(None) if col is None else col).cast("string")


def business_rows(raw: DataFrame, ingested_at) -> DataFrame:
    """Register records to one row per business; the name falls back over four places."""
    s = raw.schema
    legal = F.nullif(F.concat_ws(" ", _text(s, "legalName.givenName"), _text(s, "legalName.familyName")), F.lit(""))
    name = F.coalesce(first_present(raw, "mainName.organisationName", "businessName.organisationName",
                                    "mainTradingName.organisationName").cast("string"), legal)
    at = F.lit(ingested_at).cast("timestamp") if isinstance(ingested_at, str) else F.lit(ingested_at)
    return raw.select(
        _text(s, "ABN.identifierValue").try_cast("long").alias("abn"),
        _text(s, "entityStatus.entityStatusCode").alias("status"),
        _text(s, "entityType.entityDescription").alias("entity_type"),
        _text(s, "mainBusinessPhysicalAddress.stateCode").alias("state"),
        _text(s, "mainBusinessPhysicalAddress.postcode").try_cast("long").alias("postcode"),
        name.alias("organisation_name"), at.alias("ingested_at"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Text documents by page, a form feed ending each: (path, page, text), pages numbered from 1 in each file.

    Files are read in byte ranges of ``spark.sql.files.maxPartitionBytes``, a page
    by the task in whose range it begins, so a document of any size is shared by
    many tasks; a compressed file is read by one. Text behind the last form feed
    is a page where there is any. The pages of every range are counted by a
    first pass, and one number per range tells where it starts.
    """
    raw = (spark.read.option("lineSep", "\f").option("recursiveFileLookup", True).text(path)
           .select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"),
                   F.monotonically_increasing_id().alias("_at")))
    ranges = raw.groupBy("path", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.select("path", "_start", "_first", F.coalesce(earlier, F.lit(0)).alias("_before"))
    page = F.col("_before") + F.col("_at") - F.col("_first") + 1
    return raw.join(starts, ["path", "_start"]).select("path", page.cast("int").alias("page"), F.col("value").alias("text"))


def page_documents(pages: DataFrame, files: DataFrame | None = None, text: str = "text") -> DataFrame:
    """(path, n_pages, n_chars, error_status) per document; ``files`` (path) names those that must be there.

    A document without a page is ``empty``, one whose pages are all blank
    ``no text``, one with bytes that are no UTF-8 ``broken text``; else NULL.
    """
    value = F.col(text)
    found = pages.groupBy("path").agg(F.count("*").alias("n_pages"), F.sum(F.length(value)).cast("long").alias("n_chars"),
                                      F.max(F.trim(F.regexp_replace(value, r"\s", "")) != "").alias("_any"),
                                      F.max(~F.is_valid_utf8(value)).alias("_broken"))
    out = files.select("path").distinct().join(found, "path", "left") if files is not None else found
    status = F.when(F.col("n_pages").isNull(), "empty").when(F.col("_broken"), "broken text").when(~F.col("_any"), "no text")
    return out.select("path", F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"),
                      status.alias("error_status"))


def point_read(spark: SparkSession, sql: str, args: dict) -> DataFrame:
    """Parameterised read; values are bound, never pasted into the text."""
    return spark.sql(sql, args=args)


def seed_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
