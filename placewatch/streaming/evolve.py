"""Landed JSON files whose fields nobody declares: types are inferred, new fields become columns, what fits no column is rescued.

Records are read as VARIANT, so that no value is lost or changed before its
type is known. The columns are kept as numbered schemas beside the checkpoint.
A micro-batch with a field that the newest schema lacks notes the next one and
stops its query before anything of it is published; started again, the query
meets the same files with the new columns. Older rows read them as NULL.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import let
from ..sources.sinks import note, note_next, noted, notes, table_exists
from .ingest import write_counted

#: Columns beside the inferred ones; a field of such a name is rescued.
OWN = ("_rescued", "_malformed", "_ingest_time", "_source_file")


class SchemaChanged(RuntimeError):
    """New fields were noted; the query has to be started again."""


def column_type(kind: str) -> T.DataType | None:
    """Column type for a VARIANT's schema text: JSON numbers with a point are doubles; objects, arrays and mixed values stay VARIANT."""
    if kind == "VOID":
        return None
    if kind.startswith("DECIMAL") or kind in ("DOUBLE", "FLOAT"):
        return T.DoubleType()
    return {"BIGINT": T.LongType(), "BOOLEAN": T.BooleanType(), "STRING": T.StringType()}.get(kind, T.VariantType())


def fits(value: Column, to: T.DataType) -> Column:
    """True where a VARIANT value is held by the column type without a change; JSON null fits every type."""
    kind = F.schema_of_variant(value)
    if isinstance(to, T.VariantType):
        return F.lit(True)
    if isinstance(to, T.DoubleType):
        # 17 digits tell all doubles apart.
        digits = F.regexp_extract(kind, r"^DECIMAL\((\d+),", 1).try_cast("int")
        whole = F.abs(F.try_variant_get(value, "$", "double")) <= 2.0**53
        good = (kind == "DOUBLE") | (digits <= 17) | ((kind == "BIGINT") & whole)
    else:
        good = kind == {T.LongType: "BIGINT", T.BooleanType: "BOOLEAN", T.StringType: "STRING"}[type(to)]
    return F.coalesce((kind == "VOID") | good, F.lit(False))


def known_schema(spark: SparkSession, checkpoint: str) -> tuple[int, T.StructType]:
    """Number and columns of the newest schema; 0 and none before the first."""
    folder = f"{checkpoint}_schemas"
    numbers = notes(spark, folder)
    if not numbers:
        return 0, T.StructType([])
    return numbers[-1], T.StructType.fromJson(json.loads(noted(spark, f"{folder}/_{numbers[-1]:08d}")))


def read_records(spark: SparkSession, path: str, multi_line: bool = True, max_files: int | None = None) -> DataFrame:
    """A stream of landed JSON values as VARIANT ``_value`` (a whole array, or an object per line), with file time and path."""
    reader = (spark.readStream.schema("_value variant").option("singleVariantColumn", "_value")
              .option("multiLine", multi_line).option("recursiveFileLookup", True))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path).select("_value", F.col("_metadata.file_modification_time").alias("_ingest_time"),
                                    F.col("_metadata.file_path").alias("_source_file"))


def _records(values: DataFrame) -> DataFrame:
    """A row per record: its fields as a map, or the whole value where it is no object."""
    many = F.schema_of_variant("_value").startswith("ARRAY")
    parts = F.when(many, F.try_variant_get("_value", "$", "array<variant>")).otherwise(F.array("_value"))

    def parsed(record: Column, malformed: Column) -> Column:
        is_object = F.schema_of_variant(record).startswith("OBJECT")
        return F.struct(malformed.alias("_malformed"), record.alias("_record"),
                        F.when(is_object, F.try_variant_get(record, "$", "map<string,variant>")).alias("_fields"))

    # Made inside the generator, so that a record's fields are taken apart once and not once per column. The value is
    # looked at once: behind the generator, or per record, a whole array would be copied for each of its records.
    whole = F.struct(F.col("_value").isNull().alias("malformed"), parts.alias("parts"))
    taken = let(whole, lambda w: F.transform(w["parts"], lambda record: parsed(record, w["malformed"])))
    return values.select("_ingest_time", "_source_file", F.inline(taken))


def _new_fields(records: DataFrame, known: T.StructType, most: int) -> list[T.StructField]:
    """Fields of a typed value that the schema lacks, by name; at most ``most`` columns in all."""
    names = [f.name for f in known.fields]
    unknown = F.map_filter("_fields", lambda k, _: ~k.isin(*names, *OWN))
    pairs = records.select(F.explode(unknown).alias("name", "value"))
    kinds = pairs.groupBy("name").agg(F.schema_of_variant_agg("value").alias("kind"))
    # Names that differ in case only can't be two columns; the first one is.
    found, taken = [], {n.lower() for n in names} | {n.lower() for n in OWN}
    for r in kinds.orderBy("name").limit(max(0, most - len(names)) + 1).collect():
        to = column_type(r.kind)
        if to is not None and r.name.lower() not in taken and len(names) + len(found) < most:
            taken.add(r.name.lower())
            found.append(T.StructField(r.name, to))
    return found


def typed(records: DataFrame, known: T.StructType) -> DataFrame:
    """Columns of the schema; what fits none of them as JSON text ``_rescued``, whole values that are no objects too."""
    fields = {f.name: f.dataType for f in known.fields}
    own = {n: F.element_at("_fields", F.lit(n)) for n in fields}
    # A value is tested once, in a step of its own, for its column and for what is rescued.
    good = {n: f"_good{i}" for i, n in enumerate(fields)}
    records = records.withColumns({good[n]: fits(v, fields[n]) for n, v in own.items()})
    columns = [F.when(F.col(good[n]), v if isinstance(fields[n], T.VariantType) else F.try_variant_get(v, "$", fields[n].simpleString())).alias(n)
               for n, v in own.items()]

    def left_over(name: Column, value: Column) -> Column:
        test = F.schema_of_variant(value) != "VOID"
        if not fields:
            return test
        first, *others = fields
        chain = F.when(name == first, ~F.col(good[first]))
        for n in others:
            chain = chain.when(name == n, ~F.col(good[n]))
        return chain.otherwise(test)

    rest = F.nullif(F.to_json(F.map_filter("_fields", left_over)), F.lit("{}"))
    if fields:
        # Most records have nothing but values that fit.
        held = reduce(lambda a, b: a + b, [F.when(own[n].isNotNull() & F.col(good[n]), 1).otherwise(0) for n in fields])
        rest = F.when(held < F.size("_fields"), rest)
    rescued = F.when(F.col("_fields").isNull(), F.to_json("_record")).otherwise(rest)
    return records.select(*columns, rescued.alias("_rescued"), "_malformed", "_ingest_time", "_source_file")


def ingest_inferred(spark: SparkSession, landing: str, path: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame] | None = None,
                    rules: dict[str, str] | None = None, watched: dict[str, str] | None = None, audit_path: str | None = None,
                    dataset: str = "bronze", multi_line: bool = True, max_files: int | None = None, most: int = 1000,
                    restarts: int = 20) -> int:
    """Ingest all unseen files under ``landing``; returns the number of the newest schema.

    A column gets the type of its first values and keeps it; a value of another
    type, a field beyond ``most`` columns or one whose name differs from a
    column's in case only goes to ``_rescued``, so that nothing is lost. A file
    that is no JSON is a row with ``_malformed``. Fields that were null so far
    are no columns yet. ``shape`` is applied to the typed rows before the
    rules; rules that break drop a row and are counted at ``audit_path``. A
    micro-batch that finds new fields stops its query; it is started again here
    at most ``restarts`` times. Read the table with ``read_inferred``.
    """
    def write(batch: DataFrame, n: int) -> None:
        session = batch.sparkSession
        version, known = known_schema(session, checkpoint)
        records = _records(batch)
        if new := _new_fields(records, known, most):
            # Another run may have noted a schema meanwhile; the restart reads whichever is newest.
            note_next(session, f"{checkpoint}_schemas", T.StructType(known.fields + new).json(), version + 1)
            raise SchemaChanged(f"new fields: {[f.name for f in new]}")
        rows = typed(records, known)
        rows = shape(rows) if shape else rows
        if (columns := rows.schema.json()) != _table_columns(session, checkpoint):
            note(session, f"{checkpoint}_schemas/_columns", columns)
        write_counted(rows, n, path, rules or {}, watched or {}, audit_path, dataset)

    for _ in range(restarts + 1):
        before, _ = known_schema(spark, checkpoint)
        try:
            (read_records(spark, landing, multi_line, max_files).writeStream.foreachBatch(write)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
            return before
        except StreamingQueryException:
            if known_schema(spark, checkpoint)[0] == before:
                raise
    raise SchemaChanged(f"{landing}: new fields in each of {restarts} restarts")


def _table_columns(spark: SparkSession, checkpoint: str) -> str | None:
    file = f"{checkpoint}_schemas/_columns"
    return noted(spark, file) if table_exists(spark, file) else None


def read_inferred(spark: SparkSession, path: str, checkpoint: str) -> DataFrame:
    """The ingested rows: columns of the newest schema and those that ``shape`` made; older rows lack later ones (NULL).

    The columns are noted, so no file is opened for them. Before the first file
    there is no table: an error.
    """
    if (columns := _table_columns(spark, checkpoint)) is None:
        raise ValueError(f"{path}: nothing has been ingested")
    return spark.read.schema(T.StructType.fromJson(json.loads(columns))).parquet(path).drop("batch")
