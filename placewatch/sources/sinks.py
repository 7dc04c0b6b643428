"""Writers: stamped appends, replacing and clustering tables, upserts, views, comments."""

from __future__ import annotations

import datetime as dt
import json
import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.history import latest_per_key, upsert


FILE_ROWS = 2_000_000   # rows that one task sorts for a file


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder the session names."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        # One process, as in tests: a folder of its own, kept by the context.
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="placewatch-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/placewatch/{name}-{uuid.uuid4().hex}"


def append_batch(df: DataFrame, path: str, partition_by: str | None = "_ingest_time") -> None:
    """Append one stamped batch, in day folders of its stamp; an empty batch writes no row.

    The columns of all batches so far are noted beside the table, so that
    readers need not open every file for them. A column keeps its type.
    """
    spark = df.sparkSession
    if partition_by:
        df = df.withColumn("_ingest_date", F.to_date(partition_by))
    known = {f.name: f for f in (_columns(spark, path) or T.StructType([])).fields}
    for f in df.schema.fields:
        if known.setdefault(f.name, T.StructField(f.name, f.dataType)).dataType != f.dataType:
            raise ValueError(f"{path}: {f.name} is {known[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
    df.write.mode("append").partitionBy(*(["_ingest_date"] if partition_by else [])).parquet(path)
    note(spark, f"{path}/_columns", T.StructType(list(known.values())).json())


def _columns(spark: SparkSession, path: str) -> T.StructType | None:
    if not table_exists(spark, f"{path}/_columns"):
        return None
    return T.StructType.fromJson(json.loads(noted(spark, f"{path}/_columns")))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Batches of any earlier schema; columns added later are NULL in older ones."""
    columns = _columns(spark, path)
    return spark.read.schema(columns).parquet(path) if columns else spark.read.option("mergeSchema", True).parquet(path)


def clustered(df: DataFrame, keys: list[str], files: int | None = None) -> DataFrame:
    """Rows in key ranges and sorted, so file statistics let readers skip."""
    ranged = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def z_ordered(df: DataFrame, columns: list[str], files: int, bits: int = 8, sample: int = 20_000) -> DataFrame:
    """Rows along a Z-order curve over several columns, so that statistics of each file let readers skip by any of them.

    A column's value counts by its place among 2^``bits`` ranges of about equal
    size, whose bounds come from at most ``sample`` rows, those with the least
    hash of these columns; the bits of the places are interleaved. The sample
    decides on the order of rows only. NULL is the first range; of one very
    common value all rows lie together, and ties of the curve are in the order
    of the columns.
    """
    known = df.select(*columns).orderBy(F.xxhash64(*columns)).limit(sample).collect()
    code = F.lit(0).cast("long")
    for i, c in enumerate(columns):
        seen = sorted(r[i] for r in known if r[i] is not None)
        bounds = [seen[len(seen) * k // 2**bits] for k in range(1, 2**bits)] if seen else []
        if not bounds:
            continue
        limits = F.array(*[F.lit(b) for b in bounds]).cast(T.ArrayType(df.schema[c].dataType))
        code = code + _spread(_place(F.col(c), limits, bits), bits, len(columns), i)
    return (df.withColumn("_z", code).repartitionByRange(files, "_z", *columns).sortWithinPartitions("_z", *columns).drop("_z"))


def _place(value: Column, limits: Column, bits: int) -> Column:
    """How many limits are not above the value, by binary search: a step is taken where the limit before its end allows it."""
    return F.reduce(F.array(*[F.lit(2**k) for k in reversed(range(bits))]), F.lit(0),
                    lambda at, step: at + F.when(F.get(limits, at + step - 1) <= value, step).otherwise(0))


def _spread(place: Column, bits: int, gap: int, first: int) -> Column:
    """The bits of a number moved apart, ``gap`` places each, from place ``first`` on."""
    start = F.struct(place.cast("long").alias("rest"), F.lit(0).cast("long").alias("out"))
    powers = F.array(*[F.lit(2**(k * gap + first)).cast("long") for k in range(bits)])
    return F.reduce(powers, start, lambda a, p: F.struct(F.shiftright(a["rest"], 1).alias("rest"), (a["out"] + (a["rest"] % 2) * p).alias("out")), lambda a: a["out"])


def replace(df: DataFrame, path: str, cluster_by: tuple[str, ...] = ()) -> None:
    out = clustered(df, list(cluster_by)) if cluster_by else df
    out.write.mode("overwrite").parquet(path)


def compact(spark: SparkSession, source: str, target: str, keys: list[str], files: int) -> None:
    """Rewrite many small files as ``files`` sorted ones, into another folder; as more where one would hold over ``FILE_ROWS`` rows.

    A file is sorted by one task, so its rows are bounded, not the table's.
    """
    rows = spark.read.parquet(source)
    clustered(rows, keys, max(files, -(-rows.count() // FILE_ROWS))).write.mode("overwrite").parquet(target)


def land(df: DataFrame, root: str, subdir: str, batch_time: dt.datetime) -> str | None:
    """One batch as JSON at <root>/<subdir>/YYYY/MM/DD/HHMMSS.json; never over an old one, none when empty."""
    if df.isEmpty():
        return None
    path = f"{root.rstrip('/')}/{subdir}/{batch_time:%Y/%m/%d/%H%M%S}.json"
    df.write.mode("errorifexists").json(path)
    return path


def land_arrays(df: DataFrame, folder: str, rows: int = 10_000) -> None:
    """Rows as files of one JSON array each, over several lines, of about ``rows`` objects a file's block."""
    number = F.monotonically_increasing_id()
    block = df.select(F.to_json(F.struct(*df.columns)).alias("o"), (number / rows).cast("long").alias("b"))
    text = F.concat(F.lit("[\n "), F.array_join(F.collect_list("o"), ",\n "), F.lit("\n]"))
    arrays = block.groupBy("b").agg(text.alias("value"))
    # A text file holds the lines of one array only.
    arrays.repartition(F.col("b")).write.partitionBy("b").mode("append").text(folder)


def upsert_table(spark: SparkSession, path: str, source: DataFrame, keys: list[str],
                 order_by: list[str] | None = None, buckets: int = 64, newest: bool = False, files: int = 8) -> DataFrame:
    """Merge into a Parquet table kept in ``buckets`` folders by a hash of the keys; returns the new table.

    The source is written once and read from there. Only the buckets it touches
    are read and replaced (dynamic partition overwrite: files are staged and
    swapped when the job has succeeded), each by up to ``files`` tasks. Running
    the same merge again gives the same table; NULL keys are equal to each
    other. The bucket count is kept with the table, another one is an error.
    One writer at a time. Choose ``buckets`` so that a bucket holds a few GB.
    With ``newest`` the stored row stays where it is larger by ``order_by`` than
    the arriving one.
    """
    number = F.xxhash64(*keys)
    staged = scratch(spark, "merge")
    source.withColumn("_bucket", F.pmod(number, F.lit(buckets)).cast("int")).write.parquet(staged)
    source = spark.read.parquet(staged)
    if table_exists(spark, f"{path}/_buckets"):
        if (kept := int(noted(spark, f"{path}/_buckets"))) != buckets:
            raise ValueError(f"{path} is kept in {kept} buckets, not {buckets}")
        touched = [r[0] for r in source.select("_bucket").distinct().collect()]   # at most ``buckets`` numbers
        before = spark.read.schema(source.schema).parquet(path).where(F.col("_bucket").isin(touched))
    else:
        # The first merge, or one after a first merge that failed: what that one left behind is replaced.
        drop(spark, path)
        before = source.limit(0)
    if newest:
        merged = latest_per_key(before.unionByName(source), ["_bucket", *keys], order_by)
    else:
        merged = upsert(before, source, ["_bucket", *keys], order_by)
    part = F.pmod(F.shiftrightunsigned(number, 32), F.lit(files))
    (merged.repartition("_bucket", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("_bucket").parquet(path))
    # Only now is there a table. A merge without rows leaves its columns, so that an empty table can be read.
    note(spark, f"{path}/_merged", source.drop("_bucket").schema.json())
    note(spark, f"{path}/_buckets", str(buckets))
    drop(spark, staged)
    return read_merged(spark, path)


def note(spark: SparkSession, file: str, text: str) -> None:
    """Keep a short text in one file, replaced in one step: a reader finds the old text or the new one, never none.

    Readers of tables pass over names that begin with an underscore.
    """
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    old = fs.Path(file)
    new = fs.Path(old.getParent(), f"_new.{uuid.uuid4().hex}")
    out = new.getFileSystem(conf).create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    how[0] = getattr(fs, "Options$Rename").OVERWRITE
    fs.FileContext.getFileContext(old.toUri(), conf).rename(new, old, how)


def note_next(spark: SparkSession, folder: str, text: str, number: int | None = None) -> int | None:
    """Add the next numbered note of a folder, from 1, or the one of ``number``; None where another writer took the number first."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    number = number or max(notes(spark, folder), default=0) + 1
    path, new = fs.Path(f"{folder}/_{number:08d}"), fs.Path(f"{folder}/_new.{uuid.uuid4().hex}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    # A rename without OVERWRITE fails where the name is taken, so that a note is there as a whole or not at all.
    how = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    how[0] = getattr(fs, "Options$Rename").NONE
    try:
        fs.FileContext.getFileContext(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(new, path, how)
    except Py4JJavaError as e:
        files.delete(new, False)
        if "FileAlreadyExists" in str(e.java_exception):
            return None
        raise
    return number


def notes(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of a folder's notes, rising."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(path))
    return sorted(int(n[1:]) for n in names if re.fullmatch(r"_\d{8}", n))


def noted(spark: SparkSession, file: str) -> str:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
    got = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    try:
        return bytes(got.readAllBytes()).decode()
    finally:
        got.close()


def drop(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder that no frame reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    columns = T.StructType.fromJson(json.loads(noted(spark, f"{path}/_merged")))
    return spark.read.schema(columns).parquet(path).drop("_bucket")


def table_exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def declare(spark: SparkSession, table: str, columns: str, partition_by: str | None = None,
            comment: str | None = None, location: str | None = None) -> None:
    """Create an empty Parquet table unless it exists; ``location`` is a folder all executors share."""
    part = f" PARTITIONED BY ({partition_by})" if partition_by else ""
    text = f" COMMENT {_quoted(comment)}" if comment else ""
    where = f" LOCATION {_quoted(location)}" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet{part}{where}{text}")


def document(spark: SparkSession, table: str, comment: str, columns: dict[str, str] | None = None) -> None:
    """Table and column comments; apply again after a table was replaced."""
    spark.sql(f"COMMENT ON TABLE {table} IS {_quoted(comment)}")
    for c, text in (columns or {}).items():
        spark.sql(f"ALTER TABLE {table} ALTER COLUMN {c} COMMENT {_quoted(text)}")


def view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def supplier_events(df: DataFrame, action: str, at) -> DataFrame:
    """Rows of ADD or REMOVE events ready to append; a postcode that is no number becomes NULL."""
    from ..functions.scalars import clean_abn

    adding = action == "ADD"
    names = ["supplier_name", "supplier_status", "supplier_entity_type", "supplier_state"]
    code = F.col("supplier_postcode").cast("string")
    postcode = F.when(code.rlike(r"^\d+$"), code.try_cast("long")) if adding else F.lit(None).cast("long")
    return df.where(clean_abn("user_abn").rlike(r"^\d{11}$")).select(
        clean_abn("user_abn").cast("long").alias("user_abn"),
        clean_abn("supplier_abn").try_cast("long").alias("supplier_abn"),
        *[(F.coalesce(F.col(c), F.lit("")) if adding else F.lit("")).alias(c) for c in names],
        postcode.alias("supplier_postcode"),
        F.lit(str(at)).cast("timestamp").alias("added_at"), F.lit(action).alias("action"))
