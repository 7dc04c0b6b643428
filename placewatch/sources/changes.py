"""Merged tables without rewriting: changed rows are appended, the newest merge of a key counts, compaction folds them in.

A table is a folder of numbered notes (``_log``) and of data folders. A merge
writes only its own rows and then its note; a data folder that no note names
was never published. Readers take the last base and the changes noted after it,
so a merge of few keys costs what those keys cost, whatever the table holds.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.history import latest_per_key
from .sinks import note_next, noted, notes


def _entries(spark: SparkSession, path: str) -> list[dict]:
    """Published merges since the last base, that base first."""
    found = []
    for n in reversed(notes(spark, f"{path}/_log")):
        found.append({"number": n, **json.loads(noted(spark, f"{path}/_log/_{n:08d}"))})
        if found[-1]["base"]:
            break
    return found[::-1]


def merge_changes(spark: SparkSession, path: str, source: DataFrame, keys: list[str], order_by: list[str] | None = None,
                  name: str | None = None) -> None:
    """Publish ``source`` as the newest rows of its keys; nothing else of the table is read or written.

    Of rows with the same key the largest by ``order_by`` counts; without it a
    repeated key is an error. NULL keys are equal to each other. A merge with
    the ``name`` of one that is already published does nothing, so a repeated
    micro-batch counts once. New columns are NULL in older rows; a column keeps
    its type. A merge without rows only makes the table known.
    """
    log = _entries(spark, path)
    if name is not None and any(e["name"] == name for e in log):
        return
    if log and log[0]["keys"] != keys:
        raise ValueError(f"{path} has the keys {log[0]['keys']}, not {keys}")
    known = {f.name: f.dataType for e in log for f in T.StructType.fromJson(e["columns"]).fields}
    for f in source.schema.fields:
        if known.get(f.name, f.dataType) != f.dataType:
            raise ValueError(f"{path}: {f.name} is {known[f.name].simpleString()}, not {f.dataType.simpleString()}")
    if order_by:
        rows = latest_per_key(source, keys, order_by).select(*source.columns)
    else:
        rest = [c for c in source.columns if c not in keys]
        packed = source.groupBy(*keys).agg(F.count("*").alias("_n"), F.any_value(F.struct(*rest)).alias("_row"))
        one = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(F.lit("merge: the source has more than one row for a key")))
        rows = packed.select(*keys, one.alias("_row")).select(*keys, "_row.*").select(*source.columns)
    own = f"rows-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{own}")
    entry = json.dumps({"base": not log, "name": name, "keys": keys, "folder": own, "columns": json.loads(rows.schema.json())})
    # Where another merge took the number, this one counts after it.
    while note_next(spark, f"{path}/_log", entry) is None:
        if not log:
            raise RuntimeError(f"{path}: another first merge was published; merge again")


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """The table now: the newest row of each key. The base is not shuffled where the changed keys fit a broadcast."""
    log = _entries(spark, path)
    if not log:
        raise ValueError(f"{path}: no merge has been published")
    fields = {f.name: f for e in log for f in T.StructType.fromJson(e["columns"]).fields}
    columns, keys = T.StructType(list(fields.values())), log[0]["keys"]

    def rows(e: dict) -> DataFrame:
        return spark.read.schema(columns).parquet(f"{path}/{e['folder']}")

    base = rows(log[0])
    if len(log) == 1:
        return base
    changed = rows(log[1]).withColumn("_at", F.lit(log[1]["number"]))
    for e in log[2:]:
        changed = changed.unionByName(rows(e).withColumn("_at", F.lit(e["number"])))
    if len(log) > 2:
        changed = latest_per_key(changed, keys, ["_at"])
    hit = changed.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = [base[k].eqNullSafe(hit[f"_k{i}"]) for i, k in enumerate(keys)]
    return base.join(hit, same, "left_anti").unionByName(changed.select(*base.columns))


def compact_changes(spark: SparkSession, path: str, files: int | None = None) -> None:
    """Fold all changes into a new base. Readers of the old base are not disturbed; the folders it replaces stay."""
    log = _entries(spark, path)
    if len(log) < 2:
        return
    keys = log[0]["keys"]
    now = read_changes(spark, path)
    now = now.repartitionByRange(files, *keys) if files else now.repartitionByRange(*keys)
    own = f"base-{uuid.uuid4().hex}"
    now.sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/{own}")
    entry = {"base": True, "name": log[-1]["name"], "keys": keys, "folder": own, "columns": json.loads(now.schema.json())}
    # The number is asked for, so that a base never hides a merge it does not hold.
    if note_next(spark, f"{path}/_log", json.dumps(entry), log[-1]["number"] + 1) is None:
        raise RuntimeError(f"{path}: a merge was published while it was compacted; compact again")
