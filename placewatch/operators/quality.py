"""Data-quality rules that count, drop or stop, and checks on tables and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .history import union_all

AUDIT_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("dataset", T.StringType()),
    T.StructField("event_type", T.StringType()), T.StructField("rule", T.StringType()),
    T.StructField("action", T.StringType()), T.StructField("failed", T.LongType()),
    T.StructField("rows", T.LongType()), T.StructField("at", T.TimestampType())])


class RuleViolation(RuntimeError):
    """A dataset broke a rule that stops the run."""


def holds(rule: str | Column) -> Column:
    """A row passes only if the rule is TRUE; NULL is a failure."""
    return F.coalesce(F.expr(rule) if isinstance(rule, str) else rule, F.lit(False))


def expect(df: DataFrame, rules: dict[str, str], name: str | None = None) -> tuple[DataFrame, Observation]:
    """Count failures of each rule while the rows flow on unchanged."""
    seen = Observation(name) if name else Observation()
    counts = [F.count_if(~holds(r)).alias(n) for n, r in rules.items()]
    return df.observe(seen, F.count(F.lit(1)).alias("_rows"), *counts), seen


def expect_or_drop(df: DataFrame, rules: dict[str, str], name: str | None = None) -> tuple[DataFrame, Observation]:
    """Count failures and leave the failing rows out."""
    watched, seen = expect(df, rules, name)
    return keep_valid(watched, rules), seen


def keep_valid(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    for r in rules.values():
        df = df.where(holds(r))
    return df


def quarantine(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Failing rows with the names of the rules they break."""
    broken = F.array_compact(F.array(*[F.when(~holds(r), F.lit(n)) for n, r in rules.items()]))
    return df.withColumn("_broken", broken).where(F.size("_broken") > 0)


def rule_counts(df: DataFrame, rules: dict[str, str]) -> dict[str, int]:
    """Failures of each rule, and all rows as ``_rows``, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(~holds(r)).alias(n) for n, r in rules.items()]).first().asDict()


def stop_if_broken(counts: dict[str, int]) -> None:
    broken = {n: c for n, c in counts.items() if c and n != "_rows"}
    if broken:
        raise RuleViolation(f"rows that break a rule: {broken}")


def expect_or_fail(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Stop before anything is published when a row breaks a rule."""
    stop_if_broken(rule_counts(df, rules))
    return df


def rule_report(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule, passed, failed) in one pass over the data."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count_if(holds(r)).alias(n) for n, r in rules.items()])
    return (counts.unpivot(["_rows"], list(rules), "rule", "passed")
            .select("rule", "passed", (F.col("_rows") - F.col("passed")).alias("failed")))


def require_tables(spark: SparkSession, names: list[str]) -> DataFrame:
    """Row count per table; an error that lists the missing ones."""
    missing = [n for n in names if not spark.catalog.tableExists(n)]
    if missing:
        raise ValueError(f"missing tables: {missing}")
    return table_counts({n: spark.table(n) for n in names})


def missing_columns(frames: dict[str, DataFrame], wanted: dict[str, list[str]]) -> dict[str, list[str]]:
    gaps = {t: [c for c in cols if c not in frames[t].columns] for t, cols in wanted.items()}
    return {t: cols for t, cols in gaps.items() if cols}


def require_columns(frames: dict[str, DataFrame], wanted: dict[str, list[str]]) -> None:
    gaps = missing_columns(frames, wanted)
    if gaps:
        raise ValueError(f"missing columns: {gaps}")


def probe_values(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def table_counts(frames: dict[str, DataFrame]) -> DataFrame:
    return union_all([f.agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n")
                      for t, f in frames.items()])


def freshness_minutes(frames: dict[str, tuple[DataFrame, str]], now) -> DataFrame:
    """Newest stamp of each table, its batches, and how many minutes old it is at ``now``."""
    from ..functions.scalars import minutes_between

    parts = []
    for name, (f, ts) in frames.items():
        batches = f.groupBy(ts).agg(F.count("*").alias("_n"))
        last = batches.agg(F.max(ts).alias("latest"), F.count(ts).alias("n_batches"), F.sum("_n").alias("n_rows"))
        at = F.lit(now).cast(f.schema[ts].dataType)
        parts.append(last.select(F.lit(name).alias("table_name"), "n_rows", "n_batches", "latest",
                                 minutes_between("latest", at).alias("minutes_old")))
    return union_all(parts)


def audit(spark: SparkSession, run_id: str, dataset: str, action: str, metrics: dict[str, int],
          event_type: str = "expectation_result") -> DataFrame:
    """Audit rows of one dataset's rule counts, ready to append."""
    rows = metrics.get("_rows")
    made = [(run_id, dataset, event_type, rule, action, n, rows) for rule, n in metrics.items() if rule != "_rows"]
    head = T.StructType(AUDIT_SCHEMA.fields[:-1])
    return spark.createDataFrame(made, head).withColumn("at", F.current_timestamp())


def audit_events(log: DataFrame, event_type: str, limit: int | None = None) -> DataFrame:
    """Events of one type, the newest first; all of them unless a ``limit`` is asked for."""
    found = log.where(F.col("event_type") == event_type).orderBy(F.desc("at"), "dataset", "rule")
    return found if limit is None else found.limit(limit)
