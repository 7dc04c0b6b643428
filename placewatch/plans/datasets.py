"""Named datasets with inputs and rules, rebuilt in dependency order into Parquet folders."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import AUDIT_SCHEMA, RuleViolation, audit, expect, keep_valid, rule_counts, stop_if_broken
from ..sources.sinks import clustered, drop, note, noted, scratch


@dataclass
class Dataset:
    build: Callable[..., DataFrame]
    inputs: tuple[str, ...] = ()
    watch: dict[str, str] = field(default_factory=dict)
    drop: dict[str, str] = field(default_factory=dict)
    fail: dict[str, str] = field(default_factory=dict)
    cluster_by: tuple[str, ...] = ()
    comment: str = ""
    properties: dict[str, str] = field(default_factory=dict)


class Datasets:
    """A registry: ``define`` datasets, then ``refresh`` them under one root folder.

    Each refresh writes new folders named by the run and then notes the folder
    in a small file beside them, with the dataset's comment and properties.
    ``read`` follows that note, so readers in any process never see a
    half-written table. Rule counts are appended to the ``_audit`` folder.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.known: dict[str, Dataset] = {}
        self.sources: dict[str, DataFrame] = {}

    def source(self, name: str, df: DataFrame) -> None:
        self.sources[name] = df

    def define(self, name: str, build: Callable[..., DataFrame], inputs: tuple[str, ...] = (), **options) -> None:
        self.known[name] = Dataset(build, inputs, **options)

    def order(self) -> list[str]:
        graph = {n: [i for i in d.inputs if i in self.known] for n, d in self.known.items()}
        return list(TopologicalSorter(graph).static_order())

    def about(self, name: str) -> dict:
        """Folder, run, comment and properties of the newest published version."""
        return json.loads(noted(self.spark, f"{self.root}/{name}/_published"))

    def read(self, name: str) -> DataFrame:
        return self.sources[name] if name in self.sources else self.spark.read.parquet(self.about(name)["path"])

    def refresh(self, run_id: str | None = None) -> str:
        run_id = run_id or uuid.uuid4().hex
        for name in self.order():
            self._build(name, run_id)
        return run_id

    def _build(self, name: str, run_id: str) -> None:
        d = self.known[name]
        df = d.build(*[self.read(i) for i in d.inputs])
        rules, seen, counts, staged = {**d.watch, **d.drop}, None, {}, None
        if d.fail or (rules and d.cluster_by):
            # Checked before anything is published, and read again by range clustering: written once, not computed twice.
            staged = scratch(self.spark, f"datasets/{name}")
            df.write.parquet(staged)
            df = self.spark.read.schema(df.schema).parquet(staged)
            counts = rule_counts(df, {**rules, **d.fail})
            try:
                stop_if_broken({r: counts[r] for r in d.fail})
            except RuleViolation:
                drop(self.spark, staged)
                raise
        elif rules:
            df, seen = expect(df, rules)
        df = keep_valid(df, d.drop)
        path = f"{self.root}/{name}/{run_id}"
        (clustered(df, list(d.cluster_by)) if d.cluster_by else df).write.mode("errorifexists").parquet(path)
        if staged:
            drop(self.spark, staged)
        note(self.spark, f"{self.root}/{name}/_published", json.dumps({"path": path, "run_id": run_id, "comment": d.comment, "properties": d.properties}))
        rows = self.spark.read.parquet(path).count()
        log = audit(self.spark, run_id, name, "write", {"rows_written": rows, "_rows": rows}, "flow_progress")
        counts = seen.get if seen is not None else counts
        for action, some in (("allow", d.watch), ("drop", d.drop), ("fail", d.fail)):
            if some:
                part = {r: counts[r] for r in some}
                log = log.unionByName(audit(self.spark, run_id, name, action, {**part, "_rows": counts["_rows"]}))
        log.coalesce(1).write.mode("append").parquet(f"{self.root}/_audit")

    def audit_log(self) -> DataFrame:
        return self.spark.read.schema(AUDIT_SCHEMA).parquet(f"{self.root}/_audit")

    def dropped(self) -> DataFrame:
        return (self.audit_log().where("event_type = 'expectation_result'")
                .groupBy("dataset", "rule", "action").agg(F.sum("failed").alias("failed")))
