"""Streams: files to tables once each, replay, daily roll-up, newest row per key."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from ..operators.quality import expect, keep_valid
from ..sources.changes import merge_changes
from ..sources.sinks import note


def ingest(stream: DataFrame, path: str, checkpoint: str, rules: dict[str, str] | None = None,
           watched: dict[str, str] | None = None, audit_path: str | None = None, dataset: str = "bronze",
           available_now: bool = True) -> StreamingQuery:
    """Append unseen files to a Parquet table, a folder per micro-batch; rows that break ``rules`` are left out.

    Each file counts once: the checkpoint names the files read, and a repeated
    micro-batch replaces its own folders. With ``audit_path`` the counts of
    ``rules`` and ``watched`` are observed while the rows are written, in the
    same pass, and appended there; a repeated micro-batch replaces these too,
    so counts and rows stay exact after a restart.
    """
    def write(batch: DataFrame, n: int) -> None:
        write_counted(batch, n, path, rules or {}, watched or {}, audit_path, dataset)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


AUDIT = "dataset string, rule string, action string, passed long, failed long"


def write_counted(batch: DataFrame, n: int, path: str, rules: dict[str, str], watched: dict[str, str],
                  audit_path: str | None = None, dataset: str = "bronze") -> None:
    """Write the valid rows of micro-batch ``n``, and the counts of the rules that were observed on the way."""
    every = {**rules, **watched}
    counted, seen = expect(batch, every)
    keep_valid(counted, rules).write.mode("overwrite").parquet(f"{path}/batch={n}")
    if audit_path is not None:
        got = seen.get
        found = [(dataset, r, "drop" if r in rules else "allow", got["_rows"] - got[r], got[r]) for r in every]
        batch.sparkSession.createDataFrame(found, AUDIT).coalesce(1).write.mode("overwrite").parquet(f"{audit_path}/batch={n}")


def replay(build, path: str, checkpoint: str, rules: dict[str, str] | None = None) -> StreamingQuery:
    """Rebuild a table from its landing files: a new table folder with a new checkpoint.

    ``build`` makes the stream. The stamps are file times, so the rebuilt rows
    carry the stamps of the first run.
    """
    return ingest(build(), path, checkpoint, rules)


def daily_rollup(stream: DataFrame, ts: str, keys: list[str], aggs: dict, watermark: str = "1 day") -> DataFrame:
    """Event-time day sums per key; rows later than the watermark are dropped by Spark."""
    day = F.window(ts, "1 day")
    return (stream.withWatermark(ts, watermark).groupBy(day.alias("_w"), *keys)
            .agg(*[c.alias(n) for n, c in aggs.items()])
            .withColumn("day", F.to_date("_w.start")).drop("_w"))


def store_rollup(rolled: DataFrame, path: str, keys: list[str], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep a roll-up as a table of changes (``read_changes``): each micro-batch appends its changed groups, nothing is rewritten."""
    def merge(batch: DataFrame, n: int) -> None:
        merge_changes(batch.sparkSession, path, batch, keys, name=f"{checkpoint}-{n}")

    writer = rolled.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_to_parquet(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run an append stream over all input there is and return what it wrote."""
    query = (df.writeStream.format("parquet").outputMode("append").option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


class _Newest(StatefulProcessor):
    """The newest row of a key as its state; a row comes out only where it replaces that."""

    def __init__(self, columns: list[str], order: list[str], state: str):
        self.columns, self.order, self.kind = columns, order, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("newest", self.kind)

    def _rank(self, row) -> tuple:
        return tuple((row[self.columns.index(c)] is not None, row[self.columns.index(c)]) for c in self.order)

    def handleInputRows(self, key, rows, timer_values):
        # One look at the state per key and micro-batch, however many rows came.
        before = best = self.kept.get() if self.kept.exists() else None
        for row in rows:
            row = tuple(row[c] for c in self.columns)
            if best is None or self._after(row, best):
                best = row
        if best is not before:
            self.kept.update(best)
            yield Row(**dict(zip(self.columns, best)))

    def _after(self, row, other) -> bool:
        for (some, a), (has, b) in zip(self._rank(row), self._rank(other)):
            if some != has:
                return some
            if some and a != b:
                return a > b
        return False

    def close(self) -> None:
        pass


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def changed_latest(stream: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows that become the newest of their key (largest ``order``, NULL first), at most one per key and micro-batch.

    The newest row of each key is streaming state; a row that arrives late and
    is older, or as new as the kept one, comes out nowhere. The query has to be
    started with the state store ``STATE_STORE``.
    """
    state = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    return stream.groupBy(*keys).transformWithState(_Newest(stream.columns, order, state), stream.schema, "Update", "None")


def keep_latest(stream: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str,
                available_now: bool = True) -> StreamingQuery:
    """Newest row per key, kept as a table of changes (``read_changes``): a micro-batch appends the keys it changed."""
    def merge(batch: DataFrame, n: int) -> None:
        merge_changes(batch.sparkSession, path, batch, keys, name=f"{checkpoint}-{n}")

    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, STATE_STORE)         # noted in the checkpoint when the query starts
    try:
        writer = (changed_latest(stream, keys, order).writeStream.outputMode("update").foreachBatch(merge)
                  .option("checkpointLocation", checkpoint))
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        conf.set(name, before)


class FlowAudit(StreamingQueryListener):
    """Progress of streaming queries as a table: rows read per micro-batch, and rows dropped as later than the watermark.

    Spark counts late rows behind its partial aggregation: rows of one group
    that come in one task count once.
    """

    SCHEMA = "dataset string, query_id string, batch long, rows long, late long, watermark string, state_rows long, at string"

    def __init__(self, spark: SparkSession, path: str, dataset: str):
        self.spark, self.path, self.dataset, self.ended = spark, path, dataset, threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = {"dataset": self.dataset, "query_id": str(p.id), "batch": p.batchId, "rows": p.numInputRows,
               "late": sum(s.numRowsDroppedByWatermark for s in p.stateOperators), "watermark": dict(p.eventTime or {}).get("watermark"),
               "state_rows": sum(s.numRowsTotal for s in p.stateOperators), "at": p.timestamp}
        # A file per micro-batch, replaced when it is repeated. Progress without rows leaves its own mark only.
        note(self.spark, f"{self.path}/{p.id}-{p.batchId}.json", json.dumps(row))

    def onQueryTerminated(self, event) -> None:
        self.ended.set()

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).json(self.path)

    def follow(self, start: Callable[[], StreamingQuery], seconds: float = 60) -> None:
        """Run a query to its end; when this returns, all its progress is in the table."""
        self.spark.streams.addListener(self)
        try:
            self.ended.clear()
            start().awaitTermination()
            if not self.ended.wait(seconds):
                raise TimeoutError("the end of the query was not reported")
        finally:
            self.spark.streams.removeListener(self)
