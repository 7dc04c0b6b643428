"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import sys
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import scratch

#: White space that separates words: space and the control characters 9 to 13.
SPACES = r"[\x20\x09-\x0D]+"
#: Rows of a side of a join that Spark may broadcast if it likes: a few MB in the driver.
FEW = 50_000


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a table under the shared checkpoint folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, f"llm/{name}")
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    # The schema by name, as the reader puts partition columns last.
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_shuffle(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` as the side of a join that grows with the documents: never sent through the driver, unless it has ``rows`` and these are few.

    Spark judges a side by its packed file, and does not count the rows that an
    explode makes of one; so a side of any size in memory may pass for a small one.
    """
    return df if rows is not None and rows <= FEW else df.hint("merge")


def per_process(key: str, make: Callable[[], Any]) -> Any:
    """A value kept for the life of a Python worker, from task to task (functions arrive by value, so module globals don't last)."""
    kept = sys.__dict__.setdefault("_placewatch_llm", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Words between white space, as an array; empty for a text without words."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")
