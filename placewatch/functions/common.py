"""Small helpers shared by the operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def moment(df: DataFrame, ts: str, now) -> Column:
    """``now`` as a literal of the same timestamp type as column ``ts``.

    Without ``now`` the newest value of ``ts`` in ``df`` is used, so a result
    depends on the data and never on the clock of the machine.
    """
    if now is None:
        return df.agg(F.max(ts)).scalar()
    if isinstance(now, Column):
        return now
    if isinstance(now, dt.datetime):
        now = now.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(str(now)).cast(df.schema[ts].dataType)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def tasks(spark: SparkSession) -> int:
    """Tasks of a shuffle; a number given to ``repartition`` stays where few bytes mean much work, others Spark makes fewer."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def seconds(c: str | Column) -> Column:
    return F.unix_timestamp(as_col(c).cast("timestamp"))
