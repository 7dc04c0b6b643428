"""Wide to long, code-named columns, tagged unions, array set measures, contracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import as_col


def to_contract(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in its order and types; absent ones become typed NULLs."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in schema.fields])


def zero_fill(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.fillna(0, subset=cols)


def derive(df: DataFrame, exprs: dict[str, Column | str]) -> DataFrame:
    return df.withColumns({n: F.expr(e) if isinstance(e, str) else e for n, e in exprs.items()})


def tolerant_cast(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    """Cast without failing: text that does not fit becomes NULL."""
    return df.withColumns({n: F.col(n).try_cast(t) for n, t in casts.items()})


def first_present(df: DataFrame, *paths: str) -> Column:
    """First non-null of the paths this schema has; structs and arrays of structs both work."""
    found = [c for c in (path_column(df.schema, p) for p in paths) if c is not None]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def path_column(schema: T.StructType, path: str) -> Column | None:
    """Column for a dotted path, entering the first element of arrays; NULL-safe, None when absent."""
    col, kind = None, schema
    for name in path.split("."):
        if isinstance(kind, T.ArrayType):
            col, kind = F.get(col, F.lit(0)), kind.elementType
        if not isinstance(kind, T.StructType) or name not in kind.fieldNames():
            return None
        col = F.col(f"`{name}`") if col is None else col[name]
        kind = kind[name].dataType
    if isinstance(kind, T.ArrayType):
        col = F.get(col, F.lit(0))
    return col


def normalise_names(df: DataFrame) -> DataFrame:
    """Lower-case column names, blanks and hyphens as underscores."""
    return df.toDF(*[c.lower().replace(" ", "_").replace("-", "_") for c in df.columns])


def pick_column(df: DataFrame, *candidates: str) -> str:
    """The first candidate the frame has, ignoring case; an error when there is none."""
    have = {c.lower(): c for c in df.columns}
    for c in candidates:
        if c.lower() in have:
            return have[c.lower()]
    raise ValueError(f"none of {candidates} among columns {df.columns}")


def union_tagged(frames: dict[str, DataFrame], tag: str = "tag") -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b),
                  [f.withColumn(tag, F.lit(name)) for name, f in frames.items()])


def distinct_seeds(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).distinct()


def unpivot_drop_nulls(df: DataFrame, ids: list[str], cols: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, cols, name, value).where(F.col(value).isNotNull())


def melt_named(df: DataFrame, ids: list[str], pattern: str, parts: list[str], value: str = "value") -> DataFrame:
    """Columns whose names match ``pattern`` to rows; its groups become the columns ``parts``.

    Other columns are left out. Values that are no numbers are dropped.
    """
    import re

    rx = re.compile(pattern)
    named = [c for c in df.columns if c not in ids and rx.match(c)]
    text = df.select(*ids, *[F.col(f"`{c}`").try_cast("double").alias(c) for c in named])
    long = unpivot_drop_nulls(text, ids, named, "_series", value)
    extra = [F.regexp_extract("_series", pattern, i + 1).alias(p) for i, p in enumerate(parts)]
    return long.select(*ids, *extra, value)


def set_overlap(actual: str | Column, expected: str | Column, forbidden: str | Column) -> Column:
    """Struct of matched, missed, extra and forbidden entries, recall, precision, score.

    NULL expected means: not scored. Nothing expected gives recall 1; nothing
    called gives precision 1 if nothing was expected, else 0. Any forbidden
    entry costs 0.5.
    """
    none = F.array().cast("array<string>")
    called = F.array_distinct(F.coalesce(as_col(actual), none))
    wanted, banned = as_col(expected), F.coalesce(as_col(forbidden), none)
    matched = F.array_intersect(called, wanted)
    bad = F.array_intersect(called, banned)
    recall = F.when(F.size(wanted) == 0, 1.0).otherwise(F.try_divide(F.size(matched), F.size(wanted)))
    precision = (F.when(F.size(called) > 0, F.try_divide(F.size(matched), F.size(called)))
                 .when(F.size(wanted) == 0, 1.0).otherwise(0.0))
    penalty = F.when(F.size(bad) > 0, 0.5).otherwise(0.0)
    scored = wanted.isNotNull()
    return F.struct(
        F.when(scored, recall).alias("recall"),
        F.when(scored, precision).alias("precision"),
        F.when(scored, F.array_sort(F.array_except(wanted, called))).otherwise(none).alias("missed"),
        F.when(scored, F.array_sort(F.array_except(F.array_except(called, wanted), banned))).otherwise(none).alias("extra"),
        F.when(scored, F.array_sort(bad)).otherwise(none).alias("forbidden_called"),
        F.when(scored, F.greatest(F.lit(0.0), recall - penalty)).alias("score"))
