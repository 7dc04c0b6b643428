"""Grid cells and distances as native column expressions.

A cell is one square of a regular latitude/longitude grid with ``per_degree``
squares to a degree. Its id is a long, row * (360 * per_degree) + column, so
every spatial test on cells is an equality of longs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import as_col, let

EARTH_KM = 6371.0  # fixed value
PER_DEGREE = 100   # about 1.1 km north to south


def _at_most(index: Column, last: int) -> Column:
    return F.when(index > last, F.lit(last).cast("long")).otherwise(index)


def cell_row(lat: str | Column, per_degree: int = PER_DEGREE) -> Column:
    return _at_most(F.floor((as_col(lat) + 90.0) * per_degree), 180 * per_degree - 1)


def cell_column(lon: str | Column, per_degree: int = PER_DEGREE) -> Column:
    return _at_most(F.floor((as_col(lon) + 180.0) * per_degree), 360 * per_degree - 1)


def cell_at(row: str | Column, column: str | Column, per_degree: int = PER_DEGREE) -> Column:
    return as_col(row) * F.lit(360 * per_degree).cast("long") + as_col(column)


def cell_id(lon: str | Column, lat: str | Column, per_degree: int = PER_DEGREE) -> Column:
    """Cell of a point, longitude first; NULL when a coordinate is NULL."""
    return cell_at(cell_row(lat, per_degree), cell_column(lon, per_degree), per_degree)


def _split(cell: str | Column, per_degree: int) -> tuple[Column, Column]:
    width = F.lit(360 * per_degree).cast("long")
    cell = as_col(cell)
    return F.floor(cell / width), F.pmod(cell, width)


def cell_center(cell: str | Column, per_degree: int = PER_DEGREE) -> Column:
    row, column = _split(cell, per_degree)
    return F.struct(((row + 0.5) / per_degree - 90.0).alias("lat"),
                    ((column + 0.5) / per_degree - 180.0).alias("lon"))


def cell_boundary(cell: str | Column, per_degree: int = PER_DEGREE) -> Column:
    """WKT of the cell's square, longitude first, closed ring."""
    row, column = _split(cell, per_degree)
    south, north = row / per_degree - 90.0, (row + 1) / per_degree - 90.0
    west, east = column / per_degree - 180.0, (column + 1) / per_degree - 180.0
    ring = [(west, south), (east, south), (east, north), (west, north), (west, south)]
    points = [F.concat_ws(" ", F.round(x, 6).cast("string"), F.round(y, 6).cast("string")) for x, y in ring]
    return F.concat(F.lit("POLYGON(("), F.concat_ws(", ", *points), F.lit("))"))


def ring(cell: str | Column, k: int = 1, per_degree: int = PER_DEGREE) -> Column:
    """The cell and all cells at most ``k`` steps away; wraps in longitude, stops at the poles."""
    width, last = F.lit(360 * per_degree).cast("long"), 180 * per_degree - 1
    steps = F.sequence(F.lit(-k).cast("long"), F.lit(k).cast("long"))

    def around(at: Column) -> Column:
        rows = F.filter(F.transform(steps, lambda d: at["row"] + d), lambda r: (r >= 0) & (r <= last))
        return F.flatten(F.transform(rows, lambda r: F.transform(
            steps, lambda d: r * width + F.pmod(at["column"] + d, width))))

    row, column = _split(cell, per_degree)
    return F.when(as_col(cell).isNotNull(), let(F.struct(row.alias("row"), column.alias("column")), around))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (as_col(c) for c in (lat1, lon1, lat2, lon2))
    a = (F.pow(F.sin(F.radians((lat2 - lat1) / 2)), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians((lon2 - lon1) / 2)), 2))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(a))


def wkt_to_points(wkt: str | Column) -> Column:
    """Outer ring of a POLYGON text as [[lat, lng], ...] (axes swapped); holes are left out, a number that is none is NULL."""
    ring = F.regexp_extract(as_col(wkt), r"\(([^()]+)\)", 1)
    pairs = F.transform(F.split(ring, ","), lambda p: F.split(F.trim(p), r"\s+"))
    return F.transform(F.filter(pairs, lambda p: F.size(p) == 2),
                       lambda p: F.array(p[1].try_cast("double"), p[0].try_cast("double")))
