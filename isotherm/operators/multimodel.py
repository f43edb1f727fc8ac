"""Several coarse models, each with a grid and a calendar of its own, beside one fine record.

Models whose axes are equal share a grid. An index of the axes, keyed by (grid, side), goes to all tasks as one row; a
fine row looks its cell up in it once for each grid, so no assignment of pixels is made or joined, and the
fine record is shuffled once for each different grid, not for each model. Days are decoded from each model's
count of days in its own calendar before anything is joined.

Defined cases: a day that the common calendar lacks (30 February of a calendar with months of 30 days) is NULL and pairs with
nothing; models without a row in the table of calendars are left out; a pixel without coordinates has no cell; of
lines with equal coordinates the lower index is meant; fine rows without a value or day are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..schema import MAX_AXIS
from .grid import grouped

#: Steps of the table of one axis, at most; an axis so uneven that it needs more is refused.
MAX_STEPS = 20_000
CELL = ["grid", "clat_ix", "clon_ix", "day"]


def decode_days(coarse: DataFrame, calendars: DataFrame) -> DataFrame:
    """coarse (model, time: days since 1 January of a year, ...) with day; calendars: (model, start_year, calendar).

    calendar is standard, noleap or 360_day. The table has one row a model and is broadcast.
    """
    if calendars.limit(MAX_AXIS + 1).count() > MAX_AXIS:
        raise ValueError(f"more than {MAX_AXIS} models")
    day = E.decode_day(F.col("start_year"), F.col("time"), F.col("calendar"))
    return coarse.join(F.broadcast(calendars), "model").withColumn("day", day).drop("start_year", "calendar", "time")


def _table(lines: list[tuple[int, float]]) -> tuple[float, float, list[int], list[float], list[int]]:
    """(first, step, near, coords, places) of an axis: near names, for each even step, the line nearest at its beginning."""
    first_of: dict[float, int] = {}
    for ix, coord in sorted(lines, reverse=True):
        first_of[coord] = ix
    coords = sorted(first_of)
    places = [first_of[c] for c in coords]
    if len(coords) == 1:
        return coords[0], 1.0, [0], coords, places
    step = min(b - a for a, b in zip(coords, coords[1:])) / 4
    n = math.ceil((coords[-1] - coords[0]) / step) + 1
    if n > MAX_STEPS:
        raise ValueError(f"an axis is too uneven: {n} steps")
    at, near = 0, []
    for k in range(n):
        x = coords[0] + (k - 1) * step
        while at + 2 < len(coords) and abs(coords[at + 1] - x) < abs(coords[at] - x):
            at += 1
        near.append(at)
    return coords[0], step, near, coords, places


_AXIS = "struct<first:double,step:double,near:array<int>,coords:array<double>,places:array<int>>"


def axis_index(coarse: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """One row with axes, array<struct<grid, lat, lon>>, and the grid of each model. Axes are short; long ones are refused."""
    lines = coarse.select("model", F.inline(F.array(F.struct(F.lit("lat").alias("side"), F.col("clat_ix").alias("ix"), F.col("cmip_lat").alias("coord")), F.struct(F.lit("lon").alias("side"), F.col("clon_ix").alias("ix"), F.col("cmip_lon").alias("coord"))))).distinct()
    rows = lines.filter("ix is not null and coord is not null").limit(10 * MAX_AXIS + 1).collect()
    if len(rows) > 10 * MAX_AXIS:
        raise ValueError(f"the axes of all models have more than {10 * MAX_AXIS} lines")
    axes: dict[str, dict[str, list[tuple[int, float]]]] = {}
    for r in rows:
        axes.setdefault(r["model"], {"lat": [], "lon": []})[r["side"]].append((r["ix"], float(r["coord"])))
    keys: dict[tuple, int] = {}
    of = {m: keys.setdefault((tuple(sorted(a["lat"])), tuple(sorted(a["lon"]))), len(keys)) for m, a in sorted(axes.items()) if a["lat"] and a["lon"]}
    index = [(g, _table(list(lat)), _table(list(lon))) for (lat, lon), g in keys.items()]
    return coarse.sparkSession.createDataFrame([(index,)], f"axes array<struct<grid:int,lat:{_AXIS},lon:{_AXIS}>>"), of


def _nearest(value: Column, axis: Column) -> Column:
    """Index of the line nearest to value, the lower index of equals; the step's line and the next one are compared."""
    near, coords, places = axis["near"], axis["coords"], axis["places"]
    cell = F.least(F.greatest(F.floor((value - axis["first"]) / axis["step"]), F.lit(0)), F.size(near) - 1).cast("int")
    low = F.get(near, cell)
    high = F.least(low + 1, F.size(coords) - 1)
    before, after = F.abs(value - F.get(coords, low)), F.abs(value - F.get(coords, high))
    first, second = F.get(places, low), F.get(places, high)
    return F.when(before < after, first).when(after < before, second).otherwise(F.least(first, second))


def assigned(fine: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of fine with a value and a day, once for each grid, with the cell of that grid."""
    rows = fine.filter("t2m is not null and day is not null and era5_lat is not null and era5_lon is not null").crossJoin(F.broadcast(index))
    cells = F.transform("axes", lambda a: F.struct(a["grid"].alias("grid"), _nearest(F.col("era5_lat"), a["lat"]).alias("clat_ix"), _nearest(F.col("era5_lon"), a["lon"]).alias("clon_ix")))
    return rows.select(*fine.columns, F.inline(cells))


def _gridded(coarse: DataFrame, of: dict[str, int]) -> DataFrame:
    known = coarse.sparkSession.createDataFrame(sorted(of.items()), "model string, grid int")
    return coarse.select("model", "clat_ix", "clon_ix", "cmip_lat", "cmip_lon", "day", "tas").join(F.broadcast(known), "model")


def paired(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """A row for each model, pixel and day that both have: pixel, cell of the model's own grid, t2m and tas."""
    index, of = axis_index(coarse)
    out = assigned(fine, index).join(_gridded(coarse, of), CELL)
    return out.select("model", "lat_ix", "lon_ix", "clat_ix", "clon_ix", "era5_lat", "era5_lon", "cmip_lat", "cmip_lon", "day", "t2m", "tas")


def folded(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """The same folded to (model, cell, day), for fits by model: n, total, square, low and high of t2m, and tas.

    Pixels are folded to the cells of each grid before they meet the models.
    """
    index, of = axis_index(coarse)
    y = F.col("t2m")
    rows = assigned(fine, index).filter(E.is_finite(y))
    sums = grouped(rows, CELL, (), F.count("*").alias("n"), F.sum(y).alias("total"), F.sum(y * y).alias("square"), F.min(y).alias("low"), F.max(y).alias("high"))
    return sums.join(_gridded(coarse, of), CELL)
