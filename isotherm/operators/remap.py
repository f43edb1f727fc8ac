"""Conservative remapping between two rectilinear grids on the sphere, with axes as uneven as they like.

A cell reaches from midpoint to midpoint of its axis. Which cells overlap is found on each axis by itself: the edges of
both axes are sorted together, and each stretch between two edges lies in one cell of either axis, so overlaps are
read off one pass over the sorted edges, without a pair of cells that don't touch. Latitudes are measured by the sine, as
areas on a sphere are; longitudes by degrees, and a cell that passes the date line is two stretches. The field is
folded latitude by latitude first, then longitude by longitude.

The integral over the target is that over the part of the source it covers; cells without a value have no area.

Defined cases: an axis needs two lines for its cells to have a size, else edges must be given; cells that touch in a
point only don't overlap; latitudes beyond a pole are cut there; longitudes count modulo 360, and cells of one axis must
not overlap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import MAX_AXIS

#: Shorter stretches (in sines, or degrees) come from rounding of edges that are meant to be equal.
LEAST = 1e-12


def edges_of(centres: Sequence[float]) -> list[float]:
    """Midpoints between centres in their order, and outer edges half an end spacing away."""
    mids = [(a + b) / 2 for a, b in zip(centres, centres[1:])]
    return [centres[0] - (mids[0] - centres[0]), *mids, centres[-1] + (centres[-1] - mids[-1])]


def intervals(spark: SparkSession, edges: Sequence[float], latitude: bool) -> DataFrame:
    """(ix, lo, hi) of the cells between consecutive edges, within the poles or within [-180, 180)."""
    if len(edges) > MAX_AXIS:
        raise ValueError(f"an axis has more than {MAX_AXIS} lines")
    rows: list[tuple[int, float, float]] = []
    for ix, (a, b) in enumerate(zip(edges, edges[1:])):
        lo, hi = float(min(a, b)), float(max(a, b))
        if latitude:
            rows.append((ix, max(-90.0, lo), min(90.0, hi)))
            continue
        start = (lo + 180.0) % 360.0 - 180.0
        end = start + min(360.0, hi - lo)
        rows += [(ix, start, min(end, 180.0))] + ([(ix, -180.0, end - 360.0)] if end > 180.0 else [])
    return spark.createDataFrame([r for r in rows if r[2] > r[1]], "ix int, lo double, hi double")


def overlaps(source: DataFrame, target: DataFrame, measure) -> DataFrame:
    """(source, target, w): the measure of what each two intervals share; both are axes, so the pass is short."""
    mark = lambda df, side: df.select(F.inline(F.array(F.struct(F.col("lo").alias("x"), F.lit(side).alias("side"), F.struct("ix", "hi").alias("cell")), F.struct(F.col("hi").alias("x"), F.lit(side).alias("side"), F.lit(None).cast("struct<ix:int,hi:double>").alias("cell")))))
    marks = mark(source, "s").unionByName(mark(target, "t"))
    upto = Window.orderBy("x", "side", "cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # What lies after a mark: the cell that its side began last, unless that has ended.
    cell = lambda side: F.last(F.when(F.col("side") == side, F.col("cell")), ignorenulls=True).over(upto)
    rows = marks.select("x", "side", "cell", cell("s").alias("s"), cell("t").alias("t"), F.lead("x").over(Window.orderBy("x", "side", "cell")).alias("next"))
    held = (F.col("x") < F.col("s.hi")) & (F.col("x") < F.col("t.hi"))
    after = rows.filter(held).select("x", "next", F.col("s.ix").alias("source"), F.col("t.ix").alias("target"))
    shared = after.groupBy("source", "target").agg(F.sum(measure(F.col("next")) - measure(F.col("x"))).alias("w"))
    return shared.filter(F.col("w") > LEAST)


def _sine(lat: Column) -> Column:
    return F.sin(F.radians(lat))


def weights(spark: SparkSession, source: tuple[Sequence[float], Sequence[float]], target: tuple[Sequence[float], Sequence[float]]) -> tuple[DataFrame, DataFrame]:
    """Overlaps of latitudes (in sines) and longitudes (in degrees); source and target: edges of latitudes and longitudes."""
    lat = overlaps(intervals(spark, source[0], True), intervals(spark, target[0], True), _sine)
    lon = overlaps(intervals(spark, source[1], False), intervals(spark, target[1], False), lambda x: x)
    return lat.select(F.col("source").alias("clat_ix"), F.col("target").alias("lat_ix"), "w"), lon.select(F.col("source").alias("clon_ix"), F.col("target").alias("lon_ix"), "w")


def remapped(field: DataFrame, value: str, lat_weights: DataFrame, lon_weights: DataFrame, by: Sequence[str] = ("day",)) -> DataFrame:
    """(lat_ix, lon_ix, by..., value, area): means over what each target cell covers of the source (clat_ix, clon_ix).

    Weights are axis tables and are broadcast. Rows grow by the overlaps of one axis at a time, and are folded in between.
    """
    known = field.filter(F.col(value).isNotNull()).select("clat_ix", "clon_ix", *by, F.col(value).cast("double").alias("v"))
    rows = known.join(F.broadcast(lat_weights), "clat_ix").groupBy("lat_ix", "clon_ix", *by).agg(F.sum(F.col("w") * F.col("v")).alias("v"), F.sum("w").alias("a"))
    out = rows.join(F.broadcast(lon_weights), "clon_ix").groupBy("lat_ix", "lon_ix", *by).agg(F.sum(F.col("w") * F.col("v")).alias("v"), F.sum(F.col("w") * F.col("a")).alias("area"))
    return out.select("lat_ix", "lon_ix", *by, (F.col("v") / F.col("area")).alias(value), "area")
