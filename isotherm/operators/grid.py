"""Geometry of grids: boxes, masks, the nearest coarse cell, cell edges, shares of land and sea."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..schema import MAX_AXIS, Region


def standardize_longitude(df: DataFrame, lon: str) -> DataFrame:
    """Into [-180, 180), only if some longitude of the table is above 180; decided once for the table."""
    high = df.agg(F.max(lon).alias("high")).first()["high"]
    return df.withColumn(lon, E.wrap_longitude(F.col(lon))) if high is not None and high > 180 else df


def subset_box(df: DataFrame, lat: str, lon: str, region: Region, pad_lat: float = 0.0, pad_lon: float = 0.0) -> DataFrame:
    """Rows in the padded box, bounds included. Plain comparisons of columns, so the scan can skip row groups."""
    return df.filter(F.col(lat).between(region.south - pad_lat, region.north + pad_lat) & F.col(lon).between(region.west - pad_lon, region.east + pad_lon))


def axis(df: DataFrame, ix: str, coord: str) -> list[float]:
    """Coordinates of a dense index axis in order, for literals. Axes are short; a long one is refused."""
    rows = df.select(ix, coord).distinct().limit(MAX_AXIS + 1).collect()
    if len(rows) > MAX_AXIS:
        raise ValueError(f"{coord} has more than {MAX_AXIS} values")
    by = {r[0]: r[1] for r in rows}
    return [by[k] for k in sorted(by)]


def axis_order(df: DataFrame, coord: str) -> DataFrame:
    """(pos, coord): distinct values of an axis in ascending order, from 0. An axis is short, whatever the table's size."""
    return df.filter(F.col(coord).isNotNull()).select(coord).distinct().select((F.row_number().over(Window.orderBy(coord)) - 1).alias("pos"), coord)


def axis_table(spark: SparkSession, coords: list[float], ix: str, coord: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(map(float, coords))), f"{ix} int, {coord} double")


def grid(lats: DataFrame, lons: DataFrame) -> DataFrame:
    """Every cell of two axes. Its size is that of the grid itself; no table with days is crossed."""
    return lats.crossJoin(F.broadcast(lons))


def cell_keys(*tables: DataFrame) -> list[str]:
    """What names a coarse cell in all of these tables: its indices, or its coordinates where a table has no more."""
    indexed = all({"clat_ix", "clon_ix"} <= set(t.columns) for t in tables)
    return ["clat_ix", "clon_ix"] if indexed else ["cmip_lat", "cmip_lon"]


def pixel_keys(*tables: DataFrame) -> list[str]:
    """The same for a fine pixel."""
    indexed = all({"lat_ix", "lon_ix"} <= set(t.columns) for t in tables)
    return ["lat_ix", "lon_ix"] if indexed else ["era5_lat", "era5_lon"]


def grouped(df: DataFrame, keys: list[str], coords: tuple[str, str], *aggregates: Column) -> DataFrame:
    """One row for each cell or pixel, named by keys, with its coordinates."""
    more = [F.min(c).alias(c) for c in coords if c not in keys and c in df.columns]
    return df.groupBy(*keys).agg(*more, *aggregates)


def land_mask(fine: DataFrame, value: str = "t2m") -> DataFrame:
    """(lat_ix, lon_ix, is_land): a pixel is land if it ever has a value."""
    return fine.groupBy("lat_ix", "lon_ix").agg((F.count(value) > 0).alias("is_land"))


def nearest_axis(fine: DataFrame, coord: str, coarse: list[float], ix: str, nearest: str) -> DataFrame:
    """Adds the index and coordinate of the nearest coarse line of one axis; ties go to the lower index.

    A function of one row, so neither a join nor a shuffle. A pixel without a coordinate gets -1, which no cell has: as
    the index is never NULL, a join on it adds no filter by which the scan would find the line a second time.
    """
    return fine.withColumn(ix, F.coalesce(E.nearest_index(F.col(coord), coarse), F.lit(-1))).withColumn(nearest, E.coordinate(F.col(ix), coarse))


def assign_cells(pixels: DataFrame, coarse_lats: list[float], coarse_lons: list[float]) -> DataFrame:
    """Pixels (era5_lat, era5_lon) with their coarse cell, nearest on each axis by itself."""
    return nearest_axis(nearest_axis(pixels, "era5_lat", coarse_lats, "clat_ix", "cmip_lat"), "era5_lon", coarse_lons, "clon_ix", "cmip_lon")


def nearest_point(axis_df: DataFrame, ix: str, coord: str, target: float) -> DataFrame:
    """The axis line nearest to a target, the lower index of equals."""
    return axis_df.agg(F.min_by(F.struct(ix, coord), F.struct(F.abs(F.col(coord) - target), F.col(ix))).alias("p")).select(f"p.{ix}", f"p.{coord}")


def pixel_counts(assignment: DataFrame) -> DataFrame:
    """Cells with n_pixels."""
    return grouped(assignment, cell_keys(assignment), ("cmip_lat", "cmip_lon"), F.count("*").alias("n_pixels"))


def pixel_count_stats(counts: DataFrame) -> DataFrame:
    """One row about pixels per cell; sample standard deviation, exact linear quantiles."""
    n = F.col("n_pixels")
    q = lambda p: F.percentile(n, p)
    return counts.agg(
        F.count("*").alias("n_cells"), F.sum(n).alias("n_land_pixels"), F.avg(n).alias("mean"), F.stddev_samp(n).alias("std"), F.min(n).alias("min"), q(0.25).alias("p25"), q(0.5).alias("median"),
        q(0.75).alias("p75"), q(0.9).alias("p90"), F.max(n).alias("max"),
    )


def sea_fraction(assigned_grid: DataFrame) -> DataFrame:
    """Per cell: grid points, land, sea and the share of sea. assigned_grid: every grid point, with is_land."""
    out = grouped(assigned_grid, cell_keys(assigned_grid), ("cmip_lat", "cmip_lon"), F.count("*").alias("n_total"), F.sum(F.col("is_land").cast("long")).alias("n_land"))
    return out.withColumn("n_sea", F.col("n_total") - F.col("n_land")).withColumn("sea_fraction", F.col("n_sea") / F.col("n_total"))


def cell_stats(sea: DataFrame, counts: DataFrame) -> DataFrame:
    """Sea fractions with the number of land pixels; 0 where a cell has none."""
    keys = cell_keys(sea, counts)
    joined = sea.join(counts.select(*keys, F.col("n_pixels").alias("n_land_pixels")), keys, "left")
    return joined.withColumn("n_land_pixels", F.coalesce("n_land_pixels", F.lit(0)).cast("int"))


def coastal_counts(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count_if(F.col("sea_fraction") > 0).alias("coastal"), F.count_if(F.col("sea_fraction") == 0).alias("inland"))


def cell_ids(assignment: DataFrame) -> DataFrame:
    """Assignment with cell_id, 0 up in order of latitude, then longitude.

    The rank is taken over the distinct cells (a few hundred rows, whatever the number of pixels) and joined.
    """
    keys = cell_keys(assignment)
    cells = grouped(assignment, keys, ("cmip_lat", "cmip_lon")) if "cmip_lat" not in keys else assignment.select(*keys).distinct()
    ids = cells.withColumn("cell_id", F.dense_rank().over(Window.orderBy("cmip_lat", "cmip_lon")) - 1)
    return assignment.join(ids.select(*keys, "cell_id"), keys)


def cell_edges(axis_df: DataFrame, coord: str) -> DataFrame:
    """(pos, edge): midpoints between sorted centres, and outer edges half an end spacing away.

    Needs two centres; with fewer there is no edge.
    """
    w = Window.orderBy(coord)
    c, before, after = F.col(coord), F.lag(coord).over(w), F.lead(coord).over(w)
    rows = axis_df.select(coord).distinct().select((F.row_number().over(w) - 1).alias("pos"), c.alias("c"), before.alias("b"), after.alias("a"), F.lead(coord, 1).over(w).isNull().alias("last"))
    first = F.when(F.col("b").isNull(), F.col("c") - (F.col("a") - F.col("c")) / 2).otherwise((F.col("b") + F.col("c")) / 2)
    lower = rows.select("pos", first.alias("edge"))
    upper = rows.filter("last").select((F.col("pos") + 1).alias("pos"), (F.col("c") + (F.col("c") - F.col("b")) / 2).alias("edge"))
    return lower.unionByName(upper).filter(F.col("edge").isNotNull())


def distance_to_center(assignment: DataFrame) -> DataFrame:
    return assignment.withColumn("dist_deg", E.distance_degrees(F.col("era5_lat"), F.col("era5_lon"), F.col("cmip_lat"), F.col("cmip_lon")))


def on_grid(cells: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Every cell of a grid, with NULL where the statistic has no row."""
    return cells.join(stats, keys, "left")


def pivot_counts(counts: DataFrame, lons: list[float]) -> DataFrame:
    """A row for each latitude, north first, a column for each longitude, 0 where there is no cell."""
    wide = counts.groupBy("cmip_lat").pivot("cmip_lon", lons).agg(F.sum("n_pixels"))
    names = [f"lon_{k}" for k in range(len(lons))]
    return wide.toDF("cmip_lat", *names).fillna(0, names).select("cmip_lat", *(F.col(n).cast("int").alias(n) for n in names)).orderBy(F.desc("cmip_lat"))
