"""The paired table: one row for each land pixel and day, with the temperature of its coarse cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as E
from .calendar import align
from .grid import assign_cells, axis, cell_keys, grouped, pixel_keys


def assignment(fine: DataFrame, coarse: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Each pixel of fine with its coarse cell; with a mask, land pixels only."""
    pixels = fine.select("lat_ix", "lon_ix", "era5_lat", "era5_lon").distinct()
    if mask is not None:
        pixels = pixels.join(mask.filter("is_land").select("lat_ix", "lon_ix"), ["lat_ix", "lon_ix"], "left_semi")
    return assign_cells(pixels, axis(coarse, "clat_ix", "cmip_lat"), axis(coarse, "clon_ix", "cmip_lon"))


def _assigned(fine: DataFrame, coarse: DataFrame, mask: DataFrame | None, axes: tuple[list[float], list[float]] | None) -> DataFrame:
    """Rows of fine with a value and a day, with their coarse cell."""
    lats, lons = axes or (axis(coarse, "clat_ix", "cmip_lat"), axis(coarse, "clon_ix", "cmip_lon"))
    rows = fine.filter("t2m is not null and day is not null")
    if mask is not None:
        rows = rows.join(mask.filter("is_land").select("lat_ix", "lon_ix"), ["lat_ix", "lon_ix"], "left_semi")
    return assign_cells(rows, lats, lons)


def paired(fine: DataFrame, coarse: DataFrame, mask: DataFrame | None = None, axes: tuple[list[float], list[float]] | None = None) -> DataFrame:
    """Rows of fine with a value on shared days, with cell and tas of the nearest cell; NULL tas stays.

    The cell of a pixel is a function of its coordinates, so no assignment is joined: rows get their cell
    where they are scanned, and are shuffled once, by cell and day, to meet the coarse rows. A mask that was
    made from the same table needs no join either, as rows without a value go anyway; another one is joined.
    The inner join on the day also does the calendar alignment. If coarse has a column model, each row is paired
    with every model that has the cell and day.
    """
    models = [c for c in ("model",) if c in coarse.columns]
    out = _assigned(fine, coarse, mask, axes).join(coarse.select("clat_ix", "clon_ix", "day", "tas", *models), ["clat_ix", "clon_ix", "day"], "inner")
    return out.select("lat_ix", "lon_ix", "clat_ix", "clon_ix", "era5_lat", "era5_lon", "cmip_lat", "cmip_lon", "day", "t2m", "tas", *models)


def folded_pairs(fine: DataFrame, coarse: DataFrame, mask: DataFrame | None = None, axes: tuple[list[float], list[float]] | None = None, spread: bool = False) -> DataFrame:
    """The pairs' finite t2m folded to (cell, day): tas, n, total, square, low and high; with spread also mean and the squared deviations from it.

    All pixels of a cell share its tas, so what a fit or an extent needs of the pairs follows from these rows, of
    which there are as many as coarse rows. They are folded before they meet the coarse record.
    """
    y = F.col("t2m")
    rows = _assigned(fine, coarse, mask, axes).filter(E.is_finite(y))
    more = [F.avg(y).alias("mean"), (F.var_pop(y) * F.count("*")).alias("spread")] if spread else []
    sums = grouped(rows, ["clat_ix", "clon_ix", "day"], ("cmip_lat", "cmip_lon"), F.count("*").alias("n"), F.sum(y).alias("total"), F.sum(y * y).alias("square"), F.min(y).alias("low"), F.max(y).alias("high"), *more)
    models = [c for c in ("model",) if c in coarse.columns]
    return sums.join(coarse.select("clat_ix", "clon_ix", "day", "tas", *models), ["clat_ix", "clon_ix", "day"])


def paired_values(fine: DataFrame, keys: DataFrame, axes: tuple[list[float], list[float]]) -> DataFrame:
    """t2m of the rows of fine whose cell and day are in keys (folded_pairs(), say): what paired() has, without the rest."""
    rows = _assigned(fine, fine, None, axes).select("clat_ix", "clon_ix", "day", "t2m")
    return rows.join(keys.select("clat_ix", "clon_ix", "day"), ["clat_ix", "clon_ix", "day"], "left_semi").select("t2m")


def aligned_paired(fine: DataFrame, coarse: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """The same after an explicit alignment of both calendars."""
    a, b, _ = align(fine, coarse)
    return paired(a, b, mask)


def with_distance(pairs: DataFrame, distances: DataFrame) -> DataFrame:
    """Pairs with dist_deg of their pixel, NULL where a pixel has none."""
    keys = pixel_keys(pairs, distances)
    return pairs.join(distances.select(*keys, "dist_deg"), keys, "left")


def means_of_folded(folded: DataFrame) -> DataFrame:
    """cell_day_means() from folded_pairs()."""
    return folded.filter("tas is not null").select(*cell_keys(folded), "cmip_lat", "cmip_lon", "day", "tas", (F.col("total") / F.col("n")).alias("t2m_mean"))


def cell_day_means(pairs: DataFrame) -> DataFrame:
    """Mean t2m for each cell, day and tas; rows with a NULL key are left out."""
    keys = [*cell_keys(pairs), "day", "tas"]
    return grouped(pairs.dropna(subset=keys), keys, ("cmip_lat", "cmip_lon"), F.avg("t2m").alias("t2m_mean"))
