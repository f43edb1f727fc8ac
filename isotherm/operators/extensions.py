"""Analyses that go beyond the study's own: per-cell fits, lags, neighbours, skill, autocorrelation, interpolation."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from .grid import cell_keys, grouped, pixel_keys
from .ranks import ranked
from .regression import fit


def fit_by_cell(pairs: DataFrame) -> DataFrame:
    keys = cell_keys(pairs)
    return fit(pairs, keys=(*dict.fromkeys((*keys, "cmip_lat", "cmip_lon")),))


def lagged(coarse: DataFrame) -> DataFrame:
    """Adds tas of the day before and after; NULL where that very day isn't there."""
    w = Window.partitionBy("clat_ix", "clon_ix").orderBy("day")
    near = lambda f, gap: F.when(F.datediff(f("day", 1).over(w), "day") == gap, f("tas", 1).over(w))
    return coarse.withColumns({"tas_before": near(F.lag, -1), "tas_after": near(F.lead, 1)})


def neighbour_mean(coarse: DataFrame) -> DataFrame:
    """Adds the mean tas of the up to four neighbour cells of the same day, by index; NULL without any."""
    moved = coarse.select("day", "tas", F.explode(F.array(*(F.struct((F.col("clat_ix") + i).alias("clat_ix"), (F.col("clon_ix") + j).alias("clon_ix")) for i, j in ((0, 1), (0, -1), (1, 0), (-1, 0))))).alias("at"))
    means = moved.groupBy("at.clat_ix", "at.clon_ix", "day").agg(F.avg("tas").alias("tas_neighbours"))
    return coarse.join(means, ["clat_ix", "clon_ix", "day"], "left")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(day, difference) of two daily series on shared days."""
    return a.select("day", F.col("value").alias("a")).join(b.select("day", F.col("value").alias("b")), "day").select("day", (F.col("a") - F.col("b")).alias("difference"))


def serial_correlation(series: DataFrame, lags: Sequence[int] = (1,)) -> DataFrame:
    """(label, durbin_watson, acf_<lag>...) of a series by order of day; a series is one label's, and short."""
    w = Window.partitionBy("label").orderBy("day")
    mean = F.avg("value").over(Window.partitionBy("label"))
    e = series.withColumn("e", F.col("value") - mean).withColumns({f"e_{k}": F.lag("e", k).over(w) for k in {1, *lags}})
    square = F.sum(F.col("e") * F.col("e"))
    return e.groupBy("label").agg(
        F.try_divide(F.sum(F.pow(F.col("e") - F.col("e_1"), F.lit(2))), square).alias("durbin_watson"), *(F.try_divide(F.sum(F.col("e") * F.col(f"e_{k}")), square).alias(f"acf_{k}") for k in lags)
    )


def skill(pairs: DataFrame) -> DataFrame:
    """Per pixel: n, bias, RMSE and correlation of tas against t2m; the last is NULL where one of them is constant."""
    gap = F.col("tas") - F.col("t2m")
    v = pairs.filter(E.is_finite(F.col("tas")) & E.is_finite(F.col("t2m")))
    return grouped(v, pixel_keys(pairs), ("era5_lat", "era5_lon"), F.count("*").alias("n"), F.avg(gap).alias("bias"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.try_divide(F.covar_pop("t2m", "tas"), F.stddev_pop("t2m") * F.stddev_pop("tas")).alias("correlation"))


def partial_autocorrelation(series: DataFrame, most: int = 3) -> DataFrame:
    """(label, pacf_1, ...) of a daily series up to a lag, from its autocorrelations by the Durbin-Levinson recursion."""
    lags = range(1, most + 1)
    out = serial_correlation(series, tuple(lags)).drop("durbin_watson")
    r, before, columns = {k: F.col(f"acf_{k}") for k in lags}, [], []
    for k in lags:
        above = functools.reduce(lambda a, b: a - b, (p * r[k - j - 1] for j, p in enumerate(before)), r[k])
        below = functools.reduce(lambda a, b: a - b, (p * r[j + 1] for j, p in enumerate(before)), F.lit(1.0))
        last = F.try_divide(above, below)
        out = out.withColumns({f"phi_{k}_{j}": p - last * before[k - 2 - j] for j, p in enumerate(before)} | {f"phi_{k}_{k - 1}": last})
        before = [F.col(f"phi_{k}_{j}") for j in range(k)]
        columns.append(before[-1].alias(f"pacf_{k}"))
    return out.select("label", *columns)


def _normal_cdf(z: Column) -> Column:
    """The standard normal distribution function, by a rational approximation of the error function (error below 1.5e-7)."""
    # The coefficients of that approximation.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / math.sqrt(2)
    t = 1.0 / (1.0 + p * x)
    tail = functools.reduce(lambda acc, c: (acc + c) * t, reversed(a), F.lit(0.0)) * F.exp(-x * x) / 2
    return F.when(z < 0, tail).otherwise(1.0 - tail)


def normality(df: DataFrame, value: str) -> DataFrame:
    """(n, d, p): Kolmogorov-Smirnov distance of a column from the normal distribution with its mean and SD.

    p is the limit distribution's, which takes mean and SD as known. Ranks are exact and global; no task ranks all rows,
    and equal values are spread over tasks (see ``ranks``).
    """
    rows = df.filter(E.is_finite(F.col(value))).select(F.col(value).cast("double").alias("v"))
    order = ranked(rows, "v")
    one = order.agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.count("*").alias("n")).filter("sd > 0")
    cdf = _normal_cdf((F.col("v") - F.col("mean")) / F.col("sd"))
    d = F.max(F.greatest(F.col("rank") / F.col("n") - cdf, cdf - (F.col("rank") - 1) / F.col("n")))
    out = order.crossJoin(F.broadcast(one)).agg(F.first("n").alias("n"), d.alias("d")).filter("n is not null")
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * F.col("n") * F.col("d") * F.col("d")))
    p = F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
    return out.select("n", "d", F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)).alias("p"))


def random_intercept(resid: DataFrame) -> DataFrame:
    """(n, n_cells, var_cell, var_error, icc): variance of residuals between and within cells, by analysis of variance.

    A cell's own intercept is random, the slope common; a negative estimate of its variance is 0.
    """
    cells = resid.groupBy(*cell_keys(resid)).agg(F.count("residual").alias("m"), F.avg("residual").alias("mean"), F.var_pop("residual").alias("var")).filter("m > 0")
    s = cells.agg(F.sum("m").alias("n"), F.count("*").alias("k"), F.sum(F.col("m") * F.col("var")).alias("within"), F.sum(F.col("m") * F.col("m")).alias("squares"), F.sum(F.col("m") * F.col("mean")).alias("total"), F.sum(F.col("m") * F.col("mean") * F.col("mean")).alias("between"))
    n, k = F.col("n"), F.col("k")
    error = F.try_divide(F.col("within"), n - k)
    spread = F.try_divide(F.col("between") - F.col("total") * F.col("total") / n, k - 1)
    size = F.try_divide(n - F.try_divide(F.col("squares"), n), k - 1)
    cell = F.greatest(F.lit(0.0), F.try_divide(spread - error, size))
    return s.select("n", k.alias("n_cells"), cell.alias("var_cell"), error.alias("var_error"), F.try_divide(cell, cell + error).alias("icc"))


def with_split(pairs: DataFrame, train_until: int, validate_until: int) -> DataFrame:
    """Adds day_of_year and split (train, validation, test) by year."""
    y = F.year("day")
    return pairs.withColumns({"day_of_year": F.dayofyear("day"), "split": F.when(y <= train_until, "train").when(y <= validate_until, "validation").otherwise("test")})


def with_daily_predictor(pairs: DataFrame, daily: DataFrame, name: str = "global_mean_tas") -> DataFrame:
    """Adds a daily series as a column; a row a day, so the planner broadcasts it."""
    return pairs.join(daily.select("day", F.col("value").alias(name)), "day", "left")


def bilinear(pixels: DataFrame, coarse: DataFrame, lats: list[float], lons: list[float], by: str = "day") -> DataFrame:
    """(lat_ix, lon_ix, day, tas) at pixels inside the coarse axes: weights of the four corners around.

    A pixel gets a row a day (or other key) for which all corners of positive weight have a value. Axes ascend.
    """

    def bracket(value, axis):
        n = len(axis)
        array = F.array(*(F.lit(float(a)) for a in axis))
        low = F.least(F.size(F.filter(array, lambda a: a <= value)) - 1, F.lit(n - 2))
        a, b = F.element_at(array, low + 1), F.element_at(array, low + 2)
        return low, (value - a) / (b - a), (value >= axis[0]) & (value <= axis[-1])

    i, u, in_lat = bracket(F.col("era5_lat"), lats)
    j, v, in_lon = bracket(F.col("era5_lon"), lons)
    p = pixels.filter(in_lat & in_lon).select("lat_ix", "lon_ix", i.alias("i"), u.alias("u"), j.alias("j"), v.alias("v"))
    corner = lambda di, dj, w: F.struct((F.col("i") + di).alias("clat_ix"), (F.col("j") + dj).alias("clon_ix"), w.alias("w"))
    one = F.lit(1.0)
    corners = F.array(corner(0, 0, (one - F.col("u")) * (one - F.col("v"))), corner(0, 1, (one - F.col("u")) * F.col("v")), corner(1, 0, F.col("u") * (one - F.col("v"))), corner(1, 1, F.col("u") * F.col("v")))
    wanted = p.select("lat_ix", "lon_ix", F.inline(corners)).filter("w > 0")
    out = wanted.join(coarse.select("clat_ix", "clon_ix", by, "tas"), ["clat_ix", "clon_ix"]).filter("tas is not null")
    sums = out.groupBy("lat_ix", "lon_ix", by).agg(F.sum(F.col("w") * F.col("tas")).alias("tas"), F.sum("w").alias("w"))
    return sums.filter("w > 0.999999").select("lat_ix", "lon_ix", by, "tas")


def _overlaps(df: DataFrame, coord: str, half: float, centres: list[float], ix: str, weight: str) -> DataFrame:
    """A row for each coarse line whose cell (midpoint to midpoint) overlaps the pixel's side, with the length."""
    mids = [(a + b) / 2 for a, b in zip(centres, centres[1:])]
    edges = [centres[0] - (centres[1] - centres[0]) / 2, *mids, centres[-1] + (centres[-1] - centres[-2]) / 2]
    cells = F.array(*(F.struct(F.lit(k).alias(ix), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(zip(edges, edges[1:]))))
    length = lambda c: F.least(c["b"], F.col(coord) + half) - F.greatest(c["a"], F.col(coord) - half)
    found = F.transform(F.filter(cells, lambda c: length(c) > 1e-9), lambda c: F.struct(c[ix].alias(ix), length(c).alias(weight)))
    return df.select("*", F.inline(found))


def area_weighted(pixels: DataFrame, coarse: DataFrame, lats: list[float], lons: list[float], step: float, by: str = "day") -> DataFrame:
    """(lat_ix, lon_ix, day, tas): mean of the coarse cells under each pixel, by the area they share.

    Areas in degrees; the overlap is found on each axis by itself. Cells without a value have no weight.
    """
    both = _overlaps(_overlaps(pixels.select("lat_ix", "lon_ix", "era5_lat", "era5_lon"), "era5_lat", step / 2, lats, "clat_ix", "wa"), "era5_lon", step / 2, lons, "clon_ix", "wo")
    joined = both.join(coarse.select("clat_ix", "clon_ix", by, "tas"), ["clat_ix", "clon_ix"]).filter("tas is not null")
    w = F.col("wa") * F.col("wo")
    return joined.groupBy("lat_ix", "lon_ix", by).agg((F.sum(w * F.col("tas")) / F.sum(w)).alias("tas"))


def morans_i(field: DataFrame, value: str) -> DataFrame:
    """(n, morans_i) of a field on a grid (lat_ix, lon_ix), neighbours being cells that share a side."""
    centred = field.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(field.agg(F.avg(value).alias("mean")))).select("lat_ix", "lon_ix", (F.col(value) - F.col("mean")).alias("e"))
    moved = centred.select(F.col("e").alias("near"), F.inline(F.array(*(F.struct((F.col("lat_ix") + i).alias("lat_ix"), (F.col("lon_ix") + j).alias("lon_ix")) for i, j in ((0, 1), (0, -1), (1, 0), (-1, 0))))))
    links = centred.join(moved, ["lat_ix", "lon_ix"]).agg(F.count("*").alias("w"), F.sum(F.col("e") * F.col("near")).alias("cross"))
    whole = centred.agg(F.count("*").alias("n"), F.sum(F.col("e") * F.col("e")).alias("square"))
    return whole.crossJoin(links).select("n", F.try_divide(F.col("n") * F.col("cross"), F.col("w") * F.col("square")).alias("morans_i"))


def multiple_regression(df: DataFrame, y: str, predictors: dict[str, Column]) -> DataFrame:
    """(term, coefficient) of least squares with an intercept on any column expressions, say an interaction.

    Means and covariances are one aggregate's; the small system is solved on the driver.
    """
    import numpy as np

    columns = [*(f"x_{k}" for k in range(len(predictors))), "y"]
    x = df.select(*(c.cast("double").alias(n) for n, c in zip(columns, [*predictors.values(), F.col(y)])))
    clean = x.filter(" and ".join(f"{c} is not null and not isnan({c})" for c in columns))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = clean.agg(*(F.avg(c).alias(c) for c in columns), *(F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in pairs)).first()
    n = len(predictors)
    m = np.array([[sums[f"x_{min(i, j)}_x_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
    slopes = np.linalg.lstsq(m, np.array([sums[f"x_{i}_y"] or 0.0 for i in range(n)]), rcond=None)[0]
    intercept = (sums["y"] or 0.0) - sum(b * (sums[f"x_{i}"] or 0.0) for i, b in enumerate(slopes))
    return df.sparkSession.createDataFrame([("intercept", float(intercept)), *((k, float(v)) for k, v in zip(predictors, slopes))], "term string, coefficient double")


def height(geopotential):
    """Metres from m2/s2."""
    return geopotential / 9.80665
