"""Least squares: global and grouped fits, residuals, trends with confidence bands, binned residuals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..schema import CONFIDENCE_PERCENT, DISTANCE_EDGES, RESIDUAL_BINS
from .grid import cell_keys, grouped, pixel_keys
from .stats import box_statistics

_ROW = ("lat_ix", "lon_ix", "clat_ix", "clon_ix", "era5_lat", "era5_lon", "cmip_lat", "cmip_lon", "day", "model")


def _valid(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.filter(E.is_finite(F.col(x)) & E.is_finite(F.col(y)))


def fit(df: DataFrame, x: str = "tas", y: str = "t2m", keys: Sequence[str] = ()) -> DataFrame:
    """slope, intercept, r and n over finite pairs, one row, or one for each key."""
    v = _valid(df, x, y)
    aggregates = [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r"), F.count("*").alias("n")]
    return v.groupBy(*keys).agg(*aggregates) if keys else v.agg(*aggregates)


def fit_with_sd(pairs: DataFrame) -> DataFrame:
    """slope, intercept and sd over finite pairs, one row.

    Residuals of a fit with an intercept have mean 0, so their sample SD follows from the sums of the fit.
    """
    sse = F.greatest(F.lit(0.0), F.regr_syy("t2m", "tas") - F.pow(F.regr_sxy("t2m", "tas"), F.lit(2)) / F.regr_sxx("t2m", "tas"))
    return _valid(pairs, "tas", "t2m").agg(F.regr_slope("t2m", "tas").alias("slope"), F.regr_intercept("t2m", "tas").alias("intercept"), F.sqrt(F.try_divide(sse, F.count("*") - 1)).alias("sd"))


def fit_folded(folded: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The same from folded_pairs(), with r and n: the pairs themselves aren't built for it.

    Sums are taken around a value near the means (the first of the table), so that little is lost by subtraction.
    """
    f = folded.filter(E.is_finite(F.col("tas")))
    near = f.agg(F.first("tas").alias("x0"), F.first(F.col("total") / F.col("n")).alias("y0"))
    x, n = F.col("tas") - F.col("x0"), F.col("n")
    y, yy = F.col("total") - n * F.col("y0"), F.col("square") - 2 * F.col("y0") * F.col("total") + n * F.col("y0") * F.col("y0")
    sums = [F.sum(n).alias("n"), F.sum(n * x).alias("x"), F.sum(y).alias("y"), F.sum(n * x * x).alias("xx"), F.sum(x * y).alias("xy"), F.sum(yy).alias("yy"), F.first("x0").alias("x0"), F.first("y0").alias("y0")]
    both = f.crossJoin(F.broadcast(near))
    s = both.groupBy(*keys).agg(*sums) if keys else both.agg(*sums)
    c = {k: F.col(k) for k in ("n", "x", "y", "xx", "xy", "yy", "x0", "y0")}
    sxx, sxy, syy = c["xx"] - c["x"] * c["x"] / c["n"], c["xy"] - c["x"] * c["y"] / c["n"], c["yy"] - c["y"] * c["y"] / c["n"]
    slope = F.try_divide(sxy, sxx)
    sse = F.greatest(F.lit(0.0), syy - F.try_divide(sxy * sxy, sxx))
    intercept = c["y0"] + c["y"] / c["n"] - slope * (c["x0"] + c["x"] / c["n"])
    return s.select(*keys, slope.alias("slope"), intercept.alias("intercept"), F.try_divide(sxy, F.sqrt(sxx * syy)).alias("r"), F.sqrt(F.try_divide(sse, c["n"] - 1)).alias("sd"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _rows(df: DataFrame) -> list[str]:
    return [c for c in _ROW if c in df.columns]


def residuals(pairs: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """Keys, day and residual of each finite pair, from one global fit (one row, broadcast)."""
    v = _valid(pairs, "tas", "t2m")
    with_fit = v.crossJoin(F.broadcast((model if model is not None else fit(pairs)).select("slope", "intercept")))
    return with_fit.select(*_rows(pairs), (F.col("t2m") - (F.col("slope") * F.col("tas") + F.col("intercept"))).alias("residual"))


def standardized_residuals(pairs: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """residuals() with std_residual; model: slope, intercept and sd, in one row."""
    v = _valid(pairs, "tas", "t2m")
    model = (model if model is not None else fit_with_sd(pairs)).select("slope", "intercept", "sd")
    residual = F.col("t2m") - (F.col("slope") * F.col("tas") + F.col("intercept"))
    return v.crossJoin(F.broadcast(model)).select(*_rows(pairs), residual.alias("residual"), F.try_divide(residual, F.col("sd")).alias("std_residual"))


def standardized(resid: DataFrame) -> DataFrame:
    """residual over its sample SD of all rows; not centred."""
    sd = resid.agg(F.stddev_samp("residual").alias("sd"))
    return resid.crossJoin(F.broadcast(sd)).withColumn("std_residual", F.try_divide(F.col("residual"), F.col("sd"))).drop("sd")


def mean_standardized(pairs: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """Pixels with mean_std_residual."""
    return grouped(standardized_residuals(pairs, model), pixel_keys(pairs), ("era5_lat", "era5_lon"), F.avg("std_residual").alias("mean_std_residual"))


def trends(series: DataFrame, dates: Sequence[str]) -> DataFrame:
    """(label, date, n, slope, intercept): value on a fixed date against 0, 1, 2, ... by year; n of 2 at least."""
    rows = indexed(series, dates)
    out = rows.groupBy("label", "date").agg(F.count("value").alias("n"), F.regr_slope("value", "x").alias("slope"), F.regr_intercept("value", "x").alias("intercept"))
    return out.filter("n >= 2")


def indexed(series: DataFrame, dates: Sequence[str]) -> DataFrame:
    """Rows on the fixed dates with x, their place by day within label and date."""
    on = series.select("label", "day", "value", E.month_day(F.col("day")).alias("date")).filter(F.col("date").isin(*dates))
    return on.withColumn("x", (F.row_number().over(Window.partitionBy("label", "date").orderBy("day")) - 1).cast("double"))


def trend_band(spark: SparkSession, series: DataFrame, dates: Sequence[str], percent: float = CONFIDENCE_PERCENT) -> DataFrame:
    """(label, date, day, fit, lo, hi): the line and the band of its mean response; n of 3 at least.

    Quantiles of Student's t come from a small table, one row for each number of years that occurs.
    """
    rows = indexed(series, dates)
    v, x = F.col("value"), F.col("x")
    model = rows.groupBy("label", "date").agg(
        F.count(v).alias("n"), F.regr_slope(v, x).alias("slope"), F.regr_intercept(v, x).alias("intercept"), F.regr_avgx(v, x).alias("mx"), F.regr_sxx(v, x).alias("sxx"),
        F.greatest(F.lit(0.0), F.regr_syy(v, x) - F.pow(F.regr_sxy(v, x), F.lit(2)) / F.regr_sxx(v, x)).alias("sse"),
    ).filter("n >= 3")
    most = rows.groupBy("label", "date").count().agg(F.max("count")).first()[0] or 0  # years of a record: a short table
    p = 1 - (1 - percent / 100) / 2
    t = spark.createDataFrame([(n, E.t_quantile(p, n - 2)) for n in range(3, most + 1)], "n long, t double")
    joined = rows.join(model, ["label", "date"]).join(F.broadcast(t), "n")
    line = F.col("slope") * x + F.col("intercept")
    se = F.sqrt(F.col("sse") / (F.col("n") - 2)) * F.sqrt(1 / F.col("n") + F.pow(x - F.col("mx"), F.lit(2)) / F.col("sxx"))
    return joined.select("label", "date", "day", line.alias("fit"), (line - F.col("t") * se).alias("lo"), (line + F.col("t") * se).alias("hi"))


def line_samples(df: DataFrame, x: str, y: str, points: int = 200) -> DataFrame:
    """(i, x, y): points of the fitted line between the extremes of x."""
    span = _valid(df, x, y).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    rows = span.crossJoin(fit(df, x, y)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.col("lo") + F.col("i") * ((F.col("hi") - F.col("lo")) / (points - 1))
    return rows.select("i", at.alias("x"), (F.col("slope") * at + F.col("intercept")).alias("y"))


def residuals_by_distance(pairs: DataFrame, edges: int = DISTANCE_EDGES, model: DataFrame | None = None) -> DataFrame:
    """(bin, lo, hi, n, mean): mean residual over equal bins (a, b] of dist_deg; all bins, the lowest value in none.

    Over all rows; without a model the fit uses rows that have a distance, as only these are analysed.
    """
    rows = pairs.dropna(subset=["tas", "t2m", "dist_deg"])
    v = _valid(rows, "tas", "t2m").crossJoin(F.broadcast((model if model is not None else fit(rows)).select("slope", "intercept")))
    v = v.select("dist_deg", (F.col("t2m") - (F.col("slope") * F.col("tas") + F.col("intercept"))).alias("residual"))
    # Folded by distance first: it is a pixel's, so there are far fewer of them than rows.
    sums = v.groupBy("dist_deg").agg(F.count("*").alias("n"), F.sum("residual").alias("total"))
    low, high = F.col("low"), F.col("high")
    span = sums.agg(F.min("dist_deg").alias("low"), F.max("dist_deg").alias("high")).filter("low is not null")
    marks = F.transform(F.sequence(F.lit(0), F.lit(edges - 1)), lambda k: F.when(k == edges - 1, high).otherwise(low + k * ((high - low) / (edges - 1))))
    span = span.select(marks.alias("marks"))
    at = E.bin_cut(F.col("dist_deg"), F.col("marks"))
    got = sums.crossJoin(F.broadcast(span)).groupBy(at.alias("bin")).agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"))
    bins = span.select("marks", F.explode(F.sequence(F.lit(0), F.lit(edges - 2))).alias("bin")).select("bin", F.get("marks", F.col("bin")).alias("lo"), F.get("marks", F.col("bin") + 1).alias("hi"))
    return bins.join(got, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "mean")


def bin_list(spark: SparkSession, edges: Sequence[float]) -> DataFrame:
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, lo double, hi double")


def residuals_by_cell_bin(resid: DataFrame, stats: DataFrame, column: str, edges: Sequence[float]) -> DataFrame:
    """Box statistics of residuals by bin of a cell statistic, with n_cells that have residuals; all bins.

    Cells without a finite statistic are left out. Bins are (a, b] and take in what is outside.
    """
    keys = cell_keys(resid, stats)
    cells = stats.filter(E.is_finite(F.col(column))).select(*keys, E.bin_left(F.col(column).cast("double"), edges).alias("bin"))
    rows = resid.select(*keys, "residual").join(cells, keys).select(*keys, "bin", "residual")
    out = bin_list(resid.sparkSession, edges).join(box_statistics(rows, ["bin"], "residual", [E.distinct_few(*keys).alias("n_cells")], bound=len(edges)), "bin", "left")
    return out.select("bin", "lo", "hi", F.coalesce("n_cells", F.lit(0)).cast("long").alias("n_cells"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "q1", "median", "q3", "whisker_lo", "whisker_hi")


def sea_fraction_edges(bins: int = RESIDUAL_BINS) -> list[float]:
    return E.linspace(0.0, 1.0, bins + 1)


def pixel_count_edges(stats: DataFrame, bins: int = RESIDUAL_BINS) -> list[float]:
    """Quantiles of the cells' land pixels, the first one lowered by 1. A handful of numbers."""
    q = stats.agg(F.percentile("n_land_pixels", [k / bins for k in range(bins + 1)]).alias("q")).first()["q"] or [0.0] * (bins + 1)
    return [q[0] - 1, *q[1:]]
