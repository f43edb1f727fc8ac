"""Summaries: units, maps, daily series, distributions, box plots, hexagons."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..schema import COLOUR_LIMITS, HEX_COLUMNS, HISTOGRAM_EDGES, KELVIN, KELVIN_MEAN, PERCENTILES
from ..sources.grids import is_kelvin, units_of, with_units
from ..sources.tables import emptied, new_path, written


#: 1 / relative error of the ranks by which quantiles are narrowed down.
ACCURACY = 10_000
#: So many groups are sent to all tasks (some 400 bytes each); beyond it only those of many rows are.
FEW_GROUPS = 100_000


def same_keys(a: str, b: str, columns: Sequence[str]) -> Column:
    """Equal keys, NULL being a key like any other."""
    return functools.reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns))


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, bound: int | None, few: int = FEW_GROUPS) -> DataFrame:
    """rows joined to a table of one row a group, without moving the rows of a large group.

    bound: the most groups there can be, where that is known. Up to `few`, counted if need be, groups are broadcast.
    Beyond it those with more rows (column `size`) than 1 / few of all are, of which there are fewer than `few`, and only
    rows of the others, each a small part of the whole, are shuffled.
    """
    on = same_keys("r", "g", keys)
    if bound is not None and bound <= few:
        return rows.alias("r").join(F.broadcast(groups).alias("g"), on)
    groups = written(groups, "groups")
    seen = groups.agg(F.count("*").alias("n"), F.sum(size).alias("rows")).first()
    if seen["n"] <= few:
        return rows.alias("r").join(F.broadcast(groups).alias("g"), on)
    large = groups.filter(F.col(size) > seen["rows"] // few)
    names = F.broadcast(large.select(*keys))
    small = rows.alias("r").join(names.alias("g"), on, "left_anti")
    moved = small.alias("r").join(groups.filter(F.col(size) <= seen["rows"] // few).alias("g"), on)
    kept = rows.alias("r").join(F.broadcast(large).alias("g"), on)
    every = [*(f"r.{c}" for c in rows.columns), *(f"g.{c}" for c in groups.columns if c not in keys)]
    return kept.select(*every).unionByName(moved.select(*every)).alias("r")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: Sequence[float], levels: int = 1, accuracy: int = ACCURACY, bound: int | None = None) -> DataFrame:
    """(keys, n, q): exact quantiles with linear interpolation of each group's values, an array in the order asked for.

    No task holds a group and no row is moved to its group (see with_groups; bound is the most groups there can be). A
    mergeable sketch with a bounded error of ranks gives an interval around each wanted rank; values below it are counted,
    and only those in it, about 8 / accuracy of a group, are sorted, folded to distinct values with counts. At the
    default accuracy a task sorts 1 million of 10**9 rows; each further level divides that by about 1,000 again.
    Groups without a value have no row.
    """
    p = [float(x) for x in probabilities]
    names = [f"k_{k}" for k in range(len(keys))]
    rows = df.filter(F.col(value).isNotNull()).select(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.col(value).cast("double").alias("v"))
    if not keys:
        rows, names, bound = rows.withColumn("k_0", F.lit(0)), ["k_0"], 1
    gap = 4 / accuracy
    ends = [x for q in p for x in (max(0.0, q - gap), min(1.0, q + gap))]
    group = rows.groupBy(*names).agg(F.count("*").alias("n"), F.percentile_approx("v", ends, accuracy).alias("e"), F.min("v").alias("least"), F.max("v").alias("most"))
    # In groups of at most `accuracy` rows a rank is wider than the gap: they are taken whole.
    end = lambda n, of, k, side: F.when(n > accuracy, of[k]).otherwise(F.col(side))
    wanted = F.array(*(F.struct(F.lit(k).alias("i"), ((F.col("n") - 1) * q).alias("h"), end(F.col("n"), F.col("e"), 2 * k, "least").alias("lo"), end(F.col("n"), F.col("e"), 2 * k + 1, "most").alias("hi")) for k, q in enumerate(p)))
    asked = group.select(*names, "n", wanted.alias("w"))

    def narrowed(groups: DataFrame) -> DataFrame:
        """Each value once for each wanted rank of its group, unless it is above the rank's interval."""
        joined = with_groups(rows, groups, names, "n", bound)
        return joined.select(*(f"r.{c}" for c in names), "v", "n", F.inline(F.filter("w", lambda x: F.col("v") <= x["hi"])))

    for _ in range(levels - 1):
        near = narrowed(asked)
        counts = near.groupBy(*names, "i").agg(F.count_if(F.col("v") < F.col("lo")).alias("below"))
        within = near.filter(F.col("v") >= F.col("lo")).groupBy(*names, "i").agg(
            F.count("*").alias("m"), F.first("n").alias("n"), F.first("h").alias("h"), F.percentile_approx("v", [k / 1000 for k in range(1001)], accuracy).alias("e"), F.min("v").alias("least"), F.max("v").alias("most")
        )
        both = within.alias("w").join(counts.alias("c"), same_keys("w", "c", [*names, "i"]))
        share = (F.col("h") - F.col("below")) / F.greatest(F.col("m") - 1, F.lit(1))
        place = F.floor(share * 1000).cast("int")
        lower = F.when((F.col("m") > accuracy) & (place >= 6), F.get("e", place - 6)).otherwise(F.col("least"))
        upper = F.when((F.col("m") > accuracy) & (place <= 993), F.get("e", place + 7)).otherwise(F.col("most"))
        each = both.select(*(F.col(f"w.{c}") for c in names), "n", F.struct(F.col("w.i").alias("i"), "h", lower.alias("lo"), upper.alias("hi")).alias("s"))
        asked = each.groupBy(*names).agg(F.first("n").alias("n"), F.collect_list("s").alias("w"))  # a handful for each group
    near = narrowed(asked)
    counted = near.groupBy(*names, "i", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("x")).agg(F.count("*").alias("f"), F.first("h").alias("h"), F.first("n").alias("n"))
    # x is NULL: all that is below the interval, in one row.
    upto = F.sum("f").over(Window.partitionBy(*names, "i").orderBy(F.col("x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counted.withColumn("upto", upto)
    at = lambda r: F.max(F.when((F.col("upto") - F.col("f") <= r) & (r < F.col("upto")), F.col("x")))
    low, high = F.floor("h"), F.ceil("h")
    one = placed.groupBy(*names, "i").agg(F.first("n").alias("n"), F.first("h").alias("h"), at(low).alias("a"), at(high).alias("b"))
    part = F.col("h") - F.floor("h")
    value_ = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * (1 - part) + F.col("b") * part)
    lists = one.select(*names, "n", "i", value_.alias("q")).groupBy(*names).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "q"))).alias("s"))
    return lists.select(*(F.col(a).alias(b) for a, b in zip(names, keys)), "n", F.transform("s", lambda x: x["q"]).alias("q"))


def with_quantiles(one: DataFrame, df: DataFrame, value: str, probabilities: Sequence[float]) -> DataFrame:
    """A table of one row with q, exact quantiles of all of df; NULL if it has no value."""
    none = df.sparkSession.range(1).select(F.array().cast("array<double>").alias("q"))
    q = exact_quantiles(df, [], value, probabilities).select("q").unionByName(none).agg(F.max_by("q", F.size("q")).alias("q"))
    return one.crossJoin(F.broadcast(q))


def to_celsius(df: DataFrame, value: str, units: str | None = None, threshold: float = KELVIN_MEAN) -> DataFrame:
    """Minus 273.15 if the units are Kelvin or the mean of the whole table is over the threshold, else unchanged."""
    units = units if units is not None else units_of(df, value)
    if not is_kelvin(units):
        mean = df.agg(F.avg(value).alias("mean")).first()["mean"]
        if mean is None or mean <= threshold:
            return df
    return df.withColumn(value, with_units(F.col(value) - KELVIN, value, "°C"))


def temporal_mean(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"))


def seasonal_mean(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Pooled over all days of a season in all years."""
    return df.groupBy(E.season(F.col("day")).alias("season"), *keys).agg(F.avg(value).alias("mean"))


def daily(df: DataFrame, value: str, label: str) -> DataFrame:
    """(label, day, value): unweighted mean over cells."""
    return df.groupBy("day").agg(F.avg(value).alias("value")).select(F.lit(label).alias("label"), "day", "value")


def daily_spread(df: DataFrame, value: str) -> DataFrame:
    """(day, mean, sd, lo, hi, min, max) over cells; population standard deviation."""
    out = df.groupBy("day").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.select("day", "mean", "sd", (F.col("mean") - F.col("sd")).alias("lo"), (F.col("mean") + F.col("sd")).alias("hi"), "min", "max")


def weighted_daily_mean(df: DataFrame, value: str, lat: str) -> DataFrame:
    """(day, value): means weighted by the cosine of latitude; cells without a value have no weight."""
    w, v = E.area_weight(F.col(lat)), F.col(value)
    return df.groupBy("day").agg(F.try_divide(F.sum(w * v), F.sum(F.when(v.isNotNull(), w))).alias("value"))


def missing_by_day(df: DataFrame, value: str, n_cells: int) -> DataFrame:
    """(day, missing): share of the grid's cells without a value; cells without a row are missing too."""
    return df.groupBy("day").agg((1 - F.count(value) / n_cells).alias("missing"))


def missing_by_cell(df: DataFrame, keys: list[str], value: str, n_days: int) -> DataFrame:
    return df.groupBy(*keys).agg((1 - F.count(value) / n_days).alias("missing"))


def describe(df: DataFrame, value: str) -> DataFrame:
    """count, mean, sample SD, min, quartiles, max; exact."""
    v = F.col(value)
    one = df.agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).cast("double").alias("min"), F.max(v).cast("double").alias("max"))
    out, q = with_quantiles(one, df, value, [0.25, 0.5, 0.75]), lambda k: F.get("q", k)
    return out.select("count", "mean", "std", "min", q(0).alias("p25"), q(1).alias("p50"), q(2).alias("p75"), "max")


def main_statistics(df: DataFrame, value: str, label: str) -> DataFrame:
    """(dataset, metric, value): the report's metrics of one cube; population SD, linear quantiles."""
    v = F.col(value)
    one = df.agg(F.min(v).alias("min"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.max(v).alias("max"), E.distinct_few("day").cast("double").alias("days"), F.count(v).cast("double").alias("values"))
    one, q = with_quantiles(one, df, value, [p / 100 for p in PERCENTILES]), lambda k: F.get("q", k)
    cols = {"min": F.col("min"), "mean": F.col("mean"), "sd": F.col("sd"), "max": F.col("max"), "days": F.col("days"), "values": F.col("values"), "iqr": q(2) - q(0)}
    cols |= {f"p{p}": q(k) for k, p in enumerate(PERCENTILES)}
    pairs = F.array(*(F.struct(F.lit(k).alias("metric"), c.cast("double").alias("value")) for k, c in cols.items()))
    return one.select(F.lit(label).alias("dataset"), F.inline(pairs))


def main_report(fine: DataFrame, coarse: DataFrame, n_pixels: int) -> DataFrame:
    """(pos, metric, fine, coarse): the table of main statistics, with land pixels and the missing share.

    n_pixels: cells of the fine grid. The coarse record has no mask: all its cells count, none is missing.
    """
    order = ("min", "p25", "p50", "mean", "sd", "iqr", "p75", "p90", "max", "days", "land_pixels", "missing_fraction")
    side = lambda df, value, name: main_statistics(df, value, name).select("metric", F.col("value").alias(name))
    land = fine.groupBy("lat_ix", "lon_ix").agg(F.count("t2m").alias("n")).agg(F.count_if(F.col("n") > 0).cast("double").alias("land"))
    more = land.select(F.inline(F.array(F.struct(F.lit("land_pixels").alias("metric"), F.col("land").alias("fine")), F.struct(F.lit("missing_fraction").alias("metric"), (1 - F.col("land") / n_pixels).alias("fine")))))
    both = side(fine, "t2m", "fine").unionByName(more).join(side(coarse, "tas", "coarse"), "metric", "left")
    place = F.create_map(*(x for k, m in enumerate(order) for x in (F.lit(m), F.lit(k))))
    return both.filter(F.col("metric").isin(*order)).select(place[F.col("metric")].alias("pos"), "metric", "fine", F.when(F.col("metric") == "missing_fraction", 0.0).otherwise(F.col("coarse")).alias("coarse"))


def colour_limits(df: DataFrame, value: str) -> DataFrame:
    """2nd and 98th percentile of all panels together."""
    return with_quantiles(df.agg(F.count(value).alias("n")), df, value, COLOUR_LIMITS).select(F.get("q", 0).alias("vmin"), F.get("q", 1).alias("vmax"))


def symmetric_limits(df: DataFrame, value: str) -> DataFrame:
    sizes = df.select(F.abs(F.col(value)).alias("v"))
    return with_quantiles(sizes.agg(F.count("v").alias("n")), sizes, "v", [COLOUR_LIMITS[1]]).select((-F.get("q", 0)).alias("vmin"), F.get("q", 0).alias("vmax"))


def histogram(df: DataFrame, value: str, edges: int = HISTOGRAM_EDGES) -> DataFrame:
    """(label, bin, lo, hi, n, density) of each label over bins shared by all; empty bins are left out.

    The range is one row, joined by broadcast; bins are found by arithmetic, with map-side counts.
    """
    bins = edges - 1
    clean = df.filter(E.is_finite(F.col(value))).select("label", F.col(value).alias("v"))
    span = clean.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    counted = clean.crossJoin(F.broadcast(span)).groupBy("label", E.bin_equal(F.col("v"), F.col("low"), F.col("high"), bins).alias("bin")).agg(F.count("*").alias("n"))
    totals = counted.groupBy("label").agg(F.sum("n").alias("total"))
    width = (F.col("high") - F.col("low")) / bins
    out = counted.join(totals, "label").crossJoin(F.broadcast(span))
    return out.select("label", "bin", (F.col("low") + F.col("bin") * width).alias("lo"), (F.col("low") + (F.col("bin") + 1) * width).alias("hi"), "n", F.try_divide(F.col("n"), F.col("total") * width).alias("density"))


def box_statistics(df: DataFrame, keys: list[str], value: str, more: Sequence[Column] = (), bound: int | None = None) -> DataFrame:
    """Per group: n, q1, median, q3 and whiskers, the extreme values within 1.5 IQR of the box.

    Quantiles are those of exact_quantiles(). more: other aggregates of the group's rows, taken in the pass that finds
    the whiskers. bound: the most groups there can be. Rows with a NULL key are left out. The rows are written once and
    read for each of the three passes, which happens here; only the result stays.
    """
    spark = df.sparkSession
    path, out = new_path(spark, "box-rows"), new_path(spark, "boxes")
    every = written(df.filter(F.col(value).isNotNull()).dropna(subset=keys).withColumn("v", F.col(value)), "box-rows", path)
    box = exact_quantiles(every.select(*keys, "v"), keys, "v", [0.25, 0.5, 0.75], bound=bound).select(*keys, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    box = written(box, "boxes", f"{out}/box")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.when((F.col("v") >= F.col("q1") - reach) & (F.col("v") <= F.col("q3") + reach), F.col("v"))
    joined = with_groups(every, box.select(*keys, F.col("n").alias("size_"), "q1", "q3"), keys, "size_", bound)
    whiskers = joined.select(*(f"r.{c}" for c in every.columns), "q1", "q3").groupBy(*keys).agg(F.min(inside).alias("whisker_lo"), F.max(inside).alias("whisker_hi"), *more)
    result = written(box.join(whiskers, keys, "left"), "boxes", f"{out}/all")
    emptied(spark, path)
    return result


def quantiles(df: DataFrame, keys: list[str], value: str, percents=PERCENTILES, bound: int | None = None) -> DataFrame:
    """(keys, percent, value), exact; bound: the most groups there can be."""
    q = exact_quantiles(df, keys, value, [p / 100 for p in percents], bound=bound)
    pairs = F.array(*(F.struct(F.lit(p).alias("percent"), F.col("q")[k].alias("value")) for k, p in enumerate(percents)))
    return q.select(*keys, F.inline(pairs))


def hexagons(df: DataFrame, x: str, y: str, columns: int = HEX_COLUMNS, span: DataFrame | None = None) -> DataFrame:
    """(x, y, n): centres of hexagons with at least one point, over all points.

    span: the extremes x0, x1, y0, y1 in one row, where they are known without another pass over df.

    Two rectangular lattices, one shifted by half a step both ways; a point belongs to the nearer centre, in
    units in which a hexagon is one wide and the square root of 3 high for two rows.
    """
    clean = df.filter(E.is_finite(F.col(x)) & E.is_finite(F.col(y))).select(F.col(x).alias("px"), F.col(y).alias("py"))
    rows = int(columns / math.sqrt(3))
    span = span if span is not None else clean.agg(F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1"))
    # A constant coordinate gets a step of 1, so that all its points share one line.
    step = lambda a, b, n: F.when(F.col(b) > F.col(a), (F.col(b) - F.col(a)) / n).otherwise(1.0)
    p = clean.crossJoin(F.broadcast(span)).select(((F.col("px") - F.col("x0")) / step("x0", "x1", columns)).alias("u"), ((F.col("py") - F.col("y0")) / step("y0", "y1", rows)).alias("w"))
    near = lambda c: F.floor(F.col(c) + 0.5)
    half = lambda c: F.floor(F.col(c)) + 0.5
    gap = lambda f: F.pow(F.col("u") - f("u"), F.lit(2)) + 3.0 * F.pow(F.col("w") - f("w"), F.lit(2))
    first = gap(near) < gap(half)
    at = p.select(F.when(first, near("u").cast("double")).otherwise(half("u")).alias("i"), F.when(first, near("w").cast("double")).otherwise(half("w")).alias("j"))
    counts = at.groupBy("i", "j").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(span)).select((F.col("x0") + F.col("i") * step("x0", "x1", columns)).alias("x"), (F.col("y0") + F.col("j") * step("y0", "y1", rows)).alias("y"), "n")


def ranges(df: DataFrame, value: Column) -> DataFrame:
    return df.agg(F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"))


def export_sample(df: DataFrame, rows: int, seed: int = 42, by: Sequence[str] | None = None) -> DataFrame:
    """About so many rows, for display only; statistics never use it.

    Rows are chosen by a digest of what names them (by, or all columns), so the choice is the same at each run.
    """
    names = F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in by or df.columns), F.lit(str(seed))))
    place = F.conv(F.substring(names, 1, 8), 16, 10).cast("double") / float(1 << 32)
    size = df.agg(F.count("*").alias("size_"))
    return df.withColumn("place_", place).crossJoin(F.broadcast(size)).filter(F.col("place_") * F.col("size_") < rows).drop("place_", "size_")
