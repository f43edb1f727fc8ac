"""Exact global ranks of a column of any size, and tests of normality that need them.

Rows are dealt by ranges of the value, each task sorts its range, and the counts of the ranges before give each
range its offset: no task ranks all rows. Equal values are parted by an arbitrary number, so that a value that a
third of all rows have is spread over tasks as well; which of them comes first doesn't matter to what is computed here.
The ranges are a written table, which settles them before the offsets are counted.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..sources.tables import new_path, written

_LOW = (1 << 33) - 1  # bits of a row's number within its task


def ranked(df: DataFrame, value: str | Sequence[str], path: str | None = None) -> DataFrame:
    """df with rank (from 1) by one or more columns, NULL first; path: where the sorted table goes, else a new folder."""
    order = [*(F.col(c).asc_nulls_first() for c in ([value] if isinstance(value, str) else value)), F.col("tie_")]
    rows = df.withColumn("tie_", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()  # task and place in it, taken after the sort
    rows = rows.drop("tie_").withColumn("at_", place).select("*", F.shiftright("at_", 33).alias("part_"), F.col("at_").bitwiseAND(_LOW).alias("place_")).drop("at_")
    table = written(rows, "ranks", path or new_path(df.sparkSession, "ranks"))
    counts = table.groupBy("part_").agg(F.count("*").alias("m"))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    offsets = counts.select("part_", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before_"))
    return table.join(F.broadcast(offsets), "part_").withColumn("rank", F.col("before_") + F.col("place_") + 1).drop("part_", "place_", "before_")


def _polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    """c0 + c1 x + c2 x^2 + ..."""
    return functools.reduce(lambda acc, c: acc * x + c, reversed(coefficients[:-1]), F.lit(coefficients[-1]))


# Wichura's rational approximations of the normal quantile (AS 241), numerators and denominators.
CENTRE = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
MIDDLE = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
TAIL = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def normal_quantile(p: Column) -> Column:
    """The value below which a standard normal variable lies with probability p, for 0 < p < 1."""
    q = p - 0.5
    ratio = lambda x, c: _polynomial(x, c[0]) / _polynomial(x, c[1])
    r = F.sqrt(-F.log(F.least(p, 1.0 - p)))
    far = F.when(r <= 5.0, ratio(r - 1.6, MIDDLE)).otherwise(ratio(r - 5.0, TAIL))
    return F.when(F.abs(q) <= 0.425, q * ratio(0.180625 - q * q, CENTRE)).otherwise(F.when(q < 0, -far).otherwise(far))


# Coefficients of the approximation, in 1/sqrt(n) for the weights and in n or log n for the p-value.
LAST_WEIGHT = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
NEXT_WEIGHT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_MEAN, SMALL_SD, SMALL_LIMIT = (0.5440, -0.39978, 0.025054, -6.714e-4), (1.3822, -0.77857, 0.062767, -0.0020322), (-2.273, 0.459)
MEAN, SD = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)
#: Above so many values the approximation of p isn't valid.
MOST_FOR_P = 5000


def shapiro_wilk(df: DataFrame, value: str, cdf) -> DataFrame:
    """(n, w, p): the Shapiro-Wilk statistic of all finite values, and its p-value where that is valid.

    Weights are functions of the rank, so all is one sum over ranked rows. w is NULL for fewer than 3 values or if all
    are equal, and so is p, which is NULL above MOST_FOR_P values too. cdf: the standard normal distribution function.
    """
    rows = df.filter(E.is_finite(F.col(value))).select(F.col(value).cast("double").alias("x"))
    order = ranked(rows, "x")
    one = order.agg(F.count("*").alias("n"), F.avg("x").alias("centre"))
    n, rank, x = F.col("n"), F.col("rank"), F.col("x")
    m = normal_quantile((rank - 0.375) / (n + 0.25))
    each = order.crossJoin(F.broadcast(one)).select("n", "rank", (x - F.col("centre")).alias("x"), m.alias("m"))
    at = lambda k, c: F.max(F.when(rank == k, F.col(c)))
    s = each.agg(
        F.first("n").alias("n"), F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum(F.col("m") * x).alias("mx"), F.sum(x * x).alias("xx"), F.sum("x").alias("sx"),
        at(F.lit(1), "x").alias("first"), at(F.lit(2), "x").alias("second"), at(n - 1, "x").alias("next"), at(n, "x").alias("last"), at(n - 1, "m").alias("m_next"), at(n, "m").alias("m_last"),
    ).filter("n is not null")
    square = F.col("xx") - F.col("sx") * F.col("sx") / n
    u, root = 1.0 / F.sqrt(n), F.sqrt("mm")
    a_last = F.when(n == 3, math.sqrt(0.5)).otherwise(_polynomial(u, LAST_WEIGHT) + F.col("m_last") / root)
    a_next = _polynomial(u, NEXT_WEIGHT) + F.col("m_next") / root
    wide, narrow = F.col("last") - F.col("first"), F.col("next") - F.col("second")
    two = lambda c: 2.0 * F.col(c) * F.col(c)
    big = n > 5
    share = F.when(big, (F.col("mm") - two("m_last") - two("m_next")) / (1.0 - 2.0 * a_last * a_last - 2.0 * a_next * a_next)).otherwise((F.col("mm") - two("m_last")) / (1.0 - 2.0 * a_last * a_last))
    rest = F.col("mx") - F.col("m_last") * wide - F.when(big, F.col("m_next") * narrow).otherwise(0.0)
    total = a_last * wide + F.when(big, a_next * narrow).otherwise(0.0) + F.when(n == 3, 0.0).otherwise(F.try_divide(rest, F.sqrt(F.when(share > 0, share))))
    w = F.when((n >= 3) & (F.col("last") > F.col("first")), F.least(F.lit(1.0), F.try_divide(total * total, square)))
    log_n, real = F.log(n), n.cast("double")
    y = F.log(F.greatest(1.0 - F.col("w"), F.lit(1e-300)))
    limit = _polynomial(real, SMALL_LIMIT)
    z_small = (-F.log(limit - y) - _polynomial(real, SMALL_MEAN)) / F.exp(_polynomial(real, SMALL_SD))
    z = (y - _polynomial(log_n, MEAN)) / F.exp(_polynomial(log_n, SD))
    three = F.greatest(F.lit(0.0), 6.0 / math.pi * (F.asin(F.sqrt("w")) - math.asin(math.sqrt(0.75))))
    p = F.when(n == 3, three).when(n <= 11, F.when(y >= limit, 0.0).otherwise(1.0 - cdf(z_small))).when(n <= MOST_FOR_P, 1.0 - cdf(z))
    return s.select("n", w.alias("w")).select("n", "w", F.when(F.col("w").isNotNull(), p).alias("p"))


def morans_i_test(field: DataFrame, value: str, replicates: int = 99, seed: int = 42) -> DataFrame:
    """(n, links, morans_i, p, mean_i): Moran's I of a field on a grid (lat_ix, lon_ix) with a permutation test.

    Neighbours are cells that share a side. Replicate r deals the values to the cells anew: the k-th cell in the order of
    a digest of (seed, r, cell) gets the k-th value of the field. All replicates are ranked and added up in one pass,
    keyed by r, so neither a replicate nor the field is one task's. p: the share of all arrangements, the field's own
    among them, whose I is at least its own; mean_i: mean of the replicates. Cells without a finite value are left
    out; a field without variance or links has no I.
    """
    known = field.filter(E.is_finite(F.col(value))).select("lat_ix", "lon_ix", F.col(value).cast("double").alias("v"))
    cells = ranked(known, ["lat_ix", "lon_ix"]).withColumnRenamed("rank", "id")
    one = cells.agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    z = cells.crossJoin(F.broadcast(one)).select("id", "lat_ix", "lon_ix", "n", (F.col("v") - F.col("mean")).alias("z"))
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("r").cast("string"), F.col("lat_ix").cast("string"), F.col("lon_ix").cast("string")))
    again = z.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).select("r", "lat_ix", "lon_ix", "n", draw.alias("draw"))
    placed = ranked(again, ["r", "draw", "lat_ix", "lon_ix"]).select("r", "lat_ix", "lon_ix", (F.col("rank") - (F.col("r") - 1) * F.col("n")).alias("id"))
    dealt = placed.join(z.select("id", "z"), "id").select("r", "lat_ix", "lon_ix", "z")
    every = dealt.unionByName(z.select(F.lit(0).alias("r"), "lat_ix", "lon_ix", "z"))
    moved = every.select("r", F.col("z").alias("near"), F.inline(F.array(*(F.struct((F.col("lat_ix") + i).alias("lat_ix"), (F.col("lon_ix") + j).alias("lon_ix")) for i, j in ((0, 1), (0, -1), (1, 0), (-1, 0))))))
    cross = every.join(moved, ["r", "lat_ix", "lon_ix"]).groupBy("r").agg(F.count("*").alias("links"), F.sum(F.col("z") * F.col("near")).alias("c"))
    square = z.agg(F.max("n").alias("n"), F.sum(F.col("z") * F.col("z")).alias("s"))
    i = F.try_divide(F.col("n") * F.col("c"), F.col("links") * F.col("s"))
    told = cross.crossJoin(F.broadcast(square)).select("r", "n", "links", F.round(i, 12).alias("i"))  # equal arrangements count as equal
    own = told.filter("r = 0").select(F.col("i").alias("own"))
    out = told.crossJoin(F.broadcast(own)).agg(F.max("n").alias("n"), F.max("links").alias("links"), F.max("own").alias("morans_i"), (F.count_if(F.col("i") >= F.col("own")) / F.lit(replicates + 1)).alias("p"), F.avg(F.when(F.col("r") > 0, F.col("i"))).alias("mean_i"))
    return out.filter("morans_i is not null")
