"""Queries of the engine over the derived grids, with their SQL.

Computed doubles are rounded to 6 decimals on both sides (0.0 is added so that there is no negative zero) and
days are texts. Queries are thin: what they compute is in the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..operators import calendar, extensions, grid, pairing, regression, stats
from ..schema import AUGUST, COARSE_PADDING, KELVIN_MEAN_SERIES, PERCENTILES, QUARTERS, STUDY_REGION, TARGET, Region
from ..sources import grids as sources
from ..sources import tables, transfer
from .fixtures import COARSE_LATS, COARSE_LONS, Grids, grids, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

DATED = {"day", "period", "first", "last"}


def _plain(df: DataFrame) -> DataFrame:
    """Doubles rounded, days as text, counts as long."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "double":
            c = F.round(c, 6) + F.lit(0.0)
        elif kind == "date":
            c = E.day_text(c)
        elif kind in ("int", "smallint"):
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(*out)


def _query(name: str, statement: str, *parts: str):
    """Registers a function of (Grids, spark) under a name. In the SQL, [x] stands for x rounded."""

    def register(f: Callable[[Grids, SparkSession], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: _plain(f(grids(spark, sf_dir), spark))
        ORACLE_SQL[name] = sql(statement.replace("[[", "round(").replace("]]", ", 6) + 0.0"), *parts)
        return f

    return register


DAY = "strftime(day, '%Y-%m-%d') as day"
_PAIR = "[[era5_lat]] as era5_lat, [[era5_lon]] as era5_lon, [[cmip_lat]] as cmip_lat, [[cmip_lon]] as cmip_lon"
_CELL = "[[cmip_lat]] as cmip_lat, [[cmip_lon]] as cmip_lon"
_PIXEL = "[[era5_lat]] as era5_lat, [[era5_lon]] as era5_lon"


def _pairs(g: Grids) -> DataFrame:
    return pairing.paired(g.fine, g.coarse, axes=(COARSE_LATS, COARSE_LONS))


_FOUR = ["era5_lat", "era5_lon", "cmip_lat", "cmip_lon"]
_TWO = ["cmip_lat", "cmip_lon"]


def _folded(g: Grids) -> DataFrame:
    return pairing.folded_pairs(g.fine, g.coarse, axes=(COARSE_LATS, COARSE_LONS))


def _model(g: Grids) -> DataFrame:
    """The global fit; the pairs aren't built for it."""
    return regression.fit_folded(_folded(g))


def _resid(g: Grids) -> DataFrame:
    return regression.residuals(_pairs(g), _model(g))


def _assigned(g: Grids) -> DataFrame:
    return grid.assign_cells(g.pixels, COARSE_LATS, COARSE_LONS)


def _stats(g: Grids) -> DataFrame:
    a = _assigned(g)
    return grid.cell_stats(grid.sea_fraction(a), grid.pixel_counts(a.filter("is_land")))


def _series(g: Grids) -> DataFrame:
    return stats.daily(g.fine, "t2m", "fine").unionByName(stats.daily(g.coarse, "tas", "coarse"))


# --- sources, projections, filters


@_query("load_fine", f"select {_PIXEL}, {DAY}, [[t2m]] as t2m from fine where era5_lat between 26.0::double - 0.1::double and 30.0::double + 0.1::double and era5_lon between 32.0::double - 0.1::double and 36.0::double + 0.1::double", "fine")
def _(g, spark):
    raw = g.fine.select(F.col("era5_lat").alias("latitude"), F.col("era5_lon").alias("longitude"), F.col("day").cast("timestamp_ntz").alias("valid_time"), F.coalesce("t2m", F.lit(float("nan"))).alias("t2m"), F.lit(0).alias("number"), F.lit("x").alias("expver"))
    halves = [raw.filter(F.month("valid_time") <= 6), raw.filter(F.month("valid_time") > 6).withColumnRenamed("valid_time", "time")]
    return sources.load_fine(halves, Region(26.0, 30.0, 32.0, 36.0), 0.1, 0.1)


@_query(
    "load_coarse",
    f"select {_CELL}, {DAY}, [[tas]] as tas from (select cmip_lat, day, tas, (cmip_lon + 300.0 + 180.0) % 360.0 - 180.0 as cmip_lon from coarse) where cmip_lat between 25.0::double - 1.0 and 30.0::double + 1.0 and cmip_lon between -30.0::double - 1.5 and -26.0::double + 1.5",
    "coarse",
)
def _(g, spark):
    raw = g.coarse.select(F.col("cmip_lat").alias("lat"), (F.col("cmip_lon") + 300.0).alias("lon"), F.col("day").alias("time"), "tas", F.lit(1.0).alias("other"))
    return sources.load_coarse(raw, Region(25.0, 30.0, -30.0, -26.0), *COARSE_PADDING)


@_query(
    "manifest",
    """select 'fine' as dataset, count(*) as n_rows, count(distinct era5_lat) as n_lat, count(distinct era5_lon) as n_lon, count(distinct day) as n_times, [[min(era5_lat)]] as lat_min, [[max(era5_lat)]] as lat_max,
      [[min(era5_lon)]] as lon_min, [[max(era5_lon)]] as lon_max, strftime(min(day), '%Y-%m-%d') as first, strftime(max(day), '%Y-%m-%d') as last from fine
    union all select 'coarse', count(*), count(distinct cmip_lat), count(distinct cmip_lon), count(distinct day), [[min(cmip_lat)]], [[max(cmip_lat)]], [[min(cmip_lon)]], [[max(cmip_lon)]], strftime(min(day), '%Y-%m-%d'), strftime(max(day), '%Y-%m-%d') from coarse""",
    "fine", "coarse",
)
def _(g, spark):
    return sources.manifest({"fine": (g.fine, "era5_lat", "era5_lon", "day"), "coarse": (g.coarse, "cmip_lat", "cmip_lon", "day")})


@_query(
    "no_leap_days",
    f"""select n::bigint as n, {DAY} from (select day, (year(day) - 1990) * 365 + dayofyear(day) - 1 - case when month(day) > 2 and day(make_date(year(day), 2, 28) + 1) = 29 then 1 else 0 end as n
      from (select distinct day from coarse))""",
    "coarse",
)
def _(g, spark):
    # The count of days in a calendar without leap days, taken from the record, gives its dates again.
    leap = F.day(F.last_day(F.make_date(F.year("day"), F.lit(2), F.lit(1)))) == 29
    n = (F.year("day") - 1990) * 365 + F.dayofyear("day") - 1 - F.when(leap & (F.month("day") > 2), 1).otherwise(0)
    return g.coarse.select(n.alias("n")).distinct().select("n", E.no_leap_day(1990, F.col("n")).alias("day"))


@_query(
    "standardize_longitude",
    "select lon_ix::bigint as ix, [[case when (select max(era5_lon * 9) from lon) > 180 then (era5_lon * 9 + 180.0) % 360.0 - 180.0 else era5_lon * 9 end]] as lon from lon",
    "lon",
)
def _(g, spark):
    raw = g.lons.select(F.col("lon_ix").alias("ix"), (F.col("era5_lon") * 9).alias("lon"))
    return grid.standardize_longitude(raw, "lon")


@_query("box_subset", f"select {_PIXEL}, {DAY}, [[t2m]] as t2m from fine where era5_lat between 24.0 - 0.1 and 38.0 + 0.1 and era5_lon between 33.0::double and 35.0::double and t2m is not null".replace("24.0 - 0.1 and 38.0 + 0.1", "24.0::double - 0.1::double and 38.0::double + 0.1::double"), "fine")
def _(g, spark):
    return grid.subset_box(grid.subset_box(g.fine, "era5_lat", "era5_lon", STUDY_REGION, 0.1, 0.1), "era5_lat", "era5_lon", Region(0.0, 90.0, 33.0, 35.0)).filter("t2m is not null").select("era5_lat", "era5_lon", "day", "t2m")


@_query("to_celsius", f"select {_PIXEL}, {DAY}, [[(t2m + 273.15::double) - case when (select avg(t2m + 273.15::double) from fine) > 150 then 273.15::double else 0 end]] as t2m from fine", "fine")
def _(g, spark):
    return stats.to_celsius(g.fine.withColumn("t2m", F.col("t2m") + F.lit(273.15)), "t2m").select("era5_lat", "era5_lon", "day", "t2m")


@_query("to_celsius_by_units", "select count(*) as n, [[min(tas - 273.15::double)]] as low, [[max(tas - 273.15::double)]] as high from coarse", "coarse")
def _(g, spark):
    cold = g.coarse.withColumn("tas", sources.with_units(F.col("tas"), "tas", " Kelvin "))
    return stats.to_celsius(cold, "tas").agg(F.count("*").alias("n"), F.min("tas").alias("low"), F.max("tas").alias("high"))


@_query("series_to_celsius", f"select {DAY}, [[avg(tas + 120.0) - case when (select avg(tas + 120.0) from coarse) > 100 then 273.15::double else 0 end]] as value from coarse group by day", "coarse")
def _(g, spark):
    warm = stats.daily(g.coarse.withColumn("tas", F.col("tas") + 120.0), "tas", "coarse")
    return stats.to_celsius(warm, "value", threshold=KELVIN_MEAN_SERIES).select("day", "value")


@_query("align_calendars", f"select {DAY}, n_fine, n_coarse from (select day, count(*) as n_fine from fine group by day) join (select day, count(*) as n_coarse from coarse group by day) using (day)", "fine", "coarse")
def _(g, spark):
    a, b, days = calendar.align(g.fine, g.coarse)
    return days.join(a.groupBy("day").agg(F.count("*").alias("n_fine")), "day").join(b.groupBy("day").agg(F.count("*").alias("n_coarse")), "day")


@_query("align_dropped_days", f"select {DAY}, count(*) as n from fine where day not in (select day from coarse) group by day", "fine", "coarse")
def _(g, spark):
    days = calendar.shared_days(g.fine, g.coarse)
    return g.fine.join(days, "day", "left_anti").groupBy("day").agg(F.count("*").alias("n"))


@_query("finite_values", "select 'fine' as dataset, count(*) as n_rows, count(t2m) as n_finite from fine union all select 'coarse', count(*), count(tas) from coarse", "fine", "coarse")
def _(g, spark):
    # The fine record drops missing values only, the coarse one infinities too.
    count = lambda df, test, label: df.agg(F.lit(label).alias("dataset"), F.count("*").alias("n_rows"), F.count_if(test).alias("n_finite"))
    return count(g.fine, F.col("t2m").isNotNull(), "fine").unionByName(count(g.coarse, E.is_finite(F.col("tas")), "coarse"))


@_query("fixed_dates", f"select label, {DAY}, [[value]] as value from series where strftime(day, '%m-%d') in ('01-01', '04-01', '07-01', '10-01')", "series")
def _(g, spark):
    return _series(g).filter(E.month_day(F.col("day")).isin(*QUARTERS))


_AUG = "group by year(day)"


@_query(
    "august_table",
    f"""select a.year, [[fine_mean]] as fine_mean, [[fine_min]] as fine_min, [[fine_max]] as fine_max, [[coarse_mean]] as coarse_mean, [[coarse_min]] as coarse_min, [[coarse_max]] as coarse_max from
    (select year(day) as year, avg(t2m) as fine_mean, min(t2m) as fine_min, max(t2m) as fine_max from fine where strftime(day, '%m-%d') = '08-01' {_AUG}) a
    join (select year(day) as year, avg(tas) as coarse_mean, min(tas) as coarse_min, max(tas) as coarse_max from coarse where strftime(day, '%m-%d') = '08-01' {_AUG}) b on a.year = b.year""",
    "fine", "coarse",
)
def _(g, spark):
    def side(df, value, name):
        return calendar.on_date(df, AUGUST).groupBy(F.year("day").alias("year")).agg(F.avg(value).alias(f"{name}_mean"), F.min(value).alias(f"{name}_min"), F.max(value).alias(f"{name}_max"))

    return side(g.fine, "t2m", "fine").join(side(g.coarse, "tas", "coarse"), "year")


def _point_series(g: Grids) -> DataFrame:
    lat, lon = TARGET
    near = lambda axis, ix, coord, t: grid.nearest_point(axis, ix, coord, t).select(ix)
    fine = g.fine.join(F.broadcast(near(g.lats, "lat_ix", "era5_lat", lat)), "lat_ix").join(F.broadcast(near(g.lons, "lon_ix", "era5_lon", lon)), "lon_ix")
    coarse = g.coarse.join(F.broadcast(near(g.clats, "clat_ix", "cmip_lat", lat)), "clat_ix").join(F.broadcast(near(g.clons, "clon_ix", "cmip_lon", lon)), "clon_ix")
    return fine.select(F.lit("fine").alias("label"), "day", F.col("t2m").alias("value")).unionByName(coarse.select(F.lit("coarse").alias("label"), "day", F.col("tas").alias("value")))


_POINT = """select 'fine' as label, day, t2m as value from fine where lat_ix = (select lat_ix from lat order by abs(era5_lat - 32.0), lat_ix limit 1) and lon_ix = (select lon_ix from lon order by abs(era5_lon - 35.0), lon_ix limit 1)
  union all select 'coarse', day, tas from coarse where clat_ix = (select clat_ix from clat order by abs(cmip_lat - 32.0), clat_ix limit 1) and clon_ix = (select clon_ix from clon order by abs(cmip_lon - 35.0), clon_ix limit 1)"""


@_query("nearest_point_series", f"select label, {DAY}, [[value]] as value from ({_POINT})", "fine", "coarse", "lat", "lon", "clat", "clon")
def _(g, spark):
    return _point_series(g)


_SEASON = "case when month(day) in (12, 1, 2) then 'DJF' when month(day) in (3, 4, 5) then 'MAM' when month(day) in (6, 7, 8) then 'JJA' else 'SON' end"


@_query("seasonal_split", f"select {_SEASON} as season, month(day) as month, count(*) as n, count(t2m) as n_valid from fine group by all", "fine")
def _(g, spark):
    parts = [df.withColumn("season", F.lit(s)) for s, df in calendar.seasonal_split(g.fine).items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("season", F.month("day").alias("month")).agg(F.count("*").alias("n"), F.count("t2m").alias("n_valid"))


# --- grids and joins


@_query("land_mask", "select lat_ix::bigint as lat_ix, lon_ix::bigint as lon_ix, count(t2m) > 0 as is_land from fine group by all", "fine")
def _(g, spark):
    return grid.land_mask(g.fine)


@_query(
    "land_pixel_counts",
    """select (select count(*) from (select 1 from fine group by lat_ix, lon_ix having count(t2m) > 0)) as by_mask, (select count(distinct (lat_ix, lon_ix)) from fine where t2m is not null and day = (select min(day) from fine)) as by_first_day,
      (select count(*) from (select 1 from fine group by lat_ix, lon_ix)) as n_pixels""",
    "fine",
)
def _(g, spark):
    mask = grid.land_mask(g.fine).agg(F.count_if("is_land").alias("by_mask"), F.count("*").alias("n_pixels"))
    first = g.fine.join(F.broadcast(g.fine.agg(F.min("day").alias("day"))), "day").agg(F.count_if(F.col("t2m").isNotNull()).alias("by_first_day"))
    return mask.crossJoin(first).select("by_mask", "by_first_day", "n_pixels")


_ASSIGNED = f"select lat_ix::bigint as lat_ix, lon_ix::bigint as lon_ix, clat_ix::bigint as clat_ix, clon_ix::bigint as clon_ix, {_PAIR} from assigned"
_COLUMNS = ["lat_ix", "lon_ix", "clat_ix", "clon_ix", "era5_lat", "era5_lon", "cmip_lat", "cmip_lon"]


@_query("assignment_all", _ASSIGNED, "assigned")
def _(g, spark):
    return _assigned(g).select(*_COLUMNS)


@_query("assignment_land", _ASSIGNED + " where (lat_ix, lon_ix) in (select lat_ix, lon_ix from fine where t2m is not null)", "assigned", "fine")
def _(g, spark):
    return pairing.assignment(g.fine, g.coarse, grid.land_mask(g.fine)).select(*_COLUMNS)


@_query("assignment_cell_id", f"select {_PAIR}, dense_rank() over (order by cmip_lat, cmip_lon) - 1 as cell_id from assigned where is_land", "assigned")
def _(g, spark):
    return grid.cell_ids(_assigned(g).filter("is_land")).select("era5_lat", "era5_lon", "cmip_lat", "cmip_lon", "cell_id")


@_query("paired", f"select {_PAIR}, {DAY}, [[t2m]] as t2m, [[tas]] as tas from paired", "paired")
def _(g, spark):
    return _pairs(g).select(*_FOUR, "day", "t2m", "tas")


@_query("paired_aligned", "select count(*) as n, count(distinct day) as n_days, [[sum(t2m)]] as t2m, [[avg(tas)]] as tas from paired", "paired")
def _(g, spark):
    return pairing.aligned_paired(g.fine, g.coarse, grid.land_mask(g.fine)).agg(F.count("*").alias("n"), E.distinct_few("day").alias("n_days"), F.sum("t2m").alias("t2m"), F.avg("tas").alias("tas"))


@_query(
    "paired_summary",
    """select count(*) as n, count(distinct (cmip_lat, cmip_lon)) as n_cells, count(distinct day) as n_days, [[regr_slope(t2m, tas)]] as slope, [[regr_intercept(t2m, tas)]] as intercept, [[corr(t2m, tas)]] as r,
      [[avg(t2m)]] as t2m_mean, [[stddev_pop(t2m)]] as t2m_sd, [[quantile_cont(t2m, 0.5)]] as t2m_median, [[quantile_cont(t2m, 0.75) - quantile_cont(t2m, 0.25)]] as t2m_iqr from paired""",
    "paired",
)
def _(g, spark):
    folded = tables.written(_folded(g), "folded")
    n, mean = F.sum("n"), F.sum("total") / F.sum("n")
    one = folded.agg(n.alias("n"), E.distinct_few("clat_ix", "clon_ix").alias("n_cells"), E.distinct_few("day").alias("n_days"), mean.alias("t2m_mean"), F.sqrt(F.sum("square") / n - mean * mean).alias("t2m_sd"))
    values = tables.written(pairing.paired_values(g.fine, folded, (COARSE_LATS, COARSE_LONS)), "paired-values")
    out = stats.with_quantiles(one.crossJoin(regression.fit_folded(folded).select("slope", "intercept", "r")), values, "t2m", [0.25, 0.5, 0.75])
    return out.withColumns({"t2m_median": F.get("q", F.lit(1)), "t2m_iqr": F.get("q", F.lit(2)) - F.get("q", F.lit(0))}).drop("q")


@_query("pixel_counts", f"select {_CELL}, n_pixels from counts", "counts")
def _(g, spark):
    return grid.pixel_counts(_assigned(g).filter("is_land")).select(*_TWO, "n_pixels")


@_query(
    "pixel_count_stats",
    """select count(*) as n_cells, sum(n_pixels)::bigint as n_land_pixels, [[avg(n_pixels)]] as mean, [[stddev_samp(n_pixels)]] as std, min(n_pixels) as min, [[quantile_cont(n_pixels, 0.25)]] as p25, [[quantile_cont(n_pixels, 0.5)]] as median,
      [[quantile_cont(n_pixels, 0.75)]] as p75, [[quantile_cont(n_pixels, 0.9)]] as p90, max(n_pixels) as max from counts""",
    "counts",
)
def _(g, spark):
    return grid.pixel_count_stats(grid.pixel_counts(_assigned(g).filter("is_land")))


@_query("sea_fraction", f"select {_CELL}, n_total, n_land, n_sea, [[sea_fraction]] as sea_fraction from sea", "sea")
def _(g, spark):
    return grid.sea_fraction(_assigned(g)).select(*_TWO, "n_total", "n_land", "n_sea", "sea_fraction")


@_query("cell_stats", f"select {_CELL}, n_total, n_land, n_sea, [[sea_fraction]] as sea_fraction, n_land_pixels::bigint as n_land_pixels from stats", "stats")
def _(g, spark):
    return _stats(g).drop("clat_ix", "clon_ix")


@_query("coastal_counts", "select count(*) filter (sea_fraction > 0) as coastal, count(*) filter (sea_fraction = 0) as inland from stats", "stats")
def _(g, spark):
    return grid.coastal_counts(_stats(g))


_DESCRIBE = "count({c}) as count, [[avg({c})]] as mean, [[stddev_samp({c})]] as std, [[min({c})::double]] as min, [[quantile_cont({c}, 0.25)]] as p25, [[quantile_cont({c}, 0.5)]] as p50, [[quantile_cont({c}, 0.75)]] as p75, [[max({c})::double]] as max"


@_query("cell_stats_describe", " union all ".join(f"select '{c}' as stat, {_DESCRIBE.format(c=c)} from stats" for c in ("n_total", "n_land", "sea_fraction")), "stats")
def _(g, spark):
    s = _stats(g)
    a, b, c = (stats.describe(s, x).select(F.lit(x).alias("stat"), "*") for x in ("n_total", "n_land", "sea_fraction"))
    return a.unionByName(b).unionByName(c)


_DIST = "sqrt(pow(era5_lat - cmip_lat, 2) + pow((era5_lon - cmip_lon) * cos(radians((era5_lat + cmip_lat) / 2)), 2))"


@_query("distance_to_center", f"select {_PIXEL}, [[{_DIST}]] as dist_deg from assigned where is_land", "assigned")
def _(g, spark):
    return grid.distance_to_center(_assigned(g).filter("is_land")).select("era5_lat", "era5_lon", "dist_deg")


@_query("mean_field_on_grid", f"select {_PIXEL}, [[mean]] as mean from points left join (select lat_ix, lon_ix, avg(t2m) as mean from fine group by all) using (lat_ix, lon_ix)", "points", "fine")
def _(g, spark):
    return grid.on_grid(g.points, stats.temporal_mean(g.fine, ["lat_ix", "lon_ix"], "t2m"), ["lat_ix", "lon_ix"]).select("era5_lat", "era5_lon", "mean")


@_query("cell_edges", """select pos, [[edge]] as edge from (
  select row_number() over (order by cmip_lat) - 1 as pos, case when lag(cmip_lat) over w is null then cmip_lat - (lead(cmip_lat) over w - cmip_lat) / 2 else (lag(cmip_lat) over w + cmip_lat) / 2 end as edge from clat window w as (order by cmip_lat)
  union all select count(*), max(cmip_lat) + (max(cmip_lat) - max(cmip_lat) filter (clat_ix < 16)) / 2 from clat)""", "clat")  # fmt: skip
def _(g, spark):
    return grid.cell_edges(g.clats, "cmip_lat")


_LON_COLUMNS = ", ".join(f"coalesce(sum(n_pixels) filter (clon_ix = {k}), 0)::bigint as lon_{k}" for k in range(len(COARSE_LONS)))


@_query("cell_pivot", f"select [[cmip_lat]] as cmip_lat, {_LON_COLUMNS} from (select cmip_lat, clon_ix, count(*) as n_pixels from assigned where is_land group by all) group by cmip_lat", "assigned")
def _(g, spark):
    return grid.pivot_counts(grid.pixel_counts(_assigned(g).filter("is_land")), COARSE_LONS)


# --- maps and series


@_query("temporal_mean_maps", "select 'fine' as label, [[era5_lat]] as lat, [[era5_lon]] as lon, [[avg(t2m)]] as mean from fine group by label, era5_lat, era5_lon union all select 'coarse', [[cmip_lat]], [[cmip_lon]], [[avg(tas)]] from coarse group by cmip_lat, cmip_lon", "fine", "coarse")
def _(g, spark):
    return _mean_maps(g)


def _mean_maps(g: Grids) -> DataFrame:
    fine = stats.temporal_mean(g.fine, ["era5_lat", "era5_lon"], "t2m").toDF("lat", "lon", "mean")
    coarse = stats.temporal_mean(g.coarse, ["cmip_lat", "cmip_lon"], "tas").toDF("lat", "lon", "mean")
    return fine.select(F.lit("fine").alias("label"), "*").unionByName(coarse.select(F.lit("coarse").alias("label"), "*"))


_SEASONAL = f"select {_SEASON} as season, era5_lat as lat, era5_lon as lon, avg(t2m) as mean from fine group by all union all select {_SEASON}, cmip_lat, cmip_lon, avg(tas) from coarse group by all"


def _seasonal_maps(g: Grids) -> DataFrame:
    fine = stats.seasonal_mean(g.fine, ["era5_lat", "era5_lon"], "t2m").toDF("season", "lat", "lon", "mean")
    return fine.unionByName(stats.seasonal_mean(g.coarse, ["cmip_lat", "cmip_lon"], "tas").toDF("season", "lat", "lon", "mean"))


@_query("seasonal_mean_maps", f"select season, [[lat]] as lat, [[lon]] as lon, [[mean]] as mean from ({_SEASONAL})", "fine", "coarse")
def _(g, spark):
    return _seasonal_maps(g)


@_query("color_limits", "select [[quantile_cont(mean, 0.02)]] as vmin, [[quantile_cont(mean, 0.98)]] as vmax from (select avg(t2m) as mean from fine group by era5_lat, era5_lon union all select avg(tas) from coarse group by cmip_lat, cmip_lon)", "fine", "coarse")
def _(g, spark):
    return stats.colour_limits(_mean_maps(g), "mean")


@_query("seasonal_color_limits", f"select [[quantile_cont(mean, 0.02)]] as vmin, [[quantile_cont(mean, 0.98)]] as vmax from ({_SEASONAL})", "fine", "coarse")
def _(g, spark):
    return stats.colour_limits(_seasonal_maps(g), "mean")


@_query("domain_daily", f"select label, {DAY}, [[value]] as value from series", "series")
def _(g, spark):
    return _series(g)


@_query("domain_spread", f"select {DAY}, [[avg(tas)]] as mean, [[stddev_pop(tas)]] as sd, [[avg(tas) - stddev_pop(tas)]] as lo, [[avg(tas) + stddev_pop(tas)]] as hi, [[min(tas)]] as min, [[max(tas)]] as max from coarse group by day", "coarse")
def _(g, spark):
    return stats.daily_spread(g.coarse, "tas")


@_query("domain_range_series", f"select month, [[avg(m)]] as mean, [[avg(lo)]] as mean_min, [[avg(hi)]] as mean_max from (select strftime(day, '%Y-%m') as month, cmip_lat, cmip_lon, avg(tas) as m, min(tas) as lo, max(tas) as hi from coarse group by all) group by month", "coarse")
def _(g, spark):
    cells = g.coarse.groupBy(F.date_format("day", "yyyy-MM").alias("month"), "cmip_lat", "cmip_lon").agg(F.avg("tas").alias("m"), F.min("tas").alias("lo"), F.max("tas").alias("hi"))
    return cells.groupBy("month").agg(F.avg("m").alias("mean"), F.avg("lo").alias("mean_min"), F.avg("hi").alias("mean_max"))


@_query("missing_fraction_by_day", f"select {DAY}, [[1 - count(t2m) / 11421.0::double]] as missing from fine group by day", "fine")
def _(g, spark):
    return stats.missing_by_day(g.fine, "t2m", 141 * 81)


@_query("missing_fraction_map", f"select {_PIXEL}, [[1 - count(t2m) / (select count(distinct day) from fine)::double]] as missing from fine group by era5_lat, era5_lon", "fine")
def _(g, spark):
    return stats.missing_by_cell(g.fine, ["era5_lat", "era5_lon"], "t2m", g.fine.select("day").distinct().count())


def _period_sql(freq: str, aggregate: str, columns: str) -> str:
    label = {"ME": "last_day(day)", "YE": "make_date(year(day), 12, 31)"}[freq]
    unit = {"ME": "month", "YE": "year"}[freq]
    return f"""select label, strftime(period, '%Y-%m-%d') as period, {columns} from
      (select label, {label.replace('day)', 'start)') if freq == 'ME' else 'make_date(year(start), 12, 31)'} as period from
        (select label, unnest(generate_series(date_trunc('{unit}', min(day))::date, max({label}), interval 1 {unit}))::date as start from series group by label))
      left join (select label, {label} as period, {aggregate} from series group by all) using (label, period)"""


_SD = "avg(value) as mean, avg(value) - stddev_samp(value) as lo, avg(value) + stddev_samp(value) as hi"
_PCT = "avg(value) as mean, quantile_cont(value, 0.05) as lo, quantile_cont(value, 0.95) as hi"
_BANDS = "[[mean]] as mean, [[lo]] as lo, [[hi]] as hi"


@_query("domain_monthly", _period_sql("ME", "avg(value) as value", "[[value]] as value"), "series")
def _(g, spark):
    return calendar.resample_mean(_series(g), "ME")


@_query("domain_yearly", _period_sql("YE", "avg(value) as value", "[[value]] as value"), "series")
def _(g, spark):
    return calendar.resample_mean(_series(g), "YE")


for _freq, _name in (("ME", "monthly"), ("YE", "yearly")):
    for _method, _agg in (("sd", _SD), ("percentile", _PCT)):
        _query(f"domain_{_name}_band_{_method}", _period_sql(_freq, _agg, _BANDS), "series")(lambda g, spark, f=_freq, m=_method: calendar.resample_band(_series(g), f, m))

for _method, _agg in (("sd", _SD), ("percentile", _PCT)):
    _query(f"monthly_climatology_{_method}", f"select label, month, {_BANDS} from (select label, month, {_agg} from (select label, year(day) as year, month(day) as month, avg(value) as value from series group by all) group by all)", "series")(
        lambda g, spark, m=_method: calendar.monthly_climatology(_series(g), m)
    )


@_query("month_year_matrix", "select month(day) as month, " + ", ".join(f"[[avg(value) filter (year(day) = {y})]] as y{y}" for y in range(1992, 1999)) + " from series where label = 'coarse' group by month(day)", "series")
def _(g, spark):
    years = list(range(1992, 1999))
    return calendar.month_year_matrix(stats.daily(g.coarse, "tas", "coarse"), years).toDF("month", *(f"y{y}" for y in years))


@_query("series_frequency", "select label, case when date_diff('day', min(day), max(day)) / nullif(count(*) - 1, 0) > 300 then 'YE' else 'ME' end as freq from (select * from series union all select 'yearly', day, value from series where label = 'coarse' and strftime(day, '%m-%d') = '08-01') group by label", "series")
def _(g, spark):
    daily = stats.daily(g.coarse, "tas", "coarse")
    return calendar.series_frequency(_series(g).unionByName(calendar.on_date(daily, AUGUST).withColumn("label", F.lit("yearly"))))


@_query("series_labels", "select label, row_number() over (order by min(day), label) - 1 as pos from series group by label", "series")
def _(g, spark):
    return calendar.labels_in_order(_series(g), "day")


@_query("global_weighted_mean", f"select {DAY}, [[sum(cos(radians(cmip_lat)) * tas) / sum(cos(radians(cmip_lat))) ]] as value from coarse group by day", "coarse")
def _(g, spark):
    return stats.weighted_daily_mean(g.coarse, "tas", "cmip_lat")


# --- distributions

_VALUES = "select 'fine' as label, t2m as v from fine where t2m is not null union all select 'coarse', tas from coarse"


def _values(g: Grids) -> DataFrame:
    return g.fine.select(F.lit("fine").alias("label"), F.col("t2m").alias("v")).unionByName(g.coarse.select(F.lit("coarse").alias("label"), F.col("tas").alias("v"))).filter("v is not null")


def _main_sql(label: str, c: str) -> str:
    metrics = {"min": f"min({c})", "mean": f"avg({c})", "sd": f"stddev_pop({c})", "max": f"max({c})", "days": "count(distinct day)::double", "values": f"count({c})::double", "iqr": f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"}
    metrics |= {f"p{p}": f"quantile_cont({c}, {p / 100})" for p in PERCENTILES}
    return " union all ".join(f"select '{label}' as dataset, '{k}' as metric, [[{v}]] as value from {label}" for k, v in metrics.items())


@_query("main_statistics", _main_sql("fine", "t2m") + " union all " + _main_sql("coarse", "tas"), "fine", "coarse")
def _(g, spark):
    return stats.main_statistics(g.fine, "t2m", "fine").unionByName(stats.main_statistics(g.coarse, "tas", "coarse"))


_REPORT = [("min", "min({c})"), ("p25", "quantile_cont({c}, 0.25)"), ("p50", "quantile_cont({c}, 0.5)"), ("mean", "avg({c})"), ("sd", "stddev_pop({c})"), ("iqr", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"), ("p75", "quantile_cont({c}, 0.75)"), ("p90", "quantile_cont({c}, 0.9)"), ("max", "max({c})"), ("days", "count(distinct day)::double")]
_LAND = "(select count(*) from (select 1 from fine group by lat_ix, lon_ix having count(t2m) > 0))"


@_query(
    "main_report",
    " union all ".join(f"select {k}::bigint as pos, '{m}' as metric, [[(select {x.format(c='t2m')} from fine)]] as fine, [[(select {x.format(c='tas')} from coarse)]] as coarse" for k, (m, x) in enumerate(_REPORT))
    + f" union all select 10, 'land_pixels', [[{_LAND}::double]], null union all select 11, 'missing_fraction', [[1 - {_LAND} / 11421.0::double]], 0.0::double",
    "fine", "coarse",
)
def _(g, spark):
    return stats.main_report(g.fine, g.coarse, 141 * 81)


_BIN = "greatest(0, least(k - case when v < low + k * step then 1 else 0 end + case when v >= low + (k + 1) * step then 1 else 0 end, 298))"


@_query(
    "histogram_density",
    f"""select label, bin::bigint as bin, [[low + bin * step]] as lo, [[low + (bin + 1) * step]] as hi, n, [[n / (sum(n) over (partition by label) * step)]] as density
    from (select label, {_BIN} as bin, low, step, count(*) as n from (select label, v, low, step, floor((v - low) / step)::bigint as k from ({_VALUES}), (select min(v) as low, (max(v) - min(v)) / 299 as step from ({_VALUES}))) group by all)""",
    "fine", "coarse",
)
def _(g, spark):
    return stats.histogram(_values(g), "v")


@_query("distribution_percentiles", " union all ".join(f"select label, {p}::bigint as percent, [[quantile_cont(v, {p / 100})]] as value from ({_VALUES}) group by label" for p in PERCENTILES), "fine", "coarse")
def _(g, spark):
    return stats.quantiles(_values(g), ["label"], "v", bound=2)


def _box_sql(source: str, keys: str, v: str) -> str:
    on = " and ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    own = ", ".join(f"b.{k.strip()}" for k in keys.split(","))
    return f"""select {own}, b.n, q1, median, q3, min(a.{v}) filter (a.{v} >= q1 - 1.5 * (q3 - q1)) as whisker_lo, max(a.{v}) filter (a.{v} <= q3 + 1.5 * (q3 - q1)) as whisker_hi
      from (select {keys}, count({v}) as n, quantile_cont({v}, 0.25) as q1, quantile_cont({v}, 0.5) as median, quantile_cont({v}, 0.75) as q3 from ({source}) group by {keys}) b
      join ({source}) a on {on} group by {own}, b.n, q1, median, q3"""


_BOX = "n, [[q1]] as q1, [[median]] as median, [[q3]] as q3, [[whisker_lo]] as whisker_lo, [[whisker_hi]] as whisker_hi"


@_query("boxplot_stats", f"select label, {_BOX} from ({_box_sql(_VALUES, 'label', 'v')})", "fine", "coarse")
def _(g, spark):
    return stats.box_statistics(_values(g), ["label"], "v", bound=2)


@_query(
    "hexbin",
    """select [[x0 + i * sx]] as x, [[y0 + j * sy]] as y, count(*) as n from (
      select x0, sx, y0, sy, case when d1 < d2 then floor(u + 0.5) else floor(u) + 0.5 end as i, case when d1 < d2 then floor(w + 0.5) else floor(w) + 0.5 end as j from (
        select *, pow(u - floor(u + 0.5), 2) + 3.0 * pow(w - floor(w + 0.5), 2) as d1, pow(u - (floor(u) + 0.5), 2) + 3.0 * pow(w - (floor(w) + 0.5), 2) as d2 from (
          select *, (tas - x0) / sx as u, (t2m - y0) / sy as w from paired, (select min(tas) as x0, (max(tas) - min(tas)) / 60 as sx, min(t2m) as y0, (max(t2m) - min(t2m)) / 34 as sy from paired)))) group by x0, sx, y0, sy, i, j""",
    "paired",
)
def _(g, spark):
    f = _folded(g).filter(E.is_finite(F.col("tas")))
    span = f.agg(F.min("tas").alias("x0"), F.max("tas").alias("x1"), F.min("low").alias("y0"), F.max("high").alias("y1"))
    return stats.hexagons(_pairs(g), "tas", "t2m", span=span)


# --- models


@_query("ols_fit", "select [[slope]] as slope, [[intercept]] as intercept, [[(select corr(t2m, tas) from paired)]] as r, (select count(*) from paired) as n from model", "model", "paired")
def _(g, spark):
    return _model(g).select("slope", "intercept", "r", "n")


@_query("ols_residuals", f"select {_PAIR}, {DAY}, [[residual]] as residual from resid", "resid")
def _(g, spark):
    return _resid(g).select(*_FOUR, "day", "residual")


@_query("residual_sd", "select [[stddev_samp(residual)]] as sd, [[avg(residual)]] as mean, count(*) as n from resid", "resid")
def _(g, spark):
    return _resid(g).agg(F.stddev_samp("residual").alias("sd"), F.avg("residual").alias("mean"), F.count("*").alias("n"))


@_query("mean_residual_map", f"select {_PIXEL}, [[m]] as mean_std_residual from pixels left join (select era5_lat, era5_lon, avg(residual / sd) as m from resid, (select stddev_samp(residual) as sd from resid) group by all) using (era5_lat, era5_lon)", "pixels", "resid")
def _(g, spark):
    means = regression.mean_standardized(_pairs(g), _model(g))
    return grid.on_grid(g.pixels, means.select("lat_ix", "lon_ix", "mean_std_residual"), ["lat_ix", "lon_ix"]).select("era5_lat", "era5_lon", "mean_std_residual")


@_query("residual_limits", "select [[-quantile_cont(abs(m), 0.98)]] as vmin, [[quantile_cont(abs(m), 0.98)]] as vmax from (select avg(residual / sd) as m from resid, (select stddev_samp(residual) as sd from resid) group by era5_lat, era5_lon)", "resid")
def _(g, spark):
    return stats.symmetric_limits(regression.mean_standardized(_pairs(g), _model(g)), "mean_std_residual")


def _means(g: Grids) -> DataFrame:
    return pairing.means_of_folded(_folded(g))


_MEANS = "select cmip_lat, cmip_lon, day, tas, avg(t2m) as t2m_mean from paired where tas is not null group by all"


@_query("cell_day_means", f"select {_CELL}, {DAY}, [[tas]] as tas, [[t2m_mean]] as t2m_mean from ({_MEANS})", "paired")
def _(g, spark):
    return _means(g).select(*_TWO, "day", "tas", "t2m_mean")


@_query("cell_day_ols", f"select [[regr_slope(t2m_mean, tas)]] as slope, [[regr_intercept(t2m_mean, tas)]] as intercept, [[corr(t2m_mean, tas)]] as r, count(*) as n from ({_MEANS})", "paired")
def _(g, spark):
    return regression.fit(_means(g), "tas", "t2m_mean")


@_query("regression_line", f"select i, [[x]] as x, [[slope * x + intercept]] as y from (select i, lo + i * ((hi - lo) / 199) as x, slope, intercept from (select range as i from range(200)), (select min(tas) as lo, max(tas) as hi, regr_slope(t2m_mean, tas) as slope, regr_intercept(t2m_mean, tas) as intercept from ({_MEANS})))", "paired")
def _(g, spark):
    return regression.line_samples(_means(g), "tas", "t2m_mean")


_MARKS = "case when i = {n} then hi else lo + i * ((hi - lo) / {n}) end"


@_query(
    "resid_by_distance",
    f""",
far as (select residual, {_DIST} as d from resid),
    e as (select i::bigint as bin, {_MARKS.format(n=19)} as lo_, case when i + 1 = 19 then hi else lo + (i + 1) * ((hi - lo) / 19) end as hi_ from (select range as i from range(19)), (select min(d) as lo, max(d) as hi from far))
    select bin, [[lo_]] as lo, [[hi_]] as hi, count(residual) as n, [[avg(residual)]] as mean from e left join far on d > lo_ and d <= hi_ group by bin, lo_, hi_""",
    "resid",
)
def _(g, spark):
    distances = grid.distance_to_center(_assigned(g).filter("is_land"))
    p = _pairs(g)
    return regression.residuals_by_distance(pairing.with_distance(p, distances), model=_model(g))



def _by_cell_sql(edges: str, column: str, n: int) -> str:
    rows = f"select least((select count(*) from edge where k > 0 and e < {column}), {n - 1}) as bin, r.residual, r.cmip_lat, r.cmip_lon from resid r join stats using (cmip_lat, cmip_lon)"
    return f""",
edge as ({edges}), rows_ as ({rows}), box as ({_box_sql('select * from rows_', 'bin', 'residual')})
select a.k::bigint as bin, [[a.e]] as lo, [[b.e]] as hi, coalesce((select count(distinct (cmip_lat, cmip_lon)) from rows_ where rows_.bin = a.k), 0) as n_cells, coalesce(n, 0) as n, [[q1]] as q1, [[median]] as median, [[q3]] as q3, [[whisker_lo]] as whisker_lo, [[whisker_hi]] as whisker_hi
from edge a join edge b on b.k = a.k + 1 left join box on box.bin = a.k"""


@_query("resid_by_sea_fraction", _by_cell_sql("select range as k, case when range = 5 then 1.0::double else range * 0.2::double end as e from range(6)", "sea_fraction", 5), "resid", "stats")
def _(g, spark):
    return regression.residuals_by_cell_bin(_resid(g), _stats(g), "sea_fraction", regression.sea_fraction_edges())


@_query("resid_by_pixel_count", _by_cell_sql("select range as k, (select quantile_cont(n_land_pixels, [0, 0.2, 0.4, 0.6, 0.8, 1]) from stats)[range + 1] - case when range = 0 then 1 else 0 end as e from range(6)", "n_land_pixels", 5), "resid", "stats")
def _(g, spark):
    s = _stats(g)
    return regression.residuals_by_cell_bin(_resid(g), s, "n_land_pixels", regression.pixel_count_edges(s))



@_query("resid_by_season", f"select season, {_BOX} from ({_box_sql(f'select {_SEASON} as season, residual from resid', 'season', 'residual')})", "resid")
def _(g, spark):
    return stats.box_statistics(calendar.with_season(_resid(g)).select("season", "residual"), ["season"], "residual", bound=4)


@_query("resid_by_month", f"select month, {_BOX} from ({_box_sql('select month(day) as month, residual from resid', 'month', 'residual')})", "resid")
def _(g, spark):
    return stats.box_statistics(_resid(g).select(F.month("day").alias("month"), "residual"), ["month"], "residual", bound=12)


_INDEXED = "select label, strftime(day, '%m-%d') as date, day, value, (row_number() over (partition by label, strftime(day, '%m-%d') order by day) - 1)::double as x from ({s}) where strftime(day, '%m-%d') in ({d})"
_QUARTERS = ", ".join(f"'{q}'" for q in QUARTERS)


@_query("quarterly_trend", f"select label, date, count(value) as n, [[regr_slope(value, x)]] as slope, [[regr_intercept(value, x)]] as intercept from ({_INDEXED.format(s='select * from series', d=_QUARTERS)}) group by label, date having count(value) >= 2", "series")
def _(g, spark):
    return regression.trends(_series(g), QUARTERS)


@_query("august_trend", f"select label, date, count(value) as n, [[regr_slope(value, x)]] as slope, [[regr_intercept(value, x)]] as intercept from ({_INDEXED.format(s=_POINT + ' ', d=repr(AUGUST))}) group by label, date having count(value) >= 2", "fine", "coarse", "lat", "lon", "clat", "clon")
def _(g, spark):
    return regression.trends(_point_series(g), [AUGUST])


_T = " ".join(f"when {n} then {E.t_quantile(0.95, n - 2)!r}::double" for n in range(3, 31))


@_query(
    "trend_confidence_band",
    f"""select label, date, {DAY}, [[fit]] as fit, [[fit - t * se]] as lo, [[fit + t * se]] as hi from (
      select label, date, day, slope * x + intercept as fit, case n {_T} end as t, sqrt(greatest(0, sse) / (n - 2)) * sqrt(1.0::double / n + pow(x - mx, 2) / sxx) as se from ({_INDEXED.format(s='select * from series', d=_QUARTERS)})
      join (select label, date, count(value) as n, regr_slope(value, x) as slope, regr_intercept(value, x) as intercept, regr_avgx(value, x) as mx, regr_sxx(value, x) as sxx, regr_syy(value, x) - pow(regr_sxy(value, x), 2) / regr_sxx(value, x) as sse
        from ({_INDEXED.format(s='select * from series', d=_QUARTERS)}) group by label, date having count(value) >= 3) using (label, date))""",
    "series",
)
def _(g, spark):
    return regression.trend_band(spark, _series(g), QUARTERS)


# --- bins, labels, reports

_V = "select ((l_orderkey * 10 + l_linenumber) % 101)::double as v from lineitem"
_EDGES = [0.0, 10.0, 10.0, 25.0, 60.0, 90.0]


def _bin_sql(bin_: str) -> str:
    return f"select v, coalesce({bin_}, -1)::bigint as bin, count(*) as n from ({_V}) group by all"


def _bin_values(spark: SparkSession, sf_dir: str, f) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(((F.col("l_orderkey") * 10 + F.col("l_linenumber")) % 101).cast("double").alias("v"))
    return _plain(v.groupBy("v", F.coalesce(f(F.col("v"), _EDGES), F.lit(-1)).alias("bin")).agg(F.count("*").alias("n")))


_LIST = "[" + ", ".join(f"{e}::double" for e in _EDGES) + "]"
for _name, _f, _case in (
    ("bins_left", E.bin_left, f"least(len(list_filter({_LIST}[2:], lambda e: e < v)), 4)"),
    ("bins_histogram", E.bin_histogram, f"case when v between 0 and 90 then least(len(list_filter({_LIST}, lambda e: e <= v)) - 1, 4) end"),
    ("bins_cut", E.bin_cut, f"case when v > 0 and v <= 90 then len(list_filter({_LIST}, lambda e: e < v)) - 1 end"),
):
    QUERIES[_name] = lambda spark, sf_dir, f=_f: _bin_values(spark, sf_dir, f)
    ORACLE_SQL[_name] = _bin_sql(_case)


@_query(
    "axis_labels",
    """select lat_ix::bigint as ix, case when round_even(era5_lat, 0) >= 0 then round_even(era5_lat, 0)::int || '°N' else (-round_even(era5_lat, 0)::int) || '°S' end as lat_label,
      case when round_even(era5_lat - 31, 0) >= 0 then round_even(era5_lat - 31, 0)::int || '°E' else (-round_even(era5_lat - 31, 0)::int) || '°W' end as lon_label, trunc(era5_lat - 31)::int || '°' as temp_label from lat""",
    "lat",
)
def _(g, spark):
    return g.lats.select(F.col("lat_ix").alias("ix"), E.latitude_label(F.col("era5_lat")).alias("lat_label"), E.longitude_label(F.col("era5_lat") - 31).alias("lon_label"), E.temperature_label(F.col("era5_lat") - 31).alias("temp_label"))


_TICKS = "select unnest(generate_series(ceil(min({c}) / 2)::int * 2, floor(max({c}) / 2)::int * 2, 2))::bigint as tick, '{a}' as axis from {t}"


@_query("map_ticks", " union all ".join(_TICKS.format(c=c, a=a, t=a) for c, a in (("era5_lat", "lat"), ("era5_lon", "lon"))), "lat", "lon")
def _(g, spark):
    tick = lambda axis, c, name: axis.agg(F.min(c).alias("lo"), F.max(c).alias("hi")).select(F.explode(E.ticks(F.col("lo"), F.col("hi"), 2)).alias("tick"), F.lit(name).alias("axis"))
    return tick(g.lats, "era5_lat", "lat").unionByName(tick(g.lons, "era5_lon", "lon"))


@_query("map_aspect", "select lat_ix::bigint as ix, [[1 / cos(radians((era5_lat + 38.0) / 2))]] as aspect from lat", "lat")
def _(g, spark):
    return g.lats.select(F.col("lat_ix").alias("ix"), E.map_aspect(F.col("era5_lat"), F.lit(38.0)).alias("aspect"))


@_query("axis_extents", "select [[min(era5_lat)]] as lat_min, [[max(era5_lat)]] as lat_max, [[min(era5_lon)]] as lon_min, [[max(era5_lon)]] as lon_max from fine", "fine")
def _(g, spark):
    return g.fine.agg(F.min("era5_lat").alias("lat_min"), F.max("era5_lat").alias("lat_max"), F.min("era5_lon").alias("lon_min"), F.max("era5_lon").alias("lon_max"))


@_query("value_ranges", "select 'fine' as label, [[min(t2m)]] as min, [[avg(t2m)]] as mean, [[max(t2m)]] as max from fine union all select 'coarse', [[min(tas)]], [[avg(tas)]], [[max(tas)]] from coarse", "fine", "coarse")
def _(g, spark):
    one = lambda df, c, label: stats.ranges(df, F.col(c)).select(F.lit(label).alias("label"), "*")
    return one(g.fine, "t2m", "fine").unionByName(one(g.coarse, "tas", "coarse"))


_SIZE = "(c_custkey * c_custkey * 131071)::bigint"


def _transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", (F.col("c_custkey") * F.col("c_custkey") * 131071).alias("size"))
    rate = (F.col("c_custkey") % 25).cast("double")
    return c.select(F.col("c_custkey").cast("long").alias("c_custkey"), E.format_bytes(F.col("size")).alias("size_text"), E.transfer_estimate(F.col("size"), rate).alias("eta"))


QUERIES["transfer_report"] = _transfer
_UNITS = " ".join(f"when size < {1024 ** (k + 1)} then printf('%.1f {u}', size / {float(1024**k)}::double)" for k, u in enumerate(("B", "KB", "MB", "GB")))
ORACLE_SQL["transfer_report"] = f"""select c_custkey::bigint as c_custkey, case {_UNITS} else printf('%.1f TB', size / {float(1024**4)}::double) end as size_text,
  case when s < 60 then printf('%.1f sec', s) else printf('%.1f min', s / 60) end as eta
  from (select *, case when rate > 0 then size / (rate * 1048576.0::double) else 0.0 end as s from (select c_custkey, {_SIZE} as size, (c_custkey % 25)::double as rate from customer))"""


def _work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    return tables.new_path(spark, f"isotherm-{name}")


def _fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each nation, fetched unless it is there; one in five is, and one in five is not to be found."""
    folder = _work_folder(spark, "fetch")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("int").alias("k"), "n_name").filter("k % 5 != 1")
    nations.coalesce(1).write.partitionBy("k").text(f"{folder}/from")
    want = lambda k, contains: transfer.Request(f"n{k}", f"{folder}/to/{k}.txt", (f"{folder}/none", f"{folder}/from"), "part-*.txt", contains)
    every = [want(k, f"/K={k}/") for k in range(25)]
    transfer.fetch_missing(spark, every[::5]).collect()
    return transfer.fetch_missing(spark, every).select("label", "status", "length", "size_text")


QUERIES["fetch_missing"] = _fetched
ORACLE_SQL["fetch_missing"] = """select 'n' || n_nationkey as label, case n_nationkey % 5 when 0 then 'skipped' when 1 then 'missing' else 'copied' end as status,
  case when n_nationkey % 5 <> 1 then length(n_name) + 1 end::bigint as length, case when n_nationkey % 5 <> 1 then printf('%.1f B', (length(n_name) + 1)::double) end as size_text from nation"""


# --- beyond the study's own analyses


@_query("ols_by_cell", f"select {_CELL}, [[case when count(*) > 2 then regr_slope(t2m, tas) end]] as slope, [[case when count(*) > 2 then regr_intercept(t2m, tas) end]] as intercept, count(*) as n from paired group by cmip_lat, cmip_lon", "paired")
def _(g, spark):
    enough = lambda c: F.when(F.col("n") > 2, F.col(c)).alias(c)
    return extensions.fit_by_cell(_pairs(g)).select("cmip_lat", "cmip_lon", enough("slope"), enough("intercept"), "n")


@_query("lagged_tas", f"select clat_ix::bigint as clat_ix, clon_ix::bigint as clon_ix, {DAY}, [[case when lag(day) over w = day - 1 then lag(tas) over w end]] as tas_before, [[case when lead(day) over w = day + 1 then lead(tas) over w end]] as tas_after from coarse window w as (partition by clat_ix, clon_ix order by day)", "coarse")
def _(g, spark):
    return extensions.lagged(g.coarse).select("clat_ix", "clon_ix", "day", "tas_before", "tas_after")


@_query("neighbour_tas", f"select a.clat_ix::bigint as clat_ix, a.clon_ix::bigint as clon_ix, strftime(a.day, '%Y-%m-%d') as day, [[avg(b.tas)]] as tas_neighbours from coarse a join coarse b on a.day = b.day and abs(a.clat_ix - b.clat_ix) + abs(a.clon_ix - b.clon_ix) = 1 group by all", "coarse")
def _(g, spark):
    return extensions.neighbour_mean(g.coarse).select("clat_ix", "clon_ix", "day", "tas_neighbours")


@_query("difference_series", f"select {DAY}, [[a.value - b.value]] as difference from (select * from series where label = 'fine') a join (select * from series where label = 'coarse') b using (day)", "series")
def _(g, spark):
    return extensions.difference(stats.daily(g.fine, "t2m", "fine"), stats.daily(g.coarse, "tas", "coarse"))


@_query("serial_correlation", "select label, [[sum(pow(e - p, 2)) / sum(e * e)]] as durbin_watson, [[sum(e * p) / sum(e * e)]] as acf_1, [[sum(e * p7) / sum(e * e)]] as acf_7 from (select *, lag(e) over (partition by label order by day) as p, lag(e, 7) over (partition by label order by day) as p7 from (select *, value - avg(value) over (partition by label) as e from series)) group by label", "series")
def _(g, spark):
    return extensions.serial_correlation(_series(g), (1, 7))


@_query("skill_map", f"select {_PIXEL}, count(*) as n, [[avg(tas - t2m)]] as bias, [[sqrt(avg((tas - t2m) * (tas - t2m)))]] as rmse, [[case when stddev_pop(t2m) > 0 and stddev_pop(tas) > 0 then covar_pop(t2m, tas) / (stddev_pop(t2m) * stddev_pop(tas)) end]] as correlation from paired group by era5_lat, era5_lon", "paired")
def _(g, spark):
    return extensions.skill(_pairs(g)).drop("lat_ix", "lon_ix")


_ACF = "select label, " + ", ".join(f"sum(e * e_{k}) / sum(e * e) as r{k}" for k in (1, 2, 3)) + " from (select *, " + ", ".join(f"lag(e, {k}) over (partition by label order by day) as e_{k}" for k in (1, 2, 3)) + " from (select *, value - avg(value) over (partition by label) as e from series)) group by label"


@_query("partial_autocorrelation", f"select label, [[r1]] as pacf_1, [[p2]] as pacf_2, [[(r3 - a1 * r2 - p2 * r1) / (1 - a1 * r1 - p2 * r2)]] as pacf_3 from (select *, (r2 - r1 * r1) / (1 - r1 * r1) as p2, r1 * (1 - r2) / (1 - r1 * r1) as a1 from ({_ACF}))", "series")
def _(g, spark):
    return extensions.partial_autocorrelation(_series(g))


_CDF_TAIL = "(((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-x * x) / 2)"


@_query(
    "residual_normality",
    f"""select n, [[d]] as d, [[least(1.0, greatest(0.0, list_sum(list_transform(range(1, 101), lambda k: case when k % 2 = 1 then 2.0 else -2.0 end * exp(-2.0 * k * k * n * d * d)))))]] as p from (
      select max(n) as n, max(greatest(i / n - f, f - (i - 1) / n)) as d from (
        select n, i::double as i, case when z < 0 then {_CDF_TAIL} else 1 - {_CDF_TAIL} end as f from (select *, 1.0::double / (1.0 + 0.3275911::double * x) as t from (
          select z, abs(z) / sqrt(2.0::double) as x, count(*) over () as n, row_number() over (order by z) as i from (select (residual - (select avg(residual) from resid)) / (select stddev_samp(residual) from resid) as z from resid)))))""",
    "resid",
)
def _(g, spark):
    return extensions.normality(_resid(g), "residual")


@_query(
    "random_intercept",
    """select n, n_cells, [[v]] as var_cell, [[e]] as var_error, [[v / (v + e)]] as icc from (select n, n_cells, e, greatest(0, (b - e) / size) as v from (
      select sum(m)::bigint as n, count(*) as n_cells, sum(ss) / (sum(m) - count(*)) as e, sum(m * pow(mean - (select avg(residual) from resid), 2)) / (count(*) - 1) as b, (sum(m) - sum(m * m)::double / sum(m)) / (count(*) - 1) as size
      from (select count(*) as m, avg(residual) as mean, count(*) * var_pop(residual) as ss from resid group by cmip_lat, cmip_lon)))""",
    "resid",
)
def _(g, spark):
    return extensions.random_intercept(_resid(g))


@_query(
    "interaction_fit",
    """,
p as (select t2m as y, tas as x1, sea_fraction as x2, tas * sea_fraction as x3 from paired join sea using (cmip_lat, cmip_lon)),
m as (select avg(y) as my, avg(x1) as m1, avg(x2) as m2, avg(x3) as m3, regr_slope(x2, x1) as b21, regr_slope(x3, x1) as b31, regr_slope(y, x1) as by1 from p),
e as (select y - my as yc, x2 - m2 - b21 * (x1 - m1) as e2, x3 - m3 - b31 * (x1 - m1) as f3 from p, m),
b as (select sum(f3 * e2) / sum(e2 * e2) as b32, sum(yc * e2) / sum(e2 * e2) as by2 from e),
c as (select sum(yc * (f3 - b32 * e2)) / sum(pow(f3 - b32 * e2, 2)) as c3 from e, b),
d as (select c3, by2 - c3 * b32 as c2, by1 - (by2 - c3 * b32) * b21 - c3 * b31 as c1, * from m, b, c)
select 'tas' as term, [[c1]] as coefficient from d union all select 'sea_fraction', [[c2]] from d union all select 'tas:sea_fraction', [[c3]] from d union all select 'intercept', [[my - c1 * m1 - c2 * m2 - c3 * m3]] from d""",
    "paired", "sea",
)
def _(g, spark):
    sea = grid.sea_fraction(_assigned(g)).select("clat_ix", "clon_ix", "sea_fraction")
    rows = _pairs(g).join(sea, ["clat_ix", "clon_ix"])
    return extensions.multiple_regression(rows, "t2m", {"tas": F.col("tas"), "sea_fraction": F.col("sea_fraction"), "tas:sea_fraction": F.col("tas") * F.col("sea_fraction")})


_MODELS = "select 'a' as model, tas, t2m from paired union all select 'b', 0.5 * tas + clat_ix, t2m from paired join clat using (cmip_lat)"


@_query("ols_by_model", f"select model, [[regr_slope(t2m, tas)]] as slope, [[regr_intercept(t2m, tas)]] as intercept, [[corr(t2m, tas)]] as r, count(*) as n from ({_MODELS}) group by model", "paired", "clat")
def _(g, spark):
    second = g.coarse.withColumn("tas", 0.5 * F.col("tas") + F.col("clat_ix")).withColumn("model", F.lit("b"))
    both = g.coarse.withColumn("model", F.lit("a")).unionByName(second)
    folded = pairing.folded_pairs(g.fine, both, axes=(COARSE_LATS, COARSE_LONS))
    return regression.fit_folded(folded, keys=["model"]).select("model", "slope", "intercept", "r", "n")


@_query("pairs_by_model", f"select model, count(*) as n, [[sum(tas)]] as tas, [[sum(t2m)]] as t2m from ({_MODELS}) group by model", "paired", "clat")
def _(g, spark):
    second = g.coarse.withColumn("tas", 0.5 * F.col("tas") + F.col("clat_ix")).withColumn("model", F.lit("b"))
    both = g.coarse.withColumn("model", F.lit("a")).unionByName(second)
    return pairing.paired(g.fine, both, axes=(COARSE_LATS, COARSE_LONS)).groupBy("model").agg(F.count("*").alias("n"), F.sum("tas").alias("tas"), F.sum("t2m").alias("t2m"))


@_query(
    "display_sample",
    f"""select {DAY}, lat_ix::bigint as lat_ix, lon_ix::bigint as lon_ix, [[t2m]] as t2m from fine, (select count(*) as size from fine)
      where ('0x' || substr(md5(lat_ix || '|' || lon_ix || '|' || strftime(day, '%Y-%m-%d') || '|42'), 1, 8))::bigint / 4294967296.0::double * size < 500""",
    "fine",
)
def _(g, spark):
    return stats.export_sample(g.fine, 500, by=["lat_ix", "lon_ix", "day"]).select("day", "lat_ix", "lon_ix", "t2m")


_TEXT = "case o_orderkey % 4 when 0 then strftime(o_orderdate::date, '%Y-%m-%d') when 1 then strftime(o_orderdate::date, '%Y-%m-%d') || 'T12:00:00' when 2 then 'n/a' else strftime(o_orderdate::date, '%d/%m/%Y') end"


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    kinds = [E.day_text(day), F.concat(E.day_text(day), F.lit("T12:00:00")), F.lit("n/a"), F.date_format(day, "dd/MM/yyyy")]
    text = F.get(F.array(*kinds), (F.col("o_orderkey") % 4).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(E.parse_day(text).alias("day"))
    return _plain(rows.groupBy("day").agg(F.count("*").alias("n")))


QUERIES["parse_dates"] = _parsed
ORACLE_SQL["parse_dates"] = f"select strftime(try_cast(substr(t, 1, 10) as date), '%Y-%m-%d') as day, count(*) as n from (select {_TEXT} as t from orders) group by 1"


@_query("time_split", "select split, count(*) as n, min(doy) as first_doy, max(doy) as last_doy from (select case when year(day) <= 1995 then 'train' when year(day) <= 1996 then 'validation' else 'test' end as split, dayofyear(day) as doy from paired) group by split", "paired")
def _(g, spark):
    return extensions.with_split(_pairs(g), 1995, 1996).groupBy("split").agg(F.count("*").alias("n"), F.min("day_of_year").alias("first_doy"), F.max("day_of_year").alias("last_doy"))


@_query("daily_predictor", "select count(*) as n, [[avg(g)]] as predictor, [[corr(t2m, g)]] as r from paired left join (select day, sum(cos(radians(cmip_lat)) * tas) / sum(cos(radians(cmip_lat))) as g from coarse group by day) using (day)", "paired", "coarse")
def _(g, spark):
    p = extensions.with_daily_predictor(_pairs(g), stats.weighted_daily_mean(g.coarse, "tas", "cmip_lat"))
    return p.agg(F.count("*").alias("n"), F.avg("global_mean_tas").alias("predictor"), F.corr("t2m", "global_mean_tas").alias("r"))


_CORNER = "(case when c.clat_ix = i then 1 - u else u end) * (case when c.clon_ix = j then 1 - v else v end)"


_SEASON_FIELD = f"select {_SEASON} as season, clat_ix, clon_ix, avg(tas) as tas from coarse group by all"


def _season_field(g: Grids) -> DataFrame:
    return stats.seasonal_mean(g.coarse, ["clat_ix", "clon_ix"], "tas").withColumnRenamed("mean", "tas")


@_query(
    "bilinear_tas",
    f"""select lat_ix::bigint as lat_ix, lon_ix::bigint as lon_ix, season, [[sum({_CORNER} * tas)]] as tas from (
      select lat_ix, lon_ix, i, j, (era5_lat - a.cmip_lat) / (b.cmip_lat - a.cmip_lat) as u, (era5_lon - c1.cmip_lon) / (c2.cmip_lon - c1.cmip_lon) as v from (
        select *, least((select count(*) from clat where cmip_lat <= era5_lat) - 1, 15) as i, least((select count(*) from clon where cmip_lon <= era5_lon) - 1, 7) as j from pixels
          where era5_lat between (select min(cmip_lat) from clat) and (select max(cmip_lat) from clat) and era5_lon between (select min(cmip_lon) from clon) and (select max(cmip_lon) from clon)) p
      join clat a on a.clat_ix = i join clat b on b.clat_ix = i + 1 join clon c1 on c1.clon_ix = j join clon c2 on c2.clon_ix = j + 1) q
    join ({_SEASON_FIELD}) c on c.clat_ix in (i, i + 1) and c.clon_ix in (j, j + 1) group by lat_ix, lon_ix, season""",
    "pixels", "coarse", "clat", "clon",
)
def _(g, spark):
    return extensions.bilinear(g.pixels, _season_field(g), COARSE_LATS, COARSE_LONS, by="season")


def _overlap_sql(fine: str, ix: str, coord: str, coarse: str, cix: str, ccoord: str, step: float) -> str:
    edges = f"select {cix}, {ccoord} - {step / 2!r}::double as a, {ccoord} + {step / 2!r}::double as b from {coarse}"
    return f"select {ix}, {cix}, least(b, {coord} + 0.05::double) - greatest(a, {coord} - 0.05::double) as w from {fine}, ({edges}) where least(b, {coord} + 0.05::double) - greatest(a, {coord} - 0.05::double) > 1e-9"


@_query(
    "area_weighted_tas",
    f"""select a.lat_ix::bigint as lat_ix, b.lon_ix::bigint as lon_ix, season, [[sum(a.w * b.w * tas) / sum(a.w * b.w)]] as tas from ({_overlap_sql('lat', 'lat_ix', 'era5_lat', 'clat', 'clat_ix', 'cmip_lat', 0.942408)}) a,
      ({_overlap_sql('lon', 'lon_ix', 'era5_lon', 'clon', 'clon_ix', 'cmip_lon', 1.25)}) b, ({_SEASON_FIELD}) c, pixels p where a.clat_ix = c.clat_ix and b.clon_ix = c.clon_ix and p.lat_ix = a.lat_ix and p.lon_ix = b.lon_ix group by a.lat_ix, b.lon_ix, season""",
    "coarse", "lat", "lon", "clat", "clon", "pixels",
)
def _(g, spark):
    return extensions.area_weighted(g.pixels, _season_field(g), COARSE_LATS, COARSE_LONS, 0.1, by="season")


_NEAR = "cell_field a join cell_field b on abs(a.lat_ix - b.lat_ix) + abs(a.lon_ix - b.lon_ix) = 1"


@_query(
    "morans_i",
    f"""select count(*) as n, [[count(*) * (select sum((a.v - c) * (b.v - c)) from {_NEAR}, (select avg(v) as c from cell_field)) / ((select count(*) from {_NEAR}) * sum(pow(v - (select avg(v) from cell_field), 2)))]] as morans_i
      from cell_field""",
    "cell_field",
)
def _(g, spark):
    means = stats.temporal_mean(g.coarse, ["clat_ix", "clon_ix"], "tas")
    return extensions.morans_i(means.select(F.col("clat_ix").alias("lat_ix"), F.col("clon_ix").alias("lon_ix"), F.col("mean").alias("v")), "v")


@_query("height", "select lat_ix::bigint as ix, [[era5_lat * 1000 / 9.80665::double]] as height from lat", "lat")
def _(g, spark):
    return g.lats.select(F.col("lat_ix").alias("ix"), extensions.height(F.col("era5_lat") * 1000).alias("height"))


@_query(
    "percent_labels",
    """select bin, (bin * 20) || '–' || ((bin + 1) * 20) || '%' as label, count(*) as n from (
      select least(len(list_filter([0.2::double, 0.4::double, 0.6::double, 0.8::double, 1.0::double], lambda e: e < sea_fraction)), 4)::bigint as bin from sea) group by bin""",
    "sea",
)
def _(g, spark):
    edges = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
    bins = grid.sea_fraction(_assigned(g)).select(E.bin_left(F.col("sea_fraction"), edges).alias("bin"))
    low = F.round(F.col("bin") / 5, 6)
    return bins.groupBy("bin").agg(F.count("*").alias("n")).select("bin", E.percent_bin_label(low, F.round((F.col("bin") + 1) / 5, 6)).alias("label"), "n")


from . import models  # noqa: E402,F401  registers the queries of models
