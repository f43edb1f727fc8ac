"""Gridded records derived from the driver's tables, in Spark and in SQL by the same formulas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_LAT, N_LON, N_CLAT, N_CLON = 141, 81, 17, 9
COARSE_LATS, COARSE_LONS = [23.089005 + i * 0.942408 for i in range(N_CLAT)], [28.75 + j * 1.25 for j in range(N_CLON)]


@dataclass(frozen=True)
class Grids:
    fine: DataFrame
    coarse: DataFrame
    pixels: DataFrame
    lats: DataFrame
    lons: DataFrame
    clats: DataFrame
    clons: DataFrame
    points: DataFrame


def grids(spark: SparkSession, sf_dir: str) -> Grids:
    """fine: pixels with parts of the line items as values, sea without; coarse: a field for each order day.

    pixels: the grid's points that the fine record has, sea too; the axes are those of the two records.
    points: all points of the fine grid, whether the record has them or not.
    """
    at = {"lat_ix": (F.col("l_partkey") % N_LAT).cast("int"), "lon_ix": ((F.col("l_partkey") * 7) % N_LON).cast("int"), "day": F.to_date("l_shipdate")}
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_quantity", *(c.alias(k) for k, c in at.items()))
    means = raw.groupBy("lat_ix", "lon_ix", "day").agg(F.avg("l_quantity").alias("q"))
    fine = means.select(
        "lat_ix", "lon_ix", (F.lit(24.0) + F.col("lat_ix") * F.lit(0.1)).alias("era5_lat"), (F.lit(30.0) + F.col("lon_ix") * F.lit(0.1)).alias("era5_lon"), "day",
        F.when(3 * F.col("lon_ix") + F.col("lat_ix") >= 150, F.col("q")).alias("t2m"),
    )
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").cast("decimal(18,2)").alias("price")).filter("not (month(day) = 2 and day(day) = 29)")
    base = orders.groupBy("day").agg((F.sum("price").cast("double") / F.count("*") / F.lit(9973.0)).alias("base"))
    cells = base.withColumn("clat_ix", F.explode(F.sequence(F.lit(0), F.lit(N_CLAT - 1)))).withColumn("clon_ix", F.explode(F.sequence(F.lit(0), F.lit(N_CLON - 1))))
    coarse = cells.select(
        "clat_ix", "clon_ix", (F.lit(23.089005) + F.col("clat_ix") * F.lit(0.942408)).alias("cmip_lat"), (F.lit(28.75) + F.col("clon_ix") * F.lit(1.25)).alias("cmip_lon"), "day",
        (F.col("base") + F.lit(0.25) * F.col("clat_ix") - F.lit(0.1) * F.col("clon_ix")).alias("tas"),
    )
    lats, lons = fine.select("lat_ix", "era5_lat").distinct(), fine.select("lon_ix", "era5_lon").distinct()
    clats, clons = coarse.select("clat_ix", "cmip_lat").distinct(), coarse.select("clon_ix", "cmip_lon").distinct()
    pixels = fine.groupBy("lat_ix", "lon_ix").agg(F.min("era5_lat").alias("era5_lat"), F.min("era5_lon").alias("era5_lon"), (F.count("t2m") > 0).alias("is_land"))
    line = lambda n, ix, start, coord: spark.range(n).select(F.col("id").cast("int").alias(ix), (F.lit(start) + F.col("id") * F.lit(0.1)).alias(coord))
    points = line(N_LAT, "lat_ix", 24.0, "era5_lat").crossJoin(F.broadcast(line(N_LON, "lon_ix", 30.0, "era5_lon")))
    return Grids(fine, coarse, pixels, lats, lons, clats, clons, points)


#: The same as SQL; each part may use those before it.
SQL_PARTS = {
    "fine": f"""select lat_ix, lon_ix, 24.0::double + lat_ix * 0.1::double as era5_lat, 30.0::double + lon_ix * 0.1::double as era5_lon, day,
      case when 3 * lon_ix + lat_ix >= 150 then q end as t2m
      from (select (l_partkey % {N_LAT})::int as lat_ix, ((l_partkey * 7) % {N_LON})::int as lon_ix, l_shipdate::date as day, avg(l_quantity) as q from lineitem group by all)""",
    "lat": "select distinct lat_ix, era5_lat from fine",
    "lon": "select distinct lon_ix, era5_lon from fine",
    "clat_line": f"select range::int as clat_ix, 23.089005::double + range * 0.942408::double as cmip_lat from range({N_CLAT})",
    "clon_line": f"select range::int as clon_ix, 28.75::double + range * 1.25::double as cmip_lon from range({N_CLON})",
    "base": """select o_orderdate::date as day, sum(o_totalprice::decimal(18,2))::double / count(*) / 9973.0::double as base from orders
      where not (month(o_orderdate) = 2 and day(o_orderdate) = 29) group by 1""",
    "coarse": "select clat_ix, clon_ix, cmip_lat, cmip_lon, day, base + 0.25::double * clat_ix - 0.1::double * clon_ix as tas from base, clat_line, clon_line",
    "clat": "select distinct clat_ix, cmip_lat from coarse",
    "clon": "select distinct clon_ix, cmip_lon from coarse",
    "pixels": "select lat_ix, lon_ix, era5_lat, era5_lon, count(t2m) > 0 as is_land from fine group by lat_ix, lon_ix, era5_lat, era5_lon",
    "cell_field": "select clat_ix as lat_ix, clon_ix as lon_ix, avg(tas) as v from coarse group by clat_ix, clon_ix",
    "lat_line": f"select range::int as lat_ix, 24.0::double + range * 0.1::double as era5_lat from range({N_LAT})",
    "lon_line": f"select range::int as lon_ix, 30.0::double + range * 0.1::double as era5_lon from range({N_LON})",
    "points": "select * from lat_line, lon_line",
    "lat_map": "select lat_ix, clat_ix, cmip_lat from lat, clat qualify row_number() over (partition by lat_ix order by abs(era5_lat - cmip_lat), clat_ix) = 1",
    "lon_map": "select lon_ix, clon_ix, cmip_lon from lon, clon qualify row_number() over (partition by lon_ix order by abs(era5_lon - cmip_lon), clon_ix) = 1",
    "assigned": "select p.*, clat_ix, cmip_lat, clon_ix, cmip_lon from pixels p join lat_map using (lat_ix) join lon_map using (lon_ix)",
    "paired": """select f.era5_lat, f.era5_lon, c.cmip_lat, c.cmip_lon, f.day, t2m, tas from fine f join lat_map using (lat_ix) join lon_map using (lon_ix)
      join coarse c on c.clat_ix = lat_map.clat_ix and c.clon_ix = lon_map.clon_ix and c.day = f.day where t2m is not null""",
    "pairs_ix": """select f.lat_ix, f.lon_ix, c.clat_ix, c.clon_ix, f.era5_lat, f.era5_lon, c.cmip_lat, c.cmip_lon, f.day, t2m, tas from fine f join lat_map using (lat_ix)
      join lon_map using (lon_ix) join coarse c on c.clat_ix = lat_map.clat_ix and c.clon_ix = lon_map.clon_ix and c.day = f.day where t2m is not null""",
    "model": "select regr_slope(t2m, tas) as slope, regr_intercept(t2m, tas) as intercept from paired",
    "resid": "select era5_lat, era5_lon, cmip_lat, cmip_lon, day, t2m - (slope * tas + intercept) as residual from paired, model",
    "counts": "select cmip_lat, cmip_lon, count(*) as n_pixels from assigned where is_land group by all",
    "sea": """select cmip_lat, cmip_lon, count(*) as n_total, sum(is_land::int)::bigint as n_land, count(*) - sum(is_land::int)::bigint as n_sea,
      (count(*) - sum(is_land::int)) / count(*)::double as sea_fraction from assigned group by all""",
    "stats": "select s.*, coalesce(n_pixels, 0)::int as n_land_pixels from sea s left join counts using (cmip_lat, cmip_lon)",
    "series": """select 'fine' as label, day, avg(t2m) as value from fine group by day union all select 'coarse', day, avg(tas) from coarse group by day""",
}

#: Parts that others read more than once: worked out once, so that no plan joins their inputs all over again.
MATERIALIZED = ("fine", "coarse", "lat_map", "lon_map", "paired", "pairs_ix", "model", "resid")


def sql(query: str, *parts: str) -> str:
    """A query with the parts it uses, and what those use, as common table expressions."""
    needs: list[str] = []

    def add(name: str) -> None:
        if name in needs:
            return
        words = set(SQL_PARTS[name].replace(",", " ").replace("(", " ").replace(")", " ").split())
        for other in SQL_PARTS:
            if other != name and other in words and list(SQL_PARTS).index(other) < list(SQL_PARTS).index(name):
                add(other)
        needs.append(name)

    for p in parts:
        add(p)
    part = lambda n: f"{n} as {'materialized ' if n in MATERIALIZED else ''}({SQL_PARTS[n]})"
    head = "with " + ",\n".join(map(part, needs)) + "\n" if needs else ""
    query = query.removeprefix(",\n") if not head else query  # steps of its own follow those parts
    return (head.rstrip() if query.startswith(",\n") else head) + query
