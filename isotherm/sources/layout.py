"""Cubes stored for pairing: both records in buckets of (cell, day), so that they meet without an exchange.

The fine record is given its cell when it is stored. Both tables have the same number of buckets, one file each, sorted by
the key, so a join of the two reads bucket by bucket and moves nothing. Storing again replaces what was there. A small
table beside them says how they were stored, by which ``open_pairs`` finds them in another session.

Defined cases: fine rows without a value or a day aren't stored; an empty record stores empty tables; a pixel
without coordinates has cell -1, which pairs with nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import assign_cells

KEY = ["clat_ix", "clon_ix", "day"]
#: Rows of the fine record that share a bucket, about.
BUCKET_ROWS = 2_000_000
_LAYOUT = "buckets int, fine string, coarse string"


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def _store(df: DataFrame, path: str, buckets: int) -> None:
    name = f"isotherm_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *KEY)
    try:
        dealt.write.format("parquet").mode("overwrite").bucketBy(buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
    finally:
        df.sparkSession.sql(f"drop table if exists {name}")  # the name only: the files stay


def _opened(spark: SparkSession, path: str, schema: str, buckets: int) -> DataFrame:
    name, keys = f"isotherm_{uuid.uuid4().hex}", ", ".join(KEY)
    spark.sql(f"create table {name} ({schema}) using parquet clustered by ({keys}) sorted by ({keys}) into {buckets} buckets location '{path}'")
    try:
        return spark.table(name).select("*")
    finally:
        spark.sql(f"drop table {name}")


def store(fine: DataFrame, coarse: DataFrame, path: str, axes: tuple[list[float], list[float]], buckets: int | None = None) -> None:
    """Store both records under path. axes: coordinates of the coarse lines; buckets: else by the size of the fine record."""
    spark = fine.sparkSession
    rows = assign_cells(fine.filter("t2m is not null and day is not null"), *axes)
    buckets = buckets or max(1, -(-rows.count() // BUCKET_ROWS))
    slim = coarse.select(*KEY, "tas", *(c for c in ("model",) if c in coarse.columns))
    _store(rows, f"{path}/fine", buckets)
    _store(slim, f"{path}/coarse", buckets)
    spark.createDataFrame([(buckets, _ddl(rows), _ddl(slim))], _LAYOUT).coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")


def open_pairs(spark: SparkSession, path: str) -> DataFrame:
    """The paired table of what is stored under path: an inner join on cell and day, without an exchange."""
    how = spark.read.schema(_LAYOUT).parquet(f"{path}/layout").first()
    fine, coarse = (_opened(spark, f"{path}/{side}", how[side], how["buckets"]) for side in ("fine", "coarse"))
    return fine.join(coarse.hint("merge"), KEY).select("lat_ix", "lon_ix", "clat_ix", "clon_ix", "era5_lat", "era5_lon", "cmip_lat", "cmip_lon", "day", "t2m", "tas", *(c for c in ("model",) if c in coarse.columns))
