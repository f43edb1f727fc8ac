"""Reading gridded temperature records into cubes."""

from __future__ import annotations

import importlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import expressions as E
from ..operators.grid import standardize_longitude, subset_box
from ..schema import Region
from . import netcdf3


def list_files(spark: SparkSession, path: str, pattern: str = "*", exclude: str = "(1)") -> DataFrame:
    """(path, length, modified) of files under path whose names fit a glob and don't contain exclude, by name."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select("path", "length", F.col("modificationTime").alias("modified")).filter(~F.element_at(F.split("path", "/"), -1).contains(exclude) if exclude else F.lit(True)).orderBy("path")


def first_match(spark: SparkSession, path: str, pattern: str, contains: str | None = None) -> DataFrame:
    """The first file by name that fits the glob and, whatever its case, contains a text; empty if none does."""
    found = list_files(spark, path, pattern, exclude="")
    return (found.filter(F.lower("path").contains(contains.lower())) if contains else found).limit(1)


def first_existing(spark: SparkSession, roots: list[str], pattern: str, contains: str | None = None) -> str | None:
    """Tries roots in order; the first match of the first root that has one. A missing root is no error."""
    from pyspark.errors import AnalysisException

    for root in roots:
        try:
            if row := first_match(spark, root, pattern, contains).first():
                return row["path"]
        except AnalysisException:
            continue
    return None


def copy_if_missing(df: DataFrame, path: str) -> None:
    """Write a table unless the target is there already."""
    df.write.mode("ignore").parquet(path)


def prepare_fine(raw: DataFrame) -> DataFrame:
    """valid_time becomes time, helper coordinates go, only t2m is kept; NaN becomes NULL."""
    df = raw.withColumnRenamed("valid_time", "time") if "valid_time" in raw.columns else raw
    df = df.drop("number", "expver")
    return df.select(F.col("latitude").cast("double").alias("era5_lat"), F.col("longitude").cast("double").alias("era5_lon"), "time", E.missing_to_null(F.col("t2m").cast("double")).alias("t2m"))


def load_fine(parts: list[DataFrame], region: Region | None = None, pad_lat: float = 0.0, pad_lon: float = 0.0) -> DataFrame:
    """All parts as one cube, optionally cut to a box. Repeated times stay; order is for the output only."""
    df = prepare_fine(parts[0])
    for p in parts[1:]:
        df = df.unionByName(prepare_fine(p))
    df = df.withColumn("day", F.to_date("time")).drop("time")
    return subset_box(df, "era5_lat", "era5_lon", region, pad_lat, pad_lon) if region else df


def load_coarse(raw: DataFrame, region: Region | None = None, pad_lat: float = 1.0, pad_lon: float = 1.5, calendar: str | None = None, start_year: int | None = None) -> DataFrame:
    """A coarse cube: longitudes standardised, then cut to a box.

    calendar="noleap": time counts days since 1 January of start_year without leap days.
    """
    df = standardize_longitude(raw.withColumnsRenamed({"lat": "cmip_lat", "lon": "cmip_lon"}), "cmip_lon")
    day = E.no_leap_day(start_year, F.col("time")) if calendar == "noleap" else F.to_date("time")
    df = df.select("cmip_lat", "cmip_lon", day.alias("day"), E.missing_to_null(F.col("tas").cast("double")).alias("tas"))
    return subset_box(df, "cmip_lat", "cmip_lon", region, pad_lat, pad_lon) if region else df


def manifest(tables: dict[str, tuple[DataFrame, str, str, str]]) -> DataFrame:
    """For each label of (table, latitude, longitude, time): sizes and extents, one row a label."""
    out = None
    for label, (df, lat, lon, time) in tables.items():
        one = df.agg(
            F.lit(label).alias("dataset"), F.count("*").alias("n_rows"), E.distinct_few(lat).alias("n_lat"), E.distinct_few(lon).alias("n_lon"), E.distinct_few(time).alias("n_times"),
            F.min(lat).alias("lat_min"), F.max(lat).alias("lat_max"), F.min(lon).alias("lon_min"), F.max(lon).alias("lon_max"), F.min(time).alias("first"), F.max(time).alias("last"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def is_kelvin(units: str | None) -> bool:
    return (units or "").lower().strip() in {"k", "kelvin"}


def units_of(df: DataFrame, column: str) -> str | None:
    return df.schema[column].metadata.get("units")


def with_units(column: Column, name: str, units: str) -> Column:
    return column.alias(name, metadata={"units": units})


# --- NetCDF: classic files by netcdf3, NetCDF-4 where h5netcdf or netCDF4 is installed


class _Chunk(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


def _open(path: str):
    """Classic files by ``netcdf3``; others with netCDF4, or with h5netcdf where that isn't installed or can't open the
    file. All give arrays by name and decode packed values."""
    try:
        classic = netcdf3.is_classic(path)
    except (OSError, ValueError):  # the libraries know paths of their own
        classic = False
    if classic:
        return netcdf3.Dataset(path)
    failed: Exception | None = None
    for library in ("netCDF4", "h5netcdf.legacyapi"):
        try:
            return importlib.import_module(library).Dataset(path)
        except ModuleNotFoundError:
            continue
        except (OSError, RuntimeError, ValueError) as e:
            failed = e
    if failed is not None:
        raise OSError(f"{path} can't be opened") from failed
    raise ImportError("reading NetCDF needs netCDF4 or h5netcdf; convert to Parquet where neither is installed")


class NetCdfSource(DataSource):
    """spark.read.format("netcdf"): options path, variable, lat, lon, time, steps (time steps a partition).

    path: one or several, with commas between. decode=true: time is a date, by the units and calendar of each file;
    otherwise it is the number in the file.
    """

    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def schema(self) -> T.StructType:
        d = T.DoubleType()
        return T.StructType([T.StructField("latitude", d), T.StructField("longitude", d), T.StructField("time", T.DateType() if _decodes(self.options) else d), T.StructField(self.options["variable"], d)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _NetCdfReader(dict(self.options))


def _decodes(options: dict[str, str]) -> bool:
    return options.get("decode", "false").lower() == "true"


class _NetCdfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.o = {"lat": "latitude", "lon": "longitude", "time": "time", "steps": "32"} | options

    def partitions(self) -> list[_Chunk]:
        out, steps = [], int(self.o["steps"])
        for path in self.o["path"].split(","):
            with _open(path) as ds:
                n = len(ds.variables[self.o["time"]])
            out += [_Chunk(path, a, min(a + steps, n)) for a in range(0, n, steps)]
        return out

    def read(self, partition: _Chunk):
        import numpy as np
        import pyarrow as pa

        with _open(partition.path) as ds:
            v = ds.variables
            lat, lon = np.asarray(v[self.o["lat"]][:], float), np.asarray(v[self.o["lon"]][:], float)
            times = v[self.o["time"]]
            for t in range(partition.start, partition.stop):
                values = np.ma.filled(np.ma.asarray(v[self.o["variable"]][t], float), np.nan).ravel()
                time = float(times[t])
                if _decodes(self.o):
                    time = netcdf3.day_of(time, times.units, getattr(times, "calendar", "standard"))
                    column = pa.array([time], pa.date32()).take(pa.array(np.zeros(values.size, np.int32)))
                else:
                    column = pa.array(np.full(values.size, time))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(lat, len(lon))), pa.array(np.tile(lon, len(lat))), column, pa.array(values, from_pandas=True)],
                    ["latitude", "longitude", "time", self.o["variable"]],
                )


def register_netcdf(spark: SparkSession) -> None:
    spark.dataSource.register(NetCdfSource)
