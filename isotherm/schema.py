"""Tables of the engine, and the constants of the study region.

A cube is a long table: one row for each cell and day. Axes are tables of (ix, coord); cells are joined by
integer index, never by a double. Missing values are NULL; NaN is turned into NULL on the way in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in columns.items()])


_I, _L, _D, _DAY, _B = T.IntegerType(), T.LongType(), T.DoubleType(), T.DateType(), T.BooleanType()

FINE = _struct(lat_ix=_I, lon_ix=_I, era5_lat=_D, era5_lon=_D, day=_DAY, t2m=_D)
COARSE = _struct(clat_ix=_I, clon_ix=_I, cmip_lat=_D, cmip_lon=_D, day=_DAY, tas=_D)
AXIS = _struct(ix=_I, coord=_D)
LAND_MASK = _struct(lat_ix=_I, lon_ix=_I, is_land=_B)
ASSIGNMENT = _struct(lat_ix=_I, lon_ix=_I, era5_lat=_D, era5_lon=_D, clat_ix=_I, clon_ix=_I, cmip_lat=_D, cmip_lon=_D)
PAIRED = _struct(era5_lat=_D, era5_lon=_D, cmip_lat=_D, cmip_lon=_D, day=_DAY, t2m=_D, tas=_D)
RESIDUAL = _struct(era5_lat=_D, era5_lon=_D, cmip_lat=_D, cmip_lon=_D, day=_DAY, residual=_D)
CELL_STATS = _struct(cmip_lat=_D, cmip_lon=_D, n_total=_L, n_land=_L, n_sea=_L, sea_fraction=_D, n_land_pixels=_I)
SERIES = T.StructType([T.StructField("label", T.StringType()), T.StructField("day", _DAY), T.StructField("value", _D)])


@dataclass(frozen=True)
class Region:
    """A box in degrees; bounds are inclusive. It doesn't wrap at the date line."""

    south: float
    north: float
    west: float
    east: float


#: Fixed values of the study.
STUDY_REGION = Region(south=24.0, north=38.0, west=30.0, east=38.0)
FINE_PADDING = (0.1, 0.1)
COARSE_PADDING = (1.0, 1.5)
KELVIN = 273.15
KELVIN_MEAN, KELVIN_MEAN_SERIES = 150.0, 100.0
SEASONS = {"DJF": (12, 1, 2), "MAM": (3, 4, 5), "JJA": (6, 7, 8), "SON": (9, 10, 11)}
PERCENTILES = (25, 50, 75, 90)
BAND = (0.05, 0.95)
COLOUR_LIMITS = (0.02, 0.98)
HISTOGRAM_EDGES, DISTANCE_EDGES, RESIDUAL_BINS, HEX_COLUMNS = 300, 20, 5, 60
CONFIDENCE_PERCENT = 90.0
TARGET = (32.0, 35.0)  # latitude, longitude
QUARTERS = ("01-01", "04-01", "07-01", "10-01")
AUGUST = "08-01"

#: Axes are looked up as literal arrays and broadcast; a longer one is refused.
MAX_AXIS = 100_000
