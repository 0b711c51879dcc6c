"""Numbers, dates and coordinates as they are printed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
#: Stands for "present, not counted" in a matrix cell.
PRESENT = -1.0


def cell_value(text: Column) -> Column:
    """A printed count: '.' groups thousands, ',' is the decimal mark, * and + mean present; null if empty, zero or no number."""
    plain = F.replace(F.replace(F.btrim(text), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    number = F.when(plain.rlike(r"^[0-9.]+$"), plain.try_cast("double"))
    return F.when(plain.isin("*", "+"), F.lit(PRESENT)).when(plain.isin("", "0"), None).otherwise(number)


def decimal_comma(text: Column) -> Column:
    """A measured value: ',' is the decimal mark; null if it isn't a plain number."""
    plain = F.replace(text, F.lit(","), F.lit("."))
    return F.when(plain.rlike(r"^[0-9.]+$"), plain.try_cast("double"))


def campaign(caption: Column) -> Column:
    """yyyy-MM from a caption that names month and year."""
    month, year = F.regexp_extract(caption, _MONTH, 1), F.regexp_extract(caption, _MONTH, 2)
    return F.when(year != "", F.concat(year, F.lit("-"), F.lpad(month, 2, "0")))


def year(text: Column) -> Column:
    """The first year from 1700 to 2029."""
    return F.regexp_extract(text, r"\b(1[7-9]\d\d|20[0-2]\d)\b", 1).try_cast("int")


# How degrees, and month and year, are printed.
_MONTH = r"tháng\s*(\d{1,2})\s*năm\s*(\d{4})"
_DMS = r"(\d{2,3})(?:°|0|\s)\s?(\d{1,2})\s?[’'′]\s?(\d{1,2}(?:[.,]\d+)?)"


def degrees(text: Column) -> Column:
    """All degree-minute-second values in a text, as decimal degrees."""
    parts = [F.regexp_extract_all(text, F.lit(_DMS), F.lit(i)) for i in (1, 2, 3)]
    zipped = F.arrays_zip(*(p.alias(n) for p, n in zip(parts, "dms", strict=True)))
    return F.transform(zipped, lambda x: x["d"].cast("double") + x["m"].cast("double") / 60 + F.replace(x["s"], F.lit(","), F.lit(".")).cast("double") / 3600)


def position(text: Column) -> Column:
    """(lat, lon) told apart by their ranges, as headers may be swapped; null unless both are there."""
    values = degrees(text)
    lat = F.get(F.filter(values, lambda v: v.between(8, 24)), F.lit(0))
    lon = F.get(F.filter(values, lambda v: v.between(102, 110)), F.lit(0))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon")))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda x: F.pow(F.sin(x / 2), F.lit(2.0))
    h = half(F.radians(lat2 - lat1)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(F.radians(lon2 - lon1))
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def half_even(value: Column, places: int = 3) -> Column:
    return F.bround(value, places)
