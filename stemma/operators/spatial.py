"""Points that lie close together."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import EARTH_RADIUS_M, haversine_m


def _height(metres: float) -> float:
    """Rows of cells are as high as the distance, in degrees."""
    return math.degrees(metres / EARTH_RADIUS_M) * 1.0001


def _cells_around(row: Column, metres: float) -> Column:
    """How many cells a row has around the globe: each is as wide as the distance where this row and its neighbours are furthest from the equator."""
    height = _height(metres)
    furthest = F.least(F.lit(90.0), F.greatest(F.abs((row - 1) * height), F.abs((row + 2) * height)))
    ratio = F.least(F.lit(1.0), F.lit(math.sin(metres / EARTH_RADIUS_M / 2)) / F.greatest(F.lit(1e-12), F.cos(F.radians(furthest))))
    return F.greatest(F.lit(1).cast("long"), F.floor(F.lit(360.0) / (F.degrees(2 * F.asin(ratio)) * 1.0001)))


def _cell(lon: Column, around: Column) -> Column:
    return F.least(F.floor(F.pmod(lon, F.lit(360.0)) / 360.0 * around), around - 1)


def close_pairs(points: DataFrame, group: str, key: str, metres: float) -> DataFrame:
    """group, a, b, metres of points of a group with a < b that are closer than so much.

    Points are dealt to cells as high and at least as wide as the distance; a point meets those of its own cell and the eight around it.
    """
    celled = points.select(F.col(group).alias("group"), F.col(key).alias("key"), "lat", "lon", F.floor(F.col("lat") / _height(metres)).alias("row"))
    own = celled.withColumn("cell", _cell(F.col("lon"), _cells_around(F.col("row"), metres)))
    other = celled.select("group", F.col("key").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.explode(F.sequence(F.col("row") - 1, F.col("row") + 1)).alias("row"))
    other = other.withColumn("around", _cells_around(F.col("row"), metres)).withColumn("cell", _cell(F.col("lon2"), F.col("around")))
    beside = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(F.col("cell") + d, F.col("around"))))
    other = other.withColumn("cell", F.explode(beside)).drop("around")
    d = haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return own.join(other, ["group", "row", "cell"]).where("key < b").select("group", F.col("key").alias("a"), "b", d.alias("metres")).where(F.col("metres") < metres)


def first_fit_clusters(points: DataFrame, group: str, order: str, metres: float = 150.0, columns: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """points with `anchor`: the order number of the first earlier point of the group, itself an anchor, that is closer; or its own.

    The order decides, so a group is one task's work; groups are waterbodies, whose points are few. A point is compared with the anchors of its row of
    cells and the next ones only.
    """
    lat, lon = columns
    height = _height(metres)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        anchors: dict[int, list[tuple[int, float, float]]] = {}
        found = []
        for n, a, b in zip(rows[order], rows[lat], rows[lon], strict=True):
            row = math.floor(a / height)
            hits = (m for k in (row - 1, row, row + 1) for m, c, d in anchors.get(k, ()) if _metres(a, b, c, d) < metres)
            hit = min(hits, default=None)
            if hit is None:
                anchors.setdefault(row, []).append((n, a, b))
                hit = n
            found.append(hit)
        return rows.assign(anchor=found)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields) + ", anchor long"
    return points.groupBy(group).applyInPandas(run, schema)


def _metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    dlat, dlon = math.radians(lat2 - lat1) / 2, math.radians(lon2 - lon1) / 2
    h = math.sin(dlat) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(dlon) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(min(1.0, h)))


def numbered_clusters(clustered: DataFrame, prefix: str = "S") -> DataFrame:
    """clustered with site_uid: anchors numbered in their order, three digits at least."""
    from .ordered import numbered

    anchors = numbered(clustered.select("anchor").distinct(), ["anchor"], "_n")
    return clustered.join(anchors.select("anchor", F.format_string(f"{prefix}%03d", F.col("_n") + 1).alias("site_uid")), "anchor").drop("anchor")
