"""Distances on the sphere, and a grid of several levels with the cells that cover a circle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticegrid import vocab
from noticegrid.functions.text import col

# Cells of level n are 2^n degrees high and about as wide in miles: nearer to a pole they span 2, 4, 8 ... times as many degrees.
FINEST, COARSEST = -10, 6
# Widens every covering a little, so that rounding never leaves out a point on the circle's edge.
EDGE = 1e-7
# A cell whose corner is this near to the circle counts as one on its edge.
EDGE_MILES = 1e-6


def haversine_mi(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (col(c) for c in (lat1, lon1, lat2, lon2))
    a = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0))
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
         * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0)))
    return 2 * vocab.EARTH_RADIUS_MI * F.asin(F.sqrt(F.when(a > 1.0, F.lit(1.0)).otherwise(a)))


def destination_point(lat, lon, bearing_deg, distance_mi) -> Column:
    """Struct (lat, lon) reached from a point along a compass bearing."""
    bearing, d = F.radians(col(bearing_deg)), col(distance_mi) / vocab.EARTH_RADIUS_MI
    lat1, lon1 = F.radians(col(lat)), F.radians(col(lon))
    lat2 = F.asin(F.sin(lat1) * F.cos(d) + F.cos(lat1) * F.sin(d) * F.cos(bearing))
    lon2 = lon1 + F.atan2(F.sin(bearing) * F.sin(d) * F.cos(lat1),
                          F.cos(d) - F.sin(lat1) * F.sin(lat2))
    return F.struct(F.degrees(lat2).alias("lat"), F.degrees(lon2).alias("lon"))


def grid_level(radius) -> Column:
    """The level whose cells are between a quarter and a half of the radius."""
    degrees = F.degrees(F.greatest(col(radius).cast("double"), F.lit(1e-9)) / vocab.EARTH_RADIUS_MI)
    return F.greatest(F.lit(FINEST), F.least(F.lit(COARSEST), F.floor(F.log2(degrees)) - 1)).cast("int")


def _row_span(level: Column, row: Column) -> Column:
    """Degrees of longitude of the cells in a row of a level: a power of two that divides the circle as wide as the row's lower edge allows."""
    size = F.pow(F.lit(2.0), level)
    lower = F.least(F.abs(row * size), F.abs((row + 1) * size))
    narrow = F.greatest(F.cos(F.radians(F.least(lower, F.lit(90.0)))), F.lit(2.0 ** -12))
    return size * F.pow(F.lit(2.0), F.floor(-F.log2(narrow)))


def _cell_key(level: Column, row: Column, column: Column) -> Column:
    """One number for a cell: level, row, and the column counted from -180."""
    return ((level.cast("long") - FINEST) * F.lit(1 << 48) + (row.cast("long") + (1 << 20)) * F.lit(1 << 24) + column.cast("long")).cast("long")


def cell_of(lat, lon, level) -> Column:
    """The cell of a level that holds a point; longitudes may run beyond ±180."""
    level = col(level)
    row = F.floor(col(lat) / F.pow(F.lit(2.0), level))
    return _cell_key(level, row, F.floor(F.pmod(col(lon) + 180.0, F.lit(360.0)) / _row_span(level, row)))


def with_cells(circles: DataFrame, level: Column, inside: bool = False) -> DataFrame:
    """Circles (_clat, _clon, _reach) once for each cell (_cell) of a level that they may touch, across ±180 and the poles too.

    Of each row of cells those are taken that the circle's widest part inside the row spans. With ``inside`` also _inside: whether
    all of the cell lies in the circle. The point of a cell farthest from anywhere is a corner of it.
    """
    lat, lon = F.col("_clat"), F.col("_clon")
    row, size, span, half = (F.col(c) for c in ("_row", "_size", "_span", "_half"))
    arc = F.least(F.col("_reach") / vocab.EARTH_RADIUS_MI, F.lit(math.pi))
    out = circles.withColumn("_level", level).withColumns({"_size": F.pow(F.lit(2.0), F.col("_level")), "_arc": arc})
    reach = F.degrees("_arc") + EDGE
    out = out.withColumn("_row", F.explode(F.sequence(
        F.floor(F.greatest(lat - reach, F.lit(-90.0)) / size), F.floor(F.least(lat + reach, F.lit(90.0)) / size))))
    # Meridians touch the circle at this latitude; north or south of it the circle narrows.
    widest = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(F.radians(lat)) / F.greatest(F.cos("_arc"), F.lit(1e-12))))))
    out = out.withColumns({"_span": _row_span(F.col("_level"), row),
                           "_at": F.radians(F.greatest(row * size, F.least((row + 1) * size, widest)))})
    flat = F.cos(F.radians(lat)) * F.cos("_at")
    out = out.withColumns({"_flat": flat, "_ratio": F.try_divide(F.cos("_arc") - F.sin(F.radians(lat)) * F.sin("_at"), flat)})
    whole = (F.col("_flat") < 1e-9) | (F.col("_ratio") <= -1.0) | (F.col("_arc") >= math.pi / 2)
    wide = F.degrees(F.acos(F.least(F.col("_ratio"), F.lit(1.0)))) + EDGE / F.greatest(F.cos("_at"), F.lit(1e-9))
    out = out.withColumn("_half", F.when(whole, F.lit(180.0)).otherwise(F.least(F.lit(180.0), wide)))
    # Columns are counted from -180; the last may be narrower than the others.
    out = out.withColumns({"_last": F.ceil(F.lit(360.0) / span) - 1, "_west": F.pmod(lon + 180.0 - half, F.lit(360.0))})
    last, west, east = F.col("_last"), F.col("_west"), F.col("_west") + 2 * half
    at, zero = (lambda x: F.least(last, F.floor(x / span))), F.lit(0).cast("long")
    columns = F.when(half >= 180.0, F.sequence(zero, last)).when(east < 360.0, F.sequence(at(west), at(east))).otherwise(
        F.array_distinct(F.concat(F.sequence(at(west), last), F.sequence(zero, at(east - 360.0)))))
    out = out.withColumn("_column", F.explode(columns)).withColumn("_cell", _cell_key(F.col("_level"), row, F.col("_column")))
    if inside:
        south, north = F.greatest(row * size, F.lit(-90.0)), F.least((row + 1) * size, F.lit(90.0))
        sides = (F.col("_column") * span - 180.0, F.least((F.col("_column") + 1) * span, F.lit(360.0)) - 180.0)
        farthest = F.greatest(*[haversine_mi(lat, lon, y, x) for y in (south, north) for x in sides])
        out = out.withColumn("_inside", (span <= 90.0) & (farthest < F.col("_reach") - EDGE_MILES))
    return out.drop("_level", "_size", "_arc", "_row", "_span", "_at", "_flat", "_ratio", "_half", "_last", "_west", "_column")


def ring_points(lat, lon, radius) -> Column:
    """Sample points around a centre: none under 40 mi, one ring under 80 mi, else two.

    Array of (ring, idx, bearing, distance, point).
    """
    radius = col(radius).cast("double")
    guessed = F.greatest(F.lit(2), F.least(F.lit(vocab.MAX_ANCHOR_TOWNS),
                                           F.bround(radius / 20).cast("int")))
    fractions = F.when(radius < 80, F.array(F.lit(0.7))).otherwise(F.array(F.lit(0.5), F.lit(0.85)))
    per_ring = F.greatest(F.lit(1), F.floor(guessed / F.size(fractions)).cast("int"))

    def ring(frac, ring_i):
        def point(i):
            bearing = i * (360.0 / per_ring) + ring_i * (180.0 / per_ring)
            return F.struct(ring_i.alias("ring"), i.alias("idx"), bearing.alias("bearing"),
                            (radius * frac).alias("distance"),
                            destination_point(lat, lon, bearing, radius * frac).alias("point"))
        return F.transform(F.sequence(F.lit(0), per_ring - 1), point)

    return F.when(radius >= 40, F.flatten(F.transform(fractions, ring)))
