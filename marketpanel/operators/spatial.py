"""Projected coordinates, point-in-polygon, ring areas and box fitting as column jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketpanel.operators.skew import attach

# GRS80 ellipsoid, central meridian, scale and false easting of the TM2 zone.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257222101
CENTRAL_MERIDIAN, SCALE, FALSE_EASTING = 121.0, 0.9999, 250000.0


def transverse_mercator(longitude: Column, latitude: Column) -> tuple[Column, Column]:
    """Easting and northing in metres, by Krüger's series in the third flattening (order 4)."""
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    eccentric = 2 * n**0.5 / (1 + n)
    sine, offset = F.sin(F.radians(latitude)), F.radians(longitude - CENTRAL_MERIDIAN)
    conformal = F.sinh(F.atanh(sine) - eccentric * F.atanh(eccentric * sine))
    xi = F.atan2(conformal, F.cos(offset))
    eta = F.atanh(F.sin(offset) / F.sqrt(1 + conformal * conformal))
    north, east = xi, eta
    for j, a in enumerate(series, 1):
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return FALSE_EASTING + SCALE * radius * east, SCALE * radius * north


def polygon_edges(vertices: DataFrame) -> DataFrame:
    """Closed edges of each ring; `vertices` has (polygon, ring, seq, x, y)."""
    ring = Window.partitionBy("polygon", "ring").orderBy("seq")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = F.coalesce(F.lead(F.struct("x", "y")).over(ring), F.first(F.struct("x", "y")).over(whole))
    return vertices.withColumn("_next", following).select(
        "polygon", "ring", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"),
        F.col("_next.x").alias("x2"), F.col("_next.y").alias("y2"),
    )


def points_in_polygon(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Even-odd test of each point against its own polygon, equi-joined on the polygon code.

    A polygon travels as one row with its edge list, so points are never multiplied by edges; a
    bounding box settles most outside points without looking at an edge.
    """
    shapes = edges.groupBy("polygon").agg(
        F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_edges"),
        F.min("x1").alias("_x0"), F.max("x1").alias("_x9"), F.min("y1").alias("_y0"), F.max("y1").alias("_y9"),
    )
    joined = attach(points, shapes, ["polygon"], "left")
    x, y = F.col("x"), F.col("y")

    def crosses(e: Column) -> Column:
        spans = (e["y1"] > y) != (e["y2"] > y)
        at = (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
        return spans & F.coalesce(x < at, F.lit(False))

    inside_box = x.between(F.col("_x0"), F.col("_x9")) & y.between(F.col("_y0"), F.col("_y9"))
    crossings = F.size(F.filter("_edges", crosses))
    inside = F.when(inside_box, crossings % 2 == 1).otherwise(F.lit(False))
    return joined.withColumn("is_inside", inside).drop("_edges", "_x0", "_x9", "_y0", "_y9")


def ring_areas(vertices: DataFrame, by: Sequence[str] = ("polygon", "ring")) -> DataFrame:
    """Shoelace area of each ring."""
    edges = polygon_edges(vertices)
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    return edges.groupBy(*by).agg(F.abs(F.sum(cross) / 2).alias("area"), F.count(F.lit(1)).alias("vertices"))


def fit_to_box(points: DataFrame, group: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Affine fit of each group's points into a display box, centred, y downwards."""
    left, top, width, height = box
    bounds = points.groupBy(group).agg(
        F.min("x").alias("_x0"), F.max("x").alias("_x9"), F.min("y").alias("_y0"), F.max("y").alias("_y9")
    )
    joined = attach(points, bounds, [group])
    wide, high = F.col("_x9") - F.col("_x0"), F.col("_y9") - F.col("_y0")
    scale = F.least(F.lit(width) / wide, F.lit(height) / high)
    out = joined.withColumn("_scale", scale)
    return out.withColumns({
        "fit_x": left + (width - wide * F.col("_scale")) / 2 + (F.col("x") - F.col("_x0")) * F.col("_scale"),
        "fit_y": top + (height - high * F.col("_scale")) / 2 + (F.col("_y9") - F.col("y")) * F.col("_scale"),
    }).drop("_scale", "_x0", "_x9", "_y0", "_y9")
