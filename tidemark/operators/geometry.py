"""Share of a polygon that falls on each cell of a weather grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lattice_in_polygons(vertices: DataFrame, step: float = 0.01) -> DataFrame:
    """Lattice points inside each polygon as rows: the inside stretches with every point of them made."""
    scale = float(round(1 / step))
    return lattice_stretches(vertices, step).withColumn("column", F.explode(F.sequence("first", "last"))).select(
        "area_id", (F.col("row") / F.lit(scale)).alias("latitude"), (F.col("column") / F.lit(scale)).alias("longitude"))


def lattice_stretches(vertices: DataFrame, step: float = 0.01) -> DataFrame:
    """(area_id, row, first, last): runs of lattice columns inside each polygon, by counting edge crossings to the east.

    An edge is offered only to the lattice rows between its two ends, found by
    arithmetic, and turned into one crossing longitude per row. A point is inside
    when an odd number of crossings lies to its east. Points and edges are never
    multiplied: the crossings of a row, sorted, cut it into stretches.
    """
    scale = round(1 / step)
    ring = Window.partitionBy("area_id").orderBy("seq")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = vertices.select(
        "area_id", F.col("lon").alias("x1"), F.col("lat").alias("y1"),
        F.coalesce(F.lead("lon").over(ring), F.first("lon").over(whole)).alias("x2"),
        F.coalesce(F.lead("lat").over(ring), F.first("lat").over(whole)).alias("y2"),
    ).where("y1 <> y2")
    rows = F.sequence(F.ceil(F.least("y1", "y2") * scale), F.floor(F.greatest("y1", "y2") * scale))
    lat = F.col("row") / F.lit(float(scale))
    spans = (F.col("y1") > lat) != (F.col("y2") > lat)
    crossings = (
        edges.where(F.ceil(F.least("y1", "y2") * scale) <= F.floor(F.greatest("y1", "y2") * scale))
        .withColumn("row", F.explode(rows))
        .where(spans)
        .select("area_id", "row", ((F.col("x2") - F.col("x1")) * (lat - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")).alias("x"))
    )
    order = Window.partitionBy("area_id", "row").orderBy("x")
    # Between an odd crossing and the next, points with x_odd <= longitude < x_next have an odd number to their east.
    stretches = crossings.withColumn("n", F.row_number().over(order)).withColumn("x_next", F.lead("x").over(order)).where("n % 2 = 1")
    first, last = F.ceil(F.col("x") * scale), F.ceil(F.col("x_next") * scale) - 1
    return stretches.select("area_id", "row", first.alias("first"), last.alias("last")).where("first <= last")


def _cell(place: Column, per_cell: int) -> Column:
    """Cell whose centre is nearest to a lattice place; a place between two centres belongs to the even cell."""
    twice = 2 * place + per_cell
    cell = F.floor(twice / (2 * per_cell))
    return cell - F.when((twice % (2 * per_cell) == 0) & (cell % 2 != 0), 1).otherwise(0)


def _shared_places(first: Column, last: Column, cell: Column, per_cell: int) -> Column:
    """How many places of [first, last] belong to a cell."""
    edge = F.when(cell % 2 == 0, 0).otherwise(1) if per_cell % 2 == 0 else F.lit(0)  # an odd cell has neither of its two borders
    low = F.ceil((2 * cell - 1) * per_cell / 2) + edge
    high = F.floor((2 * cell + 1) * per_cell / 2) - edge
    return F.least(last, high) - F.greatest(first, low) + 1


def lattice_cells(vertices: DataFrame, step: float = 0.01, grid: float = 0.25) -> DataFrame:
    """Lattice points of each polygon in each grid cell, counted without making a point.

    A stretch meets the cells between those of its ends, and its points in each are a difference of borders. Rows
    grow with polygons' heights in steps and widths in cells, and leave as one per polygon and cell. ``grid`` must be a whole number of steps.
    """
    per_cell = round(grid / step)
    if per_cell < 1 or abs(per_cell * step - grid) > 1e-9 * grid:
        raise ValueError("grid is a whole number of steps")
    met = lattice_stretches(vertices, step).withColumn(
        "column", F.explode(F.sequence(_cell(F.col("first"), per_cell), _cell(F.col("last"), per_cell))))
    counted = met.groupBy("area_id", _cell(F.col("row"), per_cell).alias("row"), "column").agg(
        F.sum(_shared_places(F.col("first"), F.col("last"), F.col("column"), per_cell)).cast("bigint").alias("lattice_points"))
    return counted.select("area_id", (F.col("row") * grid).alias("latitude"), (F.col("column") * grid).alias("longitude"), "lattice_points")


def grid_weights(points: DataFrame, grid: float = 0.25) -> DataFrame:
    """Points snapped to grid cells, and each cell's share of its polygon to four digits."""
    snap = lambda c: F.bround(F.col(c) / grid) * grid
    cells = points.groupBy("area_id", snap("latitude").alias("latitude"), snap("longitude").alias("longitude")).agg(
        F.count(F.lit(1)).alias("lattice_points"))
    return cell_weights(cells)


def cell_weights(cells: DataFrame) -> DataFrame:
    """Each cell's share of its polygon's lattice points to four digits, heaviest cells first."""
    area = Window.partitionBy("area_id")
    share = F.col("lattice_points") / F.sum("lattice_points").over(area)
    order = area.orderBy(F.col("area_weight").desc(), "latitude", "longitude")
    return cells.withColumn("area_weight", F.round(share, 4)).withColumn(
        "grid_point_id", F.concat(F.lit("grid_"), F.lpad(F.row_number().over(order).cast("string"), 3, "0")))
