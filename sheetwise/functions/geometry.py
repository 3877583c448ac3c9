"""Column functions over boxes: structs of x0, y0, x1, y1 in points, origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def box(x0, y0, x1, y1) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def width(b) -> Column:
    return F.abs(b["x1"] - b["x0"])


def height(b) -> Column:
    return F.abs(b["y1"] - b["y0"])


def area(b) -> Column:
    return width(b) * height(b)


def centre_x(b) -> Column:
    return (b["x0"] + b["x1"]) / 2


def centre_y(b) -> Column:
    return (b["y0"] + b["y1"]) / 2


def holds(b, x, y) -> Column:
    """Whether the point lies in the box, its edges included."""
    return (x >= b["x0"]) & (x <= b["x1"]) & (y >= b["y0"]) & (y <= b["y1"])


def truncated_px(v, dpi: int) -> Column:
    return (v * dpi / 72).cast("int")


def rounded_px(v, zoom: float) -> Column:
    """Half goes to the even neighbour."""
    return F.bround(v * zoom).cast("int")


def intersection(a, b) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


#: Side of a square of the page's grid, in points: as high as the tallest frame.
SQUARE = 40.0


def square_of(v) -> Column:
    """Number of the column or row of squares that holds the coordinate."""
    return F.floor(v / SQUARE)


def squares_between(low, high) -> Column:
    """Numbers of all columns or rows of squares from one coordinate to the other, which isn't smaller."""
    return F.sequence(square_of(low), square_of(high))


def in_squares(df: DataFrame, x0, y0, x1, y1) -> DataFrame:
    """A row of ``df`` for each square (sx, sy) that the box touches. A point that the box holds lies in exactly one of them.

    Points and boxes that are joined by page and square meet once, whatever else is on the page.
    """
    return df.withColumn("sx", F.explode(squares_between(x0, x1))).withColumn("sy", F.explode(squares_between(y0, y1)))
