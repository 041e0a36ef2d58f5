"""Boxes as columns: overlap, duplicates, coordinate systems, tiles, polygon coverage.

A box is an array [x, y, w, h].  ``box_columns`` takes one apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTAINED = 0.8
SAME_PLACE = 0.15


def box_columns(box: Column) -> tuple[Column, Column, Column, Column]:
    return tuple(F.get(box, F.lit(i)) for i in range(4))


def intersection(a: Column, b: Column) -> Column:
    ax, ay, aw, ah = box_columns(a)
    bx, by, bw, bh = box_columns(b)
    w = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    h = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def area(a: Column) -> Column:
    _, _, w, h = box_columns(a)
    return w * h


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty; null for null boxes."""
    return overlap_ratio(intersection(a, b), area(a) + area(b))


def overlap_ratio(inter: Column, areas: Column) -> Column:
    """``iou`` from the intersection and the sum of both areas."""
    union = areas - inter
    return F.when(union > 0, F.try_divide(inter, union)).when(union.isNotNull(), 0.0)


def same_place(a: Column, b: Column, threshold: float) -> Column:
    """Duplicates: enough overlap, or the smaller box mostly inside the larger; boxes that only touch differ."""
    inter = intersection(a, b)
    smaller = F.least(area(a), area(b))
    return (inter > 0) & ((iou(a, b) >= threshold) | (F.try_divide(inter, smaller) >= CONTAINED))


def center_distance(a: Column, b: Column) -> Column:
    ax, ay, aw, ah = box_columns(a)
    bx, by, bw, bh = box_columns(b)
    return F.hypot((ax + aw / 2) - (bx + bw / 2), (ay + ah / 2) - (by + bh / 2))


def normalize(box: Column, width: Column, height: Column) -> Column:
    """Pixels to shares of the image; null where the image has no size."""
    x, y, w, h = box_columns(box)
    return F.array(*[F.try_divide(v, s) for v, s in ((x, width), (y, height), (w, width), (h, height))])


def center_to_corner(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A normalized centre box as pixel corners within the image: struct x0, y0, x1, y1."""
    return F.struct(
        F.greatest(F.lit(0.0), (cx - w / 2) * width).alias("x0"),
        F.greatest(F.lit(0.0), (cy - h / 2) * height).alias("y0"),
        F.least(width.cast("double"), (cx + w / 2) * width).alias("x1"),
        F.least(height.cast("double"), (cy + h / 2) * height).alias("y1"),
    )


def yolo_line(class_id: Column, box: Column) -> Column:
    """A normalized corner box as a label line with the centre and six decimals."""
    x, y, w, h = box_columns(box)
    return F.format_string("%d %.6f %.6f %.6f %.6f", class_id, x + w / 2, y + h / 2, w, h)


def tile_to_image(box: Column, tile: Column) -> Column:
    """A box in shares of a tile (struct x, y, w, h) as shares of the image."""
    x, y, w, h = box_columns(box)
    return F.array(
        tile["x"] + x * tile["w"], tile["y"] + y * tile["h"], w * tile["w"], h * tile["h"]
    )


def tile_grid(df: DataFrame, rows: str = "rows", cols: str = "cols", overlap: str = "overlap") -> DataFrame:
    """One row per tile of each grid: row, col, tile (struct x, y, w, h).  A grid of one row or column starts at 0."""
    w = 1 / (F.col(cols) - (F.col(cols) - 1) * F.col(overlap))
    h = 1 / (F.col(rows) - (F.col(rows) - 1) * F.col(overlap))
    grid = df.withColumn("row", F.explode(F.expr(f"sequence(0, {rows} - 1)"))).withColumn("col", F.explode(F.expr(f"sequence(0, {cols} - 1)")))
    x = F.when(F.col(cols) == 1, 0.0).otherwise(F.try_divide(F.col("col") * (1 - w), F.col(cols) - 1))
    y = F.when(F.col(rows) == 1, 0.0).otherwise(F.try_divide(F.col("row") * (1 - h), F.col(rows) - 1))
    return grid.withColumn("tile", F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")))


def clip_to_box(points: list[tuple[float, float]], box: tuple[float, float, float, float]) -> list[tuple[float, float]]:
    """The part of a polygon within a corner box, one edge of the box after the other."""
    x0, y0, x1, y1 = box
    for axis, bound, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        kept: list[tuple[float, float]] = []
        for i, p in enumerate(points):
            before = points[i - 1]
            d0, d1 = sign * (before[axis] - bound), sign * (p[axis] - bound)
            if (d0 < 0) != (d1 < 0):
                t = d0 / (d0 - d1)
                kept.append((before[0] + t * (p[0] - before[0]), before[1] + t * (p[1] - before[1])))
            if d1 >= 0:
                kept.append(p)
        points = kept
    return points


def polygon_area(points: list[tuple[float, float]]) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1]))) / 2


def coverage(points: list[tuple[float, float]], box: tuple[float, float, float, float]) -> float:
    """Share of the corner box that the polygon covers; 0 for fewer than three points and empty boxes."""
    whole = (box[2] - box[0]) * (box[3] - box[1])
    if len(points) < 3 or whole <= 0:
        return 0.0
    inside = clip_to_box(points, box)
    return polygon_area(inside) / whole if len(inside) >= 3 else 0.0


def covered_area(polygon: Column, box: Column) -> Column:
    """Area of a flat polygon [x1, y1, x2, y2, ...] within a corner box, without leaving the JVM.

    By Green's theorem it is the sum over the edges of the integral, along x
    within the box, of how high the edge stands in the box.
    """
    x0, y0, x1, y1 = (F.get(box, F.lit(i)) for i in range(4))
    n = F.size(polygon)
    clamp = lambda v, lo, hi: F.least(F.greatest(v, lo), hi)
    # the integral of the height up to y
    upto = lambda y: F.when(y <= y0, 0.0).when(y < y1, (y - y0) * (y - y0) / 2).otherwise((y1 - y0) * (y1 - y0) / 2 + (y - y1) * (y1 - y0))

    def edge(i: Column) -> Column:
        return F.struct(
            F.get(polygon, i * 2).alias("xa"), F.get(polygon, i * 2 + 1).alias("ya"), F.get(polygon, (i * 2 + 2) % n).alias("xb"), F.get(polygon, (i * 2 + 3) % n).alias("yb")
        )

    def within(e: Column) -> Column:
        left, right = clamp(e["xa"], x0, x1), clamp(e["xb"], x0, x1)
        slope = F.try_divide(e["yb"] - e["ya"], e["xb"] - e["xa"])
        return F.struct((right - left).alias("dx"), (e["ya"] + (left - e["xa"]) * slope).alias("a"), (e["ya"] + (right - e["xa"]) * slope).alias("b"))

    def integral(e: Column) -> Column:
        flat = F.abs(e["b"] - e["a"]) < 1e-9 * (F.abs(y1 - y0) + 1e-300)
        mean = F.when(flat, clamp((e["a"] + e["b"]) / 2, y0, y1) - y0).otherwise(F.try_divide(upto(e["b"]) - upto(e["a"]), e["b"] - e["a"]))
        return F.when(e["dx"] == 0, 0.0).otherwise(e["dx"] * mean)

    edges = F.transform(F.sequence(F.lit(0), (n / 2 - 1).cast("int")), edge)
    total = F.aggregate(F.transform(F.transform(edges, within), integral), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    return F.when(n >= 6, F.abs(total)).when(polygon.isNotNull(), 0.0)


def coverage_udf(polygon: Column | str, box: Column | str) -> Column:
    """``coverage`` of flat polygons and corner boxes [x0, y0, x1, y1] as a column; null for nulls."""
    polygon, box = (F.col(c) if isinstance(c, str) else c for c in (polygon, box))
    whole = (F.get(box, F.lit(2)) - F.get(box, F.lit(0))) * (F.get(box, F.lit(3)) - F.get(box, F.lit(1)))
    return F.when(whole > 0, covered_area(polygon, box) / whole).when(polygon.isNotNull() & box.isNotNull(), 0.0)


def polygon_area_column(polygon: Column) -> Column:
    """Shoelace area of a flat polygon without leaving the JVM."""
    n = F.size(polygon)
    terms = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), n / 2 - 1).cast("int")),
        lambda i: F.coalesce(
            F.get(polygon, i * 2) * F.get(polygon, (i * 2 + 3) % n) - F.get(polygon, (i * 2 + 2) % n) * F.get(polygon, i * 2 + 1), F.lit(0.0)
        ),
    )
    return F.when(n >= 6, F.abs(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)) / 2).when(polygon.isNotNull(), 0.0)
