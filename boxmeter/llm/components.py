"""Connected components by min-hooking and pointer jumping on a contracted graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmeter.session import cut, is_empty


def _jump(parents: DataFrame) -> DataFrame:
    """Halve the depth of every tree until each node points at its root."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        parents = cut(
            parents.join(up, "parent").select(
                "node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")
            )
        )
        if is_empty(parents.filter("moved")):
            return parents.select("node", "parent")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (src, dst); the root is the smallest node.

    Each round hooks every node on its smallest neighbour where that is smaller
    than itself, flattens the trees by pointer jumping, and goes on with the
    edges between roots only, so the graph shrinks from round to round.  Rows
    with a null end and loops give nothing.  No edge: no row.
    """
    e = edges.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    e = cut(e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    roots: DataFrame | None = None
    while not is_empty(e):
        both = e.select(F.col("a").alias("node"), F.col("b").alias("other")).union(e.select("b", "a"))
        hooked = both.groupBy("node").agg(F.min("other").alias("least"))
        hooked = _jump(cut(hooked.select("node", F.least("node", "least").alias("parent"))))
        ra = hooked.select(F.col("node").alias("a"), F.col("parent").alias("ra"))
        rb = hooked.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        e = cut(
            e.join(ra, "a")
            .join(rb, "b")
            .filter("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
        if roots is None:
            roots = hooked.withColumnRenamed("parent", "root")
        else:
            up = hooked.select(F.col("node").alias("root"), F.col("parent").alias("above"))
            roots = cut(roots.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")))
    if roots is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
