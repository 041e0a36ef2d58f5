"""Greedy one-to-one matching and suppression of duplicates.

Images of usual size are folded in the JVM: their boxes stand in arrays and a
higher-order aggregate walks the predictions.  Images beyond ``FOLD_BOXES`` are
matched in rounds over candidate pairs, those of many predictions from a grid, so
that no image has to fit into one task; both ways give the same pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxmeter.operators.geometry import area, box_columns, intersection, iou, overlap_ratio, same_place
from boxmeter.session import cut, cut_table, is_empty

IOU_THRESHOLD = 0.5
FOLD_BOXES = 400


def image_arrays(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """image_id, gts, preds: the boxes of an image as arrays in index order.

    ``gt`` has image_id, idx, box; ``pred`` also confidence.  Images of either
    side are kept; the other array is then empty.
    """
    g = gt.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("idx", "box"))).alias("gts"))
    p = pred.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("rank"), "idx", "box"))).alias("preds"))
    both = g.join(p, "image_id", "full_outer")
    return both.select(
        "image_id",
        F.coalesce("gts", F.array().cast("array<struct<idx:bigint,box:array<double>>>")).alias("gts"),
        F.coalesce("preds", F.array().cast("array<struct<rank:double,idx:bigint,box:array<double>>>")).alias("preds"),
    )


def matched_array(gts: Column, preds: Column, threshold: float) -> Column:
    """The pairs (gt, pred, iou) of one image.  Each prediction by falling confidence takes the free box of largest overlap, the first on ties."""

    def edges_of(p: Column) -> Column:
        met = F.transform(
            gts, lambda g: F.struct(intersection(g["box"], p["box"]).alias("inter"), (area(g["box"]) + area(p["box"])).alias("both"), g["idx"].alias("gt"))
        )
        scored = F.transform(
            F.filter(met, lambda m: m["inter"] > 0),
            lambda m: F.struct(p["rank"].alias("rank"), p["idx"].alias("pred"), (-F.try_divide(m["inter"], m["both"] - m["inter"])).alias("neg"), m["gt"].alias("gt")),
        )
        return F.filter(scored, lambda e: -e["neg"] >= threshold)

    # only overlaps of the threshold and more can be taken, so the walk goes over few edges:
    # in the order of predictions, then overlaps, each edge whose ends are both free is a pair
    edges = F.array_sort(F.flatten(F.transform(preds, edges_of)))
    empty = F.array().cast("array<struct<gt:bigint,pred:bigint,iou:double>>")

    def take(pairs: Column, e: Column) -> Column:
        taken = F.exists(pairs, lambda m: (m["gt"] == e["gt"]) | (m["pred"] == e["pred"]))
        return F.when(taken, pairs).otherwise(F.concat(pairs, F.array(F.struct(e["gt"].alias("gt"), e["pred"].alias("pred"), (-e["neg"]).alias("iou")))))

    return F.aggregate(edges, empty, take)


#: Below this overlap the grid of like sizes has more cells than the grid of all overlapping boxes.
LEAST_GRID_OVERLAP = 0.3


def _candidates(gt: DataFrame, pred: DataFrame, threshold: float, fold_boxes: int) -> DataFrame:
    """Pairs that may match, once for each pair of rows or less.

    A box of an image of up to ``fold_boxes`` predictions meets all of them,
    which are fewer than the cells that a grid would copy it to; other images
    go through the grid.
    """
    g, p = (df.select("image_id", F.col("idx").cast("long").alias("idx"), *columns, "box") for df, columns in ((gt, []), (pred, ["confidence"])))
    crowded = cut(p.groupBy("image_id").count().filter(F.col("count") > fold_boxes).select("image_id"))
    if is_empty(crowded):
        return _all_pairs(g, p, threshold)
    few, many = (tuple(df.join(crowded, "image_id", how) for df in (g, p)) for how in ("left_anti", "left_semi"))
    return _all_pairs(*few, threshold).union(_grid_pairs(*many, threshold))


def _all_pairs(g: DataFrame, p: DataFrame, threshold: float) -> DataFrame:
    def flat(df: DataFrame, at: str, *columns: str) -> DataFrame:
        x, y, w, h = box_columns(F.col("box"))
        ends = [x.alias(f"{at}x"), y.alias(f"{at}y"), (x + w).alias(f"{at}r"), (y + h).alias(f"{at}b"), area(F.col("box")).alias(f"{at}a")]
        return df.filter("box IS NOT NULL").select("image_id", *columns, *ends)

    # every pair is looked at, by numbers that stand ready: over arrays the overlap is more code than the JVM compiles
    pairs = flat(g, "g", F.col("idx").alias("gt")).join(flat(p, "p", F.col("idx").alias("pred"), "confidence"), "image_id")
    width, height = (F.greatest(F.lit(0.0), F.least(f"g{end}", f"p{end}") - F.greatest(f"g{at}", f"p{at}")) for at, end in ("xr", "yb"))
    return _near(pairs, overlap_ratio(width * height, F.col("ga") + F.col("pa")), threshold)


def _near(pairs: DataFrame, overlap: Column, threshold: float) -> DataFrame:
    pairs = pairs.withColumn("iou", overlap)
    return pairs.filter(F.col("iou") >= threshold if threshold > 0 else F.col("iou") > 0).select("image_id", "gt", "pred", "confidence", "iou")


def _grid_pairs(g: DataFrame, p: DataFrame, threshold: float) -> DataFrame:
    """Pairs that may match, by a grid, without looking at all pairs of an image.

    An overlap of t makes sides differ by a factor of 1 / t at most and centres
    by (1 - t) / 2t of the prediction's side.  So a prediction in a cell of its
    size meets the boxes of few sizes from few cells around; for small t all
    boxes that overlap at all are met.
    """
    if threshold < LEAST_GRID_OVERLAP:
        typed = lambda df: df.withColumn("damage_type", F.lit(None).cast("string"))
        met = _met(typed(g), typed(p)).select("image_id", F.col("a").alias("gt"), F.col("b").alias("pred"), F.col("a_box").alias("gb"), F.col("b_box").alias("pb"))
        pairs = met.join(p.select("image_id", F.col("idx").alias("pred"), "confidence"), ["image_id", "pred"])
    else:
        levels, reach = math.ceil(-math.log2(threshold)), math.ceil((1 - threshold) / threshold)
        size = lambda i: F.floor(F.log2(F.greatest(F.lit(1e-9), F.col("box")[i])))
        cell = lambda i, k: F.floor((F.col("box")[i] + F.col("box")[i + 2] / 2) / F.pow(F.lit(2.0), F.col(k)))
        p = p.withColumn("kx", size(2)).withColumn("ky", size(3)).withColumn("cx", cell(0, "kx")).withColumn("cy", cell(1, "ky"))
        around = F.array(*[F.lit(d) for d in range(-levels, levels + 1)])
        wide = F.array(*[F.lit(d) for d in range(-reach, reach + 1)])
        g = g.withColumn("kx", F.explode(F.transform(around, lambda d: size(2) + d))).withColumn("ky", F.explode(F.transform(around, lambda d: size(3) + d)))
        g = g.withColumn("cx", F.explode(F.transform(wide, lambda d: cell(0, "kx") + d))).withColumn("cy", F.explode(F.transform(wide, lambda d: cell(1, "ky") + d)))
        pairs = p.select("image_id", "kx", "ky", "cx", "cy", F.col("idx").alias("pred"), "confidence", F.col("box").alias("pb")).join(
            g.select("image_id", "kx", "ky", "cx", "cy", F.col("idx").alias("gt"), F.col("box").alias("gb")), ["image_id", "kx", "ky", "cx", "cy"]
        )
    return _near(pairs, iou(F.col("gb"), F.col("pb")), threshold).distinct()


def match_in_rounds(gt: DataFrame, pred: DataFrame, threshold: float = IOU_THRESHOLD, fold_boxes: int = FOLD_BOXES) -> DataFrame:
    """The pairs (image_id, gt, pred, iou) of greedy matching, found in rounds over candidate pairs.

    In a round every free prediction looks at its best free box; it takes the
    box if no prediction before it could want that box.  A round moves the pairs
    left at most twice, by box and by prediction.
    """
    at = lambda c, *order: Window.partitionBy("image_id", c).orderBy(*order)
    of_gt = at("gt", F.desc("take"), F.desc_nulls_first("confidence"), "pred")
    of_pred = at("pred", F.desc("iou"), "gt")
    left = _candidates(gt, pred, threshold, fold_boxes).withColumn("take", F.lit(False))
    done: DataFrame | None = None
    while done is None or not is_empty(left.filter("NOT take")):
        # a box that was taken goes with all its pairs; the others are wanted by the first prediction left
        wanted = left.select("*", F.first("take").over(of_gt).alias("gone"), F.first("pred").over(of_gt).alias("by")).filter("NOT gone")
        best = wanted.select("*", F.row_number().over(of_pred).alias("place"), (F.first("by").over(of_pred) == F.col("pred")).alias("found"))
        left = cut_table(best.filter("NOT found OR place = 1").select("image_id", "gt", "pred", "confidence", "iou", F.col("found").alias("take")))
        take = left.filter("take").select("image_id", "gt", "pred", "iou")
        done = take if done is None else done.union(take)
    return done


def greedy_match(gt: DataFrame, pred: DataFrame, threshold: float = IOU_THRESHOLD, fold_boxes: int = FOLD_BOXES) -> DataFrame:
    """(image_id, gt, pred, iou): one-to-one pairs, predictions by falling confidence, then index; class-agnostic.

    Boxes that are null overlap nothing.  Images with more than ``fold_boxes``
    boxes of a side go through ``match_in_rounds``.
    """
    g, p = gt.select("image_id", F.col("idx").cast("long").alias("idx"), "box"), pred.select("image_id", F.col("idx").cast("long").alias("idx"), "confidence", "box")
    big = g.groupBy("image_id").count().union(p.groupBy("image_id").count()).filter(F.col("count") > fold_boxes).select("image_id").distinct()
    if not is_empty(big := cut(big)):
        small_g, small_p = g.join(big, "image_id", "left_anti"), p.join(big, "image_id", "left_anti")
        rest = match_in_rounds(g.join(big, "image_id", "left_semi"), p.join(big, "image_id", "left_semi"), threshold, fold_boxes)
        return _fold(small_g, small_p, threshold).unionByName(rest)
    return _fold(g, p, threshold)


def _fold(g: DataFrame, p: DataFrame, threshold: float) -> DataFrame:
    arrays = image_arrays(g, p).filter("size(gts) > 0 AND size(preds) > 0")
    pairs = arrays.select("image_id", F.explode(matched_array(F.col("gts"), F.col("preds"), threshold)).alias("m"))
    return pairs.select("image_id", "m.gt", "m.pred", "m.iou")


def _same_place_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(image_id, damage_type, a, b): boxes a of ``left`` and b of ``right`` in the same place, without looking at all pairs."""
    near = _met(left, right).filter(same_place(F.col("a_box"), F.col("b_box"), threshold))
    return near.select("image_id", F.when(~F.col("untyped"), F.col("damage_type")).alias("damage_type"), "a", "b").distinct()


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Boxes a of ``left`` and b of ``right`` of one type, all that overlap among them (a pair may stand several times).

    Boxes that overlap have their middles within the larger one's longer side,
    so both meet in a grid of that size or in the cell next to it.
    """
    level = F.ceil(F.log2(F.greatest(F.lit(1e-9), F.col("box")[2], F.col("box")[3])))
    cell = lambda i, k: F.floor((F.col("box")[i] + F.col("box")[i + 2] / 2) / F.pow(F.lit(2.0), F.col(k)))
    near = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    # boxes without a type are of one type, as in the fold
    kept = lambda df, name: df.select("image_id", F.coalesce("damage_type", F.lit("")).alias("damage_type"), F.col("damage_type").isNull().alias("untyped"), F.col("idx").cast("long").alias(name), "box", level.alias("own"))
    l, r = kept(left, "a"), kept(right, "b")
    top = l.select("image_id", "own").union(r.select("image_id", "own")).groupBy("image_id").agg(F.max("own").alias("top"))

    def large(df: DataFrame, name: str) -> DataFrame:
        at = df.withColumn("k", F.col("own")).withColumn("cx", cell(0, "k")).withColumn("cy", cell(1, "k"))
        return at.select("image_id", "damage_type", "untyped", "k", "cx", "cy", name, F.col("box").alias(f"{name}_box"))

    def small(df: DataFrame, name: str) -> DataFrame:
        at = df.join(top, "image_id").withColumn("k", F.explode(F.sequence("own", "top")))
        at = at.withColumn("cx", F.explode(F.transform(near, lambda d: cell(0, "k") + d))).withColumn("cy", F.explode(F.transform(near, lambda d: cell(1, "k") + d)))
        return at.select("image_id", "damage_type", "untyped", "k", "cx", "cy", name, F.col("box").alias(f"{name}_box"))

    on = ["image_id", "damage_type", "untyped", "k", "cx", "cy"]
    columns = ["image_id", "damage_type", "untyped", "a", "b", "a_box", "b_box"]
    return large(l, "a").join(small(r, "b"), on).select(*columns).union(small(l, "a").join(large(r, "b"), on).select(*columns))


def _suppress_in_rounds(boxes: DataFrame, threshold: float) -> DataFrame:
    """(image_id, idx): in each round the boxes that no stronger live one covers are kept, and what they cover goes."""
    b = boxes.select("image_id", "damage_type", F.col("idx").cast("long").alias("idx"), "confidence", "box")
    rank = lambda n: b.select("image_id", F.col("idx").alias(n), F.struct((-F.col("confidence")).alias("r"), "idx").alias(f"r{n}"))
    pairs = _same_place_pairs(b, b, threshold).join(rank("a"), ["image_id", "a"]).join(rank("b"), ["image_id", "b"])
    pairs = cut_table(pairs.filter("ra < rb").select("image_id", "a", "b"))  # a is stronger than b
    gone: DataFrame | None = None
    while not is_empty(pairs):
        weaker = pairs.select("image_id", F.col("b").alias("a")).distinct()
        lost = cut_table(pairs.join(weaker, ["image_id", "a"], "left_anti").select("image_id", "b").distinct())
        gone = lost if gone is None else gone.union(lost)
        pairs = cut_table(pairs.join(lost, ["image_id", "b"], "left_anti").join(lost.withColumnRenamed("b", "a"), ["image_id", "a"], "left_anti"))
    all_ = b.select("image_id", "idx")
    return all_ if gone is None else all_.join(gone.withColumnRenamed("b", "idx"), ["image_id", "idx"], "left_anti")


def suppress_duplicates(boxes: DataFrame, threshold: float, fold_boxes: int = FOLD_BOXES) -> DataFrame:
    """(image_id, idx) of the boxes kept: by falling confidence, a box goes if a kept one of its type is in the same place.

    ``boxes`` has image_id, idx, damage_type, confidence, box.  A prediction is
    compared with kept ones of its own type only, so types are folded apart;
    images with more than ``fold_boxes`` boxes go in rounds over near pairs.
    Boxes without a type are of one type.  Rows of one image_id and idx are one
    box, that of the strongest row.
    """
    boxes = _one_per_index(boxes)
    big = boxes.groupBy("image_id").count().filter(F.col("count") > fold_boxes).select("image_id")
    if not is_empty(big := cut(big)):
        rest = _suppress_in_rounds(boxes.join(big, "image_id", "left_semi"), threshold)
        return _suppress_by_fold(boxes.join(big, "image_id", "left_anti"), threshold).unionByName(rest)
    return _suppress_by_fold(boxes, threshold)


def _one_per_index(boxes: DataFrame) -> DataFrame:
    first = F.min(F.struct((-F.col("confidence")).alias("rank"), "damage_type", "box")).alias("b")
    one = boxes.groupBy("image_id", F.col("idx").cast("long").alias("idx")).agg(first)
    return one.select("image_id", "idx", "b.damage_type", (-F.col("b.rank")).alias("confidence"), "b.box")


def _suppress_by_fold(boxes: DataFrame, threshold: float) -> DataFrame:
    per = boxes.groupBy("image_id", "damage_type").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("rank"), F.col("idx").cast("long").alias("idx"), "box"))).alias("b")
    )
    empty = F.array().cast("array<struct<rank:double,idx:bigint,box:array<double>>>")
    kept = F.aggregate(
        "b", empty, lambda k, x: F.when(F.exists(k, lambda y: F.coalesce(same_place(y["box"], x["box"], threshold), F.lit(False))), k).otherwise(F.concat(k, F.array(x)))
    )
    return per.select("image_id", F.explode(kept).alias("k")).select("image_id", "k.idx")


def second_look(found: DataFrame, fresh: DataFrame, threshold: float, fold_boxes: int = FOLD_BOXES) -> DataFrame:
    """(image_id, idx, look): all boxes of the first look, and those of the second that repeat none of them nor each other."""
    seen = _same_place_pairs(found, fresh, threshold).select("image_id", F.col("b").alias("idx")).distinct()
    new = suppress_duplicates(fresh.withColumn("idx", F.col("idx").cast("long")).join(seen, ["image_id", "idx"], "left_anti"), threshold, fold_boxes)
    return found.select("image_id", F.col("idx").cast("long").alias("idx"), F.lit(1).alias("look")).distinct().unionByName(new.select("image_id", "idx", F.lit(2).alias("look")))


def existing_before(before: DataFrame, after: DataFrame, reach: float) -> DataFrame:
    """``after`` with state: EXISTING where a box of the same view, type and part was there before within ``reach`` of centres, NEW, or NOT_COMPARED where the view has no earlier photo.

    Both have view, damage_type, part, cx, cy; ``before`` may hold rows without
    damage (null damage_type) that only say that the view was seen.  The view
    ``extra`` and null views are never compared.  Many may exist by one earlier box.
    """
    seen = before.filter("view IS NOT NULL AND view <> 'extra'")
    views = seen.select("view").distinct().withColumn("known", F.lit(True))
    # centres within reach lie in the same or a neighbouring cell, so a hot key is split by place
    spot = lambda c: F.floor(F.col(c) / reach)
    near = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    old = (
        seen.filter("damage_type IS NOT NULL")
        .select("view", "damage_type", "part", F.col("cx").alias("ox"), F.col("cy").alias("oy"), spot("cx").alias("sx"), spot("cy").alias("sy"))
        .distinct()
        .withColumn("sx", F.explode(F.transform(near, lambda d: F.col("sx") + d)))
        .withColumn("sy", F.explode(F.transform(near, lambda d: F.col("sy") + d)))
    )
    new = after.withColumn("sx", spot("cx")).withColumn("sy", spot("cy"))
    hit = [new[c].eqNullSafe(old[c]) for c in ("view", "damage_type", "part")] + [new.sx == old.sx, new.sy == old.sy]
    close = F.hypot(new.cx - old.ox, new.cy - old.oy) <= reach
    condition = close
    for h in hit:
        condition = condition & h
    state = new.join(old, condition, "left_semi").withColumn("state", F.lit("EXISTING"))
    other = new.join(old, condition, "left_anti").join(views, "view", "left")
    rest = other.withColumn("state", F.when(F.col("known"), "NEW").otherwise("NOT_COMPARED")).drop("known")
    return state.unionByName(rest).drop("sx", "sy")


def row_positions(df: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """idx from 0 within ``by``."""
    return df.withColumn("idx", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)
