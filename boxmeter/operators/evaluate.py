"""Detection, classification and calibration metrics from matched boxes.

``gt`` has image_id, idx, box, damage_type, severity, part, action; ``pred`` the
same and confidence; ``images`` has image_id, position and status (success,
error, missing).  Predictions of images without success do not count, their
boxes are all missed.  All metrics are sums over per-image statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxmeter.operators.matching import FOLD_BOXES, IOU_THRESHOLD, match_in_rounds, matched_array
from boxmeter.schemas import CALIBRATION_BINS, DAMAGE_TYPES, SEVERITIES, THRESHOLDS
from boxmeter.session import cut, is_empty

FIELDS = ["damage_type", "severity", "part", "action"]


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def f1(p: Column, r: Column) -> Column:
    """Null if either is null, 0 if both are 0."""
    return F.when(p.isNotNull() & r.isNotNull(), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


def images_with_status(gt_images: DataFrame, answers: DataFrame) -> DataFrame:
    """Reference images left outer answers: status is missing without an answer, and error for any status but success."""
    a = answers.select("image_id", F.col("status").alias("answer"), F.lit(True).alias("there"))
    status = F.when(F.col("there").isNull(), "missing").when(F.col("answer") == "success", "success").otherwise("error")
    return gt_images.join(a, "image_id", "left").withColumn("status", status).drop("answer", "there")


def unknown_answers(gt_images: DataFrame, answers: DataFrame) -> DataFrame:
    """Ids of answers that no reference image has."""
    return answers.select("image_id").join(gt_images.select("image_id"), "image_id", "left_anti").distinct()


def counted(images: DataFrame, gt: DataFrame, pred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reference boxes of the images, and predictions of the successful ones."""
    good = images.filter("status = 'success'").select("image_id")
    return gt.join(images.select("image_id"), "image_id", "left_semi"), pred.join(good, "image_id", "left_semi")


def _boxes(df: DataFrame, *more: str) -> Column:
    there = [c for c in ("idx", "box", *FIELDS, *more) if c in df.columns]
    return F.struct(*[F.col(c).cast("long").alias(c) if c == "idx" else F.col(c) for c in there])


def parts(images: DataFrame, gt: DataFrame, pred: DataFrame, threshold: float = IOU_THRESHOLD, fold_boxes: int = FOLD_BOXES) -> DataFrame:
    """image_id, status, gts, preds, pairs: the boxes of an image, its counted predictions and what was matched, from which all metrics are sums.

    Every side is read and moved once.  pairs holds (g, p, iou), places from 1
    in the arrays.  An image of more than ``fold_boxes`` boxes of a side stands
    in several rows of few boxes each.
    """
    sides = gt.select("image_id", F.lit(0).alias("side")).union(pred.select("image_id", F.lit(1).alias("side")))
    big = cut(sides.groupBy("image_id", "side").count().filter(F.col("count") > fold_boxes).select("image_id").distinct())
    if is_empty(big):
        return _folded_parts(images, gt, pred, threshold)
    small, crowded = (tuple(df.join(big, "image_id", how) for df in (images, gt, pred)) for how in ("left_anti", "left_semi"))
    g, p = counted(*crowded)
    return _folded_parts(*small, threshold).unionByName(parts_of_pairs(*crowded, match_in_rounds(g, p, threshold, fold_boxes)))


def _folded_parts(images: DataFrame, gt: DataFrame, pred: DataFrame, threshold: float) -> DataFrame:
    g = gt.groupBy("image_id").agg(F.array_sort(F.collect_list(_boxes(gt))).alias("gts"))
    ranked = F.struct((-F.col("confidence")).alias("rank"), _boxes(pred, "confidence").alias("b"))
    p = pred.groupBy("image_id").agg(F.array_sort(F.collect_list(ranked)).alias("ranked"))
    all_ = images.select("image_id", "status").join(g, "image_id", "left").join(p, "image_id", "left")
    good = F.when(F.col("status") == "success", F.col("ranked"))
    kept = F.coalesce(good, F.array().cast(p.schema["ranked"].dataType))
    rows = all_.select("image_id", "status", F.coalesce("gts", F.array().cast(g.schema["gts"].dataType)).alias("gts"), F.transform(kept, lambda x: x["b"]).alias("preds"))
    places = lambda c, rank: F.transform(F.col(c), lambda x, i: F.struct(*([(-x["confidence"]).alias("rank")] if rank else []), (i + 1).cast("long").alias("idx"), x["box"].alias("box")))
    found = matched_array(places("gts", False), places("preds", True), threshold)
    pairs = F.transform(found, lambda m: F.struct(m["gt"].cast("int").alias("g"), m["pred"].cast("int").alias("p"), m["iou"].alias("iou")))
    # a generator of one row, which no projection is merged with: the matching runs once
    return rows.select("image_id", "status", "gts", "preds", F.explode(F.array(pairs)).alias("pairs"))


def parts_of_pairs(images: DataFrame, gt: DataFrame, pred: DataFrame, pairs: DataFrame) -> DataFrame:
    """``parts`` of boxes that were matched before (image_id, gt, pred, iou): a row per image, per pair, and per box without a partner."""
    g, p = counted(images, gt, pred)
    g = g.select("image_id", F.col("idx").cast("long").alias("gt"), _boxes(gt).alias("gb"))
    p = p.select("image_id", F.col("idx").cast("long").alias("pred"), _boxes(pred, "confidence").alias("pb"))
    met = pairs.select("image_id", F.col("gt").cast("long").alias("gt"), F.col("pred").cast("long").alias("pred"), "iou")
    none = {c: F.lit(None).cast(df.schema[c].dataType).alias(c) for df, c in ((g, "gb"), (p, "pb"), (met, "iou"))}
    left = g.join(met, ["image_id", "gt"], "left").join(p, ["image_id", "pred"], "left").select("image_id", "gb", "pb", "iou")
    right = p.join(met, ["image_id", "pred"], "left_anti").select("image_id", none["gb"], "pb", none["iou"])
    whole = images.select("image_id", none["gb"], none["pb"], none["iou"])
    one = lambda c: F.array_compact(F.array(c))
    link = F.struct(F.lit(1).alias("g"), F.lit(1).alias("p"), "iou")
    rows = left.unionByName(right).unionByName(whole).select("image_id", one("gb").alias("gts"), one("pb").alias("preds"), one(F.when(F.col("iou").isNotNull(), link)).alias("pairs"))
    return rows.join(images.select("image_id", "status"), "image_id").select("image_id", "status", "gts", "preds", "pairs")


def pairs_of(rows: DataFrame) -> DataFrame:
    """One row per pair of ``parts``: image_id, gt, pred, iou, confidence, and g_ / p_ of each field."""
    each = rows.select("image_id", "gts", "preds", F.explode("pairs").alias("m")).select("image_id", "m.iou", F.element_at("gts", F.col("m.g")).alias("g"), F.element_at("preds", F.col("m.p")).alias("p"))
    return each.select("image_id", F.col("p.idx").alias("pred"), F.col("g.idx").alias("gt"), "iou", *[F.col(f"g.{f}").alias(f"g_{f}") for f in FIELDS], "p.confidence", *[F.col(f"p.{f}").alias(f"p_{f}") for f in FIELDS])


def matched_pairs(images: DataFrame, gt: DataFrame, pred: DataFrame, threshold: float = IOU_THRESHOLD) -> DataFrame:
    """``pairs_of`` the ``parts`` of a set of images."""
    return pairs_of(parts(images, gt, pred, threshold))


def per_image(images: DataFrame, gt: DataFrame, pred: DataFrame, pairs: DataFrame) -> DataFrame:
    return per_image_of(parts_of_pairs(images, gt, pred, pairs))


def per_image_of(rows: DataFrame) -> DataFrame:
    """image_id, status, tp, fp, fn of every image."""
    n = [F.sum(F.size(c)).alias(c) for c in ("gts", "preds", "pairs")]
    t = rows.groupBy("image_id").agg(F.min("status").alias("status"), *n)
    return t.select("image_id", "status", F.col("pairs").alias("tp"), (F.col("preds") - F.col("pairs")).alias("fp"), (F.col("gts") - F.col("pairs")).alias("fn"))


def detection(report: DataFrame) -> DataFrame:
    """Totals of ``per_image`` with precision, recall and F1."""
    t = report.agg(
        F.count("*").alias("images"), F.count_if(F.col("status") != "success").alias("images_failed"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")],
    )
    t = t.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return t.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def _dense(spark, values: list[str], name: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def _known_class(c: Column) -> Column:
    """Fail on classes outside the enumeration instead of dropping them."""
    return F.when(c.isin(DAMAGE_TYPES), c).otherwise(F.raise_error(F.concat(F.lit("unknown damage_type "), F.coalesce(c, F.lit("null")))).cast("string"))


def per_class(images: DataFrame, gt: DataFrame, pred: DataFrame, pairs: DataFrame) -> DataFrame:
    return per_class_of(parts_of_pairs(images, gt, pred, pairs))


def per_class_of(rows: DataFrame) -> DataFrame:
    """Class counts on top of class-agnostic pairs: a wrong type is a false alarm of its own class and a miss of the true one.  Every class has a row."""
    said = lambda c, side: F.transform(F.col(c), lambda x: F.struct(F.lit(side).alias("side"), x["damage_type"].alias("damage_type")))
    right = F.filter(F.transform("pairs", lambda m: F.struct(F.element_at("gts", m["g"])["damage_type"].alias("g"), F.element_at("preds", m["p"])["damage_type"].alias("p"))), lambda m: m["g"] == m["p"])
    hits = F.transform(right, lambda m: F.struct(F.lit("tp").alias("side"), m["g"].alias("damage_type")))
    each = rows.select(F.explode(F.concat(said("gts", "gt"), said("preds", "pred"), hits)).alias("x")).select("x.side", _known_class(F.col("x.damage_type")).alias("damage_type"))
    got = each.groupBy("damage_type").agg(*[F.count_if(F.col("side") == s).alias(f"n_{s}") for s in ("gt", "pred", "tp")])
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = _dense(rows.sparkSession, DAMAGE_TYPES, "damage_type").join(got, "damage_type", "left")
    out = out.select("damage_type", zero("n_tp").alias("tp"), (zero("n_pred") - zero("n_tp")).alias("fp"), (zero("n_gt") - zero("n_tp")).alias("fn"))
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def macro_f1(classes: DataFrame) -> DataFrame:
    """Mean F1 over classes with any count; a class without F1 counts 0; null without classes."""
    return classes.agg(F.avg(F.when(F.col("tp") + F.col("fp") + F.col("fn") > 0, F.coalesce("f1", F.lit(0.0)))).alias("macro_f1"))


def field_accuracy(pairs: DataFrame) -> DataFrame:
    """field, n, correct, accuracy over the pairs whose prediction carries the field."""
    each = pairs.select(
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"g_{f}").alias("g"), F.col(f"p_{f}").alias("p")) for f in FIELDS])).alias("x")
    ).select("x.*")
    got = each.filter("p IS NOT NULL").groupBy("field").agg(F.count("*").alias("n"), F.count_if(F.col("g") == F.col("p")).alias("correct"))
    out = _dense(pairs.sparkSession, FIELDS, "field").join(got, "field", "left")
    return out.select("field", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("correct", F.lit(0)).alias("correct")).withColumn(
        "accuracy", ratio(F.col("correct"), F.col("n"))
    )


def severity_confusion(pairs: DataFrame) -> DataFrame:
    """gt rows, prediction columns, all severities; predictions outside the enumeration are left out."""
    wide = pairs.groupBy(F.col("g_severity").alias("gt")).pivot("p_severity", SEVERITIES).count()
    return _dense(pairs.sparkSession, SEVERITIES, "gt").join(wide, "gt", "left").fillna(0)


def confidence_scores(pairs: DataFrame) -> DataFrame:
    """n, brier (mean squared distance of confidence from being right) and pearson (null below two pairs or without variance)."""
    y = (F.col("g_damage_type") == F.col("p_damage_type")).cast("double")
    t = pairs.select(F.col("confidence").alias("c"), y.alias("y")).agg(
        F.count("*").alias("n"), F.sum(F.pow(F.col("c") - F.col("y"), F.lit(2))).alias("sq"), F.sum("c").alias("sc"), F.sum("y").alias("sy"),
        F.sum(F.col("c") * F.col("c")).alias("scc"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(F.col("c") * F.col("y")).alias("scy"),
        F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
    )
    cov = F.col("scy") - F.col("sc") * F.col("sy") / F.col("n")
    var = (F.col("scc") - F.col("sc") * F.col("sc") / F.col("n")) * (F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"))
    r = F.when((F.col("c0") < F.col("c1")) & (F.col("y0") < F.col("y1")), F.try_divide(cov, F.sqrt(F.greatest(F.lit(0.0), var))))
    return t.select("n", ratio(F.col("sq"), F.col("n")).alias("brier"), r.alias("pearson"))


def calibration(pairs: DataFrame) -> DataFrame:
    """confidence_range, count, empirical_accuracy, mean_confidence; every bin has a row, the last one holds 1.0."""
    spark = pairs.sparkSession
    label = None
    for lo, hi in CALIBRATION_BINS:
        c = F.col("confidence")
        inside = (c >= lo) & ((c <= hi) if hi == 1.0 else (c < hi))
        label = F.when(inside, f"{lo:.1f}-{hi:.1f}") if label is None else label.when(inside, f"{lo:.1f}-{hi:.1f}")
    got = pairs.withColumn("confidence_range", label).groupBy("confidence_range").agg(
        F.count("*").alias("count"), F.count_if(F.col("g_damage_type") == F.col("p_damage_type")).alias("correct"), F.sum("confidence").alias("total")
    )
    out = _dense(spark, [f"{lo:.1f}-{hi:.1f}" for lo, hi in CALIBRATION_BINS], "confidence_range").join(got, "confidence_range", "left")
    n = F.coalesce("count", F.lit(0))
    return out.select("confidence_range", n.alias("count"), ratio(F.col("correct"), n).alias("empirical_accuracy"), ratio(F.col("total"), n).alias("mean_confidence"))


def image_level(images: DataFrame, gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Presence of classes per image: tp, fp, fn of distinct types, precision, recall."""
    g, p = counted(images, gt, pred)
    both = g.select("image_id", "damage_type").distinct().withColumn("g", F.lit(1)).join(
        p.select("image_id", "damage_type").distinct().withColumn("p", F.lit(1)), ["image_id", "damage_type"], "full_outer"
    )
    t = both.agg(
        F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn")
    )
    return t.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))


def selective_curve(images: DataFrame, gt: DataFrame, pred: DataFrame, pairs: DataFrame) -> DataFrame:
    return selective_curve_of(parts_of_pairs(images, gt, pred, pairs))


def selective_curve_of(rows: DataFrame) -> DataFrame:
    """What remains above each threshold of confidence.

    Greedy matching by confidence keeps its pairs when weak predictions go, so
    one matching serves all thresholds.  An image is automatic where all its
    predictions clear the threshold (also where it has none), and perfect where
    besides all are right and as many as the reference boxes.
    """
    hits = F.transform(
        "pairs", lambda m: F.struct(F.element_at("preds", m["p"])["confidence"].alias("c"), (F.element_at("gts", m["g"])["damage_type"] == F.element_at("preds", m["p"])["damage_type"]).alias("right"))
    )
    levels = F.array(*[F.lit(t) for t in THRESHOLDS])
    above = lambda array, test: F.transform(levels, lambda t: F.size(F.filter(array, lambda x: test(x, t))).cast("long"))
    of_row = rows.select(
        "image_id", F.size("gts").alias("n_gt"), F.size("preds").alias("n"), F.array_min(F.transform("preds", lambda p: p["confidence"])).alias("low"), F.size(F.filter(hits, lambda h: h["right"])).alias("n_right"),
        above(F.col("preds"), lambda p, t: p["confidence"] >= t).alias("accepted"), above(hits, lambda h, t: h["c"] >= t).alias("matched"), above(hits, lambda h, t: (h["c"] >= t) & h["right"]).alias("right"),
    )
    add = lambda c: F.array(*[F.sum(F.col(c)[i]) for i in range(len(THRESHOLDS))]).alias(c)
    of_image = of_row.groupBy("image_id").agg(F.sum("n_gt").alias("n_gt"), F.sum("n").alias("n"), F.min("low").alias("low"), F.sum("n_right").alias("n_right"), *[add(c) for c in ("accepted", "matched", "right")])
    perfect = (F.col("n") == F.col("n_gt")) & (F.col("n_right") == F.col("n"))
    clear = lambda also: F.transform(levels, lambda t: ((F.coalesce("low", F.lit(float("inf"))) >= t) & also).cast("long"))
    facts = of_image.select("n_gt", "n", "accepted", "matched", "right", clear(F.lit(True)).alias("auto"), clear(perfect).alias("perfect"))
    counts = ("accepted", "matched", "right", "auto", "perfect")
    sums = facts.agg(F.coalesce(F.sum("n_gt"), F.lit(0)).alias("n_gt"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pred"), *[add(c) for c in counts])
    at = sums.select("n_gt", "n_pred", F.posexplode(levels).alias("i", "threshold"), *counts)
    v = {c: F.coalesce(F.element_at(c, F.col("i") + 1), F.lit(0)) for c in counts}
    return at.select(
        "threshold", v["accepted"].alias("accepted"), ratio(v["accepted"], F.col("n_pred")).alias("coverage"), ratio(v["matched"], v["accepted"]).alias("precision"),
        ratio(v["right"], v["matched"]).alias("type_accuracy"), ratio(v["matched"], F.col("n_gt")).alias("recall"),
        v["auto"].alias("images_all_predictions_accepted"), v["perfect"].alias("images_fully_correct_and_accepted"),
    )
