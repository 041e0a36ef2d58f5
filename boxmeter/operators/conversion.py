"""From raw label files to an annotation pool, labeling sheets and ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxmeter.functions.text import DAMAGE_RULES, PART_RULES, map_name
from boxmeter.operators.geometry import center_to_corner, coverage_udf
from boxmeter.schemas import DAMAGE_TYPES, LABEL_FIELDS

# fixed values
PART_BY_DAMAGE_TYPE = {"lamp_broken": "light"}
LEAST_COVERAGE = 0.10


def damage_boxes(lines: DataFrame, images: DataFrame, names: DataFrame) -> DataFrame:
    """Damage lines as pixel corners with a problem: bad_damage_line, empty_box or null.

    ``lines`` has stem, line_no, class_id, values; ``images`` image_id, stem,
    width, height; ``names`` class_id, name.  Class names without a rule fail.
    """
    cx, cy, w, h = (F.get("values", F.lit(i)) for i in range(4))
    boxes = lines.join(images, "stem").join(names, "class_id", "left")
    corners = F.when(F.size("values") == 4, center_to_corner(cx, cy, w, h, F.col("width"), F.col("height")))
    problem = F.when(F.size("values") != 4, "bad_damage_line").when((corners["x1"] <= corners["x0"]) | (corners["y1"] <= corners["y0"]), "empty_box")
    return boxes.select("image_id", "stem", "line_no", map_name(F.col("name"), DAMAGE_RULES).alias("damage_type"), corners.alias("corners"), problem.alias("problem"))


def annotate(boxes: DataFrame, parts: DataFrame) -> DataFrame:
    """Annotations with the part whose polygon covers most of the box (the first on ties).

    ``boxes`` as ``damage_boxes`` gives them; ``parts`` has image_id, part_no,
    name, polygon (pixels, flat).  Below LEAST_COVERAGE there is no part; broken
    lamps are always on lights, counted after the part was found missing.
    """
    good = boxes.filter("problem IS NULL")
    flat = F.array("corners.x0", "corners.y0", "corners.x1", "corners.y1")
    own = parts.filter(F.size("polygon") >= 6).select("image_id", "part_no", F.col("name").alias("source"), map_name(F.col("name"), PART_RULES, "other").alias("part"), "polygon")
    # polygons that do not even reach the box's frame drop out before they are measured
    every_other = lambda k: lambda v, i: i % 2 == k
    ends = [f(F.filter("polygon", every_other(k))) for k in (0, 1) for f in (F.array_min, F.array_max)]
    own = own.select("*", *[e.alias(c) for e, c in zip(ends, ("px0", "px1", "py0", "py1"))])
    near = good.join(own, "image_id").filter("px0 <= corners.x1 AND px1 >= corners.x0 AND py0 <= corners.y1 AND py1 >= corners.y0")
    scored = near.withColumn("c", F.round(coverage_udf(F.col("polygon"), flat), 12)).filter("c > 0")  # equal coverages tie whatever the order of sums
    best = scored.groupBy("image_id", "line_no").agg(F.max(F.struct("c", (-F.col("part_no")).alias("p"), "part", "source")).alias("b"))
    out = good.join(best, ["image_id", "line_no"], "left")
    c = F.coalesce("b.c", F.lit(0.0))
    missing = c < LEAST_COVERAGE
    forced = F.create_map(*[F.lit(x) for kv in PART_BY_DAMAGE_TYPE.items() for x in kv])[F.col("damage_type")]
    x0, y0, x1, y1 = (F.col(f"corners.{k}") for k in ("x0", "y0", "x1", "y1"))
    return out.select(
        "image_id", "line_no", "damage_type", F.transform(F.array(x0, y0, x1 - x0, y1 - y0), lambda v: F.bround(v, 1)).alias("bbox"),
        F.bround((x1 - x0) * (y1 - y0), 1).alias("area"), missing.alias("no_auto_part"),
        F.coalesce(forced, F.when(missing, "").otherwise(F.col("b.part"))).alias("auto_part"),
        F.when(forced.isNotNull(), F.concat(F.lit("damage type "), F.col("damage_type"))).when(missing, "").otherwise(F.col("b.source")).alias("auto_part_source"),
        F.when(forced.isNotNull(), 1.0).otherwise(F.bround(c, 2)).alias("auto_part_coverage"),
    )


def conversion_report(boxes: DataFrame, annotations: DataFrame) -> DataFrame:
    """counter, n: boxes per type, skipped lines by problem, boxes without a part."""
    spark = boxes.sparkSession
    dense = spark.createDataFrame([(t,) for t in [*DAMAGE_TYPES, "skipped_bad_damage_line", "skipped_empty_box", "no_auto_part"]], "counter string")
    got = (
        annotations.groupBy(F.col("damage_type").alias("counter")).agg(F.count("*").alias("n"))
        .unionByName(boxes.filter("problem IS NOT NULL").groupBy(F.concat(F.lit("skipped_"), F.col("problem")).alias("counter")).agg(F.count("*").alias("n")))
        .unionByName(annotations.filter("no_auto_part").agg(F.count("*").alias("n")).select(F.lit("no_auto_part").alias("counter"), "n"))
    )
    return dense.join(got, "counter", "left").fillna(0, ["n"])


def sheet_rows(annotations: DataFrame, images: DataFrame, sample: DataFrame) -> DataFrame:
    """Rows of a labeling sheet for the sampled images, the part filled in and explained."""
    rows = annotations.join(sample.select("image_id").distinct(), "image_id", "left_semi").join(images.select("image_id", "file_name"), "image_id")
    note = F.when(
        F.col("auto_part") != "",
        F.format_string("part auto: %s (%d%% of box), check it", F.col("auto_part_source"), F.bround(F.col("auto_part_coverage") * 100, 0).cast("int")),
    ).otherwise("")
    return rows.select(
        "image_id", "file_name", F.col("id").alias("annotation_id"), "damage_type", *[F.col("bbox")[i].alias(f"bbox_{c}") for i, c in enumerate("xywh")],
        F.col("auto_part").alias("part"), F.lit("").alias("severity"), F.lit("").alias("action"), note.alias("comment"),
    )


def _row_errors() -> list[Column]:
    bad = [F.when(F.col("true_type").isNotNull() & F.col("damage_type").isNull(), "has no row in the labeling sheet"),
           F.when(F.col("true_type").isNull(), "does not belong to the selected images"),
           F.when(F.col("damage_type") != F.col("true_type"), "damage_type differs from the dataset")]
    bad += [F.when(F.col("true_type").isNotNull() & F.col("damage_type").isNotNull() & ~F.coalesce(F.col(f).isin(v), F.lit(False)), f"{f} is not allowed") for f, v in LABEL_FIELDS.items()]
    return bad


def integrity_errors(annotations: DataFrame, sample: DataFrame, sheet: DataFrame) -> DataFrame:
    """(annotation_id, error): everything that keeps a sheet from becoming ground truth.

    ``annotations`` has annotation_id, image_id, damage_type; ``sample``
    image_id; ``sheet`` annotation_id, damage_type, part, severity, action.
    """
    expected = annotations.join(sample.select("image_id").distinct(), "image_id", "left_semi")
    unknown = sample.select("image_id").distinct().join(annotations.select("image_id").distinct(), "image_id", "left_anti")
    twice = sheet.groupBy("annotation_id").agg(F.count("*").alias("n")).filter("n > 1").select("annotation_id", F.lit("appears twice").alias("error"))
    one = sheet.dropDuplicates(["annotation_id"])
    both = expected.select("annotation_id", F.col("damage_type").alias("true_type")).join(one, "annotation_id", "full_outer")
    rows = both.select("annotation_id", F.explode(F.array_compact(F.array(*_row_errors()))).alias("error"))
    return rows.unionByName(twice).unionByName(unknown.select(F.col("image_id").alias("annotation_id"), F.lit("image is not in the annotation file").alias("error")))


def integrity_errors_by(annotations: DataFrame, sample: DataFrame, sheets: DataFrame, by: str) -> DataFrame:
    """(by, annotation_id, error): ``integrity_errors`` of every sheet at once; ``by`` names the sheet of a row of ``sheets``."""
    each = sheets.select(by).distinct()
    chosen = sample.select("image_id").distinct()
    expected = annotations.join(chosen, "image_id", "left_semi").select("annotation_id", F.col("damage_type").alias("true_type")).crossJoin(F.broadcast(each))
    unknown = chosen.join(annotations.select("image_id").distinct(), "image_id", "left_anti").crossJoin(F.broadcast(each))
    twice = sheets.groupBy(by, "annotation_id").agg(F.count("*").alias("n")).filter("n > 1").select(by, "annotation_id", F.lit("appears twice").alias("error"))
    both = expected.join(sheets.dropDuplicates([by, "annotation_id"]), [by, "annotation_id"], "full_outer")
    rows = both.select(by, "annotation_id", F.explode(F.array_compact(F.array(*_row_errors()))).alias("error"))
    return rows.unionByName(twice).unionByName(unknown.select(by, F.col("image_id").alias("annotation_id"), F.lit("image is not in the annotation file").alias("error")))


def ground_truth(annotations: DataFrame, images: DataFrame, sample: DataFrame, sheet: DataFrame) -> DataFrame:
    """One row per sampled image with its labelled damages in order of annotation."""
    d = annotations.join(sheet.select("annotation_id", "part", "severity", "action"), "annotation_id")
    damages = d.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("annotation_id", "bbox", "damage_type", "part", "severity", "action"))).alias("damages"))
    chosen = images.join(sample.select("image_id").distinct(), "image_id", "left_semi").join(damages, "image_id", "left")
    return chosen.select(F.col("image_id").cast("string").alias("image_id"), "file_name", "width", "height", "damages")
