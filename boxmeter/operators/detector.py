"""Output of a box detector as predictions, and its place beside a sample of images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmeter.schemas import DAMAGE_TYPES


def detector_damages(boxes: DataFrame, names: dict[int, str]) -> DataFrame:
    """image_id, idx, damage_type, confidence, box: normalized centre boxes as corner boxes within the image.

    ``boxes`` has image_id, class_id, confidence, cx, cy, w, h, position (order
    of the output).  Classes outside the enumeration are dropped; idx counts by
    falling rounded confidence, then position.
    """
    codes = F.create_map(*[F.lit(x) for k, v in names.items() if v in DAMAGE_TYPES for x in (k, v)]) if set(names.values()) & set(DAMAGE_TYPES) else F.lit(None).cast("map<int,string>")
    c = {k: F.col(k).cast("double") for k in ("cx", "cy", "w", "h")}
    x, y = (F.least(F.greatest(c[a] - c[b] / 2, F.lit(0.0)), F.lit(1.0)) for a, b in (("cx", "w"), ("cy", "h")))
    box = F.array(*[F.bround(v, 6) for v in (x, y, F.least(c["w"], 1.0 - x), F.least(c["h"], 1.0 - y))])
    found = boxes.select("image_id", "position", F.try_element_at(codes, F.col("class_id")).alias("damage_type"), F.bround(F.col("confidence").cast("double"), 4).alias("confidence"), box.alias("box"))
    ranked = found.filter("damage_type IS NOT NULL").groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("rank"), "position", "damage_type", "confidence", "box"))).alias("d")  # a detector's boxes of one image
    )
    return ranked.select("image_id", F.posexplode("d").alias("idx", "b")).select("image_id", F.col("idx").cast("long").alias("idx"), "b.damage_type", "b.confidence", "b.box")


def beside_sample(answers: DataFrame, sample: DataFrame) -> DataFrame:
    """The answers (one per image, image_id) to the images of the sample; an image of the sample without an answer is an error."""
    wanted = sample.filter("image_id IS NOT NULL").select("image_id").distinct()
    missing = wanted.join(answers.select("image_id"), "image_id", "left_anti").orderBy("image_id").first()
    if missing is not None:
        raise ValueError(f"no answer of the detector for image {missing['image_id']}")
    return answers.join(wanted, "image_id", "left_semi")
