"""One report from several answers: photos of one vehicle, and tiles of one image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmeter.functions.text import SEVERITY_RANK
from boxmeter.operators.geometry import tile_to_image


def merge_photos(damages: DataFrame) -> DataFrame:
    """One row per key, part and type: the same damage seen on several photos.

    ``damages`` has key, position, part, damage_type, severity, action,
    confidence, and may have description.  Confidence is the mean, severity the worst, the action that of
    the most confident sight (the first on ties); first_seen orders the rows.
    An unknown severity fails.
    """
    ranks = F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])
    names = F.array(*[F.lit(s) for s in SEVERITY_RANK])
    ranked = damages.withColumn("rank", F.coalesce(F.try_element_at(ranks, F.col("severity")), F.raise_error(F.concat(F.lit("unknown severity "), F.coalesce("severity", F.lit("null")))).cast("int")))
    best = F.struct("confidence", (-F.col("position")).alias("p"))
    more = [F.max_by("description", best).alias("description")] if "description" in damages.columns else []
    return ranked.groupBy("key", "part", "damage_type").agg(
        F.min("position").alias("first_seen"), F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.element_at(names, F.max("rank") + 1).alias("severity"),
        F.max_by("action", best).alias("action"), *more,
    )


def merged_status(answers: DataFrame) -> DataFrame:
    """key, status, n_photos, n_failed: a report is an error only where all its photos failed."""
    ok = F.col("status") == "success"
    t = answers.groupBy("key").agg(F.count("*").alias("n_photos"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("n_failed"))
    return t.select("key", F.when(F.col("n_failed") < F.col("n_photos"), "success").otherwise("error").alias("status"), "n_photos", "n_failed")


def overall_score(merged: DataFrame) -> DataFrame:
    """key, overall_score: the sum over merged damages of (rank + 1) x 20 x confidence, 100 at most."""
    ranks = F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])
    points = (F.try_element_at(ranks, F.col("severity")) + 1) * 20.0 * F.col("confidence")
    return merged.groupBy("key").agg(F.least(F.lit(100.0), F.sum(points)).alias("overall_score"))


def combine_parts(parts: DataFrame) -> DataFrame:
    """One row per image from its whole view (part 0) and its tiles: status, attempts, mean score of the successes, failed parts, whether a vehicle is seen.

    ``parts`` has image_id, part, status, attempts, overall_score, vehicle_visible, n_damages.
    """
    ok = F.col("status") == "success"
    t = parts.groupBy("image_id").agg(
        F.count("*").alias("n_parts"), F.count_if(ok).alias("n_ok"), F.sum("attempts").alias("attempts"), F.avg(F.when(ok, F.col("overall_score"))).alias("overall_score"),
        F.sum(F.when(ok, F.col("n_damages")).otherwise(0)).alias("n_damages"),
        F.bool_or(F.when((F.col("part") == 0) & ok, F.col("vehicle_visible"))).alias("whole_visible"),
    )
    return t.select(
        "image_id", F.when(F.col("n_ok") > 0, "success").otherwise("error").alias("status"), "attempts", F.when(F.col("n_ok") > 0, F.col("overall_score")).alias("overall_score"),
        (F.col("n_parts") - F.col("n_ok")).alias("n_failed"), F.when(F.col("n_damages") > 0, True).otherwise(F.col("whole_visible")).alias("vehicle_visible"),
    )


def tile_boxes(damages: DataFrame) -> DataFrame:
    """Boxes of tiles (column tile: struct x, y, w, h; null for the whole image) in shares of the image."""
    return damages.withColumn("box", F.when(F.col("tile").isNull(), F.col("box")).otherwise(tile_to_image(F.col("box"), F.col("tile"))))
