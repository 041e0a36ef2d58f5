"""Around a run of a model over images: what may be sent, how large, and what came back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values
MEDIA_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png"}
LARGEST_FILE = 40 * 1024 * 1024
LONGEST_SIDE, MOST_BYTES = 1568, 4_500_000


def media_type(file_name: Column) -> Column:
    """By the extension, in any case; null for other files."""
    types = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return F.try_element_at(types, F.lower(F.regexp_extract(file_name, "\\.([^.]*)$", 1)))


def check_images(plan: DataFrame, files: DataFrame) -> DataFrame:
    """The planned images, each once at its first place, with problem: missing, type, size or null.

    ``plan`` has image_id, file_name, position; ``files`` file_name, size.  All
    problems are reported before anything is sent.
    """
    first = plan.groupBy("image_id").agg(F.min(F.struct("position", "file_name")).alias("p")).select("image_id", "p.position", "p.file_name")
    found = first.join(files.groupBy("file_name").agg(F.max("size").alias("size")), "file_name", "left")
    problem = F.when(F.col("size").isNull(), "missing").when(media_type(F.col("file_name")).isNull(), "type").when(F.col("size") > LARGEST_FILE, "size")
    return found.select("image_id", "file_name", "position", "size", problem.alias("problem"))


def sent_size(width: Column, height: Column, size: Column) -> Column:
    """struct resized, width, height: images with a longer side or more bytes than allowed are scaled down to the longest side."""
    longest = F.greatest(width, height)
    scale = F.least(F.lit(1.0), F.lit(float(LONGEST_SIDE)) / longest)
    resized = (longest > LONGEST_SIDE) | (size > MOST_BYTES)
    side = lambda v: F.greatest(F.lit(1), F.floor(v * scale + 0.5)).cast("int")
    return F.struct(resized.alias("resized"), F.when(resized, side(width)).otherwise(width).alias("width"), F.when(resized, side(height)).otherwise(height).alias("height"))


def summary(answers: DataFrame, by: list[str] | None = None) -> DataFrame:
    """answers and errors, in all or per ``by``; any status but success is an error."""
    return answers.groupBy(*(by or [])).agg(F.count("*").alias("answers"), F.count_if(~F.col("status").eqNullSafe(F.lit("success"))).alias("errors"))
