"""Samples and pools that can be repeated: every choice follows a seeded hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_order(seed: int, *columns: str) -> Column:
    """A hash that puts rows into the same random order everywhere."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def distinct_by_first(df: DataFrame, key: str, position: str) -> DataFrame:
    """Each key once, with its first position."""
    return df.groupBy(key).agg(F.min(position).alias(position))


def stratified_sample(candidates: DataFrame, classes: list[str], per_class: int, seed: int, exclude: DataFrame | None = None) -> DataFrame:
    """(class, image_id): up to ``per_class`` images of each class in turn, none twice.

    ``candidates`` has class and image_id.  A class takes the first of its
    images in seeded order that no earlier class took; per_class x classes rows
    at most leave a step, so they are the only state between steps.
    """
    pool = candidates.select("class", "image_id").distinct()
    if exclude is not None:
        pool = pool.join(exclude.select("image_id"), "image_id", "left_anti")
    spark = candidates.sparkSession
    chosen: list[tuple] = []
    kind = pool.schema["image_id"].dataType.simpleString()
    for c in classes:
        used = spark.createDataFrame([(i,) for _, i in chosen], f"image_id {kind}")
        free = pool.filter(F.col("class") == c).join(used, "image_id", "left_anti")
        picked = free.orderBy(seeded_order(seed, "class", "image_id"), "image_id").limit(per_class).collect()
        chosen += [(c, r["image_id"]) for r in picked]
    return spark.createDataFrame(chosen, f"class string, image_id {kind}")


def split_days(groups: DataFrame, share: float, seed: int) -> DataFrame:
    """(key, pool): whole groups in seeded order, each to the pool further below its target (dev on ties).

    ``groups`` has key and n, one row per group.  Where a group goes depends on
    all before it, so they stream in order through one task that holds nothing
    but the two totals; records were counted per group before.
    """
    total = groups.agg(F.sum("n")).first()[0] or 0

    def walk(batches):
        dev = test = 0
        for b in batches:
            pools = []
            for n in b["n"].tolist():
                if share * total - dev >= (1 - share) * total - test:
                    dev, pool = dev + n, "dev"
                else:
                    test, pool = test + n, "test"
                pools.append(pool)
            yield b[["key"]].assign(pool=pools)

    ordered = groups.select("key", "n", seeded_order(seed, "key").alias("h")).repartition(1).sortWithinPartitions("h", "key")
    return ordered.mapInPandas(walk, "key string, pool string")


def train_or_val(pool: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """The pool with split: val for members of the sample, else train."""
    mark = sample.select(key).distinct().withColumn("m", F.lit(True))
    return pool.join(mark, key, "left").withColumn("split", F.when(F.col("m"), "val").otherwise("train")).drop("m")


def top_counts(df: DataFrame, key: str, n: int, position: str) -> DataFrame:
    """The n most frequent keys; the one seen first wins ties."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min(position).alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(n)


def per_class_images(df: DataFrame, classes: list[str]) -> DataFrame:
    """damage_type, images: distinct images of each class, 0 included."""
    got = df.groupBy("damage_type").agg(F.count_distinct("image_id").alias("images"))
    return df.sparkSession.createDataFrame([(c,) for c in classes], "damage_type string").join(got, "damage_type", "left").fillna(0, ["images"])


def newest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")


def images_by_class(annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """(class, image_id): every image of each category once; annotations of unknown categories and nulls are skipped."""
    named = annotations.join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("class")), "category_id")
    return named.filter("class IS NOT NULL AND image_id IS NOT NULL").select("class", "image_id").distinct()


def unknown_classes(categories: DataFrame, classes: list[str]) -> DataFrame:
    """The category names that are not among ``classes``, to be warned about."""
    return categories.filter(F.col("name").isNotNull() & ~F.col("name").isin(classes)).select("name").distinct()
