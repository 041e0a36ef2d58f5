"""Bootstrap over images from sufficient statistics.

Every metric is a function of sums of per-image statistics, so images are
matched once; a resample only weighs them by how often it drew them.
"""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxmeter.operators.evaluate import f1, parts_of_pairs, ratio
from boxmeter.schemas import DAMAGE_TYPES
from boxmeter.session import cut

RESAMPLES, SEED = 2000, 42
_FIELD = ["severity", "part", "action"]


def statistics(images: DataFrame, gt: DataFrame, pred: DataFrame, pairs: DataFrame) -> DataFrame:
    return statistics_of(parts_of_pairs(images, gt, pred, pairs))


def statistics_of(rows: DataFrame) -> DataFrame:
    """One row per image of ``evaluate.parts``: tp, fp, fn, the class counts, and the sums behind accuracies and the Brier score."""
    many = lambda array, test=None: F.size(F.filter(array, test) if test else array).cast("long")
    met = F.col("met")
    rows = rows.select("image_id", "gts", "preds", F.explode(F.array(F.transform("pairs", lambda m: F.struct(F.element_at("gts", m["g"]).alias("g"), F.element_at("preds", m["p"]).alias("p"))))).alias("met"))
    of_type = lambda t: lambda x: x["damage_type"] == t
    right = lambda m: m["g"]["damage_type"] == m["p"]["damage_type"]
    right_of = lambda t: lambda m: right(m) & (m["g"]["damage_type"] == t)
    said = lambda f: lambda m: m["p"][f].isNotNull()
    equal = lambda f: lambda m: m["p"][f] == m["g"][f]
    brier = F.aggregate(met, F.lit(0.0), lambda a, m: a + F.pow(m["p"]["confidence"] - F.coalesce(right(m), F.lit(False)).cast("double"), F.lit(2)))
    each = {
        "tp": many(met), "p_n": many("preds"), "g_n": many("gts"), "right": many(met, right), "brier_sum": brier,
        **{f"tp_{t}": many(met, right_of(t)) for t in DAMAGE_TYPES},
        **{f"p_{t}": many("preds", of_type(t)) for t in DAMAGE_TYPES}, **{f"g_{t}": many("gts", of_type(t)) for t in DAMAGE_TYPES},
        **{f"n_{f}": many(met, said(f)) for f in _FIELD}, **{f"right_{f}": many(met, equal(f)) for f in _FIELD},
    }
    all_ = rows.select("image_id", *[v.alias(k) for k, v in each.items()]).groupBy("image_id").agg(*[F.sum(k).alias(k) for k in each])
    return all_.select(
        "image_id", "tp", (F.col("p_n") - F.col("tp")).alias("fp"), (F.col("g_n") - F.col("tp")).alias("fn"), "right", "brier_sum",
        *[F.col(f"tp_{t}") for t in DAMAGE_TYPES], *[(F.col(f"p_{t}") - F.col(f"tp_{t}")).alias(f"fp_{t}") for t in DAMAGE_TYPES],
        *[(F.col(f"g_{t}") - F.col(f"tp_{t}")).alias(f"fn_{t}") for t in DAMAGE_TYPES], *[F.col(f"{k}_{f}") for k in ("n", "right") for f in _FIELD],
    )


def metric_columns() -> dict[str, Column]:
    """The metrics as columns over summed statistics."""
    c = F.col
    scores, present = [], []
    for t in DAMAGE_TYPES:
        tp, fp, fn = c(f"tp_{t}"), c(f"fp_{t}"), c(f"fn_{t}")
        any_ = tp + fp + fn > 0
        scores.append(F.when(any_, F.coalesce(f1(ratio(tp, tp + fp), ratio(tp, tp + fn)), F.lit(0.0))).otherwise(0.0))
        present.append(any_.cast("int"))
    total = lambda xs: sum(xs[1:], xs[0])
    return {
        "recall": ratio(c("tp"), c("tp") + c("fn")), "precision": ratio(c("tp"), c("tp") + c("fp")), "macro_f1": F.try_divide(total(scores), total(present)),
        "type_accuracy": ratio(c("right"), c("tp")), **{f"{f}_accuracy": ratio(c(f"right_{f}"), c(f"n_{f}")) for f in _FIELD}, "brier": ratio(c("brier_sum"), c("tp")),
    }


def seeded_draws(spark: SparkSession, n_images: int, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(resample, position, times) drawn one after the other from a seeded generator, as the published intervals were.

    For samples of images that a driver can number, such as evaluation sets;
    ``hashed_draws`` serves any size.
    """
    rng, rows = random.Random(seed), []
    places = range(n_images)
    for r in range(resamples):
        count: dict[int, int] = {}
        for _ in places:
            i = rng.choice(places)
            count[i] = count.get(i, 0) + 1
        rows += [(r, i, k) for i, k in count.items()]
    return spark.createDataFrame(rows, "resample int, position long, times int")


def numbered(df: DataFrame, key: str) -> DataFrame:
    """The rows with position: places from 0 in order of ``key``, numbered over range partitions; one offset per partition is all that is shared."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, key).sortWithinPartitions(key).withColumn("_pid", F.spark_partition_id()))
    before = F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ranged.groupBy("_pid").agg(F.count("*").alias("_n")).select("_pid", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_pid").orderBy(key))
    placed = ranged.withColumn("_i", inside).join(F.broadcast(offsets), "_pid")
    return placed.select(*df.columns, (F.col("_before") + F.col("_i") - 1).alias("position"))


def positions(images: DataFrame) -> DataFrame:
    """image_id, position in order of image_id."""
    return numbered(images.select("image_id"), "image_id").select("image_id", "position")


def hashed_draws(images: DataFrame, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(resample, position, times): each of the n positions of ``images`` draws a position by a 64-bit hash, in parallel."""
    n = images.count()
    each = images.select("position").withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    drawn = F.pmod(F.xxhash64(F.lit(seed), "resample", F.col("position").cast("long")), F.lit(max(n, 1)).cast("long"))
    return _times(each.select("resample", drawn.alias("position")))


def _times(drawn: DataFrame) -> DataFrame:
    # by position alone, so that the join with the statistics needs no other shuffle
    return drawn.repartition("position").groupBy("resample", "position").agg(F.count("*").alias("times"))


def resampled_metrics(stats: DataFrame, positions: DataFrame, draws: DataFrame) -> DataFrame:
    """resample, metric, value: long form; metrics without a value in a resample are null."""
    numbers = [c for c in stats.columns if c != "image_id"]
    drawn = draws.join(positions.join(stats, "image_id"), "position")
    sums = drawn.groupBy("resample").agg(*[F.sum(F.col("times") * F.col(c)).alias(c) for c in numbers])
    return _metrics(sums)


# fixed values: a prime for arithmetic on 31 bits
_PRIME = (1 << 31) - 1
#: Below these shares of the prime a hash means 0, 1, 2, ... copies (Poisson with mean 1).
POISSON_STEPS = [int(_PRIME * sum(math.exp(-1) / math.factorial(k) for k in range(n + 1))) for n in range(13)]


def resample_keys(resamples: int = RESAMPLES, seed: int = SEED) -> list[tuple[int, int, int, int]]:
    """(resample, a0, a1, a2): the coefficients of each resample's hash."""
    digits = [hashlib.md5(f"{seed}|{r}".encode()).hexdigest() for r in range(resamples)]
    return [(r, *(int(x[7 * k : 7 * k + 7], 16) for k in range(3))) for r, x in enumerate(digits)]


def poisson_copies(h1: np.ndarray, h2: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """(images, resamples): how often a resample takes an image, by a hash of both, as a Poisson number with mean 1."""
    _, a0, a1, a2 = keys.T
    y = (a0 + a1 * h1[:, None] + a2 * h2[:, None]) % _PRIME
    square = y * y % _PRIME
    x = square * square % _PRIME * y % _PRIME
    return np.searchsorted(POISSON_STEPS, x, side="right")


def poisson_metrics(stats: DataFrame, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """resample, metric, value of resamples that take each image a Poisson number of times.

    The limit of drawing n of n images: an image's number is a hash of image
    and resample, so images need no positions, no draws move, and the sums of a
    task are the product of two matrices, one row per resample.  Two models
    compared on the same images share the numbers (paired resamples).
    """
    numbers = [c for c in stats.columns if c != "image_id"]
    keys = np.array(resample_keys(resamples, seed), np.int64)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(keys), len(numbers)))
        for b in batches:
            for at in range(0, len(b), 256):
                p = b.iloc[at : at + 256]
                total += poisson_copies(p["h1"].to_numpy(np.int64), p["h2"].to_numpy(np.int64), keys).T @ p[numbers].to_numpy(float)
        yield pd.DataFrame(total, columns=numbers).assign(resample=keys[:, 0])

    digits = F.md5(F.concat_ws("|", F.lit("image"), F.col("image_id").cast("string")))
    halves = [F.conv(F.substring(digits, 1 + 7 * i, 7), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(2)]
    hashed = stats.filter("image_id IS NOT NULL").select(*halves, *[F.col(c).cast("double").alias(c) for c in numbers])
    parts = hashed.mapInPandas(sums, ", ".join(f"{c} double" for c in numbers) + ", resample int")
    return _metrics(parts.groupBy("resample").agg(*[F.sum(c).alias(c) for c in numbers]))


def _metrics(sums: DataFrame) -> DataFrame:
    pairs = [F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in metric_columns().items()]
    return sums.select("resample", F.explode(F.array(*pairs)).alias("m")).select("resample", "m.metric", "m.value")


def intervals(values: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """metric, ci95_low, ci95_high, resamples_used: exact percentiles, of B - A where ``other`` is B; resamples without a value on either side are dropped."""
    v = values if other is None else values.withColumnRenamed("value", "a").join(other.withColumnRenamed("value", "b"), ["resample", "metric"]).select("resample", "metric", (F.col("b") - F.col("a")).alias("value"))
    return v.groupBy("metric").agg(
        F.percentile("value", 0.025).alias("ci95_low"), F.percentile("value", 0.975).alias("ci95_high"), F.count("value").alias("resamples_used")
    )


def point_metrics(stats: DataFrame) -> DataFrame:
    """metric, value over all images."""
    sums = stats.agg(*[F.sum(c).alias(c) for c in stats.columns if c != "image_id"])
    pairs = [F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in metric_columns().items()]
    return sums.select(F.explode(F.array(*pairs)).alias("m")).select("m.metric", "m.value")
