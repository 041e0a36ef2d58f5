"""Cutoff keeping a target fraction (problem 6).

Method: sort by source and score over range partitions, count per partition and
source, find by prefix sums the partition that holds the target rank, and read
the exact row there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxmeter.session import cut


def latest_scores(scores: DataFrame) -> DataFrame:
    """(source, model_client, confidence): the counted delivery of each pred_id.

    The delivery with the latest loaded_at counts (null is oldest; equal times:
    the later scored_at, then the larger confidence), and only if its confidence
    is a number from 0 to 1.  Sources are in lower case without outer blanks;
    rows without pred_id or source are left out.
    """
    rank = F.struct(
        "loaded_at", "scored_at", F.when(F.isnan("confidence"), F.lit(-1e308)).otherwise(F.col("confidence")).alias("rank"),
        F.lower(F.trim("source")).alias("source"), "model_client", "confidence",
    )
    one = scores.filter("pred_id IS NOT NULL AND source IS NOT NULL").groupBy("pred_id").agg(F.max(rank).alias("r"))
    return one.select("r.source", F.col("r.model_client").alias("model_client"), "r.confidence").filter(
        "confidence >= 0 AND confidence <= 1 AND NOT isnan(confidence) AND source <> ''"
    )


def cutoffs(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source the largest cutoff that keeps at least its target percent.

    ``scores`` has source, model_client and confidence; ``targets`` has
    model_client and target_pct.  Result: source, target_pct, n, cutoff, kept_n,
    kept_share.  A target of zero or less needs no row; the cutoff is then the
    largest confidence.  A target above 100 counts as 100.  Sources whose client
    has no target have a null cutoff; a source of several clients goes by the
    first in order of names.  Equal scores stand or fall together, so
    kept_n may exceed the target.
    """
    spark = scores.sparkSession
    # equal scores of a source become one weighted row before anything is moved
    ties = scores.groupBy("source", "confidence").agg(F.count("*").alias("m"), F.min("model_client").alias("model_client"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(
        ties.repartitionByRange(parts, F.col("source"), F.col("confidence").desc())
        .sortWithinPartitions(F.col("source"), F.col("confidence").desc())
        .withColumn("pid", F.spark_partition_id())
    )
    # at most one row per partition and source
    counts = ranged.groupBy("pid", "source").agg(F.sum("m").alias("m"), F.min("model_client").alias("model_client"))
    over = Window.partitionBy("source").orderBy("pid")
    whole = Window.partitionBy("source")
    percent = targets.filter("model_client IS NOT NULL").groupBy("model_client").agg(F.max("target_pct").alias("target_pct"))
    placed = (
        counts.withColumn("before", F.sum("m").over(over) - F.col("m"))
        .withColumn("n", F.sum("m").over(whole))
        .withColumn("model_client", F.min("model_client").over(whole))
        .join(percent, "model_client", "left")
    )
    placed = placed.withColumn("rank", F.greatest(F.lit(1), F.expr("(n * greatest(0, least(100, target_pct)) + 99) div 100")))
    target = placed.filter("target_pct IS NOT NULL AND rank > before AND rank <= before + m")
    # the rows of the located partitions only
    run = Window.partitionBy("pid", "source").orderBy(F.col("confidence").desc()).rowsBetween(Window.unboundedPreceding, 0)
    located = cut(target.select("pid", "source", "before", "n", "rank", "target_pct"))  # one row per source
    rows = ranged.select("pid", "source", "confidence", F.col("m").alias("w")).join(located, ["pid", "source"])
    upto = rows.withColumn("upto", F.col("before") + F.sum("w").over(run))
    hit = upto.filter("rank > upto - w AND rank <= upto").select(
        "source", "target_pct", "n", F.col("confidence").alias("cutoff"), F.col("upto").alias("kept_n"),
        (F.col("upto") / F.col("n")).alias("kept_share"),
    )
    none = placed.filter("target_pct IS NULL AND before = 0").select(
        "source", "target_pct", "n", F.lit(None).cast("double").alias("cutoff"), F.lit(None).cast("long").alias("kept_n"),
        F.lit(None).cast("double").alias("kept_share"),
    )
    return hit.unionByName(none)


def cutoff_table(result: DataFrame) -> DataFrame:
    """(source, cutoff_milli, kept_n) of ``cutoffs``."""
    return result.select("source", F.round(F.col("cutoff") * 1000).cast("long").alias("cutoff_milli"), "kept_n")
