"""Inspection history as event tables: appends only, current state by latest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest_first(inspections: DataFrame) -> DataFrame:
    """Order of listings: created_at, then the insertion sequence, both falling."""
    return inspections.orderBy(F.desc("created_at"), F.desc("seq"))


def keep_newest(inspections: DataFrame, by: str, n: int) -> DataFrame:
    """The newest n of each ``by``.  Spark turns the rank filter into a group limit that prunes before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc("created_at"), F.desc("seq"))
    return inspections.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).drop("rank")


def effective_damages(photos: DataFrame, corrections: DataFrame) -> DataFrame:
    """Photos with ``damages``: the latest correction where there is one, else the model's."""
    last = corrections.groupBy("inspection_id", "idx").agg(F.max_by("after_json", "seq").alias("corrected"), F.count("*").alias("n_corrections"))
    return photos.join(last, ["inspection_id", "idx"], "left").withColumn("damages", F.coalesce("corrected", "damages_json")).withColumn(
        "n_corrections", F.coalesce("n_corrections", F.lit(0))
    )


def correction_log(photos: DataFrame, corrections: DataFrame) -> DataFrame:
    """The audit log: each correction with what was visible before it."""
    w = Window.partitionBy("inspection_id", "idx").orderBy("seq")
    c = corrections.join(photos.select("inspection_id", "idx", "damages_json"), ["inspection_id", "idx"], "left")
    return c.withColumn("before_json", F.coalesce(F.lag("after_json").over(w), F.col("damages_json"))).drop("damages_json")


def delete_inspections(ids: DataFrame, inspections: DataFrame, photos: DataFrame, corrections: DataFrame) -> dict[str, DataFrame]:
    """The three tables without the inspections of ``ids`` (inspection_id); references to a deleted one become null."""
    gone = ids.select("inspection_id").distinct()
    left = inspections.join(gone, "inspection_id", "left_anti")
    ref = gone.select(F.col("inspection_id").alias("before_id"), F.lit(True).alias("gone"))
    left = left.join(ref, "before_id", "left").withColumn("before_id", F.when(F.col("gone").isNull(), F.col("before_id"))).drop("gone")
    return {
        "inspections": left.select(*inspections.columns),
        "photos": photos.join(gone, "inspection_id", "left_anti"),
        "corrections": corrections.join(gone, "inspection_id", "left_anti"),
    }


def with_return(inspections: DataFrame) -> DataFrame:
    """Inspections with has_return: whether another one refers to them as its earlier state."""
    refs = inspections.select(F.col("before_id").alias("inspection_id")).filter("inspection_id IS NOT NULL").distinct().withColumn("r", F.lit(True))
    return inspections.join(refs, "inspection_id", "left").withColumn("has_return", F.coalesce("r", F.lit(False))).drop("r")


def add_missing_columns(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """The table with all columns of a later schema; absent ones are null."""
    return df.select(*[(F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in schema.items()])


def not_answered(plan: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """What a resumed run has still to send: planned keys without an answer; errors are answers too."""
    return plan.join(answers.select(key).distinct(), key, "left_anti")


def same_run(meta: dict[str, str], earlier: dict[str, str], keys: tuple[str, ...] = ("model", "model_client", "prompt_version", "mode")) -> None:
    """Refuse to resume a run under other settings."""
    other = [k for k in keys if meta.get(k) != earlier.get(k)]
    if other:
        raise ValueError(f"the earlier run differs in {', '.join(other)}")


def find(table: DataFrame, key: str, value, owner: str | None = None, user=None) -> DataFrame:
    """The rows of a key; with ``owner`` those of another user are as if they were not there."""
    rows = table.filter(F.col(key) == F.lit(value))
    return rows if owner is None else rows.filter(F.col(owner) == F.lit(user))


def decoded_photos(photos: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Photos in order of idx with their JSON columns (name: schema) decoded; broken and null JSON is null."""
    for name, schema in columns.items():
        photos = photos.withColumn(name, F.from_json(name, schema))
    return photos.orderBy("inspection_id", "idx")


def new_inspections(rows: DataFrame, last_seq: int = 0) -> DataFrame:
    """Rows to append to the inspections: the caller's inspection_id, and seq in order of created_at behind ``last_seq``."""
    from boxmeter.operators.resample import numbered

    placed = numbered(rows.withColumn("order", F.struct("created_at", "inspection_id")), "order")
    return placed.withColumn("seq", F.col("position") + last_seq + 1).drop("order", "position")


def new_photos(photos: DataFrame) -> DataFrame:
    """Rows to append to the photos: damages as JSON without nulls where the analysis succeeded, else the empty list."""
    ok = F.col("status") == "success"
    return photos.withColumn("damages_json", F.when(ok & F.col("damages").isNotNull(), F.to_json("damages")).otherwise("[]")).drop("damages")


def comparison_totals(states: DataFrame, key: str) -> DataFrame:
    """key, n_new, n_existing, n_not_compared of compared damages (``matching.existing_before``)."""
    count = lambda s: F.count_if(F.col("state") == s)
    return states.groupBy(key).agg(count("NEW").alias("n_new"), count("EXISTING").alias("n_existing"), count("NOT_COMPARED").alias("n_not_compared"))
