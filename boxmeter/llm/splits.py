"""Splits that keep related records together (problem 1).

Method: an incremental, persisted component table with pointer jumping for
merges.  A component that already has a split keeps it, new components fill the
deficits of the splits, and a merge of components of different splits is
quarantined.  A batch appends its records and keys and changes the component
table only; rows of earlier batches are never rewritten.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxmeter.llm.components import components
from boxmeter.session import cut, cut_table

PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}
QUARANTINE = "quarantine"
#: A new component above this share of all new records is placed one by one (there are at most 1 / BIG_SHARE of them); the others are placed by prefix sums.
BIG_SHARE = 0.001

# What may stand behind the stem of a name: extension, copy marks of file managers and editors, blanks.
_BEHIND = (
    r"(?:\.[a-z][a-z0-9]{1,4}|\s*\(\d{1,4}\)|\s*\[\d{1,4}\]|~\d{0,3}"
    r"|[\s_.\-–—]+(?:copy|kopie|копия)(?:[\s_-]*\d{1,3})?|[\s_.\-–—]+(?:edit|edited|bearbeitet|изменено)(?:[\s_-]*\d{1,3})?|\s+)+$"
)
_BEFORE = r"^(?:(?:copy|kopie|копия)(?: \(\d+\))? (?:of|von) )+"
_DATE = r"^id[\s_\-]*(\d+)[\s_\-]+(\d{4})[\-._]?(\d{2})[\-._]?(\d{2})(?:[\s_\-t]+\d{2}[\-._:]?\d{2}(?:[\-._:]?\d{2})?)$"
_UNIX = r"^id[\s_\-]*(\d+)[\s_\-]+(\d{10}|\d{13})$"


def name_stem(name: Column) -> Column:
    """The name without folder, extension, letter case, outer blanks and copy marks; null for null and blank names."""
    flat = F.lower(F.regexp_replace(name, r"^[\s\u00a0]+|[\s\u00a0]+$", ""))
    last = F.regexp_replace(flat, r"(?s)^.*[\\/]", "")
    stem = F.regexp_replace(F.regexp_replace(last, _BEHIND, ""), _BEFORE, "")
    stem = F.when(stem == "", last).otherwise(stem)
    return F.when(stem != "", stem)


def session_key(name: Column) -> Column:
    """The key that images of one shooting session share; null where a name joins nothing.

    ``d|device|yyyymmdd`` where the name tells a device and a moment (a Unix
    time in seconds or milliseconds means its UTC day), else ``n|stem``.
    """
    stem = name_stem(name)
    unix = F.regexp_extract(stem, _UNIX, 2)
    seconds = F.substring(unix, 1, 10).try_cast("long")
    unix_day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")), "yyyyMMdd")
    written = F.concat(*[F.regexp_extract(stem, _DATE, i) for i in (2, 3, 4)])
    day = F.when(unix != "", unix_day).when(
        F.try_to_timestamp(written, F.lit("yyyyMMdd")).isNotNull(), written
    )
    device = F.regexp_replace(
        F.when(unix != "", F.regexp_extract(stem, _UNIX, 1)).otherwise(F.regexp_extract(stem, _DATE, 1)), "^0+(?=.)", ""
    )
    return F.when(day.isNotNull(), F.concat_ws("|", F.lit("d"), device, day)).when(
        stem.isNotNull(), F.concat(F.lit("n|"), stem)
    )


RECORDS, KEYS, GROUPS = "record_id bigint, group_id bigint", "key string, group_id bigint", "group_id bigint, root bigint, split string, n bigint"


@dataclass
class SplitTables:
    """The state: which group a record and a key came to, and the component table of the groups.

    ``members`` and ``key_table`` only grow: their rows name the group of the
    time they were written.  ``groups`` has a row for every group there ever
    was, with the group it now belongs to (root), and at the root the split and
    the number of records.
    """

    members: DataFrame  # RECORDS
    key_table: DataFrame  # KEYS
    groups: DataFrame  # GROUPS
    fresh_members: DataFrame | None = None  # what the last batch added
    fresh_keys: DataFrame | None = None

    @property
    def records(self) -> DataFrame:
        """(record_id, group_id, split) with the groups of now."""
        return _resolved(self.members, self.groups)

    def write(self, path: str) -> int:
        """Persist the state behind a batch and return its number.

        The first call writes everything, later ones append what the batch
        added and write the small component table anew; earlier batches are
        never rewritten.  The component table comes last: a batch counts once
        it is whole, so a write that was broken off is simply repeated.
        """
        last = _last_batch(self.groups.sparkSession, path)
        n = last + 1
        rows = (self.members, self.key_table) if n == 0 or self.fresh_members is None else (self.fresh_members, self.fresh_keys)
        for table, df in zip(("members", "keys"), rows):
            df.write.mode("overwrite").parquet(f"{path}/{table}/batch={n}")
        self.groups.write.mode("overwrite").parquet(f"{path}/groups/batch={n}")
        return n

    @staticmethod
    def read(spark: SparkSession, path: str) -> "SplitTables":
        """The state behind the last whole batch."""
        n = _last_batch(spark, path)
        upto = lambda table, schema: spark.read.schema(schema).parquet(*[f"{path}/{table}/batch={i}" for i in range(n + 1)])
        return SplitTables(upto("members", RECORDS), upto("keys", KEYS), spark.read.schema(GROUPS).parquet(f"{path}/groups/batch={n}"))

    @staticmethod
    def empty(spark: SparkSession) -> "SplitTables":
        return SplitTables(*(spark.createDataFrame([], schema) for schema in (RECORDS, KEYS, GROUPS)))


def _resolved(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with the root of their group and its split in place of the group of their time."""
    now = groups.select("group_id", "root").join(groups.filter("group_id = root").select("root", "split"), "root")
    return rows.join(now, "group_id").drop("group_id").withColumnRenamed("root", "group_id")


def _last_batch(spark: SparkSession, path: str) -> int:
    """The number of the last batch whose component table is whole, -1 where there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/groups")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return -1
    names = [f.getPath() for f in fs.listStatus(folder)]
    whole = [int(p.getName().split("=")[1]) for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max(whole, default=-1)


def links_of_images(images: DataFrame) -> DataFrame:
    """(record_id, key) of a table with image_id and file_name; rows without image_id give none, a null name gives a null key."""
    return images.filter("image_id IS NOT NULL").select(
        F.col("image_id").cast("long").alias("record_id"), session_key(F.col("file_name")).alias("key")
    )


def _place_new(groups: DataFrame, have: dict[str, int], proportions: dict[str, float], seed: int) -> DataFrame:
    """(group_id, split) of new groups (group_id, n), filling what each split lacks.

    Big groups (at most 1 / BIG_SHARE) go one by one, largest first, to the
    split that lacks most.  The rest stands in hash order; a prefix sum over its
    range partitions cuts that order at the remaining deficits.
    """
    spark = groups.sparkSession
    names = sorted(proportions)
    weight = sum(proportions.values())
    groups = cut(groups)
    total = groups.agg(F.sum("n")).first()[0] or 0
    all_of = total + sum(have.values())
    lack = {s: proportions[s] / weight * all_of - have.get(s, 0) for s in names}
    limit = max(1.0, BIG_SHARE * total)
    big = sorted(groups.filter(F.col("n") > limit).collect(), key=lambda r: (-r["n"], r["group_id"]))
    placed = []
    for r in big:
        best = max(names, key=lambda s: (lack[s], proportions[s], s))
        placed.append((r["group_id"], best))
        lack[best] -= r["n"]
    rest = total - sum(r["n"] for r in big)
    open_ = {s: max(0.0, lack[s]) for s in names}
    scale = rest / sum(open_.values()) if sum(open_.values()) > 0 else 0.0
    small = (
        groups.filter(F.col("n") <= limit)
        .withColumn("h", F.xxhash64(F.lit(seed), "group_id"))
        .repartitionByRange("h", "group_id")
        .sortWithinPartitions("h", "group_id")
        .withColumn("pid", F.spark_partition_id())
    )
    small = cut(small)
    # one row per partition: the offsets never grow with the data
    offsets = small.groupBy("pid").agg(F.sum("n").alias("m")).withColumn(
        "before", F.sum("m").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    )
    inside = Window.partitionBy("pid").orderBy("h", "group_id").rowsBetween(Window.unboundedPreceding, 0)
    at = (
        small.join(F.broadcast(offsets.select("pid", F.coalesce("before", F.lit(0)).alias("before"))), "pid")
        .withColumn("middle", F.col("before") + F.sum("n").over(inside) - F.col("n") / 2)
    )
    edge, split = 0.0, None
    for s in names:
        edge += open_[s] * scale
        split = F.when(F.col("middle") < edge, s) if split is None else split.when(F.col("middle") < edge, s)
    last = max(names, key=lambda s: (open_[s], s))
    out = at.select("group_id", split.otherwise(last).alias("split"))
    return out.union(spark.createDataFrame(placed, "group_id bigint, split string")) if placed else out


def assign_splits(
    links: DataFrame,
    before: SplitTables | None = None,
    proportions: dict[str, float] | None = None,
    seed: int = 7,
) -> SplitTables:
    """Group records by shared keys and give every group a split.

    ``links`` has record_id and key, one row per key of a record; a null key
    links nothing but its record still gets a split.  ``before`` is the state of
    earlier batches.  A new group's id is its smallest record_id; an earlier
    group keeps its id and its split, and of several that a batch joins the
    smallest id stays and the others point to it.  A batch that joins groups of different splits puts all
    their records into the split ``quarantine`` for good.  Repeated rows count
    once; an empty batch returns the state.  Of the state only the rows that
    share a key or a record with the batch are joined on, and only the component
    table changes.
    """
    spark = links.sparkSession
    proportions = proportions or PROPORTIONS
    before = before or SplitTables.empty(spark)
    batch = cut(links.select("record_id", "key").filter("record_id IS NOT NULL").distinct())
    roots_of = before.groups.select("group_id", "root")
    named = lambda df, name: df.select("*", F.concat(F.lit("g|"), F.col("root")).alias(name)).drop("root", "group_id")

    # entities: earlier groups, and the keys and records that belong to none yet
    keys = batch.filter("key IS NOT NULL").select("key").distinct()
    old_keys = named(keys.join(before.key_table, "key").join(roots_of, "group_id"), "old")
    keys = cut(keys.join(old_keys, "key", "left").select("key", F.col("old").isNull().alias("fresh"), F.coalesce("old", F.concat(F.lit("k|"), F.col("key"))).alias("entity")))
    ids = batch.select("record_id").distinct()
    old_records = named(ids.join(before.members, "record_id").join(roots_of, "group_id"), "own")
    of_record = batch.join(keys.select("key", F.col("entity").alias("by_key")), "key", "left").join(old_records, "record_id", "left")
    pairs = of_record.select(
        "record_id", F.col("own").isNull().alias("fresh"),
        F.explode(F.array_distinct(F.array_compact(F.array("by_key", F.coalesce("own", F.when(F.col("by_key").isNull(), F.concat(F.lit("r|"), F.col("record_id")))))))).alias("entity"),
    )
    pairs = cut(pairs.distinct())
    home = cut(pairs.groupBy("record_id").agg(F.min("fresh").alias("fresh"), F.min("entity").alias("home"), F.max("entity").alias("other")))
    # a record of one entity needs no edge
    several = home.filter("home <> other").select("record_id", "home")
    roots = components(pairs.join(several, "record_id").select(F.col("home").alias("src"), F.col("entity").alias("dst")))

    # every entity of the batch with its component: the records it brings, and the group it was
    entity = (
        home.select(F.col("home").alias("entity"), F.col("record_id").alias("least"), F.col("fresh").cast("long").alias("n"))
        .unionByName(pairs.select("entity", F.col("record_id").alias("least"), F.lit(0).cast("long").alias("n")))
        .groupBy("entity")
        .agg(F.min("least").alias("least"), F.sum("n").alias("n"))
        .join(roots.withColumnRenamed("node", "entity"), "entity", "left")
        .withColumn("component", F.coalesce("root", "entity"))
        .withColumn("old", F.when(F.col("entity").startswith("g|"), F.substring("entity", 3, 20).cast("long")))
        .drop("root")
    )
    at_root = before.groups.filter("group_id = root").select(F.col("group_id").alias("old"), "split", F.col("n").alias("had"))
    entity = cut(entity.join(at_root, "old", "left"))
    touched = entity.groupBy("component").agg(
        F.min("least").alias("least"), F.min("old").alias("old"), F.sum("n").alias("more"), F.coalesce(F.sum("had"), F.lit(0)).alias("had"),
        F.min("split").alias("lo"), F.max("split").alias("hi"),
    )
    touched = touched.select(
        "component", (F.col("more") + F.col("had")).alias("n"), F.coalesce("old", "least").alias("group_id"),
        F.when(F.col("lo") == F.col("hi"), F.col("lo")).when(F.col("lo").isNotNull(), QUARANTINE).alias("split"),
    )
    touched = cut(touched)
    have = {r["split"]: r["n"] for r in at_root.groupBy("split").agg(F.sum("had").alias("n")).collect()}
    have.pop(QUARANTINE, None)
    new = touched.filter("split IS NULL")
    placed = _place_new(new.select("group_id", "n"), have, proportions, seed)
    settled = cut_table(touched.filter("split IS NOT NULL").select("group_id", "n", "split").unionByName(new.select("group_id", "n").join(placed, "group_id")))

    # the component table: roots that were joined point to the one that stays
    place = cut(entity.select("entity", "old", "component").join(touched.select("component", "group_id"), "component").select("entity", "old", "group_id"))
    moved = place.filter("old <> group_id").select(F.col("old").alias("root"), F.col("group_id").alias("to"))
    old_groups = before.groups.join(moved, "root", "left").select("group_id", F.coalesce("to", "root").alias("root"), F.when(F.col("to").isNull(), F.col("split")).alias("split"), F.when(F.col("to").isNull(), F.col("n")).alias("n"))
    groups = old_groups.join(settled.select("group_id"), "group_id", "left_anti").unionByName(settled.select("group_id", F.col("group_id").alias("root"), "split", "n"))
    fresh_members = cut_table(home.filter("fresh").select("record_id", F.col("home").alias("entity")).join(place, "entity").select("record_id", "group_id"))
    fresh_keys = cut_table(keys.filter("fresh").select("key", "entity").join(place, "entity").select("key", "group_id"))
    return SplitTables(before.members.unionByName(fresh_members), before.key_table.unionByName(fresh_keys), cut_table(groups), fresh_members, fresh_keys)


def groups_of_several(state: SplitTables) -> DataFrame:
    """(record_id, group_id) of the records whose group has at least two records."""
    several = state.groups.filter("group_id = root AND n > 1").select("root")
    return state.members.join(state.groups.select("group_id", "root").join(several, "root", "left_semi"), "group_id").select("record_id", F.col("root").alias("group_id"))
