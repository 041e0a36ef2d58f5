"""Agreement of annotators: kappas, majority, disagreements, sensitivity.

``labels`` is long: item, rater, field, value.  A rater has one value per item and field.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmeter.operators.evaluate import ratio


def unpivot(labels: DataFrame, item: str, rater: str, fields: list[str]) -> DataFrame:
    """Wide label rows as long ones."""
    return labels.select(F.col(item).alias("item"), F.col(rater).alias("rater"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("x")).select(
        "item", "rater", "x.field", "x.value"
    )


def paired(labels: DataFrame, a: str, b: str) -> DataFrame:
    """item, field, va, vb of the items that both raters have."""
    left = labels.filter(F.col("rater") == a).select("item", "field", F.col("value").alias("va"))
    right = labels.filter(F.col("rater") == b).select("item", "field", F.col("value").alias("vb"))
    return left.join(right, ["item", "field"])


def coverage_of(labels: DataFrame, a: str, b: str) -> DataFrame:
    """n_common, n_only_a, n_only_b items of two sheets."""
    left = labels.filter(F.col("rater") == a).select("item").distinct().withColumn("a", F.lit(1))
    right = labels.filter(F.col("rater") == b).select("item").distinct().withColumn("b", F.lit(1))
    both = left.join(right, "item", "full_outer")
    return both.agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_common"), F.count_if(F.col("b").isNull()).alias("n_only_a"), F.count_if(F.col("a").isNull()).alias("n_only_b")
    )


def disagreements(pairs: DataFrame) -> DataFrame:
    """The pairs of values that differ."""
    return pairs.filter(~F.col("va").eqNullSafe(F.col("vb")))


def cohens_kappa(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys (at least one), n, agreement, kappa from contingency counts alone; kappa is null where chance agreement is 1."""
    cells = pairs.groupBy(*keys, "va", "vb").agg(F.count("*").alias("m"))
    n = cells.groupBy(*keys).agg(F.sum("m").alias("n"), F.sum(F.when(F.col("va").eqNullSafe(F.col("vb")), F.col("m")).otherwise(0)).alias("agree"))
    ma = cells.groupBy(*keys, F.col("va").alias("v")).agg(F.sum("m").alias("ma"))
    mb = cells.groupBy(*keys, F.col("vb").alias("v")).agg(F.sum("m").alias("mb"))
    same = [ma[k].eqNullSafe(mb[k]) for k in [*keys, "v"]]
    chance = ma.join(mb, same).select(*[ma[k] for k in keys], (F.col("ma") * F.col("mb")).alias("x")).groupBy(*keys).agg(F.sum("x").alias("x"))
    out = n.join(chance, keys, "left")
    x, total = F.coalesce("x", F.lit(0)), F.col("n") * F.col("n")
    kappa = F.when(x < total, ratio(F.col("agree") * F.col("n") - x, total - x))
    return out.select(*keys, "n", ratio(F.col("agree"), F.col("n")).alias("agreement"), kappa.alias("kappa"))


def _filled(labels: DataFrame) -> DataFrame:
    return labels.filter("value IS NOT NULL AND value <> ''")


def item_mismatches(labels: DataFrame) -> DataFrame:
    """rater, n_items, n_missing, n_unfilled: what keeps the sheets of the raters from being compared as wholes.

    n_missing counts items and fields that another rater has and this one
    lacks; n_unfilled the rater's empty values.
    """
    every = labels.select("item", "field").distinct().count()
    own = labels.groupBy("rater").agg(F.count_distinct("item", "field").alias("m"), F.count_if(F.coalesce("value", F.lit("")) == "").alias("n_unfilled"))
    return own.select("rater", F.col("m").alias("n_items"), (F.lit(every) - F.col("m")).alias("n_missing"), "n_unfilled")


def require_same_items(labels: DataFrame) -> DataFrame:
    """The labels, or an error that names a rater whose sheet lacks items of the others or holds empty values."""
    bad = item_mismatches(labels).filter("n_missing > 0 OR n_unfilled > 0").orderBy("rater").first()
    if bad is not None:
        raise ValueError(f"the sheets do not hold the same items: {bad['rater']} lacks {bad['n_missing']} and leaves {bad['n_unfilled']} empty")
    return labels


def fleiss_kappa(labels: DataFrame) -> DataFrame:
    """field, n_items, n_left_out, least_raters, most_raters, kappa; null where chance agreement is 1.

    Every item with at least two filled values counts, whatever their number: an
    item's agreement is the share of its pairs of raters that agree.  Where all
    items have the same number this is the usual coefficient (``require_same_items``
    insists on it).  Items with fewer values are counted in n_left_out.
    """
    counts = _filled(labels).groupBy("field", "item", "value").agg(F.count("*").alias("m"))
    per_item = counts.groupBy("field", "item").agg(F.sum("m").alias("r"), F.sum(F.col("m") * F.col("m")).alias("sq"))
    rated = per_item.filter("r > 1")
    share = ratio(F.col("sq") - F.col("r"), F.col("r") * (F.col("r") - 1))
    p = rated.groupBy("field").agg(
        F.count("*").alias("n_items"), F.min("r").alias("least_raters"), F.max("r").alias("most_raters"), F.sum("r").alias("n"), F.avg(share).alias("agree")
    )
    values = counts.join(rated.select("field", "item"), ["field", "item"]).groupBy("field", "value").agg(F.sum("m").alias("m")).groupBy("field").agg(F.sum(F.col("m") * F.col("m")).alias("e"))
    items = labels.groupBy("field").agg(F.count_distinct("item").alias("all_items"))
    chance = ratio(F.col("e"), F.col("n") * F.col("n"))
    out = items.join(p, "field", "left").join(values, "field", "left")
    n = F.coalesce("n_items", F.lit(0))
    return out.select(
        "field", n.alias("n_items"), (F.col("all_items") - n).alias("n_left_out"), "least_raters", "most_raters",
        F.when(F.col("e") < F.col("n") * F.col("n"), F.try_divide(F.col("agree") - chance, 1 - chance)).alias("kappa"),
    )


def all_agree(labels: DataFrame) -> DataFrame:
    """field, n_items, n_agree, all_agree: the share of items on which all raters agree, of those that at least two have filled."""
    per = _filled(labels).groupBy("field", "item").agg(F.count_distinct("value").alias("v"), F.count("*").alias("r")).filter("r > 1")
    return per.groupBy("field").agg(F.count("*").alias("n_items"), F.count_if(F.col("v") == 1).alias("n_agree")).withColumn("all_agree", ratio(F.col("n_agree"), F.col("n_items")))


def pairwise_kappas(labels: DataFrame) -> DataFrame:
    """Cohen's kappa of every two raters in each field.

    Pairs are made among the raters of one item (one value each), so their
    number is bounded by raters, not by rows.
    """
    left = labels.select("item", "field", F.col("rater").alias("ra"), F.col("value").alias("va"))
    right = labels.select("item", "field", F.col("rater").alias("rb"), F.col("value").alias("vb"))
    return cohens_kappa(left.join(right, ["item", "field"]).filter("ra < rb"), ["field", "ra", "rb"])


def majority(labels: DataFrame) -> DataFrame:
    """item, field, value, n_votes, n_raters: the value of more than half of the raters, else an empty string."""
    votes = labels.groupBy("item", "field", "value").agg(F.count("*").alias("m"))
    per = votes.groupBy("item", "field").agg(F.sum("m").alias("n_raters"), F.max(F.struct("m", "value")).alias("top"))
    won = F.col("top.m") * 2 > F.col("n_raters")
    return per.select("item", "field", F.when(won, F.col("top.value")).otherwise("").alias("value"), F.col("top.m").alias("n_votes"), "n_raters")


def sensitivity(pairs: DataFrame, labels: DataFrame, a: str, b: str) -> DataFrame:
    """field, pairs, vs_a, vs_b, agree, where_equal: how a prediction's accuracy depends on whose labels are taken.

    ``pairs`` has item, field, value (the prediction); items that either rater lacks fail the count check and are left out.
    """
    both = pairs.withColumnRenamed("value", "p").join(paired(labels, a, b), ["item", "field"])
    equal = F.col("va").eqNullSafe(F.col("vb"))
    t = both.groupBy("field").agg(
        F.count("*").alias("pairs"), F.count_if(F.col("p") == F.col("va")).alias("right_a"), F.count_if(F.col("p") == F.col("vb")).alias("right_b"),
        F.count_if(equal).alias("agree"), F.count_if(equal & (F.col("p") == F.col("va"))).alias("right_equal"),
    )
    return t.select("field", "pairs", "agree", ratio(F.col("right_a"), F.col("pairs")).alias("vs_a"), ratio(F.col("right_b"), F.col("pairs")).alias("vs_b"), ratio(F.col("right_equal"), F.col("agree")).alias("where_equal"))
