"""Mixing sources to target weights (problem 8).

Method: entropy balancing.  The rates closest to "every document once" in
relative entropy that meet a source's token target are exponential in the
document's length, cut off at the source's cap.  Distributed Newton iterations
solve the convex dual, one multiplier per source; the rates are then rounded
into whole copies along prefix sums, so that no total is off by more than a
document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxmeter.llm.tokenizer import encode
from boxmeter.session import cut


def clean_source(c) -> F.Column:
    """Sources without case, outer blanks and ``-`` for ``_``."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""), "-", "_"))


def document_sizes(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of documents; null and empty texts have no tokens."""
    key = docs.select(F.struct("doc_id", clean_source(F.col("source")).alias("source")).alias("k"), "text")
    sizes = encode(key, "k", vocabulary=vocabulary, lengths_only=True)
    return sizes.select("k.doc_id", F.col("k.source").alias("source"), "n_tokens")


@dataclass
class Mix:
    documents: DataFrame  # doc_id, source, n_tokens, rate, copies
    shares: DataFrame  # source, weight, target_share, max_repeat, tokens_there, tokens, actual_share, n_docs, n_copies


def mix(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None, tolerance: float = 1e-9, rounds: int = 80, seed: int = 11) -> Mix:
    """Copies of documents such that each listed source holds its share of all tokens.

    ``targets`` has source, weight, max_repeat; weights are relative.  Rows with
    no weight above 0 or no max_repeat of at least 1 are left out, as are listed
    sources without tokens, whose weight goes to the others in proportion; of a
    source listed twice the larger weight and cap count.  Documents of sources
    that are not listed, and of null sources, get no copy.  Without
    ``total_tokens`` the mix is the largest that holds all shares; a larger
    wish is cut down to it.  An empty corpus gives an empty mix.  Targets that
    ``rounds`` iterations do not meet to ``tolerance`` are an error.
    """
    spark = sizes.sparkSession
    wanted = (
        targets.filter("source IS NOT NULL AND weight > 0 AND NOT isnan(weight) AND max_repeat >= 1")
        .groupBy(clean_source(F.col("source")).alias("source"))
        .agg(F.max("weight").cast("double").alias("weight"), F.max("max_repeat").cast("long").alias("max_repeat"))
    )
    listed = cut(sizes.filter("n_tokens > 0 AND source IS NOT NULL").join(wanted.select("source"), "source", "left_semi"))
    # documents of one length count alike, so the iterations read lengths, not documents
    lengths = cut(listed.groupBy("source", "n_tokens").agg(F.count("*").alias("m")))
    there = lengths.groupBy("source").agg(F.sum(F.col("m") * F.col("n_tokens")).alias("tokens_there"), F.sum("m").alias("n_docs"))
    plan = wanted.join(there, "source", "left")  # one row per listed source: the size of the target table
    rows = [r.asDict() for r in plan.collect()]
    live = [r for r in rows if r["tokens_there"]]
    weight = sum(r["weight"] for r in live)
    most = min((r["max_repeat"] * r["tokens_there"] / (r["weight"] / weight) for r in live), default=0.0)
    total = min(most, total_tokens) if total_tokens is not None else most
    state = {}
    for r in live:
        goal = total * r["weight"] / weight
        mean = r["tokens_there"] / r["n_docs"]
        full = goal >= r["max_repeat"] * r["tokens_there"] * (1 - 1e-12)
        state[r["source"]] = {"goal": goal, "mean": mean, "cap": float(r["max_repeat"]), "lam": 0.0, "lo": -math.inf, "hi": math.inf, "done": full, "full": full}
    while not all(s["done"] for s in state.values()):
        if rounds == 0:
            raise RuntimeError(f"no rates found for {sorted(k for k, s in state.items() if not s['done'])}")
        rounds -= 1
        for r in _moments(lengths, state).collect():
            s = state[r["source"]]
            if s["done"]:
                continue
            gap = r["first"] - s["goal"] / s["mean"]
            if abs(gap) <= tolerance * s["goal"] / s["mean"]:
                s["done"] = True
                continue
            s["lo" if gap < 0 else "hi"] = s["lam"]
            new = s["lam"] - gap / r["second"] if r["second"] > 0 else math.inf
            if not s["lo"] < new < s["hi"] or abs(new - s["lam"]) > 4:
                lo = s["lo"] if s["lo"] > -math.inf else s["lam"] - 4
                hi = s["hi"] if s["hi"] < math.inf else s["lam"] + 4
                new = (lo + hi) / 2 if s["lo"] > -math.inf and s["hi"] < math.inf else (hi if gap < 0 else lo)
            s["lam"] = new
    rates = _parameters(spark, state)
    rate = F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.exp(F.least(F.lit(300.0), F.col("lam") * F.col("n_tokens") / F.col("mean")))))
    rated = listed.join(rates, "source").select("doc_id", "source", "n_tokens", rate.alias("rate"), F.xxhash64(F.lit(seed), "doc_id").alias("h"))
    documents = _round(rated)
    got = documents.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.sum("copies").alias("n_copies"))
    all_tokens = documents.agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("all_tokens"))
    shares = (
        plan.join(got, "source", "left")
        .crossJoin(F.broadcast(all_tokens))  # one row
        .select(
            "source", "weight",
            F.when(F.col("tokens_there") > 0, F.col("weight") / F.lit(weight or 1.0)).otherwise(0.0).alias("target_share"),
            "max_repeat", F.coalesce("tokens_there", F.lit(0)).alias("tokens_there"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce(F.try_divide("tokens", "all_tokens"), F.lit(0.0)).alias("actual_share"),
            F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"),
        )
    )
    return Mix(documents, shares)


def _parameters(spark, state: dict) -> DataFrame:
    rows = [(k, s["lam"], s["mean"], s["cap"], s["full"]) for k, s in state.items()]
    return spark.createDataFrame(rows, "source string, lam double, mean double, cap double, full boolean")


def _moments(lengths: DataFrame, state: dict) -> DataFrame:
    """Per source the gradient's and the Hessian's sums at the current multipliers, in mean lengths."""
    open_ = {k: s for k, s in state.items() if not s["done"]}
    x = F.col("n_tokens") / F.col("mean")
    raw = F.exp(F.least(F.lit(300.0), F.col("lam") * x))
    at = lengths.join(_parameters(lengths.sparkSession, open_), "source")
    return at.groupBy("source").agg(
        F.sum(F.col("m") * F.least("cap", raw) * x).alias("first"),
        F.sum(F.when(raw < F.col("cap"), F.col("m") * raw * x * x).otherwise(0.0)).alias("second"),
    )


def _round(rated: DataFrame) -> DataFrame:
    """Whole copies: documents of a source stand by length, and each gets the whole numbers that its stretch of the rates' prefix sum passes."""
    spark = rated.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(
        rated.repartitionByRange(parts, "source", "n_tokens", "h", "doc_id")
        .sortWithinPartitions("source", "n_tokens", "h", "doc_id")
        .withColumn("pid", F.spark_partition_id())
    )
    # sums in millionths are exact, so every executor finds the same borders
    ranged = ranged.withColumn("u", F.round(F.col("rate") * 1_000_000).cast("long"))
    before = ranged.groupBy("pid", "source").agg(F.sum("u").alias("m")).select(
        "pid", "source",
        F.coalesce(F.sum("m").over(Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    inside = Window.partitionBy("pid", "source").orderBy("n_tokens", "h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    upto = ranged.withColumn("run", F.sum("u").over(inside)).join(before, ["pid", "source"]).withColumn("upto", F.col("before") + F.col("run"))
    half = 500_000
    copies = F.expr(f"(upto + {half}) div 1000000 - (upto - u + {half}) div 1000000")
    return upto.select("doc_id", "source", "n_tokens", "rate", copies.alias("copies"))
