import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from boxmeter.llm import cutoff, mixing

T0 = datetime(2026, 1, 1)
SCORES = "pred_id long, source string, model_client string, confidence double, scored_at timestamp_ntz, loaded_at timestamp_ntz"


def scores(spark, rows):
    return spark.createDataFrame(rows, SCORES).withColumn("n", F.lit(1)).withColumn("pid", F.lit(2)).withColumn("rank", F.lit(3))


def plain(counted, targets):
    out = {}
    for source, (client, values) in counted.items():
        values = sorted(values, reverse=True)
        for c in sorted(set(values), reverse=True):
            kept = sum(v >= c for v in values)
            if kept * 100 >= targets[client] * len(values):
                out[source] = (c, kept)
                break
    return out


def test_cutoffs_equal_a_loop(spark):
    r = random.Random(2)
    rows, counted = [], {}
    for k in range(1500):
        s = "hot" if k % 3 == 0 else f"s{r.randrange(12)}"
        c = r.choice([0.5, r.randrange(1001) / 1000, None, float("nan"), 1.5, -0.1])
        rows.append((k, r.choice([s, s.upper(), f" {s} "]), "x" if s < "s5" else "y", c, T0, T0 + timedelta(days=1)))
        rows.append((k, s, "x" if s < "s5" else "y", 0.123, T0, T0))
        if c is not None and 0 <= c <= 1:
            counted.setdefault(s, ("x" if s < "s5" else "y", []))[1].append(c)
    rows += rows[:100] + [(None, "s1", "x", 0.5, T0, T0), (9, None, "x", 0.5, T0, T0)]
    rows += [(5000, "odd", "z", 0.4, T0, None), (5000, "odd", "z", 0.3, T0, T0)]
    targets = spark.createDataFrame([("x", 35), ("y", 100), (None, 5)], "model_client string, target_pct int")
    got = {r.source: (r.cutoff, r.kept_n) for r in cutoff.cutoffs(cutoff.latest_scores(scores(spark, rows)), targets).collect()}
    assert got.pop("odd") == (None, None)
    assert got == plain(counted, {"x": 35, "y": 100})


@pytest.mark.parametrize("pct,want", [(0, (1.0, 1)), (25, (1.0, 1)), (26, (0.5, 3)), (76, (0.1, 4)), (150, (0.1, 4))])
def test_targets_at_the_edges(spark, pct, want):
    rows = [(i, "s", "x", c, T0, T0) for i, c in enumerate([1.0, 0.5, 0.5, 0.1])]
    targets = spark.createDataFrame([("x", pct)], "model_client string, target_pct int")
    r = cutoff.cutoffs(cutoff.latest_scores(scores(spark, rows)), targets).first()
    assert (r.cutoff, r.kept_n) == want


def test_no_scores(spark):
    targets = spark.createDataFrame([], "model_client string, target_pct int")
    assert cutoff.cutoffs(cutoff.latest_scores(scores(spark, [])), targets).count() == 0


def sizes(spark, n=3000):
    r = random.Random(1)
    rows = [(i, r.choice(["a", "b", "c", "other", None]), r.choice([0, 5, 20, 100, 900])) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, weight double, max_repeat int")


@pytest.mark.parametrize("total", [None, 100_000.0])
def test_shares_and_caps(spark, total):
    m = mixing.mix(sizes(spark), targets(spark, [("A ", 5.0, 1), ("b", 3.0, 3), ("c", 2.0, 2), ("none", 4.0, 2), ("bad", -1.0, 2), ("a", None, 1), (None, 1.0, 1)]), total)
    shares = {r.source: r for r in m.shares.collect()}
    assert set(shares) == {"a", "b", "c", "none"} and shares["none"].tokens == 0 and shares["none"].target_share == 0
    for s, want in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert shares[s].target_share == pytest.approx(want) and abs(shares[s].actual_share - want) < 0.01
    most = {r.source: r.c for r in m.documents.groupBy("source").agg(F.max("copies").alias("c")).collect()}
    assert most["a"] <= 1 and most["b"] <= 3 and most["c"] <= 2
    assert m.documents.filter("copies < 0 OR source = 'other' OR abs(copies - rate) > 1.000001").count() == 0
    if total:  # no source is off by more than its longest document
        assert all(abs(shares[s].tokens - total * want) <= 900 for s, want in (("a", 0.5), ("b", 0.3), ("c", 0.2)))


def test_scarce_source_is_used_to_its_cap(spark):
    s = spark.createDataFrame([(1, "a", 10), (2, "b", 1000), (3, "b", 1000)], "doc_id long, source string, n_tokens long")
    m = mixing.mix(s, targets(spark, [("a", 1.0, 4), ("b", 49.0, 2)]))
    assert {r.doc_id: r.copies for r in m.documents.collect()}[1] == 4


def test_empty_mix(spark):
    m = mixing.mix(sizes(spark, 0), targets(spark, [("a", 1.0, 1)]))
    assert m.documents.count() == 0 and m.shares.first().actual_share == 0
    assert mixing.mix(sizes(spark, 50), targets(spark, [])).documents.count() == 0


def test_sizes_in_tokens(spark):
    df = spark.createDataFrame([(1, "hello world", "A-b "), (2, None, None), (3, "", "x")], "doc_id long, text string, source string")
    assert [tuple(r) for r in mixing.document_sizes(df).orderBy("doc_id").collect()] == [(1, "a_b", 2), (2, None, 0), (3, "x", 0)]
