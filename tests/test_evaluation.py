"""Matching and metrics on hand-computed cases and against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from boxmeter.operators import agreement, evaluate, geometry, matching, resample

BOX = "image_id string, idx long, box array<double>, damage_type string, severity string, part string, action string"


def table(spark, rows, pred=False):
    rows = [(i, k, [float(v) for v in b], t, s, "door", "repair", *c) for i, k, b, t, s, *c in rows]
    return spark.createDataFrame(rows, BOX + (", confidence double" if pred else ""))


def overlap(a, b):
    w = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    union = a[2] * a[3] + b[2] * b[3] - w * h
    return w * h / union if union > 0 else 0.0


def plain(gts, preds, threshold=0.5):
    used, out = set(), set()
    for k in sorted(range(len(preds)), key=lambda k: (-preds[k][1], k)):
        best, at = 0.0, None
        for g, box in enumerate(gts):
            if g not in used and overlap(box, preds[k][0]) > best:
                best, at = overlap(box, preds[k][0]), g
        if at is not None and best >= threshold:
            used.add(at)
            out.add((at, k))
    return out


def test_overlap(spark):
    rows = [([0.0, 0.0, 1.0, 1.0], [0.0, 0.0, 1.0, 1.0], 1.0), ([0.0, 0.0, 1.0, 1.0], [2.0, 2.0, 1.0, 1.0], 0.0), ([0.0, 0.0, 2.0, 1.0], [1.0, 0.0, 2.0, 1.0], 1 / 3), ([0.0] * 4, [0.0] * 4, 0.0)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, want double")
    assert all(r.got == pytest.approx(r.want) for r in df.select("want", geometry.iou(F.col("a"), F.col("b")).alias("got")).collect())
    norm = spark.range(1).select(geometry.normalize(F.array(*[F.lit(float(x)) for x in (10, 20, 30, 40)]), F.lit(100), F.lit(200)).alias("b")).first().b
    assert norm == pytest.approx([0.1, 0.1, 0.3, 0.2])


@pytest.mark.parametrize("fold_boxes", [400, 3])
def test_matching_equals_a_loop(spark, fold_boxes):
    r = random.Random(4)
    gt, pred, want = [], [], set()
    for image in range(12):
        g = [[r.randint(0, 6) / 10, r.randint(0, 6) / 10, r.choice((2, 3)) / 10, r.choice((2, 3)) / 10] for _ in range(r.randint(0, 12))]
        p = [([r.randint(0, 6) / 10, r.randint(0, 6) / 10, r.choice((2, 3)) / 10, r.choice((2, 3)) / 10], r.choice((0.3, 0.5, 0.9))) for _ in range(r.randint(0, 12))]
        gt += [(str(image), i, b, "crack", "minor") for i, b in enumerate(g)]
        pred += [(str(image), i, b, "crack", "minor", c) for i, (b, c) in enumerate(p)]
        want |= {(str(image), a, b) for a, b in plain(g, p)}
    got = matching.greedy_match(table(spark, gt), table(spark, pred, True), fold_boxes=fold_boxes)
    assert {(r.image_id, r.gt, r.pred) for r in got.collect()} == want


def test_duplicate_is_a_false_alarm_and_wrong_type_counts_twice(spark):
    unit = [0, 0, 1, 1]
    gt = table(spark, [("a", 0, unit, "crack", "minor"), ("b", 0, unit, "crack", "minor"), ("b", 1, [5, 5, 1, 1], "crack", "minor")])
    pred = table(spark, [("a", 0, unit, "crack", "severe", 0.5), ("a", 1, unit, "scratch", "minor", 0.8), ("b", 0, unit, "crack", "minor", 0.9)], True)
    images = spark.createDataFrame([("a", "success"), ("b", "error"), ("c", "missing")], "image_id string, status string")
    pairs = evaluate.matched_pairs(images, gt, pred)
    assert [(r.pred, r.iou) for r in pairs.collect()] == [(1, 1.0)]
    total = evaluate.detection(evaluate.per_image(images, gt, pred, pairs)).first()
    assert (total.tp, total.fp, total.fn, total.images_failed) == (1, 1, 2, 2)
    classes = {r.damage_type: (r.tp, r.fp, r.fn, r.precision, r.f1) for r in evaluate.per_class(images, gt, pred, pairs).collect()}
    assert classes["crack"] == (0, 1, 3, 0.0, 0.0) and classes["scratch"] == (0, 1, 0, 0.0, None) and classes["lamp_broken"] == (0, 0, 0, None, None)
    assert evaluate.macro_f1(evaluate.per_class(images, gt, pred, pairs)).first().macro_f1 == 0.0
    scores = evaluate.confidence_scores(pairs).first()
    assert (scores.n, scores.pearson) == (1, None) and scores.brier == pytest.approx(0.64)
    presence = evaluate.image_level(images, gt, pred).first()
    assert (presence.tp, presence.fp, presence.fn) == (1, 1, 1)


def test_nothing_matched_and_empty_tables(spark):
    gt, pred = table(spark, []), table(spark, [], True)
    images = spark.createDataFrame([], "image_id string, status string")
    pairs = evaluate.matched_pairs(images, gt, pred)
    total = evaluate.detection(evaluate.per_image(images, gt, pred, pairs)).first()
    assert (total.tp, total.precision, total.f1) == (0, None, None)
    assert [r["count"] for r in evaluate.calibration(pairs).collect()] == [0] * 4
    assert evaluate.field_accuracy(pairs).filter("accuracy IS NOT NULL").count() == 0
    assert evaluate.selective_curve(images, gt, pred, pairs).filter("accepted = 0 AND coverage IS NULL").count() == 8


def test_crowded_images_give_the_same_metrics(spark):
    r = random.Random(9)
    box = lambda: [r.randint(0, 12) / 10, r.randint(0, 12) / 10, 0.3, 0.3]
    gt = table(spark, [(str(k % 3), k, box(), r.choice(("crack", "scratch")), "minor") for k in range(60)])
    pred = table(spark, [(str(k % 4), k, box(), r.choice(("crack", "scratch")), r.choice(("minor", "severe")), r.choice((0.35, 0.6, 0.95))) for k in range(60)], True)
    images = spark.createDataFrame([("0", "success"), ("1", "success"), ("2", "error"), ("5", "missing")], "image_id string, status string")
    ways = [evaluate.parts(images, gt, pred, fold_boxes=n) for n in (1000, 5)]
    assert ways[1].count() > ways[0].count() == 4
    for metric in (evaluate.per_image_of, evaluate.per_class_of, evaluate.selective_curve_of, evaluate.pairs_of):
        a, b = (sorted(tuple(x) for x in metric(w).collect()) for w in ways)
        assert a == b and a, metric
    a, b = ({x.image_id: [round(v, 9) for v in x[1:]] for x in resample.statistics_of(w).collect()} for w in ways)
    assert a == b and len(a) == 4


def test_unknown_class_fails(spark):
    gt = table(spark, [("a", 0, [0, 0, 1, 1], "rust", "minor")])
    images = spark.createDataFrame([("a", "success")], "image_id string, status string")
    with pytest.raises(Exception, match="unknown damage_type"):
        evaluate.per_class(images, gt, table(spark, [], True), evaluate.matched_pairs(images, gt, table(spark, [], True))).collect()


def test_selective_curve(spark):
    gt = table(spark, [("a", 0, [0, 0, 1, 1], "crack", "minor"), ("a", 1, [3, 0, 1, 1], "crack", "minor"), ("b", 0, [0, 0, 1, 1], "crack", "minor")])
    pred = table(spark, [("a", 0, [0, 0, 1, 1], "crack", "minor", 0.9), ("a", 1, [3, 0, 1, 1], "crack", "minor", 0.8), ("a", 2, [9, 9, 1, 1], "crack", "minor", 0.3), ("b", 0, [0, 0, 1, 1], "scratch", "minor", 0.6)], True)
    images = spark.createDataFrame([("a", "success"), ("b", "success"), ("c", "missing")], "image_id string, status string")
    pairs = evaluate.matched_pairs(images, gt, pred)
    rows = {r.threshold: r for r in evaluate.selective_curve(images, gt, pred, pairs).collect()}
    assert rows[0.0].precision == 0.75 and rows[0.4].precision == 1.0 and rows[0.4].coverage == 0.75
    assert rows[0.4].type_accuracy == pytest.approx(2 / 3) and rows[0.0].images_all_predictions_accepted == 3 and rows[0.7].images_all_predictions_accepted == 1


def test_bootstrap(spark):
    gt = table(spark, [(i, k, [k * 2, 0, 1, 1], "crack", "minor") for i in "abc" for k in range(2)])
    pred = table(spark, [(i, k, [k * 2 + (0.8 if i == "c" else 0), 0, 1, 1], "crack", "minor", 0.9) for i in "abc" for k in range(2)], True)
    images = spark.createDataFrame([(i, "success") for i in "abc"], "image_id string, status string")
    stats = resample.statistics(images, gt, pred, evaluate.matched_pairs(images, gt, pred))
    places = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "image_id string, position long")
    draws = resample.seeded_draws(spark, 3, 40)
    assert draws.groupBy("resample").agg(F.sum("times").alias("n")).filter("n <> 3").count() == 0
    values = resample.resampled_metrics(stats, places, draws)
    ci = {r.metric: r for r in resample.intervals(values).collect()}
    point = {r.metric: r.value for r in resample.point_metrics(stats).collect()}
    assert point["recall"] == pytest.approx(2 / 3) and ci["recall"].ci95_low <= point["recall"] <= ci["recall"].ci95_high
    same = {r.metric: r for r in resample.intervals(values, values).collect()}
    assert same["recall"].ci95_low == same["recall"].ci95_high == 0.0
    assert resample.hashed_draws(places, 5).groupBy("resample").agg(F.sum("times").alias("n")).filter("n <> 3").count() == 0


def long_labels(spark, sheets):
    rows = [(i, r, "f", v) for r, values in sheets.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "item int, rater string, field string, value string")


def test_kappas(spark):
    a, b = "xxxxxyyyyy", "xxxxyyyyyx"
    got = agreement.cohens_kappa(agreement.paired(long_labels(spark, {"a": a, "b": b}), "a", "b"), ["field"]).first()
    assert (got.n, got.agreement) == (10, 0.8) and got.kappa == pytest.approx(0.6)
    one = agreement.cohens_kappa(agreement.paired(long_labels(spark, {"a": "xx", "b": "xx"}), "a", "b"), ["field"]).first()
    assert one.kappa is None
    fleiss = lambda s: agreement.fleiss_kappa(long_labels(spark, s)).first().kappa
    assert fleiss({"a": "xy", "b": "xy", "c": "xy"}) == pytest.approx(1) and fleiss({"a": "xy", "b": "yx"}) == pytest.approx(-1) and fleiss({"a": "xx", "b": "xx"}) is None


def test_items_of_few_raters_count_too(spark):
    labels = spark.createDataFrame([(0, "a", "f", "x"), (0, "b", "f", "x"), (0, "c", "f", "y"), (1, "a", "f", "y"), (1, "b", "f", "y"), (2, "a", "f", "x"), (3, "a", "f", ""), (3, "b", "f", None)], "item int, rater string, field string, value string")
    got = agreement.fleiss_kappa(labels).first()
    chance = (2 * 2 + 3 * 3) / 25
    assert (got.n_items, got.n_left_out, got.least_raters, got.most_raters) == (2, 2, 2, 3) and got.kappa == pytest.approx(((1 / 3 + 1) / 2 - chance) / (1 - chance))
    assert tuple(agreement.all_agree(labels).select("n_items", "n_agree").first()) == (2, 1)
    assert {tuple(r) for r in agreement.item_mismatches(labels).collect()} == {("a", 4, 0, 1), ("b", 3, 1, 1), ("c", 1, 3, 0)}
    with pytest.raises(ValueError, match="a lacks 0 and leaves 1 empty"):
        agreement.require_same_items(labels)
    agreement.require_same_items(long_labels(spark, {"a": "xy", "b": "yy"}))
    assert agreement.fleiss_kappa(labels.filter("false")).count() == 0


@pytest.mark.parametrize("threshold", [0.1, 0.35, 0.6])
def test_rounds_serve_every_threshold(spark, threshold):
    r = random.Random(14)
    box = lambda: [r.randint(0, 30) / 10, r.randint(0, 30) / 10, r.choice((2, 5, 9, 14)) / 10, r.choice((2, 5, 9, 14)) / 10]
    g, p = [box() for _ in range(60)], [(box(), r.choice((0.2, 0.5, 0.9))) for _ in range(60)]
    gt = table(spark, [("a", i, b, "crack", "minor") for i, b in enumerate(g)])
    pred = table(spark, [("a", i, b, "crack", "minor", c) for i, (b, c) in enumerate(p)], True)
    ways = [{(x.gt, x.pred) for x in matching.greedy_match(gt, pred, threshold, n).collect()} for n in (1000, 5)]
    assert ways[0] == ways[1] == plain(g, p, threshold) and ways[0]


def shuffled_rows(spark):
    jvm, store = spark.sparkContext._gateway.jvm, spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_rounds_over_usual_images_move_few_rows(spark):
    images, r = 400, random.Random(15)
    gt, pred, want = [], [], set()
    for image in range(images):
        box = lambda: [r.randint(0, 3) * 15 / 100, r.randint(0, 3) * 15 / 100, r.randint(30, 49) / 100, r.randint(30, 49) / 100]
        g, p = [box() for _ in range(5)], [(box(), r.choice((0.3, 0.5, 0.9))) for _ in range(5)]
        gt += [(str(image), i, b, "crack", "minor") for i, b in enumerate(g)]
        pred += [(str(image), i, b, "crack", "minor", c) for i, (b, c) in enumerate(p)]
        want |= {(str(image), a, b) for a, b in plain(g, p)}
    before = shuffled_rows(spark)
    got = [(x.image_id, x.gt, x.pred) for x in matching.match_in_rounds(table(spark, gt), table(spark, pred, True)).collect()]
    assert sorted(got) == sorted(want)
    # a grid copies each of the boxes 81 times
    assert shuffled_rows(spark) - before < 10 * (len(gt) + len(pred))


def test_copies_of_boxes_make_one_pair(spark):
    unit = [0, 0, 1, 1]
    gt = table(spark, [("a", 0, unit, "crack", "minor"), ("a", 0, unit, "crack", "minor"), ("a", 1, unit, "crack", "minor"), ("b", 0, unit, "crack", "minor")])
    pred = table(spark, [("a", 0, unit, "crack", "minor", 0.5), ("a", 0, unit, "crack", "minor", 0.5), ("a", 1, unit, "crack", "minor", 0.5), ("b", 0, [3, 3, 1, 1], "crack", "minor", 0.5)], True)
    for fold_boxes in (400, 1):
        got = matching.match_in_rounds(gt, pred, fold_boxes=fold_boxes)
        assert sorted((x.image_id, x.gt, x.pred, x.iou) for x in got.collect()) == [("a", 0, 0, 1.0), ("a", 1, 1, 1.0)]
    assert matching.match_in_rounds(gt.filter("image_id = 'b'"), pred.filter("image_id = 'b'")).count() == 0


def test_poisson_resamples(spark):
    import numpy as np

    counts = [c for c in resample.statistics(*_empty_evaluation(spark)).columns if c != "image_id"]
    rows = [(f"i{k}", k % 4, k % 3, k % 5) for k in range(600)]
    stats = spark.createDataFrame(rows, "image_id string, tp long, fp long, fn long").repartition(3)
    full = stats.select("*", *[F.lit(0).alias(c) for c in counts if c not in ("tp", "fp", "fn")])
    got = {(r.resample, r.metric): r.value for r in resample.poisson_metrics(full, 300).collect()}
    halves = np.array([[int(__import__("hashlib").md5(f"image|{r[0]}".encode()).hexdigest()[7 * i : 7 * i + 7], 16) for i in range(2)] for r in rows])
    times = resample.poisson_copies(halves[:, 0], halves[:, 1], np.array(resample.resample_keys(300)))
    assert abs(times.mean() - 1) < 0.01 and abs(times.var() - 1) < 0.02 and abs((times == 0).mean() - math.exp(-1)) < 0.005
    assert abs(np.corrcoef(times[:, 0], times[:, 1])[0, 1]) < 0.15 and abs(np.corrcoef(times[0], times[1])[0, 1]) < 0.2
    tp, fn = (times.T @ np.array([r[c] for r in rows]) for c in (1, 3))
    assert [got[k, "recall"] for k in range(300)] == pytest.approx(list(tp / (tp + fn)))
    # as wide as drawing n of n
    drawn = np.random.default_rng(1).multinomial(600, [1 / 600] * 600, 300)
    want = (drawn @ np.array([r[1] for r in rows])) / (drawn @ np.array([r[1] + r[3] for r in rows]))
    assert np.std(tp / (tp + fn)) == pytest.approx(np.std(want), rel=0.2)
    assert resample.poisson_metrics(full.filter("false"), 5).filter("value IS NOT NULL").count() == 0


def test_majority(spark):
    got = {r.item: r.value for r in agreement.majority(long_labels(spark, {"a": "xxx", "b": "xyy", "c": "yxz"})).collect()}
    assert got == {0: "x", 1: "x", 2: ""}
    tie = agreement.majority(long_labels(spark, {"a": "x", "b": "y"})).first()
    assert tie.value == ""


def test_suppression_and_second_look(spark):
    rows = [("a", 0, [0, 0, 1, 1], "crack", "minor", 0.9), ("a", 1, [0, 0, 1, 0.9], "crack", "minor", 0.8), ("a", 2, [0, 0, 0.3, 0.3], "crack", "minor", 0.7), ("a", 3, [0, 0, 1, 1], "scratch", "minor", 0.5), ("a", 4, [1, 0, 1, 1], "crack", "minor", 0.4)]
    pred = table(spark, rows, True)
    assert {r.idx for r in matching.suppress_duplicates(pred, 0.5).collect()} == {0, 3, 4}
    assert {r.idx for r in matching.suppress_duplicates(pred, 0.5, fold_boxes=1).collect()} == {0, 3, 4}
    looks = matching.second_look(pred.filter("idx < 2"), pred.filter("idx >= 2"), 0.5)
    assert {(r.idx, r.look) for r in looks.collect()} == {(0, 1), (1, 1), (3, 2), (4, 2)}


def test_before_and_after(spark):
    schema = "id int, view string, damage_type string, part string, cx double, cy double"
    before = spark.createDataFrame([(0, "front", "crack", "door", 0.5, 0.5), (1, "left", None, None, None, None), (2, "extra", "crack", "door", 0.5, 0.5)], schema)
    after = spark.createDataFrame([(0, "front", "crack", "door", 0.62, 0.59), (1, "front", "crack", "door", 0.9, 0.9), (2, "left", "crack", "door", 0.5, 0.5), (3, "extra", "crack", "door", 0.5, 0.5), (4, None, "crack", "door", 0.5, 0.5)], schema)
    got = {r.id: r.state for r in matching.existing_before(before, after, 0.15).collect()}
    assert got == {0: "EXISTING", 1: "NEW", 2: "NEW", 3: "NOT_COMPARED", 4: "NOT_COMPARED"}


def test_polygons(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    assert geometry.coverage(square, (1, 0, 3, 2)) == 0.5 and geometry.coverage(square, (5, 5, 6, 6)) == 0.0 and geometry.coverage(square, (0, 0, 1, 1)) == 1.0
    assert geometry.coverage(square[:2], (0, 0, 1, 1)) == 0.0 and geometry.coverage(square, (1, 1, 1, 1)) == 0.0
    df = spark.createDataFrame([([0.0, 0.0, 2.0, 0.0, 2.0, 2.0, 0.0, 2.0], [1.0, 0.0, 3.0, 2.0]), (None, [0.0] * 4), ([0.0, 0.0, 1.0, 1.0], [0.0, 0.0, 1.0, 1.0])], "p array<double>, b array<double>")
    got = df.select(geometry.coverage_udf("p", "b").alias("c"), geometry.polygon_area_column(F.col("p")).alias("a")).collect()
    assert [(r.c, r.a) for r in got] == [(0.5, 4.0), (None, None), (0.0, 0.0)]


def test_coverage_column_equals_clipping(spark):
    r = random.Random(12)
    rows = []
    for _ in range(200):
        k = r.randint(3, 9)
        turns = sorted(r.random() * 2 * math.pi for _ in range(k))  # simple polygons, often concave, of either orientation
        points = [(5 + r.uniform(0.5, 5) * math.cos(t), 5 + r.uniform(0.5, 5) * math.sin(t)) for t in turns][:: r.choice((1, -1))]
        if r.random() < 0.3:
            points = [(float(round(x)), float(round(y))) for x, y in points]
        x, y = r.uniform(-1, 8), r.uniform(-1, 8)
        rows.append(([v for p in points for v in p], [x, y, x + r.uniform(0.1, 6), y + r.uniform(0.1, 6)]))
    df = spark.createDataFrame(rows, "p array<double>, b array<double>")
    got = [x.c for x in df.select(geometry.coverage_udf("p", "b").alias("c")).collect()]
    want = [geometry.coverage(list(zip(p[0::2], p[1::2])), tuple(b)) for p, b in rows]
    assert got == pytest.approx(want, abs=1e-9) and sum(w > 0 for w in want) > 100


def test_tiles(spark):
    grid = geometry.tile_grid(spark.createDataFrame([(2, 2, 0.2)], "rows int, cols int, overlap double")).orderBy("row", "col").collect()
    assert grid[3].tile.x + grid[3].tile.w == pytest.approx(1) and grid[1].tile.x == pytest.approx(1 - grid[1].tile.w)
    t = F.struct(F.lit(0.5).alias("x"), F.lit(0.0).alias("y"), F.lit(0.5).alias("w"), F.lit(0.5).alias("h"))
    moved = spark.range(1).select(geometry.tile_to_image(F.array(*[F.lit(0.5)] * 4), t).alias("b")).first().b
    assert moved == pytest.approx([0.75, 0.25, 0.25, 0.25])


def test_suppression_in_rounds_equals_the_fold(spark):
    r = random.Random(8)
    rows = [(str(i % 3), i, [r.randint(0, 30) / 10, r.randint(0, 30) / 10, r.choice((2, 3, 9, 14)) / 10, r.choice((2, 3, 9, 14)) / 10], "crack", "minor", r.choice((0.2, 0.5, 0.9))) for i in range(150)]
    pred = table(spark, rows, True)
    want = {(x.image_id, x.idx) for x in matching.suppress_duplicates(pred, 0.3).collect()}
    assert {(x.image_id, x.idx) for x in matching.suppress_duplicates(pred, 0.3, fold_boxes=10).collect()} == want and 10 < len(want) < 150
    pairs = {(x.a, x.b) for x in matching._same_place_pairs(pred, pred, 0.3).collect()}
    boxes = {i: (im, b) for im, i, b, *_ in rows}

    def together(a, b):
        w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
        h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        return w > 0 and h > 0 and (overlap(a, b) >= 0.3 or w * h / min(a[2] * a[3], b[2] * b[3]) >= 0.8)

    assert pairs == {(a, b) for a in boxes for b in boxes if boxes[a][0] == boxes[b][0] and together(boxes[a][1], boxes[b][1])}


def test_every_position_can_be_drawn_evenly(spark):
    n, border = 1_200_000, 1_000_003
    places = spark.range(n).withColumnRenamed("id", "position")
    draws = resample.hashed_draws(places, 3).groupBy("resample").agg(
        F.sum("times").alias("n"), F.sum(F.when(F.col("position") >= border, F.col("times"))).alias("far"), F.count("*").alias("different"), F.max("position").alias("top")
    )
    rows = draws.collect()
    assert len(rows) == 3 and len({r.different for r in rows}) == 3
    for r in rows:
        assert r.n == n and r.top < n
        assert abs(r.far - (n - border)) < 2500  # about six deviations
        assert abs(r.different - n * (1 - 1 / 2.718281828)) < 2500
    m = 600_000  # not a divisor of 1,000,003: the first 400,003 had twice the weight
    low = resample.hashed_draws(spark.range(m).withColumnRenamed("id", "position"), 1).filter("position < 400003").agg(F.sum("times")).first()[0]
    assert abs(low - 400_003) < 2500


def test_intervals_equal_brute_force(spark):
    import numpy as np

    rows = [(f"i{k}", k, k % 4, k % 3, k % 5) for k in range(12)]
    counts = [c for c in resample.statistics(*_empty_evaluation(spark)).columns if c != "image_id"]
    stats = spark.createDataFrame(rows, "image_id string, position long, tp long, fp long, fn long")
    places = stats.select("image_id", "position")
    full = stats.drop("position").select("image_id", "tp", "fp", "fn", *[F.lit(0).alias(c) for c in counts if c not in ("tp", "fp", "fn")])
    draws = resample.hashed_draws(places).cache()
    times = np.zeros((resample.RESAMPLES, 12))
    for r in draws.collect():
        times[r.resample, r.position] = r.times
    tp, fp, fn = (times @ np.array([r[c] for r in rows]) for c in (2, 3, 4))
    got = {r.metric: r for r in resample.intervals(resample.resampled_metrics(full, places, draws)).collect()}
    for metric, values in (("recall", tp / (tp + fn)), ("precision", tp / (tp + fp))):
        assert got[metric].ci95_low == pytest.approx(np.percentile(values, 2.5)) and got[metric].ci95_high == pytest.approx(np.percentile(values, 97.5))
        assert got[metric].resamples_used == resample.RESAMPLES == 2000


def _empty_evaluation(spark):
    images = spark.createDataFrame([], "image_id string, status string")
    gt, pred = table(spark, [("a", 0, [0, 0, 1, 1], "crack", "minor")]), table(spark, [("a", 0, [0, 0, 1, 1], "crack", "minor", 0.9)], True)
    return images, gt, pred, evaluate.matched_pairs(images, gt, pred)


def test_the_query_draws_all_resamples(spark, data):
    from boxmeter.plans import core_queries

    assert {r.metric: r.resamples_used for r in core_queries.bootstrap_all_metrics(spark, data).collect()}["recall"] == resample.RESAMPLES


def test_fold_and_rounds_agree_on_nulls_and_copies(spark):
    import random

    r = random.Random(3)
    rows = [(i, k, [r.random() * 2, r.random() * 2, 1.0, 1.0], r.choice([None, "", "crack"]), "minor", r.choice([0.5, 0.7, 0.9])) for i in "ab" for k in range(25)]
    rows += [(i, k, [0.0, 0.0, 1.0, 1.0], None, "minor", c) for i, k, c in [("c", 0, 0.9), ("c", 1, 0.8), ("c", 1, 0.8), ("c", 2, 0.95), ("c", 2, 0.1)]]
    rows += [("d", 0, [0.0, 0.0, 1.0, 1.0], "crack", "minor", 0.9), ("d", 0, [5.0, 0.0, 1.0, 1.0], "crack", "minor", 0.4)]
    boxes = table(spark, rows + rows[:20], True)
    fold = sorted(tuple(x) for x in matching.suppress_duplicates(boxes, 0.3, 1000).collect())
    rounds = sorted(tuple(x) for x in matching.suppress_duplicates(boxes, 0.3, 0).collect())
    assert fold == rounds and len(fold) == len(set(fold))
    assert [x for x in fold if x[0] in "cd"] == [("c", 2), ("d", 0)]
    first = table(spark, [("c", 7, [0.0, 0.0, 1.0, 1.0], None, "minor")] * 2)
    looks = [sorted(tuple(x) for x in matching.second_look(first, boxes.filter("image_id >= 'c'"), 0.3, n).collect()) for n in (0, 1000)]
    assert looks[0] == looks[1] == [("c", 7, 1), ("d", 0, 2)]
