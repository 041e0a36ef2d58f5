"""Queries of the evaluation operators over the tables of a data folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxmeter.functions import text
from boxmeter.operators import agreement, conversion, detector, evaluate, geometry, matching, merging, resample, runs, sampling, store, validate
from boxmeter.plans import views
from boxmeter.plans.views import LABELS, PAIRS, read
from boxmeter.schemas import CALIBRATION_BINS, DAMAGE_TYPES, GENERAL_DAMAGE_TYPES, GENERAL_PARTS, LABEL_FIELDS, PARTS, SEVERITIES, THRESHOLDS
from boxmeter.streaming import keyed, limiter, windows

_Q: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _Q[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _r(c: str, digits: int = 9):
    """Sums of doubles depend on their order, so their last digits are rounded off on both sides."""
    return F.round(c, digits).alias(c)


def _values(words: list[str], name: str) -> str:
    return "(VALUES " + ", ".join(f"('{w}')" for w in words) + f") AS d({name})"


# ---------------------------------------------------------------- matching and metrics


@query(PAIRS + "SELECT image_id, gk AS gt, pk AS pred, iou FROM pairs")
def greedy_matching(spark: SparkSession, d: str) -> DataFrame:
    images, gt, pred = views.evaluation(spark, d)
    g, p = evaluate.counted(images, gt, pred)
    return matching.greedy_match(g, p)


@query(PAIRS + "SELECT image_id, gk AS gt, pk AS pred, iou FROM pairs")
def matching_in_rounds(spark: SparkSession, d: str) -> DataFrame:
    images, gt, pred = views.evaluation(spark, d)
    g, p = evaluate.counted(images, gt, pred)
    return matching.match_in_rounds(g, p)


_PER_IMAGE = PAIRS + """, report AS (
  SELECT i.image_id, i.status, (SELECT count(*) FROM pairs m WHERE m.image_id = i.image_id) AS tp,
         (SELECT count(*) FROM pred p WHERE p.image_id = i.image_id) AS np, (SELECT count(*) FROM gt g WHERE g.image_id = i.image_id) AS ng
  FROM images i
)
"""


@query(_PER_IMAGE + "SELECT image_id, status, tp, np - tp AS fp, ng - tp AS fn FROM report")
def per_image_report(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.per_image_of(views.parts(spark, d))


@query(
    _PER_IMAGE + """, t AS (SELECT count(*) AS images, count(*) FILTER (status <> 'success') AS images_failed, sum(tp)::BIGINT AS tp, sum(np - tp)::BIGINT AS fp, sum(ng - tp)::BIGINT AS fn FROM report),
  r AS (SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM t)
  SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM r"""
)
def detection_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.detection(evaluate.per_image_of(views.parts(spark, d)))


_CLASSES = PAIRS + f""", c AS (
  SELECT damage_type, (SELECT count(*) FROM pairs WHERE gt_type = p_type AND gt_type = damage_type) AS tp,
         (SELECT count(*) FROM pred p WHERE p.damage_type = d.damage_type) AS np, (SELECT count(*) FROM gt g WHERE g.damage_type = d.damage_type) AS ng
  FROM {_values(DAMAGE_TYPES, "damage_type")}
), k AS (SELECT damage_type, tp, np - tp AS fp, ng - tp AS fn, CASE WHEN np > 0 THEN tp / np END AS precision, CASE WHEN ng > 0 THEN tp / ng END AS recall FROM c),
classes AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) WHEN precision + recall = 0 THEN 0.0 END AS f1 FROM k)
"""


@query(_CLASSES + "SELECT * FROM classes")
def per_class_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.per_class_of(views.parts(spark, d))


@query(_CLASSES + "SELECT round(avg(coalesce(f1, 0.0)), 9) AS macro_f1 FROM classes WHERE tp + fp + fn > 0")
def macro_f1(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.macro_f1(evaluate.per_class_of(views.parts(spark, d))).select(_r("macro_f1"))


_FIELD_COLUMNS = {"damage_type": ("gt_type", "p_type"), "severity": ("gs", "ps"), "part": ("gp", "pp"), "action": ("ga", "pa")}


@query(
    PAIRS
    + " UNION ALL ".join(
        f"SELECT '{f}' AS field, count({p}) AS n, count(*) FILTER ({g} = {p}) AS correct, count(*) FILTER ({g} = {p}) / count({p}) AS accuracy FROM pairs" for f, (g, p) in _FIELD_COLUMNS.items()
    )
)
def field_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.field_accuracy(views.pairs(spark, d))


@query(
    PAIRS + "SELECT gt, " + ", ".join(f"(SELECT count(*) FROM pairs WHERE gs = gt AND ps = '{s}') AS {s}" for s in SEVERITIES) + f" FROM {_values(SEVERITIES, 'gt')}"
)
def severity_confusion(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.severity_confusion(views.pairs(spark, d))


@query(
    PAIRS + """SELECT count(*) AS n, round(avg((confidence - y) ** 2), 9) AS brier, round(corr(confidence, y), 9) AS pearson
  FROM (SELECT confidence, CASE WHEN gt_type = p_type THEN 1.0::DOUBLE ELSE 0.0 END AS y FROM pairs)"""
)
def confidence_scores(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confidence_scores(views.pairs(spark, d)).select("n", _r("brier"), _r("pearson"))


@query(
    PAIRS
    + " UNION ALL ".join(
        f"SELECT '{lo:.1f}-{hi:.1f}' AS confidence_range, count(*) AS count, count(*) FILTER (gt_type = p_type) / nullif(count(*), 0) AS empirical_accuracy, "
        f"round(avg(confidence), 9) AS mean_confidence FROM pairs WHERE confidence >= {lo} AND confidence {'<=' if hi == 1.0 else '<'} {hi}"
        for lo, hi in CALIBRATION_BINS
    )
)
def calibration_table(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.calibration(views.pairs(spark, d)).select("confidence_range", "count", "empirical_accuracy", _r("mean_confidence"))


@query(
    PAIRS + """, both_ AS (SELECT g.image_id IS NOT NULL AS g, p.image_id IS NOT NULL AS p FROM (SELECT DISTINCT image_id, damage_type FROM gt) g
    FULL JOIN (SELECT DISTINCT image_id, damage_type FROM pred) p ON g.image_id = p.image_id AND g.damage_type = p.damage_type),
  t AS (SELECT count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g) AS fp, count(*) FILTER (NOT p) AS fn FROM both_)
  SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM t"""
)
def image_level_presence(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.image_level(*views.evaluation(spark, d))


@query(
    PAIRS + f""", records AS (SELECT p.image_id, p.confidence, m.pk IS NOT NULL AS matched, m.pk IS NOT NULL AND m.gt_type = m.p_type AS correct FROM pred p LEFT JOIN pairs m ON m.pk = p.k),
  facts AS (SELECT i.image_id, (SELECT count(*) FROM gt g WHERE g.image_id = i.image_id) AS ng, (SELECT count(*) FROM records r WHERE r.image_id = i.image_id) AS np,
    coalesce((SELECT min(confidence) FROM records r WHERE r.image_id = i.image_id), 9) AS low, coalesce((SELECT bool_and(correct) FROM records r WHERE r.image_id = i.image_id), true) AS fine FROM images i)
  SELECT t::DOUBLE AS threshold, count(*) FILTER (confidence >= t) AS accepted, count(*) FILTER (confidence >= t) / count(*) AS coverage,
    count(*) FILTER (confidence >= t AND matched) / count(*) FILTER (confidence >= t) AS precision,
    count(*) FILTER (confidence >= t AND correct) / count(*) FILTER (confidence >= t AND matched) AS type_accuracy,
    count(*) FILTER (confidence >= t AND matched) / (SELECT count(*) FROM gt) AS recall,
    (SELECT count(*) FROM facts WHERE low >= t) AS images_all_predictions_accepted, (SELECT count(*) FROM facts WHERE low >= t AND np = ng AND fine) AS images_fully_correct_and_accepted
  FROM records, (VALUES {", ".join(f"({t})" for t in THRESHOLDS)}) AS v(t) GROUP BY t"""
)
def selective_curve(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.selective_curve_of(views.parts(spark, d))


_HALVES = " ".join(f", ('0x' || substr(md5('image|' || image_id), {1 + 7 * k}, 7))::BIGINT AS h{k + 1}" for k in range(2))
_KEYS = ", ".join(f"('0x' || substr(md5('{resample.SEED}|' || r), {1 + 7 * k}, 7))::BIGINT AS a{k}" for k in range(3))
_COUNT = lambda table, where: f"(SELECT count(*) FROM {table} x WHERE x.image_id = i.image_id{where})"
_BOOT = PAIRS + f""", stats AS (
  SELECT i.image_id{_HALVES}, {_COUNT("pairs", "")} AS tp, {_COUNT("pred", "")} AS np, {_COUNT("gt", "")} AS ng, {_COUNT("pairs", " AND gt_type = p_type")} AS ok,
    coalesce((SELECT sum((confidence - CASE WHEN gt_type = p_type THEN 1.0::DOUBLE ELSE 0.0 END) ** 2) FROM pairs x WHERE x.image_id = i.image_id), 0.0) AS brier,
    {", ".join(f"{_COUNT('pairs', f' AND {p} IS NOT NULL')} AS n_{f}, {_COUNT('pairs', f' AND {g} = {p}')} AS ok_{f}" for f, g, p in (("severity", "gs", "ps"), ("part", "gp", "pp"), ("action", "ga", "pa")))},
    {", ".join(f"{_COUNT('pairs', chr(32) + f'AND gt_type = p_type AND gt_type = {t!r}')} AS tp{k}, {_COUNT('pred', f' AND damage_type = {t!r}')} AS np{k}, {_COUNT('gt', f' AND damage_type = {t!r}')} AS ng{k}" for k, t in enumerate(DAMAGE_TYPES))}
  FROM images i
), keys AS (SELECT r, {_KEYS} FROM range({resample.RESAMPLES}) AS t(r)),
hashed AS (SELECT s.*, r, (a0 + a1 * h1 + a2 * h2) % 2147483647 AS y FROM stats s, keys),
fifth AS (SELECT *, (((y * y) % 2147483647) * ((y * y) % 2147483647)) % 2147483647 * y % 2147483647 AS x FROM hashed),
drawn AS (SELECT *, {" + ".join(f"(x >= {t})::BIGINT" for t in resample.POISSON_STEPS)} AS times FROM fifth),
sums AS (
  SELECT r, {", ".join(f"sum(times * {c}) AS {c}" for c in ["tp", "np", "ng", "ok", "brier", *[f"{k}_{f}" for f in ("severity", "part", "action") for k in ("n", "ok")], *[f"{c}{k}" for k in range(4) for c in ("tp", "np", "ng")]])}
  FROM drawn GROUP BY r
), v AS (
  SELECT tp / nullif(ng, 0) AS recall, tp / nullif(np, 0) AS precision, ok / nullif(tp, 0) AS type_accuracy, brier / nullif(tp, 0) AS brier,
    {", ".join(f"ok_{f} / nullif(n_{f}, 0) AS {f}_accuracy" for f in ("severity", "part", "action"))},
    ({" + ".join(f"coalesce(2 * tp{k} / nullif(np{k} + ng{k}, 0), 0) * (np{k} > 0 AND ng{k} > 0)::INT" for k in range(4))}) / nullif({" + ".join(f"(np{k} + ng{k} > 0)::INT" for k in range(4))}, 0) AS macro_f1
  FROM sums
)
"""


def _intervals_sql(*metrics: str) -> str:
    return _BOOT + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, round(quantile_cont({m}, 0.025), 9) AS ci95_low, round(quantile_cont({m}, 0.975), 9) AS ci95_high, count({m}) AS resamples_used FROM v" for m in metrics
    )


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    values = resample.poisson_metrics(resample.statistics_of(views.parts(spark, d)))
    return resample.intervals(values).select("metric", _r("ci95_low"), _r("ci95_high"), "resamples_used")


@query(_intervals_sql("recall", "precision"))
def bootstrap_intervals(spark: SparkSession, d: str) -> DataFrame:
    return _intervals(spark, d).filter("metric IN ('recall', 'precision')")


@query(_intervals_sql("recall", "precision", "macro_f1", "type_accuracy", "severity_accuracy", "part_accuracy", "action_accuracy", "brier"))
def bootstrap_all_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _intervals(spark, d)


# ---------------------------------------------------------------- geometry, duplicates, tiles, before and after

_SAME = """greatest(0.0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0.0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"""
_DUPLICATES = f"""
WITH RECURSIVE box AS ({views._text(views.BOXES, False).replace("ORDERS", "orders")}), p AS (SELECT * FROM box WHERE is_pred = 1),
near AS (
  SELECT k, list(other) AS others FROM (
    SELECT a.k, b.k AS other, {_SAME} AS i, a.w * a.h AS aa, b.w * b.h AS ba FROM p a JOIN p b ON a.image_id = b.image_id AND a.damage_type = b.damage_type AND a.k <> b.k)
  WHERE i > 0 AND (i / (aa + ba - i) >= 0.4 OR i / least(aa, ba) >= 0.8) GROUP BY k
), ranked AS (SELECT p.image_id, damage_type, p.k, coalesce(others, []) AS others, row_number() OVER (PARTITION BY p.image_id, damage_type ORDER BY confidence DESC, p.k) AS rn FROM p LEFT JOIN near USING (k)),
walk(image_id, damage_type, rn, kept) AS (
  SELECT DISTINCT image_id, damage_type, 0::BIGINT, []::BIGINT[] FROM ranked
  UNION ALL
  SELECT w.image_id, w.damage_type, w.rn + 1, CASE WHEN list_has_any(w.kept, r.others) THEN w.kept ELSE list_append(w.kept, r.k) END
  FROM walk w JOIN ranked r ON r.image_id = w.image_id AND r.damage_type = w.damage_type AND r.rn = w.rn + 1
)
SELECT image_id, unnest(kept) AS idx FROM walk WHERE (image_id, damage_type, rn) IN (SELECT image_id, damage_type, max(rn) FROM walk GROUP BY ALL)
"""


@query(_DUPLICATES)
def suppressed_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return matching.suppress_duplicates(views.boxes(spark, d).filter("is_pred = 1"), 0.4)


_LOOK = _DUPLICATES.replace(
    "p AS (SELECT * FROM box WHERE is_pred = 1)",
    f"""p AS (SELECT * FROM box a WHERE is_pred = 1 AND NOT EXISTS (
  SELECT 1 FROM (SELECT b.k, {_SAME} AS i, a.w * a.h AS aa, b.w * b.h AS ba FROM box b WHERE b.is_pred = 0 AND b.image_id = a.image_id AND b.damage_type = a.damage_type)
  WHERE i > 0 AND (i / (aa + ba - i) >= 0.4 OR i / least(aa, ba) >= 0.8)))""",
).replace("SELECT image_id, unnest(kept) AS idx FROM walk", "SELECT image_id, k AS idx, 1 AS look FROM box WHERE is_pred = 0 UNION ALL SELECT image_id, unnest(kept), 2 FROM walk")


@query(_LOOK)
def second_look_merge(spark: SparkSession, d: str) -> DataFrame:
    """Reference boxes as the first look, predictions as the second."""
    b = views.boxes(spark, d)
    return matching.second_look(b.filter("is_pred = 0"), b.filter("is_pred = 1"), 0.4)


@query(
    """SELECT event_id, state FROM (
  SELECT a.event_id, CASE WHEN a.view NOT IN (SELECT view FROM p WHERE late = 0 AND view <> 'purchase') THEN 'NOT_COMPARED'
    WHEN EXISTS (SELECT 1 FROM p b WHERE b.late = 0 AND b.view <> 'purchase' AND b.view = a.view AND b.damage_type = a.damage_type AND b.part = a.part AND sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) <= 0.15 + 1e-12) THEN 'EXISTING' ELSE 'NEW' END AS state
  FROM p a WHERE late = 1)""".replace("FROM p ", "FROM p_ ").replace("SELECT event_id, state", "WITH p_ AS (" + views.PHOTOS_SQL + ") SELECT event_id, state", 1)
)
def before_and_after(spark: SparkSession, d: str) -> DataFrame:
    p = views.photos(spark, d)
    return matching.existing_before(p.filter("late = 0 AND view <> 'purchase'"), p.filter("late = 1"), 0.15 + 1e-12).select("event_id", "state")


@query(
    """WITH p_ AS (""" + views.PHOTOS_SQL + """), s AS (SELECT a.user_id, CASE WHEN a.view NOT IN (SELECT view FROM p_ WHERE late = 0 AND view <> 'purchase') THEN 'NOT_COMPARED'
    WHEN EXISTS (SELECT 1 FROM p_ b WHERE b.late = 0 AND b.view <> 'purchase' AND b.view = a.view AND b.damage_type = a.damage_type AND b.part = a.part AND sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) <= 0.15 + 1e-12) THEN 'EXISTING' ELSE 'NEW' END AS state
    FROM (SELECT p_.*, e.user_id FROM p_ JOIN events e USING (event_id) WHERE late = 1) a)
  SELECT user_id, count(*) FILTER (state = 'NEW') AS n_new, count(*) FILTER (state = 'EXISTING') AS n_existing, count(*) FILTER (state = 'NOT_COMPARED') AS n_not_compared FROM s GROUP BY user_id"""
)
def comparison_totals(spark: SparkSession, d: str) -> DataFrame:
    p = views.photos(spark, d)
    states = matching.existing_before(p.filter("late = 0 AND view <> 'purchase'"), p.filter("late = 1"), 0.15 + 1e-12)
    return store.comparison_totals(states.join(read(spark, d, "events").select("event_id", "user_id"), "event_id"), "user_id")


_CENTRES = "SELECT l_orderkey AS image_id, l_suppkey * 1000 + l_linenumber AS position, l_partkey % 6 AS class_id, (l_partkey % 9973) / 9973.0::DOUBLE AS confidence, (l_orderkey % 101) / 100.0::DOUBLE AS cx, (l_suppkey % 97) / 96.0::DOUBLE AS cy, (1 + l_partkey % 50) / 100.0::DOUBLE AS w, (1 + l_linenumber * 7) / 100.0::DOUBLE AS h"
_KINDS = {**dict(enumerate(DAMAGE_TYPES)), 4: "wheel", 5: "plate"}
_DETECTED = f"""
WITH raw AS (SELECT DISTINCT * FROM ({_CENTRES} FROM lineitem)),
c AS (SELECT *, CASE class_id WHEN 0 THEN 'glass_shatter' WHEN 1 THEN 'lamp_broken' WHEN 2 THEN 'crack' ELSE 'scratch' END AS damage_type, least(greatest(cx - w / 2, 0.0), 1.0) AS x, least(greatest(cy - h / 2, 0.0), 1.0) AS y FROM raw WHERE class_id < 4)
SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY round_even(confidence, 4) DESC, position, damage_type, round_even(x, 6)) - 1 AS idx, damage_type, round_even(confidence, 4) AS confidence,
  round_even(x, 6) AS x, round_even(y, 6) AS y, round_even(least(w, 1.0 - x), 6) AS w, round_even(least(h, 1.0 - y), 6) AS h FROM c
"""


@query(_DETECTED)
def detector_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Items as a detector's centre boxes, in the corner form of predictions."""
    raw = read(spark, d, "lineitem").selectExpr(*[x.replace("::DOUBLE", "D") for x in _CENTRES.removeprefix("SELECT ").split(", ")]).withColumn("class_id", F.col("class_id").cast("int")).distinct()
    found = detector.detector_damages(raw, _KINDS)
    return found.select("image_id", "idx", "damage_type", "confidence", *[F.col("box")[i].alias(c) for i, c in enumerate("xywh")])


_TILES = [(1, 1, 0.0), (2, 2, 0.2), (3, 2, 0.1), (1, 4, 0.25)]


@query(
    "WITH g(rows, cols, overlap) AS (VALUES " + ", ".join(f"({a}, {b}, {c}::DOUBLE)" for a, b, c in _TILES) + "), s AS (SELECT *, 1 / (cols - (cols - 1) * overlap) AS w, 1 / (rows - (rows - 1) * overlap) AS h FROM g) "
    "SELECT rows, cols, r AS row, c AS col, round(CASE WHEN cols = 1 THEN 0.0 ELSE c * (1 - w) / (cols - 1) END, 9) AS x, round(CASE WHEN rows = 1 THEN 0.0 ELSE r * (1 - h) / (rows - 1) END, 9) AS y, round(w, 9) AS w, round(h, 9) AS h "
    "FROM s, LATERAL (SELECT unnest(range(rows)) AS r), LATERAL (SELECT unnest(range(cols)) AS c)"
)
def tile_grids(spark: SparkSession, d: str) -> DataFrame:
    grids = spark.createDataFrame(_TILES, "rows int, cols int, overlap double")
    t = geometry.tile_grid(grids).select("rows", "cols", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "tile.*")
    return t.select("rows", "cols", "row", "col", _r("x"), _r("y"), _r("w"), _r("h"))


@query(
    "WITH box AS (" + views._text(views.BOXES, False).replace("ORDERS", "orders") + ") SELECT k, round(0.5 + x * 0.5, 9) AS x, round(0.25 + y * 0.5, 9) AS y, round(w * 0.5, 9) AS w, round(h * 0.5, 9) AS h, printf('%d %.6f %.6f %.6f %.6f', k % 4, x + w / 2, y + h / 2, w, h) AS line FROM box"
)
def box_projections(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of a tile in the image, and as label lines."""
    b = views.boxes(spark, d)
    tile = F.struct(F.lit(0.5).alias("x"), F.lit(0.25).alias("y"), F.lit(0.5).alias("w"), F.lit(0.5).alias("h"))
    moved = geometry.tile_to_image(F.col("box"), tile)
    line = geometry.yolo_line((F.col("k") % 4).cast("int"), F.col("box"))
    return b.select("k", *[F.round(moved[i], 9).alias(c) for i, c in enumerate("xywh")], line.alias("line"))


_RANK = "CASE severity WHEN 'minor' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END"
_MERGED = (
    "WITH box AS (" + views._text(views.BOXES, False).replace("ORDERS", "orders") + f"""), merged AS (SELECT image_id AS key, part, damage_type, min(k) AS first_seen, count(*) AS n, avg(confidence) AS confidence,
  ['minor', 'moderate', 'severe'][max({_RANK}) + 1] AS severity, arg_max(action, (confidence, -k)) AS action FROM box WHERE is_pred = 1 GROUP BY ALL)"""
)


@query(_MERGED + " SELECT key, part, damage_type, first_seen, n, round(confidence, 9) AS confidence, severity, action FROM merged")
def merged_photos(spark: SparkSession, d: str) -> DataFrame:
    sights = views.boxes(spark, d).filter("is_pred = 1").withColumnRenamed("image_id", "key").withColumn("position", F.col("k"))
    return merging.merge_photos(sights).withColumn("confidence", F.round("confidence", 9))


@query(_MERGED + f" SELECT key, round(least(100.0, sum(({_RANK} + 1) * 20.0 * confidence)), 6) AS overall_score FROM merged GROUP BY key")
def merged_scores(spark: SparkSession, d: str) -> DataFrame:
    sights = views.boxes(spark, d).filter("is_pred = 1").withColumnRenamed("image_id", "key").withColumn("position", F.col("k"))
    return merging.overall_score(merging.merge_photos(sights)).select("key", _r("overall_score", 6))


@query(
    """WITH parts AS (SELECT user_id AS image_id, event_id % 5 AS part, event_type <> 'error' AS ok, 1 + event_id % 3 AS attempts, value, event_id % 4 AS n_damages, event_id % 2 = 0 AS seen FROM events)
  SELECT image_id, CASE WHEN bool_or(ok) THEN 'success' ELSE 'error' END AS status, sum(attempts)::BIGINT AS attempts, round(avg(value) FILTER (ok), 9) AS overall_score, count(*) FILTER (NOT ok) AS n_failed,
    CASE WHEN sum(n_damages) FILTER (ok) > 0 THEN true ELSE bool_or(seen) FILTER (ok AND part = 0) END AS vehicle_visible FROM parts GROUP BY image_id"""
)
def combined_tiles(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    parts = e.select(
        F.col("user_id").alias("image_id"), (F.col("event_id") % 5).alias("part"), F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        (1 + F.col("event_id") % 3).alias("attempts"), F.col("value").alias("overall_score"), (F.col("event_id") % 2 == 0).alias("vehicle_visible"), (F.col("event_id") % 4).alias("n_damages"),
    )
    return merging.combine_parts(parts).withColumn("overall_score", F.round("overall_score", 9))


# ---------------------------------------------------------------- raw labels to annotations

_WIDTH, _HEIGHT = 1000, 800
_RAW_NAMES = ["broken-glass", "Front_Lamp", "deep crack", "Scratch"]
_PART_NAMES = ["front-left_door", "Side Mirror", "rear quarter", "front panel", "rocker", "unheard of"]
_LINES_SQL = "WITH box AS (" + views._text(views.BOXES, False).replace("ORDERS", "orders") + f"""), raw AS (
  SELECT image_id, k AS line_no, k % 4 AS class_id, greatest(0.0, (x + w / 2 - w / 2) * {_WIDTH}) AS x0, greatest(0.0, (y + h / 2 - h / 2) * {_HEIGHT}) AS y0,
    least({_WIDTH}.0, (x + w / 2 + w / 2) * {_WIDTH}) AS x1, least({_HEIGHT}.0, (y + h / 2 + h / 2) * {_HEIGHT}) AS y1 FROM box WHERE is_pred = 1 AND k % 11 <> 0
), part AS (
  SELECT image_id, k AS part_no, [{", ".join(f"'{n}'" for n in _PART_NAMES)}][k // 2 % {len(_PART_NAMES)} + 1] AS name, x * {_WIDTH} AS px0, y * {_HEIGHT} AS py0, (x + w) * {_WIDTH} AS px1, (y + h) * {_HEIGHT} AS py1 FROM box WHERE is_pred = 0
), met AS (
  SELECT r.image_id, r.line_no, p.part_no, p.name, round(greatest(0.0, least(x1, px1) - greatest(x0, px0)) * greatest(0.0, least(y1, py1) - greatest(y0, py0)) / ((x1 - x0) * (y1 - y0)), 12) AS c
  FROM raw r JOIN part p USING (image_id) WHERE x1 > x0 AND y1 > y0
)"""


def _raw_labels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Damage lines (every eleventh has too few values) and parts as rectangles drawn as polygons, of images of one size."""
    b = views.boxes(spark, d)
    centre = F.array(F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2, "w", "h")
    lines = b.filter("is_pred = 1").select(F.col("image_id").cast("string").alias("stem"), F.col("k").alias("line_no"), (F.col("k") % 4).cast("int").alias("class_id"), F.when(F.col("k") % 11 == 0, F.array("x")).otherwise(centre).alias("values"))
    images = b.select("image_id").distinct().select("image_id", F.col("image_id").cast("string").alias("stem"), F.lit(_WIDTH).alias("width"), F.lit(_HEIGHT).alias("height"))
    names = spark.createDataFrame(list(enumerate(_RAW_NAMES)), "class_id int, name string")
    x0, y0, x1, y1 = F.col("x") * _WIDTH, F.col("y") * _HEIGHT, (F.col("x") + F.col("w")) * _WIDTH, (F.col("y") + F.col("h")) * _HEIGHT
    name = F.element_at(F.array(*[F.lit(n) for n in _PART_NAMES]), (F.expr("k div 2") % len(_PART_NAMES) + 1).cast("int"))
    parts = b.filter("is_pred = 0").select("image_id", F.col("k").alias("part_no"), name.alias("name"), F.array(x0, y0, x1, y0, x1, y1, x0, y1).alias("polygon"))
    return conversion.damage_boxes(lines, images, names), parts


_PART_OF = "CASE name " + " ".join(f"WHEN '{n}' THEN '{p}'" for n, p in zip(_PART_NAMES, ("door", "mirror", "fender", "bumper", "other", "other"))) + " END"
_ANNOTATED = _LINES_SQL + """, best AS (
  SELECT image_id, line_no, max(c) AS c, arg_max(name, (c, -part_no)) AS name FROM met WHERE c > 0 GROUP BY ALL
), annotated AS (
  SELECT r.image_id, r.line_no, ['glass_shatter', 'lamp_broken', 'crack', 'scratch'][class_id + 1] AS damage_type, x0, y0, x1, y1, coalesce(b.c, 0) AS c, b.name AS name FROM raw r LEFT JOIN best b USING (image_id, line_no) WHERE x1 > x0 AND y1 > y0
)"""


@query(
    _ANNOTATED + f""" SELECT image_id, line_no, damage_type, round_even(x0, 1) AS x, round_even(y0, 1) AS y, round_even(x1 - x0, 1) AS w, round_even(y1 - y0, 1) AS h, round_even((x1 - x0) * (y1 - y0), 1) AS area,
  CASE WHEN damage_type = 'lamp_broken' THEN 'light' WHEN c < 0.1 THEN '' ELSE {_PART_OF} END AS auto_part,
  CASE WHEN damage_type = 'lamp_broken' THEN 'damage type lamp_broken' WHEN c < 0.1 THEN '' ELSE name END AS auto_part_source, CASE WHEN damage_type = 'lamp_broken' THEN 1.0 ELSE round_even(c, 2) END::DOUBLE AS auto_part_coverage FROM annotated"""
)
def annotated_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Damage lines as annotations with the part that covers most of the box."""
    a = conversion.annotate(*_raw_labels(spark, d))
    return a.select("image_id", "line_no", "damage_type", *[F.col("bbox")[i].alias(c) for i, c in enumerate("xywh")], "area", "auto_part", "auto_part_source", "auto_part_coverage")


@query(
    _ANNOTATED + """ SELECT t AS counter, (SELECT count(*) FROM annotated WHERE damage_type = t) AS n FROM (VALUES ('glass_shatter'), ('lamp_broken'), ('crack'), ('scratch')) AS v(t)
  UNION ALL SELECT 'skipped_bad_damage_line', (SELECT count(*) FROM box WHERE is_pred = 1 AND k % 11 = 0) UNION ALL SELECT 'skipped_empty_box', (SELECT count(*) FROM raw WHERE x1 <= x0 OR y1 <= y0)
  UNION ALL SELECT 'no_auto_part', (SELECT count(*) FROM annotated WHERE c < 0.1)"""
)
def conversion_counters(spark: SparkSession, d: str) -> DataFrame:
    boxes, parts = _raw_labels(spark, d)
    return conversion.conversion_report(boxes, conversion.annotate(boxes, parts))


# ---------------------------------------------------------------- agreement

_KAPPA = """, cells AS (SELECT a.field, a.rater AS ra, b.rater AS rb, a.value AS va, b.value AS vb FROM labels a JOIN labels b ON a.item = b.item AND a.field = b.field AND a.rater < b.rater),
n AS (SELECT field, ra, rb, count(*) AS n, count(*) FILTER (va = vb) AS same FROM cells GROUP BY ALL),
ma AS (SELECT field, ra, rb, va AS v, count(*) AS m FROM cells GROUP BY ALL), mb AS (SELECT field, ra, rb, vb AS v, count(*) AS m FROM cells GROUP BY ALL),
x AS (SELECT field, ra, rb, sum(ma.m * mb.m)::BIGINT AS x FROM ma JOIN mb USING (field, ra, rb, v) GROUP BY ALL)
SELECT field, ra, rb, n, same / n AS agreement, CASE WHEN coalesce(x, 0) < n * n THEN (same * n - coalesce(x, 0)) / (n * n - coalesce(x, 0)) END AS kappa FROM n LEFT JOIN x USING (field, ra, rb)"""


@query(LABELS + _KAPPA)
def pairwise_kappas(spark: SparkSession, d: str) -> DataFrame:
    return agreement.pairwise_kappas(views.labels(spark, d))


@query(
    LABELS + """, rated AS (SELECT field, item, list(value) FILTER (value <> '') AS vs FROM labels GROUP BY ALL), many AS (SELECT * FROM rated WHERE len(vs) > 1),
  same AS (SELECT field, item, len(vs) AS r, len(list_filter(flatten(list_transform(range(1, len(vs) + 1), lambda i: list_transform(range(i + 1, len(vs) + 1), lambda j: vs[i] = vs[j]))), lambda b: b)) AS agreeing FROM many),
  one AS (SELECT field, value, count(*) AS m FROM (SELECT field, unnest(vs) AS value FROM many) GROUP BY ALL), shares AS (SELECT field, sum((m / total) ** 2) AS pe FROM (SELECT *, sum(m) OVER (PARTITION BY field) AS total FROM one) GROUP BY field),
  t AS (SELECT field, count(*) AS n_items, min(r) AS least_raters, max(r) AS most_raters, avg(agreeing / (r * (r - 1) / 2)) AS pa FROM same GROUP BY field)
  SELECT field, n_items, (SELECT count(*) FROM rated WHERE rated.field = t.field) - n_items AS n_left_out, least_raters, most_raters, round((pa - pe) / (1 - pe), 9) AS kappa FROM t JOIN shares USING (field)"""
)
def fleiss_kappa(spark: SparkSession, d: str) -> DataFrame:
    return agreement.fleiss_kappa(views.labels(spark, d)).select("field", "n_items", "n_left_out", "least_raters", "most_raters", _r("kappa"))


@query(
    LABELS + "SELECT field, count(*) AS n_items, count(*) FILTER (lo = hi) AS n_agree, count(*) FILTER (lo = hi) / count(*) AS all_agree "
    "FROM (SELECT field, item, min(value) AS lo, max(value) AS hi FROM labels WHERE value <> '' GROUP BY ALL HAVING count(*) >= 2) GROUP BY field"
)
def all_agree(spark: SparkSession, d: str) -> DataFrame:
    return agreement.all_agree(views.labels(spark, d))


@query(
    LABELS + ", n AS (SELECT count(*) AS n FROM (SELECT DISTINCT item, field FROM labels)) "
    "SELECT rater, count(*) AS n_items, (SELECT n FROM n) - count(*) AS n_missing, count(*) FILTER (value = '') AS n_unfilled FROM labels GROUP BY rater"
)
def sheet_mismatches(spark: SparkSession, d: str) -> DataFrame:
    return agreement.item_mismatches(views.labels(spark, d))


@query(
    LABELS + ", v AS (SELECT item, field, value, count(*) AS m FROM labels GROUP BY ALL) "
    "SELECT item, field, CASE WHEN max(m) * 2 > sum(m) THEN arg_max(value, m) ELSE '' END AS value, max(m) AS n_votes, sum(m)::BIGINT AS n_raters FROM v GROUP BY item, field"
)
def majority_labels(spark: SparkSession, d: str) -> DataFrame:
    return agreement.majority(views.labels(spark, d))


@query(LABELS + "SELECT a.item, a.field, a.value AS va, b.value AS vb FROM labels a JOIN labels b USING (item, field) WHERE a.rater = 'a02' AND b.rater = 'b00' AND a.value <> b.value")
def sheet_disagreements(spark: SparkSession, d: str) -> DataFrame:
    return agreement.disagreements(agreement.paired(views.labels(spark, d), "a02", "b00"))


@query(
    LABELS + ", a AS (SELECT DISTINCT item FROM labels WHERE rater = 'a02'), b AS (SELECT DISTINCT item FROM labels WHERE rater = 'b00') "
    "SELECT (SELECT count(*) FROM a SEMI JOIN b USING (item)) AS n_common, (SELECT count(*) FROM a ANTI JOIN b USING (item)) AS n_only_a, (SELECT count(*) FROM b ANTI JOIN a USING (item)) AS n_only_b"
)
def sheet_coverage(spark: SparkSession, d: str) -> DataFrame:
    return agreement.coverage_of(views.labels(spark, d), "a02", "b00")


@query(
    LABELS + """, p AS (SELECT item, field, value FROM labels WHERE rater = 'a05'), j AS (SELECT p.field, p.value AS p, a.value AS va, b.value AS vb FROM p JOIN labels a USING (item, field) JOIN labels b USING (item, field) WHERE a.rater = 'a02' AND b.rater = 'b00')
  SELECT field, count(*) AS pairs, count(*) FILTER (va = vb) AS agree, count(*) FILTER (p = va) / count(*) AS vs_a, count(*) FILTER (p = vb) / count(*) AS vs_b, count(*) FILTER (va = vb AND p = va) / nullif(count(*) FILTER (va = vb), 0) AS where_equal FROM j GROUP BY field"""
)
def label_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    labels = views.labels(spark, d)
    return agreement.sensitivity(labels.filter("rater = 'a05'").select("item", "field", "value"), labels, "a02", "b00")


# ---------------------------------------------------------------- answers

def _judged(types: list[str], parts: list[str]) -> str:
    return f"""
WITH answers AS ({views.ANSWERS_SQL}), t AS (SELECT event_id, raw, CASE WHEN raw LIKE '```%' THEN trim(regexp_extract(raw, '(?s)^```[^\\n]*\\n(.*)```', 1), ' ' || chr(10)) ELSE raw END AS x FROM answers),
p AS (SELECT event_id, CASE WHEN x NOT LIKE '{{%' THEN 'answer is not a JSON object' WHEN NOT json_valid(x) THEN 'answer is not valid JSON' END AS problem, CASE WHEN json_valid(x) THEN x::JSON END AS j FROM t),
m AS (SELECT event_id, problem, CASE WHEN problem IS NULL THEN list_filter([
  CASE WHEN (j ->> '$.overall_score')::DOUBLE > 100 THEN 'overall_score must be in [0, 100], was ' || (j ->> '$.overall_score') END,
  CASE WHEN (j ->> '$.damages[0].damage_type') NOT IN ({", ".join(repr(x) for x in types)}) THEN 'damages[0].damage_type has unknown value ''' || (j ->> '$.damages[0].damage_type') || '''' END,
  CASE WHEN (j ->> '$.damages[0].part') NOT IN ({", ".join(repr(x) for x in parts)}) THEN 'damages[0].part has unknown value ''' || (j ->> '$.damages[0].part') || '''' END,
  CASE WHEN (j ->> '$.damages[0].action') IS NULL THEN 'damages[0].action is missing' END,
  CASE WHEN (j ->> '$.damages[0].confidence')::DOUBLE > 1 THEN 'damages[0].confidence must be in [0, 1], was ' || (j ->> '$.damages[0].confidence') END,
  CASE WHEN (j ->> '$.damages[0].bounding_box[2]')::DOUBLE > 1 THEN 'damages[0].bounding_box values must be normalized to [0, 1], was [0.25, 0.25, 1.5, 0.25]' END], lambda s: s IS NOT NULL) ELSE [] END AS messages FROM p)
"""


_JUDGED = _judged(DAMAGE_TYPES, PARTS)


@query(_JUDGED + "SELECT event_id, problem, len(messages)::INT AS n, array_to_string(messages, '; ') AS messages FROM m")
def answer_violations(spark: SparkSession, d: str) -> DataFrame:
    return _violations(spark, d, "benchmark")


@query(_judged(GENERAL_DAMAGE_TYPES, GENERAL_PARTS) + "SELECT event_id, problem, len(messages)::INT AS n, array_to_string(messages, '; ') AS messages FROM m")
def general_violations(spark: SparkSession, d: str) -> DataFrame:
    return _violations(spark, d, "general")


def _violations(spark: SparkSession, d: str, profile: str) -> DataFrame:
    judged = validate.judged_answers(views.answers(spark, d).select("event_id", "raw"))
    found = F.when(F.col("problem").isNull(), validate.violations(F.col("answer"), profile)).otherwise(F.array().cast("array<string>"))
    return judged.select("event_id", "problem", F.explode(F.array(found)).alias("m")).select("event_id", "problem", F.size("m").alias("n"), F.array_join("m", "; ").alias("messages"))


@query(
    _JUDGED + """, a AS (SELECT event_id // 3 AS key, event_id % 3 + 1 AS attempt, CASE WHEN problem IS NULL AND len(messages) = 0 THEN 1 END AS ok FROM m)
  SELECT key, CASE WHEN count(ok) > 0 THEN 'success' ELSE 'error' END AS status, coalesce(min(attempt) FILTER (ok = 1), max(attempt)) AS attempts FROM a GROUP BY key"""
)
def attempt_results(spark: SparkSession, d: str) -> DataFrame:
    a = views.answers(spark, d).select(F.expr("event_id div 3").alias("key"), (F.col("event_id") % 3 + 1).alias("attempt"), "raw")
    return validate.first_valid_attempt(a).select("key", "status", "attempts")


# ---------------------------------------------------------------- names, samples, pools

_DAY = "CASE WHEN regexp_matches(stem, '^ID\\d+_\\d{8}_\\d{6}$') THEN 'date:' || regexp_extract(stem, '^ID\\d+_(\\d{8})_', 1) WHEN regexp_matches(stem, '^ID\\d+_\\d{13}$') THEN 'date:' || strftime(epoch_ms(regexp_extract(stem, '_(\\d{13})$', 1)::BIGINT), '%Y%m%d') ELSE 'file:' || stem END"
_NAMES = "(SELECT DISTINCT file_name, regexp_replace(file_name, '(.)\\.[^./\\\\]*$', '\\1') AS stem FROM test_examples WHERE file_name IS NOT NULL)"


@query(f"SELECT file_name, {_DAY} AS session FROM {_NAMES}")
def session_days(spark: SparkSession, d: str) -> DataFrame:
    names = read(spark, d, "test_examples").select("file_name").filter("file_name IS NOT NULL").distinct()
    return names.select("file_name", text.session_day(F.col("file_name")).alias("session"))


_RULES = " ".join(f"WHEN contains(n, '{k}') THEN '{t}'" for k, t in text.PART_RULES)


@query(f"SELECT name, CASE {_RULES} ELSE 'other' END AS part, m AS n FROM (SELECT name, replace(lower(name), '_', ' ') AS n, count(*) AS m FROM (SELECT regexp_extract(comment, 'suggested part ([a-z_]+),', 1) AS name FROM labels_test_b) WHERE name <> '' GROUP BY ALL)")
def mapped_parts(spark: SparkSession, d: str) -> DataFrame:
    names = read(spark, d, "labels_test_b").select(F.regexp_extract("comment", "suggested part ([a-z_]+),", 1).alias("name")).filter("name <> ''")
    return names.groupBy("name").agg(F.count("*").alias("n")).select("name", text.map_name(F.col("name"), text.PART_RULES, "other").alias("part"), "n")


def _sample_sql() -> str:
    steps = ["c AS (SELECT DISTINCT class_selected_for AS class, image_id FROM test_examples WHERE class_selected_for IS NOT NULL)"]
    for i, c in enumerate(DAMAGE_TYPES):
        used = " AND ".join(f"image_id NOT IN (SELECT image_id FROM s{k})" for k in range(i)) or "true"
        steps.append(f"s{i} AS (SELECT class, image_id FROM c WHERE class = '{c}' AND {used} ORDER BY md5('42|' || class || '|' || image_id), image_id LIMIT 6)")
    return "WITH " + ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(len(DAMAGE_TYPES)))


@query(_sample_sql())
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    candidates = read(spark, d, "test_examples").filter("class_selected_for IS NOT NULL").select(F.col("class_selected_for").alias("class"), "image_id")
    return sampling.stratified_sample(candidates, DAMAGE_TYPES, 6, 42)


@query(
    f"""WITH RECURSIVE g AS (SELECT {_DAY} AS key, count(*) AS n FROM {_NAMES} GROUP BY ALL), o AS (SELECT key, n, row_number() OVER (ORDER BY md5('42|' || key), key) AS rn, sum(n) OVER ()::BIGINT AS total FROM g),
  w(rn, key, pool, dev, test) AS (
    SELECT 0::BIGINT, '', '', 0::BIGINT, 0::BIGINT
    UNION ALL
    SELECT o.rn, o.key, CASE WHEN 0.5 * total - dev >= 0.5 * total - test THEN 'dev' ELSE 'test' END, CASE WHEN dev <= test THEN dev + n ELSE dev END, CASE WHEN dev <= test THEN test ELSE test + n END
    FROM w JOIN o ON o.rn = w.rn + 1)
  SELECT key, pool FROM w WHERE rn > 0"""
)
def day_pools(spark: SparkSession, d: str) -> DataFrame:
    names = read(spark, d, "test_examples").select("file_name").filter("file_name IS NOT NULL").distinct()
    groups = names.groupBy(text.session_day(F.col("file_name")).alias("key")).agg(F.count("*").alias("n"))
    return sampling.split_days(groups, 0.5, 42)


@query("SELECT d.damage_type, count(DISTINCT image_id) AS images FROM " + _values(DAMAGE_TYPES, "damage_type") + " LEFT JOIN test_examples ON class_selected_for = d.damage_type GROUP BY d.damage_type")
def images_per_class(spark: SparkSession, d: str) -> DataFrame:
    return sampling.per_class_images(read(spark, d, "test_examples").withColumnRenamed("class_selected_for", "damage_type"), DAMAGE_TYPES)


@query("SELECT DISTINCT l.image_id, l.annotation_id, CASE WHEN e.image_id IS NULL THEN 'train' ELSE 'val' END AS split FROM labels_test_b l LEFT JOIN (SELECT DISTINCT image_id FROM disagreements_test) e ON e.image_id = l.image_id")
def train_or_val(spark: SparkSession, d: str) -> DataFrame:
    pool = read(spark, d, "labels_test_b").select("image_id", "annotation_id").distinct()
    return sampling.train_or_val(pool, read(spark, d, "disagreements_test"), "image_id")


@query(
    """WITH ann AS (SELECT annotation_id, min(image_id) AS image_id, min(damage_type) AS damage_type FROM labels_test_b GROUP BY annotation_id),
  expected AS (SELECT ann.* FROM ann WHERE image_id IN (SELECT image_id FROM test_examples)),
  sheet AS (SELECT DISTINCT annotation_id, damage_type, lower(trim(part)) AS part, lower(trim(severity)) AS severity, lower(trim(action)) AS action FROM labels_test_b WHERE annotator = 'b00'
    QUALIFY row_number() OVER (PARTITION BY annotation_id ORDER BY labeled_at DESC, loaded_at DESC) = 1),
  both_ AS (SELECT coalesce(e.annotation_id, s.annotation_id) AS annotation_id, e.damage_type AS t, s.damage_type AS d, s.part, s.severity, s.action FROM expected e FULL JOIN sheet s ON e.annotation_id = s.annotation_id)
  SELECT annotation_id, unnest(list_filter([CASE WHEN t IS NOT NULL AND d IS NULL THEN 'has no row in the labeling sheet' END, CASE WHEN t IS NULL THEN 'does not belong to the selected images' END,
    CASE WHEN d <> t THEN 'damage_type differs from the dataset' END, """
    + ", ".join(f"CASE WHEN t IS NOT NULL AND d IS NOT NULL AND coalesce({f} NOT IN ({', '.join(repr(v) for v in vs)}), true) THEN '{f} is not allowed' END" for f, vs in LABEL_FIELDS.items())
    + "], lambda s: s IS NOT NULL)) AS error FROM both_"
)
def sheet_errors(spark: SparkSession, d: str) -> DataFrame:
    labels = read(spark, d, "labels_test_b")
    annotations = labels.groupBy("annotation_id").agg(F.min("image_id").alias("image_id"), F.min("damage_type").alias("damage_type"))
    own = labels.filter("annotator = 'b00'")
    last = sampling.newest_per_key(own, ["annotation_id"], [F.desc("labeled_at"), F.desc("loaded_at")])
    sheet = last.select("annotation_id", "damage_type", *[F.lower(F.trim(f)).alias(f) for f in LABEL_FIELDS])
    errors = conversion.integrity_errors(annotations, read(spark, d, "test_examples"), sheet)
    return errors.filter("error <> 'image is not in the annotation file'")


@query(None)
def sheet_errors_of_all(spark: SparkSession, d: str) -> DataFrame:
    """(annotator, annotation_id, error): every kind of error in the sheet of every annotator; an image without annotations stands with its image_id, once for each."""
    labels = read(spark, d, "labels_test_b")
    annotations = labels.groupBy("annotation_id").agg(F.min("image_id").alias("image_id"), F.min("damage_type").alias("damage_type"))
    last = sampling.newest_per_key(labels.filter("annotator IS NOT NULL"), ["annotator", "annotation_id"], [F.desc("labeled_at"), F.desc("loaded_at")])
    sheets = last.select("annotator", "annotation_id", "damage_type", *[F.lower(F.trim(f)).alias(f) for f in LABEL_FIELDS])
    return conversion.integrity_errors_by(annotations, read(spark, d, "test_examples"), sheets, "annotator")


# ---------------------------------------------------------------- history


def _history(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = read(spark, d, "events")
    inspections = e.select(F.col("event_id").alias("inspection_id"), "user_id", F.col("ts").alias("created_at"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") - 150).alias("before_id"))
    photos = e.select(F.col("event_id").alias("inspection_id"), (F.col("event_id") % 4).alias("idx"), F.col("props").alias("damages_json"))
    corrections = e.filter("event_type = 'click'").select(F.expr("event_id div 2").alias("inspection_id"), F.expr("event_id div 2 % 4").alias("idx"), F.col("event_id").alias("seq"), F.concat(F.lit("c"), F.col("event_id")).alias("after_json"))
    return inspections, photos, corrections


@query("SELECT event_id AS inspection_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50")
def kept_inspections(spark: SparkSession, d: str) -> DataFrame:
    return store.keep_newest(_history(spark, d)[0], "user_id", 50).select("inspection_id", "user_id")


@query("SELECT event_id AS inspection_id, event_id IN (SELECT event_id - 150 FROM events WHERE event_id % 3 = 0) AS has_return FROM events")
def returned_inspections(spark: SparkSession, d: str) -> DataFrame:
    return store.with_return(_history(spark, d)[0]).select("inspection_id", "has_return")


_CORRECTIONS = "WITH c AS (SELECT event_id // 2 AS inspection_id, (event_id // 2) % 4 AS idx, event_id AS seq, 'c' || event_id AS after_json FROM events WHERE event_type = 'click') "


@query(
    _CORRECTIONS + "SELECT event_id AS inspection_id, event_id % 4 AS idx, coalesce(arg_max(after_json, seq), any_value(props)) AS damages, count(seq) AS n_corrections FROM events LEFT JOIN c ON c.inspection_id = event_id AND c.idx = event_id % 4 GROUP BY event_id"
)
def current_damages(spark: SparkSession, d: str) -> DataFrame:
    _, photos, corrections = _history(spark, d)
    return store.effective_damages(photos, corrections).select("inspection_id", "idx", "damages", "n_corrections")


@query(_CORRECTIONS + "SELECT c.inspection_id, c.idx, seq, coalesce(lag(after_json) OVER (PARTITION BY c.inspection_id, c.idx ORDER BY seq), props) AS before_json, after_json FROM c LEFT JOIN events ON event_id = c.inspection_id AND event_id % 4 = c.idx")
def correction_log(spark: SparkSession, d: str) -> DataFrame:
    _, photos, corrections = _history(spark, d)
    return store.correction_log(photos, corrections).select("inspection_id", "idx", "seq", "before_json", "after_json")


@query(
    "WITH gone AS (SELECT event_id AS g FROM events WHERE event_type = 'error') SELECT event_id AS inspection_id, CASE WHEN event_id % 3 = 0 AND event_id - 150 NOT IN (SELECT g FROM gone) THEN (event_id - 150)::VARCHAR END AS before_id FROM events WHERE event_id NOT IN (SELECT g FROM gone)"
)
def after_deletion(spark: SparkSession, d: str) -> DataFrame:
    inspections, photos, corrections = _history(spark, d)
    gone = read(spark, d, "events").filter("event_type = 'error'").select(F.col("event_id").alias("inspection_id"))
    return store.delete_inspections(gone, inspections, photos, corrections)["inspections"].select("inspection_id", F.col("before_id").cast("string").alias("before_id"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def resumed_plan(spark: SparkSession, d: str) -> DataFrame:
    answered = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return store.not_answered(read(spark, d, "orders").select("o_orderkey"), answered, "o_orderkey")


# ---------------------------------------------------------------- state and windows

_REQUESTS = '''SELECT event_id, user_id, epoch(ts)::BIGINT AS "at", (1 + event_id % 2)::INT AS units FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events)'''


@query(
    f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "at", event_id) AS rn FROM ({_REQUESTS})),
  w(user_id, rn, taken, event_id, "at", units, admitted) AS (
    SELECT DISTINCT user_id, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::INT, NULL::BOOLEAN FROM r
    UNION ALL
    SELECT r.user_id, r.rn, CASE WHEN len(live) + r.units <= 5 THEN list_concat(live, list_transform(range(r.units), lambda i: r."at")) ELSE live END, r.event_id, r."at", r.units, len(live) + r.units <= 5
    FROM (SELECT w.user_id, w.rn, n."at" AS now, list_filter(w.taken, lambda t: t > n."at" - 86400) AS live FROM w JOIN r n ON n.user_id = w.user_id AND n.rn = w.rn + 1) x
    JOIN r ON r.user_id = x.user_id AND r.rn = x.rn + 1)
  SELECT event_id, user_id, "at", units, admitted FROM w WHERE rn > 0"""
)
def admitted_requests(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    at = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', date_trunc('SECOND', ts))")
    return limiter.admit_batch(e.select("event_id", "user_id", at.alias("at"), (1 + F.col("event_id") % 2).cast("int").alias("units")), 5, 86400)


@query("SELECT strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    t = windows.tumbling_counts(read(spark, d, "events"), "6 hours")
    return t.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", _r("total", 6))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '4 hours' THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, sum(first) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, n, count(*) AS sessions FROM (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL) GROUP BY ALL"""
)
def session_sizes(spark: SparkSession, d: str) -> DataFrame:
    return windows.sessions(read(spark, d, "events"), "4 hours").groupBy("user_id", "n").agg(F.count("*").alias("sessions"))


@query(
    """WITH o AS (SELECT user_id AS key, ts, event_type, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type) <= INTERVAL '3 hours' THEN 0 ELSE 1 END AS fresh FROM events),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY ts, event_type ROWS UNBOUNDED PRECEDING) AS s FROM o)
  SELECT key::VARCHAR AS key, arg_max(event_type, (ts, event_type)) AS value, epoch_us(min(ts)) AS first_at, epoch_us(max(ts)) AS last_at, count(*) AS n FROM s GROUP BY key, s"""
)
def key_stretches(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user before a pause of more than three hours."""
    e = read(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("ts").alias("at"), F.col("event_type").alias("value"))
    return keyed.stretches_batch(e, 3 * 3600).select("key", "value", F.unix_micros("first_at").alias("first_at"), F.unix_micros("last_at").alias("last_at"), "n")


@query("SELECT DISTINCT damage_type AS class, image_id FROM labels_test_b WHERE image_id IS NOT NULL AND damage_type IN ('glass_shatter', 'lamp_broken', 'crack')")
def class_images(spark: SparkSession, d: str) -> DataFrame:
    """The images of each category; scratches have no category here."""
    categories = spark.createDataFrame([(i, t) for i, t in enumerate(DAMAGE_TYPES[:3])], "id int, name string")
    ids = F.create_map(*[F.lit(x) for i, t in enumerate(DAMAGE_TYPES) for x in (t, i)])
    return sampling.images_by_class(read(spark, d, "labels_test_b").select("image_id", F.try_element_at(ids, F.col("damage_type")).alias("category_id")), categories)


@query("SELECT event_id AS inspection_id, event_id % 4 AS idx, (props ->> '$.k')::INT AS k FROM events WHERE user_id = (SELECT min(user_id) FROM events)")
def photos_of_user(spark: SparkSession, d: str) -> DataFrame:
    """The photos of one user's inspections with their JSON decoded."""
    inspections, photos, _ = _history(spark, d)
    user = inspections.agg(F.min("user_id")).first()[0]
    own = store.find(inspections, "user_id", user).select("inspection_id")
    return store.decoded_photos(photos.join(own, "inspection_id", "left_semi"), {"damages_json": "k int"}).select("inspection_id", "idx", "damages_json.k")


@query("SELECT event_id AS inspection_id, user_id, row_number() OVER (ORDER BY ts, event_id) + 7 AS seq FROM events")
def numbered_inspections(spark: SparkSession, d: str) -> DataFrame:
    return store.new_inspections(_history(spark, d)[0].drop("seq"), 7).select("inspection_id", "user_id", "seq")


# ---------------------------------------------------------------- relational floor, beyond the operators of evaluation


@query(
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"
)
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").filter("l_shipdate <= TIMESTAMP_NTZ'1998-09-02 00:00:00'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query(
    "SELECT r_name, n_name, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)"
)
def regional_rollup(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.join(n, F.col("c_nationkey") == F.col("n_nationkey")).rollup("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def status_cube(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query(
    "SELECT o_custkey, o_orderkey, o_totalprice, rank() OVER w AS rank, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC) QUALIFY rank() OVER w <= 3"
)
def top_orders(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey")
    ranked = read(spark, d, "orders").withColumn("running", F.round(F.sum("o_totalprice").over(w.orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)), 2))
    return ranked.withColumn("rank", F.rank().over(w.orderBy(F.desc("o_totalprice")))).filter("rank <= 3").select("o_custkey", "o_orderkey", "o_totalprice", F.col("rank").cast("long").alias("rank"), "running")


@query("SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def never_returned(spark: SparkSession, d: str) -> DataFrame:
    """The orders with items of which none came back."""
    li = read(spark, d, "lineitem")
    sold = read(spark, d, "orders").select(F.col("o_orderkey").alias("k")).intersect(li.select("l_orderkey"))
    return sold.subtract(li.filter("l_returnflag = 'R'").select("l_orderkey"))


# ---------------------------------------------------------------- runs


@query(
    """WITH im AS (SELECT doc_id, unnest(images) AS i FROM (SELECT DISTINCT doc_id, images FROM gt_dev)), s AS (SELECT doc_id, i.image_id AS image_id, i.width AS w, i.height AS h, greatest(i.width, i.height) AS m FROM im WHERE i IS NOT NULL)
  SELECT doc_id, image_id, m > 1568 AS resized, CASE WHEN m > 1568 THEN greatest(1, floor(w * (1568.0::DOUBLE / m) + 0.5))::INT ELSE w END AS width, CASE WHEN m > 1568 THEN greatest(1, floor(h * (1568.0::DOUBLE / m) + 0.5))::INT ELSE h END AS height
  FROM s WHERE w IS NOT NULL AND h IS NOT NULL"""
)
def sent_sizes(spark: SparkSession, d: str) -> DataFrame:
    images = read(spark, d, "gt_dev").select("doc_id", "images").distinct().select("doc_id", F.explode("images").alias("i")).filter("i.width IS NOT NULL AND i.height IS NOT NULL")
    return images.select("doc_id", "i.image_id", runs.sent_size(F.col("i.width"), F.col("i.height"), F.lit(0)).alias("s")).select("doc_id", "image_id", "s.*")


@query(
    """WITH first AS (SELECT image_id, arg_min(file_name, (selected_at, file_name)) AS file_name FROM test_examples WHERE file_name IS NOT NULL GROUP BY image_id), f AS (SELECT file_name, max(annotation_id) * 30000 AS size FROM labels_test_b GROUP BY file_name)
  SELECT image_id, file_name, CASE WHEN size IS NULL THEN 'missing' WHEN lower(regexp_extract(file_name, '\\.([^.]*)$', 1)) NOT IN ('jpg', 'jpeg', 'png') THEN 'type' WHEN size > 40 * 1024 * 1024 THEN 'size' END AS problem FROM first LEFT JOIN f USING (file_name)"""
)
def checked_images(spark: SparkSession, d: str) -> DataFrame:
    plan = read(spark, d, "test_examples").filter("file_name IS NOT NULL").select("image_id", "file_name", F.col("selected_at").alias("position"))
    files = read(spark, d, "labels_test_b").groupBy("file_name").agg((F.max("annotation_id") * 30000).alias("size"))
    return runs.check_images(plan, files).select("image_id", "file_name", "problem")


@query(PAIRS + "SELECT status = 'missing' AS missing, count(*) AS answers, count(*) FILTER (status <> 'success') AS errors FROM images GROUP BY ALL")
def answer_summary(spark: SparkSession, d: str) -> DataFrame:
    images, _, _ = views.evaluation(spark, d)
    return runs.summary(images.withColumn("missing", F.col("status") == "missing"), ["missing"])
