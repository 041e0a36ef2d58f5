"""Evaluation tables derived from the star schema, in Spark and as common table expressions of SQL.

Every value is integer arithmetic on keys, written the same way on both sides,
so that doubles agree to the last bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxmeter.operators import evaluate
from boxmeter.schemas import LABEL_FIELDS, PARTS


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _text(template: str, spark: bool) -> str:
    return template.replace("DIV", "div" if spark else "//").replace("AT(", "element_at(array(" if spark else "list_extract([").replace("]]", "), " if spark else "], ")


_PARTS = ", ".join(f"'{p}'" for p in PARTS)

BOXES = f"""
  SELECT image_id, k, k % 2 AS is_pred, CAST(m * 37 % 4 * 15 AS DOUBLE) / 100 AS x, CAST(m * 53 % 4 * 15 AS DOUBLE) / 100 AS y,
         CAST(30 + k * 7 % 20 AS DOUBLE) / 100 AS w, CAST(30 + k * 11 % 20 AS DOUBLE) / 100 AS h, CAST(k * 7919 % 1000 AS DOUBLE) / 1000 AS confidence,
         CASE left(o_orderpriority, 1) WHEN '1' THEN 'glass_shatter' WHEN '2' THEN 'lamp_broken' WHEN '3' THEN 'crack' ELSE 'scratch' END AS damage_type,
         CASE o_orderstatus WHEN 'F' THEN 'minor' WHEN 'O' THEN 'moderate' ELSE 'severe' END AS severity,
         AT({_PARTS}]] CAST(k % 10 + 1 AS INT)) AS part, CASE WHEN k % 3 = 0 THEN 'replacement' ELSE 'repair' END AS action,
         CASE image_id % 10 WHEN 3 THEN 'error' WHEN 7 THEN 'missing' ELSE 'success' END AS status
  FROM (SELECT o_custkey AS image_id, o_orderkey AS k, o_orderkey DIV 2 AS m, o_orderpriority, o_orderstatus FROM ORDERS)
"""


def boxes(spark: SparkSession, d: str) -> DataFrame:
    sql = _text(BOXES, True).replace("ORDERS", "{orders}")
    return spark.sql(sql, orders=read(spark, d, "orders")).withColumn("box", F.array("x", "y", "w", "h")).withColumn("idx", F.col("k"))


def evaluation(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, gt, pred."""
    b = boxes(spark, d)
    images = b.groupBy("image_id").agg(F.min("status").alias("status")).withColumn("position", F.col("image_id"))
    columns = ["image_id", "idx", "box", "damage_type", "severity", "part", "action"]
    return images, b.filter("is_pred = 0").select(*columns), b.filter("is_pred = 1").select(*columns, "confidence")


def parts(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.parts(*evaluation(spark, d))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.pairs_of(parts(spark, d))


#: gt, pred (of successful images), images and pairs of the greedy matching as a recursion over ranked predictions.
PAIRS = f"""
WITH RECURSIVE box AS ({_text(BOXES, False).replace("ORDERS", "orders")}),
images AS (SELECT image_id, min(status) AS status FROM box GROUP BY image_id),
gt AS (SELECT * FROM box WHERE is_pred = 0),
pred AS (SELECT * FROM box WHERE is_pred = 1 AND status = 'success'),
over AS (
  SELECT p.image_id, p.k AS pk, g.k AS gk, p.w * p.h AS pa, g.w * g.h AS ga,
         greatest(0.0, least(g.x + g.w, p.x + p.w) - greatest(g.x, p.x)) * greatest(0.0, least(g.y + g.h, p.y + p.h) - greatest(g.y, p.y)) AS inter
  FROM pred p JOIN gt g USING (image_id)
),
cand AS (SELECT image_id, pk, gk, inter / (ga + pa - inter) AS iou FROM over WHERE inter / (ga + pa - inter) >= 0.5),
ranked AS (SELECT image_id, k, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, k) AS rn FROM pred),
walk(image_id, rn, used, gk, pk, iou) AS (
  SELECT DISTINCT image_id, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE FROM ranked
  UNION ALL
  SELECT w.image_id, w.rn + 1, CASE WHEN b.gk IS NULL THEN w.used ELSE list_append(w.used, b.gk) END, b.gk, r.k, b.iou
  FROM walk w JOIN ranked r ON r.image_id = w.image_id AND r.rn = w.rn + 1
  LEFT JOIN LATERAL (SELECT arg_min(c.gk, (-c.iou, c.gk)) AS gk, max(c.iou) AS iou FROM cand c WHERE c.pk = r.k AND NOT list_contains(w.used, c.gk)) b ON true
),
pairs AS (
  SELECT w.image_id, w.gk, w.pk, w.iou, p.confidence, g.damage_type AS gt_type, p.damage_type AS p_type, g.severity AS gs, p.severity AS ps,
         g.part AS gp, p.part AS pp, g.action AS ga, p.action AS pa
  FROM walk w JOIN gt g ON g.k = w.gk JOIN pred p ON p.k = w.pk WHERE w.gk IS NOT NULL
)
"""


def labels(spark: SparkSession, d: str) -> DataFrame:
    """item, rater, field, value: the latest labelling of each item by each annotator; words outside the enumerations are empty."""
    raw = read(spark, d, "labels_test_b")
    columns = [_clean_word(f).alias(f) for f in LABEL_FIELDS]
    latest = raw.filter("annotation_id IS NOT NULL AND annotator IS NOT NULL").groupBy("annotation_id", "annotator").agg(F.max(F.struct("labeled_at", "loaded_at", *columns)).alias("r"))
    fields = [F.struct(F.lit(f).alias("field"), F.col(f"r.{f}").alias("value")) for f in LABEL_FIELDS]
    return latest.select(F.col("annotation_id").alias("item"), F.col("annotator").alias("rater"), F.explode(F.array(*fields)).alias("x")).select("item", "rater", "x.field", "x.value")


def _clean_word(f: str):
    w = F.lower(F.trim(F.col(f)))
    return F.when(w.isin(LABEL_FIELDS[f]), w).otherwise("")


LABELS = """
WITH latest AS (
  SELECT annotation_id AS item, annotator AS rater, {cleaned} FROM labels_test_b
  QUALIFY row_number() OVER (PARTITION BY annotation_id, annotator ORDER BY labeled_at DESC, loaded_at DESC, {order}) = 1
), labels AS (
  {union}
)
""".format(
    cleaned=", ".join(f"CASE WHEN lower(trim({f})) IN ({', '.join(repr(v) for v in vs)}) THEN lower(trim({f})) ELSE '' END AS c_{f}" for f, vs in LABEL_FIELDS.items()),
    order=", ".join(f"c_{f} DESC" for f in LABEL_FIELDS),
    union=" UNION ALL ".join(f"SELECT item, rater, '{f}' AS field, c_{f} AS value FROM latest" for f in LABEL_FIELDS),
)

#: Answers of every kind about events: plain, fenced, prose, broken and out of range.
ANSWERS = """
  SELECT event_id, CASE event_id % 5
    WHEN 0 THEN body WHEN 1 THEN concat('```json', chr(10), body, chr(10), '```') WHEN 2 THEN concat('Here is what I see: ', event_type)
    WHEN 3 THEN left(body, length(body) - 3) ELSE replace(body, '0.5', '1.5') END AS raw
  FROM (SELECT event_id, event_type, concat('{"damages": [{"damage_type": "', CASE event_id % 3 WHEN 0 THEN 'crack' WHEN 1 THEN 'scratch' ELSE 'dent' END,
    '", "part": "', CASE event_id % 4 WHEN 0 THEN 'hood' WHEN 1 THEN 'door' WHEN 2 THEN 'roof' ELSE 'light' END,
    '", "severity": "minor", ', CASE WHEN event_id % 7 = 0 THEN '' ELSE '"action": "repair", ' END,
    '"confidence": 0.5, "bounding_box": [0.25, 0.25, 0.5, 0.25]}], "overall_score": ', CASE WHEN event_id % 11 = 0 THEN '150.5' ELSE '40.5' END, '}') AS body FROM EVENTS)
"""


def answers(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(ANSWERS.replace("{", "{{").replace("}", "}}").replace("EVENTS", "{events}"), events=read(spark, d, "events"))


#: Damages on photos of users before and after the middle of the month.
PHOTOS = """
  SELECT event_id, CASE WHEN ts < CAST('2024-01-16 00:00:00' AS TIMESTAMP) THEN 0 ELSE 1 END AS late, event_type AS view,
         AT('glass_shatter', 'lamp_broken', 'crack', 'scratch']] CAST(user_id % 4 + 1 AS INT)) AS damage_type, CAST(user_id % 10 AS INT) AS part,
         CAST(event_id * 37 % 100 AS DOUBLE) / 100 AS cx, CAST(event_id * 53 % 100 AS DOUBLE) / 100 AS cy
  FROM EVENTS
"""


def photos(spark: SparkSession, d: str) -> DataFrame:
    sql = _text(PHOTOS, True).replace("AS TIMESTAMP", "AS TIMESTAMP_NTZ").replace("EVENTS", "{events}")
    return spark.sql(sql, events=read(spark, d, "events"))


PHOTOS_SQL = _text(PHOTOS, False).replace("EVENTS", "events")
ANSWERS_SQL = ANSWERS.replace("EVENTS", "events")
