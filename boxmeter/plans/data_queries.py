"""Queries of the general data problems over the tables of a data folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxmeter.operators import badrows, drift, structure
from boxmeter.schemas import ENUMS


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _flat(spark: SparkSession, d: str, *kinds: str) -> dict[str, DataFrame]:
    as_json = lambda *columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    gt = _read(spark, d, "gt_dev").select("doc_id", as_json("meta", "images").alias("content"), as_json("images").alias("images"))
    return {
        "gt": structure.flat_tables(gt, "doc_id", "content", kinds, "images"),
        "pred": structure.flat_tables(_read(spark, d, "predictions_dev_v3"), "run_id", "content", kinds),
    }


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    flat = {src: structure.damage_places(t).select(F.lit(src).alias("src"), "*") for src, t in _flat(spark, d, "place").items()}
    return flat["gt"].unionByName(flat["pred"])


def _table(spark: SparkSession, d: str, kind: str, columns: list[str]) -> DataFrame:
    flat = {src: t.filter(F.col("kind") == kind).select(F.lit(src).alias("src"), *columns) for src, t in _flat(spark, d, kind).items()}
    return flat["gt"].unionByName(flat["pred"])


def p2_documents(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "document", ["doc_id", "meta"])


def p2_images(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "image", ["doc_id", "image_no", "image_id", *structure._IMAGE_FIELDS])


def p2_damages(spark: SparkSession, d: str) -> DataFrame:
    columns = ["doc_id", "image_no", "image_id", "damage_no", "annotation_id", "damage_type", "part", "severity", "action", "confidence", "description"]
    return _table(spark, d, "damage", columns)


def p2_boxes(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "box", ["doc_id", "image_no", "image_id", "damage_no", "box_no", "number"])


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """Every value of both whole tables, all members of documents, images and damages included, linked to its parent."""
    as_json = lambda *columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    gt = _read(spark, d, "gt_dev")
    members = [c for c in gt.columns if c != "doc_id"]
    whole = gt.select("doc_id", as_json(*members).alias("content"), as_json("images").alias("images"))
    values = {
        "gt": structure.whole_values(whole, "doc_id", "content", "images"),
        "pred": structure.whole_values(_read(spark, d, "predictions_dev_v3"), "run_id", "content"),
    }
    return values["gt"].select(F.lit("gt").alias("src"), "*").unionByName(values["pred"].select(F.lit("pred").alias("src"), "*"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return badrows.rejected(badrows.parse_lines(_read(spark, d, "label_lines"))).select("sheet", "line_no", "reason")


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The typed label rows of the lines that parse."""
    return badrows.loaded(badrows.parse_lines(_read(spark, d, "label_lines")))


def p3_edits(spark: SparkSession, d: str) -> DataFrame:
    """The failed lines with the cheapest mend, lines of any length."""
    return badrows.rejected(badrows.parse_lines(_read(spark, d, "label_lines"), None))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(drift.meta_fields(_read(spark, d, "predictions_dev_v3")))


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    """The meta objects of all files with the same columns and types."""
    files = drift.cut(drift.meta_fields(_read(spark, d, "predictions_dev_v3")))
    return drift.unified(files, drift.canonical_names(files, drift.changes(files)))


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_documents, p2_images, p2_damages, p2_boxes, p2_values, p3_found, p3_loaded, p3_edits, p5_found, p5_table)}


def _enum(c: str, empty: bool) -> str:
    words = ", ".join(f"'{w}'" for w in ENUMS[c] + ([""] if empty else []))
    return f"{c} IN ({words})"


_CELL = '(?:"(?:[^"]|"")*"|[^"SEP]*)'
_NAMES = "image_id file_name annotation_id damage_type bbox_x bbox_y bbox_w bbox_h part severity action comment".split()


def _by_sep(pattern: str) -> str:
    return f"CASE WHEN sep = ';' THEN {pattern.replace('SEP', ';')} ELSE {pattern.replace('SEP', ',')} END"


_LINES = f"""
WITH seps AS (
  SELECT sheet, min(CASE WHEN length(raw) - length(replace(raw, ';', '')) >= length(raw) - length(replace(raw, ',', '')) THEN ';' ELSE ',' END) AS sep
  FROM label_lines WHERE line_no = 1 GROUP BY sheet
), lines AS (
  SELECT DISTINCT sheet, line_no, raw, coalesce(sep, ';') AS sep FROM label_lines LEFT JOIN seps USING (sheet)
  WHERE regexp_matches(raw, '[^ \\s]') AND lower(replace(replace(raw, chr(65279), ''), ',', ';')) <> '{";".join(_NAMES)}'
), cells AS (
  SELECT *, {_by_sep(f"regexp_full_match(raw, '{_CELL}(?:SEP{_CELL})*', 's')")} AS whole,
         {_by_sep(f"regexp_extract_all('SEP' || raw, 'SEP({_CELL})', 1, 's')")} AS cell
  FROM lines
), named AS (
  SELECT sheet, line_no, whole, len(cell) AS n, {", ".join(f"trim(CASE WHEN cell[{i + 1}] LIKE '\"%' THEN replace(cell[{i + 1}][2:-2], '\"\"', '\"') ELSE cell[{i + 1}] END, ' ') AS {c}" for i, c in enumerate(_NAMES))}
  FROM cells
), judged AS (
  SELECT *, CASE WHEN NOT whole THEN 'quoting' WHEN n <> 12 THEN 'columns'
    WHEN regexp_full_match(image_id, '0*[1-9][0-9]*') AND regexp_full_match(annotation_id, '0*[1-9][0-9]*')
     AND {" AND ".join(f"regexp_full_match({c}, '[0-9]+([.][0-9]+)?')" for c in _NAMES[4:8])}
     AND try_cast(bbox_w AS DOUBLE) > 0 AND try_cast(bbox_h AS DOUBLE) > 0
     AND {_enum("damage_type", False)} AND {_enum("part", True)} AND {_enum("severity", True)} AND {_enum("action", True)} THEN NULL
    ELSE 'value' END AS reason
  FROM named
)
"""

_P2 = """
WITH gt AS (
  SELECT DISTINCT doc_id, unnest(images) AS im FROM gt_dev
), gt_rows AS (
  SELECT 'gt' AS src, doc_id, im.image_id AS image_id,
         unnest(CASE WHEN len(list_filter(im.damages, lambda x: x IS NOT NULL)) > 0
                     THEN list_filter(range(len(im.damages)), lambda i: im.damages[i + 1] IS NOT NULL) ELSE [-1] END) AS damage_no
  FROM gt WHERE im IS NOT NULL
), files AS (
  SELECT DISTINCT run_id, content::JSON AS j FROM predictions_dev_v3 WHERE json_valid(content)
), entries AS (
  SELECT run_id, k AS image_id, json_extract(j, '$.predictions."' || k || '"') AS e
  FROM (SELECT run_id, j, unnest(json_keys(j, '$.predictions')) AS k FROM files WHERE json_type(j, '$.predictions') = 'OBJECT')
  UNION ALL
  SELECT run_id, coalesce(e ->> '$.image_id', e ->> '$.image.image_id'), coalesce(json_extract(e, '$.result'), e)
  FROM (SELECT run_id, unnest(json_extract(j, '$.predictions[*]')) AS e FROM files WHERE json_type(j, '$.predictions') = 'ARRAY')
), listed AS (
  SELECT run_id, image_id, CASE WHEN json_type(e, '$.damages') = 'VARCHAR' THEN try_cast(e ->> '$.damages' AS JSON) ELSE json_extract(e, '$.damages') END AS d
  FROM entries WHERE json_type(e) = 'OBJECT'
), parts AS (
  SELECT run_id, image_id, CASE json_type(d)
    WHEN 'ARRAY' THEN json_extract(d, '$[*]')
    WHEN 'OBJECT' THEN CASE WHEN json_exists(d, '$."0"') THEN list_transform(json_keys(d), lambda k: json_extract(d, '$."' || k || '"')) WHEN len(json_keys(d)) > 0 THEN [d] ELSE [] END
    ELSE [] END AS parts
  FROM listed
), pred_rows AS (
  SELECT 'pred' AS src, run_id AS doc_id, image_id,
         unnest(CASE WHEN len(list_filter(parts, lambda x: json_type(x) = 'OBJECT')) > 0
                     THEN list_filter(range(len(parts)), lambda i: json_type(parts[i + 1]) = 'OBJECT') ELSE [-1] END) AS damage_no
  FROM parts
)
SELECT DISTINCT src, doc_id, image_id, damage_no::BIGINT AS damage_no FROM gt_rows
UNION ALL SELECT DISTINCT src, doc_id, image_id, damage_no::BIGINT FROM pred_rows
"""


_ENTRIES = """
WITH gt AS (
  SELECT doc_id, images, unnest(range(len(images))) AS image_no FROM (SELECT DISTINCT doc_id, images FROM gt_dev)
), gt_images AS (
  SELECT doc_id, image_no, images[image_no + 1] AS im FROM gt WHERE images[image_no + 1] IS NOT NULL
), gt_damages AS (
  SELECT doc_id, image_no, im.image_id AS image_id, damage_no, im.damages[damage_no + 1] AS d
  FROM (SELECT *, unnest(range(len(im.damages))) AS damage_no FROM gt_images) WHERE im.damages[damage_no + 1] IS NOT NULL
), files AS (
  SELECT run_id, any_value(content)::JSON AS j FROM (SELECT DISTINCT run_id, content FROM predictions_dev_v3 WHERE json_valid(content)) GROUP BY run_id
), entries AS (
  SELECT run_id, image_no, ks[image_no + 1] AS image_id, json_extract(j, '$.predictions."' || ks[image_no + 1] || '"') AS own
  FROM (SELECT run_id, j, json_keys(j, '$.predictions') AS ks, unnest(range(len(json_keys(j, '$.predictions')))) AS image_no FROM files WHERE json_type(j, '$.predictions') = 'OBJECT')
  UNION ALL
  SELECT run_id, image_no, coalesce(own ->> '$.image_id', own ->> '$.image.image_id', own ->> '$.result.image_id'), own
  FROM (SELECT run_id, image_no, json_extract(j, '$.predictions[' || image_no || ']') AS own
        FROM (SELECT run_id, j, unnest(range(json_array_length(j, '$.predictions')::BIGINT)) AS image_no FROM files WHERE json_type(j, '$.predictions') = 'ARRAY'))
), pred_images AS (
  SELECT run_id AS doc_id, image_no, image_id, own, CASE WHEN json_type(own, '$.result') = 'OBJECT' AND json_type(own, '$.damages') IS NULL THEN json_extract(own, '$.result') ELSE own END AS e
  FROM entries WHERE json_type(own) = 'OBJECT'
), listed AS (
  SELECT *, CASE WHEN json_type(e, '$.damages') = 'VARCHAR' THEN try_cast(e ->> '$.damages' AS JSON) ELSE json_extract(e, '$.damages') END AS l FROM pred_images
), lists AS (
  SELECT *, CASE json_type(l) WHEN 'ARRAY' THEN json_extract(l, '$[*]')
    WHEN 'OBJECT' THEN CASE WHEN json_exists(l, '$."0"') THEN list_transform(list_sort(list_transform(json_keys(l), lambda k: k::INT)), lambda k: json_extract(l, '$."' || k || '"')) WHEN len(json_keys(l)) > 0 THEN [l] ELSE [] END ELSE [] END AS parts
  FROM listed
), pred_damages AS (
  SELECT doc_id, image_no, image_id, damage_no, parts[damage_no + 1] AS d FROM (SELECT *, unnest(range(len(parts))) AS damage_no FROM lists) WHERE json_type(parts[damage_no + 1]) = 'OBJECT'
)
"""
_LATER = [c for c in structure._IMAGE_FIELDS if c not in ("file_name", "width", "height")]
_ENTRY_SQL = {
    "p2_images": _ENTRIES
    + "SELECT 'gt' AS src, doc_id, image_no, im.image_id AS image_id, im.file_name AS file_name, im.width::VARCHAR AS width, im.height::VARCHAR AS height, " + ", ".join(f"NULL::VARCHAR AS {c}" for c in _LATER)
    + " FROM gt_images UNION ALL SELECT 'pred', doc_id, image_no, image_id, " + ", ".join(f"coalesce(e ->> '$.{c}', own ->> '$.{c}')" for c in ["file_name", "width", "height", *_LATER]) + " FROM pred_images",
    "p2_damages": _ENTRIES
    + "SELECT 'gt' AS src, doc_id, image_no, image_id, damage_no, d.annotation_id::VARCHAR AS annotation_id, d.damage_type AS damage_type, d.part AS part, d.severity AS severity, d.action AS action, NULL AS confidence, NULL AS description"
    + " FROM gt_damages UNION ALL SELECT 'pred', doc_id, image_no, image_id, damage_no, " + ", ".join(f"d ->> '$.{c}'" for c in ("annotation_id", "damage_type", "part", "severity", "action", "confidence", "description")) + " FROM pred_damages",
    "p2_boxes": _ENTRIES
    + "SELECT 'gt' AS src, doc_id, image_no, image_id, damage_no, box_no, CASE WHEN NOT isnan(d.bbox[box_no + 1]) THEN d.bbox[box_no + 1] END AS number FROM (SELECT *, unnest(range(len(d.bbox))) AS box_no FROM gt_damages) UNION ALL "
    + " UNION ALL ".join(
        f"SELECT 'pred', doc_id, image_no, image_id, damage_no, box_no, CASE WHEN json_type(d, '$.{b}[' || box_no || ']') NOT IN ('VARCHAR', 'NULL', 'OBJECT', 'ARRAY', 'BOOLEAN') THEN (d ->> ('$.{b}[' || box_no || ']'))::DOUBLE END"
        f" FROM (SELECT *, unnest(range(json_array_length(d, '$.{b}')::BIGINT)) AS box_no FROM pred_damages WHERE json_type(d, '$.{b}') = 'ARRAY')" for b in structure._BOX_NAMES
    ),
}


def oracle_sql() -> dict[str, str]:
    kinds = {"image_id": "BIGINT", "annotation_id": "BIGINT"} | {c: "DOUBLE" for c in _NAMES[4:8]}
    typed = ", ".join(f"try_cast(nullif({c}, '') AS {kinds.get(c, 'VARCHAR')}) AS {c}" for c in _NAMES)
    return {
        "p2_found": _P2,
        **_ENTRY_SQL,
        "p3_found": _LINES + "SELECT sheet, line_no, reason FROM judged WHERE reason IS NOT NULL",
        "p3_loaded": _LINES + f"SELECT sheet, line_no, {typed} FROM judged WHERE reason IS NULL",
    }
