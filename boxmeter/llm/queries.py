"""Queries of the llm problems over the tables of a data folder, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxmeter.llm import consensus, cutoff, mixing, splits, tokenizer, truncation
from boxmeter.session import ensure_checkpoint_dir


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    state = splits.assign_splits(splits.links_of_images(_read(spark, d, "test_examples")))
    return splits.groups_of_several(state).select(F.col("record_id").alias("image_id"), "group_id")


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    """The split of every image."""
    state = splits.assign_splits(splits.links_of_images(_read(spark, d, "test_examples")))
    return state.records.select(F.col("record_id").alias("image_id"), "group_id", "split")


def p1_increments(spark: SparkSession, d: str) -> DataFrame:
    """The groups behind two batches through a persisted state: the images by the half of the time they were selected in (null times come first)."""
    images = _read(spark, d, "test_examples")
    middle = images.agg(F.expr("timestampadd(SECOND, timestampdiff(SECOND, min(selected_at), max(selected_at)) div 2, min(selected_at))").alias("m")).first()["m"]
    late = F.coalesce(F.col("selected_at") > F.lit(middle), F.lit(False))
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/splits-{uuid.uuid4()}"
    splits.assign_splits(splits.links_of_images(images.filter(~late))).write(folder)
    earlier = splits.SplitTables.read(spark, folder)
    state = splits.assign_splits(splits.links_of_images(images.filter(late)), earlier)
    state.write(folder)
    now = splits.SplitTables.read(spark, folder).records
    was = earlier.records.select("record_id", F.col("split").alias("was"))
    # the least record names a group as SQL can; a split that was given stays, unless its group clashed
    least = now.groupBy("group_id").agg(F.min("record_id").alias("least"), F.count_distinct("split").alias("n_splits"))
    kept = F.when(F.col("was").isNull(), F.lit("new")).when((F.col("was") == F.col("split")) | (F.col("split") == splits.QUARANTINE), "kept").otherwise("lost")
    return now.join(least, "group_id").join(was, "record_id", "left").select(F.col("record_id").alias("image_id"), "least", "n_splits", kept.alias("state"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    model = consensus.fit(_read(spark, d, "labels_test_b"))
    return consensus.consensus(model).filter("n_values > 1").select("annotation_id", "field", "consensus")


def p4_items(spark: SparkSession, d: str) -> DataFrame:
    """Consensus, its probability and the agreement of every labelled item and field."""
    return consensus.consensus(consensus.fit(_read(spark, d, "labels_test_b")))


def p4_annotators(spark: SparkSession, d: str) -> DataFrame:
    """Reliability of every annotator in each field."""
    labels = _read(spark, d, "labels_test_b")
    return consensus.reliability(consensus.fit(labels), labels)


def _cutoffs(spark: SparkSession, d: str) -> DataFrame:
    scores = cutoff.latest_scores(_read(spark, d, "prediction_scores"))
    return cutoff.cutoffs(scores, _read(spark, d, "coverage_targets"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.cutoff_table(_cutoffs(spark, d))


def p6_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    """Cutoff, counted and kept predictions of every source."""
    return _cutoffs(spark, d).select("source", "target_pct", "n", "cutoff", "kept_n")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(_read(spark, d, "documents"))


def p7_offsets(spark: SparkSession, d: str) -> DataFrame:
    """The byte of its text at which each token of a document starts."""
    return tokenizer.encode(_read(spark, d, "documents"), offsets=True)


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    return mixing.mix(mixing.document_sizes(_read(spark, d, "documents")), _read(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """How often each document of a listed source occurs in the mix."""
    return _mix(spark, d).documents


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share that each listed source was to hold and does hold."""
    return _mix(spark, d).shares


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(_read(spark, d, "documents")).select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates."""
    docs = _read(spark, d, "documents")
    return truncation.rates(docs, truncation.truncated(docs))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_splits, p1_increments, p4_found, p4_items, p4_annotators, p6_found, p6_cutoffs, p7_ids, p7_offsets, p8_mix, p8_shares, p9_found, p9_rates)}


# Written from the statement, without the operator's patterns: copy marks and extensions go one at a time, and the digits of what is left tell the moment.
_P1 = r"""
WITH RECURSIVE flat AS (
  SELECT DISTINCT image_id, lower(regexp_replace(file_name, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')) AS name, selected_at FROM test_examples WHERE file_name IS NOT NULL AND image_id IS NOT NULL
), bare(image_id, stem, last, pass) AS (
  SELECT image_id, list_last(string_split(replace(name, '\', '/'), '/')), list_last(string_split(replace(name, '\', '/'), '/')), 0 FROM flat
  UNION
  SELECT image_id, CASE
      WHEN regexp_matches(stem, '^(copy|kopie|копия)( [(][0-9]+[)])? (of|von) ') THEN regexp_replace(stem, '^(copy|kopie|копия)( [(][0-9]+[)])? (of|von) ', '')
      WHEN regexp_matches(stem, '[.][a-z][a-z0-9]{1,4}$') THEN regexp_replace(stem, '[.][a-z0-9]+$', '')
      WHEN regexp_matches(stem, '[(\[][0-9]{1,4}[)\]]$') THEN regexp_replace(stem, '\s*[(\[][0-9]+[)\]]$', '')
      WHEN regexp_matches(stem, '~[0-9]{0,3}$') THEN regexp_replace(stem, '~[0-9]*$', '')
      WHEN regexp_matches(stem, '[\s_.–—-](copy|kopie|копия|edit|edited|bearbeitet|изменено)([\s_-]*[0-9]{1,3})?$')
        THEN regexp_replace(stem, '[\s_.–—-]+(copy|kopie|копия|edit|edited|bearbeitet|изменено)([\s_-]*[0-9]{1,3})?$', '')
      ELSE rtrim(stem) END, last, pass + 1
  FROM bare WHERE pass < 12
), stems AS (
  SELECT DISTINCT image_id, coalesce(nullif(stem, ''), last) AS stem FROM bare WHERE pass = 12 AND last <> ''
), parts AS (
  SELECT image_id, stem, regexp_extract_all(stem, '[0-9]+') AS n, regexp_replace(stem, '[0-9]+', '#', 'g') AS shape FROM stems
), moments AS (
  SELECT image_id, stem, n, CASE WHEN regexp_full_match(shape, 'id[\s_-]*#[\s_-]+#') AND len(n[2]) IN (10, 13) THEN strftime(DATE '1970-01-01' + (left(n[2], 10)::BIGINT // 86400)::INT, '%Y%m%d')
    WHEN regexp_full_match(shape, 'id[\s_-]*#[\s_-]+#([._-]?#[._-]?#)?[\s_t-]+#([._:-]?#([._:-]?#)?)?') AND regexp_full_match(stem, 'id[\s_-]*[0-9]+[\s_-]+[0-9]{4}[._-]?[0-9]{2}[._-]?[0-9]{2}[\s_t-]+[0-9]{2}[._:-]?[0-9]{2}([._:-]?[0-9]{2})?')
      THEN left(array_to_string(n[2:], ''), 8) END AS day
  FROM parts
), keys AS (
  SELECT DISTINCT image_id, CASE WHEN try_strptime(day, '%Y%m%d') IS NOT NULL THEN coalesce(nullif(ltrim(n[1], '0'), ''), '0') || ' on ' || day ELSE 'name ' || stem END AS key FROM moments
), edges AS (
  SELECT DISTINCT a.image_id AS a, b.image_id AS b FROM keys a JOIN keys b USING (key)
), reach AS (
  SELECT a, b FROM edges
  UNION
  SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
)
"""

_HALVES = """, half AS (
  SELECT min(selected_at) + to_seconds(datediff('second', min(selected_at), max(selected_at)) // 2) AS m FROM test_examples
), images AS (
  SELECT image_id, bool_and(selected_at > m AND selected_at IS NOT NULL) AS fresh FROM test_examples, half WHERE image_id IS NOT NULL GROUP BY image_id
)
SELECT image_id, coalesce((SELECT min(b) FROM reach WHERE a = image_id), image_id) AS least, 1::BIGINT AS n_splits, CASE WHEN fresh THEN 'new' ELSE 'kept' END AS state FROM images
"""

_CUT = """
WITH counted AS (
  SELECT lower(trim(arg_max(source, (loaded_at, scored_at)))) AS source, arg_max(model_client, (loaded_at, scored_at)) AS model_client,
         arg_max(coalesce(confidence, 'nan'::DOUBLE), (loaded_at, scored_at)) AS confidence
  FROM prediction_scores WHERE source IS NOT NULL GROUP BY pred_id
), valid AS (
  SELECT * FROM counted WHERE confidence BETWEEN 0 AND 1
), ranked AS (
  SELECT v.source, confidence, target_pct, count(*) OVER (PARTITION BY v.source ORDER BY confidence DESC) AS kept, count(*) OVER (PARTITION BY v.source) AS n
  FROM valid v JOIN coverage_targets USING (model_client)
), hit AS (
  SELECT source, any_value(target_pct) AS target_pct, any_value(n) AS n, max(confidence) AS cutoff, arg_max(kept, confidence) AS kept_n
  FROM ranked WHERE kept * 100 >= target_pct * n GROUP BY source
)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1 + "SELECT a AS image_id, min(b) AS group_id FROM reach GROUP BY a HAVING count(DISTINCT b) > 1",
        "p1_increments": _P1 + _HALVES,
        "p6_found": _CUT + "SELECT source, round(cutoff * 1000)::BIGINT AS cutoff_milli, kept_n::BIGINT AS kept_n FROM hit",
        "p6_cutoffs": _CUT + "SELECT source, target_pct, n::BIGINT AS n, cutoff, kept_n::BIGINT AS kept_n FROM hit",
    }
