"""Readers and writers of the data model's files."""

from __future__ import annotations

import json
import re
import struct
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxmeter.operators.resample import numbered
from boxmeter.schemas import GROUND_TRUTH, PREDICTIONS, SHEET_COLUMNS


def read_predictions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(answers, damages) of a predictions file: its keys are image ids, so it is read as a map and never inferred."""
    doc = spark.read.schema(PREDICTIONS).option("multiLine", True).json(path)
    answers = doc.select(F.explode("predictions").alias("image_id", "a")).select("image_id", "a.*")
    damages = answers.select("image_id", "status", F.posexplode("damages").alias("idx", "d")).select(
        "image_id", "status", F.col("idx").cast("long").alias("idx"), "d.damage_type", "d.part", "d.severity", "d.action", "d.confidence", F.col("d.bounding_box").alias("box")
    )
    return answers, damages


def read_ground_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(images, damages) of a ground-truth file; boxes are normalized to the image."""
    doc = spark.read.schema(GROUND_TRUTH).option("multiLine", True).json(path)
    images = doc.select(F.posexplode("images").alias("position", "i")).select(F.col("position").cast("long").alias("position"), "i.*")
    d = images.select("image_id", "width", "height", F.posexplode("damages").alias("idx", "d"))
    box = F.transform(F.col("d.bbox"), lambda v, k: v / F.when(k % 2 == 0, F.col("width")).otherwise(F.col("height")))
    damages = d.select("image_id", F.col("idx").cast("long").alias("idx"), box.alias("box"), "d.annotation_id", "d.damage_type", "d.part", "d.severity", "d.action")
    return images.drop("damages"), damages


def sniff_separator(spark: SparkSession, path: str) -> str:
    """``;`` unless a comma is more frequent in the first 4096 characters."""
    lines = spark.read.text(path).limit(200).collect()  # in order: a file is read from its start
    text = "\n".join(r["value"] for r in lines)[:4096]
    return ";" if text.count(";") >= text.count(",") else ","


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A labeling sheet as trimmed strings; the byte-order mark goes, the separator is sniffed."""
    raw = spark.read.option("header", True).option("sep", sniff_separator(spark, path)).option("multiLine", True).csv(path)
    there = {c.lstrip("﻿").strip(): c for c in raw.columns}
    return raw.select(*[(F.trim(F.coalesce(F.col(f"`{there[c]}`"), F.lit(""))) if c in there else F.lit("")).alias(c) for c in SHEET_COLUMNS])


def write_sheet(rows: DataFrame, path: str) -> None:
    """A sheet for spreadsheets: one file, ``;``, byte-order mark, fixed columns.  Sheets are what people fill in, so they fit a driver."""
    import csv

    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f, delimiter=";")
        out.writerow(SHEET_COLUMNS)
        for r in rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("") for c in SHEET_COLUMNS]).toLocalIterator():
            out.writerow(list(r))


def write_report(report: dict, path: str) -> None:
    Path(path).write_text(json.dumps(report, indent=2, ensure_ascii=False), encoding="utf-8")


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """stem, line_no, class_id, values of label text files; blank lines are skipped."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), "^(.*?)(\\.[^.]*)?$", 1).alias("stem"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    tokens = text.filter(F.trim("line") != "").withColumn("t", F.split(F.trim("line"), "\\s+"))
    numbers = F.transform(F.slice("t", 2, F.greatest(F.lit(0), F.size("t") - 1)), lambda v: v.cast("double"))
    return tokens.select("stem", "line_no", F.col("t")[0].cast("double").cast("int").alias("class_id"), numbers.alias("values"))


def yolo_lines(boxes: DataFrame) -> DataFrame:
    """split, stem, text: the label file of each image; ``boxes`` has split, stem, idx, line."""
    lines = F.array_sort(F.collect_list(F.struct("idx", "line")))
    return boxes.groupBy("split", "stem").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def _plain(line: str) -> str:
    """A line without its comment: ``#`` outside of quotes, at the start or behind a blank."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "#" and (i == 0 or line[i - 1].isspace()):
            return line[:i]
    return line


def _items(text: str) -> list[str]:
    """The parts between commas outside of quotes."""
    parts, quote = [""], ""
    for c in text:
        if c == "," and not quote:
            parts.append("")
            continue
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        parts[-1] += c
    return [p for p in parts if p.strip()]


def read_names(path: str) -> dict[int, str]:
    """The ``names`` entry of a dataset description: a list or a map, inline or as a block."""
    lines = [_plain(line) for line in Path(path).read_text(encoding="utf-8").splitlines()]
    heads = [re.fullmatch(r"names\s*:(.*)", line.rstrip()) for line in lines]
    at = next((i for i, m in enumerate(heads) if m), None)
    if at is None:
        raise ValueError(f"no names in {path}")
    unquote = lambda s: s.strip().strip("'\"")
    inline = heads[at].group(1).strip()
    if inline.startswith("["):
        return dict(enumerate(unquote(x) for x in _items(inline.strip("[]"))))
    if inline.startswith("{"):
        return {int(unquote(k)): unquote(v) for k, v in (x.split(":", 1) for x in _items(inline.strip("{}")))}
    out: dict[int, str] = {}
    for line in lines[at + 1 :]:
        body = line.strip()
        if not body:
            continue
        if not line[0].isspace() and not body.startswith("-"):
            break
        if body.startswith("-"):
            out[len(out)] = unquote(body[1:])
        else:
            k, v = body.split(":", 1)
            out[int(unquote(k))] = unquote(v)
    return out


IMAGE = T.StructType([T.StructField("format", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("orientation", T.IntegerType())])


def image_header(data: bytes | None) -> tuple[str | None, int | None, int | None, int | None]:
    """(format, width, height, orientation) from the first bytes of a PNG or JPEG; anything else has no format."""
    if data is None or len(data) < 4:
        return (None, None, None, None)
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return ("png", *struct.unpack(">II", data[16:24]), None)
    if data[:2] != b"\xff\xd8":
        return (None, None, None, None)
    at, turned = 2, None
    while at + 9 < len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        marker = data[at + 1]
        if marker == 0xFF or marker in (0x01, *range(0xD0, 0xDA)):
            at += 1 if marker == 0xFF else 2
            continue
        size = int.from_bytes(data[at + 2 : at + 4])
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return ("jpeg", width, height, turned)
        if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            turned = exif_orientation(data[at + 10 : at + 2 + size])
        at += 2 + size
    return ("jpeg", None, None, turned)


def exif_orientation(tiff: bytes) -> int | None:
    """Tag 0x0112 of the first directory; None where it is absent or the block is damaged."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    try:
        at = struct.unpack(order + "I", tiff[4:8])[0]
        for i in range(struct.unpack(order + "H", tiff[at : at + 2])[0]):
            tag, _, _, value = struct.unpack(order + "HHIH", tiff[at + 2 + 12 * i : at + 12 + 12 * i])
            if tag == 0x0112:
                return value
    except (struct.error, TypeError):
        pass
    return None


@F.pandas_udf(IMAGE)
def image_info(data: pd.Series) -> pd.DataFrame:
    """``image_header`` of a binary column."""
    out = pd.DataFrame([image_header(d) for d in data], columns=IMAGE.names, dtype=object)
    return out.astype({c: "Int32" for c in IMAGE.names[1:]})


#: Bytes of an image file that its header is looked for in; metadata may stand before the size.
HEADER_BYTES = 1 << 20


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """file_name, size and header of the images in a folder, image_id by name from 1.

    Only sizes and headers leave the readers; names are numbered over range
    partitions, of which one offset each is shared.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png,JPG,JPEG,PNG}").load(path)
    head = F.substring("content", 1, HEADER_BYTES)
    rows = files.select(F.regexp_extract("path", "([^/]*)$", 1).alias("file_name"), F.col("length").alias("size"), image_info(head).alias("i"))
    return numbered(rows, "file_name").select((F.col("position") + 1).alias("image_id"), "file_name", "size", "i.*")


def coco_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """images, annotations, categories of a COCO file."""
    schema = (
        "images array<struct<id:bigint,file_name:string,width:int,height:int>>,"
        "annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>,area:double,iscrowd:int,auto_part:string,auto_part_source:string,auto_part_coverage:double>>,"
        "categories array<struct<id:bigint,name:string>>"
    )
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    return {t: doc.select(F.explode(t).alias("x")).select("x.*") for t in ("images", "annotations", "categories")}


def photo_bytes(spark: SparkSession, folder: str, idx: int) -> DataFrame:
    """content of the file of a photo, named by its number whatever the extension; no row where there is none."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"{idx}.*").load(folder).select("content")


def write_disagreements(rows: DataFrame, path: str) -> None:
    """Disagreements as separated files with header and byte-order mark, one per partition."""
    columns = ["image_id", "file_name", "annotation_id", "damage_type", "field", "annotator_a", "annotator_b"]
    head = [F.lit("").cast("string").alias(c) if c not in rows.columns else F.col(c).cast("string").alias(c) for c in columns]
    marked = rows.select(*head).withColumnRenamed("image_id", "\ufeffimage_id")
    marked.write.option("header", True).option("sep", ";").option("emptyValue", "").csv(path)


def write_sample(sample: DataFrame, path: str, position: str = "position") -> None:
    """A sample as ``ids`` (text, each image once, in order of its first place) and ``rows`` (JSON lines)."""
    first = sample.groupBy("image_id").agg(F.min(position).alias(position))
    first.repartitionByRange(position).sortWithinPartitions(position).select(F.col("image_id").cast("string")).write.text(f"{path}/ids")
    sample.drop(position).write.json(f"{path}/rows")


def write_pools(images: DataFrame, annotations: DataFrame, pools: DataFrame, path: str) -> None:
    """Images and annotations in folders ``pool=dev`` and ``pool=test``; ``pools`` has image_id and pool, and an image of no pool is an error."""
    pool = F.coalesce("pool", F.raise_error(F.concat(F.lit("no pool for image "), F.col("image_id").cast("string"))).cast("string"))
    for name, table in (("images", images), ("annotations", annotations)):
        table.join(pools.select("image_id", "pool"), "image_id", "left").withColumn("pool", pool).write.partitionBy("pool").json(f"{path}/{name}")


def write_label_folder(boxes: DataFrame, path: str, names: list[str]) -> None:
    """Label text in folders split=.../stem=..., and the dataset description; ``boxes`` as ``yolo_lines`` takes them."""
    yolo_lines(boxes).repartition("split", "stem").write.partitionBy("split", "stem").text(f"{path}/labels")
    listed = "".join(f"  {i}: {n}\n" for i, n in enumerate(names))
    description = boxes.sparkSession.createDataFrame([(f"path: {path}\ntrain: images/train\nval: images/val\nnames:\n{listed}".rstrip("\n"),)], "value string")
    description.coalesce(1).write.text(f"{path}/data")


def append_answers(answers: DataFrame, path: str, key: str = "image_id") -> None:
    """Append answers to those of a run; ones that the run has already are left out, so a broken run is simply repeated."""
    spark = answers.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    new = answers.dropDuplicates([key])
    if there:
        new = new.join(spark.read.schema(answers.schema).json(path).select(key).distinct(), key, "left_anti")
    new.write.mode("append").json(path)
