"""Answers, history, merging, sampling, conversion, files and state."""

import hashlib
import hmac
import json
import struct
from urllib.parse import urlencode

import pytest
from pyspark.sql import functions as F

from boxmeter.functions import text
from boxmeter.operators import conversion, detector, merging, runs, sampling, store, validate
from boxmeter.sources import files
from boxmeter.streaming import keyed, limiter, windows

DAMAGE = {"damage_type": "crack", "part": "door", "severity": "minor", "action": "repair", "confidence": 0.5, "bounding_box": [0.1, 0.1, 0.2, 0.2]}


def answer(**change):
    d = {k: v for k, v in {**DAMAGE, **change}.items() if v is not ...}
    return json.dumps({"damages": [d], "overall_score": 10})


@pytest.mark.parametrize(
    "raw,want",
    [
        (answer(), []), ("```json\n" + answer() + "\n```", []), (None, "empty answer"), ("  ", "empty answer"), ("I see a car", "answer is not a JSON object"), (answer()[:-2], "answer is not valid JSON"),
        (json.dumps({"damages": "x", "overall_score": 1}), "answer is not valid JSON"), (json.dumps({"overall_score": 1}), ["damages is missing"]),
        (answer(part=...), ["damages[0].part is missing"]), (answer(severity="bad"), ["damages[0].severity has unknown value 'bad'"]),
        (answer(confidence=1.5), ["damages[0].confidence must be in [0, 1], was 1.5"]), (answer(bounding_box=...), ["damages[0].bounding_box is missing"]),
        (answer(bounding_box=[0.1]), ["damages[0].bounding_box must have 4 values [x, y, w, h], had 1"]),
        (answer(bounding_box=[0.9, 0.1, 0.2, 0.0]), ["damages[0].bounding_box width and height must be > 0, was [0.9, 0.1, 0.2, 0.0]", "damages[0].bounding_box extends outside the image, was [0.9, 0.1, 0.2, 0.0]"]),
        (answer(bounding_box=[0.8, 0.1, 0.2005, 0.2]), []), (json.dumps({"damages": [None]}), ["overall_score is missing", "damages[0] is null"]),
    ],
)
def test_answers(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "raw string")
    a, problem = validate.parse_answer(F.col("raw"))
    r = df.select(problem.alias("p"), a.alias("a")).select("p", validate.violations(F.col("a")).alias("v")).first()
    assert (r.p == want) if isinstance(want, str) else (r.p is None and r.v == want)


def test_general_profile(spark):
    df = spark.createDataFrame([(answer(damage_type="rust", part="roof"),)], "raw string").select(validate.parse_answer(F.col("raw"))[0].alias("a"))
    assert df.select(validate.violations(F.col("a"), "general").alias("v")).first().v == []
    with pytest.raises(ValueError):
        validate.violations(F.col("a"), "other")


def test_attempts(spark):
    rows = [(1, 1, "nothing"), (1, 2, answer()), (1, 3, answer()), (2, 1, None), (2, 2, answer(part="x")), (2, 3, "?"), (2, 4, answer()), (3, 1, json.dumps({"vehicle_visible": False, "overall_score": 0}))]
    got = {r.key: r for r in validate.first_valid_attempt(spark.createDataFrame(rows, "key int, attempt int, raw string")).collect()}
    assert (got[1].status, got[1].attempts, got[1].damages) == ("success", 2, 1) and (got[3].status, got[3].damages) == ("success", 0)
    assert got[2].status == "error" and got[2].error_message.startswith("No valid answer after 3 attempts. attempt 1: model call failed | attempt 2: damages[0].part has unknown value 'x'")


def test_regions(spark):
    box = [[0.1, 0.1, 0.2, 0.2], [0.5, 0.5, 0.1, 0.1]]
    entry = lambda n, t="crack", **c: {"region": n, "damage_type": t, "part": "door", "severity": "minor", "action": "repair", "confidence": 0.5, **c}
    cases = [[entry(1), entry(2, "none")], [entry(1)], [entry(1), entry(1), entry(2)], [entry(1), entry(3)], [entry(1, confidence=2), entry(2)]]
    rows = [(i, json.dumps({"regions": c}), box) for i, c in enumerate(cases)] + [(9, "{", box), (10, "{}", box)]
    got = {r.key: r for r in validate.region_answers(spark.createDataFrame(rows, "key int, raw string, regions array<array<double>>")).collect()}
    assert got[0].violations == [] and [(x.region, x.box) for x in got[0].damages] == [(1, box[0])]
    assert got[1].violations == ["expected an entry for every region 1..2, got 1"] and got[2].violations == ["region 1 appears twice"] and got[3].violations == ["unknown region number 3"]
    assert got[4].violations == ["region 1: confidence must be a number in [0, 1]"] and got[9].violations == ["answer is not valid JSON"] and got[10].violations == ["'regions' array is missing"]
    ok = spark.createDataFrame([(box,), (box * 16,), ([[0.1, 0.1, 0.0, 0.2]],), (None,), ([],)], "r array<array<double>>").select(validate.valid_regions(F.col("r")).alias("v"))
    assert [r.v for r in ok.collect()] == [True, False, False, False, True]


def test_history(spark):
    ins = spark.createDataFrame([("a", 1, 10, 1, None), ("b", 1, 10, 2, "a"), ("c", 1, 20, 3, "a"), ("d", 2, 5, 4, None)], "inspection_id string, user_id int, created_at long, seq long, before_id string")
    photos = spark.createDataFrame([("a", 0, "m"), ("b", 0, "m")], "inspection_id string, idx int, damages_json string")
    corr = spark.createDataFrame([("a", 0, 1, "x"), ("a", 0, 2, "y")], "inspection_id string, idx int, seq long, after_json string")
    assert [r.inspection_id for r in store.newest_first(ins.filter("user_id = 1")).collect()] == ["c", "b", "a"]
    assert {r.inspection_id for r in store.keep_newest(ins, "user_id", 2).collect()} == {"b", "c", "d"}
    assert {r.inspection_id: (r.damages, r.n_corrections) for r in store.effective_damages(photos, corr).collect()} == {"a": ("y", 2), "b": ("m", 0)}
    assert [r.before_json for r in store.correction_log(photos, corr).orderBy("seq").collect()] == ["m", "x"]
    left = store.delete_inspections(ins.filter("inspection_id = 'a'"), ins, photos, corr)
    assert {r.inspection_id: r.before_id for r in left["inspections"].collect()} == {"b": None, "c": None, "d": None}
    assert left["photos"].count() == 1 and left["corrections"].count() == 0
    assert {r.inspection_id for r in store.with_return(ins).filter("has_return").collect()} == {"a"}
    wide = store.add_missing_columns(photos.withColumn("extra", F.lit(1)), {"inspection_id": "string", "view": "string"})
    assert wide.columns == ["inspection_id", "view"]
    with pytest.raises(ValueError):
        store.same_run({"mode": "tiled"}, {"mode": "whole"})


def test_merging(spark):
    schema = "key int, position int, part string, damage_type string, severity string, action string, confidence double"
    d = spark.createDataFrame([(1, 0, "door", "crack", "minor", "repair", 0.9), (1, 1, "door", "crack", "severe", "replacement", 0.7), (1, 2, "hood", "crack", "minor", "repair", 0.5)], schema)
    rows = merging.merge_photos(d).orderBy("first_seen").collect()
    assert [(r.part, r.n, r.severity, r.action) for r in rows] == [("door", 2, "severe", "repair"), ("hood", 1, "minor", "repair")] and rows[0].confidence == pytest.approx(0.8)
    assert merging.overall_score(merging.merge_photos(d)).first().overall_score == pytest.approx(3 * 20 * 0.8 + 20 * 0.5)
    with pytest.raises(Exception, match="unknown severity"):
        merging.merge_photos(d.withColumn("severity", F.lit("bad"))).collect()
    parts = spark.createDataFrame([(1, 0, "success", 1, 10.0, False, 0), (1, 1, "success", 2, 30.0, True, 2), (1, 2, "error", 3, None, None, 0), (2, 0, "error", 3, None, None, 0)], "image_id int, part int, status string, attempts int, overall_score double, vehicle_visible boolean, n_damages int")
    got = {r.image_id: r for r in merging.combine_parts(parts).collect()}
    assert (got[1].status, got[1].attempts, got[1].overall_score, got[1].n_failed, got[1].vehicle_visible) == ("success", 6, 20.0, 1, True)
    assert (got[2].status, got[2].overall_score, got[2].vehicle_visible) == ("error", None, None)


def test_names(spark):
    names = ["ID1_20240917_150956.png", "ID5_1726736225270.png", "other.v2.png", "ID1_20240917_150956"]
    got = [r.k for r in spark.createDataFrame([(n,) for n in names], "n string").select(text.session_day(F.col("n")).alias("k")).collect()]
    assert got == ["date:20240917", "date:20240919", "file:other.v2", "date:20240917"]
    parts = [("Left-mirror", "mirror"), ("rear_window", "window"), ("front--panel", "bumper"), ("Quarter_panel", "fender"), ("roof", "other"), ("rocker_panel", "other"), ("back door", "door")]
    df = spark.createDataFrame(parts, "n string, want string").select("want", text.map_name(F.col("n"), text.PART_RULES, "other").alias("got"))
    assert all(r.want == r.got for r in df.collect())
    with pytest.raises(Exception, match="no rule for"):
        spark.createDataFrame([("dent",)], "n string").select(text.map_name(F.col("n"), text.DAMAGE_RULES)).collect()


def test_signature(spark):
    fields = {"auth_date": "1", "user": '{"id":5}'}
    key = hmac.new(b"WebAppData", b"tok", hashlib.sha256).digest()
    sign = hmac.new(key, "\n".join(f"{k}={v}" for k, v in sorted(fields.items())).encode(), hashlib.sha256).hexdigest()
    good = urlencode({**fields, "hash": sign})
    df = spark.createDataFrame([(good, "tok"), (good, "other"), (good.replace("auth_date=1", "auth_date=2"), "tok"), (None, "tok")], "d string, t string")
    assert [r.v for r in df.select(text.signature_valid("d", "t").alias("v")).collect()] == [True, False, False, False]


def test_sampling(spark):
    rows = [("a", i) for i in range(6)] + [("b", i) for i in range(3, 9)] + [("c", 1)]
    c = spark.createDataFrame(rows + rows, "class string, image_id int")
    first = sampling.stratified_sample(c, ["a", "b", "c"], 3, 42, spark.createDataFrame([(0,)], "image_id int")).collect()
    again = sampling.stratified_sample(c, ["a", "b", "c"], 3, 42, spark.createDataFrame([(0,)], "image_id int")).collect()
    assert first == again and len({r.image_id for r in first}) == len(first) and sum(r["class"] == "b" for r in first) == 3 and 0 not in {r.image_id for r in first}
    pools = sampling.split_days(spark.createDataFrame([(f"d{i}", 1 + i % 3) for i in range(20)], "key string, n int"), 0.5, 42)
    assert pools.count() == 20 and {r.pool for r in pools.collect()} == {"dev", "test"}
    assert [r.k for r in sampling.top_counts(spark.createDataFrame([("x", 0), ("y", 1), ("y", 2), ("z", 3), ("x", 4)], "k string, p int"), "k", 2, "p").collect()] == ["x", "y"]
    assert {r.k: r.p for r in sampling.distinct_by_first(spark.createDataFrame([("x", 3), ("x", 1)], "k string, p int"), "k", "p").collect()} == {"x": 1}


def test_conversion(spark, tmp_path):
    for folder in ("damage", "parts", "images"):
        (tmp_path / folder).mkdir()
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 1000, 800)
    (tmp_path / "images" / "a.png").write_bytes(png)
    (tmp_path / "damage" / "a.txt").write_text("0 0.5 0.55 0.2 0.1\n\n1 0.9 0.9 0.1 0.1\n0 0.5 0.5\n0 1.5 0.5 0.1 0.1\n")
    (tmp_path / "parts" / "a.txt").write_text("0 0.0 0.0 0.5 0.0 0.5 1.0 0.0 1.0\n1 0.0 0.0 0.1 0.1\n")
    (tmp_path / "d.yaml").write_text("path: x\nnames:\n  0: scratch\n  1: broken_lamp\n")
    images = files.read_images(spark, str(tmp_path / "images")).withColumn("stem", F.regexp_extract("file_name", "^(.*)\\.", 1))
    assert [(r.image_id, r.width, r.height, r.format) for r in images.collect()] == [(1, 1000, 800, "png")]
    names = spark.createDataFrame(list(files.read_names(str(tmp_path / "d.yaml")).items()), "class_id int, name string")
    boxes = conversion.damage_boxes(files.read_label_lines(spark, str(tmp_path / "damage")), images, names)
    parts = files.read_label_lines(spark, str(tmp_path / "parts")).join(images, "stem").select(
        "image_id", F.col("line_no").alias("part_no"), F.lit("left_door").alias("name"), F.transform("values", lambda v, i: v * F.when(i % 2 == 0, F.col("width")).otherwise(F.col("height"))).alias("polygon")
    )
    got = conversion.annotate(boxes, parts).orderBy("line_no").collect()
    assert [(r.bbox, r.auto_part, r.auto_part_coverage, r.no_auto_part) for r in got] == [([400.0, 400.0, 200.0, 80.0], "door", 0.5, False), ([850.0, 680.0, 100.0, 80.0], "light", 1.0, True)]
    report = {r.counter: r.n for r in conversion.conversion_report(boxes, conversion.annotate(boxes, parts)).collect()}
    assert report == {"glass_shatter": 0, "lamp_broken": 1, "crack": 0, "scratch": 1, "skipped_bad_damage_line": 1, "skipped_empty_box": 1, "no_auto_part": 1}


def test_integrity(spark):
    ann = spark.createDataFrame([(1, 10, "crack"), (2, 10, "crack"), (3, 11, "scratch"), (4, 12, "crack")], "annotation_id long, image_id long, damage_type string")
    sample = spark.createDataFrame([(10,), (11,), (99,)], "image_id long")
    sheet = spark.createDataFrame([(1, "crack", "door", "minor", "repair"), (3, "crack", "door", "bad", ""), (4, "crack", "door", "minor", "repair"), (1, "crack", "door", "minor", "repair")], "annotation_id long, damage_type string, part string, severity string, action string")
    got = {tuple(r) for r in conversion.integrity_errors(ann, sample, sheet).collect()}
    assert got == {
        (1, "appears twice"), (2, "has no row in the labeling sheet"), (3, "damage_type differs from the dataset"), (3, "severity is not allowed"), (3, "action is not allowed"),
        (4, "does not belong to the selected images"), (99, "image is not in the annotation file"),
    }


def test_files(spark, tmp_path):
    doc = {"meta": {"model": "m", "nested": {"a": 1}}, "predictions": {"1": {"status": "success", "damages": [DAMAGE], "attempts": 1}, "2": {"status": "error"}}}
    (tmp_path / "p.json").write_text(json.dumps(doc, indent=2), encoding="utf-8")
    answers, damages = files.read_predictions(spark, str(tmp_path / "p.json"))
    assert {r.image_id: r.status for r in answers.collect()} == {"1": "success", "2": "error"} and damages.first().box == DAMAGE["bounding_box"]
    gt = {"images": [{"image_id": "1", "width": 100, "height": 200, "damages": [{"bbox": [10, 20, 30, 40], "damage_type": "crack", "part": "door", "severity": "minor", "action": "repair"}]}]}
    (tmp_path / "g.json").write_text(json.dumps(gt))
    images, boxes = files.read_ground_truth(spark, str(tmp_path / "g.json"))
    assert images.count() == 1 and boxes.first().box == pytest.approx([0.1, 0.1, 0.3, 0.2])
    rows = spark.createDataFrame([(1, "a;b.png", "crack")], "image_id int, file_name string, damage_type string")
    files.write_sheet(rows, str(tmp_path / "s.csv"))
    assert (tmp_path / "s.csv").read_bytes().startswith(b"\xef\xbb\xbfimage_id;")
    back = files.read_sheet(spark, str(tmp_path / "s.csv")).first()
    assert (back.image_id, back.file_name, back.severity) == ("1", "a;b.png", "")
    (tmp_path / "c.csv").write_text("image_id,part\n5, door \n")
    assert files.read_sheet(spark, str(tmp_path / "c.csv")).first().part == "door"
    for body in ("names: [a, 'b']", "names: {0: a, 1: b}", "names:\n- a\n- b\nnc: 2", "nc: 2\nnames:\n  0: a\n  1: b"):
        (tmp_path / "n.yaml").write_text(body)
        assert files.read_names(str(tmp_path / "n.yaml")) == {0: "a", 1: "b"}


def test_image_headers():
    exif = b"II*\0" + struct.pack("<IH", 8, 1) + struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0)
    app1 = b"Exif\0\0" + exif
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 600, 800) + b"\0" * 12
    assert files.image_header(jpeg) == ("jpeg", 800, 600, 6)
    assert files.image_header(b"GIF89a") == (None,) * 4 and files.image_header(None) == (None,) * 4 and files.image_header(b"\xff\xd8\xff\xd9") == ("jpeg", None, None, None)
    assert files.exif_orientation(b"XX") is None


REQUESTS = [(i, 1, t, 1) for i, t in enumerate([0, 10, 20, 30, 40, 50, 3601, 3611, 3621])] + [(20, 2, 30, 3), (21, 2, 31, 5), (22, 2, 32, 2), (23, 2, 33, -1), (24, 2, 34, 1)]
ADMITTED = {0, 1, 2, 3, 4, 6, 7, 8, 20, 22, 23, 24}


def test_limiter(spark, tmp_path):
    df = spark.createDataFrame(REQUESTS, "event_id long, user_id long, at long, units int")
    assert {r.event_id for r in limiter.admit_batch(df, 5, 3600).filter("admitted").collect()} == ADMITTED | set()
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = limiter.admit_stream(stream, 5, 3600).writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.event_id for r in spark.table("admitted").filter("admitted").collect()} == ADMITTED


def test_limiter_on_many_batches_equals_the_batch(spark, tmp_path):
    import random

    r = random.Random(5)
    rows, at = [], 0
    for i in range(240):
        at += r.choice((0, 5, 40, 900))
        rows.append((i, r.randrange(3), at, r.choice((1, 2, 3, -1))))
    late = sorted(rows, key=lambda x: x[2] + r.randrange(0, 500))  # out of order, within the allowed delay
    schema = "event_id long, user_id long, at long, units int"
    for k in range(6):
        part = late[k * 40 : k * 40 + 40]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(999, 77, at + 100_000, 1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = {(x.event_id, x.admitted) for x in limiter.admit_batch(spark.createDataFrame(rows, schema), 5, 3600).collect()}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = limiter.admit_stream(stream, 5, 3600, "600 seconds").writeStream.format("memory").queryName("many").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert {(x.event_id, x.admitted) for x in spark.table("many").collect()} == want


def test_limiter_gives_back_the_newest_units():
    held = limiter.Window(5, 100)
    assert [held.decide(0, 3), held.decide(10, 2), held.decide(20, 1), held.decide(30, -3), held.decide(40, 3), held.decide(40, -99), held.decide(41, 5)] == [True, True, False, True, True, True, True]
    assert held.held == 5 and list(held.taken) == [[41, 5]]


def test_names_of_every_form(tmp_path):
    for text, want in [
        ("names : [a, b]", {0: "a", 1: "b"}), ("names: ['a#1', b]  # two", {0: "a#1", 1: "b"}), ("nc: 2\nnames:\n- x # first\n- 'y, z'\nval: q", {0: "x", 1: "y, z"}),
        ("names: {0: 'p:q', 3: r}", {0: "p:q", 3: "r"}), ("names:\n  1: one\n\n  2: \"t#2\"", {1: "one", 2: "t#2"}), ("names: []", {}),
    ]:
        (tmp_path / "d.yaml").write_text(text)
        assert files.read_names(str(tmp_path / "d.yaml")) == want, text


def test_windows_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:01", "a", 1.0), ("2024-01-01 00:10:00", "a", 2.0), ("2024-01-01 03:00:00", "b", 3.0)], "t string, event_type string, value double").selectExpr("CAST(t AS TIMESTAMP_NTZ) AS ts", "event_type", "value")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windows.tumbling_counts(stream, "1 hour").writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.event_type, r.n, r.total) for r in spark.table("tumbling").collect()) == [("a", 2, 3.0), ("b", 1, 3.0)]


def test_runs(spark):
    plan = spark.createDataFrame([(1, "a.JPG", 0), (1, "a.JPG", 5), (2, "b.gif", 1), (3, "c.png", 2), (4, "d.png", 3)], "image_id int, file_name string, position int")
    there = spark.createDataFrame([("a.JPG", 10), ("b.gif", 10), ("c.png", 41 * 1024 * 1024)], "file_name string, size long")
    assert {r.image_id: (r.position, r.problem) for r in runs.check_images(plan, there).collect()} == {1: (0, None), 2: (1, "type"), 3: (2, "size"), 4: (3, "missing")}
    df = spark.createDataFrame([(3136, 1000, 0), (100, 50, 0), (100, 50, 5_000_000), (9999, 1, 0)], "w int, h int, s long").select(runs.sent_size(F.col("w"), F.col("h"), F.col("s")).alias("x"))
    assert [tuple(r.x) for r in df.collect()] == [(True, 1568, 500), (False, 100, 50), (True, 100, 50), (True, 1568, 1)]
    answers = spark.createDataFrame([("success",), ("error",), (None,)], "status string")
    assert tuple(runs.summary(answers).first()) == (3, 2)


def test_errors_of_every_sheet(spark):
    from boxmeter.operators import conversion

    annotations = spark.createDataFrame([(1, 10, "crack"), (2, 10, "scratch"), (3, 11, "crack")], "annotation_id long, image_id long, damage_type string")
    sample = spark.createDataFrame([(10,), (12,)], "image_id long")
    columns = "annotator string, annotation_id long, damage_type string, part string, severity string, action string"
    rows = [("a", 1, "crack", "hood", "minor", "repair"), ("a", 3, "crack", "hood", "minor", "repair"), ("b", 1, "dent", "hood", "minor", "none"), ("b", 2, "scratch", "hood", "minor", "repair"), ("b", 2, "scratch", "hood", "minor", "repair")]
    sheets = spark.createDataFrame(rows, columns)
    got = sorted(tuple(r) for r in conversion.integrity_errors_by(annotations, sample, sheets, "annotator").collect())
    want = sorted((a, *r) for a in "ab" for r in conversion.integrity_errors(annotations, sample, sheets.filter(f"annotator = '{a}'").drop("annotator")).collect())
    assert got == want
    assert {(r[0], r[1]) for r in got if r[2] == "image is not in the annotation file"} == {("a", 12), ("b", 12)}
    assert ("a", 2, "has no row in the labeling sheet") in got and ("a", 3, "does not belong to the selected images") in got and ("b", 2, "appears twice") in got


def test_the_query_checks_all_sheets_and_kinds(spark, data):
    from boxmeter.plans import core_queries

    rows = core_queries.sheet_errors_of_all(spark, data)
    labels, sample = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("labels_test_b", "test_examples"))
    annotators = labels.select("annotator").filter("annotator IS NOT NULL").distinct().count()
    missing = sample.select("image_id").distinct().join(labels, "image_id", "left_anti").count()
    assert rows.filter("error = 'image is not in the annotation file'").count() == missing * annotators > 0
    assert rows.select("annotator").distinct().count() == annotators > 1


def test_detector_output(spark):
    rows = [(1, 0, 0.90004, 0.05, 0.5, 0.2, 0.2, 0), (1, 1, 0.95, 0.9, 0.9, 0.4, 0.4, 1), (1, 9, 0.99, 0.5, 0.5, 0.1, 0.1, 2), (2, 2, 0.9, 0.5, 0.5, 0.1, 0.1, 0)]
    boxes = spark.createDataFrame(rows, "image_id int, class_id int, confidence double, cx double, cy double, w double, h double, position int")
    got = [(r.image_id, r.idx, r.damage_type, r.confidence, r.box) for r in detector.detector_damages(boxes, {0: "crack", 1: "scratch", 2: "wheel"}).orderBy("image_id", "idx").collect()]
    assert got == [(1, 0, "scratch", 0.95, [0.7, 0.7, 0.3, 0.3]), (1, 1, "crack", 0.9, [0.0, 0.4, 0.2, 0.2])]
    assert detector.detector_damages(boxes, {0: "wheel"}).count() == 0 and detector.detector_damages(boxes.filter("false"), {0: "crack"}).count() == 0
    sample = spark.createDataFrame([(1,), (1,), (None,)], "image_id int")
    assert detector.beside_sample(spark.createDataFrame([(1, "x"), (3, "y")], "image_id int, a string"), sample).count() == 1
    with pytest.raises(ValueError, match="image 1"):
        detector.beside_sample(spark.createDataFrame([(3, "y")], "image_id int, a string"), sample)


def test_store_reads_and_writes(spark, tmp_path):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id int, user_id string")
    assert store.find(table, "id", 1, "user_id", "a").count() == 1 and store.find(table, "id", 1, "user_id", "b").count() == 0 and store.find(table, "id", 2).count() == 1
    photos = spark.createDataFrame([(1, 1, '{"k": 2}'), (1, 0, "x"), (1, 2, None)], "inspection_id int, idx int, meta string")
    assert [(r.idx, r.meta and r.meta.k) for r in store.decoded_photos(photos, {"meta": "k int"}).collect()] == [(0, None), (1, 2), (2, None)]
    new = spark.createDataFrame([(1, "success", [("crack", None)]), (2, "error", [("crack", "x")]), (3, "success", None)], "idx int, status string, damages array<struct<t:string,d:string>>")
    assert [r.damages_json for r in store.new_photos(new).orderBy("idx").collect()] == ['[{"t":"crack"}]', "[]", "[]"]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "3.jpg").write_bytes(b"abc")
    assert [bytes(r.content) for r in files.photo_bytes(spark, str(tmp_path / "p"), 3).collect()] == [b"abc"] and files.photo_bytes(spark, str(tmp_path / "p"), 4).count() == 0
    merged = merging.merged_status(spark.createDataFrame([(1, "success"), (1, "error"), (2, None), (2, "error")], "key int, status string"))
    assert {tuple(r) for r in merged.collect()} == {(1, "success", 2, 1), (2, "error", 2, 2)}


def test_sinks(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    sample = spark.createDataFrame([(5, "a.png", "crack", 1), (7, "b.png", "crack", 0), (5, "a.png", "scratch", 2)], "image_id int, file_name string, class_selected_for string, position int")
    files.write_sample(sample, at("sample"))
    assert [r.value for r in spark.read.text(at("sample/ids")).collect()] == ["7", "5"] and spark.read.json(at("sample/rows")).count() == 3
    images = spark.createDataFrame([(5, "a.png"), (7, "b.png")], "image_id int, file_name string")
    pools = spark.createDataFrame([(5, "dev"), (7, "test")], "image_id int, pool string")
    files.write_pools(images, images, pools, at("pools"))
    assert {(r.image_id, r.pool) for r in spark.read.json(at("pools/annotations")).collect()} == {(5, "dev"), (7, "test")}
    with pytest.raises(Exception, match="no pool for image 7"):
        files.write_pools(images, images, pools.filter("image_id = 5"), at("bad"))
    boxes = spark.createDataFrame([("train", "a", 0, "0 1 2 3 4"), ("train", "a", 1, "1 1 2 3 4"), ("val", "b", 0, "2 1 2 3 4")], "split string, stem string, idx int, line string")
    files.write_label_folder(boxes, at("yolo"), ["crack", "scratch"])
    assert [r.value for r in spark.read.text(at("yolo/labels/split=train/stem=a")).collect()] == ["0 1 2 3 4", "1 1 2 3 4"]
    data = next((tmp_path / "yolo" / "data").glob("part-*"))
    assert files.read_names(str(data)) == {0: "crack", 1: "scratch"}
    answers = spark.createDataFrame([("1", "success"), ("2", "error"), ("2", "error")], "image_id string, status string")
    files.append_answers(answers.filter("image_id = '1'"), at("run"))
    files.append_answers(answers, at("run"))
    files.append_answers(answers, at("run"))
    assert sorted(r.image_id for r in spark.read.json(at("run")).collect()) == ["1", "2"]
    files.write_disagreements(spark.createDataFrame([(1, "a.png", 2, "crack", "part", "door", None)], "image_id int, file_name string, annotation_id int, damage_type string, field string, annotator_a string, annotator_b string").coalesce(1), at("dis"))
    assert next((tmp_path / "dis").glob("part-*.csv")).read_text(encoding="utf-8-sig").splitlines() == ["image_id;file_name;annotation_id;damage_type;field;annotator_a;annotator_b", "1;a.png;2;crack;part;door;"]


def test_more_scalars(spark):
    df = spark.createDataFrame([("100", 150, b"ab", ["x is missing", "y"])], "a string, now int, b binary, v array<string>")
    row = df.select(
        text.still_valid(F.col("a"), F.col("now"), 50).alias("in"), text.still_valid(F.col("a"), F.col("now"), 49).alias("out"), text.still_valid(F.lit("x"), F.col("now"), 9).alias("none"),
        text.data_url(F.col("b"), F.lit("image/png")).alias("url"), text.local_time(F.lit("2026-01-01 23:30:00"), "Europe/Berlin").alias("t"),
        text.with_corrections(F.lit("p"), F.lit(2), F.col("v"), "Mend:").alias("again"), text.with_corrections(F.lit("p"), F.lit(1), F.col("v"), "Mend:").alias("first"),
    ).first()
    assert tuple(row) == (True, False, None, "data:image/png;base64,YWI=", "2026-01-02 00:30", "p\n\nMend:\n- x is missing\n- y", "p")
    cats = spark.createDataFrame([(1, "crack"), (2, "rust"), (3, None)], "id int, name string")
    assert [r.name for r in sampling.unknown_classes(cats, ["crack"]).collect()] == ["rust"]


def test_stretches_of_a_stream(spark, tmp_path):
    rows = [("a", 0, "x"), ("a", 50, "y"), ("a", 500, "z"), ("b", 10, "q"), ("b", 60, None), ("zz", 100_000, "end")]
    df = spark.createDataFrame(rows, "key string, s long, value string").select("key", F.timestamp_seconds("s").alias("at"), "value")
    want = {(r.key, r.value, r.n) for r in keyed.stretches_batch(df, 100).collect()}
    assert want == {("a", "y", 2), ("a", "z", 1), ("b", None, 2), ("zz", "end", 1)}
    for k in range(3):
        part = spark.createDataFrame(rows[2 * k : 2 * k + 2], "key string, s long, value string").select("key", F.timestamp_seconds("s").alias("at"), "value")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = keyed.stretches_stream(stream, 100, "1000 seconds").writeStream.format("memory").queryName("stretches").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert {(r.key, r.value, r.n) for r in spark.table("stretches").collect()} == want - {("zz", "end", 1)}
