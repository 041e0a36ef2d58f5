"""Model answers: parsing, ordered violations, attempts, region answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxmeter.functions.text import strip_fence
from boxmeter.schemas import ACTIONS, ASSESSMENT, DAMAGE_TYPES, GENERAL_DAMAGE_TYPES, GENERAL_PARTS, PARTS, SEVERITIES

# fixed values: profiles, tolerance, and below the wording of the messages, which models are shown again
PROFILES = {"benchmark": (DAMAGE_TYPES, PARTS), "general": (GENERAL_DAMAGE_TYPES, GENERAL_PARTS)}
EDGE = 1e-3
_CORRUPT = ASSESSMENT.add("_corrupt", "string")


def parse_answer(raw: Column) -> tuple[Column, Column]:
    """(answer, problem): the assessment struct, and why there is none: empty answer, not a JSON object, or not valid JSON."""
    text = F.trim(strip_fence(F.trim(raw)))
    parsed = F.from_json(text, _CORRUPT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    problem = (
        F.when(raw.isNull() | (F.trim(raw) == ""), "empty answer")
        .when(~text.startswith("{"), "answer is not a JSON object")
        .when(parsed.isNull() | parsed["_corrupt"].isNotNull(), "answer is not valid JSON")
    )
    return F.when(problem.isNull(), parsed), problem


def judged_answers(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """``answers`` with answer and problem, as ``parse_answer`` gives them; every text is parsed once.

    Text and parsed struct go through a generator of one row, which no
    projection is merged with, so what refers to them doesn't parse again.
    """
    text = F.trim(strip_fence(F.trim(F.col(raw))))
    once = answers.select("*", F.explode(F.array(text)).alias("_text"))
    once = once.select("*", F.explode(F.array(F.from_json("_text", _CORRUPT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))).alias("_parsed"))
    problem = (
        F.when(F.col(raw).isNull() | (F.trim(raw) == ""), "empty answer")
        .when(~F.col("_text").startswith("{"), "answer is not a JSON object")
        .when(F.col("_parsed").isNull() | F.col("_parsed._corrupt").isNotNull(), "answer is not valid JSON")
    )
    return once.select(*answers.columns, F.when(problem.isNull(), F.col("_parsed")).alias("answer"), problem.alias("problem"))


def _number(x: Column) -> Column:
    return x.cast("string")


def violations(answer: Column, profile: str = "benchmark") -> Column:
    """The ordered messages about an answer struct; empty means valid."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile}")
    types, parts = PROFILES[profile]
    score, damages = answer["overall_score"], answer["damages"]

    def enum(d: Column, name: str, allowed: list[str], path: Column) -> Column:
        v = d[name]
        return F.when(v.isNull(), F.concat(path, F.lit(f".{name} is missing"))).when(
            ~v.isin(allowed), F.concat(path, F.lit(f".{name} has unknown value '"), v, F.lit("'"))
        )

    def damage(d: Column, i: Column) -> Column:
        path = F.concat(F.lit("damages["), i.cast("string"), F.lit("]"))
        c, box = d["confidence"], d["bounding_box"]
        at = F.concat(path, F.lit(".bounding_box"))
        shown = F.concat(F.lit("["), F.array_join(F.transform(box, _number), ", ", "null"), F.lit("]"))
        x, y, w, h = (F.get(box, F.lit(k)) for k in range(4))
        flawed = F.exists(box, lambda v: v.isNull() | (v < 0) | (v > 1))
        shape = (
            F.when(box.isNull(), F.concat(at, F.lit(" is missing")))
            .when(F.size(box) != 4, F.concat(at, F.lit(" must have 4 values [x, y, w, h], had "), F.size(box).cast("string")))
            .when(flawed, F.concat(at, F.lit(" values must be normalized to [0, 1], was "), shown))
        )
        fine = shape.isNull()
        messages = F.array(
            enum(d, "damage_type", types, path), enum(d, "part", parts, path), enum(d, "severity", SEVERITIES, path), enum(d, "action", ACTIONS, path),
            F.when(c.isNull(), F.concat(path, F.lit(".confidence is missing"))).when((c < 0) | (c > 1), F.concat(path, F.lit(".confidence must be in [0, 1], was "), _number(c))),
            shape,
            F.when(fine & ((w <= 0) | (h <= 0)), F.concat(at, F.lit(" width and height must be > 0, was "), shown)),
            F.when(fine & ((x + w > 1 + EDGE) | (y + h > 1 + EDGE)), F.concat(at, F.lit(" extends outside the image, was "), shown)),
        )
        return F.when(d.isNull(), F.array(F.concat(path, F.lit(" is null")))).otherwise(messages)

    head = F.array(
        F.when(score.isNull(), "overall_score is missing").when((score < 0) | (score > 100), F.concat(F.lit("overall_score must be in [0, 100], was "), _number(score))),
        F.when(damages.isNull(), "damages is missing"),
    )
    body = F.coalesce(F.flatten(F.transform(damages, damage)), F.array().cast("array<string>"))
    return F.when(answer.isNull(), F.array(F.lit("answer is null"))).otherwise(F.array_compact(F.concat(head, body)))


def without_vehicle(answer: Column) -> Column:
    """An answer that sees no vehicle and leaves damages out has none."""
    none = F.array().cast("array<" + ASSESSMENT["damages"].dataType.elementType.simpleString() + ">")
    missing = answer["damages"].isNull() & (answer["vehicle_visible"] == F.lit(False))
    return F.when(missing, answer.withField("damages", none)).otherwise(answer)


def first_valid_attempt(answers: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Per key the first valid of up to ``max_attempts`` recorded answers, or an error with the log of all.

    ``answers`` has key, attempt (from 1), raw (null: the call failed).  Result:
    key, status, attempts, damages (number), error_message.
    """
    judged = judged_answers(answers.filter(F.col("attempt") <= max_attempts).select("key", "attempt", "raw"))
    judged = judged.withColumn("answer", without_vehicle(F.col("answer")))
    found = F.when(F.col("raw").isNull(), F.array(F.lit("model call failed"))).when(F.col("problem").isNotNull(), F.array("problem")).otherwise(violations(F.col("answer")))
    judged = judged.select("key", "attempt", F.size(F.col("answer.damages")).alias("damages"), F.explode(F.array(found)).alias("found"))
    log = F.concat(F.lit("attempt "), F.col("attempt").cast("string"), F.lit(": "), F.array_join("found", "; "))
    per = judged.groupBy("key").agg(
        F.min(F.when(F.size("found") == 0, F.struct("attempt", "damages"))).alias("ok"), F.max("attempt").alias("n"),
        F.array_sort(F.collect_list(F.struct("attempt", log.alias("text")))).alias("log"),  # at most max_attempts
    )
    text = F.concat(F.lit("No valid answer after "), F.col("n").cast("string"), F.lit(" attempts. "), F.array_join(F.transform("log", lambda x: x["text"]), " | "))
    return per.select(
        "key", F.when(F.col("ok").isNotNull(), "success").otherwise("error").alias("status"), F.coalesce("ok.attempt", "n").alias("attempts"),
        F.col("ok.damages").alias("damages"), F.when(F.col("ok").isNull(), text).alias("error_message"),
    )


def valid_regions(regions: Column, most: int = 30) -> Column:
    """Whether a list of boxes may be asked about: at most ``most``, four values in [0, 1] each, with an extent."""
    one = lambda r: r.isNotNull() & (F.size(r) == 4) & F.forall(r, lambda v: v.isNotNull() & (v >= 0) & (v <= 1)) & (F.get(r, F.lit(2)) > 0) & (F.get(r, F.lit(3)) > 0)
    return F.coalesce(regions.isNotNull() & (F.size(regions) <= most) & F.forall(regions, one), F.lit(False))


_REGION = "struct<regions:array<struct<region:int,damage_type:string,part:string,severity:string,action:string,confidence:double>>,_corrupt:string>"


def region_answers(answers: DataFrame) -> DataFrame:
    """Answers about numbered boxes: key, violations, damages (the detector's boxes with their description).

    ``answers`` has key, raw, regions (array of boxes).  Entries of type ``none``
    are dropped; every region must be answered exactly once.
    """
    text = F.trim(strip_fence(F.trim(F.coalesce("raw", F.lit("")))))
    parsed = F.from_json(text, _REGION, {"columnNameOfCorruptRecord": "_corrupt"})
    start = F.struct(F.array().cast("array<int>").alias("seen"), F.array().cast("array<string>").alias("bad"), F.array().cast("array<struct<region:int,damage_type:string,part:string,severity:string,action:string,confidence:double,box:array<double>>>").alias("ok"))

    def take(s: Column, e: Column) -> Column:
        n, t, c = e["region"], e["damage_type"], e["confidence"]
        label = F.concat(F.lit("region "), n.cast("string"))
        unknown = n.isNull() | (n < 1) | (n > F.size("regions"))
        twice = F.array_contains(s["seen"], n)
        incomplete = ~(F.coalesce(e["part"].isin(PARTS), F.lit(False)) & F.coalesce(e["severity"].isin(SEVERITIES), F.lit(False)) & F.coalesce(e["action"].isin(ACTIONS), F.lit(False)))
        message = (
            F.when(unknown, F.concat(F.lit("unknown region number "), F.coalesce(n.cast("string"), F.lit(""))))
            .when(twice, F.concat(label, F.lit(" appears twice")))
            .when(~F.coalesce(t.isin([*DAMAGE_TYPES, "none"]), F.lit(False)), F.concat(label, F.lit(": unknown damage_type '"), F.coalesce(t, F.lit("null")), F.lit("'")))
            .when(c.isNull() | (c < 0) | (c > 1), F.concat(label, F.lit(": confidence must be a number in [0, 1]")))
            .when((t != "none") & incomplete, F.concat(label, F.lit(": part, severity or action missing or not allowed")))
        )
        entry = F.struct(n.alias("region"), t.alias("damage_type"), e["part"].alias("part"), e["severity"].alias("severity"), e["action"].alias("action"), c.alias("confidence"), F.get(F.col("regions"), n - 1).alias("box"))
        return F.struct(
            F.when(unknown | twice, s["seen"]).otherwise(F.concat(s["seen"], F.array(n))).alias("seen"),
            F.when(message.isNull(), s["bad"]).otherwise(F.concat(s["bad"], F.array(message))).alias("bad"),
            F.when(message.isNull() & (t != "none"), F.concat(s["ok"], F.array(entry))).otherwise(s["ok"]).alias("ok"),
        )

    folded = answers.withColumn("p", parsed).withColumn("s", F.aggregate(F.col("p.regions"), start, take))
    short = (F.size("s.bad") == 0) & (F.size("s.seen") != F.size("regions"))
    bad = (
        F.when(F.col("p").isNull() | F.col("p._corrupt").isNotNull(), F.array(F.lit("answer is not valid JSON")))
        .when(F.col("p.regions").isNull(), F.array(F.lit("'regions' array is missing")))
        .when(short, F.array(F.concat(F.lit("expected an entry for every region 1.."), F.size("regions").cast("string"), F.lit(", got "), F.size("s.seen").cast("string"))))
        .otherwise(F.col("s.bad"))
    )
    return folded.select("key", bad.alias("violations"), F.col("s.ok").alias("ok")).select("key", "violations", F.when(F.size("violations") == 0, F.col("ok")).alias("damages"))
