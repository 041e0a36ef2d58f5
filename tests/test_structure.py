import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from boxmeter.operators import structure as S

JSON = st.recursive(
    st.none() | st.booleans() | st.integers(-10**6, 10**6) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4),
    max_leaves=12,
)


def whole(b):
    try:
        json.loads(b, parse_constant=lambda c: 1 / 0)
        return True
    except Exception:
        return False


def rebuild(x):
    inside = S.members(x)

    def value(i):
        if x.kind[i] == S.OBJECT:
            return {x.key(j): value(j) for j in inside.get(i, ())}
        if x.kind[i] == S.ARRAY:
            return [value(j) for j in inside.get(i, ())]
        return json.loads(x.raw(i))

    return {int(x.doc[i]): value(i) for i in inside.get(-1, ())}


@settings(max_examples=150, deadline=None)
@given(st.lists(JSON, max_size=5), st.booleans(), st.sampled_from([None, 1]))
def test_round_trip(values, ascii_only, indent):
    x = S.index([json.dumps(v, ensure_ascii=ascii_only, indent=indent).encode() for v in values])
    assert x.valid.all()
    assert rebuild(x) == dict(enumerate(values))


def test_damaged_texts_are_told_like_a_parser_does():
    r = random.Random(5)
    base = [b'{"a":[1,2,{"b":"x\\"y"}],"c":null}', b"[]", b"{}", b'""', b"1", b"[[],{}]", b' {"k" : -1.5e3 , "z":"\\u00e9\\\\"} ']
    cases = [b"", b" ", b"tru", b'"\x01"', b'"\\x"', b'"\\u12g4"', b"[1,]", b'{"a"}', b'{"a":1,}', b"1 2", b"]["]
    for _ in range(3000):
        b = bytearray(r.choice(base))
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(b) + 1)
            if r.random() < 0.5 and i < len(b):
                del b[i]
            else:
                b.insert(i, r.choice(b'{}[]",: \\1eatn\n'))
        cases.append(bytes(b))
    assert S.index(cases).valid.tolist() == [whole(c) for c in cases]


FILE = {
    "meta": {},
    "predictions": {
        "7": {"status": "success", "damages": [{"damage_type": "crack", "bounding_box": [0.1, 0.2, 0.3, None]}, None, {"damage_type": "dent"}]},
        "8": {"status": "error", "damages": None},
        "9": {"damages": {"1": {"part": "hood"}, "0": {"part": "door"}}},
        "10": {"damages": {"damage_type": "crack"}},
        "11": {"damages": '[{"part": "door"}, null]'},
        "12": {"damages": "not json"},
        "13": None,
        "14": {"damages": []},
        "15": {"damages": {"3": {"part": "door"}, "1": None, "2": {}}},
        "16": {"damages": {"0": "text", "1": 5}},
    },
}


def test_places_of_damages(spark):
    listed = {"predictions": [{"image_id": 5, "damages": [{}]}, {"image": {"image_id": "6"}, "result": {"damages": []}}, None]}
    rows = [(1, json.dumps(FILE)), (1, json.dumps(FILE)), (1, '{"pred'), (2, json.dumps(listed)), (3, None), (4, ""), (5, "[]"), (None, json.dumps(FILE))]
    df = spark.createDataFrame(rows, "run_id long, content string").selectExpr("*", "'x' AS text", "1 AS doc_id")
    flat = S.flat_tables(df, "run_id", "content")
    got = {tuple(r) for r in S.damage_places(flat).collect()}
    narrow = {tuple(r) for r in S.damage_places(S.flat_tables(df, "run_id", "content", ("image",))).collect()}
    assert got == narrow == {
        (1, "7", 0), (1, "7", 2), (1, "8", -1), (1, "9", 0), (1, "9", 1), (1, "10", 0), (1, "11", 0), (1, "12", -1), (1, "14", -1), (1, "15", 1), (1, "15", 2), (1, "16", -1),
        (2, "5", 0), (2, "6", -1),
    }
    boxes = [(r.damage_no, r.box_no, r.number) for r in flat.filter("kind = 'box'").orderBy("box_no").collect()]
    assert boxes == [(0, 0, 0.1), (0, 1, 0.2), (0, 2, 0.3), (0, 3, None)]
    assert flat.filter("kind = 'document'").count() == 3


def test_every_value_is_linked_to_its_parent(spark):
    df = spark.createDataFrame([(1, '{"a": [1, {"b": "x"}], "a": null}'), (2, "{")], "id long, t string")
    rows = S.flatten(df, "id", "t").orderBy("node").collect()
    assert [(r.node, r.parent, r.depth, r.key, r.place, r.kind, r.value) for r in rows] == [
        (0, -1, 0, None, 0, "object", None), (1, 0, 1, "a", 0, "array", None), (2, 1, 2, None, 0, "number", "1"),
        (3, 1, 2, None, 1, "object", None), (4, 3, 3, "b", 0, "string", "x"), (5, 0, 1, "a", 1, "null", None),
    ]


def test_values_of_one_delivery(spark):
    whole = ['{"meta": {"a": 1}, "x": [2]}', '{"meta": {"a": 1}, "x": [3]}', "{"]
    rows = [(1, whole[0]), (1, whole[1]), (1, whole[0]), (1, "{"), (2, "{"), (2, "["), (None, whole[0]), (3, None), (4, "5"), (5, "{"), (5, "6")]
    df = spark.createDataFrame(rows, "id long, t string").coalesce(1)
    got = S.whole_values(df, "id", "t")
    images = S.flat_tables(df.selectExpr("id", "t"), "id", "t", ("document",))
    assert {r.doc_id for r in images.collect()} == {1, 4, 5} == {r.doc_id for r in got.collect()}
    chosen = df.filter("id = 1 AND t <> '{'").selectExpr("t", "xxhash64(t) AS h").orderBy("h").first().t
    assert sorted(tuple(r) for r in got.filter("doc_id = 1").collect()) == sorted(tuple(r) for r in S.flatten(spark.createDataFrame([(1, chosen)], "id long, t string"), "id", "t").collect())


def test_every_scalar_member_is_in_the_values(spark, data):
    from boxmeter.plans import data_queries

    v = data_queries.p2_values(spark, data).cache()
    names = {(r.src, r.key) for r in v.select("src", "key").distinct().collect()}
    assert {("gt", c) for c in ("meta", "created_at", "file_name", "width", "height", "annotation_id")} <= names
    assert {("pred", c) for c in ("meta", "attempts", "overall_score", "vehicle_visible", "confidence")} <= names
    gt = spark.read.parquet(f"{data}/gt_dev.parquet")
    wanted = gt.selectExpr("doc_id", "explode(images) AS i").distinct().filter("i.width IS NOT NULL").count()
    assert v.filter("src = 'gt' AND key = 'width' AND kind = 'number'").count() == wanted
    assert v.groupBy("src", "doc_id", "node").count().filter("count > 1").count() == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "run_id long, content string")
    assert S.damage_places(S.flat_tables(df, "run_id", "content")).count() == 0
