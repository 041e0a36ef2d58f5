import random

import pytest
from pyspark.sql import functions as F

from boxmeter.llm import splits as S
from boxmeter.llm.components import components


def union_find(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    r = random.Random(1)
    ids = [f"{i:03d}" for i in range(60)]
    edges = {"chain": list(zip(ids, ids[1:])), "star": [(ids[40], i) for i in ids], "random": [(r.choice(ids), r.choice(ids)) for _ in range(45)]}[shape]
    df = spark.createDataFrame([*edges, edges[0], (None, "x"), ("x", None)], "src string, dst string")
    want = union_find([(a, b) for a, b in edges if a != b])
    assert {r.node: r.root for r in components(df).collect()} == want


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "src string, dst string")).count() == 0


@pytest.mark.parametrize(
    "name,key",
    [
        ("ID3_20260518_125935.png", "d|3|20260518"), (" C:\\photos\\in\\id00003_1779108000000 (2).JPEG ", "d|3|20260518"), ("id3_1779108000.png", "d|3|20260518"), ("ID 3 20260518 125935_copy.png", "d|3|20260518"),
        ("ID3-20260518-125935-edited.png", "d|3|20260518"), ("/mnt/x.y/ID3_2026-05-18_12-59-35 - Copy (2).png", "d|3|20260518"), ("ID3_20261332_125935.png", "n|id3_20261332_125935"), ("IMG_0001(3).PNG", "n|img_0001"),
        ("front left 7.jpg", "n|front left 7"), ("img_0001", "n|img_0001"), (None, None), ("  ", None), ("Copy of a.png", "n|a"), ("ID3_123.png", "n|id3_123"),
    ],
)
def test_keys(spark, name, key):
    assert spark.createDataFrame([(name,)], "n string").select(S.session_key(F.col("n")).alias("k")).first().k == key


def links(spark, rows):
    return spark.createDataFrame(rows, "record_id long, key string").withColumn("split", F.lit("clash")).withColumn("group_id", F.lit(0))


def groups(state):
    return {r.record_id: r.group_id for r in state.records.collect()}


def test_groups_and_proportions(spark):
    r = random.Random(3)
    rows = [(i, f"k{r.randrange(900)}") for i in range(2000)] + [(i, "hot") for i in range(5000, 5600)] + [(9999, None), (9999, None)]
    state = S.assign_splits(links(spark, rows + rows[:50]), proportions={"train": 0.6, "validation": 0.2, "test": 0.2})
    want = union_find([(f"i{i:06d}", f"k{k}") for i, k in rows if k])
    got = groups(state)
    assert len(got) == 2601
    by_root = {}
    for i, _ in rows[:-2]:
        by_root.setdefault(want[f"i{i:06d}"], set()).add(i)
    assert all(got[i] == min(members) for members in by_root.values() for i in members)
    assert state.records.groupBy("group_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    shares = {r.split: r.n / 2601 for r in state.records.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert abs(shares["train"] - 0.6) < 0.02 and abs(shares["test"] - 0.2) < 0.02


def test_increments_keep_splits_and_quarantine_conflicts(spark, tmp_path):
    first = S.assign_splits(links(spark, [(i, f"k{i // 2}") for i in range(40)]))
    first.write(str(tmp_path / "v1"))
    state = S.SplitTables.read(spark, str(tmp_path / "v1"))
    before = {r.record_id: r.split for r in state.records.collect()}
    a = next(i for i in before if before[i] == "train")
    b = next(i for i in before if before[i] != "train")
    same = next(i for i in before if before[i] == "train" and i // 2 != a // 2)
    batch = [(100, f"k{a // 2}"), (100, f"k{b // 2}"), (101, f"k{same // 2}"), (102, "new"), (103, "new"), (104, None)]
    after = S.assign_splits(links(spark, batch), state)
    now = {r.record_id: (r.group_id, r.split) for r in after.records.collect()}
    quarantined = {i for i in before if i // 2 in (a // 2, b // 2)} | {100}
    assert {i for i, v in now.items() if v[1] == "quarantine"} == quarantined
    assert all(now[i][1] == before[i] for i in before if i not in quarantined)
    assert now[101] == (min(same // 2 * 2, same), "train") and now[102] == (102, now[103][1]) and now[104][0] == 104 and len(now) == 45
    third = S.assign_splits(links(spark, [(100, "late")]), after)
    again = {r.record_id: (r.group_id, r.split) for r in third.records.collect()}
    assert again == now
    assert groups(S.assign_splits(links(spark, []), after)) == {i: v[0] for i, v in now.items()}


def test_a_late_record_joins_two_earlier_groups_of_one_split(spark, tmp_path):
    first = S.assign_splits(links(spark, [(i, f"k{i}") for i in range(30)]))
    path = str(tmp_path / "state")
    assert first.write(path) == 0
    before = {r.record_id: r.split for r in S.SplitTables.read(spark, path).records.collect()}
    a, b = [i for i in before if before[i] == "train"][:2]
    second = S.assign_splits(links(spark, [(b, f"k{a}"), (77, f"k{b}"), (78, None)]), S.SplitTables.read(spark, path))
    assert second.write(path) == 1
    state = S.SplitTables.read(spark, path)
    now = {r.record_id: (r.group_id, r.split) for r in state.records.collect()}
    assert now[a] == now[b] == now[77] == (a, "train") and len(now) == 32
    assert sorted(r.record_id for r in S.groups_of_several(state).collect()) == sorted([a, b, 77])
    assert {i: now[i][1] for i in before} == before
    assert {(r.group_id, r.root, r.n) for r in state.groups.collect()} >= {(a, a, 3), (b, a, None)}


def test_empty(spark):
    assert S.groups_of_several(S.assign_splits(links(spark, []))).count() == 0
