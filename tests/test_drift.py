import json
from datetime import datetime, timedelta

import pytest

from boxmeter.operators import drift as D

T0 = datetime(2026, 1, 1)


def files(spark, metas, series="s"):
    rows = [(i + 1, series, T0 + timedelta(days=i), m if isinstance(m, str) else json.dumps({"meta": m, "predictions": {}})) for i, m in enumerate(metas)]
    return spark.createDataFrame(rows, "run_id long, series string, written_at timestamp_ntz, content string").selectExpr("*", "0 AS fields", "0 AS pid")


def found(spark, metas):
    df = files(spark, metas)
    return {tuple(r) for r in D.changes(D.meta_fields(df)).collect()}


def test_each_change(spark):
    got = found(spark, [{"a": 1, "model": "x"}, {"a": "1", "model": "x", "seed": 5}, {"a": "1", "modelId": "x"}, "{broken", {"a": None, "modelId": "x"}, {"a": 2, "modelId": "x"}])
    assert got == {(2, "type_changed", "a", ""), (2, "added", "seed", ""), (3, "removed", "seed", ""), (3, "renamed", "model", "modelId"), (6, "type_changed", "a", "")}


def test_renamed_with_another_type_gives_two_rows(spark):
    got = found(spark, [{"prompt_version": "v17"}, {"promptVersion": 17}])
    assert got == {(2, "renamed", "prompt_version", "promptVersion"), (2, "type_changed", "promptVersion", "")}


def test_null_keeps_the_last_type_through_a_renaming(spark):
    got = found(spark, [{"max_tries": 3}, {"max_tries": None}, {"max_attempts": None}, {"max_attempts": "3"}])
    assert (3, "renamed", "max_tries", "max_attempts") in got and (4, "type_changed", "max_attempts", "") in got


@pytest.mark.parametrize(
    "gone,come,pairs",
    [
        ([("started", "string", '"2026-01-01T00:00:00+00:00"')], [("run_started", "number", "1767300000")], [("started", "run_started")]),
        ([("max_attempts", "number", "1")], [("dry_run", "boolean", "true")], []),
        ([("seed", "number", "7")], [("workers", "number", "8")], []),
        ([("model", "string", '"m"'), ("model_client", "string", '"c"')], [("model_name", "string", '"m"'), ("client_name", "object", '{"name": "c"}')], [("model", "model_name"), ("model_client", "client_name")]),
        ([("a", "null", "null")], [("b", "null", "null")], []),
    ],
)
def test_correspondences(gone, come, pairs):
    named = lambda side: [(n, None if t == "null" else t, raw) for n, t, raw in side]
    assert sorted((f[0], g[0]) for f, g in D.renamings(named(gone), named(come))) == pairs


def test_a_long_series_spans_partitions(spark):
    metas = []
    for i in range(60):
        m = {"a": i, "keep": None if 5 < i < 50 else ("x" if i < 30 else 1)}
        if i % 7 == 0:
            m["extra"] = i
        metas.append(m)
    df = D.meta_fields(files(spark, metas))
    state, want = None, set()
    for i, m in enumerate(metas):
        fields = [(k, {int: "number", str: "string"}.get(type(v)), json.dumps(v)) for k, v in m.items()]
        if state is None:
            state = D._first(fields)
        else:
            changes, state = D.step(state, fields)
            want |= {(i + 1, *c) for c in changes}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {tuple(r) for r in D.changes(df).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == want and (51, "type_changed", "keep", "") in got


def test_one_table(spark):
    df = D.cut(D.meta_fields(files(spark, [{"model": "m", "n": 1, "on": True}, {"modelId": ["m"], "n": "2", "on": False}, {}, "x"])))
    table = D.unified(df, D.canonical_names(df, D.changes(df)))
    assert table.dtypes[3:] == [("model", "string"), ("n", "double"), ("on", "boolean")]
    rows = table.orderBy("run_id").collect()
    assert [(r.model, r.n, r.on) for r in rows] == [("m", 1.0, True), ("m", 2.0, False), (None, None, None)]


def test_the_table_keeps_every_member(spark):
    metas = [
        {"detector": {"name": "boxer-0", "conf": 0.25}, "version": "v10", "id": 12345678901234567890, "at": "2026-01-15T06:23:21.5+02:00", "opts": {"depth": 3}, "tags": ["a", "b"]},
        {"detector": '{"name": "lumen-2", "rev": [1, 2]}', "version": 10, "id": 7, "at": 1768451002, "opts": {"depth": 4}, "seed": 1768451002, "seed.x": "a", "SEED": "b"},
    ]
    table = D.unified(df := D.cut(D.meta_fields(files(spark, metas))), {n: n for m in metas for n in m})
    assert df.count() == 2
    got = [{k: v for k, v in r.asDict().items() if v is not None and k not in ("run_id", "series", "written_at")} for r in table.orderBy("run_id").collect()]
    assert got == [
        {"detector": "boxer-0", "detector.conf": 0.25, "version": "v10", "id": "12345678901234567890", "at": "2026-01-15T04:23:21.500000Z", "opts": 3.0, "opts.depth": 3.0, "tags": '["a", "b"]'},
        {"detector": "lumen-2", "detector.rev": "[1, 2]", "version": "10", "id": "7", "at": "2026-01-15T04:23:22Z", "opts": 4.0, "opts.depth": 4.0, "meta_seed": 1768451002.0, "seed.x": "a", "SEED": "b"},
    ]


def test_two_fields_of_a_column_are_both_kept(spark):
    df = D.cut(D.meta_fields(files(spark, [{"model": "a", "modelId": {"name": "b", "rev": 1}}, {"modelId": "c"}])))
    rows = D.unified(df, {"model": "model", "modelId": "model"}).orderBy("run_id").collect()
    assert [(r["model"], r["modelId"], r["modelId.rev"]) for r in rows] == [("a", "b", 1.0), ("c", None, None)]


def test_copies_nulls_and_empty(spark):
    one = files(spark, [{"a": 1}, {"b": "x"}])
    got = D.changes(D.meta_fields(one.union(one).union(one.selectExpr("run_id", "series", "written_at", "'{' AS content", "fields", "pid")))).count()
    assert got == 2
    none = spark.createDataFrame([], one.schema)
    assert D.changes(D.meta_fields(none)).count() == 0
    files_ = D.meta_fields(none)
    assert D.unified(files_, D.canonical_names(files_, D.changes(files_))).columns == ["run_id", "series", "written_at"]
    no_series = files(spark, [{"a": 1}, {}], None)
    assert [r.change for r in D.changes(D.meta_fields(no_series)).collect()] == ["removed"]


def test_words():
    assert D.words("maxAttempts") == {"max", "attempts"} and D.words("PROMPT_VERSION") == {"prompt", "version"} and D.words("version_of_prompt") == {"version", "prompt"}


def test_the_flooded_score_selects(spark, monkeypatch):
    import numpy as np

    metas = [{"model": "a", "prompt_version": "v1"}, {"model_name": "a", "version": 1}]
    assert {c[1] for c in found(spark, metas)} >= {"renamed"}
    gone, come = ([(k, "string", json.dumps(v)) for k, v in m.items()] for m in metas)
    assert len(D.renamings(gone, come)) == 2
    monkeypatch.setattr(D, "flood", lambda a, b: np.zeros((len(a), len(b))))
    assert D.renamings(gone, come) == []


def test_members_tell_objects_apart(monkeypatch):
    gone = [("options", "object", '{"depth": 3, "beam": 2}'), ("limits_options", "object", '{"calls": 3, "seconds": 9}')]
    come = [("new_options", "object", '{"calls": 4, "seconds": 8}'), ("old_options", "object", '{"depth": 5, "beam": 1}')]
    assert {(f[0], g[0]) for f, g in D.renamings(gone, come)} == {("options", "old_options"), ("limits_options", "new_options")}


def test_any_legal_json_has_a_content(spark):
    for raw in ("1" * 400, "1" * 5000, "-" + "9" * 6000 + ".5e3", '"' + "7" * 9000 + '"', "[" * 3000 + "]" * 3000, '"\\ud800"', "1e999", '{"name": 12}', "2e9"):
        assert D.sign(raw)[0]
        assert D.sign(D.signed(raw)) == D.sign(raw)
    assert D._alike(D.sign("2000000000"), D.sign("900000000")) and D._alike(D.sign("1767300000"), D.sign('"2026-01-01T00:00:00Z"')) and not D._alike(D.sign("5"), D.sign('"2026-01-01T00:00:00Z"'))
    assert D._same(D.sign("1767225600"), D.sign('"2026-01-01T00:00:00Z"'))
    text = '{"meta": {"n": ' + "1" * 5000 + '}, "predictions": {}}'
    df = D.cut(D.meta_fields(files(spark, [{"n": 1}, text])))
    assert [r.n for r in D.unified(df, {"n": "n"}).orderBy("run_id").collect()] == ["1", "1" * 5000]
