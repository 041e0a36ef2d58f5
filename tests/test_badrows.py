import itertools
import random

import pytest

from boxmeter.operators import badrows as B

GOOD = "1;a.png;2;crack;1;2.5;3;4;door;minor;repair;ok"


def brute_edits(line: str, sep: str, cells: int, most: int) -> int | None:
    """Fewest single insertions and deletions of quotes and separators that make the line parse."""
    seen, layer = {line}, {line}
    for cost in range(most + 1):
        for s in layer:
            whole, n = B.unedited([B.symbols(s, sep)])
            if whole[0] and n[0] == cells:
                return cost
        new = set()
        for s in layer:
            for i in range(len(s) + 1):
                new |= {s[:i] + c + s[i:] for c in ('"', sep)}
                if i < len(s) and s[i] in ('"', sep):
                    new.add(s[:i] + s[i + 1 :])
        layer = new - seen
        seen |= layer
    return None


def test_cheapest_edits_equal_a_search():
    r = random.Random(2)
    for _ in range(120):
        line = "".join(r.choice('a";') for _ in range(r.randint(0, 6)))
        want = brute_edits(line, ";", 3, 3)
        got = int(B.cheapest_edits([B.symbols(line, ";")], 3)[0]) // B._UNIT
        assert want is None and got > 3 or got == want, line


def test_edit_words():
    sym = [B.symbols('a;"b', ";")]
    assert B.edit_text(int(B.cheapest_edits(sym, 2)[0])) in ("insert quote 1", "delete quote 1")
    assert B.edit_text(int(B.cheapest_edits([B.symbols("a", ";")], 3)[0])) == "insert separator 2"
    assert B.edit_text(int(B._NEVER)) == ""


@pytest.mark.parametrize(
    "change,reason",
    [
        ({}, None), ({11: '"a;b ""c"" \n d"'}, None), ({8: "", 9: "", 10: ""}, None), ({8: " door "}, None), ({0: "007"}, None),
        ({11: '"open'}, "quoting"), ({11: 'size 5"'}, "quoting"), ({11: '"x" y'}, "quoting"), ({11: ' "x"'}, "quoting"), ({11: "a;b"}, "columns"),
        ({0: "0"}, "value"), ({0: "-1"}, "value"), ({2: "٣"}, "value"), ({4: "1e3"}, "value"), ({4: ".5"}, "value"), ({4: "5."}, "value"), ({6: "0.0"}, "value"),
        ({3: ""}, "value"), ({3: "dent"}, "value"), ({9: "Minor"}, "value"), ({10: "n/a"}, "value"), ({4: ""}, "value"),
    ],
)
def test_reasons(change, reason):
    cells = GOOD.split(";")
    for i, v in change.items():
        cells[i] = v
    got = B._parse([";".join(cells)], [";"], 4096)[0]
    assert got[1] == reason


def test_sheets(spark):
    head = ";".join(B.SHEET_COLUMNS)
    rows = [
        ("s", 1, "﻿" + head, None), ("s", 2, GOOD, None), ("s", 2, GOOD, None), ("s", 3, head, None), ("s", 4, "  ", None), ("s", 5, None, None), ("s", 6, "...", None),
        ("t", 1, head.replace(";", ","), None), ("t", 2, GOOD.replace(";", ","), None), ("t", 3, GOOD, None), ("u", 2, GOOD, None), (None, 2, GOOD, None), ("u", None, GOOD, None),
        ("v", 1, GOOD, None), ("u", 9, '"' + "x;" * 20000, None),
    ]
    df = spark.createDataFrame(rows, "sheet string, line_no long, raw string, received_at timestamp_ntz").selectExpr("*", "1 AS reason", "2 AS cells")
    parsed = B.parse_lines(df)
    bad = {(r.sheet, r.line_no): (r.reason, r.edits) for r in B.rejected(parsed).collect()}
    assert bad == {("s", 6): ("columns", "insert separator 11"), ("t", 3): ("columns", "insert separator 11"), ("u", 9): ("quoting", None)}
    good = B.loaded(parsed).orderBy("sheet", "line_no").collect()
    assert [(r.sheet, r.line_no) for r in good] == [("s", 2), ("t", 2), ("u", 2), ("v", 1)]
    assert (good[0].image_id, good[0].bbox_y, good[0].comment) == (1, 2.5, "ok")


def test_empty_table(spark):
    df = spark.createDataFrame([], "sheet string, line_no long, raw string, received_at timestamp_ntz")
    assert B.parse_lines(df).count() == 0


def test_header_forms():
    head = B.SHEET_COLUMNS
    assert B.is_header("﻿" + ",".join(head)) and B.is_header(";".join(f'"{c}"' for c in head)) and not B.is_header(GOOD)
    assert list(itertools.chain(B.split_cells('"a;b";c', ";"))) == ["a;b", "c"]


def test_long_lines_have_edits_too():
    for line in ('a;"b', 'a"b;c;d"', '";;"x";', "a;b;c;d"):
        sym = [B.symbols(line, ";")]
        assert B.edit_text(B.cheapest_edits(sym, 3, B._WIDE_BITS)[0], B._WIDE_BITS) == B.edit_text(int(B.cheapest_edits(sym, 3)[0]))
    assert B._parse([";" * 5010], [";"], None) == [(None, "columns", "5011", "insert quote 2")]
    assert B._parse([";" * 5010], [";"], 6000)[0][3] == "insert quote 2" and B._parse([";" * 5010], [";"], 4096)[0][3] is None


def test_the_edits_query_mends_long_lines(spark, tmp_path):
    from boxmeter.plans import data_queries

    df = spark.createDataFrame([("u", 9, ";" * 5010, None)], "sheet string, line_no long, raw string, received_at timestamp_ntz")
    df.write.parquet(f"{tmp_path}/label_lines.parquet")
    assert [r.edits for r in data_queries.p3_edits(spark, str(tmp_path)).collect()] == ["insert quote 2"]
