"""Rows that fail to parse (problem 3): a minimum-cost error parse of separated lines.

A line is a walk through four modes (start of a cell, inside a bare cell, inside
a quoted cell, behind a closing quote) and a count of cells.  Edits insert or
delete a quote or a separator, each at cost one; dynamic programming over
(mode, cells) finds the cheapest walk to exactly the wanted number of cells, for
all lines of a batch at once.  A line whose walk has cost zero and whose cells
are valid values loads; for every other line the edit costs give the reason
(quoting where no number of cells comes without edits, columns where only the
wanted number does not) and the cheapest edits say how it could be mended.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmeter.schemas import ENUMS, SHEET_COLUMNS

START, BARE, QUOTED, CLOSED = range(4)
_Q, _S, _O, _END = range(4)
#: Costs are packed as total, inserted quotes, deleted quotes, inserted and deleted separators, so that a minimum is also the tally of its edits.
_BITS = 12
_WIDE_BITS = 40
#: Symbols of a group of lines that are walked together.
_CELLS = 1 << 18
#: Symbols of a line that the narrow counters serve.
_NARROW = 4096
_UNIT = 1 << (4 * _BITS)
_NEVER = np.int64(1) << 62
_EDIT_NAMES = [("insert quote", 3), ("delete quote", 2), ("insert separator", 1), ("delete separator", 0)]
_ID = re.compile(r"0*[1-9][0-9]*")
_SIZE = re.compile(r"[0-9]+(?:\.[0-9]+)?")


def symbols(line: str, sep: str) -> np.ndarray:
    """The line as quote, separator and runs of anything else."""
    flat = re.sub(f'[^"{re.escape(sep)}]+', "o", line)
    codes = np.full(len(flat), _O, np.int8)
    raw = np.frombuffer(flat.encode("ascii", "replace"), np.uint8)
    codes[raw == 34] = _Q
    codes[raw == ord(sep)] = _S
    return codes


def _padded(lines: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(lines), max((len(x) for x in lines), default=0)), _END, np.int8)
    for i, x in enumerate(lines):
        out[i, : len(x)] = x
    return out


# mode after a symbol without any edit, -1: the walk breaks
_STEP = np.array([[QUOTED, START, BARE, START], [-1, START, BARE, BARE], [CLOSED, QUOTED, QUOTED, QUOTED], [QUOTED, START, -1, CLOSED]])


def unedited(lines: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(whole, cells): whether the walk without edits gets through, and how many cells it passes."""
    table = _padded(lines)
    mode = np.zeros(len(lines), np.int64)
    whole = np.ones(len(lines), bool)
    cells = np.ones(len(lines), np.int64)
    for j in range(table.shape[1]):
        s = table[:, j]
        after = _STEP[mode, s]
        whole &= after >= 0
        cells += (s == _S) & (mode != QUOTED)
        mode = np.where(after >= 0, after, mode)
    return whole & (mode != QUOTED), cells


def cheapest_edits(lines: list[np.ndarray], cells: int, bits: int = _BITS) -> np.ndarray:
    """The packed cost of the cheapest edits that make each line ``cells`` well-quoted cells."""
    return edit_costs(lines, cells, bits)[:, cells - 1]


def edit_costs(lines: list[np.ndarray], cells: int, bits: int = _BITS) -> np.ndarray:
    """(lines, cells + 1): the packed cost of the cheapest edits that make each line 1, 2, ... ``cells`` or more well-quoted cells.

    Counters of more than ``_BITS`` are Python integers, which have no bound.
    """
    kind, never = (np.int64, _NEVER) if bits <= _BITS else (object, _never(bits))
    ins_q, del_q, ins_s, del_s = ((1 << (4 * bits)) + (1 << (bits * k)) for k in (3, 2, 1, 0))
    table = _padded(lines)
    b, width = table.shape
    cost = np.full((b, 4, cells + 1), never, kind)  # the last place: more cells than wanted
    cost[:, START, 0] = 0

    def add(a: np.ndarray, edit: int) -> np.ndarray:
        return np.where(a < never, a + edit, never)

    def insert(c: np.ndarray) -> None:
        """Insertions between two symbols; a separator moves one cell on, so cells go in order."""
        for k in range(cells + 1):
            for _ in range(2):
                c[:, QUOTED, k] = np.minimum(c[:, QUOTED, k], add(c[:, START, k], ins_q))
                c[:, CLOSED, k] = np.minimum(c[:, CLOSED, k], add(c[:, QUOTED, k], ins_q))
                c[:, QUOTED, k] = np.minimum(c[:, QUOTED, k], add(c[:, CLOSED, k], ins_q))
            if k < cells:
                least = c[:, [START, BARE, CLOSED], k].min(axis=1)
                c[:, START, k + 1] = np.minimum(c[:, START, k + 1], add(least, ins_s))

    insert(cost)
    for j in range(width):
        s = table[:, j]
        new = np.full_like(cost, never)
        shift = np.full((b, cells + 1), never, kind)
        left = cost[:, [START, BARE, CLOSED]].min(axis=1)
        shift[:, 1:] = left[:, :-1]
        shift[:, cells] = np.minimum(shift[:, cells], left[:, cells])
        q, sep, other = (s == k for k in (_Q, _S, _O))
        new[q, QUOTED] = np.minimum(cost[q, START], cost[q, CLOSED])
        new[q, CLOSED] = cost[q, QUOTED]
        new[q] = np.minimum(new[q], add(cost[q], del_q))
        new[sep, START] = shift[sep]
        new[sep, QUOTED] = cost[sep, QUOTED]
        for m in (START, BARE, CLOSED):
            new[sep, m] = np.minimum(new[sep, m], add(cost[sep, m], del_s))
        new[other, BARE] = np.minimum(cost[other, START], cost[other, BARE])
        new[other, QUOTED] = cost[other, QUOTED]
        live = s != _END
        part = new[live]
        insert(part)
        cost[live] = part
    return cost[:, [START, BARE, CLOSED]].min(axis=1)


def _never(bits: int) -> int:
    return 1 << (6 * bits)


def edit_text(packed: int, bits: int = _BITS) -> str:
    """The edits of a packed cost in words, such as ``insert quote 1``."""
    if packed >= (_NEVER if bits <= _BITS else _never(bits)):
        return ""
    tally = [(name, (packed >> (bits * k)) & ((1 << bits) - 1)) for name, k in _EDIT_NAMES]
    return "; ".join(f"{name} {n}" for name, n in tally if n)


def split_cells(line: str, sep: str) -> list[str]:
    """The cells of a well-quoted line, quotes removed."""
    if '"' not in line:
        return line.split(sep)
    found = re.findall(f'(?:^|{re.escape(sep)})("(?:[^"]|"")*"|[^"{re.escape(sep)}]*)', line)
    return [c[1:-1].replace('""', '"') if c[:1] == '"' else c for c in found]


def bad_values(cells: list[str]) -> list[str]:
    """Names of the columns whose value is not allowed."""
    v = dict(zip(SHEET_COLUMNS, (c.strip(" ") for c in cells)))
    bad = [c for c in ("image_id", "annotation_id") if not _ID.fullmatch(v[c])]
    bad += [c for c in ("bbox_x", "bbox_y", "bbox_w", "bbox_h") if not _SIZE.fullmatch(v[c])]
    bad += [c for c in ("bbox_w", "bbox_h") if c not in bad and not float(v[c])]
    bad += [c for c, allowed in ENUMS.items() if v[c] not in allowed and (v[c] or c == "damage_type")]
    return bad


def is_header(line: str) -> bool:
    line = line.lstrip("﻿")
    return any(
        [c.strip().strip('"').lower() for c in line.split(sep)] == SHEET_COLUMNS for sep in ";,"
    )


def _groups(walk: list[int], sizes: list[int]) -> Iterator[list[int]]:
    """Lines of rising length in groups that stay below ``_CELLS`` when they are padded to the longest; a longer line goes alone."""
    group: list[int] = []
    for i, size in zip(walk, sizes):
        if group and ((len(group) + 1) * size > _CELLS or len(group) == 512):
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def _parse(lines: list[str], seps: list[str], max_symbols: int | None) -> list[tuple]:
    """(cells, reason, detail, edits) of each line; reason 'header' or 'blank' marks lines that are no rows."""
    out: list[tuple | None] = [None] * len(lines)
    walk: list[int] = []
    for i, line in enumerate(lines):
        if line is None or not line.strip("﻿ \t\r\n\v\f\xa0"):
            out[i] = (None, "blank", None, None)
        elif is_header(line):
            out[i] = (None, "header", None, None)
        elif '"' not in line and line.count(seps[i]) == len(SHEET_COLUMNS) - 1:
            pass  # no quote and the right number of separators: cost zero
        else:
            walk.append(i)
    walk.sort(key=lambda i: len(lines[i]))
    for some in _groups(walk, [len(lines[i]) for i in walk]):
        sym = [symbols(lines[i], seps[i]) for i in some]
        # the layer of cost zero first: what gets through it needs no edits
        whole, cells = unedited(sym)
        broken = [k for k in range(len(some)) if not whole[k] or cells[k] != len(SHEET_COLUMNS)]
        short = [k for k in broken if len(sym[k]) <= min(_NARROW, max_symbols or _NARROW)]
        costs = {k: (c, _BITS) for k, c in zip(short, edit_costs([sym[k] for k in short], len(SHEET_COLUMNS)))} if short else {}
        for k in broken:
            if k not in costs and (max_symbols is None or len(sym[k]) <= max_symbols):  # a long line goes alone, with wider counters
                costs[k] = (edit_costs([sym[k]], len(SHEET_COLUMNS), _WIDE_BITS)[0], _WIDE_BITS)
        for k in broken:
            edits = None
            if k in costs:
                # quotes are at fault where no number of cells is to be had without edits
                cost, bits = costs[k]
                reason = "quoting" if min(cost.tolist()) >= 1 << (4 * bits) else "columns"
                edits = edit_text(int(cost[len(SHEET_COLUMNS) - 1]), bits)
            else:
                reason = "columns" if whole[k] else "quoting"
            out[some[k]] = (None, reason, None if reason == "quoting" else str(int(cells[k])), edits)
    for i, line in enumerate(lines):
        if out[i] is None:
            cells = split_cells(line, seps[i])
            bad = bad_values(cells)
            out[i] = (cells, "value", ",".join(bad), None) if bad else (cells, None, None, None)
    return out


def parse_lines(df: DataFrame, max_symbols: int | None = _NARROW) -> DataFrame:
    """Parse the sheet lines of ``df`` (sheet, line_no, raw, received_at).

    Result, one row per line that is neither header nor blank: sheet, line_no,
    cells (null where the line has no cells), reason (null: loads; quoting,
    columns or value), detail (number of cells, or the columns with bad values)
    and edits (the cheapest mend; null where a line has more than
    ``max_symbols`` quotes, separators and runs between them, never if that is
    None: lines beyond ``_NARROW`` go alone with wider counters, in time that
    grows with their length).  The separator is
    the one that line 1 of the sheet has more of, ``;`` on ties and where line 1
    is missing.  Of several deliveries of a line the first received counts.
    Null lines are blank.
    """
    lines = (
        df.filter("sheet IS NOT NULL AND line_no IS NOT NULL")
        .groupBy("sheet", "line_no")
        .agg(F.min_by("raw", F.struct(F.coalesce("received_at", F.lit("9999-12-31").cast("timestamp_ntz")), "raw")).alias("raw"))
    )
    commas, semis = (F.length(F.regexp_replace("raw", f"[^{c}]", "")) for c in ",;")
    first = df.filter("line_no = 1 AND raw IS NOT NULL").groupBy("sheet").agg(F.min(F.when(semis >= commas, ";").otherwise(",")).alias("sep"))
    # one small row per sheet; Spark broadcasts them only while they are small
    joined = lines.join(first, "sheet", "left").select("sheet", "line_no", "raw", F.coalesce("sep", F.lit(";")).alias("sep"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [None if x is None or x != x else x for x in b["raw"]]
            done = pd.DataFrame(_parse(raw, b["sep"].tolist(), max_symbols), columns=["cells", "reason", "detail", "edits"], dtype=object)
            done.insert(0, "sheet", b["sheet"].to_numpy())
            done.insert(1, "line_no", b["line_no"].to_numpy())
            yield done[~done["reason"].isin(["header", "blank"])]

    return joined.mapInPandas(
        rows, "sheet string, line_no long, cells array<string>, reason string, detail string, edits string"
    )


def loaded(parsed: DataFrame) -> DataFrame:
    """The typed label rows; empty cells are null."""
    kinds = {"image_id": "long", "annotation_id": "long"} | {c: "double" for c in SHEET_COLUMNS if c.startswith("bbox_")}
    cell = {c: F.nullif(F.trim(F.col("cells")[i]), F.lit("")) for i, c in enumerate(SHEET_COLUMNS)}
    return parsed.filter("reason IS NULL").select(
        "sheet", "line_no", *[(cell[c].try_cast(kinds[c]) if c in kinds else cell[c]).alias(c) for c in SHEET_COLUMNS]
    )


def rejected(parsed: DataFrame) -> DataFrame:
    """The failed lines with the reason, its detail and the cheapest mend."""
    return parsed.filter("reason IS NOT NULL").select("sheet", "line_no", "reason", "detail", "edits")
