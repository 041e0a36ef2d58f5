"""Schemas that drift between files (problem 5), by similarity flooding.

The top-level fields of each file are read through the structural index.  From
one file of a series to the next, the fields that end and the fields that begin
make two small schema graphs: fields hold words, members (one level of nesting)
with words of their own, kinds of content, values and types.  Match scores flood
over the graph of pairs until they settle.  Renamings are the one-to-one
correspondences that the flooded scores select, highest first, as far as the
content bears them out.  Correspondences of the whole corpus give one table with
the same columns and types for all files.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmeter.operators.structure import KINDS, NULL, OBJECT, Index, Members, _bytes, index, parts_of
from boxmeter.session import cut

#: Field: (name, type or None for null, JSON text).
Field = tuple[str, str | None, str]
_FIELDS = "array<struct<name:string,type:string,raw:string>>"
_FILES = f"run_id long, series string, written_at timestamp_ntz, fields {_FIELDS}"
# fixed values: words that join names without meaning
_JOINING = {"of", "at", "in", "the", "is", "to", "by", "for"}
_TIME = re.compile(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:Z|[+-]\d\d:?\d\d)?")


def words(name: str) -> set[str]:
    """The words of a field name, however it is spelled (snake, kebab, dotted, camel or upper case)."""
    parts = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", name)
    found = {w.lower() for w in re.findall(r"[^\W_]+", parts)}
    return found - _JOINING or found


def content(raw: str):
    """What a value says regardless of its type: a lone member or a name stands for its list or object, numbers for their texts, moments for Unix times."""
    v = _load(raw)
    for _ in range(4):
        if isinstance(v, str) and not isinstance(v, _Written) and v[:1] in "[{":
            try:
                v = _load(v)
            except (ValueError, RecursionError):
                break
        elif isinstance(v, list) and len(v) == 1:
            v = v[0]
        elif isinstance(v, dict) and isinstance(v.get("name"), (str, float)):
            v = v["name"]
        elif isinstance(v, dict) and len(v) == 1:
            v = next(iter(v.values()))
        else:
            break
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, str):
        s = v.strip()
        if re.fullmatch(r"v?[+-]?\d{1,300}(\.\d+)?", s, re.I | re.A):
            return float(s.lower().lstrip("v"))
        if s.lower() in ("true", "false"):
            return s.lower() == "true"
        if _TIME.fullmatch(s):
            try:
                t = datetime.fromisoformat(s)
                return ("time", (t if t.tzinfo else t.replace(tzinfo=UTC)).timestamp())
            except ValueError:
                pass
        return s
    if isinstance(v, float):
        # a number of this size may be a Unix time; it is of either kind
        return ("moment", v / 1000 if v > 1e11 else v) if 1e9 <= v < 1e10 or 1e12 <= v < 1e13 else v
    return json.dumps(v, sort_keys=True)


class _Written(str):
    """A JSON number as it is written."""


def _float(text: str):
    """The number, or its written form where a double cannot hold it."""
    x = float(text)
    return x if math.isfinite(x) else _Written(text)


def _load(raw: str):
    """A JSON value whose numbers are doubles; those that aren't finite stay as they are written."""
    return json.loads(raw, parse_int=_float, parse_float=_float)


def kind(value) -> str:
    """The kind of a content: time, moment (a number that may be one), number, flag, list or object, path, or text."""
    if value is None:
        return "null"
    if isinstance(value, tuple):
        return value[0]
    if isinstance(value, bool):
        return "flag"
    if isinstance(value, float):
        return "number"
    if value[:1] in "[{":
        return "nested"
    return "path" if "/" in value else "text"


#: What the comparisons need of a value: kind, digest of the content, names of its members.
Sign = tuple[str, str, tuple[str, ...]]
_SIGNED = "\0"


@lru_cache(maxsize=1 << 16)
def sign(raw: str) -> Sign:
    """The signature of a JSON text, or of a value that was signed before."""
    if raw[:1] == _SIGNED:
        k, digest, members = json.loads(raw[1:])
        return k, digest, tuple(members)
    try:
        value, whole = content(raw), _load(raw) if raw.lstrip()[:1] == "{" else None
    except RecursionError:  # nested too deep to look into
        value, whole = raw, None
    # moments compare equal to times, whatever they are written as
    said = repr(("time", value[1])) if isinstance(value, tuple) else repr(value)
    return kind(value), hashlib.md5(said.encode("utf-8", "surrogatepass")).hexdigest()[:16], tuple(whole) if isinstance(whole, dict) else ()


def signed(raw: str) -> str:
    """A JSON text as its signature, which is short and stands for it in comparisons."""
    return raw if raw[:1] == _SIGNED else _SIGNED + json.dumps(sign(raw))


def _same(a: Sign, b: Sign) -> bool:
    return a[0] != "null" and a[1] == b[1]


def _alike(a: Sign, b: Sign) -> bool:
    """The same kind of content; a number that may be a time is of both kinds, and a null of any."""
    x, y = {a[0]}, {b[0]}
    for s in (x, y):
        if "moment" in s:
            s |= {"time", "number"}
    return bool(x & y) or "null" in x | y


def _word_likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    return 0.7 * len(short) / len(long) + 0.2 if len(short) >= 3 and long.startswith(short) else 0.0


def _spread(holders: list[set[str]]) -> tuple[np.ndarray, list[str]]:
    """(fields, names): the share of each name in the field that holds it, and the names."""
    names = sorted({n for h in holders for n in h})
    has = np.array([[n in h for n in names] for h in holders], float).reshape(len(holders), len(names))
    return has / np.maximum(has.sum(1, keepdims=True), 1), names


def flood(gone: list[Field], come: list[Field], rounds: int = 60) -> np.ndarray:
    """Match scores of every (ending, beginning) pair of fields after flooding, the best is 1.

    Pairs of fields exchange scores with the pairs of their words and of their
    members; values, kinds and types give them what they start from.  Every
    round adds what flows in, lets the alternatives of a field share, and scales
    by the largest.
    """
    sa, sb = ([sign(f[2]) for f in side] for side in (gone, come))
    same_value = np.array([[_same(x, y) for y in sb] for x in sa], float)
    same_kind = np.array([[_alike(x, y) for y in sb] for x in sa], float)
    same_type = np.array([[f[1] == g[1] for g in come] for f in gone], float)
    shared = np.array([[bool(words(f[0]) & words(g[0])) for g in come] for f in gone], float)
    graphs = []
    for hold in (lambda f, s: words(f[0]), lambda f, s: {w for m in s[2] for w in words(m)}):
        a, left = _spread([hold(f, s) for f, s in zip(gone, sa)])
        b, right = _spread([hold(f, s) for f, s in zip(come, sb)])
        if left and right:
            graphs.append((a, b, np.array([[_word_likeness(p, q) for q in right] for p in left])))
    start = 2.0 * same_value + 2.0 * shared * same_kind + 0.3 * same_kind + 0.1 * same_type
    for a, b, like in graphs:
        start = start + 0.5 * a @ like @ b.T
    fields, pairs = start / max(start.max(), 1e-12), [like for _, _, like in graphs]
    for _ in range(rounds):
        new = start + fields
        for (a, b, _), p in zip(graphs, pairs):
            new = new + 0.5 * a @ p @ b.T
        # alternatives of the same field hold each other down
        new = new / np.sqrt(np.maximum(np.sqrt(new.sum(1, keepdims=True) * new.sum(0, keepdims=True)), 1e-12))
        new /= max(new.max(), 1e-12)
        pairs = [like * (1 + _scaled(a.T @ new @ b)) / 2 for a, b, like in graphs]
        done = np.abs(new - fields).max() < 1e-4
        fields = new
        if done:
            break
    return fields


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / max(x.max(), 1e-12)


#: A pair of fields below this share of the best score of a file does not correspond.
LEAST_SCORE = 0.1


def renamings(gone: list[Field], come: list[Field]) -> list[tuple[Field, Field]]:
    """One-to-one correspondences by falling flooded score, as far as they carry content on.

    That is: the same value, or the same kind of content under a name that shares a word.
    """
    if not gone or not come:
        return []
    score = flood(gone, come)
    out, used_i, used_j = [], set(), set()
    order = sorted((-score[i, j], gone[i][0], come[j][0], i, j) for i, j in zip(*np.nonzero(score > LEAST_SCORE)))
    for *_, i, j in order:
        if i in used_i or j in used_j:
            continue
        a, b = sign(gone[i][2]), sign(come[j][2])
        if _same(a, b) or words(gone[i][0]) & words(come[j][0]) and _alike(a, b):
            used_i.add(i)
            used_j.add(j)
            out.append((gone[i], come[j]))
    return out


#: What is known of a series behind a file: field name -> (last type or None, JSON text, name in the first file of the stretch or None).
State = dict[str, tuple[str | None, str, str | None]]


def step(state: State, fields: list[Field], changes_too: bool = True) -> tuple[list[tuple[str, str, str]], State]:
    """The changes (change, field, new_field) that a file makes, and the state behind it.

    The state alone needs the renamings only where a beginning field is null
    and takes its type from an ending one.
    """
    now = {f[0]: f for f in fields}
    gone = [(n, t, raw) for n, (t, raw, _) in state.items() if n not in now]
    come = [f for f in fields if f[0] not in state]
    pairs = renamings(gone, come) if changes_too or any(t is None for _, t, _ in come) else []
    came_from = {g[0]: f[0] for f, g in pairs}
    ended = {f[0] for f, _ in pairs}
    changes = [("removed", f[0], "") for f in gone if f[0] not in ended]
    changes += [("added", g[0], "") for g in come if g[0] not in came_from]
    changes += [("renamed", f[0], g[0]) for f, g in pairs]
    new: State = {}
    for name, (_, kind_now, raw) in now.items():
        before = state.get(came_from.get(name, name))
        last, origin = (before[0], before[2]) if before else (None, None)
        if kind_now and last and kind_now != last:
            changes.append(("type_changed", name, ""))
        new[name] = (kind_now or last, raw, None if kind_now else origin)
    return changes, new


def _first(fields: list[Field]) -> State:
    return {n: (t, raw, None if t else n) for n, t, raw in fields}


def _as_fields(value) -> list[Field]:
    return [(f["name"], f["type"], f["raw"]) for f in value]


def meta_fields(df: DataFrame, root: str = "meta") -> DataFrame:
    """(run_id, series, written_at, fields): the top-level fields of ``root`` in each whole file.

    Needs run_id, series, written_at, content.  Damaged and null contents give no
    row; of equal run_ids one whole delivery counts.  A file without an object
    ``root`` has no fields.  Of a repeated name the last counts.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (p for batch in batches for p in parts_of(batch, "content")):
            x = index(_bytes(b["content"]))
            inside = Members(x, 2)
            found: list = [None] * len(b)
            for top in inside[-1]:
                found[x.doc[top]] = _meta(x, inside, top, root)
            out = b[["run_id", "series", "written_at"]].copy()
            out["fields"] = found
            yield out[x.valid]

    files = df.filter("run_id IS NOT NULL AND content IS NOT NULL").select(
        F.col("run_id").cast("long").alias("run_id"), "series", F.col("written_at").cast("timestamp_ntz").alias("written_at"), "content"
    )
    read = files.mapInPandas(rows, _FILES)
    one = read.groupBy("run_id").agg(F.min(F.struct("written_at", "series", "fields")).alias("r"))
    return one.select("run_id", "r.series", "r.written_at", "r.fields")


def _meta(x: Index, inside: Members, top: int, root: str) -> list[dict]:
    for i in inside[top]:
        if x.key(i) == root and x.kind[i] == OBJECT:
            last = {x.key(j): j for j in inside[i]}
            return [
                {"name": n, "type": None if x.kind[j] == NULL else KINDS[x.kind[j]], "raw": x.raw(j).decode("utf-8", "replace")}
                for n, j in last.items()
            ]
    return []


def changes(files: DataFrame) -> DataFrame:
    """(run_id, change, field, new_field): every change of fields from one file of a series to the next.

    ``files`` as ``meta_fields`` gives them; order is written_at (null first),
    then run_id.  A null value has no type and is compared by the last value of
    the field that has one.  Files of a null series are a series of their own.
    A series may be of any length: files are sorted into range partitions, so
    that one series may span many, and only the state at their borders (one row
    per partition: names, types and signatures of the fields of a file) passes
    over the driver.
    """
    spark = files.sparkSession
    keyed = cut(_signed_fields(files)).select(F.coalesce("series", F.lit("")).alias("series_key"), "written_at", "run_id", "fields")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(
        keyed.repartitionByRange(parts, "series_key", "written_at", "run_id")
        .sortWithinPartitions("series_key", "written_at", "run_id")
        .withColumn("pid", F.spark_partition_id())
    )

    def border(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = series = pid = None
        many, state = False, {}
        for b in batches:
            for r in b.itertuples():
                fields = _as_fields(r.fields)
                if first is None:
                    first, pid = (r.series_key, fields), r.pid
                if r.series_key != series:
                    many = many or series is not None
                    series, state = r.series_key, _first(fields)
                else:
                    _, state = step(state, fields, False)
        if first is not None:
            yield pd.DataFrame({"pid": [pid], "r": [json.dumps([first, series, many, state])]})

    borders = {r["pid"]: json.loads(r["r"]) for r in ranged.mapInPandas(border, "pid int, r string").collect()}
    carried: dict[int, tuple[str, State]] = {}
    before: tuple[str, State] | None = None
    for pid in sorted(borders):
        (head, fields), series, many, state = borders[pid]
        state = {n: tuple(v) for n, v in state.items()}
        if before and before[0] == head:
            carried[pid] = before
            if not many:  # the whole partition goes on with the series: fields null since its start keep their earlier type
                _, entry = step(before[1], [tuple(f) for f in fields], False)
                state = {n: (t or (entry[o][0] if o in entry else None), raw, o) for n, (t, raw, o) in state.items()}
        before = (series, state)
    shared = spark.sparkContext.broadcast(carried)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, state = None, {}
        start = True
        for b in batches:
            out = []
            for r in b.itertuples():
                fields = _as_fields(r.fields)
                if start:
                    start = False
                    series, state = shared.value.get(r.pid, (None, {}))
                if r.series_key != series:
                    series, state = r.series_key, _first(fields)
                else:
                    found, state = step(state, fields)
                    out += [(r.run_id, *c) for c in found]
            yield pd.DataFrame(out, columns=["run_id", "change", "field", "new_field"], dtype=object)

    return ranged.mapInPandas(run, "run_id long, change string, field string, new_field string")


def _signed_fields(files: DataFrame) -> DataFrame:
    """The files with signatures in place of values: what the comparisons need, and all that is moved for them."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(fields=[[{"name": n, "type": t, "raw": signed(raw)} for n, t, raw in _as_fields(f)] for f in b["fields"]])

    return files.select("run_id", "series", "written_at", "fields").mapInPandas(rows, _FILES)


#: A table of more columns than this is not planned.
MOST_NAMES = 20_000


def canonical_names(files: DataFrame, found: DataFrame) -> dict[str, str]:
    """Every field name with the name of its column: the most frequent name among those that renamings join.

    The names become the columns of a table; of more than ``MOST_NAMES`` no plan
    can be made, which is an error that says how many there are.
    """
    n_names = files.select(F.explode("fields.name").alias("name")).distinct().count()
    if n_names > MOST_NAMES:
        raise ValueError(f"{n_names} different field names: these are data, not fields")
    counts = {r["name"]: r["n"] for r in files.select(F.explode("fields.name").alias("name")).groupBy("name").agg(F.count("*").alias("n")).collect()}
    links = found.filter("change = 'renamed'").groupBy("field", "new_field").agg(F.count("*").alias("n")).collect()
    root = {n: n for n in counts}

    def find(n: str) -> str:
        while root.setdefault(n, n) != n:
            n = root[n]
        return n

    for r in sorted(links, key=lambda r: (r["field"], r["new_field"])):
        a, b = find(r["field"]), find(r["new_field"])
        if a != b:
            best, other = sorted((a, b), key=lambda n: (-counts.get(n, 0), n))
            root[other] = best
    return {n: find(n) for n in counts}


_PLAIN = re.compile(r"-?\d{1,15}(\.\d+)?")


def _moment(v) -> str | None:
    """A time of a text or a Unix time in UTC, else None."""
    s = str(v).strip()
    try:
        if _TIME.fullmatch(s):
            t = datetime.fromisoformat(s)
            t = t.astimezone(UTC) if t.tzinfo else t.replace(tzinfo=UTC)
        elif _PLAIN.fullmatch(s) and isinstance(content(s), tuple):
            t = datetime.fromtimestamp(content(s)[1], UTC)
        else:
            return None
    except (ValueError, OverflowError):
        return None
    return t.replace(tzinfo=None).isoformat() + "Z"


def _written(v) -> str:
    """The text of a string, else the JSON text."""
    if isinstance(v, str):
        return str(v)
    return json.dumps(v, ensure_ascii=False)


def _numbers(v):
    """Numbers as they are written made numbers again, within containers."""
    if isinstance(v, _Written):
        return json.loads(v) if len(v) < 4000 else str(v)  # longer integers are not numbers to Python
    if isinstance(v, list):
        return [_numbers(x) for x in v]
    return {k: _numbers(x) for k, x in v.items()} if isinstance(v, dict) else v


def cells_of(raw: str) -> dict[str, str]:
    """The texts of a value by member: "" holds the value itself, or what stands for a list or object; every other member stands under its name.

    A lone member stands for its list, a plain ``name`` or a lone member for its
    object (the lone member also under its name), as in ``content``, but nothing
    is cast: numbers and texts stay as they are written.  Other lists and objects
    stand as JSON text.  Null has no text.
    """
    load = lambda s: json.loads(s, parse_int=_Written, parse_float=_Written)
    out: dict[str, str] = {}
    v, prefix, plain = load(raw), "", True
    for _ in range(4):
        if isinstance(v, str) and not isinstance(v, _Written) and v[:1] in "[{":
            try:
                inner = load(v)
            except ValueError:
                break
            v, plain = inner, False
        elif isinstance(v, list) and len(v) == 1:
            v, plain = v[0], False
        elif isinstance(v, dict) and isinstance(v.get("name"), str) or isinstance(v, dict) and len(v) == 1:
            name = "name" if isinstance(v.get("name"), str) else next(iter(v))
            rest = v if name != "name" else {k: x for k, x in v.items() if k != "name"}
            out |= {f"{prefix}.{k}": _written(_numbers(x) if isinstance(x, (list, dict)) else x) for k, x in rest.items() if x is not None}
            prefix, v, plain = f"{prefix}.{name}", v[name], False
        else:
            break
    if v is not None:
        out[""] = raw if plain and isinstance(v, (list, dict)) else _written(_numbers(v) if isinstance(v, (list, dict)) else v)
    return out


def unified(files: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row per file with the same columns and types: run_id, series, written_at and a column per field.

    A column is double or boolean where every value is one, else string; times
    are in UTC where all values of a column are times.  The name of an object
    and a lone member stand for it in the column, its other members have columns
    ``column.member`` (``cells_of``).  Where a file holds two fields of a column,
    the one of the column's own name counts there, and another stands in the
    column of its own name.  Columns whose names differ in case only are
    numbered.
    """
    spark = files.sparkSession
    shared = spark.sparkContext.broadcast(names)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to = shared.value
        for b in batches:
            out, moments = [], []
            for fields in b["fields"]:
                row: dict[str, str] = {}
                taken: set[str] = set()
                for n, t, raw in sorted(_as_fields(fields), key=lambda f: (f[0] != to.get(f[0]), f[0])):
                    if t is None:
                        continue
                    column = to.get(n, n)
                    if column in taken:
                        column = n
                    taken.add(column)
                    for member, text in cells_of(raw).items():
                        name = column + member
                        while name in row:  # a field may be named like a member
                            name += "_"
                        row[name] = text
                out.append(row)
                moments.append({n: m for n, x in row.items() if (m := _moment(x))})
            done = b[["run_id", "series", "written_at"]].copy()
            done["cells"], done["moments"] = out, moments
            yield done

    cells = cut(files.mapInPandas(rows, "run_id long, series string, written_at timestamp_ntz, cells map<string,string>, moments map<string,string>"))
    text = F.trim("text")
    each = cells.select(F.explode("cells").alias("name", "text"), "moments").withColumn("moment", F.try_element_at("moments", F.col("name")))
    kinds = each.groupBy("name").agg(
        # more digits than a double holds stay text
        F.bool_and(text.rlike(r"^[+-]?\d+(\.\d+)?([eE][+-]?\d{1,2})?$") & (F.length(F.regexp_replace(F.regexp_replace(text, "[eE].*", ""), r"\D", "")) <= 15)).alias("number"),
        F.bool_and(F.lower(text).isin("true", "false")).alias("flag"),
        (F.bool_and(F.col("moment").isNotNull()) & F.bool_or(text.contains(":"))).alias("time"),
    )
    types = {r["name"]: "double" if r["number"] else "boolean" if r["flag"] else "time" if r["time"] else "string" for r in kinds.collect()}
    used, columns = {"run_id", "series", "written_at"}, []
    for n, t in sorted(types.items()):
        name, k = n if n.lower() not in used else f"meta_{n}", 2
        while name.lower() in used:
            name, k = f"{n}_{k}", k + 1
        used.add(name.lower())
        columns.append(F.try_element_at("moments" if t == "time" else "cells", F.lit(n)).try_cast("string" if t == "time" else t).alias(name))
    return cells.select("run_id", "series", "written_at", *columns)
