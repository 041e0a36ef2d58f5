"""Nested records as related flat tables (problem 2), by structural indexing of JSON text.

All texts of a batch stand in one byte array.  Bitmaps of quotes, brackets and
delimiters and prefix sums over them give, without a loop over characters or
documents, which bytes are inside strings, how deep each byte is nested, which
bracket closes which, and to which container every value belongs.  The values
come out as linked rows: each knows its document, its parent and its place.
The same arrays say whether a text is valid JSON at all.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmeter.session import cut

OBJECT, ARRAY, STRING, NUMBER, TRUE, FALSE, NULL = range(7)
#: Characters indexed at once; a longer text goes alone.
CHUNK = 1 << 20
KINDS = ["object", "array", "string", "number", "boolean", "boolean", "null"]
_NUMBER = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_WORDS = {b"true": TRUE, b"false": FALSE, b"null": NULL}
_HEX = np.zeros(256, bool)
_HEX[[*b"0123456789abcdefABCDEF"]] = True
_ESCAPED = np.zeros(256, bool)
_ESCAPED[[*b'"\\/bfnrtu']] = True
_SPACE = np.zeros(256, bool)
_SPACE[[*b" \t\r\n"]] = True
#: Token codes: what a byte begins when it is outside of strings.
_CODE = np.zeros(256, np.int8)
_CODE[[*b"{}[],:"]] = [1, 2, 3, 4, 5, 6]
OPEN_O, CLOSE_O, OPEN_A, CLOSE_A, COMMA, COLON, TEXT, SCALAR = range(1, 9)


@dataclass
class Index:
    """The values of all valid texts of a batch in document order, one array element per value."""

    texts: list[bytes]
    valid: np.ndarray  # bool per text
    doc: np.ndarray  # text of the value
    parent: np.ndarray  # index of the enclosing value, -1 at the top
    depth: np.ndarray
    kind: np.ndarray
    start: np.ndarray  # byte offsets in the text, end exclusive
    end: np.ndarray
    key_start: np.ndarray  # of the member name with its quotes, -1 in arrays
    key_end: np.ndarray
    place: np.ndarray  # among the values of the parent, from 0

    def raw(self, i: int) -> bytes:
        return self.texts[self.doc[i]][self.start[i] : self.end[i]]

    def key(self, i: int) -> str | None:
        if self.key_start[i] < 0:
            return None
        return _unquote(self.texts[self.doc[i]][self.key_start[i] : self.key_end[i]])

    def value(self, i: int):
        """Text of a string without its escapes; the written form of everything else, None for null."""
        k = self.kind[i]
        if k == NULL:
            return None
        return _unquote(self.raw(i)) if k == STRING else self.raw(i).decode("utf-8", "replace")


def _unquote(b: bytes) -> str:
    if b"\\" not in b:
        return b[1:-1].decode("utf-8", "replace")
    return json.loads(b).encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # no half surrogate pairs


def index(texts: list[bytes]) -> Index:
    """Structural index of a list of JSON texts.  Empty and broken texts are invalid and give no values."""
    sizes = np.array([len(t) for t in texts], np.int64)
    # every text ends with a blank of its own, so that no two touch
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
    n, bad = len(data), np.zeros(len(texts), bool)
    pos = np.arange(n, dtype=np.int32)
    doc_of = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1) if len(texts) else np.zeros(n, np.int32)

    # escapes: a byte behind an odd run of backslashes
    slash = data == 92
    escaped = np.zeros(n, bool)
    if slash.any():
        run_start = np.maximum.accumulate(np.where(slash, np.int32(-1), pos))
        odd = slash & ((pos - run_start) & 1 == 1)
        escaped[1:] = odd[:-1]
    # quote bitmap and, by a prefix sum in each text, the parity that tells inside from outside
    quote = (data == 34) & ~escaped
    count = np.cumsum(quote, dtype=np.int32)
    base = np.where(begin > 0, count[begin - 1], 0).astype(np.int32) if len(texts) else np.zeros(0, np.int32)
    odd_level = ((count - base[doc_of]) & 1 == 1) if len(texts) else count & 1 == 1
    inside = odd_level & ~quote
    opening = quote & odd_level
    closing = quote & ~odd_level
    if len(texts):
        last = count[np.append(begin[1:], n) - 1]
        bad |= (last - base) % 2 == 1
    flaws = (inside & (data < 32)) | (inside & escaped & ~_ESCAPED[data]) | (~inside & ~quote & slash)
    u = np.flatnonzero(inside & escaped & (data == 117))
    if len(u):
        flaws[u] |= ~np.logical_and.reduce([_HEX[data[np.minimum(u + k, n - 1)]] & inside[np.minimum(u + k, n - 1)] for k in range(1, 5)])
    bad[doc_of[np.flatnonzero(flaws)]] = True

    # tokens outside of strings
    outside = ~inside & ~quote
    code = np.where(outside, _CODE[data], 0)
    loose = outside & (code == 0) & ~_SPACE[data]
    scalar = loose & ~np.concatenate([[False], loose[:-1]])
    kind_at = np.where(code > 0, code, np.where(opening, TEXT, np.where(scalar, SCALAR, 0)))
    tok = np.flatnonzero(kind_at)
    tk, td = kind_at[tok], doc_of[tok]
    # where strings and scalars end
    close_pos = np.flatnonzero(closing)
    loose_end = np.flatnonzero(loose & ~np.concatenate([loose[1:], [False]]))
    end = tok + 1
    if len(close_pos):
        at = np.minimum(np.searchsorted(close_pos, tok), len(close_pos) - 1)
        end = np.where(tk == TEXT, close_pos[at] + 1, end)
    if len(loose_end):
        at = np.minimum(np.searchsorted(loose_end, tok), len(loose_end) - 1)
        end = np.where(tk == SCALAR, loose_end[at] + 1, end)

    # nesting depth by prefix sums in each text
    step = np.where((tk == OPEN_O) | (tk == OPEN_A), 1, np.where((tk == CLOSE_O) | (tk == CLOSE_A), -1, 0))
    total = np.cumsum(step)
    first = np.searchsorted(td, np.arange(len(texts)))
    n_tok = np.diff(np.concatenate([first, [len(tok)]]))
    before = np.where(first > 0, total[np.minimum(first, len(total)) - 1], 0) if len(total) else np.zeros(len(texts), np.int64)
    depth = total - before[td] if len(tok) else total  # after the token
    bad |= n_tok == 0
    bad[td[depth < 0]] = True
    if len(tok):
        has = n_tok > 0
        last = np.where(has, first + n_tok - 1, 0)
        bad |= has & (depth[last] != 0)

    ok = ~bad[td] if len(tok) else np.zeros(0, bool)
    tok, tk, td, end, depth = tok[ok], tk[ok], td[ok], end[ok], depth[ok]
    m = len(tok)
    is_open = (tk == OPEN_O) | (tk == OPEN_A)
    is_close = (tk == CLOSE_O) | (tk == CLOSE_A)
    own = np.where(is_open, depth - 1, depth)  # depth at which the token stands
    # the bracket that closes: next in (text, depth) order
    br = np.flatnonzero(is_open | is_close)
    order = br[np.lexsort((br, own[br], td[br]))]
    mate = np.full(m, -1)
    if len(order):
        a, b = order[0::2], order[1::2]
        if len(a) == len(b):
            fits = is_open[a] & is_close[b] & (tk[b] - tk[a] == 1) & (td[a] == td[b]) & (own[a] == own[b])
            mate[a], mate[b] = b, a
            bad[td[a[~fits]]] = True
        else:  # cannot be with depths that close; kept as a guard
            bad[td[order]] = True
    # container of each token: the last open bracket of the depth above
    inner = _containers(td, own, is_open)
    in_object = (inner >= 0) & (tk[inner] == OPEN_O)

    # grammar: which token may follow which
    prev = np.concatenate([[0], tk[:-1]]) if m else tk
    new_text = np.concatenate([[True], td[1:] != td[:-1]]) if m else np.zeros(0, bool)
    prev = np.where(new_text, 0, prev)
    starts_value = is_open | (tk == TEXT) | (tk == SCALAR)
    after_value = (prev == CLOSE_O) | (prev == CLOSE_A) | (prev == TEXT) | (prev == SCALAR)
    is_key = (tk == TEXT) & in_object & ((prev == OPEN_O) | (prev == COMMA))
    prev_key = np.concatenate([[False], is_key[:-1]]) if m else is_key
    prev_key &= ~new_text
    fine = np.zeros(m, bool)
    fine |= starts_value & (inner < 0) & (prev == 0)
    fine |= starts_value & (inner >= 0) & ~in_object & ((prev == OPEN_A) | (prev == COMMA))
    fine |= is_key | (starts_value & in_object & (prev == COLON))
    fine |= (tk == COLON) & in_object & prev_key
    fine |= (tk == COMMA) & (inner >= 0) & after_value & ~prev_key
    fine |= is_close & ((after_value & ~prev_key) | (prev == OPEN_O) & (tk == CLOSE_O) | (prev == OPEN_A) & (tk == CLOSE_A))
    bad[td[~fine]] = True

    # values
    val = np.flatnonzero(starts_value & ~is_key)
    kind = np.full(m, -1)
    kind[tk == OPEN_O], kind[tk == OPEN_A], kind[tk == TEXT] = OBJECT, ARRAY, STRING
    buffer = data.tobytes()
    memo: dict[bytes, int] = {}
    for i in np.flatnonzero(tk == SCALAR):
        s = buffer[tok[i] : end[i]]
        k = memo.get(s)
        if k is None:
            k = memo[s] = _WORDS.get(s, NUMBER if _NUMBER.fullmatch(s) else -1)
        kind[i] = k
        if k < 0:
            bad[td[i]] = True
    val = val[~bad[td[val]]]
    number = np.full(m, -1)
    number[val] = np.arange(len(val))
    stop = np.where(is_open, end[np.maximum(mate, 0)], end)
    offset = begin[td[val]]
    up = inner[val]
    keyed = in_object[val]
    key_tok = np.where(keyed, val - 2, 0)
    # place among the values of the same parent
    parent = np.where(up >= 0, number[np.maximum(up, 0)], -1)
    by = np.argsort(parent, kind="stable")
    place = np.zeros(len(val), np.int64)
    if len(val):
        p = parent[by]
        fresh = np.concatenate([[True], (p[1:] != p[:-1]) | (p[1:] < 0)])  # every text has one value at the top
        at = np.arange(len(val))
        place[by] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return Index(
        texts, ~bad, td[val], parent, own[val], kind[val], tok[val] - offset, stop[val] - offset,
        np.where(keyed, tok[key_tok] - offset, -1), np.where(keyed, end[key_tok] - offset, -1), place,
    )


#: Up to this depth one pass per level is the quickest; deeper texts are sorted once.
SHALLOW = 32


def _containers(td: np.ndarray, own: np.ndarray, is_open: np.ndarray) -> np.ndarray:
    """The last open bracket of the level above in the same text, for every token; -1 at the top."""
    m, deepest = len(td), int(own.max(initial=0))
    inner = np.full(m, -1)
    if deepest <= SHALLOW:
        for d in range(1, deepest + 1):
            src = np.where(is_open & (own == d - 1), np.arange(m), -1)
            here = own == d
            inner[here] = np.maximum.accumulate(src)[here]
        return inner
    # tokens and, one level further in, the brackets that open it, in the order of (text, level, place)
    opens = np.flatnonzero(is_open)
    at = np.concatenate([np.arange(m), opens])
    level = np.concatenate([own, own[opens] + 1])
    mark = np.concatenate([np.full(m, -1), opens])
    order = np.lexsort((at, level, td[at]))
    here = order < m
    last = np.maximum.accumulate(np.where(here, -1, np.arange(len(order))))
    found = np.where(last >= 0, mark[order[np.maximum(last, 0)]], -1)
    tokens = order[here]
    inner[tokens] = np.where(own[tokens] > 0, found[here], -1)
    return inner


def parts_of(batch: pd.DataFrame, column: str, limit: int = CHUNK) -> Iterator[pd.DataFrame]:
    """A batch in stretches of about ``limit`` characters: the index takes some tens of bytes of memory for each."""
    if not len(batch):
        return
    sizes = batch[column].str.len().fillna(0).to_numpy(np.int64)
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // limit)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(batch)]):
        yield batch.iloc[a:b]


def _bytes(column: pd.Series) -> list[bytes]:
    return [b"" if t is None or t is pd.NA or t != t else t.encode("utf-8", "surrogatepass") for t in column]


LINKED = "doc_id long, node long, parent long, depth int, key string, place long, kind string, value string"


def flatten(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Every value of every valid JSON text as a row linked to its parent.

    Result: doc_id, node (from 0 in document order), parent (-1 at the top),
    depth, key (null in arrays), place among its siblings, kind (object, array,
    string, number, boolean, null), value (null for containers and null).
    Null, empty and invalid texts give no rows.  Order of members is kept;
    a repeated member name gives a row each time.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (p for batch in batches for p in parts_of(batch, "text")):
            yield _linked(b["doc_id"].to_numpy(), index(_bytes(b["text"])))

    return df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInPandas(rows, LINKED)


def _linked(ids: np.ndarray, x: Index) -> pd.DataFrame:
    first = np.searchsorted(x.doc, np.arange(len(ids)))
    base = first[x.doc] if len(x.doc) else x.doc
    every = range(len(x.doc))
    return pd.DataFrame(
        {
            "doc_id": ids[x.doc],
            "node": np.arange(len(x.doc)) - base,
            "parent": np.where(x.parent < 0, -1, x.parent - base),
            "depth": x.depth,
            "key": pd.Series([x.key(i) for i in every], dtype=object),
            "place": x.place,
            "kind": pd.Series([KINDS[k] for k in x.kind], dtype=object),
            "value": pd.Series([None if x.kind[i] in (OBJECT, ARRAY) else x.value(i) for i in every], dtype=object),
        }
    )


def whole_values(df: DataFrame, id_column: str, text_column: str, by_column: str | None = None) -> DataFrame:
    """``flatten`` over one delivery per document, the one ``flat_tables`` takes: of its whole texts that of smallest digest.

    ``by_column`` is the text whose digest counts if it isn't the whole text.
    Texts move once, sorted, so that each is parsed once and no values move.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = seen = None
        for b in (p for batch in batches for p in parts_of(batch, "text")):
            keys = list(zip(b["doc_id"].tolist(), b["digest"].tolist(), b["own"].tolist()))
            fresh = [k != before and k[0] != done for k, before in zip(keys, [seen, *keys])]
            seen = keys[-1]
            b = b[fresh]
            ids, texts = b["doc_id"].tolist(), _bytes(b["text"])
            valid = index(texts).valid if len(set(ids)) < len(ids) else np.ones(len(ids), bool)
            chosen = []
            for i, doc in enumerate(ids):
                if valid[i] and (not chosen or ids[chosen[-1]] != doc):
                    chosen.append(i)
            x = index([texts[i] for i in chosen])
            for i, ok in zip(chosen, x.valid):
                if ok:
                    done = ids[i]
            yield _linked(np.array([ids[i] for i in chosen], np.int64), x)

    texts = df.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"),
        F.xxhash64(F.col(by_column or text_column)).alias("digest"), F.xxhash64(F.col(text_column)).alias("own"),
    ).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return texts.repartition("doc_id").sortWithinPartitions("doc_id", "digest", "own").mapInPandas(rows, LINKED)


class Members:
    """The values in each container, in document order; container -1 holds the values at the top."""

    def __init__(self, x: Index, deepest: int | None = None):
        """Down to ``deepest``, if that is given."""
        near = np.arange(len(x.parent)) if deepest is None else np.flatnonzero(x.depth <= deepest)
        self.order = near[np.argsort(x.parent[near], kind="stable")]
        self.edges = np.searchsorted(x.parent[self.order], np.arange(-1, len(x.parent) + 1))

    def __getitem__(self, i: int) -> list[int]:
        return self.order[self.edges[i + 1] : self.edges[i + 2]].tolist()


def members(x: Index) -> dict[int, list[int]]:
    """The containers that hold anything, with their values in order."""
    inside = Members(x)
    return {i: inside[i] for i in np.unique(x.parent).tolist()}


_DAMAGE_FIELDS = ("damage_type", "part", "severity", "action", "confidence", "annotation_id", "description")
_IMAGE_FIELDS = ("status", "file_name", "width", "height", "overall_score", "attempts", "vehicle_visible", "error_message")
_BOX_NAMES = ("bounding_box", "bbox")
#: The columns of the flat table: those of every row, and those of a kind.
_LINKS = ["kind string", "doc_id long", "digest long", "image_no long", "image_id string", "damage_no long"]
_OF_KIND = {
    "document": ["meta string"], "image": [f"{c} string" for c in _IMAGE_FIELDS], "damage": [f"{c} string" for c in _DAMAGE_FIELDS],
    "box": ["box_no long", "number double"],
}


def _entries(x: Index, inside: Members, top: int) -> Iterator[tuple[int, str | None, dict[str, int], dict[str, int]]]:
    """(place, image id, members, members of what holds the damages) of each image entry, however the text nests them."""
    head = {x.key(i): i for i in inside[top]}
    for name in ("predictions", "images"):
        if (root := head.get(name)) is None:
            continue
        for i in inside[root]:
            if x.kind[i] != OBJECT:
                continue
            own = {x.key(j): j for j in inside[i]}
            holder, image = own, None
            if (j := own.get("result")) is not None and x.kind[j] == OBJECT and "damages" not in own:
                holder = {x.key(k): k for k in inside[j]}
            for at in (own, holder):
                if image is None and (j := at.get("image_id")) is not None and x.kind[j] in (STRING, NUMBER):
                    image = x.value(j)
            if image is None and (j := own.get("image")) is not None:
                if x.kind[j] == OBJECT:
                    deep = {x.key(k): k for k in inside[j]}
                    if (k := deep.get("image_id", deep.get("id"))) is not None and x.kind[k] in (STRING, NUMBER):
                        image = x.value(k)
                elif x.kind[j] in (STRING, NUMBER):
                    image = x.value(j)
            if image is None and x.kind[root] == OBJECT:
                image = x.key(i)
            yield int(x.place[i]), image, own, holder


def _damages(x: Index, inside: Members, j: int | None) -> list[tuple[int, int]]:
    """(place, value) of the damage objects listed at value j: a list, an object of numbered places, or one object alone."""
    listed = inside[j] if j is not None else []
    if not listed or x.kind[j] not in (ARRAY, OBJECT):
        return []
    if x.kind[j] == ARRAY:
        return [(int(x.place[i]), i) for i in listed if x.kind[i] == OBJECT]
    if all((x.key(i) or "").isdigit() for i in listed):
        return [(n, i) for n, i in enumerate(sorted(listed, key=lambda i: int(x.key(i)))) if x.kind[i] == OBJECT]
    return [(0, j)]


def _emit(x: Index, ids: np.ndarray, digests: np.ndarray, kinds: tuple[str, ...], out: list[dict]) -> None:
    fields, boxes, about = "damage" in kinds, "box" in kinds, "image" in kinds
    nested: list[tuple[dict, dict, bytes]] = []  # damages that are JSON within a string

    def image(head: dict, texts: dict, x: Index, inside: Members, j: int | None) -> None:
        found = _damages(x, inside, j)
        if about or not found:
            out.append({"kind": "image", **head, "damage_no": None if found else -1, **texts})
        for no, i in found:
            if not fields and not boxes:
                out.append({"kind": "place", **head, "damage_no": no})
                continue
            own = {x.key(k): k for k in inside[i]}
            if fields:
                out.append({"kind": "damage", **head, "damage_no": no, **{f: x.value(own[f]) for f in _DAMAGE_FIELDS if f in own}})
            for name in _BOX_NAMES if boxes else ():
                if (b := own.get(name)) is not None and x.kind[b] == ARRAY:
                    for k in inside[b]:
                        number = float(x.value(k)) if x.kind[k] == NUMBER else None
                        out.append({"kind": "box", **head, "damage_no": no, "box_no": int(x.place[k]), "number": number})

    inside = Members(x)
    for top in inside[-1]:
        doc = {"doc_id": int(ids[x.doc[top]]), "digest": int(digests[x.doc[top]])}
        meta = next((x.raw(i).decode("utf-8", "replace") for i in inside[top] if x.kind[top] == OBJECT and x.key(i) == "meta"), None) if "document" in kinds else None
        out.append({"kind": "document", **doc, "meta": meta})
        for place, image_id, own, holder in _entries(x, inside, top) if set(kinds) - {"document"} else ():
            head = {**doc, "image_no": place, "image_id": image_id}
            texts = {f: x.value(at[f]) for at in (own, holder) for f in _IMAGE_FIELDS if f in at} if about else {}
            j = holder.get("damages")
            if j is not None and x.kind[j] == STRING:
                nested.append((head, texts, x.value(j).encode("utf-8", "surrogatepass")))
            else:
                image(head, texts, x, inside, j)
    if nested:
        y = index([t for _, _, t in nested])
        within = Members(y)
        tops = {int(y.doc[t]): t for t in within[-1]}
        for n, (head, texts, _) in enumerate(nested):
            image(head, texts, y, within, tops.get(n))


def flat_tables(
    df: DataFrame, id_column: str, text_column: str, kinds: tuple[str, ...] = ("document", "image", "damage", "box"), by_column: str | None = None
) -> DataFrame:
    """Documents, images, damages and box numbers of nested evaluation files, as one table of tagged rows.

    ``kind`` says which table a row belongs to (document, image, damage, box);
    doc_id, image_no (place of the image entry) and damage_no (place among what
    is listed for the image, empty places counted) link a row to its parents.
    An image row has damage_no -1 where the image has no damage object.  Without
    damage and box in ``kinds`` damages come as rows of kind place that only
    hold the links; the places are the same.  A document row holds ``meta`` as
    JSON text.  The table has the columns of the wanted kinds.
    Rows with the same id are copies or damaged deliveries: of the whole texts
    of a document the one of smallest digest counts (of ``by_column``, if it is
    given).  Entries may stand in an object by image id or in a list; damages in
    a list, in an object of numbered places, alone, or as JSON in a string.
    Null entries and invalid texts give nothing.
    """

    flat_columns = [*_LINKS, *[c for k, columns in _OF_KIND.items() if k in kinds for c in columns]]
    names = [c.split()[0] for c in flat_columns]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (p for batch in batches for p in parts_of(batch, "text")):
            out: list[dict] = []
            _emit(index(_bytes(b["text"])), b["doc_id"].to_numpy(), b["digest"].to_numpy(), kinds, out)
            columns = {c: [r.get(c) for r in out] for c in names}
            yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in columns.items()})

    texts = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), F.xxhash64(F.col(by_column or text_column)).alias("digest")).filter(
        "doc_id IS NOT NULL AND text IS NOT NULL"
    )
    # copies fall together before one delivery per document is chosen; whole texts never move
    flat = cut(texts.mapInPandas(rows, ", ".join(flat_columns)).distinct())
    first = flat.filter("kind = 'document'").groupBy("doc_id").agg(F.min("digest").alias("digest"))
    return flat.join(first, ["doc_id", "digest"], "left_semi").drop("digest")


def damage_places(flat: DataFrame) -> DataFrame:
    """(doc_id, image_id, damage_no): one row per damage object, and -1 for an image entry without any."""
    return (
        flat.filter("kind IN ('damage', 'place') OR kind = 'image' AND damage_no = -1")
        .select("doc_id", "image_id", "damage_no")
        .distinct()
    )
