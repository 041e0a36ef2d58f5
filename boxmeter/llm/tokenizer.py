"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 7).

Pre-tokenisation works on arrays of code points.  Every code point has a class;
class, class of the neighbour and contraction length make one of a few symbols,
and every symbol is a transition function on the states of the pre-tokeniser.
Functions compose associatively, so a blocked scan finds the state before each
code point, and with it every boundary, for a whole batch and without regular
expressions.  The slices between boundaries go through a cached pair merging.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Code points taken through the arrays at once; longer texts go alone.
CHUNK = 1 << 20
CACHE = 1 << 20

# classes of code points
_L, _N, _O, _BLANK, _WHITE = range(5)
# fixed values: code points with the Unicode property White_Space
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# states: nothing open, in a run of letters, numbers, others, white space; behind a blank that joins the next run; within a contraction
NONE, LETTERS, NUMBERS, OTHERS, SPACES, JOIN, ONE_MORE, TWO_MORE = range(8)
# symbols: letter, number, other, apostrophe of a contraction of one or two letters, blank or other white space, last of its run or not
S_L, S_N, S_O, S_O1, S_O2, S_BLANK_LAST, S_WHITE_LAST, S_SPACE_ON = range(8)


@cache
def _classes() -> np.ndarray:
    kind = np.full(0x110000, _O, np.int8)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))[0]
        if c == "L":
            kind[cp] = _L
        elif c == "N":
            kind[cp] = _N
    kind[_SPACES] = _WHITE
    kind[32] = _BLANK
    return kind


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a token starts) by symbol and state; symbols from 8 on begin a text."""
    to, start = np.zeros((16, 8), np.int8), np.ones((16, 8), bool)
    for sym, run in ((S_L, LETTERS), (S_N, NUMBERS), (S_O, OTHERS), (S_O1, OTHERS), (S_O2, OTHERS)):
        to[sym] = {S_O1: ONE_MORE, S_O2: TWO_MORE}.get(sym, run)
        for s in (run, JOIN):
            to[sym, s], start[sym, s] = run, False
    to[S_L, ONE_MORE], start[S_L, ONE_MORE] = NONE, False
    to[S_L, TWO_MORE], start[S_L, TWO_MORE] = ONE_MORE, False
    to[S_BLANK_LAST] = JOIN
    to[S_WHITE_LAST] = NONE
    to[S_SPACE_ON] = SPACES
    start[S_SPACE_ON, SPACES] = False
    to[8:] = to[:8, [NONE]]
    return to, start


_TO, _START = _tables()


def scan(symbols: np.ndarray, block: int = 256) -> np.ndarray:
    """The state before each symbol: block-wise composition of transition functions, then a scan over blocks."""
    n = len(symbols)
    rows = -(-n // block)
    padded = np.zeros(rows * block, np.int8)
    padded[:n] = symbols
    grid = padded.reshape(rows, block)
    whole = np.tile(np.arange(8, dtype=np.int8), (rows, 1))
    for j in range(block):
        whole = _TO[grid[:, j, None], whole]
    # inclusive scan over the blocks by doubling: f[i] becomes f[i] after f[i - step]
    step = 1
    while step < rows:
        whole[step:] = np.take_along_axis(whole[step:], whole[:-step].astype(np.int64), axis=1)
        step *= 2
    state = np.zeros(rows, np.int8)
    state[1:] = whole[:-1, NONE]
    out = np.empty((rows, block), np.int8)
    for j in range(block):
        out[:, j] = state
        state = _TO[grid[:, j], state]
    return out.reshape(-1)[:n]


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each code point; ``first`` marks the first of each text."""
    n = len(points)
    kind = _classes()[points]
    space = kind >= _BLANK
    solid_next = np.zeros(n, bool)
    solid_next[:-1] = ~space[1:] & ~first[1:]
    sym = np.select(
        [kind == _L, kind == _N, kind == _O, ~solid_next, kind == _BLANK], [S_L, S_N, S_O, S_SPACE_ON, S_BLANK_LAST], S_WHITE_LAST
    ).astype(np.int8)
    a = np.flatnonzero(points == 39)
    if len(a):
        one, two = np.minimum(a + 1, n - 1), np.minimum(a + 2, n - 1)
        has1 = (a + 1 < n) & ~first[one]
        has2 = has1 & (a + 2 < n) & ~first[two]
        p, q = points[one], points[two]
        sym[a[has1 & np.isin(p, [*map(ord, "sdmt")])]] = S_O1
        pair = has2 & ((p == 108) & (q == 108) | (p == 118) & (q == 101) | (p == 114) & (q == 101))
        sym[a[pair]] = S_O2
    sym[first] += 8
    return _START[sym, scan(sym)]


class Encoder:
    """Token ids of byte strings by pair merging over ranks, with a cache of pre-tokens."""

    def __init__(self, ranks_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        self.texts = {i: b for b, i in self.ranks.items()}
        self.widths = np.zeros(max(self.texts, default=-1) + 1, np.int64)
        for i, b in self.texts.items():
            self.widths[i] = len(b)
        self.cache: dict[bytes, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Join the neighbouring pair of lowest rank, leftmost first, until no pair has a rank."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        end = list(range(1, n + 1))  # of the part that starts here
        prev = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop or end[i] >= stop:
                continue
            gone = end[i]
            alive[gone] = False
            end[i] = stop
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, counts, offsets): the ids of all texts one after the other, how many each has, and the byte of its text at which each token starts."""
        ids, counts, offsets = [], [], []
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK):
                size += len(texts[to])
                to += 1
            i, c, o = self._chunk(texts[at:to])
            ids.append(i)
            counts.append(c)
            offsets.append(o)
            at = to
        none, many = np.zeros(0, np.int32), np.zeros(0, np.int64)
        return np.concatenate(ids or [none]), np.concatenate(counts or [many]), np.concatenate(offsets or [many])

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(t) for t in texts], np.int64)
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64), np.zeros(0, np.int64)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = np.cumsum(sizes) - sizes
        first = np.zeros(len(points), bool)
        first[begin[sizes > 0]] = True
        starts = np.flatnonzero(boundaries(points, first))
        width = 1 + (points > 0x7F) + (points > 0x7FF).astype(np.int64) + (points > 0xFFFF)
        byte_at = np.concatenate([[0], np.cumsum(width)])
        data = joined.encode("utf-8", "surrogatepass")
        slices = byte_at[np.append(starts, len(points))]
        cuts = slices.tolist()
        get, merge, store = self.cache.get, self.merge, self.cache
        if len(store) > CACHE:
            store.clear()
        flat: list[int] = []
        lengths = np.empty(len(starts), np.int64)
        for k in range(len(starts)):
            piece = data[cuts[k] : cuts[k + 1]]
            found = get(piece)
            if found is None:
                found = merge(piece)
                if len(piece) < 64:
                    store[piece] = found
            flat += found
            lengths[k] = len(found)
        total = np.concatenate([[0], np.cumsum(lengths)])
        edge = np.searchsorted(starts, np.append(begin, len(points)))
        ids, counts = np.array(flat, np.int32), np.diff(total[edge])
        # a token starts where its slice does, behind the tokens before it in the slice
        run = np.cumsum(self.widths[ids]) - self.widths[ids]
        offsets = np.repeat(slices[:-1] - run[total[:-1]], lengths) + run - np.repeat(byte_at[begin], counts)
        return ids, counts, offsets

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.texts[i] for i in ids)


_encoders: dict[int, Encoder] = {}


def _encoder(ranks_file: bytes) -> Encoder:
    key = hash(ranks_file)
    if key not in _encoders:
        _encoders[key] = Encoder(ranks_file)
    return _encoders[key]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encode(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None, lengths_only: bool = False, offsets: bool = False
) -> DataFrame:
    """(id, ids) of every row: the token ids of its text, without special tokens.

    Empty and null texts have the empty list.  Strings of special tokens are
    ordinary text.  ``vocabulary`` is the path of a file of ranks on the driver;
    its bytes (under 1 MB for the dealt ones) go to the workers once.  With
    ``lengths_only`` the result has n_tokens in place of ids, and ``id_column``
    may be any column that goes along, such as a struct; with ``offsets`` it has
    starts, the byte of the text at which each token starts, in place of ids.
    """
    with open(vocabulary or vocabulary_path(), "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = pa.int32()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            at = 0
            while at < len(texts):  # a batch of long texts goes out in parts
                to, size = at + 1, len(texts[at])
                while to < len(texts) and size + len(texts[to]) <= 4 * CHUNK:
                    size += len(texts[to])
                    to += 1
                ids, counts, starts = encoder.encode(texts[at:to])
                keys = b.column(0).slice(at, to - at)
                if lengths_only:
                    out = pa.array(counts, pa.int64())
                else:
                    out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(starts if offsets else ids, pa.int64() if offsets else kind))
                yield pa.RecordBatch.from_arrays([keys, out], names=["id", "out"])
                at = to

    taken = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    result = taken.mapInArrow(rows, f"id {taken.schema['id'].dataType.simpleString()}, out {'long' if lengths_only else 'array<long>' if offsets else 'array<int>'}")
    return result.select(F.col("id").alias(id_column), F.col("out").alias("n_tokens" if lengths_only else "starts" if offsets else "ids"))
