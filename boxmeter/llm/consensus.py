"""Consensus from several annotators' labels (problem 4).

Method: a community confusion model.  Annotators belong to types that share a
confusion matrix; an annotator's own matrix has the type's matrix as its prior,
so that few labels lean on the type and many speak for themselves.  Variational
updates go around between the items' values, the annotators' matrices and types,
and the types' matrices.  Items are packed into blocks once; every round reads
the blocks, and only sums per annotator leave the workers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmeter.schemas import LABEL_FIELDS
from boxmeter.session import cut

#: Up to so many annotators their tables are gathered on the driver and broadcast (under 2 kB each); beyond, they stay distributed and are joined to the blocks.
BROADCAST_ANNOTATORS = 2_000
#: Turns of types and shares between two passes over the items.
TURNS = 40
#: Pseudo-counts of a type's row in each annotator's matrix.
STRENGTH = 12.0
#: Labels of a block; an item of more stands alone.
BLOCK_LABELS = 1 << 16


def _digamma(x: np.ndarray) -> np.ndarray:
    """psi(x) for x > 0 by recurrence and the asymptotic series."""
    x = np.asarray(x, float).copy()
    low = np.zeros_like(x)
    for _ in range(6):
        small = x < 6
        low -= np.where(small, 1 / x, 0)
        x += small
    f = 1 / (x * x)
    return low + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f / 240)))


def _lgamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float).copy()
    low = np.zeros_like(x)
    for _ in range(7):
        small = x < 7
        low -= np.where(small, np.log(x), 0)
        x += small
    f = 1 / (x * x)
    return low + (x - 0.5) * np.log(x) - x + 0.91893853320467274 + (1 / 12 - f * (1 / 360 - f / 1260)) / x


def prototypes(k: int) -> np.ndarray:
    """Types to start from: expert, fair, guessing, contrary, one step down, one step up, and always the same (one for each of the first values)."""
    eye, even = np.eye(k), np.full((k, k), 1 / k)
    off = (1 - eye) / (k - 1)
    shift = lambda d: np.eye(k)[np.clip(np.arange(k) + d, 0, k - 1)]
    kinds = [0.95 * eye + 0.05 * off, 0.75 * eye + 0.25 * off, even, 0.15 * eye + 0.85 * off, 0.75 * shift(-1) + 0.25 * even, 0.75 * shift(1) + 0.25 * even]
    kinds += [0.85 * np.eye(k)[[c] * k] + 0.15 * even for c in range(min(k, 3))]
    return np.array(kinds)


@dataclass
class Types:
    """What is shared by all annotators, for one field; its size depends on the number of values only."""

    matrix: np.ndarray  # (types, true, label)
    weight: np.ndarray  # (types,)
    prior: np.ndarray  # (true,)


def annotator_update(counts: np.ndarray, types: Types) -> tuple[np.ndarray, np.ndarray]:
    """(share of each type, expected log matrices) of annotators with expected counts (annotators, true, label)."""
    alpha = STRENGTH * types.matrix
    rows = counts.sum(axis=2)
    fit = np.zeros((len(counts), len(alpha)))
    for m, a in enumerate(alpha):
        total = a.sum(axis=1)
        fit[:, m] = (_lgamma(total) - _lgamma(total + rows)).sum(axis=1) + (_lgamma(a + counts) - _lgamma(a)).sum(axis=(1, 2))
    fit += np.log(types.weight)
    share = np.exp(fit - fit.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)
    log_matrix = np.zeros_like(counts)
    for m, a in enumerate(alpha):
        post = a + counts
        log_matrix += share[:, m, None, None] * (_digamma(post) - _digamma(post.sum(axis=2, keepdims=True)))
    return share, log_matrix


def type_sums(counts: np.ndarray, share: np.ndarray, types: Types) -> np.ndarray:
    """Counts per type, of each annotator's labels the part that speaks for the type rather than for the own matrix.

    alpha * (psi(alpha + n) - psi(alpha)) is that part of n labels; the matrices
    made of these sums never fit worse than the ones before, so the updates
    cannot go around in circles.
    """
    out = np.empty_like(types.matrix)
    for m, a in enumerate(STRENGTH * types.matrix):
        out[m] = np.einsum("a,akl->kl", share[:, m], a * (_digamma(a + counts) - _digamma(a)))
    return out


def type_update(sums: np.ndarray, shares: np.ndarray, truths: np.ndarray) -> Types:
    start = prototypes(sums.shape[1])
    matrix = sums + 2.0 * start + 1e-3
    weight = shares + 1.0
    prior = truths + 1.0
    return Types(matrix / matrix.sum(axis=2, keepdims=True), weight / weight.sum(), prior / prior.sum())


def clean_label(c: str) -> F.Column:
    """Index of the label in the enumeration of its field, -1 for blanks, nulls and other words; case and outer blanks don't matter."""
    word = F.lower(F.trim(F.regexp_replace(F.col(c), "[\\s\\u00a0]+", " ")))
    codes = F.create_map(*[x for i, v in enumerate(LABEL_FIELDS[c]) for x in (F.lit(v), F.lit(i))])
    return F.coalesce(F.try_element_at(codes, word), F.lit(-1))


FIELDS = list(LABEL_FIELDS)
SIZES = [len(v) for v in LABEL_FIELDS.values()]
_BLOCK = "block long, items binary, ptr binary, who binary, names binary, labels binary"


def counted_labels(labels: DataFrame) -> DataFrame:
    """One row per item and annotator: the latest labelling (null labeled_at is oldest; equal times: the later loaded_at, then the larger labels)."""
    codes = [clean_label(c).alias(c) for c in FIELDS]
    latest = F.max(F.struct("labeled_at", "loaded_at", *codes)).alias("r")
    rows = labels.filter("annotation_id IS NOT NULL AND annotator IS NOT NULL")
    return rows.groupBy("annotation_id", "annotator").agg(latest).select(
        "annotation_id", "annotator", *[F.col(f"r.{c}").alias(c) for c in FIELDS]
    )


def _pack(counted: DataFrame) -> DataFrame:
    """Blocks of items with all their labels, as arrays in binary columns."""
    code = F.lit(0)
    for c, k in zip(FIELDS, SIZES):
        code = code * (k + 1) + F.col(c) + 1
    items = counted.groupBy("annotation_id").agg(
        F.collect_list(F.struct(F.xxhash64("annotator").alias("w"), code.alias("c"))).alias("l")  # one per annotator at most
    ).select("annotation_id", F.col("l.w").alias("w"), F.col("l.c").alias("c"))

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            many = np.array([len(x) for x in b["w"]], np.int64)
            edges = np.flatnonzero(np.diff((np.cumsum(many) - many) // BLOCK_LABELS)) + 1
            for at, to in zip([0, *edges], [*edges, len(b)]):
                p = b.iloc[at:to]
                if not len(p):
                    continue
                sizes = np.array([len(x) for x in p["w"]], np.int64)
                names, who = np.unique(np.concatenate(p["w"].to_numpy()), return_inverse=True)
                code = np.concatenate(p["c"].to_numpy()).astype(np.int64)
                columns = []
                for k in reversed(SIZES):
                    columns.insert(0, (code % (k + 1)).astype(np.int8))
                    code //= k + 1
                ids = p["annotation_id"].to_numpy(np.int64)
                yield pd.DataFrame(
                    {
                        "block": [int(ids[0])],  # an item stands in one block only, so this names the block
                        "items": [ids.tobytes()], "ptr": [(np.cumsum(sizes) - sizes).tobytes()], "who": [who.astype(np.int32).tobytes()],
                        "names": [names.astype(np.int64).tobytes()], "labels": [np.concatenate(columns).tobytes()],
                    }
                )

    return cut(items.mapInPandas(blocks, _BLOCK))


class Block:
    def __init__(self, row):
        self.items = np.frombuffer(row.items, np.int64)
        self.ptr = np.frombuffer(row.ptr, np.int64)
        self.who = np.frombuffer(row.who, np.int32)
        self.names = np.frombuffer(row.names, np.int64)
        self.labels = np.frombuffer(row.labels, np.int8).reshape(len(FIELDS), -1)  # 0: none, else index + 1
        self.item_of = np.repeat(np.arange(len(self.items)), np.diff(np.append(self.ptr, len(self.who))))

    def votes(self, f: int) -> np.ndarray:
        flat = np.bincount(self.item_of * (SIZES[f] + 1) + self.labels[f], minlength=len(self.items) * (SIZES[f] + 1))
        return flat.reshape(len(self.items), -1)[:, 1:]

    def truth(self, f: int, tables: np.ndarray | None, prior: np.ndarray | None) -> np.ndarray:
        """(items, values): how probable each value is; by votes where there are no tables yet."""
        k = SIZES[f]
        if tables is None:
            v = self.votes(f) + 0.02
            return v / v.sum(axis=1, keepdims=True)
        gains = np.concatenate([np.zeros((len(self.names), 1, k)), tables.transpose(0, 2, 1)], axis=1).reshape(-1, k)
        score = np.add.reduceat(gains[self.who * (k + 1) + self.labels[f]], self.ptr, axis=0) + np.log(prior)
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return score / score.sum(axis=1, keepdims=True)

    def counts(self, f: int, truth: np.ndarray) -> np.ndarray:
        """(names, true, label): expected counts of this block."""
        k = SIZES[f]
        cell = self.who * (k + 1) + self.labels[f]
        spread = truth[self.item_of]
        n = len(self.names)
        out = [np.bincount(cell, weights=spread[:, t], minlength=n * (k + 1)).reshape(n, k + 1)[:, 1:] for t in range(k)]
        return np.stack(out, axis=1)


_STAT = "total boolean, annotator long, counts array<double>"
_WIDTH = sum(k * k for k in SIZES)


def _tables_of(flat: np.ndarray) -> list[np.ndarray]:
    """Per field the (annotators, true, label) arrays of rows that hold all fields one after the other."""
    out, at = [], 0
    for k in SIZES:
        out.append(flat[:, at : at + k * k].reshape(len(flat), k, k))
        at += k * k
    return out


@dataclass
class _Tables:
    """The annotators' expected log matrices, on the driver (names, flat) or as a DataFrame (annotator, flat)."""

    names: np.ndarray | None = None
    flat: np.ndarray | None = None
    frame: DataFrame | None = None


def _with_tables(blocks: DataFrame, tables: _Tables | None) -> DataFrame:
    """Beyond the broadcast bound: the tables a block needs, joined to it (at most one per label of the block)."""
    if tables is None or tables.frame is None:
        return blocks.withColumn("own", F.lit(None).cast("array<struct<annotator:bigint,flat:array<double>>>"))
    names = blocks.select("block", "names").mapInPandas(
        lambda it: (pd.DataFrame({"block": np.repeat(r.block, len(r.names) // 8), "annotator": np.frombuffer(r.names, np.int64)}) for b in it for r in b.itertuples()),
        "block long, annotator long",
    )
    own = names.join(tables.frame, "annotator").groupBy("block").agg(F.collect_list(F.struct("annotator", "flat")).alias("own"))
    return blocks.join(own, "block")


def _lookup(block: Block, own, shared) -> list[np.ndarray] | None:
    if own is not None:
        rows = sorted(((r["annotator"], r["flat"]) for r in own), key=lambda r: r[0])
        return _tables_of(np.array([r[1] for r in rows]))
    if shared is None:
        return None
    names, flat = shared
    return _tables_of(flat[np.searchsorted(names, block.names)])


def _round(blocks: DataFrame, tables: _Tables | None, types: list[Types] | None) -> tuple[DataFrame, Broadcast]:
    """Expected counts per annotator from all blocks, the row marked total holds the sums of the truths; and the broadcast they were made with."""
    sc = blocks.sparkSession.sparkContext
    shared = sc.broadcast((tables.names, tables.flat) if tables and tables.names is not None else None)
    priors = [t.prior for t in types] if types else [None] * len(FIELDS)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        truths = np.zeros(_WIDTH)
        for b in batches:
            for row in b.itertuples():
                block = Block(row)
                found = _lookup(block, row.own, shared.value)
                flat, at = [], 0
                for f, k in enumerate(SIZES):
                    truth = block.truth(f, found[f] if found else None, priors[f])
                    seen = block.votes(f).any(axis=1)
                    truths[at : at + k] += truth[seen].sum(axis=0)
                    at += k
                    flat.append(block.counts(f, truth).reshape(len(block.names), -1))
                for name, x in zip(block.names.tolist(), np.concatenate(flat, axis=1)):
                    total[name] = total[name] + x if name in total else x
        yield pd.DataFrame({"total": [False] * len(total) + [True], "annotator": [*total, 0], "counts": [*total.values(), truths]})

    parts = _with_tables(blocks, tables).mapInPandas(sums, _STAT)
    # a row per task and annotator holds all its sums, so they move and are added as one row
    added = parts.groupBy("total", "annotator").agg(*[F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(_WIDTH)])
    return added.select("total", "annotator", F.array(*[f"c{i}" for i in range(_WIDTH)]).alias("counts")), shared


@dataclass
class Fit:
    blocks: DataFrame
    tables: _Tables
    types: list[Types]
    annotators: DataFrame  # annotator long, counts array<double>
    rounds: int


def _settle_types(counts: np.ndarray, truths: np.ndarray, types: list[Types]) -> tuple[list[Types], np.ndarray]:
    """The types that fit the annotators' counts, in turns with their shares, and the annotators' tables."""
    new, flat = [], []
    for f, c in enumerate(_tables_of(counts)):
        t = types[f]
        for _ in range(TURNS):
            share = annotator_update(c, t)[0]
            before, t = t, type_update(type_sums(c, share, t), share.sum(axis=0), _truth_part(truths, f))
            if max(np.abs(before.matrix - t.matrix).max(), np.abs(before.weight - t.weight).max()) < 1e-5:
                break
        new.append(t)
        flat.append(annotator_update(c, t)[1].reshape(len(c), SIZES[f] ** 2))
    return new, np.concatenate(flat, axis=1)


def _moved(a: list[Types], b: list[Types]) -> float:
    return max(max(np.abs(x.matrix - y.matrix).max(), np.abs(x.prior - y.prior).max()) for x, y in zip(a, b))


def fit(labels: DataFrame, rounds: int = 400, tolerance: float = 1e-4, broadcast_annotators: int = BROADCAST_ANNOTATORS) -> Fit:
    """Run the variational updates until no type's matrix and no prior moves by ``tolerance``; fail after ``rounds`` that did not settle.

    While the annotators' counts are on the driver, types and shares take turns
    several times before the next pass over the items.
    """
    counted = counted_labels(labels)
    blocks = _pack(counted)
    spark = labels.sparkSession
    types = [type_update(np.zeros_like(prototypes(k)), np.zeros(len(prototypes(k))), np.zeros(k)) for k in SIZES]
    tables: _Tables | None = None
    few = None
    for done in range(1, rounds + 1):
        stats, shared = _round(blocks, tables, types if tables else None)
        if few is None:
            stats = cut(stats)
            few = stats.count() - 1 <= broadcast_annotators
        if few:  # a row per annotator, bounded
            pdf = stats.toPandas()
            shared.destroy()
            truths = np.sum(pdf[pdf["total"]]["counts"].tolist() or [np.zeros(_WIDTH)], axis=0)
            pdf = pdf[~pdf["total"]].sort_values("annotator")
            names = pdf["annotator"].to_numpy(np.int64)
            counts = np.array(pdf["counts"].tolist(), float).reshape(-1, _WIDTH)
            new, flat = _settle_types(counts, truths, types)
            settled = _moved(types, new) < tolerance
            tables = _Tables(names, flat)
        else:
            stats = cut(stats)
            new, tables = _distributed_update(stats, types)
            settled = _moved(types, new) < tolerance
        types = new
        if settled:
            if few:
                rows = [(int(a), c.tolist()) for a, c in zip(names, counts)]
                annotators = spark.createDataFrame(rows, "annotator long, counts array<double>")
            else:
                annotators = stats.filter("NOT total").drop("total")
            return Fit(blocks, tables, types, annotators, done)
    raise RuntimeError(f"the consensus has not settled within {rounds} rounds")


def _truth_part(truths: np.ndarray, f: int) -> np.ndarray:
    at = sum(SIZES[:f])
    return truths[at : at + SIZES[f]]


def _distributed_update(stats: DataFrame, types: list[Types]) -> tuple[list[Types], _Tables]:
    """The same update with the annotators left where they are; only sums per type come to the driver."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[~b["total"]]
            if len(b):
                row = []
                for f, c in enumerate(_tables_of(np.array(b["counts"].tolist()))):
                    share, _ = annotator_update(c, types[f])
                    row += [type_sums(c, share, types[f]).ravel(), share.sum(axis=0)]
                yield pd.DataFrame({"v": [np.concatenate(row)]})

    total = stats.mapInPandas(sums, "v array<double>").select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    v = np.array([r["x"] for r in sorted(total.collect(), key=lambda r: r["at"])])
    truths = np.array(stats.filter("total").first()["counts"])
    new, at = [], 0
    for f, k in enumerate(SIZES):
        m = len(prototypes(k))
        s, w = v[at : at + m * k * k].reshape(m, k, k), v[at + m * k * k : at + m * k * k + m]
        at += m * k * k + m
        new.append(type_update(s, w, _truth_part(truths, f)))

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[~b["total"]]
            if len(b):
                parts = [annotator_update(c, new[f])[1].reshape(len(b), -1) for f, c in enumerate(_tables_of(np.array(b["counts"].tolist())))]
                yield pd.DataFrame({"annotator": b["annotator"], "flat": list(np.concatenate(parts, axis=1))})

    return new, _Tables(frame=cut(stats.mapInPandas(tables, "annotator long, flat array<double>")))


def consensus(model: Fit) -> DataFrame:
    """One row per item and field with at least one counted label.

    annotation_id, field, consensus (ties: the first value of the enumeration),
    probability, n_labels, n_values (different ones), agreement (share of pairs
    of labels that agree; null for one label).
    """
    shared = model.blocks.sparkSession.sparkContext.broadcast(
        (model.tables.names, model.tables.flat) if model.tables.names is not None else None
    )
    priors = [t.prior for t in model.types]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                block = Block(row)
                found = _lookup(block, row.own, shared.value)
                for f, (name, values) in enumerate(LABEL_FIELDS.items()):
                    truth, votes = block.truth(f, found[f], priors[f]), block.votes(f)
                    n = votes.sum(axis=1)
                    best = truth.argmax(axis=1)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        pairs = (votes * (votes - 1)).sum(axis=1) / (n * (n - 1))
                    out = pd.DataFrame(
                        {
                            "annotation_id": block.items, "field": name, "consensus": np.array(values)[best],
                            "probability": truth[np.arange(len(best)), best], "n_labels": n, "n_values": (votes > 0).sum(axis=1), "agreement": pairs,
                        }
                    )
                    out["agreement"] = out["agreement"].astype(object).where(out["n_labels"] > 1, None)
                    yield out[out["n_labels"] > 0]

    return _with_tables(model.blocks, model.tables).mapInPandas(
        rows, "annotation_id long, field string, consensus string, probability double, n_labels long, n_values long, agreement double"
    )


def reliability(model: Fit, labels: DataFrame) -> DataFrame:
    """(annotator, field, n_labels, reliability, type_share): the probability that the annotator gives the true value, and the shares of the types."""
    types = model.types

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            for f, c in enumerate(_tables_of(np.array(b["counts"].tolist()))):
                share, _ = annotator_update(c, types[f])
                mean = np.einsum("am,mkl->akl", share, STRENGTH * types[f].matrix) + c
                mean /= mean.sum(axis=2, keepdims=True)
                hit = np.einsum("akk,k->a", mean, types[f].prior)
                yield pd.DataFrame(
                    {"w": b["annotator"], "field": FIELDS[f], "n_labels": np.rint(c.sum(axis=(1, 2))).astype("int64"), "reliability": hit, "type_share": list(share)}
                )

    names = labels.filter("annotator IS NOT NULL").select("annotator").distinct().select("annotator", F.xxhash64("annotator").alias("w"))
    own = model.annotators.mapInPandas(rows, "w long, field string, n_labels long, reliability double, type_share array<double>")
    return names.join(own, "w").drop("w")
