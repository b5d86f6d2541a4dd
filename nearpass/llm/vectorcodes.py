"""Vector codes by product quantisation, the nearest entry found by Orchard search.

Components become integers floor(scale * x); vectors are cut into equal parts, each with a codebook of few entries. For every entry of a
codebook the other entries are listed by distance. The search for a part starts at an entry and walks along that entry's list. An entry that
is nearer than the best so far becomes the best, and the walk goes on at the start of its list; entries already met are skipped. It
stops where the list's distance exceeds twice the distance to the best: by the triangle inequality all entries behind are farther.
All parts of a batch walk together, one step of each at a time.

Codebooks are trained by rounds of assigning all vectors and averaging. A task adds up its own sums and sends one row per part,
entry and component, so that the driver receives the size of the codebooks whatever the number of vectors.

Rows with a null vector, a null or non-finite component or one beyond ``LIMIT`` (its square would leave 64 bits) are dropped. Vectors must have the
length of the vector with the smallest id, others are dropped too; parts may differ in length by one where the length is not divisible. Null ids
come after all others and are coded like any row; repeated rows are coded one by one. Fewer vectors than entries give fewer entries. A table
without vectors gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from nearpass.llm.common import checkpointed, unused

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LIMIT = 1 << 14
BATCH = 4096
BROADCAST_LABELS = 100_000


@dataclass
class Codebook:
    """Entries of one part and, for every entry, the entries in order of distance from it (ties: lower index)."""

    entries: np.ndarray

    def __post_init__(self):
        apart = ((self.entries[:, None, :] - self.entries[None, :, :]) ** 2).sum(axis=2)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.distance = np.take_along_axis(apart, self.order, axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of every row's nearest entry (ties: lower index) and the squared distance."""
        n, k = len(x), len(self.entries)
        best, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
        error = ((x - self.entries[0]) ** 2).sum(axis=1)
        met = np.zeros((n, k), bool)
        met[:, 0] = True
        walk = np.arange(n)
        while len(walk):
            here, at = best[walk], place[walk]
            # squares: beyond twice the distance is beyond four times its square
            on = self.distance[here, at] <= 4 * error[walk]
            walk, here, at = walk[on], here[on], at[on]
            place[walk] = at + 1
            other = self.order[here, at]
            new = ~met[walk, other]
            to, other = walk[new], other[new]
            met[to, other] = True
            found = ((x[to] - self.entries[other]) ** 2).sum(axis=1)
            better = (found < error[to]) | (found == error[to]) & (other < best[to])
            to, other = to[better], other[better]
            best[to], error[to], place[to] = other, found[better], 0
            walk = walk[place[walk] < k]
        return best, error


def whole_vectors(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", scale: int = SCALE) -> DataFrame:
    """(id, label, x): the rows that can be coded, with integer components."""
    x, size = F.col(f"`{vector}`"), F.size
    fit = F.forall(x, lambda v: F.coalesce(F.abs(v.cast("double")) < LIMIT, F.lit(False)))
    good = vectors.filter(x.isNotNull() & fit)
    rows = good.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{label}`").alias("label"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("x"))
    first = rows.orderBy(F.asc_nulls_last("id"), "x").select(size("x").alias("n")).first()
    return rows.filter(size("x") == (first["n"] if first else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _batches(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, BATCH):
            part = batch.slice(i, BATCH)
            yield part, _matrix(part.column(place))


def _cuts(length: int, parts: int) -> list[slice]:
    edges = [length * p // parts for p in range(parts + 1)]
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]


def _sums(rows: DataFrame, books: list[Codebook], cuts: list[slice]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Number and component sums of the vectors at every entry of every part."""

    def add(batches):
        total = [np.zeros((len(b.entries), b.entries.shape[1] + 1), np.int64) for b in books]
        for _, x in _batches(batches, 0):
            for book, cut, to in zip(books, cuts, total):
                part = np.column_stack((x[:, cut], np.ones(len(x), np.int64)))
                np.add.at(to, book.nearest(x[:, cut])[0], part)
        for p, to in enumerate(total):
            entry, column = np.nonzero(to)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), p, np.int32)), pa.array(entry.astype(np.int32)), pa.array(column.astype(np.int32)), pa.array(to[entry, column])],
                                             names=["part", "entry", "col", "total"])

    out = [np.zeros((len(b.entries), b.entries.shape[1] + 1), object) for b in books]
    for r in rows.select("x").mapInArrow(add, "part int, entry int, col int, total long").groupBy("part", "entry", "col").agg(F.sum("total").alias("total")).collect():
        out[r["part"]][r["entry"], r["col"]] = r["total"]  # parts x entries x components at most
    return {(p, e): (row[-1], row[:-1].tolist()) for p, sums in enumerate(out) for e, row in enumerate(sums)}


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Entries of every part: those of the smallest ids at first, then ``rounds`` times the floor of the mean of what is nearest to them."""
    seeds = [r["x"] for r in rows.orderBy(F.asc_nulls_last("id"), "x").select("x").limit(entries).collect()]
    if not seeds:
        return []
    start = np.array(seeds, np.int64).reshape(len(seeds), -1)
    cuts = _cuts(start.shape[1], parts)
    books = [start[:, cut] for cut in cuts]
    for _ in range(rounds):
        sums = _sums(rows, [Codebook(b) for b in books], cuts)
        books = [np.array([[s // n for s in total] if n else old.tolist() for old, (n, total) in zip(b, (sums[p, e] for e in range(len(b))))], np.int64).reshape(b.shape)
                 for p, b in enumerate(books)]
    return books


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(id, label, codes, error): the entry of every part and the summed squared distance."""
    kind, group = rows.schema["id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    cuts = _cuts(sum(b.shape[1] for b in books), len(books)) if books else []

    def code(batches):
        each = [Codebook(b) for b in books]
        for batch, x in _batches(batches, 2):
            found = [book.nearest(x[:, cut]) for book, cut in zip(each, cuts)]
            codes = np.column_stack([f[0] for f in found]).astype(np.int32)
            at = np.arange(0, codes.size + 1, len(each), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(at), pa.array(codes.ravel())), pa.array(sum(f[1] for f in found))],
                                             names=["id", "label", "codes", "error"])

    return rows.select("id", "label", "x").mapInArrow(code, f"id {kind}, label {group}, codes array<int>, error long")


def with_label_error(coded: DataFrame) -> DataFrame:
    """Add ``label_error``: the error summed over equal labels, nulls together."""
    coded = checkpointed(coded)
    name = unused(coded, "_label")
    totals = checkpointed(coded.groupBy(F.col("label").alias(name)).agg(F.sum("error").alias("label_error")))
    if totals.count() <= BROADCAST_LABELS:
        totals = F.broadcast(totals)
    return coded.join(totals, F.col("label").eqNullSafe(F.col(name))).drop(name)
