"""Clusters around centroids, over vectors compressed to a few bits per dimension (VA-file).

Each dimension is cut at quantiles into 2^BITS cells, and a vector is stored as its cell numbers and its exact squared length.
For a centroid, a table over dimension and cell holds the least and the greatest share a component of that cell adds
to the distance; summing the entries of a vector's cells gives an interval that holds its distance. If one centroid's
interval ends before all others begin, the vector is assigned without its components; where intervals overlap, the full vector is fetched.

Sums of the clusters are kept up to date: a round only adds and takes away the vectors that change their cluster, so
the full vector of a row whose place is sure and unchanged isn't touched. All numbers are integers; nothing is rounded
but the means, whose floor is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnis.llm.vectors import integer_vectors
from tarnis.session import settle

#: Bits of a cell number.
BITS = 6
#: Squared lengths of kept vectors stay below this: sums of distances of 10^8 rows fit a long at any spread.
LONGEST = 2.0**46
#: Error of the quantiles at which dimensions are cut; it only moves work, never a result.
ACCURACY = 1000


def edges(vectors: DataFrame, dims: int, bits: int = BITS) -> np.ndarray:
    """The edges of the cells, dims x (2^bits + 1): least value, quantiles, greatest value of each dimension."""
    cuts = [i / (1 << bits) for i in range(1, 1 << bits)]
    values = vectors.select(F.posexplode("v").alias("dim", "x")).groupBy("dim")
    rows = values.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.percentile_approx("x", cuts, ACCURACY).alias("marks")).collect()
    out = np.zeros((dims, (1 << bits) + 1), np.int64)
    for r in rows:
        out[r.dim] = [r.low, *r.marks, r.high]
    return out


def cells(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Cell numbers: cell j holds values from edge j up to edge j + 1."""
    return np.stack([np.searchsorted(cut[d, 1:-1], values[:, d], side="right") for d in range(values.shape[1])], 1).astype(np.uint8)


def pack(codes: np.ndarray, bits: int = BITS) -> list[bytes]:
    flags = np.unpackbits(codes[:, :, None], axis=2)[:, :, 8 - bits :]
    return [row.tobytes() for row in np.packbits(flags.reshape(len(codes), -1), axis=1)]


def unpack(packed: pa.Array, dims: int, bits: int = BITS) -> np.ndarray:
    raw = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(len(packed), -1)
    flags = np.unpackbits(raw, axis=1, count=dims * bits).reshape(len(packed), dims, bits)
    return np.packbits(flags, axis=2)[:, :, 0] >> (8 - bits)


class Tables:
    """Distance intervals to a set of centroids by look-up.

    The squared distance is |x|^2 plus, for each dimension, c^2 - 2xc; only the second part depends on the cell, and over a cell it
    is extreme at an edge.
    """

    def __init__(self, centroids: np.ndarray, cut: np.ndarray):
        c = centroids.T[:, None, :]
        ends = np.stack([cut[:, :-1, None] * c, cut[:, 1:, None] * c])
        self.centroids = centroids
        self.low, self.high = c * c - 2 * ends.max(0), c * c - 2 * ends.min(0)

    def intervals(self, codes: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.repeat(square[:, None], len(self.centroids), 1)
        high = low.copy()
        for d in range(codes.shape[1]):
            low += self.low[d][codes[:, d]]
            high += self.high[d][codes[:, d]]
        return low, high

    def sure(self, codes: np.ndarray, square: np.ndarray) -> np.ndarray:
        """The nearest centroid where the intervals tell it, else -1. Touching intervals overlap: ties need the vector."""
        low, high = self.intervals(codes, square)
        possible = low <= high.min(1)[:, None]
        return np.where(possible.sum(1) == 1, possible.argmax(1), -1)

    def distances(self, values: np.ndarray) -> np.ndarray:
        return np.stack([((values - c) ** 2).sum(1) for c in self.centroids], 1)

    def nearest(self, values: np.ndarray) -> np.ndarray:
        return self.distances(values).argmin(1)


def _fetch(vectors: pa.Array, at: np.ndarray, dims: int) -> np.ndarray:
    return np.asarray(vectors.take(pa.array(at)).flatten()).reshape(len(at), dims).astype(np.int64)


def place(tables: Tables, codes: np.ndarray, square: np.ndarray, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Every row's centroid, and the rows whose full vector was fetched for it."""
    own = tables.sure(codes, square)
    open_ = np.flatnonzero(own < 0)
    own[open_] = tables.nearest(_fetch(vectors, open_, codes.shape[1]))
    return own, open_


def _moves(old: np.ndarray | None, new: np.ndarray, cut: np.ndarray, bits: int):
    """For each batch, what rounds add to sums and counts; `old` are the centroids of the round before (None: no cluster yet)."""
    k, dims = new.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after, before = Tables(new, cut), None if old is None else Tables(old, cut)
        total, fetched, seen = np.zeros((k, dims + 1), np.int64), 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, square, vectors = unpack(batch.column(0), dims, bits), batch.column(1).to_numpy(), batch.column(2)
            now, then = after.sure(codes, square), np.full(batch.num_rows, -2) if before is None else before.sure(codes, square)
            need = np.flatnonzero((now < 0) | (now != then))
            values = _fetch(vectors, need, dims)
            now, then = now[need], then[need]
            now[now < 0] = after.nearest(values[now < 0])
            if before is not None:
                then[then < 0] = before.nearest(values[then < 0])
            values = np.concatenate([values, np.ones((len(need), 1), np.int64)], 1)
            for c in range(k):
                total[c] += values[(now == c) & (then != c)].sum(0) - values[(then == c) & (now != c)].sum(0)
            fetched, seen = fetched + len(need), seen + batch.num_rows
        names = np.repeat(np.arange(k), dims + 1), np.tile(np.arange(dims + 1), k)
        made = [np.append(names[0], [-1, -1]), np.append(names[1], [0, 1]), np.append(total.ravel(), [fetched, seen])]
        yield pa.record_batch([pa.array(x, pa.int64()) for x in made], names=["cluster", "dim", "x"])

    return run


def _stored(vectors: DataFrame, cut: np.ndarray, bits: int) -> DataFrame:
    """vec_id, cells, square, v of every vector, written once and read by every round."""
    dims = len(cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = np.asarray(batch.column(1).flatten()).reshape(-1, dims).astype(np.int64)
                columns = [batch.column(0), pa.array(pack(cells(values, cut), bits), pa.binary()), pa.array((values * values).sum(1)), batch.column(1)]
                yield pa.record_batch(columns, names=["vec_id", "cells", "square", "v"])

    return settle(vectors.mapInArrow(run, "vec_id long, cells binary, square long, v array<int>"), "cells")


def _placed(tables: Tables, bits: int):
    dims = tables.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, _ = place(tables, unpack(batch.column(1), dims, bits), batch.column(2).to_numpy(), batch.column(3))
                values = _fetch(batch.column(3), np.arange(batch.num_rows), dims)
                far = ((values - tables.centroids[own]) ** 2).sum(1)
                yield pa.record_batch([batch.column(0), pa.array(own, pa.int32()), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def cluster(
    rows: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dims: int = 64, seed: int = 3, bits: int = BITS,
    id_col: str = "vec_id", vec_col: str = "embedding",
) -> tuple[DataFrame, np.ndarray, list[float]]:
    """Rows (vec_id, cluster, distance), the centroids, and the share of rows whose full vector each round fetched.

    Kept are vectors of exactly `dims` components, none null or non-finite, with a squared length below LONGEST after
    scaling; components count as floor(scale * x). Centroids start as the k kept vectors of the smallest sha256 of
    '<seed>:<vec_id>'; rows of one id go by their components, rows without an id come last and can still start one. Ties of distance go to the smaller number. Repeated rows count each. Fewer than k vectors give
    fewer centroids, none gives an empty table. Other columns are ignored. Rounds after a fixed point would change
    nothing and are left out.
    """
    vectors = settle(integer_vectors(rows, scale, id_col, vec_col, LONGEST).where(F.size("v") == dims), "vectors")
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(mark.asc_nulls_last(), "v").limit(k).select("v").collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(-1, dims)
    if not len(centroids):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids, []
    cut = edges(vectors, dims, bits)
    stored = _stored(vectors, cut, bits)
    total, old, shares = np.zeros((len(centroids), dims + 1), np.int64), None, []
    for _ in range(rounds):
        moved = stored.select("cells", "square", "v").mapInArrow(_moves(old, centroids, cut, bits), "cluster long, dim long, x long")
        told = np.zeros(2, np.int64)
        for c, d, x in moved.groupBy("cluster", "dim").agg(F.sum("x")).collect():
            if c < 0:
                told[d] = x
            else:
                total[c, d] += x
        shares.append(float(told[0] / max(told[1], 1)))
        old, centroids, full = centroids, centroids.copy(), total[:, -1] > 0
        centroids[full] = total[full, :-1] // total[full, -1:]
        if (old == centroids).all():
            break
    return stored.mapInArrow(_placed(Tables(centroids, cut), bits), "vec_id long, cluster int, distance long"), centroids, shares
