"""Exact top-k search by columnar branch-and-bound.

Candidates lie in vertical layout, one array per dimension. A query adds up its scores one block of dimensions after
another, the dimensions in which it is largest first. What is left of a score is bounded by the remaining mass of both
vectors (the product of the lengths of what has not been added up yet). The k-th best lower bound is a score that k
candidates surely reach; candidates whose upper bound is below it are dropped and the rest is compacted, so that later
blocks touch ever fewer rows. Sums are exact integers throughout.

The query set meets all candidates in cells of bounded size: each holds one group of candidates and one of queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnis.llm.vectors import best, dealt, integer_vectors, matrix
from tarnis.session import settle

#: Dimensions added up before bounds are taken again.
BLOCK = 8
#: Rows of a cell.
CANDIDATES, QUERIES = 8_192, 1_024
#: A score that no candidate can have; marks the query's own rows.
NEVER = -(1 << 62)

_FOUND = "query_id long, vec_id long, score long"


def search_block(ids: np.ndarray, columns: np.ndarray, squares: np.ndarray, query: np.ndarray, own: int | None, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of the k best candidates (columns: dimension by candidate), and how many were left at the last block.

    Candidates of the query's own id take no part; equal scores go by ascending id.
    """
    order = np.argsort(-np.abs(query), kind="stable")
    scores = np.where(ids == own, NEVER, 0).astype(columns.dtype)
    mass, query_mass = squares.sum(0), float((query * query).sum())
    alive, least = None, -np.inf
    for at in range(0, len(order), BLOCK):
        dims = order[at : at + BLOCK]
        if alive is None:
            part, part_mass = columns[dims], squares[dims]
        else:
            part, part_mass = columns[np.ix_(dims, alive)], squares[np.ix_(dims, alive)]
        scores = scores + query[dims] @ part
        mass = mass - part_mass.sum(0)
        query_mass -= float((query[dims] * query[dims]).sum())
        # rounding of the root and of what is taken from the mass stays far below the one that is added
        left = np.sqrt(max(query_mass, 0.0) * np.maximum(mass, 0)) * (1 + 1e-9) + 1 if at + BLOCK < len(order) else np.zeros(len(scores))
        if len(scores) > k:
            least = max(least, np.partition(scores - left, len(scores) - k)[len(scores) - k])
            stay = np.flatnonzero(scores + left >= least)
            if len(stay) < len(scores):
                alive = stay if alive is None else alive[stay]
                scores, mass = scores[stay], mass[stay]
    alive = np.arange(len(ids)) if alive is None else alive
    real = np.flatnonzero(ids[alive] != own) if own is not None else np.arange(len(alive))
    chosen = real[np.lexsort((ids[alive[real]], -scores[real]))[:k]]
    return alive[chosen], scores[chosen].astype(np.int64), len(alive)


def _cell(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(candidates) and len(queries):
            dims = len(candidates.column("v")[0])
            columns, asked = matrix(candidates.column("v"), dims).T.astype(np.int64), matrix(queries.column("v"), dims).astype(np.int64)
            squares = columns * columns
            longest = max(float(squares.sum(0).max()), float((asked * asked).sum(1).max()))
            if longest < 2.0**52:  # whole numbers up to here are exact in doubles, whose products are faster
                columns, squares, asked = columns.astype(np.float64), squares.astype(np.float64), asked.astype(np.float64)
            columns, squares = np.ascontiguousarray(columns), np.ascontiguousarray(squares)
            ids = candidates.column("vec_id").to_numpy()
            for query_id, query in zip(queries.column("vec_id").to_pylist(), asked):
                at, scores, _ = search_block(ids, columns, squares, query, query_id, k)
                found.append((np.full(len(at), query_id, np.int64), ids[at], scores))
        parts = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), parts)))

    return run


def top_k(
    rows: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding",
    candidates_per_cell: int = CANDIDATES, queries_per_cell: int = QUERIES,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows with the highest integer inner product for each query.

    Components count as floor(scale * x). Rows that share the query's id are no candidates of it. Equal scores go by ascending
    id; fewer than k candidates give fewer rows. Vectors that are null, hold null or non-finite components, or are so long that a score might not fit a
    long take no part, nor do rows without an id; an empty vector has score 0 with other empty ones. Vectors of different lengths don't meet. Repeated rows
    are candidates of their own; queries that share an id rank all their pairs together. An empty table gives no rows. Other columns are ignored.
    """
    # the slot is drawn once and stored: whatever ids repeat, groups are even, and a lost task finds the same groups again
    stored = settle(integer_vectors(rows, scale, id_col, vec_col).where("vec_id is not null").withColumn("slot", F.floor(F.rand() * (1 << 40))), "candidates")
    asked = settle(integer_vectors(queries, scale, id_col, vec_col).where("vec_id is not null").withColumn("slot", F.floor(F.rand() * (1 << 40))), "queries")
    groups, query_groups = (max(1, -(-t.count() // size)) for t, size in ((stored, candidates_per_cell), (asked, queries_per_cell)))
    cell = ["dims", "group", "query_group"]
    left = dealt(stored.withColumn("dims", F.size("v")), F.col("slot"), groups, query_groups, "group", "query_group").drop("slot")
    right = dealt(asked.withColumn("dims", F.size("v")), F.col("slot"), query_groups, groups, "query_group", "group").drop("slot")
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_cell(k), _FOUND)
    return best(found, "query_id", "vec_id", "score", k).select("query_id", "rank", "vec_id", "score")
