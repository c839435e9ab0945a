"""Ranked lexical search with LEMP-style norm buckets.

A document is a sparse vector of integer impacts over the terms that the items ask for, an item one of integer term weights; the score
is their inner product. Documents are ordered by the length of their vectors and cut into buckets. For an item with a
score that ten documents already reach:

* Cauchy-Schwarz: a bucket whose greatest length times the item's length stays below that score is skipped, and so
  are all behind it, which are shorter;
* coordinate bounds: inside a bucket the item's largest coordinates are added up, and what the others can still give is at most the product of
  the lengths that are left on both sides; documents whose bound stays below the score are out;
* the survivors are scored again in integers, over all their terms.

Scores to beat come from a first round over a part of the documents of all lengths, and rise from bucket to bucket.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnis.llm.common import id_and_text, map_batches
from tarnis.llm.vectors import best
from tarnis.session import settle

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Bits of the term filter for each distinct term of the items, and at most; a full filter only lets more terms through.
BITS_PER_TERM, MOST_BITS = 16, 1 << 26
#: Documents of a cell and of a bucket, items of a cell.
CELL, BUCKET, ITEMS = 8_192, 1_024, 256
#: One document in so many is scored in the first round.
SEED = 16
#: Coordinates added up before the bound.
FOCUS = 8
#: Words remembered with the filter's answer.
REMEMBERED = 1_000_000


def terms(text: str) -> list[str]:
    return _TERM.findall(text.translate(_LOWER))


# --- terms of the documents that items ask for ------------------------------------------------------------------


def _places(term: str, bits: int) -> tuple[int, int]:
    h = xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"))
    return h % bits, (h >> 32) % bits


def term_filter(asked: DataFrame) -> np.ndarray:
    """Flags (packed) of a Bloom filter over the distinct terms (column term), sized by their number up to a bound."""
    bits = 64
    n = asked.count()
    while bits < min(n * BITS_PER_TERM, MOST_BITS):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(bits, bool)
        for batch in batches:
            for term in batch.column(0).to_pylist():
                flags[list(_places(term, bits))] = True
        at = np.flatnonzero(np.packbits(flags))
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(np.packbits(flags)[at].astype(np.int32))], names=["at", "x"])

    made = np.zeros(bits // 8, np.uint8)
    for r in asked.select("term").mapInArrow(run, "at long, x int").groupBy("at").agg(F.bit_or("x").alias("x")).toLocalIterator():
        made[r["at"]] = r.x
    return made


def document_terms(docs: DataFrame, flags: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (all terms), terms and counts (those that pass the filter) of every row."""
    bits = len(flags) * 8

    def passes(term: str) -> bool:
        return all(flags[p >> 3] >> (7 - (p & 7)) & 1 for p in _places(term, bits))

    known: dict[str, bool] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ns, found, counts = [], [], []
        for text in batch.column(1).to_pylist():
            own = terms(text)
            ns.append(len(own))
            kept = []
            for term, tf in Counter(own).items():
                ok = known.get(term)
                if ok is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    ok = known[term] = passes(term)
                if ok:
                    kept.append((term, tf))
            found.append([t for t, _ in kept])
            counts.append([c for _, c in kept])
        return pa.record_batch(
            [batch.column(0), pa.array(ns, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))],
            names=["doc_id", "n", "terms", "counts"],
        )

    return map_batches(id_and_text(docs, id_col, text_col), run, "doc_id long, n long, terms array<string>, counts array<long>")


# --- one cell ---------------------------------------------------------------------------------------------------


class Bucket:
    """Documents of about one length: their coordinates by row and by column."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, starts: np.ndarray, columns: np.ndarray, impacts: np.ndarray, width: int):
        self.ids, self.lengths, self.starts, self.columns, self.impacts = ids, lengths, starts, columns, impacts
        self.longest = float(lengths.max())
        order = np.argsort(columns, kind="stable")
        self.by_column = np.repeat(np.arange(len(ids)), np.diff(starts))[order]
        self.column_impacts = impacts[order]
        self.column_starts = np.searchsorted(columns[order], np.arange(width + 1))

    def survivors(self, query: np.ndarray, places: np.ndarray, least: float) -> np.ndarray:
        """Rows whose bound reaches `least`. places: the query's coordinates, largest first."""
        part, mass = np.zeros(len(self.ids)), self.lengths**2
        focus, rest = places[:FOCUS], places[FOCUS:]
        for f in focus:
            lies = slice(self.column_starts[f], self.column_starts[f + 1])
            at, x = self.by_column[lies], self.column_impacts[lies].astype(np.float64)
            part[at] += query[f] * x
            mass[at] -= x * x
        left = np.sqrt(float((query[rest].astype(np.float64) ** 2).sum()) * np.maximum(mass, 0.0))
        # doubles are good to 15 digits: widened so that rounding can't lose a document
        return np.flatnonzero((part + left) * (1 + 1e-9) + 1 >= least)

    def scores(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact scores of some rows."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        at = np.arange(offsets[-1]) + np.repeat(self.starts[rows] - offsets[:-1], sizes)
        sums = np.concatenate(([0], np.cumsum(query[self.columns[at]] * self.impacts[at])))
        return sums[offsets[1:]] - sums[offsets[:-1]]


def _buckets(docs: pa.Table, known: pa.Array) -> Iterator[Bucket]:
    """The cell's documents in buckets, longest first; coordinates are places in `known`, others are left out."""
    flat, sizes = docs.column("terms").combine_chunks(), pc.list_value_length(docs.column("terms")).to_numpy()
    columns = pc.fill_null(pc.index_in(flat.flatten(), value_set=known), -1).to_numpy()
    impacts = docs.column("impacts").combine_chunks().flatten().to_numpy()
    rows = np.repeat(np.arange(len(docs)), sizes)
    rows, columns, impacts = rows[columns >= 0], columns[columns >= 0], impacts[columns >= 0]
    squares = np.bincount(rows, impacts.astype(np.float64) ** 2, len(docs))
    lengths, ids = np.sqrt(squares), docs.column("doc_id").combine_chunks()
    starts = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(docs)))))
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    for at in range(0, len(order), BUCKET):
        own = order[at : at + BUCKET]
        sizes = starts[own + 1] - starts[own]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        picked = np.arange(ends[-1]) + np.repeat(starts[own] - ends[:-1], sizes)
        yield Bucket(np.array(own), lengths[own] * (1 + 1e-12), ends, columns[picked], impacts[picked], len(known))


class Best:
    """The k best documents of an item so far; ties go by ascending id, null ids last."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, least
        self.scores, self.ranks, self.rows = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, scores: np.ndarray, ranks: np.ndarray, rows: np.ndarray) -> None:
        scores, ranks, rows = np.append(self.scores, scores), np.append(self.ranks, ranks), np.append(self.rows, rows)
        chosen = np.lexsort((ranks, -scores))[: self.k]
        self.scores, self.ranks, self.rows = scores[chosen], ranks[chosen], rows[chosen]
        if len(chosen) == self.k:
            self.least = max(self.least, int(self.scores[-1]))


def search_cell(docs: pa.Table, items: pa.Table, k: int) -> pa.Table:
    """The k best documents of the cell for each of its items, those below the item's score to beat left out."""
    found: list[tuple[list, pa.Array, np.ndarray]] = []
    known = items.column("terms").combine_chunks().flatten().unique()
    names, beat = items.column("item_id").to_pylist(), items.column("beat").to_pylist()
    queries = []
    for own, weights in zip(items.column("terms").combine_chunks(), items.column("weights").combine_chunks()):
        query = np.zeros(len(known), np.int64)
        at = pc.index_in(pa.array(own.as_py(), pa.string()), value_set=known).to_numpy()
        query[at] = np.array(weights.as_py(), np.int64)
        places = at[np.argsort(-query[at], kind="stable")]
        queries.append((query, places[query[places] > 0]))
    tops = [Best(k, b or 1) for b in beat]
    ids = docs.column("doc_id").combine_chunks()
    plain = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
    for bucket in _buckets(docs, known):
        for (query, places), top in zip(queries, tops):
            length = float(np.sqrt((query[places].astype(np.float64) ** 2).sum()))
            if length * bucket.longest * (1 + 1e-9) + 1 < top.least:
                continue
            rows = bucket.survivors(query, places, top.least)
            scores = bucket.scores(query, rows)
            good = scores >= top.least
            rows = bucket.ids[rows[good]]
            top.add(scores[good], plain[rows], rows)
    for name, top in zip(names, tops):
        found.append(([name] * len(top.rows), ids.take(pa.array(top.rows)), top.scores))
    return pa.table(
        {
            "item_id": pa.array([x for f in found for x in f[0]], pa.int64()),
            "doc_id": pa.concat_arrays([f[1] for f in found]) if found else pa.array([], pa.int64()),
            "score": np.concatenate([f[2] for f in found]) if found else np.zeros(0, np.int64),
        }
    )


# --- the search -------------------------------------------------------------------------------------------------


def _impacts(docs: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    m = F.lit(25) + F.call_function("div", F.lit(75) * F.col("n") * F.lit(n_docs), F.lit(n_terms))
    impact = F.transform("counts", lambda tf: F.call_function("div", F.lit(10**9) * tf, F.lit(1000) * tf + F.lit(8) * F.col("m")))
    return docs.withColumn("m", m).withColumn("impacts", impact)


def _item_vectors(asked: DataFrame, df: DataFrame, n_docs: int) -> DataFrame:
    """item_id, terms, weights: each term's weight times its repeats in the item."""
    ratio = F.lit(float(2 * n_docs + 2)) / (F.lit(2) * F.col("df") + F.lit(1)).cast("double")
    weighed = asked.join(df, "term").withColumn("weight", F.floor(F.lit(1000.0) * F.log(ratio)) * F.col("repeats"))
    lists = weighed.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("own"))
    return lists.select("item_id", F.col("own.term").alias("terms"), F.col("own.weight").alias("weights"))


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents of the highest score above 0 for each item.

    Terms are runs of letters, digits and characters beyond ASCII in the whole text, only A-Z lowered; weights and impacts are the integers
    of the contract, over the counts of all documents. Null and empty texts have no term, so such documents are never
    found and such items have no rows. Every row is a document of its own, so repeated rows appear as often; equal scores go by ascending
    doc_id, null ids last. Rows of items that share an id (null as well) count as one text. Without documents or items there are no rows. Other columns are ignored.
    """
    named = id_and_text(items, item_col, item_text_col)
    split = map_batches(named, _item_terms, "item_id long, term string, repeats long")
    asked = settle(split.groupBy("item_id", "term").agg(F.sum("repeats").alias("repeats")), "asked")
    flags = term_filter(asked.select("term").distinct())
    own = settle(document_terms(docs, flags, id_col, text_col), "terms")
    n_docs, n_terms = own.agg(F.sum((F.col("n") > 0).cast("long")), F.sum("n")).first()
    n_docs, n_terms = n_docs or 0, max(n_terms or 0, 1)
    df = own.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    vectors = settle(_item_vectors(asked, df, n_docs).withColumn("slot", F.floor(F.rand() * (1 << 40))), "items")

    with_impacts = _impacts(own, n_docs, n_terms).where(F.size("terms") > 0)
    length = F.aggregate("impacts", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    with_impacts = with_impacts.select("doc_id", "terms", "impacts", length.alias("length"), F.rand().alias("u"))
    cells, groups = max(1, -(-n_docs // CELL)), max(1, -(-vectors.count() // ITEMS))
    # by length, and by a draw among equal lengths, so that copies of one text are spread
    sorted_ = with_impacts.repartitionByRange(cells, F.col("length").desc(), "u")
    placed = settle(sorted_.withColumn("cell", F.spark_partition_id()).withColumn("part", F.floor(F.col("u") * SEED)), "lengths")
    cells = (placed.agg(F.max("cell")).first()[0] or 0) + 1
    vectors = vectors.select("item_id", "terms", "weights", F.pmod("slot", F.lit(groups)).cast("int").alias("items"))

    def run(part: DataFrame, asking: DataFrame, n_cells: int) -> DataFrame:
        left = part.withColumn("items", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        right = asking.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(n_cells - 1))))
        cogrouped = left.groupBy("cell", "items").cogroup(right.groupBy("cell", "items"))
        return cogrouped.applyInArrow(lambda a, b: search_cell(a, b, k), "item_id long, doc_id long, score long")

    first = placed.where("part = 0").select(F.floor(F.col("cell") / SEED).cast("int").alias("cell"), "doc_id", "terms", "impacts")
    seeds = settle(best(run(first, vectors.withColumn("beat", F.lit(None).cast("long")), -(-cells // SEED)), "item_id", "doc_id", "score", k), "seeds")
    beat = seeds.where(F.col("rank") == k).select("item_id", F.col("score").alias("beat"))
    asking = vectors.join(beat, vectors["item_id"].eqNullSafe(beat["item_id"]), "left").select(vectors["item_id"], "terms", "weights", "items", "beat")
    rest = run(placed.where("part > 0").select("cell", "doc_id", "terms", "impacts"), asking, cells)
    found = rest.unionByName(seeds.select("item_id", "doc_id", "score"))
    return best(found, "item_id", "doc_id", "score", k).select("item_id", "rank", "doc_id", "score")


def _item_terms(batch: pa.RecordBatch) -> pa.RecordBatch:
    made = [(i, t, n) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t, n in Counter(terms(text)).items()]
    kinds = [pa.int64(), pa.string(), pa.int64()]
    return pa.record_batch([pa.array([m[j] for m in made], kinds[j]) for j in range(3)], names=["item_id", "term", "repeats"])
