"""Token counts by rank-synchronous merging of ragged arrays.

All distinct pre-tokens of a batch are held as one ragged array (symbols and row starts). In each round every row
finds its lowest-rank pair and all rows apply theirs at once; rows without a pair leave with the number of symbols
that survived. A row needs as many rounds as it has different merges, so a batch of ordinary words is done in a few
dozen array passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnis.llm.common import id_and_text, pieces
from tarnis.llm.pretokens import Index, Vocabulary, load

NO_PAIR = np.iinfo(np.int64).max
#: Pre-tokens remembered between batches of a task.
REMEMBERED = 200_000


class PairTable:
    """Rank of a symbol pair: an open-addressing table in two arrays, probed for many pairs at once."""

    def __init__(self, vocabulary: Vocabulary):
        n = len(vocabulary.made)
        self.mask = (1 << (4 * n).bit_length()) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.ranks = np.full(self.mask + 1, NO_PAIR, np.int64)
        keys = vocabulary.left << 32 | vocabulary.right
        todo, slot = np.arange(n), self.slot(keys)
        while len(todo):
            free = self.keys[slot] < 0
            _, first = np.unique(slot, return_index=True)
            take = np.zeros(len(todo), bool)
            take[first] = True
            take &= free
            self.keys[slot[take]], self.ranks[slot[take]] = keys[todo[take]], todo[take]
            todo, slot = todo[~take], (slot[~take] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        slot, out = self.slot(keys), np.full(len(keys), NO_PAIR, np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            at = self.keys[slot]
            hit = at == keys[todo]
            out[todo[hit]] = self.ranks[slot[hit]]
            more = ~hit & (at >= 0)
            todo, slot = todo[more], (slot[more] + 1) & self.mask
        return out


def alternate(hit: np.ndarray) -> np.ndarray:
    """Of places that overlap, as in `a a a`, the first, third, ... of each run."""
    at = np.flatnonzero(hit)
    new = np.ones(len(at), bool)
    new[1:] = np.diff(at) > 1
    if new.all():
        return at
    begin = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
    return at[(at - begin) % 2 == 0]


def count_symbols(words: list[bytes], vocabulary: Vocabulary, ranks: PairTable) -> np.ndarray:
    """Tokens of each (non-empty) pre-token."""
    lengths = np.array([len(w) for w in words], np.int64)
    out = np.zeros(len(words), np.int64)
    if not len(words):
        return out
    raw = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(lengths) - 1
    symbols = vocabulary.inner[raw]
    symbols[ends] = vocabulary.final[raw[ends]]
    rows = np.arange(len(words))
    rank = np.full(len(symbols), NO_PAIR, np.int64)
    rank[:-1] = ranks(symbols[:-1], symbols[1:])
    rank[ends] = NO_PAIR
    while len(rows):
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        lowest = np.minimum.reduceat(rank, starts)
        done = lowest == NO_PAIR
        if done.any():
            out[rows[done]] = lengths[done]
            keep = np.repeat(~done, lengths)
            symbols, rank = symbols[keep], rank[keep]
            rows, lengths, lowest = rows[~done], lengths[~done], lowest[~done]
            if not len(rows):
                break
        of = np.repeat(np.arange(len(rows)), lengths)
        at = alternate(rank == lowest[of])
        symbols[at] = vocabulary.made[rank[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        lengths = lengths - np.bincount(of[at], minlength=len(rows))
        new = (np.cumsum(keep) - 1)[at]
        symbols, rank = symbols[keep], rank[keep]
        last = np.zeros(len(symbols), bool)
        last[np.cumsum(lengths) - 1] = True
        near = np.zeros(len(symbols), bool)
        near[new] = True
        near[new[new > 0] - 1] = True
        rank[near] = NO_PAIR
        touched = np.flatnonzero(near & ~last)
        rank[touched] = ranks(symbols[touched], symbols[touched + 1])
    return out


class Counter:
    """Counts tokens of texts; remembers pre-tokens it has met."""

    def __init__(self, path: str):
        self.vocabulary = load(path)
        self.ranks = PairTable(self.vocabulary)
        self.index, self.counts = Index(), np.zeros(0, np.int64)

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for a, b in pieces(texts):
            if len(self.index) > REMEMBERED:
                self.index, self.counts = Index(), np.zeros(0, np.int64)
            known = len(self.index)
            rows = [np.fromiter(map(self.index.__getitem__, w), np.int64, len(w)) for w in map(self.vocabulary.words, texts[a:b])]
            new = list(self.index)[known:]
            each = count_symbols([b"\0" if w[0] == " " else w.encode() for w in new], self.vocabulary, self.ranks)
            self.counts = np.concatenate((self.counts, each))  # a special token stands as one byte: one token
            out[a:b] = [self.counts[r].sum() for r in rows]
        return out


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each whole text, as the tokenizer file at a path that all executors have gives them.

    Returns doc_id, n_bytes, n_tokens, over_limit. A null text counts as empty: zero bytes and tokens. Special
    strings inside a text are one token each, as is the library's default. Repeated rows give a row each; other
    columns are ignored; an empty table gives an empty result. Texts of any length are counted whole.
    """

    def run(batches):
        counter = None
        for batch in batches:
            counter = counter or Counter(tokenizer)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(counter(batch.column(1).to_pylist()))], names=["doc_id", "n_bytes", "n_tokens"])

    rows = id_and_text(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
