"""BPE encoding by batched merge rounds, and decoding.

The symbols of many words lie in one flat array, words separated by a mark that no merge holds. In each round the
pairs of the whole array are looked up by binary search over the sorted pair keys, every word applies its
lowest-rank pair, and words without one are taken out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnis.llm.common import fresh, id_and_text, pieces
from tarnis.llm.pretokens import Index, Vocabulary, load

#: Pre-tokens remembered between batches of a task.
REMEMBERED = 200_000
#: Rows of a result batch; ids and decoded text are longer than the text, and both steps run in one task.
ROWS = 250


class Merges:
    """The merges of a vocabulary, sorted by pair key."""

    def __init__(self, vocabulary: Vocabulary):
        self.size = len(vocabulary.strings) + 1
        self.gap = self.size - 1  # the mark between words
        keys = vocabulary.left * self.size + vocabulary.right
        self.rank = np.argsort(keys)
        self.keys = keys[self.rank]
        self.made = vocabulary.made
        self.none = len(keys)

    def ranks(self, flat: np.ndarray) -> np.ndarray:
        """Rank of each symbol with the next one, or `none`."""
        keys = flat[:-1] * self.size + flat[1:]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        out = np.full(len(flat), self.none, np.int64)
        out[:-1] = np.where(self.keys[at] == keys, self.rank[at], self.none)
        return out

    def encode(self, words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all (non-empty) words one after another, and the number of each word."""
        counts = np.zeros(len(words), np.int64)
        if not words:
            return np.zeros(0, np.int64), counts
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        last = np.cumsum(lengths) - 1
        flat = np.full(len(raw) + len(words), self.gap, np.int64)
        of = np.repeat(np.arange(len(words)), lengths)
        flat[np.arange(len(raw)) + of] = vocabulary.inner[raw]
        flat[last + np.arange(len(words))] = vocabulary.final[raw[last]]
        word = np.repeat(np.arange(len(words)), lengths + 1)
        done_ids, done_words = [], []
        while len(flat):
            rank = self.ranks(flat)
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            lowest = np.minimum.reduceat(rank, starts)
            spread = np.repeat(lowest, np.diff(np.append(starts, len(flat))))
            out = spread == self.none
            if out.any():
                ready = out & (flat != self.gap)
                done_ids.append(flat[ready])
                done_words.append(word[ready])
                flat, word, rank, spread = flat[~out], word[~out], rank[~out], spread[~out]
                if not len(flat):
                    break
            hits = np.flatnonzero(rank == spread)
            # where places overlap (a a a), every other one of the run counts, from its left end
            head = np.concatenate(([True], np.diff(hits) != 1))
            nth = np.arange(len(hits)) - np.maximum.accumulate(np.where(head, np.arange(len(hits)), 0))
            hits = hits[nth % 2 == 0]
            flat[hits] = self.made[rank[hits]]
            keep = np.ones(len(flat), bool)
            keep[hits + 1] = False
            flat, word = flat[keep], word[keep]
        ids, of = np.concatenate(done_ids), np.concatenate(done_words)
        order = np.argsort(of, kind="stable")
        return ids[order], np.bincount(of, minlength=len(words))


class Encoder:
    """Encodes texts; remembers the ids of pre-tokens it has met."""

    def __init__(self, path: str):
        self.vocabulary = load(path)
        self.merges = Merges(self.vocabulary)
        self.forget()

    def forget(self) -> None:
        self.index = Index()
        self.ids, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for a, b in pieces(texts):
            if len(self.index) > REMEMBERED:
                self.forget()
            known = len(self.index)
            rows = [np.fromiter(map(self.index.__getitem__, w), np.int64, len(w)) for w in map(self.vocabulary.words, texts[a:b])]
            self.learn(list(self.index)[known:])
            out += map(self.gather, rows)
        return out

    def learn(self, new: list[str]) -> None:
        special = np.array([w[0] == " " for w in new], bool)
        ids, counts = self.merges.encode([b"\0" if w[0] == " " else w.encode() for w in new], self.vocabulary)
        starts = np.cumsum(counts) - counts
        if special.any():
            ids[starts[special]] = [self.vocabulary.special[w[1:]] for w in new if w[0] == " "]
        self.starts = np.concatenate((self.starts, starts + len(self.ids)))
        self.counts = np.concatenate((self.counts, counts))
        self.ids = np.concatenate((self.ids, ids.astype(np.int32)))

    def gather(self, row: np.ndarray) -> np.ndarray:
        """Ids of a text from the numbers of its pre-tokens."""
        counts = self.counts[row]
        total = int(counts.sum())
        step = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        return self.ids[np.repeat(self.starts[row], counts) + step]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each whole text, as the tokenizer file at a path that all executors have
    gives them, without begin and end tokens.

    A null text counts as empty and has no ids. Special strings inside a text are one id each, as is the library's
    default. Repeated rows give a row each; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(tokenizer)
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = encoder(part.column(1).to_pylist())
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))], names=["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, tokenizer: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """Adds the text of an id column: the token strings joined by one space, special tokens included, which is how
    the library decodes for a tokenizer file without a decoder. Null ids give an empty text, an id outside the
    vocabulary gives nothing, as in the library. A column of the result's name is replaced."""
    rows = rows.drop(name)
    key = fresh(rows, "ids_to_decode")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{name}` string"

    def run(batches):
        strings = None
        for batch in batches:
            if strings is None:
                known = load(tokenizer).strings
                strings = np.array(known, dtype=object)
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = []
                for ids in part.column(part.num_columns - 1):
                    own = ids.values.to_numpy(zero_copy_only=False) if ids.is_valid and len(ids) else np.zeros(0, np.int32)
                    own = own[(own >= 0) & (own < len(strings))]
                    texts.append(" ".join(strings[own].tolist()))
                yield pa.record_batch([*part.columns[:-1], pa.array(texts, pa.string())], names=[*part.schema.names[:-1], name])

    return rows.withColumn(key, F.col(f"`{ids_col}`")).mapInArrow(run, schema)
