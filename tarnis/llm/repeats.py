"""Removal of repeated byte strings by longest previous factors, over a whole corpus.

A byte goes if a string of `length` bytes around it also starts earlier: in a document of smaller id, or earlier in the
same one. That is so where the longest previous factor of some start reaches the length. In suffix order the earlier
match of a start is with the previous or next smaller position, whichever shares the longer prefix.

To find suffixes that share so long a prefix without one suffix array of the corpus, each start is sent where its
equals are. Its first `length` bytes have an anchor: the k-gram of least hash, which equal strings have in the same
place. Consecutive starts with one anchor form a fragment.

1. Fragments are compared by anchor and content, as hashes. Later copies of a fragment are removed as a whole; an
   anchor met once needs nothing more.
2. Where fragments of one anchor differ - at the ends of repeats - their starts are dealt out by the bytes that all
   strings of a short block share, and each such group gets a suffix order, its neighbours' common prefixes, and the
   previous and next smaller positions.

Every task first settles what its own rows repeat, so that a string met in a third of all documents is sent once from
each task. Long texts are cut into overlapping segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnis.session import settle

LENGTH, GRAM = 100, 32
#: Starts of a block that is dealt out together.
BLOCK = 16
#: Bytes worked on at once, and fragments gathered before a task settles its own repeats.
SEGMENT, GATHERED = 1 << 20, 1 << 19
#: Text bytes for which there is a bucket.
BUCKET = 1 << 24

_POSITION = np.uint64((1 << 23) - 1)
_BASE = 0xD6E8FEB86659FD93 | 1
_POWERS: dict[int, np.ndarray] = {}

#: Columns of a packed fragment: anchor and content hash, document (id, mark), first start, starts, place of the anchor.
FRAGMENT = [("h", "<u8"), ("f", "<u8"), ("id", "<i8"), ("mark", "<i8"), ("start", "<i4"), ("n", "<i2"), ("at", "<i2")]
BLOCKS = [("id", "<i8"), ("mark", "<i8"), ("start", "<i4"), ("n", "<i2")]
SPAN = [("id", "<i8"), ("mark", "<i8"), ("start", "<i4"), ("end", "<i4")]
#: Stands for several contents of an anchor that one task has seen.
SEVERAL = 0


def pack(rows: dict[str, np.ndarray], columns: list[tuple[str, str]]) -> bytes:
    return b"".join(np.ascontiguousarray(rows[c], dtype=t).tobytes() for c, t in columns)


def unpack(blobs: list[bytes], columns: list[tuple[str, str]]) -> dict[str, np.ndarray]:
    width = sum(np.dtype(t).itemsize for _, t in columns)
    parts: dict[str, list[np.ndarray]] = {c: [np.zeros(0, t)] for c, t in columns}
    for blob in blobs:
        n, at = len(blob) // width, 0
        for c, t in columns:
            parts[c].append(np.frombuffer(blob, t, n, at))
            at += n * np.dtype(t).itemsize
    return {c: np.concatenate(p) for c, p in parts.items()}


def take(rows: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return {c: v[which] for c, v in rows.items()}


def join(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def heads(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins, in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    if len(new):
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1), base, np.uint64)
        out[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(out)
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of any stretches of some bytes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=self.sums[1:])
        self.inverse = _powers(pow(_BASE, -1, 1 << 64), n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def segments(n: int, length: int, size: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Stretches of a text of n bytes that together hold every string of the length once."""
    for a in range(0, max(n - length + 1, 0), size):
        yield a, min(a + size + length - 1, n)


def fragments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Fragments of the segments that lie one after another in the data (ends at `offsets`, each at least `length`
    long): h, f, n, at, and their first start within the segment and the segment's number."""
    hashes, n = Hashes(data), len(data)
    grams = n - gram + 1
    first = np.arange(grams)
    own = hashes(first, first + gram)
    low = (own & ~_POSITION) | first.astype(np.uint64)
    window, step = length - gram + 1, 1
    while step < window:  # the least of every `window` grams: by doubling, the last step overlaps
        move = min(step, window - step)
        low = np.minimum(low[: len(low) - move], low[move:])
        step += move
    anchor = (low & _POSITION).astype(np.int64)
    segment = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    inside = np.arange(len(anchor)) + length <= offsets[segment + 1]
    starts = np.flatnonzero(inside)
    new = heads(anchor[starts], segment[starts])
    begin = starts[new]
    count = np.diff(np.append(np.flatnonzero(new), len(starts)))
    at = anchor[begin]
    f = hashes(begin, begin + count + length - 1) ^ _mix((at - begin).astype(np.uint64) << np.uint64(20) | count.astype(np.uint64))
    f[f == SEVERAL] = 1
    return {"h": own[at], "f": f, "n": count, "at": at - begin, "start": begin - offsets[segment[begin]], "segment": segment[begin]}


def spans_of(rows: dict[str, np.ndarray], length: int) -> dict[str, np.ndarray]:
    """Rows (id, mark, start, n) of starts as merged spans of bytes."""
    order = np.lexsort((rows["start"], rows["mark"], rows["id"]))
    id_, mark, start = (rows[c][order] for c in ("id", "mark", "start"))
    end = start.astype(np.int64) + rows["n"][order] + length - 1
    doc = np.cumsum(heads(id_, mark)) if len(id_) else np.zeros(0, np.int64)
    # the furthest end so far within the document
    reach = np.maximum.accumulate(end + (doc << 32)) - (doc << 32) if len(doc) else end
    new = heads(doc)
    new[1:] |= start[1:] > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:], len(doc)) - 1 if len(doc) else np.zeros(0, np.int64)
    return {"id": id_[new], "mark": mark[new], "start": start[new], "end": reach[last]}


def longest_previous(order: np.ndarray, common: np.ndarray, need: int) -> np.ndarray:
    """Whether each suffix of a suffix order shares `need` bytes with one of smaller position.

    order: positions in suffix order; common[i]: bytes that suffixes i-1 and i share. The previous and next smaller
    positions are found by following the smaller ones found so far; a way is given up where less is shared.
    """
    n, found = len(order), np.zeros(len(order), bool)
    for step in (-1, 1):
        near = np.arange(n) + step
        edge = common if step < 0 else np.append(common[1:], 0)
        open_ = np.flatnonzero((near >= 0) & (near < n) & (edge >= need))
        while len(open_):
            smaller = order[near[open_]] < order[open_]
            found[open_[smaller]] = True
            rest = open_[~smaller]
            at = near[rest]
            onward = near[at]
            # what the neighbour's own way shares, it must share with that neighbour too
            goes = (onward >= 0) & (onward < n) & (edge[at] >= need)
            near[rest[goes]] = onward[goes]
            open_ = rest[goes]
    return found


class Gather:
    """Fragments of a task's documents; gives packed rows by bucket after settling the task's own repeats."""

    def __init__(self, buckets: int, length: int, gram: int):
        self.buckets, self.length, self.gram = buckets, length, gram
        self.parts: list[dict[str, np.ndarray]] = []
        self.texts: list[np.ndarray] = []
        self.owners: list[tuple[int, int, int]] = []
        self.held = self.size = 0

    def add(self, id_: int, mark: int, text: bytes) -> Iterator[tuple[int, str, bytes]]:
        raw = np.frombuffer(text, np.uint8)
        for a, b in segments(len(raw), self.length):
            self.texts.append(raw[a:b])
            self.owners.append((id_, mark, a))
            self.size += b - a
            if self.size >= SEGMENT:
                yield from self.cut()

    def cut(self) -> Iterator[tuple[int, str, bytes]]:
        if self.texts:
            offsets = np.cumsum([0, *map(len, self.texts)])
            rows = fragments(np.concatenate(self.texts), offsets, self.length, self.gram)
            owners = np.array(self.owners, np.int64)[rows.pop("segment")]
            rows |= {"id": owners[:, 0], "mark": owners[:, 1], "start": (rows["start"] + owners[:, 2]).astype(np.int32)}
            self.parts.append({c: rows[c].astype(t) for c, t in FRAGMENT})
            self.held += len(owners)
            self.texts, self.owners, self.size = [], [], 0
        if self.held >= GATHERED:
            yield from self.settle()

    def settle(self) -> Iterator[tuple[int, str, bytes]]:
        if self.parts:
            rows = join(self.parts)
            self.parts, self.held = [], 0
            rows, later, asked = resolve(rows)
            yield from emit_marks(later, asked, self.length, self.buckets)
            bucket = (rows["h"] % np.uint64(self.buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(heads(bucket[order]))
            for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
                yield int(bucket[order[a]]), "fragment", pack(take(rows, order[a:b]), FRAGMENT)

    def end(self) -> Iterator[tuple[int, str, bytes]]:
        yield from self.cut()
        yield from self.settle()


def resolve(rows: dict[str, np.ndarray]) -> tuple[dict, dict, dict]:
    """A row for each anchor; fragments that repeat an earlier one; those to be compared start by start.

    An anchor with several contents keeps no content: all first copies of its contents are to be compared."""
    rows = take(rows, np.lexsort((rows["start"], rows["mark"], rows["id"], rows["f"], rows["h"])))
    known = rows["f"] != SEVERAL
    content = heads(rows["h"], rows["f"])
    # rows that are one place (a repeated row of the table) don't precede each other
    place = heads(rows["h"], rows["f"], rows["id"], rows["mark"], rows["start"])
    run = np.cumsum(content) - 1
    first_place = np.cumsum(place) == (np.cumsum(place)[content])[run]
    later = known & ~first_place
    anchors = np.flatnonzero(heads(rows["h"]))
    several = np.add.reduceat(content.astype(np.int64), anchors) > 1 if len(anchors) else np.zeros(0, bool)
    several |= ~known[anchors]  # SEVERAL sorts first
    of = np.repeat(several, np.diff(np.append(anchors, len(known))))
    asked = known & content & of
    kept = take(rows, anchors)
    kept["f"] = np.where(several, np.uint64(SEVERAL), kept["f"])
    return kept, take(rows, later), take(rows, asked)


def emit_marks(later: dict, asked: dict, length: int, buckets: int) -> Iterator[tuple[int, str, bytes]]:
    if len(later["id"]):
        spans = spans_of(later, length)
        yield int(spans["start"][0]) % buckets, "span", pack(spans, SPAN)
    if len(asked["id"]):
        yield int(asked["start"][0]) % buckets, "asked", pack(asked, FRAGMENT)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, mark, body. The mark tells texts of one id apart; it is 0 where no id is repeated."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    id_ = F.col(f"`{id_col}`").cast("long")
    repeated = docs.select(id_.alias("id")).groupBy("id").count().where("count > 1 or id is null").limit(1).count()
    mark = F.xxhash64(text) if repeated else F.lit(0).cast("long")
    return docs.select(id_.alias("id"), mark.alias("mark"), text.cast("binary").alias("body"))


#: A null id comes before all others; the bound is never an id of its own then, since marks tell texts apart.
_NULL = -(1 << 63)
_ROWS = "bucket long, kind string, rows binary"


def _rows(made: Iterator[tuple[int, str, bytes]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, str, bytes]] = []
    size = 0

    def batch() -> pa.RecordBatch:
        bucket, kind, rows = zip(*held, strict=True)
        return pa.record_batch([pa.array(bucket, pa.int64()), pa.array(kind), pa.array(rows, pa.binary())], names=["bucket", "kind", "rows"])

    for row in made:
        held.append(row)
        size += len(row[2])
        if size > 1 << 24:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _unpacked(marks: DataFrame, kind: str, columns: list[tuple[str, str]]) -> DataFrame:
    names = {"<u8": "long", "<i8": "long", "<i4": "int", "<i2": "int"}
    schema = ", ".join(f"{c} {names[t]}" for c, t in columns)

    def run(batches):
        for batch in batches:
            rows = unpack(batch.column(0).to_pylist(), columns)
            yield pa.record_batch([pa.array(rows[c].view(np.int64) if t == "<u8" else rows[c].astype(np.int32) if t == "<i2" else rows[c]) for c, t in columns], names=[c for c, _ in columns])

    return marks.where(F.col("kind") == kind).select("rows").mapInArrow(run, schema)


def _first_round(table: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    def cut(batches):
        gather = Gather(buckets, length, gram)

        def rows():
            for batch in batches:
                for id_, mark, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield from gather.add(_NULL if id_ is None else id_, mark, body)
            yield from gather.end()

        yield from _rows(rows())

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        own = part["kind"] == "fragment"
        out = list(part.loc[~own, ["bucket", "kind", "rows"]].itertuples(index=False, name=None))
        if own.any():
            _, later, asked = resolve(unpack(part.loc[own, "rows"].tolist(), FRAGMENT))
            out += emit_marks(later, asked, length, buckets)
        return pd.DataFrame(out, columns=["bucket", "kind", "rows"])

    return table.mapInArrow(cut, _ROWS).groupBy("bucket").applyInPandas(compare, _ROWS)


def _deal(body: np.ndarray, asked: dict[str, np.ndarray], length: int, block: int) -> tuple[dict, np.ndarray]:
    """Blocks of the starts asked for in one text, and the hash of the bytes that all strings of a block share.

    Blocks are cut where the distance of the start from the anchor is a multiple, so equal strings lie in equal blocks.
    """
    start = np.repeat(asked["start"].astype(np.int64), asked["n"])
    anchor = np.repeat(asked["start"].astype(np.int64) + asked["at"], asked["n"])
    start += np.arange(len(start)) - np.repeat(np.cumsum(asked["n"].astype(np.int64)) - asked["n"], asked["n"])
    distance = (anchor - start) // block
    order = np.lexsort((start, anchor))
    start, anchor, distance = start[order], anchor[order], distance[order]
    new = heads(anchor, distance)
    begin, n = start[new], np.diff(np.append(np.flatnonzero(new), len(start)))
    # of a whole block: from its last start to the end of the first string
    last = anchor[new] - distance[new] * block
    return {"start": begin, "n": n}, np.stack([last, last - block + 1 + length], 1)


def _second_round(table: DataFrame, asked: DataFrame, buckets: int, length: int, block: int) -> DataFrame:
    """Spans from suffix orders of what the first round could not tell."""
    # tasks that hold copies of a row ask for the same fragments
    wanted = asked.groupBy("id", "mark").agg(F.collect_set(F.struct("start", "n", "at")).alias("asked"))
    ours = table.select(F.coalesce("id", F.lit(_NULL)).alias("id"), "mark", "body")
    joined = ours.join(wanted, ["id", "mark"])

    def deal(batches):
        held: list[tuple[dict, np.ndarray, np.ndarray]] = []
        size = 0

        def settle_own():
            keys = np.concatenate([k for _, k, _ in held])
            rows = join([r for r, _, _ in held])
            strings = [s for _, _, s in held]
            flat = np.concatenate(strings)
            width = rows["n"].astype(np.int64) + length - 1
            offsets = np.cumsum(width) - width
            removed, rest = _suffixes(rows, flat, offsets, length)
            if len(removed["id"]):
                yield int(removed["start"][0]) % buckets, "span", pack(spans_of(removed, length), SPAN)
            # what is left of a block is sent as it is, cut to the starts still open
            of, begin, n = rest
            bucket = (keys[of] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(heads(bucket[order]))
            for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
                which = order[a:b]
                own = {"id": rows["id"][of[which]], "mark": rows["mark"][of[which]], "start": rows["start"][of[which]] + begin[which], "n": n[which]}
                lies = offsets[of[which]] + begin[which]
                text = b"".join(flat[x : x + m + length - 1].tobytes() for x, m in zip(lies.tolist(), n[which].tolist(), strict=True))
                head = pack(own, BLOCKS)
                yield int(bucket[order[a]]), "block", len(own["id"]).to_bytes(4, "little") + head + text

        def rows():
            nonlocal held, size
            for batch in batches:
                for id_, mark, body, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    raw = np.frombuffer(body, np.uint8)
                    for a in range(0, len(own), 1 << 15):
                        some = own[a : a + (1 << 15)]
                        ask = {c: np.array([x[c] for x in some], np.int64) for c in ("start", "n", "at")}
                        got, common = _deal(raw, ask, length, block)
                        lo, hi = int(got["start"].min()), int((got["start"] + got["n"]).max()) + length
                        hashes = Hashes(raw[max(lo - block, 0) : hi + block])
                        common = np.clip(common - max(lo - block, 0), 0, len(hashes.sums) - 1)
                        keys = hashes(common[:, 0], common[:, 1])
                        width = got["n"] + length - 1
                        lies = np.repeat(got["start"] - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
                        full = {"id": np.full(len(width), id_, np.int64), "mark": np.full(len(width), mark, np.int64), **got}
                        held.append((full, keys, raw[lies]))
                        size += int(width.sum())
                        if size > 1 << 22:
                            yield from settle_own()
                            held, size = [], 0
            if held:
                yield from settle_own()

        yield from _rows(rows())

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        own = part["kind"] == "block"
        out = list(part.loc[~own, ["bucket", "kind", "rows"]].itertuples(index=False, name=None))
        if own.any():
            blobs = part.loc[own, "rows"].tolist()
            width = sum(np.dtype(t).itemsize for _, t in BLOCKS)
            counts = [int.from_bytes(x[:4], "little") for x in blobs]
            rows = unpack([x[4 : 4 + c * width] for x, c in zip(blobs, counts, strict=True)], BLOCKS)
            flat = np.frombuffer(b"".join(x[4 + c * width :] for x, c in zip(blobs, counts, strict=True)), np.uint8)
            sizes = rows["n"].astype(np.int64) + length - 1
            removed, _ = _suffixes(rows, flat, np.cumsum(sizes) - sizes, length)
            if len(removed["id"]):
                out.append((int(part["bucket"].iloc[0]), "span", pack(spans_of(removed, length), SPAN)))
        return pd.DataFrame(out, columns=["bucket", "kind", "rows"])

    return joined.mapInArrow(deal, _ROWS).groupBy("bucket").applyInPandas(compare, _ROWS)


def _suffixes(rows: dict[str, np.ndarray], flat: np.ndarray, offsets: np.ndarray, length: int) -> tuple[dict, tuple]:
    """The starts of some blocks whose longest previous factor among them reaches the length, and the runs left:
    number of the block, first start within it, starts."""
    n = rows["n"].astype(np.int64)
    block = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(block)) - np.repeat(np.cumsum(n) - n, n)
    lies = offsets[block] + within
    windows = np.lib.stride_tricks.sliding_window_view(flat, length)[lies]
    strings = np.ascontiguousarray(windows).view(f"S{length}").ravel()
    suffix = np.argsort(strings, kind="stable")
    # positions: order of (document, start); rows of one place share a position
    id_, mark, start = rows["id"][block], rows["mark"][block], rows["start"][block].astype(np.int64) + within
    order = np.lexsort((start, mark, id_))
    position = np.empty(len(order), np.int64)
    position[order] = np.cumsum(heads(id_[order], mark[order], start[order]))
    common = np.zeros(len(suffix), np.int64)
    unlike = windows[suffix[1:]] != windows[suffix[:-1]]
    common[1:] = np.where(unlike.any(1), unlike.argmax(1), length)
    gone = np.zeros(len(suffix), bool)
    gone[suffix] = longest_previous(position[suffix], common, length)
    removed = {"id": id_[gone], "mark": mark[gone], "start": start[gone], "n": np.ones(int(gone.sum()), np.int64)}
    left = np.flatnonzero(~gone)
    new = heads(block[left], within[left] - np.arange(len(left)))
    runs = np.diff(np.append(np.flatnonzero(new), len(left)))
    return removed, (block[left][new], within[left][new], runs)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, spans (array of start and end of maximal removed runs, in UTF-8 bytes of the text) and kept (the
    remaining bytes, binary) of each text.

    A byte goes if it lies in a string of `length` bytes that also starts earlier: in a document of smaller id, or
    earlier in the same document; overlaps count; strings are judged on the input. A null text counts as empty. Of texts with one id, the one of the smaller hash comes
    first; identical rows are one document, returned as often as it is repeated; a null id comes before all others.
    Whole texts are compared, of any length; other columns are ignored.
    """
    if not 0 < gram <= length:
        raise ValueError("the anchor must fit into the string")
    table = _documents(docs, id_col, text_col)
    total = table.agg(F.sum(F.octet_length("body").cast("long"))).first()[0] or 0
    buckets = 16 + total // BUCKET
    first = settle(_first_round(table, buckets, length, gram), "fragments")
    second = settle(_second_round(table, _unpacked(first, "asked", FRAGMENT).select("id", "mark", "start", "n", "at"), buckets, length, min(BLOCK, length)), "blocks")
    spans = _unpacked(first, "span", SPAN).unionByName(_unpacked(second, "span", SPAN))
    by_doc = spans.groupBy("id", "mark").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("found"))
    ours = table.withColumn("key", F.coalesce("id", F.lit(_NULL)))
    joined = ours.join(by_doc.select(F.col("id").alias("key"), "mark", "found"), ["key", "mark"], "left")

    def finish(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                spans, kept = [], []
                for body, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    merged: list[list[int]] = []
                    for s in found or []:
                        if merged and s["start"] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], s["end"])
                        else:
                            merged.append([s["start"], s["end"]])
                    edges = [0, *(x for m in merged for x in m), len(body)]
                    spans.append([{"start": s, "end": e} for s, e in merged])
                    kept.append(b"".join(body[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
                sizes = [len(b) for b in batch.column(1).to_pylist()]
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return joined.select("id", "body", "found").mapInArrow(finish, "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
