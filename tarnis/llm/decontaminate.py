"""Benchmark decontamination by templates.

Numbers, names and units are replaced by typed placeholders, and windows of the resulting tokens are joined with
those of the benchmark. Matches on one alignment must fill the slots consistently: a value of the question that stands
in several slots must have become one value in the document. So a question with other numbers or names is found too,
while windows that merely look alike are not.

Windows with too few words for a template are compared by their own values and signs instead, so every item that has
a letter or a digit has a window. In scripts without spaces between words each character is a token.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnis.llm.common import fresh, pieces
from tarnis.session import settle

#: Tokens of a window, and how many of them must be words and not placeholders.
WINDOW, LITERAL = 8, 4
#: Items below a window are one window of their own length. Those with fewer tokens than this match only a sentence or
#: line of their own.
SHORTEST = 3
#: Share of an item's tokens that matched windows must cover, or else tokens in a row on one alignment.
COVERAGE, RUN = 0.5, 13
#: Bits of the filter that spares most windows of the corpus the shuffle; its size doesn't grow.
FILTER_BITS = 1 << 23

#: Words of quantity, units, and first names common in exercises.
NUMBERS = """two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen
eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half
twice thrice""".split()
UNITS = """mm cm dm m km inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers
kilometre kilometres centimeter centimeters centimetre centimetres g kg mg gram grams kilogram kilograms ton tons
tonne tonnes ounce ounces pound pounds lb lbs oz ml cl dl l liter liters litre litres gallon gallons pint pints cup
cups s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz
ghz v volt volts w kw watt watts j kj joule joules n newton newtons pa kpa bar k kelvin celsius fahrenheit degree
degrees percent cent cents dollar dollars usd euro euros eur yen rupee rupees kb mb gb tb byte bytes bit bits mph
kmh mol moles""".split()
NAMES = """james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph
jessica thomas sarah charles karen christopher lisa daniel nancy matthew betty anthony margaret mark sandra donald
ashley steven kimberly paul emily andrew donna joshua michelle kenneth carol kevin amanda brian melissa george
deborah edward stephanie ronald rebecca timothy laura jason sharon jeffrey cynthia ryan kathleen jacob amy gary
shirley nicholas angela eric helen jonathan anna tom jim jack jill bob alice ben sam max lucy kate jane peter maria
olivia emma noah liam mia ella leo alex ali ahmed fatima omar raj priya wei ming juan carlos jose sofia luis
pierre marie hans greta ivan olga""".split()

WORD, NUMBER, UNIT, NAME = 0, 1, 2, 3
#: Forms of a window: names kept as words, names as slots, all values kept. A key begins with its form.
PLAIN, TYPED, EXACT = "f", "t", "e"
MARK = {NUMBER: "<number>", UNIT: "<unit>", NAME: "<name>"}
_PUNCTUATION = re.compile("[" + "".join(f"{chr(a)}-{chr(z)}" for a, z in ((0xA0, 0xBF), (0x2010, 0x206F), (0x3000, 0x303F))) + "]")
#: Scripts without spaces between words: Thai, Lao, Myanmar, Khmer, kana, Han.
_UNSPACED = re.compile("[" + "".join(f"{chr(a)}-{chr(z)}" for a, z in ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))) + "]")
#: What may stand between the tokens of an exact window and tells nothing; other signs are part of it.
_FILLER = re.compile(rb"[\s.,;:!?\"'`]+")

_CLASS = np.zeros(256, np.uint8)  # 0 break, 1 letter, 2 digit
_CLASS[ord("0") : ord("9") + 1] = 2
for _a, _z in (("a", "z"), ("A", "Z")):
    _CLASS[ord(_a) : ord(_z) + 1] = 1
_CLASS[128:] = 1
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A") : ord("Z") + 1] += np.uint64(32)
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in '.!?:;"\n']] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) mod 2^64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.ones(max(n, 1), np.uint64)
        out[1:] = np.uint64(base)
        have = _POWERS[base] = np.multiply.accumulate(out)
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Tokens:
    """The tokens of several texts: runs of letters or of a number, or characters of a script without spaces; A-Z count
    as a-z."""

    def __init__(self, texts: list[str]):
        clean = [t if t.isascii() else _UNSPACED.sub(r" \g<0> ", _PUNCTUATION.sub(" ", t)) for t in texts]
        raw = [t.encode("utf-8", "surrogatepass") for t in clean]
        self.data = b"\n".join(raw) + b"\n"
        self.offsets = np.cumsum([0, *(len(r) + 1 for r in raw)])
        b = np.frombuffer(self.data, np.uint8)
        kind = _CLASS[b]
        # a point or comma between digits belongs to the number
        inner = np.flatnonzero((b[1:-1] == 46) | (b[1:-1] == 44)) + 1
        inner = inner[(kind[inner - 1] == 2) & (kind[inner + 1] == 2)]
        kind[inner] = 2
        edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        starts = np.concatenate(([0], edge))
        ends = np.append(edge, len(b))
        token = kind[starts] > 0
        self.starts, self.ends = starts[token], ends[token]
        digits = kind[self.starts] == 2
        low = (_LOWER[b] + np.uint64(1)) * _powers(_BASE, len(b))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(low, dtype=np.uint64)))
        self.hash = _mix((sums[self.ends] - sums[self.starts]) * _powers(_INVERSE, len(b) + 1)[self.starts])
        self.kind = np.where(digits, NUMBER, WORD).astype(np.uint8)
        for words, k in ((_LISTS[NUMBER], NUMBER), (_LISTS[UNIT], UNIT)):
            self.kind[_within(self.hash, words)] = k
        # a capital and small letters within a sentence, or a known first name
        upper = np.concatenate(([0], np.cumsum(_UPPER[b])))
        stops = np.concatenate(([0], np.cumsum(_STOP[b])))
        before = np.concatenate(([0], self.ends[:-1]))
        title = _UPPER[b[self.starts]] & (upper[self.ends] - upper[self.starts] == 1) & (self.ends - self.starts > 1)
        title &= stops[self.starts] == stops[before]
        if len(title):
            title[0] = False
        self.typed = self.kind.copy()
        self.typed[(self.kind == WORD) & (title | _within(self.hash, _LISTS[NAME]))] = NAME
        self.text = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.first = np.searchsorted(self.text, np.arange(len(texts)))
        self.count = np.bincount(self.text, minlength=len(texts)) if len(self.text) else np.zeros(len(texts), int)

    def windows(self, length: int, form: str) -> tuple[np.ndarray, np.ndarray]:
        """First tokens of the windows of a form, and their hashes: templates with enough literal words, or else exact."""
        typed = form == TYPED
        kind = self.typed if typed else self.kind
        n = len(kind) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        literal = np.concatenate(([0], np.cumsum(kind == WORD)))
        fits = literal[length:] - literal[:n] >= min(LITERAL, length - 1)
        if length < SHORTEST:
            fits[:] = False
        whole = self.text[:n] == self.text[length - 1 :]
        if form == EXACT:
            at = np.flatnonzero(~fits & whole)
            total = np.full(len(at), length + 2000, np.uint64)
            for j in range(length):
                total = total * np.uint64(_BASE) + self.hash[at + j]
            return at, _mix(total)
        fits &= whole
        one = np.where(kind == WORD, self.hash, _mix(kind.astype(np.uint64) + np.uint64(11)))
        total = np.full(n, length + (1000 if typed else 0), np.uint64)
        for j in range(length):
            total = total * np.uint64(_BASE) + one[j : j + n]
        if typed:  # without a name in it, the window is the other form's
            names = np.concatenate(([0], np.cumsum(kind == NAME)))
            fits &= names[length:] - names[:n] > 0
        at = np.flatnonzero(fits)
        return at, _mix(total[at])

    def apart(self, at: int, length: int) -> bool:
        """Whether a whole item that stands here tells enough: one or two tokens as a sentence or line of their own,
        values without a word not as a part of a longer row of values."""
        end, sides = at + length, []
        for i, other in ((at, at - 1), (end, end)):
            if 0 < i < len(self.text) and self.text[i] == self.text[i - 1]:
                sides.append((self.data[self.ends[i - 1] : self.starts[i]], self.kind[other] != WORD))
        if length < SHORTEST:
            return all(any(_STOP[c] for c in between) for between, _ in sides)
        if (self.kind[at:end] == WORD).any():
            return True
        return not any(value and not between.strip(b" \t,") for between, value in sides)

    def exact(self, at: int, length: int) -> tuple[str, list[str]]:
        """The window with its values and the signs between them; no slots."""
        out = []
        for i in range(at, at + length):
            if i > at:
                out.append(_FILLER.sub(b"", self.data[self.ends[i - 1] : self.starts[i]]).decode("utf-8", "replace"))
            out.append(self.data[self.starts[i] : self.ends[i]].lower().decode("utf-8", "replace"))
        return f"{EXACT} " + " ".join(out), []

    def template(self, at: int, length: int, form: str) -> tuple[str, list[str]]:
        """The window in words, and what stands in its slots."""
        if form == EXACT:
            return self.exact(at, length)
        kind = self.typed if form == TYPED else self.kind
        words, slots = [], []
        for i in range(at, at + length):
            own = self.data[self.starts[i] : self.ends[i]].lower().decode("utf-8", "replace")
            words.append(MARK.get(int(kind[i]), own))
            if kind[i] != WORD:
                slots.append(own)
        return f"{form} " + " ".join(words), slots


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def _hashes(words: list[str]) -> np.ndarray:
    out = []
    for w in words:
        b = np.frombuffer(w.encode(), np.uint8)
        out.append(((_LOWER[b] + np.uint64(1)) * _powers(_BASE, len(b))).sum(dtype=np.uint64))
    return np.sort(_mix(np.array(out, np.uint64)))


_LISTS = {NUMBER: _hashes(NUMBERS), UNIT: _hashes(UNITS), NAME: _hashes(NAMES)}
_WINDOWS = "id long, mark long, n_tokens int, pos int, length int, key string, slots array<string>, hash long"


def _table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _emit(batch: pa.RecordBatch, a: int, tokens: Tokens, found: list[tuple[np.ndarray, np.ndarray, int, str]]) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in range(6)]
    for at, hashes, length, form in found:
        rows = tokens.text[at]
        templates = [tokens.template(int(i), length, form) for i in at]
        made = ((rows + a).tolist(), tokens.count[rows].tolist(), (at - tokens.first[rows]).tolist(), [length] * len(at), templates, hashes.view(np.int64).tolist())
        for column, values in zip(columns, made, strict=True):
            column += values
    rows = pa.array(columns[0], pa.int64())
    arrays = [
        batch.column(0).take(rows), batch.column(1).take(rows), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()),
        pa.array(columns[3], pa.int32()), pa.array([t for t, _ in columns[4]], pa.string()), pa.array([s for _, s in columns[4]], pa.list_(pa.string())), pa.array(columns[5], pa.int64()),
    ]
    return pa.record_batch(arrays, names=["id", "mark", "n_tokens", "pos", "length", "key", "slots", "hash"])


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """All windows of the items: templates with names replaced, and with their words kept; exact where words are few."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for i, text in enumerate(texts):
                tokens = Tokens([text])
                length = min(window, len(tokens.starts))
                if length:
                    yield _emit(batch, i, tokens, [(*tokens.windows(length, form), length, form) for form in (PLAIN, TYPED, EXACT)])

    return _table(benchmark, id_col, text_col).mapInArrow(run, _WINDOWS)


def _bits(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return (hashes % np.uint64(size)).astype(np.int64), ((hashes >> np.uint64(32)) % np.uint64(size)).astype(np.int64)


def _filter(windows: DataFrame, size: int) -> bytes:
    """A filter of fixed size over the window hashes, made in the tasks and joined in one."""

    def fill(batches):
        own = np.zeros(size, bool)
        for batch in batches:
            for at in _bits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), size):
                own[at] = True
        yield pa.record_batch([pa.array([np.packbits(own).tobytes()], pa.binary())], names=["bits"])

    def join(batches):
        own = np.zeros(size // 8, np.uint8)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                own |= np.frombuffer(x, np.uint8)
        yield pa.record_batch([pa.array([own.tobytes()], pa.binary())], names=["bits"])

    return bytes(windows.select("hash").mapInArrow(fill, "bits binary").repartition(1).mapInArrow(join, "bits binary").first()[0])


def corpus_windows(docs: DataFrame, bits: bytes, kinds: list[tuple[int, str]], id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The windows of the corpus, of some lengths and forms, that pass the filter."""
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        known = np.unpackbits(np.frombuffer(held.value, np.uint8)).astype(bool)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in pieces(texts):
                tokens, found = Tokens(texts[a:b]), []
                for length, form in kinds:
                    at, hashes = tokens.windows(length, form)
                    one, two = _bits(hashes, len(known))
                    hit = np.flatnonzero(known[one] & known[two])
                    if form == EXACT and length < window:
                        hit = np.array([i for i in hit if tokens.apart(int(at[i]), length)], np.int64)
                    found.append((at[hit], hashes[hit], length, form))
                if any(len(x[0]) for x in found):
                    yield _emit(batch, a, tokens, found)

    return _table(docs, id_col, text_col).mapInArrow(run, _WINDOWS)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, coverage: float = COVERAGE, run: int = RUN,
) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds, perhaps with other numbers, names or units.

    A pair counts if consistent alignments cover the share `coverage` of the item, or one of them `run` tokens in a row.
    Returns doc_id, text_hash (of the document's text, so that repeated or null ids stay apart by text), item_id,
    n_item_tokens, n_covered (of them, by matched windows of consistent alignments), coverage, same_values (whether
    all slots hold the item's own values). Null and empty texts match nothing. Windows of few words match with their own
    values only; items of one or two tokens only as a sentence or line of their own, and items below a window that have
    no word not within a longer row of values. Identical rows count as one document. Texts are searched whole; other columns are ignored.
    """
    items = settle(benchmark_windows(benchmark, item_col, item_text_col, window), "benchmark-windows")
    kinds = sorted(tuple(r) for r in items.select("length", F.substring("key", 1, 1)).distinct().collect())  # at most `window` lengths
    found = corpus_windows(docs, _filter(items, FILTER_BITS), kinds, id_col, text_col, window)
    theirs = items.select("key", F.col("id").alias("item_id"), F.col("n_tokens").alias("n_item_tokens"), F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"))
    joined = found.select("id", "mark", "pos", "length", "key", "slots").join(theirs, "key")
    # one alignment: the windows of a document that stand at the same distance from the item's
    pairs = F.arrays_zip("item_slots", "slots")
    lined = joined.groupBy("id", "mark", "item_id", "n_item_tokens", (F.col("pos") - F.col("item_pos")).alias("offset")).agg(
        F.collect_set(F.struct("item_pos", "length")).alias("at"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("filled")
    )
    values = F.array_distinct(F.transform("filled", lambda p: p["item_slots"]))
    lined = lined.where(F.size(values) == F.size("filled"))
    lined = lined.withColumn("same", F.forall("filled", lambda p: p["item_slots"] == p["slots"]))
    tokens = F.array_distinct(F.flatten(F.transform("at", lambda w: F.sequence(w["item_pos"], w["item_pos"] + w["length"] - 1))))
    covered = F.array_sort(tokens)
    in_a_row = F.exists(F.transform(covered, lambda x, i: F.coalesce(F.get(covered, i + (run - 1)) == x + (run - 1), F.lit(False))), lambda x: x)
    lined = lined.withColumn("long", in_a_row)
    by_item = lined.groupBy("id", "mark", "item_id", "n_item_tokens").agg(
        F.flatten(F.collect_set("at")).alias("at"), F.bool_and("same").alias("same_values"), F.bool_or("long").alias("long")
    )
    out = by_item.withColumn("n_covered", F.size(tokens))
    out = out.withColumn("coverage", F.col("n_covered") / F.col("n_item_tokens")).where((F.col("coverage") >= coverage) | F.col("long"))
    return out.select(F.col("id").alias("doc_id"), F.col("mark").alias("text_hash"), "item_id", "n_item_tokens", "n_covered", "coverage", "same_values")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark item, with the columns they came with."""
    found = contaminated(docs, benchmark, id_col, text_col, **options)
    id_, mark = fresh(docs, "contaminated_id"), fresh(docs, "contaminated_text")
    found = found.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(mark)).distinct()
    same = (F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))) == F.col(mark)) & F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(id_))
    return docs.join(found, same, "left_anti")
