"""Toxicity scores by weak supervision.

1. Voters: lists of insults and patterns written by hand, and lists mined from labelled rows, each of words or word
   beginnings that toxic texts hold far more often. A voter fires or doesn't.
2. A generative label model takes the firing of each voter to depend on the hidden label. Expectation maximisation
   over all learning rows (labels where there are some) estimates how often each voter fires under either label and
   how voters go together; a voter that goes with others counts for less.
3. A linear classifier over hashed words and word beginnings is fitted to the posterior labels of a bounded sample,
   and scores every text.

Rows are learned from only where crc32 of the id, as text, leaves another remainder than 1 by 3.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnis.llm.common import id_and_text
from tarnis.llm.pretokens import Index
from tarnis.session import settle

#: Lists of the hand-written voters, in English, German, French and Spanish.
LISTS = {
    "stupidity": "idiot idiots stupid moron morons dumb fool imbecile dimwit idioten dumm dummkopf trottel blöd idiote stupide imbécile crétin abruti idiota estúpido imbécil tonto",
    "worth": "loser losers worthless pathetic useless nobody versager wertlos erbärmlich nutzlos minable inutile raté inútil patético fracasado perdedor",
    "filth": "scum trash garbage vermin filth abschaum müll dreck ungeziefer ordure déchet racaille vermine escoria basura mugre",
    "disgust": "disgusting vile repulsive gross sickening ekelhaft widerlich abscheulich dégoûtant répugnant ignoble asqueroso repugnante vil",
    "mockery": "clown clowns joke laughingstock freak witzfigur spinner bouffon guignol payaso ridículo hazmerreír",
    "threat": "kill die hurt destroy töten sterben vernichten tuer crever mourir détruire matar morir destruir",
    "contempt": "hate despise hass verachte hasse haine déteste méprise odio desprecio detesto",
    "silence": "shut shutup maul klappe ferme tais cállate",
}
LISTS = {k: frozenset(v.split()) for k, v in LISTS.items()}
_INSULT = "|".join(sorted(LISTS["stupidity"] | LISTS["worth"] | LISTS["filth"] | LISTS["mockery"]))
PATTERNS = {
    "addressed": re.compile(rf"\b(?:you|you're|u|du|tu|vous|eres)\b(?:\W+\w+){{0,3}}\W+(?:{_INSULT})\b"),
    "only_a": re.compile(rf"\b(?:only|such|nur|seulement|solo)\W+(?:an?\W+)?(?:{_INSULT})\b"),
    "exclaimed": re.compile(r"!{3,}"),
}
#: Mined lists: their number, the least share of toxic learning rows that hold an item, how many times more often these
#: must hold it, and by how many standard errors. The share bounds the items by the mean number of items in a text over
#: it, whatever the corpus.
MINED, SHARE, LIFT, ERRORS = 24, 0.005, 20.0, 5.0
NAMES = [*LISTS, *PATTERNS, *(f"mined_{i}" for i in range(MINED))]
PREFIXES = (4, 5)

ROUNDS = 12
#: Rows of the classifier's sample, about half of them likely toxic; features; passes; penalty.
SAMPLE, FEATURES, EPOCHS, PENALTY = 10_000, 1 << 18, 300, 1e-5
THRESHOLD = 0.7

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def items_of(words: set[str]) -> set[str]:
    """Words, and beginnings of longer ones, marked by a star."""
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n}


def sketch(text: str) -> int:
    """The least hash of three words in a row: mostly equal for near copies, unequal for other texts."""
    words = text.encode("utf-8", "surrogatepass").split()
    if len(words) < 3:
        return zlib.crc32(b" ".join(words))
    return min(zlib.crc32(c, zlib.crc32(b, zlib.crc32(a))) for a, b, c in zip(words, words[1:], words[2:], strict=False))


def errors(a, all_a, b, all_b):
    """By how many standard errors the share of a exceeds that of b; columns, numbers or arrays."""
    pooled = (a + b + 0.5) / (all_a + all_b + 1.0)
    return (a / all_a - b / all_b) / (pooled * (1.0 - pooled) * (1.0 / all_a + 1.0 / all_b)) ** 0.5


def votes(text: str, words: set[str], mined: dict[str, int]) -> int:
    """A bit for each voter that fires."""
    out = 0
    for i, words_ in enumerate(LISTS.values()):
        if not words.isdisjoint(words_):
            out |= 1 << i
    low = text.lower() if out or "!!!" in text else ""
    for i, pattern in enumerate(PATTERNS.values(), len(LISTS)):
        if low and pattern.search(low):
            out |= 1 << i
    for w in words:
        for item in (w, *(w[:n] + "*" for n in PREFIXES if len(w) > n)):
            if (voter := mined.get(item)) is not None:
                out |= 1 << (len(LISTS) + len(PATTERNS) + voter)
    return out


def remainder(id_: Column) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % 3


def mine(docs: DataFrame, labels: DataFrame) -> dict[str, int]:
    """The voter of each mined item. docs: doc_id, text of learning rows; labels: doc_id, toxic."""

    def run(batches):
        counts: dict[str, list[int]] = {}
        totals = [0, 0, 0]

        def rows():
            toxic, clean, spread = (pa.array([*(c[i] for c in counts.values()), totals[i]], pa.int64()) for i in range(3))
            out = pa.record_batch([pa.array([*counts, ""]), toxic, clean, spread], names=["item", "n_toxic", "n_clean", "spread"])
            counts.clear()
            totals[:] = [0, 0, 0]
            return out

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bit = 1 << sketch(text) % 63 if toxic else 0
                totals[1 - toxic] += 1
                for item in items_of(words_of(text)):
                    own = counts.get(item)
                    if own is None:
                        own = counts[item] = [0, 0, 0]
                    own[1 - toxic] += 1
                    own[2] |= bit
                if len(counts) > 300_000:
                    yield rows()
        yield rows()

    # labels grow with the documents, so they are never broadcast
    held = docs.join(labels.hint("merge"), "doc_id").select("text", "toxic")
    sums = held.mapInArrow(run, "item string, n_toxic long, n_clean long, spread long").groupBy("item")
    sums = settle(sums.agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"), F.bit_or("spread").alias("spread")).where("n_toxic > 0"), "items")
    total = sums.where("item = ''").first()
    if total is None:
        return {}
    # near copies share a sketch: texts are counted by the sketches met, as long as these can be told apart
    bits = F.bit_count("spread")
    texts = F.when(bits < 60, F.least(F.col("n_toxic").cast("double"), -63.0 * F.log(1 - bits / 63.0))).otherwise(F.col("n_toxic").cast("double"))
    all_toxic, all_clean = float(total["n_toxic"]), float(max(total["n_clean"], 1))
    fits = (F.col("a") >= max(2.5, SHARE * all_toxic)) & (F.col("a") / all_toxic >= LIFT * (F.col("n_clean") + 1) / (all_clean + 1))
    fits &= errors(F.col("a"), all_toxic, F.col("n_clean"), all_clean) >= ERRORS
    chosen = sums.where("item <> ''").withColumn("a", texts).where(fits).select("item")
    return {r[0]: zlib.crc32(r[0].encode()) % MINED for r in chosen.collect()}


@dataclass
class LabelModel:
    """prior: log odds of toxic; fires: probability of each voter under clean and toxic; weight: what is left of a
    voter's vote beside those it goes with."""

    prior: float
    fires: np.ndarray
    weight: np.ndarray

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        on = np.log(self.fires[1]) - np.log(self.fires[0])
        off = np.log1p(-self.fires[1]) - np.log1p(-self.fires[0])
        odds = self.prior + np.where(fired, on, off) @ self.weight
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def unfold(bits: np.ndarray) -> np.ndarray:
    return (bits[:, None] >> np.arange(len(NAMES))) & 1 > 0


def fit_label_model(patterns: DataFrame, rounds: int = ROUNDS) -> LabelModel:
    """patterns: votes, toxic (null where unknown), n. Only sums over voters and pairs of voters reach the driver."""
    m = len(NAMES)
    hand = len(LISTS) + len(PATTERNS)
    # to begin with, voters are right more often than not
    fires = np.stack([np.full(m, 0.02), np.full(m, 0.2)])
    model = LabelModel(np.log(0.1 / 0.9), fires, np.where(np.arange(m) < hand, 0.5, 1.0))
    for _ in range(rounds):

        def sums(batches, model=model):
            mass, first, both = np.zeros(2), np.zeros((2, m)), np.zeros((2, m, m))
            for batch in batches:
                bits, known, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                fired = unfold(bits.astype(np.int64)).astype(float)
                toxic = model.posterior(fired > 0)
                known = known.astype(float)
                toxic = np.where(np.isnan(known), toxic, known)
                for y, share in enumerate((1 - toxic, toxic)):
                    w = share * n
                    mass[y] += w.sum()
                    first[y] += w @ fired
                    both[y] += (fired * w[:, None]).T @ fired
            yield pa.record_batch([pa.array([np.concatenate([mass, first.ravel(), both.ravel()]).tobytes()], pa.binary())], names=["sums"])

        parts = patterns.select("votes", "toxic", "n").mapInArrow(sums, "sums binary").coalesce(1).mapInArrow(_add, "sums binary").first()
        total = np.frombuffer(parts[0]) if parts else np.zeros(2 + 2 * m + 2 * m * m)
        mass, first, both = total[:2], total[2 : 2 + 2 * m].reshape(2, m), total[2 + 2 * m :].reshape(2, m, m)
        fires = (first + np.array([[0.05], [0.1]])) / (mass[:, None] + 1.0)
        fires = np.clip(fires, 1e-7, 1 - 1e-7)
        # correlations within each label
        mean = first / np.maximum(mass[:, None], 1)
        cov = both / np.maximum(mass[:, None, None], 1) - mean[:, :, None] * mean[:, None, :]
        spread = np.sqrt(np.maximum(np.einsum("yjj->yj", cov), 1e-12))
        corr = np.clip(cov / (spread[:, :, None] * spread[:, None, :]), 0, 1)
        corr = (corr * (mass / max(mass.sum(), 1))[:, None, None]).sum(0)
        np.fill_diagonal(corr, 0)
        model = LabelModel(float(np.log((mass[1] + 0.5) / (mass[0] + 0.5))), fires, 1 / (1 + corr.sum(1)))
    return model


def _add(batches):
    total = None
    for batch in batches:
        for x in batch.column(0).to_pylist():
            total = np.frombuffer(x) if total is None else total + np.frombuffer(x)
    if total is not None:
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["sums"])


class Features:
    """Hashed features of word sets; remembers words it has met."""

    def __init__(self):
        self.index, self.rows = Index(), np.zeros((0, 1 + len(PREFIXES)), np.int32)

    def __call__(self, words: set[str]) -> np.ndarray:
        if len(self.index) > 200_000:
            self.__init__()
        known = len(self.index)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if len(self.index) > known:
            new = list(self.index)[known:] if known == 0 else [w for w in words if self.index[w] >= known]
            new.sort(key=self.index.__getitem__)
            made = [[zlib.crc32(x.encode()) % FEATURES for x in (w, *(w[:n] + "*" if len(w) > n else w for n in PREFIXES))] for w in new]
            if len(self.index) > len(self.rows):
                grown = np.zeros((max(2 * len(self.rows), len(self.index), 4096), self.rows.shape[1]), np.int32)
                grown[: len(self.rows)] = self.rows
                self.rows = grown
            self.rows[known : len(self.index)] = made
        return np.unique(self.rows[at])


def fit_classifier(rows: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression on 0/1 features, the last one the constant. Features that don't tell the
    labels apart by ERRORS standard errors, or that less than SHARE of either hold, stay out."""
    w = np.zeros(FEATURES + 1)
    if not rows:
        return w
    flat = np.concatenate(rows)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    a, b = (np.bincount(flat, x[of], minlength=FEATURES) for x in (toxic, 1 - toxic))
    z = np.abs(errors(a, toxic.sum() + 1e-3, b, (1 - toxic).sum() + 1e-3))
    common = (a >= SHARE * toxic.sum()) | (b >= SHARE * (1 - toxic).sum())
    tells = (common & (z >= ERRORS))[flat]
    flat, of = flat[tells], of[tells]
    square = np.full(FEATURES + 1, 1e-8)
    for _ in range(EPOCHS):
        odds = w[-1] + np.bincount(of, w[flat], minlength=len(rows))
        miss = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - toxic) * weight
        slope = np.bincount(flat, miss[of], minlength=FEATURES + 1) + PENALTY * w
        slope[-1] = miss.sum()
        square += slope * slope
        w -= 0.3 * slope / np.sqrt(square)
    return w


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out (never learned from), score (0 to 1, higher: more likely toxic), predicted (1 if score >= 0.7)
    of every whole text.

    Null and empty texts get the score of a text without words. Repeated rows get equal scores; rows with a null id
    are scored but not learned from; of repeated labels of one id the highest counts, null labels don't. Without any
    label the hand-written voters are left; without documents the result is empty. Inputs of a score are the text's
    words only. The classifier is fitted on about `sample` learning rows, chosen by a hash of the id; voters, label
    model and prior use all learning rows.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col)
    learn = rows.where(remainder(F.col("doc_id")) != 1)
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{toxic_col}`").cast("int").alias("toxic"))
    known = known.where("toxic in (0, 1)").where(remainder(F.col("doc_id")) != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    mined = spark.sparkContext.broadcast(mine(learn, known))

    def vote(batches):
        for batch in batches:
            bits = [votes(t, words_of(t), mined.value) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(bits, pa.int64())], names=["doc_id", "votes"])

    voted = learn.mapInArrow(vote, "doc_id long, votes long").join(known, "doc_id", "left")
    patterns = settle(voted.groupBy("votes", "toxic").agg(F.count(F.lit(1)).alias("n")), "votes")
    model = fit_label_model(patterns)

    # the shares of likely toxic and other rows that the sample takes
    def share(batches):
        for batch in batches:
            bits, n = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            high = model.posterior(unfold(bits.astype(np.int64))) >= 0.5
            yield pa.record_batch([pa.array([int(n[high].sum())]), pa.array([int(n[~high].sum())])], names=["high", "low"])

    sizes = patterns.select("votes", "n").mapInArrow(share, "high long, low long").agg(F.sum("high"), F.sum("low")).first()
    shares = [min(1.0, sample / 2 / max(n or 0, 1)) for n in sizes]
    scale = 1 << 20
    dice = F.pmod(F.xxhash64("doc_id"), F.lit(scale))

    def collect(batches):
        features = Features()
        for batch in batches:
            out = [], [], [], []
            for text, roll in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                toxic = float(model.posterior(unfold(np.array([votes(text, words, mined.value)])))[0])
                kept = shares[0] if toxic >= 0.5 else shares[1]
                if roll < kept * scale:
                    for column, x in zip(out, (features(words).astype("<i4").tobytes(), toxic, 1 / kept, sketch(text)), strict=True):
                        column.append(x)
            if out[0]:
                yield pa.record_batch([pa.array(out[0], pa.binary()), pa.array(out[1]), pa.array(out[2]), pa.array(out[3], pa.int64())], names=["features", "toxic", "weight", "sketch"])

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("sketch")
        own = [np.frombuffer(x, "<i4") for x in part["features"]]
        # both halves count alike, so the rarer label isn't drowned
        high = part["toxic"].to_numpy() >= 0.5
        weight = part["weight"].to_numpy().copy()
        for half in (high, ~high):
            if half.any():
                weight[half] /= weight[half].sum()
        return pd.DataFrame({"weights": [fit_classifier(own, part["toxic"].to_numpy(), weight).tobytes()]})

    chosen = learn.where(dice < F.lit(int(max(shares) * scale))).select("text", dice.alias("roll"))
    sampled = settle(chosen.mapInArrow(collect, "features binary, toxic double, weight double, sketch long"), "sample")
    fitted = sampled.groupBy(F.lit(0).alias("all")).applyInPandas(fit, "weights binary").first()
    weights = spark.sparkContext.broadcast(np.frombuffer(fitted[0]) if fitted else np.zeros(FEATURES + 1))

    def judge(batches):
        features = Features()
        for batch in batches:
            w = weights.value
            odds = np.array([w[-1] + w[features(words_of(t))].sum() for t in batch.column(1).to_pylist()])
            made = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            yield pa.record_batch([batch.column(0), pa.array(made, pa.float64())], names=["doc_id", "score"])

    scored = rows.mapInArrow(judge, "doc_id long, score double")
    held = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= F.lit(THRESHOLD)).cast("int").alias("predicted"))
