"""Ranked lexical search, clusters over compressed cells and exact top-k search against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tarnis.llm import centroids, lexical, vector_search

DOCS = "doc_id long, text string, score string, terms string, item_id string, rank string"
VECTORS = "vec_id long, embedding array<float>, cluster string, v string, score string, slot string"


# --- lexical ----------------------------------------------------------------------------------------------------


def brute_search(docs, items, k=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    rows = [(i, Counter(w), len(w)) for i, t in docs if (w := split(t))]
    n_docs, n_terms = len(rows), sum(r[2] for r in rows)
    df = Counter(t for r in rows for t in r[1])
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(split(t))
    out = []
    for item, query in asked.items():
        scored = []
        for i, tf, n in rows:
            m = 25 + (75 * n * n_docs) // n_terms
            w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in query if t in tf}
            score = sum(query[t] * w[t] * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in w)
            scored += [(-score, i is None, i or 0)] if score > 0 else []
        out += [(item, r + 1, None if missing else i, -s) for r, (s, missing, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def some_docs(n, seed=5):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "日本", "İx", "a-b", "x_y", "A1"]
    made = [(i, " ".join(rnd.choices(words, [1 / (j + 1) for j in range(len(words))], k=rnd.choice([1, 3, 20, 200])))) for i in range(n)]
    hot = made[7][1]  # a third of all rows are copies of one text
    return made + [(n + i, hot) for i in range(n // 2)]


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(lexical, "CELL", 40)
    monkeypatch.setattr(lexical, "BUCKET", 8)
    monkeypatch.setattr(lexical, "ITEMS", 3)


def test_lexical_search_is_that_of_all_pairs(spark, small_cells):
    docs = [*some_docs(160), (None, None), (None, "w1 w2 w3"), (900, ""), (901, " .,- "), (902, "w9 " * 30_000), (7, "w1 another text of id seven"), (903, "\u0000\x1cW1|w2")]
    items = [(i, t) for i, t in some_docs(12, 9)] + [(50, None), (51, ""), (52, "nowhere to be found"), (53, "w0 w0 w0"), (1, "w5 w6"), (None, "W1 日本")]
    made = spark.createDataFrame([(i, t, *["x"] * 4) for i, t in docs], DOCS).repartition(5)
    asked = spark.createDataFrame([(i, t, "x", 3) for i, t in items], "item_id long, text string, doc_id string, repeats int").repartition(2)
    got = sorted((tuple(r) for r in lexical.search(made, asked).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == brute_search(docs, items)


def test_lexical_search_without_rows(spark):
    docs = spark.createDataFrame([(1, "a b", *["x"] * 4)], DOCS)
    items = spark.createDataFrame([(1, "a c")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == lexical.search(docs, items.limit(0)).count() == 0
    assert [(r.doc_id, r.score) for r in lexical.search(docs, items).collect()] == [(1, math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 800)))]


def test_term_filter_passes_all_its_terms(spark):
    words = [f"term{i}" for i in range(500)]
    flags = lexical.term_filter(spark.createDataFrame([(w,) for w in words], "term string").repartition(3))
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    assert sorted(lexical.document_terms(docs, flags).first().terms) == sorted(words)
    others = spark.createDataFrame([(1, " ".join(f"other{i}" for i in range(5000)))], "doc_id long, text string")
    assert len(lexical.document_terms(others, flags).first().terms) < 500


def test_buckets_skip_and_bounds_hold():
    """No document within reach is lost, and the bounds do leave documents out."""
    rnd = np.random.default_rng(2)
    names = [f"t{i}" for i in range(40)]
    own = [sorted(rnd.choice(40, rnd.integers(1, 12), False).tolist()) for _ in range(600)]
    impacts = [rnd.integers(1, 900_000, len(o)).tolist() for o in own]
    docs = pa.table({"doc_id": np.arange(600), "terms": [[names[j] for j in o] for o in own], "impacts": impacts})
    query, places = np.zeros(40, np.int64), np.arange(12)
    query[:12] = np.arange(12, 0, -1) * 500
    exact = np.array([sum(int(query[j]) * x for j, x in zip(o, i)) for o, i in zip(own, impacts)])
    for least in np.sort(exact)[[-3, -50, 0]]:
        kept = set()
        for bucket in lexical._buckets(docs, pa.array(names)):
            rows = bucket.survivors(query, places, int(least))
            assert (bucket.scores(query, rows) == exact[bucket.ids[rows]]).all()
            kept |= set(bucket.ids[rows].tolist())
        assert kept >= set(np.flatnonzero(exact >= max(least, 1)).tolist())
        assert least < np.sort(exact)[-10] or len(kept) < 300


# --- clusters ---------------------------------------------------------------------------------------------------


def brute_clusters(rows, k=8, rounds=10, dims=64, scale=1024):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    ends = [list(r[1]) for r in first]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(ends))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(ends)):
            members = [v for (_, v), o in zip(kept, own) if o == j]
            if members:
                ends[j] = [sum(x) // len(members) for x in zip(*members)]
    return sorted(((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), key=str), ends


def vector_rows(n, dims, seed=1):
    rnd = np.random.default_rng(seed)
    middles = rnd.normal(0, 0.2, (6, dims))
    made = [(i, (middles[i % 6] + rnd.normal(0, 0.08, dims)).astype(np.float32).tolist()) for i in range(n)]
    return made + [(n + i, made[3][1]) for i in range(n // 2)] + [(5, made[9][1]), (5, made[5][1]), (None, made[2][1])]


AWKWARD = [(800, None), (801, []), (802, [float("nan")] + [0.0] * 63), (803, [None] * 64), (804, [float("inf")] * 64), (805, [0.1] * 63), (850, [0.0] * 64), (851, [-0.25] * 64), (852, [3e38] * 64)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, *["x"] * 4) for i, v in rows], VECTORS).repartition(4)


def test_clusters_are_those_of_full_vectors(spark):
    rows = vector_rows(240, 64) + AWKWARD
    got, ends, shares = centroids.cluster(frame(spark, rows))
    want, middles = brute_clusters([r for r in rows if r[0] != 852])  # too long to be kept
    assert sorted((tuple(r) for r in got.select("vec_id", "cluster", "distance").collect()), key=str) == want
    assert ends.tolist() == middles
    assert shares[0] == 1 and min(shares) < 0.7


def test_few_or_no_vectors(spark):
    rows = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-0.5] * 64)]
    got, ends, _ = centroids.cluster(frame(spark, rows))
    assert sorted(tuple(r) for r in got.collect()) == brute_clusters(rows)[0] and len(ends) == 3
    got, ends, _ = centroids.cluster(frame(spark, [(1, None), (2, [1.0])]))
    assert got.count() == len(ends) == 0


def test_intervals_hold_the_distance_and_decide_most():
    rnd = np.random.default_rng(4)
    values, ends = rnd.integers(-400, 400, (500, 16)), rnd.integers(-150, 150, (5, 16))
    cut = np.array([[c.min(), *np.quantile(c, np.arange(1, 64) / 64).astype(np.int64), c.max()] for c in values.T])
    codes = centroids.cells(values, cut)
    assert (centroids.unpack(pa.array(centroids.pack(codes)), 16) == codes).all()
    tables = centroids.Tables(ends, cut)
    low, high = tables.intervals(codes, (values**2).sum(1))
    exact = tables.distances(values)
    assert (low <= exact).all() and (exact <= high).all()
    own, fetched = centroids.place(tables, codes, (values**2).sum(1), pa.array(values.tolist(), pa.list_(pa.int32())))
    assert (own == exact.argmin(1)).all() and len(fetched) < 250


# --- exact top-k ------------------------------------------------------------------------------------------------


def brute_top(rows, k, every=50, scale=256):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in kept if i % every == 0}):
        scored = sorted((-sum(a * b for a, b in zip(x, v)), i) for j, x in kept if j == q for i, v in kept if i != q and len(v) == len(x))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("sizes", [(8192, 1024), (37, 3)])
def test_top_k_is_that_of_all_pairs(spark, sizes):
    rows = [r for r in vector_rows(300, 64) + AWKWARD if r[0] != 852] + [(100, [0.2] * 64), (1000, [0.5, 0.25]), (1001, [0.5]), (1050, []), (1051, [1.0, -1.0])]
    made = frame(spark, rows)
    got = vector_search.top_k(made, made.where("vec_id % 50 = 0"), candidates_per_cell=sizes[0], queries_per_cell=sizes[1])
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute_top(rows, 5)


def test_top_k_of_long_vectors_stays_exact(spark):
    """Beyond 2^53 doubles would round; vectors whose scores don't fit a long are left out."""
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.integers(-3, 3, 64).astype(float) * 2.0**17 + rnd.integers(0, 9, 64)) for i in range(60)]
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    made = frame(spark, [*rows, (852, [3e38] * 64)])
    got = vector_search.top_k(made, made.where("vec_id % 50 = 0"))
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 5)


def test_top_k_without_rows(spark):
    made = frame(spark, [(50, [0.5] * 4), (51, [1.0] * 4)])
    assert [tuple(r) for r in vector_search.top_k(made, made.where("vec_id % 50 = 0")).collect()] == [(50, 1, 51, 4 * 128 * 256)]
    assert vector_search.top_k(made.limit(0), made).count() == vector_search.top_k(made, made.limit(0)).count() == 0


def test_blocks_drop_candidates_early():
    rnd = np.random.default_rng(6)
    columns = rnd.integers(-60, 60, (64, 4000)).astype(np.float64)
    query = columns[:, 17] * 2.0
    at, scores, left = vector_search.search_block(np.arange(4000), columns, columns**2, query, None, 5)
    exact = (query @ columns).astype(np.int64)
    assert scores.tolist() == np.sort(exact)[::-1][:5].tolist() and (exact[at] == scores).all() and left < 400
