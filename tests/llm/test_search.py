"""Hard negatives, ranked search and nearest neighbours against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbmark.llm import hardneg, lexical, nndescent

NAN, INF = float("nan"), float("inf")
CLASH = ["uid", "q", "id", "node", "windows", "score", "place", "n", "bag", "class"]


def vectors(spark, rows):
    return spark.createDataFrame([(*r, *["?"] * len(CLASH)) for r in rows],
                                 "vec_id long, embedding array<float>, label int, " + ", ".join(f"{c} string" for c in CLASH))


def odd_vectors(seed, n=150, dims=6):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(dims)], rng.randrange(3)) for i in range(n)]
    rows += [(n, rows[0][1], rows[0][2])] + [rows[10], rows[10]]  # a copy under another id, repeated rows
    rows += [(n + 1, rows[20][1], 1), (20, [0.125] * dims, 2)]    # one id with two vectors
    rows += [(None, [1.0] * dims, 1), (n + 2, None, 1), (n + 3, [1.0, None], 1), (n + 4, [NAN] * dims, 1), (n + 5, [INF] * dims, 1),
             (n + 6, [1.0] * dims, None), (n + 7, [], 1), (n + 8, [0.5], 2), (n + 9, [0.0] * dims, 0), (n + 10, [2.0 ** 20] * dims, 0)]
    return rows


def usable(rows):
    return sorted({(i, tuple(v), l) for i, v, l in rows if i is not None and l is not None and v is not None
                   and all(x is not None and math.isfinite(x) for x in v)})


def brute_negatives(rows, step):
    rows = [(i, [math.floor(256 * x) for x in v], l) for i, v, l in usable(rows)]
    out = []
    for a, q, label in rows:
        if a % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, l) for i, v, l in rows if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            fit = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i, _) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("settings", [hardneg.Settings(), hardneg.Settings(block_rows=40, anchor_rows=3, levels=(0.9, 0.5, 0.1), depths=(0.99, 0.5), chunk=2)])
def test_negatives_against_brute_force(spark, settings):
    rows = odd_vectors(1)
    found = hardneg.mine(vectors(spark, rows), F.col("vec_id") % 10 == 0, settings=settings)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in found.collect()) == brute_negatives(rows, 10)


def test_negatives_of_few_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.0], 1), (2, [0.2, 1.0], 2)]
    assert [tuple(r) for r in hardneg.mine(vectors(spark, rows), F.col("vec_id") % 100 == 0).collect()] == brute_negatives(rows, 100) != []
    for some in (rows[:1], []):
        assert hardneg.mine(vectors(spark, some), F.col("vec_id") % 100 == 0).collect() == []


def test_searches_join_neither_blocks_nor_anchors(spark, monkeypatch):
    # A join may be a broadcast of every pair of block and set of anchors, through the driver.
    plans, kept = [], hardneg.stored

    def noted(df, purpose, **more):
        if purpose == "negatives-found":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return kept(df, purpose, **more)
    monkeypatch.setattr(hardneg, "stored", noted)
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(6)], rng.randrange(3)) for i in range(900)]
    found = hardneg.mine(vectors(spark, rows), F.col("vec_id") % 10 == 0, settings=hardneg.Settings(block_rows=30, anchor_rows=16)).collect()
    assert sorted(tuple(r) for r in found) == brute_negatives(rows, 10)  # 30 blocks, several in a unit
    assert len(plans) >= 2 and not [p for p in plans if "Join" in p]


def test_negatives_of_empty_and_of_large_vectors(spark):
    empty = [(i, [], i % 2) for i in range(4)]
    large = [(i, [x * 2.0 ** k for x in (1.0, -0.5)], i % 2) for i, k in enumerate((0, 1, 0, 2, 9, 8, 12, 24))]  # components of 64 bits
    for some in (empty, large):
        found = hardneg.mine(vectors(spark, some), F.col("vec_id") % 2 == 0)
        assert sorted(tuple(r) for r in found.collect()) == brute_negatives(some, 2) != []


def test_best_rows_of_windows_over_several_blocks():
    rng = np.random.default_rng(3)
    for trial in range(20):
        shape = hardneg.Shape(3, 5, "int16")
        q, rows = rng.integers(-9, 9, (4, 5)), rng.integers(-9, 9, (90, 5))
        ids, labels, own, alike = np.arange(4), rng.integers(0, 2, 4), rng.integers(0, 60, 90), rng.integers(0, 2, 90)
        most = rng.integers(-20, 200, (4, 3)) if trial % 2 else np.full((4, 3), (1 << 63) - 1)
        least, owner, place = most - 60 if trial % 2 else np.full((4, 3), hardneg.NEVER), np.repeat(np.arange(4), 3), np.tile(np.arange(3), 4)
        asked = {"uids": (ids + 7).tobytes(), "ids": ids.tobytes(), "labels": labels.tobytes(), "matrix": q.astype(np.int16).tobytes(),
                 "windows": np.stack([owner, place, least.ravel(), most.ravel()]).tobytes()}
        held = [(own[b:b + 30], alike[b:b + 30], rows[b:b + 30].astype(np.int16)) for b in (0, 30, 60)]
        found = hardneg._best(asked, held, shape, np.arange(5), trial % 4 < 2, 6, 2).to_pylist()
        full = q @ rows.T
        wanted = []
        for k, p in zip(owner.tolist(), place.tolist()):
            fit = sorted((-int(full[k, j]), int(own[j])) for j in range(90) if (labels[k] == alike[j]) == (trial % 4 < 2) and own[j] != k
                         and least[k, p] <= full[k, j] <= most[k, p])
            wanted += [(k + 7, p, i, -s) for s, i in fit[:6]]
        assert [tuple(r.values()) for r in found] == wanted


def test_all_pairs_above_a_threshold():
    rng = np.random.default_rng(2)
    for trial in range(60):
        a, x = (rng.integers(-50, 50, (n, 7)) for n in (rng.integers(1, 6), rng.integers(1, 40)))
        if trial % 3 == 0:  # beyond what a float holds
            a, x = a * (1 << 21) + 1, x * (1 << 21) + 3
        full = a @ x.T
        least = np.quantile(full, rng.random(len(a)), axis=1)[0].astype(np.int64) if trial % 2 else np.full(len(a), int(full.max()) * 3 // 4)
        order = np.argsort(-(x.astype(float) ** 2).sum(axis=0))
        i, j, s = hardneg.above(a, least, x, order, 2)
        assert {(p, q, v) for p, q, v in zip(i.tolist(), j.tolist(), s.tolist())} == {
            (p, q, int(full[p, q])) for p, q in zip(*(z.tolist() for z in np.nonzero(full >= least[:, None])))}


def brute_rank(docs, items, top=10):
    bags = [(i, lexical.terms(t)) for i, t in docs]
    bags = [(i, t) for i, t in bags if t]
    total = sum(len(t) for _, t in bags)
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(lexical.terms(t))
    out = []
    for item, words in wanted.items():
        weight = {w: math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * sum(w in t for _, t in bags) + 1))) for w in words}
        scored = []
        for i, t in bags:
            m = 10 + 90 * len(t) * len(bags) // total
            s = sum(weight[w] * (10 ** 9 * t.count(w) // (1000 * t.count(w) + 8 * m)) for w in words if w in t)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "é", "x1", "ÉCOLE", "gamma", "日本", "d", "the", "THE"]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", ".", "\n", "-"]) for _ in range(rng.randrange(12)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "... !"), (None, "alpha beta"), (3, rows[3][1]), (3, "alpha alpha")] + [(1000 + i, rows[5][1]) for i in range(40)]


ITEMS = [(1, "Alpha beta the"), (2, "école 日本 the the"), (3, None), (4, ""), (5, "nowhere"), (None, "alpha"), (1, "Alpha beta the"), (6, "x1"), (6, "gamma d")]


@pytest.mark.parametrize("settings", [lexical.Settings(), lexical.Settings(item_bytes=12, cells=20)])
def test_ranking_against_brute_force(spark, settings):
    rows = corpus(4, 120)
    docs = spark.createDataFrame([(*r, *["?"] * len(CLASH)) for r in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASH))
    items = spark.createDataFrame([(*r, "?") for r in ITEMS], "item_id long, text string, doc_id string")
    got = lexical.rank(docs, items, settings=settings)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_rank(rows, ITEMS)


def test_ranking_of_empty_tables_and_long_texts(spark):
    docs = spark.createDataFrame([(0, "alpha " * 200_000), (1, "alpha beta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Alpha"), (2, "beta")], "item_id long, text string")
    assert sorted(tuple(r) for r in lexical.rank(docs, items).collect()) == brute_rank([(0, "alpha " * 200_000), (1, "alpha beta")], [(1, "Alpha"), (2, "beta")])
    assert lexical.rank(docs.limit(0), items).collect() == [] and lexical.rank(docs, items.limit(0)).collect() == []


def brute_nearest(rows, step):
    rows = sorted({(i, tuple(v)) for i, v, _ in rows if i is not None and v is not None
                   and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    width = max(len(v) for _, v in rows)
    m = np.array([v + (0.0,) * (width - len(v)) for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for k, (i, _) in enumerate(rows):
        if i % step == 0:
            for j, (other, _) in enumerate(rows):
                if other != i:
                    seen = out.setdefault(i, {})
                    seen[other] = max(seen.get(other, -2), float(m[k] @ m[j]))
    return {i: sorted(s.values(), reverse=True)[:5] for i, s in out.items()}, out


def test_neighbours_of_odd_rows(spark):
    rows = odd_vectors(3)
    best, every = brute_nearest(rows, 10)
    index = nndescent.build(vectors(spark, rows))
    found = {}
    for r in sorted(nndescent.search(index, F.col("id") % 10 == 0).collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r)
    assert set(found) == set(best)
    for i, list_ in found.items():
        assert [r["rank"] for r in list_] == list(range(1, len(best[i]) + 1)) and len({r.vec_id for r in list_}) == len(list_)
        assert all(abs(r.score - every[i][r.vec_id]) < 1e-12 for r in list_)
        assert [(-r.score, r.vec_id) for r in list_] == sorted((-r.score, r.vec_id) for r in list_)
        assert np.allclose([r.score for r in list_], best[i], atol=0.01)


def test_neighbours_recall_where_cells_are_many(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((8, 24))
    x = np.concatenate([rng.standard_normal((1500, 24)) + 2 * centres[rng.integers(0, 8, 1500)], np.repeat(rng.standard_normal((1, 24)), 500, axis=0)])
    rows = [(i, [float(np.float32(c)) for c in v], 0) for i, v in enumerate(x)]
    index = nndescent.build(vectors(spark, rows), settings=nndescent.Settings(leaf=128, degree=16, beam=96))
    assert index.nodes.count() == 1501
    found = {}
    for r in nndescent.search(index, F.col("id") % 50 == 0).collect():
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    best, every = brute_nearest(rows, 50)
    assert set(found) == set(best) and all(len(f) == 5 for f in found.values())
    hits = sum(sum(s >= best[i][-1] - 1e-12 for s in f.values()) for i, f in found.items())
    assert hits >= 0.9 * 5 * len(best)
    # Copies of one vector: the smallest ids, not one's own.
    assert sorted(found[1550]) == [1500, 1501, 1502, 1503, 1504] and sorted(found[1500]) == [1501, 1502, 1503, 1504, 1505]


@pytest.mark.parametrize("n", [0, 1, 3])
def test_neighbours_of_few_rows(spark, n):
    rows = [(i, [1.0, float(i)], 0) for i in range(n)]
    found = nndescent.search(nndescent.build(vectors(spark, rows)), F.col("id") % 50 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found) == ([(0, 1, 1), (0, 2, 2)] if n == 3 else [])
