"""Near copies against brute-force Jaccard similarity of all pairs."""

import itertools
import random

import corpus_pipeline
from ebbmark.llm import nearcopies
from tests.llm.conftest import CLASH, TEXTS


def brute_groups(texts):
    """Least position reachable by links of similarity 0.8 or more, and all linked pairs."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set())
    root, linked = list(range(len(texts))), []

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] == sets[j] or both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
            linked.append((i, j))
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], linked


def planted_texts():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(30, 300))]
        texts.append(" ".join(base))
        for _ in range(12):  # copies of copies, on both sides of the least similarity
            copy = texts[rng.randrange(len(texts) - 1, len(texts))].split()
            for _ in range(rng.randrange(1, max(2, len(base) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


def test_planted_near_copies(spark, small):
    texts = planted_texts()
    groups, linked = brute_groups(texts)
    assert len(linked) > 100 and len(set(groups)) > 20
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, small)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups))


def test_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, small)
    assert sorted(r.doc_id for r in kept.collect()) == [rows[i].doc_id for i in sorted(set(brute_groups([r.text for r in rows])[0]))]


def test_odd_rows(docs, no_docs):
    kept = nearcopies.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted((r.doc_id for r in rows), key=str) == [0, 1, 5, 6, 7, 8, None]
    assert all(r[c] == f"{c}!" for r in rows for c in CLASH)  # other columns go through, whatever their names
    assert len(TEXTS) == docs.count() and nearcopies.one_of_each(no_docs).collect() == []


def crowd(seed, n):
    """Copies around two cores that share most of their words, some with edits in common, on both sides of the least similarity."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    core = [rng.choice(words) for _ in range(60)]
    other = core[:40] + [rng.choice(words) for _ in range(20)]
    edits = [(rng.randrange(60), rng.choice(words)) for _ in range(12)]
    texts = []
    for _ in range(n):
        copy = list(rng.choice([core, core, other]))
        for _ in range(rng.randrange(5)):
            at, word = rng.choice(edits) if rng.random() < 0.5 else (rng.randrange(60), rng.choice(words))
            copy[at] = word
        texts.append(" ".join(copy[rng.randrange(3):] + [rng.choice(words) for _ in range(rng.randrange(10))]))
    return texts


def test_crowded_buckets_lose_no_link(spark):
    # One row a band puts all sets that share any least hash into one bucket: the groups are then exact.
    for seed, crowded in ((1, 4), (2, 4), (3, 1)):
        texts = crowd(seed, 140)
        groups, linked = brute_groups(texts)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        kept = nearcopies.one_of_each(docs, settings=nearcopies.Settings(bands=64, rows=1, crowded=crowded))
        assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups))
        assert len(linked) > 50 and len(set(groups)) > 5


def test_copies_edited_apart_make_no_pairs(spark, monkeypatch):
    """Hundreds of texts around one passage, none similar enough: pairs do not grow with the square of their number."""
    seen, plain = {}, nearcopies.stored

    def counted(df, purpose):
        out = plain(df, purpose)
        seen[purpose] = seen.get(purpose, 0) + out.count()
        return out
    monkeypatch.setattr(nearcopies, "stored", counted)
    passage, pairs = [f"p{i}" for i in range(60)], []
    for n in (150, 600):
        texts = [" ".join(passage + [f"own{i}x{j}" for j in range(14)]) for i in range(n)]
        seen.clear()
        kept = nearcopies.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        assert kept.count() == n
        pairs.append(seen["near-copy-pairs"] + seen["near-copy-stars"])
    assert pairs[1] <= 8 * pairs[0] and pairs[1] < 600 * 40
