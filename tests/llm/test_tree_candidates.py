"""Near copies that share no MinHash bucket are found by the BK-trees over fingerprints."""

import random

from ebbmark.llm import nearcopies


def test_links_of_fingerprints_are_candidates(spark):
    rng, settings = random.Random(3), nearcopies.Settings(bands=1, rows=384)
    texts, near = [], set()
    for i in range(10):
        words = [f"w{rng.randrange(5000)}" for _ in range(2500)]
        copy = list(words)
        for place in rng.sample(range(2500), 3):
            copy[place] = "changed"
        sets = [nearcopies.shingles(" ".join(w).encode(), settings) for w in (words, copy)]
        prints = [nearcopies.fingerprint_of_set(h) & ((1 << 64) - 1) for h in sets]
        sketches = [nearcopies.Sketcher(settings).sketch(h)[0] for h in sets]
        if (prints[0] ^ prints[1]).bit_count() <= settings.radius and sketches[0] != sketches[1]:
            near.add(2 * i + 1)
        texts += [" ".join(words), " ".join(copy)]
    assert len(near) >= 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in nearcopies.one_of_each(docs, settings=settings).collect()}
    assert not kept & near and set(range(0, 20, 2)) <= kept
