import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from ebbmark.llm import simhash
from ebbmark.llm.components import components
from tests.llm.conftest import TEXTS


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Least position reachable by links of three or fewer bits."""
    a, root = np.array(prints, np.uint64), list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3).tolist():
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


def test_fingerprints_in_windows():
    for _, text, *_ in TEXTS:
        b = (text or "").encode()
        assert simhash.fingerprint(b, simhash.Settings()) == simhash.fingerprint(b, simhash.Settings(), window=5)
        if len(b) < 1000:
            assert simhash.fingerprint(b, simhash.Settings()) & (1 << 64) - 1 == brute_print(text or "")


def test_tree_finds_what_all_pairs_find():
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(12)]
    values = np.array(sorted({c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (1 << 64) - 1 for c in centres for _ in range(25)}), np.uint64)
    tree = simhash.BKTree(values)
    found = {(int(tree.value[n]), int(values[q])) for n, near in tree.links(values, 3) for q in near.tolist()}
    assert found == {(int(x), int(y)) for x in values for y in values if int(x ^ y).bit_count() <= 3}


def test_links_connect_the_same_prints_with_split_shards(spark):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    prints = sorted({centre ^ sum(1 << b for b in rng.sample(range(20), rng.randrange(6))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(200)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    fps = spark.createDataFrame([(s,) for s in signed], "fp long")
    settings = simhash.Settings(tree_size=16)  # the hot shard is dealt out as many trees
    got = {r.node: r.label for r in components(simhash.fingerprint_links(fps, settings), "a", "b").collect()}
    want = brute_components(prints)
    groups, mine = {}, {}
    for i, s in enumerate(signed):
        groups.setdefault(want[i], set()).add(s)
        mine.setdefault(got.get(s, s), set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_long_chain_and_hub_are_one_component(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_near_duplicates_of_the_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    prints = [brute_print(r.text or "") for r in rows]
    want = {rows[i].doc_id: (prints[i], rows[c].doc_id) for i, c in enumerate(brute_components(prints))}
    got = {r.doc_id: (int(r.h, 16), r.component_id) for r in
           simhash.near_duplicates(docs).withColumn("h", simhash.hexadecimal(F.col("fp"))).collect()}
    assert got == want


def test_odd_rows(docs, no_docs):
    rows = simhash.near_duplicates(docs).collect()
    by = {r.doc_id: r.component_id for r in rows}
    assert len(rows) == len(TEXTS) and by[4] == 0 and by[1] == by[2] == by[3] == 1 and by[None] is None
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [0, 1, 5, 6, 7, 8, None]
    assert simhash.near_duplicates(no_docs).collect() == [] and simhash.one_of_each(no_docs).collect() == []
