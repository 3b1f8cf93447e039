"""Near copies by exact Jaccard similarity of word shingles, with candidates from BK-trees over SimHash fingerprints and from banded MinHash.

A text's set is the hashes of its runs of ``words`` words. Two sets are linked if their Jaccard similarity is at least ``least`` (a
ratio of whole numbers, judged exactly); a document's group is what links lead to.

Equal sets are one row throughout. Each set gets a SimHash fingerprint; those that the BK-trees of ``simhash`` link (at most ``radius`` bits differ), and sets with the
same fingerprint, are candidates. A radius that covers the least similarity alone would put nearly all fingerprints in one shard (copies at 0.8 were
counted to differ in up to 11 bits), so MinHash finds the others: each set gets ``bands * rows`` MinHash values; sets that agree in all values of a band share a
bucket. At similarity 0.8, 48 bands of 8 miss a pair with probability 1.5e-4, at 0.85 with 3e-7. First every set of a bucket is checked against
the bucket's least one and confirmed links are merged; then what still lies in different groups of a bucket is checked: pair by pair in a bucket of at most
``crowded`` sets; in the crowds that larger ones connect with the set nearest to what most of a crowd holds, and then where two sets share one of their rarest differences
from that (``_shared_edits``), which loses no link. Before a pair of a small bucket is written its lengths must allow the similarity, and one bit of each MinHash value must not disagree more
than five standard deviations above what the least similarity gives. Shingles are written only for sets that share a bucket.

Cases: a text without words (or null) has the empty set; a text of fewer words than a shingle is one shingle; repeated rows and
null ids are treated as in ``simhash.one_of_each``; an empty table gives an empty one; other columns are carried along, whatever their names.
The shingle hashes of one text, eight bytes a word, are held at once in a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ebbmark.llm import simhash
from ebbmark.llm.common import map_texts, read_texts
from ebbmark.llm.components import components
from ebbmark.llm.simhash import fingerprint_links, fingerprint_of_set, rows_of
from ebbmark.session import stored


@dataclass(frozen=True)
class Settings:
    words: int = 5
    least: tuple[int, int] = (4, 5)
    seed: int = 42
    radius: int = 3
    bands: int = 48
    rows: int = 8
    crowded: int = 32

    @property
    def most_unequal(self) -> int:
        n, share = self.bands * self.rows, (1 - self.least[0] / self.least[1]) / 2
        return math.ceil(n * share + 5 * math.sqrt(n * share * (1 - share)))


def shingles(text: bytes, settings: Settings) -> np.ndarray:
    """The distinct shingle hashes of UTF-8 bytes, ascending."""
    from xxhash import xxh64_intdigest
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(settings.words, len(words))
    return np.unique(np.fromiter((xxh64_intdigest(b" ".join(s), settings.seed) for s in zip(*(words[j:] for j in range(k)))), np.uint64))


class Sketcher:
    """Of a set: a name by bucket for each band, and one bit of each MinHash value."""

    STEP = 256

    def __init__(self, settings: Settings):
        n, rng = settings.bands * settings.rows, np.random.default_rng(settings.seed)
        self.times, self.plus, self.fold = (rng.integers(0, 1 << 64, n, np.uint64) for _ in range(3))
        self.times |= np.uint64(1)
        self.fold |= np.uint64(1)
        self.shape = settings.bands, settings.rows

    def sketch(self, hashes: np.ndarray) -> tuple[list[int], list[int]]:
        least = np.full(len(self.times), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(hashes), self.STEP):
            np.minimum(least, (hashes[i:i + self.STEP, None] * self.times + self.plus).min(axis=0), out=least)
        mixed = (least ^ (least >> np.uint64(29))) * self.fold
        buckets = mixed.reshape(self.shape).sum(axis=1, dtype=np.uint64)
        bits = np.packbits((mixed >> np.uint64(63)).astype(np.uint8), bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % 8, np.uint8)])
        return buckets.view(np.int64).tolist(), bits.view(np.int64).tolist()


def sketches(df: DataFrame, text: str, settings: Settings, **keep: Column) -> DataFrame:
    """``keep`` columns, ``set`` (a hash of it), its ``size``, ``print`` (SimHash), ``buckets`` and ``bits`` for each row."""
    def work() -> Callable:
        from xxhash import xxh64_intdigest
        sketcher = Sketcher(settings)

        def compute(texts):
            names, sizes, prints, buckets, bits = [], [], [], [], []
            for t in texts:
                h = shingles(t.encode(), settings)
                b, s = sketcher.sketch(h)
                name = xxh64_intdigest(h.tobytes(), settings.seed)
                names.append(name - (1 << 64) if name >> 63 else name)
                sizes.append(len(h))
                prints.append(fingerprint_of_set(h))
                buckets.append(b)
                bits.append(s)
            return {"set": names, "size": sizes, "print": prints, "buckets": buckets, "bits": bits}
        return compute
    return map_texts(read_texts(df, text, **keep), work, "set long, size long, print long, buckets array<long>, bits array<long>")


def _alike(a: str, b: str, settings: Settings) -> Column:
    """Whether sizes and bits of two sets allow the least similarity."""
    p, q = settings.least
    x, y = F.col(f"{a}.size"), F.col(f"{b}.size")
    unequal = sum((F.bit_count(F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])) for i in range(-(-settings.bands * settings.rows // 64))), F.lit(0))
    return (q * F.least(x, y) >= p * F.greatest(x, y)) & (unequal <= settings.most_unequal)


def _confirmed(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The pairs ``a, b`` whose sets are as similar as they must be."""
    p, q = settings.least
    x, y = F.col("x.hashes"), F.col("y.hashes")
    both = F.size(F.array_intersect(x, y))
    return pairs.alias("p").join(sets.alias("x"), F.col("p.a") == F.col("x.set")).join(sets.alias("y"), F.col("p.b") == F.col("y.set")) \
        .where((p + q) * both >= p * (F.size(x) + F.size(y))).select("p.a", "p.b")


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``set, group`` after more links ``a, b``: only the groups that they join are gone through again."""
    of_a = links.join(groups.select(F.col("set").alias("a"), F.col("group").alias("x")), "a")
    both = of_a.join(groups.select(F.col("set").alias("b"), F.col("group").alias("y")), "b").where("x <> y").select("x", "y").distinct()
    joined = components(both, "x", "y")
    return stored(groups.join(joined, F.col("group") == F.col("node"), "left").select("set", F.coalesce("label", "group").alias("group")), "near-copy-groups")


def _tree_candidates(distinct: DataFrame, settings: Settings) -> DataFrame:
    """``a, b``: sets with the same fingerprint, as links to the least of them, and those least ones where BK-trees link their fingerprints."""
    named = distinct.where("size > 0").select("set", F.col("print").alias("fp"))
    least = stored(named.groupBy("fp").agg(F.min("set").alias("first")), "near-copy-prints")
    links = fingerprint_links(least.select("fp"), simhash.Settings(words=settings.words, seed=settings.seed, radius=settings.radius,
                                                                   blocks=settings.radius + 2))
    same = named.join(least, "fp").where("set <> first").select(F.col("first").alias("a"), F.col("set").alias("b"))
    near = links.join(least.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    return same.union(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def _possible(pairs: DataFrame, facts: DataFrame, settings: Settings) -> DataFrame:
    return pairs.distinct().alias("p").join(facts.alias("x"), F.col("p.a") == F.col("x.set")).join(facts.alias("y"), F.col("p.b") == F.col("y.set")) \
        .where(_alike("x", "y", settings)).select("p.a", "p.b")


def set_groups(df: DataFrame, distinct: DataFrame, id: str, text: str, settings: Settings) -> DataFrame:
    """``set, group`` of all sets that share a bucket or are linked by their fingerprints, as links between all pairs of at least the least similarity would group
    them. ``distinct``: ``set, size, print, buckets, bits`` and ``best``, a document of the set, one row a set."""
    placed = distinct.where("size > 0").select("set", F.posexplode("buckets").alias("band", "bucket"))
    first = placed.groupBy("band", "bucket").agg(F.min("set").alias("first"), F.count("*").alias("sets")).where("sets > 1")
    shared = stored(placed.join(first, ["band", "bucket"]).select("band", "bucket", "set", "first"), "near-copy-buckets")
    facts = distinct.select("set", "size", "bits")
    of_trees = stored(_possible(_tree_candidates(distinct, settings), facts, settings), "near-copy-tree-pairs")
    wanted = shared.select("set").union(of_trees.select("a")).union(of_trees.select("b")).distinct()
    some = distinct.join(wanted, "set", "left_semi").select("set", "best")

    def work() -> Callable:
        return lambda texts: {"hashes": [shingles(t.encode(), settings).view(np.int64) for t in texts]}
    texts = rows_of(df, some, id, text).select("best.set", F.col(f"row.{text}").cast("string").alias("text"))
    sets = stored(map_texts(texts, work, "hashes array<long>"), "near-copy-sets")

    starred = shared.where("set <> first").select(F.col("first").alias("a"), F.col("set").alias("b"))
    stars = stored(_possible(starred, facts, settings).union(of_trees).distinct(), "near-copy-stars")
    groups = _merged(sets.select("set", F.col("set").alias("group")), stored(_confirmed(stars, sets, settings), "near-copy-links"))

    apart = stored(_apart(shared, groups), "near-copy-rest")
    few = apart.where(F.col("sets") <= settings.crowded).join(facts, "set")
    x, y = few.alias("x"), few.alias("y")
    pairs = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.set") < F.col("y.set"))
                   & (F.col("x.group") != F.col("y.group")) & _alike("x", "y", settings)).select(F.col("x.set").alias("a"), F.col("y.set").alias("b"))
    # Sets that crowded buckets connect are taken as one crowd, so that each is gone through once, not once a band.
    joined = components(apart.where((F.col("sets") > settings.crowded) & (F.col("set") != F.col("first"))).select("first", "set").distinct(), "first", "set")
    spokes = stored(joined.select(F.col("label").alias("centre"), F.col("node").alias("set")), "near-copy-crowds")
    edited = stored(_edited(spokes, sets, settings), "near-copy-edits")
    best = edited.groupBy("centre").agg(F.min(F.struct("over", "set")).alias("best")).select("centre", F.col("best.over").alias("least"), F.col("best.set").alias("core"))
    towards = edited.join(best, "centre").where("set <> core").select(F.least("set", "core").alias("a"), F.greatest("set", "core").alias("b"))
    more = stored(pairs.union(towards).distinct().join(stars, ["a", "b"], "left_anti"), "near-copy-pairs")
    groups = _merged(groups, stored(_confirmed(more, sets, settings), "near-copy-links"))
    met = stored(_shared_edits(edited, best, groups, settings).distinct(), "near-copy-pairs")
    return _merged(groups, stored(_confirmed(met, sets, settings), "near-copy-links"))


def _apart(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of buckets that hold sets of different groups, with the bucket's number of ``sets``."""
    named = shared.join(groups, "set")
    mixed = named.groupBy("band", "bucket").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("sets")).where("low <> high")
    return named.join(mixed.select("band", "bucket", "sets"), ["band", "bucket"])


def _edited(spokes: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """``centre, set, edits, n, over``: how each set differs from what at least half of the sets around a centre hold, and by how many edits (times
    the sum of the similarity's numbers) it lies over what its own size allows."""
    p, q = settings.least
    members = spokes.groupBy("centre").agg(F.count("*").alias("members"))
    common = spokes.join(sets, "set").select("centre", F.explode("hashes").alias("hash")).groupBy("centre", "hash").agg(F.count("*").alias("holders"))
    core = stored(common.join(members, "centre").where("2 * holders >= members").groupBy("centre").agg(F.collect_list("hash").alias("core")), "near-copy-cores")
    core = F.coalesce("core", F.array().cast("array<long>")), core
    around = spokes.join(sets, "set").join(core[1], "centre", "left").withColumn("core", core[0])
    return around.select("centre", "set", F.size("hashes").alias("size"), F.concat(F.array_except("hashes", "core"), F.array_except("core", "hashes")).alias("edits")) \
        .withColumn("n", F.size("edits")).withColumn("over", (p + q) * F.col("n") - (q - p) * F.col("size"))


def _shared_edits(edited: DataFrame, best: DataFrame, groups: DataFrame, settings: Settings) -> DataFrame:
    """``a, b``: pairs of different groups around a common centre that may be similar enough.

    Two sets are linked only if their difference is at most a fixed share of the sum of their sizes. They differ in the edits that they do not share, so they must share at
    least half of what both lie over their sizes' allowance (``over``), taken together. The set that lies least over, the core set, was compared with all. A set out of
    its group lies over by more than the core set lies under, which bounds the overlap from either side alone: by ``any`` edits for a set out of the core set's
    group whoever the partner is, by ``far`` edits for any set whose partner is out of that group. A set shows so many of its rarest edits that a
    partner with that overlap is met in one. Copies that were edited in different places, however many, meet nowhere.
    """
    p, q = settings.least
    core_group = best.join(groups.withColumnRenamed("set", "core"), "core").select("centre", "least", F.col("group").alias("core_group"))
    rows = edited.join(groups, "set").join(core_group, "centre").withColumn("out", F.col("group") != F.col("core_group"))
    crowd = rows.groupBy("centre").agg(F.max("out").alias("some")).where("some").select("centre")
    half = 2 * (p + q)
    rows = stored(rows.join(crowd, "centre").select(
        "centre", "set", "group", "out", "n", F.greatest(F.lit(1), F.ceil((F.col("over") + F.col("least")) / half)).alias("any"),
        F.greatest(F.lit(1), F.ceil((F.col("over") - F.col("least") + 1) / half)).alias("far"), F.explode("edits").alias("edit")), "near-copy-shared")
    met = rows.groupBy("centre", "edit").agg(F.count("*").alias("holders"), F.min("group").alias("low"), F.max("group").alias("high"))
    # The rarest edits are those of one set alone. They meet nothing and only count.
    of_set = Window.partitionBy("centre", "set")
    alone = F.col("n") - F.count("*").over(of_set)
    placed = rows.join(met.where("holders > 1"), ["centre", "edit"]) \
        .withColumn("place", alone + F.row_number().over(of_set.orderBy("holders", "edit"))).where("low <> high")
    shown = F.col("n") + 1 - F.col("place")  # edits from here on, this one included
    placed = stored(placed.select("centre", "edit", "set", "group", "out", (shown >= F.col("any")).alias("any"), (shown >= F.col("far")).alias("far"))
                    .where("out AND any OR far"), "near-copy-shown")
    on = (F.col("x.centre") == F.col("y.centre")) & (F.col("x.edit") == F.col("y.edit")) & (F.col("x.group") != F.col("y.group"))
    out = placed.where("out AND any").alias("x")
    one = out.join(placed.where("NOT out AND far").alias("y"), on)
    two = out.where("far").join(placed.where("out AND any AND far").alias("y"), on & (F.col("x.set") < F.col("y.set")))
    return one.union(two).select(F.least("x.set", "y.set").alias("a"), F.greatest("x.set", "y.set").alias("b"))


def one_of_each(df: DataFrame, id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of ``df`` without near copies: of each group, the row with the least id stays."""
    marked = stored(sketches(df, text, settings, doc_id=df[id], text_hash=F.xxhash64(df[text].cast("string"))), "near-copy-sketches")
    distinct = stored(marked.groupBy("set").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("best"), F.first("size").alias("size"),
        F.first("print").alias("print"), F.first("buckets").alias("buckets"), F.first("bits").alias("bits")), "near-copy-distinct")
    grouped = set_groups(df, distinct, id, text, settings)
    best = distinct.join(grouped, "set", "left").groupBy(F.coalesce("group", "set").alias("group")).agg(F.min("best").alias("best"))
    return rows_of(df, stored(best, "representatives"), id, text).select("row.*")
