"""Near-duplicates by SimHash fingerprints and BK-trees.

A fingerprint has a bit set where more than half of a text's shingle hashes have it. Two distinct fingerprints are
linked if at most ``radius`` bits differ; a document's component is the least id that links lead to.

Distinct fingerprints are spread over shards so that any two within the radius meet: the 64 bits are cut into
``blocks`` ranges, of which at least ``blocks - radius`` are equal in such a pair, so each fingerprint goes to one
shard for every choice of that many ranges, named by their bits. A shard with more than ``tree_size``
fingerprints is dealt out as several trees, and the shard's fingerprints are sent to each of them, so the largest
group bounds neither a task's memory nor its time. In a task, the members of a tree form a BK-tree (children keyed by their
distance to the parent) and queries follow only edges within the radius. Found links are merged at once, so a
task returns at most one link per fingerprint and tree: connectivity is kept, all pairs of a group are never written.
Equal fingerprints are one row throughout.

Cases: a text without words (or null) has fingerprint 0 and links like any other; a text of fewer words than
a shingle is one shingle; repeated rows share a component; documents with a null id get a component
only from others' ids (null if there are none); an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ebbmark.llm.common import map_texts, read_texts
from ebbmark.llm.components import components
from ebbmark.session import stored


@dataclass(frozen=True)
class Settings:
    words: int = 3
    seed: int = 42
    radius: int = 3
    blocks: int = 5
    tree_size: int = 1024


def fingerprint(text: bytes, settings: Settings, window: int = 1 << 16) -> int:
    """Of UTF-8 bytes; shingles are hashed and their bits counted in windows of bounded size."""
    from xxhash import xxh64_intdigest
    words = text.lower().split()
    if not words:
        return 0
    k = min(settings.words, len(words))
    n = len(words) - k + 1
    bits = np.zeros(64, np.int64)
    for start in range(0, n, window):
        some = words[start:start + window + k - 1]
        shingles = some if k == 1 else map(b" ".join, zip(*(some[j:] for j in range(k))))
        h = np.fromiter((xxh64_intdigest(s, settings.seed) for s in shingles), np.uint64)
        bits += _bit_counts(h)
    return _majority(bits, n)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(bits: np.ndarray, n: int) -> int:
    value = np.packbits(2 * bits > n, bitorder="little").view(np.uint64)[0]
    return int(value.astype(np.int64))


def fingerprint_of_set(hashes: np.ndarray, window: int = 1 << 16) -> int:
    """Of distinct shingle hashes, each counted once."""
    bits = np.zeros(64, np.int64)
    for start in range(0, len(hashes), window):
        bits += _bit_counts(hashes[start:start + window])
    return _majority(bits, len(hashes))


def fingerprints(df: DataFrame, text: str = "text", settings: Settings = Settings(), **keep: Column) -> DataFrame:
    """``keep`` columns and ``fp`` (the 64 bits as a signed number) for each row."""
    def work() -> Callable:
        return lambda texts: {"fp": [fingerprint(t.encode(), settings) for t in texts]}
    return map_texts(read_texts(df, text, **keep), work, "fp long")


def _choices(settings: Settings) -> list[int]:
    """Bit masks of all choices of blocks that a pair within the radius can have in common."""
    edges = [64 * i // settings.blocks for i in range(settings.blocks + 1)]
    masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(settings.blocks)]
    equal = settings.blocks - settings.radius
    return [sum(c) for c in itertools.combinations(masks, equal)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class BKTree:
    """Tree over distinct 64-bit values. Built and searched for many values at a time: a node holds the
    members and queries that reach it."""

    def __init__(self, members: np.ndarray):
        self.value: list[np.uint64] = []
        self.children: list[dict[int, int]] = []
        self.root = self._add(members) if len(members) else -1

    def _add(self, members: np.ndarray) -> int:
        waiting = [(members, -1, 0)]
        while waiting:
            group, parent, key = waiting.pop()
            node = len(self.value)
            self.value.append(group[0])
            self.children.append({})
            if parent >= 0:
                self.children[parent][key] = node
            rest = group[1:]
            if len(rest):
                distance = np.bitwise_count(rest ^ group[0])
                for d in np.unique(distance):
                    waiting.append((rest[distance == d], node, int(d)))
        return 0

    def links(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(member's number, numbers of the queries within the radius of it)."""
        waiting = [(self.root, np.arange(len(queries)))] if self.root >= 0 else []
        while waiting:
            node, at = waiting.pop()
            distance = np.bitwise_count(queries[at] ^ self.value[node]).astype(np.int16)
            near = at[distance <= radius]
            if len(near):
                yield node, near
            for key, child in self.children[node].items():
                on = at[np.abs(distance - key) <= radius]
                if len(on):
                    waiting.append((child, on))


def _tree_links(members: np.ndarray, queries: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between members and queries (distinct signed numbers)."""
    tree = BKTree(members.view(np.uint64))
    values = np.array(tree.value, np.uint64)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    links = []
    q = queries.view(np.uint64)
    for node, near in tree.links(q, radius):
        a = int(values[node].astype(np.int64))
        for b in queries[near].tolist():
            if a != b and (x := root(a)) != (y := root(b)):
                parent[y] = x
                links.append((a, b))
    return links


def fingerprint_links(fps: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``a, b``: links that connect the same distinct fingerprints as all pairs within the radius would."""
    masks = F.array(*[F.lit(_signed(m)) for m in _choices(settings)])
    placed = fps.select("fp", F.posexplode(masks).alias("choice", "mask")).select(
        "fp", "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"))
    sizes = placed.groupBy("choice", "bits").agg(F.count("*").alias("size")).where("size > 1")
    trees = F.ceil(F.col("size") / settings.tree_size).cast("int")
    shared = placed.join(sizes, ["choice", "bits"]).select(
        "choice", "bits", "fp", F.pmod(F.xxhash64("fp"), trees).cast("int").alias("home"), trees.alias("trees"))
    sent = shared.select("choice", "bits", "fp", "home", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"))
    dealt = sent.select("choice", "bits", "tree", "fp", (F.col("home") == F.col("tree")).alias("member")) \
        .repartition("choice", "bits", "tree").sortWithinPartitions("choice", "bits", "tree", F.desc("member"))
    radius, chunk = settings.radius, 4 * settings.tree_size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, queries = None, [], []

        def found() -> Iterator[pa.RecordBatch]:
            if not members or len(members) + len(queries) < 2:
                return
            m = np.array(members, np.int64)
            links = _tree_links(m, np.concatenate([m, np.array(queries, np.int64)]), radius)
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in batches:
            for c, s, t, fp, member in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if (c, s, t) != key:
                    yield from found()
                    key, members, queries = (c, s, t), [], []
                if member:
                    members.append(fp)
                else:
                    queries.append(fp)
                    if len(queries) >= chunk:  # the tree's members stay, queries pass
                        yield from found()
                        queries = []
        yield from found()

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", settings: Settings = Settings(),
                    **keep: Column) -> DataFrame:
    """For each row: ``doc_id``, the ``keep`` columns, ``fp``, ``group`` (the same for all rows of a component) and
    ``component_id``, the least id of the documents that links lead to."""
    marked = stored(fingerprints(df, text, settings, doc_id=df[id], **keep), "fingerprints")
    least = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    linked = components(fingerprint_links(least.select("fp"), settings), "a", "b")
    labelled = least.join(linked, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("group"))
    ids = labelled.groupBy("group").agg(F.min("least").alias("component_id"))
    of_print = labelled.join(ids, "group").select("fp", "group", "component_id")
    return marked.join(of_print, "fp").select("doc_id", *keep, "fp", "group", "component_id")


def one_of_each(df: DataFrame, id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component, the row with the least id stays. Decisions are made
    on ids and hashes; texts are shuffled once, for the last join."""
    found = near_duplicates(df, id, text, settings, text_hash=F.xxhash64(df[text].cast("string")))
    best = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("best"))
    return rows_of(df, stored(best, "representatives"), id, text).select("row.*")


def rows_of(df: DataFrame, chosen: DataFrame, id: str, text: str) -> DataFrame:
    """For each ``best.doc_id`` and ``best.text_hash`` of ``chosen``, one row of ``df`` as the struct ``row``, and the row of ``chosen`` as
    the struct ``best``: names of either side cannot clash."""
    carried = df.select(F.struct("*").alias("row"), df[id].alias("doc_id"), F.xxhash64(df[text].cast("string")).alias("text_hash"))
    wanted = chosen.select(F.struct("*").alias("best"), F.col("best.doc_id").alias("best_id"), F.col("best.text_hash").alias("best_hash"))
    return carried.join(wanted, carried["doc_id"].eqNullSafe(wanted["best_id"]) & (carried["text_hash"] == wanted["best_hash"])) \
        .dropDuplicates(["best_id", "best_hash"]).select("row", "best")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
