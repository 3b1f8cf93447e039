"""Ranked lexical search by classes of equal bags.

All documents are ranked for every item of a small query table. Documents are restricted to the items' vocabulary; those with the same
term frequencies and the same length factor m score alike for every item, so they form a class. Classes are found by a hash and verified by
the vectors themselves, each is scored once, and classes are expanded to their documents by ascending id at the end.

Only a class's ``top`` least ids can come among an item's first ``top`` documents, and only classes that come among the item's first
``top`` by score and least id can hold one: keeping just these, in every task and again after the shuffle, loses nothing.

Items are taken in sets of about ``item_bytes`` of text (a longer item stands with what hashes to its set), so the vocabulary that travels to the
tasks is bounded whatever the number of items; every set ranks all documents. Counts N, L and df are over all documents.

Cases: texts are read as whole; null, empty and term-free texts have no term, count in neither N nor L and are not returned; so do not items
without a term or id; rows of one item id are one item; repeated document rows count and return each; equal scores stand by ascending id, a null id
last; a term in nearly all documents may weigh nothing or less; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ebbmark.llm.common import map_texts, read_texts
from ebbmark.session import stored

#: Fixed by the contract, of lower-cased text: letters and digits of ASCII, and everything beyond.
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Settings:
    top: int = 10
    item_bytes: int = 8 << 20
    cells: int = 1 << 21  # scores held at once in a task


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(LOWER))


def _bags(docs: DataFrame, id: str, text: str, vocabulary: list[str]) -> DataFrame:
    """``doc_id, n, bag`` of documents with a term; ``bag``: numbers of vocabulary terms, ascending, each followed by its frequency."""
    def work() -> Callable:
        number = {t: i for i, t in enumerate(vocabulary)}

        def compute(texts):
            ns, bags = [], []
            for t in texts:
                found = terms(t)
                ns.append(len(found))
                bag = sorted((number[w], c) for w, c in Counter(found).items() if w in number)
                bags.append([v for pair in bag for v in pair])
            return {"n": ns, "bag": bags}
        return compute
    return map_texts(read_texts(docs, text, doc_id=docs[id]), work, "n long, bag array<int>").where("n > 0")


def rank(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
         settings: Settings = Settings()) -> DataFrame:
    """``item_id, rank, doc_id, score``: the best documents of each item."""
    wanted = stored(items.select(items[item].alias("item_id"), items[item_text].cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct(), "lexical-items")
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    sets = max(1, -(-size // settings.item_bytes))
    result = None
    for k in range(sets):
        some = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(sets)) == k).collect()
        ranked = _ranked(docs, id, text, [(r.item_id, r.text) for r in some], wanted.schema["item_id"].dataType, settings)
        result = ranked if result is None else result.unionByName(ranked)
    return result


def _ranked(docs: DataFrame, id: str, text: str, items: list[tuple], kind, settings: Settings) -> DataFrame:
    spark = docs.sparkSession
    of_item: dict = {}
    for key, t in items:
        of_item.setdefault(key, set()).update(terms(t))
    keys = sorted(of_item)
    vocabulary = sorted(set().union(*of_item.values())) if of_item else []

    bags = stored(_bags(docs, id, text, vocabulary), "lexical-bags")
    n_docs, n_terms = bags.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    pairs = bags.select(F.posexplode("bag").alias("at", "v")).where("at % 2 = 0")
    holding = np.zeros(len(vocabulary), np.int64)
    for r in pairs.groupBy("v").count().collect():  # bounded by the vocabulary
        holding[r.v] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * h + 1))) for h in holding.tolist()], np.int64)

    factor = F.lit(10).cast("long") + F.expr(f"(90L * n * {n_docs}L) div {n_terms}L")
    marked = bags.withColumn("m", factor).where(F.size("bag") > 0).withColumn("hash", F.xxhash64("bag", "m")) \
        .withColumn("uid", F.monotonically_increasing_id())
    # Rows of one hash are told apart by the bags themselves; every task sends on at most ``top`` rows of a class.
    of_class = Window.partitionBy("hash", "m", "bag").orderBy(F.col("doc_id").isNull(), "doc_id", "uid")
    members = stored(stored(marked, "lexical-marked")
                     .withColumn("place", F.row_number().over(of_class)).withColumn("class", F.first("uid").over(of_class.rowsBetween(Window.unboundedPreceding, 0)))
                     .where(F.col("place") <= settings.top).select("class", "place", "doc_id", "uid", "m", F.when(F.col("place") == 1, F.col("bag")).alias("bag")), "lexical-members")
    classes = members.where("place = 1").select("class", "doc_id", "m", "bag")
    found = _scored(classes, keys, of_item, vocabulary, weight, settings)
    first = Window.partitionBy("item").orderBy(F.desc("score"), F.col("least").isNull(), "least", "class")
    best = found.withColumn("at", F.row_number().over(first)).where(F.col("at") <= settings.top)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").isNull(), "doc_id", "uid")
    ranked = best.join(members.select("class", "doc_id", "uid"), "class").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= settings.top)
    names = spark.createDataFrame(list(enumerate(keys)), "item int, item_id string").withColumn("item_id", F.col("item_id").cast(kind)) if keys else \
        spark.createDataFrame([], "item int, item_id string").withColumn("item_id", F.col("item_id").cast(kind))
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def _scored(classes: DataFrame, keys: list, of_item: dict, vocabulary: list[str], weight: np.ndarray, settings: Settings) -> DataFrame:
    """``item, class, least, score``: of every task, the best classes of each item."""
    number = {t: i for i, t in enumerate(vocabulary)}
    postings: list[list[int]] = [[] for _ in vocabulary]
    for i, key in enumerate(keys):
        for t in of_item[key]:
            postings[number[t]].append(i)
    starts = np.concatenate([[0], np.cumsum([len(p) for p in postings])]).astype(np.int64)
    holders = np.array([i for p in postings for i in p], np.int64)
    width, top, step = max(1, len(keys)), settings.top, max(1, settings.cells // max(1, len(keys)))

    def score(bags: list[np.ndarray], m: np.ndarray) -> np.ndarray:
        lengths = np.array([len(b) // 2 for b in bags])
        flat = np.concatenate(bags).astype(np.int64).reshape(-1, 2)
        row = np.repeat(np.arange(len(bags)), lengths)
        term, tf = flat[:, 0], flat[:, 1]
        part = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
        many = starts[term + 1] - starts[term]
        at = np.repeat(starts[term], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        out = np.zeros((len(bags), width), np.int64)
        np.add.at(out.reshape(-1), np.repeat(row, many) * width + holders[at], np.repeat(part, many))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {"item": np.zeros(0, np.int64), "score": np.zeros(0, np.int64), "class": np.zeros(0, np.int64)}
        least_of: dict[int, object] = {}
        enough = np.zeros(width, np.int64)  # an item's worst kept score, once ``top`` are kept

        def cut() -> None:
            nulls = np.array([least_of[c] is None for c in kept["class"].tolist()], bool)
            ids = np.array([least_of[c] for c in kept["class"].tolist()], object)
            ids[nulls] = 0 if not len(ids[~nulls]) else ids[~nulls][0]
            place = np.unique(ids, return_inverse=True)[1] if len(ids) else np.zeros(0, np.int64)
            o = np.lexsort((kept["class"], place, nulls, -kept["score"], kept["item"]))
            item = kept["item"][o]
            begin = np.searchsorted(item, item)
            o = o[np.arange(len(o)) - begin < top]
            for name in kept:
                kept[name] = kept[name][o]
            alive = set(kept["class"].tolist())
            for c in [c for c in least_of if c not in alive]:
                del least_of[c]
            enough[:] = 0
            full = np.bincount(kept["item"], minlength=width) >= top
            worst = np.full(width, np.iinfo(np.int64).max)
            np.minimum.at(worst, kept["item"], kept["score"])
            enough[full] = worst[full]

        for batch in batches:
            names, ids = batch.column("class").to_numpy(), batch.column("doc_id").to_pylist()
            m, column = batch.column("m").to_numpy(), batch.column("bag")
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
            for i in range(0, batch.num_rows, step):
                end = min(i + step, batch.num_rows)
                scores = score([values[offsets[r]:offsets[r + 1]] for r in range(i, end)], m[i:end])
                row, item = np.nonzero((scores > 0) & (scores >= enough))
                if not len(row):
                    continue
                for r in np.unique(row).tolist():
                    least_of[int(names[i + r])] = ids[i + r]
                for name, more in (("item", item), ("score", scores[row, item]), ("class", names[i + row])):
                    kept[name] = np.concatenate([kept[name], more])
                if len(kept["item"]) > 4 * top * width + 4096:
                    cut()
        cut()
        if len(kept["item"]):
            out = [pa.array(kept["item"], pa.int64()).cast(pa.int32()), pa.array(kept["class"]), pa.array([least_of[c] for c in kept["class"].tolist()], kind), pa.array(kept["score"])]
            yield pa.RecordBatch.from_arrays(out, names=["item", "class", "least", "score"])
    from pyspark.sql.pandas.types import to_arrow_type
    kind = to_arrow_type(classes.schema["doc_id"].dataType)
    return classes.mapInArrow(run, f"item int, class long, least {classes.schema['doc_id'].dataType.simpleString()}, score long")
