"""Benchmark decontamination by winnowing. DataFrame functions only.

Both sides are reduced to fingerprints: of the hashes of all ``gram``-word spans, the least of every ``window -
gram + 1`` neighbours. Texts that share a span of ``window`` words share the least hash in it, so joining fingerprints
loses no such span. Documents that share one are candidates; their hits are then extended to whole windows, compared
by two independent 64-bit hashes. An item of fewer than ``window`` words is one window of its own length, compared with all
document spans of that length.

Fingerprints of a document are kept as one array in a table in the shared folder (about one in five words), so texts are
read once for them, and once more for candidates only. Joins are left to the optimizer: it sees the true sizes of the stored
tables, broadcasts a benchmark that is small, and splits skewed keys of one that is not. Spans with equal words are
one row on the benchmark's side, with the list of their items, so copied items multiply nothing.

Cases: a null text has no words and no hits; null item ids are left out; repeated rows get the same result each; items with equal
texts all count; an empty benchmark leaves every document clean; an empty table gives an empty one; other columns are
not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ebbmark.session import stored

#: Words of the contract: ASCII letters and digits, and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Settings:
    window: int = 13
    gram: int = 4


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def _shifted(array: Column, by: int) -> Column:
    return F.slice(array, by + 1, F.size(array))


def with_spans(df: DataFrame, lengths: Iterable[int], salt: int = 0) -> DataFrame:
    """Columns ``s<salt>_<n>``: the hash of each span of n words of the column ``words``. A span is hashed from two shorter
    ones, so each length costs one pass over numbers; a column per step keeps the plan from repeating it."""
    lengths = set(lengths)
    name = lambda n: f"s{salt}_{n}"
    out = df.withColumn(name(1), F.transform("words", lambda w: F.xxhash64(w, F.lit(salt))))
    made = {1}

    def make(n: int) -> None:
        nonlocal out
        if n in made:
            return
        left = 1 << ((n - 1).bit_length() - 1)
        make(left)
        make(n - left)
        a, b = F.col(name(left)), F.col(name(n - left))
        both = F.zip_with(a, _shifted(b, left), lambda x, y: F.xxhash64(x, y))
        out = out.withColumn(name(n), F.slice(both, 1, F.greatest(F.lit(0), F.size("words") - (n - 1))))
        made.add(n)

    for n in sorted(lengths):
        make(n)
    return out


def with_least(df: DataFrame, source: str, width: int, target: str) -> DataFrame:
    """``target``: the distinct least values of every ``width`` neighbours in the array ``source``."""
    out, have = df.withColumn(target, F.col(source)), 1
    while have < width:
        step = min(have, width - have)
        out = out.withColumn(target, F.zip_with(target, _shifted(F.col(target), step), lambda x, y: F.least(x, y)))
        have += step
    return out.withColumn(target, F.array_distinct(target))


def _windows(df: DataFrame, keys: list[str], lengths: list[int]) -> DataFrame:
    """``keys, n, at, h0, h1``: every span of each of the lengths, with two hashes."""
    spans = with_spans(with_spans(df, lengths), lengths, salt=1)
    each = [spans.select(*keys, F.lit(n).alias("n"), F.posexplode(F.arrays_zip(F.col(f"s0_{n}").alias("h0"), F.col(f"s1_{n}").alias("h1"))))
            .select(*keys, "n", F.col("pos").alias("at"), "col.h0", "col.h1") for n in lengths]
    out = each[0]
    for more in each[1:]:
        out = out.union(more)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """For each row of ``docs``: ``doc_id, text_hash, n_words, n_hit, items`` (sorted as text)."""
    full, gram = settings.window, settings.gram
    items = stored(benchmark.select(benchmark[item].alias("item"), words(benchmark[item_text]).alias("words"))
                   .where("item IS NOT NULL AND size(words) > 0"), "benchmark-words")
    lengths = [full] + sorted(r[0] for r in items.where(F.size("words") < full).select(F.size("words")).distinct().collect())
    spans = _windows(items.where(F.size("words") >= full), ["item"], [full])
    for n in lengths[1:]:
        spans = spans.union(_windows(items.where(F.size("words") == n), ["item"], [n]))
    windows = stored(spans.groupBy("n", "h0", "h1").agg(F.collect_set("item").alias("items")), "benchmark-windows")
    least = with_least(with_spans(items.where(F.size("words") >= full), [gram]), f"s0_{gram}", full - gram + 1, "prints")
    bench_prints = least.select(F.explode("prints").alias("print")).union(
        windows.where(F.col("n") < full).select(F.col("h0").alias("print"))).distinct()
    bench_prints = stored(bench_prints, "benchmark-prints")

    keyed = docs.select(docs[id].alias("doc_id"), F.xxhash64(docs[text].cast("string")).alias("text_hash"),
                        words(docs[text]).alias("words"))
    marked = with_least(with_spans(keyed, [gram, *lengths[1:]]), f"s0_{gram}", full - gram + 1, "prints")
    for n in lengths[1:]:
        marked = marked.withColumn("prints", F.concat("prints", f"s0_{n}"))
    prints = stored(marked.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), "prints"),
                    "document-prints")

    candidates = prints.select("doc_id", "text_hash", F.explode("prints").alias("print")) \
        .join(bench_prints, "print", "left_semi").select("doc_id", "text_hash").distinct()
    candidates = stored(candidates, "contamination-candidates")
    read = keyed.select("doc_id", "text_hash", "words").alias("d").join(
        candidates.alias("c"), F.expr("d.doc_id <=> c.doc_id AND d.text_hash = c.text_hash"), "left_semi")
    hits = _windows(read, ["doc_id", "text_hash"], lengths).join(windows, ["n", "h0", "h1"])
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("at", "n"))),
        F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).alias("end")),
        lambda a, x: F.struct(
            (a["words"] + F.greatest(F.lit(0), x["at"] + x["n"] - F.greatest(a["end"], x["at"]))).alias("words"),
            F.greatest(a["end"], x["at"] + x["n"]).alias("end")))
    found = hits.groupBy("doc_id", "text_hash").agg(
        covered["words"].alias("n_hit"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    return prints.alias("p").join(found.alias("f"), F.expr("p.doc_id <=> f.doc_id AND p.text_hash = f.text_hash"), "left") \
        .select("p.doc_id", "p.text_hash", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                F.array_sort(F.transform(F.coalesce("items", F.array()), lambda i: i.cast("string"))).alias("items"))


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least one hit, and hit words are a twentieth of all or more."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text",
                         settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that are not contaminated."""
    bad = contamination(docs, benchmark, id=id, text=text, settings=settings) \
        .where(contaminated(F.col("n_hit"), F.col("n_words"))).select("doc_id", "text_hash").distinct()
    rows = docs.select(F.struct("*").alias("row"), docs[id].alias("doc_id"), F.xxhash64(docs[text].cast("string")).alias("text_hash"))
    return rows.alias("r").join(stored(bad, "contaminated").alias("b"), F.expr("r.doc_id <=> b.doc_id AND r.text_hash = b.text_hash"), "left_anti").select("row.*")
