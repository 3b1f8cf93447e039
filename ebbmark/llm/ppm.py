"""Language-model scores by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts up to ``order`` bytes, counted over the training texts. A byte's probability is its
share in the longest known context; a byte not seen there escapes to the next shorter one (each distinct byte seen gives half a
count to the escape), where the bytes already refused are excluded from the counts; below the empty context all remaining
symbols are equally likely. The model is pretrained: it does not adapt to the text being scored.

The model's text is the word sequence of the contract: A-Z lower-cased, words joined by one space, and an end symbol. The
score is the sum of log10 probabilities of its bytes and the end.

The trie is whole: every span of the training texts counts, however rare. It lies cut by the ``SPLIT`` symbols before the
predicted one: all longer contexts of a symbol share them, so each part with the (few) shorter spans of all texts gives
exact probabilities. The at most ``nodes`` most frequent spans, with their log probabilities, travel to the workers as a
shortcut; all other positions of a text, seen in training or not, go to the part of the trie that knows their context, and the
sums come back by row. ``nodes`` decides how many positions travel, not the result.

The base score needs the exact training count of every word. At most ``frequent`` words hold at least one in ``frequent`` of all
tokens: those travel to the workers (longer than 64 bytes, their SHA-256); all others are looked up in the part of the words that their checksum
names, in which no word is frequent enough to be a hot key.

Between tasks, spans, words and sums travel as packed arrays in binary columns, one row for many, so that rows stay few.

Cases: a null or empty text is the end token alone; with no training row counts are zero and bytes are equally likely; repeated
rows are scored one by one; a null id counts as empty text for the split; an empty table gives an empty one; other columns are
not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ebbmark.llm.common import _arrow_schema, _as, slices_by_bytes
from ebbmark.session import stored

BITS = 9  # of a symbol: 0 before the text, 1 + byte, END
END = 257
SYMBOLS = 257
COUNTED, WINDOW = 1 << 20, 1 << 18  # positions taken at a time when counting and when scoring
SPLIT = 2  # symbols of context by which the trie is cut; shorter spans are at most 2^18
PART = 1 << 27  # training positions for one group of parts, beyond the first ``GROUPS`` groups
GROUPS = 61
SLOTS = 4093  # by which counts of spans and words are dealt out and merged; a group of parts is several
SPREAD = 16  # slots into which the spans of one context are dealt further, as some contexts are frequent; slots have 16 bits
LONG_ROW, WAITING = 50_000, 1 << 21  # spans in a row; spans of texts that wait in a task
WORDS_WAITING, WORD_BYTES_WAITING = 1 << 18, 1 << 24  # words of texts that wait in a task
HOME = 512  # rows of texts whose sums come together
MODEL, TAIL, DOC = 0, 1, 2  # kinds of rows
LONGEST_FREQUENT = 64  # bytes of a word that travels as it is


@dataclass(frozen=True)
class Settings:
    order: int = 6
    nodes: int = 1 << 20
    frequent: int = 1 << 17


def raw_texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


# Bytes that UTF-8 never uses mark the end of a text and the places before one.
_SYMBOL = np.arange(1, 257, dtype=np.uint64)
_SYMBOL[0xFF] = END
_SYMBOL[0xFE] = 0


def joined(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts as one byte array, each followed by its end and ``order`` places, and where each text starts."""
    after = b"\xff" + b"\xfe" * order
    flat = np.frombuffer(b"\xfe" * order + b"".join(x for t in texts for x in (t, after)), np.uint8)
    lengths = np.array([len(t) + len(after) for t in texts], np.int64)
    return flat, order + np.cumsum(lengths) - lengths


def codes(flat: np.ndarray, order: int, start: int, end: int) -> np.ndarray:
    """Symbol and ``order`` symbols before it, packed, for the positions from ``start`` to ``end``; 0 at places."""
    s = _SYMBOL[flat[start - order:end]]
    n = end - start
    code = s[order:].copy()
    for k in range(1, order + 1):
        code |= s[order - k:order - k + n] << np.uint64(BITS * k)
    code[s[order:] == 0] = 0
    return code


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    c = np.concatenate([p[0] for p in parts])
    n = np.concatenate([p[1] for p in parts])
    order = np.argsort(c, kind="stable")
    c, n = c[order], n[order]
    first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
    return c[first], np.add.reduceat(n, first)


def context_slot(code: np.ndarray, order: int) -> np.ndarray:
    """The symbols before the last one by which the trie is cut, dealt to ``SLOTS`` numbers."""
    return ((code >> np.uint64(BITS)) & np.uint64((1 << BITS * min(SPLIT, order)) - 1)) % np.uint64(SLOTS)


def span_slot(code: np.ndarray, order: int) -> np.ndarray:
    mixed = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    return (context_slot(code, order) * np.uint64(SPREAD) + mixed % np.uint64(SPREAD)).astype(np.uint16)  # 16 bits sort fast


def word_slot(words: list[bytes], most: int) -> np.ndarray:
    return (np.fromiter(map(crc32, words), np.int64, len(words)) % SLOTS % most).astype(np.uint16)


def packed(key: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Rows of a key and the bytes of arrays of bounded length, from columns in the order of ``key``."""
    change = np.flatnonzero(key[1:] != key[:-1]) + 1
    first = np.union1d(change, np.arange(0, len(key), LONG_ROW)).tolist()
    for i, j in zip(first, [*first[1:], len(key)]):
        yield (int(key[i]), *[c[i:j].tobytes() for c in columns])


def packed_words(key: np.ndarray, words: list[bytes], column: np.ndarray) -> Iterator[tuple]:
    """The same for words, which hold no space: negative keys, and the words joined by spaces."""
    by = np.argsort(key, kind="stable")
    key, column = key[by], column[by]
    words = [words[i] for i in by.tolist()]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist() if len(key) else []
    for i, j in zip(first, [*first[1:], len(key)]):
        yield -1 - int(key[i]), b" ".join(words[i:j]), column[i:j].tobytes()


def _batches(rows: Iterator[tuple], names: list[str], schema: pa.Schema, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about ``most`` bytes; columns without a name in ``names`` are null."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        columns = dict(zip(names, zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(held), f.type)
                                           for f in schema], schema=schema)

    for row in rows:
        held.append(row)
        size += 100 + sum(len(x) for x in row if isinstance(x, bytes))
        if size > most:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _array(of_bytes: pa.BinaryScalar, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(of_bytes.as_buffer(), kind)


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1]))


COUNTS = "slot int, codes binary, n binary, size long, total long"


def count(df: DataFrame, settings: Settings) -> DataFrame:
    """``COUNTS`` for the column ``text``: packed spans (``slot`` from 0) and words (below 0, joined by spaces; the end is the
    empty word) with their counts, how many and their sum. Each has one count. Each task sums what it sees and passes it on in parts
    of bounded size; all that a slot got comes together."""
    order = settings.order
    schema = T._parse_datatype_string(COUNTS)
    fields, names = _arrow_schema(schema), ["slot", "codes", "n"]

    def spans_out(c: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = span_slot(c, order)
        by = np.argsort(at, kind="stable")
        yield from _batches(packed(at[by], c[by], n[by].astype(np.int64)), names, fields)

    def words_out(words: Counter) -> Iterator[pa.RecordBatch]:
        w, n = list(words), np.fromiter(words.values(), np.int64, len(words))
        yield from _batches(packed_words(word_slot(w, SLOTS), w, n), names, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        parts, waiting = [], 0
        for batch in batches:
            texts = raw_texts(batch)
            words[b""] += len(texts)
            for i, j in slices_by_bytes(texts, COUNTED):  # the words of one slice at a time
                split = [tokens(t) for t in texts[i:j]]
                words.update(chain.from_iterable(split))
                flat, _ = joined([b" ".join(w) for w in split], order)
                for start in range(order, len(flat), COUNTED):
                    c, n = np.unique(codes(flat, order, start, min(len(flat), start + COUNTED)), return_counts=True)
                    parts.append((c[c > 0], n[c > 0]))
                    waiting += len(c)
            if waiting > 3_000_000:
                parts = [_merge(parts)]
                if (waiting := len(parts[0][0])) > 1_500_000:
                    yield from spans_out(*parts[0])
                    parts, waiting = [], 0
            if len(words) > 400_000:
                yield from words_out(words)
                words = Counter()
        if words:
            yield from words_out(words)
        if parts:
            yield from spans_out(*_merge(parts))

    def merged(at: int, parts: list[tuple[pa.BinaryScalar, pa.BinaryScalar]]) -> Iterator[tuple]:
        if at >= 0:
            c, n = _merge([(_array(c, np.uint64), _array(n)) for c, n in parts])
            for i in range(0, len(c), LONG_ROW):
                m = n[i:i + LONG_ROW]
                yield at, c[i:i + LONG_ROW].tobytes(), m.tobytes(), len(m), int(m.sum())
        else:
            words: Counter = Counter()
            for w, n in parts:
                for word, times in zip(w.as_py().split(b" "), _array(n).tolist()):
                    words[word] += times
            n = np.fromiter(words.values(), np.int64, len(words))
            yield at, b" ".join(words), n.tobytes(), len(n), int(n.sum())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((row for at, parts in by_key(batches, "slot", "codes", "n") for row in merged(at, parts)), fields.names, fields)

    return df.select("text").mapInArrow(run, schema).repartition("slot").sortWithinPartitions("slot").mapInArrow(merge, schema)


def by_key(batches: Iterator[pa.RecordBatch], key: str, *columns: str) -> Iterator[tuple[int, list[tuple]]]:
    """Each key of rows sorted by it, with the columns of its rows."""
    now, held = None, []
    for batch in batches:
        for at, *row in zip(batch.column(key).to_pylist(), *(batch.column(c) for c in columns)):
            if at != now and held:
                yield now, held
                held = []
            now = at
            held.append(tuple(row))
    if held:
        yield now, held


@dataclass(frozen=True)
class Trie:
    """``nodes[k]``: packed spans of k + 1 symbols, ascending, and their counts; ``contexts[k]``: spans of k symbols and
    how often any symbol followed."""

    order: int
    nodes: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]


def part_of_trie(code: np.ndarray, n: np.ndarray, short: list[tuple[np.ndarray, np.ndarray]], order: int) -> Trie:
    """The trie from the longest spans of some contexts, and the spans of up to ``SPLIT`` symbols of all texts."""
    nodes = short + [_merge([(code & np.uint64((1 << BITS * (k + 1)) - 1), n)]) if len(code) else (code, n)
                     for k in range(len(short), order + 1)]
    contexts = [_merge([(c >> np.uint64(BITS), m)]) if len(c) else (c, m) for c, m in nodes]
    return Trie(order, nodes, contexts)


def survey(spans: DataFrame, settings: Settings) -> tuple[list[tuple[np.ndarray, np.ndarray]], int, int]:
    """From ``codes, n``: the counts of all spans of up to ``SPLIT`` symbols, the number of positions, and the least count
    for which at most ``nodes`` spans are as frequent."""
    order = settings.order
    levels = min(SPLIT, order)
    mask = np.uint64((1 << BITS * max(1, levels)) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, short = Counter(), Counter()
        for batch in batches:
            if not len(batch):
                continue
            c, n = (np.concatenate([_array(x) for x in batch.column(name)]) for name in ("codes", "n"))
            size.update(dict(zip(*map(np.ndarray.tolist, np.unique(np.floor(16 * np.log2(n)).astype(np.int64), return_counts=True)))))
            if len(c):
                short.update(dict(zip(*map(np.ndarray.tolist, _merge([(c.astype(np.uint64) & mask, n)])))))
        for of_spans, found in ((False, size), (True, short)):
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([of_spans] * len(found)), pa.array(list(found), pa.int64()),
                                                  pa.array(list(found.values()), pa.int64())], ["short", "code", "n"])

    found = spans.select("codes", "n").mapInArrow(run, "short boolean, code long, n long") \
        .groupBy("short", "code").agg(F.sum("n").alias("n")).toArrow()  # at most 2^18 spans and 1,024 steps of counts
    is_short, code, n = (found.column(x).to_numpy() for x in ("short", "code", "n"))
    longest = _merge([(code[is_short].astype(np.uint64), n[is_short])]) if is_short.any() else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    short = [_merge([(longest[0] & np.uint64((1 << BITS * (k + 1)) - 1), longest[1])]) if len(longest[0]) else longest for k in range(levels)]
    steps = sorted(zip(code[~is_short].tolist(), n[~is_short].tolist()), reverse=True)
    least, kept = 1 << 62, 0
    for step, more in steps:
        if (kept := kept + more) > settings.nodes:
            break
        least = math.ceil(2 ** (step / 16))
    return short, int(longest[1].sum()), least


def most_frequent(spans: DataFrame, short: Broadcast, least: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The spans of ``group, codes, n`` that occur ``least`` times and the log probabilities of their last symbols."""
    def solve(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        c, n = _merge(parts)
        if (n >= least).any():
            log = Scorer(part_of_trie(c, n, short.value, order)).log_p(c[n >= least])
            yield pa.RecordBatch.from_arrays([pa.array(c[n >= least].astype(np.int64)), pa.array(log)], ["code", "log"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in by_key(batches, "group", "codes", "n"):
            yield from solve([(_array(c, np.uint64), _array(n)) for c, n in parts])

    found = spans.repartition("group").sortWithinPartitions("group").mapInArrow(run, "code long, log double").toArrow()
    return found.column("code").to_numpy().astype(np.uint64), found.column("log").to_numpy()


def short_name(word: bytes) -> bytes:
    return word if len(word) <= LONGEST_FREQUENT else sha256(word).digest()


def frequent_words(words: DataFrame, all_tokens: int, settings: Settings) -> dict[bytes, float]:
    """From ``codes, n`` of words: log10 of count plus one half of those that hold one in ``frequent`` tokens, at most ``frequent``,
    by their short names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, n in zip(batch.column("codes"), batch.column("n")):
                n = _array(n)
                if len(often := np.flatnonzero(n * settings.frequent >= all_tokens)):
                    w = w.as_py().split(b" ")
                    yield pa.RecordBatch.from_arrays([pa.array([short_name(w[i]) for i in often.tolist()], pa.binary()), pa.array(n[often])],
                                                     ["word", "c"])

    found = words.select("codes", "n").mapInArrow(run, "word binary, c long").toArrow()
    return {w: math.log10(c + 0.5) for w, c in zip(*[found.column(x).to_pylist() for x in ("word", "c")])}


def _log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log10(x)


class Table:
    """Open addressing over packed spans: looks up whole arrays at a time."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.at = np.full(1 << self.bits, -1, np.int32)
        slot, left, step = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            s = (slot[left] + step) & ((1 << self.bits) - 1)
            free = self.keys[s] == 0
            self.keys[s[free]] = keys[left[free]]
            won = self.keys[s] == keys[left]
            self.at[s[won]] = left[won]
            left, step = left[~won], step + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        slot = self._slot(keys)
        k = self.keys[slot]
        out = np.where(k == keys, self.at[slot], -1)
        left, step = np.flatnonzero((k != keys) & (k != 0)), 1
        while len(left):
            s = (slot[left] + step) & ((1 << self.bits) - 1)
            k = self.keys[s]
            hit = k == keys[left]
            out[left[hit]] = self.at[s[hit]]
            left, step = left[~hit & (k != 0)], step + 1
        return out


class Scorer:
    """Scores arrays of packed spans, level by level from the longest context.

    A symbol kept after a context is kept after all its shorter forms, which are at least as frequent. So the symbols to be
    excluded at a level are those of the next longer context, and what is left of a level's counts is a number per longer
    context, computed once.
    """

    def __init__(self, model: Trie, discount: float = 0.5):
        self.order, self.children, self.known, self.log_hit, self.context = model.order, [], [], [], []
        self.log_whole, self.log_escape = [], []  # with nothing excluded, by context of the level
        self.log_whole_after, self.log_escape_after = [], []  # with the symbols of a longer context excluded, by that context
        shorter = None
        for k, (spans, n) in enumerate(model.nodes):
            context = spans >> np.uint64(BITS)
            first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(spans) else np.zeros(0, np.int64)
            distinct = np.diff(np.append(first, len(spans)))
            kept = np.add.reduceat(n, first) if len(first) else np.zeros(0, np.int64)
            names, sums = model.contexts[k]
            total = np.maximum(sums[np.searchsorted(names, context[first])], kept) if len(first) else kept
            self.children.append(Table(spans))
            self.known.append(Table(context[first] + np.uint64(1)))  # keys of a table are not 0
            self.log_hit.append(np.log10(n - discount))
            self.context.append(np.repeat(np.arange(len(first)), distinct))
            self.log_whole.append(_log(total.astype(np.float64)))
            self.log_escape.append(_log((discount * distinct + total - kept) / np.maximum(total, 1)))
            if shorter is not None:
                n1, total1, kept1, distinct1, found = shorter
                at = found.find(spans & np.uint64((1 << BITS * k) - 1))
                gone = np.add.reduceat(n1[at], first) if len(first) else kept
                suffix = context[first] & np.uint64((1 << BITS * (k - 1)) - 1)
                up = self.known[k - 1].find(suffix + np.uint64(1))
                left = (total1[up] - gone).astype(np.float64)
                escape = discount * (distinct1[up] - distinct) + total1[up] - kept1[up]
                self.log_whole_after.append(_log(left))
                self.log_escape_after.append(np.where(left > 0, _log(escape / np.maximum(left, 1e-9)), 0.0))
            shorter = (n, total, kept, distinct, self.children[k])
        symbols = len(model.nodes[0][0])
        self.log_any, self.log_other = -math.log10(SYMBOLS), -math.log10(max(1, SYMBOLS - symbols))

    def log_p(self, code: np.ndarray) -> np.ndarray:
        out = np.zeros(len(code))
        left = np.flatnonzero(code)
        code = code[left]
        longer = np.full(len(left), -1)
        for k in range(self.order, -1, -1):
            if not len(left):
                return out
            child = self.children[k].find(code & np.uint64((1 << BITS * (k + 1)) - 1))
            hit = np.flatnonzero(child >= 0)
            found, after = child[hit], longer[hit]
            whole = self.log_whole[k][self.context[k][found]]
            old = np.flatnonzero(after >= 0)
            if len(old):
                whole[old] = self.log_whole_after[k][after[old]]
            out[left[hit]] += self.log_hit[k][found] - whole
            miss = np.flatnonzero(child < 0)
            left, code, longer = left[miss], code[miss], longer[miss]
            here = self.known[k].find(((code >> np.uint64(BITS)) & np.uint64((1 << BITS * k) - 1)) + np.uint64(1))
            escape = np.where(here >= 0, np.append(self.log_escape[k], 0.0)[here], 0.0)
            old = np.flatnonzero(longer >= 0)
            if len(old):
                escape[old] = self.log_escape_after[k][longer[old]]
            out[left] += escape
            longer = here
        out[left] += np.where(longer >= 0, self.log_other, self.log_any)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        total = np.zeros(len(texts))
        for code, i, starts, start in windows(texts, self.order):
            add_up(total[i:], self.log_p(code), starts, start)
        return total


def windows(texts: list[bytes], order: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, int]]:
    """Packed spans, the number of the first text, where the texts begin, and where the spans do."""
    for i, j in slices_by_bytes(texts, WINDOW):
        flat, starts = joined(texts[i:j], order)
        for start in range(order, len(flat), WINDOW):
            yield codes(flat, order, start, min(len(flat), start + WINDOW)), i, starts, start


def add_up(total: np.ndarray, values: np.ndarray, starts: np.ndarray, start: int) -> None:
    """Add the values of the positions from ``start`` on to the texts that begin at ``starts``."""
    end = start + len(values)
    run = np.concatenate([[0.0], np.cumsum(values)])
    ends = np.append(starts[1:], end)
    total[:len(starts)] += run[np.clip(ends, start, end) - start] - run[np.clip(starts, start, end) - start]


def score(df: DataFrame, train: Column, id: str = "doc_id", text: str = "text", settings: Settings = Settings(),
          **keep: Column) -> DataFrame:
    """``keep`` columns, ``n_tokens, n_known, train_tokens, base_score, score`` for each row; learns from
    rows where ``train`` is true."""
    spark, order = df.sparkSession, settings.order
    plain = df.select(*[c.alias(f"k{i}") for i, c in enumerate(keep.values())], df[text].cast("string").alias("text"), train.alias("train"))
    counts = stored(count(plain.where("train"), settings), "ppm-counts", free_shuffles=True)
    spans, words = counts.where("slot >= 0"), counts.where("slot < 0")
    n, v = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    short, positions, least = survey(spans, settings)
    groups = min(max(GROUPS, positions // PART | 1), SLOTS)
    short = spark.sparkContext.broadcast(short)
    group = F.when(F.col("slot") >= 0, F.floor(F.col("slot") / SPREAD) % groups).otherwise(-1 - (-1 - F.col("slot")) % groups).cast("int")
    sent = spark.sparkContext.broadcast((*most_frequent(spans.select(group.alias("group"), "codes", "n"), short, least, order),
                                         frequent_words(words, n, settings)))

    rows = plain.select(F.struct(F.monotonically_increasing_id().alias("row"), *[f"k{i}" for i in range(len(keep))]).alias("doc"), "text")
    doc = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema["doc"].dataType])
    per_doc = [T.StructField("doc", doc), *T._parse_datatype_string("n_tokens long, score double, known long, logs double")]
    asked = T.StructType([*T._parse_datatype_string("group int, kind int, codes binary, n binary"), *per_doc])
    solved = T.StructType([*T._parse_datatype_string("home long, kind int, rows binary, sums binary, more binary"), *per_doc])

    def docs_out(batch: pa.RecordBatch, fields: pa.Schema, **columns: np.ndarray) -> pa.RecordBatch:
        columns = {f.name: batch.column(f.name) for f in fields if f.name in batch.schema.names} | {x: pa.array(c) for x, c in columns.items()}
        return pa.RecordBatch.from_arrays([_as(columns[f.name], f.type) if f.name in columns else pa.nulls(len(batch), f.type) for f in fields],
                                          schema=fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of texts, scored as far as the workers know; the other spans and words with the rows they are in."""
        head, head_logs, logs_of = sent.value
        head, head_logs, get_log = Table(head), np.append(head_logs, 0.0), logs_of.get
        fields, names = _arrow_schema(asked), ["group", "kind", "codes", "n"]
        tails, waiting, rare, rare_rows, rare_bytes = [], 0, [], [], 0

        def tails_out() -> Iterator[pa.RecordBatch]:
            c, row = (np.concatenate(x) for x in zip(*tails))
            at = (context_slot(c, order) % np.uint64(groups)).astype(np.uint16)
            by = np.argsort(at, kind="stable")
            yield from _batches(((of, TAIL, *x) for of, *x in packed(at[by], c[by], row[by])), names, fields)

        def rare_out() -> Iterator[pa.RecordBatch]:
            found = packed_words(word_slot(rare, groups), rare, np.concatenate(rare_rows))
            yield from _batches(((of, TAIL, *x) for of, *x in found), names, fields)

        for batch in batches:
            texts = raw_texts(batch)
            row = batch.column("doc").field("row").to_numpy()
            size, found, known, logs = (np.zeros(len(texts), t) for t in (np.int64, np.float64, np.int64, np.float64))
            for i, j in slices_by_bytes(texts, WINDOW):  # the words of one slice at a time
                split = [tokens(t) for t in texts[i:j]]
                for code, first, starts, start in windows([b" ".join(w) for w in split], order):
                    at = head.find(code)
                    add_up(found[i + first:], head_logs[at], starts, start)
                    tail = np.flatnonzero((at < 0) & (code > 0))
                    bounds = np.append(np.searchsorted(tail, starts - start), len(tail))
                    tails.append((code[tail], np.repeat(row[i + first:i + first + len(starts)], np.diff(bounds))))
                    waiting += len(tail)
                    if waiting > WAITING:
                        yield from tails_out()
                        tails, waiting = [], 0
                for w in split:
                    w.append(b"")  # the end
                flat = list(chain.from_iterable(split))
                of = np.repeat(np.arange(i, j), [len(w) for w in split])
                log = np.fromiter(map(get_log, flat, repeat(np.nan)), np.float64, len(flat))
                if long := [k for k in np.flatnonzero(np.isnan(log)).tolist() if len(flat[k]) > LONGEST_FREQUENT]:
                    log[long] = [get_log(short_name(flat[k]), np.nan) for k in long]
                unknown = np.isnan(log)
                size += np.bincount(of, minlength=len(texts))
                known += np.bincount(of[~unknown], minlength=len(texts))
                logs += np.bincount(of[~unknown], log[~unknown], minlength=len(texts))
                if unknown.any():
                    new = [flat[k] for k in np.flatnonzero(unknown).tolist()]
                    rare += new
                    rare_rows.append(row[of[unknown]])
                    rare_bytes += sum(map(len, new))
                    if len(rare) > WORDS_WAITING or rare_bytes > WORD_BYTES_WAITING:
                        yield from rare_out()
                        rare, rare_rows, rare_bytes = [], [], 0
            yield docs_out(batch, fields, group=(row % groups).astype(np.int32), kind=np.full(len(row), DOC, np.int32), n_tokens=size, score=found,
                           known=known, logs=logs)
        if waiting:
            yield from tails_out()
        if rare:
            yield from rare_out()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by group and kind: a part of the trie or of the words, what is to be looked up there, and texts, which pass."""
        fields, names = _arrow_schema(solved), ["home", "kind", "rows", "sums", "more"]
        group, known, parts = None, None, []

        def looked_up(codes: pa.BinaryScalar, row: np.ndarray) -> Iterator[tuple]:
            first = _runs(row)  # what is looked up lies in the order of rows
            if group >= 0:
                sums, more = np.add.reduceat(known.log_p(_array(codes, np.uint64)), first), None
            else:
                words = codes.as_py().split(b" ")
                c = np.fromiter(map(known.get, words, repeat(0)), np.int64, len(words))
                sums, more = np.add.reduceat(np.log10(c + 0.5), first), np.add.reduceat((c > 0).astype(np.int64), first)
            row = row[first]
            home = row // HOME
            starts = _runs(home).tolist()
            for i, j in zip(starts, [*starts[1:], len(row)]):
                yield int(home[i]), TAIL, row[i:j].tobytes(), sums[i:j].tobytes(), None if more is None else more[i:j].tobytes()

        def pieces(batch: pa.RecordBatch, which: np.ndarray) -> Iterator[tuple]:
            nonlocal group, known, parts
            of, kind, codes, n = (batch.column(x) for x in ("group", "kind", "codes", "n"))
            of, kind = of.to_numpy(), kind.to_numpy()
            for i in which.tolist():
                if of[i] != group:
                    group, known, parts = of[i], None, []
                if kind[i] == MODEL:
                    parts.append((codes[i], n[i]))
                    continue
                if known is None and group >= 0:
                    model = _merge([(_array(c, np.uint64), _array(m)) for c, m in parts]) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                    known, parts = Scorer(part_of_trie(*model, short.value, order)), []
                elif known is None:
                    known, parts = dict(x for w, m in parts for x in zip(w.as_py().split(b" "), _array(m).tolist())), []
                yield from looked_up(codes[i], _array(n[i]))

        for batch in batches:
            of_doc = batch.column("kind").to_numpy() == DOC
            if of_doc.any():
                passing = batch.filter(pa.array(of_doc))
                home = passing.column("doc").field("row").to_numpy() // HOME
                yield docs_out(passing, fields, home=home)
            yield from _batches(pieces(batch, np.flatnonzero(~of_doc)), names, fields)

    scored = T.StructType(per_doc)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by home: texts and sums that belong to them."""
        fields = _arrow_schema(scored)
        home, docs, sums, more, logs = None, [], None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            for doc in docs:
                at = doc.column("doc").field("row").to_numpy() % HOME
                now = {x: doc.column(x).to_numpy() for x in ("score", "known", "logs")}
                yield docs_out(doc, fields, score=now["score"] + sums[at], known=now["known"] + more[at], logs=now["logs"] + logs[at])

        for batch in batches:
            of, kind = batch.column("home").to_numpy(), batch.column("kind").to_numpy()
            starts = _runs(of).tolist() if len(of) else []
            for i, j in zip(starts, [*starts[1:], len(of)]):
                if of[i] != home:
                    yield from done()
                    home, docs, sums, more, logs = of[i], [], np.zeros(HOME), np.zeros(HOME, np.int64), np.zeros(HOME)
                if len(here := batch.slice(i, j - i).filter(pa.array(kind[i:j] == DOC))):
                    docs.append(here)
                row, add_sums, add_more = (batch.column(x) for x in ("rows", "sums", "more"))
                for k in (i + np.flatnonzero(kind[i:j] != DOC)).tolist():
                    at = _array(row[k]) % HOME  # each row once
                    if add_more[k].is_valid:
                        more[at] += _array(add_more[k])
                        logs[at] += _array(add_sums[k], np.float64)
                    else:
                        sums[at] += _array(add_sums[k], np.float64)
        yield from done()

    model = counts.select(group.alias("group"), F.lit(MODEL).alias("kind"), "codes", "n")
    looked_up = model.unionByName(rows.mapInArrow(read, asked), allowMissingColumns=True) \
        .repartition("group").sortWithinPartitions("group", "kind").mapInArrow(solve, solved)
    docs = stored(looked_up.repartition("home").sortWithinPartitions("home").mapInArrow(add, scored), "ppm-scores", free_shuffles=True)
    each = math.log10(n + 0.5 * (v + 1))
    return docs.select(
        *[F.col(f"doc.k{i}").alias(name) for i, name in enumerate(keep)],
        "n_tokens", F.col("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * each).alias("base_score"), "score")
