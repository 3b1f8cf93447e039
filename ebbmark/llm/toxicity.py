"""Toxicity by noisy-channel deobfuscation.

Written words are taken as a noisy form of plain ones: letters replaced by look-alikes, letters set apart, letters repeated.
A token that may be such a form spans a lattice of characters; Viterbi decoding under a character trigram model of the
whole corpus, mixed with that of the learned lexicon, finds the likeliest plain form. A text is then scored by the words of
its plain forms: distinct words, or stems of words, that are much more frequent in toxic texts, through a logistic function.

What is learned: the character model from all texts (one pass, map-side combination, at most ``Settings.trigrams`` entries
travel, the most frequent); the lexicon and the logistic function from a bounded sample of labelled texts, about ``Settings.per_class`` of each class, the one
from seven tenths of the sample and the other from the rest. A lexicon word must occur in a least share of the toxic texts, which
bounds the lexicon. Scoring is row by row in Arrow batches; whole texts are used.

Cases: a null or empty text has no words and gets the score of a text without lexicon words; without labels of both classes
every score is the share of label 1 (0 if there are none); a document with several labels counts with each; repeated rows are
scored one by one; tokens and spelled-out runs of any length are decoded, long ones in overlapping pieces; a text of any length is read whole; an empty table gives an empty one;
other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ebbmark.llm.common import map_texts, read_texts, slices_by_bytes
from ebbmark.session import stored

#: Look-alikes of letters.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
              "!": "il", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l", "¡": "i", "ß": "b"}
#: Marks that may stand between set-apart letters, or mask nothing.
MARKS = "*._-~'`^/\\"
#: Stripped from both ends of a token before it is looked at.
EDGES = ".,;:?\"'()[]{}<>|«»“”„…%&#*!-_"
#: A lattice of more runs of characters is decoded in pieces that overlap by half.
PIECE = 48
LETTERS = 0x250  # the character model covers Latin; others are one class
LETTER_RUN = re.compile(r"[^\W\d_]+")
TRIPLE = re.compile(r"(.)\1\1")


@dataclass(frozen=True)
class Settings:
    per_class: int = 10_000
    trigrams: int = 1 << 17
    least_share: float = 0.004
    least_texts: int = 3
    least_ratio: float = 12.0
    lexicon_weight: float = 0.2


@dataclass(frozen=True)
class Model:
    trigrams: dict[int, float]
    lexicon: dict[str, float]
    coefficients: tuple[float, ...] | None
    share: float


def _code(a: int, b: int, c: int) -> int:
    return (a << 20) | (b << 10) | c


def _letter(ch: str) -> int:
    o = ord(ch)
    return o if o < LETTERS and ch.isalpha() else (1 if ch.isalpha() else 0)


_CLASS = np.array([_letter(chr(i)) for i in range(LETTERS)], np.int64)


def letter_trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Packed trigrams of letters and their counts; 0 stands for anything that is not a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.int64)
    c = np.where(points < LETTERS, _CLASS[np.minimum(points, LETTERS - 1)], 1)
    c = np.concatenate([[0, 0], c, [0]])
    c = c[np.append(True, (c[1:] > 0) | (c[:-1] > 0))]  # one boundary between words
    code = (c[:-2] << 20) | (c[1:-1] << 10) | c[2:]
    return np.unique(code[(c[1:-1] > 0) | (c[2:] > 0)], return_counts=True)


def character_counts(df: DataFrame, settings: Settings) -> DataFrame:
    """``code, n`` of the trigrams of the column ``text``, without the rarest if there are very many."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for i, j in slices_by_bytes(texts, 1 << 20):
                code, n = letter_trigrams("\n".join(texts[i:j]))
                for k, m in zip(code.tolist(), n.tolist()):
                    total[k] += m
        yield pa.RecordBatch.from_pydict({"code": pa.array(list(total), pa.int64()), "n": pa.array(list(total.values()), pa.int64())})
    counts = stored(df.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "trigrams")
    return counts.orderBy(F.desc("n"), "code").limit(settings.trigrams)  # all, where there are no more


def language_model(counts: dict[int, int], lexicon: dict[str, float], weight: float) -> dict[int, float]:
    """log probabilities of known trigrams, the lexicon's words holding ``weight`` of all."""
    own: Counter = Counter()
    for w in lexicon:
        code, n = letter_trigrams(w.lstrip("^"))
        own.update(dict(zip(code.tolist(), n.tolist())))
    all_n, own_n = sum(counts.values()) or 1, sum(own.values()) or 1
    mixed: Counter = Counter()
    for k, n in counts.items():
        mixed[k] += (1 - weight) * n / all_n
    for k, n in own.items():
        mixed[k] += weight * n / own_n
    pairs: Counter = Counter()
    for k, p in mixed.items():
        pairs[k >> 10] += p
    return {k: math.log(p / pairs[k >> 10]) for k, p in mixed.items()}


UNKNOWN = math.log(1e-5)
SUBSTITUTE, COLLAPSE, DROP = math.log(0.3), math.log(0.5), math.log(0.3)


def runs_of(token: str) -> list[tuple[str, int]]:
    """Characters of a token with the lengths of their runs."""
    return [(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", token, re.S)]


def decode(token: str, trigrams: dict[int, float]) -> str:
    """The likeliest plain form: a path through the lattice of the token's characters. A state is the last two
    letters; runs of a character may shrink to two or one."""
    return decode_runs(runs_of(token), trigrams)


def decode_runs(runs: list[tuple[str, int]], trigrams: dict[int, float]) -> str:
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for ch, length in runs:
        options: list[tuple[str, float]] = []
        letters = ch if ch.isalpha() else ""
        alike = LOOKALIKES.get(ch, "")
        for plain, cost in [(x, 0.0) for x in letters] + [(x, SUBSTITUTE) for x in alike]:
            options.append((plain, cost + (COLLAPSE if length > 2 else 2 * COLLAPSE if length == 2 else 0.0)))
            if length > 1:
                options.append((plain * 2, cost + (COLLAPSE if length > 2 else 0.0)))
        if not letters:
            options.append(("", DROP if ch in MARKS or ch == " " else 3 * DROP))
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (p, said) in states.items():
            for plain, cost in options:
                x, y, q = a, b, p + cost
                for c in plain:
                    z = _letter(c)
                    q += trigrams.get(_code(x, y, z), UNKNOWN)
                    x, y = y, z
                best = after.get((x, y))
                if best is None or q > best[0]:
                    after[x, y] = (q, said + plain)
        states = after
    return max((p + trigrams.get(_code(a, b, 0), UNKNOWN), said) for (a, b), (p, said) in states.items())[1]


STEMS = (4, 5, 6, 7)
#: So many single characters in a row are taken for a word set apart.
SPACED = 3


def keys(word: str) -> list[str]:
    """What the lexicon may hold of a word: itself, and its stems, marked as such."""
    return [word, *("^" + word[:k] for k in STEMS if len(word) > k)]


class Reader:
    """Words of a text in written and plain form; with a lexicon, only words that have a key in it. Each distinct
    token is looked at once while it is kept."""

    MEMO = 300_000

    def __init__(self, trigrams: dict[int, float], lexicon: dict[str, float] | None = None):
        self.trigrams, self.lexicon = trigrams, lexicon
        self.memo: dict[str, tuple[str, ...]] = {}
        self.lengths = sorted({len(w) for w in lexicon or () if not w.startswith("^") and len(w) >= STEMS[0]})
        self.piece = max(PIECE, 2 * max(self.lengths, default=0))

    def inside(self, plain: str) -> Iterator[str]:
        """Words of the lexicon at any place of letters that were run together."""
        for n in self.lengths:
            for i in range(len(plain) - n + 1):
                if plain[i:i + n] in self.lexicon:
                    yield plain[i:i + n]

    def pieces(self, runs: list[tuple[str, int]]) -> Iterator[str]:
        """Plain forms of a lattice of any length; a word of the lexicon lies whole in one of the pieces."""
        half = self.piece // 2
        for start in range(0, max(1, len(runs) - half), half):
            yield decode_runs(runs[start:start + self.piece], self.trigrams)

    def weight(self, word: str) -> float:
        return max(self.lexicon.get(k, 0.0) for k in keys(word))

    def chosen(self, words: tuple[str, ...]) -> tuple[str, ...]:
        return words if self.lexicon is None else tuple(w for w in words if self.weight(w) > 0)

    def token(self, token: str) -> tuple[str, ...]:
        core = token.strip(EDGES)
        if core.isalpha() and not TRIPLE.search(core):
            return (core,)
        words = tuple(LETTER_RUN.findall(core))
        runs = runs_of(token.strip(".,;:?\"'[]{}<>«»“”„…%&#"))
        marks = sum(c in LOOKALIKES for c, _ in runs)
        letters = sum(c.isalpha() for c, _ in runs)
        if not letters or not (marks and marks <= letters + 2 or any(c in MARKS for c, _ in runs) or any(n > 2 for _, n in runs)):
            return words
        if len(runs) <= self.piece:
            plain = decode_runs(runs, self.trigrams)
            return words + (plain,) if len(plain) > 2 else words
        return words + tuple(w for plain in self.pieces(runs) for w in self.inside(plain))

    def words(self, text: str) -> set[str]:
        tokens = text.lower().split()
        memo = self.memo
        if len(memo) > self.MEMO:
            memo.clear()
        distinct = set(tokens)
        for t in distinct:
            if t not in memo:
                memo[t] = self.chosen(self.token(t))
        found = {w for t in distinct for w in memo[t]}
        if len(tokens) >= SPACED:
            single = np.fromiter(map(len, tokens), np.int64, len(tokens)) == 1
            if single.any():
                found.update(self.chosen(tuple(self.spaced(tokens, single))))
        return found

    def features(self, text: str) -> tuple[float, float, float]:
        """Greatest weight, sum of the four greatest, and how many words of the lexicon."""
        found = sorted(map(self.weight, self.words(text)), reverse=True)
        return (found[0] if found else 0.0, sum(found[:4]), math.log1p(len(found)))

    def spaced(self, tokens: list[str], single: np.ndarray) -> Iterator[str]:
        """Runs of single characters are read as one word, and words of the lexicon are looked for inside."""
        edges = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a < SPACED:
                continue
            runs = runs_of("".join(tokens[a:b]))
            for plain in self.pieces(runs):
                if len(runs) <= self.piece:
                    yield plain
                yield from self.inside(plain)


def _labelled(df: DataFrame, labels: DataFrame, id: str, text: str, label: str, settings: Settings) -> DataFrame:
    """About ``per_class`` labelled texts of each class as ``text, label, fold``. The drawn labels are bounded,
    so they are sent to the texts."""
    own = labels.select(labels[id].alias("label_id"), labels[label].cast("int").alias("label")).where("label IN (0, 1) AND label_id IS NOT NULL")
    sizes = {r[0]: r[1] for r in own.groupBy("label").count().collect()}
    rate = F.when(F.col("label") == 1, settings.per_class / max(1, sizes.get(1, 0))).otherwise(settings.per_class / max(1, sizes.get(0, 0)))
    draw = F.xxhash64("label_id", F.lit(11)).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    drawn = own.where(draw < rate).limit(4 * settings.per_class)
    texts = df.select(df[id].alias("label_id"), df[text].cast("string").alias("text"))
    return texts.join(F.broadcast(drawn), "label_id").select(
        "text", "label", (F.pmod(F.xxhash64("label_id", F.lit(12)), F.lit(10)) < 7).alias("lexical"))


def _lexicon(sample: DataFrame, settings: Settings, trigrams: dict[int, float]) -> dict[str, float]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, counts = Reader(trigrams), {}
        for batch in batches:
            for t, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                for w in {"", *(k for w in reader.words(t or "") for k in keys(w))}:  # the empty word counts texts
                    counts.setdefault(w, [0, 0])[y] += 1
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()),
                                          **{f"n{y}": pa.array([c[y] for c in counts.values()], pa.int64()) for y in (0, 1)}})
    counts = stored(sample.where("lexical").select("text", "label").mapInArrow(run, "word string, n0 long, n1 long")
                    .groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "toxic-words")
    n0, n1 = next(((r.n0, r.n1) for r in counts.where("word = ''").collect()), (0, 0))
    if not n0 or not n1:
        return {}
    least = max(settings.least_texts, math.ceil(settings.least_share * n1))
    ratio = ((F.col("n1") + 0.5) / (n1 + 1)) / ((F.col("n0") + 0.5) / (n0 + 1))
    kept = counts.where((F.col("word") != "") & (F.col("n1") >= least) & (ratio >= settings.least_ratio)).collect()
    return {r.word: math.log(((r.n1 + 0.5) / (n1 + 1)) / ((r.n0 + 0.5) / (n0 + 1))) for r in kept}


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge-regularised logistic regression by Newton's method; the offset first."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 0.1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def fit(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic",
        settings: Settings = Settings(), corpus: DataFrame | None = None) -> Model:
    """From the labelled rows of ``df``; characters are counted over ``corpus`` (default: ``df``)."""
    whole = df if corpus is None else corpus
    rows = character_counts(whole.select(whole[text].cast("string").alias("text")), settings).collect()
    counts = {r.code: r.n for r in rows}
    sample = stored(_labelled(df, labels, id, text, label, settings), "toxicity-sample")
    lexicon = _lexicon(sample, settings, language_model(counts, {}, 0.0))
    trigrams = language_model(counts, lexicon, settings.lexicon_weight if lexicon else 0.0)

    def work() -> Callable:
        reader = Reader(trigrams, lexicon)

        def compute(texts):
            found = [reader.features(t) for t in texts]
            return {n: [f[i] for f in found] for i, n in enumerate(("x0", "x1", "x2"))}
        return compute
    seen = map_texts(sample.select("label", "text", "lexical").where("NOT lexical").drop("lexical"), work, "x0 double, x1 double, x2 double").toArrow()
    y = seen.column("label").to_numpy().astype(np.float64)
    if len(y) == 0 or y.min() == y.max():
        return Model(trigrams, lexicon, None, float(y.mean()) if len(y) else 0.0)
    x = np.column_stack([seen.column(n).to_numpy() for n in ("x0", "x1", "x2")])
    return Model(trigrams, lexicon, _logistic(x, y), float(y.mean()))


def score(df: DataFrame, model: Model, text: str = "text", **keep: Column) -> DataFrame:
    """``keep`` columns with ``score`` and ``predicted`` for each row."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # bounded by Settings

    def work() -> Callable:
        m = sent.value
        reader = Reader(m.trigrams, m.lexicon)

        def one(t: str) -> float:
            if m.coefficients is None:
                return m.share
            z = m.coefficients[0] + sum(a * b for a, b in zip(m.coefficients[1:], reader.features(t)))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        def compute(texts):
            scores = [one(t) for t in texts]
            return {"score": scores, "predicted": [int(s >= 0.5) for s in scores]}
        return compute
    return map_texts(read_texts(df, text, **keep), work, "score double, predicted int")


def without_toxic(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``df`` that the model does not take for toxic."""
    kept = {f"_{i}": df[c] for i, c in enumerate(df.columns)}
    return score(df, model, text, **kept).where("predicted = 0").select(
        *[F.col(n).alias(c) for n, c in zip(kept, df.columns)])
