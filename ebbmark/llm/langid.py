"""Language identification by hierarchical discrimination.

A text is first assigned to a language family, then to one of the family's languages. Both levels are votes of
linear support vector machines that each separate two classes (two families, or two languages of one family);
margins break ties. Features are hashed byte n-grams of the lower-cased text: square roots of their counts, scaled to
unit length. The whole text is counted, in windows of bounded memory.

The machines are fitted on the driver from a bounded sample: about ``Settings.per_language`` labelled texts of each
language. Feature vectors are counted on the executors and only they travel, at most ``Settings.dimensions`` numbers a
text.

Families of well-known languages are a fixed table; a language outside it forms a family of its own.

Cases: a text that is null or has no letter is ``und`` with score 0; with no training row at all every text is ``und``; with one
learned language every other text has that language; ties between classes go to the alphabetically first; repeated
rows are judged one by one; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ebbmark.llm.common import map_texts, read_texts

#: Families of languages by their codes.
FAMILIES = {
    "romance": "ca es fr gl it oc pt ro",
    "germanic": "af da de en fy is lb nl no nb nn sv yi",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "am ar he mt",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


#: More distinct labels than this are an error rather than languages.
MOST_LANGUAGES = 5000


@dataclass(frozen=True)
class Settings:
    per_language: int = 1000
    bits: int = 15
    orders: tuple[int, ...] = (2, 3, 4)
    penalty: float = 1e-5
    epochs: int = 12
    seed: int = 7

    @property
    def dimensions(self) -> int:
        return 1 << self.bits


@dataclass(frozen=True)
class Model:
    """``weights[k]`` with offset ``offsets[k]`` is the machine ``pairs[k]``: level, first class (positive margin), second."""

    settings: Settings
    languages: tuple[str, ...]
    pairs: tuple[tuple[str, str, str], ...]
    weights: np.ndarray
    offsets: np.ndarray


def family(language: str) -> str:
    return FAMILY_OF.get(language, language)


_TABLE = np.arange(256, dtype=np.uint32)
_TABLE[65:91] += 32
for _c in (9, 10, 11, 12, 13):
    _TABLE[_c] = 32


def features(text: bytes, settings: Settings, window: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram counts of a whole text: feature numbers and counts. Windows overlap by the longest
    n-gram less one, so every n-gram is counted once and memory is bounded."""
    over = max(settings.orders) - 1
    shift = np.uint32(32 - settings.bits)
    total = np.zeros(settings.dimensions, np.int64)
    text = b" " + text + b" "
    for start in range(0, len(text), window):
        b = _TABLE[np.frombuffer(text[start:start + window + over], np.uint8)]
        gram = b
        for k in range(2, max(settings.orders) + 1):
            gram = (gram[:-1] << np.uint32(8)) | b[k - 1:]
            if k in settings.orders:
                code = ((gram[:window] ^ np.uint32(k * 0x01010101)) * np.uint32(2654435761)) >> shift
                total += np.bincount(code, minlength=settings.dimensions)
    at = np.flatnonzero(total)
    return at, total[at]


def sample(df: DataFrame, text: str, language: str, key: str, settings: Settings) -> DataFrame:
    """About ``per_language`` rows of each language as ``label, at, n`` (packed numbers), drawn by a hash of ``key``: no sort and
    no group. Never more than twice that on the whole, even if many rows share a key."""
    labelled = df.select(df[language].cast("string").alias("label"), df[text].cast("string").alias("text"),
                         F.xxhash64(df[key].cast("string"), F.lit(settings.seed)).alias("draw")) \
        .where(F.col("label").isNotNull() & F.col("text").isNotNull())
    sizes = labelled.groupBy("label").agg(F.count("*").alias("rows")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    rate = F.create_map(*[F.lit(x) for r in sizes for x in (r.label, settings.per_language / r.rows)]) \
        if sizes else F.create_map()
    draw = F.col("draw").bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    chosen = labelled.where(draw < F.try_element_at(rate, F.col("label"))) if sizes else labelled.limit(0)
    chosen = chosen.select("label", "text")

    def work() -> Callable:
        def compute(texts):
            found = [features(t.encode(), settings) for t in texts]
            return {"at": [a.astype(np.int32).tobytes() for a, _ in found],
                    "n": [n.astype(np.float32).tobytes() for _, n in found]}
        return compute
    return map_texts(chosen, work, "at binary, n binary").limit(2 * settings.per_language * max(1, len(sizes)))


def fit(df: DataFrame, text: str, language: str, key: str, settings: Settings = Settings()) -> Model:
    """``key`` only spreads the sample; it is no input of the model."""
    rows = sample(df, text, language, key, settings).collect()
    rows.sort()
    languages = tuple(sorted({r.label for r in rows}))
    labels = np.array([r.label for r in rows], object)
    vectors = [_unit(np.frombuffer(r.at, np.int32), np.frombuffer(r.n, np.float32)) for r in rows]
    families = np.array([family(x) for x in labels], object)
    pairs, weights, offsets = [], [], []
    levels = [("family", families)] + [(f, np.where(families == f, labels, "")) for f in sorted(set(families))]
    for level, classes in levels:
        for a, b in itertools.combinations(sorted(set(classes) - {""}), 2):
            at = np.flatnonzero((classes == a) | (classes == b))
            w, c = _train([vectors[i] for i in at], np.where(classes[at] == a, 1.0, -1.0), settings)
            pairs.append((level, a, b))
            weights.append(w)
            offsets.append(c)
    size = settings.dimensions
    return Model(settings, languages, tuple(pairs),
                 np.array(weights, np.float32).reshape(-1, size), np.array(offsets, np.float64))


def _unit(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.sqrt(n)
    return at, n / max(np.sqrt((n * n).sum()), 1e-12)


def _train(vectors, signs: np.ndarray, settings: Settings) -> tuple[np.ndarray, float]:
    """Averaged stochastic subgradient descent on the hinge loss, both classes weighted alike."""
    rng = np.random.default_rng(settings.seed)
    w, c, scale = np.zeros(settings.dimensions), 0.0, 1.0
    balance = {s: len(signs) / (2 * max(1, (signs == s).sum())) for s in (1.0, -1.0)}
    total, total_c, steps = np.zeros(settings.dimensions), 0.0, 0
    t = 0
    for epoch in range(settings.epochs):
        for i in rng.permutation(len(signs)):
            t += 1
            rate = 1.0 / (1.0 + 0.0005 * t)
            at, x = vectors[i]
            scale *= 1 - rate * settings.penalty
            if signs[i] * (scale * (w[at] @ x) + c) < 1:
                step = rate * balance[signs[i]] * signs[i]
                w[at] += step * x / scale
                c += 0.1 * step
        if epoch >= settings.epochs // 2:
            total += w * scale
            total_c += c
            steps += 1
    return total / max(1, steps), total_c / max(1, steps)


def margins(texts: list[bytes], model: Model) -> np.ndarray:
    """One row per text, one column per machine. Counts enter by their square root, so they are gathered per text
    before they are weighted."""
    out = np.empty((len(texts), len(model.pairs)))
    for i, t in enumerate(texts):
        at, n = features(t, model.settings)
        at, x = _unit(at, n)
        out[i] = model.weights[:, at] @ x + model.offsets
    return out


def decide(margin: np.ndarray, model: Model) -> tuple[list[str], np.ndarray]:
    """Winner of the family level, then of that family's languages, and the least confident of the
    duels that they won."""
    n = len(margin)
    families = sorted({family(x) for x in model.languages})
    chosen, sure = _winners(margin, model, "family", families, n)
    languages, score = np.empty(n, object), np.empty(n)
    for k, f in enumerate(families):
        rows = np.flatnonzero(chosen == k)
        members = sorted(x for x in model.languages if family(x) == f)
        best, s = _winners(margin[rows], model, f, members, len(rows))
        languages[rows] = np.array(members, object)[best]
        score[rows] = np.minimum(sure[rows], s)
    return languages.tolist(), score


def _winners(margin, model: Model, level: str, classes: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    votes, strength = np.zeros((n, len(classes))), np.zeros((n, len(classes)))
    duels = [(k, classes.index(a), classes.index(b)) for k, (l, a, b) in enumerate(model.pairs) if l == level]
    for k, a, b in duels:
        m = margin[:, k]
        votes[:, a] += m >= 0
        votes[:, b] += m < 0
        strength[:, a] += np.tanh(m)
        strength[:, b] -= np.tanh(m)
    best = np.argmax(votes + 1e-3 * strength, axis=1) if n else np.zeros(0, int)
    sure = np.ones(n)
    for k, a, b in duels:
        m = np.where(best == a, margin[:, k], np.where(best == b, -margin[:, k], np.inf))
        sure = np.minimum(sure, 1 / (1 + np.exp(-np.clip(4 * m, -30, 30))))
    return best, sure


def predict(df: DataFrame, model: Model, text: str = "text", **keep) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score`` for each row."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # machines x dimensions numbers

    def work() -> Callable:
        m = sent.value

        def compute(texts):
            known = [bool(m.languages) and any(map(str.isalpha, t)) for t in texts]
            at = [i for i, k in enumerate(known) if k]
            languages, scores = ["und"] * len(texts), [0.0] * len(texts)
            if at:
                found, s = decide(margins([texts[i].encode() for i in at], m), m)
                for i, l, x in zip(at, found, s.tolist()):
                    languages[i], scores[i] = l, x
            return {"lang_pred": languages, "score": scores}
        return compute
    return map_texts(read_texts(df, text, **keep), work, "lang_pred string, score double")
