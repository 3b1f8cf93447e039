"""Quality rules by compression bands.

Zstandard ratios (raw bytes over compressed bytes) are taken over the whole text and over fixed chunks of
it. Repetitive text compresses too well, noise too badly. How well ordinary prose compresses depends on its
length, so the limits are a table of bands by length in bytes; chunks have one band of their own, the last one ends with the text, and a
text is rejected if the share of its chunks outside that band is too large. Texts shorter than a chunk are judged as a whole only, those
shorter than the first band by the base rules alone. Everything is computed row by row in Arrow batches: no shuffle, one text in memory
at a time.

Cases: a null or empty text has no words and fails the base rule; ties and repeated rows are judged one by
one; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from ebbmark.llm.common import SPACE, map_texts, read_texts

WINDOW = 8
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """``whole``: (bytes from which the band holds, least ratio, greatest ratio), by length."""

    whole: tuple[tuple[int, float, float], ...] = (
        (256, 1.15, 3.2), (512, 1.3, 3.6), (1024, 1.4, 4.2), (2048, 1.5, 4.8), (4096, 1.6, 5.5),
        (16384, 1.65, 7.0), (65536, 1.65, 9.0))
    chunk_bytes: int = 2048
    chunk: tuple[float, float] = (1.4, 8.0)
    odd_chunks: float = 0.3
    level: int = 3

    def band(self, size: int) -> tuple[float, float] | None:
        found = None
        for least, low, high in self.whole:
            if size >= least:
                found = (low, high)
        return found


@dataclass(frozen=True)
class BaseRules:
    least_words: int = 20
    repeated_percent: int = 30
    window: int = field(default=WINDOW)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by windows of ``window`` words that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    if len(np.unique(h)) == len(h):
        return 0
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    twin = np.zeros(n, bool)
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    at = np.flatnonzero(twin).tolist()
    seen: dict[tuple[bytes, ...], int] = {}  # equal hashes are only candidates
    for i in at:
        key = tuple(words[i:i + window])
        seen[key] = seen.get(key, 0) + 1
    covered = np.zeros(len(words) + 1, np.int64)
    for i in at:
        if seen[tuple(words[i:i + window])] > 1:
            covered[i] += 1
            covered[i + window] -= 1
    return int((np.cumsum(covered[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


def counts(text: str, window: int = WINDOW) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, words in repeated windows."""
    words = text.encode().split()
    chars = len(text) - sum(text.count(c) for c in SPACE)
    return (len(words), chars, sum(text.count(c) for c in SYMBOLS), duplicate_lines(text),
            repeated_words(words, window))


class Compressor:
    def __init__(self, bands: Bands):
        import zstandard
        self.bands = bands
        self.compress = zstandard.ZstdCompressor(level=bands.level, write_content_size=False).compress

    def ratio(self, raw: bytes) -> float:
        return len(raw) / len(self.compress(raw)) if raw else 1.0

    def verdict(self, raw: bytes) -> tuple[float, float, bool]:
        """Ratio of the whole, share of chunks outside their band, and whether the text is within limits."""
        size, whole = len(raw), self.ratio(raw)
        band = self.bands.band(size)
        if band is None:
            return whole, 0.0, True
        step, (low, high) = self.bands.chunk_bytes, self.bands.chunk
        starts = list(range(0, size - step + 1, step))
        if starts and size % step:
            starts.append(size - step)  # the last piece too, as a chunk of full length
        chunks = [self.ratio(raw[i:i + step]) for i in starts]
        odd = sum(not low <= r <= high for r in chunks) / len(chunks) if chunks else 0.0
        return whole, odd, band[0] <= whole <= band[1] and odd <= self.bands.odd_chunks


def judge(df: DataFrame, bands: Bands = Bands(), base: BaseRules = BaseRules(), text: str = "text", **keep) -> DataFrame:
    """``keep`` columns with the counts, both ratios, ``base_failed`` and ``kept`` for each row."""
    def work() -> Callable:
        compressor = Compressor(bands)

        def compute(texts):
            rows = []
            for t in texts:
                n, chars, symbols, lines, repeated = counts(t, base.window)
                failed = n < base.least_words or 100 * repeated > base.repeated_percent * n
                whole, odd, within = compressor.verdict(t.encode())
                rows.append((n, chars, symbols, lines, repeated, whole, odd, failed, within and not failed))
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio", "odd_chunks",
                     "base_failed", "kept")
            return dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}
        return compute
    return map_texts(read_texts(df, text, **keep), work,
                     "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                     "ratio double, odd_chunks double, base_failed boolean, kept boolean")
