"""Byte-pair encoding with forced boundaries, and decoding.

A byte pair that occurs inside no token of the vocabulary can never be merged over, so a cut between the
two bytes cannot change the encoding, as long as the pre-tokenizer cuts there too. The text is cut at all
such places, each fragment is encoded on its own, and the ids are concatenated. Fragments are short and
recur, so a worker encodes each one once and keeps the result in a bounded table; memory does not depend on
the length of a text, and nothing is shuffled.

Which pairs qualify is computed from the vocabulary file. A cut must also be safe for the pre-tokenizer's
pattern: it is taken only after an ASCII letter before another class, after an ASCII digit before another
class, and after other ASCII punctuation or an accented Latin letter before white space. White space is never cut from what follows it,
because the pattern looks ahead there. The special tokens of the file contain no such place once their own
inner pairs are exempted, so they are matched within a fragment as in the whole text.

Cases: a null text is encoded as an empty one (no ids); repeated rows give repeated results; an empty table
gives an empty one; other columns are not read. Ids outside the vocabulary decode to nothing.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from ebbmark.llm.common import map_texts, read_texts

#: Fixed value: the pre-tokenizer's pattern of byte-level vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Fragments whose ids a worker keeps at most, and the longest that it keeps.
MEMO, MEMO_BYTES = 400_000, 64


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 characters stand for
    themselves, the other bytes for the code points from 256 on, in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> tuple[dict[int, bytes], list[bytes]]:
    """Bytes of each id, and the special tokens."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    alphabet = byte_alphabet()
    tokens = {i: bytes(alphabet[c] for c in t) for t, i in model["model"]["vocab"].items()}
    special = []
    for added in model.get("added_tokens", []):
        tokens[added["id"]] = added["content"].encode()
        special.append(added["content"].encode())
    return tokens, special


def cut_tables(tokens: dict[int, bytes], special: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """256 x 256 booleans: may the text be cut between these two bytes? And, if the first ends a two-byte
    Latin letter?"""
    joined = np.zeros((256, 256), bool)
    for token in [*tokens.values(), *special]:
        b = np.frombuffer(token, np.uint8)
        joined[b[:-1], b[1:]] = True
    byte = np.arange(256)
    ascii_ = byte < 128
    letter = ((byte | 32) >= 97) & ((byte | 32) <= 122) & ascii_
    digit = (byte >= 48) & (byte <= 57)
    space = ((byte >= 9) & (byte <= 13)) | (byte == 32)
    mark = (byte > 32) & (byte < 127) & ~letter & ~digit
    safe = (letter[:, None] & (ascii_ & ~letter)[None, :]) | (digit[:, None] & (ascii_ & ~digit)[None, :]) \
        | (mark[:, None] & space[None, :])
    return safe & ~joined, ~joined & space[None, :] & (byte >= 128)[:, None]


class Codec:
    """Encoder and decoder of one vocabulary file, for use within a task. ``ordinary``: strings of special tokens
    are text like any other."""

    def __init__(self, path: str, ordinary: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        import tiktoken
        from tokenizers import Tokenizer
        tokens, special = vocabulary(path)
        self.cuts, self.before_space = cut_tables(tokens, special)
        self.accented = np.isin(np.arange(256), (0xC3, 0xC4, 0xC5))  # lead bytes of U+00C0 to U+017F
        self.bytes_of = tokens
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = ordinary
        self.special = [] if ordinary else [t.decode() for t in special]
        # Token ids of byte-level vocabularies are in merge order, so the same merges serve as ranks.
        ranks = {t: i for i, t in tokens.items() if t not in special}
        self.ranked = tiktoken.Encoding("fragments", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.memo: dict[bytes, tuple[int, ...]] = {}

    def fragments(self, text: bytes) -> list[bytes]:
        if len(text) < 2:
            return [text] if text else []
        b = np.frombuffer(text, np.uint8)
        cut = self.cuts[b[:-1], b[1:]]
        cut[1:] |= self.accented[b[:-2]] & self.before_space[b[1:-1], b[2:]]
        at = (np.flatnonzero(cut) + 1).tolist()
        return [text[i:j] for i, j in zip([0, *at], [*at, len(text)])]

    def encode_new(self, fragments: list[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Western fragments go to the quicker of two encoders of the same merges. The other knows special
        tokens, and its pattern is the reference for scripts on whose newest letters the two may differ."""
        found, rest = {}, []
        ordinary = self.ranked.encode_ordinary
        for f in fragments:
            if max(f) < 0xc9:  # all code points below U+0240
                text = f.decode()
                if not any(s in text for s in self.special):
                    found[f] = tuple(ordinary(text))
                    continue
            rest.append(f)
        if rest:
            encoded = self.tokenizer.encode_batch([f.decode() for f in rest], add_special_tokens=False)
            found.update((f, tuple(e.ids)) for f, e in zip(rest, encoded))
        return found

    def encode(self, texts: list[str]) -> list[list[int]]:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        parts = [self.fragments(t.encode()) for t in texts]
        new = [f for f in {f for p in parts for f in p} if f not in memo]
        memo.update(self.encode_new(new))
        out = []
        for p in parts:
            ids: list[int] = []
            for f in p:
                ids += memo[f]
            out.append(ids)
        for f in new:
            if len(f) > MEMO_BYTES:
                del memo[f]
        return out

    def decode(self, ids: list[int]) -> str:
        get = self.bytes_of.get
        return b"".join([get(i, b"") for i in ids]).decode("utf-8", "replace")


def encode(df: DataFrame, path: str, text: str = "text", **keep) -> DataFrame:
    """``keep`` columns and ``ids array<int>`` for each row of ``df``."""
    def work() -> Callable:
        codec = Codec(path)
        return lambda texts: {"ids": codec.encode(texts)}
    return map_texts(read_texts(df, text, **keep), work, "ids array<int>")


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """The text of the ids as ``text``, in place of the column ``ids``."""
    import pyarrow as pa
    from pyspark.sql import types as T

    from ebbmark.llm.common import _arrow_schema

    names = [c for c in df.columns if c != ids]
    schema = T.StructType([df.schema[n] for n in names] + [T.StructField("text", T.StringType())])
    arrow = _arrow_schema(schema)

    def run(batches):
        codec = Codec(path)
        for batch in batches:
            texts = [codec.decode(i or []) for i in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(texts, arrow.field("text").type)],
                                             schema=arrow)
    return df.mapInArrow(run, schema)


def round_trip_digests(df: DataFrame, path: str, text: str = "text", **keep) -> DataFrame:
    """``keep``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: ids are encoded, then decoded from the
    ids alone, in one pass over the texts, so that the ids of a table need not be held twice."""
    def work() -> Callable:
        codec = Codec(path)
        digits = {i: str(i) for i in codec.bytes_of}

        def compute(texts):
            count, coded, back = [], [], []
            for ids in codec.encode(texts):
                count.append(len(ids))
                coded.append(hashlib.sha256(",".join([digits[i] for i in ids]).encode()).hexdigest())
                back.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            return {"n_tokens": count, "ids_sha256": coded, "decoded_sha256": back}
        return compute
    return map_texts(read_texts(df, text, **keep), work,
                     "n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")
