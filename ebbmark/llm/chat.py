r"""Chat formatting by token-level assembly.

A turn is written ``<turn>### role: text</turn>`` and a line feed. The parts of the template are reserved ids beyond the vocabulary;
role and text are encoded separately, as ordinary text, and the reserved ids are spliced between them, so no text can produce
one. In the written form, control strings that occur in a text are preceded by a backslash and backslashes are doubled, which
is undone on reading. The loss mask marks the tokens of assistant texts: +1 where such a text begins, -1 where it ends, and
the running sum in between.

Turns are formatted row by row, without a shuffle: a conversation's sequence is its turns' rows in order, so a conversation of
any length never has to fit in memory. ``digests`` reads the ids and masks back and streams each conversation, sorted, through
running hashes.

Cases: a null text or role is empty; equal turn numbers are ordered by role, then text; repeated rows are turns of their own; rows with a
null conversation form one; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ebbmark.llm import bpe

OPEN, SAYS, CLOSE = "<turn>### ", ": ", "</turn>\n"
LOSS_ROLE = "assistant"

#: Strings that must not stand unescaped in a text; the special tokens of the vocabulary are added.
CONTROL = ("<turn>", "</turn>", "###")


class Formatter:
    """Encodes and reads turns with one vocabulary file, for use within a task."""

    def __init__(self, path: str):
        self.codec = bpe.Codec(path, ordinary=True)
        tokens, special = bpe.vocabulary(path)
        first = max(tokens) + 1
        self.open, self.says, self.close = first, first + 1, first + 2
        self.reserved = {self.open: OPEN, self.says: SAYS, self.close: CLOSE}
        self.bytes_of = tokens | {i: s.encode() for i, s in self.reserved.items()}
        words = sorted([*CONTROL, *(s.decode() for s in special)], key=len, reverse=True)
        self.control = re.compile(r"\\|" + "|".join(map(re.escape, words)))
        self.role_control = re.compile(self.control.pattern + "|:")

    def escape(self, text: str, role: bool = False) -> str:
        return (self.role_control if role else self.control).sub(lambda m: "\\" + m[0], text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def turns(self, roles: list[str], texts: list[str]) -> list[tuple[list[int], np.ndarray]]:
        """Ids and loss mask of each turn."""
        encoded = self.codec.encode([x for r, t in zip(roles, texts) for x in (self.escape(r, True), self.escape(t))])
        out = []
        for i, role in enumerate(roles):
            head, body = encoded[2 * i], encoded[2 * i + 1]
            ids = [self.open, *head, self.says, *body, self.close]
            step = np.zeros(len(ids) + 1, np.int8)
            if role == LOSS_ROLE:
                step[2 + len(head)] += 1
                step[2 + len(head) + len(body)] -= 1
            out.append((ids, np.cumsum(step)[:-1]))
        return out

    def written(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def read(self, ids: list[int], mask: list[int]) -> tuple[str, str, str, str]:
        """Role, text, text under the mask, and the written form, from ids and mask alone."""
        says = ids.index(self.says)
        role, text = self.written(ids[1:says]), self.written(ids[says + 1:-1])
        loss = self.written([i for i, m in zip(ids, mask) if m]) if any(mask) else ""
        return self.unescape(role), self.unescape(text), self.unescape(loss), self.written(ids)


def format_turns(df: DataFrame, path: str, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """For each row ``conv_id, turn, role_key, text_key`` (what orders equal turn numbers), ``ids`` and ``mask``."""
    rows = df.select(df[conversation].alias("conv_id"), df[turn].alias("turn"), df[role].cast("string").alias("role"),
                     df[text].cast("string").alias("text"))
    from pyspark.sql import types as T

    from ebbmark.llm.common import _arrow_schema
    kept = [rows.schema["conv_id"], rows.schema["turn"], T.StructField("role_key", T.StringType()), T.StructField("text_key", T.StringType())]
    schema = T.StructType(kept + [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("mask", T.ArrayType(T.ByteType()))])
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formatter = Formatter(path)
        for batch in batches:
            roles, texts = ([x or "" for x in batch.column(c).to_pylist()] for c in ("role", "text"))
            made = formatter.turns(roles, texts)
            yield pa.RecordBatch.from_arrays([
                batch.column("conv_id"), batch.column("turn"), pa.array(roles, pa.string()), pa.array(texts, pa.string()),
                pa.array([m[0] for m in made], arrow.field("ids").type),
                pa.array([m[1].tolist() for m in made], arrow.field("mask").type)], schema=arrow)
    return rows.mapInArrow(run, schema)


def digests(formatted: DataFrame, path: str) -> DataFrame:
    """For each conversation: ``n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, read back from ids
    and masks. Memory holds one batch and one conversation's running hashes."""
    from pyspark.sql import types as T

    from ebbmark.llm.common import _arrow_schema
    schema = T.StructType([formatted.schema["conv_id"], *T._parse_datatype_string(
        "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").fields])
    arrow = _arrow_schema(schema)
    order = ("conv_id", "turn", "role_key", "text_key")
    rows = formatted.repartition("conv_id").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formatter = Formatter(path)
        done: list[tuple] = []
        key, state = None, None

        def close() -> None:
            if state is not None:
                n, turns, chars, loss, written = state
                done.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), written))

        def out() -> pa.RecordBatch:
            columns = list(zip(*done))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for conversation, ids, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "mask"))):
                if state is None or conversation != key:
                    close()
                    key, state = conversation, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, loss, written = formatter.read(ids, mask)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(written)
            if done:
                yield out()
                done.clear()
        close()
        if done:
            yield out()
    return rows.mapInArrow(run, schema)
