"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

import ebbmark
from ebbmark.session import SETTINGS

# Functions of this package travel to the workers by value, so it need not be installed there.
cloudpickle.register_pickle_by_value(ebbmark)

#: Word separators of the contracts: space and the control characters \\t \\n \\v \\f \\r.
SPACE = " \t\n\v\f\r"

#: Bounds of one Arrow batch sent to a Python worker. Texts may be long, so bytes are bounded too.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings that the operators of this subpackage rely on."""
    spark.conf.set("spark.sql.session.timeZone", SETTINGS["spark.sql.session.timeZone"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def read_texts(df: DataFrame, text: str = "text", **more: Column) -> DataFrame:
    """Only what an operator needs: the text as ``text`` and named expressions; other columns of ``df``
    are never touched, so their names cannot clash."""
    return df.select(*[c.alias(n) for n, c in more.items()], df[text].cast("string").alias("text"))


def map_texts(df: DataFrame, work: Callable[[], Callable[[list[str]], dict[str, Iterable]]],
              fields: str) -> DataFrame:
    """Replace the column ``text`` of ``df`` by columns that Python computes from it, batch by batch.

    ``work()`` runs once per task and returns a function from a list of texts (null: empty) to columns
    of the types in ``fields``. Rows are neither shuffled nor reordered.
    """
    kept = [f for f in df.schema.fields if f.name != "text"]
    made = T._parse_datatype_string(fields)
    schema = T.StructType(kept + list(made.fields))
    arrow = _arrow_schema(schema)
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = work()
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            columns = compute(texts)
            arrays = [batch.column(n) for n in names]
            for field in made.fields:
                values = columns[field.name]
                kind = arrow.field(field.name).type
                arrays.append(values if isinstance(values, pa.Array) else pa.array(values, kind, from_pandas=False))
            yield pa.RecordBatch.from_arrays([_as(a, f.type) for a, f in zip(arrays, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def _as(array: pa.Array, kind: pa.DataType) -> pa.Array:
    return array if array.type == kind else array.cast(kind)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema, timezone="UTC") if _takes_timezone(to_arrow_schema) else to_arrow_schema(schema)


def _takes_timezone(function) -> bool:
    import inspect
    return "timezone" in inspect.signature(function).parameters


def slices_by_bytes(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` bytes; a longer text stands alone."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > most:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def sums_by(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values`` that begin at ``starts``; empty runs give 0."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    ends = np.append(starts[1:], len(values))
    return total[ends] - total[starts]


def finite(vector: Column) -> Column:
    """Whether a vector is there and has no null, NaN or infinite component."""
    infinity = F.lit(float("inf"))
    return vector.isNotNull() & F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinity))
