"""Running folds over an ordered stream without one global sort.

A running maximum over a whole stream is a window function with an empty partition key, which Spark
evaluates in one task. Here the order is cut into *units*: a slice is a fixed-width range of the
leading order column, and a slice that holds too many rows is cut further, at exact row counts, into
parts. Each unit is folded locally (a hash shuffle on scope and unit), one summary row per unit is
carried forward, and the carry is joined back. Units are a pure function of the data, so retried
tasks and separately planned branches agree on them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ebbmark.functions.scalars import bucket

ID_BLOCK = 65_536
FINER = 1024  # slices into which an overfull one is cut to count its rows


@dataclass(frozen=True)
class Slicing:
    """How to cut the order. ``width`` applies to the first order column, which must be an integer.

    ``rows_per_part`` bounds a unit: a slice above it is split at exact positions of the order, even
    inside one arrival millisecond. ``None`` is for inputs whose slices are small by construction
    (one row per tick, one row per block). ``coarse`` makes the carry over unit summaries a running
    fold of its own, over groups of that many slices; without it one task per scope walks the
    summaries, which is meant for slices of time, whose number does not grow with the data.
    """

    width: int
    rows_per_part: int | None = 4_000_000
    coarse: int | None = None


def _overfull(df: DataFrame, keys: list[str], slicing: Slicing) -> DataFrame:
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
            .where(F.col("_rows") > slicing.rows_per_part))


def _position(order: list[str]) -> list[Column]:
    return [F.col(order[0]).cast("long").alias("_at"), bucket(order[-1], ID_BLOCK).alias("_tie")]


def _parts(df: DataFrame, keys: list[str], order: list[str], slicing: Slicing) -> DataFrame:
    """The part of every position: one row per millisecond and block of ids that has rows. A slice that is not overfull has part 0.

    Rows before a position are counted by a running fold over finer slices, so one overfull slice is spread over tasks too (picking
    the overfull slices by a join would bring each into one task). A part begins where the count passes a multiple of ``rows_per_part``.
    """
    positions = (df.groupBy(*keys, *_position(order)).agg(F.count(F.lit(1)).alias("_n"))
                 .withColumnRenamed("_slice", "_whole"))
    whole = [k for k in keys if k != "_slice"] + ["_whole"]
    counted = running(positions, whole, ["_at", "_tie"], {"_rows": ("sum", "_n")},
                      Slicing(max(1, slicing.width // FINER), None), inclusive=False)
    return counted.select(*whole, "_at", "_tie", F.floor(F.coalesce("_rows_before", F.lit(0)) / slicing.rows_per_part).alias("_part")) \
        .withColumnRenamed("_whole", "_slice")


def with_units(df: DataFrame, scope: list[str], order: list[str], slicing: Slicing) -> tuple[DataFrame, list[str]]:
    """Add the unit columns; units of one scope sort like the rows they hold.

    Counts the slices first, as a range partitioning samples first, and plans no split when none is
    overfull.
    """
    df = df.withColumn("_slice", bucket(order[0], slicing.width))
    keys = scope + ["_slice"]
    if slicing.rows_per_part is None or _overfull(df, keys, slicing).isEmpty():
        return df, ["_slice"]
    parts = _parts(df, keys, order, slicing)
    rows = df.select("*", *_position(order)).alias("r")
    here = [F.col(f"r.{c}") == F.col(f"p.{c}") for c in [*keys, "_at"]] + [F.col("r._tie").eqNullSafe(F.col("p._tie"))]
    # A lookup by position, so a row costs the same however many parts its slice has.
    df = rows.join(parts.alias("p"), here, "left").select(*[f"r.{c}" for c in df.columns], F.coalesce("p._part", F.lit(0)).alias("_part"))
    return df, ["_slice", "_part"]


def _fold(kind: str, column: str, order: list[str]) -> Column:
    at = F.struct(*[F.col(c) for c in order])
    present = F.when(F.col(column).isNotNull(), at) if column != "*" else None
    if kind == "count":
        return F.count(F.lit(1)) if column == "*" else F.count(column)
    if kind == "last":
        return F.max_by(column, present)
    if kind == "first":
        return F.min_by(column, present)
    return {"max": F.max, "min": F.min, "sum": F.sum}[kind](column)


def _windowed(kind: str, column: str, frame) -> Column:
    if kind == "count":
        return (F.count(F.lit(1)) if column == "*" else F.count(column)).over(frame)
    if kind == "last":
        return F.last(column, ignorenulls=True).over(frame)
    if kind == "first":
        return F.first(column, ignorenulls=True).over(frame)
    return {"max": F.max, "min": F.min, "sum": F.sum}[kind](column).over(frame)


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind == "max":
        return F.greatest(carried, local)
    if kind == "min":
        return F.least(carried, local)
    if kind == "last":
        return F.coalesce(local, carried)
    if kind == "first":
        return F.coalesce(carried, local)
    if kind == "count":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    return F.when(carried.isNull(), local).when(local.isNull(), carried).otherwise(carried + local)


def running(df: DataFrame, scope: list[str], order: list[str], folds: dict[str, tuple[str, str]],
            slicing: Slicing, inclusive: bool = True, exclusive: bool = True, suffix: str = "") -> DataFrame:
    """Add running folds over ``order`` within ``scope``.

    ``folds`` maps an output name to (kind, column); kinds are ``max``, ``min``, ``sum``, ``count``
    (column ``*`` for rows), ``first`` and ``last`` (both skip nulls). The inclusive fold is named as
    given plus ``suffix``, the fold over strictly earlier rows gets ``_before`` on top. Rows must be distinct on
    ``scope + order``, and a tie breaker in ``order`` must be an integer.
    """
    df, unit = with_units(df, scope, order, slicing)
    keys = scope + unit
    rows = Window.partitionBy(*keys).orderBy(*order)
    upto = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = rows.rowsBetween(Window.unboundedPreceding, -1)
    summary = df.groupBy(*keys).agg(*[_fold(k, c, order).alias(f"_u_{n}") for n, (k, c) in folds.items()])
    carried = _carried(summary, scope, unit, {n: k for n, (k, _) in folds.items()}, slicing.coarse)
    columns = [c for c in df.columns if c not in unit]
    local = df
    for name, (kind, column) in folds.items():
        if inclusive:
            local = local.withColumn(f"_i_{name}", _windowed(kind, column, upto))
        if exclusive:
            local = local.withColumn(f"_x_{name}", _windowed(kind, column, before))
    out = [F.col(c) for c in columns]
    for name, (kind, _) in folds.items():
        if inclusive:
            out.append(_combine(kind, F.col(f"_c_{name}"), F.col(f"_i_{name}")).alias(name + suffix))
        if exclusive:
            out.append(_combine(kind, F.col(f"_c_{name}"), F.col(f"_x_{name}")).alias(f"{name}{suffix}_before"))
    return local.join(carried, keys).select(*out)


def _carried(summary: DataFrame, scope: list[str], unit: list[str], kinds: dict[str, str],
             coarse: int | None) -> DataFrame:
    """Per unit, the fold over all earlier units of its scope, as ``_c_<name>``."""
    kinds = {n: "sum" if k == "count" else k for n, k in kinds.items()}
    if coarse is None:
        earlier = Window.partitionBy(*scope).orderBy(*unit).rowsBetween(Window.unboundedPreceding, -1)
        return summary.select(*scope, *unit, *[_windowed(k, f"_u_{n}", earlier).alias(f"_c_{n}")
                                               for n, k in kinds.items()])
    inner = summary.select(*scope, *[F.col(u).alias(f"_at{u}") for u in unit], *[f"_u_{n}" for n in kinds])
    out = running(inner, scope, [f"_at{u}" for u in unit], {n: (k, f"_u_{n}") for n, k in kinds.items()},
                  Slicing(coarse, None), inclusive=False)
    return out.select(*scope, *[F.col(f"_at{u}").alias(u) for u in unit],
                      *[F.col(f"{n}_before").alias(f"_c_{n}") for n in kinds])


def running_max_by_arrival(events: DataFrame, scope: list[str], slicing: Slicing) -> DataFrame:
    """Newest event time seen up to (``newest``) and before (``newest_before``) each arrival."""
    return running(events, scope, ["arrival_time", "event_id"], {"newest": ("max", "event_time")}, slicing)
