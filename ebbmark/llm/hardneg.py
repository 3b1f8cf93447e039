"""Hard negatives by threshold joins of anchors against all rows (after L2AP).

An anchor's positives are its best rows of the same label; each positive opens a window of scores in which the best rows of other
labels are its negatives. Both are searched by joins with a threshold: all rows that score at least t against an anchor. Where
a threshold leaves a window short of rows, it is lowered for that anchor, the last time to the end of the window, so the answer is exact.

Rows are packed once into blocks, written down. Each search deals its blocks to units, and every unit gets all sets of anchors (or a share of them,
where blocks are few): a task holds the blocks of one unit while the sets stream by. Blocks travel once a search and anchors once a unit, in shuffles; no
join or broadcast brings them together, so the driver holds neither. In a block, dimensions stand by falling energy over the table. The block's inverted index holds a row's leading dimensions only: the rest is left out from where the norm of the
row's remaining part is too small to reach any threshold of the anchors by itself. Postings are accumulated some dimensions at a time, for rows with posting
lists of about one length together; a row goes when its partial scores and the products of the remaining norms stay below the thresholds of all anchors of the set.
What survives is completed with the dimensions left out. A unit returns at most as many rows a window as the window takes, so merging them loses nothing; once a window
is full, only rows that score at least its last one are looked for in the unit's further blocks.

Scores are inner products of whole numbers, exact in 64 bits (from the float product while it is below 2^53, else in whole numbers
without bound, cut to 64 bits at the end).

Cases: rows without id, label or vector, or with a null, NaN or infinite component take no part; vectors of different length count as filled up with
zeros; rows equal in id, label and vector count once; rows of the anchor's own id are neither its positives nor its negatives; rows of one id
and different contents count each; ties go to the smaller id; a negative positive score opens no window; an empty table gives an empty one;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ebbmark.llm.common import finite
from ebbmark.session import stored


@dataclass(frozen=True)
class Settings:
    """``low`` to ``high`` hundredths of the positive's score: the window. ``levels``: thresholds for positives, as shares of the product of the
    anchor's norm and the rows' root mean square norm; ``depths``: thresholds for negatives, as shares of the window's width; below the
    last ones the search is without a threshold, or reaches the window's end. ``held_bytes``: most bytes of blocks in a unit, one block at least."""

    scale: int = 256
    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    block_rows: int = 8192
    anchor_rows: int = 256
    held_bytes: int = 32 << 20
    levels: tuple[float, ...] = (0.35, 0.15)
    depths: tuple[float, ...] = (0.75, 0.4)
    chunk: int = 8


#: No score is below it.
NEVER = -(1 << 62)
#: Rows whose scores with a set of anchors are computed at a time, so that they stay in the cache.
TILE = 512
BLOCK = "block long, ids binary, labels binary, matrix binary"
#: What meets in a unit: its blocks (``asks`` 0) come first and stay, sets of anchors pass. Windows: the anchor's number in the set, place, least, most.
MEETING = "share int, asks int, uids binary, ids binary, labels binary, matrix binary, windows binary"


@dataclass(frozen=True)
class Shape:
    """``blocks``: their number; ``kind``: the smallest integer type that holds all components."""

    blocks: int
    dims: int
    kind: str


def _packed(rows: DataFrame, settings: Settings) -> tuple[DataFrame, Shape]:
    """Rows dealt evenly into blocks of bytes."""
    n, dims, low, high = rows.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0)), F.coalesce(F.min(F.array_min("q")), F.lit(0)),
                                  F.coalesce(F.max(F.array_max("q")), F.lit(0))).first()
    kind = next(k for k in ("int16", "int32", "int64") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    shape = Shape(max(1, -(-n // settings.block_rows)), dims, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        ids, labels, parts = [], [], []
        for batch in batches:
            ids.append(batch.column("id").to_numpy())
            labels.append(batch.column("label").to_numpy())
            parts.append(_matrix(batch.column("q"), shape))
        if sum(map(len, ids)):
            out = [[TaskContext.get().partitionId()], *([np.concatenate(p).tobytes()] for p in (ids, labels, parts))]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, (pa.int64(), *[pa.binary()] * 3))], names=["block", "ids", "labels", "matrix"])
    return stored(rows.select("id", "label", "q").repartition(shape.blocks).mapInArrow(run, BLOCK), "negatives-blocks"), shape


def _matrix(column: pa.Array, shape: Shape) -> np.ndarray:
    out = np.zeros((len(column), shape.dims), shape.kind)
    sizes = column.value_lengths().to_numpy()
    out[np.arange(shape.dims) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _rows_of(packed: dict, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(packed["ids"], np.int64)
    return ids, np.frombuffer(packed["labels"], np.int64), np.frombuffer(packed["matrix"], shape.kind).reshape(len(ids), shape.dims)


def above(anchors: np.ndarray, least: np.ndarray, rows: np.ndarray, order: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs that score at least the anchor's threshold: numbers of the anchors and of the rows, and scores."""
    a, x = anchors[:, order].astype(np.float64), rows[:, order].astype(np.float64)
    dims = a.shape[1]
    rest_a, rest_x = _rests(a, chunk), _rests(x, chunk)
    # From where on a row's remaining part cannot reach the threshold of any anchor, in steps of ``chunk``.
    norm, size = np.maximum(rest_a[:, 0], 1.0), np.maximum(rest_x[:, 0], 1.0)
    reach = (least / norm).min() if len(least) else 0.0
    length = (rest_x[:, :-1] >= reach).sum(axis=1) if reach > 0 else np.full(len(x), rest_x.shape[1] - 1)
    at = np.argsort(-length, kind="stable")  # rows of a tile then have posting lists of about one length
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for start in range(0, len(x), TILE):
        here, score, done = at[start:start + TILE], 0.0, 0
        # Float sums may be off by rounding where the whole numbers are large; the thresholds allow for it.
        bar = (least - 1e-9 * norm * size[here].max() - 0.5)[:, None]
        for stop in _stops(int(length[here[0]]), rest_x.shape[1] - 1):
            end = min(stop * chunk, dims)
            score, done = score + a[:, done:end] @ x[here, done:end].T, end
            if end == dims:
                i, j = np.nonzero(score >= bar)
                found.append((i, here[j], score[i, j]))
                break
            # What is left out may add the product of the remaining norms at most.
            bound = np.multiply.outer(rest_a[:, stop], rest_x[here, stop])
            bound += score
            alive = (bound >= bar).any(axis=0)
            if np.count_nonzero(alive) < 0.75 * len(here):
                here, score = here[alive], score[:, alive]
            if not len(here):
                break
    i, j, score = (np.concatenate(p) for p in zip(*found))
    if len(x) and norm.max() * size.max() < 1 << 53:
        exact = score.astype(np.int64)
    else:
        full = [int(np.dot(anchors[p].astype(object), rows[q].astype(object))) for p, q in zip(i, j)]
        exact = np.array([min(max(v, -(1 << 63)), (1 << 63) - 1) for v in full], np.int64)
    keep = exact >= least[i]
    return i[keep], j[keep], exact[keep]


def _stops(length: int, steps: int) -> list[int]:
    """Steps of dimensions after which rows are dropped: the indexed ones by doubling, then those that the index leaves out."""
    stops, at = [], 1
    while at < length:
        stops.append(at)
        at *= 2
    return [*stops, *([length] if length < steps else []), steps]


def _rests(m: np.ndarray, chunk: int) -> np.ndarray:
    """Norms of the parts from each step of ``chunk`` dimensions on; one column more than steps."""
    steps = [(m[:, c:c + chunk] ** 2).sum(axis=1) for c in range(0, m.shape[1], chunk)]
    squares = np.stack([*steps, np.zeros(len(m))], axis=1)
    return np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1])


#: One search: rows of the anchor's label or of others, in the windows [least, most] of the anchor, first ``take`` each.
FOUND = "uid long, place int, id long, score long"


def _sets(anchors: DataFrame, shape: Shape, shares: int, settings: Settings) -> DataFrame:
    """Anchors packed into sets, which take turns in the ``shares``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId()
        for batch in batches:
            for start in range(0, batch.num_rows, settings.anchor_rows):
                some = batch.slice(start, settings.anchor_rows)
                listed = some.column("windows")
                owner = np.repeat(np.arange(some.num_rows), listed.value_lengths().to_numpy())
                windows = np.stack([owner, *(c.to_numpy() for c in listed.flatten().flatten())]).astype(np.int64)
                out = [some.column("uid").to_numpy(), some.column("id").to_numpy(), some.column("label").to_numpy(), _matrix(some.column("q"), shape), windows]
                yield pa.RecordBatch.from_arrays([pa.array([number % shares], pa.int32()), pa.array([1], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in out)],
                                                 names=["share", "asks", "uids", "ids", "labels", "matrix", "windows"])
                number += 1
    return anchors.select("uid", "id", "label", "q", "windows").mapInArrow(run, MEETING)


def _best(asked: dict, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], shape: Shape, order: np.ndarray, same: bool, take: int, chunk: int) -> pa.RecordBatch:
    """The first ``take`` rows of each window of a set of anchors among the rows of the blocks held."""
    ids, labels, q = _rows_of(asked, shape)
    owner, place, least, most = np.frombuffer(asked["windows"], np.int64).reshape(4, -1)
    starts = np.searchsorted(owner, np.arange(len(ids) + 1))
    least, top = least.copy(), np.maximum.reduceat(most, starts[:-1])
    of, names, scores = (np.zeros(0, np.int64) for _ in range(3))
    for own, alike, rows in held:
        i, j, score = above(q, np.minimum.reduceat(least, starts[:-1]), rows, order, chunk)
        keep = ((labels[i] == alike[j]) == same) & (ids[i] != own[j]) & (score <= top[i])
        i, name, score = i[keep], own[j[keep]], score[keep]
        o = np.lexsort((name, -score, i))
        i, name, score = i[o], name[o], score[o]
        ends = np.searchsorted(i, np.arange(len(ids) + 1))
        first, last = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
        for k in np.flatnonzero(ends[1:] > ends[:-1]):
            falling, own_windows = -score[ends[k]:ends[k + 1]], slice(starts[k], starts[k + 1])
            first[own_windows] = ends[k] + np.searchsorted(falling, -most[own_windows], "left")
            last[own_windows] = ends[k] + np.searchsorted(falling, -least[own_windows], "right")
        size = np.clip(last - first, 0, take)
        at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        of, names, scores = (np.concatenate(p) for p in ((of, np.repeat(np.arange(len(owner)), size)), (names, name[at]), (scores, score[at])))
        o = np.lexsort((names, -scores, of))
        of, names, scores = of[o], names[o], scores[o]
        keep = np.arange(len(of)) - np.searchsorted(of, of) < take
        of, names, scores = of[keep], names[keep], scores[keep]
        full = np.searchsorted(of, np.arange(len(owner)), "right")
        full = full[np.bincount(of, minlength=len(owner)) == take] - 1
        least[of[full]] = scores[full]  # rows that score less come after the last one
    out = np.frombuffer(asked["uids"], np.int64)[owner[of]], place[of], names, scores
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["uid", "place", "id", "score"])


def _search(anchors: DataFrame, blocks: DataFrame, shape: Shape, order: np.ndarray, same: bool, take: int, settings: Settings) -> DataFrame:
    """``anchors``: uid, id, label, q and ``windows``, an array of (place, least, most). The best rows of each window, at most ``take``."""
    tasks = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fit = settings.held_bytes // max(1, settings.block_rows * shape.dims * np.dtype(shape.kind).itemsize)
    held = max(1, min(fit, shape.blocks // tasks))  # blocks of a unit
    units = -(-shape.blocks // held)
    shares = max(1, min(-(-tasks // units), -(-anchors.count() // settings.anchor_rows)))
    here = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(0).alias("asks"), F.expr(f"cast(block div {held} as int)").alias("unit"))
    asked = _sets(anchors, shape, shares, settings).select("*", F.explode(F.sequence(F.lit(0), F.lit(units - 1))).alias("unit"))
    met = here.drop("block").unionByName(asked, allowMissingColumns=True).withColumn("task", F.col("unit") * shares + F.col("share"))
    met = met.repartitionById(units * shares, "task").sortWithinPartitions("asks").drop("task", "unit", "share")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks_here = []
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                if not row["asks"]:
                    blocks_here.append(_rows_of(row, shape))
                elif blocks_here:
                    yield _best(row, blocks_here, shape, order, same, take, settings.chunk)
    best = Window.partitionBy("uid", "place").orderBy(F.desc("score"), "id")
    found = met.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= take)
    return stored(found, "negatives-found", free_shuffles=True)


def _lowered(anchors: DataFrame, windows: list[Callable[[], Column]], search: Callable[[DataFrame], DataFrame], take: int) -> DataFrame:
    """Search with the first thresholds; windows that are not full are searched again with the next, the last ones reaching the
    windows' ends. ``anchors`` has one row a window, with its ``place``."""
    found, left = None, anchors
    for number, least in enumerate(windows):
        last = number == len(windows) - 1
        grouped = left.withColumn("window", F.struct("place", least().alias("least"), "most")) \
            .groupBy("uid").agg(F.first("id").alias("id"), F.first("label").alias("label"), F.first("q").alias("q"), F.collect_list("window").alias("windows"))
        seen = search(stored(grouped, "negatives-anchors"))
        if last:
            done = seen
        else:
            full = seen.groupBy("uid", "place").count().where(F.col("count") >= take).select("uid", "place")
            done = seen.join(full, ["uid", "place"])
            left = stored(left.join(full, ["uid", "place"], "left_anti"), "negatives-left")
        found = done if found is None else found.unionByName(done)
        if not last and left.isEmpty():
            break
    return found


def mine(df: DataFrame, anchor: Column, id: str = "vec_id", vector: str = "embedding", label: Column | str = "label", settings: Settings = Settings()) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows of ``df`` where ``anchor`` holds."""
    label = df[label] if isinstance(label, str) else label
    rows = df.where(finite(df[vector])).select(
        df[id].cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.transform(df[vector].cast("array<double>"), lambda x: F.floor(x * float(settings.scale))).alias("q")).where("id IS NOT NULL AND label IS NOT NULL")
    rows = stored(rows.distinct().withColumn("uid", F.monotonically_increasing_id()), "negatives-rows")
    blocks, shape = _packed(rows, settings)
    energy = rows.select(F.posexplode("q").alias("k", "v")).groupBy("k").agg(F.sum(F.col("v").cast("double") * F.col("v")).alias("e")).collect()
    n = rows.count()
    power = np.zeros(shape.dims)
    for r in energy:
        power[r.k] = r.e
    order, typical = np.argsort(-power, kind="stable"), float(np.sqrt(power.sum() / max(n, 1)))

    def searching(same: bool, take: int) -> Callable[[DataFrame], DataFrame]:
        return lambda anchors: _search(anchors, blocks, shape, order, same, take, settings)

    whole = F.lit(NEVER).cast("long")
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, v: s + v.cast("double") * v))
    anchors = rows.where("anchor").select("uid", "id", "label", "q", F.lit(0).alias("place"), F.lit((1 << 63) - 1).cast("long").alias("most"))
    positives = _lowered(anchors, [*[lambda f=f: F.ceil(norm * (f * typical)).cast("long") for f in settings.levels], lambda: whole],
                         searching(True, settings.positives), settings.positives)
    opened = positives.select("uid", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("place")) \
        .join(anchors.select("uid", "id", "label", "q"), "uid") \
        .withColumn("end", F.expr(f"({settings.low}L * positive_score + 99) div 100")).withColumn("most", F.expr(f"({settings.high}L * positive_score) div 100"))
    opened = stored(opened.where((F.col("positive_score") >= 0) & (F.col("end") <= F.col("most"))), "negatives-windows")
    wide = F.col("most") - F.col("end")
    negatives = _lowered(opened, [*[lambda f=f: F.col("end") + F.floor(wide * f).cast("long") for f in settings.depths], lambda: F.col("end")],
                         searching(False, settings.negatives), settings.negatives)
    return negatives.select("uid", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")) \
        .join(opened.select("uid", "place", F.col("id").alias("anchor_id"), "positive_id", "positive_score"), ["uid", "place"]) \
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
