"""Approximate nearest neighbours by cosine: a neighbour graph from NN-descent, searched greedily.

**Nodes** are the distinct vectors; copies are members of one node. Walking uses codes, vectors rounded to one byte a component; results are
scored on the original vectors in double precision.

**Building.** A first graph comes from small cells: two random dealings, which connect it, and ``trees`` dealings by random hyperplanes. Cells larger than ``leaf`` are
cut by a hash, so each is compared inside one task of bounded size. Then rounds of neighbours of neighbours: every link u - v sends u to v, where v's
own neighbours w are; pairs u, w that beat the worst neighbour of either go on, and each node keeps its ``degree`` best. Each round is joins and grouped
aggregates over links, whose number is fixed by the nodes: a node that many name gets more rows, not more pairs each. Rounds end once fewer than ``settled`` of all links are new.

**Search.** A query starts at its own node and holds the ``beam`` nearest nodes seen. Each round follows the links of all nodes of the beam that were
not yet followed, for all queries at once, until nothing in any beam is left to follow.

All rows are indexed. Recall against brute force is tested, and in the README.

Cases: rows without id or vector, of a null, NaN or infinite component, or with only zeros take no part; vectors of different length count
as filled up with zeros; rows equal in id and vector count once; rows of the query's own id are not its neighbours; ties go to the smaller id; with
fewer rows than neighbours asked for, all are returned; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from ebbmark.llm.common import finite
from ebbmark.session import stored


@dataclass(frozen=True)
class Settings:
    degree: int = 24
    trees: int = 12
    leaf: int = 1024
    settled: float = 0.3
    beam: int = 160
    rescored: int = 32
    neighbours: int = 5
    seed: int = 42


@dataclass(frozen=True)
class Index:
    """``rows``: id, vec, node; ``members``: node, id of the least ids of each node; ``nodes``: node, vec; ``codes``; ``cells``: node and its neighbours with codes."""

    rows: DataFrame
    members: DataFrame
    nodes: DataFrame
    codes: DataFrame
    cells: DataFrame
    dims: int
    settings: Settings


def _dense(column: pa.Array, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims))
    out[np.arange(dims) < column.value_lengths().to_numpy()[:, None]] = column.flatten().to_numpy()
    return out


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their greatest component near one: exact, and squares neither overflow nor vanish."""
    exponent = np.frexp(np.abs(x).max(axis=1, initial=0.0))[1]
    return np.ldexp(x, -exponent[:, None])


def _codes(column: pa.Array, dims: int) -> pa.Array:
    x = _scaled(_dense(column, dims))
    x = np.rint(x * (127 / np.maximum(np.abs(x).max(axis=1, initial=0.0), 0.5)[:, None])).astype(np.int8)
    return pa.array([r.tobytes() for r in x], pa.binary())


def _units(codes: list[bytes], dims: int) -> np.ndarray:
    x = np.frombuffer(b"".join(codes), np.int8).reshape(-1, dims).astype(np.float32)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of corresponding rows."""
    x, y = _scaled(x), _scaled(y)
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


EDGES = "node long, near long, sim float"


def _edges(node, near, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(near, pa.int64()), pa.array(sim, pa.float32())], names=["node", "near", "sim"])


def _first_edges(codes: DataFrame, count: int, dims: int, settings: Settings) -> DataFrame:
    """Nearest nodes inside random cells."""
    parts = max(1, -(-count // settings.leaf))
    bits = (parts - 1).bit_length()
    most, seed = max(4, 2 * settings.degree // 3), settings.seed

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).standard_normal((dims, settings.trees * bits)).astype(np.float32)
        for batch in batches:
            if not batch.num_rows or not bits:  # few nodes: a random dealing compares all
                continue
            node, code = batch.column("node"), batch.column("code")
            cell = (_units(code.to_pylist(), dims) @ planes > 0).reshape(len(node), settings.trees, bits) @ (1 << np.arange(bits))
            for tree in range(settings.trees):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), tree), pa.int32()), pa.array(cell[:, tree], pa.int64()), node, code],
                                                 names=["tree", "cell", "node", "code"])
    at_random = codes.select(F.explode(F.array(F.lit(-1), F.lit(-2))).alias("tree"), "node", "code") \
        .select("tree", F.pmod(F.xxhash64("node", "tree"), F.lit(parts)).alias("cell"), "node", "code")
    cells = stored(codes.mapInArrow(dealt, "tree int, cell long, node long, code binary").unionByName(at_random), "graph-cells")
    sizes = cells.groupBy("tree", "cell").agg(F.count("*").alias("size"))
    cut = cells.join(sizes, ["tree", "cell"]).withColumn(
        "part", F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("size") / settings.leaf)).cast("int")).drop("size")

    def inside(table: pa.Table) -> pa.Table:
        node, k = table.column("node").to_numpy(), min(most, table.num_rows - 1)
        x = _units(table.column("code").to_pylist(), dims)
        sim = x @ x.T
        np.fill_diagonal(sim, -2)
        near = np.argpartition(-sim, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(node), 0), np.int64)
        return pa.Table.from_batches([_edges(np.repeat(node, k), node[near].ravel(), np.take_along_axis(sim, near, 1).ravel())])
    return cut.groupBy("tree", "cell", "part").applyInArrow(inside, EDGES)


def _kept(edges: DataFrame, settings: Settings) -> DataFrame:
    """``node, links``: the best links of each node, an array of (sim, near, old), best first. Links that were held before have ``old``."""
    one = edges.repartition("node").groupBy("node", "near").agg(F.max("sim").alias("sim"), F.max("old").alias("old"))
    return one.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("sim", "near", "old")), asc=False), 1, settings.degree).alias("links"))


def _meetings(graph: DataFrame, codes: DataFrame, dims: int, settings: Settings) -> DataFrame:
    """One round: better links among neighbours of neighbours."""
    worst = F.when(F.size("links") < settings.degree, F.lit(-2.0)).otherwise(F.element_at("links", -1)["sim"]).cast("float")
    here = graph.join(codes, "node").select("node", "code", worst.alias("worst"), "links")
    links = here.select("node", "code", "worst", F.explode("links.near").alias("near"))
    askers = links.select(F.col("near").alias("at"), F.lit(1).alias("asks"), "node", "code", "worst")
    members = links.select(F.col("node").alias("at"), "near").join(here.select(F.col("node").alias("near"), "code", "worst"), "near") \
        .select("at", F.lit(0).alias("asks"), F.col("near").alias("node"), "code", "worst")
    met = askers.unionByName(members).repartition("at").sortWithinPartitions("at", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names, codes, bars = None, np.zeros(0, np.int64), np.zeros((0, dims), np.float32), np.zeros(0, np.float32)
        for batch in batches:
            if not batch.num_rows:
                continue
            at, asks, node, bar = (batch.column(c).to_numpy() for c in ("at", "asks", "node", "worst"))
            x = _units(batch.column("code").to_pylist(), dims)
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            found = []
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(at)]):
                if own != at[i]:
                    own, names, codes, bars = at[i], node[:0], x[:0], bar[:0]
                split = i + int((asks[i:j] == 0).sum())  # a node's own neighbours come first and stay, askers pass
                if split > i:
                    names, codes, bars = (np.concatenate(p) for p in ((names, node[i:split]), (codes, x[i:split]), (bars, bar[i:split])))
                if split == j or not len(names):
                    continue
                sim = x[split:j] @ codes.T
                other = node[split:j, None] != names
                a, b = np.nonzero((sim > bar[split:j, None]) & other)
                found.append((node[split + a], names[b], sim[a, b]))
                a, b = np.nonzero((sim > bars) & other)
                found.append((names[b], node[split + a], sim[a, b]))
            if found:
                yield _edges(*(np.concatenate(p) for p in zip(*found)))
    return met.mapInArrow(run, EDGES)


def build(df: DataFrame, id: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()) -> Index:
    vec = df[vector].cast("array<double>")
    rows = df.where(finite(df[vector]) & F.exists(vec, lambda x: x != 0)).select(df[id].cast("long").alias("id"), vec.alias("vec")).where("id IS NOT NULL").distinct()
    rows = stored(rows.withColumn("uid", F.monotonically_increasing_id()), "graph-rows")
    by_vector = Window.partitionBy("vec").orderBy("id", "uid")
    some = stored(rows.withColumn("place", F.row_number().over(by_vector)).withColumn("node", F.first("uid").over(by_vector.rowsBetween(Window.unboundedPreceding, 0)))
                  .where(F.col("place") <= settings.neighbours + 1).select("node", "id", "vec", "place"), "graph-members")
    nodes = some.where("place = 1").select("node", "vec")
    count, dims = nodes.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), _codes(batch.column("vec"), dims)], names=["node", "code"])
    codes = stored(nodes.mapInArrow(coded, "node long, code binary"), "graph-codes")
    graph = stored(_kept(_first_edges(codes, count, dims, settings).withColumn("old", F.lit(1)), settings), "graph")
    while True:
        before = graph.select("node", F.inline("links")).withColumn("old", F.lit(1))
        graph = stored(_kept(before.unionByName(_meetings(graph, codes, dims, settings).withColumn("old", F.lit(0))), settings), "graph")
        fresh, held = graph.select(F.size(F.filter("links", lambda x: x["old"] == 0)).alias("fresh"), F.size("links").alias("held")) \
            .agg(F.coalesce(F.sum("fresh"), F.lit(0)), F.coalesce(F.sum("held"), F.lit(0))).first()
        if fresh <= settings.settled * held:
            break
    links = graph.select("node", F.explode("links.near").alias("near")).join(codes.select(F.col("node").alias("near"), "code"), "near")
    cells = links.groupBy("node").agg(F.collect_list(F.struct("near", "code")).alias("links"))
    return Index(rows, some.select("node", "id"), nodes, codes, stored(cells.select("node", "links.near", "links.code"), "graph-neighbours"), dims, settings)


def _followed(frontier: DataFrame, cells: DataFrame, dims: int) -> DataFrame:
    """``query, near, sim`` along the links of frontier nodes, where better than the worst of the query's beam."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.column("links")
            q = np.repeat(np.arange(batch.num_rows), near.value_lengths().to_numpy())
            if not len(q):
                continue
            sim = np.einsum("ij,ij->i", _units(batch.column("codes").flatten().to_pylist(), dims), _units(batch.column("code").to_pylist(), dims)[q])
            keep = sim > batch.column("worst").to_numpy()[q]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in (
                (batch.column("query").to_numpy()[q[keep]], pa.int64()), (near.flatten().to_numpy()[keep], pa.int64()), (sim[keep], pa.float32()))],
                names=["query", "near", "sim"])
    joined = frontier.join(cells, "node").select("query", "code", "worst", F.col("near").alias("links"), F.col("cell_codes").alias("codes"))
    return joined.mapInArrow(run, "query long, near long, sim float")


def _beams(index: Index, starts: DataFrame) -> DataFrame:
    """``query, beam``: for each query node, the nearest nodes found, an array of (sim, near, followed), best first."""
    s, spark = index.settings, starts.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Dealt by node once, for all rounds; rows that are lost with an executor are read again from the stored table.
    cells = index.cells.withColumnRenamed("code", "cell_codes").repartition(tasks, "node").persist(StorageLevel.MEMORY_AND_DISK)
    beams = stored(starts.select(F.col("node").alias("query"), "code", F.array(F.struct(
        F.lit(1.0).cast("float").alias("sim"), F.col("node").alias("near"), F.lit(0).alias("followed"))).alias("beam")), "graph-beams")
    while True:
        worst = F.when(F.size("beam") < s.beam, F.lit(-2.0)).otherwise(F.element_at("beam", -1)["sim"]).cast("float")
        frontier = stored(beams.select("query", "code", worst.alias("worst"), F.explode(F.filter("beam", lambda x: x["followed"] == 0)["near"]).alias("node")),
                          "graph-frontier")
        if frontier.isEmpty():
            cells.unpersist()
            return beams.select("query", "beam")
        seen = _followed(frontier.repartition(tasks, "node"), cells, index.dims).withColumn("followed", F.lit(0))
        held = beams.select("query", F.inline("beam")).withColumn("followed", F.lit(1))
        one = held.unionByName(seen, allowMissingColumns=True).repartition("query").groupBy("query", "near").agg(
            F.max("sim").alias("sim"), F.max("followed").alias("followed"))
        best = one.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(F.struct("sim", "near", "followed")), asc=False), 1, s.beam).alias("beam"))
        beams = stored(best.join(beams.select("query", "code"), "query").select("query", "code", "beam"), "graph-beams")


def search(index: Index, queries: Column) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of the index where ``queries``, over ``id``, holds."""
    s, dims = index.settings, index.dims
    asked = stored(index.rows.where(queries).select(F.col("id").alias("query_id"), "vec").join(index.nodes, "vec").select("query_id", "node"), "graph-queries")
    starts = asked.select("node").distinct().join(index.codes, "node")
    beams = _beams(index, starts)
    pairs = beams.select(F.col("query").alias("node"), F.explode(F.slice("beam", 1, s.rescored)["near"]).alias("near"))
    both = pairs.join(index.nodes.withColumnRenamed("vec", "x"), "node").join(index.nodes.select(F.col("node").alias("near"), F.col("vec").alias("y")), "near")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = cosines(_dense(batch.column("x"), dims), _dense(batch.column("y"), dims))
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("near"), pa.array(score)], names=["node", "near", "score"])
    scored = stored(both.select("node", "near", "x", "y").mapInArrow(run, "node long, near long, score double"), "graph-scores")
    listed = scored.join(index.members.select(F.col("node").alias("near"), "id"), "near")
    nearest = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "id"))
    # A query's own id may stand in the list once, or more often where rows share it with other vectors.
    few = stored(listed.groupBy("node", "id").agg(F.max("score").alias("score")).withColumn("place", nearest).where(F.col("place") <= s.neighbours + 1).drop("place"), "graph-lists")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return asked.join(few, "node").where(F.col("id") != F.col("query_id")).groupBy("query_id", "id").agg(F.max("score").alias("score")) \
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.neighbours).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
