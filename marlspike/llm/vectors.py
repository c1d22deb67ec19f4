"""Embedding near-duplicates by an epsilon grid order join.

Vectors become unit vectors; cosine >= t is then a distance of at most ``epsilon = sqrt(2 - 2t)``. A rotation onto the
principal axes of a bounded sample (``SAMPLE`` vectors by a hash of the id; it decides the speed, never the result) puts
most of the spread into the leading dimensions. Their coordinates, divided by epsilon, are the grid's cells, and the
order of the cells is the epsilon grid order. The ordered sequence is cut into blocks of ``BLOCK`` vectors with their
bounding boxes. Blocks whose cells in the first dimension are more than one apart never meet; of the others, those with
boxes further apart than epsilon are skipped. All this is done on boxes alone. Vectors travel by tiles: ``TILE`` blocks
next to each other in the order are a row, two rows are a tile, and a block goes once to each tile in which it has a
partner, so that n blocks are sent n / ``TILE`` times at most, not n times. Within a tile each pair of blocks is joined
recursively: intervals whose boxes are too far apart are skipped, large ones are halved, small ones are multiplied in
double precision. A tile's task holds the blocks of two rows.

What leaves a tile are counts and connecting labels, not links, so a dense group costs no more than a sparse
one. Equal vectors are summed up first and count with their number. Components are found over labels.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own
component; vectors of different lengths are never linked, and a cosine of exactly the threshold is a link as far as
double precision tells. Rows are told apart by vec_id: a repeated row isn't another vector, so that it is counted once
and each copy gets the same result; rows of one vec_id with different vectors count as vectors of their own. The labels
column isn't read, nor are other columns. Rows without a vec_id link with nothing, have no component and are kept. An empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, schema

COSINE = 0.9
SAMPLE = 20_000
BLOCK = 2048
TILE = 16
LEAF = 512
ORDERED = 4
BOXED = 8

BLOCKS = "part int, dim int, ids binary, many binary, vectors binary, low array<double>, high array<double>"


def epsilon(cosine: float) -> float:
    """The distance of unit vectors, with room for rounding."""
    return math.sqrt(max(0.0, 2 - 2 * cosine)) * (1 + 1e-9) + 1e-9


def rotation(sample: np.ndarray) -> np.ndarray:
    """Principal axes as columns, the widest first."""
    _, axes = np.linalg.eigh(np.cov(sample.T))
    return axes[:, ::-1]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that squares neither overflow nor vanish."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def _distance(low_a, high_a, low_b, high_b) -> float:
    """Least distance of two boxes."""
    gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    return float(np.sqrt((gap * gap).sum()))


class Side:
    """One block in a join: unit vectors, leading coordinates, ids, weights."""

    def __init__(self, ids: np.ndarray, many: np.ndarray, vectors: np.ndarray, axes: np.ndarray | None):
        self.ids, self.many, self.unit = ids, many, unit(vectors)
        self.lead = self.unit @ axes[:, :BOXED] if axes is not None else self.unit[:, :BOXED]
        self.label, self.links = ids.copy(), np.zeros(len(ids), np.int64)

    def box(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        part = self.lead[start:end]
        return part.min(axis=0), part.max(axis=0)


def join_blocks(a: Side, b: Side, cosine: float, same: bool) -> set[tuple[int, int]]:
    """Adds to the links of both sides; gives pairs of labels that belong together."""
    edges: set[tuple[int, int]] = set()
    _recurse(a, (0, len(a.ids)), b, (0, len(b.ids)), cosine, epsilon(cosine), same, edges)
    return edges


def _recurse(a: Side, ra: tuple[int, int], b: Side, rb: tuple[int, int], cosine: float, eps: float, same: bool, edges: set) -> None:
    if same and rb[1] <= ra[0] or ra[0] == ra[1] or rb[0] == rb[1]:
        return  # below the diagonal
    if _distance(*a.box(*ra), *b.box(*rb)) > eps:
        return
    la, lb = ra[1] - ra[0], rb[1] - rb[0]
    if la <= LEAF and lb <= LEAF:
        return _leaf(a, ra, b, rb, cosine, same, edges)
    halves = lambda r: ((r[0], cut := (r[0] + r[1]) // 2), (cut, r[1]))
    for x in halves(ra) if la > LEAF else (ra,):
        for y in halves(rb) if lb > LEAF else (rb,):
            _recurse(a, x, b, y, cosine, eps, same, edges)


def _leaf(a: Side, ra: tuple[int, int], b: Side, rb: tuple[int, int], cosine: float, same: bool, edges: set) -> None:
    near = a.unit[ra[0] : ra[1]] @ b.unit[rb[0] : rb[1]].T >= cosine
    if same:
        near &= np.arange(ra[0], ra[1])[:, None] < np.arange(rb[0], rb[1])[None, :]
    if not near.any():
        return
    rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    near = near[np.ix_(rows, cols)]
    rows, cols = rows + ra[0], cols + rb[0]
    a.links[rows] += near @ b.many[cols]
    b.links[cols] += a.many[rows] @ near
    x, y = a.label[rows].copy(), b.label[cols].copy()
    top = np.iinfo(np.int64).max
    while True:
        x2 = np.minimum(x, np.where(near, y[None, :], top).min(axis=1))
        y2 = np.minimum(y, np.where(near, x2[:, None], top).min(axis=0))
        if (x2 == x).all() and (y2 == y).all():
            break
        x, y = x2, y2
    edges.update((o, n) for o, n in zip(a.label[rows].tolist(), x.tolist()) if o != n)
    edges.update((o, n) for o, n in zip(b.label[cols].tolist(), y.tolist()) if o != n)
    a.label[rows] = x
    b.label[cols] = y


def near_duplicates(rows: DataFrame, cosine: float = COSINE, block: int = BLOCK, sample: int = SAMPLE, tile: int = TILE) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable), kept."""
    if not 0 < cosine <= 1:
        raise ValueError("cosine must lie in (0, 1]")
    spark = rows.sparkSession
    scratch = Scratch(spark, "vectors")
    every = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.col("vec_id").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    plain = F.transform("v", lambda x: F.when(x == 0, 0.0).otherwise(x))  # one zero
    every = every.select("vec_id", F.when(sound, plain).alias("v")).select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), F.reverse("v")).alias("h2"))
    reps = every.where("v IS NOT NULL").groupBy("h1", "h2").agg(F.min(F.struct("vec_id", "v")).alias("first"))
    holders = every.where("v IS NOT NULL").select("h1", "h2", "vec_id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("many"))
    reps = scratch.keep(reps.join(holders, ["h1", "h2"]).select("h1", "h2", "first.vec_id", "first.v", "many", F.size("first.v").alias("dim")), "distinct")

    common = reps.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim, n = (common.dim, common.n) if common else (0, 0)
    axes = None
    if n > 2 and dim > 1:
        got = reps.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()
        axes = rotation(unit(np.array([r.v for r in got])))

    stored = scratch.keep(_blocks(reps, axes, dim, n, cosine, block), "blocks")
    blocks = stored.withColumn("block", F.xxhash64("ids", "dim")).withColumn("row", F.floor(F.col("part") / tile).cast("int"))
    width = epsilon(cosine)
    ends = blocks.select("block", "row", "dim", "low", "high", F.floor(F.col("low")[0] / width).alias("first"), F.floor(F.col("high")[0] / width).alias("last"))
    a = ends.withColumn("cell", F.explode(F.sequence(F.col("first") - 1, F.col("last") + 1))).alias("a")
    b = ends.withColumn("cell", F.explode(F.sequence("first", "last"))).alias("b")
    gap = F.zip_with(F.zip_with("a.low", "b.high", lambda x, y: F.greatest(x - y, F.lit(0.0))), F.zip_with("b.low", "a.high", lambda x, y: F.greatest(x - y, F.lit(0.0))), lambda x, y: F.greatest(x, y))
    close = F.aggregate(F.transform(gap, lambda x: x * x), F.lit(0.0), lambda s, x: s + x) <= width * width
    pairs = a.join(b, (F.col("a.dim") == F.col("b.dim")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.block") <= F.col("b.block")) & close)
    spot = lambda x: F.struct(F.col(f"{x}.block").alias("block"), F.least("a.row", "b.row").alias("low_row"), F.greatest("a.row", "b.row").alias("high_row"), "a.dim")
    spots = pairs.select(F.explode(F.array(spot("a"), spot("b"))).alias("spot")).select("spot.*").distinct()

    both = spots.join(blocks.drop("dim", "part"), "block").groupBy("low_row", "high_row", "dim")
    found = scratch.keep(both.applyInPandas(_joiner(axes, dim, cosine), schema("vec_id long, links long, other long")), "found")

    scratch.drop(stored)
    links = found.where("links > 0").groupBy("vec_id").agg(F.sum("links").alias("links"))
    place = scratch.keep(connected_components(found.where("other IS NOT NULL").select(F.col("vec_id").alias("a"), F.col("other").alias("b")), scratch), "components")
    whole = reps.select("h1", "h2", "vec_id", "many").join(links, "vec_id", "left").join(place.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    whole = whole.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    out = every.select("vec_id", "h1", "h2", F.col("v").isNotNull().alias("sound")).join(whole, ["h1", "h2"], "left")
    component = F.when(F.col("sound"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("sound"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _blocks(reps: DataFrame, axes: np.ndarray | None, dim: int, n: int, cosine: float, block: int) -> DataFrame:
    """The vectors in epsilon grid order, cut into blocks with their boxes."""
    width = epsilon(cosine)

    def place(batches):
        for batch in batches:
            cells: list = [None] * batch.num_rows
            values, dims = batch.column("v").to_pylist(), batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                u = unit(np.array([values[i] for i in at]))
                lead = u @ axes[:, :ORDERED] if axes is not None and d == dim else u[:, :ORDERED]
                for i, c in zip(at, np.floor(lead / width).astype(int).tolist()):
                    cells[i] = c
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "v", "many", "dim")), pa.array(cells, pa.list_(pa.int64()))], names=["vec_id", "v", "many", "dim", "cells"])

    placed = reps.select("vec_id", "v", "many", "dim").mapInArrow(place, schema("vec_id long, v array<double>, many long, dim int, cells array<long>"))
    parts = max(1, -(-n // block))
    ordered = placed.repartitionByRange(parts, "dim", "cells", "vec_id").sortWithinPartitions("dim", "cells", "vec_id")

    def packed(rows: list[tuple], d: int):
        ids, many, vectors = (np.array(x) for x in zip(*rows))
        side = Side(ids, many, vectors, axes if d == dim else None)
        low, high = side.box(0, len(ids))
        return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([d], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids.astype(np.int64), many.astype(np.int64), vectors.astype(np.float64))), pa.array([low.tolist()]), pa.array([high.tolist()])], names=["part", "dim", "ids", "many", "vectors", "low", "high"])

    def cut(batches):
        rows: list[tuple] = []
        at = None
        for batch in batches:
            for vec, v, many, d in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "v", "many", "dim"))):
                if rows and (d != at or len(rows) == block):
                    yield packed(rows, at)
                    rows = []
                at = d
                rows.append((vec, many, v))
        if rows:
            yield packed(rows, at)

    return ordered.select("vec_id", "v", "many", "dim").mapInArrow(cut, schema(BLOCKS))


def _joiner(axes: np.ndarray | None, dim: int, cosine: float):
    """Joins the blocks of one tile: within its row, or between its two rows."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        low_row, high_row, d = map(int, key)
        sides = []
        for block, row, ids, many, vectors in sorted(group[["block", "row", "ids", "many", "vectors"]].itertuples(index=False), key=lambda x: x.block):
            sides.append((row, Side(np.frombuffer(ids, np.int64).copy(), np.frombuffer(many, np.int64).copy(), np.frombuffer(vectors, np.float64).reshape(-1, d), axes if d == dim else None)))
        edges: set[tuple[int, int]] = set()
        for i, (row, side) in enumerate(sides):
            for other_row, other in sides[i:]:
                if {row, other_row} == {low_row, high_row}:
                    edges |= join_blocks(side, other, cosine, side is other)
        out = [(side.ids[some], side.links[some]) for _, side in sides if len(some := np.flatnonzero(side.links))]
        links = pd.DataFrame({"vec_id": np.concatenate([i for i, _ in out]) if out else [], "links": np.concatenate([n for _, n in out]) if out else [], "other": None})
        pairs = np.array(sorted(edges), np.int64).reshape(-1, 2)
        return pd.concat([links, pd.DataFrame({"vec_id": pairs[:, 0], "links": 0, "other": pairs[:, 1]})]).astype({"vec_id": "Int64", "links": "Int64", "other": "Int64"})

    return run
