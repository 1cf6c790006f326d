"""Embedding near-dedup: an exact join of unit vectors by subspace pigeonhole.

cos >= COSINE means a squared distance of at most 2 - 2 COSINE. Vectors are rotated by an orthogonal matrix and
split into blocks; a pair within the whole budget is, in some block, within that block's share of it (in proportion to
the block's width). Each block is a range join on a grid over its leading axes: a vector has one home cell
and probes the cells that its ball of the block's radius touches. Homes and probes meet in groups of bounded homes (large
cells are salted from counts over all vectors, probes are streamed); candidates are verified at once on the whole
vectors in double precision and counted in the first block that finds them, so pairs are never emitted: a group
yields link counts and a spanning forest.

The rotation and the shape of the grid are fitted to a sample of at most FIT vectors, drawn by hash: principal axes are
dealt to the blocks in turn, so that each block has its share of the spread on its leading axes, and of several numbers of
blocks and axes the one is taken that should cost least. They bear on the work only: every vector is joined, whatever the
sample holds. Where the spread lies in few axes, few of the pairs meet. Vectors that are spread alike over many axes
can't be told apart by any few of them: the work then stays in proportion to the square, and the fit keeps its factor small.

Equal vectors are collapsed before the join and weigh as many as they are. Cases: vectors that are null, empty, zero
or hold null or non-finite components link with nothing; vectors of different lengths don't link; a null vec_id is
the lowest id and is given back as null; repeated rows are copies of a vector; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, written
from .graph import connected_components

COSINE = 0.9
#: Vectors of a length that the rotation and the grid are fitted to, at most; with fewer than the second a plain grid is taken.
FIT, FIT_LEAST = 1024, 32
#: Tables of cells are broadcast up to so many rows.
BROADCAST_CELLS = 200_000
#: Home vectors of a group, about; probes are streamed past them.
HOMES = 8192
_PROBES = 512
_NULL_ID = -(2**63)
_SLACK = 1e-5
_FIXED = float(1 << 23)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, by their largest component first."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def fixed(turn: np.ndarray) -> np.ndarray:
    """A matrix in whole numbers."""
    return np.rint(turn * _FIXED)


def rotated(u: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Unit vectors rotated in fixed point: products and sums of whole numbers are exact in any order, so every group sees the same coordinates."""
    return (np.rint(u * _FIXED) @ turn) / (_FIXED * _FIXED)


def blocks(dim: int, n: int) -> list[slice]:
    edges = [dim * i // n for i in range(n + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


@dataclass
class Grid:
    """How vectors of one length are rotated, split and put into cells."""

    turn: np.ndarray
    parts: list[slice]
    #: Each block's radius: the root of its share of the squared distance.
    radii: list[float]
    #: Axes of a block that the cells divide, and the widths of the cells: the radius.
    axes: int

    @classmethod
    def plain(cls, dim: int, cosine: float) -> Grid:
        """Without knowledge of the vectors."""
        q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
        return cls.of(q * np.sign(np.diag(r)), 2 if dim > 3 else 1, 1, cosine)

    @classmethod
    def of(cls, turn: np.ndarray, n: int, axes: int, cosine: float) -> Grid:
        dim = len(turn)
        parts = blocks(dim, n)
        return cls(fixed(turn), parts, [math.sqrt((2 - 2 * cosine) * (b.stop - b.start) / dim) + _SLACK for b in parts], axes)

    @classmethod
    def fitted(cls, u: np.ndarray, total: int, cosine: float) -> Grid:
        """The cheapest for `total` vectors of which the rows of `u` are a sample."""
        dim = u.shape[1]
        if len(u) < FIT_LEAST or dim < 4:
            return cls.plain(dim, cosine)
        _, principal = np.linalg.eigh(np.cov(u.T))
        principal = principal[:, ::-1]
        best = None
        for n in (2**k for k in range(1, 7) if dim >> k >= 2):
            # block b gets every n-th axis, so that spreads are alike; slices may differ by one in width
            order = sorted(range(dim), key=lambda i, n=n: (i % n, i))
            widths = [len(range(b, dim, n)) for b in range(n)]
            turn = principal[:, order]
            for axes in (1, 2, 3):
                grid = cls.of(turn, n, axes, cosine)
                grid.parts = [slice(sum(widths[:b]), sum(widths[: b + 1])) for b in range(n)]
                grid.radii = [math.sqrt((2 - 2 * cosine) * w / dim) + _SLACK for w in widths]
                cost = grid.cost(u, total)
                if best is None or cost < best[0]:
                    best = cost, grid
        return best[1]

    def cost(self, u: np.ndarray, total: int) -> float:
        """Nanoseconds, about: pairs that meet in each block, candidates that are verified, and rows that are sent."""
        x, pairs, rows, candidates = rotated(u, self.turn), 0.0, 0.0, 0.0
        every = total * total / 2
        for part, radius in zip(self.parts, self.radii, strict=True):
            width = part.stop - part.start
            y = x[:, part.start : part.start + min(self.axes, width)]
            cell = np.floor(y / radius)
            gap = sum(np.maximum(np.maximum(cell[None, :, a] * radius - y[:, None, a], y[:, None, a] - (cell[None, :, a] + 1) * radius), 0) ** 2 for a in range(y.shape[1]))
            meet = float((gap <= radius * radius).mean())
            near = x[:, part]
            squares = (near * near).sum(1)
            d = squares[:, None] + squares[None, :] - 2 * near @ near.T
            pairs += every * meet * (0.6 + width / 40)
            candidates += every * max(float((d <= radius * radius).mean()) - 1 / len(u), 0)
            steps = 1 + (3 ** y.shape[1] - 1) / 2 * 0.7
            rows += total * (1 + max(steps, meet * total / 2 / HOMES))
        return pairs + 150 * candidates + rows * (1500 + 16 * u.shape[1])


def _matrix(column: pa.ListArray, rows: slice | None = None) -> np.ndarray:
    """Lists of one length as a matrix."""
    column = column if rows is None else column.slice(rows.start, rows.stop - rows.start)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _cells(grids: dict[int, Grid], cosine: float, probing: bool):
    """The home cell of each vector in each block, or the cells that it probes: its own and the later ones (same: whether it is its own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[np.ndarray, ...]] = []
            lens = b["v"].value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lens).tolist():
                rows = np.flatnonzero(lens == dim)
                grid = grids.get(dim) or Grid.plain(dim, cosine)
                x = rotated(unit(_matrix(b["v"].take(pa.array(rows)))), grid.turn)
                for k, (block, radius) in enumerate(zip(grid.parts, grid.radii, strict=True)):
                    axes = min(grid.axes, block.stop - block.start)
                    y = x[:, block.start : block.start + axes]
                    home = np.floor(y / radius).astype(np.int64)
                    steps = [(0,) * axes]
                    if probing:
                        steps += [s for s in np.ndindex(*[3] * axes) if s > (1,) * axes]
                    for n, step in enumerate(steps):
                        cell = home + (np.array(step) - 1 if n else 0)
                        gap = np.maximum(np.maximum(cell * radius - y, y - (cell + 1) * radius), 0)
                        near = np.flatnonzero((gap * gap).sum(axis=1) <= radius * radius * (1 + 1e-9))
                        code = np.zeros(len(near), np.int64)
                        for a in range(axes):
                            code = code * 100_003 + cell[near, a]
                        out.append((rows[near], np.full(len(near), dim), np.full(len(near), k), code, np.full(len(near), n == 0)))
            i, dim, k, code, same = (np.concatenate(c) for c in (zip(*out, strict=True) if out else [[np.zeros(0)]] * 5))
            take = pa.array(i.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(dim.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(code.astype(np.int64)), pa.array(same.astype(bool)), b["rep"].take(take), b["copies"].take(take), b["v"].take(take)],
                names=["dim", "block", "cell", "same", "rep", "copies", "v"],
            )

    return run


class _Group:
    """The homes of one group, and the links that probes find with them."""

    def __init__(self, grid: Grid, block: int, cosine: float, ids: np.ndarray, copies: np.ndarray, v: np.ndarray):
        self.block, self.cosine, self.parts, self.limits, self.turn = block, cosine, grid.parts, grid.radii, grid.turn
        self.ids, self.copies, self.u = ids, copies, unit(v)
        self.r = rotated(self.u, self.turn)
        self.near = self.r[:, self.parts[block]].astype(np.float32)
        self.squares = (self.near * self.near).sum(1)

    def meet(self, ids: np.ndarray, copies: np.ndarray, same: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Linked (probe id, home id, probe copies, home copies)."""
        p = unit(v)
        r = rotated(p, self.turn)
        near = r[:, self.parts[self.block]].astype(np.float32)
        d = near @ (self.near.T * -2)
        d += self.squares
        d += (near * near).sum(1)[:, None]
        i, j = np.nonzero(d <= self.limits[self.block] ** 2 + 1e-4)
        keep = ~same[i] | (ids[i] > self.ids[j])
        i, j = i[keep], j[keep]
        found = []
        for k in range(0, len(i), 50_000):
            a, c = i[k : k + 50_000], j[k : k + 50_000]
            ok = np.einsum("ij,ij->i", p[a], self.u[c]) >= self.cosine
            a, c = a[ok], c[ok]
            for e in range(self.block + 1):  # in the first block that finds the pair
                gap = r[a, self.parts[e]] - self.r[c, self.parts[e]]
                ok = ((gap * gap).sum(1) <= self.limits[e] ** 2) == (e == self.block)
                a, c = a[ok], c[ok]
            found.append((a, c))
        a, c = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        return ids[a], self.ids[c], copies[a], self.copies[c]


def _join(grids: dict[int, Grid], cosine: float):
    """Groups sorted by key, homes before probes. Yields (u, v, n): n links counted for u, or u joined to v; without u, n
    pairs that were compared."""
    names = ("dim", "block", "cell", "salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, homes, group = None, [], None
        for b in batches:
            keys = np.stack([b[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in names] + [b["probe"].to_numpy(zero_copy_only=False).astype(np.int64)], axis=1)
            ids, copies = (b[c].to_numpy(zero_copy_only=False) for c in ("rep", "copies"))
            same = b["same"].to_numpy(zero_copy_only=False)
            cuts = (np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()
            counted, joined, compared = [], [], 0
            for i, j in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if i == j:
                    continue
                if tuple(keys[i, :4]) != key:
                    key, homes, group = tuple(keys[i, :4]), [], None
                if not keys[i, 4]:
                    homes.append((ids[i:j], copies[i:j], _matrix(b["v"], slice(i, j))))
                    continue
                if not homes:
                    continue
                group = group or _Group(grids.get(int(key[0])) or Grid.plain(int(key[0]), cosine), int(key[1]), cosine, *(np.concatenate(x) for x in zip(*homes, strict=True)))
                for k in range(i, j, _PROBES):
                    at = slice(k, min(k + _PROBES, j))
                    compared += (at.stop - at.start) * len(group.ids)
                    p, h, pc, hc = group.meet(ids[at], copies[at], same[at], _matrix(b["v"], at))
                    if len(p):
                        counted += [(p, hc), (h, pc)]
                        joined.append(_forest(p, h))
                if sum(len(x[0]) for x in counted) > 500_000:
                    yield _links(counted, joined)
            yield _links(counted, joined, compared)

    return run


def _links(counted: list, joined: list, compared: int = 0) -> pa.RecordBatch:
    if counted:
        ids, at = np.unique(np.concatenate([c[0] for c in counted]), return_inverse=True)
        n = np.bincount(at, np.concatenate([c[1] for c in counted]).astype(np.float64)).astype(np.int64)
        u, v = (np.concatenate(x) for x in zip(*joined, strict=True))
        u, v = _forest(u, v)
    else:
        ids = n = u = v = np.zeros(0, np.int64)
    counted.clear()
    joined.clear()
    kind = np.repeat([0, 1, 2], [1, len(ids), len(u)])
    us = pa.array(np.concatenate([[0], ids, u]).astype(np.int64), mask=kind == 0)
    vs = pa.array(np.concatenate([[0], ids, v]).astype(np.int64), mask=kind < 2)
    return pa.RecordBatch.from_arrays([us, vs, pa.array(np.concatenate([[compared], n, np.zeros(len(u), np.int64)]).astype(np.int64))], names=["u", "v", "n"])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links: each linked id with the smallest of its tree."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]


def fitted_grids(named: DataFrame, cosine: float) -> dict[int, Grid]:
    """A grid for each length of which a sample of the vectors holds enough."""
    totals = named.groupBy(F.size("v").alias("dim")).count().orderBy(F.col("count").desc()).limit(16).collect()
    grids = {}
    for dim, total in totals:
        some = named.where(F.size("v") == dim).orderBy(F.xxhash64("v"), "rep").select("v").limit(FIT).toArrow()["v"].combine_chunks()
        grids[dim] = Grid.fitted(unit(_matrix(some)), total, cosine)
    return grids


def near_vectors(named: DataFrame, cosine: float = COSINE) -> DataFrame:
    """u, v, n as `_join` yields them, of different vectors `v` that are named by `rep` and stand for `copies` each; written."""
    kind = named.schema["v"].dataType.simpleString()
    grids = fitted_grids(named, cosine)
    cells = f"dim int, block int, cell long, same boolean, rep long, copies long, v {kind}"
    homes = named.mapInArrow(_cells(grids, cosine, False), cells)
    salts = homes.groupBy("dim", "block", "cell").count().select("dim", "block", "cell", F.ceil(F.col("count") / HOMES).cast("int").alias("salts"))
    salts = written(salts, "vector-cells")
    salts = F.broadcast(salts) if salts.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS else salts
    own = F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int")
    homes = homes.join(salts, ["dim", "block", "cell"]).withColumn("salt", own)
    # within its own cell a vector meets the salts up to its own, and in that one the lower ids
    last = F.when(F.col("same"), own).otherwise(F.col("salts") - 1)
    probes = named.mapInArrow(_cells(grids, cosine, True), cells).join(salts, ["dim", "block", "cell"]).withColumn("salt", F.explode(F.sequence(F.lit(0), last)))
    probes = probes.withColumn("same", F.col("same") & (F.col("salt") == own))
    keys = ["dim", "block", "cell", "salt"]
    cols = [*keys, "probe", "same", "rep", "copies", "v"]
    both = homes.withColumn("probe", F.lit(False)).select(cols).unionByName(probes.withColumn("probe", F.lit(True)).select(cols))
    return written(both.repartition(*keys).sortWithinPartitions(*keys, "probe").mapInArrow(_join(grids, cosine), "u long, v long, n long"), "vector-links")


def embedding_report(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors` (vec_id, embedding)."""
    ship(vectors.sparkSession)
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    value = F.col("embedding").cast(kind)
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce((F.size(value) > 0) & ~bad & F.exists(value, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.coalesce("vec_id", F.lit(_NULL_ID)).alias("id"), F.when(usable, value).cast(kind).alias("v"))
    rows = written(rows.withColumn("key", F.when(F.col("v").isNotNull(), F.sha2(F.to_json(F.struct("v")), 256))), "vectors")
    groups = rows.where("v IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.any_value("v").alias("v"))
    # a number for each distinct vector; written, it stays the same
    groups = written(groups.withColumn("node", F.monotonically_increasing_id()), "vector-groups")
    found = near_vectors(groups.select(F.col("node").alias("rep"), "copies", "v"), cosine)
    links = found.where("u IS NOT NULL AND v IS NULL").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("others"))
    roots = connected_components(found.where("v IS NOT NULL").select("u", "v"), "vector-forest")
    table = groups.select("key", "rep", "copies", "node").join(links, "node", "left").join(roots, "node", "left")
    table = written(table.withColumn("root", F.coalesce("root", "node")), "vector-roots")
    lowest = table.groupBy("root").agg(F.min("rep").alias("component"))
    table = table.join(lowest, "root").select("key", "component", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("id", "key").join(table, "key", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.when(F.col("id") != _NULL_ID, F.col("id")).alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(component != _NULL_ID, component).alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )
