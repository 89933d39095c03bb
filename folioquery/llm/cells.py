"""Cells of a kd-tree over stable projections, shared by the neighbour search
and the duplicate search.

A point is a unit vector, kept as ``m`` projections onto Gaussian directions
(2-stable: the difference of two points' projections is normal with their
distance as standard deviation), rounded to steps of 1/24. A tree per part splits
them at sample medians, one direction a level; its leaves are the cells. Every
point lives in one cell. A probe visits the cells in order of the probability
that they hold a neighbour at distance ``reach`` until all the others together
hold less than ``eps`` of it, whatever the shape of the tree, so the number of
cells it visits follows from the geometry and not from a cap.

Where a part has so many cells that a probe would visit many, ``Tables`` take the
tree's place: several independent ways to cut the points into cells. A point lives
in one cell of each and is compared there only; how many there are follows from the
share of neighbours that meet in none.

Distances between projections are sums of squared steps, whole numbers that are
exact in single precision.

Cells over ``block`` points are split into blocks, and their probes likewise, so
that no task has more than one block of each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 24.0  # int8 steps per unit of a projection
PROBES = 2048  # rows a task places at once; each becomes a row per cell it visits
SHIFT = 40  # a cell's number is its part and its node
BLOCKS = 1 << 15
NEVER = -(2**62)
MATCHED = "a long, b long, cut long, cell long, blk int"
ROWS = "cell long, blk int, role tinyint, id long, after long, most long, proj binary"
LOOKED, ASKS, BOTH = 0, 1, 2


def directions(dim: int, m: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed + dim).standard_normal((dim, m)).astype(np.float32)


def quantise(x: np.ndarray) -> list[bytes]:
    q = np.clip(np.rint(x * STEP), -127, 127).astype(np.int8)
    return [r.tobytes() for r in q]


def matrix(col, m: int) -> np.ndarray:
    """In steps."""
    return np.frombuffer(b"".join(col), dtype=np.int8).reshape(-1, m).astype(np.float32)


def chi2_quantile(p: float, m: int) -> float:
    """Wilson and Hilferty's approximation."""
    from statistics import NormalDist

    return m * (1 - 2 / (9 * m) + NormalDist().inv_cdf(p) * math.sqrt(2 / (9 * m))) ** 3


def rounding(m: int) -> float:
    """The most, at 99 %, that rounding adds to a squared distance in steps: m
    times 1/6, and 2.33 deviations."""
    return m / 6 + 2.33 * math.sqrt(m * 7 / 180)


def most_steps(distance2: float, m: int, tau: float) -> int:
    """The squared steps that two points at a squared distance exceed with a
    probability of at most 1 - tau: the chi-square test on projections."""
    return math.ceil(distance2 * STEP**2 * chi2_quantile(tau, m) + rounding(m))


def normal_cdf(z: np.ndarray) -> np.ndarray:
    """Abramowitz and Stegun's 7.1.26, to seven digits."""
    t = 1 / (1 + 0.3275911 * 0.7071067812 * np.abs(z))
    tail = 0.5 * t * np.exp(-0.5 * z * z) * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.where(z > 0, 1 - tail, tail)


@dataclass
class Tree:
    """Inner nodes in heap order from 1, sorted, and where they split; level
    ``l`` splits direction ``l`` (again from the first after the last). Every
    other child of an inner node is a leaf."""

    nodes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    split: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def grown(self, sample: np.ndarray, depth: int, root: int = 1) -> Tree:
        """With ``depth`` more levels below a leaf, at medians of the sample. A
        node whose rows do not differ in its direction is split all the same;
        one side stays empty."""
        level0 = root.bit_length() - 1
        node = np.full(len(sample), root, np.int64)
        nodes, split = [], []
        for level in range(depth):
            first = root << level
            order = np.argsort(node, kind="stable")
            bounds = np.searchsorted(node[order], np.arange(first, first + 2**level + 1))
            col = sample[:, (level0 + level) % sample.shape[1]]
            cut = np.zeros(2**level, np.float32)
            for i in range(2**level):
                rows = order[bounds[i] : bounds[i + 1]]
                if len(rows):
                    cut[i] = np.median(col[rows])
            nodes.append(first + np.arange(2**level))
            split.append(cut)
            node = 2 * node + (col > cut[node - first])
        every = np.concatenate([self.nodes, *nodes]).astype(np.int64)
        values = np.concatenate([self.split, *split]).astype(np.float32)
        order = np.argsort(every)
        return Tree(every[order], values[order])

    def _inner(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.nodes, node), max(0, len(self.nodes) - 1))
        return at, self.nodes[at] == node if len(self.nodes) else np.zeros(len(node), bool)

    def leaves(self) -> list[int]:
        inner = set(self.nodes.tolist())
        return [c for n in inner for c in (2 * n, 2 * n + 1) if c not in inner] or [1]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), dtype=np.int64)
        at, level = np.arange(len(x)), 0
        while len(at):
            pos, inner = self._inner(node[at])
            at, pos = at[inner], pos[inner]
            node[at] = 2 * node[at] + (x[at, level % x.shape[1]] > self.split[pos])
            level += 1
        return node

    def probe(self, x: np.ndarray, reach: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows of x and the cells each of them visits. Of unit vectors at a
        distance, with cosine c, the projections of one are normal about c times
        the other's with variance 1 - c**2 (beyond a right angle, as of unrelated
        ones); what the cells left out hold of that is less than ``eps`` in all."""
        c = np.maximum(1 - reach * reach / 2, 0.0)
        mean, sd = x * c[:, None], np.maximum(np.sqrt(1 - c * c), 1e-3) * STEP
        rest, least, out_q, out_leaf = np.arange(len(x)), eps / 8, [], []
        while len(rest):
            q, leaf, mass = self._walk(mean[rest], sd[rest], least)
            enough = np.bincount(q, mass, minlength=len(rest)) >= 1 - eps
            enough |= least * (len(self.nodes) + 1) <= eps  # all that was dropped is less than eps
            keep = enough[q]
            q, leaf, mass = q[keep], leaf[keep], mass[keep]
            order = np.lexsort((-mass, q))
            q, leaf, mass = q[order], leaf[order], mass[order]
            before, n = np.cumsum(mass) - mass, np.bincount(q, minlength=len(rest))
            keep = before - np.repeat(before[(np.cumsum(n) - n)[n > 0]], n[n > 0]) < 1 - eps
            out_q.append(rest[q[keep]])
            out_leaf.append(leaf[keep])
            rest, least = rest[~enough], least / 8
        return np.concatenate(out_q or [rest]), np.concatenate(out_leaf or [rest])

    def _walk(self, mean: np.ndarray, sd: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, the leaves with at least ``least`` of their mass, and that."""
        q = np.arange(len(mean))
        node, mass, level, out = np.ones(len(mean), dtype=np.int64), np.ones(len(mean)), 0, []
        while len(q):
            pos, inner = self._inner(node)
            out.append((q[~inner], node[~inner], mass[~inner]))
            q, node, mass, pos = q[inner], node[inner], mass[inner], pos[inner]
            left = normal_cdf((self.split[pos] - mean[q, level % mean.shape[1]]) / sd[q]) * mass
            right = mass - left
            r, lf = right >= least, left >= least
            q, node, mass = np.concatenate([q[lf], q[r]]), np.concatenate([2 * node[lf], 2 * node[r] + 1]), np.concatenate([left[lf], right[r]])
            level += 1
        return tuple(np.concatenate(c) for c in zip(*out))


@dataclass
class Tables:
    """``n`` hash tables of ``size`` cells each: in every one a point lives in the
    cell of the direction, of ``size`` random ones, that is nearest by angle. For
    points at a given cosine the chance to meet in a table depends on nothing else."""

    m: int
    size: int
    n: int = 0

    def directions(self, t: int) -> np.ndarray:
        g = np.random.default_rng([97, self.m, self.size, t]).standard_normal((self.m, self.size)).astype(np.float32)
        return g / np.linalg.norm(g, axis=0)

    def leaf(self, x: np.ndarray, t: int) -> np.ndarray:
        """Of each row of x its cell in table ``t``."""
        g = self.directions(t)
        best = [np.argmax(x[i : i + PROBES] @ g, axis=1) for i in range(0, len(x), PROBES)]
        return t * self.size + np.concatenate([np.zeros(0, np.int64), *best]).astype(np.int64)

    def all_leaves(self, x: np.ndarray) -> np.ndarray:
        """One column per table."""
        return np.stack([self.leaf(x, t) for t in range(self.n)], axis=1)

    def fitted(self, cosine: float, tau: float, eps: float, most: int, pairs: int = 8000) -> Tables | None:
        """With as many tables as are needed for less than ``eps`` of the
        neighbours at this cosine, of those that the chi-square test lets pass, to
        meet in none: counted on simulated pairs. None if ``most`` are too few."""
        rng = np.random.default_rng(self.m)
        x, z = (STEP * rng.standard_normal((pairs, self.m)).astype(np.float32) for _ in range(2))
        y = cosine * x + math.sqrt(1 - cosine * cosine) * z
        seen = ((x - y) ** 2).sum(axis=1) <= most_steps(2 - 2 * cosine, self.m, tau)
        x, y = x[seen], y[seen]
        apart = np.ones(len(x), bool)
        for t in range(most):
            apart &= self.leaf(x, t) != self.leaf(y, t)
            if apart.mean() < eps:
                return Tables(self.m, self.size, t + 1)
        return None


@dataclass
class Cells:
    """One tree per part, or tables, and of the cells over a block's size into how many
    blocks their points and probes are split."""

    m: int
    trees: dict[int, Tree | Tables]
    grid: dict[int, tuple[int, int]] = field(default_factory=dict)


def number(part: int, node):
    return (part << SHIFT) + node


def grown(trees: dict[int, Tree], points: DataFrame, m: int, leaf_size: int, sample_rows: int = 100_000, counts: dict[int, int] | None = None) -> dict[int, Tree]:
    """trees with one for every part of points that has none, fitted on at most
    about ``sample_rows`` of the new parts' points (the only bounded sample; all
    points are placed). What reaches the driver is the sample and a count per part.

    points: part int, proj binary; ``counts``: of points per part, if known"""
    if counts is None:
        counts = {r["part"]: r["n"] for r in points.groupBy("part").agg(F.count("*").alias("n")).collect()}
    counts = {p: n for p, n in counts.items() if p not in trees}
    out = trees | {p: Tree() for p in counts}
    deep = {p: math.ceil(math.log2(n / leaf_size)) for p, n in counts.items() if n > leaf_size}
    if deep:
        share = min(1.0, sample_rows / sum(counts[p] for p in deep))
        sample = points.filter(F.col("part").isin(list(deep))).select("part", "proj").sample(share, seed=7).toPandas()
        for p, depth in deep.items():
            out[p] = Tree().grown(matrix(sample.loc[sample["part"] == p, "proj"], m), depth)
    return out


def placed(points: DataFrame, trees: dict[int, Tree], m: int) -> DataFrame:
    """points (part int, proj binary and others) with their ``cell``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x, out = matrix(f["proj"], m), np.zeros(len(f), dtype=np.int64)
            for p in f["part"].unique():
                at = (f["part"] == p).to_numpy()
                out[at] = number(int(p), trees[p].leaf(x[at]))
            yield f.assign(cell=out)

    return points.mapInPandas(run, f"{', '.join(f'{c.name} {c.dataType.simpleString()}' for c in points.schema)}, cell long")


def homes(points: DataFrame, trees: dict[int, Tree | Tables], m: int) -> DataFrame:
    """points (part int, id long, proj binary) with all their ``cells``, one in a
    tree or one in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 4 * PROBES) for b in batches for i in range(0, b.num_rows, 4 * PROBES)):
            part, x = b.column(0).to_numpy(), matrix(b.column(2).to_pylist(), m)
            for p in np.unique(part):
                at, tree = np.flatnonzero(part == p), trees[int(p)]
                leaf = tree.all_leaves(x[at]) if isinstance(tree, Tables) else tree.leaf(x[at])[:, None]
                own = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * leaf.shape[1]), pa.array(number(int(p), leaf).ravel()))
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(at)).columns, own], names=["part", "id", "proj", "cells"])

    return points.select("part", "id", "proj").mapInArrow(run, "part int, id long, proj binary, cells array<long>")


def grid_of(sizes: dict[int, int], asks: dict[int, int] | None, block: int) -> dict[int, tuple[int, int]]:
    """Of cells over ``block`` points the blocks of points and of probes."""
    return {c: (math.ceil(n / block), math.ceil((n if asks is None else asks.get(c, 1)) / block)) for c, n in sizes.items() if n > block}


def gridded(home: DataFrame, cells: Cells, block: int = 16_384) -> Cells:
    """cells with the blocks of those over ``block`` of home's points (cell)."""
    big = home.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    cells.grid = grid_of({r["cell"]: r["n"] for r in big.collect()}, None, block)
    return cells


def _cut(ids: np.ndarray, n) -> np.ndarray:
    return ((ids * 2654435761) >> 7) % n


def residents(rows: DataFrame, grid: dict[int, tuple[int, int]], most: int | None = None) -> DataFrame:
    """ROWS of points (cell, id, proj) to be looked at: one for every block of
    probes. With ``most`` they also ask in their own cell, but where it has blocks."""
    role, none = F.lit(LOOKED if most is None else BOTH), F.lit(0).cast("long")
    blk: Column = F.lit(0)
    if grid:
        table = rows.sparkSession.createDataFrame([(c, r, q) for c, (r, q) in grid.items()], "cell long, rb int, qb int")
        rb = F.pmod(F.xxhash64("id"), F.col("rb"))
        role = F.when(F.col("rb").isNull(), role).otherwise(LOOKED)
        blk = F.explode(F.when(F.col("rb").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("qb") - 1), lambda q: rb * BLOCKS + q)))
        rows = rows.join(table, "cell", "left")
    rows = rows.select("cell", blk.alias("blk"), role.cast("tinyint").alias("role"), "id", none.alias("after"), F.lit(most or 0).cast("long").alias("most"), "proj")
    return rows.withColumn("blk", F.col("blk").cast("int"))


def own_asks(rows: DataFrame, grid: dict[int, tuple[int, int]], most: int) -> DataFrame:
    """ROWS of points (cell, id, proj) that ask in their own cells, of those that
    have blocks: in the others ``residents`` ask themselves."""
    table = rows.sparkSession.createDataFrame([(c, r, q) for c, (r, q) in grid.items()], "cell long, rb int, qb int")
    mine = F.pmod(F.xxhash64("id"), F.col("qb"))
    blk = F.explode(F.transform(F.sequence(F.lit(0), F.col("rb") - 1), lambda r: (r * BLOCKS + mine).cast("int")))
    return rows.join(table, "cell").select("cell", blk.alias("blk"), F.lit(ASKS).cast("tinyint").alias("role"), "id", F.lit(0).cast("long").alias("after"), F.lit(most).cast("long").alias("most"), "proj")


def further(marks: DataFrame, asks: DataFrame) -> DataFrame:
    """ROWS of the probes that go on in a cell: marks (id, cell, blk, cut) of a
    round, and what asked (id, proj, most)."""
    return marks.join(asks.select("id", "proj", "most"), "id").select("cell", "blk", F.lit(ASKS).cast("tinyint").alias("role"), "id", F.col("cut").alias("after"), "most", "proj")


def looked_at(home: DataFrame, rows: DataFrame) -> DataFrame:
    """The points of the cells that rows ask in."""
    return home.join(rows.select("cell").distinct(), "cell", "left_semi")


def probes(queries: DataFrame, cells: Cells, eps: float, offsets: tuple[int, ...] = (0,), also_home: bool = True, only_home: bool = False) -> DataFrame:
    """ROWS of queries (part int, id long, proj binary, after long, most long,
    reach double) for every cell they visit, in the parts at ``offsets`` from
    their own, and for each block of its points. Their own cell is among them
    whatever its mass. ``also_home`` false leaves it out where it has no blocks."""
    trees, grid, m = cells.trees, cells.grid, cells.m

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in (f.iloc[i : i + PROBES] for f in frames for i in range(0, len(f), PROBES)):
            x, ids, reach, parts, out_q, out_c = matrix(f["proj"], m), f["id"].to_numpy(), f["reach"].to_numpy(), f["part"].to_numpy(), [], []
            for p in np.unique(parts):
                own = np.flatnonzero(parts == p)
                for o in offsets:
                    t = int(p) + o
                    if t not in trees:
                        continue
                    q, leaf = (own[:0], own[:0]) if only_home else trees[t].probe(x[own], reach[own], eps)
                    c = number(t, leaf)
                    if o == 0:
                        home = number(t, trees[t].leaf(x[own]))
                        keep = c != home[q]
                        rest = np.arange(len(own)) if also_home else np.flatnonzero(np.isin(home, list(grid)))
                        q, c = np.concatenate([q[keep], rest]), np.concatenate([c[keep], home[rest]])
                    out_q.append(own[q])
                    out_c.append(c)
            if not out_q:
                continue
            q, c = np.concatenate(out_q), np.concatenate(out_c)
            blk = np.zeros(len(q), np.int64)
            if grid and (big := np.isin(c, list(grid))).any():
                kr, kq = (np.array([grid.get(v, (1, 1))[i] for v in c.tolist()]) for i in (0, 1))
                rep = np.repeat(np.arange(len(q)), kr)
                rb = np.arange(len(rep)) - np.repeat(np.cumsum(kr) - kr, kr)
                blk = np.where(big[rep], rb * BLOCKS + _cut(ids[q[rep]], kq[rep]), 0)
                q, c = q[rep], c[rep]
            yield pd.DataFrame({"cell": c, "blk": blk.astype(np.int32), "role": np.int8(ASKS), "id": ids[q], "after": f["after"].to_numpy()[q], "most": f["most"].to_numpy()[q], "proj": f["proj"].to_numpy()[q]})

    return queries.select("part", "id", "proj", "after", "most", "reach").mapInPandas(run, ROWS)


def hits(q: np.ndarray, r: np.ndarray, most: np.ndarray, chunk: int = 512, ends: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows with at most so many squared steps between them, by chunks
    of q, and those steps. ``ends``: how many of the first rows of r the rows of q
    ask for, ascending; a chunk leaves out what none of its rows asks for."""
    rn = np.einsum("ij,ij->i", r, r)
    right = np.concatenate([r, -0.5 * rn[:, None]], axis=1).T.copy()
    for i in range(0, len(q), chunk):
        x = q[i : i + chunk]
        qn = np.einsum("ij,ij->i", x, x)
        s = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1) @ (right if ends is None else right[:, : ends[i : i + chunk].max()])
        if not s.shape[1]:
            continue
        at = np.flatnonzero(s >= (0.5 * (qn - most[i : i + chunk]))[:, None].astype(np.float32))  # much faster than nonzero of two dimensions
        a, b = np.divmod(at, s.shape[1])
        yield a + i, b, np.rint(qn[a] - 2 * s[a, b]).astype(np.int64)


def hits_among(x: np.ndarray, most: int, limit: int = 2_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """All pairs of different rows of x as of ``hits``, both ways, of which only one
    is computed. None if there are more than ``limit``."""
    found, n, chunk = [np.zeros((3, 0), np.int64)], 0, 512
    for i in range(0, len(x), chunk):
        q = x[i : i + chunk]
        for a, b, d in hits(q, x[i:], np.full(len(q), most), chunk):
            later = b > a
            a, b, d = a[later] + i, b[later] + i, d[later]
            n += 2 * len(a)
            if n > limit:
                return None
            found += [np.stack([a, b, d]), np.stack([b, a, d])]
    a, b, d = np.concatenate(found, axis=1)
    return a, b, d


def _grouped(rows: DataFrame, m: int, pick: Callable, earlier: bool = False) -> DataFrame:
    """Call ``pick`` for the hits of the probes of each cell and block. It has the
    probes' and points' ids, the pairs' places, their steps, and ``after``; it gives
    the pairs to keep, and the marks of the lists that go on. ``earlier``: it keeps
    only points with a smaller id than the probe's."""

    def match(f: pd.DataFrame) -> pd.DataFrame:
        role = f["role"].to_numpy()
        r, q = f[role != ASKS], f[role != LOOKED]
        if earlier:
            q = q.sort_values("id", kind="stable")
        pairs, cuts = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
        if len(r) and len(q):
            rid = r["id"].to_numpy()
            order = np.argsort(rid, kind="stable")
            x, rid, qid, after, most = matrix(r["proj"], m)[order], rid[order], q["id"].to_numpy(), q["after"].to_numpy(), q["most"].to_numpy()
            among = hits_among(x, most[0]) if not earlier and (role == BOTH).all() and (most == most[0]).all() else None
            if among is not None:
                qid, after, every = qid[order], after[order], [among]
            else:
                every = hits(matrix(q["proj"], m), x, most, ends=np.searchsorted(rid, qid) if earlier else None)
            for a, b, d in every:
                for found, marks in pick(qid, rid, after, a, b, d):
                    pairs.append(found)
                    cuts.append(marks)
        p, c = np.concatenate(pairs), np.concatenate(cuts)
        none = np.ones(len(p) + len(c), bool)
        none[: len(p)] = False
        value = lambda v, hole: pd.arrays.IntegerArray(v.astype(np.int64), hole)
        zero = np.zeros(len(p), np.int64)
        place = value(np.full(len(none), f["cell"].iloc[0] if len(f) else 0), ~none)
        return pd.DataFrame({"a": np.concatenate([p[:, 0], c[:, 0]]), "b": value(np.concatenate([p[:, 1], c[:, 0]]), none), "cut": value(np.concatenate([zero, c[:, 1]]), ~none), "cell": place, "blk": np.full(len(none), f["blk"].iloc[0] if len(f) else 0, np.int32)})

    return rows.groupBy("cell", "blk").applyInPandas(match, MATCHED)


def _nth(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted a, each entry's place among its equals and their number."""
    n = np.bincount(a, minlength=a[-1] + 1)
    return np.arange(len(a)) - (np.cumsum(n) - n)[a], n[a]


def nearest(rows: DataFrame, m: int, keep: int) -> DataFrame:
    """For each probe, of the points of a cell that are not nearer than ``after``
    (in squared steps, as ``most``), the ``keep`` nearest. Where there are more, a
    row with b null has in ``cut`` the steps of the next."""

    def pick(qid, rid, after, a, b, d):
        ok = (qid[a] != rid[b]) & (d >= after[a])
        a, b, d = a[ok], b[ok], d[ok]
        if len(a):
            order = np.lexsort((d, a))
            a, b, d = a[order], b[order], d[order]
            at, _ = _nth(a)
            last = at == keep
            yield np.stack([qid[a[at < keep]], rid[b[at < keep]]], axis=1), np.stack([qid[a[last]], d[last]], axis=1)

    return _grouped(rows, m, pick)


def earlier(rows: DataFrame, m: int, keep: int) -> DataFrame:
    """For each probe, of the points of a cell with a smaller id (and one after
    ``after``), the first ``keep``. Where there are more, a row with b null has in
    ``cut`` the last id given, from which the next round goes on."""

    def pick(qid, rid, after, a, b, d):
        ok = (rid[b] < qid[a]) & (rid[b] > after[a])
        a, b = a[ok], b[ok]
        if len(a):
            at, n = _nth(a)
            last = (at == keep - 1) & (n > keep)
            yield np.stack([qid[a[at < keep]], rid[b[at < keep]]], axis=1), np.stack([qid[a[last]], rid[b[last]]], axis=1)

    return _grouped(rows, m, pick, earlier=True)
