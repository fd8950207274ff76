"""Nearest neighbours in mixed-type tables: squared differences of numbers, 2 for each category that differs.

The reference is cut into cells of like rows. A cell has a box - ends of each number, and each
category's value if all its rows share it - and no row in it is nearer to a query than its box. A query
first meets its nearest cell, and then only the cells whose boxes are no farther than its k-th
neighbour there; both are found down the tree of cuts, whose nodes have boxes too, so few boxes are looked at. Categories are compared by a 64-bit hash of their text.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import partial, reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.io import kept

#: Reference rows of a cell, about, and cells at most; rows of the sample that says where cells are cut; queries that meet a cell in one task, about; pairs whose distances a task holds at once.
CELL_ROWS, CELLS, SAMPLE, CHUNK_ROWS, BLOCK_PAIRS = 512, 4_096, 20_000, 2_048, 2_000_000
#: Pairs whose distances are computed at once: as many as stay in a core's cache.
TILE_PAIRS = 1 << 16
#: Queries from which it is told how many meet each cell, about; no result depends on it.
COUNTED = 200_000
#: Bounds are lowered by this share before they are compared with distances, which may be rounded otherwise.
SLACK = 1e-9


def _arrays(table: pa.Table | pa.RecordBatch, n_num: int, n_cat: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and category hashes, a row a column of the table."""
    col = lambda c: table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(c).to_numpy()
    n = table.num_rows
    return np.array([col(f"n{j}") for j in range(n_num)], float).reshape(n_num, n), np.array([col(f"c{j}") for j in range(n_cat)], np.int64).reshape(n_cat, n)


@dataclass
class Cells:
    """Where cells are cut, and their boxes. A node is (column, value, left, right) or a cell's number: numbers up to the
    value and rows of the category go left. Columns from ``n_num`` on are categories."""

    n_num: int
    n_cat: int
    nodes: list = field(default_factory=list)
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    same: np.ndarray | None = None
    only: np.ndarray | None = None
    rows: np.ndarray | None = None

    @classmethod
    def cut(cls, num: np.ndarray, cat: np.ndarray, cells: int) -> Cells:
        """From a sample, largest cell first, along the column in which its rows differ most."""
        out = cls(len(num), len(cat), [None])
        n = num.shape[1] if len(num) else cat.shape[1] if len(cat) else 0
        open_, leaves = [(-n, 0, np.arange(n))], 0
        while open_:
            size, at, own = heapq.heappop(open_)
            best = out._widest(num, cat, own) if leaves + len(open_) + 1 < cells and -size > 1 else None
            if best is None:
                out.nodes[at], leaves = leaves, leaves + 1
                continue
            column, value = best
            left = num[column, own] <= value if column < out.n_num else cat[column - out.n_num, own] == value
            out.nodes[at] = (column, value, len(out.nodes), len(out.nodes) + 1)
            for side in (own[left], own[~left]):
                heapq.heappush(open_, (-len(side), len(out.nodes), side))
                out.nodes.append(None)
        return out

    def _widest(self, num: np.ndarray, cat: np.ndarray, own: np.ndarray) -> tuple | None:
        """The column with the greatest mean squared difference of two rows, and where to cut it; none if all rows are equal."""
        best = (0.0, None)
        for j in range(self.n_num):
            x = num[j, own]
            spread = 2 * x.var()
            if spread > best[0] and x.min() < x.max():
                middle = np.partition(x, (len(x) - 1) // 2)[(len(x) - 1) // 2]
                best = (spread, (j, float(middle if middle < x.max() else x[x < x.max()].max())))
        for j in range(self.n_cat):
            values, counts = np.unique(cat[j, own], return_counts=True)
            share = counts / len(own)
            spread = 2 * (1 - (share * share).sum())
            if len(values) > 1 and spread > best[0]:
                best = (spread, (self.n_num + j, int(values[counts.argmax()])))
        return best[1]

    @property
    def count(self) -> int:
        return sum(not isinstance(n, tuple) for n in self.nodes)

    def cell_of(self, num: np.ndarray, cat: np.ndarray, n: int) -> np.ndarray:
        """The cell of each of n rows."""
        split = [isinstance(x, tuple) for x in self.nodes]
        column, left, right = (np.array([x[i] if ok else -1 for x, ok in zip(self.nodes, split, strict=True)]) for i in (0, 2, 3))
        value = np.array([float(x[1]) if ok and x[0] < self.n_num else 0.0 for x, ok in zip(self.nodes, split, strict=True)])
        category = np.array([x[1] if ok and x[0] >= self.n_num else 0 for x, ok in zip(self.nodes, split, strict=True)], np.int64)
        every, at = np.arange(n), np.zeros(n, int)
        while len(inner := every[column[at] >= 0]):
            j, node = column[at[inner]], at[inner]
            number, goes = j < self.n_num, np.zeros(len(inner), bool)
            goes[number] = num[j[number], inner[number]] <= value[node[number]]
            goes[~number] = cat[j[~number] - self.n_num, inner[~number]] == category[node[~number]]
            at[inner] = np.where(goes, left[node], right[node])
        return np.array([-1 if ok else x for x, ok in zip(self.nodes, split, strict=True)])[at]

    def boxed(self, rows: list) -> Cells:
        """With the boxes of all rows: a row a cell of (cell, rows, ends of each column)."""
        n = self.count
        self.low, self.high = np.full((self.n_num, n), np.inf), np.full((self.n_num, n), -np.inf)
        self.same, self.only, self.rows = np.zeros((self.n_cat, n), bool), np.zeros((self.n_cat, n), np.int64), np.zeros(n, np.int64)
        for r in rows:
            c = r["cell"]
            self.rows[c] = r["rows"]
            for j in range(self.n_num):
                self.low[j, c], self.high[j, c] = r[f"low_n{j}"], r[f"high_n{j}"]
            for j in range(self.n_cat):
                self.same[j, c], self.only[j, c] = r[f"low_c{j}"] == r[f"high_c{j}"], r[f"low_c{j}"]
        return self

    def bounds(self, num: np.ndarray, cat: np.ndarray, n: int) -> np.ndarray:
        """Least squared distance of each of n rows to each cell's box; infinite for an empty cell."""
        tree = self.tree()
        leaves = np.flatnonzero(tree.cell >= 0)
        every = leaves[np.argsort(tree.cell[leaves])]
        return tree.bounds(num, cat, np.repeat(np.arange(n), len(every)), np.tile(every, n)).reshape(n, len(every))

    def tree(self) -> Tree:
        """The nodes with their boxes, each of which spans those of its cells."""
        cell = np.array([-1 if isinstance(x, tuple) else x for x in self.nodes])
        left, right = (np.array([x[i] if isinstance(x, tuple) else -1 for x in self.nodes]) for i in (2, 3))
        depth, n, leaf = np.zeros(len(cell), int), len(cell), cell >= 0
        for at in np.flatnonzero(~leaf):  # parents come before their children
            depth[left[at]] = depth[right[at]] = depth[at] + 1
        low, high = np.full((self.n_num, n), np.inf), np.full((self.n_num, n), -np.inf)
        same, only, filled = np.zeros((self.n_cat, n), bool), np.zeros((self.n_cat, n), np.int64), np.zeros(n, bool)
        low[:, leaf], high[:, leaf], same[:, leaf], only[:, leaf], filled[leaf] = self.low[:, cell[leaf]], self.high[:, cell[leaf]], self.same[:, cell[leaf]], self.only[:, cell[leaf]], self.rows[cell[leaf]] > 0
        for level in range(depth.max() - 1, -1, -1):
            at = np.flatnonzero((depth == level) & ~leaf)
            a, b = left[at], right[at]
            low[:, at], high[:, at], filled[at] = np.minimum(low[:, a], low[:, b]), np.maximum(high[:, a], high[:, b]), filled[a] | filled[b]
            same[:, at] = np.where(filled[a] & filled[b], same[:, a] & same[:, b] & (only[:, a] == only[:, b]), np.where(filled[a], same[:, a], same[:, b]))
            only[:, at] = np.where(filled[a], only[:, a], only[:, b])
        return Tree(cell, left, right, low, high, same, only, filled)


@dataclass
class Tree:
    """Nodes of ``Cells`` as arrays: number of the cell (-1: none), children, box, and whether any row is in it."""

    cell: np.ndarray
    left: np.ndarray
    right: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: np.ndarray
    only: np.ndarray
    filled: np.ndarray

    def bounds(self, num: np.ndarray, cat: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Least squared distance of row q[i] to the box of node at[i]; infinite for an empty node. A child's is never below its parent's."""
        out = np.zeros(len(q))
        for x, low, high in zip(num, self.low, self.high, strict=True):
            v = x[q]
            gap = np.maximum(np.maximum(low[at] - v, v - high[at]), 0.0)
            out += gap * gap
        for x, same, only in zip(cat, self.same, self.only, strict=True):
            out += 2.0 * (same[at] & (x[q] != only[at]))
        return np.where(self.filled[at], out * (1 - SLACK), np.inf)

    def nearby(self, num: np.ndarray, cat: np.ndarray, n: int) -> np.ndarray:
        """For each of n rows the least squared distance to the box of a cell near it: down the tree, always to the nearer child."""
        every, at = np.arange(n), np.zeros(n, int)
        while len(inner := every[self.cell[at] < 0]):
            a, b = self.left[at[inner]], self.right[at[inner]]
            at[inner] = np.where(self.bounds(num, cat, inner, b) < self.bounds(num, cat, inner, a), b, a)
        return self.bounds(num, cat, every, at)

    def within(self, num: np.ndarray, cat: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(row, cell) of all cells whose boxes are no farther than the row's limit, by row, the nearest first; None
        if more than one row's pairs have to be held at once and are too many. Nodes beyond the limit are not opened."""
        q, at, found = np.arange(len(limit)), np.zeros(len(limit), int), []
        while len(q):
            bound = self.bounds(num, cat, q, at)
            near = (bound <= limit[q]) & np.isfinite(bound)
            leaf = self.cell[at] >= 0
            found.append((q[near & leaf], self.cell[at[near & leaf]], bound[near & leaf]))
            q, at = q[near & ~leaf], at[near & ~leaf]
            if len(limit) > 1 and 2 * len(q) + sum(len(f[0]) for f in found) > BLOCK_PAIRS:
                return None
            q, at = np.concatenate([q, q]), np.concatenate([self.left[at], self.right[at]])
        r, c, bound = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((c, bound, r))
        return r[order], c[order]


def _with_cell(batches, cells: Cells):
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells.cell_of(*_arrays(b, cells.n_num, cells.n_cat), b.num_rows), pa.int32())], [*b.schema.names, "cell"])


def _first_cells(bound: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The cells that each query meets first: in order of their bounds, until they hold k rows. Only where the nearest does not, cells are sorted."""
    nearest = bound.argmin(axis=1)
    first = np.zeros(bound.shape, bool)
    first[np.arange(len(bound)), nearest] = True
    few = np.flatnonzero(rows[nearest] < k)
    order = np.argsort(bound[few], axis=1, kind="stable")
    meets = np.zeros(order.shape, bool)
    np.put_along_axis(meets, order, np.cumsum(rows[order], axis=1) - rows[order] < k, axis=1)
    first[few] = meets
    return first & np.isfinite(bound)


def _met(cells: Cells, tree: Tree, num: np.ndarray, cat: np.ndarray, n: int, k: int, tau: np.ndarray | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(row, cell) of the cells that each of n rows meets first, or of the others within ``tau``; None if there are too many at once."""
    found = tree.within(num, cat, tree.nearby(num, cat, n) if tau is None else tau)
    if found is None:
        return None
    r, c = found
    first = np.ones(len(r), bool)
    first[1:] = r[1:] != r[:-1]  # the nearest cell, which is within any limit
    few = r[first & (cells.rows[c] < k)]
    more_r, more_c, step = [], [], max(1, BLOCK_PAIRS // max(cells.count, 1))
    for own in (few[i : i + step] for i in range(0, len(few), step)):  # the nearest cell holds too few rows
        at, more = np.nonzero(_first_cells(cells.bounds(num[:, own], cat[:, own], len(own)), cells.rows, k))
        more_r, more_c = [*more_r, own[at]], [*more_c, more]
    more_r, more_c = (np.concatenate([np.zeros(0, int), *x]) for x in (more_r, more_c))
    if tau is None:
        return np.concatenate([r[first & ~np.isin(r, few)], more_r]), np.concatenate([c[first & ~np.isin(r, few)], more_c])
    rest = ~first & ~np.isin(r * cells.count + c, more_r * cells.count + more_c)
    return r[rest], c[rest]


def _meetings(batches, cells: Cells, k: int, again: bool):
    """Pieces of the batches with (row, cell) of what they have to meet: their nearest cells, or (``again``) the others within ``tau``."""
    tree, step = cells.tree(), BLOCK_PAIRS
    for whole in batches:
        at = 0
        while at < whole.num_rows:
            b = whole.slice(at, step)
            met = _met(cells, tree, *_arrays(b, cells.n_num, cells.n_cat), b.num_rows, k, b.column("tau").to_numpy(zero_copy_only=False) if again else None)
            if met is None:
                step = b.num_rows // 2
                continue
            at += b.num_rows
            yield b, *met


def _visits(batches, cells: Cells, k: int, parts: np.ndarray | None, again: bool):
    """Each query once for every cell that it has to meet: its nearest, or (``again``) the others within ``tau``."""
    for b, r, c in _meetings(batches, cells, k, again):
        part = b.column("id").to_numpy()[r] % (parts[c] if parts is not None else 1)
        most = max(1, BLOCK_PAIRS // b.num_columns)  # rows of many columns that meet many cells go out a piece at a time
        for lot in (slice(i, i + most) for i in range(0, len(r), most)):
            rows = b.take(pa.array(r[lot]))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(c[lot], pa.int32()), pa.array(part[lot], pa.int32())], [*rows.schema.names, "cell", "part"])


def _met_counts(batches, cells: Cells, k: int, again: bool):
    """(cell, n): how many queries of a task meet each cell."""
    n = np.zeros(cells.count, np.int64)
    for _, _, c in _meetings(batches, cells, k, again):
        n += np.bincount(c, minlength=len(n))
    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n), pa.int32()), pa.array(n[n > 0])], ["cell", "n"])


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], values.ravel())


def _nearest(query: pa.Table, ref: pa.Table, k: int, n_num: int, n_cat: int) -> pa.Table:
    """The query rows with the k nearest reference rows of a cell, ties by id; of those with ``tau`` only the ones that have a row so near."""
    ref = ref.sort_by("id")
    rid, n, (qn, qc), (rn, rc) = ref.column("id").to_numpy(), query.num_rows, _arrays(query, n_num, n_cat), _arrays(ref, n_num, n_cat)
    dist, near = np.zeros((n, min(k, len(rid)))), np.zeros((n, min(k, len(rid))), np.int64)
    step = max(1, TILE_PAIRS // max(len(rid), 1))
    total, gap = np.zeros((min(step, n), len(rid))), np.zeros((min(step, n), len(rid)))
    for at in range(0, n, step):
        t, g = total[: n - at], gap[: n - at]
        t.fill(0.0)
        for i in range(n_num):
            np.subtract(qn[i, at : at + step, None], rn[i][None, :], out=g)
            np.multiply(g, g, out=g)
            np.add(t, g, out=t)
        for i in range(n_cat):
            t += 2.0 * (qc[i, at : at + step, None] != rc[i][None, :])
        rows = np.arange(len(t))
        for j in range(dist.shape[1]):
            place = t.argmin(axis=1)
            dist[at : at + step, j], near[at : at + step, j] = t[rows, place], rid[place]
            t[rows, place] = np.inf
    out = query.drop_columns(["cell", "part"])
    if "tau" in out.column_names:
        won = np.flatnonzero(dist[:, 0] <= out.column("tau").to_numpy()) if dist.shape[1] else np.zeros(0, int)
        out, dist, near = out.take(pa.array(won)), dist[won], near[won]
    return out.append_column("d2", _lists(dist)).append_column("near", _lists(near))


@dataclass
class Search:
    """A reference cut into cells and stored, with what it takes to look for rows in it."""

    cells: Cells
    ref: DataFrame
    names: list[str]
    k: int
    chunk_rows: int

    @classmethod
    def over(cls, ref: DataFrame, n_num: int, n_cat: int, k: int, cell_rows: int = CELL_ROWS, chunk_rows: int = CHUNK_ROWS) -> Search:
        """``ref``: (id, n0.., c0..). Of equal rows only the k least ids can be found, and only they are kept."""
        names = [*(f"n{j}" for j in range(n_num)), *(f"c{j}" for j in range(n_cat))]
        if names:
            rank = F.row_number().over(W.partitionBy(*names).orderBy("id"))
            ref = ref.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
        ref = kept(ref)
        n = ref.count()
        if not n:
            raise ValueError("no reference rows")
        sample = ref.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()  # bounded
        cells = Cells.cut(*_arrays(sample, n_num, n_cat), min(CELLS, -(-n // cell_rows)) if names else 1)
        placed = kept(ref.mapInArrow(partial(_with_cell, cells=cells), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ref.schema) + ", cell int"))
        ends = [f(c).alias(f"{e}_{c}") for c in names for f, e in ((F.min, "low"), (F.max, "high"))]
        return cls(cells.boxed(placed.groupBy("cell").agg(F.count("*").alias("rows"), *ends).collect()), placed, names, k, chunk_rows)  # a row a cell

    def visits(self, query: DataFrame, again: bool) -> DataFrame:
        """``query`` by (cell, part): cells that very many queries meet are met in parts, so that no task has them all."""
        return self._dealt(query, again)[0]

    def _dealt(self, query: DataFrame, again: bool) -> tuple[DataFrame, np.ndarray]:
        """The visits, and the number of parts of each cell, by how many of some queries meet it; all queries are dealt."""
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in query.schema) + ", cell int, part int"
        share = -(-query.count() // COUNTED)
        some = query.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0) if share > 1 else query
        counts = some.mapInArrow(partial(_met_counts, cells=self.cells, k=self.k, again=again), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        parts = np.ones(self.cells.count, np.int64)
        for r in counts.collect():  # a row a cell
            parts[r["cell"]] = -(-r["n"] * share // self.chunk_rows)
        return query.mapInArrow(partial(_visits, cells=self.cells, k=self.k, parts=parts, again=again), schema), parts

    def found(self, query: DataFrame, again: bool) -> DataFrame:
        """``query`` with (d2, near) of every cell that it meets; ``again`` only where a row is within ``tau``."""
        met, parts = self._dealt(query, again)
        parts = F.lit(parts.tolist())
        ref = self.ref.withColumn("part", F.explode(F.sequence(F.lit(0), F.get(parts, F.col("cell")).cast("int") - 1)))
        n_num = sum(c.startswith("n") for c in self.names)
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in query.schema) + ", d2 array<double>, near array<long>"
        return met.groupBy("cell", "part").cogroup(ref.groupBy("cell", "part")).applyInArrow(partial(_nearest, k=self.k, n_num=n_num, n_cat=len(self.names) - n_num), schema)


def _columns(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], id_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), *[F.col(f"`{c}`").cast("double").alias(f"n{j}") for j, c in enumerate(numeric)], *[F.xxhash64(F.col(f"`{c}`").cast("string")).alias(f"c{j}") for j, c in enumerate(categorical)])


def reference(ref: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), k: int = 1, ref_id: str = "id", cell_rows: int = CELL_ROWS, chunk_rows: int = CHUNK_ROWS) -> Search:
    """``ref`` cut into cells, to be asked by ``nearest`` as often as wanted for up to k neighbours."""
    return Search.over(_columns(ref, numeric, categorical, ref_id), len(numeric), len(categorical), k, cell_rows, chunk_rows)


def nearest(query: DataFrame, ref: DataFrame | Search, numeric: Sequence[str], categorical: Sequence[str] = (), k: int = 1, query_id: str = "id", ref_id: str = "id", cell_rows: int = CELL_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(id, d: array of the k least distances, near: ids of those rows) for each query row; ties to the smaller id.

    The reference is shuffled three times, whatever the number of queries: by equal rows, of which the k
    least ids stay, and by cell for the first and the second look. What comes to the driver is a sample and a row
    a cell, both bounded. Where boxes tell nothing (very many columns), every query meets every cell
    and the work is that of all pairs. Null numbers and categories are the caller's to fill. An empty
    reference is an error; an empty query gives no rows; queries of one id are taken for the same row.
    Equal queries are searched once. ``ref`` may be a ``reference`` of the same columns for as many neighbours or more.
    The result is stored: whatever is asked of it, rows are searched once.
    """
    search = ref if isinstance(ref, Search) else reference(ref, numeric, categorical, k, ref_id, cell_rows, chunk_rows)
    if k > search.k:
        raise ValueError(f"reference rows are kept for {search.k} neighbours only")
    search = replace(search, k=k)
    whole = kept(_columns(query, numeric, categorical, query_id))
    once = whole.groupBy("id").count().where("count > 1").isEmpty()
    if not search.names:
        q = whole.distinct()
    elif once:
        q = kept(whole.groupBy(*search.names).agg(F.min("id").alias("id")))
    else:
        q = kept(whole.select(*search.names).distinct().withColumn("id", F.monotonically_increasing_id()))
    first = search.found(q, False)
    if search.cells.rows[search.cells.rows > 0].min() < k:  # then a query may meet several cells first
        first = first.groupBy("id", *search.names).agg(*_best(k))
    first = kept(first)
    tau = F.coalesce(F.get("d2", k - 1), F.lit(float("inf")))
    second = search.found(first.select("id", *search.names, tau.alias("tau")), True).groupBy("id").agg(*_best(k))
    pairs = lambda d, n: F.arrays_zip(F.col(d).alias("d"), F.col(n).alias("n"))
    both = F.slice(F.array_sort(F.concat(pairs("d2", "near"), pairs("__d", "__n"))), 1, k)
    pick = lambda c, x: F.when(F.col("__d").isNull(), F.col(c)).otherwise(F.transform(both, lambda p: p[x])).alias(c)
    others = second.select("id", F.col("d2").alias("__d"), F.col("near").alias("__n"))  # of few queries: those with a row as near in another cell
    found = first.select("id", "d2", "near").join(others, "id", "left").select("id", pick("d2", "d"), pick("near", "n"))
    if search.names and not (once and q.count() == whole.count()):
        same = reduce(and_, [F.col(f"w.{c}").eqNullSafe(F.col(f"q.{c}")) for c in search.names])
        asked = whole.alias("w").join(q.alias("q"), same).select("w.id", F.col("q.id").alias("as"))
        found = asked.join(found.withColumnRenamed("id", "as"), "as")
        found = found if once else found.groupBy("id").agg(*_best(k))
    return kept(found.select("id", F.transform("d2", F.sqrt).alias("d"), "near"))


def _best(k: int) -> list:
    """Aggregates that merge the lists (d2, near) of a query: its k best of all cells that it met."""
    pairs = F.flatten(F.collect_list(F.arrays_zip(F.col("d2").alias("d"), F.col("near").alias("n"))))
    best = F.slice(F.array_sort(pairs), 1, k)
    return [F.transform(best, lambda x: x["d"]).alias("d2"), F.transform(best, lambda x: x["n"]).alias("near")]
