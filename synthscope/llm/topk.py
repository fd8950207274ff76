"""Exact top-k inner products of integer vectors, by statistics of segments, coarse to fine.

For vectors q and x, <q, x> = (|q|^2 + |x|^2 - |q - x|^2) / 2, and a segment of L components with means m and
deviations s adds at least L ((m_q - m_x)^2 + (s_q - s_x)^2) to the squared distance. Since
|q|^2 is the sum of L (m_q^2 + s_q^2), the bound on the distance is a bound on the product:
<q, x> <= sum of L (m_q m_x + s_q s_x). It gets closer with more segments. Pairs that cannot reach a
query's k-th best score so far are left out level by level; the others get their exact product.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

#: Numbers of segments, coarse to fine; groups of queries are bounded at ``BOX``.
LEVELS, BOX = (1, 4, 16), 8
#: Candidates (and MB of them) from which the first thresholds are taken; queries of a group, about, and groups at most; rows of a block at most.
SAMPLE, SAMPLE_MB, CHUNK_ROWS, CHUNKS, BLOCK_ROWS = 2_048, 4, 8_192, 256, 1 << 18
#: Lengths of vectors for which groups of queries are bounded; with more of them all rows go to all groups.
LENGTHS = 64
#: Queries that are compared at once, and share of pairs below which they are computed one by one.
ROWS_AT_ONCE, SPARSE = 128, 0.05
#: Whole numbers below it are exact as doubles; one more than the greatest long.
LIMIT, LONG = 2.0**53, 2.0**63


def _encoded(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """floor(scale x) of each vector, as int16 where they fit and as doubles where not. A row with a component that is null or not finite is left out."""
    for b in batches:
        vectors = b.column("v")
        flat, ends = vectors.values.to_numpy(zero_copy_only=False).astype(float), vectors.offsets.to_numpy()
        with np.errstate(over="ignore", invalid="ignore"):
            flat = np.floor(flat * scale)
        fine = np.isfinite(flat)
        small = fine & (np.abs(flat) < 1 << 15)
        count = lambda flags: np.concatenate([[0], np.cumsum(flags)])
        n_bad, n_big = count(~fine), count(~small)
        rows = [(i, s, e) for i, (s, e) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if n_bad[e] == n_bad[s]]
        out = [flat[s:e].astype("<i2" if n_big[e] == n_big[s] else "<f8").tobytes() for _, s, e in rows]
        yield pa.record_batch({"id": b.column("id").take(pa.array([r[0] for r in rows], pa.int64())), "dim": pa.array([e - s for _, s, e in rows], pa.int32()), "v": pa.array(out, pa.binary())})


def encoded(df: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, dim, v)"""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null").mapInArrow(partial(_encoded, scale=scale), "id long, dim int, v binary")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a column, all of length ``dim``."""
    parts = [np.frombuffer(x, "<i2" if len(x) == 2 * dim else "<f8") for x in column.to_pylist()]
    return np.array(parts, float).reshape(len(parts), dim)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each row's segments, times the root of the segment's length: the product of two such rows bounds that of the vectors."""
    n, d = x.shape
    if not d:
        return np.zeros((n, 2))
    segments = min(segments, d)
    starts = np.arange(segments) * d // segments
    length = np.diff(np.append(starts, d))
    mean = np.add.reduceat(x, starts, axis=1) / length
    gap = x - np.repeat(mean, length, axis=1)
    return np.concatenate([mean * np.sqrt(length), np.sqrt(np.add.reduceat(gap * gap, starts, axis=1))], axis=1)


def _by_dim(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Lengths of vectors in a batch, and the rows that have each."""
    dims = b.column("dim").to_numpy()
    for d in np.unique(dims).tolist():
        yield d, np.flatnonzero(dims == d)


def _within(tau):
    """Thresholds for scores that end at the ends of a long: none at the lower, the end itself at the upper."""
    return np.where(tau < -LONG, -np.inf, np.minimum(tau, np.nextafter(LONG, 0)))


def _first_thresholds(batches: Iterator[pa.RecordBatch], sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    """Adds ``tau``, which the k-th best score cannot be below, and ``leader``, the best sampled candidate."""
    for b in batches:
        tau, leader, ids = np.full(b.num_rows, -np.inf), np.zeros(b.num_rows, np.int64), b.column("id").to_numpy()
        for d, at in _by_dim(b):
            if d in sample:
                own, x = sample[d]
                score = _matrix(b.column("v").take(pa.array(at)), d) @ x.T
                score[ids[at][:, None] == own[None, :]] = -np.inf
                leader[at] = score.argmax(axis=1)
                if score.shape[1] >= k:
                    tau[at] = _within(np.partition(score, -k, axis=1)[:, -k])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tau), pa.array(leader)], [*b.schema.names, "tau", "leader"])


def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each group of queries in a batch: ends of the means, greatest deviations, least threshold."""
    for b in batches:
        chunk, tau, out = b.column("chunk").to_numpy(), b.column("tau").to_numpy(), []
        for d, at in _by_dim(b):
            s = statistics(_matrix(b.column("v").take(pa.array(at)), d), BOX)
            half = s.shape[1] // 2
            for c in np.unique(chunk[at]).tolist():
                m = chunk[at] == c
                out += [(c, d, j, s[m, j].min(), s[m, j].max(), s[m, half + j].max(), tau[at][m].min()) for j in range(half)]
        cols = list(zip(*out, strict=True)) if out else [[]] * 7
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, [pa.int32()] * 3 + [pa.float64()] * 4, strict=True)], ["chunk", "dim", "at", "low", "high", "dev", "tau"])


def _dealt(batches: Iterator[pa.RecordBatch], boxes: dict | None, chunks: int) -> Iterator[pa.RecordBatch]:
    """Candidates, once for each group of queries of which one could rank them."""
    for b in batches:
        for d, at in _by_dim(b):
            v = b.column("v").take(pa.array(at))
            s = statistics(_matrix(v, d), BOX) if boxes is not None else None
            for c in range(chunks):
                kept = at
                if boxes is not None:
                    if (c, d) not in boxes:
                        continue
                    low, high, dev, tau = boxes[c, d]
                    mean, own = s[:, : len(low)], s[:, len(low) :]
                    most = np.maximum(mean * low, mean * high).sum(axis=1) + own @ dev
                    size = np.sqrt((s * s).sum(axis=1) * (np.maximum(np.abs(low), np.abs(high)) ** 2 + dev**2).sum())
                    kept = at[most >= tau - 0.5 - 1e-9 * size]
                if len(kept):
                    rows = b.take(pa.array(kept))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), c, np.int32)), *rows.columns], ["chunk", *rows.schema.names])


class _Best:
    """The k best candidates so far of the queries of one group, all of one length."""

    def __init__(self, rows: list[pa.RecordBatch], dim: int, k: int):
        self.k, self.dim = k, dim
        column = lambda c: np.concatenate([r.column(c).to_numpy() for r in rows])
        self.id, self.no, self.tau = column("id"), column("no"), column("tau").copy()
        self.q = np.concatenate([_matrix(r.column("v"), dim) for r in rows])
        self.levels = [n for n in LEVELS if n < dim]
        self.stats = {n: statistics(self.q, n) for n in self.levels}
        self.norm = np.sqrt((self.q * self.q).sum(axis=1))
        self.score, self.near = np.full((len(self.id), k), -np.inf), np.full((len(self.id), k), np.iinfo(np.int64).max)
        self.last: tuple[int, bytes, int] | None = None  # id and vector of the last candidate, and equal vectors up to it

    def distinct(self, ids: np.ndarray, v: pa.Array) -> np.ndarray:
        """Rows that can count: candidates come by vector and id, so repeated rows follow one another, and of equal vectors the first k + 1 ids will do."""
        keep = []
        for i, (x, b) in enumerate(zip(ids.tolist(), v.to_pylist(), strict=True)):
            same = self.last is not None and self.last[1] == b
            if same and self.last[0] == x:
                continue
            n = self.last[2] + 1 if same else 1
            if n <= self.k + 1:
                keep.append(i)
            self.last = (x, b, n)
        return np.array(keep, np.int64)

    def add(self, ids: np.ndarray, v: pa.Array) -> None:
        keep = self.distinct(ids, v)
        if not len(keep):
            return
        ids, x = ids[keep], _matrix(v.take(pa.array(keep)), self.dim)
        stats, norm = {n: statistics(x, n) for n in self.levels}, np.sqrt((x * x).sum(axis=1)).max()
        exact = max(np.abs(self.q).max(initial=0), 1) * max(np.abs(x).max(initial=0), 1) * max(self.dim, 1) < LIMIT
        for at in range(0, len(self.id), ROWS_AT_ONCE):
            own = slice(at, at + ROWS_AT_ONCE)
            least = self.tau[own] - 0.5 - 1e-9 * norm * self.norm[own]
            cols, able = np.arange(len(ids)), np.ones((len(least), len(ids)), bool)
            for n in self.levels:
                able = able & (self.stats[n][own] @ stats[n][cols].T >= least[:, None])
                some = able.any(axis=0)
                cols, able = cols[some], able[:, some]
                if not len(cols):
                    break
            able &= self.id[own][:, None] != ids[cols][None, :]
            if able.any():
                self.merge(at, ids[cols], x[cols], able, exact)

    def merge(self, at: int, ids: np.ndarray, x: np.ndarray, able: np.ndarray, exact: bool) -> None:
        """Exact scores of the pairs that are left, into the lists."""
        q = self.q[at : at + len(able)]
        if exact and able.mean() > SPARSE:
            score = np.where(able, q @ x.T, -np.inf)
            least = self.tau[at : at + len(able)]
            if len(ids) > self.k:
                least = np.maximum(least, np.partition(score, -self.k, axis=1)[:, -self.k])
            r, c = np.nonzero(able & (score >= least[:, None]))
            s = score[r, c]
        else:
            r, c = np.nonzero(able)
            if exact:
                s = np.concatenate([np.einsum("ij,ij->i", q[r[i : i + 65536]], x[c[i : i + 65536]]) for i in range(0, len(r), 65536)])
            else:  # whole numbers that doubles cannot add exactly; scores end at the ends of a long
                s = np.array([min(max(sum(int(a) * int(b) for a, b in zip(q[i], x[j], strict=True)), -(1 << 63)), (1 << 63) - 1) for i, j in zip(r, c, strict=True)], object)
                self.score = self.score.astype(object)
        for i in np.unique(r).tolist():
            new = slice(*np.searchsorted(r, [i, i + 1]))
            score, near = np.concatenate([self.score[at + i], s[new]]), np.concatenate([self.near[at + i], ids[c[new]]])
            first = np.lexsort((near, -score))[: self.k]
            self.score[at + i], self.near[at + i] = score[first], near[first]
            worst = score[first[-1]] if len(first) == self.k else -np.inf
            if worst > self.tau[at + i]:
                self.tau[at + i] = worst if exact else _within(np.nextafter(float(worst), -np.inf))

    def found(self) -> pa.RecordBatch:
        r, c = np.nonzero(self.score != -np.inf)
        return pa.record_batch({"no": pa.array(self.no[r]), "query_id": pa.array(self.id[r]), "vec_id": pa.array(self.near[r, c]), "score": pa.array([int(s) for s in self.score[r, c]], pa.int64())})


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Cells stream by: the queries of a group, then the candidates of a block."""
    now, waiting, best = None, [], None
    for b in batches:
        cell, dim, kind = (b.column(c).to_numpy() for c in ("cell", "dim", "kind"))
        cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(dim) != 0) | (np.diff(kind) != 0)) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            if s == e:
                continue
            rows, key = b.slice(s, e - s), (int(cell[s]), int(dim[s]))
            if key != now:
                if best:
                    yield best.found()
                now, waiting, best = key, [], None
            if kind[s] == 0:
                waiting.append(rows)
            elif waiting or best:
                best = best or _Best(waiting, key[1], k)
                waiting = []
                best.add(rows.column("id").to_numpy(), rows.column("v"))
    if best:
        yield best.found()


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0, sample: int = SAMPLE, chunk_rows: int = CHUNK_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k candidates with the greatest inner products of floor(``scale`` x), ties to the
    smaller id. A candidate with the query's id is left out.

    Queries are dealt into groups (by the best of a bounded ``sample`` of candidates, from which the first
    thresholds come too), candidates into blocks by id. A candidate goes to a group only if one of its
    queries could rank it by the group's bounds; each group meets each block in one stream, which holds
    the group's queries and a batch of candidates. Where no bound holds, the work is that of all
    pairs. Null ids and vectors, and vectors with a component that is null or not finite (or not after
    scaling), take no part; vectors of different lengths do not meet; repeated rows count once, different
    vectors under one id each by itself; products beyond a long end at its ends; other columns are
    ignored; an empty table gives no rows. Of equal vectors, a stream looks at the k + 1 least ids.
    """
    x = stored(encoded(candidates, id_col, vec_col, scale))
    q = encoded(queries, id_col, vec_col, scale).dropDuplicates(["id", "v"])
    n, widest = x.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(0))).first()
    most = max(4 * k, min(sample, SAMPLE_MB * 1_000_000 // (8 * max(widest, 1))))
    few: dict[int, dict[tuple[int, bytes], np.ndarray]] = {}
    for r in x.orderBy(F.xxhash64("id", "v"), "id").limit(most).toArrow().to_pylist():  # bounded by SAMPLE and SAMPLE_MB
        few.setdefault(r["dim"], {})[r["id"], r["v"]] = _matrix(pa.array([r["v"]]), r["dim"])[0]
    known = {d: (np.array([i for i, _ in rows]), np.array(list(rows.values())).reshape(len(rows), d)) for d, rows in few.items()}
    q = stored(q.mapInArrow(partial(_first_thresholds, sample=known, k=k), "id long, dim int, v binary, tau double, leader long").withColumn("no", F.monotonically_increasing_id()))
    n_q = q.count()
    chunks = max(1, min(CHUNKS, -(-n_q // chunk_rows)))
    place = F.col("leader") * F.lit(1 << 32) + F.pmod(F.xxhash64("id"), F.lit(1 << 32))
    cuts = q.agg(F.percentile_approx(place, [i / chunks for i in range(1, chunks)], 10_000)).first()[0] if chunks > 1 else []
    q = q.withColumn("chunk", F.size(F.filter(F.lit(cuts), lambda c: c < place)).cast("int") if cuts else F.lit(0))
    boxes = None
    if q.select("dim").distinct().limit(LENGTHS + 1).count() <= LENGTHS:
        ends = q.mapInArrow(_boxes, "chunk int, dim int, at int, low double, high double, dev double, tau double").groupBy("chunk", "dim", "at").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("dev").alias("dev"), F.min("tau").alias("tau"))
        rows: dict[tuple[int, int], list] = {}
        for r in ends.collect():  # CHUNKS x LENGTHS x BOX rows at most
            rows.setdefault((r["chunk"], r["dim"]), []).append(r)
        boxes = {}
        for key, part in rows.items():
            part.sort(key=lambda r: r["at"])
            boxes[key] = (*(np.array([r[c] for r in part]) for c in ("low", "high", "dev")), min(r["tau"] for r in part))
    blocks = max(1, -(-n // block_rows), min(64 // chunks, -(-n // 512)))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    dealt = x.mapInArrow(partial(_dealt, boxes=boxes, chunks=chunks), "chunk int, id long, dim int, v binary").select((F.col("chunk").cast("long") * blocks + block).alias("cell"), "dim", F.lit(1).alias("kind"), "v", "id", F.lit(None).cast("double").alias("tau"), F.lit(None).cast("long").alias("no"))
    asked = q.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).select((F.col("chunk").cast("long") * blocks + F.col("block")).alias("cell"), "dim", F.lit(0).alias("kind"), "v", "id", "tau", "no")
    cells = asked.unionByName(dealt).repartition(min(chunks * blocks, 20_000), "cell").sortWithinPartitions("cell", "dim", "kind", "v", "id")
    found = cells.mapInArrow(partial(_search, k=k), "no long, query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("no").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
