"""Exact top-k inner products by a three-phase uniform threshold.

A vector's components are cut into ``lists`` groups; in each a candidate has a
local score, and its score is their sum.  Candidates are packed in blocks that
stay where they are; within a block, vectors that lie close together form
tiles.  Per list, a tile's centre and radius bound the local scores of all its
members for any query.  Queries go past the blocks in broadcast slices of
checked size, each in three phases:

1. gather: every block scores the tiles that promise most and gives a list of
   its k best for each query; the k-th best of all blocks' lists is a safe
   cutoff, as k entries reach it.
2. collect: the cutoff is broadcast.  A score that reaches it has a local score
   of at least cutoff / lists somewhere; tiles whose bounds are all below that,
   or sum to less than the cutoff, are skipped without a product.
3. resolve: in what is left, local scores are added list by list, and queries
   that no member of the tile can satisfy any more drop out; the rest is exact,
   and the k best, ties to the smaller id, are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import pick, stage

#: Vectors in a block of queries, and of candidates.
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096
#: Vectors in a tile on average; no tile has over twice as many.
TILE = 64
LISTS = 4
#: Bytes of queries that are broadcast at once; more take further passes over the candidates.
SLICE_BYTES = 32 << 20


def tiled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): vectors that lie close together follow each other, and where each tile of them begins."""
    n = len(x)
    if n <= TILE:
        return np.arange(n), np.zeros(min(n, 1), np.int64)
    centre = x[:: max(1, n // (n // TILE))][: n // TILE]
    with np.errstate(all="ignore"):
        for _ in range(3):  # each to its nearest, centres to the middle of their own
            near = np.nan_to_num(x @ centre.T - (centre**2).sum(1) / 2, nan=-np.inf).argmax(1)
            by = np.argsort(near, kind="stable")
            first = np.flatnonzero(np.diff(near[by], prepend=-1))
            size = np.diff(np.append(first, n))
            centre = np.add.reduceat(x[by], first) / size[:, None] if x.shape[1] else centre
    return by, np.concatenate([np.arange(f, f + m, 2 * TILE) for f, m in zip(first, size)])


def _pack(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, embedding) -> rows (number, n, dim, ids, data, tiles) of at most ``block`` vectors of one length."""
    ids: dict[int, list] = {}
    rows: dict[int, list] = {}
    task, seq = TaskContext.get().partitionId(), 0

    def out(d: int) -> pa.RecordBatch:
        nonlocal seq
        i, x = np.concatenate(ids.pop(d)), np.concatenate(rows.pop(d))
        by, tiles = tiled(x)
        seq += 1
        cols = [[task << 32 | seq], [len(i)], [d], [i[by].tobytes()], [x[by].tobytes()], [tiles.astype(np.int64).tobytes()]]
        kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 3]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["number", "n", "dim", "ids", "data", "tiles"])

    for b in batches:
        v, col = np.asarray(b.column(0)), b.column(1)
        off, flat = np.asarray(col.offsets).astype(np.int64), np.asarray(col.values.cast(pa.float64(), safe=False)).astype(np.float64)
        length = np.diff(off)
        for d in np.unique(length).tolist():
            at = np.flatnonzero(length == d)
            x = np.floor(256.0 * flat[off[at][:, None] + np.arange(d)[None, :]]) if d else np.zeros((len(at), 0))
            s = 0
            while s < len(at):
                room = block - sum(map(len, ids.get(d, ())))
                ids.setdefault(d, []).append(v[at[s : s + room]])
                rows.setdefault(d, []).append(x[s : s + room])
                s += room
                if sum(map(len, ids[d])) >= block:
                    yield out(d)
    for d in list(ids):
        yield out(d)


def _usable(vectors: DataFrame) -> DataFrame:
    v = pick(vectors, "vec_id", "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.where(~bad).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def _blocks(v: DataFrame, size: int) -> DataFrame:
    return v.mapInArrow(lambda it: _pack(it, size), "number long, n long, dim int, ids binary, data binary, tiles binary")


def _load(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(data, np.float64).reshape(len(i), dim)


def _exact_in_floats(q: np.ndarray, c: np.ndarray) -> bool:
    """Whether every partial sum of integer products fits 53 bits."""
    return (np.abs(q).max(initial=0) or 0) * (np.abs(c).max(initial=0) or 0) * max(1, q.shape[1]) < 2**53


def _product(q: np.ndarray, c: np.ndarray, exact: bool) -> np.ndarray:
    """Exact integer inner products, by BLAS where floats are exact."""
    if exact:
        return q @ c.T
    return np.array([[sum(int(a) * int(b) for a, b in zip(x, y)) for y in c] for x in q], dtype=object).reshape(len(q), len(c))


class _Bounds:
    """A block's tiles and, for each list, how much a query can score in each tile."""

    def __init__(self, q: np.ndarray, c: np.ndarray, starts: np.ndarray, lists: int):
        self.starts, self.ends = starts, np.append(starts[1:], len(c))
        self.groups = [g for g in np.array_split(np.arange(q.shape[1]), lists) if len(g)]
        size = (self.ends - self.starts)[:, None]
        with np.errstate(all="ignore"):
            centre = np.add.reduceat(c, self.starts) / size if c.shape[1] else np.zeros((len(self.starts), 0))
            away = c - np.repeat(centre, size[:, 0], axis=0)
            self.local = []
            for g in self.groups:
                radius = np.sqrt(np.maximum.reduceat((away[:, g] ** 2).sum(1), self.starts))
                most = q[:, g] @ centre[:, g].T + np.sqrt((q[:, g] ** 2).sum(1))[:, None] * radius[None, :]
                self.local.append(np.nan_to_num(most, nan=np.inf, posinf=np.inf, neginf=np.inf))
            self.total = sum(self.local) if self.local else np.zeros((len(q), len(self.starts)))
            # bounds are floats: so much they may be off by
            self.slack = 1e-6 + 1e-9 * np.sqrt((q**2).sum(1)) * np.sqrt((c**2).sum(1).max(initial=0))
        self.slack = np.nan_to_num(self.slack, nan=np.inf)


def _best(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best hits, ties to the smaller id."""
    if s.dtype == object:
        by = np.array(sorted(range(len(s)), key=lambda i: (q[i], -s[i], v[i])), np.int64)
    else:
        by = np.lexsort((v, -s, q))
    first = np.flatnonzero(np.append(True, q[by][1:] != q[by][:-1])) if len(by) else np.zeros(0, np.int64)
    rank = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
    return by[rank < k]


def gather(qi: np.ndarray, q: np.ndarray, ci: np.ndarray, c: np.ndarray, starts: np.ndarray, k: int, lists: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase 1 in one block: (query id, vec_id, score), the k best of the tiles that promise most."""
    b, exact = _Bounds(q, c, starts, lists), _exact_in_floats(q, c)
    size = b.ends - b.starts
    probes = min(int(np.searchsorted(np.cumsum(np.sort(size)), k + 1)) + 1, len(size))  # tiles that surely hold k others
    chosen = np.argpartition(-b.total, probes - 1, axis=1)[:, :probes]
    out = []
    for t in np.unique(chosen).tolist():
        sel = np.flatnonzero((chosen == t).any(1))
        own = ci[b.starts[t] : b.ends[t]]
        s = _product(q[sel], c[b.starts[t] : b.ends[t]], exact)
        at, member = np.nonzero(own[None, :] != qi[sel][:, None])
        out.append((qi[sel][at], own[member], s[at, member]))
    return _top(out, k)


def resolve(qi: np.ndarray, q: np.ndarray, ci: np.ndarray, c: np.ndarray, starts: np.ndarray, cut: np.ndarray, k: int, lists: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int]:
    """Phases 2 and 3 in one block: (hits, multiplications made); ``cut`` is -inf for queries without a cutoff."""
    b, exact = _Bounds(q, c, starts, lists), _exact_in_floats(q, c)
    m = max(1, len(b.groups))
    least = cut - b.slack
    some = np.logical_or.reduce([p >= (least / m)[:, None] for p in b.local]) if b.local else np.ones(b.total.shape, bool)
    alive = some & (b.total >= least[:, None])
    out, made = [], 0
    for t in np.flatnonzero(alive.any(0)).tolist():
        sel = np.flatnonzero(alive[:, t])
        own, x = ci[b.starts[t] : b.ends[t]], c[b.starts[t] : b.ends[t]]
        score, rest = np.zeros((len(sel), len(own)), float if exact else object), b.total[sel, t]
        for g, most in zip(b.groups, b.local):
            score = score + _product(q[np.ix_(sel, g)], x[:, g], exact)
            made += len(sel) * len(own) * len(g)
            with np.errstate(invalid="ignore"):
                rest = np.nan_to_num(rest - most[sel, t], nan=np.inf)
            keep = score.max(1).astype(float) + rest >= least[sel]
            sel, score, rest = sel[keep], score[keep], rest[keep]
            if not len(sel):
                break
        at, member = np.nonzero((score >= cut[sel][:, None]) & (own[None, :] != qi[sel][:, None]))
        out.append((qi[sel][at], own[member], score[at, member]))
    return _top(out, k), made


def _top(hits: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not hits:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    q, v, s = (np.concatenate(x) for x in zip(*hits))
    keep = _best(q, v, s, k)
    return q[keep], v[keep], s[keep]


def _phase(work: Callable, shared) -> Callable:
    """Candidate blocks (dim, ids, data, tiles) -> hits, against the queries in ``shared`` of the same length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                if r["dim"] in shared.value:
                    q, v, s = work(*shared.value[r["dim"]][:2], *_load(r["ids"], r["data"], r["dim"]), np.frombuffer(r["tiles"], np.int64), *shared.value[r["dim"]][2:])
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array([int(x) for x in s], pa.int64())], names=["query_id", "vec_id", "score"])

    return run


def _slices(blocks: DataFrame, most: int) -> list[list[int]]:
    """Numbers of the query blocks in each slice of at most ``most`` bytes (one block at least)."""
    out: list[list[int]] = []
    size = 0
    for number, n in blocks.select("number", F.octet_length("ids") + F.octet_length("data")).orderBy("number").toLocalIterator():
        if not out or size + n > most:
            out.append([])
            size = 0
        out[-1].append(number)
        size += n
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, lists: int = LISTS, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest scores among all vectors but itself.

    ``queries`` and ``vectors`` have vec_id and embedding.  Components become
    floor(256 * x), the score is their inner product, ties go to the smaller
    vec_id.  Vectors that are null, or hold null or non-finite components, take
    no part, nor do those of another length than the query's.  A query with
    fewer than k candidates returns all.  Repeated rows of ``vectors`` count
    each.  ``queries`` that share a vec_id are one query, of the least vector,
    component by component; rows of ``vectors`` with its vec_id are its own.
    """
    one = _usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    qb = stage(_blocks(one, query_block), "topk-queries")
    cb = stage(_blocks(_usable(vectors), candidate_block), "topk-candidates").select("dim", "ids", "data", "tiles")
    sc, out = vectors.sparkSession.sparkContext, []
    hit = "query_id long, vec_id long, score long"
    for numbers in _slices(qb, slice_bytes):
        by_dim: dict[int, list] = {}
        for r in qb.where(F.col("number").isin(numbers)).select("dim", "ids", "data").collect():  # of a checked size
            by_dim.setdefault(r.dim, []).append(_load(bytes(r.ids), bytes(r.data), r.dim))
        own = {d: (np.concatenate([i for i, _ in x]), np.concatenate([v for _, v in x])) for d, x in by_dim.items()}
        gathered = cb.mapInArrow(_phase(lambda *a: gather(*a, k, lists), sc.broadcast(own)), hit)
        found = _merge(gathered, k).where(F.size("top") >= k).select("query_id", F.element_at("top", k)["s"].alias("cut")).collect()  # a number a query
        cuts = {r.query_id: float(r.cut) for r in found}
        own = {d: (i, x, np.array([cuts.get(j, -np.inf) for j in i.tolist()])) for d, (i, x) in own.items()}
        best = _merge(cb.mapInArrow(_phase(lambda *a: resolve(*a, k, lists)[0], sc.broadcast(own)), hit), k)
        out.append(best)
    if not out:
        out.append(_merge(vectors.sparkSession.createDataFrame([], hit), k))
    if len(out) > 1:
        out = [stage(x, "topk-slice") for x in out]
    every = out[0]
    for x in out[1:]:
        every = every.union(x)
    return every.select("query_id", F.posexplode("top").alias("p", "t")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("t.v").alias("vec_id"), F.col("t.s").alias("score"))


def _merge(hits: DataFrame, k: int) -> DataFrame:
    """(query_id, top): the k best of all blocks' lists, in two steps so that no query's lists meet whole."""
    order = F.struct((-F.col("score")).alias("n"), F.col("vec_id").alias("v"), F.col("score").alias("s"))
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(16))
    part = hits.groupBy("query_id", salt.alias("salt")).agg(F.slice(F.sort_array(F.collect_list(order)), 1, k).alias("top"))
    return part.groupBy("query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k).alias("top"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (
  SELECT vec_id, list_transform(min(embedding), lambda x: floor(256 * x::DOUBLE)) AS e FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM q JOIN v c ON c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""
