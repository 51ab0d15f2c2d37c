"""Exact top-k inner products by a pivot-distance index.

Components are whole numbers, floor(SCALE * x).  One more coordinate lifts all vectors to
the norm M of the longest, so that the distance from a query (lifted by 0) to a row is
|q|^2 + M^2 - 2 q.v under the root, and the nearest rows have the highest scores.

Index: PIVOTS vectors, chosen farthest-first from a sample of SAMPLE rows; every row is
keyed by its nearest pivot and its distance to it, range-sorted by that key and cut into
rings of up to RING rows, one row of the index each.  A ring is an annulus around its
pivot, which bounds by the triangle inequality what any of its rows can score.

Search: a query's own ring gives its first threshold.  Queries lie in blocks of up to QUERIES,
in the order of their own rings, so those of a block are near each other.  Blocks first meet
the outlines of all rings (pivot, nearest and farthest distance; no rows), OUTLINES at a
time; a ring's rows are sent to a block only if one of its queries may find a better score
there.  Cells of a block and about RINGS of its rings then expand rings in the order of
their bounds and leave out those that no query needs any more, as thresholds rise.  A cell
returns what may be among a query's best, and the best of all cells are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, save

SCALE = 1024
K = 10
SAMPLE = 2048
PIVOTS = 48
RING = 1024
QUERIES = 1024
RINGS = 8
OUTLINES = 1 << 15
SLACK = 1e-9  # of M^2, for rounding in the bounds
LARGEST = 2.0**62
RINGS_SCHEMA = "ring long, dim int, pivot int, lo double, hi double, n int, ids binary, asks binary, rows binary"


def _whole(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """id, asks, whole components as int64 bytes, number of them, squared norm; rows that take no part are left out."""
    for batch in batches:
        keep, raw, dim, norm = [], [], [], []
        for i, v in enumerate(batch.column(2)):
            x = v.values if v.is_valid else None
            if x is None or x.null_count or not batch.column(0)[i].is_valid:
                continue
            x = np.floor(x.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            if not np.isfinite(x).all():
                continue
            # products that might not fit into a long stop the query
            fits = not len(x) or float(np.abs(x).max()) ** 2 * len(x) < LARGEST
            keep.append(i)
            raw.append(x.astype("<i8").tobytes() if fits else b"")
            dim.append(len(x))
            norm.append(float(x @ x) if fits else np.inf)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(raw, pa.binary()), pa.array(dim, pa.int32()), pa.array(norm, pa.float64())], names=["id", "asks", "raw", "dim", "norm"])


def _stack(raw: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(raw), width))
    for row, b in zip(out, raw, strict=True):
        x = np.frombuffer(b, "<i8")
        row[: len(x)] = x
    return out


@dataclass
class Pivots:
    """points: lifted pivots; top: M^2; width: the most components of a row."""

    points: np.ndarray
    top: float
    width: int

    def lift(self, rows: np.ndarray) -> np.ndarray:
        return np.hstack([rows, np.sqrt(np.maximum(0, self.top - (rows * rows).sum(1)))[:, None]])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        square = (lifted * lifted).sum(1)[:, None] + (self.points * self.points).sum(1)[None, :] - 2 * lifted @ self.points.T
        return np.sqrt(np.maximum(0, square))


def choose(sample: np.ndarray, top: float, pivots: int = PIVOTS) -> Pivots:
    """Farthest-first traversal of the sample, from its first row."""
    own = Pivots(np.zeros((0, sample.shape[1] + 1)), top, sample.shape[1])
    lifted = own.lift(sample)
    chosen = [0]
    away = ((lifted - lifted[0]) ** 2).sum(1)
    while len(chosen) < min(pivots, len(sample)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((lifted - lifted[chosen[-1]]) ** 2).sum(1))
    return Pivots(lifted[chosen], top, sample.shape[1])


def _keyed(batches: Iterator[pa.RecordBatch], pivots: Pivots) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            part = batch.slice(i, 4096)
            away = pivots.distances(pivots.lift(_stack(part.column(2).to_pylist(), pivots.width)))
            near = away.argmin(1) if len(away) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), part.column(3), pa.array(near, pa.int32()), pa.array(away[np.arange(len(near)), near])], names=["id", "asks", "raw", "dim", "pivot", "away"])


def _rings(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by dim, pivot, distance -> rings of up to ``size`` rows of one dim and pivot."""
    ring = TaskContext.get().partitionId() << 32
    held: list[tuple] = []

    def close() -> pa.RecordBatch:
        nonlocal ring, held
        ids, asks, raw, dim, pivot, away = zip(*held, strict=True)
        row = [ring, dim[0], pivot[0], away[0], away[-1], len(ids), np.array(ids, "<i8").tobytes(), np.array(asks, bool).tobytes(), b"".join(raw)]
        held, ring = [], ring + 1
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in RINGS_SCHEMA.split(", ")])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (len(held) >= size or row[3:5] != held[0][3:5]):
                yield close()
            held.append(row)
    if held:
        yield close()


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: by floats where they are."""
    if q.size and v.size and float(np.abs(q).max()) * float(np.abs(v).max()) * q.shape[1] < 2.0**53:
        return np.rint(q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    return q @ v.T


def _matrix(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<i8").reshape(n, -1)


def _asking(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The queries with the k-th score that their own ring gives (null if it holds fewer)."""
    names = ["query", "query_id", "dim", "least", "raw"]
    for batch in batches:
        for r in batch.to_pylist():
            asks = np.flatnonzero(np.frombuffer(r["asks"], bool))
            if not len(asks):
                continue
            rows, ids = _matrix(r["rows"], r["n"]), np.frombuffer(r["ids"], "<i8")
            score = _products(rows[asks], rows)
            least: list[int | None] = []
            for at, s in zip(asks.tolist(), score, strict=True):
                s = s[ids != ids[at]]
                least.append(int(np.partition(s, len(s) - k)[len(s) - k]) if len(s) >= k else None)
            yield pa.RecordBatch.from_arrays([pa.array((r["ring"] << 11) + asks), pa.array(ids[asks]), pa.array([r["dim"]] * len(asks), pa.int32()), pa.array(least, pa.int64()), pa.array([rows[a].tobytes() for a in asks], pa.binary())], names=names)


BLOCK_SCHEMA = "block long, dim int, n int, queries binary, query_ids binary, least binary, rows binary"
NONE = np.iinfo(np.int64).min


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Queries sorted by dim and ring -> blocks of up to ``size`` of one dim."""
    block = TaskContext.get().partitionId() << 32
    held: list[tuple] = []

    def close() -> pa.RecordBatch:
        nonlocal block, held
        query, own, dim, least, raw = zip(*held, strict=True)
        row = [block, dim[0], len(held), np.array(query, "<i8").tobytes(), np.array(own, "<i8").tobytes(), np.array([NONE if x is None else x for x in least], "<i8").tobytes(), b"".join(raw)]
        held, block = [], block + 1
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (len(held) >= size or row[2] != held[0][2]):
                yield close()
            held.append(row)
    if held:
        yield close()


class _Block:
    """Queries of one block, with what bounds the scores of rings."""

    def __init__(self, row: dict, pivots: Pivots, k: int):
        self.k, self.pivots, self.dim = k, pivots, row["dim"]
        self.key, self.id, self.least = (np.frombuffer(row[c], "<i8") for c in ("queries", "query_ids", "least"))
        self.least = self.least.copy()
        self.rows = _matrix(row["rows"], row["n"])
        plain = np.zeros((row["n"], pivots.width))
        plain[:, : self.rows.shape[1]] = self.rows
        self.square = (plain * plain).sum(1)
        self.away = pivots.distances(np.hstack([plain, np.zeros((row["n"], 1))]))
        self.best: list[list[tuple[int, int]]] = [[] for _ in range(row["n"])]

    def bounds(self, pivot: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The most that a row of each ring can score (query, ring); rings of the block's dim."""
        d = self.away[:, pivot]
        gap = np.maximum(0, np.maximum(low[None, :] - d, d - high[None, :]))
        most = (self.square[:, None] + self.pivots.top - gap * gap) / 2
        return most + SLACK * (self.pivots.top + self.square[:, None]) + 1

    def expand(self, rings: list[dict]) -> Iterator[tuple[int, int, int, int]]:
        bounds = self.bounds(*(np.array([r[c] for r in rings]) for c in ("pivot", "lo", "hi")))
        for at in np.argsort(-bounds.max(0, initial=-np.inf), kind="stable").tolist():
            ring, need = rings[at], np.flatnonzero(bounds[:, at] >= self.least)
            if not len(need):
                continue
            ids = np.frombuffer(ring["ids"], "<i8")
            score = _products(self.rows[need], _matrix(ring["rows"], ring["n"]))
            for q, s in zip(need.tolist(), score, strict=True):
                hit = np.flatnonzero((s >= self.least[q]) & (ids != self.id[q]))
                if not len(hit):
                    continue
                # of equal scores the smaller ids come first
                hit = hit[np.lexsort((ids[hit], -s[hit]))][: self.k]
                merged = sorted(self.best[q] + list(zip((-s[hit]).tolist(), ids[hit].tolist(), strict=True)))[: self.k]
                self.best[q] = merged
                if len(merged) == self.k:
                    self.least[q] = max(self.least[q], -merged[-1][0])
        for key, own, best in zip(self.key.tolist(), self.id.tolist(), self.best, strict=True):
            for minus, vec in best:
                yield key, own, vec, -minus


def _outlined(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Outlines of rings (ring, dim, pivot, lo, hi), up to ``size`` in one binary row."""
    for batch in batches:
        for i in range(0, batch.num_rows, size):
            part = batch.slice(i, size)
            row = [part.column(k).to_numpy().astype("<f8" if k > 2 else "<i8").tobytes() for k in range(5)]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["ring", "dim", "pivot", "lo", "hi"])


def _reached(batches: Iterator[pa.RecordBatch], pivots: Pivots) -> Iterator[pa.RecordBatch]:
    """The rings that each block of queries needs, from rows of a block and outlines."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            own = _Block(row["asked"], pivots, 1)
            ring, dim, pivot = (np.frombuffer(row["outline"][c], "<i8") for c in ("ring", "dim", "pivot"))
            low, high = (np.frombuffer(row["outline"][c], "<f8") for c in ("lo", "hi"))
            found = []
            for k in range(0, len(ring), 1024):
                at = k + np.flatnonzero(dim[k : k + 1024] == own.dim)
                found.append(ring[at[(own.bounds(pivot[at], low[at], high[at]) >= own.least[:, None]).any(0)]])
            hit = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), row["asked"]["block"])), pa.array(hit)], names=["block", "ring"])


def _search(batches: Iterator[pa.RecordBatch], pivots: Pivots, k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and part: the block's queries, then rings."""
    at, asked, rings = None, None, []

    def close() -> Iterator[pa.RecordBatch]:
        if asked and rings:
            found = list(_Block(asked, pivots, k).expand(rings))
            columns = zip(*found, strict=True) if found else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "query_id", "vec_id", "score"])

    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if (row["block"], row["part"]) != at:
                yield from close()
                at, asked, rings = (row["block"], row["part"]), None, []
            if row["asked"] is None:
                rings.append(row["ringed"])
            else:
                asked = row["asked"]
    yield from close()


def reached(blocks: DataFrame, index: DataFrame, pivots: Broadcast) -> DataFrame:
    """(block, ring) of the rings that a block of queries must read; no rows of the index move for it."""
    outlines = index.select("ring", F.col("dim").cast("long").alias("dim"), F.col("pivot").cast("long").alias("pivot"), "lo", "hi")
    packed = save(outlines.mapInArrow(partial(_outlined, size=OUTLINES), "ring binary, dim binary, pivot binary, lo binary, hi binary"), "outlines")
    n = packed.count()
    numbered = packed.select((F.row_number().over(Window.orderBy("ring")) - 1).alias("part"), F.struct("ring", "dim", "pivot", "lo", "hi").alias("outline"))
    asked = blocks.select(F.struct(*blocks.columns).alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1))).alias("part"))
    met = asked.join(numbered, "part").select("asked", "outline")
    return met.mapInArrow(lambda x: _reached(x, pivots.value), "block long, ring long")


def top_k(df: DataFrame, asks: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE, ring: int = RING) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the highest whole inner products with each row where ``asks`` holds.

    Rows of the query's own id are no candidates; ties go to the smaller id, and between
    rows of one id to either, which are alike.  Rows whose id is null and vectors that are
    null or hold null or non-finite components take no part.  Components so large that a score
    might not fit into a long raise.  Vectors of different length don't meet, empty
    vectors score 0; very long ones are read whole.  Repeated rows are candidates each, and queries each with ranks of
    their own.  An empty table gives an empty one; other columns are not read.
    """
    spark = df.sparkSession
    ring = min(ring, 2048)  # a query's key is ring << 11 | place
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"), F.col(vector_col).alias("v"))
    whole = save(rows.mapInArrow(lambda x: _whole(x, scale), "id long, asks boolean, raw binary, dim int, norm double"), "whole")
    most = whole.agg(F.max("norm").alias("top"), F.max("dim").alias("width")).first()
    if most["top"] == float("inf"):
        raise ValueError(f"scores of vector {whole.where('isnan(norm) OR norm > 1.7e308').first()['id']} don't fit into a long")
    sample = whole.orderBy(F.xxhash64("id", "raw")).limit(SAMPLE).select("raw").toLocalIterator()
    pivots = choose(_stack([bytes(r["raw"]) for r in sample], most["width"] or 0), most["top"] or 0.0) if most["top"] is not None else Pivots(np.zeros((1, 1)), 0.0, 0)
    shared = spark.sparkContext.broadcast(pivots)
    keyed = whole.drop("norm").mapInArrow(lambda x: _keyed(x, shared.value), "id long, asks boolean, raw binary, dim int, pivot int, away double")
    dealt = keyed.repartitionByRange("dim", "pivot", "away", "id").sortWithinPartitions("dim", "pivot", "away", "id")
    index = save(dealt.mapInArrow(lambda x: _rings(x, ring), RINGS_SCHEMA), "rings")
    release(whole)
    queries = index.mapInArrow(lambda x: _asking(x, k), "query long, query_id long, dim int, least long, raw binary")
    near = queries.repartitionByRange("dim", "query").sortWithinPartitions("dim", "query")
    blocks = save(near.mapInArrow(partial(_blocks, size=QUERIES), BLOCK_SCHEMA), "blocks")
    pairs = save(reached(blocks, index, shared), "reached")
    parts = pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / RINGS).cast("int").alias("parts"))
    ringed = F.struct("pivot", "lo", "hi", "n", "ids", "rows").alias("ringed")
    part = F.pmod(F.xxhash64("ring"), F.col("parts")).cast("int").alias("part")
    right = index.select("ring", ringed).join(pairs, "ring").join(parts, "block").select("block", part, "ringed")
    left = blocks.join(parts, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.struct(*blocks.columns).alias("asked"))
    cells = left.unionByName(right, allowMissingColumns=True).repartition("block", "part").sortWithinPartitions("block", "part", F.col("asked").isNull())
    found = cells.mapInArrow(lambda x: _search(x, shared.value, k), "query long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10
"""
