"""Embedding near-dedup by lattice hashing.

Unit vectors are projected at random to BLOCKS times eight dimensions in each of TABLES
tables, and every eight coordinates are decoded to the nearest point of the E8 lattice.
A vector is entered under its own cell and under neighbouring ones, where one block takes
its next-nearest point.  Vectors that meet in a cell, within a label, are compared by
their cosine in double precision.

Equal vectors of a label are one class from the start.  A cell doesn't yield its pairs: it is
compared in blocks by matrix products, which return for each vector the number of its
links and the root of its component within the block; small cells are compared many at a
time.  A pair that meets in several cells counts in the first table where it does, in the
cell with the smallest key, which the two lists of keys tell.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, save, tidy
from .components import components

THRESHOLD = 0.98
TABLES = 10
BLOCKS = 2
PROBES = 2
SCALE = 0.55
ROWS = 4096
KEYS = TABLES * (PROBES + 1)
SMALL = 48  # cells of so many rows are compared many at a time
TILE = 512
PAIRS = 1 << 16
SEED = 20231


def _d8(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest points of D8 (integers with an even sum) and the squared distances."""
    near = np.rint(y)
    off = y - near
    worst = np.abs(off).argmax(1)
    rows = np.arange(len(y))
    odd = near.sum(1) % 2 != 0
    step = np.where(off[rows, worst] >= 0, 1.0, -1.0)
    near[rows[odd], worst[odd]] += step[odd]
    return near, ((y - near) ** 2).sum(1)


def decode(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Twice the nearest points of E8, those of the other coset, and how much farther these are."""
    a, da = _d8(y)
    b, db = _d8(y - 0.5)
    a, b = 2 * a, 2 * b + 1
    first = (da <= db)[:, None]
    return np.where(first, a, b).astype(np.int64), np.where(first, b, a).astype(np.int64), np.abs(da - db)


def _hash(points: np.ndarray, salt: int) -> np.ndarray:
    h = np.full(len(points), (salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64, np.uint64)
    for k in range(points.shape[1]):
        h = (h ^ points[:, k].astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def cells(unit: np.ndarray, label: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """The keys of each vector: of its own cell and ``probes`` neighbours in each table."""
    n, d = unit.shape
    out = np.zeros((n, tables, probes + 1), np.int64)
    for t in range(tables):
        planes = np.random.default_rng([SEED, t, d]).standard_normal((d, 8 * blocks)) * scale
        y = unit @ planes
        best, other, extra = zip(*(decode(y[:, 8 * b : 8 * b + 8]) for b in range(blocks)), strict=True)
        order = np.argsort(np.stack(extra, 1), axis=1)
        for p in range(min(probes, blocks) + 1):
            points = np.concatenate([np.where((order[:, p - 1] == b)[:, None] & (p > 0), other[b], best[b]) for b in range(blocks)], axis=1)
            out[:, t, p] = _hash(np.concatenate([points, label[:, None], np.full((n, 1), d)], axis=1), t)
        for p in range(min(probes, blocks) + 1, probes + 1):
            out[:, t, p] = out[:, t, 0]
    return out.reshape(n, -1)


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, raw = [], []
        for v, label in zip(batch.column(1), batch.column(2), strict=True):
            x = v.values if v.is_valid and label.is_valid else None
            if x is None or not len(x) or x.null_count:
                x = None
            else:
                x = x.to_numpy().astype(np.float64) + 0.0
                top = np.abs(x).max()
                x = x if np.isfinite(top) and top > 0 else None
            raw.append(None if x is None else x.tobytes())
            key.append(None if x is None else xxhash.xxh3_128_digest(raw[-1]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(key, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "label", "vec_key", "vector"])


def _units(raw: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(r) for r in raw])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 2048):
            part = batch.slice(i, 2048)
            raw, label = part.column(3).to_pylist(), part.column(1).to_numpy()
            size = np.array([len(r) for r in raw])
            keys = np.zeros((len(raw), KEYS), np.int64)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                keys[at] = cells(_units([raw[j] for j in at]), label[at])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, KEYS), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), lists], names=["v", "n", "vector", "keys"])


def _roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id of each one's component, in symmetric tables of links."""
    root = ids.copy()
    none = np.iinfo(np.int64).max
    while True:
        new = np.minimum(root, np.where(linked, root[..., None, :], none).min(-1, initial=none))
        if (new == root).all():
            return root
        root = new


def _counts_here(a: np.ndarray, b: np.ndarray, table: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether pairs with keys a and b (pair, table, probe), which share ``key`` of ``table``, share none before it."""
    here = np.ones(len(a), bool)
    for t in range(int(table.max(initial=-1)) + 1):
        at = np.flatnonzero(here & (t <= table))
        x, y = a[at, t], b[at, t]
        least = np.full(len(at), np.iinfo(np.int64).max)
        for p in range(x.shape[1]):
            least = np.minimum(least, np.where((y == x[:, p, None]).any(1), x[:, p], least))
        none = least == np.iinfo(np.int64).max
        here[at] = np.where(t < table[at], none, least == key[at])
    return here


class _Rows:
    """Rows of some cells, sorted by cell."""

    def __init__(self, table: pa.Table):
        self.key, self.i, self.j, self.table, self.v, self.n = (table.column(c).to_numpy() for c in ("key", "i", "j", "table", "v", "n"))
        self.left, self.right = (table.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right"))
        raw = table.column("vector").combine_chunks()
        self.raw = raw
        self.size = np.array(pc.binary_length(raw))
        self.keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(self.v), TABLES, -1)
        new = (np.diff(self.key) != 0) | (np.diff(self.i) != 0) | (np.diff(self.j) != 0)
        self.starts = np.concatenate([[0], np.flatnonzero(new) + 1]) if len(self.v) else np.zeros(0, np.int64)

    def units(self, at: np.ndarray) -> np.ndarray:
        return _units(self.raw.take(pa.array(at)).to_pylist())


def _links(rows: _Rows, at: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of cells of equal size (cell, place): how many links each place has, its root, and which have any."""
    cells_, size = at.shape
    unit = rows.units(at.ravel()).reshape(cells_, size, -1)
    left, right = rows.left[at], rows.right[at]
    linked = unit @ unit.transpose(0, 2, 1) >= threshold
    linked &= left[:, :, None] & right[:, None, :] | right[:, :, None] & left[:, None, :]
    linked[:, np.arange(size), np.arange(size)] = False
    count = np.zeros(at.size, np.int64)
    cell, a, b = np.nonzero(linked)
    for k in range(0, len(cell), PAIRS):
        c, x, y = (z[k : k + PAIRS] for z in (cell, a, b))
        p, q = at[c, x], at[c, y]
        here = _counts_here(rows.keys[p], rows.keys[q], rows.table[p].astype(np.int64), rows.key[p])
        np.add.at(count, (c * size + x)[here], rows.n[q[here]])
    return count.reshape(at.shape), _roots(linked, rows.v[at]), linked.any(2)


def _large(rows: _Rows, at: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, links, roots) of one cell, compared in tiles."""
    unit = rows.units(at)
    for i in range(0, len(at), TILE):
        for j in range(i, len(at), TILE):
            x, y = at[i : i + TILE], at[j : j + TILE]
            linked = unit[i : i + TILE] @ unit[j : j + TILE].T >= threshold
            linked &= rows.left[x][:, None] & rows.right[y][None, :] | rows.right[x][:, None] & rows.left[y][None, :]
            if i == j:
                np.fill_diagonal(linked, False)
            a, b = np.nonzero(linked)
            if not len(a):
                continue
            counts = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
            for k in range(0, len(a), PAIRS):
                p, q = a[k : k + PAIRS], b[k : k + PAIRS]
                here = _counts_here(rows.keys[x[p]], rows.keys[y[q]], rows.table[x[p]].astype(np.int64), rows.key[x[p]])
                np.add.at(counts[0], p[here], rows.n[y[q[here]]])
                if i != j:
                    np.add.at(counts[1], q[here], rows.n[x[p[here]]])
            if i == j:
                own, n, both = x, counts[0], linked
            else:
                own, n = np.concatenate([x, y]), np.concatenate(counts)
                both = np.zeros((len(own), len(own)), bool)
                both[: len(x), len(x) :] = linked
                both[len(x) :, : len(x)] = linked.T
            some = both.any(1)
            yield rows.v[own][some], n[some], _roots(both, rows.v[own])[some]


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, i, j) -> v, links, root; many cells at once, none of them parted."""

    def compared(held: list[pa.RecordBatch], all_of_it: bool) -> tuple[list[pa.RecordBatch], pa.RecordBatch | None]:
        table = pa.Table.from_batches(held)
        rows = _Rows(table)
        ends = np.append(rows.starts[1:], len(rows.v))
        done = len(ends) if all_of_it else len(ends) - 1
        found = []
        sizes = (ends - rows.starts)[:done]
        # vectors of different length don't meet: a cell is of one length, as its key is
        for size in np.unique(sizes):
            first = rows.starts[:done][sizes == size]
            for width in np.unique(rows.size[first]):
                own = first[rows.size[first] == width]
                if size < 2:
                    continue
                if size > SMALL:
                    for s in own.tolist():
                        found += list(_large(rows, np.arange(s, s + size), threshold))
                    continue
                step = max(1, PAIRS // int(size * size))
                for k in range(0, len(own), step):
                    at = own[k : k + step, None] + np.arange(size)
                    count, root, some = _links(rows, at, threshold)
                    found.append((rows.v[at][some], count[some], root[some]))
        rest = table.slice(int(rows.starts[done]) if done < len(ends) else len(rows.v))
        out = None
        if found:
            v, n, root = (np.concatenate(x) for x in zip(*found, strict=True))
            out = pa.RecordBatch.from_arrays([pa.array(v), pa.array(n), pa.array(root)], names=["v", "links", "root"])
        return rest.to_batches(), out

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held, out = compared([*held, batch], False)
        if out is not None:
            yield out
    if held:
        _, out = compared(held, True)
        if out is not None:
            yield out


def near_duplicates(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row.

    Vectors link if their labels are equal and their cosine is threshold or more.  Rows
    whose id or label is null, and vectors that are null, empty, zero or hold null or
    non-finite components, link with nothing; so do vectors of different length.  Repeated
    rows, and rows of one id that differ, are vectors of their own; n_links counts rows.
    Very long vectors are read whole; an empty table gives an empty one; other columns are not read.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).cast("long").alias("label"))
    vectors = save(rows.mapInArrow(_prepare, "vec_id long, label long, vec_key binary, vector binary"), "vectors")
    able = vectors.where("vector is not null and vec_id is not null")
    # a class has a number of its own, as rows of one id may lie in several
    alike = able.groupBy("label", "vec_key").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector"))
    classes = save(alike.withColumn("v", F.monotonically_increasing_id()), "classes")
    hashed = save(classes.select("v", "label", "n", "vector").mapInArrow(_keys, "v long, n long, vector binary, keys array<bigint>"), "cells")
    entries = hashed.select("v", F.posexplode("keys").alias("pos", "key")).select("v", "key", F.expr(f"pos div {PROBES + 1}").cast("int").alias("table"))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    met = entries.join(shared, "key").select("key", "table", "v", F.ceil(F.col("m") / ROWS).cast("int").alias("blocks"))
    block = met.join(hashed, "v").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    spread = block.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "table", "v", "n", "vector", "keys",
        (F.col("block") <= F.col("other")).alias("left"), (F.col("block") >= F.col("other")).alias("right"),
    )
    dealt = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "v")
    found = save(dealt.mapInArrow(partial(tidy(_compare), threshold=threshold), "v long, links long, root long"), "found")
    links = found.groupBy("v").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("v").alias("a"), F.col("root").alias("b")).where("a <> b").distinct())
    # the smallest id of each component, for the classes that are linked at all
    roots = joined.select("v", "component").unionByName(joined.select(F.col("component").alias("v"), "component").distinct())
    named = roots.join(classes.select("v", "id"), "v")
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(least, "component").select("v", "component_id")
    own = classes.select("label", "vec_key", "v", "id", "n").join(links, "v", "left").join(named, "v", "left")
    own = save(own.select("label", "vec_key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")), "classes")
    release(classes, hashed, found, joined)
    back = vectors.select("vec_id", "label", F.when(F.col("vec_id").isNotNull(), F.col("vec_key")).alias("vec_key")).join(own, ["label", "vec_key"], "left")
    component = F.coalesce("component_id", "vec_id")
    return back.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
able AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM able a JOIN able b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least_ AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
counted AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT v.vec_id, coalesce(c.n, 0) AS n_links, l.component_id, l.component_id = v.vec_id AS kept
FROM v JOIN least_ l ON l.x = v.vec_id LEFT JOIN counted c ON c.x = v.vec_id
"""
