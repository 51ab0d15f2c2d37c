"""MinHash near-dedup by ProbMinHash.

A document is the set of its shingles of five words (of all its words, if fewer).  For
each shingle a Poisson process with its weight as rate sends arrivals to registers; a
register keeps its first arrival, and a shingle stops once it is later than every
register.  The share of equal registers estimates the probability Jaccard similarity.  Shingles weigh 1
each (``weights`` "set"), where it is the Jaccard similarity of the sets, or 1 + ln of their count
("counts"), which parts texts that repeat a passage a different number of times.  Bands of
registers give candidates, which the exact similarity of the same weights confirms at 0.8 or more.

Equal texts are one class from the start.  A bucket of a band doesn't yield all its pairs:
its members are compared with one of them, the one that shares most buckets with others.
Where that leaves several components within a bucket, the bucket is compared in blocks:
pairs from different components whose sizes allow for the threshold are confirmed in
place, likely ones first, until they are one, and only the links that join something leave the task.
Classes are connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, tidy
from .components import components

SHINGLE = 5
BANDS = 20
ROWS = 5
THRESHOLD = 0.8
BLOCK = 1024
SALTS = 8
MOST_HOT = 64
CACHE_WORDS = 700_000
TEXTS_AT_ONCE = 64
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Text to the hashes of its shingles; word hashes are kept by word."""

    def __init__(self) -> None:
        self.cache: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        cache = self.cache
        try:
            codes = [cache[w] for w in words]
        except KeyError:
            if len(cache) > CACHE_WORDS:
                cache.clear()
            for w in words:
                if w not in cache:
                    cache[w] = xxhash.xxh3_64_intdigest(w)
            codes = [cache[w] for w in words]
        w = np.array(codes, _U)
        if not len(w):
            return w
        n = min(SHINGLE, len(w))
        h = np.zeros(len(w) - n + 1, _U)
        for i in range(n):
            h = h * _U(0x9E3779B97F4A7C15) + w[i : i + len(h)]
        return _mix(h)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = BANDS * ROWS) -> np.ndarray:
    """One row of 16-bit registers for each (distinct shingles, weights); zeros for none."""
    size = [len(s) for s, _ in sets]
    element = np.concatenate([s for s, _ in sets]) if sets else np.zeros(0, _U)
    rate = np.concatenate([w for _, w in sets]) if sets else np.zeros(0)
    doc = np.repeat(np.arange(len(sets)), size)
    first = np.full(len(sets) * registers, np.inf)
    winner = np.zeros(len(sets) * registers, np.uint16)
    time = np.zeros(len(element))
    turn = 0
    while len(element):
        turn += 1
        draw = _mix(element + _U((turn * 0xD1B54A32D192ED03) % 2**64))
        time = time - np.log(((draw >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        draw = _mix(draw)
        at = doc * registers + (draw % _U(registers)).astype(np.int64)
        early = time < first[at]
        np.minimum.at(first, at[early], time[early])
        won = np.flatnonzero(time == first[at])
        winner[at[won]] = (element[won] >> _U(48)).astype(np.uint16)
        last = first.reshape(-1, registers).max(axis=1)
        on = np.flatnonzero(time < last[doc])
        element, rate, doc, time = element[on], rate[on], doc[on], time[on]
    return winner.reshape(len(sets), registers)


def weighted(shingles: np.ndarray, weights: str) -> tuple[np.ndarray, np.ndarray | None]:
    """The distinct shingles, ascending, and their weights; None where all weigh 1."""
    if weights == "set":
        return np.unique(shingles), None
    if weights != "counts":
        raise ValueError(f"unknown weights {weights!r}")
    own, counts = np.unique(shingles, return_counts=True)
    return own, 1 + np.log(counts)


def similar(a: tuple[np.ndarray, np.ndarray | None], b: tuple[np.ndarray, np.ndarray | None], threshold: float) -> bool:
    """Whether the exact similarity of two weighted sets is threshold or more."""
    (x, u), (y, v) = a, b
    if not len(x) or not len(y) or (u is None and min(len(x), len(y)) < threshold * max(len(x), len(y))):
        return False
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    hit = x[at] == y
    if u is None:
        both = int(hit.sum())
        return both >= threshold * (len(x) + len(y) - both) - 1e-9
    return probability_jaccard(u, v, at[hit], np.flatnonzero(hit)) >= threshold - 1e-9


def probability_jaccard(u: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> float:
    """sum over shared d of 1 / sum over all e of max(u_e / u_d, v_e / v_d); elements i of u and j of v are the same.

    By the ratio v / u of an element the first term of the maximum holds below d's ratio, the
    second above it, so sums along the order of ratios give all of them.
    """
    if not len(i):
        return 0.0
    ratio = v[j] / u[i]
    order = np.argsort(ratio, kind="stable")
    ratio, a, b = ratio[order], u[i][order], v[j][order]
    last = np.searchsorted(ratio, ratio, "right")
    below = u.sum() - a.sum() + np.concatenate([[0.0], np.cumsum(a)])[last]
    above = v.sum() - np.concatenate([[0.0], np.cumsum(b)])[last]
    return float((1 / (below / a + above / b)).sum())


def _sketch(batches: Iterator[pa.RecordBatch], weights: str = "set") -> Iterator[pa.RecordBatch]:
    shingle = Shingler()
    for batch in batches:
        for i in range(0, batch.num_rows, TEXTS_AT_ONCE):
            part = batch.slice(i, TEXTS_AT_ONCE)
            sets = [weighted(shingle(t), weights) for t in part.column(2).to_pylist()]
            own = signatures([(s, np.ones(len(s)) if w is None else w) for s, w in sets])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([len(s) for s, _ in sets], pa.int32()), pa.array([r.tobytes() for r in own], pa.binary())],
                names=["doc_id", "text_key", "shingles", "registers"],
            )


def sketches(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", weights: str = "set") -> DataFrame:
    """doc_id, text_key (md5), number of shingles, registers of each row."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(tidy(_sketch), weights=weights), "doc_id long, text_key string, shingles int, registers binary")


def _verify(batches: Iterator[pa.RecordBatch], threshold: float, weights: str) -> Iterator[pa.RecordBatch]:
    shingle, leader, own, done = Shingler(), None, None, set()
    for batch in batches:
        a_s, b_s = [], []
        for a, salt, b, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (a, salt) != leader:
                leader, own, done = (a, salt), None, set()
            if b is None:
                own = weighted(shingle(text), weights) if own is None else own
            elif b not in done and own is not None:
                done.add(b)
                if similar(own, weighted(shingle(text), weights), threshold):
                    a_s.append(a)
                    b_s.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(a_s, pa.int64()), pa.array(b_s, pa.int64())], names=["a", "b"])


def verify(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, weights: str = "set") -> DataFrame:
    """The pairs (a, b) whose texts (doc_id, text) have the exact similarity threshold or more.

    The text of a travels once for each of up to SALTS parts of its partners.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    need = salted.select(F.col("b").alias("doc_id"), "a", "salt", "b").unionByName(
        salted.select(F.col("a").alias("doc_id"), "a", "salt", F.lit(None).cast("long").alias("b")).distinct()
    )
    dealt = need.join(texts, "doc_id").select("a", "salt", "b", "text").repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(partial(tidy(_verify), threshold=threshold, weights=weights), "a long, b long")


def _compare(band: int, group: pa.Table, threshold: float, weights: str = "set") -> pa.Table:
    """Links between different components of a block, as far as they join something new."""
    doc = group.column("doc").to_numpy()
    left, right = (group.column(c).to_numpy() for c in ("left", "right"))
    shingle = Shingler()
    own = [weighted(shingle(t), weights) for t in group.column("text").to_pylist()]
    size = np.array([len(x) for x, _ in own])
    regs = np.stack([np.frombuffer(x, np.uint16) for x in group.column("registers").to_pylist()])
    names, comp = np.unique(group.column("component").to_numpy(), return_inverse=True)
    a_s, b_s = [], []
    for i in np.flatnonzero(left).tolist():
        able = np.minimum(size, size[i]) >= threshold * np.maximum(size, size[i]) if weights == "set" else size > 0
        js = np.flatnonzero(right & (comp != comp[i]) & able)
        equal = regs[js] == regs[i]
        share = equal.mean(axis=1)
        # a pair that meets in several bands is compared in the first
        ok = equal.reshape(len(js), BANDS, ROWS).all(2).argmax(1) == band
        js, share = js[ok], share[ok]
        for j in js[np.argsort(-share)].tolist():
            if comp[i] == comp[j]:
                continue
            if similar(own[i], own[j], threshold):
                a_s.append(int(doc[i]))
                b_s.append(int(doc[j]))
                comp[comp == comp[j]] = comp[i]
    return pa.table({"a": pa.array(a_s, pa.int64()), "b": pa.array(b_s, pa.int64())})


def _rest(members: DataFrame, found: DataFrame, reps: DataFrame, texts: DataFrame, threshold: float, weights: str) -> DataFrame:
    """Links between different components within a bucket, by blocks of its members."""
    comp = members.join(found.withColumnRenamed("v", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    comp = save(comp, "members")
    split = comp.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    split = split.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    block = comp.join(split, "key").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    spread = block.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc", "component",
        (F.col("block") <= F.col("other")).alias("left"), (F.col("block") >= F.col("other")).alias("right"),
    )
    rows = spread.join(reps.select(F.col("doc_id").alias("doc"), "registers"), "doc").join(texts.withColumnRenamed("doc_id", "doc"), "doc")
    return save(rows.groupBy("key", "band", "i", "j").applyInArrow(lambda k, t: _compare(k[1].as_py(), t, threshold, weights), "a long, b long"), "links")


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, weights: str = "set") -> DataFrame:
    """doc_id, text_key, class_id, kept of each row; texts link at the similarity ``threshold`` or more by their ``weights``.

    class_id is the smallest id of the document's class, kept says that it is the
    document's own.  Null texts, texts without a word and rows of null id link with
    nothing and are kept (their class is their id).  Texts are read whole, however long.  Texts
    under one id are classed together.  Repeated rows share a class; an empty table gives
    an empty one.  Other columns are not read.
    """
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = save(sketches(texts, weights=weights), "sketches")
    able = rows.where("shingles > 0 and doc_id is not null")
    reps = save(able.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.first("registers").alias("registers"), F.count(F.lit(1)).alias("n")), "texts")
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("registers"), i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    entries = reps.select(F.col("doc_id").alias("doc"), F.posexplode(band).alias("band", "key"))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = save(entries.join(shared, "key").select("key", "band", "doc", "n"), "buckets")
    central = members.groupBy("doc").agg(F.sum("n").alias("met"))
    leaders = members.join(central, "doc").groupBy("key").agg(F.max(F.struct("met", (-F.col("doc")).alias("d"))).alias("m")).select("key", (-F.col("m.d")).alias("a"))
    pairs = members.join(leaders, "key").where("a <> doc").select("a", F.col("doc").alias("b")).distinct()
    # the texts that are compared at all are set apart once
    compared = members.select(F.col("doc").alias("doc_id")).distinct().join(reps.select("doc_id", "text_key"), "doc_id")
    texts = save(texts.withColumn("text_key", F.md5("text")).join(compared, ["doc_id", "text_key"]).select("doc_id", "text"), "compared")
    links = save(verify(pairs, texts, threshold, weights), "links")
    found = components(links)
    more = _rest(members.select("key", "band", "doc"), found, reps, texts, threshold, weights)
    if not more.isEmpty():
        found = components(links.unionByName(more))
    classes = reps.select("text_key", F.col("doc_id").alias("v")).join(found, "v", "left").select("text_key", F.coalesce("component", "v").alias("class_id"))
    classes = save(classes, "classes")
    # the few texts that hold a large share of all rows go another way: MOST_HOT rows at most, and so broadcast
    hot = reps.where(F.col("n") * MOST_HOT > rows.count()).select("text_key").join(classes, "text_key").select("text_key", F.col("class_id").alias("hot_class"))
    marked = rows.drop("registers").join(F.broadcast(save(hot, "hot")), "text_key", "left")
    rare = marked.where("hot_class is null").drop("hot_class").join(classes, "text_key", "left")
    met = rare.unionByName(marked.where("hot_class is not null").withColumnRenamed("hot_class", "class_id"))
    own = F.when((F.col("shingles") > 0) & F.col("doc_id").isNotNull(), F.col("class_id")).otherwise(F.col("doc_id"))
    return met.select("doc_id", "text_key", own.alias("class_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(df: DataFrame, **options) -> DataFrame:
    """df with one row of each class: the one with the smallest id, once.

    Rows without a word or an id all stay.  Of rows of one id and text one stays, the first by a
    hash of the other columns, so that only rows that agree in all of them tie; columns
    may have any name.  An empty table gives an empty one.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    marked = near_duplicates(df, **options).where("doc_id is not null and text_key is not null")
    kept = save(marked.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.min("kept").alias("_kept")), "kept")
    text = F.col(text_col)
    blank = ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]") | F.col(id_col).isNull()
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")
    others = [F.col(f"`{c}`") for c in df.columns if c not in (id_col, text_col)]
    order = F.xxhash64(F.to_json(F.struct(*others), {"ignoreNullFields": "false"}) if others else F.lit(0)).alias("_order")
    keyed = df.where(~blank).select(row, F.col(id_col).cast("long").alias("_id"), F.md5(text).alias("_key"), order)
    # the limit on ranks acts before the shuffle, so that rows repeated many times don't meet in one task
    same = Window.partitionBy("_id", "_key").orderBy("_order")
    one = keyed.withColumn("_n", F.row_number().over(same)).where("_n = 1")
    return one.join(kept, ["_id", "_key"]).where("_kept").select("_row.*").unionByName(df.where(blank))
