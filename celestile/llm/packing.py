"""Best-fit packing of documents into sequences of a fixed capacity.

Bulk-synchronous best fit.  Documents and gaps are range-sorted by size.  Sizes are whole
numbers up to the capacity, so a range is one size, and a run of equal documents or gaps
moves as one: what a round needs to know is how many there are of each size, a table
of at most ``capacity`` rows that a distributed count gives.  A round sweeps the
documents from the longest down, matches each run with its successor, the smallest
free gap that holds it, gives contested gaps to the first ranks, and updates the gaps; a
gap takes one document a round.  When a round matches nothing, the longest documents
open as many sequences as the rest needs at least.  Rounds end when all are placed.

The outcome is a list of runs (length, first rank, count, first sequence, offset),
whose number is bounded by the capacity, not by the documents.  Executors then rank the documents of each
length (by salted groups, so that one length may hold any share of all rows) and look
their runs up in blocks of ranks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, tidy
from .tokens import encoder

CAPACITY = 4096
SALTS = 1024
BLOCK_BITS = 9
TEXTS_AT_ONCE = 1024


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, first rank, count, first sequence, offset) for counts[length] documents."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    rank = np.zeros(capacity + 1, np.int64).tolist()
    left = left.tolist()
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by what is free: (first sequence, count)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(length: int, n: int, first: int, free: int, into: list[list[tuple[int, int]]]) -> None:
        runs.append((length, rank[length], n, first, capacity - free))
        rank[length] += n
        left[length] -= n
        if free > length:
            into[free - length].append((first, n))

    def sweep() -> bool:
        nonlocal gaps
        after: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        following = list(range(capacity + 2))  # the next size that has a gap

        def successor(size: int) -> int:
            passed = []
            while size <= capacity and not gaps[size]:
                passed.append(size)
                size = max(size + 1, following[size])
            for p in passed:
                following[p] = size
            return size

        moved = False
        for length in range(capacity, 0, -1):
            while left[length]:
                free = successor(length)
                if free > capacity:
                    break
                first, n = gaps[free].pop()
                take = min(n, left[length])
                if take < n:
                    gaps[free].append((first + take, n - take))
                place(length, take, first, free, after)
                moved = True
        for free, more in enumerate(after):
            gaps[free] += more
        return moved

    while any(left):
        if sweep():
            continue
        need = -(-sum(length * n for length, n in enumerate(left)) // capacity)
        for length in range(capacity, 0, -1):
            take = min(need, left[length])
            if take:
                place(length, take, sequences, capacity, gaps)
                sequences += take
                need -= take
    return np.array(runs, np.int64).reshape(-1, 5)


def assign(df: DataFrame, *, order: list[str], length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """df with sequence_id and offset.

    Lengths are from 1 to capacity; rows whose length is null, 0 or less lie in no
    sequence (null), longer ones raise.  ``order`` ranks equal lengths; rows that agree in it are
    interchangeable.  Other columns, of any name, stay as they are.  df should be a stored table: it is read twice.
    """
    spark = df.sparkSession
    keep = [c for c in df.columns if c not in ("sequence_id", "offset")]
    row = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_row")
    salt = F.pmod(F.xxhash64(*order), F.lit(SALTS)).cast("int").alias("_salt")
    salted = df.select(row, salt, F.greatest(F.coalesce(F.col(length_col), F.lit(0)), F.lit(0)).cast("int").alias("_length"))
    groups = salted.groupBy("_length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    found = {r["_length"]: r["n"] for r in groups.groupBy("_length").agg(F.sum("_n").alias("n")).toLocalIterator()}
    if max(found, default=0) > capacity:
        raise ValueError(f"a row of length {max(found)} exceeds the capacity of {capacity}")
    found.pop(0, None)
    runs = plan(found, capacity)
    table = pa.table({"_length": pa.array(runs[:, 0], pa.int32())} | {k: pa.array(runs[:, i]) for i, k in ((1, "_from"), (2, "_count"), (3, "_sequence"), (4, "_offset"))})
    blocks = F.sequence(F.shiftright("_from", BLOCK_BITS), F.shiftright(F.col("_from") + F.col("_count") - 1, BLOCK_BITS))
    runs_df = spark.createDataFrame(table).withColumn("_block", F.explode(blocks))
    before = Window.partitionBy("_length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("_length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_length", "_salt").orderBy(*(F.col(f"_row.`{c}`") for c in order))
    ranked = salted.withColumn("_r", F.row_number().over(inside)).join(starts, ["_length", "_salt"]).withColumn("_rank", F.col("_start") + F.col("_r") - 1)
    docs = ranked.select("_length", F.shiftright("_rank", BLOCK_BITS).alias("_block"), F.col("_rank"), F.lit(1).alias("_kind"), "_row", F.lit(None).cast("struct<f:bigint,s:bigint,o:bigint>").alias("_run"))
    marks = runs_df.select("_length", "_block", F.col("_from").alias("_rank"), F.lit(0).alias("_kind"), F.lit(None).cast(docs.schema["_row"].dataType).alias("_row"), F.struct(F.col("_from").alias("f"), F.col("_sequence").alias("s"), F.col("_offset").alias("o")).alias("_run"))
    at = Window.partitionBy("_length", "_block").orderBy("_rank", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = docs.unionByName(marks).withColumn("_run", F.last("_run", ignorenulls=True).over(at)).where("_kind = 1")
    return met.select("_row.*", (F.col("_run.s") + F.col("_rank") - F.col("_run.f")).alias("sequence_id"), F.col("_run.o").alias("offset"))


def _pieces(batches: Iterator[pa.RecordBatch], vocabulary: str | None, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    codec = encoder(vocabulary)
    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        for i in range(0, batch.num_rows, TEXTS_AT_ONCE):
            part = batch.slice(i, TEXTS_AT_ONCE)
            rows: list[tuple] = []
            for doc, raw in zip(part.column(0).to_pylist(), codec.encode(part.column(1).to_pylist()), strict=True):
                raw += end
                n = len(raw) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    rows.append((doc, piece, start, min(capacity, n - start), zlib.crc32(raw[4 * start : 4 * (start + capacity)])))
            doc, piece, start, length, crc = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of each document; a null text counts as empty."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(partial(tidy(_pieces), vocabulary=vocabulary, end_id=end_id, capacity=capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(df: DataFrame, **options) -> DataFrame:
    """Every document's pieces with sequence_id and offset.

    Null texts are packed as their end id alone; a very long text is read whole and cut into
    pieces of the capacity; repeated rows are packed each; of pieces of equal length
    id, piece and checksum settle the order; an empty table gives an empty one; columns beside id
    and text are not read.
    """
    return assign(save(pieces(df, **options), "pieces"), order=["doc_id", "piece", "ids_crc32"], capacity=options.get("capacity", CAPACITY))
