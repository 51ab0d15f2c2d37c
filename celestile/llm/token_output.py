"""Token ids as grammar-compressed binary shards, and their reader.

The file format is a Parquet table with one row a shard: the documents of the shard in
ascending id order (``doc_ids``, ``doc_lengths``), the place of its first id within its
partition (``first``), and a Re-Pair grammar (``rule_left``, ``rule_right``,
``rule_span``, ``body``; see repair.py).  A shard closes at SHARD_IDS ids, after whole
documents, so a task holds one shard and one batch of texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import repair
from .common import save, tidy
from .tokens import encoder, forget

SHARD_IDS = 1 << 18
TEXTS_AT_ONCE = 1024
FORMAT = (
    "part int, number int, first long, ids long, doc_ids array<bigint>, doc_lengths array<bigint>, "
    "first_rule long, rule_left binary, rule_right binary, rule_span binary, body binary"
)


def _write(batches: Iterator[pa.RecordBatch], vocabulary: str | None, end_id: int, shard_ids: int) -> Iterator[pa.RecordBatch]:
    codec, part = encoder(vocabulary), TaskContext.get().partitionId()
    end = np.array([end_id], "<u4").tobytes()
    first_rule = max(codec.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
    number, first, held, ids, sizes = 0, 0, 0, [], []
    chunks: list[bytes] = []

    def close() -> pa.RecordBatch:
        nonlocal number, first, held, ids, sizes, chunks
        grammar = repair.compress(np.frombuffer(b"".join(chunks), "<u4"), first_rule)
        row = {"part": part, "number": number, "first": first, "ids": held, "doc_ids": ids, "doc_lengths": sizes} | repair.dump(grammar)
        kinds = {"part": pa.int32(), "number": pa.int32(), "doc_ids": pa.list_(pa.int64()), "doc_lengths": pa.list_(pa.int64())}
        number, first, held, ids, sizes, chunks = number + 1, first + held, 0, [], [], []
        return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k)) for k, v in row.items()], names=list(row))

    for batch in batches:
        for i in range(0, batch.num_rows, TEXTS_AT_ONCE):
            piece = batch.slice(i, TEXTS_AT_ONCE)
            for doc, raw in zip(piece.column(0).to_pylist(), codec.encode(piece.column(1).to_pylist()), strict=True):
                ids.append(doc)
                sizes.append(len(raw) // 4 + 1)
                chunks += (raw, end)
                held += sizes[-1]
                if held >= shard_ids:
                    yield close()
    if ids:
        yield close()


def write_ids(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 2, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode every text, append end_id, and write shards in ascending id order; returns the table written.

    A null text counts as empty, so every document has its end id.  Null ids come first;
    rows of equal ids stand next to each other by text, so ties are settled but for equal rows,
    which are written each.  A text longer than a shard makes a longer shard.  An empty table
    gives an empty one.  Other columns are not read.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return save(dealt.mapInArrow(partial(tidy(_write), vocabulary=vocabulary, end_id=end_id, shard_ids=shard_ids), FORMAT), "token_ids")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()  # workers that wrote before hold the pieces they met
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            raw = memoryview(repair.expand(repair.load(row)).astype("<u4").tobytes())
            sizes = np.array(row["doc_lengths"], np.int64)
            ends = np.cumsum(sizes)
            sums = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(row["base"] + row["first"] + ends - sizes), pa.array(sizes), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def with_base(shards: DataFrame) -> DataFrame:
    """Shards with ``base``: the ids of all partitions before theirs.  One row a partition is broadcast."""
    parts = shards.groupBy("part").agg(F.sum("ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return shards.join(F.broadcast(bases), "part")


def read_digest(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the shards' grammars."""
    return with_base(shards).mapInArrow(tidy(_read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_range(shards: DataFrame, start: int, length: int) -> list[int]:
    """The ids at start .. start + length of the whole output; decodes only what covers them."""
    hit = with_base(shards).withColumn("at", F.col("base") + F.col("first")).where((F.col("at") < start + length) & (F.col("at") + F.col("ids") > start))
    out: list[int] = []
    for row in hit.orderBy("at").toLocalIterator():
        a, b = max(start, row["at"]), min(start + length, row["at"] + row["ids"])
        out += repair.read(repair.load(row.asDict()), a - row["at"], b - a).tolist()
    return out
