"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard.  On each level every child draws
-ln(u) / weight, u from the md5 of the row's key and the child's name, and the smallest
draw wins; a node weighs what its shards weigh together.  A change of weights moves rows
only into or out of the subtrees whose weights change.  A shard that is added comes as
a region of its own, so it takes rows only into itself, from any place of the tree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh

SALT_DIGITS = 3  # hexadecimal ones: 4096 salts a shard


def draw(key: Column, child: str) -> Column:
    """A hash of key and child as a double in (0, 1): 52 bits of an md5."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f"/{child}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) * F.lit(2.0**-52)


@dataclass(frozen=True)
class Topology:
    """regions[i][j] holds the (shard, weight) pairs of rack j in region i."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @classmethod
    def even(cls, regions: int = 2, racks: int = 2, shards: int = 4) -> Topology:
        number = iter(range(regions * racks * shards))
        return cls(tuple(tuple(tuple((next(number), 1.0) for _ in range(shards)) for _ in range(racks)) for _ in range(regions)))

    def grown(self, weight: float = 1.0) -> Topology:
        """With one more shard, in a region of its own."""
        new = 1 + max(s for region in self.regions for rack in region for s, _ in rack)
        return Topology((*self.regions, (((new, weight),),)))

    def __len__(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)


def _pick(children: list[tuple[str, float]], key: Column) -> Column:
    """The number of the child with the smallest draw; a child without weight never wins."""
    able = [i for i, (_, weight) in enumerate(children) if weight > 0]
    if len(able) < 2:
        return F.lit(able[0] if able else None).cast("int")
    draws = [F.struct((-F.log(draw(key, children[i][0])) / F.lit(float(children[i][1]))).alias("d"), F.lit(i).alias("i")) for i in able]
    return F.array_min(F.array(*draws))["i"]


def descend(df: DataFrame, key: str, topology: Topology, out: str) -> DataFrame:
    """df with the shard of column ``key`` as ``out``; one level of the tree a projection."""
    region, rack = f"_{out}_region", f"_{out}_rack"
    weight = lambda racks: sum(w for r in racks for _, w in r)
    k = F.col(key)
    at_rack = at_shard = F.lit(None).cast("int")
    for i, racks in enumerate(topology.regions):
        at_rack = F.when(F.col(region) == i, _pick([(f"rack {i}/{j}", weight([r])) for j, r in enumerate(racks)], k)).otherwise(at_rack)
        for j, leaves in enumerate(racks):
            chosen = F.element_at(F.array(*(F.lit(s) for s, _ in leaves)), _pick([(f"shard {s}", w) for s, w in leaves], k) + 1)
            at_shard = F.when((F.col(region) == i) & (F.col(rack) == j), chosen).otherwise(at_shard)
    found = df.withColumn(region, _pick([(f"region {i}", weight(racks)) for i, racks in enumerate(topology.regions)], k))
    return found.withColumn(rack, at_rack).withColumn(out, at_shard).drop(region, rack)


def shard(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", topology: Topology | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row.

    The law is ``key``: the id and the topology decide.  A null text has size 1 and the
    crc32 of nothing, 0; texts are read whole, however long.  A null id counts as the empty key.
    Repeated rows go to one shard and take a slot each; of equal draws the first child wins; an empty
    table gives an empty one; other columns are not read.  Slots are gapless from 0 in
    each shard: rows of (shard, salt) groups are counted, and ranked within their group
    by id, size and crc32, so only equal rows tie.
    """
    topology = topology or Topology.even()
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = F.col(text_col).cast("binary")
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        key.alias("_key"),
        F.substring(F.md5(F.concat(key, F.lit("|"), F.coalesce(F.crc32(text), F.lit(0)).cast("string"))), 1, SALT_DIGITS).alias("_salt"),
    )
    rows = descend(descend(rows, "_key", topology, "shard"), "_key", topology.grown(), "grown_shard").drop("_key")
    before = Window.partitionBy("shard").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("shard", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_salt").orderBy("doc_id", "size", "text_crc32")
    ranked = rows.withColumn("_r", F.row_number().over(inside)).join(starts, ["shard", "_salt"])
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_r") - 1).cast("long").alias("slot"), "grown_shard")


def write_shards(df: DataFrame, path: str, *, id_col: str = "doc_id", topology: Topology | None = None) -> None:
    """Write df's rows as Parquet, one folder a shard.

    The shard names the folder, so a column of that name can't be stored and raises.
    """
    if "shard" in {c.lower() for c in df.columns}:
        raise ValueError("a column named shard would clash with the folders")
    row, key = fresh(df, "_row", "_key")
    own = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(row), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias(key))
    placed = descend(own, key, topology or Topology.even(), "shard")
    dealt = placed.repartition("shard", F.pmod(F.xxhash64(key), F.lit(16)))
    dealt.select(f"{row}.*", "shard").write.partitionBy("shard").parquet(path)


def _tree_sql(topology: Topology, out: str, source: str) -> str:
    """SQL of the descent: r (region), k (rack) and the shard as ``out``."""
    able = lambda named: [(n, v, w) for n, v, w in named if w > 0]

    def pick(named: list[tuple[str, int, float]]) -> str:
        draws = ", ".join(f"{{'d': -ln((CAST('0x' || substr(md5(key || '/{n}'), 1, 13) AS BIGINT) + 0.5::DOUBLE) * pow(2::DOUBLE, -52)) / {w}::DOUBLE, 'i': {v}}}" for n, v, w in able(named))
        return f"list_min([{draws}]).i"

    weigh = lambda racks: sum(w for r in racks for _, w in r)
    regions = topology.regions
    region = pick([(f"region {i}", i, weigh(racks)) for i, racks in enumerate(regions)])
    rack = " ".join(f"WHEN {i} THEN {pick([(f'rack {i}/{j}', j, weigh([r])) for j, r in enumerate(racks)])}" for i, racks in enumerate(regions))
    leaf = " ".join(f"WHEN {i * 1000 + j} THEN {pick([(f'shard {s}', s, w) for s, w in r])}" for i, racks in enumerate(regions) for j, r in enumerate(racks))
    return f"""
{out}_r AS (SELECT *, {region} AS {out}_region FROM {source}),
{out}_k AS (SELECT *, CASE {out}_region {rack} END AS {out}_rack FROM {out}_r),
{out}_s AS (SELECT *, CASE {out}_region * 1000 + {out}_rack {leaf} END AS {out} FROM {out}_k)"""


# DuckDB has no crc32: its table comes from the polynomial, and texts go through it byte by byte.
SQL = f"""
WITH RECURSIVE bits AS (
  SELECT i, i AS c, 0 AS k FROM (SELECT unnest(range(256)) AS i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
bytes AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b FROM documents),
rows_ AS (
  SELECT doc_id, CAST(size AS BIGINT) AS size, coalesce(CAST(doc_id AS VARCHAR), '') AS key,
    xor(4294967295, list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT))) AS text_crc32 FROM bytes, crc),
{_tree_sql(Topology.even(), 'shard', 'rows_')},
{_tree_sql(Topology.even().grown(), 'grown_shard', 'shard_s')}
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(key || '|' || CAST(text_crc32 AS VARCHAR)), 1, {SALT_DIGITS}), doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
  CAST(grown_shard AS INTEGER) AS grown_shard
FROM grown_shard_s
"""
