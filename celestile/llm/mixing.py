"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Every document of a source expects the same number of copies, target / source size,
at most ``cap``.  The documents of a source stand in one order: by size class, by salt,
by size.  Expected copies are summed along it, one random offset per source is added,
and a document is emitted once per integer boundary that its share crosses.  A running
sum over a source that holds a third of all rows is split: groups of (source, size
class, salt) are counted first, so that each task ranks the rows of its groups only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

WORD = r"[^\x20\x09-\x0D]+"
SALTS = 256


def word_count(text: str) -> Column:
    """Words of a text; 0 where it is null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def size_class(size: Column) -> Column:
    """Four classes an octave, rising with the size; integers only."""
    bits = F.length(F.bin(size))
    return (bits * 8 + F.expr("shiftright(_size, greatest(0, length(bin(_size)) - 3))")).cast("int")


def source_targets(per_source: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """_source, _source_size -> with _target and _ratio.

    Sources by code point, null last, weigh ``weights`` in turn.  They share the sum of
    all sizes; a target stops at cap times its source's size and the excess is shared
    out by weight among the others: sources in order of cap / weight are capped as long
    as their share of what is left exceeds their cap.
    """
    k = len(weights)
    ranked = per_source.withColumn("_i", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())))
    ranked = ranked.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("_i") - 1) % k + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("_cap", F.col("_source_size") * cap)
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("_cap").cast("double") / F.col("_w"), "_i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = (
        ranked.withColumn("_all", F.sum("_source_size").over(everything))
        .withColumn("_capped_before", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_w_onward", F.sum("_w").over(onward))
    )
    share = (F.col("_w") * (F.col("_all") - F.col("_capped_before"))).cast("double") / F.col("_w_onward")
    ranked = ranked.withColumn("_stops", share > F.col("_cap"))
    ranked = ranked.withColumn("_cap_sum", F.coalesce(F.sum(F.when(F.col("_stops"), F.col("_cap"))).over(everything), F.lit(0)))
    ranked = ranked.withColumn("_w_sum", F.sum(F.when(~F.col("_stops"), F.col("_w"))).over(everything))
    free = (F.col("_w") * (F.col("_all") - F.col("_cap_sum"))).cast("double") / F.col("_w_sum")
    ranked = ranked.withColumn("_target", F.when(F.col("_stops"), F.col("_cap").cast("double")).otherwise(free))
    ratio = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    return ranked.select("_source", "_source_size", "_target", ratio.alias("_ratio"))


def mix(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    cap: int = 3,
    seed: str = "mix",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """df's ``keep`` columns (all, if None) with _size, _source_size, _target, _copies.

    A null text has size 0; texts are read whole, however long; null sources form one source; a source without words has
    target 0.  Repeated rows are documents of their own, an empty table gives an empty
    one.  ``_copies`` is a long, at most cap.  Reruns agree: ranks follow size and a
    hash of the id.  The four columns replace any of the same name.
    """
    own = ("_size", "_source_size", "_target", "_copies")
    keep = [c for c in (keep or df.columns) if c not in own]
    return _mix(df.select(F.struct(*keep).alias("_row"), *_inputs(id_col, text_col, source_col)), weights, cap, seed).select("_row.*", *own)


def _inputs(id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [F.col(source_col).alias("_source"), F.col(id_col).alias("_id"), word_count(text_col).alias("_size"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("_digest")]


def _mix(rows: DataFrame, weights: Sequence[int], cap: int, seed: str) -> DataFrame:
    """_row with _size, _source_size, _target, _copies, for _row and _inputs."""
    salt = F.conv(F.substring("_digest", 1, 2), 16, 10).cast("int") % SALTS
    rows = rows.withColumn("_class", size_class(F.col("_size"))).withColumn("_salt", salt)
    group = ["_source", "_class", "_salt"]
    groups = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_words"))
    targets = source_targets(groups.groupBy("_source").agg(F.sum("_words").alias("_source_size")), weights, cap)
    above = Window.partitionBy("_source").orderBy("_class", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("_before", F.coalesce(F.sum("_n").over(above), F.lit(0)))
    g, t = placed.alias("g"), targets.alias("t")
    placed = g.join(t, F.col("g._source").eqNullSafe(F.col("t._source"))).select(
        *(F.col(f"g.{c}").alias(f"{c}_g") for c in group), "_before", "_source_size", "_target", "_ratio", source_offset(seed, F.col("g._source")).alias("_offset")
    )
    inside = Window.partitionBy(*group).orderBy("_size", "_digest", "_id")
    ranked = rows.withColumn("_rank", F.row_number().over(inside))
    ranked = ranked.join(placed, F.col("_source").eqNullSafe(F.col("_source_g")) & (F.col("_class") == F.col("_class_g")) & (F.col("_salt") == F.col("_salt_g")))
    upto = F.col("_before") + F.col("_rank")
    copies = F.floor(upto * F.col("_ratio") + F.col("_offset")) - F.floor((upto - 1) * F.col("_ratio") + F.col("_offset"))
    return ranked.select("_row", "_size", "_source_size", "_target", copies.cast("long").alias("_copies"))


def source_offset(seed: str, source: Column) -> Column:
    """The random offset of a source, in [0, 1)."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("="), source), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def emit(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself: each row of df as often as the mix takes it.

    Rows of null text have no words, so their copies change no target; repeated rows are documents
    of their own; columns of any name stay as they are; an empty table gives an empty one.
    """
    mixed = _mix(df.select(F.struct(*df.columns).alias("_row"), *_inputs(id_col, text_col, source_col)), weights, cap, seed)
    again = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")
    return mixed.where("_copies > 0").select("_row", again).select("_row.*")


SQL = r"""
WITH rows_ AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
classed AS (
  SELECT *, length(bin(size)) * 8 + (size >> CAST(greatest(0, length(bin(size)) - 3) AS BIGINT)) AS class,
         CAST('0x' || substr(digest, 1, 2) AS BIGINT) AS salt FROM rows_),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM classed GROUP BY source),
weighed AS (
  SELECT *, source_size * 3 AS cap, i, CASE (i - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS i FROM per_source)),
summed AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS everything,
    CAST(coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS capped_before,
    CAST(sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS w_onward
  FROM weighed),
stopped AS (SELECT *, CAST(w * (everything - capped_before) AS DOUBLE) / w_onward > cap AS stops FROM summed),
shared AS (
  SELECT *, CAST(coalesce(sum(CASE WHEN stops THEN cap END) OVER (), 0) AS BIGINT) AS cap_sum,
    CAST(sum(CASE WHEN NOT stops THEN w END) OVER () AS BIGINT) AS w_sum FROM stopped),
targets AS (
  SELECT source, source_size,
    CASE WHEN stops THEN CAST(cap AS DOUBLE) ELSE CAST(w * (everything - cap_sum) AS DOUBLE) / w_sum END AS target,
    CAST('0x' || substr(md5('mix' || coalesce('=' || source, '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM shared),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, salt, size, digest, doc_id) AS r FROM classed)
SELECT r.doc_id, r.size, t.source_size, t.target,
  CAST(r.size * (floor(r.r * (CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END) + t.u)
    - floor((r.r - 1) * (CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END) + t.u)) AS BIGINT) AS taken
FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
"""


def mix_digest(df: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes) of each document."""
    id_col, text_col, source_col = (options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    # texts are read and counted once; what follows works on sizes
    slim = save(df.select(F.struct(F.col(id_col).alias("doc_id")).alias("_row"), *_inputs(id_col, text_col, source_col)), "sizes")
    mixed = _mix(slim, options.get("weights", (5, 2, 1)), options.get("cap", 3), options.get("seed", "mix")).select("_row.*", "_size", "_source_size", "_target", "_copies")
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))
