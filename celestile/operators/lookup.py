"""Lookups by id: semi-joins, links to tiles, batches in the asked order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .predicates import resolve

# The redshift columns that catalogs are known by, in the order in which they are tried.
REDSHIFTS = ("Z", "ZCOSMO", "Z_HP", "Z_PHOT", "REDSHIFT", "Z_QSO", "Z_RED")


def by_ids(df: DataFrame, ids: DataFrame, id_col: str = "_source_id") -> DataFrame:
    """Rows whose id is asked for.  Which side is broadcast is left to the optimizer and its size limit."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(id_col)), id_col, "left_semi")


def by_ids_in_tiles(df: DataFrame, ids: DataFrame, pixels: Sequence[int] | DataFrame, pixel: str, id_col: str = "_source_id") -> DataFrame:
    """by_ids within tiles; on a partition column the tiles prune the scan."""
    return by_ids(in_tiles(df, pixels, pixel), ids, id_col)


def in_tiles(df: DataFrame, pixels: Sequence[int] | DataFrame, pixel: str) -> DataFrame:
    if isinstance(pixels, DataFrame):
        return df.join(pixels.select(F.col(pixels.columns[0]).alias(pixel)), pixel, "left_semi")
    return df.where(F.col(pixel).isin(list(pixels)))


def values_of(df: DataFrame, ids: DataFrame, columns: Sequence[str], id_col: str = "_source_id", order: Sequence[str] = ()) -> DataFrame:
    """id and columns; of rows with one id the last in ``order`` wins."""
    found = by_ids(df, ids, id_col).select(id_col, *columns, *(c for c in order if c not in columns and c != id_col))
    last = Window.partitionBy(id_col).orderBy(*(F.col(c).desc_nulls_last() for c in (order or columns)))
    return found.withColumn("_n", F.row_number().over(last)).where("_n = 1").select(id_col, *columns)


def redshift_column(df: DataFrame) -> str:
    """The first known redshift column, in any case."""
    low = {c.lower(): c for c in df.columns}
    for name in REDSHIFTS:
        if name.lower() in low:
            return low[name.lower()]
    raise KeyError("no redshift column")


def redshifts(df: DataFrame, ids: DataFrame, column: str | None = None, id_col: str = "_source_id") -> DataFrame:
    z = resolve(df, column) if column else redshift_column(df)
    return by_ids(df, ids, id_col).select(id_col, F.col(z).cast("double").alias("z"))


def tile_of(df: DataFrame, ids: DataFrame, *, index: str, pixels: Sequence[str], id_col: str = "_source_id") -> DataFrame:
    """id, npix, idx of every asked id, one row each; -1 where it isn't found or has no index.

    ``pixels``: columns for the tile, the first that is set counts (a modality's own, then the catalog's).
    """
    known = df.where(F.col(index) >= 0).groupBy(id_col).agg(F.min(F.struct(F.coalesce(*pixels).cast("long").alias("npix"), F.col(index).cast("long").alias("idx"))).alias("at"))
    asked = ids.select(F.col(ids.columns[0]).alias(id_col))
    missing = F.lit(-1).cast("long")
    return asked.join(known, id_col, "left").select(id_col, F.coalesce("at.npix", missing).alias("npix"), F.coalesce("at.idx", missing).alias("idx"))


def tile_of_with_scan(catalog: DataFrame, ids: DataFrame, places: DataFrame, *, index: str, pixels: Sequence[str], id_col: str = "_source_id", pixel: str = "npix", row: str = "idx") -> DataFrame:
    """tile_of, and for ids that the catalog doesn't place the modality's own tiles: places (id, npix, idx); of several the first."""
    found = tile_of(catalog, ids, index=index, pixels=pixels, id_col=id_col)
    missed = found.where("npix < 0").select(id_col).distinct()
    own = by_ids(places, missed, id_col).groupBy(id_col).agg(F.min(F.struct(F.col(pixel).cast("long").alias("npix"), F.col(row).cast("long").alias("idx"))).alias("at"))
    met = found.join(own, id_col, "left")
    lost = F.col("npix") < 0
    return met.select(id_col, F.when(lost, F.coalesce("at.npix", "npix")).otherwise(F.col("npix")).alias("npix"), F.when(lost, F.coalesce("at.idx", "idx")).otherwise(F.col("idx")).alias("idx"))


def batch(df: DataFrame, ids: DataFrame, position: str, id_col: str = "_source_id", missing: str = "error") -> DataFrame:
    """The rows of a list of ids in its order; repeats are repeated.

    ids: id and position.  ``missing``: error (raised when the row is computed) or skip.
    """
    asked = ids.select(F.col(ids.columns[0]).alias(id_col), position)
    known = df.withColumn("_there", F.lit(True))
    met = asked.join(known, id_col, "inner" if missing == "skip" else "left")
    if missing == "error":
        met = met.withColumn(position, F.when(F.col("_there").isNotNull(), F.col(position)).otherwise(F.raise_error(F.concat(F.lit("no row of id "), F.col(id_col).cast("string")))))
    return met.drop("_there").orderBy(position)


def subset(df: DataFrame, ids: DataFrame, catalog: DataFrame | None = None, id_col: str = "_source_id", z: str = "z", missing: str = "skip") -> DataFrame:
    """Rows of distinct ids; redshifts from the catalog where it has one, else the rows' own.

    ``missing``: skip, or error, raised if an asked id has no row.
    """
    asked = ids.select(F.col(ids.columns[0]).alias(id_col)).distinct()
    found = by_ids(df, asked, id_col)
    if missing == "error":
        lost = asked.where(F.col(id_col).isNotNull()).join(df.select(id_col), id_col, "left_anti").orderBy(id_col).limit(5).collect()
        if lost:
            raise KeyError(f"no row of ids {', '.join(str(r[0]) for r in lost)}")
    elif missing != "skip":
        raise ValueError(f"unknown policy {missing!r}")
    if catalog is None:
        return found
    known = redshifts(catalog, ids, id_col=id_col).groupBy(id_col).agg(F.min("z").alias("_z"))
    own = F.col(z) if z in df.columns else F.lit(None).cast("double")
    return found.join(known, id_col, "left").withColumn(z, F.coalesce("_z", own)).drop("_z")


def index_map(tiles: DataFrame, id_col: str = "_source_id", pixel: str = "npix", row: str = "idx") -> DataFrame:
    """id -> (npix, row); of an id in several tiles the later tile wins."""
    return tiles.groupBy(id_col).agg(F.max(F.struct(pixel, row)).alias("at")).select(id_col, f"at.{pixel}", f"at.{row}")


def back_patched(catalog: DataFrame, links: DataFrame, index: str, pixel: str | None = None, id_col: str = "_source_id", reset_unmatched: bool = False) -> DataFrame:
    """catalog with index (and tile) columns from links (id, npix, idx); unmatched rows keep theirs or get -1."""
    own = links.select(F.col(id_col), F.col("npix").alias("_npix"), F.col("idx").alias("_idx"))
    met = catalog.join(own, id_col, "left")
    old = lambda c: F.lit(-1).cast("long") if reset_unmatched or c not in catalog.columns else F.col(c).cast("long")
    new = {index: F.coalesce(F.col("_idx").cast("long"), old(index))} | ({pixel: F.coalesce(F.col("_npix").cast("long"), old(pixel))} if pixel else {})
    return met.withColumns(new).drop("_npix", "_idx")


def changed_rows(before: DataFrame, after: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """Ids whose columns differ: what a rewrite has to touch."""
    b = before.select(id_col, F.struct(*columns).alias("_before"))
    return after.select(id_col, F.struct(*columns).alias("_after")).join(b, id_col).where(~F.col("_after").eqNullSafe(F.col("_before"))).select(id_col)


def fiber_map(catalog: DataFrame, plate: int, mjd: int, id_col: str, *, plate_col: str = "plate", mjd_col: str = "mjd", fiber_col: str = "fiber", order: Sequence[str] = ()) -> DataFrame:
    """fiber -> id of one plate and night; the first row of a fiber wins, ``repeats`` tells of others."""
    own = catalog.where((F.col(plate_col) == plate) & (F.col(mjd_col) == mjd))
    first = Window.partitionBy(fiber_col).orderBy(*(order or (id_col,)))
    ranked = own.withColumn("_n", F.row_number().over(first)).withColumn("repeats", F.count(F.lit(1)).over(Window.partitionBy(fiber_col)) - 1)
    return ranked.where("_n = 1").select(F.col(fiber_col).alias("fiber"), F.col(id_col), "repeats")


def islands(rows: DataFrame, row: str, block_bits: int = 20) -> DataFrame:
    """Contiguous runs of row numbers: first, last, count.

    Runs are found in blocks of 2^block_bits numbers; only those that touch a block's edge, two a
    block at most, are then put together.
    """
    own = rows.where(F.col(row).isNotNull()).select(F.col(row).cast("long").alias("r")).distinct().withColumn("_block", F.shiftright("r", block_bits))
    own = own.withColumn("_run", F.col("r") - F.row_number().over(Window.partitionBy("_block").orderBy("r")))
    runs = own.groupBy("_block", "_run").agg(F.min("r").alias("first"), F.max("r").alias("last"), F.count(F.lit(1)).alias("n"))
    start = F.shiftleft("_block", block_bits)
    edge = (F.col("first") == start) | (F.col("last") == start + ((1 << block_bits) - 1))
    order = Window.orderBy("first")
    met = runs.where(edge).withColumn("_new", F.coalesce((F.col("first") != F.lag("last").over(order) + 1).cast("int"), F.lit(1)))
    joined = met.withColumn("_run", F.sum("_new").over(order)).groupBy("_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return runs.where(~edge).select("first", "last", "n").unionByName(joined.drop("_run"))


def tile_sequential(ids: DataFrame, pixel: str, position: str, seed: int | None = None) -> DataFrame:
    """ids with ``step``: tile by tile, in the given order, or shuffled by a hash of the seed between and within tiles.

    Ranks are taken per tile and added to the tiles' offsets, so no task holds more than a tile.
    """
    tile_key = F.col(pixel) if seed is None else F.xxhash64(F.lit(seed), F.col(pixel))
    row_key = F.col(position) if seed is None else F.xxhash64(F.lit(seed), F.col(position))
    counts = ids.groupBy(pixel).agg(F.count(F.lit(1)).alias("_n")).withColumn("_key", tile_key)
    before = Window.orderBy("_key", pixel).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(pixel, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(pixel).orderBy(row_key, position)
    return ids.withColumn("_r", F.row_number().over(inside)).join(starts, pixel).withColumn("step", F.col("_start") + F.col("_r") - 1).drop("_r", "_start")


def striped(tiles: DataFrame, pixel: str, workers: int) -> DataFrame:
    """Each tile's worker: tiles in order, dealt in turn."""
    return tiles.select(pixel).distinct().withColumn("worker", F.pmod(F.row_number().over(Window.orderBy(pixel)) - 1, F.lit(workers)))
