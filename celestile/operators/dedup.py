"""Duplicate ids within a table and against what is there already."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class DuplicateIds(ValueError):
    pass


def first_of_each(df: DataFrame, id_col: str, order: Sequence[str]) -> DataFrame:
    """The first row of each id in ``order``; rows without an id all stay."""
    return _one(df, id_col, [F.col(c).asc() for c in order])


def last_of_each(df: DataFrame, id_col: str, order: Sequence[str]) -> DataFrame:
    return _one(df, id_col, [F.col(c).desc() for c in order])


def _one(df: DataFrame, id_col: str, order: list) -> DataFrame:
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(id_col).orderBy(*order)))
    return ranked.where((F.col("_n") == 1) | F.col(id_col).isNull()).drop("_n")


def repeated(df: DataFrame, id_col: str) -> DataFrame:
    """Ids that occur more than once, and how often."""
    return df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def refuse_repeated(df: DataFrame, id_col: str, what: str = "the table") -> DataFrame:
    if found := repeated(df, id_col).orderBy(id_col).limit(5).collect():
        raise DuplicateIds(f"{what} repeats ids: " + ", ".join(f"{r[0]} ({r[1]} times)" for r in found))
    return df


def deduplicated(df: DataFrame, id_col: str, order: Sequence[str], policy: str) -> DataFrame:
    """policy: skip (the first stays), last, error."""
    if policy == "error":
        return refuse_repeated(df, id_col)
    return {"skip": first_of_each, "last": last_of_each}[policy](df, id_col, order)


def appended(existing: DataFrame, incoming: DataFrame, id_col: str, policy: str) -> DataFrame:
    """existing and incoming: skip leaves out incoming rows of known ids, last replaces the known rows, append keeps all.

    Within incoming nothing is deduplicated; rows without an id are always kept.
    """
    if policy == "append":
        return existing.unionByName(incoming, allowMissingColumns=True)
    known = lambda df: df.where(F.col(id_col).isNotNull()).select(id_col).distinct()
    if policy == "last":
        return existing.join(known(incoming), id_col, "left_anti").select(existing.columns).unionByName(incoming, allowMissingColumns=True)
    fresh = incoming.join(known(existing), id_col, "left_anti").select(incoming.columns)
    if policy == "error":
        clash = incoming.join(known(existing), id_col, "left_semi").select(id_col).limit(5).collect()
        if clash:
            raise DuplicateIds("ids are there already: " + ", ".join(str(r[0]) for r in clash))
    elif policy != "skip":
        raise ValueError(f"unknown policy {policy!r}")
    return existing.unionByName(fresh, allowMissingColumns=True)


def appended_arrays(existing: DataFrame, incoming: DataFrame, id_col: str, policy: str) -> DataFrame:
    """As appended, for spectra and cutouts: a batch that repeats an id is always an error."""
    return appended(existing, refuse_repeated(incoming, id_col, "the batch"), id_col, policy)


def in_tile_order(df: DataFrame, pixel: str, levels: int = 2) -> DataFrame:
    """Sorted by the tile's parent ``levels`` orders up, then by tile."""
    return df.orderBy(F.shiftright(F.col(pixel).cast("long"), 2 * levels), pixel)
