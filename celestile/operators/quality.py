"""Validation of catalogs, spectra, cutouts and the links between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def link_states(catalog: DataFrame, spectra: DataFrame, id_col: str = "_source_id", index: str = "_spectrum_index", pixel: str = "npix", row: str = "idx", own_pixel: str | None = None) -> DataFrame:
    """Every catalog row and every spectrum, with the state of its link.

    Forward, a linked row is ok, or null_id, stale (no such place), wrong_id, or, where own_pixel
    names the tile that a row's position lies in, wrong_healpix if it is linked into another; an unlinked
    row is unlinked, or unpatched if a spectrum of its id exists.  Backward, a spectrum that
    no catalog row has the id of is an orphan, and one of a null id null_spectrum_id.
    """
    places = spectra.select(F.col(pixel).alias("_p"), F.col(row).cast("long").alias("_i"), F.col(id_col).alias("_there"))
    linked = catalog.where(F.col(index) >= 0)
    at = linked.join(places, (linked[pixel] == F.col("_p")) & (linked[index].cast("long") == F.col("_i")), "left")
    state = F.when(F.col(id_col).isNull(), "null_id").when(F.col("_i").isNull(), "stale").when(~F.col("_there").eqNullSafe(F.col(id_col)), "wrong_id")
    state = (state if own_pixel is None else state.when(F.col(own_pixel) != F.col("_p"), "wrong_healpix")).otherwise("ok")
    forward = at.select(F.col(id_col).alias("id"), state.alias("state"))
    known = spectra.select(F.col(id_col).alias("_known")).distinct().withColumn("_has", F.lit(True))
    free = catalog.where(F.coalesce(F.col(index), F.lit(-1)) < 0)
    unlinked = free.join(known, free[id_col] == F.col("_known"), "left").select(F.col(id_col).alias("id"), F.when(F.col("_has"), "unpatched").otherwise("unlinked").alias("state"))
    orphan = spectra.where(F.col(id_col).isNotNull()).join(catalog.select(id_col), id_col, "left_anti").select(F.col(id_col).alias("id"), F.lit("orphan").alias("state"))
    empty = spectra.where(F.col(id_col).isNull()).select(F.col(id_col).alias("id"), F.lit("null_spectrum_id").alias("state"))
    return forward.unionByName(unlinked).unionByName(orphan).unionByName(empty)


def link_counters(states: DataFrame) -> DataFrame:
    return states.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def sampled(df: DataFrame, pixel: str, k: int, id_col: str = "_source_id", seed: int = 0) -> DataFrame:
    """k rows of each tile, chosen by a hash of the id: the sample of a validation."""
    order = Window.partitionBy(pixel).orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col)
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def catalog_problems(df: DataFrame, info: dict, order: int | None = None) -> list[str]:
    """Keys of the descriptor, system columns, tile column."""
    out = [f"catalog_info has no {k}" for k in ("healpix_order", "ra_column", "dec_column", "total_rows") if k not in info]
    order = info.get("healpix_order") if order is None else order
    out += [f"no column {c}" for c in ("_source_id", f"_healpix_order{order}", info.get("ra_column", "ra"), info.get("dec_column", "dec")) if c not in df.columns]
    kinds = dict(df.dtypes)
    out += [f"{c} is of type {kinds[c]}, not bigint" for c in ("_source_id", f"_healpix_order{order}") if kinds.get(c, "bigint") != "bigint"]
    return out


def array_problems(df: DataFrame, arrays: Sequence[str], length: int | None = None, id_col: str = "_source_id") -> DataFrame:
    """id, problem: arrays of another length than ``length`` (or than the first of them), null arrays, repeated ids (a warning)."""
    want = F.lit(length) if length else F.size(arrays[0])
    checks = [F.when(F.col(a).isNull(), F.lit(f"{a} is null")).when(F.size(a) != want, F.lit(f"{a} has another length")) for a in arrays]
    own = df.select(F.col(id_col).alias("id"), F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("problem"))
    many = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return own.unionByName(many.select("id", F.lit("repeated id (warning)").alias("problem")))


def invalid_positions(df: DataFrame, ra: str, dec: str, id_col: str = "_source_id") -> DataFrame:
    from ..functions.sphere import valid_sky

    return df.where(~valid_sky(ra, dec)).select(id_col, ra, dec)


def require_valid_sky(df: DataFrame, ra: str, dec: str) -> DataFrame:
    """df, or an error with the first five bad positions."""
    from ..functions.sphere import valid_sky

    if bad := df.where(~valid_sky(ra, dec)).select(ra, dec).limit(5).collect():
        raise ValueError("invalid positions, such as " + ", ".join(str(tuple(r)) for r in bad))
    return df


def key_problems(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns that can't be joined on: missing, an array, or all null."""
    out = []
    for c in columns:
        kind = next((f.dataType for f in df.schema if f.name == c), None)
        if kind is None:
            out.append(f"no column {c}")
        elif isinstance(kind, T.ArrayType):
            out.append(f"{c} is an array")
        elif df.where(F.col(c).isNotNull()).isEmpty():
            out.append(f"{c} is null throughout")
    return out
