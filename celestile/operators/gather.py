"""Gather: a base table with the columns of its associated partners, and id bridges."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .predicates import checked


@dataclass(frozen=True)
class GatherPartner:
    """A partner catalog, its association with the base, and the columns to take.

    pixel: the partner's tile column.  Partner rows are then looked up by tile and id, as the
    association names them (healpix_npix_b), so that tiles without a match are never read.
    """

    name: str
    catalog: DataFrame
    association: DataFrame
    columns: Sequence[str]
    id: str = "_source_id"
    pixel: str | None = None


def nearest_only(association: DataFrame) -> DataFrame:
    """The nearest partner of each row; of equal separations the smaller partner id."""
    more = [c for c in ("_p",) if c in association.columns]
    best = association.groupBy("source_id_a").agg(F.min(F.struct("sep_arcsec", "source_id_b", *more)).alias("best"))
    return best.select("source_id_a", "best.source_id_b", "best.sep_arcsec", *(f"best.{c}" for c in more))


def prefixed(partner: str, column: str) -> str:
    return column if column.startswith(f"{partner}_") else f"{partner}_{column}"


def gather(base: DataFrame, partners: Sequence[GatherPartner], *, id_col: str = "_source_id", columns: Sequence[str] | None = None, multiplicity: str = "nearest", include_sep: bool = True, keep_all: bool = True, where_joined: str | None = None) -> DataFrame:
    """base with each partner's columns, called PARTNER_column, and PARTNER_sep_arcsec.

    ``nearest`` takes one partner row a base row, ``all`` each.  A base row without a
    partner has nulls, or goes, if not keep_all and no partner at all has something.  An
    association whose partner row is missing keeps its separation.
    """
    if multiplicity not in ("nearest", "all"):
        raise ValueError(f"unknown multiplicity {multiplicity!r}")
    out = base.select(*columns) if columns else base
    added: list[str] = []
    for p in partners:
        # links of other sources go before anything is grouped
        tile = [p.pixel] if p.pixel else []
        own = p.association.select("source_id_a", "source_id_b", "sep_arcsec", *(F.col("healpix_npix_b").alias("_p") for _ in tile))
        own = own.join(base.select(F.col(id_col).alias("source_id_a")), "source_id_a", "left_semi")
        link = nearest_only(own) if multiplicity == "nearest" else own
        names = {c: prefixed(p.name, c) for c in p.columns if c != p.id}
        rows = p.catalog.select(F.col(p.id).alias("_b"), *(F.col(c).cast("long").alias("_p") for c in tile), *(F.col(c).alias(n) for c, n in names.items()))
        sep = prefixed(p.name, "sep_arcsec")
        link = link.select(F.col("source_id_a").alias("_a"), F.col("source_id_b").alias("_b"), F.col("sep_arcsec").alias(sep), *("_p" for _ in tile))
        if tile:
            rows = rows.join(link.select("_p").distinct(), "_p", "left_semi")
        met = link.join(rows, ["_b", *("_p" for _ in tile)], "left").drop("_b", "_p")
        out = out.join(met, out[id_col] == met["_a"], "left").drop("_a")
        added += [sep, *names.values()]
        if not include_sep:
            out = out.drop(sep)
            added.remove(sep)
    if not keep_all and added:
        out = out.where(reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in added)))
    return out.where(F.expr(checked(where_joined))) if where_joined else out


def id_pairs(association: DataFrame, ids: DataFrame, direction: str = "b_to_a") -> DataFrame:
    """(partner_id, extract_id) of the partner ids asked for, in either direction of the association."""
    one, other = ("source_id_b", "source_id_a") if direction == "b_to_a" else ("source_id_a", "source_id_b")
    asked = ids.select(F.col(ids.columns[0]).alias("partner_id")).distinct()
    return association.select(F.col(one).alias("partner_id"), F.col(other).alias("extract_id")).join(asked, "partner_id", "left_semi")


def mapped_ids(association: DataFrame, ids: DataFrame, direction: str = "b_to_a") -> DataFrame:
    return id_pairs(association, ids, direction).select(F.col("extract_id").alias("_source_id")).distinct()


def bridge(identity: DataFrame, id_col: str, via: DataFrame | None = None) -> DataFrame:
    """Identity columns of a target list with ``_source_id``: its ids themselves, or those that pairs lead to (expanding)."""
    if via is None:
        return identity.withColumn("_source_id", F.col(id_col))
    pairs = via.select(F.col("partner_id").alias(id_col), F.col("extract_id").alias("_source_id"))
    return identity.join(pairs, id_col)


def with_bridge(extract: DataFrame, bridged: DataFrame, clash: str = "rename") -> DataFrame:
    """The extract with the identity columns; several identities of a row expand it.

    Columns of the same name are dropped or called target_NAME.
    """
    same = [c for c in bridged.columns if c in extract.columns and c != "_source_id"]
    own = bridged.drop(*same) if clash == "drop" else bridged.withColumnsRenamed({c: f"target_{c}" for c in same})
    return extract.join(own, "_source_id", "left")


def not_in_catalog(rows: DataFrame, catalog: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys aren't in the catalog."""
    return rows.join(catalog.select(*keys).where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))), list(keys), "left_anti")


def with_link_ids(extract: DataFrame, catalogs: dict[str, tuple[DataFrame, str]], id_col: str = "_source_id") -> DataFrame:
    """The extract with each catalog's native id column, aligned by id; name: (catalog, column)."""
    for name, (catalog, column) in catalogs.items():
        own = catalog.groupBy(id_col).agg(F.min(column).alias(name))
        extract = extract.join(own, id_col, "left")
    return extract


def modality_rows(product: DataFrame, modality: DataFrame, id_col: str = "_source_id") -> DataFrame:
    """Spectra or cutouts of the sources of a product."""
    return modality.join(product.select(id_col), id_col, "left_semi")


def zipped(tables: Sequence[DataFrame], row: str, keys: Sequence[str] = ()) -> DataFrame:
    """Row-aligned tables side by side; shared keys must agree row by row, other shared names are an error."""
    out = tables[0]
    for t in tables[1:]:
        clash = [c for c in t.columns if c in out.columns and c != row and c not in keys]
        if clash:
            raise ValueError(f"columns of the same name: {', '.join(clash)}")
        own = t.withColumnsRenamed({k: f"_{k}" for k in keys})
        out = out.join(own, row, "full_outer")
        for k in keys:
            wrong = F.raise_error(F.concat(F.lit(f"{k} differs in row "), F.col(row).cast("string")))
            out = out.withColumn(k, F.when(F.col(k).eqNullSafe(F.col(f"_{k}")), F.col(k)).otherwise(wrong)).drop(f"_{k}")
    return out


def as_types(tables: Sequence[DataFrame]) -> DataFrame:
    """Union of tables with the same columns whose types may differ: null gives way, text wins over numbers, double over long."""
    names = tables[0].columns
    for t in tables[1:]:
        if sorted(t.columns) != sorted(names):
            raise ValueError(f"columns differ: {sorted(set(t.columns) ^ set(names))}")
    rank = {"void": 0, "boolean": 1, "tinyint": 2, "smallint": 3, "int": 4, "bigint": 5, "float": 6, "double": 7}
    kinds = [dict(t.dtypes) for t in tables]
    best = {c: max((k[c] for k in kinds), key=lambda kind: rank.get(kind, 9 if kind == "string" else 8)) for c in names}
    best = {c: "double" if kind == "void" else kind for c, kind in best.items()}
    return reduce(DataFrame.unionByName, (t.select(*(F.col(c).cast(best[c]).alias(c) for c in names)) for t in tables))
