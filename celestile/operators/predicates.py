"""Projections, predicates and row filters of extracts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESERVED = ("_source_id", "_cutout_index", "_cutout_npix", "_spectrum_index", "_spectrum_npix")
RESERVED_PREFIX = "_healpix_order"
TYPES = {"int64": "long", "int": "long", "float64": "double", "float": "double", "string": "string", "str": "string", "bool": "boolean"}


def is_reserved(name: str) -> bool:
    return name in RESERVED or name.startswith(RESERVED_PREFIX)


def resolve(df: DataFrame, name: str) -> str:
    """A column by exact name, then in any case, then stripped, then both."""
    for same in (lambda c: c == name, lambda c: c.lower() == name.lower(), lambda c: c.strip() == name.strip(), lambda c: c.strip().lower() == name.strip().lower()):
        if found := [c for c in df.columns if same(c)]:
            return found[0]
    raise KeyError(f"no column {name!r}; there are {', '.join(df.columns[:20])}")


def expand_names(args: Sequence[str]) -> list[str]:
    """['a,b', 'c'] -> ['a', 'b', 'c']."""
    return [n for a in args for n in (x.strip() for x in a.split(",")) if n]


def select_specs(df: DataFrame, specs: Sequence[str]) -> DataFrame:
    """NAME or NAME:alias; without alias the name as it was asked for."""
    out, seen = [], set()
    for spec in expand_names(specs):
        name, _, alias = spec.partition(":")
        alias = (alias or name).strip()
        if alias in seen:
            raise ValueError(f"two columns would be called {alias!r}")
        seen.add(alias)
        out.append(F.col(f"`{resolve(df, name)}`").alias(alias))
    return df.select(*out)


def checked(where: str) -> str:
    """The predicate without a leading WHERE; statements and comments are refused."""
    text = re.sub(r"^\s*where\s+", "", where, flags=re.IGNORECASE).strip()
    if not text or re.search(r";|--|/\*", text):
        raise ValueError(f"not a predicate: {where!r}")
    return text


def conjunction(*where: str | None) -> str | None:
    parts = [f"({checked(w)})" for w in where if w]
    return " AND ".join(parts) or None


def filtered(df: DataFrame, where: str | None = None, *, extra: Sequence[str] = (), columns: Sequence[str] | None = None, limit: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Filter, then limit, then project: predicates may use columns that aren't kept.

    A limit with ``order`` is deterministic; without, any rows are taken.
    """
    both = conjunction(where, *extra)
    df = df.where(F.expr(both)) if both else df
    if limit is not None:
        if limit < 1:
            raise ValueError("a limit is positive")
        df = (df.orderBy(*order) if order else df).limit(limit)
    return select_specs(df, columns) if columns else df


def with_index(df: DataFrame, index: str) -> DataFrame:
    """Rows that link to a spectrum or cutout; all rows if there is no such column."""
    return df.where(F.col(index) >= 0) if index in df.columns else df


def one_source_of_ids(targets: DataFrame | None, where: str | None) -> None:
    if (targets is None) == (where is None):
        raise ValueError("give either a target list or a predicate")


def keep_columns(df: DataFrame, asked: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """The asked and required columns and the system's own, in the table's order."""
    wanted = {resolve(df, c) for c in (*asked, *required)}
    return df.select(*(c for c in df.columns if c in wanted or is_reserved(c)))


def _constant(text: str) -> tuple[str, Column]:
    """NAME[:TYPE]=VALUE; the type is the first of int64, float64, string that the value has."""
    head, eq, value = text.partition("=")
    name, _, kind = (x.strip() for x in head.partition(":"))
    if not eq or not name:
        raise ValueError(f"not NAME[:TYPE]=VALUE: {text!r}")
    if is_reserved(name):
        raise ValueError(f"{name} is reserved")
    if kind and kind not in TYPES:
        raise ValueError(f"unknown type {kind!r}")
    if not kind:
        kind = "int64" if re.fullmatch(r"[+-]?\d+", value) else "float64" if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", value) else "string"
    return name, F.lit(value).cast(TYPES[kind])


def with_constants(df: DataFrame, specs: Sequence[str]) -> DataFrame:
    for name, value in map(_constant, specs):
        if name in df.columns:
            raise ValueError(f"there is a column {name} already")
        df = df.withColumn(name, value)
    return df


def preview(df: DataFrame, n: int, columns: Sequence[str] | None = None) -> DataFrame:
    """The first n rows of the id, position and redshift columns, or of those named."""
    usual = [c for c in df.columns if c == "_source_id" or c.lower() in ("ra", "dec", "z", "redshift")]
    return select_specs(df, columns or usual or df.columns[:10]).limit(n)


def numbered_equals(df: DataFrame, **keys: int | str | None) -> DataFrame:
    """Equality with a cast to the column's type; keys that are None don't count."""
    kinds = dict(df.dtypes)
    for name, value in keys.items():
        if value is not None:
            own = resolve(df, name)
            df = df.where(F.col(own) == F.lit(value).cast(kinds[own]))
    return df
