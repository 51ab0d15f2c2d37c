"""Object ids: signed 64-bit integers, exact for every kind of input."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import Value, col

INTEGER = r"^[+-]?[0-9]+$"
EXACT_FLOAT = float(1 << 53)


def hash64(text: str) -> int:
    """Eight bytes of blake2b over the stripped text, big-endian and signed."""
    return int.from_bytes(hashlib.blake2b(text.strip().encode(), digest_size=8).digest(), "big", signed=True)


@F.pandas_udf(T.LongType())
def stable_hash(text: pd.Series) -> pd.Series:
    """hash64 of a column; Spark has no blake2b of its own."""
    return pd.Series([None if t is None else hash64(t) for t in text], dtype="Int64")


def to_signed(x: Value) -> Column:
    """An unsigned 64-bit number (as a decimal) to the long with the same bits; null if it has no such bits."""
    d = col(x).cast("decimal(38,0)")
    wide = F.lit(str(1 << 64)).cast("decimal(38,0)")
    return F.when(d > (1 << 63) - 1, F.when(d < wide, (d - wide).cast("long"))).when(d >= -(1 << 63), d.cast("long"))


def stripped(c: Column) -> Column:
    """A text without white space at its ends, of any kind; ``trim`` takes blanks only."""
    return F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "")


def normalize(x: Value, kind: T.DataType | None = None) -> Column:
    """The id of a text: whole numbers by value, other texts by their hash; blank texts and null give null.

    For columns of a numeric type pass ``kind``; floats are whole numbers up to 2^53 in size, others give null.
    """
    c = col(x)
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return F.when((F.abs(c) <= EXACT_FLOAT) & (c == F.floor(c)), c.cast("long"))
    if isinstance(kind, T.NumericType):
        return to_signed(c)
    t = stripped(c)
    digits = F.ltrim(F.regexp_replace(t, r"^\+", ""))
    return F.when(t.rlike(INTEGER), to_signed(digits.try_cast("decimal(38,0)"))).when(t != "", stable_hash(t))


def composite_label(parts: Sequence[Value], require_all: bool = False) -> Column:
    """The parts joined by a bar; blank parts are dropped, or, if all are required, make the label null."""
    texts = [F.nullif(stripped(col(p)), F.lit("")) for p in parts]
    label = F.nullif(F.concat_ws("|", *texts), F.lit(""))
    if not require_all:
        return label
    whole = texts[0].isNotNull()
    for t in texts[1:]:
        whole = whole & t.isNotNull()
    return F.when(whole, label)


def composite_id(parts: Sequence[Value], require_all: bool = False) -> Column:
    """The hash of the label; labels are always hashed, also those of one number."""
    return stable_hash(composite_label(parts, require_all))


def triplet_id(plate: Value, mjd: Value, fiber: Value) -> Column:
    return composite_id([plate, mjd, fiber], require_all=True)


def run2d_code(run2d: Value) -> Column:
    """'26' -> 26, 'vN_M_P' -> (N - 5) * 10000 + M * 100 + P; null for other forms."""
    t = stripped(col(run2d))
    part = lambda k: F.regexp_extract(t, r"^v(\d+)_(\d+)_(\d+)$", k).try_cast("long")
    return F.when(t.rlike(r"^\d+$"), t.try_cast("long")).when(t.rlike(r"^v\d+_\d+_\d+$"), (part(1) - 5) * 10000 + part(2) * 100 + part(3))


def _packed(*fields: tuple[Value | int, int]) -> Column:
    out = F.lit(0).cast("long")
    for value, shift in fields:
        out = out.bitwiseOR(F.shiftleft(col(value).cast("long"), shift))
    return out


def spec_id_dr7(plate: Value, mjd: Value, fiber: Value, kind: Value = 0, line: Value = 0) -> Column:
    return _packed((plate, 0), (mjd, 16), (fiber, 32), (kind, 42), (line, 48))


def spec_id_dr8(plate: Value, mjd: Value, fiber: Value, run2d: Value, line: Value = 0) -> Column:
    """run2d: its code, see run2d_code.  Ids above 2^63 wrap to negative longs."""
    return _packed((plate, 50), (fiber, 38), (col(mjd) - 50000, 24), (run2d, 10), (line, 0))


@dataclass(frozen=True)
class LinkMode:
    """How a catalog makes its ids: of a column's values, of a column as a label, or of several columns."""

    kind: str
    columns: tuple[str, ...]

    @classmethod
    def parse(cls, text: str) -> LinkMode:
        kind, colon, rest = text.partition(":")
        columns = tuple(c.strip() for c in rest.split(",") if c.strip())
        if kind not in ("column", "label", "composite") or not colon or not columns or (kind != "composite" and len(columns) > 1):
            raise ValueError(f"not a link mode: {text!r}; use column:C, label:C or composite:A,B")
        return cls(kind, columns)

    def id(self, schema: T.StructType, require_all: bool = False) -> Column:
        if self.kind == "composite":
            return composite_id([F.col(c) for c in self.columns], require_all)
        kind = schema[self.columns[0]].dataType
        if isinstance(kind, (T.ArrayType, T.BooleanType)):
            raise ValueError(f"{self.columns[0]} is of type {kind.simpleString()} and can't be an id")
        return normalize(self.columns[0], kind) if self.kind == "column" else stable_hash(F.col(self.columns[0]).cast("string"))


def radius_token(arcsec: float) -> str:
    """1 -> '1.0', 0.25 -> '0.25': up to six decimals, one at least."""
    text = f"{arcsec:.6f}".rstrip("0")
    return text + "0" if text.endswith(".") else text
