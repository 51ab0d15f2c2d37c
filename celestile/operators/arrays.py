"""Spectra and cutouts as rows: packed records, widths, coordinates of pixels."""

from __future__ import annotations

import struct
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import Value, col
from ..functions.spectra import padded

# The packed records that stand beside an array, little-endian and without gaps: name and form of each field.
META = (("z", "f"), ("z_err", "f"), ("snr", "f"), ("exptime", "f"), ("R", "f"), ("instr", "16s"), ("ra_key", "32s"), ("dec_key", "32s"), ("ra", "f"), ("dec", "f"), ("source_file", "128s"))
WCS = (("crval1", "d"), ("crval2", "d"), ("crpix1", "d"), ("crpix2", "d"), ("cd1_1", "d"), ("cd1_2", "d"), ("cd2_1", "d"), ("cd2_2", "d"), ("naxis1", "i"), ("naxis2", "i"))
# What fills up an array that is too short.
FILL = {"flux": float("nan"), "ivar": 0.0, "mask": 1, "wavelength": 0.0}
Layout = Sequence[tuple[str, str]]
KINDS = {"f": "float", "d": "double", "i": "int"}


def _form(layout: Layout) -> struct.Struct:
    return struct.Struct("<" + "".join(form for _, form in layout))


def unpacked_record(packed: Value, layout: Layout = META) -> Column:
    """The record's fields as a struct: texts without the zeros that fill them up; null for null and for records of another size."""
    schema = ", ".join(f"`{n}` {KINDS.get(form, 'string')}" for n, form in layout)

    @F.pandas_udf(schema)
    def unpack(raw: pd.Series) -> pd.DataFrame:
        form = _form(layout)
        rows = [form.unpack(r) if r is not None and len(r) == form.size else (None,) * len(layout) for r in map(lambda r: None if r is None else bytes(r), raw)]
        text = lambda v: v.rstrip(b"\0").decode("ascii", "replace") if isinstance(v, bytes) else v
        return pd.DataFrame([[text(v) for v in r] for r in rows], columns=[n for n, _ in layout])

    got = unpack(col(packed))
    return F.when(F.length(col(packed)) == _form(layout).size, got)


def packed_record(fields: dict[str, Value], layout: Layout = META) -> Column:
    """The record of these fields: missing and null numbers 0, texts cut and filled up with zeros."""

    @F.pandas_udf("binary")
    def pack(own: pd.DataFrame) -> pd.Series:
        form = _form(layout)
        kinds = dict(layout)

        def value(name: str, v: object) -> object:
            gone = v is None or v != v
            if kinds[name].endswith("s"):
                return b"" if gone else str(v).encode("ascii", "replace")
            return 0 if gone else int(v) if kinds[name] == "i" else float(v)

        return pd.Series([form.pack(*(value(n, v) for (n, _), v in zip(layout, row, strict=True))) for row in own.itertuples(index=False)])

    return pack(F.struct(*((col(fields[n]) if n in fields else F.lit(None)).cast(KINDS.get(form, "string")).alias(n) for n, form in layout)))


def pixel_to_sky(wcs: Value, x: Value, y: Value) -> Column:
    """ra and dec (struct) of a pixel, counted from 1, by the gnomonic (TAN) projection that a WCS record describes."""
    w = col(wcs)
    dx, dy = col(x) - w["crpix1"], col(y) - w["crpix2"]
    xi = F.radians(w["cd1_1"] * dx + w["cd1_2"] * dy)
    eta = F.radians(w["cd2_1"] * dx + w["cd2_2"] * dy)
    a0, d0 = F.radians(w["crval1"]), F.radians(w["crval2"])
    low = F.cos(d0) - eta * F.sin(d0)
    ra = F.degrees(a0 + F.atan2(xi, low))
    dec = F.degrees(F.atan2(F.sin(d0) + eta * F.cos(d0), F.sqrt(xi * xi + low * low)))
    return F.struct(F.pmod(ra + 360.0, F.lit(360.0)).alias("ra"), dec.alias("dec"))


def wcs_cards(wcs: Value) -> Column:
    """The header keywords of a WCS record as a map of texts."""
    w = col(wcs)
    text = lambda c: c.cast("string")
    fixed = {"CTYPE1": F.lit("RA---TAN"), "CTYPE2": F.lit("DEC--TAN"), "CUNIT1": F.lit("deg"), "CUNIT2": F.lit("deg")}
    own = fixed | {n.upper(): text(w[n]) for n, _ in WCS}
    return F.create_map(*(x for k, v in own.items() for x in (F.lit(k), v)))


def widest(df: DataFrame, array: str = "flux") -> int:
    """The most elements an array of the table has."""
    return df.agg(F.max(F.size(array))).first()[0] or 0


def widened(df: DataFrame, width: int | None = None, arrays: Sequence[str] = ("flux", "ivar", "mask", "wavelength"), policy: str = "pad") -> DataFrame:
    """Arrays of one width (that of the widest, if None): short ones are filled up by kind.

    policy: pad (longer arrays raise), truncate (longer ones are cut), error (any other width raises).
    Null arrays stay null.
    """
    own = [a for a in arrays if a in df.columns]
    width = widest(df, own[0]) if width is None else width

    def made(name: str) -> Column:
        c = F.col(name)
        short = padded(name, width, FILL.get(name, 0.0))
        wrong = F.raise_error(F.concat(F.lit(f"{name} has "), F.size(c).cast("string"), F.lit(f" elements, not {width}")))
        if policy == "error":
            return F.when(c.isNull() | (F.size(c) == width), c).otherwise(wrong)
        if policy == "truncate":
            return F.when(c.isNotNull(), F.slice(short, 1, width))
        if policy != "pad":
            raise ValueError(f"unknown policy {policy!r}")
        return F.when(c.isNull(), c).when(F.size(c) <= width, short).otherwise(wrong)

    return df.withColumns({a: made(a) for a in own})


def sky_sample(df: DataFrame, ra: str, dec: str, rows: int = 500_000, seed: int = 0) -> DataFrame:
    """About ``rows`` positions, the same for every layout of the table: chosen by a hash of position and seed."""
    n = df.count()
    share = 1.0 if n <= rows else rows / n
    own = df.select(F.col(ra).cast("double").alias("ra"), F.col(dec).cast("double").alias("dec"))
    chosen = F.pmod(F.xxhash64(F.lit(seed), "ra", "dec"), F.lit(1 << 32)) < F.lit(int(share * (1 << 32)))
    return own if share == 1.0 else own.where(chosen)
