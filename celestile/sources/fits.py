"""FITS binary tables, by the public standard: 2880-byte blocks, big-endian columns.

Tables may lie in any store, plain or packed by gzip.  On a mounted file system tasks read
shares of them, a number of rows at a time; in other stores Spark's binary source reads them
whole.  The schema is that of the first file; it and the counts of rows come from headers
alone, of which the driver reads a few blocks a file.
"""

from __future__ import annotations

import gzip
import math
import os
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import local_path, matching, mounted, read_start

BLOCK = 2880
ROWS_AT_ONCE = 1 << 16
#: Bytes of a file that a task reads at most, and files that it reads in turn.
SHARE_BYTES = 1 << 25
FILES_A_TASK = 500
# Fixed values of the standard: type and Spark type by TFORM letter.
LETTERS = {"L": ("S1", "boolean"), "B": ("u1", "smallint"), "I": (">i2", "smallint"), "J": (">i4", "int"), "K": (">i8", "bigint"), "E": (">f4", "float"), "D": (">f8", "double"), "A": ("S", "string")}


@dataclass
class Unit:
    """One header-data unit: its cards, and where its data lies."""

    cards: dict[str, str | int | float | bool]
    start: int
    size: int
    number: int = 0

    @property
    def is_table(self) -> bool:
        return self.cards.get("XTENSION") == "BINTABLE"

    @property
    def rows(self) -> int:
        return int(self.cards.get("NAXIS2", 0))

    def name(self) -> str:
        return str(self.cards.get("EXTNAME", ""))


@dataclass
class Field:
    name: str
    letter: str
    count: int
    null: int | None = None
    scale: float = 1.0
    zero: float = 0.0
    shape: tuple[int, ...] = field(default=())

    @property
    def dtype(self) -> tuple:
        kind = LETTERS[self.letter][0]
        return (self.name, f"S{self.count}") if self.letter == "A" else (self.name, kind, (self.count,)) if self.count != 1 else (self.name, kind)

    @property
    def spark(self) -> str:
        kind = LETTERS[self.letter][1]
        if self.scale != 1 or (self.zero and self.letter not in "BIJK"):
            kind = "double"
        elif self.zero:
            kind = {"B": "smallint", "I": "int", "J": "bigint", "K": "decimal(20,0)"}[self.letter]
        return kind if self.letter == "A" or self.count == 1 else f"array<{kind}>"


def _value(text: str) -> str | int | float | bool:
    text = text.strip()
    if text.startswith("'"):
        return re.match(r"'((?:[^']|'')*)'", text)[1].replace("''", "'").rstrip() if re.match(r"'((?:[^']|'')*)'", text) else text
    text = text.partition("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    for kind in (int, lambda t: float(t.replace("D", "E"))):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def units_of(read: Callable[[int, int], bytes]) -> Iterator[Unit]:
    """Headers of all units, read(place, size) at a time; a file that ends early gives those that are whole."""
    at = number = 0
    while True:
        cards: dict = {}
        ended = False
        while not ended:
            block = read(at, BLOCK)
            if len(block) < BLOCK:
                return
            for i in range(0, BLOCK, 80):
                card = block[i : i + 80].decode("ascii", "replace")
                if card[:8].rstrip() == "END":
                    ended = True
                    break
                if card[8:10] == "= ":
                    cards[card[:8].rstrip()] = _value(card[10:])
            at += BLOCK
        axes = [int(cards.get(f"NAXIS{k}", 0)) for k in range(1, int(cards.get("NAXIS", 0)) + 1)]
        size = abs(int(cards.get("BITPIX", 8))) // 8 * (math.prod(axes) + int(cards.get("PCOUNT", 0))) * int(cards.get("GCOUNT", 1)) if axes else 0
        yield Unit(cards, at, size, number)
        number += 1
        at += -(-size // BLOCK) * BLOCK


def units(raw: bytes) -> list[Unit]:
    return list(units_of(lambda at, size: raw[at : at + size]))


def plain(raw: bytes) -> bytes:
    """The content of a file, unpacked if it is packed by gzip."""
    return gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


def header_units(spark: SparkSession, path: str) -> list[Unit]:
    """The units of one file; reads its headers, not its data."""
    packed = read_start(spark, path, 0, 2) == b"\x1f\x8b"
    return list(units_of(lambda at, size: read_start(spark, path, at, size, packed)))


def _opened(path: str):
    """(file, whether it is packed): a file of a mounted file system, unpacked as it is read."""
    f = open(path, "rb")
    packed = f.read(2) == b"\x1f\x8b"
    f.seek(0)
    return (gzip.open(f), True) if packed else (f, False)


def _reads(f) -> Callable[[int, int], bytes]:
    def read(at: int, size: int) -> bytes:
        f.seek(at)
        return f.read(size)

    return read


def local_units(path: str) -> list[Unit]:
    f, _ = _opened(path)
    with f:
        return list(units_of(_reads(f)))


def fields(unit: Unit) -> list[Field]:
    out = []
    for k in range(1, int(unit.cards.get("TFIELDS", 0)) + 1):
        form = re.match(r"\s*(\d*)([A-Z])", str(unit.cards[f"TFORM{k}"]))
        count = int(form[1]) if form[1] else 1
        if form[2] not in LETTERS:
            raise ValueError(f"columns of form {form[0]!r} aren't supported")
        dims = re.findall(r"\d+", str(unit.cards.get(f"TDIM{k}", "")))
        out.append(Field(str(unit.cards.get(f"TTYPE{k}", f"col{k}")).strip(), form[2], count, unit.cards.get(f"TNULL{k}"), float(unit.cards.get(f"TSCAL{k}", 1)), float(unit.cards.get(f"TZERO{k}", 0)), tuple(int(d) for d in reversed(dims))))
    names = [f.name for f in out]
    if len(set(names)) < len(names):
        raise ValueError("two columns have the same name")
    return out


def choose_units(found: list[Unit], spec: str = "1") -> list[Unit]:
    """A number, EXTNAME, 'EXTNAME,EXTVER', or 'all' for every table."""
    tables = [u for u in found if u.is_table]
    if spec == "all":
        own = tables
    elif spec.isdigit():
        own = [u for u in found if u.number == int(spec) and u.is_table]
    else:
        name, _, version = spec.partition(",")
        own = [u for u in tables if u.name() == name.strip() and (not version or int(u.cards.get("EXTVER", 1)) == int(version))]
    if not own:
        raise ValueError(f"no table {spec!r}; there are {', '.join(f'{u.number} {u.name()}' for u in tables) or 'none'}")
    return own


def spark_schema(own: list[Field]) -> T.StructType:
    out = T.StructType()
    for f in own:
        out = out.add(T.StructField(f.name, T._parse_datatype_string(f.spark), True, {"inner_shape": list(f.shape)} if len(f.shape) > 1 else {}))
    return out


def _lists(flat: pa.Array, rows: int, count: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows * count + 1, count), pa.int32()), flat)


def decode(raw: bytes, unit: Unit) -> dict[str, pa.Array]:
    """Columns of a table as Arrow arrays: masked values are null, texts are stripped."""
    own = fields(unit)
    if unit.cards.get("ZTABLE") is True:
        raise ValueError("tables packed by tiles (ZTABLE) aren't supported")
    table = np.frombuffer(raw, np.dtype([f.dtype for f in own]), unit.rows, unit.start)
    out: dict[str, pa.Array] = {}
    for f in own:
        v = table[f.name]
        if f.letter == "A":
            out[f.name] = pa.array([x.decode("utf-8", "replace").rstrip("\0 ") for x in v.tolist()], pa.string())
            continue
        flat = v.reshape(-1)
        gone = flat == f.null if f.null is not None and f.letter in "BIJK" else None
        if f.letter == "L":
            made = pa.array(flat == b"T", mask=flat == b"\0")
        elif f.scale != 1 or (f.zero and f.letter not in "BIJK"):
            made = pa.array(flat.astype(float) * f.scale + f.zero, mask=gone)
        elif f.zero and f.letter == "K":
            from decimal import Decimal

            whole = (int(x) + int(f.zero) for x in flat.tolist())
            made = pa.array([None if gone is not None and gone[i] else Decimal(x) for i, x in enumerate(whole)], pa.decimal128(20, 0))
        elif f.zero:
            made = pa.array(flat.astype(np.int64) + int(f.zero), mask=gone)
        else:
            made = pa.array(np.ascontiguousarray(flat.astype(flat.dtype.newbyteorder("="))), mask=gone)
        out[f.name] = made if f.count == 1 else _lists(made, unit.rows, f.count)
    return out


def read_fits(spark: SparkSession, path: str, hdu: str = "1", with_path: bool = False) -> DataFrame:
    """Tables of FITS files; several units are stacked: their columns must have the same names, types may be narrower than the first's."""
    found = matching(spark, path)
    if not found:
        raise FileNotFoundError(path)
    schema = spark_schema(fields(choose_units(header_units(spark, found[0]), hdu)[0]))
    out = T.StructType([*schema.fields, *([T.StructField("input_path", T.StringType())] if with_path else [])])

    def made(name: str, raw: bytes, unit: Unit) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, columns = to_arrow_schema(out), decode(raw, unit)
        if list(columns) != schema.names:
            raise ValueError(f"{name}, unit {unit.number}: columns differ from the first table's")
        if with_path:
            columns["input_path"] = pa.array([name] * unit.rows, pa.string())
        table = pa.table([columns[f.name].cast(f.type) for f in arrow], schema=arrow)
        yield from table.to_batches(max_chunksize=ROWS_AT_ONCE)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, raw = batch.column(0)[i].as_py(), plain(batch.column(1)[i].as_py())
                for unit in choose_units(units(raw), hdu):
                    yield from made(name, raw, unit)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, k in (tuple(r.values()) for batch in batches for r in batch.to_pylist()):
            own = mounted(name)
            f, packed = _opened(own)
            with f:
                if packed and k:
                    continue
                last = k == max(0, os.path.getsize(own) - 1) // SHARE_BYTES
                for unit in choose_units(list(units_of(_reads(f))), hdu):
                    width = int(unit.cards["NAXIS1"])
                    # the rows that begin within this share of the file; the last has the rest, so that a file cut short is an error
                    begin = lambda x, unit=unit, width=max(1, width): min(unit.rows, max(0, -((unit.start - x) // width)))
                    low, high = 0 if packed or k == 0 else begin(k * SHARE_BYTES), unit.rows if packed or last else begin((k + 1) * SHARE_BYTES)
                    for at in range(low, high, ROWS_AT_ONCE) or ([low] if k == 0 else []):
                        n = min(ROWS_AT_ONCE, high - at)
                        raw = _reads(f)(unit.start + at * width, n * width)
                        yield from made(name, raw, Unit(unit.cards | {"NAXIS2": n}, 0, n * width, unit.number))

    top, _, last = path.rpartition("/")
    source = spark.read.format("binaryFile")
    # the files of a pattern in one folder are listed once, and not each as a folder of its own
    files = source.option("pathGlobFilter", last).load(top) if set("*?") & set(last) and not set("*?[]{}\\") & set(top) else source.load(path)
    if local_path(spark, path) is None:
        return files.select("path", "content").mapInArrow(whole, out)
    parts = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("length") - 1) / SHARE_BYTES)).cast("int"))).alias("k")
    # by number of files, which are known here; adaptive execution would take their few bytes for one task's work
    tasks = max(spark.sparkContext.defaultParallelism, -(-len(found) // FILES_A_TASK))
    return files.select("path", parts).repartition(tasks).mapInArrow(shares, out)


def row_count(spark: SparkSession, path: str, hdu: str = "1") -> int:
    """Rows by the headers; no data is read."""
    read = (lambda p: local_units(mounted(p))) if local_path(spark, path) else (lambda p: header_units(spark, p))
    with ThreadPoolExecutor(16) as pool:
        return sum(pool.map(lambda p: sum(u.rows for u in choose_units(read(p), hdu)), matching(spark, path)))


def unpacked(df: DataFrame) -> DataFrame:
    """A table whose rows hold whole columns as arrays -> one row an element."""
    arrays = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]
    return df.select(F.inline(F.arrays_zip(*arrays)))


def _card(key: str, value: str | int | bool) -> bytes:
    text = f"'{value:<8}'" if isinstance(value, str) else f"{'T' if value else 'F':>20}" if isinstance(value, bool) else f"{value:>20}"
    return f"{key:<8}= {text}".ljust(80)[:80].encode()


def _header(cards: list[bytes]) -> bytes:
    raw = b"".join([*cards, b"END".ljust(80)])
    return raw.ljust(-(-len(raw) // BLOCK) * BLOCK)


def encode(table: pa.Table, name: str = "CATALOG", widths: dict[str, int] | None = None) -> bytes:
    """A FITS file with one binary table.  Null texts become empty, null numbers NaN or the smallest number (TNULL).

    widths: bytes of a text column, elements of an array column; by default those of the table.
    """
    widths = widths or {}
    kinds, cards, columns = [], [], []
    for k, f in enumerate(table.schema, 1):
        x = table.column(k - 1).to_pandas()
        inner = f.type.value_type if pa.types.is_list(f.type) else f.type
        count = widths.get(f.name) or max((len(v) for v in x if v is not None), default=1) if pa.types.is_list(f.type) else 1
        if pa.types.is_string(inner) or pa.types.is_large_string(inner):
            raw = [b"" if v is None else v.encode() for v in x]
            width = widths.get(f.name) or max(1, max(map(len, raw), default=1))
            v, form, dtype = np.array(raw, f"S{width}"), f"{width}A", f"S{width}"
        elif pa.types.is_boolean(inner):
            v, form, dtype = np.array([b"\0" if b is None else b"T" if b else b"F" for b in x]), "L", "S1"
        else:
            whole = pa.types.is_integer(inner)
            dtype, letter = (">i8", "K") if whole else (">f4", "E") if pa.types.is_float32(inner) else (">f8", "D")
            gap = np.iinfo(np.int64).min if whole else np.nan
            fill = lambda e, gap=gap: gap if e is None or (isinstance(e, float) and whole and math.isnan(e)) else e  # noqa: E731, B023
            if pa.types.is_list(f.type):
                v = np.array([[fill(e) for e in (row if row is not None else [])] + [gap] * (count - len(row if row is not None else [])) for row in x], dtype).reshape(len(x), count)
            else:
                v = np.array([fill(e) for e in table.column(k - 1).to_pylist()], dtype)
            form = f"{count}{letter}"
            if whole:
                cards.append(_card(f"TNULL{k}", int(gap)))
        cards += [_card(f"TTYPE{k}", f.name), _card(f"TFORM{k}", form)]
        kinds.append((f"c{k}", dtype, (count,)) if pa.types.is_list(f.type) and count != 1 else (f"c{k}", dtype))
        columns.append(v)
    rows = np.zeros(table.num_rows, np.dtype(kinds) if kinds else np.dtype([("c", "u1")]))
    for (key, *_), v in zip(kinds, columns, strict=True):
        rows[key] = v.reshape(rows[key].shape)
    data = rows.tobytes()
    primary = _header([_card("SIMPLE", True), _card("BITPIX", 8), _card("NAXIS", 0), _card("EXTEND", True)])
    head = [_card("XTENSION", "BINTABLE"), _card("BITPIX", 8), _card("NAXIS", 2), _card("NAXIS1", rows.dtype.itemsize), _card("NAXIS2", table.num_rows), _card("PCOUNT", 0), _card("GCOUNT", 1), _card("TFIELDS", len(kinds)), _card("EXTNAME", name)]
    return primary + _header(head + cards) + data.ljust(-(-len(data) // BLOCK) * BLOCK, b"\0")


def format_report(raw: bytes) -> pd.DataFrame:
    """Unit by unit: kind, name, rows, columns, and whether its data is whole."""
    return pd.DataFrame([{"unit": u.number, "kind": u.cards.get("XTENSION", "PRIMARY"), "name": u.name(), "rows": u.rows if u.is_table else 0, "columns": int(u.cards.get("TFIELDS", 0)), "whole": u.start + u.size <= len(raw)} for u in units(raw)])
