"""Sinks: extracts, region and coverage files, archives with checksums."""

from __future__ import annotations

import hashlib
import io
import json
import os
import tarfile
from collections.abc import Callable, Iterable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import healpix, text
from ..functions.columns import Value, col
from ..functions.sphere import valid_sky
from ..operators.predicates import checked
from ..plans.region import in_pixels
from . import files, fits

#: Extracts in one file (FITS, VOTable) pass through the driver, up to so many rows.
ONE_FILE_ROWS = 2_000_000
#: Rows that a task writes as FITS parts, if a part doesn't hold more.
ROWS_A_TASK = 1 << 17


def write_extract(df: DataFrame, path: str, kind: str = "parquet", pixel: str | None = None) -> None:
    """parquet, csv, fits or votable; with ``pixel`` a tree of tiles (Parquet only).

    CSV and FITS have no nulls: texts become empty, numbers empty or NaN.
    """
    if pixel:
        if kind != "parquet":
            raise ValueError("trees of tiles are Parquet")
        df.withColumns({"Dir": healpix.dir_bucket(pixel), "Npix": F.col(pixel)}).repartition("Npix").write.partitionBy("Dir", "Npix").parquet(path)
    elif kind == "parquet":
        df.write.option("compression", "zstd").parquet(path)
    elif kind == "csv":
        df.write.options(header=True, nullValue="", emptyValue="").csv(path)
    elif kind in ("fits", "votable"):
        table = df.limit(ONE_FILE_ROWS + 1).toArrow()
        if table.num_rows > ONE_FILE_ROWS:
            raise ValueError(f"an extract in one file has at most {ONE_FILE_ROWS} rows; write Parquet instead")
        raw = fits.encode(table) if kind == "fits" else votable(df.schema, table.to_pylist()).encode()
        files.write_bytes(df.sparkSession, path, raw)
    else:
        raise ValueError(f"unknown format {kind!r}")


VOTABLE_NAMES = {"boolean": "boolean", "smallint": "short", "tinyint": "short", "int": "int", "bigint": "long", "float": "float", "double": "double"}


def votable(schema: T.StructType, rows: Iterable[dict]) -> str:
    tags = []
    for f in schema:
        kind = VOTABLE_NAMES.get(f.dataType.simpleString())
        tags.append(f'<FIELD name="{escape(f.name)}" datatype="{kind or "char"}"{"" if kind else " arraysize=" + chr(34) + "*" + chr(34)}/>')
    cells = ("<TR>" + "".join(f"<TD>{'' if r[f.name] is None else escape(str(r[f.name]))}</TD>" for f in schema) + "</TR>" for r in rows)
    return '<?xml version="1.0"?>\n<VOTABLE version="1.4"><RESOURCE><TABLE>\n' + "\n".join(tags) + "\n<DATA><TABLEDATA>\n" + "\n".join(cells) + "\n</TABLEDATA></DATA></TABLE></RESOURCE></VOTABLE>\n"


def with_provenance(spark: SparkSession, path: str, info: dict) -> None:
    files.write_text(spark, f"{path}/product_info.json", json.dumps(info, indent=1, default=str))


def write_moc(spark: SparkSession, path: str, pixels: Iterable[int], order: int, kind: str = "ascii") -> None:
    """A coverage map of bounded size (of tiles or a region), merged upwards."""
    cells = healpix.merge_cells({(order, p) for p in pixels})
    if kind == "json":
        orders = sorted({o for o, _ in cells})
        files.write_text(spark, path, json.dumps({str(o): sorted(p for q, p in cells if q == o) for o in orders}))
    else:
        files.write_text(spark, path, healpix.moc_ascii(cells) + "\n")


def write_mocs(spark: SparkSession, footprints: dict[str, DataFrame], order: int, folder: str) -> dict[str, str]:
    """One map a survey; those that are there stay, and an error doesn't stop the others."""
    out = {}
    for name, df in footprints.items():
        path = f"{folder}/{name}.moc"
        if files.exists(spark, path):
            out[name] = "skipped"
            continue
        try:
            write_moc(spark, path, [r[0] for r in df.toLocalIterator()], order)
            out[name] = "ok"
        except Exception as e:
            out[name] = f"{type(e).__name__}: {e}"
    return out


def ds9_circle(ra: Value, dec: Value, radius_arcsec: float) -> Column:
    return F.format_string(f'circle(%.8f,%.8f,{radius_arcsec:g}")', col(ra).cast("double"), col(dec).cast("double"))


def ds9_polygon(pix: int, order: int) -> str:
    return "polygon(" + ",".join(f"{v:.8f}" for corner in healpix.corners(pix, order) for v in corner) + ")"


def sky_rows(df: DataFrame, ra: str = "ra", dec: str = "dec", *, where: str | None = None, pixel: str | None = None, pixels: list[int] | None = None, limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    """The rows that a region file shows: valid positions, a predicate, tiles, and then a limit (in ``order``)."""
    own = df.where(valid_sky(ra, dec))
    own = in_pixels(own, pixel, pixels) if pixel and pixels is not None else own
    own = own.where(F.expr(checked(where))) if where else own
    return own if limit is None else (own.orderBy(*order) if order else own).limit(limit)


def write_source_regions(df: DataFrame, path: str, ra: str = "ra", dec: str = "dec", radius_arcsec: float = 1.0) -> None:
    """One circle a source, as text files."""
    df.select(ds9_circle(ra, dec, radius_arcsec).alias("value")).write.text(path)


def write_footprint_regions(spark: SparkSession, path: str, pixels: Iterable[int], order: int) -> None:
    lines = ["# Region file format: DS9", "icrs", *(ds9_polygon(p, order) for p in sorted(pixels))]
    files.write_text(spark, path, "\n".join(lines) + "\n")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 of every file below."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select("path", F.col("length").alias("size"), text.checksum("content").alias("sha256"))


class _Sink:
    """A file object over a function that takes bytes."""

    def __init__(self, write: Callable[[bytes], None]):
        self.write = write


def pack_tile(spark: SparkSession, folder: str, archive: str) -> dict:
    """A tile's files as one tar with a manifest of their checksums; they pass through the driver in chunks."""
    listed, top = [], folder.rstrip("/").rsplit("/", 1)[1]
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).orderBy("path")
    with files.writing(spark, archive) as out, tarfile.open(fileobj=_Sink(out), mode="w|", bufsize=files.CHUNK) as tar:
        for r in found.select("path", "length").toLocalIterator():
            entry = tarfile.TarInfo(r["path"].rpartition(f"/{top}/")[2])
            entry.size = r["length"]
            with files.opened(spark, r["path"]) as source:
                own = files.Hashed(source)
                tar.addfile(entry, own)
            listed.append({"name": entry.name, "size": entry.size, "sha256": own.sum.hexdigest()})
        raw = json.dumps({"files": listed}, indent=1).encode()
        entry = tarfile.TarInfo("manifest.json")
        entry.size = len(raw)
        tar.addfile(entry, io.BytesIO(raw))
    return {"files": listed}


def verify_tile(spark: SparkSession, archive: str) -> list[str]:
    """What is wrong with an archive; it is read once, in chunks."""
    own, manifest = {}, b""
    with files.opened(spark, archive) as source, tarfile.open(fileobj=source, mode="r|", bufsize=files.CHUNK) as tar:
        for m in tar:
            content = tar.extractfile(m)
            if m.name == "manifest.json":
                manifest = content.read()
                continue
            part = files.Hashed(content)
            while part.read(files.CHUNK):
                pass
            own[m.name] = part.sum.hexdigest()
    wanted = json.loads(manifest)["files"]
    out = [f"{w['name']} is missing" for w in wanted if w["name"] not in own]
    out += [f"{w['name']} has changed" for w in wanted if own.get(w["name"], w["sha256"]) != w["sha256"]]
    return out + [f"{n} isn't listed" for n in own if n not in {w["name"] for w in wanted}]


def write_parts(df: DataFrame, path: str, rows_a_file: int) -> None:
    """Spectra or cutouts as files of bounded size."""
    df.write.option("maxRecordsPerFile", rows_a_file).option("compression", "zstd").parquet(path)


def _layout(df: DataFrame) -> dict[str, int]:
    """Bytes of each text column and elements of each array column, one pass: what a FITS table must know before its first row."""
    wide = {f.name: F.max(F.octet_length(f.name)) for f in df.schema if isinstance(f.dataType, T.StringType)}
    wide |= {f.name: F.max(F.size(f.name)) for f in df.schema if isinstance(f.dataType, T.ArrayType)}
    if not wide:
        return {}
    found = df.agg(*(c.alias(n) for n, c in wide.items())).first()
    return {n: max(1, found[n] or 0) for n in wide}


def write_fits_parts(df: DataFrame, folder: str, order: list[str], rows_a_part: int = 50_000, resume: bool = False) -> dict:
    """df as FITS files of up to rows_a_part rows each, in ``order``, and a manifest.

    Executors encode parts, a task many of them one after the other, and write them where the
    folder is mounted; else the driver writes them one at a time.  No task holds more than a part.
    With ``resume`` parts that are there stay.  All parts have one layout, so they can be merged.
    ``order`` should tell all rows apart: a part is then the same in every run.
    """
    spark, widths, schema = df.sparkSession, _layout(df), df.schema
    n = df.count()
    placed = df.repartitionByRange(max(1, -(-n // max(rows_a_part, ROWS_A_TASK))), *order).sortWithinPartitions(*order)
    mounted = files.local_path(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal number
            table = pa.Table.from_batches(rows)
            name = f"part-{part:06d}-{number:04d}.fits"
            number += 1
            raw = fits.encode(table, widths=widths)
            if mounted and not (resume and os.path.exists(f"{mounted}/{name}")):
                files.put(f"{mounted}/{name}", raw)
            own = {"name": [name], "rows": [table.num_rows], "sha256": [hashlib.sha256(raw).hexdigest()], "content": [None if mounted else raw]}
            return pa.RecordBatch.from_pydict(own, pa.schema([("name", pa.string()), ("rows", pa.int64()), ("sha256", pa.string()), ("content", pa.binary())]))

        for batch in batches:
            while batch.num_rows:
                take = min(batch.num_rows, rows_a_part - size)
                held.append(batch.slice(0, take))
                batch, size = batch.slice(take), size + take
                if size == rows_a_part:
                    yield close(held)
                    held, size = [], 0
        if held:
            yield close(held)

    made, listed = placed.mapInArrow(run, "name string, rows long, sha256 string, content binary"), []
    for r in sorted(made.collect()) if mounted else made.toLocalIterator():
        path = f"{folder}/{r['name']}"
        if not mounted and not (resume and files.exists(spark, path)):
            files.write_bytes(spark, path, bytes(r["content"]))
        listed.append({k: r[k] for k in ("name", "rows", "sha256")})
    if not listed:
        raw = fits.encode(schema_table(schema), widths=widths)
        files.write_bytes(spark, f"{folder}/part-000000-0000.fits", raw)
        listed.append({"name": "part-000000-0000.fits", "rows": 0, "sha256": hashlib.sha256(raw).hexdigest()})
    manifest = {"rows": n, "rows_a_part": rows_a_part, "parts": listed}
    files.write_text(spark, f"{folder}/manifest.json", json.dumps(manifest, indent=1))
    return manifest


def schema_table(schema: T.StructType) -> pa.Table:
    """An empty table of a schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).empty_table()


def merge_fits_parts(spark: SparkSession, folder: str, path: str) -> int:
    """The parts of a folder as one FITS file, appended part by part; the number of rows."""
    listed = json.loads(files.read_text(spark, f"{folder}/manifest.json"))["parts"]
    total = sum(p["rows"] for p in listed)
    mounted = files.local_path(spark, folder)
    with files.writing(spark, path) as write:
        size, held = 0, bytearray()

        def out(raw: bytes, least: int = files.CHUNK) -> None:
            held.extend(raw)
            if len(held) >= least:
                write(bytes(held))
                held.clear()

        for k, p in enumerate(listed):
            with open(f"{mounted}/{p['name']}", "rb") if mounted else files.opened(spark, f"{folder}/{p['name']}") as part:
                raw = part.read()
            unit = next(u for u in fits.units_of(lambda at, n, raw=raw: raw[at : at + n]) if u.is_table)
            if k == 0:
                head = raw[: unit.start]
                card = next(i for i in range(fits.BLOCK, len(head), 80) if head[i : i + 8] == b"NAXIS2  ")
                out(head[:card] + fits._card("NAXIS2", total) + head[card + 80 :])
            data = raw[unit.start : unit.start + int(unit.cards["NAXIS1"]) * unit.rows]
            out(data)
            size += len(data)
        out(b"\0" * (-size % fits.BLOCK), 0)
    return total


def fits_differences(df: DataFrame, path: str) -> dict[str, int]:
    """Rows of df that a FITS extract (file or folder of parts) lacks, and rows that it has besides: a round trip.

    FITS has no null texts, and numbers of other widths: both sides are compared in the form that it gives.
    """
    back = fits.read_fits(df.sparkSession, path)
    kinds = dict(back.dtypes)

    def form(c: str, kind: str) -> Column:
        own = F.col(c)
        if kind == "string":
            return F.coalesce(F.rtrim(own), F.lit(""))
        if kind in ("float", "double"):
            return F.coalesce(own.cast(kind), F.lit(float("nan")).cast(kind))
        return own.cast(kind)

    one, other = (x.select(*(form(c, kinds[c]).alias(c) for c in back.columns), F.lit(n).alias("_n")) for x, n in ((df, 1), (back, -1)))
    each = one.unionByName(other).groupBy(*back.columns).agg(F.sum("_n").alias("_n"))
    found = each.agg(*(F.coalesce(F.sum(F.greatest(F.lit(0), s * F.col("_n"))), F.lit(0)).alias(k) for k, s in (("missing", 1), ("besides", -1)))).first()
    return found.asDict()


def write_registry(reg: DataFrame, tiles: dict[str, DataFrame], folder: str) -> None:
    """The registry of surveys, and the tiles of each with their rows, as Parquet; rewritten whole."""
    reg.write.mode("overwrite").parquet(f"{folder}/surveys.parquet")
    for name, df in tiles.items():
        df.write.mode("overwrite").parquet(f"{folder}/tiles/{name}.parquet")


def write_bridge(bridge: DataFrame, path: str) -> None:
    """The sidecar of a target list: its identity columns with the ids they lead to, sorted by id."""
    bridge.repartitionByRange("_source_id").sortWithinPartitions("_source_id").write.option("compression", "zstd").parquet(path)
