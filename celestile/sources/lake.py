"""The layout of a lake: catalogs as pixel tiles, with JSON descriptors beside them.

A tile is a directory Norder=o/Dir=d/Npix=p, so that Spark prunes partitions by pixel.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import healpix
from ..functions.ids import LinkMode
from ..functions.sphere import valid_sky
from ..operators.dedup import DuplicateIds, deduplicated
from ..operators.predicates import is_reserved, with_constants
from . import files
from .readers import canonical

LAYERS = ("catalogs", "products", "crossmatch", "areas", "shared", "cutouts", "spectra")
INDEXES = ("_cutout_index", "_spectrum_index")
# What marks a column as photometry, as catalogs name them.
PHOTOMETRY_MARKS = ("MAG", "FLUX", "MPRO", "MMOD", "AB", "VEGA")


def role_of(name: str) -> str:
    """A column's role by its name."""
    low, up = name.lower(), name.upper()
    if low == "_source_id" or low.endswith(("_id", "targetid", "source_id")):
        return "id"
    if low.startswith("_healpix"):
        return "healpix"
    if low in INDEXES or low.endswith("_npix"):
        return "index"
    if low in ("ra", "dec", "target_ra", "target_dec", "alpha", "delta"):
        return "sky"
    if low in ("z", "zerr", "z_err", "redshift", "zwarn") or low.startswith("z_"):
        return "redshift"
    if low.endswith(("class", "type")) or low.startswith("class"):
        return "classification"
    return "photometry" if any(m in up for m in PHOTOMETRY_MARKS) else "science"


def column_groups(names: Sequence[str]) -> dict[str, list[str]]:
    """Columns by the part before the first underscore, where two or more share it."""
    groups: dict[str, list[str]] = {}
    for n in names:
        head, sep, _ = n.partition("_")
        if sep and head:
            groups.setdefault(head, []).append(n)
    return {k: v for k, v in groups.items() if len(v) > 1}


def manifest(df: DataFrame, overlay: dict[str, dict] | None = None) -> dict:
    """Type, nullability and role of each column, with what an overlay adds (unit, description, AB offset)."""
    own = [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable, "role": role_of(f.name)} | (overlay or {}).get(f.name, {}) for f in df.schema]
    return {"columns": own, "groups": column_groups(df.columns)}


PLACE = ("_file", "_row")
INVALID = "invalid position"


def with_place(df: DataFrame) -> DataFrame:
    """df with where each row stood: its file and its number there, as far as the source tells; else its number alone."""
    for more in ({"_file": "_metadata.file_path", "_row": "_metadata.row_index"}, {"_file": "_metadata.file_path"}, {}):
        try:
            out = df.withColumns({k: F.col(v) for k, v in more.items()})
            out.schema  # noqa: B018
        except AnalysisException:
            continue
        return out if "_row" in more else out.withColumn("_row", F.monotonically_increasing_id())
    raise AssertionError


@dataclass
class Lake:
    spark: SparkSession
    root: str

    def path(self, layer: str, survey: str) -> str:
        if layer not in LAYERS:
            raise ValueError(f"unknown layer {layer!r}")
        return f"{self.root}/{layer}/{survey}"

    def create(self, config: dict | None = None) -> None:
        for layer in LAYERS:
            files.write_text(self.spark, f"{self.root}/{layer}/.keep", "")
        files.write_text(self.spark, f"{self.root}/lake.json", json.dumps(config or {}, indent=1))

    def surveys(self, layer: str = "catalogs") -> list[str]:
        return [s for s in files.children(self.spark, f"{self.root}/{layer}") if not s.startswith(".")]

    def info(self, survey: str, layer: str = "catalogs") -> dict:
        return json.loads(files.read_text(self.spark, f"{self.path(layer, survey)}/catalog_info.json"))

    def catalog(self, survey: str, layer: str = "catalogs", order: int | None = None) -> DataFrame:
        """The survey's rows; Npix is the partition column to filter tiles by."""
        order = self.info(survey, layer)["healpix_order"] if order is None else order
        return self.spark.read.parquet(f"{self.path(layer, survey)}/Norder={order}")

    def register(self, survey: str, view: str | None = None, layer: str = "catalogs") -> str:
        name = view or "catalog"
        self.catalog(survey, layer).createOrReplaceTempView(name)
        return name

    def tiles(self, survey: str, layer: str = "catalogs") -> DataFrame:
        return self.catalog(survey, layer).select("Npix").distinct()

    def ingest(self, df: DataFrame, survey: str, *, ra: str, dec: str, link: str, order: int = 5, constants: Sequence[str] = (), on_duplicate: str | None = None, mode: str = "error", require_all_parts: bool = False, layer: str = "catalogs") -> dict:
        """Types, ids, pixels, duplicates, tiles, descriptor.  One pass over the source, which ends at the first invalid position.

        Of rows of one id the first or last in the order of files and their rows stays, by
        ``on_duplicate`` (skip, last, error); with ``mode`` append it also holds against
        what the tiles have.
        """
        placed = with_place(df) if on_duplicate in ("skip", "last") else df
        df = with_constants(canonical(placed), constants)
        df = df.withColumn(ra, F.when(valid_sky(ra, dec), F.col(ra)).otherwise(F.raise_error(F.concat_ws(" ", F.lit(INVALID), F.col(ra).cast("string"), F.col(dec).cast("string")))))
        made = df.withColumn("_source_id", LinkMode.parse(link).id(df.schema, require_all_parts))
        made = healpix.with_pixel(made, ra, dec, order, f"_healpix_order{order}")
        made = made.withColumns({c: F.lit(-1).cast("long") for c in INDEXES if c not in df.columns})
        try:
            if on_duplicate:
                made = deduplicated(made, "_source_id", [c for c in PLACE if c in made.columns], on_duplicate).drop(*PLACE)
            return self.write_tiles(made, survey, order=order, layer=layer, mode=mode, on_duplicate=on_duplicate or "append", about={"ra_column": ra, "dec_column": dec, "link_id_mode": link})
        except Exception as e:
            if INVALID in str(e):
                raise ValueError(str(e)[str(e).index(INVALID) :].split("\n")[0]) from e
            raise

    def write_tiles(self, df: DataFrame, survey: str, *, order: int, layer: str = "catalogs", mode: str = "error", on_duplicate: str = "append", about: dict | None = None, finalize: bool = True) -> dict:
        """mode: error, overwrite (the tiles that df has rows of), skip (tiles that are there stay), append.

        Appending, ``on_duplicate`` says what becomes of ids that a tile has already: append keeps
        both, skip the old row, last the new one, error raises.  Other tiles are never touched.
        """
        pixel, top = f"_healpix_order{order}", self.path(layer, survey)
        there = files.exists(self.spark, f"{top}/Norder={order}")
        if there and mode == "error":
            raise FileExistsError(f"{top} holds a catalog")
        if there and mode == "skip":
            df = df.join(self.catalog(survey, layer, order).select(F.col("Npix").cast("long").alias(pixel)).distinct(), pixel, "left_anti")
        staged = None
        if there and mode == "append" and on_duplicate != "append":
            df, staged = self._merged(df, survey, order, layer, on_duplicate)
        placed = df.withColumns({"Dir": healpix.dir_bucket(pixel), "Npix": F.col(pixel)})
        out = placed.repartition("Dir", "Npix").sortWithinPartitions("Npix", "_source_id").write.option("compression", "zstd")
        if mode == "overwrite" or staged:
            out = out.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        else:
            out = out.mode("append")
        out.partitionBy("Dir", "Npix").parquet(f"{top}/Norder={order}")
        if staged:
            files.delete(self.spark, staged)
        return self.finalize(survey, order, layer, about or {}) if finalize else {}

    def _merged(self, df: DataFrame, survey: str, order: int, layer: str, policy: str) -> tuple[DataFrame, str | None]:
        """The rows to append; or, with a folder they are staged in, the whole of the tiles that change."""
        pixel = f"_healpix_order{order}"
        touched = df.select(F.col(pixel).alias("_p")).distinct()
        old = self.catalog(survey, layer, order)
        old = old.join(touched, old["Npix"].cast("long") == F.col("_p"), "left_semi").drop("Dir", "Npix")
        if policy in ("skip", "error"):
            known = old.select(F.col("_source_id").alias("_known"), F.col(pixel).alias("_p"))
            same = (F.col("_source_id") == F.col("_known")) & (F.col(pixel) == F.col("_p"))
            if policy == "error" and (clash := df.join(known, same, "left_semi").select("_source_id").limit(5).collect()):
                raise DuplicateIds("ids are there already: " + ", ".join(str(r[0]) for r in clash))
            return df.join(known, same, "left_anti"), None
        changed = df.where("_source_id is not null").select("_source_id", pixel).distinct()
        rest = old.join(changed, ["_source_id", pixel], "left_anti").select(old.columns)
        staged = f"{self.path(layer, survey)}/.staged-{uuid.uuid4().hex}"
        rest.unionByName(df, allowMissingColumns=True).write.parquet(staged)
        return self.spark.read.parquet(staged), staged

    def finalize(self, survey: str, order: int, layer: str = "catalogs", about: dict | None = None) -> dict:
        """Descriptor and manifest from what is stored."""
        df, top = self.catalog(survey, layer, order), self.path(layer, survey)
        n = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("Npix").alias("tiles")).first()
        own = [c for c in df.columns if c not in ("Dir", "Npix")]
        info = {"survey": survey, "healpix_order": order, "total_rows": n["n"], "total_tiles": n["tiles"], "total_columns": len(own), "finalized": True} | (about or {})
        files.write_text(self.spark, f"{top}/catalog_info.json", json.dumps(info, indent=1))
        files.write_text(self.spark, f"{top}/schema.json", json.dumps(manifest(df.select(own)), indent=1))
        return info

    def open_live(self, survey: str, order: int, layer: str = "catalogs") -> None:
        """The descriptor of a catalog that still grows; ``finalize`` writes the full one."""
        path = f"{self.path(layer, survey)}/catalog_info.json"
        if not files.exists(self.spark, path):
            files.write_text(self.spark, path, json.dumps({"survey": survey, "healpix_order": order, "lifecycle": "live", "finalized": False}, indent=1))

    def stats(self, survey: str, layer: str = "catalogs", order: int | None = None) -> dict:
        """Rows and tiles; rows are None where a file's footer can't be read."""
        order = self.info(survey, layer)["healpix_order"] if order is None else order
        top = f"{self.path(layer, survey)}/Norder={order}"
        tiles = sum(len(files.children(self.spark, f"{top}/{d}")) for d in files.children(self.spark, top) if d.startswith("Dir="))
        try:
            return {"rows": self.catalog(survey, layer, order).count(), "tiles": tiles}
        except Exception as e:
            if not any(k in str(e) for k in ("FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER", "is not a Parquet file", "footer")):
                raise
            return {"rows": None, "tiles": tiles}

    def schema(self, survey: str, layer: str = "catalogs") -> T.StructType:
        """The catalog's columns by its descriptor; no data file is opened."""
        own = json.loads(files.read_text(self.spark, f"{self.path(layer, survey)}/schema.json"))["columns"]
        return T.StructType([T.StructField(c["name"], T._parse_datatype_string(c["type"]), c["nullable"]) for c in own])

    def repair(self, survey: str, order: int, layer: str = "catalogs") -> dict:
        """The descriptor again, keeping what it said of columns and links."""
        try:
            old = self.info(survey, layer)
        except Exception:
            old = {}
        return self.finalize(survey, order, layer, {k: v for k, v in old.items() if k in ("ra_column", "dec_column", "link_id_mode", "kind")})

    def write_association(self, association: DataFrame, name: str, order: int, about: dict | None = None, mode: str = "error") -> dict:
        top = self.path("crossmatch", name)
        if files.exists(self.spark, top) and mode == "error":
            raise FileExistsError(f"{top} exists")
        own = association.withColumn("Npix", F.coalesce("healpix_npix_a", F.lit(-1)))
        # by tile, but adaptive execution splits the tiles of many pairs: a task sorts no more than its share
        own.hint("rebalance", F.col("Npix")).write.option("compression", "zstd").mode("overwrite" if mode == "overwrite" else "append").partitionBy("Npix").parquet(f"{top}/Norder={order}")
        info = {"name": name, "healpix_order": order, "rows": self.association(name, order).count()} | (about or {})
        files.write_text(self.spark, f"{top}/crossmatch_info.json", json.dumps(info, indent=1))
        return info

    def association(self, name: str, order: int) -> DataFrame:
        """The association table; an empty one of the right types if nothing matched."""
        top = f"{self.path('crossmatch', name)}/Norder={order}"
        schema = "source_id_a long, source_id_b long, sep_arcsec float, healpix_npix_a long, healpix_npix_b long"
        if not [c for c in files.children(self.spark, top) if c.startswith("Npix")]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(top)


def system_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if is_reserved(c)]
