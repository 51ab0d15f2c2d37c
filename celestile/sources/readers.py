"""Source tables in the formats that catalogs come in."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import LinkMode, normalize
from ..operators.predicates import expand_names, numbered_equals, resolve
from . import fits
from .files import read_text

SNIFFED_LINES = 20
DELIMITERS = (",", "\t", ";", "|")


def format_of(path: str) -> str:
    name = re.sub(r"\.(gz|fz)$", "", path.lower().rstrip("/"))
    for ending, kind in ((".parquet", "parquet"), (".fits", "fits"), (".fit", "fits"), (".vot", "votable"), (".xml", "votable"), (".votable", "votable"), (".ecsv", "ecsv"), (".csv", "csv"), (".tsv", "tsv"), (".txt", "list"), (".lst", "list"), (".list", "list")):
        if name.endswith(ending):
            return kind
    return "parquet"


def sniff(spark: SparkSession, path: str) -> str:
    """The delimiter that splits the first lines (comments left out) into the same number of parts, more than one; else a comma."""
    lines = [r[0] for r in spark.read.text(path).limit(SNIFFED_LINES * 2).collect() if r[0].strip() and not r[0].startswith("#")][:SNIFFED_LINES]
    best = max(((len({line.count(d) for line in lines}) == 1, min(line.count(d) for line in lines), d) for d in DELIMITERS), default=(False, 0, ",")) if lines else (False, 0, ",")
    return best[2] if best[1] else ","


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """With a header; lines that begin with # are comments; types are inferred in a pass over the file."""
    return spark.read.options(sep=delimiter or sniff(spark, path), header=True, comment="#", inferSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).csv(path)


# Fixed values of the VOTable standard: Spark types of its datatypes.
VOTABLE_TYPES = {"boolean": "boolean", "unsignedByte": "smallint", "short": "smallint", "int": "int", "long": "bigint", "float": "float", "double": "double", "char": "string", "unicodeChar": "string"}


def read_votable(spark: SparkSession, path: str) -> DataFrame:
    """TABLEDATA of a VOTable; empty cells are null."""
    head = read_text(spark, path)
    names = []
    for tag in re.findall(r"<FIELD\b[^>]*>", head.split("<DATA", 1)[0]):
        attributes = dict(re.findall(r'(\w+)\s*=\s*"([^"]*)"', tag))
        kind = VOTABLE_TYPES.get(attributes.get("datatype", "char"), "string")
        names.append((attributes.get("name", f"col{len(names) + 1}"), "string" if attributes.get("arraysize") else kind))
    rows = spark.read.format("xml").options(rowTag="TR", nullValue="").schema("TD array<string>").load(path)
    cell = lambda i: F.nullif(F.trim(F.get("TD", F.lit(i))), F.lit(""))
    return rows.select(*(cell(i).try_cast(kind).alias(n) for i, (n, kind) in enumerate(names)))


def read_table(spark: SparkSession, path: str, *, kind: str = "auto", hdu: str = "1") -> DataFrame:
    """Any table, with stripped column names; two that agree after stripping are an error."""
    kind = format_of(path) if kind == "auto" else kind
    if kind == "parquet":
        df = spark.read.parquet(path)
    elif kind == "fits":
        df = fits.read_fits(spark, path, hdu)  # plain or .gz; .fz holds tables packed by tiles, which raise
    elif kind == "votable":
        df = read_votable(spark, path)
    elif kind == "list":
        df = spark.read.text(path).select(F.trim("value").alias("id")).where("id <> '' and not startswith(id, '#')")
    else:
        df = read_delimited(spark, path, {"tsv": "\t", "ecsv": None}.get(kind))
    return stripped_names(df)


def read_many(spark: SparkSession, paths: Sequence[str], *, kind: str = "auto", with_path: bool = False) -> DataFrame:
    """Tables of any formats one under another, missing columns as nulls; with ``input_path`` where each row is from."""
    own = [read_table(spark, p, kind=kind) for p in paths]
    own = [df.withColumn("input_path", F.lit(p)) for df, p in zip(own, paths, strict=True)] if with_path else own
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), own)


def stripped_names(df: DataFrame) -> DataFrame:
    names = [c.strip() for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"names that agree when stripped: {sorted(n for n in set(names) if names.count(n) > 1)}")
    return df if names == df.columns else df.toDF(*names)


def sky_columns(df: DataFrame, ra: str, dec: str) -> DataFrame:
    return df.select(F.col(resolve(df, ra)).cast("double").alias("ra"), F.col(resolve(df, dec)).cast("double").alias("dec"))


def canonical(df: DataFrame) -> DataFrame:
    """Floats as doubles, integers as longs, also within arrays; columns of only nulls as doubles; the rest as it is."""

    def kind(t: T.DataType) -> T.DataType:
        if isinstance(t, T.ArrayType):
            return T.ArrayType(kind(t.elementType), t.containsNull)
        if isinstance(t, (T.FloatType, T.NullType)):
            return T.DoubleType()
        return T.LongType() if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)) else t

    return df.select(*(F.col(f"`{f.name}`").cast(kind(f.dataType)).alias(f.name, metadata=f.metadata) for f in df.schema))


def read_targets(df: DataFrame, column: str, position: bool = True) -> DataFrame:
    """A target list: ``_source_id`` of one or several columns, all columns, and the place of each row; repeats are kept."""
    names = [resolve(df, c) for c in expand_names([column])]
    own = LinkMode("composite", tuple(names)).id(df.schema) if len(names) > 1 else normalize(names[0], df.schema[names[0]].dataType)
    out = df.withColumn("_source_id", own)
    return out.withColumn("_position", F.monotonically_increasing_id()) if position else out


def read_ids(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """Distinct ids of a file."""
    df = read_table(spark, path)
    return read_targets(df, column or df.columns[0], position=False).select("_source_id").where("_source_id is not null").distinct()


def lookup_table(spark: SparkSession, path: str, **keys: int | str | None) -> DataFrame:
    """A lookup table and its rows of a survey, plate or night."""
    return numbered_equals(read_table(spark, path), **keys)
