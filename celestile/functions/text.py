"""Scores and checksums of texts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import Value, col

HEADING_WEIGHT, PATH_WEIGHT = 10, 5


def sections(df: DataFrame, path: str, text: str) -> DataFrame:
    """(path, heading, body) of each Markdown section; what stands before the first heading has heading ''."""
    parts = F.split(F.concat(F.lit("\n"), col(text)), r"\n(?=#{1,6} )")
    own = df.select(col(path).alias("path"), F.explode(parts).alias("part"))
    head = F.trim(F.regexp_replace(F.regexp_extract("part", r"^(#{1,6} [^\n]*)", 1), r"^#+ ", ""))
    return own.select("path", head.alias("heading"), F.regexp_replace("part", r"^#{1,6} [^\n]*", "").alias("body"))


def occurrences(text: Value, term: str) -> Column:
    """How often a term occurs, in any case, without overlaps."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    return ((F.length(low) - F.length(F.replace(low, F.lit(term.lower())))) / max(1, len(term))).cast("long")


def keyword_score(terms: Sequence[str], heading: Value, path: Value, body: Value) -> Column:
    """Per term: 10 for each heading hit, 5 for each path hit, 1 for each hit in the body."""
    score = F.lit(0).cast("long")
    for term in terms:
        score = score + HEADING_WEIGHT * occurrences(heading, term) + PATH_WEIGHT * occurrences(path, term) + occurrences(body, term)
    return score


def search(df: DataFrame, query: str, limit: int, *, heading: str = "heading", path: str = "path", body: str = "body") -> DataFrame:
    """The best rows by score, then path, then heading."""
    terms = [t for t in re.split(r"\s+", query.strip().lower()) if t]
    scored = df.withColumn("score", keyword_score(terms, heading, path, body))
    return scored.where("score > 0").orderBy(F.col("score").desc(), path, heading).limit(limit)


def checksum(content: Value) -> Column:
    return F.sha2(col(content).cast("binary"), 256)
