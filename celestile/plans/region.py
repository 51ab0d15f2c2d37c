"""Regions and selections of the sky."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import healpix
from ..functions.sphere import in_bbox, separation_acos
from ..operators.predicates import checked


@dataclass(frozen=True)
class Region:
    """Pixels, a cone, a box or a coverage map; resolves to pixels at any order."""

    kind: str
    pixels: tuple[int, ...] = ()
    order: int = 0
    cone: tuple[float, float, float] | None = None
    bbox: tuple[float, float, float, float] | None = None
    cells: frozenset[tuple[int, int]] = frozenset()

    @classmethod
    def of_pixels(cls, text: str | list[int], order: int) -> Region:
        return cls("npix", tuple(healpix.parse_pixels(text) if isinstance(text, str) else sorted(set(text))), order)

    @classmethod
    def of_cone(cls, ra: float, dec: float, radius: float) -> Region:
        return cls("cone", cone=(ra, dec, radius))

    @classmethod
    def of_bbox(cls, ra_min: float, ra_max: float, dec_min: float, dec_max: float) -> Region:
        return cls("bbox", bbox=(ra_min, ra_max, dec_min, dec_max))

    @classmethod
    def of_moc(cls, text: str) -> Region:
        return cls("moc", cells=frozenset(healpix.parse_moc(text)))

    @classmethod
    def parse(cls, doc: dict) -> Region:
        made = {"npix": lambda d: cls.of_pixels(d["npix"], d["order"]), "cone": lambda d: cls.of_cone(*map(float, d["cone"])), "bbox": lambda d: cls.of_bbox(*map(float, d["bbox"])), "moc": lambda d: cls.of_moc(d["moc"])}
        kinds = [k for k in made if k in doc]
        if len(kinds) != 1:
            raise ValueError("a region has one of npix, cone, bbox and moc")
        return made[kinds[0]](doc)

    def at(self, order: int) -> list[int]:
        if self.kind == "npix":
            return sorted(healpix.rescale_set(set(self.pixels), self.order, order))
        if self.kind == "cone":
            return healpix.cover_cone(*self.cone, order)
        return healpix.cover_bbox(*self.bbox, order) if self.kind == "bbox" else healpix.moc_pixels(set(self.cells), order)

    def frame(self, spark: SparkSession, order: int) -> DataFrame:
        return spark.createDataFrame([(p,) for p in self.at(order)], "npix long")

    def exact(self, ra: str = "ra", dec: str = "dec") -> Column:
        """The row predicate of a cone or box."""
        if self.kind == "cone":
            a, d, r = self.cone
            return separation_acos(ra, dec, a, d) <= r
        if self.kind == "bbox":
            a, b, c, d = self.bbox
            full = b - a >= 360
            return F.col(dec).between(c, d) if full else in_bbox(ra, dec, a % 360 if b - a else a, b if b == 360 else b % 360, c, d)
        raise ValueError(f"a {self.kind} region is made of whole tiles")


def select_region(df: DataFrame, region: Region, pixel: str, order: int, ra: str = "ra", dec: str = "dec", exact: bool = False) -> DataFrame:
    """Rows of the tiles that the region may touch; with ``exact`` only rows inside.

    Ranges of pixels prune tiles when ``pixel`` is a partition column, row groups otherwise.
    """
    out = in_pixels(df, pixel, region.at(order))
    return out.where(region.exact(ra, dec)) if exact else out


def cone_search(df: DataFrame, ra0: float, dec0: float, radius: float, *, ra: str = "ra", dec: str = "dec", pixel: str | None = None, order: int | None = None) -> DataFrame:
    """Rows within the radius, inclusive, and their separation."""
    if pixel is not None and order is not None:
        df = in_pixels(df, pixel, healpix.cover_cone(ra0, dec0, radius, order))
    return df.withColumn("sep_deg", separation_acos(ra, dec, ra0, dec0)).where(F.col("sep_deg") <= radius)


MOST_LISTED = 4096
MOST_RANGES = 16


def in_pixels(df: DataFrame, pixel: str, pixels: list[int]) -> DataFrame:
    """Rows of pixels: by a list of MOST_LISTED at most, else by ranges of neighbouring numbers, which both prune tiles and
    row groups; beyond MOST_RANGES of them by a semi join, so that no plan grows with the region."""
    if len(pixels) <= MOST_LISTED:
        return df.where(F.col(pixel).isin(list(pixels)))
    ends: list[list[int]] = []
    for p in sorted(set(pixels)):
        if ends and p == ends[-1][1] + 1:
            ends[-1][1] = p
        else:
            ends.append([p, p])
    if len(ends) > MOST_RANGES:
        return df.join(df.sparkSession.createDataFrame([(p,) for p in sorted(set(pixels))], f"`{pixel}` long"), pixel, "left_semi")
    own = F.lit(False)
    for a, b in ends:
        own = own | F.col(pixel).between(a, b)
    return df.where(own)


@dataclass
class Selection:
    """Which base rows an operation works on: tiles, ids, or both; nothing is collected."""

    survey: str
    order: int
    tiles: DataFrame
    ids: DataFrame | None = None

    def rows(self, df: DataFrame, pixel: str, id_col: str = "_source_id") -> DataFrame:
        own = df.join(self.tiles.select(F.col("npix").alias(pixel)), pixel, "left_semi")
        return own if self.ids is None else own.join(self.ids.select(F.col(self.ids.columns[0]).alias(id_col)), id_col, "left_semi")


def _tiles(df: DataFrame, pixel: str) -> DataFrame:
    return df.select(F.col(pixel).alias("npix")).where("npix >= 0").distinct()


def selection_of_region(df: DataFrame, survey: str, region: Region, pixel: str, order: int) -> Selection:
    wanted = region.frame(df.sparkSession, order)
    return Selection(survey, order, _tiles(df, pixel).join(wanted, "npix", "left_semi"))


def selection_of_ids(df: DataFrame, survey: str, ids: DataFrame, pixel: str, order: int, id_col: str = "_source_id") -> Selection:
    """Ids that aren't in the catalog fall out."""
    own = df.join(ids.select(F.col(ids.columns[0]).alias(id_col)), id_col, "left_semi")
    return Selection(survey, order, _tiles(own, pixel), own.select(id_col).distinct())


def selection_of_where(df: DataFrame, survey: str, where: str, pixel: str, order: int, id_col: str = "_source_id") -> Selection:
    own = df.where(F.expr(checked(where)))
    return Selection(survey, order, _tiles(own, pixel), own.select(id_col).distinct())


def selection_of_all(df: DataFrame, survey: str, pixel: str, order: int) -> Selection:
    return Selection(survey, order, _tiles(df, pixel))
