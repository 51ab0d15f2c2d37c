"""Crossmatches between catalogs: by position and by key.

The positional join is an equi-join on cells of the sky (the zones algorithm, Gray et al.
2006): declination is cut into zones, and each zone into cells of right ascension about
as wide as the zone is high.  A row of the left side lies in one cell; a row of the right
side is entered in every cell that its disc of the match radius touches, which is one or
two for cells much larger than the radius.  Above half a degree cells are half a radius
high, so that about half of the rows that meet are pairs.  Rows that meet are held against
the radius by their cosine; only those near its edge by their angle.  Only built-in joins and
aggregates are used, so adaptive execution splits dense cells of ``match_all``; see
``match_nearest`` for its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import healpix
from ..functions.columns import col
from ..functions.ids import radius_token
from ..functions.sphere import separation, valid_sky, wrap_ra

LEAST_ZONE_DEG = 1 / 120
#: Zones as high as this are cut finer than eight radii, and nearest partners are sought in smaller discs first.
WIDE_DEG = 0.5
ASSOCIATION = "source_id_a long, source_id_b long, sep_arcsec float"


@dataclass(frozen=True)
class Sky:
    """The id and position columns of a catalog; pixel: its tile column, if any."""

    id: str = "_source_id"
    ra: str = "ra"
    dec: str = "dec"
    pixel: str | None = None


def _zone(dec: Column, height: float) -> Column:
    return F.floor((dec + 90.0) / height).cast("int")


def _cells_in(zone: Column, height: float) -> Column:
    """Cells of right ascension of a zone: about as wide as it is high where the zone is widest in RA."""
    edge = F.greatest(F.abs(zone * height - 90.0), F.abs((zone + 1) * height - 90.0))
    return F.greatest(F.lit(1), F.floor(F.cos(F.radians(F.least(edge, F.lit(90.0)))) * (360.0 / height))).cast("int")


def zone_height(radius_deg: float) -> float:
    return min(180.0, max(LEAST_ZONE_DEG, min(8 * radius_deg, WIDE_DEG), radius_deg / 2))


def _rows(df: DataFrame, sky: Sky, side: str) -> DataFrame:
    """Usable rows with their unit vectors, all columns named by side."""
    pixel = F.col(sky.pixel) if sky.pixel else F.lit(None).cast("long")
    own = df.where(valid_sky(sky.ra, sky.dec) & F.col(sky.id).isNotNull()).select(F.col(sky.id).alias(f"{side}_id"), F.col(sky.ra).cast("double").alias(f"{side}_ra"), F.col(sky.dec).cast("double").alias(f"{side}_dec"), pixel.alias(f"{side}_pixel"))
    a, d = F.radians(f"{side}_ra"), F.radians(f"{side}_dec")
    return own.withColumns({f"{side}_x": F.cos(d) * F.cos(a), f"{side}_y": F.cos(d) * F.sin(a), f"{side}_z": F.sin(d)})


def _in_cell(left: DataFrame, height: float) -> DataFrame:
    """Rows of the left side with the one cell that they lie in."""
    left = left.withColumn("zone", _zone(F.col("a_dec"), height))
    n = _cells_in(F.col("zone"), height)
    return left.withColumn("cell", F.least(n - 1, F.floor(wrap_ra("a_ra") / 360.0 * n)).cast("int"))


def _in_cells(right: DataFrame, radius_deg: float, height: float) -> DataFrame:
    """Rows of the right side in every cell that their discs touch."""
    r, slack = radius_deg, 1e-9
    low, high = (_zone(F.greatest(F.lit(-90.0), F.least(F.lit(90.0), F.col("b_dec") + d)), height) for d in (-r - slack, r + slack))
    right = right.withColumn("zone", F.explode(F.sequence(low, high)))
    polar = F.abs(F.col("b_dec")) + (r + slack) >= 90.0
    reach = F.when(polar, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(math.radians(min(90.0, r + slack)))) / F.cos(F.radians("b_dec"))))) + slack)
    right = right.withColumns({"n": _cells_in(F.col("zone"), height), "reach": reach})
    first, last = (F.floor((wrap_ra("b_ra") + d) / 360.0 * F.col("n")).cast("int") for d in (-F.col("reach"), F.col("reach")))
    every = F.sequence(F.lit(0), F.col("n") - 1)
    cells = F.when(last - first + 1 >= F.col("n"), every).otherwise(F.transform(F.sequence(first, last), lambda x: F.pmod(x, F.col("n"))))
    return right.withColumn("cell", F.explode(cells)).drop("n", "reach")


def _separation() -> Column:
    return separation("a_ra", "a_dec", "b_ra", "b_dec")


def _within(radius_deg: float) -> Column:
    """Whether the separation is within the radius: by the cosine, which is cheap, where that leaves no doubt."""
    cosine = F.col("a_x") * F.col("b_x") + F.col("a_y") * F.col("b_y") + F.col("a_z") * F.col("b_z")
    chord = (2 * math.sin(math.radians(min(180.0, radius_deg)) / 2)) ** 2
    possible, sure = (1 - (chord * (1 + d * 1e-6) + d * 1e-13) / 2 for d in (1, -1))
    return (cosine >= possible) & ((cosine >= sure) | (_separation() <= radius_deg))


def pairs(a: DataFrame, b: DataFrame, radius_deg: float, sky_a: Sky = Sky(), sky_b: Sky = Sky(), height: float | None = None) -> DataFrame:
    """Every pair within the radius (inclusive): a_id, a_ra, a_dec, b_id, sep_deg, with pixels where named.

    Rows without a valid position or id match nothing.  Works across RA 0 and at the poles.
    The optimizer doesn't see in how many cells a row is entered, so the join is told not to broadcast.
    """
    h = height or zone_height(radius_deg)
    left, right = _in_cell(_rows(a, sky_a, "a"), h), _in_cells(_rows(b, sky_b, "b"), radius_deg, h)
    return left.join(right.hint("merge"), ["zone", "cell"]).where(_within(radius_deg)).withColumn("sep_deg", _separation())


def _association(met: DataFrame, *more: str) -> DataFrame:
    return met.select(F.col("a_id").alias("source_id_a"), F.col("b_id").alias("source_id_b"), (F.col("sep_deg") * 3600.0).cast("float").alias("sep_arcsec"), F.col("a_pixel").alias("healpix_npix_a"), F.col("b_pixel").alias("healpix_npix_b"), *more)


def match_all(a: DataFrame, b: DataFrame, radius_deg: float, sky_a: Sky = Sky(), sky_b: Sky = Sky()) -> DataFrame:
    """The association table with every partner within the radius."""
    return _association(pairs(a, b, radius_deg, sky_a, sky_b))


def _nearest(a: DataFrame, b: DataFrame, radius_deg: float, sky_a: Sky, sky_b: Sky) -> DataFrame:
    """a_id, a_pixel, sep_deg, b_id, b_pixel of each row's nearest partner.

    A wide radius is reached by steps of four: a row that has a partner within the smaller
    radius has its nearest there, and meets no other cell.
    """
    radii = [radius_deg]
    while radii[0] > WIDE_DEG:
        radii.insert(0, radii[0] / 4)
    own, right = _rows(a, sky_a, "a"), _rows(b, sky_b, "b")
    kinds = dict(right.dtypes)
    own = own.withColumn("best", F.lit(None).cast(f"struct<sep_deg:double,b_id:{kinds['b_id']},b_pixel:{kinds['b_pixel']}>"))
    keys = ["zone", "cell", *(c for c in own.columns if c != "best")]
    for r in radii:
        h = zone_height(r)
        left, found = _in_cell(own, h), F.col("best").isNotNull()
        if r > radii[0]:  # rows that have theirs are spread over cells that hold no partner
            left = left.withColumns({"zone": F.when(found, -1).otherwise(F.col("zone")), "cell": F.when(found, F.hash("a_id")).otherwise(F.col("cell"))})
        cells = _in_cells(right, r, h).withColumnsRenamed({"zone": "b_zone", "cell": "b_cell"}).hint("merge")
        met = left.join(cells, (F.col("zone") == F.col("b_zone")) & (F.col("cell") == F.col("b_cell")) & _within(r), "inner" if len(radii) == 1 else "left")
        new = F.when(F.col("b_id").isNotNull(), F.struct(_separation().alias("sep_deg"), "b_id", "b_pixel"))
        own = met.groupBy(*keys).agg(F.min(F.coalesce("best", new)).alias("best")).drop("zone", "cell")
    return own.where("best is not null").select("a_id", "a_pixel", "best.*")


def match_nearest(a: DataFrame, b: DataFrame, radius_deg: float, sky_a: Sky = Sky(), sky_b: Sky = Sky(), strategy: str = "bucketed") -> DataFrame:
    """The association table with each row's nearest partner; ties go to the smaller partner id.

    Rows of ``a`` that agree in id and position are one row.  The nearest partner is a
    minimum within the join's own partitions: no further shuffle.  As that minimum needs a
    cell's rows together, Spark splits a dense cell only where
    spark.sql.adaptive.forceOptimizeSkewedJoin is true, at the price of one shuffle of the minima.
    ``brute`` compares all with all and is for small tables.
    """
    if strategy == "brute":
        met = pairs(a, b, radius_deg, sky_a, sky_b, height=180.0)
        best = F.min(F.struct("sep_deg", "b_id", "b_pixel")).alias("best")
        return _association(met.groupBy("a_id", "a_ra", "a_dec", "a_pixel").agg(best).select("a_id", "a_pixel", "best.*"))
    if strategy != "bucketed":
        raise ValueError(f"unknown strategy {strategy!r}")
    return _association(_nearest(a, b, radius_deg, sky_a, sky_b))


def nearest_separation(a: DataFrame, b: DataFrame, radius_deg: float, sky_a: Sky = Sky(), sky_b: Sky = Sky()) -> DataFrame:
    """source_id_a and the least separation, in degrees, where it is within the radius."""
    return _nearest(a, b, radius_deg, sky_a, sky_b).groupBy(F.col("a_id").alias("source_id_a")).agg(F.min("sep_deg").alias("sep_deg"))


def tiles_that_may_touch(tiles: DataFrame, pixel: str, order: int, partner_order: int, radius_deg: float, out: str) -> DataFrame:
    """tiles with, exploded, every partner tile whose pixels may lie within the radius of the tile's.

    A partner's tile is entered at the coarser of both orders with the tiles around it.
    """
    common = min(order, partner_order)
    reach = radius_deg + 2 * healpix.max_pixel_radius(common)

    @F.pandas_udf("array<long>")
    def around(pix):
        import pandas as pd

        return pd.Series([healpix.cover_cone(*map(float, healpix.pix2ang(p, common)), reach, common) for p in pix])

    own = tiles.select(healpix.rescale(pixel, order, common).alias("_common")).distinct().withColumn("_near", F.explode(around("_common")))
    met = tiles.withColumn("_common", healpix.rescale(pixel, order, common)).join(own, "_common")
    fine = healpix.rescale("_near", common, partner_order)
    return met.withColumn(out, F.explode(fine) if partner_order > common else fine).drop("_common", "_near")


def match_column(a: DataFrame, b: DataFrame, key_a: str, key_b: str, sky_a: Sky = Sky(), sky_b: Sky = Sky(), *, orders: tuple[int, int] | None = None, pad_deg: float | None = None) -> DataFrame:
    """The association of rows with equal keys as texts, many to many, separation 0; null keys match nothing.

    With ``orders`` (of both catalogs' tiles, named by Sky.pixel) only rows in tiles that lie
    together match; without, keys match wherever the rows are.
    """
    side = lambda df, key, sky: df.where(F.col(key).isNotNull() & F.col(sky.id).isNotNull())
    pixel = lambda s: F.col(s.pixel) if s.pixel else F.lit(None).cast("long")
    left = side(a, key_a, sky_a).select(F.col(sky_a.id).alias("a_id"), F.col(key_a).cast("string").alias("key"), pixel(sky_a).alias("a_pixel"))
    right = side(b, key_b, sky_b).select(F.col(sky_b.id).alias("b_id"), F.col(key_b).cast("string").alias("key"), pixel(sky_b).alias("b_pixel"))
    met = left.join(right, "key")
    if orders:
        pad = healpix.max_pixel_radius(min(orders)) / 2 if pad_deg is None else pad_deg
        near = tiles_that_may_touch(left.select("a_pixel").distinct(), "a_pixel", *orders, pad, "b_pixel").distinct()
        met = met.join(near, ["a_pixel", "b_pixel"], "left_semi")
    return _association(met.withColumn("sep_deg", F.lit(0.0)))


def orphans(a: DataFrame, association: DataFrame, id_col: str = "_source_id", tiles_only: str | None = None) -> DataFrame:
    """Rows of a without an association row; with ``tiles_only``, of tiles that have some at all."""
    if tiles_only:
        seen = association.select(F.col("healpix_npix_a").alias(tiles_only)).distinct()
        a = a.join(seen, tiles_only, "left_semi")
    return a.join(association.select(F.col("source_id_a").alias(id_col)), id_col, "left_anti")


def matches_of(association: DataFrame, source_id_a: int | None = None, source_id_b: int | None = None, max_sep_arcsec: float | None = None) -> DataFrame:
    for name, v in (("source_id_a", source_id_a), ("source_id_b", source_id_b)):
        if v is not None:
            association = association.where(F.col(name) == v)
    return association if max_sep_arcsec is None else association.where(F.col("sep_arcsec") <= max_sep_arcsec)


def tree_name(a: str, b: str, radius_arcsec: float | None = None, columns: tuple[str, str] | None = None) -> str:
    """A_x_B__r1.0 of a positional tree, A_x_B__col_a__b of one by key."""
    if columns:
        for c in columns:
            if "__" in c or "/" in c or not c:
                raise ValueError(f"{c!r} can't stand in the name of a tree")
        return f"{a}_x_{b}__col_{columns[0]}__{columns[1]}"
    return f"{a}_x_{b}__r{radius_token(radius_arcsec or 0.0)}"


def parse_tree_name(name: str) -> dict:
    head, sep, tail = name.partition("__")
    a, x, b = head.partition("_x_")
    if not (sep and x):
        raise ValueError(f"not the name of an association tree: {name!r}")
    if tail.startswith("col_"):
        left, _, right = tail[4:].partition("__")
        return {"a": a, "b": b, "mode": "column", "columns": (left, right)}
    if not tail.startswith("r"):
        raise ValueError(f"not the name of an association tree: {name!r}")
    return {"a": a, "b": b, "mode": "sky", "radius_arcsec": float(tail[1:])}


@dataclass(frozen=True)
class Partner:
    """One partner of a plan: by radius or by key columns."""

    name: str
    radius_arcsec: float | None = None
    columns: tuple[str, str] | None = None


def run_plan(catalogs: dict[str, DataFrame], base: str, partners: Sequence[Partner], skies: dict[str, Sky], done: Callable[[str], bool] = lambda name: False, stop_at_error: bool = False) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The association of base with each partner by its tree name, and what went wrong by partner.

    Trees that are ``done`` are left out.  Results are lazy; a wrong plan shows at once.
    """
    found: dict[str, DataFrame] = {}
    errors: dict[str, str] = {}
    for p in partners:
        name = tree_name(base, p.name, p.radius_arcsec, p.columns)
        if done(name):
            continue
        try:
            a, b, sa, sb = catalogs[base], catalogs[p.name], skies[base], skies[p.name]
            found[name] = match_column(a, b, *p.columns, sa, sb) if p.columns else match_nearest(a, b, (p.radius_arcsec or 1.0) / 3600, sa, sb)
        except Exception as e:
            if stop_at_error:
                raise
            errors[p.name] = f"{type(e).__name__}: {e}"
    return found, errors


def build(a: DataFrame, b: DataFrame, radius_deg: float, sky_a: Sky, sky_b: Sky, orders: tuple[int, int], *, built: DataFrame | None = None, restrict: DataFrame | None = None, nearest: bool = True) -> DataFrame:
    """The association of a tiled catalog with another: of its tiles that may touch the partner's, that are asked for
    (restrict: a frame of pixels) and that aren't ``built`` yet, which is how a stopped run goes on."""
    tiles = a.select(F.col(sky_a.pixel).alias("_t")).where("_t is not null").distinct()
    if restrict is not None:
        tiles = tiles.join(restrict.select(F.col(restrict.columns[0]).alias("_t")), "_t", "left_semi")
    if built is not None:
        tiles = tiles.join(built.select(F.col("healpix_npix_a").alias("_t")).distinct(), "_t", "left_anti")
    met = tiles_that_may_touch(tiles, "_t", *orders, radius_deg, "_b")
    own = met.join(b.select(F.col(sky_b.pixel).alias("_b")).distinct(), "_b", "left_semi").select("_t", "_b")
    left = a.join(own.select(F.col("_t").alias(sky_a.pixel)).distinct(), sky_a.pixel, "left_semi")
    right = b.join(own.select(F.col("_b").alias(sky_b.pixel)).distinct(), sky_b.pixel, "left_semi")
    return (match_nearest if nearest else match_all)(left, right, radius_deg, sky_a, sky_b)


def missing_tiles(wanted: DataFrame, association: DataFrame, pixel: str) -> DataFrame:
    """Tiles that have no association row yet."""
    return wanted.select(pixel).distinct().join(association.select(col("healpix_npix_a").alias(pixel)), pixel, "left_anti")
