"""Counts, footprints, registry and density reports."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import healpix
from ..functions.columns import Value, col

ROWS_PER_TILE = 50_000
ROWS_PER_TILE_RANGE = (10_000, 100_000)


def in_region(df: DataFrame, pixel: str, pixels: Sequence[int] | DataFrame) -> DataFrame:
    if isinstance(pixels, DataFrame):
        return df.join(pixels.select(F.col(pixels.columns[0]).alias(pixel)), pixel, "left_semi")
    return df.where(F.col(pixel).isin(list(pixels)))


def discover(layers: dict[tuple[str, str], tuple[DataFrame, str]], pixels: DataFrame, exact: bool = True) -> DataFrame:
    """survey, modality, tiles, overlap_tiles, est_rows and exact_rows of each layer within a set of pixels.

    layers: (survey, modality) -> (frame, pixel column).  One pass a layer: rows are
    counted by tile, and tiles meet the region.
    """
    out = None
    region = pixels.select(F.col(pixels.columns[0]).cast("long").alias("_p")).distinct().withColumn("_in", F.lit(1))
    for (survey, modality), (df, pixel) in layers.items():
        tiles = df.groupBy(F.col(pixel).cast("long").alias("_p")).agg(F.count(F.lit(1)).alias("n")).join(region, "_p", "left")
        total, rows = F.count(F.lit(1)), F.sum("n")
        over = F.count("_in")
        estimate = F.when(total > 0, F.bround(rows / total * over, 0).cast("long")).otherwise(F.lit(0).cast("long"))
        own = tiles.agg(total.alias("tiles"), over.alias("overlap_tiles"), estimate.alias("est_rows"), F.coalesce(F.sum(F.when(F.col("_in") == 1, F.col("n"))), F.lit(0)).alias("exact_rows"))
        own = own.select(F.lit(survey).alias("survey"), F.lit(modality).alias("modality"), "*")
        own = own if exact else own.withColumn("exact_rows", F.lit(None).cast("long"))
        out = own if out is None else out.unionByName(own)
    return out


def humanized(n: Value) -> Column:
    """~12k: two significant figures."""
    c = col(n).cast("double")

    def shown(value: Column, unit: str) -> Column:
        step = F.pow(F.lit(10.0), F.floor(F.log10(value)) - 1)
        text = F.when(value < 9.95, F.format_string("%.1f", value)).otherwise(F.format_string("%.0f", F.round(value / step, 0) * step))
        return F.concat(F.lit("~"), text, F.lit(unit))

    plain = F.concat(F.lit("~"), c.cast("long").cast("string"))
    return F.when(c < 1000, plain).when(c < 1e6, shown(c / 1e3, "k")).when(c < 1e9, shown(c / 1e6, "M")).otherwise(shown(c / 1e9, "B"))


def tree_stats(df: DataFrame, pixel: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(pixel).alias("tiles"))


def crossmatch_count(association: DataFrame, pixels: DataFrame | None = None) -> DataFrame:
    """rows and tiles of an association, within a set of the base's pixels if given."""
    own = association if pixels is None else in_region(association, "healpix_npix_a", pixels)
    return own.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("healpix_npix_a").alias("tiles"))


def registry(rows: Sequence[DataFrame]) -> DataFrame:
    """One table of survey rows with whatever keys they have."""
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def with_order_match(reg: DataFrame) -> DataFrame:
    """Whether all layers of a survey have one pixel order."""
    own = Window.partitionBy("survey")
    return reg.withColumn("order_match", F.min("healpix_order").over(own) == F.max("healpix_order").over(own))


def registry_totals(reg: DataFrame) -> DataFrame:
    """Rows, surveys and unknown counts by modality, and over all (modality null)."""
    return reg.rollup("modality").agg(F.count(F.lit(1)).alias("surveys"), F.sum("total_rows").alias("total_rows"), F.count_if(F.col("total_rows").isNull()).alias("unknown"))


def paired(reg: DataFrame, layers: Sequence[str]) -> DataFrame:
    """Surveys with a column for the rows of each layer."""
    return reg.groupBy("survey").pivot("modality", list(layers)).agg(F.sum("total_rows"))


def by_kind(reg: DataFrame, kind: str | None = None, modality: str | None = None) -> DataFrame:
    """A null kind counts as ingested."""
    reg = reg.withColumn("kind", F.coalesce("kind", F.lit("ingested")))
    reg = reg.where(F.col("kind") == kind) if kind else reg
    return reg.where(F.col("modality") == modality) if modality else reg


def partner_order(reg: DataFrame) -> DataFrame:
    return reg.orderBy(F.col("total_rows").asc_nulls_last(), "survey")


def without_shadowed(first: DataFrame, second: DataFrame, key: str = "survey") -> DataFrame:
    """first, and what second has besides."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"), allowMissingColumns=True)


def multiplicity(df: DataFrame, key: str) -> DataFrame:
    """How many keys occur how often: times, keys, rows, share (of all keys)."""
    each = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("times"))
    hist = each.groupBy("times").agg(F.count(F.lit(1)).alias("keys"))
    total = F.sum("keys").over(Window.partitionBy())
    return hist.select("times", "keys", (F.col("times") * F.col("keys")).alias("rows"), (F.col("keys") / total).alias("share"))


def order_densities(df: DataFrame, ra: str, dec: str, orders: Sequence[int] = tuple(range(3, 9))) -> DataFrame:
    """order, pixels, rows_per_pixel, sky_fraction of each order.

    Rows are counted once by pixel of the finest order; coarser orders sum those counts.
    """
    finest = max(orders)
    fine = healpix.with_pixel(df.select(ra, dec), ra, dec, finest, "pix").where(F.col("pix").isNotNull()).groupBy("pix").agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*(F.struct(F.lit(o).alias("order"), F.shiftright("pix", 2 * (finest - o)).alias("p")) for o in orders))).alias("at")
    cells = fine.select(each, "n").groupBy("at.order", "at.p").agg(F.sum("n").alias("n"))
    counted = cells.groupBy("order").agg(F.count(F.lit(1)).alias("pixels"), F.sum("n").alias("rows"))
    return counted.select("order", "pixels", (F.col("rows") / F.col("pixels")).alias("rows_per_pixel"), (F.col("pixels") / (12 * F.pow(F.lit(4.0), F.col("order")))).alias("sky_fraction"))


def recommended_order(densities: DataFrame, target: float = ROWS_PER_TILE, allowed: tuple[float, float] = ROWS_PER_TILE_RANGE) -> DataFrame:
    """The order whose rows a pixel are nearest to the target on a log scale, within the allowed range if any is."""
    near = F.abs(F.log10("rows_per_pixel") - math.log10(target))
    outside = ~F.col("rows_per_pixel").between(*allowed)
    return densities.withColumn("in_range", ~outside).orderBy(outside, near, "order").limit(1)


def footprint(df: DataFrame, pixel: str, order: int, to: int) -> DataFrame:
    """Distinct pixels at an order no finer than the table's."""
    if to > order:
        raise ValueError("a footprint isn't finer than its tiles; use footprint_of_rows")
    return df.select(healpix.rescale(pixel, order, to).alias("npix")).where("npix is not null").distinct()


def footprint_of_rows(df: DataFrame, ra: str, dec: str, order: int) -> DataFrame:
    return healpix.with_pixel(df.select(ra, dec), ra, dec, order, "npix").select("npix").where("npix is not null").distinct()


def merged_cells(pixels: DataFrame, order: int) -> DataFrame:
    """(order, npix) of a coverage map: complete siblings become their parent, order by order.

    A cell is whole if all its pixels are there; one count over all orders tells, and the map
    holds the whole cells whose parent isn't.
    """
    own = pixels.select(F.col(pixels.columns[0]).cast("long").alias("p")).where("p is not null").distinct()
    every = F.explode(F.array(*(F.struct(F.lit(o).alias("order"), F.shiftright("p", 2 * (order - o)).alias("npix")) for o in range(order + 1)))).alias("c")
    counts = own.select(every).groupBy("c.order", "c.npix").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.where(F.col("n") == F.pow(F.lit(4.0), F.lit(order) - F.col("order"))).select("order", "npix")
    parents = whole.select((F.col("order") + 1).alias("order"), F.col("npix").alias("_parent"))
    within = (whole["order"] == parents["order"]) & (F.shiftright(whole["npix"], 2) == parents["_parent"])
    return whole.join(parents, within, "left_anti")


def tile_costs(a_tiles: DataFrame, cover: DataFrame, b_tiles: DataFrame) -> DataFrame:
    """npix, cost: own rows and those of the partner tiles that it covers.  tiles: npix, n; cover: npix, b_npix."""
    b = b_tiles.select(F.col("npix").alias("b_npix"), F.col("n").alias("b_n"))
    met = cover.join(b, "b_npix").groupBy("npix").agg(F.sum("b_n").alias("b_n"))
    return a_tiles.join(met, "npix", "left").select("npix", (F.col("n") + F.coalesce("b_n", F.lit(0))).alias("cost"))


def strips(costs: DataFrame, n: int) -> DataFrame:
    """npix, cost, strip: contiguous cuts of the tiles in nested order at k / n of the total cost."""
    order = Window.orderBy("npix")
    upto = F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("cost").over(Window.partitionBy())
    middle = upto - F.col("cost") / 2
    return costs.withColumn("strip", F.least(F.lit(n - 1), F.floor(middle * n / total)).cast("int"))


def linked_share(df: DataFrame, index: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(index) >= 0).alias("linked"), (F.count_if(F.col(index) >= 0) / F.count(F.lit(1))).alias("share"))


def coverage_report(recipes: DataFrame) -> DataFrame:
    """Surveys by state of their recipe: ready, skeleton or missing."""
    state = F.when(F.col("rules") > 0, "ready").when(F.col("rules") == 0, "skeleton").otherwise("missing")
    return recipes.groupBy(state.alias("status")).agg(F.count(F.lit(1)).alias("surveys"))
