"""The registered queries of the library over the driver's tables, each with its SQL.

The tables hold no positions: customers and suppliers get some by integer arithmetic, which
any engine repeats exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import healpix, ids, photometry, spectra, sphere, text
from ..functions.columns import rounded
from ..operators import counting, crossmatch, dedup, gather, homogenize, lookup, master, predicates, quality
from ..streaming import live
from .region import Region, cone_search, select_region, selection_of_ids, selection_of_where

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
SQL: dict[str, str] = {}
RADIUS_DEG = 5.0


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        FOUND[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").withColumns({"ra": F.expr("CAST(c_custkey * 7919 % 36000 AS DOUBLE) / 100D"), "dec": F.expr("CAST(c_custkey * 104729 % 17001 AS DOUBLE) / 100D - 85D")})


def supplier_sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").withColumns({"ra": F.expr("CAST(s_suppkey * 3571 % 36000 AS DOUBLE) / 100D"), "dec": F.expr("CAST(s_suppkey * 15485863 % 17001 AS DOUBLE) / 100D - 85D")})


SKY_A, SKY_B = crossmatch.Sky("c_custkey"), crossmatch.Sky("s_suppkey")
CUSTOMER = "c AS (SELECT *, CAST(c_custkey * 7919 % 36000 AS DOUBLE) / CAST(100 AS DOUBLE) AS ra, CAST(c_custkey * 104729 % 17001 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(85 AS DOUBLE) AS dec FROM customer)"
SUPPLIER = "s AS (SELECT *, CAST(s_suppkey * 3571 % 36000 AS DOUBLE) / CAST(100 AS DOUBLE) AS ra, CAST(s_suppkey * 15485863 % 17001 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(85 AS DOUBLE) AS dec FROM supplier)"


def sep_sql(a: str, b: str) -> str:
    half = lambda x: f"pow(sin((radians({b}.{x}) - radians({a}.{x})) / 2), 2)"
    return f"degrees(2 * asin(sqrt(least(CAST(1 AS DOUBLE), {half('dec')} + cos(radians({a}.dec)) * cos(radians({b}.dec)) * {half('ra')}))))"


PAIRS = f"WITH {CUSTOMER}, {SUPPLIER}, p AS (SELECT c_custkey AS source_id_a, s_suppkey AS source_id_b, {sep_sql('c', 's')} AS sep FROM c, s), near AS (SELECT * FROM p WHERE sep <= 5)"
SHOWN = "source_id_a, source_id_b, round(CAST(CAST(sep * 3600 AS REAL) AS DOUBLE), 1) AS sep_arcsec"


def shown(association: DataFrame) -> DataFrame:
    return association.select("source_id_a", "source_id_b", rounded(F.col("sep_arcsec").cast("double"), 1).alias("sep_arcsec"))


def nearest(spark: SparkSession, sf_dir: str, radius: float = RADIUS_DEG) -> DataFrame:
    return crossmatch.match_nearest(customer_sky(spark, sf_dir), supplier_sky(spark, sf_dir), radius, SKY_A, SKY_B)


@query(f"{PAIRS} SELECT {SHOWN} FROM (SELECT *, row_number() OVER (PARTITION BY source_id_a ORDER BY sep, source_id_b) AS r FROM near) WHERE r = 1")
def crossmatch_sky_nearest(spark, sf_dir):
    return shown(nearest(spark, sf_dir))


@query(f"{PAIRS} SELECT {SHOWN} FROM near")
def crossmatch_sky_all(spark, sf_dir):
    return shown(crossmatch.match_all(customer_sky(spark, sf_dir), supplier_sky(spark, sf_dir), RADIUS_DEG, SKY_A, SKY_B))


@query(f"{PAIRS} SELECT source_id_a, round(min(sep), 5) AS sep_deg FROM near GROUP BY source_id_a")
def crossmatch_min_separation(spark, sf_dir):
    found = crossmatch.nearest_separation(customer_sky(spark, sf_dir), supplier_sky(spark, sf_dir), RADIUS_DEG, SKY_A, SKY_B)
    return found.select("source_id_a", rounded("sep_deg", 5).alias("sep_deg"))


@query(f"{PAIRS} SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT source_id_a FROM near)")
def crossmatch_orphans(spark, sf_dir):
    return crossmatch.orphans(customer_sky(spark, sf_dir), nearest(spark, sf_dir), "c_custkey").select("c_custkey")


@query(f"{PAIRS} SELECT {SHOWN} FROM near WHERE CAST(sep * 3600 AS REAL) <= 7200 AND source_id_b = 1")
def association_lookup(spark, sf_dir):
    found = crossmatch.match_all(customer_sky(spark, sf_dir), supplier_sky(spark, sf_dir), RADIUS_DEG, SKY_A, SKY_B)
    return shown(crossmatch.matches_of(found, source_id_b=1, max_sep_arcsec=7200))


@query("SELECT o_orderkey AS source_id_a, c_custkey AS source_id_b, CAST(0 AS DOUBLE) AS sep_arcsec FROM orders JOIN customer ON CAST(o_custkey AS VARCHAR) = CAST(c_custkey AS VARCHAR)")
def crossmatch_column(spark, sf_dir):
    return shown(crossmatch.match_column(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "o_custkey", "c_custkey", crossmatch.Sky("o_orderkey"), crossmatch.Sky("c_custkey")))


LINES = "x AS (SELECT l_orderkey * 10 + l_linenumber AS _source_id, l_orderkey AS source_id_a, CAST(min(l_discount) * 100 AS REAL) AS sep, max(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag FROM lineitem WHERE l_quantity > 10 GROUP BY l_orderkey, l_linenumber)"
BEST = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id_a ORDER BY sep, _source_id) AS r FROM x) WHERE r = 1)"


def order_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 10").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.min("l_returnflag").alias("l_returnflag"), F.min("l_discount").alias("l_discount")).withColumn("_source_id", F.expr("l_orderkey * 10 + l_linenumber"))
    links = lines.select(F.col("l_orderkey").alias("source_id_a"), F.col("_source_id").alias("source_id_b"), F.expr("CAST(l_discount * 100 AS FLOAT)").alias("sep_arcsec"))
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_source_id"), "o_custkey", "o_totalprice")
    return base, gather.GatherPartner("L", lines.select("_source_id", "l_quantity", "l_returnflag"), links, ["l_quantity", "l_returnflag"])


GATHERED = "SELECT o_orderkey AS _source_id, o_custkey, o_totalprice, CAST(sep AS DOUBLE) AS \"L_sep_arcsec\", l_quantity AS \"L_l_quantity\", l_returnflag AS \"L_l_returnflag\" FROM orders"


def gathered(spark, sf_dir, **options):
    base, partner = order_lines(spark, sf_dir)
    return gather.gather(base, [partner], **options).withColumn("L_sep_arcsec", F.col("L_sep_arcsec").cast("double"))


@query(f"WITH {LINES}, {BEST} {GATHERED} LEFT JOIN best ON source_id_a = o_orderkey")
def gather_nearest(spark, sf_dir):
    return gathered(spark, sf_dir)


@query(f"WITH {LINES} {GATHERED} LEFT JOIN x ON source_id_a = o_orderkey")
def gather_all(spark, sf_dir):
    return gathered(spark, sf_dir, multiplicity="all")


@query(f"WITH {LINES}, {BEST} {GATHERED} JOIN best ON source_id_a = o_orderkey")
def gather_matches_only(spark, sf_dir):
    return gathered(spark, sf_dir, keep_all=False)


@query(f"WITH {LINES}, {BEST} SELECT * FROM ({GATHERED} LEFT JOIN best ON source_id_a = o_orderkey) WHERE \"L_l_quantity\" > 30 AND o_totalprice > 1000")
def gather_where_joined(spark, sf_dir):
    return gathered(spark, sf_dir, where_joined="WHERE L_l_quantity > 30 AND o_totalprice > 1000")


@query("SELECT o_custkey AS want_id, o_orderkey AS master_o_orderkey, c_name AS cust_c_name, n_name AS nation_n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = o_orderkey % 25")
def want_master_catalogs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.expr("CAST(o_orderkey % 25 AS INT)").alias("nation_id"))
    want = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    catalogs = {"Cust": (table(spark, sf_dir, "customer"), "c_custkey"), "Nation": (table(spark, sf_dir, "nation"), "n_nationkey")}
    return master.want_master_catalogs(spark, want, orders, "Cust", {"Cust": "o_custkey", "Nation": "nation_id"}, catalogs, {"Cust": ["c_name"], "Nation": ["n_name"]}, ["o_orderkey"])


@query("SELECT o_custkey AS partner_id, o_orderkey AS extract_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def via_crossmatch_pairs(spark, sf_dir):
    links = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_id_a"), F.col("o_custkey").alias("source_id_b"))
    return gather.id_pairs(links, table(spark, sf_dir, "customer").where("c_nationkey = 3").select("c_custkey"))


@query("SELECT DISTINCT o_orderkey AS _source_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def via_crossmatch_ids(spark, sf_dir):
    links = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_id_a"), F.col("o_custkey").alias("source_id_b"))
    return gather.mapped_ids(links, table(spark, sf_dir, "customer").where("c_nationkey = 3").select("c_custkey"))


@query("SELECT o.o_orderkey AS _source_id, o.o_totalprice, b.c_custkey, b.c_name FROM orders o LEFT JOIN (SELECT c_custkey, c_name, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey < 5) b ON b.o_orderkey = o.o_orderkey")
def target_bridge(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    identity = table(spark, sf_dir, "customer").where("c_nationkey < 5").select("c_custkey", "c_name")
    pairs = orders.select(F.col("o_custkey").alias("partner_id"), F.col("o_orderkey").alias("extract_id"))
    return gather.with_bridge(orders.select(F.col("o_orderkey").alias("_source_id"), "o_totalprice"), gather.bridge(identity, "c_custkey", pairs))


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_returnflag = 'R' AND r.l_orderkey = l.l_orderkey AND r.l_suppkey = l.l_suppkey AND r.l_linenumber = l.l_linenumber)")
def anti_join_keys(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return gather.not_in_catalog(lines, lines.where("l_returnflag = 'R'"), ["l_orderkey", "l_suppkey", "l_linenumber"]).select("l_orderkey", "l_partkey", "l_linenumber")


@query("SELECT c_custkey AS _source_id, c_name, o.first_order FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey")
def link_id_embed(spark, sf_dir):
    extract = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_source_id"), "c_name")
    return gather.with_link_ids(extract, {"first_order": (table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "_source_id"), "o_orderkey")})


@query("SELECT v.* FROM (SELECT vec_id, label FROM embeddings) v WHERE vec_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def modality_extract(spark, sf_dir):
    product = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("vec_id"))
    return gather.modality_rows(product, table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")


@query("WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem), b AS (SELECT l_orderkey, l_linenumber, l_tax FROM lineitem) SELECT a.l_orderkey * 10 + a.l_linenumber AS row_, a.l_orderkey, a.l_quantity, b.l_tax FROM a JOIN b USING (l_orderkey, l_linenumber)")
def row_aligned_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("row_", F.expr("l_orderkey * 10 + l_linenumber"))
    return gather.zipped([lines.select("row_", "l_orderkey", "l_quantity"), lines.select("row_", "l_orderkey", "l_tax")], "row_", ["l_orderkey"])


ACOS = "degrees(acos(least(CAST(1 AS DOUBLE), sin(radians(dec)) * sin(radians(CAST(12.5 AS DOUBLE))) + cos(radians(dec)) * cos(radians(CAST(12.5 AS DOUBLE))) * cos(radians(ra) - radians(CAST(100 AS DOUBLE))))))"


@query(f"WITH {CUSTOMER} SELECT c_custkey, round({ACOS}, 6) AS sep_deg FROM c WHERE {ACOS} <= 20.05")
def cone_search_rows(spark, sf_dir):
    tiled = healpix.with_pixel(customer_sky(spark, sf_dir), "ra", "dec", 5, "pix")
    return cone_search(tiled, 100.0, 12.5, 20.05, pixel="pix", order=5).select("c_custkey", rounded("sep_deg", 6).alias("sep_deg"))


@query(f"WITH {CUSTOMER} SELECT c_custkey FROM c WHERE ra BETWEEN 10 AND 50.5 AND dec BETWEEN -20 AND 33.3")
def bbox_search(spark, sf_dir):
    tiled = healpix.with_pixel(customer_sky(spark, sf_dir), "ra", "dec", 4, "pix")
    return select_region(tiled, Region.of_bbox(10, 50.5, -20, 33.3), "pix", 4, exact=True).select("c_custkey")


@query(f"WITH {CUSTOMER} SELECT c_custkey FROM c WHERE (ra >= 350 OR ra <= 15) AND dec BETWEEN -60 AND 60")
def bbox_search_wrapped(spark, sf_dir):
    tiled = healpix.with_pixel(customer_sky(spark, sf_dir), "ra", "dec", 4, "pix")
    return select_region(tiled, Region.of_bbox(350, 15, -60, 60), "pix", 4, exact=True).select("c_custkey")


@query(f"WITH {CUSTOMER}, d AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN -9999 WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN 'NaN'::DOUBLE ELSE ra END AS ra, CASE WHEN c_custkey % 19 = 0 THEN 95 ELSE dec END AS dec FROM c) SELECT c_custkey, ra FROM d WHERE isfinite(ra) AND isfinite(dec) AND dec BETWEEN -90 AND 90 AND ra > -9000")
def valid_sky_rows(spark, sf_dir):
    dirty = customer_sky(spark, sf_dir).withColumns({"ra": F.expr("CASE WHEN c_custkey % 11 = 0 THEN -9999D WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN double('NaN') ELSE ra END"), "dec": F.expr("CASE WHEN c_custkey % 19 = 0 THEN 95D ELSE dec END")})
    return dirty.where(sphere.valid_sky("ra", "dec")).select("c_custkey", "ra")


@query(f"WITH {CUSTOMER}, {SUPPLIER} SELECT c_custkey, round({sep_sql('c', 's')}, 6) AS haversine, round(degrees(acos(least(1.0, sin(radians(c.dec)) * sin(radians(s.dec)) + cos(radians(c.dec)) * cos(radians(s.dec)) * cos(radians(c.ra) - radians(s.ra))))), 5) AS by_acos FROM c JOIN s ON s_suppkey = c_custkey")
def separation_forms(spark, sf_dir):
    met = customer_sky(spark, sf_dir).alias("c").join(supplier_sky(spark, sf_dir).alias("s"), F.col("s_suppkey") == F.col("c_custkey"))
    at = [F.col(x) for x in ("c.ra", "c.dec", "s.ra", "s.dec")]
    return met.select("c_custkey", rounded(sphere.separation(*at), 6).alias("haversine"), rounded(sphere.separation_acos(*at), 5).alias("by_acos"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def id_lookup(spark, sf_dir):
    wanted = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select("l_orderkey").distinct()
    return lookup.by_ids(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), wanted, "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 16 IN (3, 5) AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 40)")
def id_lookup_in_tiles(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("pix", F.expr("o_custkey % 16"))
    wanted = table(spark, sf_dir, "lineitem").where("l_quantity >= 40").select("l_orderkey").distinct()
    return lookup.by_ids_in_tiles(orders, wanted, [3, 5], "pix", "o_orderkey").select("o_orderkey")


@query("WITH links AS (SELECT l_orderkey, l_partkey % 48 AS npix, l_linenumber - 3 AS idx FROM lineitem) SELECT a.o_orderkey, coalesce(m.npix, -1) AS npix, coalesce(m.idx, -1) AS idx FROM (SELECT o_orderkey FROM orders UNION ALL SELECT -o_orderkey FROM orders) a LEFT JOIN (SELECT l_orderkey, npix, CAST(idx AS BIGINT) AS idx FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY npix, idx) AS r FROM links WHERE idx >= 0) WHERE r = 1) m ON m.l_orderkey = a.o_orderkey")
def tile_locate(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.expr("l_partkey % 48").alias("npix"), F.expr("l_linenumber - 3").alias("idx"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    asked = orders.unionByName(orders.select((-F.col("o_orderkey")).alias("o_orderkey")))
    return lookup.tile_of(links, asked, index="idx", pixels=["npix"], id_col="o_orderkey")


@query("SELECT user_id, value FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE user_id IN (SELECT c_custkey FROM customer)) WHERE r = 1")
def values_of_ids(spark, sf_dir):
    return lookup.values_of(table(spark, sf_dir, "events"), table(spark, sf_dir, "customer").select("c_custkey"), ["value"], "user_id", ["event_id"])


@query("SELECT p_partkey, CAST(p_retailprice AS DOUBLE) / 1000 AS z FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def redshift_lookup(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("Redshift", F.expr("CAST(p_retailprice AS DOUBLE) / 1000D"))
    return lookup.redshifts(parts, table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_partkey"), id_col="p_partkey")


@query("SELECT l_orderkey AS id, l_linenumber, l_extendedprice AS price FROM lineitem WHERE (l_discount > 0.05) AND (l_tax < 0.03) ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice LIMIT 500")
def where_limit_extract(spark, sf_dir):
    return predicates.filtered(table(spark, sf_dir, "lineitem"), "WHERE l_discount > 0.05", extra=["l_tax < 0.03"], columns=["L_ORDERKEY:id,l_linenumber", "l_extendedprice:price"], limit=500, order=["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])


@query("SELECT o_orderkey, o_orderkey % 5 - 2 AS _spectrum_index, 7 AS run, CAST(1.5 AS DOUBLE) AS weight, 'x' AS tag FROM orders WHERE o_orderkey % 5 - 2 >= 0")
def linked_rows_with_constants(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("o_orderkey % 5 - 2").alias("_spectrum_index"))
    return predicates.with_constants(predicates.with_index(own, "_spectrum_index"), ["run:int64=7", "weight=1.5", "tag=x"])


@query("SELECT o_orderkey, count(*) AS n_lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 150000 GROUP BY o_orderkey")
def selection_of_predicate(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("pix", F.expr("o_orderkey % 48"))
    chosen = selection_of_where(orders, "orders", "where o_totalprice > 150000", "pix", 1, "o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.expr("l_orderkey % 48").alias("pix"))
    return chosen.rows(lines, "pix", "o_orderkey").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))


@query("SELECT DISTINCT o_orderkey % 48 AS npix FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)")
def tiles_of_ids(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("pix", F.expr("o_orderkey % 48"))
    return selection_of_ids(orders, "orders", table(spark, sf_dir, "lineitem").where("l_quantity = 50").select("l_orderkey"), "pix", 1, "o_orderkey").tiles


def pixel_sql(order: int, source: str) -> str:
    """The nested pixel of (ra, dec) of a table expression, in SQL."""
    n = 1 << order
    spread = lambda x: " + ".join(f"((({x} >> {k}) & 1) << {2 * k})" for k in range(order)) or "0"
    return f"""
      t AS (SELECT *, sin(radians(dec)) AS z, cos(radians(dec)) AS co, ra / 90 AS tt, abs(sin(radians(dec))) <= CAST(2 AS DOUBLE) / 3 AS flat FROM {source}),
      u AS (SELECT *, least(3, floor(tt)) AS q, {n} * co * sqrt(3 / (1 + abs(z))) AS sc FROM t),
      v AS (SELECT *, CAST(CASE WHEN flat THEN floor({n} * (0.5::DOUBLE + tt) - 0.75::DOUBLE * {n} * z) ELSE greatest(0, least({n - 1}, floor((tt - q) * sc))) END AS BIGINT) AS jp,
            CAST(CASE WHEN flat THEN floor({n} * (0.5::DOUBLE + tt) + 0.75::DOUBLE * {n} * z) ELSE greatest(0, least({n - 1}, floor((1 - (tt - q)) * sc))) END AS BIGINT) AS jm FROM u),
      w AS (SELECT *, CASE WHEN flat THEN CASE WHEN (jp >> {order}) = (jm >> {order}) THEN (jp >> {order}) | 4 WHEN (jp >> {order}) < (jm >> {order}) THEN jp >> {order} ELSE (jm >> {order}) + 8 END WHEN z > 0 THEN CAST(q AS BIGINT) ELSE CAST(q AS BIGINT) + 8 END AS face,
            CASE WHEN flat THEN jm & {n - 1} WHEN z > 0 THEN {n - 1} - jm ELSE jp END AS ix, CASE WHEN flat THEN {n - 1} - (jp & {n - 1}) WHEN z > 0 THEN {n - 1} - jp ELSE jm END AS iy FROM v),
      placed AS (SELECT *, CAST(face * {n * n} + ({spread('ix')}) + 2 * ({spread('iy')}) AS BIGINT) AS pix FROM w)"""


@query(f"WITH {CUSTOMER}, {pixel_sql(8, 'c')} SELECT c_custkey, pix FROM placed")
def healpix_ang2pix(spark, sf_dir):
    return healpix.with_pixel(customer_sky(spark, sf_dir), "ra", "dec", 8, "pix").select("c_custkey", "pix")


@query("SELECT o_orderkey % 49152 AS pix, ((o_orderkey % 49152) >> 4) AS parent, ((o_orderkey % 49152) << 2) AS first_child, 4 AS children, ((o_orderkey % 49152) // 10000) * 10000 AS dir, concat('Norder=6/Dir=', ((o_orderkey % 49152) // 10000) * 10000, '/Npix=', o_orderkey % 49152) AS path FROM orders")
def healpix_rescale(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.expr("o_orderkey % 49152").alias("pix"))
    down = healpix.rescale("pix", 6, 7)
    return own.select("pix", healpix.rescale("pix", 6, 4).alias("parent"), F.array_min(down).alias("first_child"), F.size(down).alias("children"), healpix.dir_bucket("pix").alias("dir"), healpix.tile_path("pix", 6).alias("path"))


DISCOVER = "SELECT '{0}' AS survey, 'catalog' AS modality, count(*) AS tiles, count(r.p) AS overlap_tiles, CAST(round_even(sum(n) / count(*) * count(r.p), 0) AS BIGINT) AS est_rows, CAST(coalesce(sum(CASE WHEN r.p IS NOT NULL THEN n END), 0) AS BIGINT) AS exact_rows FROM (SELECT {1} AS p, count(*) AS n FROM {2} GROUP BY 1) t LEFT JOIN (SELECT range AS p FROM range(10, 20)) r ON r.p = t.p"


@query(DISCOVER.format("orders", "o_custkey % 48", "orders") + " UNION ALL " + DISCOVER.format("lineitem", "l_partkey % 48", "lineitem"))
def region_discovery(spark, sf_dir):
    pixels = spark.range(10, 20)
    layers = {("orders", "catalog"): (table(spark, sf_dir, "orders").select(F.expr("o_custkey % 48").alias("p")), "p"), ("lineitem", "catalog"): (table(spark, sf_dir, "lineitem").select(F.expr("l_partkey % 48").alias("p")), "p")}
    return counting.discover(layers, pixels)


REGISTRY = "r AS (SELECT 'orders' AS survey, 'catalog' AS modality, count(*) AS total_rows FROM orders UNION ALL SELECT 'customer', 'catalog', count(*) FROM customer UNION ALL SELECT 'orders', 'spectra', count(*) FROM embeddings UNION ALL SELECT 'part', 'cutouts', NULL)"


def registry(spark, sf_dir):
    row = lambda survey, modality, name: table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("total_rows")).select(F.lit(survey).alias("survey"), F.lit(modality).alias("modality"), "total_rows")
    unknown = spark.range(1).select(F.lit("part").alias("survey"), F.lit("cutouts").alias("modality"))
    return counting.registry([row("orders", "catalog", "orders"), row("customer", "catalog", "customer"), row("orders", "spectra", "embeddings"), unknown])


@query(f"WITH {REGISTRY} SELECT modality, count(*) AS surveys, CAST(sum(total_rows) AS BIGINT) AS total_rows, count(*) - count(total_rows) AS unknown FROM r GROUP BY ROLLUP (modality)")
def registry_totals(spark, sf_dir):
    return counting.registry_totals(registry(spark, sf_dir))


@query(f"WITH {REGISTRY} SELECT survey, CAST(sum(CASE WHEN modality = 'catalog' THEN total_rows END) AS BIGINT) AS catalog, CAST(sum(CASE WHEN modality = 'spectra' THEN total_rows END) AS BIGINT) AS spectra FROM r GROUP BY survey")
def registry_pairs(spark, sf_dir):
    return counting.paired(registry(spark, sf_dir), ["catalog", "spectra"])


ORDERS = ", ".join(f"({o})" for o in range(3, 9))


@query(f"WITH {CUSTOMER}, {pixel_sql(8, 'c')} SELECT o AS \"order\", count(DISTINCT pix >> (2 * (8 - o))) AS pixels, CAST(count(*) AS DOUBLE) / count(DISTINCT pix >> (2 * (8 - o))) AS rows_per_pixel, count(DISTINCT pix >> (2 * (8 - o))) / (12 * pow(4, o)) AS sky_fraction FROM placed, (VALUES {ORDERS}) v(o) GROUP BY o")
def order_densities(spark, sf_dir):
    return counting.order_densities(customer_sky(spark, sf_dir), "ra", "dec")


@query("WITH e AS (SELECT l_orderkey, count(*) AS times FROM lineitem GROUP BY 1), h AS (SELECT times, count(*) AS keys FROM e GROUP BY 1) SELECT times, keys, times * keys AS rows, keys / sum(keys) OVER () AS share FROM h")
def multiplicity_histogram(spark, sf_dir):
    return counting.multiplicity(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query(f"WITH {CUSTOMER}, {pixel_sql(8, 'c')} SELECT DISTINCT pix >> 8 AS npix FROM placed")
def footprint_tiles(spark, sf_dir):
    tiled = healpix.with_pixel(customer_sky(spark, sf_dir), "ra", "dec", 8, "pix")
    return counting.footprint(tiled, "pix", 8, 4)


@query(f"WITH {CUSTOMER}, {pixel_sql(2, 'c')}, l2 AS (SELECT DISTINCT pix AS npix FROM placed), p2 AS (SELECT npix >> 2 AS npix FROM l2 GROUP BY 1 HAVING count(*) = 4), p1 AS (SELECT npix >> 2 AS npix FROM p2 GROUP BY 1 HAVING count(*) = 4) SELECT 2 AS \"order\", npix FROM l2 WHERE npix >> 2 NOT IN (SELECT npix FROM p2) UNION ALL SELECT 1, npix FROM p2 WHERE npix >> 2 NOT IN (SELECT npix FROM p1) UNION ALL SELECT 0, npix FROM p1")
def footprint_merged(spark, sf_dir):
    return counting.merged_cells(counting.footprint_of_rows(customer_sky(spark, sf_dir), "ra", "dec", 2), 2)


@query("WITH t AS (SELECT o_custkey % 192 AS npix, count(*) AS cost FROM orders GROUP BY 1), x AS (SELECT *, sum(cost) OVER (ORDER BY npix) - cost / 2 AS middle, sum(cost) OVER () AS total FROM t) SELECT npix, cost, CAST(least(3, floor(middle * 4 / total)) AS INTEGER) AS strip FROM x")
def tile_strips(spark, sf_dir):
    tiles = table(spark, sf_dir, "orders").groupBy(F.expr("o_custkey % 192").alias("npix")).agg(F.count(F.lit(1)).alias("cost"))
    return counting.strips(tiles, 4)


@query("WITH a AS (SELECT o_custkey % 192 AS npix, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT c_custkey % 192 AS npix, count(*) AS n FROM customer GROUP BY 1) SELECT a.npix, CAST(a.n + coalesce((SELECT sum(b.n) FROM b WHERE b.npix IN (a.npix, a.npix + 1)), 0) AS BIGINT) AS cost FROM a")
def tile_costs(spark, sf_dir):
    tiles = lambda name, key: table(spark, sf_dir, name).groupBy(F.expr(f"{key} % 192").alias("npix")).agg(F.count(F.lit(1)).alias("n"))
    a = tiles("orders", "o_custkey")
    cover = a.select("npix", F.explode(F.array("npix", F.col("npix") + 1)).alias("b_npix"))
    return counting.tile_costs(a, cover, tiles("customer", "c_custkey"))


@query("SELECT count(*) AS rows, count(*) FILTER (o_orderkey % 5 - 2 >= 0) AS linked, count(*) FILTER (o_orderkey % 5 - 2 >= 0) / count(*) AS share FROM orders")
def linkage_fraction(spark, sf_dir):
    return counting.linked_share(table(spark, sf_dir, "orders").withColumn("_spectrum_index", F.expr("o_orderkey % 5 - 2")), "_spectrum_index")


@query("SELECT event_id, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1 OR user_id IS NULL")
def dedup_first(spark, sf_dir):
    return dedup.first_of_each(table(spark, sf_dir, "events").select("event_id", "user_id", "value", "ts"), "user_id", ["ts", "event_id"]).drop("ts")


@query("SELECT event_id, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 OR user_id IS NULL")
def dedup_last(spark, sf_dir):
    return dedup.last_of_each(table(spark, sf_dir, "events").select("event_id", "user_id", "value", "ts"), "user_id", ["ts", "event_id"]).drop("ts")


@query("SELECT user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY user_id HAVING count(*) > 1")
def repeated_ids(spark, sf_dir):
    return dedup.repeated(table(spark, sf_dir, "events"), "user_id")


HALVES = "old AS (SELECT event_id, user_id, value FROM events WHERE event_id % 2 = 0), new AS (SELECT event_id, user_id, value FROM events WHERE event_id % 2 <> 0 OR event_id IS NULL)"


def halves(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return events.where("event_id % 2 = 0"), events.where("event_id % 2 <> 0 OR event_id IS NULL")


@query(f"WITH {HALVES} SELECT * FROM old UNION ALL SELECT * FROM new WHERE user_id IS NULL OR user_id NOT IN (SELECT user_id FROM old WHERE user_id IS NOT NULL)")
def append_skip(spark, sf_dir):
    return dedup.appended(*halves(spark, sf_dir), "user_id", "skip")


@query(f"WITH {HALVES} SELECT * FROM new UNION ALL SELECT * FROM old WHERE user_id IS NULL OR user_id NOT IN (SELECT user_id FROM new WHERE user_id IS NOT NULL)")
def append_last(spark, sf_dir):
    return dedup.appended(*halves(spark, sf_dir), "user_id", "last")


@query("SELECT o_orderkey, npix, row_number() OVER (ORDER BY npix, o_orderkey) - 1 AS step FROM (SELECT o_orderkey, o_custkey % 192 AS npix FROM orders)")
def tile_sequential_order(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("o_custkey % 192").alias("npix"))
    return lookup.tile_sequential(own, "npix", "o_orderkey")


@query("SELECT min(p) AS first, max(p) AS last, count(*) AS n FROM (SELECT p, p - row_number() OVER (ORDER BY p) AS g FROM (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_quantity > 48)) GROUP BY g")
def contiguous_runs(spark, sf_dir):
    return lookup.islands(table(spark, sf_dir, "lineitem").where("l_quantity > 48"), "l_partkey")


@query("SELECT npix, CAST((row_number() OVER (ORDER BY npix) - 1) % 5 AS INTEGER) AS worker FROM (SELECT DISTINCT o_custkey % 192 AS npix FROM orders)")
def striped_tiles(spark, sf_dir):
    return lookup.striped(table(spark, sf_dir, "orders").select(F.expr("o_custkey % 192").alias("npix")), "npix", 5).withColumn("worker", F.col("worker").cast("int"))


def rule(source, target, *steps, **more):
    return photometry.Rule(source, target, tuple(photometry.Step(**s) for s in steps), **more)


DIRTY = "p AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_partkey % 10 = 0 THEN -9999 WHEN l_partkey % 10 = 1 THEN 0 WHEN l_partkey % 10 = 2 THEN -3 WHEN l_partkey % 10 = 3 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS f, CASE WHEN l_suppkey % 10 = 0 THEN 999 ELSE CAST(l_tax AS DOUBLE) END AS e FROM lineitem)"
CLEAN = "q AS (SELECT id, CASE WHEN f NOT IN (9999, -9999, 999, -999) THEN f END AS f, CASE WHEN e NOT IN (9999, -9999, 999, -999) THEN e END AS e, f AS raw FROM p)"


def dirty(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey * 10 + l_linenumber").alias("id"), F.expr("CASE WHEN l_partkey % 10 = 0 THEN -9999D WHEN l_partkey % 10 = 1 THEN 0D WHEN l_partkey % 10 = 2 THEN -3D WHEN l_partkey % 10 = 3 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END").alias("f"), F.expr("CASE WHEN l_suppkey % 10 = 0 THEN 999D ELSE CAST(l_tax AS DOUBLE) END").alias("e"))


@query(f"WITH {DIRTY}, {CLEAN} SELECT id, round(f + 2.699, 6) AS shifted, round(f * 0.001, 9) AS scaled, CASE WHEN f <> 0 THEN round(1 / f, 6) END AS inverse, CASE WHEN f <> -3 THEN f END AS no_three, round(e * 0.001, 9) AS scaled_err FROM q")
def homogenize_steps(spark, sf_dir):
    rules = [rule("f", "shifted", {"kind": "mag_offset", "delta": 2.699}), rule("f", "scaled", {"kind": "scale", "factor": 0.001}, error="e"), rule("f", "inverse", {"kind": "inverse"}), rule("f", "no_three", {"kind": "null_if_sentinel", "values": (-3.0,)})]
    out, _ = homogenize.apply_rules(dirty(spark, sf_dir), rules)
    return out.select("id", rounded("shifted", 6).alias("shifted"), rounded("scaled", 9).alias("scaled"), rounded("inverse", 6).alias("inverse"), "no_three", rounded("scaled_err", 9).alias("scaled_err"))


@query(f"WITH {DIRTY}, {CLEAN} SELECT id, round(CASE WHEN f > 0 THEN -2.5 * log10(f) + 22.5 END, 6) AS phot_ab_g, round(CASE WHEN f > 0 THEN 1.0857362047461345 * e / f END, 6) AS phot_ab_g_err FROM q")
def homogenize_flux_to_ab(spark, sf_dir):
    out, _ = homogenize.apply_rules(dirty(spark, sf_dir), [rule("f", "phot_ab_g", {"kind": "flux_to_ab", "zero_point": 22.5}, error="e")])
    return out.select("id", rounded("phot_ab_g", 6).alias("phot_ab_g"), rounded("phot_ab_g_err", 6).alias("phot_ab_g_err"))


@query(f"WITH {DIRTY}, {CLEAN} SELECT id, round(CASE WHEN f > 0 THEN -2.5 * log10(f * 3.5) + 23.9 + 0.02 END, 6) AS m, round(CASE WHEN f > 0 THEN 1.0857362047461345 * (e * 3.5) / (f * 3.5) END, 6) AS m_err FROM q")
def homogenize_chain(spark, sf_dir):
    steps = ({"kind": "scale", "factor": 3.5}, {"kind": "flux_to_ab", "zero_point": 23.9}, {"kind": "mag_offset", "delta": 0.02})
    out, _ = homogenize.apply_rules(dirty(spark, sf_dir), [rule("f", "m", *steps, error="e")])
    return out.select("id", rounded("m", 6).alias("m"), rounded("m_err", 6).alias("m_err"))


@query(f"WITH {DIRTY}, {CLEAN} SELECT id, round(raw + 0.5, 6) AS offset_view, round(3631 * pow(10, -0.4 * f), 4) AS vega FROM q")
def homogenize_sql_view(spark, sf_dir):
    out, _ = homogenize.apply_rules(dirty(spark, sf_dir), [rule("f", "offset_view", {"kind": "mag_offset", "delta": 0.5})], sql_form=True)
    return out.select("id", rounded("offset_view", 6).alias("offset_view"), rounded(photometry.vega_flux(photometry.clean("f"), 3631), 4).alias("vega"))


@query("WITH x AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_retailprice AS DOUBLE) / 100 END AS g, CAST(p_size AS DOUBLE) AS r, CAST(p_size AS DOUBLE) / 100 AS r_err FROM part) SELECT id, 'g' AS band, CAST(4770 AS DOUBLE) AS lambda_eff, round(g, 6) AS mag, CAST(NULL AS DOUBLE) AS err FROM x WHERE g IS NOT NULL UNION ALL SELECT id, 'r', 6231, round(r, 6), round(r_err, 6) FROM x")
def sed_unpivot(spark, sf_dir):
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_retailprice AS DOUBLE) / 100D END").alias("phot_ab_g"), F.expr("CAST(p_size AS DOUBLE)").alias("phot_ab_r"), F.expr("CAST(p_size AS DOUBLE) / 100D").alias("phot_ab_r_err"), F.lit(1.0).alias("phot_ab_unknown"))
    bands = spark.createDataFrame([("g", 4770.0), ("r", 6231.0), ("i", 7625.0)], "band string, lambda_eff double")
    points = homogenize.sed_points(own, bands, "id")
    return points.select("id", "band", "lambda_eff", rounded("mag", 6).alias("mag"), rounded("err", 6).alias("err"))


def spectrum_rows(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("flux"))
    return own.withColumns({"ivar": F.expr("transform(flux, x -> IF(x > 0, x * 10D, 0D))"), "mask": F.expr("transform(flux, (x, i) -> CAST(i % 7 = 0 AS INT))"), "z": F.expr("CASE WHEN vec_id % 5 = 0 THEN NULL ELSE CAST(vec_id % 10 AS DOUBLE) / 10D END")})


SPECTRA = "e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS flux, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE CAST(vec_id % 10 AS DOUBLE) / 10 END AS z FROM embeddings), s AS (SELECT *, list_transform(flux, lambda x: CASE WHEN x > 0 THEN x * 10 ELSE CAST(0 AS DOUBLE) END) AS ivar, list_transform(flux, lambda x, i: CASE WHEN (i - 1) % 7 = 0 THEN 1 ELSE 0 END) AS mask FROM e)"


def total(c, digits=6):
    return rounded(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), digits)


@query(f"WITH {SPECTRA} SELECT vec_id, round(list_sum(list_transform(flux, lambda x: x * 2.5)), 6) AS flux_sum, round(list_sum(list_transform(ivar, lambda x: CASE WHEN x > 0 THEN x / 6.25 ELSE CAST(0 AS DOUBLE) END)), 6) AS ivar_sum FROM s")
def spectra_scale(spark, sf_dir):
    out = homogenize.homogenize_spectra(spectrum_rows(spark, sf_dir), 2.5)
    return out.select("vec_id", total("flux").alias("flux_sum"), total("ivar").alias("ivar_sum"))


@query(f"WITH {SPECTRA} SELECT vec_id, CAST(len(list_filter(list_zip(ivar, mask), lambda p: p[1] > 0 AND p[2] = 0)) AS INTEGER) AS good, CAST(len(list_filter(ivar, lambda x: NOT x > 0)) AS INTEGER) AS infinite, round(list_sum(list_transform(list_filter(ivar, lambda x: x > 0), lambda x: CAST(CAST(1 / sqrt(x) AS REAL) AS DOUBLE))), 4) AS error_sum FROM s")
def spectra_errors(spark, sf_dir):
    own = spectrum_rows(spark, sf_dir).withColumns({"err": spectra.error_of_ivar("ivar"), "good": spectra.good("ivar", "mask")})
    finite = F.filter("err", lambda x: x < F.lit(float("inf")))
    return own.select("vec_id", F.size(F.filter("good", lambda g: g)).alias("good"), (F.size("err") - F.size(finite)).alias("infinite"), total(F.transform(finite, lambda x: x.cast("double")), 4).alias("error_sum"))


@query(f"WITH {SPECTRA} SELECT vec_id, list_transform(range(0, 5), lambda i: round((3600 + 100 * i) / (1 + coalesce(z, 0)), 6)) AS rest, list_transform(range(0, 4), lambda i: round(pow(10, 3.5 + 0.001 * i), 6)) AS log_grid FROM s")
def spectra_wavelengths(spark, sf_dir):
    own = spectrum_rows(spark, sf_dir)
    grid = spectra.linear_wavelengths(F.lit(5), F.lit(3600.0), F.lit(100.0))
    logs = spectra.linear_wavelengths(F.lit(4), F.lit(3.5), F.lit(0.001), log=True)
    return own.select("vec_id", F.transform(spectra.rest_frame(grid, "z"), lambda x: rounded(x, 6)).alias("rest"), F.transform(logs, lambda x: rounded(x, 6)).alias("log_grid"))


@query(f"WITH {SPECTRA}, g AS (SELECT *, list_median(list_transform(list_filter(list_zip(flux, ivar, mask), lambda p: p[2] > 0 AND p[3] = 0), lambda p: p[1])) AS m FROM s) SELECT vec_id, round(CASE WHEN m <> 0 THEN m ELSE 1 END, 6) AS norm, round(list_sum(list_transform(flux, lambda x: x / (CASE WHEN m <> 0 THEN m ELSE 1 END))), 3) AS flux_sum, round(list_sum(list_transform(flux, lambda x: ln(1 + greatest(x, 0)))), 5) AS log_sum FROM g")
def spectra_median_normalise(spark, sf_dir):
    own = spectrum_rows(spark, sf_dir).withColumn("norm", spectra.good_median("flux", "ivar", "mask"))
    return own.select("vec_id", rounded("norm", 6).alias("norm"), total(spectra.normalised("flux", "ivar", "mask")["flux"], 3).alias("flux_sum"), total(spectra.log_flux("flux"), 5).alias("log_sum"))


@query(f"WITH {SPECTRA} SELECT vec_id, CAST(70 AS INTEGER) AS n, flux[1:3] AS head, round(list_sum(list_transform(list_zip(ivar, mask), lambda p: CASE WHEN p[2] = 0 THEN p[1] ELSE CAST(0 AS DOUBLE) END)), 6) AS ivar_sum, round(list_sum(list_transform(list_filter(list_zip(flux, mask), lambda p: p[2] = 0), lambda p: p[1])), 6) AS flux_sum FROM s")
def spectra_mask_and_pad(spark, sf_dir):
    own = spectrum_rows(spark, sf_dir)
    kept = F.filter(spectra.masked_flux("flux", "mask"), lambda x: ~F.isnan(x))
    return own.select("vec_id", F.size(spectra.padded("flux", 70, float("nan"))).alias("n"), spectra.padded("flux", 3, float("nan")).alias("head"), total(spectra.masked_ivar("ivar", "mask")).alias("ivar_sum"), total(kept).alias("flux_sum"))


@query("WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS f FROM embeddings), k AS (SELECT *, list_transform(range(1, len(f) + 1), lambda i: 0.5 * f[i] + CASE WHEN i > 1 THEN 0.25 * f[i - 1] ELSE 0 END + CASE WHEN i < len(f) THEN 0.25 * f[i + 1] ELSE 0 END) AS s FROM e) SELECT vec_id, list_transform(s[1:8], lambda x: round(x, 6)) AS smooth, round(list_sum(s), 5) AS total FROM k")
def spectra_resolution(spark, sf_dir):
    own = spectrum_rows(spark, sf_dir)
    n = F.size("flux")
    bands = F.array(*(F.array_repeat(F.lit(v), n) for v in (0.25, 0.5, 0.25)))
    out = own.withColumn("s", spectra.resolution_applied("flux", bands, [-1, 0, 1]))
    return out.select("vec_id", F.transform(F.slice("s", 1, 8), lambda x: rounded(x, 6)).alias("smooth"), total("s", 5).alias("total"))


@query("WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS f FROM embeddings), m AS (SELECT *, list_median(f) AS med FROM e), d AS (SELECT *, 1.4826 * list_median(list_transform(f, lambda x: abs(x - med))) AS mad FROM m), k AS (SELECT *, list_filter(f, lambda x: abs(x - med) <= 1.5 * mad) AS kept FROM d) SELECT vec_id, round(list_min(kept) - 0.05 * (list_max(kept) - list_min(kept)), 6) AS low, round(list_max(kept) + 0.05 * (list_max(kept) - list_min(kept)), 6) AS high FROM k")
def spectra_clip_limits(spark, sf_dir):
    own = spectrum_rows(spark, sf_dir).withColumn("l", spectra.mad_limits("flux", 1.5))
    return own.select("vec_id", rounded("l.low", 6).alias("low"), rounded("l.high", 6).alias("high"))


@query("SELECT vec_id, list_transform(embedding, lambda x, i: round(CAST(x AS DOUBLE) * CASE (i - 1) // 16 WHEN 0 THEN 2.0 WHEN 1 THEN 0.5 ELSE 3.0 END, 6)) AS image FROM embeddings")
def cutout_band_scale(spark, sf_dir):
    own = spectrum_rows(spark, sf_dir).select("vec_id", F.col("flux").alias("image"))
    out = homogenize.homogenize_cutouts(own, [2.0, 0.5], 16, default=3.0)
    return out.select("vec_id", F.transform("image", lambda x: rounded(x, 6)).alias("image"))


@query("WITH a AS (SELECT vec_id, -vec_id AS pos FROM embeddings UNION ALL SELECT vec_id, vec_id + 1000000000 FROM embeddings) SELECT a.pos, a.vec_id, e.label FROM a JOIN embeddings e ON e.vec_id = a.vec_id ORDER BY a.pos")
def batch_lookup_order(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings").select("vec_id")
    asked = own.withColumn("pos", -F.col("vec_id")).unionByName(own.withColumn("pos", F.col("vec_id") + 1000000000))
    return lookup.batch(table(spark, sf_dir, "embeddings").select("vec_id", "label"), asked, "pos", "vec_id").select("pos", "vec_id", "label")


@query("SELECT e.vec_id, coalesce(CAST(p.p_retailprice AS DOUBLE) / 1000, CAST(e.label AS DOUBLE)) AS z FROM embeddings e LEFT JOIN part p ON p.p_partkey = e.vec_id AND p.p_partkey % 2 = 0 WHERE e.vec_id IN (SELECT o_custkey FROM orders)")
def subset_with_redshift(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("double").alias("z"))
    catalog = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("vec_id"), F.expr("CAST(p_retailprice AS DOUBLE) / 1000D").alias("Z_HP"))
    return lookup.subset(rows, table(spark, sf_dir, "orders").select("o_custkey"), catalog, "vec_id").select("vec_id", "z")


LATEST = "m AS (SELECT l_orderkey AS id, npix, idx FROM (SELECT l_orderkey, l_suppkey % 48 AS npix, CAST(l_linenumber AS BIGINT) AS idx, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 48 DESC, l_linenumber DESC) AS r FROM lineitem WHERE l_quantity > 25) WHERE r = 1)"


def link_map(spark, sf_dir):
    places = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"), F.expr("l_suppkey % 48").alias("npix"), F.col("l_linenumber").cast("long").alias("idx"))
    return lookup.index_map(places, "o_orderkey")


@query(f"WITH {LATEST} SELECT o_orderkey, coalesce(m.idx, o_custkey % 3) AS _spectrum_index, coalesce(m.npix, -1) AS _spectrum_npix FROM orders LEFT JOIN m ON m.id = o_orderkey")
def index_backpatch(spark, sf_dir):
    catalog = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("o_custkey % 3").alias("_spectrum_index"))
    return lookup.back_patched(catalog, link_map(spark, sf_dir), "_spectrum_index", "_spectrum_npix", "o_orderkey")


@query(f"WITH {LATEST} SELECT o_orderkey, coalesce(m.idx, -1) AS _spectrum_index FROM orders LEFT JOIN m ON m.id = o_orderkey")
def index_backpatch_reset(spark, sf_dir):
    catalog = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("o_custkey % 3").alias("_spectrum_index"))
    return lookup.back_patched(catalog, link_map(spark, sf_dir), "_spectrum_index", None, "o_orderkey", reset_unmatched=True)


@query("SELECT fiber, l_orderkey, repeats FROM (SELECT l_linenumber AS fiber, l_orderkey, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_orderkey, l_partkey) AS r, count(*) OVER (PARTITION BY l_linenumber) - 1 AS repeats FROM lineitem WHERE l_suppkey = 7 AND l_quantity = 20) WHERE r = 1")
def fiber_lookup(spark, sf_dir):
    return lookup.fiber_map(table(spark, sf_dir, "lineitem"), 7, 20, "l_orderkey", plate_col="l_suppkey", mjd_col="l_quantity", fiber_col="l_linenumber", order=["l_orderkey", "l_partkey"])


@query("""
WITH cat AS (SELECT CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderkey END AS id, CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE o_orderkey // 12 + CASE WHEN o_orderkey % 9 = 1 THEN 1 ELSE 0 END END AS i, o_orderkey % 12 AS p FROM orders),
spec AS (SELECT l_orderkey + CASE WHEN l_orderkey % 31 = 0 THEN 1000000000 ELSE 0 END AS id, l_orderkey % 12 AS p, l_orderkey // 12 AS i FROM lineitem GROUP BY l_orderkey HAVING min(l_quantity) > 5),
fwd AS (SELECT CASE WHEN c.id IS NULL THEN 'null_id' WHEN s.i IS NULL THEN 'stale' WHEN s.id <> c.id THEN 'wrong_id' ELSE 'ok' END AS state FROM cat c LEFT JOIN spec s ON s.p = c.p AND s.i = c.i WHERE c.i >= 0),
un AS (SELECT CASE WHEN c.id IN (SELECT id FROM spec) THEN 'unpatched' ELSE 'unlinked' END AS state FROM cat c WHERE c.i < 0),
orphan AS (SELECT 'orphan' AS state FROM spec WHERE id NOT IN (SELECT id FROM cat WHERE id IS NOT NULL))
SELECT state, count(*) AS n FROM (SELECT * FROM fwd UNION ALL SELECT * FROM un UNION ALL SELECT * FROM orphan) GROUP BY state""")
def link_validation(spark, sf_dir):
    catalog = table(spark, sf_dir, "orders").select(F.expr("CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderkey END").alias("_source_id"), F.expr("CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE o_orderkey div 12 + IF(o_orderkey % 9 = 1, 1, 0) END").alias("_spectrum_index"), F.expr("o_orderkey % 12").alias("npix"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").alias("least")).where("least > 5")
    spec = lines.select(F.expr("l_orderkey + CASE WHEN l_orderkey % 31 = 0 THEN 1000000000 ELSE 0 END").alias("_source_id"), F.expr("l_orderkey % 12").alias("npix"), F.expr("l_orderkey div 12").alias("idx"))
    return quality.link_counters(quality.link_states(catalog, spec))


@query("SELECT o_orderkey, (o_custkey % 4000) | ((50000 + o_orderkey % 9000) << 16) | ((1 + o_orderkey % 640) << 32) | (CAST(2 AS BIGINT) << 42) AS dr7, CAST(((o_custkey % 4000) * 1125899906842624) | ((1 + o_orderkey % 640) << 38) | ((o_orderkey % 9000) << 24) | (CAST(702 AS BIGINT) << 10) AS BIGINT) AS dr8 FROM orders")
def spec_object_ids(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("o_custkey % 4000").alias("plate"), F.expr("50000 + o_orderkey % 9000").alias("mjd"), F.expr("1 + o_orderkey % 640").alias("fiber"), F.lit("v5_7_2").alias("run"))
    return own.select("o_orderkey", ids.spec_id_dr7("plate", "mjd", "fiber", 2).alias("dr7"), ids.spec_id_dr8("plate", "mjd", "fiber", ids.run2d_code("run")).alias("dr8"))


@query("SELECT o_orderkey, CASE WHEN u > 9223372036854775807 THEN CAST(u - 18446744073709551616::HUGEINT AS BIGINT) ELSE CAST(u AS BIGINT) END AS id FROM (SELECT o_orderkey, 9223372036854770000::HUGEINT + o_orderkey * 3 AS u FROM orders)")
def unsigned_ids(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("CAST(9223372036854770000 AS DECIMAL(20, 0)) + o_orderkey * 3").cast("string").alias("u"))
    return own.select("o_orderkey", ids.normalize("u").alias("id"))


@query("SELECT o_orderkey, concat_ws('|', CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey AS VARCHAR) END, o_orderstatus) AS label, CASE WHEN o_orderkey % 3 > 0 THEN concat_ws('|', o_custkey, o_orderstatus) END AS whole FROM orders")
def composite_labels(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("CASE o_orderkey % 3 WHEN 0 THEN '  ' ELSE CAST(o_custkey AS STRING) END").alias("a"), F.concat(F.lit(" "), "o_orderstatus").alias("b"))
    return own.select("o_orderkey", ids.composite_label(["a", "b"]).alias("label"), ids.composite_label(["a", "b"], require_all=True).alias("whole"))


@query()
def object_ids(spark, sf_dir):
    """Hashes have no SQL form; tests hold them against hashlib."""
    return table(spark, sf_dir, "customer").select("c_custkey", ids.normalize("c_name").alias("id"), ids.composite_id(["c_name", "c_mktsegment"]).alias("composite"))


@query("WITH s AS (SELECT doc_id, 10 * ((length(lower(coalesce(lang, ''))) - length(replace(lower(coalesce(lang, '')), 'en', ''))) // 2) + 5 * ((length(lower(coalesce(source, ''))) - length(replace(lower(coalesce(source, '')), 'en', ''))) // 2) + (length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), 'en', ''))) // 2 AS score FROM documents) SELECT doc_id, CAST(score AS BIGINT) AS score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20")
def doc_search_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = docs.withColumn("score", text.keyword_score(["en"], "lang", "source", "text")).where("score > 0")
    return scored.orderBy(F.col("score").desc(), "doc_id").limit(20).select("doc_id", "score")


@query("SELECT page_id, sha256(html) AS sha FROM pages")
def source_checksum(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.checksum("html").alias("sha"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_totalprice AS DOUBLE) AS v FROM orders UNION ALL SELECT p_name, CAST(p_size AS DOUBLE) FROM part UNION ALL SELECT r_name, NULL FROM region")
def union_of_types(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    b = table(spark, sf_dir, "part").select(F.col("p_name").alias("id"), F.col("p_size").alias("v"))
    c = table(spark, sf_dir, "region").select(F.col("r_name").alias("id"), F.lit(None).alias("v"))
    return gather.as_types([a, b, c])


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return live.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "1 hour")


@query("SELECT n_regionkey AS survey, CASE WHEN max(n_nationkey) - min(n_nationkey) = 0 THEN true ELSE false END AS order_match, count(*) AS layers FROM nation GROUP BY 1")
def registry_order_match(spark, sf_dir):
    reg = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("survey"), F.col("n_nationkey").alias("healpix_order"))
    return counting.with_order_match(reg).groupBy("survey").agg(F.first("order_match").alias("order_match"), F.count(F.lit(1)).alias("layers"))


def queries() -> dict[str, Query]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
