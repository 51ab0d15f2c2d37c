"""More registered queries: sources, sinks, the lake's writes, selections, homogenization and arrays.

Queries of sources and sinks write a table to the shared folder, read it back by the
library, and hold the result against the tables' own rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import healpix, ids, spectra, sphere
from ..functions import sql as sql_functions
from ..functions.columns import rounded
from ..operators import arrays, counting, crossmatch, dedup, gather, homogenize, lookup, master, predicates, quality
from ..sources import files, fits, readers, writers
from ..sources.bandpasses import Bandpasses
from ..sources.lake import Lake, manifest, role_of
from ..streaming import live
from .area import Area, Layer, cost, ingest_advice, run_area, suggest_plan
from .queries import CUSTOMER, SPECTRA, SUPPLIER, customer_sky, pixel_sql, query, sep_sql, spectrum_rows, supplier_sky, table, total
from .region import Region, select_region, selection_of_all, selection_of_region

PLACED = f"WITH {CUSTOMER}, {pixel_sql(4, 'c')}"


def placed(spark, sf_dir, order: int = 4) -> DataFrame:
    """Customers as a catalog: ids, positions, pixels."""
    own = customer_sky(spark, sf_dir).select(F.col("c_custkey").alias("_source_id"), "ra", "dec", F.col("c_acctbal").cast("double").alias("bal"))
    return healpix.with_pixel(own, "ra", "dec", order, f"_healpix_order{order}")


def stored(spark, sf_dir, order: int = 4) -> Lake:
    lake = Lake(spark, files.scratch(spark))
    raw = customer_sky(spark, sf_dir).select(F.col("c_custkey").cast("int").alias("objid"), "ra", "dec", F.col("c_acctbal").cast("float").alias("bal"))
    lake.ingest(raw, "cust", ra="ra", dec="dec", link="column:objid", order=order)
    return lake


def listed(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- sources


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def read_delimited_sniffed(spark, sf_dir):
    path = f"{files.scratch(spark)}/nation.csv"
    table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias(" n_nationkey "), "n_name", "n_regionkey").coalesce(1).write.options(sep=";", header=True).csv(path)
    return readers.read_table(spark, path, kind="csv").select(F.col("n_nationkey").cast("long"), "n_name", F.col("n_regionkey").cast("long"))


@query("SELECT c_custkey, round(CAST(c_acctbal AS DOUBLE), 2) AS bal, c_name FROM customer")
def read_fits_extract(spark, sf_dir):
    path = f"{files.scratch(spark)}/c.fits"
    writers.write_extract(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long"), F.col("c_acctbal").cast("double").alias("bal"), "c_name"), path, "fits")
    return readers.read_table(spark, path).select("c_custkey", rounded("bal", 2).alias("bal"), "c_name")


@query("SELECT c_custkey, c_name FROM customer")
def read_votable_extract(spark, sf_dir):
    path = f"{files.scratch(spark)}/c.vot"
    writers.write_extract(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long"), "c_name"), path, "votable")
    return readers.read_table(spark, path).select("c_custkey", "c_name")


def orders_in_parts(spark, sf_dir) -> str:
    folder = files.scratch(spark)
    writers.write_fits_parts(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long"), F.col("o_totalprice").cast("double").alias("price"), "o_orderstatus"), folder, ["o_orderkey"], 500)
    return folder


@query("SELECT o_orderkey, round(CAST(o_totalprice AS DOUBLE), 2) AS price, o_orderstatus FROM orders")
def fits_parts_stacked(spark, sf_dir):
    return fits.read_fits(spark, f"{orders_in_parts(spark, sf_dir)}/*.fits").select("o_orderkey", rounded("price", 2).alias("price"), "o_orderstatus")


@query("SELECT count(*) AS header_rows, count(*) AS merged_rows, CAST(sum(o_orderkey) AS BIGINT) AS keys, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS besides FROM orders")
def fits_parts_merged(spark, sf_dir):
    folder = orders_in_parts(spark, sf_dir)
    n, path = fits.row_count(spark, f"{folder}/*.fits"), f"{folder}/whole/all.fits"
    merged = writers.merge_fits_parts(spark, folder, path)
    off = writers.fits_differences(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long"), F.col("o_totalprice").cast("double").alias("price"), "o_orderstatus"), path)
    out = fits.read_fits(spark, path).agg(F.sum("o_orderkey").alias("keys"))
    return out.select(*(F.lit(v).cast("long").alias(k) for k, v in (("header_rows", n), ("merged_rows", merged), *off.items())), "keys")


@query("SELECT o_orderkey AS id, CAST(o_custkey AS DOUBLE) AS v FROM orders")
def packed_vectors(spark, sf_dir):
    own = table(spark, sf_dir, "orders").groupBy(F.expr("o_orderkey % 7")).agg(F.collect_list(F.struct("o_orderkey", "o_custkey")).alias("x"))
    return fits.unpacked(own.select(F.transform("x", lambda r: r["o_orderkey"]).alias("id"), F.transform("x", lambda r: r["o_custkey"].cast("double")).alias("v")))


@query(f"WITH {CUSTOMER} SELECT ra, dec FROM c")
def sky_only_scan(spark, sf_dir):
    return readers.sky_columns(customer_sky(spark, sf_dir).withColumnsRenamed({"ra": "RA", "dec": "Dec"}), "ra", "DEC")


@query("SELECT CAST(o_custkey AS BIGINT) AS _source_id, o_orderkey FROM orders")
def target_list(spark, sf_dir):
    """Repeats are kept."""
    own = table(spark, sf_dir, "orders").select(F.concat(F.lit(" \t"), F.col("o_custkey").cast("string"), F.lit("\n")).alias("target"), "o_orderkey")
    return readers.read_targets(own, "TARGET").select("_source_id", "o_orderkey")


@query("SELECT DISTINCT CAST(o_custkey AS BIGINT) AS _source_id FROM orders")
def ids_of_a_file(spark, sf_dir):
    path = f"{files.scratch(spark)}/ids.txt"
    table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("value")).write.text(path)
    return readers.read_ids(spark, path)


@query("SELECT l_orderkey, l_suppkey, l_linenumber FROM lineitem WHERE l_suppkey = 7 AND l_linenumber = 1")
def lookup_sidecar(spark, sf_dir):
    path = f"{files.scratch(spark)}/lines.parquet"
    table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber").write.parquet(path)
    return readers.lookup_table(spark, path, l_suppkey="7", L_LINENUMBER=1, l_orderkey=None)


# --- the lake


@query(f"{PLACED} SELECT c_custkey AS _source_id, round(CAST(CAST(c_acctbal AS REAL) AS DOUBLE), 2) AS bal, pix, CAST(-1 AS BIGINT) AS _spectrum_index FROM placed")
def catalog_view(spark, sf_dir):
    stored(spark, sf_dir).register("cust", "stored_customers")
    return spark.sql("SELECT _source_id, round(bal, 2) AS bal, _healpix_order4 AS pix, _spectrum_index FROM stored_customers")


@query(f"{PLACED} SELECT pix AS npix, count(*) AS n FROM placed GROUP BY pix")
def catalog_tiles(spark, sf_dir):
    """Tile enumeration, and each tile read for itself by its partition."""
    lake = stored(spark, sf_dir)
    return lake.tiles("cust").join(lake.catalog("cust"), "Npix").groupBy(F.col("Npix").cast("long").alias("npix")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{PLACED}, s AS (SELECT count(*) AS n FROM supplier) SELECT count(*) AS total_rows, count(DISTINCT pix) AS total_tiles, 4 AS healpix_order, true AS finalized, (SELECT n FROM s) AS suppliers FROM placed")
def catalog_descriptor(spark, sf_dir):
    """The descriptors that finalize writes, of two surveys of one lake."""
    lake = stored(spark, sf_dir)
    lake.ingest(supplier_sky(spark, sf_dir).select("s_suppkey", "ra", "dec"), "supp", ra="ra", dec="dec", link="column:s_suppkey", order=3)
    own, other = lake.info("cust"), lake.info("supp")
    return listed(spark, [(own["total_rows"], own["total_tiles"], own["healpix_order"], own["finalized"], other["total_rows"])], "total_rows long, total_tiles long, healpix_order int, finalized boolean, suppliers long")


@query(f"{PLACED}, hit AS (SELECT DISTINCT pix FROM placed WHERE c_custkey % 10 = 3) SELECT c_custkey AS _source_id, pix, CASE WHEN pix IN (SELECT pix FROM hit) THEN 2 ELSE 1 END AS v FROM placed WHERE pix NOT IN (SELECT pix FROM hit) OR c_custkey % 10 = 3")
def tile_overwrite(spark, sf_dir):
    """Incoming tiles replace stored ones; all others stay."""
    lake, own = Lake(spark, files.scratch(spark)), placed(spark, sf_dir)
    lake.write_tiles(own.withColumn("v", F.lit(1)), "x", order=4)
    lake.write_tiles(own.where("_source_id % 10 = 3").withColumn("v", F.lit(2)), "x", order=4, mode="overwrite")
    return lake.catalog("x", order=4).select("_source_id", F.col("_healpix_order4").alias("pix"), "v")


@query("SELECT c_custkey AS _source_id, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END AS skip, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 <> 0 THEN 2 ELSE 1 END AS last FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0")
def tile_append_merge(spark, sf_dir):
    """Appending rows of which some ids are stored: skip keeps the old row, last the new one."""
    own, out = placed(spark, sf_dir), None
    for policy in ("skip", "last"):
        lake = Lake(spark, files.scratch(spark))
        lake.write_tiles(own.where("_source_id % 3 = 0").withColumn(policy, F.lit(1)), "x", order=4)
        lake.write_tiles(own.where("_source_id % 2 = 0").withColumn(policy, F.lit(2)), "x", order=4, mode="append", on_duplicate=policy)
        got = lake.catalog("x", order=4).select("_source_id", policy)
        out = got if out is None else out.join(got, "_source_id")
    return out


@query("SELECT o_custkey AS _source_id, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1")
def ingest_dedup_order(spark, sf_dir):
    """Of rows of one id the first or last in the order of files and rows stays."""
    folder, out = files.scratch(spark), None
    own = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lit(10.0).alias("ra"), F.lit(5.0).alias("dec"))
    own.repartitionByRange(5, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(f"{folder}/in")
    for policy, name in (("skip", "first"), ("last", "last")):
        lake = Lake(spark, files.scratch(spark))
        lake.ingest(spark.read.parquet(f"{folder}/in"), "x", ra="ra", dec="dec", link="column:o_custkey", order=1, on_duplicate=policy)
        got = lake.catalog("x").select("_source_id", F.col("o_orderkey").alias(name))
        out = got if out is None else out.join(got, "_source_id")
    return out


@query(f"{PLACED} SELECT c_custkey AS _source_id, pix FROM placed")
def live_append(spark, sf_dir):
    """A stream of files into a catalog, twice: the second run adds nothing."""
    folder = files.scratch(spark)
    lake = Lake(spark, f"{folder}/lake")
    own = placed(spark, sf_dir)
    own.where("_source_id % 2 = 0").write.parquet(f"{folder}/a")
    own.write.parquet(f"{folder}/b")
    for part, point in (("a", "1"), ("b", "2"), ("b", "3")):
        stream = spark.readStream.schema(own.schema).parquet(f"{folder}/{part}")
        live.append_live(stream, lake, "x", 4, f"{folder}/checkpoint{point}").awaitTermination()
    live.finish(lake, "x", 4)
    return lake.catalog("x").select("_source_id", F.col("_healpix_order4").alias("pix"))


@query(f"{PLACED} SELECT pix AS npix, count(*) AS n FROM placed WHERE pix NOT IN (SELECT pix FROM placed WHERE c_custkey < 100) GROUP BY 1")
def gap_fill(spark, sf_dir):
    own = placed(spark, sf_dir).withColumnRenamed("_healpix_order4", "npix")
    return live.fill_gaps(own, own.where("_source_id < 100"), lambda df: df.groupBy("npix").agg(F.count(F.lit(1)).alias("n")))


@query(f"WITH {CUSTOMER}, {SUPPLIER} SELECT c_custkey AS source_id_a, s_suppkey AS source_id_b FROM c, s WHERE {sep_sql('c', 's')} <= 5")
def association_store(spark, sf_dir):
    lake = Lake(spark, files.scratch(spark))
    sky = crossmatch.Sky("c_custkey", pixel="pix")
    a = healpix.with_pixel(customer_sky(spark, sf_dir), "ra", "dec", 3, "pix")
    lake.write_association(crossmatch.match_all(a, supplier_sky(spark, sf_dir), 5.0, sky, crossmatch.Sky("s_suppkey")), "a_x_b__r18000.0", 3)
    return lake.association("a_x_b__r18000.0", 3).select("source_id_a", "source_id_b")


@query(f"WITH {CUSTOMER} SELECT c_custkey AS _source_id FROM c WHERE ra BETWEEN 30 AND 160 AND dec BETWEEN -50 AND 50")
def area_product(spark, sf_dir):
    """A whole area: discovery, crossmatch within the region, gather."""
    sky = crossmatch.Sky("_source_id", "ra", "dec", "_healpix_order4")
    own = placed(spark, sf_dir)
    area = Area.load(json.dumps({"name": "A", "region": {"bbox": [30, 160, -50, 50]}, "discover": {"exact": True}, "crossmatch_plan": {"base": "c", "partners": ["d:1.0"]}, "gather": {"columns": {"d": ["bal"]}}}))
    out = run_area(area, {"c": Layer(own, sky, 4), "d": Layer(own, sky, 4)})
    return out["product"].where("d_bal <=> bal").select("_source_id")


# --- sinks


@query("SELECT o_orderkey, round(CAST(o_totalprice AS DOUBLE), 2) AS price FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def extract_csv(spark, sf_dir):
    path = f"{files.scratch(spark)}/x.csv"
    wanted = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select("l_orderkey").distinct()
    writers.write_extract(lookup.by_ids(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price")), wanted, "o_orderkey"), path, "csv")
    return readers.read_delimited(spark, path, ",").select(F.col("o_orderkey").cast("long"), rounded(F.col("price").cast("double"), 2).alias("price"))


@query(f"{PLACED} SELECT pix AS npix, count(*) AS n FROM placed GROUP BY 1")
def extract_tile_tree(spark, sf_dir):
    path = f"{files.scratch(spark)}/tree"
    writers.write_extract(placed(spark, sf_dir), path, "parquet", "_healpix_order4")
    return spark.read.parquet(path).groupBy(F.col("Npix").cast("long").alias("npix")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 0 AS n, 'o_orderkey,o_totalprice' AS names")
def empty_extract(spark, sf_dir):
    path = f"{files.scratch(spark)}/none"
    writers.write_extract(table(spark, sf_dir, "orders").where("false").select("o_orderkey", "o_totalprice"), path)
    own = spark.read.parquet(path)
    return own.agg(F.count(F.lit(1)).cast("int").alias("n")).withColumn("names", F.lit(",".join(own.columns)))


@query(f"WITH {CUSTOMER}, {pixel_sql(2, 'c')} SELECT DISTINCT pix AS npix FROM placed")
def coverage_map_file(spark, sf_dir):
    path = f"{files.scratch(spark)}/m.moc"
    own = counting.footprint_of_rows(customer_sky(spark, sf_dir), "ra", "dec", 2)
    writers.write_moc(spark, path, [r[0] for r in own.toLocalIterator()], 2)
    return listed(spark, [(p,) for p in healpix.moc_pixels(healpix.parse_moc(files.read_text(spark, path)), 2)], "npix long")


@query(f"""WITH {CUSTOMER} SELECT printf('circle(%.8f,%.8f,2")', ra, dec) AS line FROM c""")
def region_file_of_sources(spark, sf_dir):
    path = f"{files.scratch(spark)}/r.reg"
    writers.write_source_regions(customer_sky(spark, sf_dir), path, radius_arcsec=2.0)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("SELECT 0 AS wrong, 1 AS listed")
def tile_archive(spark, sf_dir):
    folder = files.scratch(spark)
    table(spark, sf_dir, "orders").coalesce(1).write.parquet(f"{folder}/tile")
    made = writers.pack_tile(spark, f"{folder}/tile", f"{folder}/tile.tar")["files"]
    return listed(spark, [(len(writers.verify_tile(spark, f"{folder}/tile.tar")), sum(f["name"].endswith(".parquet") for f in made))], "wrong int, listed int")


@query("SELECT n_regionkey AS survey, count(*) AS tiles, CAST(sum(n_nationkey) AS BIGINT) AS keys FROM nation GROUP BY 1")
def registry_store(spark, sf_dir):
    folder, nation = files.scratch(spark), table(spark, sf_dir, "nation")
    reg = nation.groupBy(F.col("n_regionkey").alias("survey")).agg(F.count(F.lit(1)).alias("tiles"))
    writers.write_registry(reg, {"all": nation.select("n_regionkey", "n_nationkey")}, folder)
    keys = spark.read.parquet(f"{folder}/tiles/all.parquet").groupBy(F.col("n_regionkey").alias("survey")).agg(F.sum("n_nationkey").alias("keys"))
    return spark.read.parquet(f"{folder}/surveys.parquet").join(keys, "survey").select("survey", "tiles", "keys")


@query("SELECT c_custkey, c_name, o_orderkey AS _source_id FROM customer JOIN orders ON o_custkey = c_custkey")
def target_sidecar(spark, sf_dir):
    path = f"{files.scratch(spark)}/bridge.parquet"
    pairs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("partner_id"), F.col("o_orderkey").alias("extract_id"))
    writers.write_bridge(gather.bridge(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", pairs), path)
    return spark.read.parquet(path)


# --- filters, selections and lookups


@query("WITH m AS (SELECT l_orderkey AS id, min(l_partkey % 48) AS p FROM lineitem GROUP BY 1), k AS (SELECT l_orderkey AS id, min(l_suppkey) AS p FROM lineitem GROUP BY 1) SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 AND m.id IS NOT NULL THEN m.p ELSE coalesce(k.p, -1) END AS npix FROM orders LEFT JOIN m ON m.id = o_orderkey LEFT JOIN k ON k.id = o_orderkey")
def tile_locate_with_scan(spark, sf_dir):
    """Ids that the catalog doesn't place are looked for in the tiles themselves."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    linked = lines.join(orders.where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey"), F.expr("l_partkey % 48").alias("npix"), F.lit(0).alias("idx"))
    tiles = lines.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("npix"), F.lit(1).alias("idx"))
    return lookup.tile_of_with_scan(linked, orders.select("o_orderkey"), tiles, index="idx", pixels=["npix"], id_col="o_orderkey").select("o_orderkey", "npix")


@query(f"{PLACED} SELECT c_custkey FROM placed WHERE pix BETWEEN 48 AND 63 OR pix BETWEEN 80 AND 127 OR pix = 100 OR pix BETWEEN 1600 AND 1603")
def coverage_map_search(spark, sf_dir):
    """Tiles of a coverage map given at several orders."""
    tiled = healpix.with_pixel(customer_sky(spark, sf_dir), "ra", "dec", 4, "pix")
    return select_region(tiled, Region.of_moc("2/3 5-7 3/400 4/100"), "pix", 4).select("c_custkey")


@query(f"{PLACED} SELECT c_custkey FROM placed WHERE pix IN (5, 100, 101, 102, 103, 104, 2000)")
def pixel_list_search(spark, sf_dir):
    tiled = healpix.with_pixel(customer_sky(spark, sf_dir), "ra", "dec", 4, "pix")
    return select_region(tiled, Region.of_pixels("5,100-104,2000", 4), "pix", 4).select("c_custkey")


@query(f"{PLACED} SELECT DISTINCT pix AS npix, pix BETWEEN 100 AND 900 AS inside FROM placed")
def selections_of_tiles(spark, sf_dir):
    own = placed(spark, sf_dir)
    inside = selection_of_region(own, "c", Region.of_pixels("100-900", 4), "_healpix_order4", 4).tiles.withColumn("inside", F.lit(True))
    return selection_of_all(own, "c", "_healpix_order4", 4).tiles.join(inside, "npix", "left").select("npix", F.coalesce("inside", F.lit(False)).alias("inside"))


@query("SELECT n_name, CASE WHEN n_nationkey % 3 = 0 THEN 'product' ELSE 'ingested' END AS kind FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 3 <> 0")
def registry_filter(spark, sf_dir):
    reg = table(spark, sf_dir, "nation").select("n_name", F.expr("CASE WHEN n_nationkey % 3 = 0 THEN 'product' WHEN n_nationkey % 3 = 1 THEN 'ingested' END").alias("kind"), F.expr("CASE WHEN n_nationkey % 2 = 0 THEN 'catalog' ELSE 'spectra' END").alias("modality"))
    return counting.by_kind(reg, "ingested", "catalog").select("n_name", "kind")


@query("SELECT n_name AS survey, 'a' AS origin FROM nation WHERE n_nationkey < 15 UNION ALL SELECT n_name, 'b' FROM nation WHERE n_nationkey >= 15")
def shadowed_surveys(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_name").alias("survey"), "n_nationkey")
    first, second = nation.where("n_nationkey < 15").select("survey", F.lit("a").alias("origin")), nation.where("n_nationkey > 7").select("survey", F.lit("b").alias("origin"))
    return counting.without_shadowed(first, second)


@query("SELECT n_name AS survey, CAST(row_number() OVER (ORDER BY CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_nationkey * 10 END NULLS LAST, n_name) - 1 AS INTEGER) AS step FROM nation")
def partner_order_of_registry(spark, sf_dir):
    reg = table(spark, sf_dir, "nation").select(F.col("n_name").alias("survey"), F.expr("CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_nationkey * 10 END").alias("total_rows"))
    return listed(spark, [(r["survey"], i) for i, r in enumerate(counting.partner_order(reg).toLocalIterator())], "survey string, step int")


@query("WITH t AS (SELECT DISTINCT o_custkey % 192 AS npix FROM orders) SELECT npix FROM t ORDER BY npix >> 4, npix LIMIT 60")
def tiles_in_nested_order(spark, sf_dir):
    tiles = table(spark, sf_dir, "orders").select(F.expr("o_custkey % 192").alias("npix")).distinct()
    return dedup.in_tile_order(tiles, "npix").limit(60)


@query("SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def refused_duplicates(spark, sf_dir):
    """What a batch of arrays that repeats ids is refused for."""
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    try:
        dedup.appended_arrays(own.limit(0), own, "id", "skip")
    except dedup.DuplicateIds:
        return dedup.repeated(own, "id")
    return own.limit(0).withColumn("n", F.lit(0).cast("long"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, -label FROM embeddings WHERE vec_id % 3 = 0")
def array_append(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    return dedup.appended_arrays(own.where("vec_id % 3 <> 0"), own.select("vec_id", F.when(F.expr("vec_id % 3 = 0"), -F.col("label")).otherwise(F.lit(-99)).alias("label")), "vec_id", "skip")


@query("SELECT count(*) AS rows, count(DISTINCT o_custkey % 192) AS tiles FROM orders")
def tree_statistics(spark, sf_dir):
    return counting.tree_stats(table(spark, sf_dir, "orders").withColumn("npix", F.expr("o_custkey % 192")), "npix")


@query("SELECT o_orderkey, CASE WHEN n < 1000 THEN '~' || n WHEN n < 9950 THEN printf('~%.1fk', n / 1000) WHEN n < 1000000 THEN printf('~%.0fk', CASE WHEN n < 100000 THEN round(n / 1000) ELSE round(n / 10000) * 10 END) ELSE printf('~%.1fM', n / 1000000) END AS shown FROM (SELECT o_orderkey, CAST(100 * (1 + (o_orderkey * 7919) % 8000) AS BIGINT) AS n FROM orders)")
def humanized_counts(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("100 * (1 + (o_orderkey * 7919) % 8000)").alias("n"))
    return own.select("o_orderkey", counting.humanized("n").alias("shown"))


@query("SELECT CASE n_nationkey % 3 WHEN 0 THEN 'skeleton' WHEN 1 THEN 'ready' ELSE 'missing' END AS status, count(*) AS surveys FROM nation GROUP BY 1")
def recipe_coverage(spark, sf_dir):
    return counting.coverage_report(table(spark, sf_dir, "nation").select(F.expr("CASE n_nationkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 4 END").alias("rules")))


@query("WITH e AS (SELECT vec_id - CASE WHEN vec_id % 13 = 1 THEN 1 ELSE 0 END AS id, CASE WHEN vec_id % 11 = 0 THEN NULL ELSE embedding END AS flux, CASE WHEN vec_id % 7 = 0 THEN embedding[1:3] ELSE embedding END AS ivar FROM embeddings) SELECT id, 'flux is null' AS problem FROM e WHERE flux IS NULL UNION ALL SELECT id, 'ivar has another length' FROM e WHERE len(ivar) <> 64 UNION ALL SELECT id, 'repeated id (warning)' FROM e GROUP BY id HAVING count(*) > 1")
def array_validation(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id - IF(vec_id % 13 = 1, 1, 0)").alias("_source_id"), F.expr("CASE WHEN vec_id % 11 = 0 THEN NULL ELSE embedding END").alias("flux"), F.expr("CASE WHEN vec_id % 7 = 0 THEN slice(embedding, 1, 3) ELSE embedding END").alias("ivar")
    )
    return quality.array_problems(own, ["flux", "ivar"], 64)


@query("SELECT unnest(['catalog_info has no dec_column', 'catalog_info has no total_rows', 'no column _healpix_order4', 'no column dec']) AS problem")
def catalog_validation(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_source_id"), F.lit(1.0).alias("ra"))
    return listed(spark, [(p,) for p in quality.catalog_problems(own, {"healpix_order": 4, "ra_column": "ra"})], "problem string")


@query(f"WITH {CUSTOMER}, b AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 95 ELSE dec END AS dec, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE ra END AS ra FROM c) SELECT c_custkey FROM b WHERE NOT coalesce(ra IS NOT NULL AND dec BETWEEN -90 AND 90, false)")
def invalid_positions(spark, sf_dir):
    own = customer_sky(spark, sf_dir).withColumns({"dec": F.expr("CASE WHEN c_custkey % 5 = 0 THEN 95D ELSE dec END"), "ra": F.expr("CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE ra END")})
    return quality.invalid_positions(own, "ra", "dec", "c_custkey").select("c_custkey")


# --- geometry and ids


UNIT = "acos(greatest(-1.0, least(1.0, cos(radians(c.dec)) * cos(radians(c.ra)) * cos(radians(s.dec)) * cos(radians(s.ra)) + cos(radians(c.dec)) * sin(radians(c.ra)) * cos(radians(s.dec)) * sin(radians(s.ra)) + sin(radians(c.dec)) * sin(radians(s.dec)))))"


@query(f"WITH {CUSTOMER}, {SUPPLIER} SELECT c_custkey, round(degrees({UNIT}), 5) AS by_dot, round(degrees({UNIT}) * 3600, 1) AS arcsec FROM c JOIN s ON s_suppkey = c_custkey")
def separation_of_unit_vectors(spark, sf_dir):
    met = customer_sky(spark, sf_dir).alias("c").join(supplier_sky(spark, sf_dir).alias("s"), F.col("s_suppkey") == F.col("c_custkey"))
    sep = sphere.separation_dot("c.ra", "c.dec", "s.ra", "s.dec")
    return met.select("c_custkey", rounded(sep, 5).alias("by_dot"), rounded(sphere.arcsec(sep), 1).alias("arcsec"))


@query("SELECT o_orderkey, round((CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END) * (o_orderkey % 90 + (o_custkey % 60) / 60 + 30 / 3600), 8) AS deg FROM orders")
def sexagesimal_angles(spark, sf_dir):
    text = F.format_string("%s%d:%d 30.0", F.expr("IF(o_orderkey % 2 = 0, '-', '+')"), F.expr("o_orderkey % 90"), F.expr("o_custkey % 60"))
    return table(spark, sf_dir, "orders").select("o_orderkey", rounded(sphere.sexagesimal(text), 8).alias("deg"))


@query(f"{PLACED} SELECT c_custkey, pix, round({sep_sql('a', 'b')}, 5) AS sep, pix >> 2 AS parent FROM (SELECT c_custkey, pix, {{'ra': ra, 'dec': dec}} AS a, {{'ra': CAST(100 AS DOUBLE), 'dec': CAST(20 AS DOUBLE)}} AS b FROM placed)")
def functions_for_sql(spark, sf_dir):
    """The registered functions, used from SQL text."""
    sql_functions.register(spark)
    customer_sky(spark, sf_dir).createOrReplaceTempView("sky_customers")
    return spark.sql("SELECT c_custkey, ang2pix(ra, dec, 4) AS pix, round(separation_deg(ra, dec, 100D, 20D), 5) AS sep, pixel_parent(ang2pix(ra, dec, 4), 1) AS parent FROM sky_customers WHERE valid_sky(ra, dec)")


@query(f"WITH {CUSTOMER}, {SUPPLIER}, {pixel_sql(3, 'c')}, a AS (SELECT *, pix AS p FROM placed) SELECT DISTINCT a.p AS npix FROM a JOIN s ON {sep_sql('a', 's')} <= 5")
def tiles_with_partners(spark, sf_dir):
    """Tiles of the rows that have a partner, from the association alone."""
    a = healpix.with_pixel(customer_sky(spark, sf_dir), "ra", "dec", 3, "pix")
    found = crossmatch.match_all(a, supplier_sky(spark, sf_dir), 5.0, crossmatch.Sky("c_custkey", pixel="pix"), crossmatch.Sky("s_suppkey"))
    return found.select(F.col("healpix_npix_a").alias("npix")).distinct()


@query("SELECT unnest([{'name': '_source_id', 'role': 'id'}, {'name': 'RA', 'role': 'sky'}, {'name': 'MAG_G', 'role': 'photometry'}, {'name': 'Z_PHOT', 'role': 'redshift'}, {'name': 'CLASS_STAR', 'role': 'classification'}, {'name': '_spectrum_index', 'role': 'index'}, {'name': 'chi2', 'role': 'science'}], recursive := true)")
def column_roles(spark, sf_dir):
    own = listed(spark, [], "_source_id long, RA double, MAG_G float, Z_PHOT double, CLASS_STAR float, _spectrum_index long, chi2 double")
    return listed(spark, [(c["name"], c["role"]) for c in manifest(own)["columns"] if role_of(c["name"]) == c["role"]], "name string, role string")


@query("SELECT unnest([{'item': 'gather 360 tiles, hours', 'v': '1.0'}, {'item': 'advice', 'v': 'append'}, {'item': 'partner B', 'v': 'TARGETID = TARGETID'}, {'item': 'partner C', 'v': '1.0 arcsec'}, {'item': 'tree', 'v': 'A_x_B__r0.25'}, {'item': 'alias', 'v': 's_2mass_psc'}], recursive := true)")
def planning(spark, sf_dir):
    shown = lambda p: f"{p.columns[0]} = {p.columns[1]}" if p.columns else f"{p.radius_arcsec} arcsec"
    plan = {p.name: shown(p) for p, _ in suggest_plan("A", {"A": ["TARGETID"], "B": ["TARGETID", "x"], "C": ["ra"]}, {"B": 5, "C": None})}
    rows = [("gather 360 tiles, hours", str(cost("gather", 360)["hours"])), ("advice", ingest_advice(100, 5)["mode"]), *((f"partner {k}", v) for k, v in plan.items())]
    return listed(spark, [*rows, ("tree", crossmatch.tree_name("A", "B", 0.25)), ("alias", master.alias_of("2MASS PSC"))], "item string, v string")


@query("SELECT o_orderkey, nullif(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), '') IS NULL AS blank, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey END AS id FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN chr(9) || ' ' ELSE 'x' END AS t FROM orders)")
def trimmed_ids(spark, sf_dir):
    """White space of any kind around a number changes nothing; alone it is no id."""
    own = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("CASE o_orderkey % 4 WHEN 0 THEN '\\t ' WHEN 1 THEN concat('\\t', o_orderkey, '\\n') WHEN 2 THEN concat(' +', o_orderkey) ELSE CAST(o_orderkey AS STRING) END").alias("t"))
    made = ids.normalize("t")
    return own.select("o_orderkey", made.isNull().alias("blank"), made.alias("id"))


# --- homogenization and arrays


ERRORS = "p AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_quantity AS DOUBLE) AS f, CAST(l_tax AS DOUBLE) + 0.5 AS e FROM lineitem)"


def measured(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey * 10 + l_linenumber").alias("id"), F.col("l_quantity").cast("double").alias("f"), (F.col("l_tax").cast("double") + 0.5).alias("e"))


def recipe_of(*rules: dict) -> homogenize.Recipe:
    return homogenize.Recipe.load(json.dumps({"survey": "S", "rules": list(rules)}))


@query(f"WITH {ERRORS} SELECT id, round(1 / f, 6) AS i, round(e, 6) AS i_err, round(f * -2, 6) AS s, round(e * -2, 6) AS s_err, round(1 / (f * -2), 6) AS c, round(e * -2, 6) AS c_err FROM p")
def homogenize_inverse_error(spark, sf_dir):
    """Uncertainties by default: an inverse leaves them, a scale keeps its sign, alone and in a chain."""
    own = recipe_of(
        {"source": "f", "target": "i", "error": "e", "steps": {"type": "inverse"}}, {"source": "f", "target": "s", "error": "e", "steps": {"type": "scale", "factor": -2}},
        {"source": "f", "target": "c", "error": "e", "steps": [{"type": "scale", "factor": -2}, {"type": "inverse"}]},
    )
    out = homogenize.homogenize_product(measured(spark, sf_dir), [own])
    return out.select("id", *(rounded(c, 6).alias(c) for c in ("i", "i_err", "s", "s_err", "c", "c_err")))


@query(f"WITH {ERRORS} SELECT id, round(CASE WHEN f > 0 THEN -2.5 * log10(f * 2) + 22.5 END, 6) AS m, round(f + 0.25, 6) AS o, round(1 / f, 6) AS i FROM p")
def homogenize_view_text(spark, sf_dir):
    """Targets as the text of a SQL view over a view: nothing is copied."""
    measured(spark, sf_dir).createOrReplaceTempView("measured_lines")
    own = recipe_of(
        {"source": "f", "target": "m", "steps": [{"type": "scale", "factor": 2}, {"type": "flux_to_ab", "zero_point": 22.5}]},
        {"source": "f", "target": "o", "steps": {"type": "mag_offset", "delta": 0.25}}, {"source": "f", "target": "i", "steps": [{"type": "null_if_sentinel", "values": [-1]}, {"type": "inverse"}]},
    )
    out = spark.sql(homogenize.view_sql("measured_lines", homogenize.view_expressions(own.rules)))
    return out.select("id", *(rounded(c, 6).alias(c) for c in ("m", "o", "i")))


@query(f"WITH {ERRORS} SELECT id, round(1.0857362047461345 * (e * 3) / (f * 2 * 3) + 0.1, 6) AS m_err, round(1 / e, 6) AS i_err FROM p")
def homogenize_explicit_error(spark, sf_dir):
    own = recipe_of(
        {"source": "f", "target": "m", "error": "e", "steps": [{"type": "scale", "factor": 2}, {"type": "flux_to_ab", "zero_point": 22.5}], "error_steps": [{"type": "scale", "factor": 3}, {"type": "flux_to_ab", "zero_point": 0}, {"type": "mag_offset", "delta": 0.1}]},
        {"source": "f", "target": "i", "error": "e", "steps": [{"type": "inverse"}], "error_steps": [{"type": "inverse"}]},
    )
    out = homogenize.homogenize_product(measured(spark, sf_dir), [own])
    return out.select("id", rounded("m_err", 6).alias("m_err"), rounded("i_err", 6).alias("i_err"))


@query(f"WITH {CUSTOMER} SELECT c_custkey AS _source_id, ra, dec, round(CAST(c_acctbal AS DOUBLE), 4) AS native, round(CAST(c_acctbal AS DOUBLE) * 0.5, 4) AS half FROM c")
def homogenize_catalog_columns(spark, sf_dir):
    """Id, position, passed columns as doubles, targets; a rule whose source is missing is left out."""
    own = customer_sky(spark, sf_dir).select(F.col("c_custkey").alias("_source_id"), "ra", "dec", F.col("c_acctbal").alias("native"))
    recipe = recipe_of({"source": "native", "target": "half", "steps": [{"type": "scale", "factor": 0.5}]}, {"source": "absent", "target": "x", "steps": [{"type": "identity"}]})
    out = homogenize.homogenize_catalog(own, recipe, passthrough=["native"])
    return out.select("_source_id", "ra", "dec", rounded("native", 4).alias("native"), rounded("half", 4).alias("half"))


@query("SELECT p_partkey AS id, band, lambda_eff, mag FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS phot_ab_w1, CAST(p_retailprice AS DOUBLE) AS phot_ab_g FROM part) UNPIVOT (mag FOR name IN (phot_ab_w1, phot_ab_g)) JOIN (VALUES ('phot_ab_w1', 'w1', 33680.0::DOUBLE), ('phot_ab_g', 'g', 4810.0::DOUBLE)) AS b(name, band, lambda_eff) USING (name)")
def sed_by_bandpass_registry(spark, sf_dir):
    """Points of spectral energy distributions; wavelengths come from a registry file, and a band without any has none."""
    path = f"{files.scratch(spark)}/bandpass.json"
    files.write_text(spark, path, json.dumps({"bands": {"phot_ab_w1": {"lambda_eff_um": 3.368, "fwhm_um": 0.66}, "phot_ab_g": {"lambda_eff_um": 0.481}}}))
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("phot_ab_w1"), F.col("p_retailprice").cast("double").alias("phot_ab_g"), F.lit(1.0).alias("phot_ab_unknown"))
    return homogenize.sed_points(own, Bandpasses.load(spark, path).frame("phot_ab_"), "id").select("id", "band", rounded("lambda_eff", 6).alias("lambda_eff"), "mag")


@query(f"WITH {SPECTRA}, v AS (SELECT vec_id, list_transform(flux, lambda x: CASE WHEN x > 0 THEN CAST(1 / x AS REAL) ELSE CAST(0 AS REAL) END) AS i FROM s) SELECT vec_id, CAST(80 AS INTEGER) AS n, round(list_sum(list_transform(i, lambda x: CAST(x AS DOUBLE))), 4) AS ivar_sum, CAST(16 AS INTEGER) AS filled FROM v")
def spectra_widened(spark, sf_dir):
    """Inverse variances of variances, in arrays of one width."""
    own = spectrum_rows(spark, sf_dir).select("vec_id", spectra.ivar_of_variance("flux").alias("ivar"), F.transform("flux", lambda x: F.lit(0)).alias("mask"))
    out = arrays.widened(own, 80)
    return out.select("vec_id", F.size("ivar").alias("n"), total("ivar", 4).alias("ivar_sum"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("filled"))


@query("WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS f FROM embeddings) SELECT vec_id, list_transform(range(0, 5), lambda k: round(0.5 * f[k + 1] + 0.5 * f[k + 2], 6)) AS mid, CAST(2 AS INTEGER) AS outside FROM e")
def spectra_resampled(spark, sf_dir):
    """Flux halfway between pixels; beyond the ends nothing."""
    own = spectrum_rows(spark, sf_dir).select("vec_id", "flux", "ivar", F.transform("flux", lambda x: F.lit(0)).alias("mask"), F.transform("flux", lambda x, i: i.cast("double")).alias("w"))
    out = spectra.resample(own, "w", "flux", "ivar", "mask", [-1.0, 0.5, 1.5, 2.5, 3.5, 4.5, 1e6])
    return out.select("vec_id", F.transform(F.slice("flux", 2, 5), lambda x: rounded(x, 6)).alias("mid"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("outside"))


@query("WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS f FROM embeddings) SELECT vec_id, list_transform([0, 0, 0, 0, f[1], f[2], 0, f[9], f[10]], lambda x: round(CAST(x AS DOUBLE), 6)) AS cut FROM e")
def cutout_stamp(spark, sf_dir):
    """A stamp at the corner of an 8 x 8 image; what lies outside is filled."""
    own = spectrum_rows(spark, sf_dir).select("vec_id", "flux", F.lit(0).alias("x"), F.lit(0).alias("y"))
    return spectra.stamp(own, "flux", (8, 8), "x", "y", 3, "cut", fill=0.0).select("vec_id", F.transform("cut", lambda v: rounded(v, 6)).alias("cut"))


@query("SELECT o_orderkey, CAST(CAST(o_custkey % 100 AS REAL) / 8 AS DOUBLE) AS z, o_orderstatus AS instr, concat('f', o_orderkey, '.fits') AS source_file FROM orders")
def packed_meta(spark, sf_dir):
    """Packed records written and read back."""
    raw = arrays.packed_record({"z": F.expr("CAST(o_custkey % 100 AS FLOAT) / 8"), "instr": "o_orderstatus", "source_file": F.expr("concat('f', o_orderkey, '.fits')")})
    own = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")).withColumn("m", arrays.unpacked_record("raw"))
    return own.select("o_orderkey", F.col("m.z").cast("double").alias("z"), "m.instr", "m.source_file")


@query(f"WITH {CUSTOMER}, w AS (SELECT *, radians(dec) AS d, radians(0.01 * 5) AS eta FROM c) SELECT c_custkey, round(degrees(atan2(sin(d) + eta * cos(d), abs(cos(d) - eta * sin(d)))), 6) AS up FROM w")
def pixel_positions(spark, sf_dir):
    """The sky position of a pixel five above the centre of a cutout, by its packed coordinates."""
    wcs = {"crval1": F.col("ra"), "crval2": F.col("dec"), "crpix1": F.lit(8.0), "crpix2": F.lit(8.0), "cd1_1": F.lit(-0.01), "cd2_2": F.lit(0.01), "naxis1": F.lit(16), "naxis2": F.lit(16)}
    own = customer_sky(spark, sf_dir).withColumn("w", arrays.unpacked_record(arrays.packed_record(wcs, arrays.WCS), arrays.WCS))
    return own.select("c_custkey", rounded(arrays.pixel_to_sky("w", 8.0, 13.0)["dec"], 6).alias("up"))


@query("SELECT count(*) AS rows, CAST(sum(CASE WHEN length(c_name) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS named, 'c_custkey:bigint,size:bigint,price:double,tags:array<bigint>' AS types FROM customer")
def canonical_types(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long"), F.length("c_name").cast("smallint").alias("size"), F.col("c_acctbal").cast("float").alias("price"), F.array(F.lit(1).cast("int")).alias("tags"))
    out = readers.canonical(own)
    types = ",".join(f"{n}:{k}" for n, k in out.dtypes)
    return out.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("size") > 0).alias("named")).withColumn("types", F.lit(types))


@query("SELECT c_custkey, c_name, 'ok' AS state FROM customer")
def kept_columns(spark, sf_dir):
    """Asked and required columns by any case; exactly one source of ids."""
    own = table(spark, sf_dir, "customer")
    predicates.one_source_of_ids(own, None)
    return predicates.keep_columns(own, ["C_NAME"], ["c_CustKey"]).withColumn("state", F.lit("ok"))


@query("SELECT o_orderkey AS want_id, c_name AS cust_c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def master_query_by_sql(spark, sf_dir):
    """The master query as SQL text over views."""
    table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").createOrReplaceTempView("master_orders")
    table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("want_id")).createOrReplaceTempView("wanted_orders")
    table(spark, sf_dir, "customer").createOrReplaceTempView("cust_view")
    plan = master.build_select("master_orders", "wanted_orders", "Orders", {"Orders": "o_orderkey", "Cust": "o_custkey"}, {"Cust": ("cust_view", "c_custkey")}, {"Cust": ["c_name"]})
    spark.sql(master.master_view("master_names", plan))
    return spark.table("master_names")



# --- builds, counts and regions in parts


def two_skies(spark, sf_dir):
    a = healpix.with_pixel(customer_sky(spark, sf_dir), "ra", "dec", 2, "pa")
    b = healpix.with_pixel(supplier_sky(spark, sf_dir), "ra", "dec", 3, "pb")
    return a, b, crossmatch.Sky("c_custkey", pixel="pa"), crossmatch.Sky("s_suppkey", pixel="pb")


MATCHED = f"WITH {CUSTOMER}, {SUPPLIER}, {pixel_sql(2, 'c')}, a AS (SELECT *, pix AS p FROM placed), m AS (SELECT c_custkey AS source_id_a, s_suppkey AS source_id_b, p FROM a JOIN s ON {sep_sql('a', 's')} <= 5)"


@query(f"{MATCHED} SELECT source_id_a, source_id_b, p >= 96 AS resumed FROM m")
def crossmatch_build_resumed(spark, sf_dir):
    """A build in two runs: first of some tiles, then of those that aren't built."""
    a, b, sa, sb = two_skies(spark, sf_dir)
    lake = Lake(spark, files.scratch(spark))
    lake.write_association(crossmatch.build(a, b, 5.0, sa, sb, (2, 3), restrict=spark.range(96), nearest=False), "t", 2)
    built = lake.association("t", 2)
    rest = crossmatch.build(a, b, 5.0, sa, sb, (2, 3), built=built, restrict=spark.range(96, 192), nearest=False)
    return built.select("source_id_a", "source_id_b", F.lit(False).alias("resumed")).unionByName(rest.select("source_id_a", "source_id_b", F.lit(True).alias("resumed")))


@query(f"{MATCHED} SELECT count(*) AS rows, count(DISTINCT p) AS tiles FROM m WHERE p < 150")
def crossmatch_counts(spark, sf_dir):
    a, b, sa, sb = two_skies(spark, sf_dir)
    return counting.crossmatch_count(crossmatch.match_all(a, b, 5.0, sa, sb), spark.range(150))


@query(f"{PLACED} SELECT c_custkey FROM placed WHERE ra >= 20 AND pix < 1500 ORDER BY c_custkey LIMIT 40")
def region_rows(spark, sf_dir):
    """What a region file of sources shows: valid rows of tiles by a predicate, the first by id."""
    own = healpix.with_pixel(customer_sky(spark, sf_dir), "ra", "dec", 4, "pix")
    return writers.sky_rows(own, where="ra >= 20", pixel="pix", pixels=list(range(1500)), limit=40, order=["c_custkey"]).select("c_custkey")


@query("SELECT n_nationkey AS id, n_name AS name, 'nation' AS origin FROM nation UNION ALL SELECT r_regionkey, NULL, 'region' FROM region")
def files_one_under_another(spark, sf_dir):
    folder = files.scratch(spark)
    table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")).write.parquet(f"{folder}/nation.parquet")
    table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id")).write.parquet(f"{folder}/region.parquet")
    out = readers.read_many(spark, [f"{folder}/nation.parquet", f"{folder}/region.parquet"], with_path=True)
    return out.select("id", "name", F.regexp_extract("input_path", r"(\w+)\.parquet$", 1).alias("origin"))


@query(f"{PLACED} SELECT count(*) AS rows, count(DISTINCT pix) AS tiles, '_source_id,objid,ra,dec,bal' AS names FROM placed")
def lake_statistics(spark, sf_dir):
    """Rows and tiles of a tree, and its columns by the descriptor alone."""
    lake = stored(spark, sf_dir)
    own, names = lake.stats("cust"), lake.schema("cust").names
    return listed(spark, [(own["rows"], own["tiles"], ",".join(n for n in ("_source_id", "objid", "ra", "dec", "bal") if n in names))], "rows long, tiles long, names string")


@query("SELECT vec_id, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) IS NOT NULL AS whole, CAST(len(embedding) AS INTEGER) AS n FROM embeddings")
def spectrum_store(spark, sf_dir):
    """Spectra stored with their packed records, and read by id with both."""
    folder = files.scratch(spark)
    own = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("flux"), arrays.packed_record({"z": F.col("label").cast("float")}).alias("meta"))
    writers.write_parts(own, f"{folder}/spectra", 300)
    back = spark.read.parquet(f"{folder}/spectra").withColumn("m", arrays.unpacked_record("meta"))
    got = lookup.subset(back, table(spark, sf_dir, "embeddings").select("vec_id"), id_col="vec_id", missing="error")
    return got.select("vec_id", (F.col("m.z") >= 0).alias("whole"), F.size("flux").alias("n"))
