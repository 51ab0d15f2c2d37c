import hashlib
import json

import numpy as np
import pytest
from celestile.functions import healpix, ids, photometry, spectra, sphere, text
from celestile.operators import arrays, counting, crossmatch, dedup, gather, homogenize, lookup, master, predicates, quality
from celestile.plans.area import Area, Layer, cost, ingest_advice, parse_partner, run_area, suggest_match
from celestile.plans.region import Region, select_region
from celestile.sources import fits, readers, writers
from celestile.sources.lake import Lake, column_groups, role_of
from celestile.streaming import live
from pyspark.sql import functions as F


def sky(n, seed):
    """Points everywhere, and clusters across RA 0 and at both poles."""
    rng = np.random.default_rng(seed)
    ra, dec = rng.uniform(0, 360, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n)))
    k = n // 5
    ra[:k], dec[:k] = rng.normal(0, 0.6, k) % 360, rng.normal(0, 0.6, k)
    dec[k : 2 * k] = 90 - np.abs(rng.normal(0, 0.8, k))
    dec[2 * k : 3 * k] = -90 + np.abs(rng.normal(0, 0.8, k))
    return ra, dec


def frame(spark, n, seed, first=0):
    ra, dec = sky(n, seed)
    return spark.createDataFrame([(first + i, float(a), float(d)) for i, (a, d) in enumerate(zip(ra, dec))], "_source_id long, ra double, dec double")


@pytest.mark.parametrize("radius", [0.02, 0.4, 3.0])
def test_pairs_and_nearest_match_brute_force(spark, radius):
    a, b = frame(spark, 400, 1), frame(spark, 400, 2, 1000)
    (ra, da), (rb, db) = sky(400, 1), sky(400, 2)
    sep = healpix.distance(ra[:, None], da[:, None], rb[None], db[None])
    want = {(i, 1000 + j) for i, j in zip(*np.nonzero(sep <= radius))}
    got = [(r.source_id_a, r.source_id_b) for r in crossmatch.match_all(a, b, radius).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    near = {r.source_id_a: r.source_id_b for r in crossmatch.match_nearest(a, b, radius).collect()}
    assert near == {i: 1000 + int(sep[i].argmin()) for i in range(400) if sep[i].min() <= radius}
    if radius == 3.0:
        assert near == {r.source_id_a: r.source_id_b for r in crossmatch.match_nearest(a, b, radius, strategy="brute").collect()}
        with pytest.raises(ValueError):
            crossmatch.match_nearest(a, b, radius, strategy="other")


def test_golden_nearest_pair_and_invalid_rows(spark):
    a = spark.createDataFrame([(1001, 120.0, 45.0), (1002, 10.0, 0.0), (None, 50.0, 0.0), (1003, float("nan"), 0.0), (1004, -9999.0, -9999.0)], "_source_id long, ra double, dec double")
    b = spark.createDataFrame([(2001, 120.0001, 45.0001), (2002, 50.0, 0.0), (2003, 360.0, 0.0)], "_source_id long, ra double, dec double")
    assert [(r[0], r[1]) for r in crossmatch.match_nearest(a, b, 4 / 3600).collect()] == [(1001, 2001)]
    edge = spark.createDataFrame([(1, 0.0001, 0.0), (2, 359.9999, 0.0)], "_source_id long, ra double, dec double")
    assert {(r[0], r[1]) for r in crossmatch.match_nearest(edge, b, 1 / 3600).collect()} == {(1, 2003), (2, 2003)}


def test_plan_is_an_equi_join(spark):
    plan = crossmatch.match_nearest(frame(spark, 50, 1), frame(spark, 50, 2), 0.1)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pixels(spark):
    ra, dec = sky(3000, 3)
    df = spark.createDataFrame([(float(a), float(d)) for a, d in zip(ra, dec)], "ra double, dec double")
    for order in (0, 3, 9, 13):
        native = [r.p for r in healpix.with_pixel(df, "ra", "dec", order, "p").select("p").collect()]
        assert native == healpix.ang2pix(ra, dec, order).tolist()
        if order:
            assert ((healpix.ang2pix(ra, dec, order) >> 2) == healpix.ang2pix(ra, dec, order - 1)).all()
    for order in (0, 2, 5):
        pix = np.arange(12 * 4**order)
        a, d = healpix.pix2ang(pix, order)
        assert (healpix.ang2pix(a, d, order) == pix).all()
    rng = np.random.default_rng(0)
    n = np.bincount(healpix.ang2pix(rng.uniform(0, 360, 96_000), np.degrees(np.arcsin(rng.uniform(-1, 1, 96_000))), 1), minlength=48)
    assert n.min() > 1800 and n.max() < 2200
    odd = spark.createDataFrame([(None, 1.0), (float("nan"), 1.0), (-1e-20, 0.0), (360.0, 0.0)], "ra double, dec double")
    got = [r.p for r in healpix.with_pixel(odd, "ra", "dec", 4, "p").collect()]
    assert got[:2] == [None, None] and got[2] == got[3] == healpix.ang2pix(0.0, 0.0, 4)


def test_covers_are_supersets():
    ra, dec = sky(20_000, 5)
    for a, d, r in ((0.1, 0.2, 1.5), (120, 89.5, 2.0), (250, -40, 7.0)):
        own = healpix.ang2pix(ra, dec, 5)[healpix.distance(a, d, ra, dec) <= r]
        assert set(own.tolist()) <= set(healpix.cover_cone(a, d, r, 5))
    for box in ((359, 1, -2, 2), (10, 200, 60, 90), (0, 360, -90, -80)):
        across = (ra >= box[0]) | (ra <= box[1]) if box[0] > box[1] else (ra >= box[0]) & (ra <= box[1])
        own = healpix.ang2pix(ra, dec, 4)[across & (dec >= box[2]) & (dec <= box[3])]
        assert set(own.tolist()) <= set(healpix.cover_bbox(*box, 4)), box
    assert len(healpix.neighbours(100, 3)) >= 8
    north, west, south, east = healpix.corners(19, 2)
    assert max(healpix.distance(*healpix.pix2ang(19, 2), *c) for c in (north, west, south, east)) <= healpix.max_pixel_radius(2) + 1e-9


def test_rescale_and_maps():
    assert healpix.rescale_set({0}, 4, 5) == {0, 1, 2, 3} and healpix.rescale_set({4, 5, 6, 7}, 5, 4) == {1}
    assert healpix.rescale_set(healpix.rescale_set({42}, 5, 8), 8, 5) == {42}
    cells = healpix.merge_cells({(3, p) for p in range(16, 33)} | {(3, 100)})
    assert cells == {(1, 1), (3, 32), (3, 100)}
    assert healpix.parse_moc(healpix.moc_ascii(cells)) == cells and healpix.parse_moc('{"1": [1]}') == {(1, 1)}
    assert healpix.moc_pixels(cells, 2) == [4, 5, 6, 7, 8, 25]
    assert healpix.parse_pixels("1,2,5-9") == [1, 2, 5, 6, 7, 8, 9]
    with pytest.raises(ValueError):
        healpix.parse_pixels("a-3")


def test_ids(spark):
    df = spark.createDataFrame([("12",), ("-7",), ("18446744073709551615",), ("9223372036854775808",), (" abc ",), ("+-5",), ("",), (None,)], "t string")
    h = lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big", signed=True)
    assert [r[0] for r in df.select(ids.normalize("t")).collect()] == [12, -7, -1, -(2**63), h("abc"), h("+-5"), None, None]
    row = spark.createDataFrame([(4055, 55359, 408, "v5_7_0", "v5_13_2", "26")], "p long, m long, f long, r string, r2 string, r3 string")
    assert row.select(ids.spec_id_dr8("p", "m", "f", ids.run2d_code("r"))).first()[0] == 4565636362342690816
    assert tuple(row.select(ids.run2d_code("r2"), ids.run2d_code("r3"), ids.triplet_id("p", "m", "f")).first()) == (1302, 26, h("4055|55359|408"))
    assert ids.radius_token(1) == "1.0" and ids.radius_token(0.25) == "0.25"
    for bad in ("sequential", "column:a,b", "label:"):
        with pytest.raises(ValueError):
            ids.LinkMode.parse(bad)


def test_photometry_golden_values(spark):
    one = spark.range(1)
    rule = lambda *steps, **k: photometry.Rule("x", "y", tuple(photometry.Step(**s) for s in steps), **k)
    golden = [
        (rule({"kind": "mag_offset", "delta": 2.699}), 10.0, 12.699, 0.001),
        (rule({"kind": "mag_offset", "delta": 3.339}), 9.0, 12.339, 0.001),
        (rule({"kind": "scale", "factor": 0.001}), 15000.0, 15.0, 0.0001),
        (rule({"kind": "flux_to_ab", "zero_point": 8.906}), 1.0, 8.906, 0.001),
    ]
    assert homogenize.golden_failures(one, golden) == []
    assert len(homogenize.golden_failures(one, [(golden[0][0], 10.0, 5.0, 0.1)])) == 1
    recipe = homogenize.Recipe.load(json.dumps({"survey": "S", "rules": [{"source": "x", "target": "y", "steps": [{"type": "scale", "factor": 2}]}, {"source": "y", "target": "z", "steps": [{"type": "mag_offset", "delta": 1}]}]}))
    out = homogenize.homogenize_product(spark.createDataFrame([(1.5, "t"), (-9999.0, "t")], "x double, t string"), [recipe])
    assert [(r.y, r.z) for r in out.collect()] == [(3.0, 4.0), (None, None)]
    _, lineage = homogenize.apply_rules(out, [photometry.Rule("t", "w", (photometry.Step("scale"),)), photometry.Rule("no", "w", (photometry.Step("scale"),))])
    assert ["skipped" in x for x in lineage] == [True, True]
    with pytest.raises(ValueError):
        homogenize.Recipe.load('{"survey": "S", "rules": [{"source": "x", "target": "y", "steps": [{"type": "magic"}]}]}')


def test_spectra_resample_and_stamp(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0], [10.0, 20.0, 30.0], [1.0, 1.0, 1.0], [0, 0, 1])], "id long, w array<double>, f array<double>, i array<double>, m array<int>")
    r = spectra.resample(df, "w", "f", "i", "m", [0.5, 1.5, 2.0, 3.5]).first()
    assert r.f == [0.0, 15.0, 20.0, 0.0] and r.m == [1, 0, 0, 1] and r.i == [0.0, 1.0, 1.0, 0.0]
    image = spark.createDataFrame([([float(k) for k in range(16)], 0, 0)], "image array<double>, x int, y int")
    cut = spectra.stamp(image, "image", (4, 4), "x", "y", 2, "cut", fill=-1.0).first().cut
    assert cut == [-1.0, -1.0, -1.0, 0.0]
    with pytest.raises(ValueError):
        spectra.flux_scaled("f", 0)


def test_predicates(spark):
    df = spark.createDataFrame([(1, 2.0)], "Mag_G int, b double")
    assert predicates.select_specs(df, ["mag_g:g, b"]).columns == ["g", "b"]
    assert predicates.conjunction("where a > 1", None, "b < 2") == "(a > 1) AND (b < 2)"
    for bad in ("", "a; drop", "a -- x", "a /* x"):
        with pytest.raises(ValueError):
            predicates.checked(bad)
    for bad in ("_source_id=1", "x", "b=1", "n:blob=1"):
        with pytest.raises(ValueError):
            predicates.with_constants(df, [bad])
    with pytest.raises(ValueError):
        predicates.filtered(df, limit=0)


def test_duplicates_and_lookups(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 3), (None, 4), (2, 5)], "id long, n int")
    assert sorted(r.n for r in dedup.deduplicated(df, "id", ["n"], "skip").collect()) == [1, 3, 4, 5]
    assert sorted(r.n for r in dedup.deduplicated(df, "id", ["n"], "last").collect()) == [2, 3, 4, 5]
    for f in (lambda: dedup.deduplicated(df, "id", ["n"], "error"), lambda: dedup.appended(df, df, "id", "error"), lambda: dedup.appended_arrays(df, df, "id", "skip")):
        with pytest.raises(dedup.DuplicateIds):
            f()
    asked = spark.createDataFrame([(2, 0), (9, 1)], "id long, pos int")
    assert [r.id for r in lookup.batch(df, asked, "pos", "id", missing="skip").collect()] == [2]
    with pytest.raises(Exception, match="no row of id 9"):
        lookup.batch(df, asked, "pos", "id").collect()
    shuffled = lookup.tile_sequential(df.where("id is not null"), "id", "n", seed=3).orderBy("step").collect()
    assert [r.step for r in shuffled] == [0, 1, 2] and sorted(r.n for r in shuffled) == [1, 2, 5]
    wrong = gather.zipped([df.select("n", "id"), df.select("n", (F.col("id") + 1).alias("id"))], "n", ["id"])
    with pytest.raises(Exception, match="differs in row"):
        wrong.collect()


def test_master_sql_equals_frames(spark):
    spark.createDataFrame([(101, 1), (102, 2)], "desi_targetid long, euclid_source_id long").createOrReplaceTempView("master")
    spark.createDataFrame([(101,), (103,)], "want_id long").createOrReplaceTempView("want")
    spark.createDataFrame([(1, 20.5), (2, 21.5)], "_source_id long, mag double").createOrReplaceTempView("euclid")
    links, picks = {"DESI": "desi_targetid", "EUCLID": "euclid_source_id"}, master.column_picks(["EUCLID:mag"])
    plan = master.build_select("master", "want", "DESI", links, {"EUCLID": ("euclid", "_source_id")}, picks)
    frames = master.want_master_catalogs(spark, spark.table("want"), spark.table("master"), "DESI", links, {"EUCLID": (spark.table("euclid"), "_source_id")}, picks)
    assert [tuple(r) for r in spark.sql(plan.select).collect()] == [tuple(r) for r in frames.collect()] == [(101, 20.5)]
    assert master.guess_surveys(["desi_targetid", "euclid_source_id"], ["DESI", "EUCLID"]) == links
    assert master.alias_of("2MASS PSC") == "s_2mass_psc"


def test_fits_round_trip_and_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.5, "ab", [1.0, 2.0], True), (2, None, None, [3.0, None], None)], "id long, x double, t string, v array<float>, b boolean")
    writers.write_extract(df, f"{tmp_path}/a.fits", "fits")
    got = readers.read_table(spark, f"{tmp_path}/a.fits").collect()
    assert [r.id for r in got] == [1, 2] and got[0].v == [1.0, 2.0] and got[0].t == "ab" and got[1].t == "" and np.isnan(got[1].x) and got[1].b is None
    assert fits.row_count(spark, f"{tmp_path}/a.fits") == 2
    raw = open(f"{tmp_path}/a.fits", "rb").read()
    assert len(raw) % 2880 == 0 and fits.format_report(raw).whole.all() and not fits.format_report(raw[:5800]).whole.all()
    with pytest.raises(ValueError):
        fits.choose_units(fits.units(raw), "NOPE")
    writers.write_extract(df.select("id", "x", "t"), f"{tmp_path}/a.vot", "votable")
    assert [tuple(r) for r in readers.read_table(spark, f"{tmp_path}/a.vot").orderBy("id").collect()] == [(1, 1.5, "ab"), (2, None, None)]
    (tmp_path / "b.csv").write_text("# note\n ra ;dec\n1.5;2\n3;4\n")
    assert readers.sniff(spark, f"{tmp_path}/b.csv") == ";" and readers.read_table(spark, f"{tmp_path}/b.csv").columns == ["ra", "dec"]
    packed = spark.createDataFrame([([1, 2], [3.0, 4.0])], "a array<int>, b array<double>")
    assert [tuple(r) for r in fits.unpacked(packed).collect()] == [(1, 3.0), (2, 4.0)]


def test_lake_ingest_append_and_area(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    lake.create({"order": 3})
    raw = spark.createDataFrame([(i, float(a), float(d), 18.0 + i % 5) for i, (a, d) in enumerate(zip(*sky(200, 8)))], "objid int, RA double, DEC double, MAG_G double")
    info = lake.ingest(raw, "A", ra="RA", dec="DEC", link="column:objid", order=3, constants=["epoch=J2000"])
    assert info["total_rows"] == 200 and lake.surveys() == ["A"] and lake.catalog("A").count() == 200
    own = lake.catalog("A")
    assert own.where("Npix <> _healpix_order3").count() == 0 and quality.catalog_problems(own, info) == []
    with pytest.raises(FileExistsError):
        lake.ingest(raw, "A", ra="RA", dec="DEC", link="column:objid", order=3)
    with pytest.raises(ValueError):
        lake.ingest(raw.withColumn("DEC", F.lit(95.0)), "X", ra="RA", dec="DEC", link="column:objid")
    again, new, bare = raw.where("objid >= 190"), raw.where("objid < 10").withColumn("objid", F.col("objid") + 200), raw.where("objid < 3").withColumn("objid", F.lit(None).cast("int"))
    more = healpix.with_pixel(again.union(new).union(bare).withColumn("_source_id", F.col("objid").cast("long")), "RA", "DEC", 3, "_healpix_order3")
    more.select("_source_id", "RA", "DEC", "MAG_G", "_healpix_order3").write.parquet(f"{tmp_path}/incoming")
    for _ in range(2):  # a second run adds nothing
        stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/incoming").schema).parquet(f"{tmp_path}/incoming")
        live.append_live(stream, lake, "A", 3, f"{tmp_path}/cp{_}").awaitTermination()
    assert live.finish(lake, "A", 3)["total_rows"] == 213
    sky_of = crossmatch.Sky("_source_id", "RA", "DEC", "_healpix_order3")
    area = Area.load(json.dumps({"name": "My Area", "region": {"cone": [0, 0, 5]}, "crossmatch_plan": {"base": "A", "partners": ["B:3.0"]}, "gather": {"columns": {"B": ["MAG_G"]}}}))
    out = run_area(area, {"A": Layer(own, sky_of, 3), "B": Layer(own, sky_of, 3)})
    assert out["discovery"].count() == 2 and out["product"].where("B_MAG_G = MAG_G").count() == out["product"].count() > 0
    assert area.name == "my_area" and area.is_valid() and not Area("x", {}, crossmatch_plan={"partners": ["B:-1"]}).is_valid()
    lake.write_association(out["A_x_B__r3.0"], "A_x_B__r3.0", 3)
    assert lake.association("A_x_B__r3.0", 3).count() == out["product"].count() and lake.association("none", 3).count() == 0
    region = Region.parse({"bbox": [359, 1, -2, 2]})
    assert select_region(own, region, "_healpix_order3", 3, "RA", "DEC", exact=True).count() <= select_region(own, region, "_healpix_order3", 3).count()
    writers.pack_tile(spark, f"{tmp_path}/catalogs/A/Norder=3", f"{tmp_path}/t.tar")
    assert writers.verify_tile(spark, f"{tmp_path}/t.tar") == []
    writers.write_moc(spark, f"{tmp_path}/m.txt", range(16), 3)
    assert (tmp_path / "m.txt").read_text() == "1/0\n"


def test_tile_modes_touch_their_tiles_only(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame([(i, p, v) for i, p, v in x], "_source_id long, _healpix_order3 long, v int")
    held = lambda: sorted((r._source_id, r._healpix_order3, r.v) for r in lake.catalog("A", order=3).collect())
    lake.write_tiles(rows((1, 5, 1), (2, 5, 1), (3, 9, 1)), "A", order=3)
    lake.write_tiles(rows((4, 5, 2)), "A", order=3, mode="overwrite")
    assert held() == [(3, 9, 1), (4, 5, 2)]
    lake.write_tiles(rows((3, 9, 3), (7, 9, 3)), "A", order=3, mode="append", on_duplicate="skip")
    assert held() == [(3, 9, 1), (4, 5, 2), (7, 9, 3)]
    lake.write_tiles(rows((3, 9, 4), (8, 11, 4)), "A", order=3, mode="append", on_duplicate="last")
    assert held() == [(3, 9, 4), (4, 5, 2), (7, 9, 3), (8, 11, 4)]
    with pytest.raises(dedup.DuplicateIds):
        lake.write_tiles(rows((8, 11, 5)), "A", order=3, mode="append", on_duplicate="error")
    lake.write_tiles(rows((9, 11, 6), (9, 12, 6)), "A", order=3, mode="skip")
    assert held() == [(3, 9, 4), (4, 5, 2), (7, 9, 3), (8, 11, 4), (9, 12, 6)]


@pytest.mark.parametrize(("policy", "kept"), [("skip", 0), ("last", 5)])
def test_duplicates_at_ingest_go_by_file_order(spark, tmp_path, policy, kept):
    for k in range(3):
        spark.createDataFrame([(1, 10.0 - k, 5.0, 2 * k), (1, 10.0 - k, 5.0, 2 * k + 1)], "objid int, ra double, dec double, v int").coalesce(1).write.parquet(f"{tmp_path}/in/{k}.parquet")
    lake = Lake(spark, str(tmp_path))
    lake.ingest(spark.read.parquet(f"{tmp_path}/in/*"), "A", ra="ra", dec="dec", link="column:objid", order=1, on_duplicate=policy)
    assert [r.v for r in lake.catalog("A").collect()] == [kept]


def test_gather_by_tile_reads_the_same(spark):
    base = spark.createDataFrame([(1, 10), (2, 11)], "_source_id long, x int")
    partner = spark.createDataFrame([(7, 3, "a"), (7, 4, "other tile"), (8, 5, "b")], "_source_id long, Npix int, t string")
    links = spark.createDataFrame([(1, 7, 0.5, 3), (1, 8, 0.7, 5), (9, 8, 0.1, 5)], "source_id_a long, source_id_b long, sep_arcsec float, healpix_npix_b long")
    got = gather.gather(base, [gather.GatherPartner("P", partner, links, ["t"], pixel="Npix")]).orderBy("_source_id").collect()
    assert [(r._source_id, r.P_t) for r in got] == [(1, "a"), (2, None)]
    every = gather.gather(base, [gather.GatherPartner("P", partner, links, ["t"], pixel="Npix")], multiplicity="all").collect()
    assert sorted((r._source_id, str(r.P_t)) for r in every) == [(1, "a"), (1, "b"), (2, "None")]


def test_islands_across_blocks(spark):
    rng = np.random.default_rng(3)
    own = sorted(set(rng.integers(0, 200, 150).tolist()))
    want = {}
    for v in own:
        first = want.pop(v - 1, (v, 0))
        want[v] = (first[0], first[1] + 1)
    df = spark.createDataFrame([(v,) for v in own * 2] + [(None,)], "r long")
    for bits in (1, 3, 20):
        assert sorted((r["first"], r["last"], r["n"]) for r in lookup.islands(df, "r", bits).collect()) == sorted((a, v, n) for v, (a, n) in want.items())


def test_packed_records_and_widths(spark):
    one = spark.createDataFrame([(0.5, "DESI", 10.0, "a.fits"), (None, None, None, None)], "z double, instr string, ra double, source_file string")
    back = one.select(arrays.unpacked_record(arrays.packed_record({c: c for c in one.columns})).alias("m"), F.length(arrays.packed_record({})).alias("n")).collect()
    assert [(r.m.z, r.m.instr, r.m.ra, r.m.source_file, r.m.R, r.n) for r in back] == [(0.5, "DESI", 10.0, "a.fits", 0.0, 236), (0.0, "", 0.0, "", 0.0, 236)]
    assert spark.range(1).select(arrays.unpacked_record(F.lit(b"short")).alias("m")).first().m is None
    wcs = {"crval1": 10.0, "crval2": 20.0, "crpix1": 5.0, "crpix2": 5.0, "cd1_1": -0.01, "cd1_2": 0.0, "cd2_1": 0.0, "cd2_2": 0.01, "naxis1": 9, "naxis2": 9}
    own = spark.range(1).select(arrays.unpacked_record(arrays.packed_record({k: F.lit(v) for k, v in wcs.items()}, arrays.WCS), arrays.WCS).alias("w"))
    r = own.select(arrays.pixel_to_sky("w", 5, 5).alias("mid"), arrays.pixel_to_sky("w", 5, 6).alias("up"), arrays.wcs_cards("w").alias("c")).first()
    assert (r.mid.ra, r.mid.dec, r.up.ra) == pytest.approx((10, 20, 10)) and r.up.dec == pytest.approx(20.01, abs=1e-6) and r.c["CTYPE1"] == "RA---TAN" and r.c["NAXIS1"] == "9"
    df = spark.createDataFrame([([1.0], [1.0], [0]), ([1.0, 2.0, 3.0], [1.0, 1.0, 1.0], [0, 0, 0]), (None, None, None)], "flux array<double>, ivar array<double>, mask array<int>")
    wide = arrays.widened(df).collect()
    assert [len(r.flux) for r in wide[:2]] == [3, 3] and wide[0].mask == [0, 1, 1] and wide[0].ivar == [1.0, 0.0, 0.0] and wide[2].flux is None
    assert [len(r.flux) for r in arrays.widened(df, 2, policy="truncate").collect()[:2]] == [2, 2]
    for width, policy in ((2, "pad"), (3, "error")):
        with pytest.raises(Exception, match="elements"):
            arrays.widened(df, width, policy=policy).collect()
    sky_rows = frame(spark, 500, 4)
    assert 30 < arrays.sky_sample(sky_rows, "ra", "dec", 60).count() < 100 and arrays.sky_sample(sky_rows, "ra", "dec").count() == 500


def test_explicit_uncertainties_and_recipe_checks(spark):
    recipe = homogenize.Recipe.load(json.dumps({"survey": "S", "rules": [
        {"source": "f", "target": "m", "error": "e", "steps": [{"type": "scale", "factor": 2}, {"type": "flux_to_ab", "zero_point": 22.5}], "error_steps": [{"type": "scale", "factor": -2}, {"type": "flux_to_ab", "zero_point": 0}, {"type": "mag_offset", "delta": 0.1}]},
        {"source": "f", "target": "i", "error": "e", "steps": {"type": "inverse"}, "error_steps": {"type": "inverse"}},
        {"source": "f", "target": "j", "error": "e", "steps": {"type": "inverse"}},
        {"source": "f", "target": "s", "error": "e", "steps": {"type": "scale", "factor": -3}},
    ]}))
    r = homogenize.homogenize_product(spark.createDataFrame([(4.0, 0.5)], "f double, e double"), [recipe]).first()
    k = photometry.MAG_PER_RELATIVE_FLUX
    assert (r.m_err, r.i_err, r.j_err, r.s_err) == pytest.approx((k * -1.0 / -16 + 0.1, 2.0, 0.5, -1.5))
    for wrong in ({"type": "scale"}, {"type": "flux_to_ab"}, {"type": "mag_offset"}, {}):
        with pytest.raises(ValueError):
            homogenize.Recipe.load(json.dumps({"survey": "S", "rules": [{"source": "x", "target": "y", "steps": [wrong]}]}))


def test_packed_fits_and_header_reads(spark, tmp_path):
    import gzip

    df = spark.createDataFrame([(i, i / 2, f"t{i}") for i in range(5)], "id long, x double, t string")
    writers.write_extract(df, f"{tmp_path}/a.fits", "fits")
    raw = open(f"{tmp_path}/a.fits", "rb").read()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.fits.gz").write_bytes(gzip.compress(raw))
    (tmp_path / "in" / "c.fits").write_bytes(raw)
    assert fits.row_count(spark, f"{tmp_path}/in") == 10 and readers.read_table(spark, f"{tmp_path}/in/b.fits.gz").count() == 5
    got = fits.read_fits(spark, f"{tmp_path}/in", with_path=True)
    assert sorted((r.id, r.x, r.t) for r in got.collect()) == sorted([(i, i / 2, f"t{i}") for i in range(5)] * 2) and got.select("input_path").distinct().count() == 2


def image_unit(array, first=False, **cards):
    """A FITS image unit."""
    x = np.asarray(array, ">f8")
    head = [fits._card("SIMPLE", True) if first else fits._card("XTENSION", "IMAGE"), fits._card("BITPIX", -64), fits._card("NAXIS", x.ndim)]
    head += [fits._card(f"NAXIS{k + 1}", n) for k, n in enumerate(reversed(x.shape))] + [fits._card(k.replace("_", "-") if k == "DC_FLAG" else k, v) for k, v in cards.items()]
    data = x.tobytes()
    return fits._header(head) + data.ljust(-(-len(data) // fits.BLOCK) * fits.BLOCK, b"\0")


def test_spectra_files_by_layout(spark, tmp_path):
    import pyarrow as pa
    from celestile.sources import spectra_files

    empty = fits._header([fits._card("SIMPLE", True), fits._card("BITPIX", 8), fits._card("NAXIS", 0), fits._card("OBJECT", "star")])
    (tmp_path / "line.fits").write_bytes(image_unit([1.0, np.nan, 3.0], True, OBJECT="o", CRVAL1=4000.0, CDELT1=2.0) + image_unit([0.5, 0.5, 0.0], EXTNAME="ERR"))
    coadd = fits.encode(pa.table({"loglam": [3.5, 3.6], "flux": [1.0, 2.0], "ivar": [4.0, 5.0], "and_mask": [0, 1]}))
    (tmp_path / "coadd.fits").write_bytes(empty + coadd[fits.BLOCK :])
    plate = image_unit([[1.0, 2.0], [3.0, 4.0]], True, COEFF0=3.0, COEFF1=1.0) + image_unit([[1.0, 1.0], [0.0, 1.0]]) + image_unit([[0.0, 0.0], [1.0, 0.0]])
    (tmp_path / "plate.fits").write_bytes(plate)
    arms = b"".join(image_unit(w, EXTNAME=f"{a}_WAVELENGTH") + image_unit([f], EXTNAME=f"{a}_FLUX") + image_unit([[1.0, 1.0]], EXTNAME=f"{a}_IVAR") for a, w, f in (("R", [5.0, 7.0], [1.0, 3.0]), ("B", [4.0, 6.0], [0.0, 2.0])))
    (tmp_path / "arms.fits").write_bytes(empty + arms)
    got = {}
    for r in spectra_files.read_spectra(spark, f"{tmp_path}/*.fits").collect():
        got.setdefault(r.source_file.partition(".")[0], []).append(r)
    line, coadd, arms = got["line"][0], got["coadd"][0], got["arms"][0]
    assert (line.object, line.wavelength, line.flux, line.ivar, line.mask) == ("o", [4000.0, 4002.0, 4004.0], [1.0, 0.0, 3.0], [4.0, 4.0, 0.0], [0, 1, 0])
    assert coadd.object == "star" and coadd.wavelength == pytest.approx([10**3.5, 10**3.6]) and coadd.mask == [0, 1]
    assert [r.flux for r in got["plate"]] == [[1.0, 2.0], [3.0, 4.0]] and got["plate"][0].wavelength == [1e3, 1e4] and got["plate"][1].mask == [1, 0]
    assert arms.wavelength == [4.0, 5.0, 6.0, 7.0] and arms.flux == [0.0, 1.0, 2.0, 3.0]
    own = spectra_files.read_spectra(spark, f"{tmp_path}/line.fits", lambda found, raw: iter([("mine", *(np.ones(1),) * 4)]))
    assert [r.object for r in own.collect()] == ["mine"]


def test_fits_parts_go_on_where_they_stopped(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}", [float(i)] * (1 + i % 3)) for i in range(25)], "id long, t string, v array<double>")
    made = writers.write_fits_parts(df, f"{tmp_path}/p", ["id"], 10)
    assert made["rows"] == sum(p["rows"] for p in made["parts"]) == 25 and max(p["rows"] for p in made["parts"]) <= 10
    kept = (tmp_path / "p" / made["parts"][0]["name"]).stat().st_mtime_ns
    (tmp_path / "p" / made["parts"][1]["name"]).unlink()
    assert writers.write_fits_parts(df, f"{tmp_path}/p", ["id"], 10, resume=True) == made
    assert (tmp_path / "p" / made["parts"][0]["name"]).stat().st_mtime_ns == kept
    assert writers.merge_fits_parts(spark, f"{tmp_path}/p", f"{tmp_path}/all.fits") == 25
    assert fits.row_count(spark, f"{tmp_path}/all.fits") == 25
    assert writers.write_fits_parts(df.limit(0), f"{tmp_path}/none", ["id"])["rows"] == 0 and fits.read_fits(spark, f"{tmp_path}/none/*.fits").columns == ["id", "t", "v"]


def test_bandpass_curves(spark, tmp_path):
    from celestile.sources.bandpasses import Bandpasses

    (tmp_path / "bandpasses").mkdir()
    (tmp_path / "bandpasses" / "w.ecsv").write_text("# %ECSV 1.0\nwavelength throughput\n1.0 0.5\n2.0 0.25\n")
    (tmp_path / "b.json").write_text(json.dumps({"bands": {"w": {"lambda_eff_um": 3.4, "curve": "w.ecsv"}, "x": {"lambda_eff_um": 1, "curve": "none.ecsv"}}}))
    own = Bandpasses.load(spark, f"{tmp_path}/b.json", f"{tmp_path}/lake")
    assert [tuple(r) for r in own.curve("w").orderBy("wavelength").collect()] == [(1.0, 0.5), (2.0, 0.25)] and own.curve("x") is None and own.curve("no") is None
    assert own.frame().where("band = 'w'").first().lambda_eff == pytest.approx(34000)


def test_planning_helpers(spark):
    assert crossmatch.parse_tree_name(crossmatch.tree_name("A", "B", 1)) == {"a": "A", "b": "B", "mode": "sky", "radius_arcsec": 1.0}
    assert crossmatch.parse_tree_name(crossmatch.tree_name("A", "B", columns=("x", "y")))["columns"] == ("x", "y")
    assert parse_partner("B:k=j").columns == ("k", "j") and suggest_match(["TARGETID"], ["TARGETID"], "B")[0].columns == ("TARGETID", "TARGETID")
    assert cost("gather", 360)["hours"] == 1.0 and ingest_advice(400_000, 4)["mode"] == "shard" and ingest_advice(100, 5)["mode"] == "append"
    assert role_of("_source_id") == "id" and role_of("MAG_G") == "photometry" and column_groups(["a_x", "a_y", "b"]) == {"a": ["a_x", "a_y"]}
    shown = spark.createDataFrame([(950,), (1234,), (56_789,), (4_200_000,)], "n long").select(counting.humanized("n")).collect()
    assert [r[0] for r in shown] == ["~950", "~1.2k", "~57k", "~4.2M"]
    assert spark.range(1).select(sphere.sexagesimal(F.lit("-01 30 36.0"))).first()[0] == pytest.approx(-1.51)
    docs = spark.createDataFrame([("a.md", "# One\nx tile tile\n## Tile two\ny")], "path string, t string")
    assert [r.heading for r in text.search(text.sections(docs, "path", "t"), "tile", 5).collect()] == ["Tile two", "One"]
    best = counting.recommended_order(spark.createDataFrame([(3, 9e5), (5, 6e4), (7, 4e3)], "order int, rows_per_pixel double")).first()
    assert best["order"] == 5 and best.in_range


def test_column_match_within_tiles(spark):
    a = spark.createDataFrame([(1, "k", 10.0, 10.0), (2, None, 10.0, 10.0)], "_source_id long, key string, ra double, dec double")
    b = spark.createDataFrame([(7, "k", 10.1, 10.0), (8, "k", 200.0, -50.0)], "_source_id long, key string, ra double, dec double")
    own = [healpix.with_pixel(x, "ra", "dec", o, "p") for x, o in ((a, 4), (b, 5))]
    s = crossmatch.Sky(pixel="p")
    assert [(r[0], r[1]) for r in crossmatch.match_column(*own, "key", "key", s, s, orders=(4, 5)).collect()] == [(1, 7)]
    assert crossmatch.match_column(*own, "key", "key", s, s).count() == 2
