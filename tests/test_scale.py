"""What keeps the queries within their limits on larger tables, and what made them differ from their SQL."""

import duckdb
import numpy as np
import pytest
from celestile.functions import healpix, spectra
from celestile.functions.columns import rounded
from celestile.operators import crossmatch
from celestile.sources import files, fits, writers
from celestile.sources.lake import Lake


def positions(spark, n, seed, first=0):
    rng = np.random.default_rng(seed)
    rows = zip(range(first, first + n), rng.uniform(0, 360, n).tolist(), np.degrees(np.arcsin(rng.uniform(-1, 1, n))).tolist())
    return spark.createDataFrame(list(rows), "_source_id long, ra double, dec double")


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("radius", [1.0, 5.0])
def test_rows_that_meet_are_few_times_the_pairs(spark, radius):
    a, b, h = positions(spark, 3000, 1), positions(spark, 3000, 2), crossmatch.zone_height(radius)
    left, right = (x.select("_source_id", "ra", "dec") for x in (a, b))
    met = crossmatch._in_cell(crossmatch._rows(left, crossmatch.Sky(), "a"), h).join(crossmatch._in_cells(crossmatch._rows(right, crossmatch.Sky(), "b"), radius, h), ["zone", "cell"])
    assert met.count() < 3 * crossmatch.match_all(a, b, radius).count()


def test_pairs_on_the_edge_of_the_radius_are_those_of_the_angle(spark):
    a, b = positions(spark, 300, 3), positions(spark, 300, 4)
    every = crossmatch.pairs(a, b, 180.0).select("a_id", "b_id", "sep_deg").where("sep_deg between 1 and 20").orderBy("sep_deg").limit(40).collect()
    for r in every[::8]:  # the radius is a pair's own separation, which counts
        assert crossmatch.match_all(a, b, r.sep_deg).count() == sum(x.sep_deg <= r.sep_deg for x in every) + crossmatch.pairs(a, b, 1.0).where("sep_deg < 1").count()


def test_nearest_within_a_wide_radius_goes_by_steps(spark):
    a = positions(spark, 500, 5).union(spark.createDataFrame([(900, 10.0, 0.0), (901, 200.0, 0.0), (None, 1.0, 1.0)], "a long, b double, c double"))
    b = positions(spark, 500, 6, 1000).union(spark.createDataFrame([(7, 10.0, 0.1), (5, 10.0, -0.1), (9, 204.5, 0.0)], "a long, b double, c double"))
    plan = crossmatch.match_nearest(a, b, 5.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and "Broadcast" not in plan
    got = sorted((r[0], r[1], r[2]) for r in crossmatch.match_nearest(a, b, 5.0).collect())
    assert got == sorted((r[0], r[1], r[2]) for r in crossmatch.match_nearest(a, b, 5.0, strategy="brute").collect())
    assert dict((r[0], r[1]) for r in got)[900] == 5  # a tie goes to the smaller id
    least = {r.source_id_a: r.sep_deg for r in crossmatch.nearest_separation(a, b, 5.0).collect()}
    assert least.keys() == {r[0] for r in got} and all(abs(least[r[0]] * 3600 - r[2]) < 0.01 for r in got)


def test_a_join_by_pixel_computes_no_pixel_to_tell_whether_it_is_null(spark):
    placed = healpix.with_pixel(positions(spark, 10, 7).union(spark.createDataFrame([(1, None, 2.0), (2, 1.0, float("nan"))], "a long, b double, c double")), "ra", "dec", 3, "pix")
    assert placed.where("pix is null").count() == 2 and placed.where("pix < 0").count() == 0
    kept = placed.where("pix is not null")
    filters = [x for x in optimized(kept).split("\n") if "Filter" in x]
    assert kept.count() == 10 and max(map(len, filters)) < 600


def test_a_tile_of_many_pairs_is_written_by_many_tasks(spark, tmp_path):
    own = spark.range(400_000).selectExpr("id AS source_id_a", "id * 7919 % 400000 AS source_id_b", "CAST(id % 1000 AS FLOAT) AS sep_arcsec", "IF(id < 390000, 5L, id % 3) AS healpix_npix_a", "id AS healpix_npix_b")
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "200KB")
    try:
        lake = Lake(spark, str(tmp_path))
        assert lake.write_association(own, "x", 2)["rows"] == 400_000
    finally:
        spark.conf.unset(key)
    assert len(list(tmp_path.glob("crossmatch/x/Norder=2/Npix=5/*.parquet"))) > 3
    assert lake.association("x", 2).select(own.columns).exceptAll(own).count() == 0


def parts_of(spark, folder, n=3000):
    df = spark.range(n).selectExpr("id", "id / 2D AS x", "concat('t', id) AS t")
    return df, writers.write_fits_parts(df, str(folder), ["id"], 10)


def test_fits_parts_are_written_by_few_tasks_and_not_by_the_driver(spark, tmp_path, monkeypatch):
    written = []
    monkeypatch.setattr(files, "write_bytes", lambda *x: written.append(x[1]))
    monkeypatch.setattr(writers.files, "write_text", lambda *x: None)
    df, made = parts_of(spark, tmp_path / "p")
    assert written == [] and made["rows"] == 3000 and len({p["name"].split("-")[1] for p in made["parts"]}) == 1
    assert all(p["rows"] == 10 for p in made["parts"]) and len(list((tmp_path / "p").glob("part-*.fits"))) == 300
    back = fits.read_fits(spark, f"{tmp_path}/p/*.fits")
    assert back.exceptAll(df).count() == df.exceptAll(back).count() == 0 and fits.row_count(spark, f"{tmp_path}/p/*.fits") == 3000


def test_one_large_fits_file_is_read_by_shares(spark, tmp_path, monkeypatch):
    df, _ = parts_of(spark, tmp_path / "p", 5000)
    assert writers.merge_fits_parts(spark, f"{tmp_path}/p", f"{tmp_path}/all.fits") == 5000
    monkeypatch.setattr(fits, "SHARE_BYTES", 7000)
    back = fits.read_fits(spark, f"{tmp_path}/all.fits")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert writers.fits_differences(df.where("id > 2").union(df.where("id < 2")), f"{tmp_path}/all.fits") == {"missing": 0, "besides": 1}
    assert writers.fits_differences(df.union(df.where("id = 4")), f"{tmp_path}/all.fits") == {"missing": 1, "besides": 0}
    raw = (tmp_path / "all.fits").read_bytes()
    (tmp_path / "cut.fits").write_bytes(raw[:20000])
    with pytest.raises(Exception, match="buffer"):
        fits.read_fits(spark, f"{tmp_path}/cut.fits").count()


def test_a_tile_is_packed_and_verified_in_chunks(spark, tmp_path, monkeypatch):
    import tracemalloc

    (tmp_path / "tile").mkdir()
    (tmp_path / "tile" / "a.bin").write_bytes(np.random.default_rng(1).bytes(50_000_000))
    tracemalloc.start()
    made = writers.pack_tile(spark, f"{tmp_path}/tile", f"{tmp_path}/t.tar")["files"]
    wrong = writers.verify_tile(spark, f"{tmp_path}/t.tar")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert wrong == [] and [(f["name"], f["size"]) for f in made] == [("a.bin", 50_000_000)] and peak < 40_000_000
    raw = bytearray((tmp_path / "t.tar").read_bytes())
    raw[1_000_000] ^= 1
    (tmp_path / "u.tar").write_bytes(raw)
    assert writers.verify_tile(spark, f"{tmp_path}/u.tar") == ["a.bin has changed"]
    monkeypatch.setattr(files, "local_path", lambda *x: None)  # as in a store that isn't mounted
    assert writers.verify_tile(spark, f"{tmp_path}/u.tar") == ["a.bin has changed"]


def test_rounding_is_that_of_sql(spark):
    """ties, and the sign of zero."""
    rng = np.random.default_rng(3)
    ties = (rng.integers(-(10**6), 10**6, 20_000) + 0.5) / 1e6
    x = [0.0, -0.0, -1e-9, 1e-9, 5e-7, -5e-7, float("inf"), float("nan"), 1e300, None, *np.concatenate([ties, np.nextafter(ties, 9), rng.normal(0, 1, 5000)]).tolist()]
    df = spark.createDataFrame(list(enumerate(x)), "id long, x double")
    got = [r.y for r in df.select("id", rounded("x", 6).alias("y")).orderBy("id").collect()]
    con = duckdb.connect()
    con.register("given", df.toPandas())
    want = [r[0] for r in con.execute("SELECT round(x, 6) FROM given ORDER BY id").fetchall()]
    assert [repr(v) for v, u in zip(got, x) if u is not None and u == u] == [repr(v) for v, u in zip(want, x) if u is not None and u == u]
    assert got[x.index(None)] is None and np.isnan(got[7]) and repr(got[2]) == "-0.0"


def test_halfway_between_pixels_is_half_of_each(spark):
    """to the last bit, as ties of a later rounding show."""
    v = np.random.default_rng(4).normal(0, 0.1, (500, 6)).astype("float32").astype(float)
    df = spark.createDataFrame([(i, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0], r.tolist(), [1.0] * 6, [0] * 6) for i, r in enumerate(v)], "id long, w array<double>, f array<double>, i array<double>, m array<int>")
    got = spectra.resample(df, "w", "f", "i", "m", [0.5, 1.5, 2.5, 3.5, 4.5, 5.0]).orderBy("id").collect()
    assert [r.f for r in got] == np.column_stack([0.5 * v[:, :-1] + 0.5 * v[:, 1:], v[:, -1]]).tolist()
