import duckdb
import numpy as np
import pytest
from celestile.llm import lattice, pivots, queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def by_sql(name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    return sorted(map(tuple, con.execute(queries.oracle_sql()[name]).fetchall()))


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Nulls in any column, zero, empty, short and non-finite vectors, ties, repeated rows, clashing columns."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 6))
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i] + rng.standard_normal(6) * 0.02).tolist(), int(i % 3)) for i in range(40)]
    rows += [(200, base[0].tolist(), 0), (200, base[0].tolist(), 0), (300, (-base[0]).tolist(), 0), (301, (2 * base[0]).tolist(), 0), (302, base[0].tolist(), 1)]
    rows += [(400, None, 0), (401, [0.0] * 6, 0), (402, [], 0), (403, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (404, [float("nan")] * 6, 0), (405, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0], 0)]
    rows += [(406, [1.0, 2.0], 0), (407, [1.0, 2.0], 0), (500, base[1].tolist(), None), (None, base[1].tolist(), 1), (None, None, None), (600, [1e30] * 6, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return df.withColumn("v", F.lit("clash")).withColumn("score", F.lit(None).cast("string"))


def usable(rows, zero_too):
    for r in rows:
        x = None if r.embedding is None or None in r.embedding else np.array(r.embedding, float)
        if r.vec_id is not None and x is not None and np.isfinite(x).all() and (zero_too or (len(x) and np.abs(x).max() > 0)):
            yield r, x


def links_by_brute_force(rows):
    own = [(r.vec_id, r.label, x / np.abs(x).max()) for r, x in usable(rows, False) if r.label is not None]
    n, root = {}, {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for i, (a, la, x) in enumerate(own):
        n[i] = 0
        for j, (b, lb, y) in enumerate(own):
            if i != j and la == lb and len(x) == len(y) and x @ y >= 0.98 * np.sqrt((x @ x) * (y @ y)):
                n[i] += 1
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    out = [(a, n[i], find(a), find(a) == a) for i, (a, _, _) in enumerate(own)]
    seen = [x[0] for x in out]
    return out, seen


def test_near_vectors_match_brute_force(spark, odd_vectors):
    got = [tuple(r) for r in lattice.near_duplicates(odd_vectors).collect()]
    want, linked = links_by_brute_force(odd_vectors.collect())
    assert len(got) == odd_vectors.count()
    rest = [g for g in got if g[0] not in linked]
    assert sorted(g for g in got if g[0] in linked) == sorted(want)
    assert all(g[1:] == (0, g[0], True) for g in rest)
    assert lattice.near_duplicates(odd_vectors.limit(0)).collect() == []


def test_near_vectors_match_their_sql(spark):
    assert sorted(tuple(r) for r in queries.op2_near_vectors(spark, SF).collect()) == by_sql("op2_near_vectors")


def test_rows_that_share_an_id_are_vectors_of_their_own(spark):
    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (6, [1.0, 0.01], 1), (5, [0.0, 1.0], 2), (5, [1.0, 0.0], 1)]
    got = sorted(tuple(r) for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(5, 0, 5, True), (5, 0, 5, True), (5, 2, 5, True), (5, 2, 5, True), (6, 2, 5, False)]


@pytest.mark.parametrize("width", [16, 64, 256])
def test_recall_at_the_threshold(width):
    """Pairs at cosine 0.98 exactly meet in a cell of some table; all but 1 of 100 is asked for."""
    rng = np.random.default_rng(width)
    x, y = (v / np.sqrt((v * v).sum(1, keepdims=True)) for v in rng.standard_normal((2, 2000, width)))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.sqrt((y * y).sum(1, keepdims=True))
    near = 0.98 * x + np.sqrt(1 - 0.98**2) * y
    zero = np.zeros(2000, np.int64)
    a, b = (lattice.cells(v, zero).reshape(2000, lattice.TABLES, -1) for v in (x, near))
    assert (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3)).mean() > 0.99


@pytest.mark.parametrize("kind", ["ascending", "mixed"])
def test_components_of_a_chain_take_few_steps(spark, monkeypatch, kind):
    from celestile.llm import components as c

    n, steps = 1000, []
    name = np.arange(n + 1) if kind == "ascending" else np.random.default_rng(3).permutation(n + 1)
    plain = c.save
    monkeypatch.setattr(c, "save", lambda df, what: (steps.append(what), plain(df, what))[1])
    links = spark.createDataFrame([(int(a), int(b)) for a, b in zip(name[:-1], name[1:])], "a long, b long")
    assert sorted(map(tuple, c.components(links).collect())) == [(v, 0) for v in range(1, n + 1)]
    assert sum(s == "links" for s in steps) <= 12 and len(steps) <= 40


@pytest.mark.parametrize("small", [1, 48])
def test_blocks_of_a_large_cell_lose_no_link(spark, monkeypatch, small):
    """A cell of many vectors that all link, each its own class, cut into several blocks and tiles."""
    monkeypatch.setattr(lattice, "ROWS", 16)
    monkeypatch.setattr(lattice, "TILE", 5)
    monkeypatch.setattr(lattice, "PAIRS", 37)
    monkeypatch.setattr(lattice, "SMALL", small)
    rng = np.random.default_rng(1)
    x = np.ones(8) + 0.01 * rng.standard_normal((70, 8))
    got = lattice.near_duplicates(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(69, 0)}


def test_decoding_finds_the_nearest_lattice_point():
    rng = np.random.default_rng(2)
    y = rng.standard_normal((200, 8)) * 2
    best, other, extra = lattice.decode(y)
    for p in (best, other):
        half = p % 2
        assert ((half == half[:, :1]).all(1)).all() and (p.sum(1) % 4 == 0).all()
    near, far = (((y - p / 2) ** 2).sum(1) for p in (best, other))
    assert np.allclose(far - near, extra)
    roots = np.array([[s * (i == a) + t * (i == b) for i in range(8)] for a in range(8) for b in range(a) for s in (1, -1) for t in (1, -1)])
    halves = np.array([v for v in np.stack(np.meshgrid(*[[-0.5, 0.5]] * 8), -1).reshape(-1, 8) if v.sum() % 2 == 0])
    for step in np.concatenate([roots, halves]):
        assert (near <= ((y - best / 2 - step) ** 2).sum(1) + 1e-9).all()


def top_by_brute_force(rows, asks, k):
    own = [(r.vec_id, [int(np.floor(1024 * v)) for v in x]) for r, x in usable(rows, True)]
    out = []
    for q, x in own:
        if asks(q):
            best = sorted((-sum(a * b for a, b in zip(x, y)), v) for v, y in own if v != q and len(x) == len(y))[:k]
            out += [(q, i + 1, v, -s) for i, (s, v) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("ring", [2, 7, 1024])
def test_top_k_matches_brute_force(odd_vectors, ring, monkeypatch):
    monkeypatch.setattr(pivots, "QUERIES", 5)
    monkeypatch.setattr(pivots, "OUTLINES", 3)
    if ring == 7:
        with pytest.raises(ValueError, match="600"):
            pivots.top_k(odd_vectors, F.lit(True))
    odd_vectors = odd_vectors.where("vec_id <> 600 or vec_id is null")
    got = sorted(tuple(r) for r in pivots.top_k(odd_vectors, F.col("vec_id") % 2 == 0, k=4, ring=ring).collect())
    assert got == top_by_brute_force(odd_vectors.collect(), lambda q: q % 2 == 0, 4)
    if ring == 7:
        assert pivots.top_k(odd_vectors.limit(0), F.lit(True)).collect() == []


def test_top_k_matches_its_sql(spark):
    assert sorted(tuple(r) for r in queries.op7_top_k(spark, SF).collect()) == by_sql("op7_top_k")


def test_rings_out_of_reach_are_left_out():
    rng = np.random.default_rng(5)
    rows = np.rint(np.concatenate([1000 * rng.standard_normal(3) + 5 * rng.standard_normal((50, 3)) for _ in range(8)]))
    own = pivots.choose(rows, float((rows * rows).sum(1).max()), 8)
    away = own.distances(own.lift(rows))
    q = rows[3]
    row = {"block": 0, "dim": 3, "n": 1, "queries": np.zeros(1, "<i8").tobytes(), "query_ids": np.full(1, -1, "<i8").tobytes(), "least": np.sort(rows @ q)[-10:-9].astype("<i8").tobytes(), "rows": q.astype("<i8").tobytes()}
    block = pivots._Block(row, own, 10)
    cut = 0
    for p in range(len(own.points)):
        at = np.flatnonzero(away.argmin(1) == p)
        bound = block.bounds(np.array([p]), away[at, p].min(keepdims=True), away[at, p].max(keepdims=True))[0, 0]
        assert (rows[at] @ q <= bound).all()
        cut += bound < block.least[0]
    assert cut >= 3


def test_rings_out_of_reach_are_not_sent(spark, monkeypatch):
    """Clusters far apart: a block of queries gets the rings of its own surroundings only."""
    monkeypatch.setattr(pivots, "QUERIES", 8)
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((16, 8))
    centres /= np.sqrt((centres * centres).sum(1, keepdims=True))
    x = np.repeat(centres, 100, 0) + 0.01 * rng.standard_normal((1600, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    sent, plain = [], pivots.reached
    monkeypatch.setattr(pivots, "reached", lambda blocks, index, shared: (sent.append((blocks.count(), index.count())), plain(blocks, index, shared))[1])
    monkeypatch.setattr(pivots, "save", lambda df, name, keep=pivots.save: (lambda out: (sent.append(out.count()) if name == "reached" else None, out)[1])(keep(df, name)))
    got = pivots.top_k(df, F.col("vec_id") % 20 == 0, ring=16).collect()
    assert len(got) == 80 * 10 and sum(r.vec_id // 100 == r.query_id // 100 for r in got) > 780
    (blocks, rings), pairs = sent
    assert pairs < 0.6 * blocks * rings
