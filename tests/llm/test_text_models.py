import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from celestile.llm import components, langid, minhash, toxicity


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(rows, threshold=0.8):
    """Connected components of all pairs, by brute force."""
    sets = [(r.doc_id, shingles(r.text)) for r in rows if r.doc_id is not None and shingles(r.text)]
    own = {d: d for d, _ in sets}

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if len(x & y) >= threshold * len(x | y) - 1e-9:
            lo, hi = sorted((root(a), root(b)))
            own[hi] = lo
    return {r.doc_id: root(r.doc_id) if r.doc_id in own else r.doc_id for r in rows}


@pytest.fixture(scope="module")
def copies(spark):
    """Originals with near copies that are far from each other, chains, exact copies and texts that only share a passage."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows, n = [], itertools.count(100)
    passage = " ".join(word() for _ in range(60))
    for _ in range(6):
        base = [word() for _ in range(300)]
        for _ in range(8):
            near = list(base)
            for _ in range(rng.choice([1, 3, 5, 7])):
                near[rng.randrange(300)] = word()
            rows.append((next(n), " ".join(near)))
        rows.append((next(n), " ".join(base)))
        rows.append((next(n), " ".join(base)))
        chain = list(base)
        for _ in range(6):
            chain = chain[12:] + [word() for _ in range(12)]
            rows.append((next(n), " ".join(chain)))
        rows.append((next(n), passage + " " + " ".join(word() for _ in range(100))))
    for k in (1, 3, 4, 5):
        rows += [(next(n), " ".join(["uno", "dos", "tres", "cuatro", "cinco"][:k]))] * 2
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_near_duplicates_match_brute_force(copies, docs, odd_docs, no_docs):
    for df in (copies, docs, odd_docs, no_docs):
        rows = df.select("doc_id", "text").collect()
        want = classes(rows)
        got = minhash.near_duplicates(df).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: r.class_id for r in got} == want
        assert all(r.kept == (r.doc_id is None or r.class_id == r.doc_id) for r in got)


def test_one_of_each_class_stays(copies, odd_docs):
    for df in (copies, odd_docs):
        kept = minhash.keep_one(df)
        assert kept.columns == df.columns
        ids = [r.doc_id for r in kept.select("doc_id").collect()]
        want = {d for d, c in classes(df.select("doc_id", "text").collect()).items() if d == c}
        assert sorted(map(str, ids)) == sorted(map(str, want))


def test_register_share_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 1500).astype(np.uint64)
    a, b = (pool[:1000], np.full(1000, 1)), (pool[200:1200], np.full(1000, 1))
    regs = minhash.signatures([a, b, (pool[:0], np.zeros(0))], 2000)
    assert abs((regs[0] == regs[1]).mean() - 800 / 1200) < 0.04
    assert (regs[2] == 0).all()


def test_weighted_shingles_match_their_definition(spark):
    """Registers and the exact similarity of weights of counts, against the sum over all elements; classes against all pairs."""
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = []
    for low in (0, 40):
        own, counts = np.unique(rng.choice(pool[low : low + 250], 2000, p=rng.dirichlet(np.ones(250))), return_counts=True)
        sets.append((own, 1 + np.log(counts)))
    exact = lambda x, y: sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())
    a, b = (dict(zip(s.tolist(), w.tolist())) for s, w in sets)
    regs = minhash.signatures(sets, 4000)
    want = exact(a, b)
    assert abs((regs[0] == regs[1]).mean() - want) < 0.04
    assert minhash.similar(*sets, want - 1e-6) and not minhash.similar(*sets, want + 1e-6) and minhash.similar(sets[0], sets[0], 1.0)
    rng, rows = random.Random(5), []
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    for k in range(10):
        body, passage = [word() for _ in range(100)], [word() for _ in range(60)]
        rows += [(3 * k, " ".join(body + passage)), (3 * k + 1, " ".join(body + passage * 60)), (3 * k + 2, " ".join([*body[:-1], word(), *passage]))]

    def bag(text):
        w = text.split()
        n = {}
        for i in range(len(w) - 4):
            n[tuple(w[i : i + 5])] = n.get(tuple(w[i : i + 5]), 0) + 1
        return {s: 1 + np.log(c) for s, c in n.items()}

    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df, weights="counts").collect()}
    for k in range(10):
        x, y, z = (bag(rows[3 * k + i][1]) for i in range(3))
        assert exact(x, y) < 0.8 < exact(x, z) and exact(y, z) < 0.8
        assert [got[3 * k + i] for i in range(3)] == [3 * k, 3 * k + 1, 3 * k]


def test_a_passage_repeated_more_often_parts_no_copies(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = []
    for i in range(24):
        body, passage = [word() for _ in range(140)], [word() for _ in range(60)]
        rows += [(2 * i, " ".join(body + passage * 400)), (2 * i + 1, " ".join([word(), *body[1:], *passage]))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {d: d - d % 2 for d, _ in rows}


def test_pairs_of_a_bucket_are_told_apart_by_their_sets_alone():
    """Two copies that share the first band only, as the registers of rare pairs may."""
    words = [f"w{i}" for i in range(100)]
    regs = np.arange(2 * minhash.BANDS * minhash.ROWS, dtype=np.uint16).reshape(2, -1)
    regs[1, : minhash.ROWS] = regs[0, : minhash.ROWS]
    columns = {"doc": [1, 2], "component": [1, 2], "left": [True, True], "right": [True, True]}
    group = pa.table(columns | {"registers": [r.tobytes() for r in regs], "text": [" ".join(words), " ".join(words[1:])]})
    assert minhash._compare(0, group, 0.8).num_rows == 1


def test_components(spark):
    rng = random.Random(5)
    for links in ([], [(i, i + 1) for i in range(40)], [(500, i) for i in range(60)] + [(7, 7), (9, 500)], [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]):
        own = {v: v for v in range(600)}

        def root(x, own=own):
            while own[x] != x:
                x = own[x]
            return x

        for a, b in links:
            lo, hi = sorted((root(a), root(b)))
            own[hi] = lo
        want = {v: root(v) for v in own if root(v) != v}
        assert {r.v: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()} == want


def test_language_on_held_out_texts(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.predict_digest(docs).collect()}
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 for d, r in got.items())
    out = [d for d, r in got.items() if r.held_out]
    assert len(got) == len(lang) and sum(got[d].lang_pred == lang[d] for d in out) >= 0.97 * len(out)
    odd = langid.predict_digest(odd_docs).collect()
    assert len(odd) == 9 and {r.doc_id: r.lang_pred for r in odd if r.doc_id in (2, 3, 4)} == dict.fromkeys((2, 3, 4), "und")
    assert langid.predict_digest(no_docs).collect() == []
    assert langid.predict_digest(docs.limit(5).withColumn("lang", docs.lang.substr(100, 1)).selectExpr("doc_id", "text", "nullif(lang, '') AS lang")).where("lang_pred <> 'und'").count() == 0
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.count()


def test_kernel_predictions_equal_their_definition():
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcd " if i % 2 else "cdef ", k=80)) for i in range(40)]
    langs = ["x" if i % 2 else "y" for i in range(40)]
    model, grams = langid.fit(texts, langs, landmarks=10), langid.Presence()
    own = [set(grams(t).tolist()) for t in texts]
    k = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    order = sorted(range(40), key=lambda i: xxhash.xxh3_64_intdigest(texts[i].encode()))
    marks = [i for c in "xy" for i in [j for j in order if langs[j] == c][:10]]
    kernel = np.array([[k(a, own[b]) for b in marks] for a in own])
    values, vectors = np.linalg.eigh(kernel[marks])
    keep = values > 1e-8 * values.max()
    features = np.hstack([kernel @ (vectors[:, keep] / np.sqrt(values[keep])), np.ones((40, 1))])
    penalty = langid.RIDGE * 40 * np.eye(features.shape[1])
    penalty[-1, -1] = 1e-6
    y = np.array([[1.0 if lang == c else -1.0 for c in "xy"] for lang in langs])
    f = features @ np.linalg.solve(features.T @ features + penalty, features.T @ y)
    lang, score = model.predict(texts, grams)
    p = np.exp(langid.SHARPNESS * f)
    assert lang == ["xy"[i] for i in f.argmax(1)] and score == pytest.approx(p.max(1) / p.sum(1), abs=1e-5)
    lang, score = model.predict([None, "", "1 2", *texts[:3]], grams)
    assert lang[:3] == ["und"] * 3 and list(score[:3]) == [0, 0, 0] and lang[3:] == ["xy"[i] for i in f[:3].argmax(1)]


def test_a_text_of_many_parts_equals_its_grams():
    """A text longer than what is hashed at once has the n-grams of all its places."""
    rng = random.Random(8)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=2 * langid.CHUNK + 77))
    cut = langid.CHUNK
    parts = [text[:cut], text[cut - 4 : cut + 4], text[cut : 2 * cut], text[2 * cut - 4 : 2 * cut + 4], text[2 * cut :]]
    grams = langid.Presence()
    assert set(grams(text).tolist()) == set(np.concatenate([grams(p) for p in parts]).tolist())


def test_ordinal_regression_orders_grades(spark, odd_docs, no_docs):
    rng = random.Random(4)
    texts, grades = [], []
    for _ in range(900):
        g = rng.randrange(3)
        texts.append(" ".join(rng.choices([f"w{i}" for i in range(200)], k=60) + ["badword"] * (g > 0) * 3 + ["badword"] * (g > 1) * 6))
        grades.append(g)
    model = toxicity.fit(texts[:600], grades[:600])
    assert model.thresholds[0] < model.thresholds[1]
    x = [sum(model.word(w) for w in t.split()) / len(t.split()) ** 0.5 for t in texts[600:]]
    found = [model.at(v) for v in x]
    assert np.mean([f[0] == g for f, g in zip(found, grades[600:])]) > 0.95
    mean = [np.mean([f[1] for f, g in zip(found, grades[600:]) if g == k]) for k in range(3)]
    assert mean[0] < 0.5 < 1 - 0.4 < mean[1] < 1.5 < mean[2]


def test_toxicity_on_documents(spark, odd_docs, no_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    got = {r.doc_id: r for r in toxicity.score_digest(docs, labels).collect()}
    assert len(got) == docs.count()
    assert np.mean([got[d].toxic for d, t in toxic.items() if t == 1]) > 0.9
    assert np.mean([got[d].toxic for d, t in toxic.items() if t == 0]) < 0.05
    # by the definition: weights of words and their 5-grams over the root of the number of words
    model = toxicity.train(docs, labels)
    for r in docs.limit(60).collect():
        words = (r.text or "").lower().split()
        x = sum(model.weights.get(f, 0.0) for w in words for f in toxicity.features_of(w)) / max(1, len(words)) ** 0.5
        upto = [1 / (1 + np.exp(x - t)) for t in model.thresholds] + [1.0]
        p = [b - a for a, b in zip([0.0, *upto], upto)]
        want = (int(np.argmax(p)), sum(g * q for g, q in enumerate(p)), 1 - upto[0]) if words else (0, 0.0, 0.0)
        own = got[r.doc_id]
        assert (own.grade, own.severity, own.p_toxic) == pytest.approx(want, abs=1e-9) and own.toxic == (own.p_toxic >= 0.5)
    for some in (labels, labels.limit(0)):
        odd = toxicity.score_digest(odd_docs, some).collect()
        assert len(odd) == 9 and not any(r.toxic for r in odd if r.doc_id in (2, 3, 4))
    assert toxicity.score_digest(no_docs, labels).collect() == []
