import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from celestile.llm import brown


def tokens(text):
    return (text or "").encode().lower().split()


def xlogx(x):
    return x * math.log(x) if x > 0 else 0.0


def class_bigrams(sequences, of, side=brown.CLASSES):
    table = np.zeros((side, side))
    for s in sequences:
        k = [of[w] for w in [None, *s, None]]
        np.add.at(table, (k[:-1], k[1:]), 1)
    return table


def moved(sequences, of):
    """The classes after a sweep, word by word and class by class."""
    table = class_bigrams(sequences, of)
    rows, cols = table.sum(1), table.sum(0)
    before, after, twice, count = (Counter() for _ in range(4))
    near = defaultdict(set)
    for s in sequences:
        s = [None, *s, None]
        for x, y in zip(s, s[1:]):
            if x == y is not None:
                twice[x] += 1
            elif y is not None:
                before[y, of[x]] += 1
                near[y].add(of[x])
            if x is not None and x != y:
                after[x, of[y]] += 1
                near[x].add(of[y])
        count.update(s[1:-1])
    out = dict(of)
    more = lambda x, n: xlogx(x + n) - xlogx(x)
    for w, c in count.items():
        gain = []
        for k in range(brown.CLASSES - 1):
            sign = -1 if k == of[w] else 1
            g = sign * more(table[k, k], sign * (before[w, k] + after[w, k] + twice[w]))
            for m in near[w] - {k}:
                g += sign * (more(table[m, k], sign * before[w, m]) + more(table[k, m], sign * after[w, m]))
            gain.append(g - sign * (more(rows[k], sign * c) + more(cols[k], sign * c)))
        best = next(k for k, g in enumerate(gain) if g >= max(gain) - 1e-6)
        if gain[best] > gain[of[w]] + 2e-6:
            out[w] = best
    return out


def classes_of(sequences, c):
    """The classes by the definition: the core by exchange, then sweeps over all words, the last taken back if it lowers the likelihood."""
    core = [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: brown.CORE]]
    side = len(core) + 2
    symbol = defaultdict(lambda: side - 2, {w: i for i, w in enumerate(core)}) | {None: side - 1}
    of_symbol = brown.exchange(class_bigrams(sequences, symbol, side))
    of = {w: int(of_symbol[symbol[w]]) if w in symbol else brown.REST for w in c} | {None: brown.END}
    for _ in range(brown.SWEEPS):
        new = moved(sequences, of)
        if brown.likelihood(class_bigrams(sequences, new)) < brown.likelihood(class_bigrams(sequences, of)):
            break
        of = new
    return of


def reference(rows):
    """The model by its definition, one token at a time."""
    train = [r for r in rows if zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 7 != 2]
    sequences = [tokens(r.text) for r in train]
    c = Counter(w for s in sequences for w in s)
    of = classes_of(sequences, c)
    k, unseen = brown.CLASSES + 1, brown.UNSEEN
    trans = np.zeros((k, k))
    for s in sequences:
        s = [None, *s, None]
        for x, y in zip(s, s[1:]):
            for a in {of[x], unseen if c[x] == 1 else of[x]}:
                for b in {of[y], unseen if c[y] == 1 else of[y]}:
                    trans[a, b] += 1
    size = trans[: k - 1, : k - 1].sum(0)
    total, types = sum(c.values()) + len(train), len(c) + bool(train)
    prior = (trans.sum(0) + 1) / (trans.sum() + k)
    out = []
    for r in rows:
        before, score, base, known = brown.END, 0.0, 0.0, 0
        for w in [*tokens(r.text), None]:
            n = len(train) if w is None else c[w]
            cls = of.get(w, unseen)
            score += np.log10((trans[before, cls] + brown.PRIOR * prior[cls]) / (trans[before].sum() + brown.PRIOR))
            if w is not None and n:
                score += np.log10(n / size[cls])
            base += np.log10((n + 1) / (total + types + 1))
            known += n > 0
            before = cls
        out.append((r.doc_id, r not in train, len(tokens(r.text)) + 1, known, total, base, score))
    return out


@pytest.mark.parametrize("kind", ["docs", "odd_docs", "no_docs"])
def test_scores_match_the_definition(request, kind, monkeypatch):
    df = request.getfixturevalue(kind)
    got = sorted((tuple(r)[:7] for r in brown.score(df).collect()), key=str)
    want = sorted(reference(df.select("doc_id", "text").collect()), key=str)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda x: (str(x[0]), x[2])), sorted(want, key=lambda x: (str(x[0]), x[2]))):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:])


def test_exchange_raises_the_likelihood_and_finds_classes():
    rng = np.random.default_rng(1)
    n = 31
    kind = np.arange(n - 1) % 3
    table = np.zeros((n, n))
    for _ in range(20000):
        a, b = rng.integers(0, n - 1, 2)
        if kind[b] == (kind[a] + 1) % 3 or rng.random() < 0.05:
            table[a, b] += 1
    table[-1, :3] = table[:3, -1] = 50
    table = np.insert(np.insert(table, n - 1, 0, 0), n - 1, 0, 1)
    of = brown.exchange(table, classes=5)
    assert of[-1] == 4 and of[-2] == 3 and (of[:-2] < 3).all()
    assert all(len(set(of[:-2][kind == k])) == 1 for k in range(3)) and len(set(of)) == 5


def test_held_out_texts_are_likelier_than_by_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = brown.score(docs).where("held_out").groupBy().sum("base_score", "score").first()
    assert r[1] > r[0] + 0.05 * abs(r[0])


def test_probabilities_sum_to_one():
    table = np.zeros((brown.CLASSES + 1, brown.CLASSES + 1))
    table[brown.END, 0], table[0, 1], table[1, brown.END], table[0, brown.UNSEEN] = 5, 5, 5, 2
    m = brown.Model(brown._moves(table), table[:-1, :-1].sum(0), 15, 3, 5)
    assert np.allclose((10**m.move).sum(1), 1)
    assert np.isclose((10 ** m.emission(np.array([2, 3]), np.array([1, 1]))).sum(), 1)
    assert m.emission(np.array([0]), np.array([brown.UNSEEN])) == 0


def test_rare_words_get_the_class_of_their_neighbours(spark):
    """A grammar of three kinds in turn, far more words than the core: each word lies with its kind, which no spelling tells."""
    rng = np.random.default_rng(7)
    words = [[f"{rng.integers(1 << 40):x}" for _ in range(900)] for _ in range(3)]
    # ids that aren't held out; each word twice or more
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 7 != 2][:800]
    rows = [(i, " ".join(words[k % 3][int(900 * rng.random() ** 2)] for k in range(30))) for i in ids]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    blocks = brown.save(df.mapInArrow(lambda x: brown._block(x, 7, 2), brown.BLOCKS), "blocks")
    met, table, types = brown.cluster(blocks)
    number = {w: k for k, own in enumerate(words) for w in own}
    of = {}
    for b in blocks.collect():
        m = next(m for m in met.collect() if m.doc_ids == b.doc_ids)
        for w, c in zip(brown._split(bytes(b.words)), brown._classes(sorted(({"part": r.part, "classes": bytes(r.classes)} for r in m.state), key=lambda r: r["part"])).tolist()):
            assert of.setdefault(w, c) == c
    kinds = defaultdict(Counter)
    for w, c in of.items():
        kinds[c][number[w.decode()]] += 1
    assert types == len(of) > 3 * brown.CORE
    assert sum(max(k.values()) for k in kinds.values()) > 0.95 * types
