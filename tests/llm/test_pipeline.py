import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from celestile.llm import langid, tokens, toxicity
from tokenizers import Tokenizer

from test_mixing_sharding import targets


@pytest.mark.parametrize("kind", ["docs", "odd_docs", "no_docs"])
def test_stages(spark, request, kind, tmp_path):
    """Every stage keeps the schema and is a multiset of its input's rows; packing holds every row's pieces."""
    docs = request.getfixturevalue(kind)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        out.write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert out.columns == docs.columns
            before, after = (Counter(map(str, d.collect())) for d in (docs, out))
            assert set(after) <= set(before)
            if name != "mixing":
                assert all(after[r] <= before[r] for r in after)
            if kind == "docs" and name == "language":
                assert len(after) >= 0.97 * len(before)
        else:
            assert out.where("piece = 0").count() == docs.count()
        docs = out


def near_classes(rows):
    """doc_id -> the smallest id of its class, over all pairs of sets of five words."""
    sets, own = {}, {}
    for r in rows:
        w = (r.text or "").split()
        if w:
            sets.setdefault(r.doc_id, set()).update(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    own = {d: d for d in sets}

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets.items(), 2):
        if len(x & y) >= 0.8 * len(x | y) - 1e-9:
            lo, hi = sorted((root(a), root(b)))
            own[hi] = lo
    return {d: root(d) for d in own}


def test_run_equals_brute_force(spark, docs):
    """Each stage's decisions over again, one document at a time, from the models that the stages learn."""
    sf = "/root/testdata/sf0.001"
    rows = docs.collect()
    model, grams = langid.train(docs), langid.Presence()
    rows = [r for r in rows if (p := model.predict([r.text], grams))[0] != ["und"] and p[1][0] >= 0.3]
    kept = spark.createDataFrame(rows, docs.schema)
    model = toxicity.train(kept, spark.read.parquet(f"{sf}/labels.parquet"))
    toxic = lambda t: model.at(sum(map(model.word, w)) / len(w) ** 0.5)[2] >= 0.5 if (w := (t or "").lower().split()) else False
    rows = [r for r in rows if not toxic(r.text)]
    own = near_classes(rows)
    rows = [r for r in rows if own.get(r.doc_id, r.doc_id) == r.doc_id]
    # systematic sampling within sources: by size class, salt and size
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    digest = {r.doc_id: hashlib.md5(str(r.doc_id).encode()).hexdigest() for r in rows}
    per_source = Counter()
    for r in rows:
        per_source[r.source] += size[r.doc_id]
    want, copies = targets(per_source), Counter()
    for s in per_source:
        bits = lambda n: max(1, n.bit_length())
        order = sorted((bits(n := size[r.doc_id]) * 8 + (n >> max(0, bits(n) - 3)), int(digest[r.doc_id][:2], 16), n, digest[r.doc_id], r.doc_id) for r in rows if r.source == s)
        ratio = want[s] / per_source[s] if per_source[s] else 0.0
        u = int(hashlib.md5(("mix" + ("" if s is None else "=" + s)).encode()).hexdigest()[:8], 16) / 2**32
        for i, x in enumerate(order):
            copies[x[-1]] = math.floor((i + 1) * ratio + u) - math.floor(i * ratio + u)
    tokenizer = Tokenizer.from_file(tokens.default_vocabulary())
    pieces = Counter()
    for r in rows:
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            pieces[r.doc_id, k, start, len(part), zlib.crc32(part.tobytes())] += copies[r.doc_id]
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == +pieces
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:])) and sum(held[-1]) <= 4096
