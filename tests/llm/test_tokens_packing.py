import zlib
from collections import Counter

import numpy as np
from celestile.llm import packing, repair, token_output, tokens
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer


def reference_ids(texts, end):
    t = Tokenizer.from_file(tokens.default_vocabulary())
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for x in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_pieces_give_the_ids_of_whole_texts(texts):
    assert tokens.encoder().encode(texts) == [x[:-1].tobytes() for x in reference_ids(texts, 0)]


def test_held_words_are_not_encoded_again(monkeypatch):
    """16,000 words come round again, bare and with a mark, within 4 MB of pieces."""
    monkeypatch.setattr(tokens, "CACHE_BYTES", 4 << 20)
    codec, learned = tokens.Encoder(tokens.default_vocabulary()), []
    learn = codec._learn
    codec._learn = lambda pieces, *more: (learned.append(len(pieces)), learn(pieces, *more))
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) + "ation" for i in range(16_000)]
    texts = [[" ".join(w + mark for w in words[i : i + 2000])] for mark in ("", "", ",") for i in range(0, len(words), 2000)]
    got = [codec.encode(text)[0] for text in texts]
    assert sum(learned) == len(words)
    assert got[::5] == [reference_ids(text, 0)[0][:-1].tobytes() for text in texts[::5]]


_piece = st.one_of(
    st.text("aé.,\0", max_size=18),
    st.integers(12, 18).map(lambda n: "abcdefghijklmnopqrstuvwxyz"[:n]),
    st.sampled_from(["été", "ÉTÉ.", "ǅ", "ß,", "ſ", "aʼs", "it's", "a\tb", "..", "x.,", "<|endoftext|>", "ª", "µ.", "ŉ"]),
)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(_piece, max_size=12).map(" ".join), min_size=1, max_size=8), st.sampled_from([0, 2000, 1 << 20]))
def test_ids_stay_right_as_pieces_come_and_go(texts, room):
    codec, before = tokens.encoder(), tokens.CACHE_BYTES
    codec.now, codec.older = tokens._Generation(), tokens._Generation()
    tokens.CACHE_BYTES = room
    try:
        got = [codec.encode([text])[0] for text in texts + texts] + codec.encode(texts)
    finally:
        tokens.CACHE_BYTES = before
    assert got == [ids[:-1].tobytes() for ids in reference_ids(texts, 0)] * 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=400), st.integers(0, 300), st.integers(1, 60))
def test_grammar_round_trip_and_random_access(ids, start, length):
    ids = np.array(ids * 3, np.uint32)
    g = repair.load(repair.dump(repair.compress(ids, 6)))
    assert (repair.expand(g) == ids).all() and repair.lengths(g).sum() == len(ids)
    if start + length <= len(ids):
        assert (repair.read(g, start, length) == ids[start : start + length]).all()


def most_frequent_pair(body):
    """How often the most frequent adjacent pair occurs without overlap with itself."""
    count, last = Counter(), {}
    for i, pair in enumerate(zip(body[:-1], body[1:])):
        if last.get(pair) != i - 1 or pair[0] != pair[1]:
            count[pair] += 1
            last[pair] = i
    return max(count.values(), default=0)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 12), st.integers(0, 900), st.integers(2, 6), st.integers(0, 9))
def test_no_frequent_pair_is_left(kinds, n, least, seed):
    ids = np.random.default_rng(seed).integers(0, kinds, n).astype(np.uint32)
    g = repair.compress(ids, 12, least)
    assert (repair.expand(g) == ids).all()
    assert most_frequent_pair(g.body.tolist()) < least or n < 2 * least


def test_no_frequent_pair_is_left_of_a_large_shard():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.zipf(1.3, 60_000) % 5000, np.tile(rng.integers(0, 5000, 300), 40), np.full(20_000, 7)]).astype(np.uint32)
    g = repair.load(repair.dump(repair.compress(ids, 5000)))
    assert (repair.expand(g) == ids).all()
    assert most_frequent_pair(g.body.tolist()) < repair.LEAST
    assert len(repair.compress(np.full(20_000, 7, np.uint32), 10).body) < 2 * repair.LEAST


def check_output(df, rows):
    got = token_output.read_digest(token_output.write_ids(df, shard_ids=3000)).collect()
    rows = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    ids = reference_ids([r.text for r in rows], 2)
    starts = np.cumsum([0, *map(len, ids)])
    want = [(r.doc_id, int(s), len(i), zlib.crc32(i.tobytes())) for r, s, i in zip(rows, starts, ids)]
    assert sorted(map(tuple, got), key=lambda x: x[1]) == want
    return np.concatenate(ids) if ids else np.zeros(0)


def test_token_output(spark, docs, odd_docs, no_docs):
    check_output(odd_docs, odd_docs.select("doc_id", "text").collect())
    check_output(no_docs, [])
    everything = check_output(docs, docs.select("doc_id", "text").collect())
    shards = token_output.write_ids(docs, shard_ids=3000)
    assert token_output.read_range(shards, 12_345, 9_000) == everything[12_345 : 12_345 + 9_000].tolist()


def check_packing(df, rows, capacity=4096):
    got = packing.pack(df, capacity=capacity).collect()
    by_seq, by_doc = {}, {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    want = {}
    for r, ids in zip(rows, reference_ids([r.text for r in rows], 1)):
        want.setdefault(r.doc_id, []).extend((k, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for k, s in enumerate(range(0, len(ids), capacity)))
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    return len(by_seq), sum(r.length for r in got)


def test_packing(docs, odd_docs, no_docs):
    check_packing(odd_docs, odd_docs.select("doc_id", "text").collect())
    assert check_packing(no_docs, []) == (0, 0)
    sequences, ids = check_packing(docs, docs.select("doc_id", "text").collect())
    assert sequences <= -(-ids // 4096) + 2


def test_plan_fills_sequences():
    counts = {4096: 3, 2500: 5, 1596: 5, 100: 400, 1: 96, 4095: 1}
    runs = packing.plan(counts)
    used = np.zeros(int((runs[:, 3] + runs[:, 2]).max()), int)
    for length, _, n, first, offset in runs.tolist():
        assert (used[first : first + n] == offset).all()
        used[first : first + n] += length
    assert used.max() <= 4096 and used.sum() == sum(k * n for k, n in counts.items())
    assert len(used) == -(-int(used.sum()) // 4096)


def test_rows_without_length_lie_in_no_sequence(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, 5)], "doc_id long, length int")
    got = {r.doc_id: (r.sequence_id, r.offset) for r in packing.assign(df, order=["doc_id"], capacity=8).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (0, 0)}
