"""Class-based bigram language model: Brown classes of all words by the exchange algorithm.

The corpus is first written as blocks of about a million tokens: the distinct words of a
block, sorted by a hash, with their training counts, and its texts as numbers of these words.
Words are dealt by their hash to parts, which gather what all blocks know of a word and answer
each block; between blocks and parts a word moves once a block and sweep, as a few
bytes of an array, not as a row.

Exchange clustering moves every word of the training texts:

* it starts from the CORE most frequent words, exchanged on the driver until none moves,
  while all other words lie together in one class;
* then come SWEEPS distributed sweeps: blocks count for each word the classes before and after
  it, parts sum these sparse counts over all blocks and move each word to the class that raises
  the likelihood of the class bigrams most.  Words move at the same time, against one table of
  class bigrams; a sweep that lowers the likelihood is taken back.

What a word's removal changes between its old class and another one is left out of the gain; its
own bigrams in the old class, the diagonal and the sums are exact.

A text's probability is the product of P(class | class before) and P(word | class).  A
word has its share of its class.  Words unseen in training have a class of their own: the words seen
once stand for it, before and after each class, and transitions are smoothed by
the distribution of classes (Dirichlet prior PRIOR).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, save, tidy

CORE = 512
CLASSES = 64
REST, END, UNSEEN = CLASSES - 2, CLASSES - 1, CLASSES
PRIOR = 20.0
CORE_SWEEPS = 12
SWEEPS = 2
BLOCK_TOKENS = 1 << 20
BLOCKS_A_PART = 2
BLOCKS = "block long, doc_ids array<bigint>, sizes array<int>, held_out array<boolean>, words binary, counts binary, tokens binary"
STATE = "block long, part int, numbers binary, counts binary, classes binary"
SELF = 2 * CLASSES
CODES = SELF + 1
SMALL = 16  # gains of counts below it are looked up
WORDS_AT_ONCE = 1 << 15


def _is_held_out(doc_id: int | None, parts: int, part: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts == part


def _planes(x: np.ndarray) -> bytes:
    """The lowest bytes of all items, then the next, and so on, as far as any is needed: they compress well."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _plain(planes: bytes) -> np.ndarray:
    own = np.frombuffer(planes, np.uint8, offset=1).reshape(planes[0], -1)
    out = own[0].astype(np.int64)
    for k in range(1, len(own)):
        out |= own[k].astype(np.int64) << 8 * k
    return out


def _split(words: bytes) -> list[bytes]:
    return words.split(b" ") if words else []


def _records(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def _block(batches: Iterator[pa.RecordBatch], parts: int, part: int) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 32
    number: dict[bytes, int] = {}
    ids: list[int] = []
    sizes: list[int] = []
    out: list[bool] = []
    chunks: list[np.ndarray] = []
    held = done = 0

    def close() -> pa.RecordBatch:
        nonlocal done, held
        tokens = np.concatenate(chunks)
        words = list(number)
        order = np.argsort(np.fromiter(map(zlib.crc32, words), np.uint32, len(words)), kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        tokens = place[tokens] if len(words) else tokens.astype(np.int64)
        train = np.repeat(~np.array(out, bool), sizes)
        counts = np.bincount(tokens[train], minlength=len(words))
        row = (first + done, list(ids), list(sizes), list(out), b" ".join([words[i] for i in order.tolist()]), _planes(counts), _planes(tokens))
        done, held = done + 1, 0
        for x in (number, ids, sizes, out, chunks):
            x.clear()
        return _records([row], BLOCKS)

    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
            try:
                tokens = [number[w] for w in words]
            except KeyError:
                tokens = [number.setdefault(w, len(number)) for w in words]
            ids.append(doc.as_py())
            sizes.append(len(tokens))
            out.append(_is_held_out(ids[-1], parts, part))
            chunks.append(np.array(tokens, np.uint32))
            held += len(tokens)
            if held >= BLOCK_TOKENS:
                yield close()
    if ids:
        yield close()


ASKED = "part int, block long, words binary, counts binary"


def _ask(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The words of each block for each part, with their counts there."""
    for batch in batches:
        for row in range(batch.num_rows):
            block, words, counts = batch.column(0)[row].as_py(), _split(batch.column(1)[row].as_py()), _plain(batch.column(2)[row].as_py())
            part = (np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) * np.uint64(parts)) >> np.uint64(32)
            cuts = np.searchsorted(part, np.arange(parts + 1)).tolist()
            yield _records([(p, block, b" ".join(words[a:b]), _planes(counts[a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b], ASKED)


NUMBERED = f"{STATE}, top binary, top_counts binary, types long, once long"


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each part, which stand together."""
    part, held = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if row["part"] != part:
                if held:
                    yield part, held
                part, held = row["part"], []
            held.append(row)
    if held:
        yield part, held


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the words of a part and answers each block with them and the counts of all blocks; then one row on the part."""
    for part, rows in _by_part(batches):
        number: dict[bytes, int] = {}
        own, counts = [], []
        for r in rows:
            own.append(np.array([number.setdefault(w, len(number)) for w in _split(r["words"])], np.int64))
            counts.append(_plain(r["counts"]))
            del r["words"], r["counts"]
        total = np.zeros(len(number), np.int64)
        for n, c in zip(own, counts, strict=True):
            total[n] += c
        for k, (r, n) in enumerate(zip(rows, own, strict=True)):
            own[k] = None
            c = total[n]
            yield _records([(r["block"], part, _planes(n), _planes(c), np.where(c > 0, REST, UNSEEN).astype(np.uint8).tobytes(), None, None, 0, 0)], NUMBERED)
        words = list(number)
        top = sorted((-int(total[i]), words[i]) for i in np.flatnonzero(total >= max(1, _nth(total, CORE))).tolist())[:CORE]
        yield _records([(None, part, None, None, None, b" ".join(w for _, w in top), _planes(np.array([-c for c, _ in top], np.int64)), int((total > 0).sum()), int((total == 1).sum()))], NUMBERED)


def _nth(x: np.ndarray, n: int) -> int:
    """The n-th largest."""
    return int(np.partition(x, len(x) - n)[len(x) - n]) if len(x) > n else 0


def _sequence(tokens: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts with an end after each, and the text each belongs to."""
    doc = np.repeat(np.arange(len(sizes)), sizes + 1)
    out = np.full(len(doc), end, np.int64)
    inner = np.ones(len(doc), bool)
    inner[np.cumsum(sizes + 1) - 1] = False
    out[inner] = tokens
    return out, doc


def _array(scalar: pa.Scalar, kind: type) -> np.ndarray:
    return scalar.values.to_numpy(zero_copy_only=False).astype(kind)


def _training(sizes: pa.Scalar, held: pa.Scalar, tokens: pa.Scalar, end: int) -> np.ndarray:
    """The training texts of a block, each with an end."""
    n, out = _array(sizes, np.int64), _array(held, bool)
    return _sequence(_plain(tokens.as_py())[np.repeat(~out, n)], n[~out], end)[0]


PAIRS = "pair int, n long"


def _pairs(total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["pair", "n"])


def _summed(pairs: DataFrame, side: int) -> np.ndarray:
    """A table of side x side bigrams, summed."""
    table = np.zeros(side * side)
    found = pairs.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table[found["pair"].to_numpy()] = found["n"].to_numpy()
    return table.reshape(side, side)


def _core_bigrams(batches: Iterator[pa.RecordBatch], core: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Of the core's words, all others as one, and the end."""
    side = len(core) + 2
    total = np.zeros(side * side, np.int64)
    for batch in batches:
        for row in range(batch.num_rows):
            sizes, held, words, tokens = (batch.column(i)[row] for i in range(4))
            own = _split(words.as_py())
            symbol = np.fromiter((core.get(w, side - 2) for w in own), np.int64, len(own))
            now = np.append(symbol, side - 1)[_training(sizes, held, tokens, len(own))]
            total += np.bincount(np.roll(now, 1) * side + now, minlength=side * side)
    yield _pairs(total)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def _gain(table: np.ndarray, rows: np.ndarray, cols: np.ndarray, a: np.ndarray, b: np.ndarray, self_n: float, out: float, into: float) -> np.ndarray:
    """What each class adds to the likelihood by taking up a symbol that is in none, with a bigrams to and b from the classes."""
    gain = (_xlogx(table + a[None, :]) - _xlogx(table)).sum(1) + (_xlogx(table + b[:, None]) - _xlogx(table)).sum(0)
    d = table.diagonal()
    gain += _xlogx(d + a + b + self_n) + _xlogx(d) - _xlogx(d + a) - _xlogx(d + b)
    gain -= _xlogx(rows + out) - _xlogx(rows) + _xlogx(cols + into) - _xlogx(cols)
    gain[-2:] = -np.inf
    return gain


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = CORE_SWEEPS) -> np.ndarray:
    """The class of each symbol.  The last two symbols, all other words and the end, are alone in the last two classes.

    Start: symbols in turn by frequency.  Each symbol moves to the class that raises the
    likelihood of the class bigrams most, until a sweep moves none.
    """
    n = len(bigrams)
    out, into = bigrams.sum(1), bigrams.sum(0)
    of = np.concatenate([np.zeros(n - 2, np.int64), [classes - 2, classes - 1]])
    order = np.argsort(-(out + into)[: n - 2], kind="stable")
    of[order] = np.arange(n - 2) % (classes - 2)
    member = np.zeros((n, classes))
    member[np.arange(n), of] = 1
    table = member.T @ bigrams @ member
    rows, cols = table.sum(1), table.sum(0)
    to, fro = bigrams @ member, bigrams.T @ member
    for _ in range(sweeps):
        moved = 0
        for w in order.tolist():
            if not out[w] and not into[w]:
                continue
            old, self_n = of[w], bigrams[w, w]
            a, b = to[w].copy(), fro[w].copy()
            a[old] -= self_n
            b[old] -= self_n
            table[old] -= a
            table[:, old] -= b
            table[old, old] -= self_n
            rows[old] -= out[w]
            cols[old] -= into[w]
            gain = _gain(table, rows, cols, a, b, self_n, out[w], into[w])
            new = int(gain.argmax()) if gain.max() > gain[old] + 1e-9 else old
            table[new] += a
            table[:, new] += b
            table[new, new] += self_n
            rows[new] += out[w]
            cols[new] += into[w]
            if new != old:
                of[w] = new
                to[:, old] -= bigrams[:, w]
                to[:, new] += bigrams[:, w]
                fro[:, old] -= bigrams[w]
                fro[:, new] += bigrams[w]
                moved += 1
        if not moved:
            break
    return of


MESSAGES = "part int, block long, numbers binary, counts binary, classes binary, lengths binary, codes binary, n binary, pairs array<int>, pair_n array<bigint>"


def _join_state(state: pa.Scalar) -> list[dict]:
    return sorted(state.as_py() or [], key=lambda r: r["part"])


def _classes(state: list[dict]) -> np.ndarray:
    """The class of each word of a block."""
    return np.frombuffer(b"".join(r["classes"] for r in state), np.uint8)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block and part its state and, of each word, the classes before (code), after (CLASSES + code) it and
    how often it follows itself (SELF); then one row with the class bigrams of the task."""
    total = np.zeros(CLASSES * CLASSES, np.int64)
    for batch in batches:
        for row in range(batch.num_rows):
            block, sizes, held, tokens = (batch.column(i)[row] for i in range(4))
            state = _join_state(batch.column(4)[row])
            cls = np.append(_classes(state), np.uint8(END))
            end = len(cls) - 1
            now = _training(sizes, held, tokens, end)
            before, after = np.roll(now, 1), np.roll(now, -1)
            k = cls[now].astype(np.int64)
            total += np.bincount(np.roll(k, 1) * CLASSES + k, minlength=CLASSES * CLASSES)
            kind = np.uint32 if end < 1 << 24 else np.uint64
            word = now.astype(kind) * kind(256)
            inner = now != end
            a, b = inner & (after != now), inner & (before != now)
            key = np.sort(np.concatenate([word[b] + cls[before[b]], word[a] + (cls[after[a]] + kind(CLASSES)), word[inner & (before == now)] + kind(SELF)]))
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            n = np.diff(first, append=len(key))
            key = key[first]
            codes = (key & kind(255)).astype(np.uint8)
            length = np.bincount((key >> kind(8)).astype(np.int64), minlength=end)
            upto = np.concatenate([[0], np.cumsum(length)])
            rows, at = [], 0
            for r in state:
                words = len(r["classes"])
                x, y = int(upto[at]), int(upto[at + words])
                rows.append((r["part"], block.as_py(), r["numbers"], r["counts"], r["classes"], _planes(length[at : at + words]), codes[x:y].tobytes(), _planes(n[x:y]), None, None))
                at += words
            yield _records(rows, MESSAGES)
    at = np.flatnonzero(total)
    yield _records([(-1, None, None, None, None, None, None, None, at.tolist(), total[at].tolist())], MESSAGES)


class Gains:
    """What words add to the likelihood of class bigrams (table) by lying in each class."""

    def __init__(self, table: np.ndarray):
        self.table, self.rows, self.cols = table, table.sum(1), table.sum(0)
        self.wide = np.concatenate([table.T, table], 1)  # [k, code]: bigrams of what stands before and k, of k and what stands after
        n = np.arange(SMALL)[:, None, None]
        self.more = (_xlogx(self.wide.T[None] + n) - _xlogx(self.wide.T)[None]).reshape(SMALL * SELF, CLASSES)

    def _sums(self, count: np.ndarray) -> np.ndarray:
        values, at = np.unique(count, return_inverse=True)
        v = values[:, None]
        return (_xlogx(self.rows + v) - _xlogx(self.rows) + _xlogx(self.cols + v) - _xlogx(self.cols))[at]

    def best(self, near: np.ndarray, count: np.ndarray, old: np.ndarray) -> np.ndarray:
        """The best class of each word; near: how often it has each code, count: how often it occurs."""
        words = np.arange(len(near))
        flat = np.flatnonzero(near[:, :SELF])
        word, code = np.divmod(flat, SELF)
        n = near[word, code]
        gain = np.zeros((len(near), CLASSES))
        for i in range(0, len(word), 1 << 13):
            w, c, m = (x[i : i + (1 << 13)] for x in (word, code, n))
            vectors = self.more.take(np.minimum(m, SMALL - 1) * SELF + c, 0)
            big = np.flatnonzero(m >= SMALL)
            if len(big):
                own = self.wide.T[c[big]]
                vectors[big] = _xlogx(own + m[big, None]) - _xlogx(own)
            first = np.flatnonzero(np.diff(w, prepend=-1))
            gain[w[first]] += np.add.reduceat(vectors, first, axis=0)
        before, after, twice = near[:, :CLASSES], near[:, CLASSES:SELF], near[:, SELF]
        # the bigrams within a class hold what stands before, after and the word twice
        mixed = np.flatnonzero((twice > 0) | ((before > 0) & (after > 0)).any(1))
        d = self.table.diagonal()
        for i in range(0, len(mixed), 4096):
            at = mixed[i : i + 4096]
            a, b = after[at], before[at]
            gain[at] += _xlogx(d + a + b + twice[at, None]) + _xlogx(d) - _xlogx(d + a) - _xlogx(d + b)
        gain -= self._sums(count)
        # where it lies, the table has its bigrams already
        own = self.wide[old[word], code]
        same = (code % CLASSES) == old[word]
        stay = np.bincount(word, np.where(same, 0.0, _xlogx(own) - _xlogx(own - n)), len(near))
        inside = after[words, old] + before[words, old] + twice
        stay += _xlogx(d[old]) - _xlogx(d[old] - inside)
        stay -= _xlogx(self.rows[old]) - _xlogx(self.rows[old] - count) + _xlogx(self.cols[old]) - _xlogx(self.cols[old] - count)
        gain[words, old] = stay
        gain[:, END] = -np.inf
        new = (gain >= gain.max(1, keepdims=True) - 1e-6).argmax(1)
        return np.where(gain[words, new] > stay + 2e-6, new, old)


def _move(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The state of each block and part after each word has moved."""
    gains = Gains(table)
    for part, rows in _by_part(batches):
        numbers = [_plain(r["numbers"]) for r in rows]
        size = 1 + max((int(n.max(initial=-1)) for n in numbers), default=-1)
        count, old = np.zeros(size, np.int64), np.full(size, UNSEEN, np.uint8)
        entries = []
        for r, n in zip(rows, numbers, strict=True):
            count[n] = _plain(r["counts"])
            old[n] = np.frombuffer(r["classes"], np.uint8)
            entries.append((np.repeat(n, _plain(r["lengths"])), np.frombuffer(r["codes"], np.uint8), _plain(r["n"])))
            del r["lengths"], r["codes"], r["n"]
        new = old.copy()
        for low in range(0, size, WORDS_AT_ONCE):
            high = min(size, low + WORDS_AT_ONCE)
            near = np.zeros((high - low) * CODES, np.int64)
            for w, c, n in entries:
                at = np.flatnonzero((w >= low) & (w < high)) if size > WORDS_AT_ONCE else slice(None)
                # a block has each word and code once
                near[(w[at] - low) * CODES + c[at]] += n[at]
            known = np.flatnonzero(count[low:high])
            new[low + known] = gains.best(near.reshape(-1, CODES)[known], count[low + known], old[low + known].astype(np.int64))
        yield _records([(r["block"], part, r["numbers"], r["counts"], new[n].tobytes()) for r, n in zip(rows, numbers, strict=True)], STATE)


@dataclass
class Model:
    """move: log10 P(class | class before) with the class of unseen words; size: training tokens of each class; of tokens, types and texts in training."""

    move: np.ndarray
    size: np.ndarray
    tokens: int
    types: int
    texts: int

    def emission(self, count: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 P(word | class); unseen words are one to their class."""
        return np.where(count > 0, np.log10(np.maximum(count, 1) / np.maximum(np.append(self.size, 1)[cls], 1)), 0.0)


def _moves(table: np.ndarray) -> np.ndarray:
    share = (table.sum(0) + 1) / (table.sum() + len(table))
    return np.log10((table + PRIOR * share[None, :]) / (table.sum(1)[:, None] + PRIOR))


def likelihood(table: np.ndarray) -> float:
    """Of class bigrams, up to what no move changes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(1)).sum() - _xlogx(table.sum(0)).sum())


def _met(row: tuple[pa.Scalar, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The class and count of each word of a block."""
    state = _join_state(row)
    counts = [_plain(r["counts"]) for r in state]
    return _classes(state).astype(np.int64), np.concatenate(counts) if counts else np.zeros(0, np.int64)


def _final_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class bigrams; words seen once count in the class of unseen words, too."""
    side = CLASSES + 1
    total = np.zeros(side * side, np.int64)
    for batch in batches:
        for row in range(batch.num_rows):
            sizes, held, tokens = (batch.column(i)[row] for i in range(3))
            cls, count = _met(batch.column(3)[row])
            now = _training(sizes, held, tokens, len(cls))
            plain = np.append(cls, END)[now]
            new = np.append(np.where(count == 1, UNSEEN, -1), -1)[now]
            for left, right in ((plain, plain), (plain, new), (new, plain), (new, new)):
                left = np.roll(left, 1)
                both = (left >= 0) & (right >= 0)
                total += np.bincount(left[both] * side + right[both], minlength=side * side)
    yield _pairs(total)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    log_all = np.log10(model.tokens + model.types + 1)
    for batch in batches:
        for row in range(batch.num_rows):
            held, sizes, tokens, ids = (batch.column(i)[row] for i in (1, 0, 2, 4))
            n = _array(sizes, np.int64)
            cls, count = _met(batch.column(3)[row])
            cls, count = np.append(cls, END), np.append(count, model.texts)
            emission = model.emission(count, cls)
            emission[-1] = 0.0
            base = np.log10(count + 1) - log_all
            now, doc = _sequence(_plain(tokens.as_py()), n, len(cls) - 1)
            k = cls[now]
            before = np.roll(k, 1)
            total = lambda x, doc=doc, n=len(n): np.bincount(doc, x, n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids.values.to_pylist(), pa.int64()), pa.array(held.values.to_pylist(), pa.bool_()), pa.array(n + 1), pa.array(total(count[now] > 0).astype(np.int64)),
                    pa.array(np.full(len(n), model.tokens, np.int64)), pa.array(total(base[now])), pa.array(total(model.move[before, k] + emission[now])),
                ],
                names=[c.split()[0] for c in SCORED.split(", ")],
            )


def _by_word_part(rows: DataFrame) -> DataFrame:
    return rows.repartition("part").sortWithinPartitions("part", "block")


def _with_state(blocks: DataFrame, state: DataFrame) -> DataFrame:
    """blocks with ``state``: what the parts have answered."""
    answers = state.groupBy("block").agg(F.collect_list(F.struct("part", "numbers", "counts", "classes")).alias("state"))
    return blocks.join(answers, "block", "left")


def _core(numbered: DataFrame) -> dict[bytes, int]:
    """The CORE most frequent words; each part names as many at most."""
    best: list[tuple[int, bytes]] = []
    for r in numbered.where("block IS NULL").select("top", "top_counts").toLocalIterator():
        best = sorted(best + [(-c, w) for c, w in zip(_plain(bytes(r["top_counts"])).tolist(), _split(bytes(r["top"])), strict=True)])[:CORE]
    return {w: i for i, (_, w) in enumerate(best)}


def _start(batches: Iterator[pa.RecordBatch], core: dict[bytes, int], of: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The state with the classes of the core's words; words: of the block."""
    for batch in batches:
        for row in range(batch.num_rows):
            block, words, state = batch.column(0)[row].as_py(), _split(batch.column(1)[row].as_py()), _join_state(batch.column(2)[row])
            cls = _classes(state).copy()
            at = np.fromiter((core.get(w, -1) for w in words), np.int64, len(words))
            cls[at >= 0] = of[at[at >= 0]]
            rows, done = [], 0
            for r in state:
                rows.append((block, r["part"], r["numbers"], r["counts"], cls[done : done + len(r["classes"])].tobytes()))
                done += len(r["classes"])
            yield _records(rows, STATE)


def cluster(blocks: DataFrame, sweeps: int = SWEEPS) -> tuple[DataFrame, np.ndarray, int]:
    """The blocks' texts with the counts and classes of their words, the class bigrams, and how many words training has."""
    parts = max(1, -(-blocks.count() // BLOCKS_A_PART))
    asked = blocks.select("block", "words", "counts").mapInArrow(partial(_ask, parts=parts), ASKED)
    numbered = save(_by_word_part(asked).mapInArrow(tidy(_number), NUMBERED), "numbered")
    types = int(numbered.agg(F.sum("types")).first()[0] or 0)
    core = _core(numbered)
    bigrams = _summed(blocks.select("sizes", "held_out", "words", "tokens").mapInArrow(partial(_core_bigrams, core=core), PAIRS), len(core) + 2)
    of = exchange(bigrams)
    names = [c.split()[0] for c in STATE.split(", ")]
    plain = _with_state(blocks.select("block", "words"), numbered.where("block IS NOT NULL").select(*names)).select("block", "words", "state")
    state = save(plain.mapInArrow(partial(_start, core=core, of=of), STATE), "state")
    release(numbered)
    texts = blocks.select("block", "doc_ids", "sizes", "held_out", "tokens")
    former, least = None, -np.inf
    for _ in range(sweeps):
        both = _with_state(texts.drop("doc_ids"), state).select("block", "sizes", "held_out", "tokens", "state")
        near = save(both.mapInArrow(tidy(_near), MESSAGES), "near")
        table = _summed(near.where("part < 0").select(F.explode(F.arrays_zip("pairs", "pair_n")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.pair_n").alias("n")), CLASSES)
        if likelihood(table) < least:
            break
        least = likelihood(table)
        moved = save(_by_word_part(near.where("part >= 0").drop("pairs", "pair_n")).mapInArrow(partial(tidy(_move), table=table), STATE), "state")
        release(near, *([former] if former is not None else []))
        former, state = state, moved
    for choice in (state, former):
        met = save(_with_state(texts, choice).select("sizes", "held_out", "tokens", F.transform("state", lambda r: F.struct(r["part"].alias("part"), r["counts"].alias("counts"), r["classes"].alias("classes"))).alias("state"), "doc_ids"), "met")
        table = _summed(met.mapInArrow(tidy(_final_bigrams), PAIRS), CLASSES + 1)
        if former is None or choice is former or likelihood(table[:CLASSES, :CLASSES]) >= least:
            break
        release(met)
    release(state, *([former] if former is not None else []))
    return met, table, types


def score(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", parts: int = 7, part: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of each row.

    Rows whose crc32(id as text) mod ``parts`` is ``part`` are held out from training;
    a null id counts as the empty text.  Null texts count as empty and have their end
    as only token; texts are read whole, however long.  Repeated rows count and are scored each; ties
    between words go to the smaller bytes, between classes to the smaller number; without training rows every
    token is unseen; an empty table gives an empty one; other columns are not read.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = save(rows.mapInArrow(partial(tidy(_block), parts=parts, part=part), BLOCKS), "blocks")
    met, table, types = cluster(blocks)
    release(blocks)
    plain = table[:CLASSES, :CLASSES]
    texts = int(plain[:, END].sum())
    model = Model(_moves(table), plain.sum(0), int(plain.sum()), types + (texts > 0), texts)
    scored = met.mapInArrow(partial(tidy(_score), model=model), SCORED)
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
