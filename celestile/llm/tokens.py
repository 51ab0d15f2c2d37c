"""Token ids of whole texts by a public tokenizer, on executors.

The tokenizer drops white space, so the ids of a text are those of its pieces between
spaces, one after another.  Pieces repeat; each worker keeps the ids of CACHE_BYTES of them
(their keys counted), in two generations of which the older one goes.  Texts are split and
their distinct pieces found a chunk at a time by Arrow; ids are put together by numpy.

Unknown pieces are encoded many at a time.  A piece of Latin letters is one word for the
tokenizer, so in a row of such pieces the tokens that end a word tell the pieces apart; with
a full stop or comma behind it it is two, the word and the mark, and only the word is
encoded.  Other pieces have the end-of-text token between them, which is an added token and
so never merges with its neighbours; texts that could hold such a token are encoded whole.
"""

from __future__ import annotations

import os
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

if TYPE_CHECKING:
    from tokenizers import Tokenizer

CACHE_BYTES = 192 << 20
PIECE_BYTES = 48  # of a piece: its key, its end, its slot
ID_BYTES = 5  # of an id, in a pool that is a fifth empty at most
LONG_BYTES = 200  # more of a piece that is longer than a key: its text, its place in a dict
KEY = 15  # bytes of a piece that a key holds
ROW = 400  # pieces in a text that the tokenizer gets
SEPARATOR = "<|endoftext|>"
WORD_END = "</w>"
CHUNK_BYTES = 1 << 22
# Latin letters; not the dotted capital I, whose lower case is two characters
_LATIN = "[A-Za-zªµºÀ-ÖØ-öø-įı-ɏ]"
_LETTERS = f"^{_LATIN}+$"
_LOWER = "^[a-zß-öø-ÿ]+$"  # letters that lower case and NFC leave alone
_MARKED = f"^{_LATIN}+[.,]$"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _held(array: np.ndarray, used: int, more: int) -> np.ndarray:
    """The array, or a copy of what is used of it that has place for more."""
    if used + more <= len(array):
        return array
    out = np.zeros(used + more + used // 4, array.dtype)
    out[:used] = array[:used]
    return out


_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _keys(pieces: pa.StringArray) -> np.ndarray:
    """Two words of each piece: its bytes, with zeros behind them, and their number, KEY + 1 if there are more than KEY."""
    _, offsets, data = pieces.buffers()
    begin = np.frombuffer(offsets, np.int32, len(pieces) + 1, 4 * pieces.offset).astype(np.int64)
    raw = np.zeros(int(begin[-1] - begin[0]) + 16, np.uint8)
    if len(raw) > 16:
        raw[:-16] = np.frombuffer(data, np.uint8, len(raw) - 16, int(begin[0]))
    words = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))  # the eight bytes at each place
    at, sizes = begin[:-1] - begin[0], np.diff(begin)
    out = np.empty((len(pieces), 2), np.uint64)
    out[:, 0] = words[at] & _LOW_BYTES[np.minimum(sizes, 8)]
    out[:, 1] = words[at + 8] & _LOW_BYTES[np.clip(sizes - 8, 0, 7)]
    out[:, 1] |= np.minimum(sizes, KEY + 1).astype(np.uint64) << np.uint64(56)
    return out


def _long(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(keys[:, 1] >> np.uint64(56) > KEY)


class _Generation:
    """Pieces with their ids, one after another in a pool.

    Pieces are numbered as they come.  A table of slots, half of them empty at least, tells the number
    of a key; longer pieces stand in a dict.
    """

    def __init__(self) -> None:
        self.count = self.used = self.bytes = 0
        self.keys = np.zeros((1, 2), np.uint64)
        self.ends = np.zeros(1, np.int64)
        self.pool = np.zeros(0, np.uint32)
        self.slots = np.full(1 << 10, -1, np.int32)
        self.number: dict[str, int] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed ^= keys[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed *= np.uint64(0xFF51AFD7ED558CCD)
        return (mixed >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def _place(self, numbers: np.ndarray) -> None:
        slot = self._slot(self.keys[numbers])
        while len(numbers):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = numbers[free]
            lost = np.flatnonzero(self.slots[slot] != numbers)
            numbers, slot = numbers[lost], (slot[lost] + 1) & (len(self.slots) - 1)

    def find(self, pieces: pa.StringArray, keys: np.ndarray) -> np.ndarray:
        """The pieces' numbers; -1 for those that aren't held."""
        out = np.full(len(keys), -1, np.int64)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            at = self.slots[slot]
            held = at >= 0
            todo, slot, at = todo[held], slot[held], at[held]
            same = (self.keys[at] == keys[todo]).all(1)
            out[todo[same]] = at[same]
            todo, slot = todo[~same], (slot[~same] + 1) & (len(self.slots) - 1)
        far = _long(keys)
        if len(far):
            out[far] = [self.number.get(piece, -1) for piece in pieces.take(pa.array(far)).to_pylist()]
        return out

    def add(self, pieces: pa.StringArray, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Distinct pieces that aren't held."""
        n, used, count = len(keys), self.used, self.count
        if self.keys.shape[0] < count + n:
            self.keys = _held(self.keys.view("V16")[:, 0], count, n).view(np.uint64).reshape(-1, 2)
        self.keys[count : count + n] = keys
        self.ends = _held(self.ends, count + 1, n)
        np.cumsum(sizes, out=self.ends[count + 1 : count + 1 + n])
        self.ends[count + 1 : count + 1 + n] += used
        self.pool = _held(self.pool, used, len(ids))
        self.pool[used : used + len(ids)] = ids
        self.count, self.used = count + n, used + len(ids)
        self.bytes += PIECE_BYTES * n + ID_BYTES * len(ids)
        far = _long(keys)
        if len(far):
            texts = pieces.take(pa.array(far)).to_pylist()
            self.number.update(zip(texts, (far + count).tolist(), strict=True))
            self.bytes += LONG_BYTES * len(far) + sum(map(len, texts))
        new = np.ones(n, bool)
        new[far] = False
        new = (np.flatnonzero(new) + count).astype(np.int32)
        if 2 * self.count > len(self.slots):
            self.slots = np.full(1 << (2 * self.count).bit_length(), -1, np.int32)
            new = np.flatnonzero(self.keys[: self.count, 1] >> np.uint64(56) <= KEY).astype(np.int32)
        self._place(new)

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces in turn, and how many each has."""
        start = self.ends[numbers]
        sizes = self.ends[numbers + 1] - start
        at = np.repeat(start - (np.cumsum(sizes) - sizes), sizes)
        at += np.arange(len(at))
        return self.pool[at], sizes


class Encoder:
    """Text to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(vocabulary)
        # the same model for words that need no more than their bytes
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        letters = "".join(map(chr, [*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]))
        if not np.array_equal(*[t.encode(f"{letters} {letters[::-1]}", add_special_tokens=False).ids for t in (self.tokenizer, self.bare)]):
            self.bare = self.tokenizer
        self.separator = self.tokenizer.token_to_id(SEPARATOR)
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True) + 1, bool)
        for token, number in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.ends_word[number] = token.endswith(WORD_END)
        marks = [self._whole(mark) for mark in ".,"]
        self.marks = tuple(int(ids[0]) for ids in marks) if all(len(ids) == 1 for ids in marks) else None
        self.now, self.older = _Generation(), _Generation()

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    @staticmethod
    def _rows(tokenizer: Tokenizer, groups: list[str]) -> list[np.ndarray]:
        return [np.array(found.ids, np.uint32) for found in tokenizer.encode_batch_fast(groups, add_special_tokens=False)]

    def _learn(self, pieces: pa.StringArray, keys: np.ndarray) -> None:
        """Encode distinct pieces, and hold them."""
        plain = pc.match_substring_regex(pieces, _LETTERS).to_numpy(zero_copy_only=False)
        lower = pc.match_substring_regex(pieces, _LOWER).to_numpy(zero_copy_only=False)
        others = np.flatnonzero(~plain).tolist()
        texts = pieces.to_pylist()
        order: list[list[int] | np.ndarray] = []
        found: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        for tokenizer, own in ((self.bare, np.flatnonzero(lower)), (self.tokenizer, np.flatnonzero(plain & ~lower))):
            parts = [own[i : i + ROW] for i in range(0, len(own), ROW)]
            for part, ids in zip(parts, self._rows(tokenizer, [" ".join([texts[i] for i in part.tolist()]) for part in parts]), strict=True):
                ends = np.flatnonzero(self.ends_word[ids])
                # every piece has a word at least, so an equal number means that all have just one
                if len(ends) != len(part) or ends[-1] != len(ids) - 1:
                    others += part.tolist()
                    continue
                order.append(part)
                found.append(ids)
                sizes.append(np.diff(ends, prepend=-1))
        if self.separator is None:
            for i in others:
                order.append([i])
                found.append(self._whole(texts[i]))
                sizes.append(np.array([len(found[-1])]))
        else:
            parts = [others[i : i + ROW] for i in range(0, len(others), ROW)]
            for part, ids in zip(parts, self._rows(self.tokenizer, [SEPARATOR.join([texts[i] for i in part]) for part in parts]), strict=True):
                ends = np.append(np.flatnonzero(ids == self.separator), len(ids))
                order.append(part)
                found.append(ids[ids != self.separator])
                sizes.append(np.diff(ends, prepend=-1) - 1)
        if order:
            at = np.concatenate(order)
            self.now.add(pieces.take(pa.array(at)), keys[at], np.concatenate(found), np.concatenate(sizes))

    def _fetch(self, pieces: pa.StringArray, keys: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
        """Move those that the older generation holds into that of now; returns the others."""
        before = self.older.find(pieces, keys)
        kept = np.flatnonzero(before >= 0)
        if not len(kept):
            return pieces, keys
        self.now.add(pieces.take(pa.array(kept)), keys[kept], *self.older.ids_of(before[kept]))
        rest = np.flatnonzero(before < 0)
        return pieces.take(pa.array(rest)), keys[rest]

    def _marked(self, pieces: pa.StringArray, keys: np.ndarray) -> None:
        """Hold distinct pieces that are a word of Latin letters and a mark: the word's ids and the mark's."""
        words = pc.utf8_slice_codeunits(pieces, 0, -1).dictionary_encode()
        held = words.dictionary
        ids, sizes = self.now.ids_of(self._numbers(held, False)[words.indices.to_numpy()])
        ends = np.cumsum(sizes + 1) - 1
        out = np.empty(len(ids) + len(sizes), np.uint32)
        of_word = np.ones(len(out), bool)
        of_word[ends] = False
        out[of_word] = ids
        out[ends] = np.where(pc.ends_with(pieces, ".").to_numpy(zero_copy_only=False), *self.marks)
        self.now.add(pieces, keys, out, sizes + 1)

    def _numbers(self, pieces: pa.StringArray, turn: bool = True) -> np.ndarray:
        """Where distinct pieces stand in the generation of now; unknown ones are learned.  turn: it may get old."""
        keys = _keys(pieces)
        found = self.now.find(pieces, keys)
        missing_at = np.flatnonzero(found < 0)
        if not len(missing_at):
            return found
        if turn and self.now.bytes + (PIECE_BYTES + 4 * ID_BYTES) * len(missing_at) > CACHE_BYTES // 2 and self.now.count:
            self.older, self.now = self.now, _Generation()
            missing_at = np.arange(len(pieces))
        missing, missing_keys = pieces.take(pa.array(missing_at)), keys[missing_at]
        rest, rest_keys = self._fetch(missing, missing_keys)
        marked = pc.match_substring_regex(rest, _MARKED).to_numpy(zero_copy_only=False) & (self.marks is not None)
        at = np.flatnonzero(~marked)
        self._learn(rest.take(pa.array(at)), rest_keys[at])
        at = np.flatnonzero(marked)
        if len(at):
            self._marked(rest.take(pa.array(at)), rest_keys[at])
        found[missing_at] = self.now.find(missing, missing_keys)
        return found

    def _chunk(self, raw: list[bytes]) -> list[bytes]:
        """Ids of texts in lower case whose only line breaks are spaces."""
        split = pc.split_pattern(pa.array(raw, pa.string()), " ")
        flat = split.flatten().dictionary_encode()
        numbers = self._numbers(flat.dictionary)
        ids, sizes = self.now.ids_of(numbers[flat.indices.to_numpy()])
        upto = np.concatenate([[0], np.cumsum(sizes)])[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        whole = memoryview(ids.astype("<u4", copy=False).tobytes())
        return [bytes(whole[4 * a : 4 * b]) for a, b in zip(upto, upto[1:], strict=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        held: list[int] = []
        raw: list[bytes] = []
        size = 0

        def flush() -> None:
            nonlocal size
            for i, ids in zip(held, self._chunk(raw) if raw else [], strict=True):
                out[i] = ids
            held.clear()
            raw.clear()
            size = 0

        for i, text in enumerate(texts):
            own = (text or "").encode()
            if b"<|" in own:  # added tokens are found before lower case
                out[i] = self._whole(text).astype("<u4", copy=False).tobytes()
                continue
            held.append(i)
            # lower case as the tokenizer's own, for ASCII
            raw.append(own.lower().replace(b"\n", b" "))
            size += len(own)
            if size >= CHUNK_BYTES:
                flush()
        flush()
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str | None = None) -> Encoder:
    """The worker's encoder of a vocabulary; read once a process."""
    vocabulary = vocabulary or default_vocabulary()
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def forget() -> None:
    """Drop the worker's encoders, and what they keep."""
    _ENCODERS.clear()
