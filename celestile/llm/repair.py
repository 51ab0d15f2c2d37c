"""Re-Pair grammar compression of id sequences.

Frequent adjacent pairs of a shard are replaced by nonterminals until no pair occurs LEAST times or more.
A round counts the pairs, ranks the frequent ones by their counts, and gives each place to the
pair with the best rank: an occurrence is replaced unless it overlaps with one of a better
rank.  Pairs of which fewer than LEAST occurrences remain wait for the next round, which counts
anew.  In a run of one id, every other place counts as an occurrence of the pair of equal ids.

Symbols form a linked list, so a round touches frequent places only: a pair that was once too rare
stays so, as new pairs always hold a symbol of the last round.  A rule names two earlier
symbols; rules carry the length of their expansion, so that any place of the text is found
without expanding what stands before it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEAST = 16
HASH_BITS = 17
HASHED = 1 << 14  # so many places are told apart by a hash of their pairs


@dataclass
class Grammar:
    """first_rule: the first nonterminal; left, right, span: of the rules; body: symbols."""

    first_rule: int
    left: np.ndarray
    right: np.ndarray
    span: np.ndarray
    body: np.ndarray


def _sorted_pairs(left: np.ndarray, right: np.ndarray, symbols: int) -> np.ndarray:
    """The number of each place's pair."""
    bits = int(symbols - 1).bit_length()
    index_bits = int(len(left)).bit_length()
    key = (left.astype(np.int64) << bits) | right
    if 2 * bits + index_bits <= 63:
        key = np.sort((key << index_bits) | np.arange(len(key)))
        order = key & ((1 << index_bits) - 1)
        key >>= index_bits
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    group = np.empty(len(key), np.int64)
    group[order] = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
    return group


def _hashed_pairs(left: np.ndarray, right: np.ndarray, symbols: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The places whose pair may occur ``least`` times, and the number of each one's pair.

    A pair has its hash as number; of pairs of one hash, one has it and the others are sorted.
    """
    slot = left * np.uint32(0x9E3779B1)
    slot ^= right * np.uint32(0x85EBCA77)
    slot >>= np.uint32(32 - HASH_BITS)
    slot = slot.view(np.int32)
    may = np.flatnonzero((np.bincount(slot, minlength=1 << HASH_BITS) >= least).take(slot))
    left, right, slot = left.take(may), right.take(may), slot.take(may)
    example = np.zeros(1 << HASH_BITS, np.int32)
    example[slot] = np.arange(len(slot), dtype=np.int32)
    example = example.take(slot)
    other = np.flatnonzero((left.take(example) != left) | (right.take(example) != right))
    if len(other):
        slot[other] = (1 << HASH_BITS) + _sorted_pairs(left.take(other), right.take(other), symbols)
    return may, slot


def _every_other(at: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Of ascending places of pairs of equal symbols: whether it is the first, third, ... of its run."""
    if not len(at):
        return np.zeros(0, bool)
    begins = np.concatenate([[True], before[at[1:]] != at[:-1]])
    number = np.arange(len(at))
    return (number - number[begins][np.cumsum(begins) - 1]) % 2 == 0


def compress(ids: np.ndarray, first_rule: int, least: int = LEAST) -> Grammar:
    """ids: unsigned, all below first_rule.  A pair is frequent if it occurs ``least`` (2 or more) times."""
    n = len(ids)
    none = np.zeros(0, np.uint32)
    if n < 2 * least:
        return Grammar(first_rule, none, none, np.zeros(0, np.int64), ids.astype(np.uint32))
    # place 0 and the last one stand for the ends of the list
    symbol = np.zeros(n + 2, np.uint32)
    symbol[1:-1] = ids
    after = np.arange(1, n + 3)
    before = np.arange(-1, n + 1)
    alive = np.ones(n + 2, bool)
    alive[[0, -1]] = False
    worst = np.iinfo(np.int32).max
    rank = np.full(n + 2, worst, np.int32)
    lefts, rights, spans = [], [], [np.ones(first_rule, np.int64)]
    free = first_rule
    at, a, b = np.arange(1, n), symbol[1:n], symbol[2 : n + 1]
    while True:
        if not len(at):
            break
        if len(at) > HASHED:
            may, group = _hashed_pairs(a, b, free, least)
            at, a, b = at.take(may), a.take(may), b.take(may)
        else:
            group = _sorted_pairs(a, b, free)
        counts = np.ones(len(at), bool)
        twin = np.flatnonzero(a == b)
        counts[twin] = _every_other(at[twin], before)
        size = np.bincount(group[counts] if len(twin) else group, minlength=int(group.max(initial=0)) + 1)
        frequent = np.flatnonzero(size >= least)
        if not len(frequent):
            break
        frequent = frequent[np.argsort(-size[frequent], kind="stable")]
        rank_of = np.full(len(size), worst, np.int32)
        rank_of[frequent] = np.arange(len(frequent))
        own = rank_of.take(group)
        stay = np.flatnonzero(own < worst)
        at, own, counts = at.take(stay), own.take(stay), counts.take(stay)
        # each place goes to the best rank: those better than both neighbours, then among what is left
        todo, of = at[counts], own[counts]
        rank[todo] = of
        taken, taken_rank = [], []
        while len(todo):
            best = (of < rank.take(before.take(todo))) & (of < rank.take(after.take(todo)))
            won = todo[best]
            taken.append(won)
            taken_rank.append(of[best])
            for place in (won, before.take(won), after.take(won)):
                rank[place] = worst
            of = rank.take(todo)
            left = np.flatnonzero(of < worst)
            todo, of = todo.take(left), of.take(left)
        hit, rule = np.concatenate(taken), np.concatenate(taken_rank)
        used = np.bincount(rule, minlength=len(frequent)) >= least
        keep = used[rule]
        hit, rule = hit[keep], (np.cumsum(used) - 1)[rule[keep]]
        example = np.empty(int(used.sum()), np.int64)
        example[rule] = hit
        lefts.append(symbol[example])
        rights.append(symbol[after[example]])
        span = spans[0] if len(spans) == 1 else np.concatenate(spans)
        spans = [span, span[lefts[-1]] + span[rights[-1]]]
        gone = after[hit]
        follows = after[gone]
        symbol[hit] = (free + rule).astype(np.uint32)
        alive[gone] = False
        after[hit] = follows
        before[follows] = hit
        free += len(example)
        again = np.zeros(n + 2, bool)
        again[at] = True
        again[hit] = True
        again[before[hit]] = True
        again &= alive
        again[before[-1]] = False
        at = np.flatnonzero(again)
        a, b = symbol.take(at), symbol.take(after.take(at))
    span = np.concatenate(spans)[first_rule:]
    return Grammar(first_rule, np.concatenate(lefts) if lefts else none, np.concatenate(rights) if rights else none, span, symbol[alive])


def lengths(grammar: Grammar) -> np.ndarray:
    """How many ids each symbol of the body stands for."""
    out = np.ones(len(grammar.body), np.int64)
    rule = grammar.body >= grammar.first_rule
    out[rule] = grammar.span[grammar.body[rule] - grammar.first_rule]
    return out


def _expansions(grammar: Grammar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of every symbol, one after another, with each symbol's place and length there."""
    first = grammar.first_rule
    size = np.concatenate([np.ones(first, np.int64), grammar.span])
    place = np.cumsum(size) - size
    ids = np.empty(int(size.sum()), np.uint32)
    ids[:first] = np.arange(first, dtype=np.uint32)
    parts = np.stack([grammar.left, grammar.right], 1).astype(np.int64)
    latest = parts.max(1, initial=0) - first
    start = 0
    while start < len(parts):
        # rules up to the next that names one of these
        waits = latest[start:] >= start
        end = start + (int(waits.argmax()) if waits.any() else len(waits))
        part = parts[start:end].ravel()
        ids[place[first + start] : place[first + end - 1] + size[first + end - 1]] = ids[_spread(place[part], size[part])]
        start = end
    return ids, place, size


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after another."""
    at = np.repeat(start - (np.cumsum(size) - size), size)
    at += np.arange(len(at))
    return at


def expand(grammar: Grammar, symbols: np.ndarray | None = None) -> np.ndarray:
    """The ids of symbols, or of the whole body."""
    symbols = grammar.body if symbols is None else symbols
    ids, place, size = _expansions(grammar)
    return ids[_spread(place[symbols], size[symbols])]


def read(grammar: Grammar, start: int, length: int) -> np.ndarray:
    """The ids at start .. start + length; expands only the symbols that cover them."""
    ends = np.cumsum(lengths(grammar))
    first = int(np.searchsorted(ends, start, "right"))
    last = int(np.searchsorted(ends, start + length, "left"))
    before = int(ends[first - 1]) if first else 0
    return expand(grammar, grammar.body[first : last + 1])[start - before : start - before + length]


def _packed(x: np.ndarray) -> bytes:
    """Width in bytes of an item, then the items."""
    width = 2 if not len(x) or int(x.max()) < 1 << 16 else 4 if int(x.max()) < 1 << 32 else 8
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1)


def dump(grammar: Grammar) -> dict[str, bytes | int]:
    return {"first_rule": grammar.first_rule, "rule_left": _packed(grammar.left), "rule_right": _packed(grammar.right), "rule_span": _packed(grammar.span), "body": _packed(grammar.body)}


def load(row: dict) -> Grammar:
    return Grammar(row["first_rule"], _unpacked(row["rule_left"]).astype(np.uint32), _unpacked(row["rule_right"]).astype(np.uint32), _unpacked(row["rule_span"]).astype(np.int64), _unpacked(row["body"]).astype(np.uint32))
