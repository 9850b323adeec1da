"""Suffix arrays of many strings at once, in numpy."""

from __future__ import annotations

import numpy as np

#: Symbols in the first sorting key: 7 symbols of 9 bits (a byte plus one; zero ends a string).
_FIRST = 7


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The parts one after the other as symbols 1 to 256, each closed by a zero, and how far each position is from its zero."""
    sizes = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    text = np.zeros(int(sizes.sum()) + len(parts), np.uint16)
    ends = np.cumsum(sizes + 1) - 1
    body = np.ones(len(text), bool)
    body[ends] = False
    text[body] = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint16) + 1
    rest = np.repeat(ends, sizes + 1) - np.arange(len(text))
    return text, rest.astype(np.int32)


def suffix_array(text: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in suffix order, and each position's rank (Larsson-Sadakane).

    Suffixes are sorted by their first symbols; then, as the sorted depth
    doubles, only groups that are still tied are sorted on, each by the rank of
    the suffix that begins where the known prefix ends. A suffix ends at its own
    string's zero, and equal suffixes are told apart by position, so nothing is
    compared across strings.
    """
    n = len(text)
    key = np.zeros(n, np.int64)
    alive = np.ones(n, bool)
    for k in range(_FIRST):
        symbol = np.zeros(n, np.int64)
        symbol[:max(0, n - k)] = text[k:]
        symbol[~alive] = 0
        key = key * 512 + symbol
        alive &= symbol > 0
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    # A suffix that has ended is done: a group of its own.
    fresh = np.ones(n, bool)
    fresh[1:] = (sorted_key[1:] != sorted_key[:-1]) | (rest[order[1:]] < _FIRST)
    del key, sorted_key, alive
    start = np.flatnonzero(fresh)
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(start, np.diff(np.append(start, n)))
    sizes = np.diff(np.append(start, n))
    tied = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places in the order
    depth = _FIRST
    while len(tied):
        who = order[tied]
        group = rank[who].astype(np.int64)
        ended = rest[who] < depth
        after = np.where(ended, -1, rank[np.minimum(who + depth, n - 1)]).astype(np.int64)
        by = np.argsort(group * (n + 1) + after + 1, kind="stable")
        who, group, after, ended = who[by], group[by], after[by], ended[by]
        order[tied] = who
        fresh = np.ones(len(tied), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1]) | ended[1:]
        start = np.flatnonzero(fresh)
        sizes = np.diff(np.append(start, len(tied)))
        rank[who] = np.repeat(tied[start], sizes)
        tied = tied[np.repeat(sizes > 1, sizes)]
        depth *= 2
    return order, rank


def common_prefixes(text: np.ndarray, rest: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """By position: symbols shared with the suffix before it in the order (Kasai).

    From one position to the next a common prefix loses at most one symbol, and
    exactly one if the symbols before both suffixes agree. So only positions
    where they disagree are compared, all at once; the others count down.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    here = np.arange(n)
    paired = before >= 0
    # Ends are unique, so a suffix that starts with one shares nothing.
    derived = np.zeros(n, bool)
    derived[1:] = paired[1:] & paired[:-1] & (text[:-1] > 0) & (text[:-1] == text[before[:-1]]) & (before[:-1] + 1 == before[1:])
    shared = np.zeros(n, np.int64)
    live = np.flatnonzero(paired & ~derived & (rest > 0))
    at = np.zeros(len(live), np.int64)
    words = _words(text)
    while len(live):
        a, b = live + at, before[live] + at
        x = words[a] ^ words[b]
        room = np.minimum(rest[a], rest[b])
        same = np.where(x == 0, 4, _low_symbols(x))
        step = np.minimum(same, room)
        at += step
        done = step < 4
        shared[live[done]] = at[done]
        live, at = live[~done], at[~done]
    # Count down from the last compared position.
    source = np.maximum.accumulate(np.where(derived, -1, here))
    return np.maximum(shared[source] - (here - source), 0)


def _words(text: np.ndarray) -> np.ndarray:
    """Four symbols from each position on as one number, the first lowest."""
    padded = np.append(text, np.zeros(4, np.uint16)).astype(np.uint64)
    n = len(text)
    return padded[:n] | padded[1:n + 1] << np.uint64(16) | padded[2:n + 2] << np.uint64(32) | padded[3:n + 3] << np.uint64(48)


def _low_symbols(x: np.ndarray) -> np.ndarray:
    """How many of the four lowest symbols are zero (for numbers that are not all zero)."""
    return np.where(x & np.uint64(0xFFFF), 0, np.where(x & np.uint64(0xFFFFFFFF), 1, np.where(x & np.uint64(0xFFFFFFFFFFFF), 2, 3)))


def repeated_starts(parts: list[bytes], length: int) -> np.ndarray:
    """By position of ``joined(parts)``: whether the ``length`` bytes from there also start elsewhere in the parts."""
    text, rest = joined(parts)
    order, rank = suffix_array(text, rest)
    shared = common_prefixes(text, rest, order, rank)
    found = np.zeros(len(text), bool)
    # Shared with the one before; the one before then shares it, too.
    long = np.flatnonzero(shared >= length)
    found[long] = True
    found[order[rank[long] - 1]] = True
    return found
