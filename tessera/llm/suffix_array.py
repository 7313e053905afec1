"""Suffix arrays by induced sorting, a bucket or a suffix at a time, and permuted common prefixes."""

from __future__ import annotations

from array import array

import numpy as np

#: Buckets of fewer suffixes than this on average (names of substrings have such) are induced a suffix at a time, the others a bucket at a time; the order is the same.
SMALL_BUCKET = 64


def classify(s: np.ndarray) -> np.ndarray:
    """True for the suffixes that are smaller than their successor; the last symbol must be the least and unique."""
    n = len(s)
    last = np.append(np.flatnonzero(s[1:] != s[:-1]), n - 1)  # ends of runs of one symbol
    up = np.append(s[last[:-1]] < s[last[:-1] + 1], True)
    return np.repeat(up, np.diff(np.concatenate([[-1], last])))


def leftmost_smaller(small: np.ndarray) -> np.ndarray:
    """The places whose suffix is of the smaller kind and whose predecessor's is not."""
    return np.flatnonzero(small[1:] & ~small[:-1]) + 1


def _place(sa: np.ndarray, slot: np.ndarray, where: np.ndarray, symbols: np.ndarray, step: int) -> None:
    """Puts the suffixes ``where`` next in their symbols' buckets, in order; ``slot`` has each bucket's next free place."""
    order = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[order]
    edge = np.flatnonzero(np.append(True, sorted_symbols[1:] != sorted_symbols[:-1]))
    many = np.diff(np.append(edge, len(order)))
    rank = np.arange(len(order)) - np.repeat(edge, many)
    sa[slot[sorted_symbols] + step * rank] = where[order]
    slot[sorted_symbols[edge]] += step * many


def induce(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix array that the leftmost-smaller suffixes ``seeds``, in the order given, induce in two scans."""
    n = len(s)
    size = np.bincount(s, minlength=symbols)
    end = np.cumsum(size)
    begin = end - size
    seed_symbol = s[seeds]
    order = np.argsort(seed_symbol, kind="stable")
    sorted_seeds = seeds[order]
    cut = np.searchsorted(seed_symbol[order], np.arange(symbols + 1))
    sa = np.full(n, -1, np.int64)
    used = np.flatnonzero(size)
    # scan upwards: each suffix puts its predecessor, if that is larger than it, at the front of its bucket
    front = begin.copy()
    for c in used:
        done = begin[c]
        while True:
            if done < front[c]:
                now, done = sa[done : front[c]], front[c]
                seeded = False
            else:
                now, seeded = sorted_seeds[cut[c] : cut[c + 1]], True
            before = now[now > 0] - 1
            before = before[~small[before]]
            if len(before):
                _place(sa, front, before, s[before], 1)
            if seeded:
                break
    large = front - begin  # suffixes larger than their successor, by bucket
    # scan downwards: the same for predecessors that are smaller, from the buckets' ends
    back = end - 1
    for c in used[::-1]:
        done = end[c] - 1
        last = begin[c] + large[c] - 1
        while True:
            if done > back[c]:
                now, done = sa[back[c] + 1 : done + 1][::-1], back[c]
                rest = False
            else:
                now, rest = sa[begin[c] : last + 1][::-1], True
            before = now[now > 0] - 1
            before = before[small[before]]
            if len(before):
                _place(sa, back, before, s[before], -1)
            if rest:
                break
    # the least and last symbol has no successor that could have put it
    sa[0] = n - 1
    return sa


def induce_singly(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, symbols: int) -> np.ndarray:
    """What ``induce`` gives, by scans that look at one suffix after the other."""
    size = np.bincount(s, minlength=symbols)
    end = np.cumsum(size)
    text, up = array("q", s.astype(np.int64).tobytes()), small.tobytes()
    sa = array("q", np.full(len(s), -1, np.int64).tobytes())
    back = end.tolist()
    for p in seeds[::-1].tolist():
        c = text[p]
        back[c] -= 1
        sa[back[c]] = p
    front = (end - size).tolist()
    for i in range(len(sa)):
        p = sa[i] - 1
        if p >= 0 and not up[p]:
            c = text[p]
            sa[front[c]] = p
            front[c] += 1
    back = end.tolist()
    for i in range(len(sa) - 1, -1, -1):
        p = sa[i] - 1
        if p >= 0 and up[p]:
            c = text[p]
            back[c] -= 1
            sa[back[c]] = p
    return np.frombuffer(sa, np.int64)


def _same_substrings(s: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each but the first of the substrings (in their sorted order), whether it equals the one before."""
    same = size[1:] == size[:-1]
    pairs = np.flatnonzero(same)
    many = size[1:][pairs]
    if len(pairs):
        edge = np.cumsum(many) - many
        inner = np.arange(int(many.sum())) - np.repeat(edge, many)
        differ = s[np.repeat(at[:-1][pairs], many) + inner] != s[np.repeat(at[1:][pairs], many) + inner]
        same[pairs] = ~np.logical_or.reduceat(differ, edge)
    return same


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The places of the suffixes of ``s`` in order; the last symbol must be 0 and no other may be.

    >>> suffix_array(np.array([2, 1, 3, 1, 3, 1, 0])).tolist()
    [6, 5, 3, 1, 0, 4, 2]
    """
    if len(s) < 2:
        return np.arange(len(s))
    symbols = int(s.max()) + 1
    sort = induce if len(s) >= SMALL_BUCKET * symbols else induce_singly
    small = classify(s)
    lms = leftmost_smaller(small)
    if len(lms) > 1:
        sa = sort(s, small, lms, symbols)
        is_lms = np.zeros(len(s), bool)
        is_lms[lms] = True
        by_substring = sa[is_lms[sa]]
        length = np.zeros(len(s), np.int64)
        length[lms] = np.append(np.diff(lms) + 1, 1)
        name = np.concatenate([[0], np.cumsum(~_same_substrings(s, by_substring, length[by_substring]))])
        if name[-1] + 1 < len(lms):
            named = np.empty(len(s), np.int64)
            named[by_substring] = name
            lms = lms[suffix_array(named[lms])]
        else:
            lms = by_substring
    return sort(s, small, lms, symbols)


def permuted_common_prefixes(data: np.ndarray, sa: np.ndarray, limit: int) -> np.ndarray:
    """By place in the text: how many bytes a suffix shares with the one before it in the suffix array, up to ``limit``.

    ``data`` must go on for ``limit`` + 8 bytes after the last place in ``sa``.
    """
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int64)
    wide = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    at = np.flatnonzero(before >= 0)
    other = before[at]
    for k in range(0, limit, 8):
        differ = wide[at + k] ^ wide[other + k]
        equal = differ == 0
        odd = np.flatnonzero(~equal)
        low = differ[odd] & (~differ[odd] + np.uint64(1))
        out[at[odd]] = k + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        at, other = at[equal], other[equal]
        out[at] = k + 8
        if not len(at):
            break
    return np.minimum(out, limit)
