"""A two-stage suffix array, and what equal windows it finds.

A suffix is rising if it is smaller than its successor (the suffix one place
on), else falling. Only rising suffixes are sorted directly. A scan of the
buckets of first bytes, in order, then places the falling ones: the suffix
before a placed one, if it is falling, is the next of its own bucket. In a
bucket all falling suffixes stand before all rising ones.
"""

from __future__ import annotations

import numpy as np


def words(data: bytes | np.ndarray, count: int) -> np.ndarray:
    """The little-endian 8-byte number at each of the first ``count`` places;
    ``data`` has at least 7 bytes more."""
    out = np.empty(count, "<u8")
    for j in range(min(8, count)):
        part = out[j::8]
        part[:] = np.frombuffer(data, "<u8", len(part), j)
    return out


def rising(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor. The last is falling."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = -1
    decided = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(decided[::-1])[::-1]] > 0


def sort_directly(starts: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` by the first ``depth`` bytes at least; ``keys`` holds the 8
    bytes at each place as a big-endian number. Ties are refined word by word."""
    order = starts[np.argsort(keys[starts])]
    group = np.concatenate([[0], np.cumsum(keys[order[1:]] != keys[order[:-1]])]) if len(order) else np.zeros(0, np.int64)
    for offset in range(8, depth, 8):
        same = group[1:] == group[:-1]
        tied = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same])) if len(order) else []
        if not len(tied):
            break
        at, key = order[tied], keys[np.minimum(order[tied] + offset, len(keys) - 1)]
        # One number for the group and the word's rank: a plain sort is much
        # faster than a sort by two keys.
        rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
        sub = np.argsort(group[tied].astype(np.uint64) << np.uint64(32) | rank)
        order[tied] = at[sub]
        key, old = key[sub], group[tied]
        new = np.ones(len(order), bool)
        new[1:] = group[1:] != group[:-1]
        new[tied[1:]] = (old[1:] != old[:-1]) | (key[1:] != key[:-1])
        new[tied[0]] = True
        group = np.cumsum(new)
    return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes' places in the order of their first ``depth`` bytes."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    keys = words(padded, n + 8).byteswap()
    up = rising(text)
    direct = sort_directly(np.flatnonzero(up), keys, depth)
    first = text[direct]
    bounds = np.searchsorted(first, np.arange(257))
    fallen: list[list[np.ndarray]] = [[] for _ in range(256)]
    fallen[text[n - 1]].append(np.array([n - 1]))
    out = []

    def place(scanned: np.ndarray, bucket: int) -> np.ndarray:
        """Put the falling suffixes before these into their buckets; those of
        the bucket itself are returned."""
        before = scanned[scanned > 0] - 1
        before = before[~up[before]]
        letters = text[before]
        own = before[letters == bucket]
        before, letters = before[letters > bucket], letters[letters > bucket]
        if not len(before):
            return own
        order = np.argsort(letters, kind="stable")
        before, letters = before[order], letters[order]
        edges = np.flatnonzero(np.concatenate([[True], letters[1:] != letters[:-1]]))
        for a, b in zip(edges, [*edges[1:], len(letters)], strict=True):
            fallen[letters[a]].append(before[a:b])
        return own

    for bucket in range(256):
        waiting = fallen[bucket]
        scanned = np.concatenate(waiting) if waiting else np.zeros(0, np.int64)
        while len(scanned):
            out.append(scanned)
            scanned = place(scanned, bucket)
        sorted_here = direct[bounds[bucket] : bounds[bucket + 1]]
        out.append(sorted_here)
        place(sorted_here, bucket)
    return np.concatenate(out)


def shared_with_previous(text: np.ndarray, array: np.ndarray, span: int) -> np.ndarray:
    """Whether each suffix has a common prefix of ``span`` bytes (8 or more) with
    the one before it in the array."""
    padded = np.concatenate([text, np.zeros(span + 16, np.uint8)])
    keys = words(padded, len(text) + span)
    equal = np.zeros(len(array), bool)
    at = np.arange(1, len(array))
    for offset in [*range(0, span - 7, 8), span - 8]:
        at = at[keys[array[at] + offset] == keys[array[at - 1] + offset]]
    at = at[np.maximum(array[at], array[at - 1]) + span <= len(text)]
    equal[at] = True
    return equal
