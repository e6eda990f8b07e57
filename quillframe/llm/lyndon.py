"""Suffix arrays of many strings at once, by grouping suffixes under their Lyndon prefixes.

Phase 1 keeps the suffixes of each string in groups, from least to greatest, and takes the groups
from the greatest down.  Every suffix of the current group points to the last suffix before it that
lies in a lower group (its previous-smaller pointer).  A suffix that k pointers reach moves out of its
group into a new one right above it, the higher the larger k is: its prefix has grown by k copies of
the current group's prefix.  In the end a group holds the suffixes that share a Lyndon prefix.

Phase 2 emits the order within the groups.  A suffix is its Lyndon prefix followed by the next
smaller suffix, so a group's members follow the order of these, which lie in lower groups, or in the
same group where the prefix repeats.  No string is renamed and nothing recurses.

All strings advance in step, each with its own current group, so that every step is a handful of
array operations over all strings.
"""

from __future__ import annotations

import numpy as np

from quillframe.llm.pretokens import ragged


def _starts(flags: np.ndarray) -> np.ndarray:
    """For each place the index of the last flagged place at or before it."""
    return np.maximum.accumulate(np.where(flags, np.arange(len(flags)), 0))


def _lower_before(members: np.ndarray, rank: np.ndarray, level: np.ndarray, first: np.ndarray, prev: np.ndarray) -> np.ndarray:
    """For each member (ascending) the last place before it, in its string, with a rank below its level; -1 if there is none."""
    at = members - 1
    going = np.flatnonzero(at >= first)
    at[at < first] = -1
    # Pass over places of higher rank along their own pointers.
    while len(going):
        going = going[rank[at[going]] > level[going]]
        at[going] = prev[at[going]]
        going = going[at[going] >= 0]
    # A chain of members leads to where its first one leads.
    while True:
        chained = np.flatnonzero((at >= 0) & (rank[at] == level))
        if len(chained) == 0:
            return at
        at[chained] = at[np.searchsorted(members, at[chained])]


def lyndon_groups(symbols: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1: for each suffix where its group starts in suffix order, and its next smaller suffix.

    ``edges`` holds the strings' boundaries in ``symbols``.  The next smaller suffix of one that
    has none is the end of its string.
    """
    n = len(symbols)
    string = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    order = np.lexsort((symbols, string))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    fresh = np.ones(n, bool)
    fresh[1:] = (string[order][1:] != string[order][:-1]) | (symbols[order][1:] != symbols[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = _starts(fresh)
    stop = np.zeros(n, np.int64)
    begin = np.flatnonzero(fresh)
    stop[begin] = np.append(begin[1:], n)
    prev, following = np.full(n, -1, np.int64), np.arange(1, n + 1)
    low, top = edges[:-1].copy(), edges[1:].copy()
    low, top = low[top > low], top[top > low]
    while len(top):
        group = rank[order[top - 1]]
        size = top - group
        members = np.sort(order[ragged(group, size)])
        which = np.searchsorted(low, members, "right") - 1
        at = _lower_before(members, rank, group[which], low[which], prev)
        prev[members] = at
        inner = at >= 0
        np.maximum.at(following, at[inner], following[members[inner]])
        moved, copies = np.unique(at[inner], return_counts=True)
        if len(moved):
            home = rank[moved]
            key = np.lexsort((copies, home))
            moved, copies, home = moved[key], copies[key], home[key]
            new_home = np.ones(len(moved), bool)
            new_home[1:] = home[1:] != home[:-1]
            heads = np.flatnonzero(new_home)
            many = np.diff(np.append(heads, len(moved)))
            end = stop[home[heads]]
            target = ragged(end - many, many)
            # What lies in the target places and stays goes where the moved suffixes come from.
            source = place[moved]
            leaves = np.zeros(len(moved), bool)
            held = order[target]
            mover = np.isin(held, moved) if len(moved) > 1 else held == moved
            leaves = source < np.repeat(end - many, many)
            order[source[leaves]] = held[~mover]
            place[held[~mover]] = source[leaves]
            order[target], place[moved] = moved, target
            part = new_home.copy()
            part[1:] |= copies[1:] != copies[:-1]
            starts = target[part]
            rank[moved] = target[_starts(part)]
            home_of = home[heads]
            stop[home_of] = end - many
            last = np.append(starts[1:], 0)
            closing = np.append(new_home[np.flatnonzero(part)[1:]], True)
            last[closing] = end
            stop[starts] = last
        top = group
        open_ = top > low
        if not open_.all():
            low, top = low[open_], top[open_]
    return rank, following


def emit(rank: np.ndarray, following: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Phase 2: the suffix array of all strings one after another."""
    n = len(rank)
    end = np.repeat(edges[1:], np.diff(edges))
    size = np.bincount(rank, minlength=n)
    final = np.where(size[rank] == 1, rank, -1)
    # How often the group's prefix repeats from here on, and the suffix beyond these copies.
    # One place more stands for the end of a string.
    same = (following < end) & (np.append(rank, -1)[np.minimum(following, n)] == rank)
    repeats = same.astype(np.int64)
    jump = np.where(same, following, np.arange(n))
    while True:
        more = repeats[jump] > 0
        if not more.any():
            break
        repeats[more] += repeats[jump[more]]
        jump[more] = jump[jump[more]]
    beyond = following[jump]
    left = np.flatnonzero(final < 0)
    left = left[np.argsort(rank[left], kind="stable")]
    while len(left):
        key = np.where(beyond[left] < end[left], final[np.minimum(beyond[left], n - 1)], -2)
        heads = np.flatnonzero(np.append(True, rank[left][1:] != rank[left][:-1]))
        ready = np.repeat(np.minimum.reduceat(np.where(key == -1, 0, 1), heads) > 0, np.diff(np.append(heads, len(left))))
        mine, key = left[ready], key[ready]
        mine = mine[np.lexsort((key, repeats[mine], rank[mine]))]
        heads = np.append(True, rank[mine][1:] != rank[mine][:-1])
        final[mine] = rank[mine] + np.arange(len(mine)) - _starts(heads)
        left = left[~ready]
    out = np.empty(n, np.int64)
    out[final] = np.arange(n)
    return out


def suffix_arrays(symbols: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Suffix arrays of the strings between ``edges``, each in its string's places, as global positions."""
    if len(symbols) == 0:
        return np.zeros(0, np.int64)
    return emit(*lyndon_groups(symbols, edges), edges)
