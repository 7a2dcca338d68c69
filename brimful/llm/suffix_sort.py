"""Deep-shallow suffix sorting of byte windows.

Multikey quicksort orders suffixes by their first bytes, eight to a digit, over all segments of a round
at once; groups whose long common prefix outlasts that shallow depth are ordered by blind tries, which
look only at branching bytes on the way down and compare once, with one leaf.
"""

from __future__ import annotations

import numpy as np

DIGIT = 8


def digits(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as one big-endian number; data must reach that far."""
    rows = np.lib.stride_tricks.sliding_window_view(data, DIGIT)[at]
    return np.ascontiguousarray(rows).view(">u8")[:, 0].astype(np.uint64)


def multikey_quicksort(data: np.ndarray, starts: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the starts by their first 8 * levels bytes, begins of the groups that are equal so far)."""
    n = len(starts)
    order = np.arange(n)
    begins = np.ones(n, bool)
    seg_lo, seg_len, seg_level = np.array([0]), np.array([n]), np.array([0])
    while True:
        live = (seg_len > 1) & (seg_level < levels)
        seg_lo, seg_len, seg_level = seg_lo[live], seg_len[live], seg_level[live]
        if not len(seg_lo):
            return order, np.flatnonzero(begins)
        first = np.concatenate([[0], np.cumsum(seg_len)[:-1]])
        seg = np.repeat(np.arange(len(seg_lo)), seg_len)
        place = np.arange(len(seg)) - first[seg] + seg_lo[seg]
        own = order[place]
        key = digits(data, starts[own] + DIGIT * seg_level[seg])
        three = np.sort(np.stack([key[first], key[first + seg_len // 2], key[first + seg_len - 1]]), axis=0)
        pivot = three[1][seg]
        side = (key > pivot).astype(np.int8) - (key < pivot).astype(np.int8)
        counts = [np.add.reduceat(side == s, first, dtype=np.int64) for s in (-1, 0, 1)]
        lows = [seg_lo, seg_lo + counts[0], seg_lo + counts[0] + counts[1]]
        for s, low in zip((-1, 0, 1), lows, strict=True):
            hit = side == s
            rank = np.cumsum(hit) - hit
            order[(low[seg] + rank - rank[first][seg])[hit]] = own[hit]
        begins[seg_lo] = True
        inner = np.ones(len(place), bool)
        inner[first] = False
        begins[place[inner]] = False
        for c, low in zip(counts, lows, strict=True):
            begins[low[c > 0]] = True
        seg_lo = np.concatenate(lows)
        seg_len = np.concatenate(counts)
        seg_level = np.concatenate([seg_level, seg_level + 1, seg_level])


class BlindTrie:
    """Patricia trie over strings of one length; equal strings share a leaf."""

    __slots__ = ("root",)

    def __init__(self, text: bytes, member: int) -> None:
        self.root: list = [len(text), text, [member]]

    def insert(self, text: bytes, member: int) -> None:
        node = self.root
        while isinstance(node[1], dict):
            children = node[1]
            node = children.get(text[node[0]]) or next(iter(children.values()))
        other = node[1]
        if other == text:
            node[2].append(member)
            return
        differ = int.from_bytes(text, "big") ^ int.from_bytes(other, "big")
        lcp = len(text) - (differ.bit_length() + 7) // 8
        node = self.root
        while node[0] < lcp:
            node = node[1][text[node[0]]]
        if node[0] == lcp:
            node[1][text[lcp]] = [len(text), text, [member]]
        else:
            node[:] = [lcp, {other[lcp]: node[:], text[lcp]: [len(text), text, [member]]}]

    def groups(self) -> list[list[int]]:
        """Members of equal strings, in the order of the strings."""
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node[1], dict):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out.append(node[2])
        return out


def sort_windows(data: np.ndarray, starts: np.ndarray, width: int, shallow: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(order of the windows data[s : s + width], begins of the groups of equal windows in that order)."""
    padded = np.concatenate([data, np.zeros(DIGIT * shallow, np.uint8)])
    order, begins = multikey_quicksort(padded, starts, shallow)
    ends = np.append(begins[1:], len(starts))
    fresh = [begins[ends - begins == 1]]
    raw = data.tobytes()
    for lo, hi in zip(begins[ends - begins > 1].tolist(), ends[ends - begins > 1].tolist(), strict=True):
        own = order[lo:hi].tolist()
        at = starts[order[lo:hi]].tolist()
        trie = BlindTrie(raw[at[0] : at[0] + width], own[0])
        for s, member in zip(at[1:], own[1:], strict=True):
            trie.insert(raw[s : s + width], member)
        groups = trie.groups()
        order[lo:hi] = [m for g in groups for m in g]
        sizes = np.array([len(g) for g in groups])
        fresh.append(lo + np.cumsum(sizes) - sizes)
    return order, np.sort(np.concatenate(fresh))
