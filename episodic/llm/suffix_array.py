"""Suffix-array deduplication: bytes covered by a long string that also occurs elsewhere.

The suffix array is built by linear grouping. Suffixes are first grouped by their first symbol; groups
are then taken in descending order, each suffix of a group finds the previous suffix of a lower group
(pointers of suffixes taken before are followed), and suffixes found equally often move, together with
those of their own group, into a new group right behind the old one. In the end a suffix's group is
its longest Lyndon prefix. The order inside all groups is then emitted in one ascending pass: the
suffix that follows a Lyndon prefix is already in place when its turn comes. Nothing is renamed or
sorted again.

Which texts are compared is decided by repeats.repeated_windows. A content's bytes are read as blocks
of 8, aligned at its anchor, so equal windows have equal blocks; the suffix array is over blocks, and
suffixes that share the blocks of a whole window stand together in it. The window's loose bytes
before and after its blocks (8 together) are then compared exactly.

A content that has copies counts as often as it occurs, so its windows are repeats wherever they stand
in the array.

Null texts are empty; texts shorter than the window keep all bytes; texts of any length are read whole.
Matches never cross documents. Null ids and rows with equal ids are documents like others; rows with
equal id and text are judged as copies of one another. An empty table gives an empty result; extra
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .repeats import HOT, Places, covered, keyed_rows, repeated_windows

K = 200
M = 64
BLOCK = 8


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of symbols in ascending order, by linear grouping."""
    n = len(symbols) + 1
    s = np.append(symbols.astype(np.int64), np.iinfo(np.int64).min)  # the end is the smallest symbol
    order = np.argsort(s, kind="stable")
    new = np.append(True, s[order][1:] != s[order][:-1])
    starts = np.nonzero(new)[0]
    group_of = np.empty(n, np.int64)
    group_of[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    placed, group, at = order.tolist(), group_of.tolist(), place.tolist()
    size = dict(zip(starts.tolist(), np.diff(np.append(starts, n)).tolist(), strict=True))
    length = dict.fromkeys(size, 1)  # of the groups' Lyndon prefixes so far
    before = [-1] * n
    high = n - 1
    while high >= 0:
        g = group[placed[high]]
        members = sorted(placed[g : high + 1]) if high > g else [placed[g]]
        count: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = before[p]
            before[i] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        moving: dict[tuple[int, int], list[int]] = {}
        for p, times in count.items():
            moving.setdefault((-times, group[p]), []).append(p)
        for times, old in sorted(moving) if len(moving) > 1 else moving:
            moved = moving[times, old]
            rest = size[old]
            for p in moved:  # to the end of the old group's places
                rest -= 1
                here, other = at[p], placed[old + rest]
                placed[here], at[other] = other, here
                placed[old + rest], at[p] = p, old + rest
            start, longer = old + rest, length[old] - times * length[g]
            for p in moved:
                group[p] = start
            size[start], length[start] = len(moved), longer
            if rest:
                size[old] = rest
        high = g - 1
    following = np.arange(n) + np.array([length[g] for g in group])
    by_next = np.argsort(following, kind="stable")
    first = np.searchsorted(following[by_next], np.arange(n + 1)).tolist()
    children = by_next.tolist()
    free = {g: g for g in size}
    out = [0] * n
    out[0] = n - 1
    for i in range(n):
        s_i = out[i]
        for c in children[first[s_i] : first[s_i + 1]]:
            g = group[c]
            out[free[g]] = c
            free[g] += 1
    return np.array(out[1:], np.int64)


def match_bytes(contents: list[np.ndarray], count: np.ndarray, first: np.ndarray, anchor: np.ndarray) -> tuple[Places, Places]:
    """Windows of K bytes that some other content, another place or a copy of it has too; the same for first and further occurrences."""
    full = (K - BLOCK + 1) // BLOCK  # blocks that every window holds
    length = np.array([len(c) for c in contents])
    pad = np.zeros(K + 2 * BLOCK, np.uint8)
    buffer = np.concatenate([x for c in contents for x in (pad, c)] + [pad])
    begin = np.cumsum(length + len(pad)) - length
    phase = anchor % BLOCK
    blocks = (length - phase) // BLOCK
    word = np.zeros(len(buffer) - BLOCK + 1, np.uint64)  # the 8 bytes from each place on
    for i in range(BLOCK):
        word = word << np.uint64(8) | buffer[i : len(buffer) - BLOCK + 1 + i]
    # one symbol a block, one lower, unlike any other, after each content
    owner = np.repeat(np.arange(len(contents)), blocks + 1)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(blocks + 1) - blocks - 1, blocks + 1)
    where = begin[owner] + phase[owner] + BLOCK * index
    inner = index < blocks[owner]
    _, rank = np.unique(word[where[inner]], return_inverse=True)
    symbol = np.empty(len(owner), np.int64)
    symbol[inner] = rank
    symbol[~inner] = -1 - np.arange(len(contents))
    order = suffix_array(symbol)
    # suffixes with the same blocks of a whole window stand together
    room = index + full <= blocks[owner]
    padded = np.append(symbol, np.full(full, -(1 << 40)))
    same = room[order[:-1]] & room[order[1:]]
    for i in range(full):
        same &= padded[order[:-1] + i] == padded[order[1:] + i]
    together = np.cumsum(np.append(True, ~same))
    shared = np.append(same, False) | np.append(False, same) | (room[order] & (count[owner[order]] > 1))
    suffix, together = order[shared], together[shared]
    who, at = owner[suffix], where[suffix]
    found: list[Places] = []
    for r in range(BLOCK):
        start = at - r
        fits = (start >= begin[who]) & (start + K <= begin[who] + length[who])
        bits = np.uint64(8 * (BLOCK - r))
        left = word[at[fits] - BLOCK] & ((np.uint64(1) << np.uint64(8 * r)) - np.uint64(1))
        right = word[at[fits] + BLOCK * full]
        loose = (left << bits | right >> np.uint64(8 * r)) if r else right
        group, w, c = together[fits], start[fits], who[fits]
        if not len(w):
            continue
        by = np.lexsort((loose, group))
        equal = (loose[by][1:] == loose[by][:-1]) & (group[by][1:] == group[by][:-1])
        twice = by[np.append(equal, False) | np.append(False, equal) | (count[c][by] > 1)]
        found.append((c[twice], w[twice] - begin[c[twice]]))
    places = tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
    return places, places


def bytes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def unpack_bytes(content: bytes) -> np.ndarray:
    return np.frombuffer(content, np.uint8)


def byte_slices(content: bytes, n: int) -> list[bytes]:
    return [content[i : i + n] for i in range(len(content) - n + 1)]


def parse_bytes(text: str):
    data = bytes_of(text)
    return data, lambda a, b: data[a:b].tobytes()


def removed_bytes(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, kept (binary), spans (array of removed byte ranges a to b) of each row of docs(doc_id, text)."""
    rows = keyed_rows(docs.select("doc_id", "text"), "text", "ord", "rid")
    found = repeated_windows(rows, parse_bytes, unpack_bytes, byte_slices, K, M, match_bytes, hot=hot)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, spans in zip(batch["doc_id"], batch["text"], batch["spans"], strict=True):
                data = bytes_of(text)
                gone = covered(spans, K, len(data))
                edge = np.nonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))[0].tolist()
                kept = data[~gone].tobytes()
                out.append((doc_id, len(data), [{"a": a, "b": b} for a, b in zip(edge[::2], edge[1::2], strict=True)], kept))
            frame = pd.DataFrame([x[1:] for x in out], columns=["n_bytes", "spans", "kept"])
            yield frame.assign(doc_id=batch["doc_id"].astype("Int64").array)[["doc_id", "n_bytes", "spans", "kept"]]

    return rows.join(found, ["ord", "rid"], "left").select("doc_id", "text", "spans").mapInPandas(cut, "doc_id long, n_bytes long, spans array<struct<a: int, b: int>>, kept binary")
