"""Substring deduplication of word sequences with prefix-partitioned suffix trees.

Suffixes of all documents are partitioned by prefix: first by a gram of M words that every window of K
words holds at a place of its own (repeats.repeated_windows), so that only suffixes that can be in a
repeat are moved; a partition too large for memory is parted by longer prefixes, of K / 2 and of K words.
Inside a partition the tree is written from its root: a node's suffixes are split by their next word, a
step in which all agree lengthens the edge, and a node with one suffix is a leaf. A leaf stands for as
many suffixes as its text has copies. Nodes of depth K with more than one suffix below are the deep
internal nodes, the repeats; their suffixes carry the first occurrence of the repeat.

A window is removed if its words also start earlier (smaller id, or same document and earlier start).
Windows are judged on the input. Words are compared by 64-bit hashes, K in a row.

Null texts have no words; null ids come last; rows with equal id and text are one document and each
keeps what it keeps; of rows with one id and unlike texts the one with the smaller hash is earlier. Texts
of any length are read whole. An empty table gives an empty result; extra columns are passed on, but for
those with the names of results, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import hash_words, unused
from .repeats import HOT, Places, covered, keyed_rows, repeated_windows

K = 20
M = 6


def deep_nodes(symbols: np.ndarray, suffix: np.ndarray, weight: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (places in symbols, each standing for weight ones) below nodes of the given depth that have more than one, and their node."""
    node = np.zeros(len(suffix), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    nodes = 0
    for d in range(depth):
        if not len(suffix):
            break
        _, node, size = np.unique(node * (len(symbols) + 1) + symbols[suffix + d], return_inverse=True, return_counts=True)
        leaf = size[node] == 1
        copies = suffix[leaf & (weight > 1)]  # the leaf of equal texts: its edge reaches the depth
        found.append((copies, nodes + np.arange(len(copies))))
        nodes += len(copies)
        suffix, node, weight = suffix[~leaf], node[~leaf], weight[~leaf]
    found.append((suffix, nodes + node))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def match_words(contents: list[np.ndarray], count: np.ndarray, first: np.ndarray, anchor: np.ndarray) -> tuple[Places, Places]:
    """Windows of K words whose words start earlier than in the first occurrence of their content, and those that are in a deep node at all."""
    length = np.array([len(c) for c in contents])
    _, symbols = np.unique(np.concatenate(contents), return_inverse=True)
    owner = np.repeat(np.arange(len(contents)), length)
    begin = np.cumsum(length) - length
    offset = np.arange(len(owner)) - begin[owner]
    full = np.nonzero(offset + K <= length[owner])[0]
    suffix, node = deep_nodes(symbols, full, count[owner[full]], K)
    who, at = owner[suffix], offset[suffix]
    place = np.stack([first[who, 0], first[who, 1], first[who, 2] + at])
    by = np.lexsort((place[2], place[1], place[0], node))
    lead = np.append(True, node[by][1:] != node[by][:-1]) if len(by) else np.empty(0, bool)
    leader = by[np.maximum.accumulate(np.where(lead, np.arange(len(by)), 0))] if len(by) else by
    late = by[(place[:, by] != place[:, leader]).any(0)]  # all of a node but its earliest place
    return (who[late], at[late]), (who, at)


def words_of_text(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def unpack_words(content: bytes) -> np.ndarray:
    return hash_words(content.split())


def word_slices(content: bytes, n: int) -> list[bytes]:
    words = content.split()
    return [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def parse_words(text: str):
    words = words_of_text(text)
    return hash_words(words), lambda a, b: b" ".join(words[a:b])


def removed_words(docs: DataFrame, hot: int = HOT, layout: bool = False) -> DataFrame:
    """docs with text replaced by its kept words, joined by one space, and n_words and n_removed; layout: a text that loses nothing stays as it is."""
    kept_columns = [c for c in docs.columns if c not in ("text", "n_words", "n_removed")]
    order, rid, spans = unused(docs.columns, "ord", "rid", "spans")
    rows = keyed_rows(docs.select(*kept_columns, "text"), "text", order, rid)
    found = repeated_windows(rows.select(rows[order].alias("ord"), rows[rid].alias("rid"), "text"), parse_words, unpack_words, word_slices, K, M, match_words, hot=hot)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, n_words, n_removed = [], [], []
            for text, its in zip(batch["text"], batch[spans], strict=True):
                words = words_of_text(text)
                kept = words
                if its is not None:
                    gone = covered(its, K, len(words)).tolist()
                    kept = [w for w, g in zip(words, gone, strict=True) if not g]
                texts.append(text if layout and len(kept) == len(words) else b" ".join(kept).decode("utf-8", "surrogatepass"))
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
            yield batch[kept_columns].assign(text=texts, n_words=n_words, n_removed=n_removed)

    joined = rows.join(found.toDF(order, rid, spans), [order, rid], "left").drop(order, rid)
    fields = [*joined.select(*kept_columns).schema.fields, T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    return joined.mapInPandas(cut, T.StructType(fields))
