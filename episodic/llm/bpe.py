"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

Texts are split and normalised as the tokenizer file says (NFC, lower case, letters, single digits,
other runs; white space dropped). Each word starts as byte symbols; the leaves of its tree hold the
rank of each adjacent pair, so the root is the leftmost lowest-rank merge. A merge changes three
leaves and the nodes above them, until the root holds no mergeable pair. Words are merged many at a
time: each batch is a table of trees of one size, and one step does the next merge of every word.
Words already met by a worker are remembered, up to CACHE of them.

Null texts are empty ones; an empty text has no ids and an empty decoded text. Rows are independent,
so repeated rows, ties, null ids and extra columns pass through; result columns replace others of the same
name. Texts are encoded whole; a very long word takes time in proportion to its length. An empty table
gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import unused

CACHE = 600_000
FAR = np.iinfo(np.int64).max

ANY = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: The same for texts of ASCII or Latin-1 characters without the few on which re and Unicode classes differ.
LATIN = re.compile(r"[^\W\d_]+|'(?:[stmd]|re|ve|ll)|\d|(?:[^\s\w]|_)+")
ODD = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable, else the next one from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordBpe:
    """A tokenizer file with word-end suffix, no decoder, and special tokens that are split off first."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens: dict[int, str] = {i: t for t, i in (vocab | self.special).items()}
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + end] for s in symbols], np.int64)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, tuple[bytes, str]] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, FAR where it has none or one side is missing (below 0)."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], FAR)

    def merge(self, words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of at most size bytes (a power of two), one after the other, and how many each has."""
        n, rows = len(words), np.arange(len(words))
        length = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        filled = np.arange(size) < length[:, None]
        sym = np.full((n, size + 1), -1, np.int64)  # the last column takes what falls off either end
        sym[:, :size][filled] = self.inner[flat]
        sym[rows, length - 1] = self.last[flat[np.cumsum(length) - 1]]
        after = np.tile(np.minimum(np.arange(1, size + 2), size), (n, 1))
        before = np.tile(np.append(np.arange(-1, size - 1), size), (n, 1))
        before[:, 0] = size
        tree = np.full((n, 2 * size), FAR, np.int64)
        first = self.rank(sym[:, : size - 1], sym[:, 1:size]) if size > 1 else np.empty((n, 0), np.int64)
        tree[:, size : 2 * size - 1] = np.where(first < FAR, first * size + np.arange(max(size - 1, 0)), FAR)
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2

        def put(r: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            node = leaf + size
            tree[r, node] = value
            while size > 1 and node[0] > 1:
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        r = rows
        while size > 1:
            root = tree[r, 1]
            r, root = r[root < FAR], root[root < FAR]
            if not len(r):
                break
            at, made = root % size, self.made[root // size]
            gone = after[r, at]
            following, previous = after[r, gone], before[r, at]
            sym[r, at], sym[r, gone] = made, -1
            after[r, at], before[r, following] = following, at
            put(r, gone, np.full(len(r), FAR))
            right = self.rank(made, sym[r, following])
            put(r, at, np.where(right < FAR, right * size + at, FAR))
            some = previous < size
            if some.any():
                s, p = r[some], previous[some]
                left = self.rank(sym[s, p], made[some])
                put(s, p, np.where(left < FAR, left * size + p, FAR))
        alive = sym[:, :size] >= 0
        return sym[:, :size][alive], alive.sum(1)

    def learn(self, words: list[str]) -> None:
        """Encode words into the cache."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            raw = w.encode("utf-8", "surrogatepass")
            by_size.setdefault(1 << (len(raw) - 1).bit_length(), []).append((w, raw))
        for size, group in by_size.items():
            step = max(1, 2_000_000 // (size * 8))
            for i in range(0, len(group), step):
                part = group[i : i + step]
                ids, counts = self.merge([raw for _, raw in part], size)
                raw_ids, shown, ends = ids.astype("<u4").tobytes(), [self.tokens[x] for x in ids.tolist()], np.cumsum(counts).tolist()
                start = 0
                for (w, _), end in zip(part, ends, strict=True):
                    self.known[w] = raw_ids[4 * start : 4 * end], " ".join(shown[start:end])
                    start = end

    def words(self, text: str) -> list[str]:
        """The words of a text in order; special tokens are words of their own."""
        if self.split and "<" in text:
            parts = self.split.split(text)
            if len(parts) > 1:
                return [w for p in parts for w in ([p] if p in self.special else self.words(p))]
        ascii_only = text.isascii()
        if not ascii_only:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if (ascii_only or max(text, default=" ") < "Ā") and not ODD.search(text):
            return LATIN.findall(text)
        return ANY.findall(text)

    def encode_batch(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Ids as little-endian 32-bit integers, and the decoded text, of each text."""
        split = [self.words(t) for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        new = set().union(*split) - self.known.keys()
        for w in new & self.special.keys():
            self.known[w] = np.array([self.special[w]], "<u4").tobytes(), w
        self.learn([w for w in new if w not in self.special])
        out = [tuple(zip(*map(self.known.__getitem__, words), strict=True)) or ((), ()) for words in split]
        return [b"".join(ids) for ids, _ in out], [" ".join(shown) for _, shown in out]


loaded: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    if path not in loaded:
        loaded[path] = WordBpe(path)
    return loaded[path]


def encode_decode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df and n_tokens, ids (binary: little-endian unsigned 32-bit integers) and decoded; the text column is given up.

    path: a tokenizer file that every executor has.
    """
    kept = [c for c in df.columns if c not in (text, "n_tokens", "ids", "decoded")]
    (own,) = unused(kept, "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(path)
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.iloc[i : i + 500]
                texts = [t if isinstance(t, str) else "" for t in part[own]]
                ids, shown = bpe.encode_batch(texts)
                out = part.drop(columns=own)
                yield out.assign(n_tokens=[len(x) // 4 for x in ids], ids=ids, decoded=shown)

    source = df.select(*kept, F.col(text).cast("string").alias(own))
    fields = [*source.select(*kept).schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    return source.mapInPandas(run, T.StructType(fields))
