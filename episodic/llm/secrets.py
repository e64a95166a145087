"""Secret scans: patterns of well-known kinds, and a token-efficiency test for random strings.

Base kinds are patterns, leftmost and without overlaps: assign (a name such as password or api_key, a sign, a
value of 8 or more characters), access (AKIA and capitals or digits, 16 or more in all) and hex (32 or more
hexadecimal digits). The method adds kind random: a run of LEAST or more base-64 characters that a byte-level BPE
vocabulary cuts into many tokens, fewer than RATIO characters a token. Words take two to five characters a token,
random letters and digits about 1.4. Known digests (hexadecimal of the length of a common hash, or its base-64 form
after its name) and identifiers (UUIDs, object ids, numbers, names and paths made of words and numbers) are
excluded first, and what a base span covers is not told twice.

A null or empty text has no spans. Texts are scanned whole; a run of over CHUNK characters is cut into tokens a
chunk at a time, its ratio is that of all chunks together. Rows are independent, so repeated rows, equal and null ids
come through as they are; other columns stay, result columns replace others of the same name. An empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import unused

KINDS = ("assign", "access", "hex", "random")
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

LEAST = 20
RATIO = 1.9
CHUNK = 4096
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")

# Hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 digests, and of object ids.
DIGESTS = (32, 40, 56, 64, 96, 128)
OBJECT_ID = 24
NAMED_DIGEST = re.compile(r"(?:md5|sha1|sha224|sha256|sha384|sha512)[-=/_][A-Za-z0-9+/_-]+={0,2}", re.IGNORECASE)
UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.IGNORECASE)
ONLY_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: Names and paths: words in one case, or with a capital, and numbers, between signs.
NAME = re.compile(r"[A-Za-z]?[a-z]*|[A-Z]*|[0-9]*")
PARTS = re.compile(r"[-+/_=]+")

#: How texts are split before the merges of byte-level rank files (fixed value, as in the vocabulary's description).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

loaded: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary of a file of ranks, read once a worker."""
    if path not in loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        loaded[path] = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return loaded[path]


def characters_per_token(run: str, vocabulary: tiktoken.Encoding) -> float:
    tokens = sum(len(vocabulary.encode_ordinary(run[i : i + CHUNK])) for i in range(0, len(run), CHUNK))
    return len(run) / max(tokens, 1)


def known(run: str) -> bool:
    """Is it a digest or an identifier, which look random but tell nothing?"""
    bare = run.strip("=_+/-")
    if all(map(NAME.fullmatch, PARTS.split(run))) or UUID.fullmatch(bare) or NAMED_DIGEST.fullmatch(run.strip("_+/-")):
        return True
    return bool(ONLY_HEX.fullmatch(bare)) and (len(bare) in DIGESTS or len(bare) == OBJECT_ID)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), in order."""
    out = []
    folded = text.lower()
    if any(name in folded for name in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def united(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the parts of a text that spans in order cover."""
    starts: list[int] = []
    ends: list[int] = []
    for start, _, end in spans:
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def random_spans(text: str, base: list[tuple[int, int, int]], vocabulary: tiktoken.Encoding) -> list[tuple[int, int, int]]:
    """Runs that fail the token-efficiency test and share no character with a base span."""
    starts, ends = united(base)
    out = []
    for m in RUN.finditer(text):
        run, start, end = m.group(), m.start(), m.end()
        before = bisect_left(starts, end)  # spans that start before the run ends
        if (before and ends[before - 1] > start) or known(run):
            continue
        if characters_per_token(run, vocabulary) < RATIO:
            out.append((start, 3, end))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def found(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df and n_assign, n_access, n_hex, base_sha256, spans, n_random; the text column is given up.

    path: a file of byte-level BPE ranks that every executor has.
    """
    made = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"]
    kept = [c for c in df.columns if c not in (text, *made)]
    (own,) = unused(kept, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoding(path)
        for batch in batches:
            rows = []
            for t in batch.column(own).to_pylist():
                base = base_spans(t or "")
                added = random_spans(t or "", base, vocabulary)
                n = [sum(kind == k for _, kind, _ in base) for k in range(3)]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + added)), len(added)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(made)
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *arrays], names=[*kept, *made])

    source = df.select(*kept, F.col(text).cast("string").alias(own))
    kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
    types = [T.LongType()] * 3 + [T.StringType()] * 2 + [T.LongType()]
    return source.mapInArrow(run, T.StructType([*source.select(*kept).schema.fields, *(T.StructField(c, t) for c, t in zip(made, types, strict=True))]))
