"""Document fingerprints by winnowing, and how far a document's is like its neighbour's.

Rolling hashes of all k-grams of code points (polynomials modulo 2^64, each got from running sums, then
mixed); in every window of w consecutive hashes the smallest is chosen, the rightmost of equal ones;
chosen hashes are kept with their positions. Any two texts that share GUARANTEE = w + k - 1 code points
share a fingerprint, and the positions say where. A text shorter than k is one gram.

The next document in order of id is found without an order over all rows in one task: documents are
dealt into ranges of ids, each range is read in order, and the first document of each range (one row a
range) is also sent to the range before it.

Null texts are empty ones with an empty fingerprint; two empty fingerprints are alike (1), an empty and
another are not (0). Null ids come last; equal and null ids are ordered by a hash of their text; a range
of ids is as large as RANGE bytes of text ask, and null ids have ranges of hashes. Texts of any length are
read whole. A table of one row has itself as the next document; an empty table gives an empty result;
extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions

K = 16
W = 32
GUARANTEE = W + K - 1
#: Bytes of text in a range of ids.
RANGE = 64_000_000
_BASE = 0x9E3779B97F4A7C15
_MIX = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@lru_cache(maxsize=4)
def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of base modulo 2^64."""
    return np.cumprod(np.append(np.uint64(1), np.full(n - 1, base, np.uint64)), dtype=np.uint64)


def gram_hashes(text: str, k: int = K) -> np.ndarray:
    """32-bit rolling hashes of the k-grams of code points; of a shorter text the hash of all of it."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    if not len(c):
        return c
    k = min(k, len(c))
    room = 1 << len(c).bit_length()
    up, down = powers(_BASE, room), powers(pow(_BASE, -1, 1 << 64), room)
    total = np.append(np.uint64(0), np.cumsum(c * down[: len(c)], dtype=np.uint64))
    h = (total[k:] - total[:-k]) * up[k - 1 : len(c)]  # sum of c[j] * base^(i + k - 1 - j)
    h = (h ^ (h >> np.uint64(29))) * _MIX[0]
    h = (h ^ (h >> np.uint64(31))) * _MIX[1]
    return h >> np.uint64(32)


def winnow(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """The chosen hashes and their positions, in order; w a power of two."""
    h = gram_hashes(text, k)
    if not len(h):
        return h.astype(np.uint32), np.empty(0, np.int64)
    last = np.uint64(0xFFFFFFFF)
    low = h << np.uint64(32) | (last - np.arange(len(h), dtype=np.uint64))  # of equal hashes the rightmost is smallest
    width = 1
    while width < w and len(low) > 1:
        step = min(width, w - width, len(low) - 1)
        low = np.minimum(low[:-step], low[step:])
        width += step
    chosen = low[np.append(True, low[1:] != low[:-1])]
    return (chosen >> np.uint64(32)).astype(np.uint32), (last - (chosen & last)).astype(np.int64)


def as_text(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared by all distinct hashes."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    x, y = set(a.tolist()), set(b.tolist())
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by as many first characters of the next document, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """(bucket, halo, doc_id, tie, text): every document in the bucket of its range of ids, and as halo the document that comes after each bucket."""
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = F.octet_length("text")
    known, unknown = d.agg(F.sum(F.when(F.col("doc_id").isNotNull(), size)), F.sum(F.when(F.col("doc_id").isNull(), size))).first()
    n = max(1, shuffle_partitions(docs.sparkSession), (known or 0) // RANGE)
    found = d.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 4 * n)).alias("b")).first()["b"] if n > 1 else None
    # doubles keep the order of ids, if not their digits
    bounds = sorted({float(b) for b in found or []})
    nulls = 1 + (unknown or 0) // RANGE
    bounds = bounds or [0.0]
    ids = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="as_double", outputCol="at", handleInvalid="keep")
    by_tie = F.least(F.floor((F.xxhash64("text") / F.lit(2.0**64) + 0.5) * nulls), F.lit(nulls - 1)) + len(bounds) + 1

    def place(df: DataFrame) -> DataFrame:
        at = ids.transform(df.withColumn("as_double", F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0))))
        return at.withColumn("bucket", F.when(F.col("doc_id").isNull(), by_tie).otherwise(F.col("at")).cast("int")).drop("as_double", "at")

    d = place(d).withColumn("tie", F.xxhash64("text"))
    # one row a bucket from here to halo
    first = d.groupBy("bucket").agg(F.min("doc_id").alias("first"))
    heads = d.join(F.broadcast(first.select(F.col("bucket").alias("b"), "first")), (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("first")))
    heads = heads.groupBy("bucket").agg(F.min(F.struct("tie", "doc_id", "text")).alias("head"))
    order = Window.orderBy("bucket")
    halo = heads.withColumn("to", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy())))
    halo = halo.select(F.col("to").alias("bucket"), F.lit(1).alias("halo"), "head.doc_id", "head.tie", "head.text")
    return d.select("bucket", F.lit(0).alias("halo"), "doc_id", "tie", "text").unionByName(halo), len(bounds) + 1 + nulls


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, positions, edited_positions of each row of docs(doc_id, text).

    positions are the places of the fingerprint's hashes, as code points from 0.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row before, with its fingerprint
        for batch in batches:
            out = []
            for halo, doc_id, text in zip(batch["halo"], batch["doc_id"], batch["text"], strict=True):
                mine, places = winnow(text)
                if held:
                    before, was, its, at = held
                    new = edited(was, text)
                    new_print, new_at = winnow(new)
                    out.append((before, len(was), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), as_text(its), as_text(new_print), likeness(its, new_print), likeness(its, mine), at, new_at))
                held = None if halo else (doc_id, text, mine, places)
            frame = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions", "edited_positions"])
            yield frame.astype({"doc_id": "Int64"})

    rows, n = with_next(docs)
    dealt = rows.repartitionByRange(n, "bucket").sortWithinPartitions("bucket", "halo", F.col("doc_id").asc_nulls_last(), "tie")
    return dealt.mapInPandas(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<long>, edited_positions array<long>")
