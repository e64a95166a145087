"""Ranked lexical search turned round: an inverted index over the items, through which the documents stream.

The items' terms make an inverted index: for every term the items that hold it, and how often. It is broadcast,
POSTINGS postings at a time: more items than that are dealt to blocks by a hash, and the documents stream past
each block (an item of more terms than POSTINGS makes its block as large as itself). A first pass over the texts
keeps, for each document, its number of terms and its counts of the index's terms, written to the shared folder;
N, L and df come from that. The second pass streams these counts through the index: each document adds up
its scores for all items it shares a term with, and each task keeps a heap of the best k documents per item. The
heaps meet in two steps, so that no task merges more than k rows per item and slice.

Terms are runs of ASCII letters, digits and anything that is not ASCII, with A-Z lower-cased. Scores are exact
64-bit integers; a term's weight is floor(1000 * ln((2N + 2) / (2df + 1))).

A null or empty text has no terms: such documents are not counted and never found, such items find nothing. Texts
are read whole, long ones a piece at a time. Each row of documents is a document, so repeated rows fill several
ranks; ties go by ascending id, null ids last. Repeated rows of items count once; items of one id with different
texts are ranked on their own. Only the named columns are read, so further ones can't clash. An empty table on
either side gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, discard, stored

#: Postings (pairs of a term and an item that holds it) of one broadcast index, about 10 MB.
POSTINGS = 200_000
#: Bytes of a text that are split at a time.
PIECE = 4_000_000

#: ASCII letters lower-cased, other ASCII characters but digits as spaces, all other bytes as they are.
FOLD = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
LAST = 1 << 63  # where null ids stand in order


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, piece by piece."""
    folded, start = text.translate(FOLD), 0
    while start < len(folded):
        end = folded.find(b" ", start + PIECE) if start + PIECE < len(folded) else -1
        end = len(folded) if end < 0 else end
        yield folded[start:end].split()
        start = end


def counted(text: bytes) -> tuple[int, Counter]:
    """How many terms a text has, and how often each."""
    n, counts = 0, Counter()
    for words in terms(text):
        n += len(words)
        counts.update(words)
    return n, counts


class Index:
    """Postings of each term: items from 0, and the term's repeats in each."""

    def __init__(self, items: list[bytes]):
        postings: dict[bytes, list[tuple[int, int]]] = {}
        for i, text in enumerate(items):
            for term, k in counted(text)[1].items():
                postings.setdefault(term, []).append((i, k))
        self.items = len(items)
        self.term = {t: i for i, t in enumerate(postings)}
        self.start = np.cumsum([0, *map(len, postings.values())])
        flat = np.array([p for ps in postings.values() for p in ps], np.int64).reshape(-1, 2)
        self.item, self.repeats = flat[:, 0].copy(), flat[:, 1].copy()

    def scores(self, ids: np.ndarray, tf: np.ndarray, m: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items that share a term with a document, and its score for each."""
        gain = weight[ids] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
        first, many = self.start[ids], self.start[ids + 1] - self.start[ids]
        at = np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)
        total = np.zeros(self.items, np.int64)
        np.add.at(total, self.item[at], np.repeat(gain, many) * self.repeats[at])
        found = np.flatnonzero(total)
        return found, total[found]


def best(documents: DataFrame, items: DataFrame, k: int = 10, postings: int = POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest score above 0 for each item.

    documents(doc_id: a whole number, text), items(item_id, text).
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).where("text IS NOT NULL")
    wanted = items.select("item_id", F.col("text").cast("string").cast("binary").alias("text")).where("text IS NOT NULL").distinct()
    size = wanted.mapInArrow(_sizes, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // postings))
    out = None
    for b in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()
        found = _search(docs, Index([bytes(r.text) for r in rows]), k)
        names = documents.sparkSession.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", items.schema["item_id"].dataType)]))
        found = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # items of one block
        out = found if out is None else out.unionByName(found)
    return out


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch({"n": pa.array([len(counted(t)[1]) for t in batch.column("text").to_pylist()], pa.int64())})


def _search(docs: DataFrame, index: Index, k: int) -> DataFrame:
    """(item, rank, doc_id, score) for one index."""
    context = docs.sparkSession.sparkContext
    shipped = context.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shipped.value.term
        for batch in batches:
            n, ids, tf = [], [], []
            for text in batch.column("text").to_pylist():
                total, counts = counted(text)
                known = counts.keys() & number.keys()
                n.append(total)
                ids.append([number[t] for t in known])
                tf.append([counts[t] for t in known])
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n": pa.array(n, pa.int64()), "ids": pa.array(ids, pa.list_(pa.int32())), "tf": pa.array(tf, pa.list_(pa.int64()))})

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(shipped.value.term), np.int64)
        for batch in batches:
            df += np.bincount(batch.column("ids").flatten().to_numpy(), minlength=len(df))
        seen = np.flatnonzero(df)
        yield pa.record_batch({"term": pa.array(seen, pa.int64()), "df": pa.array(df[seen], pa.int64())})

    counts = stored(docs.mapInArrow(count, "doc_id long, n long, ids array<int>, tf array<long>").where("n > 0"))
    totals = counts.agg(F.count(F.lit(1)).alias("N"), F.sum("n").alias("L")).first()
    n_docs, n_terms = totals["N"], totals["L"]
    weight = np.zeros(len(index.term), np.int64)
    for row in counts.select("ids").mapInArrow(holders, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # terms of one block
        weight[row.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row.df + 1)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shipped.value
        heaps: list[list[tuple[int, int]]] = [[] for _ in range(index.items)]
        least = np.ones(index.items, np.int64)
        for batch in batches:
            ids, tf = batch.column("ids").flatten().to_numpy(), batch.column("tf").flatten().to_numpy()
            ends = np.cumsum(batch.column("ids").value_lengths().to_numpy()).tolist()
            start = 0
            for doc, n, end in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), ends, strict=True):
                if end > start:
                    at, got = index.scores(ids[start:end], tf[start:end], 25 + 75 * n * n_docs // n_terms, weight)
                    better = got >= least[at]
                    order = -(LAST if doc is None else doc)
                    for i, s in zip(at[better].tolist(), got[better].tolist(), strict=True):
                        heap = heaps[i]
                        if len(heap) < k:
                            heapq.heappush(heap, (s, order))
                        else:
                            heapq.heappushpop(heap, (s, order))
                        if len(heap) == k:
                            least[i] = heap[0][0]
                start = end
        rows = [(i, None if o == -LAST else -o, s) for i, heap in enumerate(heaps) for s, o in heap]
        if rows:
            item, doc, got = zip(*rows, strict=True)
            yield pa.record_batch({"item": pa.array(item, pa.int64()), "doc_id": pa.array(doc, pa.int64()), "score": pa.array(got, pa.int64())})

    heaps = counts.mapInArrow(score, "item long, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = Window.partitionBy("item", F.pmod("doc_id", F.lit(32))).orderBy(*order)
    top = heaps.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    top = top.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    done = checkpointed(top.select("item", "rank", "doc_id", "score"))  # k rows an item
    discard(counts)
    shipped.destroy()
    return done
