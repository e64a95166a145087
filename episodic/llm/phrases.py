"""Phrase collocation mining by dynamic itemset counting.

The texts are dealt to SHARDS shards, which are scanned in turn, round and round. All words are counted from the first
scan on. A longer phrase is activated as soon as both phrases that it has without its last and without its first
word have reached the threshold, wherever in the cycle that happens; it is counted in the scans that follow,
beside phrases of all other lengths, and is complete after one full cycle from there. Mining ends when no phrase
is active any more.

A scan is one job over one shard. Its tasks turn texts into word numbers, and count the phrases that may be active
by array operations. Which those are they know from two Bloom filters of a bounded size (BITS): phrases that have reached
the threshold, and those that have done so within the last cycle (only these can have active longer ones). A
filter errs on one side: phrases that are counted in vain are left out exactly afterwards, when counts meet the
table of reached phrases. Counts, reached and complete phrases are tables in the shared folder; only the filters'
words pass through the driver. Each task adds up its phrases before the shuffle, FLUSH bytes of texts at a time.

Words are runs of anything but space and tab, A-Z lower-cased, in pieces between any of . , ; : ! ? and line
breaks; phrases stay inside a piece and a language (null: und). A null or empty text has no words. Texts are read
whole, long ones some pieces at a time. Repeated rows count again; ids are not looked at, and only the named
columns are read, so further ones can't clash. Ties in the ranking go by count, then by the phrase's bytes; the lowest
cut of equal ones is the first. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, discard, small, stored

SHARDS = 2
LONGEST = 4
LEAST = 30
TOP = 2000
#: Bits of a Bloom filter for each phrase that it holds (1.4 % of false alarms), and at most (8 MB): it gives more false alarms beyond 4 million phrases, which cost time, not results.
PER_PHRASE, BITS = 16, 1 << 26
#: Bytes of texts whose phrases a task adds up at a time.
FLUSH = 12_000_000
#: Rows of a batch that a task hands on.
ROWS = 200_000
#: Keys that are broadcast, to pick the rows that are added up; beyond that the join shuffles.
HEAVY = 1_000_000
#: Bytes of a text that are looked at a time.
PIECE = 8_000_000

#: A-Z lower-cased, tab as space, ends of pieces as 255, a byte that UTF-8 never has.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 255 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
SEED = 42  # Spark's xxhash64

Filter = tuple[np.ndarray, np.ndarray]  # bits of all reached phrases, and of those reached within the last cycle


def turned(h: np.ndarray) -> np.ndarray:
    return h << np.uint64(7) | h >> np.uint64(57)


def phrase_hash(lang: Column, phrase: Column) -> Column:
    """64 bits of a language and a phrase: the words' hashes, each turned before the next one comes in. Tasks do the same on arrays."""
    turn = lambda h: F.shiftleft(h, 7).bitwiseOR(F.shiftrightunsigned(h, 57))
    return F.aggregate(F.split(phrase, " "), F.xxhash64(lang), lambda h, w: turn(h).bitwiseXOR(F.xxhash64(w)))


def holds(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Are both bits of each hash set?"""
    last = np.uint64(64 * len(bits) - 1)
    test = lambda p: bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)
    return (test(h & last) & test(h >> np.uint64(32) & last)).astype(bool)


def filter_bits(reached: DataFrame, lately: Column, size: int = BITS) -> Filter:
    """Bloom filters of reached(lang, phrase), of all rows and of those that lately holds for; at most size / 64 words come to the driver."""
    bits = tuple(np.zeros(size // 64, np.uint64) for _ in range(2))
    h = phrase_hash(F.col("lang"), F.col("phrase"))
    both = F.explode(F.array(h.bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(size - 1))))
    bit = F.expr("shiftleft(1L, cast(p & 63 as int))")
    words = reached.select(both.alias("p"), lately.alias("late")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(bit).alias("b0"), F.coalesce(F.bit_or(F.when(F.col("late"), bit)), F.lit(0).cast("long")).alias("b1")).toArrow()
    for i in range(2):
        bits[i][words["word"].to_numpy()] = words[f"b{i}"].to_numpy().view(np.uint64)
    return bits


def slices(text: bytes) -> Iterator[bytes]:
    """A folded text, cut at ends of pieces where it is long."""
    start = 0
    while start < len(text):
        end = text.find(b"\xff", start + PIECE) if start + PIECE < len(text) else -1
        end = len(text) if end < 0 else end
        yield text[start:end]
        start = end


def numbered(buffer: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Numbers of the words of a folded text, and the words by number."""
    buffer = buffer.replace(b"\xff", b" \xff ") + b" "
    ends = np.flatnonzero(np.frombuffer(buffer, np.uint8) == 32) + 1
    offsets = np.concatenate([np.zeros(1, np.int64), ends])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(buffer)])  # each with the space after it
    coded = words.filter(pa.array(np.diff(offsets) > 1)).dictionary_encode()
    return coded.indices.to_numpy(), [w[:-1] for w in coded.dictionary.to_pylist()]


class Counter:
    """Counts the active phrases of one language in one scan. Keys are the language, a tab and the phrase; the empty phrase counts all words."""

    def __init__(self, lang: str, words: bool, filters: Filter | None, limit: int):
        self.lang, self.words, self.filters, self.limit = lang.encode(), words, filters, limit
        self.root = turned(np.uint64(xxhash.xxh64_intdigest(self.lang, SEED)))
        self.parts, self.held = [], 0

    def add(self, text: bytes) -> Iterator[pa.RecordBatch]:
        for part in slices(text.translate(FOLD)):
            self.parts.append(part)
            self.held += len(part)
            if self.held >= self.limit:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        ids, names = numbered(b"\xff".join(self.parts))
        self.parts, self.held = [], 0
        real = np.array([w != b"\xff" for w in names], bool)
        if not real.any():
            return
        first, rest = pa.array([self.lang + b"\t" + w for w in names], pa.binary()), pa.array(names, pa.binary())
        if self.words:
            n = np.bincount(ids, minlength=len(names))[real]
            yield batch(first.filter(pa.array(real)), n)
            yield batch(pa.array([self.lang + b"\t"], pa.binary()), np.array([n.sum()]))
        if self.filters is None:
            return
        word = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in names), np.uint64, len(names))
        every, lately = self.filters
        inside, hashes = real[ids], (self.root ^ word)[ids]
        fresh, real_here = (holds(lately, self.root ^ word) & real)[ids], inside
        for n in range(2, LONGEST + 1):
            # from phrases of n - 1 words at each place to those of n: one half reached lately, both at all
            inside = inside[:-1] & real_here[n - 1 :]
            active = np.flatnonzero(inside & (fresh[:-1] | fresh[1:]))
            active = active[holds(every, hashes[active])]
            active = active[holds(every, hashes[active + 1])]
            if len(active):
                for at, counts in distinct(n, ids, active):
                    columns = [first.take(pa.array(at[0])), *(rest.take(pa.array(a)) for a in at[1:])]
                    yield batch(pc.binary_join_element_wise(*columns, b" "), counts)
            places = np.flatnonzero(inside)
            if n == LONGEST or not len(places):
                break
            hashes = turned(hashes[:-1]) ^ word[ids[n - 1 :]]
            fresh = np.zeros(len(hashes), bool)
            fresh[places] = holds(lately, hashes[places])


def distinct(n: int, ids: np.ndarray, places: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Word numbers of each phrase of n words at these places, word by word, and its count; ROWS at a time."""
    key = ids[places].astype(np.int64) << 32 | ids[places + 1]
    if n == 2:
        pairs, counts = np.unique(key, return_counts=True)
        words = [pairs >> 32, pairs & 0xFFFFFFFF]
    else:
        for k in range(2, n):
            key = np.unique(key, return_inverse=True)[1] << 32 | ids[places + k]
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        words = [ids[places[first] + k] for k in range(n)]
    for i in range(0, len(counts), ROWS):
        yield [w[i : i + ROWS] for w in words], counts[i : i + ROWS]


def batch(keys: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"key": keys, "cnt": pa.array(counts, pa.int64())})


def scan(shard: DataFrame, step: int, words: bool, shipped: Broadcast, limit: int = FLUSH) -> DataFrame:
    """(key, cnt, step): counts of the phrases of a shard that may be active by the shipped filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, Counter] = {}
        for rows in batches:
            for lang, text in zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist(), strict=True):
                if lang not in counters:
                    counters[lang] = Counter(lang, words, shipped.value, limit)
                yield from counters[lang].add(text)
            while sum(c.held for c in counters.values()) > 2 * limit:  # many languages at once
                yield from max(counters.values(), key=lambda c: c.held).flush()
        for c in counters.values():
            yield from c.flush()

    counted = shard.mapInArrow(run, "key binary, cnt long").select(F.col("key").cast("string").alias("key"), "cnt")
    return counted.groupBy("key").agg(F.sum("cnt").alias("cnt")).withColumn("step", F.lit(step))


def halves(df: DataFrame) -> DataFrame:
    """df with head and tail: the phrase without its last and without its first word."""
    head = F.expr("substring(phrase, 1, length(phrase) - length(substring_index(phrase, ' ', -1)) - 1)")
    return df.withColumns({"head": head, "tail": F.expr("substring(phrase, instr(phrase, ' ') + 1)")})


def frequent(documents: DataFrame, least: int = LEAST, shards: int = SHARDS, flush: int = FLUSH, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Phrases of up to LONGEST words with a count of at least least: (lang, n, phrase, a), stored; and (lang, n) of all words."""
    kept = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text")).where("length(text) > 0")
    texts = stored(kept.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")), "shard")
    counts: dict[int, DataFrame] = {}  # of the scans of the last cycle
    judged: list[DataFrame] = []
    totals: list[DataFrame] = []
    filters: Filter | None = None
    step = 0
    while step < shards or filters[1].any():
        shipped = documents.sparkSession.sparkContext.broadcast(filters)
        counts[step] = stored(scan(texts.where(F.col("shard") == step % shards).select("lang", "text"), step, step < shards, shipped, flush))
        shipped.destroy()
        if step < shards:
            totals.append(checkpointed(counts[step].where(F.endswith("key", F.lit("\t"))).select(F.expr("left(key, length(key) - 1)").alias("lang"), "cnt")))  # a row a language
        heavy = stored(union(list(counts.values())).where(F.col("cnt") >= -(-least // shards)).select("key").distinct())
        judged.append(stored(judge(counts, heavy, union(judged), step, shards, least)))
        discard(heavy)
        if step + 1 - shards in counts:
            discard(counts.pop(step + 1 - shards))
        reached = union(judged).where((F.col("reach") >= 0) & (F.col("n") < LONGEST))
        size = 1 << (64 + PER_PHRASE * reached.count()).bit_length()
        filters = filter_bits(reached, F.col("reach") > step - shards, min(bits, size))
        step += 1
    out = stored(union(judged).where("complete").select("lang", "n", "phrase", "a"))
    discard(texts, *counts.values(), *judged)
    return out, union(totals).groupBy("lang").agg(F.sum("cnt").alias("n"))


def union(tables: list[DataFrame]) -> DataFrame | None:
    return reduce(DataFrame.unionByName, tables) if tables else None


def judge(counts: dict[int, DataFrame], heavy: DataFrame, judged: DataFrame | None, step: int, shards: int, least: int) -> DataFrame:
    """(lang, n, phrase, a, reach, complete) of phrases that reach the threshold in this scan (reach, else -1) or complete their cycle with it.

    counts: of the scans of the last cycle. A phrase starts after the later of its halves' reach, a word at 0;
    counts of scans before that are of no account. Whoever reaches the threshold in a cycle has its part of it in
    one scan at least, so the many rare phrases needn't meet: only rows of keys that have that (heavy) are added up.
    """
    rows = union(list(counts.values()))
    upto = lambda end: sum((F.when(F.col("start") <= s, F.col(f"c{s}")).otherwise(0) for s in counts if s <= end), F.lit(0).cast("long"))
    hashed = heavy.select(F.xxhash64("key").alias("h")).distinct()  # a key that shares a hash is added up in vain
    per = rows.join(small(hashed, HEAVY), F.xxhash64(rows["key"]) == F.col("h"), "left_semi").groupBy("key").agg(*(F.coalesce(F.sum(F.when(F.col("step") == s, F.col("cnt"))), F.lit(0)).alias(f"c{s}") for s in counts))
    per = per.where(sum(F.col(f"c{s}") for s in counts) >= least).withColumn("phrase", F.substring_index("key", "\t", -1)).where("phrase != ''")
    per = per.withColumns({"lang": F.expr("left(key, length(key) - length(phrase) - 1)"), "n": F.expr("length(phrase) - length(replace(phrase, ' ', '')) + 1")})
    if judged is None:
        started = per.where("n = 1").withColumn("start", F.lit(0))
    else:
        reach = judged.where("reach >= 0").select("lang", "phrase", "reach")
        both = halves(per).join(reach.select("lang", F.col("phrase").alias("head"), F.col("reach").alias("r1")), ["lang", "head"], "left").join(reach.select("lang", F.col("phrase").alias("tail"), F.col("reach").alias("r2")), ["lang", "tail"], "left")
        started = both.withColumn("start", F.when(F.col("n") == 1, 0).when(F.col("r1").isNotNull() & F.col("r2").isNotNull(), F.greatest("r1", "r2") + 1))
    active = started.where((F.col("start") <= step) & (F.col("start") > step - shards)).withColumns({"a": upto(step), "before": upto(step - 1)}).where(F.col("a") >= least)
    out = active.select("lang", "n", "phrase", "a", F.when(F.col("before") < least, step).otherwise(-1).alias("reach"), (F.col("start") == step + 1 - shards).alias("complete"))
    return out.where("reach >= 0 OR complete")


def collocations(documents: DataFrame, least: int = LEAST, top: int = TOP, shards: int = SHARDS, flush: int = FLUSH, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first top phrases of each language.

    documents(lang, text).
    """
    found, totals = frequent(documents, least, shards, flush, bits)
    words = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    cuts = F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k")
    cut = found.where("n > 1").select("lang", "n", "phrase", "a", cuts).withColumns({"left": part(F.lit(1), F.col("k")), "right": part(F.col("k") + 1, F.col("n") - F.col("k"))})
    whole = found.select("lang", "phrase", "a")
    cut = cut.join(whole.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"]).join(whole.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    cut = cut.withColumn("score", F.expr("(2000000BD * cast(a as decimal(20, 0))) div cast(l + r as decimal(20, 0))"))
    lowest = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.*")
    longer = halves(found.where("n > 2"))
    around = longer.select("lang", F.explode(F.array("head", "tail")).alias("phrase"), F.col("a").alias("most")).groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    left = lowest.join(around, ["lang", "phrase"], "left").where("most IS NULL OR cast(100 as decimal(3, 0)) * cast(most as decimal(20, 0)) < cast(80 as decimal(2, 0)) * cast(a as decimal(20, 0))")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(32))).orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    ranked = ranked.join(F.broadcast(totals), "lang")  # a row a language
    done = checkpointed(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))  # top rows a language
    discard(found)
    return done
