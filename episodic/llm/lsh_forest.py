"""MinHash near-duplicates with an LSH forest.

A document's set is its distinct shingles of SHINGLE words. TREES sorted orders are kept, each over the
documents' labels of DEPTH min-hashes (DEEP for order inside a region). In an order, documents with a
common prefix stand together; a region with a common prefix of SHORTEST min-hashes and at most REGION
documents yields all its pairs as candidates; a larger one is parted by its next min-hash, so depth
adapts to each region. Regions that are still larger at full depth are taken in three steps:

1. neighbours with the longest common prefix in some of the orders, and each document with the region's
   hub (the one that stands in the largest regions; in a large group of copies the one the others were
   made from), are candidates like the others;
2. once links are confirmed, the documents outside the main component of their regions are set apart
   (regions that share documents count as one);
3. these are query blocks: every document of the regions streams past the blocks and is compared on full
   sets with what shares one of its rarest shingles there (prefix filtering, exact). No pair of a link's
   sides is left out, no pairs are listed, and blocks and chunks are of bounded size.

How rows are dealt to tasks follows counts of prefixes on a sixteenth of the documents: a prefix frequent
there is dealt by a longer one, and beyond DEEP by id. These counts decide about tasks only.

Documents with equal sets are one class from the start, so a group of copies costs one comparison.
Candidates whose min-hash signatures differ too much are dropped (by more than SLACK below the threshold:
5.4 standard deviations at 0.85), all others are confirmed on the full sets. Components grow by exchanging
smallest neighbours until nothing changes; nothing goes to the driver but counts and frequent prefixes.

Null and empty texts have empty sets and are linked with nothing; a text with fewer words than a shingle
is one shingle. Null ids are linked with nothing and kept. Rows with one id and unlike sets are documents
of their own; component ids are the smallest id of a component. Texts of any length are read whole; ties
of min-hashes don't matter. An empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, discard, hash_words, small, stored

TREES = 24
DEPTH = 6
DEEP = 8
HASHES = TREES * DEPTH
SHORTEST = 3
REGION = 32
SLACK = 0.16
#: One order in so many gives neighbours in large regions.
NEIGHBOURS = 3
#: Shingles in a block of queries, and in a chunk of the documents that stream past it.
BLOCK = 200_000
CHUNK = 250_000
_SEEDS = np.random.RandomState(20240501).randint(1, 1 << 32, (2, HASHES), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_A = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def shingle_set(text: str, n: int) -> np.ndarray:
    """Sorted hashes of a text's distinct n-word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only
    if not words:
        return np.empty(0, np.uint64)
    h = hash_words(words)
    if len(h) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(h))], np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ (out >> np.uint64(31))) * _A[i % 3] + h[i : len(h) - n + 1 + i]
    out = (out ^ (out >> np.uint64(32))) * _A[1]
    return np.unique(out ^ (out >> np.uint64(29)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of HASHES min-hashes."""
    low, high = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 128):
        best = np.minimum(best, (low[i : i + 128, None] * _SEEDS[0] + (high[i : i + 128, None] ^ _SEEDS[1])).min(0))
    return (best & np.uint32(0xFFFF)).astype("<u2")


def signed(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, d1 and d2 (digest of the set), sig of each row of docs(doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size, d1, d2, sigs = [], [], [], []
            for text in batch["text"]:
                s = shingle_set(text, n) if isinstance(text, str) else np.empty(0, np.uint64)
                h = xxhash.xxh3_128_intdigest(s.tobytes())
                size.append(len(s))
                d1.append((h >> 64) - (1 << 63))
                d2.append(h % (1 << 64) - (1 << 63))
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text_hash": batch["text_hash"], "n_shingles": size, "d1": d1, "d2": d2, "sig": sigs})

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInPandas(run, "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, sig binary")


def prefix_keys(labels: np.ndarray) -> dict[int, np.ndarray]:
    """64-bit keys of the prefixes of labels (documents x trees x DEEP), by their length from SHORTEST on."""
    key = np.broadcast_to(np.arange(1, labels.shape[1] + 1, dtype=np.uint64) * _A[0], labels.shape[:2])
    out = {}
    for d in range(DEEP):
        key = (key ^ (key >> np.uint64(29)) ^ labels[:, :, d]) * _A[1] + _A[2]
        if d + 1 >= SHORTEST:
            out[d + 1] = (key ^ (key >> np.uint64(32))).view(np.int64)
    return out


def labels_of(sigs: pd.Series) -> np.ndarray:
    """Labels of DEEP min-hashes of each order: the order's own DEPTH ones, then those of the next."""
    flat = np.frombuffer(b"".join(sigs), "<u2").reshape(-1, HASHES)
    return np.stack([np.roll(flat, -DEPTH * t, 1)[:, :DEEP] for t in range(TREES)], 1)


def frequent_prefixes(reps: DataFrame) -> np.ndarray:
    """Keys of prefixes with over REGION documents, and over a share of all, among a sixteenth of the documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                keys, times = np.unique(np.concatenate([k.ravel() for k in prefix_keys(labels_of(batch["sig"])).values()]), return_counts=True)
                yield pd.DataFrame({"key": keys, "times": times})

    sample = reps.where(F.xxhash64("id") % 16 == 0)
    least = max(REGION, sample.count() // 20_000)
    found = sample.select("sig").mapInPandas(run, "key long, times long").groupBy("key").agg(F.sum("times").alias("n")).where(F.col("n") > least)
    return np.sort(np.array([r.key for r in found.select("key").collect()], np.int64))


def orders(reps: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(deal, tree, depth, label, id, size) of every representative in every order; deal is the key of its shortest prefix that is not frequent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            labels = labels_of(batch["sig"])
            keys = prefix_keys(labels)
            deal, depth = keys[SHORTEST].copy(), np.full(labels.shape[:2], SHORTEST, np.int32)
            hot = np.isin(deal, frequent)
            for d in range(SHORTEST + 1, DEEP + 1):
                deal[hot], depth[hot] = keys[d][hot], d
                hot &= np.isin(keys[d], frequent)
            deal[hot] += np.broadcast_to(batch["id"].to_numpy()[:, None], hot.shape)[hot] % 64
            raw, width = labels.astype(">u2").tobytes(), 2 * DEEP
            yield pd.DataFrame({
                "deal": deal.ravel(), "tree": np.tile(np.arange(TREES, dtype=np.int32), len(labels)), "depth": depth.ravel(), "label": [raw[i : i + width] for i in range(0, len(raw), width)],
                "id": np.repeat(batch["id"].to_numpy(), TREES), "size": np.repeat(batch["n_shingles"].to_numpy(), TREES),
            })

    return reps.select("id", "n_shingles", "sig").mapInPandas(run, "deal long, tree int, depth int, label binary, id long, size long")


def region_pairs(rows: list[tuple], tree: int, threshold: int, depth: int) -> Iterator[tuple]:
    """Rows (a, b, tree, region, size) of members (label, id, size) in order of labels that share depth min-hashes.

    Candidates a < b have no region; members of regions larger than REGION at full depth have no b.
    """
    if len(rows) <= REGION and depth <= DEPTH:
        near = combinations(rows, 2)
    elif depth < DEPTH:
        at = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i][0][: 2 * depth + 2] != rows[at][0][: 2 * depth + 2]:
                if i > at + 1:
                    yield from region_pairs(rows[at:i], tree, threshold, depth + 1)
                at = i
        return
    else:
        yield from ((i, -1, tree, label[: 2 * DEPTH], size) for label, i, size in rows)
        near = zip(rows, rows[1:], strict=False) if tree % NEIGHBOURS == 0 else ()
    for x, y in near:
        if 100 * min(x[2], y[2]) >= threshold * max(x[2], y[2]) and x[1] != y[1]:
            yield min(x[1], y[1]), max(x[1], y[1]), -1, None, 0


def forest(placed: DataFrame, threshold: int) -> DataFrame:
    """What region_pairs gives of all regions; a prefix dealt beyond DEPTH is known to be a large region."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list[np.ndarray]] = []

        def done(columns: list[np.ndarray]) -> pd.DataFrame:
            """Of whole groups of one deal key; single rows have no partner unless their region is known to be large."""
            deal, tree, depth, label, ids, size = columns
            first = np.nonzero(np.append(True, deal[1:] != deal[:-1]))[0]
            last = np.append(first[1:], len(deal))
            found: dict[tuple, None] = {}
            wanted = (last - first > 1) | (depth[first] > DEPTH)
            for a, b in zip(first[wanted].tolist(), last[wanted].tolist(), strict=True):
                rows = list(zip(label[a:b].tolist(), ids[a:b].tolist(), size[a:b].tolist(), strict=True))
                found.update(dict.fromkeys(region_pairs(rows, int(tree[a]), threshold, int(depth[a]))))
            return pd.DataFrame(list(found), columns=["a", "b", "tree", "region", "size"])

        for batch in batches:
            if not len(batch):
                continue
            columns = [batch[c].to_numpy() for c in ("deal", "tree", "depth", "label", "id", "size")]
            if held and columns[0][0] != held[-1][0][-1]:
                yield done([np.concatenate(x) for x in zip(*held, strict=True)])
                held = []
            last = int(np.searchsorted(columns[0], columns[0][-1]))  # the last group may go on
            if last:
                whole = [*held, [c[:last] for c in columns]]
                yield done([np.concatenate(x) for x in zip(*whole, strict=True)])
                held = []
            held.append([c[last:] for c in columns])
        if held:
            yield done([np.concatenate(x) for x in zip(*held, strict=True)])

    return placed.repartition("deal").sortWithinPartitions("deal", "label", "id").mapInPandas(run, "a long, b long, tree int, region binary, size long")


def hub_pairs(large: DataFrame) -> DataFrame:
    """(id, hub, size, hub_size) of the members large(tree, region, id, size) of large regions; the hub stands in the largest regions over all orders."""
    counts = large.groupBy("tree", "region").agg(F.count(F.lit(1)).alias("n"))
    weight = large.join(small(counts), ["tree", "region"]).groupBy("id").agg(F.sum("n").alias("weight"))
    hubs = large.join(weight, "id").groupBy("tree", "region").agg(F.max(F.struct("weight", (-F.col("id")).alias("low"), "size")).alias("h"))
    hubs = hubs.select("tree", "region", (-F.col("h.low")).alias("hub"), F.col("h.size").alias("hub_size"))
    return stored(large.join(small(hubs), ["tree", "region"]).select("id", "hub", "size", "hub_size").distinct())


def block_links(members: list[np.ndarray], kin: list[int], queries: list[np.ndarray], query_kin: list[int], threshold: int) -> Iterator[tuple[int, int]]:
    """(member, query) of linked sets of unlike kin, for each query and kin of members once.

    Linked sets share a shingle among the rarest of each, as many as may be missing and one; rarity is by
    the count in the block, so what is not in it comes first.
    """
    values, count = np.unique(np.concatenate(queries), return_counts=True)
    rare: dict[int, list[int]] = {}

    def rarest(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(values, s), len(values) - 1)
        times = np.where(values[at] == s, count[at], 0)
        order = np.lexsort((s, times))[: len(s) + threshold * len(s) // -100 + 1]
        return at[order], times[order]

    for q, s in enumerate(queries):
        for x in rarest(s)[0].tolist():
            rare.setdefault(x, []).append(q)
    seen: set[tuple[int, int]] = set()
    for m, s in enumerate(members):
        at, times = rarest(s)
        for q in {q for x in at[times > 0].tolist() for q in rare.get(x, ())}:
            t = queries[q]
            if kin[m] != query_kin[q] and (q, kin[m]) not in seen and 100 * min(len(s), len(t)) >= threshold * max(len(s), len(t)):
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= threshold * (len(s) + len(t) - both):
                    seen.add((q, kin[m]))
                    yield m, q


def rest_links(hubs: DataFrame, grouped: DataFrame, texts_of: Callable[[DataFrame], DataFrame], n: int, threshold: int) -> DataFrame:
    """Links (a, b) between documents outside the main component of their regions and any of these regions' documents in another component."""
    joined = components(hubs.select(F.col("id").alias("a"), F.col("hub").alias("b")))
    d = joined.select("id", F.col("component").alias("area")).join(hubs.groupBy("id").agg(F.first("size").alias("size")), "id")
    d = d.join(grouped, "id", "left").withColumn("kin", F.coalesce("component", "id")).drop("component")
    main = d.groupBy("area", "kin").agg(F.count(F.lit(1)).alias("n")).groupBy("area").agg(F.max(F.struct("n", "kin")).alias("m"))
    d = checkpointed(d.join(small(main.select("area", F.col("m.kin").alias("main"))), "area"))
    out = F.col("kin") != F.col("main")
    ceiling = lambda c, budget: F.ceil(c / F.lit(budget)).cast("long")
    areas = d.groupBy("area").agg(ceiling(F.sum("size"), CHUNK).alias("chunks"), ceiling(F.sum(F.when(out, F.col("size"))), BLOCK).alias("blocks")).where("blocks > 0")
    d = d.join(small(areas), "area")
    d = d.join(texts_of(d.select("id")), "id")
    some = lambda c: F.pmod(F.xxhash64("id"), F.col(c))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    members = d.select("area", some("chunks").alias("chunk"), every("blocks").alias("block"), "id", "kin", "text")
    queries = d.where(out).select("area", every("chunks"), some("blocks"), "id", "kin", "text").toDF("its_area", "its_chunk", "its_block", "id", "kin", "text")

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(x) and len(y):
            sets = [[shingle_set(t, n) for t in side["text"]] for side in (x, y)]
            ids = x["id"].tolist(), y["id"].tolist()
            rows = [(ids[0][m], ids[1][q]) for m, q in block_links(sets[0], x["kin"].tolist(), sets[1], y["kin"].tolist(), threshold)]
        return pd.DataFrame(rows, columns=["a", "b"]).astype("int64")

    grid = members.groupBy("area", "chunk", "block").cogroup(queries.groupBy("its_area", "its_chunk", "its_block"))
    return checkpointed(grid.applyInPandas(compare, "a long, b long"))


def likely(pairs: DataFrame, reps: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose signatures don't rule out a link."""
    least = (threshold / 100 - SLACK) * HASHES
    short = reps.select("id", "sig")

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=bool)
        a, b = (np.frombuffer(b"".join(s), "<u2").reshape(len(x), HASHES) for s in (x, y))
        return pd.Series((a == b).sum(1) >= least)

    both = pairs.join(short.withColumnsRenamed({"id": "a", "sig": "sa"}), "a").join(short.withColumnsRenamed({"id": "b", "sig": "sb"}), "b")
    return both.where(near("sa", "sb")).select("a", "b")


def confirmed(pairs: DataFrame, texts_of: Callable[[DataFrame], DataFrame], n: int, threshold: int) -> DataFrame:
    """Pairs whose full sets are alike enough; texts_of gives (id, text) of ids."""
    texts = texts_of(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        last, a, out = None, None, []
        for s, t in zip(x, y, strict=True):
            if s is not last and s != last:
                last, a = s, shingle_set(s, n)
            b = shingle_set(t, n)
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * both >= threshold * (len(a) + len(b) - both))
        return pd.Series(out, dtype=bool)

    both = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "ta"}), "a").join(texts.withColumnsRenamed({"id": "b", "text": "tb"}), "b")
    return both.where(linked("ta", "tb")).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links(a, b); component is the smallest id reachable.

    Large star and small star in turn: every id is linked to the smallest of its neighbourhood, until the
    links no longer change; the number of rounds is logarithmic in the length of paths.
    """
    edges = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = checkpointed(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if now == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        state = now


def near_duplicates(docs: DataFrame, n: int = 5, threshold: int = 80) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept) of each row of docs(doc_id, text); linked at threshold percent of n-word shingles.

    text_hash is Spark's xxhash64 of the text; with doc_id it tells rows apart.
    """
    rows = stored(signed(docs, n))
    classes = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.min_by("text_hash", "doc_id").alias("text_hash"))
    # a class is known by its smallest doc_id; further classes with the same one get a key of their own
    digest = F.struct("d1", "d2")
    classes = classes.withColumn("id", F.when(digest == F.min(digest).over(Window.partitionBy("doc_id")), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "d1", "d2")))
    classes = stored(classes)
    reps = rows.withColumnRenamed("text_hash", "own").join(classes.select("d1", "d2", "doc_id", "id", "text_hash"), ["d1", "d2", "doc_id"]).where("own = text_hash")
    reps = stored(reps.select("id", "doc_id", "text_hash", "n_shingles", "sig").dropDuplicates(["id"]))

    def texts(ids: DataFrame) -> DataFrame:
        keys = reps.join(ids, "id", "left_semi").select("doc_id", "text_hash", "id")
        # both sides grow with the documents
        return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").join(keys.hint("merge"), ["doc_id", "text_hash"]).select("id", "text").dropDuplicates(["id"])

    found = stored(forest(orders(reps, frequent_prefixes(reps)), threshold))
    large = found.where("region IS NOT NULL").select("tree", "region", F.col("a").alias("id"), "size")
    hubs = hub_pairs(large)
    near_hub = hubs.where(f"id <> hub AND 100 * least(size, hub_size) >= {threshold} * greatest(size, hub_size)").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    pairs = found.where("region IS NULL").select("a", "b").unionByName(near_hub).distinct()
    candidates = stored(likely(pairs, reps, threshold))
    grouped = components(confirmed(candidates, texts, n, threshold))
    if not hubs.isEmpty():
        more = rest_links(hubs, grouped, texts, n, threshold)
        if not more.isEmpty():
            grouped = components(grouped.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    discard(found, hubs, candidates, reps)
    # components are named by the smallest doc_id in them
    named = classes.select("d1", "d2", "doc_id", "id").join(grouped, "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = named.join(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("d1", "d2", "component_id")
    out = rows.select("doc_id", "text_hash", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.withColumn("component_id", component)
    return out.select("doc_id", "text_hash", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
