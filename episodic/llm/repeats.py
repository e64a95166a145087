"""Repeats of K consecutive tokens over a whole corpus: what exact-substring operators share.

A window of K tokens is anchored at its smallest m-gram (by hash, leftmost of equal ones), so equal
windows have their anchor at the same place. Consecutive windows with one anchor form a run. Only runs
whose anchor gram occurs more than once can hold a repeat:

1. grams of runs are listed with their document and counted with partial sums, single ones dropped;
2. runs at the remaining grams are cut from their documents; equal ones become one content with its
   count and first occurrence (a combine before the shuffle: a task sends a content's tokens once);
3. contents are dealt by gram, read in sorted order and judged in chunks of bounded size by the
   operator's matcher, which knows a content's count: all repeats, those of copies and those inside a
   document too, are the matcher's;
4. a gram with more than HOT contents is not one group: its windows are dealt by longer prefixes (half a
   window, then a whole one, where a group is one content), and judged like the others;
5. what the matcher found comes back as ranges per document: of the first occurrence of a content directly,
   of its further ones by a join on the content's hash.

No pair of documents, no list of a gram's members and no group is ever held whole; chunks are bounded.
Documents are known by their id and a 64-bit hash of id and text, contents by 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, discard, small, stored

HOT = 20_000
#: Tokens judged at once; tokens of documents looked at at once, and of one document.
CHUNK = 1_000_000
BATCH = 300_000
SEGMENT = 4_000_000
_A = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)

#: Places in contents: which content, and the start of a window in it.
Places = tuple[np.ndarray, np.ndarray]
#: (contents as token arrays, count of each, its first occurrence as rows (document, row, start), anchor's place in it)
#: -> windows that are repeats in the first occurrence of their content, and those that are in further ones
Matcher = Callable[[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray], tuple[Places, Places]]

_PIECES = "gram long, content binary, h1 long, h2 long, ord long, rid long, starts array<int>, n int, off int, times long"


def gram_hashes(tokens: np.ndarray, m: int) -> np.ndarray:
    """64-bit hashes of all m-grams of unsigned tokens."""
    h = (tokens.astype(np.uint64) + _A[3]) * _A[0]
    h ^= h >> np.uint64(32)
    width, step = 1, 0
    while 2 * width <= m:
        step += 1
        h = h[:-width] * _A[step % 4] + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    if width < m:
        h = h[: len(h) - (m - width)] * _A[1] + h[m - width :]
        h ^= h >> np.uint64(29)
    return h * _A[2]


def runs(texts: list[np.ndarray], k: int, m: int) -> tuple[np.ndarray, ...]:
    """Document, first window, number of windows, anchor and anchor gram of each run of windows with one anchor.

    Documents are looked at many at a time; a very long one in overlapping parts.
    """
    parts = [(i, at, t[at : at + SEGMENT + k - 1]) for i, t in enumerate(texts) for at in range(0, len(t) - k + 1, SEGMENT)]
    out, held, size = [], [], 0
    for i, part in enumerate(parts):
        held.append(part)
        size += len(part[2])
        if size < BATCH and i + 1 < len(parts):
            continue
        length = np.array([len(x[2]) for x in held])
        end = np.cumsum(length)
        owner = np.repeat(np.arange(len(held)), length)
        gram = gram_hashes(np.concatenate([x[2] for x in held]), m)
        low = (gram >> np.uint64(24) << np.uint64(24)) | np.arange(len(gram), dtype=np.uint64)
        width, most = 1, k - m + 1
        while width < most:
            step = min(width, most - width)
            low = np.minimum(low[:-step], low[step:])
            width += step
        window = np.nonzero(np.arange(size - k + 1) + k <= end[owner[: size - k + 1]])[0]  # windows don't cross documents
        anchor = (low[window] & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.nonzero(np.append(True, anchor[1:] != anchor[:-1]))[0]
        who = owner[window[first]]
        shift = np.array([x[1] for x in held])[who] - (end - length)[who]
        out.append((np.array([x[0] for x in held])[who], window[first] + shift, np.diff(np.append(first, len(anchor))), anchor[first] + shift, gram[anchor[first]].view(np.int64)))
        held, size = [], 0
    if not out:
        return (np.empty(0, np.int64),) * 5
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def ranges(who: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of consecutive places, given in any order: owner, first, one after the last."""
    by = np.lexsort((at, who))
    who, at = who[by], at[by]
    first = np.nonzero(np.append(True, (who[1:] != who[:-1]) | (at[1:] - at[:-1] > 1)))[0] if len(who) else by
    last = np.append(first[1:], len(who)) - 1 if len(who) else by
    return who[first], at[first], at[last] + 1


#: A text's tokens, and the bytes of its tokens from one place to another.
Parse = Callable[[str], tuple[np.ndarray, Callable[[int, int], bytes]]]


def halves(hashed: int) -> tuple[int, int]:
    return hashed % (1 << 64) - (1 << 63), (hashed >> 64) - (1 << 63)


def judged(pieces: DataFrame, unpack: Callable[[bytes], np.ndarray], slice_: Callable[[bytes, int], list[bytes]], k: int, match: Matcher, hot: int, prefixes: tuple[int, ...]) -> DataFrame:
    """(ord, rid, a, b): ranges of window starts that are repeats, of the occurrences in pieces; prefixes: the lengths by which hot groups are dealt."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        group: list = []  # of one gram; a single content that occurs once has nothing to be compared with
        size = 0

        def flush() -> pd.DataFrame:
            columns = [np.array(x) for x in zip(*(r[2:] for r in held), strict=True)]  # cnt, ord, rid, start, off, h1, h2
            first = np.stack(columns[1:4], 1)
            parts = []
            for later, places in enumerate(match([unpack(r[1]) for r in held], columns[0], first, columns[4])):
                c, a, b = ranges(*places)
                if later:
                    c, a, b = (x[columns[0][c] > 1] for x in (c, a, b))
                shift = 0 if later else first[c, 2]
                parts.append(pd.DataFrame({"later": bool(later), "h1": columns[5][c], "h2": columns[6][c], "ord": first[c, 0], "rid": first[c, 1], "start": first[c, 2], "a": a + shift, "b": b + shift}))
            return pd.concat(parts, ignore_index=True)

        for batch in batches:
            for row in batch[["gram", "content", "cnt", "f_ord", "f_rid", "f_start", "off", "h1", "h2"]].itertuples(index=False, name=None):
                if group and row[0] != group[-1][0]:
                    if len(group) > 1 or group[0][2] > 1:
                        held += group
                        size += sum(len(x[1]) for x in group)
                    group = []
                    if size > CHUNK:
                        yield flush()
                        held, size = [], 0
                group.append(row)
        if len(group) > 1 or group and group[0][2] > 1:
            held += group
        if held:
            yield flush()

    def lengthened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each window as a piece of its own, dealt by its first tokens."""
        for batch in batches:
            out = []
            for content, cnt, order, rid, start in batch[["content", "cnt", "f_ord", "f_rid", "f_start"]].itertuples(index=False, name=None):
                for w, (window, prefix) in enumerate(zip(slice_(content, k), slice_(content, prefixes[0]), strict=False)):
                    out.append((xxhash.xxh3_64_intdigest(prefix) - (1 << 63), window, *halves(xxhash.xxh3_128_intdigest(window)), order, rid, [start + w], 1, 0, cnt))
            yield pd.DataFrame(out, columns=["gram", "content", "h1", "h2", "ord", "rid", "starts", "n", "off", "times"])

    lead = F.struct("ord", "rid", F.col("starts")[0].alias("start"))
    contents = pieces.groupBy("gram", "h1", "h2").agg(F.sum("times").alias("cnt"), F.min(lead).alias("lead"), F.first("content", ignorenulls=True).alias("content"), F.first("off").alias("off"), F.first("n").alias("n"))
    contents = stored(contents.select("gram", "h1", "h2", "content", "off", "n", "cnt", F.col("lead.ord").alias("f_ord"), F.col("lead.rid").alias("f_rid"), F.col("lead.start").alias("f_start")))
    over = checkpointed(contents.groupBy("gram").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > hot).select("gram"))
    split = bool(prefixes) and not over.isEmpty()
    whole = contents.join(small(over), "gram", "left_anti") if split else contents
    dealt = whole.repartition("gram").sortWithinPartitions("gram", "h1")
    found = stored(dealt.mapInPandas(compare, "later boolean, h1 long, h2 long, ord long, rid long, start int, a int, b int"))
    out = found.where("NOT later").select("ord", "rid", "a", "b")
    later = found.where("later").drop("later")
    if split:
        rest = contents.join(small(over), "gram", "left_semi")
        out = out.unionByName(judged(stored(rest.mapInPandas(lengthened, _PIECES)), unpack, slice_, k, match, hot, prefixes[1:]))
        # each window of a content that occurs more than once is a repeat in its further occurrences
        later = later.unionByName(rest.where("cnt > 1").selectExpr("h1", "h2", "f_ord AS ord", "f_rid AS rid", "f_start AS start", "0 AS a", "n AS b"))
    later = later.withColumnsRenamed({"ord": "f_ord", "rid": "f_rid", "start": "f_start"})
    places = pieces.select("h1", "h2", "ord", "rid", F.col("starts")).join(later, ["h1", "h2"])
    places = places.select("ord", "rid", "f_ord", "f_rid", "f_start", "a", "b", F.explode("starts").alias("start")).where("NOT (ord = f_ord AND rid = f_rid AND start = f_start)")
    return out.unionByName(places.selectExpr("ord", "rid", "start + a AS a", "start + b AS b"))


def repeated_windows(keyed: DataFrame, parse: Parse, unpack: Callable[[bytes], np.ndarray], slice_: Callable[[bytes, int], list[bytes]], k: int, m: int, match: Matcher, hot: int = HOT) -> DataFrame:
    """(ord, rid, spans) of keyed(ord, rid, text): per document with repeats, the ranges of window starts that are repeats by match.

    unpack gives the tokens of what parse cut, slice_ all its slices of so many tokens.
    """

    def list_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.iloc[i : i + 256]
                who, _, _, _, gram = runs([parse(text)[0] for text in part["text"]], k, m)
                by = np.lexsort((gram, who))
                who, gram = who[by], gram[by]
                first = np.nonzero(np.append(True, (who[1:] != who[:-1]) | (gram[1:] != gram[:-1])))[0] if len(who) else by
                yield pd.DataFrame({"ord": part["ord"].to_numpy()[who[first]], "rid": part["rid"].to_numpy()[who[first]], "gram": gram[first], "times": np.diff(np.append(first, len(who)))})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent: set[int] = set()  # contents this task has given already
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.iloc[i : i + 256]
                parsed = [parse(text) for text in part["text"]]
                found = runs([p[0] for p in parsed], k, m)
                frequent = np.isin(found[4], np.unique(np.concatenate(part["grams"].to_list())))  # a gram is frequent everywhere
                here: dict[tuple[int, int], list] = {}
                order, rid = part["ord"].tolist(), part["rid"].tolist()
                for who, start, n, anchor, gram in zip(*(x[frequent].tolist() for x in found), strict=True):
                    content = parsed[who][1](start, start + n + k - 1)
                    h = xxhash.xxh3_128_intdigest(content, anchor - start)
                    if (at := here.get((who, h))) is not None:
                        at[6].append(start)
                        at[9] += 1
                    else:
                        here[who, h] = [gram, None if h in sent else content, *halves(h), order[who], rid[who], [start], n, anchor - start, 1]
                        sent.add(h)
                if len(sent) > 200_000:
                    sent.clear()
                yield pd.DataFrame(list(here.values()), columns=["gram", "content", "h1", "h2", "ord", "rid", "starts", "n", "off", "times"])

    texts = keyed.select("ord", "rid", "text")
    listed = stored(texts.mapInPandas(list_grams, "ord long, rid long, gram long, times long"))
    often = listed.groupBy("gram").agg(F.sum("times").alias("often")).where("often > 1").select("gram")
    wanted = stored(listed.join(often, "gram").groupBy("ord", "rid").agg(F.collect_list("gram").alias("grams")))
    discard(listed)
    pieces = stored(texts.join(wanted, ["ord", "rid"]).mapInPandas(cut, _PIECES))
    discard(wanted)
    found = judged(pieces, unpack, slice_, k, match, hot, (k // 2, k))
    return stored(found.groupBy("ord", "rid").agg(F.collect_list(F.struct("a", "b")).alias("spans")))


def keyed_rows(df: DataFrame, text: str, order: str, rid: str) -> DataFrame:
    """df with text never null, order (the id, nulls last) and rid (a hash of the id and the text)."""
    d = df.withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit("")))
    return d.withColumns({order: F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), rid: F.xxhash64("doc_id", text)})


def covered(spans, k: int, n: int) -> np.ndarray:
    """Which of n tokens lie in a window whose start is in one of the ranges."""
    mark = np.zeros(n + 1, np.int64)
    if spans is not None:
        for s in spans:
            mark[s["a"]] += 1
            mark[min(s["b"] - 1 + k, n)] -= 1
    return np.cumsum(mark)[:n] > 0
