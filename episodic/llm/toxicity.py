"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel of two words counts the subsequences of three characters that they share, each weighted by
DECAY to the power of the length it spans in either word (spans over SPAN count nothing). Gaps are part of
it, so an insult with inserted characters keeps most of its likeness. It is divided by the landmark's
own kernel, held at 1, so a longer word that begins like a landmark counts in full, and raised to the
power SHARPEN (a power of a kernel is a kernel). A word is read as it stands, with its letters only and,
from STRIDE characters on, with every second character only, so that characters put between all letters
cost nothing; a word with a kernel of NEAR or more before it is raised is also read without each of its
characters, so that one put in costs nothing. The best reading counts. A text's kernel with a landmark is the sum over its
different words, held at MOST. Kernels under floor (0.0016 once raised) are left out of the sum.

A word of over LONGEST characters is as alike as its best stretch of that many.

Landmarks are beginnings of words (words too short for that whole, with a space as their end) that, in the
labelled rows used for training, stand out most in toxic texts, by whether or how often a text has them,
and are unlike those chosen before. The Nyström map (inverse square root of this kernel among the
landmarks, made symmetric) turns the kernels into features, a linear SVM (hinge loss) separates them, and a
logistic curve fitted to its margins gives the score. Training uses at most MAX_ROWS labelled rows, those
first in order of a hash of their id; nothing but texts and labels goes into it. Beginnings are counted
and features made on the executors; the driver gets the CANDIDATES best beginnings and the fitted
numbers. All documents are scored whole.

Words are scored a batch at a time: places of possible triples are looked up in a table of the
landmarks' triples. Words met before are remembered, up to CACHE of them.

Nulls: a null text is an empty one (the score of a text without words), a null label is left out, a null id
is held out. With fewer than two classes among the training rows every score is the share of toxic rows.
Rows are scored each by its text, so repeated rows tie; of two labels of one id both count. An empty table
gives an empty result; scored() passes extra columns on, a score among them is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, unused

MAX_ROWS = 4_000
LANDMARKS = 64
MIN_TOXIC_TEXTS = 3
#: Beginnings that the driver looks at, those first in rank.
CANDIDATES = 4_000
#: Lengths of the beginnings of words that may become landmarks, and how alike two landmarks may be.
LENGTHS = range(4, 9)
ALIKE = 0.6
SHARPEN = 4
MOST = 4.0
DECAY = 0.6
SPAN = 6
LONGEST = 32
STRIDE = 7
NEAR = 0.4
ALPHABET = 64
START = ALPHABET - 1
CACHE = 300_000
PREDICT_AT = 0.7

#: Words whose triples are looked up together.
TOGETHER = 1_000

EDGE = ".,;:!?\"'()[]{}|"


def whole(word: str) -> str:
    """A word too short for a beginning is marked by its end."""
    return word if len(word) >= LENGTHS[0] else word + " "


def readings(word: str) -> list[str]:
    """The word as it stands, without what is no letter, and by every second character."""
    out = [whole(word)]
    if not word.isalpha():
        plain = "".join(filter(str.isalpha, word))
        if plain:
            out.append(whole(plain))
    if len(word) >= STRIDE:
        out.append(word[::2])
    return out


def letters(word: str) -> list[int]:
    """Classes of the word's start and its characters: a to z, then digits, then all others dealt into the rest."""
    out = [START]
    for c in word:
        x = ord(c)
        out.append(x - 96 if 97 <= x <= 122 else 27 if 48 <= x <= 57 else 28 + x % (START - 28))
    return out


#: The classes of all code points, as letters() gives them; 0 is what stands between words.
CLASSES = (28 + np.arange(0x110000) % (START - 28)).astype(np.uint8)
CLASSES[97:123], CLASSES[48:58], CLASSES[0] = np.arange(1, 27), 27, 0

#: (j - i, k - i, weight) of the places of a triple.
PLACES = [(j, k, DECAY ** (k + 1)) for k in range(2, SPAN) for j in range(1, k)]


def triples(word: str) -> dict[int, float]:
    """The weight of each triple of a word."""
    code, out = letters(word), {}
    for i in range(len(code)):
        for j, k, weight in PLACES:
            if i + k < len(code):
                t = (code[i] * ALPHABET + code[i + j]) * ALPHABET + code[i + k]
                out[t] = out.get(t, 0.0) + weight
    return out


def kernel(a: dict[int, float], b: dict[int, float]) -> float:
    dot = sum(v * b[t] for t, v in a.items() if t in b)
    return dot / np.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())) if dot else 0.0


@dataclass
class Model:
    landmarks: list[str]
    whiten: np.ndarray  # of the kernels with the landmarks
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, kernels: np.ndarray) -> np.ndarray:
        margin = kernels @ self.whiten @ self.weights + self.bias
        return 1 / (1 + np.exp(-(self.slope * margin + self.offset)))


class WordKernels:
    """Kernels of words with landmarks; words far from all of them have no entry."""

    #: Kernels below this count as 0.
    floor = 0.2

    def __init__(self, landmarks: list[str]):
        self.n = len(landmarks)
        maps = [triples(w) for w in landmarks]
        known = sorted({t for m in maps for t in m})
        self.slot = np.zeros(ALPHABET**3, np.int16)  # 0: in no landmark
        self.slot[known] = np.arange(1, len(known) + 1)
        self.table = np.zeros((len(known) + 1, max(self.n, 1)), np.float32)
        at = {t: i + 1 for i, t in enumerate(known)}
        for i, m in enumerate(maps):
            norm = sum(v * v for v in m.values()) or 1
            for t, v in m.items():
                self.table[at[t], i] = v / norm
        self.most = self.table.max(1).astype(float)  # what a triple adds to any kernel, at most
        slots, self.owner = np.nonzero(self.table)
        self.value = self.table[slots, self.owner].astype(float)
        self.ends = np.searchsorted(slots, np.arange(len(self.table) + 1))
        self.known: dict[str, np.ndarray | None] = {}
        self.words: set[str] = set()  # those met
        self.near: dict[str, int] = {}  # the rows of held that such words have
        self.held = np.empty((1, self.n), np.float32)

    def learn(self, words: list[str]) -> None:
        self.known.update(dict.fromkeys(words))
        self.known.update(zip(*self.entries(words), strict=True))

    def entries(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """The words that have an entry, and their kernels, a row each."""
        found, values = [], [np.empty((0, self.n), np.float32)]
        for i in range(0, len(words) if self.n else 0, TOGETHER):
            part = words[i : i + TOGETHER]
            cut = [w for w in part if len(w) <= LONGEST]
            for w in part if len(cut) < len(part) else ():
                if len(w) > LONGEST:  # a long word is as alike as its best stretch
                    v = self.best([w[k : k + LONGEST] for k in range(0, len(w), LONGEST - SPAN)])
                    if v is not None:
                        found.append(w)
                        values.append(v[None])
            if cut:
                rows, v = self.batch(cut)
                found += [cut[r] for r in rows.tolist()]
                values.append(v)
        return found, np.concatenate(values)

    def best(self, pieces: list[str]) -> np.ndarray | None:
        rows, values = self.batch(pieces) if self.n else ([], [])
        return values.max(0) if len(rows) else None

    def batch(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of words with some kernel over the floor, and their kernels."""
        n = len(words)
        gap = "\0" * SPAN  # the last of it is the next word's start; the rest keeps triples from crossing words
        lengths = np.fromiter(map(len, words), np.int64, n) + SPAN
        code = CLASSES[np.frombuffer(("\0" + gap.join(words) + gap[1:]).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        code[np.cumsum(lengths) - lengths] = START
        word = np.repeat(np.arange(n), lengths)
        high, middle = code * ALPHABET**2, code * ALPHABET
        row, slots, weight = [], [], []
        for j, k, w in PLACES:
            m = max(len(code) - k, 0)
            slot = self.slot[high[:m] + middle[j : j + m] + code[k:]]  # no landmark's triple has a 0
            at = np.flatnonzero(slot != 0)
            row.append(word[at])
            slots.append(slot[at])
            weight.append(np.full(len(at), w))
        row, slots, weight = np.concatenate(row), np.concatenate(slots), np.concatenate(weight)
        # few words have enough triples to come over the floor
        enough = np.bincount(row, weight * self.most[slots], n) >= self.floor * (1 - 1e-5)
        some, place = np.flatnonzero(enough), np.cumsum(enough) - 1
        keep = enough[row]
        row, slots, weight = place[row[keep]], slots[keep], weight[keep]
        many = self.ends[slots + 1] - self.ends[slots]  # a triple is in few landmarks
        ends = np.cumsum(many)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.ends[slots] - ends + many, many)
        dots = np.bincount(np.repeat(row * self.n, many) + self.owner[at], np.repeat(weight, many) * self.value[at], len(some) * self.n).astype(np.float32).reshape(-1, self.n)
        over = dots.max(1, initial=0) >= self.floor
        dots[dots < self.floor] = 0
        return some[over], np.minimum(dots[over], 1) ** SHARPEN

    def text(self, words: set[str]) -> np.ndarray:
        near = self.near
        return np.minimum(self.held[np.array([near[w] for w in words if w in near], np.int64)].sum(0), MOST)

    def texts(self, texts: list[str]) -> np.ndarray:
        split = [{w.strip(EDGE) for w in set(t.lower().split())} for t in texts]
        if len(self.words) > CACHE:
            self.words.clear()
            self.near.clear()
        new = {w: readings(w) for w in set().union(*split).difference(self.words)}
        first, more = set().union(*new.values()), set()
        found, values = self.entries(list(first))
        at = dict(zip(found, range(len(found)), strict=True))
        for w, top in zip(found, values.max(1, initial=0).tolist(), strict=True):
            if top < 0.999 and top >= NEAR**SHARPEN * (1 - 1e-5) and 4 < len(w) <= LONGEST and w in new:  # NEAR itself, too, whatever the rounding
                less = [w[:i] + w[i + 1 :] for i in range(1, len(w))]
                new[w] += less
                more.update(less)
        found, others = self.entries(list(more.difference(first)))
        at.update(zip(found, range(len(values), len(values) + len(found)), strict=True))
        rows, starts = [], []
        for w, rs in new.items():
            start = len(rows)
            rows += [at[r] for r in rs if r in at]
            if len(rows) > start:
                starts.append(start)
                self.near[w] = len(self.near)
        if starts:
            while len(self.near) > len(self.held):
                self.held = np.concatenate([self.held, np.empty_like(self.held)])
            best = np.maximum.reduceat(np.concatenate([values, others])[rows], starts, axis=0)
            self.held[len(self.near) - len(starts) : len(self.near)] = best
        self.words.update(new)
        return np.array([self.text(words) for words in split], np.float32).reshape(len(texts), self.n)


def beginnings(text: str) -> Counter:
    """How many different words of a text have each beginning."""
    words = {w.strip(EDGE) for w in text.lower().split()}
    return Counter(w[:n] for w in words for n in LENGTHS if len(w) >= n) + Counter(whole(w) for w in words if 0 < len(w) < LENGTHS[0])


def ranked_beginnings(rows: DataFrame) -> DataFrame:
    """(beginning, ratio) of rows (text, toxic): the larger log likelihood ratio of toxic texts having it, or having it twice, more often."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, label in zip(batch["text"], batch["toxic"], strict=True):
                found = beginnings(text if isinstance(text, str) else "")
                yield pd.DataFrame({"beginning": list(found), "times": list(found.values())}, dtype=object).astype({"times": "int64"}).assign(label=int(label))

    n1, n0 = (F.lit(float(rows.where(f"toxic = {y}").count())) for y in (1, 0))
    having = lambda y, n: F.count_if((F.col("label") == y) & (F.col("times") >= n)).alias(f"has_{y}_{n}")
    counts = rows.mapInPandas(run, "beginning string, times long, label int").groupBy("beginning").agg(*(having(y, n) for y in (1, 0) for n in (1, 2)))

    def ratio(a: Column, b: Column) -> Column:
        p, q, r = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1), (a + b + 1) / (n1 + n0 + 2)
        part = lambda k, n, x, y: k * F.log(x / y) + (n - k) * F.log((1 - x) / (1 - y))
        return F.when(p > q, part(a, n1, p, r) + part(b, n0, q, r)).otherwise(0.0)

    both = F.greatest(*(ratio(F.col(f"has_1_{n}"), F.col(f"has_0_{n}")) for n in (1, 2)))
    return counts.where(F.col("has_1_1") >= MIN_TOXIC_TEXTS).select("beginning", both.alias("ratio"))


def choose_landmarks(ranked: DataFrame, most: int = LANDMARKS) -> list[str]:
    """The beginnings of highest ratio that are unlike those before; ties by length, then name."""
    first = ranked.where("ratio > 4").orderBy(F.col("ratio").desc(), F.length("beginning").desc(), "beginning").limit(CANDIDATES)
    chosen: list[tuple[str, dict[int, float]]] = []
    for (w,) in first.select("beginning").collect():
        m = triples(w)
        if len(chosen) < most and all(kernel(m, other) < ALIKE for _, other in chosen):
            chosen.append((w, m))
    return [w for w, _ in chosen]


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(text, toxic) of the first max_rows labelled rows outside the held-out part, in order of a hash of their id."""
    chosen = labels.select("doc_id", "toxic").where("toxic IN (0, 1)").where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def kernel_columns(df: DataFrame, landmarks: list[str], text: str, result: str, then: Callable[[np.ndarray], list], kind: T.DataType) -> DataFrame:
    """df without its text, and then(kernels of the texts with the landmarks) as result."""
    kept = [c for c in df.columns if c not in (text, result)]
    (own,) = unused(kept, "text")
    source = df.select(*kept, F.col(text).cast("string").alias(own))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kernels = WordKernels(landmarks)
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.iloc[i : i + 500]
                texts = [t if isinstance(t, str) else "" for t in part[own]]
                yield part.drop(columns=own).assign(**{result: then(kernels.texts(texts).astype(float))})

    return source.mapInPandas(run, T.StructType([*source.select(*kept).schema.fields, T.StructField(result, kind)]))


def train(rows: DataFrame) -> Model:
    """A model from a bounded number of rows (text, toxic)."""
    rows = checkpointed(rows)
    share = rows.agg(F.avg("toxic")).first()[0] or 0.0
    landmarks = choose_landmarks(ranked_beginnings(rows)) if 0 < share < 1 else []
    if not landmarks:
        base = float(np.clip(share, 1e-3, 1 - 1e-3))
        return Model([], np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, float(np.log(base / (1 - base))))
    gram = WordKernels(landmarks).texts([w.strip() for w in landmarks]).astype(float)
    value, vector = np.linalg.eigh((gram + gram.T) / 2 + 1e-3 * np.eye(len(gram)))
    whiten = vector @ np.diag(np.maximum(value, 1e-3) ** -0.5) @ vector.T
    features = kernel_columns(rows, landmarks, "text", "x", lambda k: (k @ whiten).tolist(), T.ArrayType(T.DoubleType()))
    weight = F.when(F.col("toxic") == 1, 0.5 / share).otherwise(0.5 / (1 - share))
    frame = checkpointed(features.select(array_to_vector("x").alias("features"), F.col("toxic").cast("double").alias("label"), weight.alias("weight")))
    svm = LinearSVC(maxIter=60, regParam=1e-3, weightCol="weight").fit(frame)
    margins = svm.transform(frame).select(array_to_vector(F.slice(vector_to_array("rawPrediction"), 2, 1)).alias("features"), "label")
    curve = LogisticRegression(regParam=1e-3, maxIter=60).fit(margins)
    return Model(landmarks, whiten, svm.coefficients.toArray(), float(svm.intercept), float(curve.coefficients[0]), float(curve.intercept))


def scored(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df without its text, and score (0 to 1)."""
    return kernel_columns(df, model.landmarks, text, "score", lambda k: model.score(k).tolist(), T.DoubleType())


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that training never sees: crc32 of the id as text, modulo 3, is 1; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs(doc_id, text), trained on labels(doc_id, toxic) outside the held-out part."""
    model = train(training_rows(docs, labels))
    out = scored(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return out.withColumn("predicted", (F.col("score") >= PREDICT_AT).cast("int"))
