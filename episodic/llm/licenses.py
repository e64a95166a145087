"""License scans: Aho-Corasick for notice phrases and identifier tags, shunting-yard for licence expressions.

A text is lower-cased (A-Z) and cut into words; one automaton finds every place where the words of a
phrase stand one after the other, overlapping places included. Identifier tags are found by a second
automaton on the raw text; the expression after a tag (AND, OR, WITH, parentheses) is brought into
postfix order by the shunting-yard method and evaluated to its labels and to whether some choice of
its alternatives is permissive. Base phrases give base labels; other phrases and the expressions add
labels of their own.

Score: 1 for a well-formed expression of known identifiers, 0.9 for a longer notice phrase, 0.6 for a
base phrase alone, 0.3 for a tag whose expression can't be read, else 0. Null texts are empty ones:
no words, no places, empty labels, score 0. Rows are independent, so repeated rows and null ids pass; an
empty table gives an empty result; result columns replace others of the same name; long texts are scanned
to their end, and of a line after a tag the longest beginning that is an expression counts. Places that
tie (overlapping phrases) all count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import unused

# Phrases and the labels they give.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "licensed under the apache license": "apache",
    "apache license version 2 0": "apache-2.0",
    "gnu general public license": "gpl",
    "general public license version 2": "gpl-2.0",
    "general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl-1.0",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "this is free and unencumbered software": "unlicense",
    "cc by 4 0": "cc-by",
    "cc by sa 4 0": "cc-by-sa",
    "cc by nc 4 0": "cc-by-nc",
    "cc by nd 4 0": "cc-by-nd",
    "cc0 1 0": "cc0",
    "creative commons attribution": "cc-by",
    "all rights reserved": "reserved",
}
TAGS = ("spdx-license-identifier:", "license-expression:")
SOME_TAG = re.compile("license-(?:identifier|expression):", re.I | re.A)
# Identifier families, their label and whether they are permissive.
FAMILIES = {
    "mit": ("mit", True), "apache": ("apache", True), "bsd": ("bsd", True), "isc": ("isc", True), "unlicense": ("unlicense", True), "cc0": ("cc0", True),
    "bsl": ("bsl-1.0", True), "zlib": ("zlib", True), "cc-by-nc": ("cc-by-nc", False), "cc-by-nd": ("cc-by-nd", False), "cc-by-sa": ("cc-by-sa", False),
    "cc-by": ("cc-by", True), "gpl": ("gpl", False), "lgpl": ("lgpl", False), "agpl": ("agpl", False), "mpl": ("mpl", False), "epl": ("epl", False),
}
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
WORD = re.compile(r"[()]|[^\s()]+")

#: Bytes to lower-case letters, digits, themselves beyond ASCII, or a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def family(identifier: str) -> tuple[str, bool] | None:
    fits = [k for k in FAMILIES if identifier == k or identifier.startswith(k + "-")]
    return FAMILIES[max(fits, key=len)] if fits else None


def postfix(tokens: list[str]) -> list[str] | None:
    """Operands and operators in postfix order; None if tokens are no expression."""
    out: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for token in tokens:
        if token in PRECEDENCE:
            if operand_next:
                return None
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand_next = True
        elif token == "(":
            if not operand_next:
                return None
            waiting.append(token)
        elif token == ")":
            if operand_next:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        else:
            if not operand_next:
                return None
            out.append(token)
            operand_next = False
    if operand_next or "(" in waiting:
        return None
    return out + waiting[::-1]


def leading(tokens: list[str]) -> int:
    """How many of the first tokens are an expression, at most."""
    most, depth, operand_next = 0, 0, True
    for i, token in enumerate(tokens):
        if token == "(":
            if not operand_next:
                break
            depth += 1
        elif (token in PRECEDENCE or token == ")") == operand_next:
            break
        elif token == ")":
            depth -= 1
            if depth < 0:
                break
        else:
            operand_next = token in PRECEDENCE
        if not depth and not operand_next:
            most = i + 1
    return most


def evaluate(expression: str) -> tuple[set[str], bool, bool]:
    """Labels, whether it can be met permissively, whether it is well-formed with known identifiers only."""
    tokens = [t.rstrip("+,;.*/-") if t not in "()" else t for t in WORD.findall(expression.lower())]
    tokens = [t for t in tokens if t]
    order = postfix(tokens[: leading(tokens)])  # what follows an expression on its line may be prose
    if not order:
        return set(), False, False
    stack: list[tuple[set[str], bool, bool]] = []
    for token in order:
        if token in PRECEDENCE:
            b, a = stack.pop(), stack.pop()
            if token == "with":  # an exception only loosens its licence
                stack.append(a)
            else:
                stack.append((a[0] | b[0], (a[1] or b[1]) if token == "or" else (a[1] and b[1]), a[2] and b[2]))
        else:
            known = family(token)
            stack.append(({known[0]}, known[1], True) if known else (set(), False, False))
    return stack[0]


def automaton(words) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for w in words:
        out.add_word(w, w)
    out.make_automaton()
    return out


class Scanner:
    def __init__(self) -> None:
        self.phrases = automaton(f" {p} " for p in {*BASE, *NOTICES})
        self.tags = automaton(TAGS)

    def scan(self, text: str) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, permissive, score."""
        words = text.encode("utf-8", "surrogatepass").translate(FOLD).split()
        line = " " + b" ".join(words).decode("latin-1") + " "
        starts, base, labels, score = [], set(), set(), 0.0
        seen_at, seen = 0, 0  # spaces counted so far
        found = sorted((end - len(p) + 1, p[1:-1]) for end, p in self.phrases.iter(line))
        for at, phrase in found:
            seen, seen_at = seen + line.count(" ", seen_at, at), at
            if phrase in BASE:
                starts.append(seen)
                base.add(BASE[phrase])
                score = max(score, 0.6)
            if phrase in NOTICES:
                labels.add(NOTICES[phrase])
                score = max(score, 0.9)
        permissive = None
        if SOME_TAG.search(text):
            folded = text.lower() if text.isascii() else text.translate({c: c + 32 for c in range(65, 91)})
            for end, _ in self.tags.iter(folded):
                stop = folded.find("\n", end)
                got, free, good = evaluate(folded[end + 1 : stop if stop >= 0 else len(folded)])
                labels |= got
                permissive = free if permissive is None else permissive and free
                score = max(score, 1.0 if good else 0.3)
        labels |= base
        return len(words), len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(sorted(base)), ",".join(sorted(labels)), permissive, score


COLUMNS = {"n_words": T.LongType(), "n_base": T.LongType(), "first_word": T.LongType(), "last_word": T.LongType(), "base_labels": T.StringType(), "labels": T.StringType(), "permissive": T.BooleanType(), "score": T.DoubleType()}


def scanned(df: DataFrame, text: str = "text") -> DataFrame:
    """df without its text, and the columns of Scanner.scan."""
    kept = [c for c in df.columns if c != text and c not in COLUMNS]
    (own,) = unused(kept, "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner()
        for batch in batches:
            rows = [scanner.scan(t if isinstance(t, str) else "") for t in batch[own]]
            found = pd.DataFrame(rows, columns=list(COLUMNS), index=batch.index).astype({"first_word": "Int64", "last_word": "Int64", "permissive": "boolean"})
            yield pd.concat([batch.drop(columns=own), found], axis=1)

    source = df.select(*kept, F.col(text).cast("string").alias(own))
    return source.mapInPandas(run, T.StructType([*source.select(*kept).schema.fields, *(T.StructField(k, v) for k, v in COLUMNS.items())]))
