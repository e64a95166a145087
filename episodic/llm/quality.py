"""Quality rules with adaptive thresholds from mergeable quantile sketches (DataFrame functions only).

Base rules are fixed and come first. What passes them is measured (symbols per thousand word
characters, doubled lines and repeated words per thousand, mean word length); KLL sketches of each
measure are built per (lang, source), merged to languages and to the whole corpus, and a document
is rejected that lies far beyond the quartiles of its own stratum. A stratum with too few rows takes
the merged sketch of its language, a small language that of the corpus. Thresholds are joined back to
the documents; nothing is fixed in advance but how far beyond the quartiles is too far.

Rows are measured once; their measures are stored, sketched and judged from there.

Nulls: a null text is an empty one and fails the base rules; null lang or source is a stratum of its
own. Very long texts are measured whole. Repeated rows are judged each; a measure that ties with its
threshold is kept. Extra columns stay, unless they bear the name of a result column, which replaces
them. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, SPACE, checkpointed, small, stored, unused, words_of

MIN_WORDS = 50
#: Rows a stratum needs for thresholds of its own.
MIN_STRATUM = 40
#: How many interquartile ranges, and how much besides, a measure may lie beyond its quartile.
FENCE = 4
#: measure -> (side, slack in its unit)
MEASURES = {"symbol_pm": ("high", 30), "dup_line_pm": ("high", 150), "repeat_pm": ("high", 150), "word_len_pm": ("both", 3000)}
SKETCH_K = 800

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once: an alias that a lambda reads could be put into it by the optimizer and worked out per element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def covered_by_repeats(words: Column) -> Column:
    """How many words lie in 3-word windows that occur at least twice in the array: sort the windows by hash, keep those equal to a neighbour, then add up the steps between their places, 3 at most."""

    def windows(w: Column) -> Column:
        hashed = F.transform(w, lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        return F.sort_array(F.slice(hashed, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))))

    def repeated(g: Column) -> Column:
        return F.sort_array(F.transform(F.filter(g, lambda x, i: (x.h == F.get(g, i - 1).h) | (x.h == F.get(g, i + 1).h)), lambda x: x.i))

    def total(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    return let(let(let(words, windows), repeated), total)


def with_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """df and the base columns; text null counts as empty."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    of_words = let(words_of(t), lambda w: F.struct(F.size(w).alias("n"), covered_by_repeats(w).alias("repeated")))
    of_lines = let(F.filter(F.split(t, "\n"), lambda x: x.rlike(NOT_SPACE)), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("different")))
    w, l, n = unused(df.columns, "of_words", "of_lines", "n_lines")
    d = df.drop(*BASE, *MEASURES).withColumns({w: of_words, l: of_lines})
    d = d.withColumns({
        "n_words": F.col(w)["n"].cast("long"),
        "word_chars": F.length(F.regexp_replace(t, SPACE + "+", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.col(l)["n"] - F.col(l)["different"]).cast("long"),
        "n_repeat_words": F.col(w)["repeated"].cast("long"),
        n: F.col(l)["n"],
    })
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    per_mille = lambda a, b: F.floor(1000 * F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("long")
    d = d.withColumns({
        "symbol_pm": per_mille("n_symbols", "word_chars"),
        "dup_line_pm": per_mille("n_dup_lines", n),
        "repeat_pm": per_mille("n_repeat_words", "n_words"),
        "word_len_pm": per_mille("word_chars", "n_words"),
    })
    return d.drop(w, l, n)


def sketches(measured: DataFrame) -> DataFrame:
    """One row per (lang, source) with a sketch of each measure over the rows that pass the base rules."""
    passed = ~F.col("base_failed")
    return measured.groupBy("lang", "source").agg(F.count_if(passed).alias("n"), *(F.kll_sketch_agg_bigint(F.when(passed, F.col(m)), F.lit(SKETCH_K)).alias(m) for m in MEASURES)).where("n > 0")


def thresholds(strata: DataFrame) -> DataFrame:
    """(lang, source) -> lowest and highest allowed value of each measure, from the narrowest stratum with enough rows."""

    def merged(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.kll_merge_agg_bigint(m).alias(m) for m in MEASURES))

    def fences(df: DataFrame, level: str) -> DataFrame:
        out = []
        for m, (side, slack) in MEASURES.items():
            q = lambda r, m=m: F.kll_sketch_get_quantile_bigint(m, F.lit(r).cast("double"))
            spread = FENCE * (q(0.75) - q(0.25)) + slack
            out.append((q(0.25) - spread if side == "both" else F.lit(-1).cast("long")).alias(f"{m}_low"))
            out.append((q(0.75) + spread).alias(f"{m}_high"))
        keys = [k for k in ("lang", "source") if k in df.columns]
        return df.select(*(F.col(k).alias(f"{level}_{k}") for k in keys), F.col("n").alias(f"{level}_n"), F.struct(*out).alias(level))

    by_lang = merged(strata, "lang")
    a, b, c = fences(strata, "own"), fences(by_lang, "tongue"), fences(merged(by_lang), "corpus")
    joined = a.join(b, a.own_lang.eqNullSafe(b.tongue_lang), "left").crossJoin(F.broadcast(c))  # c is one row
    chosen = F.when(F.col("own_n") >= MIN_STRATUM, F.col("own")).when(F.col("tongue_n") >= MIN_STRATUM, F.col("tongue")).otherwise(F.col("corpus"))
    return joined.select(F.col("own_lang").alias("t_lang"), F.col("own_source").alias("t_source"), chosen.alias("fence"))


def judge(measured: DataFrame, fence: DataFrame) -> DataFrame:
    """measured with kept: false if a base rule or a threshold of its stratum is broken."""
    lang, source, box = unused(measured.columns, "t_lang", "t_source", "fence")
    fence = fence.withColumnsRenamed({"t_lang": lang, "t_source": source, "fence": box})
    within = F.lit(True)
    for m in MEASURES:
        within = within & F.col(m).between(F.col(box)[f"{m}_low"], F.col(box)[f"{m}_high"])
    joined = measured.drop("kept").join(small(fence), F.col("lang").eqNullSafe(F.col(lang)) & F.col("source").eqNullSafe(F.col(source)), "left")
    return joined.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(within, F.lit(False)))).drop(lang, source, box)


def quality_filter(docs: DataFrame, text: bool = True) -> DataFrame:
    """docs (without the text, if that is not wanted) with the base columns, the measures and kept."""
    measured = with_measures(docs)
    measured = stored(measured if text else measured.drop("text"))
    return judge(measured, thresholds(checkpointed(sketches(measured))))
