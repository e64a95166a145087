"""The registered queries of the text operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, html, lexical, licenses, lsh_forest, mixing, phrases, quality, secrets, suffix_array, suffix_tree, toxicity
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_filter(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), text=False)
    return judged.select("doc_id", *quality.BASE, "kept")


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_array.removed_bytes(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s.b - s.a).cast("long"))
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_tree.removed_words(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compared(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = licenses.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    named = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return done.select(*named, *(c for c in done.columns if c not in named))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"), n=3, threshold=85).select("doc_id", "n_shingles", "component_id", "kept")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.best(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = secrets.found(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.tiktoken"))
    return done.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_html_main_text": op2_html_main_text,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_winnowing": op5_winnowing,
    "op6_license_scan": op6_license_scan,
    "op7_toxicity": op7_toxicity,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_mix_sources": op9_mix_sources,
    "op10_bpe": op10_bpe,
    "op11_lexical_search": op11_lexical_search,
    "op12_secret_scan": op12_secret_scan,
    "op13_phrase_mining": op13_phrase_mining,
}

_W = r"[^\x20\x09-\x0D]+"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op1_quality_rules": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_W}') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS ls FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS gram
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
cov AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k AS p FROM rep, range(0, 3) AS x(k)) GROUP BY r),
m AS (SELECT w.*, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov ON w.r = cov.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  1000 * n_symbols // greatest(word_chars, 1) AS m1, 1000 * n_dup_lines // greatest(len(ls), 1) AS m2,
  1000 * n_repeat_words // greatest(n_words, 1) AS m3, 1000 * word_chars // greatest(n_words, 1) AS m4 FROM m),
q AS (
  SELECT CASE WHEN GROUPING(lang, source) = 0 THEN 1 WHEN GROUPING(lang, source) = 1 THEN 2 ELSE 3 END AS lv, lang, source, count(*) AS n,
  {", ".join(f"quantile_disc(m{i}, 0.25) AS a{i}, quantile_disc(m{i}, 0.75) AS z{i}" for i in range(1, 5))}
  FROM b WHERE NOT base_failed GROUP BY GROUPING SETS ((lang, source), (lang), ())),
f AS (SELECT b.*, coalesce(CASE WHEN x.n >= {quality.MIN_STRATUM} THEN 1 WHEN y.n >= {quality.MIN_STRATUM} THEN 2 WHEN x.n > 0 THEN 3 END, 0) AS pick,
  x.lang IS NULL AS none, {", ".join(f"CASE pick WHEN 1 THEN x.a{i} WHEN 2 THEN y.a{i} ELSE z.a{i} END AS a{i}, CASE pick WHEN 1 THEN x.z{i} WHEN 2 THEN y.z{i} ELSE z.z{i} END AS z{i}" for i in range(1, 5))}
  FROM b LEFT JOIN q x ON x.lv = 1 AND x.lang IS NOT DISTINCT FROM b.lang AND x.source IS NOT DISTINCT FROM b.source
  LEFT JOIN q y ON y.lv = 2 AND y.lang IS NOT DISTINCT FROM b.lang LEFT JOIN q z ON z.lv = 3)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND m1 <= z1 + {quality.FENCE} * (z1 - a1) + 30 AND m2 <= z2 + {quality.FENCE} * (z2 - a2) + 150
  AND m3 <= z3 + {quality.FENCE} * (z3 - a3) + 150
  AND m4 BETWEEN a4 - {quality.FENCE} * (z4 - a4) - 3000 AND z4 + {quality.FENCE} * (z4 - a4) + 3000 AS kept
FROM f""",
    "op4_substring_dedup": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_W}') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d)),
x AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM w),
e AS (SELECT DISTINCT doc_id, i + k AS p FROM x, range(0, 20) AS r(k) WHERE n > 1),
v AS (SELECT d.doc_id, ws[p] AS word, p FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM d) AS d
  ANTI JOIN e USING (doc_id, p)),
g AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM v GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id""",
    "op8_minhash_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 2], ' ')) AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, m.doc_id = m.c AS kept FROM m LEFT JOIN n USING (doc_id)""",
    "op9_mix_sources": rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_W}')) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(sum(size)) OVER () AS DOUBLE) AS total,
  CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM d GROUP BY source),
h AS (SELECT *, CAST(3 * source_size AS DOUBLE) AS most FROM s),
k AS (SELECT *, coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
  sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM h),
v AS (SELECT max((total - held) / free) FILTER (WHERE most / w >= (total - held) / free) AS level FROM k),
t AS (SELECT source, source_size, coalesce(least(most, w * level), most) AS target FROM k, v),
c AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id ROWS UNBOUNDED PRECEDING) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT doc_id, size, o, (cum + pass * source_size) / target AS finish FROM c, range(0, 3) AS r(pass) WHERE size > 0),
x AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, o, doc_id ROWS UNBOUNDED PRECEDING) AS spent FROM p),
y AS (SELECT doc_id, count(*) AS n FROM x WHERE spent <= (SELECT sum(source_size) FROM t) GROUP BY doc_id)
SELECT c.doc_id, c.size, source_size, target, CAST(c.size * coalesce(n, 0) AS BIGINT) AS taken FROM c LEFT JOIN y ON c.doc_id = y.doc_id""",
    "op11_lexical_search": rf"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS ts FROM documents),
i AS (SELECT row_number() OVER () AS item_no, * FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT item_no, term, count(*) AS reps FROM (SELECT item_no, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM i) GROUP BY ALL),
t AS (SELECT row_no, term, count(*) AS tf FROM (SELECT row_no, unnest(ts) AS term FROM d) GROUP BY ALL),
a AS (SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS words FROM d WHERE len(ts) > 0),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM t, a GROUP BY term, docs),
m AS (SELECT row_no, doc_id, 25 + (75 * CAST(len(ts) AS BIGINT) * docs) // words AS m FROM d, a WHERE len(ts) > 0),
s AS (SELECT item_no, row_no, CAST(sum(reps * w.w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (row_no) GROUP BY ALL),
r AS (SELECT item_no, doc_id, score, CAST(row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s JOIN m USING (row_no) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r JOIN i USING (item_no) WHERE rank <= 10""",
    "op13_phrase_mining": rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM documents),
g AS (SELECT lang, n, array_to_string(ws[i:i + n - 1], ' ') AS phrase FROM (SELECT lang, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM p, range(1, 5) AS x(n))),
f AS (SELECT lang, n AS len, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
s AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang),
c AS (SELECT f.*, k, string_split(phrase, ' ') AS ws FROM f, range(1, 4) AS x(k) WHERE k < len),
e AS (SELECT c.lang, c.len, c.phrase, c.a, x.a AS l, y.a AS r, CAST(2000000 * CAST(c.a AS HUGEINT) // (x.a + y.a) AS BIGINT) AS score,
  row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY 2000000 * CAST(c.a AS HUGEINT) // (x.a + y.a), k) AS cut
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')),
o AS (SELECT lang, phrase, unnest([array_to_string(ws[:-2], ' '), array_to_string(ws[2:], ' ')]) AS part, a FROM (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE len > 2)),
b AS (SELECT lang, part AS phrase, max(a) AS most FROM o GROUP BY ALL),
z AS (SELECT e.*, row_number() OVER (PARTITION BY e.lang ORDER BY score DESC, a DESC, e.phrase) AS rank FROM e LEFT JOIN b ON b.lang = e.lang AND b.phrase = e.phrase
  WHERE cut = 1 AND (most IS NULL OR 100 * CAST(most AS HUGEINT) < 80 * CAST(a AS HUGEINT)))
SELECT lang, rank, phrase, a, l, r, n, score FROM z JOIN s USING (lang) WHERE rank <= 2000""",
}
