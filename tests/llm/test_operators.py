"""Each text operator against a brute-force version, with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from episodic.llm import bpe, fingerprint, html, licenses, lsh_forest, mixing, quality, repeats, suffix_array, suffix_tree, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=("a", None)):
    return spark.createDataFrame([(i, t, "en" if i % 3 else None, sources[i % len(sources)], 0) for i, t in enumerate(texts)], SCHEMA)


def texts_with_repeats(seed=1, n=60):
    rnd = random.Random(seed)
    words = ["w%d" % i for i in range(200)] + ["é", "日本"]
    passage = [rnd.choice(words) for _ in range(80)]
    out = [None, "", "  ", "one", " ".join(["ha"] * 3000)]
    for _ in range(n):
        w = [rnd.choice(words) for _ in range(rnd.randrange(1, 200))]
        if rnd.random() < 0.5:
            a = rnd.randrange(0, 40)
            at = rnd.randrange(0, len(w) + 1)
            w[at:at] = passage[a : a + rnd.randrange(15, 60)]
        out.append(rnd.choice([" ", "\n", "  "]).join(w))
    return out + out[10:16] + out[10:12]


def test_quality_base_and_strata(spark):
    texts = [" ".join(f"word{j}x{i}" for j in range(80)) + ".\nline\nline" for i in range(60)] + [" ".join(f"w{j}%%%%%%" for j in range(80)), "a b c " * 60, None, ""]
    d = documents(spark, texts).withColumn("n_words", F.lit("clash"))
    rows = {r.doc_id: r for r in quality.quality_filter(d).collect()}
    assert len(rows) == len(texts)
    assert all(rows[i].kept and rows[i].n_dup_lines == 1 for i in range(60))
    assert not rows[60].kept and not rows[60].base_failed and rows[60].n_symbols == 480
    assert rows[61].base_failed and rows[61].n_repeat_words == 180
    assert rows[62].n_words == 0 and rows[62].base_failed and not rows[63].kept
    assert quality.quality_filter(d.limit(0)).count() == 0


def test_html():
    page = """<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li>Menu item, one.</li></ul></nav><div class="ad">Buy this, now. Really, buy.</div>
    <article><h1>Head</h1><p><b>First para&amp;graph, with   words.<br><p>Second, longer paragraph; it has text. And more.</p><ul><li>a<li>b</ul></article>
    <div id="comments"><p>A comment, by a reader.</p></div><form><p>Sign up</p></form><footer>&copy; x</footer>"""
    assert html.main_text(page) == "Head\n\nFirst para&graph, with words.\n\nSecond, longer paragraph; it has text. And more.\n\na\n\nb"
    plain = '<body><div id="menu"><a href="/">Home</a></div><div><h2>Title</h2><p>Some text, with commas, and more of it.</p><p>Another one, as long as that. Yes.</p></div><div class="sidebar">x, y.</div>'
    assert html.main_text(plain).startswith("Title\n\nSome text") and "x, y" not in html.main_text(plain)
    for odd in ("", "<", "a < b", "<p", "<article></article>", "<p>x" * 3000, "<!-- open", "<script>x"):
        html.main_text(odd)
    assert html.main_text("<p>a < b</p>") == "a < b"


def test_html_keeps_all_of_a_nested_text():
    para = "A long paragraph, with commas, full stops and words enough to stand out. It goes on; and on. " * 3
    lead, many = "The lead, short as it is, tells all.", f"<p>{para}</p>" * 9
    body = "\n\n".join([para.strip()] * 9)
    menu, foot = "<div class=menu><a href=/>Home</a></div>", "<div class=footer>Terms, and more.</div>"
    # a section inside, its heading and lead outside
    assert html.main_text(f"{menu}<article><h1>Head</h1><p>{lead}</p><section>{many}</section></article>{foot}") == f"Head\n\n{lead}\n\n{body}"
    assert html.main_text(f"<main><h1>Head</h1><section>{many}</section><p>{lead}</p></main>") == f"Head\n\n{body}\n\n{lead}"
    # an inner container, prose beside it
    assert html.main_text(f"<body>{menu}<div><p>{para}</p><p>{lead}</p><div>{many}</div></div>{foot}") == f"{para.strip()}\n\n{lead}\n\n{body}"
    assert html.main_text(f"<body>{menu}<div><h2>Head</h2><div>{many}</div><p>{lead}</p><p>© x. All rights reserved.</p></div>") == f"Head\n\n{body}\n\n{lead}"
    # nearly all of the text in table cells
    table = "<table><tbody>" + f"<tr><td>{para}</td><td>{para}</td></tr>" * 8 + "</tbody></table>"
    cells = "\n\n".join([para.strip()] * 16)
    assert html.main_text(f"<body>{menu}<div><p>{lead}</p>{table}<p>{lead}</p></div>{foot}") == f"{lead}\n\n{cells}\n\n{lead}"
    assert html.main_text(f"<article><p>{lead}</p>{table}<p>{lead}</p></article>") == f"{lead}\n\n{cells}\n\n{lead}"
    # teasers are articles too
    assert html.main_text(f"<body><div>{many}</div><article><p>Teaser, short.</p></article>").startswith(body)


def test_html_frame(spark):
    d = spark.createDataFrame([(1, None, "u"), (2, "<p>Hi, there.</p>", "v")], "page_id long, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(d).collect()}
    assert got == {1: ("", 0), 2: ("Hi, there.", 10)}


def test_suffix_array():
    rnd = np.random.RandomState(0)
    for _ in range(300):
        s = rnd.randint(0, rnd.randint(1, 5), rnd.randint(0, 60))
        rest = s.tolist()
        assert suffix_array.suffix_array(s).tolist() == sorted(range(len(rest)), key=lambda i: rest[i:])


def brute_bytes(texts, k):
    data = [(t or "").encode() for t in texts]
    n = Counter(d[i : i + k] for d in data for i in range(len(d) - k + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - k + 1):
            if n[d[i : i + k]] > 1:
                gone[i : i + k] = True
        out.append(bytes(np.frombuffer(d, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("hot", [repeats.HOT, 2])
def test_removed_bytes(spark, hot):
    texts = texts_with_repeats()
    got = {r.doc_id: bytes(r.kept) for r in suffix_array.removed_bytes(documents(spark, texts), hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute_bytes(texts, suffix_array.K)
    assert suffix_array.removed_bytes(documents(spark, texts).limit(0)).count() == 0


def brute_words(texts, k):
    seen, out = set(), []
    for t in texts:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            if g in seen:
                gone[i : i + k] = [True] * k
            seen.add(g)
        out.append(b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    return out


@pytest.mark.parametrize("hot", [repeats.HOT, 2])
def test_removed_words(spark, hot):
    texts = texts_with_repeats(7)
    d = documents(spark, texts).withColumn("n_removed", F.lit("clash"))
    got = {r.doc_id: r.text for r in suffix_tree.removed_words(d, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute_words(texts, suffix_tree.K)
    assert suffix_tree.removed_words(d.limit(0)).count() == 0


def test_winnowing_picks():
    rnd = random.Random(3)
    for _ in range(300):
        t = "".join(rnd.choice("abcé") for _ in range(rnd.randrange(0, 120)))
        h = fingerprint.gram_hashes(t).tolist()
        want = []
        w = min(fingerprint.W, len(h))
        for i in range(len(h) - w + 1 if h else 0):
            low = min(h[i : i + w])
            at = max(j for j in range(i, i + w) if h[j] == low)
            if not want or want[-1] != (low, at):
                want.append((low, at))
        hashes, places = fingerprint.winnow(t)
        assert list(zip(hashes.tolist(), places.tolist(), strict=True)) == want


def test_winnowing_next(spark):
    texts = texts_with_repeats(11, 30)
    got = {r.doc_id: r for r in fingerprint.compared(documents(spark, texts).repartition(3)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        following = texts[(i + 1) % len(texts)] or ""
        new = fingerprint.edited(t or "", following)
        assert got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and got[i].n_chars == len(t or "")
        assert got[i].near_next == fingerprint.likeness(fingerprint.winnow(t or "")[0], fingerprint.winnow(following)[0])
    one = fingerprint.compared(documents(spark, ["same text"])).first()
    assert one.near_next == 1.0
    assert fingerprint.compared(documents(spark, ["x"]).limit(0)).count() == 0


def test_licenses(spark):
    s = licenses.Scanner()
    assert s.scan("The MIT License. GNU General  Public-License mit license")[1:5] == (3, 1, 7, "gpl,mit")
    assert s.scan("MIT License MIT License")[1:4] == (2, 0, 2)
    assert s.scan("")[:7] == (0, 0, None, None, "", "", None)
    assert s.scan("// SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0")[5:] == ("apache,gpl,mit", True, 1.0)
    assert s.scan("SPDX-License-Identifier: GPL-3.0 AND MIT")[6] is False
    assert licenses.postfix("a or b and c with d".split()) == ["a", "b", "c", "d", "with", "and", "or"]
    assert licenses.postfix(["(", "a"]) is None and licenses.postfix(["a", "b"]) is None
    d = spark.createDataFrame([(1, None, 5.0), (2, "mit license", 5.0)], "doc_id long, text string, score double")
    assert {r.doc_id: r.n_base for r in licenses.scanned(d).collect()} == {1: 0, 2: 1}


def test_word_kernels_match_brute_force():
    rnd = random.Random(1)
    marks = ["idiot", "achlich", "moron"]
    k = toxicity.WordKernels(marks)
    words = ["".join(rnd.choice("acdhilmnorstu*é") for _ in range(rnd.randrange(1, 14))) for _ in range(300)] + ["idiot", "id.iot", "idiots", "achlichung"]
    k.learn(words)
    for w in words:
        t = toxicity.triples(w)
        want = [min(sum(v * m.get(x, 0) for x, v in t.items()) / sum(v * v for v in m.values()), 1) for m in map(toxicity.triples, marks)]
        want = [x**toxicity.SHARPEN if x >= k.floor else 0 for x in want] if max(want) >= k.floor else [0] * 3
        got = k.known[w] if k.known[w] is not None else [0] * 3
        assert np.allclose(got, want, atol=1e-4), w


def test_toxicity_learns(spark):
    rnd = random.Random(2)
    clean = ["the", "house", "green", "walk", "river", "stone", "music", "paper"]
    texts, toxic = [], []
    for _ in range(300):
        w = [rnd.choice(clean) + rnd.choice("abcde") for _ in range(40)]
        bad = rnd.random() < 0.3
        if bad:
            w[rnd.randrange(40)] = rnd.choice(["idiot", "moron"])
        texts.append(" ".join(w))
        toxic.append(int(bad))
    texts += ["what an i.diot", None, ""]
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(toxic)] + [(301, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(documents(spark, texts), labels).collect()}
    held = [i for i in range(300) if got[i].held_out]
    assert 50 < len(held) < 150
    assert np.mean([got[i].predicted == toxic[i] for i in held]) > 0.95
    assert got[301].score == got[302].score and 0 <= got[302].score <= 1
    none = toxicity.classify(documents(spark, texts), labels.limit(0)).select("score").distinct().collect()
    assert len(none) == 1


def test_toxicity_finds_disguised_insults(spark):
    rnd = random.Random(6)
    parts = ["an", "der", "ho", "ing", "ka", "lu", "men", "or", "pe", "ri", "so", "ver", "wa"]
    bad = ["idiot", "moron", "stupid", "zug"]
    text = lambda more: " ".join(["".join(rnd.choices(parts, k=rnd.randrange(1, 5))) for _ in range(60)] + more)
    toxic = [int(i % 4 == 0) for i in range(480)]
    texts = [text(rnd.choices(bad, k=2) if y else []) for y in toxic]
    put = lambda w, k, c: w[:k] + c + w[k:]
    disguised = {
        "one sign": lambda w: put(w, rnd.randrange(1, len(w)), rnd.choice(".*-_")),
        "one letter": lambda w: put(w, rnd.randrange(2, len(w) - 1), rnd.choice("bfqx")) if len(w) > 3 else w,
        "every sign": lambda w: rnd.choice(".*-_").join(w),
        "every letter": lambda w: "".join(c + rnd.choice("bfqx") for c in w) if len(w) > 3 else w,
    }
    kinds = [*disguised, "clean"]
    for kind in kinds:
        texts += [text([disguised[kind](w) for w in rnd.choices(bad, k=2)] if kind != "clean" else []) for _ in range(50)]
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.classify(documents(spark, texts), labels).collect()}
    found = {kind: np.mean([got[len(toxic) + 50 * n + i] for i in range(50)]) for n, kind in enumerate(kinds)}
    assert found.pop("clean") <= 0.04
    assert min(found.values()) >= 0.8, found


def test_near_duplicates(spark):
    rnd = random.Random(5)
    vocabulary = ["w%d" % i for i in range(3000)]
    base = [rnd.choice(vocabulary) for _ in range(200)]
    docs = [" ".join(base), "", "  ", None, "a b", "A B", "a b"]
    for _ in range(120):
        w = list(base)
        for _ in range(rnd.randrange(1, 6)):
            w[rnd.randrange(200)] = rnd.choice(vocabulary)
        docs.append(" ".join(w))
    for _ in range(40):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 150))]
        docs.append(" ".join(w))
        for _ in range(rnd.randrange(0, 3)):
            v = list(w)
            v[rnd.randrange(len(v))] = rnd.choice(vocabulary)
            docs.append(" ".join(v))
    rnd.shuffle(docs)
    sets = [set(lsh_forest.shingle_set(t, 3).tolist()) if t else set() for t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r for r in lsh_forest.near_duplicates(documents(spark, docs), 3, 85).collect()}
    assert [got[i].component_id for i in range(len(docs))] == [find(i) for i in range(len(docs))]
    assert all(got[i].kept == (find(i) == i) and got[i].n_shingles == len(sets[i]) for i in range(len(docs)))
    assert lsh_forest.near_duplicates(documents(spark, docs).limit(0)).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r.id: r.component for r in lsh_forest.components(links).collect()}
    assert all(got[i] == 0 for i in range(41)) and {got[90], got[95], got[100]} == {90}


def test_mixing(spark):
    rnd = random.Random(4)
    texts = ["x " * rnd.randrange(0, 60) for _ in range(400)] + [None, ""]
    d = documents(spark, texts, sources=("a", "a", "a", "b", None))
    rows = mixing.mixed(d).collect()
    again = {r.doc_id: r.taken for r in mixing.mixed(d.repartition(7)).collect()}
    assert {r.doc_id: r.taken for r in rows} == again and len(rows) == len(texts)
    total = sum(r.size for r in rows)
    for s in ("a", "b", None):
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 120 and own[0].target <= 3 * own[0].source_size
    assert abs(sum(r.target for r in {r.source: r for r in rows}.values()) - total) < 1e-6
    assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in rows)
    assert mixing.mixed(d.limit(0)).count() == 0


def test_bpe_is_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    mine, theirs = bpe.WordBpe(path), Tokenizer.from_file(path)
    rnd = random.Random(1)
    texts = ["", "a", "İstanbul ΣΑΣ Σ", "a<|endoftext|>b <|startoftext|>", "it's we'll 'd 12½ ² Ⅷ x\x1cy\x85z\xa0w", "日本語テキスト", "é Å ﬁ", "'S DON'T", "x" * 3000, "__a_b__ ~!@#", "aaaa!!!!", "हिन्दी 😀👍🏽"]
    texts += ["".join(rnd.choice("abcdefgh é.,'1ßñ ") for _ in range(rnd.randrange(200))) for _ in range(300)]
    ids, shown = mine.encode_batch(texts)
    for t, i, s in zip(texts, ids, shown, strict=True):
        want = theirs.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(i, "<u4").tolist() == want and s == theirs.decode(want, skip_special_tokens=False), t


def test_bpe_frame(spark):
    d = spark.createDataFrame([(1, None, b"x"), (2, "Hi there", b"y")], "doc_id long, text string, ids binary")
    got = {r.doc_id: (r.n_tokens, r.decoded) for r in bpe.encode_decode(d, public_tokenizers.path("word_bpe_49k.json")).collect()}
    assert got[1] == (0, "") and got[2][0] == 2


def test_word_kernels_look_at_words_without_padding(monkeypatch):
    """Many short words beside a long one are looked up in as many places as they have letters; a kernel of NEAR itself is near."""
    k = toxicity.WordKernels(["idiot", "moron"])
    looked = []

    class Slots(np.ndarray):
        def __getitem__(self, at):
            looked.append(np.size(at))
            return np.asarray(self)[at]

    k.slot = k.slot.view(Slots)
    words = [f"w{i}" for i in range(500)] + ["x" * 32, "idiot"]
    rows, values = k.batch(words)
    assert [words[r] for r in rows] == ["idiot"] and values[0][0] == 1
    assert sum(looked) <= len(toxicity.PLACES) * sum(len(w) + toxicity.SPAN for w in words)
    texts = ["idiot\0s and mor on", "", "idXiot " + "z" * 90 + "moron", "\ud800 moron"]
    one, again = k.texts(texts), k.texts(texts[::-1])[::-1]
    assert np.array_equal(one, again) and one[1].max() == 0 and one[0][0] > 0.9 and one[2][0] > 0.9 and one[3][1] == 1
    assert np.array_equal(toxicity.WordKernels([]).texts(["a b", ""]), np.zeros((2, 0)))
