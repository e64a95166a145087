"""Main text of web pages by tag-path ratios.

A page is read as a sequence of blocks, each with its root-to-leaf tag path (inline markup left out);
elements that never hold text (scripts, styles, form controls) are skipped, and those that by element
name, role, class or id are menus, adverts, notices, comments and the like are marked, which makes their
paths paths of their own. Per path, text length and punctuation are summed over its blocks and divided by
their number; both ratios are smoothed along the page with a Gaussian and fused by multiplication, and a
path is content if its fused ratio exceeds the page's standard deviation around zero, that is if it
stands out. A mark is a weight: the ratio of a marked path counts MARKED times. No block of a selected path
is dropped.

The content region is the deepest container that holds all selected paths. The text is every block in the
region or between the h1 and it that isn't marked inside the region, the selected ones, and the headings
and paragraphs with a sentence that adjoin these (leads and closing lines outside an inner container;
copyright lines end that).

Blocks: character references decoded, white space runs one space, trimmed, empty ones left out, joined
by an empty line. Null and empty html give an empty text; broken markup, unclosed elements and very
long or deeply nested pages are read to the end, in time that grows with their length. Ratios that tie with
the limit are content. Rows are independent, so repeated rows and null ids pass; an empty table gives an
empty result; result columns replace others of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import unused

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
NEVER = frozenset("head button select option template svg object audio video canvas map".split()) | RAW
ASIDE = frozenset("nav header footer aside form menu dialog".split())
# An opening element of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ITEMS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
SCOPES = frozenset("ul ol dl table body html article section div main select".split())

NOISE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notice|newsletter|subscribe|popup|modal|overlay|sidebar|side|widget|related|recommend\w*|share|sharing|social|breadcrumbs?|menu|nav|navbar|navigation|pagination|pager|comments?|disqus|replies|reply|respond|footer|header|masthead|login|signup|toolbar|tags?|byline-ads|skip)(?:$|[\s_-])",
    re.I,
)
ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)(?:>|\Z)", re.S)
ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# Elements that are parts of a text and no containers of one.
LEAF = frozenset("p li pre blockquote td th tr tbody thead tfoot table caption ul ol dl dt dd figure figcaption center address summary hgroup h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre blockquote table li dd".split())
SENTENCE = re.compile(r"[.!?…。！？؟।]")
LEGAL = re.compile(r"©|\(c\)\s*\d|copyright|all rights reserved", re.I)
#: How much the ratio of a marked path counts.
MARKED = 0.1
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？؟،।]")


def is_marked(name: str, attributes: str) -> bool:
    if name in ASIDE:
        return True
    if not attributes or name in ("html", "body", "main", "article"):
        return False
    for key, a, b, c in ATTR.findall(attributes):
        value, key = a or b or c, key.lower()
        if key in ("class", "id") and NOISE_NAME.search(value) or key == "role" and value.lower() in ROLE or key == "aria-hidden" and value.lower() == "true":
            return True
    return False


class Paths:
    """The tag paths of a page as a tree: each has a number, greater than that of the path it goes on from; 0 is the empty one."""

    def __init__(self):
        self.known: dict[tuple[int, str, bool], int] = {}
        self.parent, self.name, self.marked = [0], [""], [False]
        self.heading, self.paragraph, self.title = [False], [False], [False]

    def __len__(self) -> int:
        return len(self.parent)

    def longer(self, path: int, name: str, marked: bool) -> int:
        """The path that goes on from a path with an element; marked: the element is."""
        at = self.known.setdefault((path, name, marked), len(self.parent))
        if at == len(self.parent):
            self.parent.append(path)
            self.name.append(name)
            self.marked.append(marked)
            for flags, names in ((self.heading, HEADINGS), (self.paragraph, PARAGRAPHS), (self.title, ("h1",))):
                flags.append(flags[path] or name in names)
        return at

    def beyond(self, region: int = 0) -> tuple[list[bool], list[bool]]:
        """Of each path, whether it is in the region and whether an element is marked that is no part of the region's own path."""
        own = set()
        at = region
        while at:
            own.add(at)
            at = self.parent[at]
        inside, marked = [region == 0], [False]
        for i in range(1, len(self)):
            inside.append(i == region or inside[self.parent[i]])
            marked.append(marked[self.parent[i]] or (self.marked[i] and i not in own))
        return inside, marked

    def deepest_common(self, some: set[int]) -> int:
        """The longest path that all of these go on from or are."""
        below = [int(i in some) for i in range(len(self))]
        for i in range(len(self) - 1, 0, -1):
            below[self.parent[i]] += below[i]
        return max(i for i in range(len(self)) if below[i] == len(some))


def blocks(html: str) -> tuple[Paths, list[tuple[int, str]]]:
    """The page's paths, and (path, text) of each block that has text, in page order."""
    paths = Paths()
    out: list[tuple[int, str]] = []
    # open elements that are not inline: name, path; how many of a name are open; how many never hold text
    stack: list[tuple[str, int]] = []
    count: dict[str, int] = {}
    silent = 0
    parts: list[str] = []
    hidden: list[str] = []  # open inline elements that are marked
    at, end = 0, len(html)

    def flush() -> None:
        if parts:
            text = "".join(parts)
            parts.clear()
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text and not silent:
                out.append((stack[-1][1] if stack else 0, text))

    def close(names: frozenset | set, stop: frozenset = frozenset()) -> None:
        nonlocal silent
        if not any(count.get(n) for n in names):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                flush()
                for name, _ in stack[i:]:
                    count[name] -= 1
                    silent -= name in NEVER
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    while at < end:
        upto = html.find("<", at)
        upto = end if upto < 0 else upto
        if upto > at and not hidden:
            parts.append(html[at:upto])
        if upto == end:
            break
        found = TOKEN.match(html, upto)
        if not found:  # a bare "<"
            parts.append("<") if not hidden else None
            at = upto + 1
            continue
        at = found.end()
        cdata, closing, name, attributes = found.groups()
        if cdata and not hidden:
            parts.append(cdata)
        if name is None:
            continue
        name = name.lower()
        if name in RAW and not closing:
            over = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = over.end() if over else end
            if name not in INLINE:
                flush()
        elif name in INLINE:
            if name == "br":
                parts.append(" ") if not hidden else None
            elif closing and name in hidden:
                while hidden.pop() != name:
                    pass
            elif not closing and not attributes.endswith("/") and name not in VOID and (hidden or is_marked(name, attributes)):
                hidden.append(name)
        elif closing:
            hidden.clear()
            close({name})
        else:
            hidden.clear()
            flush()
            if name in ENDS_P:
                close({"p"}, SCOPES)
            if name in ITEMS:
                close(set(ITEMS[name].split()), SCOPES)
            if name not in VOID and not attributes.rstrip().endswith("/"):
                stack.append((name, paths.longer(stack[-1][1] if stack else 0, name, is_marked(name, attributes))))
                count[name] = count.get(name, 0) + 1
                silent += name in NEVER
    flush()
    return paths, out


def smooth(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    radius = int(np.ceil(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, radius), kernel / kernel.sum(), "valid")


def content_paths(found: list[tuple[int, str]], marked: list[bool]) -> set[int]:
    """Paths whose smoothed, fused ratios stand out."""
    order = {p: i for i, p in enumerate(dict.fromkeys(p for p, _ in found))}
    which = np.array([order[p] for p, _ in found])
    chars = np.array([len(t) for _, t in found], float)
    marks = np.array([len(PUNCTUATION.findall(t)) for _, t in found], float)
    count = np.bincount(which, minlength=len(order))
    text_ratio, mark_ratio = np.bincount(which, chars) / count, np.bincount(which, marks) / count
    fused = smooth(text_ratio[which]) * smooth(1 + mark_ratio[which])
    fused = np.bincount(which, fused) / count * np.where([marked[p] for p in order], MARKED, 1)
    limit = min(float(np.std(fused[which])), float(fused.max()) / 2)
    return {p for p, i in order.items() if fused[i] >= limit}


def main_text(html: str) -> str:
    paths, found = blocks(html)
    if not found:
        return ""
    chosen = content_paths(found, paths.beyond()[1])
    region = paths.deepest_common(chosen)
    while region and paths.name[region] in LEAF:
        region = paths.parent[region]
    inside, marked = paths.beyond(region)
    found = [(p, t) for p, t in found if p in chosen or not marked[p]]

    def adjoins(i: int) -> bool:
        p, t = found[i]
        return paths.heading[p] or paths.paragraph[p] and bool(SENTENCE.search(t)) and not LEGAL.search(t)

    anchors = [i for i, (p, _) in enumerate(found) if p in chosen or inside[p] or paths.title[p]]
    a, b = anchors[0], anchors[-1]
    while a > 0 and adjoins(a - 1):
        a -= 1
    while b + 1 < len(found) and adjoins(b + 1):
        b += 1
    return "\n\n".join(t for _, t in found[a : b + 1])


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """df without its html column, and text and n_chars (code points)."""
    kept = [c for c in df.columns if c not in (html, "text", "n_chars")]
    (page,) = unused(kept, "page")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(h) if isinstance(h, str) else "" for h in batch[page]]
            yield batch.drop(columns=page).assign(text=texts, n_chars=[len(t) for t in texts])

    source = df.select(*kept, F.col(html).cast("string").alias(page))
    return source.mapInPandas(run, T.StructType([*source.select(*kept).schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
