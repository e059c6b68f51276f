"""Main text of web pages by composite text density.

One pass over the source builds the tree of a page's elements (inline elements
are transparent; every character is read a bounded number of times, whatever
the markup). Menus, footers, sidebars, scripts, styles and whatever else is told
by its element, role or hidden state is left out with all below it. Elements
whose whole class name or id says advert, notice, share or menu, and forms, go
too, unless they hold the page's ``article``, ``main`` or ``h1``, or, where no
element outside is one of these, most of the text that is no link; reader
comments always go. Where other words stand in the name, one that begins or ends
it with comments, adverts or menus (``wp-comments``, ``ad-leaderboard``) is judged
like those; any other noise word counts only if most of the element's own
characters are links, so that ``social-science`` stays; names of states
(``with-sidebar``, ``no-comments``) tell nothing.

Each node's density is its characters per tag, adjusted down by the share of
link characters and link tags. The subtree with the largest sum of child
densities is the core of the article. If it lies in an ``article`` or ``main``
element, that element is the text, as headings and short paragraphs beside the
densest part belong to it. Else the least density on the core's path to the body
is the threshold that other subtrees beside it must reach to belong to the text;
and the core is drawn out to the element around it while it holds half of that.

Results: a null, empty or text-free page gives the empty text, and so does one
of reader comments only; character references are decoded, white space in a
block becomes one space, blocks join by one space in page order; a tag that the
page's end cuts off is no text; repeated rows give repeated results; an empty
table gives an empty table; columns besides those named are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Element names and class words by what they mean here.
RAW = "script style xmp iframe noembed noframes textarea title".split()
NOISE = {*"head nav footer aside button dialog menu fieldset input video audio template noscript svg math object canvas select datalist".split()}
VOID = {*"area base br col embed hr img input link meta param source track wbr".split()}
BLOCK = {*"html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption pre blockquote figure figcaption address header hgroup center details summary hr form".split()}
CORE = {"article", "main", "h1"}
WORDS = {*"ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar footer nav navbar navigation menu breadcrumb breadcrumbs cookie cookies consent gdpr notice notices disclaimer share sharing social related recommended newsletter subscribe signup login popup modal overlay toolbar pagination pager".split()}
COMMENTS = {*"comment comments disqus reply replies respond responses".split()}
#: Words that tell enough at either end of a name; those of a state of what they stand on, which tell nothing.
TELLING = COMMENTS | {*"discussion discussions feedback ad ads advert adverts advertisement advertisements advertising sponsored nav navbar navigation breadcrumb breadcrumbs newsletter related cookie cookies".split()}
STATES = {*"no not has have with without is open opened closed enabled disabled count hide hides hidden off".split()}
#: Words that a class name may have beside those: a name with any other word says something else.
BESIDE = {*"site page main global top bottom left right inner outer sticky fixed box block bar area list item items link links button buttons btn icon icons slot unit zone container content wrapper wrap section group panel row col column body header title heading label text image form field widget module post posts article articles entry story user reader the and more".split()}
ROLES = {*"navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split()}
#: For each kind of element that a later start tag may end: its names, and those that it is not looked for beyond (None: all but div, p, address and inline ones).
ENDED = {
    "p": ({"p"}, {*"html body table td th caption button object blockquote li dd section article main div".split()}),
    "li": ({"li"}, None),
    "dt": ({"dt", "dd"}, None),
    "td": ({"td", "th"}, {"table"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
}
KINDS = list(ENDED)
BY_START = {"li": "li", "dt": "dt", "dd": "dt", "td": "td", "th": "td", "tr": "tr"}
PASSED = {"div", "p", "address"}

MARKUP = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|(!--)|[!?/])")
ATTRIBUTE = re.compile(r"[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>\"'][^\s>]*+))?+)?+)")
READ = {"class", "id", "role", "aria-hidden", "style", "hidden"}
RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in RAW}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^a-zA-Z0-9]+")
LONG_NUMBER = re.compile(r"&#(?:[xX][0-9a-fA-F]{8}[0-9a-fA-F]+|[0-9]{10}[0-9]+);?")

HARD, COMMENT, SOFT, LINKS = 4, 3, 2, 1


@lru_cache(10_000)
def kind_of_name(name: str) -> tuple[int, bool]:
    """What a class name or an id says of its element, by all its words; and whether it says header."""
    parts = [w.rstrip("0123456789") for w in CAMEL.sub(" ", name).lower().split()]
    parts = [w for w in parts if w and not re.fullmatch(r"\d*x?\d*", w)]
    header = "header" in parts and all(w in BESIDE for w in parts)
    if not all(w in WORDS or w in COMMENTS or w in BESIDE for w in parts):
        if STATES.intersection(parts):
            return 0, False
        return (SOFT if parts[0] in TELLING or parts[-1] in TELLING else LINKS if WORDS.intersection(parts) else 0), False
    return (COMMENT if any(w in COMMENTS for w in parts) else SOFT if any(w in WORDS for w in parts) else 0), header


def noise_of(tag: str, attrs: dict[str, str], in_article: bool) -> int:
    """HARD: left out with all below it; SOFT and COMMENT: by class name or id; LINKS: so, if most of it is links; 0: none of these."""
    if tag in NOISE or tag == "header" and not in_article:
        return HARD
    found = SOFT if tag == "form" else 0
    if not attrs or tag in ("html", "body"):
        return found
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or attrs.get("role", "").lower() in ROLES or HIDDEN.search(attrs.get("style", "").lower()):
        return HARD
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        kind, header = kind_of_name(name) if len(name) <= 200 else kind_of_name.__wrapped__(name)
        found = max(found, 0 if kind == LINKS and tag not in BLOCK else kind, SOFT if header and not in_article else 0)
    return found


def attributes(source: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes of interest of the start tag that goes on at ``at``, and where it ends (-1: nowhere)."""
    found: dict[str, str] = {}
    while True:
        m = ATTRIBUTE.match(source, at)
        if m is None:
            return found, -1
        if m[1]:
            return found, m.end()
        at = m.end()
        name = m[2].lower()
        if name in READ:
            found.setdefault(name, m[3] or m[4] or m[5] or "")


def decoded(text: str) -> str:
    if "&" not in text:
        return text
    try:
        return entities.unescape(text)
    except ValueError:  # numbers of thousands of digits
        return entities.unescape(LONG_NUMBER.sub("\ufffd", text))


def ends_at() -> dict[str, Callable[[int, tuple], tuple]]:
    """For each block element: the places in KINDS below it, from its own place and those above it."""
    out = {}
    for tag in BLOCK | {"button", "object", "form"}:
        rule = []
        for kind in KINDS:
            names, edge = ENDED[kind]
            beyond = tag not in PASSED if edge is None else tag in edge
            rule.append(1 if tag in names else 0 if beyond else 2)
        out[tag] = lambda place, above, rule=tuple(rule): tuple((0, place, a)[r] for r, a in zip(rule, above, strict=True))
    return out


ENDS_AT = ends_at()


class Page:
    """The tree: for each node its parent and counts, and the text segments in page order."""

    def __init__(self, source: str):
        self.tag, self.parent, self.noise = ["#page"], [-1], [0]
        self.chars, self.tags, self.link_chars, self.link_tags = [0], [0], [0], [0]
        self.segments: list[tuple[int, int, str]] = []  # (node, run, text): a run has no block edge inside
        self.read(source)
        self.dropped = self.noise_nodes()
        for i in range(len(self.tag) - 1, 0, -1):
            if not self.dropped[i]:
                for counts, own in ((self.chars, 0), (self.tags, 1), (self.link_chars, 0), (self.link_tags, 0)):
                    counts[self.parent[i]] += counts[i] + own

    def read(self, source: str) -> None:
        # Open elements: name, node (-1 in noise), whether in an article, and for each kind in KINDS the place of the innermost one a start tag may end.
        names, nodes, articles, ends = ["#page"], [0], [False], [(0,) * len(KINDS)]
        where: dict[str, list[int]] = {}
        cells = [0]  # for each open element the place of the innermost table cell or table, which end tags don't leave
        run, at, size = 0, 0, len(source)

        def close(k: int) -> None:
            for name in reversed(names[k:]):
                where[name].pop()
            del names[k:], nodes[k:], articles[k:], ends[k:], cells[k:]

        while at < size:
            m = MARKUP.search(source, at)
            if (m.start() if m else size) > at and nodes[-1] >= 0:
                self.text(nodes[-1], run, source[at : m.start() if m else size], bool(where.get("a")))
            if m is None:
                return
            at = m.end()
            tag = m[2]
            if tag is None:
                if m[3] and source.startswith((">", "->"), at):
                    mark = ">"
                else:
                    mark = "-->" if m[3] else ">"
                end = source.find(mark, at)
                at = size if end < 0 else end + len(mark)
                continue
            tag = tag.lower()
            attrs, at = ({}, at + 1) if source.startswith(">", at) else attributes(source, at)
            if at < 0:
                return
            if m[1]:
                k = where.get(tag, [0])[-1] if where.get(tag) else 0
                if k and (k >= cells[-1] or tag in ("table", "tr", "td", "th", "body", "html")):
                    close(k)
                run += tag in BLOCK
                continue
            if tag in RAW_END:
                end = RAW_END[tag].search(source, at)
                at = end.start() if end else size
                continue
            if tag in VOID:
                if tag == "br" and nodes[-1] >= 0:
                    self.segments.append((nodes[-1], run, " "))
                run += tag == "hr"
                continue
            block = tag in BLOCK
            if block:
                run += 1
                for kind in ("p", BY_START.get(tag)):
                    if kind and (k := ends[-1][KINDS.index(kind)]):
                        close(k)
            elif tag == "a" and where.get("a") and (k := where["a"][-1]) >= cells[-1]:
                close(k)
            noise = HARD if nodes[-1] < 0 else noise_of(tag, attrs, articles[-1])
            place, node = len(names), nodes[-1]
            if noise == HARD:
                node = -1
            elif block or noise:
                node = len(self.tag)
                self.tag.append(tag)
                self.parent.append(nodes[-1])
                self.noise.append(noise)
                for counts in (self.chars, self.tags, self.link_chars, self.link_tags):
                    counts.append(0)
            elif tag == "a":
                self.link_tags[node] += 1
                self.tags[node] += 1
            names.append(tag)
            nodes.append(node)
            articles.append(articles[-1] or tag in ("article", "main"))
            cells.append(place if tag in ("td", "th", "table") else cells[-1])
            ends.append(ENDS_AT[tag](place, ends[-1]) if tag in ENDS_AT else ends[-1])
            where.setdefault(tag, []).append(place)

    def text(self, node: int, run: int, text: str, links: bool) -> None:
        text = decoded(text)
        self.segments.append((node, run, text))
        n = len(text.strip())
        self.chars[node] += n
        self.link_chars[node] += n * links

    def noise_nodes(self) -> list[bool]:
        """For each node whether it is left out, itself or by an element around it."""
        size = len(self.tag)
        if not any(self.noise):
            return [False] * size
        if LINKS in self.noise:
            chars, links = [*self.chars], [*self.link_chars]
            for i in range(size - 1, 0, -1):
                chars[self.parent[i]] += chars[i]
                links[self.parent[i]] += links[i]
                if self.noise[i] == LINKS:
                    self.noise[i] = SOFT if 2 * links[i] > chars[i] else 0
        plain = [c - lc for c, lc in zip(self.chars, self.link_chars, strict=True)]
        commented, outside = [False] * size, [True] * size
        cores = [0] * size
        for i in range(1, size):
            commented[i] = commented[self.parent[i]] or self.noise[i] == COMMENT
            outside[i] = outside[self.parent[i]] and not self.noise[i]
            cores[i] = int(self.tag[i] in CORE and not commented[i])
        elsewhere = any(c and o for c, o in zip(cores, outside, strict=True))
        for i in range(size - 1, 0, -1):
            plain[self.parent[i]] += plain[i]
            cores[self.parent[i]] += cores[i]
        for most in (SOFT, COMMENT):
            dropped, left = [False] * size, self.chars[0]
            for i in range(1, size):
                own = self.noise[i] == COMMENT or most == SOFT and self.noise[i] == SOFT and not (cores[i] or not elsewhere and 2 * plain[i] > plain[0])
                dropped[i] = own or dropped[self.parent[i]]
                left += 0 if dropped[i] else self.chars[i]
            if left:
                break
        return dropped

    def densities(self) -> list[float]:
        """Link-adjusted characters per tag of every node."""
        body_links, body_chars = self.link_chars[0], max(1, self.chars[0])
        out = []
        for c, t, lc, lt, gone in zip(self.chars, self.tags, self.link_chars, self.link_tags, self.dropped, strict=True):
            if not c or gone:
                out.append(0.0)
                continue
            plain = c / max(1, t)
            base = math.log(c * lc / max(1, c - lc) + body_links * c / body_chars + math.e)
            share = c * max(1, t) / (max(1, lc) * max(1, lt))
            out.append(plain * math.log(max(share, 1.0)) / base)
        return out

    def content(self) -> list[bool]:
        """For each node whether its text belongs to the article."""
        density = self.densities()
        sums = [0.0] * len(density)
        for i in range(1, len(density)):
            sums[self.parent[i]] += density[i]
        for i in range(len(density)):  # a node with text of its own and no child is its own only part
            sums[i] = sums[i] or density[i]
        core = max(range(len(sums)), key=lambda i: (sums[i], -i))
        path = [core]
        while path[-1] and self.tag[path[-1]] != "body":
            path.append(self.parent[path[-1]])
        on_path = {*path}
        keep = [False] * len(density)
        named = [i for i in path if self.tag[i] in ("article", "main")]
        if named:
            keep[named[0]] = True
        else:
            threshold = min(density[i] for i in path)
            # Headings and short paragraphs often stand beside the densest part, in the element around it.
            while self.tag[up := max(0, self.parent[core])] not in ("body", "html", "#page") and 2 * self.chars[core] >= self.chars[up]:
                core = up
            keep[core] = True
            for i in range(1, len(density)):
                keep[i] |= i not in on_path and density[i] >= threshold and 2 * self.link_chars[i] < self.chars[i]
        for i in range(1, len(density)):
            keep[i] = (keep[i] or keep[self.parent[i]]) and not self.dropped[i]
        return keep


def main_text(source: str | None) -> str:
    if not source:
        return ""
    page = Page(source)
    keep = page.content()
    runs: dict[int, list[str]] = {}
    for node, run, text in page.segments:
        if keep[node]:
            runs.setdefault(run, []).append(text)
    blocks = (" ".join("".join(parts).split()) for parts in runs.values())
    return " ".join(b for b in blocks if b)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per row: a narrow step without a shuffle."""
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                texts = [main_text(h) for h in part["html"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=out)

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
