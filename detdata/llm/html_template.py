"""Main text of web pages by template deduction over equivalence classes (after Arasu & Garcia-Molina 2003).

A page is a sequence of tokens: start tags, each with the chain of elements it stands in and their class, id and role,
so that one tag in two roles is two tokens; and the texts of blocks. A token's occurrence vector says how often each
page of its host holds it. Tokens of a host with the same vector form an equivalence class; a class is valid if it
stands on enough of the host's pages and its tokens stand in one order on all of them. Valid classes nest by the span
of their places: of two whose spans cross, the one on fewer pages is dropped. What is left is the host's template.

The slots of the template are what its innermost open tag token holds of a page. A slot is named by the elements of
its token's chain: it is article text, it is none (menus, headers, footers, sidebars, notices, adverts, forms,
comments), or it is neither. Of a page with an article, its article slots are extracted; of others the slots that are
not ruled out, without the texts that are template tokens themselves. Elements that the template lacks, because few
pages have them, are named by themselves, and so are pages of hosts without a template. Inside an article no text is
dropped because it repeats, but for one case: a container whose class or id has a telling word only as a part of
a longer name is doubtful there, and of its texts those go that are template tokens or mostly links.

So what an occurrence vector can't tell, whether a slot that differs from page to page is an article, an advert or a
comment, the names of elements, classes, ids and roles tell; the template tells slots from fixed texts.

Vectors are never gathered. A vector's name is the sum of hashes of (page, count), so one partial aggregation
by (host, token) finds the classes, however many pages a host has. Copies of one html count once.
"""

import functools
import html as _html
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, scratch, written

#: A class stands on this share of its host's pages, and on this many, at least.
SHARE, LEAST_PAGES = 0.5, 3

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "xmp"}
OUTSIDE = {"nav", "header", "footer", "aside", "form", "head", "menu", "dialog", "button", "select", "object", *RAW}
OUTSIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
#: Words of class and id that name a container without article text.
OUTSIDE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "footer", "sidebar", "aside", "widget", "toc",
    "notice", "notices", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay", "alert", "newsletter", "subscribe", "signup", "login", "paywall",
    "comment", "comments", "reply", "replies", "disqus", "respond", "share", "sharing", "social", "related", "recommended", "pagination", "pager", "form", "search",
}
ARTICLE_ROLES = {"main", "article"}
#: Elements whose end or a new one of the same kind a start tag implies.
CLOSES_P = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "table", "section", "article", "main", "header", "footer", "nav", "aside", "form", "blockquote", "pre", "hr", "figure", "address", "fieldset"}
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag; a ">" inside quotes does not end it. Possessive, so that nothing is tried twice.
_REST = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
#: An attribute with its value, so that no value is taken for attributes.
_ATTR = re.compile(r"""([^\s"'=<>/]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
#: End tags of raw elements; only A-Z fold, so that places in the page stay what they are.
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I | re.A) for name in RAW}
_SPACE, _DIGIT, _NAME = re.compile(r"\s+"), re.compile(r"\d"), re.compile(r"[a-z]+")
#: Elements that a new one of a group closes, and those that it does not reach beyond.
_GROUPS = {"li": ("li",), "option": ("option",), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
_STOPS = ("ul", "ol", "table", "dl", "div", "article", "section", "body", "tbody")
TEXT, ARTICLE, OUTSIDE_BIT = 4, 2, 1


def text_token(text: str) -> int:
    return xxhash.xxh64_intdigest("x:" + text) - (1 << 63)


@functools.lru_cache(maxsize=200_000)
def tag_token(chain: int, tag: str) -> int:
    return xxhash.xxh64_intdigest(f"{chain}>{tag}") - (1 << 63)


@functools.lru_cache(maxsize=20_000)
def _read_short_tag(name: str, attrs: str) -> tuple[str, bool, bool, bool]:
    return _read_tag(name, attrs)


def _read_tag(name: str, attrs: str) -> tuple[str, bool, bool, bool]:
    """(the tag with its class, id and role, outside, article, doubtful). A class or id that is an outside word rules a
    container out; one that has such a word among others ("post-share-header") makes it doubtful."""
    names: dict[str, str] = {}
    for k, a, b, c in _ATTR.findall(attrs) if attrs else ():
        if (k := k.lower()) in ("class", "id", "role"):
            names.setdefault(k, (a or b or c).lower())  # of two of a name, the first holds
    tag = " ".join([name, *(f"{k}={v}" for k, v in sorted(names.items()) if not _DIGIT.search(v))])
    whole = (names.get("class", "") + " " + names.get("id", "")).split()
    article = name in ("article", "main") or names.get("role") in ARTICLE_ROLES
    known = name not in ("html", "body")
    outside = known and (any(w in OUTSIDE_WORDS for w in whole) or names.get("role") in OUTSIDE_ROLES or name in OUTSIDE)
    doubtful = known and not outside and not article and any(not OUTSIDE_WORDS.isdisjoint(_NAME.findall(w)) for w in whole)
    return tag, outside, article and not outside, doubtful


class Block:
    """A block's text, whether it stands in an article, in an outside and in a doubtful container, the slot it is in, and
    whether at least half of it is link text."""

    __slots__ = ("article", "doubtful", "links", "outside", "slot", "text")

    def __init__(self, text, article, outside, doubtful, slot, links):
        self.text, self.article, self.outside, self.doubtful, self.slot, self.links = text, article, outside, doubtful, slot, links


class _Open:
    """The open elements of a page. Each step is O(1) but for elements that it closes."""

    def __init__(self, known):
        self.known, self.stack, self.at, self.blocks = known, [], {}, []
        self.outside = self.article = self.doubtful = 0

    def push(self, name: str, token: int, outside: bool, article: bool, doubtful: bool) -> None:
        slot = token if token in self.known else self.stack[-1][4] if self.stack else None
        self.at.setdefault(name, []).append(len(self.stack))
        if name not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((name, token, outside, article, slot, doubtful))
        self.outside += outside
        self.article += article
        self.doubtful += doubtful

    def cut(self, size: int) -> None:
        """Closes all but the first `size` elements."""
        while len(self.stack) > size:
            name, _, outside, article, _, doubtful = self.stack.pop()
            self.at[name].pop()
            if name not in INLINE:
                self.blocks.pop()
            self.outside -= outside
            self.article -= article
            self.doubtful -= doubtful

    def last(self, *names: str) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def last_block(self) -> int:
        return self.blocks[-1] if self.blocks else -1

    def leave_outside(self) -> None:
        """An article that begins inside an outside container that was not closed ends that container."""
        if self.outside:
            kept = [s for s in self.stack if not s[2] or s[0] in ("article", "main", "section", "div")]
            self.cut(0)
            for name, token, outside, article, _, doubtful in kept:
                self.push(name, token, outside, article, doubtful)


def parse(page: str, known=frozenset()) -> tuple[list[Block], list[tuple[int, int]]]:
    """Blocks of a page, with the tokens of `known` as slots, and its tokens (number, label), in order. Unclosed elements
    end with their parents. Takes time in proportion to the page, however it is nested or broken."""
    blocks, tokens, parts, open_ = [], [], [], _Open(known)
    linked = 0  # characters of parts inside links

    def flush():
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = _SPACE.sub(" ", _html.unescape(raw)).strip()
            parts.clear()
            if text:
                slot = open_.stack[-1][4] if open_.stack else None
                blocks.append(Block(text, open_.article > 0, open_.outside > 0, open_.doubtful > 0, slot, 2 * linked >= len(raw)))
                if not open_.outside and (not open_.article or open_.doubtful):
                    tokens.append((text_token(text), TEXT))
            linked = 0

    at, size, quotes = 0, len(page), True
    endless: set[str] = set()  # raw elements without a further end tag
    while at < size:
        tag = page.find("<", at)
        if tag < 0:
            parts.append(page[at:])
            break
        if tag > at:
            parts.append(page[at:tag])
            if open_.at.get("a"):
                linked += tag - at
        at = tag
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else size
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            at = end + 1 if end >= 0 else size
            continue
        m = _TAG.match(page, at)
        if m is None:
            parts.append("<")
            at += 1
            continue
        rest = _REST.match(page, m.end()) if quotes else None
        if rest is not None:
            attrs, at = rest.group(1), rest.end()
        else:  # a quote that never closes: from here on, any ">" ends a tag
            quotes = False
            end = page.find(">", m.end())
            if end < 0:
                parts.append(page[at:])
                break
            attrs, at = page[m.end() : end], end + 1
        name = m.group(2).lower()
        if name not in INLINE and name not in ("script", "style", "template"):
            flush()
        elif name in ("br", "wbr", "img"):
            parts.append(" " if name == "br" else "")
            continue
        if m.group(1):
            where = open_.last(name)
            if where >= 0 and not (name in INLINE and where < open_.last_block()):  # an inline end tag doesn't close blocks
                open_.cut(where)
            continue
        text, outside, article, doubtful = _read_short_tag(name, attrs) if len(attrs) < 500 else _read_tag(name, attrs)
        if doubtful and not open_.article:  # only inside an article does one word of several need more support
            outside, doubtful = True, False
        chain = open_.stack[open_.last_block()][1] if open_.blocks else 0
        token = chain if name in INLINE else tag_token(chain, text)
        if name in VOID or attrs.endswith("/") and name not in INLINE and name not in OUTSIDE:
            if name not in INLINE:
                tokens.append((token, (OUTSIDE_BIT if open_.outside else 0) | (ARTICLE if open_.article else 0)))
            continue
        if name in RAW:
            found = None if name in endless else _ENDS[name].search(page, at)
            if found is None:
                endless.add(name)
                if name in ("script", "style"):
                    break
                continue
            close = page.find(">", found.start())
            at = close + 1 if close >= 0 else size
            continue
        if name in CLOSES_P:
            last = open_.last_block()
            if last >= 0 and open_.stack[last][0] == "p":
                open_.cut(last)
        elif name in _GROUPS:
            where = open_.last(*_GROUPS[name])
            if where > open_.last(*_STOPS, "tr" if name in ("td", "th") else "ul"):
                open_.cut(where)
        if article and not open_.article:
            open_.leave_outside()
        if name not in INLINE:
            chain = open_.stack[open_.last_block()][1] if open_.blocks else 0
            token = tag_token(chain, text)
            tokens.append((token, (OUTSIDE_BIT if open_.outside or outside else 0) | (ARTICLE if open_.article or article else 0)))
        open_.push(name, token, outside, article, doubtful)
    flush()
    return blocks, tokens


def _count_tokens(batches):
    for b in batches:
        keys, hosts = b.column(0), b.column(1)
        row, token, n, first, label = [], [], [], [], []
        for i, page in enumerate(b.column(2).to_pylist()):
            tokens = parse(page or "")[1]
            place, marks = {}, {}
            for j, (t, mark) in enumerate(tokens):
                place.setdefault(t, j)
                marks[t] = mark
            for t, c in Counter(t for t, _ in tokens).items():
                row.append(i), token.append(t), n.append(c), first.append(place[t]), label.append(marks[t])
        take = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([keys.take(take), hosts.take(take), pa.array(token, pa.int64()), pa.array(n, pa.int32()), pa.array(first, pa.int32()), pa.array(label, pa.int32())], names=["page", "host", "token", "n", "place", "label"])


def _nested(pdf: pd.DataFrame) -> pd.DataFrame:
    """The classes of one host (host, class, lo, hi, support) that nest, each with its parent."""
    kept: list[tuple] = []
    rows = pdf[["class", "lo", "hi", "support"]].itertuples(index=False, name=None)
    for name, lo, hi, support in sorted(rows, key=lambda c: (-c[3], c[1] - c[2], c[1], c[0])):
        if not any(a < lo <= b < hi or lo < a <= hi < b for _, a, b in kept):
            kept.append((name, lo, hi))
    kept.sort(key=lambda c: (c[1], -c[2]))
    out, open_ = [], []
    for name, lo, hi in kept:
        while open_ and open_[-1][1] < hi:
            open_.pop()
        out.append((pdf["host"].iloc[0], name, open_[-1][0] if open_ else None))
        open_.append((name, hi))
    return pd.DataFrame(out, columns=["host", "class", "parent"])


def template(pages: DataFrame, host: str, html: str, share: float = SHARE, least: int = LEAST_PAGES) -> DataFrame:
    """(host, class, token, label, support, place, parent): the valid classes of each host, their tokens with places, and
    the class they nest in. Pages of a host with equal html are one page."""
    whole = pages.select(F.xxhash64(html).alias("page"), F.col(host).alias("host"), F.col(html).alias("_html"))
    counts = whole.mapInArrow(_count_tokens, "page long, host string, token long, n int, place int, label int")
    counts = written(counts.groupBy("host", "page", "token").agg(*[F.max(c).alias(c) for c in ("n", "place", "label")]), "page_tokens")
    vector = F.sum(F.xxhash64("page", "n").cast("decimal(38,0)")).cast("string").alias("class")
    tokens = counts.groupBy("host", "token").agg(vector, F.count("*").alias("support"), F.avg("place").alias("place"), F.max("label").alias("label"))
    of = whole.groupBy("host").agg(F.count_distinct("page").alias("pages"))
    common = tokens.join(of, "host").where((F.col("support") >= least) & (F.col("support") >= F.col("pages") * share))
    rank = F.row_number().over(Window.partitionBy("host", "class").orderBy("place", "token"))  # a class is part of a page
    common = written(common.select("host", "token", "class", "support", "place", "label", rank.alias("rank")), "template_tokens")
    # a class whose tokens stand in another order on some page is none; a page gives each class once
    order = counts.join(common.select("host", "token", "class", "rank"), ["host", "token"]).groupBy("host", "class", "page").agg(F.array_sort(F.collect_list(F.struct("place", "rank"))).alias("o"))
    ranks = F.transform("o", lambda x: x["rank"])
    broken = order.where(ranks != F.array_sort(ranks)).select("host", "class").distinct()
    classes = common.groupBy("host", "class").agg(F.min("place").alias("lo"), F.max("place").alias("hi"), F.max("support").alias("support"))
    classes = written(classes.join(broken, ["host", "class"], "left_anti"), "classes")
    nested = classes.groupBy("host").applyInPandas(_nested, "host string, class string, parent string")
    return common.join(nested, ["host", "class"]).select("host", "class", "token", "label", "support", "place", "parent")


def main_text(page: str, known=frozenset(), slots=frozenset(), repeated=frozenset()) -> str:
    """The text of a page by its host's template: its tag tokens, those of them whose slots are extracted, and the texts
    that are tokens themselves. What stands in no slot of the template is named by the page alone."""
    blocks, tokens = parse(page, known)
    inside = [b for b in blocks if not b.outside and (b.slot is None or b.slot in slots) and not (b.article and b.doubtful and (b.links or text_token(b.text) in repeated))]
    if any(mark & ARTICLE for _, mark in tokens):
        return "\n".join(b.text for b in inside if b.article)
    return "\n".join(b.text for b in inside if text_token(b.text) not in repeated)


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", share: float = SHARE, least: int = LEAST_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by line
    feeds in page order. Null or empty html gives an empty text; a null url or one without "://" is a host of its
    own; rows of a host with equal html are one page for the template and give equal results; other columns are ignored;
    an empty table gives an empty one. The templates are joined to the pages by host.
    """
    host = F.coalesce(lower_ascii(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))
    d = pages.select(F.col(page_id).alias("_id"), F.col(url).alias("_url"), host.alias("_host"), F.col(html).alias("_html"))
    with scratch(d.sparkSession):
        found = template(d, "_host", "_html", share, least)
        text, outside = (F.col("label").bitwiseAND(b) != 0 for b in (TEXT, OUTSIDE_BIT))
        set_of = lambda what: F.array_sort(F.collect_list(F.when(what, F.col("token"))))
        per = found.groupBy("host").agg(set_of(~text).alias("known"), set_of(~text & ~outside).alias("slots"), set_of(text).alias("texts"))
        per = written(per, "templates", up=1)
    src = d.join(per, d["_host"] == per["host"], "left").select("_id", "_url", "_html", "host", "known", "slots", "texts")
    kind, url_kind = (d.schema[c].dataType.simpleString() for c in ("_id", "_url"))

    def run(batches):
        names: dict = {}
        for b in batches:
            hosts, out = b.column(3).to_pylist(), []
            for i, page in enumerate(b.column(2).to_pylist()):
                if hosts[i] is None:
                    out.append(main_text(page or ""))
                    continue
                if hosts[i] not in names:
                    if len(names) > 1000:
                        names.clear()
                    names[hosts[i]] = [frozenset(b.column(c)[i].as_py()) for c in (4, 5, 6)]
                out.append(main_text(page or "", *names[hosts[i]]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["_id", "_url", "text"])

    got = src.mapInArrow(run, f"_id {kind}, _url {url_kind}, text string")
    return got.select(F.col("_id").alias(page_id), F.col("_url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
