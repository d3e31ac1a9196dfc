"""Main text of web pages: the contiguous region with the greatest score of its words and tags.

A page is a sequence of words and tags. Words score positive, words of links less, tags negative, with weights learnt
from pages whose main element is marked. One linear scan finds the region with the greatest sum; where the page marks its
main element, the region lies in it. Elements that say by their name, role, class or id that they hold something else
(menus, notices, forms, comments, ...) are passed over as a whole, unless they are wrapped around the page's main element
or most of its words. What a class word says is weighed: by where it stands in the labelled pages, from a start for well-known
words. Inside a main element only the clear ones of these count (so a section on social policy stays), and learning can
just raise them. Reading takes time in proportion to the page, however odd it is.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate
from math import log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from venuematch.llm.shipping import workers_ready

SAMPLE_PAGES = 500
SAMPLE_CHARS = 100_000
EPOCHS = 5
RATE = 0.1
# Words never score less than this, and tags never more.
LEAST_WORD = 0.2
MOST_TAG = -0.02

# Fixed values of the HTML language: elements without content, with raw content, and those that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe object svg math canvas audio video title head".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul".split()
)
SPACED = frozenset(["br"])
MAIN = frozenset(["article", "main"])
# Elements that end without an end tag: what ends each, what holds it, and the holders by tag.
ENDED_BY = {"li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "td": ["td", "th"], "th": ["td", "th"], "tr": ["td", "th", "tr"], "option": ["option"]}
HELD = {"li": "list", "dt": "dl", "dd": "dl", "td": "table", "th": "table", "tr": "table", "option": "select"}
HOLDERS = {"ul": "list", "ol": "list", "menu": "list", "dl": "dl", "table": "table", "select": "select"}
PASSED = frozenset("nav aside footer form button select menu dialog search fieldset".split())
# Of these, the ones that may be wrapped around a whole page.
WRAPPERS = frozenset("form fieldset".split())
PASSED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())

_OPENING = re.compile(r"<(?:(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)|!--|!\[CDATA\[|[!?])")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTR = re.compile(r"(class|id|role|style|aria-hidden|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\bhidden(?=[\s/=]|\Z)", re.IGNORECASE)

# Words of class and id names that say what an element holds, and where the learning of their weights starts from.
CLEAR = frozenset(
    "ad ads adsense adbox adslot comments comment commentlist disqus sidebar sidebars sidenav menu menus nav navbar navigation topbar "
    "toolbar breadcrumb breadcrumbs footer cookie cookies gdpr newsletter pagination pager share sharing signup login popup paywall "
    "kommentar kommentare werbung anzeige seitenleiste commentaire commentaires publicite comentario comentarios publicidad".split()
)
CLEAR_STARTS = ("advert", "sponsor")
VAGUE = frozenset(
    "banner banners consent notice notices alert alerts disclaimer respond replies widget widgets social related subscribe "
    "subscription modal overlay tags skip masthead header head".split()
)
VAGUE_STARTS = ("promo", "recommend")
COMMENTS = ("comment", "kommentar", "comentario")
CLEAR_WEIGHT, VAGUE_WEIGHT = -3.0, -1.0
# Counts added on both sides before a ratio is taken, and the most that learning may change a weight by.
ODDS_PRIOR, MOST_ODDS = 5, 3.0


@lru_cache(4096)
def _attributes(attrs: str) -> tuple[frozenset[str], dict[str, str]]:
    """(words of class and id, the other attributes read here)."""
    words, others = set(), {}
    for m in _ATTR.finditer(attrs):
        key, value = (m[1] or "hidden").lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            words.update(w.rstrip("0123456789") for w in re.split(r"[\s_-]+", value))
        else:
            others[key] = value
    words.discard("")
    return frozenset(words), others


def _class_weight(word: str, in_main: bool, odds: dict[str, float]) -> float:
    """Inside the main element only clear words count, and learning can just raise them: nothing else is taken out there."""
    learnt_odds = odds.get(word, 0.0)
    if word in CLEAR or word.startswith(CLEAR_STARTS):
        return CLEAR_WEIGHT + (max(0.0, learnt_odds) if in_main else learnt_odds)
    if in_main:
        return 0.0
    return learnt_odds + (VAGUE_WEIGHT if word in VAGUE or word.startswith(VAGUE_STARTS) else 0.0)


def _passed(name: str, attrs: str, in_main: bool, by_name_only: bool, odds: dict[str, float]) -> bool:
    """Whether an element holds something else than the page's own text."""
    if name in PASSED or name == "header" and not in_main:
        return True
    if by_name_only or name in ("main", "body", "html") or not attrs:
        return False
    words, others = _attributes(attrs)
    if name == "article":
        return any(w.startswith(COMMENTS) for w in words)
    if "hidden" in others or others.get("aria-hidden") == "true" or others.get("role") in PASSED_ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", others.get("style", "")):
        return True
    return min((_class_weight(w, in_main, odds) for w in words), default=0.0) <= VAGUE_WEIGHT


@dataclass
class Block:
    """Text between two block boundaries, and where its tokens are."""

    parts: list[str] = field(default_factory=list)
    first: int = 0
    last: int = 0


class Node:
    """A text (no name; ``n`` words), a tag, an end tag (``/name``) or a raw element (``raw``).

    ``end`` is the node that ends an element: its own end tag or the tag before which it ends; None if nothing ends it.
    """

    __slots__ = ("name", "value", "n", "end")

    def __init__(self, name: str, value: str) -> None:
        self.name, self.value, self.n, self.end = name, value, 0, None


def _text(value: str) -> Node:
    node = Node("", html.unescape(value) if "&" in value else value)
    node.n = len(node.value.split())
    return node


def nodes(page: str) -> list[Node]:
    """The nodes of a page, read once from front to end: no place is searched again for an end that is missing."""
    found: list[Node] = []
    at, quoted, gone = 0, True, set()
    while (m := _OPENING.search(page, at)) is not None:
        if m.start() > at:
            found.append(_text(page[at : m.start()]))
        at, mark, name = m.start(), m[0], (m["name"] or "").lower()
        if mark == "<!--":
            end = page.find("-->", at + 2)
            at = len(page) if end < 0 else end + 3
            continue
        if mark == "<![CDATA[" and mark not in gone:
            end = page.find("]]>", m.end())
            if end >= 0:
                found.append(_text(page[m.end() : end]))
                at = end + 3
                continue
            gone.add(mark)
        end = page.find(">", m.end()) + 1
        if not end:
            break
        if not name:
            at = end
            continue
        if quoted:
            rest = _REST.match(page, m.end())
            # A quote that nothing closes: from here on tags end at the next sign.
            quoted = rest is not None
            end = rest.end() if quoted else end
        attrs, at = page[m.end() : end - 1], end
        if m["close"]:
            found.append(Node("/" + name, ""))
        elif name in RAW:
            found.append(Node("raw", ""))
            close = None
            if name not in gone and not attrs.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            if close:
                at = page.find(">", close.end()) + 1 or len(page)
            elif not attrs.endswith("/"):
                gone.add(name)
                at = len(page) if name in ("script", "style", "textarea", "svg") else at
        else:
            found.append(Node(name, attrs))
    if at < len(page):
        found.append(_text(page[at:]))
    _link(found)
    return found


def _link(found: list[Node]) -> None:
    """Sets the ends of elements, by one list of open ones for each name."""
    opened: dict[str, list[tuple[int, int]]] = defaultdict(list)
    depth: Counter = Counter()

    def ended(name: str, i: int, level: int) -> None:
        while opened[name] and opened[name][-1][1] >= level:
            found[opened[name].pop()[0]].end = i

    for i, node in enumerate(found):
        close, name = node.name.startswith("/"), node.name.lstrip("/")
        if name in BLOCKS:
            ended("p", i, 0)
        group = HOLDERS.get(name)
        if close:
            if group and depth[group]:
                for inner in ENDED_BY:
                    if HELD[inner] == group:
                        ended(inner, i, depth[group])
                depth[group] -= 1
            if opened[name]:
                found[opened[name].pop()[0]].end = i
        elif name and name != "raw" and name not in VOID and not node.value.endswith("/"):
            for other in ENDED_BY.get(name, ()):
                ended(other, i, depth[HELD[other]])
            opened[name].append((i, depth[HELD[name]] if name in HELD else 0))
            if group:
                depth[group] += 1


def _after(found: list[Node], i: int) -> int:
    """The node after the element at ``i``; one that nothing ends takes its own text only."""
    node = found[i]
    if node.end is None:
        return i + 2 if i + 1 < len(found) and not found[i + 1].name and node.name not in VOID and not node.value.endswith("/") else i + 1
    return node.end + 1 if found[node.end].name == "/" + node.name else node.end


def _is_main(node: Node) -> bool:
    if node.name in MAIN:
        return True
    if not node.value or node.name in ("body", "html"):
        return False
    others = _attributes(node.value)[1]
    return others.get("role") == "main" or others.get("itemprop") == "articlebody"


@dataclass
class Outline:
    """How many words outside links a page has before each node, and the nodes of its main element."""

    upto: list[int]
    main: tuple[int, int] | None = None

    def words(self, start: int, end: int) -> int:
        return self.upto[end] - self.upto[start]

    def wrapped(self, start: int, end: int) -> bool:
        """Whether the main element lies between, or without one most of the words."""
        if self.main is not None:
            return start <= self.main[0] < end
        return 2 * self.words(start, end) > self.upto[-1]


def outlined(found: list[Node]) -> Outline:
    """The main element is the one marked so with most words that lies in no menu, footer or the like.

    Where it has just one article with at least half of its words, it is that article, with a heading of the page before it.
    """
    upto, marked, links, skip = [], [], 0, 0
    total = 0
    for i, node in enumerate(found):
        upto.append(total)
        if i < skip:
            continue
        if not node.name:
            total += 0 if links else node.n
        elif node.name == "/a":
            links -= links > 0
        elif node.name == "a":
            links += 1
        elif node.name in PASSED - WRAPPERS or node.name == "article" and _passed("article", node.value, False, False, {}):
            skip = _after(found, i)
        elif _is_main(node):
            marked.append((i, len(found) if node.end is None else node.end))
    out = Outline([*upto, total])
    biggest = max(marked, key=lambda span: (out.words(*span), -span[0]), default=None)
    if biggest is None or not out.words(*biggest):
        return out
    inner, reach = [], 0
    for span in marked:
        if biggest[0] < span[0] < biggest[1] and span[0] >= reach:
            inner.append(span)
            reach = span[1]
    out.main = biggest
    if found[biggest[0]].name != "article" and len(inner) == 1 and 2 * out.words(*inner[0]) >= out.words(*biggest):
        first = inner[0][0]
        heads = [i for i in range(*biggest) if found[i].name == "h1"]
        if heads and heads[0] < first and not any(inner[0][0] < i < inner[0][1] for i in heads):
            first = heads[0]
        out.main = (first, inner[0][1])
    return out


def parsed(
    found: list[Node], odds: dict[str, float], by_name_only: bool = False
) -> tuple[list[tuple[str, int]], list[Block], tuple[int, int] | None]:
    """(tokens, blocks, tokens of the main element). A token is its kind and how many words it stands for (0: a tag)."""
    outline = outlined(found)
    first, last = outline.main or (-1, -1)
    tokens: list[tuple[str, int]] = []
    blocks, links, i, main_tokens = [Block()], 0, 0, [None, None]
    while i < len(found):
        node, name = found[i], found[i].name
        for k, place in enumerate((first, last)):
            if place >= 0 and main_tokens[k] is None and i >= place:
                main_tokens[k] = len(tokens)
        if not name:
            block = blocks[-1]
            if node.n:
                if not block.last:
                    block.first = len(tokens)
                tokens.append(("link word" if links else "word", node.n))
                block.last = len(tokens)
            block.parts.append(node.value)
            i += 1
            continue
        if name.lstrip("/") in BLOCKS:
            blocks.append(Block())
        if name == "raw":
            tokens.append(("raw", 0))
        elif name[0] == "/":
            tokens.append((name, 0))
            links -= name == "/a" and links > 0
        elif i != first and _passed(name, node.value, first < i < last, by_name_only, odds):
            tokens.append((f"passed {name}", 0))
            may_wrap = name in WRAPPERS or name not in PASSED and name != "header"
            # The tag of a wrapper stays in the sequence, and what is in it is read.
            if not (may_wrap and node.end is not None and outline.wrapped(i, node.end)):
                i = _after(found, i)
                if name in BLOCKS:
                    blocks.append(Block())
                continue
        else:
            tokens.append((name, 0))
            links += name == "a"
            if name in SPACED:
                blocks[-1].parts.append(" ")
        i += 1
    if first < 0:
        return tokens, [b for b in blocks if b.last], None
    return tokens, [b for b in blocks if b.last], tuple(len(tokens) if t is None else t for t in main_tokens)


@dataclass(frozen=True)
class RegionModel:
    """Weights by kind of token; ``tag`` is the weight of an unknown tag, ``odds`` what was learnt on class words."""

    weights: dict[str, float]
    tag: float = -1.0
    odds: dict[str, float] = field(default_factory=dict)

    def weight(self, token: tuple[str, int]) -> float:
        kind, n = token
        return self.weights.get(kind, self.tag) * (n or 1)

    def region(self, tokens: list[tuple[str, int]], within: tuple[int, int] | None = None) -> tuple[int, int]:
        """First token and end of the region with the greatest sum, the first of equal ones; one scan.

        ``within`` are the tokens of the main element, if the page marks one: the region lies in it, and its tags count
        nothing, so that none of its words is lost.
        """
        start, stop = within or (0, len(tokens))
        best, found, total, begin = 0.0, (start, start), 0.0, start
        for i in range(start, stop):
            if total <= 0:
                total, begin = 0.0, i
            if tokens[i][1] or within is None:
                total += self.weight(tokens[i])
            if total > best:
                best, found = total, (begin, i + 1)
        return found

    def extract(self, page: str | None) -> str:
        """The text of the blocks that the region touches, one line each; empty for a page without words."""
        found = nodes(page or "")
        for by_name_only in (False, True):
            tokens, blocks, main = parsed(found, self.odds, by_name_only)
            first, end = self.region(tokens, main)
            lines = (" ".join("".join(b.parts).split()) for b in blocks if b.first < end and b.last > first)
            text = "\n".join(line for line in lines if line)
            # A page whose outermost element has a telling class is read again by element names.
            if text:
                return text
        return ""


# What the weights start from, and keep for kinds that no labelled page has.
START = RegionModel(
    {"word": 1.0, "link word": 0.3, "raw": -0.1}
    | {f"passed {n}": -0.1 for n in PASSED | BLOCKS}
    | {t: -0.1 for n in "p b i em strong span u s small sub sup code q cite mark abbr br blockquote h1 h2 h3 h4 h5 h6 pre li ul ol figure figcaption img td tr table tbody dl dt dd".split() for t in (n, "/" + n)}
    | {t: -0.5 for n in "a section header div".split() for t in (n, "/" + n)}
    | {t: -20.0 for t in ("/body", "/html", "body", "html")}
    | {t: MOST_TAG for t in ("/article", "/main", "article", "main")}
)


def class_odds(pages: list[list[Node]]) -> dict[str, float]:
    """Log ratios of how many pages have a class word inside and outside their main element, on elements with words.

    Elements around the main element and words of the main element's own tag are not counted.
    """
    inside, outside = Counter(), Counter()
    for found in pages:
        main = outlined(found).main
        if main is None:
            continue
        upto = list(accumulate((node.n for node in found), initial=0))
        sides: tuple[set[str], set[str]] = (set(), set())
        for i, node in enumerate(found):
            if node.end is None or not node.value or not node.name or i <= main[0] < node.end or upto[node.end] == upto[i]:
                continue
            sides[0 if main[0] < i < main[1] else 1].update(_attributes(node.value)[0])
        inside.update(sides[0])
        outside.update(sides[1])
    ratio = {w: log((inside[w] + ODDS_PRIOR) / (outside[w] + ODDS_PRIOR)) for w in inside | outside}
    return {w: max(-MOST_ODDS, min(MOST_ODDS, r)) for w, r in ratio.items()}


def learnt(pages: list[str], start: RegionModel = START, epochs: int = EPOCHS) -> RegionModel:
    """Weights from pages with a marked main element: what it has more of than the region found without marks scores higher.

    A page is right if the found region touches the same words. Weights of words stay positive, those of tags negative.
    """
    weights, read = dict(start.weights), [nodes(page) for page in pages]
    odds = class_odds(read)
    known = []
    for found in read:
        tokens, _, main = parsed(found, odds)
        if main is not None and any(n for _, n in tokens[slice(*main)]):
            known.append((tokens, main))
    for _ in range(epochs):
        wrong = 0
        for tokens, (first, end) in known:
            region = RegionModel(weights, start.tag).region(tokens)
            at = lambda a, b: [i for i in range(a, b) if tokens[i][1]]
            if at(*region) == at(first, end):
                continue
            wrong += 1
            change = Counter()
            for a, b, sign in ((first, end, 1), (*region, -1)):
                for kind, n in tokens[a:b]:
                    change[kind] += sign * max(1, n)
            for kind, times in change.items():
                if kind.lstrip("/") in MAIN:
                    continue
                step = RATE * max(-10, min(10, times))
                value = weights.get(kind, start.tag) + step
                weights[kind] = max(LEAST_WORD, min(2.0, value)) if "word" in kind else min(MOST_TAG, value)
        if not wrong:
            break
    return RegionModel(weights, start.tag, odds)


def trained_model(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, sample_chars: int = SAMPLE_CHARS) -> RegionModel:
    """A model from ``pages(url, html)`` that mark their main element, at most ``sample_pages`` of ``sample_chars`` or less.

    The sample is that of the least hashes of url and html. Without labelled pages the weights are the starting ones.
    """
    page = F.col("html").cast("string")
    marked = pages.filter(page.rlike("(?i)<(article|main)[\\s>]") & (F.length(page) <= sample_chars)).select(page.alias("html"))
    keyed = marked.select(F.xxhash64("html").alias("key"), "html")
    # The keys are chosen first, so that only the chosen pages are moved.
    keys = [r[0] for r in keyed.select("key").distinct().orderBy("key").limit(sample_pages).collect()]
    rows = keyed.filter(F.col("key").isin(keys)).dropDuplicates(["key"]).orderBy("key").limit(sample_pages).collect() if keys else []
    return learnt([r["html"] for r in rows])


def main_text(pages: DataFrame, model: RegionModel | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages(page_id, url, html)``; other columns are not read.

    Character references are decoded, white space inside a block is one space, blocks are joined by a line break in page
    order. A null, empty or wordless page has an empty text. Rows are read one by one, so repeated rows agree. Learns
    the weights when called without a model; extracting is one narrow pass, in time and memory in proportion to a page.
    """
    workers_ready(pages.sparkSession)
    model = model or trained_model(pages)

    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([model.extract(t) for t in batch], dtype=object)

    text = pages.select("page_id", "url", run(F.col("html").cast("string")).alias("text"))
    return text.withColumn("n_chars", F.length("text").cast("long"))
