"""Main text of web pages by site template removal.

Element subtrees are hashed and counted per host in Spark; subtrees that recur
across many pages of their host are template and are deleted. Three kinds of
hash are counted:

* of a subtree outside plain article content: tag, class and id, children and
  text, outside articles with digits as 0, so that counters and dates do not hide a recurrence;
* of a menu, that is a subtree outside articles whose text is nearly all in two or more
  links: tag and class and the set of its children's kinds, without texts, as menus often
  differ from page to page in their items;
* of a block at the edge of an article (its first two and last two): its text.
  Plain paragraphs, headings and lists inside an article are content even where some pages
  repeat them, so such a block is template only on half of its host's pages, before or behind
  blocks that differ.

The other two kinds are template on ``least_pages`` pages that differ and ``least_share`` of the host's
pages, or on ``sure_pages`` that differ, however large the host is. What is left is read
by structure: all of main and of the articles outside it (without either, the body),
without navigation, header, footer, aside, form, script and style elements
or elements named as adverts, notices, sidebars and comments. These hints serve
hosts with too few pages to count, and boilerplate that differs on every page.

Pages are parsed twice: once for hashes and once, beside the template hashes
they hold, for the text. Counts are keyed by (host, hash) and collapse in
the map tasks, so a large host is not gathered anywhere.

NULL or empty html gives an empty text, a NULL url an empty host. Repeated rows
keep their rows and count as one page of a host. Of equal blocks all stay. Extra columns are ignored, whatever their names.
An empty table gives an empty result. Pages of any length are read whole, in time linear in their length. Broken markup is read as
browsers do in the common cases: paragraphs and list items close
implicitly, stray end tags are skipped, a tag that the page's end cuts off is no text, open elements end with the page.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stored
from .common import bounded_batches, hot_join, if_small, lean
from .url_filter import host_path

# Kinds of elements (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("head script style template noscript iframe object svg canvas nav header footer aside form button select textarea input dialog menu title".split())
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table thead tbody tfoot tr td th figure figcaption b i em strong span a code sub sup br q cite small mark u s del ins abbr time img hgroup".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "dt", "dd", "li"}
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table div section article main body html td th".split())
# Words that name boilerplate as the whole of a class, id or role, or beside the neutral words; the sure ones on plain content too (fixed values).
SURE_NAMES = frozenset("ad ads advert adverts advertisement advertising adslot adsense sponsor sponsored sponsors cookie cookies consent comment comments disqus newsletter subscribe subscription popup modal notice notices".split())
NAMES = SURE_NAMES | frozenset("banner breadcrumb breadcrumbs footer header masthead menu nav navbar navigation pagination pager promo promos promotion related recommended search share sharing sidebar social toolbar widget widgets contentinfo complementary".split())
NEUTRAL = frozenset("area bar block body box button buttons container content field form global group inner item items left link links list lower main mobile outer overlay page pane panel primary right row secondary section signup site slot strip sub thread top bottom unit upper wrap wrapper".split())

SIMPLE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)>")
NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_GAP, _ATTR, _IS, _BARE = re.compile(r"[\s/]*"), re.compile(r"[^\s/>][^\s/>=]*"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_DIGITS, _PARTS = re.compile(r"\d+"), re.compile(r"[-_]+")


class Element:
    __slots__ = ("attrs", "children", "hashes", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.hashes: tuple[int, ...] = ()  # by which the subtree may be deleted


def _attributes(page: str, at: int) -> tuple[int, dict[str, str]] | None:
    """The place behind a tag's end and its attributes; None if the page ends before."""
    attrs: dict[str, str] = {}
    n = len(page)
    while True:
        at = _GAP.match(page, at).end()
        if at >= n:
            return None
        if page[at] == ">":
            return at + 1, attrs
        m = _ATTR.match(page, at)
        name, value, at = m.group().lower(), "", m.end()
        is_ = _IS.match(page, at)
        if is_:
            at = is_.end()
            quote = page[at : at + 1]
            if quote in ('"', "'") and quote:
                end = page.find(quote, at + 1)
                if end < 0:
                    return None
                value, at = page[at + 1 : end], end + 1
            else:
                m = _BARE.match(page, at)
                value, at = m.group(), m.end()
        attrs.setdefault(name, value)


class _Builder:
    """The open elements, with counts of their tags by scope, so that no end tag searches in vain."""

    def __init__(self):
        self.root = Element("html", {}, None)
        self.open = [self.root]
        self.scopes: list[tuple[int, Counter]] = [(0, Counter())]
        self.every: Counter = Counter()

    def push(self, e: Element) -> None:
        self.open.append(e)
        self.every[e.tag] += 1
        if e.tag in SCOPE:
            self.scopes.append((len(self.open) - 1, Counter()))
        else:
            self.scopes[-1][1][e.tag] += 1

    def pop(self) -> Element:
        e = self.open.pop()
        self.every[e.tag] -= 1
        if self.scopes[-1][0] == len(self.open):
            self.scopes.pop()
        else:
            self.scopes[-1][1][e.tag] -= 1
        return e

    def scope(self) -> str:
        return self.open[self.scopes[-1][0]].tag

    def close(self, tags: set[str]) -> str:
        while True:
            e = self.pop()
            if e.tag in tags:
                return e.tag

    def end(self, tag: str) -> None:
        inner = self.scopes[-1][1][tag] if tag not in SCOPE and tag not in BLOCK else self.every[tag]
        if inner > 0:
            self.close({tag})

    def start(self, tag: str) -> None:
        """Closes what a start tag ends."""
        if tag in CLOSES_P and self.scopes[-1][1]["p"] > 0:
            self.close({"p"})
        ends = IMPLIED.get(tag)
        while ends and (self.scope() in ends or any(self.scopes[-1][1][t] > 0 for t in ends)):
            if self.close(ends) == tag:
                break


def parse(page: str | None) -> Element:
    """The element tree; children are elements and strings of raw text. One pass over the page."""
    b = _Builder()
    at, page = 0, page or ""
    n = len(page)
    while at < n:
        here = b.open[-1]
        lt = page.find("<", at)
        if lt < 0:
            here.children.append(page[at:])
            break
        m = SIMPLE.match(page, lt)
        if m:
            closes, tag, after, attrs, empty = m.group(1), m.group(2).lower(), m.end(), {}, False
        else:
            m = NAME.match(page, lt)
            if m is None:
                if page.startswith(("<!", "<?", "</"), lt) and page[lt + 2 : lt + 3] != "":
                    end = page.find("-->", lt + 4) if page.startswith("<!--", lt) else page.find(">", lt)
                    if lt > at:
                        here.children.append(page[at:lt])
                    at = n if end < 0 else end + (3 if page.startswith("<!--", lt) else 1)
                else:
                    here.children.append(page[at : lt + 1])
                    at = lt + 1
                continue
            closes, tag = page[lt + 1] == "/", m.group(1).lower()
            found = _attributes(page, m.end())
            if found is None:
                if lt > at:
                    here.children.append(page[at:lt])
                break
            after, attrs = found
            empty = page[after - 2] == "/" and tag not in BLOCK
        if lt > at:
            here.children.append(page[at:lt])
        at = after
        if closes:
            b.end(tag)
            continue
        if tag == "html" and len(b.open) == 1:
            b.root.attrs = b.root.attrs or attrs
            continue
        b.start(tag)
        here = b.open[-1]
        child = Element(tag, attrs, here)
        here.children.append(child)
        if tag in RAW:
            end = _raw_end(tag).search(page, at)
            child.children.append(page[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not empty:
            b.push(child)
    return b.root


_RAW_ENDS = {t: re.compile(f"</{t}\\s*>", re.I) for t in RAW}


def _raw_end(tag: str) -> re.Pattern:
    return _RAW_ENDS[tag]


def _named(e: Element, plain: bool = False) -> bool:
    """Whether attributes name boilerplate; of plain article content only by the sure names."""
    a = e.attrs
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or ("style" in a and HIDDEN.search(a["style"])):
        return True
    names = SURE_NAMES if plain else NAMES
    for k in ("class", "id", "role"):
        for token in a.get(k, "").lower().split():
            parts = [p for p in _PARTS.split(_DIGITS.sub("", token)) if p]
            if any(p in names for p in parts) and all(p in NAMES or p in NEUTRAL for p in parts):
                return True
    return False


#: Elements that are never deleted as a whole.
KEPT = frozenset(("html", "body", "head", "article", "main"))


def _is_main(e: Element) -> bool:
    return e.tag in ("article", "main") or e.attrs.get("role") == "main"


def _hint(e: Element, inside: bool) -> bool:
    """Whether structure alone drops an element."""
    return e.tag in DROPPED or _named(e, inside and e.tag in CONTENT)


def _digest(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _label(e: Element) -> str:
    return _DIGITS.sub("0", " ".join((e.tag, e.attrs.get("class", ""), e.attrs.get("id", ""))))


def _squeeze(text: str) -> str:
    return _DIGITS.sub("0", " ".join(text.split()))


def hash_tree(root: Element) -> list[tuple[int, int]]:
    """Hashes of all deletable subtrees, each with what must differ between pages (0: the page itself).

    Bottom up, without recursion. Below an element that a hint drops only the element itself is
    hashed; plain content of an article only at its edges.
    """
    found: dict[int, int] = {}
    order: list[tuple[Element, bool, bool]] = []
    regions: list[Element] = []
    stack: list[tuple[Element, bool, bool, bool]] = [(root, False, False, False)]
    while stack:
        e, inside, needed, below = stack.pop()
        deletable = not below and e.tag not in KEPT and not (inside and e.tag in CONTENT and not _named(e, True))
        if deletable or needed:
            order.append((e, deletable, inside))
        if _is_main(e) and not inside:
            regions.append(e)
        within, under = inside or _is_main(e), below or (e.tag not in KEPT and _hint(e, inside))
        if e.tag not in ("script", "style"):
            stack.extend((c, within, needed or deletable, under) for c in e.children if not isinstance(c, str))
    # element: (hash, text length, linked length, links, kind)
    known: dict[int, tuple[int, int, int, int, int]] = {}
    for e, deletable, inside in reversed(order):
        parts, size, linked, links, kinds = [], 0, 0, 0, set()
        for c in e.children:
            if isinstance(c, str):
                text = " ".join(c.split()) if inside else _squeeze(c)
                parts.append(text)
                size += len(text)
            elif id(c) in known:
                h, s, ln, k, kind = known[id(c)]
                parts.append(str(h))
                size, linked, links = size + s, linked + ln, links + k
                kinds.add(str(kind))
        if e.tag == "a":
            linked, links = size, 1
        label = _label(e)
        kind = _digest("kind", label, *sorted(kinds))
        own = _digest(label, *parts)
        known[id(e)] = own, size, linked, links, kind
        if deletable:
            e.hashes = (own, kind) if not inside and links > 1 and linked >= 0.9 * size else (own,)
            found.update(dict.fromkeys(e.hashes, 0))
    for region in regions:
        _edges(region, found)
    return list(found.items())


def _edges(region: Element, found: dict[int, int]) -> None:
    """Hashes the first two and last two plain blocks of an article; the block towards its middle must differ."""
    plain: list[Element] = []
    stack = [region]
    while stack:
        e = stack.pop()
        if e is not region and e.tag in CONTENT and e.tag in BLOCK:
            if not _named(e, True):
                plain.append(e)
        elif e is region or not _hint(e, True):
            stack.extend(c for c in reversed(e.children) if not isinstance(c, str))
    n = len(plain)
    if n < 5:
        return
    text = {i: _squeeze(" ".join(blocks(plain[i], frozenset()))) for i in {0, 1, 2, n - 3, n - 2, n - 1}}
    for i, towards in ((0, 1), (1, 2), (n - 2, n - 3), (n - 1, n - 2)):
        if text[i]:
            h = _digest("edge", text[i])
            plain[i].hashes += (h,)
            found[h] = _digest("beside", text[towards]) or 1


def _gone(e: Element, gone: frozenset[int]) -> bool:
    return bool(gone) and any(h in gone for h in e.hashes)


def _regions(root: Element, gone: frozenset[int]) -> list[Element]:
    """Mains and the articles outside them, in page order; the body if there are none."""
    found: list[Element] = []
    body = root
    stack = [root]
    while stack:
        e = stack.pop()
        if _is_main(e) and e is not root:
            found.append(e)
            continue
        if e.tag == "body" and body is root:
            body = e
        stack.extend(c for c in reversed(e.children) if not isinstance(c, str) and not (_hint(c, False) or _gone(c, gone)))
    return found or [body]


def blocks(top: Element, gone: frozenset[int]) -> list[str]:
    """Texts of the blocks in page order."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            text = " ".join(_html.unescape("".join(run)).split())
            run.clear()
            if text:
                out.append(text)

    inside = _is_main(top) or top.tag in CONTENT
    # elements and texts to come; None marks the end of a block
    stack: list = [(top, inside)]
    while stack:
        item = stack.pop()
        if item is None:
            flush()
            continue
        e, inside = item
        if isinstance(e, str):
            run.append(e)
        elif e is top or not (_hint(e, inside) or _gone(e, gone)):
            if e.tag == "br":
                run.append(" ")
                continue
            if e.tag in BLOCK:
                flush()
                stack.append(None)
            within = inside or _is_main(e)
            stack.extend([(c, within) for c in reversed(e.children)])
    flush()
    return out


def main_text(page: str | None, gone: frozenset[int] = frozenset()) -> str:
    if not page:
        return ""
    root = parse(page)
    if gone:
        hash_tree(root)
    return "\n\n".join(x for region in _regions(root, gone) for x in blocks(region, gone))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", least_pages: int = 5, least_share: float = 0.02, sure_pages: int = 100, edge_share: float = 0.5) -> DataFrame:
    """(key, url, text, n_chars, n_template), n_template being how many of the page's hashes are template.

    The bounds are those of the module's description; an edge block needs ``edge_share`` of the host's pages.
    """
    bounded_batches(pages.sparkSession)
    row = F.xxhash64(F.col(key), F.col(url), F.col(page))
    host = F.xxhash64(host_path(url)[0])
    rows = pages.select(row.alias("_r"), host.alias("_h"), F.col(page).alias("_p"), F.xxhash64(F.col(page)).alias("_c"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r, h, s, edge, c = [], [], [], [], []
            for i, k, p, page_hash in zip(*(b.column(j).to_pylist() for j in range(4)), strict=True):
                for x, beside in hash_tree(parse(p)) if p else ():
                    r.append(i)
                    h.append(k)
                    s.append(x)
                    edge.append(beside != 0)
                    c.append(beside or page_hash)
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in (r, h, s)], pa.array(edge, pa.bool_()), pa.array(c, pa.int64())], names=["_r", "_h", "_s", "_edge", "_c"])

    trees = Stored(rows.mapInArrow(lean(hashes), "_r long, _h long, _s long, _edge boolean, _c long"), "html-trees").df
    total = trees.count()
    hosts = Stored(rows.groupBy("_h").agg(F.count_distinct("_r").alias("_pages")), "html-hosts").df
    # copies of one page, and edge blocks beside equal blocks, collapse before they are counted
    differ = trees.groupBy("_h", "_s", "_edge", "_c").agg(F.count(F.lit(1)).alias("_n"))
    counts = differ.groupBy("_h", "_s", "_edge").agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_d")).filter(F.col("_d") >= least_pages)
    common = Stored(Stored(counts, "html-counts").df.join(if_small(hosts, 100_000), "_h"), "html-common").df
    often = (F.col("_n") >= least_share * F.col("_pages")) | (F.col("_d") >= sure_pages)
    edge = (F.col("_n") >= edge_share * F.col("_pages")) & (F.col("_d") >= edge_share * F.col("_n"))
    template = Stored(common.filter(F.when(F.col("_edge"), edge).otherwise(often)).select("_h", "_s", "_n"), "html-template").df
    gone = Stored(hot_join(trees.select("_r", "_h", "_s"), template, ["_h", "_s"], "_n", max(total, 1)).groupBy("_r").agg(F.collect_set("_s").alias("_gone")), "html-gone").df
    joined = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(page).alias("_p"), row.alias("_r")).join(if_small(gone, 20_000), "_r", "left").select("_key", "_url", "_p", "_gone")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, n, d = [], [], []
            for p, g in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                t = main_text(p, frozenset(g or ()))
                out.append(t)
                n.append(len(t))
                d.append(len(g or ()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=[key, url, "text", "n_chars", "n_template"])

    kind = dict(pages.dtypes)
    return joined.mapInArrow(lean(texts), f"`{key}` {kind[key]}, `{url}` {kind[url]}, text string, n_chars long, n_template long")
