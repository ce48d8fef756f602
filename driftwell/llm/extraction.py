"""Main text of web pages by site template removal.

Every element of a page below its body is hashed with all below it: tags, visible text and
order, not attributes. Pages are dealt over buckets of a few MB; each bucket sends the
distinct hashes (of host and subtree) with the least hashes of the pages that hold them,
packed into a block for each range of hash values; each range merges these and returns to
each bucket the subtrees that stand on enough different pages of their host. Pages with the
same source count once, however many addresses they have. The bucket deletes:

- outside an article: subtrees on FEW_PAGES pages or more, where the page has an article or
  the element bears a mark of no main text in part of its class, id or role; on MANY_PAGES
  otherwise;
- inside an article: containers (not headings, paragraphs or items) on MANY_PAGES or more;
- what recurrence cannot tell, since it differs from page to page or the host shows too few
  pages: elements whose tag, or a whole word of whose class, id or role, says that they hold
  menus, adverts, forms, reader comments and the like; on a host of fewer than FEW_PAGES
  pages a part of such a word suffices. Headings and paragraphs, and what holds an article,
  never go by such words.

Main text is the blocks of what is left of the articles; of the body, where there is none.

Defined cases: null and empty pages give an empty text; a null or odd URL counts as a host
of its own name; unclosed, crossing and cut-off tags are closed where the parent ends or
the page does; a quotation mark without its pair is an ordinary character; an unclosed
comment or script reaches to the end; repeated rows are pages of their own; other columns
are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import mix
from ._shared import BUCKET_BYTES, grown, in_buckets, n_tasks, partitions, text_bytes

#: Different pages of one host from which a subtree belongs to the site's template, with and without other evidence.
MANY_PAGES, FEW_PAGES = 10, 3
RANGE_BYTES = 64 << 20
#: Elements without content, elements that break the line of text, and elements that never hold main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("applet audio button canvas datalist dialog embed fieldset footer form frame frameset head iframe input label map menu nav noembed noframes noscript object optgroup option aside script select style svg template textarea title video".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements of running text, which no word of class, id or role deletes, nor recurrence within an article.
TEXTUAL = frozenset("a abbr b blockquote caption cite code dd dl dt em figcaption h1 h2 h3 h4 h5 h6 hgroup hr i li math ol p pre q s small strong sub sup table tbody td tfoot th thead tr u ul".split())
#: Words of class, id and role that name what is no main text, and words that say no more beside them.
MARKS = frozenset("ad ads adv advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies dialog disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion related replies respond search share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split())
BESIDE = frozenset("area bar block bottom box container content group inner item left link links list main outer page right section site top wrap wrapper".split())
_START = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_NAMED = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
_STOP = re.compile("[>\"']")
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Tags:
    """A scan over a source's tags and comments that never looks at a place twice: quotation marks count only after an
    equals sign, and only where the same mark follows."""

    def __init__(self, source: str):
        self.source, self.pos = source, 0
        self.last = {q: source.rfind(q) for q in "\"'"}

    def next(self) -> tuple[int, str | None, bool, str] | None:
        """(start, name, whether it closes, attributes) of the next tag; None for the name of a comment or a cut-off tag."""
        source, n = self.source, len(self.source)
        m = _START.search(source, self.pos)
        if m is None:
            return None
        s, at = m.span()
        if m[2] is None:
            stop = "-->" if source.startswith("<!--", s) else ">"
            end = source.find(stop, at)
            self.pos = n if end < 0 else end + len(stop)
            return s, None, False, ""
        begin = at
        while (q := _STOP.search(source, at)) is not None and q[0] != ">":
            at = q.end()
            if self.last[q[0]] > q.start() and source[max(begin, q.start() - 9) : q.start()].rstrip()[-1:] == "=":
                at = begin = source.index(q[0], at) + 1
        self.pos = n if q is None else q.end()
        return (s, None, False, "") if q is None else (s, m[2].lower(), bool(m[1]), source[m.end() : q.start()])


def marked(attributes: str) -> tuple[bool, bool]:
    """Whether a whole word of class, id or role says that the element is no main text, and whether a part of one does."""
    whole = part = False
    for value in _NAMED.findall(attributes):
        for word in value.strip("\"'").split():
            parts = [p.lower() for p in _PART.findall(word)]
            hits = [p in MARKS for p in parts]
            part = part or any(hits)
            whole = whole or any(hits) and all(h or p in BESIDE for h, p in zip(hits, parts))
    return whole, part


@dataclass
class Page:
    """Elements by place: tag, parent, whether tag or words delete it, whether words may; events: (kind, element or bounds)."""

    source: str
    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    unwanted: list[bool] = field(default_factory=list)
    doubtful: list[bool] = field(default_factory=list)
    events: list[tuple[int, int, int]] = field(default_factory=list)

    def settle(self) -> None:
        """Where each element stands, seen from the articles; what holds one goes neither by words nor by recurrence."""
        self.inside, self.around = [t in ("article", "main") and not u for t, u in zip(self.tags, self.unwanted)], [False] * len(self.tags)
        self.main = list(self.inside)
        for i, p in enumerate(self.parents):
            if p >= 0 and self.inside[p]:
                self.inside[i] = True
        for i in range(len(self.tags) - 1, -1, -1):
            if (self.main[i] or self.around[i]) and self.parents[i] >= 0:
                self.around[self.parents[i]] = True
        self.has_main = any(self.main)
        for i, t in enumerate(self.tags):
            if self.around[i] and t not in NEVER:
                self.unwanted[i] = False
            # A header within an article holds its title; elsewhere it is the site's.
            if t == "header" and not self.inside[i] and not self.around[i]:
                self.unwanted[i] = True

    def least_pages(self, i: int) -> int | None:
        """The number of the host's pages from which element i is taken for the template, if it may be."""
        t = self.tags[i]
        if self.around[i] or t in ("html", "body", "head", "article", "main", "br"):
            return None
        if self.inside[i]:
            return MANY_PAGES if t not in TEXTUAL or t in ("ul", "ol", "table") and self.doubtful[i] else None
        return FEW_PAGES if self.has_main or self.doubtful[i] else MANY_PAGES

    def subtrees(self) -> dict[int, int]:
        """A hash of each element that may belong to a template, with all below it, from the leaves up."""
        from xxhash import xxh64_intdigest

        parts: list[list[str]] = [[]]
        out = {}
        for kind, a, b in self.events:
            if kind == TEXT:
                words = self.source[a:b].split()
                if words:
                    parts[-1].append(" ".join(words))
            elif kind == OPEN:
                parts.append([])
            else:
                own = parts.pop()
                if own:
                    h = xxh64_intdigest(f"<{self.tags[a]}>" + "\x00".join(own))
                    parts[-1].append(f"\x01{h:x}")
                    if self.least_pages(a) is not None:
                        out[a] = h
        return out


OPEN, CLOSE, TEXT = 0, 1, 2


def parse(source: str) -> Page:
    page, stack, at = Page(source), [], 0
    tags, events = page.tags, page.events
    open_tags: dict[str, int] = {}
    rest = {}

    def close(place: int) -> None:
        while len(stack) > place:
            i = stack.pop()
            open_tags[tags[i]] -= 1
            events.append((CLOSE, i, 0))

    scan = Tags(source)
    while (tag := scan.next()) is not None:
        s, name, closes, attributes = tag
        if s > at:
            events.append((TEXT, at, s))
        at = pos = scan.pos
        if name is None:
            continue
        if closes:
            if open_tags.get(name):
                k = len(stack) - 1
                while tags[stack[k]] != name:
                    k -= 1
                close(k)
            continue
        if name in BLOCK and stack:
            ends = _CLOSES.get(name, set()) | {"p"}
            for k in range(len(stack) - 1, -1, -1):
                t = tags[stack[k]]
                if t in ends:
                    close(k)
                    break
                if t in BLOCK:
                    break
        i = len(tags)
        tags.append(name)
        page.parents.append(stack[-1] if stack else -1)
        whole, part = marked(attributes) if attributes and name not in ("html", "body") and name not in TEXTUAL - {"ul", "ol", "table", "a"} else (False, False)
        page.unwanted.append(name in NEVER or whole)
        page.doubtful.append(part or name in ("header", "section"))
        events.append((OPEN, i, 0))
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            events.append((CLOSE, i, 0))
        elif name in RAW:
            if name not in rest or 0 <= rest[name] < pos:
                end = re.compile(rf"</{name}\s*>", re.I).search(source, pos)
                rest[name] = end.start() if end else -1
            at = scan.pos = len(source) if rest[name] < 0 else source.index(">", rest[name]) + 1
            events.append((CLOSE, i, 0))
        else:
            stack.append(i)
            open_tags[name] = open_tags.get(name, 0) + 1
    if at < len(source):
        events.append((TEXT, at, len(source)))
    close(0)
    page.settle()
    return page


def text_of(page: Page, template: set[int] = frozenset()) -> str:
    """Blocks of the article (of the page, if it has none) joined by line breaks, without unwanted and template elements."""
    gone, main = [False] * len(page.tags), page.main
    for i, p in enumerate(page.parents):
        gone[i] = page.unwanted[i] or i in template or p >= 0 and gone[p]
    only = any(m and not g for m, g in zip(main, gone))
    blocks: list[str] = []
    line: list[str] = []
    depth, inner = 0, []
    for kind, a, b in page.events:
        if kind == TEXT:
            if not (inner and gone[inner[-1]]) and (depth or not only):
                line.append(page.source[a:b])
            continue
        tag = page.tags[a]
        if tag in BLOCK:
            if line:
                blocks.append(" ".join(html.unescape("".join(line)).split()))
                line = []
        elif tag == "br":
            line.append(" ")
        if kind == OPEN:
            inner.append(a)
            depth += main[a]
        else:
            inner.pop()
            depth -= main[a]
    if line:
        blocks.append(" ".join(html.unescape("".join(line)).split()))
    return "\n".join(x for x in blocks if x)


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else url or ""


def _host_key(host: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(host)


def _keys(page: Page, host: int) -> dict[int, int]:
    """The key of host and subtree for each element that may belong to the template."""
    subtrees = page.subtrees()
    keys = mix(np.array(list(subtrees.values()), dtype=np.uint64) + np.uint64(host)).tolist()
    return dict(zip(subtrees, keys))


def _least(keys: np.ndarray, pages: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most least different pages of each key, sorted by key and page."""
    order = np.lexsort((pages, keys))
    k, p = keys[order], pages[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1])
    k, p = k[new], p[new]
    first = np.ones(len(k), dtype=bool)
    first[1:] = k[1:] != k[:-1]
    place = np.arange(len(k)) - np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))
    return k[place < most], p[place < most]


def send(n_ranges: int, most: int):
    """Of a bucket's pages to blocks of (key, page): for each key of host and subtree, and for each host, its least pages."""

    def run(key: tuple[pa.Scalar, ...], pages: pa.Table) -> pa.Table:
        from xxhash import xxh64_intdigest

        keys, held = [], []
        for url, source in zip(pages["url"].to_pylist(), pages["html"].to_pylist()):
            host, this = _host_key(host_of(url)), xxh64_intdigest(source or "", 1)
            own = {host, *_keys(parse(source or ""), host).values()}
            keys += own
            held += [this] * len(own)
        k, p = _least(np.array(keys, dtype=np.uint64), np.array(held, dtype=np.uint64), most)
        at = ((k >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(k) else np.zeros(0, np.int64)
        split = lambda x: [y.tobytes() for y in np.split(x, cuts[1:])] if len(k) else []
        return pa.table({"bucket": pa.array([key[0].as_py()] * len(cuts), pa.int32()), "range": pa.array(at[cuts], pa.int32()), "keys": pa.array(split(k), pa.binary()), "pages": pa.array(split(p), pa.binary())})

    return run


def frequent(few: int, most: int):
    """Of a range's blocks to the keys of each block that stand on few pages or more, with their number of pages, up to most."""

    def run(key: tuple[pa.Scalar, ...], blocks: pa.Table) -> pa.Table:
        own = [np.frombuffer(x, dtype=np.uint64) for x in blocks["keys"].to_pylist()]
        k, _ = _least(np.concatenate(own), np.frombuffer(b"".join(blocks["pages"].to_pylist()), dtype=np.uint64), most)
        distinct, n = np.unique(k, return_counts=True)
        distinct, n = distinct[n >= few], n[n >= few]
        keys, counts, keep = [], [], []
        for i, x in enumerate(own):
            found = np.intersect1d(x, distinct)
            if len(found):
                keep.append(i)
                keys.append(found.tobytes())
                counts.append(n[np.searchsorted(distinct, found)].astype("<u1").tobytes())
        return pa.table({"bucket": blocks["bucket"].combine_chunks().take(pa.array(keep, pa.int64())), "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})

    return run


OUT = "page_id long, url string, text string, n_template long"


def template_of(page: Page, host: int, counts: dict[int, int]) -> set[int]:
    """The elements of a page to delete, by the number of its host's pages that each key stands on."""
    out = {i for i, k in _keys(page, host).items() if counts.get(k, 0) >= page.least_pages(i)}
    if counts.get(host, 0) < FEW_PAGES:
        out |= {i for i, d in enumerate(page.doubtful) if d and not page.inside[i] and not page.around[i] and page.tags[i] not in ("section", *TEXTUAL)}
    return out


def extract(key: tuple[pa.Scalar, ...], pages: pa.Table, back: pa.Table) -> pa.Table:
    keys = np.frombuffer(b"".join(back["keys"].to_pylist()), dtype=np.uint64).tolist()
    counts = dict(zip(keys, b"".join(back["counts"].to_pylist())))
    texts, gone = [], []
    for url, source in zip(pages["url"].to_pylist(), pages["html"].to_pylist()):
        page = parse(source or "")
        own = template_of(page, _host_key(host_of(url)), counts)
        texts.append(text_of(page, own))
        gone.append(len(own))
    return pa.table({"page_id": pages["page_id"].cast(pa.int64()), "url": pages["url"].cast(pa.string()), "text": pa.array(texts, pa.string()), "n_template": pa.array(gone, pa.int64())})


def main_text(pages: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """page_id, url, text, n_template (subtrees deleted as the host's) for each row of pages (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    total = text_bytes(rows, "html")
    # Few pages are dealt over smaller buckets, so that every task has some.
    bucket_bytes = grown(min(bucket_bytes, max(256 << 10, total // partitions(pages.sparkSession))), total, 64 << 20)
    n, n_ranges = n_tasks(pages.sparkSession, total), max(1, math.ceil(total / grown(RANGE_BYTES, total, 512 << 20)))
    dealt = in_buckets(rows, total, "page_id", "url", "html", bucket_bytes=bucket_bytes)
    blocks = dealt.groupBy("bucket").applyInArrow(send(n_ranges, MANY_PAGES), "bucket int, range int, keys binary, pages binary")
    back = blocks.repartition(min(n_ranges, n), "range").groupBy("range").applyInArrow(frequent(FEW_PAGES, MANY_PAGES), "bucket int, keys binary, counts binary")
    return dealt.groupBy("bucket").cogroup(back.groupBy("bucket")).applyInArrow(extract, OUT)
