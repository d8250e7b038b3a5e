"""Main text of web pages by wrapper induction over the pages of each host.

1. Pages are grouped by host and layout (labels of the containers near the root; digits in class names don't count).  A layout with
   too few pages joins the most frequent one of its host; hosts with too few pages are pooled by layout over all hosts.  The page with the smallest page_id of a
   group's layout is its reference, whose tree numbers the slots.
2. Every other page of the group is aligned with the reference by simple tree matching (Yang 1991): elements match if their
   tag and class agree and the order of children is kept; the mapping of most pairs wins.  For each reference node these are counted: pages where it was aligned,
   pages where its text was the same, and characters inside it on all pages, in links and not.  Copies and near copies of the reference tell nothing
   about the template and aren't counted.  Counts are summed in each task before they move, so a host of a third of all pages is no hot group.
3. A block whose text is the same on at least ``CONSTANT`` of the group's counted pages (all, not only those aligned) is template.  From the root, the way leads down to the child that is
   aligned on as many pages and holds more than half of the running text, as long as that is a container of blocks: the main slot.  What lies outside it is
   template, whether its words vary from page to page (menus, adverts) or not, but for headings and paragraphs that aren't constant.
4. Text is taken from the main slot without template blocks, and without elements that markup sets apart inside it (menus, adverts, forms, scripts, comments of
   readers: by tag, role and a few class names).  On pages without a main slot (groups of fewer than ``LEAST_PAGES`` pages that aren't copies, pages that don't align), markup alone decides:
   ``article`` or ``main`` elements if there are any, else the whole page, without such elements.  An element set apart by class name or as a form counts all
   the same if it holds an ``article``, ``main`` or ``h1``, or more than half of the page's paragraphs and isn't for comments.

The parser reads any text: unclosed and stray tags, quotes in attributes, raw text of scripts, cut-off pages (a tag that never ends is dropped), nesting of any depth.
Null and empty pages give empty text; a null url is a host of its own.  Repeated rows give equal rows.  Other columns are not carried.
"""

from __future__ import annotations

import functools
import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut

CONSTANT, LEAST_PAGES = 0.9, 4
#: Bytes of references and wrappers up to which they are broadcast; beyond, they are joined by shuffle.
BROADCAST_BYTES = 32_000_000
#: Cells of an alignment table beyond which it is found by halves, in memory that grows with one side only.
CELLS = 4_000_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>?", re.S)
#: The same where a quote of the page never ends: quotes in tags mean nothing.
_LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?][^>]*>?", re.S)
_OPEN = re.compile(r"</?[a-zA-Z]")
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_BLOCK = _CLOSES_P | frozenset("body html br li dt dd td th tr thead tbody tfoot caption option legend".split())
_PEERS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_HEAD = frozenset("head title meta link style script base noscript template".split())
_CONTAINERS = frozenset("#root html body div section article main center table tbody tr td form header".split())
_PROSE = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6".split())
#: Never text, and set apart unless there is reason to think otherwise (:func:`_apart`).
_HARD = frozenset("head script style noscript template iframe textarea title button select input svg math object canvas audio video xmp noembed noframes".split())
_SOFT = frozenset("nav footer aside form dialog menu".split())
_MARKED = frozenset("ad ads advert advertisement sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar footer cookie cookies consent gdpr notice newsletter subscribe related recommended share sharing social popup modal complementary contentinfo".split())
_COMMENTS = frozenset("comment comments disqus replies".split())
_WORDS = re.compile(r"[a-z0-9]+")
#: Class names that say what a page hasn't, or how it is laid out.
_NEGATED = re.compile(r"(?:^|(?<=\s))(?:no|has|with|without|not|is)[-_]\S+")
_DIGITS = re.compile(r"\d+")


class Node:
    __slots__ = ("tag", "label", "skip", "children", "elements", "size", "sig", "text", "number", "chars", "links", "prose", "main")

    def __init__(self, tag: str, label: str, skip: int):
        self.tag, self.label, self.skip = tag, label, skip
        self.children: list = []


#: How an element is set apart: not at all, by tag or as hidden, by class name or as a form, as comments, and never text.
PLAIN, SOFT, MARKED, COMMENTS, HARD = range(5)


def parse(markup: str, finish: bool = True) -> Node:
    """The element tree of a page, with text as strings among the children."""
    root = Node("#root", "#root", PLAIN)
    stack, at, end = [root], 0, len(markup)
    live: Counter = Counter()  # open elements by tag
    tokens = _TOKEN
    while at < end:
        m = tokens.search(markup, at)
        tag_at = _OPEN.search(markup, at, m.start() if m else end)
        if tag_at:  # a tag that doesn't end as it should
            if tokens is _TOKEN:
                tokens = _LOOSE
                continue
            _text(stack, markup[at : tag_at.start()])
            break
        if m is None:
            _text(stack, markup[at:])
            break
        if m.start() > at:
            _text(stack, markup[at : m.start()])
        at = m.end()
        if not m.group(2):
            continue
        tag = m.group(2).lower()
        if m.group(1):
            if live[tag]:
                _pop(stack, live, tag)
            continue
        if len(stack) > 1:
            if tag not in _HEAD and live["head"]:
                while stack[-1].tag not in ("html", "#root"):
                    live[stack.pop().tag] -= 1
            if tag in _CLOSES_P:
                _close(stack, live, {"p"}, {"button", "table", "td", "li", "div", "article", "section"})
            elif tag in _PEERS:
                _close(stack, live, *_PEERS[tag])
        attrs = m.group(3)
        label, skip = tag, HARD if tag in _HARD else MARKED if tag == "form" else SOFT if tag in _SOFT else PLAIN
        if attrs and attrs != "/":
            for a in _NAMED.finditer(attrs):
                name, value = a.group(1).lower(), (a.group(2) or a.group(3) or a.group(4) or "").lower()
                if name == "class":
                    label = f"{tag}.{_DIGITS.sub('', value)}"
                if name in ("class", "id", "role"):
                    if tag not in ("html", "body", "main"):
                        words = _WORDS.findall(_NEGATED.sub(" ", value))
                        skip = max(skip, COMMENTS if not _COMMENTS.isdisjoint(words) else MARKED if not _MARKED.isdisjoint(words) else PLAIN)
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                    skip = max(skip, HARD)
        node = Node(tag, label, skip)
        stack[-1].children.append(node)
        if tag in _RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(markup, at)
            at = stop.end() if stop else end
        elif tag not in _VOID:
            stack.append(node)
            live[tag] += 1
    if finish:
        _finish(root)
    return root


def _pop(stack: list[Node], live: Counter, tag: str) -> None:
    """Close the innermost open element of a tag, and all in it."""
    while True:
        gone = stack.pop().tag
        live[gone] -= 1
        if gone == tag:
            return


def _close(stack: list[Node], live: Counter, tags: set[str], limits: set[str]) -> None:
    if not any(live[t] for t in tags):
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            for n in stack[i:]:
                live[n.tag] -= 1
            del stack[i:]
            return
        if stack[i].tag in limits:
            return


def _text(stack: list[Node], text: str) -> None:
    stack[-1].children.append(entities.unescape(text) if "&" in text else text)


def _block_text(n: Node) -> str:
    """The text of a block with that of its inline elements, which belong to it: only blocks are template or slot."""
    out, todo = [], list(reversed(n.children))
    while todo:
        c = todo.pop()
        if c.__class__ is str:
            out.append(c)
        elif c.tag not in _BLOCK:
            todo.extend(reversed(c.children))
        else:
            out.append(" ")
    return " ".join("".join(out).split())


def _finish(root: Node) -> None:
    """Preorder numbers, own texts, sizes and structure signatures; characters (in all, in links, in paragraphs) and whether an
    article, main or h1 element is there, of each subtree without what is never text."""
    order, todo = [], [(root, False)]
    while todo:
        n, link = todo.pop()
        n.number = len(order)
        order.append(n)
        link = link or n.tag == "a"
        n.elements = [c for c in n.children if c.__class__ is Node]
        todo.extend([(c, link) for c in reversed(n.elements)])
        n.text = "" if n.tag not in _BLOCK else _block_text(n) if n.elements else " ".join("".join(n.children).split())
        n.chars = sum([len(c) for c in n.children if c.__class__ is str and not c.isspace()])
        n.links = n.chars if link else 0
    for n in reversed(order):
        size, chars, links, prose, main = 1, n.chars, n.links, 0, n.tag in ("article", "main", "h1")
        for c in n.elements:
            size += c.size
            chars += c.chars
            links += c.links
            prose += c.prose
            main = main or c.main
        n.size, n.main = size, main
        n.chars, n.links, n.prose = (0, 0, 0) if n.skip == HARD else (chars, links, chars - links if n.tag in _PROSE else prose)
        n.sig = hash((n.label, *[c.sig for c in n.elements]))


# -- simple tree matching


def _ends(xs: list[Node], ys: list[Node]) -> tuple[int, int]:
    """How many children at the start and at the end have equal structure; a largest match may always pair those."""
    least, head, tail = min(len(xs), len(ys)), 0, 0
    while head < least and xs[head].sig == ys[head].sig:
        head += 1
    while tail < least - head and xs[-1 - tail].sig == ys[-1 - tail].sig:
        tail += 1
    return head, tail


class Matcher:
    """Scores of pairs of trees; a score depends on the two structures only, so each pair of them is scored once."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, int], int] = {}

    def score(self, a: Node, b: Node) -> int:
        """Pairs in the largest order-preserving match of two trees."""
        known, todo = self.known, [(a, b)]
        while todo:
            x, y = todo[-1]
            key = x.sig, y.sig
            if key not in known:
                if x.label != y.label:
                    known[key] = 0
                elif x.sig == y.sig:
                    known[key] = x.size
                else:
                    head, tail = _ends(x.elements, y.elements)
                    xs, ys = x.elements[head : len(x.elements) - tail], y.elements[head : len(y.elements) - tail]
                    first, second = {c.sig: c for c in xs}, {c.sig: c for c in ys}
                    open_ = [(c, d) for s, c in first.items() for t, d in second.items() if (s, t) not in known]
                    if open_:
                        todo += open_
                        continue
                    ends = sum(c.size for c in x.elements[:head]) + sum(c.size for c in x.elements[len(x.elements) - tail :])
                    known[key] = 1 + ends + int(_last_row(self.weights(xs, ys), False)[-1] if xs and ys else 0)
            todo.pop()
        return known[a.sig, b.sig]

    def weights(self, xs: list[Node], ys: list[Node]):
        """Rows of scores of each of xs with all of ys."""
        names = {s: k for k, s in enumerate(dict.fromkeys(y.sig for y in ys))}
        at = np.array([names[y.sig] for y in ys])
        rows = {}
        for x in xs:
            if x.sig not in rows:
                rows[x.sig] = np.array([self.known[x.sig, s] for s in names], np.int64)
        return [rows[x.sig] for x in xs], at

    def align(self, page: Node, reference: Node) -> list[tuple[Node, Node]]:
        """(page node, reference node) of the largest match."""
        pairs, todo = [], [(page, reference)]
        while todo:
            a, b = todo.pop()
            pairs.append((a, b))
            xs, ys = a.elements, b.elements
            head, tail = _ends(xs, ys)
            todo.extend(zip(xs[:head], ys[:head], strict=True))
            todo.extend(zip(xs[len(xs) - tail :], ys[len(ys) - tail :], strict=True))
            xs, ys = xs[head : len(xs) - tail], ys[head : len(ys) - tail]
            if not xs or not ys:
                continue
            for x in {x.sig: x for x in xs}.values():
                for y in {y.sig: y for y in ys}.values():
                    self.score(x, y)
            todo.extend((xs[i], ys[j]) for i, j in _path(*self.weights(xs, ys)))
        return pairs


def _last_row(weights, backwards: bool) -> np.ndarray:
    """The last row of the table of best sums: entry j is that of all rows with the first (or last) j columns."""
    rows, at = weights
    best = np.zeros(len(at) + 1, np.int64)
    for row in reversed(rows) if backwards else rows:
        w = row[at]
        if backwards:
            w = w[::-1]
        np.maximum.accumulate(np.maximum(best[1:], best[:-1] + w), out=best[1:])
    return best


def _path(rows: list[np.ndarray], at: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) pairs of positive weight in order, of the largest sum: by a table, or by halves where that would be large."""
    out, todo = [], [(0, len(rows), 0, len(at))]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d:
            continue
        if (b - a) * (d - c) > CELLS and b - a > 1:
            mid = (a + b) // 2
            both = _last_row((rows[a:mid], at[c:d]), False) + _last_row((rows[mid:b], at[c:d]), True)[::-1]
            cut_at = c + int(both.argmax())
            todo += [(a, mid, c, cut_at), (mid, b, cut_at, d)]
            continue
        best = np.zeros((b - a + 1, d - c + 1), np.int64)
        for i in range(a, b):
            np.maximum.accumulate(np.maximum(best[i - a, 1:], best[i - a, :-1] + rows[i][at[c:d]]), out=best[i - a + 1, 1:])
        i, j = b - a, d - c
        while i and j:
            w = int(rows[a + i - 1][at[c + j - 1]])
            if w and best[i, j] == best[i - 1, j - 1] + w:
                i, j = i - 1, j - 1
                out.append((a + i, c + j))
            elif best[i, j] == best[i - 1, j]:
                i -= 1
            else:
                j -= 1
    return out


def score(a: Node, b: Node) -> int:
    return Matcher().score(a, b)


def align(page: Node, reference: Node) -> list[tuple[Node, Node]]:
    return Matcher().align(page, reference)


# -- text


def _apart(n: Node, root: Node) -> bool:
    """Whether markup sets an element apart from the text."""
    if n.skip in (PLAIN, SOFT, HARD):
        return n.skip != PLAIN
    return not (n.main or n.skip == MARKED and n.prose > 0.5 * root.prose)


def _regions(root: Node) -> list[Node]:
    """The outermost article elements, else main elements, else the root; none inside parts that don't count."""
    for tag in ("article", "main"):
        found, todo = [], [root]
        while todo:
            n = todo.pop()
            if _apart(n, root):
                continue
            if n.tag == tag:
                found.append(n)
            else:
                todo.extend(reversed(n.elements))
        if found:
            return found
    return [root]


def text_of(root: Node, template: set[int] | frozenset[int] = frozenset(), main: Node | None = None) -> str:
    """The text of the slots.  template: numbers of blocks of this tree whose text is left out.  main: the main slot; outside it,
    only headings and paragraphs, and articles, count.  Without it, markup alone decides."""
    out: list[str] = []
    for region in _regions(root) if main is None else [root]:
        todo: list = [(region, region.tag != "#root", main is None)]  # inside an article or the main slot; whether text counts here
        while todo:
            n, inside, counts = todo.pop()
            if n.__class__ is str:
                if counts:
                    out.append(n)
                continue
            if main is None or n.number < main.number or n.number >= main.number + main.size:
                if _apart(n, root) and not (main and n.number < main.number < n.number + n.size and n.skip != HARD) or n.tag == "header" and not inside and main is None:
                    continue
            elif n is not main and _apart(n, root):
                continue
            if n is main or n.tag in ("article", "main"):
                inside = True
            counts = counts or inside or n.tag in _PROSE
            if n.tag in _BLOCK:
                out.append(" ")
                todo.append((" ", inside, True))
            todo.extend([(c, inside, counts) for c in reversed(n.children)] if n.number not in template else [(c, inside, counts) for c in reversed(n.elements) if c.tag in _BLOCK])
    return " ".join("".join(out).split())


# -- groups of pages and their wrappers


def layout(root: Node) -> str:
    """Names the containers of the first three levels, whatever their number and order."""
    found, level = set(), [root]
    for depth in range(4):
        found |= {(depth, n.label) for n in level if n.tag in _CONTAINERS or n.tag in _SOFT}
        level = [c for n in level for c in n.children if c.__class__ is Node and n.tag != "head"]
    return hashlib.md5(repr(sorted(found)).encode()).hexdigest()[:16]


def _layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [layout(parse(x.as_py(), False)) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string())], names=["page_id", "host", "layout"])


def _is_copy(pairs: list[tuple[Node, Node]], root: Node) -> bool:
    """Whether most text of the page that markup doesn't set apart is that of the reference: a copy or near copy of it."""
    apart, todo = set(), [(root, False)]
    while todo:
        n, inside = todo.pop()
        inside = inside or _apart(n, root)
        if inside:
            apart.add(n.number)
        todo.extend((c, inside) for c in n.elements)
    own = [(len(a.text), a.text == b.text) for a, b in pairs if a.text and a.number not in apart]
    return 2 * sum(n for n, equal in own if equal) > sum(n for n, _ in own)


def _counts(batches: Iterator[pa.RecordBatch], pick) -> Iterator[pa.RecordBatch]:
    """Rows (host, html): sums for each node of the reference of the page's group.  Number -1 stands for the pages counted."""
    sums: dict[tuple[str, int], list[int]] = {}
    matcher = Matcher()

    def rows() -> pa.RecordBatch:
        keys = list(sums)
        columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32())]
        return pa.RecordBatch.from_arrays([*columns, *[pa.array([sums[k][i] for k in keys], pa.int64()) for i in range(3)]], names=["group", "number", "aligned", "same", "running"])

    for batch in batches:
        for i, markup in enumerate(batch.column(1)):
            root = parse(markup.as_py())
            group, reference = pick(batch, i, root)
            if reference is None or root.sig == reference.sig and root.chars == reference.chars and markup.as_py() == reference.text:
                continue
            if len(matcher.known) > 200_000:
                matcher = Matcher()
            pairs = matcher.align(root, reference)
            if _is_copy(pairs, root):
                continue
            for a, b in [(None, None), *pairs]:
                key = (group, -1 if b is None else b.number)
                got = sums.get(key)
                if got is None:
                    got = sums[key] = [0, 0, 0]
                got[0] += 1
                if b is not None:
                    got[1] += a.text == b.text
                    got[2] += a.chars - a.links
        if len(sums) > 200_000:
            yield rows()
            sums.clear()
    yield rows()


def wrapper(reference: Node, counts: dict[int, tuple[int, int, int]]) -> tuple[list[int], int]:
    """(template blocks, main slot) of a reference from (aligned, same, running) of its nodes; -1: no main slot."""
    pages = counts.get(-1, (0, 0, 0))[0]
    if pages < LEAST_PAGES:
        return [], -1
    fixed, todo = [], [reference]
    while todo:
        n = todo.pop()
        todo.extend(n.elements)
        if n.text and counts.get(n.number, (0, 0, 0))[1] >= CONSTANT * pages:
            fixed.append(n.number)
    total = counts.get(reference.number, (0, 0, 0))[2]
    at, main = reference, -1
    while total and at.tag not in ("article", "main"):
        inner = [c for c in at.elements if c.tag in _CONTAINERS and any(x.tag in _BLOCK and x.tag != "br" for x in c.elements) and counts.get(c.number, (0, 0, 0))[0] >= CONSTANT * pages]
        best = max(inner, key=lambda c: counts[c.number][2], default=None)
        if best is None or 2 * counts[best.number][2] <= total:
            break
        at = best
        main = at.number if at.tag not in ("html", "body") else -1
    return sorted(fixed), main


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for markup, counted in zip(batch.column(1), batch.column(2), strict=True):
            found.append(wrapper(_reference(markup.as_py()), {c["number"]: (c["aligned"], c["same"], c["running"]) for c in counted.as_py()}))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f for f, _ in found], pa.list_(pa.int32())), pa.array([m for _, m in found], pa.int32())], names=["group", "reference", "fixed", "main"])


@functools.lru_cache(maxsize=1024)
def _reference(markup: str) -> Node:
    root = parse(markup)
    root.text = markup  # the root is no block and has no text of its own
    return root


def page_text(root: Node, reference: Node | None, fixed: frozenset[int], main: int, matcher: Matcher) -> str:
    """The text of a page by the wrapper of its group."""
    if reference is None or not fixed and main < 0:
        return text_of(root)
    pairs = matcher.align(root, reference)
    template = {a.number for a, b in pairs if b.number in fixed and a.text == b.text}
    slot = next((a for a, b in pairs if b.number == main), None)
    if slot is not None and not slot.chars:
        slot = None
    return text_of(root, template, slot) or text_of(root)


def _extract(batches: Iterator[pa.RecordBatch], pick) -> Iterator[pa.RecordBatch]:
    matcher = Matcher()
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            texts = []
            for i, markup in enumerate(batch.column(1)):
                root = parse(markup.as_py() or "")
                if len(matcher.known) > 200_000:
                    matcher = Matcher()
                texts.append(page_text(root, *pick(batch, i, root), matcher))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:4], pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def host(url):
    """The host of a url, without user, port and www.; empty for null."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), r"^www\.", ""), F.lit(""))


def _bytes(df: DataFrame, *columns: str) -> int:
    return df.agg(F.sum(sum((F.octet_length(c) for c in columns), F.lit(64)))).first()[0] or 0


def groups(rows: DataFrame) -> DataFrame:
    """(host, layout, group, ref_id, ref_host) for each host and layout of rows (page_id, host, html): its group, and the page that is
    the group's reference."""
    shapes = cut(rows.select("page_id", "host", "html").mapInArrow(_layouts, "page_id long, host string, layout string").groupBy("host", "layout").agg(F.count("*").alias("n"), F.min("page_id").alias("ref_id")))
    hosts = shapes.groupBy("host").agg(F.sum("n").alias("pages"), F.max(F.struct("n", "layout")).alias("most"))
    placed = shapes.join(hosts, "host")
    large = F.col("pages") > LEAST_PAGES
    own = F.when(large & (F.col("n") <= LEAST_PAGES), F.col("most.layout")).otherwise(F.col("layout"))
    placed = placed.select("host", "layout", "n", "ref_id", F.when(large, F.col("host")).otherwise(F.lit("")).alias("scope"), own.alias("shape"))
    placed = placed.withColumn("group", F.concat_ws("|", "scope", "shape"))
    refs = placed.where("layout = shape").groupBy("group").agg(F.min(F.struct("ref_id", "host")).alias("r"), F.sum("n").alias("of_group"))
    return cut(placed.join(refs, "group").select("host", "layout", "group", F.col("r.ref_id").alias("ref_id"), F.col("r.host").alias("ref_host")))


def wrappers(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The groups of pages (page_id, url, html), and (group, reference, fixed, main): the reference of each, the numbers of its
    template blocks, and the number of its main slot or -1."""
    rows = pages.select("page_id", host(F.col("url")).alias("host"), "html").where("length(html) > 0 AND page_id IS NOT NULL")
    known = groups(rows)
    wanted = known.select("group", "ref_id", "ref_host").distinct()
    at = F.broadcast(wanted) if _bytes(wanted, "group", "ref_host") <= BROADCAST_BYTES else wanted
    refs = cut(rows.join(at, (F.col("host") == F.col("ref_host")) & (F.col("page_id") == F.col("ref_id"))).groupBy("group").agg(F.min("html").alias("reference")))
    counted = _apply(rows, known, refs, _counts, "group string, number int, aligned long, same long, running long", [])
    sums = counted.groupBy("group", "number").agg(*[F.sum(c).alias(c) for c in ("aligned", "same", "running")])
    lists = sums.groupBy("group").agg(F.collect_list(F.struct("number", "aligned", "same", "running")).alias("counts"))  # of one page's nodes
    return known, cut(refs.join(lists, "group").select("group", "reference", "counts").mapInArrow(_judge, "group string, reference string, fixed array<int>, main int").where("main >= 0 OR size(fixed) > 0"))


def _apply(rows: DataFrame, known: DataFrame, table_: DataFrame, work, schema: str, more: list[str]) -> DataFrame:
    """work over rows (host, html, more columns) with what ``pick`` finds for each page in table_ (group, reference, ...): looked up in a
    broadcast where groups and references are few, else joined by host and layout, which parses once more."""
    extra = [c for c in table_.columns if c not in ("group", "reference")]
    spark = rows.sparkSession

    def shown(got) -> tuple:
        return (got[0], _reference(got[1])) if not extra else (_reference(got[1]), frozenset(got[2]), got[3])

    none = (None, None) if not extra else (None, frozenset(), -1)
    if _bytes(known, "host", "layout", "group") + _bytes(table_, "reference") <= BROADCAST_BYTES:
        of_group = {r[0]: tuple(r) for r in table_.collect()}  # at most BROADCAST_BYTES
        of_page = {(r.host, r.layout): of_group[r.group] for r in known.where(F.col("group").isin(list(of_group)) if len(of_group) < 1000 else F.lit(True)).collect() if r.group in of_group}
        shared = spark.sparkContext.broadcast(of_page)

        def pick(batch, i, root):
            got = shared.value.get((batch.column(0)[i].as_py(), layout(root)))
            return none if got is None else shown(got)

        return rows.select("host", "html", *more).mapInArrow(lambda it: work(it, pick), schema)

    def named(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([layout(parse(x.as_py() or "", False)) for x in batch.column(1)], pa.string())], names=[*batch.schema.names, "layout"])

    base = rows.select("host", "html", *more)
    spread = known.select("host", "layout", "group").join(table_, "group")
    joined = base.mapInArrow(named, base.schema.add("layout", "string")).join(spread, ["host", "layout"], "left").select("host", "html", *more, "group", "reference", *extra)

    def pick_joined(batch, i, root):
        got = tuple(batch.column(c)[i].as_py() for c in ("group", "reference", *extra))
        return none if got[1] is None else shown(got)

    return joined.mapInArrow(lambda it: work(it, pick_joined), schema)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for every row of pages (page_id, url, html)."""
    known, found = wrappers(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"))
    rows = pages.select(host(F.col("url")).alias("host"), "html", F.col("page_id").cast("long").alias("page_id"), "url")
    return _apply(rows, known, found, _extract, "page_id long, url string, text string", ["page_id", "url"])
