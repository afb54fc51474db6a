"""Main text of pages by wrapper induction.

Pages of a host are aligned, tree against tree, by simple tree matching: two nodes match if their labels do, and of two matching
nodes the children are matched in order so that most nodes match. Before that, runs of siblings with equal labels and without
children of their own are folded into one node that holds all their texts, so a page of a thousand paragraphs is as small as one of
ten. The wrapper is the tree of the host's pages with, at each node, how many pages had it and in how many each of its texts stood.
A text that stands at its node in most pages is template; a node whose texts vary is a slot.

The tree starts from a bounded sample, the `sample` pages of each host with the least hash; it says which nodes of two pages are the same
and nothing else. Every page is aligned with it in the workers; nodes without a partner are told by their parent, label and turn among
such siblings, so layouts that the sample lacks have nodes too. Counts are of all distinct pages: each worker adds up (node, text) before
the shuffle, and template is decided from the whole sums. Of a page that stands in n rows each row counts 1/n. In the same pass a worker
passes on each page's aligned texts, so a page is parsed and aligned once, and its markup is read by nothing later.

Varying slots are content unless their place says otherwise: menus, headers and footers of the page, sidebars, adverts, forms, scripts,
styles and reader comments are told by their elements, roles and class names, as they vary like content does. Names that sections of
the text have too (MAYBE) decide only where the wrapper leaves a section open, having none of its nodes in LEAST pages, and the section
isn't most of the page's text; elsewhere the section is content if its texts, by length, are mostly ones that stand in a single page of the host. Where a page has an article or main
element, only slots inside it are content, unless its nodes outside hold more varying text in the host's pages than those inside.

Trees and wrappers are written once and their bytes summed up: up to BROADCAST_BYTES they are broadcast, and no page is shuffled;
beyond that the trees meet the pages, and the wrappers the aligned texts, in a shuffled join, a host that has a third of all pages being
dealt to SALTS tasks. Sampled and repeated pages are told by a sieve, so no other page is shuffled for them.

Alignment is bounded: a tree is DEPTH levels deep, what stands deeper hangs side by side at the last level; equal subtrees at either end
of two child lists are paired first, and lists whose product is still above CELLS are paired by label and turn, in order.

Defined results: null and empty html give an empty text; a null url is a host of its own, as is one without a host; text before a
tag that was cut off at the end is kept, the cut tag is not; a quote that is never closed ends with its tag; a hidden inline element ends
with the block at the latest; with fewer than LEAST distinct pages of a host nothing counts as template. Pages are independent of each other but for the wrapper; repeated rows give equal rows; other columns are dropped.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free, lean, materialize, sift, slices

#: Distinct pages of a host that its tree starts from.
SAMPLE = 12
#: Distinct pages that a wrapper needs before a text can be template, and the share of them that must have it.
LEAST, CONSTANT = 4, 0.8
SALTS = 64
#: Bytes of all wrappers that are sent to every executor rather than joined by shuffle.
BROADCAST_BYTES = 16 << 20
#: (node, text) sums that a worker holds before it passes them on.
SUMS = 50_000
#: Levels of a tree, and pairs of children that are tried for two nodes.
DEPTH, CELLS = 100, 100_000

# Elements by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
SKIP = set("script style head noscript template svg iframe object canvas nav footer aside form button select textarea input dialog menu title xmp noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = set("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
# Words in class names, ids and roles of what isn't main text.
OUTSIDE = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookie\w*|popup|modal|newsletter|nav|navbar|navigation|menu|breadcrumb\w*|sidebar|aside|widget|footer|masthead|topbar|comment|comments|commentlist|respond|reply|replies|disqus|pagination|pager|complementary|contentinfo)(?:$|[\s_-])", re.I)
# Such words that sections of the text have too.
MAYBE = re.compile(r"(?:^|[\s_-])(?:notice|notification|alert|consent|gdpr|subscribe|signup|share|sharing|social|side|related|recommend\w*|foot|discussion|search|login|skip|legal|disclaimer)(?:$|[\s_-])", re.I)
#: A tag; a quote opens a value only behind an equals sign.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>=]+|=\s*(?:"(?:[^"]*"|[^">]*)|'(?:[^']*'|[^'>]*)|[^\s"'>][^\s>]*)?)*))(>|\Z)""", re.S)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


@dataclass
class Node:
    label: str
    outside: bool = False
    children: list[Node] = field(default_factory=list)
    #: Texts of the blocks folded into this node, in page order; empty for a node that only has children.
    texts: list[str] = field(default_factory=list)
    order: list[int] = field(default_factory=list)
    #: Outside only by its class name, which says nothing if the article stands inside.
    by_name: bool = False
    #: Has one of the names that are left to the wrapper.
    maybe: bool = False
    #: An article or main element that counts stands here or below; known once folded.
    main: bool = False
    shape: tuple[int, int] | None = None


def parse(page: str) -> Node:
    """The tree of block elements. A run of text and inline elements between blocks is a block of its own, #text."""
    root = Node("#root")
    # name, the node that holds what stands inside, and whether something below the last level is outside
    stack: list[tuple[str, Node, bool]] = [("#root", root, False)]
    inline: list[str] = []
    blocks, mains = 0, 0  # mains: open article and main elements
    muted, depth = "", 0  # a hidden inline element that is open, and how many of its name

    def flush() -> None:
        nonlocal blocks
        text = " ".join(html.unescape("".join(inline)).split())
        inline.clear()
        if text:
            blocks += 1
            stack[-1][1].children.append(Node("#text", stack[-1][2], texts=[text], order=[blocks]))

    def leave(k: int) -> None:
        nonlocal mains
        mains -= sum(n in ("article", "main") for n, _, _ in stack[k:])
        del stack[k:]

    at, size = 0, len(page)
    while at < size:
        m = TAG.search(page, at)
        if not m:
            inline.append(page[at:] if not muted else "")
            break
        if not muted:
            inline.append(page[at : m.start()])
        at = m.end()
        close, name, attributes = m[1], (m[2] or "").lower(), m[3]
        if not name:
            continue
        if not m[4]:  # the tag was cut off by the end of the page
            break
        if name in INLINE:
            if name in VOID:
                if name == "br":
                    inline.append(" ")
            elif muted:
                depth += (name == muted) * (-1 if close else 1)
                muted = muted if depth else ""
            elif not close and hidden(attributes):  # an inline element that isn't shown
                muted, depth = name, 1
            continue
        muted = ""
        if name in RAW and not close:
            flush()
            end = RAW_END[name].search(page, at)
            rest = page.find(">", end.start()) if end else -1
            at = size if rest < 0 else rest + 1
            continue
        flush()
        if close:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    leave(k)
                    break
            continue
        if name in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    leave(k)
                    break
                if stack[k][0] in CLOSES_P:
                    break
        ends = ENDS.get(name)
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ends:
                    leave(k)
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "div", "article", "section"):
                    break
        found = {(a[0] or "").lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(attributes)}
        kind = " ".join(v for k, v in found.items() if k in ("class", "id", "role"))
        outside = name in SKIP or (name == "header" and not mains) or hidden(attributes)
        named = not outside and name not in ("article", "main", "body", "html")
        by_name = named and bool(OUTSIDE.search(kind))
        node = Node(f"{name}.{found.get('class') or ''}".rstrip("."), outside or by_name, by_name=by_name, maybe=named and not by_name and bool(MAYBE.search(kind)))
        _, holder, below = stack[-1]
        node.outside |= below
        holder.children.append(node)
        if name not in VOID and not attributes.rstrip().endswith("/"):
            mains += name in ("article", "main")
            stack.append((name, node, below) if len(stack) < DEPTH else (name, holder, node.outside))
    flush()
    return root


def hidden(attributes: str) -> bool:
    low = attributes.lower()
    if "hidden" in low and re.search(r"(?<![\w-])hidden(?:\s|$|=|/)|aria-hidden\s*=\s*[\"']?true", low):
        return True
    if "display" in low and re.search(r"display\s*:\s*none", low):
        return True
    return False


def fold(node: Node) -> Node:
    """Blocks with one text become leaves; runs of leaves with equal labels become one node."""
    own = node.label.split(".")[0] in ("article", "main")
    if node.texts:
        return Node(node.label, node.outside, texts=list(node.texts), order=list(node.order), maybe=node.maybe)
    children = [fold(c) for c in node.children]
    if len(children) == 1 and children[0].label == "#text" and node.label != "#root":
        outside = node.outside or children[0].outside
        return Node(node.label, outside, texts=children[0].texts, order=children[0].order, maybe=node.maybe, main=own and not outside and not node.maybe)
    out: list[Node] = []
    for c in children:
        if not c.children and not c.texts:
            continue
        if out and not c.children and not out[-1].children and out[-1].label == c.label and (out[-1].outside, out[-1].maybe, out[-1].main) == (c.outside, c.maybe, c.main):
            out[-1].texts += c.texts
            out[-1].order += c.order
        else:
            out.append(c)
    main = any(c.main for c in out)
    outside, maybe = node.outside and not (node.by_name and main), node.maybe and not main
    return Node(node.label, outside, out, maybe=maybe, main=not outside and not maybe and (own or main))


@dataclass
class Slot:
    """A node of a host's tree. key tells it from all nodes of all hosts."""

    label: str
    children: list[Slot] = field(default_factory=list)
    key: int = 0
    shape: tuple[int, int] | None = None

    def dump(self) -> list:
        return [self.label, [c.dump() for c in self.children]]

    @classmethod
    def load(cls, x: list, key: int) -> Slot:
        return cls(x[0], [cls.load(c, digest(key, i, c[0])) for i, c in enumerate(x[1])], key)


def digest(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


def measure(x: Node | Slot) -> tuple[int, int]:
    """A number that equal trees share, and how many nodes x has."""
    if x.shape is None:
        below = [measure(c) for c in x.children]
        x.shape = hash((x.label, *(h for h, _ in below))), 1 + sum(n for _, n in below)
    return x.shape


def match(a: list, b: list, known: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """Pairs of equal-labelled children, in order, that match most nodes in all: simple tree matching. known: weights of this page's pairs."""
    if len(a) == len(b) and all(x.label == y.label for x, y in zip(a, b, strict=True)):
        # no other pairs match more if each has one partner at most or all match in full
        if len({x.label for x in a}) == len(a) or all(measure(x) == measure(y) for x, y in zip(a, b, strict=True)):
            return [(i, i) for i in range(len(a))]
    # nothing matches more than equal trees at the same end do
    first, n = 0, min(len(a), len(b))
    while first < n and measure(a[first]) == measure(b[first]):
        first += 1
    last = 0
    while last < n - first and measure(a[-1 - last]) == measure(b[-1 - last]):
        last += 1
    ends = [(i, i) for i in range(first)], [(len(a) - i, len(b) - i) for i in range(last, 0, -1)]
    middle = between(a[first : len(a) - last], b[first : len(b) - last], known)
    return [*ends[0], *((i + first, j + first) for i, j in middle), *ends[1]]


def between(a: list, b: list, known: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    if len(a) * len(b) > CELLS:
        return by_turn(a, b)
    score = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            both = score[i - 1][j - 1] + weight(a[i - 1], b[j - 1], known)
            score[i][j] = max(score[i - 1][j], score[i][j - 1], both)
    out, i, j = [], len(a), len(b)
    while i and j:
        if score[i][j] == score[i - 1][j]:
            i -= 1
        elif score[i][j] == score[i][j - 1]:
            j -= 1
        else:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
    return out[::-1]


def by_turn(a: list, b: list) -> list[tuple[int, int]]:
    """The most pairs, in order, of the first node of a label with the first of the same label, the second with the second and so on."""
    places: dict[tuple[str, int], int] = {}
    turn: dict[str, int] = {}
    for j, y in enumerate(b):
        turn[y.label] = turn.get(y.label, 0) + 1
        places[y.label, turn[y.label]] = j
    turn.clear()
    ends: list[int] = []  # the least place in b at which a chain of so many pairs can end
    chain: list[tuple[int, int, int]] = []  # a pair and the one before it
    tops: list[int] = []
    for i, x in enumerate(a):
        turn[x.label] = turn.get(x.label, 0) + 1
        j = places.get((x.label, turn[x.label]))
        if j is None:
            continue
        k = bisect_left(ends, j)
        chain.append((i, j, tops[k - 1] if k else -1))
        ends[k : k + 1], tops[k : k + 1] = [j], [len(chain) - 1]
    out, at = [], tops[-1] if tops else -1
    while at >= 0:
        i, j, at = chain[at]
        out.append((i, j))
    return out[::-1]


def weight(a, b, known: dict[tuple[int, int], int]) -> int:
    if a.label != b.label:
        return 0
    if measure(a) == measure(b):
        return measure(a)[1]
    at = id(a), id(b)
    if at not in known:
        known[at] = 1 + sum(weight(a.children[i], b.children[j], known) for i, j in match(a.children, b.children, known))
    return known[at]


def learn_page(slot: Slot, node: Node, known: dict[tuple[int, int], int]) -> None:
    """Aligns a page with the tree; nodes without a partner are new slots."""
    pairs = {j: i for i, j in match(slot.children, node.children, known)}
    children, last = list(slot.children), -1
    for j, child in enumerate(node.children):
        if j in pairs:
            own = slot.children[pairs[j]]
            while children[last + 1] is not own:
                last += 1
            last += 1
        else:
            own = Slot(child.label)
            last += 1
            children.insert(last, own)
        learn_page(own, child, known)
    slot.children = children


def induce(pages: list[str]) -> str:
    """The tree of some of a host's pages: [label, children] as JSON."""
    root = Slot("#root")
    for p in sorted(set(pages)):
        learn_page(root, fold(parse(p)), {})
        root = Slot.load(root.dump(), 0)  # without the measures of what it was
    return json.dumps(root.dump())


def aligned(root: Node, tree: Slot | None) -> Iterator[tuple[Node, int | None, bool, Node | None]]:
    """The nodes with texts that aren't outside: with their keys, whether they stand in an article or main element, and in which MAYBE section."""
    known: dict[tuple[int, int], int] = {}

    def walk(node: Node, own: Slot | None, key: int | None, inside: bool, section: Node | None) -> Iterator[tuple[Node, int | None, bool, Node | None]]:
        if node.outside:
            return
        inside = inside or node.label.split(".")[0] in ("article", "main")
        section = section or (node if node.maybe else None)
        if node.texts:
            yield node, key, inside, section
        partner = {j: own.children[i] for i, j in match(own.children, node.children, known)} if own else {}
        turn: dict[str, int] = {}
        for j, c in enumerate(node.children):
            if j in partner:
                yield from walk(c, partner[j], partner[j].key, inside, section)
            else:
                turn[c.label] = turn.get(c.label, 0) + 1
                yield from walk(c, None, None if key is None else digest(key, "new", turn[c.label], c.label), inside, section)

    return walk(root, tree, tree.key if tree else None, False, None)


def body_of(page: str | None, tree: Slot | None) -> list:
    """Whether the page has an article or main element, and of each node with texts: key, inside one, number of its MAYBE section, texts, places."""
    if not page:
        return [False, []]
    root = fold(parse(page))
    numbers: dict[int, int] = {}
    nodes = [[key, inside, numbers.setdefault(id(section), len(numbers) + 1) if section else 0, node.texts, node.order] for node, key, inside, section in aligned(root, tree)]
    return [root.main, nodes]


@dataclass
class Wrapper:
    """Of a host: the digests of (key, text) of its template texts, and of its slots that LEAST pages have: characters a page of texts that
    aren't template, and whether most of these texts stand in a single page."""

    template: frozenset[int]
    slots: dict[int, tuple[float, bool]]

    @classmethod
    def load(cls, dumped: str) -> Wrapper:
        x = json.loads(dumped)
        return cls(frozenset(x.get("template") or ()), {n["node"]: (n["varying"], n["single"]) for n in x.get("slots") or ()})


def chosen(body: list, wrapper: Wrapper | None) -> str:
    """The main text among a page's aligned texts."""
    main, nodes = body
    slots = wrapper.slots if wrapper else {}
    sections: dict[int, float] = {}  # varying characters of texts of a single page, less those of others
    length = {section: 0 for _, _, section, _, _ in nodes}
    for key, _, section, texts, _ in nodes:
        length[section] += sum(map(len, texts))
        if section and key in slots:
            varying, single = slots[key]
            sections[section] = sections.get(section, 0.0) + (varying if single else -varying)
    # a section that the wrapper says nothing about is content if it is most of the page
    most = {x for x, n in length.items() if x not in sections and 2 * n > sum(length.values())}
    found: list[tuple[int, str, bool]] = []
    held = {True: 0.0, False: 0.0}  # varying characters inside and outside article and main
    for key, inside, section, texts, order in nodes:
        if section and sections.get(section, 0.0) <= 0 and section not in most:
            continue
        own = [(k, text, inside) for text, k in zip(texts, order, strict=True) if not wrapper or digest(key, text) not in wrapper.template]
        found += own
        if key in slots:
            held[inside] += slots[key][0]
        elif inside:
            held[inside] += sum(len(t) for _, t, _ in own)
    main = main and held[True] >= held[False]
    return "\n".join(t for _, t, inside in sorted(found) if inside or not main)


def extract(page: str | None, wrapper: Wrapper | None = None, tree: Slot | None = None) -> str:
    return chosen(body_of(page, tree), wrapper)


def inducer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by host: a tree for each."""
    host, pages = None, []
    for batch in batches:
        for h, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if h != host:
                if pages:
                    yield pa.RecordBatch.from_pydict({"of": [host], "tree": [induce(pages)]})
                host, pages = h, []
            pages.append(page)
    if pages:
        yield pa.RecordBatch.from_pydict({"of": [host], "tree": [induce(pages)]})


#: What a worker passes on: of a page its row and its aligned texts, and sums, in whose rows `of` is null.
SUMMED = [("host", pa.string()), ("node", pa.int64()), ("text", pa.int64()), ("length", pa.int64()), ("pages", pa.float64())]


def aligner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's aligned texts, and partial sums: in how many pages a node stands (text is null, host is given) and in how many each of its texts."""
    trees: dict[str, Slot] = {}
    sums: dict[tuple[str | None, int, int | None, int], float] = {}
    kinds: list[pa.DataType] = []

    def out() -> pa.RecordBatch:
        keys = list(zip(*sums, strict=True))
        arrays = [*(pa.nulls(len(sums), k) for k in kinds), *(pa.array(x, type=k) for x, (_, k) in zip([*keys, list(sums.values())], SUMMED, strict=True))]
        sums.clear()
        return pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "of", "body", *(n for n, _ in SUMMED)])

    for batch in batches:
        kinds = [batch.schema.field("page_id").type, pa.string(), pa.string(), pa.string()]
        for part in slices(batch, "html"):
            bodies = []
            for page, host, tree, n in zip(*(part.column(c).to_pylist() for c in ("html", "host", "tree", "n")), strict=True):
                if tree and host not in trees:
                    if len(trees) > 500:
                        trees.clear()
                    trees[host] = Slot.load(json.loads(tree), digest("host", host))
                body = body_of(page, trees.get(host))
                bodies.append(json.dumps(body, ensure_ascii=False, separators=(",", ":")))
                for node, _, _, texts, _ in body[1]:
                    for at in ((host, node, None, 0), *((None, node, digest(node, t), len(t)) for t in set(texts))):
                        sums[at] = sums.get(at, 0.0) + 1.0 / n
            rows = len(bodies)
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), part.column("host"), pa.array(bodies, type=pa.string()), *(pa.nulls(rows, k) for _, k in SUMMED)], names=["page_id", "url", "of", "body", *(n for n, _ in SUMMED)])
            if len(sums) > SUMS:
                yield out()
    if sums:
        yield out()


def extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    loaded: dict[str, Wrapper] = {}
    for batch in batches:
        for part in slices(batch, "body"):
            texts = []
            for body, host, dumped in zip(*(part.column(c).to_pylist() for c in ("body", "of", "wrapper")), strict=True):
                if dumped and host not in loaded:
                    if len(loaded) > 500:
                        loaded.clear()
                    loaded[host] = Wrapper.load(dumped)
                texts.append(chosen(json.loads(body), loaded.get(host)))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=["page_id", "url", "text", "n_chars"])


def host_of(url: str) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def attach(rows: DataFrame, few: DataFrame, keys: dict[str, str], how: str, salt: F.Column, salts: int, broadcast_bytes: int, keep: bool = False) -> DataFrame:
    """rows joined with few (a written table) on keys (row's to few's): broadcast up to broadcast_bytes, else shuffled, each of few dealt to all salts."""
    size = few.agg(F.sum(sum((F.octet_length(c) if t == "string" else F.lit(8) for c, t in few.dtypes), F.lit(0)))).first()[0] or 0
    same = [F.col(a) == F.col(b) for a, b in keys.items()]
    gone = [] if keep else list(keys.values())
    if size <= broadcast_bytes:
        return rows.join(F.broadcast(few), same, how).drop(*gone)
    few = few.withColumn("__w_of_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.withColumn("__w_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    return rows.join(few.hint("merge"), [*same, F.col("__w_salt") == F.col("__w_of_salt")], how).drop(*gone, "__w_salt", "__w_of_salt")


def trees_of(keyed: DataFrame, sample: int) -> tuple[DataFrame, DataFrame]:
    """of (host) and tree, from each host's `sample` pages with the least hash; and of_host, of_h and n of pages that stand in several rows."""
    hashes = materialize(keyed.where("h is not null").groupBy("host", "h").agg(F.count("*").alias("n")), "hashes")
    salt = F.pmod(F.col("h"), F.lit(SALTS))
    first = hashes.withColumn("k", F.row_number().over(Window.partitionBy("host", salt).orderBy("h"))).where(F.col("k") <= sample)
    ranked = first.withColumn("k", F.row_number().over(Window.partitionBy("host").orderBy("h"))).where(F.col("k") <= sample)
    picked = materialize(ranked.select(F.col("host").alias("of_host"), F.col("h").alias("of_h")), "chosen")
    may, _ = sift(keyed.where("h is not null"), "h", picked.select("of_h"))
    # of pages with the same html one is enough; they agree, so any is the same
    once = may.groupBy("host", "h").agg(F.min("html").alias("html"))
    bodies = once.join(picked, (F.col("host") == F.col("of_host")) & (F.col("h") == F.col("of_h")), "left_semi")
    trees = materialize(bodies.select("host", "html").repartition("host").sortWithinPartitions("host", "html").mapInArrow(lean(inducer), "of string, tree string"), "trees")
    repeats = materialize(hashes.where("n > 1").select(F.col("host").alias("of_host"), F.col("h").alias("of_h"), "n"), "repeats")
    free(hashes, picked)
    return trees, repeats


def aligned_pages(keyed: DataFrame, sample: int, salts: int, broadcast_bytes: int) -> DataFrame:
    """A written table: page_id, url, of (host) and body of each row of keyed, and rows of partial sums, in which `of` is null."""
    trees, repeats = trees_of(keyed, sample)
    may, rest = sift(keyed, "h", repeats.select("of_h"))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")
    dealt = repeats.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    again = may.withColumn("salt", salt).join(dealt, (F.col("host") == F.col("of_host")) & (F.col("h") == F.col("of_h")) & (F.col("salt") == F.col("of_salt")), "left").select(*keyed.columns, "n")
    rows = attach(again.unionByName(rest.withColumn("n", F.lit(None).cast("long"))), trees, {"host": "of"}, "left", F.xxhash64("page_id", "url"), salts, broadcast_bytes)
    schema = f"page_id {dict(keyed.dtypes)['page_id']}, url string, of string, body string, host string, node long, text long, length long, pages double"
    out = materialize(rows.select("page_id", "url", "html", "host", "tree", F.coalesce("n", F.lit(1)).alias("n")).mapInArrow(lean(aligner), schema), "aligned", "zstd")
    free(trees, repeats)
    return out


def decide(counts: DataFrame, salts: int, broadcast_bytes: int) -> DataFrame:
    """slots_of (host) and wrapper, of hosts with a node in LEAST pages: a text is template that stands in CONSTANT of the pages that have its node, if these are LEAST or more."""
    count = lambda which, what="pages": F.coalesce(F.sum(F.when(which, F.col(what))), F.lit(0))
    counts = counts.withColumn("chars", F.col("pages") * F.col("length"))
    a_text = F.col("text").isNotNull()
    sums = counts.groupBy(F.col("node").alias("of_node")).agg(F.max("host").alias("of"), count(~a_text).alias("seen"), count(a_text).alias("texts"), count(a_text & (F.col("pages") <= 1)).alias("singles"), count(a_text, "chars").alias("all_chars"))
    nodes = materialize(sums.where(F.col("seen") >= LEAST), "nodes")
    often = counts.where(a_text & (F.col("pages") >= CONSTANT * LEAST)).drop("host")
    # a node has as many template texts at most as a page has texts there, by 1 / CONSTANT
    template = attach(often, nodes.select("of_node", "of", "seen"), {"node": "of_node"}, "inner", F.col("text"), salts, broadcast_bytes, keep=True).where(F.col("pages") >= CONSTANT * F.col("seen") - 1e-9)
    template = materialize(template.select("of", "of_node", "text", "pages", "chars"), "template")
    gone = template.groupBy(F.col("of_node").alias("gone_node")).agg(F.sum("pages").alias("gone"), F.sum("chars").alias("gone_chars"))
    left = nodes.join(gone, F.col("of_node") == F.col("gone_node"), "left")
    varying = (F.col("all_chars") - F.coalesce("gone_chars", F.lit(0))) / F.col("seen")
    single = 2 * F.col("singles") > F.col("texts") - F.coalesce("gone", F.lit(0))
    slots = left.groupBy(F.col("of").alias("slots_of")).agg(F.sort_array(F.collect_list(F.struct(F.col("of_node").alias("node"), varying.alias("varying"), single.alias("single")))).alias("slots"))
    found = template.groupBy(F.col("of").alias("template_of")).agg(F.sort_array(F.collect_list("text")).alias("template"))
    both = slots.join(found, F.col("slots_of") == F.col("template_of"), "left")
    return both.select("slots_of", F.to_json(F.struct("template", "slots")).alias("wrapper"))


def main_text(pages: DataFrame, sample: int = SAMPLE, salts: int = SALTS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html)."""
    own = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).withColumn("host", host_of("url"))
    keyed = own.withColumn("h", F.when(F.length("html") > 0, F.xxhash64("html")))
    found = aligned_pages(keyed, sample, salts, broadcast_bytes)
    sums = found.where("of is null").groupBy("node", "text").agg(F.max("host").alias("host"), F.max("length").alias("length"), F.round(F.sum("pages")).cast("long").alias("pages"))
    models = materialize(decide(materialize(sums, "counts"), salts, broadcast_bytes), "wrappers")
    both = attach(found.where("of is not null").select("page_id", "url", "of", "body"), models, {"of": "slots_of"}, "left", F.xxhash64("page_id", "url"), salts, broadcast_bytes)
    id_type = dict(own.dtypes)["page_id"]
    return both.select("page_id", "url", "of", "body", "wrapper").mapInArrow(lean(extractor), f"page_id {id_type}, url string, text string, n_chars long")
