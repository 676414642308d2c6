"""Main text of web pages by wrapper induction.

Pages of one host are mostly made by one template. A page becomes an ordered tree of its
block elements (inline elements belong to the text of their block). Runs of neighbouring
siblings of one kind (tag and class) and one shape are folded to an iterator; a parent
with more than ``FLOW`` runs is a flow, whose children are one leaf for each kind.

1. *Wrapper.* The trees of up to ``WRAPPER_PAGES`` pages of a host (chosen by hashes of
   page_id) are merged one after the other: simple tree matching finds the heaviest
   order-keeping matching of the children in each pair of matched nodes, and what a page
   has besides is inserted where it stands.
2. *Votes.* Every page of the host is aligned with the wrapper by the same matching. The
   own text of each of its elements is counted at its wrapper node; pages with the same
   longest texts count once. A text that stands at its node on ``ALWAYS`` of the pages or
   more is constant, one on ``OFTEN`` or more recurs. The others make the node's varying text.
3. *Slots.* The content slot is the node that most pages mark as their article (``article``,
   ``main``, ``role=main``, ``itemprop=articleBody``), if there is one. Else it is found by
   going down from the root as long as one container holds ``SHARE`` of the varying text
   that isn't in links and nothing beside it comes near it (``SECOND``). There, slots that hold mostly links are template, and so are
   containers at either end that vary little.
4. *Extraction.* A page is aligned again; the text of its content slots remains, without
   constant texts, and without recurring ones if these are a small part of it (a page
   that shares most of its text with others is a copy, not a template).

Hosts with fewer than ``MIN_VOTES`` different pages, and pages without a content slot of
their host or (where no article is marked) without text in it, are settled by the page alone with the rule of step 3.

Regions that their tags mark as no content (menus, asides, footers, forms, scripts) are cut
inside a content slot, too, and so is what isn't shown. Class, id and role names (whole
tokens) decide where no article is marked; inside a marked one they cut what readers wrote
(an ``article`` there marks nothing), and adverts, notices and the like that are the
smaller part of it. If the only marked articles lie in regions that would be cut, these
regions stay, with any text outside of them.

Defined cases: null or empty html gives the empty text; pages without a host share the
host ""; unclosed and stray tags are repaired as far as block structure needs; nesting may
be of any depth; rows without a page_id don't serve as wrapper pages and get their text like the
others; repeated rows are extracted one by one; an input column named ``text`` is
replaced, other columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import json
import re
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_checked, materialize, per_text, read

#: Pages of a host that its wrapper is merged from, and different pages that a host needs to have a template.
WRAPPER_PAGES, MIN_VOTES = 8, 3
#: A text is constant, or recurs, if it stands at its node on so many of the host's different pages.
ALWAYS, OFTEN = 0.8, 0.3
#: Constant texts are kept in a marked article, recurring ones anywhere, if they are more than this of its text.
COPY, COPY_OFTEN = 0.5, 0.3
#: The content slot is looked for below a node while one container has so much of the node's varying text,
#: and no other child of the node has more than this of the container's.
SHARE, SECOND = 0.5, 0.25
#: Slots with more of their text in links are template; containers at the ends with less of the varying text, too.
LINKS, LITTLE = 0.6, 0.1
#: A parent with more runs of children is a flow.
FLOW = 64

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:([^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)>|([^>]*)>)|<[!?][^>]*>""", re.S)
#: Attributes that say what a node is.
TELLING = re.compile(r"class|id\s*=|role|itemprop|hidden|style\s*=", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
#: What a start tag closes if it is open in the same region.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES |= {t: {"p"} for t in BLOCK - set(CLOSES) - {"br"}}
STOPS = frozenset("table ul ol dl article section div body html select main nav aside footer header form".split())
NO_CONTENT = frozenset("script style noscript template iframe textarea title head header nav footer aside form button select svg canvas object dialog menu".split())
NO_CONTENT_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments contentinfo cookie cookies consent copyright disclaimer disqus footer header menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related search share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split())
#: Names that say that readers wrote what a node holds; it is no content wherever it stands, nor is an article in it.
READERS = frozenset("comment comments comment-list comment-body commentlist comments-area comments-section replies respond disqus disqus_thread".split())
#: Names that may stand at the title or around the article itself; they cut nothing inside a marked one.
FRAMES = frozenset("banner header".split())
MAIN = frozenset(("article", "main"))
ROOTS = frozenset(("html", "body"))
#: Elements that may be layout: content is looked for inside of them, and they may be trimmed.
CONTAINERS = frozenset("article body center details div dl fieldset form html main section table tbody td tr #root".split())
HEADINGS = frozenset("h1 h2 h3".split())


@lru_cache(10_000)
def nature(tag: str, attrs: str) -> tuple[str, bool, bool, bool, int]:
    """Kind (tag and class), whether it marks the article, whether it is no content, whether only its names say so,
    and what these mean inside a marked article (2: readers' words, 1: no content if it is the smaller part, 0: nothing)."""
    given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)}
    names = {*given.get("class", "").lower().split(), given.get("id", "").strip().lower(), *given.get("role", "").lower().split()}
    readers = tag not in ROOTS and bool(names & READERS)
    main = not readers and (tag in MAIN or given.get("role", "").lower() in MAIN or given.get("itemprop", "").lower() == "articlebody")
    unseen = bool(re.search(r"(?i)(?:^|\s)hidden(?:\s|=|$)", ATTR.sub("", attrs))) or "hidden" in given or given.get("aria-hidden") == "true" or bool(UNSEEN.search(given.get("style", "")))
    sure = not main and tag not in ROOTS and (tag in NO_CONTENT or unseen)
    named = not main and tag not in ROOTS and not sure and bool(names & (NO_CONTENT_WORDS | READERS))
    inner = 0 if not named else 2 if readers else int(bool(names & (NO_CONTENT_WORDS - FRAMES)))
    # numbers in class names tell pages apart, not kinds
    kind = ".".join([tag, *sorted(re.sub(r"\d+", "0", given["class"]).split())]) if given.get("class") else tag
    return kind, main, sure or named, named, inner


class Node:
    __slots__ = ("children", "inner", "kind", "main", "named", "out", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag = tag
        self.children: list[Node | str | None] = []  # None: a break between blocks
        self.kind, self.main, self.out, self.named, self.inner = nature(tag, attrs if attrs and TELLING.search(attrs) else "")


def parse(page: str) -> Node:
    """A tree of a page, repaired where tags are missing."""
    root = Node("#root")
    stack, at = [root], 0
    pos = 0
    while (m := TAG.search(page, pos)) is not None:
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = pos = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in STOPS and tag not in STOPS:
                    break
            if tag in BLOCK:
                stack[-1].children.append(None)
            continue
        if (over := CLOSES.get(tag)) is not None:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in over:
                    del stack[k:]
                    break
                if stack[k].tag in STOPS:
                    break
        attrs = m[3] or m[4] or ""
        node = Node(tag, attrs)
        if tag in BLOCK:
            stack[-1].children.append(None)
        stack[-1].children.append(node)
        if tag in RAW:
            close = re.compile(f"</{tag}", re.I | re.A).search(page, at)
            end = close.start() if close else len(page)
            if tag == "title" or tag == "textarea":
                node.children.append(page[at:end])
            at = pos = end
            stack.append(node)
            if end == len(page):
                break
            continue
        if tag not in VOID and not attrs.endswith("/"):
            stack.append(node)
    if at < len(page):
        stack[-1].children.append(page[at:])
    return root


def text_of(parts: list[str]) -> str:
    """References decoded, white space made one space."""
    return " ".join(html.unescape("".join(parts)).split())


def holders(root: Node) -> set[int]:
    """ids of the nodes that would be cut but hold a marked article, if every marked article lies in one of these."""
    found, only = set(), True
    # (node, nodes above that would be cut, as a chain)
    stack: list = [(root, None)]
    while stack:
        x, above = stack.pop()
        if x.main:
            only = only and above is not None
            while above is not None and above[0] not in found:
                found.add(above[0])
                above = above[1]
            continue
        above = (id(x), above) if x.out else above
        stack.extend((c, above) for c in x.children if isinstance(c, Node))
    return found if only else set()


class Page:
    """The block tree of a page in flat lists, in page order, and its text blocks."""

    def __init__(self, page: str):
        root = parse(page)
        held = holders(root)
        self.held = bool(held)
        self.kind, self.tag, self.kids = [root.kind], [root.tag], [[]]
        self.main, self.sure, self.named, self.region, self.inner = [False], [False], [False], [False], [0]
        blocks: list = []  # (node, parts, characters in links)
        now: list | None = None
        # (node, its block node, in a link, in a region that stays for its article)
        stack: list = [(root, 0, False, False)]
        while stack:
            x, at, link, region = stack.pop()
            if x is None:
                now = None
                continue
            if not isinstance(x, Node):
                if now is None or now[0] != at:
                    now = [at, [], 0]
                    blocks.append(now)
                now[1].append(x)
                now[2] += len(x) if link else 0
                continue
            if id(x) in held:
                region = True
            elif x.tag in RAW or x.tag == "head":
                continue
            if (x.tag in BLOCK or x.main or x.out) and x.tag not in VOID and x is not root:
                self.kids[at].append(len(self.kind))
                at = len(self.kind)
                self.kind.append(x.kind)
                self.tag.append(x.tag)
                self.kids.append([])
                self.main.append(x.main)
                self.sure.append(x.out and not x.named and id(x) not in held)
                self.named.append(x.named and id(x) not in held)
                self.inner.append(0 if id(x) in held else x.inner)
                self.region.append(region)
            link = link or x.tag == "a"
            stack.extend((c, at, link, region) for c in reversed(x.children))
        self.blocks = [(at, text, links) for at, parts, links in blocks if (text := text_of(parts))]
        self.fold()

    def own_texts(self) -> dict[int, tuple[int, int, int]]:
        """Of each node with text of its own: hash of that text, and its characters outside of and in links."""
        own: dict[int, list] = {}
        for at, text, links in self.blocks:
            own.setdefault(at, []).append((text, min(len(text), links)))
        return {at: (hashed("\n".join(t for t, _ in x)), sum(len(t) - k for t, k in x), sum(k for _, k in x)) for at, x in own.items()}

    def fold(self) -> None:
        """The folded tree: ``slot`` of each node, and kind, children of each slot."""
        n = len(self.kind)
        shape, runs = [0] * n, [()] * n
        for i in range(n - 1, -1, -1):
            own: list = []
            for c in self.kids[i]:
                if own and own[-1][0] == shape[c]:
                    own[-1][1].append(c)
                else:
                    own.append((shape[c], [c]))
            if len(own) > FLOW:
                shape[i], runs[i] = hash((self.kind[i], "flow")), None
            else:
                shape[i], runs[i] = hash((self.kind[i], tuple(s for s, _ in own))), own
        self.slot, self.slot_kind, self.slot_kids, self.slot_tag = [-1] * n, [], [], []
        stack = [(-1, [0])]
        while stack:
            parent, members = stack.pop()
            at = len(self.slot_kind)
            self.slot_kind.append(self.kind[members[0]])
            self.slot_tag.append(self.tag[members[0]])
            self.slot_kids.append([])
            if parent >= 0:
                self.slot_kids[parent].append(at)
            for m in members:
                self.slot[m] = at
            if runs[members[0]] is None:
                # a flow: one leaf for each kind, with all that lies below
                leaves: dict[str, int] = {}
                for m in members:
                    for c in self.kids[m]:
                        if (leaf := leaves.get(self.kind[c])) is None:
                            leaf = leaves[self.kind[c]] = len(self.slot_kind)
                            self.slot_kind.append(self.kind[c])
                            self.slot_tag.append(self.tag[c])
                            self.slot_kids.append([])
                            self.slot_kids[at].append(leaf)
                        below = [c]
                        while below:
                            b = below.pop()
                            self.slot[b] = leaf
                            below.extend(self.kids[b])
            else:
                # members are of one shape, so their runs are parallel; the stack gives them back in page order
                together = zip(*(runs[m] for m in members), strict=True)
                stack.extend(reversed([(at, [c for _, own in run for c in own]) for run in together]))


def match(kind: list, kids: list, other_kind: list, other_kids: list) -> dict[int, int]:
    """Simple tree matching of two trees with equal roots: node to node of the other tree.

    In each pair of nodes of one kind the children are matched in order, so that the
    number of matched nodes is largest.
    """
    done: dict[tuple[int, int], tuple[int, list]] = {}
    stack = [(0, 0, False)]
    while stack:
        a, b, ready = stack.pop()
        if (a, b) in done:
            continue
        own, others = kids[a], other_kids[b]
        if not own or not others:
            done[a, b] = (1, [])
            continue
        if not ready:
            stack.append((a, b, True))
            stack.extend((x, y, False) for x in own for y in others if kind[x] == other_kind[y])
            continue
        # best[i][j]: the heaviest matching of the first i and j children
        best = [[0] * (len(others) + 1)]
        for x in own:
            above, row = best[-1], [0]
            for j, y in enumerate(others):
                value = above[j + 1] if above[j + 1] >= row[j] else row[j]
                if kind[x] == other_kind[y] and (here := above[j] + done[x, y][0]) > value:
                    value = here
                row.append(value)
            best.append(row)
        i, j, pairs = len(own), len(others), []
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((own[i], others[j]))
        done[a, b] = (1 + best[-1][-1], pairs)
    out, work = {}, [(0, 0)]
    while work:
        a, b = work.pop()
        out[a] = b
        work.extend(done[a, b][1])
    return out


def merge(pages: list[Page]) -> str:
    """The wrapper of some pages as JSON: kind, tag and children of each node."""
    kind, tag, kids, seen = ["#root"], ["#root"], [[]], [0]
    for p in pages:
        to = match(p.slot_kind, p.slot_kids, kind, kids)
        for i in range(len(p.slot_kind)):
            if i not in to:
                continue  # inserted below with its parent's children, or it lies below an inserted node
            at = to[i]
            seen[at] += 1
            place = 0
            for c in p.slot_kids[i]:
                if c in to:
                    place = kids[at].index(to[c]) + 1
                    continue
                to[c] = len(kind)
                kind.append(p.slot_kind[c])
                tag.append(p.slot_tag[c])
                kids.append([])
                seen.append(0)
                kids[at].insert(place, to[c])
                place += 1
    # of three pages or more, what only one of them has says nothing of the host
    least = 2 if len(pages) > 2 else 1
    order, number, stack = [], {}, [0]
    while stack:
        x = stack.pop()
        number[x] = len(order)
        order.append(x)
        kids[x] = [c for c in kids[x] if seen[c] >= least]
        stack.extend(reversed(kids[x]))
    return json.dumps({"kind": [kind[x] for x in order], "tag": [tag[x] for x in order], "kids": [[number[c] for c in kids[x]] for x in order]}, separators=(",", ":"))


def placed(p: Page, wrapper: dict) -> list[int]:
    """The wrapper node of each slot of a page: its own, or that of the nearest slot above that has one (negative: ~node)."""
    to = match(p.slot_kind, p.slot_kids, wrapper["kind"], wrapper["kids"])
    out = [0] * len(p.slot_kind)
    for i, below in enumerate(p.slot_kids):
        near = out[i] if out[i] >= 0 else ~out[i]
        for c in below:
            out[c] = to.get(c, ~near)
    return out


def choose(tag: list, kids: list, cut: list, chars: list, links: list, marked: set) -> tuple[set[int], set[int]]:
    """(content slots, template slots below them) from the varying text of each slot.

    ``cut`` slots are no content by their tags or names, ``chars`` and ``links`` count
    characters outside of and in links; children come after their parents.
    """
    if marked:
        return marked, set()
    chars, links = list(chars), list(links)
    for i in range(len(tag) - 1, -1, -1):
        for c in kids[i]:
            if not cut[c]:
                chars[i] += chars[c]
                links[i] += links[c]
    at = 0
    while True:
        own = [c for c in kids[at] if not cut[c]]
        into = max(own, key=lambda c: chars[c], default=None)
        if into is None or tag[into] not in CONTAINERS or not kids[into] or chars[into] < SHARE * chars[at] or any((tag[c] in HEADINGS and chars[c]) or (c != into and chars[c] > SECOND * chars[into]) for c in own):
            break
        at = into
    out = set()
    for ends in (kids[at], kids[at][::-1]):
        for c in ends:
            if not cut[c] and (tag[c] not in CONTAINERS or chars[c] >= LITTLE * chars[at]):
                break
            out.add(c)
    stack = list(kids[at])
    while stack:
        c = stack.pop()
        if links[c] > LINKS * (links[c] + chars[c]) and tag[c] not in ("p", *HEADINGS):
            out.add(c)
        else:
            stack.extend(kids[c])
    return {at}, out


def outcast(p: Page, named: bool) -> list[bool]:
    """Nodes that are no content by their tags, and if ``named`` by their names; a form that holds most of the text stays.

    If not ``named``, for an article is marked, names still cut what readers wrote, and
    adverts, notices and the like that hold less than half of the largest marked article.
    """
    out = [s or (named and x) for s, x in zip(p.sure, p.named, strict=True)]
    inner = [] if named else [i for i, x in enumerate(p.inner) if x]
    if inner or "form" in p.tag:
        size = [0] * len(p.tag)
        for at, text, _ in p.blocks:
            size[at] += len(text)
        for i in range(len(size) - 1, -1, -1):
            size[i] += sum(size[c] for c in p.kids[i])
        most = max((size[i] for i, x in enumerate(p.main) if x), default=size[0])
        for i in inner:
            out[i] = out[i] or p.inner[i] == 2 or 2 * size[i] < most
        for i, t in enumerate(p.tag):
            if t == "form" and 2 * size[i] > size[0]:
                out[i] = False
    return out


def alone(p: Page) -> str:
    """The text of a page by itself: its marked articles, else what its own tree says."""
    n = len(p.kind)
    by_tag = outcast(p, False)
    cut = list(by_tag) if any(p.main) else outcast(p, True)
    inside, gone = [False] * n, [False] * n
    for i in range(n):
        if cut[i] and not (inside[i] and p.tag[i] == "header"):
            gone[i] = True
        inside[i] = inside[i] or (p.main[i] and not gone[i])
        for c in p.kids[i]:
            inside[c], gone[c] = inside[i], gone[i]
    if any(inside):
        outside = any(not gone[at] and not inside[at] and not p.region[at] for at, _, _ in p.blocks)
        if not (p.held and outside) and any(inside[at] and not gone[at] for at, _, _ in p.blocks):
            return " ".join(text for at, text, _ in p.blocks if inside[at] and not gone[at])
        if p.held:
            return " ".join(text for at, text, _ in p.blocks if not gone[at])
    if any(p.main):
        cut = outcast(p, True)
        gone = [False] * n
        for i in range(n):
            gone[i] = gone[i] or cut[i]
            for c in p.kids[i]:
                gone[c] = gone[i]
    chars, links = [0] * n, [0] * n
    for at, text, linked in p.blocks:
        chars[at] += max(0, len(text) - linked)
        links[at] += min(len(text), linked)
    roots, out = choose(p.tag, p.kids, gone, chars, links, set())
    state = [False] * n
    for i in range(n):
        state[i] = (state[i] or i in roots) and i not in out
        for c in p.kids[i]:
            state[c] = state[i]
    return " ".join(text for at, text, _ in p.blocks if state[at] and not gone[at])


class Host:
    """What is known of a host: its wrapper, content slots, template slots, constant and recurring texts."""

    def __init__(self, wrapper: str, pages: int, sums: list, marks: list, recurring: list):
        self.wrapper = json.loads(wrapper)
        n = len(self.wrapper["kind"])
        chars, links = [0] * n, [0] * n
        for s in sums:
            chars[s["node"]], links[s["node"]] = s["chars"], s["links"]
        self.marked = {m["node"] for m in marks if 2 * m["pages"] >= pages}
        cut = [t in NO_CONTENT and t != "form" for t in self.wrapper["tag"]]
        self.content, self.template = choose(self.wrapper["tag"], self.wrapper["kids"], cut, chars, links, self.marked)
        self.always = {(r["node"], r["hash"]) for r in recurring if r["pages"] >= ALWAYS * pages}
        self.often = {(r["node"], r["hash"]) for r in recurring if r["pages"] < ALWAYS * pages}

    def text(self, p: Page) -> str | None:
        """The text of a page, or nothing if it has no content slot of the host."""
        to = placed(p, self.wrapper)
        if not self.content.intersection(to):
            return None
        cut = outcast(p, not self.marked)
        kept, gone = [False] * len(p.kind), [False] * len(p.kind)
        for i in range(len(p.kind)):
            node = to[p.slot[i]]
            kept[i] = kept[i] or node in self.content
            gone[i] = gone[i] or node in self.template or (cut[i] and not (kept[i] and p.tag[i] == "header"))
            for c in p.kids[i]:
                kept[c], gone[c] = kept[i], gone[i]
        level = {}
        for at, (key, _, _) in p.own_texts().items():
            node = to[p.slot[at]]
            said = (node if node >= 0 else ~node, key)
            level[at] = 2 if said in self.always else 1 if said in self.often else 0
        own = [(text, level[at]) for at, text, _ in p.blocks if kept[at] and not gone[at]]
        for kind, most in ((2, COPY if self.marked else 1.0), (1, COPY_OFTEN)):
            shared = sum(len(t) for t, x in own if x == kind)
            if shared <= most * sum(len(t) for t, _ in own):
                own = [(t, x) for t, x in own if x != kind]
        return " ".join(t for t, _ in own)


def hashed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


def extract(page: str | None, host: Host | None = None) -> str:
    """The main text of a page, by its host's wrapper if there is one."""
    if not page:
        return ""
    p = Page(page)
    text = host.text(p) if host else None
    # a content slot that nobody marks may miss a page of another layout
    return alone(p) if text is None or not (text or host.marked) else text


def host_of(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def wrapper_of(pages: pa.Table) -> pa.Table:
    """One row for a host: the wrapper of its chosen pages."""
    own = sorted(zip(pages.column("_page").to_pylist(), pages.column("html").to_pylist(), strict=True))
    return pa.table({"_host": [pages.column("_host")[0].as_py()], "_wrapper": [merge([Page(x) for _, x in own])]})


def voter():
    """Fingerprint, texts at their wrapper nodes and marked nodes of each page."""
    wrappers: dict[str, dict] = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints, blocks, marks = [], [], []
        for host, page, raw in zip(*(batch.column(c).to_pylist() for c in ("_host", "html", "_wrapper")), strict=True):
            if len(wrappers) > 2000:
                wrappers.clear()
            if (wrapper := wrappers.get(host)) is None:
                wrapper = wrappers[host] = json.loads(raw)
            p = Page(page)
            to = placed(p, wrapper)
            own, sizes = {}, {}
            for at, (key, chars, links) in p.own_texts().items():
                node = to[p.slot[at]]
                x = own.setdefault((node if node >= 0 else ~node, key), [0, 0])
                x[0] += chars
                x[1] += links
                sizes[key] = chars + links
            longest = sorted(sizes, key=lambda k: (-sizes[k], k))[:3]
            prints.append(hashed(repr(sorted(longest))))
            blocks.append([{"node": n, "hash": k, "chars": c, "links": x} for (n, k), (c, x) in own.items()])
            marks.append(sorted({to[p.slot[i]] for i in range(len(p.kind)) if p.main[i] and to[p.slot[i]] >= 0}))
        types = pa.list_(pa.struct([("node", pa.int32()), ("hash", pa.int64()), ("chars", pa.int64()), ("links", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column("_host"), pa.array(prints, pa.int64()), pa.array(blocks, types), pa.array(marks, pa.list_(pa.int32()))], names=["_host", "print", "blocks", "marks"])

    return work


def extractor():
    hosts: dict[str, Host] = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for page, name, known in zip(*(batch.column(c).to_pylist() for c in ("html", "_host", "_known")), strict=True):
            host = None
            if known is not None and (host := hosts.get(name)) is None:
                if len(hosts) > 500:
                    hosts.clear()
                host = hosts[name] = Host(*(known[k] for k in ("wrapper", "pages", "sums", "marks", "recurring")))
            out.append(extract(page, host))
        names = [c for c in batch.schema.names if c not in ("html", "_host", "_known")]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.string())], names=[*names, "text"])

    return work


def induce(pages: DataFrame) -> DataFrame:
    """(_host, _known): wrapper, number of different pages, varying text by node, marked nodes and recurring texts.

    A host's row is bounded by the size of its wrapper and of a few pages.
    """
    own = pages.select(host_of(F.col("url")).alias("_host"), F.col("page_id").alias("_page"), "html").filter("trim(html) <> ''")
    picks = own.filter("_page IS NOT NULL").groupBy("_host").agg(F.array(*(F.min_by("_page", F.xxhash64("_page", F.lit(k))) for k in range(WRAPPER_PAGES))).alias("_page"))
    first = materialize(picks.select("_host", F.explode(F.array_distinct("_page")).alias("_page")), "wrapper-pages")
    chosen = join_checked(own, first, ["_host", "_page"], "left_semi", 120).groupBy("_host", "_page").agg(F.min("html").alias("html"))
    wrappers = materialize(chosen.groupBy("_host").applyInArrow(wrapper_of, "_host string, _wrapper string"), "wrappers")
    # a wrapper's size is checked, not only the number of hosts
    size = wrappers.agg(F.sum(F.length("_wrapper") + 200)).first()[0] or 0
    row = "_host string, print bigint, blocks array<struct<node:int,hash:bigint,chars:bigint,links:bigint>>, marks array<int>"
    votes = materialize(per_text(join_checked(own, wrappers, "_host", "inner", size, 1).select("_host", "html", "_wrapper"), row, voter), "page-votes")
    # pages with the same longest texts are copies and count once
    each = votes.groupBy("_host", "print").agg(F.min(F.struct("blocks", "marks")).alias("_")).select("_host", "_.*")
    each = materialize(each, "different-pages")
    counted = materialize(each.groupBy("_host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= MIN_VOTES), "host-pages")
    hosts = counted.count()
    marks = each.select("_host", F.explode("marks").alias("node")).groupBy("_host", "node").agg(F.count("*").alias("pages"))
    marks = marks.groupBy("_host").agg(F.collect_list(F.struct("node", "pages")).alias("marks"))
    at = each.select("_host", F.explode("blocks").alias("b")).groupBy("_host", "b.node", "b.hash").agg(F.count("*").alias("n"), F.sum("b.chars").alias("chars"), F.sum("b.links").alias("links"))
    at = materialize(join_checked(at, counted, "_host", "inner", 120, hosts).withColumn("again", (F.col("n") >= MIN_VOTES) & (F.col("n") >= OFTEN * F.col("pages"))), "blocks")
    recurring = at.filter("again").groupBy("_host").agg(F.collect_list(F.struct("node", "hash", F.col("n").alias("pages"))).alias("recurring"))
    sums = at.filter("NOT again").groupBy("_host", "node").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    sums = sums.groupBy("_host").agg(F.collect_list(F.struct("node", "chars", "links")).alias("sums"))
    known = counted.join(wrappers, "_host").join(sums, "_host", "left").join(marks, "_host", "left").join(recurring, "_host", "left")
    some = [F.coalesce(c, F.array()).alias(c) for c in ("sums", "marks", "recurring")]
    return materialize(known.select("_host", F.struct(F.col("_wrapper").alias("wrapper"), "pages", *some).alias("_known")), "hosts")


def main_text(pages: DataFrame) -> DataFrame:
    """All columns of ``pages`` but html, and text."""
    known = induce(pages)
    size = known.agg(F.sum(F.length("_known.wrapper") + 24 * (F.size("_known.sums") + F.size("_known.recurring")) + 300)).first()[0] or 0
    kept = [f for f in pages.schema.fields if f.name not in ("html", "text")]
    own = pages.select(*[f"`{f.name}`" for f in kept], "html", host_of(F.col("url")).alias("_host"))
    with_host = join_checked(own, known, "_host", "left", size, 1).select(*[f"`{f.name}`" for f in kept], "html", "_host", "_known")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["text string"])
    return per_text(with_host, schema, extractor)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
