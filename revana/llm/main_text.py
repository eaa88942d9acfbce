"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks, the text between two block-level tags. What is known of
a block's elements (their kind, role, class and id) and a classifier of its form
(length, share of links, kind of element, place, ...) give its cost of being
boilerplate or content. The costs are the capacities from the source and to the
sink of a graph whose nodes are the blocks; neighbours in the page and the next
block of the same parent are joined by edges, the weaker the further apart they
are in the document tree. The minimum cut is the cheapest labelling, in which a
block of unclear form goes with those around it.

The classifier is a naive Bayes model over binned features. It learns from the
blocks of all pages whose elements say what they are, in one aggregation of a
few hundred counts, and helps where they don't.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revana.llm.common import field, slices

# ---- fixed values: elements and names ------------------------------------------

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IN_HEAD = frozenset("head base link meta noscript".split())
# Their content is not text of the page.
RAW = frozenset("script style title textarea xmp iframe noembed noframes template svg math object canvas".split())
BLOCK = frozenset("""address article aside blockquote body head button caption center dd details dialog dir div dl dt
    fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav
    noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul""".split())
ENDS_PARAGRAPH = BLOCK - frozenset("button label option optgroup select noscript caption td th tr tbody thead tfoot".split())
# What the start of an element ends, and the elements beyond which it does not look.
ENDS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"),
        "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
        "tbody": ("tbody thead tfoot", "table"), "tfoot": ("tbody thead", "table"),
        "option": ("option", "select"), "optgroup": ("optgroup", "select")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
CELLS = frozenset("td th caption table button".split())

BOILERPLATE_TAGS = frozenset("""head nav footer aside header form button select option optgroup label legend fieldset
    dialog menu noscript search""".split())
BOILERPLATE_ROLES = frozenset("""navigation banner contentinfo complementary search dialog alertdialog alert form
    menu menubar toolbar""".split())
BOILERPLATE_NAMES = frozenset("""ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors
    promo promotion promoted banner masthead header topbar footer nav navbar navigation menu breadcrumb breadcrumbs
    sidebar rail widget widgets related recommended recommendations trending popular cookie cookies consent gdpr
    notice notices popup modal overlay paywall newsletter subscribe subscription signup login share sharing social
    pagination pager toolbar search form copyright skip hidden""".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus respond replies reply discussion".split())
CONTENT_NAMES = frozenset("article content post entry story main body text prose".split())
CONTENT_ROLES = frozenset("main article".split())

# ---- costs, in nats -------------------------------------------------------------

KNOWN = 8.0             # an element names a block as content or boilerplate
WITHIN_MAIN = 2.0       # in the main element, but not in an article it holds
NAMED = 3.0             # a class or id names content
OUTSIDE = -2.0          # the page has an article or main element elsewhere
MOST_OF_ONE, MOST_OF_ALL = 1.5, 4.0     # what features can say
BESIDE, SAME_PARENT = 1.0, 0.5          # edges
FAR = 0.8               # an edge's weight goes down by this for each step in the tree
SCALE = 1000            # capacities are whole numbers

_TAG = re.compile(r"""<([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_PLAIN_TAG = re.compile(r"<([a-zA-Z][^\s/>]*)([^>]*)>")
_END = re.compile(r"</([a-zA-Z][^\s/>]*)[^>]*>")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|\b(hidden)\b""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}


class Page:
    """Blocks of a page and the tree of its elements."""

    def __init__(self, html: str):
        self.tags, self.parents, self.depths, self.evidence = ["html"], [-1], [0], [0]
        self.texts: list[str] = []
        self.owners: list[int] = []         # innermost block-level element
        self.linked: list[int] = []         # characters within links
        self._stack, self._block_stack, self._open = [0], [0], Counter(["html"])
        self._text: list[str] = []
        self._links = 0
        self._read(html)
        self._flush()

    # -- reading --

    def _read(self, html: str) -> None:
        at, tag = 0, _TAG
        while True:
            low = html.find("<", at)
            if low < 0:
                return self._say(html[at:])
            self._say(html[at:low])
            after = html[low + 1:low + 2]
            if html.startswith("<!--", low):
                end = html.find("-->", low + 4)
                if end < 0:
                    return
                at = end + 3
            elif after in ("!", "?"):
                end = html.find(">", low)
                if end < 0:
                    return
                at = end + 1
            elif after == "/":
                found = _END.match(html, low)
                if found:
                    self._end(found[1].lower())
                    at = found.end()
                else:
                    end = html.find(">", low)       # </ and no name is a comment
                    if end < 0:
                        return
                    at = end + 1
            elif after.isascii() and after.isalpha():
                found = tag.match(html, low)
                if not found and tag is _TAG:
                    tag = _PLAIN_TAG                # a quote is never closed: quotes mean nothing from here on
                    found = tag.match(html, low)
                if not found:
                    return
                at = found.end()
                name = found[1].lower()
                if name in RAW:
                    if not found[2].endswith("/"):
                        closed = _RAW_END[name].search(html, at)
                        if not closed:
                            return
                        at = closed.end()
                else:
                    self._start(name, found[2])
            else:
                self._say("<")
                at = low + 1

    def _say(self, text: str) -> None:
        if text:
            if "&" in text:
                text = unescape(text)
            self._text.append(text)
            if self._open["a"]:
                self._links += len(text)

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.texts.append(text)
                self.owners.append(self._block_stack[-1])
                self.linked.append(min(self._links, len(text)))
            self._text.clear()
        self._links = 0

    # -- the tree --

    def _start(self, name: str, attributes: str) -> None:
        if self._open["head"] and name not in IN_HEAD:      # its end may be left out
            self._end("head")
        if name == "br":
            self._text.append(" ")
            return
        if name in VOID:
            if name == "hr":
                self._flush()
            return
        if name in ("html", "body", "head") and self._open[name] or name == "head" and self._open["body"]:
            return
        if name in ENDS_PARAGRAPH and self._open["p"]:
            self._end_one(("p",), ("button",))
        if name in ENDS:
            self._end_one(*ENDS[name])
        evidence = element_evidence(name, attributes)
        node = len(self.tags)
        self.tags.append(name)
        self.parents.append(self._stack[-1])
        self.depths.append(self.depths[self._stack[-1]] + 1)
        self.evidence.append(evidence)
        if name in BLOCK or evidence:
            self._flush()
            self._block_stack.append(node)
        self._stack.append(node)
        self._open[name] += 1

    def _end_one(self, names, beyond) -> None:
        for i in range(len(self._stack) - 1, 0, -1):
            tag = self.tags[self._stack[i]]
            if tag in names:
                return self._pop_to(i)
            if tag in beyond:
                return None

    def _pop_to(self, i: int) -> None:
        for node in self._stack[i:]:
            self._open[self.tags[node]] -= 1
        first = self._stack[i]
        del self._stack[i:]
        if self._block_stack[-1] >= first:
            self._flush()
            while self._block_stack[-1] >= first:
                self._block_stack.pop()

    def _end(self, name: str) -> None:
        if not self._open[name] or name in ("html", "body"):
            if name == "p":
                self._flush()
            return
        inline = name not in BLOCK
        for i in range(len(self._stack) - 1, 0, -1):
            node = self._stack[i]
            if self.tags[node] == name:
                if inline and self._block_stack[-1] > node:     # blocks in it go on
                    self._open[name] -= 1
                    del self._stack[i]
                    if node in self._block_stack:
                        self._flush()
                        self._block_stack.remove(node)
                else:
                    self._pop_to(i)
                return
            if self.tags[node] in CELLS and name not in CELLS and name not in ENDS:
                return


def element_evidence(name: str, attributes: str) -> int:
    """Of one element: -2 comments, -1 other boilerplate, 1 named content,
    2 main, 3 article, 0 nothing."""
    names: set[str] = set()
    role = hidden = ""
    if attributes and attributes != "/":
        for key, value, bare in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id"):
                names |= {w.lower() for w in _NAME.findall(value)}
            elif key == "role":
                role = value.lower()
            elif bare or key == "hidden" or key == "aria-hidden" and value.lower() == "true" \
                    or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                hidden = "hidden"
    if name in ("html", "body"):
        return 0
    if names & COMMENT_NAMES:
        return -2
    if hidden:
        return -1
    if name == "article" or role == "article":
        return 3
    if name == "main" or role == "main":
        return 2
    if name in BOILERPLATE_TAGS or role in BOILERPLATE_ROLES:
        return -1
    bad, good = bool(names & BOILERPLATE_NAMES), bool(names & CONTENT_NAMES)
    return 0 if bad == good else -1 if bad else 1


def known_costs(page: Page) -> tuple[list[float], list[bool]]:
    """What the elements around each block say, positive for content, and whether
    they name it outright.

    Boilerplate around an article or main element (a form around a whole page)
    means nothing, comments do. A heading in the header of an article is content.
    """
    tags, parents, evidence = page.tags, page.parents, page.evidence
    holds = [False] * len(tags)         # an article or main element
    for node in range(len(tags) - 1, 0, -1):
        if holds[node] or evidence[node] >= 2:
            holds[parents[node]] = True
    # State of a node from that of its parent: -1 boilerplate, 0 nothing, 1 named content, 2 main, 3 article.
    state, article_header = [0] * len(tags), [False] * len(tags)
    for node in range(1, len(tags)):
        above, own = state[parents[node]], evidence[node]
        article_header[node] = article_header[parents[node]]
        if own == -2 or above == -2:
            state[node] = -2
        elif article_header[node] and tags[node] in ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"):
            state[node], article_header[node] = 3, False
        elif above == -1:
            state[node] = -1
        elif own == -1 and not holds[node]:
            state[node] = -1
            article_header[node] = tags[node] == "header" and above == 3
        else:
            state[node] = max(above, own)
    has_article = any(s == 3 for s in state)
    has_main = has_article or any(s == 2 for s in state)
    costs, certain = [], []
    for owner in page.owners:
        s = state[owner]
        cost = (-KNOWN if s < 0 else KNOWN if s == 3 or s == 2 and not has_article else WITHIN_MAIN if s == 2
                else NAMED if s == 1 and not has_main else OUTSIDE if has_main else 0.0)
        costs.append(cost)
        certain.append(abs(cost) == KNOWN)
    return costs, certain


def features(page: Page) -> list[tuple]:
    """Bins of each block's form, one value per feature."""
    sizes = [len(t) for t in page.texts]
    total, before, out = sum(sizes) or 1, 0, []
    alike = Counter((page.parents[o], page.tags[o]) for o in page.owners)
    for text, owner, linked, size in zip(page.texts, page.owners, page.linked, sizes):
        tag = page.tags[owner]
        out.append((min(text.count(" ") + 1, 255).bit_length(), math.ceil(4 * linked / size),
                    "h" if tag[0] == "h" and tag[1:].isdigit() else tag if tag in BLOCK else "inline",
                    text[-1] in ".!?:;\"'…”’»。！？", 5 * before // total,
                    min(alike[page.parents[owner], tag], 31).bit_length()))
        before += size
    return out


FEATURES = 6

# ---- the cut --------------------------------------------------------------------


def edges(page: Page) -> list[tuple[int, int, int]]:
    """(block, later block, capacity)."""
    def steps(a: int, b: int) -> int:
        n = 0
        while a != b and n < 24:
            if a > b:                   # a node is numbered after its parent
                a = page.parents[a]
            else:
                b = page.parents[b]
            n += 1
        return n

    owners, last, found = page.owners, {}, []
    for i, owner in enumerate(owners):
        if i:
            found.append((i - 1, i, max(1, round(SCALE * BESIDE * FAR ** steps(owners[i - 1], owner)))))
        parent = page.parents[owner]
        if (j := last.get(parent, -1)) >= 0:
            found.append((j, i, round(SCALE * SAME_PARENT)))
        last[parent] = i
    return found


def minimum_cut(costs: list[int], joined: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes lie on the source's side of a minimum cut, as many as can.

    ``costs`` are capacities from the source if positive, to the sink if not;
    ``joined`` has undirected edges. A node whose own capacity outweighs its edges
    is certain and hands them to its neighbours as capacities; what is left
    after that is solved by augmenting shortest paths in phases.
    """
    n = len(costs)
    net, around = list(costs), [dict() for _ in range(n)]
    for a, b, capacity in joined:
        around[a][b] = around[a].get(b, 0) + capacity
        around[b][a] = around[b].get(a, 0) + capacity
    load = [sum(e.values()) for e in around]
    side: list[bool | None] = [None] * n
    ready = deque(range(n))
    while ready:
        v = ready.popleft()
        if side[v] is not None or not (net[v] >= load[v] or -net[v] > load[v]):
            continue
        side[v] = net[v] >= load[v]
        for u, capacity in around[v].items():
            if side[u] is None:
                net[u] += capacity if side[v] else -capacity
                load[u] -= capacity
                ready.append(u)
    open_ = [v for v in range(n) if side[v] is None]
    if open_:
        number = {v: i for i, v in enumerate(open_)}
        rest = [(number[v], number[u], c) for v in open_ for u, c in around[v].items() if v < u and u in number]
        for v, s in zip(open_, _flow_side([net[v] for v in open_], rest)):
            side[v] = s
    return side


def _flow_side(net: list[int], joined: list[tuple[int, int, int]]) -> list[bool]:
    """``minimum_cut`` by maximum flow: blocking flows on layered graphs."""
    n = len(net)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to, room = [], []

    def join(a: int, b: int, forth: int, back: int) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(forth)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for v, c in enumerate(net):
        if c > 0:
            join(source, v, c, 0)
        elif c < 0:
            join(v, sink, -c, 0)
    for a, b, c in joined:
        join(a, b, c, c)

    def layers(start: int, forward: bool) -> list[int]:
        level = [-1] * (n + 2)
        level[start] = 0
        queue = deque([start])
        while queue:
            v = queue.popleft()
            for e in head[v]:
                if level[to[e]] < 0 and room[e if forward else e ^ 1] > 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        return level

    while True:
        level = layers(source, True)
        if level[sink] < 0:
            break
        at, path, v = [0] * (n + 2), [], source
        while True:
            if v == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                full = next(i for i, e in enumerate(path) if room[e] == 0)
                v = to[path[full] ^ 1]
                del path[full:]
                continue
            while at[v] < len(head[v]):
                e = head[v][at[v]]
                if room[e] > 0 and level[to[e]] == level[v] + 1:
                    path.append(e)
                    v = to[e]
                    break
                at[v] += 1
            else:
                if v == source:
                    break
                v = to[path.pop() ^ 1]
                at[v] += 1
    # All that cannot reach the sink any more.
    return [d < 0 for d in layers(sink, False)[:n]]


# ---- the operator ----------------------------------------------------------------

Model = dict[tuple[int, str], float]


def form_costs(page: Page, model: Model) -> list[float]:
    return [max(-MOST_OF_ALL, min(MOST_OF_ALL, sum(model.get((k, str(v)), 0.0) for k, v in enumerate(row))))
            for row in features(page)]


def label_blocks(page: Page, model: Model) -> list[bool]:
    """True for content."""
    known, _ = known_costs(page)
    costs = [round(SCALE * (a + b)) for a, b in zip(known, form_costs(page, model))]
    return minimum_cut(costs, edges(page))


def train(pages: DataFrame, html_col: str = "html") -> Model:
    """Log odds of content for each bin of each feature, from the blocks of all
    ``pages`` that their elements name. The counts of a task are summed in it; a
    few hundred numbers reach the driver, whatever the corpus. An empty table, or one
    without named blocks, gives an empty model, which says nothing."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches, html_col):
            for html in field(batch, html_col).to_pylist():
                if html:
                    page = Page(html)
                    known, certain = known_costs(page)
                    for row, cost, sure in zip(features(page), known, certain):
                        if sure:
                            counts.update((k, str(v), cost > 0) for k, v in enumerate(row))
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()),
             pa.array([k[2] for k in keys], pa.bool_()), pa.array([counts[k] for k in keys], pa.int64())],
            ["feature", "bin", "content", "n"])

    rows = (pages.select(html_col).mapInArrow(count, "feature int, bin string, content boolean, n long")
            .groupBy("feature", "bin").agg(F.sum(F.when(F.col("content"), F.col("n")).otherwise(0)).alias("yes"),
                                           F.sum(F.when(F.col("content"), 0).otherwise(F.col("n"))).alias("no")).collect())
    yes, no = (sum(r[c] for r in rows if r.feature == 0) for c in ("yes", "no"))
    if not yes or not no:
        return {}
    odds = lambda r: math.log((r.yes + 1) / (yes + 2)) - math.log((r.no + 1) / (no + 2))
    return {(r.feature, r.bin): max(-MOST_OF_ONE, min(MOST_OF_ONE, odds(r))) for r in rows}


def extract_main_text(pages: DataFrame, model: Model, keep: list[str], html_col: str = "html") -> DataFrame:
    """(*keep, text, n_blocks, n_content) per row of ``pages``: the blocks of content
    in page order, white space turned into one blank, joined by one blank.

    Null and empty pages, and pages without text, give an empty text and no
    blocks. Broken markup (tags never closed, ended in another order, cut off)
    is read as browsers do, comments and tags that never end take the rest of the page.
    Rows that repeat each get a row, an empty table gives an empty one; columns
    not in ``keep`` are ignored. Pages are read whole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html_col):
            texts, blocks, content = [], [], []
            for html in field(batch, html_col).to_pylist():
                page = Page(html or "")
                kept = [t for t, is_content in zip(page.texts, label_blocks(page, model)) if is_content]
                texts.append(" ".join(kept).encode("utf-8", "replace").decode())
                blocks.append(len(page.texts))
                content.append(len(kept))
            yield pa.RecordBatch.from_arrays(
                [*(field(batch, c) for c in keep), pa.array(texts, pa.string()), pa.array(blocks, pa.int64()),
                 pa.array(content, pa.int64())], [*keep, "text", "n_blocks", "n_content"])

    chosen = pages.select(*keep, html_col)
    schema = (chosen.select(*keep).schema.add("text", "string").add("n_blocks", "long").add("n_content", "long"))
    return chosen.mapInArrow(run, schema)
