"""HTML extraction with a tree-structured graphical model.

A page becomes a tree of its block elements, with a leaf for every block of text. Each node has a
hidden state, content or not. The model is a product of potentials: one per node for what it looks
like (kind of tag, words in class, id and role, length and link share of a text), and one per
parent-child edge. Sum-product message passing, once from the leaves up and once back down, gives
each leaf's exact marginal; texts whose marginal of being content is above one half are kept, in
page order.

Potentials are smoothed frequencies, counted on labelled pages: by default those of
``labelled_pages``, layouts written for this purpose and filled by a fixed rule. Other labelled pages
can be given to ``train``: a node with data-keep="1" or "0" labels itself and what is below it.

Pages are independent, so a page is one row of one map over the table: nothing is shuffled, and the
model is a few hundred numbers. Parsing is one scan for tags, whose open elements are found by name, however deep
they lie; passes are linear in a page's nodes.

Inside a text character references are decoded, white space (a line break element included) becomes
one space, and the ends are trimmed. Scripts, styles, comments, forms' controls and the head's elements
have no text; in scripts and the like "<" opens no tag, the head needs no end tag, and a control, an image or a
template without an end tag swallows nothing. Defined cases: a null or empty page has no text; text outside any element is judged like a
paragraph of the body; unclosed and misplaced tags are closed where a block begins or its parent
ends; a tag cut off at the end of the page is dropped; repeated rows are judged each by itself; a
null page_id or url stays as it is; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm.common import prepare, table

# a quote opens a value only behind "="
_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAME = re.compile(r"[A-Za-z][a-z]*|[0-9]+")
#: Elements whose contents are no text.
_SILENT = {"script", "style", "noscript", "noframes", "noembed", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "select", "button", "title", "audio", "video"}
#: Of these, the elements in which "<" opens no tag: only their own end tag ends them.
_RAW = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in ("script", "style", "noscript", "noframes", "noembed", "iframe", "textarea", "title")}
_SCRIPT = re.compile(r"<!--(?!-?>)|-->|</?script(?=[\s/>]|\Z)", re.I)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Kinds of block elements; other elements are part of the text around them.
_KINDS = {
    "article": "article", "main": "article",
    "nav": "aside", "aside": "aside", "footer": "aside", "menu": "aside", "dialog": "aside", "form": "aside", "fieldset": "aside", "address": "aside",
    "header": "header",
    "ul": "list", "ol": "list", "dl": "list", "li": "item", "dt": "item", "dd": "item",
    "h1": "head", "h2": "head", "h3": "head", "h4": "head", "h5": "head", "h6": "head",
    "p": "text", "pre": "text", "blockquote": "text", "figcaption": "text", "caption": "text",
    "table": "table", "thead": "table", "tbody": "table", "tfoot": "table", "tr": "table", "td": "table", "th": "table",
    "div": "box", "section": "box", "figure": "box", "details": "box", "summary": "box", "center": "box", "hgroup": "box", "body": "body", "html": "body",
}
#: Words in class, id and role that speak against and for content.
_AGAINST = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert warning popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager header masthead topbar footer foot bottom sidebar aside rail widget widgets related recommended recommendations teaser "
    "share sharing social follow comment comments commentlist reply replies respond discussion disqus reader form login signup signin register subscribe subscription newsletter search tags toolbar skip copyright legal "
    "contentinfo complementary dialog".split()
)
_FOR = set("article articlebody content main maincontent post posts entry story body text prose page document".split())


def _look(tokens: list[str]) -> str:
    """What the tokens of class, id and role say: for, against, mixed (both), hint (a word against is only part of a longer token) or none. How much that counts is up to the model."""
    found = set()
    for token in tokens:
        parts = {p.lower() for p in _NAME.findall(token)}
        whole = token.lower() in _AGAINST | _FOR or bool(parts) and (parts <= _AGAINST or parts <= _FOR)
        if parts & _AGAINST:
            found.add("against" if whole else "hint")
        elif parts & _FOR:
            found.add("for")
    if "for" in found:
        return "mixed" if "against" in found else "for"
    return "against" if "against" in found else "hint" if "hint" in found else "none"


@dataclass
class Node:
    """An element, or a leaf with a text."""

    parent: int
    kind: str
    look: str
    label: int | None
    text: list[str] = field(default_factory=list)
    linked: int = 0
    first: str = ""


def _raw_end(html: str, name: str, at: int) -> int:
    """Where the end tag of the raw element ``name`` with contents from ``at`` begins, or the page's end."""
    if name != "script":
        m = _RAW[name].search(html, at)
        return m.start() if m else len(html)
    comment = nested = False
    for m in _SCRIPT.finditer(html, at):
        what = m[0].lower()
        if what == "<!--":
            comment = True
        elif what == "-->":
            comment = nested = False
        elif what == "<script":
            nested = comment
        elif nested:
            nested = False
        else:
            return m.start()
    return len(html)


def parse(html: str) -> list[Node]:
    """The page's tree, parents before children, leaves in page order."""
    nodes = [Node(-1, "body", "none", None)]
    stack: list[tuple[str, int]] = [("", 0)]
    places: dict[str, list[int]] = {}  # of each name's open elements in the stack

    def top(names: tuple[str, ...]) -> int:
        """Place of the innermost open element with one of ``names``, 0 if none is open."""
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def close(k: int) -> None:
        """The element at place ``k`` ends, with all in it."""
        for n, _ in reversed(stack[k:]):
            places[n].pop()
        del stack[k:]

    leaf: Node | None = None
    links = 0
    silent = ""
    depth = 0
    later: dict[str, int] = {}

    def ended(name: str, at: int) -> bool:
        """Whether an end tag of ``name`` follows; where none does, the element swallows nothing."""
        if later.get(name, -1) < at:
            m = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(html, at)
            later[name] = m.start() if m else len(html) + 1
        return later[name] <= len(html)

    def say(raw: str) -> None:
        nonlocal leaf
        if leaf is None:
            if not raw.strip():
                return
            up = stack[-1][1]
            leaf = Node(up, "leaf", nodes[up].kind, None)
            nodes.append(leaf)
        leaf.text.append(raw)
        if links:
            leaf.linked += len(raw)

    at = 0
    while (m := _TAG.search(html, at)) is not None:
        if not silent and m.start() > at:
            say(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        closing = m[1] == "/"
        if name in _RAW and silent not in ("svg", "math"):
            if not closing:
                at = _raw_end(html, name, at)
            continue
        own = m[3].endswith("/") and name in ("svg", "math")  # elsewhere the slash means nothing
        if silent:
            if name == silent and not own:
                depth += -1 if closing else 1
                if depth <= 0 or not ended(name, at):
                    silent = ""
            continue
        if name in _SILENT:
            if not closing and not own and ended(name, at):
                silent, depth = name, 1
            continue
        if name == "br":
            say(" ")
            continue
        if name in _VOID:
            if name == "hr":
                leaf = None
            continue
        kind = _KINDS.get(name)
        if kind is None:
            if name == "a":
                links = 0 if closing else 1
            continue
        leaf, links = None, 0
        if closing:
            if k := top((name,)):
                close(k)
            continue
        # a block ends an open paragraph or heading, an item ends an item of the same list, a cell ends a cell
        if stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
            close(len(stack) - 1)
        ends, stop = (("li",), ("ul", "ol")) if name == "li" else (("dt", "dd"), ("dl",)) if name in ("dt", "dd") else (("td", "th"), ("tr", "table")) if name in ("td", "th") else (("tr",), ("table",)) if name == "tr" else ((), ())
        if ends and (k := top(ends)) > top(stop):
            close(k)
        look, label = "none", None
        if m[3] and not m[3].isspace():
            tokens: list[str] = []
            for a in _ATTRIBUTE.finditer(m[3]):
                key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if key in ("class", "id", "role", "aria-label"):
                    tokens += value.split()
                elif key == "data-keep":
                    label = int(value == "1")
            look = _look(tokens)
        if name in ("body", "html"):
            nodes[0].look = look if look != "none" else nodes[0].look
            continue
        nodes.append(Node(stack[-1][1], kind, look, label))
        places.setdefault(name, []).append(len(stack))
        stack.append((name, len(nodes) - 1))
    if not silent and at < len(html):
        say(html[at:])
    return nodes


def _leaf_look(node: Node, text: str) -> str:
    """Kind of parent, length and link share of a text."""
    n = len(text)
    size = "s" if n < 40 else "m" if n < 160 else "l"
    share = "linked" if 2 * node.linked > n else "plain"
    return f"{node.look}/{size}/{share}"


def block_text(node: Node) -> str:
    return " ".join(references.unescape("".join(node.text)).split())


@dataclass
class Model:
    """Log potentials: of the root, of a child's state given its parent's (by the kinds of both, or the child's kind), and of a look given the state."""

    root: tuple[float, float]
    edge: dict[str, tuple[tuple[float, float], tuple[float, float]]]
    seen: dict[str, tuple[float, float]]

    def marginals(self, nodes: list[Node], looks: list[str]) -> list[float]:
        """Probability of content for each node, by messages up and down the tree."""
        none = ((0.0, 0.0), (0.0, 0.0))
        edge = [self.edge.get(f"{nodes[n.parent].kind}>{n.kind}") or self.edge.get(n.kind, none) for n in nodes]
        up = [list(self.seen.get(x, (0.0, 0.0))) for x in looks]
        sent: list[tuple[float, float]] = [(0.0, 0.0)] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            (a, b), (c, d) = edge[i]
            x, y = up[i]
            message = (_add(x + a, y + b), _add(x + c, y + d))
            sent[i] = message
            p = up[nodes[i].parent]
            p[0] += message[0]
            p[1] += message[1]
        belief = [(0.0, 0.0)] * len(nodes)
        belief[0] = (up[0][0] + self.root[0], up[0][1] + self.root[1])
        for i in range(1, len(nodes)):
            (a, b), (c, d) = edge[i]
            p, s = belief[nodes[i].parent], sent[i]
            x, y = p[0] - s[0], p[1] - s[1]  # the parent's belief without this child
            top = max(x, y)
            x, y = x - top, y - top
            belief[i] = (up[i][0] + _add(x + a, y + c), up[i][1] + _add(x + b, y + d))
        return [1 / (1 + math.exp(min(50.0, max(-50.0, x - y)))) for x, y in belief]


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def _looks(nodes: list[Node], texts: list[str]) -> list[str]:
    return [_leaf_look(n, t) if n.kind == "leaf" else f"{n.kind}:{n.look}" for n, t in zip(nodes, texts)]


def _texts(nodes: list[Node]) -> list[str]:
    return [block_text(n) if n.kind == "leaf" else "" for n in nodes]


def train(pages: list[str], smooth: float = 0.3) -> Model:
    """Smoothed frequencies on labelled pages; a node without a label takes its parent's; an element above all labels is content if it holds some."""
    edges: dict[str, Counter] = {}
    looks: dict[tuple[bool, str], Counter] = {}
    root: Counter = Counter()
    for page in pages:
        nodes = parse(page)
        texts = _texts(nodes)
        state: list[int | None] = [n.label for n in nodes]
        for i, n in enumerate(nodes):
            if state[i] is None and n.parent >= 0:
                state[i] = state[n.parent]
        votes = [[0, 0] for _ in nodes]
        for i in range(len(nodes) - 1, 0, -1):
            if nodes[i].kind == "leaf" and state[i] is not None:
                votes[i][state[i]] += len(texts[i])
            for s in (0, 1):
                votes[nodes[i].parent][s] += votes[i][s]
        final = [s if s is not None else int(v[1] > 0) for s, v in zip(state, votes)]
        root[final[0]] += 1
        for i, (n, look) in enumerate(zip(nodes, _looks(nodes, texts))):
            looks.setdefault((n.kind == "leaf", look), Counter())[final[i]] += 1
            if i:
                for name in (n.kind, f"{nodes[n.parent].kind}>{n.kind}"):
                    edges.setdefault(name, Counter())[(final[n.parent], final[i])] += 1
    total = {(leaf, s): sum(c[s] for (k, _), c in looks.items() if k == leaf) for leaf in (False, True) for s in (0, 1)}
    kinds = {leaf: sum(1 for k, _ in looks if k == leaf) for leaf in (False, True)}
    seen = {look: tuple(math.log((c[s] + smooth) / (total[leaf, s] + smooth * kinds[leaf])) for s in (0, 1)) for (leaf, look), c in looks.items()}
    edge = {k: tuple(tuple(math.log((c[(p, s)] + smooth) / (c[(p, 0)] + c[(p, 1)] + 2 * smooth)) for s in (0, 1)) for p in (0, 1)) for k, c in edges.items()}
    return Model(tuple(math.log((root[s] + smooth) / (len(pages) + 2 * smooth)) for s in (0, 1)), edge, seen)


def labelled_pages() -> list[str]:
    """Layouts with labelled parts, each filled three times: short, mixed and long texts."""
    menu = '<ul><li><a href="#">{w}</a></li><li><a href="#">{w}</a></li><li><a href="#">{w} {w}</a></li><li><a href="#">{w}</a></li></ul>'
    story = "<h1>{t}</h1><p>{x}</p><p>{x}</p><p>{s}</p><p>{x}</p><h2>{t}</h2><p>{x}</p><ul><li>{s}</li><li>{x}</li></ul><p>{s}</p>"
    plain = "<h1>{t}</h1><p>{x}</p><p>{s}</p><p>{x}</p><p>{s}</p>"
    layouts = [
        f'<body><nav data-keep="0">{menu}</nav><div class="ad" data-keep="0">{{x}}</div><article data-keep="1">{story}</article><footer data-keep="0">&copy; {{s}}</footer></body>',
        f'<body><header data-keep="0"><h1>{{w}}</h1><p>{{s}}</p>{menu}</header><main data-keep="1">{plain}</main><aside data-keep="0"><h3>{{w}}</h3><p>{{x}}</p>{menu}</aside><footer data-keep="0"><p>{{x}}</p>{menu}</footer></body>',
        f'<body><div id="cookie-notice" data-keep="0"><p>{{x}}</p><p>{{s}}</p></div><div class="menu" data-keep="0">{menu}</div><div class="content" data-keep="1">{story}<div class="advert" data-keep="0"><p>{{x}}</p></div><p>{{x}}</p></div><div class="comments" data-keep="0"><h3>{{w}}</h3><div><p>{{x}}</p></div><div><p>{{s}}</p></div></div></body>',
        f'<body><div class="topbar" data-keep="0">{{s}}</div><section data-keep="1">{plain}<blockquote><p>{{x}}</p></blockquote></section><section class="comments" data-keep="0"><ol><li><p>{{x}}</p></li><li><p>{{s}}</p></li></ol></section><form class="newsletter" data-keep="0"><p>{{s}}</p><label>{{w}}</label></form></body>',
        f'<body><header data-keep="0"><h1>{{w}} {{w}}</h1></header><div><div class="sidebar" data-keep="0"><h3>{{w}}</h3>{menu}<p>{{s}}</p></div><div data-keep="1">{story}</div></div><div class="footer" data-keep="0"><p>{{s}}</p></div></body>',
        f'<body><nav data-keep="0"><a href="#">{{w}}</a> <a href="#">{{w}}</a></nav><article data-keep="1"><header><h1>{{t}}</h1></header><p>{{x}}</p><table><tr><td>{{s}}</td><td>{{s}}</td></tr></table><p>{{x}}</p><aside data-keep="0"><p>{{x}}</p></aside><p>{{x}}</p><pre>{{s}}</pre></article><div class="related" data-keep="0">{menu}</div></body>',
        f'<body><div class="banner" data-keep="0"><p>{{x}}</p></div><div id="main" data-keep="1"><div class="entry">{plain}</div></div><div class="share social" data-keep="0">{menu}</div><div id="disqus" data-keep="0"><p>{{x}}</p><p>{{x}}</p></div><div class="alert" data-keep="0">{{x}}</div></body>',
        f'<body><header data-keep="0"><h1>{{w}}</h1><p>{{s}}</p></header><nav data-keep="0">{menu}</nav><article data-keep="1"><p>{{s}}</p><p>{{x}}</p></article><div class="sponsored" data-keep="0"><p>{{x}}</p></div><form data-keep="0"><p>{{x}}</p></form><footer data-keep="0">{{x}}<p>{{s}}</p></footer></body>',
        f'<body><header data-keep="0"><h2>{{w}}</h2>{menu}</header><article data-keep="1">{story}<section class="comments" data-keep="0"><h2>{{w}}</h2><article><p>{{x}}</p></article><article><p>{{s}}</p></article></section></article><aside class="widget" data-keep="0">{menu}<p>{{x}}</p></aside></body>',
        f'<body><h1 data-keep="1">{{t}}</h1><p data-keep="1">{{x}}</p><p data-keep="1">{{s}}</p><p data-keep="1">{{x}}</p><div class="nav" data-keep="0">{menu}</div></body>',
        f'<body><header class="masthead" data-keep="0"><h1>{{w}}</h1>{menu}</header><article data-keep="1"><h1>{{t}}</h1>{{x}}<div>{{s}}</div>{{s}}<div><div>{{x}}</div><div>{{s}}</div></div><section><h2>{{t}}</h2><div>{{x}}</div></section><figure><figcaption>{{s}}</figcaption></figure></article><footer data-keep="0"><div>{{s}}</div></footer></body>',
        f'<body><div class="header" data-keep="0"><div>{{w}}</div><div>{{s}}</div></div><div class="post" data-keep="1"><h1>{{t}}</h1><div>{{x}}</div><div>{{x}}</div><dl><dt>{{w}}</dt><dd>{{s}}</dd></dl><table><tr><th>{{w}}</th><td>{{s}}</td></tr></table></div><div class="tags" data-keep="0">{menu}</div><div class="copyright" data-keep="0">{{s}}</div></body>',
        f'<body><nav class="breadcrumb" data-keep="0"><ol><li><a href="#">{{w}}</a></li><li><a href="#">{{w}}</a></li></ol></nav><main><article data-keep="1"><header><h1>{{t}}</h1><p>{{s}}</p></header><section><p>{{x}}</p><blockquote>{{s}}</blockquote><ol><li>{{s}}</li><li>{{x}}</li></ol></section><div class="share" data-keep="0"><a href="#">{{w}}</a></div></article><aside class="related" data-keep="0"><h2>{{w}}</h2>{menu}</aside></main></body>',
        f'<body><div class="popup overlay" data-keep="0"><h2>{{t}}</h2><p>{{x}}</p></div><article class="story" data-keep="1"><p>{{x}}</p><div><p>{{s}}</p></div><div>{{s}}</div><details><summary>{{s}}</summary><p>{{x}}</p></details><div class="promo" data-keep="0">{{s}}</div></article><div class="pagination" data-keep="0"><a href="#">{{w}}</a><a href="#">{{w}}</a></div></body>',
        f'<body>{menu.replace("<ul>", '<ul data-keep="0">')}<article data-keep="1"><h2>{{t}}</h2><div>{{s}}</div><p>{{x}}</p></article><div id="comments" data-keep="0"><div class="comment"><div>{{w}}</div><div>{{x}}</div></div><form><p>{{s}}</p></form></div><aside data-keep="0"><div>{{x}}</div><div>{{s}}</div></aside></body>',
    ]
    # classes whose words mislead: layout hints on content and on what is around it
    layouts += [
        f'<body class="has-sidebar"><header class="site-header" data-keep="0"><h1>{{w}}</h1>{menu}</header><article class="bottom-margin" data-keep="1">{story}</article><div class="left-sidebar" data-keep="0">{menu}<p>{{s}}</p></div><footer class="page-footer" data-keep="0"><p>{{s}}</p></footer></body>',
        f'<body><div class="top-nav" data-keep="0">{menu}</div><div class="tag-news post tags" data-keep="1">{plain}</div><div class="post-comments" data-keep="0"><div><p>{{x}}</p></div><div><p>{{s}}</p></div></div><div class="site-footer" data-keep="0">{{s}}</div></body>',
        f'<body><div class="menu main" data-keep="0">{menu}</div><div class="footer-margin wide" data-keep="1">{story}</div><div class="sidebar content" data-keep="0"><h3>{{w}}</h3>{menu}<p>{{s}}</p></div></body>',
        f'<body><nav class="main" data-keep="0">{menu}</nav><section class="share-enabled" data-keep="1">{plain}<div class="ad-slot-1" data-keep="0"><p>{{x}}</p></div><p>{{x}}</p></section><div class="cookie-bar-wrapper" data-keep="0"><p>{{s}}</p></div></body>',
        f'<body><main class="comment-enabled search-result-body" data-keep="1">{plain}</main><article class="content notice post" data-keep="1"><p>{{x}}</p><p>{{s}}</p></article><div class="comment-box-1" data-keep="0"><p>{{x}}</p></div></body>',
    ]
    words = ["ale", "borin", "cast", "doremi", "ente", "fal", "gorum", "hin", "isolde", "jun"]
    out = []
    for k, layout in enumerate(layouts):
        for size in (3, 18, 70):
            count = 0

            def fill(m: re.Match, k: int = k, size: int = size) -> str:
                nonlocal count
                count += 1
                n = {"w": 1, "t": 6, "s": 4, "x": size + count % 5}[m[1]]
                text = " ".join(words[(k + 3 * count + i * i) % len(words)] for i in range(n))
                return text if m[1] == "w" else text.capitalize() + ("." if m[1] in "sx" else "")

            out.append(re.sub(r"\{([wtsx])\}", fill, layout))
    return out


def extract(html: str, model: Model) -> str:
    """The main text of one page."""
    nodes = parse(html)
    texts = _texts(nodes)
    chance = model.marginals(nodes, _looks(nodes, texts))
    return "\n".join(t for t, p in zip(texts, chance) if t and p > 0.5)


def extract_pages(spark: SparkSession, pages: DataFrame, model: Model | None = None) -> DataFrame:
    """Per page row: page_id, url, text, n_chars."""
    prepare(spark)
    model = model or train(labelled_pages())
    kind = dict(pages.dtypes)["page_id"]

    def run(batches):
        for batch in batches:
            texts = [extract(h.as_py() or "", model) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark, table(spark, sf_dir, "pages"))
