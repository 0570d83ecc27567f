"""Main-text extraction by a tree-structured graphical model over the DOM.

Every block element and every block of text is a node with a hidden label, content or boilerplate. Its
own features (tag, words in class, id and role, length, share of link text, sentence ends, and for an
element those of all its text) give its unary potential; a parent and a child are tied by a pairwise potential that depends on the kind of
child. Sum-product messages go up to the root and down again, which is exact on a tree, and the blocks
of text with a content marginal above one half are kept.

Pair potentials are smoothed counts over labelled pages, unary ones the weights of a logistic regression. The tables carry no labels for pages, so the
labelled pages come from ``labelled_pages``: five kinds of layout (``LAYOUTS``: sections by their own
elements, by telling names, by either, by nothing but plain ``div`` elements, and by table cells) with
known main text, a documented bounded number drawn by a fixed seed. Any other labelled pages can be
given to ``train`` instead.

Scripts, styles, comments and form controls never become text, nor do drawings; formulas do. White space inside a block turns into one
space; blocks are joined by a line feed in page order; character references are decoded. Null and empty
pages give an empty text. Broken markup is read as browsers would: an open paragraph or list item ends
where the next begins, unmatched end tags are ignored, open elements end with the page. Repeated rows each give a
row; extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose text is never page text.
SILENT = frozenset("head title script style noscript template iframe object svg annotation annotation-xml canvas select option textarea button audio video map".split())
#: Roots of foreign markup, in which a closing slash ends an element.
FOREIGN = frozenset({"svg", "math"})
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that an open one of the same group ends at.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
REGIONS = frozenset("article aside footer form header main nav section dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class, id and role by what they tell.
HINTS = {
    "menu": "nav navbar menu breadcrumb breadcrumbs toc pagination pager tabs",
    "head": "header masthead topbar banner logo branding",
    "foot": "footer copyright legal colophon",
    "side": "sidebar aside widget related recommended trending popular rail complementary",
    "ad": "ad ads adv advert advertisement sponsor sponsored promo promotion teaser",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall",
    "talk": "comment comments reply replies discussion disqus respond feedback reviews",
    "form": "form login search searchbox contact",
    "share": "share social sharing follow tags meta byline",
    "main": "article content main post entry story body text page",
}
_HINT_OF = {w: k for k, words in HINTS.items() for w in words.split()}
#: Those long enough to tell inside a longer word, as in commentlist or hentry; the longest first.
_STEMS = sorted((w for w in _HINT_OF if len(w) >= 5), key=lambda w: (-len(w), w))


@lru_cache(10_000)
def hint_of(word: str) -> str | None:
    """What a word of a class, id or role tells: itself, or the longest known word that it begins or ends with."""
    whole = _HINT_OF.get(word)
    return whole or next((_HINT_OF[s] for s in _STEMS if word.startswith(s) or word.endswith(s)), None)


_NOTE = re.compile(r"©|\(c\) ?\d{4}|all rights reserved|cookie|subscribe|newsletter|sign up|log ?in|privacy policy|terms of|advertisement|sponsored", re.I)
CONTENT, BOILERPLATE = 0, 1


class _Tree(HTMLParser):
    """Nodes as parallel lists: parent, tag, hints; texts only for blocks of text, whose tag is #text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.hints, self.text, self.links = [-1], ["#root"], [()], [None], [0]
        self.stack: list[tuple[str, int]] = []  # open elements: tag and node (of the nearest block for inline ones)
        self.silent = self.anchors = 0
        self.run: list[str] = []
        self.run_links = 0

    def _at(self) -> int:
        return self.stack[-1][1] if self.stack else 0

    def _node(self, tag: str, hints: tuple, text: str | None = None, links: int = 0) -> int:
        self.parent.append(self._at())
        self.tag.append(tag)
        self.hints.append(hints)
        self.text.append(text)
        self.links.append(links)
        return len(self.tag) - 1

    def flush(self) -> None:
        if self.run:
            text = " ".join("".join(self.run).split())
            if text:
                self._node("#text", (), text, self.run_links)
            self.run, self.run_links = [], 0

    def _pop(self, size: int) -> None:
        if any(t in BLOCKS for t, _ in self.stack[size:]):
            self.flush()
        for t, _ in self.stack[size:]:
            self.silent -= t in SILENT
            self.anchors -= t == "a"
        del self.stack[size:]

    def _close(self, tags: Iterable[str], scope: Iterable[str]) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in tags:
                self._pop(i)
                return
            if self.stack[i][0] in scope:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in FOREIGN and (self.get_starttag_text() or "").endswith("/>"):
            return  # <svg width=1/> is meant to end here, though the slash belongs to the value
        if tag == "br" or tag == "hr":
            self.run.append(" ")
            if tag == "hr":
                self.flush()
            return
        if tag in VOID:
            return
        if tag in CLOSED_BY:
            self._close(CLOSED_BY[tag], SCOPES.get(tag, ()))
        if tag == "body":
            self._close(("head",), ())
        if tag in BLOCKS:
            self._close(("p",), ("table", "td", "th", "li", "article", "section", "div", "blockquote", "body"))
            if tag in HEADINGS:
                self._close(HEADINGS, ("div", "section", "article", "body"))
            self.flush()
            words = []
            for name, value in attrs:
                if name in ("class", "id", "role", "aria-label", "itemprop") and value:
                    words += re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
            self.stack.append((tag, self._node(tag, tuple(sorted({h for w in words if (h := hint_of(w))})))))
        else:
            self.stack.append((tag, self._at()))
            self.anchors += tag == "a"
        self.silent += tag in SILENT

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        # Elsewhere browsers do not heed the slash.
        if tag not in FOREIGN and not any(t in FOREIGN for t, _ in self.stack):
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._pop(i)
                return
            if tag not in BLOCKS and self.stack[i][0] in BLOCKS:
                return  # an inline end tag does not end a block

    def collapse(self) -> None:
        """Takes out elements that tell nothing and hold one other element alone: a chain of them would wear the messages out."""
        n = len(self.tag)
        children = [0] * n
        only = [0] * n
        for i in range(1, n):
            children[self.parent[i]] += 1
            only[self.parent[i]] = i
        gone = [i > 0 and self.text[i] is None and not self.hints[i] and self.tag[i] not in REGIONS and self.tag[i] not in FRAME and children[i] == 1 and self.text[only[i]] is None for i in range(n)]
        if not any(gone):
            return
        place, at, up = [0] * n, [], 0
        for i in range(n):
            up = self.parent[i]
            # A parent that is gone hands its own place on; parents come first.
            place[i] = place[up] if gone[i] else len(at)
            if not gone[i]:
                at.append(i)
        self.parent = [-1 if i == 0 else place[self.parent[i]] for i in at]
        self.tag, self.hints, self.text, self.links = ([x[i] for i in at] for x in (self.tag, self.hints, self.text, self.links))

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.run.append(data)
            if self.anchors:
                self.run_links += len(data.strip())


def parse(page: str | None) -> _Tree:
    tree = _Tree()
    tree.feed(page or "")
    tree.close()
    tree._pop(0)
    tree.flush()
    tree.collapse()
    return tree


class _Below:
    """Words, characters, characters of links, and blocks of text with and without a sentence end below every element; and the zone that each node stands in, by the nearest element that tells."""

    def __init__(self, tree: _Tree) -> None:
        n = len(tree.tag)
        self.words, self.chars, self.links, self.stops, self.blocks = ([0] * n for _ in range(5))
        self.zone = ["none"] * n
        for i in range(1, n):
            hints, tag = tree.hints[i], tree.tag[i]
            own = next((h for h in hints if h != "main"), None) or ("main" if hints or tag in ("article", "main") else tag if tag in REGIONS else None)
            self.zone[i] = own or self.zone[tree.parent[i]]
        for i in range(n - 1, 0, -1):
            text, p = tree.text[i], tree.parent[i]
            if text is not None:
                self.words[i], self.chars[i], self.links[i] = len(text.split()), len(text), tree.links[i]
                self.stops[i], self.blocks[i] = int(_stops(text)), 1
            self.words[p] += self.words[i]
            self.chars[p] += self.chars[i]
            self.links[p] += self.links[i]
            self.stops[p] += self.stops[i]
            self.blocks[p] += self.blocks[i]


def _stops(text: str) -> bool:
    return text[-1] in ".!?…\"”»"


def _share(part: int, whole: int) -> int:
    return 0 if not part else 1 if part < 0.4 * whole else 2 if part < 0.8 * whole else 3


def node_features(tree: _Tree, i: int, below: _Below) -> list[str]:
    tag = tree.tag[i]
    links = _share(below.links[i], below.chars[i])
    if tag != "#text":
        hints = tree.hints[i] or ("none",)
        own = ["element", "tag=" + tag, *("hint=" + h for h in hints)]
        if below.blocks[i] < 2:
            return own  # a single block speaks for itself
        size = min(9, int(math.log2(below.words[i] + 1)))
        # Where all is links, the place tells a reading list from a menu.
        return [*own, f"below={size}", f"linked={links}", f"stops={_share(below.stops[i], below.blocks[i])}", *([f"linked-in={below.zone[i]}"] if links == 3 else ())]
    text = tree.text[i]
    out = ["text", "in=" + tree.tag[tree.parent[i]], f"words={min(6, int(math.log2(below.words[i])))}", f"links={links}"]
    out.append("end=" + ("stop" if _stops(text) else "none"))
    if links == 3:
        out.append(f"link-in={below.zone[i]}")
    if tree.tag[tree.parent[i]] in HEADINGS:
        out.append(f"heading-in={below.zone[i]}")
    if below.words[i] < 40 and _NOTE.search(text):
        out.append("note")
    return out


#: Elements that hold both content and boilerplate; their own label tells little about their children's.
FRAME = frozenset({"#root", "html", "body"})
KINDS = ("frame", "text", "region", "plain", "top-text", "top-region", "top-plain")


def child_kind(tree: _Tree, i: int) -> str:
    tag = tree.tag[i]
    if tag in FRAME:
        return "frame"
    kind = "text" if tag == "#text" else "region" if tag in REGIONS or tree.hints[i] else "plain"
    return "top-" + kind if tree.tag[tree.parent[i]] in FRAME else kind


class Model:
    """Log potentials: unary[feature] and pair[kind] as tables over the labels, root as a pair."""

    def __init__(self, unary: dict[str, tuple[float, float]], pair: dict[str, list[list[float]]], root: tuple[float, float]):
        self.unary, self.pair, self.root = unary, pair, root

    def marginals(self, tree: _Tree) -> list[float]:
        """Probability of content for every node. Parents come before their children in the lists."""
        n = len(tree.tag)
        # A page of n nodes costs O(n): one message up and one down per edge.
        own = [[0.0, 0.0] for _ in range(n)]
        kinds, below = [""] * n, _Below(tree)
        own[0] = list(self.root)
        for i in range(1, n):
            kinds[i] = child_kind(tree, i)
            for f in node_features(tree, i, below):
                u = self.unary.get(f)
                if u:
                    own[i][0] += u[0]
                    own[i][1] += u[1]
        up = [[0.0, 0.0]] * n
        for i in range(n - 1, 0, -1):
            t, b = self.pair[kinds[i]], own[i]
            message = [_add(t[y][0] + b[0], t[y][1] + b[1]) for y in (0, 1)]
            up[i] = message
            p = own[tree.parent[i]]
            p[0] += message[0]
            p[1] += message[1]
        # own[i] now holds the beliefs of i's subtree; the way down adds what comes from above.
        down = [own[0]] * n
        out = [0.0] * n
        for i in range(n):
            if i:
                above, t, mine = down[tree.parent[i]], self.pair[kinds[i]], up[i]
                rest = (above[0] - mine[0], above[1] - mine[1])
                down[i] = [own[i][x] + _add(rest[0] + t[0][x], rest[1] + t[1][x]) for x in (0, 1)]
            out[i] = 1 / (1 + math.exp(min(700.0, down[i][1] - down[i][0])))
        return out


def _add(a: float, b: float) -> float:
    m = max(a, b)
    return m + math.log1p(math.exp(-abs(a - b)))


def train(pages: Iterable[tuple[str, set[str]]], smooth: float = 0.5) -> Model:
    """From (html, its content blocks): a text node is content if it is one of them, an element if most of its text is.

    Pair potentials are smoothed counts. Unary ones are weights of a logistic regression of the labels on the
    features, less the labels' prior odds, which the pairs already hold.
    """
    pairs, root = Counter(), Counter()
    seen: dict[str, list[tuple[list[str], int]]] = {"text": [], "element": []}
    for page, content in pages:
        tree = parse(page)
        n, below = len(tree.tag), _Below(tree)
        weight = [[0, 0] for _ in range(n)]
        for i in range(n - 1, 0, -1):
            if tree.tag[i] == "#text":
                weight[i][CONTENT if tree.text[i] in content else BOILERPLATE] = len(tree.text[i])
            for y in (0, 1):
                weight[tree.parent[i]][y] += weight[i][y]
        label = [CONTENT if w[0] > w[1] else BOILERPLATE for w in weight]
        root[label[0]] += 1
        for i in range(1, n):
            pairs[child_kind(tree, i), label[tree.parent[i]], label[i]] += 1
            features = node_features(tree, i, below)
            seen[features[0]].append((features, label[i]))
    unary: dict[str, tuple[float, float]] = {}
    for kind, rows in seen.items():
        for f, w in _logistic(rows, kind).items():
            unary[f] = (w / 2, -w / 2)
    pair = {}
    for kind in KINDS:
        counts = [[pairs[kind, y, x] + smooth for x in (0, 1)] for y in (0, 1)]
        pair[kind] = [[math.log(c / sum(row)) for c in row] for row in counts]
    total = sum(root.values()) + 2 * smooth
    return Model(unary, pair, tuple(math.log((root[y] + smooth) / total) for y in (0, 1)))


def _logistic(rows: list[tuple[list[str], int]], bias: str, ridge: float = 1.0, steps: int = 12) -> dict[str, float]:
    """Weight of every feature in the log odds of content, by Newton's method; ``bias`` is the feature that all rows have."""
    names = sorted({f for features, _ in rows for f in features})
    if not names:
        return {}
    column = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, (features, _) in enumerate(rows):
        x[i, [column[f] for f in features]] = 1
    y = np.array([label == CONTENT for _, label in rows], float)
    w = np.zeros(len(names))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
    w[column[bias]] -= math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    return dict(zip(names, w.tolist()))


LAYOUTS = ("elements", "names", "mixed", "bare", "table")
_ELEMENTS = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form", "talk": "section", "main": "article main", "ad": "aside", "notice": "dialog", "share": "aside"}
_NAMES = {
    "menu": "nav menu navbar breadcrumb",
    "head": "header masthead banner",
    "foot": "footer copyright legal",
    "side": "sidebar related widget trending",
    "ad": "ad ads advert sponsored promo",
    "notice": "cookie consent notice newsletter popup alert",
    "form": "form search login contact",
    "talk": "comments discussion replies",
    "share": "share social tags byline",
    "main": "content article-body post entry-content story",
}


def labelled_pages(n: int = 600, seed: int = 7, layouts: tuple[str, ...] = LAYOUTS) -> Iterable[tuple[str, set[str]]]:
    """Pages with known main text: (html, set of content blocks). The layouts take turns."""
    r = random.Random(seed)
    syllables = [a + b for a in "bdfgklmnprstv" for b in "aeiou"]

    def word() -> str:
        return "".join(r.choices(syllables, k=r.randint(1, 4)))

    def words(least: int, most: int) -> str:
        return " ".join(word() for _ in range(r.randint(least, most)))

    def sentence(least: int, most: int) -> str:
        return words(least, most).capitalize() + r.choice(["."] * 8 + ["!", "?"])

    def sentences(k: int, least: int, most: int) -> str:
        return " ".join(sentence(least, most) for _ in range(k))

    def link() -> str:
        return f'<a href="/{word()}">{words(1, 3).capitalize() if r.random() < 0.5 else word()}</a>'

    def links() -> str:
        """Links as a list, a line or a row of blocks."""
        kind, own = r.random(), [link() for _ in range(r.randint(3, 9))]
        if kind < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in own) + "</ul>"
        return r.choice([" | ", " &middot; ", " "]).join(own) if kind < 0.8 else "".join(f"<div>{x}</div>" for x in own)

    def page(layout: str) -> tuple[str, set[str]]:
        content: set[str] = set()

        def region(kind: str) -> tuple[str, str]:
            if layout in ("bare", "table"):
                tag = "form" if kind == "form" else "div"
                return f"<{tag}>", f"</{tag}>"
            if layout == "elements" or (layout == "mixed" and r.random() < 0.5):
                tag = r.choice(_ELEMENTS[kind].split())
                name = f' id="{kind}"' if kind in ("ad", "notice", "share") else ' id="comments"' if kind == "talk" else ""
                return f"<{tag}{name}>", f"</{tag}>"
            name = r.choice(_NAMES[kind].split()) + r.choice(["", "", "-box", " wrap", "_1"])
            tag = r.choice(["div", "div", "section"]) if kind != "form" else "form"
            return f'<{tag} {r.choice(["class", "class", "id"])}="{name}">', f"</{tag}>"

        def prose() -> str:
            """A block of content; with links or inline markup at times, which leave the text as it is."""
            text = sentences(r.choice([1, 1, 2, 3, 5, 8]), 1, 14)
            kind = r.random()
            if kind < 0.1:
                text = " | ".join(word() for _ in range(r.randint(3, 20)))
            elif kind < 0.2:
                text = text.rstrip(".!?")
            elif kind < 0.4:
                text = sentence(1, r.choice([1, 3, 6]))
            elif kind < 0.45:  # content too may speak of such things
                text = r.choice(["All rights reserved.", "This says more on cookies. ", "She did subscribe to it. ", "His privacy policy is old. "]) + (sentence(1, 9) if r.random() < 0.5 else "")
                text = text.strip()
            content.add(text)
            parts = text.split(" ")
            if len(parts) > 2 and r.random() < 0.3:
                i = r.randrange(len(parts) - 1)
                j = min(len(parts), i + r.randint(1, 3))
                a, b = r.choice([('<a href="/x">', "</a>")] * 3 + [("<b>", "</b>"), ("<em>", "</em>"), ("<code>", "</code>")])
                return html_lib.escape(" ".join(parts[:i]) + " " * (i > 0)) + a + html_lib.escape(" ".join(parts[i:j])) + b + html_lib.escape(" " * (j < len(parts)) + " ".join(parts[j:]))
            return html_lib.escape(text)

        def item() -> str:
            return r.choice(["<li>{}</li>", "<li><p>{}</p></li>"]).format(prose())

        def body_part() -> str:
            p = r.random()
            if p < 0.7:
                return f"<p>{prose()}</p>"
            if p < 0.8:
                return f"<{(h := r.choice(['h2', 'h3']))}>{prose()}</{h}>"
            if p < 0.87:
                return "<ul>" + "".join(item() for _ in range(r.randint(2, 5))) + "</ul>"
            if p < 0.9:
                return f"<blockquote><p>{prose()}</p></blockquote>"
            if p < 0.94:
                return "<table>" + "".join(f"<tr><td>{prose()}</td><td>{prose()}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
            if p < 0.955:
                return "<dl>" + "".join(f"<dt>{prose()}</dt><dd>{prose()}</dd>" for _ in range(r.randint(2, 5))) + "</dl>"
            if p < 0.98:
                return f"<figure><img src=x><figcaption>{prose()}</figcaption></figure>"
            return f"<pre>{prose()}</pre>"

        def boilerplate(kind: str) -> str:
            p, h, (a, b) = r.random(), r.choice(["h2", "h3", "h4", "p"]), region(kind)
            if kind == "menu":
                return a + links() + b
            if kind == "head":
                return f"{a}<{(t := r.choice(['h1', 'div', 'p']))}>{words(1, 3)}</{t}>{'<p>' + sentence(2, 6) + '</p>' if p < 0.4 else links() if p < 0.6 else ''}{b}"
            if kind == "foot":
                line = r.choice([f"&copy; 20{r.randint(10, 25)} {words(1, 2)}", f"Copyright {words(1, 2)}. All rights reserved.", f"{words(1, 2)}, {r.randint(1, 99)} {word()}, {word()}", sentences(r.randint(1, 3), 2, 9)])
                return f"{a}{'<p>' + line + '</p>' if p < 0.6 else line}{links() if p < 0.4 else ''}{b}"
            if kind == "side":
                inner = links() if p < 0.6 else "<p>" + sentences(r.randint(1, 4), 3, 12) + "</p>" if p < 0.8 else "".join(f"<div>{link()}<p>{sentence(4, 10)}</p></div>" for _ in range(r.randint(1, 4)))
                return f"{a}<{h}>{word()}</{h}>{inner}{b}"
            if kind == "ad":
                return f"{a}{sentences(r.randint(1, 3), 2, 10) if p < 0.6 else '<p>' + link() + ' ' + sentence(2, 6) + '</p>'}{b}"
            if kind == "notice":
                line = r.choice(["We use cookies. ", "Subscribe now. ", "Sign up for our newsletter. ", ""]) + sentence(3, 12)
                return f"{a}{'<p>' + line + '</p>' if p < 0.5 else line}{link() if p < 0.3 else ''}{b}"
            if kind == "form":
                return f"{a}<label>{word()}</label><input name=q><p>{sentence(2, 7)}</p><button>{word()}</button>{b}"
            if kind == "share":
                return f"{a}{links() if p < 0.5 else words(2, 4)}{b}"
            if layout not in ("bare", "table") and r.random() < 0.4:
                own = r.choice(["li", "li class=comment", 'article class="comment"'])
                said = "".join(f"<{own}><p>{word()} {r.randint(1, 28)}</p><p>{sentences(r.randint(1, 4), 2, 12)}</p></{own.split()[0]}>" for _ in range(r.randint(1, 5)))
                return f"{a}<{h}>{r.choice(['Comments', word()])}</{h}>{'<ol class=commentlist>' + said + '</ol>' if own[0] == 'l' else said}{b}"
            said = "".join(f"<div{' class=comment' if layout not in ('bare', 'table') else ''}><b>{word()}</b> {word()} {r.randint(1, 28)}<p>{sentences(r.randint(1, 4), 2, 12)}</p></div>" for _ in range(r.randint(1, 5)))
            return f"{a}<{h}>{r.choice(['Comments', word()])}</{h}>{said}{b}"

        title = words(2, 8).capitalize()
        content.add(title)
        parts = [body_part() for _ in range(r.choice([1, 2, 4, 8, 15]))]
        if layout not in ("bare", "table") and r.random() < 0.12:  # a reading list: links are all it says
            titles = [words(1, 9).capitalize() + r.choice(["", "", "."]) for _ in range(r.randint(2, 12))]
            content.update(titles)
            listed = "".join(f'<li><a href="/{word()}">{t}</a></li>' for t in titles)
            parts = [*(parts[:1] if r.random() < 0.3 else []), r.choice(["<ul>{}</ul>", "<ol>{}</ol>"]).format(listed)]
            content &= {title, *titles} | ({x for x in content if html_lib.escape(x) in parts[0]} if len(parts) > 1 else set())
        if r.random() < 0.35:
            parts.insert(r.randint(0, len(parts)), boilerplate(r.choice(["ad", "share", "side", "notice", "form"])))
        a, b = region("main")
        often = r.choice([1] * 7 + [0.1])  # some pages hold little besides their text, and no title then
        head = f"<h1>{title}</h1>"
        if often < 1 and r.random() < 0.3:
            content.discard(title)
            head = ""
        main = f"{a}{head}{''.join(parts)}{b}"
        before = [boilerplate(k) for k in ("head", "menu", "notice", "ad", "form") if r.random() < 0.55 * often]
        after = [boilerplate(k) for k in ("talk", "side", "ad", "notice", "form", "foot") if r.random() < 0.5 * often]
        r.shuffle(before)
        if layout == "table":
            cells = "".join(f"<td>{x}</td>" for x in (boilerplate("menu"), main, boilerplate("side")))
            inner = f"<table><tr><td colspan=3>{''.join(before)}</td></tr><tr>{cells}</tr><tr><td colspan=3>{''.join(after)}</td></tr></table>"
        elif r.random() < 0.4:
            name = "" if layout == "bare" else f' class="{r.choice(["wrapper", "page", "container", "main"])}"'
            inner = f"{''.join(before)}<div{name}>{main}{boilerplate('side') if r.random() < 0.5 else ''}</div>{''.join(after)}"
        else:
            inner = "".join((*before, main, *after))
        return f"<html><head><title>{title} - {word()}</title><script>track(1)</script></head><body>{inner}</body></html>", {" ".join(x.split()) for x in content}

    for i in range(n):
        yield page(layouts[i % len(layouts)])


@lru_cache(1)
def default_model() -> Model:
    return train(labelled_pages())


def extract(page: str | None, model: Model) -> str:
    tree = parse(page)
    keep = model.marginals(tree)
    return "\n".join(t for t, p in zip(tree.text, keep) if t is not None and p > 0.5)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars. The model is trained once, where the driver runs."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        return column.map(lambda x: extract(x, shared.value))

    found = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_of(F.coalesce(html_col, F.lit(""))).alias("text"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
