"""Main text of web pages by a graphical model on the DOM tree.

Every element is a variable with two states, content or not. Its own potential comes from its tag, the words of
its class, id and role, the length of its own text and the share of linked text below it; parent-child potentials
connect the elements. Sum-product messages go up from the leaves and down from the root, which is exact on a tree,
and an element's text is kept if the marginal of content is at least one half. The potentials are smoothed
frequencies over labelled pages; LABELLED makes these, with all kinds of boilerplate, from a fixed seed.

A class, id or role in which every word is known (a neutral word like "list" does not count) is telling anywhere. Inside an
article or main element, or one that is named as an article, a name that holds other words too, as "related-figure", is a weak hint, learnt apart.

Text in one block has its character references decoded and white space turned into one space; blocks follow in page
order. Formulas, drawings' texts, and what object and noscript hold are text like any other; forms' controls and what no
browser shows (scripts, styles, templates, a formula's source) are not. A page cut off in the midst of a tag loses the tag
only. Null html and an empty page have empty text. Repeated pages give equal text; a marginal of exactly one half keeps the
text. Parsing is linear in the page's length, nesting may be of any depth, and very long pages are worked on one by one. An
empty table gives an empty result. Other columns stay; those named text or n_chars are renamed by an underscore at the end.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import apart, sliced, worker

# In quotes, > may stand in an attribute, < may not: each < then ends the search, and time stays linear.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/><]*)((?:[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+)>""")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/><]*)([^><]*)>")
ATTRIBUTE = re.compile(r"""(?i)(?:^|[\s"'])(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page; of the second, the content is text without markup.
RAW = frozenset("script style textarea title iframe template select button noembed noframes annotation annotation-xml datalist".split())
LITERAL = frozenset(["xmp", "plaintext"])
_MATH = "math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts semantics"
INLINE = frozenset(f"a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img noscript object svg g text tspan {_MATH}".split())
#: Elements that a start tag closes, up to the nearest of the second set.
_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_CLOSES = {t: (frozenset(["p"]), frozenset(["article", "aside", "section", "div", "td", "th", "body", "li", "main", "button", "blockquote"])) for t in _P}
_CLOSES |= {"li": (frozenset(["li", "p"]), frozenset(["ul", "ol", "menu"])), "dt": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])), "tr": (frozenset(["tr", "td", "th", "p"]), frozenset(["table"])), "td": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])), "option": (frozenset(["option"]), frozenset(["select"])), "body": (frozenset(["head"]), frozenset())}
TAGS = {t: t for t in "article main section div p li ul ol nav header footer aside form table td blockquote pre figure figcaption body html head dl dd dt".split()} | {f"h{k}": "h" for k in range(1, 7)} | {t: "inline" for t in INLINE}
LEXICON = {
    "comment": "comment comments commentlist reply replies disqus respond discussion responses thread",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored sponsors adslot dfp taboola outbrain promoted",
    "notice": "notice cookie cookies consent gdpr banner alert popup modal newsletter subscribe subscription signup promo promotion paywall disclaimer privacy",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs skip submenu",
    "side": "sidebar side aside widget widgets related recommended recommendations popular trending rail complementary teaser",
    "footer": "footer foot copyright legal colophon contentinfo",
    "header": "header masthead topbar logo brand site",
    "form": "form search login register contact",
    "share": "share sharing social follow",
    "content": "article content main post entry story body text prose page document",
}
#: Words that say nothing about what an element holds.
NEUTRAL = frozenset("container wrapper wrap list left right top bottom box block area section inner outer item items row col column bar unit group holder panel primary secondary fixed sticky js is has no the".split())
#: Words that name an article's own element, whatever its tag.
WHOLE = frozenset("article post entry story prose".split())
_GROUP = {w: g for g, words in reversed(LEXICON.items()) for w in words.split()}
_ORDER = {g: k for k, g in enumerate(LEXICON)}


class Page:
    """A parsed page: for each element its parent, tag, lexicon group, label in training; text runs and their elements."""

    __slots__ = ("groups", "inside", "labelled", "labels", "parents", "runs", "tags")

    def __init__(self, text: str, labelled: bool = True):
        #: whether data-y is a label; pages to extract may use the attribute for anything
        self.labelled = labelled
        self.parents, self.tags, self.groups, self.labels, self.inside = [-1], ["root"], ["g:none"], [0], [False]
        #: (element, text, linked); an element of -1 is a block's edge
        self.runs: list[tuple[int, str, bool]] = []
        self._parse(text)

    def _open(self, parent: int, tag: str, attributes: str) -> int:
        group, label, inside = "none", self.labels[parent], self.inside[parent]
        weak = holds = False
        if attributes and "=" in attributes:
            best = 99
            for m in ATTRIBUTE.finditer(attributes):
                value = m[2] or m[3] or m[4] or ""
                if m[1].lower() == "data-y":
                    if self.labelled:
                        label = int(value)
                    continue
                for name in value.split():
                    words = [w.lower() for w in WORD.findall(name)]
                    holds = holds or not WHOLE.isdisjoint(words) and tag != "body"
                    other = any(w not in _GROUP and w not in NEUTRAL and not w.isdigit() for w in words)
                    for w in words:
                        # a name that is known as a whole goes before one that is known in part
                        if (g := _GROUP.get(w)) and (rank := _ORDER[g] + 20 * (other and inside)) < best:
                            best, group, weak = rank, g, other and inside
        self.parents.append(parent)
        self.tags.append(tag)
        self.groups.append(("w:" if weak else "g:") + group)
        self.labels.append(label)
        self.inside.append(inside or tag in ("article", "main") or holds)
        return len(self.parents) - 1

    def _parse(self, text: str) -> None:
        runs, at, n = self.runs, 0, len(text)
        stack, names, links = [0], ["root"], 0
        opened: Counter[str] = Counter()

        def close_to(k: int) -> None:
            nonlocal links
            for name in names[k:]:
                opened[name] -= 1
                links -= name == "a"
                if name not in INLINE:
                    runs.append((-1, "", False))
            del stack[k:], names[k:]

        while at < n:
            start = text.find("<", at)
            if start < 0:
                start = n
            if start > at:
                runs.append((stack[-1], text[at:start], links > 0))
            if start == n:
                break
            after = text[start + 1 : start + 2]
            if after in ("!", "?"):
                if text.startswith("<!--", start):
                    end = text.find("-->", start + 4)
                    at = n if end < 0 else end + 3
                else:
                    end = text.find(">", start)
                    at = n if end < 0 else end + 1
                continue
            m = TAG.match(text, start) or LOOSE.match(text, start)
            if m is None:
                if after.isalpha() or after == "/":
                    # a tag that is cut off by the end or by another tag
                    end = text.find("<", start + 1)
                    at = n if end < 0 else end
                    continue
                runs.append((stack[-1], "<", links > 0))
                at = start + 1
                continue
            at, tag = m.end(), m[2].lower()
            if m[1]:
                if opened[tag] > 0:
                    k = len(names) - 1
                    while names[k] != tag:
                        k -= 1
                    close_to(k)
                continue
            if tag in _CLOSES:
                closed, until = _CLOSES[tag]
                if any(opened[c] > 0 for c in closed):
                    k, first = len(names) - 1, -1
                    while k > 0 and names[k] not in until:
                        if names[k] in closed:
                            first = k
                        k -= 1
                    if first > 0:
                        close_to(first)
            if tag in VOID:
                runs.append((stack[-1], " ", False) if tag in INLINE or tag == "br" else (-1, "", False))
                continue
            if tag in LITERAL:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(text, at) if tag == "xmp" else None
                runs += [(-1, "", False), (stack[-1], html.escape(text[at : n if end is None else end.start()]), False), (-1, "", False)]
                at = n if end is None else end.end()
                continue
            if tag in RAW:
                if not m[3].endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(text, at)
                    at = n if end is None else end.end()
                continue
            if tag not in INLINE:
                runs.append((-1, "", False))
            if m[3].endswith("/") and tag not in TAGS:
                continue
            stack.append(self._open(stack[-1], tag, m[3]))
            names.append(tag)
            opened[tag] += 1
            links += tag == "a"

    def features(self) -> list[tuple[str, ...]]:
        """Of each element: tag, lexicon group, own text, share of linked text below."""
        n = len(self.parents)
        own, total, linked = [0] * n, [0] * n, [0] * n
        for e, text, link in self.runs:
            if e >= 0 and (k := len(text)) and not text.isspace():
                own[e] += k
                total[e] += k
                linked[e] += k * link
        for i in range(n - 1, 0, -1):
            p = self.parents[i]
            total[p] += total[i]
            linked[p] += linked[i]
            if self.tags[i] in INLINE:
                own[p] += own[i]
        out = []
        for i in range(n):
            size = "n0" if own[i] == 0 else "n1" if own[i] < 25 else "n2" if own[i] < 80 else "n3" if own[i] < 300 else "n4"
            share = "l-" if total[i] == 0 else f"l{min(3, 4 * linked[i] // total[i])}"
            out.append((TAGS.get(self.tags[i], "other"), self.groups[i], size, share))
        return out

    def text(self, keep: list[bool]) -> str:
        blocks, block = [], []
        for e, text, _ in self.runs:
            if e < 0:
                if block:
                    blocks.append("".join(block))
                    block = []
            elif keep[e]:
                block.append(html.unescape(text) if "&" in text else text)
        if block:
            blocks.append("".join(block))
        return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


class TreeModel:
    """Potentials, of node features given the state and of child states given the parent's; exact marginals."""

    def __init__(self, pages: list[str]):
        counts, pairs, states = [Counter(), Counter()], {}, [1.0, 1.0]
        for source in pages:
            page = Page(source)
            for i, features in enumerate(page.features()):
                y = page.labels[i]
                states[y] += 1
                counts[y].update(features)
                if i:
                    pairs.setdefault(features[0], [[1.0, 1.0], [1.0, 1.0]])[page.labels[page.parents[i]]][y] += 1
        # P(features | state), smoothed; P(child's state | parent's state), for each tag of the child
        names = set(counts[0]) | set(counts[1])
        # lengths and links repeat from child to child, so they are damped; a telling name is not
        damped = {**dict.fromkeys(("n0", "n1", "n2", "n3", "n4"), 0.3), **dict.fromkeys(("l-", "l0", "l1", "l2", "l3"), 0.75)}
        self.node = {f: tuple(((counts[y][f] + 0.2) / (states[y] + 0.4)) ** damped.get(f, 1.0) for y in (0, 1)) for f in names}
        self.pair = {tag: [[x / sum(row) for x in row] for row in table] for tag, table in pairs.items()}
        self.unseen = [[sum(t[p][y] for t in self.pair.values()) / len(self.pair) for y in (0, 1)] for p in (0, 1)]

    def marginals(self, page: Page) -> list[float]:
        """P(content) of each element, by messages up and down the tree."""
        n, node = len(page.parents), self.node
        belief, pair = [], []
        for features in page.features():
            a = b = 1.0
            pair.append(self.pair.get(features[0], self.unseen))
            for f in features:
                if f in node:
                    x, y = node[f]
                    a *= x
                    b *= y
            belief.append([a / (a + b), b / (a + b)])
        belief[0] = [1.0, 0.0]  # the root is no content
        up: list[tuple[float, float]] = [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):  # children follow their parents
            (b0, b1), (pa0, pa1) = belief[i], pair[i]
            m0, m1 = pa0[0] * b0 + pa0[1] * b1, pa1[0] * b0 + pa1[1] * b1
            s = m0 + m1
            up[i] = m0, m1 = m0 / s, m1 / s
            p = belief[page.parents[i]]
            p[0] *= m0
            p[1] *= m1
            s = p[0] + p[1]
            p[0] /= s
            p[1] /= s
        out = [0.0] * n
        for i in range(1, n):
            q = out[page.parents[i]]
            m0, m1 = up[i]
            # what the parent believes without this child, passed down
            c0, c1 = (1 - q) / max(m0, 1e-300), q / max(m1, 1e-300)
            (b0, b1), (pa0, pa1) = belief[i], pair[i]
            x, y = (c0 * pa0[0] + c1 * pa1[0]) * b0, (c0 * pa0[1] + c1 * pa1[1]) * b1
            out[i] = y / (x + y) if x + y > 0 else 0.5
        return out

    def extract(self, source: str | None) -> str:
        if not source:
            return ""
        page = Page(source, labelled=False)
        return page.text([p >= 0.5 for p in self.marginals(page)])


def labelled_pages(n: int = 600, seed: int = 7) -> list[str]:
    """Pages whose elements carry data-y, 1 for content; the boilerplate is of all kinds, with and without telling names."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioulnrstd") for _ in range(r.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    links = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 8))) + "</ul>"
    name = lambda g: r.choice(LEXICON[g].split())

    def box(group: str, tags: tuple[str, ...], inner: str, always: bool = False) -> str:
        tag = r.choice(tags)
        bare = tag != "div" and not always and r.random() < 0.6
        return f"<{tag} data-y=0{'' if bare else f' class={name(group)}'}>{inner}</{tag}>"

    def noise() -> str:
        kind = r.choice((0, 1, 2, 3, 4, 5, 5, 5, 6, 7))
        if kind == 0:
            return box("nav", ("nav", "div", "ul"), links())
        if kind == 1:
            return box("ad", ("div", "aside", "section"), words(3, 25) if r.random() < 0.7 else f"<p>{words(3, 20)}</p>{link()}", True)
        if kind == 2:
            return box("side", ("aside", "div"), f"<h3>{words(1, 4)}</h3>" + (links() if r.random() < 0.6 else f"<p>{words(5, 40)}</p>"))
        if kind == 3:
            return box("notice", ("div", "section", "p"), f"<p>{words(5, 30)}</p>{link()}" if r.random() < 0.5 else words(5, 30), True)
        if kind == 4:
            return box("form", ("form", "div"), f"<label>{words(1, 4)}</label><input><p>{words(2, 12)}</p>")
        if kind == 5:
            return box("comment", ("div", "section"), f"<h3>{words(1, 3)}</h3>" + "".join(f"<div><p>{words(4, 60)}</p></div>" for _ in range(r.randint(1, 5))), True)
        if kind == 6:
            return box("share", ("div", "ul"), "".join(f"<li>{link()}</li>" for _ in range(3)), True)
        return box("footer", ("footer", "div"), f"<p>{words(3, 25)}</p>" if r.random() < 0.5 else f"&copy; {words(2, 20)}")

    def body(sure: bool) -> str:
        parts = [f"<h1>{words(2, 12)}</h1>"]
        for _ in range(r.randint(1, 14)):
            k = r.random()
            text = words(1, 90) + "."
            if r.random() < 0.2:
                text = f"{words(1, 30)} {link()} {words(1, 30)} <b>{words(1, 6)}</b>"
            parts.append(f"<h2>{words(1, 6)}</h2>" if k < 0.08 else f"<{(t := r.choice(('ul', 'ol')))}><li>{text}</li>{''.join(f'<li>{words(2, 40)}</li>' for _ in range(r.randint(1, 4)))}</{t}>" if k < 0.14 else f"<blockquote><p>{text}</p></blockquote>" if k < 0.18 else f"<pre>{text}</pre>" if k < 0.2 else f"<table><tr><td>{words(1, 5)}</td><td>{words(1, 5)}</td></tr></table>" if k < 0.23 else f"<div>{text}</div>" if k < 0.27 else f"<p>{text}</p>")
            if r.random() < 0.08:
                parts.append(noise())
            if sure and r.random() < 0.12:
                # content under a name of which one word alone would tell of something else, and some noise under such a name
                group, inner = r.choice([g for g in LEXICON if g != "content"]), f"<p>{words(4, 60)}</p>"
                good = r.random() < 0.8
                name_ = f"{name(group)}-{word()}x" if r.random() < 0.5 else f"{word()}x_{name(group)}"
                parts.append(f"<{(t := r.choice(('div', 'section', 'figure')))} data-y={int(good)} class={name_}>{inner if good else links()}</{t}>")
            if r.random() < 0.04:
                parts.append(f"<p>{words(2, 9)} <math><mi>{word()}</mi><mo>=</mo><mn>2</mn></math> {words(1, 9)}</p><noscript>{words(1, 9)}</noscript><object>{words(1, 4)}</object>")
        return "".join(parts)

    out = []
    for _ in range(n):
        tag = r.choice(("article", "article", "article", "main", "div", "section"))
        bare = tag in ("article", "main") and r.random() < 0.7
        named = "" if bare else name("content")
        inner = f"<{tag} data-y=1{named and f' class={named}'}>{body(tag in ('article', 'main') or named in WHOLE)}</{tag}>"
        if r.random() < 0.3:
            inner = f"<div>{noise()}{inner}{noise() if r.random() < 0.5 else ''}</div>"
        head = box("header", ("header", "div"), f"<h2>{words(1, 4)}</h2>" + (links() if r.random() < 0.5 else f"<p>{words(1, 10)}</p>")) if r.random() < 0.5 else ""
        out.append(f"<html data-y=0><body>{head}{''.join(noise() for _ in range(r.randint(0, 3)))}{inner}{''.join(noise() for _ in range(r.randint(0, 3)))}</body></html>")
    return out


_models: list[TreeModel] = []


def model() -> TreeModel:
    if not _models:
        _models.append(TreeModel(labelled_pages()))
    return _models[0]


def main_text(pages: DataFrame, page: str = "html") -> DataFrame:
    """`pages` with text in place of the html column, and n_chars, its code points."""
    pages = apart(pages.withColumnRenamed(page, "_html") if page in ("text", "n_chars") else pages, ("text", "n_chars"))
    page = "_html" if page in ("text", "n_chars") else page
    fields, at = [f for f in pages.schema.fields if f.name != page], pages.columns.index(page)
    kept = [pages.columns.index(f.name) for f in fields]
    out = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    shared = pages.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in sliced(b, at)):
            texts = [shared.value.extract(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=out.names)

    return pages.mapInArrow(worker(run), out)
