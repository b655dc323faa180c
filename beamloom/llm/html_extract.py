"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into its leaf blocks (runs of text that no block element interrupts). Each block
has features from its ancestor elements (tags and the words of their class, id and role) and
from its text (length, link share, punctuation, marks of notices and copyright lines). A chain
with two states, text and boilerplate, scores blocks in page order; its weights are fitted by
maximum likelihood on labelled pages, and Viterbi decoding picks the best labelling of a page.

Defined results: null, empty or textless html gives an empty string; unclosed elements end with
their parent; unclosed comments and scripts run to the page's end, an unclosed tag is text; repeated
rows are extracted as often as they occur; nothing is capped, and time and memory are in
proportion to the html, however deep or broken it is; ids and urls are carried as they are, null
ones too; an empty table gives an empty result; other columns of the input are not returned.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT, BOILERPLATE = 1, 0
#: Elements whose content is no text of the page.
_RAW = re.compile(r"(script|style|template|svg|textarea|select|iframe|canvas)\b", re.I)
_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
#: Elements that never have content.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements inside a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br object math mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot munder mover munderover mtable mtr mtd mstyle semantics annotation".split())
#: An element of the key ends open elements of the value, up to a container.
CLOSES = {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "p": {"p"},
}
CONTAINERS = frozenset("ul ol dl table tbody thead tfoot div section article aside nav header footer main form body blockquote fieldset figure details".split())
_ATTR = re.compile(r"\b(class|id|role|itemprop|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


def _words(attrs: str) -> tuple[str, ...]:
    """Words of class, id and role, and a mark for hidden elements."""
    return _short_words(attrs) if len(attrs) < 300 else _found_words(attrs)


def _found_words(attrs: str) -> tuple[str, ...]:
    out = []
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                out.append("!hidden")
        elif name == "hidden" or name == "aria-hidden":
            if value.lower() != "false":
                out.append("!hidden")
        else:
            out += _WORD.findall(_CAMEL.sub(r"\1 \2", value).lower())
    return tuple(dict.fromkeys(out))


_short_words = lru_cache(4096)(_found_words)


class Element:
    """An open element: its parent, tag, words, and the features that its ancestors lack. Blocks share their ancestors."""

    __slots__ = ("parent", "tag", "words", "new", "score")

    def __init__(self, parent: Element | None, tag: str, words: tuple[str, ...], new: tuple[str, ...]):
        self.parent, self.tag, self.words, self.new, self.score = parent, tag, words, new, None

    def path(self) -> list[tuple[str, tuple[str, ...]]]:
        """(tag, words) from the outermost ancestor."""
        out, node = [], self
        while node is not None:
            out.append((node.tag, node.words))
            node = node.parent
        return out[::-1]


class _Stack:
    """The open elements, with counts of their features and tags, so that a push or pop costs what it changes."""

    def __init__(self):
        self.items: list[Element] = []
        self.features: dict[str, int] = {}
        self.tags: dict[str, int] = {}

    def push(self, tag: str, words: tuple[str, ...]) -> None:
        own = (f"t:{tag}", *[f"w:{w}" for w in words])
        new = tuple(f for f in own if not self.features.get(f))
        for f in own:
            self.features[f] = self.features.get(f, 0) + 1
        self.tags[tag] = self.tags.get(tag, 0) + 1
        self.items.append(Element(self.items[-1] if self.items else None, tag, words, new))

    def pop(self) -> str:
        e = self.items.pop()
        for f in (f"t:{e.tag}", *[f"w:{w}" for w in e.words]):
            self.features[f] -= 1
        self.tags[e.tag] -= 1
        return e.tag

    def close(self, tag: str) -> None:
        if self.tags.get(tag):
            while self.pop() != tag:
                pass


class _Tags:
    """Finds where tags of a page end, in linear time over all calls."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.dead: set[int] = set()  # places outside quotes from which no end is found

    def end(self, start: int) -> int:
        """The place of the ">" that ends a tag's attributes, not one inside quotes; if quotes do not close, the next ">"; -1 without any."""
        page, last = self.page, self.last
        if start > last[">"]:
            return -1
        at, passed = start, []
        while (m := _STOP.search(page, at)) is not None:
            at = m.start()
            if m[0] == ">":
                return at
            if at in self.dead or last[m[0]] <= at:
                break
            passed.append(at)
            at = page.find(m[0], at + 1) + 1
        self.dead.update(passed)
        if m is not None:
            self.dead.add(at)
        return page.find(">", start)


def _tokens(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, tag or None for what is skipped, whether it is an end tag, attributes) of the markup of a page."""
    tags, at, n = _Tags(page), 0, len(page)
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = n if end < 0 else end + 3
            yield at, end, None, False, ""
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at) + 1 if at < tags.last[">"] else 0
            if end:
                yield at, end, None, False, ""
        elif (m := _TAG.match(page, at + 1)) is None:
            end = 0
        elif not m[1] and (raw := _RAW.match(page, at + 1)):
            end = page.find(">", raw.end()) + 1 if at < tags.last[">"] else 0
            if end:
                if page[end - 2] != "/":
                    close = re.compile(rf"</{raw[1]}\s*>", re.I).search(page, end)
                    end = close.end() if close else n
                yield at, end, None, False, ""
        else:
            end = tags.end(m.end()) + 1
            if end:
                yield at, end, m[2].lower(), bool(m[1]), page[m.end() : end - 1]
        at = end or at + 1


def blocks(page: str) -> list[tuple[str, Element | None, float]]:
    """(text, innermost open element, share of characters in links) of the leaf blocks."""
    out: list = []
    stack = _Stack()
    parts: list[str] = []
    linked, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((text, stack.items[-1] if stack.items else None, min(1.0, linked / len(text))))
            parts.clear()
            linked = 0

    for start, end, tag, ends, attrs in _tokens(page):
        if start > at:
            parts.append(page[at:start])
            if in_link:
                linked += start - at
        at = end
        if tag is None:
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if ends else 1
            elif tag == "br" or tag == "img":
                parts.append(" ")
            continue
        flush()
        in_link = 0
        if ends:
            stack.close(tag)
        elif tag not in VOID:
            closing = CLOSES.get(tag) or {"p"}
            while stack.items and stack.items[-1].tag in closing:
                stack.pop()
            stack.push(tag, _words(attrs))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


_NOTICE = re.compile(r"cookie|consent|newsletter|subscribe|sign up|log ?in|privacy|advert|sponsor|all rights reserved|terms of|share this|read more|click here|copyright|©", re.I)


def leaf_features(element: Element | None) -> tuple[str, ...]:
    return ("leaf:",) if element is None else (f"leaf:{element.tag}", *[f"lw:{w}" for w in element.words])


def path_features(element: Element | None) -> list[str]:
    """Each tag and word of the ancestors once, and the innermost element's as such."""
    out = list(leaf_features(element))
    while element is not None:
        out += element.new
        element = element.parent
    return out


def text_features(text: str, linked: float) -> tuple[str, ...]:
    n = text.count(" ") + 1
    out = [f"n:{min(6, n.bit_length())}", f"a:{int(linked * 3.999)}", f"end:{'.' if text[-1] in '.!?…:' else 'w' if text[-1].isalnum() else 'o'}"]
    if _NOTICE.search(text):
        out.append("notice" if n < 60 else "long notice")
    if text[0] == "©":
        out.append("copyright")
    return tuple(out)


class ChainCRF:
    """Two states; features are binary. Weights are for TEXT against BOILERPLATE."""

    def __init__(self, weights: dict[str, float], trans: list[list[float]], start: list[float]):
        self.weights, self.trans, self.start = weights, trans, start

    def path_score(self, element: Element | None) -> float:
        """The weights of a block's ancestors; each element's sum is kept on it."""
        open_, node = [], element
        while node is not None and node.score is None:
            open_.append(node)
            node = node.parent
        total, get = 0.0 if node is None else node.score, self.weights.get
        for node in reversed(open_):
            for f in node.new:
                total += get(f, 0.0)
            node.score = total
        return total

    def scores(self, found: list) -> list[float]:
        """One number a block. Elements keep sums of the model that scored them first."""
        get, out = self.weights.get, []
        for text, element, linked in found:
            s = self.path_score(element)
            for f in leaf_features(element):
                s += get(f, 0.0)
            for f in text_features(text, linked):
                s += get(f, 0.0)
            out.append(s)
        return out

    def decode(self, found: list) -> list[int]:
        """The most probable labelling (Viterbi)."""
        if not found:
            return []
        (t00, t01), (t10, t11) = self.trans
        scores = self.scores(found)
        b, t = self.start[0], self.start[1] + scores[0]
        back = []
        for s in scores[1:]:
            from_b, from_t = b + t00 < t + t10, b + t01 < t + t11
            back.append((from_b, from_t))
            b, t = (t + t10 if from_b else b + t00), (t + t11 if from_t else b + t01) + s
        state = int(t > b)
        out = [state]
        for step in reversed(back):
            state = int(step[state])
            out.append(state)
        return out[::-1]

    @classmethod
    def fit(cls, pages: list[tuple[list, list[int]]], rounds: int = 60, rate: float = 0.15, decay: float = 1e-3) -> ChainCRF:
        """Maximum likelihood by Adam over all pages at once, with forward and backward sums."""
        names: dict[str, int] = {}
        seqs = []
        for found, labels in pages:
            if found:
                rows = [[names.setdefault(f, len(names)) for f in (*path_features(p), *text_features(t, a))] for t, p, a in found]
                seqs.append((rows, labels))
        longest, n = max(len(r) for r, _ in seqs), len(seqs)
        flat_seq = np.concatenate([np.full(sum(map(len, r)), i) for i, (r, _) in enumerate(seqs)])
        flat_pos = np.concatenate([np.repeat(np.arange(len(r)), [len(x) for x in r]) for r, _ in seqs])
        flat_feat = np.concatenate([np.concatenate([np.array(x) for x in r]) for r, _ in seqs])
        size = np.array([len(r) for r, _ in seqs])
        gold = np.zeros((n, longest), int)
        for i, (_, labels) in enumerate(seqs):
            gold[i, : len(labels)] = labels
        real = np.arange(longest)[None, :] < size[:, None]
        step = real[:, 1:]
        theta = np.zeros(len(names) + 6)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        k, rows = len(names), np.arange(n)
        for it in range(1, rounds + 1):
            w, trans, start = theta[:k], theta[k : k + 4].reshape(2, 2), theta[k + 4 :]
            emit = np.zeros((n, longest, 2))
            np.add.at(emit[:, :, 1], (flat_seq, flat_pos), w[flat_feat])
            fwd, bwd = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
            fwd[:, 0] = start + emit[:, 0]
            for t in range(1, longest):
                new = np.logaddexp.reduce(fwd[:, t - 1, :, None] + trans, axis=1) + emit[:, t]
                fwd[:, t] = np.where(real[:, t, None], new, fwd[:, t - 1])
            for t in range(longest - 2, -1, -1):
                new = np.logaddexp.reduce(trans + (emit[:, t + 1] + bwd[:, t + 1])[:, None, :], axis=2)
                bwd[:, t] = np.where(real[:, t + 1, None], new, 0)
            total = np.logaddexp.reduce(fwd[rows, size - 1], axis=1)
            node = np.exp(fwd + bwd - total[:, None, None]) * real[:, :, None]
            pair = np.exp(fwd[:, :-1, :, None] + trans + (emit + bwd)[:, 1:, None, :] - total[:, None, None, None]) * step[:, :, None, None]
            grad = np.zeros_like(theta)
            np.add.at(grad[:k], flat_feat, (gold - node[:, :, 1])[flat_seq, flat_pos])
            for a in (0, 1):
                grad[k + 4 + a] = ((gold[:, 0] == a) - node[:, 0, a]).sum()
                for b in (0, 1):
                    grad[k + 2 * a + b] = (((gold[:, :-1] == a) & (gold[:, 1:] == b) & step) - pair[:, :, a, b]).sum()
            grad = grad / n - decay * theta
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            theta += rate * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.999**it)) + 1e-8)
        return cls({f: float(theta[i]) for f, i in names.items()}, theta[k : k + 4].reshape(2, 2).tolist(), theta[k + 4 :].tolist())


def labelled_page(seed: int) -> tuple[str, set[str]]:
    """A page made from varied templates, and the texts of its main blocks; words are invented."""
    r = random.Random(seed)
    letters = ["a", "e", "i", "o", "u", "é", "ü", "st", "tr", "n", "l", "m", "r", "ch", "th", "ñ", "s", "d"]

    def words(lo: int, hi: int) -> str:
        made = ["".join(r.choice(letters) for _ in range(r.randint(1, 5))) for _ in range(r.randint(lo, hi))]
        if r.random() < 0.1:
            made = [w + r.choice(["***", "%%%", "!!", "###", ","]) for w in made]
        text = " ".join(made)
        return text.upper() if r.random() < 0.05 else text.capitalize()

    main: set[str] = set()

    def keep(text: str) -> str:
        main.add(" ".join(text.split()))
        return text

    def link(text: str) -> str:
        return f'<a href="/{r.randint(0, 999)}">{text}</a>'

    def named(tag: str, *names: str, bare: float = 0.15) -> tuple[str, str]:
        attr = "" if r.random() < bare else f' {r.choice(["class", "class", "id"])}="{r.choice(names)}{r.choice(["", "", "-" + r.choice(["box", "top", "main2", "wrap", "1"]), " " + r.choice(["col", "row", "x1", "clearfix"])])}"'
        return f"<{tag}{attr}>", f"</{tag}>"

    def menu() -> str:
        items = [f"<li>{link(words(1, 2))}</li>" for _ in range(r.randint(2, 8))]
        if r.random() < 0.3:
            items = [link(words(1, 2)) + r.choice([" | ", " "]) for _ in items]
            a, b = named(r.choice(["nav", "div"]), "nav", "menu", "navbar", "navigation", "topnav", "links")
            return a + "".join(items) + b
        a, b = named(r.choice(["nav", "nav", "div"]), "nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", bare=0.3)
        if a == "<div>":
            a = '<div class="menu">'
        return f"{a}<ul>{''.join(items)}</ul>{b}"

    def banner() -> str:
        a, b = named("header", "header", "masthead", "site-header", "banner", bare=0.4) if r.random() < 0.7 else named("div", "header", "masthead", "site-header", "topbar", "banner", "logo", bare=0)
        return a + f"<{(t := r.choice(['p', 'h1', 'div', 'span', 'h2']))}>{words(1, 6)}</{t}>" + (menu() if r.random() < 0.4 else "") + b

    def aside() -> str:
        a, b = named("aside", "sidebar", "related", "widget", "rail", bare=0.4) if r.random() < 0.6 else named("div", "sidebar", "related", "widget", "side", "recommended", "popular", "trending", "rail", bare=0)
        inner = f"<h3>{words(1, 4)}</h3>" if r.random() < 0.6 else ""
        inner += "<ul>" + "".join(f"<li>{link(words(2, 8))}</li>" for _ in range(r.randint(1, 6))) + "</ul>" if r.random() < 0.6 else f"<p>{words(3, 40)}.</p>"
        return a + inner + b

    def advert() -> str:
        a, b = named(r.choice(["div", "div", "section", "aside", "ins"]), "ad", "ads", "advert", "advertisement", "sponsored", "promo", "sponsor", "banner-ad", "adsbygoogle", bare=0)
        text = r.choice([words(2, 12) + ".", words(2, 12), f"<p>{words(4, 25)}.</p>", link(words(2, 8))])
        return a + text + b

    def notice() -> str:
        a, b = named(r.choice(["div", "div", "section", "aside", "p"]), "cookie", "cookie-notice", "notice", "consent", "gdpr", "alert", "newsletter", "popup", "modal", "overlay", "subscribe", "disclaimer", "warning", bare=0)
        said = r.choice([words(4, 25) + ".", f"We use cookies {words(3, 15)}.", f"Subscribe to {words(2, 8)}", f"{words(3, 12)} cookies {words(1, 6)}."])
        return a + said + ("" if "<p" in a else f" <button>{words(1, 2)}</button>") + b

    def form() -> str:
        a, b = named("form", "search", "login", "contact", "signup", bare=0.5)
        return a + f"<label>{words(1, 4)}</label><input name=q><p>{words(2, 15)}.</p><button>{words(1, 2)}</button>" + b

    def comments() -> str:
        a, b = named(r.choice(["div", "section", "ol", "aside"]), "comments", "comment", "discussion", "responses", "replies", "reader-comments", "disqus", bare=0)
        rows = []
        for _ in range(r.randint(1, 5)):
            c, d = named(r.choice(["div", "li", "article"]), "comment", "reply", "comment-body", "response", bare=0)
            rows.append(f"{c}<p>{words(3, 60)}.</p>" + (f"<span>{words(1, 3)}</span>" if r.random() < 0.4 else "") + d)
        return a + (f"<h3>{words(1, 3)}</h3>" if r.random() < 0.6 else "") + "".join(rows) + b

    def footer() -> str:
        a, b = named("footer", "footer", "site-footer", bare=0.6) if r.random() < 0.7 else named("div", "footer", "copyright", "site-footer", "bottom", "legal", bare=0)
        text = r.choice([f"&copy; {r.randint(1990, 2030)} {words(1, 4)} &middot; {words(2, 15)}.", words(2, 20) + ".", f"<p>{words(2, 12)}</p>" + link(words(1, 2))])
        return a + text + (menu() if r.random() < 0.2 else "") + b

    def share() -> str:
        a, b = named("div", "share", "social", "social-links", "tags", "byline-tools", "toolbar", bare=0)
        return a + " ".join(link(words(1, 1)) for _ in range(r.randint(2, 5))) + b

    def body() -> str:
        lo, hi = r.choice([(1, 8), (5, 40), (30, 120), (1, 120)])
        out = [f"<h1>{keep(words(1, 10))}</h1>"] if r.random() < 0.75 else []
        for _ in range(r.choice([1, 2, 4, 8, 14])):
            kind = r.random()
            text = words(lo, hi) + r.choice([".", ".", "!", "", ".."])
            if r.random() < 0.06:  # articles have such lines of their own
                text = r.choice(["All rights reserved.", f"Copyright {words(1, 4)}. All rights reserved.", f"Cookies {words(1, 9)}.", f"Licensed under {words(1, 9)}.", f"Read more {words(1, 5)}", f"© {words(1, 4)}"])
            if kind < 0.7:
                end = r.choice(["</p>", "</p>", "</p>", "<br>", ""])
                out.append(f"<p>{'<b>' if r.random() < 0.1 else ''}{keep(text)}{end}")
            elif kind < 0.78:
                out.append(f"<h{(k := r.randint(2, 4))}>{keep(words(1, 7))}</h{k}>")
            elif kind < 0.85:
                out.append("<ul>" + "".join(f"<li>{keep(words(1, 25))}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote><p>{keep(text)}</p></blockquote>")
            elif kind < 0.94:
                out.append("<table>" + "".join(f"<tr><td>{keep(words(1, 5))}</td><td>{keep(words(1, 5))}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.96:
                out.append(f"<pre>{keep(text)}</pre>")
            elif kind < 0.97:
                out.append(f"<noscript><p>{keep(text)}</p></noscript>")
            else:
                a = words(1, 2)
                out.append(f"<p>{link(a)} {text}</p>")
                keep(f"{a} {text}")
            if r.random() < 0.05:
                out.append(r.choice([advert, share, aside, notice])())
        tag = r.choice(["article", "article", "main", "div", "section"])
        a, b = named(tag, "content", "article", "post", "entry", "story", "article-body", "post-content", "entry-content", "text", "main-content", bare=0 if tag in ("div", "section") else 0.5)
        tail = "".join(f() for f in (share, comments) if r.random() < 0.12)
        inner = a + "".join(out) + tail + b
        return f"<main>{inner}</main>" if r.random() < 0.2 else inner

    def unscripted() -> str:
        return f"<noscript>{r.choice(['Please enable JavaScript', words(2, 9)])}{r.choice(['.', ''])}</noscript>"

    before = [f() for f, p in ((notice, 0.2), (banner, 0.4), (menu, 0.7), (advert, 0.4), (form, 0.15), (aside, 0.15)) if r.random() < p]
    after = [f() for f, p in ((share, 0.2), (aside, 0.3), (comments, 0.35), (advert, 0.25), (form, 0.15), (notice, 0.2), (footer, 0.8)) if r.random() < p]
    if r.random() < 0.06:
        before.append(unscripted())
    r.shuffle(before)
    foot = [x for x in after if "foot" in x[:40] or "copyright" in x[:40]]
    rest = [x for x in after if x not in foot]
    if r.random() < 0.3:
        r.shuffle(rest)
    inner = "".join([*before, body(), *rest, *foot])
    if r.random() < 0.3:
        a, b = named("div", "page", "wrapper", "container", "layout", "site", bare=0.2)
        inner = a + inner + b
    head = f"<head><meta charset=utf-8><title>{words(1, 8)}</title><style>p{{margin:0}}</style></head>"
    return f"<!DOCTYPE html><html>{head}<body>{inner}" + r.choice(["</body></html>", ""]), main


def label(page: str, main: set[str]) -> tuple[list, list[int]]:
    found = blocks(page)
    return found, [TEXT if text in main else BOILERPLATE for text, _, _ in found]


@lru_cache(2)
def trained(pages: int = 600, rounds: int = 60) -> ChainCRF:
    """Fitted once in each process, on the first `pages` labelled pages."""
    return ChainCRF.fit([label(*labelled_page(seed)) for seed in range(pages)], rounds)


def main_text(page: str | None, model: ChainCRF) -> str:
    found = blocks(page or "")
    return "\n\n".join(b[0] for b, y in zip(found, model.decode(found), strict=True) if y == TEXT)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", model: ChainCRF | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row; a map without a shuffle. The weights are a few hundred numbers."""
    model = model or trained()
    shared = pages.sparkSession.sparkContext.broadcast((model.weights, model.trans, model.start))
    kinds = [pages.schema[c].dataType.simpleString() for c in (page_id, url)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = ChainCRF(*shared.value)
        for batch in batches:
            texts = [main_text(v.as_py(), crf) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [page_id, url, "text", "n_chars"]
            )

    return pages.select(F.col(page_id), F.col(url), F.col(html).cast("string")).mapInArrow(run, f"`{page_id}` {kinds[0]}, `{url}` {kinds[1]}, text string, n_chars long")
