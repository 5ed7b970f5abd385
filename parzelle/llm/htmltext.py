"""Main text of web pages by a recurrent block labeller.

A page is read as the sequence of its leaf blocks: runs of text between block-level
tags, each with the path of tags (and the words of their class, id and role) above it.
A bidirectional LSTM in numpy reads, for every block, the vectors of its path and of its
hashed words and a few shares, and labels it as main text or not; both directions see
the whole page, so a block is judged in the context of the document.

The labeller is trained here. Where the main text of a page is marked by its tags
(``article`` or ``main``), the blocks inside and outside are known, and from a bounded
sample of such blocks new pages are built in many layouts: other containers and class
names, menus, sidebars, notices, adverts, forms, comments. The labels of those pages are
known by construction.

Defined cases: null and empty pages have the empty text; scripts, styles, comments and
the head have none; tags that are never closed, closed twice or cut off are read like a
browser would, which ends an open head at the first tag or text that can't be in one. A
never-closed button, select, drawing or player, in which a browser would leave all that
follows, ends at the next block instead, so that no text is lost to it; pages whose
blocks all count as furniture give the empty text. Without any page to learn from a
page's blocks are judged by the layouts alone. Repeated rows are rows of their own; pages
of any length are read whole, in time linear in their length. Extra columns are not read.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most pages the labeller learns from, by a hash of the id, and most characters of one.
EXAMPLES = 300
EXAMPLE_CHARS = 20_000
LAYOUTS = 700
PATHS, WORDS = 512, 512
PATH_SIZE, WORD_SIZE, HIDDEN = 16, 8, 20

# The tags of HTML by the role they play in a text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins "
                   "kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup "
                   "time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup "
                   "msubsup munder mover munderover mstyle mspace mpadded mphantom menclose "
                   "mtable mtr mtd semantics".split())
SILENT = frozenset("script style noscript template head title svg iframe object canvas "
                   "audio video select textarea datalist button annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe")
#: Fixed value: tags that leave an open head open.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style "
                    "template title".split())
#: Silent tags that the next block ends if they are never closed.
ENDED_BY_BLOCKS = frozenset("svg object canvas audio video select datalist button".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figure footer "
                           "form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul "
                           "li dd dt tr td th".split())
#: Fixed value: tags that end an open one of their kind, and up to which tag.
SIBLINGS = {"li": ({"li"}, {"ul", "ol"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table"}),
            "th": ({"td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
            "button": ({"button"}, {"template", "object", "table", "td", "th"}),
            "select": ({"select"}, {"template", "object", "table", "td", "th"})}

#: What stands between a tag's name and its end. A quote opens a value only right after the
#: equals sign; elsewhere it is a character like any other, and one that is never
#: closed too. Nothing is tried twice, so the time is linear.
ATTRIBUTES = r"""(?>[^\s>=/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]*))?|[\s/]|=)*+"""
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(" + ATTRIBUTES + r")(?:>|\Z)",
    re.DOTALL | re.IGNORECASE)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
PART = re.compile(r"[a-z]+|\d+")


class Block:
    """A leaf block: its text, the tags and names above it (each once, the innermost part also
    with ``^`` before it) and how much of it is links."""

    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple[str, ...], linked: float):
        self.text, self.path, self.linked = text, path, linked


def _below(path: tuple[str, ...], parts: tuple[str, ...]) -> tuple[str, ...]:
    """A path with more parts; paths of equal parts are one object however deep they are."""
    new = tuple(dict.fromkeys(p for p in parts if p not in path))
    return (*path, *new) if new else path


def _names(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    found = " ".join(a or b or c for a, b, c in NAMES.findall(attributes))
    return tuple("." + w for w in PART.findall(found.lower())) if found else ()


def _plain(text: str) -> str:
    """Character references decoded, runs of white space one space."""
    return " ".join((html.unescape(text) if "&" in text else text).split())


def _never_closed(tokens: Sequence[re.Match]) -> set[int]:
    """Where the tags of ``ENDED_BY_BLOCKS`` start that have no end tag."""
    opened: dict[str, list[int]] = {}
    for token in tokens:
        tag = (token.group(3) or "").lower()
        if tag not in ENDED_BY_BLOCKS or token.group(4).endswith("/"):
            continue
        if not token.group(2):
            opened.setdefault(tag, []).append(token.start())
        elif opened.get(tag):
            opened[tag].pop()
    return {at for places in opened.values() for at in places}


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in its order."""
    out: list[Block] = []
    tokens = list(TOKEN.finditer(page))
    endless = _never_closed(tokens)
    # open tags: (tag, parts of the path down to it, innermost part, inside a link, silent,
    # ended by the next block), and how many there are of each
    top = ("", (), "", False, False, False)
    stack = [top]
    open_tags: Counter[str] = Counter()
    ended = 0
    pieces: list[str] = []
    linked, path = 0, ((), "")

    def flush():
        nonlocal linked
        text = _plain("".join(pieces))
        if text:
            out.append(Block(text, (*path[0], "^" + path[1]), min(1.0, linked / len(text))))
        pieces.clear()
        linked = 0

    def take(text: str):
        nonlocal linked, path
        if stack[-1][0] == "head" and text and not text.isspace():
            close(len(stack) - 1)
        _, above, inner, link, silent, _ = stack[-1]
        if silent or not text:
            return
        if not text.isspace():
            if not any(not p.isspace() for p in pieces):
                path = above, inner
            if link:
                linked += len(text.strip())
        pieces.append(text)

    def close(depth: int):
        nonlocal ended
        while len(stack) > depth:
            last = stack.pop()
            open_tags[last[0]] -= 1
            ended -= last[5]
            if last[0] not in INLINE:
                flush()

    def deepest(tag: str) -> int:
        """The place of the innermost open tag of a kind, 0 without one."""
        return next((d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == tag), 0) if open_tags[tag] else 0

    at = 0
    for token in tokens:
        take(page[at:token.start()])
        at = token.end()
        tag = token.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if token.group(2):
            depth = deepest(tag)
            if depth:
                close(depth)
            elif tag not in INLINE:
                flush()
            continue
        if stack[-1][0] == "head":
            if tag == "head":
                continue
            if tag not in IN_HEAD:
                close(len(stack) - 1)
        if tag == "br":
            take(" ")
            continue
        if tag in ENDS_PARAGRAPH:
            flush()
            for d in range(len(stack) - 1, 0, -1) if ended else ():
                if stack[d][5]:
                    close(d)
                elif stack[d][0] in SILENT:
                    break
            depth = deepest("p")
            if depth:
                close(depth)
        if tag in SIBLINGS and any(open_tags[k] for k in SIBLINGS[tag][0]):
            kinds, limits = SIBLINGS[tag]
            for d in range(len(stack) - 1, 0, -1):
                if stack[d][0] in limits:
                    break
                if stack[d][0] in kinds:
                    close(d)
                    break
        if tag not in INLINE:
            flush()
        if tag in VOID or token.group(4).endswith("/") and tag not in ENDS_PARAGRAPH:
            continue
        _, above, inner, link, silent, _ = stack[-1]
        if tag not in INLINE:
            parts = (tag, *_names(token.group(4)))
            above, inner = _below(above, parts), parts[-1]
        stack.append((tag, above, inner, link or tag == "a", silent or tag in SILENT,
                      token.start() in endless))
        open_tags[tag] += 1
        ended += stack[-1][5]
    # a tag that is cut off at the end of the page is no text
    rest = page[at:]
    cut = rest.rfind("<")
    take(rest[:cut] if cut >= 0 and ">" not in rest[cut:] and re.match(r"<[/!a-zA-Z]", rest[cut:])
         else rest)
    flush()
    return out


class _Hashed(dict):
    """Buckets of words, remembered."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.buckets
        return value


NUMBERS = 9


#: Part of a path that stands for a name the labeller has not learned.
STRANGE = ".?"


def encode(page: Sequence[Block], path_bucket: _Hashed, word_bucket: _Hashed,
           names: frozenset[str] = frozenset()):
    """The path buckets and word buckets of every block, and its numbers; names (of classes,
    ids and roles) other than ``names`` are all the same strange one."""
    def known(part: str) -> str:
        name = part.removeprefix("^")
        return part if name[:1] != "." or name in names else part[:-len(name)] + STRANGE
    paths, words = [], []
    numbers = np.zeros((len(page), NUMBERS), np.float32)
    for i, b in enumerate(page):
        paths.append([path_bucket[p] for p in dict.fromkeys(map(known, b.path))])
        split = b.text.lower().split()
        words.append([word_bucket[w] for w in split])
        n = len(b.text)
        numbers[i] = (np.log1p(len(split)) / 4, b.linked, min(1, n / max(len(split), 1) / 12),
                      sum(map(b.text.count, ".,;:!?")) / n * 10, sum(map(str.isdigit, b.text)) / n
                      if n < 200 else 0, i / len(page), b.text[-1] in ".!?…»\"”", i == 0,
                      i == len(page) - 1)
    return paths, words, numbers


def _means(lists: Sequence[Sequence[int]], vectors: np.ndarray) -> np.ndarray:
    """The average of the vectors of each list (zeros for an empty one)."""
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((x for part in lists for x in part), np.int64, int(size.sum()))
    total = np.zeros((len(flat) + 1, vectors.shape[1]))
    np.cumsum(vectors[flat], axis=0, out=total[1:])
    end = np.cumsum(size)
    return ((total[end] - total[end - size]) / np.maximum(size, 1)[:, None]).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Vectors of path parts and words, an LSTM for each direction, and a logistic unit."""

    def __init__(self, seed: int = 3):
        #: The names that it has learned; others are strange to it.
        self.names: frozenset[str] = frozenset()
        r = np.random.default_rng(seed)
        size = PATH_SIZE + WORD_SIZE + NUMBERS
        self.p = {"path": r.normal(0, 0.3, (PATHS, PATH_SIZE)),
                  "word": r.normal(0, 0.1, (WORDS, WORD_SIZE)),
                  "out": r.normal(0, 0.2, (2 * HIDDEN + size, 1)), "bias": np.zeros(1)}
        for d in "fb":
            self.p["w" + d] = r.normal(0, (size + HIDDEN) ** -0.5, (size + HIDDEN, 4 * HIDDEN))
            self.p["c" + d] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, x: np.ndarray, live: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States of one direction over (time, page, input); padding leaves them as they are."""
        w, c = self.p["w" + d], self.p["c" + d]
        steps, n, _ = x.shape
        h = np.zeros((n, HIDDEN), np.float32)
        s = np.zeros_like(h)
        out = np.zeros((steps, n, HIDDEN), np.float32)
        into = x @ w[:x.shape[2]] + c
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = into[t] + h @ w[x.shape[2]:]
            gate = _sigmoid(z[:, :3 * HIDDEN])
            i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN:2 * HIDDEN], gate[:, 2 * HIDDEN:]
            g = np.tanh(z[:, 3 * HIDDEN:])
            on = live[t][:, None]
            new = f * s + i * g
            deep = np.tanh(new)
            if keep is not None:
                keep.append((t, h, s, i, f, o, g, deep, on))
            h, s = np.where(on, o * deep, h), np.where(on, new, s)
            out[t] = h
        return out

    def _back(self, x: np.ndarray, kept: list, pull: np.ndarray, d: str, grads: dict) -> np.ndarray:
        w = self.p["w" + d]
        size = x.shape[2]
        dh = np.zeros(pull.shape[1:], np.float32)
        ds = np.zeros_like(dh)
        dx = np.zeros_like(x)
        dw = np.zeros_like(w)
        dc = np.zeros(4 * HIDDEN, np.float32)
        for t, h, s, i, f, o, g, deep, on in reversed(kept):
            dh = dh + pull[t]
            dn = (ds + dh * o * (1 - deep ** 2)) * on
            dz = np.concatenate([dn * g * i * (1 - i), dn * s * f * (1 - f),
                                 dh * deep * o * (1 - o) * on, dn * i * (1 - g ** 2)], 1)
            dw[:size] += x[t].T @ dz
            dw[size:] += h.T @ dz
            dc += dz.sum(0)
            dx[t] = dz @ w[:size].T
            dh = np.where(on, dz @ w[size:].T, dh)
            ds = np.where(on, dn * f, ds)
        grads["w" + d], grads["c" + d] = dw, dc
        return dx

    def _inputs(self, pages):
        """(time, page, input) and which of its places are blocks."""
        steps = max(len(n) for _, _, n in pages)
        x = np.zeros((steps, len(pages), PATH_SIZE + WORD_SIZE + NUMBERS), np.float32)
        live = np.zeros((steps, len(pages)), bool)
        paths = _means([p for page in pages for p in page[0]], self.p["path"])
        words = _means([w for page in pages for w in page[1]], self.p["word"])
        at = 0
        for k, (_, _, numbers) in enumerate(pages):
            n = len(numbers)
            x[:n, k] = np.concatenate([paths[at:at + n], words[at:at + n], numbers], 1)
            live[:n, k] = True
            at += n
        return x, live

    def logits(self, pages, keep: dict | None = None) -> list[np.ndarray]:
        """The log-odds of every block of pages with at least one."""
        x, live = self._inputs(pages)
        kept = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        both = [self._run(x, live, d, kept[d]) for d in "fb"]
        top = np.concatenate([*both, x], 2)
        z = (top @ self.p["out"])[:, :, 0] + self.p["bias"]
        if keep is not None:
            keep.update(x=x, live=live, kept=kept, top=top, z=z)
        return [z[:len(n), k] for k, (_, _, n) in enumerate(pages)]

    def gradients(self, pages, labels: Sequence[np.ndarray]) -> dict[str, np.ndarray]:
        state: dict = {}
        self.logits(pages, state)
        x, live, z = state["x"], state["live"], state["z"]
        y = np.zeros_like(z)
        for k, part in enumerate(labels):
            y[:len(part), k] = part
        dz = np.where(live, _sigmoid(z) - y, 0)[:, :, None] / live.sum()
        grads = {"out": np.einsum("tnk,tno->ko", state["top"], dz), "bias": dz.sum((0, 1))}
        dtop = dz @ self.p["out"].T
        dx = dtop[:, :, 2 * HIDDEN:]
        for k, d in enumerate("fb"):
            dx = dx + self._back(x, state["kept"][d], dtop[:, :, k * HIDDEN:(k + 1) * HIDDEN], d, grads)
        rows = np.concatenate([dx[:len(n), k] for k, (_, _, n) in enumerate(pages)])
        for name, part, a, b in (("path", 0, 0, PATH_SIZE), ("word", 1, PATH_SIZE, PATH_SIZE + WORD_SIZE)):
            grads[name] = np.zeros_like(self.p[name])
            lists = [p for page in pages for p in page[part]]
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter((v for p in lists for v in p), np.int64, int(size.sum()))
            share = rows[:, a:b] / np.maximum(size, 1)[:, None]
            np.add.at(grads[name], flat, np.repeat(share, size, 0))
        return grads

    def train(self, pages, labels, rounds: int = 5, batch: int = 20, rate: float = 0.02,
              seed: int = 4) -> None:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        total = rounds * -(-len(pages) // batch)
        for _ in range(rounds):
            order = r.permutation(len(pages))
            for a in range(0, len(order), batch):
                part = order[a:a + batch]
                grads = self.gradients([pages[i] for i in part], [labels[i] for i in part])
                step += 1
                speed = rate * (1 - step / (total + 1))
                for k, g in grads.items():
                    g = np.clip(g, -1, 1)
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.p[k] -= (speed * (m[k] / (1 - 0.9 ** step))
                                  / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)

    def main_text(self, pages: Sequence[Sequence[Block]], buckets) -> list[str]:
        """The blocks labelled as main text of each page, a line each."""
        out = [""] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            # pages of like length together, a bounded number of places at once
            end = at + 1
            while (end < len(order) and end - at < 128
                   and (end - at + 1) * len(pages[order[end]]) <= 8_192):
                end += 1
            part = [pages[i] for i in order[at:end]]
            for i, page, z in zip(order[at:end], part,
                                  self.logits([encode(p, *buckets, self.names) for p in part]), strict=True):
                out[i] = "\n".join(b.text for b, v in zip(page, z, strict=True) if v > 0)
            at = end
        return out


# What the built pages are made of: containers of the main text, and the furniture of web
# pages by the names that authors give it.
CONTAINERS = ("<article>", "<main>", "<main><article>", '<div class="content">', '<div id="content">',
              '<div class="post-content">', '<div class="entry-content">', '<div class="article-body">',
              '<section class="article">', '<div id="main"><div class="post">', '<div role="main">',
              '<article class="post">', '<div class="story-body">', '<td class="main">',
              '<main id="main"><div class="text">', '<div class="page"><article class="entry">')
FURNITURE = {
    "menu": ("<nav>", '<div class="menu">', '<ul class="nav">', '<div id="navigation">',
             '<div class="navbar">', '<nav class="breadcrumb">', '<div class="breadcrumbs">',
             '<div class="main-menu">', '<div class="pagination">', '<div class="toc">',
             '<div role="navigation">'),
    "header": ("<header>", '<div class="header">', '<div id="masthead">', '<div class="banner">',
               '<div class="site-header">', '<header class="top">', '<div role="banner">'),
    "footer": ("<footer>", '<div class="footer">', '<div id="footer">', '<div class="copyright">',
               '<div class="site-footer">', '<div role="contentinfo">', '<footer class="legal">'),
    "side": ("<aside>", '<div class="sidebar">', '<div id="sidebar">', '<aside class="widget">',
             '<div class="related">', '<div class="recommended">', '<div class="widget-area">',
             '<div class="popular-posts">', '<aside class="related-posts">', '<div class="teaser">'),
    "notice": ('<div class="cookie-notice">', '<div id="cookie-banner">', '<div class="notice">',
               '<div class="consent">', '<div class="gdpr">', '<div class="alert">',
               '<div class="newsletter">', '<div class="subscribe">', '<div class="popup">',
               '<div class="modal">', '<div role="alert">', '<div class="disclaimer">'),
    "advert": ('<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="sponsored">',
               '<div id="ad-top">', '<div class="promo">', '<aside class="advertisement">',
               '<div class="ad-banner">', '<div class="sponsor">', '<section class="promotion">'),
    "form": ("<form>", '<form class="search">', '<form id="login">', '<div class="contact-form"><form>'),
    "comments": ('<div class="comments">', '<section id="comments">', '<div class="comment">',
                 '<ol class="comment-list">', '<div class="replies">', '<div id="disqus-thread">',
                 '<div class="comments-area">', '<section class="responses">', '<div class="reviews">',
                 '<div class="discussion">'),
    "share": ('<div class="share">', '<div class="social">', '<div class="tags">', '<div class="byline">',
              '<div class="author-bio">', '<div class="meta">'),
}
SHORT = ("menu", "header", "footer", "advert", "form", "share")


def _ends(opening: str) -> str:
    return "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opening)))


def build_page(main: Sequence[str], other: Sequence[str], r: np.random.Generator
               ) -> tuple[str, list[bool]]:
    """A page in a random layout and the label of each of its blocks."""
    parts: list[str] = []
    labels: list[bool] = []

    def pick(texts: Sequence[str], most: int) -> str:
        words = texts[r.integers(len(texts))].split()
        if len(words) > most:
            at = int(r.integers(len(words) - most + 1))
            words = words[at:at + most]
        return html.escape(" ".join(words), quote=False)

    def put(text: str, tag: str, label: bool):
        if not text:
            return
        if r.random() < 0.15 and tag == "p":
            text = f"<b>{text}"
        parts.append(f"<{tag}>{text}" + (f"</{tag}>" if r.random() < 0.95 else ""))
        labels.append(label)

    def furniture(kind: str):
        opening = FURNITURE[kind][r.integers(len(FURNITURE[kind]))]
        parts.append(opening)
        if kind in ("menu", "share") or kind in ("side", "footer", "header") and r.random() < 0.5:
            parts.append("<ul>")
            for _ in range(r.integers(2, 8)):
                word = pick(other, int(r.integers(1, 4)))
                if word:
                    parts.append(f'<li><a href="/x">{word}</a></li>')
                    labels.append(False)
            parts.append("</ul>")
        elif kind == "form":
            parts.append("<div>")
            put(pick(other, 6), "p", False)
            parts.append('<input name="q"><button>Go</button></div>')
        else:
            for _ in range(r.integers(1, 3 if kind in SHORT else 6)):
                long = kind not in SHORT and r.random() < 0.6
                source = main if r.random() < 0.7 else other
                put(pick(source, int(r.integers(8, 80 if long else 20))),
                    ("p", "div", "h3", "span")[r.choice(4, p=(0.55, 0.25, 0.15, 0.05))], False)
                if r.random() < 0.2:
                    parts.append("<div>")
                    put(pick(other, 5), "p", False)
                    parts.append("</div>")
        parts.append(_ends(opening))

    wrap = ("", '<div id="wrapper">', '<div class="container"><div class="row">',
            '<table><tr><td>', '<div class="site">')[r.integers(5)]
    parts.append(wrap)
    for kind in ("notice", "header", "menu", "advert", "form", "side"):
        if r.random() < (0.8 if kind == "menu" else 0.35):
            furniture(kind)
    container = CONTAINERS[r.integers(len(CONTAINERS))]
    if container.startswith("<td"):
        container = "<table><tr>" + container
    parts.append(container)
    if r.random() < 0.8:
        put(pick(main, int(r.integers(3, 15))), ("h1", "h2")[r.integers(2)], True)
    if r.random() < 0.25:
        furniture("share")
    for i in range(int(r.integers(1, 14))):
        kind = r.random()
        if kind < 0.06:
            furniture(("advert", "side", "notice", "share")[r.integers(4)])
        elif kind < 0.14:
            parts.append("<ul>")
            for _ in range(r.integers(1, 5)):
                put(pick(main, int(r.integers(2, 25))), "li", True)
            parts.append("</ul>")
        elif kind < 0.22 and i:
            put(pick(main, int(r.integers(2, 10))), ("h2", "h3")[r.integers(2)], True)
        elif kind < 0.27:
            parts.append("<blockquote>")
            put(pick(main, int(r.integers(5, 50))), "p", True)
            parts.append("</blockquote>")
        else:
            put(pick(main, int(r.choice((4, 12, 40, 120)))), "p", True)
    if r.random() < 0.25:
        furniture(("share", "comments")[r.integers(2)])
    parts.append(_ends(container))
    for kind in ("share", "comments", "side", "advert", "form", "notice", "footer"):
        if r.random() < (0.8 if kind == "footer" else 0.3):
            furniture(kind)
    parts.append(_ends(wrap))
    return "<html><body>" + "".join(parts) + "</body></html>", labels


#: Names of what stands within an article without being part of it.
BESIDE = frozenset(n for kind in ("side", "notice", "advert", "comments", "share")
                   for opening in FURNITURE[kind] for n in _names(opening))


def _marked(page: Sequence[Block]) -> np.ndarray | None:
    """Which blocks lie in the element that marks the main text, if there is one."""
    inside = np.array([bool({"article", "main"} & set(b.path)) for b in page], bool)
    furniture = np.array([bool(({"nav", "footer", "aside", "form"} | BESIDE) & set(b.path))
                          for b in page], bool)
    return inside & ~furniture if inside.any() else None


#: Tags that say what they hold.
TELLING = frozenset("article main nav aside footer header".split())
#: Fixed value: text for built pages where there is none to learn from.
PLAIN = ("Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor "
         "incididunt ut labore et dolore magna aliqua.",)


def learn(pages: Sequence[str], layouts: int = LAYOUTS, seed: int = 6) -> Labeller:
    """Train a labeller on pages as they are, where marked, and in built layouts."""
    r = np.random.default_rng(seed)
    main, other, found, labels = [], [], [], []
    for page in pages:
        parsed = blocks(page)
        marks = _marked(parsed) if parsed else None
        if marks is not None:
            found.append(parsed)
            labels.append(marks)
            main += [b.text for b, m in zip(parsed, marks, strict=True) if m]
            other += [b.text for b, m in zip(parsed, marks, strict=True) if not m]
    main, other = main or list(PLAIN), other or list(PLAIN)
    marked = len(found)
    for _ in range(layouts):
        page, known = build_page(main, other, r)
        parsed = blocks(page)
        if len(parsed) == len(known):  # markup that joins or drops a block teaches nothing
            found.append(parsed)
            labels.append(np.array(known))
    labeller = Labeller()
    labeller.names = frozenset(p for page in found for b in page for p in b.path if p[0] == ".")
    buckets = _Hashed(PATHS), _Hashed(WORDS)
    on = [i for i, p in enumerate(found) if p]
    # Pages as they are are learned so, and once more like the built ones: names are
    # withheld from half of those and some from the others, and so are the tags that name
    # the main text. What a block is must show in where it stands, how long it is and how
    # much of it is links.
    encoded = [encode(found[i], *buckets, labeller.names) for i in on if i < marked]
    on = [i for i in on if i < marked] + on
    for i in on[len(encoded):]:
        share = 1.0 if r.random() < 0.5 else 0.3
        kept = frozenset(n for n in sorted(labeller.names) if r.random() >= share)
        page = found[i]
        if r.random() < 0.4:
            page = [Block(b.text, tuple(p for p in b.path if p.removeprefix("^") not in TELLING), b.linked)
                    for b in page]
        encoded.append(encode(page, *buckets, kept))
    labeller.train(encoded, [labels[i] for i in on])
    return labeller


def examples(pages: DataFrame, most: int = EXAMPLES) -> list[str]:
    """A bounded sample of pages, by a hash of their id.

    The ids are chosen first, so that no task sends pages that aren't among them.
    """
    by_hash = (F.xxhash64("page_id"), F.col("page_id"))
    chosen = (pages.select("page_id").where("page_id is not null").distinct()
              .orderBy(*by_hash).limit(most))
    rows = (pages.select("page_id", "html").join(F.broadcast(chosen), "page_id")
            .where(F.length("html") <= EXAMPLE_CHARS)
            .orderBy(*by_hash, F.xxhash64("html")).limit(most).collect())
    return [r["html"] for r in rows]


def extract(pages: DataFrame, labeller: Labeller, keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, ``text`` and ``n_chars`` of every page."""
    shared = pages.sparkSession.sparkContext.broadcast((labeller.p, labeller.names))
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(tables):
        model = Labeller()
        model.p, model.names = shared.value
        buckets = _Hashed(PATHS), _Hashed(WORDS)
        for rows in tables:
            for at in range(0, rows.num_rows, 512):
                part = rows.slice(at, 512)
                texts = model.main_text([blocks(h.as_py() or "") for h in part.column("html")], buckets)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return pages.select(*keep, "html").mapInArrow(run, f"{schema}, text string, n_chars long")
