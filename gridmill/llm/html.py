"""Main text of web pages by a recurrent block labeller (operator 9).

A page is read into its leaf blocks: runs of text between block-level tags, each with the path of its open elements (tags,
classes and ids). A block's vector is the mean of the learned vectors of its hashed path parts, the mean of those of its
hashed words, and a few sizes. A bidirectional LSTM in numpy reads the whole sequence of a page's blocks and labels each as
main text or not. The network is trained here, on pages that :func:`training_page` invents (article, menus, headers,
footers, sidebars, notices, adverts, forms, reader comments, in many mark-ups); no page of the corpus is used for it.

Pages are scanned once by position, and a path is a chain of nodes that blocks share, so time and memory grow with the
page's length only, however it is nested or broken.

Edge cases: null html is empty; a page without main text gives an empty text; broken and unclosed tags and comments are read
as browsers do without scripts; left out are the contents of script, style and textarea, of a title outside svg, and of a
select where it is ended; other elements (math, svg, object, noscript, template, iframe, ...) are read as any; repeated
pages each give a row; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, words_of

PATHS, WORDS, PATH_DIM, WORD_DIM, SIZES, HIDDEN = 4096, 4096, 16, 6, 4, 16
TRAIN_PAGES, EPOCHS, RATE, SEED = 800, 8, 0.01, 5

# Elements of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
# Left out as a whole, but only where it ends.
SKIPPED = "select"
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr object svg tspan".split())
INLINE |= frozenset("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics annotation".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
BOUNDS = frozenset("html body article section div main aside nav header footer table ul ol dl form blockquote td th".split())

_name = re.compile(r"[a-zA-Z][^\s/>]*")
_stop = re.compile(r"[>\"']")
_attr = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_part = re.compile(r"[a-z]+")


@lru_cache(maxsize=20_000)
def _element(tag: str, attributes: str) -> str:
    """An element's part of the path: its tag and the words of its class, id and role."""
    marks = [w for m in _attr.finditer(attributes) for w in _part.findall((m[2] or m[3] or m[4] or "").lower())]
    return " ".join([tag, *(f".{w}" for w in dict.fromkeys(marks))])


@lru_cache(maxsize=100)
def _end_of(tag: str):
    return re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I)


def _tag_end(page: str, at: int, dead: set[int]) -> int:
    """The place of the ``>`` that ends a tag, quoted ones left out, or -1. ``dead``: quotes from which none was found, shared by a page's tags."""
    seen = []
    while m := _stop.search(page, at):
        i = m.start()
        if page[i] == ">":
            return i
        seen.append(i)
        close = -1 if i in dead else page.find(page[i], i + 1)
        if close < 0:
            break
        at = close + 1
    dead.update(seen)
    return -1


def _tokens(page: str):
    """(text before, whether an end tag, name, attributes) of each tag, comments left out; at the end the rest of the text with an empty name. Raw elements are left out."""
    begun, at, parts, dead, svg, last = 0, 0, [], set(), 0, page.rfind(">")
    while (i := page.find("<", at)) >= 0:
        c = page[i + 1 : i + 2]
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            parts.append(page[begun:i])
            begun = at = end + 3 if end >= 0 else len(page)
            continue
        slash = c == "/"
        m = _name.match(page, i + 1 + slash)
        if not m:
            if c in ("!", "?", "/") and c:
                end = page.find(">", i)
                parts.append(page[begun:i])
                begun = at = end + 1 if end >= 0 else len(page)
            else:  # a plain character
                at = i + 1
            continue
        parts.append(page[begun:i])
        if m.end() > last:  # no tag ends from here on
            begun = len(page)
            break
        end = _tag_end(page, m.end(), dead)
        end = page.find(">", m.end()) if end < 0 else end
        begun = at = end + 1
        tag, attributes = m[0].lower(), page[m.end() : end]
        if tag in RAW and not slash and not (tag == "title" and svg):
            close = _end_of(tag).search(page, at)
            begun = at = close.end() if close else len(page)
            continue
        if tag == "svg":
            svg = max(0, svg - 1) if slash else svg + (not attributes.endswith("/"))
        yield "".join(parts), slash, tag, attributes
        parts = []
    parts.append(page[begun:])
    yield "".join(parts), False, "", ""


def _select_ends(tokens: list) -> dict[int, int]:
    """The place of each select and of the end tag that closes it."""
    begun, out = [], {}
    for i, (_, slash, tag, _) in enumerate(tokens):
        if tag == SKIPPED:
            if not slash:
                begun.append(i)
            elif begun:
                out[begun.pop()] = i
    return out


class Node:
    """An element on a block's path, below ``parent``."""

    __slots__ = ("parent", "part", "number")

    def __init__(self, parent: Node | None, part: str, number: int):
        self.parent, self.part, self.number = parent, part, number


class _Stack:
    """The open elements, and where each kind of them is, so that no look-up walks through all."""

    def __init__(self):
        self.tags, self.nodes, self.places = [], [None], {}
        self.bounds, self.outer, self.count = [], [], 0

    def top(self) -> Node | None:
        return self.nodes[-1]

    def last(self, tag: str) -> int:
        own = self.places.get(tag)
        return own[-1] if own else -1

    def push(self, tag: str, part: str) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        if tag in BOUNDS:
            self.bounds.append(len(self.tags))
        if tag not in INLINE:
            self.outer.append(len(self.tags))
        self.tags.append(tag)
        self.nodes.append(Node(self.nodes[-1], part, self.count))
        self.count += 1

    def cut(self, place: int) -> None:
        """Close the element at a place and all within it."""
        while len(self.tags) > place:
            tag = self.tags.pop()
            self.nodes.pop()
            self.places[tag].pop()
            if tag in BOUNDS:
                self.bounds.pop()
            if tag not in INLINE:
                self.outer.pop()

    def closed_by(self, tag: str) -> int:
        """The place of the open element that a new element of a name closes, or -1."""
        found = max([self.last(t) for t in CLOSES.get(tag, ())], default=-1)
        if tag in ENDS_P:
            found = max(found, self.last("p"))
        return found if found >= (self.bounds[-1] if self.bounds else 0) else -1


def blocks(page: str | None) -> list[tuple[Node | None, str, int]]:
    """(innermost open element, text, characters in links) of each leaf block with text, in page order."""
    out, stack, texts, node, linked = [], _Stack(), [], None, 0
    tokens = list(_tokens(page or ""))
    ends = _select_ends(tokens)

    def close():
        nonlocal texts, linked
        if texts:
            text = " ".join(entities.unescape("".join(texts)).split())
            if text:
                out.append((node, text, linked))
            texts, linked = [], 0

    def add(text):
        nonlocal node, linked
        if not text:
            return
        if not texts:
            if text.isspace():
                return
            node = stack.top()
        texts.append(text)
        if stack.last("a") >= 0:
            linked += len(text.strip())

    skip = -1
    for i, (text, slash, tag, attributes) in enumerate(tokens):
        if i <= skip:
            continue
        add(text)
        if not tag:
            continue
        if not slash:
            if tag == SKIPPED:
                skip = ends.get(i, -1)
                continue
            if tag == "br":
                if texts:
                    texts.append(" ")
                continue
            if tag not in INLINE:
                close()
            if tag in VOID:
                continue
            place = stack.closed_by(tag)
            if place >= 0:
                close()
                stack.cut(place)
            if not attributes.endswith("/"):
                stack.push(tag, _element(tag, attributes))
        else:
            if tag not in INLINE:
                close()
            place = stack.last(tag)
            if place >= 0 and (tag not in INLINE or place > (stack.outer[-1] if stack.outer else -1)):
                stack.cut(place)
    close()
    return out


@lru_cache(maxsize=50_000)
def _part_ids(part: str) -> tuple[int, ...]:
    return () if part.startswith(("html", "body")) else tuple(zlib.crc32(w.encode()) % PATHS for w in part.split())


def path_ids(node: Node | None) -> tuple[int, ...]:
    """The hashed parts of a whole path, outermost first; training needs them one by one."""
    parts = []
    while node is not None:
        parts.append(_part_ids(node.part))
        node = node.parent
    return tuple(i for ids in reversed(parts) for i in ids) or (0,)


def _path_means(nodes: list[Node | None], table: np.ndarray) -> np.ndarray:
    """The mean vector of each path's parts. Each node's sum is its parent's and its own parts', taken once."""
    sums: dict[int, tuple[np.ndarray, int]] = {}
    nothing = np.zeros(table.shape[1])
    out = np.empty((len(nodes), table.shape[1]), np.float32)
    for k, node in enumerate(nodes):
        chain = []
        while node is not None and node.number not in sums:
            chain.append(node)
            node = node.parent
        total, n = sums[node.number] if node is not None else (nothing, 0)
        for below in reversed(chain):
            if ids := _part_ids(below.part):
                total, n = total + table[list(ids)].sum(axis=0, dtype=np.float64), n + len(ids)
            sums[below.number] = (total, n)
        out[k] = total / n if n else table[0]
    return out


def vectors(found: list[tuple[Node | None, str, int]], weights: dict, parts: bool = False):
    """The blocks' input vectors; with ``parts`` also the hashed parts that they are made of, for training."""
    _, _, _, words, counts = words_of([t.lower().encode() for _, t, _ in found])
    words = (words % np.uint64(WORDS)).astype(np.int64)
    w = np.add.reduceat(weights["word"][words], np.cumsum(counts) - counts, axis=0) / counts[:, None]
    chars = np.array([len(t) for _, t, _ in found], np.float32)
    links = np.array([k for _, _, k in found], np.float32)
    sizes = np.stack([np.log1p(chars) / 6, np.minimum(1, links / chars), np.array([t[-1] in ".!?:\"'”»" for _, t, _ in found], np.float32), np.array([sum(map(t.count, ",.;")) for _, t, _ in found], np.float32) / chars * 10], 1)
    if not parts:
        return np.concatenate([_path_means([node for node, _, _ in found], weights["path"]), w, sizes], 1).astype(np.float32)
    paths = [path_ids(node) for node, _, _ in found]
    n = np.array([len(p) for p in paths])
    flat = np.fromiter((i for p in paths for i in p), np.int64, int(n.sum()))
    p = np.add.reduceat(weights["path"][flat], np.cumsum(n) - n, axis=0) / n[:, None]
    return np.concatenate([p, w, sizes], 1).astype(np.float32), [(flat, n), (words, counts)]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states over time of x (time, pages, inputs); pages that have ended hold their state."""
    hidden = np.zeros((x.shape[1], HIDDEN), np.float32)
    cell, out = hidden, np.empty((*x.shape[:2], HIDDEN), np.float32)
    into = x @ w + b
    for t in range(len(x)):
        z = into[t] + hidden @ u
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g, m = np.tanh(z[:, 3 * HIDDEN :]), mask[t][:, None]
        new = f * cell + i * g
        c = np.tanh(new)
        if keep is not None:
            keep.append((hidden, cell, i, f, o, g, c, m))
        cell = m * new + (1 - m) * cell
        hidden = m * (o * c) + (1 - m) * hidden
        out[t] = hidden
    return out


def _lstm_back(x, grads, keep, w, u):
    dw, du, db = np.zeros_like(w), np.zeros_like(u), np.zeros(4 * HIDDEN, np.float32)
    dx = np.zeros_like(x)
    dh, dc = np.zeros_like(grads[0]), np.zeros_like(grads[0])
    for t in range(len(x) - 1, -1, -1):
        hidden, cell, i, f, o, g, c, m = keep[t]
        dh = dh + grads[t]
        dnew = (dh * o * (1 - c * c) + dc) * m
        z = np.concatenate([dnew * g * i * (1 - i), dnew * cell * f * (1 - f), dh * m * c * o * (1 - o), dnew * i * (1 - g * g)], 1)
        dw += x[t].T @ z
        du += hidden.T @ z
        db += z.sum(0)
        dx[t] = z @ w.T
        dh = z @ u.T + dh * (1 - m)
        dc = dnew * f + dc * (1 - m)
    return dx, dw, du, db


def label(pages: list[np.ndarray], weights: dict) -> list[np.ndarray]:
    """The chance of being main text for each block of each page."""
    out: list = [np.zeros(0)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and stop - at < 256 and len(pages[order[stop]]) * (stop - at) <= 40_000:
            stop += 1
        own = order[at:stop]
        steps = max(len(pages[i]) for i in own)
        x, mask = np.zeros((steps, len(own), PATH_DIM + WORD_DIM + SIZES), np.float32), np.zeros((steps, len(own)), np.float32)
        for k, i in enumerate(own):
            x[: len(pages[i]), k] = pages[i]
            mask[: len(pages[i]), k] = 1
        ahead = _lstm(x, mask, weights["w0"], weights["u0"], weights["b0"])
        back = _lstm(x[::-1], mask[::-1], weights["w1"], weights["u1"], weights["b1"])[::-1]
        p = _sigmoid(np.concatenate([ahead, back, x], 2) @ weights["v"] + weights["c"])
        for k, i in enumerate(own):
            out[i] = p[: len(pages[i]), k]
        at = stop
    return out


def _sample_words(rng, n, hints=()):
    syllables = "an ber cor del en fo gra hin is jo ka lu mer no or pel qui ras sto tu un ver wa xi yo zen".split()
    words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(n)]
    for h in hints:
        if rng.random() < 0.5:
            words.insert(int(rng.integers(0, len(words) + 1)), h)
    return " ".join(words)


def training_page(rng: np.random.Generator) -> tuple[str, list[int]]:
    """An invented page and, for each of its blocks, 1 for main text and 0 for the rest."""
    labels: list[int] = []

    def pick(*options):
        return options[int(rng.integers(len(options)))]

    def block(tag, main, n, hints=(), link=False):
        labels.append(main)
        text = _sample_words(rng, max(1, n), hints) + pick(".", ".", "", "!", ",") * (1 if n > 4 or rng.random() < 0.2 else 0)
        if rng.random() < 0.7:
            text = text[0].upper() + text[1:]
        if link:
            text = f'<a href="/{len(labels)}">{text}</a>'
        elif main and rng.random() < 0.3:
            text = f"<{pick('b', 'em', 'a', 'span')}>{text}</{pick('b', 'em', 'a', 'span')}>"
        end = "" if tag in ("p", "li") and rng.random() < 0.25 else f"</{tag}>"
        return f"<{tag}>{text}{end}"

    def size(low, high):
        return int(rng.integers(low, high))

    def named(tag, *names):
        return f'<{tag} {pick("class", "class", "id")}="{pick(*names)}">' if names else f"<{tag}>"

    def menu():
        tag = pick("nav", "nav", "div", "ul")
        head = named(tag, "menu", "nav", "navbar", "navigation", "main-menu", "breadcrumb", "topnav") if tag != "nav" or rng.random() < 0.4 else "<nav>"
        items = "".join(block("li", 0, size(1, 3), ("home", "about", "contact"), True) for _ in range(size(2, 9)))
        return f"{head}<ul>{items}</ul></{tag}>" if tag != "ul" else f"{head}{items}</ul>"

    def header():
        tag = pick("header", "header", "div")
        return (("<header>" if tag == "header" else named("div", "header", "top", "site-header", "masthead", "banner")) + block(pick("div", "h1", "p", "span"), 0, size(1, 6)) + (menu() if rng.random() < 0.4 else "") + f"</{tag}>")

    def footer():
        tag = pick("footer", "footer", "footer", "div")
        body = "".join(block(pick("p", "div", "small", "span") if k else pick("p", "div"), 0, size(2, 16), ("copyright", "&copy;", "privacy", "terms")) + ("<hr>") for k in range(size(1, 4)))
        return (named(tag, "footer", "site-footer", "bottom", "copyright", "legal") if tag == "div" or rng.random() < 0.3 else "<footer>") + body + f"</{tag}>"

    def bare_footer():
        labels.append(0)
        return f"<footer>&copy; {_sample_words(rng, size(1, 3))} &middot; {_sample_words(rng, size(4, 12))}.</footer>"

    def advert():
        labels.append(0)
        return named(pick("div", "div", "aside", "section", "ins"), "ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "ad-slot") + _sample_words(rng, size(2, 25), ("buy", "offer")) + "." + "</div></aside></section></ins>"

    def notice():
        labels.append(0)
        return named(pick("div", "section", "p"), "notice", "cookie", "cookie-notice", "consent", "alert", "popup", "modal", "newsletter", "subscribe", "disclaimer", "warning") + _sample_words(rng, size(3, 25), ("cookies", "accept", "subscribe")) + ".</div></section></p>"

    def sidebar():
        tag = pick("aside", "aside", "div")
        body = "".join(block(pick("li", "p", "h3", "a"), 0, size(1, 14), ("related", "popular"), rng.random() < 0.5) + "<hr>" for _ in range(size(1, 6)))
        return ("<aside>" if tag == "aside" and rng.random() < 0.6 else named(tag, "sidebar", "side", "related", "widget", "recommended", "more", "share", "social", "tags")) + body + f"</{tag}>"

    def form():
        body = "".join(block(pick("label", "p", "button", "legend", "div"), 0, size(1, 7), ("name", "email", "search", "send")) + "<input><br><hr>" for _ in range(size(1, 4)))
        return pick("<form>", named("form", "search", "login", "signup", "contact")) + body + "</form>"

    def comments():
        tag = pick("section", "div", "ul", "ol")
        one = "li" if tag in ("ul", "ol") else pick("div", "p", "article")
        body = "".join(f'<{one} {pick("", "class=comment", "class=reply", "class=comment-body")}>' + block("p", 0, size(2, 50), ("reply",)) + f"</p></{one}>" for _ in range(size(1, 6)))
        head = block("h3", 0, size(1, 3), ("comments",)) if rng.random() < 0.5 else ""
        return named(tag, "comments", "comment-list", "reader-comments", "discussion", "responses", "replies", "disqus") + head + body + f"</{tag}>"

    def content():
        out = [block(pick("h1", "h1", "h2"), 1, size(2, 14))] if rng.random() < 0.9 else []
        for _ in range(size(1, 14)):
            r = rng.random()
            if r < 0.7:
                out.append(block("p", 1, size(1, 90)))
            elif r < 0.78:
                out.append(block(pick("h2", "h3", "h4"), 1, size(1, 8)))
            elif r < 0.84:
                out.append("<ul>" + "".join(block("li", 1, size(1, 20)) for _ in range(size(1, 5))) + "</ul>")
            elif r < 0.9:
                out.append(block(pick("blockquote", "pre", "div", "figcaption"), 1, size(3, 40)))
            elif r < 0.94:
                out.append("<table><tr>" + "".join(block("td", 1, size(1, 6)) for _ in range(size(1, 5))) + "</tr></table>")
            else:
                out.append(pick(advert, sidebar, notice, form)())
        if rng.random() < 0.15:
            out.append(pick(comments, sidebar)())
        return "".join(out)

    parts = ["<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var a='</p>';</script></head><body>"]
    before = [f for f, p in ((header, 0.5), (menu, 0.8), (notice, 0.3), (advert, 0.6), (form, 0.2)) if rng.random() < p]
    rng.shuffle(before)
    parts += [f() for f in before]
    wrap = pick("<article>", "<article>", "<article>", "<main><article>", '<article class="post">', "<main>", '<div class="content">', '<div id="article-body">', '<section class="story">', '<div class="entry">')
    outer = pick("", "", '<div class="container">', '<div class="wrapper">', '<div id="page">')
    parts += [outer, wrap, content(), "</div></section>" if wrap.startswith(("<div", "<section")) else "</article>", "</main>" if "<main>" in wrap else ""]
    after = [f for f, p in ((sidebar, 0.4), (comments, 0.5), (form, 0.2), (advert, 0.3), (notice, 0.2)) if rng.random() < p]
    rng.shuffle(after)
    parts += [f() for f in after]
    parts += ["</div>" if outer else "", pick(footer, bare_footer)() if rng.random() < 0.9 else "", pick("</body></html>", "")]
    return "".join(parts), labels


@lru_cache(maxsize=4)
def train(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """Weights learned from invented pages by Adam on the blocks' cross-entropy; the same weights for the same arguments."""
    rng = np.random.default_rng(seed)
    size = PATH_DIM + WORD_DIM + SIZES

    def start(*shape, scale=0.2):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    # Parts and words that training doesn't meet stay at zero and say nothing.
    weights = {"path": np.zeros((PATHS, PATH_DIM), np.float32), "word": np.zeros((WORDS, WORD_DIM), np.float32), "v": start(2 * HIDDEN + size), "c": np.zeros(1, np.float32)}
    for d in "01":
        weights |= {f"w{d}": start(size, 4 * HIDDEN), f"u{d}": start(HIDDEN, 4 * HIDDEN), f"b{d}": np.zeros(4 * HIDDEN, np.float32)}
    made = []
    while len(made) < pages:
        page, labels = training_page(rng)
        found = blocks(page)
        if len(found) == len(labels):  # mark-up that a reader cuts into other blocks is not used
            made.append((found, np.array(labels, np.float32)))
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(made))
        for i in range(0, len(order), 20):
            own = sorted((made[k] for k in order[i : i + 20]), key=lambda p: len(p[0]))
            step += 1
            grads = _gradients(own, weights)
            for k, g in grads.items():
                a, b = moment[k]
                a *= 0.9
                a += 0.1 * g
                b *= 0.99
                b += 0.01 * g * g
                weights[k] -= (RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return weights


def _gradients(own, weights):
    steps, size = len(own[-1][0]), PATH_DIM + WORD_DIM + SIZES
    x, mask, y = np.zeros((steps, len(own), size), np.float32), np.zeros((steps, len(own)), np.float32), np.zeros((steps, len(own)), np.float32)
    parts = []
    for k, (found, labels) in enumerate(own):
        x[: len(found), k], ids = vectors(found, weights, parts=True)
        if k % 4:  # three of four pages in a step are learned by their paths alone, so that words don't take over
            x[:, k, PATH_DIM : PATH_DIM + WORD_DIM] = 0
        mask[: len(found), k], y[: len(found), k] = 1, labels
        parts.append(ids)
    ahead_kept, back_kept = [], []
    ahead = _lstm(x, mask, weights["w0"], weights["u0"], weights["b0"], ahead_kept)
    back = _lstm(x[::-1], mask[::-1], weights["w1"], weights["u1"], weights["b1"], back_kept)[::-1]
    top = np.concatenate([ahead, back, x], 2)
    d = (_sigmoid(top @ weights["v"] + weights["c"]) - y) * mask / mask.sum()
    grads = {"v": np.einsum("tp,tpk->k", d, top), "c": np.array([d.sum()], np.float32)}
    dtop = d[:, :, None] * weights["v"]
    dx, grads["w0"], grads["u0"], grads["b0"] = _lstm_back(x, dtop[:, :, :HIDDEN], ahead_kept, weights["w0"], weights["u0"])
    rx, grads["w1"], grads["u1"], grads["b1"] = _lstm_back(x[::-1], dtop[::-1, :, HIDDEN : 2 * HIDDEN], back_kept, weights["w1"], weights["u1"])
    dx = dx + rx[::-1] + dtop[:, :, 2 * HIDDEN :]
    grads["path"], grads["word"] = np.zeros_like(weights["path"]), np.zeros_like(weights["word"])
    for k, ((flat, n), (words, counts)) in enumerate(parts):
        own_dx = dx[: len(n), k]
        np.add.at(grads["path"], flat, np.repeat(own_dx[:, :PATH_DIM] / n[:, None], n, axis=0))
        np.add.at(grads["word"], words, np.repeat((k % 4 == 0) * own_dx[:, PATH_DIM : PATH_DIM + WORD_DIM] / counts[:, None], counts, axis=0))
    return grads


def extract(pages: list[str | None], weights: dict) -> list[str]:
    """The main text of each page: its main blocks in page order, joined by one space."""
    found = [blocks(p) for p in pages]
    chances = label([vectors(b, weights) if b else np.zeros((0, 1)) for b in found], weights)
    return [" ".join(t for (_, t, _), p in zip(b, c, strict=True) if p >= 0.5) for b, c in zip(found, chances, strict=True)]


def _extract(weights, html: str):
    def run(batches):
        for batch in slices(batches, html):
            texts = extract(batch.column(html).to_pylist(), weights.value)
            yield pa.RecordBatch.from_arrays([*(c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != html), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*(n for n in batch.schema.names if n != html), "text", "n_chars"])

    return run


def main_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns of each page, its main ``text`` and ``n_chars``."""
    weights = pages.sparkSession.sparkContext.broadcast(train())
    fields = ", ".join(f"`{n}` {pages.schema[n].dataType.simpleString()}" for n in keep)
    return pages.select(*keep, F.col(html)).mapInArrow(_extract(weights, html), f"{fields}, text string, n_chars long")


def op9_html(spark, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
