"""Main text of web pages by a recurrent block labeller.

A page is cut into its text blocks (what block-level elements bound). Each block
becomes a vector: its tag path (element names, class, id and role words of all open
elements) and its words, both hashed, and a few numbers such as length and link
share. A bidirectional LSTM in numpy reads a page's blocks in order, so every block
is labelled with the whole page as context; kept blocks are the main text.

The labeller is trained when the operator runs, on

* generated pages: random layouts (semantic elements, or plain containers with
  telling, neutral or no names) around random main text, with menus, banners,
  notices, adverts, forms, sidebars, link lists, reader comments and footers;
* a bounded sample of the given pages, labelled by their semantic elements where
  they have any; in training their names are hidden at random, so that words and
  context must do too.

Only scripts, styles, titles, comments and other unshown markup are dropped by rule. A
head has no text of its own: what cannot stand in it is read, as in browsers.

Defined results for edge cases
* null or empty html, or a page without any kept block: empty text, 0 characters;
* unclosed, crossed and unknown elements: as far as they go, like browsers do for
  paragraphs, list items and table cells; scripts, styles and titles without an end run
  to the end of the page, other unshown elements without one hide nothing, and an svg
  ends at the first HTML element in it or with the element around it;
* very long pages: all blocks are read, in one sequence;
* null ids or urls are kept; repeated rows: one result each; an empty table: no
  rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyman.llm.common import pick

#: Bounds of training: sampled pages and their length, generated pages, passes.
SAMPLE_PAGES, SAMPLE_CHARS, GENERATED, PASSES = 200, 100_000, 500, 6
PATH_DIMS, WORD_DIMS, HIDDEN = 96, 48, 14
NUMBERS = 8
DIMS = PATH_DIMS + WORD_DIMS + NUMBERS
SEED = 11
#: Block vectors a task holds at a time, about.
STEPS = 40_000

# Fixed values of HTML: elements that bound a block, that have no end tag, whose content is text up to their end tag
# and not shown, whose content is not shown if they end, that end an svg, and in which an svg holds HTML.
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search
section select summary table tbody td textarea tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "title"))
UNSHOWN = frozenset(("noscript", "template", "iframe"))
ANNOTATION = frozenset(("annotation", "annotation-xml"))  # of math
BREAKOUT = BLOCK | frozenset("b big br code em embed font head i img listing meta nobr ruby s small span strike strong sub sup tt u var".split())
HOLDS_HTML = frozenset(("foreignobject", "desc"))
#: Elements that a new one of the same group ends, up to the container that holds them.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
INLINE_SPACE = frozenset(("br", "img", "input", "wbr"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>"
    r"|<(?P<odd>[a-zA-Z][^\s/>]*)[^>]*>|<[/!?][^>]*>|(?P<text>[^<]+|<)", re.S | re.I)
_TAGS = {name: re.compile(rf"<{name}(?=[\s/>])|<(/){name}(?=[\s/>])[^>]*>", re.I) for name in RAW | UNSHOWN | ANNOTATION}
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Za-z]+|\d+")
_WORD = re.compile(r"\w+|©")
_SPACE = re.compile(r"\s+")


class Block:
    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple[str, ...], linked: int):
        self.text, self.path, self.linked = text, path, linked


def _ends(page: str, name: str) -> dict[int, int]:
    """Where the elements of a name that end do so, by where they start. Templates nest; of
    the others one that starts again before its end has none."""
    out, still_open = {}, []
    for m in _TAGS[name].finditer(page):
        if not m[1]:
            if name != "template":
                still_open.clear()
            still_open.append(m.start())
        elif still_open:
            out[still_open.pop()] = m.end()
    return out


def blocks(page: str) -> list[Block]:
    """The page's text blocks: text, path words, and characters inside links."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    links = linked = 0
    foreign: list[str] = []  # open elements from an svg on
    ends: dict[str, dict[int, int]] = {}

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block(text, tuple(w for _, words in stack for w in words), min(linked, len(text))))
            parts.clear()
        linked = 0

    def close(at: int) -> None:
        nonlocal links
        for name, _ in stack[at:]:
            if name in BLOCK:
                flush()
            links -= name == "a"
        del stack[at:]

    at = 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        text = m["text"]
        if text is not None:
            if foreign:
                continue
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if links:
                linked += len(text.strip())
            continue
        name = (m["name"] or m["odd"] or "").lower()
        if m["name"] is None and name not in RAW and name not in UNSHOWN and name != "svg":
            continue  # a comment, declaration or broken tag
        closed = m[0].endswith("/>")
        if name in RAW:
            if not m["end"] and not (foreign and closed):
                last = next((t for t in _TAGS[name].finditer(page, at) if t[1]), None)
                at = last.end() if last else len(page)
            continue
        if name in UNSHOWN or name in ANNOTATION and any(n == "math" for n, _ in stack):
            if not m["end"]:
                if name not in ends:
                    ends[name] = _ends(page, name)
                at = ends[name].get(m.start(), at)
            continue
        if foreign:
            if m["end"]:
                if name in foreign:
                    while foreign.pop() != name:
                        pass
                    continue
                if name not in ("p", "br") and all(n != name for n, _ in stack):
                    continue
            elif name not in BREAKOUT or not HOLDS_HTML.isdisjoint(foreign):
                if not closed and name not in VOID:
                    foreign.append(name)
                continue
            foreign.clear()
        if name == "svg":
            if not m["end"] and not closed:
                foreign.append(name)
            continue
        if name == "head":
            continue
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            if name in BLOCK:
                flush()
            continue
        if name in BLOCK:
            flush()
            for k in range(len(stack) - 1, -1, -1):  # a block element ends an open paragraph
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in BLOCK:
                    break
            if name in ENDS:
                ended, holders = ENDS[name]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in holders:
                        break
                    if stack[k][0] in ended:
                        close(k)
                        if name != "tr":
                            break
        elif name in INLINE_SPACE:
            parts.append(" ")
        if name in VOID or m["attrs"].endswith("/") and name not in BLOCK:
            continue
        words = [name]
        if m["attrs"]:
            for a, b, c in _NAMES.findall(m["attrs"]):
                words += [f".{w.lower()}" for w in _PART.findall(a or b or c)]
        stack.append((name, tuple(words)))
        links += name == "a"
    flush()
    return out


def _hash(word: str, dims: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % dims


class Vectors:
    """Block vectors; hashed words are remembered up to a bound."""

    def __init__(self):
        self.paths: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def _at(self, known: dict[str, int], word: str, dims: int) -> int:
        at = known.get(word)
        if at is None:
            if len(known) > 500_000:
                known.clear()
            at = known[word] = _hash(word, dims)
        return at

    def __call__(self, page: list[Block]) -> np.ndarray:
        x = np.zeros((len(page), DIMS), np.float32)
        total = sum(len(b.text) for b in page) or 1
        before = 0
        for row, b in zip(x, page):
            for w in b.path:
                row[self._at(self.paths, w, PATH_DIMS)] = 1.0
            words = _WORD.findall(b.text.lower())
            if words:
                at = np.bincount([self._at(self.words, w, WORD_DIMS) for w in words], minlength=WORD_DIMS)
                row[PATH_DIMS:PATH_DIMS + WORD_DIMS] = at / np.sqrt((at * at).sum())
            n = len(b.text)
            row[-NUMBERS:] = (np.log1p(n) / 6, np.log1p(len(words)) / 5, b.linked / n, sum(map(b.text.count, ".,;:!?")) / n * 10,
                              b.text[-1] in ".!?…\"»", sum(map(b.text.count, "0123456789|/@©")) / n * 5, before / total, min(len(b.path), 20) / 10)
            before += n
        return x


# ---- the network -----------------------------------------------------------------------

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    h = HIDDEN
    w = {}
    for d in "fb":  # forward, backward
        w["x" + d] = rng.normal(0, 1 / np.sqrt(12), (DIMS, 4 * h)) * 0.5
        w["h" + d] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
        w["c" + d] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])  # input, forget, output, candidate
    w["out"] = rng.normal(0, 0.3, (2 * h, 1))
    w["skip"] = np.zeros((DIMS, 1))
    w["bias"] = np.zeros(1)
    return w


def _direction(x: np.ndarray, mask: np.ndarray, wx: np.ndarray, wh: np.ndarray, c0: np.ndarray, keep: bool):
    """One LSTM direction over (time, batch, DIMS); states of padded steps pass through."""
    t, b, _ = x.shape
    n = wh.shape[0]
    pre = (x.reshape(t * b, -1) @ wx + c0).reshape(t, b, 4 * n)
    h, c = np.zeros((b, n), x.dtype), np.zeros((b, n), x.dtype)
    out, trace = np.empty((t, b, n), x.dtype), []
    for s in range(t):
        a = pre[s] + h @ wh
        g = _sigmoid(a[:, :3 * n])
        i, f, o, z = g[:, :n], g[:, n:2 * n], g[:, 2 * n:], np.tanh(a[:, 3 * n:])
        c2 = f * c + i * z
        tc = np.tanh(c2)
        m = mask[s][:, None]
        if keep:
            trace.append((h, c, i, f, o, z, tc, m))
        h, c = np.where(m, o * tc, h), np.where(m, c2, c)
        out[s] = h
    return out, trace


def _direction_back(x: np.ndarray, dout: np.ndarray, trace: list, wx: np.ndarray, wh: np.ndarray):
    t, b, _ = x.shape
    n = wh.shape[0]
    dh, dc = np.zeros((b, n)), np.zeros((b, n))
    da = np.empty((t, b, 4 * n))
    dwh = np.zeros_like(wh)
    for s in range(t - 1, -1, -1):
        h, c, i, f, o, z, tc, m = trace[s]
        dh = dh + dout[s]
        live_h, live_c = np.where(m, dh, 0), np.where(m, dc, 0)
        dct = live_c + live_h * o * (1 - tc * tc)
        da[s] = np.concatenate([dct * z * i * (1 - i), dct * c * f * (1 - f), live_h * tc * o * (1 - o), dct * i * (1 - z * z)], axis=1)
        dwh += h.T @ da[s]
        dh = np.where(m, da[s] @ wh.T, dh)
        dc = np.where(m, dct * f, dc)
    flat = da.reshape(t * b, -1)
    return x.reshape(t * b, -1).T @ flat, dwh, flat.sum(0)


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(len(p) for p in pages)
    x, mask = np.zeros((t, len(pages), DIMS), np.float32), np.zeros((t, len(pages)), bool)
    for k, p in enumerate(pages):
        x[:len(p), k], mask[:len(p), k] = p, True
    return x, mask


def probabilities(w: dict[str, np.ndarray], pages: list[np.ndarray]) -> list[np.ndarray]:
    x, mask = _padded(pages)
    hf, _ = _direction(x, mask, w["xf"], w["hf"], w["cf"], False)
    hb, _ = _direction(x[::-1], mask[::-1], w["xb"], w["hb"], w["cb"], False)
    z = np.concatenate([hf, hb[::-1]], axis=2) @ w["out"] + x @ w["skip"] + w["bias"]
    p = _sigmoid(z[:, :, 0])
    return [p[:len(v), k] for k, v in enumerate(pages)]


def fit(pages: list[tuple[np.ndarray, np.ndarray]], passes: int = PASSES, batch: int = 16, rate: float = 0.01) -> dict[str, np.ndarray]:
    """Weights by Adam over the pages' (vectors, labels), mean log loss over blocks."""
    rng = np.random.default_rng(SEED)
    w = new_weights(rng)
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for turn in range(passes):
        order = rng.permutation(len(pages))
        order = sorted(order, key=lambda k: len(pages[k][0]) // 8)
        groups = [order[i:i + batch] for i in range(0, len(order), batch)]
        for g in rng.permutation(len(groups)):
            chosen = [pages[k] for k in groups[g]]
            x, mask = _padded([c[0] for c in chosen])
            drop = rng.random((1, x.shape[1], DIMS)) < 0.2  # a page's hashed name or word hidden
            drop[:, :, -NUMBERS:] = False
            x = np.where(drop, 0, x)
            y = np.zeros(mask.shape)
            for k, (_, labels) in enumerate(chosen):
                y[:len(labels), k] = labels
            hf, tf = _direction(x, mask, w["xf"], w["hf"], w["cf"], True)
            hb, tb = _direction(x[::-1], mask[::-1], w["xb"], w["hb"], w["cb"], True)
            both = np.concatenate([hf, hb[::-1]], axis=2)
            p = _sigmoid((both @ w["out"] + x @ w["skip"] + w["bias"])[:, :, 0])
            dz = (np.where(mask, p - y, 0) / mask.sum())[:, :, None]
            grads = {"out": both.reshape(-1, 2 * HIDDEN).T @ dz.reshape(-1, 1), "skip": x.reshape(-1, DIMS).T @ dz.reshape(-1, 1) + 1e-4 * w["skip"], "bias": dz.sum((0, 1))}
            dboth = dz @ w["out"].T
            grads["xf"], grads["hf"], grads["cf"] = _direction_back(x, dboth[:, :, :HIDDEN], tf, w["xf"], w["hf"])
            grads["xb"], grads["hb"], grads["cb"] = _direction_back(x[::-1], dboth[::-1, :, HIDDEN:], tb, w["xb"], w["hb"])
            step += 1
            norm = np.sqrt(sum(float((v * v).sum()) for v in grads.values()))
            for k, v in grads.items():
                v = v * min(1.0, 1.0 / max(norm, 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                w[k] = w[k] - rate * (1 - turn / (passes + 1)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in w.items()}


# ---- training pages --------------------------------------------------------------------

#: Elements whose content is main text, and whose content is not, for weak labels.
INSIDE, OUTSIDE = frozenset(("article", "main")), frozenset(("nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog"))


def weak_labels(page: list[Block]) -> np.ndarray | None:
    """1 inside an article or main element and outside of page furniture; None if the page has no such element."""
    labels = np.array([bool(INSIDE.intersection(b.path)) and not OUTSIDE.intersection(b.path) for b in page], float)
    return labels if labels.any() else None


def hidden_names(page: list[Block], rng: np.random.Generator) -> list[Block]:
    """The page with its semantic elements and some names replaced by plain containers."""
    gone = set(INSIDE | OUTSIDE) if rng.random() < 0.3 else {w for w in INSIDE | OUTSIDE if rng.random() < 0.3}
    forgotten = {w for b in page for w in b.path if w.startswith(".") and rng.random() < 0.4}
    return [Block(b.text, tuple("div" if w in gone else w for w in b.path if w not in forgotten), b.linked) for b in page]


_FURNITURE = {
    "menu": ("home about contact products services news blog shop login register search help support more archive categories tags faq jobs press".split(),
             ["nav", "div.menu", "ul.nav", "div.navbar", "div#navigation", "div.topnav", "header", "div.links", "div"]),
    "banner": ("welcome site daily times magazine official portal your source for news".split(), ["header", "div.header", "div#masthead", "div.banner", "div.top", "div"]),
    "notice": ("we use cookies to improve your experience accept decline privacy settings policy this site consent learn more subscribe newsletter".split(),
               ["div.cookie", "div.notice", "aside.alert", "div#consent", "div.popup", "dialog", "section.notice", "div"]),
    "advert": ("buy now sale offer sponsored advertisement discount free shipping limited deal click here best price".split(),
               ["div.ad", "div.ads", "aside.advert", "div.sponsored", "div#banner", "ins.adsbygoogle", "div.promo", "section.ad"]),
    "form": ("name email message send submit search your address password sign in subscribe required".split(), ["form", "form.search", "form.contact", "div.form form", "fieldset"]),
    "sidebar": ("recent posts popular related archive tags follow us twitter facebook most read you may also like".split(),
                ["aside", "div.sidebar", "div#sidebar", "div.widget", "section.related", "div.aside", "td.side", "div.related"]),
    "comments": ("reply says posted by user comment thanks great article i agree ago likes report anonymous".split(),
                 ["section.comments", "div#comments", "div.comment", "ol.commentlist", "div.discussion", "section#respond", "ul.comments", "div.responses"]),
    "footer": ("copyright © all rights reserved terms privacy imprint contact sitemap powered by company address".split(),
               ["footer", "div.footer", "div#footer", "section.footer", "div.bottom", "div.copyright"]),
}
_MAIN = ["article", "main", "main article", "div.content", "div#content", "div.post", "div.entry", "section.story", "div.article", "div.body", "td.main", "div", "section", "body", "div.text", "article.post"]


def generated_page(rng: np.random.Generator, vocabulary: list[str]) -> tuple[list[Block], np.ndarray]:
    """A random layout with labels. Text comes from ``vocabulary``; page furniture mixes in its usual words."""
    page: list[tuple[Block, int]] = []

    def sentence(low: int, high: int, usual: list[str] | None = None, share: float = 0.0) -> str:
        n = int(rng.integers(low, high + 1))
        words = [usual[rng.integers(len(usual))] if usual and rng.random() < share else vocabulary[rng.integers(len(vocabulary))] for _ in range(n)]
        return " ".join(words).capitalize()

    def names(spec: str) -> tuple[str, ...]:
        out: list[str] = []
        for element in spec.split():
            tag, *rest = re.split(r"[.#]", element)
            out += [tag, *(f".{r}" for r in rest)]
        return tuple(out)

    base = ("html", "body", *(("div",) * int(rng.integers(0, 3))), *(((".page", ".wrapper", ".container")[rng.integers(3)],) if rng.random() < 0.4 else ()))

    def furniture(kind: str, inside: tuple[str, ...] = base) -> None:
        usual, holders = _FURNITURE[kind]
        path = (*inside, *names(holders[rng.integers(len(holders))]))
        share = float(rng.choice([0.0, 0.3, 0.7]))
        if kind in ("menu", "sidebar") and rng.random() < 0.8 or kind == "footer" and rng.random() < 0.3:
            if kind == "sidebar" and rng.random() < 0.6:
                page.append((Block(sentence(1, 3, usual, share), (*path, "h3"), 0), 0))
            for _ in range(int(rng.integers(2, 9))):
                text = sentence(1, 2 if kind == "menu" else 7, usual, share)
                page.append((Block(text, (*path, "ul", "li", "a") if rng.random() < 0.7 else (*path, "a"), len(text)), 0))
            return
        many = {"comments": (1, 6), "form": (1, 4)}.get(kind, (1, 3))
        for _ in range(int(rng.integers(many[0], many[1] + 1))):
            if kind == "comments" and rng.random() < 0.6:
                page.append((Block(sentence(1, 4, usual, share), (*path, ("span", "div", "cite", "b")[rng.integers(4)]), 0), 0))
            text = sentence(*((3, 40) if kind == "comments" else (1, 5) if kind == "form" else (2, 22)), usual, share)
            text += "." if rng.random() < 0.7 and kind != "form" else ""
            if kind == "footer" and rng.random() < 0.6:
                text = "© " + text
            page.append((Block(text, (*path, ("p", "div", "li", "span", "label")[rng.integers(5)]) if rng.random() < 0.6 else path, int(rng.random() < 0.2) * len(text)), 0))

    def maybe(kind: str, chance: float, inside: tuple[str, ...] = base) -> None:
        if rng.random() < chance:
            furniture(kind, inside)

    maybe("notice", 0.25), maybe("banner", 0.35), maybe("menu", 0.85), maybe("advert", 0.45), maybe("form", 0.15), maybe("sidebar", 0.2)
    main = (*base, *names(_MAIN[rng.integers(len(_MAIN))]))
    if rng.random() < 0.85:
        page.append((Block(sentence(2, 12), (*main, ("h1", "h2")[rng.integers(2)]), 0), 1))
    for _ in range(int(rng.integers(1, 12)) if rng.random() < 0.9 else int(rng.integers(12, 50))):
        kind = rng.random()
        shout = rng.random() < 0.1
        text = " ".join(sentence(2, 18) + "." for _ in range(int(rng.integers(1, 7)))) if kind < 0.85 else sentence(1, 9)
        if rng.random() < 0.1:
            text = sentence(1, 4) + "."
        linked = int(len(text) * rng.choice([0.0, 0.0, 0.1, 0.3]))
        tail = ("h2",) if kind > 0.93 else ("ul", "li") if kind > 0.85 else ("blockquote", "p") if kind > 0.82 else ("p", "b") if kind > 0.75 else ("div",) if kind > 0.7 else ("p",)
        page.append((Block(text.upper() if shout else text, (*main, *tail), linked), 1))
        if rng.random() < 0.05:
            furniture(("advert", "form", "sidebar", "notice")[rng.integers(4)], main)
    maybe("sidebar", 0.45), maybe("advert", 0.2), maybe("comments", 0.45, main if rng.random() < 0.25 else base), maybe("form", 0.2), maybe("footer", 0.85), maybe("notice", 0.1)
    return [b for b, _ in page], np.array([y for _, y in page], float)


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, generated: int = GENERATED, passes: int = PASSES) -> dict[str, np.ndarray]:
    """Weights from generated pages and at most ``sample_pages`` given ones of at most
    ``SAMPLE_CHARS`` characters (the pages whose hashes are smallest)."""
    hashed = pages.where(F.col("html").isNotNull() & (F.length("html") <= SAMPLE_CHARS)).select("html", F.xxhash64("html").alias("h"))
    # first which pages, as numbers, then their text: else every task would send its smallest pages
    chosen = [r.h for r in hashed.select("h").distinct().orderBy("h").limit(sample_pages).collect()]
    rows = hashed.where(F.col("h").isin(chosen)).dropDuplicates(["h"]).collect() if chosen else []
    given = [p for p in (blocks(r.html) for r in sorted(rows, key=lambda r: r.h)) if p]
    words = sorted({w for p in given for b in p for w in b.text.split()}) or ["text"]
    rng, vectors = np.random.default_rng(SEED), Vectors()
    words = [words[k] for k in rng.permutation(len(words))[:20_000]]
    known = []
    for p in given:
        labels = weak_labels(p)
        if labels is not None:
            known += [(vectors(p), labels), (vectors(hidden_names(p, rng)), labels)]
    for _ in range(generated):
        p, labels = generated_page(rng, words)
        known.append((vectors(p), labels))
    return fit(known, passes)


def extract(pages: DataFrame, weights: dict[str, np.ndarray] | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks, n_kept`` of each page."""
    rows = pick(pages, page_id=page_id, url=url, html=html)
    weights = train(rows) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for whole in batches:
            for at in range(0, len(whole), 256):
                b = whole.slice(at, 256)
                cut = [blocks(h.as_py() or "") for h in b.column("html")]
                texts = [""] * len(cut)
                kept = [0] * len(cut)
                order = sorted((k for k in range(len(cut)) if cut[k]), key=lambda k: len(cut[k]))
                while order:  # pages of similar length together, about STEPS block vectors at a time
                    n = 1
                    while n < len(order) and (n + 1) * len(cut[order[n]]) <= STEPS // 4:
                        n += 1
                    group, order = order[:n], order[n:]
                    for k, p in zip(group, probabilities(weights, [vectors(cut[k]) for k in group])):
                        chosen = [x.text for x, q in zip(cut[k], p) if q >= 0.5]
                        texts[k], kept[k] = "\n".join(chosen), len(chosen)
                yield pa.RecordBatch.from_arrays([
                    b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([len(c) for c in cut], pa.int64()), pa.array(kept, pa.int64())],
                    names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    rows = rows.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")
