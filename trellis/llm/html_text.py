"""Main text of web pages by a recurrent block labeller.

A page is read once into its leaves: the texts of its blocks, in page order, each with the path of tags above it
and their classes and ids. A bidirectional LSTM in NumPy reads, for each leaf, a hashed tag path, hashed words and some
measures, and labels it as main text or not with the whole page in view. Main leaves are joined by line feeds.

The labeller is trained here, on pages that `training_page` makes from a seed: menus, headers, notices,
adverts, sidebars, forms, comments and footers of many shapes around an article of made-up words. Its size is fixed
(about 60 kB), so it goes to every task.

Scripts, styles, templates, comments and the head are no text. White space in a block becomes one space; line breaks
(`br`) are white space; character references are decoded. A page without main text, null or empty, gives an empty
text. Repeated rows are read each for itself. Columns named like the results are replaced.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bytetext import ALNUM, Tokens, column_bytes, slices
from .common import small_batches

#: Fixed values of HTML.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style template noscript textarea title head svg iframe".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORD = re.compile("[a-z]+")
PATHS, WORDS, MEASURES, INNER, HIDDEN = 192, 128, 8, 24, 20


class Node:
    """An open tag under another, with its names. The slots of the whole path are a set of bits, so that a page's depth costs nothing."""

    __slots__ = ("above", "parts", "slots", "tag")

    def __init__(self, above: Node | None, tag: str, names: tuple[str, ...]):
        self.above, self.tag, self.parts, self.slots = above, tag, (tag, *names), above.slots if above else 0
        for part in self.parts:
            self.slots |= 1 << _slot(part)


class Leaf:
    __slots__ = ("linked", "node", "text")

    def __init__(self, node: Node | None, text: str, linked: int):
        self.node, self.text, self.linked = node, text, linked

    @property
    def path(self) -> tuple[str, ...]:
        out, node = [], self.node
        while node:
            out.append(node.parts)
            node = node.above
        return tuple(x for parts in reversed(out) for x in parts)


def leaves(page: str | None) -> list[Leaf]:
    """The page's blocks of text."""
    out: list[Leaf] = []
    stack: list[Node] = []
    places: dict[str, list[int]] = {}  # each open tag's places in the stack
    blocks_open: list[int] = []  # the places of blocks
    parts: list[str] = []
    linked = at = 0
    page = page or ""

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Leaf(stack[-1] if stack else None, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def cut(size: int) -> None:
        while len(stack) > size:
            tag = stack.pop().tag
            places[tag].pop()
            if tag in BLOCKS:
                blocks_open.pop()

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if any(x.tag == "a" for x in stack[-4:]):
                linked += len(piece.strip())

    while m := _TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if places.get(tag):
                inside = places[tag][-1]
                if blocks_open and blocks_open[-1] >= inside:
                    flush()
                cut(inside)
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                # a head that is not closed ends with the body
                end = end or (re.compile("<body", re.I).search(page, at) if tag == "head" else None)
                at = len(page) if not end else end.end() if end[0][1] == "/" else end.start()
            continue
        if tag in ("br", "wbr"):
            parts.append(" " if tag == "br" else "")
            continue
        if tag in BLOCKS:
            flush()
            # tags that a block closes are blocks, so that the innermost open block tells
            if blocks_open and ((other := stack[blocks_open[-1]].tag) == "p" or other in CLOSED_BY.get(tag, ())):
                cut(blocks_open[-1])
        if tag not in VOID and not m[3].endswith("/"):
            names = tuple(f"{tag}.{w}" for a, b, c in _NAMES.findall(m[3]) for w in _WORD.findall((a or b or c).lower())) if m[3] else ()
            places.setdefault(tag, []).append(len(stack))
            if tag in BLOCKS:
                blocks_open.append(len(stack))
            stack.append(Node(stack[-1] if stack else None, tag, names + tuple(f".{n.partition('.')[2]}" for n in names)))
    add(page[at:])
    flush()
    return out


@functools.lru_cache(maxsize=100_000)
def _slot(part: str) -> int:
    return xxhash.xxh32_intdigest(part) % PATHS


def inputs(pages: list[list[Leaf]], places: list[tuple[int, int]] | None = None) -> np.ndarray:
    """A vector for each leaf of the pages, or of parts of pages: places has each one's first leaf and its page's leaves."""
    flat = [x for p in pages for x in p]
    out = np.zeros((len(flat), PATHS + WORDS + MEASURES), np.float32)
    if not flat:
        return out
    paths: dict[tuple[int, str | None], np.ndarray] = {}
    for i, leaf in enumerate(flat):
        slots, last = (leaf.node.slots, leaf.node.parts[-1]) if leaf.node else (0, None)
        if (v := paths.get((slots, last))) is None:
            v = np.array([slots >> k & 1 for k in range(PATHS)], np.float32)
            if last is not None:
                v[_slot(f"last {last}")] = 1
            paths[slots, last] = v
        out[i, :PATHS] = v
    data, offsets = column_bytes(pa.array([x.text for x in flat], pa.string()))
    words = Tokens(data, offsets, ALNUM, fold=True)
    np.add.at(out, (words.rows, PATHS + (words.hashes % np.uint64(WORDS)).astype(np.int64)), 1)
    n = np.maximum(words.counts, 1)
    out[:, PATHS : PATHS + WORDS] /= np.sqrt(n)[:, None]
    length = np.diff(offsets)
    stops = np.bincount(words.rows, weights=np.isin(data[np.minimum(words.ends, len(data) - 1)], np.frombuffer(b".,;:!?", np.uint8)), minlength=len(flat))
    place = np.concatenate([(first + np.arange(len(p)) + 0.5) / n for p, (first, n) in zip(pages, places or [(0, len(p)) for p in pages], strict=True) if p])
    linked = np.array([x.linked / max(1, len(x.text)) for x in flat])
    measures = [np.log1p(length) / 8, np.log1p(n) / 6, stops / n, linked, place, n < 4, n > 15, length / np.maximum(n, 1) / 10]
    out[:, PATHS + WORDS :] = np.stack(measures, 1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Linear layer, LSTM in both directions, logistic output."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = PATHS + WORDS + MEASURES
        draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.w = {"in": draw(n, INNER), "in_b": np.zeros(INNER, np.float32), "out": draw(2 * HIDDEN, 1), "out_b": np.zeros(1, np.float32)}
        for d in "fb":
            self.w |= {f"x{d}": draw(INNER, 4 * HIDDEN), f"h{d}": draw(HIDDEN, 4 * HIDDEN), f"b{d}": np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)}

    def inner(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w["in"] + self.w["in_b"])

    def forward(self, inner: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of (time, page, inner vector); mask is 1 where a page has a leaf."""
        w = self.w
        steps, n = mask.shape
        hs, saved = {}, {}
        for d in "fb":
            order = range(steps) if d == "f" else range(steps - 1, -1, -1)
            gates_in = inner @ w[f"x{d}"] + w[f"b{d}"]
            h = c = np.zeros((n, HIDDEN), np.float32)
            hs[d] = np.zeros((steps, n, HIDDEN), np.float32)
            saved[d] = []
            for t in order:
                z = gates_in[t] + h @ w[f"h{d}"]
                i, f, o = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
                g = np.tanh(z[:, 3 * HIDDEN :])
                m = mask[t][:, None]
                c2 = (f * c + i * g) * m
                tc = np.tanh(c2)
                h2 = o * tc * m
                if keep:
                    saved[d].append((t, h, c, i, f, o, g, tc))
                h, c = h2, c2
                hs[d][t] = h
        both = np.concatenate([hs["f"], hs["b"]], 2)
        return (both @ w["out"])[..., 0] + w["out_b"][0], inner, both, saved

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        logits, inner, both, saved = self.forward(self.inner(x), mask, keep=True)
        delta = ((_sigmoid(logits) - y) * mask / mask.sum()).astype(np.float32)
        out = {"out": both.reshape(-1, 2 * HIDDEN).T @ delta.reshape(-1, 1), "out_b": np.array([delta.sum()], np.float32)}
        d_both = delta[..., None] * w["out"][:, 0]
        d_inner = np.zeros_like(inner)
        for k, d in enumerate("fb"):
            gx, gh, gb = (np.zeros_like(w[f"{p}{d}"]) for p in "xhb")
            dh = dc = np.zeros((mask.shape[1], HIDDEN), np.float32)
            for t, h, c, i, f, o, g, tc in reversed(saved[d]):
                m = mask[t][:, None]
                dh = (dh + d_both[t][:, k * HIDDEN : (k + 1) * HIDDEN]) * m
                dc = (dc * m) + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1) * m
                gx += inner[t].T @ dz
                gh += h.T @ dz
                gb += dz.sum(0)
                d_inner[t] += dz @ w[f"x{d}"].T
                dh, dc = dz @ w[f"h{d}"].T, dc * f
            out |= {f"x{d}": gx, f"h{d}": gh, f"b{d}": gb}
        d_in = d_inner * (1 - inner * inner)
        out["in"] = x.reshape(-1, x.shape[2]).T @ d_in.reshape(-1, INNER)
        out["in_b"] = d_in.sum((0, 1))
        return out

    def labels(self, pages: list[list[Leaf]], batch: int = 64, most: int = 20_000) -> list[np.ndarray]:
        """For each page, which leaves are main text. Pages of like length are read together, at most `batch` of them and
        about `most` leaves with their padding (a longer page alone), and turned to inner vectors piece by piece, so that a page
        of any length takes about a kilobyte for each of its leaves."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: -len(pages[i]))
        a = 0
        while a < len(order):
            steps = len(pages[order[a]])
            mine = order[a : a + max(1, min(batch, most // steps))]
            a += len(mine)
            inner, mask = np.zeros((steps, len(mine), INNER), np.float32), np.zeros((steps, len(mine)), np.float32)
            for k, i in enumerate(mine):
                mask[: len(pages[i]), k] = 1
                for first in range(0, len(pages[i]), most):
                    part = pages[i][first : first + most]
                    inner[first : first + len(part), k] = self.inner(inputs([part], [(first, len(pages[i]))]))
            logits = self.forward(inner, mask)[0]
            for k, i in enumerate(mine):
                out[i] = shared(pages[i], logits[: len(pages[i]), k]) > 0
        return out


def shared(page: list[Leaf], logits: np.ndarray) -> np.ndarray:
    """Blocks of one kind (tag and names) under one element share the mean of their logits: items of a list, paragraphs of a
    container. So a short paragraph among others is judged with them, and an advert between them by itself."""
    kinds: dict[tuple, int] = {}
    of = np.empty(len(page), np.int64)
    for i, leaf in enumerate(page):
        node = leaf.node
        while node and node.tag not in BLOCKS:
            node = node.above
        of[i] = kinds.setdefault((id(node.above), node.parts) if node else (0, i), len(kinds))
    return (np.bincount(of, weights=logits) / np.bincount(of))[of]


def padded(pages: list[list[Leaf]]) -> tuple[np.ndarray, np.ndarray]:
    flat, steps = inputs(pages), max(map(len, pages))
    x = np.zeros((steps, len(pages), flat.shape[1]), np.float32)
    mask = np.zeros((steps, len(pages)), np.float32)
    at = 0
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = flat[at : at + len(p)], 1
        at += len(p)
    return x, mask


def training_page(rng: np.random.Generator) -> tuple[str, set[str]]:
    """A made-up page and its main blocks."""
    parts = [b + c for b in ("k", "m", "t", "r", "s", "l", "n", "d", "p", "v", "") for c in ("a", "e", "i", "o", "u", "an", "er", "on", "is", "ent")]
    word = lambda: "".join(rng.choice(parts, rng.integers(1, 5)))
    pick = lambda *x: str(rng.choice(x))

    def prose(least: int, most: int) -> str:
        n = int(rng.integers(least, most + 1))
        words = [word()] * n if rng.random() < 0.03 else [word() for _ in range(n)]  # now and then one word over and over
        out = []
        for i, w in enumerate(words):
            junk = pick("***", "&&&", "$$$", "%%%", " |", "!!") if odd else ""
            out.append((w.capitalize() if i == 0 or out[-1].endswith(".") else w.upper() if shout else w) + junk + pick("", "", "", "", "", "", ",", "."))
        return " ".join(out).rstrip(",. ") + "."

    odd, shout = rng.random() < 0.08, rng.random() < 0.05
    main: list[str] = []

    def keep(text: str) -> str:
        main.append(" ".join(text.split()))
        return html.escape(text, quote=False)

    link = lambda t: f'<a href="/{word()}">{t}</a>'
    named = lambda tag, *names: f'<{tag} {pick("class", "id")}="{pick(*names)}">'

    def listed(n: int) -> str:
        if rng.random() < 0.6:
            return "<ul>" + "".join(f"<li>{link(word())}</li>" for _ in range(n)) + "</ul>"
        return " ".join(link(word()) for _ in range(n))

    def wrapped(tags: list[tuple[str, ...]], inside: str) -> str:
        tag, *names = tags[int(rng.integers(len(tags)))]
        return (named(tag, *names) if names and rng.random() < 0.9 else f"<{tag}>") + inside + f"</{tag}>"

    nav = lambda: wrapped([("nav",), ("nav", "menu", "navbar"), ("div", "menu", "nav", "navigation", "breadcrumb"), ("ul", "menu", "nav")], listed(int(rng.integers(3, 9))))
    advert = lambda: wrapped([("div", "ad", "ads", "advert", "banner", "sponsored", "promo"), ("aside", "ad", "promo"), ("section", "advert", "sponsor")], html.escape(prose(3, 25), quote=False))
    notice = lambda: wrapped([("div", "cookie", "notice", "consent", "alert", "popup", "newsletter", "subscribe")], f"<p>{pick('We use cookies.', 'Subscribe to our newsletter', 'Sign up', 'Accept all')} {prose(2, 14)}</p>")
    side = lambda: wrapped([("aside",), ("aside", "sidebar"), ("div", "sidebar", "related", "widget", "recommended", "share", "social", "tags")], f"<h3>{word()}</h3>" + (listed(4) if rng.random() < 0.6 else f"<p>{prose(5, 30)}</p>"))
    form = lambda: f"<form><label>{word()}</label><input type=text><button>{pick('Search', 'Send', 'Login')}</button></form>"
    comments = lambda: wrapped([("div", "comments", "comment", "disqus", "replies"), ("section", "comments", "discussion")], "".join(f'{named("div", "comment", "reply")}<b>{word()}</b><p>{prose(4, 40)}</p></div>' for _ in range(rng.integers(1, 5))))
    header = lambda: wrapped([("header",), ("div", "header", "masthead", "top", "logo")], f"{pick('<h1>', '<p>', '<span>')}{word()} {word()}" + (nav() if rng.random() < 0.5 else ""))
    footer = lambda: wrapped([("footer",), ("footer", "footer"), ("div", "footer", "bottom", "copyright", "legal")], pick(f"&copy; {word()}.example.com &middot; {prose(3, 14)}", f"<p>Copyright {word()}. {prose(1, 8)}</p>{listed(3)}", f"All rights reserved. {listed(3)}"))

    def article() -> str:
        out = []
        if rng.random() < 0.9:
            out.append(f"<h1>{keep(prose(2, 12))}</h1>")
        for _ in range(rng.integers(1, 14)):
            roll = rng.random()
            text = prose(1, 12) if rng.random() < 0.45 else prose(8, 120)
            if roll < 0.72:
                out.append(f"<p>{keep(text)}</p>")
            elif roll < 0.80:
                out.append(f"<p><b>{keep(text)}<br>")
            elif roll < 0.86:
                out.append(f"<{pick('h2', 'h3')}>{keep(prose(1, 8))}</{pick('h2', 'h3')}>")
            elif roll < 0.91:
                out.append("<ul>" + "".join(f"<li>{keep(prose(2, 20))}</li>" for _ in range(rng.integers(2, 6))) + "</ul>")
            elif roll < 0.94:
                out.append(f"<blockquote>{keep(text)}</blockquote>")
            elif roll < 0.97:
                first, second = prose(2, 12)[:-1], prose(4, 30)
                main.append(f"{first} {second}")
                out.append(f"<p>{html.escape(first, quote=False)} {link(html.escape(second, quote=False))}</p>")
            elif roll < 0.985:
                out.append(advert())
            else:
                out.append("<table><tr>" + "".join(f"<td>{keep(prose(1, 4))}</td>" for _ in range(3)) + "</tr></table>")
        return "".join(out)

    around = [("article",), ("article", "post", "entry"), ("main",), ("main", "content", "main"), ("div", "content", "main", "article", "post", "entry", "story", "text", "body"), ("section", "content", "article")]
    body = wrapped(around, article())
    if rng.random() < 0.35:
        body = wrapped([("main",), ("div", "container", "wrapper", "page"), ("div", "main")], body + (side() if rng.random() < 0.4 else ""))
    some = lambda p, f: f() if rng.random() < p else ""
    page = some(0.35, header) + some(0.75, nav) + some(0.3, notice) + some(0.5, advert) + some(0.15, side) + body + some(0.25, comments) + some(0.3, side) + some(0.2, form) + some(0.2, advert) + some(0.8, footer) + some(0.15, notice)
    return f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{}}</style></head><body>{page}<script>track('<p>')</script></body></html>", set(main)


def training_pages(n: int, seed: int) -> list[tuple[list[Leaf], np.ndarray]]:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        page, main = training_page(rng)
        if found := leaves(page):
            out.append((found, np.array([x.text in main for x in found])))
    return out


@functools.lru_cache(maxsize=2)
def trained(pages: int = 700, epochs: int = 9, seed: int = 7, rate: float = 0.01) -> Labeller:
    """The labeller after training by Adam; the same seed gives the same weights."""
    model, rng = Labeller(seed), np.random.default_rng(seed)
    rows = sorted(training_pages(pages, seed), key=lambda r: len(r[0]))
    batches = []
    for a in range(0, len(rows), 25):
        part = rows[a : a + 25]
        x, mask = padded([p for p, _ in part])
        y = np.zeros_like(mask)
        for k, (_, labels) in enumerate(part):
            y[: len(labels), k] = labels
        batches.append((x, mask, y))
    one = {k: np.zeros_like(v) for k, v in model.w.items()}
    two = {k: np.zeros_like(v) for k, v in model.w.items()}
    step = 0
    for epoch in range(epochs):
        for b in rng.permutation(len(batches)):
            step += 1
            now = rate * (0.5 ** max(0, epoch - epochs // 2))
            for k, g in model.gradients(*batches[b]).items():
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.999 * two[k] + 0.001 * g * g
                model.w[k] = (model.w[k] - now * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def main_text(pages: DataFrame, model: Labeller | None = None, *, html_col: str = "html", keep_html: bool = False) -> DataFrame:
    """The pages (without the html, unless it is to stay) with text and n_chars."""
    spark = pages.sparkSession
    small_batches(spark, 100)
    pages = pages.drop("text", "n_chars")
    stay = [c for c in pages.columns if keep_html or c != html_col]
    weights = spark.sparkContext.broadcast(model or trained())
    schema = T.StructType([*(pages.schema[c] for c in stay), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, html_col):
                found = [leaves(x.as_py()) for x in batch.column(html_col)]
                texts = ["\n".join(x.text for x, m in zip(p, keep, strict=True) if m) for p, keep in zip(found, weights.value.labels(found), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in stay), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*stay, "text", "n_chars"])

    return pages.mapInArrow(work, schema)
