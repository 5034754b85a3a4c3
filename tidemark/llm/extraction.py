"""Main text of web pages by a recurrent labeller of blocks.

A page becomes its sequence of leaf blocks. Each block is read as a hashed vector of the tags, classes and ids
on its path, a hashed vector of its words, and a few proportions. A bidirectional LSTM in numpy runs over the
whole sequence, so every block is judged with all of the page around it. The network is trained here on pages
made by ``sample_page``, whose layouts, wrappers and names vary; no page of the table is used.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
import zlib
from collections.abc import Iterator, Sequence, Set
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH, WORDS, MORE = 256, 64, 8
INPUTS = 2 * PATH + WORDS + MORE
HIDDEN = 24

#: Elements as HTML defines them.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title"
    " tr ul".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, to the end of the page where they do not end; others that are left out only where they end.
RAW_TEXT = frozenset("script style textarea title iframe".split())
HIDDEN_TEXT = RAW_TEXT | frozenset("noscript template svg".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table", "tbody", "thead", "tfoot"}, "option": {"select"}}
PARAGRAPH, PARAGRAPH_SCOPE = frozenset({"p"}), frozenset({"button", "td", "th", "table"})
KEEPS_PARAGRAPH = frozenset("a b i em strong span u small sub sup code br img font label button input select option".split())

TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(/?)([A-Za-z][^\s/>]*+)((?>[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)|</[^>]*+(?:>|\Z)""",
    re.S,
)
NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def slot(token: str, size: int) -> int:
    return zlib.crc32(token.encode()) % size


@lru_cache(maxsize=20_000)
def own_slots(tag: str, named: str) -> tuple[int, ...]:
    return tuple(slot(t, PATH) for t in [f"t:{tag}"] + [f"n:{p.lower()}" for p in PARTS.findall(named)])


class Node:
    """An open block element, linked to the one around it; its slots are the parent's and its own, as bits."""

    __slots__ = ("parent", "tag", "named", "depth", "own", "whole")

    def __init__(self, parent: Node | None, tag: str, named: str):
        self.parent, self.tag, self.named = parent, tag, named
        self.depth, self.own = (parent.depth + 1 if parent else 1), 0
        for at in own_slots(tag, named):
            self.own |= 1 << at
        self.whole = self.own | (parent.whole if parent else 0)

    def outward(self) -> Iterator[Node]:
        node: Node | None = self
        while node is not None:
            yield node
            node = node.parent


@dataclass
class Block:
    node: Node | None
    text: str
    linked: float

    @property
    def path(self) -> tuple[tuple[str, str], ...]:
        """Block elements around the text with their names, outermost first."""
        return tuple((n.tag, n.named) for n in self.node.outward())[::-1] if self.node else ()

    @property
    def slots(self) -> tuple[int, int]:
        """Slots of everything on the path, and those of the innermost two elements, as bits."""
        if self.node is None:
            return 0, 0
        return self.node.whole, self.node.own | (self.node.parent.own if self.node.parent else 0)


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order: text between block elements, references decoded, white space as one space.

    Unclosed elements are closed as HTML closes them, end tags without a start are skipped, a tag or a comment
    that the end of the page cuts off is no text. Scripts, styles and other hidden text are left out; what stands in
    math, object or canvas is text, as is what follows a drawing, noscript or template without an end. Time and
    memory are in proportion to the page, however deep its elements lie in each other. A null page has no block.
    """
    out: list[Block] = []
    stack: list[tuple[str, Node | None]] = []  # open elements, each with the innermost block element up to it
    places: dict[str, list[int]] = {}  # where on the stack the elements of a name stand
    endless: set[str] = set()  # names that no end tag of the rest of the page closes
    parts: list[str] = []
    links, at, page = 0, 0, page or ""

    def flush() -> None:
        nonlocal links
        if not parts:
            return
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(stack[-1][1] if stack else None, text, min(1.0, links / len(text))))
        parts.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        if not raw:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if places.get("a"):
            links += len(text)

    def last(names: Set[str]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    def close(k: int) -> None:
        while len(stack) > k:
            places[stack.pop()[0]].pop()

    def leave(names: Set[str], scope: Set[str]) -> None:
        k = last(names)
        if k > last(scope):
            flush()
            close(k)

    while True:
        found = TAG.search(page, at)
        if found is None:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        name = found[2] or found[5]
        if not name:
            if found[0].startswith("<![CDATA["):
                add(found[0][9:].removesuffix("]]>"))
            continue
        name, closing, attributes = name.lower(), bool(found[1] or found[4]), found[3] if found[2] else found[6]
        if not closing and name in HIDDEN_TEXT:
            if not (attributes or "").endswith("/"):
                end = None if name in endless else re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
                if end is not None:
                    at = page.find(">", end.end() - 1) + 1 or len(page)
                elif name in RAW_TEXT:
                    break
                else:
                    endless.add(name)
            continue
        if name in EMPTY and name not in BLOCKS:
            parts.append(" ")
            continue
        if closing:
            k = last({name})
            if k >= 0:
                if any(x[0] in BLOCKS for x in stack[k:]):
                    flush()
                close(k)
            continue
        if name in BLOCKS:
            if name not in KEEPS_PARAGRAPH:
                leave(PARAGRAPH, PARAGRAPH_SCOPE)
            if name in CLOSED_BY:
                leave(CLOSED_BY[name], SCOPE[name])
            flush()
        if name in EMPTY:
            continue
        around = stack[-1][1] if stack else None
        if name in BLOCKS:
            named = " ".join(m.strip("\"'") for m in NAMES.findall(attributes or "")) if attributes else ""
            around = Node(around, name, named)
        places.setdefault(name, []).append(len(stack))
        stack.append((name, around))
    flush()
    return out


def ordered_slots(block: Block) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """The slots of ``Block.slots`` one by one, innermost elements first."""
    around = [own_slots(n.tag, n.named) for n in block.node.outward()] if block.node else []
    return tuple({at for own in around for at in own}), tuple({at for own in around[:2] for at in own})


#: A number per byte; the sum over a word's bytes is its hash.
BYTE_HASH = np.random.default_rng(3).integers(0, 2**32, 256, dtype="int64")
BYTE_HASH[32] = 0


def plain_vectors(page: Sequence[Block]) -> np.ndarray:
    """Hashed words and proportions of each block, all blocks of a page in one pass over its bytes."""
    joined = np.frombuffer(" ".join(b.text for b in page).lower().encode(), "uint8")
    starts = np.r_[0, np.flatnonzero(joined == 32) + 1]
    slots = np.add.reduceat(BYTE_HASH[joined], starts) * 0x9E3779B1 >> 20 & (WORDS - 1)
    sizes = np.array([b.text.count(" ") + 1 for b in page])
    owner = np.repeat(np.arange(len(page)), sizes)
    counts = np.bincount(owner * WORDS + slots, minlength=len(page) * WORDS).reshape(-1, WORDS)
    more = []
    for k, (b, n) in enumerate(zip(page, sizes)):
        text = b.text
        stops = sum(map(text.count, ".,;:!?"))
        digits = sum(map(text.count, "0123456789"))
        more.append((
            math.log1p(n) / 5, b.linked, min(2.0, 5 * stops / n), float(text[-1] in ".!?:\"\u201d"), float("\u00a9" in text),
            digits / len(text), min(1.0, (b.node.depth if b.node else 0) / 10), min(1.0, k / max(len(page) - 1, 1)),
        ))
    return np.column_stack([np.sqrt(counts / sizes[:, None]), np.array(more)]).astype("float32")


def path_vectors(paths: Sequence[tuple[int, int]]) -> np.ndarray:
    """One row per path, given as ``Block.slots``."""
    octets = b"".join(part.to_bytes(PATH // 8, "little") for path in paths for part in path)
    bits = np.frombuffer(octets, "uint8").reshape(len(paths), PATH // 4)
    return np.unpackbits(bits, axis=1, bitorder="little").astype("float32")


def vectors(page: Sequence[Block], forget: random.Random | None = None) -> np.ndarray:
    """One row per block: path, words, proportions. With ``forget``, names on the path are dropped now and then, for training."""
    x = path_vectors([b.slots for b in page])
    if forget is not None:
        x[:] = 0.0
        for k, b in enumerate(page):
            whole, inner = (tuple(s for s in part if forget.random() > 0.08) for part in ordered_slots(b))
            x[k, list(whole)] = 1.0
            x[k, [PATH + s for s in inner]] = 1.0
    return np.concatenate([x, plain_vectors(page)], axis=1)


class Labeller:
    """Bidirectional LSTM with a logistic output for every block."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        scale = 1 / math.sqrt(HIDDEN)
        self.weights = {}
        for d in ("f", "b"):
            self.weights[f"x{d}"] = r.normal(0, 0.1, (INPUTS, 4 * HIDDEN)).astype("float32")
            self.weights[f"h{d}"] = r.normal(0, scale, (HIDDEN, 4 * HIDDEN)).astype("float32")
            bias = np.zeros(4 * HIDDEN, "float32")
            bias[HIDDEN : 2 * HIDDEN] = 1.0
            self.weights[f"c{d}"] = bias
        self.weights["out"] = r.normal(0, scale, 2 * HIDDEN + 1).astype("float32")

    @staticmethod
    def sigmoid(v: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(v, -30, 30)))

    def run(self, gates: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States of one direction from the inputs' share in the gates of padded pages (time, page, gate).

        ``keep``: with what every step held, as the gradient needs it.
        """
        h = c = np.zeros((gates.shape[1], HIDDEN), "float32")
        states, kept = np.empty((*gates.shape[:2], HIDDEN), "float32"), []
        for t in range(len(gates)) if d == "f" else range(len(gates) - 1, -1, -1):
            g = gates[t] + self.weights[f"c{d}"] + h @ self.weights[f"h{d}"]
            s = self.sigmoid(g[:, : 3 * HIDDEN])
            i, f, o, z = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * z
            squashed = np.tanh(new)
            if keep:
                kept.append((t, h, c, i, f, o, z, squashed, m))
            h, c = m * (o * squashed) + (1 - m) * h, m * new + (1 - m) * c
            states[t] = h
        return states, kept

    def logits(self, gates: dict[str, np.ndarray], mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray, dict]:
        """Padding (mask 0) leaves the state of either direction as it is."""
        (forth, kf), (back, kb) = self.run(gates["f"], mask, "f", keep), self.run(gates["b"], mask, "b", keep)
        states = np.concatenate([forth, back], axis=2)
        return states @ self.weights["out"][:-1] + self.weights["out"][-1], states, {"f": kf, "b": kb}

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        z, states, kept = self.logits({d: x @ self.weights[f"x{d}"] for d in ("f", "b")}, mask, keep=True)
        p = self.sigmoid(z)
        total = mask.sum()
        dz = (p - y) * mask / total
        loss = -float((mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / total)
        grads = {"out": np.append(np.einsum("tp,tps->s", dz, states), dz.sum()).astype("float32")}
        for k, d in enumerate(("f", "b")):
            dstates = dz[:, :, None] * self.weights["out"][:-1][k * HIDDEN : (k + 1) * HIDDEN]
            wh, dgates = self.weights[f"h{d}"], np.zeros((*x.shape[:2], 4 * HIDDEN), "float32")
            dwh, dh, dc = np.zeros_like(wh), 0.0, 0.0
            for t, h, c, i, f, o, zt, squashed, m in reversed(kept[d]):
                dh = dh + dstates[t]
                live = m * dh
                dnew = m * dc + live * o * (1 - squashed**2)
                g = np.concatenate([dnew * zt * i * (1 - i), dnew * c * f * (1 - f), live * squashed * o * (1 - o), dnew * i * (1 - zt**2)], axis=1)
                dgates[t] = g
                dwh += h.T @ g
                dh = g @ wh.T + (1 - m) * dh
                dc = dnew * f + (1 - m) * dc
            flat = dgates.reshape(-1, 4 * HIDDEN)
            grads |= {f"x{d}": x.reshape(-1, INPUTS).T @ flat, f"h{d}": dwh, f"c{d}": flat.sum(axis=0)}
        return grads, loss

    def label(self, pages: Sequence[Sequence[Block]], cells: int = 16_384) -> list[np.ndarray]:
        """Probability of main text for every block, pages of like length side by side.

        Many blocks share a path, so each path meets the weights once. Pages without blocks give no probabilities.
        """
        paths = {p: k for k, p in enumerate(dict.fromkeys(b.slots for page in pages for b in page))}
        if not paths:
            return [np.zeros(0)] * len(pages)
        every = list(paths)
        slabs = [path_vectors(every[k : k + 4096]) for k in range(0, len(every), 4096)]
        shared = {d: np.concatenate([x @ self.weights[f"x{d}"][: 2 * PATH] for x in slabs]) for d in ("f", "b")}
        del slabs
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        while order:
            longest = len(pages[order[-1]])
            some = [order.pop() for _ in range(min(len(order), max(1, cells // longest)))]
            x, mask = padded([plain_vectors(pages[k]) for k in some])
            which = np.zeros(mask.shape, "int64")
            for column, k in enumerate(some):
                which[: len(pages[k]), column] = [paths[b.slots] for b in pages[k]]
            gates = {d: x @ self.weights[f"x{d}"][2 * PATH :] + shared[d][which] for d in ("f", "b")}
            p = self.sigmoid(self.logits(gates, mask)[0])
            for column, k in enumerate(some):
                out[k] = p[: len(pages[k]), column]
        return out


def padded(pages: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x, mask = np.zeros((longest, len(pages), pages[0].shape[1]), "float32"), np.zeros((longest, len(pages)), "float32")
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1.0
    return x, mask


#: Names that sites give to the parts of a page; each list is drawn from at random.
PART_NAMES = {
    "nav": "nav navbar menu navigation topnav main-menu breadcrumb breadcrumbs tabs pagination pager toc skip-links",
    "header": "header site-header masthead top-bar branding page-header topbar logo",
    "footer": "footer site-footer page-footer copyright bottom colophon legal footer-links credits",
    "aside": "sidebar side aside widget related related-posts recommended popular trending rail more-stories tags",
    "ad": "ad ads advert advertisement banner sponsored promo promotion adsbox ad-slot google-ad sponsor",
    "notice": "cookie cookie-banner notice gdpr consent alert popup modal overlay paywall announcement",
    "share": "share social social-links share-buttons toolbar follow",
    "form": "form newsletter subscribe login signup search search-form contact",
    "comments": "comments comment-list comment discussion responses respond reader-comments disqus replies",
    "main": "content main-content article post entry story entry-content post-content article-body body-text page-content text prose markdown",
    "wrapper": "container wrapper row inner page layout grid outer site wrap col-md-8 css-1x2y box block section",
}
MARK = "\ue000"
SYLLABLES = "an the er on re ti es or st en ed nd to it ou ea ha as is le de la que un el con ver ein und der ge sch mi ra lo su pa né ción ñó ä".split()


def sample_page(r: random.Random) -> str:
    """A page of a random layout. Blocks of main text begin with ``MARK``."""
    word = lambda: "".join(r.choices(SYLLABLES, k=r.randint(1, 4)))
    words = lambda lo, hi: " ".join(word() for _ in range(r.randint(lo, hi)))
    sentence = lambda lo=2, hi=14: words(lo, hi).capitalize() + r.choice(".....?!")
    prose = lambda n=6: " ".join(sentence() for _ in range(r.randint(1, n)))
    link = lambda: f'<a href="/{word()}">{r.choice([word, lambda: words(1, 6)])()}</a>'

    def named(kind: str) -> str:
        return r.choice(["", f' data-x="{word()}"']) + f' {r.choice(["class", "class", "id"])}="{r.choice(PART_NAMES[kind].split())}{r.choice(["", "", " " + word(), " mt-4"])}"'

    def part(kind: str, tag: str, body: str, own: float = 0.5) -> str:
        semantic = tag if r.random() < own else "div"
        return f"<{semantic}{named(kind) if semantic == 'div' or r.random() < 0.4 else ''}>{body}</{semantic}>"

    def links(n: int = 8) -> str:
        kind = r.random()
        if kind < 0.7:
            return r.choice(["<ul>{}</ul>", "{}"]).format("".join(f"<li>{link()}</li>" for _ in range(r.randint(1, n))))
        return r.choice([" | ", " ", " &middot; "]).join(link() for _ in range(r.randint(1, n)))

    def loose() -> str:
        """Text of no part in particular, long or short, as it stands in boxes of every kind."""
        return r.choice([lambda: f"<p>{prose(3)}</p>", lambda: prose(2), lambda: links(5), lambda: f"<h3>{words(1, 5)}</h3>{links(5)}", lambda: f"<h4>{words(1, 5)}</h4><p>{prose(3)}</p>"])()

    def ad() -> str:
        return r.choice(["", f"<!-- ad {r.randint(1, 99)} -->"]) + part("ad", r.choice(["aside", "div"]), loose(), 0.2)

    def form() -> str:
        body = "".join(r.choice([f"<label>{words(1, 3)}</label><input name='q'>", f"<p>{sentence()}</p>", f"<button>{word()}</button>", f"<select><option>{word()}<option>{word()}</select>"]) for _ in range(r.randint(1, 4)))
        return part("form", "form", body, 0.7) if r.random() < 0.5 else f"<form>{body}</form>"

    def comments() -> str:
        one = lambda: r.choice(["<div class='comment'><b>{}</b><p>{}</p></div>", "<li><cite>{}</cite> {}</li>", "<article class='comment'><h4>{}</h4><p>{}</p></article>", "<p>{}: {}</p>"]).format(word(), prose(4))
        body = r.choice(["", f"<h2>{words(1, 3)}</h2>", f"<h3>{r.randint(1, 40)} {word()}</h3>"]) + "".join(one() for _ in range(r.randint(1, 6))) + (form() if r.random() < 0.3 else "")
        return part("comments", "section", body, 0.0) if r.random() < 0.8 else f"<section{named('comments')}>{body}</section>"

    def text(body: str) -> str:
        return MARK + body

    def inside() -> str:
        kind = r.random()
        if kind < 0.66:
            body = prose(r.choice([1, 3, 6, 12]))
            if r.random() < 0.15:
                body = body + " " + link() + " " + prose(2)
            if r.random() < 0.2:
                return f"<p><b>{text(body)}<br>"
            return f"<p>{text(body)}</p>" if r.random() < 0.85 else f"<p>{text(body)}"
        if kind < 0.78:
            return f"<h{(n := r.randint(2, 4))}>{text(words(1, 8))}</h{n}>"
        if kind < 0.86:
            return f"<{(n := r.choice(['ul', 'ol']))}>" + "".join(f"<li>{text(r.choice([prose(1), words(1, 6)]))}</li>" for _ in range(r.randint(1, 5))) + f"</{n}>"
        if kind < 0.9:
            return f"<blockquote>{r.choice(['<p>{}</p>', '{}']).format(text(prose(3)))}</blockquote>"
        if kind < 0.94:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{text(words(1, 3))}</td>" for _ in range(2)) + "</tr>" for _ in range(r.randint(1, 3))) + "</table>"
        if kind < 0.97:
            return f"<pre>{text(words(3, 20))}</pre>"
        return f"<div>{text(prose(4))}</div>"

    def article() -> str:
        head = f"<h1>{text(words(1, 14))}</h1>"
        body = [inside() for _ in range(r.choice([1, 2, 4, 8, 14]))]
        for extra, chance in ((ad, 0.25), (lambda: part("share", "ul", links(4), 0.1), 0.2), (lambda: part("aside", "aside", loose(), 0.6), 0.2), (form, 0.1), (comments, 0.08), (lambda: part("notice", "div", loose()), 0.1)):
            if r.random() < chance:
                body.insert(r.randint(0, len(body)), extra())
        if r.random() < 0.15:
            head = f"<header>{head}</header>"
        return (head if r.random() < 0.85 else "") + "".join(body)

    tag = r.choice(["article", "article", "article", "main", "div", "div", "section"])
    main = f"<{tag}{named('main') if tag in ('div', 'section') or r.random() < 0.3 else ''}>{article()}</{tag}>"
    if tag != "main" and r.random() < 0.3:
        main = f"<main>{main}</main>"
    side = lambda: part("aside", "aside", "".join(loose() for _ in range(r.randint(1, 3))), 0.6)
    before = [x() for x, chance in (
        (lambda: part("notice", "div", loose()), 0.3), (lambda: part("header", "header", r.choice([words(1, 4), f"<h2>{words(1, 3)}</h2>", f"<a href='/'>{word()}</a>"]) + (f"<p>{sentence()}</p>" if r.random() < 0.4 else "") + (links() if r.random() < 0.4 else ""), 0.6), 0.5),
        (lambda: part("nav", "nav", links(), 0.6), 0.75), (ad, 0.45), (side, 0.15), (form, 0.1),
    ) if r.random() < chance]
    after = [x() for x, chance in (
        (lambda: part("share", "div", links(4)), 0.15), (comments, 0.35), (side, 0.35), (ad, 0.25), (form, 0.15), (lambda: part("notice", "div", loose()), 0.1), (lambda: part("nav", "nav", links(5), 0.5), 0.1),
    ) if r.random() < chance]
    foot = [part("footer", "footer", r.choice(["&copy; {} {}", "{} &middot; {}", "<p>&copy; 2020 {}</p><p>{}</p>", "<p>{} {}</p>"]).format(r.choice([word(), "www." + word() + ".example.com"]), r.choice([sentence(), words(1, 4), links(4)])), 0.65)] if r.random() < 0.85 else []
    r.shuffle(before)
    r.shuffle(after)
    for _ in range(r.choice([0, 0, 1, 2])):
        main = f"<{(n := r.choice(['div', 'div', 'section']))}{named('wrapper') if n == 'div' else ''}>{main}</{n}>"
    page = "".join([*before, main, *after, *foot])
    for _ in range(r.choice([0, 0, 1])):
        page = f"<div{named('wrapper')}>{page}</div>"
    page = f"<!DOCTYPE html><html><head><title>{words(1, 9)}</title><style>p{{}}</style></head><body>{page}</body></html>"
    return page[: r.randint(len(page) * 3 // 4, len(page))] if r.random() < 0.1 else page


def labelled(page: str) -> tuple[list[Block], np.ndarray]:
    found = blocks(page)
    y = np.array([MARK in b.text for b in found], "float32")
    for b in found:
        b.text = b.text.replace(MARK, "") or "-"
    return found, y


@lru_cache(maxsize=2)
def trained(pages: int = 2400, passes: int = 5, together: int = 32, rate: float = 0.01, seed: int = 11) -> Labeller:
    """A labeller fitted by Adam to sampled pages; the same for the same parameters."""
    r = random.Random(seed)
    model = Labeller()
    first = {k: np.zeros_like(w) for k, w in model.weights.items()}
    second = {k: np.zeros_like(w) for k, w in model.weights.items()}
    made = [labelled(sample_page(r)) for _ in range(pages)]
    made = [m for m in made if m[0]]
    steps = passes * (len(made) // together)
    step = 0
    for _ in range(passes):
        # Pages of like length train together, in random order.
        batches = sorted(range(len(made)), key=lambda k: len(made[k][0]) + r.random() * 6)
        starts = list(range(0, len(made) - together + 1, together))
        r.shuffle(starts)
        for at in starts:
            some = [made[k] for k in batches[at : at + together]]
            x, mask = padded([vectors(b, r) for b, _ in some])
            y = np.zeros_like(mask)
            for k, (_, labels) in enumerate(some):
                y[: len(labels), k] = labels
            grads, _ = model.gradients(x, mask, y)
            size = math.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            step += 1
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (size + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.weights[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype("float32")
    return model


def main_text(pages: Sequence[str | None], model: Labeller, least: float = 0.5) -> list[str]:
    """Main text of whole pages: blocks labelled as such, in order, two line feeds between."""
    found = [blocks(p) for p in pages]
    marks = model.label(found)
    return ["\n\n".join(b.text for b, p in zip(bs, ps) if p >= least) for bs, ps in zip(found, marks)]


def extract(pages: DataFrame, model: Labeller | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", together: int = 100) -> DataFrame:
    """page_id, url, text, n_chars of every row; a null, empty or blank page gives an empty text.

    Rows are read ``together`` at a time, each whole; repeated rows give the same text. Other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, together):
                batch = whole.slice(at, together)
                texts = main_text(batch.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(each, "page_id long, url string, text string, n_chars long")
