"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks (runs of text between block-level tags). A bidirectional LSTM in
numpy reads, for the whole sequence of leaves, hashed tag-path and word vectors and labels every
block: content, or one of the kinds of what surrounds it. The labeller is fitted here, once per
process and with a fixed seed, on pages that ``sample_page`` composes with known labels.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracequarry.llm.naming import quoted

LABELS = ("content", "menu", "header", "footer", "sidebar", "notice", "advert", "form", "comment")
PATH, WORD, REST = 160, 48, 8
WIDTH = PATH + WORD + REST
HIDDEN = 24
BATCH = 64
#: Blocks that are read together at most, unless one page has more.
CELLS = 1 << 15

NAME = re.compile(r"[A-Za-z][^\s/>]*")
#: What ends a piece of a tag outside of values: a tag's end, or a sign of equality before a value.
PIECE = re.compile(r"[^=>]*+(?:>|=\s*+)")
BARE = re.compile(r"[^\s>]*+")
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[a-z]+")
#: Elements whose text is never shown as such.
HIDDEN_TEXT = frozenset("script style title template noscript textarea iframe svg math object canvas select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag on the left ends open elements on the right.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Open elements of these kinds, and inline ones, don't keep a start tag from ending those around them.
PASSED = frozenset("dt dd td th option".split())


@dataclass
class Block:
    text: str
    path: tuple[int, ...]  # slots of the tags, classes, ids and roles of all open elements
    linked: float


class Tags:
    """Finds where tags end. Quotes count only around a value, as browsers read them.

    Each character is looked at once or twice in all: a quote without its like ahead is remembered.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        self.lost: set[str] = set()

    def end(self, at: int) -> int:
        """Position after the '>' of the tag whose name ends at ``at``; -1 if there is none."""
        page = self.page
        while m := PIECE.match(page, at):
            at = m.end()
            if page[at - 1] == ">":
                return at
            quote = page[at : at + 1]
            if quote in ("'", '"') and quote not in self.lost:
                end = page.find(quote, at + 1)
                if end >= 0:
                    at = end + 1
                    continue
                self.lost.add(quote)
            at = BARE.match(page, at).end()
        return -1


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order: references decoded, white space turned to one space.

    Time is linear in the page, whatever its markup. A tag that never ends hides what follows it, and
    a quoted value without its closing quote ends like one without quotes.
    """
    page = page or ""
    found: list[Block] = []
    stack: list[tuple[str, tuple[int, ...]]] = []
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack each tag is open
    walls: list[int] = []  # where elements are that implied ends don't pass
    held: Counter[int] = Counter()  # slots of what is open
    parts: list[str] = []
    linked, links = 0, 0
    path: tuple[int, ...] = ()
    rooted = False

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append(Block(text, path, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked, path, rooted
        if not parts or not rooted:
            if not raw.strip():
                return
            tags = [tag for tag, _ in stack[-2:]]
            path = (*held, path_slot("last " + (tags[-1] if tags else "")), path_slot("pair " + " ".join(tags)))
            rooted = bool(stack)
        parts.append(raw)
        if links:
            linked += len(raw)

    def cut(size: int) -> None:
        nonlocal links
        while len(stack) > size:
            tag, slots = stack.pop()
            places[tag].pop()
            links -= tag == "a"
            if walls and walls[-1] == len(stack):
                walls.pop()
            for x in slots:
                held[x] -= 1
                if not held[x]:
                    del held[x]

    at, lower, tags = 0, None, Tags(page)
    while at < len(page):
        i = page.find("<", at)
        i = len(page) if i < 0 else i
        m = NAME.match(page, i + 1 + page.startswith("/", i + 1))
        if i > at or not m:
            marked = page.startswith(("!", "?", "/"), i + 1)
            say(page[at : i if m or marked else i + 1])  # a sign that opens no tag is text
            at = i if m or marked else i + 1
        if not m:
            if at < len(page) and page[at] == "<" and page.startswith(("!", "?", "/"), at + 1):
                mark = "-->" if page.startswith("<!--", at) else ">"
                end = page.find(mark, at + 2)
                at = len(page) if end < 0 else end + len(mark)
            continue
        at = tags.end(m.end())
        if at < 0:
            break  # a tag that never ends takes the rest with it
        tag, inner = m[0].lower(), page[m.end() : at - 1]
        if m.start() == i + 2:
            if tag not in INLINE:
                close()
            if places.get(tag):
                cut(places[tag][-1])
            continue
        if tag in HIDDEN_TEXT and not inner.endswith("/"):
            lower = lower if lower is not None else page.lower()
            end = lower.find("</" + tag, at)
            end = len(page) if end < 0 else end
            stop = page.find(">", end)
            at = len(page) if stop < 0 else stop + 1
            if tag not in INLINE:
                close()
            continue
        if tag == "br":
            say(" ")
        if tag not in INLINE:
            close()
            ended = max(places[x][-1] if places.get(x) else -1 for x in ("p", *ENDS.get(tag, ())))
            if ended >= (walls[-1] if walls else 0):
                cut(ended)
        if tag not in VOID and not inner.endswith("/"):
            names = ["." + p for x in NAMES.findall(inner) for p in PART.findall("".join(x).lower())] if inner else []
            slots = tuple({path_slot(x) for x in (tag, *names)})
            held.update(slots)
            places[tag].append(len(stack))
            if tag not in INLINE and tag not in PASSED:
                walls.append(len(stack))
            stack.append((tag, slots))
            links += tag == "a"
    close()
    return found


@lru_cache(maxsize=20_000)
def path_slot(token: str) -> int:
    return zlib.crc32(token.encode()) % PATH


def digits(text: str) -> int:
    return sum(map(text.count, "0123456789")) if text.isascii() else sum(map(str.isdigit, text))


@lru_cache(maxsize=200_000)
def word_slot(word: str) -> int:
    return zlib.crc32(word.encode()) % WORD


def vectors(found: list[Block]) -> np.ndarray:
    """One row per block: hashed path, hashed words, and plain measures."""
    x = np.zeros((len(found), WIDTH), np.float32)
    for i, b in enumerate(found):
        x[i, list(b.path)] = 1
        words = b.text.lower().split()
        hashed = np.bincount([word_slot(w) for w in words], minlength=WORD)
        x[i, PATH : PATH + WORD] = hashed / np.sqrt(len(words))
        n = len(b.text)
        x[i, PATH + WORD :] = (
            np.log1p(len(words)) / 3,
            np.log1p(n) / 5,
            b.linked,
            b.text[-1] in ".!?:;\"')",
            b.text.count(",") / len(words),
            digits(b.text) / n,
            i / len(found),
            1.0,
        )
    return x


class Lstm:
    """One direction, with the gates input, forget, output and new value side by side."""

    def __init__(self, rng: np.random.Generator, width: int, hidden: int) -> None:
        self.wx = (rng.standard_normal((width, 4 * hidden)) / np.sqrt(width / 4)).astype(np.float32)
        self.wh = (rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.b = np.zeros(4 * hidden, np.float32)
        self.b[hidden : 2 * hidden] = 1

    def params(self) -> list[np.ndarray]:
        return [self.wx, self.wh, self.b]

    def forward(self, x: np.ndarray, keep: bool = False):
        """x: (time, batch, width). Hidden states (time, batch, hidden) and what backward needs."""
        steps, n, _ = x.shape
        h_size = self.wh.shape[0]
        pre = (x.reshape(steps * n, -1) @ self.wx + self.b).reshape(steps, n, -1)
        h = c = np.zeros((n, h_size), np.float32)
        out, saved = np.empty((steps, n, h_size), np.float32), []
        for t in range(steps):
            z = pre[t] + h @ self.wh
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h_size], -30, 30)))
            new = np.tanh(z[:, 3 * h_size :])
            i, f, o = gates[:, :h_size], gates[:, h_size : 2 * h_size], gates[:, 2 * h_size :]
            before, c = c, f * c + i * new
            bent = np.tanh(c)
            if keep:
                saved.append((h, before, i, f, o, new, bent))
            h = o * bent
            out[t] = h
        return out, saved

    def backward(self, x: np.ndarray, saved: list, grad: np.ndarray) -> list[np.ndarray]:
        steps, n, _ = x.shape
        h_size = self.wh.shape[0]
        dz = np.empty((steps, n, 4 * h_size), np.float32)
        dwh = np.zeros_like(self.wh)
        dh = dc = np.zeros((n, h_size), np.float32)
        for t in range(steps - 1, -1, -1):
            h, before, i, f, o, new, bent = saved[t]
            dh = dh + grad[t]
            dc = dc + dh * o * (1 - bent * bent)
            dz[t] = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * bent * o * (1 - o), dc * i * (1 - new * new)], axis=1)
            dwh += h.T @ dz[t]
            dh, dc = dz[t] @ self.wh.T, dc * f
        flat = dz.reshape(steps * n, -1)
        return [x.reshape(steps * n, -1).T @ flat, dwh, flat.sum(axis=0)]


class Labeller:
    """Bidirectional LSTM with a softmax over ``LABELS``."""

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.ahead, self.back = Lstm(rng, WIDTH, HIDDEN), Lstm(rng, WIDTH, HIDDEN)
        self.w = (rng.standard_normal((2 * HIDDEN, len(LABELS))) * 0.1).astype(np.float32)
        self.b = np.zeros(len(LABELS), np.float32)

    def params(self) -> list[np.ndarray]:
        return [*self.ahead.params(), *self.back.params(), self.w, self.b]

    @staticmethod
    def packed(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(time, page, width) of the pages, of the pages reversed, and their lengths."""
        lengths = np.array([len(p) for p in pages])
        x = np.zeros((lengths.max(), len(pages), WIDTH), np.float32)
        y = np.zeros_like(x)
        for i, p in enumerate(pages):
            x[: len(p), i], y[: len(p), i] = p, p[::-1]
        return x, y, lengths

    @staticmethod
    def flipped(states: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = np.zeros_like(states)
        for i, n in enumerate(lengths):
            out[:n, i] = states[:n, i][::-1]
        return out

    def logits(self, pages: list[np.ndarray]) -> np.ndarray:
        x, y, lengths = self.packed(pages)
        both = np.concatenate([self.ahead.forward(x)[0], self.flipped(self.back.forward(y)[0], lengths)], axis=2)
        return both @ self.w + self.b

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The label of every block of every page; pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
        while order:
            n = 1  # the longest pages come first, and set how many of them are read together
            while n < min(BATCH, len(order)) and len(pages[order[-1]]) * (n + 1) <= CELLS:
                n += 1
            part, order = order[-n:], order[:-n]
            z = self.logits([pages[i] for i in part])
            for j, i in enumerate(part):
                out[i] = z[: len(pages[i]), j].argmax(axis=1)
        return out

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 7, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.params()]
        step, last = 0, epochs * (-(-len(pages) // 32))
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), 32):
                part = order[at : at + 32]
                x, y, lengths = self.packed([pages[i] for i in part])
                a, saved_a = self.ahead.forward(x, True)
                b, saved_b = self.back.forward(y, True)
                both = np.concatenate([a, self.flipped(b, lengths)], axis=2)
                z = both @ self.w + self.b
                p = np.exp(z - z.max(axis=2, keepdims=True))
                p /= p.sum(axis=2, keepdims=True)
                dz = np.zeros_like(p)
                for j, i in enumerate(part):
                    n = lengths[j]
                    dz[:n, j] = p[:n, j]
                    dz[np.arange(n), j, labels[i]] -= 1
                dz /= lengths.sum()
                flat = dz.reshape(-1, len(LABELS))
                dboth = dz @ self.w.T
                grads = [
                    *self.ahead.backward(x, saved_a, dboth[..., :HIDDEN]),
                    *self.back.backward(y, saved_b, self.flipped(dboth[..., HIDDEN:], lengths)),
                    both.reshape(-1, 2 * HIDDEN).T @ flat,
                    flat.sum(axis=0),
                ]
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
                for w, g, (m, v) in zip(self.params(), grads, moments, strict=True):
                    g = g * min(1.0, 1.0 / (norm + 1e-9))
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    w -= 0.02 * (1 - 0.9 * step / last) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)


SYLLABLES = "the an er ti on in re ed ou ha en or st nd es le la de que ión ra sch ung ver eau eux ai ment ta to is".split()
SAYINGS = {
    "menu": "Home|About|Contact|News|Sports|Blog|Products|Login|Sign up|Services|Archive|FAQ|Search|Shop|Accueil|Startseite|Inicio".split("|"),
    "header": "Welcome to our site|The daily post|Site name|Your trusted source|Skip to content|My account|Breaking news".split("|"),
    "footer": "© 2024 All rights reserved|Copyright|Terms of use|Privacy policy|Impressum|Powered by|Follow us|Contact us".split("|"),
    "sidebar": "Related articles|Popular posts|Recent posts|Categories|Tags|Archives|You may also like|Most read|Trending|See also".split("|"),
    "notice": "We use cookies to improve your experience|Accept all|Cookie settings|This site uses cookies|Please enable JavaScript|Subscribe to continue reading|Your browser is outdated".split("|"),
    "advert": "Advertisement|Sponsored|Buy now|Limited offer|Sale ends today|Promoted content|Shop the deal|Click here".split("|"),
    "form": "Email address|Your name|Submit|Subscribe to our newsletter|Send|Search|Password|Message|Leave a reply|Required fields".split("|"),
    "comment": "Reply|says:|3 comments|Posted by|Great article|Thanks for sharing|I agree|Report|2 hours ago|Leave a comment".split("|"),
}
WRAPS = {
    "menu": [("nav", ""), ("nav", 'class="main-nav"'), ("div", 'class="menu"'), ("div", 'id="navigation"'), ("div", 'class="navbar"'), ("ul", 'class="nav-list"'), ("div", 'class="breadcrumbs"'), ("div", 'role="navigation"')],
    "header": [("header", ""), ("header", 'class="site-header"'), ("div", 'id="header"'), ("div", 'class="masthead"'), ("div", 'class="top-bar"'), ("div", 'role="banner"')],
    "footer": [("footer", ""), ("footer", 'class="site-footer"'), ("div", 'id="footer"'), ("div", 'class="copyright"'), ("div", 'role="contentinfo"')],
    "sidebar": [("aside", ""), ("aside", 'class="sidebar"'), ("div", 'id="sidebar"'), ("div", 'class="related"'), ("div", 'class="widget"'), ("section", 'class="recommended"'), ("div", 'class="share-buttons social"')],
    "notice": [("div", 'class="cookie-notice"'), ("div", 'id="cookie-banner"'), ("div", 'class="notice"'), ("div", 'class="alert"'), ("div", 'class="consent"'), ("div", 'role="alert"'), ("div", 'class="popup modal"'), ("section", 'class="banner notice"')],
    "advert": [("div", 'class="ad"'), ("div", 'class="ads"'), ("div", 'id="ad-top"'), ("div", 'class="advert"'), ("div", 'class="sponsored"'), ("aside", 'class="promo"'), ("div", 'class="banner-ad"'), ("div", 'class="advertisement"')],
    "form": [("form", ""), ("form", 'class="newsletter"'), ("form", 'id="search"'), ("form", 'class="contact-form"'), ("div", 'class="subscribe form"')],
    "comment": [("section", 'class="comments"'), ("div", 'id="comments"'), ("ol", 'class="comment-list"'), ("div", 'class="comment"'), ("div", 'id="disqus_thread"'), ("ul", 'class="responses comments"'), ("section", 'id="discussion"')],
    "content": [("article", ""), ("article", ""), ("article", 'class="post"'), ("main", ""), ("div", 'class="content"'), ("div", 'id="content"'), ("div", 'class="entry-content"'), ("div", 'class="post-body"'), ("div", 'class="article"'), ("div", 'role="main"'), ("section", 'class="story"'), ("div", "")],
}


def sample_page(rng: random.Random, deep: float = 0.1) -> tuple[str, list[str]]:
    """A composed page and the label of each of its blocks, in order.

    ``deep`` is the share of parts whose blocks lie under many more elements, some never ended.
    """
    labels: list[str] = []

    def inside(tag: str, names: str, body: str) -> str:
        if tag not in ("ul", "ol") and rng.random() < deep:
            n, inner = rng.choice((4, 12, 40, 120)), rng.choice(('div class="row"', 'div class="inner"', "div", "section", "span"))
            name = inner.split()[0]  # left open, elements named as the part would take its end tag
            body = f"<{inner}>" * n + body + (f"</{name}>" * n if name == tag or rng.random() < 0.5 else "")
        return f"<{tag} {names}>{body}</{tag}>" if names else f"<{tag}>{body}</{tag}>"

    def words(n: int) -> str:
        made = ["".join(rng.choices(SYLLABLES, k=rng.choice((1, 1, 2, 2, 3)))) for _ in range(n)]
        noise = rng.random()
        if noise < 0.12:
            marks = [rng.choice("%*&$#|=~^+-_") * rng.choice((1, 3)) for _ in range(5)]
            made = [w + html.escape(rng.choice(("", *marks))) for w in made]
        elif noise < 0.2:
            return f" {rng.choice('|/,-*')} ".join(made) + rng.choice((".", ""))
        elif noise < 0.24:
            made = made[:1] * n
        return " ".join(made).capitalize() + rng.choice((".", ".", "", "?", "!"))

    def phrase(kind: str) -> str:
        return rng.choice(SAYINGS[kind]) if rng.random() < 0.6 else words(rng.choice((1, 2, 3, 6, 12, 30)))

    def block(kind: str, tag: str, text: str, ended: bool = True) -> str:
        labels.append(kind)
        return f"<{tag}>{text}" + (f"</{tag.split()[0]}>" if ended else "")

    def around(kind: str) -> str:
        tag, names = rng.choice(WRAPS[kind])
        body = ""
        listed = tag in ("ul", "ol") or rng.random() < {"menu": 0.8, "sidebar": 0.5, "footer": 0.3, "comment": 0.3}.get(kind, 0.05)
        n = rng.randint(1, 8 if listed else 4)
        if kind == "header" and rng.random() < 0.5:
            body += block(kind, "h1", phrase(kind))
        if kind in ("sidebar", "comment") and rng.random() < 0.6 and tag not in ("ul", "ol"):
            body += block(kind, rng.choice(("h2", "h3", "h4")), phrase(kind))
        if listed:
            items = ""
            for _ in range(n):
                text = phrase(kind)
                if kind == "comment" and rng.random() < 0.6:
                    labels.append(kind)
                    items += f"<li><p>{words(rng.randint(3, 40))}</p></li>"
                else:
                    items += block(kind, "li", f'<a href="#">{text}</a>' if rng.random() < 0.85 else text)
            body += items if tag in ("ul", "ol") else f"<ul>{items}</ul>"
        elif kind == "form":
            for _ in range(n):
                body += block(kind, rng.choice(("p", "div", "button", "legend")), f"<label>{phrase(kind)}</label><input>")
        else:
            if n == 1 and rng.random() < 0.6 and not body:
                labels.append(kind)
                body += phrase(kind) + (f' &middot; {words(rng.randint(3, 15))}' if rng.random() < 0.5 else "")
            else:
                for _ in range(n):
                    text = words(rng.randint(4, 60)) if kind in ("comment", "advert", "notice") and rng.random() < 0.6 else phrase(kind)
                    body += block(kind, rng.choice(("p", "p", "div", "p")), f'<a href="#">{text}</a>' if rng.random() < 0.3 else text)
        return inside(tag, names, body)

    def story() -> str:
        tag, names = rng.choice(WRAPS["content"])
        body, loose = "", rng.random() < 0.5
        if rng.random() < 0.85:
            head = block("content", rng.choice(("h1", "h1", "h2")), words(rng.randint(1, 14)))
            body += f"<header>{head}</header>" if rng.random() < 0.15 else head
        for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 13, 20))):
            kind = rng.random()
            n = rng.choice((1, 1, 2, 4, 15, 40, 80, 120, 300))
            if kind < 0.78:
                text = words(n)
                if rng.random() < 0.15:
                    text = f'<a href="#">{text}</a> ' + words(rng.randint(1, 30)) if rng.random() < 0.7 else f'<a href="#">{text}</a>'
                if rng.random() < 0.2:
                    text = f"<b>{text}<br>" if loose else f"<b>{text}</b>"
                body += block("content", "p", text, not loose or rng.random() < 0.5)
            elif kind < 0.85:
                body += block("content", rng.choice(("h2", "h3")), words(rng.randint(1, 8)))
            elif kind < 0.92:
                body += "<ul>" + "".join(block("content", "li", words(rng.randint(1, 25))) for _ in range(rng.randint(1, 5))) + "</ul>"
            elif kind < 0.96:
                body += block("content", rng.choice(("blockquote", "pre", "figcaption")), words(n))
            elif tag != "div" or names:
                body += around(rng.choice(("advert", "advert", "sidebar", "form", "notice")))
        return inside(tag, names, body)

    body = ""
    for kind in ("notice", "header", "menu", "advert"):
        if rng.random() < {"menu": 0.85, "header": 0.5}.get(kind, 0.35):
            inner = around(kind)
            if kind == "header" and rng.random() < 0.4:
                inner += around("menu")
            body += inner
    if rng.random() < 0.2:
        body += around("sidebar")
    centre = story() if rng.random() < 0.97 else ""
    for kind in ("comment", "form", "sidebar", "advert", "notice"):
        if rng.random() < {"comment": 0.4, "sidebar": 0.3}.get(kind, 0.15):
            centre += around(kind)
    body += f'<div class="{rng.choice(("wrapper", "container", "page", "row"))}">{centre}</div>' if rng.random() < 0.4 else centre
    if rng.random() < 0.85:
        body += around("footer")
    return f'<!DOCTYPE html><html lang="en"><head><title>{words(5)}</title><script>var t="</p>";</script></head><body>{body}</body></html>', labels


def sample_pages(n: int, seed: int, deep: float = 0.1) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Vectors and labels of composed pages; pages whose markup merges blocks are left out."""
    rng, pages, labels = random.Random(seed), [], []
    while len(pages) < n:
        page, names = sample_page(rng, deep)
        found = blocks(page)
        if found and len(found) == len(names):
            pages.append(vectors(found))
            labels.append(np.array([LABELS.index(x) for x in names]))
    return pages, labels


@lru_cache(maxsize=2)
def fitted(pages: int = 1500, seed: int = 5) -> Labeller:
    """The labeller, fitted on composed pages; the same weights for the same arguments."""
    labeller = Labeller()
    labeller.fit(*sample_pages(pages, seed))
    return labeller


def main_texts(pages: list[str | None], labeller: Labeller) -> list[str]:
    """The content blocks of each page, joined by newlines."""
    cut = [blocks(p) for p in pages]
    labels = labeller.label([vectors(b) for b in cut])
    return ["\n".join(b.text for b, k in zip(bs, ks, strict=True) if k == 0) for bs, ks in zip(cut, labels, strict=True)]


def extract_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), labeller: Labeller | None = None) -> DataFrame:
    """One row per row of ``pages``: the kept columns, text and n_chars.

    Null, empty and text-less pages have the empty text; kept columns may hold nulls. Repeated rows
    give repeated rows, an empty table none. Pages of any length and markup are read whole, in
    time linear in them. A kept column called text or n_chars gives way to the new one; other
    columns don't take part.
    """
    model = labeller or fitted()
    keep = tuple(c for c in keep if c.lower() not in ("text", "n_chars"))
    schema = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in keep) + "text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = main_texts(part.column(len(keep)).to_pylist(), model)
                columns = [*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "text", "n_chars"])

    named = (quoted(c).alias(f"c{i}") for i, c in enumerate((*keep, html_col)))  # names with dots can't be passed on
    return pages.select(*named).mapInArrow(run, schema)
