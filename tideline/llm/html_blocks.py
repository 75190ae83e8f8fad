"""Main-text extraction by a recurrent block labeller (numpy).

A page becomes a sequence of leaf blocks: text between block-level tags, with the path of open
elements. A bidirectional LSTM reads, for each block, a hashed vector of its tag path (names, classes
and ids), a hashed vector of its words, and its length and link share; it labels every block as main
text or not, with the whole page as context. It is trained here, on pages that a seeded generator
makes up in many layouts with known labels; no page of the corpus is used for training.

Cases: a null page counts as empty (no text). Unclosed and wrongly nested elements, stray "<" and cut
pages are read as far as they go; from the first tag whose quotes don't end, tags end at the next ">". Reading takes time in
proportion to the page, and pages of very many blocks go through the network in segments. Ties and repeated rows are each extracted; an empty table gives an
empty result; extra columns aren't carried. Pages of any length are read whole.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tideline.llm.common import by_size

OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][\w:-]*))")
REST = re.compile(r"""(?:"[^"]*+"|'[^']*+'|[^'">])*+>""")
#: Elements whose contents aren't text of the page.
RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in "script style template textarea title noscript svg iframe select button".split()}
NAMES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meta link q s samp small span strike strong sub sup time tt u var wbr input".split())
VOID = frozenset("br img meta link input hr wbr area base col embed source track".split())
CLOSES_P = frozenset("p div ul ol li table section article aside header footer nav form h1 h2 h3 h4 h5 h6 blockquote pre dl main figure hr address details".split())
SPACE = re.compile(r"\s+")
PATH, WORDS, EXTRA, HIDDEN = 192, 32, 4, 20
INPUT = PATH + WORDS + EXTRA


@dataclass
class Block:
    path: int  # the slots of the path's names, as bits
    text: str
    linked: int


def tokens(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """Where each text starts and ends, and the tag after it: its name (None: nothing to open or close), whether it closes, its attributes."""
    at = place = 0
    quotes = True
    while (m := OPEN.search(page, place)) is not None:
        name, attributes = None, ""
        if m[1]:
            end = page.find("-->", m.end())
            end = len(page) if end < 0 else end + 3
        else:
            whole = REST.match(page, m.end()) if quotes and m[4] else None
            quotes = quotes and (whole is not None or not m[4])
            end = whole.end() if whole is not None else page.find(">", m.end()) + 1
            if not end:  # no tag ends any more; a comment may begin
                comment = page.find("<!--", m.end())
                yield at, len(page) if comment < 0 else comment, None, False, ""
                return
            name = m[4]
            if name is not None:
                name, attributes = name.lower(), page[m.end() : end - 1]
                if not m[3] and name in RAW:
                    close = RAW[name].search(page, end)
                    name, end = None, len(page) if close is None else close.end()
        yield at, m.start(), name, bool(m[3]), attributes
        at = place = end
    yield at, len(page), None, False, ""


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page with text, in order. An open element is its name, and its name with each class or id."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []
    open_: dict[str, int] = {}
    parts: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            found = SPACE.sub(" ", "".join(parts)).strip()
            if found:
                out.append(Block(stack[-1][1] if stack else 0, found, linked))
            parts.clear()
        linked = 0

    def pop() -> None:
        open_[stack.pop()[0]] -= 1

    for start, end, name, closes, attributes in tokens(page):
        if end > start:
            decoded = html.unescape(page[start:end])
            parts.append(decoded)
            linked += len(decoded) if links else 0
        if name is None:
            continue
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            elif name == "a":
                links = 0 if closes else 1
            continue
        flush()
        links = 0
        if closes:
            if open_.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if stack and (stack[-1][0] == "p" and name in CLOSES_P or stack[-1][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
            pop()
        if name not in VOID:
            words = [w.lower() for v in NAMES.findall(attributes) for w in re.split(r"[\s_-]+", v.strip("\"'")) if w]
            path = stack[-1][1] if stack else 0
            for x in (name, *(f"{name}.{w}" for w in words), *(f".{w}" for w in words)):
                path |= 1 << _slot(x, PATH, False)[0]
            stack.append((name, path))
            open_[name] = open_.get(name, 0) + 1
    flush()
    return out


@functools.lru_cache(maxsize=50_000)
def _slot(word: str, size: int, sign: bool) -> tuple[int, float]:
    h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    return h % size, (-1.0 if sign and h & 0x80000000 else 1.0)


def vectors(found: list[Block], first: bool = True) -> np.ndarray:
    """What the network reads of blocks; ``first``: whether they begin the page."""
    out = np.zeros((len(found), INPUT), dtype=np.float32)
    if found:
        bits = np.frombuffer(b"".join(b.path.to_bytes(PATH // 8, "little") for b in found), dtype=np.uint8)
        out[:, :PATH] = np.unpackbits(bits, bitorder="little").reshape(len(found), PATH)
    for k, b in enumerate(found):
        row = out[k]
        words = b.text.lower().split()
        for w in words:
            i, s = _slot(w, WORDS, True)
            row[PATH + i] += s / (1 + len(words)) ** 0.5
        n = len(b.text)
        row[-4:] = np.log1p(n) / 6, b.linked / n, "\xa9" in b.text, first and k == 0
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(map(len, pages)), len(pages), INPUT), dtype=np.float32)
    mask = np.zeros(x.shape[:2], dtype=np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


def _run(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool, state: tuple | None = None):
    """Hidden states of all steps, what the way back needs, and the last state, which ``state`` may go on from."""
    steps, n, _ = x.shape
    z = x @ w + b
    h, c = state or (np.zeros((n, HIDDEN), dtype=np.float32),) * 2
    out, saved = np.zeros((steps, n, HIDDEN), dtype=np.float32), []
    for t in range(steps):
        a = z[t] + h @ u
        g = _sigmoid(a[:, : 3 * HIDDEN])
        i, f, o, new = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :], np.tanh(a[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        c2 = f * c + i * new
        th = np.tanh(c2)
        if keep:
            saved.append((h, c, i, f, o, new, th, m))
        h, c = m * (o * th) + (1 - m) * h, m * c2 + (1 - m) * c
        out[t] = h
    return out, saved, (h, c)


def _back(x: np.ndarray, saved: list, d_out: np.ndarray, u: np.ndarray):
    dw, du, db = 0.0, np.zeros_like(u), 0.0
    dh = dc = np.zeros_like(d_out[0])
    da_all = np.zeros((*d_out.shape[:2], 4 * HIDDEN), dtype=np.float32)
    for t in range(len(saved) - 1, -1, -1):
        h, c, i, f, o, new, th, m = saved[t]
        dh = dh + d_out[t]
        own = dh * m
        dct = dc * m + own * o * (1 - th**2)
        da = np.concatenate([dct * new * i * (1 - i), dct * c * f * (1 - f), own * th * o * (1 - o), dct * i * (1 - new**2)], axis=1)
        du += h.T @ da
        da_all[t] = da
        dh, dc = da @ u.T + dh * (1 - m), dct * f + dc * (1 - m)
    flat = da_all.reshape(-1, 4 * HIDDEN)
    dw, db = x.reshape(-1, INPUT).T @ flat, flat.sum(0)
    return dw, du, db


class Labeller:
    """Weights: for each direction input, recurrent and bias; then the output layer over both directions and the input."""

    def __init__(self, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        one = lambda *shape: (r.standard_normal(shape) * 0.1).astype(np.float32)
        bias = np.zeros(4 * HIDDEN, dtype=np.float32)
        bias[HIDDEN : 2 * HIDDEN] = 1
        self.weights = [w for _ in range(2) for w in (one(INPUT, 4 * HIDDEN), one(HIDDEN, 4 * HIDDEN), bias.copy())] + [one(2 * HIDDEN + INPUT), np.zeros(1, dtype=np.float32)]

    def _forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        w = self.weights
        ahead, s1, _ = _run(x, mask, *w[:3], keep)
        behind, s2, _ = _run(x[::-1], mask[::-1], *w[3:6], keep)
        top = np.concatenate([ahead, behind[::-1], x], axis=2)
        return top @ w[6] + w[7][0], top, s1, s2

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Of each page's blocks; pages of about the same length run together."""
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        out: list[np.ndarray] = [np.zeros(0, dtype=np.float32)] * len(pages)
        while order:
            longest = len(pages[order[-1]])
            take = max(1, min(128, 20_000 // longest))
            part, order = order[-take:], order[:-take]
            g = self._forward(*_padded([pages[k] for k in part]))[0]
            for j, k in enumerate(part):
                out[k] = _sigmoid(g[: len(pages[k]), j])
        return out

    def long_page(self, found: list[Block], segment: int = 4096) -> np.ndarray:
        """The probabilities of one page's blocks, of which only a segment is held as vectors at a time."""
        w, starts = self.weights, range(0, len(found), segment)
        g, state = np.full(len(found), w[7][0], dtype=np.float32), None
        for a in starts:
            x = vectors(found[a : a + segment], a == 0)[:, None]
            out, _, state = _run(x, np.ones(x.shape[:2], dtype=np.float32), *w[:3], False, state)
            g[a : a + segment] += (out @ w[6][:HIDDEN] + x @ w[6][2 * HIDDEN :])[:, 0]
        state = None
        for a in reversed(starts):
            x = vectors(found[a : a + segment], a == 0)[::-1, None]
            out, _, state = _run(x, np.ones(x.shape[:2], dtype=np.float32), *w[3:6], False, state)
            g[a : a + segment] += (out @ w[6][HIDDEN : 2 * HIDDEN])[::-1, 0]
        return _sigmoid(g)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean logistic loss over all blocks, by the weights."""
        g, top, s1, s2 = self._forward(x, mask, keep=True)
        d = (_sigmoid(g) - y) * mask / mask.sum()
        d_top = d[:, :, None] * self.weights[6]
        ahead, behind = _back(x, s1, d_top[:, :, :HIDDEN], self.weights[1]), _back(x[::-1], s2, d_top[::-1, :, HIDDEN : 2 * HIDDEN], self.weights[4])
        return [*ahead, *behind, np.tensordot(d, top, axes=([0, 1], [0, 1])), d.sum(keepdims=True).reshape(1)]

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int, rate: float = 0.01, seed: int = 9) -> None:
        r = np.random.default_rng(seed)
        first, second, step = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0
        for _ in range(epochs):
            for part in np.array_split(r.permutation(len(pages)), max(1, len(pages) // 32)):
                x, mask = _padded([pages[k] for k in part])
                y = np.zeros(mask.shape, dtype=np.float32)
                for j, k in enumerate(part):
                    y[: len(labels[k]), j] = labels[k]
                step += 1
                for k, v in enumerate(self.gradients(x, mask, y)):
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.999 * second[k] + 0.001 * v * v
                    self.weights[k] = (self.weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def made_page(r: np.random.Generator) -> tuple[str, list[str]]:
    """A page in a random layout and the texts of its main blocks."""
    pick = lambda *x: x[int(r.integers(len(x)))]
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to is ou st le un ch la eau ge be zu lich sch ción os ado ue".split()
    word = lambda: "".join(pick(*syllables) for _ in range(int(r.integers(1, 4)))) + pick("", "", "", "", ".", ",", "***", "!!", "%%%")
    line = lambda lo, hi: " ".join(word() for _ in range(int(r.integers(lo, hi)))).capitalize()
    chance = lambda p: r.random() < p
    attr = lambda *names: "" if chance(0.3) else f' {pick("class", "id")}="{pick(*names)}"'
    links = lambda n: "".join(f'<li><a href="/{k}">{line(1, 4)}</a></li>' for k in range(n))
    main: list[str] = []

    def paragraph() -> str:
        t = line(1, 5) if chance(0.2) else line(4, 70)
        main.append(t)
        kind = pick("p", "p", "p", "p", "p", "h2", "li", "blockquote", "pre", "b", "div", "td", "h3")
        if kind == "li":
            return f"<ul><li>{t}</li></ul>"
        if kind == "b":
            return f"<p><b>{t}<br>" + ("</p>" if chance(0.3) else "")
        if kind == "td":
            return f"<table><tr><td>{t}</td></tr></table>"
        if chance(0.2):
            a, _, b = t.partition(" ")
            return f"<{kind}><a href='/x'>{a}</a> {b}</{kind}>"
        return f"<{kind}>{t}</{kind}>"

    def junk() -> str:
        kind = pick("ad", "ad", "aside", "form", "share", "comments", "related", "cookie", "newsletter", "breadcrumb", "author")
        if kind == "ad":
            return f"<{pick('div', 'section', 'aside')} {pick('class', 'id')}=\"{pick('ad', 'ads', 'advert', 'sponsored', 'promo', 'banner', 'ad-slot', 'advertisement')}\">{pick('{}', '<p>{}</p>', '<a href=/x>{}</a>').format(line(3, 15))}</{'div'}>"
        if kind == "aside":
            return f"<{(t := pick('aside', 'div'))} class=\"{pick('sidebar', 'side', 'widget', 'sidebar-left')}\">{pick('<h3>{}</h3>', '').format(line(1, 4))}<p>{line(3, 25)}</p><ul>{links(3)}</ul></{t}>"
        if kind == "form":
            return f"<form action=/s{attr('search', 'login', 'subscribe', 'signup')}><label>{line(1, 4)}</label><input name=q>{pick('<p>{}</p>', '').format(line(2, 12))}</form>"
        if kind == "comments":
            said = "".join(f'<{(t := pick("div", "li", "article", "p"))} class="{pick("comment", "comment-body", "reply")}">{pick("{}", "<p>{}</p>").format(line(2, 40))}</{t}>' for _ in range(int(r.integers(1, 5))))
            return f"<{(t := pick('div', 'section'))} {pick('id', 'class')}=\"{pick('comments', 'comment-list', 'discussion', 'reader-comments')}\"><h3>{line(1, 3)}</h3>{said}</{t}>"
        if kind == "related":
            return f"<{(t := pick('div', 'section', 'nav', 'aside'))} class=\"{pick('related', 'recommended', 'more', 'related-posts')}\"><h4>{line(1, 4)}</h4><ul>{links(4)}</ul></{t}>"
        names = {"share": ("share", "social"), "cookie": ("cookie", "consent", "notice", "cookie-notice", "cookie-banner", "gdpr"), "newsletter": ("newsletter", "subscribe"), "breadcrumb": ("breadcrumb", "breadcrumbs"), "author": ("byline", "meta", "post-meta")}[kind]
        return f"<div {pick('class', 'id')}=\"{pick(*names)}\">{pick('{}', '<p>{}</p>').format(line(2, 25))}</div>"

    title = line(2, 14)
    head = f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
    menu = pick(f"<nav{attr('menu', 'top')}><ul>{links(int(r.integers(2, 9)))}</ul></nav>", f'<div class="{pick("menu", "nav", "navbar")}"><ul>{links(4)}</ul></div>', f'<ul class="{pick("menu", "nav")}">{links(5)}</ul>', "")
    top = f"<header{attr('header', 'site-header', 'masthead')}>{pick('<h1>{}</h1>', '<p>{}</p>', '<div>{}</div>').format(line(1, 6))}{menu}</header>" if chance(0.4) else menu
    body = []
    if chance(0.8):
        main.append(title)
        body.append(f"<h1>{title}</h1>")
    for _ in range(int(r.integers(1, 16)) if chance(0.9) else 40):
        body.append(paragraph())
        if chance(0.04):
            body.append(junk())
    wrap = pick("article", "article", "article", "main", 'div class="content"', 'div id="main"', 'div class="article-body"', 'section class="post"', 'div class="entry-content"', 'div role="main"')
    article = f"<{wrap}>{''.join(body)}</{wrap.split()[0]}>"
    if chance(0.3):
        article = f"<{(w := pick('main', 'div class=\"container\"', 'div id=\"page\"'))}>{article}</{w.split()[0]}>"
    before, after = [junk() for _ in range(int(r.integers(0, 3)))], [junk() for _ in range(int(r.integers(0, 4)))]
    foot = pick(f"<footer{attr('footer', 'site-footer')}>{pick('&copy; {}', '{}', '<p>{}</p>', '&copy; x.example.com &middot; {}').format(line(2, 25))}</footer>", f'<div {pick("class", "id")}="footer"><p>&copy; {line(2, 20)}</p></div>', "")
    return head + top + "".join(before) + article + "".join(after) + foot + "</body></html>", main


@functools.lru_cache(maxsize=1)
def trained(pages: int = 900, epochs: int = 6, seed: int = 3) -> Labeller:
    """The labeller, trained on generated pages; always the same one."""
    r = np.random.default_rng(seed)
    x, y = [], []
    for _ in range(pages):
        page, main = made_page(r)
        found = blocks(page)
        wanted = [SPACE.sub(" ", t).strip() for t in main]
        label, k = np.zeros(len(found), dtype=np.float32), 0
        for j, b in enumerate(found):
            if k < len(wanted) and b.text == wanted[k]:
                label[j], k = 1, k + 1
        if k == len(wanted):
            x.append(vectors(found))
            y.append(label)
    model = Labeller()
    model.train(x, y, epochs)
    return model


#: Blocks of a page up to which it goes through the network with others.
LONG = 10_000


def extract(pages: list[str | None], model: Labeller) -> list[str]:
    found = [blocks(p) if isinstance(p, str) else [] for p in pages]
    labels = model.probabilities([vectors(f) if len(f) <= LONG else vectors([]) for f in found])
    labels = [model.long_page(f) if len(f) > LONG else p for f, p in zip(found, labels, strict=True)]
    return ["\n".join(b.text for b, p in zip(f, own, strict=True) if p >= 0.5) for f, own in zip(found, labels, strict=True)]


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page: a narrow map, no shuffle. The labeller's weights go along with the task."""
    model = trained()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = [p if isinstance(p, str) else "" for p in batch["html"]]
            for first, last in by_size(sizes, 1 << 21):
                part = batch.iloc[first:last]
                text = extract(list(part["html"]), model)
                yield pd.DataFrame({"page_id": part["page_id"].astype("Int64"), "url": part["url"], "text": text, "n_chars": [len(t) for t in text]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
