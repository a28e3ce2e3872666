"""Main text of web pages: a linear-chain CRF over DOM leaf blocks, decoded by Viterbi."""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^<]*\Z", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")
#: Elements that break a line of text; all others stand inside one.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
_RAW = frozenset(("script", "style", "noscript", "template", "textarea", "svg", "iframe", "object"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening element ends these open ones, up to the nearest list or table around it.
_ENDS = {"li": {"li", "p"}, "p": {"p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}}
_FENCE = frozenset("ul ol dl table select body html article section div nav aside main td".split())


class Block:
    """Text between two block boundaries, its ancestors, and how much of it is links."""

    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple[tuple[str, tuple[str, ...]], ...], linked: int):
        self.text, self.path, self.linked = text, path, linked


def leaf_blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order, without script and style; broken markup is read as far as it goes."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    out: list[Block] = []
    parts: list[str] = []
    linked = at = links = 0

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, tuple(stack), min(linked, len(text))))
        parts.clear()
        linked = 0

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at:
            parts.append(page[at:end])
            linked += (end - at) * (links > 0)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if name in BLOCKS:
                close()
            if name == "a":
                links = max(0, links - 1)
            if depth is not None and (name in BLOCKS or all(x[0] not in BLOCKS for x in stack[depth:])):
                if any(x[0] == "a" for x in stack[depth:]) and name != "a":
                    links = 0
                del stack[depth:]
            continue
        if name in _RAW:
            if not m[3].endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else n
            continue
        if name == "br":
            parts.append(" ")
        if name in BLOCKS:
            close()
        if name in _VOID or m[3].endswith("/"):
            continue
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in _ENDS.get(name, ()):
                del stack[i:]
            elif stack[i][0] in _FENCE:
                break
        marks = tuple(w for a in _ATTRIBUTE.findall(m[3]) for w in _NAME.findall((a[1] or a[2] or a[3]).lower()))
        stack.append((name, marks))
        links += name == "a"
    close()
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    """The names of each block's features: ancestor tags and marks, and text."""
    out = []
    for k, b in enumerate(blocks):
        n = len(b.text)
        own = {f"in={name}" for name, _ in b.path} | {f"mark={w}" for _, marks in b.path for w in marks}
        own.add(f"leaf={next((x for x, _ in reversed(b.path) if x in BLOCKS), '')}")
        own.add(f"length={min(6, int(math.log2(n + 1)) // 2)}")
        own.add(f"linked={int(4 * b.linked / n)}")
        if b.text[-1] in ".!?…\"”":
            own.add("stop")
        if b.text[0] in "©" or b.text.lower().startswith("copyright"):
            own.add("copyright")
        own.add(f"depth={min(6, len(b.path))}")
        if k == 0:
            own.add("first")
        if k == len(blocks) - 1:
            own.add("last")
        if not any(name in BLOCKS - {"html", "body"} for name, _ in b.path):
            own.add("bare")
        out.append(sorted(own))
    return out


class Chain:
    """A linear-chain CRF with two labels: 0 boilerplate, 1 main text."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights, moves
        self.scores = {name: (float(weights[k, 0]), float(weights[k, 1])) for name, k in names.items()}
        self.table = [[float(x) for x in row] for row in moves]

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The best labels, by Viterbi; of equal ones boilerplate."""
        back: list[tuple[int, int]] = []
        a = b = 0.0
        (t00, t01), (t10, t11) = self.table
        for k, row in enumerate(rows):
            e0 = e1 = 0.0
            for name in row:
                s = self.scores.get(name)
                if s:
                    e0 += s[0]
                    e1 += s[1]
            if k == 0:
                a, b = e0, e1
                continue
            from0, from1 = int(b + t10 > a + t00), int(b + t11 > a + t01)
            back.append((from0, from1))
            a, b = max(a + t00, b + t10) + e0, max(a + t01, b + t11) + e1
        if not rows:
            return []
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    @classmethod
    def fit(cls, pages: list[tuple[list[list[str]], list[int]]], epochs: int = 12, rate: float = 0.3, decay: float = 1e-4, seed: int = 1) -> Chain:
        """Trained on labelled pages by gradient steps on the conditional log-likelihood."""
        names = {x: k for k, x in enumerate(sorted({f for rows, _ in pages for row in rows for f in row}))}
        w, t = np.zeros((len(names), 2)), np.zeros((2, 2))
        gw, gt = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
        coded = [([[names[f] for f in row] for row in rows], labels) for rows, labels in pages if rows]
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(coded)):
                rows, labels = coded[k]
                e = np.array([w[row].sum(0) for row in rows])
                alpha, beta = e.copy(), np.zeros_like(e)
                for i in range(1, len(e)):
                    alpha[i] += np.logaddexp.reduce(alpha[i - 1][:, None] + t, 0)
                for i in range(len(e) - 2, -1, -1):
                    beta[i] = np.logaddexp.reduce(t + e[i + 1] + beta[i + 1], 1)
                z = np.logaddexp.reduce(alpha[-1])
                node = np.exp(alpha + beta - z)
                node[np.arange(len(labels)), labels] -= 1
                pair = np.exp(alpha[:-1, :, None] + t + (e[1:] + beta[1:])[:, None, :] - z).sum(0)
                for i, j in zip(labels, labels[1:], strict=False):
                    pair[i, j] -= 1
                for row, g in zip(rows, node, strict=True):
                    g = g + decay * w[row]
                    gw[row] += g * g
                    w[row] -= rate * g / np.sqrt(gw[row])
                gt += pair * pair
                t -= rate * pair / np.sqrt(gt)
        return cls(names, w, t)


def _words(rng: random.Random, low: int, high: int) -> str:
    return " ".join("".join(rng.choice(("th", "er", "on", "an", "re", "es", "la", "de", "ch", "ver", "ti", "ou")) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high)))


def labelled_page(rng: random.Random) -> tuple[str, set[str]]:
    """A made-up page and the texts of its main blocks; layouts and their names vary."""
    main: set[str] = set()
    used: set[str] = set()

    def text(good: bool, low: int, high: int) -> str:
        while (s := _words(rng, low, high)) in used:
            low, high = low + 1, high + 1
        s = s[:1].upper() + s[1:]
        if rng.random() < (0.8 if good else 0.4):
            s += "."
        used.add(s.lower())
        if good:
            main.add(s)
        return s

    def bad(low: int = 1, high: int = 8) -> str:
        return text(False, low, high)

    def mark(*names: str) -> str:
        name = rng.choice(names)
        return rng.choice((f' class="{name}"', f' id="{name}"', f' class="{name} {rng.choice(("box", "wide", "left"))}"'))

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{k}">{bad(1, 3)}</a></li>' for k in range(n))

    def menu() -> str:
        body = f"<ul>{links(rng.randint(2, 8))}</ul>"
        return rng.choice((f"<nav>{body}</nav>", f"<div{mark('menu', 'nav', 'navbar', 'navigation')}>{body}</div>", f'<div role="navigation">{body}</div>'))

    def header() -> str:
        return rng.choice((f"<header><h2>{bad(1, 4)}</h2><p>{bad(2, 8)}</p></header>", f"<div{mark('header', 'masthead', 'banner', 'top')}><p>{bad(1, 6)}</p>{menu()}</div>", ""))

    def footer() -> str:
        body = rng.choice(("&copy; ", "Copyright ", "")) + bad(2, 12)
        return rng.choice((f"<footer>{body}</footer>", f"<footer><p>{body}</p></footer>", f"<div{mark('footer', 'bottom')}><p>{body}</p></div>"))

    def advert() -> str:
        return rng.choice((f"<div{mark('ad', 'ads', 'advert', 'sponsor', 'promo', 'banner')}>{bad(3, 30)}</div>", f"<aside{mark('ad', 'promo')}><p>{bad(3, 30)}</p></aside>", f"<ins{mark('ad', 'ads')}><p>{bad(3, 12)}</p></ins>"))

    def aside() -> str:
        return rng.choice((f"<aside><h3>{bad(1, 3)}</h3><ul>{links(3)}</ul></aside>", f"<div{mark('sidebar', 'related', 'widget', 'side')}><h3>{bad(1, 3)}</h3><p>{bad(3, 25)}</p></div>", f"<aside><p>{bad(5, 40)}</p></aside>"))

    def notice() -> str:
        return rng.choice((f"<div{mark('notice', 'cookie', 'consent', 'alert', 'popup', 'newsletter', 'subscribe', 'share', 'breadcrumb', 'modal')}><p>{bad(4, 30)}</p></div>", f"<p{mark('notice', 'disclaimer', 'cookie')}>{bad(4, 20)}</p>", f'<div role="dialog"><p>{bad(4, 20)}</p></div>'))

    def form() -> str:
        return f"<form><label>{bad(1, 3)}</label><select><option>{bad(1, 2)}<option>{bad(1, 2)}</select><p>{bad(2, 10)}</p><button>{bad(1, 2)}</button></form>"

    def comments() -> str:
        body = "".join(f"<p>{bad(2, 50)}</p>" if rng.random() < 0.6 else f"<div{mark('comment', 'reply')}><p>{bad(2, 50)}</p></div>" for _ in range(rng.randint(1, 5)))
        return rng.choice((f"<section{mark('comments', 'comment', 'discussion', 'responses')}><h3>{bad(1, 3)}</h3>{body}</section>", f"<div{mark('comments', 'replies', 'disqus')}>{body}</div>", f"<ol{mark('comments', 'commentlist')}><li>{bad(3, 40)}</li><li>{bad(3, 40)}</li></ol>"))

    def paragraph() -> str:
        kind = rng.random()
        if kind < 0.6:
            return f"<p>{text(True, 2, 80)}</p>"
        if kind < 0.68:
            return f"<p><b>{text(True, 2, 40)}<br>"
        if kind < 0.75:
            return f"<ul><li>{text(True, 2, 15)}</li><li>{text(True, 2, 15)}</li></ul>"
        if kind < 0.82:
            return f"<blockquote>{text(True, 5, 40)}</blockquote>"
        if kind < 0.89:
            return f"<h2>{text(True, 1, 6)}</h2>"
        if kind < 0.93:
            return f"<table><tr><td>{text(True, 1, 5)}</td><td>{text(True, 1, 5)}</td></tr></table>"
        if kind < 0.97:
            return f"<pre>{text(True, 2, 20)}</pre>"
        return f"<figure><img src=x><figcaption>{text(True, 2, 12)}</figcaption></figure>"

    inner = [f"<h1>{text(True, 1, 9)}</h1>"] if rng.random() < 0.8 else []
    inner += [paragraph() for _ in range(rng.randint(1, 9))]
    for part in (advert, aside, notice, menu, comments, form):
        if rng.random() < 0.08:
            inner.insert(rng.randint(0, len(inner)), part())
    inside = "".join(inner)
    article = rng.choice((f"<article>{inside}</article>", f"<article>{inside}</article>", f"<main>{inside}</main>", f"<main><article>{inside}</article></main>", f"<div{mark('content', 'article', 'post', 'entry', 'story', 'main', 'text')}>{inside}</div>", f"<div><div{mark('body', 'page', 'wrapper')}>{inside}</div></div>", f"<section><article{mark('post', 'entry')}>{inside}</article></section>", f"<div>{inside}</div>", inside))
    if rng.random() < 0.06:
        return rng.choice((text(True, 1, 60), inside, f"<html><body>{inside}")), main
    before = "".join(p() for p in (notice, header, menu, advert, aside, form) if rng.random() < 0.45)
    after = "".join(p() for p in (aside, comments, advert, form, notice, menu, footer) if rng.random() < 0.45)
    page = f"<!DOCTYPE html><html><head><title>{bad(1, 9)}</title><style>p{{}}</style></head><body>{before}{article}{after}"
    if rng.random() < 0.1:
        page = page.replace(after, "") if after else page
    return page + "</body></html>", main


@functools.lru_cache(2)
def trained(pages: int = 700, seed: int = 23) -> Chain:
    """A chain fitted on made-up labelled pages; the same on every machine."""
    rng = random.Random(seed)
    own = []
    for _ in range(pages):
        page, main = labelled_page(rng)
        blocks = leaf_blocks(page)
        own.append((features(blocks), [int(b.text in main) for b in blocks]))
    return Chain.fit(own)


def main_text(page: str, chain: Chain) -> str:
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, keep in zip(blocks, chain.decode(features(blocks)), strict=True) if keep)


def _extractor(chain: Chain, html_at: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x or "", chain) for x in part.column(html_at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:html_at], *part.columns[html_at + 1 :], pa.array(texts, pa.string())], names=[*(c for k, c in enumerate(part.schema.names) if k != html_at), name])

    return run


def extract(pages: DataFrame, html_col: str = "html", name: str = "text", chain: Chain | None = None) -> DataFrame:
    """pages with the main text as column `name` in the place of html_col.

    Blocks are in page order, one a line; white space in a block is one space. A
    page without markup is one block. Null, empty and blank pages have an empty
    text. A column called `name` is replaced; other columns and repeated rows stay.
    """
    own = pages.drop(name) if name != html_col else pages
    at = own.columns.index(html_col)
    rest = [f for k, f in enumerate(own.schema.fields) if k != at]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), f"`{name}` string"])
    return own.mapInArrow(_extractor(chain or trained(), at, name), schema)


def digest(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page, a row a row: null and empty pages have an empty text, repeated ones repeat.

    Null ids and addresses stay null; other columns are not read.
    """
    found = extract(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
