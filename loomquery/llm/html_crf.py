"""HTML extraction by a linear-chain conditional random field over DOM leaf blocks.

A tolerant parser cuts a page into leaf blocks: texts between block-level tags, with their ancestors. Features are the
ancestors' tags, words of their class and id, and figures of the text (length, links, punctuation, place). The field has
two labels, boilerplate and content; weights come from labelled pages (those whose content carries ``data-gold``) by
maximum likelihood, and Viterbi decoding labels all blocks of a page together. By default it is trained on pages
generated here in several layouts (``TRAIN_PAGES``, a documented bound); ``fit`` takes any other labelled pages.

Defined cases: null html gives null text, empty html and pages without content blocks the empty text; broken markup
never fails, and an unclosed script swallows the rest; repeated pages are extracted alike; null ids and urls are kept; of
labels that tie boilerplate wins; very long pages are parsed whole, in about 40 bytes a character and 300 a block; an
empty table gives no rows; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import html as html_module
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_text, read

TRAIN_PAGES = 240
EPOCHS, RATE, PENALTY = 200, 0.1, 1e-3
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b[^>]*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>|<[!?][^>]*+>|([^<]++)|<", re.S | re.I)
_ATTRIBUTES = re.compile(r"(?:\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))|(\bdata-gold\b)", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i img input kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TAGS = "html head title body nav header footer aside article main section div form table tr td th ul ol li dl p h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption button select option iframe".split()
_GOOD_WORDS, _BAD_WORDS = "content article post entry story main text body".split(), "nav menu side foot head ad ads advert banner cookie comment share social relat promo crumb widget login search tag meta".split()
_TAG_AT = {t: i for i, t in enumerate(_TAGS)}
_LENGTHS, _LINKS = (3, 6, 12, 25, 50, 100), (0.01, 0.25, 0.5, 0.9)
FEATURES = 1 + len(_TAGS) + len(_GOOD_WORDS) + len(_BAD_WORDS) + len(_LENGTHS) + len(_LINKS) + 8


class Leaf:
    """A leaf block: its text, the tags and class words of its ancestors, the share of its characters in links."""

    __slots__ = ("text", "tags", "words", "links", "gold")

    def __init__(self, text: str, tags: tuple, words: frozenset, links: float, gold: bool):
        self.text, self.tags, self.words, self.links, self.gold = text, tags, words, links, gold


def leaves(page: str) -> list[Leaf]:
    """The leaf blocks of a page in order."""
    out: list[Leaf] = []
    stack: list[tuple[str, frozenset, bool]] = []  # tag, class words of it and its ancestors, gold
    buffer: list[str] = []
    linked = total = anchors = 0

    def flush() -> None:
        nonlocal linked, total
        text = " ".join(html_module.unescape("".join(buffer)).split())
        if text:
            top = stack[-1] if stack else ("", frozenset(), False)
            out.append(Leaf(text, tuple(dict.fromkeys(t for t, _, _ in stack)), top[1], linked / max(total, 1), top[2]))
        buffer.clear()
        linked = total = 0

    for m in _TOKEN.finditer(page):
        data = m[5]
        if data is not None or m[0] == "<":
            data = data or "<"
            buffer.append(data)
            n = len(data.strip())
            total += n
            linked += n if anchors else 0
        elif m[3]:
            tag = m[3].lower()
            if tag in _INLINE:
                if tag == "a":
                    anchors = max(0, anchors + (-1 if m[2] else 1))
                continue
            if tag == "br":
                buffer.append(" ")
                continue
            flush()
            anchors = 0
            if m[2]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            elif tag not in _VOID:
                if stack and stack[-1][0] == tag and tag in ("p", "li", "option", "tr", "td"):
                    stack.pop()
                words, gold = (stack[-1][1], stack[-1][2]) if stack else (frozenset(), False)
                if m[4]:
                    for a, b, c, g in _ATTRIBUTES.findall(m[4]):
                        gold = gold or bool(g)
                        if a or b or c:
                            words = words | frozenset(re.findall(r"[a-z]+", (a or b or c).lower()))
                stack.append((tag, words, gold))
    flush()
    return out


_hits: dict[frozenset, list[int]] = {}


def _word_features(words: frozenset) -> list[int]:
    if words not in _hits:
        if len(_hits) > 10_000:
            _hits.clear()
        at = 1 + len(_TAGS)
        good = [at + i for i, w in enumerate(_GOOD_WORDS) if w in words]
        bad = [at + len(_GOOD_WORDS) + i for i, b in enumerate(_BAD_WORDS) if any(w == b or (len(b) > 3 and w.startswith(b)) for w in words)]
        _hits[words] = good + bad
    return _hits[words]


def features(page: list[Leaf]) -> np.ndarray:
    """A row of 0/1 features a block."""
    x = np.zeros((len(page), FEATURES), np.float32)
    base = 1 + len(_TAGS) + len(_GOOD_WORDS) + len(_BAD_WORDS)
    for i, leaf in enumerate(page):
        on = [0]
        for t in leaf.tags:
            j = _TAG_AT.get(t)
            if j is not None:
                on.append(1 + j)
        if leaf.words:
            on += _word_features(leaf.words)
        text = leaf.text
        n = text.count(" ") + 1
        on += [base + j for j, k in enumerate(_LENGTHS) if n >= k]
        on += [base + len(_LENGTHS) + j for j, k in enumerate(_LINKS) if leaf.links >= k]
        at = base + len(_LENGTHS) + len(_LINKS)
        stops = text.count(".") + text.count("!") + text.count("?")
        for j, ok in enumerate((text[-1] in ".!?:\"”", stops >= 2, "," in text, "©" in text, "|" in text or "·" in text, i < 0.15 * len(page), i > 0.85 * len(page), text[0].isupper())):
            if ok:
                on.append(at + j)
        x[i, on] = 1
    return x


class Field:
    """Weights: emission (features x 2), transition (2 x 2), start and end (2 each)."""

    def __init__(self, emission: np.ndarray, transition: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.emission, self.transition, self.start, self.end = emission, transition, start, end

    def decode(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The likeliest labels of all pages at once (Viterbi)."""
        n = np.array([len(p) for p in pages])
        if not n.sum():
            return [np.zeros(0, np.int64) for _ in pages]
        score = np.concatenate([p for p in pages if len(p)]) @ self.emission
        first = np.cumsum(n) - n
        most = int(n.max())
        best = np.zeros((len(pages), 2))
        back = np.zeros((most, len(pages), 2), np.int8)
        last = np.zeros((len(pages), 2))
        for t in range(most):
            on = np.flatnonzero(n > t)
            s = score[first[on] + t]
            if t == 0:
                best[on] = s + self.start
            else:
                ways = best[on][:, :, None] + self.transition
                back[t, on] = ways.argmax(1)
                best[on] = ways.max(1) + s
            done = on[n[on] == t + 1]
            last[done] = best[done] + self.end
        out = np.zeros((most, len(pages)), np.int64)
        now = last.argmax(1)
        for t in range(most - 1, -1, -1):
            on = np.flatnonzero(n > t)
            out[t, on] = now[on]
            now[on] = back[t, on, now[on]]
        return [out[: n[i], i] for i in range(len(pages))]


class Examples:
    """Labelled pages as arrays: features, labels and length of each, padded to the longest."""

    def __init__(self, pages: list[np.ndarray], labels: list[list[bool]]):
        self.n = np.array([len(p) for p in pages])
        docs, most = len(pages), int(self.n.max())
        x = np.zeros((docs, most, pages[0].shape[1]), np.float32)
        y = np.zeros((docs, most), np.int64)
        for i, (p, gold) in enumerate(zip(pages, labels)):
            x[i, : len(p)], y[i, : len(p)] = p, gold
        self.shape = (docs, most, 2)
        self.live = np.arange(most) < self.n[:, None]
        self.gold = np.eye(2)[y] * self.live[:, :, None]
        self.flat = x.reshape(docs * most, -1)


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)


def likelihood(weights: list[np.ndarray], data: Examples, penalty: float) -> tuple[float, list[np.ndarray]]:
    """The mean log-likelihood of the labels less the penalty, and its gradient, by forward-backward."""
    emission, step, start, end = weights
    docs, most, _ = data.shape
    live, row = data.live, np.arange(docs)
    s = (data.flat @ emission).reshape(data.shape)
    ahead, behind = np.zeros(data.shape), np.zeros(data.shape)
    ahead[:, 0] = s[:, 0] + start
    for t in range(1, most):
        ahead[:, t] = np.where(live[:, t, None], _lse(ahead[:, t - 1, :, None] + step, 1) + s[:, t], ahead[:, t - 1])
    behind[:, most - 1] = end
    for t in range(most - 2, -1, -1):
        behind[:, t] = np.where(live[:, t + 1, None], _lse(step + (s[:, t + 1] + behind[:, t + 1])[:, None, :], 2), end)
    z = _lse(ahead[:, most - 1] + end, 1)
    p = np.exp(ahead + behind - z[:, None, None]) * live[:, :, None]
    pair = np.exp(ahead[:, :-1, :, None] + step + (s[:, 1:] + behind[:, 1:])[:, :, None, :] - z[:, None, None, None]) * live[:, 1:, None, None]
    steps = np.einsum("dta,dtb->ab", data.gold[:, :-1], data.gold[:, 1:])
    value = ((s * data.gold).sum() + (steps * step).sum() + (data.gold[:, 0] @ start).sum() + (data.gold[row, data.n - 1] @ end).sum() - z.sum()) / docs
    wrong = data.gold - p
    grads = [data.flat.T @ wrong.reshape(-1, 2), steps - pair.sum((0, 1)), wrong[:, 0].sum(0), wrong[row, data.n - 1].sum(0)]
    return value - penalty / 2 * sum((w**2).sum() for w in weights), [g / docs - penalty * w for g, w in zip(grads, weights)]


def fit(pages: list[str], epochs: int = EPOCHS, rate: float = RATE, penalty: float = PENALTY) -> Field:
    """Maximum likelihood by Adam on pages whose content elements carry data-gold."""
    parsed = [p for p in map(leaves, pages) if p]
    data = Examples([features(p) for p in parsed], [[leaf.gold for leaf in p] for p in parsed])
    weights = [np.zeros((FEATURES, 2)), np.zeros((2, 2)), np.zeros(2), np.zeros(2)]
    m1, m2 = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for epoch in range(1, epochs + 1):
        _, grads = likelihood(weights, data, penalty)
        for i, g in enumerate(grads):
            m1[i] = 0.9 * m1[i] + 0.1 * g
            m2[i] = 0.999 * m2[i] + 0.001 * g * g
            weights[i] = weights[i] + rate * (m1[i] / (1 - 0.9**epoch)) / (np.sqrt(m2[i] / (1 - 0.999**epoch)) + 1e-8)
    return Field(*weights)


def labelled_pages(n: int = TRAIN_PAGES, seed: int = 7) -> list[str]:
    """Pages in varied layouts, their content elements marked with data-gold."""
    r = random.Random(seed)
    syllables = "ta re mi on el sa ver in dor qui les ner po ala ist um ka".split()

    def word() -> str:
        return "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def sentence(lo: int = 5, hi: int = 18) -> str:
        w = [word() for _ in range(r.randint(lo, hi))]
        if len(w) > 7 and r.random() < 0.5:
            w[3] += ","
        return " ".join(w).capitalize() + r.choice("....!?")

    def paragraph() -> str:
        text = " ".join(sentence() for _ in range(r.choice((1, 1, 2, 3, 5, 8))))
        if r.random() < 0.2:
            text = text.replace(" ", f' <a href="/{word()}">{word()}</a> ', 1)
        if r.random() < 0.2:
            text = "<b>" + text + r.choice(("</b>", "<br>"))
        return text

    def links(k: int, open_: str, close: str) -> str:
        return open_ + "".join(f'<li><a href="/{word()}">{" ".join(word() for _ in range(r.randint(1, 3)))}</a></li>' for _ in range(k)) + close

    out = []
    for _ in range(n):
        head = f"<!DOCTYPE html><html><head><title>{sentence(2, 6)}</title><style>p{{margin:0}}</style></head><body>"
        menu = links(r.randint(3, 9), *r.choice((("<nav><ul>", "</ul></nav>"), ('<div class="menu"><ul>', "</ul></div>"), ('<header><ul id="nav">', "</ul></header>"), ("<ul>", "</ul>"))))
        ads = [f'<{t} class="{c}">{sentence(3, 22)}</{t}>' for t, c in r.sample((("div", "ad"), ("aside", "promo"), ("div", "cookie-banner"), ("div", "sidebar"), ("section", "related"), ("div", "share social")), r.randint(0, 3))]
        parts = [f"<h1 data-gold>{sentence(2, 8)}</h1>"]
        for _ in range(r.choice((1, 2, 3, 5, 8, 14))):
            kind = r.random()
            if kind < 0.75:
                parts.append(f"<p data-gold>{paragraph()}</p>")
            elif kind < 0.85:
                parts.append(f"<h2 data-gold>{sentence(1, 5)}</h2>")
            elif kind < 0.92:
                parts.append("<ul>" + "".join(f"<li data-gold>{sentence(3, 9)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.96:
                parts.append(f"<blockquote data-gold>{paragraph()}</blockquote>")
            else:
                parts.append(f'<div class="ad">{sentence(3, 12)}</div>')
        a, b = r.choice((("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="post-body">', "</div>"), ("<main><article>", "</article></main>"), ("<div>", "</div>"), ("<section>", "</section>"), ("<table><tr><td>", "</td></tr></table>")))
        tail = r.choice((f"<footer>&copy; {word()}.example &middot; {sentence(4, 16)}</footer>", f'<div class="footer">&copy; {word()} | {sentence(2, 6)}</div>', f"<footer><p>{sentence(4, 20)}</p></footer>", links(4, '<footer><ul>', "</ul></footer>")))
        after = [f'<div class="comments"><p>{sentence(3, 14)}</p><p>{sentence(2, 9)}</p></div>'] if r.random() < 0.25 else []
        r.shuffle(ads)
        cut = r.randint(0, len(ads))
        out.append(head + menu + "".join(ads[:cut]) + a + "".join(parts) + b + "".join(ads[cut:] + after) + tail + "</body></html>")
    return out


@lru_cache(1)
def default_field() -> Field:
    """Trained once a driver."""
    return fit(labelled_pages())


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """(page_id, url, text, blocks, content_blocks): the content blocks of each page, one a line."""
    shared = pages.sparkSession.sparkContext.broadcast(field or default_field())
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        raw = part.column("html").to_pylist()
        parsed = [leaves(p or "") for p in raw]
        labels = shared.value.decode([features(p) for p in parsed])
        text = [None if r is None else "\n".join(leaf.text for leaf, on in zip(p, y.tolist()) if on) for r, p, y in zip(raw, parsed, labels)]
        return pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array([len(p) for p in parsed], pa.int32()), pa.array([int(y.sum()) for y in labels], pa.int32())], ["page_id", "url", "text", "blocks", "content_blocks"])

    return map_text(pages.select("page_id", "url", "html"), run, f"page_id {kind}, url string, text string, blocks int, content_blocks int", column="html")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
