"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks (runs of text between block-level tags).  Each block is a
vector of its tag path (names, classes and ids, hashed), its words (hashed) and a few
measures such as link share and length.  A bidirectional LSTM in numpy reads the blocks of
the whole page and labels each as main text or not, so a block is judged with everything
before and after it in view.  The labeller is trained here, from a fixed seed, on
generated pages of many layouts (:func:`training_pages`); no page of the input is used.

Scripts, styles, comments and the head are never text; what stands inside a script or another
raw-text element is no markup and ends at its literal end tag.  White space inside a block becomes
one space; character references are decoded.  Null or empty html gives an empty text; a
page cut short keeps what it has; very long pages are read whole.  Repeated rows are
answered one by one.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilquery.llm._common import ALNUM_LOWER, words_of

#: Fixed by HTML: elements that hold no text, that are not closed, and that break a line of text.
_HIDDEN = {"script", "style", "head", "title", "template", "noscript", "svg", "iframe", "object", "math", "canvas", "audio", "video"}
#: Elements whose content is no markup: it ends at their literal end tag.
_RAW = {"script", "style", "title", "iframe", "textarea", "xmp"}
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "label", "legend", "li", "main", "menu", "nav", "ol",
    "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "textarea", "tfoot", "th", "thead", "tr", "ul",
}
#: A start tag that ends an open element of the same kind within the nearest of the given parents.
_ENDS = {"p": {"p"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "div", "article", "section", "body", "td", "nav", "aside", "main", "header", "footer", "form", "blockquote", "select"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[a-zA-Z/][^>]*(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACES = re.compile(r"\s+")

_PATH, _WORDS, _MEASURES = 64, 24, 8
_SIZE = _PATH + _WORDS + _MEASURES
_HIDDEN_UNITS = 20


class Path:
    """An open block element and those around it; long paths share what they have in common."""

    __slots__ = ("element", "outer", "seen")

    def __init__(self, outer: Path | None, element: str):
        self.outer, self.element, self.seen = outer, element, None

    def vector(self) -> np.ndarray:
        """All elements' names and marks, hashed, and the innermost element's name."""
        path, waiting = self, []
        while path is not None and path.seen is None:
            waiting.append(path)
            path = path.outer
        seen = np.zeros(_PATH, dtype=np.float32) if path is None else path.seen
        for p in reversed(waiting):
            own = _cells(p.element)[0]
            if not seen[own].all():
                seen = seen.copy()
                seen[own] = 1
            p.seen = seen
        out = self.seen.copy()
        out[_cells(self.element)[1]] = 1
        return out


@lru_cache(maxsize=20_000)
def _cells(element: str) -> tuple[list[int], list[int]]:
    """Where an element's name and marks count in any place of a path, and where its name counts as the innermost."""
    tokens = re.findall(r"[a-z0-9]+", element)
    # an element's name and its marks are different features
    anywhere = [zlib.crc32(f"{'n' if k == 0 else 'm'}{t}".encode()) % (_PATH - 16) for k, t in enumerate(tokens)]
    return anywhere, [_PATH - 16 + zlib.crc32(t.encode()) % 16 for t in tokens[:1]]


def blocks_of(page: str) -> list[tuple[Path | None, str, float]]:
    """Tag path, text and share of text inside links of each leaf block, in page order; time in proportion to the page."""
    out: list[tuple[Path | None, str, float]] = []
    stack: list[tuple[str, Path | None]] = []
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    linked = 0
    links = 0
    at, skip = 0, None

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = _SPACES.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                out.append((stack[-1][1] if stack else None, text, min(1.0, linked / len(text))))
        pieces, linked = [], 0

    def close(depth: int) -> None:
        nonlocal links
        for name, _ in stack[depth:]:
            links -= name == "a"
            opened[name] -= 1
        del stack[depth:]

    m = _TOKEN.search(page)
    while m:
        start, end = m.span()
        name = (m[2] or "").lower()
        after = end
        if name in _RAW and not m[1] and not m[3].rstrip().endswith("/"):
            closing = _RAW_END[name].search(page, end)
            after = closing.start() if closing else len(page)
        token, m = m, _TOKEN.search(page, after)
        if skip is not None:
            if token[1] and name == skip:
                skip = None
                at = end
            continue
        if start > at:
            text = page[at:start]
            pieces.append(text)
            if links > 0:
                linked += len(text.strip())
        at = end
        if not name:
            continue
        if token[1]:
            if name in _BLOCK:
                flush()
            if opened[name]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            continue
        if name in _HIDDEN and not token[3].rstrip().endswith("/"):
            if name != "head":
                skip = name
            continue
        if name in _BLOCK:
            flush()
            ends = _ENDS.get(name)
            if ends and any(opened[x] for x in ends):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ends:
                        close(k)
                        break
                    if stack[k][0] in _SCOPE:
                        break
        elif name == "br":
            pieces.append(" ")
        if name not in _VOID:
            path = stack[-1][1] if stack else None
            if name in _BLOCK and name not in ("html", "body"):
                marks = " ".join(x for found in _NAMED.findall(token[3]) for x in found if x).lower() if token[3] else ""
                path = Path(path, f"{name} {marks}".strip())
            stack.append((name, path))
            opened[name] += 1
            links += name == "a"
    if skip is None and at < len(page):
        pieces.append(page[at:])
    flush()
    return out


def _path_vector(path: Path | None) -> np.ndarray:
    return np.zeros(_PATH, dtype=np.float32) if path is None else path.vector()


def _vectors(blocks: list[tuple[Path | None, str, float]]) -> np.ndarray:
    x = np.zeros((len(blocks), _SIZE), dtype=np.float32)
    if not blocks:
        return x
    texts = [t.encode() for _, t, _ in blocks]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    words = words_of(np.frombuffer(b"".join(texts), np.uint8), bounds, ALNUM_LOWER)
    count = np.diff(words.first)
    row = np.repeat(np.arange(len(blocks)), count)
    hashed = np.bincount(row * _WORDS + (words.hashes % np.uint64(_WORDS)).astype(np.int64), minlength=len(blocks) * _WORDS).reshape(len(blocks), _WORDS)
    x[:, :_PATH] = [_path_vector(p) for p, _, _ in blocks]
    x[:, _PATH : _PATH + _WORDS] = hashed / np.maximum(count, 1)[:, None]
    m = x[:, _PATH + _WORDS :]
    m[:, 0] = np.log1p(count) / 4
    m[:, 1] = [share for _, _, share in blocks]
    m[:, 2] = [t.count(".") + t.count(",") + t.count("?") + t.count("!") for _, t, _ in blocks] / np.maximum(count, 1)
    m[:, 3] = np.arange(len(blocks)) / max(1, len(blocks) - 1)
    m[:, 4] = count <= 3
    m[:, 5] = [t[-1] in ".!?:;\"'" for _, t, _ in blocks]
    m[:, 6] = count >= 12
    m[:, 7] = ["©" in t or "(c)" in t.lower() for _, t, _ in blocks]
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """One bidirectional LSTM layer and a logistic output; weights by name."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    @staticmethod
    def fresh(seed: int) -> Labeller:
        r, h = np.random.default_rng(seed), _HIDDEN_UNITS
        w = {}
        for d in "fb":
            w[f"x{d}"] = (r.standard_normal((_SIZE, 4 * h)) / np.sqrt(_SIZE) * 1.5).astype(np.float32)
            w[f"h{d}"] = (r.standard_normal((h, 4 * h)) / np.sqrt(h)).astype(np.float32)
            w[f"c{d}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)
        w["o"] = (r.standard_normal(2 * h + _SIZE) * 0.05).astype(np.float32)
        w["p"] = np.zeros(1, dtype=np.float32)
        return Labeller(w)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """Hidden states (pages, blocks, units) in reading order of direction d; padding leaves the state as it is."""
        h_size, w = _HIDDEN_UNITS, self.weights
        n, t = mask.shape
        out = np.zeros((n, t, h_size), dtype=np.float32)
        h = np.zeros((n, h_size), dtype=np.float32)
        c = np.zeros_like(h)
        inputs = x @ w[f"x{d}"] + w[f"c{d}"]
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = inputs[:, k] + h @ w[f"h{d}"]
            gates = _sigmoid(z[:, : 3 * h_size])
            i, f, o = gates[:, :h_size], gates[:, h_size : 2 * h_size], gates[:, 2 * h_size :]
            g = np.tanh(z[:, 3 * h_size :])
            live = mask[:, k, None]
            c2 = np.where(live, f * c + i * g, c)
            tc = np.tanh(c2)
            h2 = np.where(live, o * tc, h)
            if keep is not None:
                keep.append((k, h, c, i, f, o, g, tc, live))
            h, c = h2, c2
            out[:, k] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, "f", None), self._run(x, mask, "b", None), x], axis=2)
        return both @ self.weights["o"] + self.weights["p"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        h_size, w = _HIDDEN_UNITS, self.weights
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(x, mask, "f", kept["f"]), self._run(x, mask, "b", kept["b"]), x], axis=2)
        p = _sigmoid(both @ w["o"] + w["p"])
        n = mask.sum()
        loss = float(-(np.log(np.maximum(np.where(y, p, 1 - p), 1e-9)) * mask).sum() / n)
        d_out = ((p - y) * mask / n).astype(np.float32)
        grads = {"o": np.einsum("nt,ntk->k", d_out, both), "p": np.array([d_out.sum()])}
        for j, d in enumerate("fb"):
            part = d_out[:, :, None] * w["o"][j * h_size : (j + 1) * h_size]
            dh, dc = np.zeros((len(x), h_size), np.float32), np.zeros((len(x), h_size), np.float32)
            dz_all = np.zeros((*mask.shape, 4 * h_size), np.float32)
            gh = np.zeros_like(w[f"h{d}"])
            for k, h0, c0, i, f, o, g, tc, live in reversed(kept[d]):
                dh = dh + part[:, k]
                go = dh * tc
                gc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([gc * g * i * (1 - i), gc * c0 * f * (1 - f), go * o * (1 - o), gc * i * (1 - g * g)], axis=1) * live
                dz_all[:, k] = dz
                gh += h0.T @ dz
                dh = np.where(live, dz @ w[f"h{d}"].T, dh)
                dc = np.where(live, gc * f, dc)
            grads[f"h{d}"] = gh
            grads[f"x{d}"] = np.einsum("nti,ntj->ij", x, dz_all, optimize=True)
            grads[f"c{d}"] = dz_all.sum(axis=(0, 1))
        return loss, grads


def _padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(len(s) for s in sequences)
    x = np.zeros((len(sequences), t, _SIZE), dtype=np.float32)
    mask = np.zeros((len(sequences), t), dtype=bool)
    for k, s in enumerate(sequences):
        x[k, : len(s)] = s
        mask[k, : len(s)] = True
    return x, mask


def _words(r: random.Random, low: int, high: int) -> str:
    syllables = ["an", "er", "tion", "le", "de", "ver", "en", "ti", "re", "on", "st", "ou", "é", "ich", "mente", "os", "th", "in"]
    words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
    return " ".join(words).capitalize()


def _sentences(r: random.Random, low: int, high: int) -> str:
    return " ".join(_words(r, 3, 14) + r.choice([".", ".", ".", ",", "!", "?"]) for _ in range(r.randint(low, high)))


def training_pages(n: int, seed: int) -> list[list[tuple[str, bool]]]:
    """Generated pages as parts (html, is main text); layouts, markup and marks vary."""
    r = random.Random(seed)
    pick = r.choice

    def mark(*names: str) -> str:
        name = pick(names)
        return pick([f' class="{name}"', f' id="{name}"', f' class="{name} {pick(["box", "block", "wide", "c1"])}"', f" class={name}"])

    def listed(tag: str) -> str:
        items = "".join(f'<li><a href="/{i}">{_words(r, 1, 4)}</a></li>' for i in range(r.randint(2, 9)))
        return f"<{tag}>{items}</{tag}>"

    def other(kind: str) -> str:
        text = pick([_sentences(r, 1, 4), _sentences(r, 1, 4), _words(r, 1, 2) + ".", _words(r, 1, 6) + pick([".", "!", ""])])
        if kind == "nav":
            return pick([f"<nav{pick(['', mark('menu', 'nav', 'navbar')])}>{listed('ul')}</nav>", f"<div{mark('menu', 'nav', 'navigation', 'breadcrumb', 'topbar')}>{listed('ul')}</div>"])
        if kind == "header":
            return f"<{pick(['header', 'div' + mark('header', 'masthead', 'banner')])}><p>{_words(r, 1, 6)}</p></header>"
        if kind == "footer":
            line = pick([f"&copy; {_words(r, 1, 3)} &middot; {_sentences(r, 1, 2)}", f"Copyright {_words(r, 2, 6)}", text])
            return pick([f"<footer>{line}</footer>", f"<footer><p>{line}</p>{listed('ul')}</footer>", f"<div{mark('footer', 'bottom', 'copyright')}><p>{line}</p></div>"])
        if kind == "ad":
            name = mark("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "adbox")
            return pick([f"<div{name}>{text}</div>", f"<div{name}><p>{text}</p></div>", f"<aside{name}>{text}</aside>", f"<section{name}><a href=/x>{text}</a></section>"])
        if kind == "aside":
            name = pick(["", mark("sidebar", "related", "widget", "recommended", "share", "social", "tags")])
            return pick([f"<aside{name}><h3>{_words(r, 1, 3)}</h3>{listed('ul')}</aside>", f"<aside{name}><p>{text}</p></aside>", f"<div{mark('sidebar', 'related', 'widget', 'share', 'side', 'trending')}><h4>{_words(r, 1, 3)}</h4><p>{text}</p></div>"])
        if kind == "notice":
            return f"<div{mark('cookie', 'notice', 'consent', 'gdpr', 'alert', 'popup', 'modal', 'newsletter')}><p>{text}</p><button>{_words(r, 1, 2)}</button></div>"
        if kind == "form":
            return f"<form{pick(['', mark('subscribe', 'search', 'login', 'signup')])}><label>{_words(r, 1, 3)}</label><input name=q><p>{_words(r, 2, 8)}</p><button>{_words(r, 1, 2)}</button></form>"
        reply = "".join(f"<{pick(['li', 'div'])}{mark('comment', 'reply')}><p>{_words(r, 1, 2)}</p><p>{_sentences(r, 1, 4)}</p></div>" for _ in range(r.randint(1, 5)))
        return pick([f"<section{mark('comments', 'discussion', 'replies')}><h3>{_words(r, 1, 2)}</h3>{reply}</section>", f"<div{mark('comments', 'responses', 'disqus')}>{reply}</div>"])

    def paragraph() -> str:
        text = _sentences(r, 1, 9)
        return pick(
            [f"<p>{text}</p>"] * 6 + [f"<p><b>{text}<br>", f"<p><a href=/y>{_words(r, 1, 3)}</a> {text}</p>", f"<blockquote><p>{text}</p></blockquote>", f"<h2>{_words(r, 2, 7)}</h2>",
             f"<h2>{_words(r, 2, 7)}</h2><p>{text}</p>", f"<ul><li>{_sentences(r, 1, 2)}</li><li>{_words(r, 3, 9)}</li></ul>", f"<p>{_words(r, 1, 3)}.</p>", f"<p>{_words(r, 1, 5)}</p>", f"<p>{_words(r, 1, 5)}", f"<pre>{text}</pre>", f"<table><tr><td>{_words(r, 1, 4)}</td><td>{_words(r, 1, 4)}</td></tr></table>"]
        )

    pages = []
    for _ in range(n):
        kinds = ["nav", "header", "ad", "aside", "notice", "form"]
        before = [k for k in kinds if r.random() < (0.75 if k == "nav" else 0.3)]
        r.shuffle(before)
        after = [k for k in ("ad", "aside", "form", "comment", "nav", "notice") if r.random() < 0.3] + (["footer"] if r.random() < 0.85 else [])
        wrap = pick(["<article>"] * 4 + [f"<article{mark('post', 'entry')}>", "<main>", "<main><article>", f"<div{mark('content', 'post', 'article', 'entry', 'main', 'story', 'text')}>", f"<section{mark('content', 'article', 'body')}>"])
        parts: list[tuple[str, bool]] = [(other(k), False) for k in before]
        head = pick([f"<h1>{_words(r, 3, 12)}.</h1>"] * 4 + [""])
        parts.append((wrap + head, True))
        for _ in range(pick([1, 1, 2, 3, 5, 8, 14])):
            parts.append((paragraph(), True))
            if r.random() < 0.04:
                parts.append((other(pick(["ad", "aside", "form"])), False))
        cut = r.random() < 0.08
        parts.append(("" if cut else "".join(f"</{x}>" for x in reversed(re.findall(r"<([a-z]+)", wrap))), False))
        if not cut:
            parts += [(other(k), False) for k in after]
        pages.append(parts)
    return pages


def _labelled(parts: list[tuple[str, bool]]) -> tuple[list, np.ndarray]:
    """Blocks of a generated page with labels: each text carries a mark that tells its part."""
    marked = []
    for k, (part, _) in enumerate(parts):
        marked.append(re.sub(r">([^<>]+)", lambda m, k=k: f">\x01{k}\x02{m[1]}", part))
    blocks, labels = [], []
    for path, text, share in blocks_of("<html><body>" + "".join(marked) + "</body></html>"):
        ks = re.findall("\x01(\\d+)\x02", text)
        clean = _SPACES.sub(" ", re.sub("\x01\\d+\x02", "", text)).strip()
        if clean and ks:
            blocks.append((path, clean, share))
            labels.append(parts[int(ks[0])][1])
    return blocks, np.array(labels, dtype=bool)


@lru_cache(maxsize=2)
def trained(pages: int = 900, rounds: int = 10, seed: int = 11) -> Labeller:
    """The labeller, trained on generated pages (about ten seconds; once a process)."""
    made = [_labelled(p) for p in training_pages(pages, seed)]
    data = sorted(((_vectors(b), y) for b, y in made if b), key=lambda d: len(d[1]))
    model, r = Labeller.fresh(seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    batches = [data[a : a + 32] for a in range(0, len(data), 32)]
    step = 0
    for k in range(rounds):
        for at in r.permutation(len(batches)):
            step += 1
            x, mask = _padded([v for v, _ in batches[at]])
            y = np.zeros(mask.shape, dtype=bool)
            y[mask] = np.concatenate([t for _, t in batches[at]])
            _, grads = model.gradients(x, mask, y)
            rate = 0.012 * (1 - k / rounds) + 0.001
            for name, g in grads.items():
                g = np.clip(g, -1, 1)
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                move = rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)
                model.weights[name] = (model.weights[name] - move).astype(np.float32)
    return model


def main_texts(pages: list[str | None], model: Labeller) -> list[str]:
    found = [blocks_of(p) if p else [] for p in pages]
    order = sorted((k for k, b in enumerate(found) if b), key=lambda k: len(found[k]))
    out = [""] * len(pages)
    a = 0
    while a < len(order):
        # pages of like length together, as many as keep the padded array small
        b = a + max(1, min(len(order) - a, 20_000 // len(found[order[min(a + 200, len(order) - 1)]])))
        b = min(b, a + 200)
        x, mask = _padded([_vectors(found[k]) for k in order[a:b]])
        main = model.scores(x, mask) > 0
        for row, k in enumerate(order[a:b]):
            out[k] = "\n\n".join(t for (_, t, _), keep in zip(found[k], main[row].tolist(), strict=False) if keep)
        a = b
    return out


def extract(pages: DataFrame, *, text: str = "html", model: Labeller | None = None) -> DataFrame:
    """One row per page: page_id, url, text (main blocks, joined by an empty line), n_chars."""
    sent = pages.sparkSession.sparkContext.broadcast((model or trained()).weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(sent.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = main_texts(part.column(2).to_pylist(), labeller)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    id_type = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", text).mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")
