"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks. Each block is a vector: hashed names of
its tag path, hashed words, and a few figures (length, link share, punctuation,
place). A bidirectional LSTM in numpy reads the whole sequence in both
directions and gives every block the chance that it belongs to the article, so
a paragraph is judged by the blocks around it as well.

Training: no table says which blocks are main text, so the labeller learns from
pages whose labels are known by construction. Words come from the blocks of at
most ``sample_pages`` pages (hash order of page_id); layouts come from a generator
that nests article and other blocks in varied tags and class names. Sampled
pages that mark their article by <article> or <main> join the training set with
the labels that these elements give, as they are and with the marks taken away.

Cases: null or empty html has no blocks and the empty text; hidden elements,
comments and markup are no text; broken markup is read as far as it goes; equal
pages get equal texts; a null page_id is a page like others; other columns pass
unchanged; an empty table gives an empty one.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.html_blocks import Block, leaf_blocks

SAMPLE_PAGES, SAMPLE_CHARS = 150, 100_000
SYNTHETIC_PAGES = 500
PATH_SLOTS, WORD_SLOTS, FIGURES = 64, 32, 6
INPUTS = PATH_SLOTS + WORD_SLOTS + FIGURES
HIDDEN = 16
BATCH_PAGES = 64
SEED = 7


class Slots(dict):
    """name -> one of ``size`` slots by its CRC-32; remembers names up to a bound."""

    def __init__(self, size: int, limit: int = 200_000):
        super().__init__()
        self.size, self.limit = size, limit

    def __missing__(self, name: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[name] = at = zlib.crc32(name.encode("utf-8", "surrogatepass")) % self.size
        return at


PATH_SLOT, WORD_SLOT = Slots(PATH_SLOTS), Slots(WORD_SLOTS)


def vectors(blocks: list[Block]) -> np.ndarray:
    """One row per block."""
    x = np.zeros((len(blocks), INPUTS), np.float32)
    for i, b in enumerate(blocks):
        for element in b.path[-10:]:
            for name in element:
                x[i, PATH_SLOT[name]] = 1.0
        words = b.text.lower().split()
        at = np.fromiter(map(WORD_SLOT.__getitem__, words), np.int64, len(words))
        counts = np.bincount(at, minlength=WORD_SLOTS)
        x[i, PATH_SLOTS:PATH_SLOTS + WORD_SLOTS] = counts / (1.0 + len(words))
        size = len(b.text)
        marks = sum(map(b.text.count, ".,;:!?"))
        x[i, -FIGURES:] = (np.log1p(size) / 6.0, min(1.0, b.link_chars / size), np.log1p(len(words)) / 4.0,
                           min(1.0, 10.0 * marks / size), (i + 0.5) / len(blocks), 1.0)
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Weights of both directions and the output; plain numpy."""

    def __init__(self, rng: np.random.Generator):
        def weights(rows: int, columns: int) -> np.ndarray:
            return (rng.standard_normal((rows, columns)) / np.sqrt(rows)).astype(np.float32)

        self.p = {}
        for d in "fb":
            self.p[d + "x"], self.p[d + "h"] = weights(INPUTS, 4 * HIDDEN), weights(HIDDEN, 4 * HIDDEN)
            self.p[d + "c"] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)  # the forget gates start open
        self.p["o"] = weights(2 * HIDDEN + INPUTS, 1)

    def direction(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x: pages, steps, inputs. Padded steps leave the state as it is."""
        pages, steps, _ = x.shape
        pre = x @ self.p[d + "x"] + self.p[d + "c"]
        h = np.zeros((pages, HIDDEN), np.float32)
        c = np.zeros_like(h)
        out = np.zeros((pages, steps, HIDDEN), np.float32)
        for t in (range(steps) if d == "f" else range(steps - 1, -1, -1)):
            z = pre[:, t] + h @ self.p[d + "h"]
            i, f, o = sigmoid(z[:, :HIDDEN]), sigmoid(z[:, HIDDEN:2 * HIDDEN]), sigmoid(z[:, 2 * HIDDEN:3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN:])
            new = f * c + i * g
            m = mask[:, t:t + 1]
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, new))
            c = m * new + (1 - m) * c
            h = m * (o * np.tanh(new)) + (1 - m) * h
            out[:, t] = h
        return out

    def chances(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.direction("f", x, mask), self.direction("b", x, mask), x], 2)
        return sigmoid(both @ self.p["o"])[:, :, 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept = {"f": [], "b": []}
        outs = {d: self.direction(d, x, mask, kept[d]) for d in "fb"}
        both = np.concatenate([outs["f"], outs["b"], x], 2)
        delta = ((sigmoid(both @ self.p["o"])[:, :, 0] - y) * mask / max(mask.sum(), 1.0))[:, :, None]
        grads = {"o": (both * delta).sum((0, 1))[:, None]}
        for k, d in enumerate("fb"):
            into = delta @ self.p["o"][k * HIDDEN:(k + 1) * HIDDEN].T
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            gh = np.zeros_like(self.p[d + "h"])
            dh = np.zeros((len(x), HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            for t, h, c, i, f, o, g, new in reversed(kept[d]):
                m = mask[:, t:t + 1]
                dh = dh + into[:, t]
                squashed = np.tanh(new)
                dnew = m * (dh * o * (1 - squashed ** 2) + dc)
                dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), m * dh * squashed * o * (1 - o), dnew * i * (1 - g ** 2)], 1)
                dz_all[:, t] = dz
                gh += h.T @ dz
                dh = dz @ self.p[d + "h"].T + (1 - m) * dh
                dc = dnew * f + (1 - m) * dc
            grads[d + "x"] = np.einsum("bti,btj->ij", x, dz_all, optimize=True)
            grads[d + "h"], grads[d + "c"] = gh, dz_all.sum((0, 1))
        return grads


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((len(pages), steps, INPUTS), np.float32), np.zeros((len(pages), steps), np.float32)
    for i, v in enumerate(pages):
        x[i, :len(v)], mask[i, :len(v)] = v, 1.0
    return x, mask


def fit(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 14, rate: float = 0.01) -> Labeller:
    """Adam over batches of pages of like length."""
    rng = np.random.default_rng(SEED)
    model = Labeller(rng)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    pages = sorted(pages, key=lambda p: len(p[1]))
    batches = [pages[i:i + 32] for i in range(0, len(pages), 32)]
    step = 0
    for epoch in range(epochs):
        for at in rng.permutation(len(batches)):
            x, mask = padded([v for v, _ in batches[at]])
            y = np.zeros_like(mask)
            for i, (_, labels) in enumerate(batches[at]):
                y[i, :len(labels)] = labels
            step += 1
            for k, g in model.gradients(x, mask, y).items():
                a, b = moments[k]
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                model.p[k] -= rate * (1 - epoch / epochs) * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
    return model


# layouts for training: names are ordinary English mark-up vocabulary
MAIN_NAMES = ("content main article post entry story body text page single primary article-body post-content entry-content main-content story-text").split()
SIDE_NAMES = {
    "nav": "nav navbar menu navigation topnav breadcrumb main-menu site-nav links".split(),
    "header": "header masthead site-header banner top branding logo".split(),
    "ad": "ad ads advert advertisement sponsored promo banner-ad ad-slot".split(),
    "aside": "sidebar aside related widget recommended popular side more-links".split(),
    "notice": "cookie notice consent gdpr alert popup newsletter subscribe overlay".split(),
    "form": "form search login signup contact newsletter-form".split(),
    "comments": "comments comment discussion replies reader-comments respond thread".split(),
    "footer": "footer site-footer bottom copyright colophon legal".split(),
}
SIDE_TAGS = {"nav": "nav", "header": "header", "ad": "div", "aside": "aside", "notice": "div", "form": "form", "comments": "section", "footer": "footer"}


def synthetic_page(rng: random.Random, words: list[str]) -> tuple[str, list[int]]:
    """Markup and the label of each of its leaf blocks, in order."""
    labels: list[int] = []

    def prose(low: int, high: int) -> str:
        n = rng.randint(low, high)
        return " ".join(rng.choice(words) for _ in range(n)).capitalize() + rng.choice([".", ".", "", "!"])

    def block(markup: str, label: int) -> str:
        labels.append(label)
        return markup

    def side(kind: str) -> str:
        tag = SIDE_TAGS[kind] if rng.random() < 0.6 else rng.choice(["div", "section"])
        name = f' {rng.choice(["class", "id"])}="{rng.choice(SIDE_NAMES[kind])}"' if tag in ("div", "section") or rng.random() < 0.5 else ""
        if kind in ("nav", "aside", "header") and rng.random() < 0.8:
            items = "".join(block(f"<li><a href='/x'>{prose(1, 5)}</a></li>", 0) for _ in range(rng.randint(2, 8)))
            inner = f"<ul>{items}</ul>"
        elif kind == "form":
            inner = "".join(block(f"<{t}>{prose(1, 4)}</{t}>", 0) for t in rng.sample(["p", "legend", "button", "div"], 2))
        elif kind == "comments":
            inner = "".join(block(f"<div class='{rng.choice(['comment', 'reply', 'item'])}'><p>{prose(4, 40)}</p></div>", 0) for _ in range(rng.randint(1, 6)))
        elif kind == "footer" and rng.random() < 0.5:
            inner = block(f"&copy; {prose(2, 14)}", 0)
        else:
            inner = block(f"<p>{prose(2, 25)}</p>", 0) if rng.random() < 0.5 else block(prose(2, 25), 0)
        return f"<{tag}{name}>{inner}</{tag}>"

    def article() -> str:
        parts = [block(f"<h1>{prose(3, 12)}</h1>", 1)] if rng.random() < 0.9 else []
        for _ in range(rng.randint(1, 14)):
            tag = rng.choices(["p", "h2", "li", "blockquote", "pre", "td"], [20, 2, 2, 1, 1, 1])[0]
            if tag == "li":
                parts.append("<ul>" + "".join(block(f"<li>{prose(2, 20)}</li>", 1) for _ in range(rng.randint(1, 4))) + "</ul>")
            elif tag == "td":
                parts.append("<table><tr>" + "".join(block(f"<td>{prose(1, 6)}</td>", 1) for _ in range(rng.randint(1, 4))) + "</tr></table>")
            elif tag == "p" and rng.random() < 0.15:
                parts.append(block(f"<p><b>{prose(1, 30)}<br>", 1))
            else:
                parts.append(block(f"<{tag}>{prose(1, 90)}</{tag}>", 1))
            if rng.random() < 0.06:
                parts.append(side(rng.choice(["ad", "aside", "notice"])))
        body = "".join(parts)
        way = rng.random()
        if way < 0.35:
            return f"<article>{body}</article>"
        if way < 0.5:
            return f"<main>{body}</main>"
        if way < 0.85:
            return f"<div {rng.choice(['class', 'id'])}='{rng.choice(MAIN_NAMES)}'>{body}</div>"
        return f"<div>{body}</div>"

    before = [k for k in ("notice", "header", "nav", "ad", "aside", "form") if rng.random() < 0.4]
    rng.shuffle(before)
    after = [k for k in ("comments", "aside", "ad", "form", "nav", "notice") if rng.random() < 0.3]
    rng.shuffle(after)
    if rng.random() < 0.85:
        after.append("footer")
    page = "".join(side(k) for k in before) + article() + "".join(side(k) for k in after)
    return f"<html><head><title>{prose(2, 8)}</title></head><body>{page}</body></html>", labels


MARKS = {"article", "main"}
SIDE_MARKS = {"nav", "header", "footer", "aside", "form", "script", "style"} | {n for names in SIDE_NAMES.values() for n in names}


def marked_labels(blocks: list[Block]) -> list[int] | None:
    """Labels by the innermost telling element of each path; None for a page that marks no article."""
    labels = []
    for b in blocks:
        label = 0
        for element in b.path:
            if element[0] in MARKS:
                label = 1
            elif SIDE_MARKS.intersection(element):
                label = 0
        labels.append(label)
    return labels if any(labels) else None


def unmarked(blocks: list[Block]) -> list[Block]:
    """The blocks as if the article stood in a plain element."""
    return [Block(b.text, tuple(("div", *e[1:]) if e[0] in MARKS else e for e in b.path), b.link_chars) for b in blocks]


def train(pages: list[str]) -> Labeller:
    rng = random.Random(SEED)
    read = [leaf_blocks(p) for p in pages]
    words = [w for blocks in read for b in blocks for w in b.text.lower().split()][:200_000] or "the of and to in is that for with was on as by are from this".split()
    examples: list[tuple[np.ndarray, np.ndarray]] = []
    for blocks in read:
        labels = marked_labels(blocks) if blocks else None
        if labels:
            for version in (blocks, blocks, unmarked(blocks)):
                examples.append((vectors(version), np.array(labels, np.float32)))
    for _ in range(SYNTHETIC_PAGES):
        page, labels = synthetic_page(rng, words)
        blocks = leaf_blocks(page)
        if len(blocks) == len(labels):
            examples.append((vectors(blocks), np.array(labels, np.float32)))
    return fit(examples)


def sample_pages(pages: DataFrame, limit: int = SAMPLE_PAGES, max_chars: int = SAMPLE_CHARS) -> list[str]:
    """The html of at most ``limit`` pages of at most ``max_chars`` code points, in hash order of their ids. Ids are chosen first, so only these pages travel."""
    usable = pages.where(F.char_length("html") <= max_chars).where(F.col("page_id").isNotNull())
    ids = [r["page_id"] for r in usable.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(limit).collect()]
    rows = usable.where(F.col("page_id").isin(ids)).select("html").collect() if ids else []
    return sorted({r["html"] for r in rows})[:limit]


def main_texts(model: Labeller, pages: list[str]) -> list[str]:
    """Pages of like length are read together."""
    read = [leaf_blocks(p) for p in pages]
    order = sorted((i for i in range(len(read)) if read[i]), key=lambda i: len(read[i]))
    out = [""] * len(read)
    begin = 0
    while begin < len(order):
        end = begin + 1
        while end < len(order) and end - begin < BATCH_PAGES and (end + 1 - begin) * len(read[order[end]]) <= 20_000:
            end += 1
        batch = order[begin:end]
        x, mask = padded([vectors(read[i]) for i in batch])
        for i, chance in zip(batch, model.chances(x, mask)):
            out[i] = "\n\n".join(b.text for b, p in zip(read[i], chance) if p >= 0.5)
        begin = end
    return out


def extract_column(page: Column, model: Labeller) -> Column:
    """The main text of a column of html."""

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts: list[str] = []
            for i in range(0, len(batch), 256):
                texts += main_texts(model, list(batch[i:i + 256]))
            yield pd.Series(texts, dtype=object)

    return extract(F.coalesce(page, F.lit("")))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""
    model = train(sample_pages(pages.select("page_id", "html")))
    return pages.select("page_id", "url", extract_column(F.col("html"), model).alias("text"))
