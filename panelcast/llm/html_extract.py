"""HTML extraction by a recurrent block labeller.

A page is read into its sequence of leaf blocks: runs of text between block-level tags, each with the path
of tags (and of the words in their class, id and role attributes) above it. A bidirectional LSTM in numpy
reads for every block the hashed path, hashed words and a few numbers, and labels the block as main text or not
with the whole page as context. The blocks labelled as main text, in page order, are the extraction.

The labeller is trained here, on layouts built from at most `MAX_PAGES` pages of up to MAX_CHARS characters (those with the
smallest hashes of id and html): the pages as they are, where text within <article> or <main> is main text unless a nested
sidebar, menu, form, footer, advert or comment holds it, and the same texts set anew in layouts with menus, banners, notices, adverts, forms, comments, sidebars and footers under many
names, whose labels are known by construction. Everything is extracted by the one model that this gives.

Defined results: null and empty html gives an empty text; scripts, styles, templates, comments and the head
give no blocks, all other text does (formulas and pictures' text in line, fallback text of embedded objects as blocks of its
own); character references are decoded and white space within a block (line breaks too) is one space;
broken markup is read as browsers do as far as the standard parser goes; nothing is cut, whatever its length;
null ids and repeated pages pass through; other columns are ignored unless named in `keep`; with no pages to learn from, the
layouts alone are learnt from fixed words.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, functions as F

from panelcast.llm.common import map_texts, smallest_hashes

MAX_PAGES, MAX_CHARS = 300, 200_000
PATH_SLOTS, WORD_SLOTS, NUMBERS = 512, 64, 5
INPUTS = PATH_SLOTS + WORD_SLOTS + NUMBERS
HIDDEN, EPOCHS, BATCH, RATE, SEED = 16, 12, 32, 0.01, 7
CELLS, STRIDE = 20_000, 1024  # blocks, with padding, that are labelled at a time; blocks whose inputs exist at a time

# Fixed by the HTML standard.
BLOCK_TAGS = set("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select
summary table tbody td textarea tfoot th thead tr ul""".split())
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = set("script style template head title".split())
FALLBACK_TAGS = set("noscript iframe object canvas audio video".split())  # their text is a block of its own, to be labelled like any other
BLOCK_TAGS |= FALLBACK_TAGS
CLOSES_P = BLOCK_TAGS - FALLBACK_TAGS - set("body html li dd dt td th tr tbody thead tfoot option optgroup button legend caption summary".split())
# Within <article> or <main>, what these hold is not main text.
NESTED = set("<aside <form <nav <footer <menu <noscript .ad .ads .advert .advertisement .sponsored .comment .comments .cookie .newsletter .related".split())
NAME = re.compile(r"[A-Za-z][a-z]*|\d+")


class Block(NamedTuple):
    text: str
    path: tuple[str, ...]
    linked: int  # characters within links


class PageReader(HTMLParser):
    """Collects leaf blocks with their paths."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.parts: list[str] = []
        self.silent = self.links = self.linked = 0

    def end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(text, tuple(w for _, words in self.open for w in words), self.linked))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append("\n")
            return
        if tag in VOID_TAGS:
            if tag == "hr":
                self.end_block()
            return
        if tag == "body":  # ends a head that was left open
            while self.open and self.open[-1][0] in SILENT_TAGS:
                self.close_last()
        if tag in BLOCK_TAGS:
            self.end_block()
            if tag in CLOSES_P:
                self.close("p", BLOCK_TAGS - {"p"})
            if tag in ("li", "option", "tr"):
                self.close(tag, BLOCK_TAGS - {tag, "p"} - ({"td", "th"} if tag == "tr" else set()))
            elif tag in ("td", "th", "dt", "dd"):
                for t in ("td", "th") if tag[0] == "t" else ("dt", "dd"):
                    self.close(t, BLOCK_TAGS - {t, "p"})
        named = [w.lower() for key, value in attrs if key in ("class", "id", "role") and value for w in NAME.findall(value)]
        words = tuple(f".{w}" for w in named)
        self.open.append((tag, (f"<{tag}", *words) if tag in BLOCK_TAGS or words else ()))
        self.silent += tag in SILENT_TAGS
        self.links += tag == "a"

    def close_last(self) -> None:
        tag = self.open.pop()[0]
        self.silent -= tag in SILENT_TAGS
        self.links -= tag == "a"

    def close(self, tag: str, fence: set[str]) -> bool:
        """Close the innermost open tag of this name, unless one of the fence is open within."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                while len(self.open) > i:
                    self.close_last()
                return True
            if self.open[i][0] in fence:
                return False
        return False

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self.end_block()
        self.close(tag, set() if tag in BLOCK_TAGS | SILENT_TAGS else BLOCK_TAGS)

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())

    def close_page(self) -> list[Block]:
        super().close()
        self.end_block()
        return self.blocks


def read_blocks(html: str) -> list[Block]:
    reader = PageReader()
    reader.feed(html)
    return reader.close_page()


@lru_cache(maxsize=200_000)
def slot(word: str, slots: int) -> int:
    return zlib.crc32(word.encode()) % slots


def inputs(blocks: list[Block], start: int = 0, end: int | None = None) -> np.ndarray:
    """One row per block from start to end: hashed path, share of hashed words, and numbers."""
    n, end = len(blocks), len(blocks) if end is None else min(end, len(blocks))
    x = np.zeros((end - start, INPUTS), np.float32)
    for i in range(start, end):
        b, row = blocks[i], x[i - start]
        for p in b.path:
            row[slot(p, PATH_SLOTS)] = 1
        words = b.text.lower().split()
        for w in words:
            row[PATH_SLOTS + zlib.crc32(w.encode()) % WORD_SLOTS] += 1
        row[PATH_SLOTS : PATH_SLOTS + WORD_SLOTS] /= len(words)
        row[-NUMBERS:] = (np.log1p(len(words)) / 5, min(1.0, b.linked / len(b.text)), 1 / (1 + i), 1 / (n - i), b.text[-1] in ".!?")
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """Two LSTMs, one in each direction, and a linear read-out of both. Time comes first in all arrays."""

    def __init__(self, rng: np.random.Generator):
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"w{d}"] = rng.normal(0, 0.1, (INPUTS, 4 * HIDDEN)).astype(np.float32)
            self.p[f"u{d}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.p[f"b{d}"] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)].astype(np.float32)
        self.p["v"] = rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32)
        self.p["c"] = np.zeros(1, np.float32)

    def direction(self, driven, mask, d, trace=None):
        """driven: what the inputs contribute to the gates."""
        steps, size, _ = driven.shape
        h = np.zeros((size, HIDDEN), np.float32)
        c, out = h, np.empty((steps, size, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = driven[t] + h @ self.p[f"u{d}"]
            gates, g = sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            m = mask[t][:, None]
            new = (f * c + i * g) * m
            if trace is not None:
                trace.append((t, i, f, o, g, c, new, h))
            c, h = new, o * np.tanh(new) * m
            out[t] = h
        return out

    def driven(self, x, d):
        return x @ self.p[f"w{d}"] + self.p[f"b{d}"]

    def logits(self, x, mask, traces=None):
        return self.read_out({d: self.driven(x, d) for d in "fb"}, mask, traces)

    def read_out(self, driven, mask, traces=None):
        states = [self.direction(driven[d], mask, d, None if traces is None else traces.setdefault(d, [])) for d in "fb"]
        both = np.concatenate(states, axis=2)
        return both @ self.p["v"] + self.p["c"], both

    def gradients(self, x, mask, y):
        """Of the mean logistic loss over the blocks of a batch."""
        traces: dict[str, list] = {}
        logits, both = self.logits(x, mask, traces)
        wrong = (sigmoid(logits) - y) * mask / mask.sum()
        grad = {"v": np.einsum("tb,tbh->h", wrong, both), "c": np.array([wrong.sum()], np.float32)}
        for k, d in enumerate("fb"):
            outer = wrong[:, :, None] * self.p["v"][k * HIDDEN : (k + 1) * HIDDEN]
            dz_all = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            dh, dc = (np.zeros((mask.shape[1], HIDDEN), np.float32) for _ in range(2))
            grad[f"u{d}"] = np.zeros_like(self.p[f"u{d}"])
            for t, i, f, o, g, c_old, c, h_old in reversed(traces[d]):
                m = mask[t][:, None]
                dh = (dh + outer[t]) * m
                squashed = np.tanh(c)
                dc = (dc + dh * o * (1 - squashed**2)) * m
                dz = np.concatenate([dc * g * i * (1 - i), dc * c_old * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)], axis=1)
                dz_all[t] = dz
                grad[f"u{d}"] += h_old.T @ dz
                dh, dc = dz @ self.p[f"u{d}"].T, dc * f
            grad[f"w{d}"] = np.einsum("tbi,tbz->iz", x, dz_all, optimize=True)
            grad[f"b{d}"] = dz_all.sum((0, 1))
        return grad

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], rng: np.random.Generator) -> None:
        """Adam over batches of pages of like length."""
        first, second, step = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2)), None, 0
        first, second = first
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][1]))
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        for epoch in range(EPOCHS):
            for at in rng.permutation(len(batches)):
                x, mask, y = padded([pages[i] for i in batches[at]])
                step += 1
                for k, g in self.gradients(x, mask, y).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    scale = RATE * (0.8**epoch)
                    self.p[k] = (self.p[k] - scale * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Whether each block is main text; pages are labelled in groups of like length.

        Inputs are wide, so they are made a slice of STRIDE blocks at a time and only their gates are kept.
        """
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order, start = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if len(pages[i])], 0
        while start < len(order):
            end = start + 1
            while end < len(order) and (end + 1 - start) * len(pages[order[end]]) <= CELLS:
                end += 1
            steps = len(pages[order[end - 1]])
            driven = {d: np.zeros((steps, end - start, 4 * HIDDEN), np.float32) for d in "fb"}
            mask = np.zeros((steps, end - start), np.float32)
            for column, i in enumerate(order[start:end]):
                mask[: len(pages[i]), column] = 1
                for low in range(0, len(pages[i]), STRIDE):
                    x = inputs(pages[i], low, low + STRIDE)
                    for d in "fb":
                        driven[d][low : low + len(x), column] = self.driven(x, d)
            logits, _ = self.read_out(driven, mask)
            for column, i in enumerate(order[start:end]):
                out[i] = logits[: len(pages[i]), column] > 0
            start = end
        return out


def padded(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(len(y) for _, y in pages)
    x, mask, y = np.zeros((steps, len(pages), INPUTS), np.float32), np.zeros((steps, len(pages)), np.float32), np.zeros((steps, len(pages)), np.float32)
    for b, (rows, labels) in enumerate(pages):
        x[: len(labels), b], mask[: len(labels), b], y[: len(labels), b] = rows, 1, labels
    return x, mask, y


# Names under which layouts are written; each is cut into words, of which a path keeps every one.
MAIN_WRAPS = """<article>|<main>|<article class=post>|<main id=content>|<div class=article-body>|<div class=entry-content>|<div id=main-content>|
<section class=story>|<div class=post-content>|<div role=main>|<article itemprop=articleBody>|<main><article>|<div class=page><article>|<body>|
<div class=wrapper><div class=content>|<div class=container><main>|<section><article>|<div class=text>""".replace("\n", "").split("|")
SIDE_WRAPS = {
    "menu": "<nav>|<nav class=menu>|<div class=nav>|<ul class=menu>|<div id=navigation>|<div class=breadcrumbs>|<ul class=nav-links>|<div role=navigation>|<menu>|<div class=toc>|<div class=pagination>",
    "head": "<header>|<header class=site-header>|<div id=header>|<div class=masthead>|<div class=top-bar>|<div class=logo>|<div role=banner>|<header class=page-header>|<div class=branding>",
    "foot": "<footer>|<footer class=site-footer>|<div id=footer>|<div class=copyright>|<div role=contentinfo>|<div class=legal>|<footer class=page-footer>|<div class=bottom>",
    "side": "<aside>|<aside class=sidebar>|<div class=sidebar>|<div id=sidebar>|<div class=widget>|<div class=related>|<section class=related-posts>|<div role=complementary>|<div class=recommended>|<div class=share>|<div class=social>|<div class=tags>|<div class=author-box>|<div class=popular>",
    "note": "<div class=cookie-notice>|<div class=notice>|<div id=cookie-banner>|<div class=banner>|<div class=popup>|<div class=modal>|<div class=alert>|<dialog>|<div role=alert>|<div class=consent>|<div class=paywall>|<div class=newsletter>|<div class=subscribe>|<div role=dialog>",
    "ad": "<div class=ad>|<div class=ads>|<div class=advert>|<div class=advertisement>|<div class=sponsored>|<aside class=promo>|<div id=ad-top>|<section class=sponsor>|<div class=ad-slot>|<ins class=adsbygoogle>|<div class=promotion>",
    "form": "<form>|<form class=search>|<form id=login>|<div class=search-form>|<form class=contact>|<form class=comment-form>|<fieldset>",
    "talk": "<section class=comments>|<div id=comments>|<div class=comment-list>|<ol class=comments>|<section id=discussion>|<div class=reader-comments>|<div class=replies>|<div class=responses>|<section class=reviews>|<div id=disqus>",
}
LEAVES_OF = {"menu": "<li><a>|<a>|<li>", "head": "<p>|<h1>|<div>|<a>", "foot": "<p>|<div>|<small>||<a>", "side": "<p>|<h3>|<li><a>|<div>|<li>", "note": "<p>|<button>|<div>|",
             "ad": "<p>|<div>||<a>", "form": "<label>|<button>|<p>|<option>|<legend>", "talk": "<p>|<div class=comment><p>|<li><p>|<article class=comment><p>|<div class=comment-body>|<li class=comment>|<h3>"}
MAIN_LEAVES = "<p>|<p>|<p>|<p>|<div>|<li>|<blockquote>|<h2>|<h3>|<pre>|<td>|<figcaption>|<dd>|<p class=lead>|<section><p>".split("|")
FIXED_WORDS = "home about contact search login subscribe share reply comments privacy terms cookies accept advertisement more next".split()


def wrapped(inner: str, tags: str) -> str:
    names = re.findall(r"<(\w+)", tags)
    return tags + inner + "".join(f"</{n}>" for n in reversed(names))


def layouts(texts: list[list[str]], rng: np.random.Generator, count: int) -> list[tuple[list[Block], np.ndarray]]:
    """Pages built from main texts of real ones. Texts in side blocks are of other pages, so main text is known by its words."""
    made = []
    pick = lambda options: options[int(rng.integers(len(options)))]
    pool = [t for page in texts for t in page] or [" ".join(FIXED_WORDS)]
    for n in range(count):
        page = texts[n % len(texts)] if texts else [" ".join(rng.permutation(FIXED_WORDS)) for _ in range(3)]
        page = [pick(page) for _ in page] if rng.random() < 0.3 else page
        if n % 25 == 0:  # some pages are long: what is learnt must hold however far the ends of the page are
            page = [" ".join(pick(page).split()[: int(rng.integers(2, 30))]) for _ in range(int(rng.integers(60, 400)))]
        marked = lambda t: f"{t}\u0001"  # noqa: E731  a mark that the labels are read from and that is taken off again

        def side(kind: str) -> str:
            def words() -> str:
                if kind in ("menu", "form") or rng.random() < 0.3:
                    return " ".join(pick(pick(pool).split() or FIXED_WORDS) for _ in range(int(rng.integers(1, 5))))
                t = pick(pool).split()
                return " ".join(t[: int(rng.integers(3, 60))])

            leaves = "".join(wrapped(words(), pick(LEAVES_OF[kind].split("|"))) for _ in range(int(rng.integers(1, 6))))
            return wrapped(leaves, pick(SIDE_WRAPS[kind].split("|")))

        body = [wrapped(marked(page[0]), pick(["<h1>", "<h1>", "<h1 class=title>", "<p>", "<header><h1>"]))] + [wrapped(marked(t), pick(MAIN_LEAVES)) for t in page[1:]]
        for kind in ("ad", "side", "note", "form"):  # inside the main text too
            if rng.random() < 0.25:
                body.insert(int(rng.integers(1, len(body) + 1)), side(kind))
        if rng.random() < 0.3:
            body.append(side("talk"))
        before = [side(k) for k in ("note", "head", "menu", "ad", "form") if rng.random() < 0.5]
        after = [side(k) for k in ("talk", "side", "ad", "menu", "note", "form", "foot") if rng.random() < 0.45]
        html = "<html><body>" + "".join(before) + wrapped("".join(body), pick(MAIN_WRAPS)) + "".join(after)
        blocks = read_blocks(html)
        labels = np.array(["\u0001" in b.text for b in blocks], np.float32)
        made.append(([b._replace(text=b.text.replace("\u0001", "").strip() or ".") for b in blocks], labels))
    return made


def train_labeller(pages: DataFrame, html: str = "html", id: str = "page_id", max_pages: int = MAX_PAGES) -> Labeller:
    filled = pages.select(F.col(f"`{html}`").alias("h"), F.col(f"`{id}`").alias("k")).filter(f"length(h) BETWEEN 1 AND {MAX_CHARS}")
    sample = sorted(smallest_hashes(filled, ["k", "h"], max_pages).collect(), key=lambda r: (r["__hash"], r.h))
    read = [read_blocks(r.h) for r in sample]

    def main(b: Block) -> bool:
        inside = next((i for i, p in enumerate(b.path) if p in ("<article", "<main")), None)
        return inside is not None and not NESTED & set(b.path[inside:])

    real = [(blocks, np.array([main(b) for b in blocks], np.float32)) for blocks in read if any(map(main, blocks))]
    texts = [[b.text for b in blocks if main(b)] for blocks, _ in real]
    rng = np.random.default_rng(SEED)
    lessons = real + layouts(texts, rng, 1500)
    model = Labeller(rng)
    model.train([(inputs(blocks), labels) for blocks, labels in lessons if len(labels)], rng)
    return model


def extract(pages: DataFrame, model: Labeller, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """`keep` (default page_id, url), text and n_blocks, n_main (all blocks, blocks of main text)."""

    def work(texts: list[bytes]) -> list[list]:
        read = [read_blocks(t.decode()) for t in texts]
        labels = model.label(read)
        chosen = [[b.text for b, y in zip(blocks, ys) if y] for blocks, ys in zip(read, labels)]
        return [["\n\n".join(c) for c in chosen], [len(b) for b in read], [len(c) for c in chosen]]

    return map_texts(pages, html, keep or ["page_id", "url"], "text string, n_blocks bigint, n_main bigint", work, chunk_bytes=1_000_000)
