"""Main text of web pages by a linear-chain conditional random field over their leaf blocks.

Each leaf block of a page is an item of a chain, labelled as main text or not. Features are the
tags and names (class, id, role) of its ancestors and the look of its text; neighbouring labels
depend on each other. Weights are learned on labelled pages by gradient ascent on the
conditional likelihood (forward and backward sums); a page is labelled by Viterbi.

The labelled pages are built here: layouts that differ in their elements, names and order, with
words from a bounded sample of the given pages. Which block is main text is known as each page
is put together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm.catalog import query, table
from rowtide.llm.html_blocks import Block, Names, leaf_blocks
from rowtide.llm.words import WORD, slices, wider, with_columns, without


@dataclass(frozen=True)
class Training:
    """``sample``: pages, those with the lowest hash, whose words the labelled pages use, up to
    ``characters`` of each; ``pages``: labelled pages; then the settings of the ascent."""

    sample: int = 40
    characters: int = 20_000
    pages: int = 500
    epochs: int = 6
    rate: float = 0.3
    decay: float = 1e-4
    seed: int = 5


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of what holds for each block of a page, those of its ancestors included."""
    return [own + [f"in {n}" for n in b.names] for own, b in zip(own_features(blocks), blocks)]


def own_features(blocks: list[Block]) -> list[list[str]]:
    """Names of what holds for each block of a page by itself."""
    out = []
    for b in blocks:
        words = b.text.count(" ") + 1
        linked = b.linked / max(len(b.text), 1)
        found = ["always", f"leaf {b.tag}", f"words {min(words.bit_length(), 8)}", f"links {int(4 * min(linked, 1))}"]
        found.append("ends a sentence" if b.text[-1] in ".!?:;…\"'”»" else "no end")
        found.append(f"commas {min(b.text.count(',').bit_length(), 3)}")
        if "©" in b.text or "(c)" in b.text.lower():
            found.append("copyright")
        out.append(found)
    return out


@dataclass
class Chain:
    """Weights: of each feature for main text, of label pairs, and of the first label."""

    index: dict[str, int]
    weights: np.ndarray
    pairs: np.ndarray
    first: np.ndarray

    def scores(self, found: list[list[str]]) -> list[float]:
        index, weights = self.index, self.weights
        return [sum(weights[index[f]] for f in names if f in index) for names in found]

    def around(self, names: Names) -> float:
        """The weight of the names around a block; kept with them, as neighbours share them."""
        chain = []
        while names is not None and names.weight is None:
            chain.append(names)
            names = names.above
        total = names.weight if names is not None else 0.0
        for link in reversed(chain):
            total += sum(self.weights[self.index[f"in {n}"]] for n in link.new if f"in {n}" in self.index)
            link.weight = total
        return total

    def page_scores(self, blocks: list[Block]) -> list[float]:
        return [s + self.around(b.names) for s, b in zip(self.scores(own_features(blocks)), blocks)]

    def viterbi(self, scores: list[float]) -> list[int]:
        (oo, om), (mo, mm) = self.pairs.tolist()
        other, main = self.first[0], self.first[1] + scores[0]
        back = []
        for s in scores[1:]:
            back.append((main + mo > other + oo, main + mm > other + om))
            other, main = max(main + mo, other + oo), s + max(main + mm, other + om)
        label = int(main > other)
        labels = [label]
        for choice in reversed(back):
            label = int(choice[label])
            labels.append(label)
        return labels[::-1]


def _log_add(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=0)
    return top + np.log(np.exp(a - top).sum(axis=0))


def gradient(found: list[list[int]], labels: np.ndarray, weights: np.ndarray, pairs: np.ndarray, first: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihood of a page's labels, and its slope by each kind of weight; ``found`` has the
    numbers of each block's features. Forward and backward sums run over the blocks."""
    n = len(found)
    unary = np.zeros((n, 2))
    unary[:, 1] = [weights[f].sum() for f in found]
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    forward[0] = first + unary[0]
    for i in range(1, n):
        forward[i] = unary[i] + _log_add(forward[i - 1][:, None] + pairs)
    for i in range(n - 2, -1, -1):
        backward[i] = _log_add((pairs + unary[i + 1] + backward[i + 1]).T)
    whole = _log_add(forward[-1])
    likely = np.exp(forward + backward - whole)
    slope = np.zeros(len(weights))
    np.add.at(slope, np.concatenate([np.array(f) for f in found]), np.repeat(labels - likely[:, 1], [len(f) for f in found]))
    joint = np.zeros((2, 2))
    if n > 1:
        np.add.at(joint, (labels[:-1], labels[1:]), 1)
        joint -= np.exp(forward[:-1, :, None] + pairs + (unary + backward)[1:, None, :] - whole).sum(axis=0)
    start = -likely[0]
    start[labels[0]] += 1
    likelihood = first[labels[0]] + unary[np.arange(n), labels].sum() + pairs[labels[:-1], labels[1:]].sum() - whole
    return float(likelihood), slope, joint, start


def fit(pages: list[tuple[list[list[str]], list[int]]], training: Training) -> Chain:
    """Weights that make the given labels likely, by scaled gradient steps page by page."""
    index: dict[str, int] = {}
    coded = [([[index.setdefault(f, len(index)) for f in names] for names in found], np.array(y)) for found, y in pages]
    weights, pairs, first = np.zeros(len(index)), np.zeros((2, 2)), np.zeros(2)
    seen, seen_pairs, seen_first = np.full(len(index), 1e-3), np.full((2, 2), 1e-3), np.full(2, 1e-3)
    random = np.random.default_rng(training.seed)
    for _ in range(training.epochs):
        for k in random.permutation(len(coded)):
            _, slope, joint, start = gradient(*coded[k], weights, pairs, first)
            slope -= training.decay * weights
            for values, change, total in ((weights, slope, seen), (pairs, joint, seen_pairs), (first, start, seen_first)):
                total += change**2
                values += training.rate * change / np.sqrt(total)
    return Chain(index, weights, pairs, first)


# Names that page authors give to the parts of a page.
MAIN_NAMES = ("content", "post", "entry", "story", "article body", "post content", "main", "text", "page body", "entry content")
HEAD_NAMES = ("entry header", "post header", "article header", "title", "headline")
BYLINES = ("byline", "author", "meta", "date", "published", "dateline")
OTHER_PARTS = {
    "nav": ("nav", "menu", "navbar", "main nav", "breadcrumb", "pagination", "toc"),
    "header": ("header", "site header", "masthead", "top bar", "branding", "page header"),
    "footer": ("footer", "site footer", "copyright", "legal", "bottom"),
    "aside": ("sidebar", "aside", "widget", "related", "recommended", "trending", "popular"),
    "notice": ("notice", "cookie", "cookie banner", "consent", "alert", "gdpr", "popup", "modal", "message"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner"),
    "form": ("form", "newsletter", "subscribe", "search", "login", "signup", "contact"),
    "comments": ("comments", "comment", "comment list", "replies", "discussion", "respond", "disqus"),
    "share": ("share", "social", "tags", "toolbar"),
}


# Families of layouts: what holds the main text, and what its beginning and end look like. "bare"
# pages have little or nothing else, and few or no names; fragments lack the page around it; a "headed" article has a header and a
# footer of its own.
LAYOUTS = ("article", "main", "main article", "div", "section", "div div", "headed article", "headed main", "headed div", "bare", "bare fragment")


def labelled_pages(words: list[str], training: Training, layouts: Sequence[str] = LAYOUTS) -> list[tuple[str, list[int]]]:
    """Pages and, for each of their blocks in order, whether it is main text.

    The header and byline of an article are part of it; its footer and what it shares are not.
    """
    random = np.random.default_rng(training.seed)
    words = words or ["word"]

    def some(low: int, high: int) -> str:
        return " ".join(words[i] for i in random.integers(0, len(words), random.integers(low, high + 1)))

    def one(options):
        return options[random.integers(len(options))]

    def chance(p: float) -> bool:
        return random.random() < p

    def sentence_like(low: int, high: int) -> str:
        text = some(low, high).rstrip(".,;:!?")
        return text + one((".", ".", ".", "!", "?")) if chance(0.8) else text

    def attributes(names: tuple, share: float = 0.9) -> str:
        return f' {one(("class", "class", "id"))}="{one(names).replace(" ", "-")}"' if chance(share) else ""

    def items(kind: str, low: int, high: int, link: float) -> tuple[str, int]:
        n = int(random.integers(low, high + 1))
        cells = [f'<a href="/x">{some(1, 4)}</a>' if chance(link) else some(1, 8) for _ in range(n)]
        return "".join(f"<{kind}>{c}</{kind}>" for c in cells), n

    def other(kind: str) -> tuple[str, int]:
        """A part that is no main text, and its number of blocks."""
        names = OTHER_PARTS[kind]
        semantic = kind in ("nav", "header", "footer", "aside", "form") and chance(0.7)
        tag = kind if semantic else one(("div", "div", "section", "ul" if kind in ("nav", "share") else "div"))
        own = attributes(names, 0.5 if semantic else 1.0)
        if kind in ("nav", "share") or kind == "aside" and chance(0.5):
            inside, n = items("li", 2, 8, 0.95)
            inside = inside if tag == "ul" else f"<ul>{inside}</ul>"
        elif kind == "comments":
            n = int(random.integers(1, 6))
            inside = "".join(f"<{t}>{sentence_like(3, 50)}</{t}>" for t in [one(("p", "p", "div", "li")) for _ in range(n)])
            if chance(0.5):
                inside, n = f"<h3>{some(1, 3)}</h3>{inside}", n + 1
        elif kind == "form":
            parts = [f"<label>{some(1, 3)}</label><input name=x>", f"<p>{sentence_like(4, 20)}</p>", f"<button>{some(1, 2)}</button>"]
            chosen = [p for p in parts if chance(0.7)] or parts[:1]
            inside, n = "".join(chosen), len(chosen)
        elif kind in ("header", "footer") and chance(0.6):
            inside, n = (f"<p>{'&copy; ' if kind == 'footer' and chance(0.6) else ''}{some(1, 14)}</p>", 1)
        else:
            n = int(random.integers(1, 4))
            texts = [sentence_like(2, 30) for _ in range(n)]
            inside = texts[0] if n == 1 and chance(0.6) else "".join(f"<p>{t}</p>" for t in texts)
        return f"<{tag}{own}>{inside}</{tag}>", n

    def main_part(headed: bool, bare: bool) -> tuple[str, list[int]]:
        html, labels = "", []
        if chance(0.4 if bare else 0.9):
            html += f"<h1>{some(2, 14)}</h1>"
            labels.append(1)
        if headed or chance(0.1):
            if chance(0.6):
                byline = one((f"<p>{some(1, 6)}</p>", f"<p{attributes(BYLINES)}>{some(1, 6)}</p>", f"<div{attributes(BYLINES)}>{some(1, 6)}</div>"))
                html, labels = html + byline, labels + [1]
            if html and chance(0.8):
                html = f"<header{attributes(HEAD_NAMES, 0.4)}>{html}</header>"
        parts = int(random.integers(1, 4)) if bare or chance(0.25) else int(random.integers(1, 16))
        for _ in range(parts):
            draw = random.random()
            if draw < 0.72:
                inner = sentence_like(3, 90)
                if chance(0.2):
                    inner = f"<b>{inner}" + ("</b>" if chance(0.5) else "<br>")
                if chance(0.15):
                    inner += f' <a href="/y">{some(1, 5)}</a> {some(1, 9)}.'
                html += f"<p>{inner}" + ("</p>" if chance(0.85) else "")
                labels.append(1)
            elif draw < 0.82:
                tag = one(("h2", "h3", "blockquote", "pre", "figcaption", "div"))
                html += f"<{tag}>{sentence_like(2, 30)}</{tag}>"
                labels.append(1)
            elif draw < 0.92:
                inside, n = items(one(("li", "li", "li", "td")), 2, 6, 0.1)
                html += f"<table><tr>{inside}</tr></table>" if "<td>" in inside else f"<ul>{inside}</ul>"
                labels += [1] * n
            else:
                part, n = other(one(("ad", "aside", "form", "share", "notice")))
                html += part
                labels += [0] * n
        if headed and chance(0.7):
            part, n = other("footer")
            html, labels = html + part, labels + [0] * n
        if not bare and chance(0.25):
            part, n = other("comments")
            html, labels = html + part, labels + [0] * n
        return html, labels

    pages = []
    for _ in range(training.pages):
        head = f"<head><title>{some(2, 9)}</title><style>p{{margin:0}}</style></head>" if chance(0.9) else ""
        html, labels = "", [0] if head else []
        layout = one(layouts)
        bare, headed, fragment = layout.startswith("bare"), layout.startswith("headed "), layout == "bare fragment"
        few = 0.0 if fragment else 0.15 if bare else 1.0
        if fragment:
            head, labels = "", []
        for kind in ("notice", "header", "nav", "ad", "aside"):
            if chance(0.5 * few):
                part, n = other(kind)
                html, labels = html + part, labels + [0] * n
        main, y = main_part(headed, bare)
        container = one(("div", "div", "main", "article", "section", "")) if bare else layout.removeprefix("headed ")
        for tag in reversed(container.split()):
            plain = (tag in ("article", "main") and chance(0.6)) or bare and chance(0.7)
            main = f"<{tag}{'' if plain else attributes(MAIN_NAMES, 0.85)}>{main}</{tag}>"
        html, labels = html + main, labels + y
        for kind in ("comments", "aside", "form", "ad", "share", "nav", "footer"):
            if chance(0.45 * few):
                part, n = other(kind)
                html, labels = html + part, labels + [0] * n
        if chance(0.3 * few):
            html = f'<div class="{one(("wrapper", "container", "page", "site", "layout"))}">{html}</div>'
        pages.append((html if fragment else f"<!DOCTYPE html><html>{head}<body>{html}</body></html>", labels))
    return pages


def learn(pages: DataFrame, training: Training = Training(), html: str = "html") -> Chain:
    """Fits the chain on labelled pages with words of a bounded sample of ``pages``."""
    usable = pages.filter(F.col(html).isNotNull()).select(F.substring(html, 1, training.characters).alias("h")).withColumn("x", F.xxhash64("h"))
    # Hashes alone are compared and brought together; then the pages that have the lowest.
    least = [r["x"] for r in usable.select("x").distinct().orderBy("x").limit(training.sample).collect()]
    rows = usable.filter(F.col("x").isin(least)).groupBy("x").agg(F.min("h").alias("h")).orderBy("x").collect() if least else []
    words = [w for r in rows for b in leaf_blocks(r["h"]) for w in WORD.findall(b.text) if "<" not in w and "&" not in w]
    made = []
    for page, labels in labelled_pages(words, training):
        blocks = leaf_blocks(page)
        if len(blocks) == len(labels):  # not so where a made-up text is blank
            made.append((features(blocks), labels))
    return fit(made, training)


def main_text(chain: Chain, html: str) -> str:
    blocks = leaf_blocks(html)
    if not blocks:
        return ""
    labels = chain.viterbi(chain.page_scores(blocks))
    return "\n\n".join(b.text for b, y in zip(blocks, labels) if y)


def extract_text(df: DataFrame, chain: Chain, html: str = "html", name: str = "text") -> DataFrame:
    """Adds the main text of each page: its main blocks in order, two line breaks between.

    No shuffle; one row in, one row out; pages are read whole. Null and empty pages have the
    empty text, as have pages without a main block. A column of the added name is replaced;
    repeated rows stay; an empty table gives no rows.
    """
    base = without(df, [name])
    held = df.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        for batch in (part for b in batches for part in slices(b, html)):
            texts = [main_text(held.value, h or "") for h in batch.column(html).to_pylist()]
            yield with_columns(batch, [name], [pa.array(texts, pa.string())])

    return base.mapInArrow(run, wider(base, f"`{name}` STRING"))


@query()
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    found = extract_text(pages, learn(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
