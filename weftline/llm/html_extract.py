"""Operator 9: main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page's blocks, in order, are labelled content or not. A block's features are the tags and the words of classes,
ids and roles of all its ancestors, its own element, and length, links, punctuation and place of its text;
transitions between labels have weights of their own. The field is trained by maximum likelihood (forward-
backward, AdaGrad) on labelled pages and decoded by Viterbi.

Labelled pages. The corpus has none, so they are written here: ``labelled_pages`` builds pages of many layouts
whose content blocks carry a mark that the features don't show. Their number is the bound of the fit.

Edge cases: a null or empty page, or one without text, has empty text; unclosed and stray tags are read as
browsers do, but a ``<`` that no tag follows is text; formulas and fallbacks are running text; a page is read once,
whatever its markup; rows of a repeated id are rows of their own; only the weights, some hundred numbers, are sent to the executors.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import freed, table
from .html_blocks import Block, block_features, leaf_blocks

PAGES = 500
_LETTERS = "eeeaaiioutnsrlhdcmpgbfvy"


def _words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(_LETTERS) for _ in range(rng.randint(2, 9))) for _ in range(n))


def _sentence(rng: random.Random, n: int) -> str:
    return ", ".join(_words(rng, max(1, n // 2)) for _ in range(rng.randint(1, 3))).capitalize() + "."


def _links(rng: random.Random, n: int) -> str:
    return "<ul>" + "".join(f'<li><a href="/x">{_words(rng, rng.randint(1, 3))}</a></li>' for _ in range(n)) + "</ul>"


#: Names of classes and ids that page authors use; fixed values.
_CONTENT = ["article", "article-body", "post-content", "entry-content", "content", "main-content", "story", "story-body", "text", "post", "body-copy", "page-content"]
_AROUND = {
    "nav": ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar", "toc", "pagination", "main-menu", "site-nav"],
    "header": ["header", "masthead", "site-header", "page-header", "top", "logo", "branding"],
    "footer": ["footer", "site-footer", "copyright", "legal", "bottom", "colophon"],
    "aside": ["sidebar", "aside", "widget", "related", "recommended", "popular", "trending", "more-stories", "right-rail", "tags", "share", "social"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "adsense", "sponsor", "outbrain", "commercial"],
    "notice": ["notice", "cookie", "cookie-notice", "cookies", "consent", "gdpr", "alert", "banner", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "paywall", "disclaimer"],
    "form": ["form", "search", "login", "contact-form", "search-box"],
    "comments": ["comments", "comment", "comment-list", "respond", "disqus", "replies", "reply", "discussion", "reviews"],
}


def _outside(rng: random.Random, kind: str) -> str:
    name = rng.choice(_AROUND[kind])
    at = f'{rng.choice(["class", "class", "id"])}="{name}"'
    say = lambda a, b: _sentence(rng, rng.randint(a, b))
    if kind == "nav":
        inner = _links(rng, rng.randint(2, 8)) if rng.random() < 0.8 else " | ".join(f"<a href=#>{_words(rng, 1)}</a>" for _ in range(5))
        return f"<nav>{inner}</nav>" if rng.random() < 0.5 else f"<div {at}>{inner}</div>"
    if kind in ("header", "footer"):
        inner = rng.choice(["", f"<p>{say(3, 25)}</p>", f"<h1>{_words(rng, 3)}</h1>" if kind == "header" else f"&copy; {_words(rng, 2)} &middot; {say(3, 30)}", _links(rng, 3), say(3, 30)]) + say(1, 8)
        return f"<{kind}>{inner}</{kind}>" if rng.random() < 0.6 else f"<div {at}>{inner}</div>"
    if kind == "aside":
        inner = f"<h3>{_words(rng, 2)}</h3>" + rng.choice([_links(rng, 4), f"<p>{say(5, 50)}</p><p>{say(5, 40)}</p>", say(5, 40)])
        return f"<aside>{inner}</aside>" if rng.random() < 0.5 else f"<div {at}>{inner}</div>"
    if kind == "form":
        inner = f"<label>{_words(rng, 2)}</label><input name=q><p>{say(2, 30)}</p><button>{_words(rng, 1)}</button>"
        return f"<form action=/s>{inner}</form>" if rng.random() < 0.8 else f"<div {at}>{inner}</div>"
    if kind == "comments":
        one = lambda: f'<{(t := rng.choice(["div", "li", "p", "article"]))} class="{rng.choice(["comment", "comment-body", "reply"])}">{rng.choice(["<b>" + _words(rng, 1) + "</b>", ""])}<p>{say(3, 60)}</p></{t}>'
        inner = f"<h2>{_words(rng, 1)}</h2>" + "".join(one() for _ in range(rng.randint(1, 5)))
        return f"<{(t := rng.choice(["section", "div", "ol"]))} {at}>{inner}</{t}>"
    inner = rng.choice([say(3, 60), f"<p>{say(3, 60)}</p>", f"<p>{say(3, 40)}</p><p>{say(3, 40)}</p><button>{_words(rng, 1)}</button>", f"<p>{say(3, 40)} <a href=#>{_words(rng, 2)}</a></p>"])
    if kind == "notice" and rng.random() < 0.2:
        return f"<{(t := rng.choice(['dialog', 'noscript']))}>{inner}</{t}>"
    return f"<{(t := rng.choice(["div", "div", "section", "p"] if "<p>" not in inner else ["div", "section"]))} {at}>{inner}</{t}>"


def labelled_pages(n: int = PAGES, seed: int = 9) -> list[str]:
    """Pages in which content stands inside elements marked ``data-content``."""
    rng = random.Random(seed)
    pages = []
    for _ in range(n):
        body = []
        if rng.random() < 0.8:
            body.append(f"<h1>{_words(rng, rng.randint(2, 10)).capitalize()}</h1>")
        for _ in range(rng.randint(1, 8)):
            x = rng.random()
            text = " ".join(_sentence(rng, rng.randint(2, 20)) for _ in range(rng.randint(1, 6)))
            if x < 0.65:
                body.append(f"<p>{rng.choice(['', '<b>'])}{text}{rng.choice(['</p>', '', '<br>' + _sentence(rng, 8) + '</p>'])}")
            elif x < 0.72:
                body.append(f"<h2>{_words(rng, rng.randint(1, 6))}</h2>")
            elif x < 0.8:
                body.append("<ul>" + "".join(f"<li>{_sentence(rng, rng.randint(1, 12))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif x < 0.86:
                body.append(f"<blockquote>{text}</blockquote>")
            elif x < 0.9:
                body.append(f"<table><tr><td>{_words(rng, 2)}</td><td>{_words(rng, 1)}</td></tr><tr><td>{_words(rng, 2)}</td></tr></table>")
            elif x < 0.94:
                body.append(f"<pre>{_words(rng, 8)}</pre>")
            else:
                body.append(f"<p>{_words(rng, rng.randint(1, 4))}</p>")
        marked = [f"<x-mark data-content>{b}</x-mark>" for b in body]
        for _ in range(rng.randint(0, 2)):  # boilerplate inside the article's element
            marked.insert(rng.randint(0, len(marked)), _outside(rng, rng.choice(["ad", "aside", "notice", "form", "nav"])))
        inner = "".join(marked)
        x = rng.random()
        if x < 0.4:
            inner = f"<article>{inner}</article>"
        elif x < 0.55:
            inner = f"<main>{inner}</main>"
        elif x < 0.6:
            inner = f"<main><article>{inner}</article></main>"
        elif x < 0.92:
            inner = f'<{(t := rng.choice(["div", "div", "section"]))} {rng.choice(["class", "id"])}="{rng.choice(_CONTENT)}">{inner}</{t}>'
        before = [_outside(rng, k) for k in rng.choices(["nav", "header", "ad", "notice", "form"], k=rng.randint(1, 4))]
        after = [_outside(rng, k) for k in rng.choices(["aside", "footer", "ad", "comments", "notice", "form", "nav"], k=rng.randint(1, 4))]
        if rng.random() < 0.7:
            after.append(_outside(rng, "footer"))
        page = "".join(before) + inner + "".join(after)
        if rng.random() < 0.3:
            page = f'<div class="{rng.choice(["wrapper", "container", "page", "site", "layout"])}">{page}</div>'
        pages.append(f"<html><head><title>{_words(rng, 4)}</title></head><body>{page}</body></html>")
    return pages


def _all_features(blocks: list[Block]) -> list[list[str]]:
    last = max(len(blocks) - 1, 1)
    return [[*b.context, *block_features(b, i / last)] for i, b in enumerate(blocks)]


@dataclass
class Field:
    """Weights towards content of each feature, and of label pairs; the other label's weights are their negatives."""

    weights: dict[str, float]
    steps: list[list[float]]

    def decode(self, blocks: list[Block], cache: dict | None = None) -> list[bool]:
        """The likeliest labels, by Viterbi; ties go to content."""
        if not blocks:
            return []
        get, cache = self.weights.get, {} if cache is None else cache
        last, s = max(len(blocks) - 1, 1), self.steps
        back, a, b = [], 0.0, 0.0
        for i, block in enumerate(blocks):
            around = cache.get(block.context)
            if around is None:
                if len(cache) > 50_000:
                    cache.clear()
                around = cache[block.context] = sum(get(f, 0.0) for f in sorted(block.context))
            e = around + sum(get(f, 0.0) for f in block_features(block, i / last))
            if not i:
                a, b = -e, e
                continue
            a0, a1, b0, b1 = a + s[0][0], b + s[1][0], a + s[0][1], b + s[1][1]
            back.append((a1 >= a0, b1 >= b0))
            a, b = max(a0, a1) - e, max(b0, b1) + e
        now = b >= a
        out = [now]
        for step in reversed(back):
            now = step[now]
            out.append(now)
        return out[::-1]


def train(pages: list[str], epochs: int = 25, rate: float = 0.3, decay: float = 2e-4) -> Field:
    """Maximum likelihood; ancestor features that only one page has are left out."""
    parsed = [p for p in map(leaf_blocks, pages) if p]
    for blocks in parsed:
        for b in blocks:
            b.context = b.context - {"x-mark"}
            if b.tag == "x-mark":
                b.tag = "div"
    rows = [(_all_features(blocks), [int(b.content) for b in blocks]) for blocks in parsed]
    count: dict[str, int] = {}
    for feats, _ in rows:
        for f in {x for one in feats for x in one}:
            count[f] = count.get(f, 0) + 1
    names = sorted(f for f, n in count.items() if n >= 2)
    place = {f: i for i, f in enumerate(names)}
    data = [([np.array([place[f] for f in one if f in place]) for one in feats], np.array(y)) for feats, y in rows]
    w, s = np.zeros(len(names)), np.zeros((2, 2))
    gw, gs = np.full(len(names), 1e-6), np.full((2, 2), 1e-6)
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            feats, y = data[i]
            e = np.array([w[f].sum() for f in feats])
            score = np.stack([-e, e], axis=1)
            n = len(y)
            alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
            alpha[0] = score[0]
            for t in range(1, n):
                alpha[t] = score[t] + np.logaddexp.reduce(alpha[t - 1][:, None] + s, axis=0)
            for t in range(n - 2, -1, -1):
                beta[t] = np.logaddexp.reduce(s + (score[t + 1] + beta[t + 1])[None, :], axis=1)
            z = np.logaddexp.reduce(alpha[-1])
            p = np.exp(alpha + beta - z)
            d = (2 * y - 1) - (p[:, 1] - p[:, 0])
            grad = np.zeros(len(w))
            for f, x in zip(feats, d, strict=True):
                grad[f] += x
            pairs = np.zeros((2, 2))
            if n > 1:
                pairs -= np.exp(alpha[:-1, :, None] + s[None] + (score[1:] + beta[1:])[:, None, :] - z).sum(axis=0)
                np.add.at(pairs, (y[:-1], y[1:]), 1)
            grad -= decay * w * n
            gw += grad * grad
            gs += pairs * pairs
            w += rate * grad / np.sqrt(gw)
            s += rate * pairs / np.sqrt(gs)
    return Field(dict(zip(names, w.tolist(), strict=True)), s.tolist())


def main_text(page: str | None, field: Field, cache: dict | None = None) -> str:
    """The content blocks of a page, joined by one space."""
    blocks = leaf_blocks(page, field.weights.keys()) if page else []
    return " ".join(b.text for b, y in zip(blocks, field.decode(blocks, cache), strict=True) if y)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", n_pages: int = PAGES) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    field = train(labelled_pages(n_pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [main_text(x, field, cache) for x in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.selectExpr(f"cast(`{id_col}` as long) page_id", f"cast(`{url_col}` as string) url", f"cast(`{html_col}` as string) html")
    return rows.mapInArrow(lambda b: freed(run(b)), "page_id long, url string, text string, n_chars long")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
