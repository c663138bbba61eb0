"""Main text of web pages by a tree-structured graphical model.

The block elements of a page are the nodes of a tree; each is content or not.  A
node's features give its own potential, and each parent-child edge one for the two
labels together, by the child's element.  Sum-product messages go up to the root and
down again, which gives every node's exact marginal; a node whose marginal exceeds
one half is content, and a page's text is that of its content nodes in page order.

The potentials are trained on the labelled pages of ``labelled_pages`` by ascent of
the exact likelihood, once in the driver; tasks get some hundred numbers.  Pages are
read and scored batch by batch; nothing is shuffled.

Defined results: a null or empty page has empty text, as has one without content
nodes; unclosed or crossed tags close where the next block needs it; a page of any
length is read whole; repeated rows give equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dom import HINTS, N_NUMBERS, TAGS, Forest, by_level
from .words import slices

T, H = len(TAGS), len(HINTS)
NAMED = 1 + T + H
WIDTH = NAMED + N_NUMBERS


def design(x: dict) -> np.ndarray:
    """Features of each node: a constant, its element, its hints, its numbers."""
    out = np.zeros((len(x["tag"]), WIDTH))
    out[:, 0] = 1
    out[np.arange(len(out)), 1 + x["tag"]] = 1
    out[x["hint_node"], 1 + T + x["hint"]] = 1
    out[:, NAMED:] = x["numbers"]
    return out


def _log_sum(a: np.ndarray) -> np.ndarray:
    """log(exp(a) summed over the last axis, of length 2)."""
    hi, lo = np.maximum(a[..., 0], a[..., 1]), np.minimum(a[..., 0], a[..., 1])
    return hi + np.log1p(np.exp(lo - hi))


def _potentials(w: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node's log-potential for content, and its edge's for (parent, own) labels.

    The numbers speak through the edges below nodes that aren't content: a short
    paragraph tells something in a page's frame, nothing inside an article.
    """
    own = f[:, :NAMED] @ w[:NAMED]
    return own, (f @ w[NAMED:].reshape(WIDTH, 4)).reshape(-1, 2, 2)


def sum_product(own: np.ndarray, edge: np.ndarray, parent: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of nodes (n,) and of edges (n, 2, 2), and the log of all partition sums."""
    inside = np.stack([np.zeros_like(own), own], axis=1)
    sent = np.zeros_like(inside)
    levels = by_level(level)
    for at in reversed(levels[1:]):
        sent[at] = _log_sum(edge[at] + inside[at][:, None, :])
        np.add.at(inside, parent[at], sent[at])
    belief = inside.copy()
    pairs = np.zeros_like(edge)
    log_z = float(_log_sum(inside[levels[0]]).sum()) if len(own) else 0.0
    for at in levels[1:]:
        rest = belief[parent[at]] - sent[at]
        joint = rest[:, :, None] + edge[at] + inside[at][:, None, :]
        pairs[at] = np.exp(joint - _log_sum(_log_sum(joint))[:, None, None])
        belief[at] = inside[at] + _log_sum(np.swapaxes(rest[:, :, None] + edge[at], 1, 2))
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), pairs, log_z


def _gradient(w: np.ndarray, f: np.ndarray, x: dict, y: np.ndarray) -> np.ndarray:
    own, edge = _potentials(w, f)
    p, pairs, _ = sum_product(own, edge, x["parent"], x["level"])
    inner = np.flatnonzero(x["parent"] >= 0)
    e = -pairs
    e[inner, y[x["parent"][inner]], y[inner]] += 1
    edges = f.T @ e.reshape(-1, 4)
    edges[NAMED:, 2:] = 0  # numbers tell nothing below a content node
    return np.concatenate([f[:, :NAMED].T @ (y - p), edges.ravel()])


def train(pages: list[str], rounds: int = 150, rate: float = 0.15, ridge: float = 0.0005) -> np.ndarray:
    """Weights from labelled pages: ``data-main`` attributes mark where labels change."""
    forest = Forest()
    for page in pages:
        forest.add(page)
    x = forest.arrays()
    y = np.zeros(len(x["parent"]), np.int64)
    for i, (mark, parent) in enumerate(zip(x["marked"].tolist(), x["parent"].tolist(), strict=True)):
        y[i] = mark if mark >= 0 else (y[parent] if parent >= 0 else 0)
    f = design(x)
    w = np.zeros(NAMED + 4 * WIDTH)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        g = _gradient(w, f, x, y) - ridge * len(pages) * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def labelled_pages(n: int = 300, seed: int = 7) -> list[str]:
    """Labelled pages of common layouts: filler words in regions whose label is known.

    A region put beside or inside the article is marked ``data-main="0"``; the
    article, or the paragraphs where a page has no such element, ``data-main="1"``.
    A share of the pages names nothing: there lengths, links and elements alone tell.
    """
    rng = np.random.default_rng(seed)
    syllables = "ka lo mi tu re so na vel dor ith an per qui sal mon tra".split()

    def word():
        return "".join(rng.choice(syllables, rng.integers(1, 4)))

    def say(lo, hi):
        words = [word() + ("," if rng.random() < 0.08 else "") for _ in range(rng.integers(lo, hi))]
        return " ".join(words).capitalize() + "."

    def pick(*options):
        return options[rng.integers(len(options))]

    def links(lo, hi, tag="li"):
        return "".join(f'<{tag}><a href="/{word()}">{word()}</a></{tag}>' for _ in range(rng.integers(lo, hi)))

    def outside():
        return pick(
            f'<nav data-main="0"><ul>{links(3, 8)}</ul></nav>',
            f'<header data-main="0"><div class="logo">{word()}</div><ul>{links(2, 6)}</ul></header>',
            f'<div class="menu" data-main="0"><ul>{links(3, 8)}</ul></div>',
            f'<div class="breadcrumbs" data-main="0">{links(2, 4, "span")}</div>',
            f'<div class="{pick("ad", "ads", "advert", "ad-slot", "sponsored", "promo")}" data-main="0">{say(4, 25)}</div>',
            f'<div class="{pick("cookie-notice", "banner", "consent", "notice", "alert")}" data-main="0"><p>{say(5, 25)}</p><button>{word()}</button></div>',
            f'<aside data-main="0"><h3>{word()}</h3><ul>{links(2, 6)}</ul><p>{say(4, 20)}</p></aside>',
            f'<div id="sidebar" data-main="0"><h2>{word()}</h2><p>{say(4, 30)}</p><ul>{links(2, 6)}</ul></div>',
            f'<form data-main="0"><label>{word()}</label><input name="q"><button>{word()}</button><p>{say(3, 12)}</p></form>',
            f'<div class="{pick("newsletter", "subscribe", "login", "search")}" data-main="0"><form><p>{say(3, 12)}</p><input></form></div>',
            f'<div class="{pick("related", "recommended", "social", "share")}" data-main="0"><h3>{word()}</h3><ul>{links(2, 6)}</ul></div>',
        )

    def after():
        return pick(
            f'<footer data-main="0">&copy; {word()} &middot; {say(3, 30)}</footer>',
            f'<footer data-main="0"><p>{say(3, 30)}</p><ul>{links(2, 5)}</ul></footer>',
            f'<div class="footer" data-main="0"><p>{say(3, 25)}</p></div>',
            f'<section class="comments" data-main="0"><h3>{word()}</h3>' + "".join(f'<div class="comment"><p>{say(4, 40)}</p></div>' for _ in range(rng.integers(1, 5))) + "</section>",
            f'<div id="comments" data-main="0"><ol>' + "".join(f"<li><p>{say(4, 40)}</p></li>" for _ in range(rng.integers(1, 5))) + "</ol></div>",
        )

    def inside():
        return pick(
            f'<div class="{pick("ad", "advert", "sponsor", "promo")}" data-main="0">{say(4, 25)}</div>',
            f'<aside data-main="0"><p>{say(4, 25)}</p></aside>',
            f'<form data-main="0"><p>{say(3, 12)}</p><input><button>{word()}</button></form>',
            f'<div class="{pick("share", "social", "related")}" data-main="0"><ul>{links(2, 5)}</ul></div>',
            f'<div class="comments" data-main="0"><div class="comment"><p>{say(4, 40)}</p></div></div>',
            f'<nav data-main="0"><ul>{links(2, 5)}</ul></nav>',
            f'<footer data-main="0">{say(3, 15)}</footer>',
            f'<div class="notice" data-main="0"><p>{say(5, 20)}</p></div>',
        )

    def block():
        return pick(
            *[f"<p>{say(5, 120)}</p>"] * 5,
            f"<p>{say(1, 5)}</p>",
            f"<p><b>{say(3, 30)}<br>",
            f"<h2>{word()} {word()}</h2>",
            f"<h3>{word()}</h3>",
            "<ul>" + "".join(f"<li>{say(2, 20)}</li>" for _ in range(rng.integers(2, 6))) + "</ul>",
            "<ol>" + "".join(f"<li><p>{say(2, 20)}</p></li>" for _ in range(rng.integers(2, 6))) + "</ol>",
            f"<blockquote><p>{say(4, 40)}</p></blockquote>",
            f"<blockquote>{say(4, 40)}</blockquote>",
            f"<pre>{say(4, 40)}</pre>",
            f"<table><tr><th>{word()}</th><td>{say(1, 5)}</td></tr></table>",
            f"<figure><img src=x><figcaption>{say(2, 12)}</figcaption></figure>",
            f"<section><h2>{word()}</h2><p>{say(5, 80)}</p></section>",
            f"<div><p>{say(5, 80)}</p></div>",
            f"<dl><dt>{word()}</dt><dd>{say(2, 12)}</dd></dl>",
            f'<p>{say(3, 30)} <a href="/{word()}">{word()}</a> {say(3, 30)}</p>',
        )

    def nameless():
        """A name as style tools make them."""
        return f'class="{pick("css", "sc", "x", "jss", "r")}-{rng.integers(1 << 24):06x}"'

    def beside():
        return pick(
            f'<div {nameless()} data-main="0">{links(3, 9, "span")}</div>',
            f'<div {nameless()} data-main="0"><ul>{links(3, 8)}</ul></div>',
            f'<div {nameless()} data-main="0"><div {nameless()}><a href="/">{word()}</a></div><div {nameless()}>{links(2, 6, "div")}</div></div>',
            f'<div {nameless()} data-main="0"><h3>{word()}</h3><ul>{links(2, 6)}</ul></div>',
            f'<div {nameless()} data-main="0"><p>{say(2, 9)}</p>{links(2, 5, "span")}</div>',
            f'<div {nameless()} data-main="0"><label>{word()}</label><input><button>{word()}</button></div>',
            outside(),
        )

    def below():
        return pick(f'<div {nameless()} data-main="0">&copy; {word()} {links(2, 6, "span")}</div>', f'<div {nameless()} data-main="0"><p>&copy; {say(2, 8)}</p><ul>{links(3, 8)}</ul></div>', after())

    def unnamed_page():
        title, paragraphs = f"<h1>{say(2, 12)}</h1>", "".join(f"<p>{say(12, 120)}</p>" for _ in range(rng.integers(2, 8)))
        kind = pick("box", "deep", "split", "thread", "tips", "cells", "text", "plain")
        if kind == "box":
            core = f'<div {nameless()} data-main="1">{title}{paragraphs}</div>'
        elif kind == "deep":
            core = f'<div {nameless()}><div {nameless()}><div data-main="1" {nameless()}>{title}<div>{paragraphs}</div></div></div></div>'
        elif kind == "split":
            core = f'<h1 data-main="1">{say(2, 12)}</h1><div data-main="1">{paragraphs}</div>'
        elif kind == "thread":
            core = f'<div {pick(nameless(), "class=thread")} data-main="1">' + "".join(f"<div {pick(nameless(), 'class=msg')}>{pick(*['<p>%s</p>'] * 3, '%s', '<p>%s</p><p>%s</p>').replace('%s', say(8, 80))}</div>" for _ in range(rng.integers(2, 8))) + "</div>"
        elif kind == "tips":
            core = f'<h1 data-main="1">{say(2, 12)}</h1><{pick("ol", "ul")} data-main="1">' + "".join(f'<li><a href="/{word()}">{word()} {word()}</a> {say(5, 40)}</li>' for _ in range(rng.integers(4, 14))) + "</ol>"
        elif kind == "cells":
            core = f'<table><tr><td {pick("", nameless(), "class=side")} data-main="0">{links(3, 9, "div")}</td><td data-main="1">{title}{paragraphs}</td></tr></table>'
        elif kind == "plain":
            core = "".join(f'<p data-main="1">{say(6, 40)}</p>' for _ in range(rng.integers(2, 8)))
        else:
            core = "<br><br>".join(say(20, 120) for _ in range(rng.integers(1, 6)))
        top, end = "".join(beside() for _ in range(rng.integers(0, 4))), "".join(below() for _ in range(rng.integers(0, 3)))
        mark = ' data-loose="1"' if kind == "text" else ""
        wrap = ("", "")
        if kind != "text" and rng.random() < 0.5:
            wrap = pick((f"<div {nameless()}>", "</div>"), (f"<div id=root><div {nameless()}>", f"</div>{beside()}</div>"), (f"<div {nameless()}>{beside()}", f"{beside()}</div>"))
        return f"<!DOCTYPE html><html><head><title>{say(2, 10)}</title></head><body{mark}>{top}{wrap[0]}{core}{wrap[1]}{end}</body></html>"

    out = []
    for k in range(n):
        if k % 2:
            out.append(unnamed_page())
            continue
        head = f"<h1>{say(2, 12)}</h1>"
        if rng.random() < 0.2:
            head = f"<header>{head}<p>{say(2, 8)}</p></header>"
        if rng.random() < 0.25:  # many short lines
            body = [f"<p>{say(1, 4)}</p>" for _ in range(rng.integers(5, 60))]
        else:
            body = [block() for _ in range(rng.integers(0, 12))]
        for _ in range(rng.integers(0, 3)):
            body.insert(rng.integers(len(body) + 1), inside())
        inner = head + "".join(body)
        name = pick("article", "article", "article", "main", "content", "content", "div", "bare")
        if name in ("article", "main"):
            core = f'<{name} data-main="1">{inner}</{name}>'
        elif name == "content":
            core = f'<div class="{pick("content", "post", "entry-content", "article-body", "story", "main-text")}" data-main="1">{inner}</div>'
        elif name == "div":
            core = f'<main data-main="1"><article>{inner}</article></main>'
        else:
            core = "".join(f'<p data-main="1">{say(8, 120)}</p>' for _ in range(rng.integers(2, 8)))
        if rng.random() < 0.3:
            core = f'<div class="{pick("wrapper", "page", "container", "row")}">{core}</div>'
        top = "".join(outside() for _ in range(rng.integers(0, 4)))
        end = "".join(after() for _ in range(rng.integers(0, 3)))
        out.append(f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{say(2, 10)}</title></head><body>{top}{core}{end}</body></html>")
    return out


@lru_cache(maxsize=1)
def weights() -> np.ndarray:
    return train(labelled_pages())


def content_nodes(forest: Forest, w: np.ndarray) -> np.ndarray:
    """Each node's marginal probability of being content."""
    x = forest.arrays()
    return sum_product(*_potentials(w, design(x)), x["parent"], x["level"])[0]


def extract(pages: DataFrame, w: np.ndarray | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""
    w = weights() if w is None else w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html", 2 << 20):
                forest = Forest()
                for source in batch.column("html").to_pylist():
                    forest.add(source or "")
                texts = forest.main_texts(content_nodes(forest, w) > 0.5)
                columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    columns = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")]
    return pages.select(*columns).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_main_text(spark, sf_dir):
    """The main text of every page of the table."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
