"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A leaf block is the text between two block-level tags. Its features are tags and class names of its
ancestors, its place, length, links, punctuation and cue words, and length and links of the blocks beside it.
The field has two labels, kept and dropped; it is trained by maximum likelihood (forward-backward, Adam) on
labelled pages and decoded by Viterbi.

Labelled pages: blocks of a bounded sample of real pages, of which those inside <article> are kept; copies of
these pages whose <article> and <main> are taken out or replaced by elements without a name; and the same texts
laid out anew in varied templates with known labels, in a third of which nothing names the article.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.llm.common import chunks, hashed_share

#: Pages that training reads at most; pages laid out anew.
SAMPLE_PAGES, TEMPLATE_PAGES = 150, 700
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
#: Fixed values of HTML: elements whose content is no text of the page; the first three hold raw text up to their end tag, or the page's end.
RAW, SKIPPED = {"script", "style", "textarea"}, {"script", "style", "textarea", "noscript", "template", "svg", "select"}
ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in SKIPPED}
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
#: Fixed values of HTML: elements without an end tag, and elements that do not end a block.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
#: Elements that a new element of the same kind closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Cue words of boilerplate in the corpus's languages.
CUES = set("copyright rights reserved cookie cookies privacy policy subscribe newsletter login signup share tweet comments comment reply sponsored advertisement related terms accept menu home contact datenschutz impressum kontakt anmelden anzeige werbung kommentare antworten teilen accueil contactez publicité partager commentaires répondre inicio contacto publicidad compartir comentarios responder suscribirse".split())


class Node:
    """An element and its ancestors, by a link to the parent."""

    __slots__ = ("tag", "names", "parent", "held", "depth", "hidden", "own")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Node | None):
        self.tag, self.names, self.parent, self.own = tag, names, parent, None
        plain = tag not in ("html", "body")
        more = {f"name={n}" for n in names} | ({f"in={tag}"} if plain else set())
        above = parent.held if parent else frozenset()
        self.held = above if more <= above else above | more
        self.depth = (parent.depth if parent else 0) + plain
        self.hidden = tag in ("head", "title") or bool(parent and parent.hidden)

    def features(self) -> tuple[str, ...]:
        """The features that the ancestors alone give."""
        if self.own is None:
            tags, at = [], self
            while at and len(tags) < 2:
                tags += [at.tag] if at.tag not in ("html", "body") else []
                at = at.parent
            self.own = ("bias", f"tag={tags[0] if tags else 'none'}", f"depth={min(self.depth, 6)}", *sorted(self.held), *([f"tags={tags[1]}>{tags[0]}"] if len(tags) > 1 else []))
        return self.own


ROOT = Node("body", (), None)


@dataclass
class Block:
    text: str
    node: Node
    link_chars: int = 0

    def inside(self, tag: str) -> bool:
        return f"in={tag}" in self.node.held


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks with text in page order; head, scripts, styles, comments and markup give none."""
    page = page or ""
    out: list[Block] = []
    node, held = ROOT, []
    open_tags: Counter[str] = Counter()
    unclosed: set[str] = set()
    links, link_chars, at = 0, 0, 0

    def flush() -> None:
        nonlocal link_chars
        if held:
            text = " ".join("".join(held).split())
            if text and not node.hidden:
                out.append(Block(text, node, link_chars))
        held.clear()
        link_chars = 0

    def add(raw: str) -> None:
        nonlocal link_chars
        text = entities.unescape(raw) if "&" in raw else raw
        held.append(text)
        if links:
            link_chars += len(text)

    while m := TOKEN.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        ended, empty = bool(m[1]), m[3].endswith("/")
        if tag in SKIPPED and not ended and (tag in RAW or not empty) and tag not in unclosed:
            if end := ENDS[tag].search(page, at):
                at = end.end()
                continue
            if tag in RAW:
                at = len(page)
                continue
            unclosed.add(tag)
        if tag == "br":
            held.append(" ")
            continue
        if tag == "a":
            links = 0 if ended else 1
        if tag in INLINE:
            continue
        flush()
        if ended:
            if open_tags[tag]:
                while True:
                    open_tags[node.tag] -= 1
                    last, node = node.tag, node.parent
                    if last == tag:
                        break
        elif tag not in VOID and not empty:
            closed = CLOSES.get(tag)
            if closed and node is not ROOT and node.tag in closed:
                open_tags[node.tag] -= 1
                node = node.parent
            if tag == "body":
                node, open_tags = ROOT, Counter()
            names = tuple(x.lower() for got in NAMES.findall(m[3]) for x in PARTS.findall(" ".join(got))) if "=" in m[3] else ()
            node = Node(tag, names, node)
            open_tags[tag] += 1
    add(page[at:])
    flush()
    return out


def features(page: list[Block]) -> list[list[str]]:
    """Names of the features that hold of each block."""
    rows = []
    looks = ["none", *(f"{min(8, len(b.text).bit_length()) // 2}:{min(1, 2 * b.link_chars // max(1, len(b.text)))}" for b in page), "none"]
    for i, b in enumerate(page):
        f = [*b.node.features()]
        n, words = len(b.text), b.text.split(" ")
        f.append(f"chars={min(8, n.bit_length())}")
        f.append(f"linked={min(3, 4 * b.link_chars // max(1, n))}")
        f.append(f"end={b.text[-1] if b.text[-1] in '.!?:,;' else 'other'}")
        f += [f"before={looks[i]}", f"after={looks[i + 2]}"]
        f.append(f"place={'first' if i == 0 else 'last' if i == len(page) - 1 else 'inner'}")
        low = {w.strip('.,:;!?()').lower() for w in words}
        cues = len(low & CUES)
        f.append(f"cues={min(cues, 3)}")
        if n < 300 and ("©" in b.text or "(c)" in b.text):
            f.append("copyright")
        rows.append(f)
    return rows


@dataclass
class Crf:
    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    named: dict[str, float] | None = None

    def scores(self, rows: list[list[str]]) -> list[float]:
        """For each block, the weight of `kept` over `dropped`."""
        if self.named is None:
            self.named = dict(zip(self.index, self.weights.tolist()))
        get = self.named.get
        return [sum(get(x, 0.0) for x in r) for r in rows]

    def viterbi(self, scores: list[float]) -> list[int]:
        if not scores:
            return []
        (a, b), (c, d) = self.moves.tolist()
        off, on, back = 0.0, scores[0], []
        for s in scores[1:]:
            to_off, to_on = (0, off + a) if off + a >= on + c else (1, on + c), (0, off + b) if off + b > on + d else (1, on + d)
            back.append((to_off[0], to_on[0]))
            off, on = to_off[1], to_on[1] + s
        label = int(on > off)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def labels(self, page: list[Block]) -> list[int]:
        return self.viterbi(self.scores(features(page)))


def likelihood(s: np.ndarray, moves: np.ndarray, mask: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood of all chains and its slopes by s and moves. s: weight of `kept` at each block of each chain."""
    b, t = s.shape
    both = mask[:, 1:] * mask[:, :-1]
    node = np.stack([np.zeros_like(s), s], 2)
    alpha, beta = np.zeros((b, t, 2)), np.zeros((b, t, 2))
    alpha[:, 0] = node[:, 0]
    for k in range(1, t):
        nxt = np.logaddexp(alpha[:, k - 1, 0:1] + moves[0], alpha[:, k - 1, 1:2] + moves[1]) + node[:, k]
        alpha[:, k] = np.where(mask[:, k : k + 1] > 0, nxt, alpha[:, k - 1])
    for k in range(t - 2, -1, -1):
        x = node[:, k + 1] + beta[:, k + 1]
        prev = np.logaddexp(x[:, 0:1] + moves[:, 0], x[:, 1:2] + moves[:, 1])
        beta[:, k] = np.where(mask[:, k + 1 : k + 2] > 0, prev, 0.0)
    z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    p = np.exp(alpha[..., 1] + beta[..., 1] - z[:, None]) * mask
    pair = np.exp(alpha[:, :-1, :, None] + moves + (node + beta)[:, 1:, None, :] - z[:, None, None, None]) * both[..., None, None]
    seen = np.zeros((2, 2))
    np.add.at(seen, (target[:, :-1][both > 0], target[:, 1:][both > 0]), 1)
    loss = float(z.sum() - (s * target * mask).sum() - (seen * moves).sum())
    return loss, (p - target) * mask, pair.sum((0, 1)) - seen


def fit(pages: list[tuple[list[list[str]], list[int]]], steps: int = 120, rate: float = 0.15, decay: float = 2e-3, longest: int = 60) -> Crf:
    """Maximum likelihood by forward-backward over all chains at once; longer chains are cut for training."""
    cut = [(r[i : i + longest], y[i : i + longest]) for r, y in pages for i in range(0, len(r), longest)]
    index: dict[str, int] = {}
    for r, _ in cut:
        for x in r:
            for name in x:
                index.setdefault(name, len(index))
    if not cut:
        return Crf()
    b, t = len(cut), max(len(r) for r, _ in cut)
    mask, target = np.zeros((b, t)), np.zeros((b, t), np.int64)
    cell, code = [], []
    for i, (r, y) in enumerate(cut):
        mask[i, : len(r)], target[i, : len(r)] = 1, y
        for j, x in enumerate(r):
            cell += [i * t + j] * len(x)
            code += [index[name] for name in x]
    cell, code = np.array(cell), np.array(code)
    w, moves = np.zeros(len(index)), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for step in range(1, steps + 1):
        _, slopes, by_moves = likelihood(np.bincount(cell, w[code], minlength=b * t).reshape(b, t), moves, mask, target)
        g_moves = by_moves / b + decay * moves
        g = np.bincount(code, slopes.ravel()[cell], minlength=len(w)) / b + decay * w
        grad = np.append(g, g_moves.ravel())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, moves = w - change[:-4], moves - change[-4:].reshape(2, 2)
    return Crf(index, w, moves)


#: Names that pages give to the parts of their layout; the templates draw from them.
KEPT_WRAPPERS = ["<article>", "<main><article>", '<main id="main">', '<div class="content">', '<div id="article-body">', '<div class="post-content">', '<section class="entry-content">', '<div class="story body-text">', '<article class="post">', '<div class="main-text">']
#: What stands for the article's element where nothing names it; the first puts its blocks beside the page's other parts.
NAMELESS = ["", "", "<div>", "<div><div>", "<section>", "<div><section>", "<center>", "<table><tr><td>"]
WRAPPER = re.compile(r"<(/?)(?:article|main)\b[^>]*>", re.I)
DROPPED = {
    "nav": ["<nav>", '<nav class="menu">', '<div class="navbar">', '<ul class="menu main-menu">', '<div id="navigation">', '<div class="breadcrumbs">', '<div class="topbar">'],
    "header": ["<header>", '<header class="site-header">', '<div class="page-header banner">', '<div id="masthead">'],
    "footer": ["<footer>", '<div class="footer">', '<footer class="site-footer">', '<div id="colophon footer">', '<div class="copyright">'],
    "aside": ["<aside>", '<aside class="sidebar">', '<div class="sidebar">', '<div id="secondary" class="widget">', '<div class="related-posts">', '<div class="recommended">', '<section class="see-also related">'],
    "ad": ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<aside class="sponsored">', '<div class="promo">', '<div id="ad-slot">', '<section class="advertisement">', '<div class="banner-ad">'],
    "notice": ['<div class="cookie">', '<div class="cookie-notice">', '<div id="consent-banner">', '<div class="notice">', '<div class="alert">', '<div class="gdpr popup">', '<div role="alert" class="message">', '<div class="modal overlay">'],
    "form": ["<form>", '<form class="newsletter">', '<form id="search-form">', '<div class="subscribe"><form>', '<form class="login">'],
    "comments": ['<div class="comments">', '<section id="comments">', '<div class="comment-list">', '<ol class="commentlist">', '<section class="reader-comments">', '<div id="disqus_thread" class="discussion">', '<div class="responses">'],
    "share": ['<div class="share">', '<ul class="social">', '<div class="share-buttons">', '<div class="byline-tools toolbar">'],
}


def closing(opened: str) -> str:
    return "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opened)))


def laid_out(prose: list[str], short: list[str], rng: random.Random) -> tuple[str, list[int]]:
    """A page of these texts, and the label of each of its blocks."""
    parts: list[tuple[str, int]] = []
    esc = entities.escape

    def dropped(kind: str) -> None:
        opened = rng.choice(DROPPED[kind])
        parts.append((opened, -1))
        if kind in ("nav", "share"):
            parts.append(("<ul>", -1))
            for _ in range(rng.randint(2, 8)):
                parts.append((f'<li><a href="/x">{esc(rng.choice(short))}</a></li>', 0))
            parts.append(("</ul>", -1))
        elif kind == "form":
            for _ in range(rng.randint(1, 3)):
                parts.append((rng.choice(["<label>{}</label><br/>", "<p>{}</p>", "<div>{}</div>", "<button>{}</button>", "<fieldset>{}</fieldset>"]).format(esc(rng.choice(short + prose))), 0))
            parts[-1] = (f"<div>{parts[-1][0]}</div>", 0)
        elif kind == "comments":
            if rng.random() < 0.7:
                parts.append((f"<h3>{esc(rng.choice(short))}</h3>", 0))
            for _ in range(rng.randint(1, 5)):
                one = rng.choice(['<div class="comment">{}</div>', '<li class="comment"><p>{}</p></li>', "<p>{}</p>", '<article class="comment"><p>{}</p></article>', "<div><p>{}</p></div>", '<div class="reply">{}</div>'])
                parts.append((one.format(esc(rng.choice(prose))), 0))
        else:
            for _ in range(rng.randint(1, 3)):
                text = rng.choice(prose) if rng.random() < 0.6 else rng.choice(short)
                text = f"© {text}" if kind == "footer" and rng.random() < 0.5 else text
                form = rng.choice(["{}", "<p>{}</p>", "<h3>{}</h3>", "<ul><li><a>{}</a></li></ul>", "<div>{}</div>"])
                parts.append((form.format(esc(text)), 0))
                if form == "{}":
                    break
        parts.append((closing(opened), -1))

    for kind in ("header", "nav", "ad", "notice"):
        if rng.random() < 0.6:
            dropped(kind)
    wrapper = rng.choice(KEPT_WRAPPERS if rng.random() < 2 / 3 else NAMELESS)
    parts.append((wrapper, -1))
    parts.append((f"<h1>{esc(rng.choice(prose)[:80].strip() or 'x')}</h1>", 1))
    for text in rng.sample(prose, rng.randint(0, min(len(prose), 9))):
        form = rng.choice(["<p>{}</p>"] * 8 + ["<p><b>{}</b></p>", "<p>{}", "<h2>{}</h2>", "<h3>{}</h3>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>", "<div>{}</div>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>", '<p>{} <a href="/y">more</a></p>', "<section><p>{}</p></section>", "<figure><figcaption>{}</figcaption></figure>", "<ol><li><p>{}</p></li></ol>"])
        text = rng.choice(short) if rng.random() < 0.15 else text
        parts.append((form.format(esc(text)), 1))
        if rng.random() < 0.12:
            dropped(rng.choice(["ad", "aside", "share", "notice", "form", "nav"]))
    if rng.random() < 0.3:
        dropped(rng.choice(["comments", "share", "aside"]))
    parts.append((closing(wrapper), -1))
    for kind in ("comments", "aside", "form", "footer"):
        if rng.random() < 0.55:
            dropped(kind)
    body = "".join(x for x, _ in parts)
    return f"<html><head><title>{esc(rng.choice(short))}</title></head><body>{body}</body></html>", [y for _, y in parts if y >= 0]


def unnamed(page: str, element: str) -> str:
    """The page with each <article> and <main> replaced by `element` (a start tag), or taken out where that is empty."""
    return WRAPPER.sub(lambda m: closing(element) if m[1] else element, page)


def labelled_pages(sample: list[str], n: int = TEMPLATE_PAGES, seed: int = 42) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels: the sample itself, its <article> kept, a copy of each page with neither <article> nor <main>, and n pages laid out from its texts."""
    rng, out = random.Random(seed), []
    prose, short = [], ["Home", "About us", "Contact", "Log in", "Share", "Privacy policy", "All rights reserved", "Subscribe", "Menu", "Read more", "Datenschutz", "Kontakt", "Accueil", "Inicio", "Accept cookies", "Reply", "Advertisement"]
    for page in sample:
        got = blocks(page)
        kept = [int(b.inside("article")) for b in got]
        if any(kept):
            out.append((features(got), kept))
            copy = blocks(unnamed(page, rng.choice(["", "<div>", "<section>"])))
            if [b.text for b in copy] == [b.text for b in got]:
                out.append((features(copy), kept))
        for b, y in zip(got, kept):
            (prose if y and len(b.text) > 25 else short).append(b.text)
    prose = prose or ["A sentence that stands for the text of an article, with a full stop."]
    for _ in range(n):
        page, labels = laid_out(prose, short, rng)
        got = blocks(page)
        if len(got) == len(labels):
            out.append((features(got), labels))
    return out


def train(pages: DataFrame, rows: int = SAMPLE_PAGES) -> Crf:
    """Trains on at most about `rows` whole pages, chosen by a hash of the id."""
    usable = pages.select("page_id", "html").where("page_id is not null and html is not null")
    got = hashed_share(usable, "page_id", rows, usable.count()).orderBy("page_id", "html").limit(2 * rows).collect()
    return fit(labelled_pages([r.html for r in got]))


def extract(pages: DataFrame, model: Crf, html_col: str = "html") -> DataFrame:
    """pages plus text: the kept blocks, joined by a line feed; empty if there are none or html is null.

    A column named text is replaced, others pass through; repeated pages stay; an empty table gives no rows. A
    page of any length or depth is read whole, by one task, in time that grows with its length.
    """
    names = [c for c in pages.columns if c.lower() != "text"]
    source, at = pages.select(*[F.col(f"`{c}`") for c in names]), names.index(html_col)
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = sent.value
        for batch in chunks(batches, html_col):
            texts = []
            for page in batch.column(at).to_pylist():
                got = blocks(page)
                texts.append("\n".join(b.text for b, y in zip(got, crf.labels(got)) if y))
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*names, "text"])

    return source.mapInArrow(run, source.withColumn("text", F.lit("")).schema)
