"""Main-text extraction: gradient-boosted trees over DOM nodes, and a decoding along the tree.

Each block element and each run of text gets the probability that main text is in it. The decoding finds the
most likely choice in which nothing below a dropped node is kept, so no descendant contradicts its ancestor.
The trees are trained here, on pages that ``page_maker`` makes with known main text.
"""

from __future__ import annotations

import hashlib
import io
import random
import re
import uuid
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm import html_dom
from rasterlake.llm.common import shared_dir, table
from rasterlake.llm.html_dom import Node, parse

#: Attribute tokens and tags that speak for or against main text, in groups.
TOKENS = {
    "nav": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc topnav subnav megamenu tabs skip",
    "head": "header masthead topbar banner branding logo site-header sitename hero-nav",
    "foot": "footer foot colophon bottom copyright legal site-footer",
    "side": "sidebar side aside rail widget widgets related recommended recommendations trending popular more-stories",
    "note": "cookie cookies consent gdpr notice notification alert alerts popup modal overlay dialog toast privacy warning",
    "ads": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted adsense adslot banner-ad dfp",
    "form": "form search searchbox login signin signup subscribe subscription newsletter register contact-form",
    "talk": "comment comments commentlist discussion disqus reply replies respond respondents reviews thread reader-comments",
    "share": "share sharing social follow tweet facebook byline meta tags tag-list",
    "main": "article articles content main post entry story body text article-body post-content entry-content maincontent prose page-content hentry blog-post",
}
TAGS = {
    "nav": "nav menu", "head": "header", "foot": "footer", "side": "aside", "form": "form button select fieldset input label textarea",
    "main": "article main", "list": "ul ol li dl dt dd", "cell": "table thead tbody tr td th", "para": "p pre blockquote figcaption",
    "title": "h1 h2 h3 h4 h5 h6 hgroup", "box": "div section center", "fig": "figure picture", "run": "#text", "top": "html body #root", "dead": "head dialog",
}
_GROUPS = list(TOKENS)
_TAG_GROUPS = list(TAGS)
_OF_TOKEN: dict[str, int] = {}
for _k, _words in enumerate(TOKENS.values()):
    for _w in _words.split():
        _OF_TOKEN[_w] = _OF_TOKEN.get(_w, 0) | 1 << _k
_OF_TAG = {t: k for k, ts in enumerate(TAGS.values()) for t in ts.split()}
_SPLIT = re.compile(r"[^a-z0-9]+")
_ROLES = {"navigation": "nav", "banner": "head", "contentinfo": "foot", "complementary": "side", "dialog": "note", "alertdialog": "note", "alert": "note", "search": "form", "form": "form", "main": "main", "article": "main"}
N_TAG, N_GROUP = len(TAGS), len(TOKENS)
N_FEATURES = N_TAG + 2 * N_GROUP + N_TAG + 18


@cache
def _token_mask(tag: str, attrs: str) -> int:
    """Groups that an element's tag, class, id, role and label name, as bits."""
    got = Node(tag, None, attrs).attributes()
    mask = 0
    for name in ("class", "id", "itemprop", "data-component", "aria-label"):
        value = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", got.get(name, "")).lower()
        for word in value.split():
            mask |= _OF_TOKEN.get(word, 0)
            for part in _SPLIT.split(word):
                mask |= _OF_TOKEN.get(part, 0)
    role = _ROLES.get(got.get("role", "").lower())
    if role:
        mask |= 1 << _GROUPS.index(role)
    if "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", ""):
        mask |= 1 << N_GROUP
    return mask


def page_nodes(root: Node) -> list[Node]:
    """Nodes in page order, each before those below it."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.children))
    return out


def features(nodes: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """A row of numbers for each node, and each node's parent by index (-1: none)."""
    n = len(nodes)
    index = {id(x): i for i, x in enumerate(nodes)}
    parent = np.array([-1 if x.parent is None else index[id(x.parent)] for x in nodes], dtype=np.int64)
    up = parent.tolist()
    tag = [_OF_TAG.get(x.tag, -1) for x in nodes]
    own = [_token_mask(x.tag, x.attrs) if x.attrs else 0 for x in nodes]
    chars, links, runs, size, punct, words = ([0] * n for _ in range(6))
    for i in range(n - 1, -1, -1):
        x = nodes[i]
        if x.tag == "#text":
            t = x.text
            chars[i], links[i], runs[i], words[i] = len(t), min(x.link, len(t)), 1, t.count(" ") + 1
            punct[i] = t.count(".") + t.count(",") + t.count("!") + t.count("?") + t.count(";")
        size[i] += 1
        p = up[i]
        if p >= 0:
            for a in (chars, links, runs, size, punct, words):
                a[p] += a[i]
    above_tag, above_token, depth, before = [0] * n, [0] * n, [0] * n, [0] * n
    place, of, alike = [0] * n, [1] * n, [1] * n
    seen = 0
    for i, x in enumerate(nodes):
        p = up[i]
        if p >= 0:
            above_tag[i] = above_tag[p] | (1 << tag[p] if tag[p] >= 0 else 0)
            above_token[i] = above_token[p] | own[p]
            depth[i] = depth[p] + 1
        before[i] = seen
        if x.tag == "#text":
            seen += chars[i]
        kids = x.children
        if kids:
            same: dict[str, int] = {}
            for k in kids:
                same[k.tag] = same.get(k.tag, 0) + 1
            for j, k in enumerate(kids):
                c = index[id(k)]
                place[c], of[c], alike[c] = j, len(kids), same[k.tag]
    total = max(seen, 1)
    a = np.array([chars, links, runs, size, punct, words, depth, before, place, of, alike], dtype=np.float64)
    pi = np.maximum(parent, 0)
    out = np.zeros((n, N_FEATURES), dtype=np.float32)
    t = np.array(tag)
    has = t >= 0
    out[np.flatnonzero(has), t[has]] = 1
    bits = lambda m, k: (np.array(m)[:, None] >> np.arange(k)) & 1
    at = N_TAG
    out[:, at : at + N_GROUP] = bits(own, N_GROUP)
    at += N_GROUP
    out[:, at : at + N_GROUP] = bits(above_token, N_GROUP)
    at += N_GROUP
    out[:, at : at + N_TAG] = bits(above_tag, N_TAG)
    at += N_TAG
    c, l, r, s, pu, w, d, b, pl, o, al = a
    own_bits = np.array(own)
    siblings = (c[pi] - c) / np.maximum(o - 1, 1)
    rest = [
        np.log1p(c), l / np.maximum(c, 1), np.log1p(c / s), pu / np.maximum(w, 1), np.log1p(w / np.maximum(r, 1)), c / total, b / total, d,
        pl / o, np.log1p(o), al / o, np.log1p(s), np.log1p(siblings), l[pi] / np.maximum(c[pi], 1), np.log1p(c[pi] / s[pi]),
        (own_bits >> N_GROUP) & 1, (np.array(above_token) >> N_GROUP) & 1, np.log1p(r),
    ]
    out[:, at:] = np.stack(rest, axis=1)
    return out, parent


class BoostedTrees:
    """Depth-limited regression trees on binned features, boosted on logistic loss with second-order gains."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, k = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(k)]
        b = self._binned(x)
        self.bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score = np.full(n, self.bias)
        inner = (1 << self.depth) - 1
        self.feature = np.zeros((self.trees, inner), dtype=np.int64)
        self.cut = np.full((self.trees, inner), 255, dtype=np.uint8)
        self.value = np.zeros((self.trees, inner + 1))
        offset = np.arange(k) * self.bins
        flat = b.astype(np.int64) + offset
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, dtype=np.int64)
            for level in range(self.depth):
                first, many = (1 << level) - 1, 1 << level
                at = (node[:, None] * (k * self.bins) + flat).ravel()
                gs = np.bincount(at, np.repeat(g, k), many * k * self.bins).reshape(many, k, self.bins).cumsum(axis=2)
                hs = np.bincount(at, np.repeat(h, k), many * k * self.bins).reshape(many, k, self.bins).cumsum(axis=2)
                ga, ha = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + self.l2) + (ga - gs) ** 2 / (ha - hs + self.l2) - ga**2 / (ha + self.l2)
                gain[:, :, -1] = 0
                best = gain.reshape(many, -1).argmax(axis=1)
                ok = gain.reshape(many, -1)[np.arange(many), best] > 1e-6
                self.feature[t, first : first + many] = best // self.bins
                self.cut[t, first : first + many] = np.where(ok, best % self.bins, 255)
                node = node * 2 + (b[np.arange(n), self.feature[t, first + node]] > self.cut[t, first + node])
            gs, hs = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
            self.value[t] = -self.rate * gs / (hs + self.l2)
            score += self.value[t][node]
        return self

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, bias=self.bias, feature=self.feature, cut=self.cut, value=self.value, cuts=np.concatenate(self.cuts), sizes=[len(c) for c in self.cuts])
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> BoostedTrees:
        with np.load(io.BytesIO(raw)) as z:
            trees, inner = z["feature"].shape
            out = cls(trees, (inner + 1).bit_length() - 1)
            out.bias, out.feature, out.cut, out.value = float(z["bias"]), z["feature"], z["cut"], z["value"]
            out.cuts = np.split(z["cuts"], np.cumsum(z["sizes"])[:-1])
        return out

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1).astype(np.uint8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        rows, score = np.arange(len(b)), np.full(len(b), self.bias)
        for t in range(self.trees):
            node = np.zeros(len(b), dtype=np.int64)
            for level in range(self.depth):
                k = (1 << level) - 1 + node
                node = node * 2 + (b[rows, self.feature[t][k]] > self.cut[t][k])
            score += self.value[t][node]
        return score


def decode(logit: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """The most likely choice of kept nodes in which every kept node's parent is kept."""
    keep, drop = (-np.logaddexp(0, -logit)).tolist(), (-np.logaddexp(0, logit)).tolist()
    up = parent.tolist()
    n = len(up)
    best = [False] * n
    kept, dropped = keep[:], drop[:]  # of whole subtrees: this node kept and the best below, or all dropped
    for i in range(n - 1, -1, -1):
        best[i] = kept[i] >= dropped[i]
        p = up[i]
        if p >= 0:
            kept[p] += kept[i] if best[i] else dropped[i]
            dropped[p] += dropped[i]
    for i in range(n):
        if up[i] >= 0 and not best[up[i]]:
            best[i] = False
    return np.array(best, dtype=bool)


def extract(pages: list[str | None], model: BoostedTrees) -> list[str]:
    """Main text of each page: its blocks in page order, joined by a blank line."""
    trees = [page_nodes(parse(h)) for h in pages]
    if not trees:
        return []
    got = [features(t) for t in trees]
    logit = model.logit(np.concatenate([x for x, _ in got]))
    out, at = [], 0
    for nodes, (x, parent) in zip(trees, got, strict=True):
        chosen = decode(logit[at : at + len(x)], parent)
        at += len(x)
        out.append("\n\n".join(n.text for n, ok in zip(nodes, chosen.tolist(), strict=True) if ok and n.tag == "#text"))
    return out


def page_maker(seed: int) -> tuple[str, list[str]]:
    """A page of made-up words with its main-text blocks, in one of many layouts."""
    r = random.Random(seed)
    syllables = [a + b for a in "b c d f g l m n p r s t v th st er an".split() for b in "a e i o u en ar is on".split()]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    phrase = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    junk = r.choice(["", "", "", "### ", "*** ", "!! ", " | "])

    def prose(a: int, b: int) -> str:
        n, out = r.choice([r.randint(a, b), r.randint(a, b), r.randint(1, 4)]), []
        while n > 0:
            k = min(n, r.randint(1, 14))
            out.append(phrase(k, k).capitalize() + r.choice([".", ".", ".", ",", "!", "?"]) + junk.rstrip() * (junk != ""))
            n -= k
        return " ".join(out)

    main: list[str] = []

    def keep(text: str) -> str:
        main.append(text)
        return text

    pick = lambda *names: r.choice(names)
    lead = r.choice(["", "", "site-", "page-", "js-"])

    def box(tags: str, names: str, inner: str, bare: float = 0.3) -> str:
        tag = pick(*tags.split())
        name = lead * (r.random() < 0.3) + pick(*names.split())
        how = r.random()
        semantic = tag not in ("div", "section", "ul", "ol", "p")
        attrs = "" if semantic and how < bare else f' class="{name}"' if how < 0.75 else f' id="{name}"' if how < 0.9 else f' class="{word()} {name}" id="{word()}"'
        return f"<{tag}{attrs}>{inner}</{tag}>"

    link = lambda t: f'<a href="/{word()}">{t}</a>'
    menu = lambda: "<ul>" + "".join(f"<li>{link(phrase(1, 2))}</li>" for _ in range(r.randint(2, 9))) + "</ul>"
    nav = lambda: box("nav nav div ul", "nav menu navbar navigation main-menu breadcrumbs topnav", menu())
    ad = lambda: box("div div section aside ins", "ad ads advert advertisement sponsored promo ad-slot adsense banner-ad", pick(prose(2, 30), link(phrase(2, 9)), f"<p>{prose(3, 20)}</p>"), 0)
    note = lambda: box("div div section dialog", "cookie-banner cookie-consent notice consent gdpr popup modal alert notification privacy-notice", f"<p>{prose(4, 40)}</p><button>{phrase(1, 2)}</button>" if r.random() < 0.6 else prose(3, 30), 0)
    form = lambda: pick(f'<form action="/{word()}">' + f"<label>{phrase(1, 3)}</label><input name=q><button>{phrase(1, 2)}</button>" + f"<p>{prose(2, 20)}</p>" * r.randint(0, 1) + "</form>", box("div section form", "newsletter subscribe signup login search searchbox", f"<p>{prose(3, 25)}</p><form><input><button>{word()}</button></form>", 0))
    side = lambda: box("aside aside div div section", "sidebar side-bar related widget trending recommended right-rail popular", f"<h3>{phrase(1, 4)}</h3>" + pick(menu(), f"<p>{prose(4, 40)}</p>" * 1, "".join(f"<div>{link(phrase(3, 9))}<p>{prose(4, 20)}</p></div>" for _ in range(r.randint(1, 4)))))
    said = lambda: pick(f'<li class="{pick("comment", "reply", "item")}"><b>{word()}</b><p>{prose(3, 40)}</p></li>', f'<div class="{pick("comment", "comment-body", "reply", "post")}"><p>{prose(3, 50)}</p></div>', f"<article><header>{word()}</header><p>{prose(3, 50)}</p></article>", f"<p>{prose(3, 50)}</p>")
    talk = lambda: box("section div div ol ul", "comments comment-list reader-comments discussion disqus respond comments-area", f"<h2>{phrase(1, 3)}</h2>" + "".join(said() for _ in range(r.randint(1, 6))), 0)
    share = lambda: box("div ul p", "share social share-buttons social-links follow", "".join(link(word()) for _ in range(r.randint(2, 5))), 0)

    def para() -> str:
        text = keep(prose(4, 140))
        if r.random() < 0.3 and " " in text:
            a, b = text.split(" ", 1)
            return "<p>" + pick(f"<b>{a}</b> {b}", f"{link(a)} {b}", f"<b>{a} {b}<br>", f"{a}<br>{b}", f"<em>{a}</em> {b}") + ("</p>" if r.random() < 0.8 else "")
        return f"<p>{text}</p>" if r.random() < 0.92 else f"<p>{text}"

    def block() -> str:
        how = r.random()
        if how < 0.72:
            return para()
        if how < 0.8:
            return (h := pick("h2", "h3")) and f"<{h}>{keep(phrase(1, 7))}</{h}>"
        if how < 0.86:
            t = pick("ul", "ol")
            return f"<{t}>" + "".join(f"<li>{keep(prose(2, 18))}</li>" for _ in range(r.randint(1, 5))) + f"</{t}>"
        if how < 0.9:
            return f"<blockquote>{para()}</blockquote>" if r.random() < 0.5 else f"<blockquote>{keep(prose(4, 40))}</blockquote>"
        if how < 0.94:
            return f"<figure><img src=x><figcaption>{keep(prose(2, 14))}</figcaption></figure>"
        if how < 0.97:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{keep(phrase(1, 3))}</td>" for _ in range(2)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>"
        return f"<div>{keep(prose(4, 60))}</div>"

    inside = []
    if r.random() < 0.85:
        inside.append(f"<h1>{keep(phrase(1, 12))}</h1>")
    for _ in range(pick(0 if inside else 1, 1, 2, 3, 5, 8, 13)):
        inside.append(block())
        if r.random() < 0.08:
            inside.append(pick(ad, ad, share, form, side, note)())
    if r.random() < 0.15:
        inside.append(talk())
    body = "".join(inside)
    if r.random() < 0.25:
        body = f'<div class="{pick("text", "entry-content", "post-content", "article-body", word())}">{body}</div>'
    article = box("article article article main div div section", "article content post entry main-content story article-body entry-content main", body, 0.6)
    if r.random() < 0.3:
        article = pick("<main>{}</main>", '<div id="content">{}</div>', '<div class="container">{}</div>', '<div class="wrap"><div>{}</div></div>').format(article)
    some = lambda p, f: f() if r.random() < p else ""
    head = some(0.5, lambda: box("header div", "header masthead topbar site-header banner branding", pick(f"<h1>{phrase(1, 3)}</h1>", f"<h2>{phrase(1, 3)}</h2>", link(phrase(1, 3))) + some(0.4, lambda: f"<p>{prose(2, 12)}</p>") + some(0.4, nav)))
    foot = some(0.9, lambda: box("footer footer footer div", "footer site-footer foot colophon copyright", pick(f"&copy; {word()}.example &middot; {prose(2, 20)}", f"<p>&copy; {phrase(1, 6)}</p>" + menu(), f"<p>{prose(3, 40)}</p><p>{link(phrase(1, 3))}</p>")))
    around = [some(0.9, nav), some(0.5, ad), some(0.25, note), some(0.2, form)]
    r.shuffle(around)
    after = [some(0.3, side), some(0.25, talk), some(0.15, ad), some(0.15, form), some(0.1, share), some(0.15, note)]
    r.shuffle(after)
    page = f"<!DOCTYPE html><html><head><title>{phrase(2, 6)}</title><style>p{{}}</style><script>var a=\"</p>\";</script></head><body>{head}{''.join(around)}<!-- {word()} -->"
    page += article + "".join(after) + foot
    return page + "</body></html>" * (r.random() < 0.9), main


def labelled(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of a made page's nodes, and whether main text is in each."""
    html, main = page_maker(seed)
    nodes = page_nodes(parse(html))
    x, parent = features(nodes)
    y = np.zeros(len(nodes))
    want = iter([" ".join(m.split()) for m in main])
    now = next(want, None)
    for i, n in enumerate(nodes):
        if n.tag == "#text" and now is not None and n.text == now:
            y[i] = 1
            now = next(want, None)
    for i in range(len(nodes) - 1, 0, -1):
        if y[i]:
            y[parent[i]] = 1
    return x, y


@cache
def trained(pages: int = 1000, seed: int = 1) -> BoostedTrees:
    """The model, fitted to ``pages`` made pages; the same on each call."""
    made = [labelled(seed * 1_000_000 + k) for k in range(pages)]
    return BoostedTrees().fit(np.concatenate([x for x, _ in made]), np.concatenate([y for _, y in made]))


@cache
def _kept(folder: str) -> BoostedTrees:
    """The model from the shared folder, fitted and written there by the first session that needs it."""
    code = hashlib.sha256(b"".join(Path(m).read_bytes() for m in (__file__, html_dom.__file__))).hexdigest()[:24]
    disk, at = fs.FileSystem.from_uri(folder)
    path = f"{at}/html-trees-{code}.npz"
    if disk.get_file_info(path).is_file:
        with disk.open_input_stream(path) as f:
            return BoostedTrees.load(f.read())
    model = trained()
    disk.create_dir(at)
    part = f"{path}.{uuid.uuid4().hex}"
    with disk.open_output_stream(part) as f:
        f.write(model.dump())
    disk.move(part, path)  # whole or not at all
    return model


def extract_pages(pages: DataFrame, html: str = "html", keep: list[str] | None = None, model: BoostedTrees | None = None) -> DataFrame:
    """Adds ``text``, the main text of each page, and ``n_chars``, its code points.

    Null or empty html, and pages without main text, give an empty text. Every row gives one row; input columns
    named like an output are dropped. One narrow pass without a shuffle; the trees (some 20 KB) go with the
    tasks, and a task holds the nodes of 64 pages at a time. Unless ``model`` is given, the trees are those that the first session
    fitted and left in the shared folder.
    """
    model = model or _kept(shared_dir(pages.sparkSession))
    kept = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars")]
    source = pages.select(*kept, pages[html].alias("__html"))
    fields = source.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = extract(part.column(part.num_columns - 1).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*(f.name for f in fields), "text", "n_chars"])

    return source.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["text string", "n_chars long"]))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``; see ``extract_pages`` for null, empty and damaged html and repeated rows."""
    return extract_pages(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
