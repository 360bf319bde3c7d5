"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the page.

A block's features are the tags, the words of class, id and role and the kinds that such words stand for, of all elements that it is in; its own tag, and its text's length, link
share, punctuation and signs; neighbours are tied by weights that depend on whether they share an element. Weights are fitted
to the exact likelihood (forward and backward sums) on labelled pages; decoding is Viterbi. The blocks labelled as main text,
in page order and joined by blanks, are the text.

Labelled pages: at most SAMPLE pages, those with the least hash of their id (the documented bound). A page that marks its
article or main part is labelled by its own markup. Of each such page's blocks further pages are laid out in LAYOUTS other
ways, with the menus, notices, adverts, forms, comments and so on that pages have, under the tags and names in use for them; so
the model also knows parts that the pages at hand lack. Where no page is marked, layouts are filled with plain words.

White space, that of Unicode included, is one blank. Null and empty pages, and those without text, give an empty text. Repeated
rows give equal texts; other columns stay. A page of any length or nesting is read whole, in time in proportion to it.
An empty table gives an empty result. If the table has a column of an added name, the new one gets an underscore more.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import fresh, small_batches
from tallyforge.llm.page_blocks import NAMES_OF, Element, blocks

SAMPLE, LAYOUTS = 200, 5
STEPS, RATE, L2 = 200, 0.3, 0.005
#: Longest page that is used for learning, in blocks.
MOST_BLOCKS = 400
#: Kinds of neighbours: in the same element, in sibling elements, in others.
KINDS = 3

#: Parts of pages that aren't main text: tags in use for them, and what fills them. NAMES_OF has words of their class or id.
PARTS = {
    "menu": (("nav", "ul", "div", "menu"), "links"),
    "header": (("header", "div"), "short"),
    "footer": (("footer", "div"), "small"),
    "sidebar": (("aside", "div", "section"), "mixed"),
    "notice": (("div", "section", "aside", "dialog"), "prose"),
    "advert": (("div", "aside", "section", "div"), "prose"),
    "form": (("form", "div", "fieldset"), "form"),
    "comments": (("section", "div", "ol", "aside"), "comments"),
    "share": (("div", "ul"), "links"),
}
#: Names of what holds the main text, and of what holds everything.
MAIN, AROUND = "content post entry story article body text main page single prose", "wrapper container page site content main layout row col inner root app"
#: Elements whose blocks aren't main text even inside an article, and names that say so of a page's own elements.
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button"}
OUTSIDE = {f"kind {kind}" for kind in PARTS}


def text_features(text: str, linked: int, e: Element) -> list[str]:
    """What a block's text, own tag and nearest telling element say."""
    tag, n = e.tag, text.count(" ") + 1
    length = f"{min(n.bit_length(), 8)}"
    share = min(4, 4 * linked // len(text)) if linked else 0
    end = text[-1]
    stops = sum(map(text.count, ".,;:!?"))
    out = ["bias", f"tag {tag}", f"length {length}", f"links {share}", f"tag {tag} length {length}", f"tag {tag} links {share}", "ends well" if end in ".!?\"'”»…" else "ends else"]
    out.append(f"stops {min(4, 10 * stops // n)}")
    if n > 20 and not share:
        out.append("long prose")
    out += [f"sign {c}" for c in "©|·»@" if c in text]
    return out + e.near


def element_features(e: Element) -> list[str]:
    """The features of an element and of all that it is in."""
    out = []
    while e is not None:
        out += e.features
        e = e.up
    return out


def kind_of_pair(a: Element, b: Element) -> int:
    return 0 if a is b else 1 if a.up is b.up else 2


@dataclass
class Field:
    """Weights of the label 'main text' by feature, and of pairs of labels by the kind of neighbours: [kind][label][next label]."""

    weights: dict[str, float]
    pairs: list

    def labels(self, page: list[tuple[str, int, Element]]) -> list[int]:
        """The likeliest labels of a page's blocks (Viterbi); 1 is main text."""
        weight, best, back, before = self.weights.get, None, [], None
        for text, linked, e in page:
            own = sum(weight(f, 0.0) for f in text_features(text, linked, e)) + self.of_element(e)
            if best is None:
                best = (0.0, own)
            else:
                p = self.pairs[kind_of_pair(before, e)]
                stay, leave = best[0] + p[0][0], best[1] + p[1][0]
                enter, go_on = best[0] + p[0][1], best[1] + p[1][1]
                back.append((int(leave > stay), int(go_on >= enter)))
                best = (max(stay, leave), max(enter, go_on) + own)
            before = e
        if best is None:
            return []
        out = [int(best[1] > best[0])]
        for b in reversed(back):
            out.append(b[out[-1]])
        return out[::-1]

    def of_element(self, e: Element) -> float:
        """The weight of an element's features and of those it is in, summed once for each element."""
        todo = []
        while e.total is None:
            todo.append(e)
            if e.up is None:
                break
            e = e.up
        total = e.total or 0.0
        for x in reversed(todo):
            total += sum(self.weights.get(f, 0.0) for f in x.features)
            x.total = total
        return total

    def text(self, page: str | None) -> str:
        found = blocks(page)
        return " ".join(b[0] for b, main in zip(found, self.labels(found), strict=True) if main)


def fit(pages: list[tuple[list[tuple[str, int, Element]], list[int]]]) -> Field:
    """The weights of least penalised loss on pages of (blocks, labels): gradient steps with rates by feature over all pages at
    once, each with the exact expected counts from forward and backward sums."""
    names: dict[str, int] = {}
    rows, cols, y, owner, kind = [], [], [], [], []
    for k, (page, labels) in enumerate(pages):
        for i, ((text, linked, e), label) in enumerate(zip(page, labels, strict=True)):
            for f in text_features(text, linked, e) + element_features(e):
                rows.append(len(y))
                cols.append(names.setdefault(f, len(names)))
            kind.append(kind_of_pair(page[i - 1][2], e) if i else KINDS)
            y.append(label)
            owner.append(k)
    rows, cols, y, owner, kind = (np.array(x, np.int64) for x in (rows, cols, y, owner, kind))
    start = np.r_[0, np.flatnonzero(np.diff(owner)) + 1]
    size = np.diff(np.r_[start, len(y)])
    order = np.argsort(-size, kind="stable")  # pages by falling length: those with a block i are the first ones
    start, size = start[order], size[order]
    alive = [int((size > i).sum()) for i in range(size[0])]
    w, pairs = np.zeros(len(names)), np.zeros((KINDS + 1, 2, 2))
    seen_w, seen_p = np.full(len(names), 1e-8), np.full(pairs.shape, 1e-8)
    true_pairs = np.zeros(pairs.shape)
    inner = np.flatnonzero(kind < KINDS)
    np.add.at(true_pairs, (kind[inner], y[inner - 1], y[inner]), 1)
    for _ in range(STEPS):
        own = np.zeros((len(y), 2))
        own[:, 1] = np.bincount(rows, w[cols], len(y))
        fore, back = own.copy(), np.zeros((len(y), 2))
        for i in range(1, len(alive)):
            at = start[: alive[i]] + i
            fore[at] += np.logaddexp.reduce(fore[at - 1][:, :, None] + pairs[kind[at]], axis=1)
        for i in range(len(alive) - 1, 0, -1):
            at = start[: alive[i]] + i
            back[at - 1] = np.logaddexp.reduce(pairs[kind[at]] + (own[at] + back[at])[:, None, :], axis=2)
        whole = fore + back
        one = np.exp(whole[:, 1] - np.logaddexp(whole[:, 0], whole[:, 1]))
        both = fore[inner - 1][:, :, None] + pairs[kind[inner]] + (own[inner] + back[inner])[:, None, :]
        both = np.exp(both - np.logaddexp.reduce(both.reshape(-1, 4), axis=1)[:, None, None])
        expected = np.zeros(pairs.shape)
        np.add.at(expected, kind[inner], both)
        for value, slope, seen in ((w, np.bincount(cols, (one - y)[rows], len(w)) + L2 * w, seen_w), (pairs, expected - true_pairs + L2 * pairs, seen_p)):
            seen += slope * slope
            value -= RATE * slope / np.sqrt(seen)
    return Field({f: float(w[i]) for f, i in names.items()}, pairs[:KINDS].tolist())


def own_labels(page: list[tuple[str, int, Element]]) -> list[int] | None:
    """Labels by a page's own markup: what is inside its article or main element and not in a part beside it; None where the
    page marks neither."""
    out, marked = [], False
    for _, _, e in page:
        inside = False
        title = e.tag in ("h1", "h2")
        while e is not None:
            if (e.tag in ASIDE and not (title and e.tag == "header")) or OUTSIDE.intersection(e.features):
                inside = False
                break
            inside = inside or e.tag in ("article", "main")
            e = e.up
        marked = marked or inside
        out.append(int(inside))
    return out if marked else None


class Layout:
    """Pages laid out from given texts; MARK stands before each block of main text."""

    MARK = "\ue000"

    def __init__(self, seed: str, stock: list[str]):
        self.r, self.stock = random.Random(seed), stock

    def named(self, tag: str, names: str, inner: str, bare: bool = False) -> str:
        """An element with some of the names as class or id, in one of the usual spellings."""
        words = self.r.sample(names.split(), self.r.choice([1, 1, 2]))
        if self.r.random() < 0.3:
            words.append(self.r.choice(["box", "block", "area", "list", "item", "wrap"]))
        name = self.r.choice(["-", "_", " ", " "]).join(words) if self.r.random() < 0.8 else words[0] + "".join(w.title() for w in words[1:])
        where = self.r.choice(["class", "class", "id"])
        return f"<{tag}>{inner}</{tag}>" if bare else f'<{tag} {where}="{name}">{inner}</{tag}>'

    def prose(self, least: int = 1) -> str:
        return " ".join(self.r.choice(self.stock) for _ in range(self.r.choice([least, least, 2, 3])))

    def short(self) -> str:
        words = self.r.choice(self.stock).split()
        at = self.r.randrange(len(words))
        return " ".join(words[at : at + self.r.choice([1, 1, 2, 3, 5])])

    def fill(self, what: str) -> str:
        r = self.r
        links = "".join(self.named("li", "item link", f'<a href="/x">{self.short()}</a>', bare=r.random() < 0.7) for _ in range(r.randint(2, 7)))
        if what == "links":
            return r.choice([f"<ul>{links}</ul>", links, " ".join(f'<a href="#">{self.short()}</a>' for _ in range(4))])
        if what == "short":
            return r.choice([f"<h1>{self.short()}</h1>", f"<div>{self.short()}</div>", f'<a href="/">{self.short()}</a>', f"<p>{self.short()}</p>"])
        if what == "small":
            return r.choice(["", f"<ul>{links}</ul>"]) + r.choice([f"&copy; {self.short()} &middot; {self.prose()}", f"<p>{self.prose()}</p>", f"<div>{self.short()} | {self.short()}</div>"])
        if what == "mixed":
            return r.choice(["", f"<h3>{self.short()}</h3>"]) + r.choice([f"<ul>{links}</ul>", f"<p>{self.prose()}</p>", f"<div>{self.prose()}</div><p>{self.short()}</p>"])
        if what == "prose":
            return r.choice([self.prose(), f"<p>{self.prose()}</p>", f"<span>{self.short()}</span> {self.prose()}", f"<p>{self.prose()}</p><button>{self.short()}</button>"])
        if what == "form":
            return f'<label>{self.short()}</label><input type="text">' + r.choice(["", f"<p>{self.prose()}</p>"]) + f"<button>{self.short()}</button>"
        told = [f"<p>{self.prose()}</p>" if r.random() < 0.7 else self.prose() for _ in range(r.randint(1, 4))]
        tag = r.choice(["div", "li", "article", "div"])
        return r.choice(["", f"<h2>{self.short()}</h2>"]) + "".join(self.named(tag, "comment reply response review", f"<b>{self.short()}</b> {x}", bare=r.random() < 0.3) for x in told)

    def part(self, kind: str) -> str:
        tags, what = PARTS[kind]
        tag = self.r.choice(tags)
        return self.named(tag, NAMES_OF[kind], self.fill(what), bare=tag in ("nav", "header", "footer", "aside", "form") and self.r.random() < 0.5)

    def page(self, texts: list[str]) -> str:
        r, main = self.r, []
        for k, t in enumerate(texts):
            text = self.MARK + t.replace("&", "&amp;").replace("<", "&lt;")
            tag = "h1" if k == 0 and r.random() < 0.7 else r.choice(["p"] * 12 + ["h2", "h3", "div", "div", "blockquote", "ul", "table", "figure", "pre", "section"])
            inner = {"ul": f"<li>{text}</li>", "table": f"<tr><td>{text}</td></tr>", "figure": f"<figcaption>{text}</figcaption>", "section": f"<p>{text}</p>"}.get(tag, text)
            main.append(r.choice(["<p>" + text, f"<p><b>{text}<br>"]) if tag == "p" and r.random() < 0.3 else f"<{tag}>{inner}</{tag}>")
            if tag == "h1" and r.random() < 0.2:
                main[-1] = f"<header>{main[-1]}</header>"
        alone = r.random() < 0.15
        for kind in r.sample(["advert", "notice", "share", "form", "sidebar"], 0 if alone else r.choice([0, 1, 2, 3])):
            main.insert(r.randrange(1, len(main) + 1), self.part(kind))
        if not alone and r.random() < 0.25:
            main.append(self.part("comments"))
        body, wrap = "".join(main), r.random()
        if alone and wrap < 0.2:
            return self.MARK + " ".join(texts).replace("&", "&amp;").replace("<", "&lt;")
        if wrap < 0.9:
            body = f"<article>{body}</article>" if wrap < 0.3 else f"<main>{body}</main>" if wrap < 0.4 else self.named(r.choice(["div", "div", "section", "article"]), MAIN, body)
        if r.random() < 0.3:
            body = r.choice([f"<main>{body}</main>", f"<article>{body}</article>", self.named("div", MAIN, body)])
        before = [self.part(k) for k in r.sample(["menu", "header", "notice", "advert", "form", "sidebar"], 0 if alone else r.randint(1, 4))]
        after = [self.part(k) for k in r.sample(["footer", "comments", "sidebar", "share", "notice", "advert", "form"], 0 if alone else r.randint(1, 4))]
        whole = "".join([*before, body, *after])
        whole = self.named("div", AROUND, whole) if r.random() < 0.5 else whole
        return f"<html><body>{whole}</body></html>" if r.random() < 0.5 else whole

    def labelled(self, texts: list[str]) -> tuple[list[tuple[str, int, Element]], list[int]]:
        found = blocks(self.page(texts))
        labels = [int(text.startswith(self.MARK)) for text, _, _ in found]
        return [(text.replace(self.MARK, "").strip() or "-", linked, e) for text, linked, e in found], labels


def labelled_pages(pages: list[str | None]) -> list[tuple[list[tuple[str, int, Element]], list[int]]]:
    """Pages labelled by their own markup, and layouts of the same texts."""
    out, stories, stock = [], [], []
    for page in pages:
        found = blocks(page)[:MOST_BLOCKS]
        labels = own_labels(found)
        if labels:
            out.append((found, labels))
            stories.append([b[0] for b, main in zip(found, labels, strict=True) if main])
        stock += [b[0] for b in found[:40]]
    if not stock:
        stock = [f"Some words, {w} and others; a text number {k}." for k, w in enumerate("one two three four five six seven eight".split())]
    stories = stories or [[s, *stock[k : k + 6]] for k, s in enumerate(stock[:SAMPLE])]
    for k, story in enumerate(stories):
        out += [Layout(f"{k} {n}", stock).labelled(story[: MOST_BLOCKS // 4]) for n in range(LAYOUTS)]
    return out


def train(pages: DataFrame, key: str = "page_id", html: str = "html") -> Field:
    """The field from the labelled pages. Ids are chosen first, so that only the chosen rows' pages are read."""
    ids = pages.where(F.col(key).isNotNull()).select(key).orderBy(F.xxhash64(key), key).limit(SAMPLE)
    chosen = [r[0] for r in ids.collect()]
    rows = pages.where(F.col(key).isin(chosen)).select(key, html).orderBy(F.xxhash64(key), key, html).limit(2 * SAMPLE).collect()
    return fit(labelled_pages([r[1] for r in rows]))


def extract(pages: DataFrame, field: Field, html: str = "html", text: str = "text") -> DataFrame:
    """pages without the html, with the main text and, last, its length in code points."""
    small_batches(pages.sparkSession)
    at = pages.columns.index(html)
    rest = [f for k, f in enumerate(pages.schema.fields) if k != at]
    names = [fresh(pages, text), fresh(pages, "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [field.text(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([c for k, c in enumerate(batch.columns) if k != at] + [pa.array(got, pa.string()), pa.array([len(x) for x in got], pa.int64())], names=[*(f.name for f in rest), *names])

    return pages.mapInArrow(run, T.StructType([*rest, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.LongType())]))
