"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text between the borders of block elements, each with its open
elements, their class and id words, its links and its wording. A chain of two labels, article or other,
scores blocks by these features and by the label before; its weights are trained by maximum likelihood on
labelled pages (made ones, in the layouts of the web at large, seeded and without words of any language),
and decoding is Viterbi's. Scripts, styles and markup are no text to begin with.

A page is a row of its own: no row moves between tasks, and memory is bounded by the longest page.

Defined results: null and empty pages have the empty text; text outside any element is a block; elements
left open are closed by what follows them or at the end; rows that repeat are read each; an empty table
gives no rows; further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's elements without content, those whose content is no text, and those that border a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "object", "textarea", "title", "math", "canvas")
FOREIGN = ("svg", "math")  # of those the ones that a slash closes
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Words in class and id attributes, by what they tell.
HINTS = {
    "nav": "nav menu breadcrumb breadcrumbs pagination pager toc tabs navbar skip", "head": "header masthead banner topbar logo branding", "foot": "footer foot copyright legal colophon",
    "side": "sidebar aside widget related recommended trending popular more recirc", "note": "cookie consent notice alert gdpr popup modal newsletter subscribe signup paywall promo",
    "ad": "ad ads advert adverts advertisement sponsor sponsored banner-ad dfp promo teaser", "form": "form search login register", "talk": "comment comments reply replies disqus discussion respond thread",
    "share": "share social follow tweet facebook meta byline author tags", "main": "article content main post entry story body text page prose",
}
_HINT_OF = {w: k for k, ws in HINTS.items() for w in ws.split()}

# A tag is its name and then attributes: blanks and slashes between names, each with a value that is quoted, or else goes on to a blank or the end of the tag.
_VALUE = r"""(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+{_VALUE}?+)?+|=)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}
_PART = re.compile(r"[a-z]+")


# Elements that hide an open paragraph from what comes inside them.
P_SCOPE = frozenset("html body table td th caption button object marquee".split())
#: Elements that features tell by name; others count as elements of no name, so that invented names cost no memory.
NAMED = frozenset("a article aside blockquote body button dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header label li main nav ol option p pre section select summary table tbody td th thead tr ul".split())


#: Elements that stand for themselves: hints from around them are not the nearest ones.
SECTIONS = frozenset("article aside body footer form header main nav section".split())


class Open:
    """An open element. What its ancestors say is kept as sets that are shared where nothing is new, so depth costs no copies."""

    __slots__ = ("tag", "up", "tags", "hints", "near", "outer")

    def __init__(self, tag: str, own: tuple[str, ...], up: Open | None) -> None:
        self.tag, self.up = tag, up
        tags, hints = (up.tags, up.hints) if up else (frozenset(), frozenset())
        self.tags = tags if tag in tags or tag not in NAMED else tags | {tag}
        self.hints = hints if hints.issuperset(own) else hints.union(own)
        self.near = own or (up.near if up and tag not in SECTIONS else ())
        self.outer = (up.outer if up else "") if tag in INLINE else tag if tag in NAMED else "other"


@dataclass
class Block:
    text: str
    at: Open | None  # the innermost open element
    linked: int  # characters inside links


def _hints(attributes: str) -> tuple[str, ...]:
    found = set()
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        if (name := name.lower()) == "hidden" or name == "style" and "none" in (a or b or c):
            found.add("hidden")
        elif name != "style":
            for name in (a or b or c).lower().split():
                words = _PART.findall(name)
                found.update(_HINT_OF[w] for w in (*words, "".join(words)) if w in _HINT_OF)
    return tuple(sorted(found))


class _Reader:
    """Reads one page into blocks; how often each element is open is counted, so that no close searches the stack in vain."""

    def __init__(self) -> None:
        self.out: list[Block] = []
        self.parts: list[str] = []
        self.top: Open | None = None
        self.open: Counter[str] = Counter()
        self.linked = 0

    def text(self, s: str) -> None:
        if s:
            self.parts.append(s)
            if self.open["a"]:
                self.linked += len(s.strip())

    def border(self) -> None:
        if self.parts:
            if joined := " ".join(entities.unescape("".join(self.parts)).split()):
                self.out.append(Block(joined, self.top, self.linked))
            self.parts.clear()
        self.linked = 0

    def pop(self, tag: str) -> None:
        """Close the innermost element of the name, with all that is open in it."""
        while self.top:
            was, self.top = self.top.tag, self.top.up
            self.open[was] -= 1
            if was == tag:
                break

    def close_paragraph(self) -> None:
        at = self.top if self.open["p"] else None
        while at and at.tag not in P_SCOPE:
            if at.tag == "p":
                self.pop("p")
                return
            at = at.up

    def start(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self.border()
            if tag in CLOSES_P:
                self.close_paragraph()
            if self.top and tag in ("li", "td", "tr", "option", "dt", "dd") and self.top.tag == tag:
                self.pop(tag)
        if tag not in VOID and not attributes.endswith("/"):
            self.top = Open(tag, _hints(attributes) if attributes else (), self.top)
            self.open[tag] += 1

    def end(self, tag: str) -> None:
        if tag not in INLINE:
            self.border()
        if self.open[tag]:
            self.pop(tag)

    def read(self, page: str) -> list[Block]:
        at, n, find = 0, len(page), _TOKEN.search
        while at < n:
            if not (m := find(page, at)):
                self.text(page[at:])
                break
            self.text(page[at : m.start()])
            at = m.end()
            if not (tag := m[2]):
                continue
            tag = tag.lower()
            if tag == "br":
                self.parts.append(" ")
            elif m[1]:
                self.end(tag)
            elif tag in _RAW_END:
                if tag not in INLINE and tag not in FOREIGN:
                    self.border()
                if not (tag in FOREIGN and m[3].endswith("/")):
                    end = _RAW_END[tag].search(page, at)
                    at = end.end() if end else n
            else:
                self.start(tag, m[3])
        self.border()
        return self.out


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order, with white space collapsed and character references decoded."""
    return _Reader().read(page or "")


def features(own: list[Block]) -> list[list[str]]:
    """For each block the names of its features: ancestors, hints, links, wording and place."""
    out = []
    for i, b in enumerate(own):
        tags, hints, near, outer = (b.at.tags, b.at.hints, b.at.near, b.at.outer) if b.at else (frozenset(), frozenset(), (), "")
        n, words = len(b.text), b.text.count(" ") + 1
        share = b.linked / n
        f = ["one", f"tag={outer}", f"size={min(7, n.bit_length() - 3 if n > 7 else 0)}", f"links={0 if not share else 1 if share < 0.3 else 2 if share < 0.8 else 3}"]
        f += [f"in={t}" for t in tags if t not in INLINE or t == "a"]
        f += [f"hint={h}" for h in hints]
        f += [f"near={h}" for h in near]
        f += [f"hint={h}&article" for h in hints if "article" in tags or "main" in tags]
        f.append("stop" if b.text[-1] in ".!?…。" else "nostop")
        if "article" in tags or "main" in tags:
            f.append(f"inner&{outer}")
        if words < 5:
            f.append("few")
        if "©" in b.text:
            f.append("copyright")
        if i == 0:
            f.append("first")
        if i == len(own) - 1:
            f.append("last")
        out.append(f)
    return out


@dataclass(frozen=True)
class Crf:
    names: dict[str, int]
    emit: np.ndarray  # [feature, label]
    move: np.ndarray  # [label before, label]

    def scores(self, fs: list[list[str]]) -> np.ndarray:
        return np.array([self.emit[[self.names[x] for x in f if x in self.names]].sum(axis=0) for f in fs]).reshape(-1, 2)

    def decode(self, fs: list[list[str]]) -> list[int]:
        """Viterbi's best labels; 1 is the article."""
        if not fs:
            return []
        e = self.scores(fs).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = e[0]
        back = []
        for x, y in e[1:]:
            from_a, from_b = a + m00 >= b + m10, a + m01 >= b + m11
            back.append((not from_a, not from_b))
            a, b = (a + m00 if from_a else b + m10) + x, (a + m01 if from_b else b + m11) + y
        label = int(b > a)
        path = [label]
        for choices in reversed(back):
            label = int(choices[label])
            path.append(label)
        return path[::-1]


def marginals(x: np.ndarray, inside: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of chains padded to one length: the log of the sum over all labellings, the probability of each label at each place, and the expected numbers of moves.

    ``x``: [chain, place, label] scores, zero where not ``inside``.
    """
    most = x.shape[1]
    log_sum = np.logaddexp.reduce
    forward, backward = np.zeros_like(x), np.zeros_like(x)
    forward[:, 0] = x[:, 0]
    for t in range(1, most):
        new = x[:, t] + log_sum(forward[:, t - 1, :, None] + move, axis=1)
        forward[:, t] = np.where(inside[:, t, None], new, forward[:, t - 1])
    for t in range(most - 2, -1, -1):
        new = log_sum(move + (x[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
        backward[:, t] = np.where(inside[:, t + 1, None], new, 0)
    z = log_sum(forward[:, -1], axis=1)
    p = np.exp(forward + backward - z[:, None, None])
    pairs = np.zeros((2, 2))
    for t in range(1, most):
        both = np.exp(forward[:, t - 1, :, None] + move + (x[:, t] + backward[:, t])[:, None, :] - z[:, None, None])
        pairs += both[inside[:, t]].sum(axis=0)
    return z, p, pairs


def fit(pages: list[tuple[list[list[str]], list[int]]], steps: int = 120, penalty: float = 0.02) -> Crf:
    """Maximum likelihood with an L2 penalty, by Adagrad on the exact gradient from forward and backward sums."""
    names = {x: i for i, x in enumerate(sorted({x for fs, _ in pages for f in fs for x in f}))}
    emit, move = np.zeros((len(names), 2)), np.zeros((2, 2))
    coded = [([np.array([names[x] for x in f]) for f in fs], np.array(labels)) for fs, labels in pages if fs]
    flat = np.concatenate([i for fs, _ in coded for i in fs])
    row = np.repeat(np.arange(sum(len(fs) for fs, _ in coded)), [len(i) for fs, _ in coded for i in fs])
    ends = np.cumsum([0, *(len(fs) for fs, _ in coded)])
    truth = np.concatenate([y for _, y in coded])
    length, most = np.diff(ends), int(np.diff(ends).max())
    place = np.full((len(coded), most), -1)
    for k, (a, n) in enumerate(zip(ends[:-1], length, strict=True)):
        place[k, :n] = np.arange(a, a + n)
    inside = place >= 0
    sums, move_sums = np.full_like(emit, 1e-8), np.full_like(move, 1e-8)
    pair_truth = np.zeros((2, 2))
    for _, y in coded:
        np.add.at(pair_truth, (y[:-1], y[1:]), 1)
    for _ in range(steps):
        e = np.zeros((int(ends[-1]), 2))
        np.add.at(e, row, emit[flat])
        _, p, pairs = marginals(np.where(inside[..., None], e[place], 0), inside, move)
        miss = np.zeros_like(e)
        miss[place[inside]] = p[inside]
        miss[np.arange(len(truth)), truth] -= 1
        grad = penalty * len(coded) / 10 * emit
        np.add.at(grad, flat, miss[row])
        move_grad = pairs - pair_truth
        sums += grad**2
        move_sums += move_grad**2
        emit -= 0.5 * grad / np.sqrt(sums)
        move -= 0.5 * move_grad / np.sqrt(move_sums)
    return Crf(names, emit, move)


class _Maker:
    """Labelled pages: an article in many layouts, amid the furniture of pages. Words are random letters."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, a: int, b: int, stop: bool = True) -> str:
        r = self.r
        s = " ".join("".join(r.choice("abdefghilmnoprstuvéüñ") for _ in range(r.randint(2, 9))) for _ in range(r.randint(a, b))).capitalize()
        if r.random() < 0.15:
            s = s.replace(" ", f"{r.choice([',', ';', ' &amp;', ' -'])} ")
        return s + (r.choice(".....!?") if stop and r.random() < 0.93 else "")

    def mark(self, kind: str) -> str:
        """An attribute with a hint of the kind, mostly."""
        r = self.r
        if r.random() < 0.25:
            return r.choice(["", f' class="{self.words(1, 1, False).lower()}"'])
        word = r.choice(HINTS[kind].split())
        return f' {r.choice(["class", "class", "id"])}="{r.choice(["", "", "site-", "page-", "c-"])}{word}{r.choice(["", "", "-box", "-list", " clearfix"])}"'

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{i}">{self.words(1, 4, False)}</a></li>' for i in range(n))

    def furniture(self, kind: str) -> str:
        r, w = self.r, self.words
        if kind == "nav":
            t = r.choice(["nav", "nav", "div", "ul"])
            inner = self.links(r.randint(2, 9))
            return f"<{t}{self.mark(kind)}>{inner if t == 'ul' else f'<ul>{inner}</ul>'}</{t}>"
        if kind == "head":
            return f"<header{self.mark(kind)}><{(h := r.choice(['h1', 'div', 'p', 'span']))}>{w(1, 5, False)}</{h}>{r.choice(['', f'<p>{w(3, 9)}</p>'])}</header>" if r.random() < 0.7 else f"<div{self.mark(kind)}><a href='/'>{w(1, 3, False)}</a> {w(0, 6)}</div>"
        if kind == "foot":
            t = r.choice(["footer", "footer", "footer", "div"])
            if r.random() < 0.3:
                return f"<{t}{self.mark(kind) if t == 'div' else ''}><p>{w(2, 12)}</p>{r.choice(['', f'<p>{w(2, 20)}</p>'])}</{t}>"
            return f"<{t}{self.mark(kind) if t == 'div' or r.random() < 0.4 else ''}>{r.choice(['&copy; ', '', '© 2020 '])}{w(1, 3, False)} {r.choice(['&middot; ', '| ', ''])}{w(0, 12)}{r.choice(['', f'<ul>{self.links(3)}</ul>', f'<p>{w(5, 20)}</p>'])}</{t}>"
        if kind == "side":
            t = r.choice(["aside", "aside", "div", "section"])
            return f"<{t}{self.mark(kind)}><{(h := r.choice(['h2', 'h3', 'h4']))}>{w(1, 4, False)}</{h}>{r.choice([f'<ul>{self.links(r.randint(2, 6))}</ul>', f'<p>{w(5, 30)}</p>', f'<p>{w(3, 9)}</p><ul>{self.links(3)}</ul>'])}</{t}>"
        if kind in ("note", "ad"):
            t = r.choice(["div", "div", "section", "aside", "p"])
            inner = w(3, 25) + r.choice(["", f' <a href="#">{w(1, 2, False)}</a>', f" <button>{w(1, 2, False)}</button>"])
            mark = self.mark(kind)
            return f"<{t}{mark or ' class=' + chr(34) + r.choice(HINTS[kind].split()) + chr(34)}>{inner if t == 'p' or r.random() < 0.5 else f'<p>{inner}</p>'}</{t}>"
        if kind == "form":
            return f'<form action="/x"{self.mark(kind)}><label>{w(1, 3, False)}</label><input name=q><select><option>{w(1, 1, False)}<option>{w(1, 1, False)}</select><button>{w(1, 2, False)}</button>{r.choice(["", f"<p>{w(4, 12)}</p>"])}</form>'
        if kind == "talk":
            each = "".join(f"<{(t := r.choice(['div', 'li', 'article']))} class={r.choice(['comment', 'reply', 'comment-body'])}><p>{w(1, 2, False)}</p><p>{w(4, 40)}</p></{t}>" for _ in range(r.randint(1, 4)))
            return f"<{(t := r.choice(['section', 'div', 'div']))}{self.mark(kind)}><h3>{w(1, 3, False)}</h3>{each}</{t}>"
        return f"<div{self.mark('share')}>{w(1, 4, False)} <a href='#'>{w(1, 1, False)}</a> <a href='#'>{w(1, 1, False)}</a></div>"

    def page(self) -> str:
        """HTML in which the article's text is marked with a leading sign that is no part of any word."""
        r, w, sign = self.r, self.words, "\x01"
        inner = [f"<h{(k := r.choice([1, 1, 1, 2]))}>{sign}{w(1, 12, r.random() < 0.5)}</h{k}>"] if r.random() < 0.75 else []
        for _ in range(r.choice([1, 2, 4, 8, 16])):
            x = r.random()
            if x < 0.7:
                text = w(*r.choice([(1, 2), (2, 8), (10, 40), (30, 120)]))
                if r.random() < 0.2 and " " in text:
                    a, _, b = text.partition(" ")
                    text = f"{a} {r.choice(['<a href=/y>', '<em>', '<b>'])}{b}" + r.choice(["</a></em></b>", "</b>"])
                if r.random() < 0.12:
                    inner.append(f"<p><b>{sign}{w(2, 20)}<br>")
                inner.append(f"<p{r.choice(['', '', self.mark('main')])}>{sign}{text}{r.choice(['</p>'] * 6 + [''])}")
            elif x < 0.73:
                inner.append(f"<pre>{sign}{w(2, 30, False)}</pre>")
            elif x < 0.8:
                inner.append(f"<h{(k := r.randint(2, 4))}>{sign}{w(1, 8, False)}</h{k}>")
            elif x < 0.86:
                inner.append("<ul>" + "".join(f"<li>{sign}{w(2, 20)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif x < 0.9:
                inner.append(f"<blockquote>{r.choice(['', '<p>'])}{sign}{w(5, 40)}</blockquote>")
            elif x < 0.92:
                inner.append(f"<table><tr><td>{sign}{w(1, 4, False)}<td>{sign}{w(1, 9)}</table>")
            else:
                inner.append(self.furniture(r.choice(["ad", "note", "side", "share", "form"])))
        body = "".join(inner)
        shape, plain = r.random(), r.choice(["", "", f' class="{w(1, 1, False).lower()}"'])
        if shape < 0.38:
            body = f"<article{r.choice(['', '', self.mark('main')])}>{body}</article>"
        elif shape < 0.52:
            body = f"<main{r.choice(['', '', plain, self.mark('main')])}>{body}</main>"
        elif shape < 0.66:
            body = f'<div class="{r.choice(HINTS["main"].split())}">{body}</div>'
        elif shape < 0.75:
            body = f"<main><article>{body}</article>{self.furniture('talk')}</main>"
        elif shape < 0.83:
            body = f"<section{r.choice([plain, self.mark('main')])}>{body}</section>"
        elif shape < 0.91:
            body = f"<div>{body}</div>"
        # Some pages are the article alone, some begin with it, some end with it.
        around = r.random()
        before = "".join(self.furniture(k) for k in ("note", "head", "nav", "form", "ad", "nav", "side") if r.random() < 0.5) if 0.2 < around < 0.93 else ""
        after = "".join(self.furniture(k) for k in ("share", "talk", "side", "ad", "form", "nav", "foot") if r.random() < 0.5) if around > 0.12 else ""
        if around < 0.03:
            return body if r.random() < 0.5 else f"{sign}{w(10, 80)}"
        whole = f"<!DOCTYPE html><html><head><title>{w(1, 8)}</title><style>p{{}}</style></head><body>{before}{body}{after}</body></html>"
        return whole[: r.randint(len(whole) // 2, len(whole))] if r.random() < 0.06 else whole


@cache
def trained(pages: int = 700, seed: int = 3) -> Crf:
    """The model, trained on ``pages`` made pages; the same in every process."""
    maker, labelled = _Maker(seed), []
    for _ in range(pages):
        own = blocks(maker.page())
        labels = [int("\x01" in b.text) for b in own]
        for b in own:
            b.text = b.text.replace("\x01", "") or "."
        labelled.append((features(own), labels))
    return fit(labelled)


def main_text(page: str | None, model: Crf) -> str:
    own = blocks(page)
    return "\n".join(b.text for b, y in zip(own, model.decode(features(own)), strict=True) if y)


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [main_text(x.as_py(), shared.value) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())  # some hundred weights
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_extract(shared), "page_id long, url string, text string, n_chars long")
