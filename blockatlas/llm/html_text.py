"""Main text of HTML pages by a recurrent block labeller.

A page is read as the sequence of its leaf blocks (text between block-level boundaries). Each
block's input is a hashed vector of its tag path (tags, classes, ids, roles), a hashed vector of
its words and a few numbers; a bidirectional LSTM in numpy reads the whole sequence both ways and
labels every block, so each decision sees the whole document.

There are no labelled pages, so training labels come from two places: a bounded sample of the
pages themselves, where semantic elements tell article from furniture, and pages put together
here from common layouts (with the sampled pages' words), whose labels are known by construction.
Documented bound: ``SAMPLE_PAGES`` pages of at most ``SAMPLE_CHARS`` characters; every page is
labelled whole.

Defined results
* null and empty html give the empty text with n_chars 0; a page without main text too;
* scripts, styles, templates, comments, the head and form controls are no blocks;
* character references are decoded once; white space in a block (with line breaks and no-break
  spaces) becomes one space; blocks of the main text are joined by one space in page order;
* repeated ids are extracted row by row; other columns may have any name.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .arrow import batch_of, pieces, schema_of
from .mixing import hash60

PATH_DIM, WORD_DIM, NUMBERS = 96, 32, 8
INPUT = PATH_DIM + WORD_DIM + NUMBERS
HIDDEN = 24
SAMPLE_PAGES = 120
SAMPLE_CHARS = 60_000
BUILT_PAGES = 700
EPOCHS = 5
SEED = 11

#: Attributes as HTML reads them: a quote opens a value only right behind the equals sign; one that never closes is part of a bare value.
_VALUE = r"""\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+))"""
_BARE = _VALUE.replace("([", "(?:[")
#: Attributes as HTML reads them: a quote opens a value only right behind the equals sign; one that never closes is part of a bare value.
_VALUE = r"""\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+))"""
_BARE = _VALUE.replace("([", "(?:[")
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</?[a-zA-Z][^\s/>]*+(?:[\s/]++|[^\s/>][^\s/>=]*+(?:{_BARE})?+)*+>?", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(rf"([^\s/>][^\s/>=]*+)(?:{_VALUE})?+")
_TOLD = frozenset("class id role itemprop".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Elements whose content is no text of the page.
_HIDDEN = frozenset("script style template noscript head svg annotation annotation-xml iframe object canvas audio video select textarea button".split())
_RAW = frozenset("script style textarea title iframe noscript template".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_INLINE |= frozenset("nobr output picture rb rp rt rtc ruby math mrow mi mo mn ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd mstyle mpadded mphantom menclose semantics".split())
_INLINE |= frozenset("nobr output picture rb rp rt rtc ruby math mrow mi mo mn ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd mstyle mpadded mphantom menclose semantics".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: A start tag of the first kind ends an open element of the second.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}


class Path:
    """What the open elements around a block tell of it: their marks' vector, their number, whether they are of the article.

    main: inside an article or main element and not in furniture of it; any_main: inside one at all.
    """

    __slots__ = ("vector", "depth", "main", "any_main")

    def __init__(self, vector: np.ndarray, depth: int, main: bool, any_main: bool):
        self.vector, self.depth, self.main, self.any_main = vector, depth, main, any_main

    def __len__(self) -> int:
        return self.depth


class _Open:
    """The open elements. Everything asked of them is kept up to date, so nothing walks the whole stack."""

    def __init__(self):
        self.tags: list[str] = []
        self.rows: list[tuple[list[str], bool, bool]] = []  # marks, main, any_main; of inline elements those around them
        self.at: defaultdict[str, list[int]] = defaultdict(list)  # tag -> places on the stack
        self.blocks: list[int] = []  # places of the elements that are not inline
        self.hidden = self.links = 0
        self._times: Counter[str] = Counter()
        self._vector = np.zeros(PATH_DIM, np.float32)
        self._path: Path | None = None

    def push(self, tag: str, marks: list[str]) -> None:
        _, main, any_main = self.rows[-1] if self.rows else ([], False, False)
        inline = tag in _INLINE
        if not inline:
            self._path = None
            self.blocks.append(len(self.tags))
            for m in marks:
                self._times[m] += 1
                if self._times[m] == 1:
                    at, sign = _mark_slot(m)
                    self._vector[at] += sign
            if tag in ("article", "main"):
                main = any_main = True
            elif tag in _BAD_TAGS and tag != "header":
                main = False
        self.at[tag].append(len(self.tags))
        self.tags.append(tag)
        self.rows.append(([] if inline else marks, main, any_main))
        self.hidden += tag in _HIDDEN
        self.links += tag == "a"

    def pop_to(self, place: int) -> None:
        while len(self.tags) > place:
            tag, (marks, _, _) = self.tags.pop(), self.rows.pop()
            self.at[tag].pop()
            self.hidden -= tag in _HIDDEN
            self.links -= tag == "a"
            if self.blocks and self.blocks[-1] == len(self.tags):
                self.blocks.pop()
                self._path = None
                for m in marks:
                    self._times[m] -= 1
                    if not self._times[m]:
                        at, sign = _mark_slot(m)
                        self._vector[at] -= sign

    def find(self, tags: tuple[str, ...], stops: tuple[str, ...] = ()) -> int:
        """The place of the innermost of ``tags`` if none of ``stops`` is open inside it, else -1."""
        last = lambda names: max((self.at[t][-1] for t in names if self.at[t]), default=-1)
        found = last(tags)
        return found if found > last(stops) else -1

    def only_inline_from(self, place: int) -> bool:
        return not self.blocks or self.blocks[-1] < place

    def path(self) -> Path:
        if self._path is None:
            v = self._vector.copy()
            if self.blocks:
                at, sign = _mark_slot("last " + self.tags[self.blocks[-1]])
                v[at] += sign
            _, main, any_main = self.rows[-1] if self.rows else ([], False, False)
            self._path = Path(v, len(self.blocks), main, any_main)
        return self._path


class Path:
    """What the open elements around a block tell of it: their marks' vector, their number, whether they are of the article.

    main: inside an article or main element and not in furniture of it; any_main: inside one at all.
    """

    __slots__ = ("vector", "depth", "main", "any_main")

    def __init__(self, vector: np.ndarray, depth: int, main: bool, any_main: bool):
        self.vector, self.depth, self.main, self.any_main = vector, depth, main, any_main

    def __len__(self) -> int:
        return self.depth


class _Open:
    """The open elements. Everything asked of them is kept up to date, so nothing walks the whole stack."""

    def __init__(self):
        self.tags: list[str] = []
        self.rows: list[tuple[list[str], bool, bool]] = []  # marks, main, any_main; of inline elements those around them
        self.at: defaultdict[str, list[int]] = defaultdict(list)  # tag -> places on the stack
        self.blocks: list[int] = []  # places of the elements that are not inline
        self.hidden = self.links = 0
        self._times: Counter[str] = Counter()
        self._vector = np.zeros(PATH_DIM, np.float32)
        self._path: Path | None = None

    def push(self, tag: str, marks: list[str]) -> None:
        _, main, any_main = self.rows[-1] if self.rows else ([], False, False)
        inline = tag in _INLINE
        if not inline:
            self._path = None
            self.blocks.append(len(self.tags))
            for m in marks:
                self._times[m] += 1
                if self._times[m] == 1:
                    at, sign = _mark_slot(m)
                    self._vector[at] += sign
            if tag in ("article", "main"):
                main = any_main = True
            elif tag in _BAD_TAGS and tag != "header":
                main = False
        self.at[tag].append(len(self.tags))
        self.tags.append(tag)
        self.rows.append(([] if inline else marks, main, any_main))
        self.hidden += tag in _HIDDEN
        self.links += tag == "a"

    def pop_to(self, place: int) -> None:
        while len(self.tags) > place:
            tag, (marks, _, _) = self.tags.pop(), self.rows.pop()
            self.at[tag].pop()
            self.hidden -= tag in _HIDDEN
            self.links -= tag == "a"
            if self.blocks and self.blocks[-1] == len(self.tags):
                self.blocks.pop()
                self._path = None
                for m in marks:
                    self._times[m] -= 1
                    if not self._times[m]:
                        at, sign = _mark_slot(m)
                        self._vector[at] -= sign

    def find(self, tags: tuple[str, ...], stops: tuple[str, ...] = ()) -> int:
        """The place of the innermost of ``tags`` if none of ``stops`` is open inside it, else -1."""
        last = lambda names: max((self.at[t][-1] for t in names if self.at[t]), default=-1)
        found = last(tags)
        return found if found > last(stops) else -1

    def only_inline_from(self, place: int) -> bool:
        return not self.blocks or self.blocks[-1] < place

    def path(self) -> Path:
        if self._path is None:
            v = self._vector.copy()
            if self.blocks:
                at, sign = _mark_slot("last " + self.tags[self.blocks[-1]])
                v[at] += sign
            _, main, any_main = self.rows[-1] if self.rows else ([], False, False)
            self._path = Path(v, len(self.blocks), main, any_main)
        return self._path


def blocks_of(page: str | None) -> list[tuple[Path, str, float]]:
    """The leaf blocks: (path, text, share of its characters in links)."""
    page = page or ""
    out: list[tuple[Path, str, float]] = []
    opened = _Open()
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            words = " ".join("".join(text).split())
            if words:
                out.append((opened.path(), words, min(1.0, linked / len(words))))
            text.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not opened.hidden:
            raw = htmllib.unescape(raw)
            text.append(raw)
            if opened.links:
                linked += len(" ".join(raw.split()))

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        token = m[0]
        name = _NAME.match(token)
        if not name:
            continue
        tag = name[1].lower()
        if token[1] == "/":
            k = opened.find((tag,))
            if tag not in _INLINE and tag not in _HIDDEN:
                flush()
                if tag == "p" and k < 0:
                    continue
            if k >= 0 and (tag not in _INLINE or opened.only_inline_from(k)):
                opened.pop_to(k)
            continue
        if tag == "br":
            add("\n")
            continue
        if tag not in _INLINE and tag not in _HIDDEN:
            flush()
        if tag in _CLOSES_P and (k := opened.find(("p",), ("td", "th", "li", "div", "section", "article", "body", "button"))) >= 0:
            opened.pop_to(k)
        if tag in _ENDS and (k := opened.find(_ENDS[tag], _STOPS[tag])) >= 0:
            opened.pop_to(k)
        if tag in _VOID or token.endswith("/>") and tag in ("path", "circle"):
            continue
        if tag == "body" and (k := opened.find(("head",))) >= 0:
            opened.pop_to(k)
        marks = [] if tag in ("html", "body") else [tag]
        if "=" in token and tag not in _INLINE:
            for attr, a, b, c in _ATTR.findall(token, name.end()):
                if (attr := attr.lower()) in _TOLD:
                    marks += [f"{attr}:{w.lower()}" for w in _PARTS.findall(htmllib.unescape(a or b or c))]
        opened.push(tag, marks)
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            stop = end.start() if end else len(page)
            add(page[at:stop])
            at = stop
    flush()
    return out


_SLOT: dict[str, tuple[int, float]] = {}
_MARK: dict[str, tuple[int, float]] = {}


def _slot(word: str, dim: int) -> tuple[int, float]:
    h = xxhash.xxh3_64_intdigest(word)
    return h % dim, 1.0 if h >> 40 & 1 else -1.0


def _mark_slot(mark: str) -> tuple[int, float]:
    found = _MARK.get(mark)
    if found is None:
        if len(_MARK) > 50_000:
            _MARK.clear()
        found = _MARK[mark] = _slot(mark, PATH_DIM)
    return found


def _path_vector(path: Path | tuple[str, ...]) -> np.ndarray:
    """Of a path, or of the keys (tag and marks) of its elements."""
    if isinstance(path, Path):
        return path.vector
    opened = _Open()
    for key in path:
        opened.push(key.split()[0], [m for m in key.split() if m not in ("html", "body")])
    return opened.path().vector


def inputs(blocks: list[tuple[tuple[str, ...], str, float]]) -> np.ndarray:
    """One row of INPUT numbers for each block."""
    x = np.zeros((len(blocks), INPUT), np.float32)
    for k, (path, text, linked) in enumerate(blocks):
        x[k, :PATH_DIM] = _path_vector(path)
        words = text.lower().split()
        for w, times in Counter(words).items():
            slot = _SLOT.get(w)
            if slot is None:
                slot = _slot(w, WORD_DIM)
                if len(_SLOT) < 200_000:
                    _SLOT[w] = slot
            x[k, PATH_DIM + slot[0]] += times * slot[1]
        x[k, PATH_DIM : PATH_DIM + WORD_DIM] /= 4 * np.sqrt(len(words))
        n = len(text)
        marks = sum(text.count(c) for c in ".,;:!?")
        x[k, PATH_DIM + WORD_DIM :] = (np.log1p(n) / 6, linked, marks / n * 10, len(words) > 12, k / max(1, len(blocks) - 1), len(path) / 10, text[-1] in ".!?", 1.0)
    return x


class BiLstm:
    """A bidirectional LSTM with a logistic output, its gradients and Adam, all in numpy."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p = {"out": rng.normal(0, 0.1, (2 * HIDDEN, 1)), "bias": np.zeros(1)}
        for d in "fb":
            self.p |= {f"x{d}": rng.normal(0, INPUT**-0.5, (INPUT, 4 * HIDDEN)), f"h{d}": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)), f"c{d}": np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    @staticmethod
    def _sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """x: (T, B, INPUT), mask: (T, B). State stands still where the mask is 0."""
        steps, rows = mask.shape
        z_in = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        h, c = np.zeros((rows, HIDDEN), np.float32), np.zeros((rows, HIDDEN), np.float32)
        out = np.zeros((steps, rows, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = z_in[t] + h @ self.p[f"h{d}"]
            gates, g = self._sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = np.split(gates, 3, 1)
            m = mask[t][:, None]
            new_c = f * c + i * g
            tc = np.tanh(new_c)
            if keep is not None:
                keep.append((t, i, f, o, g, c, tc, h, m))
            c = m * new_c + (1 - m) * c
            h = m * (o * tc) + (1 - m) * h
            out[t] = h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, "f"), self._run(x, mask, "b")], 2)
        return (both @ self.p["out"])[..., 0] + self.p["bias"][0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean logistic loss over the masked blocks and its gradients."""
        kept = {"f": [], "b": []}
        outs = [self._run(x, mask, d, kept[d]) for d in "fb"]
        both = np.concatenate(outs, 2)
        p = self._sigmoid((both @ self.p["out"])[..., 0] + self.p["bias"][0])
        n = mask.sum()
        loss = float(-(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / n)
        delta = (mask * (p - y) / n)[..., None]
        grad = {"out": np.einsum("tbh,tbo->ho", both, delta), "bias": delta.sum((0, 1))}
        back = delta @ self.p["out"].T
        for k, d in enumerate("fb"):
            dh_out = back[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            wh = self.p[f"h{d}"]
            dz_all = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            gh = np.zeros_like(wh)
            dh, dc = np.zeros_like(dh_out[0]), np.zeros_like(dh_out[0])
            for t, i, f, o, g, c, tc, h, m in reversed(kept[d]):
                dh = dh + dh_out[t]
                dnew_h = dh * m
                do = dnew_h * tc
                dnew_c = dnew_h * o * (1 - tc * tc) + dc * m
                dz = np.concatenate([dnew_c * g * i * (1 - i), dnew_c * c * f * (1 - f), do * o * (1 - o), dnew_c * i * (1 - g * g)], 1)
                dz_all[t] = dz
                gh += h.T @ dz
                dh = dh * (1 - m) + dz @ wh.T
                dc = dc * (1 - m) + dnew_c * f
            grad |= {f"x{d}": np.einsum("tbi,tbz->iz", x, dz_all, optimize=True), f"h{d}": gh, f"c{d}": dz_all.sum((0, 1))}
        return loss, grad

    def fit(self, sequences: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, batch: int = 16, rate: float = 0.01, seed: int = SEED) -> float:
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        step, loss = 0, 0.0
        for epoch in range(epochs):
            groups = [g for g in np.array_split(np.argsort([len(y) + rng.random() for _, y in sequences], kind="stable"), max(1, len(sequences) // batch)) if len(g)]
            rng.shuffle(groups)
            for group in groups:
                step += 1
                loss, grad = self.gradients(*_pad([sequences[k][0] for k in group], [sequences[k][1] for k in group]))
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                lr = rate * (1 - epoch / epochs) * min(1.0, 2.0 / (norm + 1e-9))
                for k, g in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page's inputs, which blocks are main text. Pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = [k for k in np.argsort([len(p) for p in pages], kind="stable") if len(pages[k])]
        start = 0
        while start < len(order):
            stop = start
            while stop < len(order) and stop - start < 256 and (stop + 1 - start) * len(pages[order[stop]]) <= 40_000 or stop == start:
                stop += 1
            x, mask, _ = _pad([pages[k] for k in order[start:stop]])
            z = self.logits(x, mask)
            for b, k in enumerate(order[start:stop]):
                out[k] = z[: len(pages[k]), b] > 0
            start = stop
        return out


def _pad(xs: list[np.ndarray], ys: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(len(x) for x in xs)
    x, mask, y = np.zeros((steps, len(xs), INPUT), np.float32), np.zeros((steps, len(xs)), np.float32), np.zeros((steps, len(xs)), np.float32)
    for k, one in enumerate(xs):
        x[: len(one), k], mask[: len(one), k] = one, 1
        if ys is not None:
            y[: len(one), k] = ys[k]
    return x, mask, y


#: Words that layouts use for the parts of a page, as they go into classes and ids here.
MAIN = ["article", "content", "post", "entry", "story", "main", "entry content", "post body", "article body", "page content", "text"]
FURNITURE = {
    "menu": (["nav", "div", "ul", "menu"], ["nav", "menu", "navbar", "navigation", "main menu", "breadcrumb", "breadcrumbs", "topnav", "pagination", "toc", "skip link"]),
    "header": (["header", "div"], ["header", "site header", "masthead", "top", "banner", "logo", "branding", "topbar"]),
    "footer": (["footer", "div", "section"], ["footer", "site footer", "bottom", "copyright", "legal", "colophon", "foot links"]),
    "sidebar": (["aside", "div", "section"], ["sidebar", "side", "widget", "related", "related posts", "popular", "recent", "tags", "archive", "right column", "recommended", "more stories"]),
    "notice": (["div", "section", "p"], ["cookie", "cookie notice", "notice", "consent", "gdpr banner", "alert", "newsletter", "subscribe", "popup", "modal", "paywall", "disclaimer", "warning"]),
    "advert": (["div", "aside", "section"], ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "ad slot", "banner ad", "teaser"]),
    "form": (["form", "div"], ["search", "search form", "login", "signup", "contact form", "comment form", "respond", "form"]),
    "comments": (["div", "section", "ol", "ul"], ["comments", "comment", "comment list", "commentlist", "replies", "discussion", "responses", "disqus thread", "reviews", "user comments"]),
    "share": (["div", "ul"], ["share", "social", "sharing", "follow", "byline tools", "actions"]),
}
#: Grid, utility and CMS classes, which say nothing of what an element holds.
UTILITY = ["col-lg-4 col-md-6 col-sm-12", "col-md-8 offset-md-2", "row no-gutters", "d-flex flex-column", "mb-3 p-4", "w-100 h-100", "mx-auto px-2 py-3", "post-812 type-post status-publish", "format-standard hentry", "category-news tag-world", "page-id-7 page-template-default", "wp-block-group is-layout-flow", "has-text-align-left has-background", "grid-12 span-6 last", "u-cf js-hook", "elementor-element elementor-widget-wrap", "region-14 block-system even", "md:text-lg bg-white rounded shadow"]
_BAD_TAGS = frozenset("nav header footer aside form menu".split())


def build_page(rng: np.random.Generator, words: list[str]) -> tuple[list, np.ndarray]:
    """A page of a random common layout: its blocks, and which of them are main text."""
    said = lambda n: " ".join(words[k] for k in rng.integers(0, len(words), n))
    pick = lambda xs: xs[int(rng.integers(0, len(xs)))]
    mark = "\x01"
    wide = rng.random() < 0.4  # a page of long class lists, in which names come last

    def attr(name: str) -> str:
        name = name.replace(" ", pick(["-", "_", " "]))
        if wide:
            return f' class="{" ".join(pick(UTILITY) for _ in range(int(rng.integers(1, 5))))} {name}"'
        return pick([f' class="{name}"', f' id="{name}"', f' class="{name} {pick(["box", "wrap", "inner", "clearfix", "block"])}"'])

    def piece(kind: str) -> str:
        tags, names = FURNITURE[kind]
        tag, name = pick(tags), pick(names)
        semantic = tag in _BAD_TAGS
        opened = f"<{tag}{attr(name) if not semantic or rng.random() < 0.5 else ''}>"
        n = int(rng.integers(1, 7))
        if kind in ("menu", "share") or kind in ("sidebar", "footer") and rng.random() < 0.5:
            items = "".join(f'<li><a href="/x">{said(int(rng.integers(1, 4)))}</a></li>' for _ in range(n + 1))
            inner = items if tag in ("ul", "ol", "menu") else f"<ul>{items}</ul>"
        elif kind == "comments":
            inner = "".join(pick(["<li>{}</li>", "<div><p>{}</p></div>", '<div class="comment"><p>{}</p><p>{}</p></div>', "<p>{}</p>"]).format(*(said(int(rng.integers(3, 50))) for _ in range(2))) for _ in range(n))
            inner = pick(["", f"<h3>{said(2)}</h3>"]) + inner
        elif kind == "form":
            inner = f"<label>{said(2)}</label><input name=q><p>{said(int(rng.integers(1, 12)))}</p>"
        else:
            inner = pick(["{}", "<p>{}</p>", "<div>{}</div>", "<span>{}</span>", "<h3>{}</h3><p>{}</p>", "&copy; {}"]).format(*(said(int(rng.integers(2, 40))) for _ in range(2)))
        return f"{opened}{inner}</{tag}>"

    def body() -> str:
        out = []
        for k in range(int(rng.integers(1, 14))):
            kind = rng.random()
            text = said(int(rng.integers(2, 90))) + pick([".", ".", "", "!"])
            if k and kind < 0.1:
                out.append(f"<{pick(['h2', 'h3', 'h4'])}>{mark}{said(int(rng.integers(1, 9)))}</h2>")
            elif kind < 0.16:
                out.append("<ul>" + "".join(f"<li>{mark}{said(int(rng.integers(1, 20)))}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.2:
                out.append(f"<blockquote>{mark}{text}</blockquote>")
            elif kind < 0.23:
                out.append("<table>" + "".join(f"<tr><td>{mark}{said(2)}</td><td>{mark}{said(3)}</td></tr>" for _ in range(2)) + "</table>")
            elif kind < 0.26:
                out.append(f"<pre>{mark}{text}</pre>")
            elif kind < 0.32:
                out.append(f"<p><b>{mark}{text}<br>")
            elif kind < 0.4:
                out.append(f'<p>{mark}{text} <a href="/y">{said(2)}</a> {said(4)}</p>')
            else:
                out.append(f"<{(t := pick(['p', 'p', 'p', 'p', 'div']))}>{mark}{text}</{t}>")
            if rng.random() < 0.06:
                out.append(piece(pick(["advert", "share", "sidebar", "notice"])))
        return "".join(out)

    title = pick(["<h1>{}</h1>", "<h1>{}</h1>", "<header><h1>{}</h1></header>", '<h1 class="title">{}</h1>', "<h2>{}</h2>"]).format(mark + said(int(rng.integers(2, 12))))
    opened, closed = pick([("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), (f"<div{attr(pick(MAIN))}>", "</div>"), (f"<section{attr(pick(MAIN))}>", "</section>"), (f"<div{attr(pick(MAIN))}><div{attr(pick(MAIN))}>", "</div></div>"), (f"<article{attr(pick(MAIN))}>", "</article>")])
    before = [piece(pick(["menu", "header", "notice", "advert", "form", "share", "menu"])) for _ in range(int(rng.integers(0, 5)))]
    after = [piece(pick(["footer", "sidebar", "comments", "form", "advert", "notice", "comments", "footer", "menu"])) for _ in range(int(rng.integers(0, 5)))]
    late = piece("comments") if rng.random() < 0.2 else ""
    page = "<html><body>" + pick(["", "<div id=page>"]) + "".join(before) + opened + title + body() + late + closed + "".join(after) + "</body></html>"
    found = blocks_of(page)
    y = np.array([mark in text for _, text, _ in found], np.float32)
    return [(path, text.replace(mark, "").strip() or "-", linked) for path, text, linked in found], y


def weak_labels(blocks: list) -> np.ndarray | None:
    """Labels from semantic elements alone; None where the page has no article or main element."""
    if not any(path.any_main for path, _, _ in blocks):
        return None
    return np.array([path.main for path, _, _ in blocks], np.float32)


def train(pages: list[str], seed: int = SEED, built: int = BUILT_PAGES) -> BiLstm:
    """The labeller from a sample of pages and pages of common layouts."""
    rng = np.random.default_rng(seed)
    found = [b for p in pages if (b := blocks_of(p))]
    words = [w for b in found for _, text, _ in b for w in text.split()] or [f"w{k}" for k in range(200)]
    words = [words[k] for k in rng.integers(0, len(words), 5000)]
    sequences = [build_page(rng, words) for _ in range(built)]
    sequences += [(b, y) for b in found if (y := weak_labels(b)) is not None]
    model = BiLstm(seed)
    model.fit([(inputs(b), y) for b, y in sequences if len(b)])
    return model


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: BiLstm | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks of every row."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    if model is None:
        fit_on = rows.filter(F.length("html") <= SAMPLE_CHARS).select(hash60(F.col("page_id")).alias("h"), F.col("html"))
        # The limit is found on hashes alone, so that tasks do not each send that many pages.
        last = fit_on.select("h").orderBy("h").limit(SAMPLE_PAGES).agg(F.max("h")).first()[0]
        chosen = fit_on.filter(F.col("h") <= (-1 if last is None else last))
        model = train([r["html"] for r in chosen.orderBy("h", "html").limit(SAMPLE_PAGES).collect()])
    shipped = pages.sparkSession.sparkContext.broadcast(model)
    ddl = "page_id long, url string, text string, n_chars long, n_blocks long"
    schema = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2, 4 << 20):
            blocks = [blocks_of(p) for p in batch.column(2).to_pylist()]
            marks = shipped.value.label([inputs(b) for b in blocks])
            texts = [" ".join(text for (_, text, _), keep in zip(b, m, strict=True) if keep) for b, m in zip(blocks, marks, strict=True)]
            yield batch_of(schema, [batch.column(0), batch.column(1), texts, [len(t) for t in texts], [len(b) for b in blocks]])

    return rows.mapInArrow(run, ddl)


def op3_html_lstm(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
