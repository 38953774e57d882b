"""Main text of web pages by a recurrent block labeller.

A page is read into leaf blocks: runs of text between block-level tags, each
with the path of open tags (with class, id and role words). A bidirectional LSTM
in numpy reads the blocks' vectors in page order and says for each, with the
whole page as context, whether it belongs to the article. A vector holds hashed
path words, the last tags, hashed words of the whole text, and a few shares
(length, links, punctuation, place).

The labeller is trained here, on a fixed number of pages that a generator makes
up: articles in many kinds of containers among menus, headers, footers,
sidebars, notices, adverts, forms and comments, whose labels are known by
construction. It is trained once in the driver and travels with the tasks; no
page passes through the driver.

Pages are read in one pass, in time in proportion to their length whatever is
left open, and long ones are labelled segment by segment: the states of the
network are carried on, so that the result is that of the whole page, and memory
is that of a segment and of the blocks themselves.

Defined cases: null and empty pages have an empty text; what is not closed is
closed by its container's end or the page's; a script or comment that never ends
reaches to the page's end; a quote that never ends closes with its tag; a tag
that never ends is text; tags deeper than `DEPTH` count as if they stood there,
as in browsers; a line break tag is white space; repeated rows are read alike; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import Words, plain, prepare, runs
from quarry.llm.decontamination import FOLD, INSIDE

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
RAW = re.compile(r"<(script|style|template|noscript|svg|iframe|object|textarea|select)\b", re.I)
INSIDE_TAG = re.compile(r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>""")
MARK = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Tags by the HTML standard: those without content, and those that don't begin a new block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
HOLDS = frozenset("ul ol dl table tbody thead tfoot menu body".split())

DEPTH = 128
SEGMENT = 4096  # blocks of a page that are labelled at once
PATH, LAST, WORD, MORE = 192, 48, 48, 8
SIZE = PATH + LAST + WORD + MORE
HIDDEN = 24
BLOCK = tuple[tuple[str, ...], str, int]  # path, text, characters in links


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """What is not text: start, end, name (empty for comments and the like), whether it is an end tag, and attributes.

    Nothing is looked for twice that was not found: a tag's end after the last one, or marks after which a quote stays open.
    """
    at, close, open_for_good = 0, 0, set()

    def end_of(at: int) -> int:
        """The end of a tag whose quotes are all closed, or -1."""
        if not open_for_good:
            if m := INSIDE_TAG.match(page, at):
                return m.end()
        passed = []
        while (m := MARK.search(page, at)) and m[0] != ">" and m.start() not in open_for_good:
            passed.append(m.start())
            at = page.find(m[0], m.end()) + 1
            if not at:
                break
        if m and m[0] == ">" and at:
            return m.end()
        open_for_good.update(passed)
        return -1

    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith("<!--", start):
            at = page.find("-->", start + 4) + 3
            at = at if at > 2 else len(page)
            yield start, at, "", False, ""
            continue
        if 0 <= close <= start:
            close = page.find(">", start)
        if close < 0:  # only a comment can still come
            at = page.find("<!--", at)
            if at < 0:
                return
            continue
        if m := RAW.match(page, start):
            end = re.compile(rf"</{m[1]}\s*+>", re.I).search(page, close + 1)
            at = end.end() if end else len(page)
            yield start, at, "", False, ""
        elif m := NAME.match(page, start):
            at = end_of(m.end())
            if at >= 0:
                yield start, at, m[1].lower(), page[start + 1] == "/", page[m.end() : at - 1]
            else:
                at = close + 1
                yield start, at, "", False, ""
        elif page[start + 1 : start + 2] in ("!", "?"):
            at = close + 1
            yield start, at, "", False, ""


def blocks(page: str) -> list[BLOCK]:
    """The leaf blocks of a page in order, with references decoded and white space made single."""
    found: list[BLOCK] = []
    stack: list[tuple[str, str]] = []
    paths: dict[tuple[str, ...], tuple[str, ...]] = {}
    text: list[str] = []
    linked = links = at = 0

    def close() -> None:
        nonlocal linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                path = tuple(s for _, s in stack)
                found.append((paths.setdefault(path, path), whole, min(linked, len(whole))))
        text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            text.append(piece)
            if links:
                linked += len(piece)

    def pop(tags: tuple[str, ...], until: frozenset = frozenset()) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                del stack[k:]
                return
            if stack[k][0] in until:
                return

    for start, end, tag, ends, attributes in tags(page):
        add(page[at:start])
        at = end
        if not tag:
            continue
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                links = max(0, links + (-1 if ends else 1))
            continue
        close()
        links = 0
        if ends:
            pop((tag,))
            continue
        if tag in CLOSES_P:
            pop(("p",), CLOSES_P - {"p"})
        if tag in SAME:
            pop(SAME[tag], HOLDS)
        if tag not in VOID and not attributes.endswith("/") and len(stack) < DEPTH:
            names = " ".join(a or b or c for a, b, c in ATTRIBUTE.findall(attributes))
            stack.append((tag, f"{tag} {names.lower()}" if names else tag))
    add(page[at:])
    close()
    return found


def _place(word: str, size: int) -> int:
    return zlib.crc32(word.encode()) % size


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH + LAST, np.float32)
    for step in path:
        tag, _, names = step.partition(" ")
        v[_place(f"<{tag}", PATH)] = 1
        for word in re.findall(r"[a-z]+", names):
            v[_place(word, PATH)] = 1
    for k, step in enumerate(path[-3:][::-1]):
        v[PATH + _place(f"{k} {step.partition(' ')[0]}", LAST)] = 1
    return v


def vectors(flat: list[BLOCK], place: np.ndarray, total: np.ndarray) -> np.ndarray:
    """A row for each block; place: its place in its page, total: the page's number of blocks."""
    x = np.zeros((len(flat), SIZE), np.float32)
    if not flat:
        return x
    seen: dict[tuple[str, ...], np.ndarray] = {}
    for i, (path, _, _) in enumerate(flat):
        v = seen.get(path)
        if v is None:
            v = seen[path] = path_vector(path)
        x[i, : PATH + LAST] = v
    raw = [t.encode() for _, t, _ in flat]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    w = Words(FOLD[data], at, INSIDE)
    bins = np.bincount(w.text * WORD + (w.hash >> np.uint64(40)).astype(np.int64) % WORD, minlength=len(flat) * WORD).reshape(-1, WORD)
    x[:, PATH + LAST : PATH + LAST + WORD] = np.sqrt(bins / np.maximum(1, w.counts())[:, None])
    size = np.maximum(1, np.diff(at))

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask[data])])
        return (total[at[1:]] - total[at[:-1]]) / size

    table = np.arange(256)
    more = x[:, PATH + LAST + WORD :]
    more[:, 0] = np.minimum(np.log1p(w.counts()) / 5, 2)
    more[:, 1] = np.array([n for *_, n in flat]) / size
    more[:, 2] = share(np.isin(table, [ord(c) for c in ".,;:!?"]))
    more[:, 3] = share((table >= 48) & (table < 58))
    more[:, 4] = place / total
    more[:, 5] = np.minimum(1, total / 50)
    more[:, 6] = data[at[1:] - 1] == ord(".")
    more[:, 7] = 1
    return x


def of_pages(pages: list[list[BLOCK]]) -> tuple[np.ndarray, np.ndarray]:
    """A row for each block of the pages, and the pages' offsets in the rows."""
    size = np.array([len(p) for p in pages], np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)])
    return vectors([b for p in pages for b in p], np.arange(offsets[-1]) - np.repeat(offsets[:-1], size), np.repeat(size, size)), offsets


# The labeller


class Labeller:
    """A bidirectional LSTM with a linear way past it, trained by Adam on the logistic loss."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.p: dict[str, np.ndarray] = {"past": np.zeros(SIZE), "out": rng.normal(0, 0.1, 2 * h), "bias": np.zeros(1)}
        for d in "fb":
            self.p[f"w{d}"] = rng.normal(0, SIZE**-0.5, (SIZE, 4 * h))
            self.p[f"u{d}"] = rng.normal(0, h**-0.5, (h, 4 * h))
            self.p[f"c{d}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    @staticmethod
    def _gates(z: np.ndarray) -> tuple[np.ndarray, ...]:
        h = HIDDEN
        s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h], -30, 30)))
        return s[:, :h], s[:, h : 2 * h], s[:, 2 * h :], np.tanh(z[:, 3 * h :])

    def _one_way(self, d: str, x: np.ndarray, keep: np.ndarray, trace: list | None, state: list | None = None) -> np.ndarray:
        """Hidden states over padded pages (time, page, feature); keep masks what is there. state: what to begin with, replaced by the last one."""
        t, n, _ = x.shape
        zx = (x.reshape(t * n, -1) @ self.p[f"w{d}"] + self.p[f"c{d}"]).reshape(t, n, -1)
        out = np.zeros((t, n, HIDDEN), np.float32)
        hid, cell = state or (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            i, f, o, g = self._gates(zx[k] + hid @ self.p[f"u{d}"])
            m = keep[k][:, None]
            new = f * cell + i * g
            tan = np.tanh(new)
            if trace is not None:
                trace.append((k, hid, cell, i, f, o, g, tan, m))
            hid, cell = np.where(m, o * tan, hid), np.where(m, new, cell)
            out[k] = hid
        if state is not None:
            state[:] = hid, cell
        return out

    def _long(self, page: list[BLOCK]) -> np.ndarray:
        """The labels of a long page, segment by segment: the backward states first, then the others from the page's start."""
        cuts = range(0, len(page), SEGMENT)
        states = np.zeros((len(page), HIDDEN), np.float32)
        out = np.zeros(len(page), bool)
        for d, order in (("b", reversed(cuts)), ("f", cuts)):
            state = [np.zeros((1, HIDDEN), np.float32), np.zeros((1, HIDDEN), np.float32)]
            for a in order:
                own = page[a : a + SEGMENT]
                x = vectors(own, np.arange(a, a + len(own)), np.full(len(own), len(page)))
                found = self._one_way(d, x[:, None], np.ones((len(own), 1), bool), None, state)[:, 0]
                if d == "b":
                    states[a : a + len(own)] = found
                else:
                    both = np.concatenate([found, states[a : a + len(own)]], 1)
                    out[a : a + len(own)] = both @ self.p["out"] + x @ self.p["past"] + self.p["bias"] > 0
        return out

    def logits(self, x: np.ndarray, keep: np.ndarray, traces: dict | None = None) -> np.ndarray:
        sides = [self._one_way(d, x, keep, None if traces is None else traces.setdefault(d, [])) for d in "fb"]
        both = np.concatenate(sides, 2)
        if traces is not None:
            traces["both"] = both
        return both @ self.p["out"] + x @ self.p["past"] + self.p["bias"]

    def gradients(self, x: np.ndarray, keep: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        traces: dict = {}
        z = self.logits(x, keep, traces)
        dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * keep / keep.sum()).astype(np.float32)
        grad = {"out": np.tensordot(dz, traces["both"], 2), "past": np.tensordot(dz, x, 2), "bias": dz.sum(keepdims=True).reshape(1)}
        t, n, _ = x.shape
        for s, d in enumerate("fb"):
            dout = dz[:, :, None] * self.p["out"][s * HIDDEN : (s + 1) * HIDDEN]
            dzx, du = np.zeros((t, n, 4 * HIDDEN), np.float32), np.zeros_like(self.p[f"u{d}"])
            dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for k, hid, cell, i, f, o, g, tan, m in reversed(traces[d]):
                dh = dh + dout[k]
                on = np.where(m, dh, 0)
                dnew = np.where(m, dc, 0) + on * o * (1 - tan * tan)
                gate = np.concatenate([dnew * g * i * (1 - i), dnew * cell * f * (1 - f), on * tan * o * (1 - o), dnew * i * (1 - g * g)], 1)
                dzx[k] = gate
                du += hid.T @ gate
                dh = np.where(m, 0, dh) + gate @ self.p[f"u{d}"].T
                dc = np.where(m, dnew * f, dc)
            flat = dzx.reshape(t * n, -1)
            grad |= {f"w{d}": x.reshape(t * n, -1).T @ flat, f"u{d}": du, f"c{d}": flat.sum(0)}
        return grad

    def fit(self, pages: list[tuple[list[BLOCK], list[int]]], rounds: int = 10, batch: int = 32, rate: float = 0.01, seed: int = 6) -> None:
        x, offsets = of_pages([p for p, _ in pages])
        y = np.array([v for _, labels in pages for v in labels], np.float32)
        rng, step = np.random.default_rng(seed), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for r in range(rounds):
            order = rng.permutation(len(pages))
            for a in range(0, len(order), batch):
                px, keep, py = padded(x, offsets, order[a : a + batch], y)
                step += 1
                for k, g in self.gradients(px, keep, py).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    fast = rate * (1 if r < rounds * 2 // 3 else 0.2)
                    self.p[k] = (self.p[k] - fast * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def label(self, pages: list[list[BLOCK]]) -> list[np.ndarray]:
        """For each page a boolean for each block."""
        size = np.array([len(p) for p in pages], np.int64)
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        for page in np.flatnonzero(size > SEGMENT).tolist():
            out[page] = self._long(pages[page])
        order = np.argsort(size, kind="stable")
        order = order[(size[order] > 0) & (size[order] <= SEGMENT)]
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and size[order[b]] * (b + 1 - a) <= 2 * SEGMENT:
                b += 1
            px, keep, _ = padded(*of_pages([pages[k] for k in order[a:b].tolist()]), np.arange(b - a), None)
            z = self.logits(px, keep)
            for k, page in enumerate(order[a:b].tolist()):
                out[page] = z[: size[page], k] > 0
            a = b
        return out


def padded(x: np.ndarray, offsets: np.ndarray, which: np.ndarray, y: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    size = np.diff(offsets)[which]
    t = int(size.max())
    out, keep = np.zeros((t, len(which), x.shape[1]), np.float32), np.arange(t)[:, None] < size[None, :]
    labels = None if y is None else np.zeros(keep.shape, np.float32)
    for k, page in enumerate(which.tolist()):
        a, b = offsets[page], offsets[page + 1]
        out[: b - a, k] = x[a:b]
        if labels is not None:
            labels[: b - a, k] = y[a:b]
    return out, keep, labels


# Made-up pages

#: Names that page authors give to the parts of a page, by part.
NAMES = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topnav submenu toc tabs pagination",
    "header": "header masthead banner topbar branding logo",
    "footer": "footer bottom colophon copyright legal imprint",
    "side": "sidebar aside widget related recommended popular trending teaser more",
    "notice": "notice cookie consent gdpr alert popup modal banner warning overlay",
    "advert": "ad ads advert advertisement sponsored promo promotion banner adbox sponsor",
    "form": "form newsletter subscribe login search signup register contact",
    "comment": "comments comment replies reply discussion respond disqus responses",
    "share": "share social sharing follow buttons tags meta",
    "article": "article post entry content story main body text article-body post-content entry-content page story-body",
}
TAGS = {"menu": "nav div ul", "header": "header div", "footer": "footer div", "side": "aside div section", "notice": "div section aside p", "advert": "div aside section", "form": "form div section", "comment": "section div ol", "share": "div ul p"}
LEAVES = {"menu": "li li li a", "header": "h1 div p", "footer": "p div li", "side": "h3 p li", "notice": "p div", "advert": "p div h4", "form": "p label button legend", "comment": "h3 p p li", "share": "li p div"}


def made_up(rng: np.random.Generator) -> tuple[list[BLOCK], list[int]]:
    """A page's blocks and their labels."""
    page: list[BLOCK] = []
    labels: list[int] = []

    def pick(words: str) -> str:
        return str(rng.choice(words.split()))

    def say(n: int) -> str:
        letters = rng.integers(97, 123, 8 * n).astype(np.uint8).tobytes().decode()
        words = [letters[8 * i : 8 * i + int(k)] for i, k in enumerate(rng.integers(1, 9, n))]
        mark = pick("- - - - - - !! ### &&& |")
        if mark != "-" and rng.random() < 0.3:
            words = [w + mark for w in words]
        if rng.random() < 0.1:
            words = [w.upper() for w in words]
        return " ".join(words).capitalize() + ("." if rng.random() < 0.7 else "")

    def part(kind: str, inside: tuple[str, ...]) -> None:
        tag = pick(TAGS[kind])
        plain_tag = tag in ("nav", "header", "footer", "aside", "form")
        name = "" if plain_tag and rng.random() < 0.5 else " " + pick(NAMES[kind]) + ("" if rng.random() < 0.6 else " " + pick("top left right box inner wrap main item list"))
        path = (*inside, tag + name)
        short = kind in ("menu", "share", "form")
        for _ in range(1 if kind in ("advert", "notice") else int(rng.integers(1, 7))):
            leaf = pick(LEAVES[kind])
            text = say(int(rng.integers(1, 4 if short else 40)))
            bare = leaf == "a" or (leaf in ("div", "p") and rng.random() < 0.5)
            own = path if bare else (*path, "ul", leaf) if leaf == "li" and tag != "ul" else (*path, leaf)
            if kind == "comment" and rng.random() < 0.4:
                own = (*path, "div comment", leaf)
            page.append((own, text, len(text) if kind == "menu" or rng.random() < 0.2 else 0))
            labels.append(0)

    def article(inside: tuple[str, ...]) -> None:
        form = rng.random()
        box = ("article",) if form < 0.45 else ("main",) if form < 0.55 else ("main", "article") if form < 0.65 else (f"{pick('div section article')} {pick(NAMES['article'])}",)
        path = (*inside, *box)
        if rng.random() < 0.8:
            page.append(((*path, "header", "h1") if rng.random() < 0.15 else (*path, "h1"), say(int(rng.integers(1, 14))), 0))
            labels.append(1)
        for _ in range(int(rng.integers(1, 22))):
            if rng.random() < 0.05:
                part(pick("advert side share form"), path)
            leaf = pick("p p p p p p p p h2 h3 li blockquote pre td div figcaption")
            own = (*path, "ul", "li") if leaf == "li" else (*path, "table", "tr", "td") if leaf == "td" else (*path, "blockquote", "p") if leaf == "blockquote" else path if leaf == "div" else (*path, leaf)
            text = say(int(np.exp(rng.uniform(0, 5.5))))
            page.append((own, text, len(text) // 4 if rng.random() < 0.05 else 0))
            labels.append(1)

    def some(kinds: str, inside: tuple[str, ...], share: float) -> None:
        for kind in kinds.split():
            if rng.random() < share:
                part(kind, inside)

    body: tuple[str, ...] = ("html", "body")
    if rng.random() < 0.9:
        page.append((("html", "head", "title"), say(int(rng.integers(1, 12))), 0))
        labels.append(0)
    if rng.random() < 0.4:
        body = (*body, "div " + pick("page wrapper container site root app"))
    some("notice header menu menu advert notice", body, 0.45)
    if rng.random() < 0.25:
        some("side", body, 0.7)
    if rng.random() < 0.95:
        article(body)
    some("share comment side advert form", body, 0.4)
    some("footer", body, 0.9)
    return page, labels


_TRAINED: dict[int, Labeller] = {}


def trained(pages: int = 480, seed: int = 11) -> Labeller:
    """The labeller, fitted on so many made-up pages; the same each time."""
    if pages not in _TRAINED:
        rng = np.random.default_rng(seed)
        model = Labeller()
        model.fit([p for p in (made_up(rng) for _ in range(pages)) if p[0]])
        _TRAINED[pages] = model
    return _TRAINED[pages]


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    prepare(pages.sparkSession)
    weights = (model or trained()).p

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller()
        labeller.p = weights
        for b in runs(batches, "html"):
            found = [blocks(h or "") for h in b.column("html").to_pylist()]
            texts = ["\n\n".join(t for (_, t, _), y in zip(p, keep, strict=True) if y) for p, keep in zip(found, labeller.label(found), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return plain(pages, "page_id", "url", "html").mapInArrow(read, "page_id long, url string, text string, n_chars long")
