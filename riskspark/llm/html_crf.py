"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

A page is the sequence of its leaf blocks. Every block has features of its open elements (tags, and words of class,
id and role), of its text (length, end, links, capitals) and of its place; the two labels are main text and other.
Weights are fitted by AdaGrad on the log-likelihood of labelled pages (forward-backward), pages are decoded by
Viterbi, and the blocks labelled main are joined.

Labelled pages come from the given ones. A block's label follows from sectioning markup where the page has it:
inside ``article`` or ``main`` and, below it, in no ``nav``, ``aside``, ``footer``, ``form`` and so on and in nothing
named like one. A ``header`` or ``figure`` of the article is part of it. As such markup is not on every page, the
labelled pages' texts are also poured into layouts drawn by rule (``layout``): content (paragraphs, lists, tables,
preformatted text, captions, titles in a header) and surroundings in elements with usual class names, with the labels
known. What is around the article or main element has features of its own, and names of ``html`` and ``body`` have
none: they say what a page has, not what a block is. At most ``max_pages`` distinct pages, those whose address hashes
lowest, are taken: hashes are picked first, and the driver gets the texts of the picked pages only.

Defined results: null or empty html has an empty text; a page without main blocks too; broken markup is read as far
as it goes. Equal rows get equal results. Without any page to learn from, blocks inside ``article`` or ``main`` count.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.html_blocks import Block, leaf_blocks
from riskspark.llm.kept import kept_apart
from riskspark.llm.textbytes import small_batches

BUCKETS = 1 << 14
CONTENT_TAGS = frozenset(["article", "main"])
OTHER_TAGS = frozenset("nav aside footer form menu dialog button fieldset".split())
# Main text inside an article or main element, something else outside of one.
EITHER_TAGS = frozenset(["header", "figure"])

# Usual names of parts of a page, for the layouts (fixed values).
CONTENT_NAMES = (
    "content", "article", "post", "entry", "story", "main", "body", "text", "post content", "entry content", "article body",
    "story body", "main content", "page content", "post body",
)
OTHER_NAMES = (
    "menu", "nav", "navbar", "navigation", "topbar", "header", "masthead", "footer", "copyright", "sidebar", "side", "widget", "related",
    "recommended", "trending", "ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored", "sponsor", "cookie", "cookies",
    "consent", "notice", "alert", "gdpr", "privacy", "legal", "newsletter", "subscribe", "signup", "popup", "modal", "overlay", "login",
    "search", "share", "social", "breadcrumb", "breadcrumbs", "pagination", "pager", "tags", "meta", "byline", "author", "toolbar", "skip",
    "hidden",
)
COMMENT_NAMES = (
    "comments", "comment", "comment list", "comment body", "replies", "reply", "discussion", "respond", "disqus", "feedback", "reviews",
    "responses",
)


# Elements of main text in the layouts, as often as paragraphs; every entry is drawn alike.
SHAPES = (
    ("p",), ("p",), ("p",), ("p",), ("div",), ("blockquote", "p"), ("ul", "li"), ("ul", "li"), ("ol", "li"), ("ul", "li", "p"), ("pre",), ("pre",),
    ("table", "tr", "td"), ("table", "tbody", "tr", "td"), ("table", "thead", "tr", "th"), ("dl", "dd"), ("dl", "dd"), ("figure", "figcaption"),
    ("figure", "figcaption"), ("figure", "pre"), ("h2",), ("h3",), ("section", "h2"), ("details", "summary"),
)
HEADER_NAMES = ((), (), ("entry", "header"), ("post", "header"), ("header",), ("article", "title"))
# Words in names of elements around the article that only say what the page has.
PAGE_NAMES = (
    "has sidebar", "header fixed", "with sidebar", "single post", "site content", "home page", "no sidebar", "main wrapper", "page single",
    "sidebar right", "footer sticky", "nav open", "layout", "menu closed", "content area", "search enabled",
)


@dataclass(frozen=True)
class Crf:
    weights: np.ndarray  # bucket x label
    moves: np.ndarray  # label x label
    start: np.ndarray


def _bucket(*parts: object) -> int:
    return zlib.crc32("\t".join(map(str, parts)).encode()) % BUCKETS


Path = tuple[tuple[str, tuple[str, ...]], ...]


def split_path(path: Path) -> tuple[Path, Path]:
    """The elements around the article or main element of a block, and that element with all below it.

    That is the outermost ``article`` (one inside another is a comment or the like) or else the innermost ``main``.
    Without either the second part is empty. Names of ``html`` and ``body`` are left out.
    """
    path = tuple((t, ()) if t in ("html", "body") else (t, names) for t, names in path)
    tags = [t for t, _ in path]
    if "article" in tags:
        at = tags.index("article")
    elif "main" in tags:
        at = len(tags) - 1 - tags[::-1].index("main")
    else:
        return path, ()
    return path[:at], path[at:]


def _markup(path: Path) -> list[int]:
    around, inside = split_path(path)
    out = []
    for place, part in (("around", around), ("", inside)) if inside else (("", around),):
        out += [_bucket(place + "tag", t) for t in {t for t, _ in part}]
        out += [_bucket(place + "name", n) for n in {n for _, names in part for n in names}]
    part = inside or around
    out += [_bucket("near", n) for n in next((names for _, names in reversed(part) if names), ())]
    # a header or figure is read with the names around it
    named: tuple[str, ...] = ()
    for tag, names in part:
        if tag in EITHER_TAGS:
            out += [_bucket("under", bool(inside), tag, n) for n in named or ("",)]
        named = names or named
    return [*out, _bucket("leaf", bool(inside), *(t for t, _ in part[-1:])), _bucket("pair", *(t for t, _ in part[-2:]))]


def block_features(blocks: list[Block]) -> list[list[int]]:
    """Hashed features of every block of a page."""
    out = []
    cached: dict[Path, list[int]] = {}
    for i, block in enumerate(blocks):
        markup = cached.get(block.path)
        if markup is None:
            markup = cached[block.path] = _markup(block.path)
        text = block.text
        words = text.count(" ") + 1
        share = min(block.linked, len(text)) / len(text)
        out.append(
            [
                *markup, _bucket("bias"), _bucket("words", words.bit_length()), _bucket("links", int(share * 4 + 0.5)),
                _bucket("end", text[-1] if not text[-1].isalnum() else "a"), _bucket("upper", text[0].isupper(), words > 6),
                _bucket("first", i == 0), _bucket("last", i == len(blocks) - 1),
            ]
        )
    return out


def markup_labels(blocks: list[Block]) -> list[int]:
    """1 for blocks in an article or main element that is in no part of another kind, nor are they inside it."""
    def label(block: Block) -> int:
        around, inside = split_path(block.path)
        if not inside:
            return 0
        names = {n for _, each in inside[1:] for n in each} | ({n for n in inside[0][1]} & _COMMENTS)
        return int(not {t for t, _ in (*around, *inside)} & OTHER_TAGS and not names & _OUTSIDE)

    return [label(b) for b in blocks]


_OUTSIDE = frozenset(w for n in (*OTHER_NAMES, *COMMENT_NAMES) for w in n.split()) - {"body", "list", "main", "header"}
_COMMENTS = frozenset(w for n in COMMENT_NAMES for w in n.split()) - {"body", "list"}


def layout(content: list[str], other: list[str], rng: random.Random) -> list[tuple[Block, int]]:
    """A page drawn by rule: the content in one container, other texts around and inside it, with labels."""
    out: list[tuple[Block, int]] = []
    base = [("html", ()), ("body", ())]
    for _ in range(rng.randint(0, 2)):
        base.append(("div", tuple(rng.choice(("wrapper", "container", "page", "site", "row", "col", "inner", "outer", "layout", rng.choice(PAGE_NAMES))).split())))
    holder = rng.choice(
        [("article", ()), ("main", ()), *[(rng.choice(("div", "div", "section", "article", "main", "td")), tuple(rng.choice(CONTENT_NAMES).split()))] * 4]
    )

    def part(name: str, words: tuple[str, ...], inside: list, n: int, long: bool) -> None:
        item = rng.choice(("p", "li", "div", "span", "span", "td", "button", "h1", "h2", "h3") if not long else ("p", "p", "div", "li", "span", "h2"))
        # teasers are articles too
        teaser = [("article", ())] if name in ("aside", "nav", "footer") and not words and rng.random() < 0.15 else []
        for _ in range(n):
            text = rng.choice(content) if long else rng.choice(other)
            text = text if long or rng.random() < 0.7 else " ".join(text.split()[: rng.randint(1, 4)])
            link = len(text) if not long and rng.random() < 0.5 else 0
            out.append((Block(text, (*inside, (name, words), *teaser, *([(item, ())] if item != "span" else [])), link), 0))

    def surroundings(inside: list, most: int) -> None:
        for _ in range(rng.randint(0, most)):
            kind = rng.random()
            if kind < 0.35:
                part(rng.choice(("nav", "aside", "footer", "header", "form")), (), inside, rng.randint(1, 5), rng.random() < 0.2)
            elif kind < 0.75:
                part(rng.choice(("div", "section", "ul", "aside", "p")), tuple(rng.choice(OTHER_NAMES).split()), inside, rng.randint(1, 4), rng.random() < 0.35)
            else:
                part(rng.choice(("div", "section", "ol", "ul")), tuple(rng.choice(COMMENT_NAMES).split()), inside, rng.randint(1, 4), rng.random() < 0.8)

    def piece(text: str, leaf: tuple[str, ...], link: int = 0) -> None:
        names = rng.choice(HEADER_NAMES)
        out.append((Block(text, (*inner, *((t, names if t == "header" else ()) for t in leaf)), link), 1))

    def short(text: str) -> str:
        return " ".join(text.split()[: rng.randint(1, 8)])

    surroundings(base, 3)
    around = [*base, ("main", ())] if holder[0] == "article" and rng.random() < 0.4 else base
    inner = [*around, holder]
    for i, text in enumerate(content):
        if i and rng.random() < 0.25:
            surroundings(inner, 1)
        if not i:
            piece(text, rng.choice((("h1",), ("h2",), ("p",), ("header", "h1"), ("header", "h2"), ("header", "div", "h1"))))
            continue
        shape = rng.choice(SHAPES)
        if shape in (("p",), ("div",), ("blockquote", "p"), ("pre",), ("figure", "pre")):
            piece(text, shape, len(text) // 5 if rng.random() < 0.1 else 0)
            continue
        for _ in range(rng.randint(1, 4)):  # items, cells, captions and headings: whole texts and short ones
            leaf = ("dl", rng.choice(("dt", "dd"))) if shape == ("dl", "dd") else shape
            words = text if rng.random() < 0.5 else short(text)
            piece(words, leaf, len(words) if rng.random() < 0.1 else 0)
    if rng.random() < 0.3:
        surroundings(inner, 2)
    if around is not base:
        surroundings(around, 1)
    surroundings(base, 3)
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - most).sum(axis=axis)) + most.squeeze(axis)


def fit(pages: list[tuple[list[list[int]], list[int]]], epochs: int = 5, step: float = 0.5, penalty: float = 1e-4, seed: int = 5) -> Crf:
    """AdaGrad on the log-likelihood, page by page."""
    weights, moves, start = np.zeros((BUCKETS, 2)), np.zeros((2, 2)), np.zeros(2)
    seen_w, seen_m, seen_s = np.full((BUCKETS, 2), 1e-2), np.full((2, 2), 1e-2), np.full(2, 1e-2)
    pages = [(f, y) for f, y in pages if f]
    if not pages:
        weights[[_bucket("tag", t) for t in CONTENT_TAGS], 1] = 1.0
        weights[_bucket("bias"), 0] = 0.5
        return Crf(weights, moves, start)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for p in rng.permutation(len(pages)):
            feats, labels = pages[p]
            n = len(feats)
            emit = np.stack([weights[f].sum(0) for f in feats])
            ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
            ahead[0] = start + emit[0]
            for i in range(1, n):
                ahead[i] = emit[i] + _log_sum(ahead[i - 1][:, None] + moves, 0)
            for i in range(n - 2, -1, -1):
                back[i] = _log_sum(moves + (emit[i + 1] + back[i + 1])[None, :], 1)
            total = _log_sum(ahead[-1], 0)
            grad = np.exp(ahead + back - total)
            grad[np.arange(n), labels] -= 1
            step_m = np.zeros((2, 2))
            if n > 1:
                both = ahead[:-1, :, None] + moves[None] + (emit[1:] + back[1:])[:, None, :] - total
                step_m = np.exp(both).sum(0)
                np.subtract.at(step_m, (labels[:-1], labels[1:]), 1)
            flat = np.concatenate([np.asarray(f) for f in feats])
            used, inverse = np.unique(flat, return_inverse=True)
            each = np.repeat(grad, [len(f) for f in feats], axis=0)
            grad_w = np.stack([np.bincount(inverse, weights=each[:, k]) for k in range(2)], 1) + penalty * weights[used]
            seen_w[used] += grad_w**2
            weights[used] -= step * grad_w / np.sqrt(seen_w[used])
            seen_m += step_m**2
            moves -= step * step_m / np.sqrt(seen_m)
            seen_s += grad[0] ** 2
            start -= step * grad[0] / np.sqrt(seen_s)
    return Crf(weights, moves, start)


def viterbi(model: Crf, feats: list[list[int]]) -> list[int]:
    """The likeliest labels; of equally likely ones the first."""
    if not feats:
        return []
    flat = np.concatenate([np.asarray(f) for f in feats])
    begin = np.cumsum([0, *(len(f) for f in feats[:-1])])
    emit = np.add.reduceat(model.weights[flat], begin, axis=0).tolist()
    (m00, m01), (m10, m11) = model.moves.tolist()
    best0, best1 = model.start[0] + emit[0][0], model.start[1] + emit[0][1]
    steps = []
    for e0, e1 in emit[1:]:
        from0, from1 = int(best1 + m10 > best0 + m00), int(best1 + m11 > best0 + m01)
        steps.append((from0, from1))
        best0, best1 = e0 + (best1 + m10 if from0 else best0 + m00), e1 + (best1 + m11 if from1 else best0 + m01)
    label = int(best1 > best0)
    out = [label]
    for move in reversed(steps):
        label = move[label]
        out.append(label)
    return out[::-1]


def training_pages(pages: list[str | None], per_page: int = 5, seed: int = 3) -> list[tuple[list[list[int]], list[int]]]:
    """Labelled sequences from pages: as they are, where they have main text, and poured into layouts."""
    rng = random.Random(seed)
    read = [leaf_blocks(p) for p in pages]
    labelled = [(b, markup_labels(b)) for b in read]
    other = [x.text for b, y in labelled for x, k in zip(b, y, strict=True) if not k] or ["menu"]
    out = []
    for blocks, labels in labelled:
        content = [x.text for x, k in zip(blocks, labels, strict=True) if k]
        if not content:
            continue
        out.append((block_features(blocks), labels))
        for _ in range(per_page):
            drawn = layout(content, other, rng)
            out.append((block_features([b for b, _ in drawn]), [k for _, k in drawn]))
    return out


def main_text(model: Crf, page: str | None) -> str:
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, k in zip(blocks, viterbi(model, block_features(blocks)), strict=True) if k)


def train(pages: DataFrame, html: str = "html", key: str = "url", max_pages: int = 300) -> Crf:
    """Fit on at most ``max_pages`` distinct pages, those whose ``key`` hashes lowest.

    Only hashes are compared over all pages; the texts of the picked ones are then fetched, once each.
    """
    hashed = pages.where(F.col(html).isNotNull()).select(
        F.xxhash64(key).alias("h"), F.xxhash64(html).alias("d"), F.col(html).cast("string").alias("page")
    )
    picked = hashed.select("h", "d").distinct().orderBy("h", "d").limit(max_pages)
    texts = hashed.join(F.broadcast(picked), ["h", "d"]).groupBy("h", "d").agg(F.min("page").alias("page"))
    rows = sorted((r.h, r.d, r.page) for r in texts.collect())
    return fit(training_pages([page for _, _, page in rows]))


def _extract(rows: Iterator[pa.RecordBatch], keep: list[str], model: Crf) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        texts = [main_text(model, p.as_py()) for p in batch.column("__html")]
        columns = [*(batch.column(k) for k in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*keep, "text", "n_chars"])


@kept_apart()
def extract_main_text(pages: DataFrame, model: Crf, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages`` (columns ``keep``, default all) with ``text`` and ``n_chars``; columns of these names give way."""
    keep = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars")]
    source = small_batches(pages.select(*[pages[c] for c in keep], pages[html].cast("string").alias("__html")))
    schema = source.drop("__html").schema.add("text", "string").add("n_chars", "long")
    return source.mapInArrow(lambda rows: _extract(rows, keep, model), schema)
