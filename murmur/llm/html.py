"""Main text of web pages: a recurrent labeller of leaf blocks.

A page is cut into leaf blocks. Each block is read as hashed tag-path tokens and hashed
words, and a bidirectional LSTM over all blocks of the page says which belong to the
article, so every decision sees the whole document. The network is numpy, trained on a
bounded sample of pages, whose labels come from the sectioning elements of well-formed pages.
Before training, sample pages get other layouts: containers renamed,
and menus, notices, adverts, forms and comments put in around and inside the article.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.llm import textops

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|title|textarea|iframe)\b[^>]*>.*?(?:</\1\b[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|([^<]+|<)", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z0-9]+")

# Elements that don't end a line of text, and elements without content.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_ITSELF = frozenset("p li dt dd tr td th option".split())
MAX_DEPTH = 256

# Elements whose content isn't text, though it is markup; and elements that such a one can't hold if it has no end.
HIDDEN = ("noscript", "template", "select", "svg", "object")
BREAKS_OUT = frozenset("address article aside blockquote body center dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li "
                       "main nav ol p pre section table td th tr ul".split())
_HIDDEN_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in HIDDEN}


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int  # characters inside links


@dataclass
class _Open:
    tag: str
    tokens: tuple[str, ...]


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order: text between block elements or line breaks.

    Character references are decoded, white space becomes one space, blocks without text are left
    out. Comments, scripts, styles, titles and form fields aren't text. Unclosed and stray tags
    are borne: a closing tag without its opening is ignored; a comment, script, style, title, text area or frame without end
    runs to the end, as browsers read it, any other form field, drawing, template or object only to the end of the element around it or to
    the next paragraph, section or the like. NULL and empty pages have no blocks.
    """
    page = page or ""
    out: list[Block] = []
    endless: set[str] = set()
    hidden = resume = 0
    stack: list[_Open] = []
    held: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            out.append(Block(tuple(t for e in stack for t in e.tokens), text, linked))
        held.clear()
        linked = 0

    for match in _MARKUP.finditer(page):
        if match.start() < resume:
            continue
        text = match[5]
        if text is not None:
            if hidden:
                continue
            text = entities.unescape(text)
            held.append(text)
            if links:
                linked += len(text)
            continue
        tag = match[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _HIDDEN_END and not match[2]:
            if match[4].endswith("/"):
                continue
            end = None if tag in endless else _HIDDEN_END[tag].search(page, match.end())
            if end:
                resume = end.end()
                continue
        if tag not in INLINE:
            flush()
        if match[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    links -= sum(e.tag == "a" for e in stack[i:])
                    hidden -= sum(e.tag in endless for e in stack[i:])
                    del stack[i:]
                    break
            continue
        if tag in VOID or match[4].endswith("/"):
            continue
        if tag in _HIDDEN_END:  # has no end
            endless.add(tag)
            hidden += len(stack) < MAX_DEPTH
        elif hidden and tag in BREAKS_OUT:
            first = next(i for i, e in enumerate(stack) if e.tag in endless)
            links -= sum(e.tag == "a" for e in stack[first:])
            del stack[first:]
            hidden = 0
        if tag in CLOSES_ITSELF and stack and stack[-1].tag == tag:
            stack.pop()
        if len(stack) < MAX_DEPTH:
            names = [x for a in _ATTRIBUTE.findall(match[4]) for x in _NAME.findall("".join(a).lower())]
            stack.append(_Open(tag, (tag, *(f".{n}" for n in names[:16]))))
            links += tag == "a"
    flush()
    return out


@dataclass(frozen=True)
class Settings:
    """``sample_pages`` of at most ``sample_bytes`` each train the network."""

    sample_pages: int = 400
    sample_bytes: int = 1 << 16
    path_buckets: int = 512
    word_buckets: int = 1024
    path_size: int = 16
    word_size: int = 8
    hidden: int = 16
    epochs: int = 10
    batch: int = 32
    rate: float = 0.01
    steps: int = 96
    seed: int = 7


_EXTRA = 4


@dataclass
class Features:
    """Blocks of some pages, one after another."""

    path: np.ndarray  # buckets of path tokens, flat
    path_bounds: np.ndarray
    words: np.ndarray  # buckets of words, flat
    word_bounds: np.ndarray
    extra: np.ndarray


_bucket_cache: dict[str, int] = {}


def _bucket(token: str) -> int:
    if token not in _bucket_cache:
        if len(_bucket_cache) > 100_000:
            _bucket_cache.clear()
        _bucket_cache[token] = zlib.crc32(token.encode())
    return _bucket_cache[token]


def features(found: Sequence[Block], settings: Settings) -> Features:
    path = np.fromiter((_bucket(t) for b in found for t in b.path), np.int64) % settings.path_buckets
    words = textops.split_words([b.text.encode("utf-8", "replace") for b in found], lower=True)
    sizes = np.array([len(b.text) for b in found], float)
    linked = np.array([b.linked for b in found], float)
    counts = words.counts
    extra = np.stack([np.log1p(sizes) / 5, np.minimum(linked / np.maximum(sizes, 1), 1), np.log1p(counts) / 4,
                      np.ones(len(found))], axis=1) if len(found) else np.zeros((0, _EXTRA))
    return Features(path, np.concatenate([[0], np.cumsum([len(b.path) for b in found])]).astype(np.int64),
                    (words.hashes % np.uint64(settings.word_buckets)).astype(np.int64), words.bounds, extra)


def _means(table: np.ndarray, buckets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros((len(buckets) + 1, table.shape[1]))
    np.cumsum(table[buckets], axis=0, out=sums[1:])
    return (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """Embeddings, two LSTMs and a logistic output."""

    settings: Settings
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, settings: Settings) -> Network:
        random = np.random.Generator(np.random.PCG64(settings.seed))
        size, hidden = settings.path_size + settings.word_size + _EXTRA, settings.hidden
        weights = {"path": random.normal(0, 0.3, (settings.path_buckets, settings.path_size)),
                   "word": random.normal(0, 0.3, (settings.word_buckets, settings.word_size)),
                   "out": random.normal(0, 0.2, (2 * hidden + size, 1)), "bias": np.zeros(1)}
        for way in ("forth", "back"):
            weights[way] = random.normal(0, 0.2, (size + hidden, 4 * hidden))
            weights[f"{way}_bias"] = np.concatenate([np.ones(hidden), np.zeros(3 * hidden)])
        return cls(settings, weights)

    def inputs(self, f: Features) -> np.ndarray:
        w = self.weights
        return np.concatenate([3 * _means(w["path"], f.path, f.path_bounds), _means(w["word"], f.words, f.word_bounds), f.extra], axis=1)

    def _walk(self, x: np.ndarray, mask: np.ndarray, way: str, keep: bool) -> tuple[np.ndarray, list]:
        """One LSTM over (steps, pages, size); a page's state stands still outside its blocks."""
        w, bias, hidden = self.weights[way], self.weights[f"{way}_bias"], self.settings.hidden
        h = np.zeros((x.shape[1], hidden))
        c = np.zeros_like(h)
        out, tape = np.zeros((*x.shape[:2], hidden)), []
        order = range(len(x)) if way == "forth" else range(len(x) - 1, -1, -1)
        given = x @ w[:x.shape[2]] + bias
        for t in order:
            gates = given[t] + h @ w[x.shape[2]:]
            f, i, o = (_sigmoid(gates[:, k * hidden:(k + 1) * hidden]) for k in range(3))
            g = np.tanh(gates[:, 3 * hidden:])
            m = mask[t][:, None]
            c_new = f * c + i * g
            th = np.tanh(c_new)
            if keep:
                tape.append((t, h, c, f, i, o, g, th, m))
            h, c = np.where(m, o * th, h), np.where(m, c_new, c)
            out[t] = h
        return out, tape

    def _unwalk(self, x: np.ndarray, grad: np.ndarray, tape: list, way: str, grads: dict) -> np.ndarray:
        w, hidden, size = self.weights[way], self.settings.hidden, x.shape[2]
        dx = np.zeros_like(x)
        dh, dc = np.zeros((x.shape[1], hidden)), np.zeros((x.shape[1], hidden))
        for t, h, c, f, i, o, g, th, m in reversed(tape):
            dh = dh + grad[t]
            own = np.where(m, dh, 0)
            dcn = np.where(m, dc, 0) + own * o * (1 - th * th)
            dg = np.concatenate([dcn * c * f * (1 - f), dcn * g * i * (1 - i), own * th * o * (1 - o), dcn * i * (1 - g * g)], axis=1)
            grads[way][:size] += x[t].T @ dg
            grads[way][size:] += h.T @ dg
            grads[f"{way}_bias"] += dg.sum(0)
            dx[t] = dg @ w[:size].T
            dh = dg @ w[size:].T + np.where(m, 0, dh)
            dc = dcn * f + np.where(m, 0, dc)
        return dx

    def _padded(self, x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.diff(bounds)
        steps = int(counts.max()) if len(counts) else 0
        mask = np.arange(steps)[:, None] < counts[None]
        padded = np.zeros((steps, len(counts), x.shape[1]))
        padded[mask] = x[(bounds[:-1][None] + np.arange(steps)[:, None])[mask]]
        return padded, mask

    def logits(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """One for each block; ``bounds`` cuts the blocks into pages."""
        padded, mask = self._padded(x, bounds)
        states = [self._walk(padded, mask, way, False)[0] for way in ("forth", "back")]
        z = (np.concatenate([*states, padded], axis=2) @ self.weights["out"])[:, :, 0] + self.weights["bias"]
        out = np.zeros(len(x))
        out[(bounds[:-1][None] + np.arange(len(mask))[:, None])[mask]] = z[mask]
        return out

    def learn(self, pages: list[tuple[list[Block], np.ndarray]]) -> None:
        """Adam on the logistic loss, page batches in a seeded order."""
        settings, w = self.settings, self.weights
        random = np.random.Generator(np.random.PCG64(settings.seed + 1))
        cut = [(b[i:i + settings.steps], y[i:i + settings.steps]) for b, y in pages for i in range(0, len(b), settings.steps)]
        ready = [(features(b, settings), y) for b, y in cut]
        first = {k: np.zeros_like(v) for k, v in w.items()}
        second = {k: np.zeros_like(v) for k, v in w.items()}
        step = 0
        for _ in range(settings.epochs):
            order = random.permutation(len(ready))
            for low in range(0, len(order), settings.batch):
                chosen = [ready[i] for i in order[low:low + settings.batch]]
                grads = self._gradients(chosen)
                step += 1
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    w[k] -= settings.rate * first[k] / (1 - 0.9 ** step) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)

    def _gradients(self, chosen: list[tuple[Features, np.ndarray]]) -> dict[str, np.ndarray]:
        w, settings = self.weights, self.settings
        xs = [self.inputs(f) for f, _ in chosen]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in xs])])
        x, mask = self._padded(np.concatenate(xs), bounds)
        places = (bounds[:-1][None] + np.arange(len(mask))[:, None])[mask]
        wanted = np.zeros(mask.shape)
        wanted[mask] = np.concatenate([y for _, y in chosen])[places]
        forth, tape_f = self._walk(x, mask, "forth", True)
        back, tape_b = self._walk(x, mask, "back", True)
        joined = np.concatenate([forth, back, x], axis=2)
        z = (joined @ w["out"])[:, :, 0] + w["bias"]
        dz = np.where(mask, _sigmoid(z) - wanted, 0) / mask.sum()
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        grads["out"] = np.einsum("tpk,tp->k", joined, dz)[:, None]
        grads["bias"] = np.array([dz.sum()])
        dj = dz[:, :, None] * w["out"][:, 0]
        hidden = settings.hidden
        dx = dj[:, :, 2 * hidden:].copy()
        dx += self._unwalk(x, dj[:, :, :hidden], tape_f, "forth", grads)
        dx += self._unwalk(x, dj[:, :, hidden:2 * hidden], tape_b, "back", grads)
        flat = np.zeros((int(bounds[-1]), x.shape[2]))
        flat[places] = dx[mask]
        for (f, _), low, high in zip(chosen, bounds[:-1], bounds[1:], strict=True):
            for name, buckets, cuts, a, b, scale in (
                    ("path", f.path, f.path_bounds, 0, settings.path_size, 3.0),
                    ("word", f.words, f.word_bounds, settings.path_size, settings.path_size + settings.word_size, 1.0)):
                counts = np.diff(cuts)
                share = scale * flat[low:high, a:b] / np.maximum(counts, 1)[:, None]
                np.add.at(grads[name], buckets, np.repeat(share, counts, axis=0))
        return grads


# What marks sections that aren't the article, and names that articles' containers have.
SECTIONS = ("nav", "aside", "footer", "header", "form", "menu", "dialog")
MARKS = ("ad", "ads", "advert", "advertisement", "banner", "sponsor", "promo", "sidebar", "menu", "nav", "navbar", "breadcrumb",
         "cookie", "notice", "alert", "consent", "popup", "modal", "newsletter", "subscribe", "signup", "login", "share", "social",
         "related", "recommended", "comments", "comment", "reply", "discussion", "footer", "header", "copyright", "widget", "tags")
ARTICLES = ('article', 'main', 'div class="content"', 'div class="post-content"', 'div id="content"', 'div class="entry-content"',
            'section class="article-body"', 'div class="story"', 'div id="main" role="main"', 'article class="post"')


def _teacher(path: Sequence[str]) -> bool:
    """Whether a well-formed page's sections put a block into the article."""
    inside = any(t in ("article", "main") for t in path)
    return inside and not any(t in SECTIONS or t[1:] in MARKS for t in path if t[0] == "." or t in SECTIONS)


def _outside_sections(path: Sequence[str]) -> bool:
    """Whether a block lies in no section or container that isn't an article by its name."""
    return not any(t in SECTIONS or t[1:] in MARKS for t in path if t[0] == "." or t in SECTIONS)


def _varied(page: str, texts: list[str], random: np.random.Generator) -> tuple[str, str]:
    """A page with boilerplate put in, and the same with another container: the first can still be labelled."""
    def pick(options: Sequence) -> str:
        return options[int(random.integers(len(options)))]

    def words(most: int) -> str:
        return " ".join(pick(texts).split()[:int(random.integers(1, most))]) or "more"

    def section() -> str:
        mark, kind = pick(MARKS), int(random.integers(6))
        if kind == 0:
            tag = pick(("nav", "aside", f'div class="{mark}"'))
            links = "".join(f'<li><a href="#">{words(5)}</a></li>' for _ in range(int(random.integers(2, 7))))
            return f"<{tag}><ul>{links}</ul></{tag.split()[0]}>"
        if kind == 1:
            return f"<form><label>{words(6)}</label><input><button>{words(3)}</button></form>"
        if kind == 2:
            tag = pick(("section", "div"))
            said = "".join(f'<div class="comment"><p>{words(60)}</p></div>' for _ in range(int(random.integers(1, 5))))
            return f'<{tag} id="comments"><h2>{words(4)}</h2>{said}</{tag}>'
        if kind == 3:
            tag = pick(SECTIONS)
            return f"<{tag}><p>{words(40)}</p></{tag}>"
        tag, joint = pick(("div", "section", "ul", "p")), pick(("", "-box", " block", "-bar", "_wrap"))
        return f'<{tag} {pick(("class", "id"))}="{mark}{joint}">{words(50)}</{tag}>'

    opened, closed = re.search(r"<article[^>]*>", page), page.rfind("</article>")
    if not opened or closed < 0:
        return page, page
    inner = page[opened.end():closed]
    spots = [m.end() for m in re.finditer(r"</p>", inner)]
    for spot in sorted((s for s in spots if random.random() < 0.15), reverse=True):
        inner = f"{inner[:spot]}{section()}{inner[spot:]}"
    before = "".join(section() for _ in range(int(random.integers(0, 4))))
    after = "".join(section() for _ in range(int(random.integers(0, 4))))
    made = [f"{page[:opened.start()]}{before}<{name}>{inner}</{name.split()[0]}>{after}{page[closed + 10:]}"
            for name in ("article", pick(ARTICLES))]
    return made[0], made[1]


def _least_hashed(hashed: DataFrame, n: int) -> list:
    """The ``n`` rows of least ``h``, an even 64-bit hash: those below a bound that leaves a few more than ``n``."""
    total = hashed.count()
    share = (n + 10 * n**0.5 + 10) / max(total, 1)
    while True:
        below = hashed if share >= 1 else hashed.where(F.col("h") <= int(-(1 << 63) + share * (1 << 64)))
        rows = below.orderBy("h", "key", F.xxhash64("html")).limit(n).collect()
        if len(rows) == n or share >= 1:
            return rows
        share *= 4


def train(df: DataFrame, key_col: str = "page_id", html_col: str = "html", settings: Settings = Settings()) -> Network:
    """Train on a bounded sample: the pages of least key hash, at most ``sample_bytes`` characters long.

    The driver gets ``sample_pages`` pages: pages are counted first, which gives a bound on the hash, and partitions send only
    what lies below it. Where no page of the sample has an ``article`` or ``main`` element, what lies outside sections and
    containers known by name (menus, footers, adverts, comments and so on) is taken for the article. An empty
    sample leaves the network untrained.
    """
    fit = (F.length(df[html_col]) > 0) & (F.length(df[html_col]) <= settings.sample_bytes)
    hashed = df.where(fit).select(F.xxhash64(df[key_col]).alias("h"), df[key_col].alias("key"), df[html_col].alias("html"))
    rows = _least_hashed(hashed, settings.sample_pages)
    random = np.random.Generator(np.random.PCG64(settings.seed + 2))
    texts = [b.text for r in rows for b in blocks(r["html"])]
    pages = []
    teacher = _teacher if any(_teacher(b.path) for r in rows for b in blocks(r["html"])) else _outside_sections
    for row in rows:
        plain = blocks(row["html"])
        variants = [(plain, plain)]
        if texts:
            marked, renamed = _varied(row["html"], texts, random)
            variants.append((blocks(marked), blocks(renamed)))
        for labelled, shown in variants:
            labels = np.array([teacher(b.path) for b in labelled], float)
            if labels.any() and len(labelled) == len(shown):
                pages.append((shown, labels))
    network = Network.fresh(settings)
    if pages:
        network.learn(pages)
    return network


RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()),
                       T.StructField("n_blocks", T.LongType())])


def extract(df: DataFrame, network: Network, html_col: str = "html", keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """Main text of every whole page.

    Columns: ``keep``, ``text`` (article blocks in page order, joined by one space), ``n_chars``, ``n_blocks``
    (all blocks of the page). One row comes back per row. NULL and empty pages, and pages without a block, have
    the empty text. The network has a fixed size and goes to the tasks; nothing is shuffled.
    """
    shared = df.sparkSession.sparkContext.broadcast(network)

    def make() -> Callable[[list[bytes | None]], list]:
        net = shared.value

        def work(pages: list[bytes | None]) -> list:
            found = [blocks((p or b"").decode("utf-8", "replace")) for p in pages]
            kept = _kept(net, found)
            texts = [" ".join(b.text for b, k in zip(bs, ks, strict=True) if k) for bs, ks in zip(found, kept, strict=True)]
            return [texts, [len(t) for t in texts], [len(bs) for bs in found]]

        return work

    return textops.map_texts(df, html_col, keep, RESULT, make)


def _kept(network: Network, found: list[list[Block]]) -> list[np.ndarray]:
    """Which blocks of each page are article; pages of like length are walked together."""
    order = sorted(range(len(found)), key=lambda i: len(found[i]))
    kept: list[np.ndarray] = [np.zeros(0, bool)] * len(found)
    for group in _groups(order, found):
        x = network.inputs(features([b for i in group for b in found[i]], network.settings))
        bounds = np.concatenate([[0], np.cumsum([len(found[i]) for i in group])])
        if not len(x):
            continue
        good = network.logits(x, bounds) > 0
        for i, low, high in zip(group, bounds[:-1], bounds[1:], strict=True):
            kept[i] = good[low:high]
    return kept


def _groups(order: list[int], found: list[list[Block]], cells: int = 1 << 14) -> Iterator[list[int]]:
    group: list[int] = []
    for i in order:
        if group and (len(group) + 1) * len(found[i]) > cells:
            yield group
            group = []
        group.append(i)
    if group:
        yield group
