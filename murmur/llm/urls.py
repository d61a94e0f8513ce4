"""URL filters: glob rules packed into multiword Shift-And masks.

All patterns are read at once. Every literal of every pattern owns one bit of a
vector of 64-bit words; a step over one byte is a shift, an AND with the byte's mask,
and an OR with the bits that a star keeps alive. A batch of URLs takes each step
together, so the cost follows the bytes read, not the number of rules below 64 a word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from murmur.llm import textops


@dataclass(frozen=True)
class SiteRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``; the longest rule wins."""

    verdict: str
    host: str
    path: str

    @property
    def label(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class GlobRule:
    """A glob over host and path: ``*`` any bytes, ``?`` one byte, ``{sub}`` nothing or labels ending in a dot.

    ``{sub}`` may stand at the front only, and doesn't reach past the host.
    """

    verdict: str
    glob: str


#: At most so many bytes of state are stepped together.
STATE_BYTES = 8 << 20
_SUB = "{sub}"
_ANY, _HOST = 1, 2  # what a star keeps alive: every byte, or every byte but a slash


class Automaton:
    """Anchored matching of many globs at once.

    Bit ``first + j`` of a pattern means that its first j bytes are matched. A star
    after byte j keeps that bit; so does the host part of ``{sub}``, whose branch
    with labels is a pattern of its own (any host bytes, a dot, the rest).
    """

    def __init__(self, globs: Sequence[str]):
        variants = []
        for i, glob in enumerate(globs):
            body = glob.removeprefix(_SUB)
            if _SUB in body:
                raise ValueError(f"{glob}: {_SUB} stands at the front only")
            variants.append((i, body, 0))
            if body != glob:
                variants.append((i, "." + body, _HOST))
        bits = sum(len(body.encode()) + 1 for _, body, _ in variants)
        words = max(1, -(-bits // 64))
        step = np.zeros((256, words * 64), bool)
        stay = np.zeros((256, words * 64), bool)
        begin = np.zeros(words * 64, bool)
        self.ends: list[tuple[int, int]] = []
        at = 0
        for i, body, front in variants:
            begin[at] = True
            if front == _HOST:
                stay[:, at] = True
                stay[ord("/"), at] = False
            for byte in body.encode():
                if byte == ord("*"):
                    stay[:, at] = True
                    continue
                at += 1
                step[:, at] = byte == ord("?")
                step[byte, at] = True
            self.ends.append((at, i))
            at += 1
        self.step, self.stay = self._pack(step), self._pack(stay)
        self.begin = self._pack(begin[None])[0]
        self.patterns = len(globs)

    @staticmethod
    def _pack(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)

    def matches(self, texts: Sequence[bytes]) -> np.ndarray:
        """A row for each text: which patterns match all of it. Texts take their steps in blocks, so that thousands of patterns fit in memory."""
        block = max(1, STATE_BYTES // (8 * len(self.begin)))
        if len(texts) <= block:
            return self._matches(texts)
        return np.concatenate([self._matches(texts[i:i + block]) for i in range(0, len(texts), block)])

    def _matches(self, texts: Sequence[bytes]) -> np.ndarray:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        flat = np.frombuffer(b"".join(texts), np.uint8)
        starts = (np.cumsum(lengths) - lengths)[order]
        state = np.tile(self.begin, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        active = len(texts)
        for position in range(int(sizes[0]) if len(texts) else 0):
            while active and sizes[active - 1] <= position:
                active -= 1
            byte = flat[starts[:active] + position]
            now = state[:active]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:active] = (moved & self.step[byte]) | (now & self.stay[byte])
        found = np.zeros((len(texts), self.patterns), bool)
        for bit, pattern in self.ends:
            found[order, pattern] |= (state[:, bit // 64] >> np.uint64(bit % 64)) & one == one
        return found


RESULT = T.StructType([
    T.StructField("host", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("rule", T.StringType()), T.StructField("glob_rule", T.StringType()),
    T.StructField("verdict", T.StringType()),
])


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    stop = min((i for i in (tail.find(c) for c in "?#") if i >= 0), default=len(tail))
    return host.translate(_LOWER), tail[:stop]


_LOWER = {c: c + 32 for c in range(65, 91)}


def site_rules(rules: DataFrame) -> list[SiteRule]:
    """Site rules from a table ``(verdict, host, path)``, in the order of its rows by ``position`` if it has one. At most ``MOST_RULES``."""
    return [SiteRule(r["verdict"], r["host"], r["path"]) for r in _rule_rows(rules, "verdict", "host", "path")]


def glob_rules(rules: DataFrame) -> list[GlobRule]:
    """Glob rules from a table ``(verdict, glob)``, as ``site_rules``."""
    return [GlobRule(r["verdict"], r["glob"]) for r in _rule_rows(rules, "verdict", "glob")]


MOST_RULES = 50_000


def _rule_rows(rules: DataFrame, *columns: str) -> list:
    ordered = rules.orderBy("position") if "position" in rules.columns else rules
    if rules.where(reduce(lambda a, b: a | b, (rules[c].isNull() for c in columns))).limit(1).count():
        raise ValueError("a rule lacks a value")
    rows = ordered.select(*columns).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return rows


def judge(df: DataFrame, site_rules: Sequence[SiteRule], glob_rules: Sequence[GlobRule], url_col: str = "url",
          keep: Sequence[str] = ("page_id",), default: str = "allow") -> DataFrame:
    """Host, path, fitting site rule, fitting glob and verdict of every URL.

    The longest fitting site rule decides, of two equally long the first listed.
    Where none fits, the first fitting glob rule decides, else ``default``. ``rule`` and
    ``glob_rule`` are NULL where none fits.

    One row comes back per row, repeated rows and NULL keys included. A NULL or empty
    URL, or one without ``://``, has an empty host and path, and only a glob
    that matches nothing at all could fit it. Rules are part of the program and go to
    the tasks with it. Nothing is shuffled.
    """
    ranked = sorted(site_rules, key=lambda r: -len(r.label))
    globs = [f"{_SUB}{r.host}{r.path}*" for r in ranked] + [r.glob for r in glob_rules]
    schema = T.StructType([df.schema[c] for c in keep] + list(RESULT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(globs)
        for batch in batches:
            urls = batch.column(batch.num_columns - 1).to_pylist()
            raw = [(u or "").encode() for u in urls]
            for low, high in textops.row_slices(raw):
                parts = [split_url(u) for u in urls[low:high]]
                found = automaton.matches([(h + p).encode() for h, p in parts])
                sites, others = found[:, :len(ranked)], found[:, len(ranked):]
                rules = [ranked[int(r.argmax())] if r.any() else None for r in sites]
                hits = [glob_rules[int(r.argmax())] if r.any() else None for r in others]
                verdicts = [r.verdict if r else g.verdict if g else default
                            for r, g in zip(rules, hits, strict=True)]
                added = [[h for h, _ in parts], [p for _, p in parts], [r and r.label for r in rules],
                         [g and g.glob for g in hits], verdicts]
                rows = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(i) for i in range(len(keep))] + [pa.array(a, pa.string()) for a in added],
                    names=schema.names)

    return textops.map_arrow(df.select(*(df[c] for c in keep), df[url_col].alias("__url")), run, schema)
