"""Parameters shared by every operator: entities, periods, topics, table schemas.

Operators never name a forum, a person or a date themselves; callers pass the
dataclasses below. All datetimes are naive and mean UTC wall-clock time.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH = datetime(1970, 1, 1)
OTHER = "other"

#: What counts as part of a word. Spelled out as Unicode classes because ``\b``
#: treats accented letters differently from one regex engine to the next.
WORD_CLASS = r"\p{L}\p{N}_"


def _quote(term: str) -> str:
    return re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", term)


@dataclass(frozen=True)
class EntityPattern:
    """A named entity and the terms that count as a mention of it."""

    name: str
    terms: Sequence[str]
    home_forums: Sequence[str] = ()

    @property
    def flag(self) -> str:
        return f"mentions_{self.name.lower()}"

    @property
    def regex(self) -> str:
        """Whole-word alternation over the terms, for lower-cased text."""
        words = "|".join(_quote(t) for t in self.lower_terms)
        return f"(?<![{WORD_CLASS}])(?:{words})(?![{WORD_CLASS}])"

    @property
    def lower_terms(self) -> list[str]:
        return [t.lower() for t in self.terms]


def _seconds(moment: datetime) -> float:
    return (moment - EPOCH) / timedelta(seconds=1)


def ntz(moment: datetime) -> Column:
    """A zone-free timestamp literal, equal under every session time zone."""
    return F.to_timestamp_ntz(F.lit(moment.isoformat(sep=" ", timespec="microseconds")))


@dataclass(frozen=True)
class Period:
    """A labelled span of time, closed at the start; the end is closed on request."""

    label: str
    start: datetime
    end: datetime
    end_inclusive: bool = False

    def seconds(self) -> tuple[int, int]:
        """The first and the last whole Unix second inside; the last comes before the first where there is none."""
        last = math.floor(_seconds(self.end)) if self.end_inclusive else math.ceil(_seconds(self.end)) - 1
        return math.ceil(_seconds(self.start)), last

    def covers_seconds(self, seconds: Column) -> Column:
        """Membership test on whole Unix seconds.

        Integer bounds against the bare column, so the range reaches the Parquet
        reader as a pushed filter.
        """
        first, last = self.seconds()
        return (seconds >= first) & (seconds <= last)

    def covers_timestamp(self, moment: Column) -> Column:
        """Membership test on a timestamp_ntz column."""
        upper = moment <= ntz(self.end) if self.end_inclusive else moment < ntz(self.end)
        return (moment >= ntz(self.start)) & upper

    def months(self) -> Iterator[tuple[int, int]]:
        """Every (year, month) partition the period can touch."""
        year, month = self.start.year, self.start.month
        while (year, month) <= (self.end.year, self.end.month):
            yield year, month
            year, month = (year + 1, 1) if month == 12 else (year, month + 1)


@dataclass(frozen=True)
class Calendar:
    """An ordered list of periods; the first one that covers a row labels it."""

    periods: Sequence[Period]

    @property
    def labels(self) -> list[str]:
        return [p.label for p in self.periods]

    def __getitem__(self, label: str) -> Period:
        for period in self.periods:
            if period.label == label:
                return period
        raise KeyError(label)

    def moved(self, days: int) -> Calendar:
        """The same periods some days later."""
        shift = timedelta(days=days)
        return Calendar([replace(p, start=p.start + shift, end=p.end + shift) for p in self.periods])

    def window(self, first: str, last: str) -> Period:
        """One span from the start of ``first`` through the end of ``last``, both ends closed."""
        return Period(f"{first}..{last}", self[first].start, self[last].end, end_inclusive=True)


@dataclass(frozen=True)
class TopicFilter:
    """Forum names that define a topic, compared without regard to case."""

    forums: Sequence[str]
    names: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "names", tuple(sorted({f.lower() for f in self.forums})))


def _columns(text: str, key: str, extra: Sequence[T.StructField] = ()) -> T.StructType:
    return T.StructType([
        T.StructField(key, T.LongType(), False),
        T.StructField("subreddit", T.StringType(), False),
        T.StructField(text, T.StringType(), True),
        T.StructField("score", T.LongType(), True),
        *extra,
        T.StructField("author_id", T.LongType(), True),
        T.StructField("created_utc", T.LongType(), False),
        T.StructField("yyyy", T.IntegerType(), False),
        T.StructField("mm", T.IntegerType(), False),
    ])


POSTS_SCHEMA = _columns("title", "post_id", [T.StructField("num_comments", T.LongType(), True)])
COMMENTS_SCHEMA = _columns("body", "comment_id")
