"""MinHash near-duplicates from bottom-k sketches of one hash function.

A document's set holds the hashes of its word shingles; its sketch, the k least of
them. Texts with equal sets are one class, and only classes are compared.

1. Inverted lists: each class enters the lists of its rarest retained values, as many
   as make two sets of the wanted similarity meet: were at least ``overlap`` of k values
   shared, one is among the first k - overlap + 1 of each, in any common order.
2. Candidates: lists up to ``short_list`` classes give all their pairs. In a longer
   list each class meets the list's leaders, so rows grow with the list, not its square.
3. Union-sketch estimation drops candidates far from the wanted similarity.
4. Exact Jaccard of the full sets decides.
5. What long lists may still owe is found over whole sets; see ``_rest``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.functions.scale import broadcast_if_small, stage
from murmur.llm import textops
from murmur.llm.components import components


_WORDS = 16  # 64-bit words of a set's parity bits
_LOOK_BACK = 16  # how many of a set's rarer values a row of its lists carries, only to spare repeated pairs


@dataclass(frozen=True)
class Settings:
    """``percent``: link sets with 100 * intersection >= percent * union."""

    width: int = 5
    percent: int = 80
    k: int = 64
    short_list: int = 4
    leaders: int = 1
    missed: float = 1e-9

    @property
    def overlap(self) -> int:
        """The most values of a union's bottom k that two linked sets share but for a part ``missed`` of links.

        Of a union's k least values each is shared with a chance of at least the similarity, so fewer are by the binomial's
        tail, and the true tail (drawn without return) is thinner.
        """
        p, tail = self.percent / 100, 0.0
        for shared in range(self.k + 1):
            tail += math.comb(self.k, shared) * p**shared * (1 - p)**(self.k - shared)
            if tail > self.missed:
                return max(1, shared)
        return self.k


def shingle_sets(texts: Sequence[bytes | None], width: int, key: int = 0) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than ``width`` are one shingle. ``key`` is that of the hashes."""
    words = textops.split_words(texts, lower=True, key=key)
    hashes, at = textops.windows(words.hashes, words.bounds, width)
    cuts = np.searchsorted(at, words.bounds)
    out = []
    for i, n in enumerate(words.counts):
        if n >= width:
            out.append(np.unique(hashes[cuts[i]:cuts[i + 1]]))
        elif n:
            low, high = words.bounds[i:i + 2]
            own = words.hashes[low:high]
            out.append(textops.windows(own, np.array([0, n]), int(n))[0] ^ np.uint64(n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_TOP = np.uint64(1 << 63)  # flipped in sketches, so that signed order is the hashes' order

SKETCH = T.StructType([
    T.StructField("n_shingles", T.LongType()), T.StructField("set_id", T.BinaryType()),
    T.StructField("sketch", T.ArrayType(T.LongType())),
])


def sketches(df: DataFrame, settings: Settings, key_col: str = "doc_id", text_col: str = "text", key: int = 0) -> DataFrame:
    """Set size, digest of the whole set (NULL when empty) and bottom-k sketch of every text."""
    def work(texts: list[bytes | None]) -> list:
        sets = shingle_sets(texts, settings.width, key)
        return [[len(s) for s in sets], [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                [(s[:settings.k] ^ _TOP).view(np.int64) for s in sets]]

    return textops.map_texts(df, text_col, [key_col], SKETCH, lambda: work)


#: At most so many keys have more rows than their share, and are broadcast.
_HEAVY = 50_000


def _join_counted(rows: DataFrame, counted: DataFrame, on: str, total: int) -> DataFrame:
    """``rows`` joined to ``counted``, which has one row for each ``on`` and says in ``_rows`` how many of the ``total`` rows it has.

    Keys of more than one in ``_HEAVY`` of all rows, of which there are fewer than that, are broadcast, so that no task gathers
    their rows; the others are shuffled. ``total`` is no less than the sum of ``_rows``.
    """
    heavy = F.col("_rows") > max(64, total // _HEAVY)
    few, many = counted.where(heavy).drop("_rows"), counted.where(~heavy).drop("_rows")
    light = rows.join(F.broadcast(few.select(on)), on, "left_anti")
    return rows.join(F.broadcast(few), on).unionByName(light.join(many, on))


def _prefix(values: DataFrame, share: float, total: int) -> DataFrame:
    """Each document in the lists of its rarest values: ``value``, ``doc``, ``size`` of the list, ``alone``, ``kept``, ``place``.

    ``values`` has ``doc``, ``value`` and ``kept`` (the document's number of values). Two documents
    that share the part ``share`` of their values have a list in common. Values that no
    other document holds (``alone`` of them) are the rarest, and use up places. ``total`` is about the number of rows.
    """
    sizes = values.groupBy("value").agg(F.count("*").alias("size")).where("size > 1").withColumn("_rows", F.col("size"))
    alone = F.col("kept") - F.count("*").over(W.partitionBy("doc"))
    place = F.row_number().over(W.partitionBy("doc").orderBy("size", "value"))
    ranked = _join_counted(values, sizes, "value", total).select(
        "value", "doc", "kept", "size", alone.alias("alone"), place.alias("shared_place"))
    return ranked.withColumn("place", F.col("shared_place") + F.col("alone")).where(
        F.col("place") <= F.col("kept") - F.ceil(F.col("kept") * share) + 1).select(
        "value", "doc", "size", "alone", "kept", "place")


def _leaders(lists: DataFrame, settings: Settings, total: int) -> DataFrame:
    """Rows of long lists with the list's leaders: its member with the fewest values of its own, and random ones."""
    long = lists.where(F.col("size") > settings.short_list)
    picks = [F.min(F.struct(*([F.col("alone")] if i == 0 else []), F.xxhash64("doc", F.lit(i)), F.col("doc").alias("doc")))
             .alias(f"pick{i}") for i in range(settings.leaders)]
    chosen = long.groupBy("value").agg(*picks, F.count("*").alias("_rows")).select(
        "value", F.array_distinct(F.array(*(F.col(f"pick{i}.doc") for i in range(settings.leaders)))).alias("leaders"), "_rows")
    return _join_counted(long, chosen, "value", total).select("doc", "leaders")


def _candidates(lists: DataFrame, led: DataFrame, settings: Settings) -> DataFrame:
    """Pairs of classes that meet in a list, each once: ``a`` > ``b``."""
    short = lists.where(F.col("size") <= settings.short_list).groupBy("value").agg(
        F.sort_array(F.collect_set("doc")).alias("docs"))  # at most short_list classes
    pairs = short.where("size(docs) > 1").select("docs", F.explode("docs").alias("a")).select(
        "a", F.explode(F.filter("docs", lambda d: d < F.col("a"))).alias("b"))
    starred = led.select("doc", F.explode("leaders").alias("leader")).where("doc <> leader").select(
        F.greatest("doc", "leader").alias("a"), F.least("doc", "leader").alias("b"))
    return pairs.union(starred).distinct()


def _estimated(pairs: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """Pairs whose union sketch doesn't rule out the wanted similarity.

    The bottom k of two sketches together is the bottom k of the sets' union; the share of
    it that both retain estimates their similarity. Sets below k are whole, so the share is exact.
    """
    left = classes.select(F.col("doc").alias("a"), F.col("sketch").alias("sa"), F.col("n_shingles").alias("na"))
    right = classes.select(F.col("doc").alias("b"), F.col("sketch").alias("sb"), F.col("n_shingles").alias("nb"))
    joined = pairs.join(left, "a").join(right, "b").where(
        100 * F.least("na", "nb") >= settings.percent * F.greatest("na", "nb"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, settings.k)
    counted = joined.withColumn("u", union).withColumn(
        "hits", F.size(F.array_intersect("u", F.array_intersect("sa", "sb"))))
    whole = F.size("u") < settings.k
    return counted.where(
        (whole & (100 * F.col("hits") >= settings.percent * F.size("u")))
        | (~whole & (F.col("hits") >= settings.overlap))).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Pairs whose whole sets are similar enough."""
    left = sets.select(F.col("doc").alias("a"), F.col("items").alias("ia"))
    right = sets.select(F.col("doc").alias("b"), F.col("items").alias("ib"))
    percent = settings.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(p, q)
                shared = int(np.count_nonzero(p[np.minimum(at, len(p) - 1)] == q))
                keep.append(100 * shared >= percent * (len(p) + len(q) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ia", "ib")
    return textops.map_arrow(joined, run, pairs.select("a", "b").schema)


def _sets(named: DataFrame, wanted: DataFrame, settings: Settings, key: int) -> DataFrame:
    """Whole shingle sets of the wanted classes (``doc``), as sorted unsigned 64-bit values.

    ``wanted`` names a key for each class. Where that key stands on other texts too, their digests tell them apart.
    """
    texts = named.join(broadcast_if_small(wanted), "key").select("doc", "text")

    def work(texts: list[bytes | None]) -> list:
        items = [s.tobytes() for s in shingle_sets(texts, settings.width, key)]
        return [items, [hashlib.blake2b(i, digest_size=16).digest() for i in items]]

    added = T.StructType([T.StructField("items", T.BinaryType()), T.StructField("_digest", T.BinaryType())])
    sets = textops.map_texts(texts, "text", ["doc"], added, lambda: work)
    return sets.where(F.col("doc") == F.col("_digest")).drop("_digest")


def links(df: DataFrame, settings: Settings, key_col: str = "doc_id", text_col: str = "text"
          ) -> tuple[DataFrame, DataFrame]:
    """All rows with their class, and verified links between classes.

    A class is a set of shingles, whatever texts and keys have it, and goes by the set's digest. The first frame has the key,
    ``n_shingles`` and ``doc`` (the class; NULL for an empty set or a NULL key), the second ``a`` and ``b``.
    """
    secret = textops.fresh_key()
    named = df.select(df[key_col].alias("key"), df[text_col].alias("text"))
    measured = stage(sketches(named, settings, "key", "text", secret).withColumn(
        "doc", F.when(F.col("key").isNotNull(), F.col("set_id"))).drop("set_id"), "sketches")
    classes = stage(measured.where("doc is not null").groupBy("doc").agg(
        F.min("key").alias("key"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "classes")
    total = settings.k * classes.count()
    retained = classes.select("doc", F.explode("sketch").alias("value"), F.size("sketch").alias("kept"))
    lists = stage(_prefix(retained, settings.overlap / settings.k, total), "lists")
    led = stage(_leaders(lists, settings, total), "leaders")
    pairs = stage(_estimated(_candidates(lists, led, settings), classes, settings), "candidates")
    wanted = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).union(led.select("doc")).distinct()
    wanted = stage(wanted.join(classes.select("doc", "key"), "doc"), "wanted")
    sets = stage(_sets(named, wanted, settings, secret).dropDuplicates(["doc"]), "sets")
    found = stage(_verified(pairs, sets, settings), "links")
    rows = measured.select(F.col("key").alias(key_col), "n_shingles", "doc")
    rest = _rest(led, found, sets, settings)
    return rows, found if rest is None else found.union(rest)


def _rest(led: DataFrame, found: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame | None:
    """Links that long lists may still owe, found exactly; None where none is possible.

    A class is open if it isn't yet connected with the first leader of one of its
    long lists. Open classes meet the classes of all long lists, of other components,
    in the inverted lists of whole sets: a link of the wanted similarity shares one of
    the rarest shingles of either, as many as the similarity lets differ plus one. A text that
    only quotes what many quote has too many shingles of its own to enter a list. Sets whose
    parity bits differ in more places than linked sets may differ in shingles give no pair.
    """
    reached = components(found)
    named = led.select("doc", F.col("leaders")[0].alias("leader"))
    of = lambda name: reached.select(F.col("node").alias(name), F.col("component").alias(f"{name}_in"))
    known = named.join(of("doc"), "doc", "left").join(of("leader"), "leader", "left")
    apart = F.coalesce("doc_in", "doc") != F.coalesce("leader_in", "leader")
    members = stage(known.groupBy("doc").agg(F.max(apart).alias("open"), F.min(F.coalesce("doc_in", "doc")).alias("at")),
                    "members")
    if members.where("open").isEmpty():
        return None
    concerned = sets.join(broadcast_if_small(members.select("doc")), "doc", "left_semi")
    values = _values(concerned)
    total = concerned.agg(F.coalesce(F.sum(F.octet_length("items")), F.lit(0))).first()[0] // 8
    lists = _prefix(values, settings.percent / 100, total)
    earlier = W.partitionBy("doc").orderBy("place").rowsBetween(-_LOOK_BACK, -1)
    lists = stage(lists.withColumn("before", F.collect_list("value").over(earlier)).join(
        members.join(_parity(concerned), "doc"), "doc"), "whole_lists")
    carried = ["doc", "at", "kept", "place", "before", "open", *(f"bits{i}" for i in range(_WORDS))]
    side = lambda name: [F.col(c).alias(f"{name}_{c}") for c in carried]
    mine = lists.where("open").select("value", *side("x"))
    others = lists.select("value", *side("y"))
    # of two sets, the first value they share leaves this many that can be shared; fewer can't make a link
    most = 1 + F.least(F.col("x_kept") - F.col("x_place"), F.col("y_kept") - F.col("y_place"))
    both = F.col("x_kept") + F.col("y_kept")
    enough = (100 + settings.percent) * most >= settings.percent * both
    apart_by = sum((F.bit_count(F.col(f"x_bits{i}").bitwiseXOR(F.col(f"y_bits{i}"))) for i in range(1, _WORDS)),
                   F.bit_count(F.col("x_bits0").bitwiseXOR(F.col("y_bits0"))))
    near = (100 + settings.percent) * apart_by <= (100 - settings.percent) * both
    # two open classes meet once, and a pair not again where it has met in a list just before
    once = (~F.col("y_open") | (F.col("x_doc") > F.col("y_doc"))) & ~F.arrays_overlap("x_before", "y_before")
    pairs = mine.join(others, "value").where((F.col("x_at") != F.col("y_at")) & enough & near & once).select(
        F.greatest("x_doc", "y_doc").alias("a"), F.least("x_doc", "y_doc").alias("b")).distinct()
    return stage(_verified(pairs, sets, settings), "rest")


def _values(sets: DataFrame) -> DataFrame:
    """One row per document and shingle hash."""
    schema = T.StructType([sets.schema["doc"], T.StructField("value", T.LongType()), T.StructField("kept", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [np.frombuffer(i.as_buffer(), np.int64) for i in batch.column(1)]
            sizes = [len(i) for i in items]
            rows = np.repeat(np.arange(len(items)), sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(np.concatenate([np.zeros(0, np.int64), *items])),
                 pa.array(np.repeat(np.array(sizes, np.int64), sizes))], names=schema.names)

    return textops.map_arrow(sets.select("doc", "items"), run, schema)


def _parity(sets: DataFrame) -> DataFrame:
    """Whether an odd number of a set's values falls to each of 64 * ``_WORDS`` places, as columns of bits.

    Values of both sets cancel out, so two sets' bits differ in no more places than the sets in values.
    """
    names = [f"bits{i}" for i in range(_WORDS)]
    schema = T.StructType([sets.schema["doc"], *(T.StructField(n, T.LongType()) for n in names)])
    places = np.uint64(64 * _WORDS - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((batch.num_rows, _WORDS), np.int64)
            for i, items in enumerate(batch.column(1)):
                at = (np.frombuffer(items.as_buffer(), np.uint64) & places).astype(np.int64)
                odd = (np.bincount(at, minlength=64 * _WORDS) & 1).astype(np.uint8)
                rows[i] = np.packbits(odd).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(np.ascontiguousarray(rows[:, i])) for i in range(_WORDS))], names=schema.names)

    return textops.map_arrow(sets.select("doc", "items"), run, schema)


def groups(df: DataFrame, settings: Settings = Settings(), key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate group of every row.

    Columns: the key, ``n_shingles``, ``component_id`` (the least key reachable over links, its own
    included), ``kept`` (the key is the component's). One row comes back per row. NULL and empty
    texts, and those of white space alone, have the empty set and are linked with
    nothing. A NULL key has no component and is kept. A key that stands on several texts belongs to the component of each
    row's own text, and is kept in each component of which it is the least. The key may be of any type with an order.
    """
    rows, found = links(df, settings, key_col, text_col)
    known = rows.where(F.col("doc").isNotNull())
    sizes = known.groupBy("doc").agg(F.min(key_col).alias("least"), F.count("*").alias("_rows"))
    labelled = sizes.join(components(found).withColumnRenamed("node", "doc"), "doc", "left").withColumn(
        "component", F.coalesce("component", "doc"))
    labelled = stage(labelled, "labelled")
    total = labelled.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    heads = labelled.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("_rows"))
    classes = _join_counted(labelled.withColumnRenamed("_rows", "_copies"), heads, "component", total).select(
        "doc", "component_id", F.col("_copies").alias("_rows"))
    joined = _join_counted(known, classes, "doc", total)
    alone = rows.where(F.col("doc").isNull()).withColumn("component_id", F.col(key_col))
    component = F.col("component_id")
    return joined.unionByName(alone).select(key_col, "n_shingles", component, F.coalesce(component == F.col(key_col), F.lit(True)).alias("kept"))
