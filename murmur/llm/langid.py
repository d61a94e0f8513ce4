"""Language ID by compression: the language whose dictionary packs a text smallest.

Each language's dictionary is raw text, lower-cased, of a bounded sample of labelled rows. A text is
cut into blocks, each block is compressed on its own with every dictionary, and
the sizes are summed: what a dictionary saves then grows with the text instead of
fading as the text starts to explain itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.llm import textops

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` of ``sample_chars`` each fill a dictionary; ``languages`` bounds their number.

    A text whose margin at ``level`` is below ``second_look`` is packed again at ``second_level``. It is accepted if the
    best size is then smaller than the second by the share ``min_margin``.
    """

    sample_rows: int = 256
    sample_chars: int = 1024
    languages: int = 128
    block: int = 2048
    level: int = 6
    second_look: float = 0.01
    second_level: int = 12
    min_margin: float = 0.002


@dataclass(frozen=True)
class Model:
    """A dictionary for each language, the most frequent language first."""

    dictionaries: dict[str, bytes]
    settings: Settings


def fit(df: DataFrame, lang_col: str = "lang", key_col: str = "doc_id", text_col: str = "text",
        settings: Settings = Settings()) -> Model:
    """Learn dictionaries from the labelled rows of ``df``.

    Of each language, the rows whose key has the least hash are taken; longer texts give their
    first ``sample_chars`` characters. Rows without language, key or text are passed over. Which language is how
    frequent is counted over all labelled rows. The driver gets ``languages`` times ``sample_rows`` rows at most; more
    languages than that raise. No labelled row gives a model that calls everything unknown.
    """
    named = df.where(df[lang_col].isNotNull() & df[key_col].isNotNull())
    labelled = named.select(df[key_col].alias("key"), df[lang_col].alias("lang"),
                            F.substring(df[text_col], 1, settings.sample_chars).alias("text"))
    counts = {r["lang"]: r["n"] for r in named.groupBy(df[lang_col].alias("lang")).agg(F.count("*").alias("n"))
              .limit(settings.languages + 1).collect()}
    if len(counts) > settings.languages:
        raise ValueError(f"more than {settings.languages} languages")
    order = W.partitionBy("lang").orderBy(F.xxhash64("key"), "key")
    rows = (labelled.where(F.length("text") > 0).withColumn("place", F.row_number().over(order))
            .where(F.col("place") <= settings.sample_rows).select("lang", "place", "text").collect())
    texts: dict[str, list[bytes]] = {}
    for row in sorted(rows, key=lambda r: (-counts[r["lang"]], r["lang"], r["place"], r["text"])):
        texts.setdefault(row["lang"], []).append(row["text"].lower().encode())
    return Model({lang: b"\n".join(parts) for lang, parts in texts.items()}, settings)


RESULT = T.StructType([
    T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("accepted", T.BooleanType()),
])


def _packers(model: Model, level: int) -> list[Callable[[bytes], bytes]]:
    out = []
    for text in model.dictionaries.values():
        data = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level)
        out.append(zstandard.ZstdCompressor(level=level, dict_data=data, write_checksum=False,
                                            write_content_size=False, write_dict_id=False).compress)
    return out


def _classifier(model: Model) -> Callable[[list[bytes | None]], list]:
    names, settings = list(model.dictionaries), model.settings
    first, second = _packers(model, settings.level), _packers(model, settings.second_level)

    def look(text: bytes, packers: list) -> tuple[int, float]:
        """The best language, the first of equals, and its margin."""
        blocks = [text[i:i + settings.block] for i in range(0, len(text), settings.block)]
        sizes = [sum(len(pack(b)) for b in blocks) for pack in packers]
        best = sizes.index(min(sizes))
        next_best = min([*sizes[:best], *sizes[best + 1:]], default=2 * sizes[best])
        return best, (next_best - sizes[best]) / next_best

    def classify(texts: list[bytes | None]) -> list:
        langs, scores, accepted = [], [], []
        for raw in texts:
            text = (raw or b"").decode("utf-8", "replace").lower()
            if not names or not any(map(str.isalpha, text)):
                langs.append(UNKNOWN)
                scores.append(0.0)
                accepted.append(False)
                continue
            data = text.encode()
            best, margin = look(data, first)
            if margin < settings.second_look:
                best, margin = look(data, second)
            langs.append(names[best])
            scores.append(min(1.0, margin))
            accepted.append(margin >= settings.min_margin)
        return [langs, scores, accepted]

    return classify


def predict(df: DataFrame, model: Model, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Language of every whole text.

    Columns: ``keep``, ``lang_pred``, ``score`` (the share by which the best size beats the second,
    0 to 1), ``accepted`` (the margin isn't narrow). One row comes back per row. A NULL text,
    and one without a letter, is ``und`` with score 0 and not accepted. Of equal sizes
    the more frequent language wins, with score 0. The model is at most
    ``languages`` dictionaries and goes to the tasks with the code.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    return textops.map_texts(df, text_col, keep, RESULT, lambda: _classifier(shared.value))


def held_out(key: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether a key's checksum falls into the fold kept from learning; a NULL key doesn't."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))
