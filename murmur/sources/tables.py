"""Reading and writing the two fact tables, and writing result tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.functions.scale import broadcast_if_small
from murmur.specs import COMMENTS_SCHEMA, POSTS_SCHEMA, Calendar, Period

PARTITIONS = ("yyyy", "mm")


class SchemaMismatch(ValueError):
    """A table lacks a column an operator needs, or holds it under another type."""


def require_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Fail, when the rows are read, on a row that lacks one of the keys; no pass of its own is made."""
    def checked(key: str) -> Column:
        fault = F.raise_error(F.lit(f"{key} is missing")).cast(df.schema[key].dataType)
        return F.coalesce(F.col(key), fault).alias(key)
    return df.select(*(checked(c) if c in keys else F.col(f"`{c}`") for c in df.columns))


def require_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    actual = {f.name: f.dataType for f in df.schema.fields}
    wrong = [
        f"{f.name}: expected {f.dataType.simpleString()}, found "
        f"{actual[f.name].simpleString() if f.name in actual else 'nothing'}"
        for f in expected.fields
        if actual.get(f.name) != f.dataType
    ]
    if wrong:
        raise SchemaMismatch("; ".join(wrong))
    return df


def partition_predicate(periods: Iterable[Period]) -> Column:
    """The (yyyy, mm) partitions that can hold rows of any of the periods; none without a period."""
    by_year: dict[int, set[int]] = {}
    for period in periods:
        for year, month in period.months():
            by_year.setdefault(year, set()).add(month)
    return reduce(
        lambda a, b: a | b,
        ((F.col("yyyy") == y) & F.col("mm").isin(sorted(months)) for y, months in sorted(by_year.items())),
        F.lit(False),
    )


def only_partitions(
    df: DataFrame,
    years: Sequence[int] | None = None,
    months: Sequence[int] | None = None,
    periods: Calendar | Iterable[Period] | None = None,
) -> DataFrame:
    """Keep chosen partitions. Bare partition columns, so unread folders are never listed."""
    if years is not None:
        df = df.where(F.col("yyyy").isin(list(years)))
    if months is not None:
        df = df.where(F.col("mm").isin(list(months)))
    if periods is not None:
        spans = list(periods.periods if isinstance(periods, Calendar) else periods)
        df = df.where(partition_predicate(spans))
    return df


def conform(df: DataFrame, schema: T.StructType, columns: Mapping[str, str | Column] | None = None,
            keys: Sequence[str] = ("post_id", "comment_id")) -> DataFrame:
    """Bring a raw table to a canonical schema.

    ``columns`` says where a canonical column comes from if not from the column
    of the same name, as in ``{"author_id": F.xxhash64("author")}``. Other
    columns are left out; values that do not fit the type become NULL, but for those of ``keys``: a key that is there
    and does not fit fails the read, as it would otherwise be lost without a word.
    """
    sources = {name: F.col(c) if isinstance(c, str) else c for name, c in (columns or {}).items()}

    def fitted(field: T.StructField) -> Column:
        source = sources.get(field.name, F.col(field.name))
        value = source.try_cast(field.dataType)
        if field.name in keys:
            fault = F.raise_error(F.concat(F.lit(f"{field.name} does not fit: "), source.cast("string"))).cast(field.dataType)
            value = F.when(source.isNotNull() & value.isNull(), fault).otherwise(value)
        return value.alias(field.name)

    return df.select(*map(fitted, schema.fields))


def _load(spark, path, schema, years, months, periods, columns) -> DataFrame:
    table = only_partitions(spark.read.parquet(path), years, months, periods)
    return require_schema(table if columns is None else conform(table, schema, columns), schema)


def load_posts(spark: SparkSession, path: str, years=None, months=None, periods=None, columns=None) -> DataFrame:
    """Posts under ``path``, limited to the partitions asked for; ``columns`` as in ``conform``."""
    return _load(spark, path, POSTS_SCHEMA, years, months, periods, columns)


def load_comments(spark: SparkSession, path: str, years=None, months=None, periods=None, columns=None) -> DataFrame:
    """Comments under ``path``, limited to the partitions asked for; ``columns`` as in ``conform``."""
    return _load(spark, path, COMMENTS_SCHEMA, years, months, periods, columns)


def calendar_table(spark: SparkSession, calendar: Calendar | Iterable[Period]) -> DataFrame:
    """The periods as a table, one row for each month that a period touches.

    Columns ``label``, ``position``, ``first_second`` and ``last_second`` (whole Unix seconds, both inside) and ``yyyy``, ``mm``.
    """
    periods = calendar.periods if isinstance(calendar, Calendar) else calendar
    rows = [(p.label, i, *p.seconds(), year, month) for i, p in enumerate(periods) for year, month in p.months()]
    return spark.createDataFrame(
        rows, "label string, position int, first_second long, last_second long, yyyy int, mm int")


def in_calendar(df: DataFrame, months: DataFrame, ts_col: str = "created_utc") -> DataFrame:
    """Rows inside any period of a calendar table, whatever has been selected from it.

    The table is joined on the partition columns, so where it is read from files and filtered (``label = ...``) Spark
    prunes partitions at run time by the months that the filter leaves: they need not be known when the query is
    written. A row in several periods comes back once. The table has a row for each period and month, and is broadcast
    where it is measured to be small.
    """
    spans = months.select(F.col("yyyy").alias("_yyyy"), F.col("mm").alias("_mm"), F.col("first_second").alias("_first"),
                          F.col("last_second").alias("_last"))
    inside = (F.col("yyyy") == F.col("_yyyy")) & (F.col("mm") == F.col("_mm")) & F.col(ts_col).between(F.col("_first"), F.col("_last"))
    return df.join(broadcast_if_small(spans), inside, "left_semi")


def save_partitioned(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    partition_by: Sequence[str] = PARTITIONS,
    rebalance: bool = False,
    replace: str = "table",
    cluster_by: Sequence[str] = (),
    bloom_filters: bool = True,
    expected_values: int = 10_000,
) -> str:
    """Write Parquet, one folder per partition value.

    By default every task writes what it holds, without a shuffle. With
    ``rebalance`` rows are first gathered by partition value, which bounds the
    number of files; a partition far larger than the rest is split over several
    tasks by adaptive execution rather than sent to one. Ask for it after a filter that drops most rows, or every
    input split leaves a tiny file.

    With ``replace="partitions"`` an overwrite replaces the partitions that ``df`` has rows of and leaves all others as
    they are, so one month can be saved again beside the rest.

    With ``cluster_by`` rows are range-partitioned by the partition columns, these columns and a hash of the row, and sorted
    inside each file, so that equal values lie in few row groups; a value with very many rows runs through several files. They
    get a Bloom filter in each row group, sized for ``expected_values``; Parquet leaves it out where a dictionary
    holds all values, which serves as well. A pushed ``=`` or ``IN`` then skips what it can't match. The splitters are sampled from these columns alone, never from texts.
    """
    if replace not in ("table", "partitions"):
        raise ValueError("replace is 'table' or 'partitions'")
    if cluster_by:
        keys = [*partition_by, *cluster_by]
        df = df.repartitionByRange(*keys, F.xxhash64(*(F.col(f"`{c}`") for c in df.columns if _hashable(df, c)))).sortWithinPartitions(*keys)
    elif rebalance and partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode)
    if replace == "partitions":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if cluster_by and bloom_filters:
        for column in cluster_by:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
            writer = writer.option(f"parquet.bloom.filter.expected.ndv#{column}", str(expected_values))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def _hashable(df: DataFrame, column: str) -> bool:
    """Fixed-width columns: a key among them tells rows apart without a look at their texts."""
    return isinstance(df.schema[column].dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def saved_coverage(spark: SparkSession, path: str, partition_by: Sequence[str] = PARTITIONS) -> DataFrame:
    """Which partitions a saved table has, with their files and bytes: ``partition_by``, ``files``, ``bytes``, in order.

    The folder is listed and nothing is read from its files, whatever their size. A partition whose files hold no
    row is listed too; Spark itself writes none. A table without files, or one that isn't partitioned by these columns, has
    no coverage and raises.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "false").load(path)
    missing = [c for c in partition_by if c not in files.columns]
    if missing:
        raise SchemaMismatch(f"{path} is not partitioned by {', '.join(missing)}")
    return files.groupBy(*partition_by).agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes")).orderBy(*partition_by)


def _footers(spark: SparkSession) -> SparkSession:
    """A session of the same application that answers counts from Parquet footers."""
    session = spark.newSession()
    for name, value in (("spark.sql.sources.useV1SourceList", ""), ("spark.sql.parquet.aggregatePushdown", "true"),
                        ("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))):
        session.conf.set(name, value)
    return session


def saved_counts(spark: SparkSession, path: str, partition_by: Sequence[str] = PARTITIONS) -> DataFrame:
    """Rows of each partition of a saved table, from the files' footers: ``partition_by``, ``rows``.

    The count is pushed into the scan, which opens footers and no column. Without ``partition_by`` it is the whole table's.
    """
    saved = _footers(spark).read.parquet(path)
    return saved.groupBy(*partition_by).agg(F.count("*").alias("rows"))


def verify_saved(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Row counts of freshly written tables: ``(table, rows)``, from the files' footers."""
    session = _footers(spark)
    counts = [
        session.read.parquet(path).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, path in paths.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def save_result_csv(df: DataFrame, path: str, order_by: Sequence[str | Column] = (), keep_order: bool = False) -> str:
    """Write an aggregated result as a single CSV file with a header.

    The one-file shuffle comes after the aggregation, so only the finished
    result rows pass through the writing task. With ``keep_order`` a short result that is in order stays so: its last
    stage then runs in that task.
    """
    single = df.coalesce(1) if keep_order else df.repartition(1)
    if order_by:
        single = single.sortWithinPartitions(*order_by)
    single.write.mode("overwrite").option("header", True).csv(path)
    return path


def schema_report(df: DataFrame, count_nulls: bool = False) -> DataFrame:
    """One row per column: position, name, type and whether it may lack a value, from the schema alone.

    ``count_nulls`` adds ``null_rows``, how many rows lack it, which reads all of the data.
    """
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.lit(f.nullable).alias("nullable"),
            *([F.col(f.name).alias("null_rows")] if count_nulls else []),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    counts = [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    source = df.agg(*counts) if count_nulls else df.sparkSession.range(1)
    return source.select(F.inline(F.array(*entries)))


def partition_coverage(df: DataFrame, keys: Sequence[str] = PARTITIONS) -> DataFrame:
    """Which partition values are present, in order."""
    return df.select(*keys).distinct().orderBy(*keys)


def preview(df: DataFrame, columns: Sequence[str], key: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows by key, with the columns of interest."""
    return df.select(key, *columns).orderBy(key).limit(n)
