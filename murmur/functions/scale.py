"""Guards that keep a plan safe when its inputs grow."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure a frame, reading no more than one row past the bound."""
    width = F.lit(0).cast("long")
    for column in df.schema.fields:
        if isinstance(column.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(F.col(column.name)), F.lit(0)) + 16
        else:
            width = width + 16
    rows, size = df.limit(max_rows + 1).agg(F.count("*"), F.sum(width)).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only for a frame measured to be small.

    A larger frame comes back without a hint: the planner then shuffles both
    sides, and adaptive execution splits whatever key turns out to be hot.
    """
    return F.broadcast(df) if fits_broadcast(df, max_rows, max_bytes) else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores on a source that arrives in fewer pieces than there are cores.

    ``keys`` identify a row, so that no hot value gathers in one task. A table of
    many files is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def nth_largest(df: DataFrame, column: str, n: int):
    """The value in place ``n`` when a column of counts is put in descending order; None where it has fewer.

    Only how often each value occurs is put in order. Counts that sum to N take fewer than sqrt(2 N) different
    values, so few rows are, and no partition sends its own ``n`` rows.
    """
    levels = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    reached = F.sum("_n").over(W.orderBy(F.desc(column)))
    return levels.withColumn("_reached", reached).where(F.col("_reached") >= n).agg(F.max(column)).first()[0]


def hash_order(key: str) -> list[Column]:
    """A repeatable order that has nothing to do with the rows' own: by md5 of the key, then by key."""
    return [F.md5(F.col(key).cast("string")), F.col(key)]


def hash_bound(df: DataFrame, key: str, n: int, digits: int = 4) -> str | None:
    """A prefix of md5 digests so that at least ``n`` rows' hashed keys do not come after it, and few more; None for a smaller table.

    Rows are counted by the digests' leading ``digits`` hex digits, then, where many share the last group needed, by as many
    more inside it. Each pass reads the key alone, and the driver sees no more than 16 to the power ``digits`` counts.
    """
    digest = F.md5(F.col(key).cast("string"))
    prefix, wanted = "", n
    while len(prefix) < 32:
        size = len(prefix) + digits
        inside = df.select(digest.alias("_d")).where(F.col("_d").startswith(prefix)) if prefix else df.select(digest.alias("_d"))
        counts = inside.groupBy(F.substring("_d", 1, size).alias("_p")).agg(F.count("*").alias("_n")).where(
            F.col("_p").isNotNull()).orderBy("_p").collect()
        for row in counts:
            if row["_n"] >= wanted:
                prefix, held = row["_p"], row["_n"]
                break
            wanted -= row["_n"]
        else:
            return None
        if held <= max(n, 1 << 4 * digits):
            break
    return prefix


def first_by_hash(df: DataFrame, n: int, key: str) -> DataFrame:
    """The ``n`` rows whose hashed keys come first: a bound on the hash is found from the keys, then whole rows are fetched.

    What is put in order is about ``n`` rows in all, not ``n`` of every partition. Rows without a key come first.
    """
    if n <= 0:
        return df.limit(0)
    order = hash_order(key)
    missing = df.where(F.col(key).isNull()).limit(n).count()
    bound = hash_bound(df, key, n - missing) if missing < n else ""
    if bound is not None:
        df = df.where(F.col(key).isNull() | (F.substring(order[0], 1, len(bound)) <= bound) if bound else F.col(key).isNull())
    return df.orderBy(*order).limit(n)


def steady(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Rows placed by key in sorted partitions, so that a seeded fit repeats.

    The number of partitions is part of what must stay the same; by default it is
    the session's ``spark.sql.shuffle.partitions``, which is sized to the cluster.
    """
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, key).sortWithinPartitions(key)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``, else the session's warehouse.

    A warehouse on the driver's own disk will do where everything runs on that machine; on a cluster it is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return shared_or_refused(warehouse, spark.sparkContext.master) + "/murmur-staged"


def shared_or_refused(path: str, master: str) -> str:
    """The path, if executors under this master can be expected to share it."""
    scheme = path.split(":", 1)[0] if ":" in path else "file"
    if scheme == "file" and not master.startswith("local"):
        raise ValueError(f"{path} is on one machine's disk; set spark.checkpoint.dir to a folder that all executors share")
    return path


_staged: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A new path in the shared folder, or in ``folder``, that ``remove_staged`` will clear."""
    path = f"{(folder or shared_folder(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stage(df: DataFrame, name: str = "stage", folder: str | None = None) -> DataFrame:
    """Write a frame to the shared folder, or to ``folder``, and read it back.

    Cuts the lineage before an iterative fit: a lost executor re-reads files
    instead of recomputing the regexes and joins that led here.
    """
    path = scratch_path(df.sparkSession, name, folder)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_staged(spark: SparkSession) -> int:
    """Delete what this application staged; frames that read it can't be used after. Returns the number of paths."""
    paths = _staged.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
    return len(paths)
