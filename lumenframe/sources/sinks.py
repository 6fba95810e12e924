"""Writers: replacing by key, append-only trails, content-addressed texts, event-stream frames, results as JSON."""

from __future__ import annotations

from itertools import accumulate

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import text as fx
from lumenframe.session import cut


def bucketed(df: DataFrame, key: str, buckets: int = 256) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def replace_by_key(df: DataFrame, path: str, key: str, buckets: int = 256) -> None:
    """Write rows so that every key in ``df`` has exactly its new rows in the table at ``path``: the buckets of these keys
    are rewritten, all others stay as they are. A crash leaves whole buckets, old or new."""
    spark = df.sparkSession
    new = bucketed(df, key, buckets)
    touched = new.select("bucket").distinct()
    try:
        old = spark.read.parquet(path).join(F.broadcast(touched), "bucket", "left_semi")  # at most one row a bucket
        keep = old.join(new.select(key).distinct(), key, "left_anti").select(*new.columns)
        new = cut(keep.unionByName(new))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    new.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").parquet(path)


def append_trail(events: DataFrame, path: str, order: tuple[str, ...] = ("ts", "session_id", "kind", "payload_json")) -> None:
    """Append events to a trail that is never rewritten, each with ``seq``, a number that grows from batch to batch and,
    within one, by ``order``. The batch is sorted by ranges; a range's numbers begin after those of the ranges before it,
    whose sizes (one number each) are all that is gathered. Trails have one writer."""
    spark = events.sparkSession
    # Cut, as ranges and their rows must be the same for counting and numbering.
    held = cut(events.repartitionByRange(*order).sortWithinPartitions(*order)).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    sizes = held.groupBy("part").agg(F.count("*").alias("n"), F.min("place").alias("first")).orderBy("part").collect()
    last = highest(spark, path)
    begins = list(accumulate((r["n"] for r in sizes), initial=last + 1))
    offsets = spark.createDataFrame([(r["part"], begin - r["first"]) for r, begin in zip(sizes, begins, strict=False)], "part int, shift long")
    numbered = held.join(F.broadcast(offsets), "part").withColumn("seq", F.col("place") + F.col("shift"))
    numbered.select("seq", *events.columns).write.mode("append").parquet(path)


def highest(spark, path: str) -> int:
    """The highest number of a trail, 0 if there is none yet."""
    try:
        return spark.read.parquet(path).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0


def upsert_vectors(vectors: DataFrame, path: str, key: str = "id", buckets: int = 256) -> None:
    """Write vectors (``key``, ``vector``, payload columns) so that each key has its new one; null vectors are left out."""
    replace_by_key(vectors.where("vector is not null"), path, key, buckets)


def content_name(text: Column, prefix: str) -> Column:
    """The file name of a text kept by its content."""
    return F.concat(F.lit(prefix + "-"), F.left(F.sha2(text, 256), F.lit(16)), F.lit(".txt"))


def spill(texts: DataFrame, text_col: str, prefix: str, path: str) -> None:
    """Keep each distinct text once, under its content's name."""
    once = texts.select(content_name(F.col(text_col), prefix).alias("name"), F.col(text_col).alias("text")).dropDuplicates(["name"])
    try:
        known = texts.sparkSession.read.parquet(path).select("name")
        once = once.join(known, "name", "left_anti")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    once.write.mode("append").parquet(path)


def frame(kind: Column, data: Column) -> Column:
    """An event as a server-sent frame; ``data`` is a struct."""
    return F.concat(F.lit("event: "), kind, F.lit("\ndata: "), F.to_json(data), F.lit("\n\n"))


def safe_name(path: Column) -> Column:
    """A file's own name, without any folder that a client sent along."""
    return fx.base_name(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
