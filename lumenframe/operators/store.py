"""Relational operators over files, sessions and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def left_counts(left: DataFrame, right: DataFrame, key: str, counted: str, name: str) -> DataFrame:
    """``left`` with the number of its ``right`` rows (0 if there are none); the right side is counted before the join,
    so that a hot key joins one row."""
    counts = right.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(counted).alias(name))
    return left.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the row that is last by ``order`` (then by all other columns), as a grouped maximum."""
    rest = [c for c in df.columns if c not in keys]
    ordered = [*order, *(c for c in rest if c not in order)]
    top = F.max(F.struct(*ordered)).alias("top")
    return df.groupBy(*keys).agg(top).select(*(F.col(k) for k in keys), *(F.col("top")[c].alias(c) for c in rest)).select(*df.columns)


def last_n(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The ``n`` rows of each key that come last by ``order``; Spark keeps only n rows a key and task before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).drop("place")


def pieces(name: Column, n: int) -> Column:
    """The different pieces of ``n`` characters of a name."""
    last = F.length(name) - n + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(name, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def resolve(names: DataFrame, files: DataFrame) -> DataFrame:
    """``name``, ``id``, ``filename``, ``tier`` of the file that each name means: by exact id (1), exact file name (2), what
    a file name begins with (3) or holds (4), case aside, words or parts of them; the first tier that finds any, within it
    the latest ingested file, then the first id. All tiers are equi-joins: a name joins by the trigram that the fewest file
    names hold and is then compared, a name of one or two characters by itself. Characters that are wildcards elsewhere
    are plain ones; null names find nothing.
    """
    names = names.select("name").where("name is not null").distinct()
    files = latest(files.select("id", "filename", "ingested_at"), ["id"], ["ingested_at"])
    by_id = files.select(F.col("id").alias("key"), "id", "filename", "ingested_at", F.lit(1).alias("tier"))
    by_name = files.select(F.col("filename").alias("key"), "id", "filename", "ingested_at", F.lit(2).alias("tier"))
    exact = names.join(by_id.unionByName(by_name), F.col("name") == F.col("key"))
    # Of equal file names only the best file can win; of a short piece that thousands of files hold, too.
    age = F.min(F.struct((-F.col("ingested_at")).alias("age"), "id", "filename")).alias("best")
    held = files.where("filename is not null").groupBy(F.lower("filename").alias("low")).agg(age).select("low", "best.*")
    asked = names.withColumn("key", F.lower("name"))
    short = F.concat(F.array(F.lit("")), pieces(F.col("low"), 1), pieces(F.col("low"), 2))
    tier = lambda piece: F.when(F.startswith(F.col("low"), piece), 3).otherwise(4).alias("tier")
    shorts = held.select("*", F.explode(short).alias("key")).groupBy("key").agg(F.min(F.struct(tier(F.col("key")), "age", "id", "filename")).alias("best"))
    by_short = asked.join(shorts.select("key", "best.*"), "key").select("name", "tier", "age", "id", "filename")
    grams = held.select("*", F.explode(pieces(F.col("low"), 3)).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = asked.select("name", "key", F.explode(pieces(F.col("key"), 3)).alias("gram")).join(counts, "gram")
    rarest = rarest.groupBy("name", "key").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    by_part = rarest.join(grams, "gram").where(F.contains(F.col("low"), F.col("key"))).select("name", tier(F.col("key")), "age", "id", "filename")
    found = exact.select("name", "tier", (-F.col("ingested_at")).alias("age"), "id", "filename").unionByName(by_short).unionByName(by_part)
    top = F.min(F.struct("tier", "age", "id", "filename")).alias("top")
    return found.groupBy("name").agg(top).select("name", "top.id", "top.filename", "top.tier")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with every row whose key is in ``new`` replaced by the new one; the last of equal new keys is the caller's
    to choose (see ``latest``)."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def delete(df: DataFrame, gone: DataFrame, key: str, own: str | None = None) -> DataFrame:
    """``df`` without the rows whose ``own`` column (``key`` if none is given) is among ``gone``'s keys."""
    dead = gone.select(F.col(key).alias("dead")).distinct()
    return df.join(dead, F.col(own or key) == F.col("dead"), "left_anti")


def forward_fill(df: DataFrame, group: list[str], order: list[str], column: str) -> DataFrame:
    """``column`` with null and empty values replaced by the last one before them that is neither, empty if none is."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.coalesce(F.last(F.nullif(F.col(column), F.lit("")), ignorenulls=True).over(w), F.lit("")))


def half_open_year(column: Column, year: int) -> Column:
    """Times (unix seconds) of a year: from its first second, up to the next year's first second."""
    first = lambda y: F.unix_timestamp(F.make_timestamp(F.lit(y), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    return (column >= first(year)) & (column < first(year + 1))


def picked(df: DataFrame, column: str, wanted: list, empty_is_all: bool) -> DataFrame:
    """The rows whose ``column`` is among ``wanted``; an empty list means all rows, or none."""
    if wanted:
        return df.where(F.col(column).isin(*wanted))
    return df if empty_is_all else df.limit(0)


def required(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` joined to ``right`` on ``key``; a left row without a partner is an error, not a lost row."""
    found = right.withColumn("found", F.lit(True))
    joined = left.join(found, key, "left")
    return joined.where(F.when(F.col("found").isNull(), F.raise_error(F.concat(F.lit(f"no {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(F.lit(True))).drop("found")
