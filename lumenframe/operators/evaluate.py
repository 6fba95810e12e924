"""Measures of retrieval: ranks of first hits, recall, reciprocal rank, latency, presence of the answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import text as fx

CUTS = (1, 3, 5, 10)


def first_hits(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """``query_id``, ``kind``, ``first`` (least rank of a hit in the expected file whose pages span the expected one),
    ``exact`` (whose first page is it); null where no hit is right. Hits without an end page end where they begin."""
    own = F.col("h.filename") == F.col("q.expected_doc")
    spans = (F.col("q.expected_page") >= F.col("h.page")) & (F.col("q.expected_page") <= F.coalesce("h.page_end", "h.page"))
    pairs = questions.alias("q").join(hits.alias("h"), (F.col("q.query_id") == F.col("h.query_id")) & own, "left")
    return pairs.groupBy("q.query_id", "q.kind").agg(
        F.min(F.when(spans, F.col("h.rank"))).alias("first"),
        F.min(F.when(F.col("q.expected_page") == F.col("h.page"), F.col("h.rank"))).alias("exact"),
    )


def within(rank: Column, k: int) -> Column:
    return F.coalesce((rank <= k).cast("int"), F.lit(0))


def summary(firsts: DataFrame) -> DataFrame:
    """One row: ``n``, recall at each cut, ``mrr``, ``exact_at_5``."""
    recalls = [F.round(F.avg(within(F.col("first"), k)), 4).alias(f"recall_at_{k}") for k in CUTS]
    return firsts.agg(F.count("*").alias("n"), *recalls, F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 4).alias("mrr"), F.round(F.avg(within(F.col("exact"), 5)), 4).alias("exact_at_5"))


def by_kind(firsts: DataFrame) -> DataFrame:
    return firsts.groupBy("kind").agg(F.count("*").alias("n"), F.sum(within(F.col("first"), 5)).alias("hits"), F.round(F.avg(within(F.col("first"), 5)), 3).alias("recall_at_5"))


def ordered_p95(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys``, ``p95``: the value at place max(1, floor(0.95 n)) in order, not interpolated. Values are counted first,
    so a hot key sorts its distinct values, not its rows."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).count()
    upto = Window.partitionBy(*keys).orderBy("value")
    whole = Window.partitionBy(*keys)
    placed = counted.withColumn("upto", F.sum("count").over(upto)).withColumn("n", F.sum("count").over(whole))
    place = F.greatest(F.lit(1), F.floor(F.col("n") * 0.95))
    return placed.where((F.col("upto") >= place) & (F.col("upto") - F.col("count") < place)).select(*keys, F.col("value").alias("p95"))


def latencies(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys``, ``n``, ``mean_ms``, ``p50_ms``, ``p95_ms``, ``max_ms``."""
    base = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(value), 1).alias("mean_ms"), F.percentile(value, F.lit(0.5)).alias("p50_ms"), F.max(value).alias("max_ms"))
    tail = ordered_p95(rows, keys, value)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return base.alias("a").join(tail.alias("b"), same).select(*(F.col(f"a.{k}") for k in keys), "n", "mean_ms", "p50_ms", F.col("b.p95").alias("p95_ms"), "max_ms")


def answer_present(outputs: DataFrame) -> DataFrame:
    """``query_id``, ``present`` of rows ``query_id``, ``answer``, ``output``: at least half of the answer's keys (and
    one) stand in the output. Answers without keys are left out."""
    keys = outputs.withColumn("keys", fx.answer_keys(F.col("answer"))).where(F.size("keys") > 0)
    found = F.size(F.filter("keys", lambda k: F.contains(F.lower(F.col("output")), F.lower(k))))
    return keys.select("query_id", (found >= F.greatest(F.lit(1), F.floor(F.size("keys") / 2))).alias("present"))


def gate(measures: DataFrame, column: str, least: float) -> DataFrame:
    """``measures``, but an error where ``column`` is below ``least``."""
    low = F.col(column) < least
    return measures.where(F.when(low, F.raise_error(F.concat(F.lit(f"{column} is "), F.col(column).cast("string"), F.lit(f", least {least}")))).otherwise(F.lit(True)))
