"""Reciprocal rank fusion of ranked lists, and hybrid search over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.config import LIMITS
from lumenframe.operators import bm25, dense


def fuse(lists: dict[str, DataFrame], k: int = LIMITS.rrf_k, limit: int = LIMITS.candidates) -> DataFrame:
    """``query_id``, ``id``, ``score`` (sum of 1 / (k + rank)), ``ranks`` (a map from list to rank), ``sources`` (the
    lists' names, sorted), ``rank``. Any number of lists; an id in one list only is kept."""
    parts = [df.select("query_id", "id", F.lit(name).alias("source"), "rank") for name, df in lists.items()]
    union = reduce(DataFrame.unionByName, parts)
    entry = F.struct("source", "rank")
    fused = union.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("ranks"))
    return bm25.rank(fused, "score", limit).withColumn("sources", F.array_sort(F.map_keys("ranks")))


def hybrid(corpus: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, top_k: int = 5, mode: str = "hybrid", index: str | None = None) -> DataFrame:
    """The best passages of each query by both rankings: ``query_id``, ``id``, ``score``, ``rank``, ``dense_rank``,
    ``sparse_rank``, ``sources``, and the corpus columns. ``mode``: hybrid, dense or sparse; ``index``: the corpus's stored index, else one is built. Ids without a corpus row,
    or without a file name, are dropped; texts are fetched only for what is found."""
    lists = {}
    if mode in ("hybrid", "dense"):
        lists["dense"] = dense.search(vectors, query_vectors)
    if mode in ("hybrid", "sparse"):
        lists["sparse"] = bm25.search(corpus.sparkSession, index, queries) if index else bm25.search_corpus(corpus, queries)
    fused = fuse(lists)
    if "filename" in corpus.columns:
        corpus = corpus.where("filename is not null and filename <> ''")
    found = fused.join(corpus, "id")
    kept = bm25.rank(found.drop("rank"), "score", max(1, min(20, top_k)))
    return kept.withColumn("dense_rank", F.col("ranks")["dense"]).withColumn("sparse_rank", F.col("ranks")["sparse"]).drop("ranks")
