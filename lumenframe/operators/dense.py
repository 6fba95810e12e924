"""Dense ranking: exact cosine search of stated query rows against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.config import LIMITS
from lumenframe.functions import text as fx
from lumenframe.operators import bm25

#: Rows of a block of queries and of a block of the searched side.
QUERY_BLOCK, ROW_BLOCK = 1000, 20_000


def blocks(n: int, size: int) -> int:
    return max(1, -(-n // size))


def search(rows: DataFrame, queries: DataFrame, id_col: str = "id", vector_col: str = "vector", limit: int = LIMITS.candidates) -> DataFrame:
    """``query_id``, ``id``, ``score`` (cosine, in double precision), ``rank`` of the best rows of each query.

    Queries (query_id, vector) and rows are dealt into blocks of bounded size; each pair of blocks is one product of
    matrices and keeps its best, and the best of all pairs are ranked. Null vectors and those of no length find
    nothing; ties go to the lower id.
    """
    asked = queries.where(F.col("vector").isNotNull())
    held = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where(F.col("vector").isNotNull())
    n_query, n_row = blocks(asked.count(), QUERY_BLOCK), blocks(held.count(), ROW_BLOCK)
    asked = asked.select("query_id", F.col("vector").alias("query"), F.pmod(F.xxhash64("query_id"), F.lit(n_query)).alias("q"))
    asked = asked.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n_row - 1)).cast("array<bigint>")))
    held = held.withColumn("r", F.pmod(F.xxhash64("id"), F.lit(n_row))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1)).cast("array<bigint>")))
    id_type, query_type = held.schema["id"], asked.schema["query_id"]

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "id", "score"]
        a, b = unit(left.column("query")), unit(right.column("vector"))
        if not len(a) or not len(b):
            return pa.table([left.column("query_id").slice(0, 0), right.column("id").slice(0, 0), pa.array([], pa.float64())], names=names)
        ids = right.column("id")
        order = np.argsort(np.array(pc.rank(ids, sort_keys="ascending", tiebreaker="first")))
        scores = (a @ b.T)[:, order]
        best = np.argsort(-np.round(scores, 12), axis=1, kind="stable")[:, :limit]
        which = np.repeat(np.arange(len(a)), best.shape[1])
        found = np.take_along_axis(scores, best, axis=1).ravel()
        real = ~np.isnan(found)
        return pa.table([left.column("query_id").take(which[real]), ids.take(order[best.ravel()[real]]), pa.array(found[real])], names=names)

    schema = f"query_id {query_type.dataType.simpleString()}, id {id_type.dataType.simpleString()}, score double"
    pairs = asked.groupBy("q", "r").cogroup(held.groupBy("q", "r")).applyInArrow(pair, schema)
    return bm25.rank(pairs.withColumn("score", F.round("score", 6)), "score", limit)


def unit(vectors: pa.ChunkedArray) -> np.ndarray:
    """Rows of unit length, in double precision; rows of no length become nan."""
    flat = np.array(vectors.to_pylist(), dtype=np.float64)
    if not len(flat):
        return flat
    with np.errstate(invalid="ignore", divide="ignore"):
        return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def hashed(corpus: DataFrame, id_col: str = "id", text_col: str = "text", dim: int = 64) -> DataFrame:
    """``id``, ``vector``: texts as unit vectors of hashed white-space tokens, the same in every process."""
    tokens = corpus.select(F.col(id_col).alias("id"), F.explode(F.filter(F.split(fx.strip(F.lower(F.col(text_col))), r"\s+"), lambda t: t != "")).alias("tok"))
    cells = tokens.groupBy("id", F.pmod(F.xxhash64("tok"), F.lit(dim)).cast("int").alias("cell")).count()
    norm = F.sqrt(F.aggregate("cells", F.lit(0.0), lambda a, x: a + x["count"] * x["count"]))
    held = cells.groupBy("id").agg(F.collect_list(F.struct("cell", "count")).alias("cells")).withColumn("norm", norm)
    filled = F.map_from_entries("cells")
    return held.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.coalesce(filled[i], F.lit(0)) / F.col("norm")).cast("float")).alias("vector"))
