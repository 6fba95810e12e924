"""Lexical ranking (BM25, Okapi weights) over a stored index: postings by segments of texts, term weights, corpus sizes.

A segment is a bounded part of the corpus, chosen by hashes of ids. Its postings are one row a token (numbers of texts and
counts), so that neither building nor searching moves a row a posting, and it ranks its own texts: only the best of each
segment are gathered.
"""

from __future__ import annotations

import uuid
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.config import LIMITS
from lumenframe.functions import text as fx
from lumenframe.session import ensure_checkpoint_dir, stored

#: Buckets of tokens that an index is partitioned by; a search reads the buckets of its tokens, and HEADS.
BUCKETS, HEADS = 8, -1
#: Characters of a segment's texts, and queries that are searched at once.
SEGMENT_CHARS, QUERY_BLOCK = 8_000_000, 10_000
#: Columns of an index, but for the ids of postings.
POSTING, TERM = "segment int, tok string, df long, uses long, docs array<int>, tfs array<int>", "tok string, df long, uses long, idf double, bucket int"


def bucket(buckets: int):
    return F.when(F.col("tok").isNull(), HEADS).otherwise(F.pmod(F.xxhash64("tok"), F.lit(buckets)).cast("int")).alias("bucket")


def posting_type(id_type: str) -> str:
    return f"{POSTING}, ids array<{id_type}>"


def invert(group: pa.Table) -> pa.Table:
    """The postings of a segment's texts (segment, id, tokens): a row a token, and a head (``tok`` null) with the ids, in
    order, and their numbers of tokens. Texts are numbered by the order of their ids; texts of one id are one."""
    tokens, named = group.column("tokens").combine_chunks(), group.column("id").combine_chunks()
    ids = named.unique()
    ids = ids.take(pc.array_sort_indices(ids))
    sizes = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
    doc = np.repeat(pc.index_in(named, value_set=ids).to_numpy(zero_copy_only=False).astype(np.int64), sizes)
    coded = tokens.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs, tf = np.unique(code * len(ids) + doc, return_counts=True)
    df = np.bincount(pairs // len(ids), minlength=len(coded.dictionary))
    uses = np.bincount(code, minlength=len(df))
    # The head comes last.
    ends = np.concatenate([[0], np.cumsum(df), [len(pairs)]]).astype(np.int32)
    counts = np.concatenate([tf, np.bincount(doc, minlength=len(ids))]).astype(np.int32)
    rows = len(df) + 1
    return pa.table(
        {
            "segment": pa.array(np.full(rows, group.column("segment")[0].as_py(), dtype=np.int32)),
            "tok": pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.nulls(1, pa.string())]),
            "df": pa.array(np.append(df, 0)),
            "uses": pa.array(np.append(uses, 0)),
            "docs": pa.ListArray.from_arrays(pa.array(ends), pa.array((pairs % len(ids)).astype(np.int32))),
            "tfs": pa.ListArray.from_arrays(pa.array(np.append(ends[:-1], len(counts)).astype(np.int32)), pa.array(counts)),
            "ids": pa.ListArray.from_arrays(pa.array(np.append(np.zeros(rows), len(ids)).astype(np.int32)), ids),
        }
    )


def postings(corpus: DataFrame, segments: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``segment``, ``tok``, ``df`` (texts of the segment with the token), ``uses`` (how often it stands in them), ``docs``
    and ``tfs`` (those texts and how often it stands in each), and a head a segment, see ``invert``."""
    id_type = corpus.schema[id_col].dataType.simpleString()
    texts = corpus.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    texts = texts.select(F.pmod(F.xxhash64(id_col), F.lit(segments)).cast("int").alias("segment"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # Texts move, not their tokens.
    cut = texts.repartition("segment").sortWithinPartitions("segment").select("segment", "id", fx.tokenize(F.col("text")).alias("tokens"))
    return cut.groupBy("segment").applyInArrow(invert, posting_type(id_type))


def build(corpus: DataFrame, path: str, id_col: str = "id", text_col: str = "text", buckets: int = BUCKETS, segment_chars: int = SEGMENT_CHARS) -> str:
    """Write the index of a corpus to ``path``: ``postings`` and ``terms`` (tok, df, idf), partitioned by token bucket, and
    ``sizes`` (n_docs, avgdl, buckets; written last, so that a broken build is none).

    A term of more than half of the texts has a negative weight and takes a share of the mean weight of all terms
    instead. Texts without tokens have no postings, but count in the sizes. A hot token is a row a segment.
    """
    spark = corpus.sparkSession
    id_type = corpus.schema[id_col].dataType.simpleString()
    whole = corpus.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("chars")).first()
    # Small corpora are dealt to all cores.
    segments = max(spark.sparkContext.defaultParallelism, -(-whole["chars"] // segment_chars))
    posts = postings(corpus, segments, id_col, text_col).select("*", bucket(buckets))
    posts.sortWithinPartitions("bucket", "tok").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    # Schemas are stated, as the index of an empty corpus has no files to infer them from.
    posts = spark.read.schema(f"{posting_type(id_type)}, bucket int").parquet(f"{path}/postings").where(F.col("bucket") != HEADS)
    n = F.lit(whole["n_docs"])
    stats = posts.groupBy("tok", "bucket").agg(F.sum("df").alias("df"), F.sum("uses").alias("uses"))
    stats = stats.select("tok", "bucket", "df", "uses", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    # One-row side.
    mean = stats.agg(F.avg("raw").alias("mean"))
    terms = stats.join(F.broadcast(mean)).select("tok", "bucket", "df", "uses", F.when(F.col("raw") < 0, LIMITS.bm25_epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    terms.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    uses = spark.read.schema(TERM).parquet(f"{path}/terms").agg(F.coalesce(F.sum("uses"), F.lit(0)).alias("uses"))
    sizes = uses.select(n.alias("n_docs"), F.try_divide("uses", n).alias("avgdl"), F.lit(buckets).alias("buckets"), F.lit(id_type).alias("id_type"))
    sizes.coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes")
    return path


def refreshed(corpus: DataFrame, name: str, scan: DataFrame, id_col: str = "id", text_col: str = "text") -> str:
    """The path of the corpus's index in the shared folder, built anew where the files of ``scan`` (the table that the
    corpus is made of) are others than those of the stored one: their paths, sizes and times tell."""
    spark = corpus.sparkSession
    files = scan.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    print_ = files.agg(F.coalesce(F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)")), F.lit(0)).alias("print")).first()["print"]
    path = f"{ensure_checkpoint_dir(spark)}/bm25-segments-{name}-{print_}"
    return path if stored_sizes(spark, path) else build(corpus, path, id_col, text_col)


def stored_sizes(spark: SparkSession, path: str):
    """The sizes of an index, or None if none is there."""
    try:
        return spark.read.parquet(f"{path}/sizes").first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def terms(spark: SparkSession, path: str) -> DataFrame:
    """``tok``, ``df``, ``idf`` of an index."""
    return spark.read.schema(TERM).parquet(f"{path}/terms").select("tok", "df", "idf")


def rank(scored: DataFrame, by: str, limit: int, key: str = "query_id") -> DataFrame:
    """The ``limit`` best of each query, ties in id order, with ``rank`` from 1."""
    best = Window.partitionBy(key).orderBy(F.desc(by), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def ranked_segment(avgdl: float, limit: int):
    """A function from a segment's rows (its head, and the asked tokens' rows with ``asked``, ``weights`` of the queries
    that ask them) to ``q``, ``id``, ``score`` of the ``limit`` best texts of each query."""
    k1, b = LIMITS.bm25_k1, LIMITS.bm25_b

    def best(group: pa.Table) -> pa.Table:
        heads = pc.is_null(group.column("tok"))
        # In one order everywhere, so that equal texts of different segments score the same to the last bit.
        head, rows = group.filter(heads), group.filter(pc.invert(heads)).sort_by("tok")
        flat = lambda of, name: of.column(name).combine_chunks().flatten()
        ends = lambda name: np.append(0, np.cumsum(pc.list_value_length(rows.column(name)).to_numpy()))
        ids, sizes = flat(head, "ids"), flat(head, "tfs").to_numpy()
        docs, tfs = flat(rows, "docs").to_numpy(), flat(rows, "tfs").to_numpy()
        part = tfs * (k1 + 1) / (tfs + (k1 * (1 - b + b * sizes / avgdl))[docs])
        at, held = ends("docs"), ends("asked")
        asked, weights = flat(rows, "asked").to_numpy(), flat(rows, "weights").to_numpy()
        row = np.repeat(np.arange(rows.num_rows), np.diff(held))
        order = np.argsort(asked, kind="stable")
        queries, starts = np.unique(asked[order], return_index=True)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for q, of in zip(queries, np.split(order, starts[1:])):
            score = np.zeros(len(ids))
            for k in of:
                its = slice(at[row[k]], at[row[k] + 1])
                score[docs[its]] += weights[k] * part[its]
            doc = np.flatnonzero(score > 0)
            score = score[doc]
            if len(doc) > limit:
                # Whatever may come to the same rounded score as the last of the best stays until it is rounded.
                near = score >= np.partition(score, -limit)[-limit] - 2e-6
                doc, score = doc[near], score[near]
            values, which = np.unique(score, return_inverse=True)
            score = np.array([rounded(v) for v in values])[which]
            kept = np.lexsort((doc, -score))[:limit]
            found.append((np.full(len(kept), q), doc[kept], score[kept]))
        q, doc, score = (np.concatenate(x) for x in zip(*found))
        return pa.table({"q": pa.array(q), "id": ids.take(pa.array(doc)), "score": pa.array(score)})

    return best


def rounded(value: float) -> float:
    """Six places, as Spark's round gives them."""
    return float(Decimal(repr(float(value))).quantize(Decimal("0.000001"), ROUND_HALF_UP))


def search(spark: SparkSession, path: str, queries: DataFrame, limit: int = LIMITS.candidates) -> DataFrame:
    """``query_id``, ``id``, ``score``, ``rank``: the best texts of an index for each of ``queries`` (query_id, text). Only
    the buckets of asked tokens are read.

    A query's repeated tokens count as often as they stand. Texts that score nought or less are left out; a query or
    corpus without tokens finds nothing. Each segment ranks its own texts, and the best of all segments are ranked.
    """
    sizes = stored_sizes(spark, path)
    asked = queries.select("query_id", F.explode(fx.tokenize(F.col("text"))).alias("tok")).groupBy("query_id", "tok").agg(F.count("*").alias("asked"))
    # Queries travel as numbers.
    numbered = stored(asked.select("query_id").distinct().select("query_id", F.monotonically_increasing_id().alias("q")))
    blocks = max(1, -(-numbered.count() // QUERY_BLOCK))
    asked = asked.join(numbered, asked["query_id"].eqNullSafe(numbered["query_id"])).select("q", "tok", "asked", bucket(sizes["buckets"]))
    weight = F.struct("q", (F.col("asked") * F.col("idf")).alias("weight"))
    wanted = spark.read.schema(TERM).parquet(f"{path}/terms").join(asked, ["bucket", "tok"]).groupBy("bucket", "tok", F.pmod(F.xxhash64("q"), F.lit(blocks)).alias("block"))
    wanted = wanted.agg(F.collect_list(weight).alias("by")).select("bucket", "tok", "block", F.col("by.q").alias("asked"), F.col("by.weight").alias("weights"))
    posts = spark.read.schema(f"{posting_type(sizes['id_type'])}, bucket int").parquet(f"{path}/postings")
    heads = posts.where(F.col("bucket") == HEADS).select("segment", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("block"), "tok", "docs", "tfs", "ids")
    heads = heads.select("*", F.lit(None).cast("array<bigint>").alias("asked"), F.lit(None).cast("array<double>").alias("weights"))
    rows = posts.where(F.col("bucket") != HEADS).join(wanted, ["bucket", "tok"]).select("segment", "block", "tok", "docs", "tfs", F.lit(None).cast(f"array<{sizes['id_type']}>").alias("ids"), "asked", "weights")
    best = rows.unionByName(heads).groupBy("segment", "block").applyInArrow(ranked_segment(sizes["avgdl"] or 1.0, limit), f"q long, id {sizes['id_type']}, score double")
    return rank(best.join(numbered, "q").select("query_id", "id", "score"), "score", limit).where(F.col("score") > 0)


def search_corpus(corpus: DataFrame, queries: DataFrame, id_col: str = "id", text_col: str = "text", limit: int = LIMITS.candidates) -> DataFrame:
    """``search`` over an index that is built for this call."""
    path = build(corpus, f"{ensure_checkpoint_dir(corpus.sparkSession)}/bm25-{uuid.uuid4().hex}", id_col, text_col)
    return search(corpus.sparkSession, path, queries, limit)
