"""Prompt classification: hashed n-gram features, logistic regression, held-out accuracy; capable models by need."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, NGram, RegexTokenizer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on at most (a documented bound; all rows are then classified).
FIT_ROWS = 20_000
#: Bits of a hash that tell its range.
RANGE_BITS = 12


def split(labelled: DataFrame, label: str, key: str, share: float = 0.2) -> DataFrame:
    """``labelled`` with ``held_out``: a fixed share of each label's rows, chosen by a hash of the key."""
    # Ranks are those of one window a label, but counted over ranges of hashes, so that no label is sorted in one task.
    ranged = labelled.withColumn("hashed", F.xxhash64(key)).withColumn("range", F.shiftright("hashed", 64 - RANGE_BITS))
    counts = ranged.groupBy(F.col(label).alias("of"), F.col("range").alias("at")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("of")
    before = F.coalesce(F.sum("n").over(w.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("of", "at", before.alias("before"), F.sum("n").over(w).alias("all"))
    joined = ranged.join(counts, F.col(label).eqNullSafe(F.col("of")) & (F.col("range") == F.col("at")))
    place = F.col("before") + F.rank().over(Window.partitionBy(label, "range").orderBy("hashed", key)) - 1
    return joined.withColumn("held_out", place / F.greatest(F.col("all") - 1, F.lit(1)) < share).select(*labelled.columns, "held_out")


def pipeline(text: str, label: str, features: int = 1 << 14) -> Pipeline:
    """Words and word pairs with inverse document frequency, then logistic regression over all labels."""
    return Pipeline(
        stages=[
            StringIndexer(inputCol=label, outputCol="label_index", handleInvalid="skip", stringOrderType="alphabetAsc"),
            RegexTokenizer(inputCol=text, outputCol="words", pattern=r"\W+", minTokenLength=1),
            NGram(inputCol="words", outputCol="pairs", n=2),
            HashingTF(inputCol="words", outputCol="tf_words", numFeatures=features),
            HashingTF(inputCol="pairs", outputCol="tf_pairs", numFeatures=features),
            IDF(inputCol="tf_words", outputCol="w"),
            IDF(inputCol="tf_pairs", outputCol="p"),
            VectorAssembler(inputCols=["w", "p"], outputCol="features"),
            LogisticRegression(labelCol="label_index", featuresCol="features", maxIter=30, regParam=0.01),
        ]
    )


def fit(labelled: DataFrame, text: str, label: str, key: str) -> PipelineModel:
    """A classifier of at most FIT_ROWS labelled rows, those with the least hashes of their keys."""
    few = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull()).orderBy(F.xxhash64(key), key).limit(FIT_ROWS)
    return pipeline(text, label).fit(few)


def classify(model: PipelineModel, rows: DataFrame, label: str) -> DataFrame:
    """``rows`` with ``predicted`` (a label) and ``confidence`` (its probability)."""
    labels = model.stages[0].labels
    rows = rows.withColumn(label, F.coalesce(label, F.lit(labels[0])))
    scored = SQLTransformer(statement="SELECT * FROM __THIS__").transform(PipelineModel(model.stages[1:]).transform(rows))
    chances = vector_to_array("probability")
    names = F.array(*map(F.lit, labels))
    return scored.withColumn("confidence", F.array_max(chances)).withColumn("predicted", F.element_at(names, F.col("prediction").cast("int") + 1)).select(*rows.columns, "predicted", "confidence")


def fit_vectors(labelled: DataFrame, vector: str, label: str, key: str, strength: float = 10.0) -> PipelineModel:
    """A classifier over given vectors (arrays), of at most FIT_ROWS labelled rows; ``strength`` is the inverse of the
    regularisation of all rows together."""
    few = labelled.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).orderBy(F.xxhash64(key), key).limit(FIT_ROWS)
    few = few.withColumn("features", array_to_vector(vector))
    stages = [
        StringIndexer(inputCol=label, outputCol="label_index", handleInvalid="skip", stringOrderType="alphabetAsc"),
        LogisticRegression(labelCol="label_index", featuresCol="features", maxIter=100, regParam=1.0 / (strength * max(few.count(), 1))),
    ]
    return Pipeline(stages=stages).fit(few)


def cheapest_capable(needs: DataFrame, models: DataFrame) -> DataFrame:
    """``need``, ``model_id``, ``alternatives`` of each need: the capable model of least size (then the first in order), the
    other capable ones by size."""
    held = models.select("model_id", "size_mb", F.explode("capabilities").alias("need"))
    listed = needs.select("need").distinct().join(held, "need", "left").groupBy("need")
    order = F.array_sort(F.collect_list(F.when(F.col("model_id").isNotNull(), F.struct("size_mb", "model_id"))))
    ids = listed.agg(F.transform(order, lambda m: m["model_id"]).alias("ids"))
    return ids.select("need", F.get("ids", 0).alias("model_id"), F.slice("ids", F.lit(2), F.size("ids")).alias("alternatives"))
