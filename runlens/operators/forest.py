"""The forest classifier: TF-IDF over words and word pairs, 100 trees, with saved models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IDF, HashingTF, IndexToString, Normalizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions import columns as C
from runlens.functions.hashing import FEATURES, hashed
from runlens.functions.text import bigrams, tokens
from runlens.storage import durable, scratch

#: Number of trees and seed.
TREES, SEED = 100, 42


def with_terms(rows: DataFrame, text_col: str) -> DataFrame:
    words = tokens(F.col(text_col))
    return rows.withColumn("terms", F.concat(words, bigrams(words)))


def fit(rows: DataFrame, target: str, features: int = FEATURES, depth: int = 10, trees: int = TREES) -> PipelineModel:
    """A model of rows with terms, or with their hashed() counts; the table may be large, the trees see hashed features only.

    Texts are tokenised once: what the trees learn from is written before they grow.
    """
    indexer = StringIndexer(inputCol=target, outputCol="_y", stringOrderType="alphabetAsc").fit(rows)
    hashing = HashingTF(inputCol="terms", outputCol="_tf", numFeatures=features)
    counted = rows if "_tf" in rows.columns else hashing.transform(rows)
    with scratch(rows.sparkSession):
        counted = durable(indexer.transform(counted).select("_y", "_tf"), "forest-counts")
        idf = IDF(inputCol="_tf", outputCol="_idf").fit(counted)
        norm = Normalizer(inputCol="_idf", outputCol="_x", p=2.0)
        grown = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=SEED, predictionCol="_p", probabilityCol="_prob")
        grown = grown.fit(norm.transform(idf.transform(counted)))
    return PipelineModel([indexer, hashing, idf, norm, grown, IndexToString(inputCol="_p", outputCol="predicted", labels=indexer.labels)])


def predict(model: PipelineModel, rows: DataFrame, target: str | None = None) -> DataFrame:
    """rows with predicted and confidence (the largest class probability, in per cent)."""
    known = "_tf" in rows.columns
    live = PipelineModel([s for s in model.stages if (target or not s.__class__.__name__.startswith("StringIndexer")) and not (known and isinstance(s, HashingTF))])
    out = live.transform(rows).withColumn("confidence", F.array_max(vector_to_array("_prob")) * 100)
    return out.drop("_y", "_tf", "_idf", "_x", "_p", "_prob", "rawPrediction")


def save(model: PipelineModel, root: str) -> str:
    """Keep the model under its time and as the latest."""
    name = f"{root.rstrip('/')}/model_v1_{_now()}"
    model.write().overwrite().save(name)
    model.write().overwrite().save(f"{root.rstrip('/')}/latest_model")
    return name


def _now() -> str:
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().range(1).select(C.stamp()).first()[0]


def load(root: str) -> PipelineModel | None:
    """The latest model, or None."""
    from pyspark.sql import SparkSession

    context = SparkSession.getActiveSession().sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/latest_model")
    if not path.getFileSystem(context._jsc.hadoopConfiguration()).exists(path):
        return None
    return PipelineModel.load(path.toString())
