"""Is a paragraph a description? A linear model over hashed word runs, trained on labelled paragraphs.

Defined cases: null and empty texts have no words and score by the intercept alone.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scores from this on count as descriptions.
THRESHOLD = 0.9


def fit(labelled: DataFrame, *, text: str = "text", label: str = "is_desc", runs: int = 2, features: int = 1 << 18, rounds: int = 50) -> PipelineModel:
    """``runs``: longest run of words that is a feature; ``features``: hashed columns, which bound the model's size."""
    stages = [SQLTransformer(statement=f"SELECT *, coalesce(`{text}`, '') AS __text FROM __THIS__"), RegexTokenizer(inputCol="__text", outputCol="__run1", pattern=r"\W+")]
    stages += [NGram(n=n, inputCol="__run1", outputCol=f"__run{n}") for n in range(2, runs + 1)]
    stages.append(SQLTransformer(statement=f"SELECT *, concat({', '.join(f'__run{n}' for n in range(1, runs + 1))}) AS __runs FROM __THIS__"))
    stages.append(HashingTF(numFeatures=features, inputCol="__runs", outputCol="__features"))
    stages.append(LogisticRegression(featuresCol="__features", labelCol=label, probabilityCol="__probability", rawPredictionCol="__raw", predictionCol="__prediction", maxIter=rounds, regParam=0.001))
    return Pipeline(stages=stages).fit(labelled)


def score(model: PipelineModel, paragraphs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``paragraphs`` with ``score`` and ``accepted``."""
    judged = model.transform(paragraphs).withColumn("score", vector_to_array("__probability")[1])
    return judged.select(*(c for c in paragraphs.columns if c not in ("score", "accepted")), "score", (F.col("score") >= threshold).alias("accepted"))
