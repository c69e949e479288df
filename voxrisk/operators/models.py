"""Regression on two numeric columns and the trained sentiment score, on Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import HashingTF, PolynomialExpansion, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxrisk.operators import bagged

SEED = 42
TEST_TENTHS = 2


def numeric_pair(df: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """Rows with both numbers, and which side of the 80/20 split they fall on.

    The side follows from a digest of the row key: the same on every run and in every engine.
    """
    side = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint") % 10 < TEST_TENTHS
    return df.select(
        key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), side.alias("is_test")
    ).filter(F.col("x").isNotNull() & F.col("y").isNotNull())


def regression_metrics(predicted: DataFrame) -> DataFrame:
    """R2, MSE, RMSE and MAE for the training and the test rows, in one pass.

    The sums are taken around the mean of each side by ``var_pop``, which does not
    lose digits.
    """
    error = F.col("y") - F.col("prediction")
    out = predicted.groupBy("is_test").agg(
        F.count("*").alias("n"),
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.var_pop("y").alias("_var"),
    )
    return out.select(
        F.when(F.col("is_test"), "test").otherwise("train").alias("part"), "n",
        (1 - F.try_divide("mse", "_var")).alias("r2"), "mse", F.sqrt("mse").alias("rmse"), "mae",
    )


def fit_polynomial(pairs: DataFrame, degree: int = 1) -> PipelineModel:
    stages = [VectorAssembler(inputCols=["x"], outputCol="_x1")]
    features = "_x1"
    if degree > 1:
        stages.append(PolynomialExpansion(degree=degree, inputCol="_x1", outputCol="_xn"))
        features = "_xn"
    stages.append(LinearRegression(featuresCol=features, labelCol="y", solver="normal"))
    return Pipeline(stages=stages).fit(pairs.filter(~F.col("is_test")))


def coefficients(model: PipelineModel) -> tuple[float, list[float]]:
    line = model.stages[-1]
    return float(line.intercept), [float(c) for c in line.coefficients]


def expression(intercept: float, coefs: list[float]) -> str:
    """``y=1.0000+2.0000*x-3.0000*x^2``."""
    terms = [f"{intercept:.4f}"]
    for power, c in enumerate(coefs, 1):
        name = "x" if power == 1 else f"x^{power}"
        terms.append(f"{'+' if c >= 0 else '-'}{abs(c):.4f}*{name}")
    return "y=" + "".join(terms)


def fit_forest(pairs: DataFrame, trees: int = 100, depth: int = 5) -> PipelineModel:
    """The model that Spark ML fits, without a copy of the rows: ``bagged`` adds up what the trees need."""
    assembler = VectorAssembler(inputCols=["x"], outputCol="_x1")
    forest = RandomForestRegressor(featuresCol="_x1", labelCol="y", numTrees=trees, maxDepth=depth, seed=SEED)
    rows = pairs.filter(~F.col("is_test"))
    model = bagged.fit(forest, rows)
    return Pipeline(stages=[assembler, forest]).fit(rows) if model is None else PipelineModel([assembler, model])


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds ``prediction`` to rows with a column ``x``."""
    if isinstance(model.stages[-1], RandomForestRegressionModel):
        return bagged.predict(model.stages[-1], rows)
    return model.transform(rows).drop("_x1", "_xn")


def residuals(predicted: DataFrame) -> DataFrame:
    return predicted.withColumn("residual", F.col("y") - F.col("prediction"))


def line_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line over all rows as plain aggregates."""
    return df.agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
    )


def fit_sentiment(labelled: DataFrame, content: str = "content", label: str = "label", features: int = 1 << 16) -> PipelineModel:
    """Naive Bayes over hashed word counts. Hashing needs no vocabulary on the driver."""
    words = RegexTokenizer(inputCol=content, outputCol="_words", pattern=r"[\p{L}\p{N}]+", gaps=False, minTokenLength=2)
    counts = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features)
    bayes = NaiveBayes(featuresCol="_tf", labelCol=label, smoothing=1.0)
    return Pipeline(stages=[words, counts, bayes]).fit(labelled)


def sentiment_probability(column: str = "probability") -> Column:
    return vector_to_array(F.col(column))[1]


def score_sentiment(model: PipelineModel, df: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``model_score``, the probability of the positive class; 0.5 without text."""
    scored = model.transform(df.withColumn(content, F.coalesce(content, F.lit(""))))
    score = F.when(F.size("_words") == 0, F.lit(0.5)).otherwise(sentiment_probability())
    return scored.withColumn("model_score", score).drop("_words", "_tf", "rawPrediction", "probability", "prediction")
