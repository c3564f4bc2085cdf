"""Models on the features: forecasts with calibrated bands, drop risk, and clusters of series.

The forecast is a boosted regression with empirical residual quantiles per commodity, widened by the conformal step; boosting for quantile loss does not exist in
pyspark.ml, so its figures are not those of a quantile model. Silhouettes are of squared distances."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import conformal_width

NUMERIC = [*(f"d_lag_{k}" for k in (1, 3, 7, 14, 28)), *(f"{s}_{k}" for k in (7, 14, 30) for s in ("mean", "std", "min", "max")), "yoy_change", "momentum_30", "report_freq_30", "since", "state_rel", "state_change_7_prev1", "state_falling_prev1", "state_n_prev1", "dow", "week", "month"]


def _ready(features: DataFrame) -> DataFrame:
    x = features.withColumn("state_rel", F.col("state_lp_prev1") - F.col("lp"))
    return x.withColumns({c: F.col(c).cast("double") for c in NUMERIC})


def _stages() -> list:
    return [Imputer(strategy="median", inputCols=NUMERIC, outputCols=[f"i_{c}" for c in NUMERIC]), StringIndexer(inputCol="commodity", outputCol="c", handleInvalid="keep"), VectorAssembler(inputCols=[*(f"i_{c}" for c in NUMERIC), "c"], outputCol="x")]


def forecast(features: DataFrame, train_until: int, calibrate_until: int, rounds: int = 20, seed: int = 42) -> DataFrame:
    """Forecasts p10, p50, p90 (logs) for days from ``calibrate_until`` on. The model is fitted on days before ``train_until`` whose targets lie before it too, the band's
    residual quantiles on the first half of the days between, and its widening on the second, so that it is calibrated on days it was not fitted on."""
    x = _ready(features).withColumn("y", F.col("target") - F.col("lp"))
    known = x.filter(F.col("y").isNotNull())
    model = Pipeline(stages=[*_stages(), GBTRegressor(featuresCol="x", labelCol="y", maxIter=rounds, maxDepth=4, seed=seed)]).fit(known.filter(F.col("day") < train_until - 7))
    out = model.transform(x.filter(F.col("day") >= train_until)).withColumn("p50", F.col("lp") + F.col("prediction"))
    cal = out.filter((F.col("day") < calibrate_until - 7) & F.col("target").isNotNull())
    half = (train_until + calibrate_until - 7) // 2
    q = cal.filter(F.col("day") < half).withColumn("r", F.col("target") - F.col("p50")).groupBy("commodity").agg(F.percentile("r", 0.1).alias("q10"), F.percentile("r", 0.9).alias("q90"))
    band = lambda d: d.join(F.broadcast(q), "commodity").withColumns({"p10": F.col("p50") + F.least("q10", F.lit(0.0)), "p90": F.col("p50") + F.greatest("q90", F.lit(0.0))})  # noqa: E731  a row per commodity
    width = conformal_width(band(cal.filter(F.col("day") >= half)), "target", "p10", "p90", ["commodity"])
    new = band(out.filter(F.col("day") >= calibrate_until)).join(F.broadcast(width.select("commodity", "width")), "commodity")
    return new.select("market_key", "commodity", "day", "lp", "target", "p50", F.least(F.col("p10") - F.col("width"), F.col("p50")).alias("p10"), F.greatest(F.col("p90") + F.col("width"), F.col("p50")).alias("p90"))


def drop_risk(features: DataFrame, labels: DataFrame, train_until: int, method: str = "boosted", seed: int = 42) -> DataFrame:
    """Probability of a drop for each labelled day from ``train_until`` on, from a classifier weighted for the rarity of drops."""
    y = labels.filter(F.col("is_drop").isNotNull()).select("market_key", "commodity", F.unix_date("date").alias("day"), F.col("is_drop").cast("double").alias("y"))
    x = _ready(features).join(y, ["market_key", "commodity", "day"])
    train = x.filter(F.col("day") < train_until - 14)
    share = train.agg(F.avg("y").alias("s")).first()["s"] or 0.5
    train = train.withColumn("w", F.when(F.col("y") == 1, 0.5 / max(share, 1e-6)).otherwise(0.5 / max(1 - share, 1e-6)))
    if method == "boosted":
        last = [GBTClassifier(featuresCol="x", labelCol="y", weightCol="w", maxIter=20, maxDepth=4, seed=seed)]
    else:
        last = [StandardScaler(inputCol="x", outputCol="z", withMean=True), LogisticRegression(featuresCol="z", labelCol="y", weightCol="w")]
    out = Pipeline(stages=[*_stages(), *last]).fit(train).transform(x.filter(F.col("day") >= train_until))
    return out.select("market_key", "commodity", "day", (F.col("y") == 1).alias("is_drop"), F.round(vector_to_array("probability")[1], 6).alias("risk"))


def clusters(series: DataFrame, columns: list[str], ks: tuple[int, ...] = (3, 4, 5, 6), slack: float = 0.02, seed: int = 42) -> DataFrame:
    """Series with their cluster: k-means on standardised columns, with the largest k whose silhouette is within ``slack`` of the best."""
    prep = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="v", handleInvalid="skip"), StandardScaler(inputCol="v", outputCol="features", withMean=True)]).fit(series)
    x = prep.transform(series)
    tried = []
    for k in ks:
        m = KMeans(k=k, seed=seed).fit(x)
        tried.append((k, ClusteringEvaluator().evaluate(m.transform(x)), m))
    best = max(s for _, s, _ in tried)
    k, s, m = max((t for t in tried if t[1] >= best - slack), key=lambda t: t[0])
    return m.transform(x).drop("v", "features").withColumnRenamed("prediction", "cluster").withColumns({"k": F.lit(k), "silhouette": F.lit(round(s, 4))})
