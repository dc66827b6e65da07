"""Spark ML models: boosted trees for risk, principal components for the population map."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from sleuthflow import catalog
from sleuthflow.functions.columns import band
from sleuthflow.operators.contracts import check_features, check_ops
from sleuthflow.operators.entity import operational_to_features
from sleuthflow.operators.quality import assert_no_leakage
from sleuthflow.session import scratch_path


def _assembler(feature_names: list[str], output: str) -> VectorAssembler:
    return VectorAssembler(inputCols=feature_names, outputCol=output, handleInvalid="error")


def train_risk_model(
    train: DataFrame,
    feature_names: list[str] = catalog.FEATURES,
    trees: int = 300,
    learning_rate: float = 0.05,
    depth: int = 6,
    min_child: int = 5,
    seed: int = 42,
    checkpoint_every: int = 10,
) -> PipelineModel:
    """Gradient-boosted trees on `label`. NaN, Inf and NULL features stop the fit."""
    assert_no_leakage(feature_names)
    context = train.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_path(train.sparkSession, "boosting"))
    booster = GBTClassifier(
        featuresCol="features",
        labelCol="label",
        maxIter=trees,
        stepSize=learning_rate,
        maxDepth=depth,
        minInstancesPerNode=min_child,
        seed=seed,
        checkpointInterval=checkpoint_every,
    )
    finite = [F.when(F.abs(F.col(c)) != F.lit(float("inf")), F.col(c)).alias(c) for c in feature_names]
    return Pipeline(stages=[_assembler(feature_names, "features"), booster]).fit(train.select("label", *finite))


def predict_risk(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Probability and label per row; rows outside the feature bounds keep NULLs and get a `reason`."""
    checked = check_features(features.drop("features_vector"))
    names = model.stages[0].getInputCols()
    good = F.col("reason").isNull()
    # The model sees a legal stand-in for a rejected row; its result is blanked below.
    stand_in = {n: F.when(good, F.col(n)).otherwise(F.lit(catalog.FEATURE_BOUNDS[n][0])) for n in names}
    kept = checked.withColumns({f"_own_{n}": F.col(n) for n in names}).withColumns(stand_in)
    had_features = "features" in kept.columns
    if had_features:
        kept = kept.withColumnRenamed("features", "_features")
    scored = model.transform(kept)
    probability = F.when(good, vector_to_array("probability")[1])
    result = scored.withColumn("probability", probability).withColumns({n: F.col(f"_own_{n}") for n in names})
    result = result.drop("features", "rawPrediction", "prediction", *[f"_own_{n}" for n in names])
    if had_features:
        result = result.withColumnRenamed("_features", "features")
    return result.withColumns(
        {
            "label_text": F.when(good, band(F.col("probability"), catalog.MODEL_BANDS, "Low")),
            "threshold_policy": F.lit(catalog.THRESHOLD_POLICY),
            "threshold_values": F.create_map(
                *[F.lit(x) for limit, name in reversed(catalog.MODEL_BANDS) for x in (name.lower(), limit)]
            ),
        }
    )


def predict_from_ops(model: PipelineModel, ops: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(predictions with the derived features, quarantined facts with their reason)."""
    checked = check_ops(ops)
    features = operational_to_features(checked.where(F.col("reason").isNull()), keep=[key])
    return predict_risk(model, features), checked.where(F.col("reason").isNotNull())


def feature_importances(model: PipelineModel, top: int | None = None) -> DataFrame:
    """Importances scaled to sum to 1, largest first."""
    if top is not None and not 1 <= top <= len(catalog.FEATURES):
        raise ValueError(f"top must be between 1 and {len(catalog.FEATURES)}")
    booster = model.stages[-1]
    names = model.stages[0].getInputCols()
    weights = [float(w) for w in booster.featureImportances.toArray()]
    total = sum(weights)
    rows = [(n, w / total if total > 0 else w) for n, w in zip(names, weights)]
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    table = spark.createDataFrame(rows, "feature string, importance double")
    ranked = table.orderBy(F.desc("importance"), F.asc("feature"))
    return ranked.limit(top) if top else ranked


@dataclass
class PopulationMap:
    """Fitted scaler and two principal components, with signs and scale fixed."""

    model: PipelineModel
    factors: tuple[float, float]

    @property
    def feature_names(self) -> list[str]:
        return self.model.stages[0].getInputCols()

    def project(self, df: DataFrame) -> DataFrame:
        """PCA1 and PCA2 for the fitted rows or for new ones; other columns pass through."""
        axes = vector_to_array("_components")
        return (
            self.model.transform(df)
            .withColumns({f"PCA{i + 1}": axes[i] * F.lit(f) for i, f in enumerate(self.factors)})
            .drop("_raw", "_scaled", "_components")
        )


def fit_population_map(df: DataFrame, feature_names: list[str] = catalog.FEATURES) -> PopulationMap:
    """Standardise, then two components.

    Spark scales by the sample deviation; the factor sqrt(n / (n - 1)) turns that into the population
    deviation. Each component is turned so that its largest loading is positive.
    """
    if feature_names != catalog.FEATURES:
        raise ValueError(f"features must be in catalog order: {catalog.FEATURES}")
    stages = [
        _assembler(feature_names, "_raw"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
        PCA(k=2, inputCol="_scaled", outputCol="_components"),
    ]
    rows = df.select(*feature_names)
    model = Pipeline(stages=stages).fit(rows)
    loadings = model.stages[-1].pc.toArray()
    if loadings.shape != (len(feature_names), 2):
        raise ValueError(f"unexpected component shape {loadings.shape}")
    n = rows.count()
    scale = (n / (n - 1)) ** 0.5 if n > 1 else 1.0
    signs = [1.0 if column[abs(column).argmax()] >= 0 else -1.0 for column in loadings.T]
    return PopulationMap(model, (signs[0] * scale, signs[1] * scale))


def population_layers(projected: DataFrame) -> DataFrame:
    """Layers of the map; a borderline row is in its class layer and in the borderline layer."""
    layer = {
        "legit": F.col("label") == 0,
        "pyramid": F.col("label") == 1,
        "borderline": F.col("is_borderline"),
    }
    parts = [projected.where(rule).withColumn("layer", F.lit(name)) for name, rule in layer.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def layer_summary(layers: DataFrame) -> DataFrame:
    return layers.groupBy("layer").agg(
        F.count("*").alias("n"), F.avg("PCA1").alias("center_pca1"), F.avg("PCA2").alias("center_pca2")
    )
