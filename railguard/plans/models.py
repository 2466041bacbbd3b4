"""Models that produce the two prediction columns: Spark ML pipelines frozen as bundles."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Bucketizer, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from railguard.functions.columns import Y_MAX, Y_MIN, clip, require_finite
from railguard.operators.contracts import forbid_columns
from railguard.operators.quantiles import column_quantiles
from railguard.session import durable

# Outcome columns that may never be features.
OUTCOMES = ("truth", "label", "target")
#: Bins of a feature that trees tell apart (Spark's own default), and the weight of their cells.
BINS = 32
CELL_WEIGHT = "_cell_weight"


def add_indicators(df: DataFrame, features: list[str]) -> DataFrame:
    """0/1 column per feature that says whether it was missing before imputation."""
    flags = {f"missing__{c}": F.col(c).isNull().cast("double") for c in features}
    return df.withColumns(flags)


def impute_median(df: DataFrame, features: list[str]) -> SQLTransformer:
    """Fill ``features`` with their medians over ``df`` (the mean of the middle pair).

    The medians are exact, and no task holds all values of a column. They become constants
    of the transformer, which serves every later table.
    """
    found = column_quantiles(df, features, [0.5])
    return _filled({name: values[0] if values else 0.0 for name, values in found.items()})


def _filled(medians: dict[str, float]) -> SQLTransformer:
    filled = ", ".join(f"COALESCE(CAST({c} AS DOUBLE), {v!r}D) AS imputed__{c}" for c, v in medians.items())
    return SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__")


@dataclass(frozen=True)
class MedianPipeline:
    """A pipeline whose medians are taken from what ``fit`` is given."""

    prepare: list[SQLTransformer]
    features: list[str]
    rest: list

    def fit(self, df: DataFrame) -> PipelineModel:
        filled = impute_median(PipelineModel(self.prepare).transform(df), self.features)
        return Pipeline(stages=[*self.prepare, filled, *self.rest]).fit(df)


@dataclass(frozen=True)
class BinnedPipeline:
    """Medians, bins between exact quantiles, and trees fitted on the cells of the bins.

    A tree sees a record only by the bins of its features, and squared error needs of the
    records of a cell their weight and their mean label. So all records are added up per cell
    first (at most ``bins`` to the power of the features), and the trees, however many, pass
    over the cells. Records without weight count 1. A missing label or weight stops the job.
    ``minInstancesPerNode`` means records: a node holds at least the weight of so many average
    ones. The bootstrap of a forest draws cells.
    """

    prepare: list[SQLTransformer]
    features: list[str]
    rest: list
    label: str
    weight: str | None
    bins: int

    def fit(self, df: DataFrame) -> PipelineModel:
        probs = [i / self.bins for i in range(1, self.bins)]
        cuts = column_quantiles(PipelineModel(self.prepare).transform(df), self.features, [0.5, *probs])
        filled = _filled({c: v[0] if v else 0.0 for c, v in cuts.items()})
        # A value that is itself a cut opens the bin above it, so few distinct values keep one each.
        edges = [sorted({x + 0.0 for x in cuts[c][1:] if math.isfinite(x)}) or [0.0] for c in self.features]
        binned = Bucketizer(
            splitsArray=[[-math.inf, *e, math.inf] for e in edges],
            inputCols=[f"imputed__{c}" for c in self.features],
            outputCols=[f"bin__{c}" for c in self.features], handleInvalid="keep",
        )
        front = [*self.prepare, filled, binned]
        places = [f"{kind}__{c}" for kind in ("bin", "missing") for c in self.features]
        weight = require_finite(self.weight, self.weight) if self.weight else F.lit(1.0)
        label = require_finite(self.label, self.label)
        summed = PipelineModel(front).transform(df).groupBy(*places).agg(
            F.sum(weight).alias(CELL_WEIGHT), F.sum(weight * label).alias("_total"), F.count(F.lit(1)).alias("_records")
        )
        cells = summed.filter(F.col(CELL_WEIGHT) > 0).withColumn(self.label, F.col("_total") / F.col(CELL_WEIGHT))
        # Trees pass over the cells many times; the records are read for them once.
        cells = durable(cells.drop("_total"))
        records = cells.agg(F.sum("_records")).first()[0] or 1
        *before, trees = self.rest
        share = min(0.49, trees.getMinInstancesPerNode() / records)
        trees = trees.copy({trees.minInstancesPerNode: 1, trees.minWeightFractionPerNode: share})
        fitted = Pipeline(stages=[*before, trees]).fit(cells)
        return PipelineModel([*front, *fitted.stages])


TREES = ("forest", "boosting")


def backbone(kind: str, label: str, weight: str | None, seed: int, **settings):
    """Regressor by name.  Extremely randomised trees are not in Spark ML: random forests.

    ``settings`` are Spark ML parameters of the regressor (``maxDepth``, ``numTrees``,
    ``featureSubsetStrategy``, ``regParam``, ...) and replace the defaults given here. Spark
    grows trees to 30 levels at most; the default of 8 keeps a bundle small.
    """
    common = {"featuresCol": "features", "labelCol": label, "predictionCol": "raw_prediction"}
    if weight:
        common["weightCol"] = weight
    if kind == "forest":
        chosen = {"numTrees": 80, "minInstancesPerNode": 20, "maxDepth": 8, "featureSubsetStrategy": "0.8"}
        return RandomForestRegressor(seed=seed, **common, **(chosen | settings))
    if kind == "boosting":
        return GBTRegressor(seed=seed, **common, **({"maxIter": 40, "maxDepth": 4} | settings))
    if kind == "ridge":
        return LinearRegression(**common, **({"regParam": 1.0, "elasticNetParam": 0.0} | settings))
    raise ValueError(f"unknown backbone {kind}")


def build_pipeline(
    features: list[str], label: str, *, kind: str = "forest", log_column: str | None = None,
    weight: str | None = None, scale: bool = False, seed: int = 17, **settings,
) -> MedianPipeline | BinnedPipeline:
    """log1p of the order key -> indicators -> medians -> (bins) -> vector -> (scaling) -> model.

    Every transformation is part of the pipeline, so a saved bundle applies exactly what
    it was fitted with. Trees work on bins (``maxBins`` of the settings, else ``BINS``); scaling
    does not change them.
    """
    forbid_columns(features, OUTCOMES)
    stages = []
    inputs = list(features)
    if log_column:
        stages.append(SQLTransformer(statement=f"SELECT *, log1p({log_column}) AS log__{log_column} FROM __THIS__"))
        inputs = [f"log__{c}" if c == log_column else c for c in inputs]
    flags = ", ".join(f"CAST({c} IS NULL AS DOUBLE) AS missing__{c}" for c in inputs)
    stages.append(SQLTransformer(statement=f"SELECT *, {flags} FROM __THIS__"))
    if kind in TREES:
        bins = settings.get("maxBins", BINS)
        assembler = VectorAssembler(inputCols=[f"{k}__{c}" for k in ("bin", "missing") for c in inputs], outputCol="features")
        # ``keep`` gives NaN a bin of its own beside the others.
        trees = backbone(kind, label, CELL_WEIGHT, seed, **(settings | {"maxBins": bins + 1}))
        return BinnedPipeline(stages, inputs, [assembler, trees], label, weight, bins)
    rest = []
    vector = [f"imputed__{c}" for c in inputs] + [f"missing__{c}" for c in inputs]
    rest.append(VectorAssembler(inputCols=vector, outputCol="assembled" if scale else "features"))
    if scale:
        rest.append(StandardScaler(withMean=True, inputCol="assembled", outputCol="features"))
    rest.append(backbone(kind, label, weight, seed, **settings))
    return MedianPipeline(stages, inputs, rest)


def predict(model: PipelineModel, df: DataFrame, out: str = "prediction") -> DataFrame:
    """Clipped predictions; helper columns of the pipeline are dropped."""
    scored = model.transform(df).withColumn(out, clip("raw_prediction", Y_MIN, Y_MAX))
    return scored.select(*df.columns, out)


def leave_one_domain_out(
    df: DataFrame, domains: list[str], pipelines: dict[str, MedianPipeline | BinnedPipeline], *, domain: str = "domain",
) -> DataFrame:
    """One model per left-out domain; every record is predicted by models that never saw it.

    ``pipelines`` by the name of their prediction column. All are fitted on the table itself,
    not on what others have added to it. The loop runs over declared domains, a short list;
    fitting itself is distributed.
    """
    parts = []
    for name in domains:
        seen, part = df.filter(F.col(domain) != name), df.filter(F.col(domain) == name)
        for out, pipeline in pipelines.items():
            part = predict(pipeline.fit(seen), part, out)
        parts.append(part)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
