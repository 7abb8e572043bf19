"""Feature table, training, guarded updates and prediction of the multiclass risk model with pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill import fixed_values as V
from ledgermill.operators.incremental import one_per_group
from ledgermill.operators.statements import ItemReader
from ledgermill.session import materialise

UPDATED, EMPTY, UNSEEN, SINGLE_CLASS, NO_MODEL = "updated", "empty", "unseen_label", "single_class", "no_model"
TREES, DEPTH, ROUNDS, SEED = 50, 6, 20, 42


@dataclass(frozen=True)
class RiskModel:
    """Feature pipeline fitted first, classifier fitted last, and the label dictionary."""
    features: PipelineModel
    classifier: object
    labels: tuple[str, ...]

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.features.write().overwrite().save(f"{path}/features")
        PipelineModel([self.classifier]).write().overwrite().save(f"{path}/classifier")
        spark.createDataFrame([(i, n) for i, n in enumerate(self.labels)], "pos INT, label STRING").coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/labels")

    @classmethod
    def load(cls, path: str) -> "RiskModel":
        rows = SparkSession.active().read.parquet(f"{path}/labels").orderBy("pos").collect()
        return cls(PipelineModel.load(f"{path}/features"), PipelineModel.load(f"{path}/classifier").stages[0],
                   tuple(r["label"] for r in rows))


def statement_features(pairs: DataFrame, sector: str = "sector") -> DataFrame:
    """Model features from statement pairs (items, items_t1): the ratios that can be derived from the items."""
    loaded, now = ItemReader.load(pairs, "items", [
        V.CURRENT_ASSETS, V.CURRENT_LIABILITIES, V.LIABILITIES, V.EQUITY, V.NET_INCOME, V.SALES, V.ASSETS, V.PRETAX,
        V.INTEREST])
    loaded, old = ItemReader.load(loaded, "items_t1", [V.SALES])
    n = now.number
    ebit = n(V.PRETAX) + n(V.INTEREST)
    derived = {
        "CurrentRatio": F.try_divide(n(V.CURRENT_ASSETS), n(V.CURRENT_LIABILITIES)),
        "DebtToEquityRatio": F.try_divide(n(V.LIABILITIES), n(V.EQUITY)),
        "NetProfitMargin": F.try_divide(n(V.NET_INCOME), n(V.SALES)),
        "ROA": F.try_divide(ebit, n(V.ASSETS)), "ROE": F.try_divide(n(V.NET_INCOME), n(V.EQUITY)),
        "InterestCoverageRatio": F.try_divide(ebit, n(V.INTEREST)),
        "SalesGrowth": F.try_divide(n(V.SALES), old.number(V.SALES)) - 1,
        "AssetTurnover": F.try_divide(n(V.SALES), n(V.ASSETS)),
        "OperatingMargin": F.try_divide(ebit, n(V.SALES)),
    }
    keep = [c for c in pairs.columns if c not in ("items", "items_t1", sector)]
    return loaded.select(*keep, *[v.alias(k) for k, v in derived.items()], F.col(sector).alias(V.SECTOR))


def select_features(table: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Known numeric features (absent ones as null, NaN as null), the sector ('Unknown' if absent) and extra columns."""
    def number(name: str):
        if name not in table.columns:
            return F.lit(None).cast("double").alias(name)
        value = F.col(name).cast("double")
        return F.when(~F.isnan(value), value).alias(name)
    sector = (F.coalesce(F.col(V.SECTOR).cast("string"), F.lit("Unknown")) if V.SECTOR in table.columns
              else F.lit("Unknown"))
    return table.select(*extra, *[number(f) for f in V.NUMERIC_FEATURES], sector.alias(V.SECTOR))


def fit_scale(table: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, mean, std: population deviation without missing values; a deviation of 0 counts as 1."""
    stats = [F.struct(F.lit(f).alias("feature"), F.avg(f).alias("mean"), F.stddev_pop(f).alias("std")) for f in features]
    return (table.agg(F.array(*stats).alias("s")).select(F.inline("s"))
            .withColumn("std", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std"))))


def apply_scale(table: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    return table.withColumns({f: (F.col(f) - mean) / std for f, (mean, std) in scale.items()})


def _feature_pipeline(table: DataFrame) -> PipelineModel:
    """Scaling as one SQL stage (so it is saved with the model), indicators for missing values, encoded sector."""
    rows = fit_scale(table, V.NUMERIC_FEATURES).collect()          # one row per feature
    scaled = []
    for r in rows:
        f = r["feature"]
        if r["mean"] is None:
            scaled.append(f"double(0) AS `{f}__z`, double(1) AS `{f}__na`")
        else:
            scaled.append(f"coalesce((`{f}` - {r['mean']!r}D) / {r['std']!r}D, 0D) AS `{f}__z`, "
                          f"double(`{f}` IS NULL) AS `{f}__na`")
    inputs = [f"{f}__{k}" for f in V.NUMERIC_FEATURES for k in ("z", "na")]
    stages = [
        SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__"),
        StringIndexer(inputCol=V.SECTOR, outputCol="sector__i", handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=["sector__i"], outputCols=["sector__v"], dropLast=False),
        VectorAssembler(inputCols=[*inputs, "sector__v"], outputCol="features"),
    ]
    return Pipeline(stages=stages).fit(table)


def _fit_classifier(prepared: DataFrame, algorithm: str):
    if algorithm == "forest":
        return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxMemoryInMB=1024).fit(prepared)
    if algorithm == "boosted":
        return OneVsRest(classifier=GBTClassifier(maxIter=ROUNDS, stepSize=0.1, maxDepth=DEPTH, seed=SEED)).fit(prepared)
    raise ValueError(f"unknown algorithm: {algorithm}")


def _prepared(model_features: PipelineModel, labels: Sequence[str], table: DataFrame) -> DataFrame:
    index = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(V.TARGET)) - 1
    return model_features.transform(table).select("features", index.cast("double").alias("label"))


def train(table: DataFrame, algorithm: str = "forest") -> RiskModel | None:
    """Fit the scaling, the label dictionary (alphabetical) and the classifier on the rows that have a label; None if none has."""
    data = materialise(select_features(table, [V.TARGET]).where(F.col(V.TARGET).isNotNull()))      # read by every fitting step
    labels = tuple(StringIndexer(inputCol=V.TARGET, outputCol="_label", stringOrderType="alphabetAsc").fit(data).labels)
    if not labels:
        return None
    features = _feature_pipeline(data)
    return RiskModel(features, _fit_classifier(_prepared(features, labels, data), algorithm), labels)


def update_guard(batch: DataFrame, model: RiskModel | None) -> str:
    """Why a batch may not update the model, or 'updated'; one aggregate of the batch."""
    unseen = F.lit(False) if model is None else ~F.col(V.TARGET).isin(list(model.labels))
    row = batch.agg(F.count(F.lit(1)).alias("rows"), F.count_if(unseen | F.col(V.TARGET).isNull()).alias("unseen"),
                    F.min(V.TARGET).alias("low"), F.max(V.TARGET).alias("high")).first()
    if row["rows"] == 0:
        return EMPTY
    if model is None:
        return NO_MODEL
    if row["unseen"]:
        return UNSEEN
    return SINGLE_CLASS if row["low"] == row["high"] else UPDATED


def update(batch: DataFrame, model: RiskModel | None, history: DataFrame,
           algorithm: str = "forest") -> tuple[RiskModel | None, str]:
    """Refit the classifier on the history together with the batch; scaling and labels stay as first fitted.

    A batch that fails a guard leaves the model as it is."""
    status = update_guard(batch, model)
    if status != UPDATED:
        return model, status
    data = materialise(select_features(history, [V.TARGET]).unionByName(select_features(batch, [V.TARGET])))
    return RiskModel(model.features, _fit_classifier(_prepared(model.features, model.labels, data), algorithm),
                     model.labels), status


def predict(table: DataFrame, model: RiskModel | None, keep: Sequence[str] = ()) -> DataFrame:
    """keep columns, risk_category, risk_score, probabilities MAP<class, DOUBLE>, error."""
    if model is None:
        return table.select(*keep, F.lit(None).cast("string").alias("risk_category"),
                            F.lit(None).cast("double").alias("risk_score"),
                            F.lit(None).cast("map<string,double>").alias("probabilities"),
                            F.lit(V.MODEL_NOT_LOADED).alias("error"))
    names = F.array(*[F.lit(x) for x in model.labels])
    scored = model.classifier.transform(model.features.transform(select_features(table, keep)))
    raw = "probability" if "probability" in scored.columns else "rawPrediction"
    values = vector_to_array(F.col(raw))
    if raw == "rawPrediction":                          # one-vs-rest margins to shares
        odds = F.transform(values, lambda m: 1 / (1 + F.exp(-2 * m)))
        values = F.transform(odds, lambda o: o / F.aggregate(odds, F.lit(0.0), lambda a, x: a + x))
    label = F.get(names, F.col("prediction").cast("int"))
    points = F.create_map(*[F.lit(x) for pair in V.RISK_POINTS.items() for x in pair])
    return scored.select(*keep, label.alias("risk_category"), F.try_element_at(points, label).alias("risk_score"),
                         F.map_from_arrays(names, F.slice(values, 1, len(model.labels))).alias("probabilities"),
                         F.lit(None).cast("string").alias("error"))


def sample_predictions(table: DataFrame, model: RiskModel | None, group: str = V.SECTOR, key: str = "UniqueID",
                       keep: Sequence[str] = ()) -> DataFrame:
    """Predictions for one pseudo-random row of every group."""
    names = list(dict.fromkeys([key, group, *keep]))
    renamed = one_per_group(table, group, key).withColumn("_group", F.col(group))
    out = predict(renamed, model, [n for n in names if n != group] + ["_group"])
    return out.withColumnRenamed("_group", group)


def slice_rows(table: DataFrame, sectors: Sequence[str] | None = None, first_year: int | None = None,
               last_year: int | None = None) -> DataFrame:
    """Rows of the sectors within the years; plain predicates that reach the scan."""
    if sectors is not None:
        table = table.where(F.col(V.SECTOR).isin(list(sectors)))
    if first_year is not None:
        table = table.where(F.col("PeriodeTahun") >= first_year)
    if last_year is not None:
        table = table.where(F.col("PeriodeTahun") <= last_year)
    return table


def staged_training(table: DataFrame, initial: DataFrame, batches: Sequence[tuple[str, DataFrame]],
                    algorithm: str = "forest") -> tuple[RiskModel | None, list[tuple[str, str]]]:
    """Train on the first slice, then offer the batches in turn. Accepted batches join the history."""
    model, log, history = train(initial, algorithm), [], initial
    for name, batch in batches:
        status = update_guard(batch, model)
        if status == UPDATED:
            model, status = update(batch, model, history, algorithm)
            history = history.unionByName(batch, allowMissingColumns=True)
        log.append((name, status))
    return model, log
