"""Global boosted-tree models: one model for all series, many fits in one job."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.forecast import boosting
from shelfcast.forecast.boosting import MISSING, Ensemble, Fit, TreeParameters
from shelfcast.operators.features import CATEGORICAL, FEATURES, Date, date_value, model_columns
from shelfcast.schemas import SALES_GRAIN

#: Ends the names of encoded features.
INPUT = "_input"


def encode_categories(frame: DataFrame, columns: list[str] | None = None):
    """Indexers fitted in one pass; labels in text order, unseen values get an index of their own."""
    chosen = CATEGORICAL if columns is None else columns
    return StringIndexer(
        inputCols=chosen, outputCols=[f"{c}_index" for c in chosen], handleInvalid="keep",
        stringOrderType="alphabetAsc").fit(frame)


def encoded(frame: DataFrame, indexer: StringIndexerModel | None, features: Sequence[str], *kept: str) -> DataFrame:
    """The ``kept`` columns and the features as numbers: categories by the order of their text, missing values by a marker."""
    categorical = [c for c in CATEGORICAL if c in features]
    table = indexer.transform(frame) if categorical else frame
    return table.select(*kept, *[input_column(c, c in categorical).alias(f"{c}{INPUT}") for c in features])


def input_column(name: str, categorical: bool) -> Column:
    if categorical:
        return F.col(f"{name}_index").cast("double")
    return F.coalesce(F.col(name).cast("double"), F.lit(MISSING))


@dataclass
class GlobalModel:
    """Fitted trees with the feature list they were grown on."""

    indexer: StringIndexerModel | None
    trees: Ensemble
    features: list[str]

    def predict(self, inputs: Mapping[str, np.ndarray]) -> np.ndarray:
        """Sales, never negative, from inputs by name."""
        return self.trees.predict(inputs)

    def __getstate__(self):  # tasks need the trees only
        return {"indexer": None, "trees": self.trees, "features": self.features}

    def importances(self) -> DataFrame:
        """Features by their share of all gains, largest first."""
        gains = self.trees.gains()
        whole = sum(gains.values()) or 1.0
        rows = _active().createDataFrame(
            [(name.removesuffix(INPUT), v / whole) for name, v in gains.items()], "feature string, importance double")
        order = Window.partitionBy(F.lit(0)).orderBy(F.col("importance").desc(), "feature")  # one row per feature
        return rows.withColumn("rank", F.row_number().over(order))

    def save(self, path: str) -> None:
        """Trees, category order and feature list below one path."""
        boosting.write_models(_active(), {"model": self.trees}, f"{path}/trees")
        if self.indexer is not None:
            self.indexer.write().overwrite().save(f"{path}/categories")
        _active().createDataFrame([(self.features, self.indexer is not None)], "features array<string>, categories boolean") \
            .coalesce(1).write.mode("overwrite").json(f"{path}/settings")

    @classmethod
    def load(cls, path: str) -> GlobalModel:
        row = _active().read.schema("features array<string>, categories boolean").json(f"{path}/settings").first()
        indexer = StringIndexerModel.load(f"{path}/categories") if row["categories"] else None
        return cls(indexer, boosting.read_models(_active(), f"{path}/trees")["model"], list(row["features"]))


@dataclass
class TwoStageModel:
    """Probability of any sale times the size of a positive sale."""

    occurrence: GlobalModel
    magnitude: GlobalModel

    @property
    def indexer(self) -> StringIndexerModel | None:
        return self.occurrence.indexer

    @property
    def features(self) -> list[str]:
        return self.occurrence.features

    def predict(self, inputs: Mapping[str, np.ndarray]) -> np.ndarray:
        return self.occurrence.predict(inputs) * self.magnitude.predict(inputs)


def _active() -> SparkSession:
    return SparkSession.getActiveSession()


@dataclass(frozen=True)
class Wanted:
    """A model to fit: rows up to the cutoff, settings and features."""

    cutoff: dt.date
    parameters: TreeParameters
    features: tuple[str, ...]
    two_stage: bool = False

    def fits(self, name: str) -> list[Fit]:
        targets = ("any_sale", "log_positive") if self.two_stage else ("log_sales",)
        return [Fit(f"{name}/{t}", self.cutoff, self.parameters, tuple(f"{c}{INPUT}" for c in self.features), t) for t in targets]


def fit_models(frame: DataFrame, wanted: Mapping[str, Wanted]) -> dict[str, GlobalModel | TwoStageModel]:
    """All models in one job; what was fitted before on the same rows with the same settings is read.

    The order of categories is that of the whole frame, whose attributes are known ahead; targets after a cutoff are not read."""
    needed = list(dict.fromkeys([*[c for c in FEATURES if c in frame.columns], *[c for w in wanted.values() for c in w.features]]))
    categorical = [c for c in CATEGORICAL if c in needed]
    indexer = encode_categories(frame, categorical) if categorical else None
    rows = encoded(frame, indexer, needed, *SALES_GRAIN, "sales")
    trees = boosting.fitted(rows, [f for name, w in wanted.items() for f in w.fits(name)])
    out: dict[str, GlobalModel | TwoStageModel] = {}
    for name, w in wanted.items():
        made = [GlobalModel(indexer, trees[f.name], list(w.features)) for f in w.fits(name)]
        out[name] = TwoStageModel(*made) if w.two_stage else made[0]
    return out


def training_rows(frame: DataFrame, cutoff: Date, check: bool = True) -> DataFrame:
    """Rows up to the cutoff with a target; targets must not be negative."""
    rows = frame.filter((F.col("date") <= date_value(cutoff)) & F.col("sales").isNotNull())
    if check:
        row = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sales") < 0).alias("bad")).first()
        if not row["n"]:
            raise ValueError("no training rows are available up to the cutoff")
        if row["bad"]:
            raise ValueError("training sales must not be negative")
    return rows


def _one(frame: DataFrame, cutoff: Date, parameters: TreeParameters | None, features: list[str] | None, check: bool, two_stage: bool):
    selected = model_columns(frame, features)
    if check:
        training_rows(frame, cutoff)
    day = dt.date.fromisoformat(str(cutoff))
    return fit_models(frame, {"model": Wanted(day, parameters or TreeParameters(), tuple(selected), two_stage)})["model"]


def train_global_model(frame: DataFrame, cutoff: Date, parameters: TreeParameters | None = None,
                       features: list[str] | None = None, check: bool = True) -> GlobalModel:
    """Boosted trees on log1p(sales) of all rows up to the cutoff; the fit is distributed."""
    return _one(frame, cutoff, parameters, features, check, False)


def train_two_stage_model(frame: DataFrame, cutoff: Date, parameters: TreeParameters | None = None,
                          features: list[str] | None = None, check: bool = True) -> TwoStageModel:
    return _one(frame, cutoff, parameters, features, check, True)


def predict_sales(model: GlobalModel | TwoStageModel, frame: DataFrame) -> DataFrame:
    """The frame with a ``prediction`` column on the sales scale, never negative."""
    kept = frame.columns
    shared = frame.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*frame.schema.fields, T.StructField("prediction", T.DoubleType())])
    inputs = [f"{c}{INPUT}" for c in model.features]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = shared.value.predict({c: batch[c].to_numpy(zero_copy_only=False) for c in inputs})
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], pa.array(values, pa.float64())], [*kept, "prediction"])

    return encoded(frame, model.indexer, model.features, *kept).mapInArrow(run, schema)


predict_two_stage = predict_sales
