"""Training and retraining jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from wardline.operators import evaluate
from wardline.operators.forest import Forest, fit_forest
from wardline.operators.joins import first_per_key
from wardline.plans.enrich import enrich
from wardline.schemas import FEATURES
from wardline.session import materialize
from wardline.sources.model_store import save_forest
from wardline.sources.readers import feature_matrix


@dataclass
class Trained:
    """A model with the stored feature table it was fitted on, raw scores included."""

    model: Forest
    table: DataFrame

    @property
    def enriched(self) -> DataFrame:
        return self.table.drop("raw")

    def scored(self) -> DataFrame:
        """The training events with score and prediction, read from the stored scores."""
        return self.model.judge(self.table)


def train(logs: DataFrame, profiles: DataFrame, reference_date: str, **params) -> Trained:
    """Enrich, store the feature table, fit. Everything after reads stored tables.

    A repeated profile would repeat its user's events, so one row per user is kept.
    """
    unique = first_per_key(profiles, ["user_id"], [])
    return fit(materialize(enrich(logs, unique, reference_date), "enriched"), **params)


def fit(enriched: DataFrame, **params) -> Trained:
    """Fit on a stored feature table."""
    return Trained(*fit_forest(feature_matrix(enriched), "access_id", FEATURES, **params))


def retrain(
    spark: SparkSession,
    logs: DataFrame,
    profiles: DataFrame,
    labels: DataFrame,
    reference_date: str,
    model_path: str,
    **params,
) -> DataFrame:
    """Train, save a new model version under ``model_path``, return its metrics."""
    trained = train(logs, profiles, reference_date, **params)
    save_forest(trained.model, model_path)
    return evaluate.metrics(evaluate.labelled(trained.scored(), labels))
