"""The query registry and the inputs that queries share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardline.functions.numeric import round_to
from wardline.catalog.prelude import PRELUDE, scaled_rounding
from wardline.operators import rules
from wardline.plans import enrich as plan
from wardline.plans.train import Trained, fit
from wardline.schemas import FEATURES, IDS
from wardline.session import materialize
from wardline.sources import sample_views as views


# What the rules for labels read besides ids and features.
LABEL_INPUTS = ["query_type", "destination", "data_sensitivity", "access_tier"]


class Inputs:
    """Lazy views of one data folder. Only ``stored``, ``decisions`` and ``trained`` run jobs."""

    _stored: dict[tuple[str, str], DataFrame] = {}
    _decided: dict[tuple[str, str], DataFrame] = {}
    _fitted: dict[tuple[str, str], Trained] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        # the tables hold times without a zone; hours and weeks are read as UTC
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return views.load(self.spark, self.sf_dir, name)

    @cached_property
    def logs(self) -> DataFrame:
        return views.logs(self.spark, self.sf_dir)

    @cached_property
    def spread_logs(self) -> DataFrame:
        return views.spread_logs(self.spark, self.sf_dir)

    @cached_property
    def profiles(self) -> DataFrame:
        return views.profiles(self.spark, self.sf_dir)

    @cached_property
    def merged(self) -> DataFrame:
        return plan.merge(self.logs, self.profiles, views.REFERENCE_DATE)

    @cached_property
    def featured(self) -> DataFrame:
        """Events with every feature except the trailing count."""
        return plan.event_features(self.merged)

    @cached_property
    def enriched(self) -> DataFrame:
        return plan.enrich(self.logs, self.profiles, views.REFERENCE_DATE)

    @cached_property
    def typed(self) -> DataFrame:
        """Events with labels by rule."""
        columns = [
            "access_id", "user_id", "timestamp", "username", "department", "query_type", "destination",
            "data_sensitivity", "access_tier", "notice_period_flag", "stale_account_days",
            "Rowcount_Deviation", "Access_Tier_Mismatch", "Cross_Dept_Access_Flag", "Query_Type_Risk",
            "Equipment_Risk_Score", "VPN_Mismatch", "Failed_Action_Flag",
        ]
        return rules.typed_anomalies(plan.with_velocity(self.featured.select(*columns), self.logs))

    @cached_property
    def labels(self) -> DataFrame:
        return self.typed.select("access_id", "is_anomaly", "anomaly_type", "severity", "explanation")

    @cached_property
    def rule_scored(self) -> DataFrame:
        """A deterministic stand-in for the model: a score and prediction from three features."""
        raw = (
            F.lit(0.3)
            - F.col("Time_Sensitivity_Risk") * 0.05
            - F.col("Exfiltration_Dest_Score") * 0.06
            - F.least(F.col("Rowcount_Deviation"), F.lit(100.0)) * 0.002
        )
        ids = self.featured.select(
            "access_id", "user_id", "timestamp", round_to(raw, 6).alias("anomaly_score")
        )
        return ids.withColumn("prediction", F.when(F.col("anomaly_score") < 0, -1).otherwise(1))

    @cached_property
    def rule_explained(self) -> DataFrame:
        """Stand-in attributions over five features, in the shape the model gives."""
        share = {
            "Rowcount_Deviation": -F.least(F.col("Rowcount_Deviation"), F.lit(50.0)) / 50,
            "Exfiltration_Dest_Score": -F.col("Exfiltration_Dest_Score") / 6,
            "Time_Sensitivity_Risk": -F.col("Time_Sensitivity_Risk") / 24,
            "Query_Type_Risk": -F.col("Query_Type_Risk") / 8,
            "tenure_months": F.coalesce(F.col("tenure_months"), F.lit(0)) / 120,
        }

        def entry(name: str, value: Column) -> Column:
            observed = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
            return F.struct(
                F.lit(name).alias("feature"),
                round_to(value.cast("double"), 6).alias("shap_value"),
                round_to(observed, 4).alias("event_value"),
            )

        entries = F.array(*[entry(f, v) for f, v in share.items()])
        return self.featured.withColumn("attribution", entries)

    @property
    def decisions(self) -> DataFrame:
        """The decision log: a stored table, derived once from the labelled anomalies."""
        if self._key not in Inputs._decided:
            Inputs._decided[self._key] = materialize(self._derived_decisions(), "decisions")
        return Inputs._decided[self._key]

    def _derived_decisions(self) -> DataFrame:
        kinds = ["Monitor", "False Positive", "Quarantine", "False Positive", "Monitor"]
        return self.typed.where("is_anomaly").select(
            "access_id", "user_id", "department", "anomaly_type",
            (F.col("timestamp") + F.expr("INTERVAL 2 HOURS")).alias("decided_at"),
            views.pick(kinds, F.col("access_id") % 5).alias("decision"),
        )

    @property
    def _key(self) -> tuple[str, str]:
        return self.spark.sparkContext.applicationId, self.sf_dir

    @property
    def stored(self) -> DataFrame:
        """The feature table, written once per application and folder; for jobs that read it often."""
        return self._enriched_once.select(*IDS, *FEATURES)

    @property
    def stored_labels(self) -> DataFrame:
        """The rows of ``labels``, from the stored feature table: features and trailing counts are not made again."""
        return rules.typed_anomalies(self._enriched_once).select(
            "access_id", "is_anomaly", "anomaly_type", "severity", "explanation"
        )

    @property
    def _enriched_once(self) -> DataFrame:
        if self._key not in Inputs._stored:
            table = plan.enrich(self.spread_logs, self.profiles, views.REFERENCE_DATE, LABEL_INPUTS, self.logs)
            Inputs._stored[self._key] = materialize(table, "enriched")
        return Inputs._stored[self._key]

    @property
    def trained(self) -> Trained:
        """The fitted model of this folder; fitted once per application and folder."""
        if self._key not in Inputs._fitted:
            Inputs._fitted[self._key] = fit(self.stored)
        return Inputs._fitted[self._key]


@dataclass(frozen=True)
class Query:
    run: Callable[[Inputs], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, prelude: bool = True):
    """Register a query; ``sql`` is its oracle's final SELECT."""

    def add(fn: Callable[[Inputs], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        whole = PRELUDE + sql if sql and prelude else sql
        REGISTRY[name] = Query(fn, scaled_rounding(whole) if whole else None)
        return fn

    return add


def day_text(c: str = "day") -> Column:
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def time_text(c: str, alias: str | None = None) -> Column:
    return F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias(alias or c)


FEATURE_LIST = ", ".join(FEATURES)
