"""The alert job: score, rank, explain only what is shown, assemble."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardline.operators.attribution import BACKGROUND, background_rows, explain
from wardline.operators.triage import assemble_alerts, most_anomalous
from wardline.plans.train import Trained
from wardline.session import materialize


def explained_anomalies(trained: Trained, limit: int, background: int = BACKGROUND) -> DataFrame:
    """The ``limit`` most anomalous events with their attributions."""
    top = most_anomalous(trained.scored(), limit)
    reference = background_rows(trained.enriched, trained.model, "access_id", background)
    return explain(top, trained.model, reference)


def flagged_events(trained: Trained, logs: DataFrame, labels: DataFrame, limit: int = 50) -> DataFrame:
    """Alerts with context and ground truth.

    The explained rows are stored first: a table of ``limit`` rows. Logs and labels are then cut
    to those ids by a semi-join that scans them in place, before the outer joins of the assembly.
    """
    explained = materialize(explained_anomalies(trained, limit), "explained")
    ids = F.broadcast(explained.select("access_id"))
    cut = lambda df: df.join(ids, "access_id", "left_semi")
    return assemble_alerts(explained, cut(logs), cut(labels))
