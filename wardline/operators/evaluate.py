"""Evaluation of predictions against labels, always joined on access_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardline.functions.numeric import round_to

# Targets and the detection rate that counts as good.
TARGETS = {"precision": 0.75, "recall": 0.70, "f1_score": 0.72}
GOOD_RATE = 0.70


def labelled(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """(access_id, predicted, actual, anomaly_type, severity) for events that have both."""
    pred = predictions.select("access_id", (F.col("prediction") == -1).alias("predicted"))
    lab = labels.select(
        "access_id", F.col("is_anomaly").alias("actual"), "anomaly_type", "severity"
    )
    return pred.join(lab, "access_id")


def ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def _confusion(df: DataFrame) -> DataFrame:
    p, a = F.col("predicted"), F.col("actual")
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(p & a).alias("tp"),
        F.count_if(p & ~a).alias("fp"),
        F.count_if(~p & a).alias("fn"),
        F.count_if(~p & ~a).alias("tn"),
    )


def metrics(df: DataFrame) -> DataFrame:
    """Totals, precision, recall and F1 of the anomaly class."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    counted = _confusion(df).withColumns(
        {"_p": ratio(tp, tp + fp), "_r": ratio(tp, tp + fn)}
    )
    return counted.select(
        F.col("total").alias("total_events"),
        (tp + fp).alias("total_predicted_anomalies"),
        (tp + fn).alias("total_ground_truth_anomalies"),
        round_to("_p", 4).alias("precision"),
        round_to("_r", 4).alias("recall"),
        round_to(f1(F.col("_p"), F.col("_r")), 4).alias("f1_score"),
    )


def target_checks(measured: DataFrame) -> DataFrame:
    """One row per target: measured value and whether it is exceeded."""
    rows = [
        F.struct(
            F.lit(name).alias("metric"),
            F.col(name).alias("value"),
            F.lit(target).alias("target"),
            (F.col(name) > target).alias("reached"),
        )
        for name, target in TARGETS.items()
    ]
    return measured.select(F.inline(F.array(*rows)))


def classification_report(df: DataFrame) -> DataFrame:
    """Per class precision, recall, F1 and support, then accuracy, macro and weighted averages."""
    tp, fp, fn, tn, total = (F.col(c) for c in ["tp", "fp", "fn", "tn", "total"])
    c = _confusion(df).withColumns(
        {
            "p1": ratio(tp, tp + fp),
            "r1": ratio(tp, tp + fn),
            "p0": ratio(tn, tn + fn),
            "r0": ratio(tn, tn + fp),
            "s1": tp + fn,
            "s0": tn + fp,
        }
    )
    c = c.withColumns({"f1": f1(F.col("p1"), F.col("r1")), "f0": f1(F.col("p0"), F.col("r0"))})
    acc = ratio(tp + tn, total)

    def row(name: str, p: Column, r: Column, f: Column, s: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            round_to(p, 4).alias("precision"),
            round_to(r, 4).alias("recall"),
            round_to(f, 4).alias("f1_score"),
            s.alias("support"),
        )

    macro = lambda m: (F.col(f"{m}0") + F.col(f"{m}1")) / 2
    weighted = lambda m: ratio(
        F.col(f"{m}0") * F.col("s0") + F.col(f"{m}1") * F.col("s1"), total
    )
    return c.select(
        F.inline(
            F.array(
                row("Normal", F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
                row("Anomaly", F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
                row("accuracy", acc, acc, acc, total),
                row("macro avg", macro("p"), macro("r"), macro("f"), total),
                row("weighted avg", weighted("p"), weighted("r"), weighted("f"), total),
            )
        )
    )


def detection_by_type(df: DataFrame) -> DataFrame:
    """Share of each anomaly type that was predicted."""
    return (
        df.where(F.col("actual") & (F.col("anomaly_type") != "NORMAL"))
        .groupBy("anomaly_type")
        .agg(
            F.count_if("predicted").alias("detected"),
            F.count("*").alias("total"),
            F.avg(F.col("predicted").cast("double")).alias("_rate"),
        )
        .select(
            "anomaly_type", "detected", "total",
            round_to("_rate", 4).alias("rate"),
            (F.col("_rate") >= GOOD_RATE).alias("good"),
        )
    )


def anomaly_counts(df: DataFrame) -> DataFrame:
    """Actual and predicted anomalies with their shares."""
    n = F.count("*")
    true_n, pred_n = F.count_if("actual"), F.count_if("predicted")
    return df.agg(
        true_n.alias("true_anomalies"),
        round_to(ratio(true_n, n), 4).alias("true_share"),
        pred_n.alias("predicted_anomalies"),
        round_to(ratio(pred_n, n), 4).alias("predicted_share"),
    )


def detection_by_severity(df: DataFrame) -> DataFrame:
    return df.groupBy("severity").agg(
        F.count("*").alias("total"), F.count_if("predicted").alias("predicted")
    )
