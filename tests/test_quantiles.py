import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from wardline.operators import quantiles
from wardline.operators.quantiles import exact_quantiles, exact_quantiles_by

PROBS = [0.0, 0.25, 0.43, 0.5, 0.75, 1.0]


def check(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    known = [v for v in values if v is not None]
    got = {r["q"]: r["value"] for r in exact_quantiles(df, ["x"], PROBS).collect()}
    for p in PROBS:
        assert got[p] == pytest.approx(np.percentile(known, p * 100), rel=1e-12, abs=1e-12)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-1e6, 1e6) | st.sampled_from([0.0, 1.0]), min_size=1, max_size=60))
def test_small_lists(spark, values):
    check(spark, values)


def test_nulls_and_ties(spark):
    check(spark, [None, 2.0, 2.0, None, 2.0, 7.0])


@pytest.mark.parametrize("limit", [20_000_000, 100])
def test_bracket_is_refined(spark, monkeypatch, limit):
    """A coarse sketch leaves many values inside the brackets; the result stays exact."""
    monkeypatch.setattr(quantiles, "ACCURACY", 40)
    monkeypatch.setattr(quantiles, "INSIDE_ROWS", limit)
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.lognormal(3, 2, 4000), np.zeros(2000)])
    check(spark, [float(v) for v in values])


def test_coarse_sketch_per_group(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "GROUP_ACCURACY", 40)
    rng = np.random.default_rng(4)
    rows = [(str(i % 2), float(v)) for i, v in enumerate(rng.normal(size=4000))]
    df = spark.createDataFrame(rows, "k string, x double")
    for r in exact_quantiles_by(df, ["k"], ["x"], [0.43]).collect():
        want = np.percentile([x for k, x in rows if k == r["k"]], 43)
        assert r["value"] == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("salt", [None, 50])
def test_grouped(spark, salt):
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 3 == 0 else f"k{i % 7}", float(v), float(-v)) for i, v in enumerate(rng.normal(size=900))]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = exact_quantiles_by(df, ["k"], ["x", "y"], [0.25, 0.75], salt).collect()
    assert len(got) == 8 * 2 * 2
    for r in got:
        column = [row[1 if r["feature"] == "x" else 2] for row in rows if row[0] == r["k"]]
        assert r["value"] == pytest.approx(np.percentile(column, r["q"] * 100), rel=1e-12)


def test_agrees_with_percentile(spark):
    df = spark.range(10_001).select((F.col("id") * F.col("id") % 7919 / 3.0).alias("x"))
    want = df.agg(F.percentile("x", 0.43)).head()[0]
    assert quantiles.exact_quantile(df, "x", 0.43) == pytest.approx(want, rel=1e-12)


def test_column_without_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0)], "x double, y double")
    got = {r["feature"]: r["value"] for r in exact_quantiles(df, ["x", "y"], [0.5]).collect()}
    assert got == {"x": None, "y": 2.0}
