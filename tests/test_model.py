"""Forest and attribution: properties, not reference numbers."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.operators import attribution as at, forest as fo
from wardline.sources.model_store import load_forest, save_forest

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, rng.normal(size=3)), 1.0) for i in range(3000)]
    rows += [(3000 + i, *map(float, rng.normal(7, 0.5, size=3)), 1.0) for i in range(30)]
    return spark.createDataFrame(rows, "access_id long, a double, b double, c double, d double").persist()


@pytest.fixture(scope="module")
def model(table):
    return fo.fit_forest(table, "access_id", FEATURES, trees=40, contamination=0.05)[0]


def test_average_path():
    assert fo.average_path(1) == 0 and fo.average_path(2) == 1
    harmonic = sum(1 / i for i in range(1, 256))
    assert fo.average_path(256) == pytest.approx(2 * harmonic - 2 * 255 / 256, abs=5e-3)


def test_scaler_uses_population_deviation(table):
    got = {r["feature"]: r for r in fo.fit_scaler(table, FEATURES).collect()}
    column = np.array([r["a"] for r in table.collect()])
    assert got["a"]["std"] == pytest.approx(column.std()) and got["d"]["std"] == 0
    z = fo.standardise(table, list(got.values()), FEATURES).agg(F.avg("a"), F.stddev_pop("a"), F.max("d")).head()
    assert z[0] == pytest.approx(0, abs=1e-9) and z[1] == pytest.approx(1) and z[2] == 0


def test_samples_do_not_depend_on_partitioning(table):
    def drawn(df):
        out = fo.tree_samples(df.select("access_id"), "access_id", 10, 256, 42)
        return sorted((r["tree"], r["access_id"]) for r in out.collect())

    one, seven = drawn(table.coalesce(1)), drawn(table.repartition(7))
    assert one == seven and len(one) == 10 * 256


def test_samples_are_the_lowest_of_all_rows(spark):
    """At every size, under any partitioning, and with ids of any type."""
    for n, parts in ((20_000, 9), (300_000, 5), (40, 3)):
        out = fo.tree_samples(spark.range(n).toDF("access_id").repartition(parts), "access_id", 20, 64, 1)
        got = {}
        for r in out.collect():
            got.setdefault(r["tree"], set()).add(r["access_id"])
        for t in range(20):
            shift = np.array([t + 1 + (1 << 20)], np.uint64) * fo.GOLDEN
            picks = fo.tree_picks(np.arange(n, dtype=np.uint64), shift[0])
            assert got[t] == set(np.argsort(picks, kind="stable")[:64].tolist())
    names = spark.range(500).selectExpr("concat('e', id) AS access_id", "id AS pick_me")
    out = fo.tree_samples(names, "access_id", 3, 64, 1)
    assert {r["n"] for r in out.groupBy("tree").agg(F.countDistinct("access_id").alias("n")).collect()} == {64}
    assert fo.tree_samples(names.limit(0), "access_id", 3, 64, 1).collect() == []


def test_forest_does_not_depend_on_partitioning(table, model):
    again, _ = fo.fit_forest(table.repartition(5), "access_id", FEATURES, trees=40, contamination=0.05)
    assert again.nodes.sort_values(["tree", "node"]).drop(columns=["threshold", "path"]).values.tolist() == \
        model.nodes.sort_values(["tree", "node"]).drop(columns=["threshold", "path"]).values.tolist()
    assert again.offset == pytest.approx(model.offset, rel=1e-9)


def test_trees_are_well_formed(model):
    for _, tree in model.nodes.groupby("tree"):
        tree = tree.sort_values("node").reset_index(drop=True)
        inner = tree[tree["feature"] >= 0]
        kids = set(inner["left"]) | set(inner["left"] + 1)
        assert kids | {0} == set(tree["node"])
        assert (tree["rows"][inner["left"]].values + tree["rows"][inner["left"] + 1].values == inner["rows"]).all()
        assert tree["depth"].max() <= 8
        assert (tree["feature"] != 3).all()  # a constant feature is never split


def test_planted_outliers_score_lowest(table, model):
    scored = model.score(table).persist()
    assert scored.agg(F.min("anomaly_score") > -1, F.max("anomaly_score") < 1).head() == (True, True)
    lowest = {r["access_id"] for r in scored.orderBy("anomaly_score").limit(30).collect()}
    assert len([i for i in lowest if i >= 3000]) >= 28
    share = scored.agg(F.avg((F.col("prediction") == -1).cast("double"))).head()[0]
    assert share == pytest.approx(0.05, abs=0.001)


def test_store_round_trip(spark, table, model, tmp_path):
    save_forest(model, str(tmp_path / "v1"))
    again = load_forest(spark, str(tmp_path / "v1"))
    row = fo.agreement(model.score(table), again.score(table)).head()
    assert fo.version_agreement(table, model, again).head() == row
    assert row["match_rate"] == 1.0 and row["compared"] == 3030
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        save_forest(model, str(tmp_path / "v1"))


def test_tiny_and_empty_tables(spark):
    tiny = spark.createDataFrame([(1, 1.0, 2.0)], "access_id long, a double, b double")
    model, raw = fo.fit_forest(tiny, "access_id", ["a", "b"], trees=3)
    assert model.judge(raw).head()["prediction"] == 1
    assert model.score(tiny).head()["prediction"] == 1
    with pytest.raises(ValueError, match="empty"):
        fo.fit_forest(tiny.where("a > 5"), "access_id", ["a", "b"], trees=3)


def brute_force(x, rows, mean_path):
    """Shapley values by subsets: features outside the subset come from the background."""
    m = len(x)
    out = np.zeros(m)

    def value(subset):
        mixed = np.array(rows)
        mixed[:, list(subset)] = x[list(subset)]
        return mean_path(mixed).mean()

    for j in range(m):
        others = [i for i in range(m) if i != j]
        for size in range(m):
            weight = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
            for s in itertools.combinations(others, size):
                out[j] += weight * (value([*s, j]) - value(s))
    return out


def test_attribution_equals_brute_force(table, model):
    arrays = model.arrays()
    rows = at.background_rows(table, model, "access_id", 8)
    z = (rows - arrays["mean"]) / arrays["std"]
    leaves = at.leaf_table(arrays)
    masks = at.background_masks(at.met_bits(z, leaves))
    xs = np.array([[2.0, -1.0, 0.3, 0.0], [6.0, 6.5, 7.0, 0.0], [0.0, 0.0, 0.0, 0.0]])
    got = at.attribute_rows(xs, masks, leaves)
    walk = lambda points: fo.mean_path(points, arrays)
    for x, phi in zip(xs, got):
        assert phi == pytest.approx(brute_force(x, z, walk), abs=1e-9)
        assert phi.sum() == pytest.approx(walk(x[None, :])[0] - walk(z).mean(), abs=1e-9)


def test_blocks_of_leaves_give_the_sum_of_all_leaves(table, model, monkeypatch):
    """A row looks up one value per block, not one per leaf; also on cuts, and with blocks of any size."""
    arrays = model.arrays()
    rng = np.random.default_rng(5)
    xs = rng.normal(0, 2, (300, 4))
    cuts = arrays["threshold"][~arrays["is_leaf"]]
    xs[:100, :3] = rng.choice(cuts, (100, 3))
    back = rng.normal(0, 2, (20, 4))
    for codes, most in ((1, 1.0), (64, 0.7), (2_048, 0.3)):
        monkeypatch.setattr(at, "BLOCK_CODES", codes)
        leaves = at.leaf_table(arrays)
        assert sum(len(t["leaves"]) - 1 for t in leaves["trees"]) <= most * len(leaves["value"])
        masks = at.background_masks(at.met_bits(back, leaves))
        values = at.LeafValues(masks, leaves)
        want = np.zeros(xs.shape)
        for leaf, bits in enumerate(at.met_bits(xs, leaves).T.astype(np.int64)):
            some, which = np.unique(leaf << leaves["width"] | bits, return_inverse=True)
            np.add.at(want.T, leaves["feature"][leaf], values.of_leaves(some)[which].T)
        assert values.sums(xs[:7]) == pytest.approx(want[:7], abs=1e-12)
        assert values.sums(xs) == pytest.approx(want, abs=1e-12)
        assert all(len(v) <= 1 + len(p) for v, p in zip(values.values, values.place))


def test_explain_adds_up_in_spark(table, model):
    rows = at.background_rows(table, model, "access_id", 20)
    out = at.explain(table.where("access_id >= 3025"), model, rows).collect()
    arrays = model.arrays()
    base = fo.mean_path((rows - arrays["mean"]) / arrays["std"], arrays).mean()
    for r in out:
        x = np.array([[r[f] for f in FEATURES]])
        own = fo.mean_path((x - arrays["mean"]) / arrays["std"], arrays)[0]
        assert sum(e["shap_value"] for e in r["attribution"]) == pytest.approx(own - base, abs=1e-5)
        assert own < base


def test_top_features_break_ties_by_position(spark):
    df = spark.sql(
        "SELECT array(named_struct('feature','p','shap_value',0.1D), named_struct('feature','q','shap_value',-0.5D),"
        " named_struct('feature','r','shap_value',0.5D), named_struct('feature','s','shap_value',0.1D)) AS a"
    )
    top = df.select(at.top_features(F.col("a")).alias("t")).head()["t"]
    assert [e["feature"] for e in top] == ["q", "r", "p"]


def test_planted_patterns_score_below_ordinary_events(spark):
    """Events with the signature of the typed rules stand out from a user's ordinary ones."""
    import datetime as dt

    from test_features import REF, frames
    from wardline.plans.train import train

    rng = np.random.default_rng(8)
    day = dt.datetime(2026, 3, 2)
    logs = []
    for i in range(1500):
        at_ = day + dt.timedelta(days=int(rng.integers(0, 28)), hours=int(rng.integers(9, 17)), minutes=int(rng.integers(60)))
        logs.append(dict(access_id=f"n{i}", user_id=f"u{i % 40}", timestamp=at_, rowcount=int(rng.integers(5, 15)),
                         query_type=str(rng.choice(["SELECT", "INSERT", "UPDATE"])), data_asset="Dev_DB"))
    bulk = dict(query_type="EXPORT", destination="usb_drive", data_sensitivity="restricted", data_asset="Payroll_System",
                rowcount=4000, time_classification="night", source_ip="203.0.113.9", authentication_method="API_Key",
                geo_location="Lagos")
    for i in range(30):
        logs.append({**bulk, "access_id": f"p{i}", "user_id": f"u{i}", "timestamp": day + dt.timedelta(days=i % 28, hours=2)})
    profiles = [dict(user_id=f"u{i}", tenure_months=6 + i) for i in range(40)]
    lf, pf = frames(spark, logs, profiles)
    scored = train(lf, pf, REF, trees=60, contamination=0.05).scored()
    scored = scored.withColumn("planted", F.col("access_id").startswith("p"))
    medians = {r["planted"]: r["m"] for r in scored.groupBy("planted").agg(F.median("anomaly_score").alias("m")).collect()}
    worst = scored.where("planted").agg(F.max("anomaly_score")).head()[0]
    assert worst < medians[False]
    hits = scored.where("planted AND prediction = -1").count()
    assert hits >= 28


def test_evaluated_events(spark, small):
    """Requests are evaluated, not looked up: absent features are 0, hits are explained, the time is told."""
    from pyspark.sql import functions as F
    from wardline.catalog.registry import Inputs
    from wardline.schemas import FEATURES
    from wardline.streaming import jobs

    q = Inputs(spark, small)
    full = {r.access_id: r for r in jobs.evaluated(q.enriched, q.trained).collect()}
    stored = {r.access_id: r for r in q.trained.scored().collect()}
    assert {k: r.prediction for k, r in full.items()} == {k: r.prediction for k, r in stored.items()}
    assert all(len(r.top_features) == (3 if r.is_anomaly else 0) and r.analyzed_at for r in full.values())
    assert {r.is_anomaly for r in full.values()} == {True, False}
    absent, null = FEATURES[0], FEATURES[-1]
    part = q.enriched.drop(absent).withColumn(null, F.lit(None).cast("double"))
    zero = q.enriched.withColumns({absent: F.lit(0.0), null: F.lit(0.0)})
    got, want = ({r.access_id: (r.anomaly_score, r.top_features) for r in jobs.evaluated(x, q.trained).collect()} for x in (part, zero))
    assert got == want and got != {k: (r.anomaly_score, r.top_features) for k, r in full.items()}
    answer = entry_row(spark, small, "t6_response")
    assert answer.analyzed_at and answer.is_anomaly is not None


def entry_row(spark, folder, name):
    import __spark_entry__ as entry

    return entry.queries()[name](spark, folder).first()
