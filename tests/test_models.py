import pytest
from pyspark.sql import functions as F

from riskweave.config import RiskConfig
from riskweave.operators import features
from riskweave.operators.classifier import score_probability, train_classifier
from riskweave.operators.isolation_forest import expected_depth, fit_forest, percentile_of, sample_trees
from riskweave.sources.models import load_model, save_model
from riskweave.sources.testdata import labelled_transactions, transactions
from tests.conftest import SF

CFG = RiskConfig(forest_trees=40, boost_rounds=5)


def test_features_have_a_fixed_shape(spark):
    df = spark.createDataFrame([("a", float("nan"), 3)], "transaction_id string, amount double, user_risk_score int")
    row = features.feature_matrix(df, features.SUPERVISED_FEATURES).first()
    assert tuple(row) == ("a", 0.0, 0.0, 3.0, 0.0, 0.0, 0.0, 0.0)


def test_standardize(spark):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0)], "x double, y double")
    assert sorted(map(tuple, features.standardize(df, ("x", "y")).collect())) == [(-1.0, 0.0), (1.0, 0.0)]


def test_percentile_interpolates(spark):
    df = spark.createDataFrame([(-v / 100.0,) for v in range(1, 101)], "s double")
    value, lowest = percentile_of(df, "s", 0.01)
    assert lowest == -1.0 and value == pytest.approx(-1.0 + 0.99 * 0.01)


def test_sample_has_a_fixed_size(spark):
    df = spark.range(200_000).select(F.col("id").cast("string").alias("transaction_id"), F.col("id").cast("double").alias("amount"))
    counts = [r[1] for r in sample_trees(df, ("amount",), 20, 200_000, 1).groupBy("tree").count().collect()]
    assert len(counts) == 20 and min(counts) == max(counts) == CFG.forest_sample


def test_outliers_lead_and_layout_does_not_matter(spark):
    base = transactions(spark, SF)
    odd = base.limit(3).withColumns(
        {"transaction_id": F.concat(F.lit("odd"), "transaction_id"), "amount": F.lit(9e7), "historical_avg_txn": F.lit(5e6)}
    )
    df = base.unionByName(odd)
    forest = fit_forest(df, CFG)
    scored = forest.score(df)
    top = scored.orderBy(F.desc("ml_anomaly_score"), "transaction_id").limit(15).collect()
    assert sum(r.transaction_id.startswith("odd") for r in top) == 3
    assert scored.agg(F.max("ml_anomaly_score")).first()[0] == round(forest.top_score, 2)
    share = scored.where("ml_anomaly_score >= 50").count() / df.count()
    assert share == pytest.approx(0.01, abs=0.005)
    again = fit_forest(df.repartition(7), CFG).score(df)
    assert scored.select("transaction_id", "ml_anomaly_score").exceptAll(again.select("transaction_id", "ml_anomaly_score")).count() == 0


def test_expected_depth():
    assert (expected_depth(1), expected_depth(2)) == (0.0, 1.0) and 10.2 < expected_depth(256) < 10.3


def test_classifier_learns_and_is_stored(spark, tmp_path):
    history = labelled_transactions(spark, SF)
    training = train_classifier(history, CFG)
    assert training.accuracy > 0.9
    path = str(tmp_path / "model")
    assert load_model(spark, path) is None
    save_model(training.model, path)
    live = transactions(spark, SF)
    fresh = score_probability(live, training.model)
    stored = score_probability(live, load_model(spark, path))
    assert fresh.columns == [*live.columns, "ml_supervised_score"]
    assert fresh.exceptAll(stored).count() == 0
    assert fresh.where("ml_supervised_score < 0 OR ml_supervised_score > 100").count() == 0
    assert score_probability(live, None).where("ml_supervised_score = 0").count() == live.count()
    with pytest.raises(ValueError):
        train_classifier(live, CFG)


def test_hashed_forest_repeats_itself_and_finds_the_outlier(spark):
    from riskweave.operators.hashed_forest import fit_hashed_forest

    rows = [(f"t{k:04d}", 100.0 + k % 7, 400 + k % 5, 50, 120.0, 30.0, 10) for k in range(600)]
    rows.append(("t9999", 9_000_000.0, 1, 99, 5.0, 1.0, 0))
    df = spark.createDataFrame(
        rows, "transaction_id string, amount double, account_age_days int, user_risk_score int, historical_avg_txn double, "
        "historical_std_dev double, known_counterparties int"
    )
    one = fit_hashed_forest(df, CFG)
    two = fit_hashed_forest(df.repartition(5), CFG)
    assert one.nodes.sort_values(["tree", "node"]).reset_index(drop=True).equals(two.nodes.sort_values(["tree", "node"]).reset_index(drop=True))
    scores = {r.transaction_id: r.ml_anomaly_score for r in one.score(df).collect()}
    assert scores["t9999"] == max(scores.values()) and 0 <= min(scores.values())


def test_hashed_forest_cuts_are_drawn_from_md5():
    import pandas as pd

    from riskweave.operators.hashed_forest import _grower, draw

    pdf = pd.DataFrame({"tree": [3] * 4, "a": [1.0, 2.0, 3.0, 4.0], "b": [5.0, 5.0, 5.0, 5.0]})
    nodes = _grower(("a", "b"), 42, 8)(pdf).set_index("node")
    assert nodes.loc[1, "feature"] == 0  # b has one value: only a can split
    assert nodes.loc[1, "threshold"] == [1.0, 2.0, 3.0][draw("42:3:1:c") % 3]


def test_split_by_class_holds_out_exact_shares(spark):
    from riskweave.operators.classifier import split_by_class

    rows = [(f"t{k:05d}", 1 if k % 97 == 0 else (None if k % 331 == 0 else 0)) for k in range(5000)]
    df = spark.createDataFrame(rows, "transaction_id string, is_sar_filed int")
    fitted, held = split_by_class(df, CFG, "is_sar_filed")
    for label in (0, 1, None):
        n = sum(1 for _, y in rows if y == label)
        kept = held.where(F.col("is_sar_filed").eqNullSafe(F.lit(label))).count()
        assert kept == int(0.2 * n + 0.5)
    assert fitted.count() + held.count() == 5000 and fitted.join(held, "transaction_id").count() == 0
    again = split_by_class(df.repartition(7), CFG, "is_sar_filed")[1]
    assert sorted(r[0] for r in again.select("transaction_id").collect()) == sorted(r[0] for r in held.select("transaction_id").collect())


@pytest.mark.parametrize("n", [6000, 15_000])  # all rows, and a sample of them, find the borders of the bins
def test_grouped_rows_grow_the_trees_of_all_rows(spark, monkeypatch, n):
    import random

    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from riskweave.operators import classifier

    r = random.Random(7)
    rows = []
    for k in range(n):
        amount, age, risk = r.randrange(400) / 4, r.randrange(3), r.randrange(50) - 25
        sar = int(r.random() < (0.8 if amount > 70 and risk > 0 else 0.3 if age == 1 else 0.02))
        rows += [(f"t{k:05d}", float(amount), age, risk, 5.0, sar)]
    df = spark.createDataFrame(rows, "transaction_id string, amount double, account_age_days int, user_risk_score int, historical_avg_txn double, is_sar_filed int")
    sizes = []
    fit = classifier.Pipeline.fit
    monkeypatch.setattr(classifier.Pipeline, "fit", lambda self, rows: sizes.append(rows.count()) or fit(self, rows))
    training = train_classifier(df, CFG)
    monkeypatch.undo()
    assert sizes[-1] < 0.8 * n * 0.8  # of the rows to learn from
    names = [classifier.PREFIX + n for n in classifier.SUPERVISED_FEATURES]
    fitted, _ = classifier.split_by_class(classifier._inputs(df).withColumn("label", F.col("is_sar_filed").cast("double")), CFG, "label")
    plain = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=CFG.boost_rounds, maxDepth=CFG.boost_depth, stepSize=CFG.boost_rate, seed=CFG.seed)
    plain = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_features"), plain]).fit(fitted)
    wanted = plain.transform(classifier._inputs(df)).select("transaction_id", vector_to_array("probability")[1].alias("p"))
    got = training.model.transform(classifier._inputs(df)).select("transaction_id", vector_to_array("probability")[1].alias("q"))
    assert wanted.join(got, "transaction_id").where("abs(p - q) < 1e-9").count() == n


@pytest.mark.parametrize("values", [[], [(1.0, 5)], [(1.0, 5), (2.0, 1)], [(float("-inf"), 1), (0.0, 1), (float("inf"), 2)]])
def test_borders_of_few_values(values):
    from riskweave.operators.classifier import borders

    inner = borders(values, 32)
    assert len(inner) <= max(len(values) - 1, 0) and all(a < b for a, b in zip(inner, inner[1:]))
    assert len(borders([(float(k), 1 + k % 3) for k in range(1000)], 32)) == 31
