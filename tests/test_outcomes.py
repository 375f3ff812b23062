"""Outcome operators and sinks on small hand-made tables."""

import json
import pathlib

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from larkspan.operators import outcomes
from larkspan.sources import sinks

PERIODS = "unit long, city string, period string, ord int, n_A long, n_B long, mean_A double, mean_B double, mean_score double"


@pytest.fixture(scope="module")
def periods(spark):
    rows = [(1, "x", "a", 1, 5, 5, 1.0, 2.0, 1.5), (1, "x", "b", 2, 5, 40, 2.0, 3.0, 2.5), (1, "x", "d", 4, 5, 5, 4.0, None, 4.0), (2, "x", "a", 1, 5, 5, 1.0, 1.0, 1.0), (2, "x", "b", 2, 5, 5, 3.0, 1.0, 1.1)]
    return spark.createDataFrame(rows, PERIODS)


def test_outcomes_skip_missing_periods(periods):
    got = {(r["unit"], r["ord"]): (r["before_A"], r["now_A"], r["next_A"]) for r in outcomes.outcomes_around(periods).collect()}
    assert got[1, 2] == (1.0, 2.0, None) and got[1, 4] == (None, 4.0, None) and got[2, 1] == (None, 1.0, 3.0)


def test_peer_scores(spark, periods):
    edges = spark.createDataFrame([(1, 2), (2, 1), (1, 9)], "unit long, peer long")
    got = {(r["unit"], r["period"]): tuple(r)[2:] for r in outcomes.peer_scores(periods, edges).collect()}
    assert got[1, "a"] == (1.0, 0, None) and got[2, "b"] == (2.5, 1, 1.0) and got[1, "d"] == (None, 0, None)
    assert got[1, "b"][2] == 0.0  # a rise of 0.1


def test_unit_levels(periods):
    got = [tuple(r) for r in outcomes.unit_levels(periods).collect()]
    assert got == [(1, 45, (5 * 2.0 + 40 * 3.0) / 45)]


def test_rolling_folds(periods):
    got = {(r["fold"], r["period"]): r["part"] for r in outcomes.rolling_folds(periods).collect()}
    assert got == {(1, "a"): "train", (1, "b"): "val", (1, "d"): "test"}
    assert outcomes.rolling_folds(periods.where("ord < 3")).count() == 0


def test_cluster_slope(spark):
    rows = [(i % 7, float(i % 5), 2.0 * (i % 5) + (i % 3)) for i in range(60)] + [(1, None, 3.0)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    import numpy as np

    a = np.array(rows[:60])
    x = np.stack([np.ones(60), a[:, 1]], 1)
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ a[:, 2]
    e = a[:, 2] - x @ beta
    scores = np.stack([(x[a[:, 0] == g] * e[a[:, 0] == g, None]).sum(0) for g in range(7)])
    se = np.sqrt(np.diag(inv @ (scores.T @ scores) @ inv))
    got = outcomes.cluster_slope(df, "y", "x", "g").first()
    assert (got["n"], got["clusters"]) == (60, 7) and got["beta"] == pytest.approx(beta[1]) and got["se"] == pytest.approx(se[1])
    flat = outcomes.cluster_slope(df.withColumn("x", F.lit(1.0)), "y", "x", "g").first()
    assert flat["beta"] is None and flat["se"] is None
    fit = outcomes.cluster_slope(df, "y", "x", "g")
    both = outcomes.combine_folds(fit, fit).first()
    assert both["n"] == 120 and both["beta"] == pytest.approx(beta[1]) and both["se"] == pytest.approx(se[1] / 2**0.5)


def test_scaled_and_sample(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, 2.0), (2, 5.0), (2, None)], "g int, v double")
    got = sorted((r["g"], -1.0 if r["scaled"] is None else r["scaled"]) for r in outcomes.scaled(df, "v", ["g"]).collect())
    assert got == [(1, 0.0), (1, 0.5), (1, 1.0), (2, -1.0), (2, 0.0)]
    ids = spark.range(100)
    assert outcomes.keyed_sample(ids, ["id"], 10).collect() == outcomes.keyed_sample(ids.repartition(5), ["id"], 10).collect()
    assert [tuple(r) for r in outcomes.repeated(df, ["g"]).orderBy("g").collect()] == [(1, 3), (2, 2)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "=1+1", float("nan")), (2, "plain", 2.5)], "id int, label string, v double")
    sinks.write_parquet(df, str(tmp_path / "p"), "panel", ["id", "v"], ["id"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    with pytest.raises(ValueError):
        sinks.write_parquet(df, str(tmp_path / "q"), "panel", ["absent"])
    with pytest.raises(ValueError):
        sinks.check_schema(df.withColumnRenamed("label", "review_text"), "panel", ["id"])
    sinks.write_json(df.coalesce(1), str(tmp_path / "j"))
    lines = [json.loads(x) for f in pathlib.Path(tmp_path / "j").glob("*.json") for x in f.read_text().splitlines()]
    assert sorted((x["id"], x["v"]) for x in lines) == sorted([(1, None), (2, 2.5)])
    with pytest.raises(AnalysisException):
        sinks.write_json(df, str(tmp_path / "j"))
    sinks.write_csv(df, str(tmp_path / "c"), guarded=True)
    assert {r["label"] for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()} == {"'=1+1", "plain"}
