"""The training job's artifacts, named folds and sparse one-hot codes."""

from __future__ import annotations

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from perkline.operators import modeling, scaling


def _rows(spark, n=400):
    d = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 20).cast("double").alias("x"), F.when(F.col("id") % 3 != 0, "a").when(F.col("id") % 2 == 0, "b").alias("g"))
    d = d.withColumn("y", 3 * F.col("x") + F.when(F.col("g") == "a", 0.0).otherwise(6.0))
    return modeling.split(d, "y", "k", discrete=False)


def test_training_job_leaves_a_model_and_reports(spark, tmp_path):
    d = _rows(spark)
    run = modeling.training_job(d, ["x"], "y", "k", ["g", "absent"], str(tmp_path / "job"), {"linear": modeling.linear("y")})
    assert run.best == "linear" and [r["model"] for r in run.board.orderBy("rmse").collect()] == ["linear", "mean_baseline"]
    val = d.where("split = 'val'")
    again = modeling.regression_metrics(PipelineModel.load(f"{run.folder}/model").transform(val), "y", "prediction").first()
    stored = run.metrics.where("split = 'val'").first()
    assert stored["rmse"] == pytest.approx(again["rmse"]) and stored["n"] == val.count()
    assert {r["segment"] for r in run.segments.collect()} == {"a", "b"} and "absent" not in {r["feature"] for r in run.bias.collect()}
    assert run.bias.where("name = 'performance_disparity'").count() == 1
    verdict = run.verdict.first()
    assert not verdict["passed"] and verdict["reason"].startswith("Test RMSE")
    assert run.ranking.first()["k"] == 10


def test_training_job_without_groups_and_with_an_empty_split(spark, tmp_path):
    d = _rows(spark)
    run = modeling.training_job(d, ["x"], "y", "k", [], str(tmp_path / "a"), {})
    assert run.best == "mean_baseline" and run.segments.count() == run.bias.count() == 0
    with pytest.raises(ValueError, match="splits with rows"):
        modeling.training_job(d.where("split <> 'test'"), ["x"], "y", "k", [], str(tmp_path / "b"), {})
    with pytest.raises(ValueError, match="splits with rows"):
        modeling.training_job(d.limit(0), ["x"], "y", "k", [], str(tmp_path / "c"), {})


def test_sparse_codes_agree_with_columns(spark):
    d = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("b",)], "v string")
    params = scaling.fit(d.where("v <> 'c' OR v IS NULL"), scaling.Plan(onehot=["v"]), "d")
    names = scaling.collect_params(params, "d")[("v", "onehot")]
    got = {(r["v"], r["code"]["size"], r["code"]["position"]) for r in scaling.onehot_sparse(d, params, "d", "v", "code").collect()}
    want = {(v, len(names), names.index(v or scaling.MISSING) if (v or scaling.MISSING) in names else None) for v in ["b", "a", None, "c"]}
    assert got == want
    with pytest.raises(ValueError, match="onehot_sparse"):
        scaling.collect_params(params, "d", most_columns=2)
