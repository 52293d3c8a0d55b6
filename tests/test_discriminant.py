"""Discriminant classifiers against densities computed directly."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors

from cohortloom.operators.ml import classifier


@pytest.mark.parametrize("name", ["lda", "qda"])
def test_matches_gaussian_densities(spark, name, tmp_path):
    r = np.random.default_rng(4)
    y = r.integers(0, 3, 240)
    x = r.normal(size=(240, 2)) @ np.array([[1.0, 0.4], [0.0, 0.8]]) + np.array([[0, 0], [2, 1], [-1, 2]])[y]
    x = np.column_stack((x, np.ones(240)))  # a constant feature says nothing
    df = spark.createDataFrame([(k, Vectors.dense(v), float(c)) for k, (v, c) in enumerate(zip(x, y, strict=True))], ["id", "features", "label"])
    covs = [np.cov(x[y == k, :2].T) for k in range(3)]
    pooled = sum(c * ((y == k).sum() - 1) for k, c in enumerate(covs)) / (len(y) - 3)
    scores = []
    for k in range(3):
        cov = pooled if name == "lda" else covs[k]
        off = x[:, :2] - x[y == k, :2].mean(axis=0)
        scores.append(np.log((y == k).mean()) - 0.5 * np.log(np.linalg.det(cov)) - 0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off))
    odds = np.exp(np.array(scores).T)
    odds /= odds.sum(axis=1, keepdims=True)
    model = PipelineModel([classifier(name, 3).fit(df)])
    model.write().overwrite().save(f"file://{tmp_path}/model")
    for own in (model, PipelineModel.load(f"file://{tmp_path}/model")):
        got = sorted(own.transform(df).select("id", "probability", "prediction").collect())
        assert np.allclose([g.probability.toArray() for g in got], odds, atol=1e-8)
        assert [g.prediction for g in got] == odds.argmax(axis=1).tolist()
