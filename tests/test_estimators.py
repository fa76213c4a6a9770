import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler

from gridloom.plans import estimators as est

SCALER, REDUCE, CLUSTER = "pyspark.ml.feature.StandardScaler", "pyspark.ml.feature.PCA", "pyspark.ml.clustering.KMeans"


@pytest.fixture
def points(spark):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(i, rng.standard_normal(4).tolist()) for i in range(60)], "id long, features array<double>")


def test_settings_of_a_stage():
    run = {"scale__withMean": True, "scale__centre": False, "scale__unknown": 3, "kmeans__k": 5, "k": 9, "SCALE__withStd": False}
    assert est.settings_for(StandardScaler, "scale", run) == {"withMean": True, "withStd": False}
    assert est.settings_for(StandardScaler, "scale", run, {"withMean": "centre"}) == {"withMean": False, "withStd": False}
    assert est.settings_for(StandardScaler, "scale", {}, {"withMean": "centre"}, {"withMean": True, "withStd": True, "k": 1}) == {"withStd": True}  # a renamed parameter has no default
    assert est.settings_for(KMeans, "kmeans", run, defaults={"k": 2, "seed": 7}) == {"k": 5, "seed": 7}
    assert est.settings_for(PCA, "pca", run) == {}


def test_chain_equals_the_library_stages(spark, points):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import array_to_vector

    mine = est.RunPipeline([SCALER, REDUCE, CLUSTER], {"standardscaler__withMean": True, "pca__k": 2, "kmeans__k": 3}, defaultSpec={"seed": 4}, inputCol="features", outputCol="cluster")
    got = mine.fit(points).transform(points)
    assert got.columns == ["id", "features", "cluster"]
    stages = [StandardScaler(inputCol="v", outputCol="s", withMean=True), PCA(k=2, inputCol="s", outputCol="r"), KMeans(k=3, seed=4, featuresCol="r", predictionCol="c")]
    vectors = points.withColumn("v", array_to_vector("features"))
    want = Pipeline(stages=stages).fit(vectors).transform(vectors)
    assert {r["id"]: r["cluster"] for r in got.collect()} == {r["id"]: r["c"] for r in want.collect()}


def test_saved_and_read_back(spark, tmp_path, points):
    pipeline = est.RunPipeline([SCALER], {"scale__withMean": True}, names=["scale"], postTransform=["pyspark.ml.feature.Normalizer", REDUCE], defaultSpec={"k": 2}, outputCol="out")
    pipeline.write().overwrite().save(str(tmp_path / "estimator"))
    again = est.RunPipeline.load(str(tmp_path / "estimator"))
    assert again.uid == pipeline.uid and again._value(again.run) == {"scale__withMean": True} and again._value(again.postTransform) == ["pyspark.ml.feature.Normalizer", REDUCE]
    model = again.fit(points)
    model.write().overwrite().save(str(tmp_path / "model"))
    loaded = est.RunPipelineModel.load(str(tmp_path / "model"))
    out = [[r["out"].toArray() for r in m.transform(points).orderBy("id").collect()] for m in (model, loaded)]
    assert np.allclose(out[0], out[1]) and out[0][0].shape == (2,)
    assert np.allclose(loaded.mean.toArray(), model.mean.toArray())  # of the last stage
    with pytest.raises(AttributeError):
        loaded.no_such_attribute


def test_copy_keeps_parameters_and_names_must_fit(points):
    pipeline = est.RunPipeline([SCALER], {"standardscaler__withMean": True})
    assert pipeline.copy()._value(pipeline.modules) == [SCALER]
    with pytest.raises(ValueError):
        est.RunPipeline([SCALER, REDUCE], names=["one"])
