"""Model gates (D2-D4, D7): quality on a planted signal, reproducibility,
and the Fourier map against the exact RBF kernel."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from limnos.operators import models
from limnos.plans import catalog


@pytest.fixture(scope="module")
def planted(spark):
    return catalog.planted(spark, SF_SMALL).persist()


def test_fourier_map_approximates_rbf_kernel(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 4))
    fmap = models.FourierMap.make([f"x{i}" for i in range(4)], n_features=1024, gamma=0.25, seed=7)
    df = spark.createDataFrame([tuple(map(float, r)) + (i,) for i, r in enumerate(x)],
                               [f"x{i}" for i in range(4)] + ["i"])
    z = np.array([list(r)[:-1] for r in df.select(*fmap.columns(), "i").orderBy("i").collect()])
    approx = z @ z.T
    d2 = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    exact = np.exp(-0.25 * d2)
    assert np.abs(approx - exact).max() < 0.15


def test_rbf_classifier_beats_majority(spark, planted):
    train, test = planted.filter(~F.col("is_test")), planted.filter("is_test")
    clf = models.fit_rbf_classifier(train, catalog.PLANT_INPUTS, "class_idx", n_features=64, max_iter=50)
    scored = clf.predict_proba(test).withColumn(
        "pred", F.array_position("probs", F.array_max("probs")) - 1)
    acc = scored.agg(F.avg((F.col("pred") == F.col("class_idx")).cast("double"))).first()[0]
    counts = [r[1] for r in test.groupBy("class_idx").count().collect()]
    majority = max(counts) / sum(counts)
    assert acc > majority + 0.2
    probs = scored.select("probs").limit(50).collect()
    assert all(abs(sum(r.probs) - 1) < 1e-9 for r in probs)


def test_regressor_beats_mean_and_is_reproducible(spark, planted):
    train, test = planted.filter(~F.col("is_test")), planted.filter("is_test")
    reg, fit_part, val_part = models.fit_regressor(train, catalog.PLANT_INPUTS, "chl_ug_l",
                                                   ["l_orderkey", "l_linenumber"], max_iter=20)
    out = reg.predict(test, clip=True)
    r = out.agg(F.avg((F.log1p("chl_pred") - F.log1p("chl_ug_l")) ** 2),
                F.var_pop(F.log1p("chl_ug_l")), F.min("chl_pred")).first()
    assert r[0] < 0.25 * r[1] and r[2] >= 0
    curve = reg.curve(fit_part, val_part, "chl_ug_l")
    assert curve[-1][1] < curve[0][1] and curve[-1][2] < curve[0][2]
    reg2, _, _ = models.fit_regressor(train, catalog.PLANT_INPUTS, "chl_ug_l",
                                      ["l_orderkey", "l_linenumber"], max_iter=20)
    a = reg.predict(test).select("chl_pred").orderBy("chl_pred").limit(20).collect()
    b = reg2.predict(test).select("chl_pred").orderBy("chl_pred").limit(20).collect()
    assert a == b


def test_partitions_of_a_fit_grow_with_the_rows(spark, monkeypatch):
    from limnos import session
    from limnos.operators import models as md
    seen = []
    monkeypatch.setattr(session, "FIT_ROWS", 20)
    monkeypatch.setattr(md, "deal", lambda df, *keys, partitions: seen.append(partitions) or session.deal(df, *keys, partitions=partitions))
    df = spark.range(400).selectExpr("id k", "double(id % 20) a", "double(id % 7) b", "int(id % 2) y")
    md.fit_rbf_classifier(df, ["a", "b"], "y", n_features=4, max_iter=3)
    md.fit_regressor(df, ["a", "b"], "a", ["k"], max_iter=2, max_depth=2)
    assert seen == [20, 20]


def _classes(spark, n=3000):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, 2))
    r = (x ** 2).sum(1)
    y = np.where(r < 0.5, 0, np.where(r < 2.0, 2, 3))
    return x, y, spark.createDataFrame([(*map(float, v), int(k)) for v, k in zip(x, y)], "a double, b double, y int")


def test_rbf_fit_ends_at_the_minimum_over_all_rows(spark, monkeypatch):
    """Whatever sample the curvature comes from, the coefficients are those of
    Spark's own multinomial regression on the same features and weights."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    x, y, df = _classes(spark)
    fits = []
    for rows in (150, 100_000):
        monkeypatch.setattr(models, "CURVE_ROWS", rows)
        fits.append(models.fit_rbf_classifier(df, ["a", "b"], "y", n_features=16, partitions=3))
    assert fits[0].classes == [0, 2, 3]
    assert np.abs(fits[0].coefs - fits[1].coefs).max() < 1e-3
    # the gradient over all rows vanishes
    z, place = fits[0].fmap.vectors(x), np.searchsorted([0, 2, 3], y)
    weight = (1 / (3 * np.bincount(place)))[place]
    _, grad, _ = models._loss(z, place, weight, fits[0].coefs)
    ridge = 1e-3 * fits[0].coefs * np.append(np.ones(16), 0)[:, None]
    assert np.abs(grad + ridge).max() < 1e-5
    feats = spark.createDataFrame([(*map(float, v[:-1]), float(k), float(w) * len(y)) for v, k, w in zip(z, place, weight)],
                                  [f"z{i}" for i in range(16)] + ["k", "w"])
    spark_fit = LogisticRegression(featuresCol="z", labelCol="k", weightCol="w", family="multinomial", regParam=1e-3, maxIter=500,
                                   tol=1e-10, standardization=False).fit(VectorAssembler(inputCols=[f"z{i}" for i in range(16)], outputCol="z").transform(feats))
    got = models._softmax(z @ fits[0].coefs)[0]
    want = models._softmax(z @ np.vstack([spark_fit.coefficientMatrix.toArray().T, spark_fit.interceptVector.toArray()]))[0]
    assert np.abs(got - want).max() < 1e-3


def test_rbf_probabilities_leave_out_classes_without_rows(spark):
    x, y, df = _classes(spark, 600)
    fit = models.fit_rbf_classifier(df, ["a", "b"], "y", n_features=32, partitions=2)
    rows = fit.predict_proba(df).collect()
    assert all(r.probs[1] == 0 and abs(sum(r.probs) - 1) < 1e-9 for r in rows)
    assert np.mean([int(np.argmax(r.probs)) == r.y for r in rows]) > 0.85


def _steps(spark, n=1500):
    """Inputs of ten values each, so that every split of theirs is a candidate."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 10, size=(n, 3)).astype(float)
    y = np.sin(x[:, 0]) + 0.3 * x[:, 1] * (x[:, 2] > 4) + rng.normal(0, 0.3, n)
    return spark.createDataFrame([(k, *map(float, v), float(t)) for k, (v, t) in enumerate(zip(x, y))], "k long, a double, b double, c double, y double")


@pytest.mark.parametrize("tol", [1e-4, 0.02])
def test_trees_are_those_of_sparks_own_boosting(spark, tmp_path, tol):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    df = _steps(spark)
    reg, fit_part, val_part = models.fit_regressor(df, ["a", "b", "c"], "y", ["k"], log_target=False, max_iter=25, max_depth=4, tol=tol)
    vec = VectorAssembler(inputCols=["a", "b", "c"], outputCol="x").transform
    own = GBTRegressor(featuresCol="x", labelCol="y", predictionCol="own", maxIter=25, maxDepth=4, stepSize=0.1, validationIndicatorCol="v",
                       validationTol=tol, lossType="squared").fit(vec(fit_part.withColumn("v", F.lit(False)).unionByName(val_part.withColumn("v", F.lit(True)))))
    assert len(reg.model.trees) == len(own.trees) and list(reg.model.treeWeights) == list(own.treeWeights)
    off = reg.predict(own.transform(vec(df)), "mine", clip=False).agg(F.max(F.abs(F.col("mine") - F.col("own"))), F.stddev("own")).first()
    assert off[0] < 1e-5 < off[1]
    assert [t.depth for t in reg.model.trees] == [t.depth for t in own.trees]
    assert np.abs(reg.model.featureImportances.toArray() - own.featureImportances.toArray()).max() < 1e-5
    models.save_regressor(reg, str(tmp_path / "gbt"))
    again = models.load_regressor(str(tmp_path / "gbt"), ["a", "b", "c"], log_target=False)
    both = again.predict(reg.predict(df, "p", clip=False), "q", clip=False)
    assert both.where("p <> q").count() == 0


def test_regressor_keeps_bytes_and_not_vectors(spark, monkeypatch):
    """What a fit caches is a block of bins, labels and predicted values; the
    trees do not depend on the partitions; missing inputs are an error."""
    from limnos.operators import squared_boost
    df, kept, plain = _steps(spark), [], squared_boost.huber_boost._predicted
    monkeypatch.setattr(squared_boost.huber_boost, "_predicted", lambda blocks, model: kept.append((blocks.dtypes, len(model.trees))) or plain(blocks, model))
    fits = [models.fit_regressor(d, ["a", "b", "c"], "y", ["k"], log_target=False, max_iter=6, max_depth=3, tol=0.0, partitions=n)[0]
            for d, n in ((df, 2), (df.orderBy(F.rand(3)), 5))]
    assert kept == [([("x", "binary"), ("y", "binary"), ("val", "binary")], at) for at in (0, 4)] * 2
    assert fits[0].model.toDebugString.split("\n", 1)[1] == fits[1].model.toDebugString.split("\n", 1)[1]
    with pytest.raises(Exception, match="missing input or label"):
        models.fit_regressor(df.withColumn("a", F.expr("if(k = 7, null, a)")), ["a", "b", "c"], "y", ["k"], log_target=False, max_iter=2)
