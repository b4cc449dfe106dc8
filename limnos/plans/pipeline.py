"""The three end-to-end paths: train on lake data, score a pond, surrogate.

One function per path plus a ``Profile`` holding the differences between the
three lake variants (single lake with tunable ε, second lake with negative
filter / left shoulder / null tokens, fused lakes).  Everything that grows
with the data stays in DataFrames; the driver holds only header names,
scaler moments, model parameters and per-class counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.functions.fuzzy import SLIDER_EPS, DEFAULT_EPS
from limnos.operators import clean as C
from limnos.operators import features as FT
from limnos.operators import fuzzy_matrix as FM
from limnos.operators import knn as KNN
from limnos.operators import margin_classifier as MC
from limnos.operators import models as MD
from limnos.operators import ridge as RG
from limnos.operators.probabilities import expected_from_probs, select_truth
from limnos.sources.delimited import export_predictions, read_delimited
from limnos.sources.headers import FEATURES, TARGET, canonical_headers

Z = [f"{c}_z" for c in FEATURES]


@dataclass(frozen=True)
class Profile:
    name: str
    eps: tuple = DEFAULT_EPS
    low: str = "trapezoid"                # class-0 membership shape
    reject_negative: bool = False          # drop (and count) negative targets
    mask_unlabeled_train: bool = False     # drop training rows without a class
    require_two_classes: bool = False
    svm_c: float = 1.0
    comma: str = "decimal"


# The three lake profiles.
PROFILES = {
    "single": Profile("single", eps=SLIDER_EPS),
    "filtered": Profile("filtered", low="shoulder", reject_negative=True, mask_unlabeled_train=True,
                   require_two_classes=True, svm_c=2.0),
    "fused": Profile("fused", svm_c=2.0),
}


@dataclass
class LakeModels:
    profile: Profile
    scaler: FT.ScalerModel
    regressor: MD.RobustRegressor
    rbf: MC.MarginClassifier
    knn_train: DataFrame
    curve: list
    matrices: DataFrame
    clean: DataFrame
    rejected_negative: int = 0


def load_survey(spark: SparkSession, path: str) -> DataFrame:
    """Delimited survey -> canonical STRING columns + a row id."""
    return with_row_id(canonical_headers(read_delimited(spark, path)))


def with_row_id(df: DataFrame) -> DataFrame:
    """A row id from the row's content, a dataset tag included: the same on
    any cluster.  Equal rows share one; their features, and with them their
    neighbours and predictions, are equal too.  Give fused surveys theirs after
    the fusion."""
    return df.withColumn("_row", F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns) if c != "_row"]))


def _vectors(df: DataFrame) -> DataFrame:
    return df.withColumn("features", F.array(*[F.col(c) for c in Z]))


def _model_probs(models_or_parts, df_s: DataFrame, k: int = 7) -> DataFrame:
    """RBF and kNN class distributions for scaled rows keyed by ``_row``."""
    rbf, knn_train = models_or_parts
    with_rbf = rbf.predict_proba(df_s, out="p_rbf")
    votes = KNN.knn_classify(knn_train, _vectors(df_s).dropDuplicates(["_row"]), key="_row", vec="features",
                             label="class_idx", k=k, n_pivots=None)
    p_knn = KNN.probs_to_array(votes).select(F.col("qkey").alias("_row"), F.col("probs").alias("p_knn"))
    return with_rbf.join(p_knn, "_row", "left")


def _matrices(df: DataFrame, truth: str, prof: Profile) -> DataFrame:
    """RBF, kNN and regressor matrices side by side (E9), one aggregate.  A
    regressor's value at or below zero counts as class 0, so no row is lost."""
    df = df.withColumn("chl_nn", F.greatest("chl_nn", F.lit(1e-9)))
    return FM.fuzzy_confusion_models(df, truth, {"rbf": ("probs", "p_rbf"), "knn": ("probs", "p_knn"),
                                                 "regressor": ("pred", "chl_nn")},
                                     eps=prof.eps, low=prof.low)


def train_lake(spark: SparkSession, survey: DataFrame, profile: str | Profile = "single",
               seed: int = 42) -> LakeModels:
    """Path 1: clean -> split -> scale -> regressor + two classifiers ->
    fuzzy matrices on the held-out fifth, and the training curve."""
    prof = PROFILES[profile] if isinstance(profile, str) else profile
    df = C.clean_lake(survey, prof.comma)
    rejected = 0
    if prof.reject_negative:
        rejected = int(C.count_negative_target(df).first()["rejected"])
        df = C.reject_negative_target(df)
    clean = df.select("_row", *FEATURES, TARGET).persist()
    C.ensure_not_empty(clean, "lake survey")
    split = FT.train_test_split(clean, ["_row"], seed)
    train, test = split.filter(~F.col("is_test")), split.filter(F.col("is_test"))
    scaler = FT.fit_standard_scaler(train, FEATURES)
    train_s = FT.with_labels(scaler.transform(train, suffix="_z"), TARGET)
    test_s = scaler.transform(test, suffix="_z")
    if prof.mask_unlabeled_train:
        train_s = FT.drop_unlabeled(train_s)
    if prof.require_two_classes:
        FT.require_two_classes(train_s)
    reg = MD.fit_robust_regressor(train_s, Z, TARGET, ["_row"], seed=seed)
    rbf = MC.fit(train_s, Z, "class_idx", ["_row"], c=prof.svm_c, seed=seed)
    knn_train = _vectors(FT.drop_unlabeled(train_s)).select("_row", "features", "class_idx")
    scored = reg.predict(_model_probs((rbf, knn_train), test_s), out="chl_nn", clip=False)
    matrices = _matrices(scored, TARGET, prof)
    return LakeModels(prof, scaler, reg, rbf, knn_train, reg.curve, matrices, clean, rejected)


def score_pond(spark: SparkSession, models: LakeModels, pond: DataFrame,
               export_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Path 2: clean features -> class distributions and regressor output ->
    truth (own column, else regressor proxy) -> matrices; optional export.
    Returns (predictions, matrices)."""
    prof = models.profile
    df = C.clean_lake(pond, prof.comma, with_target=False)
    C.ensure_not_empty(df, "pond data")
    have_truth = TARGET in df.columns
    df_s = models.scaler.transform(df, suffix="_z")
    scored = _model_probs((models.rbf, models.knn_train), df_s)
    scored = models.regressor.predict(scored, out="chl_nn", clip=False)
    scored = select_truth(scored, truth=TARGET if have_truth else None,
                          regressor="chl_nn", out="y_true")
    matrices = _matrices(scored, "y_true", prof)
    keep = [c for c in df.columns if not c.startswith("_")]
    preds = scored.select(*keep, F.greatest(F.col("chl_nn"), F.lit(0.0)).alias("chl_pred"),
                          expected_from_probs("p_rbf").alias("chl_expected"), "used_proxy")
    if export_path:
        export_predictions(preds, export_path, fmt="csv")
    return preds, matrices


def surrogate(models: LakeModels, alpha: float = 1.0) -> tuple[RG.RidgeModel, float]:
    """Path 3: ridge equation of the regressor's output on raw features over
    all clean rows, and its R² against that output."""
    df_s = models.scaler.transform(models.clean, suffix="_z")
    out = models.regressor.predict(df_s, out="y_nn", clip=False)
    model = RG.fit_ridge(out, FEATURES, "y_nn", alpha)
    r2 = RG.r2_of(out, model, "y_nn").first()["r2"]
    return model, float(r2)
