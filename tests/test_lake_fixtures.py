"""Golden values on the reference's two checked-in CSV files (FIXTURES §1-2)
and the three end-to-end paths.  Skipped when the files are not present."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import LAKE_CSV, POND_CSV
from limnos.functions.fuzzy import SLIDER_EPS, DEFAULT_EPS
from limnos.operators import clean, features
from limnos.operators import fuzzy_matrix as fm
from limnos.plans import pipeline as P
from limnos.sources.delimited import read_delimited, sniff
from limnos.sources.headers import TARGET, canonical_headers

pytestmark = pytest.mark.skipif(not (LAKE_CSV and os.path.exists(LAKE_CSV) and POND_CSV),
                                reason="set LIMNOS_LAKE_CSV / LIMNOS_POND_CSV to run the golden tests")

GOLDEN = {  # column: (n, min, max, mean, std_pop)
    "ph": (326, 7.27, 10.02, 8.76581, 0.640779),
    "temp_c": (326, 20.4, 29.9, 25.557699, 1.912323),
    "cond_us_cm": (326, 229.0, 817.0, 635.667485, 96.594108),
    "do_mg_l": (326, 0.0, 388.0, 11.594693, 24.316306),
    "turb_ntu": (326, 1.95, 2670.0, 50.867638, 158.578786),
    "chl_ug_l": (326, 2.67, 176006.4, 713.947989, 9727.805697),
}


@pytest.fixture(scope="module")
def lake(spark):
    return clean.clean_lake(canonical_headers(read_delimited(spark, LAKE_CSV))).persist()


def test_sniff(spark):
    assert sniff(spark, LAKE_CSV) == (",", "UTF-8")


def test_column_statistics(lake):
    for c, (n, lo, hi, mean, std) in GOLDEN.items():
        r = lake.agg(F.count(c), F.min(c), F.max(c), F.avg(c), F.stddev_pop(c)).first()
        assert r[0] == n
        assert (r[1], r[2]) == pytest.approx((lo, hi))
        assert r[3] == pytest.approx(mean, abs=1e-5)
        assert r[4] == pytest.approx(std, abs=1e-5)


def test_comma_cells_T1(lake):
    vals = {r[0] for r in lake.select("turb_ntu").collect()}
    assert 4.9 in vals and 1.95 in vals
    assert 1378.84 in {r[0] for r in lake.select("chl_ug_l").collect()}


def test_class_counts(lake):
    labeled = features.with_labels(lake, TARGET)
    counts = {r.class_idx: r.n for r in features.class_counts(labeled).collect()}
    assert counts == {0: 0, 1: 4, 2: 66, 3: 256}


@pytest.mark.parametrize("eps,want", [(DEFAULT_EPS, [0, 4.655, 65.9339, 255.4111]),
                                      (SLIDER_EPS, [0, 4.56875, 66.4137, 255.01755])])
def test_fuzzy_mass(lake, eps, want):
    got = {r.true_idx: r.mass for r in fm.fuzzy_mass_per_class(lake, TARGET, eps).collect()}
    assert [got[i] for i in range(4)] == pytest.approx(want, abs=1e-4)
    assert sum(got.values()) == pytest.approx(326)


def test_pond_file(spark):
    pond = clean.clean_lake(canonical_headers(read_delimited(spark, POND_CSV)), with_target=False)
    assert pond.count() == 119
    r = pond.agg(F.min("cond_us_cm"), F.max("cond_us_cm"), F.avg("temp_c")).first()
    assert (r[0], r[1]) == pytest.approx((1220.355038, 1279.206297))
    assert r[2] == pytest.approx(21.795042, abs=1e-5)


def test_three_paths(spark, tmp_path):
    survey = P.load_survey(spark, LAKE_CSV)
    m = P.train_lake(spark, survey, "single")
    mats = m.matrices.collect()
    n_test = 66                                   # ceil(0.2 * 326)
    for model in ("rbf", "knn", "regressor"):
        tot = sum(r.weight for r in mats if r.model == model)
        assert tot == pytest.approx(n_test, abs=1e-6)
    assert len(m.curve) >= 1
    preds, pond_m = P.score_pond(spark, m, P.load_survey(spark, POND_CSV), str(tmp_path / "pred"))
    rows = preds.collect()
    assert len(rows) == 119 and all(r.chl_pred >= 0 and r.used_proxy for r in rows)
    back = read_delimited(spark, str(tmp_path / "pred"))
    assert back.count() == 119 and "chl_pred" in back.columns
    eq, r2 = P.surrogate(m)
    assert len(eq.coefs) == 5 and r2 <= 1.0


def test_negative_target_profile(spark):
    df = spark.createDataFrame(
        [(str(7 + i % 3), "25", "600", "8", "10", str(v)) for i, v in
         enumerate([-1.0, 3.0, 10.0, 50.0, -5.0] * 12)],
        ["pH", "Temperatura", "Conductividad", "OD (mg/L)", "Turbidez", "Clorofila"])
    survey = canonical_headers(df).withColumn("_row", F.monotonically_increasing_id())
    m = P.train_lake(spark, survey, "filtered")
    assert m.rejected_negative == 24
    assert m.clean.count() == 36
