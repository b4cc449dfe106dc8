"""The three end-to-end paths on files that the tests write."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from limnos.operators import fuzzy_matrix as fm
from limnos.plans import catalog
from limnos.plans import pipeline as P
from limnos.sources.delimited import read_delimited
from limnos.sources.headers import TARGET

HEAD = "Fecha,Hora,Sitio,pH,Temperatura (°C),Conductividad (µS/cm),Oxígeno disuelto (mg/L),Turbidez (NTU),Clorofila (µg/L)"


def lake_csv(path, n=160, negative=False):
    """Byte order mark, thousands commas in quotes, null tokens in places."""
    lines = [HEAD]
    for k in range(n):
        ph, temp, cond = 7 + k % 7 / 5, 20 + k % 11 / 2, 300 + 37 * k % 500
        chl = (ph - 7) ** 2 * 25 + (temp - 20) * 2 + 0.5
        chl = -chl if negative and k % 8 == 0 else chl
        turb = '"4,900"' if k % 40 == 0 else f"{k % 23 + 1.5}"
        cell = f'"1,{round(chl * 10):03d}.50"' if k % 50 == 7 else f"{chl:.4f}"
        lines.append(f"2{k % 8}-ene-17,10:15,Sitio {k % 5},{ph},{temp},{cond},{5 + k % 9},{turb},{cell}")
    path.write_text("﻿" + "\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def pond_csv(path, n=25, truth=False):
    lines = ["Temperatura (°C);pH;Oxígeno Disuelto (mg/L);Turbidez (NTU);Conductividad (uS/cm)" + (";Clorofila (µg/L)" if truth else "")]
    lines += [f"{21 + k % 4 / 4:.2f};{7.8 + k % 5 / 10:.2f};{1 + k % 3};{40 + k};{400 + k}".replace(".", ",") + (f";{k}" if truth else "") for k in range(n)]
    path.write_text("\r\n".join(lines) + "\r\n", encoding="utf-8")
    return str(path)


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("lake")
    survey = P.load_survey(spark, lake_csv(folder / "lake.csv"))
    return folder, P.train_lake(spark, survey, "single")


def test_path_one(spark, trained):
    _, m = trained
    assert m.clean.count() == 160 and m.rejected_negative == 0
    assert m.clean.agg(F.max("turb_ntu")).first()[0] < 100  # "4,900" is 4.9
    mats = m.matrices.collect()
    for model in ("rbf", "knn", "regressor"):
        assert sum(r.weight for r in mats if r.model == model) == pytest.approx(32, abs=1e-6)  # ceil(0.2 * 160)
    assert len(m.curve) >= 1


@pytest.mark.parametrize("truth", [False, True])
def test_path_two(spark, trained, truth):
    folder, m = trained
    out = str(folder / f"pred-{truth}")
    preds, mats = P.score_pond(spark, m, P.load_survey(spark, pond_csv(folder / f"pond-{truth}.csv", truth=truth)), out)
    rows = preds.collect()
    assert len(rows) == 25 and all(r.chl_pred >= 0 and r.chl_expected >= 0 and r.used_proxy is (not truth) for r in rows)
    assert read_delimited(spark, out).count() == 25
    total = {r.model: r.w for r in mats.groupBy("model").agg(F.sum("weight").alias("w")).collect()}
    assert set(total) == {"rbf", "knn", "regressor"}
    assert all(w == pytest.approx(24 if truth else 25, abs=1e-6) for w in total.values())  # a truth of 0 belongs nowhere


def test_path_three(spark, trained):
    _, m = trained
    eq, r2 = P.surrogate(m)
    assert len(eq.coefs) == 5 and 0.3 < r2 <= 1.0
    printed = {r.term: r for r in eq.printed(spark).collect()}
    assert printed["ph"].symbol == "pH" and float(printed["ph"].printed) == pytest.approx(printed["ph"].coef, rel=1e-3)


def test_filtered_profile(spark, tmp_path):
    m = P.train_lake(spark, P.load_survey(spark, lake_csv(tmp_path / "neg.csv", 96, negative=True)), "filtered")
    assert m.rejected_negative == 12 and m.clean.count() == 84
    assert m.clean.where(F.col(TARGET) < 0).count() == 0
    assert sum(r.weight for r in m.matrices.where("model = 'regressor'").collect()) == pytest.approx(17, abs=1e-6)


def test_lake_pipeline_query(spark):
    """Full matrices: their row sums are the fuzzy mass of the held-out truth
    for all three models, and each model is right more often than chance."""
    rows = catalog.QUERIES["lake_pipeline"](spark, SF_SMALL).collect()
    assert len(rows) == 48
    survey = catalog.lake_survey_from_lineitem(spark, SF_SMALL)
    from limnos.operators import features
    held = features.train_test_split(survey.select("_row", TARGET), ["_row"], 42).where("is_test")
    mass = {r.true_idx: r.mass for r in fm.fuzzy_mass_per_class(held, TARGET).collect()}
    for model in ("rbf", "knn", "regressor"):
        mine = [r for r in rows if r.model == model]
        for i in range(4):
            assert sum(r.weight for r in mine if r.true_idx == i) == pytest.approx(mass[i], abs=1e-3)
        total = sum(mass.values())
        chance = sum(v * v for v in mass.values()) / total
        diagonal = sum(r.weight for r in mine if r.true_idx == r.pred_idx)
        print(model, diagonal, chance, total)
        # class scores spread over their neighbours; the regressor's value does not
        assert diagonal > chance + (0.3 if model == "regressor" else 0.1) * (total - chance)


def test_pond_and_surrogate_queries(spark):
    rows = catalog.QUERIES["pond_scores"](spark, SF_SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SF_SMALL}/supplier.parquet").count()
    assert all(r.used_proxy and r.chl_pred >= 0 for r in rows)
    terms = catalog.QUERIES["regressor_surrogate"](spark, SF_SMALL).collect()
    assert [t.term for t in terms] == ["intercept", "ph", "temp_c", "cond_us_cm", "do_mg_l", "turb_ntu"]
    assert len({t.r2 for t in terms}) == 1 and terms[0].r2 <= 1
