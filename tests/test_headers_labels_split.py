"""Headers (B1-B3, T2-T4), binning (C1, T5, T16), split (C5), scaler (C6, T11)."""

import math

import pytest
from pyspark.sql import functions as F

from limnos.functions.labels import bin_label
from limnos.operators import features
from limnos.operators.clean import clean_lake
from limnos.sources.headers import canonical_headers, canonical_name, header_mapping, require_columns

LAKE_HEADERS = ["﻿Fecha", "Hora", "Sitio", "pH", "Temperatura (°C)", "Conductividad (µS/cm)",
                "Oxígeno disuelto (mg/L)", "Turbidez (NTU)", "Clorofila (µg/L)"]


def test_lake_headers():
    m = header_mapping(LAKE_HEADERS)
    assert list(m.values()) == ["fecha", "hora", "sitio", "ph", "temp_c", "cond_us_cm", "do_mg_l",
                                "turb_ntu", "chl_ug_l"]


@pytest.mark.parametrize("h,want", [
    ("TEMP (°C)", "temp_c"), ("Turbiedad NTU", "turb_ntu"), ("OD (mg/l)", "do_mg_l"),
    ("Dissolved Oxygen mg/L", "do_mg_l"), ("Chlorophyll-a", "chl_ug_l"), ("Clorofila (μg/L)", "chl_ug_l"),
    ("conductividad (uS/cm)", "cond_us_cm"), ("Conductividad (mS/cm)", "cond_ms_cm"),
    ("Ficocianina", "phyco_ug_l"), ("Comentario", "Comentario"), ("x (mg/l)", "x (mg/L)"),
])
def test_canonical_names(h, want):
    assert canonical_name(h) == want


def test_duplicates_raise_T4():
    with pytest.raises(ValueError):
        header_mapping(["Temperatura", "temp (°c)"])


def test_required_columns_B3(spark):
    df = spark.createDataFrame([("1",)], "ph string")
    with pytest.raises(ValueError):
        require_columns(df, ["ph", "temp_c"])
    with pytest.raises(ValueError):
        clean_lake(df)


def test_ms_conductivity_is_scaled_T2(spark):
    df = spark.createDataFrame([("7", "20", "1,2", "8", "5", "10")],
                               ["pH", "Temp", "Conductividad (mS/cm)", "OD (mg/L)", "NTU", "Clorofila"])
    out = clean_lake(canonical_headers(df)).first()
    assert out["cond_us_cm"] == pytest.approx(1200.0)


def test_binning_edges_T5(spark):
    xs = [-0.1, 0.0, 1.99, 2.0, 6.99, 7.0, 39.99, 40.0, 1e6, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = [r[0] for r in df.orderBy("i").select(bin_label("x")).collect()]
    assert got == [None, 0, 0, 1, 1, 2, 2, 3, 3, None, None, None]


def test_class_counts_include_zero_classes_T16(spark):
    df = spark.createDataFrame([(3.0,), (10.0,), (50.0,), (60.0,)], "y double")
    labeled = features.with_labels(df, "y")
    counts = {r.class_idx: r.n for r in features.class_counts(labeled).collect()}
    assert counts == {0: 0, 1: 1, 2: 1, 3: 2}
    assert features.distinct_classes(labeled).first()[0] == 3
    w = {r.class_idx: r.weight for r in features.class_weight_table(labeled).collect()}
    assert w == pytest.approx({1: 4 / 3, 2: 4 / 3, 3: 4 / 6})


@pytest.mark.parametrize("n", [1, 7, 326, 1000])
def test_split_exact_size_and_stable(spark, n):
    df = spark.range(n).withColumnRenamed("id", "k")
    a = features.train_test_split(df, ["k"])
    b = features.train_test_split(df.repartition(5), ["k"])
    ta = {r.k for r in a.filter("is_test").collect()}
    tb = {r.k for r in b.filter("is_test").collect()}
    assert len(ta) == math.ceil(0.2 * n) and ta == tb
    assert a.count() == n


def test_split_radix_descent(spark):
    """Small collect limit forces several histogram levels."""
    df = spark.range(5000).withColumnRenamed("id", "k").withColumn("_h", features.split_hash(["k"]))
    hs = sorted(r._h for r in df.select("_h").collect())
    assert features._kth_hash(df.select("_h"), "_h", 1000, chunk=1, collect_limit=10) == hs[999]


def test_population_std_scaler_T11(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (4.0, 5.0)], "a double, b double")
    m = features.fit_standard_scaler(df, ["a", "b"])
    assert m.stds[0] == pytest.approx(math.sqrt(1.25))
    out = m.transform(df).collect()
    assert [r.b for r in out] == [0.0] * 4          # zero variance -> divide by 1
    assert sum(r.a for r in out) == pytest.approx(0.0)


def test_split_hot_key_never_collected(spark):
    """A third of the rows share one key: the radix descent ends on the full
    hash instead of collecting the hot bucket."""
    df = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    hashed = df.withColumn("_h", features.split_hash(["k"]))
    hs = sorted(r._h for r in hashed.select("_h").collect())
    got = features._kth_hash(hashed.select("_h"), "_h", 1500, chunk=4, collect_limit=10)
    assert got == hs[1499]
