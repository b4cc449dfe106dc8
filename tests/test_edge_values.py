"""Values at the edges: NaN, nulls, constant groups, mixed headers, restarts."""

import pytest
from pyspark.sql import functions as F

from limnos.functions import calibration as cal
from limnos.functions.fuzzy import memberships
from limnos.operators import fuzzy_matrix as fm
from limnos.operators import metrics
from limnos.plans import pipeline as P
from limnos.sources.delimited import read_delimited, sniff
from limnos.sources.fusion import fuse_datasets
from limnos.sources.headers import canonical_name
from limnos.sources.sensor_log import parse_sensor_lines
from limnos.streaming import runner, telemetry


@pytest.mark.parametrize("low", ["trapezoid", "shoulder"])
def test_nan_is_in_no_class(spark, low):
    df = spark.createDataFrame([(float("nan"),), (None,), (float("inf"),)], "x double")
    got = [tuple(r) for r in df.select(*memberships("x", low=low)).collect()]
    assert got == [(0.0,) * 4, (0.0,) * 4, (0.0, 0.0, 0.0, 1.0)]


def test_eps_sweep_equals_single_matrices(spark):
    df = spark.createDataFrame([(float(x), float(x) * 1.1, x % 2) for x in range(60)], "y double, p double, g int")
    grid = [(0.3, 1.0, 5.0), (0.5, 2.0, 3.0)]
    sweep = fm.fuzzy_eps_sweep(df, "y", pred="p", eps_grid=grid, group_cols=["g"]).collect()
    assert len(sweep) == 64
    for k, eps in enumerate(grid):
        one = {(r.g, r.true_idx, r.pred_idx): r.weight for r in fm.fuzzy_confusion(df, "y", pred="p", eps=eps, group_cols=["g"]).collect()}
        assert {(r.g, r.true_idx, r.pred_idx): r.weight for r in sweep if r.eps_id == k} == pytest.approx(one)


def test_r2_of_constant_truth_and_missing_predictions(spark):
    df = spark.createDataFrame([("c", 1.0, 2.0), ("c", 1.0, 1.0), ("m", 1.0, 1.0), ("m", 3.0, 1.0), ("m", 9.0, None), ("m", None, 4.0)],
                               "g string, y double, p double")
    got = {r.g: (r.r2, r.n) for r in metrics.r2_score(df, "y", "p", ["g"]).collect()}
    assert got["c"] == (None, 2) and got["m"] == (pytest.approx(-1.0), 2)


def test_readings_without_temperature_or_voltage(spark):
    df = spark.createDataFrame([(500.0, None, None), (500.0, 25.0, 4.3)], "mv double, t double, v double")
    got = df.select(cal.calibrate_do("mv", "t").alias("do"), cal.turbidity_class("v").alias("m"),
                    cal.turbidity_class("v", cal.TURBIDITY_PROBE_CLASSES).alias("p")).collect()
    assert (got[0].do, got[0].m, got[0].p) == (None, None, None)
    assert got[1].do > 0 and got[1].p == "Agua limpia (muy pocas partículas)."


def test_probe_lines_and_errors(spark):
    lines = ["Temperatura: 24.50 °C\tVoltaje: 1245.00 mV\tOxígeno disuelto: 8.40 mg/L", "Error: Temperatura inválida"]
    one, two = parse_sensor_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert (one.kind, one.temp_c, one.millivolts, one.do_mg_l) == ("do_probe", 24.5, 1245.0, 8.4)
    assert (two.kind, two.message) == ("error", "Temperatura inválida")


@pytest.mark.parametrize("header,want", [
    ("Conductividad (s/cm)", "cond_us_cm"), ("conductividad", "cond_us_cm"), ("Oxigeno disuelto (mgl)", "do_mg_l"), ("O2 disuelto (mg/l)", "do_mg_l"),
    ("oxigeno disuelto", "oxigeno disuelto"), ("Turbidez", "turb_ntu"), ("NTU", "turb_ntu"), ("Ficocianina (µg/L)", "phyco_ug_l"),
    ("temporada", "temporada"), ("pH sensor", "pH sensor"), ("Turbidez y temperatura", "Turbidez y temperatura"), ("﻿Fecha", "fecha"),
    ("Temperatura del agua (°C)", "temp_c"), ("chlorophyll a", "chl_ug_l"), ("Voluntarios", "Voluntarios")])
def test_headers_by_quantity_and_unit(header, want):
    assert canonical_name(header) == want


def test_charset_comes_from_all_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("site,ph\nx,7\nBahía,8\n".encode("latin-1"))
    assert sniff(spark, str(tmp_path / "a.csv"))[1] == "ISO-8859-1"
    assert [r.site for r in read_delimited(spark, str(tmp_path / "a.csv")).collect()] == ["x", "Bahía"]


def test_swapped_headers_in_one_folder_are_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("pH,Temp\n8.1,25\n")
    (tmp_path / "b.csv").write_text("Temp,pH\n25,8.1\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_delimited(spark, str(tmp_path)).collect()


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('note,ph\n"one\ntwo",7\n')
    assert [r.note for r in read_delimited(spark, str(tmp_path / "a.csv"), multi_line=True).collect()] == ["one\ntwo"]


def test_row_ids_of_fused_surveys(spark):
    one = spark.createDataFrame([("7", "20"), ("8", "21")], "ph string, temp string")
    two = spark.createDataFrame([("7", "20"), ("9", "22")], "ph string, temp string")
    ids = [r._row for r in P.with_row_id(fuse_datasets({"a": one, "b": two})).collect()]
    assert len(set(ids)) == 4
    again = [r._row for r in P.with_row_id(fuse_datasets({"a": one.repartition(5), "b": two})).collect()]
    assert set(again) == set(ids)


def test_stream_resumes_and_holds_open_windows(spark, tmp_path):
    src, base = str(tmp_path / "in"), str(tmp_path / "run")
    rows = [(f"2024-01-01 00:00:0{k}", "d", "ph", 100 + k, 20.0) for k in range(4)]
    schema = "ts timestamp, device string, sensor string, raw int, temp_c double"

    def add(part):
        spark.createDataFrame(part, "ts string, device string, sensor string, raw int, temp_c double") \
            .withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(src)

    def go():
        df = runner.file_stream(spark, src, spark.createDataFrame([], schema).schema)
        plan = telemetry.burst_average(telemetry.with_event_time(df, "ts", "1 hour"), "10 seconds")
        return runner.run_available_now(spark, plan, "resume", keys=["window_start", "device", "sensor"], base=base).collect()
    add(rows[:2])
    assert [(r.n, r.raw_avg) for r in go()] == [(2, 100.5)]
    add(rows[2:])
    assert [(r.n, r.raw_avg) for r in go()] == [(4, 101.5)]
    assert [(r.n, r.raw_avg) for r in go()] == [(4, 101.5)]
