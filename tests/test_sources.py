"""Delimited source (A1): separator and charset detection, quoted cells,
BOM; sensor-log parsing (A5) of every line format."""

import pytest

from limnos.operators.clean import clean_lake
from limnos.sources.delimited import file_profiles, read_delimited, read_folder, sniff
from limnos.sources.headers import canonical_headers
from limnos.sources.sensor_log import parse_sensor_lines

LATIN1_SURVEY = ("pH;Temperatura (°C);Conductividad (mS/cm);Oxígeno disuelto (mg/L);"
                 "Turbidez (NTU);Clorofila (µg/L)\n"
                 "8,1;25,5;0,743;7,2;4,9;12,5\n"
                 "7,9;24;0,5;nd;3;40\n")


def test_latin1_semicolon_decimal_comma(spark, tmp_path):
    p = tmp_path / "survey.csv"
    p.write_bytes(LATIN1_SURVEY.encode("latin-1"))
    assert sniff(spark, str(p)) == (";", "ISO-8859-1")
    df = clean_lake(canonical_headers(read_delimited(spark, str(p))))
    rows = df.collect()
    assert len(rows) == 1                      # the "nd" row is incomplete
    r = rows[0]
    assert (r.ph, r.temp_c, r.cond_us_cm, r.do_mg_l, r.turb_ntu, r.chl_ug_l) == \
        pytest.approx((8.1, 25.5, 743.0, 7.2, 4.9, 12.5))


def test_utf8_bom_comma_quoted(spark, tmp_path):
    p = tmp_path / "bom.csv"
    p.write_bytes(("﻿pH,Turbidez (NTU),Clorofila (µg/L)\r\n"
                   '8.8,"4,900","1,378.84"\r\n').encode("utf-8"))
    assert sniff(spark, str(p)) == (",", "UTF-8")
    df = canonical_headers(read_delimited(spark, str(p)))
    assert df.columns == ["ph", "turb_ntu", "chl_ug_l"]
    r = df.first()
    assert (r.turb_ntu, r.chl_ug_l) == ("4,900", "1,378.84")


def test_sensor_lines(spark):
    lines = ["T[°C]=25.00 | Vph[mV]=1500.0 | pH=7.00",
             "pH - Voltaje: 2.000 V | pH: 7.76",
             "Oxígeno Disuelto - Voltaje: 1245.0 mV | DO: 10.44 mg/L",
             "Voltaje: 4.150 V | NTU: 27.5 -> Agua con presencia de partículas.",
             "Turbidez - Voltaje: 4.300 V | NTU: 0.5 → Agua limpia.",
             "Temperatura: -3.25 °C",
             "Raw analog: 123 | Voltage: 600.59 mV | Temp: 25.0 °C | EC: 1.23 ms/cm",
             "Raw analog: 1 | Voltage: 4.88 mV | Temp: 25.0 °C | EC: N/A (voltaje bajo)",
             "garbage"]
    df = spark.createDataFrame([(l_,) for l_ in lines], "value string")
    out = parse_sensor_lines(df).collect()
    kinds = [r.kind for r in out]
    assert kinds == ["ph_probe", "ph", "do", "turbidity", "turbidity", "temp", "ec", "ec", None]
    assert (out[0].temp_c, out[0].millivolts, out[0].ph) == (25.0, 1500.0, 7.0)
    assert (out[2].millivolts, out[2].do_mg_l) == (1245.0, 10.44)
    assert (out[3].volts, out[3].ntu, out[3].message) == (4.15, 27.5, "Agua con presencia de partículas.")
    assert out[5].temp_c == -3.25
    assert (out[6].raw, out[6].ec_ms_cm, out[7].ec_ms_cm) == (123, 1.23, None)
    assert all(v is None for k, v in out[8].asDict().items() if k not in ("line",))


def test_folder_of_dialects(spark, tmp_path):
    """One file of each kind; a Latin-1 file beside UTF-8 ones garbles none."""
    folder = tmp_path / "a folder [1]"
    (folder / "deep").mkdir(parents=True)
    head = ["pH", "Temperatura (°C)", "Clorofila (µg/L)", "Sitio"]
    (folder / "utf8.csv").write_bytes(("﻿" + ",".join(head) + '\r\n8.1,20.5,"1,378.84",Peñón\r\n').encode())
    (folder / "latin {x}.csv").write_bytes((";".join(head) + "\n8,2;21;40;Caño\n").encode("latin-1"))
    (folder / "deep" / "tab*.tsv").write_bytes(("\t".join(reversed(head)) + "\nBahía\t7\t22\t8.3\n").encode())
    (folder / "other.csv").write_bytes("pH;Turbidez (NTU)\n8.4;3\n".encode())
    (folder / "same.csv").write_bytes((";".join(head) + "\n8.5;23;2;Río\n").encode("latin-1"))
    (folder / "empty.csv").write_bytes(b"")
    (folder / "header only.csv").write_bytes((",".join(head) + "\n").encode())
    df = read_folder(spark, str(folder).replace("[", "\\[").replace("]", "\\]"))
    assert set(df.columns) == {"ph", "temp_c", "chl_ug_l", "sitio", "turb_ntu"}
    got = {r.ph: (r.temp_c, r.chl_ug_l, r.sitio, r.turb_ntu) for r in df.collect()}
    assert got == {"8.1": ("20.5", "1,378.84", "Peñón", None), "8,2": ("21", "40", "Caño", None), "8.3": ("22", "7", "Bahía", None),
                   "8.4": (None, None, None, "3"), "8.5": ("23", "2", "Río", None)}
    assert file_profiles(spark, str(folder).replace("[", "\\[").replace("]", "\\]")).count() == 6


def test_header_of_a_file_in_many_splits(spark, tmp_path):
    """The header comes from the split that starts the file."""
    rows = "".join(f"{k},{k / 7:.3f}\n" for k in range(20_000))
    (tmp_path / "one.csv").write_text("pH,Turbidez (NTU)\n" + rows)
    (tmp_path / "two.csv").write_text("Turbidez (NTU),pH\n" + rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        profiles = {r.header for r in file_profiles(spark, str(tmp_path)).collect()}
        df = read_folder(spark, str(tmp_path))
        assert profiles == {"pH,Turbidez (NTU)", "Turbidez (NTU),pH"} and df.count() == 40_000
        assert df.where("ph = turb_ntu").count() <= 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_folder_without_lines(spark, tmp_path):
    (tmp_path / "none.csv").write_text("")
    with pytest.raises(ValueError):
        read_folder(spark, str(tmp_path))
