"""Sensor-log source (A5): the probes' serial text lines -> typed readings.

Lines are read with the text source (``spark.read.text`` or
``spark.readStream.text``) and parsed with ``regexp_extract`` + ``try_cast``
— JVM-side, no Python per line.  A line that matches no format keeps
``kind = null`` and null fields rather than being dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NUM = r"(-?[0-9]+(?:\.[0-9]+)?)"
# The line formats printed by the probe firmware.
LINE_FORMATS = {
    "ph_probe": rf"^T\[°C\]={_NUM} \| Vph\[mV\]={_NUM} \| pH={_NUM}$",
    "ph": rf"^pH - Voltaje: {_NUM} V \| pH: {_NUM}$",
    "do": rf"^Oxígeno Disuelto - Voltaje: {_NUM} mV \| DO: {_NUM} mg/L$",
    "do_probe": rf"^Temperatura: {_NUM} °C\tVoltaje: {_NUM} mV\tOxígeno disuelto: {_NUM} mg/L$",
    "error": r"^Error: (.*)$",
    "turbidity": rf"^(?:Turbidez - )?Voltaje: {_NUM} V \| NTU: {_NUM} (?:->|→) (.*)$",
    "temp": rf"^Temperatura: {_NUM} °C$",
    "ec": rf"^Raw analog: ([0-9]+) \| Voltage: {_NUM} mV \| Temp: {_NUM} °C(?: \| EC: (?:{_NUM} ms/cm|N/A.*))?$",
}
# field name -> (format, capture group)
FIELDS = {
    "temp_c": [("ph_probe", 1), ("temp", 1), ("ec", 3), ("do_probe", 1)],
    "millivolts": [("ph_probe", 2), ("do", 1), ("ec", 2), ("do_probe", 2)],
    "volts": [("ph", 1), ("turbidity", 1)],
    "ph": [("ph_probe", 3), ("ph", 2)],
    "do_mg_l": [("do", 2), ("do_probe", 3)],
    "ntu": [("turbidity", 2)],
    "ec_ms_cm": [("ec", 4)],
    "raw": [("ec", 1)],
}


def _kind(line: Column) -> Column:
    k = None
    for name, pat in LINE_FORMATS.items():
        k = (F.when(line.rlike(pat), F.lit(name)) if k is None
             else k.when(line.rlike(pat), F.lit(name)))
    return k


def parse_sensor_lines(df: DataFrame, line: str = "value") -> DataFrame:
    """Text lines -> (kind, temp_c, millivolts, volts, ph, do_mg_l, ntu,
    ec_ms_cm, raw, message, line).  Works on batch and streaming frames."""
    staged = df.select(F.col(line).alias("line")).withColumn("kind", _kind(F.col("line")))
    fields = {}
    for field, sources in FIELDS.items():
        e = None
        for fmt, grp in sources:
            val = F.regexp_extract("line", LINE_FORMATS[fmt], grp).try_cast("double")
            e = (F.when(F.col("kind") == fmt, val) if e is None
                 else e.when(F.col("kind") == fmt, val))
        fields[field] = e
    fields["raw"] = fields["raw"].cast("int")
    fields["message"] = (F.when(F.col("kind") == "turbidity", F.regexp_extract("line", LINE_FORMATS["turbidity"], 3))
                         .when(F.col("kind") == "error", F.regexp_extract("line", LINE_FORMATS["error"], 1)))
    return staged.select("kind", *[v.alias(k) for k, v in fields.items()], "line")


def read_sensor_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_sensor_lines(spark.read.text(path))
