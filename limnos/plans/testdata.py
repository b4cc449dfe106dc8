"""Adapters from the driver's tables to water-quality shaped inputs.

Each adapter has a Spark form (a DataFrame built from the table, so its cost
grows with the table) and the SQL text of the same derivation for oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Non-numeric cells mixed into the text columns.
JUNK_CELLS = ["nr", "ND", "-", "", "na", "1d", "1,2,3"]
N_VARIANTS = 7
SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ------------------------------------------------------------------ number text
def fmt_cents(cents: Column, variant: Column, junk: Column) -> Column:
    """Render integer cents as text in one of seven spreadsheet styles:
    plain, decimal comma, thousands comma, European, NBSP grouping,
    junk token, padded with exponent."""
    ip = F.floor(cents / 100).cast("long")
    fp = F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0")
    hi = F.floor(ip / 1000).cast("long").cast("string")
    lo = F.lpad(F.pmod(ip, F.lit(1000)).cast("string"), 3, "0")
    ips = ip.cast("string")
    junk_txt = F.element_at(F.array(*[F.lit(j) for j in JUNK_CELLS]), (junk + 1).cast("int"))
    return (F.when(variant == 0, F.concat(ips, F.lit("."), fp))
            .when(variant == 1, F.concat(ips, F.lit(","), fp))
            .when(variant == 2, F.concat(hi, F.lit(","), lo, F.lit("."), fp))
            .when(variant == 3, F.concat(hi, F.lit("."), lo, F.lit(","), fp))
            .when(variant == 4, F.concat(hi, F.lit(" "), lo, F.lit("."), fp))
            .when(variant == 5, junk_txt)
            .otherwise(F.concat(F.lit("  "), ips, F.lit("."), fp, F.lit("e0 "))))


def fmt_cents_sql(cents: str, variant: str, junk: str) -> str:
    ip = f"(({cents}) // 100)"
    fp = f"lpad(CAST(({cents}) % 100 AS VARCHAR), 2, '0')"
    hi = f"CAST({ip} // 1000 AS VARCHAR)"
    lo = f"lpad(CAST({ip} % 1000 AS VARCHAR), 3, '0')"
    ips = f"CAST({ip} AS VARCHAR)"
    junk_list = "[" + ", ".join("'" + j.replace("'", "''") + "'" for j in JUNK_CELLS) + "]"
    return (f"(CASE WHEN {variant} = 0 THEN concat({ips}, '.', {fp}) "
            f"WHEN {variant} = 1 THEN concat({ips}, ',', {fp}) "
            f"WHEN {variant} = 2 THEN concat({hi}, ',', {lo}, '.', {fp}) "
            f"WHEN {variant} = 3 THEN concat({hi}, '.', {lo}, ',', {fp}) "
            f"WHEN {variant} = 4 THEN concat({hi}, chr(160), {lo}, '.', {fp}) "
            f"WHEN {variant} = 5 THEN {junk_list}[({junk}) + 1] "
            f"ELSE concat('  ', {ips}, '.', {fp}, 'e0 ') END)")


# Header text of the lake-style frame and the integer-cents source of each
# numeric column (Spark expression, SQL expression), with a variant offset.
LAKE_HEADERS = ["ID", "Sitio ", "Fecha", "pH", "Temperatura (°C)", "Conductividad (mS/cm)",
                "Oxígeno Disuelto (mg/l)", "Turbiedad NTU", "Clorofila (µg/L)"]
_PRICE_CENTS = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT)"
LAKE_NUMERIC = [
    # header, canonical, spark cents, sql cents, variant offset
    ("pH", "ph", lambda: F.pmod(F.col("o_custkey") * 7, F.lit(1400)), "((o_custkey * 7) % 1400)", 0),
    ("Temperatura (°C)", "temp_c", lambda: F.pmod(F.col("o_orderkey"), F.lit(1000)) + 2000,
     "((o_orderkey % 1000) + 2000)", 1),
    ("Conductividad (mS/cm)", "cond_ms_cm", lambda: F.pmod(F.col("o_custkey"), F.lit(100)) + 1,
     "((o_custkey % 100) + 1)", 2),
    ("Oxígeno Disuelto (mg/l)", "do_mg_l", lambda: F.pmod(F.col("o_orderkey") * 13, F.lit(1500)),
     "((o_orderkey * 13) % 1500)", 3),
    ("Turbiedad NTU", "turb_ntu", lambda: F.pmod(F.expr(_PRICE_CENTS), F.lit(100000)),
     f"({_PRICE_CENTS} % 100000)", 4),
    ("Clorofila (µg/L)", "chl_ug_l", lambda: F.expr(_PRICE_CENTS), f"({_PRICE_CENTS})", 5),
]


def lake_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` rendered as a messy lake survey: raw headers, text cells."""
    from limnos.session import deal
    o = deal(table(spark, sf_dir, "orders"), "o_orderkey")
    junk = F.pmod(F.floor(F.col("o_orderkey") / N_VARIANTS).cast("long"), F.lit(len(JUNK_CELLS)))
    cols = [F.col("o_orderkey").cast("string").alias("ID"),
            F.col("o_orderpriority").alias("Sitio "),
            F.col("o_orderdate").cast("date").cast("string").alias("Fecha")]
    for header, _, cents, _, off in LAKE_NUMERIC:
        variant = F.pmod(F.col("o_orderkey") + off, F.lit(N_VARIANTS))
        cols.append(fmt_cents(cents(), variant, junk).alias(header))
    return o.select(*cols)


def lake_text_sql() -> str:
    """Canonically named text columns of ``lake_frame`` (SQL)."""
    junk = f"((o_orderkey // {N_VARIANTS}) % {len(JUNK_CELLS)})"
    cols = ["CAST(o_orderkey AS VARCHAR) AS \"ID\"", "o_orderpriority AS sitio",
            "CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS fecha"]
    for _, canon, _, cents_sql, off in LAKE_NUMERIC:
        cols.append(f"{fmt_cents_sql(cents_sql, f'((o_orderkey + {off}) % {N_VARIANTS})', junk)} AS {canon}")
    return f"(SELECT o_orderkey, {', '.join(cols)} FROM orders)"


# ------------------------------------------------------------------ parse rule in SQL
_WS = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NUMERIC_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_sql(x: str, tokens: bool = True) -> str:
    s0 = f"replace(CAST({x} AS VARCHAR), chr(160), '')"
    s1 = f"regexp_replace({s0}, '^{_WS}+|{_WS}+$', '', 'g')"
    s2 = f"replace({s1}, ' ', '')"
    s3 = (f"(CASE WHEN contains({s2}, ',') AND contains({s2}, '.') THEN replace({s2}, ',', '') "
          f"WHEN contains({s2}, ',') THEN replace({s2}, ',', '.') ELSE {s2} END)")
    v = f"(CASE WHEN regexp_matches({s3}, '{NUMERIC_RE}') THEN TRY_CAST({s3} AS DOUBLE) END)"
    if tokens:
        tok = null_token_sql(x)
        v = f"(CASE WHEN {tok} IS NULL THEN NULL ELSE {v} END)"
    return v


def null_token_sql(x: str) -> str:
    from limnos.functions.numbers import NULL_TOKENS
    lst = ", ".join("'" + t + "'" for t in NULL_TOKENS)
    trimmed = f"lower(trim({x}))"
    return f"(CASE WHEN {trimmed} IN ({lst}) THEN NULL ELSE {x} END)"


# ------------------------------------------------------------------ events as concentrations
def events_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with a deterministic continuous prediction ``pred``."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return ev.withColumn("pred", F.col("value") * ((F.pmod("event_id", F.lit(5)) + 8).cast("double") / 10))


EV_PRED_SQL = ("(SELECT event_id, event_type, value, "
               "value * (CAST((event_id % 5) + 8 AS DOUBLE) / 10) AS pred FROM events)")


def model_scores(eid: Column) -> dict[int, Column]:
    """Scores of a model that knows classes 0, 2, 3 only (class 1 absent)."""
    return {0: F.pmod(eid, F.lit(4)).cast("double"),
            2: F.pmod(eid * 3, F.lit(5)).cast("double"),
            3: F.pmod(eid, F.lit(2)).cast("double")}


MODEL_SCORES_SQL = {0: "CAST(event_id % 4 AS DOUBLE)", 2: "CAST((event_id * 3) % 5 AS DOUBLE)",
                    3: "CAST(event_id % 2 AS DOUBLE)"}


def aligned_sql(prefix: str = "p") -> str:
    """SQL select list of the four aligned probabilities."""
    cols = [MODEL_SCORES_SQL.get(k, "0.0") for k in range(4)]
    s = " + ".join(f"({c})" for c in cols)
    return ", ".join(f"(CASE WHEN ({s}) > 0 THEN ({c}) / ({s}) ELSE ({c}) END) AS {prefix}{k}"
                     for k, c in enumerate(cols))


# ------------------------------------------------------------------ events as telemetry
# Which probe each event type plays.
SENSOR_OF_EVENT = {"view": "temp", "click": "ph", "signup": "do", "purchase": "turbidity", "error": "ec"}


def telemetry_of(ev: DataFrame) -> DataFrame:
    """events as probe readings: 10-bit raw count, a temperature, the value
    kept as a chlorophyll reading; works on batch and streaming frames."""
    sensor = F.element_at(F.create_map(*[F.lit(x) for kv in SENSOR_OF_EVENT.items() for x in kv]),
                          F.col("event_type"))
    return ev.select("event_id", "ts", F.col("user_id").alias("device"), sensor.alias("sensor"),
                     F.pmod((F.col("value") * 100).cast("int"), F.lit(1024)).alias("raw"),
                     (F.pmod(F.col("event_id"), F.lit(200)) - 70).cast("double").alias("temp_c"),
                     F.col("value").alias("chl_ug_l"),
                     (F.col("value") * ((F.pmod("event_id", F.lit(5)) + 8).cast("double") / 10)).alias("pred"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_of(table(spark, sf_dir, "events"))


_SENSOR_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SENSOR_OF_EVENT.items()) + " END"
TELEMETRY_SQL = ("(SELECT event_id, ts, user_id AS device, " + _SENSOR_SQL + " AS sensor, "
                 "CAST(CAST(trunc(value * 100) AS INTEGER) % 1024 AS INTEGER) AS raw, "
                 "CAST((event_id % 200) - 70 AS DOUBLE) AS temp_c, value AS chl_ug_l, "
                 "value * (CAST((event_id % 5) + 8 AS DOUBLE) / 10) AS pred FROM events)")
