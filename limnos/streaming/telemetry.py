"""Telemetry stream operators (G1-G5).

Each function maps a DataFrame of readings ``(ts TIMESTAMP, device, sensor,
raw INT, temp_c DOUBLE, ...)`` to a DataFrame and works unchanged on a
streaming DataFrame (``readStream``) and on its batch twin.  State is kept
by Spark's stateful aggregation with a watermark, so it is bounded by the
open windows and survives executor loss through the query checkpoint.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.functions import calibration as cal
from limnos.functions.fuzzy import DEFAULT_EPS, memberships
from limnos.operators import fuzzy_matrix as fm
from limnos.operators.ordered import numbered, rate_limited

# Sensor names of the five probes.
SENSORS = ("temp", "ph", "do", "turbidity", "ec")


def _session_tz(df: DataFrame) -> str:
    return df.sparkSession.conf.get("spark.sql.session.timeZone", "UTC")


def with_event_time(df: DataFrame, ts: str = "ts", delay: str | None = "1 hour") -> DataFrame:
    """``ts`` as TIMESTAMP (watermarks need it) plus the watermark when a
    delay is given.  A TIMESTAMP_NTZ input is read as UTC wall-clock time
    whatever the session time zone, so windows align the same everywhere."""
    if dict(df.dtypes).get(ts) == "timestamp_ntz":
        tz = _session_tz(df)
        col = F.col(ts) if tz == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col(ts))
        df = df.withColumn(ts, col.cast("timestamp"))
    return df.withWatermark(ts, delay) if delay else df


def utc_wall_clock(df: DataFrame, col: str) -> Column:
    """A TIMESTAMP column as UTC wall-clock TIMESTAMP_NTZ (for output)."""
    tz = _session_tz(df)
    c = F.col(col).cast("timestamp_ntz")
    return (c if tz == "UTC" else F.convert_timezone(F.lit(tz), F.lit("UTC"), c)).alias(col)


def calibrated_value(sensor: Column, raw: Column, temp_c: Column) -> Column:
    """Physical value of one reading, chosen by its sensor."""
    volts = cal.adc_to_volts(raw)
    mv = cal.adc_to_millivolts(raw)
    return (F.when(sensor == "temp", temp_c)
            .when(sensor == "ph", cal.calibrate_ph(volts))
            .when(sensor == "do", cal.calibrate_do(mv, temp_c))
            .when(sensor == "turbidity", cal.calibrate_turbidity(volts))
            .when(sensor == "ec", cal.low_voltage_gate(mv)))


def downsample(df: DataFrame, every: str = "1 second", ts: str = "ts") -> DataFrame:
    """At most one reading per device, sensor and ``every``: the first one, of
    simultaneous ones the lowest."""
    g = df.groupBy(F.window(ts, every).alias("w"), "device", "sensor")
    return g.agg(F.min_by("raw", F.struct(ts, "raw")).alias("raw"), F.min(ts).alias("first_ts")) \
        .select(F.col("w.start").alias("window_start"), "device", "sensor", "raw", "first_ts")


def burst_average(df: DataFrame, every: str = "10 seconds", ts: str = "ts") -> DataFrame:
    """Mean raw count per burst window, then the averaged-burst conversion
    (5000/1023 mV) and, for the pH probe, the pH of that voltage."""
    g = df.groupBy(F.window(ts, every).alias("w"), "device", "sensor")
    agg = g.agg(F.count(F.lit(1)).alias("n"), F.avg("raw").alias("raw_avg"))
    mv = cal.adc_avg_to_millivolts(F.col("raw_avg"))
    return agg.select(F.col("w.start").alias("window_start"), "device", "sensor", "n", "raw_avg",
                      mv.alias("millivolts"), F.when(F.col("sensor") == "ph", cal.calibrate_ph(mv / 1000.0)).alias("ph"))


# ---------------------------------------------------------------- rate limit and bursts
PROBE = ("device", "sensor")
#: Fixed value: samples of a burst.
BURST = 10


def _micros(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("_us", F.unix_micros(ts))


def rate_limit(df: DataFrame, every_ms: int = 1000, keys: Sequence[str] = PROBE, ts: str = "ts") -> DataFrame:
    """(keys, ts, raw) of the readings that each probe accepts: the first one,
    then always the first that is ``every_ms`` or more after the last accepted
    one; of simultaneous ones the lowest, null last.  Readings without a time
    are never accepted.  The batch form; a probe of any size is split."""
    rows = _micros(with_event_time(df, ts, None), ts).select(*keys, ts, "raw", "_us", F.coalesce("raw", F.lit(2**31 - 1)).alias("_tie"))
    return rate_limited(rows, keys, "_us", every_ms * 1000, ["_tie"]).select(*keys, ts, "raw")


def _key_fields(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def _in_order(frames) -> pd.DataFrame:
    """One probe's readings of a micro-batch by time, then count."""
    part = pd.concat(list(frames), ignore_index=True)
    return part[part["_us"].notna()].sort_values(["_us", "raw"], kind="stable", na_position="last")


def _counts_in_order(frames) -> np.ndarray:
    """Counts of one probe's readings (none null) by time, then count: probes
    are many and their readings few, so this goes without pandas' indexes."""
    frames = list(frames)
    us, raw = (np.concatenate([f[c].to_numpy(np.int64) for f in frames]) for c in ("_us", "raw"))
    return raw[np.lexsort((raw, us))]


def rate_limit_stream(df: DataFrame, every_ms: int = 1000, keys: Sequence[str] = PROBE, ts: str = "ts") -> DataFrame:
    """:func:`rate_limit` on a stream: (keys, us, raw, late), us being the time in
    microseconds since 1970.

    Each probe's state is the time of its last accepted reading, which outlives
    a restart with the checkpoint.  A reading that comes in a later micro-batch
    although it is older than the last accepted one can't be placed any more:
    it is handed on with ``late`` true instead of being lost.  Without such
    readings the others are those of the batch form."""
    limit = every_ms * 1000
    rows = _micros(df, ts).select(*keys, "_us", F.col("raw").cast("double").alias("raw"))

    def accept(key, frames, state):
        part = _in_order(frames)
        last = state.get[0] if state.exists else None
        t, raw = part["_us"].to_numpy(np.int64), part["raw"].to_numpy(float)
        before = 0 if last is None else int(np.searchsorted(t, last))  # older than the last accepted one
        take, k = list(range(before)), before
        while k < len(t):
            if last is not None:
                k = int(np.searchsorted(t, last + limit))
                if k >= len(t):
                    break
            take.append(k)
            last = int(t[k])
            k += 1
        if last is not None:
            state.update((last,))
        out = pd.DataFrame({"us": t[take], "raw": raw[take], "late": [k < before for k in range(len(take))]})
        for name, value in zip(keys, key):
            out[name] = value
        yield out[[*keys, "us", "raw", "late"]]

    return rows.groupBy(*keys).applyInPandasWithState(
        accept, f"{_key_fields(df, keys)}, us long, raw double, late boolean", "last long", "append", "NoTimeout")


def _burst_columns(n: Column, total: Column, size: int) -> list[Column]:
    mean = total / n
    mv = cal.adc_avg_to_millivolts(mean)
    return [n.alias("n"), (n == size).alias("complete"), mean.alias("raw_avg"), mv.alias("millivolts"),
            F.when(F.col("sensor") == "ph", cal.calibrate_ph(mv / 1000.0)).alias("ph")]


def bursts(df: DataFrame, size: int = BURST, keys: Sequence[str] = PROBE, ts: str = "ts") -> DataFrame:
    """Means over bursts of ``size`` consecutive samples of a probe (by time, then
    count): keys (``sensor`` among them), burst (from 0), n, complete, raw_avg,
    millivolts (averaged-burst conversion) and, for the pH probe, the pH.

    The last burst of a probe may be unfinished; it is reported with
    ``complete`` false.  Samples without a time or a count are no samples.  The
    batch form: places come from shard offsets, so a probe of any size is split."""
    rows = _micros(with_event_time(df, ts, None), ts).where("_us IS NOT NULL AND raw IS NOT NULL").select(*keys, "_us", "raw")
    placed = numbered(rows, keys, [F.col("_us"), F.col("raw")], "_pos")
    groups = placed.groupBy(*keys, F.floor((F.col("_pos") - 1) / size).cast("long").alias("burst")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("raw").alias("_total"))
    return groups.select(*keys, "burst", *_burst_columns(F.col("_n"), F.col("_total"), size))


def bursts_stream(df: DataFrame, size: int = BURST, keys: Sequence[str] = PROBE, ts: str = "ts") -> DataFrame:
    """:func:`bursts` on a stream, in update mode: every micro-batch hands on the
    bursts that it filled or began, so the last row of (keys, burst) holds.

    A probe's state is its open burst (number, samples, sum).  Samples are taken
    in the order of the micro-batches and by time within one."""
    rows = _micros(df, ts).where("_us IS NOT NULL AND raw IS NOT NULL").select(*keys, "_us", "raw")

    def fill(key, frames, state):
        raw = _counts_in_order(frames)
        burst, n, total = state.get if state.exists else (0, 0, 0)
        place = burst * size + n + np.arange(len(raw))
        numbers, first = np.unique(place // size, return_index=True)
        sums = np.add.reduceat(raw, first) if len(raw) else raw
        counts = np.diff(np.append(first, len(raw)))
        if len(numbers) and numbers[0] == burst:
            sums[0] += total
            counts[0] += n
        if len(numbers):
            full = counts[-1] == size
            state.update((int(numbers[-1]) + int(full), 0 if full else int(counts[-1]), 0 if full else int(sums[-1])))
        # built with its keys at once: a column set on a finished frame costs more than all the rest
        own = {name: np.full(len(numbers), value, object if value is None or isinstance(value, str) else None) for name, value in zip(keys, key)}
        yield pd.DataFrame(own | {"burst": numbers, "_n": counts, "_total": sums})

    filled = rows.groupBy(*keys).applyInPandasWithState(
        fill, f"{_key_fields(df, keys)}, burst long, _n long, _total long", "burst long, n long, total long", "update", "NoTimeout")
    return filled.select(*keys, "burst", *_burst_columns(F.col("_n"), F.col("_total"), size))


def assemble_ticks(df: DataFrame, every: str = "1 second", ts: str = "ts",
                   sensors=SENSORS) -> DataFrame:
    """One record per device and tick with a column per sensor (conditional
    aggregates — no pivot pass, works on streams)."""
    value = calibrated_value(F.col("sensor"), F.col("raw"), F.col("temp_c"))
    g = df.withColumn("_v", value).groupBy(F.window(ts, every).alias("w"), "device")
    agg = g.agg(F.count(F.lit(1)).alias("n"),
                *[F.max(F.when(F.col("sensor") == s, F.col("_v"))).alias(s) for s in sensors])
    return agg.select(F.col("w.start").alias("window_start"), "device", "n", *sensors)


def stream_score(df: DataFrame, chl: str = "chl_ug_l", eps=DEFAULT_EPS) -> DataFrame:
    """Stateless live scoring: calibrated value and class memberships."""
    ms = memberships(F.col(chl), eps)
    return df.select("*", calibrated_value(F.col("sensor"), F.col("raw"), F.col("temp_c")).alias("calibrated"),
                     *[m.alias(f"m{i}") for i, m in enumerate(ms)])


def stream_fuzzy_confusion(df: DataFrame, truth: str, pred: str, every: str = "1 day",
                           ts: str = "ts", eps=DEFAULT_EPS) -> DataFrame:
    """Fuzzy confusion matrix per event-time window (16 sums per window)."""
    # group by the window struct itself: it carries the event-time watermark
    w = df.withColumn("_w", F.window(ts, every))
    m = fm.fuzzy_confusion(w, truth, pred=pred, eps=eps, group_cols=["_w"])
    return m.select(F.col("_w.start").alias("window_start"), "true_idx", "pred_idx", "weight")
