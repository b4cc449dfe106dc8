"""Probe calibrations as column expressions (ADC counts -> physical values).

Each function is a pure arithmetic / ``CASE`` expression so telemetry tables
and streams are calibrated inside whole-stage codegen, row-parallel.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Probe constants.
ADC_LEVELS = 1024          # 10-bit converter, divisor of the single reads
ADC_LEVELS_AVG = 1023      # divisor of the averaged pH burst
VREF_V = 5.0
VREF_MV = 5000.0
PH_SLOPE = 9.836           # pH = slope * V + intercept
PH_INTERCEPT = -11.91
DO_CAL_MV = 1245.0         # one-point dissolved-oxygen calibration voltage
# Dissolved oxygen at 100 % saturation (mg/L), 0..40 °C by 1 °C.
DO_SATURATION = (
    14.46, 14.22, 13.99, 13.77, 13.56, 13.36, 13.17, 12.98, 12.80, 12.63,
    12.46, 12.30, 12.14, 11.99, 11.84, 11.69, 11.55, 11.41, 11.28, 11.15,
    11.02, 10.90, 10.78, 10.66, 10.55, 10.44, 10.33, 10.22, 10.12, 10.02,
    9.92, 9.82, 9.73, 9.63, 9.54, 9.45, 9.37, 9.28, 9.20, 9.12, 9.04,
)
# Turbidity calibration points (volts, NTU), clean to turbid.
TURB_CLEAN_V, TURB_CLEAN_NTU = 4.21, 0.5
TURB_MID_V, TURB_MID_NTU = 4.10, 50.0
TURB_DIRTY_V, TURB_DIRTY_NTU = 3.27, 500.0
# Turbidity class messages, clean to out of range.
TURBIDITY_CLASSES = ("Agua limpia.", "Agua con partículas.", "Agua muy turbia.",
                     "Fuera del rango calibrado.")
# The messages of the stand-alone turbidity probe, same order.
TURBIDITY_PROBE_CLASSES = ("Agua limpia (muy pocas partículas).", "Agua con presencia de partículas.",
                           "Agua con muchas partículas.", "Lectura fuera del rango calibrado.")
# Temperature validity windows (°C) and the pH fallback.
EC_T_MIN, EC_T_MAX = -50.0, 125.0
PH_T_MIN, PH_T_MAX, PH_T_DEFAULT = -55.0, 125.0, 25.0
EC_MIN_MV = 5.0


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def adc_to_volts(raw) -> Column:
    """raw * 5 / 1024 (volts)."""
    return _c(raw).cast("double") * F.lit(VREF_V / ADC_LEVELS)


def adc_to_millivolts(raw) -> Column:
    """raw * 5000 / 1024 (millivolts)."""
    return _c(raw).cast("double") * F.lit(VREF_MV / ADC_LEVELS)


def adc_avg_to_millivolts(raw_avg) -> Column:
    """Averaged raw * 5000 / 1023 (millivolts; the pH burst convention)."""
    return _c(raw_avg).cast("double") * F.lit(VREF_MV / ADC_LEVELS_AVG)


def calibrate_ph(volts) -> Column:
    return F.lit(PH_SLOPE) * _c(volts) + F.lit(PH_INTERCEPT)


def do_table_index(temp_c) -> Column:
    """int(T) truncated toward zero, clamped to 0..40; null without a temperature."""
    t = _c(temp_c).try_cast("int")
    return F.when(t.isNotNull(), F.least(F.greatest(t, F.lit(0)), F.lit(len(DO_SATURATION) - 1)))


def calibrate_do(millivolts, temp_c) -> Column:
    """(mV / 1245) * saturation[clamp(int(T), 0, 40)] in mg/L."""
    table = F.array(*[F.lit(v) for v in DO_SATURATION])
    return (_c(millivolts) / F.lit(DO_CAL_MV)) * F.get(table, do_table_index(temp_c))


def calibrate_turbidity(volts) -> Column:
    """Piecewise-linear NTU through the three calibration points, clamped."""
    v = _c(volts)
    m_hi = (TURB_MID_NTU - TURB_CLEAN_NTU) / (TURB_MID_V - TURB_CLEAN_V)
    b_hi = TURB_CLEAN_NTU - m_hi * TURB_CLEAN_V
    m_lo = (TURB_DIRTY_NTU - TURB_MID_NTU) / (TURB_DIRTY_V - TURB_MID_V)
    b_lo = TURB_MID_NTU - m_lo * TURB_MID_V
    return (F.when(v >= TURB_CLEAN_V, F.lit(TURB_CLEAN_NTU))
            .when(v <= TURB_DIRTY_V, F.lit(TURB_DIRTY_NTU))
            .when(v > TURB_MID_V, F.lit(m_hi) * v + F.lit(b_hi))
            .otherwise(F.lit(m_lo) * v + F.lit(b_lo)))


def turbidity_class_index(volts) -> Column:
    """0 clean, 1 particles, 2 very turbid, 3 outside the calibrated range."""
    v = _c(volts)
    return (F.when(v >= TURB_CLEAN_V, 0).when(v >= TURB_MID_V, 1)
            .when(v >= TURB_DIRTY_V, 2).when(v.isNotNull(), 3))


def turbidity_class(volts, messages=TURBIDITY_CLASSES) -> Column:
    """Message of a voltage's class; null without a voltage."""
    return F.get(F.array(*[F.lit(s) for s in messages]), turbidity_class_index(volts))


def ec_temperature_ok(temp_c) -> Column:
    """Conductivity ticks are rejected for T<-50, T>125 or NaN/null."""
    t = _c(temp_c)
    return t.isNotNull() & ~F.isnan(t) & (t >= EC_T_MIN) & (t <= EC_T_MAX)


def ph_temperature(temp_c) -> Column:
    """pH compensation temperature: T when -55<T<125, else 25 °C."""
    t = _c(temp_c)
    return F.when((t > PH_T_MIN) & (t < PH_T_MAX), t).otherwise(F.lit(PH_T_DEFAULT))


def low_voltage_gate(millivolts) -> Column:
    """Conductivity voltage kept only above 5 mV, else null (N/A)."""
    mv = _c(millivolts)
    return F.when(mv > EC_MIN_MV, mv)
