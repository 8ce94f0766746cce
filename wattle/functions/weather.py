"""Meteorological derived columns, all as native expressions (no row loop)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's formulas.
# Magnus form used for relative humidity: a = 17.625, b = 243.04 (deg C).
MAGNUS_A = 17.625
MAGNUS_B = 243.04
# Base-10 vapour-pressure form: 6.11 * 10^(7.5 * t / (237.7 + t)).
BASE10_E0 = 6.11
BASE10_A = 7.5
BASE10_B = 237.7
# US National Weather Service wind chill (deg F, mph):
#   35.74 + 0.6215 T - 35.75 V^0.16 + 0.4275 T V^0.16, for T <= 50 F and V > 3 mph.
WIND_CHILL = (35.74, 0.6215, 35.75, 0.4275, 0.16)
# NWS heat index: simple form 0.5 * (T + 61 + (T - 68) * 1.2 + RH * 0.094); when that
# is >= 80 F the Rothfusz regression with coefficients c1..c9 below, then the
# low-humidity (RH < 13, 80 <= T <= 112) and high-humidity (RH > 85, T <= 87) adjustments.
ROTHFUSZ = (-42.379, 2.04901523, 10.14333127, -0.22475541, -6.83783e-3,
            -5.481717e-2, 1.22874e-3, 8.5282e-4, -1.99e-6)


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def humidity_magnus(air_c, dew_c) -> Column:
    """Relative humidity (%) from air and dew temperature in deg C, Magnus form."""
    t, d = _c(air_c), _c(dew_c)
    return (F.lit(100.0) * F.exp(F.lit(MAGNUS_A) * d / (F.lit(MAGNUS_B) + d))
            / F.exp(F.lit(MAGNUS_A) * t / (F.lit(MAGNUS_B) + t)))


def humidity_base10(air_c, dew_c) -> Column:
    """Relative humidity (%) as the ratio of base-10 vapour pressures at dew and air."""
    t, d = _c(air_c), _c(dew_c)
    e = F.lit(BASE10_E0) * F.pow(F.lit(10.0), F.lit(BASE10_A) * d / (F.lit(BASE10_B) + d))
    es = F.lit(BASE10_E0) * F.pow(F.lit(10.0), F.lit(BASE10_A) * t / (F.lit(BASE10_B) + t))
    return e / es * F.lit(100.0)


def heat_index_f(t_f: Column, rh: Column) -> Column:
    simple = F.lit(0.5) * (t_f + F.lit(61.0) + (t_f - F.lit(68.0)) * F.lit(1.2) + rh * F.lit(0.094))
    c1, c2, c3, c4, c5, c6, c7, c8, c9 = (F.lit(v) for v in ROTHFUSZ)
    t2, r2 = t_f * t_f, rh * rh
    full = (c1 + c2 * t_f + c3 * rh + c4 * t_f * rh + c5 * t2 + c6 * r2
            + c7 * t2 * rh + c8 * t_f * r2 + c9 * t2 * r2)
    low = (F.lit(13.0) - rh) / F.lit(4.0) * F.sqrt((F.lit(17.0) - F.abs(t_f - F.lit(95.0))) / F.lit(17.0))
    high = (rh - F.lit(85.0)) / F.lit(10.0) * ((F.lit(87.0) - t_f) / F.lit(5.0))
    adjusted = (F.when((rh < 13) & (t_f <= 112), full - low)
                .when((rh > 85) & (t_f <= 87), full + high)
                .otherwise(full))
    return F.when(simple >= 80, adjusted).otherwise(simple)


def feels_like(air_c, rh, wind, wind_to_mph: float = 1.0) -> Column:
    """Apparent temperature in deg F from air temperature (deg C), relative
    humidity (%) and wind speed.

    Wind chill when T <= 50 F and V > 3, heat index when T >= 80 F, else T.
    ``wind_to_mph`` converts the wind column; the reference passes its wind
    unconverted (factor 1).  Comparisons with NULL are false, as in the
    reference: NULL wind at T <= 50 F returns T, NULL humidity at T >= 80 F
    returns NULL, NULL temperature returns NULL.
    """
    t_f = _c(air_c) * F.lit(9.0 / 5.0) + F.lit(32.0)
    v = _c(wind) * F.lit(float(wind_to_mph))
    a, b, c, d, p = WIND_CHILL
    vp = F.pow(v, F.lit(p))
    chill = F.lit(a) + F.lit(b) * t_f - F.lit(c) * vp + F.lit(d) * t_f * vp
    return (F.when((t_f <= 50) & (v > 3), chill)
            .when(t_f >= 80, heat_index_f(t_f, _c(rh)))
            .otherwise(t_f))
