"""Scalar column expressions: finiteness, thresholds, masks, palettes and random variates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SHAPE_MASK = 3
S0_BIT, FA_BIT, SIGNAL_BIT, HISTOGRAM_BIT = 4, 8, 16, 32


def is_infinite(c: Column) -> Column:
    return F.abs(c) == float("inf")


def is_number(c: Column) -> Column:
    return ~F.isnan(c) & ~is_infinite(c)


# The parts of an IEEE 754 number's bits.
EXPONENT64, FRACTION64, QUIET64 = 0x7FF0000000000000, 0x000FFFFFFFFFFFFF, 0x0008000000000000
EXPONENT32, FRACTION32, QUIET32 = 0x7F800000, 0x007FFFFF, 0x00400000


def nan_kind(bits: Column, wide: bool = True) -> Column:
    """struct(number, infinite, signalling, quiet) of a float64 (or float32) given as its bits in an integer.

    Only bits tell the two kinds of NaN apart: engines are free to change them in a floating-point column.
    """
    e, f, q = (EXPONENT64, FRACTION64, QUIET64) if wide else (EXPONENT32, FRACTION32, QUIET32)
    at = lambda mask: bits.cast("bigint").bitwiseAND(F.lit(mask).cast("bigint"))
    special, fraction, quiet = at(e) == F.lit(e), at(f) != 0, at(q) != 0
    return F.struct((~special).alias("number"), (special & ~fraction).alias("infinite"), (special & fraction & ~quiet).alias("signalling"), (special & quiet).alias("quiet"))


def threshold(c: Column, t) -> Column:
    """1 where c is above t, else 0."""
    return (c > t).cast("int")


def voxel_mask(shape: Column, s0: Column, fa: Column, signal: Column, s0_over: float, fa_over: float, signal_under: float, fa_peak) -> Column:
    """Shape code in the low two bits, then one bit for each test that holds; signal_under <= 0 lets all pass."""
    flag = lambda test, bit: F.when(test, bit).otherwise(0)
    low = F.when(shape > 0, shape).otherwise(0).cast("int")
    tests = flag(s0 > s0_over, S0_BIT) + flag(fa > fa_over, FA_BIT) + flag((F.lit(signal_under) <= 0) | (signal < signal_under), SIGNAL_BIT) + flag(fa >= fa_peak, HISTOGRAM_BIT)
    return low.bitwiseOR(tests)


def coherence_class(lci: Column) -> Column:
    """0 for no number, 1 below 25, else 2."""
    return F.when(lci.isNull() | ~is_number(lci), 0).when(lci < 25, 1).otherwise(2)


def weibull(u: Column, alpha: float, beta: float, gamma: float) -> Column:
    """Weibull variate of a uniform one."""
    return F.lit(alpha) + F.lit(beta) * F.pow(-F.log(1 - u), F.lit(1 / gamma))


def rician(nu: Column, sigma: float, seed: int = 0) -> Column:
    a, b = nu + sigma * F.randn(seed), sigma * F.randn(seed + 1)
    return F.sqrt(a * a + b * b)


def uniform(low: float, high: float, seed: int = 0) -> Column:
    return low + (high - low) * F.rand(seed)


def gaussian(mean: float, sigma: float, seed: int = 0) -> Column:
    return mean + sigma * F.randn(seed)


def _steps(x: Column, *parts: Column) -> Column:
    """One value for each quarter of a byte's range."""
    return F.when(x < 64, parts[0]).when(x < 128, parts[1]).when(x < 192, parts[2]).otherwise(parts[3]).cast("int")


def _part(x: Column, low: int, over: int) -> Column:
    return F.floor((x - low) * 255 / over)


def circular_palette(x: Column) -> Column:
    """struct(r, g, b) of a byte: red, green, cyan, blue and back to red over the four quarters."""
    x = x.cast("int")
    full, none = F.lit(255), F.lit(0)
    red = _steps(x, 255 - _part(x, 0, 63), _part(x, 63, 64), 255 - _part(x, 127, 64), _part(x, 191, 64))
    green = _steps(x, _part(x, 0, 63), full, 255 - _part(x, 127, 64), none)
    blue = _steps(x, none, _part(x, 63, 64), full, 255 - _part(x, 191, 64))
    return F.struct(red.alias("r"), green.alias("g"), blue.alias("b"))


def angle_palette(y: Column, x: Column) -> Column:
    """The palette at twice the angle of (x, y), so that opposite directions share a colour; the byte goes round past its ends."""
    turn = (2 * F.atan2(y, x) + math.pi) / (2 * math.pi)
    return circular_palette(F.pmod((255 * turn).cast("int"), F.lit(256)))


def intensity_palette(value: Column) -> Column:
    """struct(r, g, b) of a byte on a ramp of blue, cyan, green, yellow and red."""
    x = value.cast("int")
    full, none = F.lit(255), F.lit(0)
    red = _steps(x, none, none, _part(x, 128, 63), full)
    green = _steps(x, _part(x, 0, 63), full, full, 255 - _part(x, 192, 63))
    blue = _steps(x, full, 255 - _part(x, 64, 63), none, none)
    return F.struct(red.alias("r"), green.alias("g"), blue.alias("b"))
