"""Contrast transfer and phase terms on coefficient rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from motes.functions.fixed import ANGSTROM_PER_MM, MAX_AMPLITUDE_CONTRAST, RELATIVISTIC, WAVELENGTH


def finite(value: Column) -> Column:
    """Neither NULL, NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def _wavelength(voltage: Column) -> Column:
    """Of an electron, in A; the voltage in kV."""
    volts = voltage * 1000
    return F.lit(WAVELENGTH) / F.sqrt(volts + F.lit(RELATIVISTIC) * volts * volts)


def _defocus_times_square(fx: Column, fy: Column, u: Column, v: Column, angle: Column) -> Column:
    """Defocus along a frequency's direction times its squared length.

    The two defoci are the principal values of a quadratic form turned by ``angle`` degrees, so no
    direction needs to be taken.
    """
    turn = F.radians(angle)
    along, across = fx * F.cos(turn) + fy * F.sin(turn), fy * F.cos(turn) - fx * F.sin(turn)
    return u * along * along + v * across * across


def contrast_transfer(
    fx: Column,
    fy: Column,
    voltage: Column,
    defocus_u: Column,
    defocus_v: Column,
    defocus_angle: Column,
    aberration: Column,
    bfactor: Column,
    phase_shift: Column,
    amplitude_contrast: Column,
) -> Column:
    """Transfer value at a frequency in 1/A: kV, A, degrees and mm in, 1 for unusable optics."""
    square = fx * fx + fy * fy
    wave = _wavelength(voltage)
    # path lengths against the unscattered wave: out of focus one way, aberration the other
    focus = wave * _defocus_times_square(fx, fy, defocus_u, defocus_v, defocus_angle)
    bend = 0.5 * (aberration * F.lit(ANGSTROM_PER_MM)) * wave * wave * wave * square * square
    share = F.least(F.greatest(amplitude_contrast, F.lit(0.0)), F.lit(MAX_AMPLITUDE_CONTRAST))
    phase = F.lit(math.pi) * (focus - bend) + F.radians(phase_shift) + F.asin(share)
    envelope = F.exp(-0.25 * F.greatest(bfactor, F.lit(0.0)) * square)
    usable = finite(voltage) & (voltage > 0) & finite(bfactor) & finite(amplitude_contrast)
    return F.when(usable, F.sin(phase) * envelope).otherwise(F.lit(1.0))


def transfer_weight(value: Column, mode: str, tau: float = 0.0) -> Column:
    """Factor for a coefficient: ``sign``, ``multiply`` or ``wiener`` (c / (c^2 + tau))."""
    if mode == "sign":
        return F.signum(value)
    if mode == "multiply":
        return value
    if mode == "wiener":
        return F.try_divide(value, value * value + F.lit(tau))
    raise ValueError(f"unknown mode {mode}")


def complex_multiply(re1: Column, im1: Column, re2: Column, im2: Column) -> tuple[Column, Column]:
    return re1 * re2 - im1 * im2, re1 * im2 + im1 * re2


def shift_phase(re: Column, im: Column, kx: Column, ky: Column, dx: Column, dy: Column, size: int):
    """Multiply by exp(-2 pi i (kx dx + ky dy) / size); non-finite shifts count as zero."""
    dx = F.when(finite(dx), dx).otherwise(F.lit(0.0))
    dy = F.when(finite(dy), dy).otherwise(F.lit(0.0))
    angle = F.lit(-2 * math.pi) * (kx * dx + ky * dy) / F.lit(float(size))
    return complex_multiply(re, im, F.cos(angle), F.sin(angle))
