"""Column expressions shared by the operators; all stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def db(x: Column) -> Column:
    """Decibels with a floor of -120."""
    return 10 * F.log10(x + F.lit(EPS))


def safe_db(x: Column) -> Column:
    """Decibels; null for what isn't positive and finite."""
    return F.when((x > 0) & ~F.isnan(x) & (x < float("inf")), 10 * F.log10(x))


def ratio(x: Column) -> Column:
    """Power ratio of decibels."""
    return F.pow(F.lit(10.0), x / 10)


def signed8(byte: Column) -> Column:
    """A byte 0..255 as signed."""
    return F.when(byte > 127, byte - 256).otherwise(byte)


def word_i(word: Column) -> Column:
    """In-phase part of a 16-bit word: its low byte."""
    return signed8(word.bitwiseAND(255))


def word_q(word: Column) -> Column:
    """Quadrature part of a 16-bit word: its high byte."""
    return signed8(F.shiftright(word, 8).bitwiseAND(255))


def clip8(x: Column) -> Column:
    """Rounded (half to even) and clipped to a signed byte."""
    return F.greatest(F.lit(-128), F.least(F.lit(127), F.rint(x))).cast("int")


def to_word(i: Column, q: Column) -> Column:
    """16-bit word of two numbers; clips what a signed byte can't hold."""
    return F.shiftleft(F.pmod(clip8(q), F.lit(256)), 8).bitwiseOR(F.pmod(clip8(i), F.lit(256)))


def fine_offset_hz(bin_: Column, nfft: int, df_hz: float) -> Column:
    """Frequency of a fine bin against its channel's centre; bins are in ascending frequency."""
    return (bin_ - nfft // 2) * F.lit(df_hz / nfft)


def frame_time_s(frame: Column, nfft: int, hop: int, dt_s: float) -> Column:
    """Centre of a frame, in seconds from the start of its tile."""
    return (frame * hop + nfft / 2) * F.lit(dt_s)


def interval_gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Rows between two ranges; 0 if they overlap or touch."""
    return F.greatest(F.lit(0), F.greatest(a0, b0) - F.least(a1, b1))


def interval_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Rows that two ranges share."""
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def anchor_row(row0: Column, frame: Column, hop: int, window: int) -> Column:
    """Row at the centre of a hit's anchor frame."""
    return F.rint(row0 + frame * hop + F.lit(0.5 * window)).cast("long")
