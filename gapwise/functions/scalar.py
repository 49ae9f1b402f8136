"""Column functions: seeded jitter, unit conversion, display scales, classification, number texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gapwise.functions.exact import exact_fixed

# Fixed values
FNV_OFFSET, FNV_PRIME, WORD = 2166136261, 16777619, 4294967295
EV_NM = 1239.84
TARGET_MIN_EV, TARGET_MAX_EV = 0.5, 1.5
TRACK_MAX_EV = 2.2
AXIS_MIN_NM, AXIS_MAX_NM, AXIS_START, AXIS_LENGTH = 380.0, 2600.0, 20.0, 600.0
SCATTER_MAX, SCATTER_SIZE, SCATTER_PAD = 1.9, 300.0, 34.0
# What is said of a gap, by class 0 to 4
SENSING = [
    "this sits in deep short-wave IR territory, beyond typical NIR photodetector design and closer to thermal-imaging chemistries.",
    "this falls in the short-wave-IR (SWIR) range, matching extended-InGaAs and PbS/PbSe colloidal-QD detector designs.",
    "this lands squarely inside the NIR sensing target window, the same range used by InGaAs telecom photodiodes and CdTe-family absorbers.",
    "this sits just past the target window at the NIR/visible boundary, still useful as an upper-bound reference point.",
    "this has a visible-range gap, outside the scope this sandbox is built around.",
]


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units, as a long; a character beyond the BMP counts as its two surrogates."""

    def step(h: Column, unit: Column) -> Column:
        return (h.bitwiseXOR(unit) * FNV_PRIME).bitwiseAND(F.lit(WORD))

    def character(h: Column, c: Column) -> Column:
        code = F.ascii(c).cast("long")
        high = F.lit(0xD800) + F.floor((code - 0x10000) / 1024)
        low = F.lit(0xDC00) + (code - 0x10000).bitwiseAND(F.lit(1023))
        return F.when(code > 0xFFFF, step(step(h, high), low)).otherwise(step(h, code))

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(FNV_OFFSET).cast("long"), character)


def seeded_unit(text: Column) -> Column:
    """A number in [-1, 1] that depends on the text alone."""
    return fnv1a(text) / F.lit(float(WORD)) * 2.0 - 1.0


def clamp(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def ev_to_nm(eg: Column) -> Column:
    """Infinite at 0, with the zero's sign, where plain division would fail."""
    infinite = F.when(eg.cast("double").cast("string") == "-0.0", float("-inf")).otherwise(float("inf"))
    return F.when(eg == 0, infinite).otherwise(F.lit(EV_NM) / F.when(eg != 0, eg))


def track_percent(v: Column) -> Column:
    return clamp(v, 0.0, TRACK_MAX_EV) / TRACK_MAX_EV * 100.0


def band_percent(low: Column, high: Column) -> Column:
    return track_percent(high) - track_percent(low)


def axis_x(nm: Column) -> Column:
    return AXIS_START + (clamp(nm, AXIS_MIN_NM, AXIS_MAX_NM) - AXIS_MIN_NM) / (AXIS_MAX_NM - AXIS_MIN_NM) * AXIS_LENGTH


def axis_marks() -> dict[str, Column]:
    """Where visible light ends and the target window's two ends on the axis."""
    return {"visible_end": axis_x(F.lit(700.0)), "target_start": axis_x(ev_to_nm(F.lit(TARGET_MAX_EV))), "target_end": axis_x(ev_to_nm(F.lit(TARGET_MIN_EV)))}


def scatter_scale(v: Column) -> Column:
    """Not clamped."""
    return SCATTER_PAD + v / SCATTER_MAX * (SCATTER_SIZE - SCATTER_PAD * 1.5)


def scatter_y(v: Column) -> Column:
    return SCATTER_SIZE - scatter_scale(v)


def in_target_window(eg: Column) -> Column:
    return eg.between(TARGET_MIN_EV, TARGET_MAX_EV)


def sensing_class(eg: Column) -> Column:
    """0 below 0.2, 1 below 0.5, 2 to 1.5 and 3 to 1.8, both included, else 4."""
    return F.when(eg < 0.2, 0).when(eg < 0.5, 1).when(eg <= 1.5, 2).when(eg <= 1.8, 3).when(eg.isNotNull(), 4)


def sensing_context(eg: Column) -> Column:
    return F.get(F.array(*map(F.lit, SENSING)), sensing_class(eg))


def is_negative(r2: Column) -> Column:
    return F.coalesce(r2 < 0, F.lit(False))


def atom_radius(role: Column) -> Column:
    return F.when(role == "cation", 0.085).otherwise(0.065)


def parse_number(text: Column) -> Column:
    """The number that a text begins with, after white space; NaN where there is none, null for null."""
    number = F.regexp_extract(text, r"^\s*([+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?))", 1)
    return F.when(text.isNotNull(), F.coalesce(F.when(number != "", number).try_cast("double"), F.lit(float("nan"))))


def ev_text(v: Column, digits: int = 2) -> Column:
    return F.concat(exact_fixed(v, digits), F.lit(" eV"))


def nm_text(v: Column, digits: int = 0) -> Column:
    return F.concat(exact_fixed(v, digits), F.lit(" nm"))


def r2_text(v: Column, digits: int = 2) -> Column:
    return F.coalesce(exact_fixed(v, digits), F.lit("n/a"))


def angstrom_text(v: Column, digits: int = 2) -> Column:
    return F.concat(F.lit("a ≈ "), exact_fixed(v, digits), F.lit(" Å"))
