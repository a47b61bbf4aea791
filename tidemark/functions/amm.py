"""Constant-product market arithmetic, on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LAMPORTS = 1e9


def mid(vsol: Column, vtok: Column) -> Column:
    return F.when(vtok > 0, vsol / vtok).otherwise(0.0)


def fill_share(vsol: Column) -> Column:
    """How far a curve has filled, from 30 to 115 units of virtual reserves, within [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (vsol / LAMPORTS - 30) / 85))


def buy_out(vsol: Column, vtok: Column, pay: Column) -> Column:
    """Tokens out for ``pay`` in."""
    return vtok - vsol * vtok / (vsol + pay)


def sell_out(vsol: Column, vtok: Column, tokens: Column) -> Column:
    """Quote out for ``tokens`` in."""
    return vsol - vsol * vtok / (vtok + tokens)


def buy_out_exact(vsol: Column, vtok: Column, pay: Column) -> Column:
    """Whole tokens out, rounded down, without overflow; null when nothing can be paid."""
    d = lambda c: c.cast("decimal(20,0)")
    left = F.ceil(d(vsol) * d(vtok) / (d(vsol) + d(pay)))
    return F.when((pay > 0) & (vsol > 0) & (vtok > 0), (d(vtok) - left).cast("decimal(20,0)"))


def cap_up(amount: Column, bps: int) -> Column:
    return F.floor(amount * (10_000 + bps) / 10_000)


def cap_down(amount: Column, bps: int) -> Column:
    return F.floor(amount * (10_000 - bps) / 10_000)


def drifted(vsol: Column, vtok: Column, change: Column) -> tuple[Column, Column]:
    """Reserves after the price moved by ``change``."""
    root = F.sqrt(1 + change)
    return vsol * root, vtok / root


def net_return(proceeds: Column, outlay: Column, bps: float, fees: Column) -> Column:
    return proceeds / outlay - 1 - F.lit(bps / 1e4) - fees / outlay


def clamp(ret: Column, most: float = 10.0) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(most), ret))


def finite(value: Column, otherwise: float = 0.0) -> Column:
    """``value`` as double, or ``otherwise`` where it is null, NaN, infinite or no number."""
    x = value.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(otherwise)).otherwise(x)


def hash_bucket(key: Column, n: int = 100) -> Column:
    """md5(key) mod ``n`` as one 128-bit number, the same on every run and engine."""
    digest = F.md5(key.cast("string"))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)") % n
    return ((half(1) * (2**64 % n) + half(17)) % n).cast("int")
