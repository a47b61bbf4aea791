"""Exact sizing of buys on a curve: whole amounts, so decimals, not doubles.

A plan asks for as many tokens as the bet buys once the price has risen by the cap, and never pays more than the bet:
the order fills up to the cap and reverts beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def _down(a: Column, b: Column) -> Column:
    """Whole quotient of non-negative decimals, rounded down."""
    return ((a - a % b) / b).cast("decimal(38,0)")


def tokens_for(vsol: Column, vtok: Column, pay: Column) -> Column:
    """Tokens out for ``pay`` in: what is left of ``vtok`` after dividing the product, rounded down."""
    product, after = _d(vsol) * _d(vtok), _d(vsol) + _d(pay)
    whole = (_d(vtok) - _down(product, after)).cast("long")
    return F.when((vsol > 0) & (vtok > 0) & (pay > 0), whole).otherwise(0)


def quote_for(vsol: Column, vtok: Column, tokens: Column) -> Column:
    """Quote out for ``tokens`` in."""
    product, after = _d(vsol) * _d(vtok), _d(vtok) + _d(tokens)
    whole = (_d(vsol) - _down(product, after)).cast("long")
    return F.when((vsol > 0) & (vtok > 0) & (tokens > 0), whole).otherwise(0)


def cost_of(vsol: Column, vtok: Column, tokens: Column) -> Column:
    """Least quote that buys ``tokens``, rounded up; null where it cannot be had."""
    product, left = _d(vsol) * _d(vtok), _d(vtok) - _d(tokens)
    up = _down(product, left) + (product % left > 0).cast("int")
    ok = (vsol > 0) & (vtok > 0) & (tokens > 0) & (tokens < vtok)
    return F.when(ok, (up - _d(vsol)).cast("long"))


def plan(vsol: Column, vtok: Column, bet: Column, cap_bps: int) -> Column:
    """Struct of tokens, most (quote at most), and quoted (cost without drift)."""
    root = (1 + cap_bps / 1e4) ** 0.5
    tokens = tokens_for(F.floor(vsol * root), F.floor(vtok / root), bet)
    return F.struct(tokens.alias("tokens"), bet.cast("long").alias("most"), F.coalesce(cost_of(vsol, vtok, tokens), bet.cast("long")).alias("quoted"))


def fill(vsol: Column, vtok: Column, planned: Column, fee_bps: int, other_fees: Column) -> Column:
    """Struct of filled, cost, outlay (with fees) and slip, at the reserves where the order lands."""
    cost = cost_of(vsol, vtok, planned["tokens"])
    ok = F.coalesce(cost <= planned["most"], F.lit(False))
    paid = F.when(ok, cost).otherwise(0)
    fee = F.floor(paid * fee_bps / 1e4).cast("long")
    return F.struct(ok.alias("filled"), paid.alias("cost"), F.when(ok, paid + fee + other_fees).otherwise(0).cast("long").alias("outlay"), F.when(ok, cost / planned["quoted"] - 1).alias("slip"))


def realised(vsol: Column, vtok: Column, planned: Column, filled: Column, fee_bps: int, other_fees: Column) -> Column:
    """Struct of pnl, on_outlay and on_curve for selling everything at other reserves."""
    gross = quote_for(vsol, vtok, planned["tokens"])
    proceeds = gross - F.floor(gross * fee_bps / 1e4).cast("long") - other_fees
    pnl = proceeds - filled["outlay"]
    return F.struct(pnl.cast("long").alias("pnl"), F.try_divide(pnl, filled["outlay"]).alias("on_outlay"), (F.try_divide(gross, filled["cost"]) - 1).alias("on_curve"))
