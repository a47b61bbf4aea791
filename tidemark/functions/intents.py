"""Intents out of decoded transactions (:func:`.decode.transactions`): a row for each instruction of a program, as columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decode import compute_budget, discriminator, spoofed, u32, u64, writable


@dataclass(frozen=True)
class Layout:
    """Keys in hex, and where the accounts of an instruction stand, by name of the instruction. The places."""

    program: str
    budget: str
    system: str = "00" * 32
    tips: tuple[str, ...] = ()
    names: dict[str, tuple[str, int]] = field(default_factory=lambda: {"buy": ("buy", 1), "sell": ("sell", 1), "buy_v2": ("buy", 2), "sell_v2": ("sell", 2)})
    #: version: mint, user, curve, quote mint (-1: none), accounts at least
    places: dict[int, tuple[int, int, int, int, int]] = field(default_factory=lambda: {1: (2, 6, 3, -1, 7), 2: (1, 13, 10, 2, 14)})


def _hex(key: Column) -> Column:
    return F.lower(F.hex(key))


def _known(layout: Layout, what: int) -> Column:
    return F.create_map(*(F.lit(x) for name, of in layout.names.items() for x in (discriminator(name, "global"), of[what])))


def tip(instructions: Column, keys: Column, layout: Layout) -> Column:
    """Units that the last transfer to a known tip account moves, 0 without one."""
    known = F.array(*map(F.lit, layout.tips)) if layout.tips else F.array().cast("array<string>")
    mine = F.filter(instructions, lambda x: (_hex(F.get(keys, x["program"])) == layout.system) & (F.octet_length(x["data"]) >= 12) & (F.hex(F.substring(x["data"], 1, 4)) == "02000000") & F.array_contains(known, F.coalesce(_hex(F.get(keys, F.get(x["accounts"], 1))), F.lit(""))))
    return F.coalesce(F.element_at(F.transform(mine, lambda x: u64(x["data"], 4).cast("decimal(20,0)")), F.when(F.size(mine) > 0, -1).otherwise(F.lit(None).cast("int"))), F.lit(0).cast("decimal(20,0)"))


def intents(txs: DataFrame, layout: Layout) -> DataFrame:
    """The other columns of ``txs`` (slot and so on) and, for each buy or sell instruction of the program in ``tx``: type,
    version, is_buy, signer, user, mint, quote_mint (hex), token_amount, sol_limit, unit_price, cu_limit, tip, first_sig, n_ix,
    n_accounts, n_signers, programs, curve_writable, probable_spoof. Short data or accounts, and accounts beyond the keys, give no row."""
    rest = [c for c in txs.columns if c != "tx"]
    keys, ixs = F.col("tx.keys"), F.col("tx.instructions")
    has = F.exists(keys, lambda k: _hex(k) == layout.program.lower())
    rows = txs.filter(has).withColumns({"b": compute_budget(ixs, keys, layout.budget), "tip": tip(ixs, keys, layout), "programs": F.array_distinct(F.filter(F.transform(ixs, lambda x: _hex(F.get(keys, x["program"]))), lambda p: p.isNotNull()))})
    rows = rows.withColumn("ix", F.explode(F.filter(ixs, lambda x: (_hex(F.get(keys, x["program"])) == layout.program.lower()) & (F.octet_length(x["data"]) >= 24))))
    data, accounts = F.col("ix.data"), F.col("ix.accounts")
    rows = rows.withColumn("disc", _hex(F.substring(data, 1, 8))).withColumns({"type": F.try_element_at(_known(layout, 0), F.col("disc")), "version": F.try_element_at(_known(layout, 1), F.col("disc"))}).filter("type is not null")

    def place(i: int) -> Column:
        at = F.lit(None).cast("int")
        for version, of in layout.places.items():
            if of[i] >= 0:
                at = F.when(F.col("version") == version, F.get(accounts, of[i])).otherwise(at)
        return at

    least = F.create_map(*(F.lit(x) for v, of in layout.places.items() for x in (v, of[4])))
    n = F.size(keys)
    rows = rows.withColumns({"m": place(0), "u": place(1), "c": place(2), "q": place(3)}).filter((F.size(accounts) >= least[F.col("version")]) & (F.col("m") < n) & (F.col("u") < n))
    header = F.col("tx.header")
    open_ = F.coalesce((F.col("c") < n) & writable(F.col("c"), n, F.get(header, 0), F.get(header, 1), F.get(header, 2)), F.lit(False))
    return rows.select(
        *rest, "type", "version", (F.col("type") == "buy").alias("is_buy"), _hex(F.get(keys, 0)).alias("signer"), _hex(F.get(keys, F.col("u"))).alias("user"), _hex(F.get(keys, F.col("m"))).alias("mint"), F.when(F.col("q") < n, _hex(F.get(keys, F.col("q")))).alias("quote_mint"),
        u64(data, 8).alias("token_amount"), u64(data, 16).alias("sol_limit"), F.col("b.unit_price").alias("unit_price"), F.col("b.cu_limit").alias("cu_limit"), "tip", _hex(F.col("tx.signature")).alias("first_sig"), F.size(ixs).alias("n_ix"), n.alias("n_accounts"), F.get(header, 0).alias("n_signers"), "programs",
        open_.alias("curve_writable"), spoofed(open_, F.col("b.cu_limit")).alias("probable_spoof"),
    )


def failed_buys(txs: DataFrame, layout: Layout, loaded: str | None = None) -> DataFrame:
    """The other columns of failed ``txs`` with mint and signer (hex) of their first buy of the program. Account numbers count
    through the message's keys and then ``loaded``, a column of further keys (binary)."""
    rest = [c for c in txs.columns if c not in ("tx", loaded)]
    keys, ixs = F.col("tx.keys"), F.col("tx.instructions")
    every = F.concat(keys, F.coalesce(F.col(loaded), F.array().cast("array<binary>"))) if loaded else keys
    buys = F.array(*(F.lit(discriminator(name, "global")) for name, of in layout.names.items() if of[0] == "buy"))
    mine = F.filter(ixs, lambda x: (_hex(F.get(keys, x["program"])) == layout.program.lower()) & F.array_contains(buys, _hex(F.substring(x["data"], 1, 8))) & (F.size(x["accounts"]) >= 7))
    rows = txs.select(*rest, every.alias("keys"), F.get(mine, 0).alias("ix")).filter("ix is not null")
    return rows.select(*rest, _hex(F.get("keys", F.get(F.col("ix.accounts"), 2))).alias("mint"), _hex(F.get("keys", F.get(F.col("ix.accounts"), 6))).alias("signer"))
