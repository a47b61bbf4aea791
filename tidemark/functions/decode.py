"""Decoders of event payloads: fixed layouts as column expressions, varying ones as small Arrow functions.

Malformed input gives null, never an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The base58 alphabet, and the layout of a trade event (offset of each field).
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
TRADE = {"sol": 40, "tok": 48, "ts": 89, "vsol": 97, "vtok": 105, "rsol": 113, "rtok": 121}
TRADE_LENGTH = 129


def discriminator(name: str, space: str = "global") -> str:
    """First 8 bytes, in hex, of sha256("<space>:<name>")."""
    return hashlib.sha256(f"{space}:{name}".encode()).hexdigest()[:16]


def program_data(line: Column) -> Column:
    """The bytes of a log line ``Program data: <base64>``."""
    return F.try_to_binary(F.nullif(F.regexp_extract(line, r"Program data: (\S+)", 1), F.lit("")), F.lit("base64"))


def _unsigned(data: Column, offset: Column | int, size: int) -> Column:
    at = offset if isinstance(offset, Column) else F.lit(offset)
    h = F.hex(F.substring(data, at + 1, size))
    turned = F.concat(*(F.substring(h, 2 * i - 1, 2) for i in range(size, 0, -1)))
    return F.when(F.length(h) == 2 * size, F.conv(turned, 16, 10).cast("decimal(20,0)"))


def u64(data: Column, offset: Column | int) -> Column:
    """Little-endian unsigned 64-bit integer at a byte offset; null beyond the end."""
    return _unsigned(data, offset, 8)


def u32(data: Column, offset: Column | int) -> Column:
    return _unsigned(data, offset, 4).cast("long")


def trade_event(data: Column) -> Column:
    """Struct of a trade event's fields (keys in hex); null for other payloads and short ones."""
    fields = [u64(data, at).alias(name) for name, at in TRADE.items()]
    whole = F.struct(F.hex(F.substring(data, 9, 32)).alias("mint"), (F.hex(F.substring(data, 57, 1)) == "01").alias("is_buy"), F.hex(F.substring(data, 58, 32)).alias("user"), *fields)
    return F.when((F.lower(F.hex(F.substring(data, 1, 8))) == discriminator("TradeEvent", "event")) & (F.octet_length(data) >= TRADE_LENGTH), whole)


def create_event(data: Column) -> Column:
    """Struct of name, symbol, uri, mint and creator: three strings with their lengths before them, then four keys."""
    at, strings = F.lit(8).cast("long"), []
    for name in ("name", "symbol", "uri"):
        n = u32(data, at)
        strings.append(F.substring(data, (at + 5).cast("int"), n.cast("int")).cast("string").alias(name))
        at = at + 4 + n
    keys = [F.hex(F.substring(data, (at + 32 * i + 1).cast("int"), 32)).alias(k) for i, k in enumerate(("mint", "curve", "user", "creator"))]
    whole = F.struct(*strings, *keys)
    return F.when((F.lower(F.hex(F.substring(data, 1, 8))) == discriminator("CreateEvent", "event")) & (F.octet_length(data) >= at + 128), whole)


def pool_event(data: Column, buy: str, sell: str, create: str) -> Column:
    """Struct of a pool's buy, sell or creation (discriminators in hex): kind, reserves, pool, user, base mint."""
    disc, size = F.lower(F.hex(F.substring(data, 1, 8))), F.octet_length(data)
    key = lambda at: F.lower(F.hex(F.substring(data, at + 1, 32)))
    trade, made = disc.isin(buy, sell) & (size >= 184), (disc == create) & (size >= 205)
    whole = F.struct(
        F.when(made, "create").when(disc == buy, "buy").otherwise("sell").alias("kind"), F.when(trade, u64(data, 48)).alias("quote_res"), F.when(trade, u64(data, 56)).alias("base_res"),
        F.when(trade, key(120)).otherwise(key(173)).alias("pool"), F.when(trade, key(152)).alias("user"), F.when(made, key(50)).alias("base_mint"),
    )
    return F.when(trade | made, whole)


def curve_account(data: Column) -> Column:
    """Struct of a curve account: five amounts after 8 bytes, then a flag."""
    names = ("vtok", "vsol", "rtok", "rsol", "supply")
    whole = F.struct(*(u64(data, 8 + 8 * i).alias(n) for i, n in enumerate(names)), F.when(F.octet_length(data) > 48, F.hex(F.substring(data, 49, 1)) != "00").alias("complete"))
    return F.when(F.octet_length(data) >= 48, whole)


def compute_budget(instructions: Column, keys: Column, program: str) -> Column:
    """Struct of the compute limit (tag 2) and the price of a unit (tag 3) that a transaction asks for; the last of each
    counts. ``program``: the budget program's key in hex."""
    mine = F.filter(instructions, lambda x: F.lower(F.hex(F.get(keys, x["program"]))) == program.lower())

    def last(tag: str, least: int, read) -> Column:
        tagged = F.filter(mine, lambda x: (F.hex(F.substring(x["data"], 1, 1)) == tag) & (F.octet_length(x["data"]) >= least))
        return F.coalesce(F.element_at(F.transform(tagged, lambda x: read(x["data"], 1).cast("decimal(20,0)")), F.when(F.size(tagged) > 0, -1).otherwise(F.lit(None).cast("int"))), F.lit(0).cast("decimal(20,0)"))

    return F.struct(last("02", 5, u32).alias("cu_limit"), last("03", 9, u64).alias("unit_price"))


def first_known(keys: Column, known: dict[str, str]) -> Column:
    """The name of the first key that is known (routes, token programs); null if none is."""
    names = F.create_map(*(F.lit(x) for k, v in known.items() for x in (k, v)))
    return F.get(F.filter(F.transform(keys, lambda k: F.try_element_at(names, k)), lambda n: n.isNotNull()), 0)


def balance_price(after: Column, quote_mint: str) -> Column:
    """Price from token balances: the largest of the quote's over the largest of any other."""
    amount = lambda x: F.coalesce(x["amt_str"].try_cast("double"), F.lit(0.0))
    quote = F.array_max(F.transform(F.filter(after, lambda x: x["mint"] == quote_mint), amount))
    base = F.array_max(F.transform(F.filter(after, lambda x: x["mint"] != quote_mint), amount))
    return F.try_divide(quote, base)


def event_name(data: Column, names: list[str]) -> Column:
    """The event whose discriminator a payload starts with, else Unknown."""
    known = F.create_map(*(F.lit(x) for n in names for x in (discriminator(n, "event"), n)))
    return F.coalesce(F.try_element_at(known, F.lower(F.hex(F.substring(data, 1, 8)))), F.lit("Unknown"))


@F.pandas_udf(T.StringType())
def base58(data):
    """Base58 text of bytes."""

    def one(b):
        if b is None:
            return None
        n, out = int.from_bytes(b, "big"), ""
        while n:
            n, r = divmod(n, 58)
            out = BASE58[r] + out
        return "1" * (len(b) - len(b.lstrip(b"\0"))) + out

    return data.map(one)


def spoofed(curve_writable: Column, cu_limit: Column) -> Column:
    """A buy that cannot land: its curve is not writable, or its compute limit is positive but under 25,000."""
    return ~F.coalesce(curve_writable, F.lit(False)) | ((cu_limit > 0) & (cu_limit < 25_000))


def writable(index: Column, keys: Column, signers: Column, read_only_signed: Column, read_only_unsigned: Column) -> Column:
    """Whether the account at ``index`` of a message is writable, from the message's header."""
    return F.when(index < signers, index < signers - read_only_signed).otherwise(index < keys - read_only_unsigned)


def resolve_mint(kind: Column, mint: Column, accounts: Column, suffix: str) -> Column:
    """The mint an intent is about: its own field, else an account by kind, else the first one ending in ``suffix``."""
    tagged = F.get(F.filter(accounts, lambda a: a.endswith(suffix)), 0)
    return F.coalesce(mint, F.when(kind == "buy", F.get(accounts, 2)).when(kind == "sell", F.get(accounts, 0)), tagged)


def balance_delta(before: Column, after: Column, owner: Column, mint: Column) -> Column:
    """Change of ``owner``'s balance of ``mint`` between two arrays of (owner, mint, amt_str)."""

    def total(side: Column) -> Column:
        mine = F.filter(side, lambda x: (x["owner"] == owner) & (x["mint"] == mint))
        return F.aggregate(mine, F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + F.coalesce(x["amt_str"].try_cast("decimal(38,0)"), F.lit(0))).cast("decimal(38,0)"))

    return (total(after) - total(before)).cast("decimal(38,0)")


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("truncated")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def compact(self) -> int:
        """Seven bits a byte, low first, three bytes at most."""
        value = 0
        for shift in (0, 7, 14):
            b = self.number(1)
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
        raise ValueError("number too long")


def _transaction(c: _Cursor) -> dict:
    signatures = [c.take(64) for _ in range(c.compact())]
    lead = c.number(1)
    version = lead & 0x7F if lead & 0x80 else None
    header = [lead if version is None else c.number(1), c.number(1), c.number(1)]
    keys = [c.take(32) for _ in range(c.compact())]
    c.take(32)
    instructions = []
    for _ in range(c.compact()):
        program, accounts = c.number(1), list(c.take(c.compact()))
        instructions.append({"program": program, "accounts": accounts, "data": c.take(c.compact())})
    if version is not None:
        for _ in range(c.compact()):
            c.take(32)
            c.take(c.compact())
            c.take(c.compact())
    return {"signature": signatures[0] if signatures else None, "version": version, "header": header, "keys": keys, "instructions": instructions}


TRANSACTION = "struct<signature:binary,version:int,header:array<int>,keys:array<binary>,instructions:array<struct<program:int,accounts:array<int>,data:binary>>>"


def transactions(batches: DataFrame, column: str = "payload") -> DataFrame:
    """One row per transaction of each entry batch: the other columns, and ``tx``. A malformed batch gives none."""
    rest = [c for c in batches.columns if c != column]
    shape = batches.select(*rest).schema.add("tx", batches.sparkSession.createDataFrame([], f"tx {TRANSACTION}").schema["tx"].dataType)
    at = batches.columns.index(column)

    def read(data: bytes | None) -> list[dict]:
        try:
            c, out = _Cursor(data or b""), []
            for _ in range(c.number(8)):
                c.take(40)
                out += [_transaction(c) for _ in range(c.number(8))]
            return out
        except ValueError:
            return []

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("signature", pa.binary()), ("version", pa.int32()), ("header", pa.list_(pa.int32())), ("keys", pa.list_(pa.binary())), ("instructions", pa.list_(pa.struct([("program", pa.int32()), ("accounts", pa.list_(pa.int32())), ("data", pa.binary())])))])
        for b in parts:
            found = [read(x) for x in b.column(at).to_pylist()]
            take = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            cols = [b.column(i).take(take) for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([t for f in found for t in f], kind)], shape.names)

    return batches.mapInArrow(run, shape)
