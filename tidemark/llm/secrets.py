"""Secret scans, native: DataFrame functions only.

Base rules find assignments, access keys and long hex runs. Beside them, every candidate string (a run of 20 or more
base64 or hex characters) is read through a sliding window: the counts of its characters are carried from window to
window (one enters, one leaves), and with them the sum of c * log2 c, so that the Shannon entropy of each window
costs one update. Windows above the limit of their character class are joined to spans. Candidates on the allow-list
(words, numbers, UUIDs, paths, placeholders) are suppressed; base spans always stay.

Positions come from the texts between matches (``split``) and the matches themselves, counted in code points.

Cases: a null text counts as empty; very long texts and candidates are read whole; repeated rows and null doc_ids
each give their row; overlapping spans of different kinds are all reported; an empty table gives no rows; other
columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, given by the contract.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
WINDOW = 20
#: Bits per character from which a window of 20 counts as random, for each class.
LIMITS = {"entropy_hex": 2.9, "entropy_base64": 3.75}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
HEX_ONLY = r"^[0-9a-fA-F]+$"
#: No secrets, whatever their entropy: without both a letter and a digit, UUIDs, words and paths that end in a short
#: number, placeholders.
ALLOW = (
    r"^[^0-9]*$|^[^A-Za-z]*$"
    r"|^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    r"|^[A-Za-z/_=+-]*[0-9]{1,4}[/_=+-]*$"
    r"|(?i:example|placeholder|changeme|dummy|your[_-]?(key|token|secret))"
)


def _c_log_c(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _between(text: Column, found: Column, pattern: str) -> Column:
    return F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, op) -> Column:
    """Running results of an associative ``op`` over an array of ints, in two levels of about the root of its size: an array
    that a fold appends to is copied at each step, so one level would take a time that grows with the square."""

    def scanned(x: Column) -> Column:
        start = F.array().cast("array<int>")
        return F.aggregate(x, start, lambda acc, v: F.concat(acc, F.array(F.when(F.size(acc) > 0, op(F.element_at(acc, -1), v)).otherwise(v))))

    def levels(x: Column) -> Column:
        wide = F.ceil(F.sqrt(F.size(x))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / wide).cast("int") - 1), lambda p: scanned(F.slice(x, p * wide + 1, wide)))
        return _let(parts, lambda inner: _let(scanned(F.transform(inner, lambda y: F.element_at(y, -1))), lambda ends: F.flatten(F.transform(inner, lambda y, p: F.when(p == 0, y).otherwise(F.transform(y, lambda v: op(F.get(ends, p - 1), v)))))))

    return _let(values, lambda x: F.when(F.size(x) > 0, levels(x)).otherwise(x))


def _walk(found: Column, between: Column) -> Column:
    """Array of (s, e, m): code points of each match, and the match."""

    def placed(found: Column, between: Column) -> Column:
        lengths = F.transform(found, lambda m, i: F.length(F.get(between, i)) + F.length(m))
        return _let(_running(lengths, lambda a, b: a + b), lambda ends: F.transform(found, lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("s"), F.get(ends, i).alias("e"), m.alias("m"))))

    # bound before the lambdas that read them at each match: there, they would be worked out anew
    return _let(found, lambda x: _let(between, lambda y: placed(x, y)))


def entropy_spans(candidate: Column, limit: Column, window: int = WINDOW) -> Column:
    """Array of (a, b): joined extents, in ``candidate``, of its windows of at least ``limit`` bits a character."""
    chars = F.split(candidate, "")  # one entry per code point
    alphabet = F.array_distinct(chars)
    codes = F.transform(chars, lambda c: F.array_position(alphabet, c).cast("int"))
    spans = F.array().cast("array<struct<a:int,b:int>>")
    none = F.lit(0)
    start = F.struct(F.transform(alphabet, lambda _: none).alias("n"), F.lit(0.0).cast("double").alias("sum"), spans.alias("out"), codes.alias("codes"))

    def step(acc: Column, i: Column) -> Column:
        enters = F.get(acc["codes"], i)
        leaves = F.when(i >= window, F.get(acc["codes"], i - window)).otherwise(F.lit(0))
        a, b = F.get(acc["n"], enters - 1), F.get(acc["n"], leaves - 1)
        change = F.when(enters == leaves, F.lit(0.0)).otherwise(_c_log_c(a + 1) - _c_log_c(a) + F.when(leaves > 0, _c_log_c(b - 1) - _c_log_c(b)).otherwise(F.lit(0.0)))
        total = acc["sum"] + change
        counts = F.transform(acc["n"], lambda c, k: c + F.when(k == enters - 1, 1).otherwise(0) - F.when(k == leaves - 1, 1).otherwise(0))
        bits = F.log2(F.lit(float(window))) - total / window
        lo, last = i - window + 1, F.element_at(acc["out"], -1)
        joined = F.when(
            (F.size(acc["out"]) > 0) & (last["b"] >= lo),
            F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(F.struct(last["a"].alias("a"), (i + 1).alias("b")))),
        ).otherwise(F.concat(acc["out"], F.array(F.struct(lo.alias("a"), (i + 1).alias("b")))))
        return F.struct(counts.alias("n"), total.alias("sum"), F.when((i >= window - 1) & (bits >= limit), joined).otherwise(acc["out"]).alias("out"), acc["codes"].alias("codes"))

    return F.aggregate(F.sequence(F.lit(0), F.length(candidate) - 1), start, step, lambda acc: acc["out"])


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), name: str = "found") -> DataFrame:
    """The columns ``keep`` and ``name``: array of (s, k, e), every span by start, then kind (its place in KINDS)."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(*(docs[c] for c in keep), text.alias(f"{name}_t"))
    t = F.col(f"{name}_t")
    rules = {"assign": (ASSIGN, r"(?i)password|passwd|secret|token|api_?key"), "access": (ACCESS, "AKIA"), "hex": (HEX[:-1] + "{32,}", None), "long": (CANDIDATE, None)}  # a hex run is maximal: only long ones need be found
    rows = rows.select("*", *(F.when(t.rlike(guard) if guard else F.lit(True), _found(t, p)).otherwise(F.array().cast("array<string>")).alias(f"{name}_{k}") for k, (p, guard) in rules.items()))
    rows = rows.select("*", *(_between(t, F.col(f"{name}_{k}"), p).alias(f"{name}_{k}_between") for k, (p, _) in rules.items()))
    rows = rows.select(*keep, *(_walk(F.col(f"{name}_{k}"), F.col(f"{name}_{k}_between")).alias(f"{name}_{k}") for k in rules))

    def spans(rule: str, kind: str, ok) -> Column:
        k = F.lit(KINDS.index(kind))
        return F.transform(F.filter(F.col(f"{name}_{rule}"), ok), lambda x: F.struct(x["s"].alias("s"), k.alias("k"), x["e"].alias("e")))

    odd = F.filter(F.col(f"{name}_long"), lambda x: ~x["m"].rlike(ALLOW))
    rows = rows.withColumn(f"{name}_long", odd)
    is_hex = lambda m: m.rlike(HEX_ONLY)
    limit = lambda m: F.when(is_hex(m), LIMITS["entropy_hex"]).otherwise(LIMITS["entropy_base64"])
    kind = lambda m: F.when(is_hex(m), KINDS.index("entropy_hex")).otherwise(KINDS.index("entropy_base64"))
    random = F.flatten(F.transform(F.col(f"{name}_long"), lambda x: F.transform(entropy_spans(x["m"], limit(x["m"])), lambda y: F.struct((x["s"] + y["a"]).alias("s"), kind(x["m"]).alias("k"), (x["s"] + y["b"]).alias("e")))))
    rows = rows.select(
        *keep,
        spans("assign", "assign", lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 8).alias(f"{name}_a"),
        spans("access", "access", lambda x: F.length(x["m"]) >= 16).alias(f"{name}_c"),
        spans("hex", "hex", lambda x: F.length(x["m"]) >= 32).alias(f"{name}_h"),
        F.when(F.size(f"{name}_long") > 0, random).otherwise(F.array().cast("array<struct<s:int,k:int,e:int>>")).alias(f"{name}_r"),
    )
    return rows.select(*keep, F.array_sort(F.concat(f"{name}_a", f"{name}_c", f"{name}_h", f"{name}_r")).alias(name))


def _line(found: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", name(x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans, from :func:`scan`."""
    n = lambda kind: F.size(F.filter("found", lambda x: x["k"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["k"] < 3)
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_line(base), 256).alias("base_sha256"), _line(F.col("found")).alias("spans"))


#: Code points of a part of a text: cut once, so that no span is searched for from the start.
PART = 1024


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each span, or group of spans that overlap, replaced by ``mark``. Takes a time in proportion to the text."""

    def cut(parts: Column, a: Column, b: Column) -> Column:
        """Code points a to b of the text."""
        first, last = F.floor(a / PART).cast("int"), F.floor((b - 1) / PART).cast("int")
        inside = F.concat(F.substring(F.get(parts, first), a - first * PART + 1, F.lit(PART)), F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(F.get(parts, last), F.lit(1), b - last * PART))
        return F.when(b <= a, "").when(first == last, F.substring(F.get(parts, first), a - first * PART + 1, b - a)).otherwise(inside)

    def pieces(parts: Column, found: Column, ends: Column, size: Column) -> Column:
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(ends, i - 1))
        kept = F.transform(found, lambda x, i: F.when((i == 0) | (x["s"] >= before(i)), F.concat(cut(parts, before(i), x["s"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(kept, ""), cut(parts, F.element_at(ends, -1), size))

    def whole(text: Column, found: Column) -> Column:
        parts, ends = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)), _running(F.transform(found, lambda x: x["e"]), F.greatest)
        return _let(parts, lambda p: _let(ends, lambda e: pieces(p, found, e, F.length(text))))

    return F.when(F.size(found) > 0, _let(text, lambda t: _let(found, lambda x: whole(t, x)))).otherwise(text)
