"""Exit policies as folds: what is sold next depends on what was sold before.

A position is bought with ``quote`` units at the reserves of an entry snapshot; each later snapshot may sell a part of
what is left, into reserves that earlier sales have moved. A policy is a function of the fold's state and a snapshot that
says which part of the rest to sell, and as how many slices that counts. Snapshots are a bounded number of a key's rows
(:func:`snapshots`), so the array that ``aggregate`` walks inside the JVM is bounded too, whatever the key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import amm


# The defaults of slices, gaps, trail and costs.
@dataclass(frozen=True)
class Rules:
    slices: int = 8
    derisk: int = 4
    derisk_gap: float = 5.0
    runner_gap: float = 15.0
    retrace: float = 0.30
    arm: float = 0.20
    death: float = 0.10
    quote: float = 1e9
    cost_bps: float = 250.0
    fee: float = 0.0015e9  # of each transaction
    entry: int = 1  # snapshots until the entry; 0: at the decision itself
    horizon: float = 60.0  # seconds a schedule takes
    kappa: float = 0.05  # its curvature a second; 0: even slices


RULES = Rules()
Policy = Callable[[Column, Column, Rules], tuple[Column, Column]]
REGISTRY: dict[str, Policy] = {}


def register(name: str) -> Callable[[Policy], Policy]:
    def add(policy: Policy) -> Policy:
        REGISTRY[name] = policy
        return policy

    return add


def _slice(s: Column, rules: Rules) -> Column:
    """The next of the slices that are left, as a part of the rest."""
    return 1.0 / (F.lit(float(rules.slices)) - s["sold"])


def _derisk(s: Column, r: Column, rules: Rules) -> Column:
    return (s["ret"] > 0) & (r["dt"] - s["last"] >= rules.derisk_gap)


@register("k_combined")
def k_combined(s: Column, r: Column, rules: Rules) -> tuple[Column, Column]:
    """Paced slices in profit, then spaced slices whatever the return."""
    due = F.when(s["sold"] < rules.derisk, _derisk(s, r, rules)).otherwise((s["sold"] < rules.slices) & (r["dt"] - s["last"] >= rules.runner_gap))
    return F.when(due, _slice(s, rules)).otherwise(F.lit(0.0)), F.lit(1)


@register("time_spaced")
def time_spaced(s: Column, r: Column, rules: Rules) -> tuple[Column, Column]:
    """A slice for each gap since the first snapshot; all that are due are sold at once."""
    due = F.least(F.lit(rules.slices), F.floor((r["dt"] - s["dt0"]) / rules.runner_gap).cast("int")) - s["sold"]
    return F.when(due > 0, due / (F.lit(float(rules.slices)) - s["sold"])).otherwise(F.lit(0.0)), F.greatest(due, F.lit(0))


@register("h_time_spaced")
def h_time_spaced(s: Column, r: Column, rules: Rules) -> tuple[Column, Column]:
    """A slice a snapshot at most, a gap after the one before."""
    return F.when((s["sold"] < rules.slices) & (r["dt"] - s["last"] >= rules.runner_gap), _slice(s, rules)).otherwise(F.lit(0.0)), F.lit(1)


def hybrid_trail(retrace: float | None) -> Policy:
    def decide(s: Column, r: Column, rules: Rules) -> tuple[Column, Column]:
        """Paced slices in profit, then all of the rest a retrace under the armed peak."""
        out = (s["peak"] >= rules.arm) & ((s["peak"] - s["ret"]) / (1 + s["peak"]) >= (rules.retrace if retrace is None else retrace))
        return F.when(s["sold"] < rules.derisk, F.when(_derisk(s, r, rules), _slice(s, rules)).otherwise(F.lit(0.0))).when(out, F.lit(1.0)).otherwise(F.lit(0.0)), F.lit(1)

    return decide


for _name, _retrace in (("hybrid_trail", None), ("c_hybrid_t30", 0.30), ("f_hybrid_t50", 0.50)):
    register(_name)(hybrid_trail(_retrace))


@register("b_frontload")
def b_frontload(s: Column, r: Column, rules: Rules) -> tuple[Column, Column]:
    """A slice on every snapshot in profit."""
    return F.when((s["ret"] > 0) & (s["sold"] < rules.slices), _slice(s, rules)).otherwise(F.lit(0.0)), F.lit(1)


def holding(legs: Column, rules: Rules) -> Column:
    """The part of a position that a schedule still holds after ``legs`` of its slices: sinh(kappa (T - t)) / sinh(kappa T)
    at t = T legs / slices, as exponentials that do not overflow; 0 from the last slice on."""
    done = F.least(legs.cast("double"), F.lit(float(rules.slices))) / rules.slices
    way = rules.kappa * rules.horizon
    if way < 1e-9:
        return 1 - done
    return F.exp(-way * done) * (1 - F.exp(-2 * way * (1 - done))) / (1 - F.exp(F.lit(-2 * way)))


def due_legs(r: Column, dt0: Column, rules: Rules) -> Column:
    """How many slices of the schedule are due at a snapshot, counted from the first snapshot on."""
    return F.least(F.lit(rules.slices), F.floor((r["dt"] - dt0) * rules.slices / rules.horizon).cast("int"))


@register("almgren_chriss")
def almgren_chriss(s: Column, r: Column, rules: Rules) -> tuple[Column, Column]:
    """Holdings brought down to the schedule's; slices that fall due between two snapshots are sold at the later one."""
    due = due_legs(r, s["dt0"], rules)
    part = F.when(due >= rules.slices, F.lit(1.0)).otherwise(1 - holding(due, rules) / holding(s["sold"], rules))
    return F.when(due > s["sold"], part).otherwise(F.lit(0.0)), F.greatest(due - s["sold"], F.lit(0))


def level_tp(level: float, cap: float | None = None, stop: float | None = None) -> Policy:
    def decide(s: Column, r: Column, rules: Rules) -> tuple[Column, Column]:
        """All at a return of ``level``, at one of -``stop``, or ``cap`` seconds after the first snapshot."""
        out = s["ret"] >= level
        if stop is not None:
            out = out | (s["ret"] <= -stop)
        if cap is not None:
            out = out | (r["dt"] - s["dt0"] >= cap)
        return F.when(out, F.lit(1.0)).otherwise(F.lit(0.0)), F.lit(1)

    return decide


for _name, _args in (("level_tp_50", (0.5,)), ("level_tp_100", (1.0,)), ("level_tp_200", (2.0,)), ("level_tp_100_t120", (1.0, 120.0)), ("level_tp_100_s30_t120", (1.0, 120.0, 0.30))):
    register(_name)(level_tp(*_args))


def recovery(s: Column) -> Column:
    """A proxy of the chance of recovery: how little of the peak is lost, in [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.greatest(F.lit(0.0), -s["ret"]) / (1 + F.greatest(s["peak"], F.lit(0.0)))))


@register("soft_cut")
def soft_cut(s: Column, r: Column, rules: Rules) -> tuple[Column, Column]:
    """A loss with little chance of recovery p sells 1 - 2 p of the rest; else as ``k_combined``."""
    cut = F.when((s["ret"] < 0) & (recovery(s) < 0.5), 1 - 2 * recovery(s)).otherwise(F.lit(0.0))
    part, _ = k_combined(s, r, rules)
    return F.when(cut >= 0.999, F.lit(1.0)).when(cut > 0, cut).when(s["sold"] < rules.slices, part).otherwise(F.lit(0.0)), F.lit(1)


@register("lsm_continuation")
def lsm_continuation(s: Column, r: Column, rules: Rules) -> tuple[Column, Column]:
    """All once the return exceeds ``f``, what is expected of going on (a column of the snapshots)."""
    return F.when(s["ret"] > r["f"], F.lit(1.0)).otherwise(F.lit(0.0)), F.lit(1)


def binned(value: Column, edges: list[float]) -> Column:
    """The bin of ``value``: the last edge at or below it, within the bins there are."""
    return F.greatest(F.lit(0), F.least(F.lit(len(edges) - 2), sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0)) - 1))


# Edges of the states of the table policy: return, peak, chance of recovery, seconds, slices sold.
EDGES: dict[str, list[float]] = {"ret": [-1.0, -0.3, 0.0, 0.3, 1.0, 1e9], "peak": [-1.0, 0.2, 1.0, 1e9], "p": [0.0, 0.5, 0.8, 1.1], "dt": [0.0, 604800.0, 1e12], "sold": [0.0, 2.0, 4.0, 1e9]}
ACTIONS = [0.0, 0.125, 0.25, 0.5, 1.0]


def state_code(ret: Column, peak: Column, p: Column, dt: Column, sold: Column | None = None) -> Column:
    """The state as one number; without ``sold``, the number of its first four parts."""
    code = F.lit(0)
    for value, edges in zip((ret, peak, p, dt), (EDGES[c] for c in ("ret", "peak", "p", "dt")), strict=True):
        code = code * (len(edges) - 1) + binned(value, edges)
    return code if sold is None else code * (len(EDGES["sold"]) - 1) + binned(sold, EDGES["sold"])


@register("rl_layered")
def rl_layered(s: Column, r: Column, rules: Rules) -> tuple[Column, Column]:
    """The action of a table: ``tables`` of the key hold, by route, an action for each state; unknown states hold."""
    code = state_code(s["ret"], s["peak"], recovery(s), r["dt"] - s["dt0"], s["sold"].cast("double"))
    action = F.element_at(F.array(*map(F.lit, ACTIONS)), F.coalesce(F.try_element_at(s["table"], code), F.lit(0)) + 1)
    return F.when(action >= 0.999, F.lit(1.0)).otherwise(action), F.lit(1)


def snapshots(rows: DataFrame, every: int = 3, most: int = 80, shifted: bool = False) -> DataFrame:
    """Each key's forward rows at the cadence of snapshots, as ``i`` from 0: rows 1, 1 + every, ... (all, if ``every`` is 1),
    ``most`` of them. ``shifted``: the replay's cadence instead, which begins at row 1 + every, and is empty for 1."""
    place = F.col("fwd") - 1
    if shifted:
        found = rows.filter((place > 0) & (F.lit(every != 1)) & (place % every == 0)).withColumn("i", F.floor(place / every).cast("int") - 1)
    else:
        found = rows.filter(place % every == 0).withColumn("i", F.floor(place / every).cast("int"))
    return found.filter(F.col("i") < most)


def paths(rows: DataFrame, every: int = 3, most: int = 80, extra: tuple[str, ...] = ()) -> DataFrame:
    """key, ``path`` (its snapshots in order: i, vs, vt, dt and the columns ``extra``), and the reserves of its decision
    (vk, tk) and its last row (vc, tc)."""
    each = snapshots(rows, every, most).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", F.col("vsol").alias("vs"), F.col("vtok").alias("vt"), "dt", *extra))).alias("path"))
    ends = rows.groupBy("key").agg(F.max_by("vsol", "fwd").alias("vc"), F.max_by("vtok", "fwd").alias("tc"), F.first("vsol0").alias("vk"), F.first("vtok0").alias("tk"))
    return ends.join(each, "key", "left")


def entered(found: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Paths with the entry: ``pool`` (the snapshots after it), ``price`` and ``tokens`` bought."""
    n = F.coalesce(F.size("path"), F.lit(0))
    at = F.least(F.lit(rules.entry), n)  # 0: at the decision
    if rules.entry:
        vs, vt = (F.when(n > 0, F.element_at("path", F.greatest(at, F.lit(1)))[c]).otherwise(F.col(k)) for c, k in (("vs", "vk"), ("vt", "tk")))
    else:
        vs, vt = F.col("vk"), F.col("tk")
    rows = found.withColumns({"ve": vs, "te": vt}).filter("ve > 0 and te > 0")
    pool = F.when(n > rules.entry, F.slice("path", rules.entry + 1, F.greatest(n, F.lit(1)))).otherwise(F.slice("path", 1, 0))
    return rows.withColumns({"pool": F.coalesce(pool, F.array().cast(found.schema["path"].dataType)), "price": F.col("ve") / F.col("te"), "tokens": amm.buy_out(F.col("ve"), F.col("te"), F.lit(rules.quote))})


def net_of(got: Column, transactions: Column, rules: Rules) -> Column:
    return got / rules.quote - 1 - rules.cost_bps / 1e4 - rules.fee * transactions / rules.quote


def replay(found: DataFrame, policy: str, rules: Rules = RULES) -> DataFrame:
    """key, net (return after costs, with own impact, the rest sold at the key's last row), sells and left (the part sold
    only then) of a policy over :func:`paths`. A policy that uses a table reads the key's column ``table``."""
    if policy not in REGISTRY:
        raise KeyError(f"no policy {policy!r}; known: {sorted(REGISTRY)}")
    decide = REGISTRY[policy]
    rows = entered(found, rules)
    table = {"table": F.col("table")} if "table" in found.columns else {}
    start = {"left": F.lit(1.0), "got": F.lit(0.0), "gave": F.lit(0.0), "last": F.lit(-1e9), "peak": F.lit(0.0), "sold": F.lit(0), "ret": F.lit(0.0), "dt0": F.coalesce(F.get("pool", F.lit(0))["dt"], F.lit(0.0)), "price": F.col("price"), "tokens": F.col("tokens"), **table}
    fixed = ("dt0", "price", "tokens", *table)

    def step(s: Column, r: Column) -> Column:
        ret = r["vs"] / r["vt"] / s["price"] - 1
        now = F.struct(*(s[c].alias(c) for c in ("left", "got", "gave", "last", "sold", *fixed)), ret.alias("ret"), F.greatest(s["peak"], ret).alias("peak"))
        part, slices = decide(now, r, rules)
        sells = (part > 0) & (s["left"] > 0)
        amount = F.when(sells, part * s["left"] * s["tokens"]).otherwise(F.lit(0.0))
        vs, vt = F.greatest(r["vs"] - s["got"], F.lit(1.0)), r["vt"] + s["gave"]
        new = {
            "left": F.when(sells, s["left"] * (1 - part)).otherwise(s["left"]), "got": s["got"] + amm.sell_out(vs, vt, amount), "gave": s["gave"] + amount, "last": F.when(sells, r["dt"]).otherwise(s["last"]),
            "peak": F.greatest(s["peak"], ret), "sold": s["sold"] + F.when(sells, slices).otherwise(0), "ret": ret,
        }
        return F.struct(*(new.get(c, s[c]).alias(c) for c in start))

    done = rows.withColumn("s", F.aggregate("pool", F.struct(*(v.alias(c) for c, v in start.items())), step))
    left, got, gave = F.col("s.left"), F.col("s.got"), F.col("s.gave")
    rest = F.when(left > 0, amm.sell_out(F.greatest(F.col("vc") - got, F.lit(1.0)), F.col("tc") + gave, left * F.col("tokens"))).otherwise(F.lit(0.0))
    sells = F.col("s.sold") + (left > 0).cast("int")
    return done.select("key", net_of(got + rest, 1 + sells, rules).alias("net"), sells.alias("sells"), left.alias("left"))


def paper_book(found: DataFrame, rules: Rules = RULES) -> DataFrame:
    """key, kind and net of positions whose snapshots are all known. A rider sells in even slices from its first snapshot in
    profit on (``slices`` of them at most, evenly spread, halves to even); one that first falls with a chance of recovery
    (``p``, a column of the snapshots) under ``death`` is cut there; the others are held to the end."""
    rows = entered(found, rules)
    at = F.sequence(F.lit(0), F.size("pool") - 1)
    ret = lambda i: F.get("pool", i)["vs"] / F.get("pool", i)["vt"] / F.col("price") - 1
    none = F.array().cast("array<int>")
    places = F.when(F.size("pool") > 0, at).otherwise(none)
    rows = rows.withColumns({"gain": F.array_min(F.filter(places, lambda i: ret(i) > 0)), "death": F.array_min(F.filter(places, lambda i: (ret(i) < 0) & (F.get("pool", i)["p"] < rules.death)))})
    kind = F.when(F.col("gain").isNotNull() & (F.col("death").isNull() | (F.col("gain") <= F.col("death"))), "rider").when(F.col("death").isNotNull(), "cut").otherwise("hold")
    rows = rows.withColumn("kind", kind)
    length = F.size("pool") - F.col("gain")
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(rules.slices - 1)), lambda k: (F.col("gain") + F.bround(k * (length - 1) / float(rules.slices - 1), 0)).cast("int")))
    chosen = F.when(F.col("kind") == "rider", F.when(length > rules.slices, spread).otherwise(F.sequence("gain", F.size("pool") - 1))).when(F.col("kind") == "cut", F.array("death")).otherwise(none)
    rows = rows.withColumn("at", chosen)
    each = F.col("tokens") / F.size("at")

    def step(s: Column, i: Column) -> Column:
        r = F.get("pool", i)
        out = amm.sell_out(F.greatest(r["vs"] - s["got"], F.lit(1.0)), r["vt"] + s["gave"], each)
        return F.struct((s["got"] + out).alias("got"), (s["gave"] + each).alias("gave"))

    got = F.when(F.size("at") > 0, F.aggregate("at", F.struct(F.lit(0.0).alias("got"), F.lit(0.0).alias("gave")), step)["got"]).otherwise(amm.sell_out(F.col("vc"), F.col("tc"), F.col("tokens")))
    return rows.select("key", "kind", F.size("at").alias("slices"), net_of(got, 1 + F.greatest(F.size("at"), F.lit(1)), rules).alias("net"))
