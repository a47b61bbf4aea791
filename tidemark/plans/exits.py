"""Registered queries of exits that sell in parts: policies, the paper book, ladders, repairs. Same rules as :mod:`.catalog`.

The tape of ``events`` has hours between rows where trades have seconds, so the gaps of the policies are days here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import amm
from ..operators import joins, planning, policies
from ..sources.tape import by_key, events_tape
from ..streaming import harness
from .catalog import ANCHOR, TAPE, TRIG, _anchored, query, rounded

RULES = policies.Rules(derisk_gap=86400.0, runner_gap=259200.0, arm=0.05, horizon=16 * 86400.0, kappa=3.0 / (16 * 86400.0))
EVERY, MOST = 2, 80

#: Snapshots, the entry one snapshot after the decision, and the pool of those after it.
_POOL = """{TAPE}, {ANCHOR}, snap AS (SELECT key, (fwd-1)//{EVERY} AS i, vsol AS vs, vtok AS vt, dt FROM fw WHERE (fwd-1)%{EVERY}=0 AND (fwd-1)//{EVERY}<{MOST}), fin AS (SELECT key, arg_max(vsol,fwd) AS vc, arg_max(vtok,fwd) AS tc FROM fw GROUP BY key),
ent AS (SELECT key, vs/vt AS price, vt-vs*vt/(vs+1e9) AS tokens, vc, tc FROM snap JOIN fin USING (key) WHERE i=0), pool AS (SELECT key, i-1 AS i, vs, vt, dt, vs/vt/price-1 AS ret, first_value(dt) OVER (PARTITION BY key ORDER BY i) AS dt0, greatest(0.0, max(vs/vt/price-1) OVER (PARTITION BY key ORDER BY i)) AS peak FROM snap JOIN ent USING (key) WHERE i>0)"""


def pool_sql(every: int = EVERY) -> str:
    return _POOL.format(TAPE=TAPE, ANCHOR=ANCHOR, EVERY=every, MOST=MOST)


POOL = pool_sql()
#: The chance of recovery, and a sale into reserves that earlier sales have moved.
P_REC = "greatest(0.0, least(1.0, 1-greatest(0.0,-ret)/(1+peak)))"


def _sale(vs: str, vt: str, amount: str) -> str:
    return f"({vs}-{vs}*{vt}/({vt}+{amount}))"


def _replay_sql(part: str, slices: str = "1", before: str = "", join: str = "", pool: str = "pool", every: int = EVERY) -> str:
    """A policy as a recursion over the pool: ``part`` of the rest, in terms of ret, peak, dt, dt0, sold, last."""
    return f"""WITH RECURSIVE {pool_sql(every)}{before}, r AS (SELECT key, -1 AS i, 1.0::DOUBLE AS lft, 0.0::DOUBLE AS got, 0.0::DOUBLE AS gave, -1e9::DOUBLE AS last, CAST(0 AS BIGINT) AS sold FROM ent UNION ALL
 SELECT key, i, CASE WHEN f>0 AND lft>0 THEN lft*(1-f) ELSE lft END, got+{_sale("vse", "vte", "amount")}, gave+amount, CASE WHEN f>0 AND lft>0 THEN dt ELSE last END, sold+CASE WHEN f>0 AND lft>0 THEN m ELSE 0 END FROM
 (SELECT *, CASE WHEN f>0 AND lft>0 THEN f*lft*tokens ELSE 0.0 END AS amount, greatest(vs-got,1.0) AS vse, vt+gave AS vte FROM (SELECT *, CAST({part} AS DOUBLE) AS f, CAST({slices} AS BIGINT) AS m FROM (SELECT p.*, r.lft, r.got, r.gave, r.last, r.sold, e.tokens FROM r JOIN {pool} p ON p.key=r.key AND p.i=r.i+1 JOIN ent e ON e.key=r.key) {join}))),
z AS (SELECT key, arg_max(lft,i) AS lft, arg_max(got,i) AS got, arg_max(gave,i) AS gave, arg_max(sold,i) AS sold FROM r GROUP BY key), n AS (SELECT key, lft, sold+CASE WHEN lft>0 THEN 1 ELSE 0 END AS sells, got+CASE WHEN lft>0 THEN {_sale("greatest(vc-got,1.0)", "(tc+gave)", "lft*tokens")} ELSE 0.0 END AS out FROM z JOIN ent USING (key))
SELECT key, round(out/1e9-1-0.025-0.0015*(1+sells),6) AS net, CAST(sells AS INTEGER) AS sells, round(lft,6) AS "left" FROM n"""


_SLICE = "1.0/(8-sold)"
_DERISK = f"CASE WHEN ret>0 AND dt-last>={RULES.derisk_gap} THEN {_SLICE} ELSE 0 END"
_RUNNER = f"CASE WHEN sold<8 AND dt-last>={RULES.runner_gap} THEN {_SLICE} ELSE 0 END"
_COMBINED = f"CASE WHEN sold<4 THEN {_DERISK} ELSE {_RUNNER} END"
_DUE = f"(least(8, CAST(floor((dt-dt0)/{RULES.runner_gap}) AS BIGINT))-sold)"
_WAY = RULES.kappa * RULES.horizon
_LEGS = f"least(8, CAST(floor((dt-dt0)*8/{RULES.horizon}) AS BIGINT))"
_hold = lambda legs: f"((exp({_WAY}*(1-{legs}/8.0))-exp(-{_WAY}*(1-{legs}/8.0)))/(exp({_WAY})-exp(-{_WAY})))"
_trail = lambda retrace: f"CASE WHEN sold<4 THEN {_DERISK} WHEN peak>={RULES.arm} AND (peak-ret)/(1+peak)>={retrace} THEN 1 ELSE 0 END"
_CUT = f"CASE WHEN ret<0 AND {P_REC}<0.5 THEN 1-2*{P_REC} ELSE 0 END"
SQL = {
    "k_combined": _replay_sql(_COMBINED),
    "time_spaced": _replay_sql(f"CASE WHEN {_DUE}>0 THEN {_DUE}/(8.0-sold) ELSE 0 END", f"greatest({_DUE},0)"),
    "h_time_spaced": _replay_sql(_RUNNER),
    "hybrid_trail": _replay_sql(_trail(0.30)),
    "c_hybrid_t30": _replay_sql(_trail(0.30)),
    "f_hybrid_t50": _replay_sql(_trail(0.50)),
    "b_frontload": _replay_sql(f"CASE WHEN ret>0 AND sold<8 THEN {_SLICE} ELSE 0 END"),
    "almgren_chriss": _replay_sql(f"CASE WHEN {_LEGS}<=sold THEN 0 WHEN {_LEGS}>=8 THEN 1 ELSE 1-{_hold(_LEGS)}/{_hold('sold')} END", f"greatest({_LEGS}-sold,0)"),
    "level_tp_50": _replay_sql("CASE WHEN ret>=0.5 THEN 1 ELSE 0 END"),
    "level_tp_100": _replay_sql("CASE WHEN ret>=1.0 THEN 1 ELSE 0 END"),
    "level_tp_200": _replay_sql("CASE WHEN ret>=2.0 THEN 1 ELSE 0 END"),
    "level_tp_100_t120": _replay_sql("CASE WHEN ret>=1.0 OR dt-dt0>=120.0 THEN 1 ELSE 0 END"),
    "level_tp_100_s30_t120": _replay_sql("CASE WHEN ret>=1.0 OR ret<=-0.3 OR dt-dt0>=120.0 THEN 1 ELSE 0 END"),
    "soft_cut": _replay_sql(f"CASE WHEN ({_CUT})>=0.999 THEN 1 WHEN ({_CUT})>0 THEN {_CUT} WHEN sold<8 THEN {_COMBINED} ELSE 0 END"),
}


def _paths(spark: SparkSession, sf: str, extra: tuple[str, ...] = ()) -> DataFrame:
    return policies.paths(_anchored(spark, sf), EVERY, MOST, extra)


for _policy, _sql in SQL.items():

    @query(f"policy_{_policy}", _sql)
    def _replay(spark: SparkSession, sf: str, policy: str = _policy) -> DataFrame:
        return rounded(policies.replay(_paths(spark, sf), policy, RULES))


def pool_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The snapshots after the entry as rows: key, i, ret, peak, dt, dt0 and the last return."""
    rows = policies.entered(_paths(spark, sf), RULES).select("key", "price", F.posexplode("pool").alias("i", "r"))
    rows = rows.select("key", "i", (F.col("r.vs") / F.col("r.vt") / F.col("price") - 1).alias("ret"), F.col("r.dt").alias("dt"))
    w = Window.partitionBy("key").orderBy("i")
    whole = Window.partitionBy("key")
    return rows.withColumns({"peak": F.greatest(F.lit(0.0), F.max("ret").over(w)), "dt0": F.first("dt").over(w), "final": F.max_by("ret", "i").over(whole)})


@query("almgren_chriss", f"WITH {POOL} SELECT key, i, CAST({_LEGS} AS INTEGER) AS legs, round({_hold(_LEGS)},6) AS holding, round(ret,6) AS ret FROM pool")
def almgren_chriss(spark: SparkSession, sf: str) -> DataFrame:
    """What the schedule still holds at each snapshot of each position."""
    rows = pool_rows(spark, sf)
    legs = policies.due_legs({"dt": F.col("dt")}, F.col("dt0"), RULES)
    return rounded(rows.select("key", "i", legs.alias("legs"), policies.holding(legs, RULES).alias("holding"), "ret"))


def _bins_sql(value: str, edges: list[float]) -> str:
    return f"greatest(0, least({len(edges) - 2}, " + "+".join(f"CASE WHEN {value}>={e!r} THEN 1 ELSE 0 END" for e in edges) + "-1))"


_E = policies.EDGES
_CODE = f"((({_bins_sql('ret', _E['ret'])}*{len(_E['peak']) - 1}+{_bins_sql('peak', _E['peak'])})*{len(_E['p']) - 1}+{_bins_sql(P_REC, _E['p'])})*{len(_E['dt']) - 1}+{_bins_sql('(dt-dt0)', _E['dt'])})"
_STATES = f", st AS (SELECT {_CODE} AS code, avg(fin_ret-ret) AS gain FROM (SELECT *, arg_max(ret,i) OVER (PARTITION BY key) AS fin_ret FROM pool) WHERE key%2=0 GROUP BY 1)"
_NBIN = f"{_bins_sql('sold', _E['sold'])}"


@query(
    "policy_rl_layered",
    _replay_sql(
        f"CASE WHEN st.gain IS NULL THEN 0 WHEN route THEN CASE WHEN st.gain<-0.2 THEN 0.25 ELSE 0 END WHEN st.gain<0 THEN CASE WHEN {_NBIN}=2 THEN 1 ELSE 0.5 END WHEN st.gain<0.1 THEN 0.125 ELSE 0 END",
        before=_STATES + ", pool2 AS (SELECT p.*, p.key%3=0 AS route, " + _CODE + " AS code FROM pool p)",
        join="x LEFT JOIN st ON st.code=x.code",
        pool="pool2",
    ).replace("SELECT *, CAST(CASE WHEN st.gain", "SELECT x.*, CAST(CASE WHEN st.gain"),
)
def policy_rl_layered(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables of actions over binned states, fitted on even keys: gain from here to the end decides; every third key
    takes the table that holds longer."""
    rows = pool_rows(spark, sf)
    s = {"ret": F.col("ret"), "peak": F.col("peak")}
    known = rows.filter("key % 2 = 0").groupBy(policies.state_code(s["ret"], s["peak"], policies.recovery(s), F.col("dt") - F.col("dt0")).alias("code")).agg(F.avg(F.col("final") - F.col("ret")).alias("gain"))
    n = len(policies.EDGES["sold"]) - 1
    each = known.withColumn("b", F.explode(F.array(*map(F.lit, range(n)))))
    g = F.col("gain")
    disc = F.when(g < 0, F.when(F.col("b") == 2, 4).otherwise(3)).when(g < 0.1, 1).otherwise(0)
    entry = lambda action: F.map_from_entries(F.collect_list(F.struct((F.col("code") * n + F.col("b")).alias("code"), action.alias("action"))))
    # as many rows as there are states: their number is bounded by the edges
    tables = each.agg(entry(disc).alias("disc"), entry(F.when(g < -0.2, 2).otherwise(0)).alias("hold"))
    found = _paths(spark, sf).join(F.broadcast(tables)).withColumn("table", F.when(F.col("key") % 3 == 0, F.col("hold")).otherwise(F.col("disc"))).drop("disc", "hold")
    return rounded(policies.replay(found, "rl_layered", RULES))


#: Discount of a snapshot; sweeps after which SQL's plain iteration is as near to the fixed point.
DISCOUNT, PLAIN = 0.9, 220
_VALUES = f"""{POOL}, c AS (SELECT key, i, ret AS gain, {_CODE} AS state FROM pool), mv AS (SELECT *, lead(state) OVER (PARTITION BY key ORDER BY i) AS nxt FROM c), stt AS (SELECT state, avg(gain) AS stop, count(*) AS rows FROM c GROUP BY 1),
m AS (SELECT state, nxt, count(*)/sum(count(*)) OVER (PARTITION BY state) AS p, avg(CASE WHEN nxt IS NULL THEN gain ELSE 0.0 END) AS reward FROM mv GROUP BY 1, 2),
it AS (SELECT 0 AS k, state, stop AS v FROM stt UNION ALL SELECT k, state, greatest(stop, hold) FROM (SELECT it0.k+1 AS k, m.state, sum(m.p*(m.reward+CASE WHEN it0.state=m.nxt THEN {DISCOUNT}*it0.v ELSE 0.0 END)) AS hold FROM it it0 JOIN m ON it0.state=coalesce(m.nxt, m.state) WHERE it0.k<{PLAIN} GROUP BY 1, 2) h JOIN stt USING (state)),
tab AS (SELECT m.state, any_value(stt.stop) AS stop, any_value(stt.rows) AS rows, sum(m.p*(m.reward+coalesce({DISCOUNT}*it.v,0.0))) AS hold FROM m JOIN stt USING (state) LEFT JOIN it ON it.k={PLAIN} AND it.state=m.nxt GROUP BY 1)"""


def _stops(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = pool_rows(spark, sf)
    code = policies.state_code(F.col("ret"), F.col("peak"), policies.recovery({"ret": F.col("ret"), "peak": F.col("peak")}), F.col("dt") - F.col("dt0"))
    rows = rows.select("key", "i", code.alias("state"), F.col("ret").alias("gain"))
    states, moves = planning.tables(rows, "i")
    return rows, states, planning.solve(states, moves, DISCOUNT, 1e-9)


@query("stopping_values", f"WITH RECURSIVE {_VALUES} SELECT state, rows, round(stop,6) AS stop, round(hold,6) AS hold, stop>=hold AS sell FROM tab")
def stopping_values(spark: SparkSession, sf: str) -> DataFrame:
    """Value iteration over every state that occurs: what stopping and going on are worth, and which is better."""
    _, states, table = _stops(spark, sf)
    return rounded(table.join(states.select("state", "rows"), "state"))


@query(
    "policy_stopping_table",
    f"""WITH RECURSIVE {_VALUES}, x AS (SELECT key, i, gain, stop>=hold AS sell FROM c JOIN tab USING (state))
SELECT key, coalesce(min(i) FILTER (WHERE sell), max(i)) AS at, round(coalesce(arg_min(gain,i) FILTER (WHERE sell), arg_max(gain,i)),6) AS gain, count(*) FILTER (WHERE sell)=0 AS forced FROM x GROUP BY 1""",
)
def policy_stopping_table(spark: SparkSession, sf: str) -> DataFrame:
    """Each key stopped by the table of :func:`stopping_values`."""
    rows, _, table = _stops(spark, sf)
    return rounded(planning.first_stop(rows, table, "i"))


def with_values(found: DataFrame, values: DataFrame) -> DataFrame:
    """Paths whose snapshots after the entry carry ``f`` (``values``: key, i from 0 after the entry, f); unknown ones hold."""
    each = values.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("f", F.lit(1e9)).alias("f")))).alias("fs"))
    first = lambda i: F.when(i == 0, 0.0).otherwise(F.get("fs", i - 1)["f"])
    path = F.transform("path", lambda r, i: F.struct(r["i"].alias("i"), r["vs"].alias("vs"), r["vt"].alias("vt"), r["dt"].alias("dt"), first(i).alias("f")))
    return found.join(each, "key", "left").withColumn("path", path).drop("fs")


_SHAPE = f"{_bins_sql('ret', _E['ret'])}*10+{_bins_sql('peak', _E['peak'])}"


@query(
    "policy_lsm_continuation",
    _replay_sql(
        "CASE WHEN ret>f0 THEN 1 ELSE 0 END",
        before=f", lf AS (SELECT {_SHAPE} AS shape, avg(fin_ret) AS f0 FROM (SELECT *, arg_max(ret,i) OVER (PARTITION BY key) AS fin_ret FROM pool) WHERE key%2=0 GROUP BY 1), pool2 AS (SELECT p.*, coalesce(f0+0.01, 1e9) AS f0 FROM (SELECT *, {_SHAPE} AS shape FROM pool) p LEFT JOIN lf USING (shape))",
        pool="pool2",
    ),
)
def policy_lsm_continuation(spark: SparkSession, sf: str) -> DataFrame:
    """Optimal stopping: what going on is expected to bring is the mean end of like states of even keys, plus a margin."""
    rows = pool_rows(spark, sf)
    shape = policies.binned(F.col("ret"), policies.EDGES["ret"]) * 10 + policies.binned(F.col("peak"), policies.EDGES["peak"])
    rows = rows.withColumn("shape", shape)
    fitted = rows.filter("key % 2 = 0").groupBy("shape").agg((F.avg("final") + 0.01).alias("f"))  # a row for each state
    found = with_values(_paths(spark, sf), rows.join(F.broadcast(fitted), "shape", "left"))
    return rounded(policies.replay(found, "lsm_continuation", RULES))


_BOOK = f"""b AS (SELECT key, count(*) AS len, min(CASE WHEN ret>0 THEN i END) AS gain, min(CASE WHEN ret<0 AND p<0.9 THEN i END) AS death FROM (SELECT *, greatest(0.0,1-greatest(0.0,-ret)*2) AS p FROM pool) GROUP BY key),
k AS (SELECT ent.key, len, gain, death, CASE WHEN gain IS NOT NULL AND (death IS NULL OR gain<=death) THEN 'rider' WHEN death IS NOT NULL THEN 'cut' ELSE 'hold' END AS kind FROM ent LEFT JOIN b USING (key)),
c AS (SELECT DISTINCT key, CASE WHEN len-gain>8 THEN CAST(gain+round_even(x*(len-gain-1)/7.0,0) AS BIGINT) ELSE gain+x END AS i FROM k, (SELECT unnest(range(0,8)) AS x) WHERE kind='rider' AND (len-gain>8 OR x<len-gain) UNION SELECT key, death FROM k WHERE kind='cut'),
o AS (SELECT c.key, row_number() OVER (PARTITION BY c.key ORDER BY c.i) AS j, count(*) OVER (PARTITION BY c.key) AS m, vs, vt FROM c JOIN pool ON pool.key=c.key AND pool.i=c.i)"""


@query(
    "paper_book",
    f"""WITH RECURSIVE {POOL}, {_BOOK}, r AS (SELECT key, CAST(0 AS BIGINT) AS j, 0.0::DOUBLE AS got, 0.0::DOUBLE AS gave FROM ent UNION ALL SELECT key, j, got+{_sale("vse", "vte", "each")}, gave+each FROM (SELECT r.key, o.j, r.got, r.gave, greatest(o.vs-r.got,1.0) AS vse, o.vt+r.gave AS vte, e.tokens/o.m AS each FROM r JOIN o ON o.key=r.key AND o.j=r.j+1 JOIN ent e ON e.key=r.key)),
z AS (SELECT key, max(j) AS slices, arg_max(got,j) AS got FROM r GROUP BY key)
SELECT key, kind, CAST(slices AS INTEGER) AS slices, round(CASE WHEN kind='hold' THEN {_sale("vc", "tc", "tokens")} ELSE got END/1e9-1-0.025-0.0015*(1+greatest(slices,1)),6) AS net FROM z JOIN k USING (key) JOIN ent USING (key)""",
)
def paper_book(spark: SparkSession, sf: str) -> DataFrame:
    """Riders, cuts and holds, with the chance of recovery falling twice as fast as the return."""
    rules = policies.Rules(death=0.9)
    found = _paths(spark, sf)
    entry = F.element_at("path", 1)
    fall = lambda r: F.greatest(F.lit(0.0), -(r["vs"] / r["vt"] / (entry["vs"] / entry["vt"]) - 1))
    with_p = F.transform("path", lambda r: F.struct(r["i"].alias("i"), r["vs"].alias("vs"), r["vt"].alias("vt"), r["dt"].alias("dt"), F.greatest(F.lit(0.0), 1 - fall(r) * 2).alias("p")))
    return rounded(policies.paper_book(found.withColumn("path", with_p), rules))


LEVELS = [0.1, 0.3, 0.6, 1.0]


@query(
    "time_ladder",
    f"""WITH {POOL}, lv AS (SELECT * FROM (VALUES (0,0.1::DOUBLE),(1,0.3),(2,0.6),(3,1.0)) t(k,lvl)), pk AS (SELECT key, max(ret) AS top FROM pool GROUP BY key),
fc AS (SELECT p.key, k, lvl, min(dt-dt0) AS t FROM pool p JOIN lv ON p.ret>=lvl GROUP BY 1,2,3), pc AS (SELECT fc.k, CASE WHEN t<604800 THEN 0 ELSE 1 END AS tb, avg(CASE WHEN top>=n.lvl THEN 1.0 ELSE 0.0 END) AS pc FROM fc JOIN lv n ON n.k=fc.k+1 JOIN pk USING (key) WHERE key%2=0 GROUP BY 1,2),
ev AS (SELECT p.*, lv.k, lv.lvl, (SELECT max(l2.k) FROM lv l2 WHERE p.ret>=l2.lvl) AS base, CASE WHEN dt-dt0<604800 THEN 0 ELSE 1 END AS tb, (peak-ret)/(1+peak) AS haz FROM pool p CROSS JOIN lv),
hit AS (SELECT ev.key, ev.k, min(CASE WHEN ret>=lvl OR haz>=0.6 OR (base IS NOT NULL AND base<3 AND coalesce(pc.pc,0)<0.5 AND dt-dt0>=86400) THEN i END) AS i FROM ev LEFT JOIN pc ON pc.k=ev.base AND pc.tb=ev.tb GROUP BY 1,2),
s AS (SELECT ent.key, lv.k, hit.i, CASE WHEN p.key IS NULL THEN {_sale("vc", "tc", "tokens/4")} ELSE {_sale("p.vs", "p.vt", "tokens/4")} END AS out FROM ent CROSS JOIN lv LEFT JOIN hit ON hit.key=ent.key AND hit.k=lv.k LEFT JOIN pool p ON p.key=ent.key AND p.i=hit.i)
SELECT key, count(i) AS early, round(sum(out)/1e9-1-0.025-0.0015*5,6) AS net FROM s GROUP BY key""",
)
def time_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """A tranche for each level: sold when its level is reached, when the fall from the peak is too deep, or when, given the
    level reached and the time, the next one is unlikely; the rest at the end. Chances are those of even keys."""
    rows = pool_rows(spark, sf)
    after = F.col("dt") - F.col("dt0")
    levels = rows.sparkSession.createDataFrame(list(enumerate(LEVELS)), "k int, lvl double")  # a few rows
    bucket = F.when(after < 604800, 0).otherwise(1)
    top = rows.groupBy("key").agg(F.max("ret").alias("top"))
    crossed = rows.join(F.broadcast(levels), F.col("ret") >= F.col("lvl")).groupBy("key", "k").agg(F.min(after).alias("t"))
    upper = levels.select((F.col("k") - 1).alias("k"), F.col("lvl").alias("next"))
    chance = crossed.filter("key % 2 = 0").join(F.broadcast(upper), "k").join(top, "key").groupBy("k", F.when(F.col("t") < 604800, 0).otherwise(1).alias("tb")).agg(F.avg((F.col("top") >= F.col("next")).cast("double")).alias("pc"))
    base = sum((F.when(F.col("ret") >= x, 1).otherwise(0) for x in LEVELS), F.lit(0)) - 1
    each = rows.withColumns({"base": base, "tb": bucket}).join(F.broadcast(chance.select(F.col("k").alias("base"), "tb", "pc")), ["base", "tb"], "left").crossJoin(F.broadcast(levels))
    unlikely = (F.col("base") >= 0) & (F.col("base") < len(LEVELS) - 1) & (F.coalesce("pc", F.lit(0.0)) < 0.5) & (after >= 86400)
    out = (F.col("ret") >= F.col("lvl")) | ((F.col("peak") - F.col("ret")) / (1 + F.col("peak")) >= 0.6) | unlikely
    hit = each.groupBy("key", "k").agg(F.min(F.when(out, F.col("i"))).alias("i")).groupBy("key").agg(F.collect_list("i").alias("at"))
    found = policies.entered(_paths(spark, sf), RULES).join(hit, "key", "left").withColumn("at", F.coalesce("at", F.array().cast("array<int>")))
    part = F.col("tokens") / len(LEVELS)
    sold = F.aggregate("at", F.lit(0.0), lambda a, i: a + amm.sell_out(F.get("pool", i)["vs"], F.get("pool", i)["vt"], part))
    rest = (len(LEVELS) - F.size("at")) * amm.sell_out(F.col("vc"), F.col("tc"), part)
    return rounded(found.select("key", F.size("at").cast("long").alias("early"), policies.net_of(sold + rest, F.lit(1 + len(LEVELS)), RULES).alias("net")))


@query(
    "close_repair",
    f"""WITH {TAPE}, o AS (SELECT key, vsol AS vk, vtok AS tk, ts AS t_open FROM tape WHERE n=3), c AS (SELECT key, arg_max(ts,n)+CASE WHEN key%3=0 THEN 0 ELSE 60 END AS t, CASE WHEN key%3=0 THEN 'stale' ELSE 'exhausted' END AS reason, CASE WHEN key%2=0 THEN 'hold' ELSE 'rider' END AS exit_kind, CASE WHEN key%5=0 THEN NULL ELSE 0.0 END AS exit_ret FROM tape WHERE kind='click' GROUP BY key),
b AS (SELECT c.*, vk, tk, t_open FROM c JOIN o USING (key) WHERE reason='stale' AND exit_kind='hold' AND abs(exit_ret)<1e-9), l AS (SELECT b.key, arg_max(vsol,n) AS vs, arg_max(vtok,n) AS vt FROM b JOIN tape ON tape.key=b.key AND tape.ts<=b.t AND tape.kind='purchase' GROUP BY b.key)
SELECT key, round(t-t_open,6) AS duration, round((vs/vt)/(vk/tk)-1,6) AS exit_ret, round(({_sale("vs", "vt", "(tk-vk*tk/(vk+5e7))")}-5e7)/1e9-0.003,6) AS net FROM b JOIN l USING (key)""",
)
def close_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Closes booked as held at no change because the data had stopped: P&L again, from the last capture row before each."""
    tape = events_tape(spark, sf)
    opens = tape.filter("n = 3").select("key", F.col("vsol").alias("vk"), F.col("vtok").alias("tk"), F.col("ts").alias("t_open"))
    k = F.col("key")
    closes = tape.filter("kind = 'click'").groupBy("key").agg(F.max_by("ts", "n").alias("t")).select(
        "key", (F.col("t") + F.when(k % 3 == 0, 0).otherwise(60)).alias("ts"), F.when(k % 3 == 0, "stale").otherwise("exhausted").alias("reason"), F.when(k % 2 == 0, "hold").otherwise("rider").alias("exit_kind"), F.when(k % 5 != 0, 0.0).alias("exit_ret")
    )
    stale = closes.filter("reason = 'stale' and exit_kind = 'hold' and abs(exit_ret) < 1e-9").join(opens, "key")
    last = joins.as_of(stale.select("key", "ts", F.lit(0).alias("n")), tape.filter("kind = 'purchase'").select("key", "ts", "n", "vsol", "vtok"), ["vsol", "vtok"], "n")
    rows = stale.join(last.select("key", "vsol", "vtok"), "key").filter("vsol is not null")
    bet = F.lit(5e7)
    out = amm.sell_out(F.col("vsol"), F.col("vtok"), amm.buy_out(F.col("vk"), F.col("tk"), bet))
    return rounded(rows.select("key", (F.col("ts") - F.col("t_open")).alias("duration"), (F.col("vsol") / F.col("vtok") / (F.col("vk") / F.col("tk")) - 1).alias("exit_ret"), ((out - bet) / 1e9 - 0.003).alias("net")))


@query(
    "harness_outcomes",
    f"""WITH {TAPE}, {TRIG}, d AS (SELECT *, greatest(k_idx, v_idx) AS decision, first_value(mid) OVER (PARTITION BY key ORDER BY n) AS fst FROM trig WHERE k_idx IS NOT NULL AND v_idx IS NOT NULL), a AS (SELECT key, decision, max(CASE WHEN n=decision THEN mid/fst-1 END) AS score, max(CASE WHEN n=decision+1 THEN mid END) AS fmid, max(CASE WHEN n=decision+1 THEN ts END) AS fts FROM d GROUP BY 1,2),
b AS (SELECT key, decision, score, score>=0.0 AS fired, CASE WHEN score>=0.0 THEN fmid END AS fill_mid, fts FROM a), q AS (SELECT d.key, n, mid/fill_mid-1 AS ret, CASE WHEN n>b.decision+1 THEN CASE WHEN mid/fill_mid-1>=0.5 THEN 'take' WHEN ts-fts>=604800 AND fill_mid IS NOT NULL THEN 'cap' END END AS reason FROM d JOIN b USING (key)), e AS (SELECT key, arg_min(ret,n) AS exit_ret, arg_min(reason,n) AS reason FROM q WHERE reason IS NOT NULL GROUP BY key)
SELECT b.key, decision, round(score,6) AS score, fired, round(fill_mid,6) AS fill_mid, round(exit_ret,6) AS exit_ret, reason, fill_mid IS NOT NULL AND reason IS NULL AS censored FROM b LEFT JOIN e USING (key)""",
)
def harness_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Decision, score, fire, fill at the next row, exit: what the live harness does, in batch; open ends are censored."""
    return rounded(harness.outcomes(events_tape(spark, sf)))


MODES = ("mirror", "at_grad", "rolling", "rolling_aged")
_GRAD = {"multiple": 1.5, "window": 432000, "age": 864000.0, "lag": 3600.0, "lead": 7200.0, "tp": 0.3, "stop": -0.3, "horizon": 1209600.0}


@query(
    "graduation_modes",
    f"""WITH {TAPE}, g AS (SELECT key, min(CASE WHEN kind='purchase' THEN ts END) AS grad_t FROM tape GROUP BY key), w AS (SELECT tape.*, grad_t, first_value(mid) OVER (PARTITION BY key ORDER BY n) AS m0, first_value(ts) OVER (PARTITION BY key ORDER BY n) AS t0, min(mid) OVER (PARTITION BY key ORDER BY ts RANGE BETWEEN {_GRAD["window"]} PRECEDING AND CURRENT ROW) AS low FROM tape JOIN g USING (key)),
e AS (SELECT *, unnest(['mirror','at_grad','rolling','rolling_aged']) AS mode FROM w), x AS (SELECT key, mode, min(n) AS cross_n, arg_min(ts,n) AS cross_t, arg_min(t0,n) AS t0 FROM e WHERE CASE mode WHEN 'mirror' THEN mid>=m0*1.5 WHEN 'at_grad' THEN ts>=grad_t AND mid>=m0*1.5 WHEN 'rolling' THEN mid>=low*1.5 ELSE ts-t0>={_GRAD["age"]} AND mid>=low*1.5 END GROUP BY 1,2),
l AS (SELECT x.*, (SELECT count(*) FROM tape t WHERE t.key=x.key AND t.n<=x.cross_n AND t.ts<=x.cross_t-{_GRAD["lead"]}) AS before FROM x), f AS (SELECT l.key, l.mode, cross_n, before, min(t.n) AS fill_n, arg_min(t.mid,t.n) AS fill_mid, arg_min(t.ts,t.n) AS fill_t FROM l JOIN tape t ON t.key=l.key AND t.n>cross_n AND t.ts>=cross_t+{_GRAD["lag"]} WHERE before>=2 GROUP BY 1,2,3,4),
r AS (SELECT f.*, t.n, t.ts-fill_t AS dt, t.mid/fill_mid-1 AS ret FROM f JOIN tape t ON t.key=f.key AND t.n>fill_n AND t.ts-fill_t<={_GRAD["horizon"]})
SELECT key, mode, cross_n, before, fill_n, CASE WHEN min(CASE WHEN ret>=0.3 THEN dt END)<=coalesce(min(CASE WHEN ret<=-0.3 THEN dt END),1e18) THEN 1 ELSE 0 END AS y, round(coalesce(arg_min(ret, CASE WHEN ret>=0.3 OR ret<=-0.3 THEN n END), arg_max(ret,n)),6) AS ret, min(CASE WHEN ret>=0.3 OR ret<=-0.3 THEN dt END) IS NULL AS censored FROM r GROUP BY 1,2,3,4,5""",
)
def graduation_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Crosses of a key under four rules at once - against its first price, the same after graduation, against the low of a
    trailing window, the same once the key has aged - with the rows known a lead before the cross, a lagged entry, and the
    barrier that is touched first within a horizon."""
    g = _GRAD
    tape = events_tape(spark, sf).select("key", "n", "ts", "mid", "kind")
    w, whole = by_key(), Window.partitionBy("key")
    first = lambda c: F.first(c).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = tape.withColumns({"grad_t": F.min(F.when(F.col("kind") == "purchase", F.col("ts"))).over(whole), "m0": first("mid"), "t0": first("ts"), "low": F.min("mid").over(by_key("ts").rangeBetween(-g["window"], 0))})
    high, up = F.col("mid") >= F.col("m0") * g["multiple"], F.col("mid") >= F.col("low") * g["multiple"]
    rules = (high, high & (F.col("ts") >= F.col("grad_t")), up, up & (F.col("ts") - F.col("t0") >= g["age"]))
    hit = rows.withColumn("mode", F.explode(F.array(*(F.when(c, m) for c, m in zip(rules, MODES, strict=True))))).filter("mode is not null")
    cross = hit.groupBy("key", "mode").agg(F.min("n").alias("cross_n"), F.min_by("ts", "n").alias("cross_t"))
    each = cross.join(tape.select("key", "n", "ts", "mid"), "key")
    known = F.count(F.when((F.col("n") <= F.col("cross_n")) & (F.col("ts") <= F.col("cross_t") - g["lead"]), 1))
    entry = F.when((F.col("n") > F.col("cross_n")) & (F.col("ts") >= F.col("cross_t") + g["lag"]), F.col("n"))
    fill = each.groupBy("key", "mode", "cross_n").agg(known.alias("before"), F.min(entry).alias("fill_n"), F.min_by("mid", entry).alias("fill_mid"), F.min_by("ts", entry).alias("fill_t")).filter("before >= 2 and fill_n is not null")
    after = fill.join(tape.select("key", "n", "ts", "mid"), "key").withColumns({"dt": F.col("ts") - F.col("fill_t"), "ret": F.col("mid") / F.col("fill_mid") - 1}).filter((F.col("n") > F.col("fill_n")) & (F.col("dt") <= g["horizon"]))
    take, stop = F.col("ret") >= g["tp"], F.col("ret") <= g["stop"]
    at = lambda c, what: F.min(F.when(c, F.col(what)))
    out = after.groupBy("key", "mode", "cross_n", "before", "fill_n").agg(at(take, "dt").alias("t_tp"), at(stop, "dt").alias("t_stop"), F.min_by("ret", F.when(take | stop, F.col("n"))).alias("touched"), F.max_by("ret", "n").alias("last"))
    y = F.when(F.col("t_tp") <= F.coalesce("t_stop", F.lit(1e18)), 1).otherwise(0)
    return rounded(out.select("key", "mode", "cross_n", "before", "fill_n", y.alias("y"), F.coalesce("touched", "last").alias("ret"), (F.col("t_tp").isNull() & F.col("t_stop").isNull()).alias("censored")))
