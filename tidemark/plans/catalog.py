"""Registered queries over the tape, each with the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import amm
from ..operators import evaluation, features, joins, labels, policies, reputation, triggers
from ..sources.tape import by_key, events_tape, lineitem_tape, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TAPE = """tape AS (SELECT user_id AS key, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
 epoch_us(ts)/1e6 AS ts, CAST(floor(epoch_us(ts)/1e6/3600) AS BIGINT) AS slot, event_type IN ('purchase','signup','click') AS is_buy, event_type AS kind,
 value AS sol, value AS mid, event_type || '-' || CAST(event_id % 7 AS VARCHAR) AS actor, sqrt(1.8e19*value) AS vsol, sqrt(1.8e19/value) AS vtok,
 CASE WHEN user_id % 5 = 0 THEN sqrt(1.8e19*value) ELSE sqrt(1.8e19*value) - 3e10 END AS rsol, event_type = 'error' AS failed,
 CAST(json_extract_string(props,'$.k') AS DOUBLE) AS tip FROM events WHERE value > 0)"""
LINES = """tape AS (SELECT l_partkey AS key, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey) AS n,
 date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))*86400.0::DOUBLE AS ts, l_returnflag <> 'R' AS is_buy, l_quantity AS sol, l_extendedprice/l_quantity AS mid,
 CAST(l_suppkey AS VARCHAR) AS actor, l_linestatus = 'F' AS failed, l_tax AS tip FROM lineitem)"""
TRIG = """c AS (SELECT *, sum(CASE WHEN is_buy THEN sol ELSE 0.0 END) OVER (PARTITION BY key ORDER BY n) AS cum_buy FROM tape),
trig AS (SELECT *, max(CASE WHEN n=3 THEN n END) OVER (PARTITION BY key) AS k_idx, min(CASE WHEN n>=3 AND cum_buy>=150.0 THEN n END) OVER (PARTITION BY key) AS v_idx FROM c)"""
STEPS = """steps AS (SELECT *, mid - lag(mid) OVER w AS change, ts - lag(ts) OVER w AS gap, mid / first_value(mid) OVER w - 1 AS rel FROM {src} WINDOW w AS (PARTITION BY key ORDER BY n))"""
ANCHOR = """a0 AS (SELECT *, max(CASE WHEN n=3 THEN mid END) OVER (PARTITION BY key) AS mid0, max(CASE WHEN n=3 THEN ts END) OVER (PARTITION BY key) AS ts0 FROM tape),
fw AS (SELECT *, n-3 AS fwd, mid/mid0-1 AS ret, ts-ts0 AS dt FROM a0 WHERE n>3)"""


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _entry_sql(idx: str) -> str:
    return f"""WITH {TAPE}, {TRIG}, {STEPS.format(src="trig")},
p AS (SELECT * FROM steps WHERE n <= {idx}), pa AS (SELECT key, actor, sum(sol) AS s FROM p GROUP BY 1,2), act AS (SELECT key, max(s) AS top, count(*) AS uniq FROM pa GROUP BY 1),
t AS (SELECT key, arg_max(mid,n)/arg_min(mid,n)-1 AS win_ret, coalesce(abs(sum(change))/nullif(sum(abs(change)),0),0) AS dir_eff, avg(CASE WHEN is_buy THEN 1.0 ELSE 0.0 END) AS buy_frac,
 sum(CASE WHEN is_buy THEN sol ELSE -sol END) AS net_sol, sum(sol) AS tot_sol, count(*)/greatest(1e-6, arg_max(ts,n)-arg_min(ts,n)) AS trades_per_sec, arg_min(sol,n) AS entry_sol,
 greatest(0.0,max(rel)) AS drawup, least(0.0,min(rel)) AS drawdown FROM p GROUP BY key)
SELECT t.key, round(win_ret,6) win_ret, round(dir_eff,6) dir_eff, round(buy_frac,6) buy_frac, uniq, round(net_sol,6) net_sol, round(tot_sol,6) tot_sol, round(top/tot_sol,6) single_actor_share,
 round(trades_per_sec,6) trades_per_sec, round(entry_sol,6) entry_sol, round(drawup,6) drawup, round(drawdown,6) drawdown FROM t JOIN act USING (key)"""


@query("entry_features_k", _entry_sql("k_idx"))
def entry_features_k(spark: SparkSession, sf: str) -> DataFrame:
    # the K trigger needs a key's first rows only: the limit goes below everything else
    return rounded(features.entry(features.steps(triggers.with_triggers(events_tape(spark, sf).filter("n <= 3"))), F.col("k_idx")))


@query("entry_features_v", _entry_sql("v_idx"))
def entry_features_v(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.entry(features.steps(triggers.with_triggers(events_tape(spark, sf))), F.col("v_idx")))


@query("joint_decision", f"WITH {TAPE}, {TRIG} SELECT key, k_idx, v_idx, greatest(k_idx, v_idx) AS decision FROM trig WHERE n=1 AND k_idx IS NOT NULL AND v_idx IS NOT NULL")
def joint_decision(spark: SparkSession, sf: str) -> DataFrame:
    return triggers.decisions(events_tape(spark, sf))


def _four(value: str, name: str) -> str:
    return f"round(coalesce(avg({value}),0),6) AS {name}_mean, round(coalesce(quantile_cont({value},0.5),0),6) AS {name}_p50, round(coalesce(quantile_cont({value},0.9),0),6) AS {name}_p90, round(coalesce(max({value}),0),6) AS {name}_max"


@query(
    "snapshot_features",
    f"""WITH e AS ({_entry_sql("greatest(k_idx, v_idx)")}), m AS (WITH {TAPE}, {TRIG}, {STEPS.format(src="trig")}, p AS (SELECT *, CASE WHEN is_buy THEN sol END AS b, CASE WHEN NOT is_buy THEN sol END AS s FROM steps WHERE k_idx IS NOT NULL AND v_idx IS NOT NULL AND n <= greatest(k_idx, v_idx))
SELECT key, count(*) AS n_trades, round(greatest(1e-6,arg_max(ts,n)-arg_min(ts,n)),6) AS age_sec, round(coalesce(sum(b),0),6) AS cum_buy, round(coalesce(sum(s),0),6) AS cum_sell, round(arg_max(sol,n),6) AS last_sol, CAST(arg_max(is_buy,n) AS INTEGER) AS last_is_buy,
 round(coalesce(avg(gap),0),6) AS gap_mean, round(coalesce(quantile_cont(gap,0.5),0),6) AS gap_p50, round(coalesce(quantile_cont(gap,0.9),0),6) AS gap_p90, round(coalesce(min(gap),0),6) AS gap_min, {_four("b", "buy")}, {_four("s", "sell")} FROM p GROUP BY key)
SELECT * FROM e JOIN m USING (key)""",
)
def snapshot_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = features.steps(triggers.with_triggers(events_tape(spark, sf))).filter("k_idx is not null and v_idx is not null")
    return rounded(features.snapshot(rows, F.greatest("k_idx", "v_idx")))


def _lastn_sql(n: int) -> str:
    return f"""WITH {TAPE}, b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC) AS back FROM tape), p AS (SELECT * FROM b WHERE back<={n}), a AS (SELECT key, max(s) AS top FROM (SELECT key, actor, sum(sol) AS s FROM p GROUP BY 1,2) GROUP BY 1)
SELECT p.key, count(*) AS rows, round(arg_max(ts,n)-arg_min(ts,n),6) AS span, round(arg_max(mid,n)/arg_min(mid,n)-1,6) AS ret, round(avg(CASE WHEN is_buy THEN 1.0 ELSE 0.0 END),6) AS buy_frac, round(sum(CASE WHEN is_buy THEN sol ELSE -sol END),6)+0 AS net_sol, round(sum(sol),6) AS tot_sol, count(DISTINCT actor) AS uniq,
 round(max(top)/sum(sol),6) AS top_share, round(count(*)/greatest(1e-6,arg_max(ts,n)-arg_min(ts,n)),6) AS trades_per_sec, round(max(sol),6) AS max_sol, CAST(arg_max(is_buy,n) AS INTEGER) AS last_is_buy FROM p JOIN a ON a.key=p.key GROUP BY p.key"""


for _n in (3, 5, 10):

    @query("lastn_features" if _n == 10 else f"last{_n}_features", _lastn_sql(_n))
    def _lastn(spark: SparkSession, sf: str, n: int = _n) -> DataFrame:
        return rounded(features.last_n(events_tape(spark, sf), n))


#: Stand-ins for the seven fee columns of a trade.
FEES = {"fee": "tip*1000", "cu": "sol*3", "cu_limit": "sol*5+7", "priority": "CASE WHEN failed THEN 0 ELSE tip*17 END", "tip": "tip", "inner": "sol % 4", "keys": "sol % 9"}


@query(
    "exec_features",
    f"""WITH {LINES} SELECT key, {", ".join(_four(v, k) for k, v in FEES.items())}, round(avg(CASE WHEN tip>0 THEN 1.0 ELSE 0.0 END),6) AS tip_rate, round(sum(tip),6) AS tip_sum, round(avg(CASE WHEN is_buy THEN 1.0 ELSE 0.0 END),6) AS route_rate, round(avg(CASE WHEN failed THEN 1.0 ELSE 0.0 END),6) AS failed_rate FROM tape GROUP BY key""",
)
def exec_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.execution(lineitem_tape(spark, sf), {k: F.expr(v) for k, v in FEES.items()}, F.col("tip"), F.col("is_buy"), F.col("failed")))


@query(
    "rolling_flow",
    f"""WITH {TAPE}, pr AS (SELECT a.key, a.n, a.ts, b.actor, sum(b.sol) AS s, sum(CASE WHEN b.is_buy THEN 1 ELSE 0 END) AS nb, count(*) AS c, sum(CASE WHEN b.is_buy THEN b.sol ELSE -b.sol END) AS net, min(b.ts) AS t0
 FROM tape a JOIN tape b ON a.key=b.key AND b.n BETWEEN a.n-14 AND a.n GROUP BY 1,2,3,4)
SELECT key, n, round(sum(nb)*1.0/sum(c),6) AS buy_frac, CAST(count(*) AS INTEGER) AS actors, round(max(s)/sum(s),6) AS top_share, round(coalesce(sum(net)/nullif(ts-min(t0),0),0),6)+0 AS velocity FROM pr GROUP BY key, n, ts""",
)
def rolling_flow(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.rolling_flow(events_tape(spark, sf), order=("ts", "seq")))


@query(
    "rich_cross_features",
    f"""WITH {TAPE}, {STEPS.format(src="tape")}, x AS (SELECT key, min(n) AS cross_n FROM steps WHERE rel >= 1 GROUP BY key), p AS (SELECT s.*, cross_n, n > cross_n - 21 AS near FROM steps s JOIN x USING (key) WHERE n<=cross_n), a AS (SELECT key, max(c) AS top FROM (SELECT key, actor, count(*) AS c FROM p GROUP BY 1,2) GROUP BY 1),
t AS (SELECT key, count(*) AS ntr, sum(CASE WHEN is_buy THEN 1 ELSE 0 END) AS nb, sum(sol) AS vol_sol, sum(CASE WHEN is_buy THEN sol ELSE 0 END) AS bought, coalesce(max(CASE WHEN is_buy THEN sol END),0) AS max_buy_sol, sum(CASE WHEN change>0 THEN 1 ELSE 0 END) AS ups, min(rel) AS dd, max(rel) AS max_runup, greatest(arg_max(ts,n)-arg_min(ts,n),1e-3) AS age,
 greatest(arg_max(ts,n)-arg_min(ts, CASE WHEN near THEN n END),0.1) AS span, count(CASE WHEN near THEN 1 END) AS near_c, count(DISTINCT CASE WHEN near THEN actor END) AS uniq, count(DISTINCT CASE WHEN is_buy THEN actor END) AS n_buyers, count(DISTINCT CASE WHEN NOT is_buy THEN actor END) AS n_sellers, arg_max(mid,n)/arg_min(mid, CASE WHEN n>=cross_n-10 THEN n END)-1 AS recent, arg_max(coalesce(gap,0),n) AS last_gap, arg_max(rsol,n)/1e9 AS mcap_sol FROM p GROUP BY key),
u AS (SELECT *, CASE WHEN near_c>=2 THEN (near_c-1)/span ELSE 0.0 END AS tps, greatest(vol_sol,1e-9) AS vol FROM t JOIN a USING (key))
SELECT key, round(dd,6) AS dd, round(nb*1.0/ntr,6) AS buy_frac, ntr, round(recent,6) AS recent, round(tps,6) AS tps, uniq, round(age,6) AS t_to_2x, round(ln(age),6) AS log_t_to_2x, round(tps/greatest(ntr/age,1e-9),6) AS accel, round(last_gap,6) AS last_gap, round(mcap_sol,6) AS mcap_sol, round(vol_sol,6) AS vol_sol, round(vol_sol/ntr,6) AS sol_per_trade, round(max_buy_sol,6) AS max_buy_sol,
 round(max_buy_sol/vol,6) AS whale_frac, round((2*bought-vol_sol)/vol,6)+0 AS net_flow, n_buyers, n_sellers, round(n_buyers*1.0/(n_sellers+1),6) AS bs_ratio, round(top*1.0/ntr,6) AS signer_conc, round(ups*1.0/ntr,6) AS up_frac, round(max_runup,6) AS max_runup FROM u""",
)
def rich_cross_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.cross(features.steps(events_tape(spark, sf))))


@query(
    "milestone_crosses",
    f"""WITH {LINES}, b AS (SELECT *, first_value(mid) OVER w AS base, lead(mid) OVER w AS nm, lead(ts) OVER w AS nt FROM tape WINDOW w AS (PARTITION BY key ORDER BY n)),
m AS (SELECT unnest([1.2::DOUBLE,1.5::DOUBLE,2.0::DOUBLE,3.0::DOUBLE]) AS multiple), x AS (SELECT * FROM b, m WHERE mid >= multiple*base)
SELECT key, multiple, min(n) AS cross_n, round(arg_min(mid,n),6) AS cross_mid, round((array_agg(nm ORDER BY n))[1],6) AS fill_mid, round((array_agg(nt ORDER BY n))[1],6) AS fill_ts FROM x GROUP BY key, multiple""",
)
def milestone_crosses(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(labels.crosses(lineitem_tape(spark, sf), [1.2, 1.5, 2.0, 3.0]))


@query(
    "fresh_gate",
    f"""WITH {TAPE}, cl AS (SELECT *, first_value(rsol) OVER (PARTITION BY key ORDER BY n) AS first_rsol FROM tape WHERE abs(vsol-3e10-rsol)<5e7)
SELECT key, count(*) AS rows, min(n) AS first_n, round(max(first_rsol)/1e9,6) AS first_rsol, round(sum(sol),6) AS tot_sol FROM cl WHERE first_rsol<3e9 GROUP BY key""",
)
def fresh_gate(spark: SparkSession, sf: str) -> DataFrame:
    kept = triggers.fresh(events_tape(spark, sf))
    return rounded(kept.groupBy("key").agg(F.count("*").alias("rows"), F.min("n").alias("first_n"), (F.max("first_rsol") / 1e9).alias("first_rsol"), F.sum("sol").alias("tot_sol")))


def _anchored(spark: SparkSession, sf: str) -> DataFrame:
    return labels.anchored(events_tape(spark, sf))


@query(
    "fixed_tp_exit",
    f"""WITH {TAPE}, {ANCHOR}, nr AS (SELECT * FROM fw WHERE fwd<=20), h AS (SELECT key, coalesce(min(CASE WHEN ret>=0.5 THEN fwd END), max(fwd)) AS exit, min(CASE WHEN ret>=0.5 THEN fwd END) IS NOT NULL AS hit_tp FROM nr GROUP BY key)
SELECT nr.key, exit, hit_tp, round(arg_max(ret,fwd),6) AS exit_ret, round(max(ret),6) AS peak_ret FROM nr JOIN h ON nr.key=h.key AND fwd<=exit GROUP BY 1,2,3""",
)
def fixed_tp_exit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(labels.fixed_tp(_anchored(spark, sf), 0.5, 20))


@query(
    "barrier_label",
    f"""WITH {TAPE}, {ANCHOR}, t AS (SELECT key, min(CASE WHEN ret>=0.5 THEN dt END) AS t_tp, min(CASE WHEN ret<=-0.4 THEN dt END) AS t_stop, arg_max(ret,fwd) AS last_ret FROM fw GROUP BY key)
SELECT key, round(t_tp,6) AS t_tp, round(t_stop,6) AS t_stop, CASE WHEN t_tp IS NOT NULL AND (t_stop IS NULL OR t_tp<=t_stop) THEN 'tp' WHEN t_stop IS NOT NULL THEN 'stop' ELSE 'censored' END AS tp_rule,
 CASE WHEN t_tp IS NULL AND t_stop IS NULL THEN 'censored' WHEN t_stop IS NULL OR t_tp<t_stop THEN 'tp' ELSE 'stop' END AS stop_rule, round(last_ret,6) AS last_ret FROM t""",
)
def barrier_label(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(labels.barrier(_anchored(spark, sf), 0.5, -0.4))


@query(
    "trailing_stop",
    f"""WITH {TAPE}, {ANCHOR}, p AS (SELECT *, max(ret) OVER (PARTITION BY key ORDER BY fwd) AS peak FROM fw),
h AS (SELECT key, min(CASE WHEN (peak>=0.5 AND (1+ret)<=(1+peak)*(1-0.3)) OR (NOT peak>=0.5 AND ret<=-0.5) THEN fwd END) AS hit, max(fwd) AS last FROM p GROUP BY key)
SELECT p.key, fwd AS exit, hit IS NULL AS held, round(ret,6) AS exit_ret, round(peak,6) AS peak FROM p JOIN h ON p.key=h.key AND fwd=coalesce(hit,last)""",
)
def trailing_stop(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(labels.trailing(_anchored(spark, sf), 0.5, 0.3, -0.5))


@query("time_stop", f"WITH {TAPE}, {ANCHOR} SELECT key, max(fwd) AS exit, round(arg_max(ret,fwd),6) AS exit_ret FROM fw WHERE dt<=86400.0 GROUP BY key")
def time_stop(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(labels.time_stop(_anchored(spark, sf), 86400.0))


@query(
    "level_tp_policies",
    f"""WITH {TAPE}, {ANCHOR}, e AS (SELECT *, CASE WHEN ret>=level THEN 'tp' WHEN ret<=-0.6 THEN 'stop' WHEN dt>=1209600.0 THEN 'time' END AS phase FROM fw, (SELECT unnest([0.5::DOUBLE,1.0::DOUBLE,2.0::DOUBLE]) AS level)),
t AS (SELECT key, level, min(CASE WHEN phase IS NOT NULL THEN fwd END) AS hit, max(fwd) AS last FROM e GROUP BY key, level)
SELECT e.key, e.level, coalesce(phase,'held') AS phase, fwd AS exit, round(ret,6) AS exit_ret FROM e JOIN t ON e.key=t.key AND e.level=t.level AND fwd=coalesce(hit,last)""",
)
def level_tp_policies(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(labels.level_tp(_anchored(spark, sf), [0.5, 1.0, 2.0], -0.6, 1209600.0))


@query(
    "suffix_future",
    f"""WITH {TAPE}, {ANCHOR} SELECT key, fwd, round(coalesce(max(ret) OVER w, ret),6) AS future_max, round(coalesce(min(ret) OVER w, ret),6) AS future_min, round(max(ret) OVER (PARTITION BY key ORDER BY fwd ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),6) AS best_from_here
FROM fw WINDOW w AS (PARTITION BY key ORDER BY fwd ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)""",
)
def suffix_future(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(labels.future(_anchored(spark, sf)))


@query(
    "velocity_accel",
    f"""WITH {LINES}, v AS (SELECT *, (mid-lag(mid) OVER w)/nullif(ts-lag(ts) OVER w,0) AS velocity, mid/lag(mid,3) OVER w - 1 AS ret3 FROM tape WINDOW w AS (PARTITION BY key ORDER BY n))
SELECT key, n, round(velocity,6)+0 AS velocity, round((velocity-lag(velocity) OVER w)/nullif(ts-lag(ts) OVER w,0),6)+0 AS accel, round(ret3,6)+0 AS ret3 FROM v WINDOW w AS (PARTITION BY key ORDER BY n)""",
)
def velocity_accel(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.kinematics(lineitem_tape(spark, sf)))


@query(
    "islands_since_high",
    f"""WITH {TAPE}, f AS (SELECT *, CASE WHEN mid > coalesce(max(mid) OVER (PARTITION BY key ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e300) THEN 1 ELSE 0 END AS high FROM tape),
i AS (SELECT *, sum(high) OVER (PARTITION BY key ORDER BY n) AS island FROM f)
SELECT key, n, CAST(island AS BIGINT) AS island, row_number() OVER w - 1 AS rows_since, round(ts - first_value(ts) OVER w,6) AS secs_since FROM i WINDOW w AS (PARTITION BY key, island ORDER BY n)""",
)
def islands_since_high(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features.since_high(events_tape(spark, sf)))


@query(
    "rolling_min_cross",
    f"""WITH {TAPE}, m AS (SELECT *, min(mid) OVER (PARTITION BY key ORDER BY ts RANGE BETWEEN 86400.0 PRECEDING AND CURRENT ROW) AS low FROM tape)
SELECT key, min(n) AS cross_n, round(arg_min(mid,n),6) AS cross_mid, round(arg_min(low,n),6) AS low FROM m WHERE mid >= 2*low GROUP BY key""",
)
def rolling_min_cross(spark: SparkSession, sf: str) -> DataFrame:
    low = F.min("mid").over(by_key("ts").rangeBetween(-86400, 0))
    rows = events_tape(spark, sf).withColumn("low", low).filter(F.col("mid") >= 2 * F.col("low"))
    return rounded(rows.groupBy("key").agg(F.min("n").alias("cross_n"), F.min_by("mid", "n").alias("cross_mid"), F.min_by("low", "n").alias("low")))


@query(
    "cooldown_retrigger",
    f"""WITH RECURSIVE {TAPE}, h AS (SELECT key, n FROM (SELECT *, first_value(mid) OVER (PARTITION BY key ORDER BY n) AS base FROM tape) WHERE mid>=1.5*base),
r AS (SELECT key, min(n) AS n FROM h GROUP BY key UNION ALL SELECT r.key, (SELECT min(h.n) FROM h WHERE h.key=r.key AND h.n-r.n>10) FROM r WHERE EXISTS (SELECT 1 FROM h WHERE h.key=r.key AND h.n-r.n>10)) SELECT key, n FROM r""",
)
def cooldown_retrigger(spark: SparkSession, sf: str) -> DataFrame:
    return triggers.cooldown(events_tape(spark, sf), 1.5, 10)


WINDOWS = {"w1": 43200.0, "w2": 172800.0, "w3": 432000.0}


def _intent_sql(p: str, w: float) -> str:
    c = f"i.ts>=d.ts-{w!r}"
    n = f"count(CASE WHEN {c} THEN 1 END)"
    return f"""CAST({n}>0 AS INTEGER) AS {p}_present, {n} AS {p}_n, count(CASE WHEN {c} AND i.is_buy THEN 1 END) AS {p}_buy, count(CASE WHEN {c} AND NOT i.is_buy THEN 1 END) AS {p}_sell, round(coalesce(count(CASE WHEN {c} AND i.is_buy THEN 1 END)*1.0/nullif({n},0),0),6) AS {p}_buy_frac,
 round(coalesce(sum(CASE WHEN {c} THEN CASE WHEN i.is_buy THEN i.sol ELSE -i.sol END END),0),6)+0 AS {p}_net_sol, count(DISTINCT CASE WHEN {c} THEN i.actor END) AS {p}_uniq, round(coalesce(count(CASE WHEN {c} AND i.tip>0 THEN 1 END)*1.0/nullif({n},0),0),6) AS {p}_tip_rate, round(coalesce(max(CASE WHEN {c} THEN i.tip END),0),6) AS {p}_tip_max,
 round(coalesce(quantile_cont(CASE WHEN {c} THEN i.sol END,0.9),0),6) AS {p}_priority_p90, round(coalesce(count(CASE WHEN {c} AND i.failed THEN 1 END)*1.0/nullif({n},0),0),6) AS {p}_spoof_rate"""


@query(
    "intent_windows",
    f"""WITH {TAPE}, d AS (SELECT key, ts, n FROM tape WHERE kind='purchase'), i AS (SELECT * FROM tape WHERE kind<>'purchase')
SELECT d.key, round(d.ts,6) AS ts, d.n, {", ".join(_intent_sql(p, w) for p, w in WINDOWS.items())} FROM d LEFT JOIN i ON d.key=i.key AND i.ts BETWEEN d.ts-432000.0 AND d.ts GROUP BY 1,2,3""",
)
def intent_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Eleven aggregates of the intents before a decision, over three windows at once: one interval join for the widest."""
    tape = events_tape(spark, sf)
    right = tape.filter("kind <> 'purchase'").select("key", "ts", "actor", "is_buy", "sol", "tip", "failed")
    zero, parts = F.lit(0.0), []
    for p, w in WINDOWS.items():
        inside = F.col("ts_right") >= F.col("ts") - w
        n = lambda c, inside=inside: F.count(F.when(inside & c, 1))
        of = lambda c, inside=inside: F.when(inside, F.col(c))
        whole, share = n(F.lit(True)), lambda c, n=n: F.coalesce(F.try_divide(n(c), n(F.lit(True))), F.lit(0.0))
        signed = F.when(inside, F.when(F.col("is_buy"), F.col("sol")).otherwise(-F.col("sol")))
        columns = {
            "present": (whole > 0).cast("int"), "n": whole, "buy": n(F.col("is_buy")), "sell": n(~F.col("is_buy")), "buy_frac": share(F.col("is_buy")), "net_sol": F.coalesce(F.sum(signed), zero), "uniq": F.count_distinct(of("actor")), "tip_rate": share(F.col("tip") > 0), "tip_max": F.coalesce(F.max(of("tip")), zero),
            "priority_p90": F.coalesce(F.percentile(of("sol"), 0.9), zero), "spoof_rate": share(F.col("failed")),
        }
        parts += [v.alias(f"{p}_{k}") for k, v in columns.items()]
    found = joins.trailing_interval(tape.filter("kind = 'purchase'"), right, WINDOWS["w3"], parts, ["n"])
    return rounded(found.na.fill(0))


@query(
    "intent_interval_join",
    f"""WITH {TAPE}, d AS (SELECT key, ts, n FROM tape WHERE kind='purchase'), i AS (SELECT * FROM tape WHERE kind='view')
SELECT d.key, round(d.ts,6) AS ts, d.n, count(i.seq) AS intents, round(coalesce(sum(i.sol),0),6) AS intent_sol, round(max(i.tip),6) AS tip_max FROM d LEFT JOIN i ON d.key=i.key AND i.ts BETWEEN d.ts-259200.0 AND d.ts GROUP BY 1,2,3""",
)
def intent_interval_join(spark: SparkSession, sf: str) -> DataFrame:
    tape = events_tape(spark, sf)
    right = tape.filter("kind = 'view'").select("key", "ts", "seq", "sol", "tip")
    found = joins.trailing_interval(tape.filter("kind = 'purchase'"), right, 259200.0, [F.count("seq").alias("intents"), F.sum("sol").alias("intent_sol"), F.max("tip").alias("tip_max")], ["n"])
    return rounded(found.select("key", "ts", "n", F.coalesce("intents", F.lit(0)).alias("intents"), F.coalesce("intent_sol", F.lit(0.0)).alias("intent_sol"), "tip_max"))


@query(
    "asof_last_price",
    f"""WITH {TAPE}, l AS (SELECT key, ts, seq FROM tape WHERE kind='error'), r AS (SELECT key, ts, mid, sol FROM tape WHERE kind='purchase')
SELECT l.key, l.seq, round(l.ts,6) AS ts, round(r.mid,6) AS last_mid FROM l ASOF LEFT JOIN r ON l.key=r.key AND l.ts>=r.ts""",
)
def asof_last_price(spark: SparkSession, sf: str) -> DataFrame:
    tape = events_tape(spark, sf)
    right = tape.filter("kind = 'purchase'").select("key", "ts", "seq", F.col("mid").alias("last_mid"))
    return rounded(joins.as_of(tape.filter("kind = 'error'").select("key", "ts", "seq"), right, ["last_mid"]))


@query(
    "signature_first_seen",
    """WITH a AS (SELECT o_custkey AS k, min(epoch_us(o_orderdate)/1e6) AS ts_a FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1), b AS (SELECT o_custkey AS k, min(epoch_us(o_orderdate)/1e6) AS ts_b FROM orders WHERE o_orderpriority LIKE '5%' GROUP BY 1)
SELECT k, round(ts_a,6) AS ts_a, round(ts_b,6) AS ts_b, round(ts_b-ts_a,6) AS lead FROM a JOIN b USING (k)""",
)
def signature_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("k"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("ts"), "o_orderpriority")
    return rounded(joins.first_sightings(o.filter("o_orderpriority like '1%'"), o.filter("o_orderpriority like '5%'"), "k"))


@query(
    "semi_anti_coverage",
    """WITH c AS (SELECT c_custkey, c_mktsegment, EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey) AS seen, EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice>200000) AS large FROM customer)
SELECT c_mktsegment AS segment, count(*) AS customers, CAST(sum(CASE WHEN seen THEN 1 ELSE 0 END) AS BIGINT) AS covered, CAST(sum(CASE WHEN NOT seen THEN 1 ELSE 0 END) AS BIGINT) AS missed, CAST(sum(CASE WHEN large THEN 1 ELSE 0 END) AS BIGINT) AS large FROM c GROUP BY 1""",
)
def semi_anti_coverage(spark: SparkSession, sf: str) -> DataFrame:
    c, o = read(spark, sf, "customer"), read(spark, sf, "orders")
    seen = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.col("o_totalprice") > 200000).alias("large"))
    rows = c.join(seen.withColumn("seen", F.lit(1)), "c_custkey", "left")
    one = lambda x: F.sum(x.cast("long"))
    return rows.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("customers"), one(F.col("seen").isNotNull()).alias("covered"), one(F.col("seen").isNull()).alias("missed"), one(F.coalesce("large", F.lit(False))).alias("large"))


@query(
    "slot_congestion",
    f"""WITH {TAPE}, p AS (SELECT slot, count(*) AS c FROM tape GROUP BY 1) SELECT a.slot, a.c, round(coalesce(sum(b.c),0)/10.0,6) AS prior_mean, coalesce(max(b.c),0) AS prior_max FROM p a LEFT JOIN p b ON b.slot BETWEEN a.slot-10 AND a.slot-1 GROUP BY 1,2""",
)
def slot_congestion(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(joins.prior_range(events_tape(spark, sf), 10))


MEMBERS = """members AS (SELECT l_suppkey AS actor, l_orderkey AS key, min(epoch_us(l_shipdate)/1e6) AS t FROM lineitem GROUP BY 1,2),
o AS (SELECT o_orderkey AS key, epoch_us(o_orderdate)/1e6 AS cross_ts, CASE WHEN o_totalprice>150000 THEN 1 ELSE 0 END AS y, epoch_us(o_orderdate)/1e6 + (o_orderkey % 30)*86400.0::DOUBLE AS resolved_ts FROM orders),
m AS (SELECT actor, key, cross_ts, y, resolved_ts FROM members JOIN o USING (key))"""
REP = "SELECT key, round(avg(rate),6) AS rep_mean, round(max(rate),6) AS rep_max, round(avg(CASE WHEN seen>0 THEN 1.0 ELSE 0.0 END),6) AS known, CAST(sum(CASE WHEN seen>=3 AND rate>=0.6 THEN 1 ELSE 0 END) AS BIGINT) AS n_smart FROM q GROUP BY key"


def _members(spark: SparkSession, sf: str) -> DataFrame:
    sec = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    # next to none repeat: sorted as the join needs them, they take less memory than as hash tables before and after a shuffle
    pairs = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("actor"), F.col("l_orderkey").alias("key")).repartition("key")
    pairs = pairs.withColumn("again", F.row_number().over(Window.partitionBy("key", "actor").orderBy("actor"))).filter("again = 1").drop("again")
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), sec("o_orderdate").alias("cross_ts"), (F.col("o_totalprice") > 150000).cast("int").alias("y"))
    return pairs.join(o, "key").withColumn("resolved_ts", F.col("cross_ts") + (F.col("key") % 30) * F.lit(86400.0))


@query("reputation_rowframe", f"WITH {MEMBERS}, s AS (SELECT *, count(y) OVER w AS seen, coalesce(sum(y) OVER w,0) AS won FROM m WINDOW w AS (PARTITION BY actor ORDER BY cross_ts, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), q AS (SELECT *, (won+1)/(seen+2.0::DOUBLE) AS rate FROM s) {REP}")
def reputation_rowframe(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reputation.by_cross_order(_members(spark, sf)))


@query(
    "reputation_resolved",
    f"""WITH {MEMBERS}, u AS (SELECT actor, key, cross_ts AS tm, 0 AS ord, NULL::INTEGER AS y FROM m UNION ALL SELECT actor, key, resolved_ts, 1, y FROM m),
s AS (SELECT *, count(y) OVER w AS seen, coalesce(sum(y) OVER w,0) AS won FROM u WINDOW w AS (PARTITION BY actor ORDER BY tm, ord RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), q AS (SELECT *, (won+1)/(seen+2.0::DOUBLE) AS rate FROM s WHERE ord=0) {REP}""",
)
def reputation_resolved(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reputation.by_resolution(_members(spark, sf)))


SCORED = """scored AS (SELECT o_orderkey AS key, o_custkey AS grp, epoch_us(o_orderdate)/1e6 AS ts, round(((o_custkey*37 + o_orderkey*11) % 1000)/1000.0::DOUBLE,3) AS score, CASE WHEN o_totalprice > 250000 - ((o_custkey*37 + o_orderkey*11) % 1000)*100 THEN 1 ELSE 0 END AS y, o_totalprice/100000.0::DOUBLE - 2.5 AS net FROM orders)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with a made score, label and net: stand-ins for a model's output."""
    o = read(spark, sf, "orders")
    r = (F.col("o_custkey") * 37 + F.col("o_orderkey") * 11) % 1000
    return o.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("grp"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("ts"), F.round(r / F.lit(1000.0), 3).alias("score"), (F.col("o_totalprice") > 250000 - r * 100).cast("int").alias("y"), (F.col("o_totalprice") / F.lit(100000.0) - 2.5).alias("net"))


@query("pattern_dedup_mean", f"WITH {SCORED}, p AS (SELECT floor(score*100+1e-6) AS pattern, avg(net) AS m, count(*) AS c FROM scored GROUP BY 1) SELECT count(*) AS patterns, CAST(sum(c) AS BIGINT) AS rows, round(avg(m),6) AS dedup_mean FROM p")
def pattern_dedup_mean(spark: SparkSession, sf: str) -> DataFrame:
    p = scored(spark, sf).groupBy(F.floor(F.col("score") * 100 + 1e-6).alias("pattern")).agg(F.avg("net").alias("m"), F.count("*").alias("c"))
    return rounded(p.agg(F.count("*").alias("patterns"), F.sum("c").alias("rows"), F.avg("m").alias("dedup_mean")))


@query(
    "decile_lift",
    f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, key) AS rn, count(*) OVER () AS total FROM scored), d AS (SELECT *, CAST(floor((rn-1)*10/total) AS BIGINT) AS decile FROM r)
SELECT decile, count(*) AS rows, round(avg(y*1.0),6) AS rate, round(avg(net),6) AS net_mean, round(min(score),6) AS low FROM d GROUP BY 1""",
)
def decile_lift(spark: SparkSession, sf: str) -> DataFrame:
    r = evaluation.ordered(scored(spark, sf), "score", "key", descending=True)
    d = r.withColumn("decile", F.floor((F.col("rn") - 1) * 10 / F.col("total")))
    return rounded(d.groupBy("decile").agg(F.count("*").alias("rows"), F.avg(F.col("y").cast("double")).alias("rate"), F.avg("net").alias("net_mean"), F.min("score").alias("low")))


@query(
    "score_buckets",
    f"""WITH {SCORED} SELECT CASE WHEN score<=0.2 THEN '(0,.2]' WHEN score<=0.5 THEN '(.2,.5]' WHEN score<=0.8 THEN '(.5,.8]' ELSE '(.8,1]' END AS bin, round(least(floor(score*10)/10,0.9),6) AS decile, count(*) AS rows, round(avg(y*1.0),6) AS rate FROM scored GROUP BY 1,2""",
)
def score_buckets(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("score")
    b = F.when(s <= 0.2, "(0,.2]").when(s <= 0.5, "(.2,.5]").when(s <= 0.8, "(.5,.8]").otherwise("(.8,1]")
    return rounded(scored(spark, sf).groupBy(b.alias("bin"), F.least(F.floor(s * 10) / 10, F.lit(0.9)).alias("decile")).agg(F.count("*").alias("rows"), F.avg(F.col("y").cast("double")).alias("rate")))


@query(
    "ks_two_sample",
    f"""WITH {SCORED}, s AS (SELECT score AS v, CASE WHEN y=1 THEN 1 ELSE 0 END AS a, CASE WHEN y=1 THEN 0 ELSE 1 END AS b FROM scored), g AS (SELECT v, sum(a) AS a, sum(b) AS b FROM s GROUP BY v), c AS (SELECT sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM g), d AS (SELECT CAST(na AS BIGINT) AS na, CAST(nb AS BIGINT) AS nb, max(abs(ca*1.0::DOUBLE/na - cb*1.0::DOUBLE/nb)) AS d FROM c GROUP BY 1,2)
SELECT na, nb, round(d,6) AS d, round(least(1.0, 2*exp(-2*d*d*(na*1.0::DOUBLE*nb/(na+nb)))),6) AS p FROM d""",
)
def ks_two_sample(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf)
    return rounded(evaluation.ks(s.filter("y = 1"), s.filter("y = 0"), "score"))


@query(
    "auc_rank",
    f"""WITH {SCORED}, g AS (SELECT score, count(*) AS m, sum(y) AS pos FROM scored GROUP BY 1), c AS (SELECT *, sum(m) OVER (ORDER BY score) AS cum FROM g)
SELECT round((sum((cum-m+(m+1)/2.0)*pos)-sum(pos)*(sum(pos)+1)/2.0)/(sum(pos)*(sum(m)-sum(pos))),6)::DOUBLE AS auc, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(m) AS BIGINT) AS rows FROM c""",
)
def auc_rank(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluation.auc(scored(spark, sf)).withColumn("auc", F.col("auc").cast("double")))


@query(
    "youden_threshold",
    f"""WITH {SCORED}, g AS (SELECT score, sum(y) AS p, sum(1-y) AS q FROM scored GROUP BY 1), c AS (SELECT score, sum(p) OVER (ORDER BY score DESC)*1.0::DOUBLE/sum(p) OVER () AS tpr, sum(q) OVER (ORDER BY score DESC)*1.0::DOUBLE/sum(q) OVER () AS fpr FROM g)
SELECT round(score,6) AS score, round(tpr,6) AS tpr, round(fpr,6) AS fpr FROM c ORDER BY tpr-fpr DESC, score DESC LIMIT 1""",
)
def youden_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluation.youden(scored(spark, sf)))


@query(
    "es10_selection",
    f"""WITH {SCORED}, k AS (SELECT *, cut FROM scored, (SELECT unnest([0.5::DOUBLE,0.7::DOUBLE,0.9::DOUBLE]) AS cut) WHERE score>=cut), r AS (SELECT *, row_number() OVER (PARTITION BY cut ORDER BY net, key) AS r, count(*) OVER (PARTITION BY cut) AS m FROM k),
e AS (SELECT cut, avg(net) AS es10 FROM r WHERE r<=ceil(m*0.1) GROUP BY 1)
SELECT k.cut AS name, count(*) AS n, round(avg(y*1.0),6) AS precision, round(avg(net),6) AS net_mean, round(quantile_cont(net,0.5),6) AS net_p50, round(quantile_cont(net,0.25),6) AS net_p25, round(avg(CASE WHEN net>0 THEN 1.0 ELSE 0.0 END),6) AS win_rate, round(max(es10),6) AS es10 FROM k JOIN e ON k.cut=e.cut GROUP BY 1""",
)
def es10_selection(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf).withColumn("cut", F.explode(F.array(F.lit(0.5), F.lit(0.7), F.lit(0.9))))
    return rounded(evaluation.selection(rows, F.col("score") >= F.col("cut"), F.col("cut")))


@query(
    "threshold_sweep",
    f"""WITH {SCORED} SELECT cut, count(*) AS fires, round(count(*)*1.0::DOUBLE/max(total),6) AS fire_rate, round(avg(y*1.0),6) AS precision, round(sum(y)*1.0::DOUBLE/max(pos),6) AS recall, round(avg(net),6) AS net_mean
FROM scored, (SELECT unnest([0.1::DOUBLE,0.3::DOUBLE,0.5::DOUBLE,0.7::DOUBLE,0.9::DOUBLE]) AS cut), (SELECT count(*) AS total, sum(y) AS pos FROM scored) WHERE score>=cut GROUP BY cut""",
)
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf)
    totals = s.agg(F.count("*").alias("total"), F.sum("y").alias("pos"))
    rows = s.withColumn("cut", F.explode(F.array(*map(F.lit, (0.1, 0.3, 0.5, 0.7, 0.9))))).filter("score >= cut")
    per = rows.groupBy("cut").agg(F.count("*").alias("fires"), F.avg(F.col("y").cast("double")).alias("precision"), F.sum("y").alias("hits"), F.avg("net").alias("net_mean"))
    return rounded(per.crossJoin(F.broadcast(totals)).select("cut", "fires", (F.col("fires") / F.col("total")).alias("fire_rate"), "precision", (F.col("hits") / F.col("pos")).alias("recall"), "net_mean"))  # one row of totals


@query(
    "gap_audit",
    f"""WITH {TAPE}, g AS (SELECT *, ts-lag(ts) OVER (PARTITION BY key ORDER BY n) AS gap FROM tape), x AS (SELECT unnest([3600.0::DOUBLE,86400.0::DOUBLE,604800.0::DOUBLE]) AS stale)
SELECT stale, count(gap) AS gaps, CAST(sum(CASE WHEN gap>stale THEN 1 ELSE 0 END) AS BIGINT) AS false_closes, count(DISTINCT CASE WHEN gap>stale THEN key END) AS keys, round(quantile_cont(gap,0.5),6) AS gap_p50, round(max(gap),6) AS gap_max FROM g, x GROUP BY stale""",
)
def gap_audit(spark: SparkSession, sf: str) -> DataFrame:
    steps = features.steps(events_tape(spark, sf)).select("key", "gap")
    rows = steps.withColumn("stale", F.explode(F.array(F.lit(3600.0), F.lit(86400.0), F.lit(604800.0))))
    late = F.col("gap") > F.col("stale")
    per = rows.groupBy("stale", "key").agg(F.count("gap").alias("gaps"), F.sum(F.coalesce(late.cast("long"), F.lit(0))).alias("late"), F.max("gap").alias("gap_max"))
    out = per.groupBy("stale").agg(F.sum("gaps").alias("gaps"), F.sum("late").alias("false_closes"), F.count(F.when(F.col("late") > 0, 1)).alias("keys"), F.max("gap_max").alias("gap_max"))
    return rounded(out.crossJoin(F.broadcast(evaluation.quantiles(steps, "gap", [0.5]))).select("stale", "gaps", "false_closes", "keys", F.col("q0").alias("gap_p50"), "gap_max"))  # one row


@query("contention", f"WITH {TAPE} SELECT key, n, count(*) OVER (PARTITION BY key ORDER BY ts RANGE BETWEEN 172800.0 PRECEDING AND CURRENT ROW) - 1 AS others FROM tape")
def contention(spark: SparkSession, sf: str) -> DataFrame:
    return events_tape(spark, sf).select("key", "n", (F.count("*").over(by_key("ts").rangeBetween(-172800, 0)) - 1).alias("others"))


@query(
    "chrono_split",
    f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY ts, key) AS rn, count(*) OVER () AS total FROM scored)
SELECT CASE WHEN rn<=floor(total*0.6) THEN 'train' WHEN rn<=floor(total*0.8) THEN 'valid' ELSE 'test' END AS part, count(*) AS rows, round(min(ts),6) AS first_ts, round(max(ts),6) AS last_ts, round(avg(y*1.0),6) AS rate FROM r GROUP BY 1""",
)
def chrono_split(spark: SparkSession, sf: str) -> DataFrame:
    r = evaluation.ordered(scored(spark, sf), "ts", "key")
    part = F.when(F.col("rn") <= F.floor(F.col("total") * 0.6), "train").when(F.col("rn") <= F.floor(F.col("total") * 0.8), "valid").otherwise("test")
    return rounded(r.groupBy(part.alias("part")).agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.avg(F.col("y").cast("double")).alias("rate")))


@query("hash_split", "WITH h AS (SELECT md5(CAST(c_custkey AS VARCHAR)) AS m FROM customer) SELECT CAST(((CAST('0x' || m[1:16] AS UBIGINT) % 100)*16 + CAST('0x' || m[17:32] AS UBIGINT) % 100) % 100 AS INTEGER) AS bucket, count(*) AS rows FROM h GROUP BY 1")
def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").groupBy(amm.hash_bucket(F.col("c_custkey")).alias("bucket")).agg(F.count("*").alias("rows"))


@query(
    "keep_last_dedup",
    f"""WITH {LINES} SELECT key, max(n) AS last_n, round(arg_max(mid,n),9) AS last_mid, round(arg_min(mid,n),9) AS first_mid FROM tape GROUP BY key""",
)
def keep_last_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(lineitem_tape(spark, sf).groupBy("key").agg(F.max("n").alias("last_n"), F.max_by("mid", "n").alias("last_mid"), F.min_by("mid", "n").alias("first_mid")), 9)


@query(
    "event_pivot",
    f"""WITH {TAPE} SELECT key, """ + ", ".join(f"round(arg_max(sol,n) FILTER (WHERE kind='{k}'),6) AS {k}" for k in ("signup", "purchase", "error")) + " FROM tape GROUP BY key",
)
def event_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(events_tape(spark, sf).groupBy("key").pivot("kind", ["signup", "purchase", "error"]).agg(F.max_by("sol", "n")))


@query(
    "journal_rebuild",
    f"""WITH {TAPE}, j AS (SELECT key, max(CASE WHEN kind='signup' THEN n END) AS open_n, max(CASE WHEN kind='error' THEN n END) AS close_n, count(*) FILTER (WHERE kind='view') AS snaps FROM tape GROUP BY key)
SELECT key, open_n, close_n, snaps, CASE WHEN open_n IS NULL THEN 'none' WHEN close_n IS NULL OR close_n<open_n THEN 'open' ELSE 'closed' END AS state FROM j""",
)
def journal_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    latest = lambda k: F.max(F.when(F.col("kind") == k, F.col("n")))
    j = events_tape(spark, sf).groupBy("key").agg(latest("signup").alias("open_n"), latest("error").alias("close_n"), F.sum((F.col("kind") == "view").cast("long")).alias("snaps"))
    return j.withColumn("state", F.when(F.col("open_n").isNull(), "none").when(F.col("close_n").isNull() | (F.col("close_n") < F.col("open_n")), "open").otherwise("closed"))


@query(
    "slip_cap_sweep",
    f"""WITH {TAPE}, {ANCHOR}, f AS (SELECT key, max(CASE WHEN fwd=1 THEN ret END) AS slip, arg_max(ret,fwd) AS last_ret FROM fw GROUP BY key)
SELECT cap, count(*) AS orders, CAST(sum(CASE WHEN slip<=cap THEN 1 ELSE 0 END) AS BIGINT) AS filled, round(avg(CASE WHEN slip<=cap THEN (1+last_ret)/(1+slip)-1-0.025 ELSE -0.001 END),6) AS net_mean FROM f, (SELECT unnest([0.05::DOUBLE,0.2::DOUBLE,1.0::DOUBLE]) AS cap) GROUP BY cap""",
)
def slip_cap_sweep(spark: SparkSession, sf: str) -> DataFrame:
    f = _anchored(spark, sf).groupBy("key").agg(F.max(F.when(F.col("fwd") == 1, F.col("ret"))).alias("slip"), F.max_by("ret", "fwd").alias("last_ret"))
    each = f.withColumn("cap", F.explode(F.array(F.lit(0.05), F.lit(0.2), F.lit(1.0))))
    ok = F.col("slip") <= F.col("cap")
    net = F.when(ok, (1 + F.col("last_ret")) / (1 + F.col("slip")) - 1 - 0.025).otherwise(-0.001)
    return rounded(each.groupBy("cap").agg(F.count("*").alias("orders"), F.sum(ok.cast("long")).alias("filled"), F.avg(net).alias("net_mean")))


@query(
    "mdp_tables",
    f"""WITH {TAPE}, {ANCHOR}, s AS (SELECT key, fwd, CASE WHEN ret<-0.5 THEN 0 WHEN ret<0 THEN 1 WHEN ret<0.5 THEN 2 WHEN ret<1 THEN 3 ELSE 4 END AS state, ret FROM fw), t AS (SELECT *, lead(state) OVER w AS nxt, lead(ret) OVER w - ret AS reward FROM s WINDOW w AS (PARTITION BY key ORDER BY fwd))
SELECT state, nxt, count(*) AS moves, round(avg(reward),6) AS reward FROM t WHERE nxt IS NOT NULL GROUP BY 1,2""",
)
def mdp_tables(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("ret")
    s = _anchored(spark, sf).withColumn("state", F.when(r < -0.5, 0).when(r < 0, 1).when(r < 0.5, 2).when(r < 1, 3).otherwise(4))
    w = by_key("fwd")
    t = s.withColumns({"nxt": F.lead("state").over(w), "reward": F.lead("ret").over(w) - r}).filter("nxt is not null")
    return rounded(t.groupBy("state", "nxt").agg(F.count("*").alias("moves"), F.avg("reward").alias("reward")))


@query(
    "conditional_ladder",
    f"""WITH {TAPE}, {ANCHOR}, x AS (SELECT key, min(CASE WHEN ret>=0.5 THEN dt END) AS t50, min(CASE WHEN ret>=1.0 THEN dt END) AS t100 FROM fw GROUP BY key)
SELECT CASE WHEN t50<86400 THEN 'day' WHEN t50<604800 THEN 'week' ELSE 'later' END AS bucket, count(*) AS reached, CAST(sum(CASE WHEN t100 IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS next, round(avg(CASE WHEN t100 IS NOT NULL THEN 1.0 ELSE 0.0 END),6) AS p_next, round(quantile_cont(t100-t50,0.5),6) AS wait_p50 FROM x WHERE t50 IS NOT NULL GROUP BY 1""",
)
def conditional_ladder(spark: SparkSession, sf: str) -> DataFrame:
    x = _anchored(spark, sf).groupBy("key").agg(labels.first(F.col("ret") >= 0.5, "dt").alias("t50"), labels.first(F.col("ret") >= 1.0, "dt").alias("t100")).filter("t50 is not null")
    b = F.when(F.col("t50") < 86400, "day").when(F.col("t50") < 604800, "week").otherwise("later")
    hit = F.col("t100").isNotNull()
    x = x.select(b.alias("bucket"), hit.alias("hit"), (F.col("t100") - F.col("t50")).alias("wait"))
    reached = x.groupBy("bucket").agg(F.count("*").alias("reached"), F.sum(F.col("hit").cast("long")).alias("next"), F.avg(F.col("hit").cast("double")).alias("p_next"))
    return rounded(reached.join(evaluation.spread_by(x, "bucket", "wait", {"wait_p50": 0.5}), "bucket", "left"))


@query(
    "session_close",
    f"""WITH {TAPE}, g AS (SELECT *, CASE WHEN ts-lag(ts) OVER (PARTITION BY key ORDER BY n) < 86400.0 THEN 0 ELSE 1 END AS fresh FROM tape), s AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY n) AS sid FROM g)
SELECT key, round(min(ts),6) AS opened, round(max(ts)+86400,6) AS closes, count(*) AS rows, round(sum(sol),6) AS tot_sol FROM s GROUP BY key, sid""",
)
def session_close(spark: SparkSession, sf: str) -> DataFrame:
    rows = events_tape(spark, sf).withColumn("at", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))
    s = rows.groupBy("key", F.session_window("at", "86400 seconds").alias("w")).agg(F.count("*").alias("rows"), F.sum("sol").alias("tot_sol"))
    return rounded(s.select("key", (F.unix_micros("w.start") / 1e6).alias("opened"), (F.unix_micros("w.end") / 1e6).alias("closes"), "rows", "tot_sol"))


@query("tumbling_volume", "SELECT epoch_us(time_bucket(INTERVAL '1 day', ts))/1e6 AS day, event_type AS kind, count(*) AS rows, round(sum(value),6) AS volume FROM events GROUP BY 1,2")
def tumbling_volume(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    rows = e.groupBy(F.window(e["ts"].cast("timestamp"), "1 day").alias("w"), F.col("event_type").alias("kind")).agg(F.count("*").alias("rows"), F.sum("value").alias("volume"))
    return rounded(rows.select((F.unix_micros("w.start") / 1e6).alias("day"), "kind", "rows", "volume"))


@query(
    "top_k_selection",
    f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, key) AS rn, count(*) OVER () AS total FROM scored) SELECT key, round(score,6) AS score, y, round(CASE WHEN net<=1.0 THEN net ELSE 0.0 END,6) AS exec_net FROM r WHERE rn <= greatest(1, CAST(floor(total*0.02) AS BIGINT))""",
)
def top_k_selection(spark: SparkSession, sf: str) -> DataFrame:
    r = evaluation.ordered(scored(spark, sf), "score", "key", descending=True).filter(F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("total") * 0.02)))
    return rounded(r.select("key", "score", "y", F.when(F.col("net") <= 1.0, F.col("net")).otherwise(0.0).alias("exec_net")))


@query(
    "set_operations",
    """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus='F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus='O')
SELECT 'both' AS op, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'only_a', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)""",
)
def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    a, b = (o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in "FO")
    count = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return count(a.intersect(b), "both").union(count(a.union(b).distinct(), "either")).union(count(a.subtract(b), "only_a"))


@query(
    "feature_parity_diff",
    f"""WITH {TAPE}, a AS (SELECT key, avg(sol) AS m, max(sol) AS x, count(*)*1.0::DOUBLE AS c FROM tape GROUP BY 1), b AS (SELECT key, avg(sol) AS m, max(sol) AS x, count(*)*1.0::DOUBLE AS c FROM tape WHERE NOT failed GROUP BY 1),
d AS (SELECT 'mean' AS feature, a.m-b.m AS d FROM a JOIN b USING (key) UNION ALL SELECT 'max', a.x-b.x FROM a JOIN b USING (key) UNION ALL SELECT 'rows', a.c-b.c FROM a JOIN b USING (key))
SELECT feature, count(*) AS keys, round(avg(d),6) AS mean, round(quantile_cont(d,0.5),6) AS median, round(quantile_cont(abs(d),0.99),6) AS p99, round(avg(CASE WHEN abs(d)>1e-6 THEN 1.0 ELSE 0.0 END),6) AS differing FROM d GROUP BY 1""",
)
def feature_parity_diff(spark: SparkSession, sf: str) -> DataFrame:
    tape = events_tape(spark, sf)
    agg = lambda t, p: t.groupBy("key").agg(F.avg("sol").alias(f"mean{p}"), F.max("sol").alias(f"max{p}"), F.count("*").cast("double").alias(f"rows{p}"))
    both = agg(tape, "").join(agg(tape.filter("not failed"), "_b"), "key")
    d = both.select("key", *((F.col(c) - F.col(f"{c}_b")).alias(c) for c in ("mean", "max", "rows"))).unpivot("key", ["mean", "max", "rows"], "feature", "d")
    stats = d.groupBy("feature").agg(F.count("*").alias("keys"), F.avg("d").alias("mean"), F.avg((F.abs("d") > 1e-6).cast("double")).alias("differing"))
    middle = evaluation.spread_by(d, "feature", "d", {"median": 0.5})
    return rounded(stats.join(middle, "feature").join(evaluation.spread_by(d.withColumn("d", F.abs("d")), "feature", "d", {"p99": 0.99}), "feature"))


@query(
    "amm_round_trip",
    f"""WITH {TAPE}, b AS (SELECT key, n, vsol, vtok, sol*1e7 AS pay FROM tape), g AS (SELECT *, vtok - vsol*vtok/(vsol+pay) AS got FROM b)
SELECT key, n, round(got/1e6,4) AS got, round(((vsol+pay) - (vsol+pay)*(vtok-got)/(vtok-got+got))/pay - 1 - 0.025,6) AS net, round(greatest(0.0,least(1.0,(vsol/1e9-30)/85)),6) AS fill FROM g""",
)
def amm_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    b = events_tape(spark, sf).withColumn("pay", F.col("sol") * F.lit(1e7))
    g = b.withColumn("got", amm.buy_out(F.col("vsol"), F.col("vtok"), F.col("pay")))
    back = amm.sell_out(F.col("vsol") + F.col("pay"), F.col("vtok") - F.col("got"), F.col("got"))
    out = g.select("key", "n", F.round(F.col("got") / 1e6, 4).alias("got"), F.round(amm.net_return(back, F.col("pay"), 250.0, F.lit(0.0)), 6).alias("net"), F.round(amm.fill_share(F.col("vsol")), 6).alias("fill"))
    return out


@query(
    "correlation",
    f"""WITH {SCORED}, r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1)/2.0 AS rs, rank() OVER (ORDER BY net) + (count(*) OVER (PARTITION BY net) - 1)/2.0 AS rn FROM scored)
SELECT round(corr(score,net),6) AS pearson, round(corr(rs,rn),6) AS spearman FROM r""",
)
def correlation(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf)
    ranks = []
    for c in ("score", "net"):
        cum = evaluation.running(s.groupBy(c).agg(F.count("*").alias("m")), c, ["m"])
        ranks.append(cum.select(c, (F.col("cum_m") - F.col("m") + (F.col("m") + 1) / 2).alias(f"r_{c}")))
    both = s.join(ranks[0], "score").join(ranks[1], "net")
    return rounded(both.agg(F.corr("score", "net").alias("pearson"), F.corr("r_score", "r_net").alias("spearman")))


@query(
    "fire_contingency",
    f"""WITH {SCORED}, f AS (SELECT y, score>=0.6 AS a, net>=0.5 AS b FROM scored) SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'only_a' WHEN b THEN 'only_b' ELSE 'none' END AS cell, count(*) AS n, round(avg(y*1.0),6) AS precision FROM f GROUP BY 1""",
)
def fire_contingency(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("score") >= 0.6, F.col("net") >= 0.5
    return rounded(scored(spark, sf).groupBy(F.when(a & b, "both").when(a, "only_a").when(b, "only_b").otherwise("none").alias("cell")).agg(F.count("*").alias("n"), F.avg(F.col("y").cast("double")).alias("precision")))


@query(
    "rolling_cutoff",
    f"""WITH {TAPE} SELECT key, n, round(quantile_cont(mid,0.9) OVER (PARTITION BY key ORDER BY n ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),4) AS cutoff FROM tape""",
)
def rolling_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    return events_tape(spark, sf).select("key", "n", F.round(F.percentile("mid", 0.9).over(by_key().rowsBetween(-19, 0)), 4).alias("cutoff"))


@query(
    "restart_reconcile",
    """WITH chain AS (SELECT o_custkey AS k, count(*) AS held FROM orders WHERE o_orderstatus='O' GROUP BY 1), journal AS (SELECT o_custkey AS k, count(*) AS opened FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1)
SELECT coalesce(c.k, j.k) AS k, held, opened, CASE WHEN c.k IS NULL THEN 'drop' WHEN j.k IS NULL THEN 'adopt' ELSE 'restore' END AS action FROM chain c FULL JOIN journal j ON c.k=j.k""",
)
def restart_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    chain = o.filter("o_orderstatus = 'O'").groupBy("k").agg(F.count("*").alias("held"))
    journal = o.filter("o_orderpriority like '1%'").groupBy("k").agg(F.count("*").alias("opened"))
    return chain.join(journal, "k", "full_outer").withColumn("action", F.when(F.col("held").isNull(), "drop").when(F.col("opened").isNull(), "adopt").otherwise("restore"))


@query(
    "drift_flags",
    f"""WITH {SCORED}, h AS (SELECT *, ts > (SELECT quantile_cont(ts,0.5) FROM scored) AS late FROM scored), s AS (SELECT late, quantile_cont(score,0.9) AS p90, avg(CASE WHEN score>=0.8 THEN 1.0 ELSE 0.0 END) AS fires, avg(y*1.0) AS wins FROM h GROUP BY 1)
SELECT round(b.p90-a.p90,6) AS p90_shift, round(b.fires-a.fires,6) AS fire_shift, round(b.wins-a.wins,6) AS win_shift, CASE WHEN abs(b.wins-a.wins)>0.01 THEN 'wins' ELSE 'ok' END AS flag FROM s a, s b WHERE NOT a.late AND b.late""",
)
def drift_flags(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf)
    halves = s.crossJoin(F.broadcast(evaluation.quantiles(s, "ts", [0.5])))  # one row
    late = F.col("ts") > F.col("q0")
    p90 = [evaluation.quantiles(halves.filter(c).select("score"), "score", [0.9]).select(F.lit(v).alias("late"), F.col("q0").alias("p90")) for c, v in ((late, True), (~late, False))]
    h = halves.groupBy(late.alias("late")).agg(F.avg((F.col("score") >= 0.8).cast("double")).alias("fires"), F.avg(F.col("y").cast("double")).alias("wins")).join(p90[0].union(p90[1]), "late")
    d = lambda c: (F.max(F.when(F.col("late"), F.col(c))) - F.max(F.when(~F.col("late"), F.col(c))))
    out = h.agg(d("p90").alias("p90_shift"), d("fires").alias("fire_shift"), d("wins").alias("win_shift"))
    return rounded(out.withColumn("flag", F.when(F.abs("win_shift") > 0.01, "wins").otherwise("ok")))
