"""Registered queries of reports and statistics over decisions and outcomes. Same rules as :mod:`.catalog`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluation, policies
from ..sources.tape import by_key, events_tape, lineitem_tape
from .catalog import ANCHOR, LINES, SCORED, TAPE, _anchored, query, rounded, scored
from .exits import RULES, _paths
from .exits import SQL as EXIT_SQL


@query("era_means", f"WITH {SCORED} SELECT grp % 4 AS era, count(*) AS closed, round(avg(net),6) AS mean_net, round(100.0*avg(CASE WHEN net>0 THEN 1.0 ELSE 0.0 END),6) AS win_pct, min(ts) AS start_t FROM scored GROUP BY 1")
def era_means(spark: SparkSession, sf: str) -> DataFrame:
    """Closed positions of each era: number, mean net, share of wins."""
    return rounded(scored(spark, sf).groupBy((F.col("grp") % 4).alias("era")).agg(F.count("*").alias("closed"), F.avg("net").alias("mean_net"), (100 * F.avg((F.col("net") > 0).cast("double"))).alias("win_pct"), F.min("ts").alias("start_t")))


@query(
    "sample_size",
    f"""WITH {SCORED}, p AS (SELECT floor(score*100+1e-6) AS pattern, avg(net) AS m, min(ts) AS first_seen FROM scored GROUP BY 1), s AS (SELECT avg(m) AS mu, stddev_samp(m) AS sd, count(*) AS n, (count(*)-1)/((max(first_seen)-min(first_seen))/86400.0) AS rate FROM p), z AS (SELECT * FROM (VALUES (90,1.645::DOUBLE),(95,1.96)) t(confidence,z))
SELECT confidence, n, round(mu,6) AS mean, round(sd,6) AS deviation, CAST(ceil(pow(z*sd/greatest(mu,1e-9),2)) AS BIGINT) AS need_positive, CAST(ceil(pow(z*0.5*sd/0.1,2)) AS BIGINT) AS need_difference, round(rate,6) AS per_day, round(greatest(0.0,500-n)/greatest(rate,1e-9),6) AS days_to_500 FROM s, z""",
)
def sample_size(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns needed to tell the mean from zero and two policies apart, how fast new ones arrive, days until 500."""
    p = scored(spark, sf).groupBy(F.floor(F.col("score") * 100 + 1e-6).alias("pattern")).agg(F.avg("net").alias("m"), F.min("ts").alias("seen"))
    days = (F.max("seen") - F.min("seen")) / 86400.0
    # all patterns seen first at one time: an infinite rate, or none that could be told of a single pattern
    rate = F.coalesce(F.try_divide(F.count("*") - 1, days), F.when((days == 0) & (F.count("*") > 1), F.lit(float("inf"))).when(days == 0, F.lit(float("nan"))))
    s = p.agg(F.avg("m").alias("mu"), F.stddev_samp("m").alias("sd"), F.count("*").alias("n"), rate.alias("rate"))
    each = s.withColumn("c", F.explode(F.array(F.struct(F.lit(90).alias("confidence"), F.lit(1.645).alias("z")), F.struct(F.lit(95).alias("confidence"), F.lit(1.96).alias("z")))))
    need = lambda sd, effect: F.ceil(F.pow(F.col("c.z") * sd / effect, 2))
    return rounded(each.select("c.confidence", "n", F.col("mu").alias("mean"), F.col("sd").alias("deviation"), need(F.col("sd"), F.greatest("mu", F.lit(1e-9))).alias("need_positive"), need(0.5 * F.col("sd"), F.lit(0.1)).alias("need_difference"), F.col("rate").alias("per_day"), (F.greatest(F.lit(0.0), 500.0 - F.col("n")) / F.greatest("rate", F.lit(1e-9))).alias("days_to_500")))


@query(
    "slow_and_spike",
    f"""WITH {SCORED}, w AS (SELECT score, ts, net, CASE WHEN grp%3=0 THEN 'slow' ELSE 'spike' END AS kind FROM scored WHERE y=1), m AS (SELECT 'score' AS feature, median(CASE WHEN kind='slow' THEN score END) AS slow, median(CASE WHEN kind='spike' THEN score END) AS spike FROM w UNION ALL SELECT 'net', median(CASE WHEN kind='slow' THEN net END), median(CASE WHEN kind='spike' THEN net END) FROM w)
SELECT feature, round(slow,6) AS slow, round(spike,6) AS spike, round(slow/spike,6) AS ratio FROM m""",
)
def slow_and_spike(spark: SparkSession, sf: str) -> DataFrame:
    """Medians of features of slow and of spiking winners, and their ratio."""
    w = scored(spark, sf).filter("y = 1").withColumn("slow", F.col("grp") % 3 == 0)
    out = None
    for feature in ("score", "net"):  # a fixed list
        slow, spike = (evaluation.quantiles(w.filter(c).select(feature), feature, [0.5]) for c in (F.col("slow"), ~F.col("slow")))
        row = slow.crossJoin(F.broadcast(spike.withColumnRenamed("q0", "p0"))).select(F.lit(feature).alias("feature"), F.col("q0").alias("slow"), F.col("p0").alias("spike"), F.try_divide("q0", "p0").alias("ratio"))  # one row each
        out = row if out is None else out.union(row)
    return rounded(out)


@query(
    "recent_outcomes",
    f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY grp%3 ORDER BY ts DESC, key DESC) AS b FROM scored), x AS (SELECT grp%3 AS lane, y=1 AS landed, score AS latency, net AS tip FROM r WHERE b<=500),
a AS (SELECT lane, landed, list_sort(list(latency)) AS l, list_sort(list(tip)) AS t, count(*) AS c FROM x GROUP BY 1,2)
SELECT lane, CAST(sum(c) AS BIGINT) AS outcomes, CAST(coalesce(sum(CASE WHEN landed THEN c END),0) AS BIGINT) AS landed, round(coalesce(sum(CASE WHEN landed THEN c END),0)/sum(c),6) AS land_rate, round(max(CASE WHEN landed THEN l[c//2+1] END),6) AS latency_p50, round(max(CASE WHEN landed THEN l[CAST(floor(c*0.9) AS INT)+1] END),6) AS latency_p90, round(max(CASE WHEN landed THEN t[c//2+1] END),6) AS tip_p50, round(max(CASE WHEN NOT landed THEN t[c//2+1] END),6) AS failed_tip_p50 FROM a GROUP BY lane""",
)
def recent_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """The last 500 outcomes of each lane: landing rate, order statistics of latency and tips (the limit is the report's)."""
    last = Window.partitionBy("lane").orderBy(F.desc("ts"), F.desc("key"))
    rows = scored(spark, sf).withColumn("lane", F.col("grp") % 3).withColumn("b", F.row_number().over(last)).filter("b <= 500")
    a = rows.groupBy("lane", (F.col("y") == 1).alias("ok")).agg(F.sort_array(F.collect_list("score")).alias("l"), F.sort_array(F.collect_list("net")).alias("t"), F.count("*").alias("c"))  # 500 at most
    at = lambda list_, share: F.get(list_, F.floor(F.col("c") * share).cast("int"))
    of = lambda ok, value: F.max(F.when(F.col("ok") == ok, value))
    landed = F.coalesce(F.sum(F.when(F.col("ok"), F.col("c"))), F.lit(0))
    return rounded(a.groupBy("lane").agg(F.sum("c").alias("outcomes"), landed.alias("landed"), (landed / F.sum("c")).alias("land_rate"), of(True, at("l", 0.5)).alias("latency_p50"), of(True, at("l", 0.9)).alias("latency_p90"), of(True, at("t", 0.5)).alias("tip_p50"), of(False, at("t", 0.5)).alias("failed_tip_p50")))


@query(
    "trailing_counts",
    f"""WITH {TAPE}, w AS (SELECT key, max(ts)-604800 AS cut FROM tape GROUP BY key), x AS (SELECT tape.* FROM tape JOIN w USING (key) WHERE ts>=cut)
SELECT key, count(CASE WHEN kind='purchase' THEN 1 END) AS landed, count(CASE WHEN kind='error' THEN 1 END) AS failed, count(CASE WHEN kind='click' THEN 1 END) AS fills, count(CASE WHEN kind IN ('view','signup') THEN 1 END) AS retries, arg_max(CASE WHEN kind='click' AND seq%3<>0 THEN slot END, CASE WHEN kind='click' AND seq%3<>0 THEN n END) AS last_slot FROM x GROUP BY key""",
)
def trailing_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by kind in the last stretch of time of each key, and the last slot that a fill tells."""
    tape = events_tape(spark, sf)
    end = tape.groupBy("key").agg((F.max("ts") - 604800).alias("cut"))
    x = tape.join(end, "key").filter("ts >= cut")
    n = lambda *kinds: F.count(F.when(F.col("kind").isin(*kinds), 1))
    told = (F.col("kind") == "click") & (F.col("seq") % 3 != 0)
    return x.groupBy("key").agg(n("purchase").alias("landed"), n("error").alias("failed"), n("click").alias("fills"), n("view", "signup").alias("retries"), F.max_by("slot", F.when(told, F.col("n"))).alias("last_slot"))


@query(
    "snapshot_cadences",
    f"""WITH {TAPE}, {ANCHOR} SELECT key, count(CASE WHEN (fwd-1)%3=0 AND (fwd-1)//3<80 THEN 1 END) AS live, count(CASE WHEN fwd>1 AND (fwd-1)%3=0 AND (fwd-1)//3<=80 THEN 1 END) AS replayed, max(CASE WHEN (fwd-1)%3=0 AND (fwd-1)//3<80 THEN fwd END) AS last_live, round(max(CASE WHEN fwd=4 THEN ret END),6) AS first_replayed FROM fw GROUP BY key""",
)
def snapshot_cadences(spark: SparkSession, sf: str) -> DataFrame:
    """Live snapshots (rows 1, 4, 7 ..., 80 at most) beside those of the replay, which begin at row 4."""
    rows = _anchored(spark, sf)
    live = policies.snapshots(rows, 3, 80).groupBy("key").agg(F.count("*").alias("live"), F.max("fwd").alias("last_live"))
    replayed = policies.snapshots(rows, 3, 80, shifted=True).groupBy("key").agg(F.count("*").alias("replayed"), F.max(F.when(F.col("i") == 0, F.col("ret"))).alias("first_replayed"))
    return rounded(live.join(replayed, "key", "left").select("key", "live", F.coalesce("replayed", F.lit(0).cast("long")).alias("replayed"), "last_live", "first_replayed"))


@query(
    "min_before_hit",
    f"""WITH {TAPE}, {ANCHOR}, h AS (SELECT key, min(CASE WHEN ret>=0.5 THEN fwd END) AS hit FROM fw GROUP BY key) SELECT key, round(min(ret),6) AS min_ret, hit IS NOT NULL AS hit_50 FROM fw JOIN h USING (key) WHERE hit IS NULL OR fwd<=hit GROUP BY key, hit""",
)
def min_before_hit(spark: SparkSession, sf: str) -> DataFrame:
    """The least return up to the first row at +50 %; of all rows, if there is none."""
    rows = _anchored(spark, sf)
    low = F.min("ret").over(by_key("fwd").rowsBetween(Window.unboundedPreceding, 0))
    hit = F.col("ret") >= 0.5
    out = rows.withColumn("low", low).groupBy("key").agg(F.min_by("low", F.when(hit, F.col("fwd"))).alias("at"), F.min("ret").alias("all"))
    return rounded(out.select("key", F.coalesce("at", "all").alias("min_ret"), F.col("at").isNotNull().alias("hit_50")))


@query(
    "closed_form_tp",
    f"""WITH {TAPE}, {ANCHOR}, t AS (SELECT key, max(ret) AS peak, arg_max(ret,fwd) AS term FROM fw GROUP BY key) SELECT CASE WHEN key%2=0 THEN 'even' ELSE 'odd' END AS part, count(*) AS n, count(CASE WHEN peak>=1 THEN 1 END) AS captures, round(avg(CASE WHEN peak>=1 THEN 1.0 ELSE term END-0.028),6) AS mean_ratio, round(avg(CASE WHEN CASE WHEN peak>=1 THEN 1.0 ELSE term END-0.028>0 THEN 1.0 ELSE 0.0 END),6) AS win_rate FROM t GROUP BY 1""",
)
def closed_form_tp(spark: SparkSession, sf: str) -> DataFrame:
    """What a take-profit at +100 % brings, from peak and last return alone."""
    t = _anchored(spark, sf).groupBy("key").agg(F.max("ret").alias("peak"), F.max_by("ret", "fwd").alias("term"))
    net = F.when(F.col("peak") >= 1, 1.0).otherwise(F.col("term")) - 0.028
    return rounded(t.groupBy(F.when(F.col("key") % 2 == 0, "even").otherwise("odd").alias("part")).agg(F.count("*").alias("n"), F.count(F.when(F.col("peak") >= 1, 1)).alias("captures"), F.avg(net).alias("mean_ratio"), F.avg((net > 0).cast("double")).alias("win_rate")))


@query(
    "stratified_split",
    f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY y, grp%8 ORDER BY md5(CAST(key AS VARCHAR))) AS i, count(*) OVER (PARTITION BY y, grp%8) AS c FROM scored)
SELECT y, CASE WHEN i<=floor(c*0.7) THEN 'train' ELSE 'test' END AS part, count(*) AS rows, round(avg(score),6) AS score FROM r GROUP BY 1,2""",
)
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    """70 / 30 within each label, at random by a hash and so the same on every run; labels are dealt over strata of groups,
    so that no task orders a whole class."""
    w = Window.partitionBy("y", F.col("grp") % 8)
    r = scored(spark, sf).withColumns({"i": F.row_number().over(w.orderBy(F.md5(F.col("key").cast("string")))), "c": F.count("*").over(w)})
    return rounded(r.groupBy("y", F.when(F.col("i") <= F.floor(F.col("c") * 0.7), "train").otherwise("test").alias("part")).agg(F.count("*").alias("rows"), F.avg("score").alias("score")))


@query("median_time_split", f"WITH {SCORED}, m AS (SELECT median(ts) AS cut FROM scored) SELECT ts>cut AS late, count(*) AS rows, round(avg(net),6) AS net FROM scored, m GROUP BY 1")
def median_time_split(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf)
    cut = evaluation.quantiles(s, "ts", [0.5])
    return rounded(s.crossJoin(F.broadcast(cut)).groupBy((F.col("ts") > F.col("q0")).alias("late")).agg(F.count("*").alias("rows"), F.avg("net").alias("net")))  # one row


@query(
    "rolling_cutoff_warm",
    f"""WITH {LINES}, s AS (SELECT key, n, mid/1000.0 AS score FROM tape), w AS (SELECT key, n, score, count(*) OVER f AS c, quantile_cont(score,0.9) OVER f AS q FROM s WINDOW f AS (PARTITION BY key ORDER BY n ROWS BETWEEN 499 PRECEDING AND CURRENT ROW))
SELECT key, n, round(CASE WHEN c>=20 THEN q ELSE 1.5 END,6) AS cutoff, score>=CASE WHEN c>=20 THEN q ELSE 1.5 END AS fires FROM w""",
)
def rolling_cutoff_warm(spark: SparkSession, sf: str) -> DataFrame:
    """The cutoff at a quantile of the last 500 scores, the row's own included; a default until there are enough."""
    w = by_key().rowsBetween(-499, 0)
    rows = lineitem_tape(spark, sf).withColumn("score", F.col("mid") / 1000.0)
    rows = rows.withColumns({"c": F.count("*").over(w), "q": F.percentile("score", 0.9).over(w)})
    cut = F.when(F.col("c") >= 20, F.col("q")).otherwise(1.5)
    return rounded(rows.select("key", "n", cut.alias("cutoff"), (F.col("score") >= cut).alias("fires")))


@query(
    "priority_and_age",
    f"""WITH {TAPE} SELECT key, round(max(ln(greatest(ts-t0,1e-3))),6) AS log_age, round(sum(coalesce(tip,0)*200000/1e6/1e9),9) AS priority_sol, count(CASE WHEN vsol>0 AND vtok>0 THEN 1 END) AS valid FROM (SELECT *, first_value(ts) OVER (PARTITION BY key ORDER BY n) AS t0 FROM tape) GROUP BY key""",
)
def priority_and_age(spark: SparkSession, sf: str) -> DataFrame:
    """Log of a key's age, priority fees at 200,000 units, rows with valid reserves."""
    t0 = F.first("ts").over(by_key().rowsBetween(Window.unboundedPreceding, 0))
    rows = events_tape(spark, sf).withColumn("t0", t0)
    out = rows.groupBy("key").agg(F.max(F.log(F.greatest(F.col("ts") - F.col("t0"), F.lit(1e-3)))).alias("log_age"), F.sum(F.coalesce("tip", F.lit(0.0)) * 200000 / 1e6 / 1e9).alias("priority_sol"), F.count(F.when((F.col("vsol") > 0) & (F.col("vtok") > 0), 1)).alias("valid"))
    return out.select("key", F.round("log_age", 6).alias("log_age"), F.round("priority_sol", 9).alias("priority_sol"), "valid")


@query(
    "collision_merge",
    f"""WITH {SCORED}, a AS (SELECT key, score, net FROM scored), b AS (SELECT key, score*2 AS score, y FROM scored WHERE key%3=0) SELECT a.key, a.score, a.net, b.score AS score__dup, b.y FROM a LEFT JOIN b USING (key)""",
)
def collision_merge(spark: SparkSession, sf: str) -> DataFrame:
    """A left join of two tables that share a column name: the right one gets a suffix; keys without a partner stay."""
    s = scored(spark, sf)
    b = s.filter("key % 3 = 0").select("key", (F.col("score") * 2).alias("score"), "y")
    a = s.select("key", "score", "net")
    clash = set(a.columns) & set(b.columns) - {"key"}
    return a.join(b.select(*(F.col(c).alias(f"{c}__dup" if c in clash else c) for c in b.columns)), "key", "left")


@query(
    "slot_bounded_join",
    f"""WITH {TAPE}, x AS (SELECT key, arg_min(slot,n) AS cross_slot FROM tape WHERE n>=5 GROUP BY key) SELECT x.key, count(t.seq) AS intents, count(DISTINCT t.actor) AS actors, max(t.slot) AS last_slot FROM x LEFT JOIN tape t ON t.key=x.key AND t.slot<=x.cross_slot AND t.kind='view' GROUP BY x.key""",
)
def slot_bounded_join(spark: SparkSession, sf: str) -> DataFrame:
    """Intents of a key up to the slot of its cross."""
    tape = events_tape(spark, sf)
    x = tape.filter("n >= 5").groupBy("key").agg(F.min_by("slot", "n").alias("cross_slot"))
    views = tape.filter("kind = 'view'").select("key", "slot", "seq", "actor")
    met = views.join(x, "key").filter("slot <= cross_slot").groupBy("key").agg(F.count("seq").alias("intents"), F.count_distinct("actor").alias("actors"), F.max("slot").alias("last_slot"))
    return x.join(met, "key", "left").select("key", F.coalesce("intents", F.lit(0)).alias("intents"), F.coalesce("actors", F.lit(0)).alias("actors"), "last_slot")


_CHOICES = ("k_combined", "h_time_spaced", "b_frontload", "level_tp_50", "level_tp_100")


@query(
    "policy_choice",
    "WITH n AS (" + " UNION ALL ".join(f"SELECT '{p}' AS policy, net FROM ({EXIT_SQL[p]})" for p in _CHOICES) + """), m AS (SELECT policy, avg(net) AS mean, count(*) AS fires FROM n GROUP BY 1), b AS (SELECT arg_max(policy, mean) AS best, max(mean) AS mean, max(CASE WHEN policy='k_combined' THEN mean END) AS now, min(fires) AS fires FROM m)
SELECT best, round(mean,6) AS mean, round(mean-now,6) AS uplift, CASE WHEN mean-now>=0.005 AND fires>=5 THEN best ELSE 'k_combined' END AS chosen FROM b""",
)
def policy_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Which policy to run: the best mean over all keys, if it beats the present one by enough on enough keys."""
    found = _paths(spark, sf)
    nets = None
    for name in _CHOICES:
        one = rounded(policies.replay(found, name, RULES)).select(F.lit(name).alias("policy"), "net")
        nets = one if nets is None else nets.union(one)
    means = nets.groupBy("policy").agg(F.avg("net").alias("mean"), F.count("*").alias("fires"))
    best = F.max_by(F.struct("policy", "mean"), F.struct("mean", "policy"))
    now = F.max(F.when(F.col("policy") == "k_combined", F.col("mean")))
    out = means.agg(best.alias("best"), now.alias("now"), F.min("fires").alias("fires"))
    uplift = F.col("best.mean") - F.col("now")
    return rounded(out.select(F.col("best.policy").alias("best"), F.col("best.mean").alias("mean"), uplift.alias("uplift"), F.when((uplift >= 0.005) & (F.col("fires") >= 5), F.col("best.policy")).otherwise("k_combined").alias("chosen")))


@query(
    "permuted_column",
    f"""WITH {SCORED}, o AS (SELECT key, grp, y, score, row_number() OVER (PARTITION BY grp%16 ORDER BY key) AS i, grp%16 AS s FROM scored), p AS (SELECT grp%16 AS s, score AS other, row_number() OVER (PARTITION BY grp%16 ORDER BY md5(CAST(key AS VARCHAR)), key) AS i FROM scored), j AS (SELECT o.*, other FROM o JOIN p USING (s,i)),
a AS (SELECT 'own' AS col, score AS v, y FROM j UNION ALL SELECT 'permuted', other, y FROM j), r AS (SELECT col, y, rank() OVER (PARTITION BY col ORDER BY v) + (count(*) OVER (PARTITION BY col, v) - 1)/2.0 AS r, count(*) OVER (PARTITION BY col) AS n FROM a), u AS (SELECT col, (sum(CASE WHEN y=1 THEN r END) - sum(y)*(sum(y)+1)/2.0)/(sum(y)*(count(*)-sum(y))) AS auc FROM r GROUP BY col)
SELECT round(max(CASE WHEN col='own' THEN auc END),6) AS auc, round(max(CASE WHEN col='own' THEN auc END)-max(CASE WHEN col='permuted' THEN auc END),6) AS importance FROM u""",
)
def permuted_column(spark: SparkSession, sf: str) -> DataFrame:
    """Permutation importance: how much the AUC falls when the score is dealt anew, within strata of groups."""
    s = scored(spark, sf).withColumn("s", F.col("grp") % 16)
    own = s.withColumn("i", F.row_number().over(Window.partitionBy("s").orderBy("key")))
    dealt = s.select("s", F.col("score").alias("other"), F.row_number().over(Window.partitionBy("s").orderBy(F.md5(F.col("key").cast("string")), "key")).alias("i"))
    both = own.join(dealt, ["s", "i"])
    a = evaluation.auc(both.select("score", "y")).select("auc")
    b = evaluation.auc(both.select(F.col("other").alias("score"), "y")).select(F.col("auc").alias("permuted"))
    return rounded(a.crossJoin(F.broadcast(b)).select("auc", (F.col("auc") - F.col("permuted")).alias("importance")))  # one row each


_IN_FORCE = [(0.0, "k_combined"), (1704067200.0, "level_tp_50"), (1735689600.0, "b_frontload")]


@query(
    "policy_backfill",
    "WITH n AS (" + " UNION ALL ".join(f"SELECT '{p}' AS policy, key, net FROM ({EXIT_SQL[p]})" for _, p in _IN_FORCE) + f"""), c AS (WITH {TAPE} SELECT key, max(ts) - 15552000*(key%5) AS t FROM tape GROUP BY key), l AS (SELECT * FROM (VALUES {", ".join(f"({t!r}::DOUBLE,'{p}')" for t, p in _IN_FORCE)}) x(since,policy)), i AS (SELECT key, arg_max(policy, since) AS policy FROM c JOIN l ON since<=t GROUP BY key)
SELECT i.key, i.policy, n.net FROM i JOIN n ON n.key=i.key AND n.policy=i.policy""",
)
def policy_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """What each closed key would have brought under the policy in force when it closed."""
    closes = events_tape(spark, sf).groupBy("key").agg((F.max("ts") - 15552000 * (F.first("key") % 5)).alias("t"))
    name = F.lit(None).cast("string")
    for since, policy in _IN_FORCE:  # a timeline of a few entries
        name = F.when(F.col("t") >= since, policy).otherwise(name)
    found, nets = _paths(spark, sf), None
    for _, policy in _IN_FORCE:
        one = rounded(policies.replay(found, policy, RULES)).select("key", F.lit(policy).alias("policy"), "net")
        nets = one if nets is None else nets.union(one)
    return closes.select("key", name.alias("policy")).join(nets, ["key", "policy"]).select("key", "policy", "net")


@query(
    "bootstrap_auc",
    f"""WITH {SCORED}, b AS (SELECT i, score, y, CAST(('0x' || md5(CAST(key AS VARCHAR) || '-' || CAST(i AS VARCHAR))[1:8]) AS UBIGINT)/4294967296.0::DOUBLE AS u FROM scored, (SELECT unnest(range(0,20)) AS i)), w AS (SELECT i, score, y, CASE WHEN u<0.36787944 THEN 0 WHEN u<0.73575888 THEN 1 WHEN u<0.9196986 THEN 2 WHEN u<0.98101184 THEN 3 WHEN u<0.99634015 THEN 4 ELSE 5 END AS k FROM b),
g AS (SELECT i, score, sum(k*y) AS p, sum(k*(1-y)) AS q FROM w GROUP BY 1,2), c AS (SELECT *, sum(q) OVER (PARTITION BY i ORDER BY score) - q AS below FROM g), a AS (SELECT i, sum(p*(below+q/2.0::DOUBLE))/(sum(p)*sum(q)) AS auc FROM c GROUP BY i)
SELECT count(*) AS runs, round(avg(auc),6) AS mean, round(quantile_cont(auc,0.05),6) AS low, round(quantile_cont(auc,0.95),6) AS high FROM a""",
)
def bootstrap_auc(spark: SparkSession, sf: str) -> DataFrame:
    """Poisson bootstrap of the area under the ROC curve: runs share the counts per distinct score."""
    rows = scored(spark, sf).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(19))))
    u = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("key").cast("string"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    k = F.when(u < 0.36787944, 0).when(u < 0.73575888, 1).when(u < 0.9196986, 2).when(u < 0.98101184, 3).when(u < 0.99634015, 4).otherwise(5)
    g = rows.withColumn("k", k).groupBy("i", "score").agg(F.sum(F.col("k") * F.col("y")).alias("p"), F.sum(F.col("k") * (1 - F.col("y"))).alias("q"))
    c = g.withColumn("below", F.sum("q").over(Window.partitionBy("i").orderBy("score")) - F.col("q"))
    a = c.groupBy("i").agg((F.sum(F.col("p") * (F.col("below") + F.col("q") / 2.0)) / (F.sum("p") * F.sum("q"))).alias("auc"))
    return rounded(a.agg(F.count("*").alias("runs"), F.avg("auc").alias("mean"), F.percentile("auc", 0.05).alias("low"), F.percentile("auc", 0.95).alias("high")))


@query(
    "creator_reputation",
    f"""WITH {SCORED} SELECT key, count(*) OVER w AS launches, coalesce(sum(CASE WHEN net>-2 THEN 1 ELSE 0 END) OVER w,0) AS resolved, round(coalesce(coalesce(sum(CASE WHEN net>-2 THEN y ELSE 0 END) OVER w,0)*1.0/nullif(coalesce(sum(CASE WHEN net>-2 THEN 1 ELSE 0 END) OVER w,0),0),0.5),6) AS winrate FROM scored WINDOW w AS (PARTITION BY grp ORDER BY ts, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def creator_reputation(spark: SparkSession, sf: str) -> DataFrame:
    """Launches of a creator before each of its launches, how many of them have resolved, and their win rate (0.5: unknown)."""
    w = Window.partitionBy("grp").orderBy("ts", "key").rowsBetween(Window.unboundedPreceding, -1)
    done = F.col("net") > -2
    zero = F.lit(0).cast("long")
    resolved, won = F.coalesce(F.sum(done.cast("int")).over(w), zero), F.coalesce(F.sum(F.when(done, F.col("y")).otherwise(0)).over(w), zero)
    return rounded(scored(spark, sf).select("key", F.count("*").over(w).alias("launches"), resolved.alias("resolved"), F.coalesce(F.try_divide(won, resolved), F.lit(0.5)).alias("winrate")))
