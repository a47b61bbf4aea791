"""Registered queries for the remaining operators. Same rules as :mod:`.catalog`."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import decode
from ..operators import boosting, features, labels
from ..sources.tape import by_key, events_tape, lineitem_tape, read
from .catalog import ANCHOR, LINES, MEMBERS, SCORED, STEPS, TAPE, _anchored, _members, query, rounded, scored


@query(
    "competition_features",
    f"""WITH {LINES} SELECT key, round(avg(tip),6) AS tip_mean, round(max(tip),6) AS tip_max, round(arg_max(tip, CASE WHEN tip>0 THEN n END)/arg_min(tip, CASE WHEN tip>0 THEN n END),6) AS escalation,
 round(avg(CASE WHEN failed THEN 1.0 ELSE 0.0 END),6) AS failed_rate, CAST(max(ts)/86400 - min(ts)/86400 AS BIGINT) AS slot_span FROM tape GROUP BY key""",
)
def competition_features(spark: SparkSession, sf: str) -> DataFrame:
    """Fees of rivals: mean, maximum, last over first that is not zero, span."""
    some = F.when(F.col("tip") > 0, F.col("n"))
    return rounded(
        lineitem_tape(spark, sf).groupBy("key").agg(
            F.avg("tip").alias("tip_mean"), F.max("tip").alias("tip_max"), (F.max_by("tip", some) / F.min_by("tip", some)).alias("escalation"), F.avg(F.col("failed").cast("double")).alias("failed_rate"), (F.max("slot") - F.min("slot")).alias("slot_span"),
        )
    )


@query(
    "curve_history",
    f"""WITH {TAPE}, x AS (SELECT key, min(n) AS cross_n FROM (SELECT *, first_value(mid) OVER (PARTITION BY key ORDER BY n) AS base FROM tape) WHERE mid>=2*base GROUP BY key)
SELECT x.key, cross_n, round(min(ts),6) AS first_t, round(arg_min(mid,n),6) AS launch_mid, round(max(mid),6) AS max_mid, count(*) AS ntr, CAST(sum(CASE WHEN is_buy THEN 1 ELSE 0 END) AS BIGINT) AS nbuy, round(sum(sol),6) AS vol, round(arg_max(rsol,n)/1e9,6) AS last_rsol FROM x JOIN tape t ON x.key=t.key AND t.n<x.cross_n GROUP BY 1,2""",
)
def curve_history(spark: SparkSession, sf: str) -> DataFrame:
    """What was known of a key before its cross, the cross itself excluded."""
    tape = events_tape(spark, sf)
    base = F.first("mid").over(by_key().rowsBetween(Window.unboundedPreceding, 0))
    x = tape.withColumn("base", base).filter(F.col("mid") >= 2 * F.col("base")).groupBy("key").agg(F.min("n").alias("cross_n"))
    part = tape.join(x, "key").filter("n < cross_n")
    return rounded(
        part.groupBy("key", "cross_n").agg(
            F.min("ts").alias("first_t"), F.min_by("mid", "n").alias("launch_mid"), F.max("mid").alias("max_mid"), F.count("*").alias("ntr"), F.sum(F.col("is_buy").cast("long")).alias("nbuy"), F.sum("sol").alias("vol"), (F.max_by("rsol", "n") / 1e9).alias("last_rsol"),
        )
    )


@query(
    "snapshot_fill_join",
    f"""WITH {TAPE}, {ANCHOR}, p AS (SELECT key, fwd, 0.5::DOUBLE + ret/10 AS p_rec FROM fw WHERE ret<-0.2) SELECT fw.key, fw.fwd, round(coalesce(p_rec,1.0),6) AS p_rec FROM fw LEFT JOIN p ON fw.key=p.key AND fw.fwd=p.fwd WHERE fw.fwd % 5 = 1""",
)
def snapshot_fill_join(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots at a cadence, with a score by (key, row), and a neutral value where there is none."""
    rows = _anchored(spark, sf)
    p = rows.filter("ret < -0.2").select("key", "fwd", (0.5 + F.col("ret") / 10).alias("p_rec"))
    return rounded(rows.filter("fwd % 5 = 1").select("key", "fwd").join(p, ["key", "fwd"], "left").fillna({"p_rec": 1.0}))


@query(
    "first_wins_lookup",
    """WITH m AS (SELECT l_suppkey AS s, arg_min(l_partkey, (l_orderkey*100+l_linenumber)*1000000+l_partkey) AS part FROM lineitem GROUP BY 1) SELECT s_suppkey, s_name, part FROM supplier LEFT JOIN m ON s=s_suppkey""",
)
def first_wins_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A mapping that the first row decides, looked up from another table."""
    i = read(spark, sf, "lineitem")
    m = i.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.min_by("l_partkey", (F.col("l_orderkey") * 100 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("part"))
    return read(spark, sf, "supplier").select("s_suppkey", "s_name").join(m, "s_suppkey", "left")


@query(
    "clock_interpolation",
    f"""WITH {TAPE}, e AS (SELECT min(slot) AS s0, arg_min(ts,slot*1000000+seq) AS t0, max(slot) AS s1, arg_max(ts,slot*1000000+seq) AS t1 FROM tape) SELECT key, round(max(t0+(slot-s0)*(t1-t0)/(s1-s0)),3) AS est_last, round(max(abs(t0+(slot-s0)*(t1-t0)/(s1-s0)-ts)),3) AS worst FROM tape, e GROUP BY key""",
)
def clock_interpolation(spark: SparkSession, sf: str) -> DataFrame:
    """Time from slots, by the line through the first and last rows of the tape."""
    tape = events_tape(spark, sf)
    o = F.col("slot") * 1000000 + F.col("seq")
    e = tape.agg(F.min("slot").alias("s0"), F.min_by("ts", o).alias("t0"), F.max("slot").alias("s1"), F.max_by("ts", o).alias("t1"))
    est = F.col("t0") + (F.col("slot") - F.col("s0")) * (F.col("t1") - F.col("t0")) / (F.col("s1") - F.col("s0"))
    return rounded(tape.crossJoin(F.broadcast(e)).groupBy("key").agg(F.max(est).alias("est_last"), F.max(F.abs(est - F.col("ts"))).alias("worst")), 3)  # one row


@query(
    "tip_tiers",
    f"WITH {TAPE} SELECT CASE WHEN mid>=100 THEN least(tip*2,150.0) WHEN mid>=30 THEN least(tip,80.0) ELSE 10.0 END AS bid, count(*) AS rows FROM tape GROUP BY 1",
)
def tip_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Bids by tier of price, each with its cap."""
    bid = F.when(F.col("mid") >= 100, F.least(F.col("tip") * 2, F.lit(150.0))).when(F.col("mid") >= 30, F.least(F.col("tip"), F.lit(80.0))).otherwise(10.0)
    return events_tape(spark, sf).groupBy(bid.alias("bid")).agg(F.count("*").alias("rows"))


@query(
    "feature_variance",
    f"""WITH {LINES}, s AS (SELECT stddev_pop(sol) AS sol, stddev_pop(mid) AS mid, stddev_pop(tip) AS tip, stddev_pop(1.0::DOUBLE) AS flat FROM tape) SELECT 'sol' AS feature, sol>0 AS kept, round(sol,4) AS sd FROM s UNION ALL SELECT 'mid', mid>0, round(mid,4) FROM s UNION ALL SELECT 'tip', tip>0, round(tip,4) FROM s UNION ALL SELECT 'flat', flat>0, round(flat,4) FROM s""",
)
def feature_variance(spark: SparkSession, sf: str) -> DataFrame:
    """Which columns vary at all: one pass over all of them."""
    names = ["sol", "mid", "tip", "flat"]
    s = lineitem_tape(spark, sf).withColumn("flat", F.lit(1.0)).agg(*(F.stddev_pop(c).alias(c) for c in names))
    return s.unpivot([], names, "feature", "sd").select("feature", (F.col("sd") > 0).alias("kept"), F.round("sd", 4).alias("sd"))


@query(
    "sell_latency",
    f"""WITH {TAPE}, {ANCHOR}, d AS (SELECT key, min(CASE WHEN ret>=0.5 THEN fwd END) AS hit FROM fw GROUP BY key), w AS (SELECT d.key, arg_min(ret,fwd) AS real, max(ret) AS opt, min(ret) AS pess FROM d JOIN fw ON fw.key=d.key AND fwd BETWEEN hit+1 AND hit+3 GROUP BY 1) SELECT key, round(real,6) AS real, round(opt,6) AS opt, round(pess,6) AS pess FROM w""",
)
def sell_latency(spark: SparkSession, sf: str) -> DataFrame:
    """What a sale decided at +50 % gets: the next row, and the best and worst of three."""
    rows = _anchored(spark, sf)
    hit = rows.groupBy("key").agg(labels.first(F.col("ret") >= 0.5).alias("hit"))
    near = rows.join(hit, "key").filter(F.col("fwd").between(F.col("hit") + 1, F.col("hit") + 3))
    return rounded(near.groupBy("key").agg(F.min_by("ret", "fwd").alias("real"), F.max("ret").alias("opt"), F.min("ret").alias("pess")))


@query(
    "sell_into_strength",
    f"""WITH {TAPE}, {ANCHOR}, d AS (SELECT key, min(CASE WHEN ret>=0.5 THEN dt END) AS t05 FROM fw GROUP BY key) SELECT fw.key, round(max(t05),6) AS t05, round(arg_min(ret,fwd),6) AS exit_ret FROM fw JOIN d ON fw.key=d.key AND dt>=t05+3600 GROUP BY 1""",
)
def sell_into_strength(spark: SparkSession, sf: str) -> DataFrame:
    """The first row an hour or more after +50 %."""
    rows = _anchored(spark, sf)
    t = rows.groupBy("key").agg(labels.first(F.col("ret") >= 0.5, "dt").alias("t05"))
    late = rows.join(t, "key").filter(F.col("dt") >= F.col("t05") + 3600)
    return rounded(late.groupBy("key").agg(F.max("t05").alias("t05"), F.min_by("ret", "fwd").alias("exit_ret")))


@query(
    "dwell_above",
    f"""WITH {TAPE}, {ANCHOR}, u AS (SELECT key, min(CASE WHEN ret>=0.5 THEN fwd END) AS up, max(fwd) AS last FROM fw GROUP BY key), d AS (SELECT fw.key, min(fwd) AS down FROM fw JOIN u ON fw.key=u.key AND fwd>up AND ret<0.5 GROUP BY 1)
SELECT u.key, up, down, coalesce(down,last+1)-up AS rows_above, down IS NULL AS open_ended FROM u LEFT JOIN d ON u.key=d.key WHERE up IS NOT NULL""",
)
def dwell_above(spark: SparkSession, sf: str) -> DataFrame:
    """From the first row at +50 % to the first one back under it; open-ended where there is none."""
    rows = _anchored(spark, sf)
    u = rows.groupBy("key").agg(labels.first(F.col("ret") >= 0.5).alias("up"), F.max("fwd").alias("last")).filter("up is not null")
    d = rows.join(u, "key").filter("fwd > up and ret < 0.5").groupBy("key").agg(F.min("fwd").alias("down"))
    return u.join(d, "key", "left").select("key", "up", "down", (F.coalesce("down", F.col("last") + 1) - F.col("up")).alias("rows_above"), F.col("down").isNull().alias("open_ended"))


@query(
    "record_envelope",
    f"""WITH {TAPE}, {ANCHOR}, r AS (SELECT *, max(ret) OVER w AS hi, min(ret) OVER w AS lo FROM fw WINDOW w AS (PARTITION BY key ORDER BY fwd ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT key, fwd, round(ret,6) AS ret, CASE WHEN hi IS NULL OR ret>hi THEN 'up' ELSE 'dn' END AS side FROM r WHERE hi IS NULL OR ret>hi OR ret<lo""",
)
def record_envelope(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that set a new high or low: a path's envelope."""
    w = by_key("fwd").rowsBetween(Window.unboundedPreceding, -1)
    r = _anchored(spark, sf).withColumns({"hi": F.max("ret").over(w), "lo": F.min("ret").over(w)})
    up = F.col("hi").isNull() | (F.col("ret") > F.col("hi"))
    return rounded(r.filter(up | (F.col("ret") < F.col("lo"))).select("key", "fwd", "ret", F.when(up, "up").otherwise("dn").alias("side")))


@query(
    "thinned_path",
    f"""WITH RECURSIVE {TAPE}, {ANCHOR}, r AS (SELECT key, 0 AS fwd, -1e18::DOUBLE AS last, FALSE AS kept FROM (SELECT DISTINCT key FROM fw) UNION ALL
SELECT f.key, f.fwd, CASE WHEN f.dt-r.last>=CASE WHEN f.dt<86400*7 THEN 86400 ELSE 86400*5 END THEN f.dt ELSE r.last END, f.dt-r.last>=CASE WHEN f.dt<86400*7 THEN 86400 ELSE 86400*5 END FROM r JOIN fw f ON f.key=r.key AND f.fwd=r.fwd+1)
SELECT key, fwd FROM r WHERE kept""",
)
def thinned_path(spark: SparkSession, sf: str) -> DataFrame:
    """Rows at least a day after the last one kept, five days after the first week: a fold, since it looks at what was
    kept."""
    path = _anchored(spark, sf).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("fwd", "dt"))).alias("path"))
    start = F.struct(F.lit(-1e18).alias("last"), F.array().cast("array<int>").alias("kept"))

    def step(s, r):
        ok = r["dt"] - s["last"] >= F.when(r["dt"] < 86400 * 7, 86400).otherwise(86400 * 5)
        return F.struct(F.when(ok, r["dt"]).otherwise(s["last"]).alias("last"), F.when(ok, F.concat(s["kept"], F.array(r["fwd"]))).otherwise(s["kept"]).alias("kept"))

    return path.select("key", F.explode(F.aggregate("path", start, step)["kept"]).alias("fwd"))


@query(
    "reputation_ratio",
    f"""WITH {MEMBERS}, s AS (SELECT *, count(y) OVER w AS seen, coalesce(sum(y) OVER w,0) AS won FROM m WINDOW w AS (PARTITION BY actor ORDER BY cross_ts, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT key, round(avg(CASE WHEN seen>0 THEN won*1.0::DOUBLE/seen ELSE 0.5 END),6) AS rep_mean, max(seen) AS most_seen FROM s GROUP BY key""",
)
def reputation_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Plain win rates, 0.5 for the unknown."""
    w = Window.partitionBy("actor").orderBy("cross_ts", "key").rowsBetween(Window.unboundedPreceding, -1)
    s = _members(spark, sf).withColumns({"seen": F.count("y").over(w), "won": F.coalesce(F.sum("y").over(w), F.lit(0))})
    return rounded(s.groupBy("key").agg(F.avg(F.when(F.col("seen") > 0, F.col("won") / F.col("seen")).otherwise(0.5)).alias("rep_mean"), F.max("seen").alias("most_seen")))


@query(
    "block_bootstrap",
    f"""WITH {SCORED}, b AS (SELECT CAST(floor(ts/7776000) AS BIGINT) AS blk, sum(net) AS s, count(*) AS c FROM scored WHERE score>=0.5 GROUP BY 1), k AS (SELECT i, blk, s, c, CAST(('0x' || md5(CAST(blk AS VARCHAR) || '/' || CAST(i AS VARCHAR))[1:8]) AS UBIGINT) % 3 AS times FROM b, (SELECT unnest(range(0,25)) AS i)), m AS (SELECT i, sum(s*times)/nullif(sum(c*times),0) AS mean FROM k GROUP BY i)
SELECT count(*) AS runs, round(quantile_cont(mean,0.1),6) AS low, round(quantile_cont(mean,0.9),6) AS high FROM m""",
)
def block_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of a quarter are drawn whole; each run sees sums of blocks, not rows."""
    b = scored(spark, sf).filter("score >= 0.5").groupBy(F.floor(F.col("ts") / 7776000).alias("blk")).agg(F.sum("net").alias("s"), F.count("*").alias("c"))
    k = b.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(24))))
    times = F.conv(F.substring(F.md5(F.concat_ws("/", F.col("blk").cast("string"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("long") % 3
    m = k.withColumn("t", times).groupBy("i").agg(F.try_divide(F.sum(F.col("s") * F.col("t")), F.sum(F.col("c") * F.col("t")).cast("double")).alias("mean"))
    return rounded(m.agg(F.count("*").alias("runs"), F.percentile("mean", 0.1).alias("low"), F.percentile("mean", 0.9).alias("high")))


@query(
    "tree_scores",
    f"""WITH {TAPE}, {STEPS.format(src="tape")} SELECT key, n, CASE WHEN gap IS NULL THEN 0.3 WHEN gap<43200 THEN CASE WHEN rel<0 THEN 0.2 ELSE 0.6 END ELSE CASE WHEN is_buy THEN 0.7 ELSE 0.4 END END::DOUBLE AS score FROM steps""",
)
def tree_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A small tree as a table of nodes, with a direction for missing values: first rows have no gap."""
    below = lambda x: math.nextafter(x, -math.inf)
    nodes = [("gap", math.inf, False, 1, 2), ("gap", below(43200.0), False, 3, 4), (0.3,), ("rel", below(0.0), False, 5, 6), ("is_buy", 0.5, False, 7, 8), (0.2,), (0.6,), (0.4,), (0.7,)]
    rows = features.steps(events_tape(spark, sf)).select("key", "n", "gap", "rel", F.col("is_buy").cast("double").alias("is_buy"))
    return boosting.score(boosting.Forest.of(["gap", "rel", "is_buy"], [nodes]), rows).select("key", "n", "score")


@query(
    "top_kinds",
    "WITH k AS (SELECT l_suppkey, l_returnflag, count(*) AS c FROM lineitem GROUP BY 1,2), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY c DESC, l_returnflag) AS r FROM k) SELECT l_suppkey, l_returnflag, c FROM r WHERE r<=2",
)
def top_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Most common values of each key, ties by value."""
    k = read(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("c"))
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("c"), "l_returnflag")
    return k.withColumn("r", F.row_number().over(w)).filter("r <= 2").drop("r")


@query("largest_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def largest_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The 25 largest, as a heap in each task."""
    return read(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query(
    "discriminator_profile",
    """SELECT event_type AS kind, length(props) AS len, count(*) AS rows, min(event_id) AS first_id FROM events GROUP BY 1,2""",
)
def discriminator_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Payload lengths of each kind of event."""
    return read(spark, sf, "events").groupBy(F.col("event_type").alias("kind"), F.length("props").alias("len")).agg(F.count("*").alias("rows"), F.min("event_id").alias("first_id"))


@query(
    "age_gate",
    f"WITH {TAPE}, g AS (SELECT *, ts - first_value(ts) OVER (PARTITION BY key ORDER BY n) AS age FROM tape) SELECT key, min(n) AS first_old, count(*) AS rows FROM g WHERE age>=2592000 GROUP BY key",
)
def age_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of keys that are at least a month old by then."""
    age = F.col("ts") - F.first("ts").over(by_key().rowsBetween(Window.unboundedPreceding, 0))
    return events_tape(spark, sf).withColumn("age", age).filter("age >= 2592000").groupBy("key").agg(F.min("n").alias("first_old"), F.count("*").alias("rows"))


@query(
    "position_pnl",
    f"""WITH {TAPE}, b AS (SELECT key, n, sol AS cost, row_number() OVER (PARTITION BY key ORDER BY n) AS i FROM tape WHERE kind='purchase'), s AS (SELECT key, n, sol AS got, row_number() OVER (PARTITION BY key ORDER BY n) AS i FROM tape WHERE kind='click')
SELECT b.key, b.i, round(got-cost,6) AS pnl, s.n-b.n AS gap FROM b JOIN s ON b.key=s.key AND b.i=s.i WHERE s.n>b.n""",
)
def position_pnl(spark: SparkSession, sf: str) -> DataFrame:
    """The i-th buy of a key against its i-th sale, when that is later."""
    tape = events_tape(spark, sf)
    side = lambda k, n, x: tape.filter(F.col("kind") == k).select("key", F.col("n").alias(n), F.col("sol").alias(x), F.row_number().over(by_key()).alias("i"))
    both = side("purchase", "bn", "cost").join(side("click", "sn", "got"), ["key", "i"]).filter("sn > bn")
    return rounded(both.select("key", "i", (F.col("got") - F.col("cost")).alias("pnl"), (F.col("sn") - F.col("bn")).alias("gap")))


@query(
    "failed_pressure",
    f"""WITH {TAPE} SELECT key, n, count(*) FILTER (WHERE failed) OVER w AS fails, count(DISTINCT CASE WHEN failed THEN actor END) OVER w AS failers, count(*) FILTER (WHERE failed) OVER (PARTITION BY key ORDER BY ts RANGE BETWEEN 604800.0 PRECEDING AND CURRENT ROW) AS recent FROM tape WINDOW w AS (PARTITION BY key ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def failed_pressure(spark: SparkSession, sf: str) -> DataFrame:
    """Failures before a row: how many, by how many actors, and in the last week."""
    before = by_key().rowsBetween(Window.unboundedPreceding, -1)
    bad = F.when(F.col("failed"), F.col("actor"))
    rows = events_tape(spark, sf).select("key", "n", "ts", bad.alias("bad"))
    # an actor counts at its first failure, so the distinct count is a running sum
    first = F.when(F.col("bad").isNotNull() & (F.row_number().over(Window.partitionBy("key", "bad").orderBy("n")) == 1), 1)
    rows = rows.withColumn("first", first)
    return rows.select("key", "n", F.count("bad").over(before).alias("fails"), F.count("first").over(before).alias("failers"), F.count("bad").over(by_key("ts").rangeBetween(-604800, 0)).alias("recent"))


@query(
    "before_after",
    f"""WITH {TAPE}, e AS (SELECT key, min(n) AS fire_n FROM tape WHERE kind='purchase' GROUP BY key) SELECT e.key, fire_n, round(avg(CASE WHEN n<fire_n THEN sol END),6) AS before_mean, round(avg(CASE WHEN n>fire_n THEN sol END),6) AS after_mean, count(*) AS rows FROM tape t JOIN e ON t.key=e.key AND n BETWEEN fire_n-5 AND fire_n+5 GROUP BY 1,2""",
)
def before_after(spark: SparkSession, sf: str) -> DataFrame:
    """Five rows on either side of a key's first purchase."""
    tape = events_tape(spark, sf)
    e = tape.filter("kind = 'purchase'").groupBy("key").agg(F.min("n").alias("fire_n"))
    near = tape.join(e, "key").filter("n between fire_n - 5 and fire_n + 5")
    return rounded(near.groupBy("key", "fire_n").agg(F.avg(F.when(F.col("n") < F.col("fire_n"), F.col("sol"))).alias("before_mean"), F.avg(F.when(F.col("n") > F.col("fire_n"), F.col("sol"))).alias("after_mean"), F.count("*").alias("rows")))


@query(
    "reputation_null",
    f"""WITH {MEMBERS}, a AS (SELECT DISTINCT actor, actor % 4 AS s FROM m), i AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY actor) AS i FROM a), j AS (SELECT actor AS other, s, row_number() OVER (PARTITION BY s ORDER BY md5(CAST(actor AS VARCHAR))) AS i FROM a), p AS (SELECT actor, other FROM i JOIN j USING (s, i)),
t AS (SELECT actor, avg(y*1.0::DOUBLE) AS rate FROM m GROUP BY 1), r AS (SELECT p.actor, x.rate AS own, z.rate AS dealt FROM p JOIN t x ON x.actor=p.actor JOIN t z ON z.actor=p.other)
SELECT m.key, round(avg(own),6) AS own, round(avg(dealt),6) AS dealt FROM m JOIN r ON r.actor=m.actor GROUP BY m.key""",
)
def reputation_null(spark: SparkSession, sf: str) -> DataFrame:
    """Rates of actors against those of others: a fixed bijection within strata, the null for identity."""
    m = _members(spark, sf)
    a = m.select("actor").distinct().withColumn("s", F.col("actor") % 4)
    i = a.withColumn("i", F.row_number().over(Window.partitionBy("s").orderBy("actor")))
    j = a.select("s", F.col("actor").alias("other"), F.row_number().over(Window.partitionBy("s").orderBy(F.md5(F.col("actor").cast("string")))).alias("i"))
    t = m.groupBy("actor").agg(F.avg(F.col("y").cast("double")).alias("own"))
    p = i.join(j, ["s", "i"]).select("actor", "other").join(t, "actor").join(t.select(F.col("actor").alias("other"), F.col("own").alias("dealt")), "other")
    return rounded(m.join(p.select("actor", "own", "dealt"), "actor").groupBy("key").agg(F.avg("own").alias("own"), F.avg("dealt").alias("dealt")))


@query(
    "exit_plan",
    f"""WITH {TAPE}, {ANCHOR}, t AS (SELECT key, arg_min(ret, CASE WHEN ret>=0.3 THEN fwd END) AS a, arg_min(ret, CASE WHEN ret>=1.0 THEN fwd END) AS b, arg_min(ret, CASE WHEN dt>=1209600 THEN fwd END) AS c, arg_max(ret,fwd) AS last FROM fw GROUP BY key)
SELECT key, round(0.5*coalesce(a,last)+0.3*coalesce(b,last)+0.2*coalesce(c,last),6) AS net FROM t""",
)
def exit_plan(spark: SparkSession, sf: str) -> DataFrame:
    """A plan of legs with fixed fractions: each leg is a first touch."""
    ret = F.col("ret")
    hit = lambda c: F.min_by("ret", F.when(c, F.col("fwd")))
    t = _anchored(spark, sf).groupBy("key").agg(hit(ret >= 0.3).alias("a"), hit(ret >= 1.0).alias("b"), hit(F.col("dt") >= 1209600).alias("c"), F.max_by("ret", "fwd").alias("last"))
    return rounded(t.select("key", (0.5 * F.coalesce("a", "last") + 0.3 * F.coalesce("b", "last") + 0.2 * F.coalesce("c", "last")).alias("net")))


@query("gbt_holdout")
def gbt_holdout(spark: SparkSession, sf: str) -> DataFrame:
    """Boosted trees on entry features, scored on keys that a hash leaves out."""
    from ..functions import amm
    from ..operators import models

    tape = lineitem_tape(spark, sf)
    x = features.entry(features.steps(tape), F.lit(5))
    best = labels.anchored(tape, 5).groupBy("key").agg((F.max("ret") >= 0.5).cast("int").alias("y"))
    rows = x.join(best, "key").withColumn("part", amm.hash_bucket(F.col("key")))
    return models.holdout(rows, ["win_ret", "dir_eff", "buy_frac", "uniq", "net_sol", "tot_sol", "single_actor_share", "entry_sol", "drawup", "drawdown"], "part < 70")


@query("decoded_events")
def decoded_events(spark: SparkSession, sf: str) -> DataFrame:
    """Round trip of made payloads through the decoder: one for each order."""
    word = lambda c: F.unhex(F.concat(*(F.substring(F.lpad(F.hex(c.cast("long")), 16, "0"), 2 * i + 1, 2) for i in range(7, -1, -1))))
    o = read(spark, sf, "orders")
    k, price = F.col("o_custkey"), F.col("o_totalprice") * 100
    zero = F.unhex(F.lit("00" * 24))
    key32 = F.concat(word(k), zero)
    data = F.concat(F.unhex(F.lit(decode.discriminator("TradeEvent", "event"))), key32, word(price), word(k), F.unhex(F.when(k % 2 == 0, "01").otherwise("00")), key32, *(word(F.col("o_orderkey")) for _ in range(5)))
    e = o.select("o_orderkey", decode.trade_event(data).alias("e"))
    return e.select("o_orderkey", F.col("e.sol").cast("long").alias("sol"), F.col("e.tok").cast("long").alias("tok"), "e.is_buy", F.col("e.rtok").cast("long").alias("rtok"))


from .catalog import ORACLE  # noqa: E402

ORACLE["decoded_events"] = "SELECT o_orderkey, CAST(floor(o_totalprice*100) AS BIGINT) AS sol, o_custkey AS tok, o_custkey % 2 = 0 AS is_buy, o_orderkey AS rtok FROM orders"
