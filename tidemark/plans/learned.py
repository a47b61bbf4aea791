"""Registered queries on fitted models, gates and optimal stopping. Same rules as :mod:`.catalog`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boosting, features, gates
from ..sources.tape import by_key, events_tape
from .catalog import STEPS, TAPE, query, rounded

#: A fixed model over steps of the tape, with directions for missing values.
FOREST = boosting.Forest.of(
    ["gap", "rel", "sol", "tip"],
    [
        [("gap", 43200.0, False, 1, 2), ("rel", 0.0, True, 3, 4), ("sol", 60.0, True, 5, 6), (-0.4,), (0.2,), (0.1,), (0.35,)],
        [("tip", 40.0, True, 1, 2), (-0.15,), ("gap", 90000.0, True, 3, 4), (0.05,), (0.3,)],
        [("rel", 0.75, False, 1, 2), ("tip", 10.0, False, 3, 4), (-0.6,), (0.125,), (0.0,)],
    ],
    base=-0.25,
    logistic=True,
)
_STEPPED = f"WITH {TAPE}, {STEPS.format(src='tape')}"


@query("forest_scores", f"{_STEPPED} SELECT key, n, round(1/(1+exp(-({FOREST.sql()}))),6) AS score FROM steps")
def forest_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A forest as a table of nodes, walked level by level for whole batches; gaps are missing on first rows."""
    return rounded(boosting.score(FOREST, features.steps(events_tape(spark, sf)).select("key", "n", "gap", "rel", "sol", "tip")).select("key", "n", "score"))


#: Ends of bins, so that SQL can sum the same histograms.
CUTS = {"gap": [3600.0 * h for h in (12, 24, 72, 168, 336)], "rel": [-0.5, -0.2, 0.0, 0.5, 1.0, 3.0], "sol": [10.0, 25.0, 50.0, 100.0, 200.0]}


def _split_sql() -> str:
    cuts = " UNION ALL ".join(f"SELECT '{f}' AS feature, {c!r}::DOUBLE AS cut, {f} AS x, g, h FROM r" for f, cs in CUTS.items() for c in cs)
    return f"""{_STEPPED}, y AS (SELECT gap, rel, sol, CASE WHEN lead(mid) OVER (PARTITION BY key ORDER BY n) > mid THEN 1.0 ELSE 0.0 END AS y FROM steps), p AS (SELECT avg(y) AS p FROM y), r AS (SELECT y.*, p-y AS g, p*(1-p) AS h FROM y, p),
s AS (SELECT feature, cut, sum(g) AS ga, sum(h) AS ha, count(*) AS na, coalesce(sum(g) FILTER (WHERE x<=cut),0) AS gl, coalesce(sum(h) FILTER (WHERE x<=cut),0) AS hl, count(*) FILTER (WHERE x<=cut) AS nl, coalesce(sum(g) FILTER (WHERE x IS NULL),0) AS gm, coalesce(sum(h) FILTER (WHERE x IS NULL),0) AS hm, count(*) FILTER (WHERE x IS NULL) AS nm FROM ({cuts}) GROUP BY 1, 2),
d AS (SELECT feature, cut, TRUE AS missing_left, ga, ha, na, gl+gm AS gl, hl+hm AS hl, nl+nm AS nl FROM s WHERE nm>0 UNION ALL SELECT feature, cut, CASE WHEN nm>0 THEN FALSE ELSE 2*nl>na END, ga, ha, na, gl, hl, nl FROM s),
k AS (SELECT *, gl*gl/(hl+1)+(ga-gl)*(ga-gl)/(ha-hl+1)-ga*ga/(ha+1) AS gain FROM d WHERE nl>=20 AND na-nl>=20)
SELECT feature, cut AS threshold, missing_left, round(-0.1*gl/(hl+1),6) AS left_value, round(-0.1*(ga-gl)/(ha-hl+1),6) AS right_value FROM k ORDER BY gain DESC LIMIT 1"""


@query("gbt_first_split", _split_sql())
def gbt_first_split(spark: SparkSession, sf: str) -> DataFrame:
    """The first split of boosted trees that tell whether the next price is higher: histograms summed by Spark."""
    steps = features.steps(events_tape(spark, sf))
    rows = steps.select("gap", "rel", "sol", F.coalesce((F.lead("mid").over(by_key()) > F.col("mid")).cast("int"), F.lit(0)).alias("y"))
    forest = boosting.fit(rows, list(CUTS), trees=1, depth=1, cuts=list(CUTS.values()))
    at = {r[1]: r for r in forest.rows()}
    root = at[0]
    return rounded(spark.createDataFrame([(root[2], root[3], root[4], at[root[5]][7], at[root[6]][7])], "feature string, threshold double, missing_left boolean, left_value double, right_value double"))


#: Purchases as signals: a position lasts to the key's next event, a month at most.
RULES = gates.Rules(concurrent=4, fires=3, per=7200.0, loss=-1.5, least=5, window=12, fail_rate=0.6, cooldown=6 * 3600.0)
_GATE_SQL = f"""WITH RECURSIVE {TAPE}, s AS (SELECT key, n, seq, ts AS t, least(coalesce(lead(ts) OVER w, ts+86400.0), ts+2592000.0) AS closes, greatest(-1.0, least(1.0, coalesce(lead(mid) OVER w/mid-1, 0.0))) AS gain, coalesce(lead(mid) OVER w < mid, FALSE) AS failed, kind FROM tape WINDOW w AS (PARTITION BY key ORDER BY n)),
c AS (SELECT *, row_number() OVER (ORDER BY t, seq) AS i FROM s WHERE kind='purchase'),
m AS (SELECT 0::BIGINT AS i, 'start' AS verdict, '-infinity'::DOUBLE AS until, []::STRUCT(c DOUBLE, o BIGINT, g DOUBLE, f BOOLEAN)[] AS held, []::DOUBLE[] AS recent, 0::BIGINT AS closed, []::BOOLEAN[] AS ends, 0.0::DOUBLE AS lost
UNION ALL SELECT i, v, CASE WHEN v IN ('loss','failures') THEN t+{RULES.cooldown!r} ELSE until END, CASE WHEN v='fire' THEN list_sort(list_append(held, {{'c': closes, 'o': i, 'g': gain, 'f': failed}})) ELSE held END, CASE WHEN v='fire' THEN list_append(recent, t) ELSE recent END, closed, ends, lost
FROM (SELECT *, CASE WHEN t<until THEN 'cooldown' WHEN len(held)>={RULES.concurrent} THEN 'concurrent' WHEN len(recent)>={RULES.fires} THEN 'rate' WHEN closed>={RULES.least} AND lost<={RULES.loss!r} THEN 'loss' WHEN len(ends)>={RULES.window} AND len(list_filter(ends, lambda x: x))/len(ends)::DOUBLE>{RULES.fail_rate!r} THEN 'failures' ELSE 'fire' END AS v
FROM (SELECT c.i, c.t, c.closes, c.gain, c.failed, m.until, list_filter(m.held, lambda x: x.c>c.t) AS held, list_filter(m.recent, lambda x: x>=c.t-{RULES.per!r}) AS recent, m.closed+len(list_filter(m.held, lambda x: x.c<=c.t)) AS closed,
 list_concat(m.ends, list_transform(list_filter(m.held, lambda x: x.c<=c.t), lambda x: x.f))[-{RULES.window}:] AS ends, m.lost+coalesce(list_sum(list_transform(list_filter(m.held, lambda x: x.c<=c.t), lambda x: x.g)),0) AS lost FROM m JOIN c ON c.i=m.i+1)))
SELECT c.key, c.n, m.verdict FROM m JOIN c USING (i)"""


@query("global_risk_gates", _GATE_SQL)
def global_risk_gates(spark: SparkSession, sf: str) -> DataFrame:
    """One gate over all keys: concurrency, rate, loss, failures, cooldown."""
    w = by_key()
    following = F.lead("mid").over(w)
    s = events_tape(spark, sf).select(
        "key", "n", "seq", "kind", F.col("ts").alias("t"), F.least(F.coalesce(F.lead("ts").over(w), F.col("ts") + 86400), F.col("ts") + 2592000).alias("close"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(following / F.col("mid") - 1, F.lit(0.0)))).alias("gain"), F.coalesce(following < F.col("mid"), F.lit(False)).alias("failed"),
    )
    return gates.decide(s.filter("kind = 'purchase'").drop("kind"), RULES).select("key", "n", "verdict")
