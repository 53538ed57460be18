"""Queries over job logs: queues, lifecycles, staleness, batches, soak runs, packages and candidate scores; and calibration fits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from huestrata.functions import color as c
from huestrata.operators import clustering as cl
from huestrata.operators.relations import tasks_for
from huestrata.plans.registry import query
from huestrata.plans.selection import pairs
from huestrata.sources.tables import SWATCHES_SQL, swatches, table
from huestrata.streaming import jobs

R = lambda x, n=6: F.round(x, n)

# --- jobs -------------------------------------------------------------------------------------


def seconds(column="ts"):
    return F.unix_micros(F.col(column).cast("timestamp")) / 1e6


@query("sm01_sampled_status")
def sm01(spark, sf):
    """A sampled task per event; a user is a middleware with a queue. Work is in hours, so that queues fill up."""
    k = F.col("event_id")
    e = table(spark, sf, "events").select(F.col("user_id").alias("middleware"), "event_id", seconds().alias("at"), (F.col("value") * 3600).alias("work"), (F.pmod(F.xxhash64(k), F.lit(10)) < 7).alias("sampled"))
    return jobs.sampled_queue(e, limit=6, workers=2, timeout=200 * 3600.0)


@query("sm02_latest_wins", "WITH j AS (SELECT event_id AS job, user_id, epoch_us(ts)/1e6 AS made, epoch_us(ts)/1e6+value*600 AS ends FROM events) SELECT job, CASE WHEN lead(made) OVER (PARTITION BY user_id ORDER BY made, job) < ends THEN 'SUPERSEDED' ELSE 'COMPLETED' END AS status FROM j")
def sm02(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("job"), F.col("user_id").alias("view_key"), seconds().alias("made_at"), (seconds() + F.col("value") * 600).alias("end_at"))
    return jobs.latest_wins(e)


@query("sm03_staleness", """WITH m AS (SELECT user_id, ts, epoch_us(ts)/1e6 AS at, [event_id//3000, user_id%7, floor(value/40)::BIGINT, event_id%4] AS who FROM events WHERE event_type IN ('view','signup')),
    j AS (SELECT event_id AS job, user_id, unnest(['made','run','end']) AS moment, unnest([epoch_us(ts)/1e6, epoch_us(ts)/1e6+value*200, epoch_us(ts)/1e6+value*800]) AS at FROM events WHERE event_type NOT IN ('view','signup')),
    k AS (SELECT j.job, j.moment, m.who FROM j ASOF LEFT JOIN m ON j.user_id = m.user_id AND j.at >= m.at), p AS (SELECT job, max(who) FILTER (WHERE moment='made') AS a, max(who) FILTER (WHERE moment='run') AS b, max(who) FILTER (WHERE moment='end') AS c FROM k GROUP BY 1)
    SELECT job, CASE WHEN a IS DISTINCT FROM b THEN 'STALE_ROUTE_OR_GENERATION' WHEN a IS DISTINCT FROM c THEN 'STALE_AFTER_WORK' ELSE 'COMPLETED' END AS status FROM p""")
def sm03(spark, sf):
    """Views and sign-ups move a user's view; other events are jobs that run and end later."""
    e, k = table(spark, sf, "events"), F.col("event_id")
    moving = F.col("event_type").isin("view", "signup")
    moves = e.where(moving).select(F.col("user_id").alias("view_key"), seconds().alias("at"), F.floor(k / 3000).alias("generation"), (F.col("user_id") % 7).alias("view"), F.floor(F.col("value") / 40).alias("route"), (k % 4).alias("request"))
    work = e.where(~moving).select(k.alias("job"), F.col("user_id").alias("view_key"), seconds().alias("made_at"), (seconds() + F.col("value") * 200).alias("run_at"), (seconds() + F.col("value") * 800).alias("end_at"))
    return jobs.staleness(work, moves)


def job_log(spark, sf):
    """Events read as a job log: views are users, kinds follow the event id."""
    k = F.col("event_id")
    kind = F.when(k % 3 == 0, "START").when(k % 3 == 1, "FULL").otherwise("END")
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("view"), kind.alias("kind"), F.floor(k / 3).alias("job"), F.floor(k / 30).alias("generation"), seconds().alias("at"), (k % 2).alias("snapshot"))


@query("sm04_lifecycle")
def sm04(spark, sf):
    return jobs.lifecycle_batch(job_log(spark, sf))


BATCH_SQL = "b AS (SELECT event_id, CASE event_id%5 WHEN 0 THEN 'FULL' WHEN 4 THEN 'PART' ELSE 'DELTA' END AS mode, CASE WHEN event_id%10=0 THEN 0 ELSE event_id%4*30-CASE WHEN event_id%97=0 THEN 1000 ELSE 0 END END AS s, event_id%4*30+event_id%3*20-10 AS e, event_id%4*30+event_id%7*10 AS seen, CASE WHEN event_id%3=0 THEN 's' || event_id//7 WHEN event_id%3=1 THEN '' END AS base FROM events)"


@query("sm05_batches", f"""WITH {BATCH_SQL}, f AS (SELECT event_id, list_filter([CASE WHEN mode NOT IN ('FULL','DELTA') THEN 'mode' END, CASE WHEN s < 0 THEN 'start' END, CASE WHEN e < s THEN 'end' END, CASE WHEN seen < e THEN 'seen' END, CASE WHEN mode='FULL' AND s <> 0 THEN 'full_start' END, CASE WHEN mode='FULL' AND base IS NOT NULL THEN 'full_base' END, CASE WHEN mode='DELTA' AND s > 0 AND coalesce(base,'') = '' THEN 'delta_base' END], lambda x: x IS NOT NULL) AS faults FROM b)
    SELECT event_id, faults, len(faults) = 0 AS accepted FROM f""")
def sm05(spark, sf):
    k = F.col("event_id")
    mode = F.when(k % 5 == 0, "FULL").when(k % 5 == 4, "PART").otherwise("DELTA")
    start = F.when(k % 10 == 0, 0).otherwise(k % 4 * 30 - F.when(k % 97 == 0, 1000).otherwise(0))
    base = F.when(k % 3 == 0, F.concat(F.lit("s"), F.floor(k / 7).cast("string"))).when(k % 3 == 1, "")
    faults = jobs.batch_faults(mode, start, k % 4 * 30 + k % 3 * 20 - 10, k % 4 * 30 + k % 7 * 10, base)
    return table(spark, sf, "events").select("event_id", faults.alias("faults")).withColumn("accepted", F.size("faults") == 0)


# --- soak runs --------------------------------------------------------------------------------

#: Jobs of soak runs end as their phase says; runs are customers' segments by nation, so they grow in number with the table.
SOAK_SQL = """r AS (SELECT DISTINCT c_custkey//10 AS run FROM customer), j AS (SELECT run, job, CASE WHEN job <= 50 THEN 'WARMUP' WHEN job <= 250 THEN 'NORMAL' WHEN job <= 350 THEN 'DELTA_STRESS' WHEN job <= 425 THEN 'ABORT_STORM' WHEN job <= 475 THEN 'ROUTE_STORM' ELSE 'RECOVERY' END AS phase, (run*31+job*17)%97/10.0::DOUBLE AS ms FROM r, range(1,501) t(job))"""


@query("sm06_status_counts", f"WITH {SOAK_SQL} SELECT run, count(*) FILTER (WHERE phase NOT IN ('ABORT_STORM','ROUTE_STORM')) AS completed, count(*) FILTER (WHERE phase = 'ABORT_STORM') AS aborted, count(*) FILTER (WHERE phase = 'ROUTE_STORM') AS stale, 0::BIGINT AS error FROM j GROUP BY 1")
def sm06(spark, sf):
    """How the 500 jobs of each run end, by the lifecycle of their log."""
    customers = table(spark, sf, "customer")
    runs = customers.select(F.floor(F.col("c_custkey") / 10).alias("run")).distinct().repartition(tasks_for(customers, 50_000), "run")  # each becomes 500 jobs
    s = jobs.lifecycle_batch(jobs.soak_events(jobs.soak_plan(runs))).where(F.col("status") != "ACTIVE")
    n = lambda *k: F.count_if(F.col("status").isin(*k))
    return s.groupBy(F.col("view").cast("long").alias("run")).agg(n("COMPLETED").alias("completed"), n("ABORTED").alias("aborted"), n("STALE").alias("stale"), n("SUPERSEDED", "REJECTED").alias("error"))


@query("sm06_phase_latency", f"WITH {SOAK_SQL} SELECT run, phase, count(*) AS samples, quantile_disc(ms,0.5) AS p50, quantile_disc(ms,0.95) AS p95, quantile_disc(ms,0.99) AS p99, max(ms) AS most FROM j GROUP BY 1,2")
def sm06_latency(spark, sf):
    runs = table(spark, sf, "customer").select(F.floor(F.col("c_custkey") / 10).alias("run")).distinct()
    p = jobs.soak_plan(runs).withColumn("ms", (F.col("run") * 31 + F.col("job") * 17) % 97 / 10.0)
    at = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY ms)")
    return p.groupBy("run", "phase").agg(F.count(F.lit(1)).alias("samples"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max("ms").alias("most"))


@query("sm06_memory", """WITH h AS (SELECT DISTINCT c_custkey//10 AS run FROM customer), p AS (SELECT run, i*50 AS job, 60000000+i*50*(run%5*12000)+CASE WHEN run%3=0 THEN 0 ELSE (i*run)%4*40000 END AS heap, row_number() OVER (PARTITION BY run ORDER BY i DESC) AS back, lag(60000000+i*50*(run%5*12000)+CASE WHEN run%3=0 THEN 0 ELSE (i*run)%4*40000 END) OVER (PARTITION BY run ORDER BY i) AS prev FROM h, range(1,11) t(i)),
    a AS (SELECT run, arg_max(heap,job)-arg_min(heap,job) AS growth, regr_slope(heap,job) AS slope, bool_and(heap > prev) FILTER (WHERE back <= 4) AS rising FROM p GROUP BY 1) SELECT run, growth, round(slope,3) AS slope, rising, CASE WHEN growth > 20971520 AND rising AND slope > 20480 THEN 'WARN_POSSIBLE_UNBOUNDED_GROWTH' ELSE 'PASS_NO_UNBOUNDED_GROWTH_SIGNAL' END AS status FROM a""")
def sm06_memory(spark, sf):
    runs = table(spark, sf, "customer").select(F.floor(F.col("c_custkey") / 10).alias("run")).distinct()
    i, run = F.col("i"), F.col("run")
    p = runs.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(10)))).select("run", (i * 50).alias("job"), (60000000 + i * 50 * (run % 5 * 12000) + F.when(run % 3 == 0, 0).otherwise(i * run % 4 * 40000)).alias("heap"))
    w = Window.partitionBy("run")
    p = p.withColumns({"back": F.row_number().over(w.orderBy(F.desc("job"))), "prev": F.lag("heap").over(w.orderBy("job"))})
    a = p.groupBy("run").agg((F.max_by("heap", "job") - F.min_by("heap", "job")).alias("growth"), F.regr_slope("heap", "job").alias("slope"), F.bool_and(F.when(F.col("back") <= 4, F.col("heap") > F.col("prev"))).alias("rising"))
    bad = (F.col("growth") > jobs.HEAP_GROWTH) & F.col("rising") & (F.col("slope") > jobs.HEAP_SLOPE)
    return a.withColumns({"slope": R("slope", 3), "status": F.when(bad, "WARN_POSSIBLE_UNBOUNDED_GROWTH").otherwise("PASS_NO_UNBOUNDED_GROWTH_SIGNAL")})


# --- packages ---------------------------------------------------------------------------------


@query("sm09_package_state", """WITH p AS (SELECT o_custkey AS chain, o_orderkey AS package, CASE WHEN o_totalprice < 5000 THEN 'REJECTED' WHEN o_orderstatus = 'F' THEN 'PASS' WHEN o_orderstatus = 'P' THEN 'FAIL' WHEN o_orderpriority LIKE '1%' THEN 'NEW' ELSE 'HOLD' END AS own FROM orders),
    u AS (SELECT *, coalesce(bool_and(own = 'PASS') OVER w, true) AS up, arg_min(package, package) FILTER (WHERE own <> 'PASS') OVER w AS block FROM p WINDOW w AS (PARTITION BY chain ORDER BY package ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT package, CASE WHEN own = 'REJECTED' THEN own WHEN NOT up THEN 'WAITING_UPSTREAM_GATE' WHEN own = 'NEW' THEN 'READY' ELSE own END AS state, CASE WHEN own <> 'REJECTED' AND NOT up THEN 'UPSTREAM_NOT_PASS:' || block END AS reason FROM u""")
def sm09(spark, sf):
    """State of every package: its own result if all before it in its chain passed, else it waits and says for which; bad ones are rejected."""
    s = F.col("o_orderstatus")
    own = F.when(F.col("o_totalprice") < 5000, "REJECTED").when(s == "F", "PASS").when(s == "P", "FAIL").when(F.col("o_orderpriority").startswith("1"), "NEW").otherwise("HOLD")
    p = table(spark, sf, "orders").select(F.col("o_custkey").alias("chain"), F.col("o_orderkey").alias("package"), own.alias("own"))
    return jobs.package_states(p).select("package", "state", "reason")


@query("sm11_candidate_score", f"""WITH {SWATCHES_SQL}, k AS (SELECT id, id//50 AS pool, id%50+1 AS production_rank, CASE WHEN id%6=0 THEN 0.5 ELSE (id*7919)%1000/1000.0 END AS clip, greatest(0,least(1,L)) AS l, greatest(0,least(1,C/0.25)) AS c, coalesce(0.5+0.5*cos(H/180*pi()),0.5) AS h FROM swatches), s AS (SELECT *, round(0.55*clip+0.2*l+0.2*c+0.05*h,9) AS score FROM k),
    d AS (SELECT *, CASE WHEN abs(score-0.5) >= 0.25 THEN 'HIGH' WHEN abs(score-0.5) >= 0.12 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM s)
    SELECT id, round(score,6) AS score, confidence, CASE WHEN confidence = 'LOW' THEN 'ABSTAIN' ELSE 'SCORED' END AS decision, CASE WHEN confidence <> 'LOW' THEN row_number() OVER (PARTITION BY pool, confidence <> 'LOW' ORDER BY score DESC, production_rank, id) ELSE 0 END AS place FROM d""")
def sm11(spark, sf):
    """A candidate's score, how sure it is, and its place among those of its pool that are scored (0: none)."""
    k = F.col("id")
    clip = F.when(k % 6 == 0, 0.5).otherwise(k * 7919 % 1000 / 1000.0)
    score = 0.55 * clip + 0.2 * c.clamp(F.col("L")) + 0.2 * c.clamp(F.col("C") / 0.25) + 0.05 * F.coalesce(0.5 + 0.5 * F.cos(F.radians("H")), F.lit(0.5))
    s = swatches(spark, sf).select("id", F.floor(k / 50).alias("pool"), (k % 50 + 1).alias("production_rank"), R(score, 9).alias("score"))
    off = F.abs(F.col("score") - 0.5)
    s = s.withColumn("confidence", F.when(off >= 0.25, "HIGH").when(off >= 0.12, "MEDIUM").otherwise("LOW")).withColumn("scored", F.col("confidence") != "LOW")
    place = F.row_number().over(Window.partitionBy("pool", "scored").orderBy(F.desc("score"), "production_rank", "id"))
    return s.select("id", R("score").alias("score"), "confidence", F.when(F.col("scored"), "SCORED").otherwise("ABSTAIN").alias("decision"), F.when(F.col("scored"), place).otherwise(0).alias("place"))


# --- calibration ------------------------------------------------------------------------------

SETS_SQL = """cal AS (SELECT c_nationkey AS grp, c_custkey AS case_id, (c_custkey*37%100)/400.0::DOUBLE AS dl, (c_custkey*61%100)/700.0::DOUBLE AS dc, (c_custkey*29%90)/1000.0::DOUBLE AS min_c, (c_custkey*53%180)::DOUBLE AS dh, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place FROM customer),
    lab AS (SELECT *, CASE WHEN dl <= 0.06 AND dc <= 0.033 THEN 'similar' WHEN dl+CASE WHEN grp%2=0 THEN 4.0 ELSE 3.0 END*sqrt(dl*dc) >= CASE WHEN grp%2=0 THEN 0.54 ELSE 0.45 END THEN 'different' ELSE 'similar_or_partial' END AS label, (min_c < CASE WHEN grp%3=0 THEN 0.03 ELSE 0.05 END) <> (case_id%11=0) AS low, (dh <= 45) <> (case_id%13=0) AS near FROM cal WHERE place <= 20)"""


def labelled(spark, sf):
    """Twenty labelled cases for each nation: a set is a fixed list of cases, as a calibration needs."""
    k, g = F.col("c_custkey"), F.col("c_nationkey")
    r = table(spark, sf, "customer").select(g.alias("grp"), k.alias("case_id"), (k * 37 % 100 / 400.0).alias("dl"), (k * 61 % 100 / 700.0).alias("dc"), (k * 29 % 90 / 1000.0).alias("min_c"), (k * 53 % 180).cast("double").alias("dh"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("place")).where("place <= 20")
    even = F.col("grp") % 2 == 0
    apart = F.col("dl") + F.when(even, 4.0).otherwise(3.0) * F.sqrt(F.col("dl") * F.col("dc"))
    label = F.when((F.col("dl") <= 0.06) & (F.col("dc") <= 0.033), "similar").when(apart >= F.when(even, 0.54).otherwise(0.45), "different").otherwise("similar_or_partial")
    low = (F.col("min_c") < F.when(F.col("grp") % 3 == 0, 0.03).otherwise(0.05)) != (F.col("case_id") % 11 == 0)
    return r.select("grp", "case_id", "dl", "dc", "min_c", "dh", label.alias("label"), low.alias("low"), ((F.col("dh") <= 45) != (F.col("case_id") % 13 == 0)).alias("near"))


@query("cl11_grid_search", f"""WITH {SETS_SQL}, g AS (SELECT round(0.04::DOUBLE+a*0.005::DOUBLE,10) AS sl, round(0.025::DOUBLE+b*0.0025::DOUBLE,10) AS sc, round(2.0::DOUBLE+c*0.25::DOUBLE,10) AS k, round(0.40::DOUBLE+d*0.01::DOUBLE,10) AS dt FROM range(9) x(a), range(7) y(b), range(17) z(c), range(31) w(d)),
    h AS (SELECT grp, sl, sc, k, dt, count(*) FILTER (WHERE CASE WHEN dl <= sl AND dc <= sc THEN 'similar' WHEN dl+k*sqrt(dl*dc) >= dt THEN 'different' ELSE 'similar_or_partial' END = label) AS hits, count(*) AS n FROM lab, g GROUP BY ALL), m AS (SELECT grp, max(hits) AS best FROM h GROUP BY 1),
    p AS (SELECT grp, count(*) FILTER (WHERE CASE WHEN dl <= 0.06 AND dc <= 0.033 THEN 'similar' WHEN dl+4.0*sqrt(dl*dc) >= 0.54 THEN 'different' ELSE 'similar_or_partial' END = label) AS prefer FROM lab GROUP BY 1), w AS (SELECT h.grp, any_value(hits) AS hits, any_value(n) AS n, count(*) AS plateau, median(sl) AS sl, median(sc) AS sc, median(k) AS k, median(dt) AS dt FROM h JOIN m ON m.grp=h.grp AND hits = best GROUP BY 1)
    SELECT grp, hits, n, plateau, CASE WHEN prefer = hits THEN 0.06 ELSE floor(sl*10000+0.5)/10000 END::DOUBLE AS sim_l, CASE WHEN prefer = hits THEN 0.033 ELSE floor(sc*10000+0.5)/10000 END::DOUBLE AS sim_c, CASE WHEN prefer = hits THEN 4.0 ELSE floor(k*100+0.5)/100 END::DOUBLE AS k, CASE WHEN prefer = hits THEN 0.54 ELSE floor(dt*1000+0.5)/1000 END::DOUBLE AS diff FROM w JOIN p USING (grp)""")
def cl11(spark, sf):
    return cl.grid_search(labelled(spark, sf), ["grp"])


def _plateau_sql(value, truth, first, step, n, prefer, test, digits):
    return f"""WITH {SETS_SQL}, h AS (SELECT grp, t, count(*) FILTER (WHERE ({value} {test} t) = {truth}) AS hits FROM lab, (SELECT round({first}+i*{step},10) AS t FROM range({n}) r(i)) GROUP BY 1,2), m AS (SELECT grp, max(hits) AS best FROM h GROUP BY 1), e AS (SELECT h.grp, max(hits) AS hits, min(t)::DOUBLE AS low, max(t)::DOUBLE AS high FROM h JOIN m ON m.grp=h.grp AND hits=best GROUP BY 1)
    SELECT *, CASE WHEN low <= {prefer} AND high >= {prefer} THEN {prefer}::DOUBLE ELSE floor((low+high)/2*{10**digits}+0.5)/{10**digits} END AS threshold FROM e"""


@query("cl11_chroma_plateau", _plateau_sql("min_c", "low", 0.005, 0.0005, 151, 0.03, "<", 4))
def cl11_chroma(spark, sf):
    return cl.plateau(labelled(spark, sf), ["grp"], "min_c", "low", cl.CHROMA_GRID, cl.CHROMA_PREFERRED, False, 4)


@query("cl11_hue_plateau", _plateau_sql("dh", "near", 5.0, 0.5, 231, 40.0, "<=", 1))
def cl11_hue(spark, sf):
    return cl.plateau(labelled(spark, sf), ["grp"], "dh", "near", cl.HUE_GRID, cl.HUE_PREFERRED, True, 1)


@query("cl13_leave_one_out")
def cl13(spark, sf):
    """Every case of a set named by the cuts that fit the others best."""
    return cl.fitted_out(labelled(spark, sf), ["grp"], "case_id", "dl", "label")


@query("prj12_edge_packet", f"WITH {SWATCHES_SQL}, s AS (SELECT id, id//40 AS style, 0.25*L AS l FROM swatches) SELECT least(a.id::VARCHAR,b.id::VARCHAR) || '||' || greatest(a.id::VARCHAR,b.id::VARCHAR) AS pair_key, a.id AS a, b.id AS b, round(abs(a.l-b.l),6) AS delta_l FROM s a JOIN s b ON a.style=b.style AND a.id < b.id")
def prj12_edges(spark, sf):
    """The edges of a profile packet: physical relations only; a field that says what someone saw in a pair stops the query."""
    from huestrata.sources.landing import physical_only

    return physical_only(pairs(spark, sf).select("pair_key", F.col("id_1").alias("a"), F.col("id_2").alias("b"), R("delta_L").alias("delta_l")))
