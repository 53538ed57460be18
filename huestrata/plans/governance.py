"""Queries over contracts, label schemas, splits, commitments, manifests and readiness."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from huestrata.functions import text as tx
from huestrata.operators import ranking as rk
from huestrata.operators import relations as rel
from huestrata.operators import sets as so
from huestrata.operators import shuffles as sh
from huestrata.operators.digests import digest_sql
from huestrata.plans.registry import query
from huestrata.sources.tables import modes, table

R = lambda x, n=6: F.round(x, n)


def _pick(items, at):
    return F.element_at(F.array(*(F.lit(x) for x in items)), (at + 1).cast("int"))


def _pick_sql(items, at):
    return "[" + ",".join("NULL" if x is None else f"'{x}'" for x in items) + f"][({at})::INT+1]"


# --- statuses and failures --------------------------------------------------------------------

SAID = ["PASS_WITH_NOTES", "ready_for_next", "Hold: missing", "failed", "FAIL/2", "passed", "held", "unknown", ""]


@query("flt12_status", f"WITH s AS (SELECT event_id, {_pick_sql(SAID, 'event_id%9')} AS said FROM events) SELECT event_id, CASE WHEN upper(said) LIKE 'PASS%' OR upper(said) = 'READY_FOR_NEXT' THEN 'PASS' WHEN upper(said) LIKE 'HOLD%' THEN 'HOLD' WHEN upper(said) LIKE 'FAIL%' THEN 'FAIL' END AS status FROM s")
def flt12(spark, sf):
    return table(spark, sf, "events").select("event_id", tx.status(_pick(SAID, F.col("event_id") % 9)).alias("status"))


ERRORS = ["SHADOW_TIMEOUT", "request timed out", "AbortError", "invalid item", "Schema mismatch", "contract broken", "shadow engine down", "disk full", ""]
REASONS, PLACES = [None, "queue_full", "other"], ["audit_log", "shadow", "sink", "index"]


@query("fn37_failure_class", f"""WITH e AS (SELECT event_id, lower({_pick_sql(ERRORS, 'event_id%9')}) AS t, {_pick_sql(REASONS, 'event_id%3')} AS reason, {_pick_sql(PLACES, 'event_id//9%4')} AS stage FROM events),
    k AS (SELECT event_id, CASE WHEN reason = 'queue_full' THEN 'QUEUE_FULL' WHEN stage = 'audit_log' THEN 'LOG_SINK_FAILURE' WHEN t LIKE '%timeout%' OR t LIKE '%timed out%' OR t LIKE '%abort%' THEN 'TIMEOUT' WHEN t LIKE '%invalid%' OR t LIKE '%schema%' OR t LIKE '%contract%' THEN 'INVALID_INPUT' WHEN stage = 'shadow' OR t LIKE '%shadow%' THEN 'SHADOW_ENGINE_FAILURE' ELSE 'UNKNOWN' END AS category FROM e)
    SELECT event_id, category, CASE category WHEN 'QUEUE_FULL' THEN 'DROP_SHADOW_TASK' WHEN 'TIMEOUT' THEN 'ABORT_OR_IGNORE_SHADOW_RESULT' WHEN 'INVALID_INPUT' THEN 'SKIP_INVALID_SHADOW_INPUT' WHEN 'LOG_SINK_FAILURE' THEN 'CONTINUE_WITHOUT_PERSISTED_LOG' WHEN 'SHADOW_ENGINE_FAILURE' THEN 'SKIP_FAILED_SHADOW_RESULT' ELSE 'SKIP_UNKNOWN_SHADOW_FAILURE' END AS shadow_action,
      CASE WHEN category = 'LOG_SINK_FAILURE' THEN 'DROP_LOG_EVENT' ELSE 'BEST_EFFORT_DIAGNOSTIC' END AS audit_action FROM k""")
def fn37(spark, sf):
    k = F.col("event_id")
    category = tx.failure(_pick(ERRORS, k % 9), _pick(REASONS, k % 3), _pick(PLACES, F.floor(k / 9) % 4))
    return table(spark, sf, "events").select("event_id", category.alias("category"), tx.failure_action(category, "shadow").alias("shadow_action"), tx.failure_action(category, "audit").alias("audit_action"))


@query("fn28_fingerprint", "SELECT c_custkey AS id, sha256(lower(trim(nfc_normalize(c_name)))) AS print FROM customer")
def fn28(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), tx.fingerprint(F.col("c_name")).alias("print"))


@query("fn28_record_hash", """SELECT c_custkey AS id, sha256('{"balance":' || (c_acctbal*100)::BIGINT || ',"name":"' || c_name || '","nation":' || c_nationkey || '}') AS print FROM customer""")
def fn28_record(spark, sf):
    """The hash of a record's JSON with its keys in order, whatever the order of the columns."""
    r = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"), F.round(F.col("c_acctbal") * 100).cast("long").alias("balance"))
    return r.select("id", tx.record_hash("nation", "name", "balance").alias("print"))


DECK = 40
_imul = lambda a, b: f"((({a}) * (({b}) & 65535) + (((({a}) * (({b}) >> 16)) & 65535) << 16)) & 4294967295)"


@query("fn30_shuffle", f"""WITH c AS (SELECT c_custkey // {DECK} AS deck, c_custkey AS id, row_number() OVER (PARTITION BY c_custkey // {DECK} ORDER BY c_custkey) - 1 AS pos, count(*) OVER (PARTITION BY c_custkey // {DECK}) AS n FROM customer),
    a AS (SELECT *, (('0x' || substr(sha256('deal|' || deck), 1, 8))::BIGINT + (n - pos) * {0x6D2B79F5}) & 4294967295 AS a FROM c), t AS (SELECT *, {_imul('xor(a, a >> 15)', 'a | 1')} AS t FROM a),
    u AS (SELECT *, xor(t, (t + {_imul('xor(t, t >> 7)', 't | 61')}) & 4294967295) AS u FROM t), w AS (SELECT *, floor(xor(u, u >> 14) / 4294967296.0::DOUBLE * (pos + 1))::BIGINT AS swap FROM u),
    d AS (SELECT deck, list(id ORDER BY pos) AS cards, list([pos, swap] ORDER BY pos DESC) FILTER (WHERE pos > 0) AS swaps FROM w GROUP BY deck),
    s AS (SELECT deck, list_reduce(list_prepend(cards, coalesce(swaps, [])), lambda x, s: list_transform(x, lambda v, p: CASE WHEN p = s[1] + 1 THEN x[s[2] + 1] WHEN p = s[2] + 1 THEN x[s[1] + 1] ELSE v END)) AS cards FROM d)
    SELECT deck, unnest(cards) AS id, unnest(range(1, len(cards) + 1))::INT AS place FROM s""")
def fn30_shuffle(spark, sf):
    """Decks of cards, each after a Fisher-Yates shuffle by the seeded generator."""
    r = table(spark, sf, "customer").select(F.floor(F.col("c_custkey") / DECK).alias("deck"), F.col("c_custkey").alias("id"))
    return sh.shuffled(r, ["deck"], ["id"], sh.seed32(F.concat(F.lit("deal|"), F.col("deck").cast("string"))))


# --- label schemas ----------------------------------------------------------------------------

APPLICABLE, HUE, TONE, SURE = ["reliable", "low_chroma", "review", "odd", None], ["same_or_adjacent", "different", "not_applicable", "review"], ["similar", "similar_or_partial", "different", "review", "?"], ["high", "medium", "low"]


def cases(spark, sf):
    """One labelled case per customer; odd customers have labels of the old schema, without applicability."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("case_id"), F.when(k % 2 == 0, _pick(APPLICABLE, F.floor(k / 2) % 5)).alias("hue_applicability"), (k % 2 == 1).alias("legacy"), _pick(HUE, F.floor(k / 10) % 4).alias("hue_relation"), _pick(TONE, F.floor(k / 3) % 5).alias("tone_relation"),
        F.when(k % 13 != 0, _pick(SURE, k % 3)).alias("confidence"), F.when(k % 29 != 0, k * 37 % 100 / 1000.0).alias("min_chroma"))


CASES_SQL = f"""cases AS (SELECT c_custkey AS case_id, CASE WHEN c_custkey%2=0 THEN {_pick_sql(APPLICABLE, 'c_custkey//2%5')} END AS app, c_custkey%2=1 AS legacy, {_pick_sql(HUE, 'c_custkey//10%4')} AS hue, {_pick_sql(TONE, 'c_custkey//3%5')} AS tone,
    CASE WHEN c_custkey%13<>0 THEN {_pick_sql(SURE, 'c_custkey%3')} END AS sure, CASE WHEN c_custkey%29<>0 THEN c_custkey*37%100/1000.0 END AS min_c FROM customer)"""


@query("gv04_label_schema", f"""WITH {CASES_SQL}, b AS (SELECT case_id, list_filter([CASE WHEN app IS NULL OR app NOT IN ('reliable','low_chroma','review') THEN 'hue_applicability' END, CASE WHEN hue NOT IN ('same_or_adjacent','different','not_applicable','review') THEN 'hue_relation' END, CASE WHEN tone NOT IN ('similar','similar_or_partial','different','review') THEN 'tone_relation' END,
      CASE WHEN sure IS NULL OR sure NOT IN ('high','medium','low') THEN 'confidence' END, CASE WHEN app = 'low_chroma' AND hue <> 'not_applicable' THEN 'low_chroma_hue' END, CASE WHEN app = 'reliable' AND hue NOT IN ('same_or_adjacent','different') THEN 'reliable_hue' END, CASE WHEN app = 'review' AND hue <> 'review' THEN 'review_hue' END], lambda x: x IS NOT NULL) AS l FROM cases WHERE NOT legacy)
    SELECT case_id, unnest(l) AS broken FROM b""")
def gv04(spark, sf):
    app, hue = F.col("hue_applicability"), F.col("hue_relation")
    checks = {
        "hue_applicability": app.isin("reliable", "low_chroma", "review"), "hue_relation": hue.isin(HUE), "tone_relation": F.col("tone_relation").isin(TONE[:4]), "confidence": F.col("confidence").isin(SURE),
        "low_chroma_hue": ~app.eqNullSafe("low_chroma") | (hue == "not_applicable"), "reliable_hue": ~app.eqNullSafe("reliable") | hue.isin("same_or_adjacent", "different"), "review_hue": ~app.eqNullSafe("review") | (hue == "review"),
    }
    return so.violations(cases(spark, sf).where("NOT legacy"), checks).select("case_id", "broken")


@query("gv05_quarantine", f"WITH {CASES_SQL} SELECT case_id, min_c AS min_chroma FROM cases WHERE legacy AND min_c <= 0.01 AND hue NOT IN ('unreliable_low_chroma','not_applicable','review')")
def gv05(spark, sf):
    """Labels of the old schema that name a hue relation although a colour has hardly any chroma."""
    hued = ~F.col("hue_relation").isin("unreliable_low_chroma", "not_applicable", "review")
    return cases(spark, sf).where(F.col("legacy") & (F.col("min_chroma") <= 0.01) & hued).select("case_id", "min_chroma")


@query("flt09_eligible_labels", f"WITH {CASES_SQL} SELECT case_id FROM cases WHERE sure IS DISTINCT FROM 'low' AND tone <> 'review'")
def flt09(spark, sf):
    """Labels a threshold may be fitted on: not of low confidence, and not for review."""
    return cases(spark, sf).where(~F.col("confidence").eqNullSafe("low") & (F.col("tone_relation") != "review")).select("case_id")


# --- contracts --------------------------------------------------------------------------------


@query("flt10_violations", """WITH n AS (SELECT s_suppkey AS id, s_suppkey//20 AS pool FROM supplier WHERE s_suppkey%50 <> 7 UNION ALL SELECT s_suppkey-1, s_suppkey//20 FROM supplier WHERE s_suppkey%50 = 7), e AS (SELECT x.pool, x.id AS a, y.id AS b FROM n x JOIN n y ON x.pool = y.pool AND x.id < y.id WHERE (x.id+y.id)%37 <> 0),
    c AS (SELECT pool, count(*) AS nodes, count(DISTINCT id) AS ids FROM n GROUP BY 1), ec AS (SELECT pool, count(*) AS edges, count(DISTINCT (a,b)) AS pairs FROM e GROUP BY 1)
    SELECT pool, unnest(list_filter([CASE WHEN nodes <> ids THEN 'duplicate_node' END, CASE WHEN edges <> pairs THEN 'duplicate_pair' END, CASE WHEN edges <> nodes*(nodes-1)//2 THEN 'incomplete' END], lambda x: x IS NOT NULL)) AS broken FROM c JOIN ec USING (pool)""")
def flt10(spark, sf):
    """Contract of a complete graph, pool by pool: ids once, pairs once, n(n-1)/2 edges. Some pools are broken on purpose."""
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    n = s.select(F.when(k % 50 == 7, k - 1).otherwise(k).alias("id"), F.floor(k / 20).alias("pool"))
    e = n.select("pool", F.col("id").alias("a")).join(n.select("pool", F.col("id").alias("b")), "pool").where("a < b AND (a + b) % 37 <> 0")
    return so.complete_graph_violations(n, e, ["pool"])


@query("flt10_distribution", "WITH a AS (SELECT source AS k, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT source AS k, count(*) AS n FROM documents WHERE doc_id%7 <> 0 OR source <> 'src1' GROUP BY 1) SELECT coalesce(a.k,b.k) AS k, coalesce(a.n,0) AS claimed, coalesce(b.n,0) AS counted FROM a FULL JOIN b ON a.k=b.k WHERE a.n IS DISTINCT FROM b.n")
def flt10_distribution(spark, sf):
    """Where a claimed distribution and the rows disagree."""
    d = table(spark, sf, "documents").select("source", "doc_id")
    claimed = d.groupBy(F.col("source").alias("k")).agg(F.count(F.lit(1)).alias("claimed"))
    return so.distribution_mismatch(claimed, d.where("doc_id % 7 <> 0 OR source <> 'src1'").select(F.col("source").alias("k")), "k")


@query("gv11_checklist", """WITH c AS (SELECT 1 AS no, 'order ids unique' AS item, (SELECT count(*) = count(DISTINCT o_orderkey) FROM orders) AS pass UNION ALL SELECT 2, 'prices positive', (SELECT count(*) FILTER (WHERE o_totalprice <= 0) = 0 FROM orders) UNION ALL SELECT 3, 'customers known', (SELECT count(*) = 0 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
    UNION ALL SELECT 4, 'lines have orders', (SELECT count(*) = 0 FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) UNION ALL SELECT 5, 'discounts within bounds', (SELECT count(*) FILTER (WHERE l_discount NOT BETWEEN 0 AND 0.1) = 0 FROM lineitem) UNION ALL SELECT 6, 'every nation has customers', (SELECT count(*) = 0 FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer))
    UNION ALL SELECT 7, 'no balance below zero', (SELECT count(*) FILTER (WHERE c_acctbal < 0) = 0 FROM customer) UNION ALL SELECT 8, 'labels are of documents', (SELECT count(*) = 0 FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)))
    SELECT no, item, pass, (SELECT count(*) FROM c WHERE pass) AS passed, (SELECT count(*) FROM c WHERE NOT pass) AS failed FROM c""")
def gv11(spark, sf):
    t = lambda name: table(spark, sf, name)
    o, li, cu = t("orders"), t("lineitem"), t("customer")
    none_left = lambda a, x, b, y: a.select(F.col(x).alias("k")).join(b.select(F.col(y).alias("k")), "k", "left_anti").agg((F.count(F.lit(1)) == 0).alias("pass"))
    never = lambda df, test: df.agg((F.count_if(test) == 0).alias("pass"))
    checks = {
        "order ids unique": o.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("k")).agg((F.coalesce(F.max("k"), F.lit(1)) == 1).alias("pass")), "prices positive": never(o, F.col("o_totalprice") <= 0),
        "customers known": none_left(o, "o_custkey", cu, "c_custkey"), "lines have orders": none_left(li, "l_orderkey", o, "o_orderkey"), "discounts within bounds": never(li, ~F.col("l_discount").between(0, 0.1)),
        "every nation has customers": none_left(t("nation"), "n_nationkey", cu, "c_nationkey"), "no balance below zero": never(cu, F.col("c_acctbal") < 0), "labels are of documents": none_left(t("labels"), "doc_id", t("documents"), "doc_id"),
    }
    return so.checklist(checks)


@query("gv03_concentration", """WITH d AS (SELECT doc_id//100 AS pool, source, lang AS family, n_chars > 15000 AS failed, doc_id%50 = 49 AS missed FROM documents), s AS (SELECT pool, source, count(*) AS n FROM d GROUP BY 1,2), m AS (SELECT pool, max(n) AS top, count(*) AS sources FROM s GROUP BY 1),
    a AS (SELECT pool, count(*) AS n, count(DISTINCT family) AS families, avg(failed::INT) AS failure, count(*) FILTER (WHERE missed AND failed) AS unresolved FROM d GROUP BY 1)
    SELECT pool, n, sources, families, round(top/n,6) AS top_share, round(failure,6) AS failure_ratio, list_filter([CASE WHEN NOT n >= 50 THEN 'reference_count' END, CASE WHEN NOT n <= 100 THEN 'reference_count_max' END, CASE WHEN NOT families >= 3 THEN 'query_family_diversity' END, CASE WHEN NOT top/n <= 0.5 THEN 'source_concentration' END, CASE WHEN NOT failure <= 0.2 THEN 'url_failure_ratio' END, CASE WHEN NOT unresolved = 0 THEN 'cache_unresolved' END], lambda x: x IS NOT NULL) AS broken FROM a JOIN m USING (pool)""")
def gv03(spark, sf):
    """Six checks of every pool of references: size both ways, families, largest source, failed addresses, unresolved ones."""
    d = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 100).alias("pool"), "source", F.col("lang").alias("family"), (F.col("n_chars") > 15000).alias("failed"), (F.col("doc_id") % 50 == 49).alias("missed"))
    return so.pool_audit(d, "pool").withColumns({"top_share": R("top_share"), "failure_ratio": R("failure_ratio")})


# --- splits, commitments and pins -------------------------------------------------------------


@query("gv06_fresh_split")
def gv06(spark, sf):
    """Per style 24 training and 12 validation pairs of colour modes, each space-filling, from pairs that were not used before; disjoint, with their digests."""
    p = rel.physical(rel.all_pairs(modes(spark, sf), ["id", "L", "a", "bb", "C", "H"], ["style"]))
    p = p.select(F.col("style_1").alias("style"), "id_1", "id_2", tx.pair_key(F.col("id_1").cast("string"), F.col("id_2").cast("string")).alias("pair_key"), "delta_L", "delta_C", "hue_chord", "min_C", "max_C")
    used = table(spark, sf, "nation").select(tx.pair_key(F.col("n_nationkey").cast("string"), (F.col("n_nationkey") + 1).cast("string")).alias("pair_key"))
    return rk.fresh_split(p, used, ["style"], ["delta_L", "delta_C", "hue_chord", "min_C", "max_C"])


DIGEST = "(SELECT sha256(string_agg(k, chr(10) ORDER BY k)) FROM (SELECT DISTINCT k FROM {}))"


@query("gv07_commitment", """WITH d AS (SELECT c_nationkey AS batch, c_custkey AS case_id, c_name AS pair_key, 100+c_custkey AS t FROM customer), q AS (SELECT batch, case_id, pair_key, row_number() OVER (PARTITION BY batch ORDER BY case_id) AS place FROM d), g AS (SELECT batch, CASE WHEN batch%5=1 AND case_id%7=0 THEN case_id+1 ELSE case_id END AS case_id, CASE WHEN batch%5=2 AND case_id%9=0 THEN pair_key || 'x' ELSE pair_key END AS pair_key,
    row_number() OVER (PARTITION BY batch ORDER BY CASE WHEN batch%5=3 THEN -case_id ELSE case_id END) AS place, CASE WHEN batch%5=4 THEN 1 ELSE 200000000 END AS t FROM d),
    j AS (SELECT coalesce(q.batch,g.batch) AS batch, bool_and(coalesce(q.case_id = g.case_id, false)) AS ids, bool_and(coalesce(q.pair_key = g.pair_key, false)) AS pairs FROM q FULL JOIN g ON q.batch=g.batch AND q.place=g.place GROUP BY 1),
    s AS (SELECT batch, sha256(string_agg(pair_key, chr(10) ORDER BY pair_key)) AS dg FROM q GROUP BY 1), t AS (SELECT batch, sha256(string_agg(pair_key, chr(10) ORDER BY pair_key)) AS dg, count(*) = count(DISTINCT case_id) AND count(*) = count(DISTINCT pair_key) AS one_each, min(t) >= 100 AS later FROM g GROUP BY 1)
    SELECT batch, list_filter([CASE WHEN s.dg <> t.dg THEN 'digest' END, CASE WHEN NOT one_each THEN 'repeated' END, CASE WHEN NOT ids THEN 'case_order' END, CASE WHEN NOT pairs THEN 'pair_order' END, CASE WHEN NOT later THEN 'predates_freeze' END], lambda x: x IS NOT NULL) AS broken FROM j JOIN s USING (batch) JOIN t USING (batch)""")
def gv07(spark, sf):
    """What was labelled against what was sealed, batch by batch: digests, repeats, order and time. Some batches were tampered with."""
    d = table(spark, sf, "customer").select(F.col("c_nationkey").alias("batch"), F.col("c_custkey").alias("case_id"), F.col("c_name").alias("pair_key"))
    b, k = F.col("batch") % 5, F.col("case_id")
    sealed = d.withColumn("place", F.row_number().over(Window.partitionBy("batch").orderBy("case_id")))
    order = Window.partitionBy("batch").orderBy(F.when(b == 3, -k).otherwise(k))
    got = d.select("batch", F.when((b == 1) & (k % 7 == 0), k + 1).otherwise(k).alias("case_id"), F.when((b == 2) & (k % 9 == 0), F.concat("pair_key", F.lit("x"))).otherwise(F.col("pair_key")).alias("pair_key"), F.row_number().over(order).alias("place"), F.when(b == 4, 1).otherwise(200000000).alias("at"))
    return so.commitment(sealed, got, ["batch"], frozen_at=100)


@query("gv09_manifest_print", """WITH f AS (SELECT source AS folder, 'd/' || doc_id AS file, CASE WHEN doc_id%31=0 THEN NULL ELSE strlen(coalesce(text,'')) END AS bytes, CASE WHEN doc_id%31=0 THEN NULL ELSE sha256(coalesce(text,'')) END AS sha, doc_id%31=0 AS missing FROM documents)
    SELECT folder, n AS files, digest AS print FROM (""" + digest_sql("(SELECT folder, file, sha256(file || '|' || coalesce(bytes::VARCHAR,'') || '|' || coalesce(sha,'') || '|' || missing) AS r FROM f)", ["folder"], "file", "r", "''") + ")")
def gv09(spark, sf):
    """One fingerprint for the files (name, bytes, SHA-256, missing) of each folder, in order of name."""
    gone = F.col("doc_id") % 31 == 0
    text = F.coalesce("text", F.lit(""))
    f = table(spark, sf, "documents").select(F.col("source").alias("folder"), F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("file"), F.when(~gone, F.octet_length(text)).alias("bytes"), F.when(~gone, F.sha2(text, 256)).alias("sha"), gone.alias("missing"))
    return so.manifest_print(f, ["folder"])


@query("gv14_dataset_pin", """WITH d AS (SELECT o_custkey AS dataset, o_orderkey AS k, o_totalprice AS v FROM orders), p AS (SELECT dataset, count(*) AS n, sum(k*31 + floor(v*100)::BIGINT%1000003)::HUGEINT AS print FROM d GROUP BY 1),
    a AS (SELECT dataset, count(*) AS n, sum(k*31 + floor((CASE WHEN k%101=0 THEN v+1 ELSE v END)*100)::BIGINT%1000003)::HUGEINT AS print FROM d WHERE NOT (dataset%40=3 AND k%2=0) GROUP BY 1)
    SELECT p.dataset, CASE WHEN a.dataset IS NULL OR p.n <> a.n OR p.print <> a.print THEN 'HOLD_DATASET_LINEAGE_DRIFT' ELSE 'PINNED' END AS state FROM p LEFT JOIN a ON p.dataset = a.dataset""")
def gv14(spark, sf):
    """Datasets as pinned before a run against what is there after it: id, count and fingerprint. Some have drifted."""
    d = table(spark, sf, "orders").select(F.col("o_custkey").alias("dataset"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    after = d.where("NOT (dataset % 40 = 3 AND k % 2 = 0)").withColumn("v", F.when(F.col("k") % 101 == 0, F.col("v") + 1).otherwise(F.col("v")))
    row = F.col("k") * 31 + F.floor(F.col("v") * 100) % 1000003
    return so.pinned(d, after, "dataset", row)


# --- checked joins ----------------------------------------------------------------------------


@query("jn01_checked_join", "SELECT o_orderkey AS id, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey")
def jn01(spark, sf):
    """Every label must find its edge: one that does not stops the query."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"))
    return rel.checked_join(o, table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment")), "key").select("id", "segment")


@query("jn04_three_way", """WITH b AS (SELECT l_suppkey AS mode_id, sum(l_quantity) AS mass, count(DISTINCT l_partkey) AS support FROM lineitem GROUP BY 1), a AS (SELECT l_suppkey AS mode_id, round(sum(l_quantity),6)+CASE WHEN l_suppkey%23=5 THEN 1e-3 ELSE 1e-9 END AS mass, count(DISTINCT l_partkey)+CASE WHEN l_suppkey%31=4 THEN 1 ELSE 0 END AS support FROM lineitem GROUP BY 1), g AS (SELECT s_suppkey AS mode_id, s_name AS lineage FROM supplier)
    SELECT b.mode_id, lineage, list_filter([CASE WHEN abs(b.mass-a.mass) > 1e-7 THEN 'mass' END, CASE WHEN b.support <> a.support THEN 'support' END], lambda x: x IS NOT NULL) AS mismatch FROM b JOIN a USING (mode_id) JOIN g USING (mode_id)""")
def jn04(spark, sf):
    """Mode, baseline and lineage by mode id, with what of the baseline is out of tolerance."""
    mode = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("mode_id")).agg(F.sum("l_quantity").alias("mass"), F.countDistinct("l_partkey").alias("support"))
    k = F.col("mode_id")
    base = mode.select("mode_id", (F.round("mass", 6) + F.when(k % 23 == 5, 1e-3).otherwise(1e-9)).alias("mass"), (F.col("support") + F.when(k % 31 == 4, 1).otherwise(0)).alias("support"))
    lineages = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("mode_id"), F.col("s_name").alias("lineage"))
    return rel.validated(mode, base, "mode_id", {"mass": 1e-7, "support": 0}).join(lineages, "mode_id").select("mode_id", "lineage", "mismatch")
