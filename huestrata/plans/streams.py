"""Queries over sources, logs and the job lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from huestrata.plans.registry import query
from huestrata.sources import landing as ld
from huestrata.sources.tables import table
from huestrata.streaming import jobs

R = lambda x, n=6: F.round(x, n)


@query("src01_photo_scan", """SELECT 'unsplash:' || p_partkey AS id, 'unsplash' AS provider, p_size AS width, p_size+1 AS height, '#' || substr(md5(p_name),1,6) AS color, p_name AS alt FROM part WHERE p_partkey % 10 <> 0""")
def src01(spark, sf):
    p = table(spark, sf, "part")
    body = F.to_json(F.struct(F.when(F.col("p_partkey") % 10 != 0, F.col("p_partkey").cast("string")).alias("id"), F.col("p_size").alias("width"), (F.col("p_size") + 1).alias("height"), F.concat(F.lit("#"), F.substring(F.md5(F.col("p_name")), 1, 6)).alias("color"), F.col("p_name").alias("alt_description")))
    return ld.photo_rows(p.select(body.alias("body")), "unsplash").select("id", "provider", "width", "height", "color", "alt")


@query("src04_web_images", """WITH r AS (SELECT p_partkey AS k, CASE WHEN p_partkey%7=0 THEN 'x-raw-image://' || p_partkey WHEN p_partkey%5=0 THEN NULL ELSE 'https://a.com/' || p_partkey END AS o, CASE WHEN p_partkey%3=0 THEN NULL ELSE 'https://t.com/' || p_partkey END AS t FROM part)
    SELECT 'web:' || substr(sha256(coalesce(o,t)),1,16) AS id, o AS image_regular, t AS image_small FROM r WHERE coalesce(o,t) IS NOT NULL AND coalesce(o,'') NOT LIKE 'x-raw-image://%'""")
def src04(spark, sf):
    k = F.col("p_partkey")
    o = F.when(k % 7 == 0, F.concat(F.lit("x-raw-image://"), k.cast("string"))).when(k % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("https://a.com/"), k.cast("string")))
    t = F.when(k % 3 != 0, F.concat(F.lit("https://t.com/"), k.cast("string")))
    raw = table(spark, sf, "part").select(F.to_json(F.struct(o.alias("original"), t.alias("thumbnail"))).alias("body"))
    return ld.web_image_rows(raw).select("id", "image_regular", "image_small")


@query("src08_fallback", "SELECT p_partkey AS id, p_partkey%4=0 AS fallback_used, CASE WHEN p_partkey%4=0 THEN 0.85 ELSE 1.0 END::DOUBLE AS feature_reliability FROM part")
def src08(spark, sf):
    k = F.col("p_partkey")
    p = ld.with_fallback(table(spark, sf, "part"), F.when(k % 4 != 0, F.col("p_name")), F.col("p_brand"))
    return p.select(k.alias("id"), "fallback_used", "feature_reliability")


@query("src13_log_tail", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 100")
def src13(spark, sf):
    return table(spark, sf, "events").select("event_id").orderBy(F.desc("event_id")).limit(100)


@query("src15_seed_queries", "SELECT r_name AS family, lower(r_name) AS query FROM region ORDER BY 1, 2 LIMIT 6")
def src15(spark, sf):
    seeds = table(spark, sf, "region").select(F.col("r_name").alias("family"), F.lower("r_name").alias("query"))
    return ld.seed_queries(seeds, "retro")


@query("src16_pair_keys", "SELECT DISTINCT n_name || '||' || r_name AS pair_key FROM nation JOIN region ON n_regionkey = r_regionkey")
def src16(spark, sf):
    j = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.concat_ws("||", "n_name", "r_name")
    doc = F.to_json(F.struct(F.struct(F.array(F.struct(key.alias("pair_key"))).alias("cases")).alias("deep")))
    return ld.pair_keys(j.select(doc.alias("body")))


@query("prj14_flatten_json", "SELECT n_nationkey AS id, 'a.name' AS path, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'a.b.region', n_regionkey::VARCHAR FROM nation")
def prj14(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.to_json(F.struct(F.struct(F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("region")).alias("b")).alias("a"))).alias("body"))
    return ld.flatten_json(n, "id", depth=3)


@query("prj13_log_sanitize", "SELECT event_id, substr(props, 1, 20) AS props FROM events")
def prj13(spark, sf):
    log = table(spark, sf, "events").select("event_id", "props", F.array(F.lit(1)).alias("secret"))
    return ld.allowlisted(log, ["event_id", "props", "secret"], 20)


@query("sx01_tumbling_windows", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY 1, 2")
def sx01(spark, sf):
    w = jobs.windowed(table(spark, sf, "events"), "ts", ["event_type"], "value", "1 hour")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", R("total", 4).alias("total"))


@query("sx02_sessions", """WITH k AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM k)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, sid""")
def sx02(spark, sf):
    return jobs.sessions(table(spark, sf, "events"), "ts", ["user_id"], "30 minutes").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("sm08_stable_files", "WITH s AS (SELECT user_id AS path, event_id AS scan, event_id%3 AS size, lag(event_id%3) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) SELECT path, min(scan) AS admitted_at FROM s WHERE prev = size GROUP BY path")
def sm08(spark, sf):
    k = F.col("event_id")
    return jobs.admitted(table(spark, sf, "events").select(F.col("user_id").alias("path"), k.alias("scan"), (k % 3).alias("size"), F.lit(1).alias("mtime")))


@query("src02_pexels_pages", f"WITH r AS (SELECT p_partkey AS id, p_name || ' & ' || p_brand AS q, p_partkey%5-1 AS page, p_size*3 AS per_page, CASE p_partkey%3 WHEN 0 THEN 'landscape' WHEN 1 THEN '' END AS orientation, CASE p_partkey%4 WHEN 1 THEN 'red' END AS color FROM part) SELECT id, 'https://api.pexels.com/v1/search?query=' || replace(url_encode(q),'+','%20') || '&page=' || greatest(1,page) || '&per_page=' || least(80,greatest(1,per_page)) || CASE WHEN orientation <> '' THEN '&orientation=' || orientation ELSE '' END || CASE WHEN color <> '' THEN '&color=' || color ELSE '' END AS url, ceil(id/greatest(1,per_page)::DOUBLE)::BIGINT AS total_pages FROM r")
def src02(spark, sf):
    """The address of every search, with options only where they are set, and how many pages its total makes."""
    k = F.col("p_partkey")
    options = {"orientation": F.when(k % 3 == 0, "landscape").when(k % 3 == 1, ""), "color": F.when(k % 4 == 1, "red")}
    url = ld.pexels_url(F.concat("p_name", F.lit(" & "), "p_brand"), k % 5 - 1, F.col("p_size") * 3, options)
    return table(spark, sf, "part").select(k.alias("id"), url.alias("url"), ld.total_pages(k, F.col("p_size") * 3).alias("total_pages"))


@query("src03_fresh_cache", """WITH r AS (SELECT p_partkey AS id, 'https://pixabay.com/api/?q=' || replace(url_encode(p_name),'+','%20') || '&image_type=' || CASE p_partkey%3 WHEN 0 THEN 'photo' WHEN 1 THEN 'all' ELSE 'vector' END || '&order=' || CASE p_partkey%4 WHEN 0 THEN 'latest' ELSE 'popular' END || '&page=1&per_page=' || least(200,greatest(3,p_size)) AS url FROM part),
    c AS (SELECT sha256(url) AS k, (SELECT max(ts) FROM events) - to_hours((id*7%48)::INT) AS stamp, 'body' || id AS body FROM r WHERE id%5 <> 0), f AS (SELECT k, arg_max(body, stamp) AS body FROM c WHERE stamp > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY 1) SELECT id, sha256(url) AS cache_key, f.k IS NOT NULL AS hit FROM r LEFT JOIN f ON f.k = sha256(url)""")
def src03(spark, sf):
    """Which searches a cache of answers, kept for a day under the hash of their address, can serve."""
    k = F.col("p_partkey")
    url = ld.pixabay_url(F.col("p_name"), F.lit(0), F.col("p_size"), F.when(k % 3 == 0, "Photo").when(k % 3 == 1, "drawing").otherwise("vector"), F.when(k % 4 == 0, "latest").otherwise("odd"))
    r = table(spark, sf, "part").select(k.alias("id"), url.alias("url"))
    now = table(spark, sf, "events").agg(F.max("ts").alias("now"))  # one row
    c = r.where("id % 5 <> 0").join(F.broadcast(now), F.lit(True)).select(F.sha2("url", 256).alias("cache_key"), "now", F.expr("now - make_interval(0, 0, 0, 0, CAST(id * 7 % 48 AS INT))").alias("ingest_ts"), F.concat(F.lit("body"), F.col("id").cast("string")).alias("body"))
    return ld.cached(r, c, "url", F.col("now")).select("id", "cache_key", "hit")
