"""Sources and sinks: landed provider pages, JSON and NDJSON documents, image files, seeds and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huestrata.sources.staging import staged

#: The uniform projection of one search result.
PHOTO = T.StructType([T.StructField(n, t) for n, t in (
    ("id", T.StringType()), ("provider", T.StringType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("color", T.StringType()), ("alt", T.StringType()),
    ("image_small", T.StringType()), ("image_regular", T.StringType()), ("analysis_url", T.StringType()), ("photo_url", T.StringType()), ("photographer", T.StringType()), ("likes", T.IntegerType()),
)])

#: Where each provider keeps the fields of PHOTO; names as in its public JSON.
PROVIDERS: dict[str, dict[str, str]] = {
    "unsplash": {"id": "id", "width": "width", "height": "height", "color": "color", "alt": "alt_description", "image_small": "urls.small", "image_regular": "urls.regular", "analysis_url": "urls.small", "photo_url": "links.html", "photographer": "user.name", "likes": "likes"},
    "pexels": {"id": "id", "width": "width", "height": "height", "color": "avg_color", "alt": "alt", "image_small": "src.medium", "image_regular": "src.large", "analysis_url": "src.medium", "photo_url": "url", "photographer": "photographer"},
    "pixabay": {"id": "id", "width": "imageWidth", "height": "imageHeight", "alt": "tags", "image_small": "previewURL", "image_regular": "webformatURL", "analysis_url": "webformatURL", "photo_url": "pageURL", "photographer": "user", "likes": "likes"},
}


def photo_rows(raw: DataFrame, provider: str, column: str = "body") -> DataFrame:
    """PHOTO rows from a column of JSON objects, one result each; rows without an id go, ids carry the provider."""
    fields = PROVIDERS[provider]
    out = []
    for f in PHOTO.fields:
        v = F.get_json_object(column, f"$.{fields[f.name]}") if f.name in fields else F.lit(None)
        out.append(F.lit(provider).alias("provider") if f.name == "provider" else v.cast(f.dataType).alias(f.name))
    rows = raw.select(*out).where("id IS NOT NULL AND id <> ''")
    return rows.withColumn("id", F.concat(F.lit(f"{provider}:"), "id"))


def web_image_rows(raw: DataFrame, column: str = "body", prefix: str = "web:") -> DataFrame:
    """PHOTO rows of an image search: needs an original or a thumbnail, drops raw-image links, ids hash the first url."""
    get = lambda p: F.nullif(F.get_json_object(column, f"$.{p}"), F.lit(""))
    original, link, thumb = get("original"), get("link"), get("thumbnail")
    url = F.coalesce(original, link, thumb)
    rows = raw.where(F.coalesce(original, thumb).isNotNull() & ~F.coalesce(original, F.lit("")).startswith("x-raw-image://"))
    values = {"id": F.concat(F.lit(prefix), F.substring(F.sha2(url, 256), 1, 16)), "provider": F.lit("web"), "alt": get("title"), "image_small": thumb, "image_regular": original, "analysis_url": F.coalesce(thumb, original), "photo_url": link, "photographer": get("source"), "width": get("original_width"), "height": get("original_height")}
    return rows.select(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PHOTO.fields))


def enabled_sources(pages: dict[str, DataFrame], settings: dict[str, dict]) -> DataFrame:
    """The union of all providers that are enabled and have a key; an error if there is none."""
    use = [photo_rows(pages[p], p) for p in pages if settings.get(p, {}).get("enabled") and settings[p].get("key")]
    if not use:
        raise ValueError("no provider is enabled and has a key")
    out = use[0]
    for u in use[1:]:
        out = out.unionByName(u)
    return out


def fresh(cache: DataFrame, now: Column, hours: int = 24, stamp: str = "ingest_ts") -> DataFrame:
    """Rows of a cached landing zone that are younger than its time to live."""
    return cache.where(F.col(stamp) > now - F.expr(f"INTERVAL {hours} HOURS"))


def read_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON document per file with a fixed schema; unreadable files give nulls, not errors."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def read_latest(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json") -> DataFrame:
    """The rows of the most recently modified file under a path."""
    rows = spark.read.schema(schema).format(fmt).load(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_modification_time").alias("_at"))
    newest = rows.agg(F.max_by("_file", "_at").alias("_newest"))
    return rows.join(F.broadcast(newest), F.col("_file") == F.col("_newest")).drop("_file", "_at", "_newest")


def tail(spark: SparkSession, path: str, schema: T.StructType, order: str, n: int = 100) -> DataFrame:
    """The last n lines of NDJSON logs, newest first; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).orderBy(F.desc(order)).limit(n)


#: How image files begin.
SIGNATURES = [("FFD8FF", "jpeg"), ("89504E470D0A1A0A", "png"), ("474946383761", "gif"), ("474946383961", "gif"), ("424D", "bmp"), ("49492A00", "tiff"), ("4D4D002A", "tiff")]


def image_kind(content: Column) -> Column:
    """jpeg, png, gif, bmp, tiff, webp or avif by a file's first bytes; null for others, such as HTML."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(head.startswith("52494646") & head.endswith("57454250"), "webp").when(F.substring(head, 9, 16) == "6674797061766966", "avif")
    for magic, kind in SIGNATURES:
        out = out.when(head.startswith(magic), kind)
    return out


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, length, kind and content of the decodable image files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", image_kind(F.col("content")).alias("kind"), "content").where("kind IS NOT NULL")


def with_fallback(items: DataFrame, primary: Column, fallback: Column) -> DataFrame:
    """items with the url to use: the primary one, or the fallback at reliability 0.85."""
    return items.withColumns({"used_url": F.coalesce(primary, fallback), "fallback_used": primary.isNull(), "feature_reliability": F.when(primary.isNull(), 0.85).otherwise(1.0)})


def seed_queries(seeds: DataFrame, style: str, most: int = 6) -> DataFrame:
    """Query families (family, query) from seed rows, at most `most`; three made-up ones if there are none."""
    made = seeds.sparkSession.createDataFrame([("core", style), ("mood", f"{style} aesthetic"), ("detail", f"{style} detail")], "family string, query string")
    some = seeds.select("family", "query").orderBy("family", "query").limit(most)
    return some.unionByName(made.join(some.agg(F.count(F.lit(1)).alias("_n")), F.lit(True)).where("_n = 0").drop("_n"))


def pair_keys(docs: DataFrame, column: str = "body", name: str = "pair_key") -> DataFrame:
    """Every string under the key `name` anywhere in JSON documents, however deep, distinct. What is no JSON has none.

    The shape of the documents is open, so each becomes a variant, whose members are taken out
    level by level until no object or array is left; text that only looks like a key, inside a
    string, is none. Each level is written to the shared folder.
    """
    member = docs.select(F.try_parse_json(column).alias("v")).where(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)"))
    out = None
    while True:
        level = member.lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("v").outer())).select(F.col("key"), F.col("value"))
        level = staged(level)
        kind = F.schema_of_variant("value")
        found = level.where((F.col("key") == name) & (kind == "STRING")).select(F.col("value").cast("string").alias("pair_key")).where("pair_key <> ''")
        out = found if out is None else out.unionByName(found)
        member = level.where(kind.rlike("^(OBJECT|ARRAY)")).select(F.col("value").alias("v"))
        if member.isEmpty():
            return out.distinct()


def flatten_json(docs: DataFrame, key: str, column: str = "body", depth: int = 6) -> DataFrame:
    """Dotted paths and scalar values of nested JSON objects: key, path, value."""
    level = docs.select(key, F.lit("").alias("path"), F.parse_json(column).alias("v"))
    out = None
    for _ in range(depth):
        inner = level.select(key, F.col("path").alias("_p"), F.col("v").alias("_v")).lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("_v").outer()))
        inner = inner.select(key, F.concat(F.when(F.col("_p") == "", "").otherwise(F.concat("_p", F.lit("."))), F.coalesce(F.col("key"), F.col("pos").cast("string"))).alias("path"), F.col("value").alias("v"))
        nested = F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")
        leaf = inner.where(~nested).select(key, "path", F.col("v").cast("string").alias("value"))
        out = leaf if out is None else out.unionByName(leaf)
        level = inner.where(nested)
    return out


def allowlisted(log: DataFrame, fields: list[str], most: int = 240) -> DataFrame:
    """Log rows with the named scalar fields only, strings cut to `most` letters."""
    kinds = dict(log.dtypes)
    keep = [f for f in fields if f in kinds and not kinds[f].startswith(("array", "map", "struct", "binary"))]
    return log.select(*(F.substring(f, 1, most).alias(f) if kinds[f] == "string" else F.col(f) for f in keep))


def write_rounded(df: DataFrame, path: str, digits: int = 8) -> None:
    """JSON with doubles rounded to `digits`."""
    df.select(*(F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes)).write.mode("overwrite").json(path)


#: Fields that tell what a person or a model saw, which no packet may carry.
SUBJECTIVE = ["human_label", "gold_label", "ai_label", "perceptual_ground_truth", "tone_relation", "hue_relation"]


def physical_only(df: DataFrame) -> DataFrame:
    """df, if none of its fields, however deep, is subjective; else an error."""

    def names(kind):
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                yield f.name
                yield from names(f.dataType)
        elif isinstance(kind, T.ArrayType):
            yield from names(kind.elementType)
        elif isinstance(kind, T.MapType):
            yield from names(kind.valueType)

    bad = sorted({n for n in names(df.schema) if n in SUBJECTIVE})
    if bad:
        raise ValueError(f"subjective fields in a packet: {bad}")
    return df


# What requests to two providers may ask for.
PEXELS_OPTIONS = ["orientation", "size", "color", "locale"]
PIXABAY_KINDS, PIXABAY_ORDERS = ["all", "photo", "illustration", "vector"], ["popular", "latest"]


def request_url(base: str, parameters: list[tuple[str, Column]]) -> Column:
    """A request's address: the parameters in their order, percent-encoded; empty and null ones are left out."""
    one = [F.when(F.length(v.cast("string")) > 0, F.concat(F.lit(f"{n}="), F.replace(F.url_encode(v.cast("string")), F.lit("+"), F.lit("%20")))) for n, v in parameters]
    return F.concat(F.lit(base + "?"), F.concat_ws("&", *one))


def pexels_url(query: Column, page: Column, per_page: Column, options: dict[str, Column], most: int = 80) -> Column:
    """Page and size within bounds, options only where they are set."""
    return request_url("https://api.pexels.com/v1/search", [("query", F.trim(query)), ("page", F.greatest(F.lit(1), page)), ("per_page", F.least(F.lit(most), F.greatest(F.lit(1), per_page))), *((o, options[o]) for o in PEXELS_OPTIONS if o in options)])


def total_pages(total: Column, per_page: Column) -> Column:
    return F.ceil(total / F.greatest(F.lit(1), per_page))


def pixabay_url(query: Column, page: Column, per_page: Column, kind: Column, order: Column, most: int = 200) -> Column:
    """The query cut to a hundred letters; values out of an enumeration become its first; three results at least."""
    known = lambda v, allowed: F.when(F.lower(v).isin(allowed), F.lower(v)).otherwise(allowed[0])
    return request_url("https://pixabay.com/api/", [("q", F.substring(F.trim(query), 1, 100)), ("image_type", known(kind, PIXABAY_KINDS)), ("order", known(order, PIXABAY_ORDERS)), ("page", F.greatest(F.lit(1), page)), ("per_page", F.least(F.lit(most), F.greatest(F.lit(3), per_page)))])


def cached(requests: DataFrame, cache: DataFrame, url: str, now: Column, hours: int = 24) -> DataFrame:
    """requests with cache_key (SHA-256 of the address), hit, and the body of a cached answer that is not too old. cache: cache_key, ingest_ts, body."""
    newest = fresh(cache, now, hours).groupBy("cache_key").agg(F.max_by("body", "ingest_ts").alias("body"))
    return requests.withColumn("cache_key", F.sha2(F.col(url), 256)).join(newest, "cache_key", "left").withColumn("hit", F.col("body").isNotNull())
