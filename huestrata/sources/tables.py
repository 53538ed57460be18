"""Tables of a data folder, and the colour views that the queries derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huestrata.functions import color as c


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_lab(df: DataFrame, r: str = "r", g: str = "g", b: str = "b") -> DataFrame:
    """Adds L, a, bb (OKLab), C and H (OKLCH, null hue when grey) to rows with 8-bit channels."""
    L, a, bb = c.rgb_to_oklab(F.col(r), F.col(g), F.col(b))
    df = df.withColumns({"L": L, "a": a, "bb": bb})
    return df.withColumns({"C": c.chroma(F.col("a"), F.col("bb")), "H": c.hue(F.col("a"), F.col("bb"))})


def swatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One colour per part, 80 to an image: id, image_id, family, r, g, b, w and its OKLab and OKLCH."""
    p = table(spark, sf_dir, "part")
    rows = p.select(
        F.col("p_partkey").cast("long").alias("id"), F.floor(F.col("p_partkey") / 80).cast("long").alias("image_id"), F.col("p_brand").alias("family"),
        ((F.col("p_partkey") * 37) % 256).cast("int").alias("r"), ((F.col("p_partkey") * 91 + 13) % 256).cast("int").alias("g"),
        ((F.col("p_size") * 53 + F.col("p_partkey")) % 256).cast("int").alias("b"), (F.col("p_retailprice") / 1000.0).alias("w"),
    )
    return with_lab(rows)


#: Modes of a style. A relation graph is complete within a style, so its edges grow with the number of styles.
STYLE_MODES = 53


def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One colour mode per supplier, eight to an image and 53 to a style: id, image_id, style, family, r, g, b, mass and its OKLab and OKLCH."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    rows = s.select(
        k.cast("long").alias("id"), F.floor(k / 8).cast("long").alias("image_id"), F.floor(k / STYLE_MODES).cast("long").alias("style"), (F.col("s_nationkey") % 5).cast("long").alias("family"),
        ((k * 67 + 29) % 256).cast("int").alias("r"), ((k * 149 + 7) % 256).cast("int").alias("g"), ((k * 211 + 101) % 256).cast("int").alias("b"),
        (F.round(F.abs(F.col("s_acctbal")) / 1000.0, 3) + 0.001).alias("mass"),
    )
    return with_lab(rows)


# --- the same views in SQL ----------------------------------------------------------------


def _linear(x: str) -> str:
    return f"CASE WHEN {x}/255.0::DOUBLE <= 0.04045 THEN ({x}/255.0::DOUBLE)/12.92::DOUBLE ELSE pow(({x}/255.0::DOUBLE+0.055::DOUBLE)/1.055::DOUBLE, 2.4::DOUBLE) END"


def lab_sql(source: str, name: str) -> str:
    """CTEs that add L, a, bb, C and H to a source with columns r, g, b."""
    return f"""
    {name}_1 AS (SELECT *, {_linear('r')} AS lr, {_linear('g')} AS lg, {_linear('b')} AS lb FROM {source}),
    {name}_2 AS (SELECT *, cbrt(lr*0.4122214708+lg*0.5363325363+lb*0.0514459929) AS p, cbrt(lr*0.2119034982+lg*0.6806995451+lb*0.1073969566) AS q,
                 cbrt(lr*0.0883024619+lg*0.2817188376+lb*0.6299787005) AS s3 FROM {name}_1),
    {name}_3 AS (SELECT *, p*0.2104542553+q*0.7936177850-s3*0.0040720468 AS L, p*1.9779984951-q*2.4285922050+s3*0.4505937099 AS a,
                 p*0.0259040371+q*0.7827717662-s3*0.8086757660 AS bb FROM {name}_2),
    {name}_4 AS (SELECT *, sqrt(a*a+bb*bb) AS C, degrees(atan2(bb, a)) AS h0 FROM {name}_3),
    {name} AS (SELECT * EXCLUDE (lr, lg, lb, p, q, s3, h0), CASE WHEN C >= 1e-5 THEN CASE WHEN h0 < 0 THEN h0 + 360 ELSE h0 END END AS H FROM {name}_4)"""


SWATCHES_SQL = (
    """pix AS (SELECT p_partkey::BIGINT AS id, (p_partkey // 80)::BIGINT AS image_id, p_brand AS family, ((p_partkey*37)%256)::INT AS r,
    ((p_partkey*91+13)%256)::INT AS g, ((p_size*53+p_partkey)%256)::INT AS b, p_retailprice/1000.0::DOUBLE AS w FROM part),"""
    + lab_sql("pix", "swatches")
)
MODES_SQL = (
    """sup AS (SELECT s_suppkey::BIGINT AS id, (s_suppkey // 8)::BIGINT AS image_id, (s_suppkey // 53)::BIGINT AS style, (s_nationkey % 5)::BIGINT AS family, ((s_suppkey*67+29)%256)::INT AS r,
    ((s_suppkey*149+7)%256)::INT AS g, ((s_suppkey*211+101)%256)::INT AS b, round(abs(s_acctbal)/1000.0::DOUBLE, 3)+0.001::DOUBLE AS mass FROM supplier),"""
    + lab_sql("sup", "modes")
)
