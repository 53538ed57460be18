"""Grouped statistics as DataFrame functions: weighted moments and quantiles, ranks, percentiles, entropies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huestrata.operators.scans import inverse_cdf, segmented_scan


def weighted_moments(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """keys, n, weight, mean and population deviation; one partial aggregation, no second pass."""
    v, w = F.col(value), F.col(weight)
    out = df.groupBy(*keys).agg(F.count(v).alias("n"), F.sum(w).alias("weight"), (F.sum(v * w) / F.sum(w)).alias("mean"), (F.sum(v * v * w) / F.sum(w)).alias("_m2"))
    return out.select(*keys, "n", "weight", "mean", F.sqrt(F.greatest(F.col("_m2") - F.col("mean") * F.col("mean"), F.lit(0.0))).alias("std"))


def weighted_quantiles(df: DataFrame, keys: list[str], value: str, weight: str, quantiles: list[float]) -> DataFrame:
    """Inverse-CDF quantiles: the least value whose cumulative weight reaches q of the total."""
    names = {f"q{round(q * 100):02d}": F.lit(q) * F.col("total") for q in quantiles}
    return inverse_cdf(df, keys, value, names, weight, slack=1e-12).select(*keys, *names)


def mid_rank(df: DataFrame, value: str, keys: list[str] = (), name: str = "mid_rank") -> DataFrame:
    """Percentile by mid-rank of ties within the keys, values within 1e-12 tied; 1.0 for a single row.

    Distinct values are counted first, and their counts added up by ranges, so that a key is not one task.
    """
    keys = list(keys)
    df = df.withColumn("_q", F.floor(F.col(value) * 1e12 + 0.5))
    ties = segmented_scan(df.groupBy(*keys, "_q").agg(F.count(F.lit(1)).alias("_ties")), keys, ["_q"], {"_upto": "_ties"}, totals={"_all": "_ties"})
    ties = ties.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_q").alias("_q2"), "_ties", "_upto", "_all")
    same = F.col("_q").eqNullSafe(F.col("_q2"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    percentile = (F.col("_upto") - F.col("_ties") + (F.col("_ties") - 1) / 2) / (F.col("_all") - 1)
    ranked = df.join(ties, same).withColumn(name, F.when(F.col("_all") == 1, 1.0).otherwise(percentile))
    return ranked.drop("_q", "_q2", "_ties", "_upto", "_all", *(f"_k{i}" for i in range(len(keys))))


def nearest_rank(df: DataFrame, keys: list[str], value: str, fraction: float, how: str = "round", name: str = "p") -> DataFrame:
    """The value at place round((n-1)f), ceil(nf)-1 or floor((n-1)f) of the sorted values, or the linear percentile."""
    if how == "linear":
        return df.groupBy(*keys).agg(F.percentile(value, F.lit(fraction)).alias(name))
    part = Window.partitionBy(*keys)
    n = F.count(value).over(part)
    place = {"round": F.floor((n - 1) * fraction + 0.5), "ceil": F.greatest(F.ceil(n * fraction) - 1, F.lit(0)), "floor": F.floor((n - 1) * fraction)}[how]
    ranked = df.where(F.col(value).isNotNull()).withColumn("_at", F.row_number().over(part.orderBy(value)) - 1).withColumn("_place", place)
    return ranked.where("_at = _place").select(*keys, F.col(value).alias(name))


def normalized_entropy(df: DataFrame, keys: list[str], mass: str) -> DataFrame:
    """Shannon entropy of masses over the logarithm of their number; 0 for one or no mass.

    With T the sum of masses m it is ln T - sum(m ln m) / T: one partial aggregation, without their shares.
    """
    m = F.when(F.col(mass) > 0, F.col(mass).cast("double"))
    out = df.groupBy(*keys).agg(F.sum(m).alias("_t"), F.sum(m * F.ln(m)).alias("_s"), F.count(m).alias("n"))
    h = F.ln("_t") - F.col("_s") / F.col("_t")
    return out.select(*keys, "n", F.when(F.col("n") > 1, h / F.ln(F.col("n").cast("double"))).otherwise(0.0).alias("entropy"))


def softmax_entropy(scores: Column, scale: float = 1.0) -> Column:
    """Normalized entropy of the softmax of an array of scores.

    With z = (s - max) * scale and T the sum of exp(z) it is ln T - sum(z exp(z)) / T: one fold, for which the maximum is worked out once.
    """
    def h(top: Column) -> Column:
        z = lambda s: (s - top) * scale
        add = lambda a, s: F.struct((a["t"] + F.exp(z(s))).alias("t"), (a["u"] + z(s) * F.exp(z(s))).alias("u"))
        zero = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("u")).cast("struct<t:double,u:double>")
        return F.aggregate(scores.cast("array<double>"), zero, add, lambda a: F.ln(a["t"]) - a["u"] / a["t"])

    once = F.get(F.transform(F.array(F.array_max(scores)), h), 0)
    return F.when(F.size(scores) > 1, once / F.ln(F.size(scores).cast("double"))).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def circular_mean(x: Column, y: Column) -> dict[str, Column]:
    """Hue and concentration of a mean vector; no hue within 1e-12 of zero."""
    size, h = F.hypot(x, y), F.degrees(F.atan2(y, x))
    return {"concentration": size, "hue": F.when(size > 1e-12, F.when(h < 0, h + 360).otherwise(h))}
