"""Order statistics and running sums within keys of any size.

A window over a key, or an exact percentile of it, puts all rows of the key in one task. Here
no key is one task, however few there are:

* `inverse_cdf` selects by refining histograms. The range of a key's values is cut into bins,
  each bin's weight is summed with partial aggregation, and what was asked for is looked for
  in its bin alone. This is repeated until a bin holds few rows, which are then sorted.
* `segmented_scan` deals rows by ranges of (key, order), sums within each range, and adds the
  sums of the ranges before: one row for each key and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huestrata.sources.staging import staged

#: Bins of a round, and rows that are few enough to be sorted in one task.
BINS, FEW = 1024, 4096


def _same(keys: list[str]) -> Column:
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return on


def _renamed(keys: list[str]) -> list[Column]:
    return [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]


def _plain(keys: list[str]) -> list[Column]:
    return [F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)]


def inverse_cdf(df: DataFrame, keys: list[str], value: str, targets: dict[str, Column], weight: str | None = None, slack: float = 0.0, bins: int = BINS, few: int = FEW) -> DataFrame:
    """keys, n, total and, for each name, the least value at which the running weight reaches its target.

    Targets are expressions over n (rows of the key) and total (their weight; n without a
    weight). Values that are null or not finite take no part; a key with no other has no row.
    A key may be null. A target that `slack` does not bring within the total gives the largest
    value. The rounds are as many as it takes for a bin to hold at most `few` rows or one value.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & (F.abs(v) < float("inf"))).select(*_renamed(keys), v.alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("double").alias("_w"))
    ks = [f"_k{i}" for i in range(len(keys))]
    whole = rows.groupBy(*ks).agg(F.count(F.lit(1)).alias("n"), F.sum("_w").alias("total"), F.min("_v").alias("_low"), F.max("_v").alias("_high")).where("n > 0")
    wanted = F.map_from_arrays(F.array(*map(F.lit, targets)), F.array(*(t.cast("double") for t in targets.values())))
    now = staged(whole.select(*ks, "n", "total", "_low", "_high", F.col("n").alias("_in"), F.lit(0.0).alias("_before"), wanted.alias("_targets")))
    done, turn = None, 0
    while True:
        large = (F.col("_in") > few) & (F.col("_low") < F.col("_high"))
        done = now.where(~large) if done is None else done.unionByName(now.where(~large))
        left = now.where(large)
        if left.isEmpty():
            break
        now, turn = staged(_refined(rows, left, ks, bins, slack, turn % 2 == 1)), turn + 1
    return _picked(rows, done, ks, list(targets), slack).select(*_plain(keys), "n", "total", *targets)


def _inside(rows: DataFrame, ranges: DataFrame, ks: list[str], columns: list[str]) -> DataFrame:
    """Rows with the columns of the ranges (of their key) that they lie in. Ranges of a key do not overlap."""
    on = (F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high"))
    for k in ks:
        on = on & F.col(k).eqNullSafe(F.col(f"r{k}"))
    return rows.join(ranges.select(*(F.col(k).alias(f"r{k}") for k in ks), *columns), on)


def _refined(rows: DataFrame, ranges: DataFrame, ks: list[str], bins: int, slack: float, by_size: bool) -> DataFrame:
    """The bins of ranges that targets lie in, each narrowed to the values it really holds.

    Bins are of equal width, in the values themselves or (by_size) in their logarithms with
    their sign: rounds take turns, so that a few far values cannot hold up the rest.
    """
    inside = _inside(rows, ranges, ks, ["_low", "_high"])
    scale = (lambda x: F.signum(x) * (F.ln(F.greatest(F.abs(x), F.lit(5e-324))) + 750)) if by_size else (lambda x: x / 2)
    v, low, high = (scale(F.col(x)) for x in ("_v", "_low", "_high"))
    place = F.when(high > low, (v - low) / (high - low)).otherwise(F.when(F.col("_v") > F.col("_low"), 1.0).otherwise(0.0))
    inside = inside.withColumn("_bin", F.least(F.floor(place * bins), F.lit(bins - 1)))
    sums = inside.groupBy(*ks, "_low", "_bin").agg(F.count(F.lit(1)).alias("_rows"), F.sum("_w").alias("_sum"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    order = Window.partitionBy(*ks, "_low").orderBy("_bin")  # at most `bins` rows
    sums = sums.withColumns({"_run": F.sum("_sum").over(order), "_final": F.lead("_bin").over(order).isNull()})
    of = ranges.select(*(F.col(k).alias(f"r{k}") for k in ks), F.col("_low").alias("r_low"), "n", "total", "_before", F.explode("_targets").alias("_name", "_target"))
    on = F.col("_low") == F.col("r_low")
    for k in ks:
        on = on & F.col(k).eqNullSafe(F.col(f"r{k}"))
    run = F.col("_before") + F.col("_run")
    hit = sums.join(of, on).where((run + slack >= F.col("_target")) | F.col("_final"))
    first = F.min_by(F.struct("_bin", F.col("_least").alias("l"), F.col("_most").alias("h"), F.col("_rows").alias("i"), (run - F.col("_sum")).alias("b"), "n", "total", "_target"), "_bin").alias("m")
    found = hit.groupBy(*ks, "_low", "_name").agg(first)
    out = found.groupBy(*ks, "_low", F.col("m._bin").alias("_bin")).agg(F.first("m").alias("m"), F.map_from_entries(F.collect_list(F.struct("_name", "m._target"))).alias("_targets"))
    return out.select(*ks, "m.n", "m.total", F.col("m.l").alias("_low"), F.col("m.h").alias("_high"), F.col("m.i").alias("_in"), F.col("m.b").alias("_before"), "_targets")


def _picked(rows: DataFrame, ranges: DataFrame, ks: list[str], names: list[str], slack: float) -> DataFrame:
    """The value of each target, from ranges of one value or of few rows."""
    one = F.col("_low") == F.col("_high")
    inside = _inside(rows, ranges.where(~one), ks, ["_low", "_high", "_before", "n", "total", "_targets"])
    run = F.col("_before") + F.sum("_w").over(Window.partitionBy(*ks, "_low").orderBy("_v").rangeBetween(Window.unboundedPreceding, 0))
    at = lambda x: F.element_at("_targets", F.lit(x))
    reached = inside.withColumn("_run", run).groupBy(*ks, "_low").agg(
        F.first("n").alias("n"), F.first("total").alias("total"),
        *(F.coalesce(F.min(F.when(F.col("_run") + slack >= at(x), F.col("_v"))), F.max(F.when(at(x).isNotNull(), F.col("_v")))).alias(x) for x in names))
    plain = ranges.where(one).select(*ks, "_low", "n", "total", *(F.when(at(x).isNotNull(), F.col("_low")).alias(x) for x in names))
    return reached.unionByName(plain).groupBy(*ks).agg(F.first("n").alias("n"), F.first("total").alias("total"), *(F.max(x).alias(x) for x in names)).where("n > 0")


def percentiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple[str, float]], **sizes: int) -> DataFrame:
    """keys, n and exact percentiles by name: (how, fraction).

    how: 'round' the value at place round((n-1)f), 'ceil' at ceil(nf)-1, 'floor' at floor((n-1)f), all from 0; 'linear'
    between the two places around (n-1)f.
    """
    n = F.col("n")
    place = {
        "round": lambda f: F.floor((n - 1) * f + 0.5), "ceil": lambda f: F.greatest(F.ceil(n * f - 1e-9) - 1, F.lit(0)),
        "floor": lambda f: F.floor((n - 1) * f + 1e-9), "next": lambda f: F.ceil((n - 1) * f - 1e-9),
    }
    targets: dict[str, Column] = {}
    for name, (how, f) in wanted.items():
        for tag, rule in (("_floor", "floor"), ("_next", "next")) if how == "linear" else (("", how),):
            targets[name + tag] = place[rule](f) + 1
    got = inverse_cdf(df, keys, value, targets, **sizes)
    part = lambda f: (n - 1) * f - F.floor((n - 1) * f + 1e-9)
    line = lambda x, f: F.col(f"{x}_floor") + (F.col(f"{x}_next") - F.col(f"{x}_floor")) * part(f)
    return got.select(*keys, "n", *((line(x, f) if how == "linear" else F.col(x)).alias(x) for x, (how, f) in wanted.items()))


# --- running sums -------------------------------------------------------------------------


def segmented_scan(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], place: str | None = None, totals: dict[str, str] | None = None) -> DataFrame:
    """df with running sums (name: column) within the keys up to and with each row, its place from 1, and totals (name: column) of the key.

    Rows go by `order`, ascending and nulls first; rows equal in it are ordered among
    themselves as they happen to lie. With no key all rows are one segment. Nulls add nothing.
    """
    totals = totals or {}
    columns, amounts = df.columns, list(dict.fromkeys([*sums.values(), *totals.values()]))
    ranges = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = staged(ranges.withColumn("_part", F.spark_partition_id()))
    held = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), *(F.coalesce(F.sum(a), F.lit(0)).alias(f"_s{i}") for i, a in enumerate(amounts)))
    key = Window.partitionBy(*keys)
    before = key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that holds the key
    ahead = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0))
    held = held.select(*_renamed(keys), F.col("_part").alias("_p"), ahead("_n").alias("_n0"), *(ahead(f"_s{i}").alias(f"_b{i}") for i in range(len(amounts))), *(F.sum(f"_s{i}").over(key).alias(f"_t{i}") for i in range(len(amounts))))
    own = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns({"_rn": F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order))} | {f"_r{i}": F.coalesce(F.sum(a).over(own), F.lit(0)) for i, a in enumerate(amounts)})
    both = local.join(held, _same(keys) & (F.col("_part") == F.col("_p")))
    out = [(F.col(f"_r{amounts.index(a)}") + F.col(f"_b{amounts.index(a)}")).alias(name) for name, a in sums.items()]
    out += [F.col(f"_t{amounts.index(a)}").alias(name) for name, a in totals.items()]
    return both.select(*columns, *out, *([(F.col("_rn") + F.col("_n0")).alias(place)] if place else []))
