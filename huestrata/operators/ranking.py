"""Ranking, diverse selection and top-k operators."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huestrata.sources.staging import staged


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its 1-based place in a total order, and the number of rows n, without one task that holds all rows.

    Rows are range-partitioned and sorted; each partition counts on its own, and the few
    partition totals (one row each) are added in front.
    """
    spark = df.sparkSession
    columns = df.columns
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id())
    local = placed.withColumn("_rn", F.row_number().over(Window.partitionBy("_pid").orderBy(*order)))
    sizes = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_pid")) - F.col("_size")).withColumn("n", F.sum("_size").over(Window.partitionBy()))
    return local.join(F.broadcast(before.select("_pid", "_before", "n")), "_pid").select(*columns, (F.col("_rn") + F.col("_before")).alias(name), "n")


def global_running(df: DataFrame, order: list[Column], amount: str, name: str) -> DataFrame:
    """df with the sum of amount over the rows before each in a total order, and the sum over all as `total`; no task holds all rows."""
    columns = df.columns
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id())
    local = placed.withColumn("_run", F.sum(amount).over(Window.partitionBy("_pid").orderBy(*order)) - F.col(amount))
    sums = local.groupBy("_pid").agg(F.sum(amount).alias("_all"))
    before = sums.select("_pid", (F.sum("_all").over(Window.orderBy("_pid")) - F.col("_all")).alias("_before"), F.sum("_all").over(Window.partitionBy()).alias("total"))  # one row for each partition
    return local.join(F.broadcast(before), "_pid").select(*columns, (F.col("_run") + F.col("_before")).alias(name), "total")


def backend_score(content: Column, theme: Column, retrieval: Column, overlap: Column, gate: Column, content_weight: float = 0.5, retrieval_weight: float = 0.2, overlap_weight: float = 0.1) -> Column:
    """Ranking score; weights are clamped (content from 0.5, retrieval to 0.2, overlap to 0.1, theme 0.2) and normalised."""
    w = [max(0.5, content_weight), 0.2, min(0.2, max(0.0, retrieval_weight)), min(0.1, max(0.0, overlap_weight))]
    total = sum(w)
    score = sum((x * (k / total) for x, k in zip((content, theme, retrieval, overlap), w, strict=True)), F.lit(0.0))
    return score * F.when(gate == "PASS", 1.0).otherwise(0.94)


def best_fit_score(semantic, theme, palette, colour, overlap, penalty, unusable, gate) -> Column:
    """Client-side ranking score from its five positive parts and two penalties."""
    w = [0.32, 0.18, 0.22, 0.24, 0.08]
    positive = sum((x * k for x, k in zip((semantic, theme, palette, colour, overlap), w, strict=True)), F.lit(0.0)) / sum(w)
    raw = (positive - penalty * 0.4 - unusable * 0.28) * F.when(gate == "PASS", 1.0).otherwise(0.94)
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))


def qualify(df: DataFrame, score: str, tie: str, least: float = 0.5, at_least: int = 12, share: float = 0.7) -> DataFrame:
    """Rows of score `least` or more within the best max(at_least, ceil(share n)) of all."""
    ranked = global_rank(df, [F.desc(score), F.asc(tie)], "_place")
    return ranked.where((F.col(score) >= least) & (F.col("_place") <= F.greatest(F.lit(at_least), F.ceil(F.col("n") * share)))).drop("_place", "n")


def diverse_top(df: DataFrame, keys: list[str], k: int, score: str = "score", id_col: str = "id", url: str = "url", provider: str = "provider", author: str = "author", per_author: int = 2) -> DataFrame:
    """For each group the k best rows: at most ceil(0.6 k) of a provider and per_author of an author, then without the
    provider's limit, then without both; never an id or url twice. Adds place.

    Groups are search results, a few hundred rows at most, so each fits a task.
    """
    cap = max(2, math.ceil(k * 0.6))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, id_col], ascending=[False, True], kind="stable").reset_index(drop=True)
        chosen: list[int] = []
        ids, urls, providers, authors = set(), set(), Counter(), Counter()
        for by_provider, by_author in ((True, True), (False, True), (False, False)):
            for i, row in enumerate(pdf[[id_col, url, provider, author]].itertuples(index=False)):
                if len(chosen) >= k:
                    break
                if row[0] in ids or row[1] in urls or (by_provider and providers[row[2]] >= cap) or (by_author and authors[row[3]] >= per_author):
                    continue
                chosen.append(i)
                ids.add(row[0])
                urls.add(row[1])
                providers[row[2]] += 1
                authors[row[3]] += 1
        out = pdf.loc[chosen]
        return out.assign(place=range(1, len(out) + 1))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", place int"
    return df.groupBy(*keys).applyInPandas(pick, schema)


def near_duplicate_greedy(df: DataFrame, keys: list[str], order: str, hash_col: str, author: str, most_bits: int = 5, per_author: int = 2) -> DataFrame:
    """Per group, in order: rows whose 64-bit hash is further than most_bits from all kept and whose author is not used up."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, kept, hashes, authors = pdf.sort_values(order, kind="stable").reset_index(drop=True), [], [], Counter()
        for i, (h, who) in enumerate(zip(pdf[hash_col], pdf[author], strict=True)):
            value = int(h, 16)
            if authors[who] >= per_author or any((value ^ x).bit_count() <= most_bits for x in hashes):
                continue
            kept.append(i)
            hashes.append(value)
            authors[who] += 1
        return pdf.loc[kept]

    return df.groupBy(*keys).applyInPandas(keep, df.schema)


def round_robin(df: DataFrame, bucket: list[str], order: list[str], n: int) -> DataFrame:
    """n rows that take turns over the buckets: the first of each, then the second, in bucket order.

    No bucket gives more than n rows: the first n of each of its parts are found before the parts meet.
    """
    columns = df.columns
    parted = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(64)))
    first = parted.withColumn("_turn", F.row_number().over(Window.partitionBy("_part", *bucket).orderBy(*order))).where(F.col("_turn") <= n).select(*columns)
    turn = F.row_number().over(Window.partitionBy(*bucket).orderBy(*order))
    return first.withColumn("_turn", turn).where(F.col("_turn") <= n).orderBy("_turn", *bucket).limit(n).drop("_turn")


def _filled(pdf: pd.DataFrame, k: int, axes: list[str], seed: str, id_col: str, ends: tuple[str, str], most_use: int) -> list[int]:
    """Places in pdf of up to k rows, each the furthest (on axes scaled to 0..1) from those chosen; no end is used more than most_use times."""
    h = np.array([int(hashlib.sha256(f"{seed}|{x}".encode()).hexdigest()[:12], 16) for x in pdf[id_col]], dtype=float) / (2**48 - 1)
    order = np.argsort(h, kind="stable")
    h, v = h[order], pdf[axes].to_numpy(float)[order]
    if not len(v):
        return []
    span = v.max(0) - v.min(0)
    v = (v - v.min(0)) / np.where(span == 0, 1.0, span)
    one, two = np.unique(pdf[list(ends)].to_numpy()[order].ravel(), return_inverse=True)[1].reshape(-1, 2).T
    used, open_rows = np.zeros(max(one.max(), two.max()) + 1, int), np.ones(len(v), bool)
    far, chosen = np.ones(len(v)), []
    while len(chosen) < k:
        left = open_rows & (used[one] < most_use) & (used[two] < most_use)
        if not left.any():
            break
        best = int(np.argmax(np.where(left, far + h * 1e-9, -np.inf)))
        d = ((v - v[best]) ** 2).sum(1) ** 0.5
        far = np.minimum(far, d) if chosen else d
        chosen.append(best)
        open_rows[best] = False
        used[one[best]] += 1
        used[two[best]] += 1
    return order[chosen].tolist()


def space_filling(df: DataFrame, keys: list[str], k: int, axes: list[str], seed: str, id_col: str = "pair_key", ends: tuple[str, str] = ("id_1", "id_2"), most_use: int = 3) -> DataFrame:
    """Per group up to k rows, each the furthest (on axes scaled to 0..1) from those chosen; no end is used more than most_use times."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen = _filled(pdf, k, axes, seed, id_col, ends, most_use)
        return pdf.iloc[chosen].assign(place=range(1, len(chosen) + 1))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", place int"
    return df.groupBy(*keys).applyInPandas(pick, schema)


def space_filling_pool(df: DataFrame, k: int, axes: list[str], seed: str, id_col: str = "pair_key", ends: tuple[str, str] = ("id_1", "id_2"), most_use: int = 3) -> DataFrame:
    """space_filling of one pool of any size: (place, id). Each round is one distributed maximum over the whole pool."""
    lows = df.agg(*(F.min(x).alias(f"low_{i}") for i, x in enumerate(axes)), *(F.max(x).alias(f"high_{i}") for i, x in enumerate(axes))).first()
    schema = f"place int, `{id_col}` {df.schema[id_col].dataType.simpleString()}"
    if lows[0] is None:
        return df.sparkSession.createDataFrame([], schema)
    scaled = [((F.col(x) - lows[i]) / ((lows[len(axes) + i] - lows[i]) or 1.0)).alias(f"v_{i}") for i, x in enumerate(axes)]
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")), 256), 1, 12), 16, 10).cast("double") / float(2**48 - 1)
    pool = df.select(F.col(id_col).alias("_id"), F.col(ends[0]).alias("_1"), F.col(ends[1]).alias("_2"), *scaled, h.alias("_h")).persist()
    chosen, used = [], Counter()
    while len(chosen) < k:
        away = [F.sqrt(sum((F.col(f"v_{i}") - r[f"v_{i}"]) * (F.col(f"v_{i}") - r[f"v_{i}"]) for i in range(len(axes)))) for r in chosen]
        far = F.lit(1.0) if not away else away[0] if len(away) == 1 else F.least(*away)
        full = [x for x, n in used.items() if n >= most_use]
        open_rows = pool.where(~F.col("_id").isin([r["_id"] for r in chosen])) if chosen else pool
        open_rows = open_rows.where(~F.col("_1").isin(full) & ~F.col("_2").isin(full)) if full else open_rows
        best = open_rows.agg(F.max_by(F.struct(*pool.columns), F.struct((far + F.col("_h") * 1e-9).alias("s"), -F.col("_h"), "_id")).alias("m")).first()["m"]
        if best is None:
            break
        chosen.append(best)
        used.update((best["_1"], best["_2"]))
    pool.unpersist()
    return df.sparkSession.createDataFrame([(i, r["_id"]) for i, r in enumerate(chosen, 1)], schema)


def capped_take(df: DataFrame, strata: list[str], order: list[str], per_stratum: int) -> DataFrame:
    """The first per_stratum rows of each stratum."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*strata).orderBy(*order))).where(F.col("_rn") <= per_stratum).drop("_rn")


def softly_capped(df: DataFrame, keys: list[str], family: str, rank: str, n: int, cap: int) -> DataFrame:
    """Up to n rows per key in the order of rank, with place: no more than cap of a family, unless the others are too few. Keys are pools of bounded size."""
    key = Window.partitionBy(*keys)
    of_family = F.row_number().over(Window.partitionBy(*keys, family).orderBy(rank))
    turned = df.withColumn("_over", of_family > cap).withColumn("_turn", F.row_number().over(key.orderBy("_over", rank)))
    return turned.where(F.col("_turn") <= n).withColumn("place", F.row_number().over(key.orderBy(rank))).drop("_over", "_turn")


def ordered_merge(rows: Iterator[tuple], limit: float) -> list[tuple]:
    """Greedy merge of (weight, L, a, b) in falling weight: a row joins the first mean within limit, which moves by weight."""
    out: list[list[float]] = []
    for w, L, a, b in sorted(rows, key=lambda r: -r[0]):
        for m in out:
            if math.dist((L, a, b), m[1:]) < limit:
                t = m[0] + w
                m[1:] = [(x * m[0] + y * w) / t for x, y in zip(m[1:], (L, a, b), strict=True)]
                m[0] = t
                break
        else:
            out.append([w, L, a, b])
    return [tuple(m) for m in out]


def fresh_split(pool: DataFrame, used: DataFrame, keys: list[str], axes: list[str], seeds: tuple[str, str] = ("train", "validation"), sizes: tuple[int, int] = (24, 12), most_use: tuple[int, int] = (3, 2)) -> DataFrame:
    """Per key two disjoint space-filling selections of pairs that `used` does not hold: keys, part, place, pair_key, digest of the part's pairs.

    A key's pairs are one pool of bounded size.
    """
    ends = ("id_1", "id_2")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, size, most in zip(seeds, sizes, most_use, strict=True):
            chosen = _filled(pdf, size, axes, part, "pair_key", ends, most)
            picked = pdf["pair_key"].iloc[chosen].tolist()
            digest = hashlib.sha256("\n".join(sorted(picked)).encode()).hexdigest()
            out.append(pdf[keys].iloc[chosen].assign(part=part, place=range(1, len(chosen) + 1), pair_key=picked, digest=digest))
            pdf = pdf.drop(pdf.index[chosen])
        return pd.concat(out)

    kinds = {f.name: f.dataType.simpleString() for f in pool.schema.fields}
    schema = ", ".join(f"`{x}` {kinds[x]}" for x in keys) + f", part string, place int, pair_key {kinds['pair_key']}, digest string"
    open_pool = pool.join(used.select("pair_key"), "pair_key", "left_anti").select(*keys, "pair_key", *ends, *axes)
    return open_pool.groupBy(*keys).applyInPandas(pick, schema)


# --- selections whose picks depend on each other ------------------------------------------------


def balanced_slice(df: DataFrame, keys: list[str], bucket: list[str], order: str, target: int) -> DataFrame:
    """Per group (keys) up to target rows that take turns over its buckets, which come in the order of their first rows.

    When a bucket runs out, turns begin again with the first one left. order is unique within
    a group. Of a bucket only the first target rows can ever be taken, so a task holds no more
    of each.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        queues = [list(ix)[::-1] for ix in pdf.groupby(bucket, sort=False).indices.values()]
        queues.sort(key=lambda q: q[-1])
        chosen, cursor = [], 0
        while len(chosen) < target and queues:
            at = cursor % len(queues)
            chosen.append(queues[at].pop())
            if queues[at]:
                cursor += 1
            else:
                del queues[at]
                cursor = 0
        return pdf.loc[chosen].assign(place=range(1, len(chosen) + 1))

    first = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, *bucket).orderBy(order))).where(F.col("_rn") <= target).drop("_rn")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", place int"
    return first.groupBy(*keys).applyInPandas(pick, schema)


def _least(pool: DataFrame, wanted: list[tuple[Column, Column]], id_col: str, columns: list[str], n: int, buckets: int = 4096) -> list[list]:
    """For each (condition, value) the n rows of least value, ties by id: two passes over the pool, of which nothing is kept or sorted.

    The first takes the least value of each bucket of ids. The n-th of these bounds the n-th least value of all, so the second
    looks only at rows within it.
    """
    names = [f"_w{i}" for i in range(len(wanted))]
    rows = pool.select(id_col, *columns, *(F.when(test, value).alias(w) for w, (test, value) in zip(names, wanted, strict=True)))
    lows = rows.groupBy(F.pmod(F.xxhash64(id_col), F.lit(buckets)).alias("_b")).agg(*(F.min(w).alias(w) for w in names)).collect()  # a row a bucket
    bounds = [sorted(r[w] for r in lows if r[w] is not None) for w in names]
    bounds = [x[n - 1] if len(x) >= n else None for x in bounds]
    near = [F.col(w).isNotNull() if bound is None else F.col(w) <= bound for w, bound in zip(names, bounds, strict=True)]
    found = rows.withColumn("_of", F.explode(F.array_compact(F.array(*(F.when(test, F.struct(F.lit(i).alias("i"), F.col(w).alias("v"))) for i, (w, test) in enumerate(zip(names, near, strict=True)))))))
    ranked = found.select(F.col("_of.i").alias("_i"), F.col("_of.v").alias("_v"), id_col, *columns).withColumn("_rn", F.row_number().over(Window.partitionBy("_i").orderBy("_v", id_col))).where(F.col("_rn") <= n)
    out: list[list] = [[] for _ in wanted]
    for r in sorted(ranked.collect(), key=lambda r: r["_rn"]):
        out[r["_i"]].append(r)
    return out


def boundary_take(pool: DataFrame, takes: list[tuple[str, str, Column | None, int]], id_col: str = "pair_key", ends: tuple[str, str] = ("id_1", "id_2"), most_use: int = 2, first: int = 512) -> DataFrame:
    """Rows near boundaries: no, category, id. takes: (category, margin column, condition or None, how many), one after another.

    Each pick is the row of least margin, ties by id, that no earlier pick used and whose ends
    were not used most_use times. A row counts for a category only where its margin is not
    null. Picks are made from the `first` rows of each take; if those run out, from twice as many.
    """
    wanted = [(F.lit(True) if condition is None else condition, F.col(margin)) for _, margin, condition, _ in takes]
    while True:
        chosen, used, short = [], Counter(), False
        for (category, _, _, n), rows in zip(takes, _least(pool, wanted, id_col, list(ends), first), strict=True):
            taken = {c[2] for c in chosen}
            for _ in range(n):
                best = next((r for r in rows if r[id_col] not in taken and all(used[r[e]] < most_use for e in ends)), None)
                if best is None:
                    short |= len(rows) == first
                    break
                chosen.append((len(chosen) + 1, category, best[id_col]))
                taken.add(best[id_col])
                used.update(best[e] for e in ends)
        if not short:
            return pool.sparkSession.createDataFrame(chosen, f"no int, category string, `{id_col}` {pool.schema[id_col].dataType.simpleString()}")
        first *= 2


def stratified_diverse(df: DataFrame, strata: list[str], axes: list[str], n: int, seed: str, id_col: str = "pair_key", ends: tuple[str, str] = ("id_1", "id_2"), reuse: float = 0.12) -> DataFrame:
    """n rows of every stratum, far apart on axes scaled to 0..1 within it: strata, place, id.

    The first is one of the five nearest to the stratum's mean, which one the seed tells; each
    next has the largest distance to those chosen, less `reuse` for every use of its ends and
    with a seeded millionth to break ties. A round is one maximum a stratum over the pool, which
    is written once, in files that tasks share out, and neither sorted nor shuffled; what is
    joined by broadcast is a row for each stratum.
    """
    df = staged(df.select(*strata, id_col, *ends, *axes))
    parts = [F.min(a).alias(f"_l{i}") for i, a in enumerate(axes)] + [F.max(a).alias(f"_h{i}") for i, a in enumerate(axes)] + [F.avg(a).alias(f"_a{i}") for i, a in enumerate(axes)]
    spread = df.groupBy(*strata).agg(*parts).collect()  # a row for each stratum
    if not spread:
        return df.select(*strata, F.lit(1).alias("place"), id_col).limit(0)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    low = df.sparkSession.createDataFrame(spread, ", ".join(f"`{s}` {kinds[s]}" for s in strata) + ", " + ", ".join(f"_{x}{i} double" for x in "lha" for i in range(len(axes))))
    at = lambda i, x: F.when(F.col(f"_h{i}") > F.col(f"_l{i}"), (F.col(x) - F.col(f"_l{i}")) / (F.col(f"_h{i}") - F.col(f"_l{i}"))).otherwise(0.0)
    scaled = F.array(*(at(i, a) for i, a in enumerate(axes)))
    mean = F.array(*(at(i, f"_a{i}") for i in range(len(axes))))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), F.col("_id").cast("string")), 256), 1, 12), 16, 10).cast("double") / float(2**48 - 1)
    pool = df.join(F.broadcast(low), strata).select(*strata, F.col(id_col).alias("_id"), F.col(ends[0]).alias("_1"), F.col(ends[1]).alias("_2"), scaled.alias("_v"), mean.alias("_m"))
    apart = lambda x, y: F.sqrt(sum(((F.get(x, i) - F.get(y, i)) * (F.get(x, i) - F.get(y, i)) for i in range(1, len(axes))), (F.get(x, 0) - F.get(y, 0)) * (F.get(x, 0) - F.get(y, 0))))
    # of each stratum's 64 buckets the nearest; the fifth of these bounds the fifth nearest of all
    buckets = pool.groupBy(*strata, F.pmod(F.xxhash64("_id"), F.lit(64)).alias("_b")).agg(F.min(apart(F.col("_v"), F.col("_m"))).alias("_d"))
    bound = buckets.groupBy(*strata).agg(F.get(F.array_sort(F.collect_list("_d")), 4).alias("_far"))
    near = pool.withColumn("_d", apart(F.col("_v"), F.col("_m"))).join(F.broadcast(bound), strata).where("_far IS NULL OR _d <= _far")
    near = near.withColumn("_rn", F.row_number().over(Window.partitionBy(*strata).orderBy("_d", "_id"))).where("_rn <= 5")
    turn = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), *(F.col(s).cast("string") for s in strata)), 256), 1, 12), 16, 10).cast("double") / float(2**48)
    some = F.count(F.lit(1)).over(Window.partitionBy(*strata))
    chosen = [r.asDict(recursive=True) | {"place": 1} for r in near.withColumn("_turn", F.floor(turn * some) + 1).where("_rn = _turn").select(*strata, "_id", "_1", "_2", "_v").collect()]
    kinds = {f.name: f.dataType.simpleString() for f in pool.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*strata, "_id", "_1", "_2", "_v")) + ", place int"
    for place in range(2, n + 1):
        now = df.sparkSession.createDataFrame([tuple(r[c] for c in (*strata, "_id", "_1", "_2", "_v", "place")) for r in chosen], schema)
        held = now.groupBy(*strata).agg(F.collect_list("_v").alias("_vs"), F.collect_list("_id").alias("_ids"), F.flatten(F.collect_list(F.array("_1", "_2"))).alias("_used"))
        rows = pool.withColumn("_h", h)
        rows = rows.join(F.broadcast(held), strata).where(~F.array_contains("_ids", F.col("_id")))
        times = lambda e: F.size(F.filter("_used", lambda u: u == F.col(e)))
        score = F.array_min(F.transform("_vs", lambda v: apart(F.col("_v"), v))) - reuse * (times("_1") + times("_2")) + F.col("_h") * 1e-6
        # a maximum of structs would sort the pool: the bucket that holds it is found by numbers, and only its rows are compared
        rows = rows.withColumn("_b", F.pmod(F.xxhash64("_id"), F.lit(64)))
        tops = rows.groupBy(*strata, "_b").agg(F.max(score).alias("_top"))
        won = tops.withColumn("_best", F.max("_top").over(Window.partitionBy(*strata))).where("_top = _best").drop("_best")
        rows = rows.join(F.broadcast(won), [*strata, "_b"]).withColumn("_s", score).where("_s = _top")
        best = rows.groupBy(*strata).agg(F.max_by(F.struct("_id", "_1", "_2", "_v"), "_id").alias("m")).select(*strata, "m.*").collect()  # a row for each stratum
        if not best:
            break
        chosen += [r.asDict(recursive=True) | {"place": place} for r in best]
    return df.sparkSession.createDataFrame([tuple(r[c] for c in (*strata, "_id", "_1", "_2", "_v", "place")) for r in chosen], schema).select(*strata, "place", F.col("_id").alias(id_col))


def page_size(asked: Column) -> Column:
    """Rows of a page: 12 to 36, 30 if none are asked for."""
    return F.least(F.lit(36), F.greatest(F.lit(12), F.coalesce(asked, F.lit(30))))


def per_query(size: Column, queries: Column, providers: Column) -> Column:
    """Results that each query asks each provider for: the page shared out and two more, 8 to 18."""
    return F.least(F.lit(18), F.greatest(F.lit(8), (F.ceil(size / queries / providers) + 2).cast("int")))
