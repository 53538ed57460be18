"""Queries without SQL against plain Python on the smallest tables."""

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from huestrata.operators import clustering as cl
from huestrata.operators import hierarchy as hi
from huestrata.operators import masks as mk
from huestrata.operators import ranking as rk
from huestrata.plans import hierarchy as ph
from huestrata.plans import registry
from huestrata.plans.search import photos, scored
from huestrata.plans.selection import pairs
from huestrata.sources.tables import modes, swatches, table
from huestrata.streaming import jobs

registry.load_all()
SF = "/root/testdata/sf0.001"
run = lambda spark, name: registry.QUERIES[name](spark, SF).collect()


def score(seed, key):
    return int(hashlib.sha256(f"{seed}|{key}".encode()).hexdigest()[:12], 16) / (2**48 - 1)


# --- merging and what it changes --------------------------------------------------------------


def merged(points, limit):
    """Centroid linkage from scratch: the cluster (smallest id) of every id."""
    live = {r["id"]: (r["mass"], np.array([r["L"], r["a"], r["bb"]]), [r["id"]]) for r in points}
    while len(live) > 1:
        d, a, b = min((round(float(np.sqrt(((live[a][1] - live[b][1]) ** 2).sum())), 12), a, b) for a, b in itertools.combinations(sorted(live), 2))
        if d > limit + 1e-12:
            break
        (m, x, p), (n, y, q) = live[a], live.pop(b)
        live[a] = (m + n, (x * m + y * n) / (m + n), p + q)
    return {i: min(ids) for _, _, ids in live.values() for i in ids}


def mid(values, x):
    v = sorted(values)
    return 1.0 if len(v) == 1 else (sum(y < x for y in v) + (sum(y == x for y in v) - 1) / 2) / (len(v) - 1)


def plain_run(points, clusters, families=4):
    """Class of every cluster of one style, written out."""
    q = lambda x: math.floor(x * 1e12 + 0.5)
    rel = {(r["image"], r["family"]): r["reliability"] for r in points}
    whole, by_family = sum(rel.values()), defaultdict(float)
    for (_, f), w in rel.items():
        by_family[f] += w
    rows = {}
    for c in set(clusters.values()):
        mine = [r for r in points if clusters[r["id"]] == c]
        fam = {}
        for f in {r["family"] for r in mine}:
            images = {r["image"] for r in mine if r["family"] == f}
            fam[f] = (sum(r["mass"] for r in mine if r["family"] == f), len(images), sum(rel[i, f] for i in images))
        mass = sum(m for m, _, _ in fam.values())
        mean = {x: sum(r[x] * r["mass"] for r in mine) / mass for x in ("L", "a", "bb")}
        entropy = -sum(m / mass * math.log(m / mass) for m, _, _ in fam.values()) / math.log(families)
        rows[c] = {"fam": fam, "mass": mass, "L": mean["L"], "C": math.hypot(mean["a"], mean["bb"]), "cover": len(fam) / families, "ratio": sum(w for _, _, w in fam.values()) / whole, "entropy": entropy}
    out = {}
    for c, r in rows.items():
        m, chroma, light = (mid([q(x[k]) for x in rows.values()], q(r[k])) for k in ("mass", "C", "L"))
        own = any(n >= 2 and w / by_family[f] >= 0.25 and mid([q(x["fam"][f][0]) for x in rows.values() if f in x["fam"]], q(k)) >= 0.70 for f, (k, n, w) in r["fam"].items())
        tier = "core" if r["cover"] >= 0.75 and r["ratio"] >= 0.20 and m >= 0.70 else "secondary" if (r["cover"] >= 0.5 and r["ratio"] >= 0.10) or own else "rare"
        scope = "global" if r["cover"] >= 0.75 and r["entropy"] >= 0.65 else "cross_family" if r["cover"] >= 0.5 else "family_specific"
        roles = [n for n, ok in (("accent", chroma >= 0.75 and m <= 0.60), ("neutral", chroma <= 0.25), ("dark", light <= 0.25), ("light", light >= 0.75)) if ok]
        out[c] = (tier, scope, roles, r["cover"])
    return out


def test_sweep_and_stability(spark):
    styles = defaultdict(list)
    for r in ph.style_swatches(spark, SF).collect():
        styles[r["style"]].append(r)
    want, grades = {}, {}
    for style, points in styles.items():
        of = {t: merged(points, t) for t in hi.THRESHOLDS}
        classes = {t: plain_run(points, of[t]) for t in hi.THRESHOLDS}
        base = hi.THRESHOLDS[0]
        for mode in set(of[base].values()):
            members = [i for i, c in of[base].items() if c == mode]
            flips = []
            for t in hi.THRESHOLDS[1:]:
                down = {of[t][i] for i in members}
                assert len(down) == 1  # one descendant for every baseline mode
                d = down.pop()
                sources = len({of[base][i] for i, c in of[t].items() if c == d})
                a, b = classes[base][mode], classes[t][d]
                flip = a[:2] != b[:2]
                flips.append(flip)
                want[style, mode, t] = (d, sources, flip, a[2] != b[2], sources > 1 and (flip or a[2] != b[2] or a[3] != b[3]), sources > 1 and hi.TIERS.index(b[0]) > hi.TIERS.index(a[0]))
            grades[style, mode] = "C" if flips[0] else "B" if flips[1] else "A"
    got = {(r["style"], r["mode"], r["threshold"]): (r["descendant"], r["sources"], r["class_flip"], r["role_flip"], r["merge_sensitive"], r["merge_promotion"]) for r in run(spark, "cl07_threshold_sweep")}
    assert got == want and any(w[1] > 1 for w in want.values()) and any(w[2] for w in want.values())
    assert {(r["style"], r["mode"]): r["grade"] for r in run(spark, "cl08_stability")} == grades


def test_parted_modes_stop_the_lineage(spark):
    rows = [(1, 0.045, 1, 1), (1, 0.045, 2, 1), (1, 0.055, 1, 1), (1, 0.055, 2, 2)]
    assigned = spark.createDataFrame(rows, "style long, threshold double, id long, cluster long")
    classes = assigned.select("style", "threshold", "cluster", F.lit("rare").alias("tier"), F.lit("x").alias("scope"), F.array(F.lit("x")).alias("roles"), F.lit(1.0).alias("coverage")).distinct()
    with pytest.raises(Exception, match="two descendants"):
        hi.lineage(assigned, classes, ["style"]).collect()


def test_merge_trace_and_greedy_merge(spark):
    styles = defaultdict(list)
    for r in ph.style_swatches(spark, SF).collect():
        styles[r["style"]].append(r)
    got = defaultdict(list)
    for r in run(spark, "cl04_merge_trace"):
        got[r["style"]].append((r["step"], r["a"], r["b"], r["distance"]))
    for style, points in styles.items():
        live = {r["id"]: (r["mass"], np.array([r["L"], r["a"], r["bb"]])) for r in points}
        for step, a, b, d in sorted(got[style]):
            best = min((round(float(np.sqrt(((live[x][1] - live[y][1]) ** 2).sum())), 12), x, y) for x, y in itertools.combinations(sorted(live), 2))
            assert (best[1], best[2]) == (a, b) and abs(best[0] - d) < 1e-5, (style, step)
            (m, x), (n, y) = live[a], live.pop(b)
            live[a] = (m + n, (x * m + y * n) / (m + n))
        assert len(live) == 1
    got = defaultdict(list)
    for r in run(spark, "cl05_greedy_merge"):
        got[r["style"]].append((r["place"], r["mass"]))
    for style, points in styles.items():
        kept = []
        for r in sorted(sorted(points, key=lambda r: r["id"]), key=lambda r: -r["mass"]):
            x = np.array([r["L"], r["a"], r["bb"]])
            near = next((k for k in kept if np.linalg.norm(k[1] - x) < 0.045), None)
            if near is None:
                kept.append([r["mass"], x])
            else:
                near[1] = (near[1] * near[0] + x * r["mass"]) / (near[0] + r["mass"])
                near[0] += r["mass"]
        assert [m for _, m in sorted(got[style])] == [round(k[0], 6) for k in kept]


def test_palettes_and_their_matching(spark):
    p = {}
    for r in run(spark, "cl01_palette"):
        p.setdefault(r["image_id"], []).append(r)
    for rows in p.values():
        assert len(rows) <= 6 and abs(sum(r["ratio"] for r in rows) - 1) < 1e-5
        assert [r["place"] for r in sorted(rows, key=lambda r: -r["ratio"])] == list(range(1, len(rows) + 1))
        assert all(math.dist([a["L"], a["a"], a["bb"]], [b["L"], b["a"], b["bb"]]) >= 0.03 for a, b in itertools.combinations(rows, 2))
    a, b = (df.collect() for df in (cl.palettes(swatches(spark, SF), "image_id"), cl.palettes(modes(spark, SF).withColumn("w", F.col("mass")), "image_id")))
    for r in run(spark, "cl14_palette_match"):
        x, y = ([np.array([q["L"], q["a"], q["bb"]]) for q in sorted(side, key=lambda q: q["place"]) if q["image_id"] == r["image_id"]] for side in (a, b))
        x, y = (x, y) if len(x) <= len(y) else (y, x)
        best = min(sum(np.linalg.norm(u - v) for u, v in zip(x, some, strict=True)) for some in itertools.permutations(y, len(x)))
        assert abs(best / len(x) - r["cost"]) < 1e-5


# --- selections -------------------------------------------------------------------------------


def test_balanced_slice(spark):
    pools = defaultdict(list)
    for r in photos(spark, SF).collect():
        pools[r["id"] // 100].append((r["id"], (r["id"] % 3, r["provider"])))
    want = {}
    for pool, rows in pools.items():
        buckets = {}
        for i, b in sorted(rows):
            buckets.setdefault(b, []).append(i)
        keys, cursor, out = list(buckets), 0, []
        while len(out) < 60 and keys:
            k = keys[cursor % len(keys)]
            out.append(buckets[k].pop(0))
            if buckets[k]:
                cursor += 1
            else:
                keys, cursor = [x for x in keys if buckets[x]], 0
        want |= {(pool, i + 1): x for i, x in enumerate(out)}
    assert {(r["pool"], r["place"]): r["id"] for r in run(spark, "tk03_round_robin")} == want
    small = spark.createDataFrame([(1, b, i) for i, b in enumerate("aabbbbbbcc")], "g long, b string, id long")
    got = [r["id"] for r in sorted(rk.balanced_slice(small, ["g"], ["b"], "id", 9).collect(), key=lambda r: r["place"])]
    assert got == [0, 2, 8, 1, 3, 9, 4, 5, 6]  # after a ran out the turns begin again with b


def test_boundary_take(spark):
    p = pairs(spark, SF).select("pair_key", "id_1", "id_2", "delta_L", "delta_C", "delta_H", "min_C").collect()
    apart = lambda r: r["delta_L"] + 4 * math.sqrt(r["delta_L"] * r["delta_C"])
    close = lambda r: r["delta_L"] <= 0.06 and r["delta_C"] <= 0.033
    kinds = [
        ("hue_applicability", lambda r: abs(r["min_C"] - 0.03), lambda r: True, lambda r: r["min_C"] >= 0.03),
        ("hue_relation", lambda r: abs(r["delta_H"] - 40), lambda r: r["min_C"] >= 0.03, lambda r: r["delta_H"] > 40),
        ("tone", lambda r: abs(apart(r) - 0.54), lambda r: not close(r), lambda r: apart(r) >= 0.54),
    ]
    used, want = Counter(), []
    for name, margin, known, side in kinds:
        for test in (lambda r, side=side: not side(r), side, lambda r: True):
            open_rows = [r for r in p if known(r) and test(r) and r["pair_key"] not in [w[1] for w in want] and used[r["id_1"]] < 2 and used[r["id_2"]] < 2]
            if open_rows:
                best = min(open_rows, key=lambda r: (margin(r), r["pair_key"]))
                want.append((name, best["pair_key"]))
                used.update((best["id_1"], best["id_2"]))
    assert [(r["category"], r["pair_key"]) for r in sorted(run(spark, "tk07_capped_strata"), key=lambda r: r["no"])] == want


def test_stratified_diverse(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i % 2), f"p{i}", int(rng.integers(12)), int(12 + rng.integers(12)), *map(float, rng.random(2))) for i in range(80)]
    df = spark.createDataFrame(rows, "s int, pair_key string, id_1 int, id_2 int, x double, y double")
    want = set()
    for s in (0, 1):
        mine = [r for r in rows if r[0] == s]
        v = np.array([r[4:] for r in mine])
        v = (v - v.min(0)) / (v.max(0) - v.min(0))
        near = sorted(range(len(mine)), key=lambda i: (np.linalg.norm(v[i] - v.mean(0)), mine[i][1]))[:5]
        turn = int(hashlib.sha256(f"seed|{s}".encode()).hexdigest()[:12], 16) / 2**48
        chosen = [near[int(turn * len(near))]]
        while len(chosen) < 6:
            used = Counter(x for i in chosen for x in mine[i][2:4])
            left = [i for i in range(len(mine)) if i not in chosen]
            chosen.append(max(left, key=lambda i: min(np.linalg.norm(v[i] - v[j]) for j in chosen) - 0.12 * (used[mine[i][2]] + used[mine[i][3]]) + score("seed", mine[i][1]) * 1e-6))
        want |= {(s, k + 1, mine[i][1]) for k, i in enumerate(chosen)}
    assert {tuple(r) for r in rk.stratified_diverse(df, ["s"], ["x", "y"], 6, "seed").collect()} == want


def test_fresh_split(spark):
    """The picks themselves, of pools of two styles, pick by pick in plain Python."""
    rnd, axes = random.Random(5), ["x", "y", "z"]
    pool = [(s, a, b, f"{s}{a:02d}||{s}{b:02d}", *(round(rnd.random(), 3) for _ in axes)) for s in (0, 1) for a in range(12) for b in range(a + 1, 12)]
    used = {p[3] for p in pool if rnd.random() < 0.1}
    df = spark.createDataFrame(pool, "style long, id_1 long, id_2 long, pair_key string, x double, y double, z double")
    got = rk.fresh_split(df, spark.createDataFrame([(u,) for u in used], "pair_key string"), ["style"], axes).collect()
    for style in (0, 1):
        left = [p for p in pool if p[0] == style and p[3] not in used]
        for part, size, most in (("train", 24, 3), ("validation", 12, 2)):
            low, high = ([f(p[4 + i] for p in left) for i in range(3)] for f in (min, max))
            at = {p[3]: [(p[4 + i] - low[i]) / ((high[i] - low[i]) or 1) for i in range(3)] for p in left}
            h = {k: int(hashlib.sha256(f"{part}|{k}".encode()).hexdigest()[:12], 16) / (2**48 - 1) for k in at}
            chosen, ends = [], Counter()
            while len(chosen) < size:
                free = [p for p in sorted(left, key=lambda p: h[p[3]]) if p[3] not in chosen and ends[p[1]] < most and ends[p[2]] < most]
                if not free:
                    break
                best = max(free, key=lambda p: min((sum((u - v) ** 2 for u, v in zip(at[p[3]], at[c], strict=True)) ** 0.5 for c in chosen), default=1.0) + h[p[3]] * 1e-9)
                chosen.append(best[3])
                ends.update(best[1:3])
            mine = sorted((r["place"], r["pair_key"]) for r in got if r["style"] == style and r["part"] == part)
            assert [k for _, k in mine] == chosen and len(chosen) > 5
            digest = hashlib.sha256("\n".join(sorted(chosen)).encode()).hexdigest()
            assert {r["digest"] for r in got if r["style"] == style and r["part"] == part} == {digest}
            left = [p for p in left if p[3] not in chosen]
    keys = [r["pair_key"] for r in run(spark, "gv06_fresh_split")]
    assert keys and len(keys) == len(set(keys)) and not any(k.split("||") == sorted([str(n), str(n + 1)]) for k in keys for n in range(25))


def test_greedy_result_lists(spark):
    rows = defaultdict(list)
    for r in scored(spark, SF).collect():
        rows[r["search"]].append(r)
    want, kept = set(), set()
    for search, mine in rows.items():
        out = []
        for by_provider, by_author in ((1, 1), (0, 1), (0, 0)):
            for r in sorted(mine, key=lambda r: (-r["score"], r["id"])):
                if len(out) < 12 and r["id"] not in [o["id"] for o in out] and not (by_provider and sum(o["provider"] == r["provider"] for o in out) >= 8) and not (by_author and sum(o["author"] == r["author"] for o in out) >= 2):
                    out.append(r)
        want |= {(search, i + 1, r["id"]) for i, r in enumerate(out)}
        held = []
        for r in sorted(mine, key=lambda r: r["id"]):
            h = int(hashlib.md5(r["alt"].encode()).hexdigest()[:16], 16)
            if sum(a == r["author"] for _, a in held) < 2 and all((h ^ g).bit_count() > 5 for g, _ in held):
                held.append((h, r["author"]))
                kept.add((search, r["id"]))
    assert {(r["search"], r["place"], r["id"]) for r in run(spark, "tk02_diverse_top")} == want
    assert {(r["search"], r["id"]) for r in run(spark, "tk04_near_duplicate_greedy")} == kept


# --- single figures ---------------------------------------------------------------------------


def test_words_hashes_and_owners(spark):
    parts = {r["p_partkey"]: r for r in table(spark, SF, "part").collect()}
    for r in run(spark, "prj05_merge_words"):
        p, seen = parts[r["id"]], []
        for w in f"{p['p_name']} {p['p_type']} {p['p_brand']}".split():
            if w.lower() not in [s.lower() for s in seen]:
                seen.append(w)
        assert r["words"] == " ".join(seen[:10])
    for r in run(spark, "fn19_gradient_hash"):
        price = {((k - 1) % 72 % 9, (k - 1) % 72 // 9): p["p_retailprice"] for k, p in parts.items() if (k - 1) // 72 == r["image"]}
        bits = sum(1 << (63 - (y * 8 + x)) for y in range(8) for x in range(8) if price[x, y] > price[x + 1, y])
        assert r["hash"] == f"{bits:016x}"
    owner = {}
    for e in sorted(table(spark, SF, "events").collect(), key=lambda e: e["event_id"]):
        name, best = owner.get(e["event_id"] // 50, ("", -1.0))
        value = e["value"] / 100
        if value > best + 0.03 or (e["event_id"] % 2 == 0 and e["event_type"] == name):
            owner[e["event_id"] // 50] = (e["event_type"], value)
    assert {r["photo"]: (r["owner"], r["score"]) for r in run(spark, "jn22_ownership")} == {k: (n, round(s, 6)) for k, (n, s) in owner.items()}


def plain_fit(x, y, cuts):
    best = None
    for a, b in itertools.product(cuts, cuts):
        if a < b:
            said = ["similar" if v <= a else "different" if v >= b else "similar_or_partial" for v in x]
            recall = np.mean([np.mean([s == t for s, t in zip(said, y, strict=True) if t == c]) for c in set(y)])
            key = (round(float(recall), 12), sum(s == t for s, t in zip(said, y, strict=True)), round(b - a, 12), -a)
            if best is None or key > best[0]:
                best = (key, a, b)
    return best


def test_threshold_fits(spark):
    from huestrata.plans.clusters import cases
    from huestrata.plans.jobs import labelled

    rows = cases(spark, SF).collect()
    v = sorted({r["v"] for r in rows})
    key, a, b = plain_fit([r["v"] for r in rows], [r["label"] for r in rows], [(p + q) / 2 for p, q in zip(v, v[1:], strict=False)])
    got = run(spark, "cl12_threshold_fit")[0]
    assert (round(got["lo"], 9), round(got["hi"], 9), got["hits"]) == (round(a, 9), round(b, 9), key[1])
    sets = defaultdict(list)
    for r in labelled(spark, SF).where("grp < 4").collect():
        sets[r["grp"]].append(r)
    got = {(r["grp"], r["case_id"]): (r["said"], r["right"]) for r in run(spark, "cl13_leave_one_out")}
    for grp, mine in sets.items():
        for out in mine if len(mine) > 3 else []:
            rest = [r for r in mine if r["case_id"] != out["case_id"]]
            v = sorted({r["dl"] for r in rest})
            _, a, b = plain_fit([r["dl"] for r in rest], [r["label"] for r in rest], [0.0, *((p + q) / 2 for p, q in zip(v, v[1:], strict=False)), v[-1] + 1e-8])
            said = "similar" if out["dl"] <= a else "different" if out["dl"] >= b else "similar_or_partial"
            assert got[grp, out["case_id"]] == (said, said == out["label"])


def test_two_means_by_hand():
    x = np.array([[0.0, 0, 0], [0.1, 0, 0], [0.9, 0, 0], [1.0, 0, 0], [0.45, 0, 0]])
    c, label = mk.two_means(x)
    assert label.tolist() == [0, 0, 1, 1, 0] and np.allclose(sorted(c[:, 0]), [0.55 / 3, 0.95])
    assert mk.two_means(x[:1])[1].tolist() == [0]


# --- queues and soak runs ---------------------------------------------------------------------


def plain_queue(tasks, limit, workers, timeout):
    """Every task's status, by going through time: (at, work) in order of arrival."""
    free, running, waiting, out = [0.0] * workers, [], [], []
    for at, work in tasks:
        while waiting and min(free) <= at:  # a waiting task starts when a worker is free
            k = free.index(min(free))
            begin = max(free[k], waiting[0][0])
            free[k] = begin + min(waiting.pop(0)[1], timeout)
            running.append(free[k])
        running = [e for e in running if e > at]
        if len(running) + len(waiting) >= limit:
            out.append("DROPPED_QUEUE_FULL")
            continue
        out.append("TIMEOUT" if work > timeout else "OK")
        if min(free) <= at and not waiting:
            k = free.index(min(free))
            free[k] = at + min(work, timeout)
            running.append(free[k])
        else:
            waiting.append((at, work))
    return out


def test_sampled_queue_in_batch_and_as_a_stream(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(int(i % 2), i, float(t), float(w), bool(i % 5)) for i, (t, w) in enumerate(zip(np.cumsum(rng.random(300)), rng.random(300) * 4, strict=True))]
    schema = "middleware int, event_id long, at double, work double, sampled boolean"
    df = spark.createDataFrame(rows, schema)
    got = {r["event_id"]: r["status"] for r in jobs.sampled_queue(df, 3, 2, 3.0).collect()}
    for m in (0, 1):
        mine = [r for r in rows if r[0] == m and r[4]]
        assert [got[r[1]] for r in mine] == plain_queue([(r[2], r[3]) for r in mine], 3, 2, 3.0)
    assert {"OK", "TIMEOUT", "DROPPED_QUEUE_FULL", "NOT_SAMPLED"} == set(got.values())
    for k in range(3):
        df.where(F.col("event_id").between(100 * k, 100 * k + 99)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.sampled_queue_stream(jobs.event_stream(spark, str(tmp_path / "in"), df.schema, 1), 3, 2, 3.0)
    q = stream.writeStream.format("memory").queryName("queue_rows").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["event_id"]: r["status"] for r in spark.table("queue_rows").collect()} == got


def test_soak_run_ends_as_planned(spark):
    plan = jobs.soak_plan(spark.range(2).select(F.col("id").alias("run")))
    assert plan.count() == 1000
    ends = Counter(r["status"] for r in jobs.lifecycle_batch(jobs.soak_events(plan.where("run = 0"))).collect())
    assert (ends["COMPLETED"], ends["ABORTED"], ends["STALE"], ends["SUPERSEDED"] + ends["REJECTED"]) == (375, 75, 50, 0)


def test_checked_join_stops(spark):
    from huestrata.operators.relations import checked_join

    left, right = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "x")], "k long, v string")
    with pytest.raises(Exception, match="no partner for k 2"):
        checked_join(left, right, "k").collect()


# --- search plans -----------------------------------------------------------------------------


def concept(category, term, priority="secondary", intensity=1.0, styles=(), themes=()):
    return {"category": category, "search_term": term, "priority": priority, "intensity": intensity, "style_terms": list(styles), "theme_elements": list(themes)}


def test_query_plans_by_hand(spark):
    from huestrata.operators.planning import query_plans

    some = [
        concept("subject", "Coffee shop", "main", 1.0, ["retro", "Cozy"], ["object|neon sign", "object|mug"]), concept("context", "summer night", themes=["scene|street"]),
        concept("color", "warm", "slight", 1.0, ["film grain"]), concept("exclusion", "people", "exclude"),
    ]
    inputs = [some, [concept("color", "warm")], [concept("subject", "tea", themes=["x|pot"])], [concept("exclusion", "x", "exclude")], [concept("subject", "")]]
    table_of = spark.createDataFrame([(i, k, *c.values()) for i, x in enumerate(inputs) for k, c in enumerate(x)], "input long, id long, category string, search_term string, priority string, intensity double, style_terms array<string>, theme_elements array<string>")
    own = spark.createDataFrame([(0, "B", ["  neo   noir ", "", "NEO NOIR", "dusk", "dawn", "one too many"]), (0, "C", [])], "input long, branch string, terms array<string>")
    plans = {}
    for k, terms in enumerate((None, own)):
        for r in query_plans(table_of, "input", "id", terms).orderBy("no").collect():
            plans.setdefault((k, r["input"], r["branch"]), []).append(r)
    queries = lambda *at: [r["query"] for r in plans.get(at, [])]
    a = plans[0, 0, "A"]
    assert queries(0, 0, "A") == ["Coffee shop summer night", "Coffee shop retro neon sign soft light", "summer night street Cozy soft contrast"]
    assert [p["query_family"] for p in a] == ["core", "element:object", "element:scene"] and [p["no"] for p in a] == [1, 2, 3]
    raw = [(1.35 + 1.0) / 2, (1.35 + 1.35 + 1.35 * 1.1 + 0.85) / 4, (1.0 + 1.1 + 1.35 + 0.80) / 4]
    assert [p["weight"] for p in a] == [round(r / sum(raw), 4) for r in raw]
    assert queries(0, 0, "B") == ["Coffee shop summer night", "Coffee shop Cozy mug", "summer night street film grain"]  # starts at the second theme and style, has no hints
    assert queries(0, 1, "B") == ["warm"]  # only a colour: the fallback
    assert queries(0, 2, "B") == ["tea", "tea pot"]
    assert not queries(0, 3, "C") and not queries(0, 4, "A")
    # a branch's own terms take the places of styles, in turn with them
    assert queries(1, 0, "B") == ["Coffee shop summer night", "Coffee shop neo noir mug", "summer night street dawn"]
    raw = [(1.35 + 1.0) / 2, (1.35 + 1.2 + 1.35 * 1.1) / 3, (1.0 + 1.1 + 1.2) / 3]
    assert [p["weight"] for p in plans[1, 0, "B"]] == [round(r / sum(raw), 4) for r in raw]
    assert all(plans[1, i, b] == plans[0, i, b] for _, i, b in plans if (i, b) != (0, "B"))
    rows = run(spark, "pl02_query_plan")
    assert all(1 <= r["no"] <= 3 for r in rows) and len(rows) > 50
    of = defaultdict(list)
    for r in rows:
        of[r["input"], r["branch"]].append(r)
    for mine in of.values():
        assert abs(sum(r["weight"] for r in mine) - 1) < 2e-4 and len({r["query"].lower() for r in mine}) == len(mine)
