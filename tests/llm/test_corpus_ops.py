"""Dedup, near-dedup, repeats, decontamination, classifiers and the pipeline: against brute force on small fixtures."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from huestrata.llm import decontaminate, minhash, quality, suffix_dedup, toxicity
from huestrata.llm.components import stars
from huestrata.llm.exact_dedup import exact_dedup, keep_first_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _t string, cid string, rep string, key string, value string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "x", "x", "x", "x") for i, t in rows], SCHEMA)


def words_of(rnd, n):
    return [rnd.choice("abcdefghijklmnop") + str(rnd.randrange(60)) for _ in range(n)]


# --- exact dedup --------------------------------------------------------------------------


def test_exact_dedup(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "A"), (6, "a "), (7, "x" * 100000), (8, "x" * 100000), (None, "a"), (None, "only"), (9, "r"), (9, "r")]
    for weak in (None, F.unhex(F.lit("00")), F.substring(F.col("text"), 1, 1).cast("binary")):  # all collide, or some do
        got = exact_dedup(documents(spark, rows), hash128=F.coalesce(weak, F.lit(b"")) if weak is not None else None).collect()
        assert len(got) == len(rows)
        for r in got:
            same = [i for i, t in rows if hashlib.sha256((t or "").encode()).hexdigest() == r["text_sha256"]]
            ids = [i for i in same if i is not None]
            assert (r["group_size"], r["keep_id"], r["kept"]) == (len(same), max(ids, default=None), r["doc_id"] == max(ids, default=None))
    kept = keep_first_copies(documents(spark, rows))
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 2, 4, 5, 6, 8, 9, 9] and kept.columns == documents(spark, []).columns
    assert exact_dedup(documents(spark, [])).count() == 0


# --- near dedup ---------------------------------------------------------------------------


def sets_of(text):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(rows):
    sets = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return [(rows[i][0], len(sets[i]), min(groups[find(i)])) for i in range(len(rows))]


def near_rows(seed=4):
    rnd, rows = random.Random(seed), []
    boiler = words_of(rnd, 60)
    for g in range(14):  # groups of copies edited here and there, a third of all rows in one
        base = words_of(rnd, rnd.choice([4, 5, 9, 40, 120, 300])) if g else words_of(rnd, 90)
        for _ in range(60 if g == 0 else rnd.randrange(1, 9)):
            w = list(base)
            for _ in range(rnd.randrange(0, 7)):
                w[rnd.randrange(len(w))] = rnd.choice("xyz") + str(rnd.randrange(999))
            rows.append(" ".join(w))
    rows += [" ".join(boiler + words_of(rnd, 40)) for _ in range(25)]
    rows += [None, "", " \n ", "one", "ONE", "one two", "a a a a a a a", "a a a a a", "a a a a a a a a a", " x  y", *rows[:6]]
    order = list(range(len(rows)))
    rnd.shuffle(order)
    return [(order[i], t) for i, t in enumerate(rows)]


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    got = {r["doc_id"]: r for r in minhash.near_duplicates(documents(spark, rows)).collect()}
    for doc, n, comp in brute_components(rows):
        assert (got[doc]["n_shingles"], got[doc]["component_id"], got[doc]["kept"]) == (n, comp, comp == doc)


def test_near_duplicates_with_small_sketches(spark):
    rows = near_rows(9)
    params = minhash.Params(k=32, deep=40, rounds=1)  # long sets are estimated, all cross pairs are finished
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(documents(spark, rows), params).collect()}
    assert all(got[doc] == comp for doc, _, comp in brute_components(rows))


def test_near_duplicates_edges(spark):
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (5, "x"), (5, "x"), (5, "other words here and there now"), (None, "alone it is with no id")]
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in minhash.near_duplicates(documents(spark, rows)).collect())
    assert got == [(0, 0, True), (0, 3, False), (3, 3, True), (5, 5, True), (5, 5, True), (5, 5, True)]
    kept = minhash.keep_one_of_each(documents(spark, [(2, "a b c d e f"), (1, "a b c d e f"), (4, None)]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4] and kept.columns == documents(spark, []).columns


def test_rows_without_an_id_are_looked_at_once(spark):
    """Many rows without an id, and many that repeat one: as many full sets as there are different texts."""
    rnd = random.Random(12)
    base = words_of(rnd, 80)
    texts = [" ".join([*base[:k], f"edit{k}", *base[k:]]) for k in range(60)]
    rows = [(None, t) for t in texts] + [(7, t) for t in texts[:20]] + [(None, texts[0])] * 200 + [(8, " ".join(words_of(rnd, 40)))] * 50
    docs = documents(spark, rows).repartition(5)
    marked = minhash.sketches(docs, minhash.Params(), "doc_id", "text")
    wanted = marked.groupBy("key").agg(F.min(F.struct("doc_id", "h")).alias("rep")).withColumn("cid", F.monotonically_increasing_id())
    sets = minhash._full_sets(docs, wanted, minhash.Params(), "doc_id", "text")
    assert sets.select("cid").distinct().count() == 61 and sets.count() <= 61 + 5 * 2  # a repeated row once a task at most
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == {(None, 7, False), (7, 7, True), (8, 8, True)}


def test_stars_of_a_chain(spark):
    edges = spark.range(1, 200).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    got = stars(edges.unionByName(spark.createDataFrame([(1000, 900), (900, 950)], "u long, v long")))
    assert sorted(map(tuple, got.collect())) == [(i, 0) for i in range(1, 200)] + [(950, 900), (1000, 900)]


# --- repeats ------------------------------------------------------------------------------


def brute_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for r in raws:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raws:
        covered = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                covered[i : i + length] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], covered.astype(int), [0]))) == 1))
        out.append((len(r), int(covered.sum()), spans, hashlib.sha256(np.frombuffer(r, np.uint8)[~covered].tobytes()).hexdigest()))
    return out


def repeat_texts(seed, passage_len):
    rnd = random.Random(seed)
    rand = lambda n: "".join(rnd.choice("ab cdeé") for _ in range(n))
    passage = rand(passage_len)
    texts = [rand(rnd.randrange(0, 60)) + passage[rnd.randrange(0, 9) :] + rand(rnd.randrange(0, 60)) for _ in range(40)]
    texts += [rand(150) for _ in range(10)] + ["a" * 90, "ab" * 70, "abc" * 12, None, "", "x" * 39, "x" * 40, "y" * 41, rand(10) + "y" * 41]
    return [*texts, texts[3], texts[3], texts[45], passage * 2]


def test_repeats_equal_brute_force(spark):
    for block in (16384, 8):  # one block a bucket, and buckets dealt into blocks over several rounds
        texts = repeat_texts(block, 70)
        params = suffix_dedup.Params(length=40, gram=8, block=block)
        got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(documents(spark, enumerate(texts)), params).collect()}
        for i, want in enumerate(brute_repeats(texts, 40)):
            r = got[i]
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want, (block, i)
            assert hashlib.sha256(bytes(r["kept"])).hexdigest() == want[3]


def test_repeats_at_400_bytes(spark):
    rnd = random.Random(8)
    passage = " ".join(words_of(rnd, 150))
    texts = [" ".join(words_of(rnd, 120)) + passage[:n] + " ".join(words_of(rnd, 50)) for n in (399, 400, 401, 500)] + ["tail " + passage[50:470]]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(documents(spark, enumerate(texts)), keep_bytes=False).collect()}
    assert [(got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) for i in range(5)] == brute_repeats(texts, 400)
    assert suffix_dedup.remove_repeats(documents(spark, [])).count() == 0


def brute_passages(texts, size):
    """Words in passages of `size` words that stand in another row too."""
    words = [[x.decode() for x in (t or "").encode().split()] for t in texts]
    where = {}
    for i, w in enumerate(words):
        for j in range(len(w) - size + 1):
            where.setdefault(tuple(w[j : j + size]), set()).add(i)
    out = []
    for w in words:
        covered = np.zeros(len(w), bool)
        for j in range(len(w) - size + 1):
            if len(where[tuple(w[j : j + size])]) > 1:
                covered[j : j + size] = True
        out.append(int(covered.sum()))
    return out


def test_passages_shorter_than_400_bytes_are_found(spark):
    rnd = random.Random(9)
    some = lambda n: " ".join(rnd.choice("abcdefgh") * rnd.randrange(1, 4) for _ in range(n))
    passage = some(60).split()
    assert len(" ".join(passage)) < 400
    texts = [some(30) + " " + " ".join(passage[:n]) + "\n" + some(20) for n in (50, 51, 55)] + [some(40) + "\t" + "  ".join(passage[4:]), some(200)]
    texts += [(line := some(52)) + "\n" + line, (copy := some(51)), copy, (short := some(50)), short, None, ""]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(documents(spark, enumerate(texts)), keep_bytes=False, passages=True).collect()}
    assert [got[i]["n_passage_words"] for i in range(len(texts))] == brute_passages(texts, 51) == [0, 51, 55, 51, 0, 0, 51, 51, 0, 0, 0, 0]
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for _, r in sorted(got.items())] == brute_repeats(texts, 400)


def test_passages_equal_brute_force(spark):
    for block in (16384, 4):  # one block a bucket, and buckets dealt into blocks over several rounds
        rnd = random.Random(block)
        some = lambda n: [rnd.choice("abcdé") * rnd.randrange(1, 3) for _ in range(n)]
        passage, other = some(16), some(14)
        texts = [some(rnd.randrange(9)) + passage[rnd.randrange(5) :] + some(rnd.randrange(9)) for _ in range(60)]
        texts += [passage + some(k) + passage + other * 2 for k in range(12)] + [["x"] * k for k in (9, 10, 11, 40)] + [["x", "y"] * 30, some(400)]
        texts = [" ".join(t) for t in texts] + [None, "", " "]
        texts += [texts[3], texts[61], " ".join((line := some(25)) * 30), " ".join(line)]
        params = suffix_dedup.Params(length=40, gram=8, block=block, words=10, seed=3)
        got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(documents(spark, enumerate(texts)), params, keep_bytes=False, passages=True).collect()}
        assert [got[i]["n_passage_words"] for i in range(len(texts))] == brute_passages(texts, 10), block
        assert [(got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) for i in range(len(texts))] == brute_repeats(texts, 40), block


# --- decontamination ----------------------------------------------------------------------


def plain_alignment(item, text):
    best, h = 0, [0] * (len(text) + 1)
    for a in item:
        row = [0]
        for j, b in enumerate(text):
            row.append(max(0, h[j] + (1 if a == b else -1), h[j + 1] - 1, row[-1] - 1))
        h, best = row, max(best, *row)
    return best


def test_alignment_equals_the_plain_recurrence():
    rng = np.random.default_rng(3)
    pairs = [(rng.integers(11, 19, rng.integers(1, 20)).astype(np.uint64), rng.integers(12, 20, rng.integers(1, 40)).astype(np.uint64)) for _ in range(200)]
    assert decontaminate.align(pairs)[0].tolist() == [plain_alignment(a.tolist(), b.tolist()) for a, b in pairs]


def test_edited_copies_are_found_and_clean_texts_left(spark):
    rnd = random.Random(6)
    items = [words_of(rnd, n) for n in (15, 25, 40, 59)]
    texts, leaks = [], set()
    for i in range(60):
        k, w = i % 4, words_of(rnd, rnd.randrange(0, 200))
        if i < 40:
            copy = list(items[k])
            for _ in range(len(copy) // 8):  # replaced, dropped and added words
                at = rnd.randrange(len(copy))
                copy[at : at + rnd.randrange(2)] = [rnd.choice(["new", "words"])] * rnd.randrange(2)
            w[len(w) // 2 : len(w) // 2] = copy
            leaks.add((i, k))
        texts.append(", ".join(w).upper() if i % 2 else " ".join(w))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(8, None), (9, "")], "item_id long, text string")
    docs = documents(spark, [*enumerate(texts), (98, None), (99, "")])
    for params in (decontaminate.Params(), decontaminate.Params(block_bytes=200)):  # one block of items, and several
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench, params).collect()}
        assert got == leaks
    left = decontaminate.drop_contaminated(docs, bench)
    assert sorted(r["doc_id"] for r in left.collect()) == [*range(40, 60), 98, 99] and left.columns == docs.columns
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_every_alignment_that_scores_enough_is_found(spark):
    rnd = random.Random(8)
    items = [words_of(rnd, n) for n in (16, 25, 38, 12)]
    texts = [" ".join(x) for x in items]  # intact copies make the broken n-grams the rarest
    texts.append(" ".join("edit" if j % 6 == 5 else w for j, w in enumerate(items[2])))
    texts.append(" ".join(w + " more" * (j % 2) for j, w in enumerate(items[0])))  # no three words in a row are left
    for i in range(120):
        copy = [w for w in items[i % 4] for w in ([w, f"new{i}"] if rnd.random() < 0.1 else [w])]
        copy = [f"new{i}" if rnd.random() < (0.1, 0.2, 0.3)[i % 3] else w for w in copy if rnd.random() > 0.05]
        texts.append(" ".join(words_of(rnd, 30) + copy + words_of(rnd, 30)))
    want = {(i, k) for i, t in enumerate(texts) for k, x in enumerate(items) if plain_alignment(x, t.split()) / len(x) >= 0.4}
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    docs = documents(spark, enumerate(texts))
    assert {(4, 2), (5, 0)} <= want and len(want) < len(texts)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()} == want
    left = {r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert left == set(range(len(texts))) - {i for i, _ in want}


# --- classifiers --------------------------------------------------------------------------


def labelled(spark, n=900):
    rnd, rows, labels = random.Random(11), [], []
    for i in range(n):
        w = words_of(rnd, rnd.randrange(20, 120))
        toxic = rnd.random() < 0.2
        if toxic:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(["awful,", "Nasty", "vile.", "rotten"]))
        bad = rnd.random() < 0.3
        rows.append((i, ("### ".join(w) if bad else ". ".join(w)).strip()))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(n, None), (n + 1, ""), (None, "no id"), (n + 2, "vile " * 5000)]
    labels += [(None, 1, 1), (5, None, None)]
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((i, (q, t)) for i, q, t in labels if q is not None and i is not None)


def accuracy(rows, truth, k):
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert held and all(0 <= r["score"] <= 1 for r in rows)
    return np.mean([r["predicted"] == truth[r["doc_id"]][k] for r in held])


def test_toxicity_and_quality_on_held_out_rows(spark):
    docs, labels, truth = labelled(spark)
    model = toxicity.train_toxicity(docs, labels)
    rows = toxicity.score_toxicity(docs, model).collect()
    assert len(rows) == docs.count() and accuracy(rows, truth, 1) > 0.95
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows if r["doc_id"] is not None)
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns and abs(left.count() - sum(r["predicted"] == 0 for r in rows)) == 0
    gam = quality.train_quality(docs, labels, quality.GamParams(rounds=20, pair_rounds=5))
    assert accuracy(quality.score_quality(docs, gam).collect(), truth, 0) > 0.95
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    nothing = toxicity.train_toxicity(docs, labels.limit(0))
    assert {round(r["score"], 3) for r in toxicity.score_toxicity(docs, nothing).collect()} == {0.05}
    assert quality.score_quality(docs, quality.train_quality(docs, labels.limit(0))).first()["score"] == 0.5


def test_nnpu_corrects_for_hidden_positives():
    rng = np.random.default_rng(2)
    toxic = lambda: np.unique(np.concatenate([rng.integers(100, 400, 20), rng.choice([1, 2, 3], 2)])).astype(np.int32)
    clean = lambda: np.unique(rng.integers(100, 400, 20)).astype(np.int32)
    p = [toxic() for _ in range(300)]
    u = [toxic() if rng.random() < 0.2 else clean() for _ in range(1500)]
    model = toxicity.fit_nnpu(p, u, 0.2)
    assert np.mean([model.score(toxic()) > 0.5 for _ in range(200)]) > 0.95
    assert np.mean([model.score(clean()) > 0.5 for _ in range(200)]) < 0.05


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    alone = quality.fit_gam(x, y, quality.GamParams(pairs=0))
    both = quality.fit_gam(x, y, quality.GamParams(pairs=1))
    assert both.pairs == [(0, 1)]
    assert np.mean((both.score(x) > 0.5) == (y > 0)) > 0.95 > np.mean((alone.score(x) > 0.5) == (y > 0))


# --- pipeline -----------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs, labels, _ = labelled(spark, 300)
    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    item = " ".join(words_of(random.Random(77), 30))
    more = spark.createDataFrame([(5000, "copy of a text"), (5001, "copy of a text"), (5002, f"start {item} end"), (5003, item + " near"), (5004, item + " nearly")], "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "1L n_chars")
    base.unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "bpe"]
    now, ids = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "bpe":
            assert out.columns == now.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        ids[name] = {r[0] for r in now.select("doc_id").collect()}
    assert 5000 not in ids["exact_dedup"] and 5001 in ids["exact_dedup"]
    assert 5002 in ids["near_dedup"] and not {5003, 5004} & ids["near_dedup"]
    assert 5002 not in ids["decontamination"] and 5001 in ids["bpe"]
    assert {r[0] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == ids["bpe"]


def test_pipeline_equals_brute_force(spark, tmp_path):
    """run() against the same five decisions in plain Python, row by row."""
    import pytest

    tokenizers = pytest.importorskip("tokenizers")
    import corpus_pipeline
    from huestrata.llm.common import APART, word_hashes
    from huestrata.llm.queries import word_bpe_path

    docs, labels, _ = labelled(spark, 260)
    rnd = random.Random(31)
    items = [" ".join(words_of(rnd, n)) for n in (14, 30)]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for i, t in enumerate([*(t for _, t in rows[:30]), *(t for _, t in rows[:10])]):  # copies, and copies with a word changed
        w = (t or "").split(" ")
        w[len(w) // 2] = "changed" if i % 2 else w[len(w) // 2]
        rows.append((3000 + i, " ".join(w)))
    for i in range(12):
        w = items[i % 2].split(" ")
        w[rnd.randrange(len(w))] = "edit"
        rows.append((4000 + i, " ".join(words_of(rnd, 20) + w + words_of(rnd, 20))))
    base = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    base.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    model = toxicity.train_toxicity(spark.read.parquet(str(tmp_path / "documents.parquet")), labels)
    left = [(i, t) for i, t in rows if model.score(next(iter(toxicity.text_features([t])))) < 0.5]
    best = {}
    for i, t in left:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    left = [(i, t) for i, t in left if (-1 if i is None else i) == best[t or ""]]
    comp = {(i, t): c for (i, t), (_, _, c) in zip(left, brute_components([(-1 if i is None else i, t) for i, t in left]), strict=True)}
    left = [(i, t) for i, t in left if (-1 if i is None else i) == comp[i, t]]
    words = lambda t: next(iter(word_hashes([t], APART)), []).tolist() if t else []
    leaks = lambda t: any(plain_alignment(words(x), words(t)) >= 0.4 * len(words(x)) for x in items)
    left = [(i, t) for i, t in left if not leaks(t)]
    library = tokenizers.Tokenizer.from_file(word_bpe_path())
    want = sorted((-1 if i is None else i, library.encode(t or "", add_special_tokens=False).ids) for i, t in left)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], list(r["token_ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and len(got) < len(rows) - 40
