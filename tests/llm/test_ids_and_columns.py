"""Ids and columns: every operator hands ids over as they are, and no column name of the input gets in its way."""

import random

import numpy as np
import pytest

from huestrata.llm import chat, decontaminate, minhash, quality, secrets, suffix_dedup, toxicity
from huestrata.llm.exact_dedup import exact_dedup, keep_first_copies

BIG = 2**53 + 1
IDS = [BIG, None, BIG, -5, 7, None, BIG + 1, 9]
CLASHES = ["_id", "_t", "_h", "_ds", "_kid", "_ks", "_sha", "_kept_id", "_kept_sha", "_keep", "_key", "_n", "_d", "cid", "rep", "gram", "spans", "part", "root"]


def texts():
    same = " ".join(f"word{i}" for i in range(60))
    return [same, same, same, None, "", same + " more", "password=abcdefgh1", " ".join(f"other{i}" for i in range(70))]


def documents(spark, ids, kind="long"):
    schema = f"doc_id {kind}, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(i, t, "en", "s", 1, *CLASHES) for i, t in zip(ids, texts(), strict=True)], schema).coalesce(1)


def order(ids):
    return sorted(ids, key=lambda x: (x is None, str(x)))


def operators(docs, spark):
    labels = spark.createDataFrame([(BIG, 1, 1), (9, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    yield "op2", toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels))
    yield "op4", quality.score_quality(docs, quality.train_quality(docs, labels, quality.GamParams(rounds=2, pair_rounds=1)))
    yield "op5", exact_dedup(docs)
    yield "op6", suffix_dedup.remove_repeats(docs, keep_text=True)
    yield "op9", secrets.scan_secrets(docs)
    yield "op10", minhash.near_duplicates(docs)
    tokenizers = pytest.importorskip("public_tokenizers")
    from huestrata.llm.bpe import bpe_digest

    yield "op8", bpe_digest(docs, tokenizers.path("word_bpe_49k.json"))


def test_ids_beyond_2_to_53_beside_nulls(spark):
    docs = documents(spark, IDS)
    for name, out in operators(docs, spark):
        assert order(r["doc_id"] for r in out.collect()) == order(IDS), name
    bench = spark.createDataFrame([(BIG, texts()[0]), (None, texts()[7])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(BIG, BIG), (None, BIG), (9, None)}
    groups = {r["doc_id"]: r for r in exact_dedup(docs).collect() if r["doc_id"] is not None}
    assert groups[BIG]["keep_id"] == BIG and groups[BIG]["group_size"] == 3
    near = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect() if r["doc_id"] is not None}
    assert near[BIG] == BIG and near[9] == 9


def test_ids_of_text(spark):
    ids = ["b", None, "b", "a-1", "x", None, "c", "d"]
    docs = documents(spark, ids, "string")
    for out in (exact_dedup(docs), suffix_dedup.remove_repeats(docs), secrets.scan_secrets(docs), minhash.near_duplicates(docs)):
        assert order(r["doc_id"] for r in out.collect()) == order(ids)


def test_stages_keep_all_columns(spark):
    docs = documents(spark, IDS)
    bench = spark.createDataFrame([(1, texts()[7])], "item_id long, text string")
    model = toxicity.train_toxicity(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    for out, n in ((toxicity.drop_toxic(docs, model), 8), (keep_first_copies(docs), 6), (minhash.keep_one_of_each(docs), 6), (decontaminate.drop_contaminated(docs, bench), 7)):
        assert out.columns == docs.columns and {tuple(r)[5:] for r in out.collect()} == {tuple(CLASHES)}
        assert out.count() == n


def _length_as_id(texts):
    return np.array([len(t.as_py()) for t in texts], np.uint32), np.ones(len(texts), np.int64)


def test_token_store_and_chat_ids(spark, tmp_path):
    from huestrata.llm import token_store

    for kind, ids in (("long", IDS), ("string", ["b", None, "b", "a-1", "x", None, "c", "d"])):
        token_store.write_store(documents(spark, ids, kind), str(tmp_path / kind), _length_as_id)
        rows = sorted(token_store.read_digest(spark, str(tmp_path / kind)).collect(), key=lambda r: r["start"])
        known = [i for i in ids if i is not None]
        assert [r["doc_id"] for r in rows] == [None, None, *sorted(known)]
        assert [r["start"] for r in rows] == [2 * i for i in range(len(ids))] and all(r["verified"] for r in rows)
        turns = spark.createDataFrame([(i, 0, "user", "hi", 3) for i in ids], f"conv_id {kind}, turn long, role string, text string, _t int").coalesce(1)
        got = {r["conv_id"]: r["n_turns"] for r in chat.read_back(chat.format_conversations(turns)).collect()}
        assert got == {i: ids.count(i) for i in ids}


def test_many_copies_of_a_text_are_one_row_of_a_bucket(spark):
    rnd = random.Random(1)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(90))
    docs = spark.createDataFrame([(i, text) for i in range(5000)] + [(5000, text[:50] + "!" * 30), (5001, "x" * 20)], "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeats(docs, suffix_dedup.Params(length=40, gram=8, block=8)).collect()}
    assert len(got) == 5002 and all(got[i] == (90, 1) for i in range(5000)) and got[5000] == (50, 1) and got[5001] == (0, 0)


def test_long_and_repeated_words_are_aligned_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "_HITS", 50)
    monkeypatch.setattr(decontaminate, "_STRETCH", 64)
    item = [f"i{k}" for k in range(12)]
    words = ["i1", "i2"] * 300 + item + ["i5", "i6", "z"] * 200
    params = decontaminate.Params()
    items = decontaminate.Items([7], [" ".join(item)], params)
    items.choose_seeds(np.ones(len(items.known), int))
    best = decontaminate._aligned(items, [" ".join(words), " ".join(words[:600])])
    assert best == {(0, 0): (12, 612)}
