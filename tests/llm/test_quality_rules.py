"""Quality rules: counts against plain Python, the learner on made-up tables, verdicts on held-out rows."""

import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from huestrata.llm import quality_rules as q

SCHEMA = "doc_id long, text string, lang string, source string, n_words long, kept boolean, rule string, _t string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, False, "x", "x") for i, t in rows], SCHEMA)


def plain(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words as the contract has them."""
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(covered)


def texts_of(seed=3):
    rnd = random.Random(seed)
    letters = ["a", "b", "A", "é", "\U0001f600", "|", "#", "<", "\x1c", " ", "　", "1"]
    out = [None, "", " ", "\n\n", "a", "a b", "a a a", "a a a a", "A a A a A a", "x y z x y z", "x\ny\nx\n\n \n x\nx", "a\r\na\r\na", "\n".join(["same line"] * 50), "w " * 3000, "\x0b\x0c\t", "###"]
    for _ in range(300):
        out.append("".join(rnd.choice([" ", "\n", "\t", "  "]) if rnd.random() < 0.3 else rnd.choice(letters[: rnd.randrange(2, 12)]) for _ in range(rnd.randrange(0, 160))))
    return [*out, "long " + "".join(rnd.choice("abc \n") for _ in range(1_300_000))]


def test_counts_equal_plain_python(spark):
    texts = texts_of()
    got = {r["doc_id"]: r for r in q.text_statistics(documents(spark, enumerate(texts))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert tuple(r[n] for n in q.COUNTS[:5]) == plain(t), (i, t[:80])
        words = re.findall("[^\x20\x09-\x0d]+", t or "")
        assert (r["n_distinct_words"], r["n_next_words"]) == (len(set(words)), sum(a == b for a, b in zip(words, words[1:], strict=False)))
        assert r["n_lines"] == sum(bool(x.strip(" \t\n\v\f\r")) for x in (t or "").split("\n"))
        assert r["symbols_per_word"] == (r["n_symbols"] / len(words) if words else 0)


def test_learner_finds_conjunctions_in_order():
    rng = np.random.default_rng(1)
    x = {"a": rng.random(6000), "b": rng.random(6000), "c": rng.random(6000), "same": np.zeros(6000)}
    bad = ((x["a"] > 0.7) & (x["b"] <= 0.4)) | (x["c"] > 0.9)
    rules = q.learn_rules(x, ~bad)
    fired = np.zeros(6000, bool)
    for rule in rules.rules:
        assert 1 <= len(rule.conditions) <= 4 and rule.right >= 9 * rule.wrong
        fired |= rule.holds(x)
    assert np.mean(fired == bad) > 0.97 and any(len(r.conditions) == 2 for r in rules.rules)
    assert rules.rules == q.learn_rules(x, ~bad).rules and "drop if" in str(rules)


def test_noise_gives_no_rules_and_one_class_none():
    rng = np.random.default_rng(2)
    x = {"a": rng.random(3000)}
    assert not q.learn_rules(x, rng.random(3000) < 0.5).rules
    assert not q.learn_rules(x, np.ones(3000)).rules and not q.learn_rules({"a": np.empty(0)}, np.empty(0)).rules


def test_expressions_equal_the_rules(spark):
    rng = np.random.default_rng(4)
    x = {"a": rng.integers(0, 9, 400).astype(float), "b": rng.random(400)}
    rules = q.DecisionList([q.Rule((q.Condition("a", True, 4.0), q.Condition("b", False, 0.5))), q.Rule((q.Condition("a", False, 1.0),))])
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x["a"], x["b"], strict=True)], "a double, b double").withColumn("fired", rules.fired()).collect()
    first, second = rules.rules[0].holds(x), rules.rules[1].holds(x)
    assert [r["fired"] for r in rows] == [1 if p else 2 if s else None for p, s in zip(first, second, strict=True)]


def prose(rnd, n, bad):
    w = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(n)]
    if bad == 1:
        w = [x + "###" if i % 3 else x for i, x in enumerate(w)]
    elif bad == 2:
        w = [x.upper() + "!!" for x in w]
    return " ".join(w) + "."


def test_rules_on_held_out_rows(spark):
    rnd, rows, labels = random.Random(9), [], []
    for i in range(1500):
        bad = rnd.choice([0, 0, 0, 0, 1, 2])
        rows.append((i, prose(rnd, rnd.randrange(20, 140), bad)))
        labels.append((i, int(not bad), 0))
    rows += [(9000, None), (9001, ""), (None, prose(rnd, 90, 0)), (9002, "again and over " * 400)]
    truth = {i: y for i, y, _ in labels}
    labels += [(None, 1, 1), (5, None, None), (6, truth[6], 0)]
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rules = q.train_rules(docs, marks)
    assert 1 <= len(rules.rules) <= 6
    got = q.apply_rules(docs, rules).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        n, *rest = plain(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, *rest)
        assert r["base_failed"] == (n < 50 or 100 * rest[-1] > 50 * n) and r["kept"] == (not r["base_failed"] and r["rule"] is None)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [r for r in got if r["held_out"] and not r["base_failed"] and r["doc_id"] in truth]
    assert len(held) > 100 and np.mean([r["kept"] == bool(truth[r["doc_id"]]) for r in held]) > 0.97
    left = q.keep_by_rules(docs, rules)
    assert left.columns == docs.columns and left.count() == sum(r["kept"] for r in got)
    nothing = q.train_rules(docs, marks.limit(0))
    assert not nothing.rules and q.apply_rules(docs, nothing).where(F.col("kept") == F.col("base_failed")).count() == 0
    assert q.apply_rules(documents(spark, []), rules).count() == 0
