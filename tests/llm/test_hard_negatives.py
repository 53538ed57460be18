"""Hard negatives by the threshold algorithm against scoring every pair."""

import math
import random

import numpy as np
import pytest

from huestrata.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vec string, code int, pos int"


def brute(rows, anchors=100, k=5):
    whole = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out = []
    for i, v, label in whole:
        if i is None or i % anchors:
            continue
        score = lambda o: sum(a * b for a, b in zip(v, o, strict=False))  # noqa: B023, E731
        ranked = sorted(((-score(o), math.inf if j is None else j, own == label) for j, o, own in whole if j != i), key=lambda r: r[:2])
        for s, p, _ in [r for r in ranked if r[2]][:k]:
            fit = [r for r in ranked if not r[2] and 80 * -s <= 100 * -r[0] <= 100 * -s][:k]
            out += [(i, None if p == math.inf else p, rank + 1, None if n == math.inf else n, -s, -t) for rank, (t, n, _) in enumerate(fit)]
    return sorted(out, key=str)


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", 1, 1) for r in rows], SCHEMA)


def made_up(seed, n, width, spread, labels):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        v = [round(rnd.gauss(0, 1) * spread, 1) if spread > 1 else rnd.gauss(0, 1) * spread for _ in range(width)]
        rows.append((i * 7 % (3 * n) if i % 11 else i * 100, v, 0 if rnd.random() < 0.35 else rnd.randrange(labels)))
    seen, out = set(), []
    for r in rows:
        if r[0] not in seen:
            seen.add(r[0])
            out.append(r)
    return out


@pytest.mark.parametrize("width, spread", [(6, 0.3), (2, 2.0), (40, 0.1)])  # the second is full of ties
def test_hard_negatives_equal_scoring_every_pair(spark, width, spread):
    rows = made_up(width, 700, width, spread, 6)
    rows += [(None, rows[3][1], 1), (None, rows[4][1], 2), (90001, None, 1), (90100, [0.1] * width, None), (90200, [float("nan")] * width, 1), (90300, [float("inf")] * width, 1)]
    rows += [(90400, [None] * width, 1), (90500, [0.0] * width, 2), (90600, rows[0][1], 99)]  # a vector of zeros, a label of its own
    want = brute(rows)
    assert len(want) > 20
    for params in (hn.Params(), hn.Params(block_rows=64, batch_rows=3))[: 2 if width == 2 else 1]:
        got = hn.hard_negatives(table_of(spark, rows).repartition(3), params=params)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_empty_tables_and_repeated_rows(spark):
    assert hn.hard_negatives(table_of(spark, [])).count() == 0
    assert hn.hard_negatives(table_of(spark, [(1, [0.1], 1)])).count() == 0
    copies = [(100, [0.5, 0.5], 1)] + [(5, [0.5, 0.4], 1)] * 4 + [(6, [0.5, 0.3], 2)] * 7  # rows that repeat all are rows of their own
    got = sorted(map(tuple, hn.hard_negatives(table_of(spark, copies)).collect()))
    assert [r[:4] for r in got] == sorted([(100, 5, k, 6) for k in range(1, 6)] * 4)


def test_text_labels_and_scores_beyond_doubles(spark):
    rows = [(100, [3.0e6, 1.0], "a"), (1, [3.0e6, 2.0], "a"), (2, [3.0e6, 1.0], "b"), (3, [3.0e6, 1.5], "b")]
    got = sorted(map(tuple, hn.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()))
    high = (256 * 3_000_000) ** 2
    assert got == [(100, 1, 1, 3, high + 256 * 512, high + 256 * 384), (100, 1, 2, 2, high + 256 * 512, high + 256 * 256)]


def test_search_stops_before_all_is_seen():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(0, 0.125, (4000, 4)))
    lists = hn.Lists(x)
    seen = []

    def offer(new, scores):
        seen.append(len(new))
        return top.offer(scores, new)

    for a in x[:20]:
        top = hn.Tops(np.array([-np.inf]), np.array([np.inf]), 5)
        lists.search(a, lists.thresholds(a[None])[0], offer)
        assert top.scores[0].tolist() == np.sort(x @ a)[::-1][:5].tolist()
    assert sum(seen) < 20 * 4000 / 3
