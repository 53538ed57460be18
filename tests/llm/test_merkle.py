"""The Merkle manifest against trees built node by node in plain Python."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from huestrata.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """The root, and for each node its siblings (left, right) from the bottom up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(paths):
            k = at[i]
            run = k // 16 * 16
            p.append(("".join(nodes[run:k]), "".join(nodes[k + 1 : run + 16])))
            at[i] = k // 16
        nodes = [digest("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return (nodes or [None])[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        built[s] = tree([leaf_of(r) for r in groups[s]])
    root, over = tree([built[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for r, path in zip(groups[s], built[s][1], strict=True):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            changed = r[4] and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])
            node, proof = leaf_of((*r[:4], changed) if tampered else r), path + over[k]
            for left, right in proof:
                node = digest(left + node + right)
            out.append((r[0], leaf_of(r), built[s][0], root, digest("".join(a + b for a, b in proof)), node, node == root))
    return sorted(out, key=str)


def checked(docs):
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.manifest_check(docs, FIELDS, [*FIELDS[:4], lowered], F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


def rows_of(sizes):
    rnd, rows = random.Random(5), []
    for name, n in sizes.items():
        for i in range(n):
            text = rnd.choice([None, "", "Étude", "UPPER", "lower", "ÄÖ é"]) if i % 3 else f"Text {i} of {name}"
            rows.append((None if rnd.random() < 0.01 else rnd.randrange(10 * n), name, rnd.choice(["en", None]), rnd.choice([None, i]), text))
    rows += [rows[0]] * 3 + [(7, "again", None, None, "A")] * 40  # rows that repeat everything
    rnd.shuffle(rows)
    return rows


def test_manifest_equals_trees_built_node_by_node(spark):
    rows = rows_of({None: 17, "": 1, "a": 16, "B": 15, "é": 256, "z": 257, "hot": 4400, "two": 2, "\U00010000": 3, "￮": 5})
    docs = spark.createDataFrame([(*r, "x", "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, _id string, tree string, pos int").repartition(7)
    got = checked(docs).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert {r["verified"] for r in got} == {True, False}


def test_small_and_empty_tables(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert checked(spark.createDataFrame([], schema)).count() == 0
    for rows in ([(3, None, None, None, None)], [(i, f"s{i}", "en", i, "T") for i in range(300)]):
        assert sorted(map(tuple, checked(spark.createDataFrame(rows, schema)).collect()), key=str) == brute(rows)


def test_proofs_lead_to_the_root_and_fields_do_not_run_into_each_other(spark):
    docs = spark.createDataFrame([(i, "s" if i % 3 else None, "ab" if i % 2 else "a", "c" if i % 2 else "bc") for i in range(700)], "id long, part string, x string, y string")
    made = merkle.merkle_manifest(docs, merkle.leaf_digest("x", "y"), "id", "part")
    assert made.columns == ["id", "part", "leaf", "subroot", "root", "proof"]
    assert made.where(merkle.fold("leaf", "proof") == F.col("root")).count() == 700
    assert made.select("leaf").distinct().count() == 2 and made.select("root").distinct().count() == 1
