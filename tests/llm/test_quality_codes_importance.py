"""Operators 11 to 13 against brute force, and their defined results for nulls, empty and long texts, repeats, ties and extra columns."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from larkspur.llm import importance, quality, queries, vector_codes

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, __key string, __w string, p int, __b int, k string, source string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2, "z", "s") for r in rows], DOCS)


def prose(seed, n, words=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


EDGES = [(1, None), (2, ""), (3, "  \n\t "), (4, "One"), (5, "One"), (6, "Ünïcode ▁ \U0001f600 \n\n <|endoftext|> x" * 3), (7, prose(1, 20000)), (8, "a" * 30000), (None, "null key " * 12), (9, "- !"), (9, "two texts of one key")]


def against_sql(spark, name, key):
    got = queries.QUERIES[name](spark, SF).toPandas().sort_values(key).reset_index(drop=True)
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(queries.ORACLE_SQL[name]).df().sort_values(key).reset_index(drop=True)
    assert set(got.columns) == set(want.columns)
    for col in got.columns:
        if got[col].dtype == object:
            assert (got[col] == want[col]).all(), col
        else:
            assert (got[col].astype(float).fillna(-1) == want[col].astype(float).fillna(-1)).all(), col
    return got


# 11: quality


def labelled(n):
    """Good prose, and texts of symbols, capitals or one word over and over."""
    docs, labels = [], []
    for i in range(n):
        rng = random.Random(i)
        words = prose(i, 60, 3000).split()
        bad = i % 3 == 0
        text = [lambda: " ".join(w + rng.choice(["***", "###"]) for w in words), lambda: " ".join(words).upper(), lambda: " ".join([words[0]] * 60)][i % 9 // 3]() if bad else " ".join(words)
        docs.append((i, text))
        labels.append((i, int(not bad)))
    return docs, labels


def test_quality_on_held_out_labels(spark):
    got = {r.doc_id: r for r in queries.op11_quality(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality is not None}
    held = [i for i in labels if i in got and zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i in held) and len(got) == 1000
    good, bad = [i for i in held if labels[i] == 1], [i for i in held if labels[i] == 0]
    assert sum(got[i].predicted for i in good) >= 0.98 * len(good)
    assert sum(got[i].predicted for i in bad) <= 0.1 * len(bad)


def test_quality_votes_equal_brute_force(spark):
    rows, labels = labelled(240)
    docs, lab = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.learn(docs, lab, ~quality.held_out())
    got = {r.k: r for r in quality.score(docs.repartition(7), model).collect()}
    assert got == {r.k: r for r in quality.score(docs.coalesce(1), model).collect()}
    vectors = [[int(x) for x in v] for v in model.vectors]

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))

    for i, text in rows[:30]:
        own = [int(x) for x in model.project(quality.bags(pa.array([text], pa.string())))[0]]
        near = [cosine(own, v) for v in vectors]
        bar = sorted(near, reverse=True)[quality.K - 1]
        at = [j for j, c in enumerate(near) if c >= bar - 1e-12]
        w = [near[j] ** quality.SHARP * model.share[model.labels[j]] for j in at]
        vote = (sum(x * model.labels[j] for x, j in zip(w, at, strict=True)) + quality.PRIOR * model.rate) / (sum(w) + quality.PRIOR)
        p = float(np.interp(vote, model.x, model.y))
        assert got[i].score == pytest.approx(p * (1 - 1e-6) + vote * 1e-6, abs=1e-9)
        assert got[i].cosine == pytest.approx(max(near), abs=1e-9)


def test_quality_bags_equal_counting(monkeypatch):
    texts = [None, "", "A b  b\tb. c", "Ab\n12 x12! Ab", " lead", prose(3, 300, 20)]
    whole = quality.bags(pa.array(texts, pa.string()))
    monkeypatch.setattr(quality, "WORDS", 7)
    pieces = quality.bags(pa.array(texts, pa.string()))
    assert all((a == b).all() for a, b in zip(whole, pieces, strict=True))
    monkeypatch.setattr(quality, "WORDS", 1 << 19)
    for i, text in enumerate(texts):
        alone = quality.bags(pa.array([text], pa.string()))
        s = slice(whole[0][i], whole[0][i + 1])
        assert (alone[1] == whole[1][s]).all() and (alone[2] == whole[2][s]).all()
    words = sum(len((t or "").split()) for t in texts)
    pairs = sum(max(0, len((t or "").split()) - 1) for t in texts)
    assert whole[2].sum() == 2 * words + pairs + sum(10 * sum(a == b for a, b in zip(w, w[1:], strict=False)) // max(1, len(w)) for w in ((t or "").split() for t in texts))


def test_quality_edges(spark):
    rows, labels = labelled(120)
    rows += [(1000 + (i or 0), t) for i, t in EDGES]
    docs = docs_of(spark, rows)
    lab = spark.createDataFrame([*labels, (3, None), (None, 1), (1, 0), (5000, 1)], "doc_id long, quality int")
    model = quality.learn(docs, lab, ~quality.held_out())
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if r.k in (1001, 1002, 1003)}
    assert len(empty) == 1 and all(r.nearest is None for r in got if r.k in (1001, 1002, 1003))
    assert len({r.score for r in got if r.k in (1004, 1005)}) == 1
    assert quality.score(docs.limit(0), model).count() == 0
    none = quality.learn(docs, lab.limit(0), ~quality.held_out())
    assert {r.score for r in quality.score(docs, none).collect()} == {0.0}
    one = quality.learn(docs, lab.filter("quality = 1"), ~quality.held_out())
    assert {r.score for r in quality.score(docs, one).collect()} == {1.0}


# 12: vector codes

VECTORS = "vec_id long, embedding array<float>, label int, p int, v string, code string, error long"


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], VECTORS)


def brute_codes(rows):
    """rows: (vec_id, vector, label) -> {(vec_id, vector): (code, error)}, entries."""
    kept = [(i, tuple(math.floor(4096 * float(np.float32(x))) for x in v), lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = len(order[0][1])
    order = [r for r in order if len(r[1]) == length]
    cuts = [(p * length // 8, (p + 1) * length // 8) for p in range(8)]
    books = [[list(r[1][a:b]) for r in order[:16]] for a, b in cuts]

    def near(p, part):
        d = [sum((x - y) ** 2 for x, y in zip(part, e, strict=True)) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(6):
        for p, (a, b) in enumerate(cuts):
            groups = {}
            for r in order:
                groups.setdefault(near(p, r[1][a:b])[0], []).append(r[1][a:b])
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])]
    out = []
    for i, v, lab in kept:
        found = [near(p, v[a:b]) for p, (a, b) in enumerate(cuts)] if len(v) == length else None
        out.append((i, "".join(f"{k:02x}" for k, _ in found) if found else None, sum(e for _, e in found) if found else None, lab))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def checked_codes(spark, rows):
    got = vector_codes.digest(vectors_of(spark, rows)).collect()
    want, digest = brute_codes(rows)
    sums = {}
    for *_, e, lab in want:
        sums[lab] = (sums.get(lab) or 0) + e if e is not None else sums.get(lab)
    key = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in (r[0], r[1] or "", r[2], r[3], r[4]))
    assert sorted(((r.vec_id, r.code, r.error, r.label, r.label_error) for r in got), key=key) == sorted(((i, c, e, lab, sums[lab]) for i, c, e, lab in want), key=key)
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_codes_equal_brute_force_with_edges(spark, monkeypatch):
    rng = random.Random(5)
    base = [[rng.gauss(0, 0.2) for _ in range(16)] for _ in range(40)]
    rows = [(i, [x + rng.gauss(0, 0.01) for x in base[i % 40]], rng.choice([1, 2, None])) for i in range(300)]
    rows += [(500 + i, base[0], 1) for i in range(120)]  # one common vector
    rows += [(700, None, 1), (701, [None] * 16, 1), (702, [float("nan")] * 16, 1), (703, [float("inf")] + [0.0] * 15, 1), (704, [0.0] * 8, 2), (705, [], 3), (706, base[1], 1), (706, base[1], 1), (706, base[2], 1), (None, base[3], 2)]
    checked_codes(spark, rows)
    monkeypatch.setattr(vector_codes, "LEAST_HOT", 50)
    monkeypatch.setattr(vector_codes, "HOT_SHARE", 100)
    checked_codes(spark, rows)


def test_codes_of_few_vectors_odd_lengths_and_none(spark):
    checked_codes(spark, [(i, [i / 7, -i / 3, 0.5, float(i), 1.0, 2.0, 3.0, 4.0, 5.0, i / 9, 0.0], 1) for i in range(5)])
    checked_codes(spark, [(i, [float(i), 1.0, -1.0], None) for i in range(20)])
    assert vector_codes.digest(vectors_of(spark, [(1, None, 1)])).count() == 0
    held = vector_codes.digest(vectors_of(spark, [(1, [1e30] * 8, 1), (2, [-1e30] * 8, 1)])).collect()
    assert {r.error for r in held} == {0}


def test_codes_against_sql(spark):
    assert len(against_sql(spark, "op12_vector_codes", "vec_id")) == 500


# 13: importance resampling


def brute_importance(docs, target):
    gap, low = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def features(text):
        w = gap.findall((text or "").translate(low))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    s, t = [0] * 10000, [0] * 10000
    for texts, counts in ((docs, s), (target, t)):
        for _, text in texts:
            for b in features(text)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10000) / ((s[b] + 1) * (sum(t) + 10000)))) for b in range(10000)]
    out = []
    for i, text in docs:
        n, f = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20))
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    places = {}
    for k, r in enumerate(order[: 5 * len(order) // 100]):
        places.setdefault(r, []).append(k + 1)
    return sorted(((*r[:4], (places.get(r) or [None]).pop(0)) if places.get(r) else (*r[:4], None) for r in out), key=str)


def test_importance_equals_brute_force_with_edges(spark):
    rows = [(i, prose(i, 15 + i % 40, 80)) for i in range(10, 400)] + [(11, prose(11, 26, 80))] * 2 + EDGES
    target = [(1, prose(12, 50, 80)), (2, None), (3, "")]
    bench = spark.createDataFrame([(*r, 1, 2) for r in target], "item_id long, text string, __b int, __n int")
    got = [tuple(r) for r in importance.resample(docs_of(spark, rows), bench).select("__key", "__features", "__weight", "__score", "__rank").collect()]
    assert sorted(got, key=str) == brute_importance(rows, target)
    assert len([r for r in got if r[4]]) == 5 * len([r for r in rows if len(re.findall(r"[^\W_]+", r[1] or "")) >= 20]) // 100 > 10


def test_importance_of_empty_tables(spark):
    docs, bench = docs_of(spark, EDGES), spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(docs.limit(0), bench).count() == 0
    got = importance.resample(docs, bench).collect()
    assert len(got) == len(EDGES) and all(r["__weight"] == 0 for r in got if r["__key"] in (1, 2, 3))


def test_importance_ranks_spread_ties_over_partitions(spark):
    rows = spark.range(0, 5000).selectExpr("id as a", "id % 2 as s").repartition(5)
    from pyspark.sql import functions as F

    got = {r.a: r.n for r in importance.ranked(rows, [F.col("s").desc(), F.col("a").asc()], "n").collect()}
    order = sorted(range(5000), key=lambda a: (-(a % 2), a))
    assert got == {a: k + 1 for k, a in enumerate(order)}


def test_importance_against_sql(spark):
    assert len(against_sql(spark, "op13_importance", "doc_id")) == 1000
