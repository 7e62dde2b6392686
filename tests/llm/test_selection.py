"""Importance resampling, hard negatives and source mixing against brute force, SQL and rows that are empty, null, repeated or long."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import hard_negatives, importance, mixing, queries

DATA = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda x: f"{x:.12g}" if isinstance(x, float) else str(x)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_hard_negatives", "op13_source_mixing"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA), con.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert got.count() and _canon([tuple(r) for r in got.collect()], got.columns) == _canon(want.fetchall(), want.columns)


def _documents():
    rng = random.Random(3)
    vocab = ["".join(rng.choice(["an", "The", "or", "ti", "9", "é", "ß-"]) for _ in range(rng.randint(1, 4))) for _ in range(80)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows = [(i, say(rng.randint(1, 60)), "en", ["a", "b", "é", None][min(3, i % 7)], 0) for i in range(90)]
    rows += [(90, None, None, None, None), (91, "", "en", "a", 0), (92, " \n\t ", "en", "b", 0), (93, "- ! -", "en", "b", 0), (None, say(30), "en", "a", 0), (94, say(20_000), "en", "long", 0)]
    return rows + rows[:4] + [(5, say(25), "en", "a", 0)]


# 11


def _gains(docs, target, least, most, buckets):
    def runs(text):
        w = LETTERS.findall((text or "").translate(LOWER))
        return [" ".join(w[i : i + n]) for n in range(least, most + 1) for i in range(len(w) - n + 1)], len(w)

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (collections.Counter(bucket(f) for x in texts for f in runs(x)[0]) for texts in (docs, target))
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets))))
    return [(len(runs(x)[0]), sum(gain(bucket(f)) for f in runs(x)[0]), runs(x)[1]) for x in docs]


@pytest.mark.parametrize(("least", "most"), [(1, 1), (1, 2), (2, 3)])
def test_weights_scores_and_ranks(spark, monkeypatch, least, most):
    monkeypatch.setattr(importance, "BLOCK", 2000)
    rows = _documents()
    target = [t for _, t, *_ in rows[:9]] + ["the new words é", None]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("weight", F.lit("x")).withColumn("score", F.lit(1)).withColumn("words", F.lit(2)).repartition(3)
    out = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), least, most, buckets=500, percent=30)
    want = []
    for (i, *_), (n, weight, words) in zip(rows, _gains([r[1] for r in rows], target, least, most, 500), strict=True):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append([i, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= 20])
    able = sorted((r for r in want if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(able[: len(able) * 30 // 100], 1)}
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = [tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in out.collect()]
    assert sorted(got, key=key) == sorted([(*r[:4], rank.get(id(r))) for r in want], key=key)


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame(_documents()[:5], SCHEMA)
    assert importance.resample(none, some).collect() == []
    assert {r["n_features"] > 0 for r in importance.resample(some, none).collect()} == {True}
    assert importance.resample(none, none, 1, 2).collect() == []


# 12


def _mined(rows, positives=5, negatives=10, anchor=lambda i: i % 100 == 0):
    part = []
    for i, v, k in rows:
        if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            part.append((i, (k + 1) % 10 if i is not None and i % 7 == 0 else k, [math.floor(256 * float(x)) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    last = lambda i: (i is None, i or 0)
    out = []
    for i, k, v in part:
        if i is None or not anchor(i):
            continue
        near = sorted(((-dot(v, u), last(j), j) for j, m, u in part if m == k and j != i), key=lambda x: x[:2])[:positives]
        for s, _, p in near:
            far = sorted(((-dot(v, u), last(j), j) for j, m, u in part if m != k and 30 * -s <= 100 * dot(v, u) <= 90 * -s), key=lambda x: x[:2])[:negatives]
            out += [(i, p, r, j, -s, -t) for r, (t, _, j) in enumerate(far, 1)]
    return out


def _vectors(n, seed, dims=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    v = (centres[rng.integers(0, 5, n)] + 0.4 * rng.normal(size=(n, dims))).astype(np.float32)
    return [(i, [float(x) for x in v[i]], int(rng.integers(0, 10))) for i in range(n)]


def _same(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    rows = [tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect()]
    assert sorted(rows, key=key) == sorted(want, key=key)


VECTORS = "vec_id long, embedding array<float>, label int"


def test_hard_negatives_over_many_blocks(spark, monkeypatch):
    """Small blocks and groups, so that the search goes by intervals; ties, copies, and a label with few rows."""
    for name, n in (("BLOCK", 16), ("GROUP", 4), ("GROUPS_PER_TASK", 2), ("ROWS_PER_PIVOT", 40), ("STRIP", 3)):
        monkeypatch.setattr(hard_negatives, name, n)
    rows = _vectors(900, 5)
    rows += [(900 + i, rows[300][1], i % 4) for i in range(60)] + [(1000, rows[1][1], 77), (1100, rows[2][1], 77), (2100, rows[2][1], 3)]
    docs = spark.createDataFrame(rows, VECTORS).withColumn("key", F.lit("x")).withColumn("block", F.lit(1)).repartition(4)
    want = _mined(rows)
    assert len(want) > 200
    _same(hard_negatives.mine(docs), want)


def test_searches_leave_out_blocks_that_cannot_matter(spark, monkeypatch):
    """On rows in clear clusters most blocks aren't scanned."""
    for name, n in (("BLOCK", 32), ("GROUP", 4), ("ROWS_PER_PIVOT", 100)):
        monkeypatch.setattr(hard_negatives, name, n)
    rng = np.random.default_rng(2)
    centres = 4 * np.eye(10)
    rows = [(i, [float(x) for x in centres[i % 10] + 0.05 * rng.normal(size=10)], i // 10 % 2) for i in range(2000)]
    scans = []
    keep = hard_negatives._scan
    monkeypatch.setattr(hard_negatives, "_scan", lambda s, r, asked, *a: scans.append(asked.count()) or keep(s, r, asked, *a))
    index = hard_negatives.Index(hard_negatives.integral(spark.createDataFrame(rows, VECTORS), moved=10**9))
    asking = index.grouped(index.rows.drop("block").where("vec_id % 500 = 0")).withColumn("windows", F.expr(f"array(struct(0 AS w, {-(2**63) + 1} - 1 AS from, {2**63 - 1} AS to))"))
    got = index.search(asking, 3, same=True).groupBy("a").agg(F.sort_array(F.collect_list("score")).alias("s")).join(asking, "a").collect()
    q = {i: np.floor(256 * np.array(v, dtype=np.float32).astype(float)) for i, v, _ in rows}
    kind = {i: k for i, _, k in rows} | {0: 1}  # the label of id 0 moves
    for r in got:
        assert r["s"] == sorted(sorted((int(q[r["vec_id"]] @ q[i]) for i in q if kind[i] == kind[r["vec_id"]] and i != r["vec_id"]), reverse=True)[:3])
    groups = asking.select("g").distinct().count()
    assert len(got) == 4 and sum(scans) < 0.6 * groups * index.directory.select("block").distinct().count()


def test_hard_negatives_of_odd_rows(spark):
    rows = _vectors(250, 8, 3)
    rows += [(300, None, 1), (400, [1.0, None, 2.0], 1), (500, [float("nan"), 1.0, 0.0], 2), (600, [float("inf")] * 3, 2), (700, [1.0, 2.0, 3.0], None), (None, [2.0, 2.0, 2.0], 3), (None, [1.0, 1.0, 1.0], 4)]
    rows += [(800, [], 3), (801, [1.5, -0.5], 3), (0, rows[0][1], rows[0][2]), (100, rows[7][1], 5), (900, [3e4, -2e4, 9e3], 5), (901, [2e4, 2e4, 1e3], 5), (902, [1.0, 0.0, 0.0], 6)]
    _same(hard_negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(3)), _mined(rows))


def test_hard_negatives_of_huge_components(spark):
    rows = [(0, [3e9, 2e9], 1), (1, [2e9, 3e9], 2), (2, [1e9, 1e9], 2), (100, [-1e9, 5.0], 4), (8, [3e30, -1e30], 1), (9, [1e9, 2.0], 1)]
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS)).collect()
    assert {r["anchor_id"] for r in got} <= {0, 100} and all(abs(r["positive_score"]) < 2**63 for r in got)


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS)).collect() == []
    assert hard_negatives.mine(spark.createDataFrame([(1, [1.0], 2)], VECTORS)).collect() == []
    assert hard_negatives.mine(spark.createDataFrame([(100, [1.0], 2)], VECTORS)).collect() == []


# 13


def _filled(sizes, weights, budget, epochs):
    """Targets by clamping and resharing, source by source."""
    target, open_ = {}, set(sizes)
    while True:
        left = budget - sum(epochs * sizes[s] for s in sizes if s not in open_)
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / total > epochs * sizes[s] + 1e-9} if total else set()
        if not over:
            break
        open_ -= over
    for s in sizes:
        target[s] = left * weights[s] / total if s in open_ and total else float(epochs * sizes[s])
    return target


def _check_mix(out, rows, weights, share=1.0, epochs=3):
    sizes = collections.Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(WORDS.findall(t or ""))
    target = _filled(sizes, weights(sizes), share * sum(sizes.values()), epochs)
    got = out.collect()
    assert collections.Counter((r["doc_id"], r["size"], r["source"]) for r in got) == collections.Counter((i, len(WORDS.findall(t or "")), s) for i, t, _, s, _ in rows)
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], target[r["source"]], abs_tol=1e-6)
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["taken"] <= epochs * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6


def _cycle(sizes):
    return {s: 1 + k % 3 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}


def test_mixing(spark):
    rows = _documents()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("x")).withColumn("copies", F.lit(7)).repartition(4)
    _check_mix(mixing.mix(docs), rows, _cycle)
    again = lambda n: sorted(map(str, mixing.mix(docs.repartition(n)).collect()))
    assert again(2) == again(7)
    _check_mix(mixing.mix(docs, share=0.3), rows, _cycle, share=0.3)
    _check_mix(mixing.mix(docs, share=9.0), rows, _cycle, share=9.0)


def test_mixing_clamps_one_source_after_another(spark):
    rows = [(i, "w " * (5 if s == "hot" else 1 + len(s or "")), None, s, 0) for i, s in enumerate(["hot"] * 300 + ["a", "bb", "ccc", "dddd", "eeeee"] * 3 + [None] * 2)]
    _check_mix(mixing.mix(spark.createDataFrame(rows, SCHEMA)), rows, _cycle)


def test_mixing_by_given_weights_and_kept_columns(spark):
    rows = _documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    weights = spark.createDataFrame([("a", 5.0), (None, 1.0), ("gone", 3.0)], "source string, weight double")
    out = mixing.mix(docs, weights, keep=["text", "lang", "source"])
    got = out.collect()
    assert {r["source"] for r in got if r["target"] > 0} == {"a", None} and all(r["taken"] == 0 for r in got if r["source"] not in ("a", None))
    copies = mixing.repeated(out).collect()
    assert sum(len(WORDS.findall(r["text"] or "")) for r in copies) == sum(r["taken"] for r in got)


def test_mixing_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    got = mixing.mix(spark.createDataFrame([(1, None, None, "a", 0), (2, "", None, None, 0)], SCHEMA)).collect()
    assert {(r["size"], r["target"], r["taken"]) for r in got} == {(0, 0.0, 0)}
