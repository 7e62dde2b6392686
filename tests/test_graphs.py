"""Graph operators against brute force, and the invariants of those that SQL doesn't express."""

import itertools
import math
import random
from collections import defaultdict

import pytest

from linkloom.operators import centrality, communities, curation, graph, paths, resolution
from linkloom.operators import relations as R


@pytest.fixture(scope="module")
def edges(spark):
    rng = random.Random(5)
    pairs = {tuple(sorted(rng.sample(range(14), 2))) for _ in range(18)} | {(20, 21), (21, 22)}
    return [(a, b, rng.choice([6, 10, 12, 20])) for a, b in sorted(pairs)]


def _frame(spark, edges):
    return spark.createDataFrame(edges, "a long, b long, weight20 long")


def _near(edges):
    out = defaultdict(dict)
    for a, b, w in edges:
        out[a][b] = out[b][a] = w
    return out


def _distances(near, s):
    dist, order = {s: 0}, [s]
    for v in order:
        for o in near[v]:
            if o not in dist:
                dist[o] = dist[v] + 1
                order.append(o)
    return dist


def test_hops_and_components(spark, edges):
    near = _near(edges)
    want = {(s, v): d for s in near for v, d in _distances(near, s).items()}
    got = {(r["origin"], r["node"]): r["hops"] for r in graph.hops(_frame(spark, edges)).collect()}
    assert got == want
    comps = {r["node"]: r["comp"] for r in graph.components(_frame(spark, edges)).collect()}
    assert comps == {s: min(_distances(near, s)) for s in near}


def test_ego_of_an_absent_person_is_empty(spark, edges):
    assert graph.ego(_frame(spark, edges), 99).count() == 0


def test_betweenness_and_closeness(spark, edges):
    near = _near(edges)
    length = lambda a, b: 20.0 / near[a][b]
    n = 30
    dist, count = {}, {}
    for s in near:
        d, c = {s: 0.0}, {s: 1}
        todo = dict(d)
        done = {}
        while todo:
            v = min(todo, key=todo.get)
            done[v] = todo.pop(v)
            for o in near[v]:
                e = done[v] + length(v, o)
                if o in done:
                    continue
                if o not in todo or e < todo[o] - 1e-12:
                    todo[o], c[o] = e, c[v]
                elif abs(e - todo[o]) < 1e-12:
                    c[o] += c[v]
        dist[s], count[s] = done, c
    between = dict.fromkeys(near, 0.0)
    for s, t in itertools.combinations(near, 2):
        if t in dist[s]:
            for v in near:
                if v not in (s, t) and v in dist[s] and abs(dist[s][v] + dist[v][t] - dist[s][t]) < 1e-9:
                    between[v] += count[s][v] * count[v][t] / count[s][t]
    got = {r["node"]: r for r in paths.centralities(_frame(spark, edges), n).collect()}
    for v in near:
        assert math.isclose(got[v]["betweenness"], between[v] * 2 / ((n - 1) * (n - 2)), abs_tol=1e-9)
        r, total = len(dist[v]), sum(dist[v].values())
        assert math.isclose(got[v]["closeness"], (r - 1) / total * (r - 1) / (n - 1), abs_tol=1e-9)


def test_eigenvector_is_a_unit_fixpoint(spark, edges):
    main = [e for e in edges if e[0] < 20]
    x = {r["node"]: r["eigenvector"] for r in centrality.eigenvector(_frame(spark, main)).collect()}
    assert math.isclose(sum(v * v for v in x.values()), 1, rel_tol=1e-9)
    near = _near(main)
    y = {v: sum(w / 20 * x[o] for o, w in near[v].items()) for v in x}
    ratio = [y[v] / x[v] for v in x if x[v] > 1e-2]
    assert max(ratio) - min(ratio) < 1e-2


def test_communities_are_no_worse_than_one(spark, edges):
    part = communities.communities(_frame(spark, edges))
    q = communities.modularity(_frame(spark, edges), part).collect()[0][0]
    near = _near(edges)
    m, place = sum(w for *_, w in edges), {r["node"]: r["community"] for r in part.collect()}
    want = sum(w for a, b, w in edges if place[a] == place[b]) / m - sum((sum(sum(near[v].values()) for v in near if place[v] == c) / (2 * m)) ** 2 for c in set(place.values()))
    assert math.isclose(q, want, rel_tol=1e-9) and q > 0
    assert place[20] == place[22] != place[0]


def test_weights(spark):
    rows = [("documentado", 1, 20), ("documentado", 2, 30), ("tradicao_oral", 1, 12), ("hipotese", 0, 3), (None, 1, 6)]
    df = spark.createDataFrame([(c, n) for c, n, _ in rows], "confidence string, n_sources int")
    assert [r["weight20"] for r in R.with_weight(df).collect()] == [w for *_, w in rows]


def test_replay_is_a_stack(spark):
    rng = random.Random(2)
    log = [(s, i, rng.randrange(9), rng.choice(["accept", "defer", "discard", "undo", "undo"])) for s in range(6) for i in range(60)]
    want = []
    for s in range(6):
        stack = []
        for row in [r for r in log if r[0] == s]:
            if row[3] != "undo":
                stack.append(row)
            elif stack:
                stack.pop()
        want += stack
    got = [tuple(r) for r in curation.replay(spark.createDataFrame(log, "source int, seq int, item int, action string")).collect()]
    assert sorted(got) == sorted(want)


def test_a_deferred_item_that_is_accepted_later_leaves_the_queue(spark):
    log = spark.createDataFrame([(1, 1, 5, "defer"), (1, 2, 5, "accept"), (1, 3, 6, "defer")], "source int, seq int, item int, action string")
    items = spark.createDataFrame([(1, 5), (1, 6), (1, 7)], "source int, item int")
    assert sorted(tuple(r) for r in curation.pending(items, log).collect()) == [(1, 6, 1), (1, 7, 0)]


def test_resolution_decisions(spark):
    variants = spark.createDataFrame([(1, "Ana Maria Lima"), (2, "Rui Costa"), (3, "Rui Costa"), (4, "Borsoi"), (5, "Acácio Gil Borsoi")], "person long, variant string")
    names = spark.createDataFrame([(1, "arquiteto Ana Maria Lima"), (2, "Rui Costa"), (3, "Borsoi"), (4, "Ana Maria Limma"), (5, "Zélia Nunes"), (6, "")], "key long, name string")
    got = {r["key"]: (r["decision"], r["person"]) for r in resolution.resolve(names, variants).collect()}
    assert got == {1: ("auto", 1), 2: ("human", None), 3: ("human", 4), 4: ("auto", 1), 5: ("new", None), 6: ("human", None)}


def test_every_person_is_resolved(spark, tmp_path):
    rows = [(i, f"Supplier#{i:09d}", i % 25, 10.0 * i) for i in (1, 199, 200, 201, 4000)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    from linkloom.plans.queries import resolve_entities

    assert sorted(r["key"] for r in resolve_entities(spark, str(tmp_path)).collect()) == [1, 199, 200, 201, 4000]


def test_names_are_scored_against_all_variants(spark):
    known = {1: "wilson thompson", 2: "gilson thompsen", 3: "maria", 4: "kestrel auboin", 5: "ana lima"}
    asked = {1: "Vilson Tompson", 2: "Estrel Oboin", 3: "Qzx Wvy", 4: "Naria", 5: "Wilson Thompson", 6: "Ena Limo", 7: "Vilson Tompson", 8: "Gilson Tompsen"}
    names = spark.createDataFrame(list(asked.items()), "key long, name string")
    variants = spark.createDataFrame(list(known.items()), "person long, variant string")
    got = {r["key"]: r for r in resolution.resolve(names, variants).collect()}
    assert len(got) == len(asked)
    for key, name in asked.items():
        norm = name.lower()
        ranked = []
        for person, variant in known.items():
            score = resolution.token_set_ratio(norm, variant)
            ranked.append((-min(score, 70.0) if " " in norm and " " not in variant else -score, person))
        ranked.sort()
        score, second = -ranked[0][0], -ranked[1][0]
        auto = norm in known.values() or (score >= 92 and score - second >= 6)
        want = "human" if " " not in norm else "auto" if auto else "human" if score >= 72 else "new"
        assert (got[key]["decision"], got[key]["person"]) == (want, ranked[0][1] if score >= 72 else None), name
        assert got[key]["score"] == pytest.approx(score), name
    assert got[1]["decision"] == "human" and got[1]["person"] == 1


def test_rows_are_numbered_over_ranges(spark):
    from pyspark.sql import functions as F

    from linkloom.plans.loops import ranked

    df = spark.range(1000).select("id", (F.col("id") * 7 % 13).alias("x")).repartition(5)
    got = [(r["x"], r["id"]) for r in ranked(df, "k", F.desc("x"), "id").orderBy("k").collect()]
    assert got == sorted(got, key=lambda t: (-t[0], t[1])) and len(got) == 1000
    assert ranked(df.limit(0), "k", "id").count() == 0


def test_names_are_scored_by_blocks(spark, monkeypatch):
    """Blocks of any size give the scores of a plain search; names with a word longer than 63 letters too."""
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    known = sorted({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(40)} | {"x" * 70 + " y"})
    asked = sorted({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(30)} | {"x" * 69 + " z"})
    cap = lambda a, b, s: min(s, resolution.SINGLE_CAP) if " " not in b and " " in a else s
    want = {a: 100.0 if a in known else max(cap(a, b, resolution.token_set_ratio(a, b)) for b in known) for a in asked}
    names = spark.createDataFrame(list(enumerate(asked)), "key long, name string")
    variants = spark.createDataFrame([(i // 2, v) for i, v in enumerate(known)], "person long, variant string")
    monkeypatch.setattr(resolution, "BLOCK", 7)
    rows = resolution.resolve(names, variants)
    assert {r["norm"]: r["score"] for r in rows.collect()} == pytest.approx(want)
    few = [resolution.indel_ratios(a, *resolution._codes(known)).tolist() for a in asked if len(a) < 64]
    assert few == [[resolution.indel_ratio(a, b) for b in known] for a in asked if len(a) < 64]
