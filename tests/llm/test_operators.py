"""The corpus operators against brute force on small tables, and on rows that are empty, null, repeated or long."""

import collections
import math
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from linkloom.llm import components, decontamination, hpylm, language_id, licenses, line_dedup, near_dedup, packing, quality_classifier, quality_rules, queries, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = {i: i + 32 for i in range(65, 91)}
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _words(text):
    return WORDS.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    vocab = ["".join(rng.choice(["an", "the", "or", "ti", "sh", "on", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    out = {i: say(rng.randint(6, 120)) + "\n" + say(8) for i in range(60)}
    for i in range(60, 110):  # copies, and copies with words changed
        words = out[rng.randrange(40)].split(" ")
        for _ in range(i % 6):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        out[i] = " ".join(words)
    out |= {110: None, 111: "", 112: "  \n\t ", 113: "One two", 114: "one  TWO", 115: "! ? .", 116: say(9000), 117: "x"}
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "fr", None][i % 3], f"src{i % 4}", len(t or "")) for i, t in texts.items()]
    return spark.createDataFrame([*rows, (None, "no id at all here now", "en", None, 5)], SCHEMA).repartition(5)


def _rows(df):
    return [r.asDict() for r in df.collect()]


def _groups(pairs, nodes):
    place = {n: n for n in nodes}

    def top(x):
        while place[x] != x:
            x = place[x]
        return x

    for a, b in pairs:
        p, q = top(a), top(b)
        place[max(p, q)] = min(p, q)
    return {n: top(n) for n in nodes}


def _held(i, m, k):
    return i is not None and zlib.crc32(str(i).encode()) % m == k


# 1


def test_scoring_counts_and_bases(spark, docs, texts):
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = {r["doc_id"]: r for r in _rows(hpylm.score(docs, held))}
    full = dict(texts) | {None: "no id at all here now"}
    tokens = {i: [*_words(t), None] for i, t in full.items()}
    counts = collections.Counter(w for i, v in tokens.items() if not _held(i, 7, 2) for w in v)
    n, v = sum(counts.values()), len(counts)
    assert set(got) == set(full)
    for i, ws in tokens.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ws), sum(counts[w] > 0 for w in ws), n, _held(i, 7, 2))
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + 1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r["score"] < 0
    one = lambda c: sum(got[i][c] for i in got if not got[i]["held_out"])
    assert one("score") > one("base_score")


class _Seating:
    """A hierarchical Pitman-Yor model that seats customer by customer."""

    def __init__(self, d, words, rng):
        self.d, self.words, self.rng = d, words, rng
        self.at = [collections.defaultdict(lambda: collections.defaultdict(list)) for _ in range(3)]  # level, context, word: table sizes
        self.n = [collections.defaultdict(lambda: [0, 0]) for _ in range(3)]  # customers and tables of a context

    def p(self, context, w):
        if context is None:
            return 1 / (self.words + 1)
        k = len(context)
        own = self.at[k].get(context, {}).get(w, [])
        c, t = self.n[k].get(context, (0, 0))
        return hpylm.probability(sum(own), len(own), c, t, self.d[k], self.p(context[1:] if k else None, w))

    def add(self, context, w):
        if context is None:
            return
        k, up = len(context), context[1:] if context else None
        own, n = self.at[k][context][w], self.n[k][context]
        weights = [x - self.d[k] for x in own] + [(hpylm.STRENGTH + self.d[k] * n[1]) * self.p(up, w)]
        at = self.rng.choices(range(len(weights)), weights)[0]
        n[0] += 1
        if at == len(own):
            own.append(1)
            n[1] += 1
            self.add(up, w)
        else:
            own[at] += 1

    def remove(self, context, w):
        if context is None:
            return
        k = len(context)
        own, n = self.at[k][context][w], self.n[k][context]
        at = self.rng.choices(range(len(own)), own)[0]
        own[at] -= 1
        n[0] -= 1
        if not own[at]:
            del own[at]
            n[1] -= 1
            self.remove(context[1:] if context else None, w)


def test_scores_against_a_customer_by_customer_sampler(spark, monkeypatch):
    """Over several buckets, some of them parts of a common word's."""
    rng = random.Random(41)
    vocab = [f"w{k}" for k in range(60)]
    follow = {w: rng.sample(vocab, 4) for w in vocab}
    texts = {}
    for i in range(90):
        words = [rng.choice(vocab)]
        while len(words) < rng.randint(5, 60):
            words.append("the" if rng.random() < 0.25 and words[-1] != "the" else rng.choice(follow.get(words[-1], vocab)) if rng.random() < 0.8 else rng.choice(vocab))
        texts[i] = " ".join(words)
    texts |= {90: None, 91: "never seen words", 92: "the the the the the the the the"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(hpylm, "BUCKET_TOKENS", 700)
    monkeypatch.setattr(hpylm, "BUCKET_WORDS", 40)
    monkeypatch.setattr(hpylm, "FLUSH_TOKENS", 900)
    got = {r["doc_id"]: r for r in hpylm.score(docs, F.col("doc_id") % 5 == 0).collect()}
    runs = {i: [("<s>", "<s>"), *zip(["<s>", *_words(t)], _words(t), strict=False)] for i, t in texts.items()}
    tokens = {i: list(zip(runs[i], [*_words(t), "</s>"], strict=True)) for i, t in texts.items()}
    learned = [x for i, v in tokens.items() if i % 5 for x in v]
    counts = collections.Counter(learned)
    first = lambda xs: hpylm._discount(*(list(xs).count(k) for k in (1, 2)))
    pairs = collections.Counter((u[1:], w) for u, w in counts)
    d = [first(collections.Counter(w for _, w in pairs).values()), first(pairs.values()), first(counts.values())]
    model = _Seating(d, len({w for _, w in learned}), rng)
    order = list(learned)
    rng.shuffle(order)
    for x in order:
        model.add(*x)
    want = collections.Counter()
    for sweep in range(14):
        for x in order:
            model.remove(*x)
            model.add(*x)
        if sweep >= 4:
            for i, v in tokens.items():
                for k, x in enumerate(v):
                    want[i, k] += model.p(*x) / 10
    score = {i: sum(math.log10(want[i, k]) for k in range(len(v))) for i, v in tokens.items()}
    off = {i: abs(got[i]["score"] / score[i] - 1) for i in texts}
    print("off by", max(off.values()), sum(off.values()) / len(off))
    assert max(off.values()) < 0.1 and sum(off.values()) / len(off) < 0.02
    assert all(got[i]["n_tokens"] == len(v) for i, v in tokens.items())


def test_the_probabilities_of_a_context_sum_to_one():
    import numpy as np

    rng = np.random.default_rng(1)
    parent = rng.random(41)
    parent /= parent.sum()
    c = np.append(rng.integers(0, 9, 40), 0)
    t = np.minimum(c, 1 + c // 3)
    assert math.isclose(hpylm.probability(c, t, c.sum(), t.sum(), 0.6, parent).sum(), 1, rel_tol=1e-12)


def test_tables_are_drawn_from_their_conditional():
    import numpy as np

    n, c, others, parent, d = 40_000, 5, 7, 0.05, 0.5
    weights = []
    for t in range(1, c + 1):
        w = math.exp(hpylm.log_stirling(d)[c, t]) * parent**t
        for k in range(t):
            w *= hpylm.STRENGTH + d * (others + k)
        weights.append(w)
    want = np.array(weights) / sum(weights)
    got = hpylm.draw_tables(np.full(n, c), np.full(n, others), np.full(n, parent), d, hpylm.STRENGTH, 3)
    share = np.bincount(got, minlength=c + 1)[1:] / n
    assert np.abs(share - want).max() < 0.01
    # beyond EXACT: as seated one by one
    rng = random.Random(5)
    c, alone = 300, []
    for _ in range(400):
        t = int(hpylm.draw_tables(np.array([hpylm.EXACT]), np.array([others]), np.array([parent]), d, hpylm.STRENGTH, rng.randrange(1 << 40))[0])
        for k in range(hpylm.EXACT, c):
            a = (hpylm.STRENGTH + d * (others + t)) * parent
            t += rng.random() < a / (a + k - d * t)
        alone.append(t)
    many = hpylm.draw_tables(np.full(4000, c), np.full(4000, others), np.full(4000, parent), d, hpylm.STRENGTH, 9)
    assert abs(many.mean() - sum(alone) / 400) < 0.3


# 2


def test_packing_is_best_fit(spark):
    rng = random.Random(3)
    pieces = sorted(((rng.randint(1, 60), rng.choice(["a", "b", "c", "d", None]), rng.choice([None, 1, 2, 3])) for _ in range(300)), key=lambda p: -p[0])
    bins, place = [], []
    for n, s, c in pieces:
        fit = [(cap, k) for k, (cap, ss, cc) in enumerate(bins) if cap >= n and s not in ss and c not in cc]
        if fit:
            k = min(fit)[1]
        else:
            k = len(bins)
            bins.append([100, set(), set()])
        bins[k][0] -= n
        bins[k][1] |= {s} - {None}
        bins[k][2] |= {c} - {None}
        place.append(k)
    assert packing.pack(pieces, 100) == place


def test_the_packing_query_keeps_near_copies_apart(spark, tmp_path):
    rng = random.Random(21)
    rows = []
    for g in range(4):
        words = [f"w{g}x{rng.randrange(10**6)}" for _ in range(60)]
        for k in range(6):
            changed = [*words]
            changed[10 * k] = f"other{g}x{k}"
            rows.append((6 * g + k, " ".join(changed), None, None, 0))
    rows += [(None, "no id but equal texts", None, None, 0)] * 2
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = _rows(queries.op2_best_fit_packing(spark, str(tmp_path)))
    assert len(got) == len(rows)
    held = collections.Counter((r["bin"], "none" if r["doc_id"] is None else r["doc_id"] // 6) for r in got)
    assert max(held.values()) == 1
    assert len({r["bin"] for r in got}) < len(got)


def test_packing_places_every_token_once(docs, texts):
    packed = packing.assign(docs.withColumns({"tokens": F.lit("clash"), "shard": F.lit(1), "bin": F.lit(2)}), capacity=64)
    rows = _rows(packed)
    figures = packing.summary(packed, 64).first()
    assert (figures["pieces"], figures["tokens"], figures["bins"]) == (len(rows), sum(r["n_tokens"] for r in rows), len({r["bin"] for r in rows}))
    assert 0 < figures["fill"] <= 1
    tokens = collections.Counter()
    for r in rows:
        tokens[r["doc_id"]] += r["n_tokens"]
    assert tokens == {i: len(_words(t)) + 1 for i, t in texts.items()} | {None: 7}
    for b in {r["bin"] for r in rows}:
        own = [r for r in rows if r["bin"] == b]
        sources = [r["source"] for r in own if r["source"] is not None]
        clusters = [r["cluster_id"] for r in own if r["cluster_id"] is not None]
        assert sum(r["n_tokens"] for r in own) <= 64 and len(set(sources)) == len(sources) and len(set(clusters)) == len(clusters)


def test_shuffle_files_of_written_tables_go(spark):
    """Without waiting for a garbage collection, and while the frames are still referred to."""
    import pathlib
    import time

    from linkloom.llm.common import TIDY, cut, ensure_checkpoint_dir, settings

    ensure_checkpoint_dir(spark)
    folders = [pathlib.Path(str(x)) for x in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    files = lambda: {x.name for f in folders for x in f.rglob("shuffle_*.data")}
    rows = spark.range(50_000).repartition(3, "id")
    before, value = files(), spark.conf.get("spark.sql.adaptive.enabled")
    table = cut(rows)
    with settings(spark, TIDY | {"spark.sql.adaptive.enabled": "false"}):
        held = spark.range(50_000).repartition(3, "id").checkpoint()
    time.sleep(3)
    assert not files() - before
    assert table.count() == held.count() == 50_000 and spark.conf.get("spark.sql.adaptive.enabled") == value


# 3


def _near_groups(texts):
    """The sets of 5-word shingles and the component of each text, by comparing all pairs."""
    sets = {}
    for i, t in texts.items():
        w = _words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids = sorted(sets)
    return sets, _groups([(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])], ids)


def test_near_duplicates(docs, texts):
    sets, want = _near_groups(texts)
    got = {r["doc_id"]: r for r in _rows(near_dedup.find(docs))}
    assert {i: (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) for i in sets} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert got[None]["component_id"] is None and got[None]["kept"]
    left = near_dedup.deduplicate(docs.withColumn("component_id", F.lit(9)))
    assert sorted(r["doc_id"] for r in left.where("doc_id is not null").collect()) == sorted(i for i in sets if want[i] == i)


def test_near_duplicates_that_no_hub_connects(spark):
    """A large group of variants, compared in several blocks."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(400):
        words = list(base)
        for k in rng.sample(range(60), rng.randint(1, 3)):
            words[k] = f"v{rng.randrange(10**6)}"
        texts[i] = " ".join(words)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(56)} for i, t in texts.items()}
    links = [(a, b) for a in sets for b in range(a + 1, 400) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = _groups(links, sets)
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(6)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.find(df).collect()} == want


def test_hubs_meet_only_other_components(spark):
    """Of a group's members the hub meets those that no link joins to it yet; the others would join nothing."""
    from linkloom.llm import tiles

    rows = spark.createDataFrame([(g, i, 0 if i < 30 else i) for g in (1, 2) for i in range(33)] + [(3, i, 0) for i in range(30)], "group long, node long, comp long")
    weights = spark.createDataFrame([(i, 100 - i) for i in range(33)], "node long, weight long")
    assert sorted(map(tuple, tiles.hub_pairs(rows, tiles.hubs_of(rows, weights)).collect())) == [(0, 30), (0, 31), (0, 32)]
    plain = rows.drop("comp")
    assert sorted(map(tuple, tiles.hub_pairs(plain, tiles.hubs_of(plain, weights)).collect())) == [(0, i) for i in range(1, 33)]


def test_near_duplicates_of_rows_that_share_an_id(spark):
    """Two texts of one id and of equally many shingles, each with a copy of its own."""
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a), (1, b), (5, a + " more"), (6, b + " more"), (6, b + " more"), (6, "some other text of its own here"), (7, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.find(df).collect())
    assert got == [(1, 36, 1, True), (1, 36, 1, True), (5, 37, 1, False), (6, 3, 6, True), (6, 37, 1, False), (6, 37, 1, False), (7, 0, 7, True), (7, 0, 7, True)]
    left = near_dedup.deduplicate(df).collect()
    assert sorted((r["doc_id"], (r["text"] or "")[:4]) for r in left) == [(1, "a0 a"), (1, "b0 b"), (6, "some"), (7, ""), (7, "")]


def test_components_of_random_links(spark):
    rng = random.Random(6)
    links = [(rng.randrange(900), rng.randrange(900)) for _ in range(700)] + [(i, i + 1) for i in range(2000, 2100)]
    links = [x for x in links if x[0] != x[1]]
    want = _groups(links, {n for x in links for n in x})
    assert {r["node"]: r["comp"] for r in components.connected(spark.createDataFrame(links, "a long, b long").repartition(9)).collect()} == want


# 4


def test_rule_statistics(docs, texts):
    rows = {r["doc_id"]: r for r in _rows(quality_rules.apply_rules(docs.withColumn("n_words", F.lit("clash")), []))}
    for i, t in texts.items():
        w = WORDS.findall(t or "")
        seen = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {p for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert r["kept"] == (not r["base_failed"]) == (len(w) >= 20 and 100 * len(covered) <= 30 * len(w))


def test_repeated_windows(spark):
    t = " ".join(f"a{i}" for i in range(12))
    df = spark.createDataFrame([(1, f"{t} x {t} y"), (2, "b " * 30)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.statistics(df).collect()} == {1: 24, 2: 30}


def test_a_list_is_learned(spark):
    rng = random.Random(8)
    good = [" ".join(f"word{rng.randrange(99)}" for _ in range(40)) for _ in range(60)]
    bad = [" ".join(f"word{rng.randrange(99)}##" for _ in range(40)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(100)] + [(None, 1), (5, None)], "doc_id long, quality int")
    rules = quality_rules.learn(docs, labels)
    assert rules and {r["doc_id"] for r in quality_rules.apply_rules(docs, rules).where("kept").collect()} == set(range(60))
    assert quality_rules.learn(docs, labels.where("quality = 1")) == []


# 5, 6, 9


@pytest.fixture(scope="module")
def sample(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def _auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize(("module", "label"), [(quality_classifier, "quality"), (toxicity, "toxic")])
def test_classifiers_on_held_out_labels(sample, docs, module, label):
    all_, labels = sample
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = module.fit(all_, labels.where(~held), label)
    scored = module.classify(all_, model, keep=["doc_id"]).join(labels.where(held).where(f"{label} is not null"), "doc_id")
    assert _auc([(r["score"], r[label]) for r in scored.collect()]) > 0.85  # few labels
    odd = _rows(module.classify(docs.withColumn("score", F.lit("clash")), model))
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in odd)


@pytest.mark.parametrize("module", [quality_classifier, toxicity])
def test_classifiers_without_labels(spark, docs, module):
    model = module.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), "quality" if module is quality_classifier else "toxic")
    assert len({r["score"] for r in module.classify(docs, model).collect()}) == 1


def test_ftrl_against_plain_updates():
    """Weights of follow-the-regularised-leader, feature by feature in dictionaries."""
    import numpy as np

    c = quality_classifier
    rng = np.random.default_rng(5)
    size, rows, y = 30, [], []
    for _ in range(40):
        f = np.sort(rng.choice(np.arange(1, size), 6, replace=False))
        rows.append((f, rng.random(6)))
        y.append(float(f.sum() + rng.integers(0, 30) > 100))
    got = c.train(rows, np.array(y), 0.3, size, epochs=2)
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    weight = lambda i: 0.0 if abs(z[i]) <= c.L1 else -(z[i] - math.copysign(c.L1, z[i])) / ((c.BETA + math.sqrt(n[i])) / c.ALPHA + c.L2)
    order = np.random.default_rng(7)
    for _ in range(2):
        for r in order.permutation(len(rows)):
            x = {**dict(zip(rows[r][0].tolist(), rows[r][1].tolist(), strict=True)), size: 1.0}
            w = {i: weight(i) for i in x}
            off = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items()))) - y[r]
            for i, v in x.items():
                g = off * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / c.ALPHA * w[i]
                n[i] += g * g
    assert np.allclose(got.weights, [weight(i) for i in range(size)], atol=1e-6)
    share = sum(y) / len(y)
    assert math.isclose(got.intercept, weight(size) + math.log(0.3 / 0.7) - math.log(share / (1 - share)), rel_tol=1e-9)


def test_calibration_is_isotonic_regression():
    """Each level is the largest of the smallest means of the runs around it."""
    import numpy as np

    rng = np.random.default_rng(6)
    m, y, w = np.round(rng.normal(size=60), 1), rng.integers(0, 2, 60).astype(float), rng.random(60) + 0.1
    steps, levels = toxicity.isotonic(m, y, w)
    u = np.unique(m)
    mean = lambda a, b: (w * y)[(m >= a) & (m <= b)].sum() / w[(m >= a) & (m <= b)].sum()
    want = [max(min(mean(a, b) for b in u if b >= x) for a in u if a <= x) for x in u]
    assert np.allclose(np.interp(u, steps, levels), want) and (np.diff(levels) >= 0).all()


def test_tree_margins_and_scores_text_by_text(sample):
    """Margins by walking each tree, and features of a text that don't depend on its neighbours."""
    import numpy as np
    import pyarrow as pa

    rows = sample[0].orderBy("doc_id").limit(60).collect()
    texts = [r["text"] for r in rows]
    y = np.array([float("the" in (t or "")[:40]) for t in texts])
    model = toxicity.train(pa.array(texts, pa.string()), y, 0.4)
    together = np.concatenate([toxicity.dense(s, model.lexicons) for s in toxicity.K.slices(pa.array(texts, pa.string()))])
    alone = np.concatenate([toxicity.dense(s, model.lexicons) for t in texts for s in toxicity.K.slices(pa.array([t], pa.string()))])
    assert np.allclose(together, alone)
    for x, got in zip(alone, model.margin(alone), strict=True):
        total = model.base
        for feature, threshold, leaf in model.trees:
            k = 0
            for _ in range(toxicity.DEPTH):
                k = 2 * k + 1 + int(x[feature[k]] > threshold[k])
            total += leaf[k - (2**toxicity.DEPTH - 1)]
        assert math.isclose(total, got, rel_tol=1e-9, abs_tol=1e-9)
    grams = lambda ts: [np.concatenate(x) for x in zip(*(quality_classifier.features(s)[0] for s in quality_classifier.K.slices(pa.array(ts, pa.string()))), strict=True)]
    assert all((a == np.concatenate(b)).all() for a, b in zip(grams(texts), zip(*(grams([t]) for t in texts if t), strict=True), strict=True))


def test_language_on_held_out_texts(sample, docs):
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language_id.fit(sample[0].where(~held), texts_per_language=120)
    got = language_id.identify(sample[0].where(held), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.95
    assert sum(r["accepted"] for r in got) / len(got) > 0.98
    odd = {r["doc_id"]: r for r in _rows(language_id.identify(docs.withColumn("accepted", F.lit(1)), model))}
    assert {i for i, r in odd.items() if r["lang_pred"] == "und"} == {110, 111, 112, 115}
    assert all(not odd[i]["accepted"] and odd[i]["score"] == 0 for i in (110, 111, 112, 115))
    assert all(0 <= r["score"] <= 1 for r in odd.values())


def test_kneser_ney_probabilities_sum_to_one():
    """Over the alphabet, the blank and the unknown character, in contexts seen and unseen."""
    import numpy as np
    import pyarrow as pa

    model = language_id.train(pa.array(["abracadabra cab", "bad cab", "acada brac", "dab"] * 2), ["x"] * 8)
    size = len(model.alphabet)
    for context in ([2, 3, 2], [3, 3, 3], [5, 4, 3]):
        total = 0.0
        for c in [1, *range(2, size + 2)]:
            ids = np.array([*context, c], dtype=np.int32)
            index = np.arange(1, 5)
            total += float(np.exp(model._order(ids, index, np.array([3]), language_id.ORDER)[0, 0]))
        assert total == pytest.approx(1, abs=1e-4)


# 7


def _grams(w):
    return collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def _contaminated(texts, items):
    """(doc, item) pairs by comparing every window with every item."""
    use = {i: _words(t) for i, t in items if len(_words(t)) >= 5}
    df = collections.Counter(g for w in use.values() for g in set(_grams(w)))
    want = set()
    for i, t in texts:
        w = _words(t)
        for item, words in use.items():
            weigh = lambda g, a: math.log1p(len(use) / (df[g] if g in a else 1))
            size, a = min(len(words), len(w)), _grams(words)
            for s in range(len(w) - size + 1):
                b = _grams(w[s : s + size])
                top = sum(weigh(g, a) * min(a[g], b[g]) for g in a)
                if top and top / sum(weigh(g, a) * max(a[g], b[g]) for g in a.keys() | b.keys()) >= 0.75:
                    want.add((i, item))
        want |= {(i, item) for item, x in items if 0 < len(v := _words(x)) < 5 and any(w[k : k + len(v)] == v for k in range(len(w)))}
    return want


def test_decontamination(spark, docs, texts):
    items = {1: " ".join(texts[1].split()[3:25]), 2: "Totally unrelated words of an item that no document holds at all", 3: "one two", 4: None, 5: ""}
    extra = [(200, "before it " + "".join(c.upper() if c.isascii() else c for c in items[1]) + " and after", "en", "s", 1), (201, " ".join(w if k != 12 else "changed" for k, w in enumerate(items[2].split() * 3)), "en", "s", 1)] * 2
    own = docs.unionByName(spark.createDataFrame(extra, SCHEMA)).withColumns({"t": F.lit("clash"), "id": F.lit(0), "item_id": F.lit(1)})
    bench = spark.createDataFrame(list(items.items()) * 2, "item_id long, text string").withColumn("doc_id", F.lit(0))
    rows = [(r["doc_id"], r["item_id"]) for r in decontamination.find(own, bench).collect()]
    got = set(rows)
    want = _contaminated([*texts.items(), *((x[0], x[1]) for x in extra)], items.items())
    assert got == want and rows.count((200, 1)) == 2
    assert (200, 1) in got and (113, 3) in got
    left = {r["doc_id"] for r in decontamination.decontaminate(own, bench).collect()}
    assert left == {*texts, None, 200, 201} - {i for i, _ in want} and decontamination.decontaminate(own, bench).columns == own.columns
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_decontamination_does_not_depend_on_blocks(spark, monkeypatch):
    """Items that share openings, and documents each with an item of which one word is changed."""
    rng = random.Random(17)
    opening = [[f"o{k}x{i}" for i in range(12)] for k in range(3)]
    items = [(i, " ".join(opening[i % 3] + [f"w{rng.randrange(10**6)}" for _ in range(40)])) for i in range(60)] + [(60, "three short words"), (61, None)]
    texts = []
    for i in range(60):
        words = items[i][1].split()
        words[(7 * i) % 52] = "changed"
        texts.append((i, "some text before " + " ".join(words) + " and some after it"))
    texts += [(60, "these three SHORT words"), (61, "nothing of them"), (62, None)]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    found = lambda: sorted(tuple(r) for r in decontamination.find(docs, bench).collect())
    one = found()
    assert {r[:2] for r in one} == _contaminated(texts, items) and len(one) > 30
    monkeypatch.setattr(decontamination, "ITEM_BYTES", 1 << 11)
    assert found() == one


def test_no_fingerprint_within_the_radius_is_missed():
    import numpy as np

    rng = np.random.default_rng(2)
    own = rng.integers(0, 1 << 63, (1, 4), dtype=np.uint64)
    flips = np.array([np.packbits(np.isin(np.arange(256), rng.choice(256, k, replace=False))).view(np.uint64) for k in range(decontamination.RADIUS + 1) for _ in range(20)])
    assert len(decontamination.within(own ^ flips, own)) == len(flips)
    others = rng.integers(0, 1 << 63, (2000, 4), dtype=np.uint64) * np.uint64(2)
    assert not decontamination.within(others, own)


def test_the_radius_reaches_the_similarity():
    """Of windows with as many changed words as the similarity allows, at most 1 % lie outside the radius."""
    import numpy as np

    rng = np.random.default_rng(3)
    far = 0
    for _ in range(400):
        n = int(rng.integers(20, 80))
        g = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        other = g.copy()
        other[: int(n * 0.25 / 1.75)] = rng.integers(0, 1 << 63, int(n * 0.25 / 1.75), dtype=np.uint64)  # (1 - x) / (1 + x) = 0.75
        a, b = (decontamination.packed(decontamination.signed_bits(x).sum(axis=0, keepdims=True)) for x in (g, other))
        far += not decontamination.within(a, b)
    assert far <= 4


# 8


def _form(x):
    return " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.translate(LOWER)))


def test_line_groups(spark):
    """Against the edit similarity of all pairs of lines, up to two words changed."""
    rng = random.Random(23)
    vocab = ["".join(rng.choice(["an", "the", "or", "ti", "sh", "on", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    texts = {i: "\n".join(" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 5, 9, 14, 30, 70]))) for _ in range(3)) for i in range(30)}
    for i in range(30, 70):
        own = texts[rng.randrange(20)].split("\n")
        for _ in range(i % 3):
            k = rng.randrange(len(own))
            own[k] = " ".join(rng.choice(vocab) if rng.random() < 0.5 and j == len(own[k]) % (own[k].count(" ") + 1) else w for j, w in enumerate(own[k].split(" ")))
        texts[i] = "\n".join(own)
    texts |= {70: None, 71: "", 72: " \n\t", 73: "! ? .", 74: " ".join(rng.choice(vocab) for _ in range(9000)), 75: "x"}
    docs = spark.createDataFrame([*texts.items(), (None, texts[0])], "doc_id long, text string").repartition(5)
    lines = {(i, n): _form(x) for i, t in texts.items() for n, x in enumerate((t or "").split("\n")) if _form(x)}
    keys = list(lines)
    links = [(a, b) for x, a in enumerate(keys) for b in keys[x + 1 :] if lines[a] == lines[b] or line_dedup.similar(lines[a], lines[b])]
    group = _groups(links, keys)
    want = {i: sorted(n for d, n in keys if d == i and group[d, n] != (d, n)) for i in texts}
    got = {r["doc_id"]: r["removed_lines"] for r in line_dedup.find(docs).collect()}
    assert got == want and any(want.values())
    own = docs.withColumns({"gone": F.lit("clash"), "line": F.lit(1), "node": F.lit(None)})
    cleaned = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate(own).collect()}
    for i, t in texts.items():
        assert cleaned[i] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[i]))
    assert cleaned[None] == texts[0] and line_dedup.deduplicate(own).columns == own.columns


def _altered(rng, words, how):
    out, at = list(words), rng.randrange(len(words))
    if how == "letter":
        k = rng.randrange(len(out[at]))
        out[at] = out[at][:k] + rng.choice("abcdefgh") + out[at][k + 1 :]
    elif how == "word":
        out[at] = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    elif how == "less":
        del out[at]
    elif how == "more":
        out.insert(at, "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))))
    else:
        out[at] = out[at][:1] + " " + out[at][1:]
    return " ".join(out).strip() or "x"


@pytest.mark.parametrize(("how", "times"), [("letter", 1), ("word", 1), ("less", 1), ("more", 1), ("split", 1), ("letter", 3), ("word", 3), ("any", 2)])
def test_recall_of_alike_lines(how, times):
    """Candidates share a table: of all pairs of at least the similarity, a few changes apart, few are missed."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(how)
    found = collections.Counter()
    pairs = []
    for n in (2, 3, 5, 8, 10, 15, 20, 30, 40):
        for _ in range(200):
            words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n)]
            other = words
            for _ in range(times):
                other = _altered(rng, other, rng.choice(["letter", "word", "less", "more", "split"]) if how == "any" else how).split()
            other = " ".join(other)
            if other and line_dedup.similar(_form(" ".join(words)), _form(other)):
                pairs.append((n, " ".join(words), other))
    (s,) = line_dedup.K.slices(pa.array([x for p in pairs for x in p[1:]]), 1 << 30)
    _, _, _, h, first, w = line_dedup._lines(s)
    low = line_dedup.K.LOWER[s.codes]
    bags = line_dedup.bags(low, w, first)
    keys, at = line_dedup.part_keys(low, w, h, first)
    chars = line_dedup._length(low, w, first)
    assert chars.tolist() == [len(_form(x)) for p in pairs for x in p[1:]]
    for k, (n, _, _) in enumerate(pairs):
        a, b = (set(keys[at[i] : at[i + 1]].tolist()) for i in (2 * k, 2 * k + 1))
        i, j = [2 * k], [2 * k + 1]
        assert line_dedup.may_be_alike(bags[i], bags[j], chars[i], chars[j])[0]  # a bound loses nothing
        found[n] += bool(a & b)
    of = collections.Counter(n for n, _, _ in pairs)
    print(how, times, {n: round(found[n] / of[n], 3) for n in of})
    assert all(found[n] >= (0.95 if times == 1 else 0.7) * of[n] for n in of if n >= (8 if times == 1 else 10))


def test_bags_rule_out_no_alike_pair():
    """Also beyond ASCII, with counts that are full, and for the shortest lines."""
    import pyarrow as pa

    rng = random.Random(6)
    letters = "abcé漢😀 "
    pairs = []
    for n in [1, 2, 3, 7, 20, 60, 200, 900, 5000]:
        for _ in range(40):
            a = "".join(rng.choice(letters) for _ in range(n))
            b = list(a)
            for _ in range(rng.randint(0, max(1, n // 6))):
                i = rng.randrange(len(b) + 1)
                b[i : i + rng.randrange(2)] = rng.choice(["", rng.choice(letters), " "])
            pairs.append((a, "".join(b)))
    pairs = [p for p in pairs if _form(p[0]) and _form(p[1])]
    (s,) = line_dedup.K.slices(pa.array([x for p in pairs for x in p]), 1 << 30)
    _, _, _, _, first, w = line_dedup._lines(s)
    bags, chars = line_dedup.bags(line_dedup.K.LOWER[s.codes], w, first), line_dedup._length(line_dedup.K.LOWER[s.codes], w, first)
    alike = [line_dedup.similar(_form(a), _form(b)) for a, b in pairs]
    may = line_dedup.may_be_alike(bags[0::2], bags[1::2], chars[0::2], chars[1::2])
    assert sum(alike) > 100 and all(m for m, x in zip(may, alike, strict=True) if x)


def test_lines_that_no_hub_connects(spark, monkeypatch):
    """A table of many lines, compared in several tiles."""
    from linkloom.llm import tiles

    monkeypatch.setattr(tiles, "BLOCK", 16)
    rng = random.Random(14)
    opening = " ".join(f"opening{i}" for i in range(6))
    ends = [" ".join(f"end{g}of{rng.randrange(99)}" for _ in range(7)) for g in range(20)]
    rows = [(i, f"{opening} {ends[i % 20]}".replace("end", "End" if i % 3 else "emd", i % 2)) for i in range(120)]
    lines = {i: _form(t) for i, t in rows}
    links = [(a, b) for a in lines for b in range(a + 1, 120) if line_dedup.similar(lines[a], lines[b])]
    group = _groups(links, lines)
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: int(group[i] != i) for i in lines} and 1 < len(set(group.values())) < 60


def test_lines_of_repeated_rows_and_ids(spark):
    rows = [(1, "a line of some words here"), (1, "a line of some words here"), (1, "another row of the same id"), (2, "a line of some words here\nanother row of the same id\nown words of this"), (None, "a line of some words here")]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, rows[4][1]), (1, rows[0][1]), (1, rows[0][1]), (1, rows[2][1]), (2, "own words of this")]


def test_edit_distances():
    rng = random.Random(12)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        assert line_dedup.edit_distance(a, b) == row[-1]
        most = rng.randint(0, 8)
        assert min(line_dedup.edit_distance(a, b, most), most + 1) == min(row[-1], most + 1)


# 10


def test_license_places(spark):
    cases = {
        1: "Released under the MIT License.", 2: "GNU General Public License, version 3; Apache-License cc BY cc by", 3: None, 4: "", 5: "éMIT license mit  license", 6: "nothing here",
        7: "Licensed under CC BY-NC 4.0.", 8: "All rights reserved.\nSPDX-License-Identifier: BSD-3-Clause",
    }
    df = spark.createDataFrame(list(cases.items()), "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in _rows(licenses.scan(df))}
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    for i, t in cases.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        at = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    assert "gpl-3.0" in got[2]["labels"] and "cc-by-nc-4.0" in got[7]["labels"] and got[8]["labels"] == "all-rights-reserved,bsd-3-clause" and got[6]["labels"] == ""


def _license_matches(t):
    """Intervals of all rules by Python's regular expressions, less those inside one of a lower rank."""
    canon = re.sub(r"[ \t\n\x0b\f\r]+", " ", (t or "").translate(LOWER))
    found = [(m.start(), m.end(), r.rank, r.label) for r in licenses.RULES for m in re.finditer(r.pattern, canon, re.ASCII)]
    return sorted(x for x in found if not any(y[2] < x[2] and y[0] <= x[0] and y[1] >= x[1] for y in found))


def test_license_matches_against_all_rules(spark, monkeypatch):
    monkeypatch.setattr(licenses, "BLOCK_POWER", 2)
    monkeypatch.setattr(licenses, "BLOCK", 4)
    rng = random.Random(31)
    parts = [
        "Licensed under the MIT License", "the Apache License, Version 2.0", "SPDX-License-Identifier: GPL-3.0-only", "GNU General Public License version 2 or any later version", "CC BY-SA 4.0", "cc by", "All rights\nreserved",
        "released under the terms of the Mozilla Public  License 2.0", "some plain words", "Copyright (c) 2019", "https://creativecommons.org/licenses/by-nc/4.0", "public domain", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "Éclipse Public License", "licensed under the Foo Bar License", "BSD 3-Clause", "\u212agnu", "MIT-0",
    ]
    texts = {i: rng.choice([". ", " ", "\n", "; "]).join(rng.choice(parts) for _ in range(rng.choice([1, 2, 5, 30]))) for i in range(60)} | {60: None, 61: "", 62: "x " * 3000 + parts[0]}
    got = licenses.scan(spark.createDataFrame([*texts.items(), (5, texts[5])], "doc_id long, text string").withColumn("matches", F.lit(1)))
    rows = got.collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        want = _license_matches(texts[r["doc_id"]])
        assert sorted((m["start"], m["end"], m["rank"], m["label"]) for m in r["matches"]) == want
        assert set(filter(None, r["labels"].split(","))) == {x[3] for x in want} | set(filter(None, r["base_labels"].split(",")))


def test_a_license_text_of_a_megabyte(spark):
    import time

    t = "licensed under the mit license. " * 32768
    df = spark.createDataFrame([(1, t), (2, "short")], "doc_id long, text string").repartition(2)
    licenses.scan(df.where("doc_id = 2")).collect()
    began = time.time()
    r = {x["doc_id"]: x for x in licenses.scan(df).select("doc_id", "n_base", "n_words", "first_word", "last_word", "labels", F.size("matches").alias("m")).collect()}[1]
    assert (r["n_base"], r["n_words"], r["first_word"], r["last_word"], r["m"]) == (32768, 5 * 32768, 3, 5 * 32768 - 2, 32768) and r["labels"] == "mit"
    print("seconds", round(time.time() - began, 1))
    assert time.time() - began < 60


# empty tables, and the pipeline


def _samples(parsed):
    """Strings that a parsed pattern matches: one or more for every alternative and optional part."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            one = [chr(arg)]
        elif name == "BRANCH":
            one = [x for branch in arg[1] for x in _samples(branch)]
        elif name == "SUBPATTERN":
            one = _samples(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            one = [x * n for x in _samples(arg[2]) for n in {arg[0], min(arg[1], arg[0] + 1)}]
        elif name == "IN":
            one = [chr(v) for k, v in arg if str(k) == "LITERAL"] or ["7"]
        else:
            one = ["7"] if name == "ANY" else [""]
        out = [a + b for a in out for b in dict.fromkeys(one)]
    return out


def test_every_alternative_of_a_license_rule_holds_a_keyword():
    assert not [k for k in licenses.KEYWORDS if re.search(r"\s", k)]
    for r in licenses.RULES:
        for x in _samples(re._parser.parse(r.pattern)):
            assert any(k in x for k in r.keyword.split("|")), (r, x)


def test_gated_licenses_are_the_ungated_ones(spark, monkeypatch):
    said = [
        "This program is free\nsoftware; you can redistribute it and/or modify it", "All  rights\r\nreserved.", "in the public\ndomain", "Creative\n Commons Attribution", "You just\ndo what the fun you want to",
        "under the same terms as Perl itself", "MIT-0", "mit no attribution", "WTFPL", "ODbL", "pddl", "under the two-clause license", "simplified  licence", "nothing here", None,
    ]
    rows = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    gated = {r["doc_id"]: (r["labels"], r["matches"], r["score"]) for r in licenses.scan(rows).collect()}
    monkeypatch.setattr(licenses, "RULES", [r._replace(keyword="") for r in licenses.RULES])
    monkeypatch.setattr(licenses, "KEYWORDS", [*licenses.KEYWORDS, ""])
    assert gated == {r["doc_id"]: (r["labels"], r["matches"], r["score"]) for r in licenses.scan(rows).collect()}
    assert all(gated[i][0] for i in range(13)) and not gated[13][0] and not gated[14][0]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (
        hpylm.score(none, F.lit(False)), packing.assign(none), near_dedup.find(none), near_dedup.deduplicate(none), quality_rules.apply_rules(none, quality_rules.learn(none, labels)),
        quality_classifier.classify(none, quality_classifier.fit(none, labels)), toxicity.classify(none, toxicity.fit(none, labels)), decontamination.find(none, bench), line_dedup.find(none),
        line_dedup.deduplicate(none), language_id.identify(none, language_id.fit(none)), licenses.scan(none),
    ):
        assert df.count() == 0


def test_repeated_rows_and_clashing_columns(spark, docs, sample):
    """Every row gets a result, equal rows get equal ones, and columns that clash with results or inner names do no harm."""
    all_, labels = sample
    names = ["held", "bucket", "score", "predicted", "keys", "node", "fp", "h", "n", "id", "t", "row", "w", "comp", "group", "kept", "rule", "n_words", "labels", "lang_pred", "bin"]
    own = docs.unionByName(docs).withColumns({c: F.lit("clash") for c in names if c not in docs.columns})
    rules, quality, language = quality_rules.learn(all_, labels), quality_classifier.fit(all_, labels), language_id.fit(all_, texts_per_language=30)
    made = {
        "op1": hpylm.score(own, F.lit(False)).select("doc_id", "score"), "op3": near_dedup.find(own).select("doc_id", "component_id"), "op4": quality_rules.apply_rules(own, rules).select("doc_id", "kept"),
        "op5": quality_classifier.classify(own, quality).select("doc_id", "score"), "op9": language_id.identify(own, language).select("doc_id", "lang_pred"), "op10": licenses.scan(own).select("doc_id", "labels"),
        "op8": line_dedup.find(own.where("doc_id is not null")).select("doc_id", "n_removed"),
    }
    for name, df in made.items():
        found = collections.defaultdict(list)
        for r in df.collect():
            found[r[0]].append(round(r[1], 9) if isinstance(r[1], float) else r[1])
        assert all(len(v) == 2 and v[0] == v[1] for v in found.values()), name
        assert len(found) == docs.count() - (name == "op8")
    packed = packing.assign(own, capacity=64)
    assert packed.where("piece = 0").count() == own.count()


def test_pipeline_stages_take_effect(spark, docs, texts, tmp_path):
    """Each stage against brute force on what its predecessor kept."""
    import corpus_pipeline as C

    item = " ".join(texts[1].split()[3:25])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = docs.withColumn("score", F.lit(1))
    for name, stage in C.STAGES:
        before, columns = {r["doc_id"]: r["text"] for r in now.collect()}, now.columns
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        after = {r["doc_id"]: r["text"] for r in now.collect()} if name != "packing" else {}
        if name != "packing":
            assert now.columns == columns
        named = {i: t for i, t in before.items() if i is not None}
        if name == "language_id":
            assert {110, 111, 112, 115}.isdisjoint(after) and all(before[i] == t for i, t in after.items()) and len(after) > 0.9 * len(before)
        elif name == "line_dedup":
            lines = [_form(x) for i, t in sorted(named.items()) for x in (t or "").split("\n") if _form(x)]
            left = [_form(x) for i, t in sorted(after.items(), key=lambda x: x[0] or 0) if i is not None for x in (t or "").split("\n") if _form(x)]
            assert set(after) == set(before) and len(left) == len(set(left)) < len(lines)
            gone = [x for x in dict.fromkeys(lines) if x not in set(left)]
            assert all(any(line_dedup.similar(x, y) for y in lines if y != x) for x in gone)
        elif name == "near_dedup":
            group = _near_groups(named)[1]
            assert after == {i: t for i, t in before.items() if i is None or group[i] == i}
        elif name == "decontamination":
            bad = {i for i, _ in _contaminated(named.items(), [(1, item)])}
            assert bad and after == {i: t for i, t in before.items() if i not in bad}
    tokens = collections.Counter()
    for r in now.collect():
        tokens[r["doc_id"]] += r["n_tokens"]
    assert tokens == {i: len(_words(t)) + 1 for i, t in before.items()}


def test_registered_queries_have_sound_oracles():
    from linkloom.llm import queries

    assert set(queries.ORACLES) <= set(queries.QUERIES) and "pipeline" in queries.QUERIES and duckdb
