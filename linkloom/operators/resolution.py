"""Entity resolution: names against known variants, with a decision for each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions import vocab as V
from linkloom.functions.text import clean_name, normalize, slugify
from linkloom.plans.loops import cut, ranked

AUTO, HUMAN, MARGIN, SINGLE_CAP, TOP = 92.0, 72.0, 6.0, 70.0, 25
#: Names and variants that meet as a block.
BLOCK = 1024


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * longest common subsequence / total length; two empty strings are alike."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & where.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return 200.0 * (len(a) - s.bit_count()) / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """Best indel ratio among the shared words alone and with the rest of either side; 100 if one has the other's words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    only_x, only_y = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    join = lambda p, q: f"{p} {q}" if p else q
    p, q = join(both, only_x), join(both, only_y)
    return max(indel_ratio(p, q), *((indel_ratio(both, p), indel_ratio(both, q)) if both else (0.0,)))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts, a row each, filled up with -1, and their lengths."""
    n = np.array([len(t) for t in texts])
    out = np.full((len(texts), max(1, int(n.max(initial=0)))), -1, dtype=np.int32)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le"), dtype=np.int32)
    return out, n


def indel_ratios(a: str, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """indel_ratio of a (1 to 63 letters) and each of many texts, given as by _codes."""
    where: dict[int, int] = {}
    for i, c in enumerate(a):
        where[ord(c)] = where.get(ord(c), 0) | 1 << i
    letters = np.array(sorted(where), dtype=np.int32)
    masks = np.array([where[c] for c in letters.tolist()] + [0], dtype=np.uint64)
    at = np.minimum(np.searchsorted(letters, codes), len(letters) - 1)
    met = masks[np.where(letters[at] == codes, at, len(letters))]
    full = np.uint64((1 << len(a)) - 1)
    s = np.full(len(codes), full)
    for k in range(codes.shape[1]):
        u = s & met[:, k]
        s = ((s + u) | (s - u)) & full
    return 200.0 * (len(a) - np.bitwise_count(s)) / (len(a) + n)


def _best_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(norm, person, score): of a block of names against one of variants, the two best persons of each name.

    Texts that share no word meet as their sorted words alone, a name with a whole block at once; only those that
    share some are scored one by one.
    """
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for names, known in zip(batch.column("names").to_pylist(), batch.column("known").to_pylist(), strict=True):
            words = [sorted(set(k["variant"].split())) for k in known]
            joined, single = [" ".join(w) for w in words], np.array([len(k["variant"].split(" ")) == 1 for k in known])
            person = np.array([k["person"] for k in known])
            (codes, n), holders = _codes(joined), {}
            for i, w in enumerate(words):
                for word in w:
                    holders.setdefault(word, []).append(i)
            for name in names:
                own = sorted(set(name.split()))
                a = " ".join(own)
                score = indel_ratios(a, codes, n) if 0 < len(a) < 64 else np.array([indel_ratio(a, j) if own else 0.0 for j in joined])
                score[n == 0] = 0.0
                for i in {i for word in own for i in holders.get(word, ())}:
                    score[i] = token_set_ratio(name, known[i]["variant"])
                if len(name.split(" ")) > 1:
                    score[single] = np.minimum(score[single], SINGLE_CAP)
                top = score.max()
                one = person[score == top].min()
                rest = person != one
                found = [(one, top)]
                if rest.any():
                    second = score[rest].max()
                    found.append((person[rest & (score == second)].min(), second))
                for who, value in found:
                    out[0].append(name)
                    out[1].append(who)
                    out[2].append(float(value))
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], batch.schema.field("known").type.value_type.field("person").type), pa.array(out[2], pa.float64())], names=["norm", "person", "score"])


def resolve(names: DataFrame, variants: DataFrame) -> DataFrame:
    """names (key, name) against variants (person, variant): decision auto, human or new with the best person.

    Exact matches come first, and these have no score to look for.  All other names are scored
    against every variant, block by block, so the work is their product and a task holds two blocks.
    """
    clean = names.select("key", "name", normalize(clean_name(F.col("name"))).alias("norm"))
    count = F.size(F.filter(F.split("norm", " "), lambda t: (t != "") & ~t.isin(V.CONNECTORS)))
    clean = clean.withColumn("tokens", count)
    known = variants.select("person", normalize(F.col("variant")).alias("variant")).where("variant <> ''").distinct()
    exact = clean.join(known, clean["norm"] == known["variant"]).groupBy("key").agg(F.count_distinct("person").alias("n_exact"), F.min("person").alias("exact_person"))
    left = clean.select("norm").where("norm <> ''").join(known, clean["norm"] == known["variant"], "left_anti").distinct()
    blocks = lambda df, x, name: cut(ranked(df, "__n", *df.columns)).groupBy(F.floor(F.col("__n") / BLOCK).alias(f"__{name}")).agg(F.collect_list(x).alias(name))
    pairs = blocks(left, "norm", "names").crossJoin(blocks(known, F.struct("person", "variant"), "known"))
    # dealt evenly, to a number of partitions that adaptive execution leaves: the pairs of blocks are few rows of much work
    pairs = pairs.repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__names", "__known")
    raw = cut(pairs.select("names", "known").mapInArrow(_best_of_blocks, T.StructType([T.StructField("norm", T.StringType()), known.schema["person"], T.StructField("score", T.DoubleType())])))
    best = raw.groupBy("norm", "person").agg(F.max("score").alias("score"))
    rank = Window.partitionBy("norm").orderBy(F.desc("score"), "person")
    top = best.withColumns({"rn": F.row_number().over(rank), "second": F.lead("score").over(rank)}).where("rn = 1")
    out = clean.join(exact, "key", "left").join(top.select("norm", F.col("person").alias("best"), "score", "second"), "norm", "left")
    one, several = F.col("n_exact") == 1, F.col("n_exact") > 1
    score, margin = F.coalesce("score", F.lit(0.0)), F.coalesce("score", F.lit(0.0)) - F.coalesce("second", F.lit(0.0))
    decision = (
        F.when(F.col("norm") == "", "human").when(one & (F.col("tokens") >= 2), "auto").when(one | several, "human")
        .when(F.col("tokens") < 2, "human").when((score >= AUTO) & (margin >= MARGIN), "auto").when(score >= HUMAN, "human").otherwise("new")
    )
    person = F.when(F.col("norm") == "", None).when(one, F.col("exact_person")).when(several, None).when(score >= HUMAN, F.col("best"))
    return out.select("key", "name", "norm", decision.alias("decision"), person.alias("person"), F.when(one | several, 100.0).otherwise(score).alias("score"), F.when(decision == "new", slugify(F.col("norm"))).alias("provisional"))
