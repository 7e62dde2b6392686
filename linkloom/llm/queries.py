"""The corpus operators as named queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from linkloom.llm import decontamination, hard_negatives, hpylm, importance, language_id, licenses, line_dedup, mixing, near_dedup, packing, quality_classifier, quality_rules, toxicity
from linkloom.llm.common import crc_mod, table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    near = near_dedup.find(docs)
    return packing.assign(docs, clusters=near.select("doc_id", F.col("component_id").alias("cluster_id")))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.find(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rules = quality_rules.learn(docs, labels)
    out = quality_rules.apply_rules(docs.select("doc_id", "text"), rules)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = crc_mod("doc_id", 3) == 1
    model = quality_classifier.fit(docs, labels.where(~held), "quality")
    return quality_classifier.classify(docs, model, keep=["doc_id"]).select("doc_id", held.alias("held_out"), "score", "predicted")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = crc_mod("doc_id", 3) == 1
    model = toxicity.fit(docs, labels.where(~held), "toxic")
    return toxicity.classify(docs, model, keep=["doc_id"]).select("doc_id", held.alias("held_out"), "score", "predicted")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.find(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 4) == 2
    model = language_id.fit(docs.where(~held))
    return language_id.identify(docs, model, keep=["doc_id"]).select("doc_id", held.alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_near_dedup": op3_near_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_line_dedup": op8_line_dedup,
    "op9_language_id": op9_language_id,
    "op10_license_scan": op10_license_scan,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_source_mixing": op13_source_mixing,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op3_near_dedup": """WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON b.shingle = a.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(node, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.other)
SELECT c.doc_id, coalesce(n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM (SELECT node AS doc_id, min(other) AS component_id FROM r GROUP BY node) c LEFT JOIN n ON n.doc_id = c.doc_id""",
    # the polynomial of crc32 is worked out for each byte, then over the bytes of each distinct word
    "op11_importance_resampling": """WITH b AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, r: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
q AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
f AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM d) GROUP BY w), g AS (SELECT w, count(*) AS n FROM q GROUP BY w),
x AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM f UNION SELECT w FROM g)),
k AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT)), lambda c, o: xor(c >> 8, t[(xor(c, o) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM x, b),
c AS (SELECT bucket, coalesce(sum(f.n), 0)::DOUBLE AS s, coalesce(sum(g.n), 0)::DOUBLE AS t FROM k LEFT JOIN f USING (w) LEFT JOIN g USING (w) GROUP BY bucket),
n AS (SELECT bucket, floor(1000.0::DOUBLE * ln((t + 1) * ((SELECT sum(s) FROM c) + 10000.0::DOUBLE) / ((s + 1) * ((SELECT sum(t) FROM c) + 10000.0::DOUBLE))))::BIGINT AS gain FROM c),
r AS (SELECT row_number() OVER () AS i, doc_id, w FROM d),
v AS (SELECT i, sum(gain)::BIGINT AS weight FROM (SELECT i, unnest(w) AS w FROM r) JOIN k USING (w) JOIN n USING (bucket) GROUP BY i),
p AS (SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight, ('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT::DOUBLE AS h FROM r LEFT JOIN v USING (i)),
o AS (SELECT doc_id, n_features, weight, weight + floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM p),
z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_features >= 20) OVER () AS able FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= able * 10 // 100 THEN place END AS rank FROM z""",
    "op12_hard_negatives": """WITH e AS (SELECT row_number() OVER () AS i, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS v
FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.i AS a, a.vec_id AS anchor_id, b.i AS b, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a, e b WHERE a.vec_id % 100 = 0),
p AS (SELECT a, anchor_id, b, other AS positive_id, score AS positive_score FROM s WHERE same AND other IS DISTINCT FROM anchor_id QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, other NULLS LAST) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY score DESC, other NULLS LAST) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10""",
    "op13_source_mixing": """WITH r AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, ('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 15))::BIGINT AS draw FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS cap FROM t),
o AS (SELECT *, cap / weight AS fullness, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, sum(source_size) OVER () AS budget FROM w),
l AS (SELECT (budget - below)::DOUBLE / open::DOUBLE AS level FROM o WHERE (budget - below)::DOUBLE / open::DOUBLE <= fullness ORDER BY fullness, source NULLS LAST LIMIT 1),
g AS (SELECT source, source_size, least(cap::DOUBLE, weight::DOUBLE * level) AS target FROM o, l),
c AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole, sum(size) OVER (PARTITION BY r.source ORDER BY draw, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) - size AS before, r.source
FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source),
k AS (SELECT *, whole + (before + size / 2 < target - whole * source_size)::BIGINT AS copies FROM c)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, source, copies FROM k""",
}
