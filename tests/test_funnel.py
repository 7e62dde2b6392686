"""The funnel's dictionaries: names by automaton and by first word, a lexicon from its file, needed parts of expressions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from linkloom.functions import text as X
from linkloom.functions import vocab as V
from linkloom.operators import exports, funnel
from linkloom.plans import build
from linkloom.plans import queries as Q
from linkloom.sources import dataset


def _longest_first(words, phrases):
    """All phrases in a text by place, the longest first, and those that stand."""
    hits = sorted((i, -len(p.split()), p) for p in phrases for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    chosen, end = [], 0
    for i, n, p in hits:
        if i >= end:
            chosen.append(p)
            end = i - n
    return list(dict.fromkeys(p for _, _, p in hits)), chosen


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    vocab = "ana lima rui costa maria da silva souza x y".split()
    names = {(k, " ".join(rng.choice(vocab[:8]) for _ in range(rng.randint(1, 4)))) for k in range(40)}
    said = [(f"c{i}", " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40)))) for i in range(60)] + [("none", None), ("empty", ""), ("marks", "?! ..."), ("accents", "Ána  LIMA,\nRui-Costa")]
    return sorted(names), said


def test_names_in_texts_by_either_way(spark, texts, monkeypatch):
    names, said = texts
    chunks = spark.createDataFrame(said, "chunk_id string, text string").repartition(3)
    known = funnel.gazetteer(spark.createDataFrame(names, "person long, name string"))
    who = {}
    for person, name in names:
        who.setdefault(name, []).append(person)
    want = {}
    for c, text in said:
        words = re.findall("[a-z0-9]+", (text or "").lower().replace("á", "a"))
        seen, chosen = _longest_first(words, who)
        if seen:
            want[c] = (seen, [(p, sorted(set(who[p]))) for p in chosen])
    for most in (funnel.MOST_PHRASES, 3):
        monkeypatch.setattr(funnel, "MOST_PHRASES", most)
        got = {r["chunk_id"]: (r["phrases"], [(x["phrase"], x["persons"]) for x in r["chosen"]]) for r in funnel.name_hits(chunks, known).collect()}
        assert got == want


def test_no_names(spark):
    chunks = spark.createDataFrame([("a", "some text")], "chunk_id string, text string")
    none = funnel.gazetteer(spark.createDataFrame([], "person long, name string"))
    assert funnel.name_hits(chunks, none).collect() == [] and funnel._hits_by_first_word(chunks, none).collect() == []


@pytest.mark.parametrize(
    ("pattern", "parts"),
    [
        (r"\bfilh[oa]s? d[eoa]s?\b", [" d"]), (r"\b(esposa|marido) d[eo]\b", ["esposa", "marido"]), (r"(abc)?x", ["x"]), (r"[ab]+", []), (r"a|", []), (r"(ab|cd){2}e", ["ab", "cd"]), (r"casou-se com", ["casou-se com"]),
    ],
)
def test_needed_parts(pattern, parts):
    got = funnel.needed(pattern)
    if parts and max(map(len, parts)) > 2:
        assert got == parts
    rng = random.Random(1)
    pieces = ["filha", "filho", " de", "esposa", "marido", " d", "e", "o", "x", "abc", "ab", "cd", "b", "casou-se com", " "]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 5)))
        for m in re.finditer(pattern, text):
            assert not got or any(x in m.group(0) for x in got)


LEXICON = """
ensino:
  tipo_sugerido: estudo
  padroes: ["\\\\balun[oa]s? d[eao]\\\\b", "[0-9]{4}"]
familia:
  tipo_sugerido: heranca
  padroes: ["\\\\b(esposa|esposo|marido) d[eo]\\\\b", "\\\\bprim[oa]s?\\\\b"]
depoimento:
  padroes: ["houve uma escola"]
vazio:
"""


def test_a_lexicon_from_its_file(spark, tmp_path):
    (tmp_path / "vocabularios").mkdir()
    assert dataset.lexicon(spark, str(tmp_path)).count() == 0 and dataset.common_words(spark, str(tmp_path)) == V.NOT_NAMES
    (tmp_path / "vocabularios/lexico_relacional.yaml").write_text(LEXICON)
    (tmp_path / "vocabularios/common_words.yaml").write_text("[escola, museu]")
    lexicon = dataset.lexicon(spark, str(tmp_path))
    assert {(r["grp"], r["type"]) for r in lexicon.collect()} == {("ensino", "estudo"), ("familia", "heranca"), ("depoimento", None)} and lexicon.count() == 5
    texts = ["Ana foi aluna de Rui em 1950 e alunas da Eva", "o marido de Ana, primo", "Houve uma escola", "nada", None, "ALUNO DO esposo do primeiro", "prima prima primas"]
    rows = {r["i"]: sorted((x["grp"], x["term"]) for x in r["t"]) for r in spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", funnel.triggers(F.coalesce("text", F.lit("")), lexicon).alias("t")).collect()}
    for i, text in enumerate(texts):
        want = {(r["grp"], m.group(0).strip()) for r in lexicon.collect() for m in re.finditer(r["pattern"], (text or "").lower())}
        assert rows[i] == sorted(want)
    assert dataset.common_words(spark, str(tmp_path)) == ["escola", "museu"]
    chunks = spark.createDataFrame([("a", 1, 0, "s", "Na Escola Nova estudou Zeca Souza, aluno de outros")], "chunk_id string, doc_id long, idx long, source string, text string")
    known = funnel.gazetteer(spark.createDataFrame([("p", "Rui Costa")], "person string, name string"))
    assert funnel.matched(chunks, known, lexicon, dataset.common_words(spark, str(tmp_path))).first()["unknown"] == ["zeca souza"]


def test_reports_hold_all_rows_in_order(spark, tmp_path):
    df = spark.range(2500).select((F.lit(2499) - F.col("id")).alias("n"), F.concat(F.lit('a "b", <c> & | '), F.col("id").cast("string")).alias("text"), (F.col("id") % 2 == 0).alias("even"), F.lit(None).cast("string").alias("none")).repartition(7).orderBy("n")
    exports.report({"All": df}, str(tmp_path / "r.md"))
    rows = [x for x in (tmp_path / "r.md").read_text().splitlines() if x.startswith("| ")][2:]
    assert len(rows) == 2500 and [int(x.split(" | ")[0][2:]) for x in rows] == list(range(2500))
    exports.document({"all": df, "empty": df.limit(0), "own": df.select(F.lit('{"x":1}').alias("json")).limit(2)}, str(tmp_path / "r.json"))
    import json

    got = json.loads((tmp_path / "r.json").read_text())
    assert [r["n"] for r in got["all"]] == list(range(2500)) and got["empty"] == [] and got["own"] == [{"x": 1}] * 2
    exports.csv_with_bom(df, f"file:{tmp_path}/r.csv")
    import csv

    table = list(csv.reader((tmp_path / "r.csv").open(encoding="utf-8-sig", newline="")))
    assert len(table) == 2501 and table[1] == ["0", 'a "b", <c> & | 2499', "False", ""] and [int(r[0]) for r in table[1:]] == list(range(2500))


def test_files_that_are_missing(spark, tmp_path):
    sources = spark.createDataFrame([("s1", "raw_pdfs/a.pdf"), ("s2", "raw_pdfs/b/c d.pdf"), ("s3", "raw_pdfs/gone.pdf"), ("s4", None), ("s5", "")], "id string, file string")
    assert build.missing_files(spark, str(tmp_path), sources).count() == 0
    (tmp_path / "raw_pdfs/b").mkdir(parents=True)
    (tmp_path / "raw_pdfs/a.pdf").write_text("x")
    (tmp_path / "raw_pdfs/b/c d.pdf").write_text("y")
    assert [tuple(r) for r in build.missing_files(spark, str(tmp_path), sources).collect()] == [("warning", "missing-file", "sources:s3", "raw_pdfs/gone.pdf")]


def test_first_rows_of_few_keys(spark):
    from linkloom.operators.relations import top

    df = spark.range(3000).select((F.col("id") % 3).alias("key"), (F.col("id") * 7 % 101).alias("x"), "id").repartition(4)
    got = sorted((r["key"], r["place"], r["id"]) for r in top(df, 5, ["key"], F.desc("x"), "id").collect())
    rows = [(i % 3, i * 7 % 101, i) for i in range(3000)]
    assert got == sorted((k, n, i) for k in range(3) for n, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))[:5], 1))


def test_queries_of_the_funnel_agree_either_way(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    a = sorted(map(tuple, Q.QUERIES["gazetteer_matches"](spark, d).collect()))
    monkeypatch.setattr(funnel, "MOST_PHRASES", 2)
    assert a and a == sorted(map(tuple, Q.QUERIES["gazetteer_matches"](spark, d).collect()))


def test_matching_reads_texts_once(spark):
    chunks = spark.createDataFrame([("a", "Ana Lima. Rui Costa, discípulos"), ("b", "nada"), ("c", None)], "chunk_id string, text string")
    known = funnel.gazetteer(spark.createDataFrame([(1, "Ana Lima")], "person long, name string"))
    lexicon = spark.createDataFrame([("ensino", "estudo", "disc[ií]pul[oa]s?")], "grp string, type string, pattern string")
    out = funnel.matched(chunks, known, lexicon)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["chunk_id"]: ([x["phrase"] for x in r["known"]], r["unknown"], [x["term"] for x in r["triggers"]]) for r in out.collect()}
    assert got == {"a": (["ana lima"], ["rui costa"], ["discipulos"]), "b": ([], [], [])}


def test_every_mark_of_references_counts(spark):
    marks = ["DISPONÍVEL EM", "Disponivel em", "acesso EM", " DOI ", "HTTP://x", "https://x", " In:", "(Ed.)", "(ORG.)", "(coord.)", " P. 3", " v. 2", " n. 41", "dissertação (", "Tese (", "Trabalho de conclusão", "[Entrevista cedida"]
    rows = [(m, " ; ".join([m] * 5)) for m in marks]
    got = {r["mark"]: r["is"] for r in spark.createDataFrame(rows, "mark string, text string").select("mark", X.is_bibliography(F.col("text")).alias("is")).collect()}
    want = {m: m != "DISPONÍVEL EM" for m in marks}  # capitals beyond ASCII are no mark
    assert got == want


def test_cheap_tests_change_no_text(spark):
    """Texts are searched or folded only if a cheap test finds that they may hold what is sought; the results are the plain ones."""
    rng = random.Random(7)
    parts = ["SILVA, Ana", "Á, Éa", "ÇÃO LIMA, Ênio", "XX, Ab", "p. 3", "In:", "doi", "Ana Lima", "xAna Lima", "ana", "é", "`", "’", " ", "  ", "\t", "\n", "\x0b", "\f", "\r", " ", "1", "-", "a,"]
    texts = [(i, "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 9)))) for i in range(400)] + [(400, None)]
    t = F.col("text")
    folded = F.trim(F.regexp_replace(F.lower(F.translate(t, V.ACCENTED + "’`", V.PLAIN + "''")), r"\s+", " "))
    authors, marks = F.regexp_count(t, F.lit(V.REFERENCE_AUTHOR)), F.regexp_count(t, F.lit(V.REFERENCE_MARKS))
    plain = (authors >= 3) | ((authors >= 1) & (marks >= 3)) | (marks >= 5)
    names = [F.regexp_extract_all(t, F.lit(p + V.NAME_PATTERN), F.lit(1)) for p in ("", V.NAME_START)]
    df = spark.createDataFrame(texts, "id long, text string").select(
        "id", "text", X.normalize(t).eqNullSafe(folded).alias("folded"), X.is_bibliography(t).eqNullSafe(plain).alias("listed"), names[0].eqNullSafe(names[1]).alias("named")
    )
    assert [r for r in df.collect() if not (r["folded"] and r["listed"] and r["named"])] == []


def test_texts_stay_out_of_python(spark, texts):
    """Only the words of a chunk go to Python, and only if it holds those that phrases share; its columns stay where they are."""
    chunks = spark.createDataFrame(texts[1], "chunk_id string, text string")
    known = funnel.gazetteer(spark.createDataFrame(texts[0], "person long, name string"))
    plan = funnel.matched(chunks, known, spark.createDataFrame([("estudo", "estudo", "lima")], "grp string, type string, pattern string"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("ArrowEvalPython") == 1


def test_texts_that_are_read_once_are_not_written(spark, monkeypatch):
    from linkloom.plans import queries

    written, cut = [], queries.graph.cut
    monkeypatch.setattr(queries.graph, "cut", lambda df: written.append(df.columns) or cut(df))
    queries.find_duplicates(spark, "/root/testdata/sf0.001")
    assert written and not [c for c in written if "text" in c]
