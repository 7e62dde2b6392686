"""Scalar functions, on the cases that fix their meaning."""

from pyspark.sql import functions as F

from linkloom.functions import period, text
from linkloom.operators.resolution import indel_ratio, token_set_ratio


def _each(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_slugs(spark):
    assert _each(spark, ["Maurício do Passo Castro", "  É!  a ", "", None], text.slugify) == ["mauricio-do-passo-castro", "e-a", "", None]


def test_normalize(spark):
    assert _each(spark, ["  Ação\t ’x`  "], lambda c: text.normalize(c)) == ["acao 'x'"]
    assert _each(spark, ["Ḉé"], text.unaccent_any) == ["Ce"]


def test_clean_joins_hyphens_before_breaks(spark):
    assert _each(spark, ["arquite-\ntura\x07 e  mais\r\numa"], text.clean) == ["arquitetura e mais uma"]


def test_noise(spark):
    assert _each(spark, ["12 – 3", "CAPÍTULO UM", "p. 12", "https://x.y/z", "Uma frase normal."], text.is_noise) == [True, True, True, True, False]


def test_names_lose_all_titles(spark):
    assert _each(spark, ["o arquiteto Prof. Dr. João Lima (1930)", "Ana,"], text.clean_name) == ["João Lima", "Ana"]
    assert _each(spark, ["AFONSO, Alcília", "Mário de Sá Filho", "Ana", None], text.surname) == ["AFONSO", "Mário", "Ana", None]


def test_years_are_modal_then_latest(spark):
    assert _each(spark, ["1998 2004 1998 2004 1950", "none 20045", "x1999"], text.modal_year) == [2004, None, None]


def test_periods(spark):
    cases = ["1950-1954", "1954-", "1958", "-1937", "anos 1950", "c. 1960", "década de 1937", "soon", "", None, "1960-1950", "ANOS 1950", "1950 - 1954"]
    got = [tuple(x) if x else None for x in _each(spark, cases, period.parse)]
    assert got == [(1950, 1954), (1954, None), (1958, 1958), (None, 1937), (1950, 1959), (1960, 1960), (1930, 1939), None, None, None, (1960, 1950), (1950, 1959), (1950, 1954)]
    closed = [tuple(x) if x else None for x in _each(spark, ["1954-", "-1937", None], lambda c: period.effective(period.parse(c)))]
    assert closed == [(1954, 1954), (1937, 1937), None]


def test_literal_excerpts(spark):
    df = spark.createDataFrame([("um  Texto", "eis Um texto aqui"), ("outro", "um texto"), ("", "x")], "a string, b string")
    assert [r[0] for r in df.select(text.is_literal(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_bibliography(spark):
    many = "SILVA, Ana. LIMA, Rui. COSTA, Eva."
    assert _each(spark, [many, "SILVA, Ana. p. 3 v. 2 n. 4", "SILVA, Ana. p. 3", "plain"], text.is_bibliography) == [True, True, False, False]


def test_unknown_names(spark):
    got = _each(spark, ["Ontem Ana Lima de Sá viu Rui Costa Filho. Apache License", "um só Nome"], text.unknown_names)
    assert got == [["ontem ana lima de sa", "rui costa filho"], []]


def test_ratios():
    assert indel_ratio("abc", "abc") == 100 and indel_ratio("", "") == 100
    assert abs(indel_ratio("abcd", "abxd") - 75) < 1e-9
    assert token_set_ratio("ana lima", "lima ana maria") == 100
    assert token_set_ratio("ana", "rui") < 50
