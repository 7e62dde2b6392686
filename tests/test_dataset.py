"""The knowledge base's files, the rules over them, and the artifacts that are built from them."""

import csv
import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from linkloom.operators import editing, funnel
from linkloom.plans import build
from linkloom.sources import dataset, documents

PERSONS = [
    {"id": "ana-lima", "nome": "Ana Lima", "nome_completo": "Ana Maria Lima", "nascimento": 1900, "atribuicao": "arquiteto", "status": "verificado", "fontes": ["tese-1"], "atuacao": [{"nome": "ESC", "tipo": "escola"}], "formacao": [{"instituicao": "UNI", "curso": "c"}]},
    {"id": "rui-costa", "nome": "Rui Costa", "atribuicao": "professor", "papel_historiografico": "mestre", "status": "rascunho", "pendencia": "dates"},
    {"id": "eva", "nome": "Eva", "status": "rascunho", "nascimento": 1950, "morte": 1940, "apelido": "E"},
]
RELATIONS = [
    {"id": "rel-0001", "origem": "ana-lima", "destino": "rui-costa", "tipo": "estudo", "confianca": "documentado", "periodo": "1950-1954", "fontes": [{"fonte": "tese-1", "pagina": "4", "trecho": "x"}, {"fonte": "gone", "pagina": None, "trecho": None}]},
    {"id": "rel-0002", "origem": "rui-costa", "destino": "ana-lima", "tipo": "societario", "confianca": "hipotese", "rompe": "rel-9999"},
    {"id": "rel-0003", "origem": "ana-lima", "destino": "rui-costa", "tipo": "societario", "confianca": "documentado", "simetrico": True, "fontes": []},
]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    d = tmp_path_factory.mktemp("base")
    write = lambda name, rows: (d / name).write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows))
    write("pessoas.jsonl", PERSONS)
    write("relacoes.jsonl", RELATIONS)
    write("depoimentos.jsonl", [{"id": "dep-0001", "pessoa": "nobody", "existe_escola": None, "argumento": "a", "fonte": {"fonte": "tese-1"}}])
    write("fontes.jsonl", [{"id": "tese-1", "tipo": "tese", "autor": "Lima", "titulo": "T", "ano": 2001}, {"id": "x", "tipo": "scroll", "processado": True}])
    (d / "vocabularios").mkdir()
    (d / "vocabularios/instituicoes.yaml").write_text("- id: ESC\n  nome: Escola\n  tipo: escola\n")
    (d / "vocabularios/aliases.yaml").write_text("# names\nana-lima: [Lima, Dona Ana]\nghost: [lima]\n")
    for source, names in (("s1", ["Zé Souza", "Ana Maria Lima", "Solo"]), ("s2", ["Ze Souza"])):
        (d / "work" / source).mkdir(parents=True)
        (d / "work" / source / "extraidos.jsonl").write_text(json.dumps({"candidato_id": "c", "mencoes_sem_relacao": names}) + "\n")
    return str(d)


def test_tables_of_a_folder(spark, root, tmp_path):
    ds = dataset.load(spark, root)
    assert [r["source_ids"] for r in ds.relations.orderBy("id").collect()] == [["tese-1", "gone"], [], []]
    assert {(r["person"], r["name"]) for r in ds.names().collect()} == {("ana-lima", "Ana Lima"), ("ana-lima", "Ana Maria Lima"), ("rui-costa", "Rui Costa"), ("eva", "Eva"), ("ana-lima", "Lima"), ("ana-lima", "Dona Ana"), ("ghost", "lima")}
    assert dataset.load(spark, str(tmp_path / "none")).persons.count() == 0
    assert {(r["source"], len(r["mencoes_sem_relacao"])) for r in dataset.extractions(spark, root).collect()} == {("s1", 3), ("s2", 1)}
    dataset.save(ds.persons, "persons", f"{tmp_path}/pessoas.jsonl")
    assert {r["id"]: r["name"] for r in dataset.load(spark, str(tmp_path)).persons.collect()} == {p["id"]: p["nome"] for p in PERSONS}


def test_names_of_a_folder_in_texts(spark, root):
    """Longest names first; unknown names hold no known one; regular expressions in the lexicon."""
    known = funnel.gazetteer(dataset.load(spark, root).names())
    lexicon = spark.createDataFrame([("ensino", "estudo", r"alun[oa]s? d[eao]"), ("depoimento", None, "houve uma escola")], "grp string, type string, pattern string")
    said = [
        (1, "Em 1950 a arquiteta Ana Maria Lima foi aluna de Rui Costa e alunas de Zeca Souza Lima também"), (2, "Apenas Lima, limas e Dona Ana aqui, sem outra relação que se diga"), (3, "Houve uma escola, dizia Rui Costa no seu texto de memórias de anos"),
        (4, "Nada de nomes, nada de relações, somente um texto longo o bastante aqui"),
    ]
    chunks = spark.createDataFrame([(f"{i}-0", i, 0, "s", t) for i, t in said], "chunk_id string, doc_id long, idx long, source string, text string")
    got = {r["doc_id"]: r for r in funnel.matched(chunks, known, lexicon).collect()}
    assert sorted((x["person"], x["phrase"]) for x in got[1]["known"]) == [("ana-lima", "ana maria lima"), ("ana-lima", "lima"), ("ghost", "lima"), ("rui-costa", "rui costa")]
    assert got[1]["unknown"] == [] and [t["term"] for t in got[1]["triggers"]] == ["aluna de", "alunas de"]
    assert sorted(x["phrase"] for x in got[2]["known"]) == ["dona ana", "lima", "lima"] and got[2]["n_triggers"] == 0
    assert got[3]["statement"] and got[3]["n_triggers"] == 0
    passed = {r["doc_id"]: r["score2"] for r in funnel.candidates(chunks, known, lexicon).collect()}
    assert passed == {1: 4 * 3 + 2 + 4, 2: 4 * 2 + 4, 3: 4}


def test_rules_over_a_folder(spark, root):
    got = {(r["level"], r["rule"], r["entity"], r["message"]) for r in build.problems(spark, root).collect()}
    for x in (
        ("error", "schema", "persons:eva", "death"), ("error", "schema", "persons:eva", "apelido"), ("error", "schema", "sources:x", "type"), ("error", "reference", "relations:rel-0001", "source_ids"), ("error", "reference", "relations:rel-0002", "breaks"),
        ("error", "reference", "statements:dep-0001", "person"), ("error", "institution", "persons:ana-lima", "educations"), ("warning", "single-token-name", "persons:eva", ""), ("warning", "missing-attribution", "persons:eva", ""),
        ("error", "evidence", "relations:rel-0002", ""), ("error", "evidence", "relations:rel-0003", ""), ("error", "duplicate", "relations:ana-lima-rui-costa-societario", "2"), ("error", "alias", "aliases:ghost", "person"), ("warning", "ambiguous-alias", "aliases:lima", "2"),
    ):
        assert x in got
    assert len(got) == 14


def test_all_artifacts(spark, root, tmp_path):
    out = build.build(spark, root, str(tmp_path / "out"), ["ana-lima", "rui-costa"])
    assert len(out) == 8
    graph = json.loads((tmp_path / "out/graph.json").read_text())
    assert {p["id"]: p["relations"] for p in graph["persons"]} == {"ana-lima": ["rel-0001", "rel-0002", "rel-0003"], "rui-costa": ["rel-0001", "rel-0002", "rel-0003"], "eva": []}
    assert len(graph["edges"]) == 1 and graph["institutions"][0]["members"] == ["ana-lima"] and graph["summary"][0]["edges"] == 1
    rows = list(csv.DictReader((tmp_path / "out/persons.csv").open(encoding="utf-8-sig")))
    assert len(rows) == 3 and len(rows[0]) == 27 and rows[0]["hops_2"] == "1" and rows[1]["isolated"] == "True" and rows[0]["institutions"] == "ESC; UNI"
    relations = list(csv.DictReader((tmp_path / "out/relations.csv").open(encoding="utf-8-sig")))
    assert len(relations) == 3 and len(relations[0]) == 20 and {r["sources"] for r in relations} == {"tese-1; gone", ""}
    text = (tmp_path / "out/open_issues.md").read_text()
    assert "| person | rui-costa | Rui Costa | dates |" in text and "| Ze Souza | 2 | s1, s2 |" in text and "| eva | Eva |" in text and "| tese-1 |" in text
    assert "## Summary" in (tmp_path / "out/metrics.md").read_text() and json.loads((tmp_path / "out/metrics.json").read_text())["Statements"][0]["undefined"] == 1
    for name in ("graph.gexf", "graph.graphml"):
        assert [x.tag.rpartition("}")[2] for x in ET.parse(tmp_path / "out" / name).iter()].count("node") == 3


def test_documents(spark, tmp_path):
    path = str(tmp_path / "a.yaml")
    assert documents.read_yaml(spark, path) is None and documents.read_json(spark, path) is None
    documents.write_aliases(spark, path, {"ana": ["b", "A", "b"]}, "first\n\nlast")
    assert (tmp_path / "a.yaml").read_text() == "# first\n#\n# last\n\nana: [A, b]\n" and documents.read_yaml(spark, path) == {"ana": ["A", "b"]}
    documents.write_json(spark, str(tmp_path / "a.json"), {"é": 1})
    assert documents.read_json(spark, str(tmp_path / "a.json")) == {"é": 1}


def test_decisions_and_their_undoing(spark):
    """A relation, then its repetition with another source, then the first taken back: the state is that of what stands."""
    persons = spark.createDataFrame([("a", "A B"), ("b", "C D")], "id string, name string")
    none = spark.createDataFrame([], "id string, src string, dst string, type string, symmetric boolean, confidence string, source_ids array<string>, issue string")
    made = spark.createDataFrame([(1, "a", "b", "estudo", False, None, "s1", None), (2, "a", "b", "estudo", False, None, "s2", "look"), (3, "b", "a", "estudo", False, None, "s3", None)], "seq int, src string, dst string, type string, symmetric boolean, confidence string, source string, issue string")
    sources = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "id string")
    assert not editing.refusals(made, persons, sources).where("refused is not null").count()
    state = lambda seqs: sorted((r["id"], r["src"], r["source_ids"], r["issue"]) for r in editing.accept_relations(none, made.where(f"seq in ({seqs})")).collect())
    assert state("1, 2, 3") == [("rel-0001", "a", ["s1", "s2"], "look"), ("rel-0002", "b", ["s3"], None)]
    assert state("2, 3") == [("rel-0001", "a", ["s2"], "look"), ("rel-0002", "b", ["s3"], None)]
    after = editing.accept_relations(none, made)
    statements = spark.createDataFrame([], "person string")
    both = persons.unionAll(spark.createDataFrame([("new", "New One"), ("used", "Used")], "id string, name string"))
    left = editing.without_unused(both, spark.createDataFrame([("new",), ("a",)], "id string"), after, statements)
    assert {r["id"] for r in left.collect()} == {"a", "b", "used"}
    assert [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(["Sim", "NÃO", "maybe", None])], "i int, x string").orderBy("i").select(editing.truth(F.col("x"))).collect()] == [True, False, None, None]
